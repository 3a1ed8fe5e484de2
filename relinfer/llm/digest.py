"""Document fingerprints (4): a digest of the quartiles of hashed byte-triplet counts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relinfer.session import cut

BUCKETS = 256
# Differences of this many points or more mean no likeness.
FULL_DIFFERENCE = 300
# An upper quartile apart from a lower one by all three steps weighs double.
STEP_POINTS = np.array([0, 1, 2, 6])

RESULT = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def _mix() -> np.ndarray:
    """Three tables of 256 pseudo-random bytes, one for each place in a triplet."""
    x = np.arange(768, dtype=np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(56)).astype(np.uint8).reshape(3, 256)


MIX = _mix()


def fingerprint(text: bytes) -> str:
    """Hex digest: 2 digits of length, 2 of quartile ratios, then 2 bits for each bucket.

    A bucket's bits tell between which quartiles of all bucket counts its own count lies.
    The length is kept as its logarithm in steps of a tenth. Texts of fewer than three
    bytes have no triplets and all bits 0.
    """
    b = np.frombuffer(text, np.uint8)
    if len(b) > 2:
        bucket = MIX[0][b[:-2]] ^ MIX[1][b[1:-1]] ^ MIX[2][b[2:]]
        count = np.bincount(bucket, minlength=BUCKETS)
    else:
        count = np.zeros(BUCKETS, np.int64)
    q = np.sort(count)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (count > q[0]).astype(np.uint8) + (count > q[1]) + (count > q[2])
    size = min(255, round(10 * math.log(1 + len(b))))
    ratio = [int(15 * x // max(1, q[2])) for x in q[:2]]
    four = code.reshape(-1, 4)
    packed = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
    return f"{size:02x}{ratio[0]:x}{ratio[1]:x}" + packed.astype(np.uint8).tobytes().hex()


def difference(a: str, b: str) -> int:
    """Points between two digests: quartile steps of each bucket, ratios, and length (at most 60)."""
    x, y = (np.frombuffer(bytes.fromhex(s[4:]), np.uint8) for s in (a, b))
    steps = sum(STEP_POINTS[np.abs((x >> s & 3).astype(np.int8) - (y >> s & 3).astype(np.int8))].sum() for s in (0, 2, 4, 6))
    ratios = sum(abs(int(a[k], 16) - int(b[k], 16)) for k in (2, 3))
    return int(steps) + ratios + min(60, abs(int(a[:2], 16) - int(b[:2], 16)))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from FULL_DIFFERENCE points on."""
    return 1.0 - min(difference(a, b), FULL_DIFFERENCE) / FULL_DIFFERENCE


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as much of the start of `following`."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _result(id_: int | None, text: str, print_: str, following: str, next_print: str) -> tuple:
    new = edited(text, following).encode()
    new_print = fingerprint(new)
    return (
        id_, len(text), hashlib.sha256(new).hexdigest(), print_, new_print,
        likeness(print_, new_print), likeness(print_, next_print),
    )


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is the one before in ascending order of the integer id (nulls
    first), the last for the first; a lone document follows itself. Rows with equal ids
    are ordered by text. Null text is empty. An empty table gives an empty table; other
    columns aren't returned.

    Documents are ordered by a range partitioning, the only shuffle of the texts. Each
    task goes through its range and hands on its first and last document: one row of a
    task, whose neighbours are then found in a table as long as there are partitions.
    """
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    names = ["id", *(x.split()[0] for x in RESULT.split(", "))]
    edge = "struct<id: bigint, text: string>"
    schema = pa.schema([
        ("id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in names[2:5]),
        ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])
    ends = pa.struct([("id", pa.int64()), ("text", pa.string())])
    full = schema.append(pa.field("part", pa.int32())).append(pa.field("head", ends)).append(pa.field("tail", ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = tail = None
        before = ""
        for batch in batches:
            out = []
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                print_ = fingerprint(text.encode())
                if head is None:
                    head = {"id": id_, "text": text}
                else:
                    out.append(dict(zip(names, _result(id_, text, print_, tail["text"], before))))
                tail, before = {"id": id_, "text": text}, print_
            yield pa.RecordBatch.from_pylist(out, full)
        if head is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"part": part, "head": head, "tail": tail}], full)

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text, following = row["head"]["text"], row["tail"]["text"]
                prints = fingerprint(text.encode()), fingerprint(following.encode())
                out.append(dict(zip(names, _result(row["head"]["id"], text, prints[0], following, prints[1]))))
            yield pa.RecordBatch.from_pylist(out, schema)

    found = cut(
        rows.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
        .mapInArrow(run, f"id bigint, {RESULT}, part int, head {edge}, tail {edge}")
    )
    ranges = found.where("part IS NOT NULL")
    by_part = Window.orderBy("part")
    neighbours = ranges.select(
        "head",
        F.coalesce(F.lag("tail").over(by_part), F.first("tail").over(Window.orderBy(F.desc("part")))).alias("tail"),
    )
    closed = neighbours.mapInArrow(join_ends, f"id bigint, {RESULT}")
    return found.where("part IS NULL").select(names).unionByName(closed).withColumnRenamed("id", id_col)
