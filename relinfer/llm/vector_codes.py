"""Vector code compression (11): product codes by exact integer k-means over Hilbert-sorted blocks.

Every part of a vector is a short row of integers. The rows of a part position are sorted along
a Hilbert curve and cut into flat blocks, each with its box (least and greatest components), its
sum and its count, in a table in the shared folder. A round reads the boxes: an entry whose least
distance to a box exceeds the smallest greatest distance of any entry is nearest to no row of it.
A block left with one entry gives its stored sum; else the rows are compared with the entries left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relinfer.operators.skew import with_group_value
from relinfer.session import cut, drop_table, new_table_path

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
# Components in a flat block; a block of wide parts holds at least MIN_ROWS rows.
BLOCK_VALUES = 2048
MIN_ROWS = 16
# Bits of a place on the curve: up to 8 for a component, and at least one.
KEY_BITS = 64
# Integers from here on are refused; below, no sum over a block leaves 64 bits.
MAX_INTEGER = 2**50
RESULT = "code string, error bigint, label_error bigint, codebooks_sha256 string"


@dataclass
class Codebooks:
    """entries[part] has the integer entries (entry, component) of a part position."""

    entries: list[np.ndarray]

    def sha256(self) -> str:
        """Of all components, by part, entry and place."""
        numbers = (str(v) for part in self.entries for entry in part.tolist() for v in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


@dataclass
class Extent:
    """Least and greatest integer of every component of all vectors."""

    low: np.ndarray
    high: np.ndarray

    def part_width(self, parts: int) -> int:
        return len(self.low) // parts

    def stored_type(self) -> np.dtype:
        """The smallest integers that hold all components."""
        least, greatest = int(self.low.min()), int(self.high.max())
        return next(d for d in map(np.dtype, ("<i2", "<i4", "<i8")) if np.iinfo(d).min <= least and greatest <= np.iinfo(d).max)

    def exact_type(self) -> np.dtype:
        """64 bits where no squared distance exceeds them, else numbers of any size."""
        widest = sum((int(b) - int(a)) ** 2 for a, b in zip(self.low, self.high))
        return np.dtype(np.int64 if widest < 2**62 else object)


def hilbert_keys(x: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve of points (n, dims) with `bits` bits a component, as bytes that sort alike."""
    x = x.astype(np.uint16)
    n, dims = x.shape
    for b in range(bits - 1, 0, -1):
        low = np.uint16((1 << b) - 1)
        for i in range(dims):
            is_set = (x[:, i] >> b) & 1 == 1
            swap = np.where(is_set, 0, (x[:, 0] ^ x[:, i]) & low).astype(np.uint16)
            x[:, 0] ^= np.where(is_set, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.uint16)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> b) & 1 == 1, (1 << b) - 1, 0).astype(np.uint16)
    x ^= turn[:, None]
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(box, entry): whether the entry may be nearest to a point of the box (low, high).

    An entry goes only if another one is strictly nearer to all points of the box, so ties stay.
    """
    shape = len(low), len(entries)
    near, far = np.zeros(shape, entries.dtype), np.zeros(shape, entries.dtype)
    for c in range(entries.shape[1]):
        below = low[:, c, None] - entries[None, :, c]
        above = entries[None, :, c] - high[:, c, None]
        gap = np.maximum(np.maximum(below, above), 0)
        reach = np.maximum(-below, -above)
        near += gap * gap
        far += reach * reach
    return near <= far.min(1)[:, None]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each point, the lower one of equals, and the squared distance."""
    distance = np.zeros((len(points), len(entries)), entries.dtype)
    for c in range(entries.shape[1]):
        away = points[:, c, None] - entries[None, :, c]
        distance += away * away
    at = distance.argmin(1)
    return at, distance[np.arange(len(points)), at]


def _integers(vectors: DataFrame, vec_col: str, scale: int) -> DataFrame:
    """vectors that hold finite components only, with the integers floor(scale * x) in `_v`."""
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = vectors.withColumn("_v", F.col(vec_col).cast("array<double>")).where((F.size("_v") > 0) & finite)
    too_large = F.raise_error(F.lit(f"a component is not below {MAX_INTEGER} when multiplied by {scale}"))

    def integer(x):
        y = F.floor(x * F.lit(float(scale)))
        return F.when(F.abs(x) < F.lit(MAX_INTEGER / scale), y).otherwise(too_large.cast("bigint"))

    return whole.withColumn("_v", F.transform("_v", integer))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of lists of one length as rows."""
    lists = batch.column(column)
    widths = np.unique(lists.value_lengths().to_numpy(zero_copy_only=False))
    if len(widths) != 1:
        raise ValueError("all vectors must have one length")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, widths[0])


def _extent(rows: DataFrame, parts: int) -> Extent | None:
    """Of all integer vectors; None if there are none. As long as a vector, however many there are."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch, "_v")
                if low is not None and len(low) != m.shape[1]:
                    raise ValueError("all vectors must have one length")
                low = m.min(0) if low is None else np.minimum(low, m.min(0))
                high = m.max(0) if high is None else np.maximum(high, m.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(low)), pa.int32()), pa.array(low), pa.array(high)], ["at", "low", "high"])

    found = rows.select("_v").mapInArrow(ends, "at int, low bigint, high bigint").groupBy("at").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("n")
    ).orderBy("at").collect()
    if not found:
        return None
    if len(found) % parts or len({r.n for r in found}) != 1:
        raise ValueError(f"all vectors must have one length, a multiple of {parts}")
    return Extent(np.array([r.low for r in found]), np.array([r.high for r in found]))


def _part_rows(rows: DataFrame, extent: Extent, parts: int) -> DataFrame:
    """A row for each part of each vector: (_part, _key, _row, _id, _label, _p); id and label go with part 0."""
    width, stored = extent.part_width(parts), extent.stored_type()
    bits = max(1, min(8, KEY_BITS // width))
    low, span = extent.low, extent.high - extent.low + 1
    schema = T.StructType([
        T.StructField("_part", T.IntegerType()), T.StructField("_key", T.BinaryType()), T.StructField("_row", T.LongType()),
        rows.schema["_id"], rows.schema["_label"], T.StructField("_p", T.BinaryType()),
    ])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch, "_v")
            cell = ((m - low) << bits) // span
            for part in range(parts):
                own = slice(part * width, (part + 1) * width)
                raw = np.ascontiguousarray(m[:, own].astype(stored))
                named = [batch.column(c) if part == 0 else pa.nulls(len(m), batch.schema.field(c).type) for c in ("_id", "_label")]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(m), part, np.int32)), pa.array(hilbert_keys(cell[:, own], bits), pa.binary()),
                    batch.column("_row"), *named, pa.array([r.tobytes() for r in raw], pa.binary()),
                ], schema.names)

    return rows.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(split, schema)


def _blocks(sorted_rows: DataFrame, extent: Extent, parts: int) -> DataFrame:
    """Flat blocks of rows sorted by (_part, _key): values, box, sum, rows and what goes with them."""
    width, stored = extent.part_width(parts), extent.stored_type()
    size = max(MIN_ROWS, BLOCK_VALUES // width)
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("points", T.BinaryType()), T.StructField("low", longs),
        T.StructField("high", longs), T.StructField("total", longs), T.StructField("rows", longs),
        T.StructField("ids", T.ArrayType(sorted_rows.schema["_id"].dataType)), T.StructField("labels", T.ArrayType(sorted_rows.schema["_label"].dataType)),
    ])

    def block(part: int, rows: pa.Table) -> pa.RecordBatch:
        flat = b"".join(rows.column("_p").to_pylist())
        points = np.frombuffer(flat, stored).reshape(-1, width).astype(np.int64)
        lists = [[a.tolist()] for a in (points.min(0), points.max(0), points.sum(0))]
        kept = [[rows.column(c).to_pylist()] for c in ("_row", "_id", "_label")]
        if part:
            kept[1:] = [None], [None]
        types = [rows.schema.field(c).type for c in ("_row", "_id", "_label")]
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([flat], pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in lists),
            *(pa.array(x, pa.list_(t)) for x, t in zip(kept, types)),
        ], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, n = None, [], 0
        for batch in batches:
            at = batch.column("_part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)] if len(at) else [0]
            for start, end in zip(edges, edges[1:]):
                if at[start] != now and n:
                    yield block(now, pa.Table.from_batches(waiting))
                    waiting, n = [], 0
                now = int(at[start])
                while start < end:
                    taken = min(end - start, size - n)
                    waiting.append(batch.slice(start, taken))
                    start, n = start + taken, n + taken
                    if n == size:
                        yield block(now, pa.Table.from_batches(waiting))
                        waiting, n = [], 0
        if n:
            yield block(now, pa.Table.from_batches(waiting))

    return sorted_rows.mapInArrow(run, schema)


def _each_block(batch: pa.RecordBatch, books: list[np.ndarray], stored: np.dtype):
    """(row of the batch, part, entries left, points) of every block of a batch."""
    exact = books[0].dtype
    part = batch.column("part").to_numpy()
    low, high = (_matrix(batch, c).astype(exact) for c in ("low", "high"))
    flat = batch.column("points")
    for p in np.unique(part):
        own = np.flatnonzero(part == p)
        for k, left in zip(own, shortlists(low[own], high[own], books[p])):
            points = np.frombuffer(flat[int(k)].as_buffer(), stored).reshape(-1, low.shape[1])
            yield int(k), int(p), np.flatnonzero(left), points


def _round(blocks: DataFrame, books: Codebooks, extent: Extent) -> Codebooks:
    """Entries replaced by the floored means of the parts that they are nearest to."""
    entries, stored = books.entries, extent.stored_type()
    width = entries[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One more component counts.
        found = [np.zeros((len(e), width + 1), object) for e in entries]
        for batch in batches:
            if not batch.num_rows:
                continue
            totals = _matrix(batch, "total")
            for k, p, left, points in _each_block(batch, entries, stored):
                if len(left) == 1:
                    found[p][left[0], :-1] += totals[k]
                    found[p][left[0], -1] += len(points)
                    continue
                wide = points.astype(np.int64)
                at, _ = nearest(wide.astype(entries[p].dtype), entries[p][left])
                for e in np.unique(at):
                    own = wide[at == e]
                    found[p][left[e], :-1] += own.sum(0)
                    found[p][left[e], -1] += len(own)
        grid = [(p, e, c, Decimal(int(v))) for p, part in enumerate(found) for e, row in enumerate(part) if row[-1] for c, v in enumerate(row)]
        if grid:
            columns = zip(*grid)
            types = pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types)], ["part", "entry", "at", "value"])

    read = blocks.select("part", "points", "low", "high", "total")
    rows = (
        read.mapInArrow(sums, "part int, entry int, at int, value decimal(38,0)")
        .groupBy("part", "entry", "at").agg(F.sum("value").alias("value")).collect()
    )
    total = {(r.part, r.entry, r["at"]): int(r.value) for r in rows}
    new = [e.copy() for e in entries]
    for (p, e, at), value in total.items():
        if at < width:
            new[p][e, at] = value // total[p, e, width]
    return Codebooks(new)


def _assigned(blocks: DataFrame, books: Codebooks, extent: Extent) -> DataFrame:
    """(row, part, entry, error, id, label) of every part; id and label go with part 0."""
    entries, stored = books.entries, extent.stored_type()
    named = {c: blocks.schema[c].dataType.elementType for c in ("ids", "labels")}
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()),
        T.StructField("error", T.LongType()), T.StructField("id", named["ids"]), T.StructField("label", named["labels"]),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, p, left, points in _each_block(batch, entries, stored):
                at, error = nearest(points.astype(entries[p].dtype), entries[p][left])
                rows = batch.column("rows")[k].values
                kept = [batch.column(c)[k].values if p == 0 else pa.nulls(len(at), batch.schema.field(c).type.value_type) for c in named]
                yield pa.RecordBatch.from_arrays([
                    rows, pa.array(np.full(len(at), p, np.int32)), pa.array(left[at].astype(np.int32)),
                    pa.array(error.tolist(), pa.int64()), *kept,
                ], schema.names)

    return blocks.select("part", "points", "low", "high", "rows", *named).mapInArrow(run, schema)


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """Codes (id, code, error, label_error, codebooks_sha256) of vectors, and the codebooks.

    A component x counts as floor(scale * x). The codebook of each part position starts as that part of the
    vectors with the smallest ids; every round replaces its entries by floored means.

    Left out: vectors that are null, empty, or hold a null or a component that isn't finite. Null
    ids come after all others; of equal ids the smaller vector comes first, and rows that are equal in all
    are rows of their own. Fewer vectors than entries: fewer entries. Ties go to the lower entry. Null
    labels have one sum together. Other columns are not carried. No vectors: an empty result. Vectors of different
    lengths, lengths that are no multiple of `parts`, integers beyond MAX_INTEGER and sums beyond 64 bits are errors.

    The blocks are a table in the shared folder, read once a round; the driver gets entries * width
    sums, whatever the number of vectors.
    """
    spark = vectors.sparkSession
    rows = _integers(vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vec_col).alias("_x")), "_x", scale).drop("_x")
    extent = _extent(rows, parts)
    if extent is None:
        none = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, {RESULT}"
        return spark.createDataFrame([], none), Codebooks([])
    first = rows.orderBy(F.asc_nulls_last("_id"), "_v").limit(entries).collect()
    start = np.array([r["_v"] for r in first]).astype(extent.exact_type())
    books = Codebooks([np.ascontiguousarray(p) for p in np.split(start, parts, axis=1)])

    path = new_table_path(spark, "blocks")
    order = ["_part", "_key", "_row"]
    ranged = _part_rows(rows, extent, parts).repartitionByRange(*order).sortWithinPartitions(*order)
    _blocks(ranged, extent, parts).write.parquet(path)
    blocks = spark.read.parquet(path)
    for _ in range(rounds):
        books = _round(blocks, books, extent)
    entry = [F.lower(F.lpad(F.hex(F.max(F.when(F.col("part") == p, F.col("entry")))), 2, "0")) for p in range(parts)]
    codes = cut(_assigned(blocks, books, extent).groupBy("row").agg(
        F.max("id").alias("_id"), F.max("label").alias("_label"), F.concat(*entry).alias("code"), F.sum("error").alias("error")
    ).drop("row"))
    drop_table(spark, path)
    summed = with_group_value(codes, "_label", label_error=F.sum("error"))
    return summed.select(
        F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    ), books


def _codes_sql() -> str:
    away = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(s, c)])::BIGINT"
    steps = [f"""c0 AS MATERIALIZED (
  SELECT p, n - 1 AS e, s AS c FROM (SELECT p, s, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS n FROM parts)
  WHERE n <= {ENTRIES}
)"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT vec_id, p, any_value(s) AS s, min([d, e]) AS best
  FROM (SELECT vec_id, p, s, e, {away} AS d FROM parts JOIN c{k} USING (p)) GROUP BY vec_id, p
)""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS (
  SELECT p, e, list(mean ORDER BY i) AS mean FROM (
    SELECT p, e, i, floor(sum(x) / count(*))::BIGINT AS mean
    FROM (SELECT p, best[2] AS e, unnest(s) AS x, unnest(range(len(s))) AS i FROM a{k}) GROUP BY p, e, i
  ) GROUP BY p, e
), c{k + 1} AS MATERIALIZED (
  SELECT c{k}.p, c{k}.e, coalesce(mean, c) AS c FROM c{k} LEFT JOIN m{k} ON c{k}.p = m{k}.p AND c{k}.e = m{k}.e
)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), parts AS (
  SELECT vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS s FROM kept, range({PARTS}) t(p)
), {", ".join(steps)}, codes AS (
  SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error
  FROM a{ROUNDS} GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), books
"""


VECTOR_CODES_SQL = _codes_sql()
