"""N-gram Jaccard join (2): chosen-path similarity join of word-shingle sets.

Sets are embedded as minhash sketches: coordinate i with its value stands for one token
of the set, and two sets share a coordinate's token with the probability of their
Jaccard similarity. A run starts with all sets in one bucket; a bucket samples few
coordinates and is split by their tokens, again and again, until buckets are small and
are compared pair by pair. Runs are repeated until the target recall. What the sketches
leave is verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relinfer.llm.common import add_columns, byte_words, text_bytes, text_key
from relinfer.llm.components import components
from relinfer.session import cut

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
# Coordinates of a sketch, and how many of them a bucket samples on average.
COORDINATES = 128
SAMPLED = 1 / 0.7
# Buckets up to this size are compared; larger ones are split, at most MAX_DEPTH times in a row.
SMALL = 64
# A bucket that holds this share of its parent's members isn't split any further.
DENSE = 0.7
MAX_DEPTH = 4
# A bucket up to this size is split to the end by one task, which holds its sketches (512 bytes a set).
HELD = 16_384
# Sets, and shingles in them, that a task compares with as many others at once.
BLOCK = 256
BLOCK_SHINGLES = 1_000_000
# Standard deviations below the similarity down to which a sketch passes.
MARGIN = 4.5

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


FACTORS = (mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
# Words whose hashes are remembered within an Arrow batch.
CACHE_WORDS = 100_000


def shingles(text: bytes, words: int = WORDS, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words; of all words if there are fewer."""
    known = {} if known is None else known
    if len(known) > CACHE_WORDS:
        known.clear()
    found = byte_words(text)
    if not found:
        return np.empty(0, np.uint64)
    hashes = []
    for w in found:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    w = np.array(hashes, np.uint64)
    size = min(words, len(w))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        h = mix64(h + w[k : k + len(h)])
    return np.unique(h)


def sketch(s: np.ndarray) -> np.ndarray:
    """The least of the shingles under each of COORDINATES orders."""
    low = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        x = low[at : at + 1024, None] * FACTORS
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(out, x.min(0), out=out)
    return out


def survival(similarity: float, depth: int) -> float:
    """Chance that a pair of this similarity is still together after so many splits of a run."""
    chance = 1.0
    for _ in range(depth):
        chance = 1 - (1 - SAMPLED / COORDINATES * similarity * chance) ** COORDINATES
    return chance


def runs_for(similarity: float, recall: float, depth: int = MAX_DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, depth)))


def _children(sketches: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of each child bucket: the coordinates a bucket samples depend on its path alone."""
    coordinate = np.arange(COORDINATES, dtype=np.uint64)
    draw = mix64(paths[:, None] + mix64(coordinate + np.uint64(1)))
    row, at = np.nonzero(draw < np.uint64(int(SAMPLED / COORDINATES * 2**64)))
    return row, mix64(draw[row, at] + sketches[row, at].astype(np.uint64))


def _matrix(column: pa.Array, width: int, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _split(rows: DataFrame, roots: list[int] | None) -> DataFrame:
    """(rid, path, m): children of the buckets of (rid, sketch[, path, n]); of the roots if there is no path.

    m is the size of the bucket that was split, null for the roots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketches = _matrix(batch.column("sketch"), COORDINATES, np.uint32)
            paths = None if roots is not None else batch.column("path").to_numpy().view(np.uint64)
            sizes = pa.nulls(len(sketches), pa.int64()) if roots is not None else batch.column("n")
            for root in [None] if roots is None else roots:
                at = paths if root is None else np.full(len(sketches), root, np.uint64)
                row, path = _children(sketches, at)
                if len(row):
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("rid").take(at), pa.array(path.view(np.int64)), sizes.take(at)], ["rid", "path", "m"]
                    )

    return rows.mapInArrow(run, "rid bigint, path bigint, m bigint")


def _shared(split: DataFrame) -> DataFrame:
    """(rid, path, m, n): members of the buckets with two members or more, cut."""
    # A window: counts joined back would have the rows split twice.
    return cut(split.withColumn("n", F.count("*").over(Window.partitionBy("path"))).where("n > 1"))


def _ready(sizes: np.ndarray, parents: np.ndarray) -> np.ndarray:
    return (sizes <= SMALL) | (sizes >= DENSE * parents)


def _split_held(rows: DataFrame, depth: int) -> DataFrame:
    """(rid, path, n): the buckets to compare below those of (rid, path, n, sketch), split `depth` times at most.

    A bucket is split where it lies, and of its children only the buckets to compare come out.
    """
    schema = pa.schema([("rid", pa.int64()), ("path", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ("path",)):
            sketches, rid = _matrix(t["sketch"], COORDINATES, np.uint32), t["rid"].to_numpy()
            at, path, parent = np.arange(t.num_rows), t["path"].to_numpy().view(np.uint64), t["n"].to_numpy()
            for left in reversed(range(depth)):
                row, path = _children(sketches[at], path)
                _, bucket, sizes = np.unique(path, return_inverse=True, return_counts=True)
                at, parent, size = at[row], parent[row], sizes[bucket]
                done = _ready(size, parent) if left else np.ones(len(size), bool)
                out = (size > 1) & done
                if out.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rid[at[out]]), pa.array(path[out].view(np.int64)), pa.array(size[out], pa.int64())], schema=schema
                    )
                at, path, parent = at[~done], path[~done], size[~done]
                if not len(at):
                    break

    return (
        rows.select("rid", "path", "n", "sketch").repartition("path").sortWithinPartitions("path")
        .mapInArrow(run, "rid bigint, path bigint, n bigint")
    )


def leaf_buckets(sets: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(rid, path, n): the buckets to compare, of all runs.

    A bucket is compared when it is small, when it kept most of the members of the bucket
    it comes from (its sets are near each other, splitting leads nowhere), or at the
    greatest depth. Buckets of more than HELD members are split by a shuffle each time, others to the end by a task.
    """
    roots = [int(x) for x in mix64(np.arange(1, runs_for(similarity, recall) + 1, dtype=np.uint64) * M2)]
    sketches = sets.select("rid", "sketch")
    ready = (F.col("n") <= SMALL) | F.coalesce(F.col("n") >= DENSE * F.col("m"), F.lit(False))
    names = ("rid", "path", "n")
    open_ = _shared(_split(sketches, roots))
    leaves = open_.where(ready).select(*names)
    for depth in reversed(range(1, MAX_DEPTH)):
        big = open_.where(~ready).select(*names)
        leaves = leaves.union(_split_held(big.where(F.col("n") <= HELD).join(sketches, "rid"), depth))
        huge = big.where(F.col("n") > HELD)
        if huge.isEmpty():
            return leaves
        open_ = _shared(_split(huge.join(sketches, "rid"), None))
        leaves = leaves.union(open_.where(ready).select(*names))
    return leaves.union(open_.where(~ready).select(*names))


def _block_pairs(members: DataFrame, group: str, blocks: F.Column) -> DataFrame:
    """A row for each pair of blocks of its group that a member is in: columns block, x, y."""
    spread = members.withColumn("_m", blocks.cast("int"))
    own = F.pmod(F.xxhash64("rid", group), F.col("_m")).cast("int")
    return (
        spread.withColumn("block", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
        .withColumn("x", F.least("block", "_o")).withColumn("y", F.greatest("block", "_o")).drop("_m", "_o")
    )


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The groups of batches sorted by the integer columns `keys`."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if not t.num_rows:
            continue
        k = np.stack([t[c].to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield t.slice(a, b - a)
        held = t.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def _roots(pairs: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows: the least row it is connected with by the symmetric matrix `pairs`."""
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(pairs, label, n).min(1, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _to_compare(block: np.ndarray, x: int, y: int) -> np.ndarray:
    if x == y:
        return ~np.eye(len(block), dtype=bool)
    return block[:, None] != block


def _candidate_edges(leaves: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): sets that pass by their sketches, as a spanning forest of each bucket's pairs.

    A byte of each coordinate is enough to compare. Trees are stars around the least id, so
    that the buckets of a class mostly name one centre.
    """
    least = math.floor(COORDINATES * (similarity - MARGIN * math.sqrt(similarity * (1 - similarity) / COORDINATES)))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def shorten(batch: pa.RecordBatch) -> list[pa.Array]:
        brief = _matrix(batch.column("sketch"), COORDINATES, np.uint32).astype(np.uint8)
        return [pa.array([x.tobytes() for x in brief], pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [np.empty((2, 0), np.int64)], 0
        for t in _groups(batches, ("path", "x", "y")):
            if t.num_rows < 2:
                continue
            t = t.sort_by("rid")
            size, brief = t["size"].to_numpy(), _matrix(t["brief"], COORDINATES, np.uint8)
            pairs = np.minimum(size[:, None], size) >= similarity * np.maximum(size[:, None], size) - 1e-9
            np.fill_diagonal(pairs, False)
            i, j = np.nonzero(np.triu(pairs))
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                near = (brief[p] == brief[q]).sum(1) >= least
                pairs[p, q] = pairs[q, p] = near
            root, own = _roots(pairs, len(size)), np.arange(len(size))
            if t["x"][0].as_py() != t["y"][0].as_py():
                # Each block's own trees come out where it meets itself: here, only what joins them.
                block = t["block"].to_numpy()
                own = _roots(pairs & (block[:, None] == block), len(size))
            leaf = np.flatnonzero((root != np.arange(len(size))) & (own == np.arange(len(size))))
            if len(leaf):
                rid = t["rid"].to_numpy()
                found.append(np.stack([rid[root[leaf]], rid[leaf]]))
                held += len(leaf)
            if held > 50_000:
                # Buckets of other runs find the same edges again.
                a, b = np.unique(np.concatenate(found, 1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)
                found, held = [np.empty((2, 0), np.int64)], 0
        a, b = np.unique(np.concatenate(found, 1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    briefs = add_columns(sets.select("rid", "size", "sketch"), "brief binary", shorten, drop=("sketch",))
    spread = _block_pairs(leaves.join(briefs, "rid"), "path", F.ceil(F.col("n") / BLOCK))
    return (
        spread.select("path", "x", "y", "block", "rid", "size", "brief").repartition("path", "x", "y")
        .sortWithinPartitions("path", "x", "y").mapInArrow(run, "a bigint, b bigint")
    )


def _verify(members: DataFrame, similarity: float) -> DataFrame:
    """(rid, root, links) of (group, rid, copies, size, tokens, block, x, y): exact similarities within groups.

    links adds up the copies of linked sets; root is a set that this one is linked with, directly or not.
    """
    schema = pa.schema([("rid", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ("group", "x", "y")):
            n = t.num_rows
            if n < 2:
                continue
            t = t.sort_by("rid")
            size, copies = t["size"].to_numpy().astype(np.int64), t["copies"].to_numpy()
            tokens = np.concatenate([np.frombuffer(v, np.uint64) for v in t["tokens"].to_pylist()])
            row = np.repeat(np.arange(n), size)
            _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
            common = times[column] > 1
            number = np.cumsum(times > 1) - 1
            row, column = row[common], number[column[common]]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            both = np.zeros((n, n), np.float64)
            width = 8192
            for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
                a, b = np.searchsorted(column, (first, first + width))
                part = np.zeros((n, width), np.float32)
                part[row[a:b], column[a:b] - first] = 1
                both += part @ part.T
            pairs = _to_compare(t["block"].to_numpy(), t["x"][0].as_py(), t["y"][0].as_py())
            pairs &= (1 + similarity) * both >= similarity * (size[:, None] + size) - 1e-9
            links, root = pairs @ copies, _roots(pairs, n)
            linked = np.flatnonzero(links)
            rid = t["rid"].to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[linked]), pa.array(rid[root[linked]]), pa.array(links[linked], pa.int64())], schema=schema
            )

    return (
        members.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y")
        .mapInArrow(run, "rid bigint, root bigint, links bigint")
    )


def _set_columns(batch: pa.RecordBatch) -> list[pa.Array]:
    keys, sizes, sketches, known = [], [], [], {}
    for text in text_bytes(batch, "text"):
        s = shingles(text, known=known)
        keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
        sizes.append(len(s))
        sketches.append(sketch(s).tobytes() if len(s) else None)
    return [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())]


def _token_columns(batch: pa.RecordBatch) -> list[pa.Array]:
    known: dict[bytes, int] = {}
    found = [shingles(t, known=known) for t in text_bytes(batch, "text")]
    return [
        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary()),
        pa.array([s.tobytes() for s in found], pa.binary()),
    ]


def classify(docs: DataFrame, id_col: str, text_col: str, similarity: float, recall: float) -> DataFrame:
    """(id, tk, class_id, n_links, stays): a row for each document; tk is its text's hash."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(text_col).alias("tk"))
    keyed = cut(add_columns(rows, "key binary, size int, sketch binary", _set_columns, drop=("text",)))
    place = F.struct(F.col("id").isNull().alias("blank"), "id", "tk")
    # The number of a set is written with it, and so stays the same.
    sets = cut(
        keyed.where("key IS NOT NULL").groupBy("key").agg(
            F.min(place).alias("first"), F.count("*").alias("copies"),
            F.first("size").alias("size"), F.first("sketch").alias("sketch"),
        ).withColumn("rid", F.monotonically_increasing_id())
    )
    near = components(_candidate_edges(leaf_buckets(sets, similarity, recall), sets, similarity))
    members = cut(
        near.select(F.col("node").alias("rid"), "root").join(sets.select("rid", "key", "first", "copies", "size"), "rid")
    )
    totals = members.groupBy("root").agg(F.count("*").alias("_n"), F.sum("size").alias("_s"))
    texts = rows.join(
        members.select(F.col("first.id").alias("_id"), F.col("first.tk").alias("_tk")),
        F.col("id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk")),
    ).select("text")
    tokens = add_columns(texts, "key binary, tokens binary", _token_columns, drop=("text",)).dropDuplicates(["key"])
    grouped = members.join(totals, "root").join(tokens, "key")
    blocks = F.greatest(F.ceil(F.col("_n") / BLOCK), F.ceil(F.col("_s") / BLOCK_SHINGLES))
    spread = _block_pairs(grouped, "root", blocks).select(
        F.col("root").alias("group"), "x", "y", "block", "rid", "copies", "size", "tokens"
    )
    linked = cut(_verify(spread, similarity))
    links = linked.groupBy("rid").agg(F.sum("links").alias("links"))
    classes = components(linked.select(F.col("root").alias("a"), F.col("rid").alias("b")))
    named = classes.withColumnRenamed("node", "rid").join(members.select("rid", "key", "first"), "rid").join(links, "rid")
    named = cut(named.drop("rid"))
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    near = named.join(heads, "root").select("key", "head", "links")
    result = sets.select("key", "first", "copies").join(near, "key", "left").select(
        "key", F.coalesce("head", "first").alias("head"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    alone = F.col("key").isNull()
    return keyed.select("id", "tk", "key").join(result, "key", "left").select(
        "id", "tk", F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), (alone | (place == F.col("head"))).alias("stays"),
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    similarity: float = SIMILARITY, recall: float = RECALL,
) -> DataFrame:
    """(id, class_id, n_links): classes of documents whose sets of five-word shingles are near.

    Two documents are linked if the Jaccard similarity of their sets is at least
    `similarity`; a class is a connected component, named by its least id. n_links counts
    the other documents that a document is linked with. Texts of fewer than five words
    have one shingle, of all their words. Null and empty texts and texts without words have none
    and are linked with nothing: their class is their own id. A document is a row:
    rows with equal ids count each. A null id names a class only if no member has another.
    Other columns aren't returned; an empty table gives an empty table.

    Documents with equal sets are one set from the first step on; they are counted, not
    paired. Sets in one component of sketch-similar sets are compared in blocks, so
    that a group of any size is spread over tasks and only one row a set and pair of blocks comes out.
    """
    return classify(docs, id_col, text_col, similarity, recall).select(F.col("id").alias(id_col), "class_id", "n_links")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    similarity: float = SIMILARITY, recall: float = RECALL,
) -> DataFrame:
    """docs with the first document (by id, then text) of each class of near_duplicates.

    Rows equal in id and text are one document and stay or go together. All columns are kept.
    """
    gone = classify(docs, id_col, text_col, similarity, recall).where("NOT stays").select(
        F.col("id").alias("_id"), F.col("tk").alias("_tk")
    ).distinct()
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (text_key(text_col) == F.col("_tk"))
    return docs.join(gone, same, "left_anti")
