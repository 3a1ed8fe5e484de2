"""LM scoring (5): context-tree weighting over binary-decomposed bytes, next to a word baseline.

A byte is eight binary choices; each of the 255 inner nodes of that decision tree has
a context tree of its own, whose levels are the last 0 to DEPTH bytes. A node of it predicts by the
Krichevsky-Trofimov estimate of its counts and is mixed with its children by weights
that follow from how well either coded the training texts.

The tree grows with the corpus, so it is a table: tasks weigh the nodes under the same two last
bytes, from the deepest level up, and only what is above them (256 x 255 nodes) comes to the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relinfer.llm.common import add_columns, text_bytes, text_key
from relinfer.session import cut

# Contexts reach back so many bytes, at least 2 and at most 6: a gram is a number of 8 * (DEPTH + 1) bits.
DEPTH = 4
# Words as frequent as one in so many tokens, and grams as frequent as one in so many bytes, are sent to
# all tasks. There are at most that many of either.
FREQUENT = 2_000_000
# Entries of a task's counters that are handed on at once.
FLUSH = 400_000
CHUNK = 1 << 20
# Grams whose nodes are weighed at once, or more if as many have the same two last bytes.
AT_ONCE = 100_000

FOLDS, HELD_OUT = 7, 2
RESULT = (
    "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double,"
    " bits_per_byte double"
)
END = b""


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _tokens(text: bytes) -> list[bytes]:
    """Lower-cased words between white space; the end follows as an empty word."""
    return text.lower().split() + [END]


def _grams(text: bytes) -> Iterator[np.ndarray]:
    """Each byte of the lower-cased text and the end (a zero), with the bytes before as its high bytes, the last one highest."""
    whole = b"\0" * DEPTH + text.lower() + b"\0"
    for at in range(0, len(whole) - DEPTH, CHUNK):
        b = np.frombuffer(whole[at : at + CHUNK + DEPTH], np.uint8).astype(np.int64)
        n = len(b) - DEPTH
        gram = b[DEPTH:].copy()
        for back in range(1, DEPTH + 1):
            gram |= b[DEPTH - back : DEPTH - back + n] << 8 * (DEPTH + 1 - back)
        yield gram


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each is there."""
    whole = np.concatenate(parts)
    whole.sort()
    starts = _runs(whole)
    return whole[starts], np.diff(starts, append=len(whole))


def count_corpus(texts: DataFrame, text_col: str, learned: Column | None = None) -> DataFrame:
    """(word, gram, n, m): counts of all tokens (gram null) and of all bytes in context (word null).

    n counts the texts to learn from, m all texts. Words of other texts are left out, their
    grams are there with n = 0.
    """
    schema = pa.schema([("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: tuple[list[np.ndarray], ...] = ([], [])
        size = 0

        def grams() -> Iterator[pa.RecordBatch]:
            for use, parts in enumerate(held):
                if parts:
                    keys, m = _distinct(parts)
                    yield pa.RecordBatch.from_arrays([
                        pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(m * use), pa.array(m),
                    ], schema=schema)
                    parts.clear()

        def counted() -> pa.RecordBatch:
            n = pa.array(list(words.values()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), n, n], schema=schema)

        for batch in batches:
            for text, use in zip(text_bytes(batch, "_text"), batch.column("_use").to_pylist()):
                if use:
                    words.update(_tokens(text))
                for part in _grams(text):
                    held[use].append(part)
                    size += len(part)
                if size > 8 * CHUNK:
                    yield from grams()
                    size = 0
                if len(words) > FLUSH:
                    yield counted()
                    words.clear()
        yield from grams()
        if words:
            yield counted()

    use = F.lit(True) if learned is None else learned
    return (
        texts.select(F.col(text_col).alias("_text"), use.alias("_use"))
        .mapInArrow(run, "word binary, gram bigint, n bigint, m bigint")
        .groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    )


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after moving the argument up by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the KT probability of any sequence of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - 2 * math.lgamma(0.5) - _log_gamma(a + b + 1.0)


def mix(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log probability of nodes, and the weight of their own estimate."""
    weighted = np.logaddexp(own, children) - math.log(2)
    return weighted, np.exp(own - math.log(2) - weighted)


class Level:
    """Nodes of one depth at one of the eight choices, in order of context, then of the bits chosen so far."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, bit: int):
        starts = _runs(keys >> 8 - bit)
        self.bit, self.nodes = bit, keys[starts] >> 8 - bit
        self.a_b = np.add.reduceat(n, starts).astype(np.float64)
        self.b = np.add.reduceat(n * (keys >> 7 - bit & 1), starts).astype(np.float64)
        self.a = self.a_b - self.b
        self.kt = (self.b + 0.5) / (self.a_b + 1)
        self.sizes = np.diff(starts, append=len(keys))

    def shortened(self) -> np.ndarray:
        """The nodes' parents: the context without its oldest byte."""
        return self.nodes >> self.bit + 8 << self.bit | self.nodes & (1 << self.bit) - 1


def _columns(keys: np.ndarray, n: np.ndarray) -> Iterator[tuple[list[Level], list[np.ndarray], list[np.ndarray]]]:
    """For each of the eight choices: levels from DEPTH to 2, places of each level's parents in the next, weights of own estimates.

    The last level has its weighted log probabilities in `weighted`.
    """
    rows = [(keys, n)]
    for _ in range(DEPTH - 2):
        k, of = np.unique(keys >> 16 << 8 | keys & 255, return_inverse=True)
        keys, n = k, np.bincount(of, n).astype(np.int64)
        rows.append((keys, n))
    for bit in range(8):
        levels = [Level(k, c, bit) for k, c in rows]
        above, shares = [], []
        for at, level in enumerate(levels):
            own = log_kt(level.a, level.b)
            if at == 0:
                level.weighted, share = own, np.ones(len(own))
            else:
                before = levels[at - 1]
                to = np.searchsorted(level.nodes, before.shortened())
                level.weighted, share = mix(own, np.bincount(to, before.weighted, len(own)))
                above.append(to)
            shares.append(share)
        yield levels, above, shares


def _top_nodes(level: Level) -> np.ndarray:
    """The last byte and the decision node, 1 to 255, above nodes of contexts of two bytes."""
    key = level.shortened()
    return key >> level.bit << 8 | 1 << level.bit | key & (1 << level.bit) - 1


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of grams, cut only between different two last bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= AT_ONCE:
            rows = pa.Table.from_batches(held)
            last = rows.column("gram").to_numpy() >> 8 * (DEPTH - 1)
            until = int(np.searchsorted(last, last[-1]))
            if until:
                yield rows.slice(0, until)
            held, size = rows.slice(until).to_batches(), size - until
    if size:
        yield pa.Table.from_batches(held)


def _grouped(grams: DataFrame) -> DataFrame:
    last = F.shiftright("gram", 8 * (DEPTH - 1))
    return grams.repartition(last).sortWithinPartitions("gram")


class Tree:
    """The weighted tree: its counts as a table, and for its top what each node gives to the estimate and leaves to its children."""

    def __init__(self, counts: DataFrame, given: np.ndarray, left: np.ndarray):
        self.counts, self.given, self.left = counts, given, left

    def logs(self, grams: DataFrame) -> DataFrame:
        """(gram, m, log): log10 probability of each gram's byte after its context. grams: (gram, n, m) with all counts of the tree."""
        top = grams.sparkSession.sparkContext.broadcast((self.given, self.left))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given0, left0 = top.value
            for rows in _whole_groups(batches):
                keys = rows.column("gram").to_numpy()
                log = np.zeros(len(keys))
                for levels, above, shares in _columns(keys, rows.column("n").to_numpy()):
                    at = _top_nodes(levels[-1])
                    given, left = given0[at], left0[at]
                    for k in range(len(levels) - 1, -1, -1):
                        if k < len(levels) - 1:
                            given, left = given[above[k]], left[above[k]]
                        given, left = given + left * shares[k] * levels[k].kt, left * (1 - shares[k])
                    one = np.repeat(given, levels[0].sizes)
                    log += np.log10(np.where(keys >> 7 - levels[0].bit & 1, one, 1 - one))
                out = pa.table([pa.array(keys), rows.column("m"), pa.array(log)], names=["gram", "m", "log"])
                yield from out.combine_chunks().to_batches(max_chunksize=AT_ONCE)

        return _grouped(grams).mapInArrow(run, "gram bigint, m bigint, log double")

    def _also(self, grams: np.ndarray) -> pa.Table:
        """Logs of distinct grams, in order."""
        spark = self.counts.sparkSession
        more = spark.createDataFrame(pa.table({"gram": grams})).select("gram", F.lit(0).cast("long").alias("n"))
        both = self.counts.select("gram", "n").unionByName(more).groupBy("gram").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("m"))
        return self.logs(both).join(more.select("gram"), "gram").toArrow().sort_by("gram")

    def score(self, text: bytes) -> float:
        """log10 probability of one text, to look at."""
        grams, times = _distinct(list(_grams(text)))
        return float((self._also(grams).column("log").to_numpy() * times).sum())

    @property
    def table(self) -> np.ndarray:
        """log10 probabilities of the 256 bytes after each context that occurs, to look at."""
        contexts = self.counts.select(F.shiftright("gram", 8).alias("c")).distinct().toArrow().column("c").to_numpy()
        grams = (np.sort(contexts)[:, None] << 8 | np.arange(256)).ravel()
        return self._also(grams).column("log").to_numpy().reshape(-1, 256)


def train_tree(counts: DataFrame) -> Tree:
    """Weigh the tree of (gram, n) counts.

    Each task weighs the nodes of its contexts from the deepest level up to two bytes, and
    the driver those of one byte and none, from sums.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            for levels, _, _ in _columns(rows.column("gram").to_numpy(), rows.column("n").to_numpy()):
                level = levels[-1]
                node, of = np.unique(_top_nodes(level), return_inverse=True)
                sums = [np.bincount(of, x, len(node)) for x in (level.a, level.b, level.weighted)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, *sums)], ["node", "a", "b", "w"])

    tops = (
        _grouped(counts.select("gram", "n")).mapInArrow(run, "node bigint, a double, b double, w double")
        .groupBy("node").agg(*(F.sum(c).alias(c) for c in "abw")).toArrow()
    )
    a, b, below = np.zeros((3, 1 << 16))
    for x, c in zip((a, b, below), "abw"):
        x[tops.column("node").to_numpy()] = tops.column(c).to_numpy()
    weighted, own1 = mix(log_kt(a, b), below)
    a0, b0, below0 = (x.reshape(256, 256).sum(0) for x in (a, b, weighted))
    own0 = np.tile(mix(log_kt(a0, b0), below0)[1], 256)
    kt0 = np.tile((b0 + 0.5) / (a0 + b0 + 1), 256)
    given = own0 * kt0 + (1 - own0) * own1 * (b + 0.5) / (a + b + 1)
    return Tree(counts, given, (1 - own0) * (1 - own1))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    Learns from the documents that aren't held out. score is the log10 probability of
    the lower-cased text and its end by the weighted tree, bits_per_byte its code length
    per coded byte. Null and empty texts have one token and one byte, the end. A null id
    isn't held out. Without training rows nothing is known, and every byte has
    probability 1/256. Columns of these names are replaced, others carried.

    Words and grams above a relative frequency are looked up in tasks; the rare ones are shuffled
    to their counts or logs, once for each text, and their sums back by the text's hash.
    A rare gram is rare in the texts to be scored too, so no key has many rows.
    """
    spark = docs.sparkSession
    new = {x.split()[0] for x in RESULT.split(", ")}
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c not in new))
    counts = cut(count_corpus(docs, text_col, ~held_out(id_col)))
    words = counts.where("word IS NOT NULL").select("word", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(1, -(-total // frequent))
    often = {bytes(r["word"]): r["n"] for r in words.where(F.col("n") >= least).collect()}
    known = spark.sparkContext.broadcast({w: math.log10(n + 1) for w, n in often.items()})
    grams = counts.where("gram IS NOT NULL").select("gram", "n", "m")
    logs = cut(train_tree(grams).logs(grams))
    size = logs.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    usual = F.col("m") >= max(1, -(-size // frequent))
    sent = logs.where(usual).select("gram", "log").toArrow().sort_by("gram")
    tree = spark.sparkContext.broadcast((sent.column("gram").to_numpy(), sent.column("log").to_numpy()))

    def looked_up(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct grams of a text, their times, and their places in what was sent, or -1."""
        own, times = _distinct(list(_grams(text)))
        have = tree.value[0]
        if not len(have):
            return own, times, np.full(len(own), -1)
        at = np.minimum(np.searchsorted(have, own), len(have) - 1)
        return own, times, np.where(have[at] == own, at, -1)

    def near(batch: pa.RecordBatch) -> list[pa.Array]:
        get, log = known.value.get, tree.value[1]
        n_tokens, n_known, base, score, size = [], [], [], [], []
        for text in text_bytes(batch, text_col):
            tokens = _tokens(text)
            found = [x for x in map(get, tokens) if x is not None]
            n_tokens.append(len(tokens))
            n_known.append(len(found))
            base.append(math.fsum(found))
            _, times, at = looked_up(text)
            score.append(float((log[at[at >= 0]] * times[at >= 0]).sum()))
            size.append(len(text) + 1)
        return [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(size, pa.int64())]

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = known.value
        for batch in batches:
            of, found, times, rest = [], [], [], []
            for k, text in enumerate(text_bytes(batch, text_col)):
                left = Counter([w for w in _tokens(text) if w not in have])
                of += [k] * len(left)
                found += left.keys()
                times += left.values()
                own, often, place = looked_up(text)
                rest.append((np.full((place < 0).sum(), k), own[place < 0], often[place < 0]))
            at = pa.array(of, pa.int32())
            names = ["_key", "word", "gram", "times"]
            yield pa.RecordBatch.from_arrays([
                batch.column("_key").take(at), pa.array(found, pa.binary()), pa.nulls(len(of), pa.int64()), pa.array(times, pa.int64()),
            ], names)
            k, own, often = map(np.concatenate, zip(*rest)) if rest else np.zeros((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("_key").take(pa.array(k)), pa.nulls(len(k), pa.binary()), pa.array(own), pa.array(often),
            ], names)

    keyed = docs.withColumn("_key", text_key(text_col))
    scored = add_columns(keyed, "n_tokens bigint, _n bigint, _f double, _s double, _size bigint", near, drop=drop)
    spread = keyed.select("_key", text_col).mapInArrow(rare, "_key struct<a: bigint, b: bigint>, word binary, gram bigint, times bigint")
    # By word or gram first: copies of a text are then one row for each.
    once = spread.repartition("word", "gram").groupBy("word", "gram", "_key").agg(F.max("times").alias("times"))
    scarce = words.where(F.col("n") < least).select("word", F.lit(None).cast("long").alias("gram"), F.log10(F.col("n") + 1).alias("_log"))
    scarce = scarce.union(logs.where(~usual).select(F.lit(None).cast("binary"), "gram", "log"))
    scarce = scarce.select(F.col("word").alias("_w"), F.col("gram").alias("_g"), "_log")
    is_word, worth = F.col("word").isNotNull(), F.col("times") * F.col("_log")
    sums = once.join(scarce, F.col("word").eqNullSafe(F.col("_w")) & F.col("gram").eqNullSafe(F.col("_g"))).groupBy("_key").agg(
        F.sum(F.when(is_word, F.col("times"))).alias("_rare_n"), F.sum(F.when(is_word, worth)).alias("_rare_f"),
        F.sum(F.when(~is_word, worth)).alias("_rare_s"),
    )
    joined = scored.join(sums, "_key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = F.col("_s") + zero("_rare_s")
    return joined.select(
        *(c for c in docs.columns if c not in drop), held_out(id_col).alias("held_out"), "n_tokens",
        (F.col("_n") + zero("_rare_n")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("_f") + zero("_rare_f") - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        score.alias("score"), (-score / F.col("_size") * math.log2(10)).alias("bits_per_byte"),
    )
