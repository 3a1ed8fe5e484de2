"""Ranked lexical search (13): exact integer scores by dense blocked float64 matrix products.

A document's impact of a term is an integer below 10^6, an item's weight of it too is one. An item tile
has a compact vocabulary of its own, cut into term tiles so that no sum of products within one reaches 2^53:
there, BLAS in float64 is exact in any order. Products of term tiles are added as 64-bit integers. Each
tile of documents then leaves what can still be among an item's best, equal scores included.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relinfer.llm.common import byte_words, text_bytes
from relinfer.operators.skew import running_sum
from relinfer.session import cut, drop_table, new_table_path

TOP = 20
# Bytes of item texts that are searched in one pass over the documents.
BLOCK_BYTES = 1 << 20
# Sides of the tiles.
ITEMS, TERMS, DOCS = 256, 1024, 1024
# Greatest impact of a term in a document, and what sums of products have to stay below.
IMPACT = 10**6
EXACT = 2**53
# Lists of best documents of an item that are merged first.
SALTS = 64


@dataclass
class Block:
    """Items searched together: their ids, words numbered, and (item, word, times) of each pair."""

    ids: list
    words: dict[bytes, int]
    item: np.ndarray
    word: np.ndarray
    times: np.ndarray


@dataclass
class Corpus:
    """Documents with terms, all their terms, and for each word of a block the documents that hold it."""

    documents: int
    terms: int
    holding: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * n + 1))) for n in self.holding.tolist()], np.int64)

    def norms(self, n: list[int]) -> np.ndarray:
        """m of documents of n terms."""
        return np.array([75 + 25 * x * self.documents // self.terms for x in n], np.int64)


@dataclass
class ItemTile:
    """Items from `first` on; `place` has the row of each word in their vocabulary, -1 for others.

    A term tile is (first row, rows, (row, item, weight) of what isn't 0).
    """

    first: int
    items: int
    place: np.ndarray
    terms: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]


def read_block(rows: list[tuple]) -> Block:
    """A block of (id, text) rows; null texts have no words."""
    words: dict[bytes, int] = {}
    pairs = []
    for k, (_, text) in enumerate(rows):
        for word, n in Counter(byte_words((text or "").encode())).items():
            pairs.append((k, words.setdefault(word, len(words)), n))
    item, word, times = np.array(pairs, np.int64).reshape(-1, 3).T
    return Block([i for i, _ in rows], words, item, word, times)


def item_tiles(block: Block, weights: np.ndarray) -> Iterator[ItemTile]:
    """Tiles of the block's items whose partial sums stay exact.

    A weight that alone would break the bound is spread over several rows of its word's own.
    """
    weight = weights[block.word] * block.times
    most = (EXACT - 1) // IMPACT
    for first in range(0, len(block.ids), ITEMS):
        own = (block.item >= first) & (block.item < first + ITEMS) & (weight > 0)
        n = min(ITEMS, len(block.ids) - first)
        item, word, left = block.item[own] - first, block.word[own], weight[own].copy()
        layers = []
        while len(left):
            layers.append((item, word, np.minimum(left, most)))
            more = left > most
            item, word, left = item[more], word[more], left[more] - most
        tiles = []
        for item, word, value in layers:
            place = np.full(len(weights), -1, np.int64)
            vocabulary = np.unique(word)
            place[vocabulary] = np.arange(len(vocabulary))
            order = np.argsort(place[word], kind="stable")
            row, item, value = place[word][order], item[order], value[order]
            starts = np.searchsorted(row, np.arange(len(vocabulary) + 1))
            terms, begin, total = [], 0, np.zeros(n, np.int64)
            for r in range(len(vocabulary)):
                a, b = starts[r], starts[r + 1]
                added = total[item[a:b]] + value[a:b]
                if r - begin == TERMS or added.max() > most:
                    terms.append((begin, r - begin, starts[begin], a))
                    begin, total = r, np.zeros(n, np.int64)
                    added = value[a:b]
                total[item[a:b]] = added
            terms.append((begin, len(vocabulary) - begin, starts[begin], len(row)))
            tiles.append(ItemTile(first, n, place, [(s, size, row[a:b] - s, item[a:b], value[a:b]) for s, size, a, b in terms]))
        yield from tiles


class Best:
    """The best documents of each item so far: highest scores, then smallest ids, null ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.floor = np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Scores (document, item) of items from `first` on; equals of the last one may still win by id."""
        doc, item = np.nonzero(scores >= self.floor[first : first + scores.shape[1]])
        if not len(doc):
            return
        new = item + first, scores[doc, item], ids[doc], null[doc]
        item, score, doc_id, is_null = (np.concatenate(x) for x in zip(self.rows, new))
        order = np.lexsort((doc_id, is_null, -score, item))
        item, score = item[order], score[order]
        starts = np.searchsorted(item, np.arange(len(self.floor) + 1))
        kept = np.arange(len(item)) - starts[item] < self.k
        self.rows = [item[kept], score[kept], doc_id[order][kept], is_null[order][kept]]
        full = np.flatnonzero(np.diff(starts) >= self.k)
        self.floor[full] = score[starts[full] + self.k - 1]


def tile_scores(tile: ItemTile, doc: np.ndarray, word: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
    """Scores (document, item) of a tile of documents, given as (document, word, impact)."""
    row = tile.place[word]
    found = row >= 0
    doc, row, impact = doc[found], row[found], impact[found].astype(float)
    order = np.argsort(row, kind="stable")
    doc, row, impact = doc[order], row[order], impact[order]
    scores = np.zeros((docs, tile.items), np.int64)
    for start, size, at, item, value in tile.terms:
        a, b = np.searchsorted(row, (start, start + size))
        if a == b:
            continue
        impacts, weights = np.zeros((docs, size)), np.zeros((size, tile.items))
        impacts[doc[a:b], row[a:b] - start] = impact[a:b]
        weights[at, item] = value
        scores += (impacts @ weights).astype(np.int64)
    return scores


def _term_counts(docs: DataFrame, id_col: str, text_col: str, words) -> DataFrame:
    """(doc_id, n, words[], times[]) of documents with a term; of their terms, those of the block are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = words.value.get
        for batch in batches:
            keep, n, sizes, found, times = [], [], [], [], []
            for k, text in enumerate(text_bytes(batch, text_col)):
                if terms := byte_words(text):
                    numbers = np.fromiter(map(number, terms, repeat(-1)), np.int32, len(terms))
                    unique, counts = np.unique(numbers[numbers >= 0], return_counts=True)
                    keep.append(k)
                    n.append(len(terms))
                    sizes.append(len(unique))
                    found.append(unique)
                    times.append(counts)
            if keep:
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(t))) for x, t in ((found, np.int32), (times, np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(keep)), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "words", "times"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("words", T.ArrayType(T.IntegerType())),
        T.StructField("times", T.ArrayType(T.LongType())),
    ])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _corpus(counts: DataFrame, words: int) -> Corpus:
    """Counts over all documents; the driver gets one number for each word of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        holding = np.zeros(words, np.int64)
        for batch in batches:
            documents += batch.num_rows
            terms += sum(batch.column("n").to_pylist())
            holding += np.bincount(batch.column("words").flatten().to_numpy(zero_copy_only=False), minlength=words)
        there = np.flatnonzero(holding)
        keys, values = [-2, -1, *there.tolist()], [documents, terms, *holding[there].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.int64())], ["key", "value"])

    total = dict(
        counts.select("n", "words").mapInArrow(run, "key bigint, value bigint").groupBy("key").agg(F.sum("value")).collect()
    )
    return Corpus(total.get(-2, 0), total.get(-1, 0), np.array([total.get(k, 0) for k in range(words)], np.int64))


def _best(counts: DataFrame, shared, item_type: pa.DataType, k: int, schema: T.StructType) -> DataFrame:
    """The best documents of each partition for each item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, corpus, tiles = shared.value
        best = Best(len(ids), k)
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS):
                part = batch.slice(start, DOCS)
                sizes = part.column("words").value_lengths().to_numpy()
                doc = np.repeat(np.arange(part.num_rows), sizes)
                word, times = (part.column(c).flatten().to_numpy() for c in ("words", "times"))
                m = corpus.norms(part.column("n").to_pylist())
                impact = (10**9 * times) // (1000 * times + 12 * m[doc])
                null = np.asarray(part.column("doc_id").is_null())
                keys = part.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy()
                scores: dict[int, np.ndarray] = {}
                for tile in tiles:
                    found = tile_scores(tile, doc, word, impact, part.num_rows)
                    scores[tile.first] = scores[tile.first] + found if tile.first in scores else found
                for first, found in scores.items():
                    best.add(first, found, keys, null)
        item, score, doc_id, null = best.rows
        if len(item):
            yield pa.RecordBatch.from_arrays([
                pa.array(item), pa.array([ids[i] for i in item], item_type), pa.array(doc_id, mask=null), pa.array(score),
                pa.array(np.full(len(item), TaskContext.get().partitionId() % SALTS, np.int32)),
            ], schema.names)

    return counts.mapInArrow(run, schema)


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", k: int = TOP,
) -> DataFrame:
    """The k documents (item id, rank, doc id, score) of highest score above 0 for each item.

    Terms are the lower-cased words of common.byte_words. Null and empty texts have none: such documents don't count, such
    items find nothing. Equal scores go by ascending document id, null ids last. Rows equal in id, or in all, are
    documents and items of their own. Document ids are integers. Empty tables give an empty result.

    Items are searched in blocks of BLOCK_BYTES of text (an item is never cut), each in one pass over the documents; a
    block's words and weights are all that is broadcast, and the term counts of the pass are a table in
    the shared folder. Each partition leaves k documents an item, which meet in two steps.
    """
    spark = docs.sparkSession
    numbered = items.select(F.col(item_id_col).alias("_item"), F.col(item_text_col).alias("_text"), F.lit(0).alias("_all")).where("_text IS NOT NULL")
    sized = numbered.withColumn("_bytes", F.octet_length("_text").cast("bigint"))
    placed = running_sum(sized, "_all", [(F.col("_item"), False)], "_bytes", "_end").withColumn(
        "_block", F.floor((F.col("_end") - F.col("_bytes")) / BLOCK_BYTES)
    )
    blocks = cut(placed.select("_block", "_item", "_text"))
    kind, doc_kind = items.schema[item_id_col].dataType, docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("_row", T.LongType()), T.StructField("_item", kind), T.StructField("_doc", T.LongType()),
        T.StructField("score", T.LongType()), T.StructField("_salt", T.IntegerType()),
    ])
    order = [F.desc("score"), F.asc_nulls_last("_doc")]
    results = []
    for (number,) in blocks.select("_block").distinct().orderBy("_block").collect():
        found = blocks.where(F.col("_block") == number).select("_item", "_text").toArrow()
        block = read_block(list(zip(found.column("_item").to_pylist(), found.column("_text").to_pylist())))
        words = spark.sparkContext.broadcast(block.words)
        path = new_table_path(spark, "terms")
        _term_counts(docs, id_col, text_col, words).write.parquet(path)
        words.destroy()
        counts = spark.read.parquet(path)
        corpus = _corpus(counts, len(block.words))
        shared = spark.sparkContext.broadcast((block.ids, corpus, list(item_tiles(block, corpus.weights()))))
        best = _best(counts, shared, found.schema.field("_item").type, k, schema)
        for keys in (["_row", "_salt"], ["_row"]):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        results.append(cut(best.select(
            F.col("_item").alias(item_id_col), "rank", F.col("_doc").cast(doc_kind).alias(id_col), "score"
        )))
        shared.destroy()
        drop_table(spark, path)
    if not results:
        none = T.StructType([T.StructField(item_id_col, kind), T.StructField("rank", T.IntegerType()), T.StructField(id_col, doc_kind), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], none)
    return reduce(DataFrame.unionByName, results)


LEXICAL_SEARCH_SQL = r"""
WITH words AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents
), asked AS (
  SELECT item_id, w, count(*) AS times FROM (
    SELECT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
    FROM benchmark) GROUP BY item_id, w
), sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
tf AS (SELECT doc_id, w, count(*) AS tf FROM words WHERE w IN (SELECT w FROM asked) GROUP BY doc_id, w),
df AS (SELECT w, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, total GROUP BY w, docs),
impact AS (
  SELECT doc_id, w, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)) AS impact
  FROM tf JOIN sizes USING (doc_id), total
), scores AS (
  SELECT item_id, doc_id, sum(times * weight * impact)::BIGINT AS score
  FROM asked JOIN df USING (w) JOIN impact USING (w) GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM scores WHERE score > 0
) WHERE rank <= 20
"""
