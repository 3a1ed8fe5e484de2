"""Benchmark decontamination (8): suffix arrays of the documents, searched for benchmark suffixes.

Arrow batches of documents are the shards. Each gets a suffix array over its words; every
suffix of a benchmark item that starts a window is looked up in it by binary search.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relinfer.llm.common import add_columns, byte_words, text_bytes, text_key

WINDOW = 13
# Words of benchmark items that are held at once; more are searched block by block.
BLOCK_WORDS = 200_000

RESULT = (
    "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest bigint, longest_at bigint"
)
HITS = "n_words bigint, _spans array<int>, _items array<string>, _match struct<longest: bigint, back: bigint>"


@dataclass
class Block:
    """Different texts of items as word numbers from 1, each followed by a 0, and their different windows.

    `starts` and `sizes` have a place and the size of each window; `places` all its places, those of window k from
    `ends[k - 1]` to `ends[k]`. `text` has the number of the text at each place, `items` the items of each text.
    """

    ids: dict[bytes, int]
    words: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    places: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    items: list[list[str]]
    window: int

    def all_places(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into windows, place) of every place of each of the windows."""
        first = np.where(windows > 0, self.ends[windows - 1], 0)
        count = self.ends[windows] - first
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.repeat(np.arange(len(windows)), count), self.places[at]


def _block(rows: list, window: int) -> Block:
    ids: dict[bytes, int] = {}
    texts: dict[tuple[int, ...], set] = {}
    for item, words in rows:
        if words:
            own = tuple(ids.setdefault(bytes(w), len(ids) + 1) for w in words)
            texts.setdefault(own, set()).add(item)
    words = np.array([n for own in texts for n in (*own, 0)], np.int32)
    lengths = np.array([len(own) for own in texts], np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    text = np.repeat(np.arange(len(lengths)), lengths + 1)
    starts, sizes, places, counts = [], [], [], []
    for size in np.unique(np.minimum(lengths, window)):
        own = np.flatnonzero(np.minimum(lengths, window) == size)
        number = lengths[own] - size + 1
        at = np.repeat(begin[own] - np.cumsum(number) + number, number) + np.arange(number.sum())
        _, first, which = np.unique(words[at[:, None] + np.arange(size)], axis=0, return_index=True, return_inverse=True)
        which = which.ravel()
        starts.append(at[first])
        sizes.append(np.full(len(first), size, np.int64))
        places.append(at[np.argsort(which, kind="stable")])
        counts.append(np.bincount(which))
    none = [np.empty(0, np.int64)]
    starts, sizes, places, counts = (np.concatenate(x or none) for x in (starts, sizes, places, counts))
    items = [sorted(i for i in found if i is not None) for found in texts.values()]
    return Block(ids, words, starts, sizes, places, np.cumsum(counts).astype(np.int64), text, items, window)


def _items(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words) of each distinct item."""

    def words(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([byte_words(t) for t in text_bytes(batch, "_text")], pa.list_(pa.binary()))]

    rows = bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("_text")).distinct()
    return add_columns(rows, "words array<binary>", words, drop=("_text",))


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of the suffixes of s in order of their first `depth` numbers or more."""
    order = np.argsort(s, kind="stable")
    rank, k = s.astype(np.int64), 1
    while True:
        if k == 1:
            _, rank = np.unique(rank, return_inverse=True)
        if k >= depth or rank.max(initial=0) == len(s) - 1:
            return order
        after = np.full(len(s), -1, np.int64)
        after[: len(s) - k] = rank[k:]
        key = rank * (len(s) + 2) + after + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(len(s), np.int64)
        rank[order] = new
        k *= 2


def _search(s: np.ndarray, order: np.ndarray, tests: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of tests (`size` numbers): the range of `order` whose suffixes begin with it."""
    padded = np.concatenate([s, np.full(size, -1, s.dtype)])
    span = np.arange(size)

    def bound(right: bool) -> np.ndarray:
        lo, hi = np.zeros(len(tests), np.int64), np.full(len(tests), len(order), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            suffix = padded[order[np.minimum(mid, len(order) - 1)][:, None] + span]
            differs = suffix != tests
            first = differs.argmax(1)
            rows = np.arange(len(tests))
            less = np.where(differs.any(1), suffix[rows, first] < tests[rows, first], right)
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    return bound(False), bound(True)


def find_windows(flat: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, window size, window number) of each occurrence of a benchmark window in flat.

    flat holds word numbers, 0 for words that no item has and between documents. Only
    stretches of item words as long as the shortest window can match: the suffix array
    is built over these alone.
    """
    none = np.empty(0, np.int64)
    if not len(block.starts) or not len(flat):
        return none, none, none
    known = np.concatenate([[0], (flat > 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(known))
    begin, end = edges[::2], edges[1::2]
    long_ = end - begin >= block.sizes.min()
    begin, end = begin[long_], end[long_]
    if not len(begin):
        return none, none, none
    # The stretches one after the other, each followed by a 0 (place -1).
    place = np.concatenate([np.append(np.arange(b, e), -1) for b, e in zip(begin, end)])
    s = np.where(place >= 0, flat[place], 0)
    order = suffix_array(s, int(block.sizes.max()))
    at, size, window = [], [], []
    for n in np.unique(block.sizes):
        which = np.flatnonzero(block.sizes == n)
        tests = block.words[block.starts[which][:, None] + np.arange(n)]
        lo, hi = _search(s, order, tests, int(n))
        count = hi - lo
        found = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at.append(place[order[found]])
        size.append(np.full(len(found), n))
        window.append(np.repeat(which, count))
    return np.concatenate(at), np.concatenate(size), np.concatenate(window)


class Found:
    """What the windows found in documents tell of them; equal findings are worked out once."""

    def __init__(self, block: Block):
        self.block = block
        self._items: dict[bytes, list[str]] = {}
        self._runs: dict[bytes, tuple[int, int]] = {}

    def items(self, windows: np.ndarray) -> list[str]:
        """The items that have any of the windows, as sorted strings."""
        windows = np.unique(windows)
        key = windows.tobytes()
        if key not in self._items:
            texts = np.unique(self.block.text[self.block.all_places(windows)[1]])
            self._items[key] = sorted({i for t in texts for i in self.block.items[t]})
        return self._items[key]

    def longest(self, at: np.ndarray, size: np.ndarray, windows: np.ndarray) -> tuple[int, int]:
        """(words, place of the first word) of the longest stretch that stands verbatim in one item."""
        best = (0, 0)
        short = size < self.block.window
        if short.any():
            n = int(size[short].max())
            best = n, int(at[size == n].min())
        at, windows = at[~short], windows[~short]
        # Windows at consecutive places.
        cuts = np.flatnonzero(np.diff(at) != 1) + 1
        for places, run in zip(np.split(at, cuts), np.split(windows, cuts)):
            if len(run):
                n, start = self._run(run)
                best = max(best, (n + self.block.window - 1, int(places[start])), key=lambda x: (x[0], -x[1]))
        return best

    def _run(self, run: np.ndarray) -> tuple[int, int]:
        """(windows, first one) of the longest part of a run of windows that an item has in a row."""
        key = run.tobytes()
        if key not in self._runs:
            index, place = self.block.all_places(run)
            order = np.lexsort((index, place - index))
            index, place = index[order], place[order]
            new = np.concatenate([[True], (np.diff(index) != 1) | (np.diff(place) != 1)])
            first = np.flatnonzero(new)
            length = np.diff(np.append(first, len(index)))
            top = np.flatnonzero(length == length.max())
            self._runs[key] = int(length.max()), int(index[first[top]].min())
        return self._runs[key]


def _scan(texts: list[bytes], block: Block) -> list[tuple[int, list[int], list[str], tuple[int, int]]]:
    """Per text: words, hit spans (start, end, start, ...), item ids, longest match."""
    get = block.ids.get
    flat: list[int] = []
    bounds = [0]
    counts = []
    for text in texts:
        words = byte_words(text)
        counts.append(len(words))
        flat += [get(w, 0) for w in words]
        flat.append(0)
        bounds.append(len(flat))
    at, size, window = find_windows(np.array(flat, np.int32), block)
    by_place = np.argsort(at, kind="stable")
    at, size, window = at[by_place], size[by_place], window[by_place]
    cuts = np.searchsorted(at, bounds)
    found = Found(block)
    out = []
    for k, n in enumerate(counts):
        i, j = cuts[k], cuts[k + 1]
        if i == j:
            out.append((n, [], [], (0, 0)))
            continue
        spans: list[int] = []
        for b, w in zip((at[i:j] - bounds[k]).tolist(), size[i:j].tolist()):
            if spans and b <= spans[-1]:
                spans[-1] = max(spans[-1], b + w)
            else:
                spans += [b, b + w]
        out.append((n, spans, found.items(window[i:j]), found.longest(at[i:j] - bounds[k], size[i:j], window[i:j])))
    return out


def _verdict(rows: list[tuple[int, list[int], list[str], tuple[int, int]]]) -> list[pa.Array]:
    hit = [sum(s[1::2]) - sum(s[::2]) for _, s, _, _ in rows]
    # Texts with equal findings share a list.
    digests = {id(i): hashlib.sha256(",".join(i).encode()).hexdigest() for i in {id(r[2]): r[2] for r in rows}.values()}
    return [
        pa.array([n for n, _, _, _ in rows], pa.int64()), pa.array(hit, pa.int64()),
        pa.array([len(i) for _, _, i, _ in rows], pa.int64()),
        pa.array([digests[id(i)] for _, _, i, _ in rows], pa.string()),
        pa.array([h > 0 and 20 * h >= n for h, (n, _, _, _) in zip(hit, rows)], pa.bool_()),
        pa.array([m[0] for _, _, _, m in rows], pa.int64()),
        pa.array([m[1] if m[0] else -1 for _, _, _, m in rows], pa.int64()),
    ]


def contamination(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated, longest and longest_at.

    A document word is hit if it lies in an occurrence of a window, `window` consecutive
    words of an item or all words of a shorter one. `longest` is the length in words of
    the longest verbatim match with an item (0 without a hit), and `longest_at` the number of its first word, from 0
    (the first of equals; -1 without a hit). Null and empty texts have no words and
    are never contaminated; an empty benchmark hits nothing; repeated items count once;
    an item with a null id hits, but isn't counted in n_items. Columns of these names are
    replaced, others carried.

    The benchmark is held in blocks of about `block_words` words, of whole items. One block is a narrow
    pass. With more, each block is searched in a pass of its own, and the spans, keyed by
    the text's hash, are merged by a shuffle.
    """
    spark = docs.sparkSession
    items = _items(bench, item_col, item_text)
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_words))

    def block(k: int):
        rows = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == k)
        return spark.sparkContext.broadcast(_block(rows.collect(), window))

    if n_blocks == 1:
        one = block(0)
        return add_columns(
            docs, RESULT, lambda b: _verdict(_scan(text_bytes(b, text_col), one.value)), drop=drop
        )

    keyed = docs.withColumn("_key", text_key(text_col))

    def spans_of(k: int) -> DataFrame:
        part = block(k)

        def fn(batch: pa.RecordBatch) -> list[pa.Array]:
            n, spans, found, matches = zip(*_scan(text_bytes(batch, text_col), part.value))
            match = pa.StructArray.from_arrays(
                [pa.array([m[0] for m in matches], pa.int64()), pa.array([-m[1] for m in matches], pa.int64())], ["longest", "back"]
            )
            return [
                pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string())), match,
            ]

        return add_columns(keyed.select("_key", text_col), HITS, fn, drop=(text_col,)).where("size(_spans) > 0")

    found = spans_of(0)
    for k in range(1, n_blocks):
        found = found.unionByName(spans_of(k))
    merged = found.groupBy("_key").agg(
        F.collect_set("_spans").alias("_spans"), F.collect_set("_items").alias("_items"),
        F.max("_match").alias("_match"),
    )

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for n, spans, found, match in zip(
            [len(byte_words(t)) for t in text_bytes(batch, text_col)],
            *(batch.column(c).to_pylist() for c in ("_spans", "_items", "_match")),
        ):
            flat: list[int] = []
            for b, e in sorted(p for s in spans or [] for p in zip(s[::2], s[1::2])):
                if flat and b <= flat[-1]:
                    flat[-1] = max(flat[-1], e)
                else:
                    flat += [b, e]
            longest = (match["longest"], -match["back"]) if match else (0, 0)
            rows.append((n, flat, sorted({i for x in found or [] for i in x}), longest))
        return _verdict(rows)

    joined = keyed.join(merged, "_key", "left")
    return add_columns(joined, RESULT, fn, drop=("_key", "_spans", "_items", "_match", *drop))


CONTAMINATION_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), items AS (
  SELECT item_id, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i, w FROM bw WHERE len(w) > 0
), wins AS (SELECT DISTINCT item_id, n, w[i : i + n - 1] AS g FROM items),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n
), hits AS (
  SELECT doc_id, p, n, item_id FROM (SELECT doc_id, n, p, w[p : p + n - 1] AS g FROM places) JOIN wins USING (n, g)
), pairs AS (
  SELECT DISTINCT h.doc_id, h.p, h.n, i.item_id, i.w AS text, i.i - h.p AS diagonal
  FROM hits h JOIN dw ON dw.doc_id = h.doc_id JOIN items i ON i.item_id = h.item_id AND i.n = h.n
  WHERE i.w[i.i : i.i + i.n - 1] = dw.w[h.p : h.p + h.n - 1]
), matches AS (
  SELECT doc_id, min(p) - 1 AS start, count(*) + any_value(n) - 1 AS longest FROM (
    SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, text, n, diagonal ORDER BY p) AS island FROM pairs)
  GROUP BY doc_id, item_id, text, n, diagonal, island
), best AS (
  SELECT doc_id, max(longest) AS longest, arg_min(start, (-longest, start)) AS longest_at FROM matches GROUP BY doc_id
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(longest, 0)::BIGINT AS longest, coalesce(longest_at, -1)::BIGINT AS longest_at
FROM dw LEFT JOIN words ON dw.doc_id = words.doc_id LEFT JOIN found ON dw.doc_id = found.doc_id
LEFT JOIN best ON dw.doc_id = best.doc_id
"""
