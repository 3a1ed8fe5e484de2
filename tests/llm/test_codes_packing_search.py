"""Vector codes, packing and lexical search against brute force, and their odd rows."""

import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from relinfer.llm import lexical_search as ls
from relinfer.llm import packing as pk
from relinfer.llm import vector_codes as vc
from relinfer.llm.common import byte_words
from tests.conftest import FOLDER, plan

# ------------------------------------------------------------------ vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id, code, error, label error) of (id, vector, label) rows, in whole numbers."""
    kept = [
        (i, [math.floor(Fraction(x) * scale) for x in v], label) for i, v, label in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    split = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[s[p] for s in split[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for s in split:
                groups[nearest(s[p], books[p])[1]].append(s[p])
            books[p] = [
                tuple(sum(c) // len(c) for c in zip(*groups[k])) if k in groups else e for k, e in enumerate(books[p])
            ]
    found = [[nearest(s[p], books[p]) for p in range(parts)] for s in split]
    by_label = Counter()
    for f, (_, _, label) in zip(found, kept):
        by_label[label] += sum(d for d, _ in f)
    return sorted(
        ((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[label]) for f, (i, _, label) in zip(found, kept)),
        key=str,
    )


def coded(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, error int, part int, _row int")
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in vc.compress(df)[0].collect()), key=str)


def clashing(rows):
    return [(*r, "own", 1, 2, 3) for r in rows]


@pytest.mark.parametrize("values", [16, 2048])
def test_codes_equal_brute_force(spark, monkeypatch, values):
    monkeypatch.setattr(vc, "BLOCK_VALUES", values)
    monkeypatch.setattr(vc, "MIN_ROWS", 4)
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(0, 0.2, (300, 16)).astype(np.float32)
    vectors[100:200] = vectors[7]  # a third of all rows are equal
    vectors[50, :2] = 3.0  # far from all others
    rows = [(k // 2 if k > 280 else k, v.tolist(), int(rnd.integers(4))) for k, v in enumerate(vectors)]
    rows += [(500, None, 1), (501, [None, *vectors[0, 1:].tolist()], 1), (502, [math.nan] * 16, 1), (503, [-math.inf] * 16, 2), (504, [], 1)]
    rows += [(None, vectors[3].tolist(), None), (505, vectors[4].tolist(), None)]
    assert coded(spark, clashing(rows)) == brute_codes(rows)


def test_codes_of_few_and_of_large_vectors(spark):
    few = [(9, [0.1] * 8, 0), (3, [0.3] * 8, 0), (3, [0.2] * 8, None)]
    assert coded(spark, clashing(few)) == brute_codes(few)
    rnd = np.random.default_rng(5)
    # Two of the first entries are far away, so that distances to them need more than 64 bits.
    large = [(k, (v * 2.0 ** (33 if k in (3, 9) else k % 5)).tolist(), k % 3) for k, v in enumerate(rnd.normal(0, 1, (40, 8)).astype(np.float32))]
    assert vc._extent(vc._integers(spark.createDataFrame(large, "i long, v array<float>, l int"), "v", vc.SCALE), 8).exact_type() == object
    assert coded(spark, clashing(large)) == brute_codes(large)


def test_no_vectors(spark):
    assert coded(spark, []) == []
    assert coded(spark, clashing([(1, None, 1), (2, [math.inf] * 8, None)])) == []


def test_vectors_of_other_lengths_are_errors(spark):
    with pytest.raises(Exception, match="one length"):
        coded(spark, clashing([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)]))
    with pytest.raises(Exception, match="not below"):
        coded(spark, clashing([(1, [1e30] * 8, 1)]))


def test_shortlists_keep_every_nearest_entry():
    rnd = np.random.default_rng(1)
    entries = rnd.integers(-20, 20, (16, 3))
    entries[5] = entries[2]
    for _ in range(50):
        points = rnd.integers(-20, 20, 3) + rnd.integers(0, 9, (40, 3))
        left = vc.shortlists(points.min(0)[None], points.max(0)[None], entries)[0]
        at, distance = vc.nearest(points, entries)
        assert left[at].all()
        assert (distance == ((points - entries[at]) ** 2).sum(1)).all()


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (5, 2)])
def test_hilbert_neighbours_touch(dims, bits):
    """The curve visits every cell, and moves by one step each time."""
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    order = sorted(zip(vc.hilbert_keys(cells, bits), cells.tolist()))
    assert len({k for k, _ in order}) == len(cells)
    steps = np.abs(np.diff([c for _, c in order], axis=0)).sum(1)
    assert (steps == 1).all()


# ------------------------------------------------------------------ packing


def check_packed(rows, examples, limits, loss=None):
    """Pieces cover every token once; sequences are gapless, within the limits and never padded."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.ids))
        sequences[r.sequence_id].append((r.offset, r.length, r.doc_id, r.start))
        assert (r.length, r.doc_tokens) == (len(r.ids), len(examples[r.doc_id]))
    assert {k: [i for _, ids in sorted(p) for i in ids] for k, p in pieces.items()} == {k: e for k, e in examples.items() if e}
    for found in sequences.values():
        end = borne = 0
        for offset, length, doc, start in sorted(found):
            assert offset == end
            end += length
            borne += sum(loss[doc][start : start + length]) if loss else length
        assert end == limits.tokens or end & (end - 1) == 0
        assert end <= limits.tokens and len(found) <= limits.segments and borne <= limits.loss
    return sequences


@pytest.mark.parametrize("limits", [pk.Limits(64, 4, 64), pk.Limits(50, 64, 20), pk.Limits(100, 3, 10), pk.Limits(1, 1, 1)])
@pytest.mark.parametrize("masked", [False, True])
def test_packing_keeps_all_tokens_and_limits(spark, limits, masked):
    rnd = random.Random(4)
    examples = {k: [rnd.randrange(1000) for _ in range(rnd.choice((0, 1, 3, 20, 60, 300)))] for k in range(400)}
    loss = {k: [rnd.random() < 0.3 or k % 5 == 0 for _ in e] for k, e in examples.items()}
    df = spark.createDataFrame([(k, e, loss[k]) for k, e in examples.items()], "doc_id long, ids array<int>, loss array<boolean>").repartition(3)
    rows = pk.pack(df, loss_col="loss" if masked else None, limits=limits, window=16).collect()
    check_packed(rows, examples, limits, loss if masked else None)


def test_heuristic_mixes_heavy_and_light_examples(spark):
    """Where half of all tokens bear loss, limits at that mix leave no room unused but at the end."""
    examples = {k: [k] * 16 for k in range(400)}
    loss = {k: [k < 200] * 16 for k in examples}
    df = spark.createDataFrame([(k, e, loss[k]) for k, e in examples.items()], "doc_id long, ids array<int>, loss array<boolean>").coalesce(1)
    limits = pk.Limits(64, 8, 32)
    sequences = check_packed(pk.pack(df, loss_col="loss", limits=limits).collect(), examples, limits, loss)
    assert len(sequences) == 100


def test_packing_of_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, None, 7), (1, [], 7), (None, [5, 6], 7), (2, [1], 7), (2, [1], 7), (3, list(range(10_000)), 7)],
        "doc_id long, ids array<int>, start int",
    )
    rows = pk.pack(df).collect()
    assert Counter(r.doc_id for r in rows if r.doc_id != 3) == {None: 1, 2: 2}
    assert sum(r.length for r in rows) == 10_004
    assert pk.pack(df.where("false")).count() == 0
    assert "Exchange" not in plan(pk.pack(df))
    with pytest.raises(ValueError):
        pk.Limits(0)


ODD_TEXTS = [
    None, "", "  \n ", "áb ́c", "<|endoftext|> x<|endoftext|>y <|ENDOFTEXT|>", "It's 's DON'T 'tis", "\x1c a\x1cb c d\r\n e\t\tf",
    "ΑΣ Σ ΟΔΟΣ", "é É,", "İstanbul İ ı", "中文字 \U0001f600‍", "x" * 5000 + "!!!", "\x85a  b", "a ̸ = ̸ ≠", "Àé÷×ß, ſ' ŉ's",
    "ñandú... don't,it's (a) [b]$$$ c's's", "12 3rd a1 1a", "K Å ẞ", "ﬁ Ǆ ǅ",
]


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(pk.tokenizer_path())
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in pk.tokenize(df).collect()}
    assert got == {k: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}


@pytest.mark.parametrize("size", [1, 40])
def test_groups_of_texts_change_nothing(spark, monkeypatch, size):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD_TEXTS)], "doc_id long, text string")
    want = sorted(map(tuple, pk.tokenize(df).select("doc_id", "ids").collect()))
    monkeypatch.setattr(pk, "GROUP_BYTES", size)
    assert want == sorted(map(tuple, pk.tokenize(df).select("doc_id", "ids").collect()))


def test_packing_query(spark):
    import __spark_entry__ as spark_entry

    rows = spark_entry.queries()["op12_packing"](spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r.doc_id: r.ids for r in pk.tokenize(docs).collect()}
    lengths, seen = Counter(), Counter()
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(piece.tobytes()), len(ids[r.doc_id]))
        seen.update({(r.doc_id, p): 1 for p in range(r.start, r.start + r.length)})
        lengths[r.sequence_id] += r.length
    assert len(seen) == sum(map(len, ids.values())) == sum(lengths.values()) and set(seen.values()) == {1}
    assert all(n <= 2048 and n & (n - 1) == 0 for n in lengths.values())


# ------------------------------------------------------------------ lexical search


def brute_search(docs, items, k=20):
    counts = [(i, Counter(byte_words((t or "").encode()))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, terms = len(counts), sum(c.total() for _, c in counts)
    holding = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        asked = Counter(byte_words((text or "").encode()))
        found = []
        for i, c in counts:
            m = 100 - 25 + 25 * c.total() * n // terms
            score = sum(
                q * math.floor(1000 * math.log((2 * n + 2) / (2 * holding[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m))
                for w, q in asked.items() if c[w]
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, words string").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ls.search(d, b).collect()), key=str)


@pytest.mark.parametrize("tiles", [(256, 1024, 1024, 2**53, 2**20), (3, 5, 4, 2**33, 60)])
def test_search_equals_brute_force(spark, monkeypatch, tiles):
    for name, value in zip(("ITEMS", "TERMS", "DOCS", "EXACT", "BLOCK_BYTES"), tiles):
        monkeypatch.setattr(ls, name, value)
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(60)] + ["É", "é", "中"]
    docs = [(k, " ".join(rnd.choices(words, k=rnd.randint(1, 40)))) for k in range(120)]
    docs += [(200 + k, "W1 w2, w3") for k in range(60)]  # more equal scores than places
    docs += [(3, "w1"), (3, "w1"), (None, "w2 w3"), (None, None), (400, ""), (401, " ,;"), (402, "w5 " * 3000)]
    items = [(k, " ".join(rnd.choices(words, k=rnd.randint(1, 12)))) for k in range(10)]
    items += [(20, "w1 w2 w3"), (20, "w1 w2 w3"), (21, None), (22, ""), (None, "w5 W5 w6"), (23, "unknown"), (24, "w7 " * 900)]
    assert searched(spark, docs, items) == brute_search(docs, items)


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == searched(spark, [(1, "a")], []) == searched(spark, [(1, None)], [(1, "a")]) == []


def test_tiles_stay_exact(monkeypatch):
    monkeypatch.setattr(ls, "EXACT", 2**33)
    block = ls.read_block([(1, "a " * 5000 + "b c"), (2, "b b"), (3, None)])
    weights = np.array([9, 20_000, 4000])
    total = np.zeros((3, len(block.ids)), np.int64)
    for tile in ls.item_tiles(block, weights):
        for start, size, row, item, value in tile.terms:
            dense = np.zeros((size, tile.items), np.int64)
            dense[row, item] = value
            assert dense.sum(0).max() * ls.IMPACT < ls.EXACT
            for word, r in enumerate(tile.place):
                if start <= r < start + size:
                    total[word] += dense[r - start]
    assert total.tolist() == [[45_000, 0, 0], [20_000, 40_000, 0], [4000, 0, 0]]
