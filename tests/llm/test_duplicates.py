"""Similarity join, components, decontamination, line dedup and the pipeline against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from relinfer.llm import chosen_path as cp
from relinfer.llm import contamination as ct
from relinfer.llm.common import byte_words
from relinfer.llm.components import components
from relinfer.llm.line_dedup import dedup_lines
from tests.conftest import FOLDER


def brute_classes(rows, similarity=0.8):
    sets = {i: set(cp.shingles((t or "").encode()).tolist()) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}
    links = dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (find(i), links[i]) for i in ids}


def near_copies(seed=1):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    rows, shared = [], [rnd.choice(words) for _ in range(60)]
    for g in range(40):
        text = [rnd.choice(words) for _ in range(rnd.randint(3, 150))]
        for _ in range(rnd.choice((1, 1, 2, 5))):
            copy = list(text)
            for _ in range(rnd.choice((0, 1, 2))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append(" ".join(copy if g % 3 else shared + copy))
    # One large group of different near copies.
    text = [rnd.choice(words) for _ in range(200)]
    for _ in range(150):
        copy = list(text)
        copy[rnd.randrange(len(copy))] = rnd.choice(words)
        rows.append(" ".join(copy))
    return list(enumerate([*rows, "", None, "one", "one", "ONE!"]))


@pytest.mark.parametrize("block", [256, 32])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cp, "BLOCK", block)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in cp.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)
    kept = {r.doc_id for r in cp.drop_near_duplicates(docs).collect()}
    assert kept == {c for c, _ in got.values()}


def test_classes_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: (r.class_id, r.n_links) for r in cp.near_duplicates(docs).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_buckets_are_split_where_they_lie(spark, monkeypatch):
    """A bucket that fits a task is split there to the end; its children are those of splitting by shuffles."""
    near, unlike = np.random.default_rng(3).integers(0, 2**32, (2, 400, cp.COORDINATES), dtype=np.uint32)
    near[:, np.random.default_rng(4).random(cp.COORDINATES) < 0.9] = near[0, 0]
    near[:, :40] = np.arange(400, dtype=np.uint32)[:, None] % 3
    unlike[:, ::4] = 7
    rows = [(k, x.tobytes()) for k, x in enumerate(np.concatenate([near, unlike]))]
    sets = spark.createDataFrame(rows, "rid long, sketch binary").cache()
    split, calls = cp._split, []
    monkeypatch.setattr(cp, "_split", lambda rows, roots: calls.append(roots) or split(rows, roots))

    def found():
        return sorted(tuple(r) for r in cp.leaf_buckets(sets, 0.8, 0.99).collect())

    got = found()
    assert len(calls) == 1 and len(got) > 1000
    for held in (0, 150):
        monkeypatch.setattr(cp, "HELD", held)
        assert found() == got
    assert len(calls) > 4
    sets.unpersist()


def test_recall_follows_the_runs():
    assert cp.survival(0.8, 1) > cp.survival(0.8, 4) > 0.3
    assert 1 - (1 - cp.survival(0.8, 4)) ** cp.runs_for(0.8, 0.999) >= 0.999


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    other = np.concatenate([base[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    same = (cp.sketch(np.unique(base)) == cp.sketch(np.unique(other))).mean()
    assert abs(same - 800 / 1200) < 0.15


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(60)] + [(300, x) for x in range(301, 340)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in pairs)}


def brute_hits(text, items):
    words = byte_words((text or "").encode())
    hit, found = set(), set()
    for item, body in items:
        own = byte_words((body or "").encode())
        size = min(13, len(own))
        for k in range(len(own) - size + 1) if own else ():
            for p in range(len(words) - size + 1):
                if words[p : p + size] == own[k : k + size]:
                    hit |= set(range(p, p + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [ct.BLOCK_WORDS, 20])
def test_hits_equal_brute_force(spark, block_words):
    rnd = random.Random(4)
    pool = ["a", "b", "c", "É", "dd"]
    items = [(k, " ".join(rnd.choice(pool) for _ in range(n))) for k, n in enumerate((13, 14, 20, 3, 1, 30))] + [(9, ""), (10, None)]
    items[4] = (4, "rare")
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    texts += [f"x {items[5][1]} y {items[0][1].upper()}", items[2][1], "so Rare", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = ct.contamination(docs, bench, block_words=block_words).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, found = brute_hits(r.text, items)
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found))
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_longest_match(spark):
    item = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{k}" for k in range(5, 30)) + " y")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    row = ct.contamination(docs, bench).first()
    assert (row.longest, row.n_hit) == (25, 25)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 300):
        s = rng.integers(0, 3, n).astype(np.int32)
        order = ct.suffix_array(s, n)
        assert order.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def brute_lines(rows):
    first, out = {}, {}
    windows = []
    for i, text in sorted(rows):
        lines = text.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if "".join(w).strip(" "):
                first.setdefault(w, (i, p))
                windows.append((w, i, p))
    gone = {i: set() for i, _ in rows}
    for w, i, p in windows:
        at, place = first[w]
        gone[i] |= {k for k in range(p, p + 3) if (i, p) != (at, place) and (i != at or k >= place + 3)}
    for i, text in rows:
        out[i] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[i])
    return out


def test_copied_passages_go_also_where_a_copy_follows(spark):
    """A later copy of a document does not shield what that document has taken from another."""
    passage = ["p1", "p2", "p3", "p4"]
    rows = [(1, ["a1", "a2", *passage, "z1", "z2"]), (2, ["A", "B", *passage, "C", "D"]), (3, ["A", "B", *passage, "C", "D"])]
    rows += [(4, ["z", "z", "z", "z", "z"])]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id long, text string")
    left = {r.doc_id: r.text.split("\n") for r in dedup_lines(docs).collect()}
    assert left == {1: rows[0][1], 2: ["A", "B", "C", "D"], 3: [""], 4: ["z", "z", "z"]}


def test_lines_equal_brute_force(spark):
    rnd = random.Random(6)
    rows = [(i, "\n".join(rnd.choice(["a", "b", "c", ""]) for _ in range(rnd.randint(1, 9)))) for i in range(60)]
    rows += [(100, "p\nq\nr\ns"), (101, "x\np\nq\nr\ns\ny"), (102, "z\nz\nz\nz\nz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_lines(docs).collect()} == brute_lines(rows)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = stage(spark, docs, FOLDER).cache()
        rows = after.collect()
        left = {r.doc_id for r in rows}
        if name == "language":
            assert left == set(before)
        elif name == "line_dedup":
            want = brute_lines(list(before.items()))
            assert {r.doc_id: r.text for r in rows} == {i: t for i, t in want.items() if t == before[i] or t.strip(" ")}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_duplicates":
            assert left == {c for c, _ in brute_classes(list(before.items())).values()}
        elif name == "decontamination":
            for i, text in before.items():
                n, hit, _ = brute_hits(text, bench)
                assert (i in left) == (not hit or 20 * hit < n)
        else:
            assert left == set(before) and all(len(r.ids) == r.n_tokens > 0 for r in rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        docs = after
