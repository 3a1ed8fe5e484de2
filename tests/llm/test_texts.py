"""Digests, context-tree weighting, languages and pieces against plain computations."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from relinfer.llm import catalog, ctw, digest, language, pieces
from tests.conftest import FOLDER


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_digest(spark, texts):
    rows = catalog.op4_digest(spark, FOLDER).collect()
    ids = sorted(texts, reverse=True)
    following = dict(zip(ids, ids[1:] + ids[:1]))
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        text, other = texts[r.doc_id], texts[following[r.doc_id]]
        new = text[: len(text) - len(text) // 3] + other[: len(text) // 3]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == digest.fingerprint(text.encode()) and r.edited_fingerprint == digest.fingerprint(new.encode())
        assert r.near_next == pytest.approx(digest.likeness(r.fingerprint, digest.fingerprint(other.encode())))
    assert sum(r.near_edited > r.near_next for r in rows) > 0.97 * len(rows)


def test_digest_bits():
    text = "the quick brown fox".encode()
    counts = Counter(int(digest.MIX[0][a] ^ digest.MIX[1][b] ^ digest.MIX[2][c]) for a, b, c in zip(text, text[1:], text[2:]))
    all_ = sorted(counts[k] for k in range(256))
    q = [all_[63], all_[127], all_[191]]
    bits = "".join(f"{sum(counts[k] > x for x in q):02b}" for k in range(256))
    assert digest.fingerprint(text)[4:] == f"{int(bits, 2):0128x}"
    assert digest.likeness(digest.fingerprint(text), digest.fingerprint(text)) == 1.0
    assert 0.0 <= digest.likeness(digest.fingerprint(b""), digest.fingerprint(text * 90)) < 1.0


def test_base_score(spark, docs, texts):
    rows = ctw.score_texts(docs, frequent=3000).collect()
    tokens = {i: t.encode().lower().split() + [b""] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i in texts if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(own), n)
        assert r.n_known == sum(counts[w] > 0 for w in own)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
    assert np.mean([r.bits_per_byte for r in rows if r.held_out]) < 3.2


def slow_tree(train, depth):
    """Predictor by recursion over dictionaries: (context, node) -> [zeros, ones]."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def steps(data):
        for at in range(depth, len(data)):
            node = 1
            for k in range(7, -1, -1):
                yield data[at - depth : at], node, data[at] >> k & 1
                node = 2 * node + (data[at] >> k & 1)

    pad = b"\0" * depth
    for text in train:
        for context, node, bit in steps(pad + text + b"\0"):
            for d in range(depth + 1):
                own = context[depth - d :]
                counts[own, node][bit] += 1
                if d:
                    children[own[1:], node].add(own)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def weighted(own, node):
        e = kt(*counts[own, node])
        if len(own) == depth:
            return e, 1.0
        below = sum(weighted(c, node)[0] for c in children[own, node])
        w = np.logaddexp(e, below) - math.log(2)
        return w, math.exp(e - math.log(2) - w)

    def score(text):
        total = 0.0
        for context, node, bit in steps(pad + text + b"\0"):
            p, rest = 0.0, 1.0
            for d in range(depth + 1):
                own = context[depth - d :]
                c = counts[own, node] if (own, node) in counts else [0, 0]
                share = weighted(own, node)[1] if sum(c) or d == depth else 0.5
                share = 1.0 if d == depth else share
                p += rest * share * (c[bit] + 0.5) / (sum(c) + 1)
                rest *= 1 - share
            total += math.log10(p)
        return total

    return score


def test_tree_equals_recursion(spark):
    train = [b"abracadabra", b"a banana", b"bandana abra"]
    rows = spark.createDataFrame([(t.decode(),) for t in train], "text string")
    tree = ctw.train_tree(ctw.count_corpus(rows, "text").where("gram IS NOT NULL").select("gram", "n"))
    slow = slow_tree(train, ctw.DEPTH)
    for text in (b"abra", b"banana bra", b"zebra", b""):
        assert tree.score(text) == pytest.approx(slow(text), rel=1e-4)


def test_tree_is_a_distribution(spark, docs):
    tree = ctw.train_tree(ctw.count_corpus(docs, "text").where("gram IS NOT NULL").select("gram", "n"))
    assert np.allclose((10.0 ** tree.table).sum(1), 1, atol=1e-4)


def test_language_held_out(spark, docs):
    rows = catalog.op7_language(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert np.mean(held) > 0.95


def test_language_ignores_labels(spark, docs):
    """Predictions depend on the text alone."""
    classifier = language.train(docs)
    a = language.identify(docs, classifier).select("doc_id", "lang_pred").collect()
    b = language.identify(docs.selectExpr("doc_id", "text", "'xx' AS lang", "'s' AS source"), classifier).select("doc_id", "lang_pred").collect()
    assert sorted(a) == sorted(b)


def test_undetermined(spark, docs):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "中文")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.identify(odd, language.train(docs)).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] != "und"


@pytest.fixture(scope="module")
def machine():
    with open(pieces.MODEL_PATH, "rb") as f:
        return pieces.compile_transducer(f.read())


def brute_path(machine, text):
    """Least cost over all segmentations, by memory of suffixes."""
    best = {len(text): 0.0}
    for i in range(len(text) - 1, -1, -1):
        options = [machine.arcs[text[i:j]][0] + best[j] for j in range(i + 1, min(len(text), i + 20) + 1) if text[i:j] in machine.arcs]
        if text[i] not in machine.arcs:
            options.append(machine.byte_cost * len(text[i].encode()) + best[i + 1])
        best[i] = min(options)
    return best[0]


PIECE_TEXTS = [
    "hello world", "  two  spaces ", "a\nb\n\n c", "größe 中文 \U0001f600", "\t", " ", "x" * 500, "   \n   ", "\r\n",
    "▁ a▁b ▁▁", "a\x1fb \x1f c", "", "中文" * 200 + "é\U0001f600 " + "word" * 40, " " * 200 + "z",
]


def test_paths_are_cheapest_and_come_back(machine):
    ids, counts = pieces.encode_texts(machine, pa.array(PIECE_TEXTS))
    back = {i: c for c, i in machine.arcs.values()}
    for text, end, n in zip(PIECE_TEXTS, np.cumsum(counts), counts):
        own = ids[end - n : end].tolist()
        # The sign itself is no space: a sign of no piece stands in its place.
        normal = (" " + text).replace(pieces.SPACE, "\uE000").replace(" ", pieces.SPACE) if text else ""
        assert sum(back.get(i, machine.byte_cost) for i in own) == pytest.approx(brute_path(machine, normal))
        assert pieces.decode_ids(machine, own) == text
        alone, _ = pieces.encode_texts(machine, pa.array([text]))
        assert alone.tolist() == own


def test_long_words_take_the_same_paths(machine, monkeypatch):
    words = pa.array([" heonti$$$", "größe", " 中a中", " " * 9, "xyzzy" * 12])
    short = [x.tolist() for x in pieces.encode_words(machine, words)]
    monkeypatch.setattr(pieces, "LONG", 0)
    assert short == [x.tolist() for x in pieces.encode_words(machine, words)]


def test_round_trip(spark, texts):
    rows = catalog.op3_pieces(spark, FOLDER).collect()
    assert len(rows) == len(texts) and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
