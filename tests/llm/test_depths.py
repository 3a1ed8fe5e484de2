"""The weighted tree of the query at its full depth, whichever way its logs reach a text."""

import zlib

import pyarrow as pa
import pytest

from relinfer.llm import ctw
from tests.llm.test_texts import slow_tree


@pytest.mark.parametrize("frequent", [1, 40, ctw.FREQUENT])
def test_scores_look_back_four_bytes(spark, frequent):
    texts = ["xabcd yabce", "xabcd zabcf", "abracadabra", "a banana", "xabcd", "", "qabcd", "xabcd yabce"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    slow = slow_tree([t.encode() for t, h in zip(texts, held) if not h], 4)
    rows = ctw.score_texts(docs, frequent=frequent).collect()
    assert any(held) and len(rows) == len(texts)
    for r in rows:
        assert r.score == pytest.approx(slow(r.text.encode()), rel=1e-4)


def test_groups_are_cut_between_last_bytes(monkeypatch):
    monkeypatch.setattr(ctw, "AT_ONCE", 3)
    shift = 8 * (ctw.DEPTH - 1)
    grams = sorted((last << shift) + k for last, n in ((1, 1), (2, 7), (5, 2), (6, 4)) for k in range(n))
    batches = [pa.RecordBatch.from_arrays([pa.array(grams[k : k + 2])], ["gram"]) for k in range(0, len(grams), 2)]
    parts = [t.column("gram").to_pylist() for t in ctw._whole_groups(iter(batches))]
    assert sum(parts, []) == grams and len(parts) > 1
    ends = [{g >> shift for g in p} for p in parts]
    assert all(not a & b for a, b in zip(ends, ends[1:]))
