"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

from relinfer.llm import chosen_path, contamination, ctw, digest, language, licenses, line_dedup, pieces, pii, secrets

LONG = "word secret: abcdefgh12 a@b.cc MIT license\n" * 3000
TEXTS = [(1, None), (2, ""), (3, " \n\n\n "), (4, "one two"), (4, "one two"), (5, LONG), (None, "no id at all here now"), (6, "é ß 中文 \U0001f600 ▁▁  x ")]

OPERATORS = {
    "pii": lambda d, b: pii.find_pii(d),
    "near": lambda d, b: chosen_path.near_duplicates(d),
    "drop_near": lambda d, b: chosen_path.drop_near_duplicates(d),
    "pieces": lambda d, b: pieces.decode(pieces.encode(d)),
    "digest": lambda d, b: digest.compare_with_next(d),
    "ctw": lambda d, b: ctw.score_texts(d),
    "licenses": lambda d, b: licenses.scan_licenses(d),
    "language": lambda d, b: language.identify(d, language.train(d)),
    "contamination": lambda d, b: contamination.contamination(d, b),
    "secrets": lambda d, b: secrets.scan_secrets(d),
    "lines": lambda d, b: line_dedup.dedup_lines(d),
}


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (None, "no id at"), (3, "")], "item_id long, text string")


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(spark, bench, name):
    """A row comes out for every row that goes in, whatever it holds and whatever else is there."""
    docs = spark.createDataFrame(
        [(i, t, "en" if t else None, k, 1.0, "s", True) for k, (i, t) in enumerate(TEXTS)],
        "doc_id long, text string, lang string, `_row` int, score double, spans string, key boolean",
    )
    rows = OPERATORS[name](docs, bench).collect()
    assert len(rows) == len(TEXTS)
    if name not in ("near", "digest"):
        assert sorted(r["_row"] for r in rows) == list(range(len(TEXTS)))


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(spark, bench, name):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert OPERATORS[name](docs, bench).count() == 0


def test_empty_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = contamination.contamination(docs, none).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 0, 0, False)
