"""License scans (6): ordered signature rules behind a keyword prefilter.

Built-in functions only; every step is narrow.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relinfer.llm.license_rules import ROOTS, rule_rows
from relinfer.llm.spans import scan

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What stands between words, in lower-cased text and in text as it is.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

RULE = "struct<number:int, label:string, priority:int, confidence:double, key:string, regex:string>"
FOUND = "struct<start:int, back:int, priority:int, number:int, label:string, confidence:double>"
COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "licenses")


def _gate(text: Column) -> Column:
    """Whether a text holds any rule's root, in either case."""
    lower = F.lower(text)
    found = text.rlike(f"(?i)cc{RAW_BETWEEN}by")
    for root in ROOTS:
        if " " not in root:
            found = lower.contains(root) | found
    return found


def _places(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words stand one after the other."""
    parts = phrase.split()
    starts = F.filter(
        F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull()
    )

    def whole(i: Column) -> Column:
        test = F.lit(True)
        for k, part in enumerate(parts[1:], 1):
            test = test & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return test

    return F.filter(starts, whole)


def _detections(norm: Column) -> Column:
    """Matches of all rules whose key the words hold, in order of start, longest first, best priority first."""
    rules = F.from_json(F.lit(json.dumps(rule_rows())), f"array<{RULE}>")

    def matches(rule: Column) -> Column:
        parts = F.split(norm, rule["regex"], -1)
        whole = F.regexp_extract_all(norm, rule["regex"], F.lit(0))
        pairs = F.arrays_zip(F.slice(parts, F.lit(1), F.size(whole)).alias("part"), whole.alias("whole"))

        def ended(at: Column, x: Column) -> Column:
            return at + F.length(x["part"]) + F.length(x["whole"])

        def found(at: Column, x: Column) -> Column:
            start = at + F.length(x["part"])
            return F.struct(
                start.alias("start"), (-ended(at, x)).alias("back"), rule["priority"].alias("priority"),
                rule["number"].alias("number"), rule["label"].alias("label"), rule["confidence"].alias("confidence"),
            )

        return scan(pairs, F.lit(0), ended, found, FOUND)

    held = F.filter(rules, lambda r: F.contains(norm, r["key"]))
    return F.array_sort(F.flatten(F.transform(held, matches)))


def _resolve(found: Column) -> Column:
    """Detections left after suppression, in order.

    One that lies within another is dropped (of equal intervals, the one of worse
    priority, then the later rule). Of two that overlap in part, the one of better
    priority stays, of equal ones the earlier.
    """
    def tests(last: Column, x: Column) -> tuple[Column, Column]:
        """Whether x stands apart from the last one that was kept, and whether it replaces it."""
        contained = x["back"] >= last["back"]
        overlap = x["start"] < -last["back"]
        return last.isNull() | (~overlap & ~contained), overlap & ~contained & (x["priority"] < last["priority"])

    def advance(last: Column, x: Column) -> Column:
        apart, replaces = tests(last, x)
        return F.when(x.isNotNull() & (apart | replaces), x).otherwise(last)

    def settled(last: Column, x: Column) -> Column:
        """The last one, once the next stands apart from it or there is none."""
        return F.when(x.isNull() | tests(last, x)[0], last)

    nothing = F.lit(None).cast(FOUND)
    kept = scan(F.array_append(found, nothing), nothing, advance, settled, FOUND)
    return F.filter(kept, lambda x: x.isNotNull())


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word (long), base_labels, labels (string), score (double), licenses.

    `licenses` holds the detections left, with places in the normalised words; score is
    the greatest confidence of them, 0 without any. Null and empty texts have no words.
    Columns of these names are replaced, others carried.
    """
    text = F.coalesce(F.col(f"_row.`{text_col}`"), F.lit(""))
    kept = [c for c in docs.columns if c not in COLUMNS]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"))
    lowered = F.regexp_replace(F.translate(text, UPPER, LOWER), BETWEEN, " ")
    normal = rows.select(
        "_row", F.regexp_count(text, F.lit(RAW_WORD)).cast("long").alias("_n"),
        F.when(_gate(text), F.concat(F.lit(" "), F.trim(lowered), F.lit(" "))).alias("_norm"),
    )
    words = F.split(F.trim("_norm"), " ")
    split = normal.select("_row", "_n", "_norm", F.when(F.col("_norm").isNotNull(), words).alias("_words"))
    none = F.array().cast("array<int>")
    based = split.select(
        "_row", "_n", "_norm", *(
            F.coalesce(_places(F.col("_words"), p), none).alias(f"_p{k}") for k, p in enumerate(PHRASES)
        ),
    )
    places = F.concat(*(F.col(f"_p{k}") for k in range(len(PHRASES))))
    base_labels = F.array_distinct(F.filter(
        F.array(*(F.when(F.size(f"_p{k}") > 0, label) for k, label in enumerate(PHRASES.values()))),
        lambda x: x.isNotNull(),
    ))
    resolved = based.select(
        "_row", "_n", places.alias("_places"), base_labels.alias("_base"),
        F.coalesce(_resolve(_detections(F.col("_norm"))), F.array().cast(f"array<{FOUND}>")).alias("_found"),
    )
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.transform("_found", lambda x: x["label"]))))
    return resolved.select(
        *(F.col(f"_row.`{c}`").alias(c) for c in kept),
        F.col("_n").alias("n_words"), F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"), F.array_max("_places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("_found", lambda x: x["confidence"])), F.lit(0.0)).alias("score"),
        F.transform("_found", lambda x: F.struct(
            x["label"].alias("label"), x["number"].alias("rule"), x["start"].alias("start"), (-x["back"]).alias("end")
        )).alias("licenses"),
    )


