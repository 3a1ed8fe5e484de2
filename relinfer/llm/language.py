"""Language ID (7): the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relinfer.llm.common import WORD_TABLE, add_columns, text_bytes
from relinfer.session import cut

# Language codes of each family; any other code is of the family "other".
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr bs sr mk bg",
    "finno-ugric": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNKNOWN = "und"

# Hashed features of byte n-grams of one to three bytes.
DIM = 4096
# Labelled documents per language at most that the classifiers are fitted on.
SAMPLE_PER_LANG = 400
# Passes of the training over its sample, and the price of a violated margin.
EPOCHS, COST = 20, 4.0
# Learning uses no document of this remainder of the id's checksum.
FOLDS, HELD_OUT = 4, 2

LETTER = re.compile(r"[^\W\d_]")
ASCII_LETTER = re.compile(rb"[a-z]")


def held_out(id_col: str, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether an id's checksum leaves the remainder `fold`; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def features(text: bytes) -> np.ndarray | None:
    """Unit vector of square roots of n-gram counts; None without a letter.

    Signs and white space count as one space in a row, upper-case ASCII as lower-case.
    """
    words = text.translate(WORD_TABLE).split()
    flat = b" " + b" ".join(words) + b" "
    if not ASCII_LETTER.search(flat) and not LETTER.search(flat.decode("utf-8", "replace")):
        return None
    b = np.frombuffer(flat, np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0x27D4EB2F) + b[2:] * np.uint32(0xC2B2AE3D)
    index = np.concatenate([b * np.uint32(0x165667B1) >> 20, two >> 20, three >> 20])
    x = np.sqrt(np.bincount(index, minlength=DIM)).astype(np.float32)
    return x / np.linalg.norm(x)


def train_svm(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, by dual coordinate descent.

    Classes weigh alike, whatever their sizes.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    price = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
    diagonal = (x * x).sum(1) + 0.5 / price
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            gradient = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / price[i]
            new = max(0.0, alpha[i] - gradient / diagonal[i])
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    return w.astype(np.float32)


def _tasks(langs: list[str], family_of: dict[str, str]) -> list[tuple[str, str, str]]:
    """(level, a, b) of each binary classifier: pairs of families, and of languages in a family."""
    families = sorted({family_of[x] for x in langs})
    out = [("family", a, b) for a, b in combinations(families, 2)]
    for f in families:
        out += [("lang", a, b) for a, b in combinations([x for x in langs if family_of[x] == f], 2)]
    return out


class Classifier:
    """Weights of all binary classifiers, and how they vote."""

    def __init__(self, langs: list[str], family_of: dict[str, str], weights: dict[tuple[str, str, str], np.ndarray]):
        self.members: dict[str, list[str]] = {}
        for x in langs:
            self.members.setdefault(family_of[x], []).append(x)
        self.families = sorted(self.members)
        self.pairs = sorted(weights)
        self.matrix = np.stack([weights[p] for p in self.pairs]) if weights else np.zeros((0, DIM + 1), np.float32)
        self.row = {p: k for k, p in enumerate(self.pairs)}

    def _vote(self, level: str, names: list[str], margin: np.ndarray) -> tuple[str, float]:
        """The name with the greatest mean probability against the others (first of equals)."""
        if len(names) == 1:
            return names[0], 1.0
        won = dict.fromkeys(names, 0.0)
        for a, b in combinations(names, 2):
            p = 1 / (1 + np.exp(-2 * float(np.clip(margin[self.row[level, a, b]], -20, 20))))
            won[a] += p
            won[b] += 1 - p
        best = max(names, key=won.get)
        return best, won[best] / (len(names) - 1)

    def predict(self, text: bytes) -> tuple[str, float]:
        x = features(text) if self.families else None
        if x is None:
            return UNKNOWN, 0.0
        margin = self.matrix[:, :-1] @ x + self.matrix[:, -1]
        family, p = self._vote("family", self.families, margin)
        lang, q = self._vote("lang", self.members[family], margin)
        return lang, p * q


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> Classifier:
    """Fit all classifiers on at most `per_lang` documents of each non-null language.

    The sample takes the rows with the smallest hash, so it depends neither on order nor on
    partitioning. Features of whole texts are computed where the rows are; each binary
    classifier is fitted in a task of its own, on the sample of its two sides. The number of
    languages is taken to be small (hundreds).
    """
    spark = labelled.sparkSession
    # The scatter of a row's place in the sample; equal texts with other ids stand elsewhere.
    scatter = F.xxhash64(*(F.col(f"`{c}`") for c, t in labelled.dtypes if not t.startswith("map")))
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), scatter.alias("at")
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Classifier([], {}, {})
    # Thin out by the scatter first, so that few rows are ranked.
    shares = spark.createDataFrame(
        [(x, min(1.0, 2.0 * per_lang / n + 1e-9)) for x, n in counts.items()], "lang string, share double"
    )
    unit = (F.shiftrightunsigned("at", 11) / float(1 << 53)).cast("double")
    thin = rows.join(F.broadcast(shares), "lang").where(unit < F.col("share"))
    ranked = thin.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("at", "text")))

    def vectors(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [features(t) for t in text_bytes(batch, "text")]
        return [pa.array([None if x is None else x.tobytes() for x in found], pa.binary())]

    sample = cut(
        add_columns(ranked.where(F.col("rank") <= per_lang), "x binary", vectors, drop=("text", "share"))
        .where("x IS NOT NULL")
    )
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    family_of = {x: FAMILY_OF.get(x.lower().split("-")[0], "other") for x in langs}
    tasks = _tasks(langs, family_of)
    if not tasks:
        return Classifier(langs, family_of, {})
    sides = [
        (x, level, a, b, 1.0 if a in (x, family_of[x]) else -1.0)
        for level, a, b in tasks for x in langs
        if (x if level == "lang" else family_of[x]) in (a, b)
    ]
    parts = spark.createDataFrame(sides, "lang string, level string, a string, b string, y double")

    def fit(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by([("lang", "ascending"), ("at", "ascending"), ("rank", "ascending")])
        x = np.stack([np.frombuffer(v, np.float32) for v in group["x"].to_pylist()])
        w = pa.array([train_svm(x, group["y"].to_numpy()).tobytes()], pa.binary())
        return pa.table([*(pa.array([k.as_py()]) for k in key), w], ["level", "a", "b", "w"])

    fitted = (
        sample.join(F.broadcast(parts), "lang").groupBy("level", "a", "b")
        .applyInArrow(fit, "level string, a string, b string, w binary").collect()
    )
    return Classifier(langs, family_of, {(r["level"], r["a"], r["b"]): np.frombuffer(r["w"], np.float32) for r in fitted})


def identify(docs: DataFrame, classifier: Classifier, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with lang_pred and score (0 to 1), from the whole text alone.

    `und` with score 0: null and empty texts, texts without a letter, or nothing learned.
    Columns of these names are replaced, others carried. A narrow pass; the broadcast
    weights have DIM + 1 numbers for each pair of languages.
    """
    model = docs.sparkSession.sparkContext.broadcast(classifier)

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        langs, scores = zip(*map(model.value.predict, text_bytes(batch, text_col)))
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return add_columns(docs, "lang_pred string, score double", fn, drop=drop)
