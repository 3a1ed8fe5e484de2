"""Line dedup (10): overlapping windows of three lines, first occurrence kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relinfer.llm.common import text_key

WINDOW = 3


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """(doc, pos, h, g): a row for each window of `size` lines, with 128 bits of hash.

    Windows of blank lines only are left out: they carry no passage.
    """
    line = [F.element_at("_lines", F.col("_pos") + i + 1) for i in range(size)]
    return (
        docs.select("_doc", F.split(F.coalesce("_text", F.lit("")), "\n").alias("_lines"))
        .where(F.size("_lines") >= size)
        .select("_doc", "_lines", F.explode(F.expr(f"sequence(0, size(_lines) - {size})")).alias("_pos"))
        .where(F.trim(F.concat(*line)) != "")
        .select("_doc", "_pos", F.xxhash64(*line).alias("_h"), F.xxhash64(F.lit(11), *line).alias("_g"))
    )


def repeated_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(_doc, _removed): the line numbers (from 0) to remove from each document that has any.

    A window that stands earlier too (by document id, then line) is a later occurrence; the lines
    that later occurrences cover are merged and removed, whatever else covers them. Only where an occurrence
    overlaps the first one of the same window, as in a run of equal lines, the lines of the first one stay.
    Every line that is removed has an equal one at an earlier place, so that no line is lost altogether.
    """
    windows = _windows(docs, size)
    first = (
        windows.groupBy("_h", "_g")
        .agg(F.min(F.struct("_doc", "_pos")).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1").drop("_n")
    )
    overlaps = F.col("_doc").eqNullSafe(F.col("_first._doc"))
    start = F.when(overlaps, F.greatest("_pos", F.col("_first._pos") + size)).otherwise(F.col("_pos"))
    later = (
        windows.join(first, ["_h", "_g"]).where(F.struct("_doc", "_pos") != F.col("_first"))
        .select("_doc", start.alias("_start"), (F.col("_pos") + size - 1).alias("_end")).where("_start <= _end")
    )
    covered = later.select("_doc", F.explode(F.sequence("_start", "_end")).alias("_line"))
    return covered.groupBy("_doc").agg(F.collect_set("_line").alias("_removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """docs with repeated lines removed from the text, and n_lines, n_removed (long).

    Lines are split at newlines. Null text: null, 0 lines. Fewer than three lines:
    unchanged. Null ids count as the smallest. Rows equal in id and text count as
    one document and get one result; other columns are carried, and columns named
    n_lines or n_removed are replaced. An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col(text_col).alias("_text"),
        F.struct(F.col(id_col).alias("id"), text_key(text_col).alias("key")).alias("_doc"),
    )
    removed = repeated_lines(rows.select("_doc", "_text"), size).withColumnRenamed("_doc", "_of")
    lines = F.split("_text", "\n")
    joined = rows.join(removed, F.col("_doc").eqNullSafe(F.col("_of")), "left").select(
        "_row", "_text", "_removed", F.size(lines).alias("_n"), F.when(F.col("_removed").isNotNull(), lines).alias("_lines"),
    )
    rest = F.array_join(
        F.transform(
            F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_removed")),
            lambda i: F.element_at("_lines", i + 1),
        ), "\n",
    )
    text = F.when(F.col("_removed").isNull(), F.col("_text")).otherwise(rest)
    return joined.select(
        *((text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in kept),
        F.when(F.col("_text").isNull(), 0).otherwise(F.col("_n")).cast("long").alias("n_lines"),
        F.when(F.col("_removed").isNull(), 0).otherwise(F.size("_removed")).cast("long").alias("n_removed"),
    )


LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents
), windows AS (
  SELECT doc_id, i - 1 AS pos, l[i : i + 2] AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM lines)
  WHERE trim(l[i] || l[i + 1] || l[i + 2], ' ') <> ''
), marked AS (
  SELECT doc_id, pos, first_value(doc_id) OVER same AS first_doc, first_value(pos) OVER same AS first_pos
  FROM windows WINDOW same AS (PARTITION BY w ORDER BY doc_id, pos)
), covered AS (
  SELECT DISTINCT doc_id, line FROM (
    SELECT *, unnest(range(pos, pos + 3)) AS line FROM marked WHERE doc_id <> first_doc OR pos <> first_pos)
  WHERE doc_id <> first_doc OR line >= first_pos + 3
), removed AS (SELECT doc_id, list(line) AS gone FROM covered GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(
    [x for x, i in string_split(text, chr(10)) if NOT list_contains(gone, i - 1)], chr(10)) END AS text,
  coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN removed r ON d.doc_id = r.doc_id
"""
