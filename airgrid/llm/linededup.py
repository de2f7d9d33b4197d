"""Line dedup by overlapping three-line windows, in DataFrame functions only.

Every three consecutive lines of a text are a window with a hash. A window whose hash occurred before, in the order of (doc_id,
text digest, line), is a later occurrence, and all lines under later occurrences go; overlapping windows merge. The earliest
occurrence of a line in that order is never under a later occurrence, so every distinct line stays at least once.

A window's count is summed before the exchange, so a window in a third of all texts is one row per task there; what is repeated
is found by count first, and only repeated windows are ordered. Hot windows then meet one row of their own in a join, which can
be split; nothing gathers a window's occurrences. Kept lines follow from array_except, linear in a text's lines.

Null text has no lines and stays null; a text of under three lines and windows of three empty lines are left alone; rows equal
in doc_id and text tie and share their fate: neither is a later occurrence of the other. A null doc_id sorts first. Columns
pass through; text is set anew, and columns named n_lines or n_removed in any case are lost to ours. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm import _store

WINDOW = 3


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, t (digest of the text), at (line), w (digest of the window)."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("t"), F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= size)
    starts = F.sequence(F.lit(0), F.size("lines") - size)
    hashed = F.transform(starts, lambda i: F.unhex(F.md5(F.concat_ws("\n", *[F.get("lines", i + k) for k in range(size)]))))
    out = lines.select("doc_id", "t", F.posexplode(hashed).alias("at", "w"))
    return out.where(F.col("w") != F.unhex(F.md5(F.lit("\n" * (size - 1)))))


def removed_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, t, gone: the lines under later occurrences, for each text that has some."""
    windows = _windows(docs, size)
    repeated = windows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("w")
    found = _store.written(windows.join(repeated, "w"), "lines-repeated")
    first = found.groupBy("w").agg(F.min(F.struct("doc_id", "t", "at")).alias("first"))
    later = found.join(first, "w").where(~F.struct("doc_id", "t", "at").eqNullSafe(F.col("first")))
    covered = later.groupBy("doc_id", "t").agg(F.collect_set("at").alias("ats"))
    gone = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + size - 1))))
    return _store.written(covered.select("doc_id", "t", gone.alias("gone")), "lines-gone")


def dedup(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with text cleaned, n_lines before and n_removed."""
    rows, names = _store.inner(docs)
    doc, text = _store.place(names, "doc_id"), _store.place(names, "text")
    rows = rows.withColumns({doc: F.col(doc).cast("long"), text: F.col(text).cast("string")})
    gone = removed_lines(rows.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), size).select(F.struct("doc_id", "t").alias("gone_key"), "gone")
    kept_names = [k for k, c in enumerate(names) if c.lower() not in ("n_lines", "n_removed")]
    keyed = rows.select(*[f"c{k}" for k in kept_names]).withColumn("key", F.struct(F.col(doc).alias("doc_id"), F.unhex(F.md5(text)).alias("t")))
    joined = _store.bounded_join(keyed, gone, F.col("key").eqNullSafe(F.col("gone_key")), "left").withColumn("lines", F.split(text, "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    clean = F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size("lines")).cast("long")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    columns = [(clean if f"c{k}" == text else F.col(f"c{k}")).alias(f"c{k}") for k in kept_names]
    return joined.select(*columns, n_lines.alias("n_lines"), n_removed.alias("n_removed")).toDF(*[names[k] for k in kept_names], "n_lines", "n_removed")


ORACLE = """
WITH lines AS (
    SELECT d.doc_id, d.text, u.ln, string_split(d.text, chr(10))[u.ln + 1] AS line, len(string_split(d.text, chr(10))) AS n
    FROM documents d, LATERAL (SELECT unnest(range(0, len(string_split(d.text, chr(10))))) AS ln) u
    WHERE d.text IS NOT NULL
), windows AS (
    SELECT doc_id, text, ln, line || chr(10) || lead(line, 1) OVER p || chr(10) || lead(line, 2) OVER p AS w
    FROM lines WINDOW p AS (PARTITION BY doc_id, text ORDER BY ln)
), ranked AS (
    SELECT *, rank() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, md5(text), ln) AS r
    FROM windows WHERE w IS NOT NULL AND w <> chr(10) || chr(10)
), gone AS (
    SELECT DISTINCT doc_id, text, ln + k AS ln FROM ranked, (VALUES (0), (1), (2)) v(k) WHERE r > 1
), kept AS (
    SELECT l.doc_id, l.text, any_value(l.n) AS n, count(g.ln) AS gone,
           coalesce(string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (WHERE g.ln IS NULL), '') AS clean
    FROM lines l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text = g.text AND l.ln = g.ln
    GROUP BY l.doc_id, l.text
)
SELECT d.doc_id, k.clean AS text, coalesce(k.n, 0)::BIGINT AS n_lines, coalesce(k.gone, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.text = k.text
"""
