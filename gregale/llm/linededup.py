"""Line dedup on overlapping windows of three lines, in built-in functions only.

Every three consecutive lines of a document are hashed. Windows that occur more than once anywhere are found by grouping the hashes;
of each, the occurrence with the smallest (document, position) stays, and the lines that any later one covers go. Only hashes,
ids and positions are shuffled: the texts of documents that lose lines meet their positions in one join by id.

A window's identity is two 64-bit hashes of its lines, so that no two of 10^13 windows are likely to be taken for one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gregale.llm.common import read

LINES = 3


def _lines(text_col: str):
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def repeated_windows(docs: DataFrame, lines: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, at): the first line of each window that stands earlier in the corpus, too: in a smaller id, or higher in the same text.

    Windows of blank lines alone count as any. text_key, a hash of the text, tells rows of one id apart, the smaller standing first;
    rows equal in both are one document.
    """
    parts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), _lines(text_col).alias("l"))
    window = lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.col("l")[i + k] for k in range(lines)]).alias("h"), F.xxhash64(F.lit(lines), *[F.col("l")[i + k] for k in reversed(range(lines))]).alias("g"))
    windows = parts.where(F.size("l") >= lines).select("id", "text_key", F.explode(F.transform(F.sequence(F.lit(0), F.size("l") - lines), window)).alias("w")).select("id", "text_key", "w.*")
    place = F.struct("id", "text_key", "at")
    first = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g", "first")
    return windows.join(first, ["h", "g"]).where(place > F.col("first")).select("id", "text_key", "at")


def dedup_lines(docs: DataFrame, lines: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_lines, n_removed, n_spans and kept_text: the text without the lines that repeated windows cover.

    A null text has no lines and stays null; an empty one has one line. Null ids aren't compared: such rows stay whole, as do texts
    of fewer than `lines` lines. Rows of one id are documents of their own where their texts differ; repeated rows all lose the same.
    Columns of those names are replaced.
    """
    new = ["n_lines", "n_removed", "n_spans", "kept_text"]
    docs = docs.select(*[c for c in docs.columns if c not in new])
    # positions of one document are at most its lines, so this list is no longer than the text
    starts = repeated_windows(docs.where(F.col(id_col).isNotNull()), lines, id_col, text_col)
    starts = starts.groupBy(F.col("id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set("at").alias("__starts"))
    text = F.col(text_col)
    out = docs.join(starts, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__key")), "left").withColumn("__l", F.when(text.isNotNull(), _lines(text_col)))
    gone = F.array_distinct(F.flatten(F.transform("__starts", lambda s: F.sequence(s, s + (lines - 1)))))
    out = out.withColumn("__gone", F.when(F.col("__starts").isNotNull(), gone))
    rest = F.array_except(F.sequence(F.lit(0), F.size("__l") - 1), "__gone")  # in order
    return out.select(
        *docs.columns,
        F.coalesce(F.size("__l"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed"),
        F.coalesce(F.size(F.array_except("__gone", F.transform("__gone", lambda i: i + 1))), F.lit(0)).alias("n_spans"),
        F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(F.transform(rest, lambda i: F.col("__l")[i]), "\n")).alias("kept_text"),
    )


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "n_spans", "kept_text")


SQL8 = f"""
WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, pos, l[pos + 1 : pos + {LINES}] AS w
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - {LINES - 1})) AS pos FROM lines WHERE len(l) >= {LINES})
),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS r FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {LINES})) AS pos FROM ranked WHERE r > 1),
each AS (SELECT doc_id, l[pos + 1] AS line, pos FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS pos FROM lines)),
kept AS (
  SELECT e.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(CASE WHEN g.pos IS NULL THEN e.line END, chr(10) ORDER BY e.pos), '') AS kept_text
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos GROUP BY e.doc_id
),
spans AS (
  SELECT doc_id, count(*) AS n_spans
  FROM (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM gone) GROUP BY doc_id, k
)
SELECT k.doc_id, k.n_lines, k.n_removed, coalesce(s.n, 0) AS n_spans, k.kept_text
FROM kept k LEFT JOIN (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id) s ON s.doc_id = k.doc_id
"""
