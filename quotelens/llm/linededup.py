"""Line deduplication by overlapping windows of three consecutive lines.

Each window is hashed; a window found more than once in all texts keeps its first occurrence, and the lines covered by
later ones are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let

WINDOW = 3
BLANK = " \t\n\x0b\x0c\r"


def numbered_lines(text: Column) -> Column:
    """Array of (i, t): each line with a visible character, its place among all lines and its trimmed text."""
    cut = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x, F.lit(BLANK)).alias("t")))
    return F.filter(cut, lambda x: F.length(x["t"]) > 0)


def windows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mark, begin, end, h1, h2): a row for each window; mark is the text's hash, begin and end are line places.

    The pair of hashes has 96 bits.
    """
    def window(lines, k):
        three = [F.get(lines, k + d)["t"] for d in range(WINDOW)]
        return F.struct(F.get(lines, k)["i"].alias("begin"), F.get(lines, k + WINDOW - 1)["i"].alias("end"),
                        F.xxhash64(*three).alias("h1"), F.hash(F.lit(17), *three).alias("h2"))

    made = let(numbered_lines(F.col(text)), lambda lines: F.when(
        F.size(lines) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(lines) - WINDOW), lambda k: window(lines, k))))
    return docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.explode(made).alias("w")).select("key", "mark", "w.*")


def covered_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mark, covered): for each text that loses lines, the places of the lines that later occurrences cover.

    The first occurrence is the lowest by (key, mark, begin), null keys first. Frequent windows meet as counts; the
    rows of one of them are split among tasks where they are joined. What is gathered for one text is bounded by its lines.
    """
    every = windows(docs, key, text)
    repeated = (every.groupBy("h1", "h2").agg(F.min(F.struct("key", "mark", "begin")).alias("first"), F.count("*").alias("n"))
                .where("n > 1").select("h1", "h2", "first"))
    later = every.join(repeated, ["h1", "h2"]).where(~F.struct("key", "mark", "begin").eqNullSafe(F.col("first")))
    merged = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("begin", "end")), lambda w: F.sequence(w["begin"], w["end"]))))
    return later.groupBy("key", "mark").agg(merged.alias("covered"))


def remove_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `text` freed of the lines that later occurrences of repeated windows cover, and n_lines_removed.

    Lines are compared without white space at their ends; blank lines count for no window and go with the lines around
    them. Every removed line has an equal line that stays. A text of fewer than three visible lines and a null text stay
    as they are; a text of which all lines go becomes empty. Rows equal in key and text count as one text and are treated
    alike. n_lines_removed replaces a column of that name.
    """
    covered = covered_lines(docs, key, text).select(F.col("key").alias("__key"), F.col("mark").alias("__mark"), F.col("covered").alias("__covered"))
    joined = docs.withColumn("__hash", F.xxhash64(text)).join(
        covered, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__mark")), "left")
    left = let(F.split(F.col(text), "\n"), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__covered")), lambda i: F.get(lines, i)), "\n"))
    names = [c for c in docs.columns if c != "n_lines_removed"]
    return joined.select(
        *[F.when(F.col("__covered").isNull(), F.col(text)).otherwise(left).alias(text) if c == text else F.col(c) for c in names],
        F.coalesce(F.size("__covered"), F.lit(0)).alias("n_lines_removed"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, trim(l, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
visible AS (SELECT doc_id, i, t FROM lines WHERE t <> ''),
win AS (
  SELECT * FROM (
    SELECT doc_id, i AS b, lead(i, 2) OVER w AS e, t AS t1, lead(t, 1) OVER w AS t2, lead(t, 2) OVER w AS t3
    FROM visible WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE e IS NOT NULL),
later AS (SELECT doc_id, b, e FROM win QUALIFY row_number() OVER (PARTITION BY t1, t2, t3 ORDER BY doc_id, b) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(b, e + 1)) AS i FROM later),
kept AS (
  SELECT a.doc_id, string_agg(l, chr(10) ORDER BY a.i) FILTER (WHERE c.i IS NULL) AS text, count(c.i) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) a
  LEFT JOIN covered c ON a.doc_id = c.doc_id AND a.i = c.i GROUP BY a.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n, 0)::INTEGER AS n_lines_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
