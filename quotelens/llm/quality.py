"""Quality rules whose cutoffs come from mergeable quantile sketches per language and source.

A sketch is the number of documents per rounded value, the value keeping its leading `bits` binary digits: the relative
error is below 2 ** (1 - bits), a sketch has at most 2 ** (bits - 1) counters a power of two, and sketches merge by adding
counters, in any order and to the same result. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import stored

SPACE = r"[\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"
MEASURES = ("symbol_rate", "word_length", "duplicate_rate")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words of the array that lie in a three-word window found twice or more in it.

    Windows are compared by 64-bit hash. Sorting puts equal ones side by side; a covered word counts once.
    """
    def hashed(w, i):
        return F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))

    def repeated(s):
        return F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))

    def covered(positions):
        return F.aggregate(
            positions, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")), lambda acc: acc["n"])

    def sorted_windows(w):
        return F.sort_array(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(hashed(w, i).alias("h"), i.alias("p"))))

    def count(w):
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: hashed(w, i))
        again = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(F.size(w) < 4, 0).when(~again, 0).otherwise(
            let(sorted_windows(w), lambda s: covered(F.sort_array(F.transform(repeated(s), lambda x: x["p"])))))

    return let(words, count).cast("long")


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the text, with the measures of the whole text; a null text has no words. Columns of the same names are replaced.

    n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines, n_repeat_words, base_failed.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    w = F.col("__words")
    cut = docs.select(*[c for c in docs.columns if c != text], words.alias("__words"), F.length(F.regexp_replace(t, NOT_SYMBOL, "")).cast("long").alias("__symbols"),
                      let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("__lines"))
    out = cut.withColumns({
        "n_words": F.size(w).cast("long"), "word_chars": F.length(F.array_join(w, "")).cast("long"), "n_symbols": F.col("__symbols"),
        "n_lines": F.col("__lines.n"), "n_dup_lines": F.col("__lines.n") - F.col("__lines.d"), "n_repeat_words": repeat_words(w)})
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("__words", "__symbols", "__lines")


def per_mille(part: str, whole: str) -> Column:
    return F.expr(f"CASE WHEN {whole} > 0 THEN 1000 * {part} div {whole} ELSE 0 END")


def rounded(value: Column, bits: int) -> Column:
    """The non-negative integer with its lowest binary digits cleared beyond `bits` leading ones."""
    drop = F.greatest(F.lit(0), F.length(F.bin(value)) - bits)
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(measured: DataFrame, groups: list[str], bits: int = 7) -> DataFrame:
    """Sketch rows (groups, measure, value, n) of the rows of `measured`."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), rounded(F.col(m), bits).alias("value")) for m in MEASURES]))
    return measured.select(*groups, pairs.alias("__x")).select(*groups, "__x.*").groupBy(*groups, "measure", "value").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return sketch.groupBy(*groups, "measure", "value").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, measure, total, low, high): first and third quartile of each sketch, the value at rank ceil(q * total)."""
    by = Window.partitionBy(*groups, "measure")
    ranked = sketch.withColumns({"total": F.sum("n").over(by), "upto": F.sum("n").over(by.orderBy("value"))})
    return ranked.groupBy(*groups, "measure").agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("value"))).alias("low"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("value"))).alias("high"))


def fences(sketch: DataFrame, min_rows: int, spread: int, floors: dict[str, int]) -> DataFrame:
    """One row per (lang, source) with the lowest and highest allowed value of each measure.

    The fences lie `spread` interquartile ranges (at least the measure's floor) outside the quartiles. A group of fewer
    than `min_rows` documents takes its language's sketch, and a language of fewer the sketch of all.
    """
    own = quartiles(sketch, ["lang", "source"])
    by_lang = quartiles(merged(sketch, ["lang"]), ["lang"])
    all_rows = quartiles(merged(sketch, []), [])
    renamed = lambda df, p: df.select(*[F.col(c).alias(c if c in ("measure", "lang", "source") else f"{p}_{c}") for c in df.columns])
    lang, every = renamed(by_lang, "l").alias("l"), renamed(all_rows, "e").alias("e")
    o = own.alias("o")
    joined = (o.join(lang, F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.measure") == F.col("l.measure")))
              .join(every, F.col("o.measure") == F.col("e.measure")))
    pick = lambda c: F.when(F.col("total") >= min_rows, F.col(c)).when(F.col("l_total") >= min_rows, F.col(f"l_{c}")).otherwise(F.col(f"e_{c}"))
    picked = joined.select("o.lang", "o.source", "o.measure", pick("low").alias("low"), pick("high").alias("high"))
    floor = F.coalesce(*[F.when(F.col("measure") == m, F.lit(v)) for m, v in floors.items()], F.lit(0))
    width = spread * F.greatest(F.col("high") - F.col("low"), floor)
    both = picked.withColumns({"lowest": F.col("low") - width, "highest": F.col("high") + width})
    return both.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("measure") == m, F.col(end))).alias(f"{m}_{end}") for m in MEASURES for end in ("lowest", "highest")])


# least interquartile range that the fences assume, in thousandths
FLOORS = {"symbol_rate": 20, "word_length": 150, "duplicate_rate": 100}


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_rows: int = 100, spread: int = 6,
          floors: dict[str, int] | None = None) -> DataFrame:
    """Each row of `docs` without its text, with its base measures, base_failed and kept.

    kept is false for rows that fail the base rule; of the others the three rates (symbols a word, characters a word,
    repeated lines a line, in thousandths) must lie within the fences of the row's language and source, which come from
    the rows that pass the base rule. Null languages and sources form groups of their own; null texts fail the base rule.
    Repeated rows are judged alike. An empty table gives an empty result.
    """
    base = base_measures(docs.withColumns({"__lang": F.col(lang), "__source": F.col(source)}), text).withColumns({
        "symbol_rate": per_mille("n_symbols", "n_words"), "word_length": per_mille("word_chars", "n_words"), "duplicate_rate": per_mille("n_dup_lines", "n_lines")})
    base = stored(base, "quality")
    passing = base.where(~F.col("base_failed")).select(F.col("__lang").alias("lang"), F.col("__source").alias("source"), *MEASURES)
    limits = fences(sketches(passing, ["lang", "source"]), min_rows, spread, floors or FLOORS)
    limits = limits.withColumnsRenamed({"lang": "__l", "source": "__s"})
    within = F.lit(True)
    for m in MEASURES:
        within = within & F.col(m).between(F.col(f"{m}_lowest"), F.col(f"{m}_highest"))
    joined = base.join(limits, F.col("__lang").eqNullSafe(F.col("__l")) & F.col("__source").eqNullSafe(F.col("__s")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False))).drop(
        "__lang", "__source", "__l", "__s", *[f"{m}_{end}" for m in MEASURES for end in ("lowest", "highest")])


SQL = r"""
WITH words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, p, struct_pack(a := w[p], b := w[p + 1], c := w[p + 2]) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM words)),
repeats AS (
  SELECT doc_id, count(DISTINCT p + d) AS n
  FROM (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1), (VALUES (0), (1), (2)) AS v(d) GROUP BY doc_id),
base AS (
  SELECT words.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN repeats ON words.doc_id = repeats.doc_id),
rated AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbol_rate,
         CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length,
         CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS duplicate_rate
  FROM base),
tall AS (
  SELECT lang, source, measure, (x >> greatest(0, length(bin(x)) - 7)) << greatest(0, length(bin(x)) - 7) AS v
  FROM (SELECT lang, source, unnest(['symbol_rate', 'word_length', 'duplicate_rate']) AS measure,
               unnest([symbol_rate, word_length, duplicate_rate]) AS x FROM rated WHERE NOT base_failed)),
own AS (SELECT lang, source, measure, count(*) AS total, quantile_disc(v, 0.25) AS low, quantile_disc(v, 0.75) AS high FROM tall GROUP BY ALL),
bylang AS (SELECT lang, measure, count(*) AS total, quantile_disc(v, 0.25) AS low, quantile_disc(v, 0.75) AS high FROM tall GROUP BY ALL),
every AS (SELECT measure, quantile_disc(v, 0.25) AS low, quantile_disc(v, 0.75) AS high FROM tall GROUP BY ALL),
picked AS (
  SELECT o.lang, o.source, o.measure,
         CASE WHEN o.total >= 100 THEN o.low WHEN l.total >= 100 THEN l.low ELSE e.low END AS low,
         CASE WHEN o.total >= 100 THEN o.high WHEN l.total >= 100 THEN l.high ELSE e.high END AS high
  FROM own o JOIN bylang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN every e ON o.measure = e.measure),
fences AS (
  SELECT lang, source, measure, low - 6 * greatest(high - low, f) AS lowest, high + 6 * greatest(high - low, f) AS highest
  FROM picked JOIN (VALUES ('symbol_rate', 20), ('word_length', 150), ('duplicate_rate', 100)) AS v(m, f) ON measure = m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND symbol_rate BETWEEN a.lowest AND a.highest AND word_length BETWEEN b.lowest AND b.highest
         AND duplicate_rate BETWEEN c.lowest AND c.highest AS kept
FROM rated r
LEFT JOIN fences a ON a.measure = 'symbol_rate' AND a.lang IS NOT DISTINCT FROM r.lang AND a.source IS NOT DISTINCT FROM r.source
LEFT JOIN fences b ON b.measure = 'word_length' AND b.lang IS NOT DISTINCT FROM r.lang AND b.source IS NOT DISTINCT FROM r.source
LEFT JOIN fences c ON c.measure = 'duplicate_rate' AND c.lang IS NOT DISTINCT FROM r.lang AND c.source IS NOT DISTINCT FROM r.source
"""
