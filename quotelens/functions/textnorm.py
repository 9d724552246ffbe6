"""Text normalisation as column expressions; only the synonym fold is an Arrow UDF."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from ..session import shuffled
from . import vocabulary as V


# --- fixed values: patterns of the normalisation, applied in this order -----------
NORMAL = (
    (r"\([^)]*\)", " "),
    (r"(?U)^\*+[^*]+\*+\s*", ""),
    (r"(?U)^(NUEVA\s+)?(BOLSA|CAJA|PAQUETE|ROLLO|BIDON)\s+X\s+\d+\w*\s*", ""),
    (r"(?<=[A-Z])-(?=\d)|(?<=\d)-(?=[A-Z])", ""),
    (r"(?U)\bASENTAMIENTO\b", " "),
    (r"(?U)\b\d+\s*CM\b", " "),
    (r"(?U)[^\w\s.\-/]", " "),
    (r"(?U)\s+", " "),
)
SPLIT_MEASURES = (
    (r"(?iU)\bPFGAL\s*C\s*(?=\d)", "PGC "),
    (r"(?iU)\bPFGAL\s*U\s*(?=\d)", "PGU "),
    (r"(?<=\d),(?=\d)", "."),
    (r"(?<=\d)\s*[xX*]\s*(?=\d)", " x "),
    (r"(?<=\d)(?=[A-Za-zÁÉÍÓÚÑáéíóúñ])", " "),
)
GAUGES = (
    (r"(?<![\d.])0[. ](?:89|90|94|9)(?!\d)", "0.94"),
    (r"(?<![\d.])1[. ](?:20|25|29|2)(?!\d)", "1.29"),
    (r"(?<![\d.])1[. ](?:60|64|6)(?!\d)", "1.64"),
    (r"(?<![\d.])2[. ](?:00|04|0)(?!\d)", "2.04"),
)
ANCHOR = r"(?iU)\b(?:roscad\w*|anclaj\w*|spit|fischer|ftr|rgm)\b"
MASK = "VARROSCA"

WORD = re.compile(r"\w+")


def normalize(col: Column) -> Column:
    """Upper case without vowel accents, parentheses, pack prefixes and stray signs."""
    s = F.translate(F.upper(F.coalesce(col, F.lit(""))), "ÁÉÍÓÚÜ", "AEIOUU")
    for pattern, repl in NORMAL:
        s = F.regexp_replace(s, pattern, repl)
    return F.trim(s)


def synonym_rules(extra: dict[str, str] | None = None, base: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """Longest term first; equal lengths keep their order. Later rules see earlier output."""
    merged = dict(V.SYNONYMS if base is None else base)
    merged.update(extra or {})
    return sorted(merged.items(), key=lambda kv: -len(kv[0]))


class Cascade:
    """Ordered synonym rules compiled once: `fold` gives what passing over all rules in order gives, but visits only rules
    that can apply.

    Terms lie in a trie over their words. A term can only stand where all its words stand in a row, so one walk over the
    words of the text finds the rules to try, lowest place first; each replacement can only bring rules of later places.
    """

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = [(term, re.compile(r"\b" + re.escape(term) + r"\b"), canon) for term, canon in rules]
        self.trie: dict = {}
        self.wordless = []
        for i, (term, _) in enumerate(rules):
            words = WORD.findall(term)
            if not words:
                self.wordless.append(i)
                continue
            node = self.trie
            for w in words:
                node = node.setdefault(w, {})
            node.setdefault(None, []).append(i)

    def places(self, text: str) -> set[int]:
        """Rules whose words stand in a row somewhere in the text."""
        words = WORD.findall(text)
        found = set(self.wordless)
        for i, w in enumerate(words):
            node, j = self.trie.get(w), i
            while node is not None:
                found.update(node.get(None, ()))
                j += 1
                node = node.get(words[j]) if j < len(words) else None
        return found

    def fold(self, text: str | None) -> str | None:
        if text is None:
            return None
        waiting = sorted(self.places(text), reverse=True)
        while waiting:
            i = waiting.pop()
            _, pattern, canon = self.rules[i]
            text, n = pattern.subn(lambda _, c=canon: c, text)
            if n:
                waiting = sorted((k for k in self.places(text) if k > i), reverse=True)
        return text


def synonym_folder(rules: list[tuple[str, str]]):
    """Arrow UDF over texts that are already upper case and free of accents; equal texts of a batch are folded once."""

    @F.pandas_udf(StringType())
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cascade = Cascade(rules)
        for texts in batches:
            codes, distinct = pd.factorize(texts)
            folded = np.array([cascade.fold(t) for t in distinct] + [None], dtype=object)
            yield pd.Series(folded[codes])

    return fold


def before_fold(df: DataFrame, text: str, out: str) -> DataFrame:
    """Join galvanised profile names, split measures, mask anchor rods.

    Every step that looks at its input more than once reads a column of the step
    before, so the expression tree stays small.
    """
    s = F.coalesce(text, F.lit(""))
    for pattern, repl in SPLIT_MEASURES:
        s = F.regexp_replace(s, pattern, repl)
    df = df.withColumn(out, s)
    masked = F.regexp_replace(out, r"(?iU)\bVARILLAS?\b", MASK)
    df = df.withColumn(out, F.when(F.col(out).rlike(ANCHOR), masked).otherwise(F.col(out)))
    return df.withColumn(out, normalize(F.col(out)))


def after_fold(df: DataFrame, out: str) -> DataFrame:
    """Steel gauges, trailing zeros, bar lengths and the lost Ñ."""
    df = df.withColumn(out, F.replace(F.lower(out), F.lit(MASK.lower()), F.lit("varilla")))
    gauged = F.regexp_replace(out, r"(?U)\be(?=\d)", "e ")
    for pattern, canon in GAUGES:
        gauged = F.regexp_replace(gauged, pattern, canon)
    steel = F.col(out).rlike(r"(?U)\b(?:pgc|pgu|pgo)\b")
    df = df.withColumn(out, F.when(steel, gauged).otherwise(F.col(out)))
    t = F.regexp_replace(out, r"(?U)\b(\d+\.\d*?[1-9])0+\b", "$1")
    df = df.withColumn(out, F.regexp_replace(t, r"(?U)\b(\d+)\.0+\b", "$1"))
    bar = F.regexp_replace(out, r"(?U)(\d)\s*x\s*(?:12(?:\s*(?:m|mt|mts|metros))?|6\s*(?:m|mt|mts|metros))\b", "$1")
    iron = F.contains(F.col(out), F.lit("corrugado")) | F.contains(F.col(out), F.lit("hierro liso"))
    df = df.withColumn(out, F.when(iron, bar).otherwise(F.col(out)))
    return df.withColumn(out, F.replace(F.col(out), F.lit("ñ"), F.lit("n")))


def with_prepared(df: DataFrame, text: str, out: str = "norm", rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Canonical matching text; call it on distinct texts."""
    rules = synonym_rules() if rules is None else rules
    staged = before_fold(df, text, out)
    if rules:
        staged = staged.withColumn(out, synonym_folder(rules)(F.col(out)))
    done = after_fold(staged, out)
    # the outer explode keeps later filters on the text from being pushed down, which would repeat every step for each use
    return done.withColumn(out, F.explode_outer(F.array(out)))


def numbers(prepared: Column) -> Column:
    """Distinct numeric tokens; decimal commas became blanks before."""
    found = F.regexp_extract_all(normalize(prepared), F.lit(r"(?U)\b(\d+(?:[.,]\d+)?)\b"), 1)
    return F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("."))))


def token_set(prepared: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(prepared, " "), lambda t: t != "")))


def number_overlap(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).otherwise(0.0)


def missing_numbers(alias: Column, text: Column) -> Column:
    return F.size(F.array_except(alias, text))


def qualifiers(raw: Column) -> Column:
    up = F.upper(F.coalesce(raw, F.lit("")))
    return F.array_compact(F.array(*[F.when(up.rlike("(?U)" + rx), F.lit(name)) for name, rx in V.QUALIFIERS]))


def keywords_in(text: Column, words=V.KEYWORDS) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def keyword_bonus(a: Column, b: Column, words=V.KEYWORDS, distinctive=V.DISTINCTIVE) -> Column:
    """+4 per keyword on both sides, -6 per distinctive keyword on one side only."""
    ka, kb = keywords_in(a, words), keywords_in(b, words)
    shared = F.array_intersect(ka, kb)
    single = F.array_except(F.array_union(ka, kb), shared)
    strong = F.array(*[F.lit(w) for w in distinctive])
    return 4 * F.size(shared) - 6 * F.size(F.array_intersect(single, strong))


def brand_groups_v1(text: Column, groups=V.BRAND_GROUPS) -> Column:
    """Groups by plain substring, as the first scorer does."""
    hit = [F.when(text.rlike("|".join(g)), F.lit(i)) for i, g in enumerate(groups)]
    return F.array_compact(F.array(*hit))


def with_brand_groups(df: DataFrame, key: str, text: str, brands: DataFrame, out: str) -> DataFrame:
    """Whole-word brand groups of a text, by joining word n-grams with ``brands(marca, grupo)``.

    The n-grams have the lengths that occur among the brands; these few numbers come to the driver.
    """
    words = lambda c: F.filter(F.split(F.regexp_replace(F.upper(c), r"(?U)[^\w]+", " "), " "), lambda t: t != "")
    named = brands.select(F.upper("marca").alias("marca"), "grupo", F.array_join(words(F.col("marca")), " ").alias("gram"))
    lengths = sorted(r[0] for r in named.select(F.size(F.split("gram", " "))).distinct().collect())
    base = df.select(key, text).distinct().withColumn("w", words(F.col(text)))
    spots = F.sequence(F.lit(1), F.size("w"))
    grams = F.flatten(F.transform(spots, lambda i: F.array(*[F.array_join(F.slice("w", i, F.lit(n)), " ") for n in lengths])))
    if not lengths:
        return df.withColumn(out, F.array().cast("array<string>"))
    exploded = base.filter(F.size("w") > 0).select(key, text, F.explode(F.array_distinct(grams)).alias("gram"))
    whole = F.expr(f"upper({text}) rlike concat('(?U)\\\\b\\\\Q', marca, '\\\\E\\\\b')")
    groups = exploded.join(named, "gram").filter(whole).groupBy(key).agg(F.array_sort(F.collect_set("grupo")).alias(out))
    return shuffled(df).join(groups, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def is_junk(raw: Column) -> Column:
    t = F.trim(F.coalesce(raw, F.lit("")))
    return (F.length(t) < 6) | ~has_word(t, 3) | (F.size(F.split(t, r"\$")) >= 3)


def has_word(text: Column, letters: int) -> Column:
    return text.rlike(f"[A-Za-zÁÉÍÓÚÑáéíóúñ]{{{letters},}}")


def match_key(raw: Column) -> Column:
    return F.regexp_replace(F.lower(raw), "[^a-z0-9]", "")


def region(province: Column) -> Column:
    p = F.translate(F.lower(F.trim(F.coalesce(province, F.lit("")))), "áéíóúüñàèìòùâêîôû", "aeiouunaeiouaeiou")
    out = None
    for fragment, name in V.REGIONS:
        hit = F.contains(p, F.lit(fragment))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(V.NO_REGION))


def join_split_letter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\b([A-Z]) ([A-Z]{3,})\b", "$1$2")


def collapse_doubled(line: Column) -> Column:
    """Bold text printed twice: every character of a token doubled."""
    doubled = r"^(?:(.)\1){2,}$"
    return F.array_join(
        F.transform(F.split(line, " "), lambda t: F.when(t.rlike(doubled), F.regexp_replace(t, r"(.)\1", "$1")).otherwise(t)), " ")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def expired(stamp: Column, now: Column) -> Column:
    """Unreadable stamps never expire."""
    return F.coalesce(F.try_to_timestamp(stamp) < now, F.lit(False))
