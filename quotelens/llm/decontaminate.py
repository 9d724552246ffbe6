"""Benchmark decontamination by spaced seeds.

A mask selects some positions of a short window of tokens and ignores the others, so a window with substituted tokens at
ignored positions keeps its hash. Hashes of test items and of training texts are joined, and around each hit the longest
overlap that tolerates substitutions is verified token by token. With the four masks below every passage of 14 tokens with
2 substitutions, 20 with 3 or 24 with 4 is hit.

One pass over the texts, whatever the number of items, keeps the hashes that pass a filter of fixed size; these meet the
items' hashes in a shuffle join. Only texts with a common hash are read again, each distinct text once, and a pair of text and
item is verified once a diagonal on the tokens that face each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from .arrow_rows import slices, with_text_columns
from .ship import ship
from .textarrays import STEP, chunks, hashed_words, mix
from .work import stored

MASKS = ("1001111011", "1101010111", "1110010111", "1111111")
FILTER_BITS = 24
# rows of one value that a join leaves together
HEAVY = 10_000

SEED = StructType([StructField("h", LongType(), False), StructField("place", IntegerType(), False)])
OVERLAP = StructType([StructField("item", LongType()), StructField("begin", IntegerType()), StructField("end", IntegerType()),
                      StructField("n_match", IntegerType()), StructField("identity", DoubleType())])


def offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def spaced_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash at each position where the mask fits into the array."""
    n = len(words) - len(mask) + 1
    out = np.full(max(n, 0), len(mask) * 31 + int(mask, 2), np.uint64)
    for k in offsets(mask):
        out = out * np.uint64(STEP) + words[k : k + len(out)]
    return mix(out)


def placed_hashes(words: np.ndarray, text_of: np.ndarray, masks: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(mask, positions, hashes there) of each mask; windows stay in one text."""
    for mask in masks:
        h = spaced_hashes(words, mask)
        at = np.flatnonzero(text_of[: len(h)] == text_of[len(mask) - 1 :]) if len(h) else np.zeros(0, np.int64)
        yield mask, at, h[at]


def by_text(at: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """The seeds of each text, by place."""
    order = np.argsort(at, kind="stable")
    at, hashes = at[order], hashes[order].view(np.int64)
    cut = np.searchsorted(at, first)
    return [[{"h": h, "place": p} for h, p in zip(hashes[a:b].tolist(), (at[a:b] - f).tolist(), strict=True)]
            for a, b, f in zip(cut[:-1], cut[1:], first[:-1], strict=True)]


def coded_items(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(item_text, words, n_item, seeds) of each distinct text: digest, word hashes as bytes, their number, seeds.

    An item shorter than the longest mask is also hashed as a whole, by a mask of its own length.
    """
    longest = max(map(len, masks))

    def make():
        def work(texts):
            seeds, coded, sizes = [], [], []
            for _, part in chunks(texts):
                words, _, _, first = hashed_words(part)
                lengths = np.diff(first)
                text_of = np.repeat(np.arange(len(part)), lengths)
                own = ["1" * n for n in sorted({int(n) for n in lengths if 0 < n < longest})]
                found = list(placed_hashes(words, text_of, list(masks)))
                for mask, at, h in placed_hashes(words, text_of, own):  # only items of this length
                    whole = lengths[text_of[at]] == len(mask)
                    found.append((mask, at[whole], h[whole]))
                seeds += by_text(np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found]), first)
                coded += [words[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                sizes += lengths.tolist()
            return {"item_words": coded, "n_item": sizes, "seeds": seeds}

        return work

    texts = items.select("t").distinct().withColumn("item_text", F.md5("t"))
    schema = StructType([StructField("item_words", BinaryType()), StructField("n_item", IntegerType()), StructField("seeds", ArrayType(SEED, False))])
    return with_text_columns(texts, "t", schema, make, keep=["item_text"])


def seed_filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """Two bits for each hash, at its first and at its next `bits` binary digits: 2 ** (bits - 3) bytes at any number of seeds."""
    digits = (1 << bits) - 1
    at = F.explode(F.array(*[F.shiftrightunsigned("h", 64 - k * bits).bitwiseAND(F.lit(digits).cast("long")) for k in (1, 2)])).alias("at")
    one = F.expr("shiftleft(1L, int(at & 63))")
    rows = seeds.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("mask")).collect()  # at most 2 ** (bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.int64)
    out[[r.word for r in rows]] = [r["mask"] for r in rows]
    return out.view(np.uint64)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes of which both bits are set; a hash of no seed passes as often as the square of the set share."""
    width = int(math.log2(len(bits))) + 6
    at = np.arange(len(hashes))
    for k in (1, 2):
        digits = (hashes[at] >> np.uint64(64 - k * width)) & np.uint64((1 << width) - 1)
        at = at[(bits[digits >> np.uint64(6)] >> (digits & np.uint64(63))) & np.uint64(1) == 1]
    return at


def with_hits(docs: DataFrame, columns: list[str], text: str, masks: list[str], passed: np.ndarray) -> DataFrame:
    """`columns` of `docs`, the whole text, the seeds of it that pass the filter and, where there are any, the text's digest."""
    shared = docs.sparkSession.sparkContext.broadcast(passed)  # of fixed size

    def make():
        bits = shared.value

        def work(texts):
            out = []
            for _, part in chunks(texts):
                words, _, _, first = hashed_words(part)
                places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for _, at, h in placed_hashes(words, np.repeat(np.arange(len(part)), np.diff(first)), masks):
                    ok = passes(bits, h)
                    places.append(at[ok])
                    hashes.append(h[ok])
                out += by_text(np.concatenate(places), np.concatenate(hashes), first)
            return {"__hits": out}

        return work

    whole = docs.select(*columns, F.col(text).cast("string").alias("__whole"))
    marked = with_text_columns(whole, "__whole", StructType([StructField("__hits", ArrayType(SEED, False))]), make)
    return marked.withColumn("__text_id", F.when(F.size("__hits") > 0, F.md5("__whole")))


def spread_join(many: DataFrame, few: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """`many` joined with `few` on the column `on`.

    A value with over HEAVY rows in `many` is dealt over as many parts as needed, and its rows of `few` go to each part.
    """
    heavy = many.groupBy(on).agg(F.count("*").alias("__n")).where(F.col("__n") > HEAVY)
    heavy = heavy.select(on, F.ceil(F.col("__n") / HEAVY).cast("int").alias("__parts"))
    parts = F.coalesce(F.col("__parts"), F.lit(1))
    plain = [f.name for f in many.schema if f.name != "__whole" and isinstance(f.dataType, AtomicType)]
    left = many.join(heavy, on, "left").withColumn("__part", F.pmod(F.xxhash64(*plain), parts).cast("int")).drop("__parts")
    right = few.join(heavy, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [on, "__part"], how).drop("__part")


def best_overlap(same: np.ndarray, mismatch: int) -> tuple[int, int]:
    """Begin and end of the stretch with the highest sum, a match counting 1 and a substitution -mismatch."""
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -mismatch))])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    begin = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
    return begin, end


def equal_stretch(same: np.ndarray, need: int, share: Fraction) -> tuple[int, int] | None:
    """Begin and end of the stretch with the most equal tokens of those of which `share` is equal, or None if it has fewer than `need`."""
    equal = np.concatenate([[0], np.cumsum(same)])
    gain = equal * share.denominator - np.arange(len(equal)) * share.numerator
    # a stretch holds the share where its gain doesn't fall; the latest such end of each begin has the most equal tokens
    later = np.maximum.accumulate(gain[::-1])
    ends = len(gain) - 1 - np.searchsorted(later, gain, "left")
    begin = int(np.argmax(equal[ends] - equal))
    inner = np.flatnonzero(same[begin : ends[begin]])
    return (begin + int(inner[0]), begin + int(inner[-1]) + 1) if len(inner) >= max(need, 1) else None


def overlap(same: np.ndarray, need: int, share: Fraction, mismatch: int) -> tuple[int, int] | None:
    """The stretch with the highest sum where that one counts, else any that counts, else None."""
    if same.sum() < need:
        return None
    begin, end = best_overlap(same, mismatch)
    match = int(same[begin:end].sum())
    if match >= max(need, 1) and match * share.denominator >= (end - begin) * share.numerator:
        return begin, end
    return equal_stretch(same, need, share)


def needed(length: int, min_match: int, share: Fraction) -> int:
    """Equal tokens that an overlap with an item of this length must have."""
    return min(min_match, math.ceil(share * length))


def text_overlaps(marked: DataFrame, coded: DataFrame, min_match: int, min_identity: float, mismatch: int) -> DataFrame:
    """(__text_id, item_text, n_match, begin, end, identity): the best overlap of each distinct text and item text."""
    loud = marked.where(F.col("__text_id").isNotNull())
    here = loud.groupBy("__text_id").agg(F.any_value("__hits").alias("hits")).select("__text_id", F.inline("hits"))
    there = coded.select("item_text", F.explode("seeds").alias("s")).select("item_text", F.col("s.h").alias("h"), F.col("s.place").alias("item_place"))
    met = spread_join(here, there, "h")
    pairs = stored(met.select("__text_id", "item_text", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct(), "leak-pairs")

    def codes():
        def work(texts):
            out = []
            for _, part in chunks(texts):
                words, _, _, first = hashed_words(part)
                out += [words[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            return {"words": out}

        return work

    wanted = loud.join(pairs.select("__text_id").distinct(), "__text_id", "left_semi").groupBy("__text_id").agg(F.any_value("__whole").alias("t"))
    words = stored(with_text_columns(wanted, "t", StructType([StructField("words", BinaryType())]), codes, keep=["__text_id"]), "leak-texts")
    sizes = coded.select("item_text", "n_item")
    faced = (spread_join(spread_join(pairs, sizes, "item_text"), words, "__text_id")
             .withColumns({"b": F.greatest("diagonal", F.lit(0)), "i": F.greatest(-F.col("diagonal"), F.lit(0))})
             .withColumn("n", F.least(F.expr("length(words) div 8") - F.col("b"), F.col("n_item") - F.col("i")).cast("int"))
             .select("__text_id", "item_text", "n_item", "b", "i", "n", F.expr("substring(words, 8 * b + 1, 8 * n)").alias("mine")))
    facing = spread_join(faced, coded.select("item_text", "item_words"), "item_text").select(
        "__text_id", "item_text", "n_item", "b", "mine", F.expr("substring(item_words, 8 * i + 1, 8 * n)").alias("theirs"))
    ship(marked.sparkSession)
    share = Fraction(min_identity).limit_denominator(1000)
    names = ["__text_id", "item_text", "n_match", "begin", "end", "identity"]

    def verify(batches):
        for batch in batches:
            for rows in slices([batch]):
                out = []
                for text, item, n_item, b, mine, theirs in zip(*[c.to_pylist() for c in rows.columns], strict=True):
                    same = np.frombuffer(mine, np.uint64) == np.frombuffer(theirs, np.uint64)
                    stretch = overlap(same, needed(n_item, min_match, share), share, mismatch)
                    if stretch:
                        match = int(same[stretch[0] : stretch[1]].sum())
                        out.append((text, item, match, b + stretch[0], b + stretch[1], match / (stretch[1] - stretch[0])))
                types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    found = facing.mapInArrow(verify, "__text_id string, item_text string, n_match int, begin int, end int, identity double")
    best = F.max(F.struct("n_match", (-F.col("begin")).alias("minus"), "end", "identity")).alias("o")
    return found.groupBy("__text_id", "item_text").agg(best).select(
        "__text_id", "item_text", "o.n_match", (-F.col("o.minus")).alias("begin"), "o.end", "o.identity")


def _searched(docs: DataFrame, items: DataFrame, columns: list[str], text: str, item_text: str, item_key: str, masks: tuple[str, ...],
              min_match: int, min_identity: float, mismatch: int, filter_bits: int, quiet: bool) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` with their hits (those without any only if `quiet`), and each overlap of a distinct text with an item's key."""
    known = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).cast("long").alias("item"), F.col(item_text).cast("string").alias("t"))
    coded = stored(coded_items(known, masks), "leak-items")
    short = coded.where(F.col("n_item").between(1, max(map(len, masks)) - 1)).select("n_item").distinct().orderBy("n_item").collect()
    passed = seed_filter(coded.select(F.inline("seeds")), filter_bits)
    marked = with_hits(docs, columns, text, [*masks, *["1" * r.n_item for r in short]], passed)
    marked = stored(marked if quiet else marked.where(F.size("__hits") > 0), "leak-hits")
    found = text_overlaps(marked, coded, min_match, min_identity, mismatch)
    return marked, stored(found.join(known.select("item", F.md5("t").alias("item_text")), "item_text").drop("item_text"), "leaks")


def with_overlaps(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id",
                  masks: tuple[str, ...] = MASKS, min_match: int = 12, min_identity: float = 0.8, mismatch: int = 3,
                  filter_bits: int = FILTER_BITS, keep: list[str] | None = None, name: str = "overlaps") -> DataFrame:
    """`docs` (its columns in `keep`, default all) with the column `name`: (item, begin, end, n_match, identity), the best one of each item.

    begin and end are token places in the text. An overlap counts when it has `min_match` equal tokens, or `min_identity` of
    the item's tokens if these are fewer, and a share of `min_identity` of its own tokens is equal; on a hit diagonal any
    stretch may be it. Items shorter than the longest mask are found where a mask hits them or they are equal as a whole. Tokens are lower-cased runs of letters and
    digits, so case and punctuation don't matter. Null, empty and very short texts and items have no overlap. Rows with
    null or repeated keys are each judged on their own, items with equal texts are each found, and a column of that
    name is replaced. What is sent to the tasks is a filter of 2 ** (filter_bits - 3) bytes (filter_bits from 6 to 32); texts without a hash in it
    aren't shuffled, and a fuller filter only lets more hashes into the join.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if c != name]
    marked, found = _searched(docs, items, columns, text, item_text, item_key, masks, min_match, min_identity, mismatch, filter_bits, True)
    lists = found.groupBy("__text_id").agg(F.array_sort(F.collect_list(F.struct(*[f.name for f in OVERLAP]))).alias(name))
    none = F.array().cast(ArrayType(OVERLAP))
    loud = spread_join(marked.where(F.col("__text_id").isNotNull()), lists, "__text_id", "left").withColumn(name, F.coalesce(name, none))
    quiet = marked.where(F.col("__text_id").isNull()).withColumn(name, none)
    return quiet.select(*columns, name).unionByName(loud.select(*columns, name))


def find_overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", item_text: str = "text",
                  masks: tuple[str, ...] = MASKS, min_match: int = 12, min_identity: float = 0.8, mismatch: int = 3,
                  filter_bits: int = FILTER_BITS) -> DataFrame:
    """(key, item key, begin, end, n_match, identity), a row for each overlap of `with_overlaps`."""
    marked, found = _searched(docs, items, [key], text, item_text, item_key, masks, min_match, min_identity, mismatch, filter_bits, False)
    rows = spread_join(marked.select(key, "__text_id"), found, "__text_id")
    return rows.select(key, F.col("item").alias(item_key), "begin", "end", "n_match", "identity")


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id",
                    masks: tuple[str, ...] = MASKS, min_match: int = 12, min_identity: float = 0.8, mismatch: int = 3,
                    filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of `docs` without an overlap, with all their columns. Null and empty texts stay."""
    marked, found = _searched(docs, items, docs.columns, text, item_text, item_key, masks, min_match, min_identity, mismatch, filter_bits, True)
    leaks = found.select("__text_id").distinct().withColumn("__leak", F.lit(True))
    loud = spread_join(marked.where(F.col("__text_id").isNotNull()), leaks, "__text_id", "left").where(F.col("__leak").isNull())
    return marked.where(F.col("__text_id").isNull()).select(*docs.columns).unionByName(loud.select(*docs.columns))
