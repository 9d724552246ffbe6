"""Near duplicates by SimHash with meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2h bits have a common variant among those that differ from each in at most h bits.
With an odd radius of 2h + 1 one of some blocks of bits is left out at a time: a pair differs in some block, and without
that block in at most 2h bits. So every fingerprint emits, for each block left out, all variants within half the radius,
and fingerprints that share a variant are compared. Nothing is lost, and no other pair meets more often than by chance.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrow_rows import with_text_columns
from .components import connected_components
from .ngramjoin import roots_of, signed, whole_groups
from .ship import ship
from .textarrays import chunks
from .work import stored

BITS = 64
BLOCK_BYTES = 1 << 20
HASHES_AT_ONCE = 1 << 16
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(data: bytes):
    """Lists of the words of `data`, each from about BLOCK_BYTES bytes, so that a very long text is never split at once."""
    at = 0
    while at < len(data):
        end = at + BLOCK_BYTES
        gap = SPACE.search(data, end) if end < len(data) else None
        end = gap.start() if gap else len(data)
        yield data[at:end].split()
        at = end


def hash_blocks(text: str, width: int, seed: int):
    """Arrays of the shingles' 64-bit hashes; a text of fewer words is one shingle of all its words, no word gives none."""
    digest = xxhash.xxh64_intdigest
    carry, any_full = [], False
    for words in word_blocks(text.encode("utf-8", "surrogatepass").lower()):  # bytes: A-Z only
        words = carry + words
        if len(words) >= width:
            any_full = True
            yield np.array([digest(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(width)), strict=False)], np.uint64)
        carry = words[len(words) - width + 1 :] if len(words) >= width else words
    if not any_full and carry:
        yield np.array([digest(b" ".join(carry), seed)], np.uint64)


def fingerprints(part: list[str], width: int, seed: int) -> np.ndarray:
    """Fingerprint of each text: a bit is 1 if it is set in over half the hashes; 0 for a text without words."""
    ones, total = np.zeros((len(part), BITS), np.int64), np.zeros(len(part), np.int64)
    held, owner, size = [], [], 0

    def count():
        flat, text = np.concatenate(held), np.repeat(owner, [len(h) for h in held])
        bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.diff(text, prepend=-1))
        ones[text[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        total[text[first]] += np.diff(first, append=len(text))

    for i, t in enumerate(part):
        for h in hash_blocks(t, width, seed):
            held.append(h)
            owner.append(i)
            size += len(h)
            if size >= HASHES_AT_ONCE:
                count()
                held, owner, size = [], [], 0
    if held:
        count()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def ball(kept: list[int], radius: int) -> np.ndarray:
    """Masks of at most `radius` of the bits `kept`."""
    masks = [sum(1 << b for b in some) for r in range(radius + 1) for some in itertools.combinations(kept, r)]
    return np.array(masks, np.uint64)


def variants(prints: np.ndarray, radius: int, blocks: int) -> np.ndarray:
    """Variants [print, variant] within half the radius.

    With an odd radius each of `blocks` blocks of bits is left out in turn; the block's number stands in its bits.
    """
    if radius % 2 == 0:
        return prints[:, None] ^ ball(list(range(BITS)), radius // 2)[None, :]
    out, edges = [], [BITS * b // blocks for b in range(blocks + 1)]
    for b, (lo, hi) in enumerate(itertools.pairwise(edges)):
        without = np.uint64(((1 << BITS) - 1) ^ (((1 << (hi - lo)) - 1) << lo))
        masks = ball([*range(lo), *range(hi, BITS)], radius // 2)
        mark = np.uint64((b & ((1 << (hi - lo)) - 1)) << lo)
        out.append((prints & without)[:, None] ^ masks[None, :] | mark)
    return np.concatenate(out, axis=1)


def near_edges(prints: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """Distinct edges (u, v) that connect what the links of at most `radius` differing bits connect.

    `prints` has distinct longs `fp`. Fingerprints of one variant are compared whole; of the pairs verified there a star
    for each component goes on, so a dense group gives no pair for each link.
    """
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 1024):
                some = fps[at : at + 1024]
                v = variants(some, radius, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(signed(v.ravel())), pa.array(signed(np.repeat(some, v.shape[1])))], names=["variant", "fp"])

    def meet(batches):
        for table in whole_groups(batches, 1, limit=1 << 18):
            variant, fp = table.column("variant").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
            at, step, a, b = np.arange(len(fp) - 1), 1, [], []
            while len(at):  # partners 1, 2 ... places on in the same run
                at = at[at + step < len(fp)]
                at = at[variant[at] == variant[at + step]]
                near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
                a.append(near)
                b.append(near + step)
                step += 1
            a, b = np.concatenate(a or [np.zeros(0, np.int64)]), np.concatenate(b or [np.zeros(0, np.int64)])
            if len(a):
                root = roots_of(len(fp), a, b)
                off = np.flatnonzero(root != np.arange(len(root)))
                edges = np.unique(np.stack([signed(fp[off]), signed(fp[root[off]])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], names=["u", "v"])

    met = prints.select("fp").mapInArrow(emit, "variant long, fp long").repartition(parts, "variant").sortWithinPartitions("variant", "fp")
    return met.mapInArrow(meet, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3, blocks: int = 4, seed: int = 42) -> DataFrame:
    """(key, fp, component_id) for each row: the SimHash as a long and the smallest key that links lead to.

    The text is lower-cased in A-Z only; words are runs without ASCII white space; shingles of `width` words count as often
    as they occur and are hashed with XXH64. Two fingerprints link at `radius` or fewer differing bits, equal ones too. A
    null text counts as empty; texts without words have fingerprint 0 and are linked like any other. Rows with repeated keys
    are each judged on their own; a null key is never the smallest unless all of the component are null. Other columns of
    `docs` are not read, so their names can't clash. An empty table gives an empty result.

    Texts of equal fingerprints collapse before anything is emitted; the variants' shuffle grows with the number of distinct
    fingerprints, and components are contracted in rounds (see `connected_components`).
    """
    ship(docs.sparkSession)

    def make():
        def work(texts):
            return {"fp": np.concatenate([fingerprints(part, width, seed) for _, part in chunks(texts)] or [np.zeros(0, np.uint64)]).view(np.int64)}

        return work

    slim = docs.select(F.col(key).alias("__key"), F.col(text).alias("__t"))
    rows = stored(with_text_columns(slim, "__t", StructType([StructField("fp", LongType())]), make, ["__key"]), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("__key").alias("first")), "prints")
    classes = connected_components(near_edges(prints, radius, blocks)).withColumnRenamed("node", "fp")
    named = prints.join(classes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = named.groupBy("root").agg(F.min("first").alias("component_id"))
    found = named.join(heads, "root").select("fp", "component_id")
    return rows.join(found, "fp", "left").select(F.col("__key").alias(key), "fp", "component_id")


def hex_digits(fp: str):
    """The column of longs as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))
