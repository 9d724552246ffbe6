"""Cross-tokenizer alignment: byte spans of two tokenizers' tokens over the same text.

A batch of texts becomes two frames of token starts, keyed by document. `merge_asof` gives for each token start the other
side's covering token; the union of both directions is all overlapping pairs, and byte offsets where tokens of both sides
end cut a text into groups. How often two ids overlap in the whole corpus is a Spark aggregation.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .bpe import byte_symbols
from .ship import ship
from .textarrays import chunks
from .work import stored

# a group of rows has about as many characters, or one longer text, and at most so many rows
GROUP_CHARS, GROUP_ROWS = 4_000_000, 512
SHIFT = 32  # an id pair is a << SHIFT | b
# fixed value: the pattern that splits text in files of this kind
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def byte_level(path: str):
    """(text to ids, bytes by id) of a byte-level BPE file whose pieces follow PIECES.

    The file's vocabulary in order of ids is its merge ranks, so tiktoken gives the same ids as the tokenizers library, and
    three times as fast; strings of special tokens are plain text.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["content"] for t in file["added_tokens"]}
    byte_of = {c: i for i, c in enumerate(byte_symbols())}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in file["model"]["vocab"].items() if piece not in special}
    known = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        known[i] = piece
    return tiktoken.Encoding("byte-level", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, known


@functools.cache
def pieces(path: str):
    """(texts to ids, bytes by id) of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        known.append(bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return functools.partial(model.encode, num_threads=1), known


class Sides:
    """Both tokenizers with the length and the printed forms of each id, made once in a task."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        self.a_ids, self.a_bytes = byte_level(a_path)
        self.b_ids, self.b_bytes = pieces(b_path)
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        # what an id adds to the printed groups: inside a group, or at its end
        self.printed = [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for end in ends]

    def encode(self, part: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where a text is empty or either side's bytes are not the space and the text."""
        a = [self.a_ids(" " + t) if t else [] for t in part]
        b = self.b_ids(part)
        for i, t in enumerate(part):
            whole = (" " + t).encode()
            if not t or b"".join(map(self.a_bytes.__getitem__, a[i])) != whole or b"".join(map(self.b_bytes.__getitem__, b[i])) != whole:
                a[i], b[i] = [], []
        return a, b


class Aligned:
    """The tokens of some texts as flat arrays, side by side, with their links and groups."""

    def __init__(self, sides: Sides, part: list[str]):
        a, b = sides.encode(part)
        self.a_count, self.b_count = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        self.a_id, self.b_id = (np.array([i for x in side for i in x], np.int64) for side in (a, b))
        doc = np.arange(len(part))
        self.a_doc, self.b_doc = np.repeat(doc, self.a_count), np.repeat(doc, self.b_count)
        # both sides have the same bytes, so offsets over all texts agree
        self.a_end, self.b_end = np.cumsum(sides.a_len[self.a_id]), np.cumsum(sides.b_len[self.b_id])
        left = pd.DataFrame({"at": self.a_end - sides.a_len[self.a_id], "doc": self.a_doc, "a": np.arange(len(self.a_id))})
        right = pd.DataFrame({"at": self.b_end - sides.b_len[self.b_id], "doc": self.b_doc, "b": np.arange(len(self.b_id))})
        by_a = pd.merge_asof(left, right, on="at", by="doc")
        by_b = pd.merge_asof(right, left, on="at", by="doc")
        # tokens that start together are found from both sides
        again = left["at"].to_numpy()[by_b["a"].to_numpy()] == by_b["at"].to_numpy()
        self.links = np.stack([np.concatenate([by_a[c].to_numpy(), by_b[c].to_numpy()[~again]]).astype(np.int64) for c in ("a", "b")])
        self.a_cut, self.b_cut = np.isin(self.a_end, self.b_end), np.isin(self.b_end, self.a_end)
        self.a_group, self.b_group = (np.cumsum(cut) - cut for cut in (self.a_cut, self.b_cut))
        self.n_groups = np.bincount(self.a_doc[self.a_cut], minlength=len(part))
        self.n_links = np.bincount(self.a_doc[self.links[0]], minlength=len(part))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(id pair, text) of each link."""
        return self.a_id[self.links[0]] << SHIFT | self.b_id[self.links[1]], self.a_doc[self.links[0]]

    def printed(self, sides: Sides) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text."""
        order = np.argsort(np.concatenate([2 * self.a_group, 2 * self.b_group + 1]), kind="stable")
        codes = np.concatenate([2 * self.a_id + self.a_cut, 2 * (len(sides.a_bytes) + self.b_id) + self.b_cut])[order].tolist()
        ends = np.cumsum(self.a_count + self.b_count).tolist()
        return ["".join(map(sides.printed.__getitem__, codes[x:y]))[:-1] for x, y in zip([0, *ends], ends, strict=False)]

    def grouped(self) -> list[list[dict]]:
        """The groups of each text: {a: ids, b: ids}."""
        out: list[list[dict]] = [[] for _ in self.a_count]
        a_to, b_to = np.flatnonzero(self.a_cut) + 1, np.flatnonzero(self.b_cut) + 1
        a_at = b_at = 0
        for x, y, doc in zip(a_to.tolist(), b_to.tolist(), self.a_doc[self.a_cut].tolist(), strict=True):
            out[doc].append({"a": self.a_id[a_at:x].tolist(), "b": self.b_id[b_at:y].tolist()})
            a_at, b_at = x, y
        return out


GROUP = StructType([StructField("a", ArrayType(IntegerType(), False)), StructField("b", ArrayType(IntegerType(), False))])
INNER = StructType([
    StructField("__group", LongType()), StructField("n_a", LongType()), StructField("n_b", LongType()), StructField("n_groups", LongType()),
    StructField("n_links", LongType()), StructField("groups_sha256", StringType()), StructField("groups", ArrayType(GROUP, False)),
    StructField("__places", BinaryType()), StructField("__times", BinaryType()), StructField("__pairs", BinaryType()), StructField("__totals", BinaryType())])

def tokenized(docs: DataFrame, text: str, names: list[str], paths: tuple[str, str], with_groups: bool) -> DataFrame:
    """`names` and INNER. Rows go through in groups of a bounded number of characters, or one longer text.

    A group's first row holds its distinct id pairs (`__pairs`, sorted) and their numbers of links; every row holds the places
    of its pairs in that list.
    """
    ship(docs.sparkSession)
    source = docs.select(*names, F.col(text).cast("string").alias("__text"))
    out = StructType([source.schema[c] for c in names] + list(INNER))
    arrow = to_arrow_schema(out)

    def cuts(texts: list):
        at, size = 0, 0
        for i, t in enumerate(texts):
            if i > at and (i - at >= GROUP_ROWS or size + len(t or "") > GROUP_CHARS):
                yield at, i
                at, size = i, 0
            size += len(t or "")
        if at < len(texts):
            yield at, len(texts)

    def run(batches):
        sides = Sides(*paths)
        group = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            for lo, hi in cuts(texts):
                cols: dict[str, list] = {f.name: [] for f in INNER}
                pair, doc = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for base, part in chunks(texts[lo:hi]):
                    x = Aligned(sides, part)
                    for name, values in (("n_a", x.a_count), ("n_b", x.b_count), ("n_groups", x.n_groups), ("n_links", x.n_links)):
                        cols[name] += values.tolist()
                    cols["groups_sha256"] += [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in x.printed(sides)]
                    cols["groups"] += x.grouped() if with_groups else [None] * len(part)
                    p, d = x.pairs()
                    pair.append(p)
                    doc.append(d + base)
                pairs, place, totals = np.unique(np.concatenate(pair), return_inverse=True, return_counts=True)
                held, times = np.unique(np.concatenate(doc) << SHIFT | place, return_counts=True)
                ends = np.searchsorted(held >> SHIFT, np.arange(hi - lo + 1)).tolist()
                places, times = (held & ((1 << SHIFT) - 1)).astype(np.uint32), times.astype(np.uint32)
                cols["__group"] = [group] * (hi - lo)
                cols["__places"] = [places[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)]
                cols["__times"] = [times[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)]
                cols["__pairs"] = [pairs.tobytes()] + [None] * (hi - lo - 1)
                cols["__totals"] = [totals.astype(np.int64).tobytes()] + [None] * (hi - lo - 1)
                group += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo).cast(arrow.field(i).type) for i in range(len(names))]
                    + [pa.array(cols[f.name], arrow.field(f.name).type) for f in INNER], schema=arrow)

    return source.mapInArrow(run, out)


def group_pairs(rows: DataFrame) -> DataFrame:
    """(group, pair, n): the links of each id pair in each group."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                pairs, totals = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0)[i].as_py(), len(pairs)), pa.int64()), pa.array(pairs), pa.array(totals)],
                                                 names=["group", "pair", "n"])

    return rows.where("__pairs IS NOT NULL").select("__group", "__pairs", "__totals").mapInArrow(run, "group long, pair long, n long")


def pair_counts(by_group: DataFrame) -> DataFrame:
    """(pair, links, best): an id pair's links in the whole corpus, and whether its B id has no pair of more; ties are all best."""
    total = stored(by_group.groupBy("pair").agg(F.sum("n").alias("links")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    top = total.groupBy(b.alias("__b")).agg(F.max("links").alias("__top"))
    return total.join(top, b == F.col("__b")).select("pair", "links", (F.col("links") == F.col("__top")).alias("best"))


def with_counts(rows: DataFrame, answers: DataFrame, names: list[str]) -> DataFrame:
    """`rows` of `tokenized` with n_best and count_sum; `answers` has the (links, best) of every pair of each group."""
    columns = [*names, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    out = StructType([rows.schema[c] for c in columns] + [StructField("n_best", LongType()), StructField("count_sum", LongType())])
    arrow = to_arrow_schema(out)

    def run(mine: pa.Table, counts: pa.Table) -> pa.Table:
        counts = counts.sort_by("pair")
        links, best = counts.column("links").to_numpy(), counts.column("best").to_numpy().astype(np.int64)
        n_best, total = [], []
        for x, y in zip(mine.column("__places").to_pylist(), mine.column("__times").to_pylist(), strict=True):
            at, times = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32).astype(np.int64)
            n_best.append(int((best[at] * times).sum()))
            total.append(int((links[at] * times).sum()))
        kept = [mine.column(c).cast(arrow.field(c).type) for c in columns]
        return pa.Table.from_arrays([*kept, pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], schema=arrow)

    mine = rows.drop("__pairs", "__totals").groupBy("__group")
    return mine.cogroup(answers.select("__group", "pair", "links", "best").groupBy("__group")).applyInArrow(run, out)


def align_tokens(docs: DataFrame, text: str = "text", paths: tuple[str, str] | None = None, keep: list[str] | None = None, with_groups: bool = True) -> DataFrame:
    """`docs` (columns in `keep`, default all) with n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and `groups`.

    Side A is a byte-level BPE file over a space and the text, side B a sentencepiece model over the text. `groups` has the ids of both
    sides between shared token ends; it is null without `with_groups`. A link is a pair of tokens whose bytes overlap; its count is
    the number of links of its two ids in all texts; n_best counts links whose count is the highest of their B id. Null and empty
    texts, and those that either side does not reproduce byte by byte, have zeros, no groups and an empty digest. Repeated rows
    each count. New columns replace those of the same name. An empty table gives an empty result.

    Counts go to the rows that need them by group of rows, not by row: the join's size is the number of distinct pairs of
    each group, and a group is bounded by GROUP_CHARS or one longer text.
    """
    made = {f.name for f in INNER} | {"n_best", "count_sum"}
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    rows = stored(tokenized(docs, text, names, paths or default_tokenizers(), with_groups), "aligned")
    by_group = stored(group_pairs(rows), "group-pairs")
    answers = by_group.select(F.col("group").alias("__group"), "pair").join(pair_counts(by_group), "pair")
    return with_counts(rows, answers, names)
