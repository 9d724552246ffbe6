"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles; equal sets form one node. Nodes that share a band of MinHash values meet, their
MinHash values are compared step by step, and a pair is dropped as soon as the posterior probability that its similarity
reaches the threshold falls below a tolerance. What is left is verified exactly on the shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .arrow_rows import with_text_columns
from .components import connected_components
from .ship import ship
from .textarrays import STEP, chunks, hashed_words, mix
from .work import stored

HASHES, ROWS_A_BAND = 128, 4
COMPARE = 16  # MinHash values compared in one step
CELL = 128  # about as many nodes in one block
CELL_SHINGLES = 500_000  # about as many shingles in one block
PAIRS = 1_000_000  # pairs compared at once


def min_matches(threshold: float, tolerance: float) -> list[int]:
    """Least number of equal values among the first COMPARE, 2 * COMPARE ... for a pair to stay.

    With m of n values equal and a uniform prior the similarity has a Beta(m + 1, n - m + 1) posterior; its tail above the
    threshold is a sum of binomial terms.
    """
    def tail(m: int, n: int) -> float:
        return sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return [next(m for m in range(n + 2) if m > n or tail(m, n) >= tolerance) for n in range(COMPARE, HASHES + 1, COMPARE)]


def shingle_sets(part: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts and where each text's begin; a shorter text is one shingle of all its words."""
    words, _, _, first = hashed_words(part)
    lengths = np.diff(first)
    step = np.uint64(STEP)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * step + words[k : k + len(rolled)]
    rolled = mix(rolled ^ np.uint64(width))
    sets = []
    for i, n in enumerate(lengths.tolist()):
        a = int(first[i])
        if n >= width:
            sets.append(np.unique(rolled[a : a + n - width + 1]))
        elif n:
            value = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in words[a : a + n]:
                    value = value * step + w
            sets.append(mix(np.array([value], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    begin = np.zeros(len(part) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=begin[1:])
    return np.concatenate(sets), begin


_draw = np.random.default_rng(20240229)
MULTIPLY = _draw.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _draw.integers(0, 2**63, HASHES, dtype=np.uint64)


def min_hashes(shingles: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """MinHash values [set, HASHES] of the non-empty sets."""
    out = np.empty((len(begin) - 1, HASHES), np.uint64)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat(shingles * MULTIPLY[j] + ADD[j], begin[:-1])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def features(docs: DataFrame, text: str, width: int) -> DataFrame:
    """(key, mark, node, n, sig, buckets): hash of the shingle set, its size, MinHash values (16 bits each) and bands.

    A text without words has a null node.
    """
    schema = StructType([StructField("node", LongType()), StructField("n", IntegerType()), StructField("sig", BinaryType()),
                         StructField("buckets", ArrayType(LongType(), False))])

    def make():
        def work(texts):
            out = {"node": [], "n": [], "sig": [], "buckets": []}
            for _, part in chunks(texts):
                shingles, begin = shingle_sets(part, width)
                sizes = np.diff(begin)
                filled = np.flatnonzero(sizes)
                node, sig, buckets = [None] * len(part), [None] * len(part), [None] * len(part)
                if len(filled):
                    starts = np.append(begin[:-1][filled], begin[-1])
                    sums = np.add.reduceat(mix(shingles), starts[:-1])
                    nodes = signed(mix(sums ^ mix(sizes[filled].astype(np.uint64)))).tolist()
                    hashes = min_hashes(shingles, starts)
                    short = (hashes >> np.uint64(48)).astype(np.uint16)
                    bands = np.zeros((len(filled), HASHES // ROWS_A_BAND), np.uint64) + np.arange(HASHES // ROWS_A_BAND, dtype=np.uint64)
                    for k in range(ROWS_A_BAND):
                        bands = mix(bands) + hashes[:, k::ROWS_A_BAND]
                    bands = signed(mix(bands)).tolist()
                    for at, i in enumerate(filled.tolist()):
                        node[i], sig[i], buckets[i] = nodes[at], short[at].tobytes(), bands[at]
                out["node"] += node
                out["n"] += sizes.tolist()
                out["sig"] += sig
                out["buckets"] += buckets
            return out

        return work

    return with_text_columns(docs, text, schema, make, [c for c in docs.columns if c != text])


def in_cells(rows: DataFrame, group: str, blocks: str) -> DataFrame:
    """Copies each row to the cells (group, i, j), i <= j, of its block; a pair of rows of a group meets in just one cell.

    `blocks` is the number of blocks of the row's group. Rows of a cell come together, sorted, in one task. The session's
    number of partitions is kept: cells are small in bytes and large in work, so merging partitions by size would make long
    tasks.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))
    dealt = rows.withColumn("block", block).withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    return dealt.drop("other", blocks).repartition(parts, group, "i", "j").sortWithinPartitions(group, "i", "j")


def whole_groups(batches, keys: int, limit: int = 4096):
    """Tables of whole groups, which are runs of rows equal in the first `keys` columns; a group may span batches."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < limit:
            continue
        cols = [held.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(held.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        last = np.flatnonzero(change)
        if len(last):
            yield held.slice(0, int(last[-1]) + 1).combine_chunks()
            held = held.slice(int(last[-1]) + 1)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def all_pairs(table: pa.Table, keys: int):
    """Row pairs (a, b) of the table's cells in portions of about PAIRS; in a cell of two blocks only pairs across them."""
    cols = [table.column(k).to_numpy() for k in range(keys)]
    i, j, block = cols[1], cols[2], table.column("block").to_numpy()
    n = table.num_rows
    head = np.ones(n, bool)
    if n > 1:
        head[1:] = False
        for c in cols:
            head[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], n)
    end = np.repeat(ends, ends - starts)
    count = end - np.arange(n) - 1
    upto = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
        rows, c = np.arange(at, stop), count[at:stop]
        a = np.repeat(rows, c)
        b = a + 1 + np.arange(c.sum()) - np.repeat(upto[at:stop] - upto[at], c)
        across = (i[a] == j[a]) | (block[a] != block[b])
        yield a[across], b[across]
        at = stop


def prune(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Compare MinHash values COMPARE at a time; pairs that have become too unlikely go at once."""
    equal = np.zeros(len(a), np.int32)
    for step, need in enumerate(least):
        cols = slice(step * COMPARE, (step + 1) * COMPARE)
        equal = equal + (sig[a, cols] == sig[b, cols]).sum(axis=1)
        stay = equal >= need
        a, b, equal = a[stay], b[stay], equal[stay]
        if not len(a):
            break
    return a, b


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest row of each row's component in the graph of the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            short = new[new]
            if (short == new).all():
                break
            new = short
        if (new == label).all():
            return label
        label = new


def candidate_edges(nodes: DataFrame, least: list[int]) -> DataFrame:
    """Edges (u, v) that connect what the pruned candidate pairs connect: in each cell a star for each component.

    `nodes` has node, sig and buckets, one row a node. Buckets of one node go; larger ones are cut into blocks.
    """
    rows = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    members = rows.join(shared, "bucket").select("bucket", "node", F.ceil(F.col("m") / (2 * CELL)).alias("blocks"))
    cells = in_cells(members.join(nodes.select("node", "sig"), "node"), "bucket", "blocks").select("bucket", "i", "j", "block", "node", "sig")

    def run(batches):
        for table in whole_groups(batches, 3):
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            node = table.column("node").to_numpy()
            kept = [prune(sig, a, b, least) for a, b in all_pairs(table, 3)]
            root = roots_of(len(node), np.concatenate([a for a, _ in kept]), np.concatenate([b for _, b in kept]))
            off = np.flatnonzero(root != np.arange(len(root)))
            edges = np.unique(np.stack([node[off], node[root[off]]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(edges[0], pa.int64()), pa.array(edges[1], pa.int64())], names=["u", "v"])

    return cells.mapInArrow(run, "u long, v long").distinct()


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of shared shingles of each pair of rows.

    Few pairs are merged one by one; for many the rows' shingles that occur twice or more form a 0/1 matrix, multiplied by
    its transpose some columns at a time.
    """
    rows = np.unique(np.concatenate([a, b]))
    if len(a) < 4 * len(rows):
        return np.array([len(sets[x]) + len(sets[y]) - len(np.union1d(sets[x], sets[y])) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    flat = np.concatenate([sets[r] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    twice = times > 1
    column, owner = (np.cumsum(twice) - 1)[column][twice[column]], owner[twice[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((len(rows), len(rows)), np.float64)
    for first in range(0, int(twice.sum()), 2048):
        lo, hi = np.searchsorted(column, [first, first + 2048])
        x = np.zeros((len(rows), 2048), np.float32)
        x[owner[lo:hi], column[lo:hi] - first] = 1
        shared += x @ x.T
    place = np.zeros(int(rows[-1]) + 1, np.int64)
    place[rows] = np.arange(len(rows))
    return shared[place[a], place[b]].astype(np.int64)


def verified(docs: DataFrame, groups: DataFrame, text: str, width: int, threshold: float, least: list[int]) -> DataFrame:
    """(node, links, root) for each node and cell: its links found in the cell, and the lowest node they connect it to.

    `docs` has key, mark and text; `groups` has key, mark, node and n of one text of each node, and its component.
    """
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / CELL + F.sum("n") / CELL_SHINGLES).alias("blocks"))
    chosen = groups.join(sizes, "root").withColumnsRenamed({"key": "__key", "mark": "__mark"})
    texts = docs.join(chosen, F.col("key").eqNullSafe(F.col("__key")) & (F.col("mark") == F.col("__mark"))).select("root", "node", "blocks", text)

    def make():
        def work(rows):
            out = []
            for _, part in chunks(rows):
                shingles, begin = shingle_sets(part, width)
                out += [shingles[x:y].tobytes() for x, y in zip(begin.tolist(), begin[1:].tolist(), strict=False)]
            return {"shingles": out}

        return work

    made = with_text_columns(texts, text, StructType([StructField("shingles", BinaryType())]), make, ["root", "node", "blocks"])
    cells = in_cells(made, "root", "blocks").select("root", "i", "j", "block", "node", "shingles")

    def run(batches):
        for table in whole_groups(batches, 3, limit=512):
            node, i = table.column("node").to_numpy(), table.column("i").to_numpy()
            keys = np.stack([table.column("root").to_numpy(), i, table.column("j").to_numpy(), node])
            _, once = np.unique(keys, axis=1, return_index=True)  # rows equal in key and text come several times
            once.sort()
            table, node = table.take(pa.array(once)), node[once]
            sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            begin = np.zeros(len(sets) + 1, np.int64)
            np.cumsum([len(s) for s in sets], out=begin[1:])
            sig = (min_hashes(np.concatenate(sets), begin) >> np.uint64(48)).astype(np.uint16)
            size = np.diff(begin)
            links, found = np.zeros(len(node), np.int64), []
            for a, b in all_pairs(table, 3):
                a, b = prune(sig, a, b, least)
                if len(a):
                    both = overlaps(sets, a, b)
                    yes = both >= threshold * (size[a] + size[b] - both) - 1e-9
                    a, b = a[yes], b[yes]
                    links += np.bincount(a, minlength=len(node)) + np.bincount(b, minlength=len(node))
                    found.append((a, b))
            if found:
                root = roots_of(len(node), np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
                on = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (node[on], links[on], node[root[on]])], names=["node", "links", "root"])

    return cells.mapInArrow(run, "node long, links long, root long")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """(key, mark, class_id, class_mark, n_links, n_copies, n_shingles) for each row.

    mark is the text's hash. class_id and class_mark are key and mark of the class's first text (lowest key, then mark, null
    keys first). A class is what links connect: similarity of at least `threshold` of the sets of `width`-word shingles,
    words being lower-cased runs of letters and digits; a text of fewer words is one shingle. n_links is the number of
    different shingle sets that the row's set is linked to; n_copies the number of other rows with an equal set. Texts
    without words (also null and empty ones) are alone in their class. Rows equal in key and text are alike.

    Two sets of the threshold's similarity share no band with a probability of 5e-8, and `tolerance` bounds the posterior
    at which a pair goes; all else is exact. No task sees more of a group than one cell of blocks.
    """
    ship(docs.sparkSession)
    least = min_matches(threshold, tolerance)
    slim = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    rows = stored(features(slim, "text", width), "features")
    worded = rows.where("node IS NOT NULL")
    nodes = stored(worded.select("node", "sig", "buckets").dropDuplicates(["node"]), "nodes")
    first = worded.groupBy("node").agg(F.min(F.struct("key", "mark")).alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"))
    first = stored(first, "first")
    groups = connected_components(candidate_edges(nodes, least)).join(first, "node").select("node", "root", "n", "first.key", "first.mark")
    found = stored(verified(slim, groups, "text", width, threshold, least), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    known = first.join(links, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = known.groupBy("root").agg(F.min("first").alias("head"))
    named = known.join(heads, "root").select("node", "head", "links", "copies")
    out = rows.select("key", "mark", "node", F.col("n").alias("n_shingles")).join(named, "node", "left")
    return out.select(
        F.col("key").alias(key), "mark", F.when(F.col("head").isNull(), F.col("key")).otherwise(F.col("head.key")).alias("class_id"),
        F.coalesce("head.mark", "mark").alias("class_mark"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("copies") - 1, F.lit(0)).cast("long").alias("n_copies"), "n_shingles")


def first_of_each_class(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of `docs` that are the first of their class, with all their columns; of rows equal in key and text one stays."""
    heads = similar_documents(docs, key, text, **settings).where(
        F.col(key).eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("class_mark"))).groupBy(F.col(key).alias("__key"), F.col("mark").alias("__mark")).agg(
        F.max("n_shingles").alias("__n"))
    marked = docs.withColumn("__hash", F.xxhash64(text))
    kept = marked.join(heads, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__mark")))
    return kept.dropDuplicates([key, "__hash"]).select(*docs.columns)


SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS k FROM shingles GROUP BY doc_id),
nodes AS (SELECT k, min(doc_id) AS head, count(*) AS copies, any_value(n) AS n FROM sets GROUP BY k),
own AS (SELECT k, s FROM nodes JOIN shingles ON doc_id = head),
pairs AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM own a JOIN own b USING (s) WHERE a.k <> b.k GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN nodes x ON a = x.k JOIN nodes y ON b = y.k WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach(k, root) AS (SELECT k, head FROM nodes UNION SELECT b, root FROM reach JOIN links ON k = a),
classes AS (SELECT k, min(root) AS root FROM reach GROUP BY k),
counts AS (SELECT a AS k, count(*) AS links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(root, d.doc_id) AS class_id, coalesce(links, 0)::BIGINT AS n_links, coalesce(copies - 1, 0)::BIGINT AS n_copies,
       coalesce(sets.n, 0)::INTEGER AS n_shingles
FROM documents d LEFT JOIN sets ON d.doc_id = sets.doc_id LEFT JOIN nodes ON sets.k = nodes.k LEFT JOIN classes ON sets.k = classes.k
LEFT JOIN counts ON sets.k = counts.k
"""
