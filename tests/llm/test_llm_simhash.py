"""SimHash near duplicates against fingerprints and links worked out pair by pair."""

import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quotelens.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def slow_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    """prints: {key: fingerprint}; smallest key reachable over links of at most three bits."""
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {k: slow_print(t) for k, t in texts.items()}
    rows = queries.QUERIES["op12_simhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {k: f"{p:016x}" for k, p in prints.items()} and len(rows) == len(texts)
    assert {r.doc_id: r.component_id for r in rows} == slow_components(prints)
    assert any(r.component_id != r.doc_id for r in rows)


def test_edge_cases(spark):
    texts = [None, "", " \t\n", "one", "ONE", "one two", "É é A", "a b c " * 4000, "x" * 200_000, "one", "\x1ca\x85b c d　e", None]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, "one", "clash", 2), (None, "zz yy xx", "clash", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by_key = {r.doc_id: r for r in got}
    prints = {i: slow_print(t) for i, t in enumerate(texts)}
    assert all(by_key[i].fp % 2**64 == p for i, p in prints.items())
    assert {i: by_key[i].component_id for i in prints} == slow_components(prints)
    assert by_key[None].component_id is None
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    draw = random.Random(3)
    text = " ".join(draw.choice("abcdefg") * draw.randrange(1, 9) for _ in range(5000))
    whole = simhash.fingerprints([text, "a b", text], 3, 42)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 50)
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 7)
    assert (simhash.fingerprints([text, "a b", text], 3, 42) == whole).all() and int(whole[0]) == slow_print(text)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=5), st.sampled_from([1, 2, 3]), st.sampled_from([2, 3, 4, 8]))
def test_every_pair_within_the_radius_shares_a_variant(x, flips, radius, blocks):
    y = x ^ sum(1 << b for b in flips)
    v = simhash.variants(np.array([x, y], np.uint64), radius, blocks)
    if len(flips) <= radius:
        assert np.intersect1d(v[0], v[1]).size
    assert len(set(v[0].tolist())) <= v.shape[1]


def test_links_at_each_distance(spark):
    draw = random.Random(11)
    prints = set()
    for _ in range(60):
        x = draw.getrandbits(64)
        prints.add(x)
        for n in (1, 2, 3, 4, 5):
            prints.add(x ^ sum(1 << b for b in draw.sample(range(64), n)))
    center = draw.getrandbits(64)  # a dense group
    prints |= {center ^ 1 << a ^ 1 << b for a in range(12) for b in range(a)}
    by_key = {p - 2**64 if p >= 2**63 else p: p for p in prints}
    df = spark.createDataFrame([(k,) for k in by_key], "fp long")
    from quotelens.llm.components import connected_components
    for radius in (2, 3):
        roots = {r.node: r.root for r in connected_components(simhash.near_edges(df, radius)).collect()}
        keys, parent = sorted(by_key), {}
        parent = {k: k for k in keys}

        def find(k, parent=parent):
            while parent[k] != k:
                k = parent[k]
            return k

        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                if (by_key[a] ^ by_key[b]).bit_count() <= radius:
                    lo, hi = sorted((find(a), find(b)))
                    parent[hi] = lo
        assert {k: roots.get(k, k) for k in keys} == {k: find(k) for k in keys}
