"""Token alignment against the two libraries and links worked out pair by pair."""

import hashlib
import random
from collections import Counter

import pytest

from quotelens.llm import queries, tokenalign

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def spans(ids, parts):
    out, at = [], 0
    for i, p in zip(ids, parts, strict=True):
        out.append((i, at, at + len(p)))
        at += len(p)
    return out


def slow(sides, text):
    """Groups and links (a, b) of a text."""
    a, b = sides
    if not text:
        return [], [], [], []
    byte_of = {c: i for i, c in enumerate(tokenalign.byte_symbols())}
    e = a.encode(" " + text, add_special_tokens=False)
    x = spans(e.ids, [bytes(byte_of[c] for c in a.id_to_token(i)) for i in e.ids])
    ids = b.encode(text)
    names = [b.id_to_piece(i) for i in ids]
    pieces = [bytes.fromhex(n[3:5]) if b.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(ids, names, strict=True)]
    y = spans(ids, pieces)
    if b"".join(pieces) != (" " + text).encode():
        return [], [], [], []
    ends = sorted({s[2] for s in x} & {s[2] for s in y})
    groups = [([i for i, _, e in x if lo < e <= hi], [i for i, _, e in y if lo < e <= hi]) for lo, hi in zip([0, *ends], ends, strict=False)]
    links, first = [], 0
    for i, s, e in x:
        while y[first][2] <= s:
            first += 1
        k = first
        while k < len(y) and y[k][1] < e:
            links.append((i, y[k][0]))
            k += 1
    return [i for i, _, _ in x], ids, groups, links


def expected(sides, texts):
    found = {k: slow(sides, t) for k, t in texts.items()}
    count = Counter(p for _, _, _, links in found.values() for p in links)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = {}
    for k, (a, b, groups, links) in found.items():
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if a else ""
        out[k] = (len(a), len(b), len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), digest)
    return out, {k: g for k, (_, _, g, _) in found.items()}


def as_tuple(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def test_query_against_brute_force(spark, sides):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_token_alignment"](spark, SF).collect()
    assert len(rows) == len(texts) and {r.doc_id: as_tuple(r) for r in rows} == expected(sides, texts)[0]


def test_edge_cases(spark, sides, monkeypatch):
    texts = [None, "", " ", "\n", "a", " leading", "trailing ", "two  spaces\t\ttabs", "<|endoftext|> <s></s><unk> ▁x", "日本語 𝔘𝔫 🎉👍🏽", "é ﬁ Å ½",
             "\x00\x01\x1c\x85 ", "a" * 5000 + " " + "b1" * 700, "The same line. " * 400, "a", "x\r\ny", "﻿bom"]
    rows = [(i, t, "clash", 5, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, groups_sha256 string, n_a long, __group string")
    want, groups = expected(sides, dict(enumerate(texts)))
    for limit in (512, 3):  # rows of a group
        monkeypatch.setattr(tokenalign, "GROUP_ROWS", limit)
        got = tokenalign.align_tokens(df).collect()
        assert len(got) == len(texts) and {r.doc_id: as_tuple(r) for r in got} == want
        assert all([(g.a, g.b) for g in r.groups] == groups[r.doc_id] for r in got)
    assert tokenalign.align_tokens(df.limit(0)).count() == 0
    twice = {as_tuple(r)[:4] for r in tokenalign.align_tokens(df.union(df).where("doc_id = 4"), with_groups=False).collect()}
    assert twice == {want[4][:4]}


def test_byte_level_ids_equal_the_library(sides):
    encode, _ = tokenalign.byte_level(P.path("byte_bpe_50k.json"))
    draw = random.Random(4)
    letters = "ab eé'sTt12 \n\t\r\x0b\x1c\x85\xa0 　日🎉ßſ.,!-_<|>½²́​"
    for _ in range(3000):
        text = " " + "".join(draw.choice(letters) for _ in range(draw.randrange(40)))
        assert encode(text) == sides[0].encode(text, add_special_tokens=False).ids, repr(text)
