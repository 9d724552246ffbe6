"""The registered queries over a whole small table, against brute force or the library."""

import hashlib
import html
import json
import re
import struct
import zlib

import pytest

from quotelens.llm import bpe, queries

SF = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_leaks(spark, documents):
    items = {r.item_id: tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id): r for r in queries.QUERIES["op1_spaced_seed_decontamination"](spark, SF).collect()}
    words = {k: tokens(r.text) for k, r in documents.items()}
    whole = {(d, i) for d, w in words.items() for i, t in items.items() if f" {' '.join(t)} " in f" {' '.join(w)} "}
    assert whole and whole <= set(found)
    assert all(found[p].identity == 1.0 and found[p].n_match == len(items[p[1]]) for p in whole)
    for (d, i), r in found.items():  # each reported stretch lies on one diagonal of the item and is as equal as stated
        stretch, n = words[d][r.begin : r.end], r.end - r.begin
        assert max(sum(a == b for a, b in zip(stretch, items[i][s : s + n], strict=False)) for s in range(len(items[i]))) >= r.n_match >= 12


def test_languages(spark, documents):
    rows = queries.QUERIES["op2_language_id"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(documents) and len(rows) == len(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == documents[r.doc_id].lang for r in rows if r.held_out and documents[r.doc_id].lang]
    assert sum(held) >= 0.95 * len(held)


def test_token_counts(spark, documents):
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        pieces = {p.replace("</w>", "\0") for p in json.load(f)["model"]["vocab"]}
    longest, marks, known = max(map(len, pieces)), bpe.byte_symbols(), {}

    def greedy(word):
        if word not in known:
            w, at, n = "".join(marks[b] for b in word.encode()) + "\0", 0, 0
            while at < len(w) - 1:
                at = next(e for e in range(min(len(w), at + longest), at, -1) if w[at:e] in pieces)
                n += 1
            known[word] = n
        return known[word]

    got = {r.doc_id: (r.n_words, r.n_tokens) for r in queries.QUERIES["op3_token_counts"](spark, SF).collect()}
    for k, r in documents.items():
        words = bpe.PIECE.findall((r.text or "").lower())
        assert got[k] == (len(words), sum(map(greedy, words)))


def test_licences(spark, documents):
    notices = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "all-rights-reserved",
               "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only"}
    got = {r.doc_id: r.licenses for r in queries.QUERIES["op6_license_scan"](spark, SF).collect()}
    for k, r in documents.items():
        lines = (r.text or "").split("\n")
        assert sorted(got[k]) == sorted(n for x in lines for t, n in notices.items() if x.strip().endswith(t))


def test_shards(spark, documents):
    rows = queries.QUERIES["op7_virtual_slots"](spark, SF).collect()
    size = {k: len((r.text or "").encode()) + 1 for k, r in documents.items()}
    assert {r.doc_id: r.size for r in rows} == size and all(r.text_crc32 == zlib.crc32((documents[r.doc_id].text or "").encode()) for r in rows)
    loads, places = [0] * 16, [[] for _ in range(16)]
    for r in rows:
        loads[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places) and max(loads) <= max(1.05 * sum(loads) / 16, max(size.values()))


def test_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.QUERIES["op9_html_main_text"](spark, SF).collect()}
    for k, p in pages.items():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", article)]
        assert got[k].text == "\n".join(x for x in blocks if x) and got[k].n_chars == len(got[k].text) and got[k].url == p.url


def test_bpe(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    for r in queries.QUERIES["op10_bpe_encode_decode"](spark, SF).collect():
        ids = library.encode(documents[r.doc_id].text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
