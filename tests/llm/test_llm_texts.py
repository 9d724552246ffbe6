"""Operators that map one row to one row: BPE, token counts, languages, licences, pages."""

import hashlib
import json
import random
import re
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotelens.llm import bpe, htmltext, langid, licenses, tokencount
from quotelens.llm.textarrays import chunks, hashed_words

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = bpe.default_vocabulary()
SCHEMA = "doc_id long, text string, n_tokens string, lang string, source string"
ODD = [
    "", "  ", "don't İstanbul ΑΣ ς", "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "a\x1cb\x85c　d", "é é ½ 12³ ß",
    "日本語 𝔘𝔫 🎉👍🏽", "a" * 5000 + "b" * 3001, "'sAB'll''d", "ﬁ Å K", "x​y", "\x01\x02", "aaaa bbbb " * 3000,
]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", None, "s") for i, t in enumerate(texts)], SCHEMA)


def test_bpe_equals_the_library_and_replaces_clashing_columns(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    texts = [*ODD, None, *ODD[:3]]
    got = {r.doc_id: r for r in bpe.encode_digests(docs(spark, texts), VOCABULARY).collect()}
    whole = {r.doc_id: r for r in bpe.encode_texts(docs(spark, texts), VOCABULARY).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()), repr(t)[:60]
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
        assert (whole[i].token_ids, whole[i].decoded) == (ids, back)
    assert bpe.encode_digests(docs(spark, []), VOCABULARY).count() == 0


def slow_merges(ids, merges):
    ids = list(ids)
    while True:
        ranks = [merges.get(a << 32 | b, bpe.NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        if not ranks or min(ranks) == bpe.NEVER:
            return ids
        i = ranks.index(min(ranks))
        ids[i : i + 2] = [ranks[i] & bpe.MASK]


def test_segment_trees_merge_leftmost_lowest():
    draw = random.Random(5)
    for _ in range(60):
        merges = {draw.randrange(8) << 32 | draw.randrange(8): r << 32 | draw.randrange(8) for r in range(20)}
        keys = np.array(sorted(merges), np.int64)
        values = np.array([merges[k] for k in keys.tolist()], np.int64)
        words = [[draw.randrange(8) for _ in range(draw.randint(2, 30))] for _ in range(20)]
        want = [slow_merges(w, merges) for w in words]
        assert [bpe.merge_all(list(w), merges) for w in words] == want
        assert bpe.merge_many(words, keys, values) == want


def greedy(word, initial, inner):
    at = n = 0
    while at < len(word) and word[at:] != "\0":
        for end in range(len(word), at, -1):
            if word[at:end] in (initial if at == 0 else inner):
                break
        else:
            return 1
        n, at = n + 1, end
    return n


def test_automaton_counts_greedy_pieces():
    draw = random.Random(3)
    for _ in range(400):
        initial, inner = ({"".join(draw.choice("ab") for _ in range(draw.randint(1, 5))) for _ in range(6)} for _ in "xy")
        initial |= {p + "\0" for p in draw.sample(sorted(initial), 2)}
        machine, same = tokencount.Automaton(initial, inner), tokencount.Automaton(initial, initial)
        marked = tokencount.Automaton(initial, inner, "\0")
        for _ in range(20):
            w = "".join(draw.choice("ab") for _ in range(draw.randint(1, 12)))
            assert machine.count(w) == greedy(w, initial, inner) and same.count(w) == greedy(w, initial, initial)
            assert marked.count(w) == greedy(w + "\0", initial, inner)


def test_token_counts_of_whole_texts(spark):
    with open(VOCABULARY, encoding="utf-8") as f:
        pieces = {p.replace("</w>", "\0") for p in json.load(f)["model"]["vocab"]}
    marks = bpe.byte_symbols()
    texts = ["", None, "The quick, brown FOX's den", "über straße 12", "q" * 3000, "The quick"]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokencount.count_tokens(docs(spark, texts), VOCABULARY).collect()}
    for i, t in enumerate(texts):
        words = bpe.PIECE.findall((t or "").lower())
        assert got[i] == (len(words), sum(greedy("".join(marks[b] for b in w.encode()) + "\0", pieces, pieces) for w in words))


EN = "the cat sat on the mat and then the dog came to this house with that other one "
DE = "der hund und die katze sind nicht in dem haus aber auf der strasse von ihnen "
RU = "кошка и собака не были в этом доме но на улице они были вместе "


def test_languages_spans_and_odd_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * 20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "ru"]
    texts = [EN, DE, RU, None, "", "123 !?", EN * 4 + DE * 3 + RU, "日本語", EN, "the " * 20000]
    got = {r.doc_id: r for r in langid.identify(docs(spark, texts).withColumn("score", F.lit("clash")), model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 4, 5, 8, 9)] == ["en", "de", "ru", "und", "und", "und", "en", "en"]
    assert [s.lang for s in got[6].lang_spans] == ["en", "de", "ru"] and got[6].lang_pred == "en" and got[6].lang_share < 0.6
    first, second, third = got[6].lang_spans
    assert texts[6][second.begin : second.end].strip() in DE * 3 and texts[6][third.begin : third.end].strip() == RU.strip()
    assert got[7].lang_pred in model.languages and got[3].score == 0.0 and all(0 <= r.score <= 1 for r in got.values())
    empty = langid.identify_documents(docs(spark, [None, "words without any label"]))
    assert [r.lang_pred for r in empty.collect()] == ["und", "und"] and langid.identify_documents(docs(spark, [])).count() == 0


def slow_viterbi(scores, penalty):
    value, back = scores[0].copy(), []
    for s in scores[1:]:
        best = int(value.argmax())
        came = [best if value[k] < value[best] - penalty else k for k in range(len(value))]
        back.append(came)
        value = np.array([max(value[k], value[best] - penalty) for k in range(len(value))]) + s
    path = [int(value.argmax())]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def test_viterbi_equals_word_by_word():
    draw = np.random.default_rng(1)
    lengths = draw.integers(0, 40, 60)
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores = (draw.normal(size=(first[-1], 3)) * 3 + np.repeat(draw.normal(size=(first[-1] // 7 + 1, 3)) * 4, 7, axis=0)[: first[-1]]).astype(np.float32)
    path = langid.viterbi(scores, first, 6.0)
    for a, b in zip(first, first[1:], strict=False):
        if b > a:
            mine, want = path[a:b], slow_viterbi(scores[a:b].astype(float), 6.0)
            cost = lambda p, a=a: sum(scores[a + i, k] for i, k in enumerate(p)) - 6.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))
            assert abs(cost(mine.tolist()) - cost(want)) < 1e-3
    assert len(set(path.tolist())) == 3


def test_held_out_rule(spark):
    import zlib

    got = {r.doc_id: r.h for r in docs(spark, ["x"] * 40).select("doc_id", langid.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(40)}


MIT = """Title
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def test_licences(spark):
    texts = [
        None, "", "Some words.\nReleased under the MIT License.\nAll rights reserved.", MIT, "x " * 50000 + "\nLicensed under CC BY-NC 4.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Not released under the MIT licence terms.", "See the GNU General Public License for more details.",
        "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0.",
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, texts).withColumn("licenses", F.lit(1))).collect()}
    assert [got[i].licenses for i in range(len(texts))] == [
        [], [], ["MIT", "all-rights-reserved"], ["MIT"], ["CC-BY-NC-4.0"], ["MPL-2.0"], [], [], ["Apache-2.0", "Apache-2.0"]]
    assert [s.id for s in got[3].license_sentences] == ["mit-1", "mit-2"] and [s.id for s in got[7].license_sentences] == ["gpl-3"]


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
   in the documentation and/or other materials provided with the distribution.
"""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU %s as published by the Free Software Foundation, "


@pytest.mark.parametrize(("text", "names"), [
    (BSD, ["BSD-2-Clause"]), (BSD + BSD3, ["BSD-3-Clause"]), (BSD.replace("1. ", "* ").replace("2. ", "* "), ["BSD-2-Clause"]),
    (FREE % "General Public License" + "version 2 of the License.", ["GPL-2.0-only"]), (FREE % "General Public License" + "version 3 of the License.", ["GPL-3.0-only"]),
    (FREE % "Lesser General Public License" + "either version 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1-or-later"]),
    (FREE % "Affero General Public License" + "either version 3 of the License, or (at your option) any later version.", ["AGPL-3.0-or-later"]),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
     "notice and this permission notice appear in all copies.", ["ISC"]),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"]), ("Licensed under CC0 1.0.", ["CC0-1.0"]),
    ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]), ("Released under the BSD 3-Clause License.", ["BSD-3-Clause"]),
])
def test_common_licences(text, names):
    assert licenses.Recogniser().scan("Some words.\n\n" + text)[1] == names


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href=x>Home</a></nav>
<div class="ad">Buy this now and get a second one for nothing at all, today only in our shop.</div>%s<footer>&copy; us</footer>"""


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("<script>x<p>", ""), ("<p title='a>b'>q</p>", "q"),
    (PAGE % "<article><h1>A &amp; B</h1><p>One\n two&nbsp;three<br>four</p><p>Ti.</p></article>", "A & B\nOne two three four\nTi."),
    (PAGE % "<article><header><h1>T</h1></header><p>x</p><div class='post-comments'><p>nice</p></div><form><p>in</p></form></article>", "T\nx"),
    (PAGE % ("<div><p>" + "word " * 40 + "</p><p>Short.</p></div><div>Tiny</div>"), ("word " * 40).strip() + "\nShort."),
    ("<article><nav>lost<p>b</p></article>", "lost\nb"), ("<p>x</p><!-- c <p>d</p> --><p>y</p>", "x\ny"),
    ("<article>" + "<p>w</p>" * 3000 + "</article>", "\n".join(["w"] * 3000)),
])
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


LONG = ("word " * 60).strip()


@pytest.mark.parametrize(("page", "text"), [
    # wrappers that are named after what they have, or that hold the page
    *[(PAGE % f"<div class='{c}'><article><p>{LONG}</p><p>x</p></article><div class=sidebar>side</div></div>", f"{LONG}\nx")
      for c in ("layout has-sidebar", "no-sidebar", "nav-open site", "content-with-toc", "widget", "page-overlay", "comments")],
    (PAGE % f"<div class='widget-area'><p>{LONG}</p></div><div class=sidebar><p>side</p></div>", LONG),
    (PAGE % f"<form id=f><div><article><p>{LONG}</p></article></div></form>", LONG), (f"<form><p>{LONG}</p></form>", LONG),
    (f"<body><main><div class=has-sidebar><article><p>{LONG}</p></article></div><div class='share'>s</div></main></body>", LONG),
    # inline parts, code and callouts of an article
    ("<article><pre><code>x = 1 <span class='token comment'># one</span> <i class=hljs-comment>two</i></code></pre></article>", "x = 1 # one two"),
    ("<article><p>a <span class='legal'>b</span></p><p class='notice'>c</p><div class=notice>d</div></article>", "a b\nc\nd"),
    # nothing else is there
    ("<div class='ad'><p>only</p></div>", "only"),
    # still dropped: readers' and foreign parts, also with articles in them, and unclosed ones
    (f"<article><p>{LONG}</p><div class=comments><article>c</article><article class=comment>{LONG} {LONG} {LONG}</article></div><p>z</p></article>", f"{LONG}\nz"),
    (f"<article><p>{LONG}</p><div class=widget><article>card</article></div></article>", LONG),
    (f"<article><p>{LONG}</p></article><div class=related><article>card</article></div>", LONG),
    (f"<article><p>{LONG}</p><div class=share>s</article><p>t</p></div>", LONG),
    (f"<nav>{'<a href=x>menu entry</a>' * 200}</nav><article>{LONG}</article>", LONG),
])
def test_names_drop_no_main_text(page, text):
    assert htmltext.main_text(page) == text


LINK = "<a href=x>" + "linked " * 9 + "</a>"
LINKED = ("linked " * 9).strip()


@pytest.mark.parametrize(("page", "text"), [
    # paragraphs set as div, short ones among them; lists; tables
    (PAGE % f"<div><div>Short one.</div><div>{LONG}</div><div>Two.</div><div>{LONG}</div><div>End.</div></div>", f"Short one.\n{LONG}\nTwo.\n{LONG}\nEnd."),
    (PAGE % f"<div><p>{LONG}</p><ul><li>a</li><li>b</li></ul><p>{LONG}</p><ol><li>c</li></ol></div>", f"{LONG}\na\nb\n{LONG}\nc"),
    (PAGE % f"<div><p>{LONG}</p><div><p>box</p></div><table><tr><td>1<td>2</tr></table><p>{LONG}</p></div>", f"{LONG}\nbox\n1 2\n{LONG}"),
    (PAGE % f"<div><div><p>{LONG}</p></div><div><p>Short.</p></div><div><p>{LONG}</p></div></div>", f"{LONG}\nShort.\n{LONG}"),
    # titles in elements of their own
    (PAGE % f"<div><div><h1>T</h1></div><div>by me</div><div><p>{LONG}</p><p>x</p></div></div>", f"T\n{LONG}\nx"),
    (PAGE % f"<div><div class=post-title>T</div><div><h2><a href=x>H</a></h2><p>{LONG}</p><p>x</p></div></div>", f"T\nH\n{LONG}\nx"),
    # lines of links between parts of the text
    (PAGE % f"<div><p>{LONG}</p><h2><a href=x>H</a></h2><p>{LINK} ab</p><ul><li>{LINK}</li></ul><p>{LONG}</p></div>", f"{LONG}\nH\n{LINKED} ab\n{LINKED}\n{LONG}"),
    # one short article beside the text
    (PAGE % f"<div><p>{LONG}</p><article class=card><p>card</p></article><p>{LONG}</p></div>", f"{LONG}\ncard\n{LONG}"),
    (PAGE % f"<article class=card><p>card</p></article><div><p>{LONG}</p></div>", LONG),
    # still none of the text: link lists before and after it, other short containers
    (PAGE % f"<div><ul><li>{LINK}</li></ul><p>{LONG}</p><ul><li>{LINK}</li></ul></div><div>t</div>", LONG),
    (PAGE % f"<div><div><p>{LONG}</p></div><div><ul><li>{LINK}</li></ul></div><div><p>{LONG}</p></div></div><div><div>t</div></div>", f"{LONG}\n{LONG}"),
    (PAGE % f"<article><p>{LONG}</p></article><div><p>teaser</p></div>", LONG),
])
def test_text_outside_articles_is_kept_whole(page, text):
    assert htmltext.main_text(page) == text


SHORT = "This article has some two hundred characters of text. " * 4


@pytest.mark.parametrize("beside", [f"<div class='sidebar'><p>{LONG * 3}</p></div>", f"<aside><article>{LONG * 3}</article></aside>", f"<nav><p>{LONG * 3}</p></nav>",
                                    f"<menu><article>{LONG * 3}</article></menu>", f"<div class=related><div><article><p>{LONG * 3}</p></article></div></div>"])
@pytest.mark.parametrize("page", ["<body>%s<article><p>{}</p></article></body>", "<body><main><article><p>{}</p></article>%s</main></body>",
                                  "<body><div><article><p>{}</p></article></div>%s</body>", "<body><main><p>{}</p></main>%s</body>"])
def test_nothing_beside_an_article_overrides_it(page, beside):
    assert htmltext.main_text(page.format(SHORT) % beside) == SHORT.strip()


TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:"[^"]*"|'[^']*'|[^'">]++)*+|[^>]*)>""", re.S)


def test_scanner_finds_the_tags_of_the_pattern():
    draw = random.Random(6)
    for _ in range(4000):
        page = "".join(draw.choice(["<", ">", "'", '"', "a", " ", "<a ", "</a", "<!--", "-->", "<!", "=", "b='", "x>"]) for _ in range(draw.randrange(30)))
        scanner, at, got = htmltext.Scanner(page), 0, []
        while tag := scanner.next(at):
            got.append(tag)
            at = tag[1]
        assert got == [(m.start(), m.end(), (m[2] or "").lower(), bool(m[1]), m[3] or "") for m in TOKEN.finditer(page)], page


@pytest.mark.parametrize("unit", ["<a ", "<a b='", "<div style='x", '<a b="', "<a '>'", """<a '">""", "<!--", "<!", "</script", "<script>", "<a b=c ", "<p>x", "<aside><article>x",
                                  "<main>x<aside>y", "&lt", "<div class=sidebar>", "</script ", "<a href=x>y"])
def test_a_page_of_one_megabyte_takes_linear_time(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.process_time()
    htmltext.main_text(page)
    htmltext.main_text("<script>" + page + ">")
    assert time.process_time() - began < 60  # some seconds; a quadratic scan takes hours


BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
%s Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
%s Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""


@pytest.mark.parametrize(("text", "names"), [
    *[(BSD % marks, ["all-rights-reserved", "BSD-2-Clause"]) for marks in (("1.", "2."), ("*", "*"), ("(a)", "(b)"), ("-", "-"))],
    (BSD % ("1.", "2.") + "\n3. Neither the name of the University of Somewhere nor the names of its contributors may be used to endorse or promote products\n"
     "   derived from this software without specific prior written permission.", ["all-rights-reserved", "BSD-3-Clause"]),
    ("This work is licensed under CC-BY-SA 4.0.", ["CC-BY-SA-4.0"]), ("This file is licensed under the MIT License.", ["MIT"]),
    ("Distributed under the MIT License.", ["MIT"]), ("This software is licensed under the Apache License, Version 2.0", ["Apache-2.0"]),
    ("SPDX-License-Identifier: MIT", ["MIT"]), ("// SPDX-License-Identifier: GPL-2.0+\nint main;", ["GPL-2.0-or-later"]),
    ("# SPDX-License-Identifier: (MIT OR Apache-2.0)\nx = 1", ["MIT", "Apache-2.0"]), ("/* SPDX-License-Identifier: BSD-3-Clause */ code", ["BSD-3-Clause"]),
    ("The source code is available under the terms of the GNU General Public License v3.", ["GPL-3.0-only"]), ("Released under the ISC License.", ["ISC"]),
    ("Our project is made available under the Mozilla Public License 2.0!", ["MPL-2.0"]), ("This library is distributed under the terms of the BSD 3-Clause License.", ["BSD-3-Clause"]),
    ("Prose about licences.\n\nThe MIT License is short. We licensed under pressure.", []), ("This book is provided under the table.", []),
])
def test_common_forms_of_notices(text, names):
    assert licenses.Recogniser().scan(text)[1] == names
    assert licenses.Recogniser().scan(f"Some words before.\n\n{text}\n\nMore words after it")[1] == names


def test_pages_keep_their_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "old"), (2, None, None, None), (1, "u", "<p>a</p>", "old")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, htmltext.extract_text(pages).select("page_id", "url", "text").collect()), key=str) == [(1, "u", "a"), (1, "u", "a"), (2, None, "")]


def test_segments_run_from_surge_to_dive():
    assert htmltext.segments([5, 0, 0, 0, 90, 10, 3, 0, 0, 0, 4]) == [(4, 7)]
    assert htmltext.segments([0, 0]) == [] and htmltext.segments([]) == []


def test_word_hashes_tell_words_apart_in_any_chunk():
    texts = ["Élan, élan ÉLAN!", "", "a b", "b a", "x" * 100]
    parts = [hashed_words(part) for _, part in chunks(texts)]
    h, first = parts[0][0].tolist(), parts[0][3].tolist()
    assert first == [0, 3, 3, 5, 7, 8] and h[0] == h[1] == h[2] and h[3:5] == h[6:4:-1] and len(set(h)) == 4
