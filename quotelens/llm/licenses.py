"""Licence recognition by sentences: known licence sentences get identifiers, and ordered rules match sequences of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .arrow_rows import with_text_columns

# fixed values: (identifier, sentence as `normal` writes it)
SENTENCES = (
    ("apache-short", "licensed under the apache license version 2.0"),
    ("apache-1", "licensed under the apache license version 2.0 the license"),
    ("apache-1", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("apache-3", "you may obtain a copy of the license at http www apache org licenses license 2.0"),
    ("apache-4", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-5", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit-short", "released under the mit license"),
    ("mit-short", "licensed under the mit license"),
    ("mit-short", "this project is licensed under the mit license"),
    ("mit-1", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-2", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-3", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("gpl3-short", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-short", "licensed under the gnu general public license version 3"),
    ("gpl2-short", "licensed under the gnu general public license version 2"),
    ("gpl3-1", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2-1", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-2", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-3", "see the gnu general public license for more details"),
    ("gpl-4", "you should have received a copy of the gnu general public license along with this program"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("mpl-1", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2.0"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2.0"),
    ("gpl2-only-1", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license"),
    ("gpl3-only-1", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license"),
    ("gpl2-only-1", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl3-only-1", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation"),
    ("lgpl2.1-1", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"),
    ("lgpl2.1-1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"),
    ("lgpl2.1-short", "licensed under the gnu lesser general public license version 2.1"),
    ("lgpl2.1-short", "this work is licensed under the gnu lesser general public license version 2.1"),
    ("lgpl3-1", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl3-1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl3-short", "licensed under the gnu lesser general public license version 3"),
    ("lgpl3-short", "this work is licensed under the gnu lesser general public license version 3"),
    ("agpl3-1", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl3-1", "this library is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl3-short", "licensed under the gnu affero general public license version 3"),
    ("agpl3-short", "this work is licensed under the gnu affero general public license version 3"),
    ("bsd-1", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-4", "neither the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd2-short", "released under the bsd 2 clause license"),
    ("bsd2-short", "licensed under the bsd 2 clause license"),
    ("bsd2-short", "this project is licensed under the bsd 2 clause license"),
    ("bsd3-short", "released under the bsd 3 clause license"),
    ("bsd3-short", "licensed under the bsd 3 clause license"),
    ("bsd3-short", "this project is licensed under the bsd 3 clause license"),
    ("isc-1", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-short", "released under the isc license"),
    ("isc-short", "licensed under the isc license"),
    ("isc-short", "this project is licensed under the isc license"),
    ("unlicense-1", "this is free and unencumbered software released into the public domain"),
    ("cc0", "licensed under cc0 1.0"),
    ("cc0", "this work is licensed under cc0 1.0"),
    ("cc0", "this work is licensed under a creative commons cc0 1.0 universal license"),
    ("cc-by-nd", "licensed under cc by nd 4.0"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4.0 international license"),
    ("reserved", "all rights reserved"),
)
# fixed values: (licence, sequence of sentence identifiers); at each place the first rule that fits holds
RULES = (
    ("Apache-2.0", ("apache-1", "apache-2", "apache-3", "apache-4", "apache-5")),
    ("Apache-2.0", ("apache-1", "apache-3", "apache-4", "apache-5")),
    ("Apache-2.0", ("apache-1",)),
    ("Apache-2.0", ("apache-short",)),
    ("MIT", ("mit-1", "mit-2", "mit-3")),
    ("MIT", ("mit-1",)),
    ("MIT", ("mit-short",)),
    ("GPL-3.0-or-later", ("gpl3-1", "gpl-2", "gpl-3", "gpl-4")),
    ("GPL-3.0-or-later", ("gpl3-1",)),
    ("GPL-2.0-or-later", ("gpl2-1", "gpl-2", "gpl-3", "gpl-4")),
    ("GPL-2.0-or-later", ("gpl2-1",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("GPL-2.0-only", ("gpl2-short",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("MPL-2.0", ("mpl-1", "mpl-2")),
    ("MPL-2.0", ("mpl-1",)),
    ("GPL-2.0-only", ("gpl2-only-1",)),
    ("GPL-3.0-only", ("gpl3-only-1",)),
    ("LGPL-2.1-or-later", ("lgpl2.1-1",)),
    ("LGPL-3.0-or-later", ("lgpl3-1",)),
    ("AGPL-3.0-or-later", ("agpl3-1",)),
    ("LGPL-2.1-only", ("lgpl2.1-short",)),
    ("LGPL-3.0-only", ("lgpl3-short",)),
    ("AGPL-3.0-only", ("agpl3-short",)),
    ("BSD-3-Clause", ("bsd-1", "bsd-2", "bsd-3", "bsd-4")),
    ("BSD-2-Clause", ("bsd-1", "bsd-2", "bsd-3")),
    ("BSD-3-Clause", ("bsd3-short",)),
    ("BSD-2-Clause", ("bsd2-short",)),
    ("ISC", ("isc-1",)),
    ("ISC", ("isc-short",)),
    ("Unlicense", ("unlicense-1",)),
    ("CC0-1.0", ("cc0",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("all-rights-reserved", ("reserved",)),
)
# fixed values: names of licences as a short notice gives them ("licensed under the ...")
NAMES = (
    ("MIT", ("mit license", "mit licence", "mit")),
    ("Apache-2.0", ("apache license version 2.0", "apache license v2.0", "apache license 2.0", "apache 2.0 license", "apache 2.0")),
    ("BSD-2-Clause", ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license")),
    ("BSD-3-Clause", ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license")),
    ("ISC", ("isc license",)),
    ("Unlicense", ("unlicense",)),
    ("MPL-2.0", ("mozilla public license version 2.0", "mozilla public license 2.0", "mozilla public license v. 2.0", "mpl 2.0")),
    ("GPL-2.0-only", ("gnu general public license version 2", "gnu general public license v2", "gnu general public license v2.0", "gnu gpl v2", "gplv2", "gpl v2")),
    ("GPL-3.0-only", ("gnu general public license version 3", "gnu general public license v3", "gnu general public license v3.0", "gnu gpl v3", "gplv3", "gpl v3")),
    ("LGPL-2.1-only", ("gnu lesser general public license version 2.1", "gnu lesser general public license v2.1", "lgpl v2.1")),
    ("LGPL-3.0-only", ("gnu lesser general public license version 3", "gnu lesser general public license v3", "lgpl v3")),
    ("AGPL-3.0-only", ("gnu affero general public license version 3", "gnu affero general public license v3", "agpl v3")),
    ("CC0-1.0", ("cc0 1.0", "creative commons cc0 1.0 universal license", "cc0 1.0 universal")),
    ("CC-BY-4.0", ("cc by 4.0", "creative commons attribution 4.0 international license")),
    ("CC-BY-SA-4.0", ("cc by sa 4.0", "creative commons attribution sharealike 4.0 international license")),
    ("CC-BY-NC-4.0", ("cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license")),
    ("CC-BY-ND-4.0", ("cc by nd 4.0", "creative commons attribution noderivatives 4.0 international license")),
)
# fixed values: identifiers of the SPDX list beside the names of RULES
SPDX_ALSO = (("GPL-2.0-only", "GPL-2.0"), ("GPL-2.0-or-later", "GPL-2.0+"), ("GPL-3.0-only", "GPL-3.0"), ("GPL-3.0-or-later", "GPL-3.0+"),
             ("LGPL-2.1-only", "LGPL-2.1"), ("LGPL-2.1-or-later", "LGPL-2.1+"), ("LGPL-3.0-only", "LGPL-3.0"), ("LGPL-3.0-or-later", "LGPL-3.0+"),
             ("AGPL-3.0-only", "AGPL-3.0"), ("AGPL-3.0-or-later", "AGPL-3.0+"))
# a sentence ends at a mark followed by white space, at a blank line, or at a colon before a list; a version's "v." ends none
SENTENCE_END = re.compile(r"(?:(?<=[.!?])(?<!\bv\.))\s+|\n[^\S\n]*\n\s*|(?<=:)[^\S\n]*\n(?=[\W_]*(?:\d{1,2}[.)]|[a-z]\)|[*•-])\s)")
SPDX = re.compile(r"SPDX-License-Identifier:[^\S\n]*([^\n]*)", re.I)
SPDX_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")
ITEM = re.compile(r"^[\W_]*(?:\(?(?:\d{1,2}|[a-z])[.)]|[*•-])\s+(?=\w)", re.I)
# "this file is distributed under the terms of the" and the like
NOTICE = re.compile(r"^(?:(?:this|the|all|our) (?:[a-z]+ ){0,2}?(?:is|are) |(?:it|code|everything) is )?(?:dual |also )?(?:licensed|licenced|released|distributed|published|made available|available|provided) "
                    r"under (?:the )?(?:terms of )?(?:the |an? )?")
HOLDER = re.compile(r"^neither the names? of (?:the )?[\w. ]{1,80}? nor the names of (?:its|the) contributors may ")
NUMBER = re.compile(r"\W*\d{1,2}\W*")
DROPPED = re.compile(r"[^\w.]+|(?<!\d)\.+|\.+(?!\d)")


def normal(text: str) -> str:
    """Lower case, one space for whatever is no letter, digit or underscore; a dot stays between digits."""
    return " ".join(DROPPED.sub(" ", text.lower()).split())


def canonical(sentence: str) -> str:
    """A normalised sentence without what varies: who is licensed, which verb says so, and a holder's name."""
    return HOLDER.sub("neither the name of the copyright holder nor the names of its contributors may ", NOTICE.sub("licensed under ", sentence))


def spdx_sentence(name: str) -> str:
    return normal("spdx license identifier " + name.replace("+", " plus"))


def spdx_lines(text: str) -> str:
    """Each identifier of an SPDX line as a sentence of its own."""
    def apart(m):
        names = [n for n in SPDX_NAME.findall(m[1]) if n not in ("OR", "AND", "WITH")]
        return "".join(f"\n\nSPDX-License-Identifier: {n.replace('+', ' plus')}\n\n" for n in names)

    return SPDX.sub(apart, text) if "SPDX-" in text or "spdx-" in text else text


class Recogniser:
    """The sentence table and the rules, ready to scan texts."""

    def __init__(self, sentences=SENTENCES, rules=RULES):
        self.ids = {f"licensed under {name}": f"short-{licence}" for licence, names in NAMES for name in names}
        self.ids |= {spdx_sentence(also): f"spdx-{licence}" for licence, also in (*((r, r) for r, _ in rules), *SPDX_ALSO)}
        self.ids |= {canonical(s): i for i, s in sentences}
        self.last = {s.rsplit(" ", 1)[-1] for s in self.ids}
        self.longest = max((s.count(" ") + 1 for s in self.ids), default=0)
        self.rules = [(name, tuple(seq)) for name, seq in rules] + [(n.split("-", 1)[1], (n,)) for n in sorted({x for x in self.ids.values() if x.startswith(("short-", "spdx-"))})]

    def sentence_id(self, sentence: str) -> str | None:
        """Identifier of the sentence, or of its end from some line on, as a heading may stand before it; the longest one found."""
        words = normal(sentence[-64:]).rsplit(" ", 1)
        if words[-1] not in self.last:
            return None
        found, tail, rest = None, "", ""
        for line in reversed(sentence.split("\n")):
            tail = (normal(line + "\n" + tail) if tail else normal(line))
            found = self.ids.get(tail, None) or self.ids.get(canonical(tail), None) or self.ids.get(canonical(normal(ITEM.sub("", line) + "\n" + rest)), found)
            rest = tail
            if tail.count(" ") >= self.longest:
                break
        return found

    def scan(self, text: str | None) -> tuple[list[tuple[int, str]], list[str]]:
        """((place among the sentences, identifier) of each known sentence, licences in the order of the text)."""
        known, ranks, numbers = [], [], 0  # a list item's number stands for no sentence between two others
        if text:
            for place, sentence in enumerate(SENTENCE_END.split(spdx_lines(text))):
                got = self.sentence_id(sentence)
                if got is not None:
                    known.append((place, got))
                    ranks.append(place - numbers)
                elif len(sentence) < 9 and NUMBER.fullmatch(sentence):
                    numbers += 1
        licences, at = [], 0
        while at < len(known):
            for name, seq in self.rules:
                part = known[at : at + len(seq)]
                if tuple(i for _, i in part) == seq and ranks[at + len(part) - 1] - ranks[at] == len(seq) - 1:
                    licences.append(name)
                    at += len(seq)
                    break
            else:
                at += 1
        return known, licences


def scan_licenses(docs: DataFrame, text: str = "text", sentences=SENTENCES, rules=RULES, keep: list[str] | None = None) -> DataFrame:
    """Each row with license_sentences (place, id) and licenses, a list in the order of the text with repeats.

    A rule's sentences must follow one another directly. Known sentences that fit no rule are listed but name no licence.
    A null or empty text has none. Other columns pass through; columns of the same names are replaced. No shuffle.
    """
    sentence = StructType([StructField("place", IntegerType()), StructField("id", StringType())])
    schema = StructType([StructField("license_sentences", ArrayType(sentence, False)), StructField("licenses", ArrayType(StringType(), False))])

    def make():
        scan = Recogniser(sentences, rules).scan

        def work(texts):
            got = [scan(t) for t in texts]
            return {"license_sentences": [[{"place": p, "id": i} for p, i in known] for known, _ in got], "licenses": [names for _, names in got]}

        return work

    return with_text_columns(docs, text, schema, make, keep)
