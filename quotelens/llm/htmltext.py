"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one a block element; elements that never hold article text (menus, adverts, forms and the
like, by element, class, id or role) become blank lines, and so does the way from one container to another. The text
lengths of sliding windows of lines are summed; the text runs from each surge of that sum to the dive after it. Short and
linked lines between two parts of the text in one container, and headings before a part, belong to it.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .arrow_rows import with_text_columns

WINDOW = 3
# a surge is a window of this many characters, or of half the fullest window if that is less
SURGE = 86
# fixed values: elements by what they mean for the text
RAW = frozenset("script style noscript template textarea title iframe xmp".split())
DROPPED = frozenset("head nav header footer aside form button select dialog menu svg math canvas object audio video map datalist".split())
BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr caption section article main body html blockquote pre hr figure figcaption address fieldset details summary hgroup center".split())
# blocks inside the same one of these belong together; lists and tables are blocks of what they lie in
CONTAINERS = frozenset("div section article main body html center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TITLES = frozenset("title headline subtitle".split())
TITLE_CHARS = 200
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription share sharing social "
    "comment comments disqus reply replies respond related recommended recommendations widget pagination pager toolbar copyright legal disclaimer "
    "search login signup contentinfo complementary toc skip".split())
# of these names only readers' and foreign parts make an article none of the page's
READERS = frozenset("comment comments disqus reply replies respond related recommended recommendations ad ads advert sponsored promo".split())
# inside an article these name parts of its text
CALLOUTS = frozenset("notice legal disclaimer copyright".split())
# headings, code and inline elements are never dropped by name
PLAIN = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark pre q s samp small span strike strong sub sup time tt u var h1 h2 h3".split())
# these, and what is dropped by name, stay when the page's text is in them
WRAPPERS = frozenset("form header dialog".split())
HOLDERS = WRAPPERS | frozenset("nav footer aside menu".split())
# a class name that begins or ends so states something about the element and not what it is
STATES_BEFORE = frozenset("has no not with without hide show".split())
STATES_AFTER = frozenset("open opened closed".split())
BODY_NAMES = frozenset("article content main post entry story body text".split())
OPENING = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:_-]*))")
STOP = re.compile("""['">]""")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def named(value: str) -> set[str]:
    """Words of the class names (or ids, roles) in the attribute, without names such as has-sidebar or content-with-toc."""
    out: set[str] = set()
    for one in value.split():
        words = [w.lower() for w in WORD.findall(one)]
        if words and not (words[0] in STATES_BEFORE or words[-1] in STATES_AFTER or "with" in words or "without" in words):
            out.update(words)
    return out


def is_aside(name: str, attributes: str, inside: bool, in_code: bool = False) -> str:
    """Why an element is none of the article's, or ''; `inside` an article a header holds its title.

    part: by its element, hidden, name: by class, id or role, readers: by one of READERS.
    """
    if name in DROPPED:
        return "" if inside and name == "header" else "part"
    if not attributes or name in ("html", "body"):
        return ""
    names: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            names |= named(value)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value):
            return "hidden"
    found = names & ASIDE
    if found & READERS and name not in PLAIN and not in_code:
        return "readers"
    if name in MAIN or name in PLAIN or in_code or inside and (name == "p" or found <= CALLOUTS):
        return ""
    return "name" if found and not (found <= {"header"} and (inside or names & BODY_NAMES)) else ""


def is_title(attributes: str) -> bool:
    """Whether the class or id names a title."""
    if "title" not in attributes and "headline" not in attributes:
        return False
    return any(m[1].lower() in ("class", "id") and named(m[2] or m[3] or m[4] or "") & TITLES for m in ATTRIBUTE.finditer(attributes))


class Scanner:
    """Finds a page's tags in one pass that is linear also where quotes or tags are left open.

    A tag ends at the first `>` outside quotes or, where that leads to the page's end, at the first `>`. Quotes from which the
    end was reached are remembered, so no quote is looked into twice without getting on.
    """

    def __init__(self, page: str):
        self.page, self.lost = page, set()

    def tag_end(self, at: int) -> int:
        """Place of the `>` that ends the tag whose attributes begin here, or -1 where the page has no `>` any more."""
        path, k = [], at
        while k >= 0:
            stop = STOP.search(self.page, k)
            place = stop.start() if stop else -1
            if place < 0 or place in self.lost:
                break
            if self.page[place] == ">":
                return place
            path.append(place)
            k = self.page.find(self.page[place], place + 1)
            k += k >= 0
        self.lost.update(path)
        return self.page.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(begin, end, name, whether it closes, attributes) of the next tag from here; comments and the like have no name."""
        m = OPENING.search(self.page, at)
        if not m:
            return None
        end = -1 if m[1] else self.tag_end(m.end()) if m[3] else self.page.find(">", m.end())
        if end >= 0:
            return m.start(), end + 1, (m[3] or "").lower(), bool(m[2]), self.page[m.end() : end] if m[3] else ""
        # a comment, also one behind a tag that never ends
        begin = self.page.find("<!--", m.start())
        end = self.page.find("-->", begin + 4)
        return None if begin < 0 else (begin, end + 3 if end >= 0 else len(self.page), "", False, "")

    def raw_end(self, begin: re.Pattern, at: int) -> int:
        """Where the text of an element goes on after its end tag, which `begin` finds; without one at the page's end."""
        m = begin.search(self.page, at)
        end = self.page.find(">", m.end()) if m else -1
        return end + 1 if end >= 0 else len(self.page)


class Tokens:
    """Tags of a page with the text before each, where each element closes, and how much text there is before each tag."""

    def __init__(self, page: str):
        self.before: list[str] = []
        self.tags: list[tuple[str, bool, str]] = []  # (name, whether it closes, attributes)
        self.close: dict[int, int] = {}
        # characters of text outside links: all, in an article, in an article inside another
        self.upto: tuple[list[int], list[int], list[int]] = ([], [], [])
        self.body_end = -1
        opened: dict[str, list[int]] = {}
        mains: list[int] = []
        total, at, raws = [0, 0, 0], 0, {}
        self.clear: dict[int, bool] = {}
        scanner = Scanner(page)
        while True:
            tag = scanner.next(at)
            begin, end, name, closing, attributes = tag or (len(page), len(page), "", False, "")
            text, i = page[at:begin], len(self.tags)
            if text and not opened.get("a"):
                for k in range(1 + min(2, len(mains))):
                    total[k] += len(text.strip())
            self.before.append(text)
            self.tags.append((name, closing, attributes))
            for out, n in zip(self.upto, total, strict=True):
                out.append(n)
            if not tag:
                break
            at = end
            if name in RAW and not closing:
                if name not in raws:
                    raws[name] = re.compile(rf"</{name}\b", re.I)
                at = scanner.raw_end(raws[name], at)
            elif closing:
                if name == "body":
                    self.body_end = i
                if opened.get(name):
                    first = opened[name].pop()
                    self.close[first] = i
                    if mains and mains[-1] == first:
                        mains.pop()
            elif name and name not in VOID and not attributes.rstrip().endswith("/"):
                if name in BLOCK:
                    opened.pop("a", None)
                opened.setdefault(name, []).append(i)
                if name in MAIN and not is_aside(name, attributes, False):
                    mains.append(i)

    def has_clear_article(self, within: tuple[int, int]) -> bool:
        """Whether an article with text lies in `within` and in no element there that is none of an article's."""
        begin, end = within
        if begin not in self.clear:
            found, covered = False, -1
            for i in range(begin + (self.tags[begin][0] in MAIN), end):
                name, closing, attributes = self.tags[i]
                if closing or not name or i not in self.close:
                    continue
                if is_aside(name, attributes, False):
                    covered = max(covered, self.close[i])
                elif name in MAIN and i > covered and self.upto[0][self.close[i]] > self.upto[0][i]:
                    found = True
                    break
            self.clear[begin] = found
        return self.clear[begin]

    def holds_most(self, begin: int, end: int, within: tuple[int, int], depth: int, why: str, name: str) -> bool:
        """Whether the element holds most of the articles in `within`, the page or the article around it, or most of its text.

        What lies beside an article never does; a part of an article has to hold nearly all of it.
        """
        if why == "hidden" or why == "part" and name not in HOLDERS:
            return False
        scope = depth == 0 or depth == 1 and self.tags[within[0]][0] == "main"
        if scope and self.has_clear_article(within):
            return False
        share = 2 if scope and why != "readers" else 10  # over half of it, or all but a tenth

        def most(sums: list[int]) -> bool:
            mine, all_of_it = sums[end] - sums[begin], sums[within[1]] - sums[within[0]]
            return mine > 0 and share * (all_of_it - mine) < all_of_it

        # an article inside an article, or a reader's one, is a part of it
        nested = depth == 0 or depth == 1 and why != "readers" and self.tags[within[0]][0] == "main"
        return nested and most(self.upto[depth + 1]) or (why != "part" or name in WRAPPERS) and most(self.upto[0])


class Line(NamedTuple):
    text: str
    links: int  # characters of it that are links
    within: bool  # it lies in an article
    container: int  # the tag of the container that holds its block, -1 for none
    outer: int  # the tag of the container around that, -1 for none or the page's body
    heading: int  # 1 to 6, 0 for none
    apart: bool  # a foreign element was removed before it


def lines_of(page: str, by_name: bool = True) -> list[Line]:
    """Lines of the page's text. Without `by_name` only hidden elements and those that never hold text are dropped."""
    lines: list[Line] = []
    text: list[str] = []
    links = in_link = 0
    apart = False
    mains: list[int] = []  # open articles
    opened: list[int] = [-1]  # open containers
    block = -1  # the tag of the last block that was opened or closed
    code_end = heading_end = heading = -1
    tokens = Tokens(page)
    last = len(tokens.tags) - 1

    def outside(k: int) -> int:
        """The container at this depth, -1 for the page's body."""
        return opened[k] if -len(opened) <= k and opened[k] >= 0 and tokens.tags[opened[k]][0] not in ("html", "body") else -1

    def flush(at: int) -> None:
        nonlocal links, apart
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            # a container that holds nothing but this text is a block of the one around it
            up = 1 + (len(opened) > 1 and block == opened[-1] and tokens.close[block] == at)
            lines.append(Line(line, min(links, len(line)), bool(mains), outside(-up), outside(-up - 1), heading if at <= heading_end else 0, apart))
            apart = False
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if in_link:
                links += len(" ".join(plain.split()))

    i = -1
    while i < last:
        i += 1
        add(tokens.before[i])
        name, closing, attributes = tokens.tags[i]
        if not name or name in RAW and not closing:
            continue
        if closing:
            if name in BLOCK:
                flush(i)
                block = i
                while len(opened) > 1 and tokens.close[opened[-1]] <= i:
                    opened.pop()
            if name in MAIN and mains:
                mains.pop()
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name in ("td", "th"):
                text.append(" ")
            continue
        if name in VOID:
            text.append(" ")
            if name == "hr":
                flush(i)
                block = i
            continue
        why = is_aside(name, attributes, bool(mains), i < code_end)
        if why and not by_name and (why in ("name", "readers") or name in WRAPPERS):
            why = ""
        if why and attributes.rstrip().endswith("/"):
            flush(i)
            apart = True
            continue
        end = tokens.close.get(i, -1)
        if why and end > 0:
            around = (mains[-1], tokens.close.get(mains[-1], last)) if mains else (0, last)
            if not tokens.holds_most(i, end, around, len(mains), why, name):
                flush(i)
                apart = True
                # an element that is left open ends with the article or the body around it
                stop = min([end] + [around[1]] * bool(mains) + [tokens.body_end] * (tokens.body_end > i))
                if stop < end:
                    i = stop - 1
                    tokens.before[stop] = ""
                else:
                    i = end
                continue
        if name in ("code", "pre"):
            code_end = max(code_end, end)
        if name in BLOCK:
            flush(i)
            in_link, block = 0, i
            while len(opened) > 1 and tokens.close[opened[-1]] <= i:
                opened.pop()
            if name in CONTAINERS and end > 0:
                opened.append(i)
            if end > heading_end and (name in HEADINGS or is_title(attributes) and tokens.upto[0][end] - tokens.upto[0][i] <= TITLE_CHARS):
                heading, heading_end = int(name[1]) if name in HEADINGS else 1, end
        elif name == "a":
            in_link += 1
        elif name in ("td", "th", "option"):
            text.append(" ")
        if name in MAIN:
            mains.append(i)
    flush(last)
    return lines


def segments(lengths: list[int], surge: int = SURGE) -> list[tuple[int, int]]:
    """(begin, end) from each surge of the window sums to the dive after it; what precedes a surge without a blank window belongs to it."""
    n = len(lengths)
    sums = [sum(lengths[i : i + WINDOW]) for i in range(n)]
    need = min(surge, (max(sums, default=0) + 1) // 2)
    out, i = [], 0
    while i < n:
        if not sums[i] or not lengths[i]:
            i += 1
            continue
        end = i
        while end < n and sums[end]:
            end += 1
        if max(sums[i:end]) >= need:
            out.append((i, end))
        i = end
    return out


def main_text(page: str | None) -> str:
    """Blocks of the main text joined by a line break; where dropping by name leaves nothing, without it."""
    if not page:
        return ""
    return text_of(lines_of(page)) or text_of(lines_of(page, by_name=False))


def kept_lines(lines: list[Line]) -> list[bool]:
    """Which lines are main text, articles or not."""
    # a line of links only counts for nothing, though it may lie in the text
    own = [0 if 2 * line.links > len(line.text) else len(line.text) - line.links for line in lines]
    lengths: list[int] = []
    places: list[int] = []  # the line of each length
    for k, line in enumerate(lines):
        if k and (line.apart or line.container != lines[k - 1].container):
            lengths.extend([0] * WINDOW)
            places.extend([k] * WINDOW)
        lengths.append(own[k])
        places.append(k)
    keep = [False] * len(lines)
    for a, b in segments(lengths):
        for i in range(a, b):
            keep[places[i]] |= lengths[i] > 0
    core = [k for k, x in enumerate(keep) if x]
    # lines between kept ones of a container, in it directly or with one container between
    for direct in (True, False):
        ends: dict[int, tuple[int, int]] = {}
        for k in core:
            for c in {lines[k].container} if direct else {lines[k].container, lines[k].outer} - {-1}:
                ends[c] = (ends.get(c, (k, k))[0], k)
        steps = [0] * (len(lines) + 1)
        for a, b in ends.values():
            steps[a] += 1
            steps[b] -= 1
        open_ = 0
        for k, line in enumerate(lines):
            open_ += steps[k]
            if open_ and (direct or own[k] or line.heading):
                keep[k] = True
    for k in range(len(lines) - 2, -1, -1):
        keep[k] |= lines[k].heading > 0 and keep[k + 1] and not lines[k + 1].apart
    title = next((k for k in range(core[0] - 1, -1, -1) if lines[k].heading == 1), None) if core else None
    if title is not None and not any(lines[k].heading == 1 for k in core):
        keep[title] = True
    return keep


def text_of(lines: list[Line]) -> str:
    """The articles' lines where these hold most of the text, else the lines of the whole page's main text."""
    keep = kept_lines(lines)
    inside = sum(len(line.text) - line.links for line in lines if line.within)
    beside = sum(len(line.text) - line.links for line, x in zip(lines, keep, strict=True) if x and not line.within)
    if inside >= beside and any(line.within for line in lines):
        keep = [line.within for line in lines]
    return "\n".join(line.text for line, x in zip(lines, keep, strict=True) if x)


def extract_text(pages: DataFrame, markup: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Each row with `text`, the main text of its whole page.

    Character references are decoded, white space in a block becomes one space, blocks follow in page order. A null or empty
    page and one without main text give an empty text. Other columns pass through; a column named text is replaced. No
    shuffle; memory follows the longest page.
    """
    def make():
        return lambda markups: {"text": [main_text(m) for m in markups]}

    return with_text_columns(pages, markup, StructType([StructField("text", StringType())]), make, keep)
