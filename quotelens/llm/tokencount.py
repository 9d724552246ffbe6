"""Word-piece token counts by a linear longest-match automaton.

The vocabulary becomes a trie whose nodes have failure links and, precomputed, the number of pieces that following a link
completes. One pass over a word's characters gives the length of its greedy longest-match-first tokenization; no piece is
built.
"""

from __future__ import annotations

import functools
import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from .arrow_rows import with_text_columns
from .bpe import PIECE, SPACE, Generations, byte_symbols

FAIL = -1


class Automaton:
    """Counts the pieces of a word under greedy longest match.

    `initial` are the pieces that may begin a word and `inner` those that may follow, without a mark; `end` is a mark that
    closes every word (one character, or empty); on its own it counts as no piece. A word that cannot be
    cut counts as one unknown piece.
    """

    def __init__(self, initial, inner, end: str = ""):
        self.end = end
        self.edges: list[dict[str, int]] = [{}, {}]
        self.whole = [False, False]
        self.start = 1 if initial is inner else 0  # one vocabulary for both places needs one trie
        for root, pieces in ((self.start, initial), (1, inner))[: 2 - self.start]:
            for piece in pieces:
                self._insert(root, piece)
        if end:
            self._insert(1, end)
        n = len(self.edges)
        self.link, self.popped = [FAIL] * n, [0] * n
        self._link()
        if end:
            self.popped[self._node(1, end)] = 0

    def _insert(self, node: int, piece: str) -> None:
        if not piece:
            return
        for c in piece:
            nxt = self.edges[node].get(c)
            if nxt is None:
                nxt = len(self.edges)
                self.edges[node][c] = nxt
                self.edges.append({})
                self.whole.append(False)
            node = nxt
        self.whole[node] = True

    def _node(self, node: int, piece: str) -> int:
        for c in piece:
            node = self.edges[node][c]
        return node

    def _link(self) -> None:
        """Breadth first: a whole piece pops itself to the inner root; else the parent's links are followed until a step fits."""
        queue = [0, 1]
        for node in queue:
            for c, child in self.edges[node].items():
                if self.whole[child]:
                    self.link[child], self.popped[child] = 1, 1
                else:
                    at, count = self.link[node], self.popped[node]
                    while at != FAIL and c not in self.edges[at]:
                        count += self.popped[at]
                        at = self.link[at]
                    if at != FAIL:
                        self.link[child], self.popped[child] = self.edges[at][c], count
                queue.append(child)

    def count(self, word: str) -> int:
        """Number of pieces of one word."""
        if not word:
            return 0
        edges, link, popped = self.edges, self.link, self.popped
        node, pieces = self.start, 0
        for c in word + self.end:
            nxt = edges[node].get(c)
            while nxt is None:
                if link[node] == FAIL:
                    return 1
                pieces += popped[node]
                node = link[node]
                nxt = edges[node].get(c)
            node = nxt
        while node != 1:
            if link[node] == FAIL:
                return 1
            pieces += popped[node]
            node = link[node]
        return pieces


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """From a vocabulary file: pieces with a word-end mark, or WordPiece pieces whose inner ones have a prefix."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    prefix, end = model.get("continuing_subword_prefix") or "", model.get("end_of_word_suffix") or ""
    pieces = model["vocab"]
    if end:
        pieces = [p.replace(end, "\0") for p in pieces]
        end = "\0"
    if prefix:
        return Automaton([p for p in pieces if not p.startswith(prefix)], [p[len(prefix):] for p in pieces if p.startswith(prefix)], end)
    return Automaton(pieces, pieces, end)


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row with n_words and n_tokens: words of its whole text and the pieces of their greedy longest match.

    Words are the lower-cased letter runs, digits and symbol runs of the text; their UTF-8 bytes are matched as symbols.
    A null or empty text has none of either. Other columns pass through; columns of the same names are replaced. No
    shuffle; a bounded number of words is remembered in each task.
    """
    schema = StructType([StructField("n_words", LongType()), StructField("n_tokens", LongType())])
    spaces = regex.compile(f"[{SPACE}]+")

    def make():
        machine, marks = automaton(vocabulary), byte_symbols()
        runs, words = Generations(200_000), Generations(200_000)

        def work(texts):
            cut = [spaces.split(t.lower()) if t else [] for t in texts]
            new = runs.missing({w for ws in cut for w in ws})
            parts = list(map(PIECE.findall, new))
            for w in words.missing({p for ps in parts for p in ps}):
                words.now[w] = machine.count("".join([marks[b] for b in w.encode("utf-8", "surrogatepass")]))
            for w, ps in zip(new, parts, strict=True):
                runs.now[w] = len(ps), sum([words.now[p] for p in ps])
            out = {"n_words": [], "n_tokens": []}
            for ws in cut:
                got = [runs.now[w] for w in ws]
                out["n_words"].append(sum([a for a, _ in got]))
                out["n_tokens"].append(sum([b for _, b in got]))
            return out

        return work

    return with_text_columns(docs, text, schema, make, keep)
