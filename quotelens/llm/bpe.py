"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The vocabulary file's path is a parameter. Works with files of a lower-casing BPE with word ends (NFC, white space
dropped, byte-level symbols, no decoder): its text rules are in `pieces`.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .arrow_rows import with_text_columns

# pieces of more symbols than this get a tree of their own
SHORT = 64
NEVER, MASK = 1 << 62, (1 << 32) - 1
# fixed values: white space of the Unicode property, and the pieces a text is cut into
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
SPACES = regex.compile(f"[{SPACE}]+")
# the separators that Python counts as white space and Unicode does not
ODD = regex.compile("[\x1c-\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def merge_all(ids: list[int], merges: dict[int, int]) -> list[int]:
    """Merge the leftmost adjacent pair of lowest rank until no pair can be merged.

    `merges` maps left id << 32 | right id to rank << 32 | merged id. A segment tree holds that value for each pair, so its
    root is the lowest rank and the walk down prefers the left half; a merge is three point updates of logarithmic time.
    """
    n = len(ids)
    find = merges.get
    pairs = [find(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
    if min(pairs, default=NEVER) == NEVER:
        return ids
    size = 1 << (n - 2).bit_length()
    low = [NEVER] * size + pairs + [NEVER] * (size - n + 1)
    for i in range(size - 1, 0, -1):
        a, b = low[2 * i], low[2 * i + 1]
        low[i] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := low[1]) != NEVER:
        i = 1
        while i < size:
            i *= 2
            if low[i] != root:
                i += 1
        i -= size
        j = after[i]
        ids[i], ids[j] = root & MASK, -1
        k, h = after[j], before[i]
        after[i] = k
        changed = [(i, NEVER)]
        if k < n:
            before[k] = i
            changed = [(j, NEVER), (i, find(ids[i] << 32 | ids[k], NEVER))]
        if h >= 0:
            changed.append((h, find(ids[h] << 32 | ids[i], NEVER)))
        for at, value in changed:
            at += size
            low[at] = value
            while at > 1:
                best = low[at ^ 1]
                if value < best:
                    best = value
                at >>= 1
                if low[at] == best:
                    break
                low[at] = value = best
    return [x for x in ids if x >= 0]


def merge_many(pieces: list[list[int]], keys: np.ndarray, values: np.ndarray) -> list[list[int]]:
    """`merge_all` for many short pieces at once: one row, and one segment tree, a piece. `keys` is sorted."""
    n = np.array([len(p) for p in pieces])
    size = 1 << int(n.max() - 1).bit_length()  # at least as many leaves as symbols, so the last leaf never holds a pair
    none = size + 1  # a column of its own stands for "no neighbour"
    ids = np.full((len(pieces), size + 2), -1, np.int64)
    ids[np.arange(size + 2) < n[:, None]] = np.concatenate(pieces)

    def rank(left, right):
        key = left << 32 | right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[at] == key) & (left >= 0) & (right >= 0), values[at], NEVER)

    low = np.full((len(pieces), 2 * size), NEVER, np.int64)
    low[:, size:] = rank(ids[:, :size], ids[:, 1 : size + 1])
    half = size
    while half > 1:
        low[:, half // 2 : half] = np.minimum(low[:, half : 2 * half : 2], low[:, half + 1 : 2 * half : 2])
        half //= 2
    columns = np.arange(size + 2)
    after = np.where(columns + 1 < n[:, None], columns + 1, none)
    before = np.broadcast_to(np.where(columns > 0, columns - 1, none), ids.shape).copy()
    rows = np.arange(len(pieces))
    while True:
        rows = rows[low[rows, 1] != NEVER]
        if not len(rows):
            return [r[r >= 0].tolist() for r in ids]
        root = low[rows, 1]
        i = np.ones_like(rows)
        while i[0] < size:
            i *= 2
            i += low[rows, i] != root
        i -= size
        j = after[rows, i]
        k, h = after[rows, j], before[rows, i]
        ids[rows, i], ids[rows, j] = root & MASK, -1
        after[rows, i], before[rows, k] = k, i
        for at, value in ((j, NEVER), (i, rank(ids[rows, i], ids[rows, k])), (np.minimum(h, size - 1), rank(ids[rows, h], ids[rows, i]))):
            at = at + size
            low[rows, at] = value
            while at[0] > 1:
                at >>= 1
                low[rows, at] = np.minimum(low[rows, 2 * at], low[rows, 2 * at + 1])


class WordBpe:
    """The tables of one vocabulary file, and encoding by them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {self.ids[a] << 32 | self.ids[b]: r << 32 | self.ids[a + b] for r, (a, b) in enumerate(pairs)}
        self.keys = np.array(sorted(self.merges), np.int64)
        self.values = np.array([self.merges[k] for k in self.keys.tolist()], np.int64)
        marks = byte_symbols()
        self.inner = [self.ids.get(m, -1) for m in marks]
        self.last = [self.ids.get(m + self.end, -1) for m in marks]
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def piece_symbols(self, piece: str) -> list[int]:
        """Ids of a piece's bytes; a byte without a symbol in the vocabulary is left out."""
        raw = piece.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        return [i for i in ids if i >= 0] if -1 in ids else ids

    def encode_piece(self, piece: str) -> list[int]:
        return merge_all(self.piece_symbols(piece), self.merges)

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Short pieces together, by the size of their trees; long ones on their own."""
        out = [self.piece_symbols(p) for p in pieces]
        classes: dict[int, list[int]] = {}
        for at, ids in enumerate(out):
            if len(ids) > SHORT:
                out[at] = merge_all(ids, self.merges)
            elif len(ids) > 1:
                classes.setdefault((len(ids) - 1).bit_length(), []).append(at)
        for members in classes.values():
            for first in range(0, len(members), 8192):
                part = members[first : first + 8192]
                for at, ids in zip(part, merge_many([out[i] for i in part], self.keys, self.values), strict=True):
                    out[at] = ids
        return out

    def normal_words(self, text: str) -> list[str]:
        """NFC, lower case letter by letter, cut at white space."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
        text = text.lower()
        return [w for w in SPACES.split(text) if w] if ODD.search(text) else text.split()

    def segments(self, text: str):
        """(text, None) and (special token, its id) in order."""
        if self.cut is None or "<" not in text:
            yield text, None
            return
        for part in self.cut.split(text):
            if part:
                yield part, self.special.get(part)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self.segments(text):
            if special is not None:
                out.append(special)
            else:
                for word in self.normal_words(part):
                    for piece in PIECE.findall(word):
                        out += self.encode_piece(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens with one space between them, as the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


class Generations:
    """A bounded memo: when `limit` new keys have come, those not used since the last time are forgotten."""

    def __init__(self, limit: int):
        self.limit, self.now, self.older = limit, {}, {}

    def missing(self, keys: set) -> list:
        """The keys without a value, after taking over those still held from before."""
        if len(self.now) > self.limit:
            self.now, self.older = {}, self.now
        found, older = self.now, self.older
        new = keys.difference(found)
        if older:
            kept = {k: older[k] for k in new if k in older}
            found.update(kept)
            new.difference_update(kept)
        return list(new)


class Encoder:
    """Encodes lists of whole texts and remembers a bounded number of words and pieces: (ids as bytes, decoded text)."""

    def __init__(self, path: str, limit: int = 200_000):
        self.bpe = load(path)
        self.words, self.pieces = Generations(limit), Generations(limit)

    def learn(self, words: set[str]) -> dict[str, tuple[bytes, str]]:
        """Encode words not yet known, each distinct piece once."""
        new = self.words.missing(words)
        cut = list(map(PIECE.findall, new))
        fresh = self.pieces.missing({p for ps in cut for p in ps})
        known, tokens = self.pieces.now, self.bpe.tokens
        for p, ids in zip(fresh, self.bpe.encode_pieces(fresh), strict=True):
            known[p] = array("I", ids).tobytes(), " ".join([tokens[i] for i in ids])
        found = self.words.now
        for w, ps in zip(new, cut, strict=True):
            if len(ps) == 1:
                found[w] = known[ps[0]]
            else:
                parts = [known[p] for p in ps]
                found[w] = b"".join([a for a, _ in parts]), " ".join([b for a, b in parts if a])
        return found

    def batch(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text (ids as little-endian unsigned 32-bit integers, decoded text)."""
        cut = [[(special, None if special is not None else self.bpe.normal_words(part), part) for part, special in self.bpe.segments(t or "")]
               for t in texts]
        found = self.learn({w for segments in cut for _, words, _ in segments for w in words or ()})
        out = []
        for segments in cut:
            raw, text = [], []
            for special, words, part in segments:
                if special is not None:
                    raw.append(special.to_bytes(4, "little"))
                    text.append(part)
                elif words:
                    parts = [found[w] for w in words]
                    raw.append(b"".join([a for a, _ in parts]))
                    text.append(" ".join([b for a, b in parts if a]))
            out.append((b"".join(raw), " ".join(text)))
        return out


def encode_texts(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded",
                 keep: list[str] | None = None) -> DataFrame:
    """Each row with the token ids of its whole text and the text that they decode to.

    A null or empty text gives an empty list and an empty text. Other columns pass through; columns of `docs` named like
    the new ones are replaced. Repeated rows are encoded alike. No shuffle; memory follows the longest text.
    """
    schema = StructType([StructField(ids, ArrayType(IntegerType(), False)), StructField(decoded, StringType())])

    def make():
        enc = Encoder(vocabulary)

        def work(texts):
            got = enc.batch(texts)
            # the ids go on as they are, without an object for each
            offsets = np.cumsum([0] + [len(a) // 4 for a, _ in got])
            return {ids: (offsets, np.frombuffer(b"".join([a for a, _ in got]), "<i4")), decoded: [b for _, b in got]}

        return work

    return with_text_columns(docs, text, schema, make, keep)


def encode_digests(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As `encode_texts`, with digests in place of ids and text: n_tokens, ids_sha256 and decoded_sha256."""
    schema = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])

    def make():
        enc = Encoder(vocabulary)

        def work(texts):
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for raw, back in enc.batch(texts):
                out["n_tokens"].append(len(raw) // 4)
                out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
            return out

        return work

    return with_text_columns(docs, text, schema, make, keep)
