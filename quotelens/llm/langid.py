"""Language identification: scripts narrow the candidates, then Viterbi over per-word scores labels spans.

A word's score in a language is the sum of the log frequencies of its letter trigrams (word ends included), learned from
labelled rows. A path pays `penalty` for each change of language.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .arrow_rows import with_text_columns
from .ship import ship
from .textarrays import chunks, code_points, mix, runs, tables

BUCKETS = 1 << 16
UNKNOWN = "und"
# fixed values: first and last code point of each script that is told apart; other letters form script 0
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x323AF),
)
NAMES = ("other", *dict.fromkeys(s for s, _, _ in SCRIPTS))


@functools.cache
def script_bits() -> np.ndarray:
    """One bit for the script of each code point."""
    out = np.ones(0x110000, np.uint32)
    for name, first, last in SCRIPTS:
        out[first : last + 1] = 1 << NAMES.index(name)
    return out


def words_and_grams(part: list[str]):
    """(letter codes with 0 between words, text begins, word begins, word ends, trigram bucket at each position)."""
    lower, letter, _ = tables()
    codes, begin = code_points(part)
    is_letter = letter[codes]
    starts, ends = runs(is_letter)
    x = np.where(is_letter, lower[codes], 0).astype(np.uint64)
    one = np.concatenate([np.zeros(1, np.uint64), x[:-1]])
    two = np.concatenate([np.zeros(2, np.uint64), x[:-2]])[: len(x)]
    two[one == 0] = 0
    grams = mix((two << np.uint64(42)) | (one << np.uint64(21)) | x) & np.uint64(BUCKETS - 1)
    return codes, begin, starts, ends, grams.astype(np.int64)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id's text is a multiple of five; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """Log frequencies [bucket, language], and the script bits of each language."""

    def __init__(self, languages: list[str], scores: np.ndarray, scripts: np.ndarray, penalty: float):
        self.languages, self.scores, self.scripts, self.penalty = languages, scores, scripts, penalty

    def word_scores(self, part: list[str]):
        """(text begins, word begins, word ends, scores [word, language]); a language without the word's script gets none of it."""
        codes, begin, starts, ends, grams = words_and_grams(part)
        out = np.zeros((len(starts), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            total = np.zeros(len(grams) + 1)
            np.cumsum(self.scores[:, k][grams], out=total[1:])
            out[:, k] = total[ends + 1] - total[starts]  # the position after a word holds its last trigram
        if len(starts):
            edges = np.column_stack([starts, ends]).ravel()
            bits = np.bitwise_or.reduceat(np.append(script_bits()[codes], 0), edges)[::2]
            fits = (bits[:, None] & self.scripts[None, :]) != 0
            some = fits.any(axis=1)
            out[some[:, None] & ~fits] -= 1e4
            out[~some] = 0
        return begin, starts, ends, out

    def label(self, part: list[str]):
        """For each text its spans (first word, last word + 1, language), and words with their places and scores."""
        begin, starts, ends, scores = self.word_scores(part)
        first = np.searchsorted(starts, begin)
        path = viterbi(scores, first, self.penalty)
        return first, starts, ends, scores, path


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word; texts are the word ranges first[i]:first[i + 1].

    A text stays in its best language throughout when no stretch of words gains as much as one change costs; that is
    tested for all texts at once. The others go word by word, all texts side by side.
    """
    n, count = scores.shape
    lengths = np.diff(first)
    path = np.zeros(n, np.int32)
    if not n:
        return path
    text = np.repeat(np.arange(len(lengths)), lengths)
    total = np.zeros((len(lengths), count))
    filled = np.flatnonzero(lengths)
    total[filled] = np.add.reduceat(scores, first[filled], axis=0, dtype=np.float64)
    best = total.argmax(axis=1).astype(np.int32)
    path[:] = best[text]
    gain = scores.max(axis=1).astype(np.float64) - scores[np.arange(n), path]
    own = scores.copy()
    own[np.arange(n), path] = -np.inf
    step = own.max(axis=1).astype(np.float64) - scores[np.arange(n), path] if count > 1 else gain - 1
    sums = np.cumsum(step)
    before = sums - step
    span = np.ptp(np.append(sums, 0.0)) + 1
    floor = before - text * span  # lower in each later text, so that minima don't reach back into an earlier one
    rise = sums - (np.minimum.accumulate(floor) + text * span)
    worst = np.full(len(lengths), -np.inf)
    worst[filled] = np.maximum.reduceat(rise, first[filled])
    mixed = np.flatnonzero(worst >= penalty)
    if not len(mixed):
        return path
    mixed = mixed[np.argsort(-lengths[mixed], kind="stable")]
    size, at = lengths[mixed], first[mixed]
    value = scores[at].astype(np.float64)
    came = np.zeros((int(size.sum()), count), np.int16)  # language before each word, by the word's language
    place = np.concatenate([[0], np.cumsum(size)])[:-1]
    languages = np.arange(count)
    live = len(mixed)
    for t in range(1, int(size[0])):
        while size[live - 1] <= t:
            live -= 1
        v = value[:live]
        top = v.argmax(axis=1)
        peak = v[np.arange(live), top] - penalty
        move = v < peak[:, None]
        came[place[:live] + t] = np.where(move, top[:, None], languages)
        value[:live] = np.where(move, peak[:, None], v) + scores[at[:live] + t]
    state = value.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, side="left"))  # texts of more than t words
        path[at[:live] + t] = state[:live]
        if t:
            state[:live] = came[place[:live] + t, state[:live]]
    return path


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_language: int = 3000, penalty: float = 10.0) -> Model:
    """Learn trigram frequencies and scripts from labelled rows.

    At most about `rows_per_language` rows of each language are read, chosen by a hash of `key` and text. The driver gets
    one array of BUCKETS counts for each language. Rows without text or language teach nothing; no labelled row gives a
    model without languages.
    """
    ship(docs.sparkSession)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    languages = sorted(counts)
    draw = F.pmod(F.xxhash64(F.col(key), F.length(text)), F.lit(1_000_000))
    keep = F.lit(False)
    for name in languages:
        keep = keep | ((F.col(lang) == name) & (draw < F.lit(int(1_000_000 * min(1.0, rows_per_language / counts[name])))))
    schema = StructType([StructField("lang", StringType()), StructField("slot", IntegerType()), StructField("n", DoubleType())])

    def count_grams(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            texts = batch.column(1).to_pylist()
            for name in set(names.tolist()):
                mine = total.setdefault(name, np.zeros(BUCKETS + len(NAMES)))
                for _, part in chunks([texts[i] for i in np.flatnonzero(names == name)]):
                    codes, _, starts, ends, grams = words_and_grams(part)
                    inside = tables()[1][codes]
                    used = inside.copy()
                    used[ends] = True
                    mine[:BUCKETS] += np.bincount(grams[used], minlength=BUCKETS)
                    bits = script_bits()[codes[inside]]
                    for k in range(len(NAMES)):
                        mine[BUCKETS + k] += np.count_nonzero(bits == 1 << k)
        for name, mine in total.items():
            slots = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(slots)), pa.array(slots.astype(np.int32)), pa.array(mine[slots])], names=["lang", "slot", "n"])

    found = (labelled.where(keep).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
             .mapInArrow(count_grams, schema).groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas())
    table = np.zeros((BUCKETS + len(NAMES), len(languages)))
    table[found["slot"].to_numpy(int), [languages.index(x) for x in found["lang"]]] = found["n"].to_numpy(float)
    grams, letters = table[:BUCKETS], table[BUCKETS:]
    scores = np.log((grams + 0.1) / (grams.sum(axis=0) + 0.1 * BUCKETS)).astype(np.float32)
    used = letters >= np.maximum(1, 0.01 * letters.sum(axis=0))
    scripts = (used * (1 << np.arange(len(NAMES)))[:, None]).sum(axis=0).astype(np.uint32)
    return Model(languages, scores, scripts, penalty)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row with lang_pred, score, lang_share and lang_spans of its whole text.

    lang_spans lists (begin, end, lang) in characters. lang_pred is the language with most letters in the spans, `und` for
    a null text or one without letters (no span, score and share 0); ties go to the first language by name. lang_share is
    that language's share of the letters, score this share times its posterior over the words it was given. Other columns pass through; columns named like
    the new ones are replaced. No shuffle.
    """
    span = StructType([StructField("begin", IntegerType()), StructField("end", IntegerType()), StructField("lang", StringType())])
    schema = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("lang_share", DoubleType()),
                         StructField("lang_spans", ArrayType(span))])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, a column for each learned language

    def make():
        m = shared.value
        count = len(m.languages)

        def work(texts):
            pred, score, shares, spans = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if not count:
                return {"lang_pred": pred, "score": score, "lang_share": shares, "lang_spans": spans}
            for base, part in chunks(texts):
                first, starts, ends, scores, path = m.label(part)
                begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
                lengths = np.diff(first)
                text_of = np.repeat(np.arange(len(part)), lengths)
                letters = np.zeros((len(part), count))
                np.add.at(letters, (text_of, path), ends - starts)
                filled = np.flatnonzero(lengths)
                top = letters.argmax(axis=1)
                mine = np.where((path == top[text_of])[:, None], scores, 0)
                totals = np.zeros((len(part), count))
                totals[filled] = np.add.reduceat(mine, first[filled], axis=0, dtype=np.float64)
                posterior = 1 / np.exp(np.clip(totals - totals[np.arange(len(part)), top][:, None], -60, 60)).sum(axis=1)
                share = letters.max(axis=1) / np.maximum(1, letters.sum(axis=1))
                change = np.ones(len(path), bool)
                change[1:] = (path[1:] != path[:-1]) | (text_of[1:] != text_of[:-1])
                heads = np.flatnonzero(change)
                tails = np.append(heads[1:], len(path))[: len(heads)] - 1
                for h, e in zip(heads.tolist(), tails.tolist(), strict=True):
                    i = int(text_of[h])
                    spans[base + i].append({"begin": int(starts[h] - begin[i]), "end": int(ends[e] - begin[i]), "lang": m.languages[path[h]]})
                for i in filled.tolist():
                    pred[base + i] = m.languages[top[i]]
                    shares[base + i] = float(share[i])
                    score[base + i] = float(min(1.0, share[i] * posterior[i]))
            return {"lang_pred": pred, "score": score, "lang_share": shares, "lang_spans": spans}

        return work

    return with_text_columns(docs, text, schema, make, keep)


def identify_documents(docs: DataFrame, keep: list[str] | None = None, **settings) -> DataFrame:
    """`identify` with a model learned from the labelled rows of `docs` that are not held out."""
    return identify(docs, fit(docs.where(~held_out()), **settings), keep=keep)
