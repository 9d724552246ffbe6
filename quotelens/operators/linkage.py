"""Record linkage between quote texts and the alias pool.

Shape of the job: distinct texts -> distinct token sets -> exact prefix-filtered
set join -> score -> best nine aliases per token set -> guards per text -> join
back to the lines. A token set is scored once however many lines repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import textnorm as T
from ..functions.scalars import rnd
from ..functions.similarity import letter_ratio, partial_ratio, token_set_ratio
from ..session import cut, shuffled
from .ingest import numbered

# --- fixed values: thresholds -------------------------------------------------
CUTOFF = 48.0
AUTO, DOUBT = 85.0, 60.0
DEFAULT_CONF = 80
# sets of so many tokens or fewer are spelled out as all of their subsets
SHORT = 7


# --- alias pool ---------------------------------------------------------------

def prepare_aliases(aliases: DataFrame, rules=None) -> DataFrame:
    """``aliases(alias_id, codigo, denominacion, origen, confianza)`` with text and numbers prepared."""
    texts = T.with_prepared(aliases.select("denominacion").distinct(), "denominacion", "norm", rules)
    texts = texts.withColumn("nums", T.numbers(F.col("norm")))
    return shuffled(aliases).join(texts, "denominacion")


def judge_aliases(prepared: DataFrame) -> DataFrame:
    """Adds ``regla``: basura, fragmento, ambiguo or queda (one pass of partial aggregates per text)."""
    conf = F.coalesce(F.nullif("confianza", F.lit(0)), F.lit(DEFAULT_CONF))
    early = (
        F.when(~T.has_word(F.col("norm"), 3), "basura")
        .when(F.coalesce("origen", F.lit("")).isin("migracion_item", "migracion_detalle"), "fragmento")
    )
    rows = prepared.withColumn("conf", conf).withColumn("temprana", early)
    texts = rows.filter(F.col("temprana").isNull()).groupBy("norm").agg(
        F.min("codigo").alias("c_min"), F.max("codigo").alias("c_max"),
        F.max(F.struct("conf", "codigo")).alias("arriba"), F.min(F.struct((-F.col("conf")).alias("conf"), "codigo")).alias("abajo"),
    )
    single = F.col("c_min") == F.col("c_max")
    winner = (F.col("conf") == F.col("arriba.conf")) & (F.col("arriba.codigo") == F.col("abajo.codigo"))
    kept = F.when(single | winner, "queda").otherwise("ambiguo")
    return shuffled(rows).join(texts, "norm", "left").withColumn("regla", F.coalesce("temprana", kept)).drop(
        "temprana", "c_min", "c_max", "arriba", "abajo")


def synthetic_aliases(materials: DataFrame, rules=None) -> DataFrame:
    """The full canonical name of every material, confidence 100, after all learned aliases."""
    name = F.trim(F.concat_ws(" ", F.coalesce("denominacion_principal", F.lit("")), F.coalesce("descripcion", F.lit(""))))
    named = materials.withColumn("denominacion", name).filter("denominacion <> ''")
    split = F.regexp_replace("denominacion", r"(?<=\d)\s*[xX*]\s*(?=\d)", " x ")
    split = F.regexp_replace(split, r"(?<=\d)(?=[A-Za-z])", " ")
    out = T.with_prepared(named.withColumn("partido", split), "partido", "norm", rules)
    return out.withColumn("nums", T.numbers(F.col("norm"))).select(
        (F.col("orden") + F.lit(1 << 40)).alias("alias_id"), "codigo", "denominacion", "norm", "nums",
        F.lit(100).alias("conf"), F.lit(True).alias("sintetico"))


def build_pool(aliases: DataFrame, materials: DataFrame, rules=None) -> DataFrame:
    learned = judge_aliases(prepare_aliases(aliases, rules)).filter("regla = 'queda'").select(
        "alias_id", "codigo", "denominacion", "norm", "nums", "conf", F.lit(False).alias("sintetico"))
    pool = learned.unionByName(synthetic_aliases(materials, rules))
    canon = materials.select("codigo", T.qualifiers(F.concat_ws(" ", "denominacion_principal", "descripcion")).alias("calif_mat"))
    return cut(shuffled(pool).join(canon, "codigo", "left").withColumn(
        "calif", F.array_sort(F.coalesce("calif_mat", T.qualifiers(F.col("denominacion"))))).drop("calif_mat"))


# --- candidates -----------------------------------------------------------------

def signatures(df: DataFrame, norm: str, key: str) -> DataFrame:
    return df.select(T.token_set(F.col(norm)).alias("tokens")).filter(F.size("tokens") > 0).withColumn(
        key, F.array_join("tokens", " ")).dropDuplicates([key])


def _weight(tokens) -> Column:
    return F.aggregate(tokens, F.lit(0), lambda acc, t: acc + F.length(t) + 1)


def _least_shared(total: Column, cutoff: float) -> Column:
    """Shared weight a one-sided score of ``cutoff`` needs when the side weighs ``total``."""
    c = cutoff / 100.0
    return (total * c + 2 * (1 - c)) / (2 - c) - 1e-6


def _one_sided(shared: Column, total: Column) -> Column:
    return 100.0 - 100.0 * (total - shared) / (shared + total - 2)


def rank_tokens(sig: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    """Shared-vocabulary tokens from rare to common, their counts on both sides, and the total weight.

    A token weighs its length plus one; tokens the other side never uses only add weight. A column ``a`` holds the total
    weight where it is not that of the tokens.
    """
    weight = F.col("a") if "a" in sig.columns else _weight(F.col("tokens"))
    spread = sig.select(key, weight.alias("a"), F.explode("tokens").alias("token")).join(vocab, "token")
    packed = spread.groupBy(key).agg(F.first("a").alias("a"), F.array_sort(F.collect_list(F.struct("n_a", "n_t", "token"))).alias("p"))
    part = lambda f: F.transform("p", lambda t: t[f])
    return packed.select(key, "a", part("token").alias("r"), part("n_t").alias("nt"), part("n_a").alias("na"))


def key_pairs(needs: Column, cell: int) -> Column:
    """Keys a match must share: its two rarest common tokens, or one that is enough alone.

    With tokens ordered, (i, j) can be the two rarest common tokens of a match only
    if the weight of i and of everything from j on reaches what the side needs.
    """
    n = F.size("r")
    spots = F.sequence(F.lit(1), n)
    at = lambda c, i: F.element_at(c, i)
    own = lambda i: F.length(at("r", i)) + 1
    grid = lambda c, i, j: (1 + F.floor(F.least(at(c, i), at(c, j)) / cell)).cast("int")

    def entry(i, j, second):
        return F.struct(at("r", i).alias("t1"), second.alias("t2"), grid("nt", i, j).alias("s_t"), grid("na", i, j).alias("s_a"))

    alone = F.transform(F.filter(spots, lambda i: own(i) >= needs), lambda i: entry(i, i, F.lit("")))
    later = lambda i: F.filter(spots, lambda j: (j > i) & (own(i) + _weight(F.slice("r", j, n)) >= needs))
    pairs = F.flatten(F.transform(spots, lambda i: F.transform(later(i), lambda j: entry(i, j, at("r", j)))))
    return F.concat(alone, pairs)


def vocabulary(text_sig: DataFrame, alias_sig: DataFrame) -> DataFrame:
    """Tokens both sides use, with their counts."""
    count = lambda df, n: df.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias(n))
    return count(text_sig, "n_t").join(count(alias_sig, "n_a"), "token")


def candidate_pairs(t: DataFrame, a: DataFrame, cutoff: float = CUTOFF, cell: int = 2000) -> DataFrame:
    """All pairs whose token-set score reaches the cutoff, each once: ``(tkey, akey, score)``.

    ``t`` and ``a`` come from :func:`rank_tokens`. One side offers only the keys a
    match at the cutoff must touch, the other all of its keys; a pair is emitted at
    its two rarest common tokens, and the second direction leaves out what the first
    one emits. Rows of a key are spread over an s_t x s_a grid sized by the token
    counts, so no group of pairs grows beyond one cell.
    """
    grid = ["t1", "t2", "i", "j"]
    parts = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(x, key, needs, own, other, own_n, other_n):
        rows = x.select(key, F.col("r").alias(f"r_{key}"), F.col("a").alias(f"a_{key}"), F.explode_outer(key_pairs(needs, cell)).alias("k")).filter("k is not null")
        rows = rows.select(key, f"r_{key}", f"a_{key}", "k.*").withColumn(own, F.pmod(F.hash(key), F.col(own_n)))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))).drop("s_t", "s_a")
        # few bytes make many pairs, so the number of tasks does not follow the bytes
        return rows.repartition(parts, *grid)

    def joined(left, right, can, keep):
        rows = shuffled(left).join(right, grid).filter(can)
        # the explode of one element keeps the common tokens from being looked for once a use; each weighs its length plus one
        rows = rows.withColumn("c", F.explode(F.array(F.array_intersect("r_tkey", "r_akey"))))
        w = F.length(F.array_join("c", " ")) + 1
        here = (F.get("c", 0) == F.col("t1")) & (F.coalesce(F.get("c", 1), F.lit("")) == F.col("t2"))
        score = F.greatest(_one_sided(w, F.col("a_tkey")), _one_sided(w, F.col("a_akey")))
        return rows.filter(here & keep(w)).select("tkey", "akey", score.alias("score"))

    text_needs, alias_needs = _least_shared(F.col("a_tkey"), cutoff), _least_shared(F.col("a_akey"), cutoff)
    own_needs, anything = _least_shared(F.col("a"), cutoff), F.lit(0)
    t_side, a_side = ("i", "j", "s_t", "s_a"), ("j", "i", "s_a", "s_t")
    # what is shared weighs no more than either side; only a lighter alias needs less than the text
    heavy, lighter = F.col("a_akey") >= text_needs, F.col("a_akey") < F.col("a_tkey")
    by_text = joined(side(t, "tkey", own_needs, *t_side), side(a, "akey", anything, *a_side), heavy, lambda w: w >= text_needs)
    by_alias = joined(side(t, "tkey", anything, *t_side), side(a, "akey", own_needs, *a_side), lighter, lambda w: (w >= alias_needs) & (w < text_needs))
    return by_text.unionByName(by_alias).filter(F.col("score") >= cutoff)


def rank_both(texts: DataFrame, pool: DataFrame, similar: bool = False) -> tuple[DataFrame, DataFrame]:
    ts, as_ = signatures(texts, "norm", "tkey"), signatures(pool, "norm", "akey")
    if similar:
        ts = cut(with_similar_words(ts, as_, "tkey"))
    vocab = cut(vocabulary(ts, as_))
    numbered_ = lambda df, key, n: cut(rank_tokens(df, key, vocab).withColumn(n, F.monotonically_increasing_id()))
    return numbered_(ts, "tkey", "tid"), numbered_(as_, "akey", "aid")


def all_pairs(texts: DataFrame, pool: DataFrame, cutoff: float) -> DataFrame:
    return candidate_pairs(*rank_both(texts, pool), cutoff)


def _grams(token: Column) -> Column:
    """Pairs of neighbouring letters of the padded token; the k-th of equal ones is numbered k."""
    padded = F.concat(F.lit("^"), token, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(token) + 1), lambda i: F.substring(padded, i, F.lit(2)))
    return F.transform(pairs, lambda g, i: F.struct(g.alias("g"), F.size(F.filter(F.slice(pairs, 1, i + 1), lambda x: x == g)).alias("k")))


def similar_words(words: DataFrame, known: DataFrame, least: float = 70.0) -> DataFrame:
    """All pairs of a token and another known token with a letter ratio of ``least`` or more: ``(token, parecido)``.

    A q-gram count filter: tokens of n and m letters within that ratio differ by d letters at most, which leaves them
    (n + 1) - (3d + n - m) / 2 pairs of neighbouring letters in common, and the same from the other side. So each token
    offers only its rarest pairs, one more than it can lose, for every length of partner that is possible. ``least`` of
    two thirds or more leaves a pair in common at every length, so nothing is lost; what meets is verified.
    """
    share = (100.0 - least) / 100.0
    reach = (1 + share) / (1 - share)

    def needed(n, m):
        """Pairs in common that partners of these lengths must have, null where no partner has the length."""
        most = F.floor((n + m) * share + 1e-9)
        d = most - F.pmod(most - F.abs(n - m), F.lit(2))
        common = F.greatest(n + 1 - (3 * d + n - m) / 2, m + 1 - (3 * d + m - n) / 2)
        return F.when(d >= F.abs(n - m), F.greatest(common, F.lit(1)).cast("int"))

    own = words.select("token").distinct()
    other = known.select("token").distinct()
    gram = lambda df: df.withColumn("x", F.explode(_grams(F.col("token")))).select("token", "x.g", "x.k")
    seen = gram(own.unionByName(other).distinct()).groupBy("g", "k").agg(F.count("*").alias("veces"))

    def offered(df, name, mine, theirs):
        rare = gram(df).join(seen, ["g", "k"]).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("veces", "g", "k"))).alias("orden"))
        n = F.length("token")
        lengths = F.sequence(F.ceil(n / reach - 1e-9).cast("int"), F.floor(n * reach + 1e-9).cast("int"))
        rows = rare.select(F.col("token").alias(name), n.alias(mine), F.explode(lengths).alias(theirs), "orden")
        need = needed(F.col(mine), F.col(theirs))
        rows = rows.withColumn("x", F.explode(F.when(need.isNotNull(), F.slice("orden", 1, F.size("orden") - need + 1))))
        return rows.select(name, mine, theirs, "x.g", "x.k")

    met = shuffled(offered(own, "token", "n", "m")).join(offered(other, "parecido", "m", "n"), ["g", "k", "n", "m"])
    pairs = met.filter(F.col("token") != F.col("parecido")).select("token", "parecido").distinct()
    return pairs.filter(letter_ratio("token", "parecido") >= least)


def with_similar_words(sig: DataFrame, other: DataFrame, key: str, least: float = 70.0) -> DataFrame:
    """Signatures with the other side's similar tokens beside their own; ``a`` keeps the weight of their own."""
    spread = sig.select(key, F.explode("tokens").alias("token"))
    links = similar_words(spread, other.select(F.explode("tokens").alias("token")), least)
    more = spread.join(links, "token").groupBy(key).agg(F.collect_set("parecido").alias("mas"))
    tokens = F.array_distinct(F.concat("tokens", F.coalesce("mas", F.array().cast("array<string>"))))
    return sig.withColumn("a", _weight(F.col("tokens"))).join(more, key, "left").withColumn("tokens", tokens).drop("mas")


def subsets(tokens: Column) -> Column:
    """All sets of the tokens in their order, each written with a blank before every token, so that its length is its weight."""
    none = F.array(F.lit(""))
    return F.aggregate(tokens, none, lambda acc, t: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.lit(" "), t))))


def alias_lists(a: DataFrame, window: int) -> DataFrame:
    """For each set of tokens the first ``window`` aliases of each total weight that have all of them: ``(s, es)``.

    ``a`` is :func:`rank_tokens` with ``aid`` and the confidence and id of the first copy. Aliases that meet a text in the
    same tokens differ only in weight and order, so no more of them can be among the best of any text.
    """
    rows = a.select("a", "conf", "alias_id", "aid", F.explode(subsets(F.col("r"))).alias("s")).filter("s <> ''")
    w = Window.partitionBy("s", "a").orderBy(F.desc("conf"), F.asc("alias_id"))
    first = rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= window)
    # lightest first, then in the order of the pool
    entry = F.struct("a", F.col("conf").isNull().alias("nulo"), (-F.col("conf")).alias("menos"), "alias_id", "aid", "conf")
    return first.groupBy("s").agg(F.array_sort(F.collect_list(entry)).alias("es"))


def listed_pairs(t: DataFrame, lists: DataFrame, cutoff: float, window: int) -> DataFrame:
    """Pairs of texts and listed aliases at the cutoff that can be among a text's best ``window``: ``(tid, aid, score, conf, alias_id)``.

    The score falls with the lighter total of the two sides. At one set of tokens a text so meets first the aliases lighter
    than itself, the lightest first, then all others alike. A pair comes once for each set of tokens both have, with its
    true score at the largest.
    """
    w = F.length("s")
    lighter = F.filter("es", lambda e: e["a"] < F.col("at"))
    others = F.array_sort(F.transform(F.filter("es", lambda e: e["a"] >= F.col("at")), lambda e: F.struct(
        e["nulo"].alias("nulo"), e["menos"].alias("menos"), e["alias_id"].alias("alias_id"), e["aid"].alias("aid"), e["conf"].alias("conf"), F.col("at").alias("a"))))
    flat = lambda es: F.transform(F.slice(es, 1, window), lambda e: F.struct(
        e["a"].alias("a"), e["conf"].alias("conf"), e["alias_id"].alias("alias_id"), e["aid"].alias("aid")))
    parts = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = t.select("tid", F.col("a").alias("at"), F.explode(subsets(F.col("r"))).alias("s")).filter("s <> ''")
    needs = _least_shared(F.col("at"), cutoff)
    heavy = shuffled(own.filter(w >= needs)).join(lists, "s").select("tid", "s", F.slice(F.concat(flat(lighter), flat(others)), 1, window).alias("es"))
    # below what the text needs, only an alias that is lighter and has nearly all of its tokens there
    near = lists.select("s", F.filter("es", lambda e: w >= _least_shared(e["a"], cutoff)).alias("es")).filter(F.size("es") > 0)
    light = shuffled(own.filter(w < needs)).join(near, "s").select("tid", "s", flat(lighter).alias("es"))
    rows = heavy.unionByName(light).select("tid", w.alias("w"), F.explode("es").alias("e"))
    rows = rows.select("tid", "e.aid", _one_sided(F.col("w"), F.col("e.a")).alias("score"), "e.conf", "e.alias_id").filter(F.col("score") >= cutoff)
    # rows of a text stay in one task for its best ones
    return rows.repartition(parts, "tid").groupBy("tid", "aid").agg(F.max("score").alias("score"), F.first("conf").alias("conf"), F.first("alias_id").alias("alias_id"))


def letter_pairs(t: DataFrame, a: DataFrame, similar_cutoff: float, cutoff: float, window: int, cell: int = 2048) -> DataFrame:
    """The pairs of :func:`candidate_pairs` that can be among a text's best ``window`` by letters: ``(tid, aid, score, conf, alias_id)``.

    Where most texts and aliases share a word, most pairs are candidates. Here blocks of texts and aliases meet, tokens in
    common are counted for a whole block, and a pair is scored only where its upper bound reaches the text's ``window``-th
    score in the block. The number of bounds is that of all pairs.
    """
    parts = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s_t, s_a = (max(1, -(-df.count() // cell)) for df in (t, a))
    block = lambda df, key, mine, n, other, m: df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).repartition(parts, "i", "j").groupBy("i", "j")
    left = block(t.select("tid", "tkey", "a", "r"), "tid", "i", s_t, "j", s_a)
    right = block(a.select("aid", "akey", "a", "r", "conf", "alias_id"), "aid", "j", s_a, "i", s_t)
    kinds = dict(a.dtypes) | dict(t.dtypes)
    out = ", ".join(["tid long", "aid long", "score double", f"conf {kinds['conf']}", f"alias_id {kinds['alias_id']}"])
    return left.cogroup(right).applyInArrow(_letter_best(similar_cutoff, cutoff, window), out)


def _letter_best(similar_cutoff: float, cutoff: float, window: int, at_once: int = 1_000_000):
    import numpy as np
    import pyarrow as pa

    from ..functions.similarity import Words, score_bounds, token_set_scores

    one_sided = lambda shared, total: 100.0 - 100.0 * (total - shared) / np.maximum(shared + total - 2, 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, aliases = left.column("tkey").to_pylist(), right.column("akey").to_pylist()
        own, theirs = left.column("r").to_pylist(), right.column("r").to_pylist()
        weigh, heavy = left.column("a").to_numpy(), right.column("a").to_numpy()
        step = max(1, at_once // max(1, len(aliases)))
        rows, cols, scores = [], [], []
        for at in range(0, len(texts) if aliases else 0, step):
            x = texts[at : at + step]
            words = Words(own[at : at + step], theirs)
            shared = words.common(words.size + 1 if words.place else None)
            tokens = np.maximum(one_sided(shared, weigh[at : at + step, None]), one_sided(shared, heavy[None, :]))
            bound = score_bounds(x, aliases)[0] + 1e-6
            bound[(shared <= 0) | (tokens < similar_cutoff) | (bound < cutoff)] = -np.inf
            score = np.full(bound.shape, -np.inf)
            n = min(window, len(aliases))
            while True:
                least = np.maximum(np.partition(score, len(aliases) - n, axis=1)[:, len(aliases) - n], -1.0 if n == window else -np.inf)
                bound[bound < least[:, None]] = -np.inf
                live = np.flatnonzero(np.isfinite(bound).any(axis=1))
                if not len(live):
                    break
                best = np.argpartition(-bound[live], n - 1, axis=1)[:, :n]
                i, j = np.repeat(live, n), best.ravel()
                keep = np.isfinite(bound[i, j])
                i, j = i[keep], j[keep]
                score[i, j] = token_set_scores([x[k] for k in i.tolist()], [aliases[k] for k in j.tolist()])
                bound[i, j] = -np.inf
            i, j = np.nonzero((score >= np.maximum(least, cutoff)[:, None]) & np.isfinite(score))
            rows.append(i + at)
            cols.append(j)
            scores.append(score[i, j])
        i, j, k = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, cols, scores))
        l, r = left.take(pa.array(i)), right.take(pa.array(j))
        names = ["tid", "aid", "score", "conf", "alias_id"]
        return pa.table([l.column("tid"), r.column("aid"), pa.array(k, pa.float64()), r.column("conf"), r.column("alias_id")], names=names)

    return run


def _crowded(t: DataFrame, a: DataFrame) -> bool:
    """Whether texts and aliases share words so often that half of all pairs can meet."""
    met = a.agg(F.sum(F.aggregate("nt", F.lit(0.0), lambda acc, n: acc + n))).first()[0] or 0.0
    return met >= 0.5 * t.count() * a.count()


def _has(df: DataFrame) -> bool:
    return not df.isEmpty()


def best_aliases(texts: DataFrame, pool: DataFrame, window: int = 9, cutoff: float = CUTOFF, scorer: str = "token",
                 stages: tuple[float, ...] = (92.0, 86.0, 80.0, 64.0), similar_cutoff: float = CUTOFF) -> DataFrame:
    """Best ``window`` aliases per token set; ties by confidence, then pool order.

    A text that already has ``window`` aliases at a high cutoff cannot gain from a
    lower one, so only the others go on to the next stage. The result is that of
    one pass at ``cutoff``. Sets of at most ``SHORT`` tokens meet through :func:`alias_lists`, so that texts with very many
    partners get only those that can be their best; longer ones as pairs of :func:`candidate_pairs`. Equal token sets stand
    for their first copy until each text has its best sets. The character scorer may lift any candidate, so it
    runs in one stage on all pairs whose tokens reach ``similar_cutoff`` when a token counts
    as shared also where a similar one stands (see :func:`similar_words`). A value below
    ``cutoff`` finds more, as letters of unlike words add to the score, and costs more pairs.
    """
    order = (F.desc("conf"), F.asc("alias_id"))
    # an alias set can give at most `window` of its copies
    p = pool.withColumn("akey", F.array_join(T.token_set(F.col("norm")), " "))
    p = cut(p.withColumn("copia", F.row_number().over(Window.partitionBy("akey").orderBy(*order))).filter(F.col("copia") <= window))
    t, a = rank_both(texts, pool, similar=scorer == "indel")
    a = cut(shuffled(a).join(p.filter("copia = 1").select("akey", "conf", "alias_id"), "akey"))
    copies = cut(shuffled(p.select("akey", "conf", "alias_id")).join(a.select("akey", "aid"), "akey").drop("akey"))
    w = Window.partitionBy("tid").orderBy(F.desc("score"), *order)

    def first(rows):
        return rows.withColumn("previo", F.row_number().over(w)).filter(F.col("previo") <= window)

    short, crowded = F.size("r") <= SHORT, scorer == "indel" and _crowded(t, a)
    if scorer != "indel":
        few, many = a.filter(short), a.filter(~short)
        lists, any_few, any_many, any_long = cut(alias_lists(few, window)), _has(few), _has(many), _has(t.filter(~short))
    ids = lambda df, key, own: df.select(F.col(own).alias(key), "a", "r", "nt", "na")

    def stage(open_texts, level_cut):
        """Pairs at the cutoff, each once, with all that can be among a text's best."""
        if scorer == "indel" and crowded:
            return letter_pairs(open_texts, a, similar_cutoff, level_cut, window)
        if scorer == "indel":
            parts = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            pairs = candidate_pairs(open_texts, a, similar_cutoff)
            pairs = pairs.repartition(parts, "tkey", "akey").withColumn("score", token_set_ratio("tkey", "akey")).filter(F.col("score") >= level_cut)
            return shuffled(pairs).join(a.select("akey", "aid", "conf", "alias_id"), "akey").join(open_texts.select("tkey", "tid"), "tkey").drop("tkey", "akey")
        found = []
        if any_few:
            found.append(listed_pairs(open_texts.filter(short), lists, level_cut, window))
        for wanted, ts, as_ in ((any_many, open_texts.filter(short), many), (any_long, open_texts.filter(~short), a)):
            if wanted:
                pairs = candidate_pairs(ids(ts, "tkey", "tid"), ids(as_, "akey", "aid"), level_cut).withColumnsRenamed({"tkey": "tid", "akey": "aid"})
                found.append(shuffled(pairs).join(a.select("aid", "conf", "alias_id"), "aid"))
        out = found[0] if found else open_texts.limit(0).select("tid", F.lit(0).cast("long").alias("aid"), F.lit(0.0).alias("score"), F.lit(0).alias("conf"), F.lit(0).cast("long").alias("alias_id"))
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    found, open_texts = None, t
    for level_cut in (*([] if scorer == "indel" else stages), cutoff):
        # only ids cross the top-n shuffles; alias texts join the few survivors
        sets = first(stage(open_texts, level_cut)).select("tid", "aid", "score")
        top = cut(first(shuffled(sets).join(copies, "aid").drop("aid")).drop("conf"))
        if level_cut == cutoff:
            found = top if found is None else found.unionByName(top)
            break
        full = top.filter(F.col("previo") == window).select("tid")
        done = shuffled(top).join(full, "tid", "left_semi")
        found = done if found is None else found.unionByName(done)
        open_texts = shuffled(open_texts).join(full, "tid", "left_anti")
    named = shuffled(found).join(t.select("tid", "tkey"), "tid").drop("tid")
    return shuffled(named).join(p.drop("akey", "copia"), "alias_id")


# --- guards -----------------------------------------------------------------------

def brand_rule(score: Column, text_groups: Column, alias_groups: Column) -> Column:
    """Groups marked ``~`` only separate; they never add the bonus."""
    shared = F.array_intersect(text_groups, alias_groups)
    lifting = F.filter(shared, lambda g: ~F.startswith(g, F.lit("~")))
    foreign = (F.size(shared) == 0) & (F.size(text_groups) > 0) & (F.size(alias_groups) > 0)
    return F.when(F.size(lifting) > 0, F.least(F.lit(100.0), score + 6)).when(foreign, F.least(score, F.lit(84.0))).otherwise(score)


def qualifier_rule(score: Column, text_qual: Column, alias_qual: Column) -> Column:
    return F.when(F.array_sort(text_qual) != F.array_sort(alias_qual), F.least(score, F.lit(84.0))).otherwise(score)


def fragment_rule(score: Column, text_norm: Column, alias_norm: Column, synthetic: Column, alias_nums: Column) -> Column:
    nt, na = F.size(F.split(text_norm, " ")), F.size(F.split(alias_norm, " "))
    whole_name = synthetic & (F.size(alias_nums) > 0) & (nt >= na)
    return F.when((F.least(nt, na) <= 2) & (text_norm != alias_norm) & ~whole_name, F.least(score, F.lit(84.0))).otherwise(score)


def number_rule(score: Column, text_nums: Column, alias_nums: Column) -> Column:
    lost = T.missing_numbers(alias_nums, text_nums)
    agree = (F.size(alias_nums) > 0) & (F.size(alias_nums) == F.size(text_nums))
    return (
        F.when(lost > 0, F.least(score, F.greatest(F.lit(60.0), 84.0 - 8.0 * lost)))
        .when(agree & (score < AUTO), F.least(score + 4, F.lit(84.9)))
        .otherwise(score)
    )


def level(score: Column) -> Column:
    return F.when(score >= AUTO, "automatico").when(score >= DOUBT, "dudoso").otherwise("sin_match")


def band(score: Column) -> Column:
    """Bands of the first scorer."""
    return F.when(score >= 75, "OK").when(score >= 60, "REVISAR").otherwise("SIN MATCH")


def prepare_texts(texts: DataFrame, rules=None) -> DataFrame:
    """Distinct raw ``texto`` with everything the guards look at."""
    t = T.with_prepared(texts.select("texto").filter("texto <> ''").distinct(), "texto", "norm", rules).filter("norm <> ''")
    return t.withColumn("nums", T.numbers(F.col("norm"))).withColumn("calif", T.qualifiers(F.col("texto"))).withColumn(
        "tkey", F.array_join(T.token_set(F.col("norm")), " "))


def match(texts: DataFrame, pool: DataFrame, brands: DataFrame, top_n: int = 3, rules=None, scorer: str = "token") -> DataFrame:
    """Ranked matches per distinct text: rank, codigo, denominacion, score, nivel, conf."""
    t = cut(prepare_texts(texts, rules))
    top = best_aliases(t, pool, window=3 * top_n, scorer=scorer)
    t = T.with_brand_groups(t, "texto", "texto", brands, "g_texto")
    names = T.with_brand_groups(pool.select("denominacion").distinct(), "denominacion", "denominacion", brands, "g_alias")
    pairs = shuffled(top).join(names, "denominacion").select(
        "tkey", "previo", "score", "alias_id", "codigo", "denominacion", F.col("norm").alias("a_norm"),
        F.col("nums").alias("a_nums"), "conf", "sintetico", F.col("calif").alias("a_calif"), "g_alias")
    rows = shuffled(t).join(pairs, "tkey")
    s = brand_rule(F.col("score"), F.col("g_texto"), F.col("g_alias"))
    rows = rows.withColumn("score", s)
    rows = rows.withColumn("score", qualifier_rule(F.col("score"), F.col("calif"), F.col("a_calif")))
    rows = rows.withColumn("score", fragment_rule(F.col("score"), F.col("norm"), F.col("a_norm"), F.col("sintetico"), F.col("a_nums")))
    rows = rows.withColumn("score", number_rule(F.col("score"), F.col("nums"), F.col("a_nums")))
    rows = rows.withColumn("nivel", level(F.col("score"))).withColumn("score", rnd(F.col("score"), 1))
    w = Window.partitionBy("texto").orderBy(F.desc("score"), F.desc("conf"), F.asc("previo"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n).select(
        "texto", "rank", "codigo", "denominacion", "score", "nivel", "conf")


# --- after the match -----------------------------------------------------------------

def alternatives(matches: DataFrame) -> DataFrame:
    """Ranks after the best, one per code, without the best code. At most top_n rows per text."""
    best = matches.filter("rank = 1").select("texto", F.col("codigo").alias("mejor"))
    later = matches.filter("rank > 1").join(best, "texto").filter(F.col("codigo") != F.col("mejor"))
    return later.groupBy("texto", "codigo").agg(
        F.min_by(F.struct("rank", "score", "denominacion"), "rank").alias("m")).select("texto", "codigo", "m.*")


def link_lines(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """Best match of every line; lines without candidates keep nulls."""
    best = matches.filter("rank = 1").select("texto", F.col("codigo").alias("codigo_match"), "denominacion", "score", "nivel", "conf")
    return shuffled(lines).join(best, "texto", "left").withColumn("nivel", F.coalesce("nivel", F.lit("sin_match")))


def route(nivel: Column, suspicious: Column, ambiguous: Column) -> Column:
    return (
        F.when(nivel == "sin_match", "SIN_MATCH")
        .when((nivel == "automatico") & ~suspicious & ~ambiguous, "MATCH")
        .otherwise("REVISAR")
    )


def match_stats(routed: DataFrame, *by: str) -> DataFrame:
    bucket = F.col("estado")
    return routed.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(bucket == "MATCH").alias("automatico"),
        F.count_if(bucket == "REVISAR").alias("dudoso"), F.count_if(bucket == "SIN_MATCH").alias("sin_match"),
    ).withColumn("pct_automatico", rnd(100.0 * F.col("automatico") / F.greatest(F.lit(1), F.col("total")), 1))


def readjudicate(linked: DataFrame) -> DataFrame:
    """Compare the stored code with what the text matches today."""
    verdict = (
        F.when(T.is_junk(F.col("texto")), "BASURA")
        .when((F.col("codigo_match") == F.col("codigo_actual")) & (F.col("score") >= AUTO), "OK")
        .when(F.col("codigo_match") == F.col("codigo_actual"), "DUDOSO")
        .otherwise("ERRADO")
    )
    return linked.withColumn("veredicto", verdict)


def triage(pending: DataFrame, matches: DataFrame, max_prices: int | None = None) -> DataFrame:
    """One decision per distinct pending text: its rows, suppliers, prices, up to three candidates, band and place in the list.

    ``pending(id, texto, proveedor, precio)``. The ids are in :func:`triage_members`. Suppliers are a set of the supplier
    dimension, ``max_prices`` keeps the lowest prices (default: all distinct ones). The list runs by band, then best score.
    """
    p = pending.withColumn("texto", F.lower(F.trim("texto")))
    head = p.groupBy("texto").agg(
        F.count("*").alias("n_filas"), F.min("id").alias("primer_id"),
        F.array_sort(F.collect_set(F.coalesce(F.col("proveedor").cast("string"), F.lit("?")))).alias("proveedores"),
        F.array_sort(F.collect_set(F.when(F.col("precio") != 0, rnd(F.col("precio"))))).alias("precios_vistos"))
    if max_prices is not None:
        head = head.withColumn("precios_vistos", F.slice("precios_vistos", 1, max_prices))
    found = matches.groupBy("texto").agg(
        F.array_sort(F.collect_list(F.struct("rank", "codigo", "denominacion", "score", "nivel"))).alias("candidatos"))
    out = head.join(found, "texto", "left")
    best = F.get("candidatos", F.lit(0))
    score = F.coalesce(best["score"], F.lit(0.0))
    out = out.withColumns({"codigo": best["codigo"], "score": best["score"],
                           "banda": F.when(score >= AUTO, "A_fuerte").when(score >= DOUBT, "B_dudoso").otherwise("C_sin"), "menos": -score})
    return numbered(out, "banda", "menos", "texto", out="puesto").drop("menos")


def triage_members(pending: DataFrame) -> DataFrame:
    """``(texto, id)``: the rows behind each decision."""
    return pending.select(F.lower(F.trim("texto")).alias("texto"), "id")


def resolve_keys(decisions: DataFrame, pending: DataFrame) -> DataFrame:
    """Exact key first, else a prefix in either direction, earliest pending key wins.

    ``decisions(k)``, ``pending(kk, pos)`` with one row per key. Prefixes are spelled
    out on both sides, so every comparison is an equality join.
    """
    def prefixes(col):
        return F.explode(F.transform(F.sequence(F.lit(1), F.length(col)), lambda i: F.substring(F.col(col), F.lit(1), i)))

    d = decisions.filter("k <> ''").select("k").distinct()
    p = pending.filter("kk <> ''").groupBy("kk").agg(F.min("pos").alias("pos"))
    down = shuffled(p.select("kk", "pos", prefixes("kk").alias("k"))).join(d, "k")
    up = shuffled(d.select("k", prefixes("k").alias("kk"))).join(p, "kk").filter("k <> kk")
    both = down.select("k", "kk", "pos").unionByName(up.select("k", "kk", "pos"))
    return both.groupBy("k").agg(F.min_by("kk", F.struct((F.col("k") != F.col("kk")).alias("lejos"), "pos")).alias("kk"))


# --- first-generation scorer -----------------------------------------------------------

def v1_scope(lines: DataFrame, materials: DataFrame) -> DataFrame:
    """Category of the line as search scope; fewer than five items open the whole catalogue."""
    sizes = materials.groupBy(T.normalize(F.col("rubro")).alias("rubro_norm")).agg(F.count("*").alias("n_rubro"))
    known = materials.select(F.col("codigo").alias("confirmado"), T.normalize(F.col("rubro")).alias("rubro_conf"))
    x = lines.withColumn("rubro_norm", T.normalize(F.col("rubro_prov"))).join(sizes, "rubro_norm", "left").join(known, "confirmado", "left")
    extra = F.when(F.col("rubro_conf").isNotNull() & (F.col("rubro_conf") != F.col("rubro_norm")), 1).otherwise(0)
    n = F.coalesce("n_rubro", F.lit(0)) + extra
    return x.withColumn("n_candidatos", n).withColumn("alcance", F.when(n < 5, "todo").otherwise("rubro")).drop("n_rubro", "rubro_conf")


def confirm_codes(lines: DataFrame, equivalences: DataFrame) -> DataFrame:
    """``equivalences(clave, cod_int)``: by supplier code first, then by text."""
    by_code = equivalences.select(F.col("clave").alias("cod_prov"), F.col("cod_int").alias("por_codigo"))
    by_text = equivalences.select(F.col("clave").alias("desc_prov"), F.col("cod_int").alias("por_texto"))
    # the lines, which are wide, are shuffled once; the first lookup runs on their distinct keys
    keys = lines.select("cod_prov", "desc_prov").distinct()
    found = keys.join(by_code, "cod_prov", "left").join(by_text, "desc_prov", "left").select(
        F.col("cod_prov").alias("k_cod"), F.col("desc_prov").alias("k_desc"), F.coalesce("por_codigo", "por_texto").alias("confirmado"))
    same = F.col("cod_prov").eqNullSafe(F.col("k_cod")) & F.col("desc_prov").eqNullSafe(F.col("k_desc"))
    return lines.join(found.filter("confirmado is not null"), same, "left").drop("k_cod", "k_desc")


def boost(score: Column, code: Column, confirmed: Column) -> tuple[Column, Column]:
    same = F.coalesce(code == confirmed, F.lit(False))
    return F.when(same, F.greatest(score, F.lit(90.0))).otherwise(score), F.when(same, "EQUIV").otherwise("IA")


def v1_read(df: DataFrame, text: str) -> DataFrame:
    """With what the first scorer looks at in a text, read once a text: numbers, brand groups and keywords."""
    return df.withColumns({"nums": T.numbers(F.col(text)), "grupos": T.brand_groups_v1(F.col(text)), "claves": T.keywords_in(F.col(text))})


def v1_items(materials: DataFrame) -> DataFrame:
    """``materials(codigo, rubro, marca, nombre)`` as the first scorer reads them."""
    return materials.select("codigo", T.normalize(F.col("rubro")).alias("rubro_item"), "marca", T.normalize(F.col("nombre")).alias("m_text"))


def v1_pairs(lines: DataFrame, items: DataFrame, top_n: int | None = None, cell: int = 1024) -> DataFrame:
    """Every line with every item of its scope: ``lines(linea, p, rubro_norm, alcance, confirmado)``.

    Lines of a known category meet its items, a confirmed item joins them from elsewhere, and lines without a usable category
    meet the whole catalogue. Equal texts of one category are scored once by the caller. Lines and catalogue are cut into
    blocks, so neither a large category nor the whole catalogue meets its lines in one task. With ``top_n`` a block
    leaves out the pairs that cannot be among a line's best (:func:`v1_best`).
    """
    scope = lambda df, key, own: df.select(*[c for c in df.columns if c != key], F.col(key).alias("grupo"), F.lit(own).alias("alcance"))
    slim = v1_read(lines.select("linea", "p", "rubro_norm", "alcance", "confirmado"), "p")
    read = v1_read(items, "m_text")
    own = scope(slim.filter("alcance = 'rubro'").drop("alcance"), "rubro_norm", "rubro")
    every = slim.filter("alcance = 'todo'").drop("alcance", "rubro_norm").withColumns({"grupo": F.lit(""), "alcance": F.lit("todo")})
    left = own.unionByName(every)
    right = scope(read, "rubro_item", "rubro").unionByName(read.drop("rubro_item").withColumns({"grupo": F.lit(""), "alcance": F.lit("todo")}))
    keys = ["alcance", "grupo"]
    count = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count("*") / cell).cast("int").alias(n))
    sizes = count(left, "s_l").join(count(right, "s_i"), keys)
    dealt = lambda df, key, mine, other, n, m: df.join(sizes, keys).withColumn(mine, F.pmod(F.xxhash64(key), F.col(n)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("s_l", "s_i")
    block = [*keys, "i", "j"]
    l, r = dealt(left, "linea", "i", "j", "s_l", "s_i"), dealt(right, "codigo", "j", "i", "s_i", "s_l")
    cols = ["linea", "p", "confirmado", "codigo", "m_text", "marca"]
    if top_n is None:
        met = l.select(*block, "linea", "p", "confirmado").join(r.select(*block, "codigo", "m_text", "marca"), block)
    else:
        parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        kinds = dict(l.dtypes) | dict(r.dtypes)
        # blocks are few in bytes and dear to score, so the number of tasks does not follow the bytes
        met = l.repartition(parts, *block).groupBy(*block).cogroup(r.withColumn("brand", F.upper(F.coalesce("marca", F.lit("")))).repartition(parts, *block).groupBy(*block)).applyInArrow(
            v1_best(top_n), ", ".join(f"{c} {kinds[c]}" for c in cols))
    other = slim.filter("alcance = 'rubro'").join(items, F.col("confirmado") == F.col("codigo")).filter(~F.col("rubro_norm").eqNullSafe(F.col("rubro_item")))
    return met.select(*cols).unionByName(other.select(*cols))


def v1_best(top_n: int, at_once: int = 1_000_000):
    """For a block of lines and items the pairs that can be among a line's best ``top_n``.

    Each pair gets an upper bound of its score, from letters, words, numbers, brands and keywords. The pairs of the highest bounds are
    scored, and what cannot reach a line's ``top_n``-th score, to the tenth it is rounded to, goes.
    """
    import numpy as np
    import pyarrow as pa

    from ..functions.similarity import Words, partial_scores, score_bounds, token_set_scores

    strong_words = set(T.V.DISTINCTIVE)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = ({c: t.column(c).to_pylist() for c in names} for t, names in (
            (left, ("p", "nums", "grupos", "claves", "confirmado")), (right, ("m_text", "nums", "grupos", "claves", "brand", "codigo"))))
        marcas, which = np.unique(np.array(b["brand"], dtype=object).astype(str), return_inverse=True)
        step = max(1, at_once // max(1, right.num_rows))
        rows, cols = [], []
        for at in range(0, left.num_rows if right.num_rows else 0, step):
            part = slice(at, at + step)
            p = a["p"][part]
            sets, windows = score_bounds(p, b["m_text"])
            texts = lambda x: [[str(w) for w in ws] for ws in x]
            nums, groups, keys = (Words(texts(a[c][part]), texts(b[c])) for c in ("nums", "grupos", "claves"))
            strong = np.array([w in strong_words for w in keys.place], np.float32) if keys.place else np.zeros(1, np.float32)
            single = (keys.left @ strong)[:, None] + (keys.right @ strong)[None, :] - 2 * keys.common(strong)
            own = np.array([[m not in ("", "VARIOS") and m in x for m in marcas.tolist()] for x in p], bool)[:, which]
            extra = 20 * nums.common() / np.maximum(nums.left.sum(axis=1), 1)[:, None] + np.where(own, 8, np.where(groups.common() > 0, 5, 0)) + 4 * keys.common() - 6 * single
            bound = np.clip(0.5 * sets + 0.3 * windows + extra, 0, 100)

            def scored(i, j):
                x, y = [p[k] for k in i.tolist()], [b["m_text"][k] for k in j.tolist()]
                return np.clip(0.5 * token_set_scores(x, y) + 0.3 * partial_scores(x, y) + extra[i, j], 0, 100)

            def floor_of(score):
                """The `top_n`-th score of each line so far, less what rounding can hide."""
                n = min(top_n, score.shape[1])
                return np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n] - 0.1 - 1e-6 if score.shape[1] >= top_n else np.full(len(score), -1.0)

            first = min(top_n + 1, bound.shape[1])
            best = np.argpartition(-bound, first - 1, axis=1)[:, :first]
            score = np.full(bound.shape, -np.inf)
            i = np.repeat(np.arange(len(p)), first)
            score[i, best.ravel()] = scored(i, best.ravel())
            i, j = np.nonzero((bound + 1e-6 >= floor_of(score)[:, None]) & np.isinf(score))
            if len(i):
                score[i, j] = scored(i, j)
            confirmed = np.array([[c is not None and c == d for d in b["codigo"]] for c in a["confirmado"][part]], bool) if any(c is not None for c in a["confirmado"][part]) else np.zeros(bound.shape, bool)
            i, j = np.nonzero((score >= floor_of(score)[:, None]) & ~np.isinf(score) | confirmed)
            rows.append(i + at)
            cols.append(j)
        i, j = (pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (rows, cols))
        l, r = left.select(["linea", "p", "confirmado"]).take(i), right.select(["codigo", "m_text", "marca"]).take(j)
        return pa.table([*l.columns, *r.columns], names=[*l.column_names, *r.column_names])

    return run


def match_v1(lines: DataFrame, materials: DataFrame, equivalences: DataFrame, top_n: int = 3) -> DataFrame:
    """First-generation match as a whole: confirmed code, scope, score, boost and the best ``top_n`` of each line with their origin.

    ``lines(linea, texto, cod_prov, rubro_prov)``, ``materials(codigo, rubro, marca, nombre)``,
    ``equivalences(clave, cod_int)`` with one row per key. Lines with equal text, category and confirmed code are scored once.
    """
    x = confirm_codes(lines.withColumn("desc_prov", F.col("texto")), equivalences)
    x = v1_scope(x, materials).withColumn("p", T.normalize(F.col("texto")))
    keys = ["p", "rubro_norm", "alcance", "confirmado"]
    once = cut(x.groupBy(*keys).agg(F.min("linea").alias("linea")))
    # pairs are few in bytes and dear to score, so they are spread over all partitions
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = score_v1(v1_pairs(once, v1_items(materials), top_n).repartition(parts, "linea", "codigo"))
    score, origin = boost(F.col("score"), F.col("codigo"), F.col("confirmado"))
    w = Window.partitionBy("linea").orderBy(F.desc("score"), "codigo")
    best = scored.select("linea", "codigo", score.alias("score"), origin.alias("origen")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
    heads = once.withColumnRenamed("linea", "cabeza")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"h.{k}"))
    named = x.alias("x").join(heads.alias("h"), same).select("x.linea", "h.cabeza")
    out = named.join(best.withColumnRenamed("linea", "cabeza"), "cabeza", "left").drop("cabeza")
    return out.withColumn("accion", band(F.coalesce("score", F.lit(0.0))))


def score_v1(pairs: DataFrame) -> DataFrame:
    """``pairs(p, m_text, marca)`` already normalised upper case; adds ``score`` 0-100."""
    p, m = F.col("p"), F.col("m_text")
    base = token_set_ratio(p, m) * 0.5 + partial_ratio(p, m) * 0.3
    nums = T.number_overlap(T.numbers(p), T.numbers(m)) * 20
    marca = F.upper(F.coalesce("marca", F.lit("")))
    own = ~marca.isin("", "VARIOS") & F.contains(p, marca)
    brand = F.when(own, 8).when(F.arrays_overlap(T.brand_groups_v1(p), T.brand_groups_v1(m)), 5).otherwise(0)
    total = base + nums + brand + T.keyword_bonus(p, m)
    return pairs.withColumn("score", rnd(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)), 1))
