"""Scorers against hand-computed values, guards, and the staged search against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quotelens.functions.similarity import lcs_lengths, partial_score, token_set_score, token_set_scores
from quotelens.operators import linkage as M
from quotelens.session import cut

NO_BRANDS = "marca string, grupo string"


def test_token_set_score_by_hand():
    assert token_set_score("cano 20", "cano 20 gas") == 100
    # no shared token: lcs("abcd", "abxd") = 3 of 8 characters in all
    assert token_set_score("abcd", "abxd") == pytest.approx(75.0)
    # one shared token "aa": 1 - 3/(2 + 5) against "aa bb", 1 - 4/(2 + 6) against "aa ccc"
    assert token_set_score("aa bb", "aa ccc") == pytest.approx(100 - 100 * 3 / 7)


def test_partial_score_by_hand():
    assert partial_score("cable", "un cable rojo") == 100
    assert partial_score("abcd", "xxabzd") == pytest.approx(75.0)


def pool_of(spark, aliases, materials):
    a = spark.createDataFrame(aliases, "alias_id long, codigo string, denominacion string, origen string, confianza int")
    m = spark.createDataFrame(materials, "codigo string, orden long, denominacion_principal string, descripcion string")
    return M.build_pool(a, m)


def run(spark, texts, aliases, materials, brands=()):
    b = spark.createDataFrame(list(brands), NO_BRANDS)
    t = spark.createDataFrame([(x,) for x in texts], "texto string")
    rows = M.match(t, pool_of(spark, aliases, materials), b).filter("rank = 1").collect()
    return {r.texto: (r.codigo, r.nivel, r.score) for r in rows}


def test_guards(spark):
    materials = [("C1", 1, "CEMENTO COMUN", "25 KG"), ("C2", 2, "UNION PLASTICA", "32 MM"), ("C3", 3, "UNION DOBLE PLASTICA", "32 MM"),
                 ("C4", 4, "HIERRO CORRUGADO", "12 MM"), ("C5", 5, "CODO PARA REDES SIGAS", "90 20")]
    aliases = [(1, "C1", "cemento bco comun x 25 kg pinguino", "usuario", 99), (2, "C5", "codo fusion 90 de 20 sigas", "usuario", 90)]
    texts = ["CEMENTO BCO COMUN X 25 KG PINGUINO", "CEMENTO COMUN GRIS X 25 KG", "UNION DOBLE PLASTICA DE 32 MM", "UNION PLASTICA NEGRA DE 32 MM",
             "SPIT VARILLA ROSCADA 12MM", "CODO FUSION 90 DE 20 IPS", "PUERTA"]
    got = run(spark, texts, aliases, materials, [("SIGAS", "gas"), ("IPS", "agua")])
    assert got["CEMENTO BCO COMUN X 25 KG PINGUINO"][1] == "dudoso"  # even with a poisoned alias
    assert got["CEMENTO COMUN GRIS X 25 KG"][:2] == ("C1", "automatico")
    assert got["UNION DOBLE PLASTICA DE 32 MM"][:2] == ("C3", "automatico")
    assert got["UNION PLASTICA NEGRA DE 32 MM"][:2] == ("C2", "automatico")
    assert got.get("SPIT VARILLA ROSCADA 12MM", ("", "sin_match"))[1] != "automatico"
    assert got["CODO FUSION 90 DE 20 IPS"][1] == "dudoso"  # other brand domain
    assert "PUERTA" not in got


def test_ambiguous_aliases_leave_the_pool(spark):
    aliases = [(1, "A", "fusion gas tee", "u", 90), (2, "B", "fusion gas tee", "u", 90), (3, "A", "codo recto", "u", 95), (4, "B", "codo recto", "u", 90),
               (5, "A", "m3", "u", 90), (6, "A", "puerta", "migracion_item", 90)]
    a = spark.createDataFrame(aliases, "alias_id long, codigo string, denominacion string, origen string, confianza int")
    rules = {r.alias_id: r.regla for r in M.judge_aliases(M.prepare_aliases(a)).collect()}
    assert rules == {1: "ambiguo", 2: "ambiguo", 3: "queda", 4: "ambiguo", 5: "basura", 6: "fragmento"}


def brute(t, a):
    ts, as_ = set(t.split()), set(a.split())
    w = sum(len(x) + 1 for x in ts & as_)
    side = lambda s: 100 - 100 * (sum(len(x) + 1 for x in s) - w) / (w + sum(len(x) + 1 for x in s) - 2)
    return max(side(ts), side(as_)) if w else 0.0


def random_pool(spark, seed, n_text=40, n_alias=120):
    rnd = random.Random(seed)
    words = ["x", "de", "mm", "cano", "codo", "gas", "union", "20", "25", "32", "pvc", "cemento", "blanco", "chapa", "hierro"]
    # one word sits in almost every text
    make = lambda: " ".join(["tornillo"] * (rnd.random() < 0.9) + rnd.sample(words, rnd.randint(1, 5)))
    texts = sorted({make() for _ in range(n_text)})
    aliases = [(i, f"M{i}", make(), rnd.choice([80, 90, 95])) for i in range(n_alias)]
    t = spark.createDataFrame([(x,) for x in texts], "norm string").withColumn("tkey", F.array_join(M.T.token_set(F.col("norm")), " "))
    p = spark.createDataFrame(aliases, "alias_id long, codigo string, norm string, conf int").withColumn("denominacion", F.col("norm")).withColumn(
        "nums", F.array().cast("array<string>")).withColumn("sintetico", F.lit(False)).withColumn("calif", F.array().cast("array<string>"))
    return texts, aliases, t, p


@pytest.mark.parametrize("stages", [(), (80.0, 64.0)])
def test_best_aliases_equal_brute_force(spark, stages):
    texts, aliases, t, p = random_pool(spark, 5)
    got = {(r.tkey, r.previo): (r.alias_id, round(r.score, 6)) for r in M.best_aliases(t, p, stages=stages).collect()}
    want = {}
    for text in texts:
        key = " ".join(sorted(set(text.split())))
        scored = sorted(((-brute(text, a[2]), -a[3], a[0]) for a in aliases if brute(text, a[2]) >= 48))
        for i, (s, _, alias) in enumerate(scored[:9], 1):
            want[(key, i)] = (alias, round(-s, 6))
    assert got == want


def best_by_hand(texts, aliases):
    want = {}
    for text in texts:
        scored = sorted(((-brute(text, a[2]), -a[3], a[0]) for a in aliases if brute(text, a[2]) >= 48))
        for i, (s, _, alias) in enumerate(scored[:9], 1):
            want[(" ".join(sorted(set(text.split()))), i)] = (alias, round(-s, 6))
    return want


@pytest.mark.parametrize("most", [0, 2, 4])
def test_short_and_long_sets_meet_alike(spark, monkeypatch, most):
    """Sets that are spelled out as their subsets and sets that meet as pairs give the result of one pass."""
    monkeypatch.setattr(M, "SHORT", most)
    texts, aliases, t, p = random_pool(spark, 17, 25, 90)
    got = {(r.tkey, r.previo): (r.alias_id, round(r.score, 6)) for r in M.best_aliases(t, p, stages=(80.0,)).collect()}
    assert got == best_by_hand(texts, aliases)


def test_texts_with_many_partners_get_only_their_best(spark, monkeypatch):
    """Every pair at the cutoff went on to the top-n shuffle, so pairs grew with the square of the catalogue."""
    rows = []

    def counting(f):
        def g(*args, **kw):
            out = f(*args, **kw)
            rows.append(out.count())
            return out

        return g

    for name in ("candidate_pairs", "listed_pairs"):
        if hasattr(M, name):
            monkeypatch.setattr(M, name, counting(getattr(M, name)))
    texts = [f"bulon hexagonal galvanizado {i}" for i in range(20)]
    # lighter, equal and heavier aliases; copies of one set; ties by confidence and id
    aliases = [(i, f"M{i}", f"bulon hexagonal galvanizado {i % 150}" + " largo" * (i % 3 == 1), 80 + i % 4) for i in range(400)]
    aliases += [(400 + i, f"L{i}", "bulon hexagonal", 80 + i % 2) for i in range(12)]
    t = spark.createDataFrame([(x,) for x in texts], "norm string").withColumn("tkey", F.array_join(M.T.token_set(F.col("norm")), " "))
    p = spark.createDataFrame(aliases, "alias_id long, codigo string, norm string, conf int").withColumn("denominacion", F.col("norm"))
    got = {(r.tkey, r.previo): (r.alias_id, round(r.score, 6)) for r in M.best_aliases(t, p).collect()}
    assert got == best_by_hand(texts, aliases)
    assert sum(rows) < 60 * len(texts)


def test_pairs_do_not_depend_on_grid_or_partitions(spark):
    _, _, t, p = random_pool(spark, 9, 30, 60)
    ts, as_ = M.signatures(t, "norm", "tkey"), M.signatures(p, "norm", "akey")
    found = []
    v = M.vocabulary(ts, as_)
    for cell in (5, 2000):
        rows = M.candidate_pairs(M.rank_tokens(ts, "tkey", v), M.rank_tokens(as_, "akey", v), 55.0, cell).collect()
        assert len(rows) == len({(r.tkey, r.akey) for r in rows})
        found.append({(r.tkey, r.akey) for r in rows})
    keys = lambda df, k: [r[k] for r in df.collect()]
    want = {(x, y) for x, y in itertools.product(keys(ts, "tkey"), keys(as_, "akey")) if brute(x, y) >= 55.0}
    assert found[0] == found[1] == want


def test_no_cartesian_product(spark):
    _, _, t, p = random_pool(spark, 9, 10, 20)
    pairs = M.all_pairs(t, p, 60.0)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_key_resolution(spark):
    d = spark.createDataFrame([("cemento25",), ("cem",), ("arena fina gruesa".replace(" ", ""),), ("nada",)], "k string")
    p = spark.createDataFrame([("cemento25kg", 2), ("cemento25", 3), ("arenafina", 1)], "kk string, pos long")
    assert {r.k: r.kk for r in M.resolve_keys(d, p).collect()} == {"cemento25": "cemento25", "cem": "cemento25kg", "arenafinagruesa": "arenafina"}


def misspelt(draw, word):
    at, kind = draw.randrange(len(word)), draw.randrange(4)
    swap = word[:at] + word[at + 1 : at + 2] + word[at : at + 1] + word[at + 2 :]
    return [word[:at] + word[at + 1 :], word[:at] + draw.choice("aeiorst") + word[at + 1 :], word[:at] + draw.choice("aeiorst") + word[at:], swap][kind] or word


def test_similar_words_equal_brute_force(spark):
    draw = random.Random(13)
    known = sorted({"".join(draw.choice("abcdeno") for _ in range(draw.randrange(1, 13))) for _ in range(250)} | {"aaaa", "aaaaaaaa", "abababab", "cano", "cnao", "ñandú"})
    words = sorted({misspelt(draw, w) for w in known} | set(known[::7]))
    df = lambda rows: spark.createDataFrame([(x,) for x in rows], "token string")
    pairs = [(x, y) for x in words for y in known if x != y]
    common = lcs_lengths([x for x, _ in pairs], [y for _, y in pairs]).tolist()
    for least in (67.0, 85.0):
        got = [(r.token, r.parecido) for r in M.similar_words(df(words), df(known), least).collect()]
        want = {p for p, c in zip(pairs, common, strict=True) if 200.0 * c / len(p[0] + p[1]) >= least - 1e-9}
        assert set(got) == want and len(got) == len(want)


def recall(spark, draw, names, typos):
    """Share of the best nine of all pairs by the character scorer that the match finds for misspelt names."""
    texts = sorted({" ".join(misspelt(draw, w) if draw.random() < typos and len(w) > 3 else w for w in draw.sample(n.split(), max(2, len(n.split()) - 1))) for n in names[::3]})
    rows = [(i, f"M{i}", n, 80 + i % 15) for i, n in enumerate(names)]
    t = spark.createDataFrame([(x,) for x in texts], "norm string").withColumn("tkey", F.array_join(M.T.token_set(F.col("norm")), " "))
    p = spark.createDataFrame(rows, "alias_id long, codigo string, norm string, conf int").withColumn("denominacion", F.col("norm")).withColumn(
        "nums", F.array().cast("array<string>")).withColumn("sintetico", F.lit(False)).withColumn("calif", F.array().cast("array<string>"))
    got = {}
    for r in M.best_aliases(t, p, scorer="indel", similar_cutoff=36.0).collect():
        got.setdefault(r.tkey, {})[r.previo] = (r.alias_id, r.score)
    found = total = first = 0
    keys = [" ".join(sorted(set(n.split()))) for n in names]
    for text in texts:
        key = " ".join(sorted(set(text.split())))
        scores = token_set_scores([key] * len(keys), keys)
        best = sorted((-s, -c, i) for s, (i, _, _, c) in zip(scores, rows, strict=True) if s >= 48)[:9]
        mine = {a for a, _ in got.get(key, {}).values()}
        total += len(best)
        found += sum(i in mine for _, _, i in best)
        first += got.get(key, {}).get(1, (None,))[0] == best[0][2]
    return found / total, first / len(texts)


@pytest.mark.parametrize("typos", [0.5, 1.0])
def test_recall_on_misspelt_texts(spark, typos):
    names = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").selectExpr("lower(concat_ws(' ', p_name, p_type))").collect()]
    nine, first = recall(spark, random.Random(21), names, typos)
    print("recall", typos, round(nine, 4), round(first, 4))
    assert nine >= 0.99 and first >= 0.99


def test_first_generation_match_equals_brute_force(spark):
    draw = random.Random(17)
    words = ["CANO", "CODO", "UNION", "TUBO", "ROSCA", "PVC", "GAS", "20", "25", "3/4", "CHAPA", "LISA"]
    text = lambda: " ".join(draw.sample(words, draw.randrange(2, 6)))
    items = [(i, ("SANITARIO", "TECHO", "RARO")[0 if i % 20 else 2] if i % 3 else "TECHO", draw.choice(["", "VARIOS", "TUBO"]), text()) for i in range(60)]
    lines = [(i, text() if i % 9 else items[i][3], f"c{i}", draw.choice(["SANITARIO", "TECHO", "RARO", "OTRO"])) for i in range(50)]
    equiv = [(f"c{i}", (i * 7) % 60) for i in range(0, 50, 4)] + [(lines[3][1], 5)]
    got = {}
    for r in M.match_v1(spark.createDataFrame(lines, "linea long, texto string, cod_prov string, rubro_prov string"),
                        spark.createDataFrame(items, "codigo long, rubro string, marca string, nombre string"),
                        spark.createDataFrame(equiv, "clave string, cod_int long")).collect():
        got.setdefault(r.linea, []).append((r["rank"], r.codigo, r.score, r.origen))
    # the plain score of each pair of line and item, one by one
    pairs = [(n, i, t, name, brand) for n, t, _, _ in lines for i, _, brand, name in items]
    df = spark.createDataFrame(pairs, "linea long, codigo long, p string, m_text string, marca string").withColumn("p", M.T.normalize(F.col("p"))).withColumn("m_text", M.T.normalize(F.col("m_text")))
    extra = {(r.linea, r.codigo): r.x for r in df.select("linea", "codigo", (
        M.T.number_overlap(M.T.numbers(F.col("p")), M.T.numbers(F.col("m_text"))) * 20 + M.T.keyword_bonus(F.col("p"), F.col("m_text"))
        + F.when(~F.upper("marca").isin("", "VARIOS") & F.contains("p", F.upper("marca")), 8).when(
            F.arrays_overlap(M.T.brand_groups_v1(F.col("p")), M.T.brand_groups_v1(F.col("m_text"))), 5).otherwise(0)).alias("x")).collect()}
    known = dict(equiv)
    for n, t, code, rubro in lines:
        confirmed = known.get(code, known.get(t))
        scope = [i for i in items if i[1] == rubro]
        if confirmed is not None and items[confirmed][1] != rubro:
            scope.append(items[confirmed])
        if len(scope) < 5:
            scope = items
        want = []
        for i, _, _, name in scope:
            base = token_set_score(t, name) * 0.5 + partial_score(t, name) * 0.3 + extra[n, i]
            score = int(min(100.0, max(0.0, base)) * 10 + 0.5) / 10
            want.append((-(max(score, 90.0) if i == confirmed else score), i, "EQUIV" if i == confirmed else "IA"))
        best = [(k, i, -s, o) for k, (s, i, o) in enumerate(sorted(want)[:3], 1)]
        assert sorted(got[n]) == [(k, i, pytest.approx(s), o) for k, i, s, o in best], n


def test_letters_are_scored_in_blocks_where_most_pairs_are_candidates(spark, monkeypatch):
    """every candidate was shuffled with its texts and scored, which were most of all pairs."""
    _, _, t, p = random_pool(spark, 31, 20, 60)
    found = lambda: {(r.tkey, r.previo, r.alias_id, round(r.score, 6)) for r in M.best_aliases(t, p, window=4, scorer="indel").collect()}
    with monkeypatch.context() as m:
        m.setattr(M, "_crowded", lambda *_: False, raising=False)
        want = found()

    def no_pairs(*_):
        raise AssertionError("pairs were spelled out")

    monkeypatch.setattr(M, "candidate_pairs", no_pairs)
    assert found() == want and len(want) > 60


def test_bounds_of_the_first_scorer(spark):
    """no pair may score above its bound."""
    from quotelens.functions.similarity import partial_scores, score_bounds, token_set_scores

    draw = random.Random(5)
    word = lambda: "".join(draw.choice("ABC1") for _ in range(draw.randrange(1, 6)))
    a = ["", "A", "A A B", "AB  C"] + [" ".join(word() for _ in range(draw.randrange(1, 6))) for _ in range(40)]
    b = ["", "B", "C  AB"] + [" ".join(word() for _ in range(draw.randrange(1, 6))) for _ in range(50)] + a[5:9]
    sets, windows = score_bounds(a, b)
    x, y = [t for t in a for _ in b], b * len(a)
    assert (sets.ravel() >= token_set_scores(x, y) - 1e-9).all()
    assert (windows.ravel() >= partial_scores(x, y) - 1e-9).all()


def test_only_pairs_that_can_be_among_the_best_are_scored(spark, monkeypatch):
    """every line was scored with every item of its scope."""
    rows, plain = [], M.score_v1

    def counting(pairs):
        rows.append(pairs.count())
        return plain(pairs)

    monkeypatch.setattr(M, "score_v1", counting)
    draw = random.Random(9)
    names = sorted({" ".join(draw.sample(["CANO", "CODO", "UNION", "TUBO", "ROSCA", "PVC", "GAS", "CHAPA", "LISA", "20", "25", "32", "40"], 5)) for _ in range(90)})
    lines = [(i, n if i % 2 else " ".join(n.split()[:4]), None, "SANITARIO") for i, n in enumerate(names[:40])] + [(99, names[0], None, "SANITARIO")]
    out = M.match_v1(spark.createDataFrame(lines, "linea long, texto string, cod_prov string, rubro_prov string"),
                     spark.createDataFrame([(i, "SANITARIO", None, n) for i, n in enumerate(names)], "codigo long, rubro string, marca string, nombre string"),
                     spark.createDataFrame([("x", 1)], "clave string, cod_int long"))
    assert out.count() == 3 * len(lines)
    assert rows[0] < 0.3 * 40 * len(names)


def shown_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_spread_by_an_explode_are_not_broadcast(spark):
    """Keys of texts and prefixes are many times larger than the files Spark judges them by."""
    materials = [(f"C{i}", i, f"CANO {i % 7} ROJO", f"{i} MM") for i in range(40)]
    t = M.prepare_texts(spark.createDataFrame([(f"cano rojo {i} mm",) for i in range(40)], "texto string"))
    ranked = M.rank_both(t, pool_of(spark, [], materials))
    assert "Broadcast" not in shown_plan(M.candidate_pairs(*ranked))
    keys = spark.createDataFrame([("abc",), ("abcdef",)], "k string")
    found = M.resolve_keys(keys, spark.createDataFrame([("abcd", 1), ("abc", 2)], "kk string, pos long"))
    assert "Broadcast" not in shown_plan(found)
    assert {tuple(r) for r in found.collect()} == {("abc", "abc"), ("abcdef", "abcd")}


def test_pool_and_lines_are_joined_by_sorting(spark):
    """Texts that Parquet keeps in a dictionary are larger in memory than their files; none is broadcast."""
    # files have a size that Spark judges by
    a = cut(spark.createDataFrame([(1, "A", "fusion gas tee", "u", 90)], "alias_id long, codigo string, denominacion string, origen string, confianza int"))
    assert "Broadcast" not in shown_plan(M.judge_aliases(M.prepare_aliases(a)))
    best = cut(spark.createDataFrame([("tee", 1, "A", "fusion gas tee", 90.0, "automatico", 90)],
                                 "texto string, rank int, codigo string, denominacion string, score double, nivel string, conf int"))
    linked = M.link_lines(spark.createDataFrame([("tee",), ("codo",)], "texto string"), best)
    assert "Broadcast" not in shown_plan(linked)
    assert {(r.texto, r.codigo_match, r.nivel) for r in linked.collect()} == {("tee", "A", "automatico"), ("codo", None, "sin_match")}
