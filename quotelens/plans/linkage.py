"""M1-M21 on texts and aliases built from the catalogue."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import textnorm as T
from ..functions.similarity import partial_ratio, token_set_ratio
from ..operators import compare as C
from ..operators import linkage as M
from ..operators import pricing as P
from ..session import shuffled
from ..sources.derived import bare_lines, declared_total, lines, materials, with_line_id
from ..sources.views import line_seq, table
from .pricing import overrides
from .registry import add_view, on, query


# --- tables -------------------------------------------------------------------

def full_name():
    return F.concat_ws(" ", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"))


def line_text():
    """Part text as suppliers write it: full, without type, with another size, or name and brand only."""
    k = F.col("codigo") % 4
    size = F.when(k == 2, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("string")
    return (
        F.when(k == 1, F.concat_ws(" ", "p_brand", "p_name", size))
        .when(k == 3, F.concat_ws(" ", "p_name", "p_brand"))
        .otherwise(F.concat_ws(" ", "p_type", "p_name", "p_brand", size))
    )


def text_lines(spark, sf):
    m = materials(spark, sf).select("codigo", line_text().alias("texto"))
    return with_line_id(shuffled(bare_lines(spark, sf)).join(m, "codigo"))


def catalogue(spark, sf):
    return materials(spark, sf).select(
        "codigo", F.col("codigo").alias("orden"), F.concat_ws(" ", "p_name", "p_brand").alias("denominacion_principal"),
        F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("descripcion"), F.col("p_type").alias("rubro"))


def aliases(spark, sf):
    m = materials(spark, sf)
    item = m.select(
        (F.col("codigo") * 2).alias("alias_id"), "codigo", F.lower("p_name").alias("denominacion"),
        F.when(F.col("codigo") % 3 == 0, "migracion_item").otherwise("equivalencias_x").alias("origen"),
        (80 + F.col("codigo") % 15).cast("int").alias("confianza"))
    branded = m.select(
        (F.col("codigo") * 2 + 1).alias("alias_id"), "codigo",
        F.when(F.col("codigo") % 10 == 0, F.concat(F.lit("m2 "), F.col("p_size").cast("string")))
        .otherwise(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))).alias("denominacion"),
        F.lit("usuario").alias("origen"), (80 + F.col("codigo") % 7).cast("int").alias("confianza"))
    return item.unionByName(branded)


def brands(spark, sf):
    b = materials(spark, sf).select("p_brand").distinct()
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    group = F.concat(F.when(n % 5 == 0, "~g").otherwise("g"), (n % 5).cast("string"))
    return b.select(F.upper("p_brand").alias("marca"), group.alias("grupo"))


NO_RULES: list = []


def pool(spark, sf):
    return M.build_pool(aliases(spark, sf), catalogue(spark, sf), NO_RULES)


add_view("texts", """
  SELECT p_partkey AS codigo,
         CASE p_partkey % 4 WHEN 1 THEN concat_ws(' ', p_brand, p_name, p_size) WHEN 3 THEN concat_ws(' ', p_name, p_brand)
              WHEN 2 THEN concat_ws(' ', p_type, p_name, p_brand, p_size + 1) ELSE concat_ws(' ', p_type, p_name, p_brand, p_size) END AS texto
  FROM part""")
add_view("aliases", """
  SELECT p_partkey * 2 AS alias_id, p_partkey AS codigo, lower(p_name) AS denominacion,
         CASE WHEN p_partkey % 3 = 0 THEN 'migracion_item' ELSE 'equivalencias_x' END AS origen, CAST(80 + p_partkey % 15 AS INTEGER) AS conf
  FROM part
  UNION ALL
  SELECT p_partkey * 2 + 1, p_partkey,
         CASE WHEN p_partkey % 10 = 0 THEN 'm2 ' || p_size ELSE lower(concat_ws(' ', p_name, p_brand, p_type)) END,
         'usuario', CAST(80 + p_partkey % 7 AS INTEGER) FROM part""")
NORM = "trim(regexp_replace(replace(lower({c}), '#', ' '), '\\s+', ' ', 'g'))"
NUMS = "list_sort(list_distinct(regexp_extract_all({c}, '\\b(\\d+(?:[.,]\\d+)?)\\b', 1)))"
add_view("judged", f"""
  WITH n AS (SELECT *, {NORM.format(c='denominacion')} AS norm FROM aliases),
  e AS (SELECT *, CASE WHEN NOT regexp_matches(norm, '[a-z]{{3,}}') THEN 'basura' WHEN origen IN ('migracion_item', 'migracion_detalle') THEN 'fragmento' END AS early FROM n),
  g AS (SELECT norm, count(DISTINCT codigo) AS nc, max(conf) AS top FROM e WHERE early IS NULL GROUP BY norm),
  h AS (SELECT e.norm, count(DISTINCT codigo) AS nw FROM e JOIN g USING (norm) WHERE early IS NULL AND conf = top GROUP BY e.norm)
  SELECT e.*, coalesce(early, CASE WHEN nc = 1 OR (conf = top AND nw = 1) THEN 'queda' ELSE 'ambiguo' END) AS regla
  FROM e LEFT JOIN g USING (norm) LEFT JOIN h USING (norm)""", ("aliases",))
add_view("synth", f"""
  SELECT p_partkey + 1099511627776 AS alias_id, p_partkey AS codigo, concat_ws(' ', p_name, p_brand, p_type, p_size) AS denominacion,
         {NORM.format(c="concat_ws(' ', p_name, p_brand, p_type, p_size)")} AS norm, 100 AS conf, true AS sintetico FROM part""")
add_view("pool", f"""
  SELECT *, {NUMS.format(c='norm')} AS nums FROM (
    SELECT alias_id, codigo, denominacion, norm, conf, false AS sintetico FROM judged WHERE regla = 'queda'
    UNION ALL SELECT * FROM synth)""", ("judged", "synth"))
# brute force over all pairs that share any token
add_view("scored", f"""
  WITH t AS (SELECT DISTINCT texto, {NORM.format(c='texto')} AS norm FROM texts),
  tw AS (SELECT texto, unnest(list_distinct(string_split(norm, ' '))) AS tok FROM t),
  aw AS (SELECT alias_id, unnest(list_distinct(string_split(norm, ' '))) AS tok FROM pool),
  ta AS (SELECT texto, sum(length(tok) + 1) AS a FROM tw GROUP BY texto),
  aa AS (SELECT alias_id, sum(length(tok) + 1) AS a FROM aw GROUP BY alias_id),
  s AS (SELECT texto, alias_id, sum(length(tok) + 1) AS w FROM tw JOIN aw USING (tok) GROUP BY ALL)
  SELECT texto, alias_id, greatest(100.0 - 100.0 * (ta.a - w) / CAST(w + ta.a - 2 AS DOUBLE), 100.0 - 100.0 * (aa.a - w) / CAST(w + aa.a - 2 AS DOUBLE)) AS score
  FROM s JOIN ta USING (texto) JOIN aa USING (alias_id)""", ("texts", "pool"))
add_view("top9", """
  SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY texto ORDER BY score DESC, conf DESC, alias_id) AS previo
                 FROM scored s JOIN pool USING (alias_id) WHERE score >= 48) WHERE previo <= 9""", ("scored", "pool"))
GROUPS = "CASE WHEN regexp_matches(upper({c}), 'BRAND#') THEN CAST(regexp_extract(upper({c}), 'BRAND#(\\d+)', 1) AS INTEGER) % 5 END"
add_view("guarded", f"""
  WITH b AS (SELECT t.texto, previo, p.*, score AS s0, {NORM.format(c='texto')} AS tnorm,
                    {GROUPS.format(c='texto')} AS gt, {GROUPS.format(c='denominacion')} AS ga FROM top9 t JOIN pool p USING (alias_id)),
  b1 AS (SELECT *, CASE WHEN gt = ga AND gt <> 0 THEN least(100.0, s0 + 6) WHEN gt <> ga THEN least(s0, 84.0) ELSE s0 END AS s1,
                {NUMS.format(c='tnorm')} AS tnums, len(string_split(tnorm, ' ')) AS nt, len(string_split(norm, ' ')) AS na FROM b),
  b2 AS (SELECT *, CASE WHEN least(nt, na) <= 2 AND tnorm <> norm AND NOT (sintetico AND len(nums) > 0 AND nt >= na) THEN least(s1, 84.0) ELSE s1 END AS s2,
                len(list_filter(nums, lambda x: NOT list_contains(tnums, x))) AS lost FROM b1),
  b3 AS (SELECT *, CASE WHEN lost > 0 THEN least(s2, greatest(60.0, 84.0 - 8.0 * lost))
                        WHEN len(nums) > 0 AND len(nums) = len(tnums) AND s2 < 85 THEN least(s2 + 4, 84.9) ELSE s2 END AS s3 FROM b2)
  SELECT texto, alias_id, codigo, denominacion, conf, previo, CASE WHEN s3 >= 85 THEN 'automatico' WHEN s3 >= 60 THEN 'dudoso' ELSE 'sin_match' END AS nivel,
         floor(s3 * 10.0 + 0.5) / 10.0 AS score FROM b3""", ("top9", "pool"))
add_view("matched", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY texto ORDER BY score DESC, conf DESC, previo) AS rank FROM guarded) WHERE rank <= 3""", ("guarded",))


# --- queries ---------------------------------------------------------------------

@query("m1_alias_pool", on("judged", sql="SELECT alias_id, codigo, norm, conf FROM judged WHERE regla = 'queda'"))
def m1(spark, sf):
    return M.judge_aliases(M.prepare_aliases(aliases(spark, sf), NO_RULES)).filter("regla = 'queda'").select("alias_id", "codigo", "norm", "conf")


@query("h23_alias_pool_audit", on("judged", sql="""
  SELECT regla, count(*) AS n FROM judged GROUP BY regla UNION ALL SELECT 'sintetico', count(*) FROM part"""))
def h23(spark, sf):
    judged = M.judge_aliases(M.prepare_aliases(aliases(spark, sf), NO_RULES)).groupBy("regla").agg(F.count("*").alias("n"))
    added = M.synthetic_aliases(catalogue(spark, sf), NO_RULES).agg(F.count("*").alias("n")).select(F.lit("sintetico").alias("regla"), "n")
    return judged.unionByName(added)


@query("m2_synthetic_aliases", on("synth", sql=f"""
  SELECT alias_id, codigo, norm, CAST(conf AS INTEGER) AS conf, sintetico, array_to_string({NUMS.format(c='norm')}, ',') AS nums FROM synth"""))
def m2(spark, sf):
    s = M.synthetic_aliases(catalogue(spark, sf), NO_RULES)
    return s.select("alias_id", "codigo", "norm", "conf", "sintetico", F.array_join(F.array_sort("nums"), ",").alias("nums"))


def prepared_texts(spark, sf):
    return M.prepare_texts(materials(spark, sf).select(line_text().alias("texto")), NO_RULES)


@query("m3_candidates", on("top9", sql="SELECT texto, alias_id, score, previo FROM top9"))
def m3(spark, sf):
    t = prepared_texts(spark, sf)
    return shuffled(t.select("texto", "tkey")).join(M.best_aliases(t, pool(spark, sf)), "tkey").select("texto", "alias_id", "score", "previo")


add_view("ratios", f"""
  WITH t AS (SELECT texto, list_distinct(string_split({NORM.format(c='texto')}, ' ')) AS ta FROM texts),
  p AS (SELECT DISTINCT texto, alias_id, ta, list_distinct(string_split(norm, ' ')) AS tb FROM top9 JOIN pool USING (alias_id) JOIN (SELECT DISTINCT texto, ta FROM t) USING (texto)),
  r AS (SELECT *, array_to_string(list_sort(list_filter(ta, lambda x: NOT list_contains(tb, x))), ' ') AS ra,
               array_to_string(list_sort(list_filter(tb, lambda x: NOT list_contains(ta, x))), ' ') AS rb,
               array_to_string(list_sort(list_intersect(ta, tb)), ' ') AS co FROM p),
  u AS (SELECT DISTINCT ra, rb FROM r WHERE ra <> '' AND rb <> ''),
  -- one row of the LCS table a character of ra: a running maximum over the row before, one more where the characters agree
  l AS (
    WITH RECURSIVE s(ra, rb, i, fila) AS (
      SELECT ra, rb, 0, list_transform(range(length(rb) + 1), lambda x: 0) FROM u
      UNION ALL
      SELECT ra, rb, i + 1, list_transform(range(1, length(rb) + 2), lambda j: list_max(list_transform(range(1, j + 1),
        lambda k: greatest(fila[k], CASE WHEN k > 1 AND rb[k - 1] = ra[i + 1] THEN fila[k - 1] + 1 ELSE 0 END)))) FROM s WHERE i < length(ra))
    SELECT ra, rb, list_max(fila) AS lcs FROM s WHERE i = length(ra)),
  n AS (SELECT *, length(co) AS c, CASE WHEN co = '' THEN 0 ELSE 1 END AS g FROM r LEFT JOIN l USING (ra, rb))
  SELECT texto, alias_id, CASE WHEN co <> '' AND (ra = '' OR rb = '') THEN 100.0 ELSE greatest(
      100.0 - 100.0 * (length(ra) + length(rb) - 2 * lcs) / CAST(2 * (c + g) + length(ra) + length(rb) AS DOUBLE),
      CASE WHEN co <> '' THEN 100.0 - 100.0 * (g + length(ra)) / CAST(2 * c + g + length(ra) AS DOUBLE) ELSE 0 END,
      CASE WHEN co <> '' THEN 100.0 - 100.0 * (g + length(rb)) / CAST(2 * c + g + length(rb) AS DOUBLE) ELSE 0 END) END AS ratio FROM n""", ("top9", "texts", "pool"))


@query("m4_token_set_ratio", on("ratios", sql="SELECT texto, alias_id, ratio FROM ratios"))
def m4(spark, sf):
    """Character-level score of each text and the nine candidates of the ranked match."""
    t = prepared_texts(spark, sf)
    top = M.best_aliases(t, pool(spark, sf)).withColumn("akey", F.array_join(T.token_set(F.col("norm")), " ")).select("tkey", "alias_id", "akey")
    return shuffled(t.select("texto", "tkey")).join(top, "tkey").select("texto", "alias_id", token_set_ratio("tkey", "akey").alias("ratio"))


@query("m4_containment", on("pool", "texts", sql=f"""
  WITH t AS (SELECT DISTINCT list_sort(list_distinct(string_split({NORM.format(c='texto')}, ' '))) AS tt FROM texts),
  a AS (SELECT DISTINCT list_sort(list_distinct(string_split(norm, ' '))) AS al FROM pool)
  SELECT array_to_string(tt, ' ') AS tkey, array_to_string(al, ' ') AS akey FROM t JOIN a ON list_has_all(tt, al) OR list_has_all(al, tt)"""))
def m4c(spark, sf):
    t = prepared_texts(spark, sf)
    return M.all_pairs(t, pool(spark, sf), 100.0).select("tkey", "akey")


def matches(spark, sf, scorer="token"):
    texts = materials(spark, sf).select(line_text().alias("texto"))
    return M.match(texts, pool(spark, sf), brands(spark, sf), rules=NO_RULES, scorer=scorer)


@query("m6_brand_rule", on("top9", "pool", sql=f"""
  SELECT texto, alias_id, CASE WHEN gt = ga AND gt <> 0 THEN least(100.0, score + 6) WHEN gt <> ga THEN least(score, 84.0) ELSE score END AS score
  FROM (SELECT texto, alias_id, score, {GROUPS.format(c='texto')} AS gt, {GROUPS.format(c='denominacion')} AS ga FROM top9 JOIN pool USING (alias_id))"""))
def m6(spark, sf):
    t = prepared_texts(spark, sf)
    p, b = pool(spark, sf), brands(spark, sf)
    top = M.best_aliases(t, p)
    names = T.with_brand_groups(p.select("denominacion").distinct(), "denominacion", "denominacion", b, "g_alias")
    t = T.with_brand_groups(t.select("texto", "tkey"), "texto", "texto", b, "g_texto")
    rows = shuffled(t).join(shuffled(top).join(names, "denominacion"), "tkey")
    return rows.select("texto", "alias_id", M.brand_rule(F.col("score"), F.col("g_texto"), F.col("g_alias")).alias("score"))


@query("m7_qualifier_guard", on("texts", sql="""
  WITH t AS (SELECT codigo, texto || CASE WHEN codigo % 5 = 0 THEN ' blanco' WHEN codigo % 7 = 0 THEN ' dobles' ELSE '' END AS texto,
                    CASE WHEN codigo % 10 = 0 THEN 'BCA' WHEN codigo % 3 = 0 THEN 'doble refractarios' ELSE '' END AS nombre FROM texts)
  SELECT codigo, CASE WHEN (codigo % 5 = 0) = (codigo % 10 = 0) AND (codigo % 5 <> 0 AND codigo % 7 = 0) = (codigo % 10 <> 0 AND codigo % 3 = 0)
                       AND NOT (codigo % 10 <> 0 AND codigo % 3 = 0) THEN 100.0 ELSE 84.0 END AS score FROM t"""))
def m7(spark, sf):
    k = F.col("codigo")
    t = materials(spark, sf).select(
        "codigo", F.concat(line_text(), F.when(k % 5 == 0, " blanco").when(k % 7 == 0, " dobles").otherwise("")).alias("texto"),
        F.when(k % 10 == 0, "BCA").when(k % 3 == 0, "doble refractarios").otherwise("").alias("nombre"))
    return t.select("codigo", M.qualifier_rule(F.lit(100.0), T.qualifiers(F.col("texto")), T.qualifiers(F.col("nombre"))).alias("score"))


def guard_pairs(spark, sf):
    t = prepared_texts(spark, sf)
    top = M.best_aliases(t, pool(spark, sf)).select(
        "tkey", "alias_id", "score", F.col("norm").alias("a_norm"), F.col("nums").alias("a_nums"), "sintetico")
    return shuffled(t).join(top, "tkey")


@query("m8_fragment_guard", on("top9", "pool", sql=f"""
  WITH b AS (SELECT texto, t.alias_id, score, {NORM.format(c='texto')} AS tnorm, norm, sintetico, nums FROM top9 t JOIN pool USING (alias_id))
  SELECT texto, alias_id, CASE WHEN least(len(string_split(tnorm, ' ')), len(string_split(norm, ' '))) <= 2 AND tnorm <> norm
         AND NOT (sintetico AND len(nums) > 0 AND len(string_split(tnorm, ' ')) >= len(string_split(norm, ' '))) THEN least(score, 84.0) ELSE score END AS score FROM b"""))
def m8(spark, sf):
    s = M.fragment_rule(F.col("score"), F.col("norm"), F.col("a_norm"), F.col("sintetico"), F.col("a_nums"))
    return guard_pairs(spark, sf).select("texto", "alias_id", s.alias("score"))


@query("m9_number_guard", on("top9", "pool", sql=f"""
  WITH b AS (SELECT texto, t.alias_id, score, nums, {NUMS.format(c=NORM.format(c='texto'))} AS tnums FROM top9 t JOIN pool USING (alias_id)),
  c AS (SELECT *, len(list_filter(nums, lambda x: NOT list_contains(tnums, x))) AS lost FROM b)
  SELECT texto, alias_id, CASE WHEN lost > 0 THEN least(score, greatest(60.0, 84.0 - 8.0 * lost))
         WHEN len(nums) > 0 AND len(nums) = len(tnums) AND score < 85 THEN least(score + 4, 84.9) ELSE score END AS score FROM c"""))
def m9(spark, sf):
    s = M.number_rule(F.col("score"), F.col("nums"), F.col("a_nums"))
    return guard_pairs(spark, sf).select("texto", "alias_id", s.alias("score"))


@query("m10_match_ranked", on("matched", sql="SELECT texto, rank, codigo, denominacion, score, nivel, CAST(conf AS INTEGER) AS conf FROM matched"))
def m10(spark, sf):
    return matches(spark, sf)


@query("m10_match_indel")
def m10_indel(spark, sf):
    """Same match with the character-level scorer on the candidates."""
    return matches(spark, sf, "indel")


@query("m11_alternatives", on("matched", sql="""
  SELECT m.texto, m.codigo, min(m.rank) AS rank, arg_min(m.score, m.rank) AS score, arg_min(m.denominacion, m.rank) AS denominacion
  FROM matched m JOIN (SELECT texto, codigo FROM matched WHERE rank = 1) b ON m.texto = b.texto AND m.codigo <> b.codigo
  WHERE m.rank > 1 GROUP BY m.texto, m.codigo"""))
def m11(spark, sf):
    return M.alternatives(matches(spark, sf))


@query("m12_catalogue_enrichment", on("matched", sql="""
  SELECT texto, codigo, score, p_type AS categoria, p_name || ' ' || p_brand AS denominacion_principal
  FROM matched LEFT JOIN part ON codigo = p_partkey WHERE rank = 1"""))
def m12(spark, sf):
    best = matches(spark, sf).filter("rank = 1").select("texto", "codigo", "score")
    cat = catalogue(spark, sf).select("codigo", F.col("rubro").alias("categoria"), "denominacion_principal")
    return shuffled(best).join(cat, "codigo", "left").select("texto", "codigo", "score", "categoria", "denominacion_principal")


def routed_lines(spark, sf):
    l = text_lines(spark, sf).withColumn("total", declared_total())
    linked = M.link_lines(l, matches(spark, sf))
    bad = P.suspicious(F.col("pu"), F.col("cant"), F.col("total"))
    # every ninth line comes with a presentation the unit rules cannot read
    return linked.withColumn("estado", M.route(F.col("nivel"), bad, F.col("line_no") % 9 == 0))


add_view("routed", """
  SELECT l.line_id, l.doc, l.line_no, l.prov_id, l.codigo, t.texto, l.fecha, l.pu, l.cant, l.con_iva, l.descuento, m.codigo AS codigo_match, m.score,
         CASE WHEN coalesce(nivel, 'sin_match') = 'sin_match' THEN 'SIN_MATCH'
              WHEN nivel = 'automatico' AND line_no % 9 <> 0 AND NOT (doc % 17 = 0 AND abs(pu * cant - floor(floor(pu * cant * 100 + 0.5) / 100.0 * 1.5 * 100 + 0.5) / 100.0)
                   > greatest(1.0, 0.01 * floor(floor(pu * cant * 100 + 0.5) / 100.0 * 1.5 * 100 + 0.5) / 100.0)) THEN 'MATCH' ELSE 'REVISAR' END AS estado
  FROM lines l JOIN texts t USING (codigo) LEFT JOIN (SELECT * FROM matched WHERE rank = 1) m ON t.texto = m.texto""", ("lines", "texts", "matched"))


@query("m13_line_routing", on("routed", sql="SELECT line_id, codigo_match, score, estado FROM routed"))
def m13(spark, sf):
    return routed_lines(spark, sf).select("line_id", "codigo_match", "score", "estado")


STATS_SQL = """
  SELECT {by}, count(*) AS total, count(*) FILTER (estado = 'MATCH') AS automatico, count(*) FILTER (estado = 'REVISAR') AS dudoso,
         count(*) FILTER (estado = 'SIN_MATCH') AS sin_match,
         floor(100.0 * count(*) FILTER (estado = 'MATCH') / CAST(count(*) AS DOUBLE) * 10.0 + 0.5) / 10.0 AS pct_automatico
  FROM routed GROUP BY {by}"""


@query("m18_match_stats", on("routed", sql=STATS_SQL.format(by="prov_id")))
def m18(spark, sf):
    return M.match_stats(routed_lines(spark, sf), "prov_id")


@query("h26_match_rate_by_document", on("routed", sql=STATS_SQL.format(by="doc")))
def h26(spark, sf):
    return M.match_stats(routed_lines(spark, sf), "doc")


@query("m19_readjudication", on("matched", "texts", "lines", sql="""
  WITH l AS (SELECT line_id, CASE WHEN line_no = 7 THEN 'm2 $ 1 $' ELSE texto END AS texto, CASE WHEN doc % 3 = 0 THEN codigo + 1 ELSE codigo END AS codigo_actual
             FROM lines JOIN texts USING (codigo)),
  v AS (SELECT l.*, m.codigo AS cm, m.score FROM l LEFT JOIN (SELECT * FROM matched WHERE rank = 1) m ON l.texto = m.texto)
  SELECT veredicto, count(*) AS n FROM (
    SELECT CASE WHEN texto = 'm2 $ 1 $' THEN 'BASURA' WHEN cm = codigo_actual AND score >= 85 THEN 'OK' WHEN cm = codigo_actual THEN 'DUDOSO' ELSE 'ERRADO' END AS veredicto FROM v)
  GROUP BY veredicto"""))
def m19(spark, sf):
    l = text_lines(spark, sf).select(
        "line_id", F.when(F.col("line_no") == 7, "m2 $ 1 $").otherwise(F.col("texto")).alias("texto"),
        F.when(F.col("doc") % 3 == 0, F.col("codigo") + 1).otherwise(F.col("codigo")).alias("codigo_actual"))
    judged = M.readjudicate(M.link_lines(l, matches(spark, sf)))
    return judged.groupBy("veredicto").agg(F.count("*").alias("n"))


@query("m20_pending_triage", on("texts", "lines", "pool", "scored", sql=f"""
  WITH p AS (SELECT line_id AS id, lower(texto) AS texto, prov_id AS proveedor, floor(pu * 100.0 + 0.5) / 100.0 AS precio FROM lines JOIN texts USING (codigo)),
  g AS (SELECT texto, count(*) AS n_filas, min(id) AS primer_id, array_to_string(list_sort(list_distinct(list(CAST(proveedor AS VARCHAR)))), ',') AS proveedores,
               array_to_string(list_transform(list_sort(list_distinct(list(precio)))[1:4], lambda x: CAST(CAST(floor(x * 100 + 0.5) AS BIGINT) AS VARCHAR)), ',') AS precios FROM p GROUP BY texto),
  s AS (SELECT lower(texto) AS texto, alias_id, max(score) AS score FROM scored WHERE score >= 48 GROUP BY 1, 2),
  t9 AS (SELECT * FROM (SELECT texto, p.*, score AS s0, row_number() OVER (PARTITION BY texto ORDER BY score DESC, conf DESC, alias_id) AS previo FROM s JOIN pool p USING (alias_id)) WHERE previo <= 9),
  b AS (SELECT *, {NORM.format(c='texto')} AS tnorm, {GROUPS.format(c='texto')} AS gt, {GROUPS.format(c='denominacion')} AS ga FROM t9),
  b1 AS (SELECT *, CASE WHEN gt = ga AND gt <> 0 THEN least(100.0, s0 + 6) WHEN gt <> ga THEN least(s0, 84.0) ELSE s0 END AS s1,
                {NUMS.format(c='tnorm')} AS tnums, len(string_split(tnorm, ' ')) AS nt, len(string_split(norm, ' ')) AS na FROM b),
  b2 AS (SELECT *, CASE WHEN least(nt, na) <= 2 AND tnorm <> norm AND NOT (sintetico AND len(nums) > 0 AND nt >= na) THEN least(s1, 84.0) ELSE s1 END AS s2,
                len(list_filter(nums, lambda x: NOT list_contains(tnums, x))) AS lost FROM b1),
  b3 AS (SELECT *, floor(CASE WHEN lost > 0 THEN least(s2, greatest(60.0, 84.0 - 8.0 * lost))
                        WHEN len(nums) > 0 AND len(nums) = len(tnums) AND s2 < 85 THEN least(s2 + 4, 84.9) ELSE s2 END * 10.0 + 0.5) / 10.0 AS score FROM b2),
  m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY texto ORDER BY score DESC, conf DESC, previo) AS rk FROM b3) WHERE rk <= 3),
  c AS (SELECT texto, arg_min(codigo, rk) AS codigo, arg_min(score, rk) AS score, string_agg(codigo || ' ' || nivel, ',' ORDER BY rk) AS candidatos
        FROM (SELECT *, CASE WHEN score >= 85 THEN 'automatico' WHEN score >= 60 THEN 'dudoso' ELSE 'sin_match' END AS nivel FROM m) GROUP BY texto),
  z AS (SELECT g.*, c.codigo, c.score, c.candidatos, CASE WHEN coalesce(c.score, 0) >= 85 THEN 'A_fuerte' WHEN coalesce(c.score, 0) >= 60 THEN 'B_dudoso' ELSE 'C_sin' END AS banda
        FROM g LEFT JOIN c USING (texto))
  SELECT *, row_number() OVER (ORDER BY banda, -coalesce(score, 0), texto) AS puesto FROM z"""))
def m20(spark, sf):
    pending = text_lines(spark, sf).select(
        F.col("line_id").alias("id"), "texto", F.col("prov_id").alias("proveedor"), F.col("pu").alias("precio"))
    texts = pending.select(F.lower("texto").alias("texto")).distinct()
    found = M.match(texts, pool(spark, sf), brands(spark, sf), rules=NO_RULES)
    cents = F.transform("precios_vistos", lambda x: F.floor(x * 100 + 0.5).cast("string"))
    named = F.transform("candidatos", lambda x: F.concat_ws(" ", x["codigo"].cast("string"), x["nivel"]))
    return M.triage(pending, found, max_prices=4).select(
        "texto", "n_filas", "primer_id", F.array_join("proveedores", ",").alias("proveedores"), F.array_join(cents, ",").alias("precios"), "codigo", "score",
        F.array_join(named, ",").alias("candidatos"), "banda", "puesto")


@query("m20_pending_members", on("texts", "lines", sql="SELECT lower(texto) AS texto, line_id AS id FROM lines JOIN texts USING (codigo)"))
def m20_members(spark, sf):
    return M.triage_members(text_lines(spark, sf).select("texto", F.col("line_id").alias("id")))


@query("m21_key_resolution", on("texts", sql="""
  WITH d AS (SELECT DISTINCT k FROM (SELECT regexp_replace(lower(CASE WHEN codigo % 2 = 0 THEN substr(texto, 1, 14) ELSE texto || ' extra' END), '[^a-z0-9]', '', 'g') AS k FROM texts)),
  p AS (SELECT regexp_replace(lower(texto), '[^a-z0-9]', '', 'g') AS kk, min(codigo) AS pos FROM texts GROUP BY 1)
  SELECT k, arg_min(kk, (k <> kk, pos)) AS kk FROM d JOIN p ON starts_with(kk, k) OR starts_with(k, kk) GROUP BY k"""))
def m21(spark, sf):
    m = materials(spark, sf).withColumn("texto", line_text())
    short = F.when(F.col("codigo") % 2 == 0, F.substring("texto", 1, 14)).otherwise(F.concat("texto", F.lit(" extra")))
    return M.resolve_keys(
        m.select(T.match_key(short).alias("k")), m.select(T.match_key(F.col("texto")).alias("kk"), F.col("codigo").alias("pos")))


def v1_tables(spark, sf):
    """Every material's text as a line, its type and brand as category; one code in three is confirmed by text."""
    m = materials(spark, sf).withColumn("rubro", F.concat_ws(" ", "p_type", "p_brand"))
    k = F.col("codigo")
    lines_ = m.select(k.alias("linea"), line_text().alias("texto"), F.lit("").alias("cod_prov"),
                      F.when(k % 101 == 0, "OTRO").otherwise(F.col("rubro")).alias("rubro_prov"))
    items = m.select("codigo", "rubro", F.col("p_brand").alias("marca"), full_name().alias("nombre"))
    equiv = m.select(F.when(k % 3 == 0, line_text()).otherwise(F.concat(F.lit("otro "), line_text())).alias("clave"), k.alias("cod_int"))
    return lines_, items, equiv.groupBy("clave").agg(F.min("cod_int").alias("cod_int"))


@query("m14_score_v1")
def m14(spark, sf):
    """Best three items of each line's whole scope with score, origin and band."""
    return M.match_v1(*v1_tables(spark, sf)).select("linea", "rank", "codigo", "score", "origen", "accion")


@query("m5_partial_ratio")
def m5(spark, sf):
    """Best-window ratio of each text and the nine candidates of the ranked match."""
    t = prepared_texts(spark, sf)
    top = M.best_aliases(t, pool(spark, sf)).select("tkey", "alias_id", F.col("norm").alias("a_norm"))
    return shuffled(t.select("texto", "norm", "tkey")).join(top, "tkey").select("texto", "alias_id", partial_ratio("norm", "a_norm").alias("parcial"))


@query("m15_category_scope", on("texts", sql="""
  WITH l AS (SELECT p_partkey AS linea, CASE WHEN p_partkey % 11 = 0 THEN 'OTRO' ELSE p_type END AS rubro_prov,
                    CASE WHEN p_partkey % 3 = 0 THEN (p_partkey * 7) % (SELECT count(*) FROM part) END AS confirmado FROM part),
  n AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)
  SELECT linea, coalesce(n, 0) + CASE WHEN c.p_type <> rubro_prov THEN 1 ELSE 0 END AS n_candidatos,
         CASE WHEN coalesce(n, 0) + CASE WHEN c.p_type <> rubro_prov THEN 1 ELSE 0 END < 5 THEN 'todo' ELSE 'rubro' END AS alcance
  FROM l LEFT JOIN n ON n.p_type = rubro_prov LEFT JOIN part c ON c.p_partkey = confirmado"""))
def m15(spark, sf):
    m = materials(spark, sf)
    size = m.agg(F.count("*").alias("total"))  # one row
    l = m.join(size).select(
        F.col("codigo").alias("linea"), F.when(F.col("codigo") % 11 == 0, "OTRO").otherwise(F.col("rubro")).alias("rubro_prov"),
        F.when(F.col("codigo") % 3 == 0, (F.col("codigo") * 7) % F.col("total")).alias("confirmado"))
    return M.v1_scope(l, m).select("linea", "n_candidatos", "alcance")


@query("m16_confirmed_boost", on("lines", sql="""
  WITH n AS (SELECT count(*) AS total FROM part),
  l AS (SELECT line_id, 'c' || ((codigo * 3) % total) AS cod_prov, 'd' || codigo AS desc_prov, codigo, CAST(codigo % 101 AS DOUBLE) AS score FROM lines, n),
  e AS (SELECT 'c' || p_partkey AS clave, (p_partkey * 7) % total AS cod_int FROM part, n WHERE p_partkey % 5 <> 0
        UNION ALL SELECT 'd' || p_partkey, p_partkey FROM part WHERE p_partkey % 3 <> 0)
  SELECT line_id, coalesce(a.cod_int, b.cod_int) AS confirmado, CASE WHEN codigo = coalesce(a.cod_int, b.cod_int) THEN greatest(score, 90.0) ELSE score END AS score,
         CASE WHEN codigo = coalesce(a.cod_int, b.cod_int) THEN 'EQUIV' ELSE 'IA' END AS origen
  FROM l LEFT JOIN e a ON cod_prov = a.clave LEFT JOIN e b ON desc_prov = b.clave"""))
def m16(spark, sf):
    """Equivalences of all items; a flag leaves one code in five and one text in three unconfirmed."""
    k = F.col("codigo")
    m = materials(spark, sf)
    total = m.agg(F.count("*").alias("total"))  # one row
    l = lines(spark, sf).join(total).select(
        "line_id", F.concat(F.lit("c"), ((k * 3) % F.col("total")).cast("string")).alias("cod_prov"),
        F.concat(F.lit("d"), k.cast("string")).alias("desc_prov"), "codigo", (k % 101).cast("double").alias("score"))
    by_code = m.join(total).filter(k % 5 != 0).select(F.concat(F.lit("c"), k.cast("string")).alias("clave"), ((k * 7) % F.col("total")).alias("cod_int"))
    by_text = m.filter(k % 3 != 0).select(F.concat(F.lit("d"), k.cast("string")).alias("clave"), k.alias("cod_int"))
    out = M.confirm_codes(l, by_code.unionByName(by_text))
    score, origin = M.boost(F.col("score"), k, F.col("confirmado"))
    return out.select("line_id", "confirmado", score.alias("score"), origin.alias("origen"))


@query("m17_bands_v1", on("lines", sql="""
  SELECT line_id, CASE WHEN s >= 75 THEN 'OK' WHEN s >= 60 THEN 'REVISAR' ELSE 'SIN MATCH' END AS accion FROM (SELECT line_id, floor(pu / 1000) AS s FROM lines)"""))
def m17(spark, sf):
    return lines(spark, sf).select("line_id", M.band(F.floor(F.col("pu") / 1000)).alias("accion"))


@query("c17_compare_saved", on("repriced", "owned", "texts", "matched", sql="""
  WITH ch AS (SELECT o_orderkey AS doc, o_custkey AS user_id, CAST(year(o_orderdate) AS INTEGER) AS anio, count(*) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS n_docs FROM orders),
  sel AS (SELECT r.* EXCLUDE (anio), ch.user_id, ch.anio, m.codigo AS cod FROM repriced r JOIN ch USING (doc)
               JOIN texts t ON t.codigo = r.codigo JOIN matched m ON m.texto = t.texto AND m.rank = 1 AND m.nivel = 'automatico'
               WHERE n_docs <= 20 AND precio > 0),
  c AS (SELECT user_id, anio, cod, prov_id, arg_max(precio, (fecha, doc, line_no, codigo, prov_id, pu, cant)) AS neto,
               arg_max(cant, (fecha, doc, line_no, codigo, prov_id, pu, cant)) AS cant FROM sel GROUP BY ALL),
  p AS (SELECT user_id, anio, CASE WHEN count(DISTINCT doc % 3) = 1 THEN min(doc % 3) END AS obra FROM sel GROUP BY user_id, anio)
  SELECT user_id, anio, cod AS codigo, count(*) AS n_prov, arg_min(prov_id, (neto, prov_id)) AS mejor_id, min(neto) AS minimo, any_value(obra) AS obra_comun, 'OK' AS estado
  FROM c JOIN p USING (user_id, anio) GROUP BY user_id, anio, cod
  UNION ALL SELECT DISTINCT user_id, anio, NULL, NULL, NULL, NULL, NULL, 'seleccion_invalida' FROM ch WHERE n_docs > 20"""))
def c17(spark, sf):
    """Every owner compares the quotes of each year again: repriced, matched with today's aliases, automatic lines only."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("user_id"), F.year("o_orderdate").alias("anio"))
    chosen = C.check_selection(orders, ("user_id", "anio"))
    refused = chosen.filter("not valida").select("user_id", "anio").distinct()
    l = P.with_net(text_lines(spark, sf)).drop("anio")
    saved = P.reprice_saved(l, overrides(spark, sf)).join(chosen.filter("valida").select("doc", "user_id", "anio"), "doc").filter("precio > 0")
    linked = M.link_lines(saved, matches(spark, sf)).filter("nivel = 'automatico'").withColumn("neto", F.col("precio"))
    owner = ["user_id", "anio"]
    project = linked.groupBy(*owner).agg(
        F.when(F.min(F.col("doc") % 3) == F.max(F.col("doc") % 3), F.min(F.col("doc") % 3)).alias("obra_comun"))
    keys = ("user_id", "anio", "codigo_match")
    r = C.compare(C.cells(linked, line_seq(), keys=keys), keys=keys)
    out = r.join(project, owner).select(*owner, F.col("codigo_match").alias("codigo"), "n_prov", "mejor_id", "minimo", "obra_comun", F.lit("OK").alias("estado"))
    return out.unionByName(refused.withColumn("estado", F.lit("seleccion_invalida")), allowMissingColumns=True)
