"""H1-H12 on the warehouse tables."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import history as H
from ..operators import linkage as M
from ..operators.units import convert_units
from ..sources.derived import lines, materials, suppliers
from ..sources.views import line_seq
from .registry import add_view, on, query

add_view("hist", """
  SELECT *, pu AS precio, CASE WHEN anio >= 1999 THEN 'pipeline' ELSE 'legacy' END AS origen, CASE WHEN prov_id % 10 = 0 THEN 'USD' END AS moneda FROM quotes""", ("quotes",))


def history(spark, sf):
    l = lines(spark, sf).join(suppliers(spark, sf), "prov_id")
    return l.withColumn("precio", F.col("pu")).withColumn("origen", F.when(F.col("anio") >= 1999, "pipeline").otherwise("legacy")).withColumn(
        "moneda", F.when(F.col("prov_id") % 10 == 0, "USD")).withColumn("unidad", F.lit(None).cast("string"))


@query("h1_price_series", on("hist", sql="""
  SELECT codigo, fecha, proveedor, precio, 'UN' AS unidad, coalesce(moneda, 'ARS') AS moneda, line_id FROM hist WHERE origen = 'pipeline' ORDER BY codigo, fecha"""))
def h1(spark, sf):
    return H.price_series(history(spark, sf)).orderBy("codigo", "fecha", "line_id")


@query("h2_latest_price", on("hist", sql="""
  SELECT codigo, prov_id, arg_max(precio, (fecha, doc, line_no, codigo, prov_id, pu, cant)) AS precio, max(fecha) AS fecha FROM hist GROUP BY codigo, prov_id"""))
def h2(spark, sf):
    return H.latest(history(spark, sf), line_seq(), "codigo", "prov_id")


def same_business(spark, sf):
    return suppliers(spark, sf).filter("prov_id % 4 = 1").select("prov_id", (F.col("prov_id") - 1).alias("grupo_id"))


@query("h3_supplier_unification", on("hist", sql="""
  SELECT CASE WHEN prov_id % 4 = 1 THEN prov_id - 1 ELSE prov_id END AS prov_id, count(*) AS n FROM hist GROUP BY 1"""))
def h3(spark, sf):
    return H.unify_suppliers(history(spark, sf), same_business(spark, sf)).groupBy("prov_id").agg(F.count("*").alias("n"))


add_view("spread", """
  SELECT codigo, anio, mon AS moneda, count(DISTINCT prov) AS n_prov, CAST(count(*) AS BIGINT) AS n_precios, min(precio) AS minimo, max(precio) AS maximo,
         floor(max(precio) / min(precio) * 100.0 + 0.5) / 100.0 AS razon, max(precio) > 3 * min(precio) AS disperso
  FROM (SELECT *, coalesce(moneda, 'ARS') AS mon, CASE WHEN prov_id % 4 = 1 THEN prov_id - 1 ELSE prov_id END AS prov FROM hist)
  GROUP BY codigo, anio, mon HAVING count(DISTINCT prov) >= 2""", ("hist",))


def spread(spark, sf):
    h = H.unify_suppliers(history(spark, sf), same_business(spark, sf)).withColumn("moneda", F.coalesce("moneda", F.lit("ARS")))
    return H.dispersion(h, "codigo", "anio", "moneda")


@query("h4_dispersion", on("spread", sql="""
  SELECT s.*, p_name || ' ' || p_brand AS material, codigo % 13 <> 0 AS con_conversion FROM spread s LEFT JOIN part ON codigo = p_partkey"""))
def h4(spark, sf):
    m = materials(spark, sf).select("codigo", "material")
    conv = materials(spark, sf).filter("codigo % 13 <> 0").select("codigo", F.lit(True).alias("conv"))
    return spread(spark, sf).join(m, "codigo", "left").join(conv, "codigo", "left").withColumn(
        "con_conversion", F.coalesce("conv", F.lit(False))).drop("conv")


INDEX_SQL = """
  SELECT {by} count(*) AS n, count(*) FILTER (NOT disperso) AS n_sanos,
         floor(CAST(sum(CAST(b AS DECIMAL(28,4))) AS DOUBLE) / count(*) * 10000.0 + 0.5) / 10000.0 AS media,
         floor(CAST(sum(CAST(b AS DECIMAL(28,4))) FILTER (NOT disperso) AS DOUBLE) / count(*) FILTER (NOT disperso) * 10000.0 + 0.5) / 10000.0 AS media_guarda,
         floor(median(b) * 10000.0 + 0.5) / 10000.0 AS mediana, floor(median(b) FILTER (NOT disperso) * 10000.0 + 0.5) / 10000.0 AS mediana_guarda,
         floor(100.0 * count(*) FILTER (NOT disperso) / CAST(count(*) AS DOUBLE) * 10.0 + 0.5) / 10.0 AS pct_sanos
  FROM (SELECT *, floor((maximo - minimo) / minimo * 10000.0 + 0.5) / 10000.0 AS b FROM spread {where}) {group}"""


@query("h5_gap_index", on("spread", sql=INDEX_SQL.format(by="", where="", group="")))
def h5(spark, sf):
    return H.gap_index(spread(spark, sf))


@query("h5_gap_index_by_year", on("spread", sql=INDEX_SQL.format(by="anio, moneda,", where="WHERE n_prov >= 3", group="GROUP BY anio, moneda")))
def h5_year(spark, sf):
    return H.gap_index(spread(spark, sf).filter("n_prov >= 3"), "anio", "moneda")


@query("h6_basket_index", on("spread", sql=INDEX_SQL.format(
    by="codigo,", where="JOIN part ON codigo = p_partkey AND p_size <= 5", group="GROUP BY codigo")))
def h6(spark, sf):
    from ..sources.views import table

    basket = table(spark, sf, "part").filter("p_size <= 5").select(F.col("p_partkey").alias("codigo"))
    return H.gap_index(spread(spark, sf).join(basket, "codigo", "left_semi"), "codigo")


@query("h6_basket_ranking", on("spread", sql="""
  SELECT * FROM (SELECT codigo, anio, moneda, b AS brecha, row_number() OVER (ORDER BY b DESC, codigo, anio, moneda) AS puesto
                 FROM (SELECT *, floor((maximo - minimo) / minimo * 10000.0 + 0.5) / 10000.0 AS b FROM spread JOIN part ON codigo = p_partkey AND p_size <= 5))
  WHERE puesto <= 25"""))
def h6_ranking(spark, sf):
    """The basket's materials by gap, a report of 25."""
    from ..sources.views import table

    basket = table(spark, sf, "part").filter("p_size <= 5").select(F.col("p_partkey").alias("codigo"))
    r = H.ranked_gaps(spread(spark, sf).join(basket, "codigo", "left_semi"), "codigo", "anio", "moneda")
    return r.select("codigo", "anio", "moneda", "brecha", "puesto")


@query("h7_sensitivity", on("spread", sql="""
  WITH g AS (SELECT floor((maximo - minimo) / minimo * 10000.0 + 0.5) / 10000.0 AS b, codigo % 5 = 0 AS marca FROM spread),
  c AS (SELECT 'todos' AS corte, b FROM g UNION ALL SELECT 'sin_banda_iva', b FROM g WHERE NOT (b BETWEEN 0.08 AND 0.13)
        UNION ALL SELECT 'sin_marca', b FROM g WHERE NOT marca UNION ALL SELECT 'sin_extremos', b FROM g WHERE b <= 1.5)
  SELECT corte, count(*) AS n, floor(median(b) * 10000.0 + 0.5) / 10000.0 AS mediana FROM c GROUP BY corte"""))
def h7(spark, sf):
    return H.sensitivity(spread(spark, sf), F.col("codigo") % 5 == 0)


def stored_again(spark, sf):
    """Match every stored line again, convert its unit, and say why it enters the rebuilt history or does not."""
    from .linkage import matches, text_lines

    l = text_lines(spark, sf).withColumn("texto", F.when(F.col("line_no") == 7, "").otherwise(F.col("texto"))).withColumn("precio", F.col("pu"))
    linked = M.link_lines(l, matches(spark, sf))
    # even materials are sold by the piece; a line quoted by the box without a size is unclear
    conv = materials(spark, sf).filter("codigo % 2 = 0").select(
        "codigo", F.lit("un").alias("unidad_comercial"), F.lit(1.0).alias("factor"), F.lit("UN").alias("unidad_base"))
    conv = conv.withColumn("factor", F.lit(99999.0))
    x = linked.select("line_id", "prov_id", "texto", "precio", "codigo_match", "score", F.col("codigo_match").alias("codigo"), F.col("texto").alias("desc"),
                      F.when(F.col("doc") % 3 == 1, "caja").otherwise("UN").alias("unidad"), "pu", "cant")
    return H.rebuild(convert_units(x, conv))


@query("h8_history_rebuild", on("matched", "texts", "lines", sql="""
  SELECT motivo, count(*) AS n FROM (
    SELECT CASE WHEN line_no = 7 THEN 'sin_texto_o_precio' WHEN m.codigo IS NULL THEN 'sin_match' WHEN m.score < 85 THEN 'score_bajo'
                WHEN m.codigo % 2 = 0 AND doc % 3 = 1 THEN 'unidad_ambigua' ELSE 'aceptado' END AS motivo
    FROM lines l JOIN texts t USING (codigo) LEFT JOIN (SELECT * FROM matched WHERE rank = 1) m ON t.texto = m.texto) GROUP BY motivo"""))
def h8(spark, sf):
    return stored_again(spark, sf).groupBy("motivo").agg(F.count("*").alias("n"))


REBUILT = """
  SELECT line_id, m.codigo, prov_id, pu AS precio, CASE WHEN doc % 3 = 1 THEN 'CAJA' ELSE 'UN' END AS unidad
  FROM lines l JOIN texts t USING (codigo) JOIN (SELECT * FROM matched WHERE rank = 1 AND score >= 85) m ON t.texto = m.texto
  WHERE line_no <> 7 AND NOT (m.codigo % 2 = 0 AND doc % 3 = 1)"""


@query("h8_rebuilt_rows", on("matched", "texts", "lines", sql=REBUILT))
def h8_rows(spark, sf):
    return H.rebuilt_rows(stored_again(spark, sf)).drop("conversion_aplicada", "origen")


@query("h8_rebuild_summary", on("matched", "texts", "lines", sql=f"""
  WITH r AS ({REBUILT}), p AS (SELECT codigo, count(*) AS n, count(DISTINCT prov_id) AS p FROM r GROUP BY codigo)
  SELECT CAST(sum(n) AS BIGINT) AS filas, count(*) AS materiales, count(*) FILTER (p > 1) AS multi_proveedor, CAST(0 AS BIGINT) AS convertidas FROM p"""))
def h8_summary(spark, sf):
    return H.rebuild_summary(H.rebuilt_rows(stored_again(spark, sf)))


def judged(spark, sf):
    """Lines of odd documents with a verdict; history rows are the lines of even documents, priced from the same list."""
    k = F.col("doc") % 7
    return lines(spark, sf).filter("doc % 2 = 1").select(
        F.col("line_id").alias("item_id"), "codigo", (F.floor(F.col("pu") / 1000) * 1000).alias("precio"),
        F.when(k == 1, "OK").when(k < 5, "ERRADO").otherwise("DUDOSO").alias("veredicto"),
        F.when(k != 2, F.col("codigo") + 1).alias("sugerido"), F.when(k == 3, 70.0).otherwise(90.0).alias("score"))


def priced_history(spark, sf):
    return lines(spark, sf).filter("doc % 2 = 0").select(
        F.col("line_id").alias("id"), "codigo", (F.floor(F.col("pu") / 1000) * 1000).cast("double").alias("precio"), "prov_id")


add_view("judged_items", """
  SELECT line_id AS item_id, codigo, floor(pu / 1000) * 1000 AS precio,
         CASE WHEN doc % 7 = 1 THEN 'proteger' WHEN doc % 7 IN (0, 4) THEN 'reasignar' ELSE 'borrar' END AS accion FROM lines WHERE doc % 2 = 1""", ("lines",))


@query("h9_correction_plan", on("judged_items", "lines", sql="""
  WITH h AS (SELECT line_id AS id, codigo, floor(pu / 1000) * 1000 AS precio FROM lines WHERE doc % 2 = 0)
  SELECT id, codigo, CASE WHEN bool_or(accion = 'proteger') THEN 'proteger' WHEN bool_or(accion = 'borrar') THEN 'borrar' ELSE 'reasignar' END AS accion,
         CASE WHEN NOT bool_or(accion = 'proteger') AND NOT bool_or(accion = 'borrar') THEN codigo + 1 END AS destino
  FROM h JOIN judged_items USING (codigo, precio) GROUP BY id, codigo HAVING bool_or(accion <> 'proteger')"""))
def h9(spark, sf):
    return H.correction_plan(judged(spark, sf), priced_history(spark, sf))[0]


@query("h9_orphans", on("judged_items", "lines", sql="""
  SELECT item_id, codigo, accion FROM judged_items j WHERE accion <> 'proteger'
    AND NOT EXISTS (SELECT 1 FROM lines l WHERE doc % 2 = 0 AND l.codigo = j.codigo AND floor(pu / 1000) * 1000 = j.precio)"""))
def h9_orphans(spark, sf):
    return H.correction_plan(judged(spark, sf), priced_history(spark, sf))[1]


@query("h10_verified_fix", on("quotes", sql="""
  SELECT CASE WHEN line_no = 3 THEN line_id || 'x' ELSE line_id END AS id, CASE WHEN doc % 2 = 0 THEN 'reapuntar' ELSE 'borrar' END AS accion,
         CASE WHEN line_no = 3 THEN 'NO EXISTE' WHEN doc % 5 = 0 OR (prov_id + 1) % 6 = 0 THEN 'NO COINCIDE' ELSE 'APLICAR' END AS resultado FROM quotes"""))
def h10(spark, sf):
    return H.verified_fix(*fix_tables(spark, sf))


@query("h10_applied_snapshot", on("quotes", sql="""
  SELECT line_id AS id, CASE WHEN ok THEN codigo + 1 ELSE codigo END AS codigo, proveedor, pu AS precio
  FROM (SELECT *, line_no <> 3 AND doc % 5 <> 0 AND (prov_id + 1) % 6 <> 0 AS ok FROM quotes) WHERE NOT (ok AND doc % 2 = 1)"""))
def h10_applied(spark, sf):
    return H.apply_fix(*fix_tables(spark, sf))


def fix_tables(spark, sf):
    """Instructions taken earlier, and the history; since then some prices and supplier names changed."""
    h = lines(spark, sf).join(suppliers(spark, sf), "prov_id")
    wrong_name = (F.col("prov_id") + 1) % 6 == 0
    instructions = h.select(
        F.when(F.col("line_no") == 3, F.concat("line_id", F.lit("x"))).otherwise(F.col("line_id")).alias("id"),
        F.when(F.col("doc") % 2 == 0, "reapuntar").otherwise("borrar").alias("accion"), "codigo",
        F.when(wrong_name, "otro").otherwise(F.lower("proveedor")).alias("proveedor"),
        (F.col("pu") + F.when(F.col("doc") % 5 == 0, 2.0).otherwise(0.25)).alias("precio"), (F.col("codigo") + 1).alias("destino"))
    return (instructions, h.select(F.col("line_id").alias("id"), "codigo", "proveedor", F.col("pu").alias("precio")))


@query("h11_conversion_reconcile", """
  WITH t AS (SELECT p_partkey AS codigo, CAST(p_size AS DOUBLE) AS factor FROM part WHERE p_partkey % 3 <> 0),
  w AS (SELECT p_partkey AS codigo, CAST(p_size + p_partkey % 2 AS DOUBLE) AS factor FROM part WHERE p_partkey % 5 <> 0)
  SELECT codigo, coalesce(w.factor, t.factor) AS factor, CASE WHEN w.factor IS NULL THEN 'queda' WHEN t.factor IS NULL THEN 'insertar' WHEN t.factor <> w.factor THEN 'actualizar' ELSE 'igual' END AS accion
  FROM t FULL JOIN w USING (codigo)""")
def h11(spark, sf):
    m = materials(spark, sf)
    t = m.filter("codigo % 3 <> 0").select("codigo", F.col("p_size").cast("double").alias("factor"))
    w = m.filter("codigo % 5 <> 0").select("codigo", (F.col("p_size") + F.col("codigo") % 2).cast("double").alias("factor"))
    return H.reconcile(t, w, ["codigo"], ["factor"])


@query("h12_alias_reassignment", """
  WITH a AS (SELECT p_partkey AS alias_id, p_partkey % 50 AS codigo, p_name AS denominacion FROM part),
  m AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN p_partkey + 1000000 ELSE p_partkey END AS alias_id, p_name AS denominacion, (p_partkey + p_size) % 50 AS destino FROM part WHERE p_partkey % 2 = 1)
  SELECT alias_id, destino, CASE WHEN NOT EXISTS (SELECT 1 FROM a WHERE a.alias_id = m.alias_id) THEN 'no_existe'
         WHEN EXISTS (SELECT 1 FROM a WHERE a.codigo = m.destino AND a.denominacion = m.denominacion AND a.alias_id <> m.alias_id) THEN 'borrar' ELSE 'reasignar' END AS accion FROM m""")
def h12(spark, sf):
    m = materials(spark, sf)
    k = F.col("codigo")
    a = m.select(k.alias("alias_id"), (k % 50).alias("codigo"), F.col("p_name").alias("denominacion"))
    moves = m.filter("codigo % 2 = 1").select(
        F.when(k % 9 == 0, k + 1000000).otherwise(k).alias("alias_id"), F.col("p_name").alias("denominacion"), ((k + F.col("p_size")) % 50).alias("destino"))
    return H.reassign_aliases(a, moves)


