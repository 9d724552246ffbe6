"""C1-C17 on the warehouse tables; an item is compared within one year."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import exact_sum, rnd
from ..operators import compare as C
from ..operators import pricing as P
from ..sources.derived import lines, materials, suppliers
from ..sources.views import line_seq, table
from .registry import add_view, on, query


def base_cells(spark, sf):
    return C.cells(P.with_net(lines(spark, sf)), line_seq())


def rows(spark, sf):
    return C.with_saving(C.compare(base_cells(spark, sf)))


def named_rows(spark, sf):
    return C.describe(rows(spark, sf), materials(spark, sf), suppliers(spark, sf))


ROW_SQL = "codigo, anio, rubro, material, mejor, cant, n_prov, en_varios, minimo, maximo, ahorro"
ROW = [c.strip() for c in ROW_SQL.split(",")]


@query("c1_comparison_pivot", on("cells", sql="""
  SELECT codigo, anio, string_agg(proveedor || '=' || CAST(CAST(floor(neto * 100 + 0.5) AS BIGINT) AS VARCHAR), ';' ORDER BY proveedor) AS precios
  FROM cells GROUP BY codigo, anio"""))
def c1(spark, sf):
    cell = base_cells(spark, sf).join(suppliers(spark, sf), "prov_id")
    text = F.concat_ws("=", "proveedor", F.floor(F.col("neto") * 100 + 0.5).cast("string"))
    # one cell per supplier, so the list is bounded by the supplier dimension
    return cell.groupBy("codigo", "anio").agg(F.array_join(F.array_sort(F.collect_list(text)), ";").alias("precios"))


@query("c1_pivot_by_zone", on("cells", sql="""
  SELECT codigo, anio, min(neto) FILTER (r_name = 'AFRICA') AS africa, min(neto) FILTER (r_name = 'AMERICA') AS america,
         min(neto) FILTER (r_name = 'ASIA') AS asia, min(neto) FILTER (r_name = 'EUROPE') AS europe,
         min(neto) FILTER (r_name = 'MIDDLE EAST') AS middle_east
  FROM cells JOIN supplier ON s_suppkey = prov_id JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY codigo, anio"""))
def c1_zone(spark, sf):
    zones = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    zone = suppliers(spark, sf).join(n, F.col("zona") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    cell = base_cells(spark, sf).join(zone.select("prov_id", "r_name"), "prov_id")
    wide = cell.groupBy("codigo", "anio").pivot("r_name", zones).agg(F.min("neto"))
    return wide.select("codigo", "anio", *[F.col(z).alias(z.lower().replace(" ", "_")) for z in zones])


@query("c1_supplier_map", on("cells", sql="""
  SELECT codigo, anio, string_agg(prov_id || '=' || CAST(CAST(floor(neto * 100 + 0.5) AS BIGINT) AS VARCHAR) || 'x' || CAST(CAST(floor(cant) AS BIGINT) AS VARCHAR), ';' ORDER BY prov_id) AS precios
  FROM cells GROUP BY codigo, anio"""))
def c1_map(spark, sf):
    """The stored map of every row, written out in supplier order."""
    m = C.supplier_map(base_cells(spark, sf))
    text = F.transform(F.array_sort(F.map_entries("precios")), lambda e: F.concat_ws(
        "", e["key"].cast("string"), F.lit("="), F.floor(e["value"]["neto"] * 100 + 0.5).cast("string"), F.lit("x"), F.floor(e["value"]["cant"]).cast("string")))
    return m.select("codigo", "anio", F.array_join(text, ";").alias("precios"))


@query("c2_best_supplier", on("comparison", sql="SELECT codigo, anio, mejor, minimo, cant FROM comparison"))
def c2(spark, sf):
    r = C.compare(base_cells(spark, sf))
    return C.describe(r, materials(spark, sf), suppliers(spark, sf)).select("codigo", "anio", "mejor", "minimo", "cant")


@query("c3_guarded_saving", on("saved", sql="SELECT codigo, anio, ahorro FROM saved"))
def c3(spark, sf):
    return rows(spark, sf).select("codigo", "anio", "ahorro")


@query("c4_comparison_rows", on("saved", sql=f"SELECT {ROW_SQL} FROM saved ORDER BY en_varios DESC, rubro, material, codigo, anio"))
def c4(spark, sf):
    return C.ordered(named_rows(spark, sf).select(*ROW), "codigo", "anio")


@query("c5_saving_total", on("saved", sql="""
  SELECT anio, count(*) AS n_items, count(*) FILTER (en_varios) AS n_comunes,
         CAST(sum(CAST(ahorro AS DECIMAL(28,2))) AS DOUBLE) AS ahorro_total FROM saved GROUP BY anio"""))
def c5(spark, sf):
    return C.summary(rows(spark, sf), "anio")


@query("c6_filters", on("saved", sql=f"""
  SELECT {ROW_SQL} FROM saved WHERE en_varios AND rubro = 'PROMO' AND minimo > 0 AND floor(100 * (maximo - minimo) / minimo + 0.5) >= 25"""))
def c6(spark, sf):
    return C.view_filter(named_rows(spark, sf), common=True, category="PROMO", min_gap=25).select(*ROW)


add_view("seen", """
  SELECT c.codigo, c.anio, c.prov_id, c.proveedor, c.rubro, c.material, c.con_iva, c.neto, r.cant,
         floor(c.neto * (CASE WHEN c.con_iva THEN 1.105 ELSE 1.0 END) * 0.9 * 100.0 + 0.5) / 100.0 AS visto
  FROM cells c JOIN comparison r USING (codigo, anio)""", ("cells", "comparison"))
RERANK_SQL = """
  SELECT codigo, anio, arg_min(prov_id, (visto * cant, prov_id)) AS mejor_id, {saving} AS ahorro
  FROM (SELECT *, visto * cant AS total FROM seen) GROUP BY codigo, anio"""


def reranked(spark, sf, mode):
    cell = base_cells(spark, sf)
    shown = P.shown_price(F.col("neto"), False, F.col("con_iva"), 10.0)
    return C.rerank(cell, C.compare(cell), shown, mode).select("codigo", "anio", "mejor_id", "ahorro")


@query("c7_rerank_export", on("seen", sql=RERANK_SQL.format(
    saving="CASE WHEN count(*) > 1 THEN floor((max(total) - min(total)) * 100.0 + 0.5) / 100.0 ELSE 0.0 END")))
def c7_export(spark, sf):
    return reranked(spark, sf, "export")


@query("c7_rerank_screen", on("seen", sql=RERANK_SQL.format(saving="""
    CASE WHEN count(*) < 2 OR min(total) <= 0 OR max(total) > 3 * min(total) THEN 0.0
         ELSE floor(greatest(0.0, CAST(sum(CAST(total AS DECIMAL(28,4))) AS DOUBLE) / count(*) - min(total)) * 100.0 + 0.5) / 100.0 END""")))
def c7_screen(spark, sf):
    return reranked(spark, sf, "screen")


@query("c8_category_regroup", on("saved", sql="""
  SELECT r.codigo, r.anio, r.rubro, pos, primera FROM (SELECT *, codigo * 10000 + anio AS pos FROM saved) r
  JOIN (SELECT rubro, min(codigo * 10000 + anio) AS primera FROM saved GROUP BY rubro) f USING (rubro) ORDER BY primera, pos"""))
def c8(spark, sf):
    r = named_rows(spark, sf).select("codigo", "anio", "rubro", (F.col("codigo") * 10000 + F.col("anio")).alias("pos"))
    return C.regroup(r)


add_view("bought", "SELECT *, minimo * coalesce(nullif(cant, 0), 1) AS importe FROM saved", ("saved",))


@query("c9_purchase_list", on("bought", sql="""
  SELECT mejor, b.rubro, b.material, codigo, anio, cant, minimo, floor(importe * 100.0 + 0.5) / 100.0 AS subtotal, total, n_items
  FROM bought b JOIN (SELECT mejor, floor(CAST(sum(CAST(importe AS DECIMAL(28,4))) AS DOUBLE) * 100.0 + 0.5) / 100.0 AS total, count(*) AS n_items
                      FROM bought GROUP BY mejor) t USING (mejor)"""))
def c9(spark, sf):
    return C.purchase_list(named_rows(spark, sf)).select(
        "mejor", "rubro", "material", "codigo", "anio", "cant", "minimo", "subtotal", "total", "n_items")


@query("c10_purchase_cost", on("bought", sql="""
  SELECT anio, floor(CAST(sum(CAST(importe AS DECIMAL(28,4))) AS DOUBLE) * 100.0 + 0.5) / 100.0 AS total_compra, count(*) AS n FROM bought GROUP BY anio"""))
def c10(spark, sf):
    won = C.purchase_lines(rows(spark, sf))
    return won.groupBy("anio").agg(rnd(exact_sum(F.col("importe"), 4)).alias("total_compra"), F.count("*").alias("n"))


@query("c11_column_totals", on("cells", "comparison", sql="""
  SELECT prov_id, floor(CAST(sum(CAST(floor(neto * (CASE WHEN con_iva THEN 1.105 ELSE 1.0 END) * 100.0 + 0.5) / 100.0 * r.cant AS DECIMAL(28,4))) AS DOUBLE) * 100.0 + 0.5) / 100.0 AS total,
         floor(CAST(sum(CASE WHEN NOT con_iva THEN CAST(floor(floor(neto * 1.105 * 100.0 + 0.5) / 100.0 * r.cant * 100.0 + 0.5) / 100.0 AS DECIMAL(28,4)) END) AS DOUBLE) * 100.0 + 0.5) / 100.0 AS total_referencia,
         count(*) AS n_celdas
  FROM cells c JOIN comparison r USING (codigo, anio) GROUP BY prov_id"""))
def c11(spark, sf):
    cell = base_cells(spark, sf)
    return C.column_totals(cell, C.compare(cell))


@query("c12_section_rows", on("saved", sql="""
  SELECT rubro, material, CAST(grouping(rubro, material) AS BIGINT) AS nivel, count(*) AS n,
         CAST(sum(CAST(ahorro AS DECIMAL(28,2))) AS DOUBLE) AS ahorro FROM saved GROUP BY ROLLUP (rubro, material)"""))
def c12(spark, sf):
    return C.sections(named_rows(spark, sf))


@query("c13_savings_digest", on("saved", sql="""
  SELECT codigo, anio, material, mejor, ahorro FROM saved WHERE en_varios ORDER BY ahorro DESC, codigo, anio LIMIT 5"""))
def c13(spark, sf):
    return C.describe(C.digest(rows(spark, sf)), materials(spark, sf), suppliers(spark, sf)).select(
        "codigo", "anio", "material", "mejor", "ahorro")


@query("c13_digest_counts", on("lines", sql="""
  SELECT prov_id, count(*) AS n_total, count(*) FILTER (doc % 5 <> 0) AS n_match, count(*) FILTER (doc % 5 = 0) AS n_sin_match
  FROM lines GROUP BY prov_id"""))
def c13_counts(spark, sf):
    found = F.col("doc") % 5 != 0
    return lines(spark, sf).groupBy("prov_id").agg(
        F.count("*").alias("n_total"), F.count_if(found).alias("n_match"), F.count_if(~found).alias("n_sin_match"))


@query("c14_curated_merge", on("priced", sql="""
  WITH u AS (
    SELECT codigo, anio, prov_id, neto, cant, con_iva, 0 AS prio FROM (
      SELECT codigo, anio, prov_id, unnest(arg_max({'neto': neto, 'cant': cant, 'con_iva': con_iva}, (fecha, doc, line_no, codigo, prov_id, pu, cant)))
      FROM priced WHERE doc % 4 <> 0 GROUP BY codigo, anio, prov_id)
    UNION ALL
    SELECT codigo, anio, prov_id, neto, cant, con_iva, 1 FROM (
      SELECT codigo, anio, prov_id, unnest(arg_max({'neto': neto, 'cant': cant, 'con_iva': con_iva}, (fecha, doc, line_no, codigo, prov_id, pu, cant)))
      FROM priced WHERE doc % 4 = 0 AND doc % 3 <> 0 GROUP BY codigo, anio, prov_id)),
  m AS (SELECT codigo, anio, prov_id, arg_max(neto, prio) AS neto, arg_max(cant, prio) AS cant FROM u GROUP BY ALL)
  SELECT codigo, anio, count(*) AS n_prov, count(*) > 1 AS en_varios, arg_min(prov_id, (neto, prov_id)) AS mejor_id, min(neto) AS minimo
  FROM m GROUP BY codigo, anio"""))
def c14(spark, sf):
    # documents divisible by 4 hold the doubtful lines; one choice in three is rejected
    l = P.with_net(lines(spark, sf))
    auto = C.cells(l.filter("doc % 4 <> 0"), line_seq())
    chosen = C.cells(C.split_choices(l.filter("doc % 4 = 0"), F.col("doc") % 3 != 0)[0], line_seq())
    return C.compare(C.curated_cells(auto, chosen)).select("codigo", "anio", "n_prov", "en_varios", "mejor_id", "minimo")


@query("c14_rejected_unmatched", on("quotes", sql="SELECT prov_id, count(*) AS sin_match FROM quotes WHERE doc % 4 = 0 AND doc % 3 = 0 GROUP BY prov_id"))
def c14_rejected(spark, sf):
    rejected = C.split_choices(lines(spark, sf).filter("doc % 4 = 0"), F.col("doc") % 3 != 0)[1]
    return rejected.groupBy("prov_id").agg(F.count("*").alias("sin_match"))


def concept_links(spark, sf):
    l = P.with_net(lines(spark, sf))
    return l.select(
        F.col("doc").alias("concepto"),
        F.when(F.col("doc") % 15 == 0, F.lit(" ")).otherwise(F.concat(F.lit("concepto "), F.col("doc").cast("string"))).alias("nombre"),
        "line_id", "prov_id", "neto", "cant", F.lit(1.0).alias("cant_concepto"),
    )


add_view("slots", """
  SELECT doc AS concepto, prov_id, arg_max(neto, line_id) AS neto FROM priced WHERE doc % 15 <> 0 GROUP BY doc, prov_id""", ("priced",))


@query("c15_concept_rows", on("slots", sql="""
  SELECT 'emp_' || concepto AS cod_int, 'Emparejado a mano' AS rubro, 'concepto ' || concepto AS material, 1.0 AS cant, count(*) AS n_prov,
         arg_min(prov_id, (neto, prov_id)) AS mejor_id, min(neto) AS minimo, 0.0 AS ahorro, true AS en_varios
  FROM slots GROUP BY concepto HAVING count(*) >= 2"""))
def c15(spark, sf):
    return C.pair_concepts(concept_links(spark, sf)).drop("concepto")


@query("c15_left_unmatched", on("slots", "lines", sql="""
  WITH ok AS (SELECT concepto FROM slots GROUP BY concepto HAVING count(*) >= 2)
  SELECT prov_id, count(*) FILTER (concepto IS NULL) AS sin_match, count(concepto) AS emparejados
  FROM lines l LEFT JOIN ok ON doc = concepto GROUP BY prov_id"""))
def c15_left(spark, sf):
    links = concept_links(spark, sf)
    paired = C.pair_concepts(links).select("concepto", F.lit(True).alias("par"))
    both = links.join(paired, "concepto", "left")
    return both.groupBy("prov_id").agg(
        F.count_if(F.col("par").isNull()).alias("sin_match"), F.count("par").alias("emparejados"))
