"""H13-H25 on the warehouse tables (customers as users, orders as quotes, events as logs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import exact_sum, rnd
from ..operators import linkage as M
from ..operators import reports as R
from ..sources.derived import lines, materials
from ..sources.views import table
from .extract import FORMAT_SQL, e2
from .linkage import STATS_SQL, routed_lines
from .registry import on, query
from .text import customer_region


def orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("fecha"), "o_orderstatus")


@query("h13_quote_listing", """
  WITH top AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS fecha, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100)
  SELECT id, user_id, fecha, o_orderstatus, count(l_orderkey) AS n_items,
         coalesce(floor(CAST(sum(CAST(l_extendedprice * l_quantity AS DECIMAL(28,4))) AS DOUBLE) * 100.0 + 0.5) / 100.0, 0.0) AS total
  FROM top LEFT JOIN lineitem ON l_orderkey = id GROUP BY ALL""")
def h13(spark, sf):
    l = lines(spark, sf).select(F.col("doc").alias("id"), F.col("pu").alias("precio"), F.col("cant").alias("cantidad"))
    return R.quote_listing(orders(spark, sf), l)


@query("h14_quote_detail", on("lines", sql="""
  SELECT line_id, doc, pu, cant, p_name || ' ' || p_brand AS material FROM lines LEFT JOIN part ON p_partkey = codigo AND p_partkey % 10 <> 0"""))
def h14(spark, sf):
    m = materials(spark, sf).filter("codigo % 10 <> 0").select("codigo", "material")
    return lines(spark, sf).join(m, "codigo", "left").select("line_id", "doc", "pu", "cant", "material")


@query("h15_comparisons_by_project", """
  SELECT o_orderkey AS id, o_orderdate AS fecha, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 40 END AS obra,
         count(*) OVER (PARTITION BY CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 40 END) AS n_obra FROM orders""")
def h15(spark, sf):
    x = orders(spark, sf).select("id", "fecha", F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 40).alias("obra"))
    return R.grouped_by_project(x)


@query("h16_review_queue", on("quotes", sql="""
  SELECT line_id AS id, material AS texto, proveedor, fecha, 'PENDIENTE' AS estado FROM quotes
  WHERE doc % 4 = 1 AND (contains(lower(material), 'gizmo') OR contains(lower(proveedor), 'gizmo')) ORDER BY fecha DESC, line_id LIMIT 50"""))
def h16(spark, sf):
    from ..sources.views import quotes

    p = quotes(spark, sf).select(F.col("line_id").alias("id"), F.col("material").alias("texto"), "proveedor", "fecha",
                                 F.when(F.col("doc") % 4 == 1, "PENDIENTE").otherwise("VALIDADO").alias("estado"))
    return R.review_queue(p, "PENDIENTE", "Gizmo", 50)


def users(spark, sf):
    k = F.col("c_custkey")
    plan = F.when(k % 10 == 0, "advance").when(k % 10 == 1, "pro").when(k % 10 < 4, "basico").otherwise("free")
    return customer_region(spark, sf).withColumn("plan", plan)


@query("h17_business_metrics", """
  WITH u AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'advance' WHEN c_custkey % 10 = 1 THEN 'pro' WHEN c_custkey % 10 < 4 THEN 'basico' ELSE 'free' END AS plan FROM customer)
  SELECT count(*) AS total, count(*) FILTER (plan <> 'free') AS pagos,
         CAST(sum(CASE plan WHEN 'advance' THEN 48000 WHEN 'pro' THEN 48000 WHEN 'basico' THEN 19600 ELSE 0 END) AS BIGINT) AS mrr,
         floor(sum(CASE plan WHEN 'advance' THEN 48000 WHEN 'pro' THEN 48000 WHEN 'basico' THEN 19600 ELSE 0 END) / CAST(count(*) AS DOUBLE) * 100.0 + 0.5) / 100.0 AS arpu,
         floor(100.0 * count(*) FILTER (plan <> 'free') / CAST(count(*) AS DOUBLE) * 10.0 + 0.5) / 10.0 AS conversion_pct FROM u""")
def h17(spark, sf):
    return R.plan_metrics(users(spark, sf))


@query("h17_users_per_plan", """
  SELECT CASE WHEN c_custkey % 10 = 0 THEN 'advance' WHEN c_custkey % 10 = 1 THEN 'pro' WHEN c_custkey % 10 < 4 THEN 'basico' ELSE 'free' END AS plan, count(*) AS usuarios
  FROM customer GROUP BY 1""")
def h17_plans(spark, sf):
    return R.users_per_plan(users(spark, sf))


@query("h17_catalogue_counts", on("judged", sql="""
  SELECT 'materiales' AS tabla, count(*) AS filas FROM part UNION ALL SELECT 'denominaciones', count(*) FROM judged WHERE regla = 'queda'
  UNION ALL SELECT 'proveedores', count(*) FROM supplier UNION ALL SELECT 'presupuestos', count(*) FROM orders"""))
def h17_counts(spark, sf):
    return R.catalogue_counts(materiales=materials(spark, sf), denominaciones=usable_aliases(spark, sf),
                              proveedores=table(spark, sf, "supplier"), presupuestos=table(spark, sf, "orders"))


@query("h18_users_by_region", """
  SELECT CASE c_nationkey % 9 WHEN 0 THEN 'Centro' WHEN 1 THEN 'Buenos Aires' WHEN 2 THEN 'NOA' WHEN 3 THEN 'Patagonia' WHEN 4 THEN 'CABA'
         WHEN 6 THEN 'Cuyo' WHEN 7 THEN 'NEA' ELSE 'Otras / sin dato' END AS zona, count(*) AS usuarios FROM customer GROUP BY 1 ORDER BY 2 DESC""")
def h18(spark, sf):
    return customer_region(spark, sf).groupBy("zona").agg(F.count("*").alias("usuarios")).orderBy(F.desc("usuarios"), "zona")


@query("h19_cumulative_growth", """
  SELECT mes, nuevos, CAST(sum(nuevos) OVER (ORDER BY mes) AS BIGINT) AS acumulado FROM (
    SELECT strftime(f, '%Y-%m') AS mes, count(*) AS nuevos FROM (SELECT min(o_orderdate) AS f FROM orders GROUP BY o_custkey) GROUP BY 1)""")
def h19(spark, sf):
    first = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("alta"))
    return R.cumulative_growth(first, "alta")


@query("h20_monthly_billing", """
  SELECT strftime(ts, '%Y-%m') AS periodo, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,2))) AS DOUBLE) AS monto FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def h20(spark, sf):
    return R.per_period(table(spark, sf, "events").filter("event_type = 'purchase'"), "ts", "yyyy-MM", F.col("value"))


@query("h20_daily_catalogue", """SELECT strftime(ts, '%Y-%m-%d') AS periodo, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1""")
def h20_daily(spark, sf):
    return R.per_period(table(spark, sf, "events").filter("event_type = 'signup'"), "ts", "yyyy-MM-dd")


@query("h20_ocr_cost", """SELECT strftime(ts, '%Y-%m') AS periodo, count(*) AS n, floor(count(*) * 0.02 * 100.0 + 0.5) / 100.0 AS costo FROM events WHERE event_type = 'view' GROUP BY 1""")
def h20_ocr(spark, sf):
    x = R.per_period(table(spark, sf, "events").filter("event_type = 'view'"), "ts", "yyyy-MM")
    return x.withColumn("costo", rnd(F.col("n") * R.OCR_COST))


@query("h21_effective_plan", """
  WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'advance' WHEN c_custkey % 10 = 1 THEN 'pro' WHEN c_custkey % 10 < 4 THEN 'basico' ELSE 'free' END AS plan0,
      CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-10' END AS hasta, CASE WHEN c_custkey % 2 = 0 THEN '2024-01' ELSE '2023-12' END AS mes, CAST(c_custkey % 7 AS INTEGER) AS um, CAST(c_custkey % 3 AS INTEGER) AS ut,
      CASE WHEN c_custkey % 4 < 2 THEN '2024-01' ELSE '2023-06' END AS desde FROM customer),
  e AS (SELECT *, CASE WHEN plan0 <> 'free' AND hasta < TIMESTAMP '2024-01-15' THEN 'free' ELSE plan0 END AS plan FROM p),
  f AS (SELECT c_custkey, plan, CASE WHEN plan IN ('advance', 'pro') THEN 0 WHEN plan = 'basico' THEN CASE WHEN mes = '2024-01' THEN um ELSE 0 END ELSE ut END AS usados,
               CASE WHEN plan IN ('advance', 'pro') THEN 999 WHEN plan = 'basico' THEN 6 + CASE WHEN desde = '2024-01' THEN 2 ELSE 0 END ELSE 1 END AS limite FROM e)
  SELECT *, greatest(0, limite - usados) AS restantes FROM f""")
def h21(spark, sf):
    k = F.col("c_custkey")
    p = users(spark, sf).select(
        "c_custkey", "plan", F.when(k % 3 == 0, F.lit("2024-01-10").cast("timestamp")).alias("plan_hasta"), F.when(k % 2 == 0, "2024-01").otherwise("2023-12").alias("mes_usos"),
        (k % 7).cast("int").alias("usos_mes"), (k % 3).cast("int").alias("usos_total"), F.when(k % 4 < 2, F.lit("2024-01-03")).otherwise("2023-06-03").cast("timestamp").alias("plan_desde"))
    return R.effective_plan(p, F.lit("2024-01-15").cast("timestamp")).select("c_custkey", "plan", "usados", "limite", "restantes")


@query("h22_promo_status", """
  WITH n AS (SELECT user_id AS codigo, count(*) AS canjes FROM events WHERE event_type = 'purchase' GROUP BY 1),
  c AS (SELECT c_custkey AS codigo, c_custkey % 5 <> 0 AS activo, TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 40 AS INTEGER)) AS vence, c_custkey % 20 AS tope FROM customer)
  SELECT codigo, coalesce(canjes, 0) AS canjes, CASE WHEN NOT activo THEN 'inactivo' WHEN vence < TIMESTAMP '2024-01-15' THEN 'vencido' WHEN coalesce(canjes, 0) >= tope THEN 'agotado' ELSE 'vigente' END AS estado
  FROM c LEFT JOIN n USING (codigo)""")
def h22(spark, sf):
    k = F.col("c_custkey")
    codes = table(spark, sf, "customer").select(
        k.alias("codigo"), (k % 5 != 0).alias("activo"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 40).cast("int")).cast("timestamp").alias("vence"), (k % 20).alias("tope"))
    uses = table(spark, sf, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("codigo"))
    return R.promo_status(codes, uses, F.lit("2024-01-15").cast("timestamp")).select("codigo", "canjes", "estado")


@query("h24_tenant_view", on("owned", sql="""
  SELECT doc, count(*) AS n_lineas, CAST(sum(CAST(pu AS DECIMAL(28,2))) AS DOUBLE) AS monto FROM owned WHERE user_id % 10 = 7 GROUP BY doc"""))
def h24(spark, sf):
    parents = orders(spark, sf).select(F.col("id").alias("doc"), "user_id")
    mine = R.children_of(lines(spark, sf), parents, "doc", F.col("user_id") % 10 == 7)
    return mine.groupBy("doc").agg(F.count("*").alias("n_lineas"), exact_sum(F.col("pu")).alias("monto"))


def usable_aliases(spark, sf):
    from ..operators import linkage as M
    from .linkage import NO_RULES, aliases

    return M.judge_aliases(M.prepare_aliases(aliases(spark, sf), NO_RULES)).filter("regla = 'queda'").select("codigo")


@query("h25_without_alias", on("judged", sql="SELECT p_partkey AS codigo FROM part WHERE p_partkey NOT IN (SELECT codigo FROM judged WHERE regla = 'queda')"))
def h25(spark, sf):
    return materials(spark, sf).select("codigo").join(usable_aliases(spark, sf), "codigo", "left_anti")


@query("h25_top_by_aliases", on("judged", sql="""
  SELECT codigo, count(*) AS n FROM judged WHERE regla = 'queda' GROUP BY 1 ORDER BY n DESC, codigo LIMIT 10"""))
def h25_top(spark, sf):
    n = usable_aliases(spark, sf).groupBy("codigo").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "codigo").limit(10)


@query("h26_match_rate_with_method", on("routed", "items", sql=f"""
  WITH s AS ({STATS_SQL.format(by="doc")}), f AS (SELECT doc, {FORMAT_SQL} AS metodo FROM items GROUP BY doc)
  SELECT s.*, metodo FROM s LEFT JOIN f USING (doc)"""))
def h26_method(spark, sf):
    """Match rate of each document beside the format its lines were read with."""
    method = e2(spark, sf).select("doc", F.col("formato").alias("metodo"))
    return M.match_stats(routed_lines(spark, sf), "doc").join(method, "doc", "left")
