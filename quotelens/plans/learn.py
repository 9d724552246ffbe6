"""Snapshots and batches cut out of the warehouse tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learn as L
from ..operators.curation import curate_pending
from ..operators.keyed import KeyedTable, latest
from ..session import new_folder
from ..sources.derived import lines, materials
from ..sources.views import table
from .registry import on, query


@query("l1_keyed_upsert", """
  WITH t AS (SELECT p_partkey + CASE WHEN p_partkey % 2 = 1 THEN 1000000000 ELSE 0 END AS codigo, p_name AS nombre, p_size AS factor FROM part),
  b AS (SELECT l_partkey AS codigo, arg_max(l_linenumber * 10 + l_suppkey % 10, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS factor FROM lineitem GROUP BY 1)
  SELECT codigo, CASE WHEN b.codigo IS NOT NULL THEN 'nuevo' ELSE nombre END AS nombre, CAST(coalesce(b.factor, t.factor) AS BIGINT) AS factor FROM t FULL JOIN b USING (codigo)""")
def l1(spark, sf):
    # items with an odd number are filed under another code, so the batch brings new keys
    other = F.col("codigo") + F.when(F.col("codigo") % 2 == 1, 1_000_000_000).otherwise(0)
    t = materials(spark, sf).select(other.alias("codigo"), F.col("p_name").alias("nombre"), F.col("p_size").cast("bigint").alias("factor"))
    b = lines(spark, sf).select(
        "codigo", F.lit("nuevo").alias("nombre"), (F.col("line_no") * 10 + F.col("prov_id") % 10).cast("bigint").alias("factor"),
        F.struct("fecha", "doc", "line_no", "prov_id", "pu").alias("seq"))
    return L.upsert(t, b, ["codigo"])


def confirmations(spark, sf):
    m = materials(spark, sf).select("codigo", "p_name")
    text = F.when(F.col("codigo") % 10 == 0, F.concat(F.lit("m2 x "), (F.col("line_no")).cast("string"))).otherwise(
        F.concat_ws(" ", F.upper("p_name"), (F.col("prov_id") % 3).cast("string")))
    return lines(spark, sf).join(m, "codigo").select(
        "doc", "codigo", text.alias("desc_prov"), F.concat(F.lit("Casa "), (F.col("prov_id") % 3).cast("string")).alias("proveedor"), F.col("line_id").alias("seq"), "line_id")


@query("l2_alias_confirmation", on("quotes", sql="""
  WITH b AS (SELECT codigo, d AS denominacion, count(*) AS veces, arg_min(p, line_id) AS prov FROM (
      SELECT codigo, line_id, CASE WHEN codigo % 10 = 0 THEN 'm2 x ' || line_no ELSE lower(p_name) || ' ' || (prov_id % 3) END AS d, 'casa_' || (prov_id % 3) AS p FROM quotes) GROUP BY ALL),
  a AS (SELECT p_partkey AS codigo, lower(p_name) || ' 1' AS denominacion, CAST(p_size AS BIGINT) AS frecuencia, CAST(80 AS INTEGER) AS confianza, 'base' AS origen FROM part)
  SELECT codigo, denominacion, CASE WHEN a.codigo IS NULL THEN veces ELSE frecuencia + coalesce(veces, 0) END AS frecuencia,
         CAST(CASE WHEN veces IS NULL THEN confianza WHEN a.origen IS NULL AND veces = 1 THEN 80 ELSE least(99, 80 + coalesce(frecuencia, 0) + veces) END AS INTEGER) AS confianza,
         coalesce(a.origen, 'usuario_' || prov) AS origen
  FROM a FULL JOIN b USING (codigo, denominacion) WHERE a.origen IS NOT NULL OR regexp_matches(denominacion, '[a-z]{4,}')"""))
def l2(spark, sf):
    a = materials(spark, sf).select("codigo", F.concat(F.lower("p_name"), F.lit(" 1")).alias("denominacion"), F.col("p_size").alias("frecuencia"),
                                    F.lit(80).alias("confianza"), F.lit("base").alias("origen"))
    return L.confirm_aliases(a, confirmations(spark, sf))


@query("l3_line_confirmation", on("lines", sql="""
  SELECT line_id, CASE WHEN doc % 3 = 0 THEN codigo + 1 ELSE codigo END AS codigo, CASE WHEN doc % 3 = 0 THEN 'CONFIRMADO' ELSE 'REVISAR' END AS estado,
         CASE WHEN doc % 3 = 0 THEN 'usuario' ELSE 'fuzzy' END AS origen FROM lines"""))
def l3(spark, sf):
    items = lines(spark, sf).select("line_id", "codigo", F.lit("REVISAR").alias("estado"), F.lit("fuzzy").alias("origen"))
    c = confirmations(spark, sf).filter("doc % 3 = 0").select("line_id", (F.col("codigo") + 1).alias("codigo"), "seq")
    return L.confirm_lines(items, c)


def unmatched(spark, sf):
    m = materials(spark, sf).select("codigo", "material")
    return lines(spark, sf).join(m, "codigo").select(
        "line_id", F.concat(F.lit(" "), F.col("material")).alias("texto"), F.col("prov_id").alias("proveedor"), F.col("pu").alias("precio"), "codigo")


@query("l2_keyed_aliases", on("quotes", sql="""
  WITH b AS (SELECT codigo, CASE WHEN codigo % 10 = 0 THEN 'm2 x ' || line_no ELSE lower(p_name) || ' ' || (prov_id % 3) END AS denominacion FROM quotes)
  SELECT codigo, denominacion, count(*) AS frecuencia FROM b WHERE regexp_matches(denominacion, '[a-z]{4,}') GROUP BY ALL"""))
def l2_keyed(spark, sf):
    """Confirmations in three batches, the second one twice, into a stored alias table."""
    c = confirmations(spark, sf)
    store = L.alias_store(spark, new_folder(spark), code=c.schema["codigo"].dataType)
    part = F.pmod(F.hash("line_id"), F.lit(3))
    for lote in (0, 1, 1, 2):
        L.learn_into(store, c.filter(part == lote), lote)
    return store.read().select("codigo", "denominacion", "frecuencia")


@query("l1_stored_upsert", on("lines", sql="""
  SELECT codigo, prov_id, arg_max(pu, (fecha, line_id)) AS precio, max(fecha)::DATE AS fecha FROM lines GROUP BY ALL"""))
def l1_stored(spark, sf):
    """Prices by item and supplier in three batches out of order, the first one again at the end."""
    x = lines(spark, sf).select("codigo", "prov_id", F.col("pu").alias("precio"), F.col("fecha").cast("date").alias("fecha"), F.struct("fecha", "line_id").alias("seq"))
    store = KeyedTable(spark, new_folder(spark), x.schema, ("codigo",))
    for lote, k in enumerate((2, 0, 1, 2)):
        store.merge(x.filter(F.pmod(F.hash("seq"), F.lit(3)) == k), latest(("codigo", "prov_id"), "seq"), lote)
    return store.read().drop("seq")


@query("l4_pending_rows", on("quotes", sql="""
  SELECT sha256(line_id) AS id, material AS descripcion_original, lower(material) AS descripcion_normalizada, prov_id AS proveedor, pu AS precio_visto, 'PENDIENTE' AS estado
  FROM quotes"""))
def l4(spark, sf):
    return L.open_pending(unmatched(spark, sf))[0]


@query("l4_pending_prices", on("quotes", sql="""
  SELECT sha256(line_id) AS codigo_pendiente, prov_id AS proveedor, pu AS precio, 'UN' AS unidad, 'pipeline' AS origen FROM quotes"""))
def l4_prices(spark, sf):
    return L.open_pending(unmatched(spark, sf))[1]


def resolved(spark, sf):
    u = unmatched(spark, sf)
    pending, prices = L.open_pending(u)
    k = F.col("codigo") % 4
    decisions = u.filter("codigo % 4 < 3").select(
        L.pending_id(F.col("line_id")).alias("id"), F.when(k == 0, "linkear").when(k == 1, "rechazar").otherwise("crear").alias("accion"),
        F.when(k == 0, F.col("codigo")).alias("codigo"))
    aliases = materials(spark, sf).filter("codigo % 8 = 0").select("codigo", F.lower("material").alias("denominacion"))
    return L.resolve_pending(pending, prices, aliases, decisions)


@query("l5_pending_resolution", on("quotes", sql="""
  SELECT sha256(line_id) AS id, lower(material) AS descripcion_normalizada, CASE codigo % 4 WHEN 0 THEN 'VALIDADO' WHEN 1 THEN 'RECHAZADO' WHEN 2 THEN 'VALIDADO' ELSE 'PENDIENTE' END AS estado,
         CASE WHEN codigo % 4 = 0 THEN codigo END AS codigo_asignado FROM quotes"""))
def l5(spark, sf):
    return resolved(spark, sf)[0]


@query("l5_repointed_prices", on("quotes", sql="""
  SELECT CASE WHEN codigo % 4 = 0 THEN codigo END AS codigo, CASE WHEN codigo % 4 <> 0 THEN sha256(line_id) END AS codigo_pendiente, pu AS precio FROM quotes"""))
def l5_prices(spark, sf):
    return resolved(spark, sf)[1]


@query("l5_new_aliases", on("quotes", sql="""
  SELECT codigo, lower(material) AS denominacion, count(*) AS frecuencia, 95 AS confianza, 'admin_validacion' AS origen
  FROM quotes WHERE codigo % 8 = 4 GROUP BY ALL"""))
def l5_aliases(spark, sf):
    return resolved(spark, sf)[2]


@query("l6_batch_curation", on("quotes", sql="""
  SELECT codigo, lower(material) AS denominacion, CAST(count(*) AS BIGINT) AS frecuencia, 96 AS confianza, CASE WHEN codigo % 8 = 0 THEN 'duplicado' ELSE 'nuevo' END AS accion
  FROM quotes GROUP BY ALL"""))
def l6(spark, sf):
    plan = unmatched(spark, sf).groupBy("texto", "codigo").agg(F.count("*").alias("n_ids"))
    aliases = materials(spark, sf).filter("codigo % 8 = 0").select("codigo", F.lower("material").alias("denominacion"))
    return L.curate_batch(plan, aliases)


CURATED = """
  WITH t AS (SELECT codigo, texto, regexp_replace(lower(texto), '[^a-z0-9]', '', 'g') AS kk FROM texts),
  d AS (SELECT codigo AS orden, codigo, CASE WHEN codigo % 2 = 0 THEN substr(texto, 1, 14) ELSE texto || ' extra' END AS dec, codigo % 3 = 1 AS rechazar FROM t WHERE codigo % 3 <> 2),
  k AS (SELECT *, regexp_replace(lower(dec), '[^a-z0-9]', '', 'g') AS k FROM d),
  p AS (SELECT kk, min(codigo) AS pos, count(*) AS n_ids FROM t GROUP BY kk),
  r AS (SELECT k, arg_min(kk, (k <> kk, pos)) AS kk FROM (SELECT DISTINCT k FROM k) JOIN p ON starts_with(kk, k) OR starts_with(k, kk) GROUP BY k)"""


def curated(spark, sf):
    """Review rows are the materials' texts; two in three have a decision, by a shortened or lengthened text, one of them a rejection."""
    from .linkage import line_text

    m = materials(spark, sf).withColumn("texto", line_text())
    k = F.col("codigo")
    short = F.when(k % 2 == 0, F.substring("texto", 1, 14)).otherwise(F.concat("texto", F.lit(" extra")))
    pending = m.select(k.alias("id"), F.col("texto").alias("descripcion_original"), k.alias("orden"))
    decisions = m.filter("codigo % 3 <> 2").select(short.alias("texto"), "codigo", (k % 3 == 1).alias("rechazar"), k.alias("orden"))
    return curate_pending(pending, decisions, m.filter("codigo % 8 = 0").select("codigo", F.lower("texto").alias("denominacion")))


@query("l6_curated_pending", on("texts", sql=CURATED + """,
  w AS (SELECT kk, arg_max(rechazar, (rechazar, orden)) AS rechazar, arg_max(codigo, (rechazar, orden)) AS cod FROM k JOIN r USING (k) GROUP BY kk)
  SELECT t.codigo AS id, CASE WHEN rechazar IS NULL THEN 'PENDIENTE' WHEN rechazar THEN 'RECHAZADO' ELSE 'VALIDADO' END AS estado,
         CASE WHEN NOT rechazar THEN cod END AS codigo_asignado FROM t LEFT JOIN w USING (kk)"""))
def l6_pending(spark, sf):
    return curated(spark, sf)[0]


@query("l6_curated_aliases", on("texts", sql=CURATED + """,
  a AS (SELECT codigo, lower(trim(dec)) AS denominacion, CAST(sum(n_ids) AS BIGINT) AS frecuencia FROM k JOIN r USING (k) JOIN p USING (kk) WHERE NOT rechazar GROUP BY ALL)
  SELECT a.*, 96 AS confianza, CASE WHEN t.codigo IS NULL THEN 'nuevo' ELSE 'duplicado' END AS accion
  FROM a LEFT JOIN (SELECT codigo, lower(texto) AS denominacion FROM t WHERE codigo % 8 = 0) t USING (codigo, denominacion)"""))
def l6_aliases(spark, sf):
    return curated(spark, sf)[1]


@query("l7_code_absorption", """
  SELECT CASE WHEN p_partkey % 5 = 3 THEN p_partkey - 3 ELSE p_partkey END AS codigo, p_name AS denominacion, CAST(sum(p_size) AS BIGINT) AS frecuencia,
         max(CAST(80 + p_partkey % 15 AS INTEGER)) AS confianza FROM part GROUP BY 1, 2""")
def l7(spark, sf):
    k = F.col("codigo")
    a = materials(spark, sf).select("codigo", F.col("p_name").alias("denominacion"), F.col("p_size").cast("bigint").alias("frecuencia"), (80 + k % 15).cast("int").alias("confianza"))
    merges = materials(spark, sf).filter("codigo % 5 = 3").select(k.alias("absorbido"), (k - 3).alias("sobrevive"))
    return L.absorb_codes(a, merges)


@query("l7_moved_prices", on("lines", sql="""
  SELECT line_id, CASE WHEN codigo % 5 = 3 THEN codigo - 3 ELSE codigo END AS codigo, pu FROM lines"""))
def l7_prices(spark, sf):
    k = F.col("codigo")
    merges = materials(spark, sf).filter("codigo % 5 = 3").select(k.alias("absorbido"), (k - 3).alias("sobrevive"))
    return L.absorb_rows(lines(spark, sf).select("line_id", "codigo", "pu"), merges)


@query("c16_remembered_pairs", """
  WITH b AS (SELECT o_custkey AS user_id, l_suppkey AS prov_id, p_name AS texto, count(*) AS veces,
                    'concepto ' || arg_max(l_orderkey, l_orderkey) AS nuevo FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
  m AS (SELECT c_custkey AS user_id, c_custkey % 10 AS prov_id, 'red widget' AS texto, CAST(2 AS BIGINT) AS frecuencia, 'viejo' AS nombre FROM customer)
  SELECT user_id, prov_id, texto, coalesce(frecuencia, 0) + coalesce(veces, 0) AS frecuencia, coalesce(nuevo, nombre) AS nombre FROM m FULL JOIN b USING (user_id, prov_id, texto)""")
def c16(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("user_id"))
    links = lines(spark, sf).join(o, "doc").join(materials(spark, sf).select("codigo", "p_name"), "codigo").select(
        "user_id", "prov_id", F.col("p_name").alias("texto"), F.concat(F.lit("concepto "), F.col("doc").cast("string")).alias("nombre"), F.col("doc").alias("seq"))
    memory = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 10).alias("prov_id"), F.lit("red widget").alias("texto"),
        F.lit(2).cast("bigint").alias("frecuencia"), F.lit("viejo").alias("nombre"))
    return L.remember_pairs(memory, links)
