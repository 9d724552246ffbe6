"""S1-S18 on the warehouse tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rnd
from ..operators import compare as C
from ..operators import ingest as I
from ..operators import pricing as P
from ..sources import sheets as S
from ..sources.derived import lines, materials, suppliers
from ..sources.views import line_seq, quotes, table
from .registry import on, query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("s1_scan_projection", "SELECT p_partkey AS codigo, p_name AS denominacion, p_brand AS marca FROM part")
def s1(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("codigo"), F.col("p_name").alias("denominacion"), F.col("p_brand").alias("marca"))


def sheet_files(spark, sf):
    """One small sheet per line: preamble, header, the item, a summary row."""
    m = materials(spark, sf).select("codigo", "p_name")
    x = lines(spark, sf).join(m, "codigo")
    k = F.col("doc") % 3
    sep = F.when(k == 0, ",").when(k == 1, ";").otherwise("\t")
    num = F.format_string("%.2f", "pu")
    pu = F.when(k == 1, F.replace(num, F.lit("."), F.lit(","))).otherwise(num)
    name = F.concat(F.lit('"'), F.col("p_name"), F.lit(', "'), F.lit('"chico"'), F.lit('""'))
    head = F.when(F.col("line_no") % 2 == 0, F.concat_ws("|", F.lit("Código"), F.lit("Descripción"), F.lit("Cant."), F.lit("Precio Unit. $"), F.lit("Importe"))).otherwise(
        F.concat_ws("|", F.lit("SKU"), F.lit("Detalle del pedido"), F.lit("Cantidad"), F.lit("P. Unit"), F.lit("Total")))
    row = F.concat_ws("|", F.col("codigo").cast("string"), name, F.floor("cant").cast("string"), pu, F.lit(""))
    text = F.concat_ws("\n", F.lit("Lista|de|precios|del|mes"), head, row, F.lit("|Total|||999"))
    return x.select(F.col("line_id").alias("archivo"), F.translate(text, "|", "\u0001").alias("t"), sep.alias("s")).select("archivo", F.replace("t", F.lit("\u0001"), F.col("s")).alias("contenido"))


@query("s2_delimited_sheets", on("quotes", sql="""
  SELECT line_id AS archivo, CAST(2 AS INTEGER) AS fila, CAST(codigo AS VARCHAR) AS c0, p_name || ', "chico"' AS c1, CAST(CAST(floor(cant) AS BIGINT) AS VARCHAR) AS c2 FROM quotes"""))
def s2(spark, sf):
    r = S.sheet_rows(sheet_files(spark, sf)).filter("fila = 2")
    return r.select("archivo", "fila", *[F.get("celdas", i).alias(f"c{i}") for i in range(3)])


@query("s3_header_detection", on("quotes", sql="""
  SELECT line_id AS archivo, 1 AS cabecera, 0 AS i_cod, 1 AS i_desc, 2 AS i_cant, 3 AS i_pu, 4 AS i_total FROM quotes"""))
def s3(spark, sf):
    return S.find_headers(sheet_files(spark, sf))


@query("s3_sheet_items", on("quotes", sql="""
  SELECT line_id AS archivo, 2 AS fila, CAST(codigo AS VARCHAR) AS cod, p_name || ', "chico"' AS "desc", cant, pu, floor(pu * cant * 100.0 + 0.5) / 100.0 AS total FROM quotes"""))
def s3_items(spark, sf):
    return S.sheet_items(sheet_files(spark, sf))


@query("s4_row_cleanup", on("quotes", sql="""
  SELECT line_id, p AS pu, CASE WHEN t <= 0 THEN floor(p * c * 100.0 + 0.5) / 100.0 ELSE t END AS total, c AS cant FROM (
    SELECT line_id, t, c, CASE WHEN p0 <= 0 AND t > 0 THEN floor(t / c * 100.0 + 0.5) / 100.0 ELSE p0 END AS p FROM (
      SELECT line_id, CASE WHEN line_no = 2 THEN 0 ELSE pu END AS p0, CASE WHEN line_no = 3 THEN 0 ELSE floor(pu * cant * 100.0 + 0.5) / 100.0 END AS t,
             CASE WHEN line_no = 4 THEN 1 ELSE cant END AS c FROM quotes WHERE line_no <> 5)) WHERE p > 0"""))
def s4(spark, sf):
    x = lines(spark, sf).select(
        "line_id", F.when(F.col("line_no") == 5, " Total: $").otherwise("item").alias("desc"), F.when(F.col("line_no") != 2, F.col("pu")).alias("pu"),
        F.when(F.col("line_no") != 3, rnd(F.col("pu") * F.col("cant"))).alias("total"), F.when(F.col("line_no") == 4, 0.0).otherwise(F.col("cant")).alias("cant"))
    return S.clean_items(x).select("line_id", "pu", "total", "cant")


@query("s5_json_config", """
  SELECT s_name AS nombre_canonico, CASE WHEN s_suppkey % 3 = 0 THEN 1.0 ELSE 1.105 END AS factor_iva, CAST(s_suppkey % 5 AS DOUBLE) AS descuento, a AS alias
  FROM supplier CROSS JOIN LATERAL (SELECT unnest([upper(s_name), 'ALIAS ' || s_suppkey]) AS a)""")
def s5(spark, sf):
    s = suppliers(spark, sf)
    one = F.struct(F.col("proveedor").alias("nombre_canonico"), F.when(F.col("prov_id") % 3 == 0, 1.0).alias("factor_iva_default"),
                   (F.col("prov_id") % 5).cast("double").alias("descuento_default"),
                   F.array(F.upper("proveedor"), F.concat(F.lit("ALIAS "), F.col("prov_id").cast("string"))).alias("alias_archivo"))
    docs = s.select(F.to_json(F.struct(F.array(one).alias("proveedores"))).alias("j"))
    return S.explode_config(docs.select(F.from_json("j", S.CONFIG_SCHEMA).alias("d")).select("d.*"))


@query("s6_catalogue_last_wins", on("quotes", sql="""
  SELECT codigo, arg_max(rubro, k) AS categoria, arg_max(material, k) AS denominacion_principal, arg_max('U' || line_no, k) AS unidad, arg_max(CASE WHEN line_no % 2 = 0 THEN p_brand ELSE '' END, k) AS marca
  FROM (SELECT *, (fecha, doc, line_no, codigo, prov_id, pu, cant) AS k FROM quotes) GROUP BY codigo"""))
def s6(spark, sf):
    q = quotes(spark, sf)
    r = q.select("codigo", "rubro", F.concat(F.lit(" "), F.col("material")).alias("item"), F.lit("").alias("detalle"),
                 F.concat(F.lit("U"), F.col("line_no").cast("string")).alias("unidad"), F.when(F.col("line_no") % 2 == 0, F.col("p_brand")).alias("marca"), line_seq().alias("k"))
    m = I.material_rows(I.last_record(r, "codigo", F.col("k")))
    return m.select("codigo", "categoria", "denominacion_principal", F.element_at("unidades_posibles", 1)["unidad"].alias("unidad"),
                    F.coalesce(F.get("marcas_disponibles", 0), F.lit("")).alias("marca"))


@query("s7_first_aliases", """
  SELECT DISTINCT p_partkey AS codigo, t AS denominacion, o AS origen, 90 AS confianza FROM (
    SELECT p_partkey, lower(p_name) AS t, 'migracion_item' AS o FROM part UNION ALL
    SELECT p_partkey, lower(p_type), 'migracion_detalle' FROM part WHERE p_partkey % 4 <> 0)""")
def s7(spark, sf):
    r = materials(spark, sf).select("codigo", F.upper("p_name").alias("item"), F.when(F.col("codigo") % 4 == 0, F.col("p_name")).otherwise(F.col("p_type")).alias("detalle"))
    return I.first_aliases(r)


def equivalence_rows(spark, sf):
    k = F.col("codigo")
    q = lines(spark, sf).join(materials(spark, sf).select("codigo", "p_name"), "codigo").join(suppliers(spark, sf), "prov_id")
    return q.select(F.when(F.col("line_no") == 1, F.lit(None)).when(F.col("line_no") == 2, k + 100_000_000).otherwise(k).alias("codigo"),
                    F.concat(F.lit(" "), F.upper("p_name")).alias("desc"), F.when(F.col("prov_id") % 2 == 0, F.col("proveedor")).alias("proveedor"), F.col("line_id").alias("seq"))


@query("s8_equivalence_import", on("quotes", sql="""
  SELECT codigo, lower(p_name) AS denominacion, arg_min(CASE WHEN prov_id % 2 = 0 THEN 'equivalencias_' || lower(proveedor) ELSE 'equivalencias_historico' END, line_id) AS origen, 95 AS confianza
  FROM quotes WHERE line_no > 2 GROUP BY ALL"""))
def s8(spark, sf):
    return I.import_equivalences(equivalence_rows(spark, sf), materials(spark, sf))[0]


@query("s8_rejected_counts", on("quotes", sql="""
  SELECT CASE WHEN line_no = 1 THEN 'vacio' WHEN line_no = 2 THEN 'sin_codigo' ELSE 'entra' END AS motivo, count(*) AS n FROM quotes GROUP BY 1"""))
def s8_rejected(spark, sf):
    return I.import_equivalences(equivalence_rows(spark, sf), materials(spark, sf))[1]


@query("s9_reviewed_drafts", on("quotes", sql="""
  SELECT DISTINCT codigo, lower(p_name) AS denominacion, 90 AS confianza FROM quotes WHERE line_no > 1"""))
def s9(spark, sf):
    """Draft sheets with their columns in varying order; one row in each has no code."""
    q = lines(spark, sf).join(materials(spark, sf).select("codigo", "p_name"), "codigo")
    turned = F.col("doc") % 2 == 0
    code = F.when(F.col("line_no") > 1, F.col("codigo").cast("string")).otherwise("")
    pair = lambda a, b: F.when(turned, F.array(a, F.lit("x"), b)).otherwise(F.array(b, a))
    head = q.select(F.col("line_id").alias("archivo"), F.lit(0).alias("fila"), pair(F.lit("Cod interno prop."), F.lit("Desc proveedor")).alias("celdas"))
    body = q.select(F.col("line_id").alias("archivo"), F.lit(1).alias("fila"), pair(code, F.upper("p_name")).alias("celdas"))
    return _drafts(spark, sf, head.unionByName(body))[0].drop("origen")


def _drafts(spark, sf, rows):
    """Rows of draft sheets with their columns found by name; the sheet's supplier is in ``proveedor`` where there is one."""
    h = S.fragment_columns(rows, {"cod": "COD INTERNO PROP", "desc": "DESC PROVEEDOR"})
    x = rows.join(h, "archivo").filter("fila > cabecera")
    data = x.select(F.get("celdas", F.col("i_cod")).try_cast("bigint").alias("codigo"), F.get("celdas", F.col("i_desc")).alias("desc"),
                    F.col("proveedor") if "proveedor" in rows.columns else F.lit("").alias("proveedor"), F.col("archivo").alias("seq"))
    return I.import_equivalences(data, materials(spark, sf), 90)


def supplier_drafts(spark, sf):
    """One sheet a supplier in each draft; the first row of each has no code."""
    q = lines(spark, sf).join(materials(spark, sf).select("codigo", "p_name"), "codigo").join(suppliers(spark, sf).select("prov_id", "proveedor"), "prov_id")
    code = F.when(F.col("line_no") > 1, F.col("codigo").cast("string")).otherwise("")
    both = F.array(F.struct(F.lit(0).alias("fila"), F.array(F.lit("DESC PROVEEDOR"), F.lit("COD INTERNO PROP")).alias("celdas")),
                   F.struct(F.lit(1).alias("fila"), F.array(F.upper("p_name"), code).alias("celdas")))
    rows = q.select(F.col("line_id").alias("archivo"), "proveedor", F.explode(both).alias("f")).select("archivo", "proveedor", "f.*")
    return _drafts(spark, sf, rows)


@query("s9_drafts_by_supplier", on("quotes", sql="""
  SELECT codigo, lower(p_name) AS denominacion, 90 AS confianza, arg_min('equivalencias_' || lower(proveedor), line_id) AS origen FROM quotes WHERE line_no > 1 GROUP BY ALL"""))
def s9_suppliers(spark, sf):
    return supplier_drafts(spark, sf)[0]


@query("s9_rejected_counts", on("quotes", sql="""
  SELECT CASE WHEN line_no = 1 THEN 'vacio' ELSE 'entra' END AS motivo, count(*) AS n FROM quotes GROUP BY 1"""))
def s9_rejected(spark, sf):
    return supplier_drafts(spark, sf)[1]


def decisions(spark, sf):
    k = F.col("doc") % 4
    q = lines(spark, sf).join(materials(spark, sf).select("codigo", "p_name"), "codigo")
    code = F.concat(F.lit("COD"), F.lpad(F.col("codigo").cast("string"), 5, "0"))
    return q.select(
        F.col("p_name").alias("desc"), F.when(k == 0, "CARGAR").when(k == 1, "CAMBIAR").when(k == 2, "DESCARTAR").otherwise("CARGAR").alias("decision"),
        code.alias("cod_propuesto"), F.when(k == 1, F.concat(code, F.lit("B"))).alias("cod_correcto"), F.col("line_id").alias("seq"), "doc", "prov_id", "line_no", "codigo")


CONSOLIDATED = """
  WITH d AS (SELECT upper(p_name) || '|COD' || lpad(CAST(codigo AS VARCHAR), 5, '0') || CASE WHEN doc % 4 = 1 THEN 'B' ELSE '' END AS clave, line_no, doc,
             CASE doc % 4 WHEN 1 THEN 'CAMBIAR' WHEN 2 THEN 'DESCARTAR' ELSE 'CARGAR' END AS decision, 'COD' || lpad(CAST(codigo AS VARCHAR), 5, '0') AS cod, line_id FROM quotes),
  o AS (SELECT clave, decision, cod, line_id AS seq, false AS nueva FROM (SELECT *, row_number() OVER (PARTITION BY clave ORDER BY line_id) AS r FROM d WHERE line_no = 1 AND decision = 'CARGAR') WHERE r = 1),
  f AS (SELECT clave, arg_min(decision, line_id) AS decision, arg_min(cod, line_id) AS cod, min(line_id) AS seq, true AS nueva FROM d WHERE line_no > 1 AND decision <> 'DESCARTAR' AND clave NOT IN (SELECT clave FROM o) GROUP BY clave),
  u AS (SELECT * FROM o UNION ALL SELECT * FROM f)"""


def consolidated(spark, sf):
    d = decisions(spark, sf)
    first = d.filter("line_no = 1 and decision = 'CARGAR'")
    first = first.groupBy("desc", "cod_propuesto").agg(F.min_by(F.struct("decision", "cod_correcto", "seq"), "seq").alias("u")).select("desc", "cod_propuesto", "u.*")
    return I.consolidate(first, d.filter("line_no > 1"))


@query("s10_decision_consolidation", on("quotes", sql=CONSOLIDATED + """
  SELECT clave, decision, nueva, row_number() OVER (ORDER BY nueva, seq, clave) AS n FROM u"""))
def s10(spark, sf):
    return I.numbered(consolidated(spark, sf), "nueva", "seq", "clave").select("clave", "decision", "nueva", "n")


@query("s10_prefix_histogram", on("quotes", sql=CONSOLIDATED + """
  SELECT substr(cod, 1, 4) AS prefijo, count(*) AS n FROM u WHERE nueva AND decision = 'CARGAR' GROUP BY 1"""))
def s10_hist(spark, sf):
    return I.prefix_histogram(consolidated(spark, sf).filter("nueva"))


@query("s11_equivalence_seeding", on("quotes", sql="""
  WITH b AS (SELECT 'P' || (codigo % 50) AS cod_prov, 'prov' || (prov_id % 7) AS proveedor, arg_max('COD' || lpad(CAST(codigo AS VARCHAR), 5, '0'), line_id) AS cod_int, arg_max(p_name, line_id) AS item_int
             FROM quotes WHERE doc % 4 IN (0, 3) GROUP BY ALL),
  t AS (SELECT 'P' || p_partkey AS cod_prov, 'prov1' AS proveedor, 'viejo' AS cod_int, '' AS item_int FROM part)
  SELECT cod_prov, proveedor, coalesce(b.cod_int, t.cod_int) AS cod_int, coalesce(b.item_int, t.item_int) AS item_int, CASE WHEN b.cod_int IS NULL THEN 'manual' ELSE 'auto' END AS fuente,
         CASE WHEN b.cod_int IS NULL THEN 100 ELSE 85 END AS confianza FROM t FULL JOIN b USING (cod_prov, proveedor)"""))
def s11(spark, sf):
    d = decisions(spark, sf).withColumn("fuente", F.concat(F.lit("prov"), (F.col("prov_id") % 7).cast("string"), F.lit("_lista.xlsx"))).withColumn(
        "cod_prov", F.concat(F.lit("P"), (F.col("codigo") % 50).cast("string")))
    # a printed code has five digits, which items from 100,000 on share
    cat = materials(spark, sf).select("codigo", F.col("p_name").alias("item_int"))
    t = materials(spark, sf).select(F.concat(F.lit("P"), F.col("codigo").cast("string")).alias("cod_prov"), F.lit("prov1").alias("proveedor"),
                                                           F.lit("viejo").alias("cod_int"), F.lit("").alias("item_int"), F.lit("manual").alias("fuente"), F.lit(100).alias("confianza"))
    return I.seed_equivalences(t, d, cat, item="codigo")


@query("s12_equivalence_map", on("quotes", sql="""
  WITH s AS (SELECT p_name AS clave, 'base' || p_partkey AS cod, 0 AS prio, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS seq FROM part
    UNION ALL SELECT p_name, CASE doc % 4 WHEN 1 THEN 'COD' || lpad(CAST(codigo AS VARCHAR), 5, '0') || 'B' ELSE 'COD' || lpad(CAST(codigo AS VARCHAR), 5, '0') END, 1, line_id FROM quotes WHERE doc % 4 <> 2
    UNION ALL SELECT p_name, 'carga' || codigo, 2, line_id FROM quotes WHERE doc % 101 = 0)
  SELECT clave, arg_max(cod, (prio, seq)) AS cod FROM s GROUP BY clave"""))
def s12(spark, sf):
    m = materials(spark, sf)
    stored = m.select(F.col("p_name").alias("clave"), F.concat(F.lit("base"), F.col("codigo").cast("string")).alias("cod"), F.lpad(F.col("codigo").cast("string"), 12, "0").alias("seq"))
    dec = decisions(spark, sf).withColumn("clave", F.col("desc"))
    # a load names a code in one document of 101; the others leave it blank
    loads = lines(spark, sf).join(m.select("codigo", "p_name"), "codigo").select(
        F.col("p_name").alias("clave"), F.when(F.col("doc") % 101 == 0, F.concat(F.lit("carga"), F.col("codigo").cast("string"))).otherwise(" ").alias("cod"), F.col("line_id").alias("seq"))
    return I.equivalence_map(stored, dec, loads)


@query("s13_supplier_seeding", on("quotes", sql="""
  SELECT DISTINCT p AS nombre FROM (SELECT proveedor AS p FROM quotes UNION ALL SELECT 'Casa ' || n_name FROM nation) WHERE p NOT IN (SELECT s_name FROM supplier WHERE s_suppkey % 3 = 0)"""))
def s13(spark, sf):
    q = lines(spark, sf).join(suppliers(spark, sf), "prov_id").select(F.concat(F.lit(" "), F.col("proveedor"), F.lit(" ")).alias("proveedor"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("Casa "), F.col("n_name")).alias("proveedor"))
    return I.seed_suppliers(suppliers(spark, sf).filter("prov_id % 3 = 0").select(F.col("proveedor").alias("nombre")), q, n)


@query("s14_snapshot_manifest", " UNION ALL ".join(f"SELECT '{t}' AS tabla, count(*) AS filas FROM {t}" for t in TABLES))
def s14(spark, sf):
    out = None
    for t in TABLES:
        n = table(spark, sf, t).agg(F.count("*").alias("filas")).select(F.lit(t).alias("tabla"), "filas")
        out = n if out is None else out.unionByName(n)
    return out


@query("s15_price_append_rows", on("priced", sql="""
  SELECT line_id, proveedor, codigo, 'UN' AS unidad, neto AS precio, CAST(greatest(1, cant) AS INTEGER) AS cantidad, pu AS precio_raw, 'ARS' AS moneda, material AS texto_original, 'pipeline' AS origen
  FROM priced WHERE doc % 5 <> 0"""))
def s15(spark, sf):
    q = P.with_net(quotes(spark, sf)).withColumn("estado", F.when(F.col("doc") % 5 == 0, "REVISAR").otherwise("MATCH"))
    return I.price_rows(q.withColumn("codigo_match", F.col("codigo")).withColumn("unidad", F.lit(None).cast("string")).withColumn("moneda", F.lit(None).cast("string"))
                        .withColumn("precio", F.col("neto")).withColumn("texto", F.col("material")))


def uploads(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 200).alias("user_id"), (F.col("o_orderkey") % 10).alias("archivo"), F.col("o_orderpriority").alias("proveedor"), F.col("o_orderdate").alias("fecha"))


@query("s16_reupload_replacement", on("lines", sql="""
  WITH u AS (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS vigente, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders GROUP BY o_custkey % 200, o_orderkey % 10, o_orderpriority)
  SELECT line_id, id FROM lines JOIN u ON doc = vigente"""))
def s16(spark, sf):
    u = I.latest_uploads(uploads(spark, sf)).select(F.col("vigente").alias("doc"), "id")
    return lines(spark, sf).join(u, "doc").select("line_id", "id")


@query("s17_comparison_summary", on("saved", sql="""
  SELECT rubro, count(*) AS n_items, count(*) FILTER (en_varios) AS n_comunes, CAST(sum(CAST(ahorro AS DECIMAL(28,2))) AS DOUBLE) AS ahorro_total FROM saved GROUP BY rubro"""))
def s17(spark, sf):
    from .compare import named_rows

    return I.summary_row(named_rows(spark, sf), "rubro")


@query("s17_payload_rows", on("saved", sql="SELECT codigo, anio, n_prov FROM saved"))
def s17_payload(spark, sf):
    """The stored JSON of every row, read back."""
    from .compare import base_cells

    rows = I.payload_rows(C.compare(base_cells(spark, sf)).select("codigo", "anio", "n_prov"))
    return rows.select("codigo", F.from_json("datos_json", "anio int, n_prov bigint").alias("j")).select("codigo", "j.anio", "j.n_prov")


@query("s18_retention", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-25 12:00:00' - INTERVAL 48 HOUR")
def s18(spark, sf):
    return I.keep_recent(table(spark, sf, "events").select("event_id", "ts"), "ts", F.lit("2024-01-25 12:00:00").cast("timestamp"))
