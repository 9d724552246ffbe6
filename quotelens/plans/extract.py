"""Documents are written from line items and read back; the twins use the columns."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import textnorm as T
from ..functions.scalars import rnd
from ..operators import extract as E
from ..sources.derived import declared_total, lines, materials, suppliers
from ..sources.views import table
from .registry import add_view, on, query

add_view("items", """
  SELECT q.*, row_number() OVER (PARTITION BY doc ORDER BY fecha, line_no, codigo, prov_id, pu, cant) AS pos, upper(p_name) || ' PIEZA' AS descr,
         CASE WHEN doc % 17 = 0 THEN floor(floor(pu * cant * 100 + 0.5) / 100.0 * 1.5 * 100 + 0.5) / 100.0 ELSE floor(pu * cant * 100 + 0.5) / 100.0 END AS total
  FROM quotes q""", ("quotes",))


def items(spark, sf):
    w = Window.partitionBy("doc").orderBy("fecha", "line_no", "codigo", "prov_id", "pu", "cant")
    x = lines(spark, sf).join(materials(spark, sf).select("codigo", "p_name"), "codigo")
    return x.withColumn("pos", F.row_number().over(w)).withColumn("total", declared_total()).withColumn(
        "descr", F.concat(F.upper("p_name"), F.lit(" PIEZA"))).withColumn("cod", F.concat(F.lit("C"), F.col("codigo").cast("string")))


def us(c, d=2):
    return F.format_number(c, d)


def eu(c):
    return F.translate(us(c), ",.", ".,")


def quote_docs(spark, sf):
    """Five supplier formats, one per document."""
    x = items(spark, sf)
    pu, total, cant = F.col("pu"), F.col("total"), F.col("cant")
    k = F.col("doc") % 5
    line = (
        F.when(k == 0, F.concat(F.col("pos").cast("string"), F.lit("- "), F.concat_ws(" ", "cod", "descr", F.format_string("%.2f", cant), us(pu), us(total))))
        .when(k == 1, F.concat_ws(" ", "cod", F.floor(cant).cast("string"), "descr", eu(pu), eu(total)))
        .when(k == 2, F.concat(F.concat_ws(" ", "cod", "descr", eu(cant)), F.lit(" $"), eu(pu), F.lit(" $"), eu(total)))
        .when(k == 3, F.concat_ws(" ", F.format_string("%.2f", cant), F.lit("UNI"), F.col("descr"), us(pu * 2), F.lit("%18"), us(pu, 3), us(total)))
        .otherwise(F.concat(F.lit("["), F.col("cod"), F.lit("] "), F.concat_ws(" ", "descr", eu(cant)), F.lit(" Unidades "), eu(pu), F.lit(" $ "), eu(total))))
    return x.select("doc", F.col("pos").alias("line_no"), line.alias("line"))


FORMAT_SQL = "CASE doc % 5 WHEN 0 THEN 'baukraft' WHEN 1 THEN 'europeo' WHEN 2 THEN 'pedido_pev' WHEN 3 THEN 'molber' ELSE 'enseco' END"


@query("e1_line_items", on("items", sql=f"""
  SELECT doc, pos AS line_no, {FORMAT_SQL} AS formato, CASE WHEN doc % 5 = 3 THEN '' ELSE 'C' || codigo END AS cod, descr AS "desc", cant, pu, total,
         CASE WHEN doc % 5 = 3 THEN 'UNI' ELSE '' END AS unidad FROM items"""))
def e1(spark, sf):
    return E.best_format(quote_docs(spark, sf)).select("doc", "line_no", "formato", "cod", "desc", "cant", "pu", "total", "unidad")


@query("e2_best_format", on("items", sql=f"""
  SELECT doc, {FORMAT_SQL} AS formato, CAST(sum(CASE WHEN doc % 17 = 0 AND abs(pu * cant - total) > greatest(1.0, 0.01 * total) THEN 1 ELSE 2 END) AS BIGINT) AS q, count(*) AS n
  FROM items GROUP BY doc"""))
def e2(spark, sf):
    parsed = E.parse_lines(quote_docs(spark, sf))
    names = {i: n for i, (n, _, _) in enumerate(E.FORMATS)}
    label = F.element_at(F.array(*[F.lit(names[i]) for i in range(len(names))]), (F.col("prio") + 1).cast("int"))
    return E.elect(parsed, "prio").select("doc", label.alias("formato"), "q", "n")


@query("e3_item_quality", on("items", sql="""
  SELECT line_id, 1 + CASE WHEN abs(pu * c - total) <= greatest(1.0, 0.01 * total) AND c > 0 THEN 1 ELSE 0 END + CASE WHEN c < 0 THEN -3 ELSE 0 END AS q
  FROM (SELECT *, CASE WHEN line_no = 5 THEN -cant ELSE cant END AS c FROM items)"""))
def e3(spark, sf):
    x = items(spark, sf).withColumn("cant", F.when(F.col("line_no") == 5, -F.col("cant")).otherwise(F.col("cant"))).withColumn("desc", F.col("descr"))
    return x.select("line_id", E.quality().alias("q"))


@query("e4_code_like", r"""
  SELECT doc_id, NOT regexp_matches(text, '[A-Za-zÁÉÍÓÚÑáéíóúñ]{4,}') AS codigo FROM documents""")
def e4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", E.code_like(F.col("text")).alias("codigo"))


def wrapped_docs(spark, sf):
    """Item lines broken in two; in one document of four the leading digits come spaced."""
    x = items(spark, sf)
    lead = F.concat(F.format_string("%.2f", "cant"), F.lpad(F.col("codigo").cast("string"), 8, "0"))
    spaced = F.trim(F.regexp_replace(lead, "(.)", "$1 "))
    plain = F.concat_ws(" ", F.format_string("%.2f", "cant"), F.lpad(F.col("codigo").cast("string"), 8, "0"))
    head = F.concat_ws(" ", F.when(F.col("doc") % 4 == 0, spaced).otherwise(plain), "descr")
    price = F.format_string("%.2f", "pu")
    tail = F.concat_ws(" ", F.lit("GRANDE"), price, price, F.format_string("%.2f", "total"))
    two = F.array(F.struct((F.col("pos") * 2 - 1).alias("line_no"), head.alias("line")), F.struct((F.col("pos") * 2).alias("line_no"), tail.alias("line")))
    return x.select("doc", F.explode(two).alias("l")).select("doc", "l.line_no", "l.line")


@query("e6_line_repair", on("items", sql="""
  SELECT doc, pos * 2 - 1 AS line_no, lpad(CAST(codigo AS VARCHAR), 8, '0') AS cod, descr || ' GRANDE' AS "desc", cant, pu, total FROM items"""))
def e6(spark, sf):
    return E.best_format(wrapped_docs(spark, sf)).select("doc", "line_no", "cod", "desc", "cant", "pu", "total")


def split_codes(spark, sf):
    x = items(spark, sf)
    line = F.concat(F.concat_ws(" ", "cod", "descr", F.floor("cant").cast("string")), F.lit(" $"), eu("pu"), F.lit(" 0% $"), eu("total"), F.lit(" 21% $"), eu("total"))
    rest = F.concat(F.lit("X"), (F.col("pos") % 7).cast("string"))
    two = F.array(F.struct((F.col("pos") * 2 - 1).alias("line_no"), line.alias("line")), F.struct((F.col("pos") * 2).alias("line_no"), rest.alias("line")))
    return x.select("doc", F.explode(two).alias("l")).select("doc", "l.line_no", "l.line")


@query("e7_wrapped_code", on("items", sql="""
  SELECT doc, pos * 2 - 1 AS line_no, 'C' || codigo || 'X' || (pos % 7) AS cod, descr AS "desc", cant, pu, total FROM items"""))
def e7(spark, sf):
    return E.parse_lines(E.repair_codes(split_codes(spark, sf))).filter("formato = 'ofertas'").select("doc", "line_no", "cod", "desc", "cant", "pu", "total")


@query("e8_free_lines", on("items", sql="""
  SELECT doc, pos AS line_no, descr AS "desc", CASE WHEN pos % 3 = 0 THEN 1.0 ELSE cant END AS cant, pu,
         CASE WHEN pos % 3 = 0 THEN pu ELSE floor(pu * cant * 100.0 + 0.5) / 100.0 END AS total
  FROM items WHERE pos % 4 <> 3 AND NOT (pos % 3 = 2 AND total >= 1000000)"""))
def e8(spark, sf):
    """A price of a million or more with two separators is no well-formed line end here."""
    x = items(spark, sf)
    price, qty = F.format_string("%.2f", "pu"), F.floor("cant").cast("string")
    text = F.when(F.col("pos") % 4 == 3, F.concat_ws(" ", "descr", qty)).when(F.col("pos") % 3 == 0, F.concat_ws(" ", "descr", price)).when(
        F.col("pos") % 3 == 1, F.concat_ws(" ", "descr", qty, price)).otherwise(F.concat_ws(" ", "descr", qty, price, us("total")))
    return E.free_lines(x.select("doc", F.col("pos").alias("line_no"), text.alias("line"))).select("doc", "line_no", "desc", "cant", "pu", "total")


def tables_(spark, sf):
    x = items(spark, sf)
    row = F.array("cod", "descr", F.concat(F.format_string("%.2f", "cant"), F.lit(" Unidades")), F.concat(F.lit("$ "), us("pu")), us("total"))
    body = x.select(F.col("doc").alias("tabla"), F.col("pos").alias("fila"), row.alias("celdas"))
    head = x.select(F.col("doc").alias("tabla")).distinct().select(
        "tabla", F.lit(0).alias("fila"), F.array(*[F.lit(h) for h in ("Codigo", "Detalle", "Cant", "Precio", "Total")]).alias("celdas"))
    return body.unionByName(head)


add_view("roles", """
  SELECT doc, CASE WHEN sum(CAST(total AS DECIMAL(28,4))) > sum(CAST(pu AS DECIMAL(28,4))) THEN 4 ELSE 3 END AS pu_col FROM items GROUP BY doc HAVING count(*) >= 2""", ("items",))


@query("e9_column_roles", on("roles", sql="""
  SELECT doc AS tabla, 0 AS cod_col, 1 AS desc_col, CAST(pu_col AS INTEGER) AS pu_col, 2 AS cant_col, CAST(7 - pu_col AS INTEGER) AS total_col FROM roles"""))
def e9(spark, sf):
    return E.infer_columns(tables_(spark, sf))


@query("e10_table_items", on("roles", "items", sql="""
  SELECT doc AS tabla, pos AS fila, 'C' || codigo AS cod, descr AS "desc", cant, CASE WHEN pu_col = 4 THEN total ELSE pu END AS pu,
         CASE WHEN pu_col = 4 THEN pu ELSE total END AS total FROM items JOIN roles USING (doc)"""))
def e10(spark, sf):
    return E.table_items(tables_(spark, sf))


@query("e11_method_cascade", on("items", sql="""
  SELECT doc, CASE WHEN doc % 7 <> 0 AND doc % 3 <> 1 THEN 'tablas' WHEN doc % 7 <> 0 THEN 'regex' WHEN doc % 14 = 0 THEN 'lineas_heuristico'
                   WHEN doc % 21 = 0 AND count(*) >= 5 THEN 'sin_precios' ELSE 'desconocido' END AS metodo,
         CASE WHEN doc % 14 = 0 OR doc % 7 <> 0 THEN count(*) ELSE 0 END AS n_items FROM items GROUP BY doc"""))
def e11(spark, sf):
    return E.cascade(*methods(spark, sf))


@query("e11_cascade_items", on("items", sql="""
  SELECT doc, CASE WHEN doc % 7 = 0 THEN 'lineas_heuristico' WHEN doc % 3 <> 1 THEN 'tablas' ELSE 'regex' END AS metodo, pu,
         CASE WHEN doc % 7 = 0 THEN 1.0 ELSE CAST(cant AS DOUBLE) END AS cant FROM items WHERE doc % 7 <> 0 OR doc % 14 = 0"""))
def e11_items(spark, sf):
    return E.cascade_items(*methods(spark, sf)).select("doc", "metodo", "pu", F.col("cant").cast("double").alias("cant"))


def methods(spark, sf):
    x = items(spark, sf).select("doc", "pos", "cod", F.col("descr").alias("desc"), "cant", "pu", rnd(F.col("pu") * F.col("cant")).alias("total"))
    some = x.filter("doc % 7 <> 0")
    a = some.filter("doc % 3 <> 1").withColumn("metodo", F.lit("tablas")).withColumn("prio", F.lit(1))
    # the other method reads the amount as the unit price
    b = some.filter("doc % 3 <> 2").withColumn("metodo", F.lit("regex")).withColumn("prio", F.lit(0)).withColumn("total", F.col("total") * 10)
    bare = x.filter("doc % 21 = 0 and doc % 14 <> 0").select("doc", F.col("pos").alias("line_no"), F.concat_ws(" ", "desc", F.lit("CANTIDAD 5 unidades")).alias("line"))
    free = x.filter("doc % 14 = 0").select("doc", F.concat_ws(" ", "desc", F.format_string("%.2f", "pu")).alias("line"), F.col("pos").alias("line_no"))
    return a.unionByName(b), E.free_lines(free), E.no_price_documents(bare), x.select("doc").distinct()


@query("e12_no_price_document", on("items", sql="""
  SELECT doc, count(*) AS n FROM items WHERE doc % 2 = 0 GROUP BY doc HAVING count(*) >= 5"""))
def e12(spark, sf):
    x = items(spark, sf)
    body = F.concat_ws(" ", "descr", eu("cant"), F.lit("Unidades"))
    first = F.when(F.col("doc") % 2 == 0, F.concat(F.lit("Cantidad de "), body)).otherwise(body)
    return E.no_price_documents(x.select("doc", F.col("pos").alias("line_no"), F.when(F.col("pos") == 1, first).otherwise(body).alias("line")))


@query("e13_collapse_doubled", "SELECT p_partkey AS codigo, p_name || ' ' || p_size || ' Total' AS texto FROM part")
def e13(spark, sf):
    # every other word arrives doubled
    twice = F.regexp_replace(F.concat_ws(" ", "p_name"), r"([^ ])", "$1$1")
    t = F.concat_ws(" ", twice, F.col("p_size").cast("string"), F.lit("TToottaall"))
    return materials(spark, sf).select("codigo", T.collapse_doubled(t).alias("texto"))


def vat_docs(spark, sf):
    x = items(spark, sf).select("doc", F.col("pos").alias("line_no"), "pu", "cant", rnd(F.col("pu") * F.col("cant")).alias("total"))
    s = x.groupBy("doc").agg(F.sum(F.col("total").cast("decimal(28,2)")).cast("double").alias("s"), F.max("line_no").alias("m"))
    k = F.col("doc") % 4
    total = rnd(F.col("s") * F.when(k == 1, 1.21).when(k == 2, 1.105).otherwise(1.0))
    number = us(total)
    label = F.when(k == 3, "Sin cierre").otherwise(F.concat(F.lit("TOTAL: $ "), F.when(k == 1, F.translate(number, ",.", ".,")).otherwise(number)))
    legend = F.when(F.col("doc") % 10 == 0, " Contado efectivo").otherwise("")
    foot = s.select("doc", (F.col("m") + 1).alias("line_no"), F.concat(label, legend).alias("line"))
    body = x.select("doc", "line_no", F.concat_ws(" ", F.lit("item"), us("pu"), us("total")).alias("line"))
    return body.unionByName(foot), x


@query("e14_vat_regime", on("items", sql="""
  WITH s AS (SELECT doc, CAST(sum(CAST(floor(pu * cant * 100.0 + 0.5) / 100.0 AS DECIMAL(28,2))) AS DOUBLE) AS s FROM items GROUP BY doc)
  SELECT doc, CASE WHEN doc % 10 = 0 THEN 'PRECIOS EFECTIVO S/IVA (leyenda contado efectivo en mostrador)' WHEN doc % 4 = 0 THEN 'PRECIOS C/IVA INCLUIDO'
                   WHEN doc % 4 = 1 THEN 'PRECIOS S/IVA + 21%' WHEN doc % 4 = 2 THEN 'PRECIOS S/IVA + 10,5%' ELSE 'ASUMIDO 1,105' END AS iva_detectado,
         doc % 10 = 0 AS leyenda_efectivo, floor(s * 100.0 + 0.5) / 100.0 AS suma_lineas FROM s"""))
def e14(spark, sf):
    text, found = vat_docs(spark, sf)
    return E.vat_regime(text, found)


@query("e15_document_date", """
  SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 3 = 2 THEN NULL WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate AS DATE) + INTERVAL 1 DAY ELSE o_orderdate END::DATE AS fecha FROM orders""")
def e15(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), "o_orderdate")
    k = F.col("doc") % 3
    first = F.when(k == 1, F.date_format(F.date_add("o_orderdate", 1), "'entrega 'd/M/yyyy")).when(k == 2, "vence 31/02/1999").otherwise("entrega 01/01/1990")
    second = F.when(k == 0, F.date_format("o_orderdate", "'Fecha: 'd/M/yyyy")).otherwise("sin rotulo")
    two = F.array(F.struct(F.lit(1).alias("line_no"), first.alias("line")), F.struct(F.lit(2).alias("line_no"), second.alias("line")))
    return E.document_date(o.select("doc", F.explode(two).alias("l")).select("doc", "l.line_no", "l.line"))


def supplier_files(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"))
    n = suppliers(spark, sf).agg(F.count("*").alias("n"))
    s = suppliers(spark, sf).select("prov_id", "proveedor")
    x = o.join(n).withColumn("prov_id", F.col("doc") % F.col("n")).join(s, "prov_id")
    tidy = F.translate(F.lower("proveedor"), "#", "_")
    name = F.when(F.col("doc") % 3 == 0, F.concat(F.lit("/in/cotiz-"), tidy, F.lit("_v2.pdf"))).otherwise(F.lit("/in/scan.pdf"))
    line = F.when(F.col("doc") % 3 == 1, F.concat(F.lit("Presupuesto de "), tidy)).otherwise("Presupuesto")
    return x.select("doc", name.alias("archivo")), x.select("doc", F.lit(1).alias("line_no"), line.alias("line"))


@query("e16_supplier_detection", """
  SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 3 = 2 THEN NULL WHEN p % 5 = 4 THEN 'GRUPO' ELSE 'Supplier#' || lpad(CAST(p AS VARCHAR), 9, '0') END AS proveedor,
         CASE o_orderkey % 3 WHEN 0 THEN 'ARCHIVO' WHEN 1 THEN 'TEXTO' ELSE 'NO DETECTADO' END AS confianza
  FROM (SELECT o_orderkey, o_orderkey % (SELECT count(*) FROM supplier) AS p FROM orders)""")
def e16(spark, sf):
    files, text = supplier_files(spark, sf)
    s = suppliers(spark, sf)
    # one supplier in five has no alias of its own; the shared short alias catches it
    own = s.filter("prov_id % 5 <> 4").select(F.translate("proveedor", "#", "-").alias("alias"), F.col("proveedor").alias("canonico"), F.col("prov_id").alias("orden"))
    shared = s.agg(F.max("prov_id").alias("m")).select(F.lit("supplier").alias("alias"), F.lit("GRUPO").alias("canonico"), (F.col("m") + 1).alias("orden"))
    return E.detect_supplier(files, text, own.unionByName(shared))


@query("e17_block_supplier", """
  SELECT o_orderkey AS idx, o_custkey AS bloque, first_value('P' || o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS proveedor FROM orders""")
def e17(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("bloque"), F.col("o_orderkey").alias("idx"), F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("nombre"))
    return E.block_supplier(o).select("idx", "bloque", "proveedor")


@query("e18_doubtful_documents", on("items", sql="""
  WITH f AS (SELECT doc, count(*) AS n_items, count(*) FILTER (abs(pu * cant - total) <= greatest(1.0, 0.01 * total)) AS n_consistentes FROM items GROUP BY doc)
  SELECT o_orderkey AS doc, coalesce(n_items, 0) AS n_items, coalesce(n_consistentes, 0) AS n_consistentes,
         CASE WHEN coalesce(n_items, 0) = 0 THEN 'cero_items' WHEN n_items >= 5 AND n_consistentes < n_items * 0.5 THEN 'inconsistente' END AS motivo
  FROM orders LEFT JOIN f ON doc = o_orderkey"""))
def e18(spark, sf):
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"))
    l = lines(spark, sf).withColumn("total", declared_total())
    return E.doubtful_documents(docs, l).select("doc", "n_items", "n_consistentes", "motivo")


@query("e18_accepted_lines", on("items", sql="""
  SELECT line_id FROM items WHERE doc NOT IN (SELECT doc FROM items GROUP BY doc HAVING count(*) >= 5 AND count(*) FILTER (abs(pu * cant - total) <= greatest(1.0, 0.01 * total)) < count(*) * 0.5)"""))
def e18_lines(spark, sf):
    """Lines of withheld documents do not go on."""
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"))
    l = lines(spark, sf).withColumn("total", declared_total())
    held = E.doubtful_documents(docs, l).filter("motivo is not null")
    return l.join(held, "doc", "left_anti").select("line_id")
