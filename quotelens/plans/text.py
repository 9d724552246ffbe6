"""T1-T8, T15-T19 on texts built from the catalogue and on the free text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import textnorm as T
from ..functions.scalars import parse_number
from ..sources.derived import lines, materials
from ..sources.views import table
from .registry import add_view, on, query

add_view("noisy", """
  SELECT p_partkey AS codigo, p_name, p_brand, p_type, p_size,
         CASE p_partkey % 4 WHEN 0 THEN 'BOLSA X ' || p_size || 'KG ' WHEN 1 THEN '***NUEVA*** ' ELSE '' END || p_name || ' (' || p_type || ') H-' || p_size || ', ' || p_brand
           || CASE p_partkey % 3 WHEN 0 THEN ' asentamiento 10 cm' ELSE '' END AS texto FROM part""")


def noisy(spark, sf):
    k, size = F.col("codigo"), F.col("p_size").cast("string")
    head = F.when(k % 4 == 0, F.concat(F.lit("BOLSA X "), size, F.lit("KG "))).when(k % 4 == 1, "***NUEVA*** ").otherwise("")
    tail = F.when(k % 3 == 0, " asentamiento 10 cm").otherwise("")
    return materials(spark, sf).withColumn(
        "texto", F.concat(head, F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(") H-"), size, F.lit(", "), F.col("p_brand"), tail))


@query("t1_normalize", on("noisy", sql="""
  SELECT codigo, trim(upper(p_name) || ' H' || p_size || ' ' || replace(upper(p_brand), '#', ' ')) AS norm FROM noisy"""))
def t1(spark, sf):
    return noisy(spark, sf).select("codigo", T.normalize(F.col("texto")).alias("norm"))


@query("t1_normalize_documents", r"""
  SELECT doc_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    translate(upper(replace(text, 'ß', 'ss')), 'ÁÉÍÓÚÜ', 'AEIOUU'),
    '\([^)]*\)', ' ', 'g'), '^\*+[^*]+\*+\s*', ''), '^(NUEVA\s+)?(BOLSA|CAJA|PAQUETE|ROLLO|BIDON)\s+X\s+\d+\w*\s*', ''),
    '([A-Z])-([0-9])', '\1\2', 'g'), '([0-9])-([A-Z])', '\1\2', 'g'),
    '\bASENTAMIENTO\b', ' ', 'g'), '\b\d+\s*CM\b', ' ', 'g'),
    '[^\p{L}\p{M}\p{Nd}\p{Pc}\s\p{Z}.\-/]', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'))) AS n FROM documents""")
def t1_docs(spark, sf):
    """Whole document texts."""
    return table(spark, sf, "documents").select("doc_id", F.length(T.normalize(F.col("text"))).cast("bigint").alias("n"))


RULES = {"RED WIDGET": "SCARLET WIDGET", "WIDGET": "GADGET", "BOLT": "SCREW", "SCREW": "FASTENER", "SCARLET": "CRIMSON"}


@query("t2_synonym_fold", r"""
  WITH r AS (SELECT p_partkey AS codigo, upper(p_name || ' ' || p_type) AS t FROM part)
  SELECT codigo, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\bRED WIDGET\b', 'SCARLET WIDGET', 'g'),
     '\bSCARLET\b', 'CRIMSON', 'g'), '\bWIDGET\b', 'GADGET', 'g'), '\bSCREW\b', 'FASTENER', 'g'), '\bBOLT\b', 'SCREW', 'g') AS texto FROM r""")
def t2(spark, sf):
    fold = T.synonym_folder(T.synonym_rules(RULES, base={}))
    return materials(spark, sf).select("codigo", fold(F.upper(F.concat_ws(" ", "p_name", "p_type"))).alias("texto"))


FIXED = T.synonym_rules()


def _terms(pick: str) -> str:
    return "[" + ", ".join(f"'{t}'" for t, _ in FIXED) + f"][1 + {pick} % {len(FIXED)}]"


def _folded(text: str) -> str:
    """All rules of the fixed list in order; words stand between two blanks each, so plain replacements see whole words."""
    wide = lambda s: " " + s.replace(" ", "  ") + " "
    out = f"' ' || replace({text}, ' ', '  ') || ' '"
    for term, canon in FIXED:
        out = f"replace({out}, '{wide(term)}', '{wide(canon)}')"
    return f"replace(trim({out}), '  ', ' ')"


@query("t2_synonym_fixed_list", f"""
  WITH r AS (SELECT p_partkey AS codigo, upper(p_name) || ' ' || {_terms('p_partkey')} || ' ' || upper(p_type) || ' ' || {_terms('p_partkey * 7')} || ' '
                    || {_terms('(p_partkey * 7 + 1)')} AS t FROM part)
  SELECT codigo, {_folded('t')} AS texto FROM r""")
def t2_fixed(spark, sf):
    """Two neighbouring terms at the end can join into a longer one."""
    k = F.col("codigo")
    term = lambda pick: F.element_at(F.array(*[F.lit(t) for t, _ in FIXED]), (1 + pick % len(FIXED)).cast("int"))
    text = F.concat_ws(" ", F.upper("p_name"), term(k), F.upper("p_type"), term(k * 7), term(k * 7 + 1))
    return materials(spark, sf).select("codigo", T.synonym_folder(FIXED)(text).alias("texto"))


@query("t3_prep", """
  SELECT p_partkey AS codigo, lower(p_name) || ' ' || p_size || ' x 1.5 mm ' || CASE WHEN p_partkey % 2 = 0 THEN 'pgc 100 x 0.94' ELSE 'x 2.5 x 3' END AS norm FROM part""")
def t3(spark, sf):
    size = F.col("p_size").cast("string")
    tail = F.when(F.col("codigo") % 2 == 0, "PFGAL C100X0,90").otherwise("X 2.50 X 3,00")
    m = materials(spark, sf).withColumn("texto", F.concat(F.col("p_name"), F.lit(" "), size, F.lit("X1.50MM "), tail))
    return T.with_prepared(m, "texto", "norm").select("codigo", "norm")


@query("t4_numeric_tokens", on("noisy", sql=r"""
  SELECT codigo, CASE WHEN lower(p_brand) = '' THEN '' ELSE regexp_extract(p_brand, '(\d+)', 1) END AS nums FROM noisy"""))
def t4(spark, sf):
    return noisy(spark, sf).select("codigo", F.array_join(F.array_sort(T.numbers(F.col("texto"))), ",").alias("nums"))


@query("t5_number_overlap", """
  WITH s AS (SELECT p_partkey AS codigo, list_distinct([p_size, p_size % 7, 10]) AS a, list_distinct([p_size, p_size % 5]) AS b FROM part)
  SELECT codigo, len(list_intersect(a, b)) / CAST(len(a) AS DOUBLE) AS comun, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS faltan FROM s""")
def t5(spark, sf):
    s = F.col("p_size")
    m = materials(spark, sf).withColumn("a", T.numbers(F.concat_ws(" ", s.cast("string"), (s % 7).cast("string"), F.lit("10")))).withColumn(
        "b", T.numbers(F.concat_ws(" ", s.cast("string"), (s % 5).cast("string"))))
    return m.select("codigo", T.number_overlap(F.col("a"), F.col("b")).alias("comun"),
                    T.missing_numbers(F.col("b"), F.col("a")).cast("bigint").alias("faltan"))


@query("t6_brand_groups", on("noisy", sql=r"""
  SELECT codigo, CASE WHEN n % 5 = 0 THEN '~' ELSE '' END || 'g' || (n % 5) AS grupos
  FROM (SELECT codigo, CAST(regexp_extract(p_brand, '(\d+)', 1) AS INTEGER) AS n FROM noisy)"""))
def t6(spark, sf):
    from .linkage import brands

    d = noisy(spark, sf).select("codigo", "texto")
    return T.with_brand_groups(d, "codigo", "texto", brands(spark, sf), "g").select("codigo", F.array_join("g", ",").alias("grupos"))


@query("t6_brand_groups_v1", """
  SELECT p_partkey AS codigo, CASE p_partkey % 3 WHEN 0 THEN '0,1' WHEN 1 THEN '2' ELSE '' END AS grupos FROM part""")
def t6v1(spark, sf):
    k = F.col("codigo") % 3
    t = F.concat(F.col("p_name"), F.when(k == 0, " AWADUCT 3").when(k == 1, " BTICINO").otherwise(""))
    return materials(spark, sf).select("codigo", F.array_join(T.brand_groups_v1(t).cast("array<string>"), ",").alias("grupos"))


@query("t7_qualifiers", """
  SELECT p_partkey AS codigo, CASE p_partkey % 4 WHEN 0 THEN 'blanco' WHEN 1 THEN 'refractario,doble' WHEN 2 THEN 'cementicia' ELSE '' END AS calif FROM part""")
def t7(spark, sf):
    k = F.col("codigo") % 4
    t = F.concat(F.col("p_name"), F.when(k == 0, " bco").when(k == 1, " dobles REFRACTARI0").when(k == 2, " cementicio").otherwise(" redoble"))
    return materials(spark, sf).select("codigo", F.array_join(T.qualifiers(t), ",").alias("calif"))


@query("t8_keyword_bonus", """
  WITH k AS (SELECT codigo, upper(p_name) AS a, upper(p_type || ' ' || CASE WHEN codigo % 3 = 0 THEN p_name ELSE 'cold rod' END) AS b FROM (SELECT *, p_partkey AS codigo FROM part)),
  w AS (SELECT * FROM (VALUES ('BOLT', true), ('ROD', true), ('RED', false), ('COLD', false)) v(kw, dist))
  SELECT codigo, CAST(sum(CASE WHEN contains(a, kw) AND contains(b, kw) THEN 4 WHEN contains(a, kw) <> contains(b, kw) AND dist THEN -6 ELSE 0 END) AS INTEGER) AS bonus
  FROM k, w GROUP BY codigo""")
def t8(spark, sf):
    b = F.upper(F.concat_ws(" ", "p_type", F.when(F.col("codigo") % 3 == 0, F.col("p_name")).otherwise("cold rod")))
    bonus = T.keyword_bonus(F.upper("p_name"), b, words=("BOLT", "ROD", "RED", "COLD"), distinctive=("BOLT", "ROD"))
    return materials(spark, sf).select("codigo", bonus.cast("int").alias("bonus"))


@query("t15_junk_text", r"""
  SELECT doc_id, length(trim(text, ' ')) < 6 OR NOT regexp_matches(text, '[A-Za-zÁÉÍÓÚÑáéíóúñ]{3,}') OR length(text) - length(replace(text, '$', '')) >= 2 AS basura FROM documents""")
def t15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.is_junk(F.col("text")).alias("basura"))


@query("t16_match_key", "SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS clave FROM documents")
def t16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.match_key(F.col("text"))).alias("clave"))


PROVINCES = ("Córdoba", "Gran Buenos Aires (GBA)", "SALTA capital", "Río Negro", "Capital Federal", "", "Mendoza", "Chaco", "Atlantis")


def customer_region(spark, sf):
    names = F.array(*[F.lit(p) for p in PROVINCES])
    province = F.element_at(names, (F.col("c_nationkey") % len(PROVINCES) + 1).cast("int"))
    return table(spark, sf, "customer").withColumn("provincia", province).withColumn("zona", T.region(F.col("provincia")))


@query("t17_region", """
  SELECT c_custkey, CASE c_nationkey % 9 WHEN 0 THEN 'Centro' WHEN 1 THEN 'Buenos Aires' WHEN 2 THEN 'NOA' WHEN 3 THEN 'Patagonia' WHEN 4 THEN 'CABA'
         WHEN 6 THEN 'Cuyo' WHEN 7 THEN 'NEA' ELSE 'Otras / sin dato' END AS zona FROM customer""")
def t17(spark, sf):
    return customer_region(spark, sf).select("c_custkey", "zona")


@query("t18_calendar_months", """
  SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 14 AS INTEGER)) AS DATE) AS hasta, strftime(o_orderdate, '%Y-%m') AS mes,
         CASE WHEN o_orderkey % 11 = 0 THEN false ELSE o_orderdate < TIMESTAMP '1998-01-01' END AS vencido FROM orders""")
def t18(spark, sf):
    stamp = F.when(F.col("o_orderkey") % 11 == 0, "roto").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf, "orders").select(
        "o_orderkey", F.add_months(F.to_date("o_orderdate"), (F.col("o_orderkey") % 14).cast("int")).alias("hasta"),
        T.month_key(F.col("o_orderdate")).alias("mes"), T.expired(stamp, F.lit("1998-01-01").cast("timestamp")).alias("vencido"))


@query("t19_split_letter", """
  SELECT p_partkey AS codigo, 'X. ' || CASE WHEN length(string_split(p_name, ' ')[1]) > 3 THEN upper(p_name)
         ELSE upper(substr(p_name, 1, 1)) || ' ' || upper(substr(p_name, 2)) END AS texto FROM part""")
def t19(spark, sf):
    word = F.upper("p_name")
    broken = F.concat(F.lit("X. "), F.substring(word, 1, 1), F.lit(" "), F.substring(word, F.lit(2), F.length(word)))
    return materials(spark, sf).select("codigo", T.join_split_letter(broken).alias("texto"))


@query("e5_parse_number", on("lines", sql="SELECT line_id, pu AS us, pu AS eu, cant AS corto FROM lines"))
def e5(spark, sf):
    us = F.format_number("pu", 2)
    eu = F.translate(us, ",.", ".,")
    return lines(spark, sf).select("line_id", parse_number(us).alias("us"), parse_number(eu).alias("eu"),
                                   parse_number(F.format_string("%.1f", "cant")).alias("corto"))
