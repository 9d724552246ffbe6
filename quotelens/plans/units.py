"""Texts carry sizes built from table columns, the twins use the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as U
from ..operators.units import convert_units
from ..sources.derived import bare_lines, lines, materials, with_line_id
from .registry import add_view, on, query

# variant by line: what the supplier writes after the name
MODES = ("un", "kg", "m2", "m3", "ml", "m")


def sized(spark, sf):
    """Quote lines with a size in the text; `q` is the quantity as text, `k` picks the wording."""
    m = materials(spark, sf).select("codigo", "p_name", "p_size")
    x = with_line_id(bare_lines(spark, sf).join(m, "codigo")).withColumn("k", F.col("line_no") % 4).withColumn("q", F.floor("cant").cast("int"))
    q = F.col("q").cast("string")
    name = F.upper("p_name")

    def by_k(*texts):
        out = F.when(F.col("k") == 0, texts[0])
        for i, t in enumerate(texts[1:], 1):
            out = out.when(F.col("k") == i, t)
        return F.concat(name, out)

    lit = F.lit
    return x.withColumn("desc", F.when(F.col("codigo") % 6 == 0, by_k(
        F.concat(lit(" x "), q, lit(" un.")), F.concat(lit(" (BOLSA X "), (F.col("q") * 10).cast("string"), lit(")")),
        F.concat(lit(" BOLSA X "), q, lit("KG")), F.concat(lit(" X "), (F.col("q") * 25).cast("string"))))
        .when(F.col("codigo") % 6 == 1, by_k(F.concat(lit(" X "), q, lit(" KG")), F.concat(lit(" X "), q, lit("TN")), lit(" GRIS"), lit(" 1 kg")))
        .when(F.col("codigo") % 6 == 2, by_k(
            F.concat(lit(" 15x15 (3X"), q, lit(")")), F.concat(lit(" "), q, lit("X2.5")), lit(" MINI"), lit(" 7x7")))
        .when(F.col("codigo") % 6 == 3, by_k(
            F.concat(lit(" X CHASIS "), q, lit("MT")), lit(" X M3"), F.concat(lit(" X "), q, lit(" MTS CUBICOS")), lit(" A GRANEL")))
        .when(F.col("codigo") % 6 == 4, by_k(
            F.concat(lit(" X "), (F.col("q") % 10).cast("string"), lit(" MTS")), lit(" X 1,00 MTS"), lit(" X METRO"), lit(" LISA")))
        .otherwise(by_k(lit(" X METRO"), lit(" ROLLO"), F.concat(lit(" X "), F.col("p_size").cast("string"), lit(" MTS DE")), lit(" NEGRO"))))


add_view("sized", """
  SELECT q.*, line_no % 4 AS k, CAST(floor(cant) AS INTEGER) AS q, codigo % 6 AS fam FROM quotes q""", ("quotes",))


@query("t9_pack_size", on("sized", sql="""
  SELECT line_id, CASE WHEN fam = 0 THEN CASE k WHEN 0 THEN q WHEN 1 THEN q * 10 WHEN 3 THEN q * 25 END END::DOUBLE AS pack FROM sized"""))
def t9(spark, sf):
    return sized(spark, sf).select("line_id", U.pack_size(F.col("desc")).alias("pack"))


# a length of one digit is also read where the text goes on ("X 4 MTS CUBICOS")
@query("t10_sheet_length", on("sized", sql="""
  SELECT line_id, CASE WHEN fam = 4 THEN CASE k WHEN 0 THEN q % 10 WHEN 1 THEN 1 END
                       WHEN fam = 3 AND k = 2 AND q <= 9 THEN q WHEN fam = 5 AND k = 2 AND p_size <= 9 THEN p_size END::DOUBLE AS largo FROM sized"""))
def t10(spark, sf):
    return sized(spark, sf).select("line_id", U.sheet_length(F.col("desc")).alias("largo"))


@query("t11_sheet_area", on("sized", sql="""
  SELECT line_id, CASE WHEN fam = 2 AND k = 0 AND q <> 3 AND q <= 12 THEN floor(q * 3 * 10000.0 + 0.5) / 10000.0
                       WHEN fam = 2 AND k = 1 AND q <= 12 THEN floor(q * 2.5 * 10000.0 + 0.5) / 10000.0 END AS area FROM sized"""))
def t11(spark, sf):
    return sized(spark, sf).select("line_id", U.sheet_area(F.col("desc")).alias("area"))


@query("t12_truck_volume", on("sized", sql="SELECT line_id, CASE WHEN fam = 3 AND k = 0 THEN q END::DOUBLE AS volumen FROM sized"))
def t12(spark, sf):
    return sized(spark, sf).select("line_id", U.truck_volume(F.col("desc")).alias("volumen"))


@query("t13_weight", on("sized", sql="""
  SELECT line_id, CASE WHEN fam = 1 THEN CASE k WHEN 0 THEN q WHEN 1 THEN q * 1000 WHEN 3 THEN 1 END WHEN fam = 0 AND k = 2 THEN q END::DOUBLE AS kg FROM sized"""))
def t13(spark, sf):
    return sized(spark, sf).select("line_id", U.weight_kg(F.col("desc")).alias("kg"))


@query("t14_catalogue_pack", """
  SELECT p_partkey AS codigo, CASE p_partkey % 5 WHEN 0 THEN p_size * 10 WHEN 1 THEN p_size + 9 WHEN 4 THEN p_size + 50 END AS factor,
         CASE p_partkey % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 4 THEN true END AS metros FROM part""")
def t14(spark, sf):
    s, n = F.col("p_size"), F.col("p_name")
    k = F.col("codigo") % 5
    name = (F.when(k == 0, F.concat(n, F.lit(" *"), (s * 10).cast("string")))
            .when(k == 1, F.concat(n, F.lit(" X "), (s + 9).cast("string"), F.lit("M")))
            .when(k == 2, F.concat(n, F.lit(" 12*18*"), (s + 10).cast("string")))
            .when(k == 3, F.concat(n, F.lit(" "), s.cast("string"), F.lit("X"), (s + 10).cast("string")))
            .otherwise(F.concat(F.lit("cable "), n, F.lit(" 100MMX"), (s + 50).cast("string"))))
    return materials(spark, sf).withColumn("t", U.tail_pack(name)).select("codigo", "t.factor", "t.metros")


def conversions(spark, sf):
    k = F.col("codigo") % 6
    mode = F.when(k == 0, "un").when(k == 1, "kg").when(k == 2, "m2").when(k == 3, "m3").when(k == 4, "ml").otherwise("m")
    # materials divisible by 13 have no conversion row
    return materials(spark, sf).filter("codigo % 13 <> 0").select(
        "codigo", mode.alias("unidad_comercial"), F.when(k == 5, F.col("p_size") + 1).otherwise(F.lit(7)).cast("double").alias("factor"),
        F.when(k == 5, "rollo").otherwise("UN").alias("unidad_base"))


def converted(spark, sf, mode=None):
    """All lines; with `mode` only materials sold that way have a conversion, the others keep price and unit."""
    unit = F.when(F.col("doc") % 3 == 0, "un.").when(F.col("doc") % 3 == 1, "caja").otherwise("")
    known = conversions(spark, sf) if mode is None else conversions(spark, sf).filter(F.col("unidad_comercial") == mode)
    return convert_units(sized(spark, sf).select("line_id", "codigo", "desc", unit.alias("unidad"), "pu", "cant"), known)


add_view("converted", """
  WITH b AS (SELECT *, CASE doc % 3 WHEN 0 THEN 'UN' WHEN 1 THEN 'CAJA' ELSE '' END AS u, codigo % 13 = 0 AS libre,
    CAST(CASE WHEN fam = 0 THEN CASE k WHEN 0 THEN q WHEN 1 THEN q * 10 WHEN 3 THEN q * 25
                                       ELSE CASE WHEN q = 7 THEN 7 END END
         WHEN fam = 1 THEN CASE k WHEN 0 THEN q WHEN 1 THEN q * 1000 WHEN 3 THEN 1 END
         WHEN fam = 2 THEN CASE WHEN k = 0 AND q <> 3 AND q <= 12 THEN q * 3 WHEN k = 1 AND q <= 12 THEN q * 2.5 END
         WHEN fam = 3 THEN CASE k WHEN 0 THEN q END
         WHEN fam = 4 THEN CASE k WHEN 0 THEN q % 10 WHEN 1 THEN 1 END END AS DOUBLE) AS n,
    CASE WHEN fam = 4 THEN k = 2 WHEN fam = 5 THEN k = 0 ELSE false END AS metro FROM sized),
  d AS (SELECT *, CASE WHEN libre THEN 'x' WHEN fam = 5 THEN CASE WHEN metro THEN 'mul' WHEN k = 1 THEN 'base' ELSE 'amb' END
      WHEN fam = 1 AND n = 1 THEN 'keep' WHEN fam IN (0, 3, 4) AND n > 1 THEN 'div' WHEN fam IN (1, 2) AND n > 0 THEN 'div'
      WHEN fam = 0 AND u IN ('', 'UN') THEN 'keep' WHEN fam = 3 AND (n IS NOT NULL OR k = 1) THEN 'keep' WHEN fam = 4 AND (n > 0 OR metro) THEN 'keep' ELSE 'amb' END AS act FROM b)
  SELECT line_id, fam, pu, cant, u, CASE act WHEN 'div' THEN floor(pu / n * 10000.0 + 0.5) / 10000.0 WHEN 'mul' THEN floor(pu * (p_size + 1) * 100.0 + 0.5) / 100.0 ELSE pu END AS pu_norm,
         CASE act WHEN 'div' THEN cant * n WHEN 'mul' THEN cant / (p_size + 1) ELSE cant END AS cant_norm,
         CASE WHEN act IN ('x', 'amb') THEN CASE WHEN u = '' THEN 'UN' ELSE u END WHEN act IN ('mul', 'base') THEN 'rollo'
              ELSE CASE fam WHEN 0 THEN 'UN' WHEN 1 THEN 'KG' WHEN 2 THEN 'M2' WHEN 3 THEN 'M3' ELSE 'ML' END END AS unidad_final,
         act = 'amb' AS ambigua, act IN ('div', 'mul') AS con_nota FROM d""", ("sized",))

OUT = "line_id, pu_norm, cant_norm, unidad_final, ambigua, con_nota"


def _register(name, mode, fam):
    sql = f"SELECT {OUT} FROM converted" if mode is None else f"""
  SELECT line_id, CASE WHEN fam = {fam} THEN pu_norm ELSE pu END AS pu_norm, CASE WHEN fam = {fam} THEN cant_norm ELSE cant END AS cant_norm,
         CASE WHEN fam = {fam} THEN unidad_final WHEN u = '' THEN 'UN' ELSE u END AS unidad_final,
         fam = {fam} AND ambigua AS ambigua, fam = {fam} AND con_nota AS con_nota FROM converted"""

    @query(name, on("converted", sql=sql))
    def run(spark, sf):
        return converted(spark, sf, mode).select(
            "line_id", "pu_norm", "cant_norm", "unidad_final", "ambigua", F.col("nota").isNotNull().alias("con_nota"))

    return run


for _name, _mode, _fam in (("p7_unit_metre", "m", 5), ("p8_unit_piece", "un", 0), ("p9_unit_kilo", "kg", 1), ("p10_unit_area", "m2", 2),
                           ("p11_unit_volume", "m3", 3), ("p12_unit_sheet", "ml", 4), ("p13_unit_router", None, None)):
    _register(_name, _mode, _fam)
