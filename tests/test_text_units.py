"""Text preparation, detectors and unit conversion on literals."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quotelens.functions import measures as U, textnorm as T
from quotelens.functions.scalars import parse_number
from quotelens.operators.units import convert_units


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def prep(spark, *texts, rules=None):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r.norm for r in T.with_prepared(df, "t", "norm", rules).collect()]


@pytest.mark.parametrize("text,value", [("12,892.91", 12892.91), ("12.892,91", 12892.91), ("1,5", 1.5), ("1,500", 1500.0), ("424", 424.0), ("x1", None), ("", None)])
def test_parse_number(spark, text, value):
    assert one(spark, text, parse_number) == value


def test_normalize(spark):
    assert one(spark, "***NUEVA BOLSA*** Hormigón H-21 (fino) asentamiento 10 cm", T.normalize) == "HORMIGON H21"
    assert one(spark, "caño 3,33", T.normalize) == "CAÑO 3 33"


def test_synonyms_cascade_by_length(spark):
    fold = T.synonym_folder(T.synonym_rules())
    df = spark.createDataFrame([("HIERRO ADN 8",), ("ADN 8",), ("TUBOCLAVE",)], "t string")
    assert [r.x for r in df.select(fold("t").alias("x")).collect()] == ["HIERRO CORRUGADO 8", "ALETEADO 8", "TUBOCLAVE"]


def test_prepared_text(spark):
    extra = T.synonym_rules({"VARILLA": "HIERRO CORRUGADO"})
    got = prep(spark, "PFGAL C100X45 E0,9", "40X1,00 MM", "VARILLA ROSCADA FISCHER 12MM", "varilla 8 X 12M", "CAÑO 3,20", rules=extra)
    assert got == ["pgc 100 x 45 e 0.94", "40 x 1 mm", "varilla roscada fischer 12 mm", "hierro corrugado 8", "cano 3.2"]


@pytest.mark.parametrize("text,n", [
    ("CAJA ALAS C/ESTRIAS - 8 X 1,1/4 X 6.000", 6000), ('TORNILLO ALAS 8X1 1/4" (BOLSA X 100)- TEL', 100), ("T2 x 10.000 unid", 10000),
    ("Bolsa X 25KG", None), ("LADRILLO 229X114X50", None), ("CUARZO X25", None), ("PERFIL PGC 70 x 0.94 x 6", None)])
def test_pack_size(spark, text, n):
    assert one(spark, text, U.pack_size) == n


@pytest.mark.parametrize("text,area", [("MALLA MINI 15X15 (6) (3X2.40)", 7.2), ("MALLA 2X5", 10.0), ("MALLA 15X15", None), ("12X18X33", None)])
def test_sheet_area(spark, text, area):
    assert one(spark, text, U.sheet_area) == area


CONV = [("T005", "un", 6000.0, "UN"), ("T004", "un", 8000.0, "UN"), ("CH001", "ml", 1.0, "ML"), ("INS100", "m", 100.0, "rollo 100m"),
        ("TER482", "kg", 25.0, "KG"), ("CONS112", "m2", 1.0, "M2"), ("CONS107", "m3", 1.0, "M3")]
CASES = [
    ("T005", "CAJA ALAS C/ESTRIAS - 8 X 1,1/4 X 6.000", "", 348804.0, 1.0, 58.134, "UN", False),
    ("T005", 'TORNILLO ALAS 8X1 1/4" (BOLSA X 100)- TEL', "", 3310.0, 1.0, 33.10, "UN", False),
    ("T004", "TORNILLO T1 MECHA 10X3/4", "UN", 23.28, 1.0, 23.28, "UN", False),
    ("T004", "TORNILLO T1 CAJA 8000", "caja", 8000.0, 1.0, 1.0, "UN", False),
    ("T004", "TORNILLO T1", "caja", 8000.0, 1.0, 8000.0, "CAJA", True),
    ("CH001", "CHAPA ACAN POLIP X 6 ML", "", 96817.24, 8.0, 16136.2067, "ML", False),
    ("TER482", "WEBER REV BASE COAT GRIS X 30 KG", "", 38325.0, 1.0, 1277.5, "KG", False),
    ("TER482", "BASE COAT GRANITEX", "", 38325.0, 1.0, 38325.0, "UN", True),
    ("CONS112", "MALLA MINI 15X15 (6) (3X2.40)", "", 43668.17, 1.0, 6065.0236, "M2", False),
    ("CONS107", "TOSCA X CHASIS 7MT", "", 221294.11, 1.0, 31613.4443, "M3", False),
    ("CONS107", "TIERRA TOSCA X 7 MTS CUBICOS**", "", 21560.0, 1.0, 21560.0, "UN", True),
    ("INS100", "CABLE 2,5MM X METRO", "ML", 500.0, 200.0, 50000.0, "rollo 100m", False),
    ("INS100", "CABLE 2,5MM ROLLO", "", 50000.0, 1.0, 50000.0, "rollo 100m", False),
    ("OTRO", "LO QUE SEA", "bolsa.", 10.0, 1.0, 10.0, "BOLSA", False),
]


def test_unit_conversion(spark):
    conv = spark.createDataFrame(CONV, "codigo string, unidad_comercial string, factor double, unidad_base string")
    lines = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(CASES)], "i int, codigo string, desc string, unidad string, pu double, cant double")
    for r in convert_units(lines, conv).collect():
        _, desc, _, pu, cant, norm, unit, unclear = CASES[r.i]
        assert (r.pu_norm, r.unidad_final, r.ambigua) == (pytest.approx(norm, abs=1e-3), unit, unclear), desc
        # the line total survives
        assert r.pu_norm * r.cant_norm == pytest.approx(pu * cant, rel=1e-4)


def in_order(rules, text):
    for term, canon in rules:
        text = re.sub(r"\b" + re.escape(term) + r"\b", lambda _: canon, text)
    return text


def test_cascade_equals_the_ordered_pass():
    rng = random.Random(3)
    words = ["A", "B", "C", "AB", "Ñ", "1", "A1"]

    def phrase(most, gaps=(" ", " ", " ", "-", "  ", "/", " ")):
        return "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(1, most + 1)))

    for _ in range(400):
        pairs = {rng.choice(["", "", "-", "("]) + phrase(3).strip() + rng.choice(["", "", "-", ")"]): rng.choice(["", phrase(3).strip(), "-A", "B-"])
                 for _ in range(rng.randrange(1, 12))}
        rules = T.synonym_rules(pairs, base={})
        cascade = T.Cascade(rules)
        for _ in range(20):
            text = phrase(12)
            assert cascade.fold(text) == in_order(rules, text), (rules, text)


def test_cascade_over_the_fixed_list():
    rng = random.Random(4)
    rules = T.synonym_rules()
    cascade = T.Cascade(rules)
    bits = [w for term, canon in rules for w in (term, canon, *term.split())] + ["8", "X", "DE", "/", ","]
    for _ in range(3000):
        text = " ".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        assert cascade.fold(text) == in_order(rules, text)
    assert cascade.fold("") == "" and cascade.fold(None) is None


def test_cascade_is_linear_in_the_text():
    cascade = T.Cascade(T.synonym_rules())
    text = "POLIETILENO DE ALTA BARRA VARILLA 8 X 12 " * 25_000  # a million characters that begin terms and end none
    start = time.perf_counter()
    assert cascade.fold(text) == text
    assert time.perf_counter() - start < 10


def test_synonym_folder_keeps_nulls_and_repeats(spark):
    fold = T.synonym_folder(T.synonym_rules({"BOLT": "SCREW"}, base={}))
    df = spark.createDataFrame([(1, "BOLT 8"), (2, None), (3, ""), (4, "BOLT 8")], "i int, t string").coalesce(1)
    assert [r.x for r in df.orderBy("i").select(fold("t").alias("x")).collect()] == ["SCREW 8", None, "", "SCREW 8"]
