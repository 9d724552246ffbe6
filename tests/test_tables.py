"""Sheets, snapshots, medians, numbering and the registry."""

import statistics

import pytest
from pyspark.sql import functions as F

from quotelens.operators import compare as C, history as H, ingest as I, learn as L
from quotelens.plans import ORACLES, QUERIES
from quotelens.sources import sheets as S

SF = "/root/testdata/sf0.001"


def test_sheet_from_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Lista de precios\nCódigo;Descripción;Cant;Precio $;Total\nA1;Arena; 3;1.250,50;\nB2;Cal;0;;500,00\n;Total;;;999\n", encoding="utf-8")
    (tmp_path / "b.csv").write_bytes('sku,detalle,p. unit\nC3,"Caño, \xf1 roto",12.50\n'.encode("latin-1"))
    items = {r.cod: r for r in S.sheet_items(S.sheet_rows(S.read_files(spark, str(tmp_path)))).collect()}
    assert set(items) == {"A1", "B2", "C3"}
    assert (items["A1"].pu, items["A1"].total) == (1250.5, 3751.5)
    assert (items["B2"].cant, items["B2"].pu) == (1.0, 500.0)
    assert items["C3"].desc.startswith("Ca") and items["C3"].pu == 12.5


def test_config_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"proveedores": [{"nombre_canonico": "UNO", "alias_archivo": ["uno", "1"]}, {"nombre_canonico": "DOS", "factor_iva_default": 1.0, "alias_archivo": []}]}')
    rows = sorted((r.nombre_canonico, r.factor_iva, r.alias or "") for r in S.read_config(spark, str(tmp_path / "c.json")).collect())
    assert rows == [("DOS", 1.0, ""), ("UNO", 1.105, "1"), ("UNO", 1.105, "uno")]


def test_snapshot_and_append(spark, tmp_path):
    df = spark.range(5).withColumn("origen", F.lit("pipeline"))
    m = I.export_snapshot({"a": df, "b": df.limit(2)}, str(tmp_path), "2024-01-01")
    assert {r.tabla: r.filas for r in m.collect()} == {"a": 5, "b": 2}
    with pytest.raises(RuntimeError):
        I.export_snapshot({"a": df}, str(tmp_path), "2024-01-01")
    for run in ("a", "a", "b"):
        I.append_prices(df, str(tmp_path / "h"), run)
    assert spark.read.parquet(str(tmp_path / "h")).filter("origen = 'pipeline'").count() == 10


def test_exact_median(spark):
    import random

    rnd = random.Random(1)
    data = {g: [round(rnd.choice([0.1, 0.5, rnd.random() * 10, rnd.random() * 1e6]), 4) for _ in range(n)] for g, n in (("a", 101), ("b", 40), ("c", 1))}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    got = {r.g: r.mediana for r in H.exact_median(df, "v", "g").collect()}
    assert got == {g: pytest.approx(statistics.median(vs)) for g, vs in data.items()}


def test_numbering_is_consecutive(spark):
    df = spark.range(300).select(F.md5(F.col("id").cast("string")).alias("k"))
    got = {r.k: r.n for r in I.numbered(df, "k").collect()}
    assert got == {k: n for n, k in enumerate(sorted(got), 1)} and len(got) == 300


def test_stored_decisions_keep_their_numbers(spark):
    cols = "desc string, decision string, cod_propuesto string, cod_correcto string, seq string"
    old = spark.createDataFrame([(f"d{i}", "CARGAR", f"C{i}", None, f"{9 - i}") for i in range(5)], cols)
    new = spark.createDataFrame([(f"a{i}", "CARGAR", f"C{i}", None, f"{i}") for i in range(3)] + [("d1", "CARGAR", "C1", None, "7")], cols)
    number = lambda x: {r.clave: r.n for r in I.numbered(x, "nueva", "seq", "clave").collect()}
    before = number(I.consolidate(old, new.limit(0)))
    after = number(I.consolidate(old, new))
    assert before == {f"D{i}|C{i}": 5 - i for i in range(5)} and all(after[k] == n for k, n in before.items())
    assert {k: n for k, n in after.items() if k not in before} == {f"A{i}|C{i}": 6 + i for i in range(3)}


def test_saving_guard(spark):
    rows = [("a", 1, 100.0, 2.0), ("a", 2, 200.0, 5.0), ("b", 1, 10.0, 1.0), ("b", 2, 31.0, 1.0), ("c", 1, 5.0, 1.0), ("d", 2, 7.0, 0.0), ("d", 1, 7.0, 3.0), ("d", 3, 9.0, 1.0)]
    cell = spark.createDataFrame(rows, "k string, prov_id long, neto double, cant double")
    got = {r.k: r for r in C.with_saving(C.compare(cell, keys=("k",))).collect()}
    assert got["a"].ahorro == 100.0 and got["a"].cant == 2.0
    assert got["b"].ahorro == 0.0 and got["c"].ahorro == 0.0 and not got["c"].en_varios
    assert got["d"].mejor_id == 1 and got["d"].ahorro == 2.0  # first supplier on ties


def test_line_order_does_not_matter(spark):
    q = QUERIES["c3_guarded_saving"](spark, SF)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    other = QUERIES["c3_guarded_saving"](spark, SF)
    assert q.exceptAll(other).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pending_ids_are_stable(spark):
    u = spark.createDataFrame([("l1", " Texto ", "p", 1.0)], "line_id string, texto string, proveedor string, precio double")
    a, b = L.open_pending(u), L.open_pending(u)
    assert a[0].first().id == b[1].first().codigo_pendiente


def test_registry_names():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 150


def test_alias_moves_meet_one_row_a_text(spark):
    """copies of a text under one code do not pair up."""
    from quotelens.operators import history as H

    aliases = spark.createDataFrame([(1, "A", "x"), (2, "A", "x"), (3, "B", "x"), (4, "C", "y")], "alias_id long, codigo string, denominacion string")
    moves = spark.createDataFrame([(3, "x", "A"), (4, "y", "C"), (9, "x", "A"), (1, "x", "B"), (2, "x", "C")], "alias_id long, denominacion string, destino string")
    out = H.reassign_aliases(aliases, moves)
    assert {(r.alias_id, r.accion) for r in out.collect()} == {(3, "borrar"), (4, "reasignar"), (9, "no_existe"), (1, "borrar"), (2, "reasignar")}
    assert "min(alias_id" in out._jdf.queryExecution().optimizedPlan().toString()
