"""How often wide rows are shuffled, and that the results stay what they were."""

import contextlib

from pyspark.sql import functions as F

from quotelens.operators import extract as E
from quotelens.operators import history as H
from quotelens.operators import ingest as I
from quotelens.operators import linkage as M
from quotelens.operators import pricing as P
from quotelens.sources import sheets as S


@contextlib.contextmanager
def plain_plans(spark):
    """Sort joins and plans that are final at once."""
    set_to = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in set_to}
    for k, v in set_to.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def nodes(plan, name):
    """Output columns of all steps of that name."""
    own = [plan.output().mkString(",")] if plan.nodeName() == name else []
    children = plan.children()
    return own + [x for i in range(children.size()) for x in nodes(children.apply(i), name)]


def steps(df, name):
    return nodes(df._jdf.queryExecution().executedPlan(), name)


def test_header_rows_are_found_in_their_row(spark):
    """the cells of all rows were spread and grouped again."""
    rows = spark.createDataFrame(
        [("a", 0, ["Cod interno prop.", "Desc proveedor"]), ("a", 1, ["7", "Desc proveedor"]), ("a", 2, ["desc proveedor", "cod interno prop"]),
         ("b", 3, ["x", None, "DESC PROVEEDOR", "COD INTERNO PROP"]), ("c", 0, ["DESC PROVEEDOR"]), ("d", 0, None)],
        "archivo string, fila int, celdas array<string>")
    with plain_plans(spark):
        found = S.fragment_columns(rows, {"cod": "COD INTERNO PROP", "desc": "DESC PROVEEDOR"})
        assert not steps(found, "Generate") and len(steps(found, "Exchange")) == 1
        assert {tuple(r) for r in found.collect()} == {("a", 0, 0, 1), ("b", 3, 3, 2)}


def test_rows_without_a_code_meet_in_no_join(spark):
    """a left join puts all rows without a key into one task."""
    rows = spark.createDataFrame([(1, "Tee", "Uno", "s2"), (1, "tee ", "Dos", "s1"), (None, "codo", "Uno", "s3"), (2, " ", "Uno", "s4"), (9, "cano", None, "s5")],
                                 "codigo long, desc string, proveedor string, seq string")
    good, why = I.import_equivalences(rows, spark.createDataFrame([(1,), (2,)], "codigo long"))
    assert [tuple(r) for r in good.collect()] == [(1, "tee", "equivalencias_dos", 95)]
    assert {tuple(r) for r in why.collect()} == {("entra", 2), ("vacio", 2), ("sin_codigo", 1)}
    with plain_plans(spark):
        plan = good._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan and "isnotnull(codigo" in plan
        assert not any("denominacion" in x for x in steps(why, "Exchange"))


def test_wide_lines_are_shuffled_once_for_their_confirmed_code(spark):
    """every lookup shuffled all lines; a line without a supplier code is still found by its text."""
    lines = spark.createDataFrame([("c1", "t9", "ancho a"), (None, "t2", "ancho b"), ("c1", "t2", "ancho c"), ("c7", None, "ancho d"), (None, None, "ancho e")],
                                  "cod_prov string, desc_prov string, ancho string")
    known = spark.createDataFrame([("c1", 1), ("t2", 2)], "clave string, cod_int int")
    with plain_plans(spark):
        out = M.confirm_codes(lines, known)
        assert sum("ancho" in x for x in steps(out, "Exchange")) == 1
        assert {(r.ancho[-1], r.confirmado) for r in out.collect()} == {("a", 1), ("b", 2), ("c", 1), ("d", None), ("e", None)}


def test_instructions_are_compared_and_folded_in_one_pass(spark):
    """the instructions were shuffled once to verify them and once more to fold them."""
    h = spark.createDataFrame([("a", 1, "Uno", 10.0), ("b", 1, "Uno", 10.0), ("c", 1, "Uno", 10.0), ("d", 1, "Uno", 10.0)], "id string, codigo int, proveedor string, precio double")
    i = spark.createDataFrame([("a", "borrar", 1, "uno", 10.5, 2), ("b", "reapuntar", 1, "uno", 10.5, 5), ("b", "reapuntar", 1, "uno", 10.5, 4), ("c", "borrar", 1, "otro", 10.5, 2)],
                              "id string, accion string, codigo int, proveedor string, precio double, destino int")
    with plain_plans(spark):
        out = H.apply_fix(i, h)
        assert len(steps(out, "Exchange")) == 3
        assert {(r.id, r.codigo) for r in out.collect()} == {("b", 4), ("c", 1), ("d", 1)}


def shuffled_rows(plan):
    """Rows written by all shuffles of a plan that has run."""
    children, own = plan.children(), plan.metrics().get("shuffleRecordsWritten")
    return (own.get().value() if own.isDefined() else 0) + sum(shuffled_rows(children.apply(i)) for i in range(children.size()))


def test_lines_are_shuffled_twice_for_their_totals(spark):
    """lines went through more than ten shuffles, as bad and good ones, by two keys each, with and without their ids."""
    rows = [(f"l{i}", f"{'cemento' if i % 3 else 'arena fina'} gruesa {i % 7}", 900.0 * 1.004 ** i, float(2 + i % 3)) for i in range(600)]
    rows += [(f"t{i}", "".join(t.split())[:9], int(p * q / 1.105 * 100 + 0.5) / 100, q) for i, t, p, q in rows[::9]]
    with plain_plans(spark):
        out = P.total_as_unit_price(spark.createDataFrame(rows, "id string, texto string, precio double, cant double"))
        found = {r.id for r in out.collect()}
        assert {f"t{i}" for i, *_ in rows[:600:9]} <= found
        assert shuffled_rows(out._jdf.queryExecution().executedPlan()) < 2.5 * len(rows)


def test_crowded_cells_and_copies_find_the_twins_of_single_lines(spark):
    """where a cell counts by its least twin, its prices are still compared one by one at the ends of a band; copies all get theirs."""
    rows = [(i, "clavo de acero" if i % 2 else "clavo de a", 500.0 + i / 20, 2.0 if i % 5 else 1.105) for i in range(300)]
    rows += [(1000 + i, "clavo de acero x 50", int((498.0 + i / 5) * 2 / 1.105 * 100 + 0.5) / 100, 2.0) for i in range(90)]
    rows += [(2000 + i, t, p, q) for i, (_, t, p, q) in enumerate(rows[300::3])] + [(3000 + i, t, p, q) for i, (_, t, p, q) in enumerate(rows[300::3])]
    key = {i: "".join(t.split()) for i, t, _, _ in rows}
    expected = {}
    for i, _, p, q in rows:
        twins = [(j, o) for j, _, o, r in rows if r == q and p > o and (key[i].startswith(key[j]) or key[j].startswith(key[i])) and abs(p - o * r / 1.105) / (o * r / 1.105) < 0.005]
        if twins:
            expected[i] = min(twins)
    df = spark.createDataFrame(rows, "id long, texto string, precio double, cant double")
    for crowd in (1, 3, 1000):
        got = P.total_as_unit_price(df, crowd=crowd).collect()
        assert {r.id: (r.id_par, r.precio_bueno) for r in got} == expected and len(got) == len(expected) > 100


def test_only_numbers_are_shuffled_for_totals_on_the_next_line(spark):
    """every line was shuffled twice to find the lines after a label."""
    rows = [(d, i, f"item {i} 10.00") for d in range(20) for i in range(1, 21)] + [(d, 21, "TOTAL: $") for d in range(20)] + [(d, 22, "$ 200.00" if d % 2 else "gracias") for d in range(20)]
    lines = spark.createDataFrame(rows, "doc long, line_no long, line string")
    with plain_plans(spark):
        out = E.vat_regime(lines, lines.filter("line_no <= 20").select("doc", F.lit(10.0).alias("total")))
        assert {(r.doc % 2, r.iva_detectado) for r in out.collect()} == {(0, "ASUMIDO 1,105"), (1, "PRECIOS C/IVA INCLUIDO")}
        assert shuffled_rows(out._jdf.queryExecution().executedPlan()) < len(rows)


def test_cells_are_read_once_for_their_items(spark):
    """the tests of the parsed cells were written out below them, so that each cell was parsed over and over."""
    rows = [(1, 0, ["Codigo", "Detalle", "Cant", "Precio", "Total"]), (1, 1, ["C1", "ARENA FINA", "2,00 Unidades", "$ 1,234.00", "2,468.00"]),
            (1, 2, ["C2", "[AB 1] Cal\nfina", "3", "ARS 10,50", "31,50"]), (1, 3, ["C3", "Validez del presupuesto", "1", "5", "5"]), (1, 4, ["C4", "\nTubo", "", "$ars 7", None])]
    out = E.table_items(spark.createDataFrame(rows, "tabla long, fila int, celdas array<string>"))
    got = {r.fila: (r.cod, r.desc, r.cant, r.pu, r.total) for r in out.collect()}
    assert got == {1: ("C1", "ARENA FINA", 2.0, 2468.0, 1234.0), 2: ("AB 1", "Cal", 3.0, 31.5, 10.5)}
    assert not any("lambda" in line for line in str(out._jdf.queryExecution().optimizedPlan()).split("\n") if "Filter" in line)


def test_line_ids_are_not_shuffled_for_the_texts(spark, tmp_path):
    """the id of a line, its widest column, went through the join with the catalogue beside the columns it is written of."""
    from quotelens.plans.linkage import text_lines
    from quotelens.plans.units import sized

    spark.createDataFrame([(7, "hot bolt", "Brand#7", "LARGE", 3), (9, "old ring", "Brand#1", "PROMO", 5)], "p_partkey long, p_name string, p_brand string, p_type string, p_size long").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("select 11L l_orderkey, 7L l_partkey, 2L l_suppkey, 4 l_linenumber, 3.0D l_quantity, 20.5D l_extendedprice, 0.1D l_discount, 0.0D l_tax, timestamp'1996-09-13' l_shipdate "
              "union all select null, 9, 2, 1, null, 20.5, 0.1, 0.0, null").write.parquet(f"{tmp_path}/lineitem.parquet")
    with plain_plans(spark):
        for out in (text_lines(spark, str(tmp_path)), sized(spark, str(tmp_path))):
            assert steps(out, "Exchange") and not any("line_id" in x for x in steps(out, "Exchange"))
            assert {r.line_id for r in out.collect()} == {"11-4-7-2-2050-3-19960913", "1-9-2-2050"}
