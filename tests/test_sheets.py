"""Sheets with wide rows, quoted line breaks and inch marks; brands, conversions and rates at their edges."""

import csv
import datetime
import io
import random
import time

from pyspark.sql import functions as F

from quotelens.functions import textnorm as T
from quotelens.operators import extract as E
from quotelens.operators import ingest as I
from quotelens.operators import pricing as P
from quotelens.operators import units as U
from quotelens.sources import sheets as S


def parsed(spark, text, name="f"):
    rows = S.sheet_rows(spark.createDataFrame([(name, text)], "archivo string, contenido string")).collect()
    return [[c or "" for c in r.celdas] for r in sorted(rows, key=lambda r: r.fila)]


def test_cells_equal_a_csv_reader(spark):
    text = 'cod;desc;precio\n1;CAÑO 1/2" x 6;10\n2;"a ""b""\nc;d";20\n"x";"";30\n\n3;1/2";40\n4;"tres\nlineas\n";"5"\n'
    assert parsed(spark, text) == [r for r in csv.reader(io.StringIO(text), delimiter=";") if r]


def test_fifty_columns(spark):
    head = ["codigo", "descripcion"] + [f"x{i}" for i in range(41)] + ["precio unitario"] + [f"y{i}" for i in range(6)]
    row = ["7", "TORNILLO"] + [str(i) for i in range(41)] + ["99,50"] + ["z"] * 6
    files = spark.createDataFrame([("f", "\n".join(",".join(f'"{c}"' for c in r) for r in (head, row)))], "archivo string, contenido string")
    items = S.sheet_items(S.sheet_rows(files)).collect()
    assert [(i.desc, i.pu) for i in items] == [("TORNILLO", 99.5)]


def test_header_far_down_and_the_separator_of_the_whole_file(spark):
    text = "\n".join(["aviso, con coma"] * 25 + ["nota"] * 20 + ["codigo;descripcion;precio"] + [f"{i};item {i};{i}" for i in range(1, 60)])
    files = spark.createDataFrame([("f", text)], "archivo string, contenido string")
    rows = S.sheet_rows(files)
    assert S.sheet_items(rows).count() == 59 and S.find_headers(rows, first_rows=30).count() == 0


def test_many_quoted_rows_with_line_breaks(spark, tmp_path):
    n = 100_000
    with open(tmp_path / "big.csv", "w", encoding="utf-8") as f:
        f.write("codigo,descripcion,precio\n")
        f.writelines(f'{i},"item {i}\ncon, ""salto""\n{i}",{i}\n' for i in range(n))
    rows = S.sheet_rows(S.read_lines(spark, str(tmp_path / "big.csv")))
    got = rows.agg(F.count("*").alias("n"), F.min(F.size("celdas")).alias("a"), F.max(F.size("celdas")).alias("b"), F.max("fila").alias("f")).first()
    assert tuple(got) == (n + 1, 3, 3, n)
    one = rows.filter("fila = 77778").first()
    assert one.celdas == ["77777", 'item 77777\ncon, "salto"\n77777', "77777"]


def test_brand_of_five_words(spark):
    brands = spark.createDataFrame([("LA GRAN CASA DEL TORNILLO", "g1"), ("ACME", "g2")], "marca string, grupo string")
    texts = spark.createDataFrame([(1, "tornillo 5 la gran casa del tornillo x 3"), (2, "acme la gran"), (3, "nada")], "k long, texto string")
    got = {r.k: r.g for r in T.with_brand_groups(texts, "k", "texto", brands, "g").collect()}
    assert got == {1: ["g1"], 2: ["g2"], 3: []}
    assert T.with_brand_groups(texts, "k", "texto", brands.limit(0), "g").filter("size(g) = 0").count() == 3


def test_two_conversions_of_a_code_keep_one_line(spark):
    lines = spark.createDataFrame([(1, "CLAVO x 50 un.", "caja", 100.0, 2.0)], "codigo long, desc string, unidad string, pu double, cant double")
    conv = spark.createDataFrame([(1, "kg", 1.0, "KG"), (1, "un", 50.0, "UN")], "codigo long, unidad_comercial string, factor double, unidad_base string")
    assert [(r.pu_norm, r.unidad_final) for r in U.convert_units(lines, conv).collect()] == [(2.0, "UN")]


def test_undated_and_unnamed_currencies(spark):
    day = datetime.date(2024, 1, 10)
    lines = spark.createDataFrame([(1, 10.0, None, "USD"), (2, 10.0, day, "USD"), (3, 10.0, None, None)], "id long, pu double, fecha date, moneda string")
    rates = spark.createDataFrame([("USD", datetime.date(2024, 1, 1), 900.0)], "moneda string, fecha date, venta double")
    got = {r.id: (r.pu_ars, r.estado_tc, r.moneda) for r in P.convert_currency(lines, rates).collect()}
    assert got == {1: (None, "SIN_TC", "USD"), 2: (9000.0, "OK", "USD"), 3: (10.0, "OK", "ARS")}


def test_rates_by_the_minute_against_a_plain_search(spark):
    rng = random.Random(5)
    zero = datetime.datetime(1969, 12, 31, 22, 0)
    moment = lambda: zero + datetime.timedelta(minutes=rng.randrange(6000) // rng.choice([1, 60]) * rng.choice([1, 1, 5]))
    quoted = [(rng.choice(["USD", "EUR"]), moment(), float(rng.randrange(1, 99))) for _ in range(80)] + [("USD", None, 5.0), ("EUR", moment(), None)]
    asked = [(i, 2.0, moment(), rng.choice(["USD", "EUR", "ARS", "JPY"])) for i in range(300)]
    lines = spark.createDataFrame(asked, "id long, pu double, fecha timestamp, moneda string")
    rates = spark.createDataFrame(quoted, "moneda string, fecha timestamp, venta double")
    expected = {}
    for i, _, at, name in asked:
        known = [(m, v) for c, m, v in quoted if c == name and m is not None and v is not None and m <= at]
        expected[i] = max(known)[1] if known else None
    for seconds in (60, 3600, 86400):
        got = P.convert_currency(lines, rates, seconds=seconds).collect()
        assert {r.id: r.tc for r in got} == expected and len(got) == len(asked)
    assert P.convert_currency(lines.limit(0), rates).count() == 0
    assert {r.estado_tc for r in P.convert_currency(lines, rates.limit(0)).collect()} == {"OK", "SIN_TC"}


def test_totals_as_unit_prices_against_all_pairs(spark):
    rng = random.Random(6)
    names = ["cemento portland", "cemento por", "Cemento Portland x 25", "cemento", "arena fina gruesa", "arena fi"]
    # one item with many prices in one band, and quantities whose total lies close to the unit price
    rows = [(i, rng.choice(names), rng.choice([100.0, 181.0, 905.0, 1000.0]) * (1 + rng.randrange(-120, 121) / 10_000), rng.choice([1.0, 1.1, 1.105, 1.11, 2.0, 10.0]))
            for i in range(900)] + [(900, "cemento portland", 0.0, 2.0), (901, None, 5.0, 2.0), (902, "cemento portland", 5.0, None)]
    rows += [(1000 + i, "clavo de acero", 500.0 + i / 100, 2.0) for i in range(400)] + [(2000 + i, "clavo de acero", rnd2((500.0 + i) * 2 / 1.105), 2.0) for i in range(5)]
    key = lambda t: "".join((t or "").lower().split())
    known = [(i, key(t), p, q) for i, t, p, q in rows if p > 0 and q and len(key(t)) >= 8]
    expected = {}
    for i, k, p, q in known:
        twins = [(j, o) for j, l, o, r in known if r == q and p > o and (k.startswith(l) or l.startswith(k)) and abs(p - o * r / 1.105) / (o * r / 1.105) < 0.005]
        if twins:
            expected[i] = min(twins)
    got = P.total_as_unit_price(spark.createDataFrame(rows, "id long, texto string, precio double, cant double")).collect()
    assert {r.id: (r.id_par, r.precio_bueno) for r in got} == expected and len(got) == len(expected) > 100


def rnd2(x):
    return int(x * 100 + 0.5) / 100


def test_aliases_that_begin_alike(spark):
    aliases = spark.createDataFrame([(f"SUPPLIER {i:03d}", f"c{i}", i) for i in range(300)] + [("SU", "corto", 999)], "alias string, canonico string, orden long")
    texts = spark.createDataFrame([(k, f"presupuesto supplier {k:03d} y supplier") for k in range(40)] + [(99, "su casa"), (100, "nada")], "doc long, texto string")
    got = {r.doc: r.canonico for r in E.contained_alias(texts, aliases, "doc").collect()}
    assert got == {**{k: f"c{k}" for k in range(40)}, 99: "corto"}


def test_relative_tolerance_of_image_documents(spark):
    lines = spark.createDataFrame([("d", 1, "TOTAL $ 100.040,00")], "doc string, line_no int, line string")
    items = spark.createDataFrame([("d", 100000.0)], "doc string, total double")
    regime = lambda r: E.vat_regime(lines, items, r).first().iva_detectado
    assert (regime(0.0), regime(0.001)) == ("ASUMIDO 1,105", "PRECIOS C/IVA INCLUIDO")


def test_oversized_selection_is_refused_not_shortened(spark):
    from quotelens.operators import compare as C

    rows = [("a", i) for i in range(25)] + [("b", i) for i in range(20)]
    got = {r.user_id: (r.n_docs, r.valida) for r in C.check_selection(spark.createDataFrame(rows, "user_id string, doc long"), ("user_id",)).collect()}
    assert got == {"a": (25, False), "b": (20, True)}


def test_contained_alias_equals_substring_search(spark):
    draw = random.Random(9)
    word = lambda n: "".join(draw.choice("AB .-ñÉ") for _ in range(draw.randrange(1, n)))
    aliases = [(word(9), f"c{i}", i) for i in range(80)] + [("", "nada", 900), (None, "nulo", 901)]
    texts = [(k, word(60)) for k in range(150)] + [(1000, ""), (1001, None), (1002, " "), (1003, "A" * 300)]
    rows = lambda data, names: spark.createDataFrame(data, names)
    key = {r.s: r.k for r in rows([(x,) for x in {a for a, _, _ in aliases} | {t for _, t in texts} if x is not None], "s string").select(
        "s", E.supplier_key(F.col("s")).alias("k")).collect()}
    want = {}
    for k, t in texts:
        hit = [(-len(key[a]), o, c) for a, c, o in aliases if a is not None and key[a] and t is not None and key[a] in key[t]]
        if hit:
            want[k] = min(hit)[2]
    got = E.contained_alias(rows(texts, "doc long, texto string"), rows(aliases, "alias string, canonico string, orden long"), "doc").collect()
    assert {r.doc: r.canonico for r in got} == want and len(got) == len(want)


def test_supplier_in_texts_of_one_megabyte_and_across_lines(spark):
    aliases = spark.createDataFrame([("corralon del sur", "CDS", 1), ("sur", "SUR", 2)], "alias string, canonico string, orden long")
    files = spark.createDataFrame([(i, "/in/scan.pdf") for i in range(4)], "doc long, archivo string")
    lines = [(0, 1, "sur" + "x" * 1_000_000 + " CORRALÓN_DEL-SUR"), (1, 1, "y" * 1_000_000)]
    lines += [(2, i, "nada") for i in range(1, 2000)] + [(3, i, {500: "corralon", 501: "del", 502: "sur"}.get(i, "z")) for i in range(1, 1200)]
    began = time.time()
    got = E.detect_supplier(files, spark.createDataFrame(lines, "doc long, line_no int, line string"), aliases).collect()
    assert {r.doc: (r.proveedor, r.confianza) for r in got} == {0: ("CDS", "TEXTO"), 1: (None, "NO DETECTADO"), 2: (None, "NO DETECTADO"), 3: ("CDS", "TEXTO")}
    assert time.time() - began < 60


def test_items_that_share_a_printed_code_keep_their_names(spark):
    """the printed code is cut to five digits, the item is not."""
    target = spark.createDataFrame([], "cod_prov string, proveedor string, cod_int string, item_int string, fuente string, confianza int")
    decisions = spark.createDataFrame([("CARGAR", "COD12345", None, "casa_lista.xlsx", f"P{k}", str(k), k) for k in (12345, 123450, 123451)],
                                      "decision string, cod_propuesto string, cod_correcto string, fuente string, cod_prov string, seq string, codigo long")
    catalogue = spark.createDataFrame([(12345, "uno"), (123450, "dos"), (123451, "tres")], "codigo long, item_int string")
    got = I.seed_equivalences(target, decisions, catalogue, item="codigo").collect()
    assert {(r.cod_prov, r.item_int) for r in got} == {("P12345", "uno"), ("P123450", "dos"), ("P123451", "tres")}


def test_whole_files_equal_the_path_by_lines(spark):
    """files without a cell over several lines are read in place, the others by their lines."""
    texts = {"a": "lista\n\ncodigo;descripcion;precio\r\n1;uno;10,5\n;Total;99\n", "b": 'sku,detalle,cant.,p unit\n7,"dos\nlineas",2,3.5\n8,"x ""y""",1,4\n', "c": "nada", "d": ""}
    files = spark.createDataFrame(list(texts.items()), "archivo string, contenido string")
    by_lines = S.sheet_rows(S.text_lines(files))
    flat = lambda df: sorted(map(str, df.collect()))
    assert flat(S.sheet_rows(files)) == flat(by_lines)
    assert flat(S.find_headers(files)) == flat(S.find_headers(by_lines)) and S.find_headers(files).count() == 2
    assert flat(S.sheet_items(files)) == flat(S.sheet_items(by_lines)) and S.sheet_items(files).count() == 3
