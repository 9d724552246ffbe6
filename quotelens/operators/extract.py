"""Quote-line extraction: lines of text files in, priced items out.

Lines are ``(doc, line_no, line)`` with consecutive numbers inside a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructType, StructField

from ..functions import lineformats as LF
from ..functions import substrings as S
from ..functions import textnorm as T
from ..functions.scalars import exact_sum, parse_number, rnd
from ..session import cut

EU = r"((?:\d{1,3}\.)*\d{1,3},\d{2})"
EU_LOOSE = r"((?:\d{1,3}\.)*\d+,\d{2})"
US = r"([\d,]+\.\d{2})"
US_STRICT = r"((?:\d{1,3},)*\d+\.\d{2})"

# --- fixed values: line formats in priority order --------------------------------
# name, pattern, where cod | desc | cant | pu | total | unidad | marca come from
FORMATS = (
    ("enseco", r"(?iU)^\s*(?:\[([A-Z0-9]+)\]\s+)?(\S.+?)\s+" + EU + r"\s+(?:Unidades?|ML|MTS?|M2|M3|KG|UN)\s+" + EU + r"\s+\$\s*" + EU + r"\s*$",
     "$1|$2|$3|$4|$5||"),
    ("viejobueno", r"(?U)^\s*\d+\s+(\d+\.\d{2})(\d{8,})\s+(.+?)\s+" + US_STRICT + r"\s+((?:\d{1,2}\.\d{2}\s+){0,3})" + US_STRICT + r"\s+" + US_STRICT + r"\s*$",
     "$2|$3|$1|$6|$7||"),
    ("carosio_presu", r"(?U)^\s*([A-Z]{2}[A-Z0-9]{2,})\s+(\S+)\s+(.+?)\s+" + US + r"\s+" + US + r"\s+([A-Za-z]{1,6}\.?)\s+" + US + r"\s*$",
     "$2|$3|$5|$4|$7|$6|"),
    ("alfonsin", r"(?U)^\s*(\d+(?:,\d{1,2})?)\s+(?:((?=[A-Z0-9]*\d)[A-Z0-9]{5,})\s+)?(.+?)\s+" + EU_LOOSE + r"\s+-\s*[\d.,]+%\s+" + EU_LOOSE + r"\s+" + EU_LOOSE + r"\s*$",
     "$2|$3|$1|$5|$6||"),
    ("madlobos", r"(?U)^\s*" + EU_LOOSE + r"\s+(.+?)\s+" + EU_LOOSE + r"\s+(-(?:\d{1,3}\.)*\d+,\d{2})\s+" + EU_LOOSE + r"\s+" + EU_LOOSE + r"\s*$",
     "|$2|$1|$5|$6||"),
    ("jeluz", r"(?U)^\s*\d+\s+(\S+)\s+(.+?)\s+(\d+)\s+(\S+)\s+(?:INMEDIATA|PARCIAL|CONSULTAR|A CONFIRMAR)\s+\*?\s*\$\s*" + US_STRICT + r"\s+(.+?)\s+\$\s*" + US_STRICT + r"\s*$",
     "$1|$2|$3|$5|$7|$4|$6"),
    ("ofertas", r"(?U)^\s*(\S+)\s+(\D.+?)\s+(\d+(?:,\d{2})?)\s+\$\s*" + EU_LOOSE + r"\s+\d{1,2}(?:,\d)?%\s+\$\s*" + EU_LOOSE + r"\s+\d{1,2}(?:,\d)?%\s+\$\s*(?:\d{1,3}\.)*\d+,\d{2}\s*$",
     "$1|$2|$3|$4|$5||"),
    ("molber", r"(?U)^\s*(\d+(?:\.\d{2})?)\s+([A-Z]{2,4})\s+(.+?)\s+[\d,]+\.\d{1,3}\s+(?:%\d{1,2}(?:\.\d)?\s+)?([\d,]+\.\d{1,3})\s+" + US + r"\s*$",
     "|$3|$1|$4|$5|$2|"),
    ("galpon", r"(?U)^\s*" + EU_LOOSE + r"\s+([A-Z]{1,3}\.?)\s+(.+?)\s+(?:\d{1,3}\.)*\d+,\d{2}\s+\d{1,2}%\s+" + EU_LOOSE + r"\s+" + EU_LOOSE + r"\s*$",
     "|$3|$1|$4|$5|$2|"),
    ("triunvirato", r"(?U)^\s*\d+\s+" + EU_LOOSE + r"\s+([A-Z][A-Z0-9*.ÑÁÉÍÓÚ]{3,})\s+(.+?)\s+" + EU_LOOSE + r"\s+\d{1,2},\d{2}\s+" + EU_LOOSE + r"\s*$",
     "$2|$3|$1|$4|$5||"),
    ("insuma", r"(?iU)^\s*(\S{6,})\s+(.+?)\s+(?:Unidades?|Toneladas?|Kilos?|Metros?|ML|MTS?|M2|M3|KG|UN)\s+(\d+(?:\.\d{1,3})?)\s+" + US + r"\s+\d{1,2}\.\d{2}\s+\d{1,2}\.\d{2}\s+" + US + r"\s*$",
     "$1|$2|$3|$4|$5||"),
    ("foresta", r"(?U)^\s*(\d{6,})\s+" + EU_LOOSE + r"\s*([A-ZÁÉÍÓÚÑ(].*?)\s+(?:[\d.,]+:\s*\+[\d.,]+\w*\s+)?\d{1,2},\d\s+" + EU_LOOSE + r"\s+" + EU_LOOSE + r"\s*$",
     "$1|$3|$2|$4|$5||"),
    ("laprida", r"(?U)^\s*(\d+\.\d{2})\s+(\d{6,})\s+(.+?)\s+" + US + r"\s+" + US + r"\s+" + US + r"\s*$",
     "$2|$3|$1|$5|$6||"),
    ("pedido_pev", r"(?U)^\s*(\S+)\s+(.+?)\s+" + EU_LOOSE + r"\s+\$\s*" + EU_LOOSE + r"\s+\$\s*" + EU_LOOSE + r"\s*$",
     "$1|$2|$3|$4|$5||"),
    ("cant_desc_iva", r"(?U)^\s*(\d+)\s+(\D.+?)\s+\d{1,2}\.\d{2}\s+" + US + r"\s+" + US + r"\s*$",
     "|$2|$1|$3|$4||"),
    ("fagua", r"(?U)^\s*(\d{2,13})\s*(.+?)\s+(\d+(?:\.\d{2})?)\s+\$\s*" + US + r"\s+\$\s*" + US + r"\s*$",
     "$1|$2|$3|$4|$5||"),
    ("baukraft", r"(?U)^\s*\d+[-.]?\s*(\S+)\s+(.+?)\s+(\d+(?:\.\d+)?)\s+([\d,]+\.\d+)\s+([\d,]+\.\d+)\s*$",
     "$1|$2|$3|$4|$5||"),
    ("carosio", r"(?U)^\s*\d+\s+(\S+)\s+(.+?)\s+([\d,]+\.\d+)\s+([\d,]+\.\d+)\s+\S+\s+([\d,]+\.\d+)\s*$",
     "$1|$2|$4|$3|$5||"),
    ("europeo", r"(?U)^\s*(\S+)\s+(\d+)\s+(.+?)\s+" + EU + r"\s+" + EU + r"\s*$",
     "$1|$3|$2|$4|$5||"),
    ("cant_desc_eur", r"(?U)^\s*" + EU_LOOSE + r"\s+(\D.+?)\s+" + EU_LOOSE + r"\s+" + EU_LOOSE + r"\s*$",
     "|$2|$1|$3|$4||"),
)
# --- fixed values: shapes of single lines ----------------------------------------
PRICE_AT_END = (r"^(?:(?:\d{1,3}[.]\d{3})+[,]\d{2}|(?:\d{1,3}[,]\d{3})+[.]\d{2}|\d+[.]\d{2}|\d+[,]\d{2})$")
ITEM_START = r"(?U)^\s*\d+\.\d{2}\s+\d{6,}\s"
SPACED_DIGITS = r"^(?:[\d.]{1,2} ){3,}[\d.]{1,2}(?= [A-ZÁÉÍÓÚÑ])"
CODE_REST = r"^[A-Z0-9./-]{1,8}$"
NO_PRICE_LINE = r"(?iU)^.{6,}?\s+\d{1,3}(?:\.\d{3})*(?:,\d{1,2})?\s+unidades?\s*$"
DECLARED_TOTAL = r"(?iU)TOTAL[\s\$:]+(\d{1,3}(?:[.,]\d{3})*[.,]\d{2})\b"
CASH_LEGEND = r"(?iU)CONTADO\s+EFECTIVO|EFECTIVO\s+(?:EN\s+)?MOSTRADOR|CONTADO\s+EN\s+MOSTRADOR"
SUPPLIER_NOTE = (r"(?iU)producto bajo pedido|demora entre|solo para retiro|horario de retiro|condici[oó]n de pago|validez del presupuesto|"
                 r"cotizaci[oó]n sujeta|la responsabilidad|p[aá]gina\s*\d|aclaraciones")
UNIT_SUFFIX = r"(?iU)^([\d.,]+)\s+(?:Unidades?|Mts?\.?|Kg\.?|m2|m3|ml|gl|lts?\.?|un\.?|pz\.?)\s*$"


# --- items ------------------------------------------------------------------------

def with_shape(lines: DataFrame) -> DataFrame:
    """Adds `ofrecidos`: places in FORMATS of the formats a line can be, by the shape of its first and last tokens."""
    places = {name: i for i, (name, _, _) in enumerate(FORMATS)}

    @F.arrow_udf("array<int>")
    def offers(line: pa.Array) -> pa.Array:
        return pa.array([[places[n] for n in LF.offered(x)] for x in line.to_pylist()], pa.list_(pa.int32()))

    return lines.withColumn("ofrecidos", offers("line"))


def offered(shape: str = "ofrecidos") -> Column:
    """What :func:`with_shape` has found; no format that would match is left out, and most lines are offered one to three."""
    return F.col(shape)


def parse_lines(lines: DataFrame, *carry: str) -> DataFrame:
    """Every format tried on every line it can be the format of; one row per line and matching format.

    The shape of a line offers few formats, and each offered one is tried once, in one pass over batches of lines.
    """
    formats = {name: (i, LF.compiled(rx), tuple(int("0" + g[1:]) for g in order.split("|"))) for i, (name, rx, order) in enumerate(FORMATS)}
    fields = pa.schema([("prio", pa.int32()), ("formato", pa.string()), ("cod", pa.string()), ("desc", pa.string()), ("cant", pa.float64()),
                        ("pu", pa.float64()), ("total", pa.float64()), ("unidad", pa.string()), ("marca", pa.string())])

    def scan(batches):
        for b in batches:
            found = list(zip(*LF.matches(b.column(b.num_columns - 1).to_pylist(), formats))) or [()] * (len(fields) + 1)
            kept = b.select(list(range(b.num_columns - 1))).take(pa.array(found[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(v, t) for v, t in zip(found[1:], fields.types))], names=[*kept.schema.names, *fields.names])

    x = lines.select("doc", "line_no", *carry, "line")
    types = "prio int, formato string, cod string, desc string, cant double, pu double, total double, unidad string, marca string"
    x = x.mapInArrow(scan, StructType([*x.schema.fields[:-1], *StructType.fromDDL(types)]))
    x = x.withColumn("unidad", F.upper(F.regexp_replace("unidad", r"^\.+|\.+$", "")))
    f = F.col("formato")
    glued = r"(?U)^(.+?\d)([A-ZÁÉÍÓÚÑ]{3,})$"
    x = x.withColumn("resto", F.when(f == "triunvirato", F.regexp_extract("cod", glued, 2)).otherwise(""))
    x = x.withColumn("cod", F.when(F.col("resto") != "", F.regexp_extract("cod", glued, 1)).otherwise(F.col("cod")))
    x = x.withColumn("desc", F.when(F.col("resto") != "", F.concat_ws(" ", "resto", "desc"))
                     .when(f == "alfonsin", F.regexp_replace("desc", r"[ .]+$", "")).otherwise(F.col("desc")))
    # this list price comes before the discount
    x = x.withColumn("pu", F.when(f == "insuma", F.when(F.col("cant") > 0, rnd(F.col("total") / F.col("cant")))).otherwise(F.col("pu")))
    x = x.withColumn("desc", T.join_split_letter(F.col("desc"))).drop("resto")
    return x.filter("cant is not null and pu is not null and total is not null")


def code_like(desc: Column) -> Column:
    return ~F.coalesce(T.has_word(desc, 4), F.lit(False))


def quality() -> Column:
    """Per item: a real description, consistent prices, and a penalty for shifted columns."""
    pu, cant, total = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("pu", "cant", "total"))
    fits = (pu > 0) & (cant > 0) & (total > 0) & (F.abs(pu * cant - total) <= F.greatest(F.lit(1.0), 0.01 * total))
    return (F.when(code_like(F.col("desc")), 0).otherwise(1) + F.when(fits, 1).otherwise(0)
            + F.when((cant < 0) | (pu > 50_000_000), -3).otherwise(0))


def elect(items: DataFrame, *ranks: str) -> DataFrame:
    """Winner per document over the whole document: quality, then items, then rank order.

    Partial aggregates only; the winner is the largest key, so a document of any
    length never has to be sorted in one task.
    """
    score = items.withColumn("q", quality()).groupBy("doc", *ranks).agg(F.sum("q").alias("q"), F.count("*").alias("n"))
    key = F.struct("q", "n", *[(-F.col(r)).alias(f"menos_{r}") for r in ranks])
    best = score.filter("q >= 0").groupBy("doc").agg(F.max(key).alias("k"))
    return best.select("doc", F.col("k.q").alias("q"), F.col("k.n").alias("n"), *[(-F.col(f"k.menos_{r}")).alias(r) for r in ranks])


def best_format(lines: DataFrame) -> DataFrame:
    """Items of the best format of each document; formats never mix inside one."""
    # what the repairs look at is found once and stored beside the lines, as they read it several times
    marked = cut(with_repairs(repair_codes(lines)))
    plain, other = marked.select("doc", "line_no", "line"), repair_text(marked).withColumn("variante", F.lit(1))
    # read twice below: once for the election, once for the winner's items
    items = cut(parse_lines(plain.withColumn("variante", F.lit(0)).unionByName(other), "variante"))
    won = elect(items, "prio", "variante")
    return items.join(won.select("doc", "prio", "variante"), ["doc", "prio", "variante"]).drop("variante")


# --- repairs ----------------------------------------------------------------------

def _next(lines: DataFrame) -> DataFrame:
    """The following line, by an equality join that spreads one document over all tasks."""
    return lines.select("doc", (F.col("line_no") - 1).alias("line_no"), F.col("line").alias("sig"))


def repair_codes(lines: DataFrame, block: int = 4096) -> DataFrame:
    """Glue a code that was wrapped to the next line onto its own line.

    Lines are read once and shuffled once, by document and block of line numbers; the lines at both ends of a block also go to
    its neighbour.
    """
    shape = dict((n, rx) for n, rx, _ in FORMATS)["ofertas"]
    signs = F.contains("line", F.lit("$")) & F.contains("line", F.lit("%"))
    own, place = F.floor(F.col("line_no") / block), F.pmod("line_no", F.lit(block))
    blocks = F.when(place == 0, F.array(own, own - 1)).when(place == block - 1, F.array(own, own + 1)).otherwise(F.array(own))
    x = lines.select("doc", "line_no", "line", F.explode(blocks).alias("b")).withColumns({
        "inicia": F.coalesce(signs & F.col("line").rlike(shape), F.lit(False)), "resto": F.coalesce(F.trim("line").rlike(CODE_REST), F.lit(False))})
    w = Window.partitionBy("doc", "b").orderBy("line_no")
    follows = lambda at, n: F.coalesce(at("line_no").over(w) == F.col("line_no") + n, F.lit(False))
    x = x.withColumns({
        "sig": F.when(F.col("inicia") & follows(F.lead, 1) & F.lead("resto").over(w), F.trim(F.lead("line").over(w))),
        "usada": F.col("resto") & follows(F.lag, -1) & F.lag("inicia").over(w)})
    code = F.regexp_extract("line", r"(?U)^\s*(\S+)", 1)
    at = F.instr("line", code) + F.length(code)
    glued = F.concat(F.substring("line", F.lit(1), at - 1), F.col("sig"), F.substring("line", at, F.length("line")))
    return x.filter((F.col("b") == own) & ~F.col("usada")).select("doc", "line_no", F.when(F.col("sig").isNotNull(), glued).otherwise(F.col("line")).alias("line"))


def _trailing_prices(tokens: Column) -> Column:
    """How many of the last two tokens are prices."""
    last, prev = F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit("")), F.coalesce(F.try_element_at(tokens, F.lit(-2)), F.lit(""))
    return F.when(~last.rlike(PRICE_AT_END), 0).when(~prev.rlike(PRICE_AT_END), 1).otherwise(2)


def run_starts(marks: DataFrame, block: int = 4096) -> DataFrame:
    """Start of the run of consecutive marked lines each marked line is in.

    Runs are found inside blocks of line numbers and then carried across blocks,
    where one document has one row per block.
    """
    x = marks.select("doc", "line_no", F.floor(F.col("line_no") / block).alias("b"))
    w = Window.partitionBy("doc", "b").orderBy("line_no")
    x = x.withColumn("isla", F.col("line_no") - F.row_number().over(w))
    runs = x.groupBy("doc", "b", "isla").agg(F.min("line_no").alias("ini"), F.max("line_no").alias("fin"))
    edges = runs.groupBy("doc", "b").agg(
        F.max(F.when(F.col("fin") == (F.col("b") + 1) * block - 1, F.col("ini"))).alias("cola"))
    wb = Window.partitionBy("doc").orderBy("b")
    full = F.col("cola") == F.col("b") * block
    # a block marked from end to end passes on what it was given
    chain = edges.withColumn("ancla", F.when(~F.coalesce(full, F.lit(False)) | (F.lag("b").over(wb).isNull())
                                             | (F.lag("b").over(wb) != F.col("b") - 1) | F.lag("cola").over(wb).isNull(), F.col("cola")))
    chain = chain.withColumn("pasa", F.when(F.col("cola").isNotNull(), F.last("ancla", True).over(wb.rowsBetween(Window.unboundedPreceding, 0))))
    prev = chain.select("doc", (F.col("b") + 1).alias("b"), F.col("pasa").alias("antes"))
    out = x.join(runs.select("doc", "b", "isla", "ini"), ["doc", "b", "isla"]).join(prev, ["doc", "b"], "left")
    first = F.col("ini") == F.col("b") * block
    return out.select("doc", "line_no", F.when(first, F.coalesce("antes", "ini")).otherwise(F.col("ini")).alias("inicio"))


def with_repairs(lines: DataFrame) -> DataFrame:
    """Adds what `repair_text` reads: the line with its digits closed (`junta`, null where none are spaced), whether it wants the
    next line (`pide`) and whether it can be taken by the one before (`cede`)."""
    digits = F.nullif(F.regexp_extract("line", SPACED_DIGITS, 0), F.lit(""))
    closed = F.regexp_replace(F.replace("pref", F.lit(" "), F.lit("")), r"^(\d+\.\d{2})(\d+)$", "$1 $2")
    x = lines.withColumn("pref", digits).withColumn(
        "junta", F.when(F.col("pref").isNotNull(), F.concat(closed, F.substring("line", F.length("pref") + 1, F.length("line")))))
    now = F.trim(F.coalesce("junta", "line"))
    # the next line is looked at as it came, before its own digits are closed
    raw = F.trim("line")
    last = F.element_at(F.split(raw, r"(?U)\s+"), -1)
    return x.withColumns({
        "pide": F.coalesce(now.rlike(r"^\d") & (_trailing_prices(F.split(now, r"(?U)\s+")) < 2), F.lit(False)),
        "cede": F.coalesce(last.rlike(PRICE_AT_END.replace("^", "", 1)) & ~raw.rlike(ITEM_START), F.lit(False))}).drop("pref")


def repair_text(x: DataFrame) -> DataFrame:
    """Close spaced digits and merge wrapped item lines of `with_repairs`; returns the lines of the documents that changed.

    A line takes the next one when it starts like an item, ends in fewer than two
    prices, and the next ends in a price without starting an item. Inside a run of
    such lines every other one is taken.
    """
    wants = x.filter("pide").select("doc", "line_no")
    gives = x.filter("cede").select("doc", (F.col("line_no") - 1).alias("line_no"), F.trim("line").alias("sig"))
    marks = wants.join(gives, ["doc", "line_no"])
    runs = run_starts(marks)
    taken = marks.join(runs, ["doc", "line_no"]).filter((F.col("line_no") - F.col("inicio")) % 2 == 0)
    used = taken.select("doc", (F.col("line_no") + 1).alias("line_no"))
    touched = x.filter("junta is not null").select("doc").unionByName(taken.select("doc")).distinct()
    # lines of other documents go into no further join
    out = x.join(touched, "doc", "left_semi").join(taken.select("doc", "line_no", "sig"), ["doc", "line_no"], "left").join(used, ["doc", "line_no"], "left_anti")
    now = F.coalesce("junta", "line")
    return out.select("doc", "line_no", F.when(F.col("sig").isNotNull(), F.concat_ws(" ", F.trim(now), "sig")).otherwise(now).alias("line"))


# --- fallbacks and document facts -----------------------------------------------------

def where(x: DataFrame, condition: Column, *columns: str | Column) -> DataFrame:
    """``x.filter(condition).select(*columns)`` without moving the test.

    Spark moves a filter below the columns it tests and writes their expressions out in it, once for each place they are named; a
    test of parsed numbers then parses each text many times. Here every column is worked out once.
    """
    out = F.struct(*columns)
    return x.select(F.inline(F.when(condition, F.array(out))))

def free_lines(lines: DataFrame) -> DataFrame:
    """Last resort: trailing numbers are price, or quantity and price, or quantity, price and total."""
    x = lines.select("doc", "line_no", F.split(F.trim("line"), r"(?U)\s+").alias("t"))
    priced = (F.size("t") >= 2) & F.element_at("t", -1).rlike(PRICE_AT_END)
    value = lambda t: F.when(t.rlike(r"^\d[\d.,]*\d$|^\d+$"), parse_number(t))
    # from the line's end; what follows the first token that is no number is not looked at
    x = x.withColumn("v", F.when(priced, F.transform(F.reverse("t"), value)))
    x = x.withColumn("corte", F.array_position(F.transform("v", lambda v: v.isNull()), True).cast("int"))
    x = x.withColumn("n", F.when(F.col("corte") > 0, F.col("corte") - 1).otherwise(F.size("v")))
    x = x.withColumns({"alto": F.array_max(F.slice("v", F.lit(1), F.col("n"))), "a": F.get("v", F.col("n") - 1), "b": F.get("v", F.col("n") - 2),
                       "desc": F.array_join(F.slice("t", F.lit(1), F.size("t") - F.col("n")), " ")})
    a, b = F.col("a"), F.col("b")
    small = (a < 500) & ((a == F.floor(a)) | (a % 0.5 == 0))
    two = (F.col("n") == 2)
    cant = F.when(F.col("n") == 1, 1.0).when(two, F.when(small & (b > a), a).otherwise(1.0)).otherwise(F.when(small, a).otherwise(1.0))
    pu = F.when(F.col("n") == 1, a).when(two, F.when(small & (b > a), b).otherwise(F.greatest(a, b))).otherwise(b)
    x = x.withColumns({"cant": cant, "pu": pu})
    found = ((F.col("n") > 0) & (F.col("alto") >= 10) & (F.col("n") < F.size("t")) & (F.col("pu") > 0)
             & (F.length("desc") >= 4) & ~F.col("desc").rlike(r"^[\d\-/.]+$"))
    return where(x, found, "doc", "line_no", F.lit("").alias("cod"), T.join_split_letter(F.col("desc")).alias("desc"), "cant", "pu",
                 rnd(F.col("pu") * F.col("cant")).alias("total"))


def clean_cell(raw: Column) -> Column:
    """First line of a cell without currency sign and unit; a pattern is only tried on what it can match."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    ars = lambda t: F.regexp_replace(t, r"(?iU)^ARS\s*", "")
    s = (F.when(F.startswith(s, F.lit("$")), ars(F.regexp_replace(s, r"(?U)^\$\s*", "")))
         .when(F.lower(F.substring(s, 1, 1)) == "a", ars(s)).otherwise(s))
    return F.regexp_replace(F.trim(F.substring_index(s, "\n", 1)), UNIT_SUFFIX, "$1")


def infer_columns(tables: DataFrame) -> DataFrame:
    """Roles of the columns of each table from what their cells look like.

    ``tables(tabla, fila, celdas)``; row 0 may be a header. Cell statistics are
    partial aggregates; only one struct per column is collected per table.
    """
    cells = tables.filter("fila > 0").select("tabla", "fila", F.posexplode("celdas").alias("col", "raw"))
    cells = cells.withColumn("v", clean_cell(F.col("raw"))).withColumn("x", parse_number(F.col("v")))
    filled = F.col("v") != ""
    stats = cells.groupBy("tabla", "col").agg(
        F.coalesce(F.count("x") / F.nullif(F.count_if(filled), F.lit(0)), F.lit(0.0)).alias("pct"),
        F.coalesce(F.sum(F.when(filled, F.length("v"))) / F.nullif(F.count_if(filled), F.lit(0)), F.lit(0.0)).alias("largo"),
        F.coalesce(exact_sum(F.col("x"), 4) / F.nullif(F.count("x"), F.lit(0)), F.lit(0.0)).alias("valor"),
        F.count_if(F.col("raw") != "").alias("llenas"), F.max(F.length(F.trim("raw"))).alias("maximo"))
    size = tables.groupBy("tabla").agg(F.count("*").alias("filas"), F.max(F.size("celdas")).alias("n_cols")).filter("filas >= 3 and n_cols >= 3")
    cols = stats.groupBy("tabla").agg(F.array_sort(F.collect_list(F.struct("col", "pct", "largo", "valor", "llenas", "maximo"))).alias("c"))
    cols = cols.join(size, "tabla")

    def top(arr, field, sign):
        """Column number of the extreme value; the leftmost of equal ones."""
        keyed = F.transform(arr, lambda c: F.struct((sign * c[field]).alias("k"), (-c["col"]).alias("m")))
        return -F.array_max(keyed)["m"]

    def without(arr, *names):
        taken = F.array_compact(F.array(*[F.col(n) for n in names]))
        return F.filter(arr, lambda c: ~F.array_contains(taken, c["col"]))

    x = cols.withColumn("desc_col", top(F.filter("c", lambda c: c["pct"] < 0.3), "largo", 1))
    x = x.withColumn("nums", F.filter(without(F.col("c"), "desc_col"), lambda c: c["pct"] > 0.5))
    x = x.withColumn("pu_col", top(F.col("nums"), "valor", 1))
    x = x.withColumn("total_col", top(without(F.col("nums"), "pu_col"), "valor", 1))
    x = x.withColumn("cant_col", top(without(F.col("nums"), "pu_col", "total_col"), "valor", -1))
    spare = F.filter(without(F.col("c"), "desc_col", "pu_col", "total_col", "cant_col"), lambda c: (c["llenas"] > 0) & (c["maximo"] <= 20))
    x = x.withColumn("cod_col", F.get(spare, 0)["col"])
    return where(x, F.col("desc_col").isNotNull() & (F.size("nums") >= 2), "tabla", "cod_col", "desc_col", "pu_col", "cant_col", "total_col")


def table_items(tables: DataFrame) -> DataFrame:
    """Generic table to items with the inferred columns."""
    x = tables.filter("fila > 0").join(infer_columns(tables), "tabla")
    raw = lambda c: F.trim(F.coalesce(F.get("celdas", F.col(c)), F.lit("")))
    x = x.withColumn("todo", raw("desc_col"))
    first = F.trim(F.element_at(F.filter(F.split("todo", "\n"), lambda l: F.trim(l) != ""), 1))
    x = x.withColumn("d", F.when(F.contains("todo", F.lit("\n")), first).otherwise(F.col("todo")))
    bracket = r"(?sU)^\[([A-Z0-9\s]+)\]\s*(.+)$"
    bracketed = F.startswith("d", F.lit("["))
    x = x.withColumns({"cod_c": F.when(bracketed, F.trim(F.regexp_extract("d", bracket, 1))).otherwise(""),
                       "d": F.when(bracketed, F.trim(F.regexp_replace("d", bracket, "$2"))).otherwise(F.col("d"))})
    num = lambda c: parse_number(clean_cell(raw(c)))
    x = x.withColumns({"pu": num("pu_col"), "cant": F.coalesce(num("cant_col"), F.lit(1.0)), "tot": num("total_col")})
    cod = F.when(F.col("cod_c") != "", F.col("cod_c")).otherwise(clean_cell(raw("cod_col")))
    found = (F.col("pu") > 0) & (F.length("d") >= 3) & ~F.col("todo").rlike(SUPPLIER_NOTE)
    return where(x, found, "tabla", "fila", cod.alias("cod"), T.join_split_letter(F.col("d")).alias("desc"), "cant", "pu",
                 F.coalesce("tot", rnd(F.col("pu") * F.col("cant"))).alias("total"))


def cascade(candidates: DataFrame, fallback: DataFrame, no_price: DataFrame, documents: DataFrame) -> DataFrame:
    """Method per document: tables and formats compete, then free lines, then "no prices".

    ``candidates(doc, metodo, prio, cod, desc, cant, pu, total)``.
    """
    names = candidates.select("prio", "metodo").distinct()
    won = elect(candidates, "prio").join(names, "prio").select("doc", F.col("metodo").alias("m1"), "q", F.col("n").alias("n1"))
    free = fallback.groupBy("doc").agg(F.count("*").alias("n2"))
    x = documents.join(won, "doc", "left").join(free, "doc", "left").join(no_price.select("doc", F.lit(True).alias("sp")), "doc", "left")
    method = F.coalesce("m1", F.when(F.col("n2") > 0, "lineas_heuristico"), F.when(F.col("sp"), "sin_precios"), F.lit("desconocido"))
    return x.select("doc", method.alias("metodo"), F.coalesce("n1", "n2", F.lit(0)).alias("n_items"))


def cascade_items(candidates: DataFrame, fallback: DataFrame, no_price: DataFrame, documents: DataFrame) -> DataFrame:
    """The items of each document's winning method: ``(doc, metodo, cod, desc, cant, pu, total)``; none where no method finds any."""
    method = cascade(candidates, fallback, no_price, documents).select("doc", "metodo")
    cols = ["doc", "metodo", "cod", "desc", "cant", "pu", "total"]
    own = candidates.join(method, ["doc", "metodo"]).select(*cols)
    return own.unionByName(fallback.join(method.filter("metodo = 'lineas_heuristico'"), "doc").select(*cols))


def no_price_documents(lines: DataFrame) -> DataFrame:
    """Quantities without any line price: a CANTIDAD header and five or more bare lines."""
    facts = lines.groupBy("doc").agg(
        F.max(F.col("line").rlike("(?i)CANTIDAD")).alias("cabecera"), F.count_if(F.col("line").rlike(NO_PRICE_LINE)).alias("n"))
    return facts.filter("cabecera and n >= 5").select("doc", "n")


def vat_regime(lines: DataFrame, items: DataFrame, relative: float = 0.0) -> DataFrame:
    """Declared total against the sum of the lines; the cash legend overrides.

    ``relative`` widens the tolerances to that share of the declared total; image documents take 0.001.
    """
    both = F.array(F.struct(F.lit(0).alias("copia"), F.col("line").alias("s")), F.struct(F.lit(1).alias("copia"), T.collapse_doubled(F.col("line")).alias("s")))
    # a label at the end of a line reads on into the next one
    label = F.coalesce(F.col("line").rlike(r"(?iU)TOTAL[\s\$:]*$"), F.lit(False))
    # only a line that goes on with a number adds to it, so no other line is shuffled for that
    numbers = _next(lines.filter(F.col("line").rlike(r"(?U)^[\s\$:]*\d")))
    longer = lines.filter(label).join(numbers, ["doc", "line_no"], "left").select("doc", "line_no", F.concat_ws("\n", "line", "sig").alias("line"))
    search = lines.filter(~label).select("doc", "line_no", "line").unionByName(longer)
    s = search.select("doc", "line_no", F.explode(both).alias("v")).select("doc", "line_no", "v.copia", "v.s")
    total = F.nullif(F.regexp_extract("s", DECLARED_TOTAL, 1), F.lit(""))
    facts = s.groupBy("doc").agg(
        F.min_by(total, F.when(total.isNotNull(), F.struct("copia", "line_no"))).alias("t"), F.max(F.col("s").rlike(CASH_LEGEND)).alias("efectivo"))
    sums = items.groupBy("doc").agg(exact_sum(F.col("total"), 4).alias("suma"))
    x = facts.join(sums, "doc", "left").withColumn("suma", F.coalesce("suma", F.lit(0.0))).withColumn("d", parse_number(F.col("t")))
    near = lambda f, tol: F.abs(F.col("suma") * f - F.col("d")) < F.greatest(F.lit(float(tol)), relative * F.col("d"))
    regime = (F.when(F.col("efectivo"), "PRECIOS EFECTIVO S/IVA (leyenda contado efectivo en mostrador)")
              .when(near(1.0, 1), "PRECIOS C/IVA INCLUIDO").when(near(1.21, 5), "PRECIOS S/IVA + 21%")
              .when(near(1.105, 5), "PRECIOS S/IVA + 10,5%").otherwise("ASUMIDO 1,105"))
    return x.select("doc", regime.alias("iva_detectado"), F.col("efectivo").alias("leyenda_efectivo"), rnd(F.col("suma")).alias("suma_lineas"))


def document_date(lines: DataFrame) -> DataFrame:
    """First labelled date, else the first date; an impossible one is skipped."""
    def first(rx):
        hit = F.nullif(F.regexp_extract("line", rx, 0), F.lit(""))
        return F.min_by(hit, F.when(hit.isNotNull(), F.col("line_no")))

    def as_date(c):
        p = lambda i: F.regexp_extract(c, r"(\d{1,2})/(\d{1,2})/(\d{4})", i)
        return F.concat_ws("-", p(3), F.lpad(p(2), 2, "0"), F.lpad(p(1), 2, "0")).try_cast("date")

    facts = lines.groupBy("doc").agg(
        first(r"(?U)Fecha\s*[:.]?\s*(\d{1,2})/(\d{1,2})/(\d{4})").alias("a"), first(r"(\d{1,2})/(\d{1,2})/(\d{4})").alias("b"))
    return facts.select("doc", F.coalesce(as_date(F.col("a")), as_date(F.col("b"))).alias("fecha"))


def supplier_key(raw: Column) -> Column:
    s = F.translate(F.upper(F.coalesce(raw, F.lit(""))), "ÁÉÍÓÚÑ", "AEIOUN")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[_\-.]+", " "), r"(?U)\s+", " "))


def alias_filter(aliases: DataFrame, gram: int = 6):
    """The aliases as they are compared, and a function for a task: batches of (key, text) to batches of (key, possible alias).

    The aliases go to the tasks only as a filter of fixed size over their first ``gram`` characters and lengths.
    """
    a = cut(aliases.withColumn("alias", supplier_key(F.col("alias"))).filter("alias <> ''"))

    def places(batches):
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(S.filter_places(words, gram), pa.int64()), pa.array([len(w) for w in words], pa.int64())], names=["lugar", "largo"])

    # about 2 ** BITS pairs at most, however many aliases there are
    known = a.select("alias").mapInArrow(places, "lugar long, largo long").distinct().collect()
    lengths = sorted({r.largo for r in known})
    bits = np.zeros(1 << S.BITS, bool)
    bits[[r.lugar for r in known]] = True
    shared = aliases.sparkSession.sparkContext.broadcast(np.packbits(bits))  # 2 ** BITS bits

    def scan(batches):
        here = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            texts_ = b.column(1).to_pylist()
            at = 0
            while at < len(texts_):  # about a million characters at once, or one longer text
                upto, size = at, 0
                while upto < len(texts_) and (upto == at or size + len(texts_[upto]) <= 1_000_000):
                    size += len(texts_[upto])
                    upto += 1
                row, words = S.possible_words(texts_[at:upto], here, lengths, gram)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + at)), pa.array(words, pa.string())], names=[b.schema.names[0], "alias"])
                at = upto

    return a, scan


def contained_alias(texts: DataFrame, aliases: DataFrame, key: str, known=None) -> DataFrame:
    """Longest alias contained in a text, ties by alias order: ``(key, canonico)``.

    Places of a text that pass the filter (``known``, from :func:`alias_filter`) give substrings, and these join the aliases
    for equality. Time is linear in a text's length; neither the filter nor a task grows with the number of aliases.
    """
    a, scan = known or alias_filter(aliases)
    t = texts.select(key, supplier_key(F.col("texto")).alias("texto")).filter("texto <> ''")
    hits = t.mapInArrow(scan, StructType([t.schema[key], StructField("alias", StringType())])).join(a, "alias")
    return hits.groupBy(key).agg(F.max_by("canonico", F.struct(F.length("alias"), -F.col("orden"))).alias("canonico"))


def in_stretches(lines: DataFrame, stretch: int = 500, overlap: int = 50) -> DataFrame:
    """``(doc, texto)``: a document's lines in stretches, each with the first lines of the next, so no document is held whole."""
    n = F.col("line_no") - 1
    block = F.floor(n / stretch)
    before = (n % stretch < overlap) & (block > 0)
    dealt = lines.select("doc", "line_no", "line", F.explode(F.when(before, F.array(block, block - 1)).otherwise(F.array(block))).alias("tramo"))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return dealt.groupBy("doc", "tramo").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("texto")).drop("tramo")


def detect_supplier(files: DataFrame, lines: DataFrame, aliases: DataFrame, head: int | None = None) -> DataFrame:
    """By file name, else by the text lines (the first ``head``, default all); with the kind of evidence.

    An alias may reach over line ends, over at most 50 of them.
    """
    stem = F.regexp_replace(F.element_at(F.split("archivo", "/"), -1), r"\.[^.]*$", "")
    known = alias_filter(aliases)
    by_name = contained_alias(files.select("doc", stem.alias("texto")), aliases, "doc", known).select("doc", F.col("canonico").alias("por_archivo"))
    by_name = cut(by_name)  # read three times
    rest = files.join(by_name, "doc", "left_anti").select("doc")
    top = (lines if head is None else lines.filter(F.col("line_no") <= head)).join(rest, "doc", "left_semi")
    by_text = contained_alias(in_stretches(top), aliases, "doc", known).select("doc", F.col("canonico").alias("por_texto"))
    x = files.join(by_name, "doc", "left").join(by_text, "doc", "left")
    return x.select("doc", F.coalesce("por_archivo", "por_texto").alias("proveedor"),
                    F.when(F.col("por_archivo").isNotNull(), "ARCHIVO").when(F.col("por_texto").isNotNull(), "TEXTO").otherwise("NO DETECTADO").alias("confianza"))


def block_supplier(files: DataFrame) -> DataFrame:
    """The first file of a block names the whole block: ``files(bloque, idx, nombre)``."""
    first = files.groupBy("bloque").agg(F.min_by("nombre", "idx").alias("proveedor"))
    return files.join(first, "bloque")


def doubtful_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """No items, or five or more lines with own totals of which fewer than half add up."""
    own = (F.col("total") > 0) & (F.col("pu") > 0) & (F.col("cant") > 0)
    fits = own & (F.abs(F.col("pu") * F.col("cant") - F.col("total")) <= F.greatest(F.lit(1.0), 0.01 * F.col("total")))
    facts = items.groupBy("doc").agg(F.count("*").alias("n_items"), F.count_if(own).alias("con_total"), F.count_if(fits).alias("n_consistentes"))
    x = documents.join(facts, "doc", "left").na.fill(0, ["n_items", "con_total", "n_consistentes"])
    reason = F.when(F.col("n_items") == 0, "cero_items").when(
        (F.col("con_total") >= 5) & (F.col("n_consistentes") < F.col("con_total") * 0.5), "inconsistente")
    return x.withColumn("motivo", reason)
