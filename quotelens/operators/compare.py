"""Supplier comparison, savings, purchase lists and their views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import exact_sum, or_default, rnd

KEYS = ("codigo", "anio")


def cells(lines: DataFrame, seq: Column, keys=KEYS, supplier: str = "prov_id", keep=("neto", "cant", "con_iva")) -> DataFrame:
    """One cell per item and supplier; the last line wins (partial aggregation, no sort)."""
    last = F.max_by(F.struct(*keep), seq).alias("ultima")
    return lines.groupBy(*keys, supplier).agg(last).select(*keys, supplier, "ultima.*")


def compare(cell: DataFrame, keys=KEYS, supplier: str = "prov_id", price: str = "neto") -> DataFrame:
    """Best supplier (first supplier on ties), row quantity of the winner, spread of prices."""
    best = F.min_by(F.struct(F.col(supplier).alias("mejor_id"), "cant"), F.struct(price, supplier)).alias("b")
    return cell.groupBy(*keys).agg(
        F.count("*").alias("n_prov"), best, F.min(price).alias("minimo"), F.max(price).alias("maximo"),
        (exact_sum(F.col(price)) / F.count("*")).alias("promedio"),
    ).select(*keys, "n_prov", (F.col("n_prov") > 1).alias("en_varios"), "b.mejor_id", "b.cant", "minimo", "maximo", "promedio")


def guarded_saving(low: Column, high: Column, mean: Column, cant: Column, n: Column) -> Column:
    """Saving against the average quote; a spread above 3x claims nothing."""
    unsafe = (n < 2) | (low <= 0) | (high > 3 * low)
    return F.when(unsafe, 0.0).otherwise(rnd(F.greatest(F.lit(0.0), mean - low) * or_default(cant, 1)))


def with_saving(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "ahorro", guarded_saving(F.col("minimo"), F.col("maximo"), F.col("promedio"), F.col("cant"), F.col("n_prov")))


def describe(rows: DataFrame, materials: DataFrame, suppliers: DataFrame, supplier: str = "mejor_id") -> DataFrame:
    """Catalogue and supplier names, joined after the aggregation."""
    m = materials.select("codigo", "rubro", "material")
    s = suppliers.select(F.col("prov_id").alias(supplier), F.col("proveedor").alias("mejor"))
    return rows.join(m, "codigo", "left").join(s, supplier, "left")


def ordered(rows: DataFrame, *extra: str) -> DataFrame:
    """Items several suppliers quote come first."""
    return rows.orderBy(F.desc("en_varios"), "rubro", "material", *extra)


def summary(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_items"), F.count_if("en_varios").alias("n_comunes"), exact_sum(F.col("ahorro")).alias("ahorro_total"))


def gap_pct(low: Column, high: Column) -> Column:
    return F.when(low > 0, F.floor(100 * (high - low) / low + 0.5)).otherwise(F.lit(0).cast("bigint"))


def view_filter(rows: DataFrame, common: bool = False, category: str | None = None, min_gap: int | None = None) -> DataFrame:
    if common:
        rows = rows.filter("en_varios")
    if category and category != "Todos":
        rows = rows.filter(F.col("rubro") == category)
    if min_gap is not None:
        rows = rows.filter((F.col("n_prov") > 1) & (gap_pct(F.col("minimo"), F.col("maximo")) >= min_gap))
    return rows


def rerank(cell: DataFrame, row_cant: DataFrame, shown: Column, mode: str, keys=KEYS, supplier: str = "prov_id") -> DataFrame:
    """Winner and saving on displayed prices.

    ``export`` claims max-min of the line totals, ``screen`` the guarded average.
    """
    seen = cell.drop("cant").join(row_cant.select(*keys, "cant"), list(keys)).withColumn("visto", shown)
    seen = seen.withColumn("total", F.col("visto") * or_default(F.col("cant"), 1))
    rows = seen.groupBy(*keys).agg(
        F.min_by(supplier, F.struct("total", supplier)).alias("mejor_id"), F.first("cant").alias("cant"),
        F.count("*").alias("n_prov"), F.min("total").alias("minimo"), F.max("total").alias("maximo"),
        (exact_sum(F.col("total"), 4) / F.count("*")).alias("promedio"),
    )
    if mode == "export":
        saving = F.when(F.col("n_prov") > 1, rnd(F.col("maximo") - F.col("minimo"))).otherwise(0.0)
    elif mode == "screen":
        unsafe = (F.col("n_prov") < 2) | (F.col("minimo") <= 0) | (F.col("maximo") > 3 * F.col("minimo"))
        saving = F.when(unsafe, 0.0).otherwise(rnd(F.greatest(F.lit(0.0), F.col("promedio") - F.col("minimo"))))
    else:
        raise ValueError(mode)
    return rows.withColumn("ahorro", saving)


def regroup(rows: DataFrame, pos: str = "pos", category: str = "rubro") -> DataFrame:
    """Categories in order of first appearance, rows keep their order inside."""
    first = rows.groupBy(category).agg(F.min(pos).alias("primera"))
    return rows.join(first, category).orderBy("primera", pos)


def purchase_lines(rows: DataFrame) -> DataFrame:
    """Each row at its winner: unit price, quantity, line amount."""
    won = rows.filter(F.col("mejor_id").isNotNull())
    return won.withColumn("importe", F.col("minimo") * or_default(F.col("cant"), 1)).withColumn("subtotal", rnd(F.col("importe")))


def purchase_list(rows: DataFrame) -> DataFrame:
    """One order per supplier, biggest first; lines by category and item."""
    won = purchase_lines(rows)
    totals = won.groupBy("mejor_id").agg(exact_sum(F.col("importe"), 4).alias("t"), F.count("*").alias("n_items"))
    totals = totals.select("mejor_id", rnd(F.col("t")).alias("total"), "n_items")
    return won.join(totals, "mejor_id").orderBy(F.desc("total"), "mejor_id", "rubro", "material", "codigo", "anio")


def column_totals(cell: DataFrame, row_cant: DataFrame, keys=KEYS, supplier: str = "prov_id") -> DataFrame:
    """Column total per supplier; suppliers that quote net also get a with-VAT reference column."""
    seen = cell.drop("cant").join(row_cant.select(*keys, "cant"), list(keys))
    cant = or_default(F.col("cant"), 1)
    shown = rnd(F.col("neto") * F.when(F.col("con_iva"), 1.105).otherwise(1.0))
    return seen.groupBy(supplier).agg(
        rnd(exact_sum(shown * cant, 4)).alias("total"),
        rnd(exact_sum(F.when(~F.col("con_iva"), rnd(rnd(F.col("neto") * 1.105) * cant)), 4)).alias("total_referencia"),
        F.count("*").alias("n_celdas"),
    )


def sections(rows: DataFrame) -> DataFrame:
    """Report layout as grouping sets: grand total, category header, item rows."""
    return rows.rollup("rubro", "material").agg(
        F.grouping_id().alias("nivel"), F.count("*").alias("n"), exact_sum(F.col("ahorro")).alias("ahorro"))


def digest(rows: DataFrame, top: int = 5) -> DataFrame:
    """Top savings among the comparable rows."""
    return rows.filter("en_varios").orderBy(F.desc("ahorro"), "codigo", "anio").limit(top)


def curated_cells(auto: DataFrame, chosen: DataFrame, keys=KEYS, supplier: str = "prov_id") -> DataFrame:
    """A user's choice overrides the automatic cell or opens a new one."""
    both = auto.withColumn("prio", F.lit(0)).unionByName(chosen.withColumn("prio", F.lit(1)))
    payload = [c for c in auto.columns if c not in (*keys, supplier)]
    return both.groupBy(*keys, supplier).agg(F.max_by(F.struct(*payload), F.struct("prio", *payload)).alias("u")).select(
        *keys, supplier, "u.*")


def pair_concepts(links: DataFrame) -> DataFrame:
    """Concepts with a name and at least two linked lines become comparison rows.

    ``links(concepto, nombre, line_id, prov_id, neto, cant, cant_concepto)``; the
    last linked line of a supplier fills its slot.
    """
    named = links.filter(F.length(F.trim("nombre")) > 0)
    slots = named.groupBy("concepto", "prov_id").agg(
        F.max_by(F.struct("nombre", "neto", "cant_concepto"), "line_id").alias("s")).select("concepto", "prov_id", "s.*")
    return slots.groupBy("concepto").agg(
        F.trim(F.first("nombre")).alias("material"), F.count("*").alias("n_prov"),
        F.min_by("prov_id", F.struct("neto", "prov_id")).alias("mejor_id"), F.min("neto").alias("minimo"),
        F.first("cant_concepto").alias("cant"),
    ).filter("n_prov >= 2").select(
        F.concat(F.lit("emp_"), F.col("concepto").cast("string")).alias("cod_int"), F.lit("Emparejado a mano").alias("rubro"),
        "material", "cant", "n_prov", "mejor_id", "minimo", F.lit(0.0).alias("ahorro"), F.lit(True).alias("en_varios"),
        "concepto",
    )


def check_selection(selection: DataFrame, owner: tuple[str, ...], limit: int = 20) -> DataFrame:
    """``selection(owner..., doc)`` with ``valida``: a selection of more than ``limit`` quotes is refused as a whole, never shortened."""
    sizes = selection.groupBy(*owner).agg(F.count_distinct("doc").alias("n_docs"))
    return selection.join(sizes, list(owner)).withColumn("valida", F.col("n_docs") <= limit)


def split_choices(doubtful: DataFrame, accepted: Column) -> tuple[DataFrame, DataFrame]:
    """Doubtful lines by the user's choice: those taken over, and the rejected ones, which go to the unmatched lines."""
    ok = F.coalesce(accepted, F.lit(False))
    return doubtful.filter(ok), doubtful.filter(~ok)


def supplier_map(cell: DataFrame, keys=KEYS, supplier: str = "prov_id", keep=("neto", "cant")) -> DataFrame:
    """The prices of a comparison row as a map from supplier to its cell; as many entries as the item has suppliers."""
    entry = F.struct(F.col(supplier).alias("key"), F.struct(*keep).alias("value"))
    return cell.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("precios"))
