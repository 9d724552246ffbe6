"""Price history: series, dispersion, gap indices and bulk corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import exact_sum, rnd


def price_series(history: DataFrame) -> DataFrame:
    """Pipeline prices per material in time order; currency defaults to ARS."""
    kept = history.filter((F.col("origen") == "pipeline") & F.col("precio").isNotNull())
    return kept.select("codigo", "fecha", "proveedor", "precio", F.coalesce("unidad", F.lit("UN")).alias("unidad"),
                       F.coalesce("moneda", F.lit("ARS")).alias("moneda"), "line_id")


def latest(history: DataFrame, seq: Column, *keys: str) -> DataFrame:
    """Newest price per key, by aggregation instead of a sort."""
    return history.groupBy(*keys).agg(F.max_by(F.struct("precio", "fecha"), seq).alias("u")).select(*keys, "u.*")


def unify_suppliers(history: DataFrame, names: DataFrame) -> DataFrame:
    """``names(prov_id, grupo_id)``: several names of one business."""
    return history.join(names, "prov_id", "left").withColumn("prov_id", F.coalesce("grupo_id", "prov_id")).drop("grupo_id")


def dispersion(prices: DataFrame, *keys: str, supplier: str = "prov_id", min_suppliers: int = 2) -> DataFrame:
    """Spread per material and currency; never mixes currencies.

    Rows collapse to one per supplier first, so counting suppliers needs no
    distinct over the raw history of a busy material.
    """
    per = prices.groupBy(*keys, supplier).agg(F.min("precio").alias("lo"), F.max("precio").alias("hi"), F.count("*").alias("n"))
    out = per.groupBy(*keys).agg(
        F.count("*").alias("n_prov"), F.sum("n").alias("n_precios"), F.min("lo").alias("minimo"), F.max("hi").alias("maximo"))
    out = out.filter((F.col("n_prov") >= min_suppliers) & (F.col("minimo") > 0))
    return out.withColumn("razon", rnd(F.col("maximo") / F.col("minimo"))).withColumn("disperso", F.col("maximo") > 3 * F.col("minimo"))


def gaps(spread: DataFrame) -> DataFrame:
    return spread.withColumn("brecha", rnd((F.col("maximo") - F.col("minimo")) / F.col("minimo"), 4))


def ranked_gaps(spread: DataFrame, *order: str, top: int = 25) -> DataFrame:
    """The ``top`` largest gaps with their rank, ties by ``order``; only these rows meet in one task."""
    largest = gaps(spread).orderBy(F.desc("brecha"), *order).limit(top)
    return largest.withColumn("puesto", F.row_number().over(Window.orderBy(F.desc("brecha"), *order)))


def exact_median(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Median per group without holding a group in one place.

    Equal values collapse to counts, value ranges to cumulative counts; only the
    ranges that hold the middle ranks are sorted.
    """
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    counts = counts.withColumn("b", F.floor(F.signum(value) * F.log1p(F.abs(F.col(value))) * 256))
    blocks = counts.groupBy(*by, "b").agg(F.sum("c").alias("bc"))
    w = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("hasta", F.sum("bc").over(w)).withColumn("total", F.sum("bc").over(Window.partitionBy(*by)))
    lo, hi = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    hit = blocks.withColumn("desde", F.col("hasta") - F.col("bc")).withColumn("lo", lo).withColumn("hi", hi)
    hit = hit.filter(((F.col("lo") > F.col("desde")) & (F.col("lo") <= F.col("hasta"))) | ((F.col("hi") > F.col("desde")) & (F.col("hi") <= F.col("hasta"))))
    inner = counts.join(hit.select(*by, "b", "desde", "lo", "hi"), [*by, "b"])
    wi = Window.partitionBy(*by, "b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = inner.withColumn("fin", F.col("desde") + F.sum("c").over(wi)).withColumn("ini", F.col("fin") - F.col("c"))
    pick = lambda r: F.max(F.when((F.col(r) > F.col("ini")) & (F.col(r) <= F.col("fin")), F.col(value)))
    return inner.groupBy(*by).agg(((pick("lo") + pick("hi")) / 2).alias("mediana"))


def gap_index(spread: DataFrame, *by: str) -> DataFrame:
    """Mean and median gap with and without the 3x guard, and the healthy share, per group."""
    g = gaps(spread)
    if not by:
        g, by = g.withColumn("todo", F.lit(1)), ("todo",)
    base = g.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(~F.col("disperso")).alias("n_sanos"),
        (exact_sum(F.col("brecha"), 4) / F.count("*")).alias("media"),
        (exact_sum(F.when(~F.col("disperso"), F.col("brecha")), 4) / F.count_if(~F.col("disperso"))).alias("media_guarda"),
    )
    plain = exact_median(g, "brecha", *by)
    safe = exact_median(g.filter(~F.col("disperso")), "brecha", *by).withColumnRenamed("mediana", "mediana_guarda")
    out = base.join(plain, list(by)).join(safe, list(by), "left")
    out = out.withColumn("pct_sanos", rnd(100.0 * F.col("n_sanos") / F.col("n"), 1))
    for c in ("media", "media_guarda", "mediana", "mediana_guarda"):
        out = out.withColumn(c, rnd(F.col(c), 4))
    return out.drop("todo")


def sensitivity(spread: DataFrame, brand_sensitive: Column, max_gap: float = 1.5) -> DataFrame:
    """Median gap under each cut: all, without the VAT band 8-13 %, without brand-sensitive items, without gaps above 150 %."""
    g = gaps(spread).withColumn("marca", brand_sensitive)
    cases = F.array(
        F.struct(F.lit("todos").alias("corte"), F.lit(True).alias("entra")),
        F.struct(F.lit("sin_banda_iva").alias("corte"), (~F.col("brecha").between(0.08, 0.13)).alias("entra")),
        F.struct(F.lit("sin_marca").alias("corte"), (~F.col("marca")).alias("entra")),
        F.struct(F.lit("sin_extremos").alias("corte"), (F.col("brecha") <= max_gap).alias("entra")),
    )
    long = g.select("brecha", F.explode(cases).alias("c")).filter("c.entra").select("brecha", F.col("c.corte").alias("corte"))
    n = long.groupBy("corte").agg(F.count("*").alias("n"))
    return exact_median(long, "brecha", "corte").join(n, "corte").withColumn("mediana", rnd(F.col("mediana"), 4))


def rebuild(linked: DataFrame) -> DataFrame:
    """Why a stored line does or does not enter the rebuilt history."""
    reason = (
        F.when((F.trim(F.coalesce("texto", F.lit(""))) == "") | F.col("precio").isNull() | (F.col("precio") <= 0), "sin_texto_o_precio")
        .when(F.col("codigo_match").isNull(), "sin_match")
        .when(F.col("score") < 85, "score_bajo")
        .when(F.col("ambigua"), "unidad_ambigua")
        .otherwise("aceptado")
    )
    return linked.withColumn("motivo", reason)


def rebuilt_rows(judged: DataFrame) -> DataFrame:
    """Accepted lines of :func:`rebuild` as rows of the new history, in the unit of their item."""
    return judged.filter("motivo = 'aceptado'").select(
        "line_id", F.col("codigo_match").alias("codigo"), "prov_id", F.col("pu_norm").alias("precio"), F.col("unidad_final").alias("unidad"),
        F.col("nota").alias("conversion_aplicada"), F.lit("reconstruido").alias("origen"))


def rebuild_summary(rebuilt: DataFrame) -> DataFrame:
    """Rows, materials, materials with several suppliers and converted rows of the new history."""
    per = rebuilt.groupBy("codigo").agg(F.count("*").alias("n"), F.count_distinct("prov_id").alias("p"), F.count("conversion_aplicada").alias("c"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("filas"), F.count("*").alias("materiales"),
                   F.count_if(F.col("p") > 1).alias("multi_proveedor"), F.coalesce(F.sum("c"), F.lit(0)).alias("convertidas"))


def correction_plan(judged: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link judged lines to history rows by (code, rounded price).

    ``judged(item_id, codigo, precio, veredicto, sugerido, score)``. Returns the
    action per history row (a row that also belongs to a healthy line is
    protected) and the judged lines without a history row.
    """
    j = judged.withColumn("clave", rnd(F.col("precio")))
    move = (F.col("veredicto") == "ERRADO") & F.col("sugerido").isNotNull() & (F.col("score") >= 85)
    j = j.withColumn("accion", F.when(F.col("veredicto") == "OK", "proteger").when(move, "reasignar").otherwise("borrar"))
    h = history.select("id", "codigo", rnd(F.col("precio")).alias("clave"))
    # one row per (code, price) on the judged side: repeated quotes collapse first
    keyed = j.groupBy("codigo", "clave").agg(
        F.max(F.col("accion") == "proteger").alias("sano"), F.max(F.col("accion") == "borrar").alias("borrar"),
        F.max_by("sugerido", F.when(F.col("accion") == "reasignar", F.col("item_id"))).alias("destino"),
        F.max(F.col("accion") == "reasignar").alias("mover"))
    action = (F.when(F.col("sano"), "proteger").when(F.col("borrar"), "borrar").otherwise("reasignar"))
    plan = h.join(keyed, ["codigo", "clave"]).filter("mover or borrar").select(
        "id", "codigo", action.alias("accion"), F.when(~F.col("sano") & ~F.col("borrar"), F.col("destino")).alias("destino"))
    orphans = j.filter("accion <> 'proteger'").join(h.select("codigo", "clave").distinct(), ["codigo", "clave"], "left_anti")
    return plan, orphans.select("item_id", "codigo", "accion")


def verified_fix(instructions: DataFrame, history: DataFrame) -> DataFrame:
    """Act only where code, supplier fragment and price (+-1) still agree; the rest is reported."""
    return _compared(instructions, history).select("id", "accion", "resultado")


def _compared(instructions: DataFrame, history: DataFrame) -> DataFrame:
    cur = history.select(F.col("id"), F.col("codigo").alias("c_codigo"), F.col("proveedor").alias("c_prov"), F.col("precio").alias("c_precio"))
    x = instructions.join(cur, "id", "left")
    ok = (F.col("c_codigo") == F.col("codigo")) & F.contains(F.upper("c_prov"), F.upper("proveedor")) & (F.abs(F.col("c_precio") - F.col("precio")) < 1)
    status = F.when(F.col("c_codigo").isNull(), "NO EXISTE").when(ok, "APLICAR").otherwise("NO COINCIDE")
    return x.withColumn("resultado", status)


def apply_fix(instructions: DataFrame, history: DataFrame) -> DataFrame:
    """The next snapshot of the history: verified rows are deleted or moved to ``destino``, all others stay.

    Of several verified instructions for a row deleting wins, then the lowest destination.
    """
    what = _compared(instructions, history).groupBy("id").agg(
        F.max(F.col("accion") == "borrar").alias("borra"), F.min("destino").alias("destino"),
        F.max(F.col("resultado") == "APLICAR").alias("aplicar")).filter("aplicar").drop("aplicar")
    x = history.join(what, "id", "left").filter(~F.coalesce("borra", F.lit(False)))
    return x.withColumn("codigo", F.coalesce("destino", "codigo")).select(*history.columns)


def reconcile(target: DataFrame, wanted: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Update if different, insert if absent, keep the rest."""
    t = target.select(*keys, *[F.col(v).alias(f"t_{v}") for v in values], F.lit(True).alias("t_hay"))
    w = wanted.select(*keys, *[F.col(v).alias(f"w_{v}") for v in values], F.lit(True).alias("w_hay"))
    x = t.join(w, keys, "full_outer")
    differs = None
    for v in values:
        d = ~F.col(f"t_{v}").eqNullSafe(F.col(f"w_{v}"))
        differs = d if differs is None else differs | d
    action = F.when(F.col("w_hay").isNull(), "queda").when(F.col("t_hay").isNull(), "insertar").when(differs, "actualizar").otherwise("igual")
    return x.select(*keys, *[F.when(F.col("w_hay").isNull(), F.col(f"t_{v}")).otherwise(F.col(f"w_{v}")).alias(v) for v in values], action.alias("accion"))


def reassign_aliases(aliases: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves(alias_id, denominacion, destino)``: move, delete as duplicate, or skip what is gone."""
    now = aliases.select("alias_id", F.col("codigo").alias("actual"))
    # one row per code and text: another alias is there if the least or the greatest id is another one
    there = aliases.groupBy(F.col("codigo").alias("destino"), "denominacion").agg(F.min("alias_id").alias("menor"), F.max("alias_id").alias("mayor"))
    dup = moves.join(there, ["destino", "denominacion"]).filter("menor <> alias_id or mayor <> alias_id")
    dup = dup.groupBy("alias_id").agg(F.lit(True).alias("duplicado"))
    x = moves.join(now, "alias_id", "left").join(dup, "alias_id", "left")
    action = F.when(F.col("actual").isNull(), "no_existe").when(F.col("duplicado"), "borrar").otherwise("reasignar")
    return x.select("alias_id", "destino", action.alias("accion"))
