"""Listings, business metrics and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vocabulary as V
from ..functions.scalars import exact_sum, rnd

# --- fixed values: limits per plan -------------------------------------------
FREE_LIFETIME, BASIC_MONTH, BASIC_FIRST_MONTH_BONUS, UNLIMITED = 1, 6, 2, 999
OCR_COST = 0.02


def quote_listing(quotes: DataFrame, items: DataFrame, newest: int = 100) -> DataFrame:
    """Newest quotes with item count and amount; the limit is the page of the listing."""
    top = quotes.orderBy(F.desc("fecha"), F.desc("id")).limit(newest)
    sums = items.join(top.select("id"), "id", "left_semi").groupBy("id").agg(
        F.count("*").alias("n_items"), exact_sum(F.col("precio") * F.col("cantidad"), 4).alias("t"))
    return top.join(sums, "id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0))).withColumn(
        "total", rnd(F.coalesce("t", F.lit(0.0)))).drop("t")


def grouped_by_project(rows: DataFrame, project: str = "obra") -> DataFrame:
    """Newest first inside each project; rows without one come last."""
    n = rows.groupBy(project).agg(F.count("*").alias("n_obra"))
    x = rows.join(n.select(F.col(project).alias("o"), "n_obra"), F.col(project).eqNullSafe(F.col("o"))).drop("o")
    return x.orderBy(F.asc_nulls_last(project), F.desc("fecha"), "id")


def review_queue(pending: DataFrame, state: str, text: str | None = None, limit: int | None = None) -> DataFrame:
    x = pending.filter(F.col("estado") == state)
    if text:
        needle = F.lit(text.lower())
        x = x.filter(F.contains(F.lower("texto"), needle) | F.contains(F.lower("proveedor"), needle))
    x = x.orderBy(F.desc("fecha"), "id")
    return x.limit(limit) if limit else x


def plan_metrics(users: DataFrame) -> DataFrame:
    """Users by plan in one row: paying users, monthly revenue, revenue per user, conversion."""
    n = users.groupBy("plan").agg(F.count("*").alias("n"))
    price = F.coalesce(*[F.when(F.col("plan") == p, F.lit(v)) for p, v in V.PLAN_PRICES.items()], F.lit(0))
    t = n.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(price > 0, F.col("n"))), F.lit(0)).alias("pagos"), F.sum(F.col("n") * price).alias("mrr"))
    safe = lambda x: F.when(F.col("total") > 0, x).otherwise(0.0)
    return t.select("total", "pagos", "mrr", safe(rnd(F.col("mrr") / F.col("total"))).alias("arpu"), safe(rnd(100.0 * F.col("pagos") / F.col("total"), 1)).alias("conversion_pct"))


def users_per_plan(users: DataFrame) -> DataFrame:
    return users.groupBy("plan").agg(F.count("*").alias("usuarios"))


def catalogue_counts(**tables: DataFrame) -> DataFrame:
    """Number of rows of each named table, as ``(tabla, filas)``."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("filas")).select(F.lit(name).alias("tabla"), "filas")
        out = n if out is None else out.unionByName(n)
    return out


def cumulative_growth(users: DataFrame, when: str) -> DataFrame:
    """Running total of monthly new users; the window runs over one row per month."""
    monthly = users.groupBy(F.date_format(when, "yyyy-MM").alias("mes")).agg(F.count("*").alias("nuevos"))
    w = Window.orderBy("mes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return monthly.withColumn("acumulado", F.sum("nuevos").over(w))


def per_period(events: DataFrame, when: str, fmt: str, amount: Column | None = None) -> DataFrame:
    aggs = [F.count("*").alias("n")]
    if amount is not None:
        aggs.append(exact_sum(amount).alias("monto"))
    return events.groupBy(F.date_format(when, fmt).alias("periodo")).agg(*aggs)


def effective_plan(profiles: DataFrame, now: Column) -> DataFrame:
    """Expired gifts fall to free, a new month resets the counter, the plan sets the limit."""
    month = F.date_format(now, "yyyy-MM")
    gone = (F.col("plan") != "free") & F.col("plan_hasta").isNotNull() & (F.col("plan_hasta") < now)
    x = profiles.withColumn("plan", F.when(gone, "free").otherwise(F.coalesce("plan", F.lit("free"))))
    used = F.when(F.col("mes_usos") == month, F.coalesce("usos_mes", F.lit(0))).otherwise(0)
    x = x.withColumn("usados", F.when(F.col("plan").isin("advance", "pro"), 0).when(F.col("plan") == "basico", used).otherwise(F.coalesce("usos_total", F.lit(0))))
    first = F.date_format("plan_desde", "yyyy-MM") == month
    limit = (F.when(F.col("plan").isin("advance", "pro"), UNLIMITED)
             .when(F.col("plan") == "basico", BASIC_MONTH + F.when(first, BASIC_FIRST_MONTH_BONUS).otherwise(0)).otherwise(FREE_LIFETIME))
    x = x.withColumn("limite", limit)
    return x.withColumn("restantes", F.greatest(F.lit(0), F.col("limite") - F.col("usados")))


def promo_status(codes: DataFrame, uses: DataFrame, now: Column) -> DataFrame:
    n = uses.groupBy("codigo").agg(F.count("*").alias("canjes"))
    x = codes.join(n, "codigo", "left").withColumn("canjes", F.coalesce("canjes", F.lit(0)))
    state = (F.when(~F.col("activo"), "inactivo").when(F.col("vence") < now, "vencido")
             .when(F.col("canjes") >= F.col("tope"), "agotado").otherwise("vigente"))
    return x.withColumn("estado", state)


def children_of(children: DataFrame, parents: DataFrame, key: str, owner: Column) -> DataFrame:
    """Rows whose parent belongs to the owner."""
    return children.join(parents.filter(owner), key, "left_semi")
