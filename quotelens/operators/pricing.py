"""Net prices, currency, consistency guards and price repairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import rnd

VAT = 1.105


def vat_factor(con_iva: Column) -> Column:
    """A missing flag means the price carries VAT."""
    return F.when(F.coalesce(con_iva, F.lit(True)), F.lit(VAT)).otherwise(F.lit(1.0))


def clamp_discount(raw: Column) -> Column:
    """Discount 0-100; text that is no number counts as none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(raw.try_cast("double"), F.lit(0.0))))


def net_price(pu: Column, factor: Column, discount: Column) -> Column:
    return rnd(pu / factor * (1 - discount / 100.0))


def shown_price(net: Column, view_with_vat: bool, con_iva: Column, discount: float = 0.0) -> Column:
    vat = F.lit(VAT) if view_with_vat else F.when(con_iva, F.lit(VAT)).otherwise(F.lit(1.0))
    return rnd(net * vat * F.lit(1.0 - discount / 100.0))


def with_net(lines: DataFrame) -> DataFrame:
    return lines.withColumn("neto", net_price(F.col("pu"), vat_factor(F.col("con_iva")), F.col("descuento")))


def net_by_supplier(lines: DataFrame, config: DataFrame) -> DataFrame:
    """``config(proveedor, factor_iva, descuento_cfg)``; defaults 1.105 and 0."""
    joined = lines.join(config, "proveedor", "left")
    factor = F.coalesce(F.col("factor_iva"), F.lit(VAT))
    discount = F.coalesce(F.col("descuento_cfg"), F.lit(0.0))
    return joined.withColumn("precio_sin_iva", net_price(F.col("pu"), factor, discount))


def reprice_saved(lines: DataFrame, overrides: DataFrame) -> DataFrame:
    """Undo a document's own VAT/discount, then apply the override where there is one."""
    gross = F.col("neto") * vat_factor(F.col("con_iva"))
    gross = F.when((F.col("descuento") > 0) & (F.col("descuento") < 100), gross / (1 - F.col("descuento") / 100.0)).otherwise(gross)
    con_iva = F.coalesce(F.col("con_iva_nuevo"), F.col("con_iva"))
    discount = F.coalesce(F.col("descuento_nuevo"), F.col("descuento"))
    return (
        lines.join(overrides, "doc", "left")
        .withColumn("bruto", rnd(gross))
        .withColumn("precio", net_price(gross, vat_factor(con_iva), discount))
        .withColumn("con_iva", con_iva)
        .drop("con_iva_nuevo", "descuento_nuevo")
    )


def rate_cells(rates: DataFrame, wanted: DataFrame, seconds: int) -> DataFrame:
    """``(moneda, celda, propias, antes)`` for each ``(moneda, celda)`` of `wanted`: the rates inside that stretch of time
    in order, and the last rate before it.

    Stretches without rates are never spelled out. The window runs over one row per currency and stretch that occurs.
    """
    # of several rates of one moment the highest counts
    moments = rates.filter("fecha is not null and venta is not null").groupBy("moneda", F.col("fecha").cast("timestamp").alias("desde")).agg(
        F.max("venta").alias("venta"))
    own = moments.withColumn("celda", time_cell(F.col("desde"), seconds)).groupBy("moneda", "celda").agg(
        F.sort_array(F.collect_list(F.struct("desde", "venta"))).alias("propias"))
    both = wanted.select("moneda", "celda").distinct().withColumn("pedida", F.lit(True)).join(own, ["moneda", "celda"], "full_outer")
    earlier = Window.partitionBy("moneda").orderBy("celda").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("antes", F.last(F.element_at("propias", -1)["venta"], ignorenulls=True).over(earlier))
    return carried.filter("pedida").select("moneda", "celda", "propias", "antes")


def time_cell(moment: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(moment) / seconds)


def convert_currency(lines: DataFrame, rates: DataFrame, base: str = "ARS", seconds: int = 3600) -> DataFrame:
    """As-of conversion with the last rate at or before the line's moment; dates count as their midnight. A foreign line
    without a rate or a date keeps a null price and is flagged. A null currency is `base`. Rates without a moment or a value don't count.

    Lines meet the rates of their own stretch of `seconds` by equality, which carries the last earlier rate, so rates may come by the
    minute and a busy stretch is split like any skewed join: the side of the rates has one row a stretch.
    """
    lines = lines.withColumn("moneda", F.coalesce("moneda", F.lit(base)))
    at = F.col("fecha").cast("timestamp")
    keyed = lines.withColumn("celda", time_cell(at, seconds))
    cells = rate_cells(rates, keyed.filter((F.col("moneda") != base) & F.col("celda").isNotNull()), seconds)
    priced = keyed.join(cells, ["moneda", "celda"], "left")
    inside = F.filter("propias", lambda r: r["desde"] <= at)
    priced = priced.withColumn("venta", F.coalesce(F.try_element_at(inside, F.lit(-1))["venta"], F.col("antes")))
    home = F.col("moneda") == base
    return priced.select(
        *lines.columns,
        F.when(home, F.lit(None)).otherwise(F.col("venta")).alias("tc"),
        F.when(home, F.col("pu")).otherwise(rnd(F.col("pu") * F.col("venta"), 4)).alias("pu_ars"),
        F.when(home | F.col("venta").isNotNull(), "OK").otherwise("SIN_TC").alias("estado_tc"),
    )


def suspicious(pu: Column, cant: Column, total: Column) -> Column:
    return (total > 0) & (F.abs(pu * cant - total) > F.greatest(F.lit(1.0), 0.01 * total))


def price_bucket(price: Column) -> Column:
    """Buckets wide enough that a band of max(1, 2 %) touches at most the next one."""
    steep = 50 + F.floor(F.log(price / 50.0) / F.lit(0.0205))
    return F.when(price < 50, F.floor(price)).otherwise(steep)


def screw_backfill(history: DataFrame, items: DataFrame, factors: DataFrame,
                   unit_limit: float = 100.0, box_limit: float = 100_000.0) -> DataFrame:
    """Bring box prices to unit prices, recovering the text by code and price band.

    Only the first item text per (code, price) can ever be chosen, so both sides
    shrink to distinct prices before the band join.
    """
    first_text = items.groupBy("codigo", F.col("precio").alias("precio_item")).agg(
        F.min(F.struct("orden", "texto")).alias("hit")
    ).withColumn("bucket", price_bucket(F.col("precio_item")))
    wanted = history.join(factors, "codigo", "left_semi").filter(F.col("precio") >= unit_limit).select("codigo", "precio").distinct()
    probes = wanted.withColumn("bucket", F.explode(F.array(*[price_bucket(F.col("precio")) + d for d in (-1, 0, 1)])))
    band = F.abs(F.col("precio_item") - F.col("precio")) < F.greatest(F.lit(1.0), F.col("precio") * 0.02)
    texts = (
        probes.join(first_text, ["codigo", "bucket"]).filter(band)
        .groupBy("codigo", "precio").agg(F.min("hit").alias("hit"))
        .select("codigo", "precio", F.col("hit.texto").alias("texto"))
    )
    out = history.join(factors, "codigo").join(texts, ["codigo", "precio"], "left")
    digits = lambda c: F.regexp_replace(c, "[.,]", "").cast("long")
    pack_unit = digits(F.nullif(F.regexp_extract(F.lower("unidad"), r"caja\s*(\d[\d.,]*)", 1), F.lit("")))
    packs = F.filter(
        F.transform(F.regexp_extract_all(F.coalesce("texto", F.lit("")), F.lit(r"[xX]\s*(\d{1,3}(?:[.,]\d{3})+|\d{2,})"), 1), digits),
        lambda n: n >= 100,
    )
    pack = F.coalesce(F.nullif(pack_unit, F.lit(0)), F.array_max(packs),
                      F.when(F.col("precio") > box_limit, F.col("factor").cast("long")))
    action = (F.when(F.col("precio") < unit_limit, "KEEP").when(F.col("pack").isNotNull(), "CONVERT").otherwise("DELETE"))
    return out.withColumn("pack", F.when(F.col("precio") >= unit_limit, pack)).withColumn("accion", action).withColumn(
        "precio_unidad",
        F.when(F.col("accion") == "KEEP", F.col("precio")).when(F.col("accion") == "CONVERT", rnd(F.col("precio") / F.col("pack"), 4)),
    )


def repair_fraction(precio: Column, cant: Column) -> tuple[Column, Column]:
    broken = (cant > 0) & (cant < 1)
    return F.when(broken, rnd(precio * cant, 4)).otherwise(precio), F.when(broken, F.lit(1.0)).otherwise(cant)


def total_as_unit_price(items: DataFrame, tol: float = 0.005, steps: int = 16, crowd: int = 16) -> DataFrame:
    """Lines whose unit price is really the net line total of a twin line.

    ``items(id, texto, precio, cant)``. The test looks at (quantity, text, price) only, so copies collapse first. Prices lie
    on a grid of `steps` cells per tolerance. Of a cell with more than `crowd` prices of one item only the least twin counts
    where the cell lies inside the band as a whole, so however many prices one item has, a line meets a bounded number of rows;
    the prices of such a cell are compared one by one only at the band's two ends.

    A line is shuffled once as the bad one and once as the good one, by quantity, first letters and stretch of prices; a good
    line goes to every stretch its total's band reaches. Only lines with copies and bands that end in a crowded cell are shuffled again.
    """
    width = math.log1p(tol) / steps
    cell = lambda c: F.floor(F.log(c) / F.lit(width))
    wide = 8 * steps
    # below this quantity the net total is under the unit price
    ratio = F.col("cant") / F.lit(VAT)
    shape = items.select("id", "cant", "precio", F.regexp_replace(F.lower("texto"), r"\s+", "").alias("clave")).filter(
        (F.col("precio") > 0) & (F.col("cant") > 0) & (F.length("clave") >= 8) & (ratio > 1 - 2 * tol))
    # as text: joins and groups rewrite numbers with a fraction, and rows shuffled by the number itself would be shuffled anew
    place = lambda c: F.concat_ws(" ", F.col("cant").cast("string"), F.substring("clave", 1, 8), F.floor(cell(c) / wide).cast("string"))
    same = ["lugar", "cant", "clave", "precio"]
    expected, hair = F.col("precio") * F.col("cant") / F.lit(VAT), 1e-11
    reach = F.array_distinct(F.array(place(expected * (1 - tol - hair)), place(expected * (1 + tol + hair))))
    good = shape.withColumn("lugar", F.explode(reach)).repartition("lugar").groupBy(*same).agg(F.min("id").alias("id_par"))
    # where a total may also lie under its unit price, every price keeps a row of its own
    close = F.when(ratio < 1 + 2 * tol, F.col("precio")).otherwise(0.0)
    # every use of the good lines tests `f`; tested here for all, they share one shuffle
    good = good.withColumns({"esperado": expected, "f": cell(expected), "solo": close}).filter("f is not null")
    in_cell = Window.partitionBy("lugar", "clave", "f", "solo").orderBy("id_par", "precio")
    good = good.withColumns({
        "n": F.count("*").over(in_cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "puesto": F.row_number().over(in_cell)})
    crowded, first = F.col("n") > crowd, F.col("puesto") == 1
    # the ends of the band a little further out and in, so that rounding cannot put a price on the wrong side
    low, high = F.col("precio") / (1 + tol), F.col("precio") / (1 - tol)
    lines = shape.withColumn("lugar", place(F.col("precio"))).repartition("lugar")
    bad = lines.groupBy(*same).agg(F.min("id").alias("id"), F.count("*").alias("copias")).select(
        "lugar", "id", "copias", F.col("clave").alias("c_clave"), F.col("precio").alias("c_precio"),
        cell(low * (1 - hair)).alias("f0"), cell(low * (1 + hair)).alias("f1"), cell(high * (1 - hair)).alias("f2"), cell(high * (1 + hair)).alias("f3"))
    prefix = F.startswith("clave", "c_clave") | F.startswith("c_clave", "clave")
    fits = (F.col("c_precio") > F.col("precio")) & (F.abs(F.col("c_precio") - F.col("esperado")) / F.col("esperado") < tol)
    inside = (F.col("f") > F.col("f1")) & (F.col("f") < F.col("f2"))
    met = bad.join(good.filter(~crowded | first), "lugar").filter(prefix & F.when(crowded, inside).otherwise(fits))
    ends = bad.join(good.filter(crowded & first).select("lugar", "cant", "clave", "f"), "lugar").filter(
        prefix & F.col("f").isin(*[F.col(c) for c in ("f0", "f1", "f2", "f3")]))
    at_ends = ends.join(good.filter(crowded).drop("cant"), ["lugar", "clave", "f"]).filter(fits).repartition("lugar")
    columns = ["lugar", "cant", "id", "copias", F.col("c_clave").alias("clave"), F.col("c_precio").alias("precio_malo"),
               F.struct("id_par", F.col("precio").alias("precio_bueno")).alias("par")]
    found = met.select(*columns).unionByName(at_ends.select(*columns)).groupBy("lugar", "cant", "id", "copias", "clave", "precio_malo").agg(F.min("par").alias("par"))
    copies = lines.withColumn("copias", F.count("*").over(Window.partitionBy(*same))).filter("copias > 1").select(
        "lugar", "cant", "id", "clave", F.col("precio").alias("precio_malo"))
    each = found.filter("copias = 1").drop("copias").unionByName(
        copies.join(found.filter("copias > 1").drop("copias", "id"), ["lugar", "cant", "clave", "precio_malo"]))
    return each.select(
        "id", "cant", "precio_malo", F.col("par.precio_bueno").alias("precio_bueno"), F.col("par.id_par").alias("id_par"),
        rnd(F.col("par.precio_bueno") * F.col("cant") / F.lit(VAT)).alias("esperado"),
    )
