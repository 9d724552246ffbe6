"""Catalogue, alias and equivalence loads; sinks and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut, shuffled
from .learn import upsert


def last_record(records: DataFrame, key: str, seq: Column) -> DataFrame:
    """The last record of a key wins."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("u")).select(key, "u.*")


def material_rows(records: DataFrame) -> DataFrame:
    """``records(codigo, rubro, item, detalle, unidad, marca)`` to catalogue rows."""
    t = lambda c: F.trim(F.coalesce(c, F.lit("")))
    unit = F.when(t("unidad") == "", "UNIDAD").otherwise(t("unidad"))
    return records.select(
        "codigo", t("rubro").alias("categoria"), t("item").alias("denominacion_principal"), t("detalle").alias("descripcion"),
        F.array(F.struct(unit.alias("unidad"), F.lit("unidad base").alias("descripcion"), F.lit(1.0).alias("equivalencia"))).alias("unidades_posibles"),
        F.when(t("marca") != "", F.array(t("marca"))).otherwise(F.array().cast("array<string>")).alias("marcas_disponibles"),
        F.lit("migracion_inicial").alias("validado_por"))


def first_aliases(records: DataFrame) -> DataFrame:
    """Two aliases per material, item and detail where it differs; one per (code, text)."""
    item, detail = F.lower(F.trim(F.coalesce("item", F.lit("")))), F.lower(F.trim(F.coalesce("detalle", F.lit(""))))
    pair = F.array(F.struct(item.alias("denominacion"), F.lit("migracion_item").alias("origen")),
                   F.struct(F.when(detail != item, detail).alias("denominacion"), F.lit("migracion_detalle").alias("origen")))
    x = records.select("codigo", F.explode(pair).alias("a")).select("codigo", "a.*").filter("denominacion <> ''")
    return x.groupBy("codigo", "denominacion").agg(F.max("origen").alias("origen")).withColumn("confianza", F.lit(90))


def import_equivalences(rows: DataFrame, catalogue: DataFrame, confidence: int = 95) -> tuple[DataFrame, DataFrame]:
    """``rows(codigo, desc, proveedor, seq)``: aliases whose code exists, and why the others were left out."""
    x = rows.withColumn("denominacion", F.lower(F.trim("desc")))
    empty = F.col("codigo").isNull() | (F.coalesce("denominacion", F.lit("")) == "")
    known = catalogue.select("codigo").distinct()
    # rows without a code would all meet in one task of a join
    named = x.filter(~empty)
    origin = F.when(F.coalesce("proveedor", F.lit("")) != "", F.concat(F.lit("equivalencias_"), F.replace(F.lower("proveedor"), F.lit(" "), F.lit("_")))).otherwise("equivalencias_historico")
    good = shuffled(named).join(known, "codigo", "left_semi").groupBy("codigo", "denominacion").agg(F.min_by(origin, "seq").alias("origen")).withColumn("confianza", F.lit(confidence))
    codes = x.groupBy(F.when(~empty, F.col("codigo")).alias("codigo")).agg(F.count("*").alias("n")).join(known.withColumn("hay", F.lit(True)), "codigo", "left")
    reason = F.when(F.col("codigo").isNull(), "vacio").when(F.col("hay").isNull(), "sin_codigo").otherwise("entra")
    return good, codes.groupBy(reason.alias("motivo")).agg(F.sum("n").alias("n"))


def effective_code() -> Column:
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(filled("cod_correcto"), filled("cod_propuesto"), F.lit(""))


def numbered(df: DataFrame, *order: str, out: str = "n") -> DataFrame:
    """Consecutive numbers over the whole table in the given order, without sorting it in one task.

    Rows are dealt out by ranges of the order and written once; a range starts where the earlier ones end.
    """
    x = df.repartitionByRange(*order).sortWithinPartitions(*order)
    x = cut(x.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)))
    sizes = x.groupBy("_p").agg(F.count("*").alias("c"))
    starts = sizes.select("_p", (F.sum("c").over(Window.orderBy("_p")) - F.col("c")).alias("antes"))
    return x.join(starts, "_p").withColumn(out, F.col("antes") + F.col("_i") + 1).drop("_p", "_i", "antes")


def consolidate(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """Append accepted decisions that are new by text and effective code; existing rows keep theirs.

    Both carry desc, decision, cod_propuesto, cod_correcto, seq.
    """
    keyed = lambda df: df.withColumn("clave", F.concat_ws("|", F.upper(F.trim("desc")), effective_code()))
    cols = ["clave", "desc", "decision", "cod_propuesto", "cod_correcto", "seq"]
    old = keyed(existing).select(*cols)
    new = keyed(drafts.filter(F.upper(F.trim("decision")).isin("CARGAR", "CAMBIAR") & (F.trim("desc") != "")))
    new = new.groupBy("clave").agg(F.min_by(F.struct(*cols[1:]), "seq").alias("u")).select("clave", "u.*")
    fresh = new.join(old.select("clave"), "clave", "left_anti")
    return old.withColumn("nueva", F.lit(False)).unionByName(fresh.withColumn("nueva", F.lit(True)))


def prefix_histogram(rows: DataFrame) -> DataFrame:
    x = rows.filter((F.col("decision") == "CARGAR") & (effective_code() != ""))
    return x.groupBy(F.substring(effective_code(), 1, 4).alias("prefijo")).agg(F.count("*").alias("n"))


def seed_equivalences(target: DataFrame, decisions: DataFrame, catalogue: DataFrame, item: str = "cod_int") -> DataFrame:
    """CARGAR rows, supplier from the file name, item name looked up by ``item``, upsert on (cod_prov, proveedor).

    ``item`` is unique in the catalogue; name another column where printed codes are cut short and several items share one.
    """
    supplier = F.trim(F.replace(F.element_at(F.split("fuente", "_"), 1), F.lit(".xlsx"), F.lit("")))
    x = decisions.filter("decision = 'CARGAR'").withColumn("cod_int", effective_code()).filter("cod_int <> ''")
    x = x.withColumn("proveedor", F.when(supplier == "", "UNKNOWN").otherwise(supplier)).join(catalogue.select(item, "item_int"), item, "left")
    batch = x.select("cod_prov", "proveedor", "cod_int", F.coalesce("item_int", F.lit("")).alias("item_int"), F.lit("auto").alias("fuente"), F.lit(85).alias("confianza"), "seq")
    return upsert(target, batch, ["cod_prov", "proveedor"])


def equivalence_map(stored: DataFrame, decisions: DataFrame, loads: DataFrame) -> DataFrame:
    """Three sources, later ones override: ``(clave, cod, seq)`` each; decisions bring decision, cod_propuesto, cod_correcto."""
    code = F.when(F.col("decision") == "CARGAR", effective_code()).when(F.col("decision") == "CAMBIAR", F.trim("cod_correcto"))
    parts = [stored.select("clave", "cod", "seq"), decisions.select("clave", code.alias("cod"), "seq"), loads.select("clave", "cod", "seq")]
    every = None
    for prio, p in enumerate(parts):
        p = p.select(F.trim("clave").alias("clave"), F.trim("cod").alias("cod"), "seq", F.lit(prio).alias("prio")).filter("clave <> '' and cod <> ''")
        every = p if every is None else every.unionByName(p)
    return every.groupBy("clave").agg(F.max_by("cod", F.struct("prio", "seq")).alias("cod"))


def seed_suppliers(existing: DataFrame, *sources: DataFrame) -> DataFrame:
    """Distinct trimmed names of all sources that are not there yet."""
    names = None
    for s in sources:
        n = s.select(F.trim("proveedor").alias("nombre")).filter("nombre <> ''")
        names = n if names is None else names.unionByName(n)
    return names.distinct().join(existing.select("nombre"), "nombre", "left_anti")


def latest_uploads(uploads: DataFrame, keys=("user_id", "archivo", "proveedor")) -> DataFrame:
    """The newest analysis of a file replaces earlier ones but keeps the first id."""
    return uploads.groupBy(*keys).agg(F.max_by("id", F.struct("fecha", "id")).alias("vigente"), F.min_by("id", F.struct("fecha", "id")).alias("id"))


def price_rows(routed: DataFrame) -> DataFrame:
    """Automatic matches as history rows with the raw price and unit."""
    return routed.filter("estado = 'MATCH'").select(
        "line_id", "proveedor", F.col("codigo_match").alias("codigo"), F.coalesce("unidad", F.lit("UN")).alias("unidad"), "precio",
        F.greatest(F.lit(1), F.round("cant")).cast("int").alias("cantidad"), F.round("pu", 4).alias("precio_raw"),
        F.coalesce("moneda", F.lit("ARS")).alias("moneda"), F.col("texto").alias("texto_original"), F.lit("pipeline").alias("origen"))


def append_prices(rows: DataFrame, path: str, run: str) -> None:
    """Each run owns a folder, so running it again writes the same rows and doubles none."""
    rows.write.mode("overwrite").partitionBy("origen").parquet(f"{path}/corrida={run}")


def summary_row(rows: DataFrame, *by: str) -> DataFrame:
    """Counts and saving of a comparison; the rows themselves stay in the long table."""
    from .compare import summary

    return summary(rows, *by)


def payload_rows(rows: DataFrame) -> DataFrame:
    return rows.select("codigo", F.to_json(F.struct(*rows.columns)).alias("datos_json"))


def keep_recent(df: DataFrame, when: str, now: Column, hours: int = 48) -> DataFrame:
    return df.filter(F.col(when) >= now - F.expr(f"INTERVAL {hours} HOURS"))


def export_snapshot(tables: dict[str, DataFrame], root: str, day: str) -> DataFrame:
    """Every table as JSON under root/day, and a manifest of row counts; a failed table makes the export fail at the end."""
    spark = next(iter(tables.values())).sparkSession
    found = []
    for name, df in tables.items():
        target = f"{root}/{day}/{name}"
        try:
            df.write.mode("errorifexists").json(target)
            found.append((name, spark.read.schema(df.schema).json(target).count(), None))
        except Exception as err:  # the manifest records it and the others go on
            found.append((name, None, type(err).__name__))
    manifest = spark.createDataFrame(found, "tabla string, filas bigint, error string")
    manifest.coalesce(1).write.mode("append").json(f"{root}/{day}/_manifest")
    if any(e for _, _, e in found):
        raise RuntimeError(f"partial snapshot: {[n for n, _, e in found if e]}")
    return manifest
