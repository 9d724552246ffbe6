"""Learning loop: keyed merges that give a new snapshot from an old one and a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions import textnorm as T
from .keyed import KeyedTable


def upsert(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or update by key. ``batch`` may repeat a key; its largest ``seq`` wins."""
    values = [c for c in target.columns if c not in keys]
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*values), "seq").alias("n"))
    old = target.select(*keys, F.struct(*values).alias("v"))
    x = old.join(last, keys, "full_outer")
    picked = F.coalesce("n", "v")
    return x.select(*keys, *[picked[v].alias(v) for v in values])


def count_confirmations(confirmations: DataFrame) -> DataFrame:
    """Confirmations per alias, with the first supplier: ``(codigo, denominacion, veces, primera)``."""
    return confirmations.withColumn("denominacion", F.lower(F.trim("desc_prov"))).groupBy("codigo", "denominacion").agg(
        F.count("*").alias("veces"), F.min(F.struct("seq", "proveedor")).alias("primera"))


def confirm_aliases(aliases: DataFrame, confirmations: DataFrame, rules=None) -> DataFrame:
    """Fold a batch of confirmations into the alias table."""
    return fold_counts(aliases, count_confirmations(confirmations), rules)


def fold_counts(aliases: DataFrame, counts: DataFrame, rules=None) -> DataFrame:
    """The alias table after the counts of one or more batches.

    A known alias gains one per confirmation and min(99, 80+freq) confidence; a new
    one needs a word of four letters and starts at 80. Counting the batch first
    removes the lost updates of one-by-one writes.
    """
    b = counts.groupBy("codigo", "denominacion").agg(F.sum("veces").alias("veces"), F.min("primera").alias("primera"))
    b = b.select("codigo", "denominacion", "veces", F.col("primera.proveedor").alias("proveedor"))
    old = aliases.select("codigo", "denominacion", F.coalesce("frecuencia", F.lit(1)).alias("frecuencia"), "confianza", "origen", F.lit(True).alias("hay"))
    x = old.join(b, ["codigo", "denominacion"], "full_outer")
    fresh = T.with_prepared(x.filter("hay is null").select("denominacion").distinct(), "denominacion", "norm", rules)
    good = fresh.filter(T.has_word(F.col("norm"), 4)).select("denominacion", F.lit(True).alias("palabra"))
    x = x.join(good, "denominacion", "left").filter("hay or palabra")
    # a new alias is inserted by its first confirmation, the others count up
    freq = F.when(F.col("hay"), F.col("frecuencia") + F.coalesce("veces", F.lit(0))).otherwise(F.col("veces"))
    x = x.withColumn("f", freq)
    conf = (F.when(F.col("veces").isNull(), F.col("confianza")).when(F.col("hay").isNull() & (F.col("veces") == 1), 80)
            .otherwise(F.least(F.lit(99), 80 + F.col("f"))))
    origin = F.coalesce("origen", F.concat(F.lit("usuario_"), F.replace(F.lower("proveedor"), F.lit(" "), F.lit("_"))))
    return x.select("codigo", "denominacion", F.col("f").cast("bigint").alias("frecuencia"), conf.cast("int").alias("confianza"), origin.alias("origen"))


ALIASES = StructType([StructField("codigo", LongType()), StructField("denominacion", StringType()), StructField("frecuencia", LongType()),
                      StructField("confianza", IntegerType()), StructField("origen", StringType())])


def alias_store(spark, root: str, buckets: int = 64, code=None) -> KeyedTable:
    """The alias table in buckets of its text, the widest of its keys."""
    schema = StructType([StructField("codigo", code or LongType()), *ALIASES.fields[1:]])
    return KeyedTable(spark, root, schema, ("denominacion",), buckets)


def learn_into(aliases: KeyedTable, confirmations: DataFrame, lote: int, rules=None) -> list[int]:
    """Fold batch ``lote`` of confirmations into a stored alias table; the buckets written."""
    return aliases.merge(count_confirmations(confirmations), lambda old, counts: fold_counts(old, counts, rules), lote)


def upsert_into(target: KeyedTable, batch: DataFrame, keys: list[str], lote: int) -> list[int]:
    """:func:`upsert` into a stored table that is bucketed by columns of ``keys``; the buckets written."""
    return target.merge(batch, lambda old, new: upsert(old, new, keys), lote)


def confirm_lines(items: DataFrame, confirmations: DataFrame) -> DataFrame:
    """A confirmed line takes the user's code and state; the last confirmation wins."""
    c = confirmations.groupBy("line_id").agg(F.max_by("codigo", "seq").alias("nuevo"))
    x = items.join(c, "line_id", "left")
    hit = F.col("nuevo").isNotNull()
    return x.select(
        "line_id", F.coalesce("nuevo", "codigo").alias("codigo"), F.when(hit, "CONFIRMADO").otherwise(F.col("estado")).alias("estado"),
        F.when(hit, "usuario").otherwise(F.col("origen")).alias("origen"))


def pending_id(line_id: Column) -> Column:
    """Same line, same id: a repeated run creates nothing twice."""
    return F.sha2(line_id, 256)


def open_pending(unmatched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unmatched lines to review rows and their linked price rows."""
    u = unmatched.withColumn("id", pending_id(F.col("line_id")))
    pending = u.select("id", F.trim("texto").alias("descripcion_original"), F.lower(F.trim("texto")).alias("descripcion_normalizada"),
                       "proveedor", F.col("precio").alias("precio_visto"), F.lit("PENDIENTE").alias("estado"))
    prices = u.select(F.col("id").alias("codigo_pendiente"), "proveedor", "precio", F.lit("UN").alias("unidad"), F.lit("pipeline").alias("origen"))
    return pending, prices


def resolve_pending(pending: DataFrame, prices: DataFrame, aliases: DataFrame, decisions: DataFrame,
                    confidence: int = 95, origin: str = "admin_validacion") -> tuple[DataFrame, DataFrame, DataFrame]:
    """linkear / rechazar / crear: new review rows, re-pointed prices, aliases to add.

    ``decisions(id, accion, codigo)``.
    """
    d = decisions.select("id", "accion", F.col("codigo").alias("asignado"))
    x = pending.join(d, "id", "left")
    link = (F.col("accion") == "linkear") & F.col("asignado").isNotNull()
    state = F.when(link | (F.col("accion") == "crear"), "VALIDADO").when(F.col("accion") == "rechazar", "RECHAZADO").otherwise(F.col("estado"))
    reviewed = x.select("id", "descripcion_normalizada", state.alias("estado"), F.when(link, F.col("asignado")).alias("codigo_asignado"))
    linked = d.filter("accion = 'linkear' and asignado is not null")
    moved = prices.join(linked.select(F.col("id").alias("codigo_pendiente"), "asignado"), "codigo_pendiente", "left").select(
        F.col("asignado").alias("codigo"), F.when(F.col("asignado").isNull(), F.col("codigo_pendiente")).alias("codigo_pendiente"), "precio")
    texts = pending.join(linked.select("id", "asignado"), "id").groupBy(F.col("asignado").alias("codigo"), F.col("descripcion_normalizada").alias("denominacion")).agg(
        F.count("*").alias("frecuencia"))
    fresh = texts.join(aliases.select("codigo", "denominacion"), ["codigo", "denominacion"], "left_anti").withColumn(
        "confianza", F.lit(confidence)).withColumn("origen", F.lit(origin))
    return reviewed, moved, fresh


def curate_batch(plan: DataFrame, aliases: DataFrame) -> DataFrame:
    """Batch decisions ``(texto, codigo, n_ids)`` to new aliases (confidence 96) or duplicates."""
    p = plan.groupBy("codigo", F.lower(F.trim("texto")).alias("denominacion")).agg(F.sum("n_ids").alias("frecuencia"))
    known = aliases.select("codigo", "denominacion").distinct().withColumn("hay", F.lit(True))
    return p.join(known, ["codigo", "denominacion"], "left").select(
        "codigo", "denominacion", "frecuencia", F.lit(96).alias("confianza"), F.when(F.col("hay"), "duplicado").otherwise("nuevo").alias("accion"))


def absorb_codes(aliases: DataFrame, merges: DataFrame) -> DataFrame:
    """Duplicate codes give their aliases to the survivor; equal texts become one."""
    x = aliases.join(merges.select(F.col("absorbido").alias("codigo"), "sobrevive"), "codigo", "left")
    x = x.withColumn("codigo", F.coalesce("sobrevive", "codigo"))
    return x.groupBy("codigo", "denominacion").agg(F.sum("frecuencia").alias("frecuencia"), F.max("confianza").alias("confianza"))


def absorb_rows(rows: DataFrame, merges: DataFrame, code: str = "codigo") -> DataFrame:
    """Prices or quote lines of an absorbed code move to the survivor; all other columns stay."""
    x = rows.join(merges.select(F.col("absorbido").alias(code), "sobrevive"), code, "left")
    return x.withColumn(code, F.coalesce("sobrevive", code)).select(*rows.columns)


def remember_pairs(memory: DataFrame, links: DataFrame) -> DataFrame:
    """(user, supplier, text): frequency up by each use, last concept name kept."""
    keys = ["user_id", "prov_id", "texto"]
    b = links.filter("texto <> ''").groupBy(*keys).agg(F.count("*").alias("veces"), F.max_by("nombre", "seq").alias("nuevo"))
    x = memory.join(b, keys, "full_outer")
    return x.select(*keys, (F.coalesce("frecuencia", F.lit(0)) + F.coalesce("veces", F.lit(0))).alias("frecuencia"), F.coalesce("nuevo", "nombre").alias("nombre"))
