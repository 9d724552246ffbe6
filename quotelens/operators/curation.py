"""Batch curation of review rows: keys, decisions and the aliases they teach."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import textnorm as T
from .learn import curate_batch
from .linkage import resolve_keys


def curate_pending(pending: DataFrame, decisions: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Batch curation as one job: review rows after the decisions, aliases to add, and decisions that fit no review row.

    ``pending(id, descripcion_original, orden)``, ``decisions(texto, codigo, rechazar, orden)``. A decision's key finds the equal
    key of a review row, or else the earliest one that begins with it or that it begins with. Of several decisions on a
    row a rejection wins, then the last.
    """
    p = pending.withColumn("kk", T.match_key(F.col("descripcion_original")))
    d = decisions.withColumn("k", T.match_key(F.col("texto")))
    found = resolve_keys(d.select("k"), p.select("kk", F.col("orden").alias("pos")))
    hits = d.join(found, "k")
    won = hits.groupBy("kk").agg(F.max_by(F.struct("rechazar", "codigo"), F.struct("rechazar", "orden")).alias("v"))
    state = F.when(F.col("v").isNull(), "PENDIENTE").when(F.col("v.rechazar"), "RECHAZADO").otherwise("VALIDADO")
    reviewed = p.join(won, "kk", "left").select("id", state.alias("estado"), F.when(~F.col("v.rechazar"), F.col("v.codigo")).alias("codigo_asignado"))
    ids = p.groupBy("kk").agg(F.count("*").alias("n_ids"))
    plan = hits.filter("not rechazar").join(ids, "kk").select("texto", "codigo", "n_ids")
    return reviewed, curate_batch(plan, aliases), d.join(found, "k", "left_anti").select("texto", "codigo", "rechazar")
