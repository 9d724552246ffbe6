"""Small tables and texts that Spark derives from the warehouse tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .views import line_id, quotes, table, with_owner


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Quote lines without the catalogue and supplier columns."""
    return with_line_id(bare_lines(spark, sf))


def bare_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Quote lines without their id. It is written of other columns, so a join that shuffles the lines need not carry it."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("codigo"), F.col("l_suppkey").alias("prov_id"),
        F.col("l_extendedprice").alias("pu"), F.col("l_quantity").alias("cant"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("double").alias("descuento"),
        (F.col("l_tax") > 0).alias("con_iva"),
        F.col("l_shipdate").alias("fecha"), F.year("l_shipdate").alias("anio"),
    )


def with_line_id(rows: DataFrame) -> DataFrame:
    return rows.select(line_id("doc", "line_no", "codigo", "prov_id", "pu", "cant", "fecha").alias("line_id"), *rows.columns)


def materials(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("codigo"), F.col("p_type").alias("rubro"),
        F.concat_ws(" ", "p_name", "p_brand").alias("material"), "p_name", "p_brand", "p_type", "p_size",
    )


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("prov_id"), F.col("s_name").alias("proveedor"), F.col("s_nationkey").alias("zona"),
    )


def owned_quotes(spark: SparkSession, sf: str) -> DataFrame:
    return with_owner(quotes(spark, sf), spark, sf)


def declared_total() -> Column:
    """Line total as printed; one document in 17 prints a wrong one."""
    total = F.floor(F.col("pu") * F.col("cant") * 100 + 0.5) / 100.0
    return F.when(F.col("doc") % 17 == 0, F.floor(total * 1.5 * 100 + 0.5) / 100.0).otherwise(total)
