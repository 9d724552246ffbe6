"""Quote views over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_id(doc="l_orderkey", line_no="l_linenumber", codigo="l_partkey", prov_id="l_suppkey", pu="l_extendedprice", cant="l_quantity", fecha="l_shipdate") -> "F.Column":
    """Identity of a quote line; (order, line number) alone repeats."""
    return F.concat_ws(
        "-",
        F.col(doc), F.col(line_no), F.col(codigo), F.col(prov_id),
        F.floor(F.col(pu) * 100 + 0.5), F.floor(F.col(cant)),
        F.date_format(fecha, "yyyyMMdd"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per quote line with its catalogue item and supplier."""
    line = table(spark, sf_dir, "lineitem").select(
        line_id().alias("line_id"),
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("codigo"), F.col("l_suppkey").alias("prov_id"),
        F.col("l_extendedprice").alias("pu"), F.col("l_quantity").alias("cant"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("double").alias("descuento"),
        (F.col("l_tax") > 0).alias("con_iva"),
        F.col("l_shipdate").alias("fecha"), F.year("l_shipdate").alias("anio"),
    )
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("codigo"), F.col("p_type").alias("rubro"),
        F.concat_ws(" ", "p_name", "p_brand").alias("material"),
        "p_name", "p_brand", "p_size",
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("prov_id"), F.col("s_name").alias("proveedor"), F.col("s_nationkey").alias("zona"),
    )
    return line.join(part, "codigo").join(supplier, "prov_id")


def with_owner(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("doc_fecha"), F.col("o_orderstatus").alias("estado"),
    )
    return df.join(orders, "doc")


# "last line wins" and every tie end in this order
LINE_ORDER = ("fecha", "doc", "line_no", "codigo", "prov_id", "pu", "cant")


def line_seq() -> "F.Column":
    return F.struct(*[F.col(c) for c in LINE_ORDER])
