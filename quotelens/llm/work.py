"""Intermediate tables that several later steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from quotelens.session import checkpoint_root


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and read it back.

    Lost executors read it again instead of repeating what made it. Each call owns a folder; the owner of the checkpoint
    folder clears it.
    """
    path = f"{checkpoint_root(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
