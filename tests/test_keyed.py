"""Keyed tables: what a batch writes, and what a replay changes."""

import os

from pyspark.sql import functions as F

from quotelens.operators import learn as L
from quotelens.operators.keyed import KeyedTable, latest


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_a_batch_writes_the_buckets_of_its_keys(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.lit(0).cast("long").alias("seq"))
    store = KeyedTable(spark, str(tmp_path / "t"), rows.schema, ("k",), 32)
    fold = latest(("k",), "seq")
    assert len(store.merge(rows, fold, 0)) == 32
    before = files(store.path)
    few = spark.createDataFrame([(5, 100, 1), (6, 100, -1), (50_000, 1, 1), (5, 99, 0)], rows.schema)
    touched = store.merge(few, fold, 1)
    after = files(store.path)
    assert len(touched) <= 3 and sum(f not in before for f in after) <= 3 and sum(f not in after for f in before) <= 3
    sizes = lambda names: sum(os.path.getsize(f) for f in names)
    assert sizes(f for f in after if f not in before) <= sizes(after) / 6
    got = {r.k: (r.v, r.seq) for r in store.read().collect()}
    assert len(got) == 20_001 == store.read().count() and got[5] == (100, 1) and got[6] == (6, 0) and got[50_000] == (1, 1)
    assert store.merge(few, fold, 1) == [] and files(store.path) == after


def test_counts_are_exact_after_replays_and_broken_batches(spark, tmp_path):
    say = lambda *rows: spark.createDataFrame(list(rows), "codigo long, desc_prov string, proveedor string, seq long")
    store = L.alias_store(spark, str(tmp_path / "a"), 8)
    first = say((1, "cemento gris", "p", 1), (1, "Cemento Gris ", "p", 2), (2, "cal viva", "p", 3), (3, "m2", "p", 4))
    second = say(*[(1, f"cemento gris", "p", 5), (4, "chapa lisa", "q", 6)])
    L.learn_into(store, first, 0)
    L.learn_into(store, first, 0)
    # a driver that was lost after some buckets: only one of them has the batch, then all of it comes again
    L.learn_into(store, second.filter("codigo = 4"), 1)
    L.learn_into(store, second, 1)
    whole = L.confirm_aliases(spark.createDataFrame([], L.ALIASES), first.unionByName(second))
    key = lambda df: {(r.codigo, r.denominacion): r.frecuencia for r in df.collect()}
    assert key(store.read()) == key(whole) == {(1, "cemento gris"): 3, (2, "cal viva"): 1, (4, "chapa lisa"): 1}


def test_latest_shuffles_its_order_once(spark):
    """the order was shuffled inside the row and once more beside it; equal orders took either row."""
    old = spark.createDataFrame([(1, 5.0, "b"), (2, 7.0, "z"), (3, 1.0, None)], "k int, precio double, seq string")
    new = spark.createDataFrame([("c", 1, 4.0), ("a", 2, 9.0), ("c", 1, 6.0), ("d", 4, 2.0)], "seq string, k int, precio double")
    out = latest(("k",), "seq")(old, new)
    assert {tuple(r) for r in out.select("k", "precio", "seq").collect()} == {(1, 6.0, "c"), (2, 7.0, "z"), (3, 1.0, None), (4, 2.0, "d")}
    assert "max_by" not in out._jdf.queryExecution().optimizedPlan().toString()
