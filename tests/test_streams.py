"""Stream forms on files, compared with their batch twins."""

from pyspark.sql import functions as F

from quotelens.plans.learn import confirmations
from quotelens.sources.derived import lines
from quotelens.sources.views import table
from quotelens.streaming import jobs as W

SF = "/root/testdata/sf0.001"


def split(df, root, n=3):
    """Write a table as several files so that the stream sees several batches."""
    for i in range(n):
        df.filter(F.pmod(F.hash(*df.columns[:1]), F.lit(n)) == i).coalesce(1).write.mode("append").parquet(root)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(root)


def drain(q):
    q.processAllAvailable()
    q.stop()


def events(spark):
    return table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def test_sessions_and_daily_counts(spark, tmp_path):
    e = events(spark)
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = W.sessions_stream(stream, "user_id", "1 hour").writeStream.outputMode("complete").format("memory").queryName("s").option(
        "checkpointLocation", str(tmp_path / "c1")).start()
    drain(q)
    key = lambda df: {(r.user_id, r.desde, r.hasta, r.n) for r in df.collect()}
    assert key(spark.table("s")) == key(W.sessions(e, "user_id"))
    q = W.per_day(stream, "event_type", "2 days").writeStream.outputMode("complete").format("memory").queryName("d").option(
        "checkpointLocation", str(tmp_path / "c2")).start()
    drain(q)
    assert spark.table("d").exceptAll(W.per_day(e, "event_type")).count() == 0


def test_busy_windows(spark, tmp_path):
    e = events(spark)
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = W.busy_windows_stream(stream, "event_type", "1 hour", 3, 3600, 600).writeStream.outputMode("complete").format("memory").queryName("b").option(
        "checkpointLocation", str(tmp_path / "c")).start()
    drain(q)
    assert sorted(map(tuple, spark.table("b").collect())) == sorted(map(tuple, W.busy_windows(e, "event_type", 3, 3600, 600).collect()))


def test_priced_lines_build_the_comparison(spark, tmp_path):
    l = lines(spark, SF)
    stream = split(l, str(tmp_path / "in"))
    drain(W.price_stream(stream, f"p{tmp_path.name}", W.write_once(str(tmp_path / "out"))).start())
    got = W.current_comparison(spark, str(tmp_path / "out"))
    from quotelens.plans import QUERIES

    want = QUERIES["w3_incremental_comparison"](spark, SF)
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_alias_counts_and_compaction(spark, tmp_path):
    c = confirmations(spark, SF).withColumn("codigo", F.col("codigo").cast("long"))
    root, target = str(tmp_path / "al"), str(tmp_path / "tabla")
    empty = spark.createDataFrame([], "codigo long, denominacion string, frecuencia long, confianza int, origen string")
    name = f"l{tmp_path.name}"
    half = F.pmod(F.hash("line_id"), F.lit(2))
    c.filter(half == 0).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(W.learn_stream(stream, name, root).start())
    last = W.compact_aliases(empty, root, target)
    c.filter(half == 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    drain(W.learn_stream(stream, name, root).start())
    from quotelens.plans import QUERIES

    want = QUERIES["w4_incremental_aliases"](spark, SF)
    base = spark.read.parquet(f"{target}/hasta={last}")
    whole, step = W.learned_aliases(empty, root), W.learned_aliases(base, root, last)
    assert last == 0 and whole.exceptAll(step).count() == 0 and step.exceptAll(whole).count() == 0
    assert whole.select(want.columns).exceptAll(want).count() == 0 and whole.count() == want.count()


def arriving(spark, root, schema, batches):
    """A stream of one file per batch, in the order written."""
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root)
        time.sleep(1.1)  # files are taken by age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(root)


def arriving_frames(spark, root, like, frames):
    import time

    for df in frames:
        df.coalesce(1).write.mode("append").parquet(root)
        time.sleep(1.1)
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(root)


def test_append_mode_drops_what_is_later_than_the_watermark(spark, tmp_path):
    import datetime as dt

    day = lambda d, h=12: dt.datetime(2024, 1, d, h, tzinfo=dt.timezone.utc)
    batches = [[(day(1), "a"), (day(1), "a")], [(day(5), "a")], [(day(6), "a")], [(day(1, 13), "a"), (day(5, 13), "a")], [(day(9), "a")], [(day(20), "a")]]
    stream = arriving(spark, str(tmp_path / "e"), "ts timestamp, event_type string", batches)
    q = W.per_day(stream, "event_type", "1 day").writeStream.outputMode("append").format("memory").queryName("late").option(
        "checkpointLocation", str(tmp_path / "c")).start()
    drain(q)
    # the fourth batch brings a row of day 1, whose count has been given out: it stays 2
    assert {(r.dia.day, r.n) for r in spark.table("late").collect()} == {(1, 2), (5, 2), (6, 1), (9, 1)}


def test_sessions_close_in_append_mode(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 8, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=m)
    batches = [[(at(0), 1), (at(10), 1)], [(at(25), 1)], [(at(300), 1)], [(at(900), 1)]]
    stream = arriving(spark, str(tmp_path / "e"), "ts timestamp, user_id int", batches)
    q = W.sessions_stream(stream, "user_id", "30 minutes").writeStream.outputMode("append").format("memory").queryName("closed").option(
        "checkpointLocation", str(tmp_path / "c")).start()
    drain(q)
    assert sorted((r.n, r.desde.hour) for r in spark.table("closed").collect()) == [(1, at(300).hour), (3, 8)]


def test_repeated_upload_in_a_later_batch_counts_once(spark, tmp_path):
    import datetime as dt

    at = lambda d: dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc)
    batches = [[(at(1), "x"), (at(1), "y")], [(at(2), "x")], [(at(3), "z")], [(at(3), "y")]]
    stream = arriving(spark, str(tmp_path / "e"), "ts timestamp, hash string", batches)
    q = W.once_per_hash(stream, "10 days").writeStream.outputMode("append").format("memory").queryName("seen").option(
        "checkpointLocation", str(tmp_path / "c")).start()
    drain(q)
    assert sorted(r.hash for r in spark.table("seen").collect()) == ["x", "y", "z"]


def test_duplicate_upload_counts_once(spark, tmp_path):
    e = events(spark).withColumn("hash", F.md5("props"))
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = W.once_per_hash(stream, "60 days").writeStream.outputMode("append").format("memory").queryName("u").option(
        "checkpointLocation", str(tmp_path / "c")).start()
    drain(q)
    assert spark.table("u").count() == e.select("hash").distinct().count()


def test_sessions_close_by_count_request_and_timer(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 8, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=m)
    doc, ask = "pdf", "listo"
    batches = [
        [(at(0), 1, 10, doc), (at(1), 2, 20, doc), (at(2), 3, 30, ask)],
        [(at(5), 1, 11, doc), (at(6), 1, 12, doc), (at(7), 1, 13, doc), (at(8), 1, 14, doc), (at(9), 1, 15, doc)],  # the fifth closes, one is left
        [(at(12), 2, 21, doc), (at(13), 2, 22, ask), (at(14), 2, 23, ask), (at(15), 2, 24, doc)],  # a request closes, the next does nothing
        [(at(100), 4, 40, doc)],  # time goes on: timers close what is open
        [(at(101), 2, 25, ask), (at(103), 1, 16, doc)],
        [(at(400), 9, 90, doc)], [(at(500), 9, 91, doc)], [(at(900), 9, 92, ask)],
    ]
    stream = arriving(spark, str(tmp_path / "e"), "ts timestamp, user_id int, doc long, tipo string", batches)
    asked = F.col("tipo") == ask
    q = W.closing_sessions_stream(stream, "user_id", "doc", asked, "10 minutes").writeStream.outputMode("append").format("memory").queryName("closing").option(
        "checkpointLocation", str(tmp_path / "c")).start()
    drain(q)
    key = lambda df: sorted((r.user_id, r.desde, r.hasta, r.n, tuple(r.docs), r.motivo) for r in df.collect())
    got = key(spark.table("closing"))
    want = key(W.closing_sessions(spark.read.parquet(str(tmp_path / "e")), "user_id", "doc", asked))
    assert got == want
    assert {(u, d, m) for u, _, _, _, d, m in got} == {
        (1, (10, 11, 12, 13, 14), "completa"), (1, (15,), "vencida"), (1, (16,), "vencida"), (2, (20, 21), "pedida"), (2, (24,), "vencida"),
        (4, (40,), "vencida"), (9, (90,), "vencida"), (9, (91,), "vencida")}


def test_the_whole_analysis_in_a_stream_equals_the_batch(spark, tmp_path):
    from quotelens.operators import analysis as A
    from quotelens.operators import linkage as M
    from quotelens.plans import QUERIES, analysis as PA
    from quotelens.plans.linkage import aliases, brands, catalogue, line_text
    from quotelens.sources.derived import materials

    given = PA.quote_lines(spark, SF)
    pool = M.build_pool(aliases(spark, SF), catalogue(spark, SF), PA.RULES)
    conv, rates, marks = PA.conversions(spark, SF), PA.rates(spark, SF), brands(spark, SF)
    run = lambda x: A.analyse(x, pool, marks, conv, rates, F.col("seq"), PA.RULES).lines
    schema = run(given.limit(0)).schema
    state = W.Comparison.at(spark, str(tmp_path / "state"), schema)
    # two batches out of order, and some lines of the first again in a third
    folder = str(tmp_path / "in")
    late = F.pmod(F.hash("line_id"), F.lit(2)) == 0
    stream = arriving_frames(spark, folder, given, [given.filter(~late), given.filter(late), given.filter(~late).limit(300)])
    drain(W.analysis_stream(stream, f"a{tmp_path.name}", lambda raw: raw, run, state).start())
    want = QUERIES["w3_analysed_comparison"](spark, SF)
    got = state.items.read().select(F.col("codigo_match").alias("codigo"), "n_prov", "mejor_id", "cant", "minimo", "maximo")
    rounded = lambda df: {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()}
    assert rounded(got) == rounded(want.select(got.columns)) and got.count() == want.count() > 0
    # a replayed batch writes nothing
    assert state.take(run(given.filter(late)), 1) == []
