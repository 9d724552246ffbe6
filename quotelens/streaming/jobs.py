"""Structured Streaming jobs and their batch twins on an event table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from ..operators import compare as C
from ..operators import learn as L
from ..operators import pricing as P
from ..operators.keyed import KeyedTable, latest, replacing
from ..session import checkpoint_root, cut

# --- fixed values: request window, session gap, documents per session ----------
REQUESTS, WINDOW_S, SLIDE_S = 20, 60, 10
SESSION_GAP, SESSION_DOCS = "30 minutes", 5


def busy_windows_stream(events: DataFrame, key: str, watermark: str, threshold: int = REQUESTS,
                        window_s: int = WINDOW_S, slide_s: int = SLIDE_S) -> DataFrame:
    """Sliding request counts per key that reach the threshold."""
    x = events.withWatermark("ts", watermark)
    n = x.groupBy(F.window("ts", f"{window_s} seconds", f"{slide_s} seconds").alias("w"), key).agg(F.count("*").alias("n"))
    return n.filter(F.col("n") >= threshold).select(F.col("w.start").alias("desde"), key, "n")


def busy_windows(events: DataFrame, key: str, threshold: int = REQUESTS, window_s: int = WINDOW_S, slide_s: int = SLIDE_S) -> DataFrame:
    """Same counts over a table: one count per slide and key first, so only those are copied into the windows."""
    slots = events.groupBy(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / slide_s).alias("b"), key).agg(F.count("*").alias("c"))
    spread = slots.select(key, "c", F.explode(F.sequence(F.col("b") - (window_s // slide_s - 1), F.col("b"))).alias("b"))
    n = spread.groupBy("b", key).agg(F.sum("c").alias("n")).filter(F.col("n") >= threshold)
    return n.select(F.timestamp_seconds(F.col("b") * slide_s).alias("desde"), key, "n")


def sessions_stream(events: DataFrame, key: str, watermark: str, gap: str = SESSION_GAP) -> DataFrame:
    x = events.withWatermark("ts", watermark)
    s = x.groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("s.start").alias("desde"), F.col("s.end").alias("hasta"), "n", (F.col("n") >= SESSION_DOCS).alias("completa"))


def sessions(events: DataFrame, key: str, gap_s: int = 1800) -> DataFrame:
    """Inactivity sessions of a table: first inside each day, then across days.

    A key has at most one session per gap and day, so what crosses days stays
    small even for a key that holds a large share of the events.
    """
    ts = F.col("ts").cast("timestamp")
    x = events.select(key, F.unix_micros(ts).alias("t"), F.to_date(ts).alias("dia"), F.floor(F.unix_seconds(ts) / 900).alias("q"))
    # quarters of an hour are far below the gap: a quarter is one piece of a session
    quarters = x.groupBy(key, "dia", "q").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"))

    def join_pieces(df, *by):
        w = Window.partitionBy(key, *by).orderBy("a")
        new = F.coalesce(F.col("a") - F.lag("b").over(w) >= gap_s * 1_000_000, F.lit(True))
        ids = df.withColumn("nueva", new.cast("int")).withColumn("i", F.sum("nueva").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return ids.groupBy(key, *by, "i").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n")).drop("i")

    whole = join_pieces(join_pieces(quarters, "dia"))
    return whole.select(key, F.timestamp_micros("a").alias("desde"), F.timestamp_micros(F.col("b") + gap_s * 1_000_000).alias("hasta"),
                        "n", (F.col("n") >= SESSION_DOCS).alias("completa"))


CLOSED = StructType([StructField("desde", TimestampType()), StructField("hasta", TimestampType()), StructField("n", LongType()),
                     StructField("docs", ArrayType(LongType())), StructField("motivo", StringType())])
OPENED = StructType([StructField("desde", LongType()), StructField("ultimo", LongType()), StructField("docs", ArrayType(LongType()))])


def closing_sessions_stream(events: DataFrame, key: str, doc: str, request: Column, watermark: str, gap_s: int = 1800, docs: int = SESSION_DOCS) -> DataFrame:
    """Sessions as they close: ``(key, desde, hasta, n, docs, motivo)``.

    A key's state is its open session, at most ``docs`` documents. It closes with the document that fills it (``completa``), with
    a request (``pedida``), or when nothing came for ``gap_s`` seconds (``vencida``), then by a timer in event time. A request
    without an open session does nothing. ``ts`` orders a key's events, then ``doc``. Events behind the watermark are dropped.
    """
    gap = gap_s * 1_000_000
    out = StructType([events.schema[key], *CLOSED])
    at = lambda us: pd.Timestamp(us, unit="us")

    def run(keys, batches, state):
        found = []
        first, last, held = state.get if state.exists else (None, None, [])

        def close(end, reason):
            found.append((*keys, at(first), at(end), len(held), list(held), reason))

        if state.hasTimedOut:
            close(last + gap, "vencida")
            state.remove()
        else:
            rows = sorted((r for b in batches for r in zip(b["__us"].tolist(), b["__doc"].tolist(), b["__pide"].tolist())), key=lambda r: (r[0], r[2], r[1]))
            for us, one, asked in rows:
                if held and us - last >= gap:
                    close(last + gap, "vencida")
                    held = []
                if asked:
                    if held:
                        close(us, "pedida")
                        held = []
                    continue
                first = us if not held else first
                held = [*held, one]
                last = us
                if len(held) == docs:
                    close(us, "completa")
                    held = []
            if held:
                state.update((first, last, held))
                state.setTimeoutTimestamp(max((last + gap) // 1000, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        if found:
            yield pd.DataFrame(found, columns=out.names)

    x = events.withWatermark("ts", watermark).select(
        key, "ts", F.unix_micros("ts").alias("__us"), F.col(doc).cast("long").alias("__doc"), F.coalesce(request, F.lit(False)).alias("__pide"))
    return x.groupBy(key).applyInPandasWithState(run, out, OPENED, "append", "EventTimeTimeout")


def closing_sessions(events: DataFrame, key: str, doc: str, request: Column, gap_s: int = 1800, docs: int = SESSION_DOCS) -> DataFrame:
    """The same sessions of a table, the one still open at its end counting as ``vencida``.

    An event's number among the key's documents, the event before it and the last begin of a run are found inside each hour
    and carried over the key's hours, so a busy key is spread over as many tasks as it has hours.
    """
    gap = gap_s * 1_000_000
    ts = F.col("ts").cast("timestamp")
    x = events.select(key, F.unix_micros(ts).alias("us"), F.col(doc).cast("long").alias("doc"), F.coalesce(request, F.lit(False)).alias("pide"))
    x = cut(x.withColumns({"hora": F.floor(F.col("us") / 3_600_000_000), "es": (~F.col("pide")).cast("int")}))
    inside = Window.partitionBy(key, "hora").orderBy("us", "pide", "doc")
    over = Window.partitionBy(key).orderBy("hora")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    ends = x.groupBy(key, "hora").agg(F.sum("es").alias("en_hora"), F.max(F.struct("us", "pide", "doc")).alias("fin"))
    ends = ends.select(key, "hora", F.coalesce(F.sum("en_hora").over(before), F.lit(0)).alias("antes"),
                       F.lag("fin").over(over).alias("previa"))
    y = x.join(ends, [key, "hora"])
    y = y.withColumn("numero", F.col("antes") + F.sum("es").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    y = y.withColumn("previa", F.coalesce(F.lag(F.struct("us", "pide", "doc")).over(inside), F.col("previa")))
    # a run of documents begins behind a request, or after a gap
    begins = F.col("previa").isNull() | F.col("previa.pide") | (F.col("us") - F.col("previa.us") >= gap)
    y = cut(y.filter("not pide").withColumn("inicio", F.when(begins, F.col("numero"))))
    last = y.groupBy(key, "hora").agg(F.max("inicio").alias("ultimo"))
    last = last.select(key, "hora", F.max("ultimo").over(before).alias("traido"))
    order = inside.rowsBetween(Window.unboundedPreceding, 0)
    z = y.join(last, [key, "hora"]).withColumn("inicio", F.greatest(F.max("inicio").over(order), "traido"))
    z = z.withColumn("parte", F.floor((F.col("numero") - F.col("inicio")) / docs))
    rows = F.array_sort(F.collect_list(F.struct("us", "doc")))
    s = z.groupBy(key, "inicio", "parte").agg(F.min("us").alias("a"), F.max("us").alias("b"), F.count("*").alias("n"), rows.alias("r"), F.max("numero").alias("numero"))
    # a request stands behind the document of that number
    asked = x.join(ends, [key, "hora"]).withColumn("numero", F.col("antes") + F.sum("es").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    asked = asked.filter("pide").groupBy(key, "numero").agg(F.min("us").alias("pedido"))
    s = s.join(asked, [key, "numero"], "left")
    by_request = (F.col("n") < docs) & F.coalesce(F.col("pedido") - F.col("b") < gap, F.lit(False))
    end = F.when(F.col("n") == docs, F.col("b")).when(by_request, F.col("pedido")).otherwise(F.col("b") + gap)
    reason = F.when(F.col("n") == docs, "completa").when(by_request, "pedida").otherwise("vencida")
    return s.select(key, F.timestamp_micros("a").alias("desde"), F.timestamp_micros(end).alias("hasta"), "n",
                    F.transform("r", lambda v: v["doc"]).alias("docs"), reason.alias("motivo"))


def per_day(events: DataFrame, kind: str, watermark: str | None = None) -> DataFrame:
    """Tumbling daily counts; on a stream, rows later than the watermark are dropped and counted by the engine."""
    x = events.withWatermark("ts", watermark) if watermark else events
    return x.groupBy(F.window("ts", "1 day").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("dia"), kind, "n")


def once_per_hash(uploads: DataFrame, watermark: str) -> DataFrame:
    """The same file uploaded again inside the watermark counts once."""
    return uploads.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["hash"])


def _checkpoint(df: DataFrame, name: str) -> str:
    return f"{checkpoint_root(df.sparkSession)}/{name}"


def price_stream(lines: DataFrame, name: str, sink: Callable[[DataFrame, int], None]):
    """New quote lines priced as they arrive; the sink gets one batch and its number."""
    def run(batch: DataFrame, batch_id: int) -> None:
        sink(P.with_net(batch), batch_id)

    return lines.writeStream.option("checkpointLocation", _checkpoint(lines, name)).foreachBatch(run)


def write_once(root: str):
    """Each batch owns one folder, so a replayed batch rewrites the same rows."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/lote={batch_id}")

    return sink


def current_comparison(spark, root: str) -> DataFrame:
    """Comparison over everything the stream has written so far."""
    priced = spark.read.parquet(root)
    return C.with_saving(C.compare(C.cells(priced, F.struct("fecha", "doc", "line_no", "pu"))))


@dataclass(frozen=True)
class Comparison:
    """Kept state of the incremental analysis: the last price of each item and supplier, and the items' comparison.

    Both are keyed tables by item, so a batch rewrites the buckets of its items and reads no line again.
    """

    cells: KeyedTable
    items: KeyedTable

    @staticmethod
    def at(spark, root: str, lines: StructType, seq: str = "seq", supplier: str = "prov_id", buckets: int = 64) -> Comparison:
        """``lines`` is the schema of the analysed lines: item code, supplier, and ``seq`` that orders a cell's lines."""
        cell = StructType([StructField("codigo_match", lines["codigo_match"].dataType), StructField(supplier, lines[supplier].dataType),
                           StructField("seq", lines[seq].dataType), StructField("neto", DoubleType()), StructField("cant", DoubleType())])
        empty = spark.createDataFrame([], cell)
        item = C.with_saving(C.compare(empty, keys=("codigo_match",), supplier=supplier)).schema
        return Comparison(KeyedTable(spark, f"{root}/celdas", cell, ("codigo_match",), buckets), KeyedTable(spark, f"{root}/items", item, ("codigo_match",), buckets))

    def take(self, lines: DataFrame, lote: int, supplier: str = "prov_id") -> list[int]:
        """Merge the analysed lines of a batch; late, repeated and replayed lines leave the state of one pass over all."""
        keys = ("codigo_match", supplier)
        accepted = lines.filter("estado = 'MATCH'").select(
            *keys, "seq", F.col("precio").cast("double").alias("neto"), F.col("cant_norm").cast("double").alias("cant"))
        delta = cut(accepted.groupBy(*keys).agg(F.max_by(F.struct("seq", "neto", "cant"), "seq").alias("v")).select(*keys, "v.*"))
        self.cells.merge(delta, latest(keys, "seq"), lote)
        # only the items of the batch are compared again, from their kept cells
        mine = self.cells.of(delta).join(delta.select("codigo_match").distinct(), "codigo_match", "left_semi")
        changed = C.with_saving(C.compare(mine, keys=("codigo_match",), supplier=supplier))
        return self.items.merge(changed, replacing(("codigo_match",)), lote)


def analysis_stream(raw: DataFrame, name: str, prepare: Callable[[DataFrame], DataFrame], analyse: Callable[[DataFrame], DataFrame], state: Comparison):
    """The whole analysis of quote lines as they arrive: extraction, rate, match, unit, routing, then the merged comparison.

    ``prepare`` makes quote lines of a raw batch (a document comes in one batch), ``analyse`` the routed lines of these.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        state.take(cut(analyse(prepare(batch))), batch_id)

    return raw.writeStream.option("checkpointLocation", _checkpoint(raw, name)).foreachBatch(run)


def learn_stream(confirmations: DataFrame, name: str, root: str):
    """Each batch writes its counts per alias to a folder of its own; a replay writes the same ones again.

    The alias table is not touched by a batch: :func:`learned_aliases` folds the counts in, :func:`compact_aliases` stores that.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        L.count_confirmations(batch).write.mode("overwrite").parquet(f"{root}/lote={batch_id}")

    return confirmations.writeStream.option("checkpointLocation", _checkpoint(confirmations, name)).foreachBatch(run)


def learned_aliases(base: DataFrame, root: str, since: int = -1, rules=None) -> DataFrame:
    """``base`` and all counts of batches after ``since``."""
    counts = base.sparkSession.read.parquet(root).filter(F.col("lote") > since).drop("lote")
    return L.fold_counts(base, counts, rules)


def learn_keyed_stream(confirmations: DataFrame, name: str, aliases: KeyedTable, rules=None):
    """Each batch folds its counts into the buckets of its aliases; a replayed batch changes nothing."""
    def run(batch: DataFrame, batch_id: int) -> None:
        L.learn_into(aliases, batch, batch_id, rules)

    return confirmations.writeStream.option("checkpointLocation", _checkpoint(confirmations, name)).foreachBatch(run)


def compact_aliases(base: DataFrame, root: str, target: str, since: int = -1, rules=None) -> int:
    """Store the table with all counts so far under ``target`` and return the last batch it holds."""
    last = base.sparkSession.read.parquet(root).agg(F.max("lote")).first()[0]
    counts = base.sparkSession.read.parquet(root).filter((F.col("lote") > since) & (F.col("lote") <= last)).drop("lote")
    L.fold_counts(base, counts, rules).write.mode("overwrite").parquet(f"{target}/hasta={last}")
    return last
