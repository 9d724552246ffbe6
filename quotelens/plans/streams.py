"""Batch twins on the event table; the stream forms are tested on files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import learn as L
from ..operators import pricing as P
from ..sources.derived import lines
from ..sources.views import table
from ..streaming import jobs as W
from .learn import confirmations
from .registry import on, query


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


@query("w1_busy_windows", """
  WITH x AS (SELECT event_type, epoch_us(ts) // 10000000 AS b FROM events),
  e AS (SELECT event_type, b - o AS b FROM x, (SELECT unnest(range(0, 360)) AS o))
  SELECT make_timestamp(b * 10000000) AS desde, event_type, count(*) AS n FROM e GROUP BY ALL HAVING count(*) >= 5""")
def w1(spark, sf):
    """The table has few requests per minute, so the window here is an hour that slides by ten seconds."""
    return W.busy_windows(events(spark, sf), "event_type", threshold=5, window_s=3600, slide_s=10)


@query("w1_busy_minutes", """
  WITH x AS (SELECT user_id, epoch_us(ts) // 10000000 AS b FROM events),
  e AS (SELECT user_id, b - o AS b FROM x, (SELECT unnest(range(0, 6)) AS o))
  SELECT make_timestamp(b * 10000000) AS desde, user_id, count(*) AS n FROM e GROUP BY ALL HAVING count(*) >= 2""")
def w1_minutes(spark, sf):
    return W.busy_windows(events(spark, sf), "user_id", threshold=2)


@query("w2_sessions", """
  WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events),
  i AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
  SELECT user_id, min(ts) AS desde, max(ts) + INTERVAL 30 MINUTE AS hasta, count(*) AS n, count(*) >= 5 AS completa FROM i GROUP BY user_id, i""")
def w2(spark, sf):
    return W.sessions(events(spark, sf), "user_id")


@query("w2_sessions_by_type", """
  WITH g AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) >= INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY event_type ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events),
  i AS (SELECT event_type, ts, sum(s) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
  SELECT event_type, min(ts) AS desde, max(ts) + INTERVAL 30 MINUTE AS hasta, count(*) AS n, count(*) >= 5 AS completa FROM i GROUP BY event_type, i""")
def w2_type(spark, sf):
    """Few keys with many events each: the sessions run over midnight and through many pieces."""
    return W.sessions(events(spark, sf), "event_type")


@query("w2_closing_sessions", """
  WITH e AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS pide FROM events),
  o AS (SELECT *, lag(ts) OVER w AS pts, lag(pide) OVER w AS ppide FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, pide, event_id)),
  r AS (SELECT *, sum(CASE WHEN NOT pide AND (pts IS NULL OR ppide OR ts - pts >= INTERVAL 30 MINUTE) THEN 1 ELSE 0 END)
                    OVER (PARTITION BY user_id ORDER BY ts, pide, event_id ROWS UNBOUNDED PRECEDING) AS run,
               lead(ts) OVER w AS nts, lead(pide) OVER w AS npide FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, pide, event_id)),
  d AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) // 5 AS parte FROM r WHERE NOT pide),
  g AS (SELECT user_id, run, parte, min(ts) AS desde, max(ts) AS b, count(*) AS n, list(event_id ORDER BY ts, event_id) AS docs,
               arg_max(npide, (ts, event_id)) AS pedida, arg_max(nts, (ts, event_id)) AS pedido FROM d GROUP BY ALL)
  SELECT user_id, desde, CASE WHEN n = 5 THEN b WHEN pedida AND pedido - b < INTERVAL 30 MINUTE THEN pedido ELSE b + INTERVAL 30 MINUTE END AS hasta,
         n, docs, CASE WHEN n = 5 THEN 'completa' WHEN pedida AND pedido - b < INTERVAL 30 MINUTE THEN 'pedida' ELSE 'vencida' END AS motivo FROM g""")
def w2_closing(spark, sf):
    """Purchases stand for the request to compare now; every other event is a document."""
    return W.closing_sessions(events(spark, sf), "user_id", "event_id", F.col("event_type") == "purchase")


@query("w2_closing_sessions_by_type", """
  WITH e AS (SELECT event_type, ts, event_id, user_id % 7 = 0 AS pide FROM events),
  o AS (SELECT *, lag(ts) OVER w AS pts, lag(pide) OVER w AS ppide FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts, pide, event_id)),
  r AS (SELECT *, sum(CASE WHEN NOT pide AND (pts IS NULL OR ppide OR ts - pts >= INTERVAL 30 MINUTE) THEN 1 ELSE 0 END)
                    OVER (PARTITION BY event_type ORDER BY ts, pide, event_id ROWS UNBOUNDED PRECEDING) AS run,
               lead(ts) OVER w AS nts, lead(pide) OVER w AS npide FROM o WINDOW w AS (PARTITION BY event_type ORDER BY ts, pide, event_id)),
  d AS (SELECT *, (row_number() OVER (PARTITION BY event_type, run ORDER BY ts, event_id) - 1) // 5 AS parte FROM r WHERE NOT pide),
  g AS (SELECT event_type, run, parte, min(ts) AS desde, max(ts) AS b, count(*) AS n, list(event_id ORDER BY ts, event_id) AS docs,
               arg_max(npide, (ts, event_id)) AS pedida, arg_max(nts, (ts, event_id)) AS pedido FROM d GROUP BY ALL)
  SELECT event_type, desde, CASE WHEN n = 5 THEN b WHEN pedida AND pedido - b < INTERVAL 30 MINUTE THEN pedido ELSE b + INTERVAL 30 MINUTE END AS hasta,
         n, docs, CASE WHEN n = 5 THEN 'completa' WHEN pedida AND pedido - b < INTERVAL 30 MINUTE THEN 'pedida' ELSE 'vencida' END AS motivo FROM g""")
def w2_closing_type(spark, sf):
    """Few keys with many events each, so sessions close by count, by request and by silence."""
    return W.closing_sessions(events(spark, sf), "event_type", "event_id", F.col("user_id") % 7 == 0)


@query("w3_incremental_comparison", on("cells", sql="SELECT codigo, anio, count(*) AS n_prov, min(neto) AS minimo FROM cells GROUP BY codigo, anio"))
def w3(spark, sf):
    """Result the stream converges to once every line has arrived."""
    seq = F.struct("fecha", "doc", "line_no", "codigo", "prov_id", "pu", "cant")
    return C.compare(C.cells(P.with_net(lines(spark, sf)), seq)).select("codigo", "anio", "n_prov", "minimo")


@query("w4_incremental_aliases", on("quotes", sql="""
  WITH b AS (SELECT codigo, CASE WHEN codigo % 10 = 0 THEN 'm2 x ' || line_no ELSE lower(p_name) || ' ' || (prov_id % 3) END AS denominacion FROM quotes)
  SELECT codigo, denominacion, count(*) AS frecuencia FROM b WHERE regexp_matches(denominacion, '[a-z]{4,}') GROUP BY ALL"""))
def w4(spark, sf):
    """Two batches in a row give the counts of one."""
    c = confirmations(spark, sf)
    empty = c.limit(0).select("codigo", F.lit("").alias("denominacion"), F.lit(0).alias("frecuencia"), F.lit(0).alias("confianza"), F.lit("").alias("origen"))
    early, late = F.pmod(F.hash("line_id"), F.lit(2)) == 0, F.pmod(F.hash("line_id"), F.lit(2)) == 1
    return L.confirm_aliases(L.confirm_aliases(empty, c.filter(early)), c.filter(late)).select("codigo", "denominacion", "frecuencia")


@query("w5_daily_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS dia, event_type, count(*) AS n FROM events GROUP BY ALL")
def w5(spark, sf):
    return W.per_day(events(spark, sf), "event_type")


@query("w6_duplicate_uploads", "SELECT md5(props) AS hash, count(*) AS subidas, min(event_id) AS primera FROM events GROUP BY 1")
def w6(spark, sf):
    """Distinct files by content hash; the stream form keeps the first inside the watermark."""
    return events(spark, sf).groupBy(F.md5("props").alias("hash")).agg(F.count("*").alias("subidas"), F.min("event_id").alias("primera"))
