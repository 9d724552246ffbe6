"""Query registry and the SQL views the twins are written on."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "quotes": """
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT), CAST(floor(l_quantity) AS BIGINT),
                   strftime(l_shipdate, '%Y%m%d')) AS line_id,
         l_orderkey AS doc, l_linenumber AS line_no, l_partkey AS codigo, l_suppkey AS prov_id,
         l_extendedprice AS pu, l_quantity AS cant,
         CAST(floor(l_discount * 100 + 0.5) AS DOUBLE) AS descuento, l_tax > 0 AS con_iva,
         l_shipdate AS fecha, CAST(year(l_shipdate) AS INTEGER) AS anio,
         p_type AS rubro, p_name || ' ' || p_brand AS material, p_name, p_brand, p_size,
         s_name AS proveedor, s_nationkey AS zona
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "owned": """
  SELECT q.*, o_custkey AS user_id, o_orderdate AS doc_fecha, o_orderstatus AS estado
  FROM quotes q JOIN orders ON doc = o_orderkey""",
    "priced": """
  SELECT *, floor(pu / (CASE WHEN con_iva THEN 1.105 ELSE 1.0 END) * (1 - descuento / 100.0) * 100.0 + 0.5) / 100.0 AS neto
  FROM quotes""",
    # last line per cell, then one row per cell
    "cells": """
  SELECT codigo, anio, rubro, material, proveedor, prov_id,
         arg_max(neto, (fecha, doc, line_no, codigo, prov_id, pu, cant)) AS neto,
         arg_max(cant, (fecha, doc, line_no, codigo, prov_id, pu, cant)) AS cant,
         arg_max(con_iva, (fecha, doc, line_no, codigo, prov_id, pu, cant)) AS con_iva
  FROM priced GROUP BY ALL""",
    "comparison": """
  SELECT codigo, anio, rubro, material, count(*) AS n_prov, count(*) > 1 AS en_varios,
         arg_min(proveedor, (neto, prov_id)) AS mejor, arg_min(cant, (neto, prov_id)) AS cant,
         min(neto) AS minimo, max(neto) AS maximo,
         CAST(sum(CAST(neto AS DECIMAL(28,2))) AS DOUBLE) / count(*) AS promedio
  FROM cells GROUP BY codigo, anio, rubro, material""",
    "saved": """
  SELECT *, CASE WHEN n_prov = 1 OR minimo <= 0 OR maximo > 3 * minimo THEN 0.0
                 ELSE floor(greatest(0.0, promedio - minimo) * coalesce(nullif(cant, 0), 1) * 100.0 + 0.5) / 100.0 END AS ahorro
  FROM comparison""",
}
_NEEDS = {
    "quotes": [], "owned": ["quotes"], "priced": ["quotes"], "cells": ["quotes", "priced"],
    "comparison": ["quotes", "priced", "cells"], "saved": ["quotes", "priced", "cells", "comparison"],
}


def add_view(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    chain: list[str] = []
    for need in needs:
        for step in [*_NEEDS[need], need]:
            if step not in chain:
                chain.append(step)
    VIEWS[name] = sql
    _NEEDS[name] = chain


def on(*names: str, sql: str) -> str:
    """SQL text with the named views (and what they need) in front."""
    chain: list[str] = []
    for name in names:
        for step in [*_NEEDS[name], name]:
            if step not in chain:
                chain.append(step)
    if not chain:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in chain)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
