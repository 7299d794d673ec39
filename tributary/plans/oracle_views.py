"""DuckDB text of the fixture bindings, used to build the oracle SQL.

Each entry is the DuckDB form of the same-named function in
:mod:`tributary.sources.fixtures`.  :func:`with_views` prefixes an oracle
body with the CTEs it names, so the oracle runs on the driver's raw tables.
"""

from __future__ import annotations

import re

_CATALOG = ("SELECT DISTINCT concat('{prefix}nwm.', strftime({day}, '%Y%m%d'), '/short_range/nwm.t', "
            "lpad(CAST({key} % 24 AS VARCHAR), 2, '0'), 'z.short_range.channel_rt.f', "
            "lpad(CAST(1 + {key} % 18 AS VARCHAR), 3, '0'), '{suffix}') AS path FROM {table}")

VIEWS: dict[str, str] = {
    "flow": "SELECT l_suppkey AS feature_id, l_shipdate AS time, avg(l_quantity) AS streamflow "
            "FROM lineitem GROUP BY 1, 2",
    "forecast_hourly": "SELECT user_id AS feature_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS reference_time, "
                       "CAST(date_trunc('hour', ts) AS TIMESTAMP) + to_hours(CAST(event_id % 18 + 1 AS INTEGER)) AS time, "
                       "avg(value) AS streamflow FROM events GROUP BY 1, 2, 3",
    "forecast": "SELECT l_suppkey AS feature_id, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS reference_time, "
                "CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS time, avg(l_quantity) AS streamflow "
                "FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
                "WHERE l_shipdate > o_orderdate GROUP BY 1, 2, 3",
    "grid": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS time, CAST(user_id % 10 AS DOUBLE) AS y, "
            "CAST(user_id AS DOUBLE) AS x, avg(value) AS zwattablrt FROM events GROUP BY 1, 2, 3",
    "gauge": "SELECT user_id AS site, CAST(date_trunc('day', ts) AS TIMESTAMP) AS value_date, avg(value) - 20 AS value "
             "FROM events WHERE (event_type NOT IN ('purchase', 'signup') OR event_type IS NULL) GROUP BY 1, 2",
    "gauge_forecast": "SELECT user_id AS site, user_id + 1000 AS nwm_feature_id, "
                      "CAST(date_trunc('day', ts) AS TIMESTAMP) AS value_date, avg(value) AS value "
                      "FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1, 2, 3",
    "huc": "SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS huc4, "
           "lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS huc2, n_nationkey AS huc_key FROM nation",
    "reach": "SELECT c_custkey AS comid, c_nationkey AS huc_key FROM customer",
    "divides": "SELECT p_partkey AS toid, p_size AS aoi FROM part",
    "flowpaths": "SELECT DISTINCT l_orderkey AS id, l_partkey AS toid, l_linenumber AS ord FROM lineitem",
    "nexus": "SELECT s_suppkey AS id, s_acctbal < 0 AS outflow FROM supplier",
    "crosswalk": "SELECT o_orderkey AS id, o_custkey AS comid, CAST(o_orderkey % 4 AS INTEGER) AS part FROM orders",
    "catalog_src": _CATALOG.format(prefix="", suffix=".conus.nc", day="o_orderdate", key="o_orderkey", table="orders"),
    "catalog_dst": _CATALOG.format(prefix="kerchunk/", suffix=".conus.json", day="l_shipdate", key="l_orderkey", table="lineitem"),
    "seg": "SELECT vec_id AS comid, CAST(embedding[1] AS DOUBLE) * 10 AS x1, CAST(embedding[2] AS DOUBLE) * 10 AS y1, "
           "CAST(embedding[3] AS DOUBLE) * 10 AS x2, CAST(embedding[4] AS DOUBLE) * 10 AS y2 FROM embeddings",
    "coverage": "SELECT c_custkey AS toid, c_nationkey AS grp, CAST(c_custkey % 40 AS INTEGER) AS cx, "
                "CAST(floor(c_custkey / 40) AS INTEGER) AS cy FROM customer",
    "results": "SELECT l_returnflag AS query, l_linenumber AS nb_days, "
               "CASE WHEN l_linestatus = 'O' THEN 'base' ELSE 'rechunked' END AS source, "
               "l_extendedprice / 1000 AS time FROM lineitem",
    "areas": "SELECT n_nationkey AS area_id, c.v AS v, "
             "(CAST(-4.0 AS DOUBLE) + CAST(2.0 AS DOUBLE) * (n_nationkey % 5)) + CAST(c.dx AS DOUBLE) AS x, "
             "(CAST(-4.0 AS DOUBLE) + CAST(2.0 AS DOUBLE) * floor(n_nationkey / 5)) + CAST(c.dy AS DOUBLE) AS y "
             "FROM nation, (VALUES (0, -0.9, -0.6), (1, 0.7, -0.9), (2, 0.9, 0.7), (3, -0.6, 0.9)) AS c(v, dx, dy)",
    "catchments": "SELECT catchment_id, c.v AS v, "
                  "CASE c.v WHEN 0 THEN x0 WHEN 1 THEN x0 + s WHEN 2 THEN x0 + s ELSE x0 END AS x, "
                  "CASE c.v WHEN 0 THEN y0 WHEN 1 THEN y0 WHEN 2 THEN y0 + s ELSE y0 + s END AS y "
                  "FROM (SELECT p_partkey AS catchment_id, "
                  "CAST(-4.6 AS DOUBLE) + CAST(0.37 AS DOUBLE) * (p_partkey % 25) AS x0, "
                  "CAST(-4.6 AS DOUBLE) + CAST(0.37 AS DOUBLE) * (floor(p_partkey / 25) % 25) AS y0, "
                  "CAST(0.2 AS DOUBLE) + p_size / CAST(100.0 AS DOUBLE) AS s FROM part), "
                  "(VALUES (0), (1), (2), (3)) AS c(v)",
}

def _used(sql: str) -> list[str]:
    found = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            found.append(name)
    return found


def with_views(body: str) -> str:
    """Prefix ``body`` with CTEs for every fixture it names ."""
    names = _used(body)
    if not names:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
