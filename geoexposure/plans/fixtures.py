"""Views on the driver's tables that stand in for zones, pixels, lines and footprints.

The text of a view is valid in Spark SQL and in DuckDB, so an oracle starts with the same text. Cell (row, col) covers
[col, col + 1] x [row, row + 1]; the grid has 100 columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
NROWS = "(SELECT CAST(count(*) AS DOUBLE)/100 FROM {orders})"
H = "(SELECT CAST(count(*) AS DOUBLE)/500 FROM {orders})"

VIEWS = {
    "px": "SELECT CAST(floor(o_orderkey/100) AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col, CAST(round(o_totalprice*100) AS BIGINT) AS value, "
    "CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS mask, CAST(substr(o_orderpriority,1,1) AS INT) AS cls, o_orderdate AS acquired FROM {orders}",
    "zones": f"SELECT CAST(n_nationkey AS BIGINT) AS zone_id, n_name AS name, n_regionkey AS region, (n_nationkey % 5)*20+2.5e-1 AS xmin, (n_nationkey % 5)*20+1.975e1 AS xmax, "
    f"floor(n_nationkey/5)*{H}+5e-1 AS ymin, floor(n_nationkey/5)*{H}+{H}-2.5e-1 AS ymax FROM {{nation}}",
    "lines": f"SELECT p_partkey AS fid, p_type AS cls, ((p_partkey*37) % 400)/4e0 AS x1, ((p_partkey*53) % CAST(4*{NROWS} AS BIGINT))/4e0 AS y1, "
    f"((p_partkey*37) % 400)/4e0 + ((p_partkey % 9)-4)*1.5e0 AS x2, ((p_partkey*53) % CAST(4*{NROWS} AS BIGINT))/4e0 + ((p_partkey % 7)-3)*5e-1 AS y2 FROM {{part}}",
    "feats": f"SELECT c_custkey AS fid, c_nationkey AS iso, ((c_custkey*29) % 400)/4e0+1.25e-1 AS x, ((c_custkey*31) % CAST(4*{NROWS} AS BIGINT))/4e0+1.25e-1 AS y, "
    "((c_custkey % 4)+1)*5e-1 AS side, c_custkey % 2 AS sex, (c_custkey*13) % 101 AS age FROM {customer}",
    "geo": f"SELECT c_custkey AS fid, (((c_custkey*29) % 400)/4e0+1.25e-1)*3.6e0-1.8e2 AS lon, "
    f"(((c_custkey*31) % CAST(4*{NROWS} AS BIGINT))/4e0+1.25e-1)*1.6e2/{NROWS}-8e1 AS lat FROM {{customer}}",
    "series": "SELECT c_nationkey AS iso3, CAST(year(o_orderdate) AS INT) AS yr, CAST(count(*) AS DOUBLE) AS pop FROM {orders} JOIN {customer} ON o_custkey=c_custkey GROUP BY 1,2",
    "scenes": "SELECT event_id AS scene_id, user_id AS tile, ts, least(CAST(floor(value) AS INT),100) AS cloud, CAST((event_id*17) % 101 AS INT) AS coverage FROM {events}",
    "edges": "SELECT p_partkey AS u, (p_partkey*7+1) % (SELECT count(*) FROM {part}) AS v, CAST(p_retailprice*10 AS BIGINT) AS length_m, p_type AS cls FROM {part}",
}


class Tables:
    """The driver's tables and the views on them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        named = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{n: getattr(self, n) for n in named})

    @property
    def nrows(self) -> int:
        """Rows of the pixel grid; the count comes from file footers."""
        return -(-self.orders.count() // 100)


def _without_hypot(text: str) -> str:
    """hypot(a, b), which DuckDB lacks, as a square root."""
    while (start := text.rfind("hypot(")) >= 0:
        depth, comma, at = 1, 0, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(text[at], 0)
            comma = at if text[at] == "," and depth == 1 else comma
            at += 1
        text = f"{text[:start]}sqrt(power({text[start + 6 : comma]}, 2)+power({text[comma + 1 : at - 1]}, 2)){text[at:]}"
    return text


def oracle(text: str) -> str:
    """``text`` after the views that it names."""
    text = _without_hypot(text)
    needed, queue = [], [text]
    while queue:
        part = queue.pop()
        for v in VIEWS:
            if v not in needed and re.search(rf"\b{v}\b", part):
                needed.append(v)
    views = ", ".join(f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in needed)
    return f"WITH RECURSIVE {views}, {text[5:]}" if text.startswith("WITH ") and views else f"WITH {views} {text}" if views else text
