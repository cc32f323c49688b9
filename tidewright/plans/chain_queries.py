"""Greedy bins of keys that hold a large part of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.operators.chains import greedy_bins
from tidewright.plans.registry import query
from tidewright.session import table

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _sql(opens: str) -> str:
    """Bins by recursion over the first item of each: the next one's is the first item behind it that fulfils *opens*."""
    return f"""
WITH RECURSIVE q AS (SELECT l_linestatus, {", ".join(_ORDER)}, l_quantity::BIGINT AS n FROM lineitem),
r AS (SELECT *, row_number() OVER w AS pos, sum(n) OVER w - n AS used FROM q WINDOW w AS (PARTITION BY l_linestatus ORDER BY {", ".join(_ORDER)}, n ROWS UNBOUNDED PRECEDING)),
s AS (SELECT l_linestatus, 0::BIGINT AS bin, 1::BIGINT AS pos, 0::HUGEINT AS used FROM r GROUP BY l_linestatus UNION ALL
  SELECT x.l_linestatus, x.bin + 1, x.pos, x.used FROM (SELECT s.l_linestatus, s.bin, min(r.pos) AS pos, min(r.used) AS used
    FROM s JOIN r ON r.l_linestatus = s.l_linestatus AND r.pos > s.pos AND {opens} GROUP BY s.l_linestatus, s.bin) x)
SELECT r.l_linestatus, {", ".join("r." + c for c in _ORDER)}, r.n AS n, s.bin FROM r ASOF JOIN s ON r.l_linestatus = s.l_linestatus AND r.pos >= s.pos"""


def _bins(spark: SparkSession, sf_dir: str, most: int, closes: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").selectExpr("l_linestatus", *_ORDER, "CAST(l_quantity AS BIGINT) AS n")
    return greedy_bins(items, "l_linestatus", _ORDER, "n", most, closes, block_rows=20_000)


@query("O137", _sql("r.used + r.n >= s.used + 20000 AND r.used > s.used"))
def long_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys hold the whole table; a bin ends before the item that would fill it."""
    return _bins(spark, sf_dir, 20_000, "before")


@query("O143", _sql("r.used > s.used + 30000"))
def long_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys hold the whole table; a chunk ends with the item that overfills it."""
    return _bins(spark, sf_dir, 30_000, "after")
