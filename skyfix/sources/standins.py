"""Synthetic stand-ins for the engine's entities, derived by arithmetic from the driver's tables.

They are no localizations: they only give every operator rows of the right shape. Each is one SQL
text that Spark and DuckDB read alike, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CANDIDATES = """
SELECT job_id, candidate_id, p % 116 AS tile_id, ((p * 37 + s * 11) % 1000) / 1e3 AS similarity, raw_matches,
       CAST(floor(raw_matches * ((s % 70) / 1e2)) AS INT) AS inliers,
       floor(raw_matches * ((s % 70) / 1e2)) / CAST(raw_matches AS DOUBLE) AS ratio,
       (p % 17) / 16e0 AS coverage, CASE WHEN s % 11 = 0 THEN NULL ELSE (p % 150) / 1e1 END AS error,
       (s + p) % 3 <> 0 AS valid, (s + p) % 3 = 0 AND p % 2 = 0 AS partial,
       CASE WHEN (s + p) % 3 <> 0 THEN NULL WHEN p % 2 = 0 THEN 'below_min_inliers' ELSE 'excessive_shear' END AS rejection,
       (p % 90) / 1e2 AS shear, CASE WHEN s % 13 = 0 THEN NULL ELSE CAST((p * 7) % 900 AS DOUBLE) END AS x, CAST((s * 31) % 900 AS DOUBLE) AS y
FROM (SELECT l_orderkey AS job_id, l_linenumber AS candidate_id, min(l_partkey) AS p, min(l_suppkey) AS s, 20 + min(l_partkey) % 380 AS raw_matches
      FROM lineitem GROUP BY l_orderkey, l_linenumber) g
"""

MAPS = "SELECT c_custkey AS map_id, CAST(400 + (c_custkey * 37) % 2600 AS INT) AS map_w, CAST(300 + (c_custkey * 53) % 2700 AS INT) AS map_h FROM customer"

HOMOGRAPHIES = """
SELECT p_partkey AS h_id, 0.5e0 + (p_partkey % 40) / 3e1 AS h0, ((p_partkey % 21) - 10) / 2e1 AS h1, CAST(p_partkey % 500 AS DOUBLE) AS h2,
       ((p_partkey % 19) - 9) / 2e1 AS h3, 0.4e0 + (p_partkey % 37) / 3e1 AS h4, CAST(p_partkey % 300 AS DOUBLE) AS h5,
       ((p_partkey % 7) - 3) / 2e4 AS h6, ((p_partkey % 5) - 2) / 2e4 AS h7, 1e0 AS h8,
       CAST(p_partkey % 60 AS INT) AS inliers, (p_partkey % 10) / 1e1 AS ratio, (p_partkey % 160) / 1e1 AS error, (p_partkey % 17) / 16e0 AS coverage
FROM part
"""

POINTS = "SELECT l_orderkey AS candidate_id, (l_partkey * 13 % 700) - 20e0 AS qx, (l_suppkey * 29 % 520) - 10e0 AS qy, l_extendedprice / 1e3 AS err, CAST(l_linenumber % 4 AS INT) AS k FROM lineitem"

LOG = """
SELECT user_id AS job_id, event_type AS key, CASE CAST(floor(value) AS INT) % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'skipped' END AS state,
       CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS detail, ts, event_id AS seq
FROM events
"""

ITEMS = """
SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_custkey * 7 % 3000 AS DOUBLE) END AS expected_x,
       CAST(o_custkey * 11 % 3000 AS DOUBLE) AS expected_y, o_orderkey % 8 = 0 AS expect_no_match FROM orders
"""

RESULTS = """
SELECT o_orderkey AS item_id, CASE o_orderkey % 5 WHEN 0 THEN 'NO_MATCH' WHEN 1 THEN 'MATCH_FOUND' WHEN 2 THEN 'LOW_CONFIDENCE' WHEN 3 THEN 'MATCH_FOUND' ELSE 'AMBIGUOUS' END AS status,
       CASE WHEN o_orderkey % 5 IN (0, 4) THEN NULL ELSE CAST(o_custkey * 7 % 3000 + o_orderkey % 400 - 100 AS DOUBLE) END AS x,
       CASE WHEN o_orderkey % 5 IN (0, 4) THEN NULL ELSE CAST(o_custkey * 11 % 3000 + o_orderkey % 90 AS DOUBLE) END AS y
FROM orders WHERE o_orderkey % 10 <> 7
"""

BOXES = """
SELECT s_suppkey AS ref_id, (s_suppkey % 200) - 1e2 AS north, (s_suppkey % 170) - 1e2 AS south, (s_suppkey % 360) - 18e1 AS west, (s_suppkey * 7 % 380) - 19e1 AS east,
       CAST(s_suppkey % 5 * 600 AS INT) AS width, CAST((s_suppkey % 7) * 500 AS INT) AS height, CAST(s_suppkey * 3 % 500 AS DOUBLE) AS px, CAST(s_suppkey * 5 % 400 AS DOUBLE) AS py
FROM supplier
"""

PLACES = """
SELECT o_orderkey AS job_id, r.representation AS representation, CAST(o_custkey % 900 AS DOUBLE) + r.d * (o_orderkey % 37) AS x, CAST(o_custkey * 3 % 900 AS DOUBLE) + r.d * (o_orderkey % 23) AS y,
       (o_orderkey % 10 + r.d) / 12e0 AS geo, (o_orderkey + r.d) % 4 <> 0 AS verified, r.w - (o_orderkey % 6) * 0.1e0 AS weight
FROM orders CROSS JOIN (SELECT 'rgb' AS representation, 0 AS d, 0.4e0 AS w UNION ALL SELECT 'structural', 1, 0.25e0 UNION ALL SELECT 'map', 2, 0.15e0) r
WHERE NOT (o_orderkey % 11 = 0 AND r.d = 0)
"""

#: The winning place of a job and the estimates of its other representations; jobs without an rgb row have none.
BEST_PLACES = f"""
SELECT job_id, (job_id % 97) / 97e0 AS similarity, CAST(job_id % 300 AS INT) AS raw_matches, CAST(job_id % 200 AS INT) AS inliers, (job_id % 200) / 300e0 AS ratio,
       CASE WHEN job_id % 5 <> 0 THEN (job_id % 40) / 7e0 END AS error, verified AS valid, geo, x, y, 20e0 + job_id % 60 AS radius
FROM ({PLACES}) p WHERE representation = 'rgb'
"""

ESTIMATES = f"""
SELECT job_id, representation, CAST(job_id % 150 AS INT) AS raw_matches, CAST(job_id % 100 AS INT) AS inliers, (job_id % 100) / 150e0 AS ratio,
       (job_id % 30) / 11e0 AS error, verified AS valid, geo, x, y
FROM ({PLACES}) p WHERE representation <> 'rgb' AND NOT (job_id % 9 = 0 AND representation = 'map')
"""

JOBS = "SELECT o_orderkey AS job_id, o_orderdate AS started, o_orderstatus AS state FROM orders"

HISTORY = "SELECT o_custkey AS run, o_orderkey AS epoch, o_totalprice AS total FROM orders"

_TABLES = {"lineitem", "customer", "part", "events", "orders", "supplier", "embeddings"}


def read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The stand-in's rows; only the tables that its SQL names are opened."""
    return read_from(spark, sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if re.search(rf"\bFROM {t}\b", sql)})


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CANDIDATES, dealt by job before anything is grouped: all that a job's operators group, order and join by its id stays where it is."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return read_from(spark, CANDIDATES, lineitem=lineitem.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey"))


def read_from(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """The stand-in's rows over the given tables, which may be streams."""
    for t in tables:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **tables)
