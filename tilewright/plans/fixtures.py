"""Rasters, tiles, histories and trials built from the driver tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import grid as g
from tilewright.operators import stencil

TILE, OVERLAP, REACH = 32, 0.3, 5
WIDTH = 64
POSITIVE = 3.0
SCALES = (1000, 1700, 2300)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def emb(spark: SparkSession, sf: str) -> DataFrame:
    """r, c, x of all cells."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "x")).select("r", F.col("c").cast("long"), F.col("x").cast("double"))


def height(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "embeddings").count()


def grid(spark: SparkSession, sf: str) -> g.Grid:
    return g.Grid.of(height(spark, sf), WIDTH, TILE, OVERLAP)


def banded(cells: DataFrame) -> DataFrame:
    """Cells (r, c, x and others) with the bands b1, b2, b3."""
    black, white = (F.col("r") < 64) & (F.col("c") < 32), (F.col("r") >= 400) & (F.col("c") >= 32)
    band = lambda m: F.when(black, 0).when(white, 255).otherwise(F.pmod(F.floor(F.abs("x") * m), F.lit(256))).cast("double")
    return cells.select("*", *[band(m).alias(f"b{k}") for k, m in enumerate(SCALES, 1)])


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """r, c, x, b1, b2, b3."""
    return banded(emb(spark, sf))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """The rgb raster in long form."""
    bands = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col(f"b{k}").alias("value")) for k in (1, 2, 3)]))
    return wide(spark, sf).select(F.lit("rgb").alias("raster_id"), "r", "c", bands.alias("v")).select("raster_id", F.col("v.band").alias("band"), "r", "c", F.col("v.value").alias("value"))


def mask(spark: SparkSession, sf: str) -> DataFrame:
    return emb(spark, sf).select("r", "c", F.when((F.col("x") > 0.30) & (F.col("r") >= 100), 1).otherwise(0).alias("value"))


def target(spark: SparkSession, sf: str) -> DataFrame:
    """r, c, x, target."""
    near = stencil.proximity(mask(spark, sf).filter("value = 1").select("r", "c"), height(spark, sf), WIDTH, REACH, REACH)
    return emb(spark, sf).join(near, ["r", "c"], "left").select("r", "c", "x", F.coalesce("proximity", F.lit(0)).cast("double").alias("target"))


def pred(spark: SparkSession, sf: str) -> DataFrame:
    """r, c, target, pred."""
    return target(spark, sf).select("r", "c", "target", F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.col("target") + 8 * F.col("x"))).alias("pred"))


def tiled(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return g.in_tiles(df, grid(spark, sf))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """run_id, metric, step, value, ts from events."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("metric"), (F.row_number().over(w) - 1).cast("long").alias("step"), F.col("value").cast("double").alias("value"), "ts", "event_id")


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """study_name, mode, trial_number, state, value, session_started_at, session_id from orders; texts as in a trials file."""
    o = table(spark, sf, "orders")
    m5 = F.pmod("o_orderkey", F.lit(5))
    return o.select(
        F.col("o_orderpriority").alias("study_name"), F.col("o_orderstatus").alias("mode"), F.col("o_orderkey").cast("long").alias("trial_number"),
        F.when(m5 == 0, "PRUNED").when(m5 == 1, "FAIL").otherwise("COMPLETE").alias("state"),
        F.when(F.pmod("o_orderkey", F.lit(7)) == 0, "").otherwise((F.col("o_totalprice").cast("double") / 1e5).cast("string")).alias("value"),
        F.when(F.pmod("o_orderkey", F.lit(11)) == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("session_started_at"),
        F.date_format("o_orderdate", "yyyy-MM").alias("session_id"),
    )


def params(spark: SparkSession, sf: str) -> DataFrame:
    """run_id, key, value, end_time from customer."""
    c = table(spark, sf, "customer")
    kv = F.explode(F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("balance"), F.floor(F.col("c_acctbal").cast("double")).cast("long").cast("string")))
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.max(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("end_time"))
    return c.select(F.col("c_custkey").alias("run_id"), kv.alias("key", "value")).join(last, "run_id", "left")


# DuckDB ---------------------------------------------------------------------------------------------

EMB = "emb AS (SELECT vec_id AS r, CAST(k AS BIGINT) AS c, CAST(embedding[k + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(64)) AS k))"


#: Cells alone, for statements that need no more.
CELLS = "WITH emb AS (SELECT vec_id AS r, CAST(unnest(range(64)) AS BIGINT) AS c, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def _band(k: int, m: int) -> str:
    return f"CASE WHEN r < 64 AND c < 32 THEN 0.0 WHEN r >= 400 AND c >= 32 THEN 255.0 ELSE CAST(CAST(floor(abs(x) * {m}) AS BIGINT) % 256 AS DOUBLE) END AS b{k}"


RGB = "wide AS (SELECT r, c, x, " + ", ".join(_band(k, m) for k, m in enumerate(SCALES, 1)) + " FROM emb)"
TARGET = """ones AS (SELECT r, c FROM emb WHERE x > 0.30 AND r >= 100),
offs AS (SELECT a.v AS dr, b.v AS dc FROM (SELECT unnest(range(-5, 6)) AS v) a, (SELECT unnest(range(-5, 6)) AS v) b WHERE a.v * a.v + b.v * b.v <= 25),
near AS (SELECT o.r + f.dr AS r, o.c + f.dc AS c, min(f.dr * f.dr + f.dc * f.dc) AS d2 FROM ones o, offs f GROUP BY 1, 2),
tgt AS (SELECT e.r, e.c, e.x, CASE WHEN n.d2 IS NULL THEN 0.0 ELSE floor(greatest(0.0, 5.0 - sqrt(n.d2))) END AS target FROM emb e LEFT JOIN near n ON e.r = n.r AND e.c = n.c),
pr AS (SELECT r, c, target, greatest(0.0, least(5.0, target + 8 * x)) AS pred FROM tgt)"""
GRID = """len AS (SELECT max(vec_id) + 1 AS h FROM embeddings),
rs AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS o FROM (SELECT DISTINCT s FROM (SELECT unnest(range(0, h - 31, 22)) AS s FROM len UNION ALL SELECT h - 32 FROM len))),
cs AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS o FROM (SELECT DISTINCT s FROM (SELECT unnest(range(0, 33, 22)) AS s UNION ALL SELECT 32))),
tiles AS (SELECT rs.o * (SELECT count(*) FROM cs) + cs.o AS tile_idx, rs.s AS row_start, rs.s + 32 AS row_end, cs.s AS col_start, cs.s + 32 AS col_end FROM rs, cs)"""
ALL = f"WITH {EMB}, {RGB}, {TARGET}, {GRID}"
TILED = ALL + """, tw AS (SELECT t.tile_idx, w.* FROM tiles t JOIN wide w ON w.r >= t.row_start AND w.r < t.row_end AND w.c >= t.col_start AND w.c < t.col_end),
tt AS (SELECT t.tile_idx, p.r, p.c, p.r - t.row_start AS tr, p.c - t.col_start AS tc, p.target, p.pred FROM tiles t JOIN pr p ON p.r >= t.row_start AND p.r < t.row_end AND p.c >= t.col_start AND p.c < t.col_end)"""
HISTORY = "WITH h AS (SELECT user_id AS run_id, event_type AS metric, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS step, CAST(value AS DOUBLE) AS value, ts, event_id FROM events)"
TRIALS = """WITH t AS (SELECT o_orderpriority AS study_name, o_orderstatus AS mode, CAST(o_orderkey AS BIGINT) AS trial_number,
 CASE o_orderkey % 5 WHEN 0 THEN 'PRUNED' WHEN 1 THEN 'FAIL' ELSE 'COMPLETE' END AS state,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DOUBLE) / 1e5 END AS v,
 CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS started, strftime(o_orderdate, '%Y-%m') AS session_id FROM orders)"""
PARAMS = """WITH ends AS (SELECT o_custkey, max(strftime(o_orderdate, '%Y-%m-%d')) AS end_time FROM orders GROUP BY 1),
p AS (SELECT c.c_custkey AS run_id, k.key, CASE k.key WHEN 'segment' THEN c.c_mktsegment WHEN 'nation' THEN CAST(c.c_nationkey AS VARCHAR) ELSE CAST(CAST(floor(CAST(c.c_acctbal AS DOUBLE)) AS BIGINT) AS VARCHAR) END AS value, e.end_time
 FROM customer c CROSS JOIN (SELECT unnest(['segment', 'nation', 'balance']) AS key) k LEFT JOIN ends e ON e.o_custkey = c.c_custkey)"""
