"""Every query with a DuckDB statement gives the same rows as that statement."""

import glob
import math
import os

import duckdb
import pytest

from tilewright import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert rows or name in ("g7_target_coverage", "t6_placements")
    if name in ORACLE:
        rel = duck.sql(ORACLE[name])
        assert sorted(rel.columns) == columns
        at = [rel.columns.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize(("name", "height"), [("b6_representatives", 74_001), *[("j15_resample_average", h) for h in (501, 502, 503, 3)]])
def test_query_on_another_height(spark, tmp_path, name, height):
    """Rasters of more than 10,000 tiles, and of heights that 4 does not divide."""
    path = str(tmp_path / "embeddings.parquet")
    vector = "transform(sequence(0, 63), k -> CAST(sin(id * 64 + k) AS FLOAT))" if height < 1000 else "array_repeat(CAST(0 AS FLOAT), 64)"
    spark.range(height).selectExpr("id AS vec_id", f"{vector} AS embedding").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    rel = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})")
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_fixture_has_every_class(spark):
    got = {r.status: r.n for r in QUERIES["g5_tile_filter"](spark, SF).groupBy("status").count().withColumnRenamed("count", "n").collect()}
    assert set(got) == {"valid", "background_only", "rgb_invalid"}
    light = {r.illumination for r in QUERIES["g14_shadow_area"](spark, SF).collect()}
    assert light == {"sun", "mixed", "shadow"}


@pytest.mark.parametrize("name", ["g3_baselines", "j1_cells_in_tiles", "x1_proximity", "s1_split"])
def test_partition_count_does_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(repr, QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
