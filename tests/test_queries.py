import os

import duckdb
import pytest

import __spark_entry__
from threadmap import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame[columns].itertuples(index=False))


FAST = ["q01_validate_cloud", "q02_feature_moments", "q04_constant_feature", "q07_knn_mutual", "q15_medoids", "q16_duplicate_groups", "q17_ancestry_compose", "q20_project_polyline",
        "q20b_project_batches", "q29_support_mean", "q33_target_kind", "q35_log_scaled", "q36_variable_genes", "q37_angular_sectors", "q38_octilinear_bin", "q43_spearman", "streamed_projection",
        "q45_windowed_events", "q48_grid_lookup", "q49_sliding_windows", "q53_composed_ancestry", "q55_corridor", "q56_location_dispersion", "q60_residual_coordinates", "q63_bridges",
        "q68_replicate_links", "q69_link_supports", "q71_branch_modes", "q72_merged_regions", "q73_greedy_match", "q74_shortest_paths", "q75_refined_paths"]


@pytest.mark.parametrize("name", FAST)
def test_query_agrees_with_its_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    want = duck.sql(core.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 500


def test_streamed_table_of_many_files(spark, tmp_path):
    held = spark.read.parquet(f"{SF}/embeddings.parquet")
    held.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    held.limit(7).write.parquet(str(tmp_path / "embeddings_old.parquet"))
    got, want = (__spark_entry__.queries()[n](spark, str(tmp_path)).toPandas() for n in ("streamed_projection", "q20b_project_batches"))
    assert len(got) == 500 and rows(got) == rows(want)


def test_windowed_stream(spark, tmp_path):
    from threadmap.streaming import apply

    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = apply.windowed_values(apply.read_table(spark, str(tmp_path / "in")), "ts", "event_type", "value")
    running = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination()
    assert spark.table("windows").groupBy().sum("n").first()[0] == 1000


def test_rows_later_than_the_watermark_are_left_out(spark, tmp_path):
    import time

    from threadmap.streaming import apply

    schema = "ts timestamp_ntz, event_type string, value double"
    for i, rows in enumerate([[("2024-01-01 10:00", "a", 1.0), ("2024-01-01 12:00", "a", 1.0)], [("2024-01-01 12:05", "a", 1.0)], [("2024-01-01 10:05", "a", 1.0), ("2024-01-01 12:10", "a", 1.0)]]):
        frame = spark.createDataFrame(rows, "t string, event_type string, value double").selectExpr("CAST(t AS timestamp_ntz) AS ts", "event_type", "value")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    windows = apply.windowed_values(stream, "ts", "event_type", "value")
    windows.writeStream.format("memory").queryName("late").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    got = {r["start"]: r["n"] for r in spark.sql("SELECT date_format(start, 'HH:mm') AS start, max(n) AS n FROM late GROUP BY 1").collect()}
    assert got == {"10:00": 1, "12:00": 3}
