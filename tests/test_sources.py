import pytest
from pyspark.sql import functions as F

from marquee.sources import tables as T
from marquee.streaming.popularity import windowed_counts


def test_reads_latin1_with_missing_values(spark, tmp_path):
    p = tmp_path / "movie_actors.dat"
    p.write_bytes("movieID\tactorID\tactorName\tranking\n1\ta\tJosé \"x\tz\n2\tN/A\t\\N\t3\n".encode("latin-1"))
    got = T.read_table(spark, str(p), T.SCHEMAS["movie_actors"]).orderBy("_row_id").collect()
    assert [tuple(r)[:4] for r in got] == [(1, "a", 'José "x', None), (2, None, "\\N", 3)]
    assert T.read_table(spark, str(p), T.SCHEMAS["movie_actors"], columns=["movieID"], rename={"movieID": "id"}).columns == ["id", "_row_id"]


def test_empty_table_is_an_error(spark, tmp_path):
    p = tmp_path / "tags.dat"
    p.write_text("id\tvalue\n")
    with pytest.raises(ValueError):
        T.load_tables(spark, {"tags": str(p)})


def test_paths(tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "sub").mkdir()
    assert T.project_root(tmp_path) == tmp_path == T.project_root(tmp_path / "sub")
    assert set(T.file_map(tmp_path)) == set(T.SCHEMAS)


def test_models_and_runs_are_tables(spark, tmp_path):
    T.save_model({"items": spark.range(2)}, {"k": 3}, str(tmp_path / "m"))
    tables, params = T.load_model(spark, str(tmp_path / "m"), ["items"])
    assert tables["items"].count() == 2 and params == {"k": 3}
    with T.RunLog(spark, str(tmp_path / "runs")).start_run("a") as log:
        log.log_params({"k": 3})
        log.log_metrics({"rmse": 0.5})
        log.set_tag("t", 1)
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 3
    with T.RunLog().start_run("b") as log:
        log.log_params({})


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    q = windowed_counts(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("popularity").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.window_start, r.event_type, r.n) for r in df.collect())
    assert key(spark.table("popularity")) == key(windowed_counts(batch))
