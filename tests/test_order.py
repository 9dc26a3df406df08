"""Row positions on tables of many partitions: each index once, whatever AQE does with the stages."""

import pytest
from pyspark.sql import functions as F

from loomframe import Frame, col

N = 400_000


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    old = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield request.param
    spark.conf.set("spark.sql.adaptive.enabled", old[0])
    spark.conf.set("spark.sql.shuffle.partitions", old[1])


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Rows of two columns of 128 characters in many files, k = 3 * rank."""
    path = str(tmp_path_factory.mktemp("wide") / "t")
    t = spark.range(N).select((F.col("id") * 3).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("a"), F.repeat(F.sha2((-F.col("id")).cast("string"), 256), 2).alias("b"))
    t.repartition(16, "a").write.parquet(path)
    return path


@pytest.fixture
def wide(spark, table):
    return Frame(spark.read.parquet(table)).order_by("k")


def written(f, spark, tmp_path, name="t"):
    f.df.write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


def once(df, index, rank, rows=N):
    """df has `rows` rows, each index from 0 on once, and index is as `rank` says."""
    got = df.agg(F.count(F.lit(1)), F.countDistinct(index), F.min(index), F.max(index), F.sum((F.col(index) != rank).cast("int"))).first()
    assert tuple(got) == (rows, rows, 0, rows - 1, 0)


def test_row_index(spark, wide, adaptive, tmp_path):
    once(written(wide.with_row_index("i"), spark, tmp_path), "i", F.col("k") / 3)


def test_row_number(spark, wide, tmp_path):
    out = written(wide.with_columns(col("k").row_number().alias("n")), spark, tmp_path).withColumn("i", F.col("n") - 1)
    once(out, "i", F.col("k") / 3)


def test_reverse(spark, wide, tmp_path):
    once(written(wide.reverse().with_row_index("i"), spark, tmp_path), "i", F.lit(N - 1) - F.col("k") / 3)


def test_slice(spark, wide, tmp_path):
    out = written(wide.slice(1000, -2000), spark, tmp_path).withColumn("i", (F.col("k") / 3 - 1000).cast("long"))
    once(out, "i", F.col("k") / 3 - 1000, N - 3000)


def test_hstack(spark, wide, adaptive, tmp_path):
    other = Frame(spark.range(N).select((F.col("id") * 7).alias("z"), F.repeat(F.lit("y"), 200).alias("w")).repartition(9)).order_by("z")
    out = written(wide.hstack(other), spark, tmp_path).withColumn("i", (F.col("z") / 7).cast("long"))
    once(out, "i", F.col("k") / 3)


def test_names_that_look_internal(spark):
    f = Frame(spark.createDataFrame([(1, 2, 3, [4, 5])], "a int, __row_id int, __size int, __pos array<int>"))
    assert f.columns == ["a", "__row_id", "__size", "__pos"]
    assert f.sort("a").columns == f.columns and f.with_row_index("__i").columns == ["__i", *f.columns]
    assert f.join(f, on="a").columns == ["a", "__row_id", "__size", "__pos", "__row_id_right", "__size_right", "__pos_right"]
    assert f.explode("__pos").to_dicts() == [{"a": 1, "__row_id": 2, "__size": 3, "__pos": x} for x in (4, 5)]


def test_a_column_without_a_type_keeps_its_place(spark):
    f = Frame(spark.sql("select 1 as a, null as b, 2 as c")).with_row_index("i")
    assert f.columns == ["i", "a", "b", "c"] and f.to_dicts() == [{"i": 0, "a": 1, "b": None, "c": 2}]
