"""Staged and published tables: a failing writer leaves what is there readable."""

import pytest
from pyspark.sql import functions as F

from shopgrain.sources import versions, writers


def rows(spark, *values):
    return spark.createDataFrame([(v, str(v)) for v in values], "k int, v string")


def keys(df):
    return sorted(r["k"] for r in df.collect())


def broken(df):
    return df.withColumn("v", F.when(F.col("k") > 1, F.raise_error(F.lit("bad row"))).otherwise(F.col("v")))


def test_failing_writes_leave_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    assert keys(writers.write_verified(rows(spark, 1, 2), path)) == [1, 2]
    with pytest.raises(writers.WriteCheckError):
        writers.write_verified(rows(spark, 3), path, expected_rows=5)
    with pytest.raises(Exception, match="bad row"):
        writers.write_verified(broken(rows(spark, 1, 2, 3)), path)
    assert keys(spark.read.parquet(path)) == [1, 2]
    assert [p.name for p in tmp_path.iterdir()] == ["t.parquet"], "nothing is left beside the table"
    writers.write_csv(rows(spark, 1), f"{tmp_path}/c")
    with pytest.raises(Exception, match="bad row"):
        writers.write_csv(broken(rows(spark, 1, 2)), f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 1


def test_a_table_can_be_made_from_itself(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    t = writers.write_verified(rows(spark, 1, 2), path)
    assert keys(writers.write_verified(t.where("k = 2").unionByName(rows(spark, 7)), path)) == [2, 7]


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/p"
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path)
    assert versions.history(spark, path).count() == 0
    assert versions.publish(rows(spark, 1, 2), path) == 1
    before = versions.read_version(spark, path)
    assert versions.publish(rows(spark, 3), path, partition_by=("k",)) == 2
    with pytest.raises(versions.WriteCheckError):
        versions.publish(rows(spark, 4), path, expected_rows=9)
    with pytest.raises(Exception, match="bad row"):
        versions.publish(broken(rows(spark, 5)), path)
    assert keys(versions.read_version(spark, path)) == [3] and versions.read_version(spark, path).columns == ["k", "v"]
    assert keys(before) == keys(versions.read_version(spark, path, 1)) == [1, 2], "readers of an old version are not disturbed"
    assert len([p for p in (tmp_path / "p").iterdir()]) == 3, "two versions and the manifest"
    assert versions.expire(spark, path, 1) == 1 and [r["version"] for r in versions.history(spark, path).collect()] == [2]
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path, 1)
    with pytest.raises(ValueError):
        versions.expire(spark, path, 0)


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    """The other writer enters version 1 between this one's look at the manifest and its own entry."""
    path = f"{tmp_path}/p"
    look, first = versions.history, []

    def history(s, p):
        seen = spark.createDataFrame(look(s, p).collect(), versions._MANIFEST)
        if not first:
            first.append(1)
            versions.publish(rows(spark, 1), path)
        return seen

    monkeypatch.setattr(versions, "history", history)
    with pytest.raises(versions.WriteCheckError, match="another writer"):
        versions.publish(rows(spark, 2), path)
    monkeypatch.undo()
    assert keys(versions.read_version(spark, path)) == [1]
