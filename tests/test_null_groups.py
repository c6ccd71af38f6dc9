"""No row is lost for a null class, key, address or time; number formats keep all digits."""

import pytest
from pyspark.sql import functions as F

from alertsift.operators import classifiers, cleaning, features, flows, mapping, ordering, sampling, splits


@pytest.fixture(scope="module")
def rows(spark):
    label = F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, "a").otherwise("b")
    return spark.range(400).withColumn("label", label).withColumn("ts", (F.col("id") % 50).cast("long")).cache()


def test_splitters_and_numberers_keep_every_row(rows):
    made = {
        "split": splits.stratified_split(rows, ["label"], "id", {"test": 0.2}),
        "upto": sampling.sample_upto(rows, 10_000, ["label"], "id"),
        "folds": splits.temporal_folds(rows, "label", ["ts", "id"]),
        "tail": splits.early_stop_tail(rows, "label", ["ts", "id"]),
        "weight": classifiers.with_class_weight(rows, "label"),
        "number": ordering.number_rows(rows, ["label"], ["id"]),
    }
    for name, df in made.items():
        assert df.count() == 400, name
        assert df.where("label IS NULL").count() == 40, name
    assert made["split"].where("label IS NULL AND split = 'test'").count() == 8
    assert made["folds"].where("label IS NULL").groupBy("temporal_fold").count().count() == 4
    assert made["number"].where("label IS NULL").agg(F.max("row_number")).first()[0] == 40


def test_null_class_gets_its_quota(rows):
    drawn = sampling.sample_budget(rows, 31, "id")
    assert {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()} == {None: 11, "a": 10, "b": 10}
    assert sampling.sample_upto(rows, 5, ["label"], "id").groupBy("label").count().where("count = 5").count() == 3


def test_running_totals_of_a_null_group(rows):
    totals = ordering.running_totals(rows.withColumn("n", F.lit(1)), "ts", ["n"], ["label"])
    assert totals.agg(F.sum("n")).first()[0] == 400
    assert totals.where("label IS NULL").agg(F.max("cum_n")).first()[0] == 40


def test_look_back_keeps_rows_without_time_or_address(spark):
    data = [(1, "x", "y", 10), (2, "x", "y", 20), (3, None, "y", 20), (4, "x", "y", None), (5, None, "y", 20), (6, "x", "y", 20)]
    df = spark.createDataFrame(data, "id long, src string, dst string, ts long")
    got = features.attempts_same_target(df, {"near": 60}, ["src", "dst"], "ts", "id")
    assert {r.id: r.near for r in got.collect()} == {1: 1, 2: 2, 3: None, 4: None, 5: None, 6: 3}


def test_clusters_with_null_key_and_part_of_a_second(spark):
    data = [("f", "a", 0.1), ("f", "a", 0.9), ("f", None, 0.1), ("f", None, None), ("f", None, 0.3)]
    df = spark.createDataFrame(data, "source_file string, `Flow ID` string, ts double")
    got = flows.assign_logical_flow(df, cutoff=0.5).collect()
    assert sorted((str(r["Flow ID"]), str(r.ts), r.cluster) for r in got) == [
        ("None", "0.1", 1), ("None", "0.3", 1), ("None", "None", 2), ("a", "0.1", 1), ("a", "0.9", 2)
    ]
    assert {r.cluster for r in flows.assign_logical_flow(df.where("`Flow ID` = 'a'"), cutoff=1.0).collect()} == {1}


def test_hexadecimal_of_any_length(spark):
    values = ["0x1F", "0x" + "f" * 16, "0x1" + "0" * 16, "0x1G", "0xZZ", "0x", "12", "text", None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, code string")
    got = {r.id: r.code for r in cleaning.hex_to_number(df, ["code"]).collect()}
    assert [got[k] for k in (0, 1, 2, 6)] == [31.0, float(2**64 - 1), float(16**16), 12.0]
    assert len({got[k] for k in (3, 4, 5, 7, 8)}) == 1  # the median


def test_a_row_without_a_split_is_kept(spark):
    sample = spark.createDataFrame([("f1", "train"), ("f2", None), ("f3", "val")], "lfid string, split string")
    aligned = spark.createDataFrame([("k", "test")], f"{mapping.KEY} string, split string")
    cand = spark.createDataFrame([("k", "f1"), ("k", "f2"), ("k", "f3")], f"{mapping.KEY} string, lfid string")
    kept, removed = mapping.remove_leaks(sample, aligned, cand)
    assert [r.lfid for r in kept.collect()] == ["f2"]
    assert sorted(r.lfid for r in removed.collect()) == ["f1", "f3"]
