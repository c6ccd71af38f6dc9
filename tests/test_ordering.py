"""Distributed ordering helpers against brute force, on skewed and tied data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alertsift.operators import sampling, splits
from alertsift.operators.ordering import number_rows, running_totals
from alertsift.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 rows; one group has about two thirds of them, scores are heavily tied."""
    rng = np.random.default_rng(5)
    n = 20_000
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "g": np.where(rng.random(n) < 0.66, "hot", rng.integers(0, 50, n).astype(str)),
            "v": np.round(rng.exponential(1.0, n), 2),
            "w": np.where(rng.random(n) < 0.5, 0.0, rng.normal(size=n)),
            "one": 1,
        }
    )
    pdf.loc[rng.random(n) < 0.05, "w"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("w", F.when(~F.isnan("w"), F.col("w"))).repartition(8)
    return pdf, df.cache()


def test_number_rows_matches_pandas(skewed):
    pdf, df = skewed
    got = number_rows(df, ["g"], ["v", "id"], "rn", "n").select("id", "rn", "n").toPandas().set_index("id").sort_index()
    ordered = pdf.sort_values(["g", "v", "id"])
    want = (ordered.groupby("g").cumcount() + 1).sort_index()
    assert (got["rn"].to_numpy() == want.to_numpy()).all()
    assert (got["n"].to_numpy() == pdf.groupby("g")["id"].transform("size").to_numpy()).all()


def test_number_rows_without_group_is_a_permutation(skewed):
    pdf, df = skewed
    got = number_rows(df, [], [F.col("v").desc(), F.col("id")], "rn").select("id", "rn").toPandas()
    want = pdf.sort_values(["v", "id"], ascending=[False, True])["id"].to_numpy()
    assert (got.sort_values("rn")["id"].to_numpy() == want).all()


def test_hot_group_spans_several_ranges(skewed):
    _, df = skewed
    ranged = df.repartitionByRange(8, "g", "v", "id").withColumn("p", F.spark_partition_id())
    assert ranged.where("g = 'hot'").select("p").distinct().count() > 1


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_matches_pandas(skewed, descending):
    pdf, df = skewed
    got = running_totals(df, "v", ["one"], ["g"], descending).toPandas().sort_values(["g", "v"]).reset_index(drop=True)
    table = pdf.groupby(["g", "v"], as_index=False)["one"].sum().sort_values(["g", "v"], ascending=[True, not descending])
    table["cum"] = table.groupby("g")["one"].cumsum()
    table = table.sort_values(["g", "v"]).reset_index(drop=True)
    assert (got["cum_one"] == table["cum"]).all()
    assert (got["total_one"] == table.groupby("g")["one"].transform("sum")).all()


@pytest.mark.parametrize("cells", [10**9, 400])
def test_exact_quantiles_both_routes(skewed, cells):
    """The refining route (few values allowed per task) gives the very same numbers."""
    pdf, df = skewed
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, {"v": F.col("v"), "w": F.col("w"), "none": F.lit(None)}, probs, direct_cells=cells)
    assert got["none"] == [None] * len(probs)
    np.testing.assert_allclose(got["v"], pdf["v"].quantile(probs), rtol=1e-12)
    np.testing.assert_allclose(got["w"], pdf["w"].quantile(probs), rtol=1e-12, atol=1e-15)


def test_sample_sizes_are_exact_for_hot_and_small_classes(skewed):
    pdf, df = skewed
    got = sampling.sample_upto(df, 500, ["g"], "id").groupBy("g").count().toPandas().set_index("g")["count"]
    want = pdf.groupby("g").size().clip(upper=500)
    assert got.sort_index().to_dict() == want.sort_index().to_dict()


def test_sample_does_not_depend_on_input_order(skewed):
    _, df = skewed
    a = {r.id for r in sampling.sample_exact(df, 100, "id").select("id").collect()}
    b = {r.id for r in sampling.sample_exact(df.orderBy(F.rand(3)).repartition(3), 100, "id").select("id").collect()}
    assert a == b and len(a) == 100


def test_short_pool_is_an_error(skewed):
    _, df = skewed
    with pytest.raises(ValueError, match="need"):
        sampling.sample_exact(df.limit(10), 11, "id")


def test_copies_of_a_key_are_reported_not_miscounted(spark):
    copies = spark.range(1000).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("id"))
    hashes = sampling.hash_cuts(copies, [], "id", {"cut": F.lit(10)}).first()
    rows = copies.where(sampling.hash_order(F.col("id")) <= hashes["cut"]).count()
    assert rows == 10 + hashes["excess"]


def test_balanced_sample_checks_classes(skewed):
    _, df = skewed
    with pytest.raises(ValueError, match="classes"):
        sampling.sample_balanced(df, "id", "g")
    five = df.where("g IN ('hot', '1', '2', '3', '4')")
    assert sampling.sample_balanced(five, "id", "g", total=50).groupBy("g").count().where("count <> 10").count() == 0
    with pytest.raises(ValueError, match="null"):
        sampling.sample_balanced(five.withColumn("g", F.when(F.col("g") != "1", F.col("g"))), "id", "g")


def test_folds_are_contiguous_in_time(skewed):
    _, df = skewed
    folded = splits.temporal_folds(df, "g", ["v", "id"])
    bad = folded.groupBy("g", "temporal_fold").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    pdf = bad.toPandas().sort_values(["g", "temporal_fold"])
    for _, part in pdf.groupby("g"):
        assert (part["lo"].to_numpy()[1:] >= part["hi"].to_numpy()[:-1]).all()


def test_group_split_keeps_groups_whole_and_falls_back(skewed):
    _, df = skewed
    assert splits.group_overlap(splits.group_split(df, "g"), "g").isEmpty()
    fallback = splits.group_split(df, None, 0.2, strata=["g"], key="id")
    assert abs(fallback.where("split = 'test'").count() / 20_000 - 0.2) < 0.01


def test_split_map_must_cover_all_rows(spark):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    assigned = spark.createDataFrame([(1, "train")], "id long, split string")
    with pytest.raises(ValueError, match="no split"):
        splits.apply_split_map(df, assigned, "id")


def test_benign_validation_needs_two_rows(spark):
    with pytest.raises(ValueError, match="two"):
        splits.fit_validation_split(spark.range(1), "id")
    assert splits.fit_validation_split(spark.range(2), "id").agg(F.sum("is_validation")).first()[0] == 1
