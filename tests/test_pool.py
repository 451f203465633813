"""The labelled pool is whole: a channel of more than 250,000 pairs."""

import pytest
from pyspark.sql import functions as F

from entwine import pool_queries  # noqa: F401
from entwine import queries as q

N = 130_000  # records of each source, in 8 countries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Texts and names of their own, so that the only channel is that of random pairs: one of each other source for every record."""
    path = tmp_path_factory.mktemp("pool")
    i = F.col("id")
    spark.range(3 * N).select(i.alias("doc_id"), F.concat(F.lit("n"), i.cast("string")).alias("text"), F.concat(F.lit("c"), (i % 8).cast("string")).alias("lang"), F.lit("web").alias("source"), F.lit(9).cast("long").alias("n_chars")).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_training_pool_is_whole(spark, folder):
    got = q.queries()["training_pool"](spark, folder).groupBy("channel", "msrc").agg(F.count("*"), F.count_distinct("s1_id", "cand_id")).collect()
    assert sorted(map(tuple, got)) == [("n_random", "S2", N, N), ("n_random", "S3", N, N)]


def test_a01b_pool_separation_counts_the_whole_pool(spark, folder):
    got = q.queries()["a01b_pool_separation"](spark, folder).select("label", "n").distinct().collect()
    assert list(map(tuple, got)) == [(False, 2 * N)]


def test_a03_ambiguity_channels_counts_the_whole_pool(spark, folder):
    got = q.queries()["a03_ambiguity_channels"](spark, folder).select("channel", "n").collect()
    assert list(map(tuple, got)) == [("n_random", 2 * N)]


def test_training_flags_are_of_the_whole_pool(spark, folder):
    assert q.queries()["training_flags"](spark, folder).count() == 2 * N


def test_training_features_are_of_the_whole_pool(spark, folder):
    assert q.queries()["training_features"](spark, folder).count() == 2 * N


def test_training_features_make_each_set_once_a_pair(spark, sf):
    plan = q.queries()["training_features"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    pairs = plan[: plan.index("Join")]  # what is computed on pairs
    assert pairs.count("transform(sequence(") == 8  # grams of two lengths, of names and addresses, on both sides
    assert pairs.count("array_intersect(") == 8  # six kinds of sets, numbers, rare tokens


def test_a01b_pool_separation_makes_its_pairs_once(spark, sf):
    plan = q.queries()["a01b_pool_separation"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" in plan and "array_intersect(" not in plan  # means and quantiles read the written rows, as the AUC does
