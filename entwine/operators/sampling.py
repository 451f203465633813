"""Deterministic samples and splits by digests of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entwine.operators.metrics import cardinality
from entwine.plans.running import running


def digest(c: Column, seed: int = 42) -> Column:
    """A non-negative long that any engine with md5 can reproduce."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c)), 1, 15), 16, 10).cast("long")


def hash_sample(df: DataFrame, key: str, percent: int, seed: int = 42) -> DataFrame:
    """All rows of about `percent` of the keys."""
    return df.filter(digest(F.col(key), seed) % 100 < percent)


def hash_head(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(digest(F.col(key), seed), key).limit(n)


def head_of_group(df: DataFrame, group: str, order: list, n: int = 6) -> DataFrame:
    return df.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("r") <= n).drop("r")


def stratified(entities: DataFrame, truth: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """(s1_id, country, bucket): of every country x cardinality stratum max(1, round(n * fraction)) ids in order of the digest."""
    n = truth.groupBy("s1_id").agg(F.count("*").alias("k"))
    s = entities.select("s1_id", "country").join(n, "s1_id", "left").select("s1_id", "country", cardinality(F.coalesce("k", F.lit(0))).alias("bucket"))
    return _first_of_strata(s, fraction, seed)


def _ranked(df: DataFrame, strata: list[str], order: list[str]) -> DataFrame:
    """df with r, a row's rank from 1 within its stratum, and n, the stratum's rows.

    Ranks are running totals over ranges of all strata, so that a large stratum is no task of its own.
    """
    r = running(df, [F.col(c) for c in (*strata, *order)], {"before": F.lit(1)})
    of = r.groupBy(*strata).agg(F.min("before").alias("first"), F.count("*").alias("n"))  # one row a stratum
    return r.join(of, strata).withColumn("r", F.col("before") - F.col("first") + 1).drop("before", "first")


def _first_of_strata(s: DataFrame, fraction: float, seed: int) -> DataFrame:
    r = _ranked(s.withColumn("d", digest(F.col("s1_id"), seed)), ["country", "bucket"], ["d", "s1_id"])
    return r.filter(F.col("r") <= F.greatest(F.lit(1), F.bround(F.col("n") * fraction))).select("s1_id", "country", "bucket")


def nested(entities: DataFrame, truth: DataFrame, fraction: float, mini: float, seed: int = 42) -> DataFrame:
    """A stratified part of the stratified split, by another digest: a smaller split inside the full one."""
    return _first_of_strata(stratified(entities, truth, fraction, seed), mini, seed + 1)


def random_negatives(recs: DataFrame, most: int = 62_500, seed: int = 42) -> DataFrame:
    """(s1_id, cand_id, msrc): for up to `most` records of a country one of source 2 and one of source 3, by rank of digests."""
    r = recs.select("id", "country", "src", digest(F.col("id"), seed).alias("d"))
    r = _ranked(r, ["country", "src"], ["d", "id"]).filter(F.col("r") <= most).drop("n")
    n = r.filter("src > 1").groupBy("country", "src").agg(F.count("*").alias("n"))
    q = r.filter("src = 1").select("country", F.col("id").alias("s1_id"), F.col("r").alias("rq")).join(n, "country").withColumn("r", F.pmod(F.col("rq") - 1, F.col("n")) + 1)
    return q.join(r.select("country", "src", F.col("id").alias("cand_id"), "r"), ["country", "src", "r"]).select("s1_id", "cand_id", F.concat(F.lit("S"), F.col("src").cast("string")).alias("msrc"))


def without_matches(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(truth.select("s1_id", F.col("matched_id").alias("cand_id")), ["s1_id", "cand_id"], "left_anti")
