"""Writers of results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_tsv(df: DataFrame, path: str, *by: str) -> None:
    """A folder of TSV parts with headers; null is an empty cell and nothing is quoted. With `by`, a folder for each of its values."""
    w = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).write
    (w.partitionBy(*by) if by else w).mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("nullValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def bundle(s1: DataFrame, matches: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matching, candidate) result frames of (s1_id, cand_id) pairs: one row for every record of source 1, ids sorted.

    Matches of a record join its candidates if it has any, so the first list is part of the second.
    """
    listed = lambda df, name: df.groupBy("s1_id").agg(F.collect_set("cand_id").alias(name))
    both = s1.select("s1_id").join(listed(matches, "m"), "s1_id", "left").join(listed(candidates, "c"), "s1_id", "left")
    cell = lambda c: F.coalesce(F.array_join(F.sort_array(c), ","), F.lit(""))
    none = F.array().cast("array<string>")
    union = F.when(F.col("c").isNotNull(), F.array_union("c", F.coalesce("m", none)))
    return (
        both.select(F.col("s1_id").alias("source1_entity_id"), cell(F.col("m")).alias("matched_entity_ids")),
        both.select(F.col("s1_id").alias("source1_entity_id"), cell(union).alias("candidate_entity_ids")),
    )


def write_bundle(matching: DataFrame, candidate: DataFrame, path: str) -> None:
    """Both result frames as TSV folders below path."""
    write_tsv(matching, f"{path}/matching_results.tsv")
    write_tsv(candidate, f"{path}/candidate_pairs.tsv")


def metrics_json(one_row: DataFrame) -> str:
    """A one-row metric frame as a JSON document."""
    return json.dumps(one_row.limit(1).collect()[0].asDict(recursive=True), default=str, sort_keys=True)
