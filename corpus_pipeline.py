"""A training corpus from raw documents: quality, near duplicates, benchmark passages, source mix, shards.

Every stage works on all rows that it gets. Rows travel as structs, so columns of any name pass unchanged (only sharding replaces
columns named slot and shard). Defined results common to all stages: an empty table gives an empty table; rows that repeat or
lack an id are rows of their own; null texts are empty texts; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.llm.common import WORD, packed, row_id, table, text_key, written
from entwine.llm.decontamination import decontaminate
from entwine.llm.mixing import mix
from entwine.llm.near_dedup import near_duplicate_rows
from entwine.llm.quality import THRESHOLD, learn, score
from entwine.llm.sharding import shard


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the documents that it gets, scores at the threshold or above.

    Empty and null texts have a score as any text. Without usable labels of both kinds there is no rule to reject by, and all stay.
    Equal texts get equal scores, so there are no ties to break.
    """
    model = learn(docs, table(spark, sf_dir, "labels"))
    if not model[1]:
        return docs
    rows = docs.select(packed(docs), "text")
    return score(rows, model, "row").filter(F.col("score") >= THRESHOLD).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the first by (doc_id with null last, digest of the text), and every row without words.

    Of rows that are equal in id and text any one stays, with its other columns. Null texts have no words, so they stay.
    """
    kept = near_duplicate_rows(docs).filter("kept AND n_shingles > 0").select(row_id("doc_id").alias("uid"), "th")
    some = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = docs.filter(some).select(packed(docs), row_id("doc_id").alias("uid"), text_key("text").alias("th"))
    # Equal rows become one before they travel, so that a text of very many copies is no large group.
    rows = rows.dropDuplicates(["uid", "th"]).join(written(kept, "kept").hint("merge"), ["uid", "th"], "left_semi")
    return rows.select("row.*").unionByName(docs.filter(~some))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark. Null, empty and short texts hold none and stay; repeated rows go or stay together."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times. Texts without words have no size and are taken 0 times; a null source
    is a source of its own; which of equal rows are taken is settled by their position."""
    # The rows go along, so that rows that share id, source and text keep their own numbers of times.
    rows = mix(docs, carry=packed(docs)).filter("times > 0")
    return rows.select(F.col("carried").alias("row"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot and shard. Rows without an id share a slot, and so do rows of one id."""
    return shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Training and sketches are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
