"""The dataframe baseline: exact and suffix joins, one-pass assignment, result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entwine.operators.select import MOST, one_pass, top_candidates
from entwine.sources.sinks import bundle


#: Candidates that a record's list holds at most, beside its matches.
FIRST = 50


def _by(recs: DataFrame) -> list[tuple[DataFrame, list[str], float]]:
    """Records that take part, their key and its confidence, for full names and for shortened ones that differ from them."""
    r = recs.select("src", "id", "country", "name_norm", "name_norm_suf")
    of = lambda column, conf, when: (r.filter((F.octet_length(column) >= 3) & when), ["country", column], conf)
    return [of("name_norm", 0.95, F.lit(True)), of("name_norm_suf", 0.88, F.col("name_norm_suf") != F.col("name_norm"))]


def _side(x: DataFrame, key: list[str], first: bool) -> DataFrame:
    return x.filter("src = 1" if first else "src > 1").select(*key, F.col("id").alias("s1_id" if first else "cand_id"))


def joined(recs: DataFrame) -> DataFrame:
    """(s1_id, cand_id, conf) of equal names, and of equal shortened names that differ from the full ones on both sides."""
    one, two = (_side(x, key, True).join(_side(x, key, False), key).select("s1_id", "cand_id", F.lit(conf).alias("conf")) for x, key, conf in _by(recs))
    return one.unionByName(two).groupBy("s1_id", "cand_id").agg(F.max("conf").alias("conf"))


def first_candidates(recs: DataFrame, most: int = FIRST) -> DataFrame:
    """top_candidates(joined(recs), most), made from the first `most` candidates of every key only.

    All records of a key share its candidates in one order. Those of a full name come before those of a shortened one, and of the
    first `most` of a shortened name the ones that a record has by its full name already are as many as its list is longer.
    """
    out = None
    for x, key, conf in _by(recs):
        c = _side(x, key, False).distinct().withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("cand_id"))).filter(F.col("r") <= most)
        lists = c.groupBy(*key).agg(F.collect_list("cand_id").alias("c"))
        pairs = _side(x, key, True).join(lists, key).select("s1_id", F.explode("c").alias("cand_id"), F.lit(conf).alias("conf"))
        out = pairs if out is None else out.unionByName(pairs)
    return top_candidates(out.groupBy("s1_id", "cand_id").agg(F.max("conf").alias("conf")), most)


def best_records(recs: DataFrame, most: int = MOST) -> DataFrame:
    """one_pass(joined(recs), most), made from the first record of every key only: a candidate of the key can't prefer another."""
    out = None
    for x, key, conf in _by(recs):
        first = _side(x, key, True).groupBy(*key).agg(F.min("s1_id").alias("s1_id"))
        pairs = _side(x, key, False).join(first, key).select("s1_id", "cand_id", F.lit(conf).alias("conf"))
        out = pairs if out is None else out.unionByName(pairs)
    return one_pass(out, most)


def baseline(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matching, candidate) result frames."""
    s1 = recs.filter("src = 1").select(F.col("id").alias("s1_id"))
    return bundle(s1, best_records(recs), first_candidates(recs))
