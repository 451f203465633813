"""Candidate pairs by six kinds of shared keys, with a bitmask of the kinds.

A record's keys of all kinds come from one scan. Posting lists of candidates over their cap are dropped by a count before
any pair is made; the pair join is an equi-join on (country, channel, key), so the data spread over keys, never over countries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entwine.functions.text import ADDR_STOP, NAME_STOP

NAME, SUFFIX, NAME_TOKEN, NUMBER, ADDRESS, ADDRESS_TOKEN = 1, 2, 4, 8, 16, 32


@dataclass(frozen=True)
class Caps:
    """The longest posting list that is used, by channel, and the candidates that a query keeps."""

    name: int = 150
    name_token: int = 250
    number: int = 120
    address: int = 50
    address_token: int = 100
    budget: int = 150

    def of(self, channel: Column) -> Column:
        return F.when(channel.isin(NAME, SUFFIX), self.name).when(channel == NAME_TOKEN, self.name_token).when(channel == NUMBER, self.number).when(channel == ADDRESS, self.address).otherwise(self.address_token)


def _keys(suffix: Column) -> Column:
    one = lambda bit, when, key: F.when(when, F.array(F.struct(F.lit(bit).alias("channel"), key.alias("key"))))
    many = lambda bit, when, keys: F.when(when, F.transform(keys, lambda k: F.struct(F.lit(bit).alias("channel"), k.alias("key"))))
    has_addr = F.col("addr_missing") == 0
    none = F.array().cast("array<struct<channel:int,key:string>>")
    return F.concat(
        F.coalesce(one(NAME, F.col("name_norm") != "", F.col("name_norm")), none),
        F.coalesce(one(SUFFIX, suffix, F.col("name_norm_suf")), none),
        F.coalesce(one(ADDRESS, has_addr & (F.char_length("addr_norm") >= 5), F.col("addr_norm")), none),
        F.coalesce(many(NAME_TOKEN, F.lit(True), F.filter("name_toks", lambda t: (F.char_length(t) >= 3) & ~t.isin(*NAME_STOP))), none),
        F.coalesce(many(ADDRESS_TOKEN, has_addr, F.filter("addr_toks", lambda t: (F.char_length(t) >= 4) & ~t.isin(*ADDR_STOP) & ~t.rlike(r"\p{Nd}"))), none),
        F.coalesce(many(NUMBER, F.lit(True), F.filter("addr_nums", lambda t: F.char_length(t) >= 2)), none),
    )


def query_postings(recs: DataFrame) -> DataFrame:
    q = recs.filter("src = 1").select("country", F.col("id").alias("s1_id"), F.explode(_keys(F.col("name_norm_suf") != "")).alias("k"))
    return q.select("country", "k.channel", "k.key", "s1_id")


def candidate_postings(recs: DataFrame) -> DataFrame:
    suffix = (F.col("name_norm_suf") != "") & (F.col("name_norm_suf") != F.col("name_norm"))
    c = recs.filter("src > 1").select("country", F.col("id").alias("cand_id"), F.explode(_keys(suffix)).alias("k"))
    return c.select("country", "k.channel", "k.key", "cand_id")


KEY = ["country", "channel", "key"]


def oversized(postings: DataFrame, caps: Caps = Caps()) -> DataFrame:
    return postings.groupBy(*KEY).agg(F.count("*").alias("size")).filter(F.col("size") > caps.of(F.col("channel")))


def pruned(postings: DataFrame, caps: Caps = Caps()) -> DataFrame:
    return postings.join(oversized(postings, caps).select(*KEY), KEY, "left_anti")


def candidates(recs: DataFrame, caps: Caps = Caps(), postings: DataFrame | None = None) -> DataFrame:
    """(s1_id, cand_id, mask) of all pairs that share a key; postings: pruned ones of the candidates, if they are at hand."""
    pairs = query_postings(recs).join(pruned(candidate_postings(recs), caps) if postings is None else postings, KEY)
    return pairs.groupBy("s1_id", "cand_id").agg(F.bit_or("channel").alias("mask"))


def budgeted(cands: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """At most caps.budget candidates of each query, those of most channels first, ties by id."""
    w = Window.partitionBy("s1_id").orderBy(F.bit_count("mask").desc(), "cand_id")
    return cands.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= caps.budget).drop("r")


def bounded_key_join(q: DataFrame, c: DataFrame, keys: list[str], most: int = 20_000) -> DataFrame:
    """q join c on keys whose numbers of rows multiply to `most` at most."""
    nq, nc = q.groupBy(*keys).agg(F.count("*").alias("nq")), c.groupBy(*keys).agg(F.count("*").alias("nc"))
    good = nq.join(nc, keys).filter(F.col("nq") * F.col("nc") <= most).select(*keys)
    return q.join(good, keys, "left_semi").join(c, keys)


def recall(cands: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: truth pairs, those among the candidates, recall, candidates per query."""
    t = truth.select("s1_id", F.col("matched_id").alias("cand_id")).distinct()
    hit = t.join(cands.select("s1_id", "cand_id").withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
    per = cands.agg(F.count("*").alias("n_cands")).crossJoin(queries.agg(F.count("*").alias("n_queries")))  # one row each
    return hit.crossJoin(per).select("n_true", "n_found", (F.col("n_found") / F.col("n_true")).alias("recall"), (F.col("n_cands") / F.col("n_queries")).alias("mean_candidates"))
