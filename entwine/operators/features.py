"""Similarity features of candidate pairs. Grams and token sets are made once a record, before the pair join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entwine.functions.sets import containment, dice, jaccard, ngrams, overlap, share_of

# The model's features, in its order.
MODEL = (
    "name_tok_jac", "name_contain_q", "name_contain_c", "name_char2", "name_char3", "addr_tok_jac", "addr_contain_q", "addr_contain_c", "addr_char2", "addr_char3",
    "num_overlap", "rare_shared", "pool_name_eq", "pool_addr_eq", "pool_both_eq", "pool_ntok_eq", "pool_atok_eq", "pool_addr_any_missing", "is_us",
)


def with_grams(recs: DataFrame) -> DataFrame:
    cols = {f"{c}_c{n}": ngrams(F.col(f"{c}_norm"), n) for c in ("name", "addr") for n in (2, 3)}
    return recs.select("id", "country", "name_norm", "name_norm_suf", "addr_norm", "addr_missing", "name_toks", "addr_toks", "addr_nums", *[v.alias(k) for k, v in cols.items()])


def paired(cands: DataFrame, recs: DataFrame) -> DataFrame:
    g = with_grams(recs)
    q = g.select(F.col("id").alias("s1_id"), *[F.col(c).alias(f"q_{c}") for c in g.columns if c != "id"])
    c = g.select(F.col("id").alias("cand_id"), *[F.col(c).alias(f"c_{c}") for c in g.columns if c != "id"])
    return cands.join(q, "s1_id").join(c, "cand_id")


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def pair_features(cands: DataFrame, recs: DataFrame) -> DataFrame:
    """s1_id, cand_id, mask and the features of both names, addresses and numbers, and the model's directional ones."""
    q, c = (lambda n: F.col(f"q_{n}")), (lambda n: F.col(f"c_{n}"))
    both = (q("addr_norm") != "") & (c("addr_norm") != "")
    addr = lambda x: F.when(both, x).otherwise(0.0)
    nums = F.size(F.array_intersect(q("addr_nums"), c("addr_nums")))
    numbered = (F.size(q("addr_nums")) > 0) & (F.size(c("addr_nums")) > 0)
    end = lambda i: _flag(numbered & (F.try_element_at(q("addr_nums"), F.lit(i)) == F.try_element_at(c("addr_nums"), F.lit(i))))
    same = lambda a, b: (F.size(a) > 0) & (F.size(a) == F.size(b)) & (F.size(F.array_intersect(a, b)) == F.size(a))
    name_eq, addr_eq = (q("name_norm") != "") & (q("name_norm") == c("name_norm")), (q("addr_norm") != "") & (q("addr_norm") == c("addr_norm"))
    cols = {
        "name_eq": _flag(name_eq),
        "name_suf_eq": _flag((q("name_norm_suf") != "") & (q("name_norm_suf") == c("name_norm_suf"))),
        "name_tok_jac": jaccard(q("name_toks"), c("name_toks")),
        "name_char2": dice(q("name_c2"), c("name_c2")),
        "name_char3": dice(q("name_c3"), c("name_c3")),
        "name_contain": containment(q("name_toks"), c("name_toks")),
        "name_len_diff": F.abs(F.char_length(q("name_norm")) - F.char_length(c("name_norm"))).cast("double"),
        "name_tok_diff": F.abs(F.size(q("name_toks")) - F.size(c("name_toks"))).cast("double"),
        "addr_missing": _flag(c("addr_norm") == ""),
        "addr_eq": addr(_flag(addr_eq)),
        "addr_tok_jac": addr(jaccard(q("addr_toks"), c("addr_toks"))),
        "addr_char2": addr(dice(q("addr_c2"), c("addr_c2"))),
        "addr_char3": addr(dice(q("addr_c3"), c("addr_c3"))),
        "addr_contain": addr(containment(q("addr_toks"), c("addr_toks"))),
        "addr_len_diff": addr(F.abs(F.char_length(q("addr_norm")) - F.char_length(c("addr_norm"))).cast("double")),
        "num_overlap": nums.cast("double"),
        "num_overlap_ratio": nums / F.greatest(F.size(q("addr_nums")), F.size(c("addr_nums")), F.lit(1)),
        "first_num_match": end(1),
        "last_num_match": end(-1),
        "ch_count": F.bit_count("mask").cast("double"),
        "name_contain_q": share_of(q("name_toks"), c("name_toks")),
        "name_contain_c": share_of(c("name_toks"), q("name_toks")),
        "addr_contain_q": addr(share_of(q("addr_toks"), c("addr_toks"))),
        "addr_contain_c": addr(share_of(c("addr_toks"), q("addr_toks"))),
        "rare_shared": overlap(q("name_toks"), c("name_toks")),
        "pool_name_eq": _flag(name_eq),
        "pool_addr_eq": _flag(addr_eq),
        "pool_both_eq": _flag(name_eq & addr_eq),
        "pool_ntok_eq": _flag(same(q("name_toks"), c("name_toks"))),
        "pool_atok_eq": _flag(same(q("addr_toks"), c("addr_toks"))),
        "pool_addr_any_missing": _flag((c("addr_missing") == 1) | (q("addr_norm") == "")),
        "is_us": _flag(F.lower(q("country")).isin("us", "usa", "united states")),
    }
    return paired(cands, recs).select("s1_id", "cand_id", F.col("q_country").alias("country"), "mask", *[v.alias(k) for k, v in cols.items()])


def rare_vocabulary(recs: DataFrame, least: int = 3, most: int = 4000) -> DataFrame:
    """(token, df): name tokens by the number of their occurrences in records."""
    t = recs.select(F.explode(F.filter(F.split("name_norm_suf", " "), lambda x: x != "")).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df").between(least, most))


def rare_tokens(recs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, rare): the distinct tokens of a record's name that the vocabulary has, where there are any."""
    t = recs.select("id", F.explode(F.array_distinct(F.filter(F.split("name_norm_suf", " "), lambda x: x != ""))).alias("token"))
    return t.join(vocabulary, "token", "left_semi").groupBy("id").agg(F.collect_set("token").alias("rare"))


def shared_rare(pairs: DataFrame, recs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(s1_id, cand_id, rare_shared): tokens of the vocabulary that both names have, 0 included."""
    own = rare_tokens(recs, vocabulary)
    p = pairs.join(own.select(F.col("id").alias("s1_id"), F.col("rare").alias("a")), "s1_id", "left").join(own.select(F.col("id").alias("cand_id"), F.col("rare").alias("b")), "cand_id", "left")
    return p.select("s1_id", "cand_id", F.coalesce(F.size(F.array_intersect("a", "b")), F.lit(0)).cast("long").alias("rare_shared"))
