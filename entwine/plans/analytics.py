"""Analytics over records, truth, pairs and predictions: one plan a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entwine.functions.sets import jaccard, overlap
from entwine.plans.lineage import cut

r6 = lambda c: F.round(c, 6)
share = lambda c: r6(F.avg(c.cast("int")))


def truth_pairs(recs: DataFrame, truth: DataFrame) -> DataFrame:
    """Truth pairs with the columns of both records (q_, c_)."""
    cols = ["country", "name", "addr", "name_norm", "name_norm_suf", "addr_norm", "nlen", "alen", "ntok", "atok", "addr_missing", "name_toks", "addr_toks", "addr_nums"]
    q = recs.select(F.col("id").alias("s1_id"), *[F.col(c).alias(f"q_{c}") for c in cols])
    c = recs.select(F.col("id").alias("matched_id"), *[F.col(x).alias(f"c_{x}") for x in cols])
    return truth.join(q, "s1_id").join(c, "matched_id")


def exact_flags(pairs: DataFrame) -> DataFrame:
    """A-01 rows: boolean equalities and length differences of truth pairs."""
    eq = lambda c, f=lambda x: x: f(F.col(f"q_{c}")) == f(F.col(f"c_{c}"))
    miss = lambda: ((F.col("q_addr_missing") == 1), (F.col("c_addr_missing") == 1))
    a, b = miss()
    flags = {
        "name_raw_eq": eq("name"), "name_lower_eq": eq("name", F.lower), "name_norm_eq": eq("name_norm"), "name_norm_suf_eq": eq("name_norm_suf"),
        "addr_raw_eq": eq("addr"), "addr_lower_eq": eq("addr", F.lower), "addr_norm_eq": eq("addr_norm"), "both_norm_eq": eq("name_norm") & eq("addr_norm"),
        "ntok_eq": eq("ntok"), "atok_eq": eq("atok"), "addr_missing_any": a | b, "addr_missing_both": a & b, "country_eq": eq("country"),
    }
    diff = {f"{n}_diff": F.abs(F.col(f"q_{n}") - F.col(f"c_{n}")) for n in ("nlen", "alen")}
    return pairs.select("s1_id", "matched_id", "msrc", "q_country", *[v.alias(k) for k, v in (flags | diff).items()])


def flag_rates(flags: DataFrame, *by: str) -> DataFrame:
    """A-01: rates of the flags, mean and 90 % quantile of the length differences."""
    names = [f for f, t in flags.dtypes if t == "boolean"]
    return flags.groupBy(*by).agg(F.count("*").alias("n"), *[share(F.col(x)).alias(x) for x in names], r6(F.avg("nlen_diff")).alias("nlen_diff_mean"), r6(F.percentile("nlen_diff", 0.9)).alias("nlen_diff_p90"))


def corruption(pairs: DataFrame, *keep: str) -> DataFrame:
    """A-02: how names and addresses of truth pairs differ, the first kind that holds."""

    def kind(prefix: str, raw: str, empty: list) -> Column:
        q, c = F.col(f"q_{prefix}_toks"), F.col(f"c_{prefix}_toks")
        both, small, all_ = overlap(q, c), F.least(F.size(q), F.size(c)), F.size(F.array_union(q, c))
        eq = lambda n, f=lambda x: x: f(F.col(f"q_{n}")) == f(F.col(f"c_{n}"))
        out = F
        for when, name in [*empty, (eq(raw), "exact"), (eq(raw, F.lower), "case"), (eq(f"{prefix}_norm"), "punct")] + ([(eq("name_norm_suf"), "suffix")] if prefix == "name" else []):
            out = out.when(when, name)
        return out.when(both == all_, "order").when((both == small) & (small > 0), "subtoken").otherwise("heavy")

    a, b = F.col("q_addr_missing") == 1, F.col("c_addr_missing") == 1
    return pairs.select("s1_id", "matched_id", "msrc", "q_country", kind("name", "name", []).alias("name_type"), kind("addr", "addr", [(a & b, "both_missing"), (a | b, "missing")]).alias("addr_type"), *keep)


def corruption_means(pairs: DataFrame) -> DataFrame:
    """A-02: by kind of difference, overall, by country and by source: pairs and their mean similarities."""
    sims = {"name_tok_jac": jaccard(F.col("q_name_toks"), F.col("c_name_toks")), "addr_tok_jac": jaccard(F.col("q_addr_toks"), F.col("c_addr_toks")), "num_overlap": overlap(F.col("q_addr_nums"), F.col("c_addr_nums"))}
    kinds = corruption(pairs.withColumns(sims), *sims)
    one = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value"), F.lit(name).alias("by_name"), value.alias("by_value"))
    rows = [one(kind, name, F.lit("") if name == "all" else F.col(name)) for kind in ("name_type", "addr_type") for name in ("all", "q_country", "msrc")]
    x = kinds.select(*sims, F.explode(F.array(*rows)).alias("x")).select(*sims, "x.*")
    return x.groupBy("kind", "value", "by_name", "by_value").agg(F.count("*").alias("n"), *[r6(F.avg(c)).alias(f"{c}_mean") for c in sims])


def corruption_counts(kinds: DataFrame) -> DataFrame:
    g = kinds.groupingSets([["name_type"], ["addr_type"], ["name_type", "addr_type"]], "name_type", "addr_type").agg(F.count("*").alias("n"))
    return g.select(F.coalesce("name_type", F.lit("*")).alias("name_type"), F.coalesce("addr_type", F.lit("*")).alias("addr_type"), "n")


def ambiguity(labelled: DataFrame) -> DataFrame:
    """A-03: over labelled pairs, how often equal names and addresses are true, and hard negatives."""
    c, label = F.col, F.col("label")
    same, addr = c("pool_name_eq") > 0, c("pool_addr_eq") > 0
    hard = ~label & (c("name_tok_jac") >= 0.8) & ~same
    return labelled.agg(F.count("*").alias("n"), F.count_if(same).alias("n_same_name"), F.count_if(same & label).alias("n_same_name_true"), F.count_if(addr).alias("n_same_addr"), F.count_if(addr & label).alias("n_same_addr_true"), F.count_if(hard).alias("n_hard_negative"))


def evidence(labelled: DataFrame) -> DataFrame:
    """A-04: share of true pairs that each gate keeps, and what addresses and numbers rescue where names differ."""
    t = labelled.filter("label")
    c = F.col
    weak = c("name_tok_jac") < 0.5
    return t.agg(F.count("*").alias("n"), share(c("name_tok_jac") >= 0.5).alias("gate_name_05"), share(c("addr_tok_jac") >= 0.5).alias("gate_addr_05"), share(c("num_overlap") >= 1).alias("gate_num"), share((c("name_tok_jac") >= 0.5) | (c("addr_tok_jac") >= 0.5) | (c("num_overlap") >= 1)).alias("gate_any"), F.count_if(weak & (c("addr_tok_jac") >= 0.5)).alias("rescued_addr"), F.count_if(weak & (c("num_overlap") >= 1)).alias("rescued_num"))


def gates(labelled: DataFrame, features: list[str], cuts: tuple[float, ...]) -> DataFrame:
    """A-04: true and false pairs that each feature keeps at each threshold."""
    grid = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(c).alias("cut"), (F.col(f) >= c).alias("kept")) for f in features for c in cuts])
    x = labelled.select("label", F.explode(grid).alias("x")).select("label", "x.*")
    label, kept = F.col("label"), F.col("kept")
    return x.groupBy("feature", "cut").agg(F.count_if(label).alias("n_true"), F.count_if(label & kept).alias("true_kept"), F.count_if(~label & kept).alias("false_kept"))


def probes(labelled: DataFrame, named: dict[str, Column]) -> DataFrame:
    """M-06: for each mask its rows and the shares of positives and negatives that it takes."""
    from entwine.operators.rules import unpivoted

    u = unpivoted(labelled, named, "label")
    p = F.col("pred")
    return u.groupBy("rule").agg(F.count_if(p).alias("n"), r6(F.avg(F.when(F.col("label"), p.cast("int")))).alias("pos_frac"), r6(F.avg(F.when(~F.col("label"), p.cast("int")))).alias("neg_frac"))


def address_structure(recs: DataFrame) -> DataFrame:
    """A-05: by country, presence of numbers and the lengths of the first and last one."""
    n = F.col("addr_nums")
    first, last = F.try_element_at(n, F.lit(1)), F.try_element_at(n, F.lit(-1))
    return recs.filter("addr_missing = 0").groupBy("country").agg(F.count("*").alias("n"), share(F.size(n) > 0).alias("with_number"), r6(F.avg(F.size(n))).alias("numbers_mean"), share(F.coalesce(F.char_length(first) == 5, F.lit(False))).alias("first_len5"), share(F.coalesce(F.char_length(last) == 6, F.lit(False))).alias("last_len6"))


def number_agreement(pairs: DataFrame) -> DataFrame:
    """A-05 on truth pairs: agreement of first and last numbers over all pairs."""
    q, c = F.col("q_addr_nums"), F.col("c_addr_nums")
    at = lambda i: F.coalesce(F.try_element_at(q, F.lit(i)) == F.try_element_at(c, F.lit(i)), F.lit(False))
    return pairs.groupBy("q_country").agg(F.count("*").alias("n"), share((F.size(q) > 0) & (F.size(c) > 0)).alias("both_given"), share(at(1)).alias("first_eq"), share(at(-1)).alias("last_eq"))


def name_token_stats(recs: DataFrame) -> DataFrame:
    """A-06: by country, numbers of tokens and of distinct ones."""
    t = F.filter(F.split("name_norm", " "), lambda x: x != "")
    return recs.groupBy("country").agg(F.count("*").alias("n"), r6(F.avg("ntok")).alias("ntok_mean"), r6(F.median("ntok")).alias("ntok_median"), F.max("ntok").cast("long").alias("ntok_max"), share(F.size(t) != F.size("name_toks")).alias("with_repeats"))


def top_tokens(recs: DataFrame, k: int = 10) -> DataFrame:
    """A-06: the k most frequent name tokens of every country, ties by token."""
    from pyspark.sql import Window

    t = recs.select("country", F.explode(F.filter(F.split("name_norm", " "), lambda x: x != "")).alias("token")).groupBy("country", "token").agg(F.count("*").alias("n"))
    return t.withColumn("r", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("n"), "token"))).filter(F.col("r") <= k)


def end_tokens(recs: DataFrame, k: int = 5) -> DataFrame:
    """A-06: the k most frequent first and last tokens over all records."""
    from pyspark.sql import Window

    t = F.filter(F.split("name_norm", " "), lambda x: x != "")
    both = recs.select(F.explode(F.array(F.struct(F.lit("first").alias("place"), F.try_element_at(t, F.lit(1)).alias("token")), F.struct(F.lit("last").alias("place"), F.try_element_at(t, F.lit(-1)).alias("token")))).alias("x")).select("x.*").filter("token is not null")
    return both.groupBy("place", "token").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("place").orderBy(F.desc("n"), "token"))).filter(F.col("r") <= k)


def block_partners(recs: DataFrame) -> DataFrame:
    """A-07: by country, how many candidates share the name of a record of source 1."""
    sizes = recs.filter("src > 1 and name_norm <> ''").groupBy("country", "name_norm").agg(F.count("*").alias("n"))
    q = recs.filter("src = 1").select("country", "name_norm").join(sizes, ["country", "name_norm"], "left").select("country", F.coalesce("n", F.lit(0)).alias("n"))
    return q.groupBy("country").agg(F.count("*").alias("queries"), share(F.col("n") == 0).alias("without"), r6(F.avg("n")).alias("mean"), r6(F.percentile("n", 0.5)).alias("p50"), r6(F.percentile("n", 0.9)).alias("p90"), F.max("n").alias("largest"))


def vocabulary_shift(a: DataFrame, b: DataFrame, column: str = "name_toks") -> DataFrame:
    """A-08: distinct tokens of two record frames and those of both."""
    t = lambda df: df.select("country", F.explode(column).alias("token")).distinct()
    both = t(a).withColumn("a", F.lit(1)).join(t(b).withColumn("b", F.lit(1)), ["country", "token"], "full")
    return both.groupBy("country").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count(F.col("a") + F.col("b")).alias("n_both"))


def block_overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """A-08: distinct block keys of two record frames and those of both."""
    return overlap_counts(a, b, column)


def country_sources(recs: DataFrame) -> DataFrame:
    return recs.groupBy("country", "src").agg(F.count("*").alias("n")).select("country", F.col("src").cast("int").alias("src"), "n")


def rule_coverage(labelled: DataFrame, named: dict[str, Column]) -> DataFrame:
    """A-09: recall, negative rate and covered F0.5 of every rule."""
    from entwine.operators.metrics import rule_scores
    from entwine.operators.rules import unpivoted

    u = unpivoted(labelled, named, "s1_id", "label")
    p, t = F.col("pred"), F.col("label")
    return u.groupBy("rule").agg(r6(F.avg(F.when(t, p.cast("int")))).alias("recall"), r6(F.avg(F.when(~t, p.cast("int")))).alias("neg_rate")).join(rule_scores(u), "rule")


def block_sizes(recs: DataFrame, column: str, *by: str) -> DataFrame:
    """A-10: sizes of blocks of equal values, overall or by columns, with the value of the largest."""
    g = recs.filter(F.col(column) != "").groupBy(*by, column).agg(F.count("*").alias("n"))
    return g.groupBy(*by).agg(F.count("*").alias("n_groups"), F.count_if(F.col("n") == 1).alias("singletons"), r6(F.avg("n")).alias("mean"), r6(F.percentile("n", 0.5)).alias("p50"), r6(F.percentile("n", 0.9)).alias("p90"), r6(F.percentile("n", 0.99)).alias("p99"), F.max("n").alias("largest"), F.count_if(F.col("n") > 10).alias("over_10"), F.max_by(column, F.struct("n", column)).alias("largest_key"))


def cardinality_stats(truth: DataFrame, ids: DataFrame) -> DataFrame:
    """A-11: matches per record of source 1: counts, spread, and from which sources."""
    per = truth.groupBy("s1_id").agg(F.count("*").alias("k"), F.count_if(F.col("msrc") == "S2").alias("k2"), F.count_if(F.col("msrc") == "S3").alias("k3"))
    x = ids.select("s1_id").join(per, "s1_id", "left").na.fill(0)
    k, k2, k3 = F.col("k"), F.col("k2"), F.col("k3")
    return x.agg(F.count("*").alias("n"), F.sum("k").alias("pairs"), r6(F.avg("k")).alias("mean"), F.max("k").alias("largest"), F.count_if(k == 0).alias("none"), F.count_if(k == 1).alias("one"), F.count_if(k > 1).alias("several"), F.count_if((k2 > 0) & (k3 == 0)).alias("s2_only"), F.count_if((k2 == 0) & (k3 > 0)).alias("s3_only"), F.count_if((k2 > 0) & (k3 > 0)).alias("both"))


def cardinality_histogram(truth: DataFrame, recs: DataFrame) -> DataFrame:
    """A-11: records of source 1 by country and number of matches."""
    per = truth.groupBy("s1_id").agg(F.count("*").alias("k"))
    return recs.filter("src = 1").select(F.col("id").alias("s1_id"), "country").join(per, "s1_id", "left").groupBy("country", F.coalesce("k", F.lit(0)).alias("k")).agg(F.count("*").alias("n"))


def cross_source(truth: DataFrame, recs: DataFrame) -> DataFrame:
    """A-12: for records matched in both other sources, whether some pair of the two agrees."""
    r = recs.select("id", "name_norm_suf", "addr_norm")
    side = lambda s: truth.filter(F.col("msrc") == s).select("s1_id", F.col("matched_id").alias("id")).join(r, "id").select("s1_id", F.col("name_norm_suf").alias(f"n{s}"), F.col("addr_norm").alias(f"a{s}"))
    p = side("S2").join(side("S3"), "s1_id").groupBy("s1_id").agg(F.bool_or(F.col("nS2") == F.col("nS3")).alias("name"), F.bool_or((F.col("aS2") == F.col("aS3")) & (F.col("aS2") != "")).alias("addr"))
    return p.agg(F.count("*").alias("n"), F.count_if("name").alias("name_agrees"), F.count_if("addr").alias("addr_agrees"), F.count_if(F.col("name") | F.col("addr")).alias("either"))


def overlap_counts(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """A-13, A-16: ids of either frame and of both."""
    x = a.select(column).distinct().withColumn("a", F.lit(1)).join(b.select(column).distinct().withColumn("b", F.lit(1)), column, "full")
    return x.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count(F.col("a") + F.col("b")).alias("n_both"))


def split_hygiene(train: DataFrame, test: DataFrame, truth: DataFrame) -> DataFrame:
    """A-13, A-16: ids that training and test records share, by source, and truth ids among the test records."""
    frames = [(f"s{s}", train.filter(F.col("src") == s).select("id"), test.filter(F.col("src") == s)) for s in (1, 2, 3)]
    frames.append(("truth", truth.select(F.col("s1_id").alias("id")), test.filter("src = 1")))
    out = None
    for name, a, b in frames:
        one = overlap_counts(a, b, "id").select(F.lit(name).alias("name"), "n_a", "n_b", "n_both")
        out = one if out is None else out.unionByName(one)
    return out


def country_shift(train: DataFrame, test: DataFrame) -> DataFrame:
    """A-16: records by country in both sets; countries that only one has count 0 in the other."""
    n = lambda df, name: df.groupBy("country").agg(F.count("*").alias(name))
    return n(train, "n_train").join(n(test, "n_test"), "country", "full").select("country", F.coalesce("n_train", F.lit(0)).alias("n_train"), F.coalesce("n_test", F.lit(0)).alias("n_test"))


def table_profile(recs: DataFrame) -> DataFrame:
    """A-14: one row a source: rows, distinct ids, empties, lengths, tokens, non-ASCII shares."""
    q = lambda c, p, n: r6(F.percentile(c, p)).alias(n)
    return recs.groupBy(F.col("src").cast("int").alias("src")).agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.count_distinct("country").alias("n_countries"), share(F.col("name") == "").alias("name_empty"), share(F.col("addr") == "").alias("addr_empty"),
        r6(F.avg("nlen")).alias("nlen_mean"), q("nlen", 0.5, "nlen_p50"), q("nlen", 0.95, "nlen_p95"), q("alen", 0.5, "alen_p50"), q("alen", 0.95, "alen_p95"), r6(F.avg("ntok")).alias("ntok_mean"),
        r6(F.avg("non_a_name")).alias("name_non_ascii"), r6(F.avg("non_a_addr")).alias("addr_non_ascii"),
    )


def truth_profile(truth: DataFrame, ids: DataFrame) -> DataFrame:
    """A-15: zero, one, several; distinct and repeated matched ids."""
    per = ids.select("s1_id").join(truth.groupBy("s1_id").agg(F.count("*").alias("k")), "s1_id", "left").na.fill(0)
    part = truth.groupBy("matched_id").agg(F.count_distinct("s1_id").alias("k")).agg(F.count("*").alias("n_matched"), F.count_if(F.col("k") > 1).alias("n_in_several"))
    return per.agg(F.count_if(F.col("k") == 0).alias("zero"), F.count_if(F.col("k") == 1).alias("one"), F.count_if(F.col("k") > 1).alias("several")).crossJoin(part)  # one row each


def scalars(recs: DataFrame, truth: DataFrame) -> DataFrame:
    """A-16: the Cartesian size within countries and the macro F0.5 of predicting nothing."""
    c = recs.groupBy("country").agg(F.count_if(F.col("src") == 1).alias("q"), F.count_if(F.col("src") > 1).alias("c"))
    n = c.agg(F.sum(F.col("q") * F.col("c")).alias("cartesian"), F.sum("q").alias("queries"))
    return n.crossJoin(truth.agg(F.count_distinct("s1_id").alias("with_truth"))).select("cartesian", "queries", r6(1 - F.col("with_truth") / F.col("queries")).alias("predict_none"))


def error_samples(pred: DataFrame, truth: DataFrame, cands: DataFrame, n: int = 10) -> DataFrame:
    """A-17: up to n examples of each kind of error, first ids first."""
    from pyspark.sql import Window

    t = truth.select("s1_id", F.col("matched_id").alias("cand_id")).distinct().withColumn("t", F.lit(1))
    p = pred.select("s1_id", "cand_id").distinct().withColumn("p", F.lit(1))
    c = cands.select("s1_id", "cand_id").withColumn("c", F.lit(1))
    e = p.join(t, ["s1_id", "cand_id"], "full").filter("p is null or t is null").join(c, ["s1_id", "cand_id"], "left").join(truth.select("s1_id").distinct().withColumn("has", F.lit(1)), "s1_id", "left")
    kind = F.when(F.col("p").isNotNull() & F.col("has").isNull(), "singleton_fp").when(F.col("p").isNotNull(), "fp").when(F.col("c").isNotNull(), "fn_retrieved").otherwise("fn_missed")
    return e.withColumn("kind", kind).withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("s1_id", "cand_id"))).filter(F.col("r") <= n).select("kind", "s1_id", "cand_id")


def prediction_stats(pred: DataFrame, ids: DataFrame) -> DataFrame:
    """A-18: records with a prediction, pairs, and pairs per record."""
    return pred.agg(F.count_distinct("s1_id").alias("n_predicted"), F.count("*").alias("n_pairs")).crossJoin(ids.agg(F.count("*").alias("n"))).select("n_predicted", "n_pairs", r6(F.col("n_pairs") / F.col("n")).alias("mean_pairs"))


def separation(labelled: DataFrame, features: list[str]) -> DataFrame:
    """A-01b: by feature and label mean and quantiles, with the feature's AUC. The rows are written once, as both parts read them."""
    from entwine.operators.metrics import auc

    u = cut(labelled.select("label", *features)).select("label", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in features])).alias("x")).select("label", "x.*")
    g = u.groupBy("feature", "label").agg(F.count("*").alias("n"), r6(F.avg("v")).alias("mean"), *[r6(F.percentile("v", p / 100)).alias(f"q{p}") for p in (50, 90, 99)])
    return g.join(auc(u, "v", "label", "feature"), "feature")
