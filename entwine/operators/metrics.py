"""Entity-level F0.5 and related measures, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entwine.plans.running import running


def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """F0.5 of one entity; both sets empty is 1."""
    p = F.when(n_pred > 0, tp / n_pred).otherwise(0.0)
    r = F.when(n_true > 0, tp / n_true).otherwise(0.0)
    d = 0.25 * p + r
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when(d <= 0, 0.0).otherwise(1.25 * p * r / F.when(d > 0, d))


def entity_scores(pred: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """(s1_id, tp, n_pred, n_true, f05) for every id of truth's universe; predictions for other ids do not count."""
    p = pred.select("s1_id", "cand_id").distinct().withColumn("p", F.lit(1))
    t = truth.select("s1_id", F.col("matched_id").alias("cand_id")).distinct().withColumn("t", F.lit(1))
    both = p.join(t, ["s1_id", "cand_id"], "full").groupBy("s1_id").agg(F.count(F.col("p") * F.col("t")).alias("tp"), F.count("p").alias("n_pred"), F.count("t").alias("n_true"))
    out = ids.select("s1_id").join(both, "s1_id", "left").na.fill(0, ["tp", "n_pred", "n_true"])
    return out.withColumn("f05", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def summary(scores: DataFrame, *by: str) -> DataFrame:
    """Macro F0.5 and its deviation, micro precision, recall and F0.5, counts; for each group of `by`."""
    g = scores.groupBy(*by).agg(F.count("*").alias("n_entities"), F.sum("tp").alias("tp"), (F.sum("n_pred") - F.sum("tp")).alias("fp"), (F.sum("n_true") - F.sum("tp")).alias("fn"), F.round(F.avg("f05"), 6).alias("macro_f05"), F.round(F.stddev_samp("f05"), 6).alias("std_f05"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    d = 0.25 * p + r
    return g.withColumns({"micro_precision": F.round(p, 6), "micro_recall": F.round(r, 6), "micro_f05": F.round(F.when(d > 0, 1.25 * p * r / F.when(d > 0, d)).otherwise(0.0), 6)})


def cardinality(n: Column) -> Column:
    return F.when(n == 0, "k0").when(n == 1, "k1").when(n <= 3, "k2_3").when(n <= 5, "k4_5").otherwise("k6+")


def slices(scores: DataFrame, country: DataFrame) -> DataFrame:
    """summary() overall, by country and by cardinality in one pass (grouping sets)."""
    s = scores.join(country, "s1_id").withColumn("cardinality", cardinality(F.col("n_true")))
    g = s.groupingSets([[], ["country"], ["cardinality"]], "country", "cardinality").agg(F.count("*").alias("n_entities"), F.sum("tp").alias("tp"), F.round(F.avg("f05"), 6).alias("macro_f05"))
    return g.select(F.coalesce("country", "cardinality", F.lit("all")).alias("slice"), "n_entities", "tp", "macro_f05")


def rule_scores(labelled: DataFrame) -> DataFrame:
    """Per rule over (rule, s1_id, pred, label): covered macro F0.5 and numbers of entities."""
    c = lambda x: F.sum(x.cast("int"))
    p, t = F.col("pred"), F.col("label")
    e = labelled.groupBy("rule", "s1_id").agg(c(p & t).alias("tp"), c(p & ~t).alias("fp"), c(~p & t).alias("fn")).filter("tp + fp + fn > 0")
    n_pred, n_true = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    score = F.when((n_pred == 0) | (n_true == 0), 0.0).otherwise(f05(F.col("tp"), n_pred, n_true))
    return e.groupBy("rule").agg(F.round(F.avg(score), 6).alias("f05_covered"), F.count("*").alias("n_covered"), F.count_if(n_pred > 0).alias("n_with_pred"), F.count_if(n_true > 0).alias("n_with_true"))


def auc(df: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """Area under the ROC curve by average ranks; rows are first counted by score, and the counts summed over ranges of scores."""
    g = df.groupBy(*by, F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    g = running(g, [F.col(c) for c in (*by, "s")], {"before": F.col("n")})
    first = g.groupBy(*by).agg(F.min("before").alias("first"))  # one row a group
    g = (g.join(first, list(by)) if by else g.withColumn("first", F.lit(0))).withColumn("rank", F.col("before") - F.col("first") + (F.col("n") + 1) / 2.0)
    a = g.groupBy(*by).agg(F.sum(F.col("rank") * F.col("p")).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    pos, neg = F.col("p"), F.col("n") - F.col("p")
    return a.select(*by, F.when((pos > 0) & (neg > 0), F.round((F.col("u") - pos * (pos + 1) / 2.0) / (pos * neg), 6)).alias("auc"))
