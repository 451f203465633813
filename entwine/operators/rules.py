"""Tiered rules, probability adjustments and crisp rule masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tests() -> list[tuple[Column, Column | float, int]]:
    """(condition, confidence, tier) in order of precedence."""
    f = F.col
    jac, c2, c3, cnt = f("name_tok_jac"), f("name_char2"), f("name_char3"), f("name_contain")
    ajac, ac2, ac3, acnt = f("addr_tok_jac"), f("addr_char2"), f("addr_char3"), f("addr_contain")
    same = (f("name_eq") > 0) | (f("name_suf_eq") > 0)
    number, first, last = f("num_overlap") >= 1, f("first_num_match") > 0, f("last_num_match") > 0
    addr = f("addr_eq") > 0
    top = lambda x: F.least(F.lit(1.0), x)
    mean = top((jac + ajac) / 2.0)
    return [
        (same & (addr | (ajac >= 0.35) | (ac2 >= 0.50) | number | first), 0.95 + 0.04 * top(ajac + F.when(number, 0.05).otherwise(0.0)), 1),
        (addr & ((jac >= 0.30) | (c2 >= 0.40) | (cnt >= 0.50)), 0.94 + 0.05 * top(jac), 1),
        (((jac >= 0.65) | (c3 >= 0.70)) & ((ajac >= 0.45) | (ac2 >= 0.60)), 0.92 + 0.05 * mean, 1),
        ((number | first) & ((jac >= 0.45) | (c2 >= 0.55) | (cnt >= 0.60)) & ((ajac >= 0.30) | (ac2 >= 0.45)), 0.91 + 0.05 * mean, 1),
        (((ajac >= 0.50) | (ac3 >= 0.65)) & (number | first) & ((c2 >= 0.30) | (cnt >= 0.35)), 0.85 + 0.05 * ajac, 2),
        (((jac >= 0.55) | (c3 >= 0.60)) & ((ajac >= 0.35) | (ac2 >= 0.50)), 0.80 + 0.05 * jac, 2),
        ((number | first | last) & ((jac >= 0.60) | ((c2 >= 0.70) & (cnt >= 0.60))), 0.78 + 0.05 * jac, 2),
        ((f("addr_missing") > 0) & same & (f("name_len_diff") <= 3), 0.76, 2),
        ((ajac >= 0.45) & ((jac >= 0.25) | (c2 >= 0.35)), 0.65 + 0.05 * ajac, 3),
        (((jac >= 0.80) | (same & (f("name_len_diff") <= 2))) & ((ac2 >= 0.30) | (acnt >= 0.30)), 0.60, 3),
    ]


def score(features: DataFrame, first: int = 10) -> DataFrame:
    """features with conf and tier by the first rules, in one ordered CASE."""
    return _ruled(features, _tests()[:first])


def _ruled(features: DataFrame, tests: list[tuple[Column, Column | float, int]]) -> DataFrame:
    out = None
    for when, conf, tier in tests:
        value = F.struct((conf if isinstance(conf, Column) else F.lit(conf)).cast("double").alias("conf"), F.lit(tier).alias("tier"))
        out = F.when(when, value) if out is None else out.when(when, value)
    return features.withColumn("rule", out.otherwise(F.struct(F.lit(0.0).alias("conf"), F.lit(0).alias("tier")))).withColumns({"conf": F.col("rule.conf"), "tier": F.col("rule.tier")}).drop("rule")


def score_native(features: DataFrame) -> DataFrame:
    """features with conf and tier by the native variant's six rules, which have fewer alternatives than the first six of score()."""
    f = F.col
    jac, c2, c3 = f("name_tok_jac"), f("name_char2"), f("name_char3")
    ajac, ac2, ac3 = f("addr_tok_jac"), f("addr_char2"), f("addr_char3")
    number, addr = f("num_overlap") >= 1, f("addr_eq") > 0
    when = [
        (f("name_eq") > 0) & (addr | (ajac >= 0.35) | number),
        addr & ((jac >= 0.30) | (c2 >= 0.40)),
        ((jac >= 0.65) | (c3 >= 0.70)) & ((ajac >= 0.45) | (ac2 >= 0.60)),
        number & ((jac >= 0.45) | (c2 >= 0.55)) & ((ajac >= 0.30) | (ac2 >= 0.45)),
        ((ajac >= 0.50) | (ac3 >= 0.65)) & number & (c2 >= 0.30),
        ((jac >= 0.55) | (c3 >= 0.60)) & ((ajac >= 0.35) | (ac2 >= 0.50)),
    ]
    return _ruled(features, [(w, conf, tier) for w, (_, conf, tier) in zip(when, _tests()[:6], strict=True)])


def masks(f: DataFrame) -> dict[str, Column]:
    """Crisp rules by name."""
    c = F.col
    jac, ajac, num = c("name_tok_jac"), c("addr_tok_jac"), c("num_overlap") >= 1
    same, addr = c("pool_name_eq") > 0, c("pool_both_eq") > 0
    return {
        "R1": same,
        "R2": addr,
        "R3": same & num,
        "R4": jac >= 0.8,
        "R5": (jac >= 0.8) | (c("name_char2") >= 0.9),
        "R6": (jac >= 0.6) & (ajac >= 0.5),
        "R7": (ajac >= 0.4) & num,
        "R8": c("addr_char2") >= 0.8,
        "R9": num & (jac >= 0.5),
        "R10": (jac >= 0.9) | (ajac >= 0.6) | (c("addr_char2") >= 0.9) | num,
        "R11": (c("rare_shared") >= 1) & (ajac >= 0.3),
    }


def unpivoted(df: DataFrame, named: dict[str, Column], *keep: str) -> DataFrame:
    """keep, rule, pred: a row for each mask, without another pass over df."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("pred")) for k, v in named.items()])).alias("x")).select(*keep, "x.rule", "x.pred")


#: Share of positives among training pairs and among candidates at large.
TRAIN_PRIOR, TEST_PRIOR = 0.422144, 0.06


def prior_shift(p: Column, train: float = TRAIN_PRIOR, test: float = TEST_PRIOR) -> Column:
    """A probability learnt under one share of positives, under another."""
    odds = p / F.greatest(1.0 - p, F.lit(1e-7)) * ((test / (1 - test)) / (train / (1 - train)))
    return odds / (1.0 + odds)


def hybrid(p: Column, conf: Column, tier: Column) -> Column:
    """Geometric mean of probability and rule confidence, 0 without a rule."""
    return F.when(tier > 0, F.sqrt(p) * F.sqrt(conf)).otherwise(0.0)
