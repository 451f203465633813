"""Selection of matches per record of source 1, and the disjoint assignment. All orders are total: conf desc, then ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entwine.plans.lineage import cut

MOST = 11


def _rank():
    return Window.partitionBy("s1_id").orderBy(F.desc("conf"), "cand_id")


def _all():
    return Window.partitionBy("s1_id")


def tiered(s: DataFrame) -> DataFrame:
    return s.filter(F.col("tier").isin(1, 2))


def policy_a(s: DataFrame, least: float = 0.75) -> DataFrame:
    return s.filter(F.col("conf") >= least)


def policy_b(s: DataFrame, t1: float = 0.88, t2: float = 0.75, t3: float | None = None) -> DataFrame:
    third = F.lit(False) if t3 is None else (F.col("tier") == 3) & (F.col("conf") >= t3)
    return s.filter(((F.col("tier") == 1) & (F.col("conf") >= t1)) | ((F.col("tier") == 2) & (F.col("conf") >= t2)) | third)


def policy_c(s: DataFrame, anchor: float = 0.85, floor: float = 0.72, delta: float = 0.15, most: int = MOST) -> DataFrame:
    """The best candidate if it reaches the anchor, and those of tiers 1 and 2 among the next that lie close to it."""
    r = s.withColumn("r", F.row_number().over(_rank())).filter(F.col("r") <= most).withColumn("top", F.max("conf").over(_all()))
    near = F.col("tier").isin(1, 2) & (F.col("conf") >= F.greatest(F.lit(floor), F.col("top") - delta))
    return r.filter((F.col("top") >= anchor) & ((F.col("r") == 1) | near)).drop("r", "top")


def policy_d(s: DataFrame, t1: float = 0.88, alone: float = 0.82, beside: float = 0.75, most: int = MOST) -> DataFrame:
    """All strong candidates of tier 1; those of tier 2 fill up to `most`, with a higher bar where tier 1 has none."""
    strong = (F.col("tier") == 1) & (F.col("conf") >= t1)
    x = s.withColumn("n1", F.sum(strong.cast("int")).over(_all()))
    second = (F.col("tier") == 2) & (F.col("conf") >= F.when(F.col("n1") > 0, beside).otherwise(alone))
    r = x.withColumn("second", second).withColumn("r", F.row_number().over(Window.partitionBy("s1_id", "second").orderBy(F.desc("conf"), "cand_id")))
    return r.filter(strong | (F.col("second") & (F.col("r") + F.col("n1") <= most))).drop("n1", "second", "r")


def sweep(s: DataFrame, anchors=(0.82, 0.85, 0.88, 0.90), deltas=(0.10, 0.12, 0.15)) -> DataFrame:
    """policy_c under every pair of parameters in one pass: anchor, delta, s1_id, cand_id."""
    grid = F.array(*[F.struct(F.lit(a).alias("anchor"), F.lit(d).alias("delta")) for a in anchors for d in deltas])
    r = s.withColumn("r", F.row_number().over(_rank())).filter(F.col("r") <= MOST).withColumn("top", F.max("conf").over(_all())).withColumn("g", F.explode(grid))
    near = F.col("tier").isin(1, 2) & (F.col("conf") >= F.greatest(F.lit(0.72), F.col("top") - F.col("g.delta")))
    return r.filter((F.col("top") >= F.col("g.anchor")) & ((F.col("r") == 1) | near)).select("g.anchor", "g.delta", "s1_id", "cand_id")


def one_pass(pairs: DataFrame, most: int = MOST) -> DataFrame:
    """Each candidate with its best record of source 1, then the best of each record: an approximation of assign()."""
    own = pairs.withColumn("r", F.row_number().over(Window.partitionBy("cand_id").orderBy(F.desc("conf"), "s1_id"))).filter("r = 1")
    return own.withColumn("r", F.row_number().over(_rank())).filter(F.col("r") <= most).drop("r")


def top_candidates(pairs: DataFrame, most: int = 50) -> DataFrame:
    return pairs.withColumn("r", F.row_number().over(_rank())).filter(F.col("r") <= most).drop("r")


def assign(edges: DataFrame, least: float = 0.88, most: int = MOST, rounds: int = 1000) -> DataFrame:
    """Every candidate to one record, every record up to `most`: equal to taking edges greedily in order of (conf desc, s1_id, cand_id).

    Deferred acceptance: candidates ask their best remaining record, records keep their best `most`, refused candidates ask the
    next; until nothing is refused. Every candidate's edges are ranked once; a round ranks only the records that are asked in it.
    """
    by_cand = Window.partitionBy("cand_id").orderBy(F.desc("conf"), "s1_id")
    live = cut(edges.filter(F.col("conf") >= least).select("s1_id", "cand_id", "conf").withColumn("k", F.row_number().over(by_cand)))
    ranked = lambda df: df.withColumn("r", F.row_number().over(_rank()))
    state = cut(ranked(live.filter("k = 1")))
    for _ in range(rounds):
        kept, refused = state.filter(F.col("r") <= most), state.filter(F.col("r") > most)
        if refused.limit(1).count() == 0:
            return kept.select("s1_id", "cand_id", "conf")
        asks = live.join(refused.select("cand_id", (F.col("k") + 1).alias("k")), ["cand_id", "k"]).select("s1_id", "cand_id", "conf", "k")
        asked = asks.select("s1_id").distinct()
        again = ranked(asks.unionByName(kept.drop("r").join(asked, "s1_id", "left_semi")))
        state = cut(again.unionByName(kept.join(asked, "s1_id", "left_anti")))
    raise RuntimeError(f"the assignment did not settle in {rounds} rounds")


def assign_sweep(s: DataFrame, thresholds: tuple[float, ...] = (0.85, 0.88)) -> DataFrame:
    """(least, s1_id, cand_id): assign() under every threshold."""
    out = None
    for least in thresholds:
        one = assign(s, least).select(F.lit(least).alias("least"), "s1_id", "cand_id")
        out = one if out is None else out.unionByName(one)
    return out
