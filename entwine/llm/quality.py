"""Quality scores by a sparse ensemble of rules over text statistics.

Method. Statistics of whole texts are Spark column expressions. On a bounded sample of labelled rows (SAMPLE rows at most, those
with the least digests of their ids) boosted shallow trees are grown; every path from a root is a conjunctive rule; a
logistic regression with a lasso penalty weighs the rules, and most weights are zero. The rules that remain are compiled
into one Spark column expression, which scores all rows in the JVM in one pass, without a shuffle.

Labels, language, source and ids are never inputs of a score. Rows whose crc32(id as text) mod 4 is 2 are never learnt from.

Defined results. Null and empty texts have the statistics of an empty text and get a score. Without labelled rows, or with
labels of one kind, the score is the share of label 1 (0.5 without any). Labels that are null or not 0 or 1 are left out; rows that
repeat an id count as often as they occur. Rows that tie in the order of the sample differ in nothing that is learnt from.
Very long texts: one row holds a text, its words and its lines. Other columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.llm.common import SPACE, packed, quoted, table

SAMPLE = 20_000
THRESHOLD = 0.7
TREES, DEPTH, RATE, BINS, LASSO = 40, 3, 0.3, 48, 0.002


def _statistics() -> dict[str, Column]:
    """Statistics, in order; each from the columns t (text), w (words), l (lines)."""
    t, w, l = F.col("t"), F.col("w"), F.col("l")
    chars = F.greatest(F.char_length(t), F.lit(1)).cast("double")
    n = F.greatest(F.size(w), F.lit(1)).cast("double")
    lines = F.greatest(F.size(l), F.lit(1)).cast("double")
    per_char = lambda pattern: F.regexp_count(t, F.lit(pattern)) / chars
    return {
        "chars": F.char_length(t).cast("double"),
        "words": F.size(w).cast("double"),
        "word_length": F.char_length(t) / n,
        "distinct": F.size(F.array_distinct("w")) / n,
        "upper": per_char(r"\p{Lu}"),
        "marks": per_char(r"[#$%&*@~^_=+<>]"),
        "bars": per_char(r"\|"),
        "shouts": per_char(r"!"),
        "digits": per_char(r"[0-9]"),
        "stops": per_char(r"[.,;:?]"),
        "again": F.regexp_count(t, F.lit(r"(?<![^\s])(\S+)[ \t]+\1(?![^\s])")) / n,
        "lines": lines,
        "line_length": chars / lines,
        "distinct_lines": F.size(F.array_distinct("l")) / lines,
        "ended_lines": F.regexp_count(t, F.lit(r"[.!?](?=\n|\z)")) / lines,
    }


def statistics(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """The struct row of the columns keep, and one column for each statistic."""
    t = df.select(packed(df, *keep), F.coalesce(quoted(text_col), F.lit("")).alias("t"))
    t = t.select("row", "t", F.filter(F.split("t", SPACE), lambda x: x != "").alias("w"), F.split("t", "\n").alias("l"))
    return t.select("row", *[c.alias(f"s_{k}") for k, c in _statistics().items()])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


# ---- fitting, on the driver, on the bounded sample --------------------------------------------------------------------

Rule = tuple[tuple[int, float, bool], ...]  # (statistic, cut, whether above it), all of which must hold


def _grow(b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, step: np.ndarray) -> None:
    """One regression tree on binned statistics; out gets the paths, step what it adds to each row's score."""
    best = (1e-6, -1, 0)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    if depth and len(rows) >= 40:
        for f in range(b.shape[1]):
            sg = np.bincount(b[rows, f], g[rows], BINS).cumsum()[:-1]
            sh = np.bincount(b[rows, f], h[rows], BINS).cumsum()[:-1]
            n = np.bincount(b[rows, f], minlength=BINS).cumsum()[:-1]
            gain = np.where((n >= 15) & (len(rows) - n >= 15), sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
    if best[1] < 0:
        step[rows] = -RATE * total_g / (total_h + 1)
        return
    _, f, k = best
    above = b[rows, f] > k
    for side in (False, True):
        rule = (*path, (f, k, side))
        out.append(rule)
        _grow(b, g, h, rows[above == side], depth - 1, rule, out, step)


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules of a sparse ensemble for label y over statistics x."""
    if not len(y):
        return 0.0, []
    p = float(y.mean())
    if not 0 < p < 1:
        return float(np.log((p + 1e-3) / (1 - p + 1e-3))), []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    b = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    score = np.full(len(y), np.log(p / (1 - p)))
    paths: list = []
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        _grow(b, q - y, q * (1 - q), np.arange(len(y)), DEPTH, (), paths, step)
        score += step
    paths = list(dict.fromkeys(tuple(sorted(r)) for r in paths))
    hits = np.ones((len(y), len(paths)), np.float32)
    for j, r in enumerate(paths):
        for f, k, side in r:
            hits[:, j] *= (b[:, f] > k) == side
    # Rules with equal hits are one rule.
    _, first = np.unique(hits, axis=1, return_index=True)
    paths, hits = [paths[j] for j in sorted(first)], hits[:, sorted(first)]
    mean, sd = hits.mean(0), hits.std(0) + 1e-9
    z = (hits - mean) / sd
    weights, intercept = np.zeros(z.shape[1]), np.log(p / (1 - p))
    ahead, t = weights.copy(), 1.0
    pace = 4 / float(np.linalg.eigvalsh((z.T @ z / len(y)).astype(np.float64))[-1])
    for _ in range(400):  # proximal gradient with momentum
        q = 1 / (1 + np.exp(-(z @ ahead + intercept)))
        new = ahead - pace * (z.T @ (q - y) / len(y))
        new = np.sign(new) * np.maximum(np.abs(new) - pace * LASSO, 0)
        intercept -= 4 * (q - y).mean()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, weights, t = new + (t - 1) / t2 * (new - weights), new, t2
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    out = [(float(weights[j] / sd[j]), tuple((f, float(cuts[f][k]), side) for f, k, side in paths[j])) for j in used]
    return float(intercept - (weights[used] * mean[used] / sd[used]).sum()), out


def compile_rules(intercept: float, rules: list[tuple[float, Rule]]) -> Column:
    """The score as a column over the columns that statistics() makes."""
    names = list(_statistics())
    total = F.lit(intercept)
    for weight, rule in rules:
        holds = None
        for f, cut, side in rule:
            c = F.col(f"s_{names[f]}") > cut if side else F.col(f"s_{names[f]}") <= cut
            holds = c if holds is None else holds & c
        total = total + F.when(holds, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[float, list[tuple[float, Rule]]]:
    """Fits the ensemble on at most `sample` labelled rows of docs that are not held out. A model without rules scores all rows alike."""
    some = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & ~held_out("__id"))
    # The sample is drawn among labels of these documents, so that labels of others take no place in it.
    some = some.join(docs.select(quoted(id_col).alias("__id")).distinct(), "__id", "left_semi")
    some = some.orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample)
    # At most `sample` rows of two numbers: the bound of this broadcast.
    rows = docs.select(quoted(id_col).alias("__id"), quoted(text_col).alias("__t")).join(F.broadcast(some), "__id")
    got = statistics(rows, "__t", "__id", "__y").select("row.*", *[f"s_{k}" for k in _statistics()]).orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample).toPandas()
    got = got.sort_values(list(got.columns), kind="stable")
    return fit(got[[c for c in got.columns if c.startswith("s_")]].to_numpy(float), got["__y"].to_numpy(float))


def score(docs: DataFrame, model: tuple[float, list[tuple[float, Rule]]], *keep: str, text_col: str = "text") -> DataFrame:
    """keep and score, for every row of docs."""
    return statistics(docs, text_col, *keep).select("row.*", compile_rules(*model).alias("score"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, "doc_id").select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
