"""Mixing sources to target weights by nested hash thresholds, without a sort of the rows.

Method. Every row has a 60-bit digest of its id. Sizes are summed by source and the top 15 bits; running sums over these
bounded histograms find the bucket in which a source's budget ends. Only rows of that bucket are summed again by the next 15
bits, and so on four times, until the bucket is one digest value. The rows below the threshold that results are taken;
the digest at the threshold is taken too if that comes nearer. If several rows have that digest, the budget ends among them
in the same way by a 60-bit digest of their texts, and among equal rows by their position. A target above a source's size takes every row the whole
number of times first and selects the rest in the same way.

Targets. Sources in order of code points, null last, weigh 3, 1, 2, repeating, and share a given part of all sizes; a target
stops at twice its source's size and the excess is shared again by weight. That is the least level t with
sum(min(2 size, t weight)) = total, found by running totals over the sources in order of size / weight, which are
range-partitioned, so that sources may be hosts; histograms are summed in two steps, so a task has few buckets of a source.

Defined results. Null text has size 0 and is taken 0 times. Rows that repeat an id or lack one share a digest of it, but are
taken row by row where the budget ends among them; the SQL takes them together, so it has the same result where no id repeats.
Rows whose digests tie are told apart in that order, and no other ties arise. A null source is a source of its own. If all sizes
are 0, all targets are 0. Very long texts: only the number of their words counts. Other columns do not matter. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entwine.llm.common import table, text_key, word_count, written
from entwine.plans.running import running

WEIGHTS = (3, 1, 2)
PERCENT, MOST_TIMES = 150, 2
BITS, LEVELS = 15, 4


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT) -> DataFrame:
    """sizes(source, source_size), a row a source, with target. Ranks and sums in order are running totals over ranges of sources."""
    hold = lambda df: written(df, "sources")
    s = running(sizes, [F.col("source").asc_nulls_last()], {"i": F.lit(1)}, hold)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("i") % len(weights) + 1).cast("int")).cast("long")
    s = s.withColumn("w", w).withColumn("cap", F.lit(MOST_TIMES).cast("long") * F.col("source_size")).drop("i")
    # In order of cap / weight the sources that reach their cap come first.
    s = s.withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    s = running(s, [F.col("ratio").asc(), F.col("source").asc_nulls_last()], {"i": F.lit(1), "caps": F.col("cap"), "ws": F.col("w")}, hold)
    every = s.agg(F.sum("source_size").alias("total"), F.sum("w").alias("w_total"))  # one row
    s = s.crossJoin(F.broadcast(every)).withColumn("left", F.col("total") * percent - 100 * F.col("caps")).withColumn("ws", F.col("w_total") - F.col("ws"))  # left: in hundredths
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    s = written(s.withColumn("at_cap", 100 * wide("cap") * wide("ws") <= wide("left") * wide("w")).select("source", "source_size", "cap", "w", "i", "left", "ws", "at_cap"), "levels")
    first = s.filter(~F.col("at_cap")).agg(F.min(F.struct("i", "left", "ws")).alias("l"))  # one row
    level = (F.col("l.left") * F.col("w")).cast("double") / (100 * F.col("l.ws")).cast("double")
    return s.crossJoin(F.broadcast(first)).select("source", "source_size", F.when(F.col("l").isNull() | (F.col("i") < F.col("l.i")), F.col("cap").cast("double")).otherwise(level).alias("target"))


def _digest(c: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(c.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def _ends(rows: DataFrame, by: str, budgets: DataFrame, tag: str) -> DataFrame:
    """Where each source's budget ends: source, prefix (a value of `by`), what is open of the budget below it, its size and rows."""

    def last(sums: DataFrame, column: str) -> DataFrame:
        """The bucket in which what is open ends, with what is open below it; a source has 2 ** (BITS / 2) buckets here, about."""
        upto = F.sum("size").over(Window.partitionBy("source").orderBy(column))
        ends = sums.withColumn("below", upto - F.col("size")).filter((F.col("below") <= F.col("open")) & (F.col("below") + F.col("size") > F.col("open")))
        return ends.withColumn("open", F.col("open") - F.col("below")).drop("below")

    at = budgets.select("source", F.lit(0).cast("long").alias("prefix"), "open")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        a = at.select(F.col("source").alias("s"), F.col("prefix").alias("p"), "open")
        inside = rows.filter("size > 0").join(a, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright(by, shift + BITS) == F.col("p")))
        sums = inside.groupBy("source", F.shiftright(by, shift).alias("prefix")).agg(F.sum("size").alias("size"), F.first("open").alias("open"), F.count("*").alias("n"))
        # The histogram in two steps: first its coarse buckets, then the fine ones of the coarse bucket found.
        sums = written(sums.withColumn("coarse", F.shiftright("prefix", BITS - BITS // 2)), f"{tag}sums{level}")
        coarse = last(sums.groupBy("source", "coarse").agg(F.sum("size").alias("size"), F.first("open").alias("open")), "coarse")
        c = coarse.select(F.col("source").alias("s"), F.col("coarse").alias("c"), F.col("open").alias("rest"))
        fine = sums.join(c, F.col("source").eqNullSafe(F.col("s")) & (F.col("coarse") == F.col("c"))).select("source", "prefix", "size", F.col("rest").alias("open"), "n")
        at = written(last(fine, "prefix").select("source", "prefix", "open", "size", "n"), f"{tag}{level}")
    return at


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Column | None = None) -> DataFrame:
    """Per row of docs: doc_id, th (tells rows apart that share an id), size, source, source_size, target, times, taken; and carry."""
    extra = [] if carry is None else [carry.alias("carried")]
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("th"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _digest(F.col(id_col)).alias("h"), F.monotonically_increasing_id().alias("rid"), *extra)
    rows = written(rows, "sizes")
    t = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_TIMES))).otherwise(0).cast("long")
    t = written(t.withColumn("whole", whole).withColumn("budget", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")), "targets")

    # Narrow every source's budget to one digest; where several rows have it, on by the digest of the text, then by position.
    at = _ends(rows, "h", t.select("source", F.col("budget").alias("open")), "level")
    order = {"h": F.col("h"), "x": _digest(F.col("th")), "rid": F.col("rid")}
    tied, found = rows.select("source", "size", "h", order["x"].alias("x"), "rid"), []
    for i, by in enumerate(order):
        found.append(at.select(F.col("source").alias(f"s{i}"), F.col("prefix").alias(f"p{i}"), (F.col("open") * 2 >= F.col("size")).alias(f"half{i}")))
        several = at.filter("n > 1")
        if by == "rid" or several.limit(1).count() == 0:
            break
        nxt = list(order)[i + 1]
        tied = written(tied.join(several.select(F.col("source").alias("s"), F.col("prefix").alias("p")), F.col("source").eqNullSafe(F.col("s")) & (F.col(by) == F.col("p"))).drop("s", "p"), f"tied-{nxt}")
        at = _ends(tied, nxt, several.select("source", "open"), f"level-{nxt}-")

    # The row in which the budget ends counts if half of it or more fits. No such row: no budget, or all rows fit.
    t = t.select(F.col("source").alias("s"), "source_size", "target", "whole")
    for i, f in enumerate(found):
        t = t.join(f, F.col("s").eqNullSafe(F.col(f"s{i}")), "left").drop(f"s{i}")
    more = F.lit(False)
    for i, by in reversed(list(enumerate(order))[: len(found)]):
        deeper = F.when(F.col(f"p{i + 1}").isNotNull(), more).otherwise(F.col(f"half{i}")) if i + 1 < len(found) else F.col(f"half{i}")
        more = (order[by] < F.col(f"p{i}")) | ((order[by] == F.col(f"p{i}")) & deeper)
    times = F.when(F.col("size") > 0, F.least(F.col("whole") + F.coalesce(more, F.lit(False)).cast("long"), F.lit(MOST_TIMES))).otherwise(0).cast("long")
    out = rows.join(t, F.col("source").eqNullSafe(F.col("s"))).withColumn("times", times)
    return out.select("doc_id", "th", "size", "source", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), *(["carried"] if extra else []))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w FROM d GROUP BY source),
c AS (SELECT *, 2 * source_size AS cap, row_number() OVER by_ AS i,
        150 * sum(source_size) OVER () - 100 * coalesce(sum(2 * source_size) OVER (by_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(w) OVER (by_ ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
    FROM s WINDOW by_ AS (ORDER BY (2 * source_size)::DOUBLE / w, source NULLS LAST)),
l AS (SELECT i AS li, rest AS lrest, ws AS lws FROM c WHERE 100 * cap * ws > rest * w ORDER BY i LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN li IS NULL OR i < li THEN cap::DOUBLE ELSE (lrest * w)::DOUBLE / (100 * lws)::DOUBLE END AS target FROM c LEFT JOIN l ON true),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT doc_id, d.source, size, h, source_size, target, whole, target - (whole * source_size)::DOUBLE AS budget,
        sum(size) OVER (PARTITION BY d.source, h) AS same, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN (upto - same <= budget AND upto > budget AND (budget - (upto - same)) * 2 >= same) OR upto <= budget THEN (budget > 0)::INT ELSE 0 END))::BIGINT AS taken FROM r
"""
