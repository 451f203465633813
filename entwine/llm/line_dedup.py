"""Removal of lines that occur on many sites (boilerplate), by distinct-site spread.

Method. Lines are hashed (96 bits). A line on s sites has s rows at least, so hashes with fewer rows than the limit are out by a
plain count. For the rest, the sites of a line's rows are gathered in HyperLogLog sketches, which merge by aggregation, so that
no table of distinct (line, site) pairs is made. An estimate clear of the limit by more than BAND decides; only for lines near
it the distinct sites are counted exactly. Flagged lines lead back to their positions, and texts keep the lines between these.

Defined results. A line is what stands between newlines; lines of white space only are never boilerplate and stay. Null texts are
empty. A null site counts as one site. Rows of their own are documents of their own, also when ids or whole rows repeat
(copies on one site add no site). Ties do not arise. Very long texts: work grows with their lines, which one row holds. Other
columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.llm.common import bound, row_id, table, text_key, written

SITES, BAND, PRECISION = 5, 0.5, 12
LINE = ["h1", "h2"]


def frequent(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """The rows of lines that have as many rows as could lie on `sites` sites."""
    often = lines.groupBy(*LINE).agg(F.count("*").alias("c")).filter(F.col("c") >= sites).select(*LINE)
    # A table of its own, so that the join is a plain one, which Spark can broadcast by size or split by skew.
    return lines.join(written(often, "often"), LINE)


def estimates(lines: DataFrame) -> DataFrame:
    """(h1, h2, estimate): the number of sites of each line by its merged sketch."""
    return lines.groupBy(*LINE).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", PRECISION)).alias("estimate"))


def spread(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(h1, h2) of the lines (h1, h2, site) that occur on `sites` sites or more."""
    sketched = written(estimates(lines).filter(F.col("estimate") >= sites * (1 - BAND)), "spread")
    near = sketched.filter(F.col("estimate") <= sites * (1 + BAND)).select(*LINE)
    exact = lines.join(near, LINE).groupBy(*LINE).agg(F.count_distinct("site").alias("n")).filter(F.col("n") >= sites).select(*LINE)
    return sketched.filter(F.col("estimate") > sites * (1 + BAND)).select(*LINE).unionByName(exact)


def without(lines: Column, gone: Column) -> Column:
    """The array without the elements at the (0-based, distinct) positions `gone`: the stretches between them, in one pass."""

    def stretches(x: Column) -> Column:
        at, n = x["gone"], F.size(x["gone"])
        first = lambda k: F.when(k == 0, 0).otherwise(F.element_at(at, F.greatest(k, F.lit(1))) + 1)
        stop = lambda k: F.when(k == n, F.size(x["lines"])).otherwise(F.element_at(at, F.least(k + 1, F.greatest(n, F.lit(1)))))
        cut = lambda k: F.slice(x["lines"], first(k) + 1, stop(k) - first(k))
        return F.when(n == 0, x["lines"]).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), n), cut)))

    return bound(F.struct(lines.alias("lines"), F.sort_array(gone).alias("gone")), stretches)


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_removed, kept (the text without the lines)."""
    base = docs.select(F.col(id_col).alias("doc_id"), row_id(id_col).alias("uid"), text_key(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("")).alias("site"))
    split = base.select("uid", "th", "site", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(F.trim(F.regexp_replace("line", r"\s", "")) != "")
    lines = split.select("uid", "th", "site", "at", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))
    lines = written(frequent(lines, sites), "lines")
    bad = written(spread(lines, sites), "boilerplate")
    gone = lines.join(bad, LINE).groupBy("uid", "th").agg(F.collect_set("at").alias("gone"))
    out = base.join(gone, ["uid", "th"], "left").select("doc_id", F.split("text", "\n").alias("l"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    return out.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.array_join(without(F.col("l"), F.col("gone")), "\n").alias("kept"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
b AS (SELECT line FROM l WHERE regexp_replace(line, '\s', '', 'g') <> '' GROUP BY line HAVING count(DISTINCT coalesce('=' || source, '')) >= 5)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE b.line IS NOT NULL))::BIGINT AS n_removed,
    sha256(coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN b ON l.line = b.line GROUP BY doc_id
"""
