"""Benchmark items inside documents: size-partitioned MinHash containment search, with DataFrame functions only.

Method. A short item in a long document has a tiny Jaccard similarity with it, so the search is for containment: the share of
the item's word shingles that the document has. Items are partitioned by the size of their shingle sets (powers of two), and
each partition has a sketch size and a number of sketch shingles that have to be met of its own (sketch_size, need). An
item's MinHash sketch are its shingles of least hash; sets of up to SKETCH shingles are their own sketch. On the side of the
documents the same order of hashes makes the sketch: shingles above the largest value in any item's sketch are left out. A
document that meets enough of an item's sketch is a candidate: a true case misses that with a probability of MISS at most,
by the partition's number. Candidates are verified by exact containment: every candidate's item shingles are joined to the
document's. The sketches are a written table, which Spark broadcasts if its measured size is under its threshold and joins
by shuffle otherwise.

Defined results. Words are those of common.words; items of fewer than `shingle` words have no shingle and are never found, nor
are documents of fewer words. Null texts are empty. Rows that repeat an id and text are reported once; items likewise. Null
ids stay null. Very long texts: their words are one array in one row. Other columns do not matter. Ties do not arise (equal
hashes are one shingle). Empty tables give an empty result.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entwine.llm.common import packed, quoted, row_id, table, text_key, words, written

#: Shingles in the sketch of the first partition above it, and how many more each doubling of the size adds.
SKETCH, STEP, MISS = 16, 8, 1e-6
NO_ID = -(1 << 62)


def shingles(df: DataFrame, text_col: str, k: int, *keep: str) -> DataFrame:
    """keep and h: every shingle of every row, as often as it occurs."""
    w = df.select(*keep, words(F.col(text_col)).alias("w")).filter(F.size("w") >= k)
    return w.select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.xxhash64(F.slice("w", i, k)))).alias("h"))


def sketch_size(partition: int) -> int:
    """Of items with over 2 ** (partition - 1) and up to 2 ** partition shingles; all shingles of items up to SKETCH."""
    return max(SKETCH, SKETCH + STEP * (partition - SKETCH.bit_length()))


def need(size: int, percent: int) -> int:
    """Shingles of a sketch of `size` that a document which holds `percent` of the item meets but for a probability of MISS."""
    p, tail, t = percent / 100, 0.0, 0
    while (tail := tail + comb(size, t) * p**t * (1 - p) ** (size - t)) <= MISS:
        t += 1
    return max(1, t)


def sketched(sets: DataFrame, percent: int) -> DataFrame:
    """(item, h, partition, need): the sketches of sets (item, n, h)."""
    partition, whole = F.ceil(F.log2("n")).cast("int"), F.col("n") <= SKETCH
    size, needed = F.lit(sketch_size(40)), F.lit(need(sketch_size(40), percent))
    for p in range(39, SKETCH.bit_length() - 1, -1):
        size, needed = F.when(partition == p, sketch_size(p)).otherwise(size), F.when(partition == p, need(sketch_size(p), percent)).otherwise(needed)
    ranked = sets.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("h"))).filter(whole | (F.col("r") <= size))
    return ranked.select("item", "h", partition.alias("partition"), F.when(whole, F.ceil(F.col("n") * percent / 100).cast("int")).otherwise(needed).alias("need"))


def likely_pairs(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(uid, th, item) of the document shingles docs(uid, th, h) that meet enough of an item's sketch."""
    top = sketches.agg(F.max("h")).first()[0]
    met = docs.filter(F.col("h") <= F.lit(top).cast("long")).join(sketches, "h").groupBy("uid", "th", "partition", "item", "need").agg(F.count_distinct("h").alias("met"))
    return met.filter("met >= need").select("uid", "th", "item")


def verified(likely: DataFrame, docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(uid, th, item_id, n, n_common) of the candidates that hold percent of the item's shingles or more."""
    wanted = likely.join(sets, "item")
    both = wanted.join(docs.distinct(), ["uid", "th", "h"]).groupBy("uid", "th", "item", "item_id", "n").agg(F.count("*").alias("n_common"))
    return both.filter(100 * F.col("n_common") >= percent * F.col("n"))


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, th, item_id, n_item, n_common) of documents that hold percent of an item's shingles or more."""
    base = docs.select(row_id(id_col).alias("uid"), text_key(text_col).alias("th"), F.col(text_col).alias("text"))
    own = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    own = written(own.withColumn("item", F.monotonically_increasing_id()), "items")
    sets = written(shingles(own, "text", shingle, "item", "item_id").distinct(), "item-shingles")
    sets = written(sets.withColumn("n", F.count("*").over(Window.partitionBy("item"))), "item-sets")
    sketches = written(sketched(sets, percent), "sketches")
    likely = written(likely_pairs(shingles(base, "text", shingle, "uid", "th"), sketches), "candidates")
    # The texts of candidates by a join that always shuffles, so that the plan is the same at every size.
    again = base.join(likely.select("uid", "th").distinct().hint("merge"), ["uid", "th"], "left_semi")
    out = verified(likely, shingles(again, "text", shingle, "uid", "th"), sets, percent)
    return out.select(F.when(F.col("uid") != NO_ID, F.col("uid")).alias("doc_id"), "th", "item_id", F.col("n").alias("n_item"), "n_common")


def decontaminate(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """The rows of docs that hold no item, unchanged."""
    found = written(find_items(docs, items, **kw).select(F.col("doc_id").alias("id"), "th").distinct(), "found")
    rows = docs.select(packed(docs), quoted(kw.get("id_col", "doc_id")).alias("own"), text_key(kw.get("text_col", "text")).alias("own_th"))
    return rows.join(found.hint("merge"), F.col("own").eqNullSafe(F.col("id")) & (F.col("own_th") == F.col("th")), "left_anti").select("row.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "n_item", "n_common")


OP4_SQL = r"""
WITH lowered AS (SELECT 0 AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM lowered),
s AS (SELECT DISTINCT kind, id, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) AS h FROM w WHERE len(w) >= 5),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id),
c AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_common FROM s d JOIN s b USING (h) WHERE d.kind = 0 AND b.kind = 1 GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_item, n_common FROM c JOIN n ON c.item_id = n.id WHERE 100 * n_common >= 80 * n
"""
