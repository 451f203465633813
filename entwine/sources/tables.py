"""Readers of delimited and columnar sources, and the entity view over a document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entwine.functions.text import non_ascii, normalize, numeric_tokens, short_suffixes, tokens

RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType = RAW, columns: list[str] | None = None, quoted: bool = False) -> DataFrame:
    """A TSV with a header; cells are raw unless quoted, short rows get empty cells, extra cells are dropped, nothing is null."""
    reader = spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "PERMISSIVE").option("encoding", "UTF-8").option("enforceSchema", True)
    df = reader.option("quote", '"' if quoted else "").csv(path)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns or schema.names])


def rows(df: DataFrame):
    """Rows as dicts, a partition at a time."""
    return (r.asDict() for r in df.toLocalIterator())


def source_of(entity_id: Column) -> Column:
    return F.when(entity_id.startswith("S1-"), 1).when(entity_id.startswith("S2-"), 2).otherwise(3)


def native_rows(raw: DataFrame, source: int | None = None, country: str | None = None) -> DataFrame:
    """Rows of one source and country, with trailing white space of the country cut."""
    out = raw.withColumn("country", F.regexp_replace("country", r"[\r ]+$", ""))
    out = out if source is None else out.filter(source_of(F.col("entity_id")) == source)
    return out if country is None else out.filter(F.col("country") == country)


def ids(df: DataFrame, column: str = "entity_id") -> DataFrame:
    return df.select(column).distinct()


def truth_long(wide: DataFrame, id_col: str = "source1_entity_id", list_col: str = "matched_entity_ids") -> DataFrame:
    """(s1_id, matched_id, msrc) of comma lists; empty lists give no row."""
    one = wide.select(F.col(id_col).alias("s1_id"), F.explode(F.split(F.coalesce(list_col, F.lit("")), ",")).alias("m")).select("s1_id", F.trim("m").alias("matched_id"))
    return one.filter("matched_id <> ''").withColumn("msrc", F.when(F.col("matched_id").startswith("S2-"), "S2").otherwise("S3"))


def truth_sets(ids_: DataFrame, long: DataFrame) -> DataFrame:
    """(s1_id, matched): a sorted set for every id, empty for singletons."""
    sets = long.groupBy("s1_id").agg(F.sort_array(F.collect_set("matched_id")).alias("matched"))
    return ids_.join(sets, "s1_id", "left").select("s1_id", F.coalesce("matched", F.array().cast("array<string>")).alias("matched"))


def records(raw: DataFrame) -> DataFrame:
    """The sixteen typed columns of every record, and its distinct token arrays, in one projection."""
    r = raw.select(F.col("entity_id").alias("id"), "country", F.col("business_name").alias("name"), F.col("business_address").alias("addr"))
    r = r.withColumns({"name_norm": normalize(F.col("name")), "addr_norm": normalize(F.col("addr")), "addr_nums": numeric_tokens(F.col("addr"))})
    r = r.withColumns({"name_norm_suf": short_suffixes(F.col("name_norm")), "addr_num": F.array_join("addr_nums", " "), "name_toks": tokens(F.col("name_norm")), "addr_toks": tokens(F.col("addr_norm"))})
    return r.select(
        source_of(F.col("id")).cast("tinyint").alias("src"), "id", "country", "name", "addr", "name_norm", "name_norm_suf", "addr_norm", "addr_num",
        F.char_length("name_norm").alias("nlen"), F.char_length("addr_norm").alias("alen"), F.size("name_toks").alias("ntok"), F.size("addr_toks").alias("atok"),
        non_ascii(F.col("name")).cast("tinyint").alias("non_a_name"), non_ascii(F.col("addr")).cast("tinyint").alias("non_a_addr"), (F.col("addr") == "").cast("tinyint").alias("addr_missing"),
        F.array_distinct("name_toks").alias("name_toks"), F.array_distinct("addr_toks").alias("addr_toks"), "addr_nums",
    )


def entity_view(docs: DataFrame) -> DataFrame:
    """Raw source rows made from documents: three sources by id, name and address from the first two lines."""
    src = F.col("doc_id") % 3 + 1
    d = docs.select("doc_id", "lang", src.alias("src"), F.split("text", "\n").alias("l"))
    d = d.select("doc_id", "lang", "src", F.split(F.get("l", F.lit(0)), " ").alias("first"), F.get("l", F.lit(1)).alias("second"))
    d = d.withColumn("words", F.split("second", " "))
    addr = F.when(F.col("second").isNull() | (F.col("second") == ""), "").otherwise(F.concat(F.char_length("second").cast("string"), F.lit(" "), F.array_join(F.slice("words", 1, 8), " "), F.lit(" "), F.size("words").cast("string"), F.lit("w")))
    return d.select(F.concat(F.lit("S"), F.col("src").cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), F.array_join(F.slice("first", 1, 6), " ").alias("business_name"), addr.alias("business_address"), F.col("lang").alias("country"))


def proxy_truth(docs: DataFrame) -> DataFrame:
    """Truth of the entity view: equal normalised texts of a country, each candidate with its smallest record of source 1."""
    d = docs.select("doc_id", F.col("lang").alias("country"), (F.col("doc_id") % 3 + 1).alias("src"), F.md5(normalize(F.col("text"))).alias("t"))
    first = d.filter("src = 1").groupBy("country", "t").agg(F.min("doc_id").alias("s1"))
    hit = d.filter("src > 1").join(first, ["country", "t"])
    name = lambda s, i: F.concat(F.lit("S"), s.cast("string"), F.lit("-"), i.cast("string"))
    return hit.select(name(F.lit(1), F.col("s1")).alias("s1_id"), name(F.col("src"), F.col("doc_id")).alias("matched_id"), F.concat(F.lit("S"), F.col("src").cast("string")).alias("msrc"))
