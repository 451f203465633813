"""Dice of the native variant in blocks, and the baseline's lists, against a table of all pairs."""

import pytest
from pyspark.sql import functions as F

from entwine import pool_queries
from entwine import queries as q
from entwine.functions import sets, text
from entwine.operators import native, select
from entwine.plans import baseline


def brute(v):
    r = v.raw.select("entity_id", text.ascii_clean(F.col("business_name")).alias("name"), text.ascii_clean(F.col("business_address")).alias("addr"))
    g = r.select("entity_id", *[sets.ngrams(F.col(c), n, whole=False).alias(f"{c}{n}") for c in ("name", "addr") for n in (2, 3)])
    side = lambda name, p: g.select(F.col("entity_id").alias(name), *[F.col(c).alias(f"{p}_{c}") for c in native.DICE])
    pairs = v.edges.select("s1_id", "cand_id").join(side("s1_id", "q"), "s1_id").join(side("cand_id", "c"), "cand_id")
    return pairs.select("s1_id", "cand_id", *[F.round(sets.dice(F.col(f"q_{c}"), F.col(f"c_{c}"), 0.0), 6).alias(c) for c in native.DICE])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Names with and without company words, of no ASCII letters, too short for a gram or a key, and one large key."""
    names = ["acme limited", "acme ltd", "Acme  Ltd.", "acme", "été où", "ab", "a", "日本語", "日本語 limited", "", "x company limited", "x co ltd"]
    path = tmp_path_factory.mktemp("native")
    rows = [(i, f"{n}\n{a}", c, "web", 9) for i, (n, a, c) in enumerate((n, a, c) for n in names for a in ("", "1 main st", "ü", "22 élan road b") for c in ("en", "fr", None) for _ in range(3))]
    rows += [(1000 + i, f"one large key\nline {i % 17} of it", "en", "web", 9) for i in range(400)] + [(5000, None, "en", "web", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("view", [q.View, pool_queries.Worded])
def test_blocks_make_every_pair_once(spark, folder, view):
    v = view(spark, folder)
    want = sorted(map(tuple, brute(v).collect()))
    assert len(want) > 5_000 and len({w[2:] for w in want}) > 5
    for rows, columns, pairs in ((native.ROWS, native.COLUMNS, native.PAIRS), (7, 30, 500)):
        assert sorted(map(tuple, native.paired_dice(v.recs, 6, rows, columns, pairs).collect())) == want


def test_pairs_are_not_shuffled(spark, folder):
    """Neither the query nor what it writes sends a row of a pair: only records are dealt."""
    df = native.paired_dice(q.View(spark, folder).recs, 6, 7, 30, 500)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.index("MapInArrow") < plan.index("Exchange")
    assert df.rdd.getNumPartitions() > 20  # the large key alone makes about 35,000 pairs


def test_ids_that_repeat(spark, tmp_path):
    rows = [(i % 6, f"name {i % 2}\nline {i % 4}", "en", "web", 9) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = q.queries()["native_dice"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, brute(q.View(spark, str(tmp_path))).collect())) != []


@pytest.mark.parametrize("view", [q.View, pool_queries.Worded])
@pytest.mark.parametrize("most", [1, 3, 50])
def test_baseline_lists_need_no_table_of_all_pairs(spark, folder, view, most, monkeypatch):
    recs = view(spark, folder).recs
    recs = recs.unionByName(recs.filter("id like '%4'").withColumn("name_norm_suf", F.lit("acme ltd")))  # ids that repeat, with other keys
    pairs = baseline.joined(recs)
    monkeypatch.setattr(baseline, "joined", None)
    cols = ["s1_id", "cand_id", "conf"]
    for got, want in ((baseline.first_candidates(recs, most), select.top_candidates(pairs, most)), (baseline.best_records(recs, most), select.one_pass(pairs, most))):
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect())) != []
    assert baseline.baseline(recs)[1].count() == recs.filter("src = 1").count()
