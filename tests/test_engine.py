import random

import pytest
from pyspark.sql import functions as F

from entwine.operators import blocking, metrics, sampling, select, validate
from entwine.plans import baseline
from entwine.sources import sinks, tables


def greedy(edges, least, most):
    used, count, out = set(), {}, set()
    for c, s, d in sorted((-c, s, d) for s, d, c in edges if c >= least):
        if d not in used and count.get(s, 0) < most:
            used.add(d)
            count[s] = count.get(s, 0) + 1
            out.add((s, d))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_assign_equals_greedy(spark, seed):
    r = random.Random(seed)
    edges = list({(f"S1-{r.randrange(12)}", f"S2-{r.randrange(40)}"): r.randrange(85, 100) / 100 for _ in range(160)}.items())
    edges = [(s, d, c) for (s, d), c in edges]
    df = spark.createDataFrame(edges, "s1_id string, cand_id string, conf double")
    got = {(x.s1_id, x.cand_id) for x in select.assign(df, 0.88, 2).collect()}
    assert got == greedy(edges, 0.88, 2)


def test_assign_all_tied_and_empty(spark):
    edges = [(f"S1-{i}", f"S2-{j}", 0.9) for i in range(3) for j in range(5)]
    df = spark.createDataFrame(edges, "s1_id string, cand_id string, conf double")
    assert {(x.s1_id, x.cand_id) for x in select.assign(df, 0.88, 2).collect()} == greedy(edges, 0.88, 2)
    assert select.assign(df.limit(0)).count() == 0


def test_metric_worked_example_and_conventions(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1_id string")
    pred = spark.createDataFrame([("a", "S2-47"), ("a", "S2-193"), ("a", "S3-812"), ("c", "x")], "s1_id string, cand_id string")
    truth = spark.createDataFrame([("a", "S2-47", "S2"), ("a", "S3-812", "S3"), ("d", "x", "S2")], "s1_id string, matched_id string, msrc string")
    got = {r.s1_id: r.f05 for r in metrics.entity_scores(pred, truth, ids).collect()}
    assert got["a"] == pytest.approx(0.7142857)
    assert (got["b"], got["c"], got["d"]) == (1.0, 0.0, 0.0)


def test_auc_matches_pairs(spark):
    r = random.Random(5)
    rows = [(r.randrange(6) / 5, r.random() < 0.4) for _ in range(80)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.auc(spark.createDataFrame(rows, "s double, y boolean"), "s", "y").first().auc == pytest.approx(want, abs=1e-6)


def _raw(spark, rows):
    return spark.createDataFrame(rows, tables.RAW)


def test_blocks_at_and_over_the_cap(spark):
    rows = [("S1-0", "acme tools", "", "x")] + [(f"S2-{i}", "acme tools", "", "x") for i in range(4)] + [("S1-1", "other shop", "", "x")] + [(f"S3-{i}", "other shop", "", "x") for i in range(3)]
    recs = tables.records(_raw(spark, rows))
    caps = blocking.Caps(name=3, name_token=3)
    got = blocking.candidates(recs, caps)
    assert {r.cand_id for r in got.collect()} == {"S3-0", "S3-1", "S3-2"}
    assert {r["mask"] for r in got.collect()} == {blocking.NAME | blocking.NAME_TOKEN}
    assert blocking.budgeted(got, blocking.Caps(budget=2)).count() == 2


def test_records_of_odd_rows(spark):
    rows = tables.records(_raw(spark, [("S1-1", "", "", "x"), ("S2-1", "!!!", "--", "x"), ("Q", "İ é", "No. 7", "y")])).orderBy("id").collect()
    assert [(r.id, r.src, r.name_norm, r.addr_missing) for r in rows[1:]] == [("S1-1", 1, "", 1), ("S2-1", 2, "", 0)]
    assert (rows[0].src, rows[0].addr_num) == (3, "7")


def test_tsv_round_trip(spark, tmp_path):
    src = tmp_path / "in.tsv"
    src.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Joe"s" Bar\t\tfr \nS2-1\tA\n', encoding="utf-8")
    df = tables.read_tsv(spark, str(src))
    assert sorted(tuple(r) for r in df.collect()) == [("S1-1", '"Joe"s" Bar', "", "fr "), ("S2-1", "A", "", "")]
    assert len(list(tables.rows(df))) == 2
    assert tables.native_rows(df, 1, "fr").count() == 1
    out = str(tmp_path / "out")
    sinks.write_tsv(df, out)
    assert sorted(tuple(r) for r in tables.read_tsv(spark, out).collect()) == sorted(tuple(r) for r in df.collect())
    sinks.write_parquet(df, str(tmp_path / "p"), "country")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_truth_lists_and_validation(spark):
    wide = spark.createDataFrame([("S1-1", "S2-1, S3-2"), ("S1-2", ""), ("S1-3", None)], tables.TRUTH)
    long = tables.truth_long(wide)
    assert sorted(tuple(r) for r in long.collect()) == [("S1-1", "S2-1", "S2"), ("S1-1", "S3-2", "S3")]
    ids = wide.select(F.col("source1_entity_id").alias("s1_id"))
    assert {r.s1_id: r.matched for r in tables.truth_sets(ids, long).collect()} == {"S1-1": ["S2-1", "S3-2"], "S1-2": [], "S1-3": []}
    pairs = long.select("s1_id", F.col("matched_id").alias("cand_id"))
    m, c = sinks.bundle(ids, pairs, pairs.limit(1))
    known = spark.createDataFrame([("S2-1",), ("S3-2",)], "id string")
    assert validate.valid(m, c, ids, known)
    assert validate.outside_candidates(m, c).count() == 0
    assert not validate.valid(m.union(m.limit(1)), c, ids, known)
    lines = spark.createDataFrame([("source1_entity_id\tmatched_entity_ids",), ("S1-1",), ("source1_entity_id,x",)], "value string")
    assert (validate.malformed(lines).count(), validate.header_errors(lines).count()) == (2, 1)


def test_stratified_split_is_stable_and_covers_strata(spark):
    s1 = spark.createDataFrame([(f"S1-{i}", "ab"[i % 2]) for i in range(50)], "s1_id string, country string")
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}", "S2") for i in range(0, 50, 7)], "s1_id string, matched_id string, msrc string")
    a = {r.s1_id for r in sampling.stratified(s1, truth, 0.1).collect()}
    assert a == {r.s1_id for r in sampling.stratified(s1.repartition(7), truth, 0.1).collect()}
    assert len({(r.country, r.bucket) for r in sampling.stratified(s1, truth, 0.1).collect()}) == 4


def test_baseline_invariants(spark, sf):
    recs = tables.records(tables.entity_view(spark.read.parquet(f"{sf}/documents.parquet")))
    m, c = baseline.baseline(recs)
    s1 = recs.filter("src = 1").select(F.col("id").alias("s1_id"))
    assert validate.valid(m, c, s1, recs.filter("src > 1").select("id"))
    assert validate.outside_candidates(m, c).count() == 0


def test_model_saves_and_scores(spark, sf, tmp_path):
    from entwine.operators import model
    from entwine.queries import View

    lab = View(spark, sf).labelled.withColumn("label", F.col("label").cast("int")).cache()
    m = model.train(lab, trees=3, depth=3)
    model.save(m, str(tmp_path / "m"))
    a, b = (model.predict(x, lab).orderBy("s1_id", "cand_id").select("prob").collect() for x in (m, model.load(str(tmp_path / "m"))))
    trees = model.trees_table(m)
    assert a == b and trees.select("tree").distinct().count() == 3
    by_table = [r.prob for r in model.predict_by_table(trees, lab).orderBy("s1_id", "cand_id").collect()]
    assert by_table == pytest.approx([r.prob for r in a])
    assert metrics.auc(model.predict(m, lab), "prob", "label").first().auc > 0.9


def test_streaming_scores_like_a_batch(spark, sf, tmp_path):
    from entwine.streaming import score

    raw = tables.entity_view(spark.read.parquet(f"{sf}/documents.parquet"))
    new = raw.filter(tables.source_of(F.col("entity_id")) == 1)
    new.coalesce(1).write.parquet(str(tmp_path / "in"))
    known = tables.records(raw)
    got = []
    q = score.start(spark.readStream.schema(new.schema).parquet(str(tmp_path / "in")), known, lambda df, i: got.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(got) == sorted(score.match_batch(new, known).collect())


@pytest.fixture(scope="module")
def large_blocks(spark, tmp_path_factory):
    """390 documents of one country: ten names of 13 records a source, every text its own."""
    path = tmp_path_factory.mktemp("blocks")
    rows = [(i, f"some name {i // 39}\nown{i} words", "en", "web", 20) for i in range(390)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_random_negatives_are_not_cut_at_100(spark, large_blocks):
    from entwine import queries

    got = queries.queries()["random_negatives"](spark, large_blocks).collect()
    assert len(got) == 260 and len({r.s1_id for r in got}) == 130 and len({r.cand_id for r in got}) == 260


def test_key_join_keeps_blocks_over_50_pairs(spark, large_blocks):
    from entwine import queries

    got = {(r.s1_id, r.cand_id) for r in queries.queries()["bounded_key_join"](spark, large_blocks).collect()}
    ids = [(i // 39, 1 + i % 3, f"S{1 + i % 3}-{i}") for i in range(390)]
    assert got == {(q, c) for g, s, q in ids if s == 1 for h, t, c in ids if t > 1 and g == h}


def test_assignment_equals_greedy_by_11(spark, sf):
    from entwine import queries

    edges = [(r.s1_id, r.cand_id, r.conf) for r in queries.View(spark, sf).edges.select("s1_id", "cand_id", "conf").collect()]
    got = {(r.s1_id, r.cand_id) for r in queries.queries()["assign_disjoint"](spark, sf).collect()}
    assert got == greedy(edges, 0.88, 11) != greedy(edges, 0.88, 2)
