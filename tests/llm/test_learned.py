"""Quality, neighbours, tokens."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from entwine.llm import ann, quality, token_counts

from .test_native import clashing


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    os.path.isdir(sf) or pytest.skip("no test tables")
    got = quality.op5_quality(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = got.filter("held_out").join(labels, "doc_id").toPandas()
    assert len(r) > 50 and (r.predicted == r.quality).mean() >= 0.95
    rows = got.toPandas()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.7)).all()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert quality.learn(docs, labels) == quality.learn(docs.repartition(5), labels.repartition(3))


def test_quality_never_learns_from_held_out_rows(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.learn(docs, labels) == quality.learn(docs, flipped)


def test_rules_compile_to_what_was_fit(spark):
    r = np.random.RandomState(1)
    x = r.rand(600, 15)
    y = ((x[:, 3] > 0.6) | (x[:, 1] < 0.2)).astype(float)
    b, rules = quality.fit(x, y)
    hits = lambda v: b + sum(w for w, rule in rules if all((v[f] > c) == s for f, c, s in rule))
    want = [1 / (1 + np.exp(-hits(v))) for v in x[:50]]
    names = [f"s_{k}" for k in quality._statistics()]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x[:50])], "i int, " + ", ".join(f"{n} double" for n in names))
    got = [s.p for s in df.select("i", quality.compile_rules(b, rules).alias("p")).orderBy("i").collect()]
    assert got == pytest.approx(want) and len(rules) < 120
    assert np.mean((np.array([hits(v) for v in x]) > 0) == y) > 0.95


def test_quality_odd_rows(spark):
    df = clashing(spark, [(1, None, None), (2, "", "s"), (None, "A b. " * 20_000, "s"), (3, "x", "s"), (3, "x", "s")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.score, 2) for r in quality.score(df, quality.learn(df, none), "doc_id", "row", "t", "a.b").collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (2, None), (1, 7)], "doc_id long, quality int")
    assert all(r.score > 0.9 for r in quality.score(df, quality.learn(df, one), "doc_id").collect())
    assert quality.score(df.limit(0), (0.0, []), "doc_id").count() == 0


def test_statistics_by_plain_python(spark):
    import re

    texts = ["", "Plain text, with words. And words.\nSecond line!", "AB | cd | ef\n\nAB AB ab\n", "é Ü 日本 #1 $2\t\n12 12 x", "a  a a\nend.", "!!! ??? ...", " \n ", "one.\ntwo!\nthree?"]
    for r in quality.statistics(spark.createDataFrame(list(enumerate(texts)), "i int, x string"), "x", "i").collect():
        t = texts[r.row.i]
        w, lines = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x], t.split("\n")
        chars, n = max(len(t), 1), max(len(w), 1)
        rate = lambda ok: sum(map(ok, t)) / chars
        want = {
            "chars": len(t), "words": len(w), "word_length": len(t) / n, "distinct": len(set(w)) / n, "upper": rate(str.isupper), "marks": rate(lambda c: c in "#$%&*@~^_=+<>"), "bars": rate("|".__eq__), "shouts": rate("!".__eq__),
            "digits": rate(lambda c: c in "0123456789"), "stops": rate(lambda c: c in ".,;:?"), "again": len(re.findall(r"(?<![^\s])(\S+)[ \t]+\1(?![^\s])", t, re.ASCII)) / n, "lines": len(lines), "line_length": chars / len(lines),
            "distinct_lines": len(set(lines)) / len(lines), "ended_lines": sum(x[-1:] in (".", "!", "?") and x != "" for x in lines) / len(lines),
        }
        assert {k: r[f"s_{k}"] for k in want} == pytest.approx(want), t


# ---- neighbours


def brute(rows, every, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, float) / max(map(abs, v))
    out = {}
    for q in ok:
        if q % every == 0:
            s = sorted((-round(float(ok[q] @ ok[c] / np.linalg.norm(ok[q]) / np.linalg.norm(ok[c])), 12), c) for c in ok if c != q)[:k]
            out[q] = [c for _, c in s]
    return out


def test_neighbours_of_odd_rows(spark):
    r = np.random.RandomState(3)
    rows = [(i, r.standard_normal(8).tolist()) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(30)]  # many equal vectors: ties go to smaller ids
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] + [1.0] * 7), (204, [float("inf")] + [1.0] * 7), (205, [None] + [1.0] * 7), (None, [1.0] * 8), (206, [1e-200] * 8), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1, 1.0) for i, v in rows], "vec_id long, embedding array<double>, key int, score double")
    got = {}
    for x in sorted(ann.nearest(df, every=10, k=5).collect(), key=lambda x: (x.query_id, x["rank"])):
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert got == brute(rows, 10, 5)
    assert ann.nearest(df.limit(0)).count() == 0
    assert [tuple(x)[:3] for x in ann.nearest(df.filter("vec_id in (10, 11)"), every=10).collect()] == [(10, 1, 11)]


def test_neighbours_in_parts_and_slices(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_MOST", 16)
    monkeypatch.setattr(ann, "SLICE", 3)
    r = np.random.RandomState(5)
    rows = [(i, r.standard_normal(8).tolist()) for i in range(120)]
    rows += [(200 + i, (np.array(rows[7][1]) * 2.0 ** (i - 20)).tolist()) for i in range(40)]  # ties of different vectors
    got = {}
    for x in sorted(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).collect(), key=lambda x: (x.query_id, x["rank"])):
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert got == brute(rows, 10, 5)


def test_ties_and_ids_of_many_vectors(spark):
    r = np.random.RandomState(11)
    v = r.standard_normal(8).astype(np.float32).astype(float)
    rows = [(i, r.standard_normal(8).tolist()) for i in range(20, 40)] + [(0, v.tolist())]
    rows += [(10 + i, (v * m).tolist()) for i, m in enumerate((3.0, 7.0, 1.0, 11.0, 9.0, 5.0, 13.0, 6.0))]  # exact multiples: all tie
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x["rank"], x.vec_id, x.score) for x in ann.nearest(df.repartition(3), every=50).collect() if x.query_id == 0)
    assert got == [(i + 1, 10 + i, 1.0) for i in range(5)]
    # One id with many vectors nearer than all others, and the query's own vectors, leave five distinct neighbours.
    near = [(50, (v + 1e-3 * r.standard_normal(8)).tolist()) for _ in range(40)] + [(0, (v + 1e-3 * r.standard_normal(8)).tolist()) for _ in range(40)]
    far = rows[:20] + [(0, v.tolist())]
    out = [x for x in ann.nearest(spark.createDataFrame(far + near, "vec_id long, embedding array<double>"), every=100).collect()]
    of = {i: np.array([y for j, y in far + near if j == i]) for i, _ in far + near}
    cos = lambda a, b: max(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)) for x in a for y in b)
    want = sorted((-cos(of[0], of[i]), i) for i in of if i)[:5]
    assert [x.vec_id for x in sorted(out, key=lambda x: x["rank"])] == [i for _, i in want] and want[0][1] == 50


def test_cosines_are_the_nearest_doubles():
    from fractions import Fraction
    from math import isqrt

    r = np.random.RandomState(4)
    x, y = r.standard_normal((40, 9)), r.standard_normal((40, 9)) * 10.0 ** r.randint(-150, 150, (40, 1))
    for a, b, c in zip(x, y, ann.cosines(x, y), strict=True):
        a, b = [Fraction(float(t)) for t in a], [Fraction(float(t)) for t in b]
        dot, size = sum(p * q for p, q in zip(a, b, strict=True)), sum(p * p for p in a) * sum(p * p for p in b)
        square = dot * dot / size
        root = Fraction(isqrt(square.numerator * square.denominator << 400), square.denominator << 200)
        assert float(root if dot > 0 else -root) == c


def test_slices_follow_the_queries_of_a_block():
    r = np.random.RandomState(8)
    u = ann.unit(r.standard_normal((400, 8)))
    curves = ann.Curves(u)
    keys = curves.keys(u)
    marks = np.sort(keys, axis=0).T
    cuts = np.stack([m[[40, 160, 300]] for m in marks])
    batch = pa.RecordBatch.from_arrays([pa.array(list(u), pa.list_(pa.float64()))], names=["vec"])
    for query, reach in ((False, 0.0), (True, 0.1), (True, 1.0)):
        want = np.zeros((ann.CURVES, 4), int)
        for c in range(ann.CURVES):
            for key in keys[:, c]:
                at = int(np.searchsorted(cuts[c], key, "right"))
                lo, hi = (int(x[0]) for x in ann._span(np.array([key]), cuts[c], marks[c], reach)) if query else (at, at)
                assert lo <= at <= hi and (reach < 1 or (lo, hi) == (0, 3))
                want[c, lo : hi + 1] += 1
        got = np.zeros_like(want)
        for b in ann._sizes(curves, cuts, marks, reach, query)(iter([batch, batch.slice(0, 0)])):
            for c, block, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                got[c, block] = n
        assert (got == want).all()


def test_neighbour_recall(spark, sf):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, 50, 5)
    got = {}
    for x in ann.nearest(df).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    assert sum(len(got[q] & set(v)) for q, v in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_hilbert_keys_are_a_walk():
    side = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = side[np.argsort(ann.hilbert(side, 3))]
    assert len(set(ann.hilbert(side, 3).tolist())) == 512
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# ---- tokens


def test_tokens_add_up_and_follow_the_rule(spark):
    import tiktoken

    texts = ["", None, "a\n", "\n\n", "Hello  world\n\n  déjà vu\n日本語 🙂 <|endoftext|>", "x " * 30_000, "line\r\nline", "no break at end\nlast"]
    with open(token_counts.VOCABULARY, encoding="ascii") as f:
        ranks = token_counts.load_ranks(f.readlines())
    coder = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {}
    for r in token_counts.count_tokens(clashing(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.n_bytes, r.n_tokens, r.n_crossing)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        parts = raw.split(b"\n")
        parts = [p + b"\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] or len(parts) == 1 else [])
        ends, at, want = np.cumsum([len(p) for p in parts]), 0, [[len(p), 0, 0] for p in parts]
        ids = coder.encode_ordinary(raw.decode())
        assert b"".join(coder.decode_single_token_bytes(x) for x in ids) == raw
        for x in ids:
            n = len(coder.decode_single_token_bytes(x))
            s = next(j for j, e in enumerate(ends) if at < e)
            want[s][1] += 1
            want[s][2] += at + n > ends[s]
            at += n
        assert [got[i][j] for j in range(len(parts))] == [tuple(w) for w in want] and len(got[i]) == len(parts)
    assert token_counts.count_tokens(clashing(spark, []).limit(0)).count() == 0


def test_tokens_of_long_runs_of_white_space(spark):
    texts = ["a" + "\n" * 1_000_000 + "b", " " * 2_000_000, "word " * 3 + "\t" * 120_000 + " end"]
    got = token_counts.count_tokens(clashing(spark, [(i, t, "s") for i, t in enumerate(texts)])).groupBy("doc_id").agg(F.sum("n_bytes").alias("b"), F.sum("n_tokens").alias("n"), F.max("section").alias("s")).collect()
    got = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        assert got[i].b == len(t) and 0 < got[i].n <= len(t)
        assert "".join(token_counts.stretches(t)) == t
    assert got[0].s == 1_000_000
    assert list(token_counts.stretches(" " * token_counts.STRETCH + "x")) == [" " * token_counts.STRETCH + "x"]


def test_tokens_need_a_vocabulary(spark):
    with pytest.raises(FileNotFoundError, match="vocabulary"):
        token_counts.count_tokens(clashing(spark, []), vocabulary="/nowhere")
