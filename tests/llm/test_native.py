"""Sharding, decontamination, chat formatting, line dedup, mixing: SQL or brute force, and defined results of odd rows."""

import hashlib
import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from entwine.llm import chat, decontamination, line_dedup, mixing, queries, sharding

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, row string, slot int, shard int, id long, th long, own long, w int, t int, score double, size int, h long, `a.b` string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, k=5):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "r", 1, 1, 1, 1, 1, 1, 1, 0.5, 1, 1, "x") for i, t, s in rows], CLASH)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    key = lambda r: tuple(x.item() if hasattr(x, "item") else x for x in r)
    got, want = queries.queries()[name](spark, sf).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(key, got[cols].itertuples(index=False)), key=repr) == sorted(map(key, want[cols].itertuples(index=False)), key=repr)


# ---- sharding


def test_fill_takes_turns():
    names = [f"n{i}" for i in range(5)]
    owner = sharding.fill(names, 101)
    assert max(Counter(owner).values()) - min(Counter(owner).values()) <= 1
    # Brute force: whole preference lists, shards in turn.
    d = [hashlib.md5(n.encode()).hexdigest() for n in names]
    prefs = [[(int(x[:15], 16) % 101 + j * (int(x[15:30], 16) % 100 + 1)) % 101 for j in range(101)] for x in d]
    want, i = {}, 0
    while len(want) < 101:
        s = next(p for p in prefs[i % 5] if p not in want)
        want[s] = i % 5
        i += 1
    assert owner == [want[s] for s in range(101)]
    fewer = sharding.fill(names[:4], 101)
    assert sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 4) < 30
    for bad in (([], 101), (["a", "a"], 101), (["a"], 100)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_shard_odd_rows(spark):
    df = clashing(spark, [(None, "x", None), (1, None, "s"), (1, "", "s"), (2, "y" * 100_000, "s")])
    got = sharding.shard(df, shards=4, slots=11)
    assert got.columns == [c for c in df.columns if c not in ("slot", "shard")] + ["slot", "shard"]
    rows = got.collect()
    assert len(rows) == 4 and all(0 <= r.slot < 11 and 0 <= r.shard < 4 for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert sharding.shard(df.limit(0)).count() == 0


# ---- decontamination


def test_items_found_by_brute_force(spark):
    base = [f"w{i}" for i in range(400)]
    items = [(0, " ".join(base[10:30])), (1, " ".join(base[100:160]).upper()), (2, "too short item"), (None, " ".join(base[200:212])), (4, None)]
    docs = [
        (0, " ".join(["z"] * 3000 + base[5:40] + ["y"] * 3000)),
        (1, " ".join(base[100:112] + ["edit"] + base[113:160])),
        (2, " ".join(base[100:130] + ["a"] * 9)),
        (3, None), (4, ""), (5, " ".join(base[200:212])), (None, " ".join(base[10:30])), (7, "w10 w11"), (7, " ".join(base)), (8, " ".join(base[10:30])), (8, " ".join(base[10:30])),
    ]
    d = clashing(spark, [(i, t, "s") for i, t in docs])
    it = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = sorted({(i, k, len(shingles(b)), len(shingles(b) & shingles(t))) for i, t in docs for k, b in items if shingles(b) and 5 * len(shingles(b) & shingles(t)) >= 4 * len(shingles(b))}, key=repr)
    got = sorted({tuple(r) for r in decontamination.find_items(d, it).select("doc_id", "item_id", "n_item", "n_common").collect()}, key=repr)
    assert got == want and len(got) >= 6
    clean = decontamination.decontaminate(d, it)
    assert clean.columns == d.columns
    assert sorted((r.doc_id, r.text or "") for r in clean.collect()) == sorted((i, t or "") for i, t in docs if i is not None and not any(w[0] == i and shingles(dict(items)[w[1]]) <= shingles(t) or (w[0] == i == 1 and t) for w in want))
    for x, y in ((d.limit(0), it), (d, it.limit(0))):
        assert decontamination.find_items(x, y).count() == 0
    assert decontamination.decontaminate(d, it.limit(0)).count() == len(docs)


def test_partitions_have_sketches_of_their_own(spark):
    r = list(range(1, 41))
    sizes = [decontamination.sketch_size(p) for p in r]
    needs = [decontamination.need(n, 80) for n in sizes]
    assert sizes[4:8] == [16, 24, 32, 40] and all(a < b for a, b in zip(needs[4:12], needs[5:13], strict=False)) and all(a < b for a, b in zip(needs, sizes, strict=True))
    rows = [(i, n, h) for i, n in enumerate((5, 16, 17, 32, 33, 64, 200)) for h in (x * 7919 % 10007 for x in range(1, n + 1))]
    got = {}
    for x in decontamination.sketched(spark.createDataFrame(rows, "item long, n long, h long"), 80).collect():
        got.setdefault(x.item, []).append((x.h, x.partition, x.need))
    for i, n in enumerate((5, 16, 17, 32, 33, 64, 200)):
        k = n if n <= 16 else decontamination.sketch_size((n - 1).bit_length())
        assert sorted(h for h, _, _ in got[i]) == sorted(h for j, _, h in rows if j == i)[:k]
        assert {(p, t) for _, p, t in got[i]} == {((n - 1).bit_length(), -(-4 * n // 5) if n <= 16 else decontamination.need(k, 80))}


def test_sketches_rule_out_and_verification_decides(spark):
    item = [(1, 100, h) for h in range(100)]
    sketches = decontamination.sketched(spark.createDataFrame(item, "item long, n long, h long"), 80)
    holds = lambda share: [h for h in range(100) if h * 37 % 100 < share]
    docs = [(d, 0, h) for d, share in enumerate((100, 82, 70, 20, 0)) for h in [*holds(share), *range(10_000, 10_050)]]
    d = spark.createDataFrame(docs, "uid long, th long, h long")
    likely = decontamination.likely_pairs(d, sketches)
    met = {x.uid for x in likely.collect()}
    assert {0, 1} <= met and not {3, 4} & met and 2 in met  # 70 meets the sketch, but is not verified
    sets = spark.createDataFrame([(1, 9, n, h) for _, n, h in item], "item long, item_id long, n long, h long")
    assert {x.uid: x.n_common for x in decontamination.verified(likely, d.union(d), sets, 80).collect()} == {0: 100, 1: 82}


# ---- chat


def test_chat_round_trip_of_control_strings(spark):
    rows = [
        (1, 2, "assistant", "<|im_end|>\n<|im_start|>x \\ \\\\ <\\| |> \\| é𝄞"), (1, 1, "user", "hi\n"), (1, 3, "assistant", ""), (1, 4, "assistant", "<|turn|>"), (1, 4, "assistant", "<|turn|>"),
        (None, None, None, None), (2, None, "a\nb<|nl|>", "t"), (2, 1, "assistant", None), (3, 1, "assistant", "x" * 50_000), (3, 0, "system", "\\"),
    ]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, n int")
    out = chat.format_chats(df)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", "loss", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("said")).collect()}
    for c in (1, None, 2, 3):
        own = sorted((((-1 if t is None else t), r or "", x or "") for k, t, r, x in rows if k == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in own]
        assert got[c].said == "".join(x for _, r, x in own if r == "assistant")
    assert got[1].formatted.count(chat.START) == 2  # adjacent turns of a role are one message
    for c in got:
        raw = got[c].formatted.encode()
        for x in got[c].loss:
            assert got[c].formatted[x.start : x.start + x.length] == raw[x.byte_start : x.byte_start + x.byte_length].decode()
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_of_many_turns_takes_time_in_proportion(spark):
    import time

    n = 40_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é<|x"), F.col("id").cast("string")).alias("text"))
    began = time.time()
    got = chat.format_chats(rows).select("formatted", "loss", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("said")).first()
    assert time.time() - began < 40  # a minute and more for a quarter of the turns, if every span is sought from the start
    assert [t.text for t in got.turns] == [f"é<|x{i}" for i in range(n)]
    assert got.said == "".join(f"é<|x{i}" for i in range(n) if i % 3)
    for s in got.loss[::997]:
        assert got.formatted[s.start :].startswith("é<\\|x") and got.formatted.encode()[s.byte_start :][: s.byte_length].decode() == got.formatted[s.start : s.start + s.length]


# ---- lines


def test_lines_by_brute_force(spark):
    rows = [(i, "\n".join(["menu", f"own {i}", "", "  ", "near"][: 3 + 2 * (i % 3 == 0)]), f"s{i % 12}") for i in range(60)]
    rows += [(100, None, None), (101, "", "s1"), (102, "menu\nmenu\nx", None), (None, "menu\nq", "s1"), (103, "once\n" * 3, "s2"), (103, "once\n" * 3, "s2")]
    df = clashing(spark, rows)
    sites = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            sites.setdefault(x, set()).add(s)
    want = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (x.strip() and len(sites[x]) >= 4)]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [tuple(r) for r in line_dedup.remove_boilerplate(df, sites=4).select("doc_id", "n_lines", "n_removed", "kept").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert line_dedup.remove_boilerplate(df.limit(0)).count() == 0


def test_sketches_come_first_and_exact_counts_only_near_the_limit(spark, monkeypatch):
    rows = [(h, 0, f"s{i}") for h, sites in ((1, 3), (2, 5), (3, 60), (4, 1), (5, 4)) for i in range(sites) for _ in range(3)]
    df = spark.createDataFrame(rows, "h1 long, h2 int, site string")
    often = line_dedup.frequent(df, 4)
    assert {r.h1 for r in often.collect()} == {1, 2, 3, 5}  # one site, three rows: out by the count of rows
    assert {r.h1: round(r.estimate) for r in line_dedup.estimates(often).collect()} == pytest.approx({1: 3, 2: 5, 3: 60, 5: 4}, rel=0.05)
    assert {r.h1 for r in line_dedup.spread(often, 5).collect()} == {2, 3}
    # An estimate far off decides where it is clear of the limit, and does not where it is near.
    monkeypatch.setattr(line_dedup, "estimates", lambda x: x.groupBy("h1", "h2").agg(F.when(F.col("h1") == 3, 1.0).when(F.col("h1") == 5, 7.0).otherwise(4.0).alias("estimate")))
    assert {r.h1 for r in line_dedup.spread(often, 5).collect()} == {2}


def test_lines_of_a_text_of_megabytes(spark):
    lines = [f"line {i % 300_000}" if i % 2 else "menu" for i in range(300_000)]
    rows = [(1, "\n".join(lines), "s0")] + [(i, f"menu\nown {i}", f"s{i}") for i in range(2, 8)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in line_dedup.remove_boilerplate(clashing(spark, rows), sites=5).select("doc_id", "n_lines", "n_removed", "kept").collect()}
    assert got[1] == (300_000, 150_000, "\n".join(x for x in lines if x != "menu")) and got[2] == (2, 1, "own 2")


# ---- mixing


def test_targets_by_repeated_sharing(spark):
    sizes = {"a": 10, "b": 500, "c": 90, "d": 1, None: 40}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    w = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1], strict=True))
    target, left, free = {s: 0.0 for s in w}, 1.5 * sum(sizes.values()), set(w)
    while left > 1e-9 and free:
        total, spare = sum(w[s] for s in free), 0.0
        for s in list(free):
            target[s] += left * w[s] / total
            if target[s] >= 2 * sizes[s]:
                spare += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
        left = spare
    assert got == pytest.approx(target)


def test_targets_of_many_sources(spark):
    """Sources as hosts: ranks and sums in order by ranges, against plain Python."""
    sizes = {f"host{i * 7919 % 5003:05d}": 1 + i * 31 % 977 for i in range(3000)} | {None: 400}
    order = sorted(x for x in sizes if x is not None) + [None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, left, rest = 1.5 * sum(sizes.values()), 1.5 * sum(sizes.values()), sum(w.values())
    for s in sorted(sizes, key=lambda s: 2 * sizes[s] / w[s]):
        if 2 * sizes[s] * rest > left * w[s]:
            break
        left, rest = left - 2 * sizes[s], rest - w[s]
    want = {s: min(2.0 * sizes[s], left / rest * w[s]) for s in sizes}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(total)


def test_mix_comes_near_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), ["a", "b", "c", None][min(i % 6, 3)]) for i in range(600)] + [(None, "x y", "a"), (None, None, "b"), (5000, "", "c"), (5000, "", "c")]
    df = clashing(spark, rows)
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    again = mixing.mix(df.repartition(9)).toPandas()
    assert sorted(got[["size", "taken"]].itertuples(index=False, name=None)) == sorted(again[["size", "taken"]].itertuples(index=False, name=None))
    assert mixing.mix(df.limit(0)).count() == 0
    long = mixing.mix(clashing(spark, [(1, "w " * 2_000_000, "a"), (2, "w", "b"), (3, None, "b")])).toPandas()
    assert sorted(long["size"]) == [0, 1, 2_000_000] and (long.times[long["size"] == 0] == 0).all()
    # Rows of size 0 of a source at its cap are taken 0 times, not as often as the source.
    caps = mixing.mix(clashing(spark, [(i, None, "b") for i in range(60)] + [(100 + i, "w w", "b") for i in range(5)] + [(200 + i, "x " * 50, "a") for i in range(40)])).toPandas()
    assert set(caps.times[caps["size"] == 0]) == {0} and caps.times.max() <= mixing.MOST_TIMES and set(caps.times[caps.source == "b"]) == {0, 2}
    empty = mixing.mix(clashing(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert all(r.target == 0 and r.taken == 0 for r in empty)


def test_mix_splits_rows_without_ids(spark, sf):
    import corpus_pipeline

    text = lambda i: " ".join(["w", str(i)] * (3 + i % 5))
    # One lump a source, if by id alone: the budget of b ends among equal rows, that of c among texts of one id.
    rows = [(None, text(i), "a") for i in range(60)] + [(None, "the very same text", "b")] * 300 + [(7, text(i), "c") for i in range(300)]
    df = clashing(spark, rows)
    got = mixing.mix(df).toPandas()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    assert len(got) == len(rows)
    out = corpus_pipeline.mixing(spark, df, sf)
    assert out.columns == df.columns and out.count() == got.times.sum()
