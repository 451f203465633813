"""Near duplicates and repeated passages against brute force; the pipeline."""

import hashlib
import os
import random

import numpy as np
import pytest

from entwine.llm import common, near_dedup, suffix_dedup

from .test_native import clashing, shingles, words


def sets_of(t, k):
    w = words(t)
    return shingles(t, k) if len(w) >= k else ({tuple(w)} if w else set())


def linked(rows, k, percent=80):
    """Component by id of brute-force links; rows that share an id are one document."""
    s = [(i, sets_of(t, k)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            x, y = s[a][1], s[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(s[a][0]), top(s[b][0])
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in up}


def family(r, n, size=150, rate=0.035):
    base = [f"w{r.randrange(10**6)}" for _ in range(size)]
    return [" ".join(w if r.random() > rate * r.random() else f"e{r.randrange(10**6)}" for w in base) for _ in range(n)]


def test_components_of_copies_around_the_threshold(spark):
    r = random.Random(4)
    texts = [t for _ in range(3) for t in family(r, 60)] + family(r, 40, rate=0.09) + family(r, 30, size=8, rate=0.2) + family(r, 5, size=3)
    texts += ["same text of some words here"] * 20 + ["", None, " \t\n", "one", "ONE", "é É", "a b c", "A B C"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    want = linked(rows, 5)
    got = {x.doc_id: x for x in near_dedup.near_duplicate_rows(clashing(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert {i: x.component_id for i, x in got.items()} == want
    assert all(x.n_shingles == len(sets_of(texts[i], 5)) and x.kept == (x.component_id == i) for i, x in got.items())
    assert len(set(want.values())) < len(rows) - 100


def test_crossing_finds_every_pair_at_the_threshold(spark):
    r = random.Random(3)
    texts = [" ".join(f"mould{j}" for j in range(12)) + f" own{i}" for i in range(40)]
    for g in range(12):
        words = [f"g{g}w{j}" for j in range(r.randint(12, 60))]
        for i in range(6):
            copy = words[: len(words) - r.randint(0, 5)]
            copy[r.randrange(len(copy))] = f"edit{g}-{i}"
            texts.append(" ".join(copy + [f"tail{g}-{i}"] * r.randint(0, 1)))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    want = {(b, a) for a in range(len(texts)) for b in range(a + 1, len(texts)) if texts[a] != texts[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node long, text string")
    alone = spark.createDataFrame([(i, i) for i in range(len(texts))], "node long, comp long")
    got = {(x.a, x.b) for x in near_dedup._crossing(alone, rows, 4, 80).collect()}
    assert len(want) > 30 and want <= got
    # Of 8 shingles 7 are shared: 7 / 9 is under the threshold.
    mould = spark.createDataFrame([(i, " ".join(f"mould{j}" for j in range(10)) + f" own{i}") for i in range(40)], "node long, text string")
    assert near_dedup._crossing(alone.filter("node < 40"), mould, 4, 80).count() == 0


def test_a_crowd_under_the_threshold_in_parts(spark, monkeypatch):
    """Texts of one mould at 0.78 of each other, none linked, with a few true copies between: parts of few rows find these."""
    monkeypatch.setattr(near_dedup, "PART", 8)
    own = lambda i, n: [f"own{i}-{j}" for j in range(n)]
    mould = [f"mould{j}" for j in range(80)]
    texts = [" ".join(mould[:70] + own(i, 9) + mould[70:]) for i in range(60)]
    texts += [" ".join(mould[:70] + own(i, 9) + mould[70:-1]) for i in range(0, 60, 5)]
    rows = list(enumerate(texts))
    want = linked(rows, 5)
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicate_rows(clashing(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == want and 40 < len(set(want.values())) < 72


def test_long_texts_are_hashed_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(common, "TILE", 997)
    r = random.Random(6)
    texts = [" ".join("w" * r.randrange(1, 9) + str(r.randrange(10**4)) for _ in range(3000)) + "\n" * 1500, "x" * 5000, "a " * 2500, "b" * 1200 + " c d e f"]
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        both = common.word_hashes(raw, np.array([0, len(raw)]))[0], common.word_hashes(raw, np.array([0, len(raw), len(raw)]))[0]
        assert (both[0] == both[1]).all() and len(both[0]) == len(t.split())


def test_near_dedup_of_a_text_of_megabytes(spark):
    long = " ".join(f"w{i}" for i in range(700_000))
    rows = [(3, long), (1, long + " tail"), (2, "other " + long[:3_000_000]), (4, "short text")]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dedup.near_duplicate_rows(clashing(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got[3] == (1, 699_996) and got[1] == (1, 699_997) and got[2][0] == 2 and got[4] == (4, 1)


def test_rows_are_linked_by_text_alone(spark):
    a, b, c, d = (" ".join(f"{p}{i}" for i in range(30)) for p in "abcd")
    rows = [(5, a), (5, b), (3, b), (9, c), (9, c), (None, c), (None, "lonely text of seven words in all"), (None, d), (None, d), (None, None), (11, "")]
    df = clashing(spark, [(i, t, "s") for i, t in rows])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicate_rows(df).collect()), key=repr)
    want = [(3, 26, 3, True), (5, 26, 3, False), (5, 26, 5, True), (9, 26, 9, True), (9, 26, 9, False), (None, 26, 9, False), (None, 3, None, True), (None, 26, None, True), (None, 26, None, False), (None, 0, None, True), (11, 0, 11, True)]
    assert got == sorted(want, key=repr)
    assert near_dedup.near_duplicate_rows(df.limit(0)).count() == 0


def test_the_stage_keeps_one_row_of_each_group(spark, sf):
    import corpus_pipeline as p

    c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "cd")
    rows = [(9, c), (9, c), (None, c), (None, "lonely text of seven words in all"), (None, d), (None, d), (None, None), (None, None), (4, " ")]
    df = clashing(spark, [(i, t, "s") for i, t in rows])
    out = p.near_dedup(spark, df, sf)
    want = [(9, c), (None, "lonely text of seven words in all"), (None, d), (None, None), (None, None), (4, " ")]
    assert out.columns == df.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_estimates_are_near(spark):
    r = np.random.RandomState(2)
    for j in (0.3, 0.6, 0.8, 0.95):
        n = 2000
        both = int(2 * n * j / (1 + j))
        pool = common.mix(r.randint(0, 2**62, 2 * n).astype(np.uint64))
        x, y = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
        k = near_dedup.sketch([np.unique(x), np.unique(y)], 500)
        assert near_dedup.estimate(k[:1], k[1:], np.array([n * 1.0]), np.array([n * 1.0]))[0] == pytest.approx(j, abs=0.09)
        merged = near_dedup.sketch([np.union1d(x, y)], 500)
        assert (merged[0] == np.maximum(k[0], k[1])).all()


# ---- passages


def removed(texts, n):
    """Kept bytes of every text by brute force."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t in raw:
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]] = seen.get(t[i : i + n], 0) + 1
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def passages(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefgh éß日\n") for _ in range(n))
    shared = [text(r.randrange(50, 400)) for _ in range(6)]
    out = [text(r.randrange(200)) + r.choice(shared)[r.randrange(20) :] + text(r.randrange(90)) + r.choice(shared)[: r.randrange(40, 400)] for _ in range(70)]
    out += ["ab" * 300, "a" * 500, "a" * 101, "Mentpa " * 60, "", None, "short", out[0], out[0], shared[0] * 2, "日" * 60]
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_passages_by_brute_force(spark, hot):
    texts = passages(hot)
    df = clashing(spark, [(i, t, "s") for i, t in enumerate(texts)])
    want = removed(texts, 100)
    for x in suffix_dedup.remove_repeats(df, length=100, hot=hot).collect():
        spans = sum(s.stop - s.start for s in x.spans)
        assert (x.n_bytes, spans, len(x.spans), hashlib.sha256(x.kept).hexdigest()) == want[x.doc_id]
    assert sum(w[1] for w in want) > 5000


def test_long_texts_go_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TILE", 700)
    monkeypatch.setattr(suffix_dedup, "PAIRWISE", 2)
    r = random.Random(8)
    long = "".join(r.choice("abcdef ") for _ in range(4000))
    texts = [long, long[500:2300] + "x" + long[2301:2900], long[3000:3400] * 3]
    got = {x.doc_id: x for x in suffix_dedup.remove_repeats(clashing(spark, [(i, t, "s") for i, t in enumerate(texts)]), length=100).collect()}
    for i, w in enumerate(removed(texts, 100)):
        assert (got[i].n_bytes, len(got[i].spans), hashlib.sha256(got[i].kept).hexdigest()) == (w[0], w[2], w[3])


def test_halves_settle_windows_that_all_share(spark):
    """Groups of more than `hot` variants down to single windows: texts that share one window only, each with a context of its own."""
    r = random.Random(12)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    for shared in (text(100), text(99), text(130)):
        texts = [text(r.randrange(60)) + shared + text(r.randrange(60)) for _ in range(12)]
        got = {x.doc_id: x for x in suffix_dedup.remove_repeats(clashing(spark, [(i, t, "s") for i, t in enumerate(texts)]), length=100, hot=2).collect()}
        for i, w in enumerate(removed(texts, 100)):
            assert (got[i].n_bytes, len(got[i].spans), hashlib.sha256(got[i].kept).hexdigest()) == (w[0], w[2], w[3])


def test_passages_in_a_text_of_megabytes_and_in_many_equal_rows(spark):
    r = random.Random(2)
    long, shared = r.randbytes(2_500_000).hex(), "passage " * 3 + "".join(r.choice("abcdef") for _ in range(500))
    rows = [(1, long + shared), (2, shared + "end")] + [(3, "x" + shared)] * 50
    got = suffix_dedup.remove_repeats(clashing(spark, [(i, t, "s") for i, t in rows])).collect()
    assert sorted((x.doc_id, x.n_bytes, len(x.kept)) for x in got) == sorted([(1, len(long + shared), len(long)), (2, len(shared) + 3, 3)] + [(3, len(shared) + 1, 0)] * 50)


def test_passages_of_odd_rows(spark):
    r = random.Random(1)
    x = "".join(r.choice("abcdefg") for _ in range(300))
    got = sorted((str(r.doc_id), len(r.kept)) for r in suffix_dedup.remove_repeats(clashing(spark, [(None, x, "s"), (None, "y" + x[:150], "s"), (4, "z", "s"), (4, None, "s")]), length=100).collect())
    assert got == [("4", 0), ("4", 1), ("None", 1), ("None", 150)]
    assert suffix_dedup.remove_repeats(clashing(spark, [])).count() == 0


def test_query_on_planted_passages_and_clean_documents(spark, tmp_path):
    """The contract's columns at its 400 bytes. n_bytes is the input's size whatever goes; n_removed and kept_sha256 tell what went."""
    r = random.Random(9)
    text = lambda n: " ".join("".join(r.choice("abcdefghéß日") for _ in range(r.randrange(2, 12))) for _ in range(n))
    planted = [text(70) for _ in range(8)]
    texts = [text(r.randrange(1, 90)) + f" <{k}> " + p + f" <{k}> " + text(r.randrange(60)) for p in planted for k in range(r.randrange(2, 5))]
    edge = {n: "".join(r.choice("abcdefgh ") for _ in range(n)) for n in (398, 399, 400, 401)}
    clean = [text(r.randrange(120)) for _ in range(20)] + [x + edge[399] + y for x, y in (("k", "l"), ("m", "n"))] + ["", None]
    # A start and an end inside characters: their shared bytes go, so that 398 bytes and two of those are 400.
    cut = ["é" + edge[398] + "日1", "©" + edge[398] + "文2", "u" + edge[400] + "v", "x" + edge[400] + "y", "u" + edge[401] + "v", "x" + edge[401] + "y"]
    cut += ["é" + edge[398][::-1] + "日", "©" + edge[398][::-1] + "旦"]
    rows = texts + clean + cut
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = suffix_dedup.op9_suffix_dedup(spark, str(tmp_path))
    assert out.dtypes[:5] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    got = {x.doc_id: x for x in out.collect()}
    assert {i: tuple(x[1:5]) for i, x in got.items()} == dict(enumerate(removed(rows, 400)))
    assert all(len(p.split()) > 50 and not any(p in x.text for x in got.values()) for p in planted)
    assert all(x.n_removed >= 400 and x.n_bytes == len(rows[i].encode()) for i, x in got.items() if i < len(texts))
    assert all(got[len(texts) + i].n_removed == 0 and got[len(texts) + i].text == (t or "") for i, t in enumerate(clean))


def test_merge_gives_sorted_order_and_common_prefixes():
    r = random.Random(3)
    entries = [(bytes(r.choice(b"ab") for _ in range(r.randrange(1, 30))), b"", bytes(suffix_dedup.PAYLOAD)) for _ in range(300)]
    runs = [suffix_dedup.front_code(entries[i::7]) for i in range(7)]
    last, out = b"", []
    for s, lcp, _, _ in suffix_dedup.merge([suffix_dedup.decode(x) for x in runs]):
        assert lcp == len(os.path.commonprefix([last, s]))
        out.append(s)
        last = s
    assert out == sorted(e[0] for e in entries)


# ---- pipeline


def test_stages_by_their_own_input(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    for name, stage in p.STAGES:
        out = common.written(stage(spark, docs, sf), "test")
        before = {(r.doc_id, r.text) for r in docs.collect()}
        after = [(r.doc_id, r.text) for r in out.collect()]
        assert set(after) <= before
        if name != "sharding":
            assert out.columns == docs.columns
        if name == "near_dedup":
            want = linked(sorted(before), 5)
            assert set(after) == {x for x in before if want[x[0]] == x[0]}
        if name == "decontamination":
            items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(after) == {x for x in before if not any(i and 5 * len(i & shingles(x[1])) >= 4 * len(i) for i in items)}
        if name == "mixing":
            assert max(after.count(x) for x in set(after)) <= 2
        docs = out
    assert p.run(spark, sf).count() == docs.count()


def test_stages_with_odd_rows(spark, sf):
    import corpus_pipeline as p

    clean, other = "A clean text. It has words.\nAnd lines.", " ".join(f"word{i}" for i in range(900_000))
    rows = [(None, None, None), (1, "", "s"), (1, "", "s"), (2, clean, None), (2, clean, None), (None, clean, "s"), (4, other, "t")]
    df = clashing(spark, rows)
    found = lambda out: sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=repr)
    stages = dict(p.STAGES)
    # No label is of these documents, so no rule rejects any.
    assert found(stages["quality"](spark, df, sf)) == sorted(rows, key=repr)
    once = found(stages["near_dedup"](spark, df, sf))
    assert once == sorted([(None, None, None), (1, "", "s"), (1, "", "s"), (2, clean, None), (4, other, "t")], key=repr)
    assert found(stages["decontamination"](spark, df, sf)) == sorted(rows, key=repr)
    mixed = found(stages["mixing"](spark, df, sf))
    assert set(mixed) <= set(rows) - {(None, None, None), (1, "", "s")} and max(mixed.count(x) for x in set(mixed)) <= 4
    assert found(stages["sharding"](spark, df, sf)) == sorted(rows, key=repr)
    for name, stage in p.STAGES:
        out = stage(spark, df, sf)
        if name != "sharding":
            assert out.columns == df.columns
        for r in out.collect():
            assert (r.lang, r.row, r["a.b"], r.th, r.score) == ("en", "r", "x", 1, 0.5)
        assert stage(spark, df.limit(0), sf).count() == 0
