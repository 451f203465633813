"""Removal of every byte that lies in a string of L bytes which also starts somewhere else in the corpus.

Method. A common-prefix-aware distributed merge sort of suffixes, over the few suffixes that can matter:

1. Every window of L bytes has a minimizer, the leftmost least hash among its g-byte grams, which depends on the
   window's bytes alone: equal windows have equal minimizers at equal places. Windows of one text with one minimizer are a
   segment (about 180 windows). A segment's row holds the gram's hash and a 128-bit digest of the segment's bytes.
2. Segments whose gram occurs once hold no repeated window. Of the others, equal digests are one variant with a count;
   a gram with a single variant needs no comparison.
3. A representative of each other variant is cut from its text. Each task sorts its suffixes (the text from the gram on)
   into runs, front-codes them (length of the prefix shared with the one before, then the rest) and sends the
   runs to the partition of the gram. There a loser tree merges them, in which a contest compares known common prefix
   lengths first and reads bytes only past them, so no known prefix is compared again. The merged order comes with all
   neighbours' common prefixes; together with those of the left contexts they tell for each window whether another
   variant holds it too. A gram with more than HOT variants is too large a group for one task: its windows are halved by
   their place around the gram, and each half gets the bytes that all its windows share (200 and more) as its key instead
   of the gram, again and again until the groups are small; they then go through the same merge. Equal windows always get
   equal keys. What is left of a half of one place has equal windows, by its key.
4. Repeated windows go back to all segments of the variant, are joined to their texts, and the union of bytes goes.

Volumes: a row of about 45 bytes per 185 bytes of text; bytes of text travel once for the representatives and once for
the removal, never once per suffix.

Defined results. Null text is empty. Texts shorter than L lose nothing. Rows are documents of their own, also when ids or
whole rows repeat (a repeated row of L bytes or more is then removed in both places). Rows without an id are treated
alike and return a null id. Overlaps count, also of a string with itself at another start; ties do not arise. Very long texts
are walked in tiles of TILE bytes; one row holds a text, its segments and what is left. Other columns do not matter. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.llm.common import Rolling, bytes_of, parts, pieces, table, text_key, written

GRAM = 32
#: Texts longer than this are walked in tiles, which bounds memory.
TILE = 1 << 21
#: Suffixes of about so many bytes are sorted into one run.
RUN = 16 << 20
#: Runs that one task merges, in bytes before front coding: their number follows the measured number of segments.
ROUTE = 64 << 20
#: Variants that a group of the merge holds at most; larger ones are split by the places of their windows.
HOT = 50_000
#: Up to so many variants of a gram are compared as pairs; more by labels of common prefixes, without pairs.
PAIRWISE = 48

ANCHORS = "uid long, th long, a int, m int, o int, h long, v1 long, v2 long"
_HASH = Rolling(51)


def segments(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(start, windows, offset of the gram in the segment, gram hash) of all segments of the rows."""
    n = len(data)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if n < length:
        return none
    w = length - GRAM + 1
    i = np.arange(n - GRAM + 1)
    sums = _HASH.sums(data)
    gram = _HASH.spans(sums, i, i + GRAM)
    mask = np.uint64((1 << max(21, int(n).bit_length())) - 1)
    packed = np.full(-(-len(gram) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    packed[: len(gram)] = (gram & ~mask) | i.astype(np.uint64)
    grid = packed.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    at = (np.minimum(back[:starts], ahead[w - 1 : w - 1 + starts]) & mask).astype(np.int64)
    valid = np.repeat(off[1:], np.diff(off))[:starts] - np.arange(starts) >= length
    fresh = np.ones(starts, bool)
    fresh[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    head = np.zeros(n + 1, bool)
    head[off] = True
    fresh |= head[:starts]
    cut = np.append(fresh | ~valid, True)
    a = np.flatnonzero(fresh & valid)
    edges = np.flatnonzero(cut)
    m = edges[np.searchsorted(edges, a, "right")] - a
    return a, m, at[a] - a, gram[at[a]]


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            data, off = bytes_of(b.column("text"))
            tiles = [(0, data, off)]
            if len(data) > 2 * TILE and b.num_rows == 1:
                tiles = [(t, data[t : t + TILE + length - 1], np.array([0, min(TILE + length - 1, len(data) - t)])) for t in range(0, len(data), TILE)]
            uid, th = (b.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "th"))
            for t, d, o in tiles:
                a, m, place, gram = segments(d, o, length)
                if not len(a):
                    continue
                row = np.searchsorted(o, a, "right") - 1
                raw = d.tobytes()
                digest = np.frombuffer(b"".join(hashlib.blake2b(raw[x : x + y], digest_size=16, salt=z).digest() for x, y, z in zip(a.tolist(), (m + length - 1).tolist(), [int(p).to_bytes(8, "little") for p in place], strict=True)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array(th[row]), pa.array((a - o[row] + t).astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1])], names=["uid", "th", "a", "m", "o", "h", "v1", "v2"])

    return run


# ---- sorted runs and their merge -----------------------------------------------------------------------------------


def common(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which known bytes are known."""
    top = min(len(x), len(y))
    if x[known:top] == y[known:top]:
        return top
    lo, hi = known, top
    while hi - lo > 8:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    while lo < top and x[lo] == y[lo]:
        lo += 1
    return lo


def front_code(entries: list[tuple[bytes, bytes, bytes]]) -> bytes:
    """A run of (suffix, left context, payload) in order of the suffix, each suffix without what it shares with the last."""
    entries.sort(key=lambda e: e[0])
    shared, rest, last = [], [], b""
    for s, _, _ in entries:
        c = common(last, s)
        shared.append(c)
        rest.append(s[c:])
        last = s
    head = np.array([shared, [len(r) for r in rest], [len(e[1]) for e in entries]], np.uint16)
    return np.int64(len(entries)).tobytes() + head.tobytes() + b"".join(e[2] for e in entries) + b"".join(rest) + b"".join(e[1] for e in entries)


#: Digest, count, windows, place of the gram, first window in the variant; a suffix is led by its group's key of KEY bytes.
PAYLOAD, KEY = 16 + 8 + 4 + 4 + 4, 8


def decode(block: bytes) -> Iterator[tuple[bytes, int, bytes, bytes]]:
    """(suffix, prefix shared with the last, left context, payload) of a run, one after the other."""
    n = int(np.frombuffer(block, np.int64, 1)[0])
    shared, rest, left = np.frombuffer(block, np.uint16, 3 * n, 8).reshape(3, n).tolist()
    p = 8 + 6 * n
    r = p + PAYLOAD * n
    x = r + sum(rest)
    s = b""
    for i in range(n):
        s = s[: shared[i]] + block[r : r + rest[i]]
        yield s, shared[i], block[x : x + left[i]], block[p : p + PAYLOAD]
        p, r, x = p + PAYLOAD, r + rest[i], x + left[i]


def merge(runs: list[Iterator[tuple[bytes, int, bytes, bytes]]]) -> Iterator[tuple[bytes, int, bytes, bytes]]:
    """The runs in one order, each entry with the prefix it shares with the one before: a loser tree over common prefixes.

    known[i] is what the head of run i shares with the last winner that it met. Of two heads with different values the larger
    one is less, without a look at bytes; with equal ones bytes count from there on, and the loser keeps the new value.
    """
    size = 1
    while size < len(runs):
        size *= 2
    head = [next(r, None) for r in runs] + [None] * (size - len(runs))
    known = [0] * size
    loser = [0] * size

    def contest(x: int, y: int) -> tuple[int, int]:
        if head[x] is None or head[y] is None:
            return (y, x) if head[x] is None else (x, y)
        if known[x] != known[y]:
            return (x, y) if known[x] > known[y] else (y, x)
        a, b = head[x][0], head[y][0]
        c = common(a, b, known[x])
        first, second = (x, y) if a[c:] <= b[c:] else (y, x)
        known[second] = c
        return first, second

    def build(node: int) -> int:
        if node >= size:
            return node - size
        first, loser[node] = contest(build(2 * node), build(2 * node + 1))
        return first

    winner = build(1)
    while head[winner] is not None:
        s, _, left, payload = head[winner]
        yield s, known[winner], left, payload
        head[winner] = next(runs[winner], None)
        known[winner] = head[winner][1] if head[winner] is not None else 0
        node = (winner + size) // 2
        while node:
            winner, loser[node] = contest(winner, loser[node])
            node //= 2


def repeated(lcp: np.ndarray, lefts: list[bytes], count: np.ndarray, m: np.ndarray, o: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each variant of one gram, in suffix order, the runs (first, last) of its windows that occur elsewhere too."""
    g = len(m)
    full = [[(0, int(x) - 1)] for x in m]
    if (count > 1).all():
        return full
    turned = [x[::-1] for x in lefts]
    if g <= PAIRWISE:
        f = np.zeros((g, g), np.int64)
        for i in range(g - 1):
            f[i, i + 1 :] = np.minimum.accumulate(lcp[i + 1 :])
        out = []
        for i in range(g):
            if count[i] > 1:
                out.append(full[i])
                continue
            spans = []
            for j in range(g):
                if j != i:
                    lo = max(length - int(f[min(i, j), max(i, j)]), int(o[i] - m[i] + 1))
                    hi = int(o[i])
                    if lo <= hi:
                        hi = min(hi, common(turned[i], turned[j]))
                        if lo <= hi:
                            spans.append((int(o[i]) - hi, int(o[i]) - lo))
            out.append(union(spans))
        return out
    order = sorted(range(g), key=turned.__getitem__)
    shared = np.array([0] + [common(turned[order[i - 1]], turned[order[i]]) for i in range(1, g)])
    rank = np.empty(g, np.int64)
    rank[order] = np.arange(g)
    hit: list[list[int]] = [[] for _ in range(g)]
    for d in range(int((o - m + 1).min()), int(o.max()) + 1):
        here = np.flatnonzero((o - m + 1 <= d) & (d <= o))
        if not len(here):
            continue
        ahead = np.cumsum(lcp < length - d)
        behind = np.cumsum(shared < d)[rank]
        _, inverse, times = np.unique(ahead[here] * (g + 1) + behind[here], return_inverse=True, return_counts=True)
        for i in here[times[inverse] > 1].tolist():
            hit[i].append(int(o[i]) - d)
    return [full[i] if count[i] > 1 else union([(x, x) for x in hit[i]]) for i in range(g)]


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of integers in inclusive spans."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _runs(length: int, routes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = sorted(held)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([front_code(held[k]) for k in keys], pa.binary())], names=["route", "run"])

        for b in batches:
            for text, segs in zip(b.column("text"), b.column("segs"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                for s in segs.as_py():
                    a, m, o = s["a"], s["m"], s["o"]
                    pay = np.array([s["v1"], s["v2"], s["n"]], np.int64).tobytes() + np.array([m, o, s["shift"]], np.int32).tobytes()
                    held.setdefault(s["h"] % routes, []).append((s["h"].to_bytes(KEY, "big", signed=True) + raw[a + o : a + m + length - 1], raw[a : a + o], pay))
                    size += m + length + 200
                    if size > RUN:
                        yield flush()
                        held, size = {}, 0
        if held:
            yield flush()

    return run


def _merged(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [x for b in batches for x in b.column("run").to_pylist()]
        if not blocks:
            return
        group: list[tuple[int, bytes, bytes]] = []
        rows: list[tuple] = []

        def settle() -> None:
            if not group:
                return
            pay = np.frombuffer(b"".join(x[2] for x in group), np.dtype([("v1", "<i8"), ("v2", "<i8"), ("n", "<i8"), ("m", "<i4"), ("o", "<i4"), ("shift", "<i4")]))
            spans = repeated(np.array([x[0] - KEY for x in group]), [x[1] for x in group], pay["n"].copy(), pay["m"].astype(np.int64), pay["o"].astype(np.int64), length)
            # Variants of several segments are repeated as a whole, which is known without the merge.
            rows.extend((int(p["v1"]), int(p["v2"]), [{"i": x + int(p["shift"]), "j": y + int(p["shift"])} for x, y in s]) for p, s in zip(pay, spans, strict=True) if s and p["n"] == 1)
            group.clear()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())])))], names=["v1", "v2", "spans"])

        for _, lcp, left, pay in merge([decode(x) for x in blocks]):
            if lcp < KEY + GRAM:
                settle()
                if len(rows) > 5000:
                    yield out()
                    rows.clear()
            group.append((lcp, left, pay))
        settle()
        yield out()

    return run


def _removed(length: int):
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            data, off = bytes_of(b.column("text"))
            raw = data.tobytes()
            spans, kept = [], []
            for i, found in enumerate(b.column("found").to_pylist()):
                lo, hi = int(off[i]), int(off[i + 1])
                own = [(x, y + 1) for x, y in union([(s["i"], s["j"] + length - 1) for s in found or []])]
                at, left = lo, []
                for x, y in own:
                    left.append(raw[at : lo + x])
                    at = lo + y
                kept.append(b"".join([*left, raw[at:hi]]))
                spans.append([{"start": x, "stop": y} for x, y in own])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(off)), pa.array(spans, kinds), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


SEGMENT = "h long, v1 long, v2 long, n long, uid long, th long, a int, m int, o int, shift int, lo int, hi int"
_FIELDS = [x.split()[0] for x in SEGMENT.split(", ")]


def _halves(length: int):
    """Segments with the windows of either half of their group's places lo to hi (bytes before the gram), under new keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            out = []
            for uid, th, text, segs in zip(b.column("uid").to_pylist(), b.column("th").to_pylist(), b.column("text"), b.column("segs").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                for s in segs:
                    gram, mid = s["a"] + s["o"], (s["lo"] + s["hi"]) // 2
                    for lo, hi in ((s["lo"], mid), (mid + 1, s["hi"])):
                        first, last = max(lo, s["o"] - s["m"] + 1), min(hi, s["o"])
                        if first <= last:
                            shared = raw[gram - lo : gram + length - hi]
                            key = hashlib.blake2b(shared, digest_size=8, salt=lo.to_bytes(8, "little") + hi.to_bytes(8, "little")).digest()
                            out.append((int.from_bytes(key, "big", signed=True), s["v1"], s["v2"], s["n"], uid, th, gram - last, last - first + 1, last, s["shift"] + gram - last - s["a"], lo, hi))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int32() if i > 5 else pa.int64()) for i in range(len(_FIELDS))], names=_FIELDS)

    return run


def _with_texts(base: DataFrame, segments_: DataFrame, *fields: str) -> DataFrame:
    """uid, th, text, segs: each text that segments come from, once, with its segments."""
    wanted = segments_.groupBy("uid", "th").agg(F.collect_list(F.struct(*fields)).alias("segs"))
    return base.select("uid", "th", "text").join(wanted, ["uid", "th"]).dropDuplicates(["uid", "th"])


def _small_groups(base: DataFrame, variants: DataFrame, length: int, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """Segments in groups of `hot` at most, which the merge compares, and (v1, v2, spans) of windows that their keys settle."""
    done, settled, live = [], None, variants
    while True:
        large = written(live.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") > hot).select("h"), "hot")
        if large.limit(1).count() == 0:
            done.append(live)
            break
        done.append(live.join(large, "h", "left_anti"))
        over = live.join(large, "h", "left_semi")
        # Groups of one place: their key is a digest of the whole window.
        whole = over.filter("lo = hi").select("v1", "v2", F.array(F.struct(F.col("shift").alias("i"), F.col("shift").alias("j"))).alias("spans"))
        settled = whole if settled is None else settled.unionByName(whole)
        live = written(_with_texts(base, over.filter("lo < hi"), *[f for f in _FIELDS if f not in ("uid", "th", "h")]).mapInArrow(_halves(length), SEGMENT), "halves")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, settled


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, spans array<struct<start,stop>> (removed bytes), kept (the bytes that remain)."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62))).alias("uid"), text_key(text_col).alias("th"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    anchors = written(base.select("uid", "th", "text").mapInArrow(_anchors(length), ANCHORS), "anchors")
    grams = anchors.groupBy("h").agg(F.count("*").alias("c"), *[f(v).alias(f"{k}{v}") for k, f in (("lo", F.min), ("hi", F.max)) for v in ("v1", "v2")]).filter("c > 1")
    # A table of its own, so that both sides of the join are plain shuffles, whose hot keys Spark can split.
    grams = written(grams.select("h", F.expr("lov1 = hiv1 AND lov2 = hiv2").alias("single")), "grams")
    again = written(anchors.join(grams, "h"), "repeated")

    variants = again.filter("not single").groupBy("h", "v1", "v2").agg(F.count("*").alias("n"), F.min(F.struct("uid", "th", "a", "m", "o")).alias("r"))
    variants = variants.select("h", "v1", "v2", "n", "r.*", F.lit(0).alias("shift"), F.lit(0).alias("lo"), F.lit(length - GRAM).alias("hi"))
    variants = written(variants, "variants")
    small, settled = _small_groups(base, variants, length, hot)
    routes = max(8, parts(spark), -(-variants.count() * (length + 200) // ROUTE))
    runs = _with_texts(base, small, "a", "m", "o", "shift", "h", "v1", "v2", "n").select("text", "segs").mapInArrow(_runs(length, routes), "route int, run binary")
    merged = runs.repartition(routes, "route").mapInArrow(_merged(length), "v1 long, v2 long, spans array<struct<i:int,j:int>>")
    merged = merged if settled is None else merged.unionByName(settled)
    merged = merged.unionByName(variants.filter("n > 1").select("v1", "v2", F.array(F.struct(F.lit(0).alias("i"), (F.col("m") - 1).alias("j"))).alias("spans")))

    whole = again.filter("single").select("uid", "th", F.col("a").alias("i"), (F.col("a") + F.col("m") - 1).alias("j"))
    some = again.filter("not single").join(merged, ["v1", "v2"]).select("uid", "th", "a", F.explode("spans").alias("s")).select("uid", "th", (F.col("a") + F.col("s.i")).alias("i"), (F.col("a") + F.col("s.j")).alias("j"))
    # Sets, as rows that repeat share (uid, th) and would send each span once a copy.
    found = whole.unionByName(some).groupBy("uid", "th").agg(F.collect_set(F.struct("i", "j")).alias("found"))
    return base.join(found, ["uid", "th"], "left").select("id", "text", "found").mapInArrow(_removed(length), "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    columns = ["doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]
    # What is left, as a text: a span may begin or end inside a character, whose other bytes then become U+FFFD.
    return out.select(*columns, F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
