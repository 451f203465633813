"""Nearest neighbours by several shifted and rotated Hilbert orderings.

Method. Each of CURVES curves projects the unit vectors on AXES random orthonormal directions, shifts and quantizes the
coordinates and takes the Hilbert key. Key ranges of about BLOCK vectors, from a bounded sample's quantiles, are the
partitions of a curve. A query meets, on every curve, all vectors of the key ranges that its window touches; each range's
vectors are reranked by the exact cosine, and the best of all curves merge by aggregation. The window is fitted: the
share of an ordering that, on the sample, holds RECALL of the true neighbours on at least one curve. On vectors with
structure it is small; on vectors without any it nears the whole ordering, as for any index of that kind.

A task gets a bounded group at any size: the vectors of each key range and the queries that touch it are counted. Ranges with
over BLOCK_MOST vectors are dealt by a digest into parts that each of those queries meets in turn, the queries of a range into slices
of about SLICE. So a range is sent once for every slice of its own queries, and not at all if none touches it.

Scores. Every vector that leaves a group has its cosine from both original vectors at twice the precision of a double, rounded
once, so that it depends on nothing else and equal directions tie exactly; ids are made distinct before each cut, and cuts keep
the k + 1 nearest ids, ties to smaller ones.

Only the sample (SAMPLE vectors at most) comes to the driver; every vector is indexed. Of equal vectors (by a 128-bit digest)
only the k + 1 smallest ids take part, as only those can be among the k nearest.

Defined results. Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id take no part, nor
do vectors whose length isn't the most frequent one (the larger of equals). A repeated id counts once, with its nearer
vector. Fewer candidates than k give all. Other columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from entwine.llm.common import mix, table, written

CURVES, AXES, DEPTH = 6, 6, 8
BLOCK, SAMPLE, PROBES, RECALL = 2048, 8192, 256, 0.97
#: Vectors of a part of a key range and queries of a slice: what one group holds, about.
BLOCK_MOST, SLICE = 4096, 8192
#: Placed rows leave a worker in batches of about so many bytes.
BATCH = 1 << 22


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of points with integer coordinates below 2**bits (rows of x); at most 63 bits in all."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """The orderings: keys(v) are the Hilbert keys of vectors (rows), one column a curve."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        r = np.random.RandomState(seed)
        d = sample.shape[1]
        axes = min(AXES, d)
        self.bits = min(DEPTH, 62 // axes)
        self.turns, self.lows, self.spans = [], [], []
        for _ in range(CURVES):
            turn = np.linalg.qr(r.standard_normal((d, d)))[0][:, :axes]
            y = sample @ turn
            span = np.maximum(y.max(0) - y.min(0), 1e-9) * 1.5
            self.turns.append(turn)
            self.lows.append(y.min(0) - span / 3 * r.random_sample(axes))
            self.spans.append(span)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        top = (1 << self.bits) - 1
        return np.stack([hilbert(np.clip((unit @ t - lo) / s * (top + 1), 0, top).astype(np.int64), self.bits) for t, lo, s in zip(self.turns, self.lows, self.spans, strict=True)], 1)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def window(u: np.ndarray, keys: np.ndarray, k: int) -> float:
    """The share of an ordering to either side that holds RECALL of the sample's k nearest on some curve."""
    n = len(u)
    if n <= k + 1:
        return 1.0
    probe = np.arange(0, n, max(1, n // PROBES))
    near = u[probe] @ u.T
    near[np.arange(len(probe)), probe] = -2
    best = np.argpartition(-near, k, axis=1)[:, :k]
    rank = np.argsort(np.argsort(keys, axis=0, kind="stable"), axis=0, kind="stable")
    off = np.abs(rank[best] - rank[probe][:, None, :]).min(2)
    return float(np.quantile(off, RECALL)) / n


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _span(keys: np.ndarray, cuts: np.ndarray, marks: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last block of one curve that the windows of queries with these keys touch."""
    at = np.searchsorted(cuts, keys, "right")
    rank = np.searchsorted(marks, keys) / len(marks)
    lo, hi = (np.searchsorted(cuts, marks[np.clip(((rank + s * reach) * len(marks)).astype(int), 0, len(marks) - 1)], "right") for s in (-1, 1))
    lo, hi = np.minimum(lo, at), np.maximum(hi, at)
    return np.where(rank - reach <= 0, 0, lo), np.where(rank + reach >= 1, len(cuts), hi)


def _sizes(curves: Curves, cuts: np.ndarray, marks: np.ndarray, reach: float, query: bool):
    """(curve, block, n): vectors in a block, or queries that touch it; a task sends one row for each block at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = cuts.shape[1] + 1
        n = np.zeros((CURVES, blocks + 1), np.int64)
        for b in batches:
            if b.num_rows:
                keys = curves.keys(unit(matrix(b.column("vec"))))
                for c in range(CURVES):
                    lo, hi = _span(keys[:, c], cuts[c], marks[c], reach) if query else (np.searchsorted(cuts[c], keys[:, c], "right"),) * 2
                    n[c] += np.bincount(lo, minlength=blocks + 1) - np.bincount(hi + 1, minlength=blocks + 1)
        n = n.cumsum(1)[:, :-1]
        c, block = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(n[c, block])], names=["curve", "block", "n"])

    return run


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row that each of sum(counts) copies comes from, and its number among the copies of that row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _placed(curves: Curves, cuts: np.ndarray, marks: np.ndarray, reach: float, parts: np.ndarray, slices: np.ndarray, query: bool):
    """Rows (curve, block, part, slice, k1, k2, id, vec): a vector in one part of the block of its key, for every slice of it; a query
    in its slice, for all parts of the blocks that its window touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vectors = matrix(b.column("vec"))
            keys = curves.keys(unit(vectors))
            digest = b.column("k1").to_numpy().view(np.uint64)
            mixed = digest if query else mix(digest + b.column("id").to_numpy().view(np.uint64))  # equal vectors spread, too
            step = max(1, BATCH // (8 * vectors.shape[1]))
            for c in range(CURVES):
                if query:
                    lo, hi = _span(keys[:, c], cuts[c], marks[c], reach)
                    row, nth = _spread(hi - lo + 1)
                    at = lo[row] + nth
                    again, part = _spread(parts[c][at])
                    row, at = row[again], at[again]
                    slice_ = (digest[row] % slices[c][at].astype(np.uint64)).astype(np.int32)
                else:
                    at = np.searchsorted(cuts[c], keys[:, c], "right")
                    row, slice_ = _spread(slices[c][at])
                    at = at[row]
                    part = (mixed[row] % parts[c][at].astype(np.uint64)).astype(np.int64)
                for i in range(0, len(row), step):
                    own = slice(i, i + step)
                    take = pa.array(row[own])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), c, np.int32)), *[pa.array(x[own].astype(np.int32)) for x in (at, part, slice_)], *[b.column(x).take(take) for x in ("k1", "k2", "id", "vec")]], names=["curve", "block", "part", "slice", "k1", "k2", "id", "vec"])

    return run


def _two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a * b as the nearest double and the exact rest."""
    split = lambda x: (t := x * 134217729.0, h := t - (t - x), x - h)[1:]
    (ah, al), (bh, bl), p = split(a), split(b), a * b
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def _two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _dot(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise dot products in twice the precision of a double: value and rest."""
    hi, lo = np.zeros(len(x)), np.zeros(len(x))
    for d in range(x.shape[1]):
        p, e = _two_product(x[:, d], y[:, d])
        hi, f = _two_sum(hi, p)
        lo = lo + (e + f)
    return _two_sum(hi, lo)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise cosines, each the double nearest to the true value but for cases too close to call at twice the precision.

    So a score depends on its two vectors only, never on a group or an order of sums, and equal directions tie exactly.
    """
    # Powers of two change no digit and keep squares in range.
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1]) for v in (x, y))
    (d, de), (a, ae), (b, be) = _dot(x, y), _dot(x, x), _dot(y, y)
    p, e = _two_product(a, b)
    p, e = _two_sum(p, e + (a * be + b * ae))
    root = np.sqrt(p)
    s, t = _two_product(root, root)
    rest = ((p - s) - t + e) / (2 * root)  # root + rest is the square root to twice the precision
    q = d / root
    u, v = _two_product(q, root)
    return np.clip(q + ((d - u) - v + de - q * rest) / root, -1.0, 1.0)


def _best(k: int):
    """The k nearest distinct ids of one group for each query, by exact scores, ties to smaller ids."""

    def top(s: np.ndarray, q: np.ndarray, v: np.ndarray, ids: np.ndarray, m: int) -> tuple[np.ndarray, ...]:
        # All that may tie with the m-th; the matrix product's rounding is far below 1e-12.
        last = -np.partition(-s, m - 1, axis=1)[:, m - 1] - 1e-12
        r, c = np.nonzero(s >= last[:, None])
        exact = np.concatenate([cosines(q[r[i : i + 65536]], v[c[i : i + 65536]]) for i in range(0, len(r), 65536)])
        order = np.lexsort((-exact, ids[c], r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.append(True, (r[1:] != r[:-1]) | (ids[c[1:]] != ids[c[:-1]]))  # an id's nearest vector
        r, c, exact = r[first], c[first], exact[first]
        order = np.lexsort((ids[c], -exact, r))
        return r[order], c[order], exact[order]

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in ("q1", "q2", "id", "score")})
        raw, asked = matrix(vectors.column("vec").combine_chunks()), matrix(queries.column("vec").combine_chunks())
        v, ids = unit(raw), vectors.column("id").to_numpy()
        q1, q2 = queries.column("k1").to_numpy(), queries.column("k2").to_numpy()
        distinct = len(np.unique(ids))
        out = []
        for i in range(0, len(asked), 512):
            q = asked[i : i + 512]
            s = unit(q) @ v.T
            left, m = np.arange(len(q)), min(k, len(v))
            while len(left):
                r, c, exact = top(s[left], q[left], raw, ids, m)
                n = np.bincount(r, minlength=len(left))
                enough = (n >= min(k, distinct)) | (m == len(v))  # else one id's vectors take the places of others
                stay = enough[r] & (_spread(n)[1] < k)
                out.append((q1[i + left[r[stay]]], q2[i + left[r[stay]]], ids[c[stay]], exact[stay]))
                left, m = left[~enough], min(4 * m, len(v))
        return pa.table({n: pa.array(np.concatenate([o[j] for o in out])) for j, n in enumerate(("q1", "q2", "id", "score"))})

    return run


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    # Single-precision components travel as such; all arithmetic is in double precision.
    kind = "float" if isinstance(vectors.schema[vec_col].dataType.elementType, FloatType) else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec")).filter("id is not null")
    rows = rows.filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    length = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    same = F.transform("vec", lambda x: x + F.lit(0.0).cast(kind))  # -0.0 is 0.0
    rows = rows.filter(F.size("vec") == length["d"]).select("id", same.alias("vec")).select("id", "vec", F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(1), F.col("vec")).alias("k2"))
    few = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("k1", "k2").orderBy("id"))).filter(F.col("r") <= k + 1)
    entries = written(few.groupBy("k1", "k2", "id").agg(F.first("vec").alias("vec")), "vectors")
    asked = written(rows.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2")).distinct(), "queries")

    n = entries.count()
    sample = entries.select("k1", "k2", "id", "vec").orderBy("k1", "k2", "id").limit(SAMPLE).toPandas()
    u = unit(np.stack(sample["vec"].to_numpy()).astype(np.float64))
    curves = Curves(u)
    keys = curves.keys(u)
    reach = window(u, keys, k)
    blocks = max(1, min(-(-n // BLOCK), len(u) // 4))
    marks = np.sort(keys, axis=0).T
    cuts = np.stack([m[[len(m) * i // blocks for i in range(1, blocks)]] for m in marks])

    wanted = asked.select(F.col("q1").alias("k1"), F.col("q2").alias("k2")).distinct()
    questions = entries.join(wanted, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("vec").alias("vec"))
    questions = written(questions, "questions")

    def shares(df: DataFrame, query: bool, most: int) -> np.ndarray:
        """Into how many groups of `most` rows the rows of each block go; at most CURVES times SAMPLE / 4 counts come to the driver."""
        out = np.zeros((CURVES, blocks), np.int64)
        for curve, block, size in df.select("vec").mapInArrow(_sizes(curves, cuts, marks, reach, query), "curve int, block int, n long").groupBy("curve", "block").agg(F.sum("n")).collect():
            out[curve, block] = -(-size // most)
        return out

    parts, slices = shares(entries, False, BLOCK_MOST), shares(questions, True, SLICE)

    schema = f"curve int, block int, part int, slice int, k1 long, k2 long, id long, vec array<{kind}>"
    group = ("curve", "block", "part", "slice")
    placed = entries.mapInArrow(_placed(curves, cuts, marks, reach, parts, slices, False), schema)
    questions = questions.mapInArrow(_placed(curves, cuts, marks, reach, parts, slices, True), schema)
    pairs = placed.groupBy(*group).cogroup(questions.groupBy(*group)).applyInArrow(_best(k + 1), "q1 long, q2 long, id long, score double")
    # Ids are distinct before each cut, so k + 1 of them hold the k nearest that are not the query's own.
    pairs = pairs.groupBy("q1", "q2", "id").agg(F.max("score").alias("score"))
    found = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k + 1)
    mine = asked.join(found, ["q1", "q2"]).filter("id != query_id").groupBy("query_id", F.col("id").alias("vec_id")).agg(F.max("score").alias("score"))
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
