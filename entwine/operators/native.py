"""Dice similarities of the native variant for all pairs of equal names, made in blocks of records and not from a table of pairs.

A key is a country and a name, full or shortened. Records of both sides go to the blocks of their key, a grid of about ROWS x COLUMNS
records, so that a large key is dealt over tasks and no pair is shuffled. A block counts shared grams by postings of its
distinct texts, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entwine.functions.text import ascii_clean
from entwine.plans.lineage import cut

#: Records of source 1, and candidates, that a block holds on average; pairs that a task makes on average.
ROWS, COLUMNS, PAIRS = 512, 2048, 1 << 20
#: Rows of a batch that goes back to the JVM.
BATCH = 1 << 16

DICE = ("name2", "name3", "addr2", "addr3")
_LETTERS = 37
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = np.arange(1, _LETTERS)  # a space is 0


def grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of the distinct n-grams of clean texts, in order of both; a text shorter than n has none."""
    raw = [t.encode() for t in texts.to_pylist()]
    size = np.array([len(t) for t in raw], np.int64)
    code = _CODE[np.frombuffer(b"".join(raw), np.uint8)]
    if len(code) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = len(code) - n + 1
    gram = np.zeros(starts, np.int64)
    for k in range(n):
        gram = gram * _LETTERS + code[k : k + starts]
    text = np.repeat(np.arange(len(raw)), size)[:starts]
    inside = np.arange(starts) + n <= np.cumsum(size)[text]
    found = np.unique(text[inside] * _LETTERS**n + gram[inside])
    return found // _LETTERS**n, found % _LETTERS**n


def shared(q: tuple[np.ndarray, np.ndarray], nq: int, c: tuple[np.ndarray, np.ndarray], nc: int) -> np.ndarray:
    """nq x nc numbers of grams that two texts share."""
    order = np.argsort(c[1], kind="stable")
    text, gram = c[0][order], c[1][order]
    lo, hi = (np.searchsorted(gram, q[1], side).tolist() for side in ("left", "right"))
    first = np.searchsorted(q[0], np.arange(nq + 1)).tolist()
    out = np.zeros((nq, nc), np.int64)
    for r in range(nq):
        own = [text[lo[k] : hi[k]] for k in range(first[r], first[r + 1]) if lo[k] < hi[k]]
        if own:
            out[r] = np.bincount(np.concatenate(own), minlength=nc)
    return out


def _dice(q: pa.Array, c: pa.Array, n: int, digits: int | None) -> np.ndarray:
    a, b = grams(q, n), grams(c, n)
    size = np.bincount(a[0], minlength=len(q))[:, None] + np.bincount(b[0], minlength=len(c))[None, :]
    d = 2.0 * shared(a, len(q), b, len(c)) / np.maximum(size, 1)
    return d if digits is None else np.floor(d * 10.0**digits + 0.5) / 10.0**digits


def _block(q: pa.Table, c: pa.Table, digits: int | None) -> Iterator[pa.RecordBatch]:
    """All pairs of a block, but those whose full names are equal (they are pairs of another key)."""
    code = lambda t, f: t.column(f).combine_chunks().dictionary_encode()
    made = {}
    for f in ("name", "addr"):
        x, y = code(q, f), code(c, f)
        for n in (2, 3):
            made[f"{f}{n}"] = _dice(x.dictionary, y.dictionary, n, digits), x.indices.to_numpy(), y.indices.to_numpy()
    full_q, full_c = (np.array(t.column("full").to_pylist(), object) for t in (q, c))
    q_id, c_id = q.column("id").combine_chunks(), c.column("id").combine_chunks()
    step = max(1, BATCH // len(c))
    for at in range(0, len(q), step):
        rows = np.arange(at, min(at + step, len(q)))
        i, j = np.repeat(rows, len(c)), np.tile(np.arange(len(c)), len(rows))
        values = [d[x[rows]][:, y].ravel() for d, x, y in (made[k] for k in DICE)]
        if full_q[0] is not None or any(x is not None for x in full_q):
            keep = (full_q[i] != full_c[j]) | np.equal(full_q[i], None)
            i, j, values = i[keep], j[keep], [v[keep] for v in values]
        for lo in range(0, len(i), BATCH):
            hi = lo + BATCH
            yield pa.RecordBatch.from_arrays([q_id.take(pa.array(i[lo:hi])), c_id.take(pa.array(j[lo:hi])), *[pa.array(v[lo:hi]) for v in values]], names=["s1_id", "cand_id", *DICE])


def _paired(digits: int | None):
    """Pairs of the blocks that a partition holds, whose rows come in order of block and side."""

    def whole(block: pa.Table) -> Iterator[pa.RecordBatch]:
        n = int(block.column("side").to_numpy().searchsorted(1))
        if 0 < n < len(block):
            yield from _block(block.slice(0, n), block.slice(n), digits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            block = np.stack([held.column(k).to_numpy() for k in ("key_id", "i", "j")])
            ends = np.flatnonzero((block[:, 1:] != block[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *ends[:-1]], ends, strict=False):
                yield from whole(held.slice(lo, hi - lo))
            held = held.slice(ends[-1]) if len(ends) else held
        if held is not None and len(held):
            yield from whole(held)

    return run


def keyed(recs: DataFrame) -> DataFrame:
    """(kind, country, key, side, id, full, name, addr): a record under its full name and, where it differs, its shortened one.

    full is the name whose pairs kind 0 has; side is 0 for source 1 and else 1.
    """
    r = recs.select(F.when(F.col("src") == 1, 0).otherwise(1).alias("side"), "id", "country", "name_norm", "name_norm_suf", ascii_clean(F.col("name")).alias("name"), ascii_clean(F.col("addr")).alias("addr"))
    long = F.octet_length("name_norm") >= 3
    of = lambda kind, key, full: (F.lit(kind).alias("kind"), "country", F.col(key).alias("key"), "side", "id", full.alias("full"), "name", "addr")
    exact = r.filter(long).select(*of(0, "name_norm", F.lit(None).cast("string")))
    short = r.filter((F.octet_length("name_norm_suf") >= 3) & (F.col("name_norm_suf") != F.col("name_norm")))
    return exact.unionByName(short.select(*of(1, "name_norm_suf", F.when(long, F.col("name_norm"))))).filter(F.col("country").isNotNull())


def paired_dice(recs: DataFrame, digits: int | None = None, rows: int = ROWS, columns: int = COLUMNS, pairs: int = PAIRS) -> DataFrame:
    """(s1_id, cand_id, name2, name3, addr2, addr3): the pairs of baseline.joined and their Dice similarities by grams of clean texts.

    Ids of recs have to be unique. digits: the values are rounded, half up.
    """
    spark, r = recs.sparkSession, keyed(recs)
    key = ["kind", "country", "key"]
    n = r.groupBy(*key).agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m")).filter("n > 0 AND m > 0")
    slices = lambda c, each: F.ceil(F.col(c) / each).cast("int").alias(f"{c}s")
    keys = cut(n.select(*key, F.monotonically_increasing_id().alias("key_id"), slices("n", rows), slices("m", columns), (F.col("n") * F.col("m")).alias("pairs")))
    made = keys.agg(F.sum("pairs")).first()[0] or 0
    # A record goes to one slice of its own side and meets all of the other.
    own = lambda c: F.array(F.pmod(F.xxhash64("id"), F.col(c)).cast("int"))
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    first = F.col("side") == 0
    placed = r.join(keys.drop("pairs"), key).withColumn("i", F.explode(F.when(first, own("ns")).otherwise(every("ns")))).withColumn("j", F.explode(F.when(first, every("ms")).otherwise(own("ms"))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), made // pairs + 1)
    dealt = placed.select("key_id", "i", "j", "side", "id", "full", "name", "addr").repartition(tasks, "key_id", "i", "j").sortWithinPartitions("key_id", "i", "j", "side")
    return dealt.mapInArrow(_paired(digits), "s1_id string, cand_id string, " + ", ".join(f"{c} double" for c in DICE))
