"""What the operators share: tables, written intermediates, row keys and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators are the ASCII white space bytes 0x09-0x0D and 0x20.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Texts are worked on in pieces of about so many bytes, which bounds a worker's memory.
PIECE = 1 << 20
TILE = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Without it a session in one process gets a folder of its own; a cluster gets an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="entwine-"))
    return _own_dir[0]


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives any executor. It goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/entwine-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def row_id(id_col: str) -> Column:
    """A long that is never null: the id, or for a row without one a value below any id."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62)))


def text_key(text_col: str) -> Column:
    """Tells apart rows that share an id."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *names: str) -> Column:
    """Columns of df as one struct called row, so that names made beside it can't clash with theirs; row.* unpacks them."""
    return F.struct(*[quoted(c) for c in names or df.columns]).alias("row")


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; empty for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SPACE), lambda w: w != "")


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once however often, and in whatever lambda, `of` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


# ---- numpy side ----------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values of a seed."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


class Rolling:
    """Hashes of any substring of a byte array from one prefix sum: a polynomial over random values of the bytes."""

    def __init__(self, seed: int):
        self.of_byte = stream(seed, 256)
        self.base = int(stream(seed + 1, 1)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(max(n, 2 * len(self.up)), b & (1 << 64) - 1, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        s = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.up[: len(data)], out=s[1:])
        return s

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about limit bytes of text, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
            yield b.slice(i, j - i)
            i = j


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    kind = pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()
    c = pc.fill_null(column.cast(kind), "" if kind == pa.large_string() else b"")
    off = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    raw = c.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


_WORDS = Rolling(11)


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and the number of the row of each.

    A row longer than TILE goes by tiles that end at white space, so its words take memory, not a multiple of its bytes
    (but for a single word of more than TILE bytes, which is a tile of its own).
    """
    n = len(data)
    if len(off) == 2 and n > TILE:
        found, at = [], 0
        while at < n:
            stop = min(n, at + TILE)
            while stop < n:
                space = np.flatnonzero(_blank(data[at:stop]))
                if len(space):
                    stop = at + int(space[-1]) + 1
                    break
                stop = min(n, stop + TILE)
            found.append(word_hashes(data[at:stop], np.array([0, stop - at, stop - at]))[0])
            at = stop
        h = np.concatenate(found)
        return h, np.zeros(len(h), np.int64)
    low = data + np.uint8(32) * ((data >= 65) & (data <= 90)).astype(np.uint8)
    inside = ~_blank(data)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return _WORDS.spans(_WORDS.sums(low), start, end), np.searchsorted(off, start, "right") - 1


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted set of hashes of its k-word shingles; fewer words make one shingle, none an empty set."""
    h, row = word_hashes(data, off)
    rows = len(off) - 1
    counts = np.bincount(row, minlength=rows)
    at = np.concatenate([[0], np.cumsum(counts)])
    salt = stream(77, k)
    n = len(h)
    s = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        s += h[i : n - k + 1 + i] * (salt[i] | np.uint64(1))
    s = mix(s)
    out = []
    for r in range(rows):
        a, c = at[r], counts[r]
        if c >= k:
            out.append(np.unique(s[a : a + c - k + 1]))
        elif c:
            out.append(mix((h[a : a + c] * (salt[:c] | np.uint64(1))).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def binary_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component) of the graph of edges (a, b): the smallest node that each node reaches.

    Each round takes the least label among a node's neighbours and then follows labels once (pointer jumping), so the
    rounds grow with the logarithm of the longest shortest path. Labels are a written table after each round; nothing
    but the number of changes comes to the driver. Repeated edges and loops do no harm; null ends are left out.
    """
    e = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    e = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{tag}-edges")
    labels = written(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), f"{tag}-0")
    for i in range(1, 200):
        other = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        least = e.join(other, "b").groupBy("a").agg(F.min("cb").alias("m")).select(F.col("a").alias("node"), "m")
        step = labels.join(least, "node").select("node", "component", F.least("component", "m").alias("n"))
        jump = labels.select(F.col("node").alias("n"), F.col("component").alias("j"))
        new = written(step.join(jump, "n", "left").select("node", F.least("n", F.coalesce("j", "n")).alias("component"), (F.least("n", F.coalesce("j", "n")) != F.col("component")).alias("changed")), f"{tag}-{i}")
        labels = new.select("node", "component")
        if new.filter("changed").limit(1).count() == 0:
            return labels
    raise RuntimeError("the components did not settle")
