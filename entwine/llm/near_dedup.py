"""Near-duplicate documents by SetSketch registers.

Method. The words of a text (runs of bytes other than ASCII white space, A-Z lowered) make its set of k-word shingles,
each a 64-bit hash. A SetSketch of m registers K_i = floor(1 - log_b(min_x e_i(x))), with e_i(x) exponential, base
b = 1.001 and 16 bits, is mergeable by maximum and equal in a register with about the Jaccard similarity. Equal sets are
one class first, whatever their number. Registers in bands of r make buckets; every member of a bucket is paired with
one member only, the one that meets most others over all bands (a star, not all pairs), a pair goes on if the similarity
estimated jointly from both sketches by maximum likelihood is within the margin, and is then confirmed on the full sets.
The members of buckets that are still in several components go through an exact prefix filter, which finds every pair
between components that can reach the threshold, and these are tested in the same way; so the components are those of
all pairs that share a bucket. With 25 bands of 5, a pair at 0.8 shares no bucket with probability 5e-5.

A full set is a set of 64-bit shingle hashes; classes of equal sets are those of equal 128-bit digests of them.

Near-threshold crowds: texts of one mould just under the threshold share frequent shingles, so the prefix filter compares
them pair by pair, as any exact way has to. The rows of a frequent shingle are dealt into parts of PART rows, so no task
holds such a group; the work still grows with the square of the crowd (README gives figures).

Defined results. Null and empty texts, and texts of white space: set size 0, linked with nothing, kept. Fewer words than
k: the whole sequence is the one shingle. Other columns do not matter, whatever their names. An empty table gives an
empty result. Every row is a document: rows are linked by their texts alone, never by an id that they share or lack, and one
row of each component is kept, the first by (doc_id with null last, th), any one of equal rows (ties). Very long texts are
hashed by tiles; a worker holds their word hashes and set, about 20 bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entwine.llm.common import binary_column, bytes_of, components, mix, pieces, row_id, shingle_sets, stream, table, text_key, written

BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: A pair whose estimate lies this far below the threshold is not confirmed: over five standard errors at 125 registers.
MARGIN = 0.2
NO_ID = -(1 << 62)
#: Rows of one shingle that a group of the prefix filter holds, about.
PART = 1024

SKETCHES = "uid long, th long, rid long, n long, s1 long, s2 long, sketch binary, bands array<long>"


def sketch(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """Register values (uint16) of non-empty sets, a row each."""
    h = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    a, b = stream(101, registers) | np.uint64(1), stream(202, registers)
    least = np.empty((len(sets), registers), np.uint64)
    for i in range(registers):
        least[:, i] = np.minimum.reduceat((h ^ b[i]) * a[i], at)
    e = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(e) / np.log(BASE)), 0, TOP).astype(np.uint16)


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes."""
    more, less = (x > y).sum(1), (x < y).sum(1)
    same = x.shape[1] - more - less
    u = nx / (nx + ny)
    v = 1 - u
    grid = np.linspace(0, 1, 101)
    p = lambda z: -np.log1p(-np.clip(z, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    top = np.minimum(u / v, v / u)[:, None]
    j = grid[None, :] * top
    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    tie = np.clip(1 - up - down, 1e-12, 1)
    return j[np.arange(len(x)), (more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(tie)).argmax(1)]


def _sketches(k: int, registers: int, rows: int):
    salt = stream(303, rows)
    bands = registers // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            sets = shingle_sets(*bytes_of(b.column("text")), k)
            some = [i for i, s in enumerate(sets) if len(s)]
            n = b.num_rows
            digest = np.zeros((n, 2), np.int64)
            regs: list = [None] * n
            keys: list = [None] * n
            if some:
                values = sketch([sets[i] for i in some], registers)
                band = (mix(values.astype(np.uint64) + np.uint64(1))[:, : bands * rows].reshape(-1, bands, rows) * (salt | np.uint64(1))).sum(2, dtype=np.uint64)
                band = mix(band + np.arange(bands, dtype=np.uint64)).view(np.int64)
                for q, i in enumerate(some):
                    digest[i] = np.frombuffer(hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), np.int64)
                    regs[i], keys[i] = values[q].tobytes(), band[q]
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("th"), b.column("rid"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), binary_column(regs), pa.array(keys, pa.list_(pa.int64()))], names=["uid", "th", "rid", "n", "s1", "s2", "sketch", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            sets = shingle_sets(*bytes_of(b.column("text")), k)
            hs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("comp"), pa.array([len(s) for s in sets], pa.int64()), hs], names=["node", "comp", "n", "hs"])

    return run


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("x", "y"))
                est = estimate(x, y, *(b.column(c).to_numpy().astype(float) for c in ("nx", "ny")))
                yield b.select(["a", "b"]).filter(pa.array(est >= least))

    return run


def _confirmed(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in pieces(batches, "x"):
            left = shingle_sets(*bytes_of(b.column("x")), k)
            ids = b.column("b").to_pylist()
            known = {i: known[i] for i in set(ids) & set(known)}
            for r, i in enumerate(ids):
                if i not in known:
                    known[i] = shingle_sets(*bytes_of(b.column("y").slice(r, 1)), k)[0]
            ok = []
            for s, i in zip(left, ids, strict=True):
                both = len(np.intersect1d(s, known[i], assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(known[i]) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _crossing(unsettled: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components that may reach the threshold: an exact prefix filter.

    With the shingles of each set in order of their frequency, two sets that share i shingles share one within the first
    n - i + 1 of either. Shingles that occur once take up the front and meet nothing, so a heavily edited copy has few or no
    rows here. The smaller set of a pair shares more of itself than the larger one, so its front is shorter: texts of one
    mould with words of their own, which share frequent shingles but less than the threshold, meet nowhere. Of each
    shingle's rows, those of its most frequent component are met but do not ask, as pairs within a component are of no use.
    """
    sets = texts.join(unsettled.hint("merge"), "node").select("node", "comp", "text").mapInArrow(_sets(k), "node long, comp long, n long, hs array<long>")
    each = written(sets.select("node", "comp", "n", F.explode("hs").alias("h")), "shingles")
    shared = each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    by = Window.partitionBy("node").orderBy("df", "h")
    at = each.join(shared, "h").withColumn("at", F.row_number().over(by)).withColumn("once", F.col("n") - F.count("*").over(Window.partitionBy("node")))
    at = at.withColumn("at", F.col("at") + F.col("once")).filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    short = F.col("at") <= F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1
    front = written(at.select("h", "node", "comp", "n", "at", short.alias("short")), "front")
    most = front.groupBy("h", "comp").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("comp", F.struct("c", "comp")).alias("most"), F.count("*").alias("comps"), F.sum("c").alias("c")).filter("comps > 1")
    most = written(most.select("h", "most", F.ceil(F.col("c") / PART).cast("int").alias("parts")), "most")
    # A frequent shingle's rows are dealt into parts; those that ask go to every part of it.
    ask = front.join(most, "h").filter("comp != most").select("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("node").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("at").alias("ax"), F.col("short").alias("sx"))
    met = front.join(most.select("h", "parts"), "h").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts")
    both = ask.filter("sx").join(met, ["h", "part"]).filter("comp != cx AND nx <= n")
    both = both.unionByName(ask.join(met.filter("short"), ["h", "part"]).filter("comp != cx AND n < nx"))
    need = F.ceil((F.col("n") + F.col("nx")) * percent / (100 + percent))
    both = both.filter((F.col("at") <= F.col("n") - need + 1) & (F.col("ax") <= F.col("nx") - need + 1) & (F.least("n", "nx") * 100 >= F.greatest("n", "nx") * percent))
    return both.select(F.greatest("node", "x").alias("a"), F.least("node", "x").alias("b")).distinct()


def _linked(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, registers: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all rows, the classes of equal sets (s1, s2, node, first: the first of their rows), and the components of these."""
    base = docs.select(row_id(id_col).alias("uid"), text_key(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    numbered = base.select("uid", "th", F.monotonically_increasing_id().alias("rid"), "text")
    sk = written(numbered.mapInArrow(_sketches(shingle, registers, rows), SKETCHES), "sketch")

    # Classes of equal sets (equal 128-bit digests); everything after works on the first row of each. A class's node is its
    # number in the written table, so that no two classes share one.
    some = sk.filter("n > 0")
    first = F.min(F.struct((F.col("uid") == NO_ID).alias("none"), "uid", "th", "rid"))
    firsts = some.groupBy("s1", "s2").agg(first.alias("first")).withColumn("node", F.monotonically_increasing_id())
    firsts = written(firsts, "classes")
    reps = written(some.join(firsts.select("node", F.col("first.rid").alias("rid")), "rid").select("node", "uid", "th", "n", "sketch", "bands"), "reps")
    bands = reps.select("node", F.explode("bands").alias("key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    met = written(bands.join(sizes, "key"), "met")
    central = met.groupBy("node").agg(F.sum("size").alias("met"))
    met = written(met.join(central, "node").select("node", "key", "met"), "central")
    leaders = met.groupBy("key").agg(F.max("met").alias("met")).join(met, ["key", "met"]).groupBy("key").agg(F.min("node").alias("b"))
    bands = written(met.join(leaders, "key").select("node", "key", "b"), "bands")

    ends = bands.select("node").distinct()
    texts = written(base.join(ends.join(reps.select("node", "uid", "th"), "node").hint("merge"), ["uid", "th"]).select("node", "text").dropDuplicates(["node"]), "texts")
    s = reps.select("node", "n", "sketch")

    def test(pairs: DataFrame, tag: str) -> DataFrame:
        x = s.select(F.col("node").alias("a"), F.col("n").alias("nx"), F.col("sketch").alias("x"))
        y = s.select(F.col("node").alias("b"), F.col("n").alias("ny"), F.col("sketch").alias("y"))
        likely = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "nx", "ny").mapInArrow(_likely(percent / 100 - MARGIN), "a long, b long")
        tx, ty = texts.select(F.col("node").alias("a"), F.col("text").alias("x")), texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
        return written(likely.join(tx, "a").join(ty, "b").select("a", "b", "x", "y").mapInArrow(_confirmed(shingle, percent), "a long, b long"), tag)

    links = test(written(bands.filter("node != b").select(F.col("node").alias("a"), "b").distinct(), "stars"), "links")
    label = components(links)

    # Buckets that are still in several components: all pairs between components that can reach the threshold.
    here = bands.select("node", "key").join(label.withColumnRenamed("component", "comp"), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    apart = here.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key")
    unsettled = written(here.join(apart, "key").select("node", "comp").distinct(), "unsettled")
    rest = written(_crossing(unsettled, texts, shingle, percent), "crossing")
    if rest.limit(1).count():
        label = components(links.unionByName(test(rest, "links-crossing")), "cc-all")
    return sk, firsts, label


def near_duplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, registers: int = 125, rows: int = 5) -> DataFrame:
    """Per row of docs: doc_id, th (tells rows apart that share an id), n_shingles, component_id (the id of the row kept), kept."""
    sk, firsts, label = _linked(docs, id_col, text_col, shingle, percent, registers, rows)
    doc_id = F.when(F.col("uid") != NO_ID, F.col("uid"))
    classes = written(firsts.join(label, "node", "left").select("s1", "s2", "first", F.coalesce("component", "node").alias("component")), "members")
    least = classes.groupBy("component").agg(F.min("first").alias("least"))
    final = classes.join(least, "component").select("s1", "s2", "least")
    out = sk.select("uid", "th", "rid", "n", "s1", "s2").join(final, ["s1", "s2"], "left")
    lone = F.col("least").isNull()
    component = F.when(lone, doc_id).otherwise(F.when(~F.col("least.none"), F.col("least.uid")))
    return out.select(doc_id.alias("doc_id"), "th", F.col("n").alias("n_shingles"), component.alias("component_id"), (lone | F.coalesce(F.col("rid") == F.col("least.rid"), F.lit(False))).alias("kept"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_rows(table(spark, sf_dir, "documents"), shingle=4)
