"""Token counts of sections by offset-mapped attribution.

Method. A whole document is encoded once by a byte-level BPE. The byte lengths of its tokens give every token's span in the text;
the spans are joined to the sections by binary search over the sections' ends. Rule: a token belongs to the
section that holds its first byte; sections are lines, each with the newline that ends it. Counts of sections so add up
to the document's count.

Tokens that begin inside a section but end in a later one are reported as n_crossing of the section that gets them.

Defined results. Null text is empty. A text without bytes has one section of 0 tokens. Control strings in texts are ordinary
text. Rows that repeat an id are counted each; ties do not arise. Other columns do not matter. An empty table gives an empty
result. Very long texts are encoded whole, one at a time; but a run of over STRETCH white-space characters is encoded in
stretches of STRETCH, which no token crosses, as the pattern's matching would run out of stack on it.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.llm.common import bytes_of, pieces, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits texts before byte-pair merges, part of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STRETCH = 50_000
SCHEMA = "doc_id long, section int, n_bytes long, n_tokens long, n_crossing long"


def attribute(starts: np.ndarray, stops: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by section, and those of them that cross its end; ends: where each section stops."""
    own = np.searchsorted(ends, starts, "right")
    last = len(ends) - 1
    own = np.minimum(own, last)
    return np.bincount(own, minlength=last + 1), np.bincount(own[stops > ends[own]], minlength=last + 1)


def stretches(text: str) -> Iterator[str]:
    """The text, cut only inside runs of more than STRETCH white-space characters."""
    at = 0
    for run in re.finditer(r"\s{%d,}" % (STRETCH + 1), text):
        for cut in range(run.start() + STRETCH, run.end(), STRETCH):
            yield text[at:cut]
            at = cut
    yield text[at:]


def _counter(ranks: dict[bytes, int], pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        width = np.zeros(max(ranks.values()) + 1, np.int64)
        for b, r in ranks.items():
            width[r] = len(b)
        for b in pieces(batches, "text"):
            data, off = bytes_of(b.column("text"))
            raw = data.tobytes()
            breaks = np.flatnonzero(data == 10) + 1
            ids, section, size, tokens, crossing = [], [], [], [], []
            doc = b.column("doc_id").to_pylist()
            for i in range(b.num_rows):
                lo, hi = int(off[i]), int(off[i + 1])
                own = breaks[np.searchsorted(breaks, lo, "right") : np.searchsorted(breaks, hi, "right")] - lo
                ends = own if len(own) and own[-1] == hi - lo else np.append(own, hi - lo)
                encoded = [x for s in stretches(raw[lo:hi].decode("utf-8", "replace")) for x in coder.encode_ordinary(s)]
                stops = np.cumsum(width[np.array(encoded, np.int64)])
                n, x = attribute(np.concatenate([[0], stops[:-1]])[: len(stops)], stops, ends)
                ids += [doc[i]] * len(ends)
                section.append(np.arange(len(ends)))
                size.append(np.diff(np.concatenate([[0], ends])))
                tokens.append(n)
                crossing.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(section).astype(np.int32))] + [pa.array(np.concatenate(v).astype(np.int64)) for v in (size, tokens, crossing)], names=["doc_id", "section", "n_bytes", "n_tokens", "n_crossing"])

    return run


def load_ranks(lines: list[str]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(r) for a, r in (x.split() for x in lines if x.strip())}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, section, n_bytes, n_tokens, n_crossing) of every line of every text."""
    if not os.path.isfile(vocabulary):
        raise FileNotFoundError(f"no vocabulary at {vocabulary}: name a file of token ranks in the parameter `vocabulary`")
    with open(vocabulary, encoding="ascii") as f:  # the driver's own file; workers get the ranks with the function
        ranks = load_ranks(f.readlines())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counter(ranks, pattern), SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
