"""Scoring of new records of source 1 as a stream, against static candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from entwine.operators.blocking import Caps, budgeted, candidate_postings, candidates, pruned
from entwine.operators.features import pair_features
from entwine.operators.rules import score
from entwine.plans.lineage import cut
from entwine.sources.tables import records


def match_batch(new: DataFrame, known: DataFrame, caps: Caps = Caps(), postings: DataFrame | None = None) -> DataFrame:
    """(s1_id, cand_id, conf, tier) of a batch of raw rows against records of sources 2 and 3, and their postings if they are at hand."""
    recs = records(new).filter("src = 1").unionByName(known.filter("src > 1"))
    scored = score(pair_features(budgeted(candidates(recs, caps, postings), caps), recs))
    return scored.filter("tier > 0").select("s1_id", "cand_id", "conf", "tier")


def start(stream: DataFrame, known: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch of raw rows is matched and handed to sink(matches, batch id). Records and postings of `known` are written once, before the first batch."""
    known = cut(known.filter("src > 1"))
    postings = cut(pruned(candidate_postings(known)))
    return stream.writeStream.foreachBatch(lambda df, i: sink(match_batch(df, known, postings=postings), i)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
