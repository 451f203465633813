"""Checks of result frames (source1_entity_id, comma list) as queries; every check returns the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _listed(res: DataFrame) -> DataFrame:
    return res.select(F.col(res.columns[0]).alias("s1_id"), F.filter(F.split(F.coalesce(F.col(res.columns[1]), F.lit("")), ","), lambda x: x != "").alias("ids"))


def header_errors(lines: DataFrame, second: str = "matched_entity_ids") -> DataFrame:
    """Rows (value) of a text frame that begin a file wrongly: lines that hold the id column's name but are not the header."""
    return lines.filter(F.col("value").startswith("source1_entity_id") & (F.col("value") != f"source1_entity_id\t{second}"))


def malformed(lines: DataFrame) -> DataFrame:
    return lines.filter((F.col("value") != "") & ~F.col("value").contains("\t"))


def duplicate_rows(res: DataFrame) -> DataFrame:
    return _listed(res).groupBy("s1_id").agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_ids(res: DataFrame) -> DataFrame:
    return _listed(res).filter(F.size("ids") != F.size(F.array_distinct("ids"))).select("s1_id")


def self_matches(res: DataFrame) -> DataFrame:
    return _listed(res).filter(F.exists("ids", lambda x: x.startswith("S1-"))).select("s1_id")


def wrong_prefix(res: DataFrame) -> DataFrame:
    return _listed(res).filter(F.exists("ids", lambda x: ~(x.startswith("S1-") | x.startswith("S2-") | x.startswith("S3-")))).select("s1_id")


def unknown_ids(res: DataFrame, known: DataFrame) -> DataFrame:
    return _listed(res).select("s1_id", F.explode("ids").alias("cand_id")).join(known.select(F.col(known.columns[0]).alias("cand_id")), "cand_id", "left_anti").select("s1_id", "cand_id")


def missing_rows(res: DataFrame, s1: DataFrame) -> DataFrame:
    return s1.select("s1_id").join(_listed(res).select("s1_id"), "s1_id", "left_anti")


def unexpected_rows(res: DataFrame, s1: DataFrame) -> DataFrame:
    return _listed(res).select("s1_id").join(s1.select("s1_id"), "s1_id", "left_anti")


def outside_candidates(matching: DataFrame, cands: DataFrame) -> DataFrame:
    """Records with matches that are not among their candidates (a warning)."""
    c = _listed(cands).select("s1_id", F.col("ids").alias("c"))
    return _listed(matching).join(c, "s1_id", "left").filter(F.size(F.array_except("ids", F.coalesce("c", F.array().cast("array<string>")))) > 0).select("s1_id")


def report(matching: DataFrame, cands: DataFrame, s1: DataFrame, known: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(check_name, kind, n) of all checks; those of the header and of malformed rows need the lines (value) of the file."""
    checks = {"duplicate_rows": duplicate_rows(matching), "duplicate_ids": duplicate_ids(matching), "self_matches": self_matches(matching), "wrong_prefix": wrong_prefix(matching), "unknown_ids": unknown_ids(matching, known), "missing_rows": missing_rows(matching, s1), "unexpected_rows": unexpected_rows(matching, s1), "outside_candidates": outside_candidates(matching, cands)}
    if lines is not None:
        checks |= {"header": header_errors(lines), "malformed": malformed(lines)}
    out = None
    for name, df in checks.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), F.lit("warning" if name == "outside_candidates" else "error").alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def valid(matching: DataFrame, cands: DataFrame, s1: DataFrame, known: DataFrame, lines: DataFrame | None = None) -> bool:
    """Whether no check with errors finds a row."""
    return report(matching, cands, s1, known, lines).filter("kind = 'error' AND n > 0").limit(1).count() == 0
