"""Queries over the labelled pool, over names that hold company words, and of the native variant, with SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entwine import queries as q
from entwine.functions import sets, text
from entwine.operators import blocking, features, native, rules, select, training, validate
from entwine.plans import analytics, baseline
from entwine.sources import tables
from entwine.sources.sinks import bundle

add, rounded = q.add, q.rounded

# ---- the labelled pool -----------------------------------------------------------------------------------------------


def _digest(value: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5('{seed}:' || {value}), 1, 15))::BIGINT"


def _block(name: str, source: str, key: str) -> str:
    """SQL of one block channel over (id, src, country, key)."""
    return f"""{name}_s AS ({source}),
  {name}_k AS (SELECT country, {key} FROM {name}_s GROUP BY ALL HAVING count(*) FILTER (WHERE src = 1) * count(*) FILTER (WHERE src > 1) <= 20000),
  {name}_j AS (SELECT DISTINCT a.id AS s1_id, b.id AS cand_id FROM {name}_s a JOIN {name}_s b USING (country, {key}) JOIN {name}_k USING (country, {key}) WHERE a.src = 1 AND b.src > 1 AND {_digest("a.id", 49)} % 100 < 55),
  {name} AS (SELECT s1_id, cand_id, '{name}' AS channel FROM (FROM {name}_j QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY {_digest("cand_id")}, cand_id) <= 6))"""


POOL = f"""{q.REC}, {q.GT}, t AS (SELECT DISTINCT s1_id, matched_id AS cand_id FROM gt),
  tk AS (SELECT id, src, country, unnest({q._toks("name_norm_suf")}) AS token FROM rec),
  rv AS (SELECT token FROM tk GROUP BY token HAVING count(*) BETWEEN 3 AND 4000),
  rare AS (SELECT DISTINCT id, src, country, token FROM tk SEMI JOIN rv USING (token)),
  ranked AS (SELECT id, country, src, row_number() OVER (PARTITION BY country, src ORDER BY {_digest("id")}, id) AS r FROM rec QUALIFY r <= 62500),
  sizes AS (SELECT country, src, count(*) AS n FROM ranked WHERE src > 1 GROUP BY ALL),
  n_random AS (SELECT a.id AS s1_id, b.id AS cand_id, 'n_random' AS channel FROM ranked a JOIN sizes s USING (country) JOIN ranked b ON b.country = a.country AND b.src = s.src AND b.r = (a.r - 1) % s.n + 1 WHERE a.src = 1),
  {_block("n_nameblk", "SELECT id, src, country, name_norm_suf FROM rec", "name_norm_suf")},
  {_block("n_addrblk", "SELECT id, src, country, addr_norm FROM rec", "addr_norm")},
  {_block("n_raretok", "FROM rare", "token")},
  pool AS (SELECT p.s1_id, p.cand_id, CASE WHEN p.cand_id LIKE 'S2-%' THEN 'S2' ELSE 'S3' END AS msrc, r.country, channel, label FROM (
    SELECT s1_id, cand_id, 'pos' AS channel, 1 AS label FROM t UNION ALL
    SELECT s1_id, cand_id, channel, 0 FROM (FROM n_random UNION ALL FROM n_nameblk UNION ALL FROM n_addrblk UNION ALL FROM n_raretok) ANTI JOIN t USING (s1_id, cand_id)) p JOIN rec r ON r.id = p.s1_id)"""
_one = lambda a, b: f"CASE WHEN len({a}) = 0 THEN 1.0::DOUBLE ELSE {q._both(a, b)}::DOUBLE / len({a}) END"
_words = lambda c: f"len(string_split({c}, ' '))"
_POOL_COLS = {
    "pool_name_eq": "x.name_norm_suf = y.name_norm_suf", "pool_addr_eq": "x.addr_norm = y.addr_norm", "pool_both_eq": "x.name_norm_suf = y.name_norm_suf AND x.addr_norm = y.addr_norm",
    "pool_ntok_eq": f"{_words('x.name_norm_suf')} = {_words('y.name_norm_suf')}", "pool_atok_eq": f"{_words('x.addr_norm')} = {_words('y.addr_norm')}", "pool_addr_any_missing": "x.addr_norm = '' OR y.addr_norm = ''",
}
for _f in ("name", "addr"):
    _POOL_COLS |= {f"{_f}_tok_jac": q._jac(f"x.{_f}t", f"y.{_f}t"), f"{_f}_contain_q": _one(f"x.{_f}t", f"y.{_f}t"), f"{_f}_contain_c": _one(f"y.{_f}t", f"x.{_f}t"), f"{_f}_char2": q._jac(f"x.{_f}2", f"y.{_f}2"), f"{_f}_char3": q._jac(f"x.{_f}3", f"y.{_f}3")}
_POOL_COLS |= {"num_overlap": f"{q._both('x.addr_nums', 'y.addr_nums')}::DOUBLE", "rare_shared": f"{q._both('x.rare', 'y.rare')}::DOUBLE"}
POOLED = f"""{POOL}, own AS (SELECT id, list(token) AS rare FROM rare GROUP BY id),
  side AS MATERIALIZED (SELECT rec.id, name_norm_suf, addr_norm, addr_nums, coalesce(rare, []::VARCHAR[]) AS rare, list_distinct({q._toks("name_norm_suf")}) AS namet, list_distinct({q._toks("addr_norm")}) AS addrt,
    {q._gram("name_norm_suf", 2)} AS name2, {q._gram("name_norm_suf", 3)} AS name3, {q._gram("addr_norm", 2)} AS addr2, {q._gram("addr_norm", 3)} AS addr3 FROM rec LEFT JOIN own USING (id)),
  pf AS MATERIALIZED (SELECT pool.*, {", ".join(f"{v} AS {k}" for k, v in _POOL_COLS.items())} FROM pool JOIN side x ON x.id = s1_id JOIN side y ON y.id = cand_id)"""


def _pool(v: q.View) -> DataFrame:
    return training.labelled_pool(v.held, v.held_truth, features.rare_vocabulary(v.held))


def _pooled(v: q.View) -> DataFrame:
    return training.pool_features(_pool(v), v.held, features.rare_vocabulary(v.held))


_FLAGS = [c for c in _POOL_COLS if c.startswith("pool_")]
_SIMS = [c for c in _POOL_COLS if not c.startswith("pool_")]
_SEEN = ["name_tok_jac", "name_char2", "addr_tok_jac", "num_overlap", "rare_shared"]
_key = ["s1_id", "cand_id", "channel"]
add("training_pool", _pool, f"WITH {POOL} SELECT * FROM pool")
add("training_flags", lambda v: _pooled(v).select(*_key, *_FLAGS), f"WITH {POOLED} SELECT {', '.join(_key + _FLAGS)} FROM pf")
add("training_features", lambda v: _pooled(v).select(*_key, *rounded(*_SIMS)), f"WITH {POOLED} SELECT {', '.join(_key)}, {', '.join(q._r(c, c) for c in _SIMS)} FROM pf")
add("block_negatives_name", lambda v: training.block_negatives(*[v.held.filter(f"src {s}").select("id", "country", "name_norm_suf") for s in ("= 1", "> 1")], ["country", "name_norm_suf"]), f"WITH {POOL} SELECT s1_id, cand_id FROM n_nameblk")
add("rare_token_negatives", lambda v: training.rare_token_negatives(v.held, features.rare_vocabulary(v.held)), f"WITH {POOL} SELECT s1_id, cand_id FROM n_raretok")
add("a03_ambiguity_channels", lambda v: training.channel_ambiguity(_pooled(v)),
    f"WITH {POOLED} SELECT channel, count(*) AS n, count(*) FILTER (WHERE pool_name_eq) AS n_same_name, count(*) FILTER (WHERE pool_addr_eq) AS n_same_addr, count(*) FILTER (WHERE pool_both_eq) AS n_same_both, count(*) FILTER (WHERE label = 0 AND name_tok_jac >= 0.8::DOUBLE AND NOT pool_name_eq) AS n_hard_negative, round(avg(name_tok_jac), 6) AS name_tok_jac_mean FROM pf GROUP BY channel")
_U = "u AS (" + " UNION ALL ".join(f"SELECT label, '{f}' AS feature, {f} AS v FROM pf" for f in _SEEN) + ")"
add("a01b_pool_separation", lambda v: analytics.separation(_pooled(v).withColumn("label", F.col("label") == 1), _SEEN),
    f"WITH {POOLED}, {_U}, a AS ({q._AUC.format('feature,', 'feature', 'u')}) SELECT feature, label = 1 AS label, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.9), 6) AS q90, round(quantile_cont(v, 0.99), 6) AS q99, auc FROM u JOIN a USING (feature) GROUP BY feature, label, auc")

# ---- gates and domains -----------------------------------------------------------------------------------------------
_CUTS = (0.3, 0.5, 0.7, 0.9)
add("a04_gates", lambda v: analytics.gates(v.labelled, ["name_tok_jac", "name_char2", "addr_tok_jac", "addr_char2"], _CUTS),
    f"WITH {q.LAB} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, {c}::DOUBLE AS cut, count(*) FILTER (WHERE label) AS n_true, count(*) FILTER (WHERE label AND {f} >= {c}::DOUBLE) AS true_kept, count(*) FILTER (WHERE NOT label AND {f} >= {c}::DOUBLE) AS false_kept FROM lab" for f in ("name_tok_jac", "name_char2", "addr_tok_jac", "addr_char2") for c in _CUTS))
_MEANS = f"round(avg({q._jac('q.name_toks', 'c.name_toks')}), 6) AS name_tok_jac_mean, round(avg({q._jac('q.addr_toks', 'c.addr_toks')}), 6) AS addr_tok_jac_mean, round(avg({q._both('q.addr_nums', 'c.addr_nums')}::DOUBLE), 6) AS num_overlap_mean"
_SETS = [(kind, by) for kind in ("name_type", "addr_type") for by in (None, "q_country", "msrc")]
add("a02_corruption_means", lambda v: analytics.corruption_means(analytics.truth_pairs(v.held, v.truth)),
    f"WITH {q._KINDS}, x AS (SELECT kd.*, q, c FROM kd JOIN pr USING (s1_id, matched_id)) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS value, '{b or 'all'}' AS by_name, {b or chr(39) + chr(39)} AS by_value, count(*) AS n, {_MEANS} FROM x GROUP BY ALL" for k, b in _SETS))
add("a08_block_overlap", lambda v: analytics.block_overlap(v.held.filter("src = 1"), v.held.filter("src > 1"), "name_norm_suf"),
    f"WITH {q.REC}, a AS (SELECT DISTINCT name_norm_suf AS k FROM rec WHERE src = 1), b AS (SELECT DISTINCT name_norm_suf AS k FROM rec WHERE src > 1) SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a SEMI JOIN b USING (k)) AS n_both")
for _c in ("addr_norm", "addr_num"):
    add(f"a10_blocks_by_country_{_c}", lambda v, c=_c: analytics.block_sizes(v.recs, c, "country"), f"WITH {q.REC} {q._BS.format(_c, 'country,', 'GROUP BY country')}")


def _halves(v: q.View) -> tuple[DataFrame, DataFrame]:
    """Records dealt into a training and a test set by their names' digests, so that their ids can't but their tokens may overlap."""
    test = training.digest(F.col("entity_id"), 42) % 100 < 30
    return tables.records(v.raw.filter(~test)), tables.records(v.raw.filter(test))


_TT = f"{q.REC}, tr AS (SELECT * FROM rec WHERE {_digest('id')} % 100 >= 30), te AS (SELECT * FROM rec WHERE {_digest('id')} % 100 < 30)"
_lap = lambda name, a, b: f"SELECT '{name}' AS name, (SELECT count(DISTINCT k) FROM {a}) AS n_a, (SELECT count(DISTINCT k) FROM {b}) AS n_b, (SELECT count(DISTINCT k) FROM {a} SEMI JOIN {b} USING (k)) AS n_both"
add("a13_train_test", lambda v: analytics.split_hygiene(*_halves(v), v.truth),
    f"WITH {_TT}, {q.GT}, " + ", ".join(f"tr{s} AS (SELECT id AS k FROM tr WHERE src = {s}), te{s} AS (SELECT id AS k FROM te WHERE src = {s})" for s in (1, 2, 3)) + ", g AS (SELECT s1_id AS k FROM gt) " + " UNION ALL ".join([*[_lap(f"s{s}", f"tr{s}", f"te{s}") for s in (1, 2, 3)], _lap("truth", "g", "te1")]))
add("a16_country_shift", lambda v: analytics.country_shift(*_halves(v)),
    f"WITH {_TT} SELECT coalesce(a.country, b.country) AS country, coalesce(a.n, 0) AS n_train, coalesce(b.n, 0) AS n_test FROM (SELECT country, count(*) AS n FROM tr GROUP BY 1) a FULL JOIN (SELECT country, count(*) AS n FROM te GROUP BY 1) b USING (country)")

# ---- names that hold company words -----------------------------------------------------------------------------------
_NAME = "array_to_string(string_split(l1, ' ')[1:6], ' ') AS name"
_WORDED = "array_to_string(string_split(l1, ' ')[1:6], ' ') || CASE doc_id % 5 WHEN 0 THEN ' limited' WHEN 1 THEN ' Ltd.' WHEN 2 THEN ' private limited' WHEN 3 THEN ' company' ELSE '' END AS name"


class Worded(q.View):
    """The entity view with a company word after most names, so that the suffix channel and its rules have something to find."""

    @property
    def raw(self) -> DataFrame:
        n = F.substring("entity_id", 4, 20).cast("long") % 5
        word = F.when(n == 0, " limited").when(n == 1, " Ltd.").when(n == 2, " private limited").when(n == 3, " company").otherwise("")
        return super().raw.withColumn("business_name", F.concat("business_name", word))


def _worded(plan):
    return lambda v: plan(Worded(v.spark, v.sf_dir))


_in_words = lambda sql: sql.replace(_NAME, _WORDED)
q.Q["block_name_suffix"], q.SQL["block_name_suffix"] = _worded(q.Q["block_name_suffix"]), _in_words(q.SQL["block_name_suffix"])
add("suffix_edges", _worded(lambda v: v.edges), _in_words(f"WITH {q.EDGES} SELECT s1_id, cand_id, conf FROM edges"))
add("suffix_candidates", _worded(lambda v: blocking.candidates(v.held)), _in_words(f"WITH {q._blocks()} SELECT s1_id, cand_id, mask FROM allc"))
add("suffix_features", _worded(lambda v: v.feats.select("s1_id", "cand_id", "name_eq", "name_suf_eq")), _in_words(f"WITH {q.FEAT} SELECT s1_id, cand_id, name_eq, name_suf_eq FROM feat"))
add("suffix_rule_scores", _worded(lambda v: v.scored.select("s1_id", "cand_id", *rounded("conf"), "tier")), _in_words(f"WITH {q.SCORED} SELECT s1_id, cand_id, {q._r('conf', 'conf')}, tier FROM scored"))

# ---- the native variant ----------------------------------------------------------------------------------------------
_n = "num_overlap >= 1"
NATIVE_SQL = [
    (f"name_eq > 0 AND (addr_eq > 0 OR addr_tok_jac >= 0.35::DOUBLE OR {_n})", q.RULES_SQL[0][1], 1),
    ("addr_eq > 0 AND (name_tok_jac >= 0.3::DOUBLE OR name_char2 >= 0.4::DOUBLE)", q.RULES_SQL[1][1], 1),
    (q.RULES_SQL[2][0], q.RULES_SQL[2][1], 1),
    (f"{_n} AND (name_tok_jac >= 0.45::DOUBLE OR name_char2 >= 0.55::DOUBLE) AND (addr_tok_jac >= 0.3::DOUBLE OR addr_char2 >= 0.45::DOUBLE)", q.RULES_SQL[3][1], 1),
    (f"(addr_tok_jac >= 0.5::DOUBLE OR addr_char3 >= 0.65::DOUBLE) AND {_n} AND name_char2 >= 0.3::DOUBLE", q.RULES_SQL[4][1], 2),
    (q.RULES_SQL[5][0], q.RULES_SQL[5][1], 2),
]
_NATIVE = f"{q.FEAT}, scored AS (SELECT s1_id, cand_id, CASE {' '.join(f'WHEN {w} THEN {c}' for w, c, _ in NATIVE_SQL)} ELSE 0.0::DOUBLE END AS conf, CASE {' '.join(f'WHEN {w} THEN {t}' for w, _, t in NATIVE_SQL)} ELSE 0 END AS tier FROM feat)"
add("rule_scores_native", lambda v: rules.score_native(v.feats).select("s1_id", "cand_id", *rounded("conf"), "tier"), f"WITH {_NATIVE} SELECT s1_id, cand_id, {q._r('conf', 'conf')}, tier FROM scored")
_CLEAN = r"trim(regexp_replace(lower(regexp_replace({0}, '[^\x00-\x7F]', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_ng = lambda c, n: f"CASE WHEN length({c}) < {n} THEN []::VARCHAR[] ELSE {q._gram(c, n)} END"
_nd = lambda a, b: q._guard(a, b, f"2.0::DOUBLE * {q._both(a, b)} / (len({a}) + len({b}))", "0.0::DOUBLE")


def _native_dice(v: q.View) -> DataFrame:
    if v.recs.groupBy("id").count().filter("count > 1").limit(1).count() == 0:
        return native.paired_dice(v.held, digits=6)
    # Ids that repeat: a pair is one of ids, and its rows are those of all records of both.
    r = v.raw.select("entity_id", "country", text.ascii_clean(F.col("business_name")).alias("name"), text.ascii_clean(F.col("business_address")).alias("addr"))
    grams = [sets.ngrams(F.col(c), n, whole=False).alias(f"{c}{n}") for c in ("name", "addr") for n in (2, 3)]
    g = r.select("entity_id", *grams)
    side = lambda name, p: g.select(F.col("entity_id").alias(name), *[F.col(c).alias(f"{p}_{c}") for c in g.columns[1:]])
    pairs = v.edges.select("s1_id", "cand_id").join(side("s1_id", "q"), "s1_id").join(side("cand_id", "c"), "cand_id")
    return pairs.select("s1_id", "cand_id", *[F.round(sets.dice(F.col(f"q_{c}"), F.col(f"c_{c}"), 0.0), 6).alias(c) for c in native.DICE])


add("native_dice", _native_dice,
    f"WITH {q.EDGES}, cl AS (SELECT id, {_CLEAN.format('name')} AS name, {_CLEAN.format('addr')} AS addr FROM ent), g AS (SELECT id, {', '.join(f'{_ng(c, n)} AS {c}{n}' for c in ('name', 'addr') for n in (2, 3))} FROM cl) SELECT s1_id, cand_id, {', '.join(f'round({_nd(f"x.{c}", f"y.{c}")}, 6) AS {c}' for c in ('name2', 'name3', 'addr2', 'addr3'))} FROM edges JOIN g x ON x.id = s1_id JOIN g y ON y.id = cand_id")

# ---- results and their report ----------------------------------------------------------------------------------------


def _bundle(v: q.View) -> DataFrame:
    cands = v.cands
    matching, candidate = bundle(v.s1, select.policy_c(rules.score(features.pair_features(cands, v.held))), cands)
    return matching.join(candidate, "source1_entity_id")


add("result_bundle", _bundle,
    f"WITH {q.SCORED}, {q.S1}, {q._POLICY_C}, m AS (SELECT s1_id, string_agg(cand_id, ',' ORDER BY cand_id) AS l FROM pred GROUP BY 1), k AS (SELECT s1_id, string_agg(cand_id, ',' ORDER BY cand_id) AS l FROM cand GROUP BY 1) SELECT s1.s1_id AS source1_entity_id, coalesce(m.l, '') AS matched_entity_ids, coalesce(k.l, '') AS candidate_entity_ids FROM s1 LEFT JOIN m USING (s1_id) LEFT JOIN k USING (s1_id)")


def _lines(v: q.View) -> DataFrame:
    """The faulty result frame as lines of a file, some without a tab, under a header with the wrong delimiter."""
    bad = q._bad(v)
    i = F.substring("source1_entity_id", 4, 20)
    row = bad.select(F.when(i.endswith("3"), F.col("source1_entity_id")).otherwise(F.concat_ws("\t", "source1_entity_id", "matched_entity_ids")).alias("value"))
    return row.unionByName(v.spark.range(1).select(F.lit("source1_entity_id,matched_entity_ids").alias("value")))


_LINES = "lines AS (SELECT CASE WHEN a LIKE '%3' THEN a ELSE a || chr(9) || b END AS value FROM bad UNION ALL SELECT 'source1_entity_id,matched_entity_ids')"
_count = lambda name, kind, sql: f"SELECT '{name}' AS check_name, '{kind}' AS kind, count(*) AS n FROM ({sql})"
_body = lambda name: q.SQL[name].removeprefix(q._V)
_CHECKS = {"duplicate_rows": "v03_dup_rows", "duplicate_ids": "v04_dup_ids", "self_matches": "v05_self_matches", "wrong_prefix": "v06_wrong_prefix", "unknown_ids": "v07_unknown_ids", "missing_rows": "v08_missing_rows", "unexpected_rows": "v08_unexpected_rows"}
_OUTSIDE = "k AS (SELECT s1_id, cand_id FROM edges QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY conf DESC, cand_id) <= 50 UNION SELECT s1_id, cand_id FROM one), m AS (SELECT s1_id, list(cand_id) AS c FROM k GROUP BY s1_id)"
add("v01_v02_lines", lambda v: validate.header_errors(_lines(v)).select("value").unionByName(validate.malformed(_lines(v))),
    f"WITH {q.REC}, {q.S1}, {q._BAD}, {_LINES} SELECT value FROM lines WHERE value LIKE 'source1_entity_id%' AND value <> 'source1_entity_id' || chr(9) || 'matched_entity_ids' UNION ALL SELECT value FROM lines WHERE value <> '' AND NOT contains(value, chr(9))")
add("v10_report", lambda v: validate.report(q._bad(v), baseline.baseline(v.held)[1], v.s1, v.recs.filter("src > 1").select("id"), _lines(v)),
    f"WITH {q.EDGES}, {q.S1}, {q._OWN}, {q._BAD}, {_OUTSIDE}, {_LINES} " + " UNION ALL ".join(_count(k, "error", _body(x)) for k, x in _CHECKS.items()) + " UNION ALL " + _count("header", "error", "SELECT value FROM lines WHERE value LIKE 'source1_entity_id%' AND value <> 'source1_entity_id' || chr(9) || 'matched_entity_ids'") + " UNION ALL " + _count("malformed", "error", "SELECT value FROM lines WHERE value <> '' AND NOT contains(value, chr(9))") + " UNION ALL " + _count("outside_candidates", "warning", "SELECT a FROM items LEFT JOIN m ON a = s1_id WHERE len(list_filter(l, lambda x: NOT list_contains(coalesce(c, []::VARCHAR[]), x))) > 0"))
