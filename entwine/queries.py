"""Every query of the library over the entity view of a documents table, with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.functions import sets, text
from entwine.operators import blocking, features, metrics, rules, sampling, select, validate
from entwine.operators.features import MODEL
from entwine.plans import analytics, baseline
from entwine.plans.lineage import cut
from entwine.sources import tables

# ---- frames ----------------------------------------------------------------------------------------------------------


class View:
    """Frames over one folder of tables; each is a plan, but for held and held_truth, which queries over the pool read several times."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def raw(self) -> DataFrame:
        return tables.entity_view(self.docs)

    @property
    def recs(self) -> DataFrame:
        return tables.records(self.raw)

    @cached_property
    def held(self) -> DataFrame:
        """recs, written once, for plans that read them many times. A scan of few partitions is spread first."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        recs = self.recs
        return cut(recs.repartition(n, "id") if recs.rdd.getNumPartitions() < n else recs)

    @property
    def s1(self) -> DataFrame:
        return self.recs.filter("src = 1").select(F.col("id").alias("s1_id"), "country")

    @property
    def truth(self) -> DataFrame:
        return tables.proxy_truth(self.docs)

    @cached_property
    def held_truth(self) -> DataFrame:
        """truth, written once: it reads whole texts."""
        return cut(self.truth)

    @property
    def cands(self) -> DataFrame:
        return blocking.budgeted(blocking.candidates(self.recs))

    @property
    def feats(self) -> DataFrame:
        return features.pair_features(self.cands, self.recs)

    @property
    def labelled(self) -> DataFrame:
        t = self.truth.select("s1_id", F.col("matched_id").alias("cand_id"), F.lit(True).alias("label")).distinct()
        return self.feats.join(t, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("label", F.lit(False)))

    @property
    def scored(self) -> DataFrame:
        return rules.score(self.feats).select("s1_id", "cand_id", "conf", "tier")

    @property
    def edges(self) -> DataFrame:
        return baseline.joined(self.recs)


# ---- SQL of the same frames --------------------------------------------------------------------------------------------

_norm = lambda c: rf"trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _short(c: str) -> str:
    for w, s in text.SUFFIXES.items():
        c = rf"regexp_replace({c}, '\b{w}\b', '{s}', 'g')"
    return c


def _short_addr(c: str) -> str:
    for w, s in text.ABBREVIATIONS.items():
        c = rf"regexp_replace({c}, '\b{w}\b', '{s}', 'g')"
    return c


_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
_toks = lambda c: f"list_filter(string_split({c}, ' '), lambda x: x <> '')"

ENT = """ent AS (SELECT doc_id, 1 + doc_id % 3 AS src, 'S' || (1 + doc_id % 3) || '-' || doc_id AS id, lang AS country,
    array_to_string(string_split(l1, ' ')[1:6], ' ') AS name,
    CASE WHEN l2 IS NULL OR l2 = '' THEN '' ELSE length(l2) || ' ' || array_to_string(string_split(l2, ' ')[1:8], ' ') || ' ' || len(string_split(l2, ' ')) || 'w' END AS addr
    FROM (SELECT doc_id, lang, string_split(text, chr(10))[1] AS l1, string_split(text, chr(10))[2] AS l2 FROM documents))"""
REC = rf"""{ENT}, n0 AS (SELECT *, {_norm("name")} AS name_norm, {_norm("addr")} AS addr_norm,
    list_sort(list_distinct(list_filter(string_split_regex(lower(addr), '\s+'), lambda t: regexp_matches(t, '\p{{Nd}}')))) AS addr_nums FROM ent),
  rec AS (SELECT *, {_short("name_norm")} AS name_norm_suf, array_to_string(addr_nums, ' ') AS addr_num, length(name_norm) AS nlen, length(addr_norm) AS alen,
    {_toks("name_norm")} AS nt, {_toks("addr_norm")} AS at_, len(nt) AS ntok, len(at_) AS atok, list_distinct(nt) AS name_toks, list_distinct(at_) AS addr_toks,
    regexp_matches(name, '[^\x00-\x7F]')::INT AS non_a_name, regexp_matches(addr, '[^\x00-\x7F]')::INT AS non_a_addr, (addr = '')::INT AS addr_missing FROM n0)"""
GT = f"""tn AS (SELECT doc_id, lang AS country, 1 + doc_id % 3 AS src, {_norm("text")} AS t FROM documents),
  f1 AS (SELECT country, t, min(doc_id) AS s1 FROM tn WHERE src = 1 GROUP BY ALL),
  gt AS (SELECT 'S1-' || s1 AS s1_id, 'S' || src || '-' || doc_id AS matched_id, 'S' || src AS msrc FROM tn JOIN f1 USING (country, t) WHERE src > 1)"""


def _keys(suffix: str) -> str:
    return rf"""SELECT country, id, 1 AS ch, name_norm AS key FROM s WHERE name_norm <> ''
    UNION ALL SELECT country, id, 2, name_norm_suf FROM s WHERE {suffix}
    UNION ALL SELECT country, id, 16, addr_norm FROM s WHERE addr_missing = 0 AND length(addr_norm) >= 5
    UNION ALL SELECT country, id, 4, k FROM (SELECT country, id, unnest(name_toks) AS k FROM s) WHERE length(k) >= 3 AND k NOT IN ({_list(text.NAME_STOP)})
    UNION ALL SELECT country, id, 32, k FROM (SELECT country, id, unnest(addr_toks) AS k FROM s WHERE addr_missing = 0) WHERE length(k) >= 4 AND k NOT IN ({_list(text.ADDR_STOP)}) AND NOT regexp_matches(k, '\p{{Nd}}')
    UNION ALL SELECT country, id, 8, k FROM (SELECT country, id, unnest(addr_nums) AS k FROM s) WHERE length(k) >= 2"""


def _blocks(caps: blocking.Caps = blocking.Caps()) -> str:
    return f"""{REC},
  qk AS (WITH s AS (SELECT * FROM rec WHERE src = 1) {_keys("name_norm_suf <> ''")}),
  ck AS (WITH s AS (SELECT * FROM rec WHERE src > 1) {_keys("name_norm_suf <> '' AND name_norm_suf <> name_norm")}),
  big AS (SELECT country, ch, key, count(*) AS size FROM ck GROUP BY ALL HAVING count(*) > CASE WHEN ch IN (1, 2) THEN {caps.name} WHEN ch = 4 THEN {caps.name_token} WHEN ch = 8 THEN {caps.number} WHEN ch = 16 THEN {caps.address} ELSE {caps.address_token} END),
  allc AS (SELECT q.id AS s1_id, c.id AS cand_id, bit_or(c.ch) AS mask FROM qk q JOIN (SELECT * FROM ck ANTI JOIN big USING (country, ch, key)) c USING (country, ch, key) GROUP BY ALL),
  cand AS (SELECT s1_id, cand_id, mask FROM allc QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY bit_count(mask) DESC, cand_id) <= {caps.budget})"""


_gram = lambda c, n: f"CASE WHEN length({c}) = 0 THEN []::VARCHAR[] WHEN length({c}) < {n} THEN [{c}] ELSE list_distinct(list_transform(generate_series(1, length({c}) - {n - 1}), lambda i: substr({c}, i, {n}))) END"
_both = lambda a, b: f"len(list_intersect({a}, {b}))"
_guard = lambda a, b, x, e: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {e} WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {x} END"
_dice = lambda a, b: _guard(a, b, f"2.0::DOUBLE * {_both(a, b)} / (len({a}) + len({b}))", "1.0::DOUBLE")
_jac = lambda a, b: _guard(a, b, f"{_both(a, b)}::DOUBLE / (len({a}) + len({b}) - {_both(a, b)})", "1.0::DOUBLE")
_cont = lambda a, b: _guard(a, b, f"{_both(a, b)}::DOUBLE / least(len({a}), len({b}))", "0.0::DOUBLE")
_share = lambda a, b: f"{_both(a, b)}::DOUBLE / greatest(len({a}), 1)"
_flag = lambda c: f"CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_addr = lambda x: f"CASE WHEN q.addr_norm <> '' AND c.addr_norm <> '' THEN {x} ELSE 0.0::DOUBLE END"
_same = lambda t: f"len(q.{t}) > 0 AND len(q.{t}) = len(c.{t}) AND {_both(f'q.{t}', f'c.{t}')} = len(q.{t})"
_end = lambda i: _flag(f"len(q.addr_nums) > 0 AND len(c.addr_nums) > 0 AND q.addr_nums[{i}] = c.addr_nums[{i}]")

FEATURE_SQL = {
    "name_eq": _flag("q.name_norm <> '' AND q.name_norm = c.name_norm"),
    "name_suf_eq": _flag("q.name_norm_suf <> '' AND q.name_norm_suf = c.name_norm_suf"),
    "name_tok_jac": _jac("q.name_toks", "c.name_toks"),
    "name_char2": _dice("q.n2", "c.n2"),
    "name_char3": _dice("q.n3", "c.n3"),
    "name_contain": _cont("q.name_toks", "c.name_toks"),
    "name_len_diff": "abs(q.nlen - c.nlen)::DOUBLE",
    "name_tok_diff": "abs(len(q.name_toks) - len(c.name_toks))::DOUBLE",
    "addr_missing": _flag("c.addr_norm = ''"),
    "addr_eq": _addr(_flag("q.addr_norm = c.addr_norm")),
    "addr_tok_jac": _addr(_jac("q.addr_toks", "c.addr_toks")),
    "addr_char2": _addr(_dice("q.a2", "c.a2")),
    "addr_char3": _addr(_dice("q.a3", "c.a3")),
    "addr_contain": _addr(_cont("q.addr_toks", "c.addr_toks")),
    "addr_len_diff": _addr("abs(q.alen - c.alen)::DOUBLE"),
    "num_overlap": f"{_both('q.addr_nums', 'c.addr_nums')}::DOUBLE",
    "num_overlap_ratio": f"{_both('q.addr_nums', 'c.addr_nums')}::DOUBLE / greatest(len(q.addr_nums), len(c.addr_nums), 1)",
    "first_num_match": _end(1),
    "last_num_match": _end(-1),
    "ch_count": "bit_count(mask)::DOUBLE",
    "name_contain_q": _share("q.name_toks", "c.name_toks"),
    "name_contain_c": _share("c.name_toks", "q.name_toks"),
    "addr_contain_q": _addr(_share("q.addr_toks", "c.addr_toks")),
    "addr_contain_c": _addr(_share("c.addr_toks", "q.addr_toks")),
    "rare_shared": f"{_both('q.name_toks', 'c.name_toks')}::DOUBLE",
    "pool_name_eq": _flag("q.name_norm <> '' AND q.name_norm = c.name_norm"),
    "pool_addr_eq": _flag("q.addr_norm <> '' AND q.addr_norm = c.addr_norm"),
    "pool_both_eq": _flag("q.name_norm <> '' AND q.name_norm = c.name_norm AND q.addr_norm <> '' AND q.addr_norm = c.addr_norm"),
    "pool_ntok_eq": _flag(_same("name_toks")),
    "pool_atok_eq": _flag(_same("addr_toks")),
    "pool_addr_any_missing": _flag("c.addr_missing = 1 OR q.addr_norm = ''"),
    "is_us": _flag("lower(q.country) IN ('us', 'usa', 'united states')"),
}
FEAT = f"""{_blocks()},
  gram AS MATERIALIZED (SELECT *, {_gram("name_norm", 2)} AS n2, {_gram("name_norm", 3)} AS n3, {_gram("addr_norm", 2)} AS a2, {_gram("addr_norm", 3)} AS a3 FROM rec),
  feat AS MATERIALIZED (SELECT s1_id, cand_id, q.country AS country, mask, {", ".join(f"{v} AS {k}" for k, v in FEATURE_SQL.items())} FROM cand JOIN gram q ON q.id = s1_id JOIN gram c ON c.id = cand_id)"""
_num, _first, _eq = "num_overlap >= 1", "first_num_match > 0", "(name_eq > 0 OR name_suf_eq > 0)"
RULES_SQL = [
    (f"{_eq} AND (addr_eq > 0 OR addr_tok_jac >= 0.35::DOUBLE OR addr_char2 >= 0.5::DOUBLE OR {_num} OR {_first})", f"0.95::DOUBLE + 0.04::DOUBLE * least(1.0::DOUBLE, addr_tok_jac + CASE WHEN {_num} THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)", 1),
    ("addr_eq > 0 AND (name_tok_jac >= 0.3::DOUBLE OR name_char2 >= 0.4::DOUBLE OR name_contain >= 0.5::DOUBLE)", "0.94::DOUBLE + 0.05::DOUBLE * least(1.0::DOUBLE, name_tok_jac)", 1),
    ("(name_tok_jac >= 0.65::DOUBLE OR name_char3 >= 0.7::DOUBLE) AND (addr_tok_jac >= 0.45::DOUBLE OR addr_char2 >= 0.6::DOUBLE)", "0.92::DOUBLE + 0.05::DOUBLE * least(1.0::DOUBLE, (name_tok_jac + addr_tok_jac) / 2.0::DOUBLE)", 1),
    (f"({_num} OR {_first}) AND (name_tok_jac >= 0.45::DOUBLE OR name_char2 >= 0.55::DOUBLE OR name_contain >= 0.6::DOUBLE) AND (addr_tok_jac >= 0.3::DOUBLE OR addr_char2 >= 0.45::DOUBLE)", "0.91::DOUBLE + 0.05::DOUBLE * least(1.0::DOUBLE, (name_tok_jac + addr_tok_jac) / 2.0::DOUBLE)", 1),
    (f"(addr_tok_jac >= 0.5::DOUBLE OR addr_char3 >= 0.65::DOUBLE) AND ({_num} OR {_first}) AND (name_char2 >= 0.3::DOUBLE OR name_contain >= 0.35::DOUBLE)", "0.85::DOUBLE + 0.05::DOUBLE * addr_tok_jac", 2),
    ("(name_tok_jac >= 0.55::DOUBLE OR name_char3 >= 0.6::DOUBLE) AND (addr_tok_jac >= 0.35::DOUBLE OR addr_char2 >= 0.5::DOUBLE)", "0.80::DOUBLE + 0.05::DOUBLE * name_tok_jac", 2),
    (f"({_num} OR {_first} OR last_num_match > 0) AND (name_tok_jac >= 0.6::DOUBLE OR (name_char2 >= 0.7::DOUBLE AND name_contain >= 0.6::DOUBLE))", "0.78::DOUBLE + 0.05::DOUBLE * name_tok_jac", 2),
    (f"addr_missing > 0 AND {_eq} AND name_len_diff <= 3", "0.76::DOUBLE", 2),
    ("addr_tok_jac >= 0.45::DOUBLE AND (name_tok_jac >= 0.25::DOUBLE OR name_char2 >= 0.35::DOUBLE)", "0.65::DOUBLE + 0.05::DOUBLE * addr_tok_jac", 3),
    (f"(name_tok_jac >= 0.8::DOUBLE OR ({_eq} AND name_len_diff <= 2)) AND (addr_char2 >= 0.3::DOUBLE OR addr_contain >= 0.3::DOUBLE)", "0.60::DOUBLE", 3),
]


def _scored() -> str:
    r = RULES_SQL
    return f"""{FEAT}, scored AS MATERIALIZED (SELECT s1_id, cand_id, CASE {" ".join(f"WHEN {w} THEN {c}" for w, c, _ in r)} ELSE 0.0::DOUBLE END AS conf,
    CASE {" ".join(f"WHEN {w} THEN {t}" for w, _, t in r)} ELSE 0 END AS tier FROM feat)"""


SCORED = _scored()
LAB = f"""{FEAT}, {GT}, lab AS MATERIALIZED (SELECT f.*, g.s1_id IS NOT NULL AS label FROM feat f LEFT JOIN (SELECT DISTINCT s1_id, matched_id FROM gt) g ON f.s1_id = g.s1_id AND f.cand_id = g.matched_id)"""
EDGES = f"""{REC}, ex AS (SELECT q.id AS s1_id, c.id AS cand_id, 0.95::DOUBLE AS conf FROM rec q JOIN rec c USING (country, name_norm) WHERE q.src = 1 AND c.src > 1 AND strlen(name_norm) >= 3
    UNION ALL SELECT q.id, c.id, 0.88::DOUBLE FROM rec q JOIN rec c USING (country, name_norm_suf) WHERE q.src = 1 AND c.src > 1 AND strlen(name_norm_suf) >= 3 AND q.name_norm <> name_norm_suf AND c.name_norm <> name_norm_suf),
  edges AS (SELECT s1_id, cand_id, max(conf) AS conf FROM ex GROUP BY ALL)"""
S1 = "s1 AS (SELECT id AS s1_id, country FROM rec WHERE src = 1)"
_F05 = "CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0::DOUBLE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * (tp::DOUBLE / n_pred) * (tp::DOUBLE / n_true) / (0.25::DOUBLE * (tp::DOUBLE / n_pred) + tp::DOUBLE / n_true) END"
_POLICY_C = "pred AS (SELECT s1_id, cand_id FROM (SELECT *, row_number() OVER w AS r, max(conf) OVER (PARTITION BY s1_id) AS top FROM scored WINDOW w AS (PARTITION BY s1_id ORDER BY conf DESC, cand_id)) WHERE r <= 11 AND top >= 0.85::DOUBLE AND (r = 1 OR (tier IN (1, 2) AND conf >= greatest(0.72::DOUBLE, top - 0.15::DOUBLE))))"
SCORES = f"""{SCORED}, {GT}, {S1}, {_POLICY_C},
  es AS (SELECT s1_id, country, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true FROM s1 LEFT JOIN (
    SELECT s1_id, count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p) AS n_pred, count(*) FILTER (WHERE t) AS n_true FROM (
      SELECT coalesce(p.s1_id, g.s1_id) AS s1_id, p.s1_id IS NOT NULL AS p, g.s1_id IS NOT NULL AS t FROM pred p FULL JOIN (SELECT DISTINCT s1_id, matched_id FROM gt) g ON p.s1_id = g.s1_id AND p.cand_id = g.matched_id) GROUP BY s1_id) USING (s1_id)),
  sc AS (SELECT *, {_F05} AS f05 FROM es)"""
_MASKS_SQL = {
    "R1": "pool_name_eq > 0", "R2": "pool_both_eq > 0", "R3": "pool_name_eq > 0 AND num_overlap >= 1", "R4": "name_tok_jac >= 0.8::DOUBLE", "R5": "name_tok_jac >= 0.8::DOUBLE OR name_char2 >= 0.9::DOUBLE",
    "R6": "name_tok_jac >= 0.6::DOUBLE AND addr_tok_jac >= 0.5::DOUBLE", "R7": "addr_tok_jac >= 0.4::DOUBLE AND num_overlap >= 1", "R8": "addr_char2 >= 0.8::DOUBLE", "R9": "num_overlap >= 1 AND name_tok_jac >= 0.5::DOUBLE",
    "R10": "name_tok_jac >= 0.9::DOUBLE OR addr_tok_jac >= 0.6::DOUBLE OR addr_char2 >= 0.9::DOUBLE OR num_overlap >= 1", "R11": "rare_shared >= 1 AND addr_tok_jac >= 0.3::DOUBLE",
}
MASKS = f"{LAB}, mk AS (" + " UNION ALL ".join(f"SELECT s1_id, cand_id, label, '{k}' AS rule, ({v}) AS pred FROM lab" for k, v in _MASKS_SQL.items()) + ")"

_r = lambda c, n: f"round({c}, 6) AS {n}"

Q: dict[str, Callable[[View], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, plan: Callable[[View], DataFrame], sql: str | None = None) -> None:
    Q[name] = plan
    if sql is not None:
        SQL[name] = sql


big = lambda *names: [F.col(n).cast("long").alias(n) for n in names]
rounded = lambda *names: [F.round(n, 6).alias(n) for n in names]

# Text
add("records", lambda v: v.recs.select("id", *[F.col(c).cast("int").alias(c) for c in ("src", "nlen", "alen", "ntok", "atok", "non_a_name", "non_a_addr", "addr_missing")], "country", "name", "addr", "name_norm", "name_norm_suf", "addr_norm", "addr_num"),
    f"WITH {REC} SELECT id, src::INT AS src, nlen::INT AS nlen, alen::INT AS alen, ntok::INT AS ntok, atok::INT AS atok, non_a_name, non_a_addr, addr_missing, country, name, addr, name_norm, name_norm_suf, addr_norm, addr_num FROM rec")
add("norm_core", lambda v: v.raw.select(F.col("entity_id").alias("id"), text.normalize(F.col("business_name")).alias("norm")), f"WITH {REC} SELECT id, name_norm AS norm FROM rec")
add("norm_core_full", lambda v: v.raw.select(F.col("entity_id").alias("id"), text.normalize(text.fold_full("business_name"), accents=True).alias("norm")), f"WITH {REC} SELECT id, name_norm AS norm FROM rec")
add("norm_accents", lambda v: v.raw.select(F.col("entity_id").alias("id"), text.normalize(F.col("business_name"), accents=True).alias("norm")), rf"WITH {ENT} SELECT id, trim(regexp_replace(regexp_replace(lower(name), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM ent")
add("norm_suffix", lambda v: v.docs.select("doc_id", text.short_suffixes(F.concat(text.normalize(F.col("text")), F.lit(" company limited private ltd"))).alias("norm")), f"SELECT doc_id, {_short('(' + _norm('text') + chr(32) + '|| ' + chr(39) + ' company limited private ltd' + chr(39) + ')')} AS norm FROM documents")
add("norm_address", lambda v: v.docs.select("doc_id", text.short_address(F.concat(F.lit("12 main street lane "), text.normalize(F.col("text")))).alias("norm")), f"SELECT doc_id, {_short_addr('(' + chr(39) + '12 main street lane ' + chr(39) + ' || ' + _norm('text') + ')')} AS norm FROM documents")
add("numeric_tokens", lambda v: v.recs.select("id", "addr_num"), f"WITH {REC} SELECT id, addr_num FROM rec")
add("tokens_exploded", lambda v: v.recs.select("id", F.explode(text.tokens(F.col("name_norm"))).alias("token")), f"WITH {REC} SELECT id, unnest(nt) AS token FROM rec")
add("non_ascii_flag", lambda v: v.raw.select(F.col("entity_id").alias("id"), text.non_ascii(F.col("business_name")).alias("flag")), rf"WITH {ENT} SELECT id, regexp_matches(name, '[^\x00-\x7F]') AS flag FROM ent")
add("native_clean", lambda v: v.raw.select(F.col("entity_id").alias("id"), text.ascii_clean(F.col("business_name")).alias("clean")), r"WITH " + ENT + r" SELECT id, trim(regexp_replace(lower(regexp_replace(name, '[^\x00-\x7F]', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')) AS clean FROM ent")
add("native_tokens", lambda v: v.raw.select(F.col("entity_id").alias("id"), F.array_join(text.ascii_tokens(text.ascii_clean(F.col("business_name"))), " ").alias("toks")), r"WITH " + ENT + r", c AS (SELECT id, string_split(trim(regexp_replace(lower(regexp_replace(name, '[^\x00-\x7F]', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')), ' ') AS t FROM ent) " + f"SELECT id, array_to_string(list_filter(t, lambda x: length(x) >= 2 AND x NOT IN ({_list(text.NAME_STOP)})), ' ') AS toks FROM c")
add("native_digit_runs", lambda v: v.raw.select(F.col("entity_id").alias("id"), F.array_join(text.digit_runs(F.col("business_address")), " ").alias("runs")), f"WITH {ENT} SELECT id, array_to_string(regexp_extract_all(addr, '[0-9]+'), ' ') AS runs FROM ent")
add("lengths", lambda v: v.raw.select(F.col("entity_id").alias("id"), F.char_length("business_name").cast("long").alias("chars"), F.octet_length("business_name").cast("long").alias("bytes")), f"WITH {ENT} SELECT id, length(name)::BIGINT AS chars, strlen(name)::BIGINT AS bytes FROM ent")

# Sources
add("gt_long", lambda v: v.truth, f"WITH {GT} SELECT s1_id, matched_id, msrc FROM gt")
_wide = lambda v: v.s1.join(v.truth.groupBy("s1_id").agg(F.array_join(F.sort_array(F.collect_set("matched_id")), ",").alias("m")), "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("m", F.lit("")).alias("matched_entity_ids"))
add("gt_wide_to_long", lambda v: tables.truth_long(_wide(v)), f"WITH {GT} SELECT DISTINCT s1_id, matched_id, msrc FROM gt")
add("gt_sets", lambda v: tables.truth_sets(v.s1, v.truth).select("s1_id", F.array_join("matched", ",").alias("matched")), f"WITH {REC}, {GT}, {S1} SELECT s1_id, coalesce(m, '') AS matched FROM s1 LEFT JOIN (SELECT s1_id, string_agg(DISTINCT matched_id, ',' ORDER BY matched_id) AS m FROM gt GROUP BY s1_id) USING (s1_id)")
add("id_set", lambda v: tables.ids(v.raw), f"WITH {ENT} SELECT DISTINCT id AS entity_id FROM ent")
add("native_scan", lambda v: tables.native_rows(v.raw, 2, "en").select("entity_id", "business_name"), f"WITH {ENT} SELECT id AS entity_id, name AS business_name FROM ent WHERE src = 2 AND country = 'en'")

# Blocking
for _n, _bit in (("name_exact", 1), ("name_suffix", 2), ("addr_exact", 16), ("name_token", 4), ("addr_token", 32), ("numeric", 8)):
    add(f"block_{_n}", lambda v, b=_bit: blocking.query_postings(v.recs).filter(F.col("channel") == b).join(blocking.candidate_postings(v.recs).filter(F.col("channel") == b), blocking.KEY).select("s1_id", "cand_id", "key"),
        f"WITH {_blocks()} SELECT q.id AS s1_id, c.id AS cand_id, key FROM qk q JOIN ck c USING (country, ch, key) WHERE ch = {_bit}")
add("query_vocabulary", lambda v: blocking.query_postings(v.recs).select("channel", "key").distinct(), f"WITH {_blocks()} SELECT DISTINCT ch AS channel, key FROM qk")
add("candidates_mask", lambda v: blocking.candidates(v.recs), f"WITH {_blocks()} SELECT s1_id, cand_id, mask FROM allc")
add("candidates_budget", lambda v: v.cands, f"WITH {_blocks()} SELECT s1_id, cand_id, mask FROM cand")
add("blocking_recall", lambda v: blocking.recall(v.cands, v.truth, v.s1).select("n_true", "n_found", *rounded("recall", "mean_candidates")), f"WITH {_blocks()}, {GT}, {S1}, t AS (SELECT DISTINCT s1_id, matched_id FROM gt) SELECT count(*) AS n_true, count(c.s1_id) AS n_found, round(count(c.s1_id)::DOUBLE / count(*), 6) AS recall, round((SELECT count(*) FROM cand)::DOUBLE / (SELECT count(*) FROM s1), 6) AS mean_candidates FROM t LEFT JOIN cand c ON t.s1_id = c.s1_id AND t.matched_id = c.cand_id")
_side = lambda v, src, name: v.recs.filter(f"src {src} AND name_norm <> ''").select("country", "name_norm", F.col("id").alias(name))
add("bounded_key_join", lambda v: blocking.bounded_key_join(_side(v, "= 1", "s1_id"), _side(v, "> 1", "cand_id"), ["country", "name_norm"]).select("s1_id", "cand_id"), f"WITH {REC}, k AS (SELECT country, name_norm FROM rec WHERE name_norm <> '' GROUP BY ALL HAVING count(*) FILTER (WHERE src = 1) * count(*) FILTER (WHERE src > 1) <= 20000) SELECT q.id AS s1_id, c.id AS cand_id FROM rec q JOIN rec c USING (country, name_norm) JOIN k USING (country, name_norm) WHERE q.src = 1 AND c.src > 1")
add("block_pruned_keys", lambda v: blocking.oversized(blocking.candidate_postings(v.recs)), f"WITH {_blocks()} SELECT country, ch AS channel, key, size FROM big")

# Features
_g = lambda f, n: lambda v: v.recs.select("id", F.size(sets.ngrams(F.col(f), n)).cast("long").alias("n_grams"), F.array_join(F.sort_array(sets.ngrams(F.col(f), n)), "|").alias("grams"))
for _k in (2, 3):
    add(f"ngrams{_k}", _g("name_norm", _k), f"WITH {REC} SELECT id, len({_gram('name_norm', _k)})::BIGINT AS n_grams, array_to_string(list_sort({_gram('name_norm', _k)}), '|') AS grams FROM rec")
for _name, _cols in {
    "dice_name": ["name_char2", "name_char3"], "jaccard_tokens": ["name_tok_jac", "addr_tok_jac"], "containment": ["name_contain", "addr_contain"],
    "pair_features_name": ["name_eq", "name_suf_eq", "name_tok_jac", "name_char2", "name_char3", "name_contain", "name_len_diff", "name_tok_diff"],
    "pair_features_addr": ["addr_missing", "addr_eq", "addr_tok_jac", "addr_char2", "addr_char3", "addr_contain", "addr_len_diff"],
    "pair_features_numeric": ["num_overlap", "num_overlap_ratio", "first_num_match", "last_num_match", "ch_count"],
    "model_vector": list(MODEL),
}.items():
    add(_name, lambda v, c=_cols: v.feats.select("s1_id", "cand_id", *rounded(*c)), f"WITH {FEAT} SELECT s1_id, cand_id, {', '.join(_r(c, c) for c in _cols)} FROM feat")
_RV = f"WITH {REC}, tk AS (SELECT id, unnest({_toks('name_norm_suf')}) AS token FROM rec), rv AS (SELECT token, count(*) AS df FROM tk GROUP BY token HAVING count(*) BETWEEN 3 AND 4000)"
add("rare_vocab", lambda v: features.rare_vocabulary(v.recs), f"{_RV} SELECT token, df FROM rv")
add("rare_shared", lambda v: features.shared_rare(v.edges.select("s1_id", "cand_id"), v.recs, features.rare_vocabulary(v.recs)), f"WITH {EDGES}, tk AS (SELECT id, unnest({_toks('name_norm_suf')}) AS token FROM rec), rv AS (SELECT token FROM tk GROUP BY token HAVING count(*) BETWEEN 3 AND 4000), own AS (SELECT id, list(DISTINCT token) AS t FROM tk SEMI JOIN rv USING (token) GROUP BY id) SELECT s1_id, cand_id, coalesce(len(list_intersect(a.t, b.t)), 0)::BIGINT AS rare_shared FROM edges LEFT JOIN own a ON a.id = s1_id LEFT JOIN own b ON b.id = cand_id")

# Rules
add("rule_scores", lambda v: v.scored.select("s1_id", "cand_id", *rounded("conf"), "tier"), f"WITH {SCORED} SELECT s1_id, cand_id, {_r('conf', 'conf')}, tier FROM scored")
add("rule_tier_counts", lambda v: v.scored.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("conf")), f"WITH {SCORED} SELECT tier, count(*) AS n, {_r('avg(conf)', 'conf')} FROM scored GROUP BY tier")
add("rule_masks", lambda v: rules.unpivoted(v.feats, rules.masks(v.feats), "s1_id", "cand_id").filter("pred").select("s1_id", "cand_id", "rule"), f"WITH {MASKS} SELECT s1_id, cand_id, rule FROM mk WHERE pred")
_P = "(1.0::DOUBLE / (1.0::DOUBLE + exp(-(4.0::DOUBLE * name_tok_jac + 3.0::DOUBLE * addr_tok_jac - 3.0::DOUBLE))))"
_p = lambda: 1.0 / (1.0 + F.exp(-(4.0 * F.col("name_tok_jac") + 3.0 * F.col("addr_tok_jac") - 3.0)))
_ratio = (rules.TEST_PRIOR / (1 - rules.TEST_PRIOR)) / (rules.TRAIN_PRIOR / (1 - rules.TRAIN_PRIOR))
_odds = f"({_P} / greatest(1.0::DOUBLE - {_P}, 1e-7::DOUBLE) * {_ratio!r}::DOUBLE)"
add("prior_shift", lambda v: v.feats.select("s1_id", "cand_id", F.round(rules.prior_shift(_p()), 6).alias("p")), f"WITH {FEAT} SELECT s1_id, cand_id, round({_odds} / (1.0::DOUBLE + {_odds}), 6) AS p FROM feat")
add("hybrid_conf", lambda v: rules.score(v.feats).select("s1_id", "cand_id", F.round(rules.hybrid(_p(), F.col("conf"), F.col("tier")), 6).alias("conf")), f"WITH {SCORED} SELECT s1_id, cand_id, round(CASE WHEN tier > 0 THEN sqrt({_P}) * sqrt(conf) ELSE 0.0::DOUBLE END, 6) AS conf FROM scored JOIN feat USING (s1_id, cand_id)")

# Selection
add("baseline_b0", lambda v: v.feats.filter(F.lit(False)).select("s1_id", "cand_id"), f"WITH {FEAT} SELECT s1_id, cand_id FROM feat WHERE false")
add("baseline_b1", lambda v: v.feats.filter("name_eq > 0").select("s1_id", "cand_id"), f"WITH {FEAT} SELECT s1_id, cand_id FROM feat WHERE name_eq > 0")
add("baseline_b2", lambda v: v.feats.filter("name_eq > 0 AND num_overlap >= 1").select("s1_id", "cand_id"), f"WITH {FEAT} SELECT s1_id, cand_id FROM feat WHERE name_eq > 0 AND num_overlap >= 1")
add("baseline_b3", lambda v: v.feats.filter("(name_tok_jac >= 0.6D OR name_eq > 0) AND addr_tok_jac >= 0.5D").select("s1_id", "cand_id"), f"WITH {FEAT} SELECT s1_id, cand_id FROM feat WHERE (name_tok_jac >= 0.6::DOUBLE OR name_eq > 0) AND addr_tok_jac >= 0.5::DOUBLE")
_pairs = lambda df: df.select("s1_id", "cand_id")
add("policy_tier", lambda v: _pairs(select.tiered(v.scored)), f"WITH {SCORED} SELECT s1_id, cand_id FROM scored WHERE tier IN (1, 2)")
add("policy_a", lambda v: _pairs(select.policy_a(v.scored)), f"WITH {SCORED} SELECT s1_id, cand_id FROM scored WHERE conf >= 0.75::DOUBLE")
add("policy_b", lambda v: _pairs(select.policy_b(v.scored, t3=0.65)), f"WITH {SCORED} SELECT s1_id, cand_id FROM scored WHERE (tier = 1 AND conf >= 0.88::DOUBLE) OR (tier = 2 AND conf >= 0.75::DOUBLE) OR (tier = 3 AND conf >= 0.65::DOUBLE)")
add("policy_c", lambda v: _pairs(select.policy_c(v.scored)), f"WITH {SCORED}, {_POLICY_C} SELECT s1_id, cand_id FROM pred")
add("policy_d", lambda v: _pairs(select.policy_d(v.scored)), f"WITH {SCORED}, x AS (SELECT *, count(*) FILTER (WHERE tier = 1 AND conf >= 0.88::DOUBLE) OVER (PARTITION BY s1_id) AS n1 FROM scored), y AS (SELECT *, (tier = 2 AND conf >= CASE WHEN n1 > 0 THEN 0.75::DOUBLE ELSE 0.82::DOUBLE END) AS second FROM x) SELECT s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, second ORDER BY conf DESC, cand_id) AS r FROM y) WHERE (tier = 1 AND conf >= 0.88::DOUBLE) OR (second AND r + n1 <= 11)")
add("policy_sweep", lambda v: select.sweep(v.scored).groupBy("anchor", "delta").agg(F.count("*").alias("n"), F.count_distinct("s1_id").alias("n_s1")), f"WITH {SCORED}, g AS (SELECT a AS anchor, d AS delta FROM unnest([0.82, 0.85, 0.88, 0.90]::DOUBLE[]) t(a), unnest([0.10, 0.12, 0.15]::DOUBLE[]) u(d)), r AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY conf DESC, cand_id) AS r, max(conf) OVER (PARTITION BY s1_id) AS top FROM scored) SELECT anchor, delta, count(*) AS n, count(DISTINCT s1_id) AS n_s1 FROM r, g WHERE r <= 11 AND top >= anchor AND (r = 1 OR (tier IN (1, 2) AND conf >= greatest(0.72::DOUBLE, top - delta))) GROUP BY ALL")
_OWN = "own AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY conf DESC, s1_id) = 1), one AS (SELECT s1_id, cand_id, conf FROM own QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY conf DESC, cand_id) <= 11)"
add("fast_baseline_pairs", lambda v: select.one_pass(v.edges), f"WITH {EDGES}, {_OWN} SELECT s1_id, cand_id, conf FROM one")
_CELL = "coalesce(string_agg({0}, ',' ORDER BY {0}), '')"
add("fast_baseline_matches", lambda v: baseline.baseline(v.recs)[0], f"WITH {EDGES}, {_OWN}, {S1} SELECT s1.s1_id AS source1_entity_id, {_CELL.format('cand_id')} AS matched_entity_ids FROM s1 LEFT JOIN one USING (s1_id) GROUP BY 1")
add("fast_baseline_candidates", lambda v: baseline.baseline(v.recs)[1], f"WITH {EDGES}, {_OWN}, {S1}, k AS (SELECT s1_id, cand_id FROM edges QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY conf DESC, cand_id) <= 50 UNION SELECT s1_id, cand_id FROM one) SELECT s1.s1_id AS source1_entity_id, {_CELL.format('cand_id')} AS candidate_entity_ids FROM s1 LEFT JOIN k USING (s1_id) GROUP BY 1")
add("candidate_cap50", lambda v: select.top_candidates(v.scored).select("s1_id", "cand_id"), f"WITH {SCORED} SELECT s1_id, cand_id FROM scored QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY conf DESC, cand_id) <= 50")
_GREEDY = """e AS (SELECT row_number() OVER (ORDER BY conf DESC, s1_id, cand_id) AS i, s1_id, cand_id FROM {0} WHERE conf >= {1}::DOUBLE),
  walk(i, s1_id, cand_id, ok, cs, ss) AS (SELECT 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, false, []::VARCHAR[], []::VARCHAR[]
    UNION ALL SELECT e.i, e.s1_id, e.cand_id, (NOT list_contains(cs, e.cand_id) AND len(list_filter(ss, lambda x: x = e.s1_id)) < {2}),
      CASE WHEN NOT list_contains(cs, e.cand_id) AND len(list_filter(ss, lambda x: x = e.s1_id)) < {2} THEN list_append(cs, e.cand_id) ELSE cs END,
      CASE WHEN NOT list_contains(cs, e.cand_id) AND len(list_filter(ss, lambda x: x = e.s1_id)) < {2} THEN list_append(ss, e.s1_id) ELSE ss END
    FROM walk w JOIN e ON e.i = w.i + 1)"""
add("assign_disjoint", lambda v: _pairs(select.assign(v.edges, 0.88)), f"WITH RECURSIVE {EDGES}, {_GREEDY.format('edges', 0.88, 11)} SELECT s1_id, cand_id FROM walk WHERE ok")
add("assign_scored_85", lambda v: _pairs(select.assign(v.scored, 0.85)), f"WITH RECURSIVE {SCORED}, {_GREEDY.format('scored', 0.85, 11)} SELECT s1_id, cand_id FROM walk WHERE ok")
add("assign_scored", lambda v: _pairs(select.assign(v.scored)), f"WITH RECURSIVE {SCORED}, {_GREEDY.format('scored', 0.88, 11)} SELECT s1_id, cand_id FROM walk WHERE ok")

# Metrics
_es = lambda v: metrics.entity_scores(select.policy_c(v.scored), v.truth, v.s1)
add("entity_f05", lambda v: _es(v).select("s1_id", "tp", "n_pred", "n_true", *rounded("f05")), f"WITH {SCORES} SELECT s1_id, tp, n_pred, n_true, {_r('f05', 'f05')} FROM sc")
add("macro_micro_f05", lambda v: metrics.summary(_es(v)), f"WITH {SCORES}, a AS (SELECT count(*) AS n_entities, sum(tp)::BIGINT AS tp, (sum(n_pred) - sum(tp))::BIGINT AS fp, (sum(n_true) - sum(tp))::BIGINT AS fn, {_r('avg(f05)', 'macro_f05')}, {_r('stddev_samp(f05)', 'std_f05')} FROM sc), p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS r FROM a) SELECT n_entities, tp, fp, fn, macro_f05, std_f05, {_r('p', 'micro_precision')}, {_r('r', 'micro_recall')}, round(CASE WHEN 0.25 * p + r > 0 THEN 1.25::DOUBLE * p * r / (0.25::DOUBLE * p + r) ELSE 0.0::DOUBLE END, 6) AS micro_f05 FROM p")
_K = "CASE WHEN n_true = 0 THEN 'k0' WHEN n_true = 1 THEN 'k1' WHEN n_true <= 3 THEN 'k2_3' WHEN n_true <= 5 THEN 'k4_5' ELSE 'k6+' END"
add("f05_slices", lambda v: metrics.slices(_es(v), v.s1), f"WITH {SCORES} SELECT slice, count(*) AS n_entities, sum(tp)::BIGINT AS tp, {_r('avg(f05)', 'macro_f05')} FROM (SELECT 'all' AS slice, * FROM sc UNION ALL SELECT country, * FROM sc UNION ALL SELECT {_K}, * FROM sc) GROUP BY slice")
add("rule_f05_covered", lambda v: metrics.rule_scores(rules.unpivoted(v.labelled, rules.masks(v.labelled), "s1_id", "label")), _RC := f"WITH {MASKS}, ec AS (SELECT rule, s1_id, count(*) FILTER (WHERE pred AND label) AS tp, count(*) FILTER (WHERE pred) AS n_pred, count(*) FILTER (WHERE label) AS n_true FROM mk GROUP BY ALL HAVING count(*) FILTER (WHERE pred OR label) > 0), rs AS (SELECT rule, round(avg({_F05}), 6) AS f05_covered, count(*) AS n_covered, count(*) FILTER (WHERE n_pred > 0) AS n_with_pred, count(*) FILTER (WHERE n_true > 0) AS n_with_true FROM ec GROUP BY rule) SELECT * FROM rs")
add("threshold_probes", lambda v: analytics.probes(v.labelled, rules.masks(v.labelled)), f"WITH {MASKS} SELECT rule, count(*) FILTER (WHERE pred) AS n, round(avg(pred::INT) FILTER (WHERE label), 6) AS pos_frac, round(avg(pred::INT) FILTER (WHERE NOT label), 6) AS neg_frac FROM mk GROUP BY rule")
_AUC = "SELECT {0} round((sum(rk * label::INT) - sum(label::INT) * (sum(label::INT) + 1) / 2.0::DOUBLE) / (sum(label::INT) * (count(*) - sum(label::INT))), 6) AS auc FROM (SELECT *, rank() OVER (PARTITION BY {1} ORDER BY v) + (count(*) OVER (PARTITION BY {1}, v) - 1) / 2.0::DOUBLE AS rk FROM {2}) GROUP BY {1}"
_FS = ["name_tok_jac", "name_char2", "addr_tok_jac", "num_overlap"]
_U = "u AS (" + " UNION ALL ".join(f"SELECT country, label, '{f}' AS feature, {f} AS v FROM lab" for f in _FS) + ")"
_unp = lambda v, *k: v.labelled.select(*k, "label", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in _FS])).alias("x")).select(*k, "label", "x.*")
add("auc_feature", lambda v: metrics.auc(_unp(v), "v", "label", "feature"), f"WITH {LAB}, {_U} {_AUC.format('feature,', 'feature', 'u')}")
add("auc_feature_by_country", lambda v: metrics.auc(_unp(v, "country"), "v", "label", "feature", "country"), f"WITH {LAB}, {_U}, ok AS (SELECT * FROM u WHERE country IN (SELECT country FROM lab GROUP BY country HAVING bool_or(label))) {_AUC.format('feature, country,', 'feature, country', 'ok')} UNION ALL SELECT feature, country, NULL FROM (SELECT DISTINCT feature, country FROM u WHERE country NOT IN (SELECT country FROM lab GROUP BY country HAVING bool_or(label)))")

# Relational primitives
add("semi_join", lambda v: v.recs.select("id", "country", "name_norm").join(v.recs.filter("src = 1").select("country", "name_norm"), ["country", "name_norm"], "left_semi").select("id"), f"WITH {REC} SELECT id FROM rec SEMI JOIN (SELECT country, name_norm FROM rec WHERE src = 1) q USING (country, name_norm)")
add("anti_join", lambda v: v.recs.filter("src > 1").select("id", "country", "name_norm").join(v.recs.filter("src = 1").select("country", "name_norm"), ["country", "name_norm"], "left_anti").select("id"), f"WITH {REC} SELECT id FROM (SELECT * FROM rec WHERE src > 1) ANTI JOIN (SELECT country, name_norm FROM rec WHERE src = 1) q USING (country, name_norm)")
add("left_join_default", lambda v: v.s1.join(v.truth.groupBy("s1_id").agg(F.count("*").alias("k")), "s1_id", "left").select("s1_id", F.coalesce("k", F.lit(0)).alias("k")), f"WITH {REC}, {GT}, {S1} SELECT s1.s1_id, count(matched_id) AS k FROM s1 LEFT JOIN gt USING (s1_id) GROUP BY 1")
add("union_all", lambda v: v.recs.filter("src = 2").select("id").unionByName(v.recs.filter("src = 3").select("id")), f"WITH {ENT} SELECT id FROM ent WHERE src > 1")
add("distinct_subset", lambda v: v.recs.groupBy("country", "name_norm").agg(F.min("id").alias("id")), f"WITH {REC} SELECT country, name_norm, min(id) AS id FROM rec GROUP BY ALL")
add("set_operations", lambda v: v.recs.filter("src = 1").select("country", "name_norm").intersect(v.recs.filter("src = 2").select("country", "name_norm")).exceptAll(v.recs.filter("src = 3").select("country", "name_norm").distinct()), f"WITH {REC} SELECT country, name_norm FROM rec WHERE src = 1 INTERSECT SELECT country, name_norm FROM rec WHERE src = 2 EXCEPT SELECT country, name_norm FROM rec WHERE src = 3")
add("top_k_per_group", lambda v: sampling.head_of_group(v.recs.select("country", "id", "nlen"), "country", [F.desc("nlen"), "id"], 6).select("country", "id", *big("nlen")), f"WITH {REC} SELECT country, id, nlen::BIGINT AS nlen FROM rec QUALIFY row_number() OVER (PARTITION BY country ORDER BY nlen DESC, id) <= 6")
_D = "('0x' || substr(md5('42:' || {0}), 1, 15))::BIGINT"
add("hash_bucket_sample", lambda v: sampling.hash_sample(v.recs.select("id", "country"), "id", 25), f"WITH {ENT} SELECT id, country FROM ent WHERE {_D.format('id')} % 100 < 25")
add("hash_head", lambda v: sampling.hash_head(v.recs.select("id"), "id", 50), f"WITH {ENT} SELECT id FROM ent ORDER BY {_D.format('id')}, id LIMIT 50")
add("stratified_split", lambda v: sampling.stratified(v.s1, v.truth, 0.2), f"WITH {REC}, {GT}, {S1}, k AS (SELECT s1_id, country, {_K} AS bucket FROM (SELECT s1.s1_id, country, count(matched_id) AS n_true FROM s1 LEFT JOIN gt USING (s1_id) GROUP BY ALL)) SELECT s1_id, country, bucket FROM k QUALIFY row_number() OVER (PARTITION BY country, bucket ORDER BY {_D.format('s1_id')}, s1_id) <= greatest(1, round_even(count(*) OVER (PARTITION BY country, bucket) * 0.2::DOUBLE, 0))")
add("stratified_mini", lambda v: sampling.nested(v.s1, v.truth, 0.4, 0.5).select("s1_id"), f"WITH {REC}, {GT}, {S1}, k AS (SELECT s1_id, country, {_K} AS bucket FROM (SELECT s1.s1_id, country, count(matched_id) AS n_true FROM s1 LEFT JOIN gt USING (s1_id) GROUP BY ALL)), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY country, bucket ORDER BY {_D.format('s1_id')}, s1_id) <= greatest(1, round_even(count(*) OVER (PARTITION BY country, bucket) * 0.4::DOUBLE, 0))) SELECT s1_id FROM f QUALIFY row_number() OVER (PARTITION BY country, bucket ORDER BY {_D.format('s1_id').replace('42:', '43:')}, s1_id) <= greatest(1, round_even(count(*) OVER (PARTITION BY country, bucket) * 0.5::DOUBLE, 0))")
add("random_negatives", lambda v: sampling.without_matches(sampling.random_negatives(v.recs), v.truth).select("s1_id", "cand_id", "msrc"), f"WITH {REC}, {GT}, r AS (SELECT id, country, src, row_number() OVER (PARTITION BY country, src ORDER BY {_D.format('id')}, id) AS r FROM rec QUALIFY r <= 62500), n AS (SELECT country, src, count(*) AS n FROM r WHERE src > 1 GROUP BY ALL), p AS (SELECT q.id AS s1_id, c.id AS cand_id, 'S' || c.src AS msrc FROM r q JOIN n USING (country) JOIN r c ON c.country = q.country AND c.src = n.src AND c.r = (q.r - 1) % n.n + 1 WHERE q.src = 1) SELECT s1_id, cand_id, msrc FROM p ANTI JOIN gt ON p.s1_id = gt.s1_id AND p.cand_id = gt.matched_id")

# Analytics
_PAIR = f"{REC}, {GT}, pr AS (SELECT gt.*, q.country AS q_country, q, c FROM gt JOIN rec q ON q.id = s1_id JOIN rec c ON c.id = matched_id)"
_FLAGS = {
    "name_raw_eq": "q.name = c.name", "name_lower_eq": "lower(q.name) = lower(c.name)", "name_norm_eq": "q.name_norm = c.name_norm", "name_norm_suf_eq": "q.name_norm_suf = c.name_norm_suf",
    "addr_raw_eq": "q.addr = c.addr", "addr_lower_eq": "lower(q.addr) = lower(c.addr)", "addr_norm_eq": "q.addr_norm = c.addr_norm", "both_norm_eq": "q.name_norm = c.name_norm AND q.addr_norm = c.addr_norm",
    "ntok_eq": "q.ntok = c.ntok", "atok_eq": "q.atok = c.atok", "addr_missing_any": "q.addr_missing = 1 OR c.addr_missing = 1", "addr_missing_both": "q.addr_missing = 1 AND c.addr_missing = 1", "country_eq": "q.country = c.country",
}
_RATES = "count(*) AS n, " + ", ".join(f"round(avg(({v})::INT), 6) AS {k}" for k, v in _FLAGS.items()) + ", round(avg(abs(q.nlen - c.nlen)), 6) AS nlen_diff_mean, round(quantile_cont(abs(q.nlen - c.nlen), 0.9), 6) AS nlen_diff_p90"
_tp = lambda v: analytics.truth_pairs(v.recs, v.truth)
add("a01_flags", lambda v: analytics.exact_flags(_tp(v)).drop("nlen_diff", "alen_diff", "q_country"), f"WITH {_PAIR} SELECT s1_id, matched_id, msrc, {', '.join(f'({x}) AS {k}' for k, x in _FLAGS.items())} FROM pr")
add("a01_flag_rates", lambda v: analytics.flag_rates(analytics.exact_flags(_tp(v)), "msrc", "q_country"), f"WITH {_PAIR} SELECT msrc, q_country, {_RATES} FROM pr GROUP BY msrc, q_country")
_SEP = f"WITH {LAB}, {_U}, a AS ({_AUC.format('feature,', 'feature', 'u')}) SELECT feature, label, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.9), 6) AS q90, round(quantile_cont(v, 0.99), 6) AS q99, auc FROM u JOIN a USING (feature) GROUP BY feature, label, auc"
add("a01b_separation", lambda v: analytics.separation(v.labelled, _FS), _SEP)
_kind = lambda p, pre, suf: f"CASE {pre} WHEN q.{p} = c.{p} THEN 'exact' WHEN lower(q.{p}) = lower(c.{p}) THEN 'case' WHEN q.{p}_norm = c.{p}_norm THEN 'punct' {suf} WHEN len(list_intersect(q.{p}_toks, c.{p}_toks)) = len(list_distinct(list_concat(q.{p}_toks, c.{p}_toks))) THEN 'order' WHEN len(list_intersect(q.{p}_toks, c.{p}_toks)) = least(len(q.{p}_toks), len(c.{p}_toks)) AND least(len(q.{p}_toks), len(c.{p}_toks)) > 0 THEN 'subtoken' ELSE 'heavy' END"
_KINDS = f"{_PAIR}, kd AS (SELECT s1_id, matched_id, msrc, q_country, {_kind('name', '', chr(87) + 'HEN q.name_norm_suf = c.name_norm_suf THEN ' + chr(39) + 'suffix' + chr(39))} AS name_type, {_kind('addr', 'WHEN q.addr_missing = 1 AND c.addr_missing = 1 THEN ' + chr(39) + 'both_missing' + chr(39) + ' WHEN q.addr_missing = 1 OR c.addr_missing = 1 THEN ' + chr(39) + 'missing' + chr(39), '')} AS addr_type FROM pr)"
add("a02_corruption", lambda v: analytics.corruption(_tp(v)), f"WITH {_KINDS} SELECT * FROM kd")
add("a02_corruption_counts", lambda v: analytics.corruption_counts(analytics.corruption(_tp(v))), f"WITH {_KINDS} SELECT name_type, '*' AS addr_type, count(*) AS n FROM kd GROUP BY name_type UNION ALL SELECT '*', addr_type, count(*) FROM kd GROUP BY addr_type UNION ALL SELECT name_type, addr_type, count(*) FROM kd GROUP BY name_type, addr_type")
add("a03_ambiguity", lambda v: analytics.ambiguity(v.labelled), f"WITH {LAB} SELECT count(*) AS n, count(*) FILTER (WHERE pool_name_eq > 0) AS n_same_name, count(*) FILTER (WHERE pool_name_eq > 0 AND label) AS n_same_name_true, count(*) FILTER (WHERE pool_addr_eq > 0) AS n_same_addr, count(*) FILTER (WHERE pool_addr_eq > 0 AND label) AS n_same_addr_true, count(*) FILTER (WHERE NOT label AND name_tok_jac >= 0.8::DOUBLE AND pool_name_eq = 0) AS n_hard_negative FROM lab")
add("a04_evidence", lambda v: analytics.evidence(v.labelled), f"WITH {LAB} SELECT count(*) AS n, round(avg((name_tok_jac >= 0.5::DOUBLE)::INT), 6) AS gate_name_05, round(avg((addr_tok_jac >= 0.5::DOUBLE)::INT), 6) AS gate_addr_05, round(avg((num_overlap >= 1)::INT), 6) AS gate_num, round(avg((name_tok_jac >= 0.5::DOUBLE OR addr_tok_jac >= 0.5::DOUBLE OR num_overlap >= 1)::INT), 6) AS gate_any, count(*) FILTER (WHERE name_tok_jac < 0.5::DOUBLE AND addr_tok_jac >= 0.5::DOUBLE) AS rescued_addr, count(*) FILTER (WHERE name_tok_jac < 0.5::DOUBLE AND num_overlap >= 1) AS rescued_num FROM lab WHERE label")
add("a05_address", lambda v: analytics.address_structure(v.recs), f"WITH {REC} SELECT country, count(*) AS n, round(avg((len(addr_nums) > 0)::INT), 6) AS with_number, round(avg(len(addr_nums)), 6) AS numbers_mean, round(avg(coalesce(length(addr_nums[1]) = 5, false)::INT), 6) AS first_len5, round(avg(coalesce(length(addr_nums[-1]) = 6, false)::INT), 6) AS last_len6 FROM rec WHERE addr_missing = 0 GROUP BY country")
add("a05_number_agreement", lambda v: analytics.number_agreement(_tp(v)), f"WITH {_PAIR} SELECT q_country, count(*) AS n, round(avg((len(q.addr_nums) > 0 AND len(c.addr_nums) > 0)::INT), 6) AS both_given, round(avg(coalesce(q.addr_nums[1] = c.addr_nums[1], false)::INT), 6) AS first_eq, round(avg(coalesce(q.addr_nums[-1] = c.addr_nums[-1], false)::INT), 6) AS last_eq FROM pr GROUP BY q_country")
add("a06_name_tokens", lambda v: analytics.name_token_stats(v.recs), f"WITH {REC} SELECT country, count(*) AS n, round(avg(ntok), 6) AS ntok_mean, round(median(ntok)::DOUBLE, 6) AS ntok_median, max(ntok)::BIGINT AS ntok_max, round(avg((ntok <> len(name_toks))::INT), 6) AS with_repeats FROM rec GROUP BY country")
add("a06_top_tokens", lambda v: analytics.top_tokens(v.recs).select("country", "token", "n", *big("r")), f"WITH {REC}, t AS (SELECT country, unnest(nt) AS token FROM rec) SELECT country, token, count(*) AS n, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, token) AS r FROM t GROUP BY 1, 2 QUALIFY r <= 10")
add("a06_end_tokens", lambda v: analytics.end_tokens(v.recs).select("place", "token", "n", *big("r")), f"WITH {REC}, t AS (SELECT 'first' AS place, nt[1] AS token FROM rec WHERE ntok > 0 UNION ALL SELECT 'last', nt[-1] FROM rec WHERE ntok > 0) SELECT place, token, count(*) AS n, row_number() OVER (PARTITION BY place ORDER BY count(*) DESC, token) AS r FROM t GROUP BY 1, 2 QUALIFY r <= 5")
add("a07_block_partners", lambda v: analytics.block_partners(v.recs), f"WITH {REC}, s AS (SELECT country, name_norm, count(*) AS n FROM rec WHERE src > 1 AND name_norm <> '' GROUP BY ALL), q AS (SELECT country, coalesce(n, 0) AS n FROM (SELECT country, name_norm FROM rec WHERE src = 1) LEFT JOIN s USING (country, name_norm)) SELECT country, count(*) AS queries, round(avg((n = 0)::INT), 6) AS without, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, max(n) AS largest FROM q GROUP BY country")
add("a08_vocabulary_shift", lambda v: analytics.vocabulary_shift(v.recs.filter("src = 1"), v.recs.filter("src > 1")), f"WITH {REC}, a AS (SELECT DISTINCT country, unnest(name_toks) AS token FROM rec WHERE src = 1), b AS (SELECT DISTINCT country, unnest(name_toks) AS token FROM rec WHERE src > 1) SELECT coalesce(a.country, b.country) AS country, count(a.token) AS n_a, count(b.token) AS n_b, count(*) FILTER (WHERE a.token IS NOT NULL AND b.token IS NOT NULL) AS n_both FROM a FULL JOIN b ON a.country = b.country AND a.token = b.token GROUP BY 1")
add("a08_country_sources", lambda v: analytics.country_sources(v.recs), f"WITH {ENT} SELECT country, src::INT AS src, count(*) AS n FROM ent GROUP BY ALL")
add("a09_rule_coverage", lambda v: analytics.rule_coverage(v.labelled, rules.masks(v.labelled)), _RC.replace("SELECT * FROM rs", "SELECT rs.*, recall, neg_rate FROM rs JOIN (SELECT rule, round(avg(pred::INT) FILTER (WHERE label), 6) AS recall, round(avg(pred::INT) FILTER (WHERE NOT label), 6) AS neg_rate FROM mk GROUP BY rule) USING (rule)"))
_BS = "SELECT {1} count(*) AS n_groups, count(*) FILTER (WHERE n = 1) AS singletons, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS largest, count(*) FILTER (WHERE n > 10) AS over_10, max_by(k, (n, k)) AS largest_key FROM (SELECT {1} {0} AS k, count(*) AS n FROM rec WHERE {0} <> '' GROUP BY ALL) {2}"
for _c in ("name_norm", "addr_norm", "addr_num"):
    add(f"a10_blocks_{_c}", lambda v, c=_c: analytics.block_sizes(v.recs, c), f"WITH {REC} {_BS.format(_c, '', '')}")
add("a10_blocks_by_country", lambda v: analytics.block_sizes(v.recs, "name_norm", "country"), f"WITH {REC} {_BS.format('name_norm', 'country,', 'GROUP BY country')}")
_PER = f"{REC}, {GT}, {S1}, per AS (SELECT s1.s1_id, country, count(matched_id) AS k, count(*) FILTER (WHERE msrc = 'S2') AS k2, count(*) FILTER (WHERE msrc = 'S3') AS k3 FROM s1 LEFT JOIN gt USING (s1_id) GROUP BY ALL)"
add("a11_cardinality", lambda v: analytics.cardinality_stats(v.truth, v.s1), f"WITH {_PER} SELECT count(*) AS n, sum(k)::BIGINT AS pairs, round(avg(k), 6) AS mean, max(k) AS largest, count(*) FILTER (WHERE k = 0) AS none, count(*) FILTER (WHERE k = 1) AS one, count(*) FILTER (WHERE k > 1) AS several, count(*) FILTER (WHERE k2 > 0 AND k3 = 0) AS s2_only, count(*) FILTER (WHERE k2 = 0 AND k3 > 0) AS s3_only, count(*) FILTER (WHERE k2 > 0 AND k3 > 0) AS both FROM per")
add("a11_histogram", lambda v: analytics.cardinality_histogram(v.truth, v.recs), f"WITH {_PER} SELECT country, k, count(*) AS n FROM per GROUP BY ALL")
add("a12_cross_source", lambda v: analytics.cross_source(v.truth, v.recs), f"WITH {REC}, {GT}, p AS (SELECT a.s1_id, bool_or(x.name_norm_suf = y.name_norm_suf) AS name, bool_or(x.addr_norm = y.addr_norm AND x.addr_norm <> '') AS addr FROM gt a JOIN gt b USING (s1_id) JOIN rec x ON x.id = a.matched_id JOIN rec y ON y.id = b.matched_id WHERE a.msrc = 'S2' AND b.msrc = 'S3' GROUP BY a.s1_id) SELECT count(*) AS n, count(*) FILTER (WHERE name) AS name_agrees, count(*) FILTER (WHERE addr) AS addr_agrees, count(*) FILTER (WHERE name OR addr) AS either FROM p")
add("a13_id_overlap", lambda v: analytics.overlap_counts(v.truth, v.s1, "s1_id"), f"WITH {REC}, {GT}, {S1} SELECT (SELECT count(DISTINCT s1_id) FROM gt) AS n_a, (SELECT count(*) FROM s1) AS n_b, (SELECT count(DISTINCT s1_id) FROM gt SEMI JOIN s1 USING (s1_id)) AS n_both")
add("a14_table_profile", lambda v: analytics.table_profile(v.recs), f"WITH {REC} SELECT src::INT AS src, count(*) AS n, count(DISTINCT id) AS n_ids, count(DISTINCT country) AS n_countries, round(avg((name = '')::INT), 6) AS name_empty, round(avg((addr = '')::INT), 6) AS addr_empty, round(avg(nlen), 6) AS nlen_mean, round(quantile_cont(nlen, 0.5), 6) AS nlen_p50, round(quantile_cont(nlen, 0.95), 6) AS nlen_p95, round(quantile_cont(alen, 0.5), 6) AS alen_p50, round(quantile_cont(alen, 0.95), 6) AS alen_p95, round(avg(ntok), 6) AS ntok_mean, round(avg(non_a_name), 6) AS name_non_ascii, round(avg(non_a_addr), 6) AS addr_non_ascii FROM rec GROUP BY src")
add("a15_truth_profile", lambda v: analytics.truth_profile(v.truth, v.s1), f"WITH {_PER} SELECT count(*) FILTER (WHERE k = 0) AS zero, count(*) FILTER (WHERE k = 1) AS one, count(*) FILTER (WHERE k > 1) AS several, (SELECT count(DISTINCT matched_id) FROM gt) AS n_matched, (SELECT count(*) FROM (SELECT matched_id FROM gt GROUP BY 1 HAVING count(DISTINCT s1_id) > 1)) AS n_in_several FROM per")
add("a16_scalars", lambda v: analytics.scalars(v.recs, v.truth), f"WITH {REC}, {GT}, c AS (SELECT country, count(*) FILTER (WHERE src = 1) AS q, count(*) FILTER (WHERE src > 1) AS c FROM rec GROUP BY country) SELECT sum(q * c)::BIGINT AS cartesian, sum(q)::BIGINT AS queries, round(1 - (SELECT count(DISTINCT s1_id) FROM gt)::DOUBLE / sum(q)::DOUBLE, 6) AS predict_none FROM c")
_ERR = f"""WITH {SCORES}, t AS (SELECT DISTINCT s1_id, matched_id AS cand_id FROM gt), e AS (SELECT coalesce(p.s1_id, t.s1_id) AS s1_id, coalesce(p.cand_id, t.cand_id) AS cand_id, p.s1_id IS NOT NULL AS isp FROM pred p FULL JOIN t ON p.s1_id = t.s1_id AND p.cand_id = t.cand_id WHERE p.s1_id IS NULL OR t.s1_id IS NULL),
  k AS (SELECT e.s1_id, e.cand_id, CASE WHEN isp AND e.s1_id NOT IN (SELECT s1_id FROM gt) THEN 'singleton_fp' WHEN isp THEN 'fp' WHEN c.s1_id IS NOT NULL THEN 'fn_retrieved' ELSE 'fn_missed' END AS kind FROM e LEFT JOIN cand c ON e.s1_id = c.s1_id AND e.cand_id = c.cand_id) SELECT kind, s1_id, cand_id FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY s1_id, cand_id) <= 10"""
add("a17_error_samples", lambda v: analytics.error_samples(select.policy_c(v.scored), v.truth, v.cands), _ERR)
add("a18_prediction_stats", lambda v: analytics.prediction_stats(select.policy_c(v.scored), v.s1), f"WITH {SCORES} SELECT count(DISTINCT s1_id) AS n_predicted, count(*) AS n_pairs, round(count(*)::DOUBLE / (SELECT count(*) FROM s1), 6) AS mean_pairs FROM pred")

# Validation, over a result frame with planted faults
_BAD = "bad AS (SELECT s1_id AS a, CASE WHEN i % 7 = 0 THEN 'S1-5,S2-1' WHEN i % 7 = 1 THEN 'S2-1,S2-1' WHEN i % 7 = 2 THEN 'X-1,S3-2' WHEN i % 7 = 3 THEN '' ELSE 'S2-1,S3-2' END AS b FROM (SELECT s1_id, substr(s1_id, 4)::BIGINT AS i FROM s1) WHERE i % 11 <> 0 UNION ALL SELECT 'S1-x', 'S2-1' UNION ALL SELECT 'S1-3', 'S2-1'), items AS (SELECT a, list_filter(string_split(b, ','), lambda x: x <> '') AS l FROM bad)"


def _bad(v: View) -> DataFrame:
    i = F.substring("s1_id", 4, 20).cast("long")
    b = F.when(i % 7 == 0, "S1-5,S2-1").when(i % 7 == 1, "S2-1,S2-1").when(i % 7 == 2, "X-1,S3-2").when(i % 7 == 3, "").otherwise("S2-1,S3-2")
    more = v.spark.range(2).select(F.when(F.col("id") == 0, "S1-x").otherwise("S1-3").alias("source1_entity_id"), F.lit("S2-1").alias("matched_entity_ids"))
    return v.s1.filter(i % 11 != 0).select(F.col("s1_id").alias("source1_entity_id"), b.alias("matched_entity_ids")).unionByName(more)


_V = f"WITH {REC}, {S1}, {_BAD} "
add("v03_dup_rows", lambda v: validate.duplicate_rows(_bad(v)), _V + "SELECT a AS s1_id, count(*) AS n FROM items GROUP BY a HAVING count(*) > 1")
add("v04_dup_ids", lambda v: validate.duplicate_ids(_bad(v)), _V + "SELECT a AS s1_id FROM items WHERE len(l) <> len(list_distinct(l))")
add("v05_self_matches", lambda v: validate.self_matches(_bad(v)), _V + "SELECT a AS s1_id FROM items WHERE len(list_filter(l, lambda x: starts_with(x, 'S1-'))) > 0")
add("v06_wrong_prefix", lambda v: validate.wrong_prefix(_bad(v)), _V + "SELECT a AS s1_id FROM items WHERE len(list_filter(l, lambda x: NOT regexp_matches(x, '^S[123]-'))) > 0")
add("v07_unknown_ids", lambda v: validate.unknown_ids(_bad(v), v.recs.filter("src > 1").select("id")), _V + "SELECT a AS s1_id, x AS cand_id FROM (SELECT a, unnest(l) AS x FROM items) WHERE x NOT IN (SELECT id FROM rec WHERE src > 1)")
add("v08_missing_rows", lambda v: validate.missing_rows(_bad(v), v.s1), _V + "SELECT s1_id FROM s1 WHERE s1_id NOT IN (SELECT a FROM items)")
add("v08_unexpected_rows", lambda v: validate.unexpected_rows(_bad(v), v.s1), _V + "SELECT a AS s1_id FROM items WHERE a NOT IN (SELECT s1_id FROM s1)")
add("v09_subset", lambda v: validate.outside_candidates(_bad(v), baseline.baseline(v.recs)[1]), f"WITH {EDGES}, {S1}, {_OWN}, {_BAD}, k AS (SELECT s1_id, cand_id FROM edges QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY conf DESC, cand_id) <= 50 UNION SELECT s1_id, cand_id FROM one), m AS (SELECT s1_id, list(cand_id) AS c FROM k GROUP BY s1_id) SELECT a AS s1_id FROM items LEFT JOIN m ON a = s1_id WHERE len(list_filter(l, lambda x: NOT list_contains(coalesce(c, []::VARCHAR[]), x))) > 0")


def _gbt(v: View) -> DataFrame:
    from entwine.operators import model

    lab = cut(v.labelled.withColumn("label", F.col("label").cast("int")))
    held = sampling.hash_sample(v.s1, "s1_id", 20)
    fit, rest = model.split_by_entity(lab, held)
    scored = rules.score(model.predict(model.train(fit), rest))
    return scored.select("s1_id", "cand_id", "prob", rules.hybrid(F.col("prob"), F.col("conf"), F.col("tier")).alias("hybrid"))


add("gbt_scores", _gbt)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import entwine.pool_queries  # noqa: F401  # registers its queries here

    return {name: (lambda spark, sf_dir, f=plan: f(View(spark, sf_dir))) for name, plan in Q.items()}


def oracle_sql() -> dict[str, str]:
    import entwine.pool_queries  # noqa: F401

    return dict(SQL)
