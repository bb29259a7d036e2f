"""The registered queries: each operator over its whole tables, and the SQL that gives the same rows.

Results are made comparable across engines here and only here: lists are joined, dates are text,
decimals are doubles and doubles are rounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldleaf.functions import kernels as K
from goldleaf.functions import vocab
from goldleaf.model.registry import PERSON
from goldleaf.operators import blocking, clustering, fallback, gate, governance, household, ledger, quality, queue, reads, rules, scoring, shred, store, survive
from goldleaf.operators.folder import Folder
from goldleaf.sources import landing
from goldleaf.sources.extract import policy_extract
from goldleaf.sources.mapping import EXTRACT_MAPPING, load_mapping
from goldleaf.streaming import ingest
from goldleaf.tables import Scratch, read_table, shared_dir, small_methods, stored

from . import jobs, operations
from . import oracle as O

MAPPING = load_mapping(EXTRACT_MAPPING)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *parts: str, plain: bool = False) -> Callable[[Query], Query]:
    """Register a query under its own name; ``plain`` SQL stands alone, other SQL follows the shared CTEs."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql if plain else O.sql(sql, *parts)
        return f

    return register


# -- shared inputs


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred.shred_parties(policy_extract(spark, sf_dir), MAPPING)


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed parties, stored: every query reads them several times."""
    return stored(shred.collapse_parties(occurrences(spark, sf_dir)), "parties")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = parties(spark, sf_dir)
    return scoring.score_pairs(blocking.block_pairs(people), people)


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.decide(scoring.grey_decisions(scored(spark, sf_dir)))


def clustered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    people = parties(spark, sf_dir)
    matched = scoring.decide(scoring.grey_decisions(scoring.score_pairs(blocking.block_pairs(people), people))).where("final_decision = 'MATCH'")
    return people, clustering.cluster(people, matched)


def policy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_id, policy_id, role, stated_relationship, with the policy's normalised number as its id."""
    return shred.shred_relationships(occurrences(spark, sf_dir)).withColumnRenamed("policy_number_normalized", "policy_id")


def _iso(*names: str) -> list:
    return [F.col(n).cast("string").alias(n) for n in names]


def _joined(*names: str) -> list:
    return [F.array_join(n, ",").alias(n) for n in names]


# -- scans and kernels


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 150000 AND o_orderpriority LIKE '%U%' AND o_custkey IS NOT NULL", plain=True)
def scan_projection_filter(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders")
    return rows.where(F.col("o_orderstatus").isin("F", "P") & F.col("o_totalprice").between(1000, 150000) & F.contains("o_orderpriority", F.lit("U")) & F.col("o_custkey").isNotNull()).select("o_orderkey", "o_orderpriority")


@query("SELECT * FROM raw")
def policy_extract_rows(spark, sf_dir):
    return policy_extract(spark, sf_dir)


def _names(sql: str) -> str:
    return f"SELECT source_record_id, {sql} FROM raw"


@query(_names(f"{O.norm('OwnerName')} AS normalized, {O.full_name('OwnerName')} AS full_name, {O.affix('OwnerName', O.PREFIX)} AS prefix, {O.affix('OwnerName', O.SUFFIX)} AS suffix"))
def normalize_names(spark, sf_dir):
    x = F.col("OwnerName")
    normal = K.normalize_text(x)
    return policy_extract(spark, sf_dir).select("source_record_id", normal.alias("normalized"), K.normalize_full_name(x).alias("full_name"), K.name_prefix(normal).alias("prefix"), K.name_suffix(normal).alias("suffix"))


@query("SELECT person_id, array_to_string(name_tokens, ',') AS name_tokens, name_sorted_key, name_initials FROM parties")
def name_keys(spark, sf_dir):
    return parties(spark, sf_dir).select("person_id", *_joined("name_tokens"), "name_sorted_key", "name_initials")


@query(f"SELECT doc_id, {O.phonetic(O.full_name('text'))} AS name_phonetic_key FROM documents", plain=False)
def name_phonetic_key(spark, sf_dir):
    name = K.normalize_full_name(F.col("text"))
    return read_table(spark, sf_dir, "documents").select("doc_id", K.phonetic_key(name).alias("name_phonetic_key"))


@query("SELECT person_id, party_type FROM parties")
def party_type(spark, sf_dir):
    return parties(spark, sf_dir).select("person_id", "party_type")


@query(f"SELECT source_record_id, {O.email('OwnerEmail')} AS email, {O.phone('OwnerPhone', '44')} AS phone FROM raw")
def normalize_contacts(spark, sf_dir):
    return policy_extract(spark, sf_dir).select("source_record_id", K.normalize_email(F.col("OwnerEmail")).alias("email"), K.normalize_phone(F.col("OwnerPhone"), "44").alias("phone"))


@query(f"SELECT source_record_id, {O.policy_number('PolicyNumber')} AS policy_number, {O.address('OwnerAddress1', 'OwnerAddress2')} AS address, {O.address_key(O.address('OwnerAddress1', 'OwnerAddress2'), 'OwnerPostcode')} AS address_key FROM raw")
def policy_number_and_address(spark, sf_dir):
    address = K.normalize_address(F.col("OwnerAddress1"), F.col("OwnerAddress2"))
    return policy_extract(spark, sf_dir).select("source_record_id", K.normalize_policy_number(F.col("PolicyNumber")).alias("policy_number"), address.alias("address"), K.address_key(address, F.col("OwnerPostcode")).alias("address_key"))


_STATUS = {"IN_FORCE": "INFORCE", "MATURED": "MATURED"}


@query(f"""SELECT source_record_id, {O.enum('Status', _STATUS)} AS status, CAST({O.date('EffectiveDate')} AS VARCHAR) AS effective, CAST({O.date('OwnerDOB')} AS VARCHAR) AS born,
  CAST({O.money('AnnualPremium')} AS DOUBLE) AS premium, CAST({O.money('SumAssured')} AS DOUBLE) AS assured, {O.integer('PolicyTerm')} AS term, upper(trim(PremiumFrequency)) IN ('Y', 'YES', 'T', 'TRUE', '1', 'X') AS flag FROM raw""")  # fmt: skip
def typed_values(spark, sf_dir):
    c = F.col
    date = lambda n: K.parse_date(c(n), MAPPING.date_formats).cast("string")
    return policy_extract(spark, sf_dir).select(
        "source_record_id", K.normalize_enum(c("Status"), _STATUS).alias("status"), date("EffectiveDate").alias("effective"), date("OwnerDOB").alias("born"), K.parse_money(c("AnnualPremium")).cast("double").alias("premium"),
        K.parse_money(c("SumAssured")).cast("double").alias("assured"), K.parse_integer(c("PolicyTerm")).alias("term"), K.parse_boolean(c("PremiumFrequency")).alias("flag"),
    )


@query("SELECT person_id, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '***' END AS {c}" for c in ("full_name", "email_normalized", "phone_e164", "address_line1")) + ", postal_code, gender FROM parties")
def mask_pii(spark, sf_dir):
    return reads.mask(parties(spark, sf_dir), PERSON).select("person_id", "full_name", "email_normalized", "phone_e164", "address_line1", "postal_code", "gender")


@query(f"SELECT person_id, role, {O.case('role', vocab.ROLE_GROUP_OF, 'NULL')} AS role_group, {O.case('role', {'OWNER': 'Yes'}, 'NULL')} AS owns FROM occ")
def role_groups(spark, sf_dir):
    rows = occurrences(spark, sf_dir).withColumn("person_id", shred.source_identity())
    return rows.select("person_id", "role", K.role_group(F.col("role")).alias("role_group"), F.when(F.col("role") == "OWNER", "Yes").alias("owns"))


_LABEL = lambda way: O.case("association_type", {k: v[way] for k, v in vocab.RELATION_LABELS.items()}, "lower(replace(association_type, '_', ' '))")


@query(f"SELECT from_id AS person_id, to_id AS other_id, {_LABEL(0)} AS label FROM assoc UNION ALL SELECT to_id, from_id, {_LABEL(1)} FROM assoc", O.HOUSEHOLDS)
def relation_labels(spark, sf_dir):
    found = _associations(spark, sf_dir)[1]
    return household.relations_of(found).select("person_id", "other_id", K.relation_label(F.col("association_type"), F.col("outgoing")).alias("label"))


@query(f"SELECT person_id, {O.case('upper(given_name_derived)', vocab.CANONICAL_GIVEN, 'upper(given_name_derived)')} AS canonical FROM parties")
def canonical_given_names(spark, sf_dir):
    return parties(spark, sf_dir).select("person_id", K.canonical_given(F.col("given_name_derived")).alias("canonical"))


_SHAPE = f"""list_transform(list_filter(regexp_split_to_array(trim(upper(coalesce(full_name, ''))), '\\s+'), lambda t: t <> ''),
  lambda t: CASE WHEN list_contains({O.listed(vocab.PARTICLES)}, t) THEN 'P' WHEN regexp_matches(t, '^\\d+$') THEN 'N' WHEN regexp_matches(t, '^\\pL$') THEN 'I' WHEN regexp_matches(t, '^\\pL+$') THEN 'W' ELSE 'S' END)"""


@query(f"SELECT shape, count(*) AS n FROM (SELECT array_to_string({_SHAPE}, '-') AS shape FROM occ) GROUP BY shape")
def token_shapes(spark, sf_dir):
    return occurrences(spark, sf_dir).groupBy(K.token_shape(F.col("full_name")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(s, 17, 1))::INT % 4 AS INT) + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS id, c_custkey FROM "
       f"(SELECT sha1(unhex('{household.HOUSEHOLD_NAMESPACE.replace('-', '')}') || encode(CAST(c_custkey AS VARCHAR))) AS s, c_custkey FROM customer)", plain=True)  # fmt: skip
def name_based_ids(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select(K.uuid5(household.HOUSEHOLD_NAMESPACE, F.col("c_custkey").cast("string")).alias("id"), "c_custkey")


# -- shredding


@query("SELECT policy_number, policy_number_normalized, product_code, product_line, policy_status, premium_frequency, currency_code, CAST(effective_date AS VARCHAR) AS effective_date, CAST(sum_assured_amount AS DOUBLE) AS sum_assured_amount, CAST(policy_term_years AS BIGINT) AS policy_term_years FROM policies", O.POLICIES)
def shred_policies(spark, sf_dir):
    rows = shred.shred_policies(policy_extract(spark, sf_dir), MAPPING)
    return rows.select("policy_number", "policy_number_normalized", "product_code", "product_line", "policy_status", "premium_frequency", "currency_code", *_iso("effective_date"), F.col("sum_assured_amount").cast("double").alias("sum_assured_amount"), F.col("policy_term_years").cast("bigint").alias("policy_term_years"))


_OCC = ("person_id", "role", "source_record_id", "full_name", "full_name_normalized", "gender", "email_normalized", "phone_e164", "address_normalized", "address_key", "party_type", "given_name_derived", "surname_derived", "name_parse_confidence", "name_parse_method", "stated_relationship")


@query(f"SELECT {', '.join(_OCC)}, CAST(date_of_birth AS VARCHAR) AS date_of_birth FROM occ")
def shred_parties(spark, sf_dir):
    return occurrences(spark, sf_dir).withColumn("person_id", shred.source_identity()).select(*_OCC, *_iso("date_of_birth"))


_COLLAPSED = ("person_id", "full_name", "name_sorted_key", "name_phonetic_key", "gender", "email_address", "email_normalized", "phone_raw", "phone_e164", "city", "postal_code", "occupation", "address_key", "party_type", "given_name_derived", "surname_derived")


@query(f"SELECT {', '.join(_COLLAPSED)}, CAST(date_of_birth AS VARCHAR) AS date_of_birth FROM parties")
def collapse_parties(spark, sf_dir):
    return shred.collapse_parties(occurrences(spark, sf_dir)).select(*_COLLAPSED, *_iso("date_of_birth"))


@query("SELECT 'PARTY_POLICY' AS edge_kind, person_id, policy_number_normalized AS policy_id, role, stated_relationship, full_name_normalized FROM occ")
def shred_edges(spark, sf_dir):
    return policy_edges(spark, sf_dir).select("edge_kind", "person_id", "policy_id", "role", "stated_relationship", "full_name_normalized")


# -- landing


@query(f"""SELECT * FROM (
  SELECT CASE WHEN blank > 0.2 * n THEN 'ERROR' ELSE 'WARNING' END AS severity, 'BLANK_POLICY_NUMBER' AS code, 'PolicyNumber' AS "column", blank AS row_count FROM (SELECT count(*) AS n, count(*) FILTER (coalesce(length(trim(PolicyNumber)), 0) = 0) AS blank FROM raw) WHERE blank > 0
  UNION ALL SELECT 'WARNING', 'DUPLICATE_POLICY_NUMBERS', 'PolicyNumber', r FROM (SELECT count(*) - count(DISTINCT {O.policy_number('PolicyNumber')}) AS r FROM raw) WHERE r > 0
  {"".join(f"UNION ALL SELECT 'WARNING', 'SPARSE_PARTY_BLOCK', '{c}', n - p FROM (SELECT count(*) AS n, count(*) FILTER (length(trim({c})) > 0) AS p FROM raw) WHERE p > 0 AND p < 0.5 * n " for c in ("OwnerName", "InsuredName", "AgentName"))}
  {"".join(f"UNION ALL SELECT CASE WHEN parsed < 0.5 * there THEN 'ERROR' ELSE 'WARNING' END, 'DATE_FORMAT_MISMATCH', '{c}', there - parsed FROM (SELECT count(*) FILTER (length(trim({c})) > 0) AS there, count({O.date(c)}) AS parsed FROM raw) WHERE parsed < 0.95 * there " for c in ("IssueDate", "EffectiveDate", "OwnerDOB", "InsuredDOB"))})""")  # fmt: skip
def validate_batch_report(spark, sf_dir):
    return landing.validate_batch(policy_extract(spark, sf_dir), MAPPING)


@query(f"SELECT DISTINCT CASE WHEN length({O.policy_number('PolicyNumber')}) > 0 THEN {O.policy_number('PolicyNumber')} END AS source_row_key FROM raw WHERE CAST(substr(source_record_id, 3) AS BIGINT) % 3 <> 0")
def land_dedup(spark, sf_dir):
    """A delivery of which every third policy has landed before, and every fifth comes twice."""
    raw = stored(policy_extract(spark, sf_dir), "delivered")
    number = F.substring("source_record_id", 3, 9).cast("bigint")
    landed = landing.landing_rows(raw.where(number % 3 == 0), MAPPING, "b1", "2024-01-01 00:00:00")
    rows = landing.landing_rows(raw.unionByName(raw.where(number % 5 == 0)), MAPPING, "b1", "2024-01-02 00:00:00")
    return landing.land(landed, rows).select("source_row_key")


@query("SELECT DISTINCT source_record_id AS delivered_id, PolicyNumber, OwnerName FROM raw")
def landed_round_trip(spark, sf_dir):
    """Source-shaped rows read back from landed payloads."""
    raw = stored(policy_extract(spark, sf_dir), "delivered")
    back = landing.read_batch(landing.landing_rows(raw, MAPPING, "b1", "2024-01-01 00:00:00"), MAPPING, "b1")
    digits = F.regexp_replace("PolicyNumber", "[^0-9]", "").cast("bigint").cast("string")
    return back.select(F.concat(F.lit("R-"), F.lpad(digits, 9, "0")).alias("delivered_id"), "PolicyNumber", "OwnerName")


# -- resolution


@query("SELECT kind, n AS block_size, count(*) AS blocks FROM sizes GROUP BY kind, n")
def block_sizes(spark, sf_dir):
    return blocking.block_sizes(parties(spark, sf_dir)).groupBy("kind", F.col("n").alias("block_size")).agg(F.count(F.lit(1)).alias("blocks"))


@query("SELECT left_id, right_id, blocking_keys FROM pairs")
def block_pairs(spark, sf_dir):
    return blocking.block_pairs(parties(spark, sf_dir))


@query("SELECT kind, count(*) AS blocks, CAST(coalesce(sum(n * (n - 1) // 2) FILTER (n <= 1000), 0) AS BIGINT) AS pairs, count(*) FILTER (n > 1000) AS dropped_blocks, CAST(coalesce(sum(n * (n - 1) // 2) FILTER (n > 1000), 0) AS BIGINT) AS dropped_pairs, max(n) AS largest_block FROM sizes GROUP BY kind")
def blocking_report(spark, sf_dir):
    return blocking.blocking_report(parties(spark, sf_dir))


@query("SELECT p AS parties, p * (p - 1) // 2 AS naive_pairs, c AS candidate_pairs, round(p * (p - 1) // 2 / greatest(c, 1), 6) AS reduction_ratio FROM (SELECT (SELECT count(*) FROM parties) AS p, (SELECT count(*) FROM pairs) AS c)")
def blocking_reduction(spark, sf_dir):
    people = parties(spark, sf_dir)
    return blocking.reduction(people, blocking.block_pairs(people))


_CMP = [f"cmp_{name}" for name, c in scoring.COMPARATORS.items() if c[0] in O.COLLAPSED]


@query("SELECT left_id, right_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _CMP) + " FROM scored", O.SCORED)
def comparators(spark, sf_dir):
    return scored(spark, sf_dir).select("left_id", "right_id", *(F.round(c, 6).alias(c) for c in _CMP))


@query("SELECT left_id, right_id, round(score, 6) AS score, round(evidence_weight, 6) AS evidence_weight, round(corroboration, 6) AS corroboration, vetoed, under_corroborated, zone FROM scored", O.SCORED)
def composite_zone(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return scored(spark, sf_dir).select("left_id", "right_id", r("score"), r("evidence_weight"), r("corroboration"), "vetoed", "under_corroborated", "zone")


@query("SELECT count(*) AS pairs, count(*) FILTER (zone = 'AUTO_MATCH') AS auto_match, count(*) FILTER (zone = 'GREY') AS grey, count(*) FILTER (zone = 'AUTO_REJECT') AS auto_reject, count(*) FILTER (vetoed) AS vetoed, count(*) FILTER (under_corroborated) AS under_corroborated, "
       + ", ".join(f"round(avg(CAST({c} IS NOT NULL AS DOUBLE)), 6) AS coverage_{c[4:]}" for c in _CMP) + " FROM scored", O.SCORED)
def zone_report(spark, sf_dir):
    return scoring.zone_report(scored(spark, sf_dir))


_FEATURES = list(scoring.GREY_WEIGHTS)


@query("SELECT left_id, right_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in _FEATURES) + " FROM featured WHERE zone = 'GREY'", O.SCORED)
def grey_features(spark, sf_dir):
    rows = scoring.grey_features(scored(spark, sf_dir).where("zone = 'GREY'"))
    return rows.select("left_id", "right_id", *(F.round(f, 6).alias(f) for f in _FEATURES))


@query("SELECT left_id, right_id, round(ai_score, 6) AS ai_score, final_decision FROM decided WHERE zone = 'GREY'", O.SCORED)
def grey_decisions(spark, sf_dir):
    return decided(spark, sf_dir).where("zone = 'GREY'").select("left_id", "right_id", F.round("ai_score", 6).alias("ai_score"), "final_decision")


_STEWARD = "length(left_id) % 2 = 0 AND right_id LIKE '%1'"


@query(f"SELECT left_id, right_id, CASE WHEN {_STEWARD} THEN 'NO_MATCH' ELSE final_decision END AS final_decision, CASE WHEN {_STEWARD} THEN 'STEWARD' ELSE decided_by END AS decided_by FROM decided", O.SCORED)
def decide_with_steward(spark, sf_dir):
    people = parties(spark, sf_dir)
    pairs = blocking.block_pairs(people)
    overrides = pairs.where(_STEWARD).select("left_id", "right_id", F.lit("NO_MATCH").alias("decision"))
    return scoring.decide(scoring.grey_decisions(scoring.score_pairs(pairs, people)), overrides).select("left_id", "right_id", "final_decision", "decided_by")


@query("SELECT left_id, right_id, round(score, 6) AS score FROM decided WHERE zone = 'GREY' ORDER BY score DESC, left_id, right_id LIMIT 100", O.SCORED)
def grey_queue(spark, sf_dir):
    """The steward's queue: the hundred most likely undecided pairs."""
    rows = scored(spark, sf_dir).where("zone = 'GREY'")
    return rows.orderBy(F.col("score").desc(), "left_id", "right_id").limit(100).select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("SELECT person_id, master_id FROM clusters", O.SCORED, O.CLUSTERED)
def clusters(spark, sf_dir):
    return clustered(spark, sf_dir)[1]


@query("SELECT master_id, count(*) AS members, count(*) >= 25 AS suspicious FROM clusters GROUP BY master_id", O.SCORED, O.CLUSTERED)
def cluster_sizes(spark, sf_dir):
    return clustering.cluster_sizes(clustered(spark, sf_dir)[1])


@query("""SELECT person_id, coalesce(g.ids[1], 'new') AS golden_id, CASE WHEN len(g.ids) > 1 THEN array_to_string(g.ids[2:], ',') END AS merged_from FROM clusters
  JOIN (SELECT master_id, list_sort(list(DISTINCT 'G-' || person_id) FILTER (person_id LIKE '%3')) AS ids FROM clusters GROUP BY master_id) g USING (master_id)""", O.SCORED, O.CLUSTERED)  # fmt: skip
def golden_ids_merge(spark, sf_dir):
    assignments = clustered(spark, sf_dir)[1]
    known = assignments.where("person_id LIKE '%3'").select("person_id", F.concat(F.lit("G-"), "person_id").alias("golden_id"))
    out = store.golden_ids(assignments, known)
    return out.select("person_id", F.when(F.col("golden_id").startswith("G-"), F.col("golden_id")).otherwise("new").alias("golden_id"), F.array_join("merged_from", ",").alias("merged_from"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 8 = 0 THEN c_custkey ELSE c_custkey - c_custkey % 8 END AS resolved_id, CAST(c_custkey % 8 AS INT) AS hops FROM customer", plain=True)
def resolve_merge_pointer(spark, sf_dir):
    ids = read_table(spark, sf_dir, "customer").select("c_custkey")
    pointers = ids.where("c_custkey % 8 <> 0").select(F.col("c_custkey").alias("golden_id"), (F.col("c_custkey") - 1).alias("merged_into_id"))
    return store.resolve_pointers(ids, pointers, "c_custkey")


# -- survivorship: an order is a contributor to its customer, its priority the source

_TRUST = {"1-URGENT": 0.9, "2-HIGH": 0.7, "3-MEDIUM": 0.7, "5-LOW": 0.2}
_CONTRIB = f"""contrib AS (SELECT CAST(o_custkey AS VARCHAR) AS master_id, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS rid, o_orderpriority AS src, o_orderdate AS ts,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus || CAST(o_orderkey % 4 AS VARCHAR) END AS occupation,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE repeat('x', CAST(o_orderkey % 6 AS INT)) || CAST(o_orderkey % 10 AS VARCHAR) END AS full_name,
  CASE WHEN o_orderkey % 7 = 0 THEN 'orphan' WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'n' || CAST(o_orderkey % 10 AS VARCHAR) END AS full_name_normalized,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE substr(o_orderstatus, 1, 1) END AS gender, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'N' || CAST(o_orderkey % 3 AS VARCHAR) END AS national_id_hash,
  CAST(o_orderdate AS DATE) AS customer_since_date, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 31 = 0 END AS do_not_contact,
  {O.case("o_orderpriority", {k: str(v) for k, v in _TRUST.items()}, "'0.5'")}::DOUBLE AS trust FROM orders),
tied AS (SELECT *, src || chr(31) || rid AS tie FROM contrib)"""


def contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    digit = lambda n: (k % n).cast("string")
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("master_id"),
        F.lpad(k.cast("string"), 9, "0").alias("source_record_id"),
        F.col("o_orderpriority").alias("source_system"),
        F.col("o_orderdate").cast("timestamp").alias("source_timestamp"),
        F.when(k % 5 != 0, F.concat(s, digit(4))).alias("occupation"),
        F.when(k % 7 != 0, F.concat(F.expr("repeat('x', cast(o_orderkey % 6 as int))"), digit(10))).alias("full_name"),
        F.when(k % 7 == 0, "orphan").when(k % 3 != 0, F.concat(F.lit("n"), digit(10))).alias("full_name_normalized"),
        F.when(k % 3 != 0, F.substring(s, 1, 1)).alias("gender"),
        F.when(k % 4 != 0, F.concat(F.lit("N"), digit(3))).alias("national_id_hash"),
        F.col("o_orderdate").cast("date").alias("customer_since_date"),
        F.when(k % 9 != 0, k % 31 == 0).alias("do_not_contact"),
    )


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survive.survive(contributors(spark, sf_dir), PERSON, _TRUST)


_PICK = "arg_max({c}, {o}) FILTER ({c} IS NOT NULL)"


def _survived(column: str, order: str, frame: str = "tied") -> str:
    return f"WITH {_CONTRIB}, ranked AS (SELECT *, row_number() OVER (PARTITION BY master_id ORDER BY {order}) AS place FROM {frame}) SELECT master_id, {_PICK.format(c=column, o='place')} AS {column} FROM ranked GROUP BY master_id"


@query(_survived("occupation", "ts, trust, tie"), plain=True)
def survive_most_recent(spark, sf_dir):
    return golden(spark, sf_dir).select("master_id", "occupation")


@query(_survived("national_id_hash", "trust, ts, tie"), plain=True)
def survive_trusted(spark, sf_dir):
    return golden(spark, sf_dir).select("master_id", "national_id_hash")


@query(_survived("full_name", "coalesce(length(full_name), 0), trust, tie"), plain=True)
def survive_complete(spark, sf_dir):
    return golden(spark, sf_dir).select("master_id", "full_name")


@query(_survived("gender", "votes, trust, tie", "(SELECT *, count(*) OVER (PARTITION BY master_id, gender) AS votes FROM tied)"), plain=True)
def survive_frequent(spark, sf_dir):
    return golden(spark, sf_dir).select("master_id", "gender")


@query(f"WITH {_CONTRIB} SELECT master_id, CAST(min(customer_since_date) AS VARCHAR) AS customer_since_date, bool_or(coalesce(do_not_contact, false)) AS do_not_contact FROM contrib GROUP BY master_id", plain=True)
def survive_min_any_true(spark, sf_dir):
    return golden(spark, sf_dir).select("master_id", *_iso("customer_since_date"), "do_not_contact")


@query(f"""WITH {_CONTRIB}, ranked AS (SELECT *, row_number() OVER (PARTITION BY master_id ORDER BY coalesce(length(full_name), 0), trust, tie) AS place FROM tied WHERE full_name IS NOT NULL)
  SELECT m.master_id, r.full_name, r.full_name_normalized FROM (SELECT DISTINCT master_id FROM tied) m LEFT JOIN (SELECT * FROM ranked QUALIFY place = max(place) OVER (PARTITION BY master_id)) r USING (master_id)""", plain=True)  # fmt: skip
def survive_follow_parent(spark, sf_dir):
    return golden(spark, sf_dir).select("master_id", "full_name", "full_name_normalized")


@query(f"WITH {_CONTRIB} SELECT master_id, CAST(count(*) AS INT) AS source_count, array_to_string(list_sort(list(DISTINCT rid)), ',') AS contributing_records, array_to_string(list_sort(list(DISTINCT src)), ',') AS contributing_sources FROM contrib GROUP BY master_id", plain=True)
def contributing_evidence(spark, sf_dir):
    return golden(spark, sf_dir).select("master_id", "source_count", *_joined("contributing_records", "contributing_sources"))


@query(f"""WITH {_CONTRIB}, ranked AS (SELECT *, row_number() OVER (PARTITION BY master_id ORDER BY ts, trust, tie) AS place FROM tied),
  won AS (SELECT master_id, arg_max(occupation, place) FILTER (occupation IS NOT NULL) AS value_text FROM ranked GROUP BY master_id),
  told AS (SELECT t.*, value_text, lower(trim(occupation)) = lower(trim(value_text)) AS same FROM tied t JOIN won USING (master_id) WHERE occupation IS NOT NULL)
  SELECT master_id, 'occupation' AS attribute_name, 'MOST_RECENT' AS strategy, arg_min(rid, tie) FILTER (same) AS winning_source_record_id, arg_min(src, tie) FILTER (same) AS winning_source_system, any_value(value_text) AS value_text,
  count(DISTINCT occupation) AS candidate_count, least(count(*) FILTER (NOT same), 20) AS rejected FROM told GROUP BY master_id HAVING count(DISTINCT occupation) > 1""", plain=True)  # fmt: skip
def provenance(spark, sf_dir):
    rows = contributors(spark, sf_dir)
    out = survive.provenance(rows, survive.survive(rows, PERSON, _TRUST), PERSON).where("attribute_name = 'occupation'")
    rejected = F.size(F.from_json("rejected_values", "array<struct<value: string, source: string, record: string>>")).cast("bigint")
    return out.withColumn("rejected", rejected).drop("rejected_values")


# -- the store


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    key = F.col("id").cast("bigint")
    return rows.where(key % 10 != 9), rows.withColumn("segment", F.when(key % 7 == 0, F.lit(None)).otherwise(F.col("segment"))).where(key % 13 != 5)


def _history(spark: SparkSession, sf_dir: str) -> store.Versions:
    first, second = _snapshots(spark, sf_dir)
    made = store.write_versions(None, first, "id", ["segment", "nation"], "2024-01-01 00:00:00").history
    return store.write_versions(made, second, "id", ["segment", "nation"], "2024-02-01 00:00:00")


_SCD = """base AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS k, c_mktsegment AS segment, c_custkey % 10 <> 9 AS old, c_custkey % 13 <> 5 AS incoming, c_custkey % 7 = 0 AS changed FROM customer),
history AS (
  SELECT id, segment, 1 AS version, '2024-01-01' AS valid_from, CASE WHEN incoming AND changed THEN '2024-02-01' END AS valid_to, NOT (incoming AND changed) AS is_current, '2024-01-01' AS created FROM base WHERE old
  UNION ALL SELECT id, NULL, 2, '2024-02-01', NULL, true, '2024-01-01' FROM base WHERE old AND incoming AND changed
  UNION ALL SELECT id, CASE WHEN changed THEN NULL ELSE segment END, 1, '2024-02-01', NULL, true, '2024-02-01' FROM base WHERE NOT old AND incoming)"""


@query(f"WITH {_SCD} SELECT * FROM history", plain=True)
def scd2_apply(spark, sf_dir):
    day = lambda c, a=None: F.substring(F.col(c).cast("string"), 1, 10).alias(a or c)
    return _history(spark, sf_dir).history.select("id", "segment", "version", day("valid_from"), day("valid_to"), "is_current", day("created_at", "created"))


@query("SELECT count(*) FILTER (c_custkey % 10 = 9) AS inserted, count(*) FILTER (c_custkey % 10 <> 9 AND c_custkey % 7 = 0) AS versioned, count(*) FILTER (c_custkey % 10 <> 9 AND c_custkey % 7 <> 0) AS unchanged FROM customer WHERE c_custkey % 13 <> 5", plain=True)
def scd2_report(spark, sf_dir):
    return _history(spark, sf_dir).report


@query("SELECT CAST(0 AS BIGINT) AS inserted, CAST(0 AS BIGINT) AS versioned, count(*) AS unchanged FROM customer WHERE c_custkey % 13 <> 5", plain=True)
def scd2_idempotent(spark, sf_dir):
    again = _snapshots(spark, sf_dir)[1]
    return store.write_versions(_history(spark, sf_dir).history, again, "id", ["segment", "nation"], "2024-03-01 00:00:00").report


@query(f"WITH {_SCD} SELECT id, segment, version FROM history WHERE valid_from <= '2024-01-15' AND (valid_to IS NULL OR valid_to > '2024-01-15')", plain=True)
def scd2_as_of(spark, sf_dir):
    return store.as_of(_history(spark, sf_dir).history, "2024-01-15 00:00:00").select("id", "segment", "version")


@query("SELECT CAST(c_custkey AS VARCHAR) AS source_party_key, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS golden_id, c_custkey % 3 = 0 OR c_custkey % 4 <> 1 AS is_active, c_custkey % 3 = 0 AND c_custkey % 5 <> 0 AS moved FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 = 0", plain=True)
def crosswalk_upsert(spark, sf_dir):
    key = F.col("c_custkey")
    rows = read_table(spark, sf_dir, "customer").select(F.lit("S").alias("source_system"), F.lit("K").alias("source_key_kind"), key.cast("string").alias("source_party_key"), key)
    seen = F.lit("2024-01-01").cast("timestamp")
    current = rows.where(key % 5 != 0).select("source_system", "source_key_kind", "source_party_key", F.lit("old").alias("golden_id"), (key % 4 != 1).alias("is_active"), seen.alias("first_seen"), seen.alias("last_seen"))
    incoming = rows.where(key % 3 == 0).withColumn("golden_id", F.lit("new"))
    return store.upsert_crosswalk(current, incoming, "2024-02-01 00:00:00").select("source_party_key", "golden_id", "is_active", "moved")


@query("SELECT count(*) AS edges, count(DISTINCT person_id || '|' || policy_number_normalized || '|' || role) AS ids FROM occ")
def edge_ids(spark, sf_dir):
    edges = store.edge_ids(shred.shred_relationships(occurrences(spark, sf_dir)))
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("relationship_id").alias("ids"))


@query("SELECT unnest(['validity_order', 'current_is_open', 'one_current_version', 'target_is_policy_or_party', 'kind_fits_target', 'role_present', 'no_self_edge', 'pair_is_ordered', 'score_in_range', 'ai_only_in_grey']) AS \"constraint\", CAST(0 AS BIGINT) AS violations", plain=True)
def constraint_violations(spark, sf_dir):
    people = parties(spark, sf_dir)
    versions = store.write_versions(None, people.select("person_id", "full_name"), "person_id", ["full_name"], "2024-01-01 00:00:00").history
    found = _associations(spark, sf_dir)[1]
    null = F.lit(None).cast("string")
    edges = policy_edges(spark, sf_dir).select("edge_kind", F.col("person_id").alias("from_person_id"), F.col("policy_id").alias("to_policy_id"), null.alias("to_person_id"), "role")
    edges = edges.unionByName(household.party_edges(found).select(*edges.columns))
    judged = scoring.decide(scoring.grey_decisions(scoring.score_pairs(blocking.block_pairs(people), people)))
    return store.violations(versions, edges, judged)


@query("SELECT entity, CAST(0 AS BIGINT) AS inserted, CAST(0 AS BIGINT) AS versioned, true AS all_unchanged, (SELECT count(*) FROM policies) AS policies, 'REDELIVERED' AS delivered_again FROM (SELECT unnest(['person', 'policy', 'relationship']) AS entity)", O.POLICIES)
def store_second_run(spark, sf_dir):
    """Deliver the extract, process it, deliver it again, process the landed batch again: what the second run changes."""
    folder = Folder(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    with Scratch(spark) as scratch:
        with small_methods(spark):
            raw = stored(policy_extract(spark, sf_dir), "delivered")
            jobs.deliver(folder, raw, MAPPING, "b1", "2024-01-01 00:00:00")
        jobs.work(folder, MAPPING, "2024-01-02 00:00:00")
        again = jobs.deliver(folder, raw.repartition(3), MAPPING, "b2", "2024-01-03 00:00:00").where("severity = 'ERROR'").agg(F.max("code").alias("delivered_again"))
        jobs.requeue(folder, "b1", "2024-01-03 00:00:00")
        jobs.work(folder, MAPPING, "2024-01-04 00:00:00")
        view = folder.view()
        runs = view.table("runs")
        first = runs.where("ended_at < '2024-01-03'").select("entity", F.col("inserted").alias("made"))
        policies = view.table("policy").agg(F.count(F.lit(1)).alias("n"))
        out = runs.where("ended_at > '2024-01-03'").join(first, "entity").crossJoin(policies).crossJoin(again)
        out = out.select("entity", "inserted", "versioned", (F.col("unchanged") == F.col("made")).alias("all_unchanged"), F.col("n").alias("policies"), "delivered_again")
        out = scratch.result(out, "second-run", narrow=False)
    folder.delete()
    return out


# -- jobs, models and constraints, over rows that break them


def _work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    at = F.timestamp_seconds(F.lit(1704067200) + k)
    state = F.when(k % 3 == 0, "CLAIMED").when(k % 7 == 0, "DEAD").otherwise("PENDING")
    return read_table(spark, sf_dir, "customer").select(k.alias("job_id"), state.alias("state"), (k % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), at.alias("visible_at"), F.timestamp_seconds(F.lit(1704067200) + k % 100).alias("leased_until"))


_WORK_ITEMS = "SELECT c_custkey AS k, c_custkey % 4 AS attempts, CASE WHEN c_custkey % 3 = 0 THEN 'CLAIMED' WHEN c_custkey % 7 = 0 THEN 'DEAD' ELSE 'PENDING' END AS state FROM customer"


@query(f"SELECT k AS job_id, CASE WHEN attempts >= 3 THEN 'DEAD' ELSE 'PENDING' END AS state, CASE WHEN attempts >= 3 THEN k ELSE 1000 + CAST(pow(2, attempts) AS BIGINT) END AS seconds FROM ({_WORK_ITEMS}) WHERE state = 'CLAIMED'", plain=True)
def queue_failures(spark, sf_dir):
    """Claimed jobs that all failed at second 1000: later and later, then dead."""
    rows = queue.failed(_work_items(spark, sf_dir).where("state = 'CLAIMED'"), "2024-01-01 00:16:40")
    return rows.select("job_id", "state", (F.unix_timestamp("visible_at") - 1704067200).alias("seconds"))


@query(f"SELECT k AS job_id, CASE WHEN state = 'CLAIMED' AND k % 100 < 50 THEN 'PENDING' ELSE state END AS state FROM ({_WORK_ITEMS})", plain=True)
def queue_reaped(spark, sf_dir):
    return queue.reap(_work_items(spark, sf_dir), "2024-01-01 00:00:50").select("job_id", "state")


@query(f"""SELECT count(*) FILTER (state = 'PENDING') AS pending, count(*) FILTER (state = 'CLAIMED') AS claimed, count(*) FILTER (state = 'DEAD') AS dead, 86400 - min(k) FILTER (state = 'PENDING') AS oldest_pending_seconds,
  (SELECT count(*) FROM orders WHERE o_orderkey % 200 > 0 AND o_orderkey % 200 <= 100 AND o_orderkey % 3 = 0) AS done_24h, (SELECT count(*) FROM orders WHERE o_orderkey % 200 > 0 AND o_orderkey % 200 <= 100 AND o_orderkey % 3 = 1) AS failed_24h FROM ({_WORK_ITEMS})""", plain=True)  # fmt: skip
def operational_snapshot(spark, sf_dir):
    """At the second day's first second; each order is an event at a second, of which 1 to 100 lie within the last day."""
    n, k = F.col("o_orderkey") % 200, F.col("o_orderkey") % 3
    at = F.timestamp_seconds(F.lit(1704067200) + F.when(n <= 100, n).otherwise(n + 86400))
    log = read_table(spark, sf_dir, "orders").select(at.alias("at"), F.when(k == 0, "DONE").when(k == 1, "FAILED").otherwise("CLAIMED").alias("state"))
    return queue.operational_snapshot(_work_items(spark, sf_dir), log, "2024-01-02 00:00:00")


def _model_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    steps = [("CANDIDATE", F.lit(True)), ("SHADOW", k % 2 == 0), ("ACTIVE", k % 3 == 0), ("RETIRED", k % 12 == 0)]
    told = F.array(*(F.when(when, F.struct(F.lit(i).alias("event_id"), F.lit(state).alias("state"))) for i, (state, when) in enumerate(steps)))
    rows = read_table(spark, sf_dir, "customer").select(k.alias("model"), F.col("c_nationkey").alias("kind"), k.cast("string").alias("digest"), F.explode(F.filter(told, lambda x: x.isNotNull())).alias("e"))
    return rows.select("model", "kind", "digest", "e.*", F.timestamp_seconds(F.lit(1704067200) + F.col("model") + F.col("e.event_id")).alias("at"))


@query("SELECT c_nationkey AS kind, max(c_custkey) AS model, CAST(max(c_custkey) AS VARCHAR) AS digest FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 12 <> 0 GROUP BY c_nationkey", plain=True)
def active_models(spark, sf_dir):
    return queue.active_models(_model_events(spark, sf_dir))


@query("SELECT c_custkey AS model, 'ACTIVE' AS state FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0", plain=True)
def illegal_transitions(spark, sf_dir):
    """Models that went from candidate to active without a shadow run."""
    return queue.illegal_transitions(_model_events(spark, sf_dir)).select("model", "state")


@query("SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS source_record_id FROM orders ORDER BY o_orderdate DESC, 1 LIMIT 1000", plain=True)
def newest_landed(spark, sf_dir):
    """The newest thousand of landed records: a top-k."""
    landed = read_table(spark, sf_dir, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("source_record_id"), F.col("o_orderdate").alias("ingested_at"))
    return landing.newest(landed, 1000).select("source_record_id")


@query(f"WITH {_SCD} SELECT id, version, coalesce(segment, CASE WHEN is_current THEN 'S' || id END) AS segment FROM history", plain=True)
def backfill_columns(spark, sf_dir):
    """Segments that current versions lack, filled in without a version; closed ones stay as they were."""
    history = _history(spark, sf_dir).history
    incoming = history.select("id").distinct().withColumn("segment", F.concat(F.lit("S"), "id"))
    return operations.backfill_columns(history, incoming, "id", ["segment"]).select("id", "version", "segment")


_BROKEN = """broken AS (SELECT c_custkey AS k, c_custkey % 7 = 0 AS ends, c_custkey % 5 <> 0 AS live FROM customer), twice AS (SELECT * FROM broken UNION ALL SELECT * FROM broken WHERE k % 3 = 0)"""


@query(f"""WITH {_BROKEN} SELECT 'validity_order' AS "constraint", count(*) AS violations FROM twice WHERE ends UNION ALL SELECT 'current_is_open', count(*) FROM twice WHERE live = ends
  UNION ALL SELECT 'one_current_version', count(*) FROM broken WHERE live AND k % 3 = 0 UNION ALL SELECT 'target_is_policy_or_party', count(*) FROM broken WHERE (k % 3 = 0) = (k % 4 <> 0)
  UNION ALL SELECT 'kind_fits_target', count(*) FROM broken WHERE (k % 2 = 0) <> (k % 4 = 0) UNION ALL SELECT 'role_present', count(*) FROM broken WHERE k % 2 <> 0 AND k % 6 = 3
  UNION ALL SELECT 'no_self_edge', count(*) FROM broken WHERE k % 8 = 0 UNION ALL SELECT 'pair_is_ordered', count(*) FROM broken WHERE k % 9 = 0
  UNION ALL SELECT 'score_in_range', count(*) FROM broken WHERE k % 12 = 11 UNION ALL SELECT 'ai_only_in_grey', count(*) FROM broken WHERE k % 2 = 0 AND k % 3 = 0""", plain=True)  # fmt: skip
def violations_found(spark, sf_dir):
    """Every constraint on rows that break it."""
    rows, k = read_table(spark, sf_dir, "customer"), F.col("c_custkey")
    day = lambda d: F.lit(d).cast("timestamp")
    person = rows.unionByName(rows.where(k % 3 == 0)).select(k.alias("person_id"), day("2024-02-01").alias("valid_from"), F.when(k % 7 == 0, day("2024-01-01")).alias("valid_to"), (k % 5 != 0).alias("is_current"))
    kind = F.when(k % 2 == 0, "PARTY_PARTY").otherwise("PARTY_POLICY")
    edges = rows.select(kind.alias("edge_kind"), k.alias("from_person_id"), F.when(k % 3 != 0, "p").alias("to_policy_id"), F.when(k % 8 == 0, k).when(k % 4 == 0, k + 1).alias("to_person_id"), F.when(k % 6 != 3, "OWNER").alias("role"))
    pairs = rows.select(k.alias("left_id"), F.when(k % 9 == 0, k - 1).otherwise(k + 1).alias("right_id"), ((k % 12) / 10.0).alias("score"), F.when(k % 2 != 0, "GREY").otherwise("AUTO_MATCH").alias("zone"), F.when(k % 3 == 0, 0.5).alias("ai_score"))
    return store.violations(person, edges, pairs)


# -- standardisation

_CHECK_SQL = {
    "name_present": "coalesce(length(full_name_normalized) > 0, false)",
    "name_token_count": "party_type <> 'PERSON' OR coalesce(len(name_tokens) BETWEEN 2 AND 6, false)",
    "name_no_digits": "coalesce(NOT regexp_matches(full_name_normalized, '[0-9]'), false)",
    "name_parsed_cleanly": "party_type <> 'PERSON' OR coalesce(length(given_name_derived) > 0 AND length(surname_derived) > 0, false)",
    "name_not_placeholder": f"coalesce(NOT regexp_matches(full_name_normalized, {O.text(vocab.PLACEHOLDER)}), false)",
    "name_has_phonetic_key": "coalesce(length(name_phonetic_key) > 0, false)",
    "email_syntax": "coalesce(length(email_address), 0) = 0 OR coalesce(length(email_normalized) > 0, false)",
    "phone_syntax": "coalesce(length(phone_raw), 0) = 0 OR coalesce(length(phone_e164) > 0, false)",
    "address_has_number": "coalesce(length(address_line1), 0) = 0 OR coalesce(regexp_matches(address_normalized, '[0-9]'), false)",
    "address_has_postcode": "coalesce(length(address_line1), 0) = 0 OR coalesce(length(postal_code) > 0, false)",
    "address_split": "coalesce(length(address_line1), 0) = 0 OR coalesce(length(address_key) > 0 AND length(city) > 0, false)",
    "dob_plausible": "date_of_birth IS NULL OR (date_of_birth > DATE '1900-01-01' AND date_of_birth < DATE '2020-01-01')",
}
_GATED = "gated AS (SELECT *, list_filter([" + ", ".join(f"CASE WHEN NOT ({x}) THEN '{n}' END" for n, x in _CHECK_SQL.items()) + "], lambda x: x IS NOT NULL) AS failed_checks FROM parties)"


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.apply_gate(parties(spark, sf_dir))


@query("SELECT person_id, array_to_string(failed_checks, ',') AS failed_checks, len(failed_checks) = 0 AS gate_passed FROM gated", _GATED)
def gate_flags(spark, sf_dir):
    return gated(spark, sf_dir).select("person_id", *_joined("failed_checks"), "gate_passed")


@query("SELECT check_name, count(*) AS failures, round(count(*) / (SELECT count(*) FROM gated), 6) AS failure_rate FROM (SELECT unnest(failed_checks) AS check_name FROM gated) GROUP BY check_name", _GATED)
def gate_summary(spark, sf_dir):
    return gate.gate_summary(gated(spark, sf_dir))


_EXTRACT_RULE = rules.Rule("initial_middle", "EXTRACT", "full_name_normalized", "^([A-Z]+) ([A-Z]) ([A-Z]+)$", targets=("given_name_derived", "middle_name_derived", "surname_derived"))


@query("SELECT person_id, regexp_replace(full_name_normalized, '^N A$', '', 'g') AS full_name_normalized FROM gated WHERE len(failed_checks) > 0", _GATED)
def rule_rewrite(spark, sf_dir):
    rule = rules.Rule("blank_na", "REWRITE", "full_name_normalized", "^N A$", "")
    return rules.apply_rules(gated(spark, sf_dir), [rule]).where("NOT gate_passed").select("person_id", "full_name_normalized")


@query("""SELECT person_id, coalesce(given_name_derived, nullif(regexp_extract(full_name_normalized, '^([A-Z]+) ([A-Z]) ([A-Z]+)$', 1), '')) AS given_name_derived, nullif(regexp_extract(full_name_normalized, '^([A-Z]+) ([A-Z]) ([A-Z]+)$', 2), '') AS middle_name_derived,
  coalesce(surname_derived, nullif(regexp_extract(full_name_normalized, '^([A-Z]+) ([A-Z]) ([A-Z]+)$', 3), '')) AS surname_derived FROM gated WHERE len(failed_checks) > 0""", _GATED)  # fmt: skip
def rule_extract(spark, sf_dir):
    rows = gated(spark, sf_dir)
    rows = rows if "middle_name_derived" in rows.columns else rows.withColumn("middle_name_derived", F.lit(None).cast("string"))
    return rules.apply_rules(rows, [_EXTRACT_RULE]).where("NOT gate_passed").select("person_id", "given_name_derived", "middle_name_derived", "surname_derived")


@query("""SELECT count(*) FILTER (m) AS matched, count(*) FILTER (NOT b AND a) AS fixed, count(*) FILTER (b AND NOT a) AS regressed, count(*) FILTER (b = a) AS unchanged FROM (
  SELECT regexp_matches(full_name_normalized, '^([A-Z]+) ([A-Z]) ([A-Z]+)$') AS m, len(failed_checks) = 0 AS b, len(failed_checks) = 0 OR (failed_checks = ['name_parsed_cleanly'] AND regexp_matches(full_name_normalized, '^([A-Z]+) ([A-Z]) ([A-Z]+)$')) AS a FROM gated)""", _GATED)  # fmt: skip
def shadow_eval(spark, sf_dir):
    rows = parties(spark, sf_dir)
    rows = rows if "middle_name_derived" in rows.columns else rows.withColumn("middle_name_derived", F.lit(None).cast("string"))
    return rules.shadow_evaluate(rows, _EXTRACT_RULE)


_ASKED = f"""asked AS (SELECT person_id, list_filter(list_transform(failed_checks, lambda c: {O.case("c", fallback.CHECK_FIELD, "NULL")}), lambda f: f IS NOT NULL)[1] AS field_name, full_name, address_line1, phone_raw, full_name_normalized, party_type FROM gated WHERE len(failed_checks) > 0),
requested AS (SELECT *, CASE field_name WHEN 'full_name' THEN full_name WHEN 'address_line1' THEN address_line1 WHEN 'phone_raw' THEN phone_raw END AS raw_value FROM asked)"""


@query("SELECT person_id, field_name, raw_value, full_name_normalized AS deterministic_value FROM requested WHERE length(trim(raw_value)) > 0", _GATED, _ASKED)
def fallback_requests(spark, sf_dir):
    return fallback.requests(gated(spark, sf_dir)).select("person_id", "field_name", "raw_value", "deterministic_value")


@query(f"""SELECT person_id, CASE WHEN n >= 2 THEN t[1] END AS given, CASE WHEN n >= 2 THEN array_to_string(t[2:n - run - 1], ' ') END AS middle, CASE WHEN n >= 2 THEN array_to_string(t[n - run:n], ' ') END AS surname FROM (
  SELECT person_id, t, len(t) AS n, CASE WHEN len(t) > 2 AND list_contains({O.listed(vocab.PARTICLES)}, t[len(t) - 1]) THEN 1 + CASE WHEN len(t) > 3 AND list_contains({O.listed(vocab.PARTICLES)}, t[len(t) - 2]) THEN 1 ELSE 0 END ELSE 0 END AS run FROM (
  SELECT person_id, list_filter(string_split(full_name_normalized, ' '), lambda x: x <> '') AS t FROM parties))""")  # fmt: skip
def heuristic_name_split(spark, sf_dir):
    rows = parties(spark, sf_dir).withColumn("p", fallback.name_parts(F.col("full_name_normalized")))
    return rows.select("person_id", "p.given", "p.middle", "p.surname")


@query(f"""SELECT field_name, 'name_parsed_cleanly' AS failed_check, shape, count(*) AS evidence_count FROM (SELECT 'full_name' AS field_name, array_to_string({_SHAPE.replace('full_name', 'full_name_normalized')}, '-') AS shape FROM parties WHERE full_name_normalized LIKE '% % %' AND party_type = 'PERSON') GROUP BY ALL HAVING count(*) >= 5""")
def mine_signatures(spark, sf_dir):
    rows = parties(spark, sf_dir).where("full_name_normalized LIKE '% % %' AND party_type = 'PERSON'")
    log = rows.select(F.lit("full_name").alias("field_name"), F.lit("name_parsed_cleanly").alias("failed_check"), F.col("full_name_normalized").alias("deterministic_value"), F.lit(True).alias("ai_resolved"))
    return rules.mine_signatures(log, 5).select("field_name", "failed_check", "shape", "evidence_count")


# -- households


def _associations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = stored(occurrences(spark, sf_dir), "occurrences")
    people = shred.collapse_parties(rows)
    edges = shred.shred_relationships(rows).withColumnRenamed("policy_number_normalized", "policy_id")
    return people, household.associations(household.stated_pairs(edges), people)


@query("SELECT from_id, to_id, policy_id, association_type FROM stated WHERE association_type IS NOT NULL", O.HOUSEHOLDS)
def stated_pairs(spark, sf_dir):
    return household.stated_pairs(policy_edges(spark, sf_dir)).select("from_id", "to_id", "policy_id", "association_type")


@query("SELECT from_id, to_id, association_type, evidence, evidence_count, same_address FROM assoc", O.HOUSEHOLDS)
def associations(spark, sf_dir):
    found = _associations(spark, sf_dir)[1]
    return found.select("from_id", "to_id", "association_type", F.array_join("evidence_policy_ids", ",").alias("evidence"), "evidence_count", "same_address")


@query("SELECT person_id, household_size, label IS NOT NULL AS in_household FROM household", O.HOUSEHOLDS)
def households(spark, sf_dir):
    people, found = _associations(spark, sf_dir)
    return household.households(found, people).select("person_id", "household_size", F.col("household_id").isNotNull().alias("in_household"))


@query("SELECT count(*) AS households, CAST(coalesce(sum(household_size), 0) AS BIGINT) AS people, coalesce(max(household_size), 0) AS largest, count(*) FILTER (household_size >= 12) AS suspicious FROM homes", O.HOUSEHOLDS)
def household_report(spark, sf_dir):
    people, found = _associations(spark, sf_dir)
    return household.household_report(household.households(found, people))


_SIDE = O.case("role", {"OWNER": "OWNER", "INSURED": "INSURED", "AGENT": "AGENT"}, "NULL")
_STRUCTURE = O.case("l.side || '>' || r.side", {"OWNER>OWNER": "CO_OWNER", "INSURED>INSURED": "CO_INSURED", "OWNER>INSURED": "OWNER_OF_INSURED", "INSURED>OWNER": "INSURED_OF_OWNER", "OWNER>AGENT": "SERVICED_BY_AGENT", "AGENT>OWNER": "AGENT_SERVICES"}, "NULL")


@query(f"SELECT association_type, count(*) AS edges, count(DISTINCT from_id) AS parties FROM (SELECT l.person_id AS from_id, {_STRUCTURE} AS association_type FROM sided l JOIN sided r ON l.policy_id = r.policy_id AND l.person_id <> r.person_id) WHERE association_type IS NOT NULL GROUP BY association_type",
       f"sided AS (SELECT DISTINCT person_id, policy_number_normalized AS policy_id, {_SIDE} AS side FROM occ)")
def structural_associations(spark, sf_dir):
    found = household.structural_pairs(policy_edges(spark, sf_dir))
    return found.groupBy("association_type").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("from_id").alias("parties"))


@query("SELECT to_id AS person_id, CAST(count(*) AS INT) AS affiliation_count FROM assoc WHERE association_type IN ('EMPLOYEE_OF', 'TRUST_MEMBER_OF', 'ESTATE_SUBJECT_OF') GROUP BY to_id", O.HOUSEHOLDS)
def affiliations(spark, sf_dir):
    return household.affiliations(_associations(spark, sf_dir)[1])


@query("SELECT h.person_id, h.household_size FROM household h WHERE h.label = (SELECT min(label) FROM labels)", O.HOUSEHOLDS)
def household_of(spark, sf_dir):
    """The members of the household of the first person that has one."""
    people, found = _associations(spark, sf_dir)
    members = stored(household.households(found, people), "members")
    first = members.where("household_id IS NOT NULL").agg(F.min("person_id").alias("first"))
    mine = members.join(first, F.col("person_id") == F.col("first"), "left_semi").select("household_id")
    return members.join(mine, "household_id", "left_semi").select("person_id", "household_size")


# -- reads


@query("SELECT person_id, full_name_normalized FROM parties WHERE contains(full_name_normalized, 'SMITH') ORDER BY full_name_normalized, person_id LIMIT 200")
def search(spark, sf_dir):
    return reads.search(parties(spark, sf_dir), name="Dr. Smith").select("person_id", "full_name_normalized")


@query(f"""SELECT probe_id, person_id, round(score, 6) AS score, zone FROM (
  SELECT left_id AS probe_id, right_id AS person_id, score, zone, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id DESC) AS place FROM scored WHERE zone <> 'AUTO_REJECT') WHERE place <= 10""",
       *[x.replace("pairs JOIN parties l", "probed JOIN parties l") for x in (
           "probed AS (SELECT DISTINCT a.id AS left_id, b.id AS right_id, '' AS blocking_keys FROM keys a JOIN keys b ON a.kind = b.kind AND a.key = b.key WHERE a.id LIKE '%D-%' AND NOT b.id LIKE '%D-%')", O.SCORED)])
def duplicate_check(spark, sf_dir):
    """Every customer with a second number, as typed in at a desk, against all the others."""
    needed = dict.fromkeys(["person_id", *_TYPED, "phone_e164", *(c[0] for c in scoring.COMPARATORS.values()), *(v[0] for v in scoring.VETOES.values())])
    with small_methods(spark), Scratch(spark) as scratch:
        everybody = shred.collapse_parties(occurrences(spark, sf_dir))
        people = stored(everybody.select(*(c for c in needed if c in everybody.columns)), "parties")
        return scratch.result(_typed_in(people), "found")


_TYPED = ("full_name", "date_of_birth", "gender", "email_address", "address_line1", "address_line2", "postal_code")


def _typed_in(people: DataFrame) -> DataFrame:
    probes = people.where(F.contains("person_id", F.lit("D-"))).select(F.col("person_id").alias("probe_id"), *_TYPED, F.col("phone_e164").alias("phone_raw"))
    found = reads.duplicate_check(probes, people.where(~F.contains("person_id", F.lit("D-"))), MAPPING.default_country_code)
    return found.select("probe_id", "person_id", F.round("score", 6).alias("score"), "zone")


@query("SELECT person_id, policy_id, CAST(shared AS BIGINT) AS shared_policies FROM (SELECT a.person_id, b.person_id AS policy_id, count(DISTINCT a.policy_number_normalized) AS shared FROM occ a JOIN occ b ON a.policy_number_normalized = b.policy_number_normalized AND a.person_id <> b.person_id GROUP BY ALL)")
def counterparties(spark, sf_dir):
    return reads.counterparties(policy_edges(spark, sf_dir)).select("person_id", F.col("other_id").alias("policy_id"), "shared_policies")


@query("SELECT person_id, policy_id, role, place FROM (SELECT person_id, o.policy_number_normalized AS policy_id, role, row_number() OVER (PARTITION BY person_id ORDER BY effective_date DESC NULLS LAST, o.policy_number_normalized, role) AS place FROM occ o JOIN policies p ON o.policy_number_normalized = p.policy_number_normalized) WHERE place <= 500", O.POLICIES)
def customer_360_policies(spark, sf_dir):
    policies = shred.shred_policies(policy_extract(spark, sf_dir), MAPPING).select(F.col("policy_number_normalized").alias("policy_id"), "effective_date")
    return reads.policies_of(policy_edges(spark, sf_dir), policies).select("person_id", "policy_id", "role", F.col("place").cast("bigint").alias("place"))


@query("SELECT person_id, CAST(sum(sum_assured_amount) AS DOUBLE) AS total_sum_assured FROM (SELECT DISTINCT person_id, policy_number_normalized FROM occ WHERE role IN ('OWNER', 'INSURED')) JOIN policies USING (policy_number_normalized) GROUP BY person_id", O.POLICIES)
def total_sum_assured(spark, sf_dir):
    policies = shred.shred_policies(policy_extract(spark, sf_dir), MAPPING).withColumnRenamed("policy_number_normalized", "policy_id")
    return reads.total_sum_assured(policy_edges(spark, sf_dir), policies).select("person_id", F.col("total_sum_assured").cast("double").alias("total_sum_assured"))


@query("""SELECT 'person' AS entity, 'rows' AS dimension, '' AS value, count(*) AS n FROM parties UNION ALL SELECT 'policy', 'rows', '', count(*) FROM policies
  UNION ALL SELECT 'person', 'party_type', party_type, count(*) FROM parties GROUP BY party_type UNION ALL SELECT 'person', 'gender', coalesce(gender, '(none)'), count(*) FROM parties GROUP BY gender
  UNION ALL SELECT 'policy', 'policy_status', policy_status, count(*) FROM policies GROUP BY policy_status UNION ALL SELECT 'policy', 'product_line', product_line, count(*) FROM policies GROUP BY product_line""", O.POLICIES)  # fmt: skip
def entity_overview(spark, sf_dir):
    tables = {"person": parties(spark, sf_dir), "policy": shred.shred_policies(policy_extract(spark, sf_dir), MAPPING)}
    return reads.overview(tables, [("person", "party_type"), ("person", "gender"), ("policy", "policy_status"), ("policy", "product_line")])


@query("SELECT person_id, full_name FROM parties ORDER BY person_id LIMIT 50 OFFSET 100")
def browse_page(spark, sf_dir):
    return reads.browse(parties(spark, sf_dir), "person_id", 2, 50).select("person_id", "full_name")


@query("SELECT person_id, CASE WHEN full_name IS NULL THEN '' ELSE '***' END AS full_name, coalesce(gender, '') AS gender, CASE WHEN name_tokens IS NULL THEN '' ELSE '***' END AS name_tokens, coalesce(postal_code, '') AS postal_code FROM parties")
def export_entity(spark, sf_dir):
    return reads.export_entity(parties(spark, sf_dir).select("person_id", "full_name", "gender", "name_tokens", "postal_code"), PERSON)


@query("SELECT source_record_id, PolicyNumber, 'P:' || policy_number_normalized AS PolicyMdmId, CASE WHEN length(OwnerCustomerId) > 0 THEN 'M:' || OwnerCustomerId END AS OwnerMdmId, CASE WHEN length(AgentCode) > 0 THEN 'M:' || AgentCode END AS AgentMdmId FROM raw JOIN policies USING (source_record_id)".replace("PolicyNumber,", "raw.PolicyNumber,"), O.POLICIES)
def export_source_shaped(spark, sf_dir):
    raw = policy_extract(spark, sf_dir)
    policies = shred.shred_policies(raw, MAPPING).select("policy_number_normalized", F.concat(F.lit("P:"), "policy_number_normalized").alias("policy_id"))
    keys = occurrences(spark, sf_dir).where("length(source_party_key) > 0").select("source_party_key").distinct()
    ids = keys.withColumn("golden_id", F.concat(F.lit("M:"), "source_party_key"))
    out = reads.export_source_shaped(raw, policies, ids, shred.policy_number(MAPPING), {"OWNER": "OwnerCustomerId", "AGENT": "AgentCode"})
    return out.select("source_record_id", "PolicyNumber", "PolicyMdmId", "OwnerMdmId", "AgentMdmId")


# -- quality


_TRUTH = "regexp_replace(source_party_key, '^[CD]-', '')"


def _labels(people: DataFrame) -> DataFrame:
    return people.where("length(source_party_key) > 0").select("person_id", F.regexp_replace("source_party_key", "^[CD]-", "").alias("true_id"))


@query(f"""SELECT hit AS true_positives, said - hit AS false_positives, actual - hit AS false_negatives, round(hit / said, 6) AS precision, round(hit / actual, 6) AS recall, round(2 * (hit / said) * (hit / actual) / (hit / said + hit / actual), 6) AS f1 FROM (
  SELECT (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM lab GROUP BY master_id, true_id)) AS hit, (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM lab GROUP BY master_id)) AS said,
  (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM lab GROUP BY true_id)) AS actual)""", O.SCORED, O.CLUSTERED, f"lab AS (SELECT person_id, master_id, {_TRUTH} AS true_id FROM clusters JOIN parties USING (person_id) WHERE length(source_party_key) > 0)")  # fmt: skip
def match_quality(spark, sf_dir):
    people, assigned = clustered(spark, sf_dir)
    return quality.pairwise_quality(assigned, _labels(people))


@query(f"SELECT count(*) FILTER (lt = rt) AS blocked, (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM lab GROUP BY true_id)) AS actual, round(count(*) FILTER (lt = rt) / (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM lab GROUP BY true_id)), 6) AS blocking_recall FROM (SELECT a.true_id AS lt, b.true_id AS rt FROM pairs JOIN lab a ON a.person_id = left_id JOIN lab b ON b.person_id = right_id)",
       f"lab AS (SELECT person_id, {_TRUTH} AS true_id FROM parties WHERE length(source_party_key) > 0)")
def blocking_recall(spark, sf_dir):
    people = parties(spark, sf_dir)
    return quality.blocking_recall(blocking.block_pairs(people), _labels(people))


@query("SELECT label AS master_id, count(DISTINCT vec_id % 7) AS truths, count(*) AS members FROM embeddings GROUP BY label HAVING count(DISTINCT vec_id % 7) > 1", plain=True)
def wrong_clusters(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("person_id"), F.col("label").alias("master_id"), (F.col("vec_id") % 7).alias("true_id"))
    return quality.wrong_clusters(rows.drop("true_id"), rows.select("person_id", "true_id"))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS attribute, round(avg(CAST(coalesce(length(CAST({c} AS VARCHAR)) > 0, false) AS DOUBLE)), 6) AS completeness, {x} AS conformity FROM parties" for c, x in {
    "full_name": "CAST(NULL AS DOUBLE)", "email_address": "round(avg(CAST(email_normalized IS NOT NULL AS DOUBLE)) FILTER (length(email_address) > 0), 6)", "phone_raw": "round(avg(CAST(phone_e164 IS NOT NULL AS DOUBLE)) FILTER (length(phone_raw) > 0), 6)", "date_of_birth": "CAST(NULL AS DOUBLE)"}.items()) + ")")
def data_quality(spark, sf_dir):
    conforms = {"email_address": F.col("email_normalized").isNotNull(), "phone_raw": F.col("phone_e164").isNotNull()}
    return quality.data_quality(parties(spark, sf_dir), conforms, ["full_name", "email_address", "phone_raw", "date_of_birth"])


@query("SELECT count(*) AS source_records, count(DISTINCT master_id) AS golden_records, round(1 - count(DISTINCT master_id) / count(*), 6) AS duplication_rate FROM clusters", O.SCORED, O.CLUSTERED)
def duplication(spark, sf_dir):
    people, assigned = clustered(spark, sf_dir)
    return quality.duplication(people, assigned)


@query("SELECT 'POLICY_ADMIN' AS source_system, source_key_kind, count(*) AS n FROM parties WHERE source_key_kind <> 'CUSTOMER_ID' GROUP BY source_key_kind")
def stale_key_kinds(spark, sf_dir):
    declared = spark.createDataFrame([("POLICY_ADMIN", "CUSTOMER_ID")], "source_system string, source_key_kind string")
    return quality.stale_key_kinds(parties(spark, sf_dir), declared)


# -- the ledger


@query("SELECT 'run-2' AS run_id, count(*) AS pairs, count(*) FILTER (final_decision = 'MATCH') AS matches, CAST(0 AS BIGINT) AS reviews, round(avg(CAST(zone = 'GREY' AS DOUBLE)), 6) AS ai_share, count(*) FILTER (vetoed) AS vetoed FROM decided", O.SCORED)
def ledger_latest_run(spark, sf_dir):
    """Two runs in the ledger; the newest one's summary."""
    now = stored(decided(spark, sf_dir), "decided")
    rows = ledger.ledger_rows(now.limit(5), "run-1", "2024-01-01 00:00:00").unionByName(ledger.ledger_rows(now, "run-2", "2024-02-01 00:00:00"))
    return ledger.run_summary(ledger.latest_run(rows))


@query("SELECT o_custkey AS left_id, o_custkey + 1 AS right_id, o_orderstatus AS decision FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderstatus) = 1", plain=True)
def steward_latest_decision(spark, sf_dir):
    told = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("left_id"), (F.col("o_custkey") + 1).alias("right_id"), F.col("o_orderstatus").alias("decision"), F.col("o_orderdate").alias("decided_at"))
    return ledger.latest_decisions(told)


@query("SELECT person_id, field_name, failed_checks[list_position(list_transform(failed_checks, lambda c: " + O.case("c", {k: "y" for k in fallback.CHECK_FIELD}, "'n'") + "), 'y')] AS failed_check FROM requested JOIN gated USING (person_id) WHERE length(trim(raw_value)) > 0", _GATED, _ASKED)
def exception_log(spark, sf_dir):
    answers = fallback.standardise(fallback.requests(gated(spark, sf_dir)), "44")
    return ledger.exception_rows(answers, "b1", "2024-01-01 00:00:00").select("person_id", "field_name", "failed_check")


@query("SELECT 'B' || CAST(c_custkey AS VARCHAR) AS batch_id, CASE WHEN c_custkey % 4 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'DEAD' ELSE 'DONE' END END AS job_state FROM customer", plain=True)
def batch_job_states(spark, sf_dir):
    rows = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("B"), F.col("c_custkey").cast("string")).alias("batch_id"), "c_custkey")
    jobs = rows.where("c_custkey % 4 <> 0").select(F.concat(F.lit("batch:"), "batch_id").alias("dedupe_key"), F.when(F.col("c_custkey") % 3 == 0, "DEAD").otherwise("DONE").alias("state"))
    return ledger.batch_states(rows.select("batch_id"), jobs)


@query("SELECT count(DISTINCT golden) AS golden_ids, count(*) AS keys, count(DISTINCT source_party_key) AS party_keys FROM (SELECT DISTINCT 'G' || source_party_key AS golden, source_party_key, attr FROM parties, (SELECT unnest(['a', 'b']) AS attr) WHERE length(source_party_key) > 0)")
def person_lineage(spark, sf_dir):
    """Every key with what it decided: the crosswalk joined with provenance."""
    people = parties(spark, sf_dir).where("length(source_party_key) > 0")
    crosswalk = people.select(F.lit("S").alias("source_system"), "source_party_key", F.concat(F.lit("G"), "source_party_key").alias("golden_id"))
    told = crosswalk.select(F.col("golden_id").alias("master_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("attribute_name"))
    rows = reads.lineage(crosswalk, told, F.col("golden_id"))
    return rows.agg(F.countDistinct("golden_id").alias("golden_ids"), F.count(F.lit(1)).alias("keys"), F.countDistinct("source_party_key").alias("party_keys"))


# -- governance, queue and streams


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of jobs: a user is a job, an event a change of its state."""
    return read_table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("state"), F.col("ts").alias("at"))


@query("SELECT user_id AS job_id, event_id, event_type AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1", plain=True)
def queue_latest_state(spark, sf_dir):
    return queue.latest_state(_jobs(spark, sf_dir)).select("job_id", "event_id", "state")


@query("SELECT event_id AS job_id, CAST(2 AS INT) AS attempts FROM events WHERE event_type = 'click' ORDER BY user_id % 5, ts, event_id LIMIT 20", plain=True)
def queue_claim_order(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), F.lit("ingest").alias("queue_name"), F.when(F.col("event_type") == "click", "PENDING").otherwise("DONE").alias("state"),
        (F.col("user_id") % 5).alias("priority"), F.col("ts").cast("timestamp").alias("visible_at"), F.lit(1).alias("attempts"), F.lit(3).alias("max_attempts"),
    )
    return queue.claim(rows, "ingest", "2100-01-01 00:00:00", 20).select("job_id", "attempts")


@query("SELECT event_type AS queue_name, CASE WHEN value > 50 THEN 'PENDING' ELSE 'DONE' END AS state, count(*) AS jobs, CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS oldest FROM events GROUP BY ALL", plain=True)
def ops_snapshot(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("queue_name"), F.when(F.col("value") > 50, "PENDING").otherwise("DONE").alias("state"), F.col("ts").alias("visible_at"))
    return queue.depth(rows).select("queue_name", "state", "jobs", F.col("oldest").cast("date").cast("string").alias("oldest"))


@query("SELECT user_id AS person_id, event_type AS purpose, CASE WHEN value > 50 THEN 'GRANTED' ELSE 'DENIED' END AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, CASE WHEN value > 50 THEN 'GRANTED' ELSE 'DENIED' END DESC) = 1", plain=True)
def consent_current(spark, sf_dir):
    told = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("person_id"), F.col("event_type").alias("purpose"), F.when(F.col("value") > 50, "GRANTED").otherwise("DENIED").alias("state"), F.col("ts").alias("stated_at"))
    return governance.consent_history(told).where("is_current").select("person_id", "purpose", "state")


@query(f"""SELECT person_id, n AS live_contracts, CASE WHEN n > 0 THEN {O.text(','.join(sorted(set(governance.erasable_fields()) - governance.RETAINED)))} ELSE {O.text(','.join(sorted(governance.erasable_fields())))} END AS erased_fields, n = 0 AS complete
  FROM (SELECT p.person_id, count(DISTINCT l.policy_number_normalized) AS n FROM (SELECT person_id FROM parties WHERE source_key_kind = 'CUSTOMER_ID') p LEFT JOIN occ o ON o.person_id = p.person_id
  LEFT JOIN (SELECT policy_number_normalized FROM policies WHERE policy_status = 'INFORCE') l ON l.policy_number_normalized = o.policy_number_normalized GROUP BY p.person_id)""", O.POLICIES)  # fmt: skip
def erasure_plan(spark, sf_dir):
    asked = parties(spark, sf_dir).where("source_key_kind = 'CUSTOMER_ID'")
    policies = shred.shred_policies(policy_extract(spark, sf_dir), MAPPING).withColumnRenamed("policy_number_normalized", "policy_id")
    return governance.erasure_plan(asked, policy_edges(spark, sf_dir), policies).select("person_id", "live_contracts", "erased_fields", "complete")


@query("SELECT event_type, CAST(time_bucket(INTERVAL 1 DAY, ts) AS VARCHAR) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", plain=True)
def tumbling_windows(spark, sf_dir):
    rows = ingest.tumbling(read_table(spark, sf_dir, "events"), "ts", "1 day", "event_type")
    return rows.select("event_type", F.col("window_start").cast("string").alias("day"), "n", F.round("total", 4).alias("total"))


@query("""SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(CAST(gap AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT user_id, ts, event_id, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR, true) AS gap FROM events)) GROUP BY ALL) GROUP BY ALL""", plain=True)  # fmt: skip
def session_windows(spark, sf_dir):
    rows = ingest.sessions(read_table(spark, sf_dir, "events"), "ts", "6 hours", "user_id")
    return rows.groupBy("user_id", "n").agg(F.count(F.lit(1)).alias("sessions"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: pairs by zone and decision, from the raw extract on."""
    return decided(spark, sf_dir).groupBy("zone", "final_decision").agg(F.count(F.lit(1)).alias("pairs"))


QUERIES["zone_decisions"] = entry
ORACLES["zone_decisions"] = O.sql("SELECT zone, final_decision, count(*) AS pairs FROM decided GROUP BY zone, final_decision", O.SCORED)

__all__ = ["ORACLES", "QUERIES", "entry", "reduce"]
