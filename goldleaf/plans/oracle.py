"""DuckDB SQL with the same results as the catalogue's queries, written from the same fixed values."""

from __future__ import annotations

from goldleaf.functions import vocab
from goldleaf.operators import scoring
from goldleaf.operators.blocking import KEYS, MAX_BLOCK
from goldleaf.sources.extract import DUCKDB, extract_sql
from goldleaf.sources.mapping import EXTRACT_MAPPING, FieldMapping, load_mapping

MAPPING = load_mapping(EXTRACT_MAPPING)
_FROM = "".join(vocab.ACCENTS.values()).replace("ẞ", "")
_TO = "".join(k * len(v) for k, v in vocab.ACCENTS.items())


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(map(text, words)) + "]"


def case(x: str, table: dict[str, str], default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in table.items()) + f" ELSE {default} END"


def replace_all(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {text(pattern)}, {text(by)}, 'g')"


def norm(x: str) -> str:
    x = f"translate(upper(replace({x}, 'ß', 'SS')), {text(_FROM)}, {text(_TO)})"
    for old, new in vocab.LIGATURES.items():
        if old != "ß":
            x = f"replace({x}, {text(old)}, {text(new)})"
    return f"trim({replace_all(replace_all(x, '[^A-Z0-9 ]+', ' '), ' +', ' ')})"


PREFIX = f"^((?:(?:{'|'.join(vocab.PREFIXES)}) )+)"
SUFFIX = f"((?: (?:{'|'.join(vocab.SUFFIXES)}))+)$"


def full_name(x: str) -> str:
    x = norm(x)
    for _ in range(2):
        x = f"trim(regexp_replace(regexp_replace({x}, {text(PREFIX)}, ''), {text(SUFFIX)}, ''))"
    return x


def affix(x: str, pattern: str) -> str:
    return f"nullif(trim(regexp_extract({norm(x)}, {text(pattern)}, 1)), '')"


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def sorted_key(x: str) -> str:
    return f"array_to_string(list_sort({tokens(x)}), ' ')"


def phonetic(x: str) -> str:
    parts = f"regexp_extract_all({x}, {text('(' + '|'.join(k for k in vocab.PHONETIC if len(k) > 1) + '|.)')}, 1)"
    folded = f"array_to_string(list_transform({parts}, lambda p: {case('p', vocab.PHONETIC, 'p')}), '')"
    bare = replace_all(replace_all(folded, r"\BH"), r"\B[AEIOUY]+")
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        bare = f"replace({bare}, '{c}{c}', '{c}')"
    return sorted_key(bare)


def initials(x: str) -> str:
    return f"array_to_string(list_sort(list_transform({tokens(x)}, lambda t: substr(t, 1, 1))), '')"


def party_type(x: str) -> str:
    has = lambda words: f"coalesce(list_has_any({x}, {listed(words)}), false)"
    return f"CASE WHEN {has(vocab.TRUST_TOKENS)} THEN 'TRUST' WHEN {has(vocab.ESTATE_TOKENS)} THEN 'ESTATE' WHEN {has(vocab.ORGANIZATION_TOKENS)} THEN 'ORGANIZATION' WHEN len({x}) = 0 THEN 'UNKNOWN' ELSE 'PERSON' END"


def email(x: str) -> str:
    return f"CASE WHEN regexp_matches(lower(trim({x})), {text(vocab.EMAIL)}) THEN lower(trim({x})) END"


def phone(x: str, code: str) -> str:
    marked, digits = replace_all(x, "[^0-9+]"), replace_all(x, "[^0-9]")
    return f"""CASE WHEN length({digits}) >= 8 THEN '+' || CASE WHEN {marked} LIKE '+%' THEN {digits} WHEN {marked} LIKE '00%' THEN substr({digits}, 3)
      WHEN {digits} LIKE '0%' THEN '{code}' || substr({digits}, 2) ELSE '{code}' || {digits} END END"""


def policy_number(x: str) -> str:
    return f"regexp_replace({replace_all(f'upper({x})', '[^A-Z0-9]')}, '^([A-Z]*)0+([0-9])', '\\1\\2')"


def address(*lines: str) -> str:
    joined = "' ' || " + " || ' ' || ".join(f"coalesce({norm(x)}, '')" for x in lines)
    keys = "|".join(sorted(vocab.ADDRESS, key=lambda k: (len(k), k)))
    parts = f"regexp_extract_all({joined}, {text(f'( (?:{keys})|.)')}, 1)"
    folded = f"array_to_string(list_transform({parts}, lambda p: {case('p', {f' {k}': f' {v}' for k, v in vocab.ADDRESS.items()}, 'p')}), '')"
    return f"trim({replace_all(folded, ' +', ' ')})"


def address_key(normalized: str, postal: str) -> str:
    numbers = f"array_to_string(list_sort(regexp_extract_all({normalized}, '([0-9]+)', 1)), ',')"
    code = f"replace({norm(postal)}, ' ', '')"
    return f"CASE WHEN length({numbers}) > 0 AND length({code}) > 0 THEN {numbers} || '|' || {code} END"


def date(x: str, formats=MAPPING.date_formats) -> str:
    return "CAST(coalesce(" + ", ".join(f"try_strptime(trim({x}), {text(f)})" for f in formats) + ") AS DATE)"


def money(x: str) -> str:
    return f"TRY_CAST({replace_all(x, '[^0-9.-]')} AS DECIMAL(18, 4))"


def integer(x: str) -> str:
    return f"TRY_CAST({replace_all(x, '[^0-9-]')} AS BIGINT)"


def enum(x: str, vocabulary: dict[str, str]) -> str:
    table = {k.upper().replace(" ", "_"): v for k, v in vocabulary.items()}
    return case(f"replace({norm(x)}, ' ', '_')", table, "'UNKNOWN'")


def transformed(f: FieldMapping) -> str:
    if f.literal is not None:
        return text(f.literal)
    x = f.source
    return {
        "text": lambda: f"trim({x})", "name": lambda: f"trim({x})", "email": lambda: email(x), "phone": lambda: phone(x, MAPPING.default_country_code), "date": lambda: date(x),
        "policy_number": lambda: policy_number(x), "money": lambda: money(x), "integer": lambda: integer(x), "enum": lambda: enum(x, f.vocabulary),
    }[f.transform]()


PARTY_COLUMNS = ("full_name", "date_of_birth", "gender", "email_address", "phone_raw", "address_line1", "address_line2", "city", "postal_code", "country_code", "occupation")


def _block(party) -> str:
    own = {f.canonical: transformed(f) for f in party.fields}
    kind = lambda c: "DATE" if c == "date_of_birth" else "VARCHAR"
    columns = ", ".join(f"{own.get(c, f'CAST(NULL AS {kind(c)})')} AS {c}" for c in PARTY_COLUMNS)
    stated = f"nullif(upper(trim({party.relationship_field})), '')" if party.relationship_field else "CAST(NULL AS VARCHAR)"
    return f"""SELECT {columns}, trim({party.key_field}) AS source_party_key, '{party.key_kind}' AS source_key_kind, '{party.role}' AS role, {stated} AS stated_relationship,
      {"true" if "address_line1" in own else "false"} AS has_address, {policy_number("PolicyNumber")} AS policy_number_normalized, source_record_id FROM raw"""


SEPARATOR = "chr(31)"
DERIVED = ("full_name_normalized", "name_tokens", "name_sorted_key", "name_phonetic_key", "name_initials", "name_prefix_derived", "name_suffix_derived", "email_normalized", "phone_e164", "party_type",
           "given_name_derived", "surname_derived", "name_parse_confidence", "name_parse_method", "address_normalized", "address_key")
COLLAPSED = (*PARTY_COLUMNS, *DERIVED, "source_party_key", "source_key_kind", "source_record_id")

PRELUDE = f"""
raw AS ({extract_sql(DUCKDB)}),
occ0 AS ({" UNION ALL ".join(_block(p) for p in MAPPING.parties)}),
occ1 AS (SELECT *, {full_name("full_name")} AS full_name_normalized FROM occ0 WHERE length(source_party_key) > 0 OR length(full_name) > 0),
occ2 AS (SELECT *, {tokens("full_name_normalized")} AS name_tokens, {sorted_key("full_name_normalized")} AS name_sorted_key, {phonetic("full_name_normalized")} AS name_phonetic_key,
  {initials("full_name_normalized")} AS name_initials, {affix("full_name", PREFIX)} AS name_prefix_derived, {affix("full_name", SUFFIX)} AS name_suffix_derived,
  {email("email_address")} AS email_normalized, {phone("phone_raw", MAPPING.default_country_code)} AS phone_e164,
  CASE WHEN has_address THEN {address("address_line1", "address_line2")} END AS address_normalized FROM occ1),
occ3 AS (SELECT *, {party_type("name_tokens")} AS party_type, {address_key("address_normalized", "postal_code")} AS address_key FROM occ2),
occ AS (SELECT *, CASE WHEN party_type = 'PERSON' AND len(name_tokens) = 2 THEN name_tokens[1] END AS given_name_derived,
  CASE WHEN party_type = 'PERSON' AND len(name_tokens) = 2 THEN name_tokens[2] END AS surname_derived,
  CASE WHEN party_type = 'PERSON' AND len(name_tokens) = 2 THEN 0.75 ELSE 0.0 END AS name_parse_confidence,
  CASE WHEN party_type = 'PERSON' AND len(name_tokens) = 2 THEN 'RULE_BASED' ELSE 'NOT_PARSED' END AS name_parse_method,
  '{MAPPING.source_system}' || {SEPARATOR} || source_key_kind || {SEPARATOR} || CASE WHEN length(source_party_key) > 0 THEN source_party_key ELSE 'anonymous:' || source_record_id || ':' || role END AS person_id
  FROM occ3),
ordered AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY CAST(date_of_birth IS NOT NULL AS INT) + CAST(email_normalized IS NOT NULL AS INT) + CAST(phone_e164 IS NOT NULL AS INT)
  + CAST(address_key IS NOT NULL AS INT) + CAST(postal_code IS NOT NULL AS INT) DESC, source_record_id, role) AS ord FROM occ),
parties AS (SELECT person_id, {", ".join(f"arg_min({c}, ord) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in COLLAPSED)} FROM ordered GROUP BY person_id),
keys AS ({" UNION ALL ".join(f"SELECT person_id AS id, '{kind}' AS kind, {column} AS key FROM parties WHERE length({column}) > 0" for kind, column in KEYS.items())}),
sizes AS (SELECT kind, key, count(*) AS n FROM keys GROUP BY kind, key),
usable AS (SELECT keys.* FROM keys JOIN sizes USING (kind, key) WHERE n BETWEEN 2 AND {MAX_BLOCK}),
pairs AS (SELECT a.id AS left_id, b.id AS right_id, array_to_string(list_sort(list(DISTINCT a.kind)), '+') AS blocking_keys
  FROM usable a JOIN usable b ON a.kind = b.kind AND a.key = b.key AND a.id < b.id GROUP BY a.id, b.id)
"""


def _compare(column: str, agree) -> str:
    a, b = f"l.{column}", f"r.{column}"
    if agree is scoring.exact:
        body = f"CAST({a} = {b} AS DOUBLE)"
    elif agree is scoring.jaccard:
        x, y = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
        body = f"CAST(len(list_intersect({x}, {y})) AS DOUBLE) / len(list_distinct(list_concat({x}, {y})))"
    elif agree is scoring.prefix_similarity:
        equal = " + ".join(f"CAST(substr({a}, 1, {n}) = substr({b}, 1, {n}) AND least(length({a}), length({b})) >= {n} AS INT)" for n in range(1, 13))
        body = f"least(1.0, CAST({equal} AS DOUBLE) / greatest(length({a}), length({b})))"
    else:
        days = f"abs(date_diff('day', {a}, {b}))"
        body = f"CASE WHEN {days} = 0 THEN 1.0 WHEN {days} <= 2 THEN 0.9 WHEN {days} <= 366 THEN 0.4 ELSE 0.0 END"
    return f"CASE WHEN length(CAST({a} AS VARCHAR)) > 0 AND length(CAST({b} AS VARCHAR)) > 0 THEN CAST({body} AS DOUBLE) END"


_ACTIVE = {f"cmp_{name}": c for name, c in scoring.COMPARATORS.items() if c[0] in COLLAPSED}
_WEIGHED = " + ".join(f"coalesce({name}, 0.0) * CAST({weight} AS DOUBLE)" for name, (_, _, weight, _) in _ACTIVE.items())
_FIRED = {name: f"CASE WHEN {name} IS NOT NULL THEN CAST({weight} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END" for name, (_, _, weight, _) in _ACTIVE.items()}
_CANON = lambda x: case(f"upper({x})", vocab.CANONICAL_GIVEN, f"upper({x})")
_GIVEN = ("coalesce(l_given, '')", "coalesce(r_given, '')")
_GREY = {
    "nickname_match": f"CAST({_CANON(_GIVEN[0])} = {_CANON(_GIVEN[1])} AS DOUBLE)",
    "surname_match": "CAST(coalesce(l_surname, '') = coalesce(r_surname, '') AS DOUBLE)",
    "initial_consistent": f"CAST((length({_GIVEN[0]}) = 1 OR length({_GIVEN[1]}) = 1) AND substr({_GIVEN[0]}, 1, 1) = substr({_GIVEN[1]}, 1, 1) AS DOUBLE)",
    "dob_agree": "coalesce(cmp_dob, 0.5)",
    "contact_agree": "greatest(coalesce(cmp_email, 0.0), coalesce(cmp_phone, 0.0))",
    "address_agree": "coalesce(cmp_address, 0.0)",
    "base_score": "score",
}

SCORED = f"""
compared AS (SELECT left_id, right_id, blocking_keys, {", ".join(f"{_compare(column, agree)} AS {name}" for name, (column, agree, _, _) in _ACTIVE.items())},
  coalesce(abs(date_diff('day', l.date_of_birth, r.date_of_birth)) > 366, false)
    OR coalesce(l.party_type <> r.party_type AND (l.party_type = 'PERSON' OR r.party_type = 'PERSON'), false) AS vetoed,
  l.given_name_derived AS l_given, r.given_name_derived AS r_given, l.surname_derived AS l_surname, r.surname_derived AS r_surname
  FROM pairs JOIN parties l ON l.person_id = left_id JOIN parties r ON r.person_id = right_id),
weighed AS (SELECT *, {" + ".join(_FIRED.values())} AS evidence_weight, CAST(0 AS DOUBLE) + {" + ".join(x for name, x in _FIRED.items() if _ACTIVE[name][3])} AS corroboration FROM compared),
valued AS (SELECT *, CASE WHEN evidence_weight > 0 THEN greatest(0.0, least(1.0, ({_WEIGHED}) / evidence_weight)) ELSE 0.0 END AS score, corroboration < {scoring.MIN_CORROBORATION} AS under_corroborated FROM weighed),
scored AS (SELECT *, CASE WHEN vetoed OR under_corroborated THEN 'AUTO_REJECT' WHEN score >= {scoring.AUTO_MATCH} THEN 'AUTO_MATCH' WHEN score < {scoring.AUTO_REJECT} THEN 'AUTO_REJECT' ELSE 'GREY' END AS zone FROM valued),
featured AS (SELECT *, {", ".join(f"{x} AS {n}" for n, x in _GREY.items())} FROM scored),
judged AS (SELECT *, CASE WHEN zone = 'GREY' THEN greatest(0.0, least(1.0, {" + ".join(f"{n} * CAST({w} AS DOUBLE)" for n, w in scoring.GREY_WEIGHTS.items())})) END AS ai_score FROM featured),
decided AS (SELECT *, CASE WHEN zone = 'AUTO_MATCH' THEN 'MATCH' WHEN zone = 'GREY' THEN CASE WHEN ai_score >= {scoring.GREY_ACCEPT} THEN 'MATCH' ELSE 'NO_MATCH' END ELSE 'NO_MATCH' END AS final_decision,
  CASE WHEN zone = 'GREY' THEN 'AI_FALLBACK' ELSE 'PROBABILISTIC' END AS decided_by FROM judged)
"""

CLUSTERED = """
arcs AS (SELECT left_id AS u, right_id AS v FROM decided WHERE final_decision = 'MATCH' UNION ALL SELECT right_id, left_id FROM decided WHERE final_decision = 'MATCH'),
reach AS (SELECT person_id AS u, person_id AS v FROM parties UNION SELECT reach.u, arcs.v FROM reach JOIN arcs ON reach.v = arcs.u),
clusters AS (SELECT u AS person_id, min(v) AS master_id FROM reach GROUP BY u)
"""

POLICIES = f"""
policies AS (SELECT * FROM (SELECT {", ".join(f"{transformed(f) if f.canonical != 'policy_number' else f'trim({f.source})'} AS {f.canonical}" for f in MAPPING.policy)},
  {policy_number("PolicyNumber")} AS policy_number_normalized, source_record_id, row_number() OVER (PARTITION BY {policy_number("PolicyNumber")} ORDER BY source_record_id) AS n FROM raw) WHERE n = 1 AND length(policy_number_normalized) > 0)
"""

HOUSEHOLDS = f"""
stated AS (SELECT o.person_id AS from_id, i.person_id AS to_id, o.policy_number_normalized AS policy_id, {case("o.stated_relationship", vocab.STATED_RELATIONS, "NULL")} AS association_type
  FROM occ o JOIN occ i ON o.policy_number_normalized = i.policy_number_normalized AND o.role = 'OWNER' AND i.role = 'INSURED' WHERE o.person_id <> i.person_id AND o.stated_relationship IS NOT NULL),
assoc AS (SELECT s.*, coalesce(f.address_key = t.address_key, false) AS same_address FROM
  (SELECT from_id, to_id, association_type, array_to_string(list_sort(list(DISTINCT policy_id)), ',') AS evidence, CAST(count(DISTINCT policy_id) AS INT) AS evidence_count FROM stated WHERE association_type IS NOT NULL GROUP BY ALL) s
  LEFT JOIN parties f ON f.person_id = from_id LEFT JOIN parties t ON t.person_id = to_id),
kin AS (SELECT from_id, to_id FROM assoc JOIN parties f ON f.person_id = from_id JOIN parties t ON t.person_id = to_id
  WHERE association_type IN ('SPOUSE_OF', 'CHILD_OF', 'PARENT_OF') AND f.party_type = 'PERSON' AND t.party_type = 'PERSON'),
kin2 AS (SELECT from_id AS u, to_id AS v FROM kin UNION SELECT to_id, from_id FROM kin),
labels(node, label) USING KEY (node) AS (
  SELECT u, min(least(u, v)) FROM kin2 GROUP BY u
  UNION
  SELECT k.u, min(l.label) FROM labels l JOIN kin2 k ON k.v = l.node JOIN recurring.labels c ON c.node = k.u WHERE l.label < c.label GROUP BY k.u),
homes AS (SELECT label, CAST(count(*) AS INT) AS household_size FROM labels GROUP BY label),
household AS (SELECT p.person_id, h.label, coalesce(h2.household_size, 0) AS household_size FROM parties p LEFT JOIN labels h ON h.node = p.person_id LEFT JOIN homes h2 ON h2.label = h.label)
"""


def sql(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ", ".join([PRELUDE, *more]) + select
