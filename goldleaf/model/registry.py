"""The field registry: every schema, survivorship rule, mask and hash is read off these tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .enums import ENUMS

SURVIVORSHIP = (
    "MOST_RECENT", "MOST_TRUSTED_SOURCE", "MOST_COMPLETE", "MOST_FREQUENT", "FIRST_NON_NULL",
    "AGGREGATE_MAX", "AGGREGATE_MIN", "ANY_TRUE", "DERIVED", "SYSTEM",
)
PII_TIERS = ("NONE", "INDIRECT", "DIRECT", "SENSITIVE")

#: Spark types of the logical types.
SPARK_TYPES: dict[str, T.DataType] = {
    "STRING": T.StringType(), "BOOL": T.BooleanType(), "INT16": T.ShortType(), "INT32": T.IntegerType(), "INT64": T.LongType(),
    "MONEY": T.DecimalType(18, 4), "RATIO": T.DoubleType(), "DATE": T.DateType(), "TIMESTAMP_TZ": T.TimestampType(), "UUID": T.StringType(),
    "LIST_STRING": T.ArrayType(T.StringType()), "LIST_UUID": T.ArrayType(T.StringType()), "JSON": T.StringType(),
}

# Fixed values, one field a line: name, logical type, survivorship, match role, PII tier, field that
# it is derived from, enum, flags (N not null, H in the record hash, I indexed, D derived).
_LINEAGE = """
version INT32 SYSTEM - - - - ND
valid_from TIMESTAMP_TZ SYSTEM - - - - NID
valid_to TIMESTAMP_TZ SYSTEM - - - - D
is_current BOOL SYSTEM - - - - NID
record_hash STRING SYSTEM - - - - ND
source_count INT32 SYSTEM - - - - ND
confidence RATIO SYSTEM - - - - ND
is_curated BOOL SYSTEM - - - - ND
is_deleted BOOL SYSTEM - - - - ND
created_at TIMESTAMP_TZ SYSTEM - - - - ND
updated_at TIMESTAMP_TZ SYSTEM - - - - ND
"""

_POLICY = """
policy_id UUID SYSTEM - - - - NID
policy_number STRING MOST_TRUSTED_SOURCE IDENTIFIER INDIRECT - - NH
policy_number_normalized STRING DERIVED IDENTIFIER - - - NHID
source_system STRING MOST_TRUSTED_SOURCE - - - - NHI
product_code STRING MOST_RECENT - - - - H
product_name STRING MOST_COMPLETE - - - - H
product_line STRING MOST_FREQUENT - - - ProductLine HI
plan_code STRING MOST_RECENT - - - - H
policy_status STRING MOST_RECENT - - - PolicyStatus HI
status_reason STRING MOST_RECENT - - - - H
application_date DATE AGGREGATE_MIN - - - - H
issue_date DATE AGGREGATE_MIN - - - - H
effective_date DATE AGGREGATE_MIN - - - - HI
maturity_date DATE MOST_RECENT - - - - H
termination_date DATE MOST_RECENT - - - - H
paid_to_date DATE AGGREGATE_MAX - - - - H
last_anniversary_date DATE AGGREGATE_MAX - - - - H
currency_code STRING MOST_FREQUENT - - - - H
sum_assured_amount MONEY MOST_RECENT - - - - H
annual_premium_amount MONEY MOST_RECENT - - - - H
modal_premium_amount MONEY MOST_RECENT - - - - H
account_value_amount MONEY MOST_RECENT - - - - H
surrender_value_amount MONEY MOST_RECENT - - - - H
premium_frequency STRING MOST_RECENT - - - PremiumFrequency H
payment_method STRING MOST_RECENT - - - - H
policy_term_years INT16 MOST_RECENT - - - - H
premium_paying_term_years INT16 MOST_RECENT - - - - H
issuing_company_code STRING MOST_TRUSTED_SOURCE - - - - H
branch_code STRING MOST_RECENT - - - - H
distribution_channel STRING MOST_FREQUENT - - - - H
underwriting_class STRING MOST_RECENT - SENSITIVE - - H
issue_jurisdiction STRING MOST_TRUSTED_SOURCE - - - - H
party_count INT16 DERIVED - - - - NHD
data_quality_score RATIO DERIVED - - - - NHD
"""

_PERSON = """
person_id UUID SYSTEM - - - - NID
party_type STRING MOST_FREQUENT VETO - - PartyType NHI
full_name STRING MOST_COMPLETE COMPARATOR DIRECT - - NH
full_name_normalized STRING DERIVED COMPARATOR DIRECT full_name - NHD
name_tokens LIST_STRING DERIVED - DIRECT full_name - NHD
name_sorted_key STRING DERIVED BLOCKING DIRECT full_name - NHID
name_phonetic_key STRING DERIVED BLOCKING DIRECT full_name - NHID
name_initials STRING DERIVED BLOCKING INDIRECT full_name - HD
given_name_derived STRING DERIVED COMPARATOR DIRECT full_name - HD
middle_name_derived STRING DERIVED - DIRECT full_name - HD
surname_derived STRING DERIVED COMPARATOR DIRECT full_name - HD
name_prefix_derived STRING DERIVED - - full_name - HD
name_suffix_derived STRING DERIVED - - full_name - HD
name_parse_confidence RATIO DERIVED - - full_name - HD
name_parse_method STRING DERIVED - - full_name NameParseMethod NHD
date_of_birth DATE MOST_FREQUENT VETO DIRECT - - HI
date_of_death DATE MOST_RECENT - SENSITIVE - - H
gender STRING MOST_FREQUENT COMPARATOR INDIRECT - Gender H
marital_status STRING MOST_RECENT - INDIRECT - MaritalStatus H
national_id_type STRING MOST_TRUSTED_SOURCE - - - NationalIdType H
national_id_hash STRING MOST_TRUSTED_SOURCE IDENTIFIER SENSITIVE - - HI
national_id_last4 STRING MOST_TRUSTED_SOURCE - SENSITIVE - - H
email_address STRING MOST_RECENT - DIRECT - - H
email_normalized STRING DERIVED BLOCKING DIRECT email_address - HID
phone_raw STRING MOST_RECENT - DIRECT - - H
phone_e164 STRING DERIVED BLOCKING DIRECT phone_raw - HID
address_line1 STRING MOST_RECENT - DIRECT - - H
address_line2 STRING MOST_RECENT - DIRECT - - H
city STRING MOST_RECENT - INDIRECT - - H
state_province STRING MOST_RECENT - INDIRECT - - H
postal_code STRING MOST_RECENT COMPARATOR INDIRECT - - H
country_code STRING MOST_RECENT - - - - H
address_normalized STRING DERIVED COMPARATOR DIRECT address_line1 - HD
address_key STRING DERIVED BLOCKING INDIRECT address_line1 - HID
occupation STRING MOST_RECENT - INDIRECT - - H
nationality STRING MOST_RECENT - INDIRECT - - H
customer_since_date DATE AGGREGATE_MIN - - - - H
is_deceased BOOL ANY_TRUE - - - - NH
do_not_contact BOOL ANY_TRUE - - - - NH
is_sanctioned BOOL ANY_TRUE - SENSITIVE - - NH
policy_count INT32 DERIVED - - - - NHD
role_bitmap INT32 DERIVED - - - - NHD
household_id UUID DERIVED - - - - HID
household_size INT32 DERIVED - - - - NHD
affiliation_count INT32 DERIVED - - - - NHD
data_quality_score RATIO DERIVED - - - - NHD
"""

_RELATIONSHIP = """
relationship_id UUID SYSTEM - - - - NID
edge_kind STRING SYSTEM - - - EdgeKind NHI
from_person_id UUID SYSTEM - - - - NHI
to_policy_id UUID SYSTEM - - - - HI
to_person_id UUID SYSTEM - - - - HI
role STRING MOST_TRUSTED_SOURCE - - - PartyRole HI
association_type STRING DERIVED - - - AssociationType HID
role_sequence INT16 MOST_TRUSTED_SOURCE - - - - H
source_party_key STRING MOST_TRUSTED_SOURCE IDENTIFIER INDIRECT - - HI
source_key_kind STRING MOST_TRUSTED_SOURCE - - - - H
source_system STRING MOST_TRUSTED_SOURCE - - - - NHI
ownership_percent RATIO MOST_RECENT - - - - H
benefit_percent RATIO MOST_RECENT - - - - H
effective_from DATE MOST_TRUSTED_SOURCE - - - - H
effective_to DATE MOST_RECENT - - - - H
evidence_policy_ids LIST_UUID DERIVED - - - - HD
evidence_count INT32 DERIVED - - - - NHD
stated_relationship STRING MOST_TRUSTED_SOURCE - - - - HI
derivation_method STRING SYSTEM - - - DerivationMethod NHI
"""


@dataclass(frozen=True)
class FieldSpec:
    """One canonical field and everything that is declared about it."""

    name: str
    logical: str
    survivorship: str
    match: str = "NONE"
    pii: str = "NONE"
    derived_from: str | None = None
    enum: str | None = None
    required: bool = False
    hashed: bool = False
    indexed: bool = False
    derived: bool = False

    def __post_init__(self) -> None:
        if self.derived and self.survivorship not in ("DERIVED", "SYSTEM"):
            raise ValueError(f"{self.name}: a derived field survives as DERIVED or SYSTEM")
        if self.derived_from and not self.derived:
            raise ValueError(f"{self.name}: only a derived field follows another")
        if self.enum and (self.logical != "STRING" or self.enum not in ENUMS):
            raise ValueError(f"{self.name}: an enum is a known one and of type STRING")
        if self.match == "VETO" and self.logical == "RATIO":
            raise ValueError(f"{self.name}: a ratio can't veto")
        if self.survivorship not in SURVIVORSHIP or self.pii not in PII_TIERS:
            raise ValueError(f"{self.name}: unknown survivorship or PII tier")

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES[self.logical]

    @property
    def masked(self) -> bool:
        return PII_TIERS.index(self.pii) >= PII_TIERS.index("DIRECT")

    def struct_field(self) -> T.StructField:
        notes = {"survivorship": self.survivorship, "match_role": self.match, "pii": self.pii}
        notes |= {"derived_from": self.derived_from} if self.derived_from else {}
        notes |= {"enum": list(ENUMS[self.enum])} if self.enum else {}
        return T.StructField(self.name, self.spark_type, not self.required, notes)


@dataclass(frozen=True)
class EntitySpec:
    """An entity: its ordered fields and keys."""

    name: str
    fields: tuple[FieldSpec, ...]
    primary_key: str
    natural_key: tuple[str, ...] = ()
    has_anchor: bool = True

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise ValueError(f"{self.name}: a field is declared twice")
        if unknown := {self.primary_key, *self.natural_key, *(f.derived_from for f in self.fields if f.derived_from)} - set(names):
            raise ValueError(f"{self.name}: {sorted(unknown)} are no fields")

    @property
    def by_name(self) -> dict[str, FieldSpec]:
        return {f.name: f for f in self.fields}

    def select(self, *, survivorship: str | None = None, pii: str | None = None, hashed: bool | None = None, derived: bool | None = None) -> list[FieldSpec]:
        """The fields that have all the given properties."""
        return [
            f
            for f in self.fields
            if (survivorship is None or f.survivorship == survivorship)
            and (pii is None or f.pii == pii)
            and (hashed is None or f.hashed == hashed)
            and (derived is None or f.derived == derived)
        ]

    def schema(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.fields])

    def ddl(self) -> str:
        """CREATE TABLE text of the entity in Spark SQL."""
        lines = [f"  {f.name} {f.spark_type.simpleString()}" + " NOT NULL" * f.required for f in self.fields]
        return f"CREATE TABLE {self.name} (\n" + ",\n".join(lines) + "\n) USING parquet"


def _parse(table: str) -> tuple[FieldSpec, ...]:
    out = []
    for line in table.split("\n"):
        if line:
            name, logical, survivorship, match, pii, parent, enum, flags = line.split()
            none = lambda x, empty=None: empty if x == "-" else x
            out.append(FieldSpec(name, logical, survivorship, none(match, "NONE"), none(pii, "NONE"), none(parent), none(enum), *(c in flags for c in "NHID")))
    return tuple(out)


LINEAGE = _parse(_LINEAGE)
POLICY = EntitySpec("policy", _parse(_POLICY) + LINEAGE, "policy_id", ("source_system", "policy_number_normalized"))
PERSON = EntitySpec("person", _parse(_PERSON) + LINEAGE, "person_id")
RELATIONSHIP = EntitySpec("relationship", _parse(_RELATIONSHIP) + LINEAGE, "relationship_id", has_anchor=False)
ENTITIES = {e.name: e for e in (POLICY, PERSON, RELATIONSHIP)}


def entity(name: str) -> EntitySpec:
    return ENTITIES[name]
