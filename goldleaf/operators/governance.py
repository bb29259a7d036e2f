"""Roles, consent, access records and erasure."""

from __future__ import annotations

import hashlib
import hmac
import secrets
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldleaf.model.enums import ACTIVE_POLICY_STATUSES
from goldleaf.model.registry import PERSON

# What each role may do.
PERMISSIONS = {
    "VIEWER": frozenset("READ SEARCH".split()),
    "OPERATOR": frozenset("READ SEARCH DUPLICATE_CHECK UNMASK".split()),
    "STEWARD": frozenset("READ SEARCH DUPLICATE_CHECK MERGE SPLIT OVERRIDE APPROVE_RULE EXPORT UNMASK".split()),
    "INGESTOR": frozenset("SUBMIT DUPLICATE_CHECK".split()),
    "ADMIN": frozenset("READ SEARCH DUPLICATE_CHECK SUBMIT MERGE SPLIT OVERRIDE APPROVE_RULE ERASE EXPORT UNMASK".split()),
}
TOMBSTONE = "[ERASED]"
RETAINED = frozenset({"full_name", "date_of_birth", "national_id_hash", "national_id_last4"})
NEVER_ERASED = frozenset({"is_sanctioned"})


class AccessDenied(PermissionError):
    """The principal's roles don't allow the action."""


def may(roles: Sequence[str], action: str) -> bool:
    return any(action in PERMISSIONS.get(r, ()) for r in roles)


def authorize(roles: Sequence[str], action: str) -> None:
    if not may(roles, action):
        raise AccessDenied(f"{', '.join(roles) or 'no role'} may not {action}")


@dataclass(frozen=True)
class Principal:
    """Who acts: a name, roles, and a salted hash of the key that proves it."""

    name: str
    roles: tuple[str, ...]
    salt: str
    key_hash: str
    active: bool = True

    def may(self, action: str) -> bool:
        return self.active and may(self.roles, action)


def _key_hash(key: str, salt: str) -> str:
    return hashlib.scrypt(key.encode(), salt=bytes.fromhex(salt), n=1 << 12, r=8, p=1).hex()


def create_principal(name: str, roles: Sequence[str]) -> tuple[Principal, str]:
    """A principal and its key; only the hash is kept, so the key is shown once."""
    if unknown := set(roles) - set(PERMISSIONS):
        raise ValueError(f"unknown roles: {sorted(unknown)}")
    key, salt = secrets.token_urlsafe(32), secrets.token_hex(16)
    return Principal(name, tuple(roles), salt, _key_hash(key, salt)), key


def authenticate(principals: Mapping[str, Principal], name: str, key: str) -> Principal:
    found = principals.get(name)
    if found is None or not found.active or not hmac.compare_digest(found.key_hash, _key_hash(key, found.salt)):
        raise AccessDenied("unknown principal or wrong key")
    return found


def access_record(actor: Column, action: str, person_ids: DataFrame, now: str, masked: bool) -> DataFrame:
    """Rows to append to the access log; nothing ever changes what is in it."""
    return person_ids.select(actor.alias("actor"), F.lit(action).alias("action"), "person_id", F.lit(masked).alias("masked"), F.lit(now).cast("timestamp").alias("accessed_at"))


def consent_history(statements: DataFrame) -> DataFrame:
    """Statements (person_id, purpose, state, stated_at) with valid_to and is_current: each closes the one before."""
    order = Window.partitionBy("person_id", "purpose").orderBy("stated_at", "state")
    return statements.withColumn("valid_to", F.lead("stated_at").over(order)).withColumn("is_current", F.row_number().over(Window.partitionBy("person_id", "purpose").orderBy(F.col("stated_at").desc(), F.col("state").desc())) == 1)


def may_contact(persons: DataFrame, history: DataFrame, purpose: str) -> DataFrame:
    """person_id, may_contact: only with a current GRANTED, never over do_not_contact."""
    granted = history.where(F.col("is_current") & (F.col("purpose") == purpose) & (F.col("state") == "GRANTED")).select("person_id", F.lit(True).alias("__granted"))
    barred = F.coalesce(F.col("do_not_contact"), F.lit(False)) if "do_not_contact" in persons.columns else F.lit(False)
    return persons.join(granted.distinct(), "person_id", "left").select("person_id", (F.coalesce("__granted", F.lit(False)) & ~barred).alias("may_contact"))


def erasable_fields() -> list[str]:
    """Personal fields that are sources of truth; derived ones follow from them."""
    return [f.name for f in PERSON.fields if f.pii != "NONE" and not f.derived and f.name not in NEVER_ERASED]


def derived_from_erased() -> list[str]:
    return [f.name for f in PERSON.fields if f.derived and f.pii != "NONE"]


def erasure_plan(requests: DataFrame, edges: DataFrame, policies: DataFrame) -> DataFrame:
    """person_id, live_contracts, erased_fields, retained_fields, complete for each request.

    With a live contract, what the contract needs is retained and the erasure is partial.
    """
    live = policies.where(F.col("policy_status").isin(*ACTIVE_POLICY_STATUSES)).select("policy_id")
    counted = edges.join(live, "policy_id", "left_semi").groupBy("person_id").agg(F.countDistinct("policy_id").alias("n"))
    planned = requests.select("person_id").distinct().join(counted, "person_id", "left").withColumn("live_contracts", F.coalesce("n", F.lit(0)))
    held = F.col("live_contracts") > 0
    fields = erasable_fields()
    names = lambda xs: F.lit(",".join(sorted(xs)))
    return planned.select(
        "person_id",
        "live_contracts",
        F.when(held, names(set(fields) - RETAINED)).otherwise(names(fields)).alias("erased_fields"),
        F.when(held, names(set(fields) & RETAINED)).otherwise(F.lit("")).alias("retained_fields"),
        (~held).alias("complete"),
    )


def erase(persons: DataFrame, plan: DataFrame) -> DataFrame:
    """All versions of the planned persons with their fields erased: text as a tombstone, the rest null."""
    marked = persons.join(plan.select(F.col("person_id").alias("__id"), F.col("live_contracts").alias("__live")), persons["person_id"] == F.col("__id"), "left")
    kinds, gone = dict(persons.dtypes), set(erasable_fields()) | set(derived_from_erased())

    def erased(name: str) -> Column:
        column = F.col(name)
        if name not in gone:
            return column
        parent = PERSON.by_name[name].derived_from or name
        hit = F.col("__id").isNotNull() & ((F.col("__live") == 0) if parent in RETAINED else F.lit(True))
        empty = F.lit(TOMBSTONE) if kinds[name] == "string" else F.lit(None).cast(kinds[name])
        return F.when(hit & column.isNotNull(), empty).otherwise(column)

    return marked.select(*(erased(c).alias(c) for c in persons.columns))


def redact_landing(landed: DataFrame, records: DataFrame) -> DataFrame:
    """Payloads of these source records as a tombstone; their hashes and keys stay."""
    gone = records.select("source_record_id").distinct().withColumn("__gone", F.lit(True))
    return landed.join(gone, "source_record_id", "left").withColumn("payload", F.when(F.col("__gone"), F.lit(TOMBSTONE)).otherwise(F.col("payload"))).drop("__gone")
