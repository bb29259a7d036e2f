"""The declared quality gate: which checks a party row fails."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldleaf.functions.kernels import filled
from goldleaf.functions.vocab import PLACEHOLDER

MAX_NAME_TOKENS = 6
EARLIEST_BIRTH, LATEST_BIRTH = "1900-01-01", "2020-01-01"


@dataclass(frozen=True)
class Check:
    """``holds`` is true for an acceptable row; where ``applies`` isn't true the row passes."""

    name: str
    field: str
    needs: tuple[str, ...]
    holds: str
    applies: str | None = None

    def fails(self) -> Column:
        failed = ~F.coalesce(F.expr(self.holds), F.lit(False))
        return failed if self.applies is None else F.coalesce(F.expr(self.applies), F.lit(False)) & failed


def _there(column: str) -> str:
    return f"({column} IS NOT NULL AND length(cast({column} AS string)) > 0)"


_IS_PERSON = "party_type = 'PERSON'"
CHECKS = (
    Check("name_present", "full_name", ("full_name_normalized",), _there("full_name_normalized")),
    Check("name_token_count", "full_name", ("name_tokens", "party_type"), f"size(name_tokens) BETWEEN 2 AND {MAX_NAME_TOKENS}", _IS_PERSON),
    Check("name_no_digits", "full_name", ("full_name_normalized",), "NOT full_name_normalized RLIKE '[0-9]'"),
    Check("name_parsed_cleanly", "full_name", ("given_name_derived", "surname_derived", "party_type"), f"{_there('given_name_derived')} AND {_there('surname_derived')}", _IS_PERSON),
    Check("name_not_placeholder", "full_name", ("full_name_normalized",), f"NOT full_name_normalized RLIKE '{PLACEHOLDER}'"),
    Check("name_has_phonetic_key", "full_name", ("name_phonetic_key",), _there("name_phonetic_key")),
    Check("email_syntax", "email_address", ("email_address", "email_normalized"), _there("email_normalized"), _there("email_address")),
    Check("phone_syntax", "phone_raw", ("phone_raw", "phone_e164"), _there("phone_e164"), _there("phone_raw")),
    Check("address_has_number", "address_line1", ("address_line1", "address_normalized"), "address_normalized RLIKE '[0-9]'", _there("address_line1")),
    Check("address_has_postcode", "postal_code", ("address_line1", "postal_code"), _there("postal_code"), _there("address_line1")),
    Check("address_split", "address_line1", ("address_line1", "address_key", "city"), f"{_there('address_key')} AND {_there('city')}", _there("address_line1")),
    Check("dob_plausible", "date_of_birth", ("date_of_birth",), f"date_of_birth > DATE '{EARLIEST_BIRTH}' AND date_of_birth < DATE '{LATEST_BIRTH}'", "date_of_birth IS NOT NULL"),
)


def checks_for(columns: list[str], fields: list[str] | None = None) -> list[Check]:
    """The checks whose columns are there, on the given fields only if any are given."""
    return [c for c in CHECKS if set(c.needs) <= set(columns) and (fields is None or c.field in fields)]


def apply_gate(rows: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """failed_checks, in declared order, and gate_passed."""
    named = [F.when(c.fails(), c.name) for c in checks_for(rows.columns, fields)]
    failed = F.filter(F.array(*named), lambda x: x.isNotNull()) if named else F.array().cast("array<string>")
    return rows.withColumn("failed_checks", failed).withColumn("gate_passed", F.size("failed_checks") == 0)


def gate_summary(gated: DataFrame) -> DataFrame:
    """check_name, failures, failure_rate of the checks that any row fails."""
    total = gated.agg(F.count(F.lit(1)).alias("total"))
    failed = gated.select(F.explode("failed_checks").alias("check_name")).groupBy("check_name").agg(F.count(F.lit(1)).alias("failures"))
    return failed.crossJoin(total).select("check_name", "failures", F.round(F.col("failures") / F.col("total"), 6).alias("failure_rate"))


__all__ = ["CHECKS", "Check", "apply_gate", "checks_for", "filled", "gate_summary"]
