"""What becomes of rows that fail the gate: one request a row, a deterministic standardiser, write-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldleaf.functions.kernels import filled
from goldleaf.functions.vocab import PARTICLES

#: The field to ask about for a failed check.
CHECK_FIELD = {
    "name_token_count": "full_name",
    "name_parsed_cleanly": "full_name",
    "name_no_digits": "full_name",
    "address_has_number": "address_line1",
    "address_split": "address_line1",
    "phone_syntax": "phone_raw",
}
FALLBACK_CONFIDENCE = 0.6


def requests(gated: DataFrame, id_column: str = "person_id") -> DataFrame:
    """id, field_name, raw_value, deterministic_value: one for each failing row that has something to ask about."""
    table = F.create_map(*(F.lit(x) for pair in CHECK_FIELD.items() for x in pair))
    asked = F.get(F.filter(F.transform("failed_checks", lambda c: F.try_element_at(table, c)), lambda f: f.isNotNull()), F.lit(0))
    values = {f: F.col(f).cast("string") for f in set(CHECK_FIELD.values()) if f in gated.columns}
    raw = F.coalesce(*(F.when(F.col("field_name") == f, c) for f, c in sorted(values.items())))
    rows = gated.where("NOT gate_passed").withColumn("field_name", asked).withColumn("raw_value", raw)
    rows = rows.where(F.length(F.trim("raw_value")) > 0)
    first = F.get(F.filter("failed_checks", lambda c: F.try_element_at(table, c).isNotNull()), F.lit(0))
    return rows.select(id_column, "field_name", "raw_value", F.col("full_name_normalized").alias("deterministic_value"), first.alias("failed_check"), "party_type")


def name_parts(value: Column) -> Column:
    """struct(given, middle, surname, confidence) of a name: particles bind to the surname, a comma turns the order."""
    comma = F.locate(",", value)
    turned = F.when(comma > 0, F.concat_ws(" ", F.trim(F.substr(value, comma + 1)), F.trim(F.substr(value, F.lit(1), comma - 1)))).otherwise(value)
    tokens = F.filter(F.split(F.upper(F.trim(turned)), r"\s+"), lambda t: t != "")
    n = F.size(tokens)
    # Particles right before the last token, counted from the end; the first token is never one.
    before = F.reverse(F.slice(tokens, F.lit(2), F.greatest(n - 2, F.lit(0))))
    run = F.aggregate(before, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, t: F.struct((a["n"] + (a["on"] & t.isin(PARTICLES)).cast("int")).alias("n"), (a["on"] & t.isin(PARTICLES)).alias("on")))["n"]
    middle = F.slice(tokens, F.lit(2), F.greatest(n - 2 - run, F.lit(0)))
    plain = (F.size(middle) == 0) | F.forall(middle, lambda m: F.length(m) == 1)
    split = F.struct(
        F.get(tokens, F.lit(0)).alias("given"),
        F.array_join(middle, " ").alias("middle"),
        F.array_join(F.slice(tokens, n - run, run + 1), " ").alias("surname"),
        F.when(plain, 0.9).otherwise(0.7).alias("confidence"),
    )
    return F.when(n >= 2, split)


def spaced_address(value: Column) -> Column:
    """Letters and digits that ran together, apart; null where there is no number."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(value, r"(?<=[A-Za-z])(?=\d)|(?<=\d)(?=[A-Za-z])", " "), r"\s+", " "))
    return F.when(spaced.rlike(r"\d"), F.upper(spaced))


def longest_phone(value: Column, country_code: str) -> Column:
    """E.164 of the telephone-like run with most digits; null under eight."""
    runs = F.transform(F.regexp_extract_all(value, F.lit(r"(\d[\d ()-]{6,})"), F.lit(1)), lambda r: F.regexp_replace(r, r"\D", ""))
    digits = F.aggregate(runs, F.lit(""), lambda best, r: F.when(F.length(r) > F.length(best), r).otherwise(best))
    national = F.when(digits.startswith("0"), F.substr(digits, F.lit(2))).otherwise(digits)
    return F.when(F.length(digits) >= 8, F.concat(F.lit(f"+{country_code}"), national))


def standardise(asked: DataFrame, country_code: str = "1") -> DataFrame:
    """Requests with given, middle, surname, address, phone, confidence and ai_resolved."""
    named = F.when(F.col("field_name") == "full_name", F.when(F.locate(",", F.col("raw_value")) > 0, F.col("raw_value")).otherwise(F.coalesce("deterministic_value", "raw_value")))
    out = asked.withColumn("__name", name_parts(named))
    out = out.withColumns(
        {
            "given": F.col("__name.given"),
            "middle": F.col("__name.middle"),
            "surname": F.col("__name.surname"),
            "address": F.when(F.col("field_name") == "address_line1", spaced_address(F.col("raw_value"))),
            "phone": F.when(F.col("field_name") == "phone_raw", longest_phone(F.col("raw_value"), country_code)),
        }
    )
    confidence = F.coalesce("__name.confidence", F.when(F.col("address").isNotNull(), 0.75), F.when(F.col("phone").isNotNull(), 0.65))
    return out.withColumns({"confidence": F.coalesce(confidence, F.lit(0.0)), "ai_resolved": confidence.isNotNull()}).drop("__name")


def write_back(rows: DataFrame, answers: DataFrame, id_column: str = "person_id") -> DataFrame:
    """Fill what is empty, by id, and mark the names so; nothing that is there is changed."""
    own = answers.where("ai_resolved").select(id_column, *(F.col(c).alias(f"__{c}") for c in ("given", "middle", "surname", "address", "phone")))
    joined = rows.join(own, id_column, "left")
    filled_by = {"given_name_derived": "__given", "middle_name_derived": "__middle", "surname_derived": "__surname", "address_normalized": "__address", "phone_e164": "__phone"}
    named = F.col("__surname").isNotNull() & ~F.coalesce(filled(F.col("surname_derived")), F.lit(False))
    marks = {"name_parse_method": F.when(named, "LLM_FALLBACK").otherwise(F.col("name_parse_method")), "name_parse_confidence": F.when(named, FALLBACK_CONFIDENCE).otherwise(F.col("name_parse_confidence"))}
    values = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.nullif(F.col(x), F.lit("")), F.col(c)) for c, x in filled_by.items() if c in rows.columns}
    return joined.withColumns(values | marks).drop(*filled_by.values())
