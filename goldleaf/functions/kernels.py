"""Normalisation kernels: each takes columns and returns a column, without Python on the executors."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

_FROM = "".join(vocab.ACCENTS.values())
_TO = "".join(letter * len(accented) for letter, accented in vocab.ACCENTS.items())
_MARK = "\x01"
_PREFIX = rf"^((?:(?:{'|'.join(vocab.PREFIXES)}) )+)"
_SUFFIX = rf"((?: (?:{'|'.join(vocab.SUFFIXES)}))+)$"
_PHONETIC_PAIRS = {k: v for k, v in vocab.PHONETIC.items() if len(k) == 2}
_PHONETIC_SWAPS = {k: v for k, v in vocab.PHONETIC.items() if len(k) == len(v) == 1}
_PHONETIC_LONGER = {k: v for k, v in vocab.PHONETIC.items() if len(k) == 1 < len(v)}
_ADDRESS_WORDS = rf"( (?:{'|'.join(sorted(vocab.ADDRESS, key=lambda k: (len(k), k)))}))"  # the shortest one wins


def _fold(x: Column, pattern: str, table: Mapping[str, str]) -> Column:
    """One left-to-right pass that replaces what ``pattern`` matches, its one group, by the table.

    Matches are marked and the marked texts replaced, since a pattern can't look its replacement up;
    the mark is in no normalised text.
    """
    marked = F.regexp_replace(x, pattern, f"$1{_MARK}")
    for old, new in table.items():
        marked = F.replace(marked, F.lit(old + _MARK), F.lit(new))
    return marked


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """Value of a small fixed table; null where the key isn't in it."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def filled(x: Column) -> Column:
    """Neither null nor empty."""
    return x.isNotNull() & (F.length(x.cast("string")) > 0)


def strip_accents(x: Column) -> Column:
    out = F.translate(x, _FROM, _TO)
    for old, new in vocab.LIGATURES.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def normalize_text(x: Column) -> Column:
    """Capitals without accents; everything but letters and digits is one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.upper(x)), "[^A-Z0-9 ]+", " "), " +", " "))


def name_prefix(normalized: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(normalized, _PREFIX, 1)), F.lit(""))


def name_suffix(normalized: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(normalized, _SUFFIX, 1)), F.lit(""))


def without_affixes(normalized: Column) -> Column:
    """Normalised text less its leading run of honorifics and its trailing run of suffixes.

    The runs are maximal, so a second pass would find nothing; a lone honorific stays.
    """
    return F.trim(F.regexp_replace(F.regexp_replace(normalized, _PREFIX, ""), _SUFFIX, ""))


def normalize_full_name(x: Column) -> Column:
    return without_affixes(normalize_text(x))


def name_tokens(normalized: Column) -> Column:
    return F.array_remove(F.split(normalized, " "), "")


def sorted_key(normalized: Column) -> Column:
    return F.array_join(F.sort_array(name_tokens(normalized)), " ")


def phonetic_key(normalized: Column) -> Column:
    """Order-free consonant skeleton: sound-alike groups fold, inner vowels and H go, doubles shrink."""
    folded = _fold(normalized, f"({'|'.join(_PHONETIC_PAIRS)})", _PHONETIC_PAIRS)
    folded = F.translate(folded, "".join(_PHONETIC_SWAPS), "".join(_PHONETIC_SWAPS.values()))
    for letter, longer in _PHONETIC_LONGER.items():
        folded = F.replace(folded, F.lit(letter), F.lit(longer))
    bare = F.regexp_replace(F.regexp_replace(folded, r"\BH", ""), r"\B[AEIOUY]+", "")
    return sorted_key(F.regexp_replace(bare, r"([A-Z])\1", "$1"))


def initials(normalized: Column) -> Column:
    return F.array_join(F.sort_array(F.transform(name_tokens(normalized), lambda t: F.substring(t, 1, 1))), "")


def party_type(tokens: Column) -> Column:
    """TRUST, ESTATE, ORGANIZATION by token; UNKNOWN without tokens; PERSON otherwise, also for null."""

    def has(words: Sequence[str]) -> Column:
        return F.coalesce(F.arrays_overlap(tokens, F.array(*map(F.lit, words))), F.lit(False))

    return (
        F.when(has(vocab.TRUST_TOKENS), "TRUST")
        .when(has(vocab.ESTATE_TOKENS), "ESTATE")
        .when(has(vocab.ORGANIZATION_TOKENS), "ORGANIZATION")
        .when(F.size(tokens) == 0, "UNKNOWN")
        .otherwise("PERSON")
    )


def normalize_email(x: Column) -> Column:
    cleaned = F.lower(F.trim(x))
    return F.when(cleaned.rlike(vocab.EMAIL), cleaned)


def normalize_phone(x: Column, country_code: str = "1") -> Column:
    """E.164: + and 00 are international, a leading 0 is national; under eight digits is null."""
    marked, digits = F.regexp_replace(x, "[^0-9+]", ""), F.regexp_replace(x, "[^0-9]", "")
    number = (
        F.when(marked.startswith("+"), digits)
        .when(marked.startswith("00"), F.substring(digits, F.lit(3), F.length(digits)))
        .when(digits.startswith("0"), F.concat(F.lit(country_code), F.substring(digits, F.lit(2), F.length(digits))))
        .otherwise(F.concat(F.lit(country_code), digits))
    )
    return F.when(F.length(digits) >= 8, F.concat(F.lit("+"), number))


def normalize_policy_number(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(x), "[^A-Z0-9]", ""), "^([A-Z]*)0+([0-9])", "$1$2")


def normalize_address(*lines: Column) -> Column:
    """One line in capitals with its common words shortened; empty, not null, where all lines are."""
    joined = F.concat(F.lit(" "), F.concat_ws(" ", *(F.coalesce(normalize_text(x), F.lit("")) for x in lines)))
    folded = _fold(joined, _ADDRESS_WORDS, {f" {k}": f" {v}" for k, v in vocab.ADDRESS.items()})
    return F.trim(F.regexp_replace(folded, r"\s+", " "))


def address_key(normalized_address: Column, postal_code: Column) -> Column:
    """All numbers of the address, sorted as text, and the postcode; null unless both are there."""
    numbers = F.array_join(F.sort_array(F.regexp_extract_all(normalized_address, F.lit(r"(\d+)"), F.lit(1))), ",")
    postcode = F.replace(normalize_text(postal_code), F.lit(" "), F.lit(""))
    return F.when((F.length(numbers) > 0) & (F.length(postcode) > 0), F.concat(numbers, F.lit("|"), postcode))


def normalize_enum(x: Column, vocabulary: Mapping[str, str], default: str = "UNKNOWN") -> Column:
    table = {k.upper().replace(" ", "_"): v for k, v in vocabulary.items()}
    return F.coalesce(lookup(table, F.replace(normalize_text(x), F.lit(" "), F.lit("_"))), F.lit(default))


#: Spark's pattern for each directive that a mapping's date formats may have.
_DIRECTIVES = {"%Y": "yyyy", "%m": "M", "%d": "d", "%b": "MMM", "%B": "MMMM", "%y": "yy", "%H": "H", "%M": "m", "%S": "s"}
DATE_FORMATS = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%Y%m%d", "%d %b %Y")


def date_pattern(directives: str) -> str:
    out = directives
    if "%Y%m%d" in out:  # without separators the fields have a fixed width
        out = out.replace("%m", "MM").replace("%d", "dd")
    for directive, pattern in _DIRECTIVES.items():
        out = out.replace(directive, pattern)
    return out


def date_shape(directives: str) -> str:
    """A pattern that every text of the format fits, and few others do."""
    parts = re.split(r"(%.)", directives)
    return "^" + "".join(("[+-]?[0-9]+" if p[1] not in "bB" else ".+") if p.startswith("%") else re.escape(p) for p in parts if p) + "$"


def parse_date(x: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The first format that fits; null where none does.

    A text of another shape isn't parsed: a failed parse costs an exception.
    """
    text = F.trim(x)
    return F.coalesce(*(F.when(text.rlike(date_shape(f)), F.try_to_timestamp(text, F.lit(date_pattern(f)))) for f in formats)).cast("date")


def parse_money(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9.\-]", "").try_cast("decimal(18,4)")


def parse_integer(x: Column) -> Column:
    """The digits alone, so 12.5 is 125."""
    return F.regexp_replace(x, r"[^0-9\-]", "").try_cast("bigint")


def parse_boolean(x: Column) -> Column:
    return F.upper(F.trim(x)).isin(vocab.BOOLEAN_TRUE)


def canonical_given(x: Column) -> Column:
    upper = F.upper(x)
    return F.coalesce(lookup(vocab.CANONICAL_GIVEN, upper), upper)


def token_shape(x: Column) -> Column:
    """P particle, N number, I initial, W word, S anything else, joined by '-'."""
    tokens = F.filter(F.split(F.trim(F.upper(F.coalesce(x, F.lit("")))), r"\s+"), lambda t: t != "")
    shape = lambda t: (
        F.when(t.isin(vocab.PARTICLES), "P").when(t.rlike(r"^\d+$"), "N").when(t.rlike(r"^\p{L}$"), "I").when(t.rlike(r"^\p{L}+$"), "W").otherwise("S")
    )
    return F.array_join(F.transform(tokens, shape), "-")


def role_group(role: Column) -> Column:
    return lookup(vocab.ROLE_GROUP_OF, role)


def relation_label(association: Column, outgoing: Column) -> Column:
    ways = {k: v[0] for k, v in vocab.RELATION_LABELS.items()}, {k: v[1] for k, v in vocab.RELATION_LABELS.items()}
    words = F.lower(F.replace(association, F.lit("_"), F.lit(" ")))
    return F.coalesce(F.when(outgoing, lookup(ways[0], association)).otherwise(lookup(ways[1], association)), words)


def uuid5(namespace: str, name: Column) -> Column:
    """The RFC 4122 version 5 identifier of a name, as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
