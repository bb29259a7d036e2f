"""Normalisation kernels on single values."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from goldleaf.functions import kernels as K

CASES = [
    ("text", lambda x: K.normalize_text(x), [("  Zoé  D'Arcy-Löwe ", "ZOE D ARCY LOWE"), ("Großmann", "GROSSMANN"), ("Ægir Œhler", "AEGIR OEHLER"), ("", ""), (None, None), ("١٢", "")]),
    ("name", lambda x: K.normalize_full_name(x), [("Prof. Dr. Ada Quill, MBA CPA", "ADA QUILL"), ("MR", "MR"), ("Quill Sr", "QUILL"), ("Sir", "SIR"), (None, None)]),
    ("prefix", lambda x: K.name_prefix(K.normalize_text(x)), [("Prof Dr Ada", "PROF DR"), ("Ada", None), (None, None)]),
    ("suffix", lambda x: K.name_suffix(K.normalize_text(x)), [("Ada Quill Sr", "SR"), ("Ada", None)]),
    ("sorted", lambda x: K.sorted_key(x), [("QUILL ADA", "ADA QUILL"), ("", ""), (None, None)]),
    ("initials", lambda x: K.initials(x), [("ZOE ADA QUILL", "AQZ"), ("", "")]),
    ("party", lambda x: K.party_type(K.name_tokens(K.normalize_full_name(x))), [
        ("Ada Quill", "PERSON"), ("Quill Grandchildren Trust", "TRUST"), ("The Estate of Zoe Quill", "ESTATE"), ("Harbour Lights Brokers GmbH", "ORGANIZATION"), ("", "UNKNOWN"), ("Incledon Cole", "PERSON"), (None, "PERSON")]),
    ("email", lambda x: K.normalize_email(x), [(" Ada.Quill+z@Example.ORG ", "ada.quill+z@example.org"), ("NONE", None), ("a@b", None), ("a b@c.d", None), (None, None)]),
    ("phone", lambda x: K.normalize_phone(x, "44"), [("020 7946 0958", "+442079460958"), ("+44 20 7946 0958", "+442079460958"), ("0044 20 7946 0958", "+442079460958"), ("2079460958", "+442079460958"), ("x221", None), ("", None), (None, None)]),
    ("policy", lambda x: K.normalize_policy_number(x), [("POL-001234", "POL1234"), ("pol 1234", "POL1234"), ("POL1234", "POL1234"), ("POL0001234", "POL1234"), ("AB-1", "AB1"), ("000", "0"), (None, None)]),
    ("address", lambda x: K.normalize_address(x), [("12 High Street", "12 HIGH ST"), ("Northeast Road", "NEAST RD"), ("Placement", "PLMENT"), ("PO Box 9", "POB 9"), (None, "")]),
    ("enum", lambda x: K.normalize_enum(x, {"IN FORCE": "INFORCE"}), [("in-force", "INFORCE"), ("In Force", "INFORCE"), ("other", "UNKNOWN"), (None, "UNKNOWN")]),
    ("date", lambda x: K.parse_date(x, ("%Y-%m-%d", "%d/%m/%Y", "%d-%b-%Y", "%Y%m%d")), [
        ("2001-02-03", datetime.date(2001, 2, 3)), ("03/02/2001", datetime.date(2001, 2, 3)), ("3/2/2001", datetime.date(2001, 2, 3)), ("03-FEB-2001", datetime.date(2001, 2, 3)), ("20010203", datetime.date(2001, 2, 3)), ("31/02/2001", None), ("x", None), (None, None)]),
    ("money", lambda x: K.parse_money(x).cast("string"), [("£1,234.50", "1234.5000"), ("n/a", None), ("-3", "-3.0000"), ("", None)]),
    ("integer", lambda x: K.parse_integer(x), [("12.5", 125), ("30 yrs", 30), ("x", None)]),
    ("boolean", lambda x: K.parse_boolean(x), [(" yes ", True), ("X", True), ("no", False), (None, None)]),
    ("nickname", lambda x: K.canonical_given(x), [("Hank", "HENRY"), ("Henry", "HENRY"), ("", "")]),
    ("shape", lambda x: K.token_shape(x), [("Ada van der Quill", "W-P-P-W"), ("Z 34 D'Arcy", "I-N-S"), (None, ""), ("", "")]),
]


@pytest.mark.parametrize(("name", "kernel", "cases"), CASES, ids=[c[0] for c in CASES])
def test_kernel(spark, name, kernel, cases):
    rows = spark.createDataFrame([(n, x) for n, (x, _) in enumerate(cases)], "n int, x string").select("n", kernel(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in sorted(rows)] == [want for _, want in cases]


@pytest.mark.parametrize(("a", "b", "equal"), [
    ("Katherine Phillips", "Catherine Filips", True), ("Smith", "Smyth", True), ("Jon Kowalski", "John Kovalski", True), ("Steven Clarke", "Stephen Clark", True), ("John Smith", "Mary Jones", False), ("Anna Reed", "Anna Rogers", False),
])
def test_phonetic_collisions(spark, a, b, equal):
    key = lambda x: K.phonetic_key(K.normalize_full_name(F.lit(x)))
    x, y = spark.range(1).select(key(a), key(b)).first()
    assert x and y and (x == y) == equal


def test_address_key_survives_reordering(spark):
    key = lambda a, p: K.address_key(K.normalize_address(F.lit(a)), F.lit(p))
    got = spark.range(1).select(key("Flat 2, 12 High St", "ab1 2cd"), key("12 High Street Apt 2", "AB12CD"), key("High Street", "AB12CD"), key("12 High Street", "")).first()
    assert got[0] == got[1] == "12,2|AB12CD" and got[2] is None and got[3] is None


def test_uuid5(spark):
    space = "6f1a5b3c-9d24-5e77-8a10-2c4e7b91d0f3"
    names = ["a", "", "Zoë", "LIFE\x1f1"]
    got = [r[0] for r in spark.createDataFrame([(n, x) for n, x in enumerate(names)], "n int, x string").orderBy("n").select(K.uuid5(space, F.col("x"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(space), x)) for x in names]
