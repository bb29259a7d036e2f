"""A wide policy-grain extract made from the provided order tables, as one SQL text for two dialects.

Every column is text, one row is one policy, and the mess is deliberate and deterministic: policy
numbers, dates, money, telephone numbers and names come in several spellings, attributes are missing,
some customers have a second number, and parties include trusts, estates and companies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from goldleaf.tables import read_table

GIVEN = "John,Mary,Robert,Kate,William,José,Anna,Thomas,Élise,David,Susan,Peter,Zoë,James,Catherine,Bob,Liz,Michael,Åsa,Daniel,Steven,Sophie,George,Bill"
SURNAME = (
    "Smith,Jones,O'Brien,Müller,Kowalski,Phillips,Filips,Clarke,Smyth,van der Berg,García,Taylor,Brown,Wright,Knight,Walker,"
    "White,Evans,Thompson,Gray,Hughes,Edwards,Cox,Schmidt,Novák,Ferreira,Adams,Baker,Nelson,Carter,Mitchell,Turner,Parker,Collins,Stewart,Morris,Rogers,Reed"
)
TOWNS = "Leeds,York,Bath,Exeter,Derby,Perth,Truro,Wells,Ely,Ripon"


@dataclass(frozen=True)
class Dialect:
    """The few functions that the two engines spell differently."""

    iso: str
    dmy: str
    dby: str
    plus: str
    money: str
    relation: str


SPARK = Dialect(
    "date_format({0}, 'yyyy-MM-dd')", "date_format({0}, 'dd/MM/yyyy')", "date_format({0}, 'dd-MMM-yyyy')", "date_add(DATE '1935-01-01', CAST({0} AS INT))", "format_number({0}, 2)", "{{{0}}}"
)
DUCKDB = Dialect(
    "strftime({0}, '%Y-%m-%d')", "strftime({0}, '%d/%m/%Y')", "strftime({0}, '%d-%b-%Y')", "(DATE '1935-01-01' + CAST({0} AS INT))", "format('{{:,.2f}}', {0})", "{0}"
)


def _spelt_date(d: Dialect, date: str, way: str) -> str:
    return f"CASE {way} WHEN 0 THEN {d.iso.format(date)} WHEN 1 THEN {d.dmy.format(date)} ELSE {d.dby.format(date)} END"


def _quoted(words: str) -> str:
    return "'" + words.replace("'", "''") + "'"


def _party(d: Dialect, role: str, c: str, k: str) -> str:
    """Columns of one person block for customer number ``c`` on policy ``k``."""
    given = f"split_part({_quoted(GIVEN)}, ',', CAST({c} % 24 AS INT) + 1)"
    surname = f"split_part({_quoted(SURNAME)}, ',', CAST(CAST(floor({c} / 24) AS INT) % 38 AS INT) + 1)"
    twin = f"({k} % 11 = 0)"
    name = f"""CASE WHEN {c} % 29 = 0 THEN 'The ' || {surname} || ' Family Trust' WHEN {c} % 31 = 0 THEN {surname} || ' Insurance Brokers Pty Ltd'
      WHEN {c} % 37 = 0 THEN 'Estate of ' || {given} || ' ' || {surname}
      WHEN {k} % 7 = 0 THEN 'Mr ' || {given} || ' ' || {surname} WHEN {k} % 7 = 1 THEN upper({surname}) || '  ' || {given}
      WHEN {k} % 7 = 2 THEN 'Dr. ' || {given} || ' ' || {surname} || ', PhD' WHEN {k} % 53 = 0 THEN {given} || ' J ' || {surname}
      WHEN {k} % 59 = 0 THEN '' WHEN {k} % 61 = 0 THEN 'N/A' ELSE {given} || ' ' || {surname} END"""
    number = f"CAST(2079000000 + {c} * 13 AS STRING)"
    phone = f"""CASE WHEN {k} % 7 = 3 THEN '' WHEN {k} % 4 = 0 THEN '0' || {number} WHEN {k} % 4 = 1 THEN '+44 ' || {number}
      WHEN {k} % 4 = 2 THEN '0044' || {number} ELSE '(0)' || substr({number}, 1, 3) || '-' || substr({number}, 4) END"""
    email = f"CASE WHEN {twin} OR {k} % 4 = 3 THEN '' WHEN {k} % 41 = 0 THEN 'NONE' ELSE ' Party' || CAST({c} AS STRING) || '@Example.com ' END"
    line1 = f"CAST({c} % 180 + 1 AS STRING) || CASE {c} % 3 WHEN 0 THEN ' High Street' WHEN 1 THEN ' Northeast Road' ELSE ' Placement Avenue' END"
    return f"""
      CASE WHEN {c} % 43 = 0 THEN '' WHEN {twin} THEN 'D-' || lpad(CAST({c} AS STRING), 6, '0') ELSE 'C-' || lpad(CAST({c} AS STRING), 6, '0') END AS {role}CustomerId,
      {name} AS {role}Name,
      CASE WHEN {k} % 10 = 9 THEN '' ELSE {_spelt_date(d, d.plus.format(f"({c} * 37 % 24000)"), f"{k} % 3")} END AS {role}DOB,
      CASE {c} % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'female' WHEN 2 THEN 'Male' WHEN 3 THEN 'F' ELSE '?' END AS {role}Gender,
      {email} AS {role}Email,
      {phone} AS {role}Phone,
      CASE WHEN {twin} THEN NULL ELSE {line1} END AS {role}Address1,
      CASE WHEN {c} % 6 = 0 THEN 'Flat ' || CAST({c} % 9 + 1 AS STRING) ELSE '' END AS {role}Address2,
      split_part('{TOWNS}', ',', CAST({c} % 10 AS INT) + 1) AS {role}City,
      CASE WHEN {c} % 13 = 0 THEN '' ELSE 'ab' || CAST({c} % 80 + 10 AS STRING) || ' ' || CAST({c} % 9 AS STRING) || 'cd' END AS {role}Postcode,
      'GB' AS {role}Country,
      CASE WHEN {c} % 4 = 0 THEN 'Engineer' ELSE NULL END AS {role}Occupation"""


def extract_sql(d: Dialect) -> str:
    """One SELECT over orders, customer and lineitem."""
    orders, customer, lineitem = (d.relation.format(t) for t in ("orders", "customer", "lineitem"))
    k, c, i, day = "o.o_orderkey", "o.o_custkey", "((o.o_custkey * 7 + 3) % n.customers + 1)", "CAST(o.o_orderdate AS DATE)"
    return f"""
    SELECT
      'R-' || lpad(CAST({k} AS STRING), 9, '0') AS source_record_id,
      CASE {k} % 3 WHEN 0 THEN 'POL-' || lpad(CAST({k} AS STRING), 8, '0') WHEN 1 THEN 'pol ' || CAST({k} AS STRING) ELSE 'POL' || CAST({k} AS STRING) END AS PolicyNumber,
      'P' || CAST({k} % 12 AS STRING) AS ProductCode,
      CASE {k} % 5 WHEN 0 THEN 'Term life' WHEN 1 THEN 'Whole-Life' WHEN 2 THEN 'annuity' WHEN 3 THEN 'Health' ELSE 'Unit linked' END AS ProductLine,
      CASE o.o_orderstatus WHEN 'F' THEN 'Matured' WHEN 'O' THEN 'In Force' ELSE 'pending' END AS Status,
      CASE {k} % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'Quarterly' WHEN 2 THEN 'H' WHEN 3 THEN 'annual' WHEN 4 THEN 'Y' ELSE 'weekly' END AS PremiumFrequency,
      substr(o.o_orderpriority, 3) AS Channel,
      {_spelt_date(d, day, f"{k} % 3")} AS IssueDate,
      CASE WHEN {k} % 17 = 0 THEN '31/02/1999' WHEN {k} % 19 = 0 THEN NULL ELSE {_spelt_date(d, day, f"({k} + 1) % 3")} END AS EffectiveDate,
      CASE WHEN {k} % 2 = 0 THEN '£' || {d.money.format('o.o_totalprice')} ELSE {d.money.format('o.o_totalprice')} END AS SumAssured,
      CASE WHEN {k} % 23 = 0 THEN 'n/a' ELSE CAST(CAST(floor(o.o_totalprice) AS INT) % 5000 AS STRING) || '.5' END AS AnnualPremium,
      CAST({k} % 30 + 1 AS STRING) || CASE WHEN {k} % 2 = 0 THEN ' yrs' ELSE '' END AS PolicyTerm,
      {d.iso.format(day)} AS LastUpdatedTs,
      {_party(d, "Owner", c, k)},
      CASE {k} % 9 WHEN 0 THEN ' spouse ' WHEN 1 THEN 'Child' WHEN 2 THEN 'PARENT' WHEN 3 THEN 'SELF' WHEN 4 THEN 'Employer' WHEN 5 THEN 'trustee' WHEN 6 THEN 'godparent' WHEN 7 THEN '' ELSE NULL END AS OwnerRelationshipToInsured,
      {_party(d, "Insured", i, k)},
      'A-' || lpad(CAST(l.l_suppkey AS STRING), 5, '0') AS AgentCode,
      split_part({_quoted(GIVEN)}, ',', CAST(l.l_suppkey % 24 AS INT) + 1) || ' ' || split_part({_quoted(SURNAME)}, ',', CAST(l.l_suppkey % 38 AS INT) + 1) AS AgentName,
      'agent' || CAST(l.l_suppkey AS STRING) || '@agency.example' AS AgentEmail,
      '0' || CAST(1130000000 + l.l_suppkey AS STRING) AS AgentPhone
    FROM {orders} o
    JOIN (SELECT l_orderkey, l_suppkey FROM {lineitem} WHERE l_linenumber = 1) l ON l.l_orderkey = {k}
    CROSS JOIN (SELECT count(*) AS customers FROM {customer}) n
    """


def policy_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extract; the row count of customer that it needs is a single row by construction.

    Orders are dealt by the key of the join that follows, so a single small file keeps all cores busy
    and a large table isn't dealt twice.
    """
    tables = {t: read_table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem")}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tables["orders"] = tables["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority").repartition(parts, "o_orderkey")
    return spark.sql(extract_sql(SPARK), **tables)
