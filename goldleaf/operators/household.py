"""Households and affiliations from what policies state about their owner and insured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldleaf.functions.kernels import lookup, uuid5
from goldleaf.functions.vocab import AFFILIATION, FAMILIAL, STATED_RELATIONS

from .clustering import components
from .store import EDGE_NAMESPACE

HOUSEHOLD_NAMESPACE = "6f1a5b3c-9d24-5e77-8a10-2c4e7b91d0f3"  # fixed value
SUSPICIOUS_HOUSEHOLD = 12


def stated_pairs(edges: DataFrame) -> DataFrame:
    """from_id, to_id, policy_id, association_type: owner and insured of one policy with a known relation."""
    owner = edges.where("role = 'OWNER' AND stated_relationship IS NOT NULL").select(F.col("person_id").alias("from_id"), "policy_id", "stated_relationship")
    insured = edges.where("role = 'INSURED'").select(F.col("person_id").alias("to_id"), "policy_id")
    known = owner.withColumn("association_type", lookup(STATED_RELATIONS, F.col("stated_relationship"))).where("association_type IS NOT NULL")
    return known.join(insured, "policy_id").where("from_id <> to_id")


def structural_pairs(edges: DataFrame) -> DataFrame:
    """from_id, to_id, policy_id, association_type that follow from sharing a policy; nothing groups by them.

    An optional extra: co-owners and co-insured in both directions, who owns cover on whom, and agents.
    """
    kinds = {"OWNER": "OWNER", "JOINT_OWNER": "OWNER", "INSURED": "INSURED", "JOINT_INSURED": "INSURED", "AGENT": "AGENT", "WRITING_AGENT": "AGENT", "SERVICING_AGENT": "AGENT"}
    sided = edges.select("person_id", "policy_id", lookup(kinds, F.col("role")).alias("side")).where("side IS NOT NULL").distinct()
    table = {"OWNER>OWNER": "CO_OWNER", "INSURED>INSURED": "CO_INSURED", "OWNER>INSURED": "OWNER_OF_INSURED", "INSURED>OWNER": "INSURED_OF_OWNER", "OWNER>AGENT": "SERVICED_BY_AGENT", "AGENT>OWNER": "AGENT_SERVICES"}
    left = sided.select(F.col("person_id").alias("from_id"), "policy_id", F.col("side").alias("a"))
    right = sided.select(F.col("person_id").alias("to_id"), "policy_id", F.col("side").alias("b"))
    joined = left.join(right, "policy_id").where("from_id <> to_id")
    return joined.withColumn("association_type", lookup(table, F.concat_ws(">", "a", "b"))).where("association_type IS NOT NULL").drop("a", "b")


def associations(pairs: DataFrame, parties: DataFrame) -> DataFrame:
    """One row for each pair and kind with its evidence and whether both live at one address."""
    grouped = pairs.groupBy("from_id", "to_id", "association_type").agg(F.array_sort(F.collect_set("policy_id")).alias("evidence_policy_ids"))
    for side in ("from", "to"):
        grouped = grouped.join(parties.select(F.col("person_id").alias(f"{side}_id"), F.col("address_key").alias(f"{side}_address")), f"{side}_id", "left")
    same = F.coalesce(F.col("from_address") == F.col("to_address"), F.lit(False))
    return grouped.select("from_id", "to_id", "association_type", "evidence_policy_ids", F.size("evidence_policy_ids").alias("evidence_count"), same.alias("same_address"))


def households(found: DataFrame, parties: DataFrame) -> DataFrame:
    """person_id, household_id, household_size of every party; alone or no person: null and 0."""
    persons = parties.where("party_type = 'PERSON'").select("person_id")
    kin = found.where(F.col("association_type").isin(*FAMILIAL)).select(F.col("from_id").alias("u"), F.col("to_id").alias("v"))
    for side in ("u", "v"):
        kin = kin.join(persons.withColumnRenamed("person_id", side), side, "left_semi")
    grouped = components(kin)
    members = grouped.unionByName(grouped.select(F.col("component").alias("node"), "component").distinct())
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).cast("int").alias("household_size"))
    own = members.join(sizes, "component").select(F.col("node").alias("person_id"), uuid5(HOUSEHOLD_NAMESPACE, F.col("component")).alias("household_id"), "household_size")
    return parties.select("person_id").join(own, "person_id", "left").select("person_id", "household_id", F.coalesce("household_size", F.lit(0)).alias("household_size"))


def affiliations(found: DataFrame) -> DataFrame:
    """person_id, affiliation_count of the parties that affiliations point to."""
    kinds = found.where(F.col("association_type").isin(*AFFILIATION))
    return kinds.groupBy(F.col("to_id").alias("person_id")).agg(F.count(F.lit(1)).cast("int").alias("affiliation_count"))


def membership(parties: DataFrame, found: DataFrame) -> DataFrame:
    """Every party with its household and affiliations: what the golden row is updated with, without a new version."""
    return households(found, parties).join(affiliations(found), "person_id", "left").withColumn("affiliation_count", F.coalesce("affiliation_count", F.lit(0)))


def party_edges(found: DataFrame) -> DataFrame:
    """Associations as PARTY_PARTY relationships with ids that follow from what they join."""
    name = F.concat_ws("|", "from_id", "to_id", "association_type")
    return found.select(
        uuid5(EDGE_NAMESPACE, name).alias("relationship_id"), F.lit("PARTY_PARTY").alias("edge_kind"), F.col("from_id").alias("from_person_id"), F.lit(None).cast("string").alias("to_policy_id"),
        F.col("to_id").alias("to_person_id"), F.lit(None).cast("string").alias("role"), "association_type", "evidence_policy_ids", "evidence_count", "same_address",
    )


def household_of(person: Column | str, memberships: DataFrame) -> DataFrame:
    """The members of a person's household."""
    mine = memberships.where((F.col("person_id") == person) & F.col("household_id").isNotNull()).select("household_id")
    return memberships.join(mine, "household_id", "left_semi")


def relations_of(found: DataFrame) -> DataFrame:
    """person_id, other_id, association_type, outgoing: every association from both ends."""
    out = found.select(F.col("from_id").alias("person_id"), F.col("to_id").alias("other_id"), "association_type", F.lit(True).alias("outgoing"))
    return out.unionByName(found.select(F.col("to_id").alias("person_id"), F.col("from_id").alias("other_id"), "association_type", F.lit(False).alias("outgoing")))


def household_report(memberships: DataFrame) -> DataFrame:
    """households, people, largest, suspicious in one row."""
    sizes = memberships.where("household_id IS NOT NULL").groupBy("household_id").agg(F.max("household_size").alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("households"), F.coalesce(F.sum("n"), F.lit(0)).alias("people"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.count_if(F.col("n") >= SUSPICIOUS_HOUSEHOLD).alias("suspicious"))
