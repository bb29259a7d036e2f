"""Controlled vocabularies: fixed values."""

ENUMS: dict[str, tuple[str, ...]] = {
    name: tuple(members.split())
    for name, members in {
        "PartyType": "PERSON ORGANIZATION TRUST ESTATE UNKNOWN",
        "PartyRole": "OWNER JOINT_OWNER INSURED JOINT_INSURED AGENT WRITING_AGENT SERVICING_AGENT BENEFICIARY CONTINGENT_BENEFICIARY PAYER PAYOR_BANK ASSIGNEE UNKNOWN",
        "AssociationType": "CO_INSURED CO_OWNER OWNER_OF_INSURED INSURED_OF_OWNER SERVICED_BY_AGENT AGENT_SERVICES SPOUSE_OF CHILD_OF PARENT_OF HOUSEHOLD_MEMBER EMPLOYEE_OF TRUST_MEMBER_OF ESTATE_SUBJECT_OF SUSPECTED_DUPLICATE",
        "EdgeKind": "PARTY_POLICY PARTY_PARTY",
        "PolicyStatus": "PROPOSED UNDERWRITING ISSUED INFORCE PAID_UP GRACE LAPSED REINSTATED SURRENDERED MATURED CLAIM_PENDING DEATH_CLAIM EXPIRED CANCELLED NOT_TAKEN_UP UNKNOWN",
        "ProductLine": "LIFE ANNUITY HEALTH DISABILITY CRITICAL_ILLNESS AUTO PROPERTY LIABILITY TRAVEL GROUP OTHER UNKNOWN",
        "PremiumFrequency": "SINGLE ANNUAL SEMI_ANNUAL QUARTERLY MONTHLY FORTNIGHTLY WEEKLY UNKNOWN",
        "Gender": "MALE FEMALE OTHER UNKNOWN",
        "MaritalStatus": "SINGLE MARRIED DIVORCED WIDOWED SEPARATED DOMESTIC_PARTNER UNKNOWN",
        "NationalIdType": "SSN TIN NRIC PASSPORT DRIVING_LICENCE NATIONAL_ID COMPANY_REG_NO OTHER UNKNOWN",
        "NameParseMethod": "NOT_PARSED RULE_BASED STATISTICAL LLM_FALLBACK MANUAL",
        "DerivationMethod": "DETERMINISTIC PROBABILISTIC EMBEDDING AI_FALLBACK MANUAL INHERITED",
        "MatchDecision": "MATCH NO_MATCH REVIEW BLOCKED_BY_RULE",
        "Zone": "AUTO_MATCH GREY AUTO_REJECT",
    }.items()
}
ACTIVE_POLICY_STATUSES = ("ISSUED", "INFORCE", "PAID_UP", "GRACE", "REINSTATED", "CLAIM_PENDING")
