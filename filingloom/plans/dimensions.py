"""The dimension of filing types, parts and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Items allowed in each part.
STRUCTURE = {
    "10-K": {"PART I": "1 1A 1B 1C 2 3 4", "PART II": "5 6 7 7A 8 9 9A 9B 9C", "PART III": "10 11 12 13 14", "PART IV": "15 16"},
    "10-Q": {"PART I": "1 2 3 4", "PART II": "1 1A 2 3 4 5 6"},
    "20-F": {
        "PART I": "1 2 3 4 4A 5 6 7 8 9 10 11 12 12D",
        "PART II": "13 14 15 16 16A 16B 16C 16D 16E 16F 16G 16H 16I",
        "PART III": "17 18 19",
    },
}
# Names of items, in the order of the structure above.
NAMES = {
    "10-K": """BUSINESS RISK_FACTORS UNRESOLVED_STAFF_COMMENTS CYBERSECURITY PROPERTIES LEGAL_PROCEEDINGS MINE_SAFETY
        MARKET_FOR_STOCK SELECTED_FINANCIAL_DATA MD_AND_A MARKET_RISK FINANCIAL_STATEMENTS CHANGES_IN_ACCOUNTING
        CONTROLS_AND_PROCEDURES OTHER_INFORMATION CYBERSECURITY_DISCLOSURES DIRECTORS_AND_OFFICERS EXECUTIVE_COMPENSATION
        SECURITY_OWNERSHIP CERTAIN_RELATIONSHIPS PRINCIPAL_ACCOUNTANT EXHIBITS FORM_10K_SUMMARY""",
    "10-Q": """FINANCIAL_STATEMENTS_P1 MD_AND_A_P1 MARKET_RISK_P1 CONTROLS_AND_PROCEDURES_P1 LEGAL_PROCEEDINGS_P2
        RISK_FACTORS_P2 UNREGISTERED_SALES_P2 DEFAULTS_P2 MINE_SAFETY_P2 OTHER_INFORMATION_P2 EXHIBITS_P2""",
    "SC 13D": "SECURITY_AND_ISSUER IDENTITY_AND_BACKGROUND SOURCE_OF_FUNDS PURPOSE_OF_TRANSACTION INTEREST_IN_SECURITIES CONTRACTS_AND_ARRANGEMENTS EXHIBITS",
    "SC 13G": """SECURITY_AND_ISSUER IDENTITY_AND_BACKGROUND SOURCE_OF_FUNDS OWNERSHIP OWNERSHIP_FIVE_PERCENT_OR_LESS
        OWNERSHIP_ON_BEHALF_OF_ANOTHER SUBSIDIARY_CLASSIFICATION GROUP_MEMBERS NOTICE_OF_DISSOLUTION CERTIFICATION""",
}
# Titles that an item has where its heading gives none.
TITLES = {
    "8-K": """1.01 Entry into a Material Definitive Agreement
1.02 Termination of a Material Definitive Agreement
1.03 Bankruptcy or Receivership
1.04 Mine Safety – Reporting of Shutdowns and Patterns of Violations
1.05 Material Cybersecurity Incidents
2.01 Completion of Acquisition or Disposition of Assets
2.02 Results of Operations and Financial Condition
2.03 Creation of a Direct Financial Obligation or an Obligation under an Off-Balance Sheet Arrangement of a Registrant
2.04 Triggering Events That Accelerate or Increase a Direct Financial Obligation or an Obligation under an Off-Balance Sheet Arrangement
2.05 Costs Associated with Exit or Disposal Activities
2.06 Material Impairments
3.01 Notice of Delisting or Failure to Satisfy a Continued Listing Rule or Standard; Transfer of Listing
3.02 Unregistered Sales of Equity Securities
3.03 Material Modification to Rights of Security Holders
4.01 Changes in Registrant's Certifying Accountant
4.02 Non-Reliance on Previously Issued Financial Statements or a Related Audit Report or Completed Interim Review
5.01 Changes in Control of Registrant
5.02 Departure of Directors or Certain Officers; Election of Directors; Appointment of Certain Officers; Compensatory Arrangements of Certain Officers
5.03 Amendments to Articles of Incorporation or Bylaws; Change in Fiscal Year
5.04 Temporary Suspension of Trading Under Registrant's Employee Benefit Plans
5.05 Amendments to the Registrant's Code of Ethics, or Waiver of a Provision of the Code of Ethics
5.06 Change in Shell Company Status
5.07 Submission of Matters to a Vote of Security Holders
5.08 Shareholder Director Nominations
6.01 ABS Informational and Computational Material
6.02 Change of Servicer or Trustee
6.03 Change in Credit Enhancement or Other External Support
6.04 Failure to Make a Required Distribution
6.05 Securities Act Updating Disclosure
6.06 Static Pool
7.01 Regulation FD Disclosure
8.01 Other Events
9.01 Financial Statements and Exhibits""",
    "SC 13D": """1 Security and Issuer
2 Identity and Background
3 Source and Amount of Funds or Other Consideration
4 Purpose of Transaction
5 Interest in Securities of the Issuer
6 Contracts, Arrangements, Understandings or Relationships with Respect to Securities of the Issuer
7 Material to be Filed as Exhibits""",
    "SC 13G": """1 Security and Issuer
2 Identity and Background
3 Source and Amount of Funds or Other Consideration
4 Ownership
5 Ownership of Five Percent or Less of a Class
6 Ownership of More than Five Percent on Behalf of Another Person
7 Identification and Classification of the Subsidiary Which Acquired the Security Being Reported on by the Parent Holding Company
8 Identification and Classification of Members of the Group
9 Notice of Dissolution of Group
10 Certification""",
}
FILING_TYPES = ("10-K", "10-Q", "20-F", "8-K", "SC 13D", "SC 13G")


def structure_rows() -> list[tuple[str, str, str]]:
    return [(t, part, f"ITEM {i}") for t, parts in STRUCTURE.items() for part, items in parts.items() for i in items.split()]


def title_rows() -> list[tuple[str, str, str]]:
    return [(t, *line.split(" ", 1)) for t, text in TITLES.items() for line in text.split("\n")]


def filing_structure(spark: SparkSession) -> DataFrame:
    """(filing_type, part, item)"""
    return spark.createDataFrame(structure_rows(), "filing_type string, part string, item string")


def filing_items(spark: SparkSession) -> DataFrame:
    """(filing_type, code, enum_name, part, item, title): a row for each named item."""
    titles = {(t, c): title for t, c, title in title_rows()}
    rows = []
    for t, names in NAMES.items():
        own = [(p, i) for k, p, i in structure_rows() if k == t] or [(None, f"ITEM {c}") for k, c, _ in title_rows() if k == t]
        rows += [(t, i[5:], n, p, i, titles.get((t, i[5:]))) for n, (p, i) in zip(names.split(), own)]
    rows += [("8-K", c, "ITEM_" + c.replace(".", "_"), None, f"ITEM {c}", title) for t, c, title in title_rows() if t == "8-K"]
    return spark.createDataFrame(rows, "filing_type string, code string, enum_name string, part string, item string, title string")


def section_titles(spark: SparkSession) -> DataFrame:
    """(filing_type, part, item, title): every section a filing type may have, parts without an item among them."""
    rows = [(t, p, i, None) for t, p, i in structure_rows()] + [(t, p, None, None) for t, parts in STRUCTURE.items() for p in parts]
    rows += [(t, None, f"ITEM {c}", title) for t, c, title in title_rows()]
    return spark.createDataFrame(rows, "filing_type string, part string, item string, title string")
