"""Display category, linguistic class and severity of each label, as data and as Columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Which labels belong to which category, class and severity.
CATEGORIES = {
    "PERSON": "PERSON PROPER_NOUN_PERSON KATAKANA_NAME JP_SURNAME WESTERN_FIRST_NAME",
    "LOCATION": "LOCATION PROPER_NOUN_LOCATION ADDRESS PREFECTURE_CITY JP_PREFECTURE_DICT JP_DESIGNATED_CITY WORLD_COUNTRY",
    "ORGANIZATION": "ORGANIZATION PROPER_NOUN_ORG COMPANY DEPARTMENT",
    "CONTACT": "EMAIL_ADDRESS PHONE_NUMBER URL IP_ADDRESS POSTAL_CODE",
    "FINANCIAL": "CREDIT_CARD BANK_ACCOUNT MONETARY_AMOUNT ANNUAL_INCOME INVOICE_NUMBER",
    "CREDENTIAL": "API_KEY SECRET MY_NUMBER DRIVERS_LICENSE PASSPORT DB_CONNECTION LICENSE_NUMBER",
    "IDENTITY": "AGE GENDER DATE BLOOD_TYPE",
    "INTERNAL_ID": "INTERNAL_ID EMPLOYEE_ID CONTRACT_NUMBER PURCHASE_ORDER CUSTOMER_ID PATIENT_ID MEMBER_ID SKU PATENT_NUMBER ASSET_NUMBER",
}
CLASSES = {
    "proper_noun": "PERSON PROPER_NOUN_PERSON KATAKANA_NAME JP_SURNAME WESTERN_FIRST_NAME LOCATION PROPER_NOUN_LOCATION ORGANIZATION PROPER_NOUN_ORG COMPANY",
    "contact": "EMAIL_ADDRESS PHONE_NUMBER URL IP_ADDRESS ADDRESS PREFECTURE_CITY JP_PREFECTURE_DICT JP_DESIGNATED_CITY WORLD_COUNTRY POSTAL_CODE",
    "identifier": "EMPLOYEE_ID MEMBER_ID CUSTOMER_ID PATIENT_ID CONTRACT_NUMBER PURCHASE_ORDER INVOICE_NUMBER INTERNAL_ID DEPARTMENT SKU ASSET_NUMBER LICENSE_NUMBER PATENT_NUMBER DB_CONNECTION",
    "credential": "API_KEY SECRET MY_NUMBER DRIVERS_LICENSE PASSPORT CREDIT_CARD BANK_ACCOUNT",
    "attribute": "AGE GENDER DATE BLOOD_TYPE MONETARY_AMOUNT ANNUAL_INCOME",
}
SEVERITIES = {
    "critical": "MY_NUMBER PASSPORT DRIVERS_LICENSE CREDIT_CARD BANK_ACCOUNT API_KEY SECRET DB_CONNECTION",
    "high": "PERSON PROPER_NOUN_PERSON JP_SURNAME WESTERN_FIRST_NAME EMAIL_ADDRESS PHONE_NUMBER ADDRESS PATIENT_ID",
    "medium": "LOCATION PROPER_NOUN_LOCATION PREFECTURE_CITY JP_PREFECTURE_DICT JP_DESIGNATED_CITY WORLD_COUNTRY PROPER_NOUN_ORG ORGANIZATION COMPANY EMPLOYEE_ID MEMBER_ID CUSTOMER_ID "
    "CONTRACT_NUMBER PURCHASE_ORDER INVOICE_NUMBER INTERNAL_ID DEPARTMENT ASSET_NUMBER LICENSE_NUMBER PATENT_NUMBER MONETARY_AMOUNT ANNUAL_INCOME URL IP_ADDRESS",
    "low": "AGE GENDER DATE BLOOD_TYPE POSTAL_CODE SKU KATAKANA_NAME",
}
USER_CATEGORIES = [*CATEGORIES, "OTHER"]
ORDER = ("critical", "high", "medium", "low")
# What a firm and a full address look like, and word parts of phrases.
FORMAL_COMPANY = "株式会社|㈱|有限会社|㈲|合同会社|合資会社"
FULL_EMAIL = r"[^\s@]+@[^\s@]+\.[a-zA-Z]{2,}"
PHRASES = "ます ません ください いたします 致します 願い 注意 確認 ご了承 申し訳 ありがと よろしく とおり ように ような については ところ ため こと もの それ これ あれ".split()


def flat(groups: dict[str, str]) -> dict[str, str]:
    return {label: group for group, labels in groups.items() for label in labels.split()}


def _lookup(label: Column, groups: dict[str, str], other: str) -> Column:
    table = F.create_map(*map(F.lit, chain(*flat(groups).items())))
    return F.coalesce(F.try_element_at(table, label), F.lit(other))


def category_for(label: Column) -> Column:
    """Display category; force-list labels carry theirs in the name."""
    own = F.regexp_extract(label, "^USER_DEFINED_(.*)$", 1)
    return F.when(own.isin(USER_CATEGORIES), own).otherwise(_lookup(label, CATEGORIES, "OTHER"))


def classification_for(label: Column) -> Column:
    return _lookup(label, CLASSES, "other")


def severity_for(label: Column) -> Column:
    return _lookup(label, SEVERITIES, "low")


def severity_for_surface(label: Column, surface: Column) -> Column:
    """Severity of a label, raised to critical for names, formal companies and full addresses."""
    raised = (
        label.isin("PERSON", "PROPER_NOUN_PERSON")
        | (label.isin("ORGANIZATION", "COMPANY", "PROPER_NOUN_ORG") & F.coalesce(surface.rlike(FORMAL_COMPANY), F.lit(False)))
        | ((label == "EMAIL_ADDRESS") & F.coalesce(surface.rlike(FULL_EMAIL), F.lit(False)))
    )
    return F.when(raised, "critical").otherwise(severity_for(label))


def severity_rank(severity: Column) -> Column:
    """0 for critical to 3 for low and anything unknown."""
    return F.coalesce(*[F.when(F.lower(severity) == s, k) for k, s in enumerate(ORDER)], F.lit(len(ORDER) - 1))


def max_severity(severity: Column) -> Column:
    """Aggregate: the worst severity of a group."""
    return F.element_at(F.array(*map(F.lit, ORDER)), F.min(severity_rank(severity)) + 1)


def is_false_positive_person(surface: Column) -> Column:
    """Long surfaces with polite or verbal phrases are no names."""
    return F.coalesce((F.length(surface) > 6) & surface.rlike("|".join(PHRASES)), F.lit(False))


def table(spark: SparkSession) -> DataFrame:
    """The label dimension: (label, category, classification, severity)."""
    cat, cls, sev = map(flat, (CATEGORIES, CLASSES, SEVERITIES))
    return spark.createDataFrame([(k, cat.get(k, "OTHER"), cls.get(k, "other"), sev.get(k, "low")) for k in sorted({*cat, *cls, *sev})], "label string, category string, classification string, severity string")
