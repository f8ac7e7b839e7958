"""The closed set of labels and how raw labels map to it."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The final labels, the raw ones with what they become, and those that are dropped.
FINAL = ("FULLNAME", "AGE", "GENDER", "DATE", "TIME", "STREET", "BUILDINGNUM", "ZIPCODE", "CITY", "PROVINCE", "EMAIL", "TELEPHONENUM", "CF", "PIVA", "ID_DOC", "IBAN", "CREDITCARDNUMBER", "AMOUNT", "TARGA", "ORG", "DOCID", "CATASTO")
PATTERN_ONLY = ("URL",)
RAW = {
    "GIVENNAME": "FULLNAME", "SURNAME": "FULLNAME", "GIUDICE": "FULLNAME", "AVVOCATO": "FULLNAME", "CONVENUTO": "FULLNAME", "ATTORE": "FULLNAME", "TESTIMONE": "FULLNAME",
    "SEX": "GENDER", "TAXNUM": "PIVA", "PEC": "EMAIL", "RG": "DOCID", "IDCARDNUM": "ID_DOC", "PASSPORTNUM": "ID_DOC", "DRIVERLICENSENUM": "ID_DOC", "SOCIALNUM": "ID_DOC", "CONTO": "IBAN",
    "CIG": "DOCID", "CUP": "DOCID", "POLIZZA": "DOCID", "MATRICOLA": "DOCID",
}
DROPPED = ("TITLE", "TRIBUNAL")
#: raw labels that older evaluations didn't map
LATER = ("CIG", "CUP", "POLIZZA", "MATRICOLA")


def mapping(legacy: bool = False) -> dict[str, str | None]:
    out = {k: v for k, v in RAW.items() if not (legacy and k in LATER)}
    return out | dict.fromkeys(DROPPED)


def final_label(raw: Column, legacy: bool = False) -> Column:
    """The final label; null for dropped ones; others as they are."""
    known = F.create_map(*map(F.lit, chain.from_iterable((k, v) for k, v in mapping(legacy).items() if v)))
    return F.when(raw.isin(*DROPPED), F.lit(None)).otherwise(F.coalesce(F.try_element_at(known, raw), raw))


def admitted(label: Column) -> Column:
    return label.isin(*FINAL, *RAW)


def bio_labels(labels: tuple[str, ...] = FINAL) -> list[str]:
    """O, then B- and I- of every label."""
    return ["O", *(f"{p}-{x}" for x in labels for p in "BI")]
