"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to, the same on every engine.
ACCENTED = "áàâäãåçéèêëíìîïñóòôöõőúùûüűýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuuyy"

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
FULL_DATE = r"\b(?:19|20)\d{2}[-./](?:0[1-9]|1[0-2])[-./](?:0[1-9]|[12]\d|3[01])\b"
NINE_DIGITS = r"\b\d{3}[ -]?\d{3}[ -]?\d{3}\b"
PHONE = r"\+\d{1,3}[ -]?\d{1,3}[ -]?\d{3}[ -]?\d{3,4}\b"
#: Forms of trial registry numbers.
REGISTRIES = {"nct": r"\bNCT\d{8}\b", "isrctn": r"\bISRCTN\d{8}\b", "eudract": r"\b20\d{2}-\d{6}-\d{2}\b", "prospero": r"\bCRD42\d{9,10}\b", "actrn": r"\bACTRN126\d{11}\b", "drks": r"\bDRKS\d{8}\b", "chictr": r"\bChiCTR[-A-Z]*\d{8,10}\b", "umin": r"\bUMIN\d{9}\b"}


def folded(text: Column) -> Column:
    """Lower case without accents, other characters as blanks, blanks collapsed."""
    low = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(low, r"[^a-z0-9]+", " "))


def folded_sql(text: str) -> str:
    return f"trim(regexp_replace(translate(lower({text}), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]+', ' ', 'g'))"


def checksum_nine(digits: Column) -> Column:
    """Whether nine digits carry the check digit of weights 3 and 7, modulo 10."""
    total = F.lit(0)
    for k in range(8):
        total = total + F.substring(digits, k + 1, 1).cast("int") * (3 if k % 2 == 0 else 7)
    return total % 10 == F.substring(digits, 9, 1).cast("int")
