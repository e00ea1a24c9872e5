"""Masks: what replaces a match, by type. Each is a function (type, text, char before) -> Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: tags ------------------------------------------------------------------------

BRIEF_TAGS = {"EMAIL": "[EMAIL]", "PHONE_NUMBER": "[PHONE]", "ADDRESS": "[ADDR]", "CREDIT_CARD": "[CC]", "SSN": "[SSN]", "DATE": "[DATE]", "PERSON": "[PER]", "URL": "[URL]", "IP_ADDRESS": "[IP]", "ORGANIZATION": "[ORG]", "LOCATION": "[LOC]", "FR_NAME": "[PER]", "FR_ADDRESS": "[ADDR]", "FR_SSN": "[SSN]", "FR_TAX_ID": "[TAX]", "FR_PHONE": "[PHONE]", "FR_SIRET": "[SIRET]"}
SHORT_TAGS = {"EMAIL_ADDRESS": "[EMAIL]", "PHONE_NUMBER": "[PHONE]", "SSN": "[SSN]", "CREDIT_CARD": "[CREDIT_CARD]", "BANK_ACCOUNT": "[BANK_ACCOUNT]", "IBAN": "[IBAN]", "SWIFT_BIC": "[SWIFT_BIC]", "VAT_NUMBER": "[VAT]", "INVOICE_NUMBER": "[INVOICE]", "PERSON": "[PERSON]", "LOCATION": "[LOCATION]", "ORGANIZATION": "[ORGANIZATION]", "CRYPTO_WALLET": "[CRYPTO]", "PAYMENT_TOKEN": "[PAYMENT_TOKEN]", "CURRENCY_AMOUNT": "[CURRENCY]"}
PARTIAL_TAGS = {"DATE": "[DATE]", "PASSPORT": "[PASSPORT]", "PERSON": "[PERSON]", "LOCATION": "[LOCATION]", "ORGANIZATION": "[ORGANIZATION]", "ADDRESS": "[ADDRESS]"}
FINANCIAL_TAGS = {
    "AR_IBAN_SA": "[IBAN-SA]", "AR_IBAN_UAE": "[IBAN-UAE]", "AR_BANK_ACCOUNT": "[حساب]", "AR_BANK_NAME": "[بنك]", "AR_AMOUNT": "[مبلغ]", "AR_CREDIT_CARD": "[بطاقة]",
    "FR_IBAN": "[IBAN]", "FR_BIC": "[BIC]", "FR_ACCOUNT_NUMBER": "[COMPTE]", "FR_BANK_NAME": "[BANQUE]", "FR_AMOUNT": "[MONTANT]",
    "EN_IBAN": "[IBAN]", "EN_SORT_CODE": "[SORT]", "EN_ACCOUNT_NUMBER": "[ACC]", "EN_BIC": "[BIC]", "EN_BANK_NAME": "[BANK]", "EN_AMOUNT": "[AMT]",
}
ARABIC_DEFAULT = "محجوب"
#: Characters to mask (-1: all), and whether from the end, by type.
MASK_N = {"EMAIL_ADDRESS": (8, False), "CREDIT_CARD": (12, True), "BANK_ACCOUNT": (8, True), "PHONE_NUMBER": (6, True), "PERSON": (-1, False), "LOCATION": (-1, False), "ORGANIZATION": (-1, False), "FINANCIAL_INFO": (10, True), "CRYPTO_WALLET": (30, False), "IBAN": (16, True), "SWIFT_BIC": (6, False), "SSN": (5, True), "VAT_NUMBER": (8, True), "PAYMENT_TOKEN": (8, True), "INVOICE_NUMBER": (6, True)}
FRENCH_REPLACEMENTS = {"PERSON": "<PERSONNE>", "LOCATION": "<LIEU>", "ORGANIZATION": "<ORGANISATION>"}
FRENCH_MASKS = {"PHONE_NUMBER": ("*", 12, True), "EMAIL_ADDRESS": ("@", 10, True), "CREDIT_CARD": ("#", 16, True), "US_SSN": ("#", 11, False)}
FRENCH_DEFAULT = "<ANONYMISÉ>"


def lookup(table: dict[str, str], kind: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), kind), default)


def mask_n(x: Column, n: int, char: str = "*", from_end: bool = False) -> Column:
    """n characters masked from the start or end; -1: all."""
    size = F.length(x)
    hidden = size if n < 0 else F.least(size, F.lit(n))
    stars = F.repeat(F.lit(char), hidden)
    return F.concat(F.substr(x, F.lit(1), size - hidden), stars) if from_end else F.concat(stars, F.substr(x, hidden + 1, size))


def partial_email(x: Column) -> Column:
    return F.concat(F.substring(F.substring_index(x, "@", 1), 1, 2), F.lit("***@"), F.substring_index(x, "@", -1))


def partial_phone(x: Column) -> Column:
    return F.concat(F.substring(x, 1, 4), F.repeat(F.lit("*"), F.greatest(F.length(x) - 4, F.lit(0))))


def partial_card(x: Column) -> Column:
    return F.concat(F.substring(x, 1, 4), F.repeat(F.lit("*"), F.lit(8)), F.right(x, F.lit(4)))


def initials(x: Column) -> Column:
    """J*** S****: the first letter of each word."""
    return F.array_join(F.transform(F.split(x, " "), lambda w: F.concat(F.substring(w, 1, 1), F.repeat(F.lit("*"), F.greatest(F.length(w) - 1, F.lit(0))))), " ")


def bracket(kind: Column, tail: str = "") -> Column:
    return F.concat(F.lit("["), kind, F.lit(tail + "]"))


def partial(kind: Column, x: Column, before: Column) -> Column:
    return F.when(kind == "EMAIL", partial_email(x)).when(kind == "PHONE_NUMBER", partial_phone(x)).when(kind == "CREDIT_CARD", partial_card(x)).when(kind == "AR_NAME", "[ARABIC_NAME]").otherwise(lookup(PARTIAL_TAGS, kind, F.lit("[REDACTED]")))


def redacted_tag(kind: Column, x: Column, before: Column) -> Column:
    return F.when(kind == "PERSON", initials(x)).otherwise(bracket(kind, " REDACTED"))


def spaced_tag(kind: Column, x: Column, before: Column) -> Column:
    """[TYPE] with a blank before it, unless white space is there already."""
    return F.when(before.rlike(r"^(?U)\s$"), bracket(kind)).otherwise(F.concat(F.lit(" "), bracket(kind)))


def masked_n(kind: Column, x: Column, before: Column) -> Column:
    out = mask_n(x, -1)
    for name, (n, end) in MASK_N.items():
        out = F.when(kind == name, mask_n(x, n, "*", end)).otherwise(out)
    return out


def french(kind: Column, x: Column, before: Column) -> Column:
    out = lookup(FRENCH_REPLACEMENTS, kind, F.lit(FRENCH_DEFAULT))
    for name, (char, n, end) in FRENCH_MASKS.items():
        out = F.when(kind == name, mask_n(x, n, char, end)).otherwise(out)
    return out


def financial(kind: Column, x: Column, before: Column) -> Column:
    """Tags of the language's table; a card keeps its last 4 characters, an IBAN its first and last 4, others nothing."""
    n = F.length(x)
    card = kind.isin("CREDIT_CARD", "VISA", "MASTERCARD", "AMEX", "DISCOVER")
    own = F.when(card, F.concat(F.repeat(F.lit("*"), F.greatest(n - 4, F.lit(0))), F.right(x, F.lit(4)))).when(kind.startswith("IBAN"), F.concat(F.substring(x, 1, 4), F.repeat(F.lit("*"), F.greatest(n - 8, F.lit(0))), F.right(x, F.lit(4)))).otherwise(F.repeat(F.lit("*"), n))
    return lookup(FINANCIAL_TAGS, kind, own)


MASKS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "tag": lambda k, x, b: bracket(k),
    "brief_tag": lambda k, x, b: lookup(BRIEF_TAGS, k, F.lit("[MASKED]")),
    "short_tag": lambda k, x, b: lookup(SHORT_TAGS, k, F.lit("[PII]")),
    "angle_tag": lambda k, x, b: F.concat(F.lit("<"), k, F.lit(">")),
    "redacted": lambda k, x, b: F.lit("[REDACTED]"),
    "arabic": lambda k, x, b: lookup(FINANCIAL_TAGS, k, F.lit(ARABIC_DEFAULT)),
    "hash": lambda k, x, b: F.concat(F.lit("[HASH:"), F.substring(F.sha2(x, 256), 1, 8), F.lit("]")),
    "stars": lambda k, x, b: F.repeat(F.lit("*"), F.length(x)),
    "identity": lambda k, x, b: x,
    "partial": partial,
    "redacted_tag": redacted_tag,
    "spaced_tag": spaced_tag,
    "mask_n": masked_n,
    "french": french,
    "financial": financial,
}


def on_strings(value: Column, kind: T.DataType, use: Callable[[Column], Column]) -> Column:
    """`use` on every string inside a column of any type: structs, arrays and map values are walked."""
    if isinstance(kind, T.StringType):
        return use(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: on_strings(x, kind.elementType, use))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: on_strings(x, kind.valueType, use))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(on_strings(value[f.name], f.dataType, use).alias(f.name) for f in kind.fields)))
    return value
