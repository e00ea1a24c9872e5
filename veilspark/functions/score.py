"""Scores of spans from their pattern, context and neighbours: expressions on a span and its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validate import luhn

# ---- fixed values ------------------------------------------------------------------------------

ARABIC_BASE = {"AR_NAME": 0.8, "AR_EMAIL": 0.9, "AR_ORGANIZATION": 0.8, "AR_ADDRESS": 0.6, "AR_PHONE_SA": 0.9, "AR_PHONE_UAE": 0.9, "AR_PHONE_EG": 0.9}
ARABIC_NEAR = {
    "AR_NAME": (
        "يدعى", "اسمه", "اسمها", "السيد", "السيدة", "الدكتور", "الدكتورة", "المهندس", "المهندسة", "الأستاذ", "الأستاذة", "قال", "قالت", "صرح", "أكد",
        "ذكر", "أفاد", "أوضح", "أشار", "أعلن", "كتب", "نشر", "ألف", "ترأس", "يعمل",
    ),
    "AR_ORGANIZATION": ("شركة", "مؤسسة", "مجموعة", "بنك", "جامعة", "معهد", "وزارة", "هيئة", "دائرة", "مركز", "مستشفى", "مدرسة", "مقرها", "مكاتبها", "فرع", "مدير"),
    "AR_ADDRESS": ("يقع في", "عنوانه", "عنوانها", "مقره", "مقرها", "يقيم في", "تقيم في", "العنوان", "الموقع", "المكان", "الشارع", "الحي", "المنطقة", "المدينة"),
}
ARABIC_PREFIXES = ("السيد", "الدكتور", "الشيخ", "المهندس", "الأستاذ", "السيدة", "الآنسة")
FRENCH_NEAR = {
    "FR_NAME": ("nommé", "appelé", "s'appelle", "je suis", "c'est", "prénom", "nom", "monsieur", "madame", "mademoiselle"),
    "FR_ADDRESS": ("habite", "demeure", "adresse", "domicilié", "résidant", "situé", "localisé", "se trouve"),
    "FR_PHONE": ("téléphone", "portable", "fixe", "numéro", "tel", "tél", "contactez", "joindre", "appeler"),
    "FR_EMAIL": ("email", "courriel", "adresse mail", "contact", "@", "électronique", "e-mail"),
}
METHOD_WEIGHTS = {"huggingface": 0.9, "presidio": 0.8, "spacy": 0.7}
TYPE_NAMES = {"PER": "PERSON", "ORG": "ORGANIZATION", "LOC": "LOCATION", "GPE": "LOCATION", "NORP": "ORGANIZATION", "FAC": "LOCATION", "NOM": "PERSON", "LIEU": "LOCATION", "ORGANISATION": "ORGANIZATION", "شخص": "PERSON", "مكان": "LOCATION", "منظمة": "ORGANIZATION", "DATE_TIME": "DATE", "EMAIL_ADDRESS": "EMAIL"}
FRENCH_TITLES = ("m.", "mme.", "dr.", "monsieur", "madame")
FRENCH_STREETS = ("rue", "avenue", "boulevard", "place")
FRENCH_SHAPES = {"FR_EMAIL": (r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", 0.3), "FR_PHONE": (r"^\+33\s?[1-9](\s?\d{2}){4}$", 0.3), "FR_NAME": (r"(?U)^\s*(?:\p{Lu}[^\s\p{Lu}\p{Lt}]*\p{Ll}[^\s\p{Lu}\p{Lt}]*(?:\s+|$))*$", 0.2)}


def around(text: Column, start: Column, end: Column, width: int) -> Column:
    """The text from `width` characters before a span to `width` after it, lower-cased."""
    low = F.greatest(start - width, F.lit(0))
    return F.lower(F.substr(text, low + 1, end + width - low))


def hits(context: Column, words: tuple[str, ...]) -> Column:
    """How many of the words are in the context."""
    return F.size(F.filter(F.array(*(F.lit(w) for w in words)), lambda w: context.contains(w)))


def pattern_score(kind: Column, x: Column) -> Column:
    """What a match of a pattern is worth: more if it has its type's full shape."""
    return (
        F.when(kind == "EMAIL", F.when(F.get(F.split(x, "@"), F.lit(1)).contains("."), 0.95).otherwise(0.5))
        .when(kind == "PHONE_NUMBER", F.when(x.rlike(r"^\+?1?\d{3}[-.]?\d{3}[-.]?\d{4}$"), 0.9).otherwise(0.7))
        .when(kind == "CREDIT_CARD", F.when(luhn(x, 13, 19), 0.95).otherwise(0.6))
        .when(kind == "SSN", F.when(x.rlike(r"^\d{3}-\d{2}-\d{4}$"), 0.9).otherwise(0.7))
        .otherwise(0.8)
    )


def context_boost(kind: Column, context: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """0.1 for each of the type's words in the context, 0.5 at most."""
    out = F.lit(0.0)
    for name, ws in words.items():
        out = F.when(kind == name, F.least(hits(context, ws) * 0.1, F.lit(0.5))).otherwise(out)
    return out


def with_context(spans: Column, text: Column, words: dict[str, tuple[str, ...]], width: int = 100) -> Column:
    """Spans with context in their scores; checked cards gain 0.1 more; 1 at most."""

    def one(s: Column) -> Column:
        raised = F.least(s["score"] + context_boost(s["type"], around(text, s["start"], s["end"], width), words), F.lit(1.0))
        score = F.when(s["type"] == "CREDIT_CARD", F.least(raised + 0.1, F.lit(1.0))).otherwise(raised)
        return s.withField("score", score).withField("neg_score", -score)

    return F.transform(spans, one)


def veto_or_boost(score: Column, context: Column, vetoes: tuple[str, ...], boosts: tuple[str, ...], gain: float = 0.05) -> Column:
    """Null if a veto word is near, else the score raised by `gain` if a boost word is."""
    return F.when(hits(context, vetoes) > 0, F.lit(None)).when(hits(context, boosts) > 0, F.least(score + gain, F.lit(1.0))).otherwise(score)


def _by_kind(kind: Column, table: dict, value, default: Column) -> Column:
    out = default
    for name, v in table.items():
        out = F.when(kind == name, value(v)).otherwise(out)
    return out


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"(?U)\S+"))


def arabic_score(kind: Column, x: Column, context: Column, is_common: Column) -> Column:
    """The type's base, more near one of its words; for names less if short and alone, more for several words and after a title; less for common words."""
    base = _by_kind(kind, ARABIC_BASE, F.lit, F.lit(0.6))
    near = _by_kind(kind, ARABIC_NEAR, lambda ws: hits(F.lower(context), ws) > 0, F.lit(False))
    n, name = word_count(x), kind == "AR_NAME"
    titled = F.exists(F.array(*(F.lit(p) for p in ARABIC_PREFIXES)), lambda p: x.startswith(p))
    boost = F.when(near, 0.15).otherwise(0.0) + F.when(name & (n >= 2), 0.1).otherwise(0.0) + F.when(name & titled, 0.2).otherwise(0.0)
    raw = base + boost - F.when(name & (n == 1) & (F.length(x) < 5), 0.3).otherwise(0.0) - F.when(is_common, 0.4).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def arabic_context_score(kind: Column, context: Column, x: Column) -> Column:
    """0.5; names and addresses more near one of their words, names more for several words and less if short."""
    name, address = kind == "AR_NAME", kind.contains("ADDRESS")
    near = F.when(name, hits(context, ARABIC_NEAR["AR_NAME"]) > 0).when(address, hits(context, ARABIC_NEAR["AR_ADDRESS"]) > 0).otherwise(False)
    raw = F.lit(0.5) + F.when(near, 0.2).otherwise(0.0) + F.when(name & (word_count(x) > 1), 0.1).otherwise(0.0) - F.when(name & (F.length(x) < 5), 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def french_score(kind: Column, sentences: Column, at: Column, x: Column) -> Column:
    """0.7, 0.3 for each of the type's words in the span's sentence, 0.2 for each in a neighbouring one, and what its shape is worth; 1 at most.

    sentences: array of sentences; at: the number of the span's; x: the span's text.
    """
    said = lambda k: F.lower(F.coalesce(F.get(sentences, k), F.lit("")))
    near = _by_kind(kind, FRENCH_NEAR, lambda ws: hits(said(at), ws) * 0.3 + (hits(said(at - 1), ws) + hits(said(at + 1), ws)) * 0.2, F.lit(0.0))
    shape = _by_kind(kind, FRENCH_SHAPES, lambda v: F.when(x.rlike(v[0]), v[1]).otherwise(0.0), F.lit(0.0))
    return F.least(F.lit(1.0), F.lit(0.7) + near + shape)


def ner_score(label: Column, x: Column, before: Column, context: Column, lang: Column) -> Column:
    """A model's find by its label: in French persons after a title, organisations of several words and places near a street word;
    else persons and organisations of several words. before, context: the 20 characters before, and those with the span and 20 after."""
    several = word_count(x) > 1
    french = F.when((label == "PER") & (hits(F.lower(before), FRENCH_TITLES) > 0), 0.95).when((label == "ORG") & several, 0.9).when((label == "LOC") & (hits(F.lower(context), FRENCH_STREETS) > 0), 0.95)
    other = F.when((label == "PERSON") & several, 0.95).when((label == "ORG") & several, 0.9)
    return F.coalesce(F.when(lang == "fr", french).otherwise(other), F.lit(0.85))


#: Words that name places in Arabic, and beginnings that do. Fixed values.
PLACE_WORDS = ("مدينة", "شارع", "حي", "منطقة", "الرياض", "جدة", "مكة", "المدينة", "طريق", "ميدان", "ساحة", "برج", "مبنى", "عمارة", "فندق")
PLACE_STARTS = ("ال", "مدينة", "حي")
LABELS = {"LOC": "LOCATION", "PER": "PERSON", "ORG": "ORGANIZATION"}


def arabic_type(label: Column, x: Column, before: Column) -> Column:
    """The type of a model's find in Arabic: a place if it is a word for one, if such a word is in the 30 characters before,
    or if a person's name begins as places do; else the label's type. Labels that are not known stay."""
    kind = label
    for short, full in LABELS.items():
        kind = F.when(label == short, full).otherwise(kind)
    near = F.exists(F.array(*(F.lit(w) for w in PLACE_WORDS)), lambda w: before.contains(w))
    starts = F.exists(F.array(*(F.lit(w) for w in PLACE_STARTS)), lambda w: x.startswith(w))
    place = x.isin(*PLACE_WORDS) | F.coalesce(near, F.lit(False)) | ((kind == "PERSON") & starts)
    return F.when(place, "LOCATION").otherwise(kind)


#: Phrases of time that are no dates. Fixed values.
NO_DATES = (r"countless\s+(?:hours|days|weeks|months|years)", r"(?:few|many|several)\s+(?:hours|days|weeks|months|years)", "(?:early|late|mid)")


def normalized_score(kind: Column, x: Column, score: Column, methods: Column, is_common: Column, shaped: Column | None = None, sensitive: Column | None = None) -> Column:
    """A score by length, common words, shape and number of methods; null drops the span.

    shaped: whether the whole of x matches a pattern; sensitive: whether a card's, phone's or SSN's pattern is in it.
    """
    kind, n, bare = F.upper(kind), F.length(x), F.trim(x)
    out = score * F.when(n < 2, 0.5).when(n < 3, 0.7).otherwise(1.0)
    out = F.when(~kind.isin("PERSON", "ORG", "GPE", "LOC") & is_common, out * 0.8).otherwise(out)
    if shaped is not None:
        out = F.when(kind.isin("EMAIL", "PHONE_NUMBER", "SSN", "CREDIT_CARD") & shaped, F.least(F.lit(1.0), out * 1.2)).otherwise(out)
    out = F.when(methods > 1, F.least(F.lit(1.0), out * (1 + F.lit(0.1) * methods))).otherwise(out)
    idle = bare.rlike(r"^\d+$") | F.lower(x).rlike("|".join(NO_DATES))
    gone = kind.isin("CARDINAL", "TIME") & idle
    gone = gone | ((kind == "CARDINAL") & ~(F.lit(False) if sensitive is None else sensitive))
    return F.when(~gone, F.when((F.length(bare) < 3) & ~kind.isin("ID", "AGE"), out * 0.5).otherwise(out))


def name_group_score(best: Column, methods: Column, parts: Column) -> Column:
    return F.least(F.lit(1.0), best + F.lit(0.1) * methods + F.least(F.lit(0.1), F.lit(0.05) * parts))


def type_name(kind: Column) -> Column:
    names = F.create_map(*(F.lit(v) for kv in TYPE_NAMES.items() for v in kv))
    return F.coalesce(F.try_element_at(names, F.upper(kind)), F.upper(kind))


def above(spans: Column, thresholds: dict[str, float], default: float = 0.5) -> Column:
    """Spans whose score reaches their type's threshold."""
    if not thresholds:
        return spans
    least = F.create_map(*(F.lit(v) for kv in thresholds.items() for v in kv))
    return F.filter(spans, lambda s: s["score"] >= F.coalesce(F.try_element_at(least, s["type"]), F.lit(default)))


def above_learnt(spans: Column, learnt: dict[tuple[str, str], float], default: float = 0.5) -> Column:
    """Spans whose score reaches the threshold of their method and type."""
    if not learnt:
        return spans
    methods = sorted({method for method, _ in learnt})
    of = {m: F.create_map(*(F.lit(x) for (method, kind), v in learnt.items() if method == m for x in (kind, v))) for m in methods}
    least = F.create_map(*(x for m in methods for x in (F.lit(m), of[m])))
    return F.filter(spans, lambda s: s["score"] >= F.coalesce(F.try_element_at(F.try_element_at(least, s["method"]), s["type"]), F.lit(default)))


def normal_value(kind: Column, x: Column) -> Column:
    """(ddd) ddd-dddd for phones of ten digits; groups of four for cards that check."""
    d = F.regexp_replace(x, "[^0-9]", "")
    phone = F.regexp_replace(d, r"^(\d{3})(\d{3})(\d{4})$", "($1) $2-$3")
    card = F.rtrim(F.regexp_replace(d, r"(\d{4})(?=\d)", "$1-"))
    return F.when((kind == "PHONE_NUMBER") & (F.length(d) == 10), phone).when((kind == "CREDIT_CARD") & luhn(x, 13, 19), card).otherwise(x)


#: What tells kinds of numbers apart nearby. Fixed values.
NUMBER_CONTEXTS = {
    "CREDIT_CARD": ("(?i)(?:credit|debit|card|visa|mastercard|amex)", "(?i)(?:expir|cvv|security code)"),
    "TAX_ID": ("(?i)(?:tax|fiscal|vat|tva)", "(?i)(?:number|id|identifier)"),
    "REFERENCE": ("(?i)(?:ref|reference|invoice|document)", "(?i)(?:number|id|#)"),
}


def number_context(context: Column) -> Column:
    """What a number is called nearby: the kind with most patterns in the context, in this order at a tie."""
    votes = {kind: sum((context.rlike(p).cast("int") for p in patterns), F.lit(0)) for kind, patterns in NUMBER_CONTEXTS.items()}
    top = F.greatest(*votes.values())
    out = F.lit("UNKNOWN")
    for kind in reversed(votes):
        out = F.when((top > 0) & (votes[kind] == top), kind).otherwise(out)
    return out


def agreement(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """`entities` with the mean weight of the distinct methods whose spans overlap or touch each, or have its text.

    Spans meet by bins of positions and by text, methods are made distinct on the way: no document's spans are paired off.
    """
    from ..operators.intervals import overlapping

    weight = F.create_map(*(F.lit(v) for kv in METHOD_WEIGHTS.items() for v in kv))
    rows = entities.withColumn("__row", F.xxhash64(key, "start", "end", "type", "method"))
    # spans that touch have a common position once their ends count
    wide = rows.select(key, "start", (F.col("end") + 1).alias("end"), "method", "__row").distinct()
    by_place = overlapping(wide, wide.select(key, "start", "end", "method").distinct(), key).select(key, F.col("a___row").alias("__row"), F.col("b_method").alias("o_method"))
    by_text = rows.select(key, "text", "__row").distinct().join(rows.select(key, "text", F.col("method").alias("o_method")).distinct(), [key, "text"]).select(key, "__row", "o_method")
    met = by_place.unionByName(by_text).distinct()
    mean = met.groupBy(key, "__row").agg(F.avg(F.coalesce(F.try_element_at(weight, F.col("o_method")), F.lit(0.7))).alias("agreement"))
    return rows.join(mean, [key, "__row"]).drop("__row")


def adapted_threshold(threshold: Column, false_positives: Column, total: Column, rate: float = 0.05, cap: float = 0.95) -> Column:
    """A threshold raised while over a tenth of a method's finds are wrong."""
    return F.when(false_positives / F.greatest(total, F.lit(1)) > 0.1, F.least(threshold + rate, F.lit(cap))).otherwise(threshold)
