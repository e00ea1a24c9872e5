"""Span extraction against Python's re, both backends, and end-to-end profiles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions.rules import PROFILES, Profile, Rule, from_config, profile
from veilspark.operators.scan import found, least_digits, least_runs, least_shapes, scan, searched
from veilspark.plans import pipeline, staged

TEXTS = [
    (0, "John Smith of Example Corp, john.smith@mail.org, 555-123-4567, card 4111-1111-1111-1111, SSN 123-45-6789.", "en"),
    (1, "Jean Dupont, +33 6 12 34 56 78, jean.dupont@exemple.fr, SIRET 123 456 789 12345, FR12 345 678 912, 75001 Paris", "fr"),
    (2, "الاسم محمد أحمد والهاتف 0512345678 والبريد mohammed@example.sa جواز A1234567", "ar"),
    (3, "هاتف ٠٥١٢٣٤٥٦٧٨ رقم", "ar"),
    (4, "", "en"),
    (5, None, "en"),
    (6, "a@b.co", "en"),
    (7, "😀 mail x.y@z.org 😀 and 10.0.0.1é 192.168.1.1", "de"),
    (8, "no hits in this one at all", None),
    (9, "visa 4532015112830366 and 4532015112830367; +1 (212) 555-0199", "en"),
]


@pytest.fixture(scope="module")
def table(spark, docs):
    made = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    return made.unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang")).repartition(4).cache()


def plain(text, lang, rules):
    lang = lang if lang in ("en", "fr", "ar") else "en"
    out = []
    for k, r in enumerate(rules):
        if text and (not r.langs or lang in r.langs):
            for m in re.finditer(r.pattern, text, re.IGNORECASE if r.ignore_case else 0):
                out.append((m.start(r.group), -r.score, k, m.end(r.group), r.type, m.group(r.group)))
    return sorted(out, key=lambda s: s[:4])


@pytest.mark.parametrize("name", ["light", "api", "modular", "simple", "fallback", "union", "financial", "code"])
@pytest.mark.parametrize("backend", ["native", "arrow"])
def test_same_spans_as_python(table, name, backend):
    if backend == "native" and len(PROFILES[name].rules) > 12:
        pytest.skip("such packs scan by Arrow")
    bare = Profile(name, tuple(Rule(r.type, r.pattern, r.score, r.method, r.langs, r.ignore_case, group=r.group) for r in PROFILES[name].rules))
    rows = table.select("doc_id", "text", "lang", scan(F.col("text"), F.col("lang"), bare, backend).alias("s")).collect()
    for r in rows:
        assert [(s.start, s.neg_score, s.ord, s.end, s.type, s.text) for s in r.s] == plain(r.text, r.lang, bare.rules), r.doc_id


def test_validators_agree_between_backends(table):
    for name in ("api", "modular"):
        both = table.select(*(scan(F.col("text"), F.col("lang"), PROFILES[name], b).alias(b) for b in ("native", "arrow"))).where("native <> arrow")
        assert both.count() == 0


@pytest.mark.parametrize("name", sorted(PROFILES))
def test_properties_of_every_profile(table, name):
    rows = pipeline.analyze(table, name).collect()
    same = {r.doc_id: r.masked_text for r in pipeline.analyze(table, name, masks="identity").collect()}
    for r in rows:
        ends = 0
        for e in r.entities:
            assert (e.start >= ends or PROFILES[name].policy == "iou") and r.text[e.start : e.end] == e.text
            ends = e.end
        assert same[r.doc_id] == r.text
        assert r.success == (r.text is not None) and r.has_pii == bool(r.entities)
        assert r.statistics.total_entities == len(r.entities) == sum(r.statistics.entity_counts.values())


def test_masks_end_to_end(spark):
    df = spark.createDataFrame(TEXTS[:1] + TEXTS[9:], "doc_id long, text string, lang string")
    light = {r.doc_id: r.masked_text for r in pipeline.analyze(df, "light").collect()}
    assert light[0] == "John Smith of Example Corp, jo***@mail.org, 555-********, card 4111********1111, SSN [REDACTED]."
    api = {r.doc_id: r for r in pipeline.analyze(df, "api").collect()}
    assert api[9].masked_text.startswith("visa [CREDIT_CARD] and 4532015112830367;")
    assert [e.type for e in api[9].entities][0] == "CREDIT_CARD" and api[9].entities[0].score == 1.0
    modular = {r.doc_id: r for r in pipeline.analyze(df, "modular").collect()}
    assert modular[0].masked_text == "John Smith of Example Corp, [EMAIL], [PHONE], card [CREDIT_CARD], SSN [SSN]."


def test_rich_profile_finds_its_types(spark):
    texts = [
        ("GB82 WEST 1234 5698 7654 32 and DEUTDEFF", "en", {"IBAN", "SWIFT_BIC"}),
        ("wallet 0x52908400098527886E0F7030069857D2E4169EE7", "en", {"CRYPTO_WALLET"}),
        ("tok_1234567890abcdefgh INV-2023-12345 LN-2023-98765", "en", {"PAYMENT_TOKEN", "INVOICE_NUMBER", "LOAN_NUMBER"}),
        ("Je m'appelle Jean Dupont", "fr", {"PERSON"}),
        ("12 rue de la Paix, 75002 Paris", "fr", {"LOCATION"}),
        ("فاتورة 12345 بمبلغ 1,500.00 ريال", "ar", {"INVOICE_NUMBER", "CURRENCY_AMOUNT"}),
        ("not.an.email and GB00 WEST 1234 5698 7654 32", "en", set()),
    ]
    df = spark.createDataFrame([(k, t, x) for k, (t, x, _) in enumerate(texts)], "doc_id long, text string, lang string")
    for r in pipeline.analyze(df, "rich").collect():
        assert {e.type for e in r.entities} >= texts[r.doc_id][2] and (texts[r.doc_id][2] or not r.entities), (r.text, r.entities)


def test_unknown_names_are_errors(table):
    for call in (lambda: profile("none"), lambda: pipeline.detect(table, "light", policy="none"), lambda: pipeline.analyze(table, "light", masks="none"), lambda: pipeline.analyze(table, "light", policy="all"), lambda: Rule("X", "a*")):
        with pytest.raises(ValueError):
            call()


def test_config_replaces_top_level_keys(tmp_path, spark):
    path = tmp_path / "rules.json"
    path.write_text('{"patterns": {"TICKET": ["T-[0-9]{3}", "Q[0-9]+"], "VAT": {"FR": "FR[0-9]{11}"}}, "entity_types": {"TICKET": {"min_confidence": 0.85}}, "context_words": {"TICKET": {"en": ["ticket"], "fr": ["billet"]}}}')
    p = from_config(str(path))
    df = spark.createDataFrame([(0, "ticket T-123", "en"), (1, "nothing near, T-124", "en"), (2, "billet FR12345678901", "fr")], "doc_id long, text string, lang string")
    got = {r.doc_id: [e.text for e in r.entities] for r in pipeline.detect(df, p).collect()}
    assert got == {0: ["T-123"], 1: [], 2: ["FR12345678901"]}


def test_nested_columns_and_copies(spark):
    df = spark.sql("select 1 as n, named_struct('a', 'x@y.org', 'b', array('u@v.org', 'plain')) as s, map('k', 'm@n.org') as m")
    r = pipeline.redact_columns(df, PROFILES["simple"]).first()
    assert (r.n, r.s.a, r.s.b, r.m) == (1, "[EMAIL]", ["[EMAIL]", "plain"], {"k": "[EMAIL]"})
    copies = spark.createDataFrame([(k, "write to x@y.org" if k % 2 else "none", "en") for k in range(10)], "doc_id long, text string, lang string")
    got = pipeline.deduplicated(copies, "simple").collect()
    assert len(got) == 10 and all(r.has_pii == bool(r.doc_id % 2) for r in got)


def test_chat_reply_masks_each_by_its_own(spark):
    df = spark.createDataFrame([("mail a@b.org", "call 212-555-0199 now")], "query string, answer string")
    r = pipeline.chat_reply(df).first()
    assert r.masked_query == "mail [EMAIL]" and r.masked_answer == "call [PHONE] now"


def test_deduplicated_keeps_null_texts(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co", "en"), (2, None, "en"), (3, None, None), (4, None, "en"), (5, "mail a@b.co", None)], "doc_id int, text string, lang string")
    got = pipeline.deduplicated(docs, "simple")
    want = pipeline.analyze(docs.withColumn("text_sha256", F.sha2("text", 256)), "simple").select(*got.columns)
    key = lambda df: sorted((str(r.asDict(True)) for r in df.collect()))
    assert got.count() == 5 and key(got) == key(want)


def test_least_digits_of_patterns_and_of_all_rules():
    assert [least_digits(p) for p in (r"\d{3}[- ]?\d{4}", r"(?:\+\d{1,3} )?[0-9]+|x\d{2}", r"(?=\d{5})[\dA-F]{8}", r"[^0-9]{4}", r"(a|12)(?:3|45)", r"20[12]\d")] == [7, 1, 0, 0, 1, 4]
    texts = ["no digit", "1", "12 34-5", "call +33 6 12 34 56 78 or 555-123-4567", "4111 1111 1111 1111, DE89 3704 0044 0532 0130 00", "٣٤٥ ١٢٣ ٤٥٦٧"]
    for p in PROFILES.values():
        for r in p.rules:
            least, pattern = least_digits(r.pattern), re.compile(r.pattern, re.IGNORECASE if r.ignore_case else 0)
            assert all(sum(map(str.isdecimal, m.group())) >= least for t in texts for m in pattern.finditer(t)), r


def test_overlap_kinds_are_counted_from_one_scan(spark):
    plan = staged.overlap_kind_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "documents" not in plan  # four scans of all rules before


def test_rules_that_need_more_digits_than_a_text_has_are_not_searched():
    searched = []

    class Watched:
        def __init__(self, name):
            self.name = name

        def finditer(self, text):
            searched.append((self.name, text))
            return iter(())

    ready = [(k, Rule(name, p), Watched(name)) for k, (name, p) in enumerate((("long", r"\d{4}-\d{4}"), ("one", r"\d+"), ("any", "[a-z]")))]
    found(["abc", "a 12", "1234 5678", None, ""], ["en"] * 5, ready)
    assert searched == [("any", "abc"), ("one", "a 12"), ("any", "a 12"), ("long", "1234 5678"), ("one", "1234 5678"), ("any", "1234 5678")]


def test_least_runs_and_shapes_of_patterns():
    runs = [r"\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", r"(?:x\s)?(?:FR|GB)[0-9A-Z]{8,12}", r"tok_[A-Za-z0-9]{16,}", r"(?i)[A-Z]{9}", r"[A-Z]{3}|\d{5}", r"(?:[A-Z]{2}-){3}", r"[^a-z]{4}"]
    assert [least_runs(p) for p in runs] == [(6, 8, 8), (2, 10, 10), (0, 0, 16), (0, 0, 0), (0, 0, 0), (2, 2, 2), (0, 0, 0)]
    assert least_runs("[A-Z]{9}", True) == (0, 0, 0) and least_shapes("abc", True) == ()
    shapes = [r"\b(?:SSN)?\s*\d{3}-\d{2}-\d{4}", r"(?:\+|00)(?:7|20|1\d)\s*[0-9 ]{8,}", r"x?", r"(?i)abc", r"ab+c", r"(?:abc)?[0-9 ]{3}", r"(?:rue|av\.)\s", r"[a-z]+@[a-z]+"]
    assert [least_shapes(p) for p in shapes] == [(b"000-00-0000",), (b"+0", b"000"), (), (), (b"ab",), (), (b"av.", b"rue"), (b"@",)]


def test_what_a_text_lacks_is_not_searched_for():
    asked = []

    class Watched:
        def __init__(self, name):
            self.name = name

        def finditer(self, text):
            asked.append((self.name, text))
            return iter(())

    ready = [(k, Rule(name, p), Watched(name)) for k, (name, p) in enumerate((("run", "[A-Z]{6}"), ("shape", r"\d\d-\d\d"), ("word", "rue|cours")))]
    texts = [t + "." * 80 for t in ("ABCDE F", "ABCDEF", "1-2 345", "12-34", "1٣-٤5", "la rue")]
    found(texts, ["en"] * len(texts), ready)
    # digits beyond ASCII have no shape: such a text is searched for the rule that has one
    assert [(name, t.rstrip(".")) for name, t in asked] == [("run", "ABCDEF"), ("shape", "12-34"), ("shape", "1٣-٤5"), ("word", "la rue")]


def test_guards_lose_no_match_of_any_rule():
    rng = random.Random(3)
    bits = ["tok_", "pi_", "FR", "GB82", "WEST", "1234", "00", "+33", "6", "12", "-", " ", ".", "<", ">", "@", "a.org", '"x"', "0x", "bnb", "r", "Compte", "12 rue de la Paix, 75002 Paris", "Mme Élodie", "٣٤٥", "ſ", "K", "DEUTDEFF", "INV-2023-12345", "SSN 123-45-6789", "123-45-6789", "f" * 40, "Aa1" * 12, "السيد", "فاتورة 12345", "1,500.00 ريال", "\n", "tax", "2131", "4111111111111111"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 12))).ljust(80, "~") for _ in range(1500)]
    for p in PROFILES.values():
        ready = [(k, r, re.compile(r.pattern, re.IGNORECASE if r.ignore_case else 0)) for k, r in enumerate(p.rules)]
        for t in texts:
            kept = {k for k, _, _ in searched(t, ready)}
            assert not [r for k, r, pattern in ready if k not in kept and pattern.search(t)], t
