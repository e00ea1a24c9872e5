"""Validators, masks, text and score expressions on single values."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions import hooks, mask, score, validate
from veilspark.functions import text as tx


def values(spark, f, *inputs):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r.v for r in df.select("k", f(F.col("x")).alias("v")).orderBy("k").collect()]


@pytest.mark.parametrize(
    "name,good,bad",
    [
        ("card", ["4111111111111111", "4532-0151-1283-0366", "378282246310005"], ["4111111111111112", "", "411111"]),
        ("iban", ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR1420041010050500013M02606"], ["GB00 WEST 1234 5698 7654 32", "ZZ82WEST12345698765432", "x"]),
        ("bic", ["DEUTDEFF", "BNPAFRPPXXX", "DEUTCAFF", "ROYCCAT2"], ["DEUTZZFF", "deutdeff", "DEUTDEF"]),
        ("ssn", ["123-45-6789"], ["000-45-6789", "666-45-6789", "900-45-6789", "123-00-6789", "123-45-0000"]),
        ("routing", ["021000021", "011401533"], ["021000022", "12"]),
        ("rib", ["20041010050500013M02606"], ["20041010050500013M02607", "x"]),
        ("email", ["a.b@mail.org"], ["a@example.com", "a@test.com", "1@mail.org", "a@my_mail.org", "a..b@mail.org", ".a@mail.org", "a@-mail.org", "a@b@c.org"]),
        ("email_short", ["a@mail.org"], ["a@b", "a..b@c.org", "a@example.com", "1@mail.org"]),
        ("phone", ["+1 (212) 555-0199", "90129012"], ["1234567", "1111111111", "12341234567", "0112342345"]),
        ("phone_country", ["+33 6 98 47 35 12", "+966598473512", "0598473512"], ["+33 6 12", "12", "+966412983547", "+11125550199", "012983547", "+33 6 12 34 56 78"]),
        ("crypto", ["0x52908400098527886E0F7030069857D2E4169EE7", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"], ["0x" + "0" * 40, "1A1z", "hello"]),
        ("vat", ["DE123456789", "FRXX999999999", "ZZ123456789", "IEA2345678B"], ["DE12", "GR123456789", "de123456789", "4111111111111111"]),
        ("payment_token", ["tok_1234567890abcdef"], ["tok_1", "xok_1234567890abcdef"]),
        ("investment_id", ["INV-123456789", "FUND-ABCDEFGH"], ["INV-1"]),
        ("loan_number", ["LN-2023-12345", "LOAN-ABCDEFGH"], ["LN-1"]),
        ("invoice_number", ["FAC-2023-12345"], ["FAC-1"]),
        ("name", ["Jean", "J.", "van Berg"], ["jean", "Ludwig van Beethoven"]),
    ],
)
def test_validators(spark, name, good, bad):
    assert values(spark, validate.VALIDATORS[name], *good) == [True] * len(good)
    assert not any(values(spark, validate.VALIDATORS[name], *bad))


def test_validator_cascades(spark):
    plain = ["INV-2024-1234", "FINV-2023/12345", "LN-2023-12345", "MORT-20231234", "123-45-6789", "000-45-6789", "12-3456-7890-1234-5678-9012", "4111 1111 1111 1111", "378282246310005", "4222222222222", "DE123456789", "x", None]
    assert values(spark, validate.financial_kind, *plain) == ["INVOICE_NUMBER", "INVOICE_NUMBER", "LOAN_NUMBER", "LOAN_NUMBER", "SSN", None, "BANK_ACCOUNT", "CREDIT_CARD", "CREDIT_CARD", None, None, None, None]
    said = lambda words: lambda x: validate.financial_kind(x, F.lit(words))
    assert values(spark, said("VAT no. of the firm"), "DE123456789", "DE1", "4111111111111111") == ["VAT_NUMBER", None, None]
    assert values(spark, said("the account of"), "4111111111111111", "INV-2024-1234", "123-45-6789") == ["BANK_ACCOUNT", "BANK_ACCOUNT", "SSN"]
    near = lambda words, name=None: lambda x: validate.arabic_financial_kind(x, F.lit(words), F.lit(name))
    assert values(spark, near("الرقم الضريبي"), "123456789012345", "378282246310005") == ["VAT_NUMBER", "VAT_NUMBER"]
    assert values(spark, near("tax"), "123456789012345", "378282246310005") == ["VAT_NUMBER", None]
    assert values(spark, near("بطاقة"), "4111-1111-1111-1111", "378282246310005", "1234 5678 9012 3456") == ["CREDIT_CARD"] * 3
    assert values(spark, near("my Card"), "4111111111111111") == ["CREDIT_CARD"] and values(spark, near("none"), "4111111111111111", "5") == [None, None]
    named = ["Arabic Bank Account", "Arabic Currency Amount", "Arabic Payment Token", "Arabic Invoice Number"]
    assert [values(spark, near("none", n), "100 ريال")[0] for n in named] == ["BANK_ACCOUNT", "CURRENCY_AMOUNT", "PAYMENT_TOKEN", None]
    assert values(spark, validate.name_fragment, "John", "J.", "J", "van Berg", "Jean-Paul", "Élodie", "john", "J.R.", "McX", "") == [True] * 6 + [False] * 4
    pair = lambda x: validate.name_combination(x, F.lit("Smith")) & ~validate.name_combination(x, F.lit("smith"))
    assert values(spark, pair, "John", "J.", "the") == [True, True, False]
    inside = lambda x: validate.well_formed(F.lit(0), x.cast("int"), F.lit(0.5), F.lit("abc"))
    assert values(spark, inside, "3", "4", "-1", None) == [True, False, False, False]
    assert values(spark, lambda x: validate.common_word(x, F.lit("en")), "The", "an", "Boston", "they", "People") == [True, True, False, True, True]
    assert values(spark, lambda x: validate.common_word(x, F.lit("ar")), "شركة", "تطوير", "محمد") == [True, True, False]
    assert values(spark, lambda x: validate.request_error(x, F.lit("en")), "", None, "x") == ["text is empty", "text is empty", None]
    assert values(spark, lambda x: validate.request_error(F.lit("t"), x), "xx") == ["unsupported language xx"]


def test_masks(spark):
    one = lambda name, kind: lambda x: mask.MASKS[name](F.lit(kind), x, F.lit(""))
    assert values(spark, one("partial", "EMAIL"), "john@mail.org") == ["jo***@mail.org"]
    assert values(spark, one("partial", "PHONE_NUMBER"), "555-123-4567") == ["555-********"]
    assert values(spark, one("partial", "CREDIT_CARD"), "4111111111111111") == ["4111********1111"]
    assert values(spark, one("partial", "DATE"), "x") == ["[DATE]"]
    assert values(spark, one("redacted_tag", "PERSON"), "John Smith") == ["J*** S****"]
    assert values(spark, one("redacted_tag", "EMAIL"), "x") == ["[EMAIL REDACTED]"]
    assert values(spark, one("mask_n", "EMAIL_ADDRESS"), "john@mail.org", "a@b") == ["********l.org", "***"]
    assert values(spark, one("mask_n", "CREDIT_CARD"), "4111111111111111") == ["4111************"]
    assert values(spark, one("mask_n", "OTHER"), "abc") == ["***"]
    assert values(spark, one("french", "PERSON"), "x") == ["<PERSONNE>"] and values(spark, one("french", "CREDIT_CARD"), "4111") == ["####"]
    assert values(spark, one("financial", "IBAN_GB"), "GB82WEST12345698765432") == ["GB82**************5432"]
    assert values(spark, one("financial", "FR_AMOUNT"), "5 EUR") == ["[MONTANT]"] and values(spark, one("financial", "VISA"), "4111111111111111") == ["************1111"]
    assert values(spark, one("brief_tag", "CREDIT_CARD"), "x") == ["[CC]"] and values(spark, one("short_tag", "X"), "x") == ["[PII]"]
    assert values(spark, one("hash", "X"), "abc") == ["[HASH:ba7816bf]"] and values(spark, one("angle_tag", "X"), "abc") == ["<X>"]
    assert values(spark, lambda x: mask.spaced_tag(F.lit("T"), F.lit("v"), x), " ", "a", "") == ["[T]", " [T]", " [T]"]
    assert values(spark, one("arabic", "OTHER"), "x") == ["محجوب"] and values(spark, one("stars", "X"), "abc") == ["***"] and values(spark, one("redacted", "X"), "a") == ["[REDACTED]"]


def test_text(spark):
    assert values(spark, tx.clean_lines, "a\r\nb\t c\u200bd") == ["a\nb cd"]
    assert values(spark, tx.collapse, "  a \n\t b\u00a0c\ufeff ") == ["a b c"]
    assert values(spark, tx.normalize_arabic, "أحمد  إلى مدرسة 12 34") == ["احمد الي مدرسه 1234"]
    assert values(spark, lambda x: tx.strip_markdown(x, 5), "*ab*c", "#abcdefg") == ["abc", "abcde..."]
    assert values(spark, tx.strip_token_marks, "▁Paris,", "Ġab;") == ["Paris", "ab"]
    assert values(spark, tx.json_escape, 'a"b\n') == ['a\\"b\\n']
    assert values(spark, tx.token_estimate, "a" * 9, "") == [2, 0]
    assert values(spark, tx.guess_language, "abc", "été", "مرحبا") == ["en", "fr", "ar"]
    assert values(spark, tx.language_code, "French", "EN-us", "de") == ["fr", "en", "de"]
    assert values(spark, lambda x: tx.sentence_chunks(x, 10), "Aa bb. Cc dd. Ee.", "a" * 25, "") == [["Aa bb. ", "Cc dd. Ee."], ["a" * 10, "a" * 10, "a" * 5], []]
    chunks = values(spark, lambda x: tx.fixed_chunks(x, 6), "aaa bbb ccc", "x" * 13, "")
    assert [[(c.offset, c.text) for c in cs] for cs in chunks] == [[(0, "aaa "), (4, "bbb "), (8, "ccc")], [(0, "x" * 6), (6, "x" * 6), (12, "x")], []]
    assert [[(c.offset, c.text) for c in cs] for cs in values(spark, lambda x: tx.windows(x, 4), "abcdef", "")] == [[(0, "abcd"), (2, "cdef"), (4, "ef")], [(0, "")]]
    assert values(spark, lambda x: tx.map_position(tx.kept_positions(x, "-"), F.lit(2)), "a-b-c", "----") == [4, 2]
    assert values(spark, tx.html_text, "<p>a &lt;b&gt; <script>x()</script>c</p><!-- d -->") == ["a <b> c"]
    assert values(spark, tx.compare_form, " A  b ") == ["a b"]


def test_scores(spark):
    assert values(spark, lambda x: score.pattern_score(F.lit("CREDIT_CARD"), x), "4111111111111111", "4111111111111112") == [0.95, 0.6]
    assert values(spark, lambda x: score.context_boost(F.lit("A"), x, {"A": ("card", "visa")}), "my visa card", "none") == [0.2, 0.0]
    assert values(spark, lambda x: score.normal_value(F.lit("PHONE_NUMBER"), x), "212-555-0199", "+1 212 555 0199") == ["(212) 555-0199", "+1 212 555 0199"]
    assert values(spark, lambda x: score.normal_value(F.lit("CREDIT_CARD"), x), "4111 1111 1111 1111") == ["4111-1111-1111-1111"]
    assert values(spark, lambda x: score.veto_or_boost(F.lit(0.9), x, ("order",), ("tel",)), "order 1", "tel 1", "x") == [None, pytest.approx(0.95), 0.9]
    arabic = lambda kind, near="", common=False: lambda x: F.round(score.arabic_score(F.lit(kind), x, F.lit(near), F.lit(common)), 6)
    assert values(spark, arabic("AR_NAME", "قال"), "محمد أحمد", "محمد", "خالدة", "السيد خالد") == [1.0, 0.65, 0.95, 1.0]
    assert values(spark, arabic("AR_ORGANIZATION", "بنك"), "بنك مصر", "ab") == [0.95, 0.95] and values(spark, arabic("AR_ORGANIZATION"), "بنك مصر") == [0.8]
    assert values(spark, arabic("AR_PHONE_SA", "قال"), "05") == [0.9] and values(spark, arabic("AR_NAME", "", True), "خالدة") == [0.4] and values(spark, arabic("AR_ADDRESS", "عنوانه"), "x") == [0.75]
    around = lambda kind, near="": lambda x: F.round(score.arabic_context_score(F.lit(kind), F.lit(near), x), 6)
    assert values(spark, around("AR_NAME"), "محمد", "محمد أحمد", "خالدة") == [0.3, 0.6, 0.5] and values(spark, around("AR_NAME", "ترأس"), "خالدة") == [0.7]
    assert values(spark, around("AR_ADDRESS", "يقع في"), "ab") == [0.7] and values(spark, around("AR_PHONE_SA", "قال"), "ab") == [0.5]
    french = lambda kind, x="": lambda s: F.round(score.french_score(F.lit(kind), F.split(s, "\\|"), F.lit(1), F.lit(x)), 6)
    assert values(spark, french("FR_PHONE"), "tel ici|appelez|rien", "a|b|c") == [0.9, 0.7]
    assert values(spark, french("FR_PHONE", "+33 612345678"), "a|b|c") == [1.0] and values(spark, french("FR_EMAIL", "a.b@c.fr"), "x|y|z") == [1.0]
    assert [values(spark, french("FR_NAME", n), "a|b|c")[0] for n in ("Jean Dupont", "Jean D", "jean dupont", "Jean DuPont", "Élodie")] == [0.9, 0.7, 0.7, 0.7, 0.9]
    ner = lambda label, lang, before="", near="": lambda x: score.ner_score(F.lit(label), x, F.lit(before), F.lit(near), F.lit(lang))
    assert values(spark, ner("PERSON", "en"), "John Smith", "John") == [0.95, 0.85] and values(spark, ner("ORG", "en"), "Big Co", "Co") == [0.9, 0.85]
    assert values(spark, ner("PER", "fr", "Bonjour Mme. "), "Dupont") == [0.95] and values(spark, ner("PER", "fr"), "Jean Dupont") == [0.85]
    assert values(spark, ner("LOC", "fr", "", "12 rue Victor"), "Victor") == [0.95] and values(spark, ner("LOC", "en", "", "12 rue Victor"), "Victor Hugo") == [0.85]
    assert values(spark, lambda x: score.normalized_score(F.lit("PERSON"), x, F.lit(0.8), F.lit(1), F.lit(False)), "John", "J") == [pytest.approx(0.8), pytest.approx(0.2)]
    assert values(spark, lambda x: score.normalized_score(F.lit("EMAIL"), x, F.lit(0.5), F.lit(2), F.lit(False), F.lit(True)), "a@mail.org") == [pytest.approx(0.72)]
    assert values(spark, lambda x: score.normalized_score(F.lit("TIME"), x, F.lit(0.8), F.lit(0), F.lit(False)), "many  days", "noon") == [None, pytest.approx(0.8)]
    assert values(spark, lambda x: score.normalized_score(F.lit("CARDINAL"), x, F.lit(0.8), F.lit(0), F.lit(False)), "12") == [None]
    assert values(spark, score.type_name, "per", "GPE", "Other") == ["PERSON", "LOCATION", "OTHER"]
    assert values(spark, score.number_context, "my credit card", "vat id", "security code", "document id", "expiry cvv", "none") == ["CREDIT_CARD", "TAX_ID", "CREDIT_CARD", "REFERENCE", "CREDIT_CARD", "UNKNOWN"]
    assert values(spark, lambda x: score.adapted_threshold(F.lit(0.93), x.cast("int"), F.lit(10)), "1", "2") == [0.93, 0.95]
    assert values(spark, lambda x: score.name_group_score(F.lit(0.8), F.lit(1), x.cast("int")), "1", "5") == [pytest.approx(0.95), 1.0]
    e = spark.createDataFrame([(1, 0, 5, "A", "PERSON", "spacy"), (1, 3, 8, "B", "PERSON", "presidio"), (1, 20, 22, "C", "X", "spacy")], "doc_id int, start int, end int, text string, type string, method string")
    assert sorted(round(r.agreement, 3) for r in score.agreement(e).collect()) == [0.7, 0.75, 0.75]


def test_hooks(spark):
    df = spark.createDataFrame([("Ann met Bob", "en", 0), (None, "en", 1), ("x", "en", 2)], "text string, lang string, chunk int")

    def load():
        return lambda text, lang: [{"type": "PERSON", "text": w, "start": text.index(w), "end": text.index(w) + 3, "score": 0.9} for w in ("Ann", "Bob") if w in text]

    def broken():
        raise MemoryError

    for first, second in ((load, None), (broken, load)):
        rows = df.select(hooks.detector(first, "stub", second)(F.col("text"), F.col("lang")).alias("e")).collect()
        assert [[x.text for x in r.e] for r in rows] == [["Ann", "Bob"], [], []]
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert hooks.with_retries(flaky, 3, 0.0)("p") == "ok" and len(calls) == 3
    with pytest.raises(OSError):
        hooks.with_retries(lambda p: (_ for _ in ()).throw(OSError()), 2, 0.0)("p")
    for policy, want in (("first", ["A:Ann met Bob", "A:", "A:x"]), ("alternate", ["A:Ann met Bob", "B:", "A:x"]), ("both", ["A:Ann met Bob\nB:Ann met Bob", "A:\nB:", "A:x\nB:x"])):
        got = hooks.prompted(df, [lambda p: "A:" + p, lambda p: "B:" + p], lambda t: t, policy)
        assert [r.response for r in got.orderBy("chunk").collect()] == want
    answer = spark.createDataFrame([("[PERSON: Bob] [CITY: Rome]", "Ann met Bob")], "r string, t string").select(hooks.tagged_answer(F.col("r"), F.col("t")).alias("e")).first().e
    assert [(x.type, x.start, x.end) for x in answer] == [("PERSON", 8, 11)]
    moved = spark.sql("select 'Ann met Bob here' as t, array(named_struct('text', 'Bob', 'start', 5, 'end', 8), named_struct('text', 'Zed', 'start', 0, 'end', 3)) as e").select(hooks.repositioned(F.col("e"), F.col("t")).alias("e")).first().e
    assert [(x.start, x.end) for x in moved] == [(8, 11)]
    tags = spark.sql("select array(named_struct('label', 'B-PER', 'start', 0, 'end', 3, 'score', 0.8), named_struct('label', 'I-PER', 'start', 4, 'end', 7, 'score', 0.6), named_struct('label', 'O', 'start', 8, 'end', 9, 'score', 1.0), named_struct('label', 'I-LOC', 'start', 10, 'end', 12, 'score', 0.5)) as t").select(hooks.decoded_labels(F.col("t")).alias("e")).first().e
    assert [(x.type, x.start, x.end, round(x.score, 2)) for x in tags] == [("PER", 0, 7, 0.7), ("LOC", 10, 12, 0.5)]
    assert values(spark, hooks.base58_payload, "rHb9CJAWyB4rj91VRWn96DkukG4bwdtyTh", "rHb9CJAWyB4rj91VRWn96DkukG4bwdtyTj", None, "") == [True, False, False, False]
    assert sorted(values(spark, hooks.shuffled_sentences, "A b. C d. E f.")[0].split(". ")) != []
    people = spark.sql("select array(named_struct('type', 'PERSON', 'text', 'Al'), named_struct('type', 'PERSON', 'text', 'Alice')) as e").select(hooks.ner_filter(F.col("e"), F.lit("en")).alias("e")).first().e
    assert [x.text for x in people] == ["Alice"]
    assert hooks.registry(spark).where("profile = 'light' and type = 'EMAIL'").count() == 1
