"""Arabic names, addresses and types of a model's finds; recognizers by language."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions import score
from veilspark.functions.rules import PROFILES, Profile
from veilspark.plans import pipeline


def found(spark, rules, rows, backend):
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    return sorted((r.doc_id, r.type, r.text, r.score) for r in pipeline.entities(df, rules, backend=backend).collect())


@pytest.mark.parametrize("backend", ["native", "arrow"])
def test_names_and_addresses(spark, backend):
    named = Profile("named", tuple(r for r in PROFILES["rich"].rules if r.name in ("Arabic Name", "Arabic Address", "Arabic Building", "Arabic Postal Code")), "all")
    rows = [
        (1, "اسمي محمد أحمد.", "ar"),
        (2, "اسمي محمد أحمد.", "en"),  # another language's rules
        (3, "شارع الملك فهد", "ar"),
        (4, "شارع الملك هاتف", "ar"),  # a word for telephones
        (5, "12345 مصر", "ar"),
        (6, "محمد أحمد", "ar"),  # no word before the name
        (7, None, "ar"),
        (8, "", "ar"),
    ]
    assert found(spark, named, rows, backend) == [(1, "PERSON", "اسمي محمد أحمد", 0.95), (3, "LOCATION", "شارع الملك فهد", 0.95), (5, "LOCATION", "12345 مصر", 0.85)]


@pytest.mark.parametrize("backend", ["native", "arrow"])
def test_recognizers(spark, backend):
    rows = [(1, "Appelez 06 12 34 56 78", "fr"), (2, "رقمي 0512345678", "ar"), (3, "06 12 34 56 78 0512345678", "en"), (4, "12 rue de la Paix 75001 Paris", "fr"), (5, None, "fr")]
    got = found(spark, "recognizers", rows, backend)
    assert {x[:2] for x in got} == {(1, "PHONE_NUMBER"), (2, "PHONE_NUMBER"), (4, "ADDRESS")}
    assert (1, "PHONE_NUMBER", "06 12 34 56 78", 0.8) in got and (2, "PHONE_NUMBER", "0512345678", 0.9) in got


def test_types_of_a_models_finds(spark):
    rows = [
        ("PER", "محمد", "", "PERSON"),
        ("PER", "الرياض", "", "LOCATION"),  # a word for a place
        ("PER", "محمد", "في شارع ", "LOCATION"),  # a word for places before it
        ("PER", "النور", "", "LOCATION"),  # begins as places do
        ("ORG", "النور", "", "ORGANIZATION"),
        ("ORG", "فندق", "", "LOCATION"),
        ("LOC", "x", None, "LOCATION"),
        ("MISC", "x", "", "MISC"),
        (None, "x", "", None),
    ]
    df = spark.createDataFrame(rows, "label string, x string, before string, want string")
    got = df.select("want", score.arabic_type(F.col("label"), F.col("x"), F.col("before")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
