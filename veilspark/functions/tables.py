"""Recognizers as table functions: a row for each find, through LATERAL, instead of an array of a whole text.

`rows` joins a table with its finds; `register` gives a pack a name that SQL can call as
`select d.doc_id, f.* from documents d, lateral finds(d.text, d.lang) f`.

Defined results: null and empty texts have no rows. Rows come in the order of `scan`: start, score, order of rule. A language
that the pack does not know uses its English rules. Validators are Spark expressions: `rows` applies them, a registered
function cannot, so packs that have some are refused there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import Profile
from .validate import VALIDATORS

FIND = "ord int, type string, text string, start int, end int, score double, method string"


def table_function(profile: Profile):
    """The pack as a table function (text, lang) -> FIND; ord is the rule's number."""
    rules, languages = profile.rules, profile.languages

    class Finds:
        def __init__(self):
            self.ready = [(k, r, re.compile(r.pattern, re.IGNORECASE if r.ignore_case else 0)) for k, r in enumerate(rules)]

        def eval(self, text: str, lang: str) -> Iterator[tuple]:
            if not text:
                return
            lang = lang if lang in languages else "en"
            found = []
            for k, r, pattern in self.ready:
                if (not r.langs or lang in r.langs) and (not r.needs or r.needs in text):
                    found += [(k, r.type, m[r.group], m.start(r.group), m.end(r.group), r.score, r.method) for m in pattern.finditer(text)]
            yield from sorted(found, key=lambda s: (s[3], -s[5], s[0], s[4]))

    return F.udtf(Finds, returnType=FIND, useArrow=True)


def rows(df: DataFrame, profile: Profile, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """`df` with a row for each valid find: its columns as find_<name>. Texts without one give none."""
    found = table_function(profile)(F.col(text).outer(), F.col(lang).outer())
    names = [c.split()[0] for c in FIND.split(", ")]
    out = df.lateralJoin(found).toDF(*df.columns, *(f"find_{n}" for n in names))
    checked: Column = F.lit(True)
    for name in sorted({r.validator for r in profile.rules if r.validator}):
        of = [k for k, r in enumerate(profile.rules) if r.validator == name]
        checked = F.when(F.col("find_ord").isin(*of), F.coalesce(VALIDATORS[name](F.col("find_text")), F.lit(False))).otherwise(checked)
    return out.where(checked)


def register(spark: SparkSession, name: str, profile: Profile) -> None:
    """Lets SQL call the pack by `name`."""
    if any(r.validator for r in profile.rules):
        raise ValueError(f"{profile.name} has validators, which a registered table function cannot apply: use rows()")
    spark.udtf.register(name, table_function(profile))
