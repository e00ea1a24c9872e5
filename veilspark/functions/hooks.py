"""Plug-ins: detectors, models and rules that the caller supplies."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules

ENTITY = "array<struct<type:string,text:string,start:int,end:int,score:double,method:string>>"
Detector = Callable[[str, str], list[dict]]


def detector(load: Callable[[], Detector], method: str, fallback: Callable[[], Detector] | None = None) -> Callable[[Column, Column], Column]:
    """A model as a column function (text, lang) -> entities. `load` runs once for each task; if it fails,
    as where a device is short of memory, `fallback` is loaded instead."""

    @F.pandas_udf(ENTITY)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            find = load()
        except (MemoryError, RuntimeError):
            if fallback is None:
                raise
            find = fallback()
        for texts, langs in batches:
            yield pd.Series([[{"method": method} | e for e in find(t, lang)] if t else [] for t, lang in zip(texts, langs, strict=True)])

    return run


def with_retries(call: Callable[[str], str], tries: int = 3, first_wait: float = 1.0) -> Callable[[str], str]:
    """`call`, tried again with doubled waits; the last error is raised."""

    def run(prompt: str) -> str:
        for k in range(tries):
            try:
                return call(prompt)
            except Exception:
                if k == tries - 1:
                    raise
                time.sleep(first_wait * 2**k)
        raise ValueError("tries must be positive")

    return run


def prompted(df: DataFrame, providers: list[Callable[[str], str]], prompt: Callable[[str], str], policy: str = "alternate", text: str = "text", ordinal: str = "chunk") -> DataFrame:
    """`df` with `response`: each text's prompt answered by one provider (the first, all in turn by ordinal, or both joined by newline)."""
    if policy not in ("first", "alternate", "both"):
        raise ValueError(f"no policy {policy!r}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for t, n in zip(frame[text], frame[ordinal], strict=True):
                chosen = providers if policy == "both" else [providers[int(n) % len(providers) if policy == "alternate" else 0]]
                out.append("\n".join(p(prompt(t or "")) for p in chosen))
            yield frame.assign(response=out)

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("response", T.StringType())]))


def tagged_answer(response: Column, text: Column, score: float = 0.8) -> Column:
    """Entities of answers written as [TYPE: text], at the text's first occurrence."""
    pattern = r"\[([A-Z_]+):\s*([^\]]+)\]"
    kinds, texts = F.regexp_extract_all(response, F.lit(pattern), F.lit(1)), F.regexp_extract_all(response, F.lit(pattern), F.lit(2))
    pairs = F.zip_with(kinds, texts, lambda k, t: F.struct(k.alias("type"), t.alias("text"), (F.position(t, text) - 1).alias("start")))
    found = F.filter(pairs, lambda p: p["start"] >= 0)
    return F.transform(found, lambda p: F.struct(p["type"].alias("type"), p["text"].alias("text"), p["start"].cast("int").alias("start"), (p["start"] + F.length(p["text"])).cast("int").alias("end"), F.lit(score).alias("score"), F.lit("llm").alias("method")))


def repositioned(entities: Column, text: Column, reach: int = 15) -> Column:
    """Entities whose text is at their start, or within `reach` characters of it, where it is moved to; others go."""

    def put(e: Column) -> Column:
        low = F.greatest(e["start"] - reach, F.lit(0))
        at = F.position(e["text"], F.substr(text, low + 1, F.length(e["text"]) + e["start"] - low + reach))
        right = F.substr(text, e["start"] + 1, F.length(e["text"])) == e["text"]
        start = F.when(right, e["start"]).when(at > 0, low + at - 1)
        return e.withField("start", start.cast("int")).withField("end", (start + F.length(e["text"])).cast("int"))

    return F.filter(F.transform(entities, put), lambda e: e["start"].isNotNull())


def decoded_labels(tokens: Column) -> Column:
    """B-/I- tagged tokens (label, start, end, score) as entities: runs of one type, with the mean score."""
    kind = "array<struct<type:string,start:int,end:int,total:double,n:int>>"

    def step(acc: Column, t: Column) -> Column:
        tag, name = F.substring(t["label"], 1, 1), F.regexp_replace(t["label"], "^[BI]-", "")
        last = F.try_element_at(acc, F.lit(-1))
        goes_on = (tag == "I") & (last["type"] == name)
        one = F.struct(name.alias("type"), t["start"].cast("int").alias("start"), t["end"].cast("int").alias("end"), t["score"].cast("double").alias("total"), F.lit(1).alias("n"))
        more = F.struct(last["type"].alias("type"), last["start"].alias("start"), t["end"].cast("int").alias("end"), (last["total"] + t["score"]).alias("total"), (last["n"] + 1).alias("n"))
        return F.when(t["label"] == "O", acc).when(F.coalesce(goes_on, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(more))).otherwise(F.concat(acc, F.array(one))).cast(kind)

    runs = F.aggregate(tokens, F.array().cast(kind), step)
    return F.transform(runs, lambda r: F.struct(r["type"].alias("type"), r["start"].alias("start"), r["end"].alias("end"), (r["total"] / r["n"]).alias("score")))


def ner_filter(entities: Column, lang: Column) -> Column:
    """Without entities too short for their type or that are common words."""
    from .validate import common_word

    least = {"PERSON": 4, "ORG": 3, "GPE": 2, "LOC": 2}
    long_enough = F.lit(True)
    return F.filter(entities, lambda e: _long(e, least, long_enough) & ~common_word(e["text"], lang))


def _long(e: Column, least: dict[str, int], default: Column) -> Column:
    out = default
    for name, n in least.items():
        out = F.when(e["type"] == name, F.length(e["text"]) >= n).otherwise(out)
    return out


def base58_payload(address: Column, size: int = 20, alphabet: str = "rpshnaf39wBUDNEGHJKLM4PQRST7VWXYZ2bcdeCg65jkm8oFqi1tuvAxyz") -> Column:
    """Whether an address is base58check with a payload of `size` bytes."""

    @F.pandas_udf("boolean")
    def check(values: pd.Series) -> pd.Series:
        def good(x: str | None) -> bool:
            n = 0
            for c in x or "":
                k = alphabet.find(c)
                if k < 0:
                    return False
                n = n * 58 + k
            zeros = len(x or "") - len((x or "").lstrip(alphabet[0]))
            raw = b"\0" * zeros + (n.to_bytes((n.bit_length() + 7) // 8, "big") if n else b"")
            if len(raw) != size + 5:
                return False
            return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]

        return values.map(good)

    return check(address)


def shuffled_sentences(text: Column, seed: int = 42) -> Column:
    """The sentences of a text in an order given by a hash: the same at each run."""
    sentences = F.split(text, r"(?<=[.!?])\s+")
    keyed = F.transform(sentences, lambda s, i: F.struct(F.xxhash64(F.lit(seed), i, s).alias("k"), s.alias("s")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["s"]), " ")


def registry(spark: SparkSession) -> DataFrame:
    """The rule packs as a table: profile, policy, mask, type, language, method, score, validator, pattern."""
    rows = [(p.name, p.policy, p.mask, r.type, lang, r.method, r.score, r.validator or None, r.pattern) for p in rules.PROFILES.values() for r in p.rules for lang in (r.langs or ("all",))]
    return spark.createDataFrame(rows, "profile string, policy string, mask string, type string, language string, method string, score double, validator string, pattern string")
