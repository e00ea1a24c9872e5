"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Tokens are words and runs of marks. Each text's features are its hashed tokens, token
pairs, and pairs and triples of token shapes (capitals, digits, which mark, same as the
one before); values are shares of the text's features, so a score is a sparse dot
product independent of length.

Defined results: null and empty text have no features and score the bias. With no
labelled rows every score is 0.5. Rows are independent; whole texts are read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common

BITS = 18
#: Labelled rows that are learnt from, at most about.
SAMPLE_ROWS = 12_000
TOKEN = regex.compile(r"\w+|[^\w\s]+")
#: Odd multipliers that mix the hashes of an n-gram. Fixed values.
MIX = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
SHIFT = np.uint64(64 - BITS)
REMEMBERED = 400_000


def shape(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:4]
    if token.isdigit():
        return "9"
    if token.isupper():
        return "A" if len(token) == 1 else "AA"
    return "Aa" if token[0].isupper() else "a"


class Hashes(dict):
    """token -> (hash, hash of its shape); forgets all when it grows past its bound."""

    def __missing__(self, token: str) -> tuple[int, int]:
        value = xxh64_intdigest(token.lower(), 1), xxh64_intdigest(shape(token), 2)
        if len(token) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = value
        return value


def features(text: str, known: Hashes) -> np.ndarray:
    """Feature numbers of a text, each as often as it occurs."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.empty(0, np.int64)
    pairs = np.array([known[t] for t in tokens], np.uint64)
    word, form = pairs[:, 0], pairs[:, 1]
    with np.errstate(over="ignore"):
        form = form + np.where(np.append(False, word[1:] == word[:-1]), MIX[3], np.uint64(0))
        parts = (word, word[:-1] * MIX[1] + word[1:], form * MIX[2], form[:-1] * MIX[3] + form[1:] * MIX[2], (form[:-2] * MIX[1] + form[1:-1]) * MIX[2] + form[2:])
        return (np.concatenate(parts) * MIX[0] >> SHIFT).astype(np.int64)


def train_ftrl(docs: list[np.ndarray], labels: np.ndarray, *, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02, rounds: int = 4, scale: float = 8.0) -> np.ndarray:
    """Weights (the last is the bias) after `rounds` passes of follow-the-regularised-leader."""
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
    sparse = []
    for f in docs:
        i, c = np.unique(f, return_counts=True)
        sparse.append((np.append(i, 2**BITS), np.append(c * (scale / max(len(f), 1)), 1.0)))
    weigh = lambda z, n: np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    share = labels.mean()
    balance = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    for _ in range(rounds):
        for (i, x), y, b in zip(sparse, labels, balance, strict=True):
            w = weigh(z[i], n[i])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * b * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    return (weigh(z, n) * np.append(np.full(2**BITS, scale), 1.0)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> np.ndarray | None:
    """Weights learnt from about `sample_rows` of the labelled documents (doc_id, text; doc_id, quality)."""

    def train(table: pa.Table) -> bytes:
        known = Hashes()
        found = [features(t or "", known) for t in table.column("text").to_pylist()]
        return common.packed(w=train_ftrl(found, table.column("quality").to_numpy().astype(float)))

    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = common.labelled_sample(docs.select("doc_id", "text"), marks, sample_rows)
    raw = common.in_one_task(sample.withColumn("mixed", F.xxhash64("doc_id")), train, ["mixed", "doc_id", "text"])
    return common.unpacked(raw)["w"] if raw else None


def score(df: DataFrame, weights: np.ndarray | None, text: str = "text", to: str = "score") -> DataFrame:
    """`df` without `text`, with the probability of label 1 in column `to`."""

    def make():
        known = common.keep(("hashes",), Hashes)

        def each(batch):
            out = np.full(batch.num_rows, 0.5)
            if weights is not None:
                for k, t in enumerate(common.as_texts(batch.column(text))):
                    f = features(t, known)
                    out[k] = 1 / (1 + np.exp(-np.clip(weights[-1] + (weights[f].mean(dtype=float) if len(f) else 0.0), -35, 35)))
            return common.replaced(batch, [text], **{to: pa.array(out)})

        return each

    kept = df.drop(to)
    return common.arrow_map(kept, make, kept.drop(text).withColumn(to, F.lit(0.0)).schema)
