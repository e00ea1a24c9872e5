"""Language identification: a linear-chain conditional random field over words.

Each word of a text gets a label by forward-backward; its features are hashed affixes,
character n-grams, the word itself and its entry in a lexicon of the languages' common
words. Transitions between labels are learnt with the feature weights. A document's
language is the label with the largest mean marginal over its words, so code-switched
text yields a mixture whose largest share wins.

A text is one chain, whatever its length, and a word has all its n-grams. For speed and bounded
memory a chain is worked on in blocks of CHAIN words: the product of each block's factors is a
small matrix, so the messages that enter a block from before and behind are exact. For learning,
each block is a chain of its own.

Defined results: text that is null or has no letter is `und` with score 0, as is every
text when there is nothing to learn from. Ties go to the language first in sorted order.
Rows are independent; an empty table gives an empty result. Other columns pass through;
lang_pred and score are replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from . import common

BITS = 16
#: Words in a block of a chain.
CHAIN = 64
#: Documents that are learnt from, at most about.
SAMPLE_ROWS = 1_500
#: Entries of the lexicon, at most, for each language.
LEXICON = 300
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"
REMEMBERED = 200_000
#: Blocks that are labelled together, and features that are summed together, besides those of one longer text or word.
SLAB, FEATURES = 2_048, 1 << 18


def words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def features(word: str, lexicon: dict[str, int]) -> list[str]:
    """Names of a word's features."""
    closed = f"<{word}>"
    names = [f"w{word}", f"l{lexicon.get(word, 0)}"]
    names += [f"p{closed[:k]}" for k in (2, 3, 4)] + [f"s{closed[-k:]}" for k in (2, 3, 4)]
    names += [closed[i : i + 2] for i in range(len(closed) - 1)] + [closed[i : i + 3] for i in range(len(closed) - 2)]
    return names


def forward_backward(emit: np.ndarray, move: np.ndarray, start: np.ndarray, there: np.ndarray, behind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels (chains, words, labels) and, summed, of label pairs; `there` masks words.

    start: ln of the message that enters each chain, or all; behind: the message that comes back into each chain's end.
    """
    chains, steps, labels = emit.shape
    peak = emit.max(2, keepdims=True)
    e = np.exp(emit - peak)
    m = np.exp(move)
    forward, scale = np.empty_like(e), np.empty((chains, steps, 1))
    a = np.exp(start) * e[:, 0]
    for t in range(steps):
        if t:
            a = (forward[:, t - 1] @ m) * e[:, t]
        scale[:, t] = a.sum(1, keepdims=True)
        forward[:, t] = a / scale[:, t]
    marginal, pairs = np.empty_like(e), np.zeros((labels, labels))
    b = np.ones((chains, labels)) if behind is None else behind
    for t in range(steps - 1, -1, -1):
        marginal[:, t] = forward[:, t] * b
        if t:
            onward = e[:, t] * b / scale[:, t]
            pairs += m * np.einsum("ci,cj->ij", forward[:, t - 1] * there[:, t, None], onward)
            # behind the last word of a chain nothing is known: the recursion starts afresh
            b = np.where(there[:, t, None], onward @ m.T, 1.0)
    return marginal / marginal.sum(2, keepdims=True), pairs


def chained(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word codes of texts as rows of CHAIN words (0 pads), which words are there, and each row's text."""
    sizes = np.diff(ends, prepend=0)
    rows = -(-sizes // CHAIN)
    text = np.repeat(np.arange(len(sizes)), rows)
    first = np.cumsum(rows) - rows
    at = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    out = np.zeros((int(rows.sum()), CHAIN), np.int64)
    there = np.zeros(out.shape, bool)
    row = np.repeat(first, sizes) + at // CHAIN
    out[row, at % CHAIN] = codes
    there[row, at % CHAIN] = True
    return out, there, text


def messages(emit: np.ndarray, move: np.ndarray, start: np.ndarray, there: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the forward message that enters each block, and the backward message that comes into its end.

    Blocks of one text follow each other. A block's matrix is the product of its words' emissions and the moves between them.
    """
    n, steps, labels = emit.shape
    m, e = np.exp(move), np.exp(emit - emit.max(2, keepdims=True))
    through, whole = np.eye(labels)[None] * e[:, 0, None, :], there.all(1)
    for rows in (whole, ~whole):
        part, own, live = through[rows], np.ascontiguousarray(e[rows].transpose(1, 0, 2)), there[rows]
        for t in range(1, steps if len(part) else 0):
            on = (part.reshape(-1, labels) @ m).reshape(part.shape)
            on *= own[t][:, None, :]
            part = on if rows is whole else np.where(live[:, t, None, None], on, part)
            if t % 8 == 7:
                part /= part.max((1, 2), keepdims=True)
        through[rows] = part
    through /= through.max((1, 2), keepdims=True)
    first = np.searchsorted(text, text)
    nth = np.arange(n) - first
    by = np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[by], np.arange(int(nth.max(initial=0)) + 2))
    ahead, back = np.empty((n, labels)), np.ones((n, labels))
    for d in range(len(cuts) - 1):
        r = by[cuts[d] : cuts[d + 1]]
        v = np.einsum("ri,rij->rj", ahead[r - 1], through[r - 1]) @ m if d else np.exp(start)[None].repeat(len(r), 0)
        ahead[r] = v / v.sum(1, keepdims=True)
    for d in range(len(cuts) - 2, 0, -1):
        r = by[cuts[d] : cuts[d + 1]]
        v = np.einsum("rij,rj->ri", through[r], back[r]) @ m.T
        back[r - 1] = v / v.sum(1, keepdims=True)
    with np.errstate(divide="ignore"):
        return np.log(ahead), back


def joined(parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 1 on of the features of some words one after another, and where each word's start."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    hashes = np.fromiter(map(xxh32_intdigest, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
    return 1 + hashes % ((1 << BITS) - 1), np.cumsum(sizes) - sizes


@dataclass
class Model:
    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray  # (2 ** BITS, labels); row 0 is zero
    move: np.ndarray
    start: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def pack(self) -> bytes:
        return common.packed(labels=np.array(self.labels), names=np.array(list(self.lexicon) or [""]), marks=np.array(list(self.lexicon.values()) or [0]), weights=self.weights.astype(np.float32), move=self.move, start=self.start)

    @classmethod
    def unpack(cls, raw: bytes) -> Model:
        x = common.unpacked(raw)
        return cls(x["labels"].tolist(), dict(zip(x["names"].tolist(), x["marks"].tolist(), strict=True)), x["weights"], x["move"], x["start"])


def lexicon_of(texts: list[list[str]], labels: list[int]) -> dict[str, int]:
    """Common words of each language -> number of the set of languages they are common in."""
    counts: dict[int, Counter] = {}
    for ws, y in zip(texts, labels, strict=True):
        counts.setdefault(y, Counter()).update(ws)
    common_in: dict[str, list[int]] = {}
    for y in sorted(counts):
        for w, _ in sorted(counts[y].items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            common_in.setdefault(w, []).append(y)
    sets = {s: k + 1 for k, s in enumerate(sorted({tuple(v) for v in common_in.values()}))}
    return {w: sets[tuple(v)] for w, v in common_in.items()}


def train(texts: list[str], langs: list[str], *, rounds: int = 3, rate: float = 0.05, decay: float = 1e-6, seed: int = 11) -> Model | None:
    """Adam on the conditional likelihood; every word of a text carries the text's language."""
    labels = sorted(set(langs))
    split = [words(t) for t in texts]
    gold = [labels.index(x) for x in langs]
    lexicon = lexicon_of(split, gold)
    vocabulary: dict[str, int] = {}
    codes = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for ws in split for w in ws], np.int64)
    if not len(codes):
        return None
    flat, first = joined([[""], *(features(w, lexicon) for w in vocabulary)])
    flat[0] = 0  # pads
    size = np.diff(first, append=len(flat))
    rows, there, text = chained(codes, np.cumsum([len(ws) for ws in split]))
    y = np.array(gold)[text]
    n = len(labels)
    shapes = {"w": (1 << BITS, n), "m": (n, n), "s": (n,)}
    p, m1, m2 = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(3))
    rng, step = np.random.default_rng(seed), 0
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
            r, th, yy = rows[part], there[part], y[part]
            kinds, back = np.unique(r, return_inverse=True)
            ends = np.cumsum(size[kinds])
            f = flat[np.arange(ends[-1]) + np.repeat(first[kinds] - ends + size[kinds], size[kinds])]
            emit = np.add.reduceat(p["w"][f], ends - size[kinds], axis=0)[back].reshape(*r.shape, n)
            marginal, pairs = forward_backward(emit, p["m"], p["s"], th)
            truth = np.zeros_like(marginal)
            truth[np.arange(len(r)), :, yy] = 1
            d = (marginal - truth) * th[..., None]
            by_kind = np.column_stack([np.bincount(back.ravel(), d[..., k].ravel(), len(kinds)) for k in range(n)])
            grad = {"w": np.column_stack([np.bincount(f, np.repeat(by_kind[:, k], size[kinds]), 1 << BITS) for k in range(n)])}
            stays = np.zeros((n, n))
            np.add.at(stays, (yy, yy), np.maximum(th.sum(1) - 1, 0))
            grad["m"], grad["s"] = pairs - stays, (marginal[:, 0] - truth[:, 0]).sum(0)
            step += 1
            for k, g in grad.items():
                g = g / max(th.sum(), 1) + decay * p[k]
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.001 * (g * g - m2[k])
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-9)
            p["w"][0] = 0
    return Model(labels, lexicon, p["w"], p["m"], p["s"])


def fit(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """A model learnt from about `sample_rows` rows of `docs` with a language and a text."""

    def run(table: pa.Table) -> bytes:
        model = train(table.column("text").to_pylist(), table.column("lang").to_pylist())
        return model.pack() if model else b""

    rows = docs.select(F.xxhash64(F.lit(17), F.col(key)).alias("mixed"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null").where(F.octet_length("text") <= common.SAMPLE_TEXT_BYTES)
    total, share = rows.count(), 1 << 30
    if total > sample_rows:
        rows = rows.where(F.pmod("mixed", F.lit(share)) < int(share * sample_rows / total))
    raw = common.in_one_task(rows, run, ["mixed", "text", "lang"])
    return Model.unpack(raw) if raw else None


class Emissions:
    """word -> row of label scores; starts afresh when it grows past its bound."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1 << 14, len(self.model.labels)), np.float32)

    def codes(self, ws: list[str]) -> np.ndarray:
        """Rows of the words of one text from 1 on; row 0 is zero."""
        fresh = [w for w in set(ws) if w not in self.rows]
        if fresh:
            first = len(self.rows) + 1
            while first + len(fresh) >= len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            held, size, at = [], 0, first
            for k, w in enumerate(fresh, 1):
                held.append(features(w, self.model.lexicon))
                size += len(held[-1])
                if size > FEATURES or k == len(fresh):
                    flat, starts = joined(held)
                    self.scores[at : at + len(held)] = np.add.reduceat(self.model.weights[flat], starts, axis=0)
                    held, size, at = [], 0, at + len(held)
            self.rows.update((w, first + k) for k, w in enumerate(fresh))
        return np.fromiter(map(self.rows.__getitem__, ws), np.int64, len(ws))

    def shares(self, codes: list[np.ndarray]) -> np.ndarray:
        """Mean marginals of the labels for each text."""
        ends = np.cumsum([len(c) for c in codes])
        rows, there, text = chained(np.concatenate(codes), ends)
        out = np.zeros((len(codes), len(self.model.labels)))
        at = 0
        while at < len(rows):
            # whole texts, of SLAB blocks or so
            end = int(np.searchsorted(text, text[min(at + SLAB, len(rows)) - 1], side="right"))
            part = slice(at, end)
            emit = self.scores[rows[part]].astype(float)
            start, behind = messages(emit, self.model.move, self.model.start, there[part], text[part])
            marginal, _ = forward_backward(emit, self.model.move, start, there[part], behind)
            by_block = (marginal * there[part][..., None]).sum(1)
            for k in range(by_block.shape[1]):
                out[:, k] += np.bincount(text[part], by_block[:, k], len(codes))
            at = end
        return out / np.maximum(np.diff(ends, prepend=0), 1)[:, None]


def predict(df: DataFrame, model: Model | None, text: str = "text", *, keep_text: bool = False) -> DataFrame:
    """`df` (without `text`, unless it is kept), with lang_pred and score (the mean marginal of lang_pred) of each whole text."""

    def make():
        known = common.keep(("crf", model.key), lambda: Emissions(model)) if model else None

        def each(batch):
            texts = common.as_texts(batch.column(text))
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            waiting: list[tuple[int, np.ndarray]] = []

            def flush():
                shares = known.shares([c for _, c in waiting])
                for (i, _), s in zip(waiting, shares, strict=True):
                    k = int(np.argmax(s))
                    best[i], score[i] = model.labels[k], min(1.0, float(s[k]))
                waiting.clear()
                if len(known.rows) > REMEMBERED:
                    known.reset()

            held = 0
            for i, t in enumerate(texts if model else ()):
                if ws := words(t):
                    waiting.append((i, known.codes(ws)))
                    held += len(ws)
                    if held > SLAB * CHAIN:
                        flush()
                        held = 0
            if waiting:
                flush()
            return common.replaced(batch, [] if keep_text else [text], lang_pred=pa.array(best, pa.string()), score=pa.array(score))

        return each

    kept = df.drop("lang_pred", "score")
    rest = kept if keep_text else kept.drop(text)
    return common.arrow_map(kept, make, rest.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)
