"""Learned operators: rule counts by brute force, held-out accuracy, and defined results of odd rows."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from veilspark.llm import common, lang_crf, lattice_lm, quality_classifier, quality_rules, queries

SF = "/root/testdata/sf0.01"
ODD = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "12 34 !!"), (5, "word " * 20_000), (6, "é"), (6, "é"), (7, "x" * 50_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, 2.0) for i, t in ODD], "doc_id long, text string, n_words int, score double").repartition(2)


def fold(i, m):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else set(windows)
    hit = {k + j for k, w in enumerate(windows) if w in twice for j in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit)


def test_rules_query(spark):
    rows = {r.doc_id: r.text for r in common.read(spark, "/root/testdata/sf0.001", "documents").collect()}
    for r in queries.op10_quality_rules(spark, "/root/testdata/sf0.001").collect():
        want = plain_counts(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_rules_tell_junk(spark):
    labels = {r.doc_id: r.quality for r in common.read(spark, SF, "labels").collect()}
    got = [(r.kept, labels[r.doc_id]) for r in queries.op10_quality_rules(spark, SF).collect() if r.doc_id in labels and not r.base_failed]
    clean, junk = [k for k, q in got if q == 1], [k for k, q in got if q == 0]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.2


def test_rules_mind_repeated_lines(spark):
    docs, labels = common.read(spark, SF, "documents").select("doc_id", "text"), common.read(spark, SF, "labels")
    forest = quality_rules.fit(docs, labels)
    rows = quality_rules.statistics(docs.join(labels.where("quality = 1").select("doc_id"), "doc_id")).toPandas()
    x = rows[list(quality_rules.COUNTS)].to_numpy(np.int64)
    x = x[~quality_rules.base_failed(x)]
    assert (forest.score(quality_rules.features(x)) < forest.threshold).mean() > 0.98
    x[:, 3], x[:, 5] = 36, 40  # duplicate lines, lines
    assert (forest.score(quality_rules.features(x)) < forest.threshold).mean() < 0.1


def test_rules_odd_rows(spark, odd):
    forest = quality_rules.fit(odd, spark.createDataFrame([(5, 1), (7, 0)], "doc_id long, quality int"))
    got = quality_rules.judge(odd, forest).collect()
    assert sorted((str(r.doc_id), r.n_words, r.base_failed) for r in got) == sorted([("None", 0, True), ("1", 0, True), ("2", 0, True), ("3", 0, True), ("4", 3, True), ("5", 20_000, True), ("6", 1, True), ("6", 1, True), ("7", 1, True)])
    assert quality_rules.fit(odd, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert quality_rules.judge(odd.limit(0), None).collect() == []


def test_forest_paths_and_threshold():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(500, 3)), rng.normal(size=(10, 3)) + 9])
    forest = quality_rules.Forest.grow(x)
    s = forest.score(x)
    assert s[500:].min() > np.quantile(s[:500], 0.97) and 0 < s.min() and s.max() < 1
    junk = np.arange(510) >= 500
    forest.calibrate(x, junk, 10.0)
    assert ((s >= forest.threshold) == junk).mean() > 0.98
    forest.calibrate(x, np.zeros(510, bool), 10.0)
    assert forest.threshold < 1 or (s < forest.threshold).all()


def test_classifier_held_out(spark):
    labels = {r.doc_id: r.quality for r in common.read(spark, SF, "labels").collect()}
    rows = queries.op6_quality_classifier(spark, SF).collect()
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == q for p, q in held]) > 0.95
    assert queries.op6_quality_classifier(spark, SF).exceptAll(spark.createDataFrame(rows, "doc_id long, held_out boolean, score double, predicted int")).count() == 0


def test_classifier_odd_rows(spark, odd):
    none = quality_classifier.score(odd, quality_classifier.fit(odd, spark.createDataFrame([], "doc_id long, quality int")))
    assert {r.score for r in none.collect()} == {0.5}
    w = quality_classifier.fit(odd, spark.createDataFrame([(5, 1), (4, 0), (4, 1), (None, 1), (1, 1)], "doc_id long, quality int"))
    got = quality_classifier.score(odd, w).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (None, 1, 2, 3)}) == 1


def test_ftrl_follows_the_formula():
    docs, y = [np.array([3, 3, 5]), np.array([5])], np.array([1.0, 0.0])
    w = quality_classifier.train_ftrl(docs, y, alpha=0.5, beta=1.0, l1=0.0, l2=0.1, rounds=1, scale=1.0)
    z, n = np.zeros(3), np.zeros(3)  # features 3, 5, bias
    weigh = lambda: -z / ((1 + np.sqrt(n)) / 0.5 + 0.1)
    for x, t in ((np.array([2 / 3, 1 / 3, 1]), 1.0), (np.array([0, 1.0, 1.0]), 0.0)):
        v = weigh()
        g = (1 / (1 + math.exp(-v @ x)) - t) * x
        s = (np.sqrt(n + g * g) - np.sqrt(n)) / 0.5
        z, n = z + g - s * v, n + g * g
    assert np.allclose(weigh(), [w[3], w[5], w[-1]], atol=1e-6)


def test_language_held_out(spark):
    langs = {r.doc_id: r.lang for r in common.read(spark, SF, "documents").collect()}
    rows = queries.op8_language_id(spark, SF).collect()
    assert len(rows) == len(langs) and all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) > 0.97


def test_language_odd_rows(spark, odd):
    docs = odd.withColumn("lang", F.when(F.col("doc_id") == 5, "en").when(F.col("doc_id") == 7, "xx").when(F.col("doc_id") == 1, "yy"))
    model = lang_crf.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_crf.predict(odd, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (None, 1, 2, 3, 4)) and got[5][0] == "en" and got[7][0] == "xx"
    assert {r.lang_pred for r in lang_crf.predict(odd, lang_crf.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}
    assert lang_crf.predict(odd.limit(0), model).collect() == []
    kept = lang_crf.predict(odd, model, keep_text=True)
    assert kept.where("text is not null").count() == len(ODD) - 2


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    emit, move, start = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    there = np.array([[True] * 4, [True, True, False, False]])
    emit[1, 2:] = 0
    got, pairs = lang_crf.forward_backward(emit, move, start, there)
    want_pairs = np.zeros((3, 3))
    for c, n in ((0, 4), (1, 2)):
        paths = list(itertools.product(range(3), repeat=n))
        w = np.array([math.exp(start[p[0]] + sum(emit[c, t, p[t]] for t in range(n)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False))) for p in paths])
        w /= w.sum()
        for t in range(n):
            assert np.allclose(got[c, t], [w[[p[t] == k for p in paths]].sum() for k in range(3)])
        for p, x in zip(paths, w, strict=True):
            for a, b in zip(p, p[1:], strict=False):
                want_pairs[a, b] += x
    assert np.allclose(pairs, want_pairs)


def test_chains_cross_blocks_and_long_words_keep_their_features():
    rng = np.random.default_rng(8)
    model = lang_crf.Model(["a", "b", "c"], {}, rng.normal(size=(1 << lang_crf.BITS, 3)).astype(np.float32), rng.normal(size=(3, 3)) * 2, rng.normal(size=3))
    e = lang_crf.Emissions(model)
    texts = [[f"w{rng.integers(50)}" for _ in range(n)] for n in (1, 63, 64, 65, 128, 129, 500, 3)]
    got = e.shares([e.codes(t) for t in texts])
    for t, shares in zip(texts, got, strict=True):
        whole = e.scores[e.codes(t)].astype(float)[None]
        marginal, _ = lang_crf.forward_backward(whole, model.move, model.start, np.ones((1, len(t)), bool))
        assert np.allclose(shares, marginal[0].mean(0))
    word = "".join(chr(97 + k % 26) for k in range(300))
    assert len(lang_crf.features(word, {})) == 2 + 6 + 301 + 300
    assert np.allclose(e.scores[e.codes([word])[0]], model.weights[lang_crf.joined([lang_crf.features(word, {})])[0]].sum(0), atol=1e-3)


def test_code_switched_words():
    model = lang_crf.train(["the cat and the dog"] * 30 + ["der hund und die katze"] * 30, ["en"] * 30 + ["de"] * 30, rounds=20)
    e = lang_crf.Emissions(model)
    shares = e.shares([e.codes(lang_crf.words("the cat and the dog der hund")), e.codes(lang_crf.words("und die katze"))])
    assert model.labels == ["de", "en"] and shares[0, 1] > 0.55 and shares[1, 0] > 0.8 and np.allclose(shares.sum(1), 1)


VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def base_scores(rows):
    counts, scored = {}, {}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    for i, t in rows:
        if fold(i, 5) != 1:
            for w in split(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        ws = split(t)
        scored[i] = (len(ws), sum(w in counts for w in ws), n, sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    return scored


def plain_marginal(pieces, names, word):
    """Probability of a word by plain recursion over the ends of its pieces."""
    word = lattice_lm.MARK + word
    sums = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - 30), j):
            if word[i:j] in names:
                sums[j] += sums[i] * math.exp(pieces.logs[names[word[i:j]]])
        sums[j] += sums[j - 1] * math.prod(math.exp(pieces.logs[b]) for b in word[j - 1].encode())
    return sums[-1]


@pytest.mark.parametrize("common_words", [40, 100_000])
def test_lm_query_against_plain_recursion(spark, common_words):
    docs = common.read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = common.fold(F.col("doc_id"), 5) == 1
    got = lattice_lm.score(docs.withColumn("own", F.lit(1)).withColumn("Rest", F.lit(2)), ~held, VOCABULARY, common_words=common_words).collect()
    assert len(got) == len(rows) and got[0].own == 1 and got[0].Rest == 2
    want = base_scores(rows)
    pieces = lattice_lm.Pieces.load(VOCABULARY)
    names = {n: k for k, n in enumerate(pieces.names) if k >= 256}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts = Counter(w for i, t in rows if fold(i, 5) != 1 for w in [*split(t), None])
    n, v, known = counts.total(), len(counts), {}
    texts = dict(rows)
    for r in got:
        tokens, seen, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, seen, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        score = math.log10((counts[None] + (v + 1) * lattice_lm.END_SHARE) / (n + v + 1))
        for w in split(texts[r.doc_id]):
            if w not in known:
                known[w] = math.log10((counts[w] + (v + 1) * (1 - lattice_lm.END_SHARE) * plain_marginal(pieces, names, w)) / (n + v + 1))
            score += known[w]
        assert r.score == pytest.approx(score, rel=1e-9)


def test_lm_odd_rows(spark, odd):
    got = lattice_lm.score(odd, F.lit(True), VOCABULARY).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in got) == sorted([("None", 1, 1), ("1", 1, 1), ("2", 1, 1), ("3", 1, 1), ("4", 4, 4), ("5", 20_001, 20_001), ("6", 2, 2), ("6", 2, 2), ("7", 2, 2)])
    assert all(math.isfinite(r.score) for r in got)
    untrained = lattice_lm.score(odd, F.lit(False), VOCABULARY).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) and math.isfinite(r.base_score) for r in untrained)
    assert lattice_lm.score(odd.limit(0), F.lit(True), VOCABULARY).collect() == []


def test_marginal_against_enumeration():
    names = [f"<0x{b:02X}>" for b in range(256)] + ["▁", "▁a", "a", "ab", "b", "ba", "bab"]
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.ones(len(names)))
    pieces = lattice_lm.Pieces(names, np.log(p).tolist())
    prob = dict(zip(names, p, strict=True))

    def cuts(s):
        if not s:
            yield []
        for j in range(1, len(s) + 1):
            heads = [[s[:j]]] if s[:j] in prob else []
            if j == 1:
                heads.append([f"<0x{b:02X}>" for b in s[0].encode()])
            for h in heads:
                for rest in cuts(s[j:]):
                    yield h + rest

    for s in ("▁ab", "▁babab", "▁zé", "▁"):
        all_cuts = list(cuts(s))
        weights = [math.prod(prob[x] for x in c) for c in all_cuts]
        assert pieces.marginals([s, "▁ab", s])[2] == pytest.approx(math.log(sum(weights)), rel=1e-9)


def test_long_words_block_by_block():
    pieces = lattice_lm.Pieces.load(VOCABULARY)
    word = lattice_lm.MARK + "internationalisation" * 40
    codes = np.array([[ord(c) for c in word]], np.uint32)
    whole = pieces.forward(codes)[0]
    assert all(pieces.forward(codes, block=b)[0] == pytest.approx(whole, rel=1e-12) for b in (1, 7, 100, 799, 801))


def test_learning_raises_likelihood(spark):
    docs = common.read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    held = common.fold(F.col("doc_id"), 5) == 1
    total = lambda df: df.where(held).agg(F.sum("score")).first()[0]
    learnt = total(lattice_lm.score(docs, ~held, VOCABULARY))
    assert learnt > total(lattice_lm.score(docs, F.lit(False), VOCABULARY)) * 0.8
