"""Decontamination and the whole pipeline against brute force."""

import random

import pytest

import corpus_pipeline
from veilspark.llm import bpe, common, decontaminate, simhash

SF = "/root/testdata/sf0.001"


def brute(texts, items, overlap=decontaminate.OVERLAP):
    """Items whose question and answer a text has: four fifths of the shingles, or all words in a row of what is shorter."""

    def has(ws, part):
        if len(part) < 5:
            return any(ws[k : k + len(part)] == part for k in range(len(ws) - len(part) + 1))
        there = {" ".join(ws[k : k + 5]) for k in range(len(ws) - 4)}
        own = {" ".join(part[k : k + 5]) for k in range(len(part) - 4)}
        return len(own & there) / len(own) >= overlap

    parts = [(i, [decontaminate.words(p) for p in decontaminate.question_and_answer(t)]) for i, t in items if t and decontaminate.words(t)]
    out = {}
    for d, t in texts:
        ws = decontaminate.words(t or "")
        out[d] = sorted(i for i, p in parts if all(has(ws, x) for x in p if x))
    return out


def test_real_text(spark):
    docs, items = common.read(spark, SF, "documents"), common.read(spark, SF, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = decontaminate.mark(docs, items).collect()
    assert {r.doc_id: [h.item_id for h in r.hits] for r in got} == want and any(want.values())
    assert all(r.contaminated == bool(r.hits) for r in got)


def test_planted_passages_are_found_and_others_not(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(6, 90))) + ".\nThe answer is " + rng.choice(words)) for k in range(60)]
    texts = []
    for k in range(150):
        body = [rng.choice(words) for _ in range(rng.randrange(0, 600))]
        at = rng.randrange(0, len(body) + 1)
        item = items[rng.randrange(60)][1].upper() if k % 3 == 0 else ""
        texts.append((k, " ".join([*body[:at], item, *body[at:]])))
    long = " ".join(f"q{k}" for k in range(30))
    items += [(61, long + "? An answer that is long enough"), (62, "Paris is lovely")]
    texts += [(900, None), (901, ""), (902, "... !!"), (903, "z " * 100_000 + items[5][1] + " z" * 100_000)]
    texts += [(910, long), (911, long + " z" * 700 + " an answer that is long enough"), (912, "so Paris is lovely, too"), (913, "paris is so lovely"), (914, "one two three")]
    table = spark.createDataFrame([(i, t, [1], True) for i, t in texts], "doc_id int, text string, hits array<int>, contaminated boolean")
    bench = spark.createDataFrame([*items, (70, None), (71, " "), (72, "one two")], "item_id long, text string")
    got = {r.doc_id: [h.item_id for h in r.hits] for r in decontaminate.mark(table, bench).collect()}
    assert got == brute(texts, items + [(72, "one two")])
    assert all(got[k] for k in range(0, 150, 3)) and got[903] == [5]
    assert [got[k] for k in range(910, 915)] == [[], [61], [62], [], [72]]
    assert decontaminate.mark(table.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.mark(table, bench.limit(0)).collect())


def test_search_finds_all_above_threshold():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 30)))) for k in range(300)]
    index = decontaminate.Index.build(items)
    assert index.block > 1
    own = [dict() for _ in index.ids]
    for w, k in index.terms.items():
        for p in range(index.first[k], index.first[k + 1]):
            own[index.items[p]][w] = index.scores[p]
    assert all(abs(sum(o.values()) - 1) < 1e-9 for o in own)
    for threshold in (0.3, 0.5, 0.9):
        text = [rng.choice(words) for _ in range(500)]
        import numpy as np

        found = index.search(np.array([index.terms.get(w, 0) for w in text]), threshold)
        half = index.passage // 2
        for p in range(max(1, -(-len(text) // half) - 1)):
            there = set(text[p * half : (p + 2) * half])
            want = {d for d, o in enumerate(own) if sum(s for w, s in o.items() if w in there) >= threshold}
            assert set(found.get(p, [])) == want


def test_items_longer_than_a_slab(monkeypatch):
    monkeypatch.setattr(decontaminate, "SLAB", 256)
    item = " ".join(f"w{k}" for k in range(400))
    index = decontaminate.Index.build([(1, item), (2, "a b c d e f")])
    assert [x[0] for x in index.leaks("z " * 900 + item + " z" * 900, 0.5, 0.8)] == [1] and index.leaks("z " * 900, 0.5, 0.8) == []


def test_shards_give_the_same(spark):
    docs, items = common.read(spark, SF, "documents").select("doc_id", "text"), common.read(spark, SF, "benchmark")
    whole = {r.doc_id: r.hits for r in decontaminate.mark(docs, items).collect()}
    assert len(list(decontaminate.shards(items, 7))) > 3
    assert {r.doc_id: r.hits for r in decontaminate.mark(docs, items, size=7).collect()} == whole


def test_question_and_answer():
    assert decontaminate.question_and_answer("What is it? It is so. Yes.") == ("What is it? It is so.", "Yes.")
    assert decontaminate.question_and_answer("Just one") == ("Just one", "")


@pytest.fixture(scope="module")
def staged(spark):
    docs = [common.read(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(common.materialize(stage(spark, docs[-1], SF), name).cache())
    return docs


def test_stages(spark, staged):
    start, language, lines, near, clean, encoded = staged
    assert all(d.columns == start.columns for d in staged[:-1])
    n = [d.count() for d in staged]
    assert n == sorted(n, reverse=True) and n[0] > n[-1] > 0
    dropped = start.join(language, "doc_id", "left_anti").collect()
    assert len(dropped) <= 0.02 * n[0]
    assert lines.count() == language.count() and all(r.n_chars == len(r.text) for r in lines.collect())
    found = simhash.near_duplicates(lines.select("doc_id", "text"))
    assert {r.doc_id for r in near.collect()} == {r.component_id for r in found.collect()}
    want = brute([(r.doc_id, r.text) for r in near.collect()], [(r.item_id, r.text) for r in common.read(spark, SF, "benchmark").collect()])
    assert {r.doc_id for r in clean.collect()} == {d for d, hits in want.items() if not hits}
    import public_tokenizers

    counts = bpe.count_tokens(clean.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted((r.doc_id, r.n_tokens) for r in counts.collect()) == sorted((r.doc_id, r.n_tokens) for r in encoded.collect())


def test_language_stage_without_a_model(spark):
    rows = [(1, "plain words"), (2, None), (3, "12 !!"), (4, ""), (5, "É\n2")]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()} == {1, 5}


def test_run_is_the_stages(spark, staged):
    got = corpus_pipeline.run(spark, SF)
    assert got.exceptAll(staged[-1]).count() == 0 == staged[-1].exceptAll(got).count()


def test_pipeline_odd_rows(spark):
    line = "a line of text that is long enough to count, in plain English words"
    rows = [(None, line, "en", None, None), (1, None, None, "s", 3), (2, "", "en", "s", 0), (3, "!!", "en", "s", 2), (4, line, "en", "s", 5), (4, line, "en", "s", 5), (5, line + " too", "fr", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.collect() == []
        docs = common.materialize(stage(spark, docs, SF), name)
    assert docs.count() >= 1


def test_rare_words_lose_nothing(spark):
    """One item among 3,000 alike ones; the text differs in the one word that is rare."""
    frame = "in the year of the great flood a merchant from {0} carried twenty sacks of grain across the river to the market at {1} and sold them all to the last of his old friends. The price was nine coins"
    items = [(k, frame.format(f"town{k}", "hill")) for k in range(3000)]
    items.append((5000, frame.format("venice", "genoa")))
    text = "x y z " * 50 + frame.format("venice", "padua") + " q r" * 60
    assert brute([(1, text)], items[-1:])[1] == [5000]
    docs = spark.createDataFrame([(1, text), (2, "in the year of the great flood " * 20)], "doc_id long, text string")
    for size in (decontaminate.SHARD, 700):
        got = {r.doc_id: [h.item_id for h in r.hits] for r in decontaminate.mark(docs, spark.createDataFrame(items, "item_id long, text string"), size=size).collect()}
        assert 5000 in got[1] and got[2] == []
        assert got[1] == brute([(1, text)], items)[1]


def test_no_accepted_copy_is_lost(spark):
    """Items with words left out and put in, at random, against brute force; for all sizes of shard."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(30)] + [f"rare{k}" for k in range(300)]
    weights = [30] * 30 + [1] * 300
    items = [(k, " ".join(rng.choices(words, weights, k=rng.randrange(4, 60))) + "? " + " ".join(rng.choices(words, weights, k=rng.randrange(1, 12)))) for k in range(80)]
    texts = []
    for k in range(400):
        ws = decontaminate.words(items[k % 80][1])
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(ws))
            ws[at : at + 1] = rng.choice([[], ["new"], [ws[at], "put", "in"]])
            ws = ws or ["none"]
        texts.append((k, " ".join([*rng.choices(words, weights, k=rng.randrange(0, 150)), *ws, *rng.choices(words, weights, k=rng.randrange(0, 150))])))
    want = brute(texts, items)
    assert sum(map(bool, want.values())) > 100
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1000, 9):
        got = {r.doc_id: [h.item_id for h in r.hits] for r in decontaminate.mark(spark.createDataFrame(texts, "doc_id long, text string"), bench, size=size).collect()}
        assert got == want
