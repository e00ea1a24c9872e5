"""Line dedup and SimHash against brute force."""

import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

import corpus_pipeline
from veilspark.llm import common, line_dedup, simhash

SF = "/root/testdata/sf0.001"


def edit_distance_at_most_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_lines(rows, min_chars):
    """Kept text by row: a line goes if an earlier line of the corpus equals it or, both being long, is one edit away."""
    seen = []
    places = [((i is not None, i or 0), p, line) for i, t in rows if t is not None for p, line in enumerate(t.split("\n")) if line.strip(" \t\n\v\f\r")]
    places.sort(key=lambda x: x[:2])
    gone = set()
    for key, p, line in places:
        long = len(line) >= min_chars
        if any(line == other or (long and len(other) >= min_chars and edit_distance_at_most_one(line, other)) for other in seen):
            gone.add((key, p))
        seen.append(line)
    return [None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if ((i is not None, i or 0), p) not in gone) for i, t in rows]


def edited(rng, line):
    i = rng.randrange(len(line))
    return rng.choice([line[:i] + line[i + 1 :], line[:i] + "aab"[rng.randrange(3)] + line[i:], line[:i] + "aab"[rng.randrange(3)] + line[i + 1 :]])


def test_lines_match_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab ") for _ in range(rng.randrange(18, 70))) for _ in range(60)]
    pool = base + [edited(rng, x) for x in base for _ in range(3)] + [edited(rng, edited(rng, x)) for x in base]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for k in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "é" * 30 + "\n" + "é" * 31 + "\n" + "é" * 29), (104, "x" * 20_000), (105, "x" * 20_001 + "\nshort\nshort\n \n ")]
    text = "".join(rng.choice("abcdef") for _ in range(3000))
    rows += [(110, text), (111, text[:1777] + "?" + text[1778:]), (112, text[:2990] + text[2991:]), (113, text[:1] + "!" + text[1:] + "\n" + text[:40] + "??" + text[42:])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, version int, n_lines int, __gone int, gone int").repartition(5)
    got = {r.doc_id: r for r in line_dedup.dedup(df).collect()}
    want = dict(zip((i for i, _ in rows), brute_lines(rows, line_dedup.MIN_CHARS), strict=True))
    assert {i: r.text for i, r in got.items()} == want
    assert got[100].n_lines == 0 and got[101].n_lines == 1 and got[102].n_dropped == 0 and got[103].n_dropped == 2
    assert got[105].text == "short\n \n " and (got[0].version, got[0]["__gone"], got[0].gone) == (1, 3, 4)
    assert [got[k].n_dropped for k in (110, 111, 112, 113)] == [0, 1, 1, 1]


def test_lines_real_text(spark):
    docs = common.read(spark, SF, "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    assert got == dict(zip((i for i, _ in rows), brute_lines(rows, line_dedup.MIN_CHARS), strict=True))


def test_lines_null_ids_repeated_rows_and_empty_table(spark):
    line = "a line of more than twenty characters"
    df = spark.createDataFrame([(None, line), (1, line), (2, line + "\nmine"), (2, line + "\nmine"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.text)) for r in line_dedup.dedup(df).collect())
    assert got == [("1", ""), ("2", "mine"), ("2", "mine"), ("None", "None"), ("None", line)]
    assert line_dedup.dedup(df.limit(0)).collect() == []
    alone = spark.createDataFrame([(2, line), (2, line), (3, line)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup(alone).collect()) == [(2, line), (2, line), (3, "")]
    with pytest.raises(ValueError):
        line_dedup.dedup(alone, min_chars=15)


def test_stage_removes_repeats_of_short_lines(spark):
    long = "a line of more than twenty characters"
    rows = [(1, f"Home\n\n{long}\nHome"), (2, f"home\nHome\n \nHom\n{long}s\n"), (3, "Home\n \n\nx\nx"), (4, None)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_chars long").repartition(2)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_deduplication(spark, df, SF).collect()}
    assert got == {1: f"Home\n\n{long}", 2: "home\n \nHom\n", 3: " \n\nx", 4: None}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64))


def plain_components(rows):
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return {i: least[root(f)] for i, f in rows if i is not None}


def test_simhash_real_text(spark):
    docs = common.read(spark, SF, "documents").select("doc_id", "text")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    got = simhash.near_duplicates(docs).withColumn("hex", simhash.as_hex(simhash.F.col("fp"))).collect()
    assert {r.doc_id: r.hex for r in got} == {i: f"{f:016x}" for i, f in rows}
    assert {r.doc_id: r.component_id for r in got} == plain_components(rows)


@pytest.mark.parametrize("bits", [1, 2])
@pytest.mark.parametrize("segments", [8, 16])
def test_links_match_brute_force(spark, bits, segments):
    rng = random.Random(bits + segments)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(40):
            fps.add(f)
            for _ in range(rng.randrange(1, 4)):
                f ^= 1 << rng.randrange(64)
    fps |= {0, (1 << 64) - 1, 1 << 63, (1 << 63) | 1, 1 << 31, 3} | {0xABCD << 40 | k for k in range(200)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(df, bits=bits, segments=segments).collect()]
    listed = sorted(map(signed, fps))
    assert sorted(edges) == [(a, b) for k, a in enumerate(listed) for b in listed[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits]
    if bits < 2:
        return
    got = {r.v: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = {f: k for k, f in enumerate(sorted(fps, key=signed))}
    want = plain_components([(ids[f], f) for f in fps])
    names = {ids[f]: signed(f) for f in fps}
    assert {signed(f): got.get(signed(f), signed(f)) for f in fps} == {signed(f): names[want[ids[f]]] for f in fps}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.v: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}


def test_simhash_odd_rows(spark):
    rows = [(3, None), (1, ""), (2, " \t\n"), (None, ""), (5, "one"), (6, "ONE"), (6, "ONE"), (7, "É x"), (8, "word " * 30_000), (None, "only null id here")]
    df = spark.createDataFrame([(*r, 9, 8, 7, 6, 5) for r in rows], "doc_id long, text string, fp int, __fp int, Version int, hash int, row int")
    assert simhash.similar(df).where("Version = 7 and hash = 6 and row = 5").count() == len(rows)
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(3, 1), (1, 1), (2, 1), (None, 1), (5, 5), (6, 5), (7, 7), (8, 8), (None, None)}
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    kept = sorted((str(r.doc_id), r.text) for r in simhash.one_of_each(df).collect())
    assert [i for i, _ in kept] == ["1", "5", "7", "8", "None"]
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "q r s t u v w"), (2, "a b c")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.one_of_each(twice).collect()) == ["a b c", "q r s t u v w"]


def plain_set(text):
    ws = (text or "").lower().split()
    return {" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()


def plain_similar(rows):
    """The smallest id of each row's component, of pairs of sets with a Jaccard similarity of 0.8 or more."""
    root, sets = {i: i for i, _ in rows}, [(i, plain_set(t)) for i, t in rows]

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i, _ in rows}


def test_sketches_bound_the_difference_of_sets():
    rng = np.random.default_rng(1)
    for n, m in ((5, 5), (60, 70), (64, 65), (500, 900), (3000, 2900)):
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.unique(np.concatenate([rng.choice(a, n // 2, replace=False), rng.integers(0, 1 << 62, m).astype(np.uint64)]))
        assert simhash.sketches_apart(simhash.sketch(a), simhash.sketch(b)) <= len(np.setxor1d(a, b))
        assert simhash.sketches_apart(simhash.sketch(a), simhash.sketch(a)) == 0


def test_stage_finds_all_similar_texts(spark):
    rng = random.Random(5)
    texts = []
    for size in (1, 3, 5, 6, 8, 9, 30, 60, 200, 200):
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        for _ in range(14):
            some = list(base)
            for _ in range(rng.randrange(0, 1 + size // 25)):
                some[rng.randrange(size)] = f"x{rng.randrange(50)}"
            texts.append(" ".join(some[: size - rng.randrange(0, 2)]))
    passage = " ".join(f"p{k}" for k in range(30))
    texts += [passage + " " + " ".join(f"q{rng.randrange(9000)}" for _ in range(rng.randrange(1, 60))) for _ in range(40)] + ["", " ", None]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_similar(rows)
    assert {r.doc_id: r.component_id for r in simhash.similar(df).collect()} == want
    kept = {r.doc_id for r in corpus_pipeline.simhash_deduplication(spark, df, SF).collect()}
    assert kept == set(want.values()) and kept != {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert simhash.similar(df.limit(0)).collect() == []
