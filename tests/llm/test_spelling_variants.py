"""Spelling variants against brute force, for all sizes of block, and defined results of odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from veilspark.llm import spelling_variants as sv


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(docs, min_chars=7, every=31, factor=10):
    """The rows of `group` by comparing all words."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for i, text in docs:
        run = ""
        for c in (text or "").translate(lower) + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                at = h % len(run)
                n[run[:at] + run[at + 1 :] if h % every == 0 else run] += 1
            run = ""
    n = {w: k for w, k in n.items() if len(w) >= min_chars and k >= 2}
    found = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(found[w], key=lambda x: (-n[x], x)) for w in n if found[w]}
    form = {w: b for w, b in best.items() if n[b] >= factor * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n[w], len(found[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n)


def rows(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def corpus(seed, letters, times):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))) for _ in range(120)]
    return [(i, " ".join(rng.choices(words, [2.0**-(k % 9) for k in range(120)], k=times))) for i in range(40)]


@pytest.mark.parametrize(("letters", "block"), [("ab", 4), ("abÉé", 2048), ("abÿ", 16)])
def test_group_is_brute_force(spark, letters, block):
    docs = corpus(len(letters), letters, 200)
    got = rows(sv.group(spark.createDataFrame(docs, "doc_id long, text string"), block=block, every=3))
    assert got == plain(docs, every=3) and len({r[5] for r in got}) < len(got)


def test_forms_lead_to_roots(spark):
    docs = [(1, " ".join(["receive"] * 2000 + ["recieve"] * 3 + ["recceive"] * 100 + ["reccceive"] * 5 + ["rceceive"] * 2))]
    got = {r[0]: r for r in rows(sv.group(spark.createDataFrame(docs, "doc_id long, text string"), every=10**12))}
    assert got["reccceive"][3] == "recceive" and got["reccceive"][5] == "receive" and got["recceive"][4] == 2000
    assert got["recieve"][3] is None and got["recieve"][5] == "recieve"


def test_blocks_give_each_pair_once():
    rng = random.Random(3)
    for letters, size, small in [("ab", 5, 2), ("ab", 8, 3), ("abé", 4, 2), ("abc", 6, 24)]:
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(size - 1, size + 2))) for _ in range(250)})
        blocks = defaultdict(list)
        for w in words:
            for r in (len(w), len(w) - 1):
                h = r // 2
                blocks[r, ">", w[:h]].append((w, w[h:], r - h, r + 1 - h))
                if h:
                    blocks[r, "<", w[len(w) - r + h :]].append((w, w[: len(w) - r + h], h, h))
        links = sv.Links(small)
        for members in blocks.values():
            links.add([m[0] for m in members], [1] * len(members), [m[1] for m in members], *members[0][2:])
        got = links.take()
        assert sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)) == [(a, b) for a in words for b in words if near(a, b)]


def test_long_words_are_taken_whole(spark):
    word = "abcdefghij" * 3000
    docs = [(1, f"{word} {word} {word[:15000]}x{word[15001:]} " * 2), (2, f"{word[1:]} {word[1:]} {word[:-2]} {word[:-2]}")]
    got = rows(sv.group(spark.createDataFrame(docs, "doc_id long, text string"), every=10**12, factor=2))
    assert sorted(r[1:3] for r in got) == [(2, 0), (2, 1), (2, 1), (4, 2)]
    assert got == plain(docs, every=10**12, factor=2)


def test_odd_rows(spark):
    docs = [(None, None), (None, "Spelling spelling"), (1, ""), (2, "x " * 10_000), (3, "Ünïcöde ÜNÏCÖDE Ünïcöde"), (4, "spelling SPELLING"), (4, "spelling SPELLING"), (5, "Ж" * 50 + " spellings spellings")]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    assert rows(sv.group(df)) == plain(docs)
    assert rows(sv.group(df.limit(0))) == [] and rows(sv.group(df.where("doc_id = 1"))) == []
