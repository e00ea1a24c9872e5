"""Byte-pair counts and round trips against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilspark.llm import bpe, common, queries

SF = "/root/testdata/sf0.001"
ODD = [
    None,
    "",
    " ",
    "Hello <|endoftext|> World's don't <|startoftext|>x",
    "ΑΣ ΟΔΟΣ Σİ x\x1c\x1dy  　z é é ½²٣",
    "\U0001f600\U0001f468‍\U0001f469 tab\t\t\n\n  end  ",
    "<|endoftext|><|endoftext|>",
    "a" * 30_000,
    "ab " * 20_000,
    "日本語 12345 it's WE'RE \x85 \x00",
]


def texts(spark):
    real = [r.text for r in common.read(spark, SF, "documents").collect()]
    return ODD + real


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_same_as_the_library(spark, name):
    path = public_tokenizers.path(name)
    library, rows = Tokenizer.from_file(path), texts(spark)
    df = spark.createDataFrame([(k, t, 7, 8) for k, t in enumerate(rows)], "doc_id long, text string, ids int, n_tokens int").repartition(3)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in rows]
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, path).collect()} == {k: len(i) for k, i in enumerate(want)}
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, path), path).collect()}
    assert {k: r.ids for k, r in got.items()} == dict(enumerate(want))
    if name == "byte_bpe_50k.json":
        assert {k: r.decoded for k, r in got.items()} == {k: library.decode(i, skip_special_tokens=False) for k, i in enumerate(want)}
        assert all(r.decoded == (rows[k] or "") for k, r in got.items())
    assert {r.doc_id: (r.ids, r.decoded) for r in bpe.round_trip(df, path).collect()} == {k: (r.ids, r.decoded) for k, r in got.items()}
    assert bpe.encode(df.limit(0), path).collect() == [] == bpe.round_trip(df.limit(0), path).collect()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_code_point_as_the_library(name):
    path = public_tokenizers.path(name)
    merges, library = bpe.Merges(path), Tokenizer.from_file(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = ["".join(f"a{c}1 {c}!" for c in points[k : k + 128]) for k in range(0, len(points), 128)]
    for text, want in zip(rows, library.encode_batch(rows, add_special_tokens=False), strict=True):
        assert [i for _, pieces in merges.parts(text) for p in pieces for i in merges.encode(p)] == want.ids


def test_decode_of_any_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ids = [[], [50256], [220, 220], list(range(200, 400)), [188, 187, 99]]
    df = spark.createDataFrame(list(enumerate(ids)), "doc_id int, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, path).collect()}
    assert got == {k: library.decode(i, skip_special_tokens=False) for k, i in enumerate(ids)}


def test_queries(spark):
    rows = {r.doc_id: r.text for r in common.read(spark, SF, "documents").collect()}
    word, byte = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    for r in queries.op2_token_counts(spark, SF).collect():
        n = len(word.encode(rows[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(rows[r.doc_id].encode()), n, n > 2048)
    for r in queries.op5_bpe_round_trip(spark, SF).collect():
        ids = byte.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


def test_forgets_at_its_bound():
    known = bpe.Remembered(len, bound=3)
    assert [known[x] for x in ("a", "bb", "ccc", "dddd", "a", "x" * 100)] == [1, 2, 3, 4, 1, 100] and len(known) <= 3


def test_merging_rechecks_stale_entries():
    merges = bpe.Merges(public_tokenizers.path("byte_bpe_50k.json"))
    for word in ("aaaaaaa", "abababab", " thethethe", "ññññ"):
        ids = merges.symbols(word)
        plain = list(ids)
        while True:
            found = [(merges.merged[a << 20 | b] >> 20, i) for i, (a, b) in enumerate(zip(plain, plain[1:], strict=False)) if a << 20 | b in merges.merged]
            if not found:
                break
            _, i = min(found)
            plain[i : i + 2] = [merges.merged[plain[i] << 20 | plain[i + 1]] & 0xFFFFF]
        n = len(ids)
        assert n - merges.merge(ids) == len(plain) and [i for i in ids if i >= 0] == plain


def test_null_id_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert [r.n_tokens for r in bpe.count_tokens(df, public_tokenizers.path("word_bpe_49k.json")).collect()] == [2, 2, 2]
    assert df.select(F.col("doc_id")).count() == 3


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_queues_popped_together_give_what_each_heap_gives(name):
    merges = bpe.Merges(public_tokenizers.path(name))
    rng = random.Random(5)
    letters = ["a", "b", "th", "e", "in", " ", "é", "ß", "日", "\U0001f600", "0", "'", "\x00"]
    pieces = {"".join(rng.choices(letters[: rng.randint(1, len(letters))], k=rng.randint(1, 24))) for _ in range(20_000)} | {"x", "a" * 31, "a" * 32, "a" * 33, "ab" * 400}
    got = bpe.Queues(merges).packed(pieces)
    assert got.keys() == pieces and all(tuple(np.frombuffer(v, np.int32)) == merges.encode(p) for p, v in got.items())
    assert bpe.Queues(merges).packed(set()) == {}


def test_short_pieces_of_a_slice_are_not_merged_one_at_a_time(monkeypatch):
    merges, asked = bpe.Merges(public_tokenizers.path("byte_bpe_50k.json")), []
    monkeypatch.setattr(merges, "merge", lambda ids, plain=merges.merge: asked.append(len(ids)) or plain(ids))
    texts = ["one two two three", "", "four " + "x" * 100]
    known, queues = bpe.Remembered(merges.packed, 5), bpe.Queues(merges)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):
        assert bpe._encoded(merges, known, queues, texts).to_pylist() == [library.encode(t).ids for t in texts]
    assert asked == [101]  # the long piece alone; the next slice has it as well, and one without it drops it
    bpe._encoded(merges, known, queues, ["five six seven"])
    assert not any(len(p) > 64 for p in known) and len(known) <= 5
