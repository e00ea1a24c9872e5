"""Fill-in-middle against plain Python, for all units, windows and odd rows; its inverse."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspark.llm import common, queries
from veilspark.llm import fill_in_middle as fim

UNITS = {"char": r"(?s).", "word": r"\s*[^\s]+\s*|\s+", "line": r"[^\n]*\n|[^\n]+"}


def units(text, unit):
    if unit != "word":
        return re.findall(UNITS[unit], text)
    out = []
    for k, c in enumerate(text):
        if k == 0 or (c not in " \t\n\v\f\r" and text[k - 1] in " \t\n\v\f\r"):
            out.append(c)
        else:
            out[-1] += c
    return out


def plain(text, h, unit="char"):
    text = text or ""
    u = units(text, unit)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in fim.MARKERS) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    return (len(u), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(u), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("window", [1, 3, 1 << 22])
def test_kernel_is_plain_python(window):
    rng = random.Random(window)
    for _ in range(150):
        texts = [rng.choice([None, "", "".join(rng.choice("ab é\n漢😀<P>SM \t") for _ in range(rng.randrange(40)))]) for _ in range(rng.randrange(1, 12))]
        skip = rng.randrange(len(texts))
        array, texts = pa.array(texts).slice(skip), texts[skip:]
        h = [np.array([rng.randrange(2**32) for _ in texts]) for _ in range(4)]
        for unit in UNITS:
            out = fim.rearranged(array, h, unit=unit, markers=fim.MARKERS, plain_percent=10, suffix_first_percent=20, window=window)
            got = list(zip(*(out[c].to_pylist() for c in ("n", "form", "prefix_units", "middle_units", "output")), strict=True))
            assert got == [plain(t, [int(x[k]) for x in h], unit) for k, t in enumerate(texts)]
            assert fim.rebuilt(out["output"], out["form"], fim.MARKERS).to_pylist() == [t or "" for t in texts]


def drawn(key):
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def test_query_whole(spark):
    texts = {r.doc_id: r.text for r in common.read(spark, "/root/testdata/sf0.001", "documents").collect()}
    got = queries.op12_fill_in_middle(spark, "/root/testdata/sf0.001").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == len(texts) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        want = plain(texts[r.doc_id], drawn(r.doc_id))
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (*want[:4], sha(want[4]), sha(texts[r.doc_id] or ""))


def test_odd_rows(spark):
    texts = [(None, None), (None, "ab"), (1, ""), (2, "x" * 3_000_000 + "é" * 1_000_000), (3, "a <M> b"), (4, "é漢😀"), (4, "é漢😀"), (5, "\x00\n"), (6, "<<P"), (7, "S>")]
    df = spark.createDataFrame([(i, t, "f", 1, 2, "z") for i, t in texts], "doc_id long, text string, form string, h1 int, n int, h2 string").repartition(2)
    out = fim.transform(df)
    assert out.columns == ["doc_id", "h1", "h2", "n", "form", "prefix_units", "middle_units", "output"]
    got = fim.restore(out.withColumn("kept", F.col("output"))).collect()
    assert sorted((str(r.doc_id), r.n, r.form, r.prefix_units, r.middle_units, r.kept, r.restored) for r in got) == sorted((str(i), *plain(t, drawn(i)), t or "") for i, t in texts)
    assert fim.restore(fim.transform(df.limit(0))).collect() == []


def test_own_markers_and_seed(spark):
    df = spark.createDataFrame([("k%d" % k, "one two\nthree four\n" * 3) for k in range(60)], "id string, body string")
    marks = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    out = fim.transform(df, key="id", text="body", unit="line", seed=7, markers=marks, plain_percent=0, suffix_first_percent=50)
    rows = out.collect()
    assert {r.form for r in rows} == {"psm", "spm"} and {r.n for r in rows} == {6} and all(r.prefix_units + r.middle_units <= 6 for r in rows)
    assert {r.restored for r in fim.restore(out, markers=marks).collect()} == {"one two\nthree four\n" * 3}
    with pytest.raises(ValueError, match="unit"):
        fim.transform(df, key="id", text="body", unit="page")
    with pytest.raises(ValueError, match="marker"):
        fim.transform(df, key="id", text="body", markers=("aa", "ab", "<M>"))
    with pytest.raises(Exception, match="lacks a marker"):
        fim.restore(spark.createDataFrame([("no marker", "psm")], "output string, form string")).collect()
