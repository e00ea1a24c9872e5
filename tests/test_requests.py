"""Request bodies as a source: odd bodies, ranges of bytes, offsets of a stream, results of a request."""

import json
import random

import pytest

from veilspark.functions.rules import Profile, Rule
from veilspark.sources import requests
from veilspark.streaming import stream

RULES = Profile("mail", (Rule("EMAIL", r"[a-z]+@[a-z]+"),), "greedy_first")


@pytest.fixture(autouse=True)
def registered(spark):
    spark.dataSource.register(requests.Requests)


def load(spark, path, **options):
    return spark.read.format("requests").options(**options).load(str(path))


def test_odd_bodies(spark, tmp_path):
    lines = [b'{"text": "a", "language": "fr", "config": {"k": 1, "s": "x", "d": {"y": [1]}}}', b"", b"no json", b"[1]", b"{}", b'{"texts": []}', b'{"texts": ["b", null, 3, ""], "language": null}', b'{"text": null, "texts": "c"}', b"\xff", b'{"text": "no line feed"}']
    (tmp_path / "a").write_bytes(b"\n".join(lines))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    (tmp_path / ".hidden").write_bytes(b"{}")
    rows = load(spark, tmp_path).collect()
    at = [sum(len(x) + 1 for x in lines[:k]) for k in range(len(lines))]
    got = {(int(r.request.split(":")[1]), r.nth): r for r in rows}
    error = {k: (r.text, r.error) for k, r in got.items()}
    bad, none = (None, "not a JSON object"), (None, "no text")
    assert error == {(at[0], 0): ("a", None), (at[2], 0): bad, (at[3], 0): bad, (at[4], 0): none, (at[5], 0): none, (at[6], 0): ("b", None), (at[6], 1): none, (at[6], 2): none, (at[6], 3): ("", None), (at[7], 0): none, (at[8], 0): bad, (at[9], 0): ("no line feed", None)}
    assert got[at[0], 0].language == "fr" and got[at[0], 0].config == {"k": "1", "s": "x", "d": '{"y": [1]}'} and got[at[6], 0].language == "en"
    (tmp_path / "empty").mkdir()
    assert load(spark, tmp_path / "empty").count() == 0 == load(spark, tmp_path / "absent").count()


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 10**9])
def test_ranges_of_bytes_give_each_body_once(spark, tmp_path, split):
    rng = random.Random(split)
    for name in "ab":
        bodies = [json.dumps({"text": name * rng.choice([0, 1, 5, 50, 300 if split > 1 else 9])}) for _ in range(40 if split < 7 else 400)]
        (tmp_path / name).write_text("\n".join(bodies) + "\n" * rng.randint(0, 2))
    reader = requests._Batch({"path": str(tmp_path), "splitBytes": str(split)})
    got = sorted((r[0], r[2]) for p in reader.partitions() for r in reader.read(p))
    whole = []
    for name in "ab":
        at = 0
        for line in (tmp_path / name).read_bytes().splitlines(keepends=True):
            whole += [(f"{name}:{at}", json.loads(line)["text"])] if line.strip() else []
            at += len(line)
    assert got == sorted(whole)
    if split >= 64:
        assert sorted((r.request, r.text) for r in load(spark, tmp_path, splitBytes=split).collect()) == got


def test_a_stream_goes_on_from_its_offset(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, *bodies):
        (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, bodies)))

    def run():
        rows = spark.readStream.format("requests").load(str(tmp_path / "in"))
        stream.run_once(requests.answered(rows, RULES).select("request", "text", "masked_text", "success"), str(tmp_path / "out"), str(tmp_path / "c"))
        return sorted((r.request, r.masked_text or "", r.success) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put("1", {"text": "to a@b"}, {"texts": ["c@d", None]})
    first = run()
    assert sorted(x[1:] for x in first) == [("", False), ("[EMAIL]", True), ("to [EMAIL]", True)]
    assert run() == first  # nothing new
    put("2", {"text": "e@f"})
    put("3", {"text": "clean"})
    assert len(run()) == 5
    put("0", {"text": "late"})  # sorts before what has been read: stated as not read
    assert len(run()) == 5


def test_results_of_a_request(spark, tmp_path):
    (tmp_path / "a").write_text('{"texts": ["x@y", "none", null], "config": {"id": "r1"}}\nbad\n')
    rows = {r.request: r for r in requests.batch_results(load(spark, tmp_path), RULES).collect()}
    one, two = rows["a:0"], rows["a:57"]
    assert (one.total_processed, one.success_count, one.error_count) == (3, 2, 1) and one.config == {"id": "r1"}
    assert [(r.nth, r.has_pii, r.masked_text, len(r.entities)) for r in one.results] == [(0, True, "[EMAIL]", 1), (1, False, "none", 0)]
    assert [tuple(e) for e in one.errors] == [(2, "no text")] and (two.success_count, two.results, two.errors[0].error) == (0, [], "not a JSON object")
