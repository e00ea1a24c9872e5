"""SimHash near-duplicates: fingerprints linked by pigeonring filtering, then components.

`fingerprints` gives each text 64 bits over its three-word shingles. `links` finds every
pair of distinct fingerprints that differ in at most `bits` places: the 64 bits form a ring
of `segments` parts, and if the whole difference stays within `bits`, some start has a chain
whose first l segments differ in at most l * bits / segments places for every l. The first
chain that must agree exactly is the key; fingerprints that share it are dealt by longer and
longer agreement along the chain: where the next segments may differ in one bit, one half of
them agrees, then three quarters of the other half. Only those that share the last key are
paired, at most 2 ** (the bits left open) in a group, however many share the first; the
budgets prune these candidates before the full Hamming check. `components` joins links into classes.

`similar` is for near-duplicate stages: it links texts by the Jaccard similarity of their
shingles. Texts that are alike to 0.8 differ in some ten of 64 bits, where no exact chain is
left to join on, so candidates come from shared shingles (prefix filter, which is exact), are
pruned by the Hamming distance of parity sketches, a lower bound of the sets' difference, and
each is checked on the whole sets.

Defined results: null and empty text, and text without a word, have fingerprint 0 and link
like any other. Rows with equal text share a fingerprint and so a component. Null doc_ids
are carried and never a component's id unless it has no other. Columns other than doc_id and
text pass through, whatever their names. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common

SHINGLE, SEED = 3, 42
BITS, SEGMENTS = 2, 16
SLAB = 1 << 16
#: Near-duplicate stages: words of a shingle, and Jaccard similarity from which texts are alike.
NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8
#: Shingles are ranked by the counts of 2 ** RANKS buckets; rounds of stars before the remaining pairs.
RANKS, STARS = 18, 2
RANK_SHIFT, RANK_REST = np.uint64(64 - RANKS), np.uint64((1 << 64 - RANKS) - 1)
#: An odd multiplier that mixes words' hashes; bits (as a power of two) that tell which texts are read again.
MIX, MARKS = np.uint64(0x9E3779B97F4A7C15), 21


def fingerprint(raw: bytes) -> int:
    """64 bits, signed; bit k is 1 if it is in over half of the shingles' hashes."""
    words = raw.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    n = max(1, len(words) - SHINGLE + 1)
    h = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, SLAB):
        part = h[k : k + SLAB]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, text: str = "text", to: str = "fp") -> DataFrame:
    """`df` without `text`, with the fingerprint (a long) of each whole text in column `to`."""

    def make():
        def each(batch):
            return common.replaced(batch, [text], **{to: pa.array([fingerprint(raw) for raw in common.as_bytes(batch.column(text))], pa.int64())})

        return each

    kept = df.drop(to)
    return common.arrow_map(kept, make, kept.drop(text).withColumn(to, F.lit(0).cast("long")).schema)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def rotated(fp: Column, start: Column, width: int) -> Column:
    """The ring read from segment `start` on, in the low bits first."""
    by = start * width
    return F.when(by == 0, fp).otherwise(F.expr("0L").bitwiseOR(F.call_function("shiftrightunsigned", fp, by)).bitwiseOR(F.call_function("shiftleft", fp, F.lit(64) - by)))


def low_bits(n: int) -> int:
    """A mask of the n low bits, as a signed 64-bit value."""
    return -1 if n >= 64 else (1 << n) - 1


def within(difference: Column, bits: int, segments: int) -> Column:
    """Whether the chain budgets hold for a difference that is rotated to its start.

    The budget l * bits // segments rises at a few lengths only, so just the longest chain at each value is tested.
    """
    width = 64 // segments
    longest = {l * bits // segments: l for l in range(1, segments + 1)}
    tests = [F.bit_count(difference.bitwiseAND(F.lit(low_bits(l * width)))) <= most for most, l in sorted(longest.items()) if most]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def shared(keyed: DataFrame, key: str, name: str) -> DataFrame:
    """The rows of `keyed` whose key others have too, written.

    The keys are written first, so that the join has two plain shuffles, which Spark can split where a key is hot.
    """
    often = common.materialize(keyed.groupBy(key).count().where("count > 1").select(key), f"simhash-{name}-keys")
    out = common.materialize(keyed.join(often, key), f"simhash-{name}")
    common.forget(often)
    return out


def dealt(rows: DataFrame, first: int, size: int, parts: int) -> DataFrame:
    """A row for each of `parts` parts of the `size` bits from `first` on of the chain, keyed by the other parts too.

    Two chains that differ in one of these bits at most agree in all parts but one. `free` is where the part left out starts.
    """
    each = size // parts
    keep = [low_bits(first + size) & ~low_bits(first) & ~(low_bits(first + k * each + each) & ~low_bits(first + k * each)) for k in range(parts)]
    out = F.explode(F.array(*(F.struct(F.lit(first + k * each).alias("free"), F.lit(m).cast("long").alias("mask")) for k, m in enumerate(keep)))).alias("part")
    rows = rows.select("fp", "chain", "key", out)
    return rows.select("fp", "chain", F.xxhash64("key", "part.free", F.col("chain").bitwiseAND(F.col("part.mask"))).alias("key"), F.col("part.free").alias("free"))


def links(fps: DataFrame, *, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """Links (a, b), a < b, between the distinct fingerprints (column `fp`): all pairs at most `bits` apart. `fps` is read twice."""
    if bits > 2:
        raise ValueError("with more than two bits no exact chain is long enough to join on")
    width = 64 // segments
    exact = width * max(l for l in range(1, segments + 1) if l * bits // segments == 0)
    one = width * max(l for l in range(1, segments + 1) if l * bits // segments <= 1) - exact
    starts = F.explode(F.array(*(F.lit(k) for k in range(segments)))).alias("start")
    keyed = fps.select("fp", starts).withColumn("chain", rotated(F.col("fp"), F.col("start"), width))
    keyed = keyed.select("fp", "chain", F.xxhash64("start", F.col("chain").bitwiseAND(F.lit(low_bits(exact)))).alias("key"))
    level = shared(keyed, "key", "chains")
    if bits == 2:
        # of the segments where one bit may differ a half agrees; then, of the other half, three quarters
        halves = shared(dealt(level, exact, one, 2), "key", "halves")
        common.forget(level)
        half = one // 2
        ends = [dealt(halves.where(F.col("free") == exact + k * half), exact + k * half, half, 4) for k in range(2)]
        level = shared(ends[0].unionByName(ends[1]), "key", "quarters")
        common.forget(halves)
    a, b = level.select("key", F.col("fp").alias("a"), F.col("chain").alias("chain_a")), level.select("key", F.col("fp").alias("b"), F.col("chain").alias("chain_b"))
    pairs = a.join(b, "key").where("a < b")
    chained = pairs.where(within(F.col("chain_a").bitwiseXOR(F.col("chain_b")), bits, segments))
    return chained.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root): for each end of the links (a, b), the smallest value it is connected to.

    Large-star and small-star in turn until nothing changes; each round is written to the shared folder, and
    what tells that it changed nothing - number and hashes of its links - is observed as it is written.
    """

    def written(links: DataFrame, name: str) -> tuple[DataFrame, dict]:
        seen = Observation()
        marks = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        return common.materialize(links.observe(seen, *marks), name), seen.get

    def least(links: DataFrame) -> DataFrame:
        """(u, low): a row for each u; grouped before the shuffle, so that no task gets all links of one."""
        return common.materialize(links.groupBy("u").agg(F.min("v").alias("low")), "lows")

    # a link is (u, v) with v < u
    now, at = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while at != before:
        before, old = at, now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = least(both)
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.least("low", "u").alias("v"))
        large = common.materialize(large, "large")
        small_lows = least(large)
        small = large.join(small_lows, "u")
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))
        now, at = written(small.select(F.inline(ends)).where("u <> v").distinct(), "stars")
        common.forget(old, lows, large, small_lows)
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(now.select("v", F.col("v").alias("root")).distinct())


def named(rows: DataFrame, link: Callable[[DataFrame], DataFrame], fp: str = "fp") -> DataFrame:
    """`rows` (doc_id, `fp` and others) with component_fp and component_id; link: classes (fp, first) -> links (a, b)."""
    classes = common.materialize(rows.select(F.col(fp).alias("fp"), "doc_id").groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = common.materialize(components(link(classes)).withColumnRenamed("v", "fp"), "roots")
    of_root = roots.join(classes, "fp").groupBy("root").agg(F.min("first").alias("least"))
    moved = roots.join(of_root, "root").select("fp", "root", "least")
    alone = F.col("root").isNull()
    found = classes.join(moved, "fp", "left").select("fp", F.coalesce("root", "fp").alias("component_fp"), F.when(alone, F.col("first")).otherwise(F.col("least")).alias("component_id"))
    found = common.materialize(found, "named").alias("n")
    common.forget(classes, roots)
    r = rows.alias("r")
    return r.join(found, F.col(f"r.`{fp}`") == F.col("n.fp")).select(*(F.col(f"r.`{c}`") for c in rows.columns if c != fp), F.col(f"r.`{fp}`").alias("fp"), "n.component_fp", "n.component_id")


def near_duplicates(docs: DataFrame, *, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """`docs` (doc_id, text and others) without `text`, with fp, component_fp and component_id for every row.

    component_id: the smallest doc_id that links reach, itself included; component_fp: the smallest fingerprint,
    which tells components apart even where rows repeat an id.
    """
    rows = common.materialize(fingerprints(docs.drop("component_id", "component_fp")), "fingerprints")
    return named(rows, lambda classes: links(classes.select("fp"), bits=bits, segments=segments))


def shingle_hashes(raw: bytes, shingle: int) -> np.ndarray:
    """A hash of each shingle of a text, in order; a text of fewer words is one shingle."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    each, size = np.fromiter(map(xxh64_intdigest, words, repeat(SEED)), np.uint64, n), min(shingle, n)
    h = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        h = (h ^ each[k : n - size + 1 + k]) * MIX
        h ^= h >> np.uint64(29)
    return h


def lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def order(docs: DataFrame, shingle: int) -> np.ndarray:
    """An order of 2 ** RANKS buckets of shingles' hashes, rare ones first: any table's counts are as many numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RANKS, np.int64)
        for batch in batches:
            for part in common.slices(batch):
                h = [shingle_hashes(raw, shingle) for raw in common.as_bytes(part.column("text"))]
                total += np.bincount((np.concatenate([np.zeros(0, np.uint64), *h]) >> RANK_SHIFT).astype(np.int64), minlength=1 << RANKS)
        k = np.flatnonzero(total)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], ["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << RANKS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    place = np.empty(1 << RANKS, np.uint64)
    place[np.argsort(counts, kind="stable")] = np.arange(1 << RANKS, dtype=np.uint64)
    return place << RANK_SHIFT


def ordered_set(raw: bytes, shingle: int, place: np.ndarray) -> np.ndarray:
    """A text's distinct shingles as numbers, in the order that `place` gives all texts."""
    h = shingle_hashes(raw, shingle)
    return np.unique(place[(h >> RANK_SHIFT).astype(np.int64)] | h & RANK_REST)


def sketch(h: np.ndarray) -> bytes:
    """Which of about as many cells as the set has members hold an odd number of them.

    Two sketches differ in no more cells than the sets differ in members, also when the longer one is folded.
    """
    cells = 64
    while cells < len(h):
        cells *= 2
    return np.packbits(np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def sketches_apart(a: bytes, b: bytes) -> int:
    """Cells in which two sketches differ; the longer is folded to the length of the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def shingled(docs: DataFrame, place: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """`docs` (doc_id, version, rest, text) without text, with fp (a hash of the set of shingles, 0 for none), n (its size), sketch and prefix.

    prefix: the set's first shingles, rare buckets first. Two sets that are alike share similarity * n of either,
    so they cannot do without a common shingle among the first n - ceil(similarity * n) + 1.
    """

    def make():
        def each(batch):
            fps, sizes, sketches, prefixes = [], [], [], []
            for raw in common.as_bytes(batch.column("text")):
                h = ordered_set(raw, shingle, place)
                n = len(h)
                fps.append(xxh64_intdigest(h.tobytes()) if n else 0)
                sizes.append(n)
                sketches.append(sketch(h))
                prefixes.append(h[: n - int(np.ceil(similarity * n - 1e-9)) + 1])
            return common.replaced(batch, ["text"], fp=pa.array(np.array(fps, np.uint64).view(np.int64)), n=pa.array(sizes, pa.int64()), sketch=pa.array(sketches, pa.binary()), prefix=lists(prefixes))

        return each

    added = {"fp": F.lit(0).cast("long"), "n": F.lit(0).cast("long"), "sketch": F.lit(b""), "prefix": F.expr("cast(array() as array<bigint>)")}
    return common.arrow_map(docs, make, docs.drop("text").withColumns(added).schema)


def marks(ends: DataFrame) -> np.ndarray:
    """Bits, 2 ** MARKS at most, that are set for the hashes of (doc_id, version) in `ends`; as many bytes for any table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << MARKS, bool)
        for batch in batches:
            found[batch.column("mark").to_numpy()] = True
        k = np.flatnonzero(found)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k)], ["mark"])

    got = ends.select(mark().alias("mark")).mapInArrow(run, "mark long").distinct().toArrow().column("mark").to_numpy()
    bits = np.zeros(1 << MARKS, bool)
    bits[got] = True
    return np.packbits(bits, bitorder="little")


def mark() -> Column:
    return F.pmod(F.xxhash64("doc_id", "version"), F.lit(1 << MARKS))


def alike(pairs: DataFrame, places: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets that are alike. places: (fp, doc_id, version, n, sketch), a text with each set; docs: (doc_id, version, text).

    Pairs whose sketches lie too far apart go first. Of the others the texts are read again, and only theirs.
    """
    side = lambda s: places.select(F.col("fp").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    drawn = pairs.join(side("a"), "a").join(side("b"), "b")

    def near():
        def each(batch):
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            apart = [sketches_apart(a, b) for a, b in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), strict=True)]
            stays = np.array(apart) <= (1 - similarity) / (1 + similarity) * total + 1e-6
            return pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(stays)) for c in ("a", "b")], ["a", "b"])

        return each

    close = common.materialize(common.arrow_map(drawn, near, "a long, b long"), "near-close")
    ends = common.materialize(close.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(places.select("fp", "doc_id", "version"), "fp"), "near-ends")
    wanted = marks(ends)

    def pick():
        def each(batch):
            k = batch.column("mark").to_numpy()
            return common.replaced(batch.filter(pa.array((wanted[k >> 3] >> (k & 7)) & 1 == 1)), ["mark"])

        return each

    def sets():
        def each(batch):
            return common.replaced(batch, ["text"], hashes=lists([np.unique(shingle_hashes(raw, shingle)) for raw in common.as_bytes(batch.column("text"))]))

        return each

    texts = docs.withColumn("mark", mark())
    texts = common.arrow_map(texts, pick, docs.schema).alias("d")
    here = texts.join(ends.alias("e"), F.col("d.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("d.version") == F.col("e.version"))).select("fp", "text")
    found = common.materialize(common.arrow_map(here, sets, "fp long, hashes array<bigint>"), "near-sets")
    both = close.join(found.select(F.col("fp").alias("a"), F.col("hashes").alias("x")), "a").join(found.select(F.col("fp").alias("b"), F.col("hashes").alias("y")), "b")
    same = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
    out = common.materialize(same.where(F.col("i") >= similarity * (F.col("n") - F.col("i")) - 1e-9).select("a", "b").distinct(), "near-links")
    common.forget(close, ends, found)
    return out


def set_links(rows: DataFrame, docs: DataFrame, *, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) whose classes are those of all pairs of sets that are alike. rows: `shingled` of docs (doc_id, version, text).

    Each shared shingle first gives stars around one member, so that large groups of copies come together by
    as many pairs as they have members; then all pairs follow that share one and are not together yet.
    The first stars are around the member with the fewest rarer shingles, as a text that others were made from
    has few of its own. Of the pairs that follow, those go whose shared shingle, were it their first, would come too
    late: neither set has more in common than what it holds from there on. Sets that are alike have a first that does not.
    """
    first = rows.where("n > 0").groupBy("fp").agg(F.min(F.struct("doc_id", "version")).alias("x"), F.min("n").alias("n"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix"))
    distinct = common.materialize(first.select("fp", "x.*", "n", "sketch", "prefix"), "near-distinct")
    places = distinct.drop("prefix")
    keyed = distinct.select("fp", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    often = common.materialize(keyed.groupBy("token").count().where("count > 1").select("token"), "near-often")
    shared = common.materialize(keyed.join(often, "token"), "near-shared")
    common.forget(often)
    fits = lambda m, n: F.least(m, n) >= similarity * F.greatest(m, n) - 1e-9
    ordered = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    found, tried, left, now = None, None, shared, None
    for k in range(STARS + 1):
        rooted = left.withColumn("root", F.col("fp"))
        if found is not None:
            roots = components(found).withColumnRenamed("v", "fp")
            rooted = common.materialize(left.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "near-left")
            common.forget(now)
        open_ = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by(F.struct("fp", "n", "root"), F.struct(F.lit(0) if k else F.col("pos"), F.xxhash64(F.lit(k), F.col("fp")))).alias("hub")).where("low <> high")
        now = common.materialize(rooted.join(open_.select("token", "hub"), "token"), "near-open")
        common.forget(rooted, left)
        if k < STARS:
            pairs = now.where((F.col("root") != F.col("hub.root")) & fits(F.col("n"), F.col("hub.n"))).select(*ordered(F.col("fp"), F.col("hub.fp")))
        else:
            x, y = now.alias("x"), now.alias("y")
            apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.root") != F.col("y.root"))
            early = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-6
            pairs = x.join(y, apart & fits(F.col("x.n"), F.col("y.n")) & early).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        left = now.select("fp", "n", "pos", "token")
        pairs = pairs.distinct()
        pairs = common.materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "near-candidates")
        tried = pairs if tried is None else tried.unionByName(pairs)
        more = alike(pairs, places, docs, shingle, similarity)
        found = more if found is None else found.unionByName(more)
    return found


def similar(docs: DataFrame, *, shingle: int = NEAR_SHINGLE, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """As `near_duplicates`, with links between all texts whose shingles have a Jaccard similarity of `similarity` or more.

    fp is a hash of the set of shingles. Texts without a word are alike.
    """
    docs = docs.drop("component_id", "component_fp", "fp")
    texts = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    rest = F.struct(F.lit(0).alias("none"), *(c for c in docs.columns if c.lower() not in ("doc_id", "text", "version")), *(F.col(c).alias("own_version") for c in docs.columns if c.lower() == "version"))
    whole = docs.select("doc_id", F.xxhash64("text").alias("version"), rest.alias("rest"), "text")
    sets = common.materialize(shingled(whole, order(docs, shingle), shingle, similarity), "sets")
    rows = sets.select("doc_id", *(F.col("rest.own_version" if c.lower() == "version" else f"rest.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("doc_id", "text")), "fp")
    return named(rows, lambda classes: set_links(sets, texts, shingle=shingle, similarity=similarity))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", find: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """The rows of `docs` less all but one of each component: that with the smallest id, and of rows that share it one.

    find: `near_duplicates` or `similar`. Only ids and hashes of texts are grouped; the texts meet them once.
    """
    version, row, nth = common.unused(docs, "version", "row", "nth")
    found = find(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")))
    # rows of one id may lie in one component with different texts: one of them stays
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_fp").agg(F.min(F.struct("hash", "doc_id")).alias("x"))
    stays = common.materialize(stays.select("x.doc_id", "x.hash", F.xxhash64(F.col("x.doc_id").isNull(), "x.doc_id").alias("row")), "stays").alias("s")
    # join and window go by the same two keys, so the texts are shuffled once
    d = docs.withColumns({version: F.xxhash64(text), row: F.xxhash64(F.col(key).isNull(), key)}).alias("d")
    same = (F.col(f"d.{row}") == F.col("s.row")) & (F.col(f"d.{version}") == F.col("s.hash"))
    kept = d.join(stays, same & F.col(f"d.`{key}`").eqNullSafe(F.col("s.doc_id"))).select("d.*")
    alone = Window.partitionBy(row, version).orderBy(F.lit(0))
    return kept.withColumn(nth, F.row_number().over(alone)).where(F.col(nth) == 1).select(*docs.columns)
