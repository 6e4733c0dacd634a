"""Exact groups, fingerprints, links, components and shards against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import exact_dedup, near_copies, sharding, simhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(rng, n):
    return " ".join(rng.choices("alpha beta gamma delta. epsilon, zeta eta theta iota kappa".split(), k=n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    long = words(rng, 30_000)
    texts = [None, "", " \t ", "a b", "a  b", "a\nb", "ab", long, long.replace(" ", "\n"), long + "!", "x" * 9000, "😀" * 5000, "😀a" * 3000, "a b\u0085c"]
    texts += [words(rng, rng.randint(1, 60)) for _ in range(40)]
    base = words(rng, 200)
    texts += [base] * 20 + [base.replace("alpha", "ALPHA", 1)] * 3 + [base + f" tail{i}" for i in range(30)]
    rows = [(i, t, "en", f"src{i % 3}", "clash", 1) for i, t in enumerate(texts)]
    rows += [(5, "a\nb", None, None, None, None), (None, "a b", "fr", None, "x", 2), (None, "lonely", None, None, None, None), (40, texts[40], "en", "src1", "clash", 1)]
    random.Random(4).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp string, row int")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(docs, weak):
    hashed = (lambda c: F.pmod(F.xxhash64(c), F.lit(3))) if weak else F.xxhash64
    got = exact_dedup.exact_groups(docs, chunk_hash=hashed).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[SPACE.sub(" ", r.text or "")].append(r.doc_id)
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            want[i, min(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in kept)


def fingerprint(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, distance):
    """Component number of each fingerprint."""
    fps, root = list(fps), {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize(("heavy", "block"), [(64, 1024), (2, 3)])
def test_near_groups(docs, monkeypatch, heavy, block):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    monkeypatch.setattr(simhash, "BLOCK", block)
    got = simhash.near_groups(docs).collect()
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == Counter(rows)
    of = classes({f for _, f in rows}, 4)
    least = defaultdict(list)
    for i, f in rows:
        least[of[f]].append(i)
    want = Counter((i, min((x for x in least[of[f]] if x is not None), default=None)) for i, f in rows)
    assert Counter((r.doc_id, r.component_id) for r in got) == want
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns and out.count() == len(least)


@pytest.mark.parametrize("operator", [simhash, near_copies])
def test_unlike_documents_stay_whatever_their_ids(spark, operator):
    rng = random.Random(3)
    unlike = [(i, " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=80))) for i in (None, None, None, 5, 5)]
    docs = spark.createDataFrame([*unlike, (5, unlike[0][1]), (None, unlike[3][1]), (None, None), (7, ""), (7, None)], "doc_id long, text string")
    kept = [(r.doc_id, r.text or "") for r in operator.one_of_each(docs).collect()]
    # Of the first text the row with an id stays, and of the empty ones 7.
    assert sorted(kept, key=str) == sorted([(5, unlike[0][1]), *unlike[1:], (7, "")], key=str)
    assert len({r.root for r in operator.near_groups(docs).collect()}) == 6


@pytest.mark.parametrize("block", [1024, 3])
def test_pipeline_finds_every_near_copy(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(11)
    texts = [None, "", "one two", "ONE  two"]
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(copy))

    def grams(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                root = [root[j] if r == root[i] else r for r in root]
    want = {min(i for i, r in enumerate(root) if r == k) for k in set(root)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 12 < len(want) < len(texts) - 20
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()} == want


@pytest.mark.parametrize(("plan_for", "distance"), [(100, 4), (1 << 20, 4), (1 << 40, 4), (100, 1), (1 << 20, 7)])
def test_links_lose_nothing(spark, monkeypatch, plan_for, distance):
    rng = random.Random(plan_for)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                f ^= 1 << b
            fps.add(f)
    plan = simhash.segment_plan(plan_for, distance)
    assert sum(w for _, w, _ in plan) == 64
    monkeypatch.setattr(simhash, "segment_plan", lambda n, d: plan)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = simhash.links(spark.createDataFrame(signed, "fp long"), distance).collect()
    mask = (1 << 64) - 1
    pairs = {frozenset((r.a & mask, r.b & mask)) for r in got}
    assert pairs == {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= distance}


@pytest.mark.parametrize(("plan_for", "distance"), [(100, 4), (1 << 20, 4), (1 << 40, 4), (100, 1), (1 << 20, 7)])
def test_heavy_entries_connect_all_that_links_do(spark, monkeypatch, plan_for, distance):
    """Fingerprints alike in most bits: every entry is heavy, and many are still so by the second index."""
    rng = random.Random(plan_for + 1)
    middle = [rng.getrandbits(64) for _ in range(3)]
    fps = {m ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for m in middle for _ in range(120)} | {rng.getrandbits(64) for _ in range(100)}
    plan = simhash.segment_plan(plan_for, distance)
    monkeypatch.setattr(simhash, "segment_plan", lambda n, d: plan)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    mask, of = (1 << 64) - 1, classes(fps, distance)
    for heavy, block in ((2, 3), (20, 50)):
        monkeypatch.setattr(simhash, "HEAVY", heavy)
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = [(r.a & mask, r.b & mask) for r in simhash.links(spark.createDataFrame(signed, "fp long"), distance).collect()]
        # A forest's stars join fingerprints by way of others.
        assert all(of[a] == of[b] for a, b in got)
        root = {f: f for f in fps}

        def find(f):
            while root[f] != f:
                f = root[f]
            return f

        for a, b in got:
            root[find(a)] = find(b)
        assert len({find(f) for f in fps}) == len(set(of.values()))


def test_nothing_that_grows_is_broadcast(spark, docs):
    """However small Spark thinks a side is: it takes an explode for one row each."""
    fps = spark.range(50).select(F.xxhash64("id").alias("fp"))
    plan = simhash.segment_plan(1 << 20)
    edges, groups = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), simhash.near_groups(docs)
    joined = [simhash.met(simhash.probe_rows(fps, plan), simhash.index_rows(fps, plan), 4), simhash.with_least(edges, edges.withColumnRenamed("b", "m")), groups, simhash.all_but_first(simhash.staged(groups))]
    for df in joined:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)}


def test_shards(docs):
    rows = sharding.hilbert_shards(docs, shards=7).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = [len(by[s]) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    order = [r.cell for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_shards_are_written_whole(spark, docs, tmp_path):
    manifest = sharding.write_shards(docs, f"{tmp_path}/s", rows_per_file=10, shards=5)
    back = spark.read.parquet(f"{tmp_path}/s")
    as_rows = lambda df: Counter(str(r) for r in df.collect())
    assert as_rows(back.select("doc.*")) == as_rows(docs)
    assert {r.shard: r["rows"] for r in manifest.collect()} == {r.shard: r["count"] for r in back.groupBy("shard").count().collect()}


def test_hilbert_cells_are_a_walk():
    import itertools

    for dims, bits in ((2, 3), (3, 3)):
        points = list(itertools.product(range(1 << bits), repeat=dims))
        walk = [p for _, p in sorted(zip(sharding.curve_cells(dims, bits), points, strict=True))]
        assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in itertools.pairwise(walk))


def test_manifest_prunes(spark):
    many = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', cast(id % 997 as int)) as text", "concat('s', id % 37) as source", "concat('l', id % 11) as lang")
    out = sharding.hilbert_shards(many)
    manifest = sharding.shard_manifest(out)
    for step in ("step_0", "step_1", "step_2"):
        assert sharding.shards_matching(manifest, **{step: (3, 3)}).count() <= 16  # of 24
    hit = {r.shard for r in out.filter("step_2 = 3").select("shard").distinct().collect()}
    assert hit <= {r.shard for r in sharding.shards_matching(manifest, step_2=(3, 3)).collect()}


def test_strings_are_quantised_whole(spark):
    many = spark.range(20_000).selectExpr("id as doc_id", "'x' as text", "concat('https://site', id % 50) as source", "date_add(date '2020-01-01', cast(id % 40 as int)) as day", "cast(concat('aaaaaaaaaa', id % 20) as binary) as raw")
    out = sharding.hilbert_shards(many, dims=("source", "day", "raw"), bits=3).cache()
    for i in range(3):
        filled = {r[f"step_{i}"]: r["count"] for r in out.groupBy(f"step_{i}").count().collect()}
        assert set(filled) == set(range(8)) and max(filled.values()) <= 20_000 / 8 + 20_000 / 20
    steps = {r.source: r.step_0 for r in out.join(many, "doc_id").select("source", "step_0").distinct().collect()}
    assert [steps[v] for v in sorted(steps)] == sorted(steps.values())
    wide = sharding.hilbert_shards(many, dims=("source", "day"))
    assert wide.select("step_0").distinct().count() == 16
    manifest = sharding.shard_manifest(wide)
    assert sharding.shards_matching(manifest, step_0=(3, 3)).count() <= 16  # of 24


def test_hot_values_and_repeated_rows_are_sharded(spark):
    rows = [(1, "same", "hot", None)] * 300 + [(None, "same", None, "l")] * 100 + [(i, f"t{i}", f"s{i % 7}", "l") for i in range(200)]
    out = sharding.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), shards=7).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert len({(r.shard, r.slot) for r in out}) == len(rows) and {len([1 for r in out if r.shard == s]) for s in range(7)} <= {85, 86}


def test_empty_tables(docs):
    none = docs.limit(0)
    assert exact_dedup.exact_groups(none).count() == simhash.near_groups(none).count() == sharding.hilbert_shards(none).count() == 0
