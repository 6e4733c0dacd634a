"""Encoding, token counts and packing against the tokenizers library itself and against brute force."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import bpe, packing, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SAMPLES = [
    None, "", " ", "\n\n a", "Hello, it's 2024! WE'RE here_now __x", "naïve ÀÉ ß µ ²½ ª", "<|endoftext|> and <|startoftext|>x", "日本語のテキスト ① Ⅷ",
    "İstanbul é ẛ̣", "a\u0085b c d\x1ce", "Привет мир Ёж", "😀😀 ok 👩‍👩‍👧", "ΑΣ ΟΔΟΣ", "x" * 300, "ab" * 9000, "'s''t <| |> ''", "ﬁ ﷺ", "\t\tx  \r\n y   ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "clash") for i, t in enumerate(SAMPLES)] + [(3, SAMPLES[4], None, None), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, row string")


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_tree_concatenation_is_exact():
    c, rng = bpe.cutter(BYTE), random.Random(1)
    for n in (1, 5, 1024, 1025, 5000, 20_000):
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "thein"):
            text = "".join(rng.choices(letters, k=n))
            assert c.tree(text.encode(), 64) == ids_of(BYTE, text)


def test_cut_from_leaves_is_exact():
    c, rng = bpe.cutter(BYTE), random.Random(9)
    pieces = ["the ", " don't", "  ", "\n\n", "\t \n x", "12 34", "<|endoftext|>", "<|end", "...", " 日本", "é\u00a0", "_a_", "'", "'s", "word" * 9, "\u2003 "]
    for leaf in (1, 3, 7, 50):
        for _ in range(60):
            text = "".join(rng.choices(pieces, k=rng.randint(1, 60)))
            assert c.cut_tree(text, leaf) == c.cut(text)[0]


@pytest.mark.parametrize(("spread", "leaf"), [(bpe.SPREAD, bpe.LEAF_TEXT), (5, 3), (40, 16)])
def test_round_trip(docs, spread, leaf):
    t = Tokenizer.from_file(BYTE)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(docs, BYTE, spread=spread, leaf=leaf).collect())
    want = Counter()
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[(r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))] += 1
    assert got == want


def test_long_texts_are_encoded_in_parallel(spark):
    """With the settings of the query: random texts of several leaves, a long pre-token across leaves, repeated rows."""
    rng, t = random.Random(4), Tokenizer.from_file(BYTE)
    pieces = ["the ", "don't ", "  ", "\n\n", "12 34", "<|endoftext|>", "...", " 日本", "é ", "_a_", "word" * 9, "😀"]
    texts = ["".join(rng.choices(pieces, k=n)) for n in (6000, 9000, 30_000)] + ["ab" * 20_000, "x " + "ab" * 9000 + " y", " " * 40_000]
    assert all(len(x) > bpe.SPREAD for x in texts)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(0, texts[0]), (None, texts[1])], "doc_id long, text string")
    out = bpe.round_trip_digests(docs, BYTE)
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for i, x in [*enumerate(texts), (0, texts[0]), (None, texts[1])]:
        ids = t.encode(x, add_special_tokens=False).ids
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))] += 1
    assert got == want


@pytest.mark.parametrize("hot", [0, 5, 1000])
def test_token_counts(docs, hot):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, WORD, 100, hot=hot).collect())
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), n := len(ids_of(WORD, r.text)), n > 100) for r in docs.collect())
    assert got == want


def test_packing(docs):
    rows = packing.packed(docs, WORD, capacity=64).collect()
    assert len(rows) >= len(SAMPLES) + 2
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for got in places.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= 64
    want = Counter()
    for r in docs.collect():
        ids = [*ids_of(WORD, r.text), 1]
        want.update((r.doc_id, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


def test_whole_sequences(docs):
    placed = packing.packed(docs.filter("doc_id <> 3"), WORD, capacity=64, with_ids=True)
    whole = {r.sequence_id: (np.frombuffer(r.ids, "<u4").tolist(), r.documents) for r in packing.sequences(placed).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in placed.collect():
        ids, documents = whole[r.sequence_id]
        assert ids[r.offset : r.offset + r.length] == [*ids_of(WORD, texts[r.doc_id]), 1][r.start : r.start + r.length] and r.doc_id in documents


def test_encoding_and_decoding_tables(spark, docs):
    t = Tokenizer.from_file(BYTE)
    both = bpe.encoded(docs, BYTE)
    for r in both.collect():
        assert r.ids == t.encode(r.doc.text or "", add_special_tokens=False).ids and set(r.doc.asDict()) == set(docs.columns)
    back = bpe.decoded(both.select("doc.doc_id", "ids"), BYTE).collect()
    assert sorted((r.doc.doc_id or -1, r.text) for r in back) == sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    odd = spark.createDataFrame([(1, [0, 50256, 220]), (2, None), (3, [])], "i int, ids array<int>")
    assert {r.doc.i: r.text for r in bpe.decoded(odd, BYTE).collect()} == {1: t.decode([0, 50256, 220], skip_special_tokens=False), 2: "", 3: ""}


def optimum(items, capacity):
    """The least number of bins, by search."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b >= items[i]}.values():
            go(i + 1, [*bins[:k], bins[k] - items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_an_optimum_and_plan_is_whole():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([10, 20, 33])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        histogram = {k: items.count(k) for k in set(items)}
        fixed, rest = packing.reduced(histogram, capacity)
        left = [k for k, v in rest.items() for _ in range(v)]
        assert sum(times for times, _ in fixed) + optimum(left, capacity) == optimum(items, capacity)
        used = defaultdict(int)
        for times, shape in packing.plan(histogram, capacity):
            assert times > 0 and sum(a * b for a, b in shape) <= capacity
            for length, each in shape:
                used[length] += times * each
        assert used == histogram


def test_empty_table(docs):
    none = docs.limit(0)
    assert bpe.round_trip_digests(none, BYTE).count() == token_counts.token_counts(none, WORD).count() == packing.packed(none, WORD).count() == 0


def test_leaves_are_cut_in_one_pass(spark):
    """Parts as Python cuts them, and time in proportion: four times the text takes nowhere near sixteen times as long."""
    took = {}
    for n in (1 << 20, 1 << 22):
        text = "aé日😀" * (n // 4)
        df = spark.createDataFrame([(text,)], "text string")
        best = []
        for _ in range(2):
            began = time.perf_counter()
            got = df.select(F.explode(bpe.leaf_texts(F.col("text"), 1000)).alias("x")).agg(F.count("x"), F.min(F.length("x")), F.max(F.length("x"))).first()
            best.append(time.perf_counter() - began)
        took[n] = min(best)
        assert tuple(got) == (-(-n // 1000), n % 1000 or 1000, 1000)
    assert took[1 << 22] < 10 * took[1 << 20] + 2
    text = "aé\n日😀" * 700
    parts = spark.createDataFrame([(text,)], "text string").select(bpe.leaf_texts(F.col("text"), 1000).alias("x")).first().x
    assert parts == [text[i : i + 1000] for i in range(0, len(text), 1000)]
