"""Alignment of tokenizers against a plain model that encodes whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corvane.llm import alignment
from corvane.llm.bpe import as_bytes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, chunk int, links string"


def model(rows):
    """doc_id and the columns of aligned(), from the whole texts and all occurrences."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()

    docs, holders = [], defaultdict(set)
    for place, (doc_id, text) in enumerate(rows):
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bx, by = [as_bytes(a.id_to_token(i)) for i in x], [piece(i) for i in y]
            if b"".join(bx) == b"".join(by) == (" " + text).encode():
                ends = []
                for parts in (bx, by):
                    at, out = 0, []
                    for p in parts:
                        out.append(at := at + len(p))
                    ends.append(out)
                common = sorted(set(ends[0]) & set(ends[1]))
                start = 0
                for end in common:
                    groups.append(([i for i, e in zip(x, ends[0], strict=True) if start < e <= end], [i for i, e in zip(y, ends[1], strict=True) if start < e <= end]))
                    start = end
        links = [(i, j) for g, h in groups for i in g for j in h]
        for pair in links:
            holders[pair].add(place)
        docs.append((doc_id, groups, links))
    best = Counter()
    for (i, _), of in holders.items():
        best[i] = max(best[i], len(of))
    out = []
    for doc_id, groups, links in docs:
        digest = hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest() if groups else ""
        counts = [len(holders[p]) for p in links]
        out.append((doc_id, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links), sum(n == best[i] for (i, _), n in zip(links, counts, strict=True)), sum(counts), digest))
    return Counter(out), {(i, j, len(of)) for (i, j), of in holders.items() if len(of) == best[i]}


def texts():
    rng = random.Random(13)
    words = ["the", "The", "attion", "naïve", "日本語", "don't", "we'll", "x" * 40, "123456", "3.14", "<|endoftext|>", "<s>", "<0x0A>", "😀", "é", " ", "　x", "\x1cq", "a\x00b", "===", "_a_", "ﬁ", "\u0085", "(foo)", "http://a.b/c?d=e", "Ärger", "год"]
    gaps = [" "] * 12 + ["  ", "\n", " \n", "\n ", "\t", "   ", "", "\r\n", " "]
    made = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    made += [" " + t for t in made[:20]] + [t + "  " for t in made[:20]] + [t + " " for t in made[20:40]]
    plain = " ".join(rng.choices(words[:6], k=30))
    return made + [None, "", " ", "  ", "   ", "\n", " \n ", "a", " a", "a ", "  a  b ", "▁", "a▁b c", "日本語" * 300, "=" * 500, " " * 300, "\n" * 77, plain, plain, plain, (plain + " ") * 200]


@pytest.fixture(scope="module")
def rows():
    out = list(enumerate(texts()))
    out += [(3, out[3][1]), (None, "the the"), (None, None), (7, "The attion")]
    random.Random(1).shuffle(out)
    return out


@pytest.mark.parametrize(("stripes", "chunk", "fan"), [(128, 1 << 20, 64), (7, 50, 3)])
def test_aligned(spark, rows, stripes, chunk, fan):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(5)
    got = alignment.aligned(df, A, B, stripes=stripes, chunk=chunk, fan=fan)
    assert Counter(map(tuple, got.collect())) == model(rows)[0]


def test_best_pairs(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    assert {tuple(r) for r in alignment.best_pairs(df, A, B, stripes=9, chunk=400, fan=2).collect()} == model(rows)[1]


def test_units_are_forgotten(spark, rows, monkeypatch):
    """A worker that keeps few units gives the same."""
    short = [(i, t) for i, t in rows if t is None or len(t) < 200]
    monkeypatch.setattr(alignment, "KEPT", 10)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in short], SCHEMA)
    got = alignment.aligned(df, A, B)
    assert Counter(map(tuple, got.collect())) == model(short)[0]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert alignment.aligned(df, A, B).collect() == []
    one = spark.createDataFrame([(1, None, None, None)], SCHEMA)
    assert [tuple(r) for r in alignment.aligned(one, A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
