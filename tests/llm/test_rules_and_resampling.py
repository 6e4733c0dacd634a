"""Line frequency rules and importance resampling against plain models and their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

from corvane.llm import line_rules, queries, resampling

DATA = Path("/root/testdata/sf0.001")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, host string, row int, line string"


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", ["op11_line_frequency", "op12_importance_resampling"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries.queries()[name](spark, str(DATA))
    found = con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(found.columns) == cols
    assert Counter(map(tuple, df.select(*cols).collect())) == Counter(found.project(",".join(cols)).fetchall())


# ── line rules ──

def corpus():
    rng = random.Random(11)
    body = lambda n: " ".join("".join(rng.choice("abcdeé日") for _ in range(4)) for _ in range(n))
    rows = []
    for i in range(60):
        lines = [body(rng.randint(5, 30)) for _ in range(rng.randint(1, 6))]
        if i % 2:
            lines.insert(rng.randint(0, len(lines)), rng.choice(["Copyright 2024  ACME", "copyright 1999 acme", "COPYRIGHT 0000\tacme "]))
        if i % 7 == 0:
            lines += ["Copyright 2024 ACME"] * 40
        rows.append((i, "\n".join(lines), f"h{i % 3}"))
    rows += [(100 + i, "shared words of one text " * 12, "h0") for i in range(30)]
    notice = body(45)
    rows += [(300 + i, f"{body(10)}\n{notice}\n{body(10)}", "h1") for i in range(6)]
    rows += [(200, None, "h0"), (201, "", None), (202, " \t\n \n", None), (203, "a b c " * 200, None), (204, "#$%&|<>* " + body(80), "h1"), (3, rows[3][1], "h1"), (None, rows[5][1], None), (205, body(60_000), "h2"), (206, "x\x1cy\x85z\n" * 60, "h2")]
    return rows


def line_model(rows, least, share, left):
    def lines(text):
        return [" ".join(WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c for c in line))) for line in (text or "").split("\n") if WORDS.search(line)]

    distinct, holders = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        distinct[host or ""].add(tuple(lines(text)))
        for line in lines(text):
            holders[host or "", line].add(tuple(lines(text)))
    frequent = {k for k, of in holders.items() if len(of) > least and len(of) > share * len(distinct[k[0]])}
    out = Counter()
    for doc_id, text, host in rows:
        w = WORDS.findall(text or "")
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        times, covered = Counter(windows), set()
        for i, x in enumerate(windows):
            if times[x] > 1:
                covered |= {i, i + 1, i + 2}
        raw = [x for x in (text or "").split("\n") if WORDS.search(x)]
        gone = sum(len(x.split(" ")) for x in lines(text) if (host or "", x) in frequent)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out[doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(raw) - len(set(raw)), len(covered), gone, failed, not failed and len(w) - gone >= left * len(w)] += 1
    return out, frequent


@pytest.mark.parametrize("small", [100_000, 0])
def test_verdicts(spark, monkeypatch, small):
    monkeypatch.setattr(line_rules, "SMALL", small)
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)
    want, frequent = line_model(rows, 3, 0.05, 0.5)
    got = line_rules.verdicts(df, least=3, share=0.05)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept"]
    assert frequent and Counter(tuple(r[c] for c in cols) for r in got.collect()) == want
    # Copies of a text don't make its lines frequent; a document of little but a frequent line goes.
    assert not any("shared" in line for _, line in frequent) and any(not k[7] and not k[8] for k in want)


def test_cleaned(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)
    want, _ = line_model(rows, 3, 0.05, 0.5)
    got = line_rules.cleaned(df, least=3, share=0.05).collect()
    assert Counter(r.doc.doc_id for r in got) == Counter(k[0] for k in want.elements() if k[8])
    removed = {k[0]: k[6] for k in want if k[8] and k[0] is not None and k[0] != 3}
    assert all(len(WORDS.findall(r.doc.text)) - len(WORDS.findall(r.text)) == removed[r.doc.doc_id] for r in got if r.doc.doc_id in removed)
    assert all("acme" not in r.text.lower() for r in got if removed.get(r.doc.doc_id)) and all(r.text == r.doc.text for r in got if removed.get(r.doc.doc_id) == 0)
    none = df.limit(0)
    assert line_rules.verdicts(none).collect() == [] == line_rules.cleaned(none).collect()


# ── resampling ──

def resampling_model(rows, target, runs, buckets, percent, least_words):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, runs + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    ss, tt = sum(s.values()), sum(t.values())
    out, able = [], []
    for at, (doc_id, text) in enumerate(rows):
        w, f = features(text)
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in f)
        weight = math.floor(gain / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(f), weight, score, None])
        if len(w) >= least_words:
            able.append((-score, math.inf if doc_id is None else doc_id, at))
    for rank, (_, _, at) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[at][4] = rank
    return Counter(map(tuple, out))


@pytest.mark.parametrize(("runs", "nodes"), [(1, 600_000), (1, 5), (3, 600_000), (3, 40)])
def test_resampled(spark, monkeypatch, runs, nodes):
    rng = random.Random(12)
    names = ["The", "the", "alpha", "béta", "x9", "日本", "O'k", "under_score", "a-b", "\x7f", "ÀÉ"]
    texts = [" ".join(rng.choices(names, k=rng.randint(1, 60))) for _ in range(80)] + [None, "", " .,", "word " * 5000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[3]), (4, texts[9]), (None, texts[10]), (None, texts[10])]
    target = [" ".join(rng.choices(names[:5], k=20)) for _ in range(9)] + [None]
    monkeypatch.setattr(resampling, "NODES", nodes)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, score string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    scores = resampling.scored(df, goal, runs=runs, nodes=nodes, buckets=50)
    got = resampling.drawn(scores, 30, 15).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, got)) == resampling_model(rows, target, runs, 50, 30, 15)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert resampling.resampled(none, none).collect() == [] == resampling.resampled(none, some).collect()
    assert [r.n_features for r in resampling.resampled(some, none, percent=100).collect()] == [30]
    assert [r["rank"] for r in resampling.resampled(some, none, percent=100).collect()] == [1]
