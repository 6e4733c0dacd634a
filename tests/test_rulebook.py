"""Rules in a table against the fold that applies each in turn."""

import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.functions import corrections as cx
from corvane.operators import rulebook

EXACT = "pos int, from string, to string, note string, enabled boolean"
ALIAS = "pos int, canonical string, variants array<string>, category string, enabled boolean"


def folded(steps, text):
    changes = []
    for kind, old, new, note, category in steps:
        sides = {"exact": ("", ""), "alias": (r"(?<![0-9A-Za-z가-힣])", r"(?![0-9A-Za-z가-힣])"), "term": (r"(?<![^\s,.!?])", r"(?![^\s,.!?])")}[kind]
        text, n = re.subn(sides[0] + re.escape(old) + sides[1], lambda m, new=new: new, text)
        if n:
            changes.append({"type": kind, "from": old, "to": new, "count": n, "note": note, "category": category})
    return text, changes


@pytest.mark.parametrize("seed", range(40))
def test_cascades_equal_the_fold(seed):
    rng = random.Random(seed)
    word = lambda most: "".join(rng.choice("ab가 .") for _ in range(rng.randint(1, most)))
    steps = [(rng.choice(["exact", "exact", "alias", "term"]), word(4), rng.choice(["", word(5)]), None, None) for _ in range(rng.randint(0, 60))]
    automaton = rulebook.Automaton(steps)
    for _ in range(60):
        text = word(30)
        assert automaton.corrected(text) == folded(steps, text)


def test_ten_thousand_rules():
    rng = random.Random(7)
    names = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(10_000)]
    steps = [(rng.choice(["exact", "alias"]), a, rng.choice(names), None, None) for a in names]
    automaton = rulebook.Automaton(steps)
    for _ in range(5):
        text = " ".join(rng.choices(names, k=60))
        assert automaton.corrected(text) == folded(steps, text)


def test_many_rules_for_the_same_words_are_looked_for_once():
    """Words that stand in many rules, and parts of words: what a text costs doesn't follow the rules that can't fire."""
    rng = random.Random(11)
    names = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 5))) for _ in range(40)]
    steps = [("exact", rng.choice(names), rng.choice(names), f"n{i}", None) for i in range(300)] + [("alias", rng.choice(names), rng.choice(names).upper(), None, f"c{i}") for i in range(3000)]
    steps = [s for s in steps if s[1] != s[2]]
    automaton, looked = rulebook.Automaton(steps), []
    for part in automaton.parts:
        part.places = lambda i, text, places=part.places: looked.append(i) or places(i, text)
    for _ in range(20):
        looked.clear()
        text = " ".join(rng.choices(names, k=80))
        got = automaton.corrected(text)
        assert got == folded(steps, text)
        assert len(looked) <= 3 * len(got[1]) + len(names)


def test_a_batch_is_made_into_rows_slice_by_slice(spark, monkeypatch):
    monkeypatch.setattr(rulebook, "SLICE", 3)
    fix = rulebook.corrector(rulebook.term_steps(spark, {"a": "b"}))
    got = spark.range(10, numPartitions=1).select("id", F.when(F.col("id") != 4, F.concat(F.lit("a a "), "id")).alias("t")).select("id", fix(F.col("t")).alias("c")).orderBy("id").collect()
    assert [r.c.text for r in got] == [None if i == 4 else f"b b {i}" for i in range(10)]
    assert [[c["count"] for c in r.c.changes] for r in got] == [[] if i == 4 else [2] for i in range(10)]


def test_memory_follows_neither_a_batch_nor_pieces_with_nothing(spark):
    fix = rulebook.corrector(rulebook.term_steps(spark, {"a": "b"}))
    batch = pa.array([f"{i} a {'x' * 4000}" for i in range(4096)])
    tracemalloc.start()
    rows = sum(len(some) for some in fix.func(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4096 and most < 4e6 < batch.nbytes / 4
    strings = rulebook.Strings(["a"])
    for i in range(1000):
        strings.inside(f"x{i}")
    assert len(strings.known) == 1000 and len(set(map(id, strings.known.values()))) == 1


def test_a_table_of_rules(spark):
    exact = spark.createDataFrame([(2, "THE and", "T&A", "n2", True), (1, " the ", "THE", None, None), (3, "off", "on", None, False), (4, None, "x", None, True), (5, "q", "q ", None, True), (6, "gone", None, "n6", True)], EXACT)
    alias = spark.createDataFrame([(1, "Kim & Co", ["kim", " kim co ", "Kim & Co", "kim", None], "firm", None), (2, " ", ["x"], None, True), (3, "on", ["off"], None, False)], ALIAS)
    texts = ["the and gone kim co, kim; akim off", "", None, "kim"]
    fix = rulebook.corrector(rulebook.exact_steps(exact), rulebook.alias_steps(alias))
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").select("id", fix(F.col("text")).alias("c")).orderBy("id").collect()
    assert [r.c.text for r in got] == ["T&A  Kim & Co, Kim & Co; akim off", "", None, "Kim & Co"]
    assert [tuple(c) for c in got[0].c.changes] == [("exact", "the", "THE", 1, None, None), ("exact", "THE and", "T&A", 1, "n2", None), ("exact", "gone", "", 1, "n6", None), ("alias", "kim co", "Kim & Co", 1, None, "firm"), ("alias", "kim", "Kim & Co", 1, None, "firm")]
    plain = cx.corrected(F.lit(texts[0]), [cx.Exact(" the ", "THE"), cx.Exact("THE and", "T&A"), cx.Exact("gone", "")], [cx.Alias("Kim & Co", ("kim", "kim co"))])
    assert spark.range(1).select(plain.alias("c")).first().c.text == got[0].c.text


def test_the_whole_dictionary(spark):
    rng = random.Random(2)
    terms = list(cx.SPOKEN_TERMS)
    texts = ["".join(rng.choice([*terms, "것", "x"]) + rng.choice([" ", ", ", "", ".", "\n", "!"]) for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    fix = rulebook.corrector(rulebook.term_steps(spark))
    assert all(r.a == r.b for r in df.select(fix(F.col("text"))["text"].alias("a"), cx.quick_fix(F.col("text")).alias("b")).collect())


def test_too_many_rules_and_none(spark, monkeypatch):
    exact = spark.createDataFrame([(i, f"w{i}", "x", None, True) for i in range(5)], EXACT)
    none = rulebook.corrector(rulebook.exact_steps(exact.limit(0)))
    assert spark.createDataFrame([("w1",)], "t string").select(none(F.col("t"))["text"].alias("t")).first().t == "w1"
    monkeypatch.setattr(rulebook, "MOST", 4)
    with pytest.raises(ValueError, match="at most 4"):
        rulebook.corrector(rulebook.exact_steps(exact))
