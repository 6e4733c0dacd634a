"""Correction rules as a table, however many, applied in one pass with an automaton.

Rules are applied in order, and a later rule sees what earlier ones wrote. Most rules meet nothing in a text, so an Aho-Corasick
automaton over all strings that rules look for says in one pass which can, and a dictionary those that look for whole words; these
alone are taken, in order. Where one has written something, that place is read again, with as much on either side as the longest
string, and the later rules that are found there are added: a string that wasn't in the text before must touch what was written.
Work follows the text and the rules that fire, not the number of rules; a word that was read once isn't read again in other texts.

The table goes to each worker by broadcast and is refused beyond MOST rules; an automaton of that size takes some 100 MB.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.corrections import SPOKEN_TERMS, WORD
from corvane.functions.text import strip

MOST = 200_000
#: Of pieces of text of so many characters at most, what was found in this many is kept. As many texts are made into rows at once.
SHORT, KEPT, SLICE = 64, 100_000, 128
#: Most pieces have nothing, which is kept once: an empty set of its own takes more than the piece.
NOTHING: frozenset[int] = frozenset()
CHANGES = "array<struct<type:string,from:string,to:string,count:int,note:string,category:string>>"
CHANGE = [("type", pa.string()), ("from", pa.string()), ("to", pa.string()), ("count", pa.int32()), ("note", pa.string()), ("category", pa.string())]
CHANGED = pa.struct([("text", pa.string()), ("changes", pa.list_(pa.struct(CHANGE)))])
STEP = "type string, from string, to string, note string, category string"
RUN = re.compile(f"[{WORD}]+")
#: What stands around a spoken term: white space and these marks.
AROUND = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000,.!?"


def exact_steps(rules: DataFrame) -> DataFrame:
    """Steps of rules (pos, from, to, note, enabled), those that do something."""
    old, new = strip(F.coalesce("from", F.lit(""))), strip(F.coalesce("to", F.lit("")))
    r = rules.filter(F.coalesce("enabled", F.lit(True))).select("pos", old.alias("from"), new.alias("to"), "note")
    r = r.filter((F.col("from") != "") & (F.col("from") != F.col("to")))
    return r.select(F.struct(F.lit(0).alias("kind"), F.col("pos").cast("long").alias("pos"), F.lit(0).alias("size"), F.lit(0).alias("place")).alias("at"), F.lit("exact").alias("type"), "from", "to", "note", F.lit(None).cast("string").alias("category"))


def alias_steps(rules: DataFrame) -> DataFrame:
    """Steps of rules (pos, canonical, variants, category, enabled): each rule's variants, the longest first."""
    to = strip(F.coalesce("canonical", F.lit("")))
    r = rules.filter(F.coalesce("enabled", F.lit(True))).select("pos", to.alias("to"), "category", F.posexplode(F.transform("variants", lambda v: strip(v))).alias("place", "from"))
    r = r.filter("`to` <> '' and `from` <> '' and `from` <> `to`").groupBy("pos", "to", "category", "from").agg(F.min("place").alias("place"))
    at = F.struct(F.lit(1).alias("kind"), F.col("pos").cast("long").alias("pos"), (-F.length("from")).alias("size"), "place")
    return r.select(at.alias("at"), F.lit("alias").alias("type"), "from", "to", F.lit(None).cast("string").alias("note"), "category")


def term_steps(spark: SparkSession, terms: dict[str, str] | None = None) -> DataFrame:
    """Steps of spoken terms, in the order given; the fixed ones if none are."""
    some = list((SPOKEN_TERMS if terms is None else terms).items())
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(some)], "pos long, from string, to string")
    none = F.lit(None).cast("string")
    return d.select(F.struct(F.lit(2).alias("kind"), "pos", F.lit(0).alias("size"), F.lit(0).alias("place")).alias("at"), F.lit("term").alias("type"), "from", "to", none.alias("note"), none.alias("category"))


class Strings:
    """Which of many strings stand in a piece of text: their numbers. Short pieces come again and again in texts of one kind, so that what
    was found in them is kept."""

    def __init__(self, strings: list[str]):
        self.longest, self.spaced = max(map(len, strings)), any(" " in s for s in strings)
        self.found, self.known, self.chars, self.hits = ahocorasick.Automaton(), {}, 0, 0
        for n, s in enumerate(strings):
            self.found.add_word(s, n)
        self.found.make_automaton()

    def inside(self, piece: str) -> frozenset[int]:
        at = self.known.get(piece)
        if at is None:
            at = frozenset(map(itemgetter(1), self.found.iter(piece))) or NOTHING
            if len(piece) <= SHORT:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[piece] = at
        return at

    def anywhere(self, text: str) -> set[int]:
        """A text in which little is found is best read as a whole; where much is, word by word, each of which is read once."""
        if self.spaced or 4 * self.hits <= self.chars:
            all_ = list(map(itemgetter(1), self.found.iter(text)))
            self.chars, self.hits = self.chars + len(text), self.hits + len(all_)
            return set(all_)
        return set().union(*map(self.inside, set(text.split(" "))))

    def around(self, text: str, places: list[int], size: int) -> set[int]:
        """Those that may touch what stands at places, of this size. No string is longer than what is read on either side, and where none
        has a space, a space ends it."""
        pieces = set()
        for p in places:
            left, right = text[max(0, p - self.longest) : p], text[p + size : p + size + self.longest]
            if not self.spaced:
                left, right = left[left.rfind(" ") + 1 :], right.partition(" ")[0]
            pieces.add(left + text[p : p + size] + right)
        return set().union(*map(self.inside, pieces))


class Part:
    """Steps (type, from, to, note, category) of one type, in order. An alias of word characters alone stands where these are a whole run
    between others; what is written there makes no runs but its own. All other strings are looked for by the automaton."""

    def __init__(self, steps: list[tuple]):
        self.kind, self.steps, self.patterns = steps[0][0], steps, {}
        self.words: dict[str, list[int]] = {}
        of: dict[str, list[int]] = {}
        for i, s in enumerate(steps):
            (self.words if self.kind == "alias" and RUN.fullmatch(s[1]) else of).setdefault(s[1], []).append(i)
        self.all_words, self.at = frozenset(self.words), {s: n for n, s in enumerate(of)}
        self.of, self.strings = list(of.values()), Strings(list(of)) if of else None

    def places(self, i: int, text: str) -> list[int]:
        old = self.steps[i][1]
        if self.kind == "exact":
            out, p = [], text.find(old)
            while p >= 0:
                out.append(p)
                p = text.find(old, p + len(old))
            return out
        if i not in self.patterns:
            # The string comes first, for which re looks fast; what may not stand before it is looked at from behind it.
            literal, no = re.escape(old), f"[{WORD}]" if self.kind == "alias" else f"[^{AROUND}]"
            self.patterns[i] = re.compile(f"{literal}(?<!{no}{literal})(?!{no})")
        return [m.start() for m in self.patterns[i].finditer(text)]

    def corrected(self, text: str, changes: list[dict]) -> str:
        left: list[int] = []
        met: set[int] = set()
        met_words: set[str] = set()

        def meet(strings: set[int], words: set[str], after: int) -> None:
            """Of what isn't waiting yet, the first step behind `after`. A step leaves nothing for the next one that looks for the same, unless
            it is met anew."""
            for at in [self.of[n] for n in strings - met] + [self.words[w] for w in words - met_words]:
                n = bisect_right(at, after)
                if n < len(at):
                    heapq.heappush(left, at[n])
            met.update(strings)
            met_words.update(words)

        runs = lambda t: self.all_words & set(RUN.findall(t)) if self.words else set()
        meet(self.strings.anywhere(text) if self.strings else set(), runs(text), -1)
        while left:
            i = heapq.heappop(left)
            kind, old, new, note, category = self.steps[i]
            met.discard(self.at.get(old, -1))
            met_words.discard(old)
            places = self.places(i, text)
            if not places:
                continue
            out, last = [], 0
            for p in places:
                out += [text[last:p], new]
                last = p + len(old)
            text = "".join([*out, text[last:]])
            changes.append({"type": kind, "from": old, "to": new, "count": len(places), "note": note, "category": category})
            written = [p + n * (len(new) - len(old)) for n, p in enumerate(places)]
            meet(self.strings.around(text, written, len(new)) if self.strings else set(), runs(new), i)
        return text


class Automaton:
    """Steps (type, from, to, note, category) in order; those of one type that follow each other are a part."""

    def __init__(self, steps: list[tuple]):
        self.parts = [Part(list(some)) for _, some in groupby(steps, itemgetter(0))]

    def corrected(self, text: str) -> tuple[str, list[dict]]:
        """The text after all steps, and the changes of those that fired."""
        changes: list[dict] = []
        for part in self.parts if text else []:
            text = part.corrected(text, changes)
        return text, changes


_BUILT: dict[int, Automaton] = {}


def corrector(*steps: DataFrame) -> Callable[[Column], Column]:
    """Of tables of steps a function from a text column to a struct of the corrected text and its changes; null stays null. Exact rules
    come first, then aliases, then terms."""
    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    n = every.count()
    if n > MOST:
        raise ValueError(f"{n} rules: at most {MOST} are broadcast")
    rows = [tuple(r) for r in every.orderBy("at").select("type", "from", "to", "note", "category").collect()]
    shared = every.sparkSession.sparkContext.broadcast(rows)
    number = shared._jbroadcast.id() if hasattr(shared, "_jbroadcast") and shared._jbroadcast else id(shared)

    @F.arrow_udf(f"text string, changes {CHANGES}")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if number not in _BUILT:
            _BUILT.clear()
            _BUILT[number] = Automaton(shared.value)
        automaton = _BUILT[number]
        # A batch has as many texts as Spark likes; only a slice of them is held as objects.
        for batch in batches:
            for start in range(0, len(batch), SLICE):
                done = [(None, []) if t is None else automaton.corrected(t) for t in batch.slice(start, SLICE).to_pylist()]
                yield pa.array([{"text": t, "changes": c} for t, c in done], CHANGED)

    return run
