"""Stages outside the engine: a model call or a transport becomes a table of responses, joined or mapped in batches (§2.16)."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.extraction import extraction_record
from corvane.functions.lexicon import ScoreLexicon
from corvane.functions.text import compress, fallback_summary, fast_score, wrap_untrusted

T = TypeVar("T")

# How often a call is tried, how long it waits, and what isn't tried again.
ATTEMPTS, WAITS, FINAL, RATE_WAIT = 4, (5, 15, 45, 90), (400, 401, 403, 404), 30
CONNECT_TRIES, CONNECT_WAIT = 3, 5
PROMPT_CHARS, OVERRIDE_CHARS = 12_000, 100
#: Texts that are held as objects at once.
DIGESTED = 256
CORRECTIONS_HEADING = "- 전사 교정 규칙 (반드시 적용, corrections에 기록):"


def retry_wait(status: Column, attempt: Column) -> Column:
    """Seconds before the next try after attempt (from 0) ended with this status; null if there is none."""
    last = attempt >= ATTEMPTS - 1
    steps = F.array(*map(F.lit, WAITS))
    return F.when(last | status.isin(*FINAL), F.lit(None).cast("int")).when(status == 429, (RATE_WAIT * F.pow(F.lit(2.0), attempt)).cast("int")).when(status >= 500, F.get(steps, attempt))


def prompt(template: str, corrections: Column, content: Column, most: int = PROMPT_CHARS, examples: str = "", override: str | None = None) -> Column:
    """The template with {corrections}, {examples} and {content}, the content cut and framed as data. An override of over a hundred
    characters, as a prompt store may give it, stands in for the template with all that is filled into it but the content."""
    framed = wrap_untrusted(F.lit("transcript"), F.substring(content, 1, most))
    if override and len(override) > OVERRIDE_CHARS:
        whole = F.lit(override)
    else:
        whole = F.replace(F.replace(F.lit(template), F.lit("{corrections}"), corrections), F.lit("{examples}"), F.lit(examples))
    return F.replace(whole, F.lit("{content}"), framed)


def prompt_digests(template: str, corrections: str, content: Column, most: int = PROMPT_CHARS, examples: str = "") -> Column:
    """Struct (md5, chars) of what prompt() makes of the same. What stands before the content is the same in all prompts, and with many
    corrections most of them: it is hashed once by each worker, and no prompt is made. Null content, null struct."""
    framed = wrap_untrusted(F.lit("transcript"), F.substring(content, 1, most))
    parts = template.replace("{corrections}", corrections).replace("{examples}", examples).split("{content}")
    shared = SparkSession.active().sparkContext.broadcast(parts)

    @F.arrow_udf("md5 string, chars int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        first, *others = [(p.encode("utf-8"), len(p)) for p in shared.value]
        head, chars = hashlib.md5(first[0], usedforsecurity=False), first[1] + sum(n for _, n in others)

        def one(text: str | None) -> dict | None:
            if text is None:
                return None
            h, own = head.copy(), text.encode("utf-8")
            for part, _ in others:
                h.update(own)
                h.update(part)
            return {"md5": h.hexdigest(), "chars": chars + len(others) * len(text)}

        for batch in batches:
            for start in range(0, len(batch), DIGESTED):
                yield pa.array([one(t) for t in batch.slice(start, DIGESTED).to_pylist()], pa.struct([("md5", pa.string()), ("chars", pa.int32())]))

    return run(framed)


def corrections_block(rules: DataFrame) -> DataFrame:
    """block: the rules (pos, old, new, note) as lines of a prompt, one row, empty without rules. Rules are what people wrote."""
    line = F.concat(F.lit('  - "'), "old", F.lit('" → "'), "new", F.lit('"'), F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" ("), "note", F.lit(")"))).otherwise(""))
    lines = rules.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return lines.select(F.when(F.col("lines") == "", "").otherwise(F.concat(F.lit(CORRECTIONS_HEADING + "\n"), "lines")).alias("block"))


def connected(connect: Callable[[], T], tries: int = CONNECT_TRIES, wait: float = CONNECT_WAIT, sleep: Callable[[float], None] = time.sleep) -> T:
    """What connect() gives, tried again after a pause while it fails; the last failure is raised. For transports outside the engine."""
    for left in range(tries - 1, -1, -1):
        try:
            return connect()
        except OSError:
            if not left:
                raise
            sleep(wait)
    raise ValueError("no tries")


class ResponseTable:
    """Responses that are already there: stem, response."""

    def __init__(self, responses: DataFrame):
        self.responses = responses

    def transform(self, df: DataFrame) -> DataFrame:
        return df.join(self.responses.select("stem", "response"), "stem", "left")


class MappedCalls:
    """Calls of a function over batches of prompts; it gives a response, or None, for each."""

    def __init__(self, call: Callable[[list[str]], list[str | None]]):
        self.call = call

    def transform(self, df: DataFrame) -> DataFrame:
        call = self.call

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(response=call(pdf["prompt"].tolist()))

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInPandas(each, f"{fields}, response string")


def extract(transcripts: DataFrame, extractor: ResponseTable | MappedCalls, template: str = "{corrections}\n{content}", lexicon: ScoreLexicon | None = None) -> DataFrame:
    """stem, status, record, summary of transcripts (stem, text): the gate and all that is cheap come before the call; dropped ones
    keep a row. status: skipped_fast_score, ok or fallback."""
    scored = transcripts.select("*", F.explode(F.array(fast_score(F.col("text"), lexicon))).alias("score"))
    asked = scored.filter("score.should_process").withColumn("prompt", prompt(template, F.lit(""), compress(F.col("text"))))
    r = extractor.transform(asked.select("stem", "text", "prompt")).select("*", F.explode(F.array(extraction_record(F.col("response")))).alias("record"))
    bad = F.col("response").isNull() | F.col("record.parse_error") | F.col("record.invalid_number")
    done = r.select("stem", F.when(bad, "fallback").otherwise("ok").alias("status"), F.when(~bad, F.col("record")).alias("record"), F.when(bad, fallback_summary(F.col("text"))["one_line"]).otherwise(F.col("record.summary.one_line")).alias("one_line"))
    kind = done.schema["record"].dataType.simpleString()
    dropped = scored.filter("not score.should_process").select("stem", F.lit("skipped_fast_score").alias("status"), F.lit(None).cast(kind).alias("record"), F.lit(None).cast("string").alias("one_line"))
    return done.unionByName(dropped)
