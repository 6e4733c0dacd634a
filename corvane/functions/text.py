"""Text scoring, detection, masking and clean-up as column expressions. All of it stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import lexicon as lx
from corvane.functions.lexicon import ScoreLexicon

#: Java's flag for Python's rule: classes are those of Unicode.
UNICODE = "(?U)"
#: What Python calls white space: four separators more than Unicode does.
SPACE = r"\s\x1c-\x1f"
SIGNALS = ("token_count", "unique_words", "entity_density", "keyword_signal", "interaction")


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text, rf"(?U)^[{SPACE}]+|[{SPACE}]+\z", "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"(?U)[{SPACE}]+"), lambda x: x != "")


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur."""
    return reduce(Column.__add__, [F.contains(text, F.lit(w)).cast("int") for w in words], F.lit(0))


def occurrences(text: Column, words: Sequence[str]) -> Column:
    return reduce(Column.__add__, [F.regexp_count(text, F.lit(re.escape(w))) for w in words], F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fast_score(text: Column, lexicon: ScoreLexicon | None = None) -> Column:
    """Struct of score, band, should_process, signals and drop_reason, before anything expensive is done with a text."""
    lexicon = lexicon or ScoreLexicon()
    found = F.regexp_count(text, F.lit(lexicon.phone)) + F.regexp_count(text, F.lit(UNICODE + lexicon.amount)) + occurrences(text, lexicon.products)
    asked = reduce(Column.__add__, [F.regexp_like(text, F.lit(p)).cast("int") for p in lexicon.interactions], F.lit(0))
    counts = F.struct(
        let(tokens(text), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct"))).alias("words"),
        found.alias("found"), hits(text, lexicon.keywords).alias("keywords"), asked.alias("asked"),
    )

    def signals(c: Column) -> Column:
        n = c["words"]["all"]
        return F.struct(
            F.least(n / 200, F.lit(1.0)).alias("token_count"),
            (c["words"]["distinct"] / F.greatest(n, F.lit(1))).alias("unique_words"),
            F.when(n > 0, F.least(c["found"] / n / 0.01, F.lit(1.0))).otherwise(F.lit(0.0)).alias("entity_density"),
            F.least(c["keywords"] / 5, F.lit(1.0)).alias("keyword_signal"),
            F.least(c["asked"] / 3, F.lit(1.0)).alias("interaction"),
        )

    def scored(raw: Column) -> Column:
        rounded = {k: F.bround(raw[k], 4) for k in SIGNALS}
        total = reduce(Column.__add__, [rounded[k] * F.lit(lexicon.weights[k]) for k in SIGNALS])
        score = F.bround(total / sum(lexicon.weights.values()), 4)
        why = F.concat_ws(
            "; ",
            F.when(raw["token_count"] <= lexicon.drop, F.concat(F.lit("token_count="), raw["token_count"].cast("string"))),
            F.when(raw["unique_words"] <= lexicon.drop, F.concat(F.lit("unique_words="), raw["unique_words"].cast("string"))),
            F.when(raw["entity_density"] == 0, "no_entities"),
            F.when(raw["keyword_signal"] == 0, "no_keywords"),
            F.when(raw["interaction"] == 0, "no_interaction"),
        )
        return F.struct(score.alias("score"), F.struct(*[v.alias(k) for k, v in rounded.items()]).alias("signals"), why.alias("why"))

    def banded(s: Column) -> Column:
        score = s["score"]
        drop = score <= lexicon.drop
        return F.struct(
            score.alias("score"),
            F.when(score >= lexicon.keep, "definite_keep").when(drop, "definite_drop").otherwise("borderline").alias("band"),
            (~(drop & (score < lexicon.keep))).alias("should_process"),
            s["signals"].alias("signals"),
            F.when(drop, F.when(s["why"] != "", s["why"]).otherwise(F.concat(F.lit("score="), score.cast("string")))).alias("drop_reason"),
        )

    return let(let(let(counts, signals), scored), banded)


def detect_ideas(text: Column, patterns: Sequence[str] = lx.IDEA_PATTERNS) -> Column:
    """Array of (content, original_phrase), pattern by pattern."""
    def of(pattern: str) -> Column:
        p = F.lit("(?d)(?iu)(?U)" + pattern)
        # The text is searched once; a phrase, which ends as it did in the text, gives its content again.
        return F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.struct(strip(F.regexp_extract(x, "(?d)(?iu)(?U)" + pattern, 1)).alias("content"), strip(x).alias("original_phrase")))

    return F.filter(F.concat(*map(of, patterns)), lambda x: F.length(x["content"]) > 5)


def detect_entities(text: Column, company: str = lx.COMPANY_PATTERN, product: str = lx.PRODUCT_PATTERN) -> Column:
    """Distinct (entity_type, name) in order: companies first."""
    def of(pattern: str, kind: str) -> Column:
        names = F.filter(F.transform(F.regexp_extract_all(text, F.lit(UNICODE + pattern), F.lit(0)), strip), lambda x: F.length(x) >= 2)
        return F.transform(names, lambda x: F.struct(F.lit(kind).alias("entity_type"), x.alias("name")))

    return F.array_distinct(F.concat(of(company, "company"), of(product, "product")))


def _operational(text: Column, should_process: Column, messages: Sequence[str]) -> Column:
    # Two characters further apart than any message is long: found at once in most texts, which then need no stripping.
    most = max([5, *map(len, messages)])
    long = rf"(?s)(?U)[^{SPACE}].{{{most}}}.*?[^{SPACE}]"
    return F.when(F.regexp_like(text, F.lit(long)), False).otherwise(let(strip(text), lambda bare: (F.length(bare) < 5) | F.lower(bare).isin(*messages))) | ~should_process


def is_operational(text: Column, messages: Sequence[str] = lx.OPERATIONAL_MESSAGES, lexicon: ScoreLexicon | None = None) -> Column:
    return _operational(text, fast_score(text, lexicon)["should_process"], messages)


def detect_signals(text: Column, lexicon: ScoreLexicon | None = None, messages: Sequence[str] = lx.OPERATIONAL_MESSAGES) -> Column:
    """Struct of ideas, entities, is_operational, fast_score, summary, and whether the event is logged."""
    found = F.struct(detect_ideas(text).alias("ideas"), detect_entities(text).alias("entities"), fast_score(text, lexicon).alias("score"))

    def judged(f: Column) -> Column:
        return F.struct(f["ideas"].alias("ideas"), f["entities"].alias("entities"), f["score"].alias("score"), _operational(text, f["score"]["should_process"], messages).alias("short"))

    def told(f: Column) -> Column:
        ideas, entities, score = F.size(f["ideas"]), F.size(f["entities"]), f["score"]
        summary = F.concat(
            F.format_string("Signals: %d ideas, %d entities | fast_score=%.3f [%s]", ideas, entities, F.bround(score["score"], 3), score["band"]),
            F.when(f["short"], " (skipped: operational)").otherwise(""),
        )
        return F.struct(
            f["ideas"].alias("ideas"), f["entities"].alias("entities"), f["short"].alias("is_operational"), score.alias("fast_score"), summary.alias("summary"),
            (~f["short"] & ((ideas > 0) | (entities > 0))).alias("logged"),
        )

    return let(let(found, judged), told)


def redact(text: Column, limit: int | None = None) -> Column:
    """Credentials and personal identifiers masked, pass by pass; with a limit, the last characters."""
    phone = r"(?U)(?<!\d)(?:" + "|".join(lx.PHONE_FORMS) + r")(?!\d)"
    out = F.coalesce(text, F.lit(""))
    for pattern, by in (
        (UNICODE + lx.BEARER, "$1[REDACTED_BEARER]"),
        (phone, "[REDACTED_PHONE]"),
        (UNICODE + lx.EMAIL, "$1***$3"),
        (UNICODE + lx.TOKEN, "[REDACTED_TOKEN]"),
        (UNICODE + lx.SECRET, "$1=[REDACTED]"),
        (UNICODE + lx.USER_PATH, "[REDACTED_PATH]"),
    ):
        out = F.regexp_replace(out, pattern, by)
    return out if limit is None else F.right(out, F.lit(limit))


def compress(text: Column, budget: int = lx.BUDGET_CHARS) -> Column:
    """Without noise, each line stripped, cut to the budget."""
    out = text
    for pattern, by in lx.NOISE:
        out = F.regexp_replace(out, UNICODE + pattern, by)
    lines = F.array_join(F.transform(F.split(out, "\n"), strip), "\n")
    return F.substring(strip(lines), 1, budget)


def fallback_summary(text: Column, keywords: Sequence[str] = lx.FALLBACK_KEYWORDS) -> Column:
    """Struct of one_line and details: what is left to say when extraction failed."""
    content = F.coalesce(text, F.lit(""))
    long = F.filter(F.transform(F.split(content, "\n"), strip), lambda x: F.length(x) > 10)
    first = F.substring(F.get(long, F.lit(0)), 1, 100)
    return F.struct(
        F.coalesce(first, F.lit(lx.FALLBACK_LINE)).alias("one_line"),
        F.array(F.format_string(lx.FALLBACK_DETAIL, hits(content, keywords))).alias("details"),
        F.lit("unknown").alias("call_type"),
        F.lit(0.1).alias("overall_confidence"),
        F.lit(True).alias("fallback"),
    )


def normalise_title(title: Column) -> Column:
    return F.substring(F.replace(F.replace(F.lower(strip(F.coalesce(title, F.lit("")))), F.lit(" "), F.lit("")), F.lit("_"), F.lit("")), 1, 100)


def normalise_source(source: Column) -> Column:
    return F.regexp_replace(F.coalesce(source, F.lit("")), r"\.(m4a|txt)\z", "")


def todo_key(title: Column, source: Column) -> Column:
    return F.concat_ws("|", normalise_title(title), normalise_source(source))


def bigrams(text: Column) -> Column:
    """The set of character pairs, without spaces, in lower case. Characters are taken apart once: substring() counts from the beginning."""
    c = F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(""))), F.lit("(?s)."), F.lit(0))

    def pairs(c: Column) -> Column:
        n = F.greatest(F.size(c) - 1, F.lit(0))
        return F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda a, b: F.concat(a, b))

    return F.array_distinct(let(c, pairs))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def bigram_similarity(a: Column, b: Column) -> Column:
    return set_jaccard(bigrams(a), bigrams(b))


def phone_display(phone: Column) -> Column:
    """3-4-4 or 3-3-4 of digits, anything else as it is."""
    d = F.regexp_replace(phone, r"\D", "")
    return (
        F.when(F.length(d) == 11, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 4), F.substring(d, 8, 4)))
        .when(F.length(d) == 10, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4)))
        .otherwise(phone)
    )


def wrap_untrusted(label: Column, content: Column) -> Column:
    return F.concat(F.lit(lx.UNTRUSTED_HEADER + "\nSource: "), label, F.lit("\n\n<<<UNTRUSTED_SOURCE_DATA>>>\n"), content, F.lit("\n<<<END_UNTRUSTED_SOURCE_DATA>>>"))


def queue_id(stem: Column, reason: Column, action: Column) -> Column:
    return F.concat(F.lit("rq_"), F.left(F.sha2(F.concat_ws("\0", stem, reason, action), 256), F.lit(16)))


def error_report(returncode: Column, stderr: Column, stdout: Column) -> Column:
    """How a run failed: its code and the last line of its errors, or of its output if there are none, masked and cut."""
    said = strip(redact(F.when(F.coalesce(stderr, F.lit("")) != "", stderr).otherwise(F.coalesce(stdout, F.lit("")))))
    last = F.element_at(F.split(said, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"), -1)
    return F.left(F.concat(F.lit("exit "), returncode.cast("string"), F.lit(": "), F.when(said == "", "no output").otherwise(last)), F.lit(500))
