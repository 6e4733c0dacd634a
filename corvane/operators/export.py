"""Export: notes, links, reports, messages, vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.names import export_name, notice_time, safe_file_name
from corvane.functions.text import normalise_title, phone_display, strip
from corvane.operators.rank import global_rank
from corvane.operators.recon import CAUSES, action_queue, health
from corvane.session import staged

# Lengths, headings, icons and limits of what is written.
LEAST_CONTENT = 100
CALL_TAG, CALL_HEADING = "통화전사", "## 통화 기록"
ICONS = {"high": "🔴", "medium": "🟡", "low": "🟢"}
UNKNOWN_PARTY, NO_DATE = "알 수 없음", "미정"
NEW_TODOS, OLD_TODOS, APPOINTMENTS = 8, 10, 5
NEW_HEADING, OPEN_HEADING, LEFT_OUT, APPOINTMENT_HEADING = "🆕 새 TODO", "📋 미완료 TODO (%d건)", "  ... 외 %d건", "📅 새 스케줄"


def skip_reasons(files: DataFrame, processed: DataFrame) -> DataFrame:
    """files (name, size_bytes, text) with parsed and skip: processed, unparsed, small, short or null."""
    f = files.join(processed.select("name", F.lit(True).alias("_done")), "name", "left").withColumn("parsed", export_name(F.col("name")))
    skip = F.when(F.col("_done"), "processed").when(F.col("parsed").isNull(), "unparsed").when(F.col("size_bytes") < LEAST_CONTENT, "small").when(F.length(strip(F.col("text"))) < LEAST_CONTENT, "short")
    return f.withColumn("skip", skip).drop("_done")


def notes(files: DataFrame, processed: DataFrame) -> DataFrame:
    """name, note, counterparty, date, markdown. Notes of one party and day get the time into their names; short files count for
    that too, for they are found out only afterwards."""
    f = skip_reasons(files, processed).filter("skip is null or skip = 'short'")
    party, date = F.coalesce("parsed.counterparty", "parsed.phone"), F.date_format("parsed.at", "yyyy-MM-dd")
    f = f.withColumns({"party": party, "date": date}).withColumn("several", F.count(F.lit(1)).over(Window.partitionBy("party", "date")) > 1)
    safe = safe_file_name(F.col("party"))
    note = F.when(F.col("several"), F.concat_ws("_", "date", F.date_format("parsed.at", "HHmm"), safe)).otherwise(F.concat_ws("_", "date", safe))
    return f.filter("skip is null").select("name", F.concat(note, F.lit(".md")).alias("note"), F.col("parsed.counterparty").alias("counterparty"), "date", markdown().alias("markdown"))


def markdown() -> Column:
    p = F.col("parsed")
    cp, phone, date = p["counterparty"], p["phone"], F.date_format(p["at"], "yyyy-MM-dd")
    tag = F.get(F.filter(F.split(F.regexp_replace(cp, "[()（）《》]", ""), r"(?U)\s+"), lambda x: x != ""), F.lit(0))
    return F.concat_ws(
        "\n",
        F.lit("---"), F.lit("type: transcript"), F.concat(F.lit('counterparty: "'), F.coalesce(cp, F.lit("")), F.lit('"')), F.concat(F.lit('phone: "'), phone, F.lit('"')),
        F.concat(F.lit("date: "), date), F.concat(F.lit('time: "'), F.date_format(p["at"], "HH:mm:ss"), F.lit('"')), F.concat(F.lit("source_file: "), F.col("name")),
        F.concat(F.lit("tags: ["), F.concat_ws(", ", F.lit(CALL_TAG), tag), F.lit("]")), F.lit("---"), F.lit(""),
        F.concat(F.lit("# 통화 전사 — "), F.coalesce(cp, phone_display(phone)), F.lit(" ("), date, F.lit(" "), F.date_format(p["at"], "HH:mm"), F.lit(")")), F.lit(""),
        F.when(cp.isNotNull(), F.concat(F.lit("> **거래처**: [["), cp, F.lit("]]"))), F.concat(F.lit("> **전화**: "), phone_display(phone)), F.lit(""), F.lit("---"), F.lit(""), F.col("text"),
    )


def party_files(written: DataFrame, existing: DataFrame) -> DataFrame:
    """counterparty, content: links of new notes under the heading, newest first, but those that are there; a new file begins
    with its first link, to which later ones are added on top. existing: counterparty, content."""
    new = written.filter("counterparty is not null").join(existing, "counterparty", "left").filter("content is null or not contains(content, note)")
    links = new.groupBy("counterparty").agg(F.sort_array(F.collect_set(F.struct("date", "note")), asc=False).alias("l"), F.any_value("content").alias("content"))
    lines = F.array_join(F.transform("l", lambda x: F.concat(F.lit("- ["), x["date"], F.lit("] [["), x["note"], F.lit("]]"))), "\n")
    heading = F.lit(CALL_HEADING)
    at = F.instr("content", CALL_HEADING)
    under = F.concat(F.substring("content", F.lit(1), at - 1), heading, F.lit("\n"), lines, F.substring("content", at + len(CALL_HEADING), F.length("content")))
    fresh = F.concat(F.lit('---\ntype: counterparty\nname: "'), F.col("counterparty"), F.lit('"\n---\n\n# '), F.col("counterparty"), F.lit("\n\n"), heading, F.lit("\n"), lines, F.lit("\n"))
    return links.select("counterparty", F.when(F.col("content").isNull(), fresh).when(at > 0, under).otherwise(F.concat("content", F.lit("\n\n"), heading, F.lit("\n"), lines, F.lit("\n"))).alias("content"))


def cause_table(counts: DataFrame) -> DataFrame:
    """The report's table of causes, as lines in order."""
    step = F.create_map(*[F.lit(x) for k, (_, n) in CAUSES.items() for x in (k, n)])
    return counts.select("pos", F.concat(F.lit("| "), F.col("reason"), F.lit(" | "), F.col("files").cast("string"), F.lit(" | "), step[F.col("reason")], F.lit(" |")).alias("line"))


def todo_lines(todos: DataFrame, most: int) -> DataFrame:
    """seq, line of the first to-dos (seq, title, priority, counterparty, phone, called_at)."""
    icon = F.coalesce(F.create_map(*[F.lit(x) for kv in ICONS.items() for x in kv])[F.col("priority")], F.lit(""))
    p = F.coalesce("phone", F.lit(""))
    shown = F.when(F.length(p) < 10, p).otherwise(F.concat_ws("-", F.substring(p, 1, 3), F.substring(p, 4, 4), F.substring(p, 8, 100)))
    cp = F.nullif(F.nullif("counterparty", F.lit("")), F.lit(UNKNOWN_PARTY))
    source = F.concat_ws(" / ", F.when(cp.isNotNull(), F.when(p != "", F.concat(cp, F.lit(" ("), shown, F.lit(")"))).otherwise(cp)), F.when(F.coalesce("called_at", F.lit("")) != "", notice_time(F.col("called_at"))))
    line = F.concat(F.lit("  "), icon, F.lit(" "), F.col("title"), F.when(source != "", F.concat(F.lit("\n    • 통화: "), source)).otherwise(""))
    return todos.orderBy("seq").limit(most).select("seq", line.alias("line"))


def _joined(parts: list[DataFrame], name: str) -> DataFrame:
    """One row: the lines of parts (seq, line), part by part, each in order. For messages and reports, whose lines are few."""
    lines = reduce(DataFrame.unionByName, [p.select(F.lit(i).alias("part"), F.col("seq").cast("long").alias("seq"), "line") for i, p in enumerate(parts)])
    ordered = F.sort_array(F.collect_list(F.struct("part", "seq", "line")))
    return lines.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(name))


def message(new: DataFrame, active: DataFrame, appointments: DataFrame) -> DataFrame:
    """body: the whole notification, one row. New to-dos first; then, if there are any, how many active ones are open besides, the first
    of them and how many are left out; then new appointments (seq, title, date, time, counterparty). Without anything, empty."""
    line = lambda df, text: df.select(F.lit(0).alias("seq"), text.alias("line"))
    some = new.agg(F.count(F.lit(1)).alias("new")).filter("new > 0")
    open_ = not_new(active, new)
    more = open_.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").crossJoin(some)
    cp = F.nullif(F.coalesce("counterparty", F.lit("")), F.lit(UNKNOWN_PARTY))
    date = F.coalesce(F.nullif("date", F.lit("")), F.lit(NO_DATE))
    shown = F.concat(F.lit("  - "), F.coalesce("title", F.lit("")), F.lit(" / "), date, F.lit(" "), F.coalesce("time", F.lit("")), F.when(cp != "", F.concat(F.lit(" / "), cp)).otherwise(""))
    met = appointments.orderBy("seq").limit(APPOINTMENTS)
    parts = [
        line(some, F.lit(NEW_HEADING)), todo_lines(new, NEW_TODOS),
        line(more, F.format_string("\n" + OPEN_HEADING, "n")), todo_lines(open_, OLD_TODOS).crossJoin(some).drop("new"), line(more.filter(F.col("n") > OLD_TODOS), F.format_string(LEFT_OUT, F.col("n") - OLD_TODOS)),
        line(met.limit(1), F.lit("\n" + APPOINTMENT_HEADING)), met.select("seq", shown.alias("line")),
    ]
    return _joined(parts, "body")


def report_text(counts: DataFrame, numbers: DataFrame, found: DataFrame, most: int = 30) -> DataFrame:
    """markdown: the whole report, one row, of counts of causes, derived counts (recon.report) and gaps: what follows from them, the
    table of causes, and the first rows of what is to be done at once, or that nothing is."""
    of = counts.agg(*[F.sum(F.when(F.col("reason") == k, F.col("files")).otherwise(0)).alias(f"n_{k}") for k in ("blacklisted", "missing_transcript", "transcription_failed")])
    one = health(counts).crossJoin(numbers).crossJoin(of)
    says = F.concat_ws(
        "\n", F.lit("# Recordings and what became of them\n"), F.format_string("- health: %s (exit_code=%d)\n\n## Conclusion\n", "health", "exit_code"),
        F.format_string("- by number of files: %d/%d (gap %d)", "complete_by_count", "audio", "gap_by_count"), F.format_string("- by stem: %d/%d (gap %d)", "complete", "audio", "gap"),
        F.format_string("- of that gap: blacklisted %d, missing_transcript %d, transcription_failed %d", "n_blacklisted", "n_missing_transcript", "n_transcription_failed"),
        F.format_string("- to be processed again: %d\n\n## Causes\n\n| category | count | next_action |\n|---|---:|---|", "reprocess"),
    )
    step = F.create_map(*[F.lit(x) for k, (_, n) in CAUSES.items() for x in (k, n)])
    queue = global_rank(action_queue(found).limit(most).select("priority", "reason", "file"), "priority", "reason", "file")
    rows = queue.select(F.col("rank").alias("seq"), F.format_string("| %s | %s | `%s` | %s |", "priority", "reason", "file", step[F.col("reason")]).alias("line"))
    none = rows.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(0).alias("seq"), F.lit("| - | - | - | nothing to be done at once |").alias("line"))
    head = one.select(F.lit(0).alias("seq"), F.lit(f"\n## To be done at once, the first {most}\n\n| priority | reason | file | next_action |\n|---|---|---|---|").alias("line"))
    return _joined([one.select(F.lit(0).alias("seq"), says.alias("line")), cause_table(counts).select(F.col("pos").alias("seq"), "line"), head, rows, none], "markdown")


def not_new(active: DataFrame, new: DataFrame) -> DataFrame:
    """Active to-dos whose title isn't among the new ones."""
    titles = new.select(normalise_title(F.col("title")).alias("_t")).distinct()
    return active.join(titles, normalise_title(active["title"]) == titles["_t"], "left_anti")


def appointment_key(title: Column, date: Column, time: Column, source: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (title, date, time, source)])


def unnotified(appointments: DataFrame, sent: DataFrame) -> DataFrame:
    """appointments (title, date, time, source) not yet sent (key); repeats within them stay."""
    key = appointment_key(*map(F.col, ("title", "date", "time", "source")))
    return appointments.withColumn("key", key).join(sent.select("key"), "key", "left_anti")


#: Queries whose vectors are held by each task at once.
QUERY_BLOCK = 1024


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, most: float = 1.5, source: str = "source") -> DataFrame:
    """query_pos, source, dist: of each query (query_pos, q) the k nearest vectors (source, v) within `most`, squared Euclidean; a
    source is kept for the first query that has it. Queries are taken in blocks of QUERY_BLOCK, whose vectors are broadcast: every
    row of vectors is scored against a block where it is, a batch passes on the k best of each query, and those meet by query. A null
    vector, or one with a null in it, is near to nothing, on either side; vectors are near only to queries of their length."""
    whole = lambda c: F.coalesce(~F.exists(c, lambda x: x.isNull()), F.lit(False))
    vectors, queries = vectors.filter(whole("v")), queries.filter(whole("q"))
    numbered = staged(global_rank(queries.select("query_pos", "q"), "query_pos").withColumn("block", F.floor(F.col("rank") / QUERY_BLOCK)))
    slim = vectors.select(F.col(source).alias("source"), "v")
    names, kind = ["query_pos", "source", "dist"], f"query_pos {numbered.schema['query_pos'].dataType.simpleString()}, source {slim.schema['source'].dataType.simpleString()}, dist double"

    def against(block: int) -> DataFrame:
        asked = numbered.filter(F.col("block") == block).select("query_pos", "q").collect()
        sent = vectors.sparkSession.sparkContext.broadcast([(r["query_pos"], np.array(r["q"], float)) for r in asked])

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                by_size = {n: (np.stack(group.map(lambda x: np.asarray(x, float)).tolist()), group.index) for n, group in pdf["v"].groupby(pdf["v"].map(len))}
                out = []
                for pos, q in sent.value:
                    if len(q) not in by_size:
                        continue
                    v, rows = by_size[len(q)]
                    d = ((v - q) ** 2).sum(axis=1)
                    # All that are as near as the k-th: ties are decided where all batches meet.
                    limit = min(most, np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf)
                    at = np.flatnonzero(d <= limit)
                    out.append(pd.DataFrame({"query_pos": pos, "source": pdf["source"].loc[rows[at]].to_numpy(), "dist": d[at]}))
                if out:
                    yield pd.concat(out)[names]

        return staged(slim.mapInPandas(each, kind))

    blocks = numbered.agg(F.max("block")).first()[0]
    if blocks is None:
        return slim.sparkSession.createDataFrame([], kind)
    d = reduce(DataFrame.unionByName, map(against, range(blocks + 1)))
    # A first cut within slices of the rows, so that a query's candidates of all batches aren't sorted in one task.
    local = F.row_number().over(Window.partitionBy("query_pos", F.pmod(F.xxhash64("source"), F.lit(64))).orderBy("dist", "source"))
    d = d.withColumn("r", local).filter(F.col("r") <= k).withColumn("r", F.row_number().over(Window.partitionBy("query_pos").orderBy("dist", "source")))
    near = d.filter((F.col("r") <= k) & (F.col("dist") <= most)).withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("query_pos", "dist")))
    return near.filter("n = 1").select(*names)


def with_recent(found: DataFrame, recent: DataFrame) -> DataFrame:
    """found and those of recent (path, ...) that aren't among it."""
    return found.unionByName(recent.join(found.select("path"), "path", "left_anti"))
