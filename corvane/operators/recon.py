"""Recordings against what became of them: matching, causes, counts, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.names import basename, canonical_stem, stem_cut, stem_struct, timed

# Causes in order with their priorities. What to do next is said in words of our own.
CAUSES = {
    "missing_sync": ("P0", "check the recording's path and its synchronisation"),
    "missing_transcript": ("P0", "transcribe the recording"),
    "blacklisted": ("P3", "leave it, or take it off the list and transcribe it"),
    "transcription_failed": ("P1", "find out why it failed, then try again or list it"),
    "diarization_failed": ("P2", "tell the speakers apart again, or use a checked copy"),
    "entity_pending": ("P2", "resume extraction"),
    "rag_pending": ("P2", "index what is new"),
    "obsidian_pending": ("P2", "export what is new"),
    "derived_excluded": ("P4", "nothing: it is a checked copy of another"),
}
OF_TEXTS = ("rag_pending", "obsidian_pending", "entity_pending")
BACKGROUND = ("blacklisted", "derived_excluded", "entity_pending", "obsidian_pending")


def unchanged(scan: DataFrame, processed: DataFrame) -> DataFrame:
    """scan (stem, hash, ...) without what was processed with the same content."""
    return scan.join(processed.select("stem", "hash"), ["stem", "hash"], "left_anti")


def split_blacklist(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stems that are blacklisted, and those that only failed."""
    e = entries.filter("stem <> '_meta'")
    listed = F.coalesce("blacklisted_at", F.lit("")) != ""
    return e.filter(listed).select("stem"), e.filter(~listed & (F.coalesce("failures", F.lit(0)) > 0)).select("stem")


def wholes(transcripts: DataFrame) -> DataFrame:
    """Stems that derived transcripts are derived from, as often as they are."""
    return transcripts.select("stem", F.explode(F.array(canonical_stem(F.col("stem")))).alias("whole")).filter("whole <> stem").select(F.col("whole").alias("stem"))


def called_alike(audio: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Stems of audio for which some transcript says the same of who called when, by an equi semi join."""
    # explode() of one element: a stem is matched once, not again in each expression that uses a part; these stay compiled, as in a lambda they wouldn't.
    one = lambda df, name, value: df.select("stem", F.explode(F.array(value)).alias(name))
    a, t = (one(one(one(df, "r", timed(F.col("stem"))).filter("r <> stem"), "cut", stem_cut(F.col("stem"), F.col("r"))), "p", stem_struct(F.col("cut"))).select("stem", "p.*") for df in (audio, transcripts))
    phoned = F.col("phone") != ""
    asked = a.select("stem", "date", phoned.alias("phoned"), F.when(phoned, F.col("phone")).otherwise(F.col("caller")).alias("who"))
    known = lambda is_phone, who: F.struct(F.lit(is_phone).alias("phoned"), F.col(who).alias("who"))
    keys = t.select("date", F.explode(F.when(phoned, F.array(known(True, "phone"), known(False, "caller"))).otherwise(F.array(known(False, "caller")))).alias("k")).select("date", "k.*")
    # By a hash first: the keys begin alike, so that a sort would compare them whole.
    asked, keys = (df.withColumn("h", F.xxhash64("date", "phoned", "who")) for df in (asked, keys))
    return asked.join(keys, ["h", "date", "phoned", "who"], "left_semi").select("stem")


def matched_audio(audio: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Stems of audio that some transcript stands for: by stem, as an aggregate of both, and by who called when."""
    # Stems are hashed, not sorted: 1 is a recording, 2 a transcript.
    names = transcripts.select("stem").unionByName(wholes(transcripts))
    both = audio.select("stem", F.lit(1).alias("side")).unionByName(names.select("stem", F.lit(2).alias("side"))).filter("stem is not null")
    same = both.groupBy("stem").agg(F.bit_or("side").alias("sides")).filter("sides = 3").select("stem")
    return same.unionByName(called_alike(audio, transcripts)).distinct()


#: What is known of a stem, a bit each.
AUDIO, TRANSCRIPT, MATCHED, LISTED, FAILED, INDEXED, EXPORTED, EXTRACTED, UNTOLD, WHOLE = (1 << i for i in range(10))


def _known(df: DataFrame, stem: Column, bit: int) -> DataFrame:
    return df.select(stem.alias("stem")).filter("stem is not null").withColumn("bit", F.lit(bit))


def gaps(
    audio: DataFrame, transcripts: DataFrame, blacklist: DataFrame, indexed: DataFrame, exported: DataFrame, extracted: DataFrame, diarization_failed: DataFrame, matched: DataFrame | None = None, once: bool = False
) -> DataFrame:
    """reason, file, stem, priority, next_action: a row for each file and cause; with once, one for each stem and cause, even if inputs
    repeat it. indexed.path, exported.name, extracted.stem; matched: matched_audio(audio, transcripts), where it is there already.

    All that is known of a stem is brought together by one aggregate of bits, which hashes stems where a join for each cause would
    deal and sort them again; so is what matches by stem. Only derived copies, which are looked up under another stem, and who called
    when have a join of their own."""
    listed, failed = split_blacklist(blacklist)
    stem, name = F.col("stem"), F.concat("stem", F.lit(".txt"))
    # A transcript's file is its stem and .txt, so that other names are no transcript's.
    named = lambda df, file: df.select(F.explode(F.array(file)).alias("file")).filter(F.endswith("file", F.lit(".txt"))).select(F.expr("left(file, length(file) - 4)").alias("stem"))
    facts = [
        audio.select("stem", F.lit(AUDIO).alias("bit")), transcripts.select("stem", F.lit(TRANSCRIPT).alias("bit")), diarization_failed.select("stem", F.lit(UNTOLD).alias("bit")),
        _known(called_alike(audio, transcripts) if matched is None else matched, stem, MATCHED), _known(listed, stem, LISTED), _known(failed, stem, FAILED),
        _known(named(indexed, basename(F.col("path"))), stem, INDEXED), _known(named(exported, F.col("name")), stem, EXPORTED), _known(extracted, stem, EXTRACTED),
    ]
    has = lambda bits: F.col("bits").bitwiseAND(bits) != 0
    is_matched = has(MATCHED)
    if matched is None:
        facts.append(_known(wholes(transcripts), stem, WHOLE))
        is_matched = is_matched | (has(TRANSCRIPT | WHOLE) & stem.isNotNull())
    number = lambda bit, name: F.count_if(F.col("bit") == bit).alias(name)
    of = reduce(DataFrame.unionByName, facts).groupBy("stem").agg(F.bit_or("bit").alias("bits"), *([] if once else [number(AUDIO, "recordings"), number(TRANSCRIPT, "texts")]))
    # As many rows as the stem has files: one, unless an input repeats it.
    recordings, texts = (has(AUDIO).cast("int"), has(TRANSCRIPT).cast("int")) if once else (F.col("recordings").cast("int"), F.col("texts").cast("int"))
    row = lambda reason, n: F.struct(reason.alias("reason"), n.alias("n"))
    text = lambda reason, bit: row(F.lit(reason), F.when(has(bit), 0).otherwise(texts))
    causes = F.array(
        row(F.when(has(LISTED), "blacklisted").when(has(FAILED), "transcription_failed").otherwise("missing_transcript"), F.when(is_matched, 0).otherwise(recordings)),
        text("rag_pending", INDEXED), text("obsidian_pending", EXPORTED), text("entity_pending", EXTRACTED), row(F.lit("diarization_failed"), has(UNTOLD).cast("int")),
    )
    known = F.create_map(*[x for k, (p, n) in CAUSES.items() for x in (F.lit(k), F.struct(F.lit(p).alias("priority"), F.lit(n).alias("next_action")))])
    out = lambda df: df.select("reason", "file", "stem", known[F.col("reason")].alias("k")).select("reason", "file", "stem", "k.priority", "k.next_action")
    found = of.select("stem", F.inline(causes)).filter("n > 0")
    if not once:
        found = found.select("stem", "reason", F.explode(F.array_repeat(F.lit(0), F.col("n"))))
    found = found.select("stem", "reason", F.concat("stem", F.when(F.col("reason").isin(*OF_TEXTS), ".txt").otherwise(".m4a")).alias("file"))
    t = transcripts.select("stem", F.explode(F.array(canonical_stem(stem))).alias("canonical"))
    derived = t.filter("canonical <> stem").join(audio.select(F.col("stem").alias("canonical")), "canonical", "left_semi").select(F.lit("derived_excluded").alias("reason"), name.alias("file"), "stem")
    return out(found).unionByName(out(derived.distinct() if once else derived))


def cause_counts(found: DataFrame) -> DataFrame:
    """reason, files of every cause, zeros too."""
    causes = found.sparkSession.createDataFrame([(i, k) for i, k in enumerate(CAUSES)], "pos int, reason string")
    counts = found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return causes.join(counts, "reason", "left").select("pos", "reason", F.coalesce("n", F.lit(0)).alias("files"))


def health(counts: DataFrame, state_errors: int = 0) -> DataFrame:
    """health, exit_code of the counts of causes."""
    urgent = F.sum(F.when(F.col("reason").isin("missing_transcript", "transcription_failed", "missing_sync"), F.col("files")).otherwise(0))
    any_ = F.sum(F.when(F.col("reason") != "derived_excluded", F.col("files")).otherwise(0))
    level = F.when(F.lit(state_errors > 0) | (urgent > 0), 2).when(any_ > 0, 1).otherwise(0)
    return counts.agg(level.alias("exit_code")).select(F.element_at(F.array(F.lit("normal"), F.lit("warning"), F.lit("danger")), F.col("exit_code") + 1).alias("health"), "exit_code")


def action_queue(found: DataFrame) -> DataFrame:
    return found.filter(~F.col("reason").isin(*BACKGROUND)).orderBy("priority", "reason", "file")


def merged_index(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Both indexes; where a key is in both, the left one's value."""
    r = right.select(key, F.col(value).alias("_other"))
    return left.select(key, value).join(r, key, "full").select(key, F.coalesce(value, "_other").alias(value))


def report(
    audio: DataFrame, transcripts: DataFrame, found: DataFrame, blacklist: DataFrame, indexed: DataFrame, exported: DataFrame, extracted: DataFrame, matched: DataFrame | None = None
) -> DataFrame:
    """The sixteen derived counts, one row: sources, matches by count and by stem, states, causes. Each source is counted once."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    of = cause_counts(found).agg(*[F.sum(F.when(F.col("reason") == k, F.col("files")).otherwise(0)).alias(k) for k in CAUSES])
    counted = {
        "audio": audio, "transcripts": transcripts, "complete": matched_audio(audio, transcripts) if matched is None else matched,
        "blacklist_entries": blacklist.filter("stem <> '_meta'"), "indexed_files": indexed.select(basename(F.col("path"))).distinct(),
        "exported_files": exported.select("name").distinct(), "extracted_stems": extracted.select("stem").distinct(),
    }
    one = reduce(DataFrame.crossJoin, [n(df, name) for name, df in counted.items()], of)
    return one.select(
        "audio", "transcripts", F.col("transcripts").alias("complete_by_count"), (F.col("audio") - F.col("transcripts")).alias("gap_by_count"), "complete", (F.col("audio") - F.col("complete")).alias("gap"),
        "derived_excluded", "blacklist_entries", "indexed_files", "rag_pending", "exported_files", "obsidian_pending", "extracted_stems", "entity_pending", "diarization_failed",
        (F.col("missing_transcript") + F.col("transcription_failed") + F.col("diarization_failed")).alias("reprocess"),
    )
