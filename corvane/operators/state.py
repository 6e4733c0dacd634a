"""State that outlives a run, as tables: blacklist, notifications, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.corrections import merged_variants
from corvane.functions.text import normalise_source, todo_key
from corvane.operators.export import appointment_key
from corvane.operators.rank import global_rank

FAILURES, ERROR_CHARS = 3, 500


def blacklist_after(entries: DataFrame, failures: DataFrame, most: int = FAILURES) -> DataFrame:
    """stem, failures, last_error, blacklisted_at after failures (seq, stem, error, at, counted): the last error, and the time of the
    failure that was one too many."""
    old = entries.select("stem", F.coalesce("failures", F.lit(0)).alias("before"), F.col("last_error").alias("old_error"), F.col("blacklisted_at").alias("old_at"))
    all_ = failures.groupBy("stem").agg(F.sum(F.col("counted").cast("int")).alias("n"), F.max_by("error", "seq").alias("error"), F.min_by("at", "seq").alias("first"))
    # Of a stem's counted failures the first few can be the one: each task passes on that many, however often a stem failed.
    place = F.row_number().over(Window.partitionBy("stem").orderBy("seq"))
    few = failures.filter("counted").select("stem", "seq", "at", place.alias("k")).filter(F.col("k") <= most).groupBy("stem").agg(F.sort_array(F.collect_list(F.struct("k", "at"))).alias("few"))
    new = all_.join(few, "stem", "left")
    before = F.coalesce("before", F.lit(0))
    at = F.when(before >= most, F.col("first")).otherwise(F.get("few", (F.lit(most - 1) - before).cast("int"))["at"])
    return old.join(new, "stem", "full").select("stem", F.coalesce(before + F.col("n"), "before").alias("failures"), F.coalesce(F.left("error", F.lit(ERROR_CHARS)), "old_error").alias("last_error"), F.coalesce("old_at", at).alias("blacklisted_at"))


def pending(audio: DataFrame, blacklisted: DataFrame, transcripts: DataFrame, too_short: DataFrame) -> DataFrame:
    """Recordings that are still to be transcribed, newest first."""
    left = audio
    for gone in (blacklisted, transcripts, too_short):
        left = left.join(gone.select("stem"), "stem", "left_anti")
    return left.orderBy(F.desc("mtime"), "stem")


def notified(state: DataFrame, todos: DataFrame, appointments: DataFrame, now: Column) -> DataFrame:
    """kind, key, title, updated_at: what was told of before and now; of one key what is told now."""
    t = todos.select(F.lit("todo").alias("kind"), todo_key(F.col("title"), F.col("source")).alias("key"), "title", now.alias("updated_at"))
    a = appointments.select(F.lit("appointment").alias("kind"), appointment_key(F.col("title"), F.col("date"), F.col("time"), normalise_source(F.col("source"))).alias("key"), "title", now.alias("updated_at"))
    new = t.unionByName(a).dropDuplicates(["kind", "key"])
    return new.unionByName(state.join(new.select("kind", "key"), ["kind", "key"], "left_anti"))


def exact_rules_after(rules: DataFrame, added: DataFrame) -> DataFrame:
    """pos, old, new, note, enabled: an added rule for a known text changes that rule where it stands; others come behind."""
    a = added.select(F.col("seq"), F.trim("old").alias("old"), F.trim("new").alias("new"), "note")
    last = a.groupBy("old").agg(F.max_by("new", "seq").alias("_new"), F.max_by("note", "seq").alias("_note"), F.min("seq").alias("_seq"))
    end = rules.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("end"))
    known = rules.join(last, "old", "left").select(
        F.col("pos").cast("long").alias("pos"), "old", F.when(F.col("_seq").isNotNull(), F.col("_new")).otherwise(F.col("new")).alias("new"),
        F.when(F.col("_seq").isNotNull(), F.col("_note")).otherwise(F.col("note")).alias("note"), (F.col("enabled") | F.col("_seq").isNotNull()).alias("enabled"),
    )
    fresh = global_rank(last.join(rules, "old", "left_anti"), "_seq").withColumn("k", F.col("rank") + 1).crossJoin(end)
    return known.unionByName(fresh.select((F.col("end") + F.col("k")).cast("long").alias("pos"), "old", F.col("_new").alias("new"), F.col("_note").alias("note"), F.lit(True).alias("enabled")))


def aliases_after(aliases: DataFrame, added: DataFrame) -> DataFrame:
    """canonical, variants, category after added (canonical, variants, category), one for each canonical form at most."""
    a = added.select("canonical", F.col("variants").alias("more"), F.col("category").alias("other"))
    none = F.array().cast("array<string>")
    both = aliases.select("canonical", "variants", "category").join(a, "canonical", "full")
    merged = merged_variants(F.col("canonical"), F.coalesce("variants", none), F.filter(F.transform(F.coalesce("more", none), lambda x: F.trim(x)), lambda x: x != ""))
    return both.select("canonical", merged.alias("variants"), F.coalesce("other", "category").alias("category"))
