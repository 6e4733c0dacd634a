"""The to-do store: fuzzy matching, merging, completion (D1 to D8, J6, J7, F2, F7, P1, W-order rules).

Similar titles are found by prefix filtering: for a Jaccard threshold t, two bigram sets can only match if they share a bigram
among the rarest |x| - ceil(t |x|) + 1 of each, and if their sizes are within a factor of t. Candidates meet in an equi
join on such a bigram whose condition also bounds the overlap by bit signatures, and what passes is verified exactly.
Equal titles are made one before the join, so that copies don't meet each other.

Where both sides of a join grow with the rows, it is told to exchange them (the hint "merge"): files of repeated titles are a few bytes
a row, by which Spark would take millions of rows for a small table and send them through the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.names import call_context
from corvane.functions.text import bigrams, normalise_source, normalise_title, set_jaccard, strip
from corvane.operators.inorder import decided
from corvane.operators.rank import global_rank
from corvane.session import staged

SIMILAR, COMPLETED_SIMILAR = 0.55, 0.45
#: Rows and similar pairs of a source that one task works through.
WHOLE = 50_000


def _signed(titles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, title, g (bigrams), n (how many), s0 to s3 (a bit for each bigram's hash), spare (bigrams that share a bit)."""
    word = "aggregate(g, 0L, (acc, x) -> CASE WHEN pmod(shiftright(xxhash64(x), 6), 4) = {i} THEN acc | shiftleft(1L, cast(xxhash64(x) & 63 AS int)) ELSE acc END)"
    # explode() of one element: what is computed above it is computed once, and not again in each expression that uses it.
    sets = titles.select(*keys, "title").distinct().select(*keys, "title", F.explode(F.array(bigrams(F.col("title")))).alias("g")).filter(F.size("g") > 0)
    signed = sets.select(*keys, "title", "g", F.size("g").alias("n"), F.inline(F.array(F.struct(*[F.expr(word.format(i=i)).alias(f"s{i}") for i in range(4)]))))
    return signed.withColumn("spare", F.expr("n - bit_count(s0) - bit_count(s1) - bit_count(s2) - bit_count(s3)"))


def _prefixes(signed: DataFrame, frequency: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """A row for each of the rarest bigrams of a title, with what bounds its similarity; the bigrams themselves stay behind."""
    own = [*keys, "title", "n", "s0", "s1", "s2", "s3", "spare"]
    grams = signed.select(*own, F.explode("g").alias("gram")).join(frequency, "gram", "left")
    ordered = grams.groupBy(*own).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "gram"))), lambda x: x["gram"]).alias("g"))
    return ordered.select(*own, F.explode(F.slice("g", F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int") + 1)).alias("gram"))


def similar_titles(left: DataFrame, right: DataFrame, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """keys, a, b: distinct titles of left and right (title, keys) of equal keys and a similarity of at least threshold."""
    keys = keys or []
    # Written once each: set expressions are costly, and none of them may be pushed into the join.
    one, two = staged(_signed(left, keys)), staged(_signed(right, keys))
    frequency = two.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("f"))
    a, b = _prefixes(one, frequency, threshold, keys).alias("a"), _prefixes(two, frequency, threshold, keys).alias("b")
    same = F.col("a.gram") == F.col("b.gram")
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    # Common bits bound the common bigrams from above; a pair that the bound rules out is never formed.
    bits = sum((F.bit_count(F.col(f"a.s{i}").bitwiseAND(F.col(f"b.s{i}"))) for i in range(4)), F.lit(0))
    most = bits + F.least("a.spare", "b.spare")
    near = a.join(b, same & (most * (1 + threshold) >= (F.col("a.n") + F.col("b.n")) * threshold - 1e-9))
    pairs = near.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.title").alias("a"), F.col("b.title").alias("b")).distinct()
    return staged(pairs).filter(set_jaccard(bigrams(F.col("a")), bigrams(F.col("b"))) >= threshold)


def not_completed(todos: DataFrame, completed: DataFrame, threshold: float = COMPLETED_SIMILAR) -> DataFrame:
    """todos (title, ...) whose normalised title neither equals nor resembles one of completed.title."""
    done = completed.select(normalise_title(F.col("title")).alias("title")).distinct()
    mine = todos.select(normalise_title(F.col("title")).alias("title")).distinct()
    near = similar_titles(mine, done, threshold).select(F.col("a").alias("title"))
    gone = near.unionByName(mine.join(done, "title", "left_semi")).distinct()
    return todos.join(gone, normalise_title(todos["title"]) == gone["title"], "left_anti")


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """seq, place of what is kept of a source's rows (seq, a) with its similar titles (a, b): row by row, each against the kept titles
    that it resembles. A row that repeats a title does nothing unless such a title has come or gone since."""
    near: dict[str, set[str]] = {}
    pairs = pdf[pdf["b"].notna()]
    for x, y in zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True):
        near.setdefault(x, {x}).add(y)
    places: dict[str, list[int]] = {}
    kept: dict[int, int] = {}
    settled: set[str] = set()
    rows = pdf[pdf["b"].isna()].sort_values("seq", kind="stable")
    for seq, title in zip(rows["seq"].astype("int64").tolist(), rows["a"].tolist(), strict=True):
        if title in settled:
            continue
        place, other = min(((min(places[y]), y) for y in near[title] if places.get(y)), default=(seq, None))
        if other is None or len(title) > len(other):
            if other is not None:
                places[other].remove(place)
                settled -= near[other]
            kept[place] = seq
            places.setdefault(title, []).append(place)
            settled -= near[title]
        else:
            settled.add(title)
    return pd.DataFrame({"seq": list(kept.values()), "place": list(kept)}, dtype="int64")


def _in_rounds(met: DataFrame, again: DataFrame, pairs: DataFrame) -> DataFrame:
    """seq, place of what is kept, of sources of any size: first rows met (source, title, seq, size), all rows of repeated titles,
    similar titles. First rows are worked through, then those, too, that come first behind a change of what is kept that they
    resemble, until no other row is found."""
    key = ["source", "title"]
    repeats, rows = not again.isEmpty(), None
    while True:
        one = met.select("source", F.col("title").alias("a"), F.col("seq").alias("earlier"))
        two = met.select("source", F.col("title").alias("b"), F.col("seq").alias("later"))
        edges = one.join(pairs.hint("merge"), ["source", "a"]).join(two.hint("merge"), ["source", "b"]).select("earlier", "later")
        if rows:
            edges = edges.unionByName(one.join(two, (one["source"] == two["source"]) & (one["a"] == two["b"])).select("earlier", "later"))
        fates = decided(met, edges.filter("earlier < later"), True)
        if not repeats:
            break
        # A change: a row that was kept, and the title that it replaced, if any.
        of = met.select("seq", *key)
        came = fates.filter("kept").select("seq", F.col("seq").alias("at")).unionByName(fates.filter("until is not null").select("seq", F.col("until").alias("at")))
        change = came.join(of.hint("merge"), "seq").select(*key, "at")
        near = change.unionByName(change.withColumnRenamed("title", "a").join(pairs.hint("merge"), ["source", "a"]).select("source", F.col("b").alias("title"), "at"))
        times = near.groupBy(*key).agg(F.sort_array(F.collect_set("at")).alias("times"))
        since = F.size(F.filter(F.coalesce("times", F.array().cast("array<bigint>")), lambda t: t < F.col("seq")))
        behind = again.join(times, key, "left").select(*key, "seq", "size", since.alias("since")).groupBy(*key, "since").agg(F.min("seq").alias("seq"), F.any_value("size").alias("size"))
        # All rows found so far: what is worked through only grows.
        more = staged(met.unionByName(behind.select(*met.columns)).distinct())
        before, rows = rows or met.count(), more.count()
        if rows == before:
            break
        met = more
    return fates.filter("kept and until is null").select("seq", "place")


def merge_within_sources(todos: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """todos (seq, title, source, ...) with overlapping titles of a source merged in order, and `place`, the position kept.

    Titles that resemble no other are kept as they come. A source whose other rows and pairs are at most WHOLE, as a call's are, is
    worked through in one task; larger ones in rounds over the pairs of all of them (inorder.decided), with no task for a source.
    """
    titled = todos.withColumn("source", F.coalesce("source", F.lit("")))
    key = ["source", "title"]
    first = staged(titled.groupBy(*key).agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("rows"), F.length(F.any_value("title")).alias("size"), F.size(bigrams(F.any_value("title"))).alias("grams")))
    pairs = staged(similar_titles(first, first, threshold, ["source"]).filter("a <> b"))
    paired = staged(first.join(pairs.select("source", F.col("a").alias("title")).distinct().hint("merge"), key, "left_semi"))
    members = titled.join(paired.select(*key, "size").hint("merge"), key).select(*key, "seq", "size")
    alone = first.filter("grams > 0").join(paired.select(*key).hint("merge"), key, "left_anti").select("seq", F.col("seq").alias("place"))
    load = pairs.groupBy("source").count().unionByName(paired.groupBy("source").agg(F.sum("rows").alias("count")))
    large = staged(load.groupBy("source").agg(F.sum("count").alias("count")).filter(F.col("count") > WHOLE).select("source"))
    each = members.select("source", "seq", F.col("title").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(pairs.select("source", F.lit(None).cast("long").alias("seq"), "a", "b"))
    some = not large.isEmpty()
    if some:
        each = each.join(large, "source", "left_anti")
    # By number: adaptive execution would put many small sources, a few bytes a row but costly, into one task.
    each = each.repartition(2 * each.sparkSession.sparkContext.defaultParallelism, "source")
    kept = alone.unionByName(each.groupBy("source").applyInPandas(lambda pdf: _merged(pdf[["seq", "a", "b"]]), "seq long, place long"))
    if some:
        met = staged(paired.join(large, "source", "left_semi").select(*key, "seq", "size"))
        again = staged(members.join(paired.filter("rows > 1").select(*key).hint("merge"), key, "left_semi").join(large, "source", "left_semi"))
        kept = kept.unionByName(_in_rounds(met, again, pairs.join(large, "source", "left_semi")))
    # A title without bigrams resembles nothing, not even its equal.
    bare = titled.filter(F.size(bigrams(F.col("title"))) == 0).select("seq", F.col("seq").alias("place"))
    return titled.join(kept.unionByName(bare).hint("merge"), "seq")


def add_new(store: DataFrame, new: DataFrame, completed: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """new (seq, title, source, ...) that the store takes: titled, not completed, resembling nothing in the store nor anything taken
    before; with `key`."""
    titled = new.withColumns({"title": strip(F.coalesce("title", F.lit(""))), "source": normalise_source(F.col("source"))}).filter("title <> ''")
    # Each is used several times below, and costs a join of similar titles.
    open_ = staged(not_completed(titled, completed))
    known = similar_titles(open_, store, threshold).select(F.col("a").alias("title")).distinct()
    fresh = staged(open_.join(known, "title", "left_anti"))
    first = staged(fresh.groupBy("title").agg(F.min("seq").alias("seq")).filter(F.size(bigrams(F.col("title"))) > 0))
    pairs = similar_titles(first, first, threshold).filter("a < b")
    seq = lambda c: first.select(F.col("title").alias(c), F.col("seq").alias(f"seq_{c}"))
    edges = pairs.join(seq("a").hint("merge"), "a").join(seq("b").hint("merge"), "b").select(F.least("seq_a", "seq_b").alias("earlier"), F.greatest("seq_a", "seq_b").alias("later"))
    taken = decided(first.select("seq"), edges, False).filter("kept").select("seq")
    bare = fresh.filter(F.size(bigrams(F.col("title"))) == 0).select("seq")
    return fresh.join(taken.unionByName(bare).hint("merge"), "seq").withColumn("key", F.concat_ws("|", normalise_title(F.col("title")), "source"))


def upsert(store: DataFrame, new: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """store and new by key, the last of new first, then the store's."""
    both = store.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("is_new"), F.desc(order)))
    return both.withColumn("rank", rank).filter("rank = 1").drop("rank", "is_new")


def merged_store(store: DataFrame, new: DataFrame, completed: DataFrame) -> DataFrame:
    """The whole merge: new ones merged within sources, completed ones removed from the store, the rest added under their keys."""
    merged = staged(merge_within_sources(new).drop("place"))
    left = not_completed(store, completed)
    added = add_new(left, merged, completed)
    return upsert(left, added.select(*left.columns))


def first_by_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key that isn't empty."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.filter((F.col("_rank") == 1) & F.coalesce(key != "", F.lit(False))).drop("_rank")


def completed_union(existing: DataFrame, store: DataFrame) -> DataFrame:
    """title, source, status, completed_at: the store's completed ones over the existing, by (title, source), by title. Of rows that
    repeat a key that with the latest completed_at, and then the greatest status, stays."""

    def latest(df: DataFrame) -> DataFrame:
        rows = df.select("title", F.coalesce("source", F.lit("")).alias("source"), F.struct("completed_at", "status").alias("last"))
        return rows.groupBy("title", "source").agg(F.max("last").alias("last")).select("title", "source", "last.status", "last.completed_at")

    done, old = latest(store.filter("status = 'completed'")), latest(existing)
    return done.unionByName(old.join(done, ["title", "source"], "left_anti")).orderBy("title", "source")


def owned(records: DataFrame, run_id: str | None = None, owner: str = "me") -> DataFrame:
    """The to-dos of validated results (file, status, todos) that are the owner's and have a title, a row each, with the context of
    the file's name: what a synchronisation adds to the store. Results that aren't ok give none; without an owner a to-do is mine."""
    each = records.filter("status = 'ok'").select("file", F.posexplode("todos").alias("place", "t"))
    mine = each.filter((F.coalesce("t.owner", F.lit("me")) == owner) & (strip(F.coalesce("t.title", F.lit(""))) != ""))
    context = call_context(normalise_source(F.col("file")))
    return mine.select("file", "place", "t", F.explode(F.array(context)).alias("c")).select(
        "file", "place", strip(F.col("t.title")).alias("title"), F.lit(owner).alias("owner"), normalise_source(F.col("file")).alias("source"), F.col("c.caller").alias("counterparty"), "c.phone", "c.called_at",
        F.coalesce("t.priority", F.lit("medium")).alias("priority"), F.lit("active").alias("status"), F.coalesce("t.context", F.lit("")).alias("details"), F.nullif("t.due_date", F.lit("")).alias("due_date"),
        F.lit(run_id).cast("string").alias("run_id"),
    )


def synchronised(store: DataFrame, records: DataFrame, completed: DataFrame, run_id: str | None = None) -> DataFrame:
    """store (seq, title, source, key) after the owner's to-dos of validated results, in the order of files and places."""
    new = global_rank(owned(records, run_id), "file", "place").withColumn("seq", F.col("rank"))
    return merged_store(store, new, completed)
