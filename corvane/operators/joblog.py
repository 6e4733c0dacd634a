"""The job store as an append-only log: events, snapshots, and a swap of the version that only one of several drivers wins (Q8 to Q18).

An event is a job as it is from then on, or the mark that it is gone. A commit writes the events of the jobs that it touches, and
nothing else, as a folder of its own; it counts once the file `commits/<version>` names that folder, and that file is made only if it
isn't there. A driver that read version n can therefore commit n + 1 alone: who comes second reads anew and decides anew, so no job
is claimed twice. A commit that fails, before or after another's, leaves data that nothing names.

The state is a fold by key: of each job the event of the highest version, an aggregate that is combined before the shuffle, however
often a job has reported progress. Each `every` versions the fold is written as a snapshot, from which readers go on; `vacuum` removes
what lies before it.

The file system must create a file exclusively, as HDFS and local ones do. Drivers' clocks play no part: `now` is given.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.operators import jobs
from corvane.sources.versions import TRIES, Conflict, Versions

EVERY = 16
MARK = "version bigint, event string, at timestamp, id bigint, gone boolean"


class JobLog:
    """The log at path, of jobs of a schema with an `id`; every: versions between snapshots."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, every: int = EVERY):
        self.spark, self.path, self.every = spark, path.rstrip("/"), every
        self.files = Versions(spark, path)
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.events_schema = StructType.fromDDL(MARK).add("job", self.schema)

    def _folder(self, kind: str, version: int) -> str:
        return f"{self.path}/data/{self.files.text(kind, version)}"

    def _written(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        return folder

    # ── reading ──

    def version(self) -> int:
        """The last version; -1 of an empty log."""
        return max([-1, *self.files.numbers("commits")])

    def events(self, since: int = -1, upto: int | None = None) -> DataFrame:
        """The events of versions behind `since` and up to `upto`."""
        last = self.version() if upto is None else upto
        paths = [self._folder("commits", v) for v in range(since + 1, last + 1)]
        empty = self.spark.createDataFrame([], self.events_schema)
        return self.spark.read.schema(self.events_schema).parquet(*paths) if paths else empty

    def _latest(self, version: int) -> DataFrame:
        """The last event of each job that isn't gone."""
        base = max([-1, *(s for s in self.files.numbers("snapshots") if s <= version)])
        rows = self.events(base, version)
        if base >= 0:
            rows = rows.unionByName(self.spark.read.schema(self.events_schema).parquet(self._folder("snapshots", base)))
        kept = [F.max_by(F.struct(*[F.col(c) for c in rows.columns]), "version").alias("last")]
        return rows.groupBy("id").agg(*kept).select("last.*").filter("not gone")

    def state(self, version: int | None = None) -> DataFrame:
        """The jobs as they are after a version, the last one if none is given."""
        return self._latest(self.version() if version is None else version).select("job.*")

    # ── writing ──

    def change(self, event: str, decide: Callable[[DataFrame], tuple[DataFrame, DataFrame]], now: Column) -> tuple[int, DataFrame]:
        """The version, and its events, after decide(state), which gives the jobs that it touches as they were and as they become. With
        another driver's commit in between it is decided anew."""
        for _ in range(TRIES):
            version = self.version()
            before, after = decide(self.state(version))
            old = before.select("id", F.to_json(F.struct(*before.columns)).alias("_was"))
            new = after.select(F.col("id"), F.struct(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.schema.names]).alias("job"))
            both = old.join(new.withColumn("_is", F.to_json("job")), "id", "full").filter(~F.col("_was").eqNullSafe(F.col("_is")))
            rows = both.select(F.lit(version + 1).cast("long").alias("version"), F.lit(event).alias("event"), now.alias("at"), "id", F.col("job").isNull().alias("gone"), "job")
            if self.files.put("commits", version + 1, self._written(rows)):
                if (version + 1) % self.every == 0:
                    self.snapshot(version + 1)
                return version + 1, self.events(version, version + 1)
        raise Conflict(f"{TRIES} commits of other drivers came first")

    def snapshot(self, version: int) -> None:
        """The fold of all events up to a version, written."""
        self.files.put("snapshots", version, self._written(self._latest(version)))

    def vacuum(self) -> None:
        """Removes the events that lie before the last snapshot but one, and older snapshots. The versions' files stay, so that no version is
        given twice."""
        taken = self.files.numbers("snapshots")[:-1]
        for v in (v for v in self.files.numbers("commits") if taken and v <= taken[-1]):
            self.files.remove(f"data/{self.files.text('commits', v)}")
        for v in taken[:-1]:
            self.files.remove(f"data/{self.files.text('snapshots', v)}")
            self.files.remove(f"snapshots/{v:012d}")

    # ── what callers ask for ──

    def submit(self, new: DataFrame, now: Column) -> tuple[int, DataFrame]:
        """Jobs whose idempotency_key no other has; the first of new ones with equal keys."""
        def decide(state: DataFrame) -> tuple[DataFrame, DataFrame]:
            fresh = jobs.submit(state, new.select(*self.schema.names)).join(new.select("id"), "id", "left_semi")
            return state.limit(0), fresh.join(state.select("id"), "id", "left_anti")

        return self.change("submit", decide, now)

    def claim(self, now: Column, per_queue: int = 1) -> tuple[int, DataFrame]:
        """The next jobs of each queue, running from now on."""
        def decide(state: DataFrame) -> tuple[DataFrame, DataFrame]:
            next_ = jobs.next_jobs(state, now, per_queue).drop("place")
            return next_, jobs.claim(next_, now, per_queue)

        return self.change("claim", decide, now)

    def _of(self, event: str, asked: DataFrame, step: Callable[[DataFrame], DataFrame], now: Column) -> tuple[int, DataFrame]:
        def decide(state: DataFrame) -> tuple[DataFrame, DataFrame]:
            touched = state.join(asked.select("id").distinct(), "id", "left_semi")
            return touched, step(touched)

        return self.change(event, decide, now)

    def transition(self, asked: DataFrame, now: Column) -> tuple[int, DataFrame]:
        """asked (id, kind) where the state allows it."""
        return self._of("transition", asked, lambda j: jobs.transition(j, asked, now), now)

    def fail(self, errors: DataFrame, now: Column) -> tuple[int, DataFrame]:
        """errors (id, error) of running jobs."""
        return self._of("fail", errors, lambda j: jobs.fail(j, errors, now), now)

    def progress(self, reports: DataFrame, now: Column) -> tuple[int, DataFrame]:
        """reports (id, progress)."""
        return self._of("progress", reports, lambda j: jobs.with_progress(j, reports), now)

    def replay(self, asked: DataFrame, now: Column) -> tuple[int, DataFrame]:
        """asked (id, new_id, override): new jobs like those."""
        def decide(state: DataFrame) -> tuple[DataFrame, DataFrame]:
            again = jobs.replay(state, asked, now)
            missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in again.columns]
            return state.limit(0), again.select("*", *missing)

        return self.change("replay", decide, now)

    def clean(self, before: Column, now: Column) -> tuple[int, DataFrame]:
        """Removes jobs that finished before then; their children lose their parent."""
        def decide(state: DataFrame) -> tuple[DataFrame, DataFrame]:
            gone = state.join(jobs.cleaned(state, before).select("id"), "id", "left_anti").select("id")
            kids = state.join(gone.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select("id")
            touched = state.join(gone.unionByName(kids).distinct(), "id", "left_semi")
            return touched, jobs.cleaned(touched, before)

        return self.change("clean", decide, now)
