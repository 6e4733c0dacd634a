"""The job log: replayed against a plain model, concurrent claims, conflicts, snapshots."""

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.operators import joblog
from corvane.operators.joblog import Conflict, JobLog
from corvane.sources.versions import BucketTable

SCHEMA = "id long, status string, queue string, priority int, payload map<string,string>, attempts int, max_attempts int, idempotency_key string, parent_id long, scheduled_at timestamp, created_at timestamp, started_at timestamp, completed_at timestamp, error string, progress string"
START = datetime(2024, 1, 1)


def at(k):
    return F.lit((START + timedelta(hours=k)).isoformat()).cast("timestamp")


def job(i, rng, status="pending"):
    return {"id": i, "status": status, "queue": f"q{i % 2}", "priority": rng.randint(0, 2), "payload": {"a": "1"}, "attempts": 0, "max_attempts": 2, "idempotency_key": f"k{i // 3}" if i % 3 else None, "parent_id": i - 1 if i % 4 == 1 else None, "scheduled_at": None, "created_at": START + timedelta(minutes=rng.randint(0, 9)), "started_at": None, "completed_at": None, "error": None, "progress": None}


def model_submit(state, new):
    known = {j["idempotency_key"] for j in state.values()} - {None}
    for j in sorted(new, key=lambda j: j["id"]):
        if j["idempotency_key"] not in known:
            state[j["id"]] = dict(j)
            known |= {j["idempotency_key"]} - {None}


def model_claim(state, k, per_queue):
    for q in ("q0", "q1"):
        due = sorted((j for j in state.values() if j["status"] == "pending" and j["queue"] == q), key=lambda j: (-j["priority"], j["created_at"], j["id"]))
        for j in due[:per_queue]:
            j |= {"status": "running", "attempts": j["attempts"] + 1, "started_at": j["started_at"] or START + timedelta(hours=k)}


MOVES = {"complete": (("running",), "completed"), "cancel": (("pending", "running", "paused"), "cancelled"), "pause": (("pending", "running"), "paused"), "resume": (("paused",), "pending")}


def shown(jobs):
    return {j["id"]: tuple(j[c] for c in ("status", "attempts", "parent_id", "started_at", "completed_at", "error", "progress")) for j in jobs}


@pytest.mark.parametrize("seed", [0])
def test_a_mixed_sequence(spark, tmp_path, seed):
    rng, state = random.Random(seed), {}
    log = JobLog(spark, f"file://{tmp_path}/log", SCHEMA, every=4)
    for k in range(11):
        now, when = at(k), START + timedelta(hours=k)
        some = rng.sample(sorted(state), min(len(state), 6))
        kind = "submit" if k in (0, 5) else rng.choice(["claim", "transition", "fail", "progress", "clean", "claim"])
        if kind == "submit":
            new = [job(k * 20 + i, rng) for i in range(12)]
            log.submit(spark.createDataFrame(new, SCHEMA), now)
            model_submit(state, new)
        elif kind == "claim":
            log.claim(now, 3)
            model_claim(state, k, 3)
        elif kind == "transition":
            asked = [(i, rng.choice(sorted(MOVES))) for i in some]
            log.transition(spark.createDataFrame(asked, "id long, kind string"), now)
            for i, move in asked:
                start, end = MOVES[move]
                if state[i]["status"] in start:
                    state[i] |= {"status": end} | ({"completed_at": when} if end in ("completed", "cancelled") else {})
        elif kind == "fail":
            log.fail(spark.createDataFrame([(i, "boom") for i in some], "id long, error string"), now)
            for i in some:
                j = state[i]
                if j["status"] == "running":
                    over = j["attempts"] >= j["max_attempts"]
                    j |= {"error": "boom", "status": "failed" if over else "pending", "completed_at": when if over else j["completed_at"]}
        elif kind == "progress":
            log.progress(spark.createDataFrame([(i, f'{{"done":{k}}}') for i in [*some, 999]], "id long, progress string"), now)
            for i in some:
                state[i]["progress"] = f'{{"done":{k}}}'
        else:
            log.clean(at(k - 1), now)
            gone = {i for i, j in state.items() if j["status"] in ("completed", "failed", "cancelled") and j["completed_at"] < START + timedelta(hours=k - 1)}
            state = {i: j | ({"parent_id": None} if j["parent_id"] in gone else {}) for i, j in state.items() if i not in gone}
    assert log.version() == 10 and log.files.numbers("snapshots") == [0, 4, 8]
    got = [r.asDict() for r in log.state().collect()]
    assert shown(got) == shown(state.values()) and len(got) == len(state)
    # From the events alone, and from what a clean-up of files leaves, the state is the same.
    log.vacuum()
    assert shown(r.asDict() for r in JobLog(spark, log.path, SCHEMA).state().collect()) == shown(state.values())


def test_two_claimers_never_share_a_job(spark, tmp_path):
    rng = random.Random(1)
    path = f"file://{tmp_path}/log"
    JobLog(spark, path, SCHEMA).submit(spark.createDataFrame([job(i, rng) | {"idempotency_key": None} for i in range(40)], SCHEMA), at(0))

    def claimer(_):
        log = JobLog(spark, path, SCHEMA)
        return [r.id for _ in range(3) for r in log.claim(at(1), 2)[1].collect()]

    with ThreadPoolExecutor(3) as pool:
        got = [i for ids in pool.map(claimer, range(3)) for i in ids]
    assert len(got) == len(set(got)) == 3 * 3 * 2 * 2
    assert JobLog(spark, path, SCHEMA).state().filter("status = 'running'").count() == len(got)


def test_who_comes_second_decides_anew(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    path = f"file://{tmp_path}/log"
    one, two = JobLog(spark, path, SCHEMA), JobLog(spark, path, SCHEMA)
    one.submit(spark.createDataFrame([job(i, rng) for i in (0, 3)], SCHEMA), at(0))
    calls = []

    def decide(state):
        calls.append(1)
        if len(calls) == 1:
            two.progress(spark.createDataFrame([(0, "first")], "id long, progress string"), at(1))
        return state, state.withColumn("error", F.concat(F.lit("saw "), F.coalesce("progress", F.lit("nothing"))))

    version, events = one.change("look", decide, at(2))
    assert version == 2 and len(calls) == 2
    assert {r.id: r.job.error for r in events.collect()} == {0: "saw first", 3: "saw nothing"}
    monkeypatch.setattr(joblog, "TRIES", 2)
    with pytest.raises(Conflict):
        one.change("lost", lambda s: (two.progress(spark.createDataFrame([(0, str(two.version()))], "id long, progress string"), at(3)), (s, s))[1], at(3))


def test_an_empty_log_and_changes_of_nothing(spark, tmp_path):
    log = JobLog(spark, f"file://{tmp_path}/log", SCHEMA)
    assert log.version() == -1 and log.state().count() == 0
    version, events = log.claim(at(0))
    assert version == 0 and events.count() == 0 and log.state().count() == 0


def test_an_upsert_rewrites_the_buckets_it_falls_in(spark, tmp_path):
    rows = {i: f"v{i}" for i in range(500)}
    table = BucketTable(spark, f"file://{tmp_path}/t", "k long, v string", "k", buckets=32)
    df = lambda some: spark.createDataFrame(some, "k long, v string, n int")
    assert table.read().count() == 0
    table.upsert(df([(k, v, 0) for k, v in rows.items()]))
    before = table.manifest()
    table.upsert(df([(7, "old", 1), (7, "new", 2), (1000, "x", 1)]), "n")
    after = table.manifest()
    assert len(before) == 32 and 1 <= sum(before.get(b) != f for b, f in after.items()) <= 2
    want = rows | {7: "new", 1000: "x"}
    assert dict(map(tuple, table.read().collect())) == want and dict(map(tuple, table.read(0).collect())) == rows
    table.delete(df([(8, None, None), (4000, None, None)]))
    del want[8]
    with pytest.raises(Exception, match="lost"):
        table.change(df([(1, "", 0)]), lambda old: old.withColumn("v", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(ValueError, match="buckets"):
        table.change(df([(1, "", 0)]), lambda old: old.unionByName(df([(k, "", 0) for k in range(50)]).drop("n")))
    assert table.version() == 2 and dict(map(tuple, table.read().collect())) == want

    def meanwhile(old):
        if table.version() == 2:
            BucketTable(spark, f"file://{tmp_path}/t", "k long, v string", "k", buckets=32).upsert(df([(9, "other", 0)]))
        return old.withColumn("v", F.concat("v", F.lit("!")))

    table.change(df([(9, "", 0)]), meanwhile)
    assert table.version() == 4 and table.read().filter("k = 9").first().v == "other!"
