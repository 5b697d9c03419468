from __future__ import annotations

import json
import os

SCHEMA = "candidate_id string, line long, event string, at timestamp"


def put(folder, name, *rows):
    tmp = folder.parent / f".{name}"
    tmp.write_text("\n".join(json.dumps(dict(zip(("candidate_id", "line", "event", "at"), r, strict=True))) for r in rows))
    os.rename(tmp, folder / name)


def test_states_close_and_survive_a_restart(spark, tmp_path):
    from talweg.streaming import journal as J

    source = tmp_path / "in"
    source.mkdir()
    out, progress = f"{tmp_path}/out", []

    def run():
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        q = J.appended(J.stream_states(events, "at", delay="1 minute", idle=600), out, f"{tmp_path}/check").outputMode("update").start()
        q.processAllAvailable()
        progress.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        q.stop()

    day = "2026-01-01T"
    put(source, "1.json", ("a", 2, "generated", day + "00:00:05Z"), ("a", 1, "started", day + "00:00:00Z"), ("b", 3, "started", day + "00:00:10Z"), ("c", 4, "failed", day + "00:00:20Z"))
    run()
    # again: a repeated line, and a key that goes on after the restart
    put(source, "2.json", ("b", 3, "started", day + "00:00:10Z"), ("b", 5, "failed", day + "00:05:00Z"), ("d", 6, "started", day + "00:06:00Z"))
    run()
    # far later: the watermark passes, all idle keys close; then an event of long ago is too late to count
    put(source, "3.json", ("e", 7, "started", day + "03:00:00Z"))
    run()
    put(source, "4.json", ("a", 8, "started", day + "00:00:30Z"), ("e", 9, "generated", day + "03:00:01Z"), (None, 10, "started", day + "03:00:02Z"))
    run()
    rows = spark.read.schema("candidate_id string, n_events long, n_repeated long, state string, closed boolean, batch int").json(out).orderBy("batch", "candidate_id").collect()
    last = {r["candidate_id"]: (r["n_events"], r["n_repeated"], r["state"], r["closed"]) for r in rows}
    assert last["a"] == (2, 0, "generated", True) and last["b"] == (2, 1, "failed", True) and last["c"] == (1, 0, "invalid", True)
    assert last["d"] == (1, 0, "started", True) and last["e"] == (2, 0, "generated", False) and set(last) == set("abcde")
    assert sum(r["closed"] for r in rows) == 4  # each key closes once, the late event opens none
    # what is kept is bounded: the closed keys are gone
    states = {r["candidate_id"] for r in rows if not r["closed"]}
    assert len(states) == 5 and progress[-1] < progress[1]


def test_a_batch_is_appended_once(spark, tmp_path):
    from talweg.streaming import journal as J

    df = spark.range(5).selectExpr("id", "'x' AS v")
    assert J.append_once(df, f"{tmp_path}/j", 0) and not J.append_once(df, f"{tmp_path}/j", 0) and J.append_once(df.limit(2), f"{tmp_path}/j", 1)
    assert spark.read.json(f"{tmp_path}/j").count() == 7 and not [f for f in os.listdir(f"{tmp_path}/j") if f.startswith("_stage")]


def test_replay_binds_rows_to_tasks(spark):
    from talweg.streaming import journal as J

    journal = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "1"), ("c", "2"), ("d", None), ("e", "1")], "k string, sha string")
    tasks = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", None), ("d", None), ("x", "1")], "k string, sha string")
    assert {tuple(r) for r in J.replay_faults(journal, tasks, "k", ["sha"]).collect()} == {("b", "repeated"), ("c", "sha"), ("d", "task"), ("e", "task")}
