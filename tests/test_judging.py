"""Scoring that outlives a killed job, and arguments cut one by one."""

from __future__ import annotations

import json
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stepscope.operators import judging


def asked(folder):
    """How often the scorer saw each payload."""
    return Counter(name.split("-")[0] for name in os.listdir(folder))


def scorer_of(folder, stop=None):
    """Leaves a file a call; stops its task at one payload, never answers well at others."""

    def scorer(payload):
        with open(f"{folder}/{payload}-{os.urandom(8).hex()}", "w"):
            pass
        if payload == stop:
            time.sleep(6)  # other tasks end meanwhile
            raise SystemExit("killed")
        if int(payload) % 10 == 3:
            return {"note": "no category"}
        if int(payload) % 10 == 7:
            return None
        return {"root_cause_error_type": "other", "root_cause_step_index": int(payload)}

    return scorer


def test_killed_job_asks_nothing_twice(spark, tmp_path):
    calls, folder = str(tmp_path / "calls"), str(tmp_path / "answers")
    os.mkdir(calls)
    rows = [(f"r{i // 2}", i % 2, str(i)) for i in range(60)]
    sent = spark.createDataFrame(rows, "run_id string, part int, payload string")
    with pytest.raises(Exception, match="killed|SystemExit|crashed"):
        judging.resumable_batch(sent, scorer_of(calls, stop="41"), folder, tasks=30)
    before = asked(calls)
    ended = judging.stored_answers(spark, folder).select("run_id", "part").collect()
    assert 0 < len(ended) < 60  # tasks that ended are kept though the job failed
    states = judging.resumable_batch(sent, scorer_of(calls), folder, tasks=30).collect()
    after = asked(calls)
    number = {(run, part): payload for run, part, payload in rows}
    assert len(states) == 60
    for r in states:
        n = number[r["run_id"], r["part"]]
        bad = int(n) % 10 in (3, 7)
        assert (r["valid"], r["tries"]) == (not bad, 3 if bad else 1)
        assert (r["error"] == "no answer") == (int(n) % 10 == 7)
        if not bad:
            assert json.loads(r["answer"])["root_cause_step_index"] == int(n)
    for run, part in ended:
        n = number[run, part]
        assert after[n] == (3 if int(n) % 10 in (3, 7) else 1)
    assert sum(after.values()) <= 60 + 2 * 12 + sum(before.values()) - len(ended)
    again = judging.resumable_batch(sent, scorer_of(calls), folder, tasks=30)
    assert again.count() == 60 and asked(calls) == after


def test_an_answer_left_twice_counts_once(spark, tmp_path):
    folder = str(tmp_path / "answers")
    rows = [("r", 0, '{"root_cause_error_type": "b"}', None, 1), ("r", 0, '{"root_cause_error_type": "a"}', None, 1)]
    schema = "run_id string, part long, answer string, error string, attempt int"
    spark.createDataFrame(rows, schema).write.parquet(folder)
    (one,) = judging.stored_answers(spark, folder).collect()
    assert one["answer"] == '{"root_cause_error_type": "a"}'
    none = spark.createDataFrame([], "run_id string, payload string")
    assert judging.resumable_batch(none, lambda p: None, str(tmp_path / "other")).count() == 0


def test_own_rule_for_invalid_answers(spark, tmp_path):
    """Memory cannot fail at the first step: such an answer is asked for again."""
    sent = spark.createDataFrame([("a", "1"), ("b", "2")], "run_id string, payload string")

    def scorer(payload):
        return {"critical_step": int(payload), "critical_module": "memory"}

    def bad(answer):
        field = lambda n: F.get_json_object(answer, f"$.{n}")
        return (field("critical_step") == "1") & field("critical_module").isin("memory", "reflection")

    got = judging.resumable_batch(sent, scorer, str(tmp_path / "answers"), invalid=bad).collect()
    assert sorted((r["run_id"], r["tries"], r["valid"]) for r in got) == [("a", 3, False), ("b", 1, True)]


def test_arguments_are_cut_one_by_one(spark):
    args = json.dumps({"a": "x" * 200, "b": "y" * 150, "c": None, "d": {"e": [1, 2]}, "f": 7})
    rows = [("r", 0, args), ("r", 1, "no json " + "z" * 200), ("r", 2, None), ("r", 3, "{}")]
    steps = spark.createDataFrame(rows, "run_id string, step_index int, args_key string").select(
        "*", *[F.lit("").alias(c) for c in ("reasoning", "action_name", "tool_response")]
    )
    got = {r["step_index"]: json.loads(r["action_args"]) for r in judging.payload_steps(steps).collect()}
    assert got[0] == {
        "a": "x" * 150 + "...[TRUNCATED, 200 chars total]", "b": "y" * 150, "c": "None", "d": '{"e":[1,2]}', "f": "7",
    }
    assert list(got[1]) == ["args"] and got[1]["args"].startswith("no json z") and "208 chars" in got[1]["args"]
    assert got[2] == {"args": ""} and got[3] == {}
    full = {r["step_index"]: json.loads(r["action_args"]) for r in judging.payload_steps(steps, full=True).collect()}
    assert full[0]["a"] == "x" * 200
