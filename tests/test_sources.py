import json
import tempfile

import pytest
from pyspark.sql import functions as F

from stepscope.operators import deltas, mining, pairing, vectors
from stepscope.sources import records, runs as source

META = {"run_id": "r1", "task_id": "t", "trial_number": 1, "final_status": "fail"}
STEPS = {"steps": [{"step_index": 0, "reasoning": "x", "action_name": "go", "action_args": {"b": 1, "a": 2}, "tool_response": "ok"}]}


def folder():
    return tempfile.mkdtemp(prefix="stepscope-src-")


def write(path, value):
    with open(path, "w", encoding="utf-8") as out:
        out.write(value if isinstance(value, str) else json.dumps(value))


def test_tree_and_consolidated_have_one_shape(spark):
    import os

    tree = folder()
    for name, meta in (("a", META), ("b", "{broken"), ("c", {"run_id": "r3"})):
        os.makedirs(f"{tree}/{name}")
        write(f"{tree}/{name}/run_metadata.json", meta)
        write(f"{tree}/{name}/trajectory.json", STEPS)
    got = source.read_runs(spark, tree)
    assert source.valid_runs(got).count() == 1 and source.rejected_runs(got).count() == 2
    one = f"{folder()}/all.json"
    items = [{"metadata": META, "trajectory": STEPS}, "text", {"x": 1}, {"metadata": {"run_id": "q"}}]
    write(one, {"runs": items})
    flat = source.read_runs(spark, one)
    assert flat.columns == got.columns
    reasons = [r.reject_reason for r in source.rejected_runs(flat).orderBy("item_index").collect()]
    assert reasons == ["item is not an object", "item missing 'metadata' key",
                       "missing required keys: task_id, trial_number, final_status"]
    step = source.run_steps(flat).first()
    assert (step.run_id, step.step_index, step.args_key) == ("r1", 0, '{"a":2,"b":1}')
    single = f"{folder()}/one.json"
    write(single, {"metadata": META, "trajectory": STEPS})
    assert source.valid_runs(source.read_runs(spark, single)).first().run_id == "r1"


def test_bad_paths(spark):
    with pytest.raises(FileNotFoundError):
        source.read_runs(spark, "/tmp/no-such-dataset")
    text = f"{folder()}/x.txt"
    write(text, "x")
    with pytest.raises(ValueError, match="unsupported"):
        source.read_runs(spark, text)
    other = f"{folder()}/x.json"
    write(other, {"y": 1})
    with pytest.raises(ValueError, match="neither"):
        source.read_runs(spark, other)


def test_judgments_first_file_wins(spark):
    place = folder()
    write(f"{place}/1.json", {"judgments": {"a": {"root_cause_error_type": "other"}}})
    write(f"{place}/2.json", {"judgments": {"a": {"root_cause_error_type": "memory_error"},
                                            "b": {"root_cause_error_type": "planning_error"}}})
    merged, missing = records.read_judgments(spark, [f"{place}/1.json", f"{place}/0.json", f"{place}/2.json"])
    assert {r.run_id: r.root_cause_error_type for r in merged.collect()} == {"a": "other", "b": "planning_error"}
    assert missing == [f"{place}/0.json"]


def test_patterns_tags_logs(spark):
    assert records.read_patterns(spark, "/tmp/no-such-patterns").count() == 0
    place = folder()
    write(f"{place}/p.json", {"patterns": [
        {"pattern_id": "p1", "category": "other", "trigger_description": "x"},
        {"pattern_id": "p2", "category": "made_up", "trigger_description": "y"}]})
    found = records.read_patterns(spark, f"{place}/p.json")
    known, rejected = records.split_patterns(found)
    assert [(r.pattern_id, r.confidence) for r in known.collect()] == [("p1", 1.0)]
    assert [r.pattern_id for r in rejected.collect()] == ["p2"]
    tags = spark.createDataFrame([("t", 1, "other", "n")], "task_id string, trial_number int, tag string, note string")
    records.append_tags(tags, f"{place}/tags")
    runs = spark.createDataFrame([("t", 1, "FAIL"), ("t", 2, "fail"), ("t", 3, "success")],
                                 "task_id string, trial_number int, final_status string")
    left = records.untagged_failures(runs, records.read_tags(spark, f"{place}/tags"))
    assert [r.trial_number for r in left.collect()] == [2]
    records.append_session_log(spark.createDataFrame([("step", "sk-" + "a" * 30)], "type string, body string"), f"{place}/log")
    assert "REDACTED" in spark.read.json(f"{place}/log").first().body


def test_transcript(spark):
    from stepscope.operators import shaping

    place = folder()
    lines = [
        {"type": "USER_INPUT", "source": "USER", "content": "do it", "created_at": "2024-01-01T00:00:00Z"},
        {"type": "PLANNER_RESPONSE", "source": "MODEL", "content": "c", "thinking": "t", "created_at": "2024-01-01T00:00:01Z",
         "tool_calls": [{"name": "ls", "args": {"p": "\"x\""}}, {"name": "cat", "args": "not json"}]},
        {"type": "GENERIC", "source": "MODEL", "content": "out1"},
        {"type": "GENERIC", "source": "MODEL", "content": "out2"},
        {"type": "PLANNER_RESPONSE", "source": "MODEL", "content": "bye"},
        {"type": "GENERIC", "source": "USER", "content": "not an answer"},
    ]
    write(f"{place}/session1.jsonl", "\n".join(json.dumps(l) for l in lines[:3]) + "\n\nbad line\n" + "\n".join(json.dumps(l) for l in lines[3:]))
    got = shaping.transcript_to_steps(records.read_transcript(spark, place)).orderBy("step_index").collect()
    assert [(r.run_id, r.action_name, r.tool_response, r.reasoning) for r in got] == [
        ("session1", "ls", "out1", "t\n\nc"), ("session1", "cat", "out2", ""), ("session1", "done", None, "bye")]
    assert got[0].action_args == {"p": "x"} and got[1].action_args == {"raw": "not json"}


def test_chunks(spark):
    chunk = lambda delta, reason=None: "data: " + json.dumps({"choices": [{"delta": delta, "finish_reason": reason}]})
    lines = [chunk({"content": "Hello "}), ": ping", chunk({"content": "world"}), chunk({}, "stop"), "data: [DONE]",
             chunk({"tool_calls": [{"index": 0, "id": "c1", "function": {"name": "ls", "arguments": "{\"a\""}}]}),
             chunk({"tool_calls": [{"index": 0, "function": {"arguments": ":1}"}}]})]
    frame = spark.createDataFrame([("s", "r", i, l) for i, l in enumerate(lines)],
                                  "session_id string, response_id string, seq int, line string")
    parsed = deltas.parse_chunks(frame)
    message = deltas.assemble_deltas(parsed).first()
    assert (message.content, message.finish_reason) == ("Hello world", "stop")
    call = deltas.assemble_tool_calls(parsed).first()
    assert (call.call_id, call.name, call.arguments) == ("c1", "ls", '{"a":1}')


def test_pairing(spark):
    calls = spark.createDataFrame(
        [("s", 1, "a", "ls", "{}", "ra"), ("s", 2, "b", "cat", "{}", "rb"), ("s", 5, "c", "rm", "{}", "rc")],
        "session_id string, call_seq long, call_id string, name string, args string, reasoning string")
    results = spark.createDataFrame(
        [("s", 3, "a", "", "A"), ("s", 4, "zz", "", "B"), ("s", 6, "a", "", "again"), ("s", 7, "c", "", "C"),
         ("s", 8, "yy", "named", "D")],
        "session_id string, result_seq long, call_id string, name string, content string")
    got = [(r.action_name, r.tool_response, r.paired_by) for r in
           pairing.pair_tool_calls(calls, results).orderBy("step_index").collect()]
    assert got == [("ls", "A", "id"), ("cat", "B", "recent"), ("rm", "C", "id"), ("named", "D", "none")]


def brute_clusters(texts, threshold):
    """The ordered clustering in plain loops, for small inputs."""
    import math
    import re

    from stepscope import taxonomy as tx

    docs = [[w for w in re.findall(r"[a-z0-9_]+", t.lower()) if len(w) > 1 and w not in tx.STOPWORDS] for t in texts]
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    vecs = []
    for d in docs:
        raw = {w: d.count(w) / len(d) * (math.log((len(docs) + 1) / (df[w] + 1)) + 1) for w in d}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1
        vecs.append({w: x / norm for w, x in raw.items()})
    sums, out = [], []
    for v in vecs:
        sims = []
        for s in sums:
            norm = math.sqrt(sum(x * x for x in s.values())) or 1
            sims.append(round(sum(x * s.get(w, 0) for w, x in v.items()) / norm, 12))
        best = max(range(len(sims)), key=lambda i: (sims[i], -i), default=-1)
        if best < 0 or sims[best] < threshold:
            best = len(sums)
            sums.append({})
        for w, x in v.items():
            sums[best][w] = sums[best].get(w, 0) + x
        out.append(best)
    return out


def test_leader_clusters_equal_brute_force_in_any_slices(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40).collect()
    texts = [" ".join(d.text.split()[:60]) for d in docs]
    rows = [("a", i, t) for i, t in enumerate(texts)] + [("b", i + 100, t) for i, t in enumerate(texts[:12])]
    frame = spark.createDataFrame(rows, "category string, doc_id long, text string")
    want = {("a", i): c for i, c in enumerate(brute_clusters(texts, 0.2))}
    want |= {("b", i + 100): c for i, c in enumerate(brute_clusters(texts[:12], 0.2))}
    for slice_rows in (1000, 9):
        got = mining.leader_cluster(frame, 0.2, slice_rows)
        assert {(r.category, r.doc_id): r.cluster for r in got.collect()} == want
    sizes = [c for (k, _), c in want.items() if k == "a"]
    assert 1 < len(set(sizes)) < 40


def test_advice(spark):
    members = spark.createDataFrame(
        [("c", 0, "r1", "Agent ignored the color filter. It should verify the color first."),
         ("c", 0, "r2", "The filter was lost; the agent must check the cart before paying."),
         ("c", 0, "r3", "Nothing else.")], "category string, cluster int, doc_id string, text string")
    chosen = spark.createDataFrame([("c", 0, "r1")], "category string, cluster int, medoid string")
    got = mining.corrective_text(members, chosen).first()
    assert got.trigger_description == "ignored the color filter"
    assert got.safe_alternative == "must check the cart before paying" and got.has_corrective


def test_nearest_pattern_thresholds(spark):
    docs = spark.createDataFrame([(1, "red shoes wrong size"), (2, "blue hat")], "doc_id int, text string")
    patterns = spark.createDataFrame(
        [(0, "p0", "planning_error", "wrong size shoes", "check size", 0.0), (1, "p1", "other", "banana", "", 1.0)],
        "pattern_no int, pattern_id string, category string, trigger_description string, safe_alternative string, confidence double")
    corpus = docs.select("text").unionByName(patterns.select(F.col("trigger_description").alias("text")))
    got = vectors.nearest_pattern(docs, patterns, vectors.idf_table(corpus)).collect()
    assert [(r.doc_id, r.match.pattern_id) for r in got] == [(1, "p0")]
    assert 0.5 < got[0].match.confidence <= 0.95
