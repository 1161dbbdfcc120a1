import json
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stepscope.functions import text as tt
from stepscope.operators import deltas, detectors, judging, pairing, shaping
from stepscope.operators.edits import extract_text_edits, path_before
from stepscope.plans import checks, parsing, tracking


def values(spark, rows, expr):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[0] for r in frame.orderBy("i").select(expr(F.col("s"))).collect()]


@pytest.mark.parametrize(
    "plan, count, way",
    [
        ("1. Open the door\n2. Take the key\n3. Leave the room", 3, "numbered"),
        ("Step 1: Open it\nStep 2: Take it", 2, "numbered"),
        ("- open the door\n- take the key\n- leave", 3, "bullets"),
        ("First, open the door. Then take the key. Finally leave the room.", 3, "transition"),
        ("open the front door\ntake the silver key", 2, "lines"),
        ("Just do the whole task at once", 1, "single"),
        ("", 1, "single"),
    ],
)
def test_plan_strategies(spark, plan, count, way):
    got = values(spark, [plan], parsing.plan_items)[0]
    assert (len(got["items"]), got["strategy"], got["is_fallback"]) == (count, way, way == "single")


HEAD = r"(?:Step\s*\d+|Subgoal\s*\d+|Phase\s*\d+|\d+)[.:)]"
NUMBERED = re.compile(rf"(?:^|\n)\s*{HEAD}\s*(.+?)(?=\n\s*{HEAD}|\n\s*[-*]|\Z)", re.I | re.S)
BULLETS = re.compile(r"(?:^|\n)\s*[-*]\s*(.+?)(?=\n\s*[-*]|\n\s*(?:Step|Subgoal|Phase|\d+)[.:)]|\Z)", re.S)
LATER = "Second|Third|Fourth|Fifth|Then|Next|Finally"
MOVES = re.compile(rf"\b(First|{LATER})\b[,:\s]+(.+?)(?=\b(?:{LATER})\b|\Z)", re.I)


def brute_plan(text):
    """(strategy, items) of a plan by plain loops."""
    text = (text or "").strip()
    found = [
        ("numbered", [m for m in NUMBERED.findall(text)]),
        ("bullets", [m for m in BULLETS.findall(text)]),
        ("transition", [f"{w} {d}" for w, d in MOVES.findall(text) if d.strip()]),
        ("lines", [s.strip() for s in text.splitlines() if len(s.strip()) > 10]),
    ]
    for way, items in found:
        if way != "lines":
            items = [m.strip().replace("\n", " ") for m in items if m.strip()]
        if len(items) >= 2:
            return way, [m[:200] for m in items]
    return "single", ["Execute task: " + text[:200].replace("\n", " ") if text else "Execute full task (default single-subgoal fallback)"]


def test_whole_texts_by_every_strategy(spark, sf, tmp_path):
    own = [
        "1. Öffne die Tür\n2) nimm den Schlüssel\n\n 3: geh", "Phase 1: look\nPHASE 2. act now", "\u00a01.\u00a0one\n\u20032.\u2003two",
        "- á la carte\n* zwei, 2.5 km\n- drei", "1. only one\n- first thing\n- second thing", "First, go é. then: come! Finally leave 3 of 4",
        "éthen, a next: b\u00a0then\u00a0c", "next\x1cone then\x1ftwo", "ein langer Satz, 12 Wörter\r\nnoch ein langer Satz", "a line of text here\u2028another line of text",
        "a line of text here\x85another line of text", "kurz", "", None, " \u3000\n", "x" * 300 + "\n" + "é" * 500, "1. " + "wort " * 50_000 + "\n2. end",
    ]
    read = spark.read.parquet(f"{sf}/documents.parquet")
    docs = read.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(own)], "doc_id long, text string"), True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for r in docs.collect():
        way, items = brute_plan(r["text"])
        want |= {(r["doc_id"], k): (f"subgoal_{k + 1:03d}", m, way == "single", way) for k, m in enumerate(items)}
    got = entry.queries()["f1_parse_plan_texts"](spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["subgoal_id"], r["description"], r["is_fallback"], r["strategy"]) == want[r["run_id"], r["subgoal_no"]]
    assert {r["strategy"] for r in got} == {"numbered", "bullets", "transition", "lines", "single"}


def test_failure_words(spark):
    benign = ["0 errors found", "no error", "error: none.", "errors: 0.", "done without error", ""]
    assert values(spark, benign, tt.failure_term) == [None] * len(benign)
    real = ["Error: failed", "Nothing happens", "cannot find it", "Invalid action", "2 errors", "a failure"]
    assert None not in values(spark, real, tt.failure_term)


def test_success_found(spark):
    texts = ["item found", "nothing found", "0 results found", "You open the box", "foundation laid"]
    assert values(spark, texts, tt.success_phrase) == ["found", None, None, "you open", None]


def test_keyword_rules(spark):
    texts = ["nothing happens, malformed action", "all fine", "HTTP 404 from the api", "one by one"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = [r.m for r in tt.add_keyword_rule(frame, "m", "s").orderBy("i").collect()]
    assert [m and m.rule_id for m in got] == [
        "tool_use_malformed_action", None, "external_env_error", "planning_exhaustive_search",
    ]
    assert got[0].confidence == 0.5


def test_redaction(spark):
    key = "sk-" + "a1B2" * 8
    texts = [f"use {key} now", "Bearer " + "x" * 24, 'api_key = "' + "k" * 30 + '"', "plain text"]
    got = values(spark, texts, tt.redact)
    assert got[0] == "use sk-***REDACTED*** now" and got[3] == "plain text"
    assert all("REDACTED" in g for g in got[:3]) and "kkkk" not in got[2]
    frame = spark.createDataFrame([([{"a": key}],)], "x array<map<string,string>>")
    assert key not in str(tt.redact_frame(frame).collect())
    assert values(spark, got, tt.redact) == got


def test_assistant_message(spark):
    rows = [
        "think <action>go[kitchen]</action>", "Because. Action: search red shoes",
        "Thought: hmm", "averyveryverylongsinglewordhere x",
    ]
    got = values(spark, rows, shaping.assistant_parts)
    assert tuple(got[0]) == ("think", "go", "query", "kitchen")
    assert tuple(got[1]) == ("Because.", "search", "target", "red shoes")
    assert got[2]["reasoning"] == "Thought: hmm" and got[2]["action_name"] == "thought:"
    assert got[3]["action_name"] == "react_action"


def test_plan_against_task(spark):
    frame = spark.createDataFrame(
        [("Buy mens shoes", "search womens shoes"), ("Buy mens shoes", "search shoes"), ("Buy shoes", "search shoes")],
        "t string, p string",
    )
    got = frame.select(
        checks.plan_contradiction(F.col("t"), F.col("p")).alias("c"),
        checks.constraint_omission(F.col("t"), F.col("p")).alias("o"),
    ).collect()
    assert got[0].c.confidence == 0.92 and got[1].c is None
    assert got[1].o.confidence == 0.85 and got[2].o is None


def test_path_scoring(spark):
    rows = [
        "Here is app.py:", "I will rename old.py to `new_version.py`:", "See section 1.5 e.g. this",
        "import os.path", "### `src/main.rs`",
    ]
    got = values(spark, rows, path_before)
    assert got == ["app.py", "new_version.py", None, None, "src/main.rs"]


def test_edit_formats(spark):
    block = "<<<<<<< SEARCH\nold\n=======\nnew\n>>>>>>> REPLACE\n"
    texts = [
        f"In file app.py:\n{block}and again\n{block}",
        "--- a/x.py\n+++ b/y.py\n@@ -1 +1 @@\n-a\n+b",
        "main.go\n```go\npackage main\n```",
        "nothing to do",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [(r.i, r.path, r.format, r.search, r.replace) for r in
           extract_text_edits(frame, ["i"]).orderBy("i", "edit_no").collect()]
    assert got[0] == (0, "app.py", "diff", "old", "new") and got[1][1] == "app.py"
    assert got[2][:3] == (1, "y.py", "udiff") and got[3][:3] == (2, "main.go", "whole")
    assert len(got) == 4


def test_parse_judgment(spark):
    rows = [
        '{"critical_step": 3, "critical_module": "planning", "error_type": "inefficient_plan"}',
        'Sure:\n```json\n{"critical_step": 2, "critical_module": "action", "error_type": "format_error",}\n```',
        "{'error_type': 'hallucination', 'error_detected': True, 'critical_module': None}",
        'error_type: step_limit, critical_step: 4, critical_module: system',
        "no idea",
    ]
    got = values(spark, rows, judging.parse_judgment)
    assert [g.parse_stage for g in got] == ["json", "trailing_comma", "literal", "salvaged", "parse_error"]
    assert [g.critical_step for g in got] == [3, 2, 1, 4, 1]
    assert got[2].error_detected and got[3].confidence == 0.3


def test_parse_judgment_of_any_length_and_depth(spark):
    long, deep = "word " * 20_000, "{" * 40 + "}" * 40
    effects = '{"a":' * 8 + "1" + "}" * 8
    rows = [
        f'{{"error_type": "misalignment", "evidence": "{long}", "cascading_effects": [{effects}]}}',
        f'{deep} then {{ never closed {{"error_type": "step_limit", "correction_guidance": "wait"}}',
        "}" * 1000 + "{" * 1000,
    ]
    got = values(spark, rows, judging.parse_judgment)
    assert [g.parse_stage for g in got] == ["json", "json", "parse_error"]
    assert got[0].evidence == long and got[0].cascading_effects.count("{") == 8
    assert got[1].correction_guidance == "wait" and got[1].root_cause == "No root cause identified"


def test_one_judgment_for_a_long_run(spark):
    steps = spark.range(3000).selectExpr(
        "'r' AS run_id", "CAST(id AS INT) AS step_index", "'' AS reasoning", "'look' AS action_name",
        "'{}' AS args_key", "'an error' AS tool_response",
    )
    sent = judging.judge_payloads(steps)
    assert sent.count() == 3

    def scorer(payload):
        first = json.loads(payload)["steps"][0]["step_index"]
        return {"root_cause_error_type": "other", "root_cause_step_index": first, "confidence": 0.5 + first / 10_000}

    got = judging.one_judgment(judging.valid_answers(judging.judge_batch(sent, scorer))).collect()
    assert [(r.run_id, r.root_cause_step_index) for r in got] == [("r", 2048)]


def test_scorer_is_asked_again(spark):
    calls = []

    def scorer(payload):
        calls.append(payload)
        if len(calls) < 3:
            raise ValueError("busy")
        return {"root_cause_error_type": "other"}

    sent = spark.createDataFrame([("r", "{}")], "run_id string, payload string").coalesce(1)
    assert judging.judge_batch(sent, scorer, attempts=2).first().error == "busy"
    assert judging.judge_batch(sent, scorer, attempts=3).first().error is None


def test_messages_of_many_chunks(spark):
    rows = [("s", "r", i, f"{i},", f"t{i}" if i % 2 else None, "length" if i == 4 else None) for i in range(10)]
    frame = spark.createDataFrame(rows, "session_id string, response_id string, seq long, content string, reasoning string, finish_reason string")
    (got,) = deltas.assemble_deltas(frame, part=3).collect()
    assert got.content == "".join(f"{i}," for i in range(10)) and got.reasoning_content == "t1t3t5t7t9"
    assert (got.finish_reason, got.n_chunks) == ("length", 10)


def test_results_without_id_go_by_name(spark):
    calls = spark.createDataFrame(
        [("s", 1, "", "look", "{}", "")], "session_id string, call_seq long, call_id string, name string, args string, reasoning string")
    results = spark.createDataFrame(
        [("s", 2, None, "look", "seen"), ("s", 3, "", "", "lost")],
        "session_id string, result_seq long, call_id string, name string, content string")
    (got,) = pairing.pair_tool_calls(calls, results).collect()
    assert (got.action_name, got.tool_response, got.paired_by) == ("look", "seen", "recent")
    assert [r.content for r in pairing.rejected_results(results).collect()] == ["lost"]


def test_idle_stretches_of_a_busy_session(spark):
    from stepscope.streaming import windows

    rows = spark.range(2000).selectExpr("'s' AS session_id", "timestamp_seconds(id % 7 + IF(id % 2 = 0, 0, 100)) AS ts")
    got = windows.idle_sessions(rows, gap="30 seconds").orderBy("start").collect()
    assert [r.n_events for r in got] == [1000, 1000]
    assert [r.end.timestamp() - r.start.timestamp() for r in got] == [36.0, 36.0]


def test_step_cap_and_boundaries(spark):
    steps = spark.createDataFrame(
        [("r", i, "", "look", "{}", "quiet") for i in range(25)],
        "run_id string, step_index int, reasoning string, action_name string, args_key string, tool_response string",
    )
    plans = spark.createDataFrame(
        [("r", "t", "1. alpha beta\n2. gamma delta\n3. omega")],
        "run_id string, task_description string, proposed_plan string",
    )
    ended = tracking.transitions(tracking.track(steps, plans, 10)).orderBy("step_index").collect()
    assert [(r.step_index, r.completed_status) for r in ended] == [
        (9, "stalled_advanced"), (19, "stalled_advanced")]
    host = spark.createDataFrame(
        [("r", "subgoal_001", "completed", 4), ("r", "subgoal_001", "completed", 5)],
        "run_id string, subgoal_id string, status string, step_index int",
    )
    tracked = tracking.track(steps, plans, 10, host)
    ended = tracking.transitions(tracked).orderBy("step_index").collect()
    # The second update of the same subgoal does not count again.
    assert [(r.step_index, r.completed_subgoal_id) for r in ended] == [
        (4, "subgoal_001"), (13, "subgoal_002"), (23, "subgoal_003")]
    total = tracking.finalize(tracked).first()
    assert total.completed_count + total.stalled_advanced_count + total.failed_count + total.abandoned_count == 3


def test_repetition_then_http_error(spark):
    rows = [("r", i, "", "open door", "{}", "quiet") for i in range(4)]
    rows[3] = ("r", 3, "", "open door", "{}", "http 404")
    steps = spark.createDataFrame(
        rows, "run_id string, step_index int, reasoning string, action_name string, args_key string, tool_response string")
    got = {r.step_index: r.match.rule_id for r in
           detectors.match_steps(steps).where("match is not null").collect()}
    assert got == {2: "structural_action_repetition", 3: "structural_action_repetition"}


def test_flatten_and_args(spark):
    got = values(spark, ['[{"type":"text","text":"a"},{"type":"image"},"b"]', "plain"], shaping.flatten_content)
    assert got == ["a\nb", "plain"]
    args = values(spark, ['{"b": 1}', "[1]", "text", None], tt.parse_args)
    assert args == [{"b": "1"}, {"args": "[1]"}, {"raw": "text"}, {}]
    assert values(spark, ['{"b": 1, "a": {"d": 2, "c": 3}}'], tt.canonical_json) == ['{"a":{"c":3,"d":2},"b":1}']


def test_advice_needs_no_shuffle_of_texts(spark):
    """Few clusters: texts stay where they are; words count as whole tokens only."""
    from stepscope.operators import mining

    said = ["Other one. A los-b two! los", "\u017flos x. is los_ y\nLOS\u0130 z. so (Los) end", None, "no word", "Agent los mid"]
    rows = [("a", 0, i, t) for i, t in enumerate(said)]
    members = spark.createDataFrame(rows, "category string, cluster int, doc_id long, text string")
    chosen = spark.createDataFrame([("a", 0, 4)], "category string, cluster int, medoid long")
    made = mining.corrective_text(members, chosen, ["los", "the", "x"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    row = made.first()
    assert row["has_corrective"] and row["safe_alternative"] == "A los-b two"
    for text in said[:2]:
        want = [s for s in spark.sql("select 1").select(mining.sentences(F.lit(text)).alias("s")).first()["s"]]
        flags = spark.createDataFrame([(s,) for s in want], "s string").select(
            mining.is_corrective(F.col("s"), ["los", "the", "x"]).alias("new"),
            F.arrays_overlap(tt.tokens(F.col("s")), F.array(F.lit("los"), F.lit("the"), F.lit("x"))).alias("old"),
        ).collect()
        assert all(r["new"] == r["old"] for r in flags) and any(r["new"] for r in flags)


def test_bare_letters_in_batches(spark):
    """Bytes are dropped as the characters of the pattern are, in the plan query's form."""
    import pyarrow as pa

    from stepscope.catalog import texts

    said = ["a\u00e9b C\tE\n1\u212a \U0001f600z\x00\x7f", "", None, "".join(map(chr, range(1, 0x300)))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(said)], names=["run_id", "proposed_plan"])
    got = next(texts._bare([batch])).column(1).to_pylist()
    assert got == [t and re.sub(texts._BARE, "", t) for t in said]


def test_plan_words_with_letters_that_fold(spark):
    """Words in any case, with the letters that Unicode takes for i, k and s."""
    said = ["F\u0130RST, cut it. THEN wash", "f\u0131r\u017ft: do a next do b", "second, a th\u0117n", "\x1f- a b\n* c d\x85"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "run_id long, proposed_plan string")
    got = frame.select("run_id", parsing.plan_items(F.col("proposed_plan")).alias("p")).collect()
    assert [r["p"]["strategy"] for r in got] == ["transition", "transition", "single", "bullets"]


def test_word_rules_look_closer_at_likely_texts_only(spark):
    """Texts with too few of the words skip the word sets, and none is lost by it."""
    from stepscope import taxonomy as tx
    from stepscope.functions import text as tt

    sets = [words for rule in tx.KEYWORD_RULES for words in rule[3]]
    cover = tt._cover(sets)
    assert all(set(words) & set(cover) for words in sets)
    texts = [" ".join(words).upper() for words in sets] + [words[0] for words in sets] + ["", "click", "error ok"]
    odd = [("r", "t", "d", [("a", "b"), ("c",)]), ("q", "u", "e", [("a",), ()])]
    for rules in (tx.KEYWORD_RULES, odd, odd[:1]):
        frame = spark.createDataFrame([(t,) for t in [*texts, "a", "b", "xcx"]], "t string")
        got = {r.t: r.m and r.m.rule_id for r in tt.add_keyword_rule(frame, "m", "t", rules).collect()}
        for t, rule in got.items():
            hits = [sum(all(w in t.lower() for w in words) for words in r[3]) for r in rules]
            assert rule == (rules[hits.index(max(hits))][0] if max(hits) else None)


def test_a_filter_on_the_verdict_does_not_repeat_it(spark, sf):
    from stepscope import catalog

    plan = catalog.QUERIES["h5_alerts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Slow progress ratio") == 1
