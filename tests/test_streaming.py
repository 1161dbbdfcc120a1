import tempfile

from pyspark.sql import functions as F

from stepscope.catalog import inputs
from stepscope.config import Settings
from stepscope.operators import detectors
from stepscope.streaming import guard

COLUMNS = (
    "session_id string, seq long, ts timestamp, hook_event_name string, prompt string, "
    "plan string, tool_name string, tool_input string, tool_response string"
)


def session_events(spark, sf):
    """The batch steps as a live session: a prompt, then one event per step, then a stop."""
    steps = inputs.steps(spark, sf)
    prompt = steps.groupBy("run_id").agg(F.min("timestamp").alias("t")).select(
        F.col("run_id").cast("string").alias("session_id"), F.lit(0).cast("long").alias("seq"),
        F.timestamp_seconds("t").alias("ts"), F.lit("UserPromptSubmit").alias("hook_event_name"),
        F.lit("finish the purchase").alias("prompt"), F.lit(inputs.plan_text()).alias("plan"),
        F.lit("").alias("tool_name"), F.lit("").alias("tool_input"), F.lit("").alias("tool_response"),
    )
    calls = steps.select(
        F.col("run_id").cast("string").alias("session_id"),
        (F.col("step_index") + 1).cast("long").alias("seq"),
        F.timestamp_seconds("timestamp").alias("ts"), F.lit("PostToolUse").alias("hook_event_name"),
        F.lit("").alias("prompt"), F.lit("").alias("plan"), F.col("action_name").alias("tool_name"),
        F.col("args_key").alias("tool_input"), "tool_response",
    )
    stop = steps.groupBy("run_id").agg(F.max("timestamp").alias("t"), F.count("*").alias("n")).select(
        F.col("run_id").cast("string").alias("session_id"), (F.col("n") + 1).alias("seq"),
        F.timestamp_seconds("t").alias("ts"), F.lit("Stop").alias("hook_event_name"),
        *[F.lit("").alias(c) for c in ("prompt", "plan", "tool_name", "tool_input", "tool_response")],
    )
    return prompt.unionByName(calls).unionByName(stop)


def run_stream(spark, events, settings, files=1, **options):
    src, out, chk = (tempfile.mkdtemp(prefix="stepscope-stream-") for _ in range(3))
    events.coalesce(files).write.mode("overwrite").json(src)
    stream = spark.readStream.schema(COLUMNS).json(src)
    judged = guard.stream_guard(stream, settings, **options)
    query = (
        judged.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", chk).outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.read.parquet(out)


def test_live_equals_batch(spark, sf):
    settings = Settings(max_subgoal_steps=3)
    events = session_events(spark, sf)
    live = run_stream(
        spark, events, settings, phrase="error", keys=["action_name"], watermark="60 days"
    )
    steps = inputs.stored_steps(spark, sf)
    batch = detectors.check_steps(
        steps, inputs.plans(spark, sf), settings, keys=["action_name"], phrase="error",
        use_task=False,
    )
    seen = live.where("kind = 'step'")
    assert seen.count() == batch.count() > 0
    columns = ["warning", "category", "confidence", "flagged"]
    both = batch.select(
        F.col("run_id").cast("string").alias("session_id"), "step_index",
        *[F.col(c).alias("b_" + c) for c in columns],
    ).join(seen, ["session_id", "step_index"])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col("b_" + c))
    assert both.count() == batch.count()
    assert both.where(differs).count() == 0
    assert live.where("kind = 'summary'").count() == steps.select("run_id").distinct().count()


def test_block_late_and_idle(spark):
    rows = [
        ("s", 0, "2024-01-01 00:00:00", "UserPromptSubmit", "Fix the failing build please", "", "", "", ""),
    ]
    for i in range(1, 4):
        rows.append(("s", i, f"2024-01-01 00:00:0{i}", "PostToolUse", "", "", "bash", '{"c": "make"}', "Error: failed"))
    rows.append(("s", 4, "2024-01-01 00:00:05", "PreToolUse", "", "", "bash", '{"c":"make"}', ""))
    rows.append(("s", 5, "2024-01-01 00:00:06", "PreToolUse", "", "", "bash", '{"c":"test"}', ""))
    rows.append(("other", 1, "2024-01-01 03:00:00", "PreToolUse", "", "", "bash", "{}", ""))
    frame = spark.createDataFrame(
        rows, "session_id string, seq long, t string, hook_event_name string, prompt string, plan string,"
        "tool_name string, tool_input string, tool_response string",
    ).withColumn("ts", F.to_timestamp("t")).drop("t")
    live = run_stream(spark, frame, Settings(), watermark="0 seconds")
    kinds = {(r.kind, r.seq) for r in live.where("session_id = 's'").collect()}
    assert ("block", 4) in kinds and ("allow", 5) in kinds
    # Nobody stopped the session; the idle timer summed it up.
    assert live.where("session_id = 's' and kind = 'summary'").count() == 1


def test_live_knows_the_task_and_the_reasoning(spark, monkeypatch):
    """A live step is judged like the same step of a batch with tasks and reasoning."""
    monkeypatch.setitem(globals(), "COLUMNS", COLUMNS + ", reasoning string")
    plan = "1. search the shop\n2. buy the shoes\n3. close the order"
    told = {
        "a": "Buy running shoes for men under 50 dollars", "b": "find a cheap direct flight for women",
        "c": "Search the web for news of today", "d": "Compare men and women in sports, boys too",
    }
    calls = [
        ("search_items", '{"query":"women running shoes"}', "", "ok"), ("search_items", '{"query":"find running shoes"}', "", "ok"),
        ("search_items", '{"query":"expensive layover women"}', "", "ok"), ("click", '{"id":"women find"}', "", "ok"),
        ("open_page", '{"id":1}', "nothing happens, malformed action", "ok"), ("search_items", '{"query":"find girls"}', "malformed action: nothing happens", "HTTP 404"),
        ("Search", '{"query":"find shoes"}', "", "HTTP 404 from the api"), ("search_items", '{"query":"men"}', None, "ok"),
    ]
    names = COLUMNS.replace("ts timestamp", "ts string")
    events = [(s, 0, "2024-01-01 00:00:00", "UserPromptSubmit", task, plan, "", "", "", None) for s, task in told.items()]
    events += [
        (s, i + 1, f"2024-01-01 00:00:{i + 1:02d}", "PostToolUse", "", "", name, args, response, why)
        for s in told for i, (name, args, why, response) in enumerate(calls)
    ]
    live = run_stream(
        spark, spark.createDataFrame(events, names).withColumn("ts", F.to_timestamp("ts")), Settings()
    ).where("kind = 'step'")
    steps = spark.createDataFrame(
        [(s, i, float(i), why or "", name, args, response) for s in told for i, (name, args, why, response) in enumerate(calls)],
        "run_id string, step_index int, timestamp double, reasoning string, action_name string, args_key string, tool_response string",
    )
    plans = spark.createDataFrame([(s, t, plan) for s, t in told.items()], "run_id string, task_description string, proposed_plan string")
    batch = detectors.check_steps(steps, plans, Settings())
    shown = ["warning", "category", "confidence", "flagged", "suggestions"]
    read = lambda frame, key: {(r[key], r["step_index"]): [r[c] for c in shown] for r in frame.collect()}
    got, want = read(live, "session_id"), read(batch, "run_id")
    assert got == want and len(got) == len(told) * len(calls)
    said = " ".join(str(v[0]) for v in got.values())
    for rule in ("planning_contradiction", "planning_constraint_omission", "tool_use_malformed_action"):
        assert rule in said


def test_a_session_costs_few_state_calls(spark):
    """A session's events come as rows of few columns, and its timer is known without a search."""
    calls = []

    class Handle:
        body = None

        def getValueState(self, *_):
            return self

        def get(self):
            calls.append("get")
            return self.body

        def update(self, body):
            calls.append("update")
            self.body = body

        def __getattr__(self, name):
            return lambda *_: calls.append(name) or []

    rows = [("s", i, f"2024-01-01 00:00:0{i}", "PostToolUse", "", "", "bash", '{"c": 1}', "Error: failed") for i in (3, 1, 2)]
    events = spark.createDataFrame(rows, COLUMNS.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
    ready = guard.packed(guard.prepare(events))
    assert ready.columns == ["session_id", "ts", "body"]
    judge = guard.SessionGuard(cap=3, idle_seconds=30)
    judge.init(Handle())
    batch = ready.collect()
    first = list(judge.handleInputRows(("s",), iter(batch), None))
    assert [(r.kind, r.seq, r.step_index, r.failed_repeats) for r in first] == [("step", i + 1, i, i) for i in range(3)]
    assert sorted(calls) == ["get", "registerTimer", "update"]
    again = list(judge.handleInputRows(("s",), iter(batch), None))
    assert [r.kind for r in again] == ["late"] * 3
    assert "listTimers" not in calls and "exists" not in calls
