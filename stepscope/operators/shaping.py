"""Chat messages and transcripts reshaped into runs and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepscope import taxonomy as tx
from stepscope.functions import text as tt
from stepscope.operators import ordered


def messages_to_steps(messages: DataFrame, block: int = ordered.BLOCK) -> DataFrame:
    """Each assistant message is a step; a user message right after it is its response.

    messages(run_id, turn, role, text) -> (run_id, step_index, turn, content,
    tool_response, current_input); `current_input` is a user message right before it.
    """
    numbered = ordered.number_rows(messages, "run_id", ["turn"], out="_pos")
    longs = ordered.long_runs(numbered, "run_id", "_pos", block)
    context = ordered.neighbours(
        numbered,
        "run_id",
        "_pos",
        lambda w: {
            "_next_role": F.lead("role").over(w),
            "_next_text": F.lead("text").over(w),
            "_prev_role": F.lag("role").over(w),
            "_prev_text": F.lag("text").over(w),
        },
        back=1,
        ahead=1,
        block=block,
        keep=True,
    )
    counted = ordered.running(
        context,
        "run_id",
        "_pos",
        {"_steps": ("sum", (F.col("role") == "assistant").cast("int"))},
        block=block,
        longs=longs,
    )
    return counted.where(F.col("role") == "assistant").select(
        "run_id",
        (F.col("_steps") - 1).cast("int").alias("step_index"),
        "turn",
        F.col("text").alias("content"),
        F.when(F.col("_next_role") == "user", F.col("_next_text")).alias("tool_response"),
        F.when(F.col("_prev_role") == "user", F.col("_prev_text")).alias("current_input"),
    )


def assistant_parts(content: Column) -> Column:
    """Assistant text as struct(reasoning, action_name, arg_name, arg_value)."""
    text = F.coalesce(content, F.lit(""))
    tag = r"(?is)<action>(.*?)</action>"
    tagged = text.contains("<action>") & text.rlike(tag)
    has_action = ~text.contains("<action>") & text.contains("Action:")
    has_thought = (
        ~text.contains("<action>") & ~text.contains("Action:") & text.contains("Thought:")
    )
    after_action = tt.strip(F.regexp_replace(text, r"(?s)^.*?Action:", ""))
    before_action = tt.strip(F.regexp_replace(text, r"(?s)Action:.*\z", ""))
    after_thought = tt.strip(F.regexp_replace(text, r"(?s)^.*?Thought:", ""))
    reasoning = (
        F.when(tagged, tt.strip(F.regexp_replace(text, tag, "")))
        .when(has_action, F.when(before_action != "", before_action).otherwise(text))
        .when(has_thought, F.concat(F.lit("Thought: "), after_thought))
        .otherwise(text)
    )
    action = (
        F.when(tagged, tt.strip(F.regexp_extract(text, tag, 1)))
        .when(has_action, after_action)
        .otherwise(text)
    )
    bracket = r"(?d)\A([a-zA-Z0-9_\-\s]+)\[(.*)\]\z"

    def finish(act: Column) -> Column:
        bare = tt.strip(act)
        clean = tt.strip(F.regexp_replace(act, r"<[^>]+>", ""))
        first = F.regexp_extract(clean, r"\A(\S+)", 1)
        rest = F.regexp_extract(clean, r"(?s)\A\S+\s+(.*)\z", 1)
        named = bare.rlike(bracket)
        worded = (first != "") & (F.length(first) <= 20)
        return F.struct(
            F.when(named, tt.strip(F.regexp_extract(bare, bracket, 1)))
            .when(worded, F.lower(first))
            .otherwise(F.lit("react_action"))
            .alias("action_name"),
            F.when(named, F.lit("query"))
            .when(worded, F.lit("target"))
            .otherwise(F.lit("command"))
            .alias("arg_name"),
            F.when(named, tt.strip(F.regexp_extract(bare, bracket, 2)))
            .when(worded, F.when(rest != "", rest).otherwise(clean))
            .otherwise(act)
            .alias("arg_value"),
        )

    return tt.let(
        F.struct(reasoning.alias("reasoning"), tt.let(action, finish).alias("a")),
        lambda s: F.struct(
            s["reasoning"].alias("reasoning"),
            s["a"]["action_name"].alias("action_name"),
            s["a"]["arg_name"].alias("arg_name"),
            s["a"]["arg_value"].alias("arg_value"),
        ),
    )


def parse_steps(steps: DataFrame) -> DataFrame:
    """Add reasoning, action_name, action_args and args_key to message steps."""
    parts = F.col("_parts")
    return (
        steps.withColumn("_parts", assistant_parts(F.col("content")))
        .withColumn("reasoning", parts["reasoning"])
        .withColumn("action_name", parts["action_name"])
        .withColumn("action_args", F.create_map(parts["arg_name"], parts["arg_value"]))
        .withColumn("args_key", F.to_json("action_args"))
        .drop("_parts")
    )


def slow_progress(
    messages: DataFrame, last: int = 10, minimum: int = 5, prefix: int = 200
) -> DataFrame:
    """Was a run exploring: over half of its last assistant texts distinct?

    The texts are numbered, and only the last ones of each run are gathered.
    """
    texts = messages.where(F.col("role") == "assistant").select(
        "run_id", "turn", F.substring(F.coalesce("text", F.lit("")), 1, prefix).alias("head")
    )
    counts = texts.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_texts"), F.max("turn").alias("last_turn")
    )
    numbered = ordered.number_rows(texts, "run_id", ["turn"], out="_pos")
    tail = (
        ordered.join_runs(numbered, counts, pos="_pos", how="inner")
        .where(F.col("_pos") >= F.col("n_texts") - last)
        .groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("window_texts"),
            F.size(F.collect_set("head")).alias("distinct_texts"),
        )
    )
    return (
        messages.groupBy("run_id").agg(F.count(F.lit(1)).alias("_m")).drop("_m")
        .join(counts.drop("last_turn"), "run_id", "left")
        .join(tail, "run_id", "left")
        .select(
            "run_id",
            F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
            F.when(F.coalesce("n_texts", F.lit(0)) < minimum, F.lit(True))
            .otherwise(F.col("distinct_texts") / F.col("window_texts") > 0.5)
            .alias("slow_progress"),
        )
    )


def step_error_map(annotations: DataFrame) -> DataFrame:
    """JSON annotations -> (run_id, step, tag); a later annotation of a step wins.

    annotations(run_id, step_annotations)
    """
    parsed = F.from_json("step_annotations", "array<map<string,string>>")
    rows = annotations.select(
        "run_id", F.posexplode(parsed).alias("pos", "note")
    ).where(F.col("note")["step"].isNotNull())
    kinds = F.coalesce(
        *[
            F.when(
                F.json_object_keys(F.try_element_at("note", F.lit(key))).isNotNull(),
                F.struct(
                    F.lit(key).alias("module"),
                    F.coalesce(
                        F.get_json_object(
                            F.try_element_at("note", F.lit(key)), "$.failure_type"
                        ),
                        F.lit(""),
                    ).alias("subtype"),
                ),
            )
            for key in tx.ANNOTATION_KEYS
        ]
    )
    found = rows.select(
        "run_id", "pos", F.col("note")["step"].try_cast("int").alias("step"), kinds.alias("k")
    ).where(F.col("k").isNotNull() & F.col("step").isNotNull())
    tagged = map_taxonomy(
        found.select("run_id", "pos", "step", F.col("k.module"), F.col("k.subtype"))
    )
    return tagged.groupBy("run_id", "step").agg(F.max_by("tag", "pos").alias("tag"))


def normal_module(col: Column) -> Column:
    low = F.lower(tt.strip(col))
    for raw, name in tx.MODULE_SYNONYM.items():
        low = F.when(low == raw, F.lit(name)).otherwise(low)
    return low


def normal_subtype(col: Column) -> Column:
    low = F.lower(tt.strip(col))
    for raw, name in tx.SUBTYPE_SYNONYM.items():
        low = F.when(low == raw, F.lit(name)).otherwise(low)
    return low


def map_taxonomy(df: DataFrame, module: str = "module", subtype: str = "subtype") -> DataFrame:
    """Add `tag` from (module, subtype); unknown pairs and blank subtypes are `other`."""
    dim = (
        tx.module_type_table(df.sparkSession)
        .where(F.col("module") != "others")
        .select(
            F.col("module").alias("_dim_module"),
            F.col("error_type").alias("_dim_subtype"),
            F.col("tag").alias("_dim_tag"),
        )
    )
    return (
        df.join(
            F.broadcast(dim),  # 18 fixed rows
            (normal_module(F.col(module)) == F.col("_dim_module"))
            & (normal_subtype(F.col(subtype)) == F.col("_dim_subtype")),
            "left",
        )
        .withColumn("tag", F.coalesce("_dim_tag", F.lit("other")))
        .drop("_dim_module", "_dim_subtype", "_dim_tag")
    )


def convert_records(records: DataFrame, split: str = "train") -> DataFrame:
    """Benchmark records -> run metadata, one row per record.

    Bad records (no id, no module or no critical step) carry a `reject_reason`.
    """
    module = F.coalesce(
        F.try_element_at("failure_modules", F.lit(1)), F.col("critical_failure_module")
    )
    subtype = F.coalesce(F.try_element_at("failure_types", F.lit(1)), F.lit(""))
    base = records.withColumn("_module", module).withColumn("_subtype", subtype)
    tagged = map_taxonomy(base, "_module", "_subtype")
    missing = tt.strip(F.col("_subtype")) == ""
    messages = F.from_json(
        "full_trajectory", "messages array<struct<role:string,content:string>>"
    )["messages"]
    heads = F.transform(
        F.filter(messages, lambda m: m["role"] == "assistant"),
        lambda m: F.substring(F.coalesce(m["content"], F.lit("")), 1, 200),
    )

    def exploring(h: Column) -> Column:
        window = F.slice(h, F.greatest(F.size(h) - 9, F.lit(1)), F.lit(10))
        return F.when(F.size(h) < 5, F.lit(True)).otherwise(
            F.size(F.array_distinct(window)) / F.size(window) > 0.5
        )

    limit_flag = F.when(
        normal_subtype(F.col("_subtype")) == "step_limit",
        tt.let(F.coalesce(heads, F.array().cast("array<string>")), exploring),
    )
    return tagged.select(
        F.lit("1.0").alias("schema_version"),
        F.col("trajectory_id").alias("run_id"),
        F.col("task_type").alias("task_id"),
        F.lit(1).alias("trial_number"),
        F.lit("fail").alias("final_status"),
        F.col("num_steps").alias("total_steps_taken"),
        F.try_element_at("failure_reasonings", F.lit(1)).alias("grader_notes"),
        F.greatest(F.col("critical_failure_step") - 1, F.lit(0)).alias("root_cause_step_index"),
        F.col("tag").alias("root_cause_error_type"),
        F.when(~missing, F.lit(1.0)).alias("tag_confidence"),
        F.lit("agenterrorbench_import").alias("tag_source"),
        F.lit("agenterrorbench").alias("source_dataset"),
        F.lit(split).alias("source_split"),
        F.col("llm_model").alias("source_llm_model"),
        normal_module(F.col("_module")).alias("original_module"),
        F.nullif(normal_subtype(F.col("_subtype")), F.lit("")).alias("original_subtype"),
        missing.alias("original_subtype_missing"),
        limit_flag.alias("likely_root_cause_was_inefficient_planning"),
        F.when(F.col("trajectory_id").isNull(), F.lit("missing trajectory_id"))
        .when(F.col("_module").isNull(), F.lit("missing failure module"))
        .when(F.col("critical_failure_step").isNull(), F.lit("missing critical_failure_step"))
        .alias("reject_reason"),
    )


def record_steps(records: DataFrame) -> DataFrame:
    """Steps of benchmark records, with the error tag of annotated steps."""
    messages = records.select(
        F.col("trajectory_id").alias("run_id"),
        F.posexplode(
            F.from_json(
                "full_trajectory", "messages array<struct<role:string,content:string>>"
            )["messages"]
        ).alias("turn", "m"),
    ).select("run_id", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"))
    steps = parse_steps(messages_to_steps(messages))
    tags = step_error_map(
        records.select(F.col("trajectory_id").alias("run_id"), "step_annotations")
    ).select(F.col("run_id"), (F.col("step") - 1).alias("step_index"), F.col("tag").alias("error_tag"))
    return steps.join(tags, ["run_id", "step_index"], "left")


def transcript_to_steps(lines: DataFrame, block: int = ordered.BLOCK) -> DataFrame:
    """Transcript lines -> steps.

    lines(run_id, line_no, created_at, type, source, content, thinking, tool_calls).
    Model lines of type GENERIC that directly follow a planner line answer its
    tool calls, by position.
    """
    numbered = ordered.number_rows(lines, "run_id", ["line_no"], out="_pos")
    generic = (F.col("type") == "GENERIC") & (F.col("source") == "MODEL")
    generic = F.coalesce(generic, F.lit(False))
    planner = F.coalesce(
        (F.col("type") == "PLANNER_RESPONSE") & (F.col("source") == "MODEL"), F.lit(False)
    )
    marked = ordered.running(
        numbered,
        "run_id",
        "_pos",
        {
            "_head": ("last", F.when(~generic, F.col("_pos"))),
            "_planned": ("last", F.when(~generic, planner)),
        },
        block=block,
    )
    answers = marked.where(generic & F.col("_planned")).select(
        F.col("run_id").alias("_run"),
        F.col("_head").alias("_turn"),
        (F.col("_pos") - F.col("_head") - 1).alias("_answer"),
        F.coalesce("content", F.lit("")).alias("tool_response"),
    )
    said = tt.strip(F.coalesce("content", F.lit("")))
    thought = tt.strip(F.coalesce("thinking", F.lit("")))
    reasoning = F.when(
        (thought != "") & (said != ""), F.concat(thought, F.lit("\n\n"), said)
    ).otherwise(F.concat(thought, said))
    turns = numbered.where(planner).select(
        "run_id",
        F.col("_pos").alias("turn"),
        tt.iso_epoch(F.col("created_at")).alias("timestamp"),
        reasoning.alias("_reasoning"),
        F.posexplode_outer("tool_calls").alias("_call", "_tool"),
    )
    joined = turns.join(
        answers,
        (F.col("run_id") == F.col("_run"))
        & (F.col("turn") == F.col("_turn"))
        & (F.col("_call") == F.col("_answer")),
        "left",
    ).withColumn("_order", F.col("turn").cast("long"))
    steps = ordered.number_rows(joined, "run_id", ["_order", "_call"])
    unquoted = F.transform_values(
        tt.parse_args(F.col("_tool.args")),
        lambda k, v: F.when(
            (F.length(v) >= 2) & v.startswith('"') & v.endswith('"'),
            F.coalesce(F.try_variant_get(F.try_parse_json(v), "$", "string"), v),
        ).otherwise(v),
    )
    return steps.select(
        "run_id",
        "step_index",
        "turn",
        "timestamp",
        F.when(F.coalesce("_call", F.lit(0)) == 0, F.col("_reasoning"))
        .otherwise("")
        .alias("reasoning"),
        F.when(F.col("_tool").isNotNull(), F.coalesce("_tool.name", F.lit("unknown")))
        .when(F.col("step_index") > 0, F.lit("done"))
        .otherwise(F.lit("none"))
        .alias("action_name"),
        F.when(F.col("_tool").isNotNull(), unquoted)
        .otherwise(F.create_map().cast("map<string,string>"))
        .alias("action_args"),
        "tool_response",
    )


def durations(
    stamps: DataFrame,
    gap_cap: float = 300.0,
    block: int = ordered.BLOCK,
) -> DataFrame:
    """Wall time and active time per run; longer gaps than the cap are idle.

    stamps(run_id, step_index, timestamp)
    """
    stamped = stamps.where(F.col("timestamp").isNotNull())
    dense = ordered.number_rows(
        stamped.withColumn("_at", F.col("step_index").cast("long")), "run_id", ["_at"], out="_pos"
    )
    gaps = ordered.neighbours(
        dense,
        "run_id",
        "_pos",
        lambda w: {"_gap": F.col("timestamp") - F.lag("timestamp").over(w)},
        back=1,
        block=block,
    )
    wall = F.max_by("timestamp", "_pos") - F.min_by("timestamp", "_pos")
    active = F.sum(F.when(F.col("_gap").between(0, gap_cap), F.col("_gap")).otherwise(0.0))
    return gaps.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("stamped_steps"),
        F.when(wall > 0, F.round(wall, 2)).alias("duration_seconds"),
        F.when(F.count(F.lit(1)) >= 2, F.round(active, 2)).alias("active_duration_seconds"),
    )


def task_identity(content: Column, prefix: str = "antigravity:") -> Column:
    """struct(task_id, task_description) of a user request."""
    text = tt.strip(F.coalesce(content, F.lit("")))
    inner = r"(?s)<USER_REQUEST>(.*?)(?:</USER_REQUEST>|<USER_REQUEST>|\z)"
    request = F.when(
        text.contains("<USER_REQUEST>"), tt.strip(F.regexp_extract(text, inner, 1))
    ).otherwise(text)
    flat = tt.strip(F.regexp_replace(F.lower(request), r"(?U)\s+", " "))
    return F.struct(
        F.concat(F.lit(prefix), F.substring(F.sha1(flat), 1, 12)).alias("task_id"),
        F.when(request != "", F.substring(request, 1, 500))
        .otherwise(F.lit("antigravity_session"))
        .alias("task_description"),
    )


def map_termination(reason: Column) -> Column:
    return (
        F.when(reason == "max_steps_exceeded", F.lit("timeout"))
        .when(reason == "error", F.lit("error"))
        .otherwise(F.lit("completed_unverified"))
    )


def to_detector_shape(steps: DataFrame, block: int = ordered.BLOCK) -> DataFrame:
    """Steps as (run_id, step from 1, content with an action tag, response, input)."""
    name = F.coalesce(F.nullif("action_name", F.lit("")), F.lit("none"))
    args = F.col("args_key")
    action = F.when(
        args.isNull() | args.isin("", "{}"), name
    ).otherwise(F.concat(name, F.lit("["), args, F.lit("]")))
    shaped = ordered.neighbours(
        steps,
        "run_id",
        "step_index",
        lambda w: {"current_input": F.coalesce(F.lag("tool_response").over(w), F.lit(""))},
        back=1,
        block=block,
    )
    return shaped.select(
        "run_id",
        (F.col("step_index") + 1).alias("step"),
        F.concat(
            F.coalesce("reasoning", F.lit("")), F.lit("\n<action>"), action, F.lit("</action>")
        ).alias("content"),
        F.coalesce("tool_response", F.lit("")).alias("env_response"),
        "current_input",
    )


def task_text_fallback(steps: DataFrame) -> DataFrame:
    """Task text per run: the first response, or the first reasoning when that is blank."""
    first = F.min_by(F.struct("tool_response", "reasoning"), "step_index")
    return (
        steps.groupBy("run_id")
        .agg(first.alias("f"))
        .select(
            "run_id",
            F.coalesce(
                tt.blank_to_null(F.col("f.tool_response")), F.col("f.reasoning"), F.lit("")
            ).alias("task_description"),
        )
    )


def task_from_chat(messages: DataFrame) -> DataFrame:
    """Task text per run, from user messages that speak of a task.

    The first `Your task is:` line decides; without one, the last message with a
    line on task, put or find does.
    """
    text = F.col("text")
    low = F.lower(text)
    asked = messages.where((F.col("role") == "user") & low.contains("task"))
    stated = F.when(
        text.contains("Your task is:"),
        tt.strip(F.regexp_extract(text, r"(?s)Your task is:([^\n]*)", 1)),
    )
    lines = F.filter(
        F.split(text, "\n"), lambda s: F.lower(s).rlike("task|put|find")
    )
    hinted = F.when(
        low.contains("put a clean") | low.contains("find"), tt.strip(F.get(lines, F.lit(0)))
    )
    marked = asked.select("run_id", "turn", stated.alias("stated"), hinted.alias("hinted"))
    return marked.groupBy("run_id").agg(
        F.coalesce(
            F.min_by("stated", F.when(F.col("stated").isNotNull(), F.col("turn"))),
            F.max_by("hinted", F.when(F.col("hinted").isNotNull(), F.col("turn"))),
            F.lit(""),
        ).alias("task_description")
    )


def _tag(content: Column, name: str) -> Column:
    return tt.strip(F.regexp_extract(content, f"(?s)<{name}>(.*?)</{name}>", 1))


def extract_modules(content: Column, env: Column, tags: dict[str, str] | None = None) -> Column:
    """struct(memory, reflection, planning, action) from tagged text."""
    names = {"memory": "memory", "reflection": "reflection", "planning": "plan",
             "action": "action", **(tags or {})}
    found = {module: _tag(content, name) for module, name in names.items()}
    memory, planning, action = found["memory"], found["planning"], found["action"]
    command = F.coalesce(
        *[
            F.nullif(F.regexp_extract(action, rf"(?i){verb}\[[^\]]*\]", 0), F.lit(""))
            for verb in ("search", "click", "buy")
        ],
        action,
    )
    recall, think = _tag(content, "memory_recall"), _tag(content, "think")
    call, answer = _tag(content, "tool_call"), _tag(content, "answer")
    answered = content.rlike(r"(?s)<answer>.*?</answer>")
    return F.struct(
        F.when((env == "gaia") & (memory == ""), recall).otherwise(memory).alias("memory"),
        found["reflection"].alias("reflection"),
        F.when((env == "webshop") & (planning == ""), think).otherwise(planning).alias("planning"),
        F.when(env == "webshop", command)
        .when(
            (env == "gaia") & answered,
            F.concat(F.lit("answer: "), F.substring(answer, 1, 100)),
        )
        .when((env == "gaia") & call.contains("tool:"), call)
        .otherwise(action)
        .alias("action"),
    )


def is_placeholder(text: Column) -> Column:
    clean = F.lower(tt.strip(F.coalesce(text, F.lit(""))))
    return (
        (F.coalesce(text, F.lit("")) == "")
        | tt.contains_any(clean, tx.PLACEHOLDER_PHRASES)
        | clean.isin(*tx.PLACEHOLDER_TEXTS)
    )


def is_substantive(text: Column) -> Column:
    return ~is_placeholder(text) & (F.length(tt.strip(text)) >= 8)


def select_task(messages: DataFrame) -> DataFrame:
    """The task of each conversation.

    The latest user message that is neither test output nor a placeholder, else
    the latest user message, else a task line of the first system message.
    """
    text = tt.strip(F.coalesce("text", F.lit("")))
    kept = messages.select("run_id", "turn", "role", text.alias("text")).where("text <> ''")
    first_line = F.lower(F.substring_index("text", "\n", 1))
    output = F.lit(False)
    for prefix in tx.TEST_OUTPUT_PREFIXES:
        output = output | first_line.startswith(prefix)
    real = ~output & ~is_placeholder(F.col("text"))
    lines = F.filter(
        F.split("text", r"\r\n|\n|\r"),
        lambda s: F.lower(s).rlike("^(?:" + "|".join(tx.TASK_LINE_PREFIXES) + ")"),
    )
    named = F.get(lines, F.lit(0))
    system_task = F.when(
        named.isNotNull(), tt.strip(F.regexp_replace(named, r"^[^:]*:", ""))
    ).otherwise(F.col("text"))
    ranked = kept.where(F.col("role").isin("user", "system")).select(
        "run_id",
        F.when(F.col("role") == "user", F.when(real, 3).otherwise(2)).otherwise(1).alias("rank"),
        F.when(F.col("role") == "user", F.col("turn")).otherwise(-F.col("turn")).alias("at"),
        F.when(F.col("role") == "user", F.col("text")).otherwise(system_task).alias("task"),
    )
    return ranked.groupBy("run_id").agg(
        F.max_by("task", F.struct("rank", "at")).alias("task_description")
    )


def detect_plan_text(messages: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """First message per run that holds a plan marker, with its turn."""
    marked = messages.where(
        tt.contains_any(F.col("text"), tx.PLAN_MARKERS if markers is None else markers)
    )
    return marked.groupBy("run_id").agg(
        F.min("turn").alias("turn"), F.min_by("text", "turn").alias("proposed_plan")
    )


def first_task_and_plan(messages: DataFrame) -> DataFrame:
    """Task and plan of a conversation as a client sees them on its first request.

    The task is the first user message, or a system message on a task before any.
    """
    task = F.when(
        (F.col("role") == "user")
        | ((F.col("role") == "system") & F.lower("text").contains("task")),
        F.col("text"),
    )
    plan = F.when(tt.contains_any(F.col("text"), tx.PLAN_MARKERS), F.col("text"))
    marked = messages.select("run_id", "turn", task.alias("t"), plan.alias("p"))
    return marked.groupBy("run_id").agg(
        F.min_by("t", F.when(F.coalesce("t", F.lit("")) != "", F.col("turn"))).alias(
            "task_description"
        ),
        F.coalesce(
            F.min_by("p", F.when(F.col("p").isNotNull(), F.col("turn"))), F.lit("")
        ).alias("proposed_plan"),
    )


def flatten_content(col: Column) -> Column:
    """Message content, a string or a JSON list of parts, as plain text."""
    items = F.from_json(col, "array<string>")
    texts = F.transform(
        F.filter(
            items,
            lambda i: F.json_object_keys(i).isNull()
            | (F.get_json_object(i, "$.type") == "text"),
        ),
        lambda i: F.when(
            F.json_object_keys(i).isNotNull(),
            F.coalesce(F.get_json_object(i, "$.text"), F.lit("")),
        ).otherwise(i),
    )
    is_list = F.coalesce(F.schema_of_variant(F.try_parse_json(col)).startswith("ARRAY"), F.lit(False))
    return F.when(is_list, F.array_join(texts, "\n")).otherwise(F.coalesce(col, F.lit("")))
