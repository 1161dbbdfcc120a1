"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

SCHEMA_VERSION = "1.0"

REQUIRED_KEYS = ["run_id", "task_id", "trial_number", "final_status"]
DOCUMENTED_KEYS = [
    "run_id", "task_id", "trial_number", "horizon_level", "final_status",
    "total_steps_taken",
]

METADATA = """
schema_version string, run_id string, task_id string, trial_number int,
horizon_level int, total_steps_taken int, final_status string,
task_description string, grader_notes string, duration_seconds double,
active_duration_seconds double, created_at string, root_cause_step_index int,
root_cause_error_type string, tag_confidence double, tag_source string,
source_dataset string, source_split string, source_llm_model string,
original_module string, original_subtype string
"""

STEP = """
step_index int, timestamp double, reasoning string, action_name string,
action_args string, tool_response string, state_snapshot string, error_tag string
"""

TRAJECTORY = f"schema_version string, steps array<struct<{STEP}>>"

JUDGMENT = """
root_cause_error_type string, root_cause_step_index int, confidence double,
justification string, root_cause_justification string
"""

PATTERN = """
pattern_id string, category string, trigger_description string,
example_snippet array<struct<step_index:int,reasoning:string,action_name:string,
action_args:map<string,string>,tool_response:string>>,
safe_alternative string, source_run_ids array<string>, confidence double
"""

TRANSCRIPT = """
created_at string, type string, source string, content string, thinking string,
tool_calls array<struct<name:string,args:string>>
"""

BENCHMARK_RECORD = """
trajectory_id string, task_type string, llm_model string, num_steps int,
failure_modules array<string>, failure_types array<string>,
failure_reasonings array<string>, critical_failure_module string,
critical_failure_step int, step_annotations string, full_trajectory string
"""

SESSION_EVENT = """
session_id string, seq long, ts timestamp, hook_event_name string, prompt string,
plan string, tool_name string, tool_input string, tool_response string
"""
