"""Derived tables over the driver's `events` and `conversations`: agent steps and raw session records.

The column rules are plain SQL that Spark and DuckDB both read, so every query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of a step from event_type, k (number in props) and u (user_id).
COLUMNS = {
    "trace_id": "CAST(u AS STRING)",
    "seq": "CAST(row_number() OVER (PARTITION BY u ORDER BY ts, event_id) AS BIGINT)",
    "step_id": "concat('e', CAST(event_id AS STRING))",
    "ts": "ts",
    "cwd": "CASE WHEN u % 10 <> 9 THEN concat('/work/p', CAST(u % 4 AS STRING)) END",
    "actor": "CASE WHEN event_type = 'signup' AND k < 20 THEN 'user' WHEN event_type = 'error' THEN 'tool' ELSE 'agent' END",
    "action_type": "CASE WHEN event_type = 'signup' AND k < 20 THEN 'utterance' WHEN event_type = 'error' THEN 'env_effect' ELSE 'tool_call' END",
    "tool_name": "CASE WHEN event_type = 'signup' AND k >= 30 THEN 'Write' WHEN event_type = 'signup' AND k >= 20 THEN 'Task' WHEN event_type = 'click' THEN 'Edit' WHEN event_type = 'view' THEN 'Read' WHEN event_type = 'purchase' THEN 'Bash' END",
    "file_path": "CASE WHEN event_type = 'signup' AND k >= 30 THEN concat('/work/p', CAST(u % 4 AS STRING), '/new', CAST(k AS STRING), '.md')"
    " WHEN event_type = 'click' AND k % 10 = 9 THEN '/tmp/scratch.py' WHEN event_type = 'click' AND k % 10 = 8 THEN '/work/other/secrets.yaml'"
    " WHEN event_type = 'click' OR (event_type = 'view' AND k % 4 = 0) THEN concat('/work/p', CAST(u % 4 AS STRING), '/f', CAST(k % 3 AS STRING), '.py')"
    " WHEN event_type = 'view' THEN concat('/work/p', CAST(u % 4 AS STRING), '/readme.md') END",
    "command": "CASE WHEN event_type <> 'purchase' THEN NULL WHEN k % 10 = 0 THEN 'pytest -q' WHEN k % 10 = 1 THEN 'git commit -m wip' WHEN k % 10 = 2 THEN 'npm test && git commit -m x'"
    " WHEN k % 10 = 3 THEN 'rm -rf build' WHEN k % 10 = 4 THEN 'git push --force origin main' WHEN k % 10 = 5 THEN 'echo A=1 >> .env' ELSE concat('cat new', CAST(k AS STRING), '.md') END",
    "text": "CASE WHEN event_type = 'signup' AND k < 20 THEN concat('task ', CAST(k AS STRING)) END",
    "tool_result": "CASE WHEN event_type = 'error' AND k % 2 = 0 THEN concat('fail ', CAST(k AS STRING)) WHEN event_type = 'error' THEN concat('ok new', CAST(k AS STRING), '.md') END",
    "is_error": "event_type = 'error' AND k % 2 = 0",
    "delegation_unobserved": "event_type = 'signup' AND k >= 20 AND k < 30",
    "declared_intent": "CASE WHEN (event_type IN ('click', 'view', 'purchase') OR (event_type = 'signup' AND k >= 20)) AND k % 7 <> 0 THEN concat('edit f', CAST(k % 3 AS STRING), ' py in p', CAST(u % 4 AS STRING)) END",
    "agent_id": "CASE WHEN k % 11 = 0 THEN concat('a', CAST(k % 2 AS STRING)) END",
    "record_type": "CASE WHEN u % 25 = 7 AND k % 5 = 0 THEN 'mystery' WHEN event_type = 'error' OR (event_type = 'signup' AND k < 20) THEN 'user' ELSE 'assistant' END",
    "k": "k",
    "u": "u",
}
#: A tool's input, from the columns above.
PAYLOAD = """CASE WHEN tool_name = 'Bash' THEN concat('{"command": "', command, '"}') WHEN tool_name = 'Task' AND k % 2 = 0 THEN concat('{"description": "part ', CAST(k AS STRING), '"}') WHEN tool_name = 'Task' THEN '{}'
 WHEN tool_name IS NOT NULL THEN concat('{"file_path": "', file_path, '"}') END"""
_SELECT = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in COLUMNS.items())

#: Starts an oracle: WITH steps AS (...).
DUCKDB = f"WITH ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id AS u FROM events), steps AS (SELECT *, {PAYLOAD} AS payload FROM ({_SELECT} FROM ev))"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per step of the traces that `events` stands for."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("*", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k", "user_id AS u")
    return ev.selectExpr(*(f"{sql} AS {name}" for name, sql in COLUMNS.items())).selectExpr("*", f"{PAYLOAD} AS payload")


def raw_lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The same traces as raw session records: (session, line, value), value a JSON object in the shape of a session log; more: columns of
    steps besides."""
    s = steps(spark, sf_dir)
    block = """CASE WHEN action_type = 'tool_call' THEN to_json(named_struct('type', 'tool_use', 'id', concat('t', seq), 'name', tool_name, 'input', named_struct('file_path', file_path, 'command', command, 'description', CASE WHEN tool_name = 'Task' THEN 'delegate' END)))
        WHEN action_type = 'env_effect' THEN to_json(named_struct('type', 'tool_result', 'tool_use_id', concat('t', seq - 1), 'content', tool_result, 'is_error', is_error))
        ELSE to_json(named_struct('type', 'text', 'text', text)) END"""
    think = "CASE WHEN action_type = 'tool_call' AND declared_intent IS NOT NULL THEN concat(to_json(named_struct('type', 'text', 'text', declared_intent)), ',') ELSE '' END"
    head = "to_json(named_struct('type', record_type, 'uuid', step_id, 'sessionId', trace_id, 'cwd', cwd, 'version', '1', 'timestamp', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")))"
    return s.selectExpr("trace_id AS session", "seq AS line", *more, f"concat(substring({head}, 1, length({head}) - 1), ',\"message\":{{\"role\":\"x\",\"content\":[', {think}, {block}, ']}}}}') AS value")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` as chat steps: trace_id, seq, role, text, without system rows."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role <> 'system'").selectExpr("CAST(conv_id AS STRING) AS trace_id", "turn AS seq", "role", "text")


TURNS = "WITH turns AS (SELECT CAST(conv_id AS VARCHAR) AS trace_id, turn AS seq, role, text FROM conversations WHERE role <> 'system')"
