"""Raw session logs to steps. Records arrive as lines (session, line, value); malformed lines are dropped, never raised."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pyjson import py_repr
from ..functions.scans import Mark, arranged, chunked, running

BLOCK = "struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:string>"
RECORD = "struct<type:string,uuid:string,parentUuid:string,sessionId:string,timestamp:string,cwd:string,gitBranch:string,version:string,permissionMode:string,message:struct<content:string>>"
# Tools that delegate, states of a task that is still to do.
DELEGATES = ("Task", "Agent")
ACTIVE = ("pending", "in_progress")


def read_lines(spark: SparkSession, glob: str, since: datetime | None = None) -> DataFrame:
    """session (file stem), agent_id (subagent files), path, line (sortable place in its file), value for every JSON object line of JSONL
    files; since: only of files last written then or later. Files not named .jsonl hold many transcripts, as write_lines() leaves them:
    there the session is what the record calls it."""
    text = spark.read.text(glob)
    if since is not None:
        text = text.where(F.col("_metadata.file_modification_time") >= F.lit(since))
    lines = text.select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
    ok = F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull()
    path = F.col("file_path")
    stem = F.regexp_extract(path, r"/([^/]+)(?:/subagents/agent-[^/]+)?\.jsonl$", 1)  # from a slash on: else it is tried at each character, on every line
    return lines.where(ok).select(
        F.when(path.endswith(".jsonl"), stem).otherwise(F.coalesce(F.get_json_object("value", "$.sessionId"), F.lit(""))).alias("session"),
        F.nullif(F.regexp_extract(path, r"/subagents/agent-([^/]+)\.jsonl$", 1), F.lit("")).alias("agent_id"),
        path.alias("path"),
        F.struct("file_block_start", "id").alias("line"),
        "value",
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """Adds transcripts (session, line, value; each record names its session) to a folder, whole and in order, many to a file: files grow
    with bytes, not with sessions, as each costs its writer, every listing and every look at it more than its few lines do. No file is
    changed later: of a transcript that grew either its new lines are added or, for runs that want all of it, the whole."""
    whole = lines.repartition("session").sortWithinPartitions("session", "line")
    whole.select("value").write.mode("append").text(path)


def read_subagent_meta(spark: SparkSession, glob: str) -> DataFrame:
    """session, agent_id, tool_use_id, description of every readable sidecar; tool_use_id is null where the key is missing."""
    files = spark.read.text(glob, wholetext=True).select("value", "_metadata.file_path").where(F.try_parse_json("value").isNotNull())
    return files.select(
        F.regexp_extract("file_path", r"([^/]+)/subagents/agent-[^/]+\.meta\.json$", 1).alias("session"),
        F.regexp_extract("file_path", r"/subagents/agent-([^/]+)\.meta\.json$", 1).alias("agent_id"),
        F.get_json_object("value", "$.toolUseId").alias("tool_use_id"),
        F.get_json_object("value", "$.description").alias("description"),
    )


def read_plan_store(spark: SparkSession, glob: str) -> DataFrame:
    """session (folder), n, subject, status of every task file with a numeric stem."""
    files = spark.read.text(glob, wholetext=True).select("value", "_metadata.file_path")
    stem = F.expr("try_cast(regexp_extract(file_path, '([^/]+)[.]json$', 1) AS INT)")
    rows = files.select(F.regexp_extract("file_path", r"([^/]+)/[^/]+\.json$", 1).alias("session"), stem.alias("n"), "value").where("n IS NOT NULL").where(F.try_parse_json("value").isNotNull())
    return rows.select("session", "n", F.get_json_object("value", "$.subject").alias("subject"), F.get_json_object("value", "$.status").alias("status"))


def records(lines: DataFrame) -> DataFrame:
    """Parsed lines: session, line, type, its fields and `blocks` (array of BLOCK; a text content is one text block).

    A line is parsed once: what is no object is left out by the explode, beyond which no filter on a record's fields is pushed, as such a
    filter would parse all lines again."""
    r = lines.withColumn("r", F.explode(F.array_compact(F.array(F.from_json("value", RECORD)))))
    content = F.col("r.message.content")
    blocks = F.when(F.trim(content).startswith("["), F.from_json(content, f"array<{BLOCK}>"))
    plain = F.when(blocks.isNull() & content.isNotNull(), content)
    return r.select(*[c for c in lines.columns if c != "value"], "r.*", blocks.alias("blocks"), plain.alias("plain")).drop("message")


def _joined(kind: str) -> Column:
    texts = F.transform(F.filter("blocks", lambda b: b["type"] == kind), lambda b: b["text"] if kind == "text" else b["thinking"])
    text = F.array_join(F.filter(texts, lambda t: F.length(t) > 0), "\n")
    return F.coalesce(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def plan_seeds(store: DataFrame) -> DataFrame:
    """session, plan: what is still to do in each session's stored tasks (session, n, subject, status), in the order of n; null if nothing."""
    open_ = F.when((F.length("subject") > 0) & F.col("status").isin(*ACTIVE), F.struct("n", "subject"))
    listed = F.transform(F.array_sort(F.collect_list(open_)), lambda x: x["subject"])
    return store.groupBy("session").agg(F.nullif(F.array_join(listed, "\n"), F.lit("")).alias("plan"))


def _active_text(subjects: list[str], active: list[int]) -> str | None:
    return "\n".join(subjects[i] for i in active) or None


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task records, by session and in order, to the plan after each that touches it. What is held is one session's tasks, not its records."""
    of, subjects, active, text = None, [], [], None
    for b in batches:
        rows, plans = [], []
        for at, (session, acts) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
            if session != of or of is None:
                of, subjects, active, text = session, [], [], None
            touched, plan = False, None
            for act in acts:
                task, status = (act["task"] or 0) - 1, act["status"]
                if act["kind"] == "set":
                    touched, plan = True, act["said"]
                    continue
                if act["kind"] == "create":
                    active.append(len(subjects))
                    subjects.append(act["subject"])
                elif act["kind"] == "update" and 0 <= task < len(subjects) and status:
                    k = bisect_left(active, task)
                    there = k < len(active) and active[k] == task
                    if there == (status in ACTIVE):
                        touched, plan = True, _active_text(subjects, active) if text is None else text
                        continue
                    active.pop(k) if there else insort(active, task)
                else:
                    continue
                text = _active_text(subjects, active)
                touched, plan = True, text
            if touched:
                rows.append(at)
                plans.append(plan)
        kept = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(kept), b.column(1).take(kept), pa.array(plans, pa.string())], ["session", "line", "plan"])


def standing_plans(anchors: DataFrame) -> DataFrame:
    """session, line, plan: the plan after each anchor record that touches it. A plan may be null: cleared, which differs from not touched.

    anchors: session, line, acts (array of struct kind, subject, status, task, said) in the record's order. kind: `set` replaces the plan
    by said; `create` adds a pending task; `update` sets the status of the task-th one created. Only records that create or update tasks
    depend on earlier ones: they are sorted by session and folded as they stream by, in time linear in records and plans; all others need
    neither order nor exchange."""
    tasked = F.exists("acts", lambda a: a["kind"] != "set")
    simple = anchors.where(~tasked).select("session", "line", F.element_at("acts", -1)["said"].alias("plan"))
    line = dict(anchors.dtypes)["line"]
    ordered = anchors.where(tasked).select("session", "line", "acts").repartition("session").sortWithinPartitions("session", "line")
    return simple.unionByName(ordered.mapInArrow(_fold, f"session string, line {line}, plan string"))


def rejects(lines: DataFrame) -> DataFrame:
    """session, reason of sessions that have no record to make a step of; normalised() has nothing of them."""
    any_ = records(lines).groupBy("session").agg(F.bool_or(F.coalesce(F.col("type").isin("user", "assistant"), F.lit(False))).alias("any"))
    return any_.where("NOT any").select("session", F.lit("no user or assistant records").alias("reason"))


def normalised(lines: DataFrame, matched: DataFrame | None = None, redact: bool = False, seeds: DataFrame | None = None) -> DataFrame:
    """Steps of sessions: session, trace_key, trace_id, seq, step_id, parent_step_id, ts, actor, declared_intent, action_type, tool_name,
    file_path, command, text, tool_result, is_error, delegation_unobserved, tool_use_id, payload, permission_mode.

    trace_id is what the session calls itself, `unknown` if it doesn't; trace_key is its transcript's, so sessions never merge. A record is
    parsed and moved once; its standing plan and place are carried along the session chunk by chunk.
    matched: session, tool_use_id of delegations whose transcript is at hand. seeds: session, plan that stands before the first record,
    of plan_seeds(). redact: inputs and results become their size as Python shows them."""
    r = arranged(records(lines).where(F.col("type").isin("user", "assistant")), ["session"], "line")
    first = r.groupBy("session").agg(F.coalesce(F.min_by("sessionId", "line"), F.lit("unknown")).alias("trace_id"))
    uses = F.coalesce(F.filter("blocks", lambda b: b["type"] == "tool_use"), F.array().cast(f"array<{BLOCK}>"))
    results = F.coalesce(F.filter("blocks", lambda b: b["type"] == "tool_result"), F.array().cast(f"array<{BLOCK}>"))
    agent = F.col("type") == "assistant"
    r = r.withColumn("said", _joined("text")).withColumn("thought", _joined("thinking")).withColumn("acts", F.when(agent, uses).otherwise(results))
    said = F.coalesce(F.nullif("said", F.lit("")), F.nullif("thought", F.lit("")))
    r = r.withColumn("intent", F.when(agent, said))
    quiet = agent & (F.size("acts") == 0)
    listed = "from_json(get_json_object(b.input, '$.todos'), 'array<struct<content:string,status:string>>')"
    anchors = r.where(agent).withColumn(
        "todo",
        F.expr(f"""filter(transform(acts, b -> CASE
            WHEN b.name = 'TodoWrite' AND {listed} IS NOT NULL THEN named_struct('kind', 'set', 'subject', CAST(NULL AS STRING), 'status', CAST(NULL AS STRING), 'task', CAST(NULL AS INT),
                'said', nullif(array_join(transform(filter({listed}, t -> t.content <> '' AND t.status IN ('pending', 'in_progress')), t -> t.content), '\\n'), ''))
            WHEN b.name = 'TaskCreate' AND get_json_object(b.input, '$.subject') <> '' THEN named_struct('kind', 'create', 'subject', get_json_object(b.input, '$.subject'), 'status', CAST(NULL AS STRING), 'task', CAST(NULL AS INT), 'said', CAST(NULL AS STRING))
            WHEN b.name = 'TaskUpdate' THEN named_struct('kind', 'update', 'subject', CAST(NULL AS STRING), 'status', get_json_object(b.input, '$.status'), 'task', try_cast(get_json_object(b.input, '$.taskId') AS INT), 'said', CAST(NULL AS STRING)) END), x -> x IS NOT NULL)"""),
    )
    utter = F.expr("array(named_struct('kind', 'set', 'subject', CAST(NULL AS STRING), 'status', CAST(NULL AS STRING), 'task', CAST(NULL AS INT), 'said', intent))")
    anchors = anchors.withColumn("todo", F.when(quiet & F.col("intent").isNotNull(), utter).otherwise(F.col("todo"))).where(F.size("todo") > 0)
    plans = standing_plans(anchors.select("session", "line", F.col("todo").alias("acts")))
    plans = plans if "struct" not in dict(r.dtypes)["line"] else plans.select("session", F.expr(f"CAST(line AS {dict(r.dtypes)['line']})").alias("line"), "plan")
    r = r.join(chunked(plans, "line").withColumn("set", F.lit(True)), ["session", "chunk", "line"], "left")
    marks = {"carried": Mark("last", F.when(F.col("set"), F.struct("plan"))), "before": Mark("sum", F.greatest(F.size("acts"), F.lit(1)), before=True)}
    r = running(r, ["session"], marks, "line").join(first, "session")
    start = F.lit(None).cast("string")
    if seeds is not None:
        r, start = r.join(seeds.select("session", F.col("plan").alias("seed")), "session", "left"), F.col("seed")
    r = r.withColumn("standing", F.when(F.col("carried").isNull(), start).otherwise(F.col("carried.plan")))
    blocks = r.select("*", F.posexplode_outer("acts").alias("i", "b")).withColumn("i", F.coalesce("i", F.lit(0)))
    call, effect = F.col("b").isNotNull() & agent, F.col("b").isNotNull() & ~agent

    def step_id(i: Column) -> Column:
        """Of a record's i-th step: its uuid, else the trace's id and i; from the second on followed by i."""
        base = F.coalesce(F.nullif("uuid", F.lit("")), F.concat("trace_id", F.lit("-"), i.cast("string")))
        return F.when(i > 0, F.concat(base, F.lit("-"), i.cast("string"))).otherwise(base)

    text = F.when(F.col("b").isNotNull(), None).when(agent, F.col("said")).otherwise(F.coalesce("plain", "said"))
    delegated = call & F.coalesce(F.col("b.name").isin(*DELEGATES), F.lit(False))
    s = blocks.withColumn("step_id", step_id(F.col("i"))).withColumn("tool_use_id", F.when(call, F.col("b.id")))
    if matched is not None:
        s = s.join(matched.select("session", "tool_use_id").distinct().withColumn("hit", F.lit(True)), ["session", "tool_use_id"], "left")
        delegated = delegated & F.col("hit").isNull()
    data = F.when(call, F.col("b.input")).when(effect, F.col("b.content"))
    if redact:  # a result that is a text is shown as it is; inputs, and results that are lists, as Python shows them
        listed = call | F.coalesce(data.rlike(r"^\s*\["), F.lit(False))
        s = s.withColumn("shown", F.coalesce(py_repr(F.when(listed, data)), data))
        value = F.to_json(F.struct(F.lit(True).alias("redacted"), F.coalesce(F.length("shown"), F.lit(0)).alias("size")))
    else:
        value = data
    failed = effect & F.coalesce(~F.lower("b.is_error").isin("", "false", "0", "null"), F.lit(False))
    return s.select(
        "session",
        F.col("session").alias("trace_key"),
        "trace_id",
        (F.col("before") + F.col("i") + 1).cast("long").alias("seq"),
        "step_id",
        F.when(F.col("i") == 0, F.nullif("parentUuid", F.lit(""))).otherwise(step_id(F.col("i") - 1)).alias("parent_step_id"),
        F.try_to_timestamp("timestamp").alias("ts"),
        F.when(agent, "agent").when(effect, "tool").otherwise("user").alias("actor"),
        F.when(agent, F.coalesce(F.when(F.col("i") == 0, F.col("intent")), "standing")).alias("declared_intent"),
        F.when(call, "tool_call").when(effect, "env_effect").otherwise("utterance").alias("action_type"),
        F.when(call, F.col("b.name")).alias("tool_name"),
        F.when(call & F.lit(not redact), F.get_json_object("b.input", "$.file_path")).alias("file_path"),
        F.when(call & F.lit(not redact), F.get_json_object("b.input", "$.command")).alias("command"),
        text.alias("text"),
        F.when(effect, value).alias("tool_result"),
        failed.alias("is_error"),
        delegated.alias("delegation_unobserved"),
        "tool_use_id",
        F.when(call, value).alias("payload"),
        F.col("permissionMode").alias("permission_mode"),
        F.col("cwd"),
    )


def trace_metadata(lines: DataFrame, prefix: str = "session-log:") -> DataFrame:
    """session, trace_key, trace_id, config (prefix and id), cwd, branch, version of each session's first substantive record; sessions without one are absent."""
    r = records(lines).where(F.col("type").isin("user", "assistant"))
    first = r.groupBy("session").agg(F.min_by(F.struct("sessionId", "cwd", "gitBranch", "version"), "line").alias("m"))
    trace = F.coalesce("m.sessionId", F.lit("unknown"))
    return first.select("session", F.col("session").alias("trace_key"), trace.alias("trace_id"), F.concat(F.lit(prefix), trace).alias("config"), F.col("m.cwd").alias("cwd"), F.col("m.gitBranch").alias("branch"), F.col("m.version").alias("version"))


def delegate_links(steps: DataFrame, meta: DataFrame) -> DataFrame:
    """session, agent_id, tool_use_id, owner (step_id), brief of every delegate whose call is in its parent. Repeated ids: the last wins."""
    own = F.row_number().over(Window.partitionBy("session", "tool_use_id").orderBy(F.desc("seq"))) == 1
    calls = steps.where(F.col("tool_use_id").isNotNull() & F.col("tool_name").isin(*DELEGATES)).withColumn("own", own).where("own")
    last = F.row_number().over(Window.partitionBy("session", "tool_use_id").orderBy(F.desc("agent_id"))) == 1
    sidecars = meta.where("tool_use_id IS NOT NULL").withColumn("last", last).where("last")
    brief = F.nullif(F.concat_ws("\n\n", F.nullif("description", F.lit("")), F.nullif(F.get_json_object("payload", "$.prompt"), F.lit(""))), F.lit(""))
    return calls.join(sidecars, ["session", "tool_use_id"]).select("session", "agent_id", "tool_use_id", F.col("step_id").alias("owner"), F.col("seq").alias("owner_seq"), F.col("trace_id").alias("owner_trace"), brief.alias("brief"))


def delegate_steps(lines: DataFrame, links: DataFrame, redact: bool = False) -> DataFrame:
    """Steps of linked subagent transcripts (lines: session, agent_id, line, value), each normalised by itself; the brief stands as plan
    before its first record."""
    key = F.to_json(F.struct("session", "agent_id")).alias("session")
    own = normalised(lines.select(key, "line", "value"), redact=redact, seeds=links.select(key, F.col("brief").alias("plan")))
    return own.withColumn("agent_id", F.get_json_object("session", "$.agent_id")).withColumn("session", F.get_json_object("session", "$.session")).withColumn("trace_key", F.col("session"))


def with_delegates(parents: DataFrame, delegates: DataFrame, links: DataFrame) -> DataFrame:
    """Parent steps, then each linked delegate's steps (of delegate_steps()) in the order of their owners."""
    own = delegates.drop("trace_id").join(links.select("session", "agent_id", "owner", "owner_seq", "owner_trace"), ["session", "agent_id"])
    own = own.withColumn("parent_step_id", F.when(F.col("seq") == 1, F.col("owner")).otherwise(F.coalesce("parent_step_id", "owner")))
    both = parents.withColumn("agent_id", F.lit(None).cast("string")).withColumn("part", F.struct(F.lit(0).cast("long").alias("o"), F.lit("").alias("a"))).unionByName(
        own.withColumn("trace_id", F.col("owner_trace")).withColumn("part", F.struct(F.col("owner_seq").alias("o"), F.col("agent_id").alias("a"))).select(*parents.columns, "agent_id", "part")
    )
    sizes = both.groupBy("session", "part").agg(F.count("*").alias("n"))
    before = sizes.select("session", "part", (F.sum("n").over(Window.partitionBy("session").orderBy("part")) - F.col("n")).alias("before"))  # a row a transcript
    return both.join(before, ["session", "part"]).withColumn("seq", F.col("before") + F.col("seq")).drop("part", "before")
