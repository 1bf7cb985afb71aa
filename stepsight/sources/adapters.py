"""Span lists, graph checkpoints and chat histories to traces and steps. Inputs have one row per span, checkpoint or message, with its
place `pos` in its list and the list's key `source`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pyjson import py_repr
from .sessions import standing_plans

SPAN = "array<struct<span_id:string,trace_id:string,parent_span_id:string,name:string,start_time:string,attributes:string>>"
CHECKPOINT = "array<struct<config:struct<configurable:struct<thread_id:string>>,checkpoint:struct<id:string,channel_values:string>,metadata:struct<step:int,writes:string>,parent_config:struct<configurable:struct<checkpoint_id:string>>>>"
MESSAGE = "array<struct<role:string,content:string,session_id:string,tool_call_id:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>"
NO_NULLS = {"ignoreNullFields": "false"}


def exploded(lists: DataFrame, schema: str) -> DataFrame:
    """source, pos and the fields of each element of JSON lists (source, value)."""
    return lists.select("source", F.posexplode(F.from_json("value", schema)).alias("pos", "x")).select("source", "pos", "x.*")


def read_lists(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """exploded() of JSON files that hold one list each."""
    return exploded(spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value"), schema)


def _attribute(name: str) -> Column:
    return F.get_json_object("attributes", f"$['{name}']")


def span_traces(spans: DataFrame) -> DataFrame:
    """source, trace_id, flow_type, agent_config_ref, tenant_id from each list's root: the first span without a parent, else the first."""
    has_parent = F.coalesce(F.length("parent_span_id"), F.lit(0)) > 0
    kind = F.upper(F.coalesce(_attribute("openinference.span.kind"), F.lit("")))
    root = F.struct("trace_id", kind.alias("kind"), _attribute("session.id").alias("session"), _attribute("user.id").alias("user"))
    r = spans.groupBy("source").agg(F.min_by(root, F.struct(has_parent.alias("p"), "pos")).alias("r"))
    flow = F.when(F.col("r.kind").startswith("VOICE") | (F.col("r.kind") == "AUDIO"), "voice").when(F.col("r.kind").startswith("BROWSER") | (F.col("r.kind") == "COMPUTER_USE"), "browser").otherwise("generic")
    return r.select("source", "r.trace_id", flow.alias("flow_type"), F.coalesce(F.nullif("r.session", F.lit("")), F.lit("unknown")).alias("agent_config_ref"), F.nullif("r.user", F.lit("")).alias("tenant_id"))


def span_steps(spans: DataFrame) -> DataFrame:
    """One step per span; its kind decides actor and action."""
    kind = F.coalesce(_attribute("openinference.span.kind"), F.lit(""))
    said, out = _attribute("input.value"), _attribute("output.value")
    tool = kind.isin("TOOL", "RETRIEVER")
    payload = (
        F.when(kind == "LLM", F.to_json(F.struct(said.alias("input"), out.alias("output")), NO_NULLS))
        .when(tool, F.to_json(F.struct("name", said.alias("input"), out.alias("output")), NO_NULLS))
        .when(kind.isin("AGENT", "CHAIN"), F.to_json(F.struct(F.col("name").alias("node"))))
        .otherwise("{}")
    )
    nanos = F.expr("try_cast(start_time AS BIGINT)")
    ts = F.when(nanos.isNotNull(), F.timestamp_micros(F.floor(nanos / 1000))).otherwise(F.try_to_timestamp("start_time"))
    docs = F.from_json(_attribute("retrieval.documents"), "array<string>")
    field = lambda d, name: F.get_json_object(d, f"$['{name}']")

    def ref(d: Column, i: Column) -> Column:
        whole = ~F.coalesce(d.startswith("{"), F.lit(False))
        text = F.when(whole, d).otherwise(field(d, "document.content"))
        return F.struct(F.lit("retrieval").alias("source"), F.coalesce(F.when(~whole, field(d, "document.id")), i.cast("string")).alias("identifier"), F.nullif(F.substring(text, 1, 100), F.lit("")).alias("excerpt"))

    return spans.join(span_traces(spans).select("source", F.col("trace_id").alias("root_trace")), "source").select(
        "source",
        F.col("root_trace").alias("trace_id"),
        F.col("pos").cast("long").alias("seq"),
        F.col("span_id").alias("step_id"),
        F.nullif("parent_span_id", F.lit("")).alias("parent_step_id"),
        ts.alias("ts"),
        F.when(tool, "tool").otherwise("agent").alias("actor"),
        F.nullif(F.substring(said, 1, 200), F.lit("")).alias("declared_intent"),
        F.when(tool, "tool_call").when(kind.isin("AGENT", "CHAIN"), "state_transition").otherwise("utterance").alias("action_type"),
        payload.alias("payload"),
        F.coalesce(F.transform(docs, ref), F.array().cast("array<struct<source:string,identifier:string,excerpt:string>>")).alias("context_used"),
    )


def checkpoint_steps(checkpoints: DataFrame, base: Column) -> DataFrame:
    """One step per checkpoint; the first key of its writes is the node. base: time of step 0."""
    node = F.get(F.json_object_keys("metadata.writes"), 0)
    own = checkpoints.withColumn("node", node).withColumn("body", F.element_at(F.from_json("metadata.writes", "map<string,string>"), F.col("node")))
    messages = F.from_json(F.get_json_object("body", "$.messages"), "array<struct<type:string,content:string>>")
    spoken = F.filter(messages, lambda m: m["type"] == "ai")
    last = F.try_element_at(spoken, F.lit(-1))["content"]
    says = (F.col("node") == "respond") | (F.coalesce(F.size(spoken), F.lit(0)) > 0)
    quiet = ~F.coalesce(F.array_contains(F.json_object_keys("body"), "messages"), F.lit(False))
    action = F.when(F.col("node").isNull(), "state_transition").when(says, "utterance").when(quiet, "tool_call").otherwise("state_transition")
    named = F.coalesce("node", F.lit("unknown")).alias("node")
    payload = F.when(F.col("node").isNotNull() & says, F.to_json(F.struct(named, F.coalesce(last, F.col("body")).alias("output")))).when(F.col("node").isNotNull() & quiet, F.to_json(F.struct(named, F.col("body").alias("writes")))).otherwise(F.to_json(F.struct(named)))
    trace = F.first("config.configurable.thread_id").over(Window.partitionBy("source").orderBy("pos"))
    return own.select(
        "source",
        trace.alias("trace_id"),
        F.col("pos").cast("long").alias("seq"),
        F.concat(F.lit("ck-"), F.col("checkpoint.id")).alias("step_id"),
        F.concat(F.lit("ck-"), F.nullif("parent_config.configurable.checkpoint_id", F.lit(""))).alias("parent_step_id"),
        (base + F.make_dt_interval(secs=F.coalesce("metadata.step", F.lit(0)))).alias("ts"),
        F.lit("agent").alias("actor"),
        F.get_json_object("checkpoint.channel_values", "$.intent").alias("declared_intent"),
        action.alias("action_type"),
        payload.alias("payload"),
    )


def chat_steps(messages: DataFrame, redact: bool = False) -> DataFrame:
    """Steps of chat histories: system messages go, ids count from 1, a tool result's parent is the call that it answers, and only
    TodoWrite changes the standing plan. redact: the whole payload of a call or result becomes its size as Python shows it."""
    trace = F.coalesce(F.nullif(F.first("session_id").over(Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit("")), F.lit("unknown"))
    own = messages.withColumn("trace_id", trace).where(F.col("role").isin("user", "assistant", "tool")).withColumn("said", F.coalesce("content", F.lit("")))
    listed = "from_json(get_json_object(c.function.arguments, '$.todos'), 'array<struct<content:string,status:string>>')"
    acts = F.expr(
        f"""transform(filter(tool_calls, c -> c.function.name = 'TodoWrite' AND {listed} IS NOT NULL), c -> named_struct('kind', 'set', 'subject', CAST(NULL AS STRING), 'status', CAST(NULL AS STRING), 'task', CAST(NULL AS INT),
            'said', nullif(array_join(transform(filter({listed}, t -> t.content <> '' AND t.status IN ('pending', 'in_progress')), t -> t.content), '\\n'), '')))"""
    )
    plans = standing_plans(own.where("role = 'assistant'").select(F.col("source").alias("session"), F.col("pos").alias("line"), acts.alias("acts")).where("size(acts) > 0"))
    plans = plans.select(F.col("session").alias("source"), F.col("line").alias("pos"), F.struct("plan").alias("p"))
    carried = F.last("p", ignorenulls=True).over(Window.partitionBy("source").orderBy("pos"))["plan"]
    own = own.join(plans, ["source", "pos"], "left").withColumn("standing", carried)
    rows = own.select("*", F.posexplode_outer(F.when(F.col("role") == "assistant", F.col("tool_calls"))).alias("i", "c")).withColumn("i", F.coalesce("i", F.lit(0)))
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("source").orderBy("pos", "i")).cast("long")).withColumn("step_id", F.concat("trace_id", F.lit("-step-"), F.col("seq")))
    calls = rows.where("c IS NOT NULL").groupBy("source", F.col("c.id").alias("tool_call_id")).agg(F.max_by("step_id", "seq").alias("parent"))
    call = F.col("c").isNotNull()
    intent = F.when(F.col("role") == "assistant", F.coalesce(F.when(F.col("i") == 0, F.nullif("said", F.lit(""))), "standing"))
    data = F.when(call, F.coalesce(F.when(F.try_parse_json("c.function.arguments").isNotNull(), F.col("c.function.arguments")), F.lit("{}")))
    answer = F.when(F.col("role") == "tool", F.col("said"))
    if redact:
        named = F.to_json(F.struct(F.coalesce("c.function.name", F.lit("")).alias("name")))
        whole = F.when(call, F.concat(F.substring(named, 1, F.length(named) - 1), F.lit(',"input":'), data, F.lit("}"))).otherwise(F.to_json(F.struct(F.col("said").alias("tool_result"))))
        rows = rows.withColumn("shown", py_repr(whole))
        hidden = F.to_json(F.struct(F.lit(True).alias("redacted"), F.length("shown").alias("size")))
        data, answer = F.when(call, hidden), F.when(F.col("role") == "tool", hidden)
    return rows.join(calls, ["source", "tool_call_id"], "left").select(
        "source",
        "trace_id",
        "seq",
        "step_id",
        F.when(F.col("role") == "tool", F.col("parent")).alias("parent_step_id"),
        F.when(F.col("role") == "user", "user").when(F.col("role") == "tool", "tool").otherwise("agent").alias("actor"),
        intent.alias("declared_intent"),
        F.when(call, "tool_call").when(F.col("role") == "tool", "env_effect").otherwise("utterance").alias("action_type"),
        F.when(call & F.lit(not redact), F.coalesce("c.function.name", F.lit(""))).alias("tool_name"),
        data.alias("payload"),
        F.when(~call & (F.col("role") != "tool"), F.col("said")).alias("text"),
        answer.alias("tool_result"),
    )
