"""JSON documents in and out: normalised traces, evidence packs, provenance entries, policies, probes; and their writers.

Readers take a glob and give tables; each has a `parse` half over (source, value) rows, so documents may come from any table. What is
no document of its kind is dropped. Writers make one JSON text for each trace or pack (a document is one row by its nature) and write
them as lines, which the readers take back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scans import keys_of

REFS = "array<struct<source:string,identifier:string,excerpt:string>>"
STEP = f"struct<step_id:string,parent_step_id:string,trace_id:string,timestamp:string,actor:string,declared_intent:string,action:struct<type:string,payload:string>,context_used:{REFS},metadata:string>"
SHARD = "struct<key:string,first:bigint>"
TRACE = f"struct<trace_id:string,tenant_id:string,flow_type:string,agent_config_ref:string,source_adapter:string,metadata:string,shard:{SHARD},steps:array<{STEP}>>"
STEP_DRIFT = "struct<step_id:string,label:string,overturned_gate:boolean,reasoning:string,severity:string,evidence:string>"
DRIFT = f"struct<drift_score:double,flagged_steps:array<string>,method:string,method_version:string,per_step:map<string,{STEP_DRIFT}>,taxonomy_counts:map<string,bigint>>"
PACK = f"struct<pack_id:string,subject:struct<agent_config_ref:string,agent_version:string,tenant_id:string>,drift_metrics:{DRIFT},trace_summary:struct<trace_count:bigint,step_count:bigint,flow_types:array<string>,time_range:array<string>>>"
PROVENANCE = "session_id string, agent string, model string, project string, branch string, recent_commits array<string>, timestamp string"
PROBE = "struct<probe_id:string,family:string,version:string,kind:string,stimulus:struct<channel:string,payload:string>,expected_behavior:struct<should_refuse:boolean,must_not_contain:array<string>,must_invoke_tools:array<string>,must_not_invoke_tools:array<string>>,applicable_flows:array<string>,description:string>"
# The kinds of probe.
KINDS = ("jailbreak", "prompt_injection", "social_engineering", "ambiguity", "voice_cloning", "screen_poisoning", "tool_misuse", "exfiltration", "alignment_drift", "pii_leak")
KEEP_NULLS = {"ignoreNullFields": "false"}


def read_values(spark: SparkSession, glob: str) -> DataFrame:
    """source, line (null for a whole file), value of JSON documents: whole .json files, and every line of .jsonl and other files."""
    path = F.col("_metadata.file_path")
    whole = spark.read.option("pathGlobFilter", "*.json").text(glob, wholetext=True).select(path.alias("source"), F.lit(None).cast("string").alias("line"), "value").where(~path.endswith(".jsonl"))
    line = F.concat_ws(".", "_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(glob).select(path.alias("source"), line.alias("line"), "value").where(~path.endswith(".json"))
    return whole.union(lines).where("try_parse_json(value) IS NOT NULL")


def _objects(values: DataFrame, schema: str) -> DataFrame:
    """source, key (the document's place), pos and x, an object of the schema, of values that are an object or a list of them."""
    many = F.regexp_replace("value", r"^\s+", "").startswith("[")
    items = F.when(many, F.from_json("value", f"array<{schema}>")).otherwise(F.array(F.from_json("value", schema)))
    line = ["line"] if "line" in values.columns else []
    found = values.select("source", *line, F.posexplode(items).alias("pos", "x")).where("x IS NOT NULL")
    return found.select("source", F.concat_ws("#", "source", *line, "pos").alias("key"), "pos", "x")


def _field(json: str, *names: str) -> Column:
    return F.get_json_object(json, "$." + ".".join(names))


def _truth(text: Column) -> Column:
    return F.coalesce(~F.lower(text).isin("", "false", "0", "null", "[]", "{}"), F.lit(False))


def _run(i: int, document: str) -> Column:
    """The model (1) or seed (2) in the path <model>/<seed>/<document>.json; null for other paths."""
    return F.nullif(F.regexp_extract("source", rf"([^/]+)/([^/]+)/{document}\.json$", i), F.lit(""))


def parse_traces(values: DataFrame) -> DataFrame:
    """Steps of normalised traces, one row each, with what the rules and the evaluation read of a step pulled out; seq is the place in the
    trace. trace_key is the document's place, as trace ids repeat, or what the shards of one trace have in common; model and seed come from a <model>/<seed>/trace.json path, if there is one."""
    t = _objects(values, TRACE).select("source", F.coalesce("x.shard.key", "key").alias("trace_key"), F.coalesce("x.shard.first", F.lit(0)).alias("first"), _run(1, "trace").alias("model"), _run(2, "trace").alias("seed"), "x.*").where("trace_id IS NOT NULL AND steps IS NOT NULL")
    s = t.select("trace_key", "first", "model", "seed", "trace_id", "tenant_id", "flow_type", "agent_config_ref", "source_adapter", F.col("metadata").alias("m"), F.posexplode("steps").alias("pos", "s"))
    own = ("step_id", "parent_step_id", "timestamp", "actor", "declared_intent", "action", "context_used", "metadata")
    s = s.select("*", *(f"s.{c}" for c in own)).withColumn("p", F.col("action.payload"))
    call = F.col("action.type") == "tool_call"
    return s.select(
        F.col("m").alias("trace_metadata"),
        *(c for c in ("tenant_id", "flow_type", "agent_config_ref", "source_adapter")),
        "trace_key",
        "model",
        "seed",
        "trace_id",
        (F.col("first") + F.col("pos")).alias("seq"),
        "step_id",
        "parent_step_id",
        F.try_to_timestamp("timestamp").alias("ts"),
        "actor",
        "declared_intent",
        F.col("action.type").alias("action_type"),
        F.when(call, _field("p", "name")).alias("tool_name"),
        F.when(call, _field("p", "input")).alias("payload"),
        F.when(call, _field("p", "input", "file_path")).alias("file_path"),
        F.when(call, _field("p", "input", "command")).alias("command"),
        F.when(call, F.coalesce(_field("p", "input", "path"), F.lit(""))).alias("path"),
        F.when(~call, _field("p", "text")).alias("text"),
        F.when(~call, _field("p", "tool_result")).alias("tool_result"),
        (_truth(_field("p", "is_error")) | _truth(_field("metadata", "is_error"))).alias("is_error"),
        _truth(_field("metadata", "delegation_unobserved")).alias("delegation_unobserved"),
        _field("metadata", "agent_id").alias("agent_id"),
        _field("metadata", "permission_mode").alias("permission_mode"),
        _field("m", "cwd").alias("cwd"),
        F.coalesce("context_used", F.array().cast(REFS)).alias("context_used"),
    )


def read_traces(spark: SparkSession, glob: str) -> DataFrame:
    return parse_traces(read_values(spark, glob))


def trace_documents(steps: DataFrame, shard: int | None = None) -> DataFrame:
    """trace_id (and trace_key, where steps have one), value: one JSON document for each trace, its steps in order. Columns that steps lack
    are left out or null.

    shard: a trace of any length becomes documents of at most about so many steps, by ranges of seq, each with the trace's key and the
    number of steps before it; parse_traces() puts them together again, in whatever order they are read."""
    has = lambda c, kind="string": F.col(c) if c in steps.columns else F.lit(None).cast(kind)
    raw = F.coalesce(has("payload"), F.lit("null"))
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(has(c).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1), F.lit("null"))
    quoted = lambda c: F.when(has(c).isNull(), "null").otherwise(text(c))
    call = F.concat(F.lit('{"name":'), quoted("tool_name"), F.lit(',"input":'), raw, F.lit("}"))
    effect = F.concat(F.lit('{"tool_result":'), quoted("tool_result"), F.when(F.coalesce(has("is_error", "boolean"), F.lit(False)), ',"is_error":true}').otherwise("}"))
    said = F.concat(F.lit('{"text":'), quoted("text"), F.lit("}"))
    payload = F.when(F.col("action_type") == "tool_call", call).when(F.col("action_type") == "env_effect", effect).otherwise(said)
    notes = F.to_json(F.struct(F.when(F.coalesce(has("delegation_unobserved", "boolean"), F.lit(False)), True).alias("delegation_unobserved"), has("agent_id").alias("agent_id"), has("permission_mode").alias("permission_mode")))
    head = F.to_json(F.struct("step_id", has("parent_step_id").alias("parent_step_id"), "trace_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), "actor", "declared_intent", has("context_used", REFS).alias("context_used")), KEEP_NULLS)
    step = F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"action":{"type":"'), F.col("action_type"), F.lit('","payload":'), payload, F.lit('},"metadata":'), notes, F.lit("}"))
    keys = keys_of(steps)
    by = [*keys, "shard"]
    split = F.floor(F.col("seq") / shard) if shard else F.lit(0)
    per = steps.select(*keys, split.cast("long").alias("shard"), "seq", has("cwd").alias("cwd"), has("flow_type").alias("flow_type"), has("source_adapter").alias("source_adapter"), has("agent_config_ref").alias("agent_config_ref"), has("tenant_id").alias("tenant_id"), step.alias("step"))
    grouped = per.groupBy(*by).agg(F.count("*").alias("n"), F.max("cwd").alias("cwd"), *(F.max(c).alias(c) for c in ("flow_type", "source_adapter", "agent_config_ref", "tenant_id")), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "step"))), lambda x: x["step"]), ",").alias("all"))
    if shard:
        before = F.sum("n").over(Window.partitionBy(*keys).orderBy("shard")) - F.col("n")  # a row a document
        grouped = grouped.withColumn("part", F.struct(F.col(keys[0]).alias("key"), before.alias("first")))
    else:
        grouped = grouped.withColumn("part", F.lit(None).cast(SHARD))
    top = F.to_json(F.struct("trace_id", F.col("part").alias("shard"), "tenant_id", F.coalesce("flow_type", F.lit("generic")).alias("flow_type"), F.coalesce("agent_config_ref", F.lit("unknown")).alias("agent_config_ref"), F.coalesce("source_adapter", F.lit("table")).alias("source_adapter"), F.struct("cwd").alias("metadata")), KEEP_NULLS)
    return grouped.select(*keys, F.concat(F.substring(top, 1, F.length(top) - 1), F.lit(',"steps":['), F.col("all"), F.lit("]}")).alias("value"))


def parse_packs(values: DataFrame) -> DataFrame:
    """source, pos and the fields of evidence packs. model and seed come from a <model>/<seed>/pack.json path, where there is one."""
    p = _objects(values, PACK).where("x.drift_metrics IS NOT NULL")
    return p.select("source", "pos", _run(1, "pack").alias("model"), _run(2, "pack").alias("seed"), "x.pack_id", "x.subject", "x.drift_metrics.*", "x.trace_summary")


def read_packs(spark: SparkSession, glob: str) -> DataFrame:
    return parse_packs(read_values(spark, glob))


def pack_steps(packs: DataFrame) -> DataFrame:
    """The per_step map of packs as rows: what identifies the pack, step_id, label, overturned_gate, reasoning, severity, evidence, flagged."""
    own = [c for c in packs.columns if c not in ("per_step", "flagged_steps", "taxonomy_counts", "trace_summary")]
    rows = packs.select(*own, "flagged_steps", F.explode("per_step").alias("step", "d"))
    return rows.select(*own, F.col("step").alias("step_id"), "d.label", F.coalesce("d.overturned_gate", F.lit(False)).alias("overturned_gate"), "d.reasoning", F.coalesce("d.severity", F.lit("LOW")).alias("severity"), F.coalesce("d.evidence", F.lit("n/a")).alias("evidence"), F.coalesce(F.array_contains("flagged_steps", F.col("step")), F.lit(False)).alias("flagged"))


def parse_provenance(values: DataFrame) -> DataFrame:
    """line and the fields of provenance entries (source, line, value); commits are joined by comma and blank."""
    p = values.select("line", F.from_json("value", PROVENANCE).alias("p")).where("p.session_id IS NOT NULL")
    return p.select("line", "p.session_id", "p.agent", "p.model", "p.project", "p.branch", F.array_join("p.recent_commits", ", ").alias("recent_commits"), "p.timestamp")


def read_provenance(spark: SparkSession, glob: str) -> DataFrame:
    lines = spark.read.text(glob).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id")).alias("line"))
    return parse_provenance(lines)


def title_of(text: Column) -> Column:
    """The first heading of the first level of a markdown text; null without one."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#[ \t]+(\S.*?)\s*$", 1)), F.lit(""))


def read_policies(spark: SparkSession, glob: str, scope: str = "project") -> DataFrame:
    """dir, path, scope, title of markdown policies; those in a hidden folder hold for the folder above it, its rules as `rules`."""
    path = F.regexp_replace("_metadata.file_path", "^file:/+", "/")
    files = spark.read.text(glob, wholetext=True).select(path.alias("path"), "value")
    rules = F.col("path").rlike(r"/\.[^/]+/rules/[^/]+$")
    return files.select(F.regexp_extract("path", r"^(.*?)(?:/\.[^/]+(?:/rules)?)?/[^/]+$", 1).alias("dir"), "path", F.when(rules, "rules").otherwise(scope).alias("scope"), title_of(F.col("value")).alias("title"))


def parse_probes(values: DataFrame) -> DataFrame:
    """Probe definitions; those without a required field or of no known kind are dropped."""
    p = _objects(values, PROBE).select("source", "x.*")
    need = F.col("kind").isin(*KINDS)
    for c in ("probe_id", "family", "version", "stimulus.channel", "stimulus.payload", "expected_behavior"):
        need = need & F.col(c).isNotNull()
    refuse = F.coalesce("expected_behavior.should_refuse", F.lit(True)).alias("should_refuse")
    lists = [F.coalesce(f"expected_behavior.{c}", F.array().cast("array<string>")).alias(c) for c in ("must_not_contain", "must_invoke_tools", "must_not_invoke_tools")]
    return p.where(need).select("source", "probe_id", "family", "version", "kind", F.col("stimulus.channel").alias("channel"), F.col("stimulus.payload").alias("payload"), refuse, *lists, F.coalesce("applicable_flows", F.array().cast("array<string>")).alias("applicable_flows"), "description")


def read_probes(spark: SparkSession, glob: str) -> DataFrame:
    return parse_probes(read_values(spark, glob))


def write_documents(documents: DataFrame, path: str, column: str = "value", by: str | None = None) -> None:
    """Writes one text a row: JSON documents as JSON lines, or rendered reports; into a folder for each value of `by`."""
    out = documents.select(F.regexp_replace(F.col(column), r"[\r\n]+", " ").alias("value") if column == "value" else F.col(column).alias("value"), *([by] if by else []))
    (out.write.partitionBy(by) if by else out.write).text(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """trace_id and markdown as JSON lines, which keep the line ends of a report."""
    reports.select(F.to_json(F.struct("trace_id", "markdown")).alias("value")).write.text(path)
