"""Session report: timeline, turns, header, rendered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import DELEGATES, EDITS
from ..functions.scans import Mark, chunked, keys_of, place_of, running
from .findings import RANK, basename, calls, is_bash, marked

CLIP = 100
#: The rules in the order in which a report lists their findings.
RULES = ("scope-escape", "churn-burst", "commit-without-tests", "tripwire", "error-cluster", "delegation-unobserved", "abandoned-artifact")


def clipped(text: Column, most: int = CLIP) -> Column:
    """White space collapsed, cut to `most` characters with an ellipsis."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most - 1), " +$", ""), F.lit("…")))


def is_user_turn() -> Column:
    return (F.col("actor") == "user") & (F.col("action_type") == "utterance") & (F.coalesce(F.length("text"), F.lit(0)) > 0)


def timeline(steps: DataFrame) -> DataFrame:
    """trace_id, seq, step_id, ts, kind, summary of notable events. Runs of edits are one event; only successful results may lie between."""
    failed = F.coalesce(F.col("is_error"), F.lit(False))
    keys = keys_of(steps)
    own = chunked(marked(steps)).where(~((F.col("action_type") == "env_effect") & ~failed)).withColumn("edit", calls(*EDITS))
    path = F.coalesce(F.col("file_path"), F.lit("?"))
    narrow = own.select(*place_of(own), "seq", "step_id", "ts", "edit", "file_path")
    # Edits of one run have the same last step before them that is none.
    edits = running(narrow, keys, {"island": Mark("max", F.when(~F.col("edit"), F.col("seq")))}).where("edit")
    runs = edits.groupBy(*keys, "island").agg(F.min("seq").alias("seq"), F.min_by(F.struct("step_id", "ts"), "seq").alias("start"), F.count("*").alias("n"), F.collect_set(basename(path)).alias("names"))
    edited = F.when(F.size("names") > 1, F.concat(F.lit("Edited "), F.col("n"), F.lit(" times across "), F.size("names"), F.lit(" files"))).when(F.col("n") == 1, F.concat(F.lit("Edited "), F.col("names")[0])).otherwise(F.concat(F.lit("Edited "), F.col("names")[0], F.lit(" x"), F.col("n")))
    described = F.coalesce(F.nullif(F.get_json_object("payload", "$.description"), F.lit("")), "tool_name")
    kind = (
        F.when((F.col("action_type") == "env_effect") & failed, "error")
        .when(is_user_turn(), "user")
        .when(calls("Write"), "write")
        .when(is_bash() & F.col("trip").isNotNull(), "tripwire")
        .when(F.col("__commit"), "commit")
        .when(F.col("__verify"), "test")
        .when(calls(*DELEGATES), "delegation")
    )
    lead = {"error": ("Error: ", F.coalesce("tool_result", F.lit("None"))), "user": ("", F.col("text")), "write": ("Wrote ", path), "commit": ("Commit: ", F.col("command")), "test": ("Ran: ", F.col("command"))}
    summary = F.when(F.col("kind") == "tripwire", F.concat(F.lit("Tripwire "), F.col("trip"), F.lit(": "), F.col("command"))).when(F.col("kind") == "delegation", F.concat(F.lit("Delegated via "), F.col("tool_name"), F.lit(": "), described))
    for k, (before, what) in lead.items():
        summary = summary.when(F.col("kind") == k, F.concat(F.lit(before), what))
    rest = own.where("NOT edit").withColumn("trip", F.get("__tripped", F.lit(0))).withColumn("kind", kind).where("kind IS NOT NULL").select(*keys, "seq", "step_id", "ts", "kind", clipped(summary).alias("summary"))
    return rest.unionByName(runs.select(*keys, "seq", "start.step_id", "start.ts", F.lit("edit").alias("kind"), clipped(edited).alias("summary")))


def turns(steps: DataFrame) -> DataFrame:
    """trace_id, turn, step_id, user_text, followed_by (map of tool to calls) of every user utterance."""
    keys = keys_of(steps)
    own = chunked(steps)
    own = own.select(*place_of(own), "seq", "step_id", "actor", "action_type", "tool_name", "text").withColumn("user", is_user_turn())
    own = running(own, keys, {"turn": Mark("sum", F.col("user").cast("int"))}).where("turn > 0")
    said = own.where("user").select(*keys, "turn", "seq", "step_id", F.col("text").alias("user_text"))
    used = own.where((F.col("actor") == "agent") & (F.col("action_type") == "tool_call") & F.col("tool_name").isNotNull()).groupBy(*keys, "turn", "tool_name").agg(F.count("*").alias("n"))
    maps = used.groupBy(*keys, "turn").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool_name", "n")))).alias("followed_by"))
    return said.join(maps, [*keys, "turn"], "left").withColumn("followed_by", F.coalesce("followed_by", F.expr("cast(map() as map<string,bigint>)")))


def header(steps: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """One row per trace: counts, the last listed minus the first listed time in seconds, and from metadata (trace_id, cwd, branch,
    version) where the session ran; without it the first cwd of its steps. The session's id is its trace's."""
    seconds = F.unix_micros(F.max_by("ts", "seq").cast("timestamp")) - F.unix_micros(F.min_by("ts", "seq").cast("timestamp"))
    keys = keys_of(steps)
    sums = steps.groupBy(*keys).agg(
        F.min_by(F.when(F.col("cwd").isNotNull(), F.col("cwd")), F.when(F.col("cwd").isNotNull(), F.col("seq"))).alias("own_cwd"),
        F.count("*").alias("n_steps"),
        F.count_if(F.col("action_type") == "tool_call").alias("n_tool_calls"),
        F.count_if(is_user_turn()).alias("n_user_turns"),
        (seconds / 1e6).alias("duration_s"),
    )
    none = F.lit(None).cast("string")
    sums = sums.join(metadata.select(*keys, "cwd", "branch", "version"), keys, "left") if metadata is not None else sums.select("*", F.col("own_cwd").alias("cwd"), none.alias("branch"), none.alias("version"))
    return sums.select(*keys, F.col("trace_id").alias("session_id"), "cwd", "branch", "version", "duration_s", "n_steps", "n_tool_calls", "n_user_turns")


def _listed(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """trace_id and the `line` of its rows in their order, joined."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col("line")))), lambda x: x["line"])
    return df.groupBy(*keys_of(df)).agg(F.array_join(lines, "\n").alias(name))


def rendered(steps: DataFrame, findings: DataFrame, metadata: DataFrame | None = None, not_checked: DataFrame | None = None, policies: DataFrame | None = None) -> DataFrame:
    """trace_id, markdown of every trace: summary, policy context, timeline, findings by severity, instruction compliance, not checked.

    findings: of findings.analyze(); metadata: as in header(); not_checked: trace_id, rule_id, reason; policies: cwd, path, scope, title,
    rank of the documents in force. steps that are arranged by trace need no exchange but those of the other tables."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(unknown)"))
    head = header(steps, metadata)
    fields = (("Session ID", "session_id"), ("Project (cwd)", "cwd"), ("Git branch", "branch"), ("Version", "version"), ("Duration (s)", "duration_s"), ("Steps", "n_steps"), ("Tool calls", "n_tool_calls"), ("User turns", "n_user_turns"))
    table = F.concat_ws("\n", F.lit("| Field | Value |\n| --- | --- |"), *(F.concat(F.lit(f"| {label} | "), shown(c), F.lit(" |")) for label, c in fields))
    when = F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("?"))
    times = timeline(steps).withColumn("line", F.concat(F.lit("- `"), F.col("step_id"), F.lit("` **"), F.col("kind"), F.lit("** ("), when, F.lit(") — "), F.col("summary")))
    found = findings.withColumn("line", F.concat(F.lit("- **"), F.col("rule_id"), F.lit("** — "), F.col("title"), F.lit(" (steps: "), F.array_join("step_ids", ", "), F.lit(") — "), F.when(F.col("shown") == "", "(none)").otherwise(F.col("shown"))))
    keys = keys_of(steps)
    by_severity = found.groupBy(*keys, "severity").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rule_order(F.col("rule_id")).alias("o"), "seq", "rule_id", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    each = {v: F.max(F.when(F.col("severity") == v, F.struct("n", "lines"))).alias(v) for v in RANK}
    found = by_severity.groupBy(*keys).agg(*each.values())
    tools = F.array_join(F.transform(F.map_entries("followed_by"), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"].cast("string"))), "\n")
    said = turns(steps).withColumn("line", F.concat(F.lit('### Turn: "'), clipped(F.col("user_text")), F.lit('"\n'), F.when(F.size("followed_by") == 0, "- No tool calls followed this turn.").otherwise(tools)))
    said = said.withColumn("line", F.concat("line", F.lit("\n")))
    out = head.join(_listed(times, "times", F.col("seq")), keys, "left").join(found, keys, "left").join(_listed(said, "said", F.col("turn")), keys, "left")
    if not_checked is not None:
        lines = not_checked.withColumn("line", F.concat(F.lit("- **"), F.col("rule_id"), F.lit("**: "), F.col("reason")))
        out = out.join(_listed(lines, "skipped", F.col("rule_id")), keys, "left")
    if policies is not None:
        lines = policies.withColumn("line", F.concat(F.lit("- **"), F.col("scope"), F.lit("** `"), F.col("path"), F.lit("` — "), F.coalesce("title", F.lit("(no heading)"))))
        lines = lines.groupBy("cwd").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("policies"))
        out = out.join(lines, "cwd", "left")
    n = {v: F.coalesce(F.col(f"{v}.n"), F.lit(0)) for v in RANK}
    total = sum(n.values(), F.lit(0))
    counted = F.concat(total, F.lit(" finding(s): "), F.concat_ws(", ", *(F.concat(n[v], F.lit(f" {v}")) for v in RANK)), F.lit("."))
    groups = F.concat_ws("\n\n", *(F.when(F.col(v).isNotNull(), F.concat(F.lit(f"### {v.upper()}\n"), F.col(f"{v}.lines"))) for v in RANK))
    compliance = F.regexp_replace(F.coalesce("said", F.lit("No user turns recorded.")), "\\n$", "")
    policy = F.coalesce(F.col("policies") if policies is not None else F.lit(None).cast("string"), F.lit("No policy files were discovered for this session's working directory."))
    skipped = F.coalesce(F.col("skipped") if not_checked is not None else F.lit(None).cast("string"), F.lit("All rules ran."))
    sections = [
        "# Session post-mortem", "", "## Summary", "", table, "", "## Policy context", "", policy, "", "## Timeline", "", F.coalesce("times", F.lit("No notable events.")), "",
        "## Findings", "", counted, "", F.when(total == 0, "No findings.").otherwise(groups), "", "## Instruction compliance", "", compliance, "", "## Not checked", "", skipped, "",
    ]
    return out.select(*keys, F.array_join(F.array(*(F.lit(x) if isinstance(x, str) else x for x in sections)), "\n").alias("markdown"))


def rule_order(rule: Column) -> Column:
    """Place of a finding's rule in the order in which the rules run."""
    order = F.lit(len(RULES))
    for i, prefix in reversed(list(enumerate(RULES))):
        order = F.when(rule.startswith(prefix), i).otherwise(order)
    return order
