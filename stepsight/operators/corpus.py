"""Counts over a corpus of raw records, and signs that a parser no longer fits it. Input: sources.sessions.records()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Record types that are known, and tools that carry a plan.
KNOWN = "assistant user last-prompt queue-operation system mode attachment ai-title custom-title permission-mode file-history-snapshot pr-link agent-name file-history-delta bridge-session frame-link summary".split()
ANCHORS = ("TodoWrite", "TaskCreate", "TaskUpdate")
UNKNOWN_SHARE = 0.05
LEAST_SESSIONS = 20


def _blocks(of: str, kind: str) -> Column:
    return F.when(F.col("type") == of, F.coalesce(F.size(F.filter("blocks", lambda b: b["type"] == kind)), F.lit(0))).otherwise(0)


def record_types(records: DataFrame) -> DataFrame:
    return records.where("type IS NOT NULL").groupBy("type").agg(F.count("*").alias("n"))


def tool_calls(records: DataFrame, names: tuple | None = None) -> DataFrame:
    used = records.where("type = 'assistant'").select("session", F.explode(F.filter("blocks", lambda b: (b["type"] == "tool_use") & b["name"].isNotNull())).alias("b")).select("session", F.col("b.name").alias("tool_name"))
    return (used.where(F.col("tool_name").isin(*names)) if names else used).groupBy("tool_name").agg(F.count("*").alias("n"))


def _marks(records: DataFrame) -> DataFrame:
    """session, agent_id, (path,) marks: what each record counts for, as (metric, key)."""
    delegate = F.col("agent_id").isNotNull() if "agent_id" in records.columns else F.lit(False)
    agent = F.col("agent_id") if "agent_id" in records.columns else F.lit(None).cast("string")
    calls = F.when(F.col("type") == "assistant", F.transform(F.filter("blocks", lambda b: (b["type"] == "tool_use") & b["name"].isNotNull()), lambda b: b["name"]))
    says = lambda metric, keys, when: F.when(when, F.transform(keys, lambda k: F.struct(F.lit(metric).alias("metric"), k.alias("key"))))
    none = F.array().cast("array<struct<metric:string,key:string>>")
    parts = [
        says("record_type", F.array("type"), F.col("type").isNotNull() & ~delegate),
        says("anchor", F.filter(calls, lambda k: k.isin(*ANCHORS)), ~delegate),
        says("subagent_records", F.array(F.lit("")), delegate),
        says("delegate_tool", calls, delegate),
    ]
    return records.select("session", agent.alias("agent_id"), *(["path"] if "path" in records.columns else []), F.concat(*(F.coalesce(p, none) for p in parts)).alias("marks"))


def _told(sums: DataFrame, seen: DataFrame, plan_stores: DataFrame | None, unreadable: DataFrame | None) -> DataFrame:
    """(metric, key, n) from sums (the same) and the transcripts seen (session, agent_id)."""
    seen = seen.groupBy("session").agg(F.count("agent_id").alias("agents"), F.count_if(F.col("agent_id").isNull()).alias("own"))
    stored = F.lit(0)
    if plan_stores is not None:
        seen, stored = seen.join(plan_stores.select("session", F.lit(1).alias("stored")).distinct(), "session", "left"), F.count_if((F.col("own") > 0) & F.col("stored").isNotNull())
    whole = seen.agg(F.count_if(F.col("own") > 0).alias("sessions"), F.coalesce(F.sum("agents"), F.lit(0)).alias("subagent_transcripts"), F.count_if(F.col("agents") > 0).alias("sessions_with_subagents"), stored.cast("long").alias("sessions_with_plan_store"))
    out = whole.selectExpr("inline(array(" + ", ".join(f"named_struct('metric', '{m}', 'key', '', 'n', {m})" for m in whole.columns) + "))").union(sums)
    return out.union(unreadable.select(F.lit("unreadable"), "path", F.lit(1).cast("long"))) if unreadable is not None else out


def counts(records: DataFrame) -> DataFrame:
    """(metric, key, n) of what single records count for: the part of statistics() that takes one pass and no transcripts."""
    return _marks(records).select(F.explode("marks").alias("x")).groupBy("x.metric", "x.key").agg(F.count("*").alias("n"))


def statistics(records: DataFrame, plan_stores: DataFrame | None = None, unreadable: DataFrame | None = None) -> DataFrame:
    """(metric, key, n): sessions; of parent transcripts, records by type and plan anchors; of subagents, transcripts, records, sessions that
    have them and calls by tool; sessions with a plan store (plan_stores: session); unreadable transcripts (unreadable: path).

    One pass: each record says what it counts for, and the counts are summed by metric and key."""
    counted = _marks(records)
    return _told(counts(records), counted.groupBy("session", "agent_id").agg(F.lit(1).alias("one")), plan_stores, unreadable)


def partials(records: DataFrame, run: int) -> DataFrame:
    """path, run, session, agent_id, counts (map of metric and key to n) of each transcript (records: with path), to be kept in a table: a
    corpus is summed from those of all runs, and only transcripts that changed are read again."""
    marks = _marks(records).select("path", "session", "agent_id", F.explode_outer("marks").alias("x"))
    sums = marks.groupBy("path", "session", "agent_id", "x.metric", "x.key").agg(F.count("x").alias("n"))
    entry = F.when(F.col("metric").isNotNull(), F.struct("metric", "key", "n"))
    return sums.groupBy("path", "session", "agent_id").agg(F.array_sort(F.collect_list(entry)).alias("counts")).select("path", F.lit(run).cast("long").alias("run"), "session", "agent_id", "counts")


def merged_statistics(parts: DataFrame, plan_stores: DataFrame | None = None, unreadable: DataFrame | None = None) -> DataFrame:
    """statistics() from partials() of any number of runs: of each transcript its last run's, which saw all of it."""
    last = parts.groupBy("path").agg(F.max_by(F.struct("session", "agent_id", "counts"), "run").alias("p")).select("p.*")
    sums = last.select(F.explode("counts").alias("x")).groupBy("x.metric", "x.key").agg(F.sum("x.n").alias("n"))
    return _told(sums, last.select("session", "agent_id").distinct(), plan_stores, unreadable)


def top(stats: DataFrame, metric: str, most: int | None = None) -> DataFrame:
    """rank, key, n of a metric of statistics(), the largest first and ties by key; anchors that nobody used are listed with 0. A key is a
    type or a tool, so the list is short."""
    own = stats.where(F.col("metric") == metric).select("key", "n")
    if metric == "anchor":
        every = stats.sparkSession.createDataFrame([(a,) for a in ANCHORS], "key string")
        own = every.join(own, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))
    ranked = own.select(F.row_number().over(Window.orderBy(F.desc("n"), "key")).cast("long").alias("rank"), "key", "n")
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def tops(stats: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """metric, rank, key, n: top() of several metrics of counts() or statistics(), which are worked out once for all of them."""
    own = stats.where(F.col("metric").isin(*metrics)).select("metric", "key", "n")
    if "anchor" in metrics:
        own = own.union(stats.sparkSession.createDataFrame([("anchor", a, 0) for a in ANCHORS], "metric string, key string, n long")).groupBy("metric", "key").agg(F.sum("n").alias("n"))
    return own.select("metric", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("n"), "key")).cast("long").alias("rank"), "key", "n")


def pairing(records: DataFrame) -> DataFrame:
    """session, calls, results, trailing (calls after the last user record), unresolved."""
    last = F.max(F.when(F.col("type") == "user", F.col("line")))
    own = records.select("session", "line", "type", _blocks("assistant", "tool_use").alias("c"), _blocks("user", "tool_result").alias("r"))
    ends = own.groupBy("session").agg(last.alias("last"))
    late = F.col("last").isNull() | (F.col("line") > F.col("last"))
    sums = own.join(ends, "session").groupBy("session").agg(F.sum("c").cast("long").alias("calls"), F.sum("r").cast("long").alias("results"), F.sum(F.when(late, F.col("c")).otherwise(0)).cast("long").alias("trailing"))
    return sums.withColumn("unresolved", F.col("calls") - F.col("results") - F.col("trailing"))


def unknown_share(records: DataFrame) -> DataFrame:
    """session, share of records whose type is unknown or missing."""
    return records.groupBy("session").agg(F.avg((~F.coalesce(F.col("type").isin(*KNOWN), F.lit(False))).cast("int")).alias("share"))


def breaches(records: DataFrame, most: float = UNKNOWN_SHARE, least_sessions: int = LEAST_SESSIONS, plan_stores: DataFrame | None = None) -> DataFrame:
    """session (null: the whole corpus), breach."""
    calls = pairing(records).where("calls <> results AND unresolved > 0").select("session", F.lit("unresolved-calls").alias("breach"))
    types = unknown_share(records).where(F.col("share") > most).select("session", F.lit("unknown-types").alias("breach"))
    whole = records.agg(F.countDistinct("session").alias("n"), F.coalesce(F.bool_or(F.exists("blocks", lambda b: (b["type"] == "tool_use") & b["name"].isin(*ANCHORS)) & (F.col("type") == "assistant")), F.lit(False)).alias("any"))
    if plan_stores is not None:
        whole = whole.crossJoin(plan_stores.agg((F.count("*") > 0).alias("stored"))).withColumn("any", F.col("any") | F.col("stored"))
    dead = whole.where((F.col("n") >= least_sessions) & ~F.col("any")).select(F.lit(None).cast("string").alias("session"), F.lit("no-plan-anchor").alias("breach"))
    return calls.union(types).union(dead)


def subagent_breaches(transcripts: DataFrame, meta: DataFrame, records: DataFrame, most: float = UNKNOWN_SHARE) -> DataFrame:
    """session, agent_id, breach of every subagent transcript: no sidecar, else no join key, else too many unknown types."""
    share = records.groupBy("session", "agent_id").agg(F.avg((~F.coalesce(F.col("type").isin(*KNOWN), F.lit(False))).cast("int")).alias("share"))
    own = transcripts.select("session", "agent_id").distinct().join(meta.select("session", "agent_id", "tool_use_id", F.lit(True).alias("has")), ["session", "agent_id"], "left").join(share, ["session", "agent_id"], "left")
    what = F.when(F.col("has").isNull(), "no-meta").when(F.col("tool_use_id").isNull(), "no-join-key").when(F.col("share") > most, "unknown-types")
    return own.select("session", "agent_id", what.alias("breach")).where("breach IS NOT NULL")


def healthy(sessions: DataFrame, breached: DataFrame) -> DataFrame:
    """Sessions that may be reported on."""
    return sessions.join(breached.where("session IS NOT NULL").select("session").distinct(), "session", "left_anti")


def intent_coverage(steps: DataFrame) -> DataFrame:
    return steps.where("actor = 'agent'").groupBy("trace_id").agg(F.avg(F.col("declared_intent").isNotNull().cast("int")).alias("coverage"), F.count("*").alias("n"))
