"""Belief state, replay, evidence packs, probes, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pyjson import canonical_json, plain_number, written_json
from ..functions.scans import keys_of

#: Columns of a probe's result and of a jurisdiction claim in a pack.
PROBE_RESULT = "probe_id:string,probe_family:string,probe_version:string,succeeded:boolean,severity:string,finding:string"
CLAIM = "regime:string,article:string,claim:string"


def beliefs(steps: DataFrame) -> DataFrame:
    """Of every step: declared_goal, the first intent of the whole trace, and salient_facts, from identifier to the last excerpt in its own
    context. The plan, the same for all steps of a trace, is in plans()."""
    whole = Window.partitionBy(*keys_of(steps)).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    goal = F.first("declared_intent", ignorenulls=True).over(whole).alias("declared_goal")
    if "context_used" not in steps.columns:
        return steps.select(*keys_of(steps), "seq", "step_id", goal, F.lit(None).cast("map<string,string>").alias("salient_facts"))
    known = F.filter("context_used", lambda c: c["identifier"].isNotNull())
    later = lambda c, i: F.exists(F.slice(known, i + 2, F.size(known)), lambda d: d["identifier"] == c["identifier"])
    facts = F.map_from_entries(F.transform(F.filter(known, lambda c, i: ~later(c, i)), lambda c: F.struct(c["identifier"], c["excerpt"])))
    return steps.select(*keys_of(steps), "seq", "step_id", goal, facts.alias("salient_facts"))


def plans(steps: DataFrame) -> DataFrame:
    """trace_id, active_plan: all intents of a trace in order; stored once, not with each step."""
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("declared_intent").isNotNull(), F.struct("seq", "declared_intent")))), lambda x: x["declared_intent"])
    return steps.groupBy(*keys_of(steps)).agg(listed.alias("active_plan"))


def replayed(steps: DataFrame, alternate: DataFrame) -> DataFrame:
    """trace_id, n_diff, first_divergence, diffs (JSON) against alternate (trace_id, step_id, action_type, payload)."""
    keys = keys_of(steps)
    a = alternate.select(*keys, "step_id", F.col("action_type").alias("other_type"), canonical_json("payload").alias("other"))
    both = steps.withColumn("own", canonical_json("payload")).join(a, [*keys, "step_id"])
    diff = both.where(~(F.col("action_type").eqNullSafe(F.col("other_type")) & F.col("own").eqNullSafe(F.col("other"))))
    action = lambda kind, payload: F.concat(F.lit('{"type": "'), kind, F.lit('", "payload": '), F.coalesce(payload, F.lit("null")), F.lit("}"))
    line = F.concat(F.lit('{"step_id": "'), F.col("step_id"), F.lit('", "original_action": '), action(F.col("action_type"), F.col("own")), F.lit(', "alternate_action": '), action(F.col("other_type"), F.col("other")), F.lit("}"))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), ", "), F.lit("]"))
    sums = diff.groupBy(*keys).agg(F.count("*").alias("n_diff"), F.min_by("step_id", "seq").alias("first_divergence"), listed.alias("diffs"))
    return steps.select(*keys).distinct().join(sums, keys, "left").select(*keys, F.coalesce("n_diff", F.lit(0)).cast("long").alias("n_diff"), "first_divergence", F.coalesce("diffs", F.lit("[]")).alias("diffs"))


def trace_summary(steps: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """One row: traces, steps, flow types in order, first and last time; zeros and nulls for no traces."""
    kinds = F.array_sort(F.collect_set("flow_type")) if "flow_type" in steps.columns else F.array().cast("array<string>")
    own = traces if traces is not None else steps
    return steps.agg(F.count("*").alias("step_count"), kinds.alias("flow_types"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).crossJoin(own.agg(F.countDistinct(keys_of(own)[0]).alias("trace_count")))


def packs(drift: DataFrame, steps: DataFrame, scored: DataFrame | None = None, issuer: str = "unknown", agent_version: str = "0", issued_at: str | None = None, probes: DataFrame | None = None, claims: DataFrame | None = None, replays: DataFrame | None = None) -> DataFrame:
    """trace_id, manifest, digest: one evidence pack per trace, canonical JSON, and the digest that seals it. All traces are scored.

    scored: rows of a judging scorer, for per_step. probes: results (probe_id, probe_family, probe_version, succeeded, severity, finding) by
    trace; claims: jurisdiction claims (regime, article, claim) by trace; replays: of replayed(), with the `policy` they followed. steps'
    flow_type, tenant_id and agent_config_ref, where there are such columns, say what was run and for whom. The pack's id is its content's,
    so runs agree; issued_at is the caller's."""
    keys = keys_of(drift)
    has = lambda c: F.col(c) if c in steps.columns else F.lit(None).cast("string")
    sums = steps.groupBy(*keys).agg(F.count("*").alias("step_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_sort(F.collect_set(has("flow_type"))).alias("flow_types"), F.max(has("tenant_id")).alias("tenant_id"), F.max(has("agent_config_ref")).alias("config"))
    rows = drift.join(sums, keys)
    if scored is None:
        rows = rows.withColumn("per_step", F.lit(None).cast("map<string,struct<step_id:string>>"))
    else:
        one = F.struct("evidence", "label", "overturned_gate", "reasoning", "severity", "step_id")
        written = F.struct(F.coalesce("rank", F.lit(-1)).alias("rank"), "seq") if "rank" in scored.columns else F.col("seq")
        last = scored.groupBy(*keys, "step_id").agg(F.max_by(one, written).alias("d"))
        rows = rows.join(last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("step_id", "d")))).alias("per_step")), keys, "left")
    typed = lambda columns: f"array<struct<{','.join(sorted(columns.split(',')))}>>"
    for name, table, columns, order in (("probe_results", probes, PROBE_RESULT, "probe_id"), ("jurisdiction_claims", claims, CLAIM, "article")):
        if table is None:
            rows = rows.withColumn(name, F.array().cast(typed(columns)))
        else:
            own = [F.col(c.split(":")[0]) for c in columns.split(",")]
            names = [c.split(":")[0] for c in columns.split(",")]
            listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("by"), F.struct(*own).alias("x")))), lambda x: _ordered({n: x["x"][n] for n in names}))  # noqa: B023
            rows = rows.join(table.groupBy(*(k for k in keys if k in table.columns)).agg(listed.alias(name)), [k for k in keys if k in table.columns], "left")
            rows = rows.withColumn(name, F.coalesce(name, F.array().cast(typed(columns))))
    replay = "counterfactual_policy:string,diff_summary:string,divergence_step:string,original_trace_id:string"
    none = F.expr(f"CAST(array() AS array<struct<{replay}>>)")
    if replays is None:
        rows = rows.withColumn("counterfactual_diffs", none)
    else:
        one = F.struct(F.col("policy").alias("counterfactual_policy"), F.col("diffs").alias("diff_summary"), F.col("first_divergence").alias("divergence_step"), F.col("trace_id").alias("original_trace_id"))
        rows = rows.join(replays.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("counterfactual_diffs")), keys, "left").withColumn("counterfactual_diffs", F.coalesce("counterfactual_diffs", none))
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    method = F.split("method", "@")
    metrics = {"drift_score": F.round("drift_score", 12), "drift_per_trace": F.create_map("trace_id", F.round("drift_score", 12)), "flagged_steps": F.col("flagged_steps"), "method": method[0], "method_version": method[1], "per_step": F.col("per_step")}
    metrics["taxonomy_counts"] = F.map_from_entries(F.array_sort(F.map_entries("taxonomy_counts")))
    sure, mark = plain_number(F.round("drift_score", 12)), F.lit(None).cast("struct<method:string>")
    if "fingerprint" in drift.columns:
        fields = drift.schema["fingerprint"].dataType.fields
        mark = F.when(F.col("fingerprint").isNotNull(), _ordered({f.name: F.col("fingerprint")[f.name] for f in fields}))
        for f in fields:
            sure = sure & plain_number(F.col("fingerprint")[f.name]) if f.dataType.typeName() in ("double", "float") else sure
    body = {
        "spec_version": F.lit("v0.1"), "issued_at": F.lit(issued_at), "issuer": F.struct(F.lit(issuer).alias("name")),
        "subject": _ordered({"agent_config_ref": F.coalesce("config", "trace_id"), "agent_version": F.lit(agent_version), "tenant_id": F.col("tenant_id")}),
        "jurisdiction_claims": F.col("jurisdiction_claims"), "probe_results": F.col("probe_results"), "drift_metrics": _ordered(metrics | {"scorer_fingerprint": mark}), "counterfactual_diffs": F.col("counterfactual_diffs"),
        "trace_summary": _ordered({"trace_count": F.lit(1), "step_count": F.col("step_count"), "flow_types": F.col("flow_types"), "time_range": F.array(at("first_ts"), at("last_ts"))}),
    }
    made = rows.select(*keys, F.to_json(_ordered(body), {"ignoreNullFields": "false"}).alias("manifest"), sure.alias("sure"))
    return made.select(*keys, written_json(F.col("manifest"), F.col("sure")).alias("manifest")).withColumn("digest", F.sha2("manifest", 256))


def _ordered(fields: dict[str, Column]) -> Column:
    """A struct whose fields come in the order of canonical JSON."""
    return F.struct(*(fields[k].alias(k) for k in sorted(fields)))


def sealed(manifests: DataFrame) -> DataFrame:
    return manifests.withColumn("digest", F.sha2(canonical_json("manifest"), 256))


def tampered(given: DataFrame, sealed_: DataFrame) -> DataFrame:
    """trace_id of packs whose manifest, canonical again, does not give the stored digest."""
    keys = keys_of(sealed_)
    return sealed(given).join(sealed_.select(*keys, F.col("digest").alias("stored")), keys).where("digest <> stored").select(*keys)


def keyword_probe(text: Column, forbidden: Column) -> Column:
    """Passes if no forbidden keyword occurs, whatever its case."""
    return ~F.exists(forbidden, lambda k: F.contains(F.lower(text), F.lower(k)))


def regex_probe(text: Column, patterns: list[str]) -> Column:
    """Passes if no pattern is found, whatever its case."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(text.rlike(f"(?idU){p}"), F.lit(False))
    return ~hit


def correlated(provenance: DataFrame, packs_: DataFrame) -> DataFrame:
    """Full outer by session_id; the last provenance entry (by line) of an id wins; what is missing is N/A."""
    entries = [c for c in ("agent", "model", "project", "branch", "recent_commits", "timestamp") if c in provenance.columns]
    last = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("line"))) == 1
    p = provenance.withColumn("last", last).where("last").select("session_id", *entries)
    found = packs_.select("session_id", F.col("drift_score").cast("string").alias("drift"), *(F.col("flagged").cast("string").alias("flagged") for c in packs_.columns if c == "flagged"))
    both = p.join(found, "session_id", "full_outer")
    return both.select("session_id", *(F.coalesce(c, F.lit("N/A")).alias(c) for c in both.columns if c != "session_id"))
