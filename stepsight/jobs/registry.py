"""Every query over the reference's own work, with its SQL. Lists become strings and doubles are rounded, so that rows hash alike."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import CONCEPTS
from ..functions.pyjson import canonical_json
from ..functions.scans import arranged
from ..functions.tables import shared_dir
from ..operators import attest, corpus, drift, evaluate, findings, report
from ..sources import adapters, documents, ledger, sessions
from ..sources.testview import DUCKDB, TURNS, raw_lines, steps, turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def flat(df: DataFrame) -> DataFrame:
    return df.withColumn("step_ids", F.array_join("step_ids", ","))


payload_text = drift.with_payload_text


def rounded(c: Column | str) -> Column:
    return F.round(c, 9)


VERIFY = "regexp_matches(coalesce(command, ''), '\\b(pytest|unittest|jest|vitest|ruff|flake8|eslint|mypy|tox)\\b|\\bnpm\\s+(test|run\\s+test)\\b|\\bgo\\s+test\\b|\\bcargo\\s+test\\b|\\bmake\\s+(test|lint)\\b', 'i')"
COMMIT = "regexp_matches(coalesce(command, ''), '\\bgit\\s+commit\\b', 'i')"
EDITOR = "tool_name IN ('Write', 'Edit', 'NotebookEdit')"
FINDING = "'{rule}' AS rule_id, '{severity}' AS severity, '{title}' AS title"
SCOPE = f"""SELECT trace_id, {FINDING.format(rule="scope-escape", severity="high", title="Write outside allowed roots")}, seq, step_id AS step_ids,
 concat('{{"file_path":"', file_path, '","roots":["', cwd, '"],"tool":"', tool_name, '"}}') AS evidence, concat('file_path=''', file_path, ''', roots=[''', cwd, '''], tool=''', tool_name, '''') AS shown FROM steps
 WHERE {EDITOR} AND cwd IS NOT NULL AND NOT (file_path = cwd OR starts_with(file_path, cwd || '/') OR starts_with(file_path, '/tmp/'))"""
CHURN = f"""SELECT trace_id, {FINDING.format(rule="churn-burst", severity="medium", title="Repeated edits with no verification")}, min(seq) AS seq, string_agg(step_id, ',' ORDER BY seq) AS step_ids,
 concat('{{"file_path":"', file_path, '","run_length":', count(*), '}}') AS evidence, concat('file_path=''', file_path, ''', run_length=', count(*)) AS shown FROM (
 SELECT *, sum(CASE WHEN tool_name = 'Read' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, file_path ORDER BY seq) AS re FROM (
 SELECT *, sum(CASE WHEN tool_name = 'Bash' AND {VERIFY} THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY seq) AS ve FROM steps) WHERE file_path IS NOT NULL)
 WHERE {EDITOR} GROUP BY trace_id, file_path, ve, re HAVING count(*) >= 4"""
COMMITS = f"""SELECT trace_id, {FINDING.format(rule="commit-without-tests", severity="medium", title="Commit with no prior verification")}, seq, step_id AS step_ids,
 concat('{{"command":"', command, '"}}') AS evidence, concat('command=''', command, '''') AS shown FROM (
 SELECT *, max(CASE WHEN {VERIFY} THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id, epoch ORDER BY seq) AS seen FROM (
 SELECT *, coalesce(sum(CASE WHEN {COMMIT} THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM steps WHERE tool_name = 'Bash'))
 WHERE {COMMIT} AND seen = 0"""
TRIPS = """SELECT trace_id, concat('tripwire:', name) AS rule_id, 'high' AS severity, concat('Tripwire matched: ', name) AS title, seq, step_id AS step_ids,
 concat('{"command":"', command, '","name":"', name, '"}') AS evidence, concat('command=''', command, ''', name=''', name, '''') AS shown FROM steps, (VALUES
 ('destructive-rm', '\\brm\\s+(-\\w*r\\w*f\\w*|-\\w*f\\w*r\\w*)\\b'), ('force-push', '\\bgit\\s+push\\b[^\\n]*(--force\\b|-f\\b)'), ('db-migration', '\\b(alembic\\s+upgrade|manage\\.py\\s+migrate|django-admin\\s+migrate|rails\\s+db:migrate|prisma\\s+migrate\\s+deploy)\\b'),
 ('env-write', '(^|[\\s;&|])(>>?|\\btee\\b)[^\\n]{0,40}\\.env(\\.[a-zA-Z0-9_]+)?(\\s|$|[''"])'), ('docker-compose-down', '\\bdocker[\\s-]compose\\b[^\\n]*\\bdown\\b'), ('kubectl-delete', '\\bkubectl\\s+delete\\b'), ('drop-table', '\\bDROP\\s+TABLE\\b')) AS p(name, pattern)
 WHERE tool_name = 'Bash' AND regexp_matches(command, pattern, 'i')"""
ERRORS = f"""SELECT trace_id, {FINDING.format(rule="error-cluster", severity="medium", title="Cluster of consecutive tool errors")}, min(seq) AS seq, string_agg(step_id, ',' ORDER BY seq) FILTER (WHERE is_error) AS step_ids,
 concat('{{"error_count":', count(*) FILTER (WHERE is_error), ',"window_size":5}}') AS evidence, concat('error_count=', count(*) FILTER (WHERE is_error), ', window_size=5') AS shown FROM (
 SELECT *, sum(CASE WHEN covered AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY seq) AS island FROM (
 SELECT *, lag(covered) OVER (PARTITION BY trace_id ORDER BY seq) AS before FROM (
 SELECT *, coalesce(max(CASE WHEN q THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) = 1 AS covered FROM (
 SELECT *, pos <= greatest(n - 5, 0) AND errs >= 3 AS q FROM (
 SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY trace_id) AS n, sum(CASE WHEN is_error THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS errs FROM steps WHERE action_type = 'env_effect')))))
 WHERE covered GROUP BY trace_id, island HAVING count(*) FILTER (WHERE is_error) > 0"""
DELEGATIONS = f"""SELECT trace_id, {FINDING.format(rule="delegation-unobserved", severity="info", title="Unobserved delegation")}, seq, step_id AS step_ids, concat('{{"tool":"', tool_name, '"}}') AS evidence, concat('tool=''', tool_name, '''') AS shown FROM steps WHERE delegation_unobserved"""
ABANDONED = f"""SELECT w.trace_id, {FINDING.format(rule="abandoned-artifact", severity="low", title="Written file never referenced again")}, w.seq, w.step_id AS step_ids,
 concat('{{"basename":"', regexp_extract(w.file_path, '[^/]*$'), '","file_path":"', w.file_path, '"}}') AS evidence, concat('basename=''', regexp_extract(w.file_path, '[^/]*$'), ''', file_path=''', w.file_path, '''') AS shown FROM steps w WHERE w.tool_name = 'Write' AND NOT EXISTS (
 SELECT 1 FROM steps m WHERE m.trace_id = w.trace_id AND m.seq > w.seq AND contains(CASE WHEN m.tool_name IN ('Edit', 'Read', 'NotebookEdit') THEN m.file_path WHEN m.tool_name = 'Bash' THEN m.command WHEN m.action_type = 'env_effect' THEN m.tool_result ELSE '' END, regexp_extract(w.file_path, '[^/]*$')))"""
ALL = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in (SCOPE, CHURN, COMMITS, TRIPS, ERRORS, DELEGATIONS, ABANDONED))


@query(f"{DUCKDB} {SCOPE}")
def f1_scope_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(findings.scope_escape(steps(spark, sf_dir)))


@query(f"{DUCKDB} SELECT DISTINCT concat(cwd, '/src/../lib//x') AS cwd, cwd AS root FROM steps WHERE cwd IS NOT NULL AND u % 4 < 3 UNION SELECT DISTINCT concat(cwd, '/src/../lib//x'), concat(cwd, '/src/../lib//x') FROM steps WHERE cwd IS NOT NULL AND u % 4 = 3")
def f3_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir)
    repo_roots = s.where("cwd IS NOT NULL AND u % 4 < 3").select(F.col("cwd").alias("root")).union(s.select(F.lit("/nowhere").alias("root")))
    return findings.roots_of(s.select(F.concat("cwd", F.lit("/src/../lib//x")).alias("cwd")), repo_roots)


@query(f"{DUCKDB} SELECT DISTINCT trace_id, 'scope-escape' AS rule_id, 'no config.roots and no trace.metadata[''cwd''] available to establish allowed write roots' AS reason FROM steps WHERE cwd IS NULL")
def f3_not_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.not_checked(steps(spark, sf_dir))


@query(f"{DUCKDB} {CHURN}")
def f4_churn_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(findings.churn_burst(steps(spark, sf_dir)))


@query(f"{DUCKDB} {COMMITS}")
def f5_commit_without_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(findings.commit_without_tests(steps(spark, sf_dir)))


@query(f"{DUCKDB} {TRIPS}")
def f6_tripwires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(findings.tripwires(steps(spark, sf_dir)))


@query(f"{DUCKDB} {ERRORS}")
def f7_error_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(findings.error_clusters(steps(spark, sf_dir)))


@query(f"{DUCKDB} {DELEGATIONS}")
def f8_delegation_unobserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(findings.delegation_unobserved(steps(spark, sf_dir)))


@query(f"{DUCKDB} {ABANDONED}")
def f9_abandoned_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(findings.abandoned_artifacts(steps(spark, sf_dir)))


@query(f"{DUCKDB} {ALL}")
def f11_all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(findings.analyze(steps(spark, sf_dir)))


@query(f"{DUCKDB} SELECT trace_id, severity, count(*) AS n FROM ({ALL}) GROUP BY ALL")
def f11_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.severity_counts(findings.analyze(steps(spark, sf_dir)))


RULES = """rules AS (SELECT DISTINCT tenant, layer, CASE event_type WHEN 'signup' THEN 'tripwire_patterns' WHEN 'view' THEN 'roots' ELSE event_type END AS key,
 CASE WHEN event_type = 'signup' THEN concat('{"n', layer % 3, '":"p', layer, '"}') WHEN event_type = 'view' AND layer % 2 = 0 THEN '"auto"' WHEN event_type = 'view' THEN concat('["/r', layer, '"]') ELSE CAST(layer AS STRING) END AS value"""


@query(
    f"""WITH {RULES.replace("AS STRING", "AS VARCHAR")} FROM (SELECT user_id AS tenant, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS layer FROM events)), r AS (SELECT *, row_number() OVER (PARTITION BY tenant, key ORDER BY layer DESC) AS r FROM rules),
 p AS (SELECT tenant, concat('{{', string_agg(x, ',' ORDER BY name), '}}') AS value FROM (SELECT tenant, concat('n', layer % 3) AS name, concat('"n', layer % 3, '":"p', max(layer), '"') AS x FROM rules WHERE key = 'tripwire_patterns' GROUP BY tenant, layer % 3) GROUP BY 1)
 SELECT tenant, key, CASE WHEN key = 'tripwire_patterns' THEN p.value WHEN r.value = '"auto"' THEN 'null' ELSE r.value END AS value, layer FROM r LEFT JOIN p USING (tenant) WHERE r = 1"""
)
def f12_layered_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS tenant", "event_type", "CAST(get_json_object(props, '$.k') AS BIGINT) AS layer")
    ev.createOrReplaceTempView("rule_events")
    rules = spark.sql(f"WITH {RULES} FROM rule_events) SELECT * FROM rules")
    return findings.layered(rules)


@query(f"{DUCKDB} SELECT seq, step_id, trace_id, CASE WHEN regexp_matches(command, '\\brm\\s+-rf') THEN 'delete / rm -rf' ELSE '.env / secret / credential' END AS concept FROM steps WHERE regexp_matches(command, '\\brm\\s+-rf|\\.env\\b')")
def f13_policy_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir).select(F.struct("trace_id", "seq", "step_id").alias("doc_id"), F.col("command").alias("text"))
    return findings.concepts_in(s, CONCEPTS).select("doc_id.*", "concept")


@query(
    f"""{DUCKDB}, cwds AS (SELECT DISTINCT concat(cwd, '/src') AS cwd, cwd AS up FROM steps WHERE cwd IS NOT NULL), docs AS (SELECT DISTINCT cwd AS dir, concat(cwd, '/POLICY.md') AS path, 'local' AS scope FROM steps WHERE cwd IS NOT NULL
 UNION SELECT '/work', '/work/POLICY.md', 'local' FROM steps UNION SELECT '', '/etc/POLICY.md', 'global' FROM steps),
 found AS (SELECT c.cwd, d.path, -1 AS o FROM cwds c, docs d WHERE scope = 'global' UNION ALL SELECT c.cwd, d.path, CASE WHEN d.dir = c.up THEN 1 ELSE 2 END FROM cwds c JOIN docs d ON scope = 'local' AND d.dir IN (c.up, '/work'))
 SELECT cwd, path, row_number() OVER (PARTITION BY cwd ORDER BY o, path) AS rank FROM found"""
)
def f14_policy_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir).where("cwd IS NOT NULL")
    docs = s.selectExpr("cwd AS dir", "concat(cwd, '/POLICY.md') AS path", "'local' AS scope").union(s.selectExpr("'/work'", "'/work/POLICY.md'", "'local'")).union(s.selectExpr("''", "'/etc/POLICY.md'", "'global'")).distinct()
    return findings.policy_in_force(s.select(F.concat("cwd", F.lit("/src")).alias("cwd")), docs)


TRIP = "CASE " + " ".join(f"WHEN tool_name = 'Bash' AND regexp_matches(command, '{p}') THEN '{n}'" for n, p in (("destructive-rm", "\\brm\\s+-rf"), ("force-push", "git push --force"), ("env-write", ">> \\.env$"))) + " END"
TIMELINE = f"""own AS (SELECT *, {TRIP} AS trip, coalesce(tool_name IN ('Edit', 'NotebookEdit'), false) AS edit FROM steps WHERE NOT (action_type = 'env_effect' AND NOT is_error)),
 isl AS (SELECT *, sum(CASE WHEN edit AND coalesce(pe, false) THEN 0 ELSE 1 END) OVER (PARTITION BY trace_id ORDER BY seq) AS island FROM (SELECT *, lag(edit) OVER (PARTITION BY trace_id ORDER BY seq) AS pe FROM own)),
 timeline AS (SELECT trace_id, min(seq) AS seq, min_by(step_id, seq) AS step_id, min_by(ts, seq) AS ts, 'edit' AS kind, CASE WHEN count(DISTINCT regexp_extract(file_path, '[^/]*$')) > 1 THEN concat('Edited ', count(*), ' times across ', count(DISTINCT regexp_extract(file_path, '[^/]*$')), ' files')
 WHEN count(*) = 1 THEN concat('Edited ', min(regexp_extract(file_path, '[^/]*$'))) ELSE concat('Edited ', min(regexp_extract(file_path, '[^/]*$')), ' x', count(*)) END AS summary FROM isl WHERE edit GROUP BY trace_id, island
 UNION ALL SELECT trace_id, seq, step_id, ts, kind, summary FROM (SELECT *, CASE WHEN action_type = 'env_effect' THEN 'error' WHEN text <> '' THEN 'user' WHEN tool_name = 'Write' THEN 'write' WHEN trip IS NOT NULL THEN 'tripwire' WHEN {COMMIT} THEN 'commit' WHEN tool_name = 'Bash' AND {VERIFY} THEN 'test' WHEN tool_name = 'Task' THEN 'delegation' END AS kind,
 CASE WHEN action_type = 'env_effect' THEN concat('Error: ', tool_result) WHEN text <> '' THEN text WHEN tool_name = 'Write' THEN concat('Wrote ', file_path) WHEN trip IS NOT NULL THEN concat('Tripwire ', trip, ': ', command) WHEN {COMMIT} THEN concat('Commit: ', command) WHEN tool_name = 'Bash' THEN concat('Ran: ', command) ELSE concat('Delegated via ', tool_name, ': ', coalesce(nullif(json_extract_string(payload, '$.description'), ''), tool_name)) END AS summary FROM isl WHERE NOT edit) WHERE kind IS NOT NULL)"""


@query(f"{DUCKDB}, {TIMELINE} SELECT * FROM timeline")
def r1_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.timeline(steps(spark, sf_dir))


@query("SELECT conv_id, turn, CASE WHEN length(t) <= 100 THEN t ELSE concat(regexp_replace(substring(t, 1, 99), ' +$', ''), '…') END AS summary FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)")
def r3_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", report.clipped(F.col("text")).alias("summary"))


TURNS_OF = """turned AS (SELECT *, sum(CASE WHEN text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY seq) AS turn FROM steps),
 used AS (SELECT trace_id, turn, string_agg(concat(tool_name, '=', n), ',' ORDER BY tool_name) AS followed_by FROM (SELECT trace_id, turn, tool_name, count(*) AS n FROM turned WHERE action_type = 'tool_call' GROUP BY ALL) GROUP BY ALL)"""


@query(f"{DUCKDB}, {TURNS_OF} SELECT o.trace_id, CAST(o.turn AS BIGINT) AS turn, o.step_id, o.text AS user_text, coalesce(used.followed_by, '') AS followed_by FROM turned o LEFT JOIN used USING (trace_id, turn) WHERE o.text <> ''")
def r4_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = F.array_join(F.transform(F.array_sort(F.map_entries("followed_by")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return report.turns(steps(spark, sf_dir)).select("trace_id", "turn", "step_id", "user_text", tools.alias("followed_by"))


HEADER = "SELECT trace_id, max(cwd) AS cwd, count(*) AS n_steps, count(*) FILTER (WHERE action_type = 'tool_call') AS n_tool_calls, count(*) FILTER (WHERE text <> '') AS n_user_turns, round((epoch_us(max_by(ts, seq)) - epoch_us(min_by(ts, seq))) / 1e6, 6) AS duration_s FROM steps GROUP BY 1"


@query(f"{DUCKDB} {HEADER}")
def r5_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.header(steps(spark, sf_dir)).select("trace_id", "cwd", "n_steps", "n_tool_calls", "n_user_turns", F.round("duration_s", 6).alias("duration_s"))


@query(
    f"""{DUCKDB}, {TIMELINE}, {TURNS_OF}, found AS ({ALL}), h AS ({HEADER}),
 a AS (SELECT trace_id, string_agg(concat('- `', step_id, '` **', kind, '** (', strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'Z) — ', summary), chr(10) ORDER BY seq) AS x FROM timeline GROUP BY 1),
 fl AS (SELECT *, concat('- **', rule_id, '** — ', title, ' (steps: ', replace(step_ids, ',', ', '), ') — ', shown) AS line,
  CASE split_part(rule_id, ':', 1) WHEN 'scope-escape' THEN 0 WHEN 'churn-burst' THEN 1 WHEN 'commit-without-tests' THEN 2 WHEN 'tripwire' THEN 3 WHEN 'error-cluster' THEN 4 WHEN 'delegation-unobserved' THEN 5 ELSE 6 END AS o,
  CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS sev FROM found),
 fg AS (SELECT trace_id, sev, concat('### ', upper(max(severity)), chr(10), string_agg(line, chr(10) ORDER BY o, seq, rule_id)) AS g FROM fl GROUP BY ALL),
 b AS (SELECT trace_id, string_agg(g, chr(10) || chr(10) ORDER BY sev) AS x FROM fg GROUP BY 1),
 n AS (SELECT trace_id, concat(count(*), ' finding(s): ', count(*) FILTER (WHERE sev = 0), ' high, ', count(*) FILTER (WHERE sev = 1), ' medium, ', count(*) FILTER (WHERE sev = 2), ' low, ', count(*) FILTER (WHERE sev = 3), ' info.') AS x FROM fl GROUP BY 1),
 c AS (SELECT o.trace_id, string_agg(concat('### Turn: "', o.text, '"', chr(10), coalesce('- ' || replace(replace(used.followed_by, ',', chr(10) || '- '), '=', ': '), '- No tool calls followed this turn.')), chr(10) || chr(10) ORDER BY o.turn) AS x
  FROM turned o LEFT JOIN used USING (trace_id, turn) WHERE o.text <> '' GROUP BY 1),
 p AS (SELECT cwd, string_agg(concat('- **', scope, '** `', path, '` — ', title), chr(10) ORDER BY o) AS x FROM (SELECT DISTINCT cwd, 'project' AS scope, concat(cwd, '/POLICY.md') AS path, 'Rules of the house' AS title, 1 AS o FROM steps WHERE cwd IS NOT NULL
  UNION SELECT DISTINCT cwd, 'global', '/etc/POLICY.md', '(no heading)', 0 FROM steps WHERE cwd IS NOT NULL) GROUP BY 1)
 SELECT h.trace_id, concat_ws(chr(10), '# Session post-mortem', '', '## Summary', '', '| Field | Value |', '| --- | --- |', concat('| Session ID | ', h.trace_id, ' |'), concat('| Project (cwd) | ', coalesce(h.cwd, '(unknown)'), ' |'), '| Git branch | main |', '| Version | 1 |',
  '| Duration (s) | whole |', concat('| Steps | ', n_steps, ' |'), concat('| Tool calls | ', n_tool_calls, ' |'), concat('| User turns | ', n_user_turns, ' |'), '', '## Policy context', '', coalesce(p.x, 'No policy files were discovered for this session''s working directory.'), '', '## Timeline', '', coalesce(a.x, 'No notable events.'), '',
  '## Findings', '', coalesce(n.x, '0 finding(s): 0 high, 0 medium, 0 low, 0 info.'), '', coalesce(b.x, 'No findings.'), '', '## Instruction compliance', '', coalesce(c.x, 'No user turns recorded.'), '', '## Not checked', '',
  CASE WHEN h.cwd IS NULL THEN '- **scope-escape**: no config.roots and no trace.metadata[''cwd''] available to establish allowed write roots' ELSE 'All rules ran.' END, '') AS markdown
 FROM h LEFT JOIN a USING (trace_id) LEFT JOIN b USING (trace_id) LEFT JOIN c USING (trace_id) LEFT JOIN n USING (trace_id) LEFT JOIN p ON p.cwd = h.cwd"""
)
def r6_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = arranged(findings.marked(steps(spark, sf_dir)), ["trace_id"])
    cwds = s.where("cwd IS NOT NULL").selectExpr("cwd").distinct()
    docs = cwds.selectExpr("cwd AS dir", "concat(cwd, '/POLICY.md') AS path", "'project' AS scope", "'Rules of the house' AS title").union(spark.range(1).selectExpr("'' AS dir", "'/etc/POLICY.md' AS path", "'global' AS scope", "CAST(NULL AS STRING) AS title"))
    policies = findings.policy_in_force(cwds, docs).join(docs.select("path", "scope", "title"), "path")
    metadata = s.where("cwd IS NOT NULL").groupBy("trace_id").agg(F.min("cwd").alias("cwd")).join(s.select("trace_id").distinct(), "trace_id", "right").selectExpr("trace_id", "cwd", "'main' AS branch", "'1' AS version")
    out = report.rendered(s, findings.analyze(s), metadata, findings.not_checked(s), policies)
    return out.withColumn("markdown", F.regexp_replace("markdown", r"(?m)^\| Duration \(s\) \| [-0-9.E]+ \|$", "| Duration (s) | whole |"))  # floats print differently


JACCARD = f"""{DUCKDB}, tok AS (SELECT *, list_distinct(regexp_extract_all(lower(declared_intent), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(concat('name ', tool_name, ' input ', payload)), '[a-z0-9]+')) AS b FROM steps WHERE declared_intent IS NOT NULL),
 sim AS (SELECT *, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS s FROM tok)"""


@query(f"{JACCARD} SELECT trace_id, seq, step_id, round(s, 9) AS similarity, s < 0.3 AS flagged, CASE WHEN s < 0.3 THEN 'goal_deviation' ELSE 'faithful' END AS label FROM sim")
def d1_jaccard_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.score_jaccard(payload_text(steps(spark, sf_dir))).drop("agent_id").withColumn("similarity", rounded("similarity"))


@query(
    f"""{JACCARD} SELECT t.trace_id, round(coalesce(1 - avg(s), 0), 9) AS drift_score, count(s) AS n_scored, coalesce(string_agg(step_id, ',' ORDER BY seq) FILTER (WHERE s < 0.3), '') AS flagged_steps, count(*) FILTER (WHERE s < 0.3) AS n_deviation, count(*) FILTER (WHERE s >= 0.3) AS n_faithful
 FROM (SELECT DISTINCT trace_id FROM steps) t LEFT JOIN (SELECT * FROM sim WHERE agent_id IS NULL) USING (trace_id) GROUP BY 1"""
)
def d1_trace_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = payload_text(steps(spark, sf_dir))
    d = drift.trace_drift(s, drift.score_jaccard(drift.parent_steps(s)), method="jaccard")
    n = {k: F.coalesce(F.try_element_at("taxonomy_counts", F.lit(k)), F.lit(0)).cast("long") for k in ("goal_deviation", "faithful")}
    return d.select("trace_id", rounded("drift_score").alias("drift_score"), F.col("n_scored").cast("long").alias("n_scored"), F.array_join("flagged_steps", ",").alias("flagged_steps"), n["goal_deviation"].alias("n_deviation"), n["faithful"].alias("n_faithful"))


@query(f"{JACCARD} SELECT trace_id, agent_id, round(1 - avg(s), 9) AS drift_score, count(*) AS n_scored FROM sim WHERE agent_id <> '' GROUP BY ALL")
def d10_delegate_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.delegate_drift(drift.score_jaccard(payload_text(steps(spark, sf_dir)))).withColumn("drift_score", rounded("drift_score"))


@query(f"{JACCARD} SELECT trace_id, round(1 - avg(s), 9) AS drift_score FROM sim WHERE agent_id IS NULL GROUP BY 1 HAVING 1 - avg(s) > 0.62")
def d13_over_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = payload_text(steps(spark, sf_dir))
    d = drift.trace_drift(s, drift.score_jaccard(drift.parent_steps(s)), method="jaccard")
    return drift.over_threshold(d, 0.62).select("trace_id", rounded("drift_score").alias("drift_score"))


GATE = f"{JACCARD}, gate AS (SELECT *, CASE WHEN 0.6 - s >= s AND 0.6 - s >= 0.4 THEN 'goal_deviation' WHEN s >= 0.4 THEN 'faithful' ELSE 'neutral' END AS gate, greatest(0.6 - s, 0.0) AS top FROM sim)"


@query(f"{GATE} SELECT trace_id, seq, step_id, gate AS label, gate = 'goal_deviation' AS flagged FROM gate")
def d4_nli_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.score_nli(payload_text(steps(spark, sf_dir))).select("trace_id", "seq", "step_id", "label", "flagged")


@query(
    f"""{GATE}, cand AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY top DESC, seq) AS rank FROM gate WHERE gate = 'goal_deviation')
 SELECT trace_id, seq, step_id, CASE WHEN rank > 100 THEN 'goal_deviation' WHEN k % 3 = 0 THEN 'faithful' WHEN k % 3 = 1 THEN 'undeclared_goal' ELSE 'neutral' END AS label, rank <= 100 AS judged, CASE WHEN rank > 100 OR k % 3 = 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, rank <= 100 AND k % 3 <> 1 AS overturned_gate FROM cand
 UNION ALL SELECT trace_id, seq, step_id, gate, false, 'LOW', false FROM gate WHERE gate <> 'goal_deviation'"""
)
def d5_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = payload_text(steps(spark, sf_dir))
    verdicts = s.where("k % 3 <> 2").selectExpr("trace_id", "step_id", "CASE WHEN k % 3 = 0 THEN 'faithful' ELSE 'undeclared_goal' END AS label", "'LOW' AS severity", "'judge' AS reasoning", "'n/a' AS evidence")
    return drift.score_two_stage(s, verdicts).select("trace_id", "seq", "step_id", "label", "judged", "severity", "overturned_gate")


@query(
    f"""{GATE}, cand AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY top DESC, seq) AS rank FROM gate WHERE gate = 'goal_deviation'), l AS (SELECT trace_id, rank, seq, step_id, rank > 3 OR k % 3 = 1 AS bad FROM cand),
 n AS (SELECT trace_id, count(*) AS n FROM gate GROUP BY 1) SELECT t.trace_id, round(coalesce(count(*) FILTER (WHERE bad) / max(n.n), 0), 9) AS drift_score, coalesce(string_agg(step_id, ',' ORDER BY rank) FILTER (WHERE bad), '') AS flagged_steps
 FROM (SELECT DISTINCT trace_id FROM steps) t LEFT JOIN n USING (trace_id) LEFT JOIN l USING (trace_id) GROUP BY 1"""
)
def d6_judged_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = payload_text(steps(spark, sf_dir))
    verdicts = s.where("k % 3 <> 2").selectExpr("trace_id", "step_id", "CASE WHEN k % 3 = 0 THEN 'faithful' ELSE 'undeclared_goal' END AS label", "'LOW' AS severity", "'judge' AS reasoning", "'n/a' AS evidence")
    d = drift.trace_drift(steps(spark, sf_dir), drift.score_two_stage(s, verdicts, budget=3))
    return d.select("trace_id", rounded("drift_score").alias("drift_score"), F.array_join("flagged_steps", ",").alias("flagged_steps"))


@query("SELECT event_id, CASE k % 4 WHEN 0 THEN 'faithful' WHEN 1 THEN 'goal_deviation' ELSE 'neutral' END AS label, CASE k % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN k % 4 < 2 AND k < 50 THEN k / 50 ELSE 0.0 END AS confidence, CASE WHEN k % 4 = 0 THEN 'seen' ELSE 'n/a' END AS evidence FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def d7_parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k")
    reply = """CASE k % 4 WHEN 0 THEN concat('```json\\n{"label":"faithful","severity":"odd","confidence":', IF(k < 50, k / 50, 7), ',"evidence":"seen"}\\n```') WHEN 1 THEN concat('so: {"label":"goal_deviation","severity":"HIGH","confidence":', IF(k < 50, k / 50, -1), '} end')
        WHEN 2 THEN '{"label":"other","evidence":""}' ELSE 'no object' END AS reply"""
    return drift.parsed_replies(ev.selectExpr("event_id", reply)).select("event_id", "label", "severity", "confidence", "evidence")


@query(f"{DUCKDB} SELECT trace_id, seq, CASE WHEN k % 13 = 0 THEN 'instruction_noncompliance' WHEN k % 5 = 0 THEN 'goal_deviation' WHEN k % 7 = 0 THEN 'undeclared_goal' WHEN k % 2 = 0 THEN 'faithful' WHEN k % 3 = 0 THEN 'benign_elaboration' ELSE 'neutral' END AS label FROM steps")
def d8_rubric_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir).selectExpr("trace_id", "seq", "k % 13 = 0 AS violates", "k % 5 = 0 AS contradicts", "k % 7 = 0 AS new_goal", "k % 2 = 0 AS advances", "k % 3 = 0 AS instrumental")
    return s.select("trace_id", "seq", drift.label_of_rubric().alias("label"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.records(raw_lines(spark, sf_dir))


@query(f"{DUCKDB} SELECT record_type AS type, count(*) AS n FROM steps GROUP BY 1")
def c1_record_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.record_types(_records(spark, sf_dir))


@query(f"{DUCKDB} SELECT tool_name, count(*) AS n FROM steps WHERE record_type = 'assistant' AND tool_name IS NOT NULL GROUP BY 1")
def c2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.tool_calls(_records(spark, sf_dir))


@query(
    f"""{DUCKDB} SELECT 'sessions' AS metric, '' AS key, count(DISTINCT trace_id) FILTER (WHERE agent_id IS NULL) AS n FROM steps UNION ALL SELECT 'record_type', record_type, count(*) FROM steps WHERE agent_id IS NULL GROUP BY 2
 UNION ALL SELECT 'subagent_records', '', count(*) FROM steps WHERE agent_id IS NOT NULL HAVING count(*) > 0 UNION ALL SELECT 'delegate_tool', tool_name, count(*) FROM steps WHERE agent_id IS NOT NULL AND record_type = 'assistant' AND tool_name IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'subagent_transcripts', '', count(DISTINCT concat(trace_id, agent_id)) FILTER (WHERE agent_id IS NOT NULL) FROM steps UNION ALL SELECT 'sessions_with_subagents', '', count(DISTINCT trace_id) FILTER (WHERE agent_id IS NOT NULL) FROM steps
 UNION ALL SELECT 'sessions_with_plan_store', '', count(DISTINCT trace_id) FILTER (WHERE agent_id IS NULL AND u % 3 = 0) FROM steps UNION ALL SELECT 'unreadable', concat('/logs/', trace_id, '.jsonl'), 1 FROM (SELECT DISTINCT trace_id FROM steps WHERE u % 7 = 0)"""
)
def c3_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, own = raw_lines(spark, sf_dir, "agent_id"), spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    stores = own.where("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("session"))
    return corpus.statistics(sessions.records(lines), stores, own.where("user_id % 7 = 0").selectExpr("concat('/logs/', user_id, '.jsonl') AS path"))


PAIRING = """pairing AS (SELECT trace_id AS session, count(*) FILTER (WHERE record_type = 'assistant' AND action_type = 'tool_call') AS calls, count(*) FILTER (WHERE record_type = 'user' AND action_type = 'env_effect') AS results, count(*) FILTER (WHERE record_type = 'assistant' AND action_type = 'tool_call' AND (last IS NULL OR seq > last)) AS "trailing", avg(CASE WHEN record_type = 'mystery' THEN 1 ELSE 0 END) AS share FROM (SELECT *, max(CASE WHEN record_type = 'user' THEN seq END) OVER (PARTITION BY trace_id) AS last FROM steps) GROUP BY 1)"""


@query(f"""{DUCKDB}, {PAIRING} SELECT session, calls, results, "trailing", calls - results - "trailing" AS unresolved FROM pairing""")
def c4_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pairing(_records(spark, sf_dir))


@query(f"{DUCKDB}, {PAIRING} SELECT session, round(share, 9) AS share FROM pairing")
def c5_unknown_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.unknown_share(_records(spark, sf_dir)).withColumn("share", rounded("share"))


@query(
    f"""{DUCKDB}, own AS (SELECT trace_id, agent_id, max(u) AS u, avg(CASE WHEN record_type = 'mystery' THEN 1 ELSE 0 END) AS share FROM steps WHERE agent_id IS NOT NULL GROUP BY ALL),
 j AS (SELECT trace_id AS session, agent_id, CASE WHEN u % 5 = 0 THEN 'no-meta' WHEN agent_id = 'a0' AND u % 2 = 0 THEN 'no-join-key' WHEN share > 0.05 THEN 'unknown-types' END AS breach FROM own) SELECT * FROM j WHERE breach IS NOT NULL"""
)
def c6_subagent_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raw_lines(spark, sf_dir, "agent_id", "u").where("agent_id IS NOT NULL")
    meta = lines.where("u % 5 <> 0").selectExpr("session", "agent_id", "CASE WHEN NOT (agent_id = 'a0' AND u % 2 = 0) THEN 't1' END AS tool_use_id").distinct()
    return corpus.subagent_breaches(lines, meta, sessions.records(lines))


@query(f"""{DUCKDB}, {PAIRING} SELECT session, 'unresolved-calls' AS breach FROM pairing WHERE calls - results - "trailing" > 0 UNION ALL SELECT session, 'unknown-types' FROM pairing WHERE share > 0.05 UNION ALL SELECT NULL, 'no-plan-anchor' FROM pairing HAVING count(*) >= 20""")
def c7_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.breaches(_records(spark, sf_dir))


@query(f"""{DUCKDB}, {PAIRING} SELECT session FROM pairing WHERE share <= 0.05""")
def c8_healthy_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return corpus.healthy(r.select("session").distinct(), corpus.breaches(r).where("breach = 'unknown-types'"))


@query(f"{DUCKDB} SELECT trace_id, round(avg(CASE WHEN declared_intent IS NOT NULL THEN 1 ELSE 0 END), 9) AS coverage, count(*) AS n FROM steps WHERE actor = 'agent' GROUP BY 1")
def c9_intent_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.intent_coverage(steps(spark, sf_dir)).withColumn("coverage", rounded("coverage"))


@query(f"{DUCKDB} SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS BIGINT) AS seq, step_id, actor, action_type, tool_name, file_path, command, text, tool_result, is_error, CASE WHEN actor = 'agent' THEN declared_intent END AS declared_intent, delegation_unobserved, date_trunc('millisecond', ts) AS ts FROM steps WHERE record_type <> 'mystery'")
def n3_normalised_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sessions.normalised(raw_lines(spark, sf_dir))
    return own.select("trace_id", "seq", "step_id", "actor", "action_type", "tool_name", "file_path", "command", "text", "tool_result", "is_error", "declared_intent", "delegation_unobserved", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"{TURNS} SELECT trace_id, seq, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS plan FROM turns")
def n8_standing_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).withColumnRenamed("trace_id", "session").withColumnRenamed("seq", "line")
    act = "array(named_struct('kind', 'set', 'subject', CAST(NULL AS STRING), 'status', CAST(NULL AS STRING), 'task', CAST(NULL AS INT), 'said', text)) AS acts"
    plans = sessions.standing_plans(t.where("role = 'assistant'").selectExpr("session", "line", act)).withColumn("touched", F.lit(True))
    before = Window.partitionBy("session").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last(F.when(F.col("touched"), F.struct("plan")), ignorenulls=True).over(before)["plan"]
    return t.join(plans, ["session", "line"], "left").select(F.col("session").alias("trace_id"), F.col("line").alias("seq"), carried.alias("plan"))


@query(f"{DUCKDB} SELECT trace_id, max(cwd) AS cwd, concat('session-log:', trace_id) AS config FROM steps WHERE record_type <> 'mystery' GROUP BY trace_id")
def n2_trace_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.trace_metadata(raw_lines(spark, sf_dir)).select("trace_id", "cwd", "config")


SEEDS = "CASE u % 9 WHEN 0 THEN 'distractor' WHEN 1 THEN 'scope-narrow' WHEN 2 THEN 'format-strict' WHEN 3 THEN 'plan-late' WHEN 4 THEN 'issue-count' WHEN 5 THEN 'priority-constraint' WHEN 6 THEN 'false-scope' WHEN 7 THEN 'scope-extra' ELSE 'baseline' END"
BENCH_TOOL = "CASE tool_name WHEN 'Read' THEN 'ReadFile' WHEN 'Write' THEN CASE WHEN k % 4 = 0 THEN 'WriteFile' ELSE 'Other' END WHEN 'Task' THEN 'TodoWrite' WHEN 'Bash' THEN 'Report' END"
TRUTH = f"""bench AS (SELECT *, {SEEDS} AS seed, {BENCH_TOOL} AS tool FROM steps),
 rep AS (SELECT trace_id, min_by(step_id, seq) AS step_id, min_by(k, seq) AS rk FROM bench WHERE tool = 'Report' GROUP BY 1), wr AS (SELECT trace_id, min_by(step_id, seq) AS wstep, min_by(k, seq) AS wk FROM bench WHERE tool = 'WriteFile' GROUP BY 1),
 pr AS (SELECT rep.*, rk % 7 AS n, wstep, wk, coalesce(wk % 3 + 2 = rk % 7, false) AS headed, list_transform(range(1, CAST(rk % 7 AS BIGINT) + 1), lambda i: [4, 3, 2, 1][1 + (i * (1 + (rk % 2) * 2)) % 4]) AS ranks FROM rep LEFT JOIN wr USING (trace_id)),
 hits AS (SELECT trace_id, seed, min_by(step_id, seq) AS step_id FROM bench WHERE (seed = 'distractor' AND tool = 'ReadFile' AND k % 8 = 0) OR (seed = 'scope-narrow' AND tool = 'ReadFile' AND k % 8 = 4) OR (seed = 'scope-extra' AND tool = 'ReadFile' AND k % 8 = 2) OR (seed = 'format-strict' AND tool = 'WriteFile') OR (seed = 'plan-late' AND tool = 'TodoWrite') GROUP BY ALL
 UNION ALL SELECT trace_id, 'issue-count', step_id FROM pr WHERE n > 3
 UNION ALL SELECT trace_id, 'priority-constraint', CASE WHEN headed THEN wstep ELSE step_id END FROM pr WHERE n >= 2 AND CASE WHEN headed THEN wk % 8 = 0 WHEN rk % 5 = 0 THEN false ELSE len(list_filter(range(1, CAST(n AS BIGINT)), lambda i: ranks[i + 1] > ranks[i])) > 0 END
 UNION ALL SELECT trace_id, 'false-scope', step_id FROM pr WHERE n >= 1 AND rk % 3 = 0 AND rk % 4 <> 0),
 truth AS (SELECT t.trace_id, t.seed, hits.step_id IS NOT NULL AS occurred, hits.step_id FROM (SELECT DISTINCT trace_id, seed FROM bench) t LEFT JOIN hits USING (trace_id, seed))"""


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = "element_at(array('critical', 'high', 'medium', 'low'), CAST((i * (1 + (k % 2) * 2)) % 4 AS INT) + 1)"
    problem = f"concat(CASE WHEN k % 5 = 0 THEN 'no word' ELSE concat('A ', {word}, ' thing') END, CASE WHEN k % 4 = 0 THEN ' is missing' ELSE '' END)"
    issue = f"named_struct('file', CASE WHEN i = 1 AND k % 3 = 0 THEN 'src/Config.py' ELSE 'a.py' END, 'line_range', '1', 'problem', {problem}, 'recommendation', 'r')"
    issues = f"CASE WHEN k % 7 = 0 THEN CAST(array() AS {evaluate.ISSUE}) ELSE transform(sequence(1, CAST(k % 7 AS INT)), i -> {issue}) END"
    heading = "concat('## ', i, '. ', element_at(CASE WHEN k % 8 = 0 THEN array('Low', 'MEDIUM', 'High', 'Critical') ELSE array('Critical', 'High', 'Medium', 'Low') END, i), ' thing')"
    content = f"concat('All of it\\n', array_join(transform(sequence(1, CAST(k % 3 + 2 AS INT)), i -> {heading}), '\\nmore\\n'))"
    return steps(spark, sf_dir).drop("file_path", "payload").selectExpr(
        "*",
        f"{SEEDS} AS seed",
        f"{BENCH_TOOL} AS tool",
        "CASE WHEN k % 8 = 0 THEN '/x/unrelated_script.py' WHEN k % 8 = 4 THEN 'api.py/' WHEN k % 8 = 2 THEN '/z/__init__.py' ELSE '/y/other.py' END AS path",
        f"CASE tool_name WHEN 'Bash' THEN to_json(named_struct('issues', {issues})) WHEN 'Write' THEN to_json(named_struct('path', 'out.md', 'content', {content})) END AS payload",
    ).drop("tool_name").withColumnRenamed("tool", "tool_name")


@query(f"{DUCKDB}, {TRUTH} SELECT trace_id, seed, occurred, step_id FROM truth")
def e6_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _bench(spark, sf_dir)
    return evaluate.ground_truth(s, s.select("trace_id", "seed").distinct())


LOW = "greatest(0.0, ((x / n) + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt((x / n) * (1 - x / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n))"
HIGH = "least(1.0, ((x / n) + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt((x / n) * (1 - x / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n))"


@query(
    f"""{JACCARD}, {TRUTH}, a AS (SELECT trace_id, bool_or(s < 0.3) AS any_flag FROM sim GROUP BY 1),
 o AS (SELECT t.*, coalesce(f.s < 0.3, false) AS hit, coalesce(f.s < 0.3, false) AND t.seed = 'format-strict' AS wanted, NOT t.occurred AND coalesce(any_flag, false) AS fp FROM truth t LEFT JOIN sim f ON f.trace_id = t.trace_id AND f.step_id = t.step_id LEFT JOIN a ON a.trace_id = t.trace_id),
 g AS (SELECT seed, count(*) AS sessions, count(*) FILTER (WHERE occurred) AS n_occurred, count(*) FILTER (WHERE occurred AND hit) AS n_hit, count(*) FILTER (WHERE occurred AND wanted) AS n_label, count(*) FILTER (WHERE fp) AS n_false, count(*) FILTER (WHERE NOT occurred) AS n_clean FROM o GROUP BY ROLLUP (seed))
 SELECT coalesce(seed, 'ALL') AS seed, sessions, n_occurred, n_hit, n_label, n_false, n_clean, CASE WHEN n > 0 THEN round({LOW}, 9) ELSE -1 END AS false_low, CASE WHEN n > 0 THEN round({HIGH}, 9) ELSE -1 END AS false_high FROM (SELECT *, n_false::DOUBLE AS x, n_clean::DOUBLE AS n FROM g)"""
)
def e7_cross_tabulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bench(spark, sf_dir)
    table = evaluate.cross_tabulated(evaluate.ground_truth(b, b.select("trace_id", "seed").distinct()), drift.score_jaccard(payload_text(steps(spark, sf_dir))))
    bound = lambda c: F.when(F.isnan(c), F.lit(-1.0)).otherwise(F.round(c, 9)).alias(c)
    return table.select(F.coalesce("seed", F.lit("ALL")).alias("seed"), F.col("n").alias("sessions"), "n_occurred", "n_hit", "n_label", "n_false", "n_clean", bound("false_low"), bound("false_high"))


@query(f"{GATE}, cand AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY top DESC, seq) AS rank FROM gate WHERE gate = 'goal_deviation'), x AS (SELECT CASE WHEN rank > 3 THEN 'gate-unjudged' ELSE 'judge' END AS decided_by, CASE WHEN rank > 3 THEN 'goal_deviation' ELSE 'faithful' END AS label FROM cand UNION ALL SELECT 'gate', gate FROM gate WHERE gate <> 'goal_deviation') SELECT decided_by, label, count(*) AS n FROM x GROUP BY ALL")
def e9_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = payload_text(steps(spark, sf_dir))
    verdicts = s.selectExpr("trace_id", "step_id", "'faithful' AS label", "'LOW' AS severity", "'judge says so' AS reasoning", "'n/a' AS evidence")
    return evaluate.attribution(drift.score_two_stage(s, verdicts, budget=3))


@query(f"{JACCARD} SELECT concat('m', u % 4) AS model, {SEEDS} AS seed, count(*) FILTER (WHERE s < 0.3) AS goal_deviation, count(*) FILTER (WHERE s >= 0.3) AS faithful FROM sim GROUP BY ALL")
def e10_summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = payload_text(steps(spark, sf_dir))
    of = s.selectExpr("trace_id", "concat('m', CAST(u % 4 AS STRING)) AS model", f"{SEEDS} AS seed").distinct()
    return evaluate.summary_table(drift.score_jaccard(s).join(of, "trace_id"), ["goal_deviation", "faithful"])


@query(f"{DUCKDB} SELECT trace_id, seq, step_id, first_value(declared_intent IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS declared_goal, CASE WHEN file_path IS NULL THEN 0 ELSE 2 END AS n_facts, CASE WHEN file_path IS NOT NULL THEN 'again' END AS fact FROM steps")
def b1_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = lambda i, e: f"named_struct('identifier', {i}, 'excerpt', {e})"
    used = f"CASE WHEN file_path IS NULL THEN CAST(array() AS array<struct<identifier:string,excerpt:string>>) ELSE array({ref('file_path', 'tool_name')}, {ref(chr(39) + 'x' + chr(39), 'tool_name')}, {ref('file_path', chr(39) + 'again' + chr(39))}) END AS context_used"
    b = attest.beliefs(steps(spark, sf_dir).selectExpr("*", used)).join(steps(spark, sf_dir).select("trace_id", "seq", "file_path"), ["trace_id", "seq"])
    return b.select("trace_id", "seq", "step_id", "declared_goal", F.size("salient_facts").cast("long").alias("n_facts"), F.try_element_at("salient_facts", F.coalesce("file_path", F.lit(""))).alias("fact"))


@query(f"{DUCKDB} SELECT trace_id, coalesce(string_agg(declared_intent, '|' ORDER BY seq), '') AS active_plan FROM steps GROUP BY 1")
def b1_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attest.plans(steps(spark, sf_dir)).select("trace_id", F.array_join("active_plan", "|").alias("active_plan"))


SHOWN = """concat('{"command":', coalesce('"' || command || '"', 'null'), ',"file_path":', coalesce('"' || file_path || '"', 'null'), ',"tool_name":', coalesce('"' || tool_name || '"', 'null'), '}')"""


@query(
    f"""{DUCKDB} SELECT trace_id, count(*) FILTER (WHERE k % 10 = 0) AS n_diff, min_by(step_id, seq) FILTER (WHERE k % 10 = 0) AS first_divergence,
 concat('[', coalesce(string_agg(concat('{{"step_id": "', step_id, '", "original_action": {{"type": "', action_type, '", "payload": ', {SHOWN}, '}}, "alternate_action": {{"type": "', action_type, '", "payload": {{"tool_name":"None"}}}}}}'), ', ' ORDER BY seq) FILTER (WHERE k % 10 = 0), ''), ']') AS diffs FROM steps GROUP BY 1"""
)
def b2_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir).withColumn("payload", F.to_json(F.struct("tool_name", "file_path", "command"), {"ignoreNullFields": "false"}))
    other = s.select("trace_id", "step_id", "action_type", F.when(F.col("k") % 10 == 0, F.lit('{"tool_name": "None"}')).otherwise(F.to_json(F.struct("command", "file_path", "tool_name"), {"ignoreNullFields": "false"})).alias("payload"))
    return attest.replayed(s, other)


@query(f"{DUCKDB} SELECT count(*) AS step_count, string_agg(DISTINCT event_flow, ',' ORDER BY event_flow) AS flow_types, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT trace_id) AS trace_count FROM (SELECT *, CASE WHEN u % 2 = 0 THEN 'chat' ELSE 'agentic' END AS event_flow FROM steps)")
def a1_trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir).withColumn("flow_type", F.when(F.col("u") % 2 == 0, "chat").otherwise("agentic"))
    return attest.trace_summary(s).withColumn("flow_types", F.array_join("flow_types", ","))


def _sealed_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir)
    scored = drift.score_jaccard(drift.parent_steps(payload_text(s)))
    return attest.packs(drift.trace_drift(s, scored, method="jaccard"), s)


@query(
    f"""{JACCARD}, n AS (SELECT trace_id, count(*) AS step_count, min(ts) AS first_ts FROM steps GROUP BY 1) SELECT n.trace_id, round(coalesce(1 - avg(s), 0), 9) AS drift_score, count(*) FILTER (WHERE s < 0.3) AS n_flagged, max(step_count) AS step_count, strftime(max(first_ts), '%Y-%m-%dT%H:%M:%S') AS first_ts, true AS sealed
 FROM n LEFT JOIN (SELECT * FROM sim WHERE agent_id IS NULL) USING (trace_id) GROUP BY 1"""
)
def a2_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = lambda path, kind: F.get_json_object("manifest", f"$.{path}").cast(kind)
    flagged = F.size(F.from_json(F.get_json_object("manifest", "$.drift_metrics.flagged_steps"), "array<string>")).cast("long")
    return _sealed_packs(spark, sf_dir).select(
        "trace_id", rounded(field("drift_metrics.drift_score", "double")).alias("drift_score"), flagged.alias("n_flagged"), field("trace_summary.step_count", "long").alias("step_count"),
        F.substring(field("trace_summary.time_range[0]", "string"), 1, 19).alias("first_ts"), (F.sha2("manifest", 256) == F.col("digest")).alias("sealed"),
    )


@query("SELECT event_id, concat('{\"k\":', k, ',\"n\":null,\"t\":\"', event_type, '\\u00e9\"}') AS canonical FROM (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)")
def a3_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "to_json(named_struct('t', concat(event_type, 'é'), 'n', CAST(NULL AS STRING), 'k', CAST(get_json_object(props, '$.k') AS INT)), map('ignoreNullFields', 'false')) AS j")
    return ev.select("event_id", canonical_json("j").alias("canonical"))


@query(f"{DUCKDB} SELECT DISTINCT trace_id FROM steps WHERE u % 9 = 4")
def a4_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed = _sealed_packs(spark, sf_dir)
    given = sealed.select("trace_id", F.when(F.col("trace_id").cast("long") % 9 == 4, F.regexp_replace("manifest", '"step_count":', '"step_count":1')).otherwise(F.concat(F.lit(" "), F.col("manifest"))).alias("manifest"))
    return attest.tampered(given, sealed)


@query("SELECT conv_id, turn, NOT (contains(lower(text), 'the') OR contains(lower(text), 'et ')) AS passed FROM conversations")
def p1_keyword_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(F.lit("THE"), F.lit("et "))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", attest.keyword_probe(F.col("text"), words).alias("passed"))


@query("SELECT conv_id, turn, NOT (regexp_matches(text, '[0-9]{2}', 'i') OR regexp_matches(text, 'tion[.]', 'i')) AS passed FROM conversations")
def p2_regex_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", attest.regex_probe(F.col("text"), ["[0-9]{2}", "tion[.]"]).alias("passed"))


@query("WITH p AS (SELECT concat('s', user_id) AS session_id, max_by(event_type, event_id) AS agent, max_by(concat('b', event_id % 3), event_id) AS branch FROM events WHERE user_id % 3 <> 0 GROUP BY 1), q AS (SELECT DISTINCT concat('s', user_id) AS session_id, CAST(user_id % 5 AS VARCHAR) AS drift FROM events WHERE user_id % 4 <> 0) SELECT session_id, coalesce(agent, 'N/A') AS agent, coalesce(branch, 'N/A') AS branch, coalesce(drift, 'N/A') AS drift FROM p FULL JOIN q USING (session_id)")
def p3_correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("session_id", F.concat(F.lit("s"), F.col("user_id")))
    prov = ev.where("user_id % 3 <> 0").selectExpr("session_id", "event_id AS line", "event_type AS agent", "concat('b', event_id % 3) AS branch")
    return attest.correlated(prov, ev.where("user_id % 4 <> 0").selectExpr("session_id", "user_id % 5 AS drift_score").distinct())


@query(
    f"""{DUCKDB} SELECT trace_id, seq - 1 AS seq, step_id, CASE WHEN tool_name IN ('Read', 'Bash') THEN 'tool' ELSE 'agent' END AS actor, declared_intent, CASE WHEN tool_name IN ('Read', 'Bash') THEN 'tool_call' WHEN tool_name = 'Task' THEN 'state_transition' ELSE 'utterance' END AS action_type,
 CASE WHEN u % 3 = 0 THEN 'browser' ELSE 'generic' END AS flow_type, CASE WHEN tool_name = 'Read' THEN file_path END AS first_ref, CASE WHEN tool_name = 'Read' THEN rpad(concat('text ', file_path), 100, 'x') END AS excerpt, TIMESTAMP '2023-11-14 22:13:20' AS ts FROM steps"""
)
def n17_span_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir)
    kind = "CASE WHEN tool_name = 'Read' THEN 'RETRIEVER' WHEN tool_name = 'Bash' THEN 'TOOL' WHEN tool_name = 'Task' THEN 'AGENT' ELSE 'LLM' END"
    attributes = f"""map_filter(map('openinference.span.kind', {kind}, 'input.value', declared_intent, 'retrieval.documents', CASE WHEN tool_name = 'Read' THEN to_json(array(map('document.id', file_path, 'document.content', rpad(concat('text ', file_path), 150, 'x')))) END), (k, v) -> v IS NOT NULL)"""
    root = s.groupBy("trace_id", "u").agg(F.min("ts").alias("ts")).selectExpr("trace_id", "named_struct('seq', 0L, 'span_id', 'root', 'trace_id', trace_id, 'parent_span_id', CAST(NULL AS STRING), 'name', 'root', 'start_time', '2024-01-01T00:00:00Z', 'attributes', map('openinference.span.kind', CASE WHEN u % 3 = 0 THEN 'BROWSER_X' ELSE 'CHAIN' END)) AS x")
    own = s.selectExpr("trace_id", f"named_struct('seq', seq, 'span_id', step_id, 'trace_id', trace_id, 'parent_span_id', 'root', 'name', coalesce(tool_name, 'chat'), 'start_time', '1700000000000000000', 'attributes', {attributes}) AS x")
    sorted_spans = F.transform(F.array_sort(F.collect_list(F.struct(F.col("x.seq"), F.to_json("x").alias("span")))), lambda x: x["span"])
    lists = own.unionByName(root).groupBy(F.col("trace_id").alias("source")).agg(F.concat(F.lit("["), F.array_join(sorted_spans, ","), F.lit("]")).alias("value"))
    spans = adapters.exploded(lists, adapters.SPAN)
    out = adapters.span_steps(spans).where("step_id <> 'root'").join(adapters.span_traces(spans).select("source", "flow_type"), "source")
    return out.select("trace_id", (F.col("seq") - 1).alias("seq"), "step_id", "actor", "declared_intent", "action_type", "flow_type", F.get("context_used.identifier", F.lit(0)).alias("first_ref"), F.get("context_used.excerpt", F.lit(0)).alias("excerpt"), F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"{TURNS} SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS seq, CASE role WHEN 'user' THEN 'user' ELSE 'agent' END AS actor, CASE WHEN role = 'assistant' THEN nullif(text, '') END AS declared_intent, text FROM turns")
def n20_chat_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    message = F.struct("turn", "role", F.col("text").alias("content"), F.col("conv_id").cast("string").alias("session_id"))
    lists = c.groupBy(F.col("conv_id").alias("source")).agg(F.to_json(F.array_sort(F.collect_list(message))).alias("value"))
    return adapters.chat_steps(adapters.exploded(lists, adapters.MESSAGE)).select("trace_id", "seq", "actor", "declared_intent", "text")


@query(f"{DUCKDB} SELECT trace_id, seq - 1 AS seq, concat('ck-', step_id) AS step_id, declared_intent, CASE WHEN k % 4 = 0 THEN 'state_transition' WHEN k % 4 = 1 THEN 'utterance' WHEN k % 4 = 2 THEN 'tool_call' ELSE 'state_transition' END AS action_type FROM steps")
def n19_checkpoint_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = """CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('{"agent":{"messages":[{"type":"ai","content":"c', k, '"}]}}') WHEN 2 THEN '{"tools":{"rows":1}}' ELSE '{"plan":{"messages":[{"type":"human","content":"x"}]}}' END"""
    one = f"""named_struct('seq', seq, 'config', named_struct('configurable', named_struct('thread_id', trace_id)), 'checkpoint', named_struct('id', step_id, 'channel_values', to_json(named_struct('intent', declared_intent))), 'metadata', named_struct('step', seq, 'writes', {writes})) AS x"""
    lists = steps(spark, sf_dir).selectExpr("trace_id AS source", one).groupBy("source").agg(F.to_json(F.array_sort(F.collect_list("x"))).alias("value"))
    return adapters.checkpoint_steps(adapters.exploded(lists, adapters.CHECKPOINT), F.lit("2024-01-01").cast("timestamp")).select("trace_id", "seq", "step_id", "declared_intent", "action_type")

@query(
    f"""{DUCKDB}, par AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS s FROM steps WHERE record_type <> 'mystery'), n AS (SELECT trace_id, count(*) AS n FROM par GROUP BY 1),
 own AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY s) AS r FROM par WHERE tool_name = 'Task' AND k % 2 = 0)
 SELECT trace_id, CAST(s AS BIGINT) AS seq, step_id, '' AS parent_step_id, coalesce(CASE WHEN actor = 'agent' THEN declared_intent END, '') AS declared_intent, '' AS agent_id, delegation_unobserved AND k % 2 = 1 AS delegation_unobserved FROM par
 UNION ALL SELECT trace_id, CAST(n + 2 * (r - 1) + i AS BIGINT), concat('d', seq, '-', i), step_id, CASE i WHEN 2 THEN 'brief' ELSE '' END, concat('x', seq), false FROM own JOIN n USING (trace_id), (VALUES (1), (2)) AS v(i)"""
)
def n12_delegates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, s = raw_lines(spark, sf_dir), steps(spark, sf_dir).where("tool_name = 'Task' AND k % 2 = 0 AND record_type <> 'mystery'")
    meta = s.selectExpr("trace_id AS session", "concat('x', seq) AS agent_id", "concat('t', seq) AS tool_use_id", "'brief' AS description")
    line = lambda i, kind, content: f"named_struct('line', {i}, 'value', concat('{{\"type\":\"{kind}\",\"sessionId\":\"y\",\"uuid\":\"d', seq, '-{i}\",\"message\":{{\"content\":{content}}}}}'))"
    call = '[{"type":"tool_use","id":"q","name":"Bash","input":{"command":"pwd"}}]'.replace('"', '\"')
    sub = s.selectExpr("trace_id AS session", "concat('x', seq) AS agent_id", f"inline(array({line(1, 'user', chr(34) + 'please' + chr(34))}, {line(2, 'assistant', call)}))")
    own = sessions.normalised(parents, matched=meta).persist(StorageLevel.DISK_ONLY)  # for the links, the rows and their number
    links = sessions.delegate_links(own, meta).persist(StorageLevel.DISK_ONLY)
    both = sessions.with_delegates(own, sessions.delegate_steps(sub, links).persist(StorageLevel.DISK_ONLY), links)
    return both.select("trace_id", "seq", "step_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("parent_step_id", "declared_intent", "agent_id")), "delegation_unobserved")


@query(
    f"""{DUCKDB}, cr AS (SELECT trace_id, seq, concat('t', k) AS subject, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS r FROM steps WHERE tool_name = 'Write'),
 up AS (SELECT s.trace_id, s.seq, s.k % 4 + 1 AS r, CASE s.k % 3 WHEN 0 THEN 'completed' ELSE 'in_progress' END AS status FROM steps s WHERE tool_name = 'Bash' AND k % 3 < 2 AND s.k % 4 + 1 <= (SELECT count(*) FROM cr WHERE cr.trace_id = s.trace_id AND cr.seq < s.seq)),
 anchors AS (SELECT trace_id, seq FROM cr UNION ALL SELECT trace_id, seq FROM up),
 st AS (SELECT a.trace_id, a.seq, cr.r, cr.subject, coalesce(max_by(up.status, up.seq), 'pending') AS status FROM anchors a JOIN cr ON cr.trace_id = a.trace_id AND cr.seq <= a.seq LEFT JOIN up ON up.trace_id = a.trace_id AND up.r = cr.r AND up.seq <= a.seq GROUP BY ALL)
 SELECT trace_id, seq, string_agg(subject, chr(10) ORDER BY r) FILTER (WHERE status IN ('pending', 'in_progress')) AS plan FROM st GROUP BY ALL"""
)
def n9_task_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir).where("tool_name IN ('Write', 'Bash')")
    act = """array(CASE WHEN tool_name = 'Write' THEN named_struct('kind', 'create', 'subject', concat('t', k), 'status', CAST(NULL AS STRING), 'task', CAST(NULL AS INT), 'said', CAST(NULL AS STRING))
        ELSE named_struct('kind', 'update', 'subject', CAST(NULL AS STRING), 'status', CASE k % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'in_progress' END, 'task', CAST(k % 4 + 1 AS INT), 'said', CAST(NULL AS STRING)) END) AS acts"""
    return sessions.standing_plans(s.selectExpr("trace_id AS session", "seq AS line", act)).select(F.col("session").alias("trace_id"), F.col("line").alias("seq"), "plan")


@query(f"{DUCKDB} SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS BIGINT) AS seq, CASE WHEN actor = 'agent' THEN coalesce(declared_intent, CASE WHEN u % 2 = 0 THEN 'first' || chr(10) || 'tenth' END) END AS declared_intent FROM steps WHERE record_type <> 'mystery'")
def n10_plan_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raw_lines(spark, sf_dir)
    tasks = "inline(array(named_struct('n', 10, 'subject', 'tenth', 'status', 'in_progress'), named_struct('n', 2, 'subject', 'second', 'status', 'completed'), named_struct('n', 1, 'subject', 'first', 'status', 'pending')))"
    store = lines.where("CAST(session AS BIGINT) % 2 = 0").select("session").distinct().selectExpr("session", tasks)
    return sessions.normalised(lines, seeds=sessions.plan_seeds(store)).select("trace_id", "seq", "declared_intent")


@query(
    f"""{DUCKDB} SELECT trace_id, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS BIGINT) AS seq, CASE WHEN tool_name = 'Task' THEN 27 WHEN tool_name = 'Bash' THEN length(command) + 15 WHEN tool_name IS NOT NULL THEN length(file_path) + 17 WHEN action_type = 'env_effect' THEN length(tool_result) END AS size FROM steps WHERE record_type <> 'mystery' QUALIFY action_type <> 'utterance'"""
)
def n14_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions.normalised(raw_lines(spark, sf_dir), redact=True)
    return s.where("action_type <> 'utterance'").select("trace_id", "seq", F.get_json_object(F.coalesce("payload", "tool_result"), "$.size").cast("long").alias("size"))


@query(f"{DUCKDB} SELECT trace_id AS session, 'no user or assistant records' AS reason FROM steps GROUP BY trace_id HAVING bool_and(record_type = 'mystery' OR u % 4 = 1)")
def n1_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raw_lines(spark, sf_dir, "u")
    return sessions.rejects(lines.withColumn("value", F.when(F.col("u") % 4 == 1, F.lit('\t{"type":"summary"}')).otherwise(F.col("value"))))


def _written(spark: SparkSession, docs: DataFrame) -> str:
    path = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    documents.write_documents(docs, path)
    return path


@query(f"{DUCKDB} SELECT trace_id, seq - 1 AS seq, step_id, ts, actor, declared_intent, action_type, tool_name, payload, file_path, command, text, tool_result, is_error, delegation_unobserved, agent_id, cwd FROM (SELECT * REPLACE (CASE WHEN tool_name IS NOT NULL AND tool_name IN ('Bash', 'Task') THEN NULL ELSE file_path END AS file_path) FROM steps)")
def s13_traces_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = documents.read_traces(spark, _written(spark, documents.trace_documents(steps(spark, sf_dir))))
    compact = canonical_json("payload")
    return back.select("trace_id", "seq", "step_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "actor", "declared_intent", "action_type", "tool_name", F.regexp_replace(compact, '":"', '": "').alias("payload"), "file_path", "command", "text", "tool_result", "is_error", "delegation_unobserved", "agent_id", "cwd")


@query(f"{GATE} SELECT trace_id, step_id, CASE WHEN gate <> 'goal_deviation' THEN gate ELSE 'undeclared_goal' END AS label, gate = 'goal_deviation' AS flagged, CASE gate WHEN 'goal_deviation' THEN 'seen' WHEN 'faithful' THEN 'NLI gate: entail' ELSE 'NLI gate: neutral' END AS reasoning, CASE WHEN gate = 'goal_deviation' THEN 'HIGH' ELSE 'LOW' END AS severity FROM gate")
def s9_pack_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = payload_text(steps(spark, sf_dir))
    verdicts = s.selectExpr("trace_id", "step_id", "'undeclared_goal' AS label", "'HIGH' AS severity", "'seen' AS reasoning", "'rm' AS evidence")
    scored = drift.score_two_stage(s, verdicts, budget=1_000_000)
    sealed = attest.packs(drift.trace_drift(s, scored), s, scored)
    back = documents.pack_steps(documents.read_packs(spark, _written(spark, sealed.select(F.col("manifest").alias("value")))))
    return back.select(F.col("subject.agent_config_ref").alias("trace_id"), "step_id", "label", "flagged", "reasoning", "severity")


@query("SELECT concat('s', user_id) AS session_id, event_type AS agent, concat('b', event_id % 3) AS branch, concat('c', event_id % 2, ', d') AS recent_commits FROM events WHERE event_id % 5 <> 0")
def s10_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = "to_json(named_struct('session_id', CASE WHEN event_id % 5 <> 0 THEN concat('s', user_id) END, 'agent', event_type, 'branch', concat('b', event_id % 3), 'recent_commits', array(concat('c', event_id % 2), 'd'))) AS value"
    path = _written(spark, spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(entry))
    return documents.read_provenance(spark, path).select("session_id", "agent", "branch", "recent_commits")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('Rules of ', source) END AS title FROM documents")
def s11_policy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat('intro # no\n## not this\n#nor this\n', CASE WHEN doc_id % 3 = 0 THEN concat('#  Rules of ', source, ' \n') ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN '# Second\n' ELSE 'end' END)"
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", documents.title_of(F.expr(text)).alias("title"))


@query("SELECT concat('p', event_id) AS probe_id, event_type AS family, 'jailbreak' AS kind, event_id % 4 <> 2 AS should_refuse, CASE WHEN event_id % 4 = 2 THEN 'key,token' ELSE '' END AS must_not_contain FROM events WHERE event_id % 4 > 1")
def s12_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = """concat('{"probe_id":"p', event_id, '","family":"', event_type, '","version":"1","kind":"', CASE WHEN event_id % 4 = 1 THEN 'odd' ELSE 'jailbreak' END, '","stimulus":{"channel":"user_message","payload":{"text":"x"}},"expected_behavior":', CASE WHEN event_id % 4 = 2 THEN '{"should_refuse":false,"must_not_contain":["key","token"]}' ELSE '{}' END, '}')"""
    value = f"CASE WHEN event_id % 4 = 0 THEN concat('{{\"probe_id\":\"p', event_id, '\"}}') ELSE {good} END AS value"
    path = _written(spark, spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(value))
    return documents.read_probes(spark, path).select("probe_id", "family", "kind", "should_refuse", F.array_join("must_not_contain", ",").alias("must_not_contain"))

#: Rules of the tenants, a tenant a user: one kind of rules for each u % 5, over two layers; some have none.
TENANT_RULES = """SELECT DISTINCT u, CAST(u AS STRING) AS tenant, x.layer, x.key, x.value FROM (SELECT DISTINCT u FROM steps) LATERAL VIEW explode(CASE u % 5
 WHEN 1 THEN array(named_struct('layer', 1, 'key', 'churn_threshold', 'value', '9'), named_struct('layer', 2, 'key', 'churn_threshold', 'value', '2'), named_struct('layer', 1, 'key', 'error_cluster_window', 'value', '3'), named_struct('layer', 1, 'key', 'error_cluster_k', 'value', '2'))
 WHEN 2 THEN array(named_struct('layer', 1, 'key', 'roots', 'value', '["/work"]'), named_struct('layer', 1, 'key', 'scratch_prefixes', 'value', '["/var", "/opt"]'))
 WHEN 3 THEN array(named_struct('layer', 1, 'key', 'tripwire_patterns', 'value', '{"print":"old","force-push":"git push --never"}'), named_struct('layer', 2, 'key', 'tripwire_patterns', 'value', '{"print":"CAT\\\\\\\\s+new7"}'))
 WHEN 4 THEN array(named_struct('layer', 1, 'key', 'roots', 'value', '["/nowhere"]'), named_struct('layer', 2, 'key', 'roots', 'value', '"auto"'), named_struct('layer', 1, 'key', 'error_cluster_window', 'value', '9'), named_struct('layer', 1, 'key', 'error_cluster_k', 'value', '4'), named_struct('layer', 1, 'key', 'churn_threshold', 'value', '"many"'))
 ELSE array(named_struct('layer', 1, 'key', 'other', 'value', '1')) END) t AS x"""
LIMITED = "t AS (SELECT *, CASE WHEN u % 5 = 1 THEN 2 ELSE 4 END AS thr, CASE u % 5 WHEN 1 THEN 3 WHEN 4 THEN 9 ELSE 5 END AS w, CASE u % 5 WHEN 1 THEN 2 WHEN 4 THEN 4 ELSE 3 END AS least, CASE WHEN u % 5 = 2 THEN '/work' ELSE cwd END AS root FROM steps)"
TENANT_SCOPE = f"""SELECT trace_id, {FINDING.format(rule="scope-escape", severity="high", title="Write outside allowed roots")}, seq, step_id AS step_ids,
 concat('{{"file_path":"', file_path, '","roots":["', root, '"],"tool":"', tool_name, '"}}') AS evidence, concat('file_path=''', file_path, ''', roots=[''', root, '''], tool=''', tool_name, '''') AS shown FROM t
 WHERE {EDITOR} AND root IS NOT NULL AND NOT (file_path = root OR starts_with(file_path, root || '/') OR (u % 5 <> 2 AND starts_with(file_path, '/tmp/')))"""
TENANT_ERRORS = f"""SELECT trace_id, {FINDING.format(rule="error-cluster", severity="medium", title="Cluster of consecutive tool errors")}, min(seq) AS seq, string_agg(step_id, ',' ORDER BY seq) FILTER (WHERE is_error) AS step_ids,
 concat('{{"error_count":', count(*) FILTER (WHERE is_error), ',"window_size":', max(w), '}}') AS evidence, concat('error_count=', count(*) FILTER (WHERE is_error), ', window_size=', max(w)) AS shown FROM (
 SELECT *, pos - row_number() OVER (PARTITION BY trace_id ORDER BY pos) AS island FROM env e WHERE EXISTS (SELECT 1 FROM starts s WHERE s.trace_id = e.trace_id AND e.pos BETWEEN s.pos AND s.pos + s.w - 1)) GROUP BY trace_id, island HAVING count(*) FILTER (WHERE is_error) > 0"""
TENANT_TRIPS = f"SELECT * FROM ({TRIPS}) WHERE NOT (rule_id = 'tripwire:force-push' AND CAST(trace_id AS INT) % 5 = 3) UNION ALL " + """SELECT trace_id, 'tripwire:print', 'high', 'Tripwire matched: print', seq, step_id, concat('{"command":"', command, '","name":"print"}'), concat('command=''', command, ''', name=''print''') FROM t WHERE u % 5 = 3 AND regexp_matches(command, 'cat\\s+new7')"""
TENANT_CHURN = CHURN.replace("FROM steps", "FROM t").replace("HAVING count(*) >= 4", "HAVING count(*) >= max(thr)")


@query(
    f"""{DUCKDB}, {LIMITED}, env AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY trace_id) AS n FROM t WHERE action_type = 'env_effect'),
 starts AS (SELECT a.trace_id, a.pos, max(a.w) AS w FROM env a JOIN env b ON a.trace_id = b.trace_id AND b.pos BETWEEN a.pos AND a.pos + a.w - 1 WHERE a.pos <= greatest(a.n - a.w, 0) GROUP BY a.trace_id, a.pos HAVING count(*) FILTER (WHERE b.is_error) >= max(a.least))
 {" UNION ALL ".join(f"SELECT * FROM ({x})" for x in (TENANT_SCOPE, TENANT_CHURN, COMMITS, TENANT_TRIPS, TENANT_ERRORS, DELEGATIONS, ABANDONED))}"""
)
def f12_tenant_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir).withColumn("tenant", F.col("u").cast("string"))
    s.createOrReplaceTempView("tenant_steps")
    layers = spark.sql(TENANT_RULES.replace("FROM steps", "FROM tenant_steps")).drop("u")
    return flat(findings.analyze(s, rules=findings.in_force(findings.layered(layers))))


#: The steps of sessions as their transcripts have them: unknown records gone, places counted anew.
RENUMBERED = DUCKDB.replace(", steps AS (", ", all_steps AS (") + ", steps AS (SELECT * REPLACE (row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS seq) FROM all_steps WHERE record_type <> 'mystery')"


@query(f"{RENUMBERED} SELECT trace_id AS trace_key, CASE WHEN CAST(trace_id AS INT) % 3 = 0 THEN trace_id ELSE 'unknown' END AS trace_id, * EXCLUDE (trace_id) FROM ({ALL})")
def n2_unknown_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the sessions don't say who they are; they are sessions of their own all the same."""
    nameless = F.when(F.col("u") % 3 == 0, F.col("value")).otherwise(F.regexp_replace("value", '"sessionId":"[^"]*",', ""))
    return flat(findings.analyze(sessions.normalised(raw_lines(spark, sf_dir, "u").withColumn("value", nameless).drop("u"))))


@query(
    f"""{RENUMBERED}, i AS (SELECT *, CASE WHEN tool_name = 'Bash' THEN 2 ELSE 1 END AS n, CASE WHEN k % 2 = 0 THEN step_id END AS uuid FROM steps), b AS (SELECT *, unnest(range(n)) AS nth FROM i),
 ids AS (SELECT *, coalesce(uuid, concat(trace_id, '-', nth)) || CASE WHEN nth > 0 THEN concat('-', nth) ELSE '' END AS sid, coalesce(uuid, concat(trace_id, '-', nth - 1)) || CASE WHEN nth > 1 THEN concat('-', nth - 1) ELSE '' END AS above FROM b)
 SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY seq, nth) AS seq, sid AS step_id, CASE WHEN nth > 0 THEN above ELSE concat('p', step_id) END AS parent_step_id FROM ids"""
)
def n5_step_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the records have no uuid; records of a shell command call it twice."""
    bare = F.when(F.col("k") % 2 == 0, F.col("value")).otherwise(F.regexp_replace("value", '"uuid":"[^"]*",', ""))
    twice = F.regexp_replace(bare, r'(\{"type":"tool_use","id":"t[0-9]+","name":"Bash".*\})\]\}\}$', "$1,$1]}}")
    above = F.regexp_replace(twice, r'^\{', F.concat(F.lit('{"parentUuid":"p'), "step_id", F.lit('",')))
    return sessions.normalised(raw_lines(spark, sf_dir, "k", "step_id").withColumn("value", above).drop("k", "step_id")).select("trace_id", "seq", "step_id", "parent_step_id")


@query(
    f"""{DUCKDB}, cwds AS (SELECT DISTINCT cwd FROM steps WHERE cwd IS NOT NULL), docs AS (SELECT cwd, concat(cwd, p) AS path, o FROM cwds, (VALUES ('/POLICY.md', 1), ('/.house/POLICY.md', 2), ('/.house/rules/a.md', 3), ('/.house/rules/b.md', 4)) AS v(p, o)
 UNION ALL SELECT cwd, concat('/work', p), o FROM cwds, (VALUES ('/POLICY.md', 5), ('/.house/POLICY.md', 6), ('/.house/rules/0.md', 7)) AS v(p, o) UNION ALL SELECT cwd, '/etc/.house/POLICY.md', 0 FROM cwds)
 SELECT cwd, path, row_number() OVER (PARTITION BY cwd ORDER BY o) AS rank FROM docs"""
)
def f14_policy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    cwds = steps(spark, sf_dir).where("cwd IS NOT NULL").select("cwd").distinct()
    doc = lambda dir, path, scope: f"named_struct('dir', {dir}, 'path', concat({dir}, '{path}'), 'scope', '{scope}')"
    own = [doc("cwd", "/.house/rules/b.md", "rules"), doc("cwd", "/.house/rules/a.md", "rules"), doc("cwd", "/.house/POLICY.md", "project"), doc("cwd", "/POLICY.md", "project")]
    above = [doc("'/work'", "/.house/rules/0.md", "rules"), doc("'/work'", "/POLICY.md", "project"), doc("'/work'", "/.house/POLICY.md", "project"), doc("'/etc'", "/.house/POLICY.md", "global")]
    return findings.policy_in_force(cwds, cwds.selectExpr(f"inline(array({', '.join(own + above)}))").distinct())


@query("SELECT event_id, CASE WHEN k % 2 = 0 THEN 'goal_deviation' ELSE 'faithful' END AS label, CASE k % 6 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' WHEN 3 THEN 'LOW' WHEN 5 THEN 'LOW' ELSE 'MEDIUM' END AS severity FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def d7_exact_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A severity counts only as it is written in the list: `low` and `High` are none."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k")
    reply = """concat('{"label":"', CASE WHEN k % 2 = 0 THEN 'goal_deviation' ELSE 'faithful' END, '","severity":"', element_at(array('LOW', 'HIGH', 'low', 'High', 'odd', ''), CAST(k % 6 AS INT) + 1), '"}') AS reply"""
    return drift.parsed_replies(ev.selectExpr("event_id", reply)).select("event_id", "label", "severity")


SCORED = f"""{GATE}, ranked AS (SELECT *, concat(trace_id, '-', seq % 9) AS sid, CASE WHEN gate = 'goal_deviation' THEN row_number() OVER (PARTITION BY trace_id, gate = 'goal_deviation' ORDER BY top DESC, seq) ELSE -1 END AS rank FROM gate),
 written AS (SELECT *, CASE WHEN gate <> 'goal_deviation' THEN gate WHEN rank > 5 THEN 'goal_deviation' ELSE 'faithful' END AS label, row_number() OVER (PARTITION BY trace_id, sid ORDER BY rank DESC, seq DESC) = 1 AS last FROM ranked)"""


@query(
    f"""{SCORED} SELECT t.trace_id, round(coalesce(count(*) FILTER (WHERE last AND label = 'goal_deviation') / count(label), 0), 9) AS drift_score, coalesce(string_agg(sid, ',' ORDER BY rank) FILTER (WHERE last AND label = 'goal_deviation'), '') AS flagged_steps,
 count(*) FILTER (WHERE last AND label = 'faithful') AS n_faithful, count(*) FILTER (WHERE last AND label = 'neutral') AS n_neutral, count(*) FILTER (WHERE last AND label = 'goal_deviation') AS n_deviation, 'gate-1' AS nli_model FROM (SELECT DISTINCT trace_id FROM steps) t LEFT JOIN written USING (trace_id) GROUP BY 1"""
)
def d11_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine step ids a trace: of rows with one id, that which the judge writes last counts."""
    s = payload_text(steps(spark, sf_dir)).withColumn("step_id", F.concat("trace_id", F.lit("-"), F.col("seq") % 9))
    verdicts = s.selectExpr("trace_id", "step_id", "'faithful' AS label", "'LOW' AS severity", "'judge' AS reasoning", "'n/a' AS evidence").distinct()
    d = drift.trace_drift(steps(spark, sf_dir), drift.score_two_stage(s, verdicts, budget=5), models={"nli_model": "gate-1"})
    n = {k: F.coalesce(F.try_element_at("taxonomy_counts", F.lit(k)), F.lit(0)).cast("long").alias(f"n_{short}") for k, short in (("faithful", "faithful"), ("neutral", "neutral"), ("goal_deviation", "deviation"))}
    return d.select("trace_id", rounded("drift_score").alias("drift_score"), F.array_join("flagged_steps", ",").alias("flagged_steps"), *n.values(), F.col("fingerprint.nli_model").alias("nli_model"))


@query(SQL["d4_nli_lexical"])
def d4_stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of half the steps are stored; a second run infers the rest, and a third nothing: its model would call all neutral."""
    s, store = payload_text(steps(spark, sf_dir)), f"{shared_dir(spark)}/predictions-{uuid.uuid4().hex}"
    drift.remember(s.where("k % 2 = 0"), store, model="m")
    drift.remember(s, store, model="m")
    neutral = lambda pairs: pairs[[]].assign(contra=0.0, entail=0.0, neutral=1.0)
    return drift.score_nli(s, neutral, store, "m").select("trace_id", "seq", "step_id", "label", "flagged")


#: Runs of a benchmark: a model for each user, whose traces and steps are all called alike.
_RUN = "concat('m', CAST(u AS STRING))"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the runs, as parse_traces() has them from <model>/<seed>/trace.json."""
    b = _bench(spark, sf_dir).withColumn("step_id", F.concat(F.lit("unknown-step-"), "seq")).withColumn("trace_key", F.concat_ws("/", F.expr(_RUN), "seed")).withColumn("trace_id", F.lit("unknown"))
    b = b.withColumn("payload", F.when(F.col("tool_name") == "ReadFile", F.to_json(F.struct("path"))).otherwise(F.col("payload")))
    docs = documents.trace_documents(b).select(F.concat(F.lit("/runs/"), "trace_key", F.lit("/trace.json")).alias("source"), "value")
    return evaluate.by_run(documents.parse_traces(docs))


@query(f"{DUCKDB}, {TRUTH} SELECT concat('m', t.trace_id, '/', t.seed) AS trace_key, t.seed, t.occurred, concat('unknown-step-', s.seq) AS step_id FROM truth t LEFT JOIN steps s ON s.trace_id = t.trace_id AND s.step_id = t.step_id")
def e6_truth_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _runs(spark, sf_dir)
    return evaluate.ground_truth(s, s.select("trace_key", "trace_id", "seed").distinct()).select("trace_key", "seed", "occurred", F.when(F.col("occurred"), F.col("step_id")).otherwise("unknown-step-").alias("step_id"))


def _packs_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored steps of the runs, as pack_steps() has them from <model>/<seed>/pack.json: the first five contradictions of each went to a judge."""
    s = payload_text(steps(spark, sf_dir)).selectExpr("*", f"concat({_RUN}, '/', {SEEDS}) AS trace_key").withColumn("step_id", F.concat(F.lit("unknown-step-"), "seq")).withColumn("trace_id", F.lit("unknown"))
    verdicts = s.selectExpr("trace_key", "step_id", "'undeclared_goal' AS label", "'HIGH' AS severity", "'seen' AS reasoning", "'rm' AS evidence")
    scored = drift.score_two_stage(s, verdicts, budget=5)
    sealed = attest.packs(drift.trace_drift(s, scored), s, scored)
    packs = documents.parse_packs(sealed.select(F.concat(F.lit("/runs/"), "trace_key", F.lit("/pack.json")).alias("source"), F.col("manifest").alias("value")))
    return evaluate.by_run(documents.pack_steps(packs))


JUDGED = f"""{GATE}, {TRUTH}, g5 AS (SELECT *, row_number() OVER (PARTITION BY trace_id, gate ORDER BY top DESC, seq) AS rank FROM gate), j AS (SELECT *, CASE WHEN gate <> 'goal_deviation' THEN gate WHEN rank <= 5 THEN 'undeclared_goal' ELSE 'goal_deviation' END AS label, gate = 'goal_deviation' AS flagged FROM g5)"""


@query(
    f"""{JUDGED}, a AS (SELECT trace_id, bool_or(flagged) AS any_flag FROM j GROUP BY 1),
 o AS (SELECT t.*, coalesce(j.flagged, false) AS hit, coalesce(j.label = CASE WHEN t.seed IN ('distractor', 'scope-narrow', 'scope-extra', 'plan-late', 'false-scope') THEN 'undeclared_goal' WHEN t.seed = 'format-strict' THEN 'goal_deviation' END, false) AS wanted, NOT t.occurred AND coalesce(any_flag, false) AS fp FROM truth t LEFT JOIN j USING (trace_id, step_id) LEFT JOIN a USING (trace_id))
 SELECT coalesce(seed, 'ALL') AS seed, count(*) AS sessions, count(*) FILTER (WHERE occurred) AS n_occurred, count(*) FILTER (WHERE occurred AND hit) AS n_hit, count(*) FILTER (WHERE occurred AND wanted) AS n_label, count(*) FILTER (WHERE fp) AS n_false, count(*) FILTER (WHERE NOT occurred) AS n_clean FROM o GROUP BY ROLLUP (seed)"""
)
def e7_runs_cross_tabulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _runs(spark, sf_dir)
    table = evaluate.cross_tabulated(evaluate.ground_truth(s, s.select("trace_key", "trace_id", "seed").distinct()), _packs_of_runs(spark, sf_dir))
    return table.select(F.coalesce("seed", F.lit("ALL")).alias("seed"), F.col("n").alias("sessions"), "n_occurred", "n_hit", "n_label", "n_false", "n_clean")


@query(
    f"""{JUDGED} SELECT concat('m', t.trace_id, '/', t.seed) AS trace_key, t.seed, j.label IS NOT NULL AS gate_fired, coalesce(j.gate = 'goal_deviation', false) AS judge_called, coalesce(j.gate = 'goal_deviation' AND j.rank <= 5, false) AS judge_decided, coalesce(j.label, '') AS label FROM truth t LEFT JOIN j USING (trace_id, step_id) WHERE t.occurred"""
)
def e9_offence_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _runs(spark, sf_dir)
    found = evaluate.offence_attribution(evaluate.ground_truth(s, s.select("trace_key", "trace_id", "seed").distinct()), _packs_of_runs(spark, sf_dir))
    return found.select("trace_key", "seed", "gate_fired", "judge_called", "judge_decided", F.coalesce("label", F.lit("")).alias("label"))


@query(f"{DUCKDB} SELECT trace_id AS session, count(*) AS n FROM steps WHERE u % 3 < 2 GROUP BY 1")
def s1_unread_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the transcripts is read and noted; the others come later and are what a second run reads."""
    lines, folder = raw_lines(spark, sf_dir, "u"), f"{shared_dir(spark)}/transcripts-{uuid.uuid4().hex}"
    logs, book = f"{folder}/logs", f"{folder}/ledger"
    sessions.write_lines(lines.where("u % 3 = 2"), logs)
    first, entries = ledger.read_unread(spark, logs, book)
    first.count()
    ledger.noted(entries, book)
    sessions.write_lines(lines.where("u % 3 < 2"), logs)
    again, _ = ledger.read_unread(spark, logs, book)
    return again.groupBy("session").agg(F.count("*").alias("n"))


@query(f"{DUCKDB} SELECT trace_id, seq - 1 AS seq, step_id, declared_intent, tool_name FROM steps")
def s13_sharded_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of any length as documents of at most 16 steps each, written by adapter and read back."""
    s = steps(spark, sf_dir).withColumn("trace_key", F.concat(F.lit("key-"), "trace_id"))
    docs = documents.trace_documents(s, 16).withColumn("source_adapter", F.concat(F.lit("a"), F.col("trace_id").cast("int") % 3))
    path = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    documents.write_documents(docs, path, by="source_adapter")
    back = documents.read_traces(spark, path)
    return back.where("trace_key = concat('key-', trace_id)").select("trace_id", "seq", "step_id", "declared_intent", "tool_name")


@query(SQL["c3_statistics"])
def c3_merged_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus summed from stored parts: the first run saw half of the lines of each transcript, the second read the grown ones anew."""
    lines, own = raw_lines(spark, sf_dir, "agent_id", "k", "u"), spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    lines = lines.withColumn("path", F.concat_ws("/", F.lit("/logs"), "session", "agent_id"))
    path = f"{shared_dir(spark)}/partials-{uuid.uuid4().hex}"
    for run, seen in enumerate(("k % 2 = 0 OR u % 4 = 0", "u % 4 <> 0")):
        corpus.partials(sessions.records(lines.where(seen)), run).write.mode("append").parquet(path)
    stores = own.where("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("session"))
    return corpus.merged_statistics(spark.read.parquet(path), stores, own.where("user_id % 7 = 0").selectExpr("concat('/logs/', user_id, '.jsonl') AS path"))


@query(
    f"""WITH s AS ({SQL["c3_statistics"]}), a AS (SELECT 'anchor' AS metric, key, coalesce(n, 0) AS n FROM (VALUES ('TodoWrite'), ('TaskCreate'), ('TaskUpdate')) AS v(key) LEFT JOIN (SELECT key, n FROM s WHERE metric = 'anchor') USING (key))
 SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY n DESC, key) AS rank, key, n FROM (SELECT metric, key, n FROM s WHERE metric IN ('record_type', 'delegate_tool') UNION ALL SELECT * FROM a)"""
)
def c3_top_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = corpus.counts(sessions.records(raw_lines(spark, sf_dir, "agent_id")))
    return corpus.tops(counts, ("record_type", "delegate_tool", "anchor"))
