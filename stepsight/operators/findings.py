"""Structural findings over steps: every rule takes steps (one row per step, ordered by seq within its trace) and returns rows
(trace_id, rule_id, severity, seq, step_ids, title, evidence, shown), and trace_key where steps have one. evidence is a JSON object with
sorted keys, shown the same as `key=value` pairs.

Traces are told apart by keys_of(). Rules look along a trace with running(), chunk by chunk, so a trace of any length is many tasks; on
arranged() steps they need no exchange of steps but of what they find. analyze() arranges a narrow projection once, and reads the long
texts, for one rule, beside it. Rules of many tenants are a table: in_force() gives a row a tenant, and each step is held to its own."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import COMMIT, EDITORS, FLAGS, TRIPWIRES, VERIFY
from ..functions.scans import Mark, arranged, chunked, keys_of, place_of, running

SCRATCH = ("/tmp",)
CHURN = 4
ERROR_WINDOW, ERROR_LEAST = 5, 3
#: Names of one trace that a text is searched for one by one; beyond, an automaton of all names reads it once.
FEW_NAMES = 32
RANK = {"high": 0, "medium": 1, "low": 2, "info": 3}
# What each rule is called in a report, and why one could not run.
TITLES = {
    "scope-escape": "Write outside allowed roots",
    "churn-burst": "Repeated edits with no verification",
    "commit-without-tests": "Commit with no prior verification",
    "error-cluster": "Cluster of consecutive tool errors",
    "delegation-unobserved": "Unobserved delegation",
    "abandoned-artifact": "Written file never referenced again",
}
LIMITS = {"churn_threshold": CHURN, "error_cluster_window": ERROR_WINDOW, "error_cluster_k": ERROR_LEAST}
NO_ROOTS = "no config.roots and no trace.metadata['cwd'] available to establish allowed write roots"
#: What the rules read of a step, the long texts apart.
NARROW = ["seq", "step_id", "action_type", "tool_name", "file_path", "command", "is_error", "delegation_unobserved", "cwd"]


def matches(column: Column, pattern: str) -> Column:
    return F.coalesce(column.rlike(FLAGS + pattern), F.lit(False))


def is_bash() -> Column:
    return (F.col("action_type") == "tool_call") & F.col("tool_name").eqNullSafe("Bash")


def calls(*names: str) -> Column:
    return (F.col("action_type") == "tool_call") & F.coalesce(F.col("tool_name").isin(*names), F.lit(False))


def marked(steps: DataFrame) -> DataFrame:
    """steps with what the patterns say of a command: __verify, __commit and __tripped, the names of the default tripwires. Added before
    steps are cached, they let a command meet each pattern once, however many rules and reports look at it."""
    if "__tripped" in steps.columns:
        return steps
    hits = F.array_compact(F.array(*(F.when(matches(F.col("command"), p), F.lit(n)) for n, p in TRIPWIRES.items())))
    bash = lambda c: F.when(is_bash(), c)
    return steps.select("*", F.coalesce(bash(matches(F.col("command"), VERIFY)), F.lit(False)).alias("__verify"), F.coalesce(bash(matches(F.col("command"), COMMIT)), F.lit(False)).alias("__commit"), bash(hits).alias("__tripped"))


def basename(path: Column) -> Column:
    """What follows the last slash; empty after a trailing one."""
    return F.element_at(F.split(path, "/"), -1)


def normal_path(path: Column) -> Column:
    """A path without `.`, `..` or doubled slashes; exactly two leading slashes stay. One that has none is left as it is."""
    root = F.when(path.rlike("^//(?!/)"), "//").when(path.startswith("/"), "/").otherwise("")
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))

    def step(done: Column, p: Column) -> Column:
        up = (p == "..") & ~((F.size(done) == 0) & (root == "")) & ~(F.element_at(F.concat(F.array(F.lit("")), done), -1) == "..")
        return F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))

    joined = F.concat(root, F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/"))
    return F.when(~path.rlike(r"/\.{0,2}(/|$)|^\.{1,2}(/|$)|^$"), path).when(joined == "", ".").otherwise(joined)


def under(path: Column, prefix: Column) -> Column:
    """Equal to a normalised prefix, or nested below it."""
    p = normal_path(prefix)
    return (path == p) | path.startswith(F.concat(F.rtrim(p, F.lit("/")), F.lit("/")))


def quoted(text: Column) -> Column:
    """A text as Python shows it: in single quotes, or double ones if it has single and no double ones."""
    double = text.contains("'") & ~text.contains('"')
    escaped = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def finding(keys: list[str], rule: str, severity: str, evidence: dict[str, Column], ids: Column | None = None, name: Column | None = None) -> list[Column]:
    """Columns of a finding. evidence: texts, lists of texts or, named n_ or ending in size, length or count, numbers. name: of the tripwire."""
    shown = []
    for key, value in sorted(evidence.items()):
        number = key.endswith(("size", "length", "count"))
        text = value.cast("string") if number else F.concat(F.lit("["), F.array_join(F.transform(value, quoted), ", "), F.lit("]")) if key == "roots" else F.coalesce(quoted(value), F.lit("None"))
        shown.append(F.concat(F.lit(f"{key}="), text))
    return [
        *(F.col(k) for k in keys),
        (F.lit(rule) if name is None else F.concat(F.lit(f"{rule}:"), name)).alias("rule_id"),
        F.lit(severity).alias("severity"),
        F.col("seq"),
        (F.array("step_id") if ids is None else ids).alias("step_ids"),
        (F.lit(TITLES[rule]) if name is None else F.concat(F.lit("Tripwire matched: "), name)).alias("title"),
        F.to_json(F.struct(*(v.alias(k) for k, v in sorted(evidence.items()))), {"ignoreNullFields": "false"}).alias("evidence"),
        F.concat_ws(", ", *shown).alias("shown"),
    ]


def ancestors(path: Column) -> Column:
    """A normalised absolute path and all folders above it, nearest first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) == 0, F.array(F.lit("/"))).otherwise(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"))))


def roots_of(cwds: DataFrame, repo_roots: DataFrame) -> DataFrame:
    """cwd, root: the longest of repo_roots (root) that is the cwd or above it, else the cwd. An equi-join on ancestors."""
    own = cwds.select("cwd").where("cwd IS NOT NULL").distinct()
    up = own.select("cwd", F.explode(ancestors(normal_path(F.col("cwd")))).alias("root"))
    found = up.join(repo_roots.select(normal_path(F.col("root")).alias("root")).distinct(), "root").groupBy("cwd").agg(F.max_by("root", F.length("root")).alias("root"))
    return own.join(found, "cwd", "left").select("cwd", F.coalesce("root", "cwd").alias("root"))


def _of_tenants(steps: DataFrame, rules: DataFrame) -> DataFrame:
    """steps with what `rules` (a row a tenant) has for each step's tenant; null where it has nothing, or steps have no tenant."""
    if "tenant" not in steps.columns:
        steps = steps.withColumn("tenant", F.lit(None).cast(dict(rules.dtypes)["tenant"]))
    return steps.join(rules.withColumnRenamed("tenant", "rules_tenant"), F.col("tenant").eqNullSafe(F.col("rules_tenant")), "left").drop("rules_tenant")


def scope_escape(steps: DataFrame, roots: DataFrame | None = None, scratch: Sequence[str] = SCRATCH, allowed: Sequence[str] | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Writes outside the trace's root (roots: cwd, root; without it, the cwd) and outside scratch folders. Traces without cwd: none.

    allowed: explicit roots for all traces, also those without cwd, instead. rules: of in_force(); a tenant's roots and scratch folders
    stand instead of these."""
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    writes = steps.where(calls(*EDITORS) & (F.coalesce(F.length("file_path"), F.lit(0)) > 0))
    found = F.when(F.col("cwd").isNotNull(), F.array("cwd"))
    if roots is not None:
        writes = writes.join(roots.select("cwd", "root"), "cwd", "left")
        found = F.when(F.col("root").isNotNull(), F.array("root"))
    writes = writes.withColumn("found_roots", found if allowed is None else texts(allowed)).withColumn("scratch", texts(scratch))
    if rules is not None:
        writes = _of_tenants(writes, rules.select("tenant", F.col("roots").alias("own_roots"), F.col("scratch_prefixes").alias("own_scratch")))
        writes = writes.withColumn("found_roots", F.coalesce("own_roots", "found_roots")).withColumn("scratch", F.coalesce("own_scratch", "scratch"))
    writes = writes.where("found_roots IS NOT NULL").withColumn("path", normal_path(F.col("file_path")))
    inside = lambda c: F.exists(c, lambda r: under(F.col("path"), r))
    return writes.where(~inside("found_roots") & ~inside("scratch")).select(*finding(keys_of(steps), "scope-escape", "high", {"file_path": F.col("file_path"), "tool": F.col("tool_name"), "roots": F.col("found_roots")}))


def not_checked(traces: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Traces whose scope can't be checked, as they have no cwd and their tenant no roots, and the reason."""
    bare = traces.where("cwd IS NULL")
    if rules is not None:
        bare = _of_tenants(bare, rules.select("tenant", F.col("roots").alias("own_roots"))).where("own_roots IS NULL")
    return bare.select(*keys_of(traces), F.lit("scope-escape").alias("rule_id"), F.lit(NO_ROOTS).alias("reason")).distinct()


def churn_burst(steps: DataFrame, least: int | Column = CHURN) -> DataFrame:
    """At least `least` edits of one path with no verify command and no read of that path between."""
    keys = keys_of(steps)
    own = chunked(marked(steps)).withColumn("least", F.lit(least) if isinstance(least, int) else least).withColumn("verify", F.col("__verify").cast("int"))
    own = own.where(F.col("verify").cast("boolean") | (calls(*EDITORS, "Read") & (F.coalesce(F.length("file_path"), F.lit(0)) > 0)))
    own = own.select(*place_of(own), "seq", "step_id", "file_path", "verify", "least", calls("Read").cast("int").alias("read"))
    own = running(own, keys, {"verified": Mark("sum", F.col("verify"))}).where("verify = 0")
    edits = running(own, [*keys, "file_path"], {"reads": Mark("sum", F.col("read"))}).where("read = 0")
    run = [*keys, "file_path", "verified", "reads"]
    place = [c for c in place_of(edits) if c not in run]
    parts = edits.groupBy(*run, *place).agg(F.collect_list(F.struct("seq", "step_id")).alias("part"), F.max("least").alias("least"))
    if "several" in place:  # a part that is the whole run, and too short, need not move
        parts = parts.where(F.col("several") | (F.size("part") >= F.col("least")))
    runs = parts.groupBy(*run).agg(F.array_sort(F.flatten(F.collect_list("part"))).alias("run"), F.max("least").alias("least")).where(F.size("run") >= F.col("least"))
    return runs.withColumn("seq", F.col("run")[0]["seq"]).select(*finding(keys, "churn-burst", "medium", {"file_path": F.col("file_path"), "run_length": F.size("run")}, F.col("run.step_id")))


def commit_without_tests(steps: DataFrame) -> DataFrame:
    """Commits with no verify command since the commit before, their own command included."""
    keys = keys_of(steps)
    own = chunked(marked(steps))
    bash = own.where(is_bash()).select(*place_of(own), "seq", "step_id", "command", F.col("__commit").alias("commit"), F.col("__verify").alias("verify"))
    marks = {"tested": Mark("max", F.when(F.col("verify"), F.col("seq"))), "before": Mark("max", F.when(F.col("commit"), F.col("seq")), before=True)}
    tested = F.col("tested").isNotNull() & (F.col("before").isNull() | (F.col("tested") > F.col("before")))
    return running(bash, keys, marks).where(F.col("commit") & ~tested).select(*finding(keys, "commit-without-tests", "medium", {"command": F.col("command")}))


def tripwires(steps: DataFrame, patterns: dict[str, str] = TRIPWIRES, rules: DataFrame | None = None) -> DataFrame:
    """One row for each dangerous pattern that a command matches. rules: of in_force(); a tenant's patterns come on top of these, and stand
    instead of those of the same name. They meet the commands of that tenant alone."""
    commands = steps.where(is_bash() & F.col("command").isNotNull())
    common = F.filter(F.array(*(F.when(matches(F.col("command"), p), F.lit(n)) for n, p in patterns.items())).cast("array<string>"), lambda x: x.isNotNull())
    if patterns is TRIPWIRES and "__tripped" in steps.columns:
        common = F.col("__tripped")
    if rules is None:
        hits = commands.withColumn("name", F.explode(common))
    else:
        own = rules.where("size(patterns) > 0").select("tenant", F.col("patterns"))
        meant = _of_tenants(commands, own.select("tenant", F.map_keys("patterns").alias("own_names")))
        kept = F.filter(common, lambda n: ~F.array_contains(F.coalesce("own_names", F.array().cast("array<string>")), n))
        first = meant.withColumn("name", F.explode(kept)).drop("own_names")
        named = own.select("tenant", F.explode("patterns").alias("name", "pattern")).where("pattern IS NOT NULL")
        meet = commands if "tenant" in commands.columns else commands.withColumn("tenant", F.lit(None).cast(dict(rules.dtypes)["tenant"]))
        both = meet.join(named.withColumnRenamed("tenant", "rules_tenant"), F.col("tenant").eqNullSafe(F.col("rules_tenant"))).drop("rules_tenant")
        hits = first.unionByName(both.where(F.rlike("command", F.concat(F.lit(FLAGS), F.col("pattern")))).drop("pattern"), allowMissingColumns=True)
    return hits.select(*finding(keys_of(steps), "tripwire", "high", {"command": F.col("command"), "name": F.col("name")}, name=F.col("name")))


def error_clusters(steps: DataFrame, window: int | Column = ERROR_WINDOW, least: int | Column = ERROR_LEAST) -> DataFrame:
    """Merged windows of `window` tool results with at least `least` errors; a trace with no more results than that is one window.

    Windows that reach the least number are those that hold some error and the (least - 1)th one after it, so an error meets that one by its
    number, whatever the lengths; what such windows cover follows from the two places. What overlaps or touches is one cluster."""
    keys = keys_of(steps)
    lit = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("long")
    own = chunked(steps)
    env = own.where("action_type = 'env_effect'").select(*place_of(own), "seq", "step_id", F.coalesce(F.col("is_error"), F.lit(False)).cast("int").alias("err"), lit(window).alias("w"), lit(least).alias("k"))
    placed = running(env, keys, {"place": Mark("sum", F.lit(1)), "nth": Mark("sum", F.col("err"))}).withColumn("f", F.col("place") - 1)
    several = [c for c in place_of(placed) if c == "several"]
    failed = placed.where("err = 1").select(*keys, *several, "seq", "step_id", "w", "k", "f", "nth")
    last = failed.select(*keys, F.col("nth").alias("at"), F.col("f").alias("l"))
    met = failed.withColumn("at", F.col("nth") + F.greatest(F.col("k"), F.lit(1)) - 1).join(last, [*keys, "at"], "left")
    fits = (F.col("k") <= 0) & (F.col("w") > 0) | (F.col("l") - F.col("f") < F.col("w"))
    low = F.when(F.col("k") <= 0, 0).otherwise(F.greatest(F.lit(0), F.col("l") - F.col("w") + 1))
    high = F.when(F.col("k") <= 0, 1 << 62).otherwise(F.col("f") + F.col("w") - 1)  # beyond a trace's end there is nothing to cover
    met = met.select(*failed.columns, F.coalesce(fits, F.lit(False)).alias("fits"), low.alias("low"), high.alias("high"))
    met = chunked(met, "nth")
    if several:  # the errors of one chunk of steps are one chunk
        met = met.withColumn("chunk", F.when(F.col("several"), F.col("chunk")).otherwise(0))
    met = running(met, keys, {"covered": Mark("max", F.when(F.col("fits"), F.col("high")), before=True), "begun": Mark("max", F.when(F.col("fits"), F.col("nth")))}, "nth")
    opens = F.col("fits") & (F.col("covered").isNull() | (F.col("low") > F.col("covered") + 1))
    met = running(met, keys, {"island": Mark("sum", opens.cast("int"))}, "nth")
    inside = met.where((F.col("nth") - F.col("begun") < F.col("k")) | (F.col("k") <= 0) & F.col("fits"))
    runs = inside.groupBy(*keys, "island").agg(F.min(F.when(F.col("fits"), F.col("low"))).alias("f"), F.max("w").alias("w"), F.array_sort(F.collect_list(F.struct("seq", "step_id"))).alias("run"))
    runs = placed.select(*keys, "f", "seq").join(runs, [*keys, "f"])  # a cluster's place is that of its first result, failed or not
    return runs.select(*finding(keys, "error-cluster", "medium", {"error_count": F.size("run"), "window_size": F.col("w")}, F.col("run.step_id")))


def delegation_unobserved(steps: DataFrame) -> DataFrame:
    return steps.where("delegation_unobserved").select(*finding(keys_of(steps), "delegation-unobserved", "info", {"tool": F.col("tool_name")}))


def _mentioned(texts: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, last (the last `at` of a text that has the name in it) for texts (keys, chunk, at, said) and names (keys, name): an
    automaton of a trace's names reads each of its texts once. Names go with each chunk of their trace, and chunks apart."""
    import ahocorasick  # noqa: F401  fails here, not on the workers

    there = texts.select(*keys, "chunk").distinct().join(names, keys).select(*keys, "chunk", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("at"), F.col("name").alias("said"))
    both = there.unionByName(texts.select(*keys, "chunk", F.lit(1).alias("kind"), F.col("at").cast("long").alias("at"), "said"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        of, tree, last = None, None, {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([of[i]] * len(last), pa.string()) for i in range(len(keys))), pa.array(list(last), pa.string()), pa.array(list(last.values()), pa.int64())], [*keys, "name", "last"])

        for b in batches:
            for *own, kind, at, said in zip(*(c.to_pylist() for c in b.columns)):
                if own != of:
                    if last:
                        yield told()
                    of, tree, last, ready = own, ahocorasick.Automaton(), {}, False
                if kind == 0:
                    tree.add_word(said, said)
                else:
                    if not ready:
                        tree.make_automaton()
                        ready = True
                    for _, name in tree.iter(said):
                        last[name] = at if name not in last else max(last[name], at)
        if last:
            yield told()

    ordered = both.repartition(*keys, "chunk").sortWithinPartitions(*keys, "chunk", "kind").select(*(F.col(k).cast("string").alias(k) for k in keys), F.col("chunk").cast("string").alias("chunk"), "kind", "at", "said")
    found = ordered.mapInArrow(search, ", ".join(f"{k} string" for k in keys) + ", name string, last bigint")
    return found.groupBy(*keys, "name").agg(F.max("last").alias("last"))


def abandoned_artifacts(steps: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Writes whose basename no later edit, read, command or result mentions: the last mention of each distinct name is enough.

    texts: where to read the mentions from, if steps lack tool_result. The texts of a trace are looked at once: for its FEW_NAMES names one
    by one, or by an automaton where it has more; arranged steps are asked first whether there is such a trace, as all texts move once more
    to be joined with those that have many. Only hits become rows."""
    keys = keys_of(steps)
    writes = steps.where(calls("Write")).select(*keys, "seq", "step_id", "file_path", basename(F.col("file_path")).alias("name")).where("name <> ''")
    distinct = writes.groupBy(*keys, "name").agg(F.min("seq").alias("first"))
    own = distinct.groupBy(*keys).agg(F.min("first").alias("first"), F.count("*").alias("n"))
    said = F.when(calls("Edit", "Read", "NotebookEdit"), F.col("file_path")).when(is_bash(), F.col("command")).when(F.col("action_type") == "env_effect", F.col("tool_result"))
    mentions = (steps if texts is None else texts).select(*keys, F.col("seq").alias("at"), said.alias("said")).where("said <> ''")
    crowded = "several" not in steps.columns or not own.where(F.col("n") > FEW_NAMES).isEmpty()
    few, many = (distinct.join(own.where(which).select(*keys), keys, "left_semi") for which in (F.col("n") <= FEW_NAMES, F.col("n") > FEW_NAMES))
    listed = (few if crowded else distinct).groupBy(*keys).agg(F.collect_list("name").alias("names"), F.min("first").alias("first"))
    hits = mentions.join(listed, keys).where("at > first").select(*keys, "at", F.explode(F.filter("names", lambda n: F.contains(F.col("said"), n))).alias("name")).groupBy(*keys, "name").agg(F.max("at").alias("last"))
    if crowded:
        long = mentions.join(own.where(F.col("n") > FEW_NAMES).select(*keys, "first"), keys).where("at > first").drop("first")
        hits = hits.unionByName(_mentioned(chunked(long, "at"), many.drop("first"), keys))
    late = writes.join(hits, [*keys, "name"], "left").where("last IS NULL OR last <= seq")
    return late.select(*finding(keys, "abandoned-artifact", "low", {"file_path": F.col("file_path"), "basename": F.col("name")}))


def analyze(steps: DataFrame, roots: DataFrame | None = None, rules: dict | DataFrame | None = None) -> DataFrame:
    """All findings of all rules, from two scans of steps: one narrow, arranged by trace, and one of the texts that may mention a file. Steps
    that are arranged already are not moved again.

    rules: a table of in_force(), each step being held to its tenant's, or of rules_of() for all steps alike; explicit roots override
    those found."""
    table = rules if isinstance(rules, DataFrame) else None
    given = rules if isinstance(rules, dict) else {}
    there = table is None and "several" in steps.columns
    marks = [c for c in ("__verify", "__commit", "__tripped") if there and c in steps.columns]
    narrow = steps.select(*(place_of if there else keys_of)(steps), *NARROW, *marks, *(["tenant"] if table is not None and "tenant" in steps.columns else []))
    limit = {k: F.lit(given.get(k, v)) for k, v in LIMITS.items()}
    if table is not None:
        narrow = _of_tenants(narrow, table.select("tenant", *(F.col(k).alias(f"own_{k}") for k in LIMITS)))
        limit = {k: F.coalesce(f"own_{k}", F.lit(v)) for k, v in LIMITS.items()}
    own = narrow if there else arranged(marked(narrow), keys_of(steps))
    out = scope_escape(own, roots, given.get("scratch_prefixes", SCRATCH), given.get("roots"), table)
    out = out.unionByName(churn_burst(own, limit["churn_threshold"])).unionByName(commit_without_tests(own))
    out = out.unionByName(tripwires(own, given.get("tripwire_patterns", TRIPWIRES), table))
    out = out.unionByName(error_clusters(own, limit["error_cluster_window"], limit["error_cluster_k"]))
    return out.unionByName(delegation_unobserved(own)).unionByName(abandoned_artifacts(own, steps))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(*keys_of(findings), "severity").agg(F.count("*").alias("n"))


def layered(rules: DataFrame) -> DataFrame:
    """tenant, key, value, layer in force of rows (tenant, layer, key, value: JSON). A later layer replaces a key's value, but
    tripwire_patterns, JSON objects, merge by their own keys; roots: "auto" stands for none given."""
    layers = rules.withColumn("value", F.when((F.col("key") == "roots") & (F.col("value") == '"auto"'), F.lit("null")).otherwise(F.col("value")))
    merging = (F.col("key") == "tripwire_patterns") & F.coalesce(F.startswith("value", F.lit("{")), F.lit(False))
    last = layers.groupBy("tenant", "key").agg(F.max_by("value", "layer").alias("value"), F.max("layer").alias("layer"))
    named = layers.where(merging).select("tenant", "layer", F.explode(F.from_json("value", "map<string,string>")).alias("name", "pattern"))
    named = named.groupBy("tenant", "name").agg(F.max_by("pattern", "layer").alias("pattern")).groupBy("tenant").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "pattern"))))).alias("patterns"))
    both = last.join(named.withColumn("key", F.lit("tripwire_patterns")), ["tenant", "key"], "left")
    return both.select("tenant", "key", F.when(F.startswith("value", F.lit("{")), F.coalesce("patterns", "value")).otherwise(F.col("value")).alias("value"), "layer")


def in_force(layers: DataFrame) -> DataFrame:
    """A row a tenant of what layered() has: tenant, roots, scratch_prefixes, churn_threshold, error_cluster_window, error_cluster_k and
    patterns (map of name to pattern). Null, or a missing name: the default stands, as do values that are no list, number or object."""
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    lists = [F.from_json(value(k), "array<string>").alias(k) for k in ("roots", "scratch_prefixes")]
    numbers = [F.expr(f"try_cast(max(CASE WHEN key = '{k}' THEN value END) AS INT)").alias(k) for k in LIMITS]
    return layers.groupBy("tenant").agg(*lists, *numbers, F.from_json(value("tripwire_patterns"), "map<string,string>").alias("patterns"))


def rules_of(layers: DataFrame, tenant: str | None) -> dict:
    """What layered() has in force for one tenant, as analyze() takes it; nulls are left to the defaults."""
    rows = layers.where(F.col("tenant").eqNullSafe(F.lit(tenant))).select("key", "value").collect()  # one for each of a handful of keys
    return {r["key"]: v for r in rows if (v := json.loads(r["value"])) is not None}


def _place(path: Column, folder: Column) -> Column:
    """Where a policy document stands in its folder: 0 directly, 1 in its hidden folder, 2 below that among the rules."""
    below = F.substring(path, F.length(F.rtrim(folder, F.lit("/"))) + 2, F.length(path))
    return F.when(below.rlike(r"^\.[^/]+/.*/"), 2).when(below.rlike(r"^\.[^/]+/"), 1).otherwise(0)


def policy_in_force(cwds: DataFrame, docs: DataFrame) -> DataFrame:
    """cwd, path, rank of the policy documents (dir, path, scope) in force: global ones first, then those of the cwd's folder and the ones
    above it, nearest first: in each the folder's own, then its hidden folder's, then the rules there by name. Each path once."""
    own = cwds.select("cwd").where("cwd IS NOT NULL").distinct()
    up = own.select("cwd", F.posexplode(ancestors(normal_path(F.col("cwd")))).alias("depth", "dir"))
    local = up.join(docs.where("scope <> 'global'"), "dir").select("cwd", "path", F.struct("depth", F.when(F.col("scope") == "rules", 2).otherwise(_place(F.col("path"), F.col("dir"))).alias("place")).alias("order"))
    # Every cwd gets every global document, so the documents' list is one value; the product is the result itself.
    world = docs.where("scope = 'global'").agg(F.collect_set("path").alias("paths"))
    world = own.crossJoin(world).select("cwd", F.explode("paths").alias("path"), F.struct(F.lit(-1).alias("depth"), F.lit(0).alias("place")).alias("order"))
    once = world.unionByName(local).groupBy("cwd", "path").agg(F.min("order").alias("order"))
    return once.select("cwd", "path", F.row_number().over(Window.partitionBy("cwd").orderBy("order", "path")).cast("long").alias("rank"))


def concepts_in(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """doc_id, concept for each concept that a text mentions."""
    hits = F.filter(F.array(*(F.when(matches(F.col("text"), p), F.lit(n)) for n, p in patterns.items())), lambda x: x.isNotNull())
    return docs.select("doc_id", F.explode(hits).alias("concept"))


