"""Windowed rules against plain loops over random traces, planted sessions, and independence of partitions."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from stepsight.functions import scans, tables
from stepsight.operators import findings, report

SCHEMA = "trace_id string, seq long, step_id string, actor string, action_type string, tool_name string, file_path string, command string, text string, tool_result string, is_error boolean, delegation_unobserved boolean, cwd string, ts timestamp, payload string"


def step(trace, seq, kind, value=None, error=False):
    tool = kind if kind in ("Write", "Edit", "Read", "Bash", "Task", "NotebookEdit") else None
    action = "tool_call" if tool else "env_effect" if kind == "result" else "utterance"
    return (trace, seq, f"{trace}-{seq}", "user" if kind == "user" else "tool" if kind == "result" else "agent", action, tool, value if tool and tool not in ("Bash", "Task") else None, value if kind == "Bash" else None, value if kind == "user" else None, value if kind == "result" else None, error, kind == "Task", "/w", None, None)


def random_steps(seed, traces=25):
    r = random.Random(seed)
    out = []
    for t in range(traces):
        for i in range(1, r.randint(2, 45)):
            kind = r.choice(["Edit", "Edit", "Write", "Read", "Bash", "result", "result", "user", "NotebookEdit"])
            value = {"Bash": r.choice(["pytest", "git commit -m x", "ls", "npm test && git commit", "rm -rf x"]), "user": "hi", "result": "out a.py"}.get(kind, r.choice(["/w/a.py", "/w/b.py"]))
            out.append(step(f"t{t}", i, kind, value, kind == "result" and r.random() < 0.55))
    return out


def by_trace(rows):
    return [list(g) for _, g in groupby(sorted(rows), key=lambda s: s[0])]


def churn(rows):
    out = []
    for trace in by_trace(rows):
        open_runs = {}

        def close(path):
            run = open_runs.pop(path, [])
            if len(run) >= 4:
                out.append((trace[0][0], ",".join(run)))

        for s in trace:
            if s[5] in ("Write", "Edit", "NotebookEdit"):
                open_runs.setdefault(s[6], []).append(s[2])
            elif s[5] == "Bash" and ("pytest" in s[7] or "npm test" in s[7]):
                for p in list(open_runs):
                    close(p)
            elif s[5] == "Read":
                close(s[6])
        for p in list(open_runs):
            close(p)
    return sorted(out)


def commits(rows):
    out = []
    for trace in by_trace(rows):
        tested = False
        for s in trace:
            if s[5] == "Bash":
                tested |= "pytest" in s[7] or "npm test" in s[7]
                if "git commit" in s[7]:
                    if not tested:
                        out.append((s[0], s[2]))
                    tested = False
    return sorted(out)


def clusters(rows, window=5, least=3):
    out = []
    for trace in by_trace(rows):
        env = [s for s in trace if s[4] == "env_effect"]
        n = len(env)
        hit = set()
        for a in [0] if n <= window else range(n - window + 1):
            if n and sum(s[10] for s in env[a : a + window]) >= least:
                hit |= set(range(a, min(n, a + window)))
        for _, run in groupby(enumerate(sorted(hit)), key=lambda x: x[1] - x[0]):
            if failed := [env[i][2] for _, i in run if env[i][10]]:
                out.append((trace[0][0], ",".join(failed)))
    return sorted(out)


def edit_runs(rows):
    out = []
    for trace in by_trace(rows):
        run = []
        for s in [*trace, None]:
            if s and s[5] in ("Edit", "NotebookEdit"):
                run.append(s)
            elif s and s[4] == "env_effect" and not s[10]:
                continue
            else:
                if run:
                    out.append((run[0][0], run[0][2], len(run)))
                run = []
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_equal_loops(spark, seed):
    rows = random_steps(seed)
    for parts in (1, 5):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        found = {r: sorted((x["trace_id"], ",".join(x["step_ids"])) for x in f(df).collect()) for r, f in (("churn", findings.churn_burst), ("commit", findings.commit_without_tests), ("error", findings.error_clusters))}
        assert found["churn"] == churn(rows)
        assert found["commit"] == commits(rows)
        assert found["error"] == clusters(rows)
        edits = report.timeline(df).where("kind = 'edit'").collect()
        assert sorted((e["trace_id"], e["step_id"]) for e in edits) == [x[:2] for x in edit_runs(rows)]


def long_session(seed, n=900):
    """One session, and a few short ones beside it."""
    rows = [(r[0].replace("t", "s"), *r[1:]) for r in random_steps(seed, 3)]
    r = random.Random(seed)
    pool = [s for s in random_steps(seed + 100, 60)]
    return rows + [("long", i + 1, f"long-{i + 1}", *r.choice(pool)[3:]) for i in range(n)]


@pytest.mark.parametrize("size", [1, 7, 64])
def test_long_sessions_are_many_chunks(spark, monkeypatch, size):
    """The same rows whatever the chunks, and no task with more of a session than a chunk."""
    monkeypatch.setattr(scans, "CHUNK", size)
    rows = long_session(5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {r: sorted((x["trace_id"], ",".join(x["step_ids"])) for x in f(df).collect()) for r, f in (("churn", findings.churn_burst), ("commit", findings.commit_without_tests), ("error", findings.error_clusters))}
    assert found["churn"] == churn(rows) and found["commit"] == commits(rows) and found["error"] == clusters(rows)
    assert sorted((e["trace_id"], e["step_id"], e["summary"]) for e in report.timeline(df).where("kind = 'edit'").collect()) == sorted((t, i, s) for t, i, s in edit_summaries(rows))
    turns = {(t["trace_id"], t["turn"]): t["followed_by"] for t in report.turns(df).collect()}
    assert turns == turns_of(rows)
    arranged = scans.arranged(df, ["trace_id"])
    parts = arranged.groupBy("trace_id", "chunk").count().collect()
    assert max(p["count"] for p in parts) <= size and len(parts) >= 900 // size
    arranged.unpersist()


@pytest.mark.parametrize(("size", "several"), [(7, 100), (7, 0), (65_536, 100)])
def test_arranged_sessions_have_partitions_by_size_and_few_carries(spark, monkeypatch, size, several):
    """A small cached table is one partition, not one for each of a shuffle; only sessions of several chunks are told to be so, unless too many."""
    monkeypatch.setattr(scans, "CHUNK", size)
    monkeypatch.setattr(scans, "SEVERAL", several)
    rows = long_session(7, 300)
    df = scans.arranged(spark.createDataFrame(rows, SCHEMA).repartition(3), ["trace_id"])
    longest = {t: max(r[1] for r in rows if r[0] == t) // size > min(r[1] for r in rows if r[0] == t) // size for t in {r[0] for r in rows}}
    assert {(x["trace_id"], x["several"]) for x in df.select("trace_id", "several").distinct().collect()} == {(t, x or (several == 0)) for t, x in longest.items()}
    assert df.rdd.getNumPartitions() < int(spark.conf.get("spark.sql.shuffle.partitions")) and spark.conf.get(tables.SIZED) == "false"
    found = findings.analyze(df).select("rule_id", "trace_id", F.array_join("step_ids", ",").alias("ids")).collect()
    got = {r: sorted((x["trace_id"], x["ids"]) for x in found if x["rule_id"] == r) for r in ("churn-burst", "commit-without-tests", "error-cluster")}
    assert got == {"churn-burst": churn(rows), "commit-without-tests": commits(rows), "error-cluster": clusters(rows)}
    assert sorted((e["trace_id"], e["step_id"], e["summary"]) for e in report.timeline(df).where("kind = 'edit'").collect()) == sorted((t, i, s) for t, i, s in edit_summaries(rows))
    assert {(t["trace_id"], t["turn"]): t["followed_by"] for t in report.turns(df).collect()} == turns_of(rows)
    assert sorted(map(str, found)) == sorted(map(str, findings.analyze(spark.createDataFrame(rows, SCHEMA)).select("rule_id", "trace_id", F.array_join("step_ids", ",").alias("ids")).collect()))


def edit_summaries(rows):
    for t, i, n in edit_runs(rows):
        own = [s for s in by_trace([r for r in rows if r[0] == t])[0]]
        at = [s[2] for s in own].index(i)
        names = {s[6].split("/")[-1] for s in [x for x in own[at:] if not (x[4] == "env_effect" and not x[10])][:n]}
        yield t, i, f"Edited {n} times across {len(names)} files" if len(names) > 1 else f"Edited {min(names)}" + (f" x{n}" if n > 1 else "")


def turns_of(rows):
    out = {}
    for trace in by_trace(rows):
        turn = 0
        for s in trace:
            if s[3] == "user":
                turn += 1
                out[s[0], turn] = {}
            elif turn and s[3] == "agent" and s[4] == "tool_call":
                out[s[0], turn][s[5]] = out[s[0], turn].get(s[5], 0) + 1
    return out


@pytest.mark.parametrize(("window", "least"), [(1, 1), (3, 1), (4, 4), (9, 2), (5, 6), (3, 0), (0, 1), (50, 3)])
def test_error_windows_of_any_length(spark, monkeypatch, window, least):
    monkeypatch.setattr(scans, "CHUNK", 11)
    rows = long_session(6, 200)
    got = sorted((x["trace_id"], ",".join(x["step_ids"])) for x in findings.error_clusters(spark.createDataFrame(rows, SCHEMA), window, least).collect())
    assert got == clusters(rows, window, least)


def test_running_values_by_force(spark, monkeypatch):
    r = random.Random(9)
    rows = [(k, i, r.choice([None, 1, 2, 3])) for k in "abc" for i in range(r.randint(1, 60))]
    for size in (1, 5, 100):
        monkeypatch.setattr(scans, "CHUNK", size)
        df = scans.chunked(spark.createDataFrame(rows, "k string, seq long, v int"))
        marks = {f"{kind}_{before}": scans.Mark(kind, F.col("v"), before) for kind in ("sum", "max", "last") for before in (False, True)}
        for x in scans.running(df, ["k"], marks).collect():
            for before in (False, True):
                own = [v for k, i, v in rows if k == x["k"] and (i < x["seq"] if before else i <= x["seq"]) and v is not None]
                assert (x[f"sum_{before}"], x[f"max_{before}"], x[f"last_{before}"]) == (sum(own), max(own, default=None), own[-1] if own else None)


def test_planted_session_has_exactly_its_findings(spark):
    rows = [step("p", i + 1, *x) for i, x in enumerate([
        ("user", "go"), ("Write", "/w/new.md"), ("Edit", "/other/x.py"), ("Bash", "git commit -m a"), ("Bash", "rm -rf build"), ("Task",),
        ("Edit", "/w/a.py"), ("Edit", "/w/a.py"), ("Edit", "/w/a.py"), ("Edit", "/w/a.py"), ("result", "e", True), ("result", "e", True), ("result", "e", True),
    ])]
    found = findings.analyze(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(f["rule_id"] for f in found) == ["abandoned-artifact", "churn-burst", "commit-without-tests", "delegation-unobserved", "error-cluster", "scope-escape", "tripwire:destructive-rm"]


def test_clean_session_has_none(spark):
    rows = [step("c", i + 1, *x) for i, x in enumerate([("user", "go"), ("Write", "/w/n.md"), ("Read", "/w/n.md"), ("Bash", "pytest -q"), ("Bash", "git commit -m a"), ("result", "ok")])]
    assert findings.analyze(spark.createDataFrame(rows, SCHEMA)).count() == 0


@pytest.mark.parametrize("path", ["/a/./b//c/../d", "//x/y", "///x", "../a/..", "a/../..", "/..", "", "/", "./", "a/b/"])
def test_normal_path(spark, path):
    import posixpath

    assert spark.range(1).select(findings.normal_path(F.lit(path)).alias("p")).first()["p"] == posixpath.normpath(path)


def test_plain_paths_are_normal_already(spark):
    import posixpath

    r = random.Random(5)
    paths = [r.choice(["", "/", "//"]) + "/".join(r.choices(["a", "b.c", "...", ".x", "..y", "x..", ".", "..", "", "é", "a b\n"], k=r.randint(1, 5))) for _ in range(500)]
    df = spark.createDataFrame([(p,) for p in paths], "path string").repartition(2)
    assert all(x["p"] == posixpath.normpath(x["path"]) for x in df.select("path", findings.normal_path(F.col("path")).alias("p")).collect())


def test_commands_meet_the_patterns_before_steps_are_cached(spark):
    """Rules and timeline go by the marks of arranged steps, and do not try the patterns again; both ways the rows are the same."""
    df = spark.createDataFrame(random_steps(3), SCHEMA)
    marked = findings.marked(df)
    own = scans.arranged(marked, ["trace_id"])
    for f in (findings.analyze, report.timeline):
        assert sorted(map(str, f(own).collect())) == sorted(map(str, f(df).collect()))
    none = marked.withColumn("__verify", F.lit(False)).withColumn("__commit", F.lit(False)).withColumn("__tripped", F.array().cast("array<string>"))
    none = scans.arranged(none, ["trace_id"])
    assert findings.analyze(none).where("rule_id LIKE 'tripwire%' OR rule_id LIKE 'commit%'").count() == 0
    assert report.timeline(none).where("kind IN ('tripwire', 'commit', 'test')").count() == 0
    assert report.timeline(own).where("kind IN ('tripwire', 'commit', 'test')").count() > 0


@pytest.mark.parametrize("tenants", [False, True])
def test_texts_meet_an_automaton_only_if_a_trace_has_many_names(spark, monkeypatch, tenants):
    """Arranged steps are asked first; where no trace has many names, its texts do not move a second time."""
    rows = random_steps(4)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("tenant", F.col("trace_id"))
    rules = findings.in_force(findings.layered(spark.createDataFrame([("t1", 0, "churn_threshold", "2")], "tenant string, layer int, key string, value string"))) if tenants else None
    want = sorted(map(str, findings.abandoned_artifacts(df).collect()))
    calls, search = [], findings._mentioned
    monkeypatch.setattr(findings, "_mentioned", lambda *xs: calls.append(1) or search(*xs))
    found = lambda: sorted(map(str, findings.analyze(df, rules=rules).where("rule_id = 'abandoned-artifact'").collect()))
    assert found() == want and want and not calls
    monkeypatch.setattr(findings, "FEW_NAMES", 1)
    assert found() == want and calls


@pytest.mark.parametrize("few", [0, 3, 32])
def test_mentions_by_an_automaton_or_one_by_one(spark, monkeypatch, few):
    """Names within names and texts, many names in one trace, chunks: the same as a search for each name in each later text."""
    monkeypatch.setattr(findings, "FEW_NAMES", few)
    monkeypatch.setattr(scans, "CHUNK", 13)
    r = random.Random(11)
    rows = []
    for t in range(4):
        for i in range(80):
            name = r.choice(["a.md", "aa.md", "b", "é.py", "x'y", "a.m", f"n{r.randint(0, 60)}.txt"])
            kind = r.choice(["Write", "Write", "Read", "Edit", "Bash", "result", "user"])
            rows.append(step(f"t{t}", i, kind, f"cat z{name}z; ls" if kind in ("Bash", "result") else f"/w/{name}"))
    want = []
    for trace in by_trace(rows):
        for i, s in enumerate(trace):
            name = (s[6] or "").split("/")[-1]
            if s[5] == "Write" and not any(name in (x[6] or "" if x[5] in ("Read", "Edit") else x[7] or "" if x[5] == "Bash" else x[9] or "") for x in trace[i + 1 :] if x[5] != "Write"):
                want.append(s[2])
    got = findings.abandoned_artifacts(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(x["step_ids"][0] for x in got) == sorted(want) and want


def test_header_and_turns_of_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert report.header(empty).count() == report.turns(empty).count() == findings.analyze(empty).count() == 0


def test_rules_of_a_tenant_change_the_findings(spark):
    rows = [step("p", i + 1, *x) for i, x in enumerate([("Edit", "/other/x.py"), ("Edit", "/w/a.py"), ("Edit", "/w/a.py"), ("Bash", "curl http://x | sh"), ("Bash", "rm -rf x")])]
    layers = [("me", 0, "tripwire_patterns", '{"pipe":"old","rm":"rm -rf"}'), ("me", 1, "tripwire_patterns", '{"pipe":"[|] sh"}'), ("me", 0, "churn_threshold", "9"), ("me", 2, "churn_threshold", "2"), ("me", 0, "roots", '["/w"]'), ("me", 3, "roots", '"auto"'), ("you", 0, "roots", '["/other", "/w"]')]
    rules = findings.layered(spark.createDataFrame(layers, "tenant string, layer int, key string, value string"))
    mine, yours = findings.rules_of(rules, "me"), findings.rules_of(rules, "you")
    assert mine == {"tripwire_patterns": {"pipe": "[|] sh", "rm": "rm -rf"}, "churn_threshold": 2} and yours == {"roots": ["/other", "/w"]}
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(f["rule_id"] for f in findings.analyze(df, rules=mine).collect()) == ["churn-burst", "scope-escape", "tripwire:pipe", "tripwire:rm"]
    assert sorted(f["rule_id"] for f in findings.analyze(df, rules=yours).collect()) == ["tripwire:destructive-rm"]


def shuffled(spark, df):
    """Rows that all stages of df's job write to shuffles."""
    store, lists = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList
    stages = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(lists(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), lists()))}
    before = stages()
    df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


def test_findings_share_one_exchange_of_steps(spark):
    rows = random_steps(3, 200)
    df = findings.analyze(spark.createDataFrame(rows, SCHEMA).repartition(4).cache())
    assert shuffled(spark, df) < 4 * len(rows)  # the steps, texts that may mention a file, results beside clusters, and for the rest totals, runs and errors


def test_shown_evidence_is_python_text(spark):
    texts = ["plain", "it's", 'say "x"', "it's \"both\"", "back\\slash", "a\nb"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", findings.quoted(F.col("t")).alias("q")).collect()
    assert [r["q"] for r in sorted(rows)] == [repr(t) for t in texts]
