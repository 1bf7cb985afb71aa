"""Stores and ledgers over two runs, documents on disk, traces that share an id, long sessions of records."""

import hashlib
import json
import random
import time
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stepsight.functions import scans
from stepsight.functions.pyjson import canonical_json, is_flat, py_repr
from stepsight.functions.tables import shared_dir
from stepsight.jobs import registry
from stepsight.operators import attest, corpus, drift, evaluate, findings, report
from stepsight.sources import adapters, documents, ledger, sessions

from .test_sessions import record, text, use


def test_a_second_run_reads_new_and_grown_transcripts_only(spark, tmp_path):
    logs, book = tmp_path / "logs" / "p", str(tmp_path / "ledger")
    logs.mkdir(parents=True)
    for i in range(3):
        (logs / f"s{i}.jsonl").write_text(record("user", f"u{i}", "go") + "\n")
    glob = f"{tmp_path}/logs/*/*.jsonl"
    lines, entries = ledger.read_unread(spark, glob, book)
    assert lines.count() == 3 and not [r for r in ledger.known(spark, book).collect()]
    ledger.noted(entries, book)
    lines, entries = ledger.read_unread(spark, glob, book)
    assert lines.count() == entries.count() == 0
    time.sleep(0.01)
    (logs / "s1.jsonl").write_text(record("user", "u1", "go") + "\n" + record("assistant", "a1", [text("more")]) + "\n")
    (logs / "s9.jsonl").write_text(record("user", "u9", "go") + "\n")
    lines, entries = ledger.read_unread(spark, glob, book)
    assert sorted((r["session"], json.loads(r["value"])["uuid"]) for r in lines.collect()) == [("s1", "a1"), ("s1", "u1"), ("s9", "u9")]
    ledger.noted(entries, book)
    assert ledger.unread(spark, glob, book).count() == 0


def scored_steps(spark, n=30):
    rows = [("t", i, f"s{i}", f"do {i % 4}\nthen {i}", f"did {i % 4}") for i in range(n)]
    return spark.createDataFrame(rows, "trace_id string, seq long, step_id string, declared_intent string, payload_text string")


def test_a_second_run_predicts_nothing(spark, tmp_path):
    store, s = str(tmp_path / "store"), scored_steps(spark)
    first = sorted(drift.score_nli(s, store=store, model="m@1").collect())
    stored = spark.read.parquet(store).count()

    def never(pairs):
        raise AssertionError("a pair was predicted again")

    assert sorted(drift.score_nli(s, never, store, "m@1").collect()) == first == sorted(drift.score_nli(s).collect())
    assert spark.read.parquet(store).count() == stored
    more = scored_steps(spark, 31)
    drift.score_nli(more, store=store, model="m@1").count()
    assert spark.read.parquet(store).count() == stored + 1  # one new pair: `then 30`; `do 2` with its action was there
    drift.score_nli(s, store=store, model="m@2").count()
    assert spark.read.parquet(store).where("model = 'm@2'").count() == stored


def test_predictions_are_remembered_without_scores(spark, tmp_path):
    """Each pair is hashed once and none is sorted to be told apart; null, empty and equal texts as before."""
    store = str(tmp_path / "store")
    rows = [("t", i, f"s{i}", g, p) for i, (g, p) in enumerate([("a b", "a b"), ("a b", None), ("a b", ""), ("", "a b"), (None, "a b"), ("a b\na b", "a b"), ("x\na b", "x")])]
    s = spark.createDataFrame(rows, "trace_id string, seq long, step_id string, declared_intent string, payload_text string")
    drift.remember(s.where("seq < 3"), store)
    assert spark.read.parquet(store).count() == 3
    drift.remember(s, store)
    assert spark.read.parquet(store).groupBy("key").count().where("count > 1").count() == 0 and spark.read.parquet(store).count() == 6
    neutral = lambda pairs: pairs[[]].assign(contra=0.0, entail=0.0, neutral=1.0)
    assert sorted(drift.score_nli(s, neutral, store).collect()) == sorted(drift.score_nli(s).collect()) and drift.score_nli(s).count() == 6
    plan = drift.score_nli(s)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "sha2" in plan


def test_batches_hold_pairs_of_like_length(spark):
    pairs = spark.createDataFrame([(str(i), "p" * (i * 37 % 100), "h") for i in range(100)], "key string, premise string, hypothesis string").coalesce(1)

    def widths(own):
        size = own["premise"].str.len() + own["hypothesis"].str.len()
        return own[[]].assign(contra=size.diff().fillna(0).min(), entail=0.0, neutral=0.0)

    assert {r["contra"] for r in drift.predicted(pairs, widths).collect()} == {0.0}  # lengths never fall within a batch


def test_sessions_without_a_name_stay_apart(spark, tmp_path):
    """Twenty transcripts that don't say who they are: findings, reports and drift of each by itself."""
    for i in range(20):
        lines = [record("user", f"u{i}", "go", sessionId=None, cwd="/w"), record("assistant", f"a{i}", [use("Bash", command="pytest -q" if i % 2 else "ls")], sessionId=None), record("assistant", f"b{i}", [use("Bash", command="git commit -m x")], sessionId=None)]
        (tmp_path / f"n{i:02}.jsonl").write_text("\n".join(lines) + "\n")
    s = sessions.normalised(sessions.read_lines(spark, f"{tmp_path}/*.jsonl"))
    assert {r["trace_id"] for r in s.collect()} == {"unknown"} and s.select("trace_key").distinct().count() == 20
    found = findings.analyze(s).collect()
    assert sorted((r["trace_key"], r["rule_id"]) for r in found) == [(f"n{i:02}", "commit-without-tests") for i in range(0, 20, 2)]
    assert report.header(s).where("n_steps = 3 AND n_tool_calls = 2").count() == 20
    text_of = {r["trace_key"]: r["markdown"] for r in report.rendered(s, findings.analyze(s)).collect()}
    assert len(text_of) == 20 and ["commit-without-tests" in text_of[f"n{i:02}"] for i in range(20)] == [i % 2 == 0 for i in range(20)]
    scored = drift.score_jaccard(drift.with_payload_text(s.withColumn("declared_intent", F.lit("pytest"))))
    assert drift.trace_drift(s, scored, "jaccard").count() == 20
    assert attest.packs(drift.trace_drift(s, scored, "jaccard"), s).select("trace_key", "digest").distinct().count() == 20


def test_step_ids_without_uuid(spark, tmp_path):
    lines = [record("assistant", None, [use("Bash", command="a"), use("Bash", command="b"), use("Bash", command="c")], parentUuid="x"), record("user", "u", [{"type": "tool_result", "content": "1"}, {"type": "tool_result", "content": "2"}])]
    (tmp_path / "t.jsonl").write_text("\n".join(lines) + "\n")
    got = [(r["step_id"], r["parent_step_id"]) for r in sessions.normalised(sessions.read_lines(spark, f"{tmp_path}/t.jsonl")).orderBy("seq").collect()]
    assert got == [("s1-0", "x"), ("s1-1-1", "s1-0"), ("s1-2-2", "s1-1-1"), ("u", None), ("u-1", "u")]


def test_a_hundred_thousand_task_records_fold_in_seconds(spark):
    kind = "named_struct('kind', '{}', 'subject', {}, 'status', {}, 'task', {}, 'said', CAST(NULL AS STRING))".format
    none = "CAST(NULL AS STRING)"
    create, done = kind("create", "concat('task ', id div 2)", none, "CAST(NULL AS INT)"), kind("update", none, "'completed'", "CAST(id div 2 AS INT) - 4")
    anchors = spark.range(100_000).selectExpr("'one' AS session", "id AS line", f"array(CASE WHEN id % 2 = 0 THEN {create} ELSE {done} END) AS acts").repartition(4)
    began = time.time()
    plans = {r["line"]: r["plan"] for r in sessions.standing_plans(anchors).collect()}
    assert time.time() - began < 30
    assert len(plans) > 99_900 and plans[99_998] == "\n".join(f"task {i}" for i in range(49_995 - 1, 50_000)) and plans[99_999] == "\n".join(f"task {i}" for i in range(49_995, 50_000))


@pytest.mark.parametrize("size", [1, 3, 100_000])
def test_plans_and_places_are_carried_over_chunks(spark, monkeypatch, size):
    monkeypatch.setattr(scans, "CHUNK", size)
    rows = []
    for i in range(40):
        blocks = [text(f"plan {i}")] if i % 7 == 0 else [use("Bash", f"t{i}", command="ls"), use("Read", f"r{i}", file_path="/x")] if i % 3 else []
        rows.append(("a" if i % 5 else "b", i, record("assistant", f"u{i}", blocks)))
    got = sessions.normalised(spark.createDataFrame(rows, "session string, line long, value string")).collect()
    want, place, plan = [], {}, {}
    for session, i, value in rows:
        blocks = [b for b in json.loads(value)["message"]["content"] if b["type"] == "tool_use"]
        if i % 7 == 0:
            plan[session] = f"plan {i}"
        for _ in blocks or [None]:
            place[session] = place.get(session, 0) + 1
            want.append((session, place[session], plan.get(session)))
    assert sorted((r["session"], r["seq"], r["declared_intent"]) for r in got) == sorted(want)


def test_lists_of_spans_checkpoints_and_messages_are_read_from_files(spark, tmp_path):
    span = {"span_id": "a", "trace_id": "T", "parent_span_id": None, "name": "n", "start_time": "2024-01-01T00:00:00Z", "attributes": {"openinference.span.kind": "LLM", "input.value": "hi"}}
    check = {"config": {"configurable": {"thread_id": "C"}}, "checkpoint": {"id": "1", "channel_values": {"intent": "do"}}, "metadata": {"step": 2, "writes": {"respond": {"messages": [{"type": "ai", "content": "x"}]}}}, "parent_config": None}
    chat = [{"role": "system", "content": "s"}, {"role": "user", "content": "u", "session_id": "M"}, {"role": "assistant", "content": None, "tool_calls": [{"id": "c1", "function": {"name": "ls", "arguments": "{}"}}]}, {"role": "tool", "tool_call_id": "c1", "content": "out"}]
    for name, value in (("spans", [span, span | {"span_id": "b", "parent_span_id": "a"}]), ("checks", [check]), ("chat", chat), ("broken", None)):
        (tmp_path / f"{name}.json").write_text(json.dumps(value) if value else "{not json")
    spans = adapters.span_steps(adapters.read_lists(spark, f"{tmp_path}/spans.json", adapters.SPAN)).orderBy("seq").collect()
    assert [(r["trace_id"], r["step_id"], r["parent_step_id"], r["declared_intent"], r["action_type"]) for r in spans] == [("T", "a", None, "hi", "utterance"), ("T", "b", "a", "hi", "utterance")]
    checks = adapters.checkpoint_steps(adapters.read_lists(spark, f"{tmp_path}/checks.json", adapters.CHECKPOINT), F.lit("2024-01-01").cast("timestamp")).collect()
    assert [(r["trace_id"], r["step_id"], r["declared_intent"], r["action_type"], json.loads(r["payload"])["output"], str(r["ts"])) for r in checks] == [("C", "ck-1", "do", "utterance", "x", "2024-01-01 00:00:02")]
    chats = adapters.chat_steps(adapters.read_lists(spark, f"{tmp_path}/chat.json", adapters.MESSAGE)).orderBy("seq").collect()
    assert [(r["trace_id"], r["actor"], r["tool_name"], r["tool_result"], r["parent_step_id"]) for r in chats] == [("unknown", "user", None, None, None), ("unknown", "agent", "ls", None, None), ("unknown", "tool", None, "out", "unknown-step-2")]
    assert adapters.read_lists(spark, f"{tmp_path}/broken.json", adapters.SPAN).count() == 0


def plain_steps(spark, traces=3, n=50):
    rows = [(f"t{t}", i + 1, f"s{i}", "agent", "tool_call", "Bash", f'{{"command":"c{i}"}}', None, f"intent {i}", None, False, f"adapter{t % 2}") for t in range(traces) for i in range(n)]
    return spark.createDataFrame(rows, "trace_id string, seq long, step_id string, actor string, action_type string, tool_name string, payload string, text string, declared_intent string, tool_result string, is_error boolean, source_adapter string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))


def test_a_trace_in_shards_is_the_same_trace(spark, tmp_path):
    s = plain_steps(spark)
    whole, parts = documents.trace_documents(s), documents.trace_documents(s, 7)
    assert parts.count() == 3 * 8 and max(len(json.loads(r["value"])["steps"]) for r in parts.collect()) <= 7
    for name, docs in (("whole", whole), ("parts", parts.orderBy(F.rand(3)))):
        documents.write_documents(docs, str(tmp_path / name))
    columns = ("trace_id", "seq", "step_id", "declared_intent", "command")
    one, many = (documents.read_traces(spark, str(tmp_path / x)).orderBy("trace_id", "seq") for x in ("whole", "parts"))
    assert one.select(*columns).collect() == many.select(*columns).collect()
    assert one.select("trace_key").distinct().count() == many.select("trace_key").distinct().count() == 3


def test_documents_and_reports_are_written_by_adapter(spark, tmp_path):
    s = plain_steps(spark)
    docs = documents.trace_documents(s).join(s.select("trace_id", "source_adapter").distinct(), "trace_id")
    documents.write_documents(docs, str(tmp_path / "by"), by="source_adapter")
    assert sorted(x.name for x in (tmp_path / "by").iterdir() if x.is_dir()) == ["source_adapter=adapter0", "source_adapter=adapter1"]
    assert documents.read_traces(spark, f"{tmp_path}/by/source_adapter=adapter1").select("trace_id").distinct().count() == 1
    rows = spark.createDataFrame([("t", "# one\n\n- two")], "trace_id string, markdown string")
    documents.write_reports(rows, str(tmp_path / "reports"))
    assert [tuple(json.loads(r["value"]).values()) for r in spark.read.text(str(tmp_path / "reports")).collect()] == [("t", "# one\n\n- two")]


def test_packs_tell_probes_claims_replays_and_who_scored(spark):
    s = plain_steps(spark, 2, 4).withColumn("flow_type", F.lit("chat")).withColumn("tenant_id", F.lit("acme")).withColumn("agent_config_ref", F.lit("cfg"))
    scored = drift.score_two_stage(drift.with_payload_text(s), spark.createDataFrame([], "trace_id string, step_id string, label string, severity string, reasoning string, evidence string"))
    d = drift.trace_drift(s, scored, models={"nli_model": "gate", "nli_revision": "7", "judge_model": "j", "judge_temperature": 0.5})
    probes = spark.createDataFrame([("t0", "p2", "f", "1", True, "low", None), ("t0", "p1", "f", "1", False, "high", "seen")], "trace_id string, " + attest.PROBE_RESULT.replace(":", " ").replace(",", ", "))
    claims = spark.createDataFrame([("t1", "act", "12", "logs are kept")], "trace_id string, regime string, article string, claim string")
    replays = attest.replayed(s, s.select("trace_id", "step_id", "action_type", F.lit('{"command":"c0"}').alias("payload"))).withColumn("policy", F.lit("other"))
    packs = {r["trace_id"]: json.loads(r["manifest"]) for r in attest.packs(d, s, scored, probes=probes, claims=claims, replays=replays).collect()}
    assert [p["probe_id"] for p in packs["t0"]["probe_results"]] == ["p1", "p2"] and packs["t1"]["probe_results"] == []
    assert packs["t1"]["jurisdiction_claims"] == [{"regime": "act", "article": "12", "claim": "logs are kept"}] and packs["t0"]["jurisdiction_claims"] == []
    assert packs["t0"]["drift_metrics"]["scorer_fingerprint"] == {"method": "llm-judge", "method_version": "0.3", "nli_model": "gate", "nli_revision": "7", "judge_model": "j", "judge_temperature": 0.5}
    assert packs["t0"]["trace_summary"]["flow_types"] == ["chat"] and packs["t0"]["subject"] == {"agent_config_ref": "cfg", "agent_version": "0", "tenant_id": "acme"}
    assert packs["t0"]["counterfactual_diffs"][0]["divergence_step"] == "s1" and len(json.loads(packs["t0"]["counterfactual_diffs"][0]["diff_summary"])) == 3
    assert attest.tampered(*(x := attest.packs(d, s, scored),) * 2).count() == 0


def test_runs_of_two_models_that_call_their_traces_alike(spark, tmp_path):
    def trace(path):
        step = {"step_id": "unknown-step-1", "trace_id": "unknown", "timestamp": "2024-01-01T00:00:00Z", "actor": "agent", "declared_intent": "x", "action": {"type": "tool_call", "payload": {"name": "ReadFile", "input": {"path": path}}}}
        return {"trace_id": "unknown", "flow_type": "code", "agent_config_ref": "c", "source_adapter": "a", "steps": [step]}

    def pack(label):
        per = {"unknown-step-1": {"step_id": "unknown-step-1", "label": label, "reasoning": "NLI gate: contradict (unjudged — budget exhausted)" if label != "neutral" else "NLI gate: neutral"}}
        return {"pack_id": "x", "drift_metrics": {"drift_score": 1.0, "flagged_steps": ["unknown-step-1"] if label != "neutral" else [], "method": "m", "method_version": "1", "per_step": per}}

    for model, seed, path, label in (("m1", "distractor", "a/unrelated_script.py", "undeclared_goal"), ("m2", "distractor", "a/models.py", "neutral"), ("m2", "scope-narrow", "api.py", "neutral"), ("m1", "baseline", "api.py", "goal_deviation")):
        folder = tmp_path / model / seed
        folder.mkdir(parents=True)
        (folder / "trace.json").write_text(json.dumps(trace(path)))
        (folder / "pack.json").write_text(json.dumps(pack(label)))
    steps = evaluate.by_run(documents.read_traces(spark, f"{tmp_path}/*/*/trace.json"))
    scored = evaluate.by_run(documents.pack_steps(documents.read_packs(spark, f"{tmp_path}/*/*/pack.json")))
    truth = evaluate.ground_truth(steps, steps.select("trace_key", "trace_id", "seed").distinct())
    assert {(r["trace_key"], r["occurred"]) for r in truth.collect()} == {("m1/distractor", True), ("m2/distractor", False), ("m2/scope-narrow", True), ("m1/baseline", False)}
    table = {r["seed"]: r for r in evaluate.cross_tabulated(truth, scored).collect()}
    assert (table[None]["n_occurred"], table[None]["n_hit"], table[None]["n_label"], table[None]["n_false"], table[None]["n_clean"]) == (2, 1, 1, 1, 2)
    who = {r["trace_key"]: (r["gate_fired"], r["judge_called"], r["judge_decided"], r["label"]) for r in evaluate.offence_attribution(truth, scored).collect()}
    assert who == {"m1/distractor": (True, True, False, "undeclared_goal"), "m2/scope-narrow": (True, False, False, "neutral")}


def test_tenants_with_roots_need_no_cwd(spark):
    layers = spark.createDataFrame([("a", 0, "roots", '["/w"]'), ("b", 0, "churn_threshold", "2")], "tenant string, layer int, key string, value string")
    rules = findings.in_force(findings.layered(layers))
    traces = spark.createDataFrame([("t1", "a", None), ("t2", "b", None), ("t3", None, None), ("t4", "b", "/w")], "trace_id string, tenant string, cwd string")
    assert sorted(r["trace_id"] for r in findings.not_checked(traces, rules).collect()) == ["t2", "t3"]
    assert sorted(r["trace_id"] for r in findings.not_checked(traces).collect()) == ["t1", "t2", "t3"]


def test_json_is_shown_alike_by_built_in_functions_and_python(spark):
    """Flat objects of plain strings, and all that is not quite that."""
    r = random.Random(4)
    values = ['{}', ' { } ', '{"a":"b"}', '{"a" : "b" , "c":"d"}', '{"a":":"}', '{":":"x"}', '{"a":", ","b":" : "}', '{"a":"1","a":"2"}', '{"a":1}', '{"a":null,"b":true}', '{"a":"it\'s"}', '{"a":"q\\"q"}', '{"a":"é"}', '{"a":{"b":"c"}}', '[1]', '"x"', 'nul', '', None, '{"a":"' + "x" * 5000 + '"}', '{"b_1":"{x}","A":"[y], {z: w}"}', '{"a":"}","b":"{"}', '\n{"a":\n"b"}\n', '{"a":"b"} x', '{"Z":"1","a":"2","Z1":"3","_":"4"}', '{"a":"\t"}']
    for _ in range(300):
        values.append(json.dumps({"".join(r.choices("abZ_1", k=r.randint(1, 3))): "".join(r.choices("ab:,{}[] =/\\'\"\né~!", weights=[9] * 12 + [1] * 6, k=r.randint(0, 8))) for _ in range(r.randint(0, 4))}, ensure_ascii=r.random() < 0.5, separators=r.choice([(",", ":"), (", ", ": "), (" ,  ", " : ")])))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = df.select("i", py_repr("v").alias("shown"), canonical_json("v").alias("canonical"), is_flat(F.col("v")).alias("flat")).orderBy("i").collect()

    def python(v, show):
        try:
            return show(json.loads(v))
        except (ValueError, TypeError):
            return None

    assert [x["shown"] for x in got] == [python(v, str) for v in values]
    assert [x["canonical"] for x in got] == [python(v, lambda o: json.dumps(o, sort_keys=True, separators=(",", ":"))) for v in values]
    assert 150 < sum(x["flat"] for x in got) < 300


def test_payload_texts_as_python_shows_them(spark):
    rows = [("tool_call", n, p, None) for n in ("Bash", None, "it's", 'q"') for p in ('{"command":"ls"}', None, '{"a":1}', '{"a":"b","c":{"d":[1,null]}}')] + [("utterance", None, None, t) for t in ("plain", None, "it's", "two\nlines", "é")] + [(None, None, None, "x")]
    s = spark.createDataFrame([(i, *r, "go") for i, r in enumerate(rows)], "i int, action_type string, tool_name string, payload string, text string, declared_intent string")
    want = [str({"name": n, "input": json.loads(p) if p else None}) if a == "tool_call" else str({"text": t or ""}) for a, n, p, t in rows]
    assert [r["payload_text"] for r in drift.with_payload_text(s).orderBy("i").collect()] == want


def test_manifests_are_canonical_whatever_is_in_them(spark):
    """Whatever the texts and numbers: the bytes are those of Python's canonical JSON, and the digest is theirs."""
    names = ["plain", "it's", 'q"\\', "\u00e9\u4e2d", "tab\t\x01\x7f", "\U0001f600", "</x>"]
    s = spark.createDataFrame([(n, i, f"{n}-{i}", f"do {n} {i}", "tool_call", "Bash", '{"command":"ls"}', None, None) for n in names for i in range(12)], "trace_id string, seq long, step_id string, declared_intent string, action_type string, tool_name string, payload string, text string, ts timestamp")
    scored = drift.score_two_stage(drift.with_payload_text(s), spark.createDataFrame([], "trace_id string, step_id string, label string, severity string, reasoning string, evidence string"))
    for score in (0.5, 0.0, 0.00005, 1 / 3, 0.002, 1.0, 12345678.0, None):
        for heat in (0.0, 1e-5, 0.7):
            d = drift.trace_drift(s, scored, models={"judge_temperature": heat}).withColumn("drift_score", F.lit(score).cast("double"))
            if (score, heat) not in ((0.5, 0.0), (0.00005, 0.7), (1 / 3, 1e-5), (None, 0.7), (12345678.0, 0.7)):
                continue
            rows = attest.packs(d, s, scored).collect()
            assert len(rows) == len(names)
            for r in rows:
                own = json.loads(r["manifest"])
                assert r["manifest"] == json.dumps(own, sort_keys=True, separators=(",", ":"))
                assert r["digest"] == hashlib.sha256(r["manifest"].encode()).hexdigest()
                assert list(own["drift_metrics"]["drift_per_trace"]) == [r["trace_id"]] and own["drift_metrics"]["drift_score"] == (None if score is None else round(score, 12))
                assert len(own["drift_metrics"]["per_step"]) == 12


def test_long_json_goes_to_workers_a_hundred_texts_at_a_time(spark):
    """Not in Arrow batches of 10,000, which hold that many manifests at once."""
    plan = spark.range(3).select(canonical_json(F.concat(F.lit('{"b":[1],"a":'), "id", F.lit("}"))).alias("c"))
    assert [r["c"] for r in plan.orderBy("c").collect()] == [f'{{"a":{i},"b":[1]}}' for i in range(3)]
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in shown and "ArrowEvalPython" not in shown


def test_top_lists_come_from_one_pass(spark):
    """The lists of several metrics are those of each, and records are parsed once for all of them."""
    call = lambda name: json.dumps({"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "1", "name": name, "input": {}}]}})
    lines = [("s", i, call(n), a) for i, (n, a) in enumerate([("Bash", "x"), ("Read", "x"), ("Bash", None), ("TaskCreate", None), ("TaskCreate", None)])] + [("t", 0, '{"type":"user"}', None)]
    records = sessions.records(spark.createDataFrame(lines, "session string, line int, value string, agent_id string"))
    metrics = ("record_type", "delegate_tool", "anchor")
    got = corpus.tops(corpus.counts(records), metrics)
    stats = corpus.statistics(records)
    want = [(m, *r) for m in metrics for r in corpus.top(stats, m).collect()]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) == 7
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_unread_files_are_looked_at_once(spark, tmp_path):
    """Entries are a table of their own: what comes or goes later does not change them, and looking at them opens no transcript."""
    (tmp_path / "logs").mkdir()
    for i in range(3):
        (tmp_path / "logs" / f"s{i}.jsonl").write_text('{"type":"user"}\n')
    lines, entries = ledger.read_unread(spark, str(tmp_path / "logs"), str(tmp_path / "book"))
    assert lines.count() == 3
    (tmp_path / "logs" / "s2.jsonl").unlink()
    assert entries.count() == 3 and "binaryFile" not in entries._jdf.queryExecution().executedPlan().toString()
    ledger.noted(entries, str(tmp_path / "book"))
    (tmp_path / "logs" / "s3.jsonl").write_text('{"type":"user"}\n')
    again, left = ledger.read_unread(spark, str(tmp_path / "logs"), str(tmp_path / "book"))
    assert left.count() == again.count() == 1


def test_files_with_odd_names_are_read(spark, tmp_path):
    """The entries spelled a space as it is and the lines' paths as %20: such transcripts were noted as read and none of their lines came."""
    logs, book = tmp_path / "my logs", str(tmp_path / "book")
    logs.mkdir()
    for name in ("s 1", "s%41", "s+2", "sü"):
        (logs / f"{name}.jsonl").write_text('{"type":"user"}\n')
    for run in (4, 0):
        lines, entries = ledger.read_unread(spark, str(logs), book)
        assert lines.count() == entries.count() == run
        ledger.noted(entries, book)


def test_transcripts_share_files(spark, tmp_path):
    """Files and ledger grow with bytes, not with sessions: each session had a folder and a file of its own before."""
    when = datetime(2024, 1, 1)
    events = [(1000 * u + i, when, u, ("click", "view", "error")[i % 3], 1.0, f'{{"k": {i}}}') for u in range(60) for i in range(11)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    shared = Path(shared_dir(spark))
    before = set(shared.glob("transcripts-*"))
    got = registry.QUERIES["s1_unread_transcripts"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted((str(u), 11) for u in range(60) if u % 3 < 2)
    (folder,) = set(shared.glob("transcripts-*")) - before
    assert len(list(folder.rglob("*.txt"))) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) and len(list(folder.glob("ledger/*.parquet"))) == 1


def test_a_file_holds_whole_transcripts_in_order(spark, tmp_path):
    logs, book = str(tmp_path / "logs"), str(tmp_path / "book")
    for run, ids in enumerate((range(20), range(20, 25))):
        rows = [(f"s {i}/{i}", j, json.dumps({"type": "user", "uuid": str(j), "sessionId": f"s {i}/{i}"})) for j in (*range(6, 12), *range(6)) for i in ids]
        sessions.write_lines(spark.createDataFrame(rows, "session string, line int, value string").repartition(5), logs)
        lines, entries = ledger.read_unread(spark, logs, book)
        found = {}
        for r in lines.orderBy("path", "line").collect():
            found.setdefault((r["session"], r["path"]), []).append(int(json.loads(r["value"])["uuid"]))
        assert sorted(s for s, _ in found) == sorted(f"s {i}/{i}" for i in ids) and all(v == list(range(12)) for v in found.values()), run
        ledger.noted(entries, book)
    assert ledger.unread(spark, logs, book).count() == 0


def test_a_line_is_parsed_once_whatever_is_asked_of_its_record(spark):
    rows = [("s", 0, '{"type":"user","uuid":"a"}'), ("s", 1, "[1]"), ("s", 2, "no"), ("s", 3, None), ("s", 4, '{"type":"mystery"}'), ("s", 5, '{"type":"user"}'), ("s", 6, "{}")]
    r = sessions.records(spark.createDataFrame(rows, "session string, line int, value string"))
    assert {x["line"]: x["type"] for x in r.collect()}.keys() >= {0, 4, 5, 6} and not {x["line"] for x in r.collect()} & {3}
    own = r.where("type = 'user'").select("line", "uuid")
    assert sorted(x["line"] for x in own.collect()) == [0, 5]
    assert own._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
