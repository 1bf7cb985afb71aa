"""Raw session logs written to a folder: malformed lines, standing plans, delegates, plan stores, redaction."""

import json

import pytest
from pyspark.sql import functions as F

from stepsight.functions.pyjson import canonical_json, py_repr
from stepsight.operators import corpus
from stepsight.operators import evaluate
from stepsight.sources import adapters, documents, sessions


def record(kind, uuid, blocks, **more):
    return json.dumps({"type": kind, "uuid": uuid, "sessionId": "s1", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": kind, "content": blocks}} | more)


def use(name, ident="t", **given):
    return {"type": "tool_use", "id": ident, "name": name, "input": given}


def text(t):
    return {"type": "text", "text": t}


@pytest.fixture()
def corpus_dir(tmp_path):
    project = tmp_path / "proj"
    sub = project / "s1" / "subagents"
    sub.mkdir(parents=True)
    lines = [
        record("user", "u1", "do it", parentUuid=None, cwd="/w"),
        "not json",
        "[1, 2]",
        "",
        record("assistant", "a1", [text(" narrate "), use("TodoWrite", todos=[{"content": "one", "status": "pending"}, {"content": "done", "status": "completed"}]), use("Bash", command="ls")], parentUuid="u1"),
        record("user", "u2", [{"type": "tool_result", "tool_use_id": "t", "content": "ok", "is_error": True}]),
        record("assistant", "a2", [use("TaskCreate", subject="first"), use("TaskCreate", subject="second")]),
        record("assistant", "a3", [use("TaskUpdate", taskId="1", status="completed"), use("TaskUpdate", taskId="9", status="completed"), use("Read", file_path="/w/x")]),
        record("assistant", "a4", [use("TodoWrite", todos=[])]),
        record("assistant", "a5", [use("Task", "d1", description="brief", prompt="please")]),
        record("summary", "z", []),
        record("assistant", "a6", [{"type": "thinking", "thinking": "hmm"}]),
        record("assistant", "a7", [use("Agent", "d2", description="lost")]),
    ]
    (project / "s1.jsonl").write_text("\n".join(lines) + "\n")
    (sub / "agent-x.jsonl").write_text(record("user", "x1", "please") + "\n" + record("assistant", "x2", [use("Bash", command="pwd")]) + "\n")
    (sub / "agent-x.meta.json").write_text(json.dumps({"toolUseId": "d1", "description": "brief"}))
    (sub / "agent-y.jsonl").write_text(record("odd", "y1", []) + "\n")
    store = tmp_path / "plans" / "s1"
    store.mkdir(parents=True)
    (store / "1.json").write_text(json.dumps({"subject": "stored", "status": "pending"}))
    (store / "x.json").write_text("{}")
    (store / "2.json").write_text("broken")
    return tmp_path


def test_steps(spark, corpus_dir):
    lines = sessions.read_lines(spark, f"{corpus_dir}/proj/*.jsonl")
    assert lines.count() == 10
    rows = {r["step_id"]: r for r in sessions.normalised(lines).collect()}
    assert rows["u1"]["text"] == "do it" and rows["u1"]["actor"] == "user"
    assert rows["a1"]["declared_intent"] == "narrate" and rows["a1-1"]["declared_intent"] == "one" and rows["a1-1"]["parent_step_id"] == "a1"
    assert rows["u2"]["is_error"] and rows["u2"]["action_type"] == "env_effect"
    assert rows["a2"]["declared_intent"] == "first\nsecond"
    assert rows["a3-2"]["declared_intent"] == "second" and rows["a3-2"]["file_path"] == "/w/x"
    assert rows["a4"]["declared_intent"] is None and rows["a5"]["declared_intent"] is None
    assert rows["a6"]["declared_intent"] == "hmm" and rows["a6"]["text"] == ""
    assert rows["a7"]["declared_intent"] == "hmm" and rows["a7"]["delegation_unobserved"]
    assert [r["step_id"] for r in sorted(rows.values(), key=lambda r: r["seq"])][:3] == ["u1", "a1", "a1-1"]


def test_delegates(spark, corpus_dir):
    lines = sessions.read_lines(spark, f"{corpus_dir}/proj/*.jsonl")
    sub = sessions.read_lines(spark, f"{corpus_dir}/proj/*/subagents/*.jsonl")
    meta = sessions.read_subagent_meta(spark, f"{corpus_dir}/proj/*/subagents/*.meta.json")
    parents = sessions.normalised(lines, matched=meta)
    links = sessions.delegate_links(parents, meta)
    assert [(x["agent_id"], x["owner"], x["brief"]) for x in links.collect()] == [("x", "a5", "brief\n\nplease")]
    both = sessions.with_delegates(parents, sessions.delegate_steps(sub, links), links).collect()
    own = [r for r in both if r["agent_id"] == "x"]
    assert [(r["step_id"], r["parent_step_id"], r["declared_intent"]) for r in sorted(own, key=lambda r: r["seq"])] == [("x1", "a5", None), ("x2", "a5", "brief\n\nplease")]
    assert min(r["seq"] for r in own) > max(r["seq"] for r in both if r["agent_id"] is None)
    assert not [r for r in both if r["step_id"] == "a5"][0]["delegation_unobserved"]
    parsed = sessions.records(sub)
    assert [(r["agent_id"], r["breach"]) for r in corpus.subagent_breaches(sub, meta, parsed).collect()] == [("y", "no-meta")]


def test_plan_store(spark, corpus_dir):
    rows = sessions.read_plan_store(spark, f"{corpus_dir}/plans/*/*.json").collect()
    assert [(r["session"], r["n"], r["subject"]) for r in rows] == [("s1", 1, "stored")]


def test_stored_plan_stands_first(spark, corpus_dir):
    seeds = sessions.plan_seeds(sessions.read_plan_store(spark, f"{corpus_dir}/plans/*/*.json"))
    assert [tuple(r) for r in seeds.collect()] == [("s1", "stored")]
    lines = [("s1", 1, record("assistant", "b1", [use("Bash", command="ls")])), ("s1", 2, record("assistant", "b2", [use("TodoWrite", todos=[])])), ("s1", 3, record("assistant", "b3", [use("Bash", command="ls")]))]
    rows = sessions.normalised(spark.createDataFrame(lines, "session string, line int, value string"), seeds=seeds).collect()
    assert {r["step_id"]: r["declared_intent"] for r in rows} == {"b1": "stored", "b2": None, "b3": None}


def test_rejects_and_led_lines(spark, tmp_path):
    (tmp_path / "e1.jsonl").write_text('\t{"type":"summary"}\n  {"type":"odd"}\n')
    (tmp_path / "e2.jsonl").write_text("\t" + record("user", "u", "x") + "\n")
    lines = sessions.read_lines(spark, f"{tmp_path}/*.jsonl")
    assert lines.count() == 3 and [r["session"] for r in sessions.rejects(lines).collect()] == ["e1"]


def test_task_lists_follow_a_plain_fold(spark):
    import random

    r, lines, want = random.Random(4), [], {}
    for session in ("a", "b"):
        tasks, plan = [], None
        for line in range(60):
            acts = []
            for _ in range(r.randint(1, 3)):
                kind = r.choice(["create", "update", "update", "set"])
                acts.append({"create": ("create", f"t{line}", None, None, None), "set": ("set", None, None, None, r.choice([None, "said"])), "update": ("update", None, r.choice(["completed", "in_progress", "", None]), r.choice([0, 1, 2, 5, 99, None]), None)}[kind])
            touched = False
            for kind, subject, status, task, said in acts:
                if kind == "set":
                    plan, touched = said, True
                elif kind == "create" or (task and task <= len(tasks) and status):
                    if kind == "create":
                        tasks.append([subject, "pending"])
                    else:
                        tasks[task - 1][1] = status
                    plan, touched = "\n".join(s for s, x in tasks if x in ("pending", "in_progress")) or None, True
            if touched:
                want[session, line] = plan
            lines.append((session, line, acts))
    df = spark.createDataFrame(lines, "session string, line int, acts array<struct<kind:string,subject:string,status:string,task:int,said:string>>")
    assert {(x["session"], x["line"]): x["plan"] for x in sessions.standing_plans(df).collect()} == want


def test_redaction_keeps_sizes_as_python_shows_them(spark):
    given = {"command": "it's \"é\"", "n": None, "flag": True}
    blocks = [{"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "x"}]}, {"type": "tool_result", "tool_use_id": "t", "content": "plain"}, {"type": "tool_result", "tool_use_id": "t"}]
    lines = [("s", 1, record("assistant", "a", [use("Bash", **given)])), ("s", 2, record("user", "u", blocks))]
    rows = {r["step_id"]: r for r in sessions.normalised(spark.createDataFrame(lines, "session string, line int, value string"), redact=True).collect()}
    size = lambda x: json.loads(x)["size"]
    assert size(rows["a"]["payload"]) == len(str(given))
    assert [size(rows[k]["tool_result"]) for k in ("u", "u-1", "u-2")] == [len(str(blocks[0]["content"])), 5, 0]


def test_redaction_hides_inputs_and_results(spark, corpus_dir):
    rows = sessions.normalised(sessions.read_lines(spark, f"{corpus_dir}/proj/*.jsonl"), redact=True).collect()
    assert all("ls" not in (r["payload"] or "") and r["command"] is None for r in rows)
    assert any('"redacted":true' in (r["tool_result"] or "") for r in rows)


VALUES = [{"b": 1, "a": [True, None, "it's", 'q"'], "é": 1.5}, [], "x", {"n": {"z": 0, "a": "\n"}}]


def test_json_helpers(spark):
    df = spark.createDataFrame([(json.dumps(v),) for v in VALUES] + [("{bad",), (None,)], "j string")
    rows = df.select(py_repr("j").alias("r"), canonical_json("j").alias("c")).collect()
    assert [r["r"] for r in rows] == [str(v) for v in VALUES] + [None, None]
    assert [r["c"] for r in rows] == [json.dumps(v, sort_keys=True, separators=(",", ":")) for v in VALUES] + [None, None]


def test_traces_are_read_from_objects_lists_and_lines(spark, tmp_path):
    step = lambda i, **more: {"step_id": f"p{i}", "trace_id": "t", "timestamp": "2024-01-01T00:00:00Z", "actor": "agent", "declared_intent": "do", "action": {"type": "tool_call", "payload": {"name": "Bash", "input": {"command": f"ls {i}"}}}, "metadata": {}} | more
    trace = lambda name, n: {"trace_id": name, "flow_type": "code", "agent_config_ref": "c", "source_adapter": "a", "metadata": {"cwd": "/w"}, "steps": [step(i) for i in range(n)]}
    effect = step(9, actor="tool", action={"type": "env_effect", "payload": {"tool_result": "no", "is_error": True}}, metadata={"agent_id": "x", "delegation_unobserved": True})
    (tmp_path / "one.json").write_text(json.dumps(trace("one", 2) | {"steps": [step(0), effect]}, indent=1))
    (tmp_path / "many.json").write_text(json.dumps([trace("m1", 1), trace("m2", 3)]))
    (tmp_path / "lines.jsonl").write_text("\n".join(json.dumps(trace(f"l{i}", 1)) for i in range(2)) + "\nbroken\n")
    rows = documents.read_traces(spark, f"{tmp_path}/*").collect()
    assert sorted((r["trace_id"], r["seq"]) for r in rows) == [("l0", 0), ("l1", 0), ("m1", 0), ("m2", 0), ("m2", 1), ("m2", 2), ("one", 0), ("one", 1)]
    bad = [r for r in rows if r["trace_id"] == "one" and r["seq"] == 1][0]
    assert bad["is_error"] and bad["delegation_unobserved"] and bad["agent_id"] == "x" and bad["tool_result"] == "no" and bad["cwd"] == "/w"
    path = f"{tmp_path}/written"
    documents.write_documents(documents.trace_documents(documents.read_traces(spark, f"{tmp_path}/*.json")), path)
    back = documents.read_traces(spark, path)
    both = ["trace_id", "seq", "step_id", "ts", "actor", "declared_intent", "action_type", "tool_name", "command", "tool_result", "is_error", "agent_id", "cwd", "flow_type"]
    assert sorted(map(tuple, back.select(both).collect()), key=str) == sorted(map(tuple, documents.read_traces(spark, f"{tmp_path}/*.json").select(both).collect()), key=str)


def test_packs_give_their_steps(spark, tmp_path):
    folder = tmp_path / "m" / "format-strict"
    folder.mkdir(parents=True)
    per_step = {"s1": {"step_id": "s1", "label": "goal_deviation", "overturned_gate": False, "reasoning": "because", "severity": "HIGH"}, "s2": {"step_id": "s2", "label": "faithful", "reasoning": "NLI gate: entail"}}
    (folder / "pack.json").write_text(json.dumps({"pack_id": "p", "subject": {"agent_config_ref": "c", "agent_version": "1"}, "drift_metrics": {"drift_score": 0.5, "flagged_steps": ["s1"], "method": "m", "method_version": "1", "per_step": per_step}, "trace_summary": {"trace_count": 1}}, indent=2))
    rows = documents.pack_steps(documents.read_packs(spark, f"{tmp_path}/*/*/pack.json")).collect()
    assert sorted((r["model"], r["seed"], r["step_id"], r["flagged"], r["severity"], r["evidence"]) for r in rows) == [("m", "format-strict", "s1", True, "HIGH", "n/a"), ("m", "format-strict", "s2", False, "LOW", "n/a")]
    assert {r["decided_by"]: r["n"] for r in evaluate.attribution(documents.pack_steps(documents.read_packs(spark, f"{tmp_path}/*/*/pack.json"))).collect()} == {"judge": 1, "gate": 1}


def test_policies_provenance_and_probes(spark, tmp_path):
    rules = tmp_path / "w" / ".agent" / "rules"
    rules.mkdir(parents=True)
    (tmp_path / "w" / "POLICY.md").write_text("text\n## no\n#  Yes  \n# later\n")
    (rules / "a.md").write_text("no heading")
    rows = {r["path"].rsplit("/", 1)[1]: r for g in ("w/*.md", "w/.agent/rules/*.md") for r in documents.read_policies(spark, f"{tmp_path}/{g}").collect()}
    assert [(rows[k]["dir"], rows[k]["scope"], rows[k]["title"]) for k in ("POLICY.md", "a.md")] == [(f"{tmp_path}/w", "project", "Yes"), (f"{tmp_path}/w", "rules", None)]
    (tmp_path / "prov.jsonl").write_text('{"session_id":"a","agent":"x","recent_commits":["1","2"]}\n\n{"agent":"none"}\n{"session_id":"a","agent":"y"}\n')
    found = documents.read_provenance(spark, f"{tmp_path}/prov.jsonl")
    assert [(r["session_id"], r["agent"]) for r in found.orderBy("line").collect()] == [("a", "x"), ("a", "y")]
    probe = {"probe_id": "p", "family": "f", "version": "1", "kind": "pii_leak", "stimulus": {"channel": "user_message", "payload": {}}, "expected_behavior": {}}
    (tmp_path / "good.json").write_text(json.dumps(probe))
    (tmp_path / "bad.json").write_text(json.dumps(probe | {"kind": "unknown"}))
    (tmp_path / "worse.json").write_text("{")
    assert [(r["probe_id"], r["should_refuse"]) for r in documents.read_probes(spark, f"{tmp_path}/*.json").collect()] == [("p", True)]


def test_chat_tool_calls(spark):
    todo = json.dumps({"todos": [{"content": "one", "status": "pending"}]})
    messages = [{"role": "system", "content": "x"}, {"role": "user", "content": "go", "session_id": None}, {"role": "assistant", "content": "", "tool_calls": [{"id": "c1", "function": {"name": "TodoWrite", "arguments": todo}}, {"id": "c2", "function": {"name": "Read", "arguments": "broken"}}]}, {"role": "tool", "tool_call_id": "c2", "content": "body"}, {"role": "assistant", "content": ""}]
    lists = adapters.exploded(spark.createDataFrame([("s", json.dumps(messages))], "source string, value string"), adapters.MESSAGE)
    rows = sorted(adapters.chat_steps(lists).collect(), key=lambda r: r["seq"])
    assert [(r["actor"], r["declared_intent"], r["tool_name"], r["parent_step_id"]) for r in rows] == [("user", None, None, None), ("agent", "one", "TodoWrite", None), ("agent", "one", "Read", None), ("tool", None, None, "unknown-step-3"), ("agent", "one", None, None)]
    hidden = sorted(adapters.chat_steps(lists, redact=True).collect(), key=lambda r: r["seq"])
    assert json.loads(hidden[1]["payload"])["size"] == len(str({"name": "TodoWrite", "input": json.loads(todo)})) and json.loads(hidden[3]["tool_result"])["size"] == len(str({"tool_result": "body"}))


def test_unknown_seed_is_an_error(spark):
    steps = spark.createDataFrame([], "trace_id string, seq long, step_id string, action_type string, tool_name string, path string, payload string")
    truth = lambda seed: evaluate.ground_truth(steps, spark.createDataFrame([("t", seed)], "trace_id string, seed string")).collect()
    assert [r["occurred"] for r in truth("baseline")] == [False]
    with pytest.raises(Exception, match="no ground-truth rule for seed odd"):
        truth("odd")


def test_anchors_are_counted(spark):
    lines = [("s", 1, record("assistant", "a", [use("TodoWrite"), use("Bash")]), None), ("s", 1, record("assistant", "b", [use("TaskCreate"), use("Bash")]), "x")]
    rows = corpus.statistics(sessions.records(spark.createDataFrame(lines, "session string, line int, value string, agent_id string"))).collect()
    assert {(r["metric"], r["key"]): r["n"] for r in rows if r["metric"] in ("anchor", "delegate_tool")} == {("anchor", "TodoWrite"): 1, ("delegate_tool", "TaskCreate"): 1, ("delegate_tool", "Bash"): 1}
