"""Rules of row acceptance, each by a row that fails it first, and hashes beside Python's own JSON."""

import hashlib
import json

from pyspark.sql import functions as F

from lodestone.operators import acceptance as A

DOC = {"id": "d1", "text": "The fox is red. It \"runs\" é.", "title": "Fox"}
NEW = {"id": "d2", "text": "The den is deep.", "title": "Den"}
digest = lambda x: hashlib.sha256(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def row(action="answer", step=1, evidence=(DOC,), **change):
    value = "red" if action == "answer" else "deep den?"
    key = "answer" if action == "answer" else "query"
    tools = [{"role": "assistant", "content": json.dumps({"action": "search", "query": "Fox colour"})}, {"role": "tool", "content": json.dumps({"result": list(evidence)})}] if evidence else []
    r = {"question": "What colour is the FOX?", "task_id": "t", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}, *tools, {"role": "assistant", "content": json.dumps({"action": action, key: value})}], "target": {"action": action, "value": value}, "step": step, "risk_labels": ["time"], "evidence": list(evidence), "retrieval_results": [NEW]}
    r["target_assistant_index"] = len(r["messages"]) - 1
    r |= {k: v for k, v in change.items() if k in r}
    r["evidence_hash"] = digest(r["evidence"])
    r["state_hash"] = digest({"question": "what colour is the fox", "messages": r["messages"][:-1]})
    r |= {k: v for k, v in change.items() if k.endswith("_hash")}
    cites = [{"document_id": "d1", "quote": "fox is red"}] if action == "answer" else [{"document_id": "d2", "quote": "den is deep"}]
    one = lambda kind, who: {"approved": True, "candidate_hash": digest([r["state_hash"], r["target"], r["evidence_hash"]]), "citations": cites, "kind": kind, "missing_fact": "depth", "reason": "fine", "reviewer": who, "state_hash": r["state_hash"]} | change.get("review", {})
    r["reviews"] = [one("api", "Ann"), one("task_agent", change.get("second", "Bo"))]
    return r | {k: v for k, v in change.items() if k == "reviews"}


def say(*messages):
    return [{"role": r, "content": c} for r, c in messages]


GOOD = row()["messages"]
CASES = [
    (row(), None), (row("search"), None), (row("search", 0, ()), None),
    (row(question=" "), "question_required"), (row(task_id=""), "task_id_required"), (row(messages=[]), "messages_required"),
    (row(messages=[{"role": "judge", "content": "x"}, *GOOD[1:]]), "invalid_visible_message"), (row(target_assistant_index=2), "final_target_assistant_required"),
    (row(target={"action": "stop", "value": "x"}), "invalid_target"), (row(target={"action": "answer", "value": "blue"}), "target_message_mismatch"), (row(messages=[*GOOD[:-1], *say(("assistant", "red"))]), "target_message_mismatch"),
    (row(step=-1), "invalid_step"), (row(risk_labels=["time", "time"]), "invalid_risk_labels"), (row(risk_labels=["odd"]), "invalid_risk_labels"),
    (row(evidence=(DOC | {"text": " "},)), "evidence_required"), (row(evidence=(DOC, DOC)), "evidence_required"), (row(evidence=()), "empty_evidence_only_initial_search"),
    (row(messages=[*GOOD[:3], *say(("tool", "[1]")), GOOD[-1]]), "malformed_tool_evidence"), (row(messages=[*GOOD[:3], *say(("tool", "torn {")), GOOD[-1]]), "visible_evidence_mismatch"),
    (row(evidence_hash="0"), "evidence_hash_mismatch"), (row(messages=[*say(("system", "Gold answer: red")), *GOOD[1:]]), "gold_metadata_in_messages"),
    (row(second="ann "), "dual_approved_reviews_required"), (row(review={"approved": False}), "dual_approved_reviews_required"), (row(review={"candidate_hash": "0"}), "dual_approved_reviews_required"),
    (row(state_hash="0"), "state_hash_mismatch"), (row(review={"citations": []}), "review_citations_required"), (row(review={"citations": [{"document_id": "d2", "quote": "den"}]}), "review_citations_required"),
    (row("search", review={"missing_fact": ""}), "search_gap_required"), (row("search", review={"citations": [{"document_id": "d1", "quote": "fox"}]}), "search_citation_must_add_evidence"),
    (row("search", retrieval_results=[NEW | {"id": "d2", "text": DOC["text"]}], review={"citations": [{"document_id": "d2", "quote": "fox"}]}), "search_citation_must_add_evidence"),
    (row("search", target={"action": "search", "value": "fox -- COLOUR"}, messages=[*GOOD[:-1], *say(("assistant", '{"action": "search", "query": "fox -- COLOUR"}'))]), "repeated_search_target"),
]


def test_first_failures(spark):
    lines = [json.dumps(r | {"n": n}) for n, (r, _) in enumerate(CASES)] + [json.dumps({"n": len(CASES), "question": "x"})]
    rows = spark.createDataFrame([(x,) for x in lines], "v string").select(F.from_json("v", A.SCHEMA + ", n int").alias("r")).select("r.*")
    got = dict(rows.select("n", A.first_failure().alias("code")).collect())
    wrong = {n: (got[n], code) for n, (_, code) in enumerate(CASES) if got[n] != code}
    assert not wrong
    assert got[len(CASES)] == "missing_fields:" + ",".join(f for f in A.FIELDS if f != "question")
    assert {code for _, code in CASES} - {None} and rows.limit(0).select(A.first_failure()).count() == 0
