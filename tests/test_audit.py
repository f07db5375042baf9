"""Objects in replies, graders and auditors against plain Python."""

import json

import pandas as pd
from pyspark.sql import functions as F

from strataq.operators import audit
from strataq.plans import catalog


def object_by_scan(text):
    start = (text or "").find("{")
    depth, quoted, escaped = 0, False, False
    for k in range(start, len(text)) if start >= 0 else ():
        ch = text[k]
        if escaped:
            escaped = False
        elif ch == "\\":
            escaped = True
        elif ch == '"':
            quoted = not quoted
        elif not quoted and ch in "{}":
            depth += 1 if ch == "{" else -1
            if not depth:
                try:
                    json.loads(text[start : k + 1])
                except ValueError:
                    return None
                return text[start : k + 1]
    return None


TEXTS = [None, "", "none", "{", "}", "{}", "} {} {", '{"a": 1', '{"a": {"b": [1, {"c": "}"}]}} tail {"x": 1}', '{broken} {"ok": 1}', 'say "{" and {"a": 1}', '\\{"a": 1}', '{"a": "\\"}{"}', '{"a": "\\\\"}', '{"a": "é日本\\u00e9"}', "{'a': 1}", '{"a": 1}}', "{" * 5000, '{"t": "' + "x{}" * 20_000 + '"}', '{"a": "x\\', 'a\\"{"b": 2}', '{"a": "line\nbreak"}']


def test_first_objects(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string").select("k", audit.first_json(F.col("text")).alias("found"))
    assert {r.k: r.found for r in rows.collect()} == {k: object_by_scan(t) for k, t in enumerate(TEXTS)}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_document_gives_its_object(spark, sf_dir):
    rows = catalog.QUERIES["first_json"](spark, sf_dir)
    assert rows.where("object is null or object not like concat('%[', doc_id, ']}, \"text\": %')").count() == 0
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


REPLIES = {1: '{"sufficient": false, "confidence": 0.7, "missing": " the date ", "refinedQuery": " when "}', 2: 'So: {"sufficient": true, "confidence": 0.9, "missing": "x", "refinedQuery": "y"}', 3: None, 4: "no object", 5: '{"sufficient": false}', 6: '{"sufficient": false, "confidence": 1, "missing": " ", "refinedQuery": ""}'}


def test_graders_and_their_failures(spark):
    questions = spark.createDataFrame([(k, f"Q{k}?") for k in [*REPLIES, 9]], "question_id long, question string")
    passages = spark.createDataFrame([(k, p, f"passage {p} of {k} " + "z" * 3000) for k in REPLIES for p in (2, 1)], "question_id long, position int, content string")

    def model(prompts):
        for batch in prompts:
            out = []
            for p in batch:
                if p is not None:
                    assert '<passage id="1">\npassage 1 of' in p and p.count("z") == 2 * (2000 - len("passage 1 of 1 "))
                out.append(None if p is None else REPLIES[int(p.split("?")[0][-1])])
            yield pd.Series(out, dtype=object)

    got = {r.question_id: tuple(r)[1:] for r in audit.graded(questions, passages, model).collect()}
    assert got == {1: (False, 0.7, "the date", "when"), 2: (True, 0.9, None, None), 3: (True, 0.0, None, None), 4: (True, 0.0, None, None), 5: (True, 0.0, None, None), 6: (False, 1.0, None, None), 9: (False, 1.0, audit.NOTHING_FOUND, None)}


def test_auditors_and_their_failures(spark):
    long = "An answer that is long enough to be looked at by an auditor."
    said = {"supported": True, "issues": [], "contradictions": [{"claim": "The timeout.", "detail": "a", "sources": [1, 3]}, {"claim": "the TIMEOUT", "detail": "b", "sources": [2, 3]}, {"claim": "other", "detail": "c", "sources": [1, 9]}, {"claim": "none", "detail": "d", "sources": None}]}
    replies = {1: json.dumps(said), 2: json.dumps({**said, "issues": ["made up"], "contradictions": []}), 3: None, 4: "{", 5: json.dumps({**said, "supported": False, "contradictions": []}), 6: "unused", 7: "unused"}
    answers = spark.createDataFrame([(k, f"Q{k}?", long if k != 6 else " short ") for k in replies], "question_id long, question string, answer string")
    sources = spark.createDataFrame([(k, m, "</sources> text") for k in replies if k != 7 for m in (1, 2, 3)], "question_id long, marker int, content string")

    def model(prompts):
        for batch in prompts:
            assert all(p is None or ("<answer>" in p and p.count("</sources>") == 1) for p in batch)  # a source can't close the block
            yield pd.Series([None if p is None else replies[int(p.split("?")[0][-1])] for p in batch], dtype=object)

    verdicts, found = audit.audited(answers, sources, model)
    assert {r.question_id: (r.supported, r.issues) for r in verdicts.collect()} == {1: (True, []), 2: (False, ["made up"]), 3: (True, []), 4: (True, []), 5: (False, []), 6: (True, []), 7: (True, [])}
    assert [tuple(r) for r in found.collect()] == [(1, "The timeout.", "a", [1, 2, 3])]
