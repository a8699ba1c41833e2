"""Prompts, strict answers, cached calls, templates and checks."""

import json
import typing
from dataclasses import dataclass

import pytest

from terrane.gateway import calls, prompts
from terrane.operators import template

MODEL = calls.Model("b", "http://here", "m")
ASK = prompts.Prompt("name.it", "1", "Be {tone}.", "Name {{x}} for {thing}.")


@dataclass
class Part:
    code: str


@dataclass
class Answer:
    title: str
    size: int | None
    kind: typing.Literal["a", "b"]
    parts: list[Part]
    done: bool


GOOD = {"title": "t", "size": None, "kind": "a", "parts": [{"code": "c"}], "done": True}


def test_prompts():
    assert ASK.render({"tone": "brief", "thing": "a {pump}"}) == ("Be brief.", "Name {x} for a {pump}.")
    for values in ({"tone": "x"}, {"tone": "x", "thing": "y", "more": "z"}):
        with pytest.raises(prompts.GatewayError):
            ASK.render(values)
    for bad in ("{a.b}", "{}", "{a!r}", "open {", "close }"):
        with pytest.raises(prompts.GatewayError):
            prompts.Prompt("x", "1", "s", bad).gaps()
    assert ASK.digest() != prompts.Prompt("name.it", "2", ASK.system, ASK.user).digest()


def test_strict_shapes():
    s = prompts.shape(Answer)
    assert s["required"] == ["title", "size", "kind", "parts", "done"] and s["additionalProperties"] is False and prompts.problems(GOOD, s) == []
    for change in ({"size": "1"}, {"size": True}, {"kind": "c"}, {"parts": [{"code": 1}]}, {"parts": [{}]}, {"more": 1}, {"done": 1}, {"title": None}):
        assert prompts.problems({**GOOD, **change}, s), change
    assert prompts.problems({k: v for k, v in GOOD.items() if k != "done"}, s) == ["$: no done"]

    @dataclass
    class Loose:
        a: str = "x"

    for kind in (Loose, float, int | str, dict):
        with pytest.raises(prompts.GatewayError):
            prompts.shape(kind)
    assert prompts.without({"type": "object", "properties": {"type": {"type": "string", "enum": []}}}, frozenset({"type"})) == {"properties": {"type": {"enum": []}}}


def test_cached_and_retried_calls():
    asked, slept, fails = [], [], [calls.Again("busy"), calls.Again("busy")]

    def chat(system, said, schema):
        asked.append(said)
        if fails:
            raise fails.pop()
        return f"answer {len(asked)}"

    g = calls.Gateway(MODEL, chat, wait=slept.append)
    values = {"tone": "brief", "thing": "pump"}
    assert g.text(ASK, values) == g.text(ASK, values) == "answer 3" and slept == [2.0, 4.0] and len(asked) == 3
    assert g.text(ASK, {**values, "thing": "ram"}) == "answer 4"
    elsewhere = calls.Gateway(calls.Model("b", "http://there", "m"), chat, cache=g.cache)
    assert elsewhere.text(ASK, values) == "answer 5" and [x["attempt"] for x in g.log] == [1, 2, 3, 0, 1]
    fails.extend([calls.Again("busy")] * 9)
    with pytest.raises(prompts.GatewayError, match="gave up after 4"):
        g.text(ASK, {**values, "thing": "valve"})


def test_answers_are_repaired_and_only_good_ones_cached():
    answers, seen = ["no json", json.dumps({**GOOD, "kind": "z"}), json.dumps(GOOD)], []
    g = calls.Gateway(MODEL, lambda system, said, schema: (seen.append(list(said)), answers.pop(0))[1])
    values, schema = {"tone": "brief", "thing": "pump"}, prompts.shape(Answer)
    assert g.structured(ASK, values, schema) == g.structured(ASK, values, schema) == GOOD
    assert [len(s) for s in seen] == [1, 3, 5] and "not one of" in seen[2][-1]["content"] and len(g.cache) == 1
    bad = calls.Gateway(MODEL, lambda *a: "[]", repairs=1)
    with pytest.raises(prompts.GatewayError, match="after 2"):
        bad.structured(ASK, values, schema)
    assert not bad.cache


def test_embeddings_in_batches():
    batches = []
    g = calls.Gateway(calls.Model("b", "s", "m", batch=2), embedder=lambda texts: (batches.append(texts), [[float(len(t)), 1.0] for t in texts])[1])
    assert g.embed(["a", "bb", "a", "ccc"]) == [[1.0, 1.0], [2.0, 1.0], [1.0, 1.0], [3.0, 1.0]] and batches == [["a", "bb"], ["ccc"]]
    g.embed(["a", "dddd"])
    assert batches[2:] == [["dddd"]]
    for client in (lambda t: [[1.0]] * (len(t) + 1), lambda t: [[1.0] * (k + 1) for k in range(len(t))]):
        with pytest.raises(prompts.GatewayError):
            calls.Gateway(MODEL, embedder=client).embed(["a", "b"])
    with pytest.raises(prompts.GatewayError):
        g.embed([])


def test_answers_over_a_frame(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "prompt string")
    cache = spark.createDataFrame([], "key string, answer string")
    asked, new = calls.complete(rows, MODEL, lambda: str.upper, cache)
    new = spark.createDataFrame(new.collect(), new.schema)
    assert sorted((r.prompt, r.answer) for r in calls.answered(asked, new).collect()) == [("a", "A"), ("b", "B")]
    assert calls.complete(rows, MODEL, lambda: str.upper, new)[1].isEmpty() and not calls.complete(rows, calls.Model("b", "x", "m"), lambda: str.upper, new)[1].isEmpty()


def test_all_checks_run():
    def broken():
        raise OSError("down")

    assert calls.run_checks({"a": broken, "b": lambda: None, "c": lambda: "3 rows"}) == [("a", False, "OSError: down"), ("b", True, "ok"), ("c", True, "3 rows")]
    assert calls.check_models({"chat": broken})[0][0] == "model chat"


def plan():
    metric = {"id": "m", "source": "patent_data", "requires_fields": ["priority_date"], "uses_definitions": ["time_basis"], "reference_practice": ["r"]}
    return {
        "references": [{"id": "r"}], "definitions": [{"id": "time_basis"}], "metrics": [metric], "chart_types": [{"id": "bar"}],
        "sections": [{"id": "one", "source_type": "patent_data", "required_facts": ["m"], "charts": [{"id": "c", "chart_type": "bar", "metrics": ["m"]}], "subsections": [{"id": "two", "tables": [{"id": "t", "metrics": ["m"]}]}]}],
        "appendices": [{"id": "x", "required_facts": ["m"]}],
    }


def test_a_template_without_problems():
    assert template.problems(plan(), ("one",)) == [] and "| m |" in template.definitions_document(plan())


@pytest.mark.parametrize("change,said", [
    (lambda t: t["metrics"].append(dict(t["metrics"][0])), "metric m is there 2 times"), (lambda t: t["sections"][0]["subsections"].append({"id": "one"}), "section one is there 2 times"),
    (lambda t: t["sections"][0]["subsections"][0]["tables"].append({"id": "c", "metrics": []}), "chart or table c is there 2 times"), (lambda t: t["appendices"][0]["required_facts"].append("n"), "appendix x: no metric n"),
    (lambda t: t["sections"][0]["charts"][0].update(chart_type="pie"), "section one, c: no chart type pie"), (lambda t: t["definitions"].append({"id": "d"}), "definition d is never used"), (lambda t: t["chart_types"].append({"id": "pie"}), "chart type pie is never used"),
    (lambda t: t["sections"][0].update(id="other"), "section one is missing"), (lambda t: t["metrics"][0].update(source="classification"), "section one of patent_data uses m of classification"), (lambda t: t["metrics"][0].update(requires_fields=[]), "metric m lists no fields"),
    (lambda t: t["metrics"][0].update(requires_fields=["applicants"]), "metric m uses time_basis without any of ['priority_date']"), (lambda t: t["metrics"][0].update(excludes_incomplete_periods=True), "metric m leaves out periods without incomplete_period"),
    (lambda t: t["metrics"][0]["uses_definitions"].append("segment_labels"), "metric m uses segment_labels and isn't of classification"),
])
def test_templates_with_problems(change, said):
    t = plan()
    change(t)
    assert said in template.problems(t, ("one",))


def test_sections_out_of_order():
    t = plan()
    t["sections"] = [{"id": "b"}, {"id": "a"}, *t["sections"]]
    assert "sections are out of order" in template.problems(t, ("a", "b"))
