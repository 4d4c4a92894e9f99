import json

import pytest

from folioforge.operators import enrich as N
from folioforge.operators import enrichment as E

KIND = "id long, content string, file string"


def scripted(answers):
    """A client that travels to the workers by value. Answers by the first key that the prompt holds; None fails."""
    error = N.ModelError

    class Client:
        def complete(self, prompt, schema=None):
            got = next((v for k, v in answers.items() if k in prompt), "plain")
            if got is None:
                raise error("overloaded", True)
            return got

    return Client()


def test_routing_fallbacks_and_warnings(spark):
    rows = [(1, "alpha text", "a_b.txt"), (2, "beta text", "b.txt"), (3, "gamma text", "c.txt"), (4, None, "d.txt"), (5, " \n", "e.txt"), (6, "delta", "f.txt")]
    df = spark.createDataFrame(rows, KIND).withColumn("error", E.F.lit("kept"))
    client = scripted({"alpha": "```json\n" + json.dumps({"title": " A ", "summary": "s", "language": "en", "language_confidence": 7}) + "\n```", "beta": None, "gamma": "no json", "delta": '{"title": " ", "summary": "d"}'})
    got = {r.id: r for r in E.enriched(df, "id", client, E.Features("llm", "llm", "llm", translate_to="fr"), name=E.F.col("file")).collect()}
    assert (got[1].title, got[1].summary, got[1].language, got[1].language_confidence) == ("A", "s", "en", 1.0)
    assert got[2].title == "b" and got[2].summary is None and got[2].feature_status["title"].method == "local_fallback" and got[2].feature_status["summary"].status == "failed"
    assert got[2].warnings == ["enrichment failed: overloaded", "translation failed: overloaded"] and got[2].translated_content is None
    assert got[3].feature_status["language"].error == "the answer was not valid JSON" and got[3].translated_content == "no json\n"
    assert got[6].title == "f" and got[6].feature_status["title"].error == "the model gave no title" and got[6].language == "und"
    for k in (4, 5):
        assert got[k].feature_status["translation"].status == "skipped" and got[k].feature_status["title"].method == "local" and got[k].warnings == []
    assert all(r.error == "kept" and r.feature_status["extraction"].status == "disabled" for r in got.values()) and len(got) == 6


def test_long_texts_are_reduced_level_by_level(spark):
    line = "word " * 30 + "\n\n"
    rows = [(1, "short", ""), (2, line * 200, ""), (3, line * 200 + "sad " + line, ""), (4, None, "")]
    df = spark.createDataFrame(rows, KIND)
    got = {r.id: r for r in E.reduced(df, "id", "content", 1000, scripted({"sad": None})).collect()}
    assert got[1].text == "short" and got[4].text == "" and set(got[2].text.split("\n\n")) == {"plain"} and got[3].error == "overloaded"
    stuck = E.reduced(df.filter("id = 2"), "id", "content", 1000, scripted({"Summarise": line * 40}), levels=2).collect()
    assert [(r.text, r.error) for r in stuck] == [(None, E.TOO_LARGE)]


def test_sections_are_joined_with_one_blank_line(spark):
    one = spark.range(1).select(E.joined_sections(E.F.array(*map(E.F.lit, ["\na\n\n", "", "b", "c\n"]))).alias("x")).first().x
    assert one == "a\n\n\nb\n\nc\n"
    text = "".join(f"## Part {k}\n\n{'x y ' * 300}\n\n" for k in range(4))
    got = E.translated(spark.createDataFrame([(1, text, "")], KIND), "id", "content", "es", N.Mock(), 512).first()
    assert got.error is None and got.translated_content.count("Mock ") == 4 and "\n\n\n" not in got.translated_content


def test_extraction(spark):
    schema = {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}
    df = spark.createDataFrame([(1, "good", ""), (2, "never", ""), (3, None, ""), (4, "down", ""), (5, "é" * 3000, "")], KIND)
    client = scripted({"good": 'Here: {"n": 4}', "never": "{}", "down": None, "é": '{"n": 1}'})
    got = {r.id: r for r in E.extract_operation(df, "id", client, schema, max_input_tokens=4500).collect()}
    assert (got[1].extracted, got[1].status, got[1].code) == ('{"n": 4}', "completed", 200)
    assert got[2].code == 422 and got[2].error == "model output does not match extract_schema: $.n is required"
    assert (got[3].status, got[3].error, got[3].code) == ("skipped", "empty content", 200) and got[4].error == "overloaded"
    assert got[5].note.endswith("of 6000 bytes of content") and got[5].status == "completed"
    with pytest.raises(ValueError):
        E.extract_operation(df, "id", client, None)


def test_language_vote(spark):
    en, de = "the house is on the hill and it was for that " * 70, "der hund ist nicht auf dem berg und das ist ein haus " * 70
    df = spark.createDataFrame([(1, en, ""), (2, f"# A\n\n{en}\n\n# B\n\n{de}", ""), (3, "zzz 123", ""), (4, None, "")], KIND)
    got = {r.id: (r.language, r.language_confidence) for r in E.detected(df, "id", "content").collect()}
    assert got[1][0] == "en" and got[1][1] > 0.9 and got[2][0] == "mul" and got[3] == got[4] == ("und", 0.0)
