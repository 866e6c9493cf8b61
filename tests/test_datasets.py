from distillery.operators import datasets, evaluate
from distillery.sources import sinks

LONG = "these are at least fifteen words so that the section counts as one with substance indeed. "
FULL = "# T\n" + "".join(f"## {h}\n{LONG}{h} ends here now.\n\n### Aside\nmore\n" for h in ("Summary", "motivation", "Goals", "Proposal", "Drawbacks", "Alternatives"))


def test_sections_and_questions(spark, tmp_path):
    docs = spark.createDataFrame([("a/one.md", FULL), ("a/two.md", FULL), ("a/template.md", FULL), ("b/thin.md", "## Summary\nshort\n\n## Design\nx")], "document_id string, text string")
    thin = {r.section: r.content for r in datasets.sections(docs.where("document_id = 'b/thin.md'")).collect()}
    assert thin == {"summary": "short", "design": "x"}
    whole = {r.section: r.content for r in datasets.sections(docs.where("document_id = 'a/one.md'")).collect()}
    assert set(whole) == set(datasets.HEADERS) and whole["summary"].endswith("### Aside\nmore")
    assert sorted(r.document_id for r in datasets.strong_documents(docs).collect()) == ["a/one.md", "a/two.md"]
    two = datasets.question_set(docs, 25, each=2).orderBy("question_id").collect()
    assert [(r.question_id, r.category) for r in two] == [("one-design", "workflow"), ("one-summary", "general"), ("two-alternatives", "decision"), ("two-motivation", "constraint")]
    assert two[1].question == "What is the summary of document one?" and two[1].expected_phrases[0].startswith("these are")
    assert [r.question_id for r in datasets.question_set(docs, 1).collect()] == ["one-summary"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "strategy string, recall double")
    sinks.write_results(rows, str(tmp_path / "r"))
    assert sinks.read_results(spark, str(tmp_path / "r")).count() == 2
    for _ in range(2):
        sinks.append_history(rows, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 4
    sinks.write_details(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    report = evaluate.markdown_report(rows, [], ["recall"])
    for _ in range(2):
        sinks.update_report(report, str(tmp_path / "m"), first="# Notes")
    lines = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert lines.count("| **a** | 100.00% |") == 1 and lines.count("## Evaluation") == 1 and lines[0] == "# Notes"
