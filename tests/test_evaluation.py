"""An evaluation run against its parts, and resumed; the command line."""

import json

import pytest
from pyspark.sql import functions as F

from folioloom.__main__ import main
from folioloom.operators import chunk, evaluate, search
from folioloom.plans import evaluation
from folioloom.sources import readers

TEXT = "\n".join([*("# One", "alpha beta " * 20, "gamma " * 30), *("# Two", "delta " * 60, "epsilon " * 50), *("# Three", "zeta " * 10)])
LABELLED = {
    "meta": {"top_k": 2, "corpus_lines": 7},
    "queries": [
        {"id": "q1", "type": "fact", "query": "alpha", "expected_advantage": "sliding_window", "answer_spans": [{"start_line": 2, "end_line": 3}]},
        {"id": "q2", "type": "list", "query": "delta", "expected_advantage": "header_aware", "answer_spans": [{"start_line": 5, "end_line": 5}, {"start_line": 7, "end_line": 7}]},
        {"id": "q3", "type": "fact", "query": "nothing", "answer_spans": [{"start_line": 1, "end_line": 1}]},
    ],
}


@pytest.fixture()
def corpus(spark, tmp_path):
    (tmp_path / "c.md").write_text(TEXT, encoding="utf-8")
    return readers.load_batch(spark, str(tmp_path / "c.md"))[0]


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.collect())))


def test_run_is_its_parts_and_resumes(spark, tmp_path, corpus):
    queries, spans = evaluation.golden(spark, LABELLED)
    root = str(tmp_path / "runs")
    first = evaluation.Run(root, corpus, queries, spans, evaluation.Settings(("sliding_window",), 2))
    assert first.run() == ["sliding_window"] and first.run() == []
    both = evaluation.Run(root, corpus, queries, spans, evaluation.Settings(("sliding_window", "header_aware"), 2))
    assert both.path == first.path and both.run() == ["header_aware"]
    made = both.manifests()
    assert made["header_aware"]["n_chunks"] == 3 and made["header_aware"]["k"] == 2 and made["header_aware"]["n_retrieved"] == 6
    asked = queries.select(F.col("qid").alias("query_id"), search.engine("text_hash")(F.col("query")).alias("query_vector"))
    want = None
    for s in ("sliding_window", "header_aware"):
        store = search.embed(chunk.chunk(corpus, s)[0], search.engine("text_hash"))
        some = search.top_k_each(store, asked, 2).select(F.lit(s).alias("strategy"), F.col("query_id").alias("qid"), "rank", "location.start_line", "location.end_line")
        want = some if want is None else want.unionByName(some)
    assert rows(both.retrievals().select("strategy", "qid", "rank", "start_line", "end_line")) == rows(want)
    found = both.results()
    assert rows(found["metrics"].drop("n_chunks")) == rows(evaluate.metrics(evaluate.score(want, spans), "strategy"))
    assert {(r.qid, r.strategy): (r.covered, r.total) for r in found["coverage"].collect()}["q2", "header_aware"] == (2, 2)
    assert found["warnings"].count() >= 0 and {r.strategy for r in found["profile"].collect()} == {"sliding_window", "header_aware"}
    # Other settings, another corpus or other labels are other runs.
    assert evaluation.Run(root, corpus, queries, spans, evaluation.Settings(top_k=3)).path != both.path
    assert evaluation.Run(root, corpus.where("element_idx > 0"), queries, spans, both.settings).path != both.path
    ratio = evaluation.Run(root, corpus, queries, spans, evaluation.Settings(("header_aware",), k_ratio=0.9, k_min=1))
    ratio.run()
    assert ratio.manifests()["header_aware"]["k"] == 3


def test_a_run_that_ends_early_counts_for_nothing(spark, tmp_path, corpus, monkeypatch):
    queries, spans = evaluation.golden(spark, LABELLED)
    run = evaluation.Run(str(tmp_path / "runs"), corpus, queries, spans, evaluation.Settings(("header_aware",), 2))
    with monkeypatch.context() as m:
        m.setattr(search, "top_k_each", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run.run()
    with pytest.raises(ValueError, match="nothing has been run"):
        run.results()
    assert run.run() == ["header_aware"]
    with pytest.raises(ValueError, match="runs backwards"):
        evaluation.Run(str(tmp_path / "runs"), corpus, queries, spans.withColumn("end_line", F.lit(0)))


def test_gate(spark):
    probes = [("a", "a", "b"), ("c", "c", "d")]
    row = evaluation.gate(spark, "text_hash", probes).first()
    assert row.same_dimension and row.least_separation > 0


def test_command_line(spark, tmp_path, corpus, capsys):
    (tmp_path / "g.json").write_text(json.dumps(LABELLED))
    base = ["evaluate", "--golden", str(tmp_path / "g.json"), "--corpus", str(tmp_path / "c.md"), "--report-dir", str(tmp_path / "reports")]
    assert main([*base, "--validate-golden"], spark) == 0
    assert main(base, spark) == 2
    assert main([*base, "--allow-mock"], spark) == 0
    said = capsys.readouterr().out
    assert 'ran ["sliding_window", "header_aware"]' in said and "metrics {" in said
    assert main(["parse", str(tmp_path / "c.md")], spark) == 0 and '"content": "One"' in capsys.readouterr().out
