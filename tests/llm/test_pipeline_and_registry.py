import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402


def test_registry():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert names[-1] == "pipeline" and "pipeline" not in entry.oracle_sql()
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece",
    ]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    line = "This very line is repeated in a number of documents of the corpus"
    clean = [(i, f"{line}\nDocument {i} says {' '.join(f'w{i}x{j}' for j in range(40))}") for i in range(30)]
    toxic = [(100 + i, f"{' '.join(f't{i}y{j}' for j in range(30))} blargword {' '.join(f't{i}z{j}' for j in range(9))}") for i in range(30)]
    item = "the answer to this question of the test is that nobody knows it for sure"
    more = [
        (200, clean[3][1].split("\n")[1] + " and more"),
        (201, clean[3][1].split("\n")[1]),
        (202, f"{' '.join(f'q{j}' for j in range(30))} {item} {' '.join(f'r{j}' for j in range(30))}"),
        (203, None),
        (204, ""),
    ]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in clean + toxic + more]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(d, 1, 0) for d, _ in clean] + [(d, 0, 1) for d, _ in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{folder}/stage-{name}"
        stage(spark, docs, folder).write.parquet(out)
        before, docs = docs.columns, spark.read.parquet(out)
        if at < 4:
            assert docs.columns == before
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert set(kept["toxicity"]) == {*range(30), *range(200, 205)}
    lines = kept["line_dedup"]
    assert set(lines) == set(kept["toxicity"])
    assert [d for d, r in lines.items() if "very line" in r.text] == [29]
    assert all(r.n_chars == len(r.text) for r in lines.values())
    assert set(kept["ngram_jaccard_join"]) == {*range(30), 202, 203, 204}
    assert set(kept["benchmark_decontamination"]) == {*range(30), 203, 204}
    last = kept["sentencepiece"]
    assert set(last) == set(kept["benchmark_decontamination"]) and all(r.round_trip for r in last.values())


def test_run_gives_the_stages_rows(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in found.select("doc_id").collect()} == {*range(30), 203, 204}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
@pytest.mark.parametrize("name", ["op1_warc", "op2_line_dedup", "op4_benchmark_decontamination", "op9_url_filters", "op10_document_fingerprints"])
def test_queries_against_sql(spark, name):
    sys.path.insert(0, os.path.join(os.path.dirname(corpus_pipeline.__file__), "tools"))
    from check_queries import compare, connect

    con = connect("/root/testdata/sf0.001")
    assert compare(entry.queries()[name](spark, "/root/testdata/sf0.001"), con, entry.oracle_sql()[name]) is None
