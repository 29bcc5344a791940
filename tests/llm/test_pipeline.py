"""The pipeline's stages, each against a plain version on its own input."""

import corpus_pipeline
import pytest

from spanlight.llm import quality
from spanlight.llm.common import text_of

from . import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    home = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 != 5), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, rows[2][1].split("\n")[1])], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return str(home)


@pytest.fixture(params=["broadcast", "shuffle"])
def lists(request, monkeypatch):
    """How the lists of dropped documents are joined: while they are small, and beyond."""
    if request.param == "shuffle":
        monkeypatch.setattr(corpus_pipeline, "DROPPED_ROWS", -1)


def kept(df):
    return {r["doc_id"] for r in df.collect()}


def test_stages(spark, docs, rows, folder):
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "decontamination", "tokens"]
    out = stage["quality"](spark, docs, folder)
    assert out.columns == COLUMNS
    scores = quality.score(text_of(docs), *quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    assert kept(out) == {r["doc_id"] for r in scores.where("score >= 0.3").collect()}
    out = stage["exact dedup"](spark, docs, folder)
    assert out.columns == COLUMNS and kept(out) == {i for i, *_, k, _ in brute.exact(rows) if k}
    out = stage["near dedup"](spark, docs, folder)
    assert out.columns == COLUMNS and kept(out) == {i for i, _, c in brute.near(rows, 5) if i == c}
    out = stage["decontamination"](spark, docs, folder)
    assert out.columns == COLUMNS and kept(out) == {r[0] for r in brute.judge(rows, [(1, rows[2][1].split("\n")[1])]) if not r[5]}
    tokens = stage["tokens"](spark, docs, folder).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in tokens} == {i: brute.sha(brute.data(t)) for i, t in rows}


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() < 131


def test_one_text_of_an_id_leaves_the_others(spark, tmp_path, lists):
    """Null and repeated ids, each with one dropped and one clean text, and rows repeated as a whole."""
    stage = dict(corpus_pipeline.STAGES)
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    bad = text("bench")
    spark.createDataFrame([(1, bad)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = [(1, text("a")), (None, text("a")), (None, text("b")), (2, text("a")), (2, text("c")), (None, bad), (3, bad), (3, text("d")), (3, text("d")), (None, text("e")), (None, text("e")), (4, None), (None, ""), (5, text("a") + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    listed = lambda df: sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=str)
    left = [(1, text("a")), (None, text("b")), (2, text("c")), (3, bad), (3, text("d")), (None, text("e")), (4, ""), (5, text("a") + " more")]
    out = stage["exact dedup"](spark, docs, str(tmp_path))
    assert out.columns == COLUMNS and listed(out) == sorted(left, key=str)
    out = stage["decontamination"](spark, docs, str(tmp_path))
    assert out.columns == COLUMNS and listed(out) == sorted(((i, t or "") for i, t in made if t != bad), key=str)
    near = [(1, text("a")), (1, text("b") + " x"), (2, text("a") + " y"), (2, text("c")), (3, text("b")), (3, text("d")), (3, text("d")), (None, text("c")), (4, None)]
    out = stage["near dedup"](spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in near], docs.schema), str(tmp_path))
    expected = [(1, text("a")), (1, text("b") + " x"), (2, text("c")), (3, text("d")), (None, text("c")), (4, "")]
    assert out.columns == COLUMNS and listed(out) == sorted(expected, key=str)
