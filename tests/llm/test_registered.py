import random
from types import SimpleNamespace

import pytest

import __spark_entry__
import corpus_pipeline
from editlore.llm import common
from editlore.llm.queries import registered, statements


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A few rows of every table, with nulls, repeats and a further column."""
    top = tmp_path_factory.mktemp("tables")
    rng = random.Random(1)
    texts = [" ".join(["went", *(rng.choice("the of and to") if rng.random() < 0.3 else f"w{rng.randint(0, 999)}" for _ in range(30))]) + "." for _ in range(40)]
    docs = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(50, texts[3], "en", "s", 1), (51, None, None, None, None), (52, "", "en", "s", 0), (3, texts[3], "en", "s", 1), (None, " ".join(texts[5].split()[::-1]), "en", "s", 1)]
    docs += [(60 + k, ("!! ".join(t.upper().split()) + "\n") * 3, "en", "s", 1) for k, t in enumerate(texts[:20])]
    docs += [(90 + k, t.replace("went", "zorkle vraxen zorkle"), "en", "s", 1) for k, t in enumerate(texts[20:40])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(top / "documents.parquet"))
    labels = [(k, 1, 0) for k in range(40)] + [(60 + k, 0, 0) for k in range(20)] + [(90 + k, 1, 1) for k in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    spark.createDataFrame([(1, texts[7]), (2, None), (None, texts[8])], "item_id long, text string").write.parquet(str(top / "benchmark.parquet"))
    spark.createDataFrame([(k, f"http://a.net/{k}", f"<p>page {k}</p>") for k in range(5)] + [(9, None, None), (None, "http://b.org/", "<p>x</p>")], "page_id long, url string, html string").write.parquet(str(top / "pages.parquet"))
    spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)] + [(100, None), (None, [1.0, 2.0])] + [(200 + k, [float(k)] * 64) for k in range(7)], "vec_id long, embedding array<float>").write.parquet(str(top / "embeddings.parquet"))
    return str(top)


@pytest.mark.parametrize("name", [n for n in registered() if n != "pipeline"])
def test_every_query_returns_its_rows(spark, tables, name):
    rows = registered()[name](spark, tables).collect()
    assert len(rows) >= (4 if "topk" in name else 6)


def test_pipeline_drops_what_each_stage_rejects(spark, tables):
    ids = {r.doc_id for r in corpus_pipeline.run(spark, tables).collect()}
    assert not {7, 8, 50} & ids  # in the benchmark; a copy
    assert len(ids & set(range(40))) > 30 and not ids & set(range(60, 80))
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_entry_has_all():
    assert set(registered()) <= set(__spark_entry__.queries()) and set(statements()) <= set(__spark_entry__.oracle_sql())


def test_a_cluster_without_a_shared_folder_is_refused():
    nothing = SimpleNamespace(get=lambda *_: None)
    session = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(getConf=lambda: nothing, master="spark://host:7077", applicationId="a"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(session)
