"""Every stage on its own input against plain versions, and the whole run."""

import pytest
from pyspark.sql import functions as F
from test_decontaminate import expected as leaks
from test_decontaminate import windows
from test_ngram_join import expected as classes

import corpus_pipeline as cp
from bytebasin.llm import sentencepieces, toxicity
from bytebasin.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_stages_keep_columns_and_clean_documents(spark, sf, documents, tmp_path):
    docs = documents
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/{k}").collect()}
        assert after.keys() <= before.keys() and len(after) > 0.5 * len(before), name
        if k < 4:
            assert out.columns == documents.columns and out.dtypes == documents.dtypes, name
            assert all(r.n_chars == len(r.text) for r in after.values())
        if k == 2:
            found = classes([(i, r.text) for i, r in before.items()])
            assert after.keys() == {i for i, c, _, _ in found if i == c}
        if k == 3:
            bench = windows([(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
            for i, r in before.items():
                if not leaks(r.text, bench)[4]:
                    assert after[i] == r
                elif i in after:
                    assert leaks(after[i].text, bench)[1] < leaks(r.text, bench)[1]
        if k == 4:
            assert all(r.n_tokens == len(r.ids) >= 2 for r in after.values())
        docs = spark.read.parquet(f"{tmp_path}/{k}")


def test_toxic_documents_go(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    kept = {r.doc_id for r in cp.drop_toxic(spark, docs, big).select("doc_id").collect()}
    scored = toxicity.with_toxicity(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{big}/labels.parquet")))
    assert kept == {r.doc_id for r in scored.where(F.col("toxicity.score") < 0.5).collect()} and len(kept) < docs.count()


def test_run(spark, sf, documents):
    out = cp.run(spark, sf)
    assert 0 < out.count() <= documents.count() and "ids" in out.columns


def test_stages_take_empty_and_odd_tables(spark, sf, documents):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a " * 20000, "en", "s", 40000), (None, "no id", "en", "s", 5)], documents.schema)
    for docs in (documents.limit(0), odd):
        for _, stage in cp.STAGES:
            assert stage(spark, docs, sf).count() == docs.count()


def test_pieces_have_spans(spark, sf, documents):
    texts = ["ﬁne  Ⅳ ½ text", "日本語\u3000x", "", None, "a  b   c"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], documents.schema)
    got = {r.doc_id: r for r in cp.to_pieces(spark, docs, sf).collect()}
    want = {r.doc_id: r.pieces for r in sentencepieces.with_pieces(docs, tokenizer_file("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        raw, r = (t or "").encode(), got[i]
        assert (r.ids, r.starts, r.ends) == (want[i].ids, want[i].starts, want[i].ends)
        assert len(r.starts) == len(r.ends) == len(r.ids) == r.n_tokens and r.starts[-1] == r.ends[-1] == len(raw)
        assert {b for s, e in zip(r.starts, r.ends) for b in range(s, e)} == set(range(len(raw))), t


def test_columns_of_any_name_pass_through(spark, sf, documents):
    names = ["__toxicity", "__hits", "__digest", "_digest", "of", "key", "seeds", "runs", "pieces"]
    docs = documents.limit(20).select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names]).persist()
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)
    found = sentencepieces.with_piece_digests(docs, tokenizer_file("piece_bpe_32k.model"))
    assert all(r[n] == f"{n}{r.doc_id}" for r in found.collect() for n in names)


def test_run_goes_on_after_the_last_stage_written(spark, sf, tmp_path, monkeypatch):
    calls = []

    def stage(name, fails=()):
        def run(spark, docs, sf_dir):
            calls.append(name)
            if len(calls) in fails:
                raise RuntimeError(name)
            return docs.limit(3)

        return name, run

    monkeypatch.setattr(cp, "STAGES", [stage("one"), stage("two", fails=(2,)), stage("three")])
    with pytest.raises(RuntimeError):
        cp.run(spark, sf, f"{tmp_path}/p")
    assert cp.run(spark, sf, f"{tmp_path}/p").count() == 3 and calls == ["one", "two", "two", "three"]
