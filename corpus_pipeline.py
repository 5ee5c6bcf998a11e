"""A training corpus from ``documents``: toxic texts out, repeated passages and near copies out, benchmarks out, token ids.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``documents``, ``n_chars`` following the text. Columns of any name pass through; an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytebasin.llm import common, decontaminate, line_dedup, ngram_join, sentencepieces, toxicity
from bytebasin.llm.queries import table, tokenizer_file
from bytebasin.sources.shared import finished


def _with_new_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from the labelled ones, doesn't hold for toxic.

    Null and empty texts have no evidence and stay; repeated rows fare alike; a score of exactly 0.5 goes.
    """
    common.limit_arrow_rows(spark)
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    into = "__toxicity"
    while into in docs.columns:
        into += "_"
    scored = toxicity.with_toxicity(docs, model, into=into)
    return scored.where(F.col(f"{into}.score") < 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their later repeated runs of lines; those of which nothing but blanks is left go.

    Null and empty texts stay; rows alike in id and text are one document and fare alike; of one id's texts the one of
    smaller hash comes first, and rows without an id before all others.
    """
    kept = line_dedup.dedup_lines(docs)
    kept = kept.where((F.col("removed_lines") == 0) | (F.trim(F.regexp_replace("text", r"\s+", "")) != ""))
    return _with_new_text(kept.select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies, the one of least id; of repeated rows one.

    Null, empty and wordless texts are classes of their own, and rows without an id stay.
    """
    common.limit_arrow_rows(spark)
    return ngram_join.one_of_each_class(docs).select(*docs.columns)


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows; those of which more than half the words are benchmark go.

    Null, empty and wordless texts stay; repeated rows fare alike.
    """
    common.limit_arrow_rows(spark)
    return _with_new_text(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with begin and end ids, and the source bytes that each id stands for.

    A null or empty text has the begin and end ids alone; repeated rows stay; of other columns lang and source do.
    """
    common.limit_arrow_rows(spark)
    found = sentencepieces.with_pieces(docs, tokenizer_file("piece_bpe_32k.model"), decoded=False)
    return found.select("doc_id", "lang", "source", F.size("pieces.ids").cast("long").alias("n_tokens"), "pieces.ids", "pieces.starts", "pieces.ends")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmarks),
    ("SentencePiece", to_pieces),
]

#: The model and the tokenizer have no form in SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again; only the last one's rows are kept.

    A run that is given the ``folder`` of one that failed goes on after the last stage which that one wrote.
    """
    folder = folder or common.shared_folder(spark, "pipeline")
    paths = [f"{folder}/{k}-{name.replace(' ', '-')}" for k, (name, _) in enumerate(STAGES)]
    done = max((k for k, path in enumerate(paths) if finished(spark, path)), default=-1)
    docs = spark.read.parquet(paths[done]) if done >= 0 else table(spark, sf_dir, "documents")
    for k in range(done + 1, len(STAGES)):
        STAGES[k][1](spark, docs, sf_dir).write.mode("overwrite").parquet(paths[k])
        docs = spark.read.parquet(paths[k])
        if k:
            common.drop_folder(spark, paths[k - 1])
    return docs
