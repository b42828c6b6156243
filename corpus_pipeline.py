"""A corpus run: documents to token ids, in five stages of the operators in ``touchline.llm``.

Each stage takes all that its predecessor kept. All but the last return the
columns of ``documents``; what a stage decides takes effect: rejected documents,
further copies and contaminated documents go, secrets are replaced in the text.

Documents are told by ``doc_id``: where an id repeats, a verdict on one of its
rows holds for all, and one row of an id stays after the stage on copies. Rows
without an id pass every stage that decides by id.

Null and empty texts are scored, have no shingles, windows or secrets, and end as
the end token alone; very long texts are one row of one task in every stage;
an empty table gives an empty one; further columns are passed on until the last
stage. The tables between stages are deleted as soon as the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.llm import decontaminate, jaccard, piece_bpe, quality, secrets
from touchline.llm._arrow import discard, written
from touchline.llm.queries import QUALITY_THRESHOLD, remainder, table, tokenizer_file


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = quality.classify(docs, labels, remainder(5) == 0, QUALITY_THRESHOLD)
    return _without(docs, written(scored.where("predicted = 0").select("doc_id"), "rejected"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies."""
    linked = jaccard.jaccard_components(docs)
    left = _without(docs, written(linked.where("doc_id <> component_id").select("doc_id"), "copies"))
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null")
    if again.limit(1).count():
        # one row of an id: the least, text first; taken on the map side, so an id of very many rows is a row for each task
        order = ["text", *[c for c in docs.columns if c not in ("text", "doc_id")]]
        one = left.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*order)).alias("row")).select("doc_id", "row.*")
        left = one.select(*docs.columns).unionByName(left.where("doc_id is null"))
    return left


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    marked = decontaminate.verdict(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))
    return marked.where(~F.col("contaminated")).select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; ``n_chars`` is that of the new text."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text they decode to."""
    coded = piece_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), tokenizer_file("piece_bpe_32k.model"))
    return piece_bpe.digests(coded, "lang", "source", "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", hide_secrets),
    ("sentencepiece", encode),
]

#: The classifier's fit, the components and the tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
            if before is not None:
                discard(before)
            before = docs
    return docs
