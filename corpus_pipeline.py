"""A training corpus from raw documents, in stages; each stage is one of the training-data operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and works on all that the stage
before it kept.  All but the last return rows with the columns of ``documents``; the last returns the
token digests of the final corpus.  ``run`` applies them to ``documents``, writing each stage's rows as
Parquet in the shared folder and reading them back for the next.

In every stage: an empty table gives no rows; columns besides doc_id, text, lang and source pass through unread, so their
names may clash with the operators' own; very long texts are worked on whole.  What a stage does with nulls, empty texts
and repeated rows is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanceframe.llm import quality_nbsvm, toxicity
from stanceframe.llm.common import stored, table
from stanceframe.llm.mixing import Plan, mixed_documents
from stanceframe.llm.ngram_join import drop_near_duplicates
from stanceframe.llm.queries import MIX_WEIGHTS, with_domain
from stanceframe.llm.sentencepiece_codec import default_model, encode_table
from stanceframe.session import prepare as prepare_session

#: Rows of an Arrow batch between Spark and its Python workers.  Rows hold whole texts: the default of 10,000 is some
#: 30 MB a batch, which the JVM's growing buffers hold about twice, for every task.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    prepare_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _filtered(scored: DataFrame, docs: DataFrame, predicted: int) -> DataFrame:
    return scored.where(F.col("predicted") == predicted).select(*(F.col(f"k_{c}").alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality: score 0.3 or more.

    Null and empty texts are scored alike, as texts without words; every row is judged by itself, so rows without
    id and repeated rows stay or go by their own text.  Without labels of both classes every score is one constant."""
    prepare(spark)
    model = quality_nbsvm.train(docs, table(spark, sf_dir, "labels"))
    return _filtered(quality_nbsvm.score_documents(docs, model, 0.3, keep=docs.columns), docs, 1)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5.

    Null and empty texts are scored alike, as texts in which no voter finds anything; rows without id and repeated rows
    stay or go by their own text."""
    prepare(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _filtered(toxicity.score_documents(docs, model, 0.5, keep=docs.columns), docs, 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates.

    Null and empty texts are duplicates of nothing and stay; so do rows without id.  Of rows that repeat an id and
    a text one stays; rows of one id with different texts stay or go by their own text."""
    prepare(spark)
    return drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted mix; a document of two epochs comes twice, one at a budget's end with its token prefix.

    Null and empty texts have no tokens and are not taken; a null language or source is the name ''; rows without id
    take part; repeated rows take part one by one, and the budget is met exactly."""
    prepare(spark)
    plan = Plan(levels=("mix__domain", "lang", "source"), weights=MIX_WEIGHTS)
    return mixed_documents(with_domain(docs, "mix__domain"), plan).select(*docs.columns)


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids and decoded text of every row, as digests.

    A null text counts as empty; null ids and repeated rows come out as they come in."""
    prepare(spark)
    return encode_table(docs, default_model())


STAGES = [("quality classifier", quality), ("toxicity", not_toxic), ("n-gram Jaccard join", near_duplicates),
          ("mixing sources to target weights", mixed), ("SentencePiece encoding and decoding", token_digests)]

#: None: the classifiers, the components and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
