"""Registered queries ``opN_<name>``: each runs its operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanceframe.llm.common import table


#: Production mix: four domains of sources, languages weighted, half of the corpus, two epochs at most.
MIX_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1,
               **{f"d{k}/{lang}": w for k in range(4) for lang, w in (("en", 6), ("de", 2), ("es", 1), ("fr", 1))}}
#: A source's domain: the remainder of the number at its end by 4 (sources without a number: domain d0).
_DOMAIN = "concat('d', coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) as int), 0) % 4)"


def with_domain(docs: DataFrame, name: str = "domain") -> DataFrame:
    """The source catalogue's domain column, which the documents table does not have."""
    return docs.withColumn(name, F.expr(_DOMAIN))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, epochs and token prefixes of the weighted mix over the domain-language-source tree."""
    from stanceframe.llm.mixing import Plan, mix
    return mix(with_domain(table(spark, sf_dir, "documents")), Plan(weights=MIX_WEIGHTS))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document from the weakly supervised classifier (trained, so tested on the held-out fold)."""
    from stanceframe.llm import toxicity
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.5)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids and decoded text of every document, as digests (no SQL form; tested against the library)."""
    from stanceframe.llm.sentencepiece_codec import default_model, encode_table
    return encode_table(table(spark, sf_dir, "documents"), default_model())


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by 5-word shingles, 0.8 (iterative, so tested by brute force)."""
    from stanceframe.llm.ngram_join import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document written to seekable files and read back (no SQL form; tested as a round trip)."""
    from stanceframe.llm.token_files import default_tokenizer, token_table
    return token_table(table(spark, sf_dir, "documents"), default_tokenizer(), end_id=0)


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base license phrases and rule detections of every document."""
    from stanceframe.llm.license_scan import scan
    return scan(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from Naive Bayes support vectors (trained, so tested on the held-out fold)."""
    from stanceframe.llm import quality_nbsvm
    docs = table(spark, sf_dir, "documents")
    return quality_nbsvm.score_documents(docs, quality_nbsvm.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op8_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with cosine 0.9 or more (hashed, so tested by brute force)."""
    from stanceframe.llm.lattice_dedup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op9_onebit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings by inner product of every row whose id is divisible by 20 (tested by brute force)."""
    from stanceframe.llm.onebit_search import search
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20).drop("compared")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of all pages, written as archives and assembled again from their records."""
    from stanceframe.llm.warc import captures
    return captures(table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings whitened on the covariance of all rows, 32 components (tested against exact arithmetic)."""
    from stanceframe.llm.whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"), components=32)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two to five words of every language, by exact counts."""
    from stanceframe.llm.collocations import mine
    return mine(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document and of its edited text, and their likenesses."""
    from stanceframe.llm.merkle import edited_likeness
    return edited_likeness(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_toxicity, op3_sentencepiece, op4_ngram_join, op5_token_files, op6_license, op7_quality,
                                   op8_lattice_dedup, op9_onebit_search, op10_warc, op11_whitening, op12_collocations, op13_merkle)}

#: What the archives must say of the pages, stated on the pages.
WARC_SQL = """WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON f.d = p.d"""


def _oracles() -> dict[str, str]:
    from stanceframe.llm.collocations import mine_sql
    from stanceframe.llm.license_scan import scan_sql
    from stanceframe.llm.merkle import edited_likeness_sql
    from stanceframe.llm.mixing import Plan, mix_sql
    domain = "'d' || CAST(coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS INTEGER), 0) % 4 AS VARCHAR)"
    return {"op1_mixing": mix_sql(Plan(weights=MIX_WEIGHTS), f"SELECT *, {domain} AS domain FROM documents"),
            "op6_license": scan_sql(), "op10_warc": WARC_SQL, "op12_collocations": mine_sql(), "op13_merkle": edited_likeness_sql()}


ORACLE_SQL: dict[str, str] = _oracles()


def queries():
    """Name -> callable, with the library shipped to the workers first."""
    from stanceframe.session import prepare

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        return run
    return {k: wrap(f) for k, f in QUERIES.items()}
