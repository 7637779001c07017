import pytest


@pytest.fixture(scope="session", autouse=True)
def _workers_know_the_library(spark):
    from stanceframe.session import prepare
    prepare(spark)


DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, key string, score double, epochs int"


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text[, lang, source]) as documents with extra columns of clashing names."""
    def make(rows, parts=3):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "src1")), len(r[1] or ""), 7, "k", 0.5, 9) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA).repartition(parts)
    return make
