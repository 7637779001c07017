"""Registry of named queries: Spark plan + DuckDB oracle SQL for each.

A query is a callable ``(spark, sf_dir) -> DataFrame`` over the given test
tables.  Its oracle is ANSI-ish SQL run by DuckDB over the same tables with
the fixture projections as CTEs.  Double columns are rounded to 6 places on
both sides (and -0.0 folded to 0.0) so the value hashes compare engines, not
last-bit float noise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stanceframe.sources.fixtures import fixture_cte

QueryFn = Callable[[SparkSession, str], DataFrame]

# Extra CTEs shared by oracle SQL: the library's first-answer-wins cells (AGG-3)
# restated in SQL, and the per-question value counts.
ORACLE_COMMON = """,
cells AS (SELECT model, respondent, question, min_by(score, ord) AS score
          FROM fx_answers WHERE score IS NOT NULL GROUP BY model, respondent, question)
"""


@dataclass
class Query:
    name: str
    fn: QueryFn
    sql: str | None = None
    doubles: tuple[str, ...] = field(default_factory=tuple)
    doc: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, doubles: tuple[str, ...] | list[str] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = Query(name, fn, sql, tuple(doubles), (fn.__doc__ or "").strip())
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    """Round double columns to 6 places and fold -0.0 into 0.0."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f.name).cast("double"), 6) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def oracle_text(q: Query) -> str | None:
    if q.sql is None:
        return None
    body = fixture_cte() + ORACLE_COMMON + q.sql.strip()
    if not q.doubles:
        return body
    rep = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in q.doubles)
    # Wrap: the body is a WITH ... SELECT; select from it as a subquery.
    return f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) AS _oracle"


def queries() -> dict[str, QueryFn]:
    _load_all()

    def wrap(q: Query) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from stanceframe.session import prepare
            prepare(spark)
            return finish(q.fn(spark, sf_dir))
        run.__name__ = q.name
        run.__doc__ = q.doc
        return run
    return {k: wrap(v) for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    out = {}
    for k, q in REGISTRY.items():
        s = oracle_text(q)
        if s is not None:
            out[k] = s
    return out


def _load_all() -> None:
    # Importing the query modules fills REGISTRY.
    from stanceframe.plans import (queries_analytics, queries_effects, queries_pages, queries_prefs,  # noqa: F401
                                   queries_io, queries_stream, queries_text)
