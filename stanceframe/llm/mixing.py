"""Mixing sources to target weights by hierarchical budgeting over a domain-language-source tree.

A token budget is passed down the tree: children of a node share its budget by weight, none gets more
than the tokens its leaves can give (their tokens times ``max_epochs``), and what a child cannot take
goes to its siblings by weight before a node as a whole falls short and its own siblings take over.  A
leaf then gives whole epochs of its documents and, of one more epoch in seeded order, a prefix of tokens,
so that the tokens taken are exactly the budget.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stanceframe.llm.common import WORD_RE, stored

DEC = "decimal(38,0)"  # token counts times weights outgrow 64 bits at scale


@dataclass(frozen=True)
class Plan:
    """Parameters of a mix.  ``weights`` maps a path (its names joined by '/') to a positive whole weight
    among its siblings; paths that are not named weigh 1."""

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: dict[str, int] = field(default_factory=dict)
    percent: int = 50  # the budget, in per cent of the corpus' tokens
    max_epochs: int = 2
    seed: int = 17


def _path(levels: Sequence[str]):
    return F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in levels))


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """``leaves`` (levels, tokens) -> the same with ``budget``; one row per leaf of the tree.

    Integer water-filling, a level at a time: children are ordered by capacity per weight; those that the
    common level would fill are filled, the rest share what is left in cumulative rounding, so that the
    children's budgets add up to their parent's.  Work and windows are over tree nodes, not documents."""
    levels = plan.levels
    spark = leaves.sparkSession
    weight = spark.createDataFrame([(k, int(v)) for k, v in plan.weights.items()] or [("", 1)], "path string, w bigint")
    cur = leaves.withColumn("cap", F.col("tokens").cast(DEC) * F.lit(plan.max_epochs))
    total = leaves.agg(F.floor(F.sum(F.col("tokens").cast(DEC)) * F.lit(plan.percent) / F.lit(100)).cast(DEC).alias("budget"))
    given = total.withColumn("parent", F.lit(""))
    for depth in range(len(levels)):
        own = _path(levels[:depth + 1])
        parent = _path(levels[:depth]) if depth else F.lit("")
        nodes = (cur.groupBy(parent.alias("parent"), own.alias("path")).agg(F.sum("cap").cast(DEC).alias("cap"))
                 .join(F.broadcast(weight), "path", "left").withColumn("w", F.coalesce("w", F.lit(1)).cast(DEC))
                 .join(given, "parent"))
        # capacity per weight as an exact order: quotient, remainder scaled, then the path
        order = [F.expr("cast(cap as double) / cast(w as double)"), F.col("path")]
        up = Window.partitionBy("parent").orderBy(*order)
        before, here = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.unboundedPreceding, 0)
        rest = up.rowsBetween(0, Window.unboundedFollowing)
        nodes = (nodes.withColumn("_used", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(DEC))
                 .withColumn("_wleft", F.sum("w").over(rest).cast(DEC))
                 .withColumn("_left", F.greatest(F.col("budget") - F.col("_used"), F.lit(0)).cast(DEC))
                 # filled: its capacity is at most its share of what is left
                 .withColumn("_full", (F.col("cap") * F.col("_wleft") <= F.col("w") * F.col("_left"))))
        # once one child is not filled, none after it is
        nodes = nodes.withColumn("_full", F.min(F.col("_full").cast("int")).over(here) == 1)
        open_ = up.rowsBetween(Window.unboundedPreceding, 0)
        nodes = (nodes.withColumn("_sum", F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(Window.partitionBy("parent")).cast(DEC))
                 .withColumn("_pool", F.greatest(F.col("budget") - F.col("_sum"), F.lit(0)).cast(DEC))
                 .withColumn("_all", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("w"))).over(Window.partitionBy("parent")).cast(DEC))
                 .withColumn("_to", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("w"))).over(open_).cast(DEC)))
        share = F.expr("cast((_pool * _to) div _all as decimal(38,0)) - cast((_pool * (_to - w)) div _all as decimal(38,0))")
        given = nodes.select(F.col("path").alias("parent"),
                             F.when(F.col("_full"), F.col("cap")).otherwise(share).cast(DEC).alias("budget"))
    return leaves.withColumn("parent", _path(levels)).join(given, "parent").drop("parent")


def mix(docs: DataFrame, plan: Plan) -> DataFrame:
    """Which documents the mix takes, and how much of them.

    ``docs``: doc_id, text and the plan's levels; returns doc_id, levels, n_tokens, epochs (whole copies),
    take_tokens (the prefix of one more copy, may be all of it) for the rows of which anything is taken.
    Tokens are words without space or tab..carriage return.  Null and empty texts have no tokens and are
    never taken; a null level is the name ''; rows that repeat take part one by one, in any order where
    nothing tells them apart; a null id sorts as ''; extra columns are ignored; an empty table gives none.

    Every leaf is cut at its budget without sorting it: tokens are summed by the first three and the next
    three digits of the rows' seeded hash, and only the last, tiny cell at the cut is put in order."""
    return _shares(docs, plan).where("epochs > 0 or take_tokens > 0")


def _shares(docs: DataFrame, plan: Plan) -> DataFrame:
    """The rows of ``mix``, and those of which nothing is taken."""
    levels = list(plan.levels)
    rows = (docs.select("doc_id", *levels, F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_RE)), F.lit(0))
                        .cast("bigint").alias("n_tokens")).where("n_tokens > 0"))
    rows = stored(rows.select("doc_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels), "n_tokens"),
                  "mix-rows")
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    plan_rows = stored(budgets(leaves, plan).select(*levels, F.floor(F.expr("budget div tokens")).cast("bigint").alias("epochs"),
                                                    F.expr("cast(budget % tokens as bigint)").alias("cut"), "tokens"), "mix-plan")
    h = F.md5(F.concat_ws(":", F.lit(str(plan.seed)), F.col("epochs").cast("string"),
                          F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    # one plan row per leaf joins onto all rows of the leaf: the small side is counted, then broadcast
    n_leaves = plan_rows.count()
    small = F.broadcast(plan_rows) if n_leaves * 200 <= 32 << 20 else plan_rows
    seeded = (rows.join(small, levels).withColumn("h", h)
              .withColumn("h1", F.substring("h", 1, 3)).withColumn("h2", F.substring("h", 4, 3)))

    def edge(cells: DataFrame, by: list[str], cell: str) -> DataFrame:
        """The cell in which the running sum of tokens passes the cut, and the cut left inside it."""
        w = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        return (cells.withColumn("_b", F.coalesce(F.sum("t").over(w), F.lit(0)))
                .where((F.col("_b") <= F.col("cut")) & (F.col("cut") < F.col("_b") + F.col("t")))
                .select(*by, F.col(cell).alias(f"edge_{cell}"), (F.col("cut") - F.col("_b")).alias("cut")))

    cells1 = seeded.groupBy(*levels, "cut", "h1").agg(F.sum("n_tokens").alias("t"))
    edge1 = stored(edge(cells1, levels, "h1"), "mix-edge")
    small1 = F.broadcast(edge1) if n_leaves * 200 <= 32 << 20 else edge1
    cells2 = (seeded.drop("cut").join(small1.withColumnRenamed("edge_h1", "h1"), [*levels, "h1"])
              .groupBy(*levels, "cut", "h2").agg(F.sum("n_tokens").alias("t")))
    edge2 = stored(edge(cells2, levels, "h2"), "mix-edge")
    small2 = F.broadcast(edge2) if n_leaves * 200 <= 32 << 20 else edge2
    both = (seeded.join(small1.drop("cut"), levels, "left").join(small2.withColumnRenamed("cut", "cell_cut"), levels, "left"))
    where = (F.when((F.col("h1") < F.col("edge_h1")) | (F.col("h1") == F.col("edge_h1")) & (F.col("h2") < F.col("edge_h2")), -1)
             .when((F.col("h1") == F.col("edge_h1")) & (F.col("h2") == F.col("edge_h2")), 0).otherwise(1))
    both = both.withColumn("_side", where)
    out = ["doc_id", *levels, "n_tokens", "epochs"]
    away = both.where("_side <> 0").select(*out, F.when(F.col("_side") < 0, F.col("n_tokens")).otherwise(0).cast("bigint").alias("take_tokens"))
    inside = Window.partitionBy(*levels).orderBy("h", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    at = (both.where("_side = 0").withColumn("_b", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
          .select(*out, F.greatest(F.lit(0), F.least("n_tokens", F.col("cell_cut") - F.col("_b"))).cast("bigint").alias("take_tokens")))
    return away.unionByName(at)


def mixed_documents(docs: DataFrame, plan: Plan) -> DataFrame:
    """The mix itself: the rows of ``docs``, one for every copy; a last, partial copy has its token prefix.

    The prefix keeps the text up to its last taken word.  Rows are found again by doc_id, levels and number of
    tokens.  Rows that agree in all of these get what ``mix`` gives to that many rows: where it gives them different
    shares (at the cut of their leaf), they are numbered, and the first ones get the larger shares.  Columns are
    those of ``docs``; a null text or id, an empty table and clashing names are as in ``mix``."""
    levels = list(plan.levels)
    shares = _shares(docs, plan).withColumn("_whole", F.col("take_tokens") == F.col("n_tokens"))
    taken = shares.groupBy("doc_id", *levels, "n_tokens").agg(
        F.max("epochs").alias("mix__epochs"), F.count(F.lit(1)).alias("mix__rows"), F.count_if("_whole").alias("mix__whole"),
        F.coalesce(F.max(F.when(~F.col("_whole"), F.col("take_tokens"))), F.lit(0)).alias("mix__part"))
    taken = taken.where("mix__epochs > 0 or mix__whole > 0 or mix__part > 0")
    taken = stored(taken.select(F.col("doc_id").alias("mix__id"), F.col("n_tokens").alias("mix__tokens"), "mix__epochs", "mix__rows", "mix__whole", "mix__part",
                                *(F.col(c).alias(f"mix__{c}") for c in levels)), "mix-taken")
    rows = docs.withColumn("mix__n", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_RE)), F.lit(0)).cast("bigint"))
    on = F.col("doc_id").eqNullSafe(F.col("mix__id")) & (F.col("mix__n") == F.col("mix__tokens"))
    for c in levels:
        on = on & (F.coalesce(F.col(c).cast("string"), F.lit("")) == F.col(f"mix__{c}"))
    differ = (F.col("mix__rows") > 1) & (F.col("mix__whole") < F.col("mix__rows")) & ((F.col("mix__whole") > 0) | (F.col("mix__part") > 0))
    alike = taken.where(~differ)
    alike = F.broadcast(alike) if alike.count() * 200 <= 32 << 20 else alike  # counted too: if small, no text is moved
    found = rows.join(alike, on).withColumn("mix__i", F.lit(0).cast("bigint"))
    # numbered by their place in a stored table: in a partition, then over the partitions that hold a key
    key = ["mix__id", "mix__tokens", *(f"mix__{c}" for c in levels)]
    few = taken.where(differ)  # keys at a leaf's cut: counted, and joined without moving the texts if they are few
    few = F.broadcast(few) if few.count() * 200 <= 32 << 20 else few
    apart = stored(rows.join(few, on).withColumn("mix__at", F.monotonically_increasing_id()), "mix-apart")
    apart = apart.withColumn("mix__in", F.shiftright("mix__at", 33))
    before = (apart.groupBy(*key, "mix__in").agg(F.count(F.lit(1)).alias("c"))
              .select(*(F.col(k).alias(f"b_{k}") for k in key), F.col("mix__in").alias("b_in"),
                      F.coalesce(F.sum("c").over(Window.partitionBy(*key).orderBy("mix__in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b_n")))
    same = F.col("mix__in") == F.col("b_in")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    apart = (apart.withColumn("mix__i", F.row_number().over(Window.partitionBy(*key, "mix__in").orderBy("mix__at")) - 1).join(before, same)
             .withColumn("mix__i", F.col("mix__i") + F.col("b_n")).select(*found.columns))
    take = (F.when(F.col("mix__i") < F.col("mix__whole"), F.col("mix__n"))
            .when(F.col("mix__i") == F.col("mix__whole"), F.col("mix__part")).otherwise(0).cast("bigint"))
    copies = F.filter(F.concat(F.array_repeat(F.col("mix__n"), F.col("mix__epochs").cast("int")), F.array(take)), lambda k: k > 0)
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    prefix = F.array_join(F.slice(words, F.lit(1), F.col("mix__k").cast("int")), "")
    text = F.when(F.col("mix__k") < F.col("mix__n"), prefix).otherwise(F.col("text"))
    return (found.unionByName(apart).withColumn("mix__k", F.explode(copies))
            .select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns)))


def mix_sql(plan: Plan, docs_sql: str) -> str:
    """The same mix in SQL over a query of doc_id, text and the levels (for the check of results)."""
    lv = list(plan.levels)
    path = [" || '/' || ".join(lv[:k + 1]) for k in range(len(lv))]
    names = ", ".join(lv)
    weights = ", ".join(f"('{k}', {v})" for k, v in (plan.weights or {"": 1}).items())
    sql = f"""WITH d AS (SELECT doc_id, {', '.join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in lv)},
   CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM ({docs_sql})),
r AS (SELECT * FROM d WHERE n_tokens > 0),
weights(path, w) AS (VALUES {weights}),
leaves AS (SELECT {names}, CAST(sum(n_tokens) AS HUGEINT) AS tokens FROM r GROUP BY {names}),
g0 AS (SELECT '' AS parent, CAST(floor(sum(tokens) * {plan.percent} / 100) AS HUGEINT) AS budget FROM leaves)"""
    for k in range(len(lv)):
        parent = path[k - 1] if k else "''"
        sql += f""",
n{k} AS (SELECT c.parent, c.path, c.cap, CAST(coalesce(x.w, 1) AS HUGEINT) AS w, g.budget
  FROM (SELECT {parent} AS parent, {path[k]} AS path, CAST(sum(tokens * {plan.max_epochs}) AS HUGEINT) AS cap FROM leaves GROUP BY 1, 2) c
  LEFT JOIN weights x ON x.path = c.path JOIN g{k} g ON g.parent = c.parent),
a{k} AS (SELECT *, greatest(budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS l,
  sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl
  FROM n{k} WINDOW o AS (PARTITION BY parent ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), path)),
b{k} AS (SELECT *, min(CASE WHEN cap * wl <= w * l THEN 1 ELSE 0 END) OVER (PARTITION BY parent ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), path) AS f FROM a{k}),
e{k} AS (SELECT *, greatest(budget - sum(CASE WHEN f = 1 THEN cap ELSE 0 END) OVER (PARTITION BY parent), 0) AS pool,
  sum(CASE WHEN f = 1 THEN 0 ELSE w END) OVER (PARTITION BY parent) AS wa,
  sum(CASE WHEN f = 1 THEN 0 ELSE w END) OVER (PARTITION BY parent ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), path) AS wt FROM b{k}),
g{k + 1} AS (SELECT path AS parent, CASE WHEN f = 1 THEN cap ELSE (CAST(pool AS HUGEINT) * CAST(wt AS HUGEINT)) // CAST(wa AS HUGEINT)
  - (CAST(pool AS HUGEINT) * CAST(wt - w AS HUGEINT)) // CAST(wa AS HUGEINT) END AS budget FROM e{k})"""
    using = ", ".join(lv)
    return sql + f""",
p AS (SELECT {names}, CAST(budget // tokens AS BIGINT) AS epochs, CAST(budget % tokens AS BIGINT) AS cut
  FROM leaves JOIN g{len(lv)} ON parent = {path[-1]}),
s AS (SELECT r.*, p.epochs, p.cut, coalesce(sum(n_tokens) OVER (PARTITION BY {using}
    ORDER BY md5('{plan.seed}:' || p.epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM r JOIN p USING ({using}))
SELECT doc_id, {names}, n_tokens, epochs, CAST(greatest(0, least(n_tokens, cut - b)) AS BIGINT) AS take_tokens
FROM s WHERE epochs > 0 OR cut > b"""
