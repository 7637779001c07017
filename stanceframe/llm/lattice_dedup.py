"""Embedding near-dedup by lattice hashing.

Every vector is projected at random onto 16 dimensions per table, read as two points of 8 dimensions,
and each is decoded to the nearest point of the E8 lattice; the pair of lattice points is the vector's
cell in that table.  A vector is stored in its own cell of every table and looks into its own and the
neighbouring cells that lie closest to its projection.  Vectors that meet are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanceframe.llm.common import stored
from stanceframe.llm.components import connected_components
from stanceframe.llm.shingles import mix

TABLES = 24
PROBES = 6  # neighbouring cells looked into per table
SCALE = 0.6  # lattice units per unit of projected length
SEED = 29
_U = np.uint64


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of size 1, or eight halves with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest whole-number points with an even sum: round, and flip the worst entry where the sum is odd."""
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(axis=1) % 2 != 0)
    if len(odd):
        off = x[odd] - f[odd]
        k = np.abs(off).argmax(axis=1)
        f[odd, k] += np.where(off[np.arange(len(odd)), k] >= 0, 1.0, -1.0)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice point of each row: the better of the nearest points of D8 and of D8 shifted by halves."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
    return np.where(closer[:, None], b, a)


_ROOTS = minimal_vectors()


def _cell(points: np.ndarray, table: int) -> np.ndarray:
    """64-bit name of a cell: two lattice points side by side (doubled, so whole numbers)."""
    h = np.full(len(points), table + 1, np.uint64)
    for c in np.rint(points * 2).astype(np.int64).view(np.uint64).T:
        h = mix(h * _U(0xD1342543DE82EF95) + c)
    return h


def cells(unit: np.ndarray, table: int, probes: int = PROBES, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(own cell, probed cells) of unit vectors in a table; the first probe is the own cell."""
    rng = np.random.default_rng((SEED, table))
    projected = unit @ rng.standard_normal((unit.shape[1], 16)) * scale
    halves = [projected[:, :8], projected[:, 8:]]
    points = [nearest_e8(h) for h in halves]
    own = _cell(np.hstack(points), table)
    out = [own]
    # how much farther each neighbouring point is than the nearest one, in either half
    extra = [2.0 - 2.0 * ((h - p) @ _ROOTS.T) for h, p in zip(halves, points, strict=True)]
    both = np.hstack(extra)
    k = min(probes, both.shape[1])
    nearest = np.argpartition(both, k - 1, axis=1)[:, :k] if k else np.zeros((len(unit), 0), np.int64)
    for j in range(k):
        pick = nearest[:, j]
        half, root = pick // len(_ROOTS), pick % len(_ROOTS)
        moved = [p + np.where((half == i)[:, None], _ROOTS[root], 0.0) for i, p in enumerate(points)]
        out.append(_cell(np.hstack(moved), table))
    return own, np.stack(out, axis=1)


def usable_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the rows that can be compared: no null, zero or non-finite ones."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return table.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where(
        F.col("v").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad & some)


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) by length of the vectors."""
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out = []
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        out.append((rows, flat[start[rows][:, None] + np.arange(n)]))
    return out


def _units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _postings(vectors: DataFrame, probes: int, tables: int) -> DataFrame:
    """(cell, node, own): every cell that a vector is stored in (own) or looks into."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for rows, m in _matrix(batch.column(1)):
                for lo in range(0, len(rows), 4096):
                    unit, who = _units(m[lo:lo + 4096]), ids[rows[lo:lo + 4096]]
                    for t in range(tables):
                        probed = cells(unit, t, probes)[1]
                        width = probed.shape[1]
                        own = np.zeros(probed.shape, bool)
                        own[:, 0] = True
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(probed.view(np.int64).ravel()), pa.array(np.repeat(who, width)), pa.array(own.ravel())],
                            names=["cell", "node", "own"])

    return vectors.select("vec_id", "v").mapInArrow(run, "cell bigint, node bigint, own boolean")


def _verified(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose cosine in double precision is at least ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            same = np.asarray(x.value_lengths()) == np.asarray(y.value_lengths())
            ok = np.zeros(len(batch), bool)
            rows = np.flatnonzero(same)
            if len(rows):
                take = pa.array(rows)
                for (at, p), (_, q) in zip(_matrix(x.take(take)), _matrix(y.take(take)), strict=True):
                    ok[rows[at]] = (_units(p) * _units(q)).sum(axis=1) >= least
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    full = (pairs.join(vectors.select(F.col("vec_id").alias("a"), F.col("v").alias("x")), "a")
            .join(vectors.select(F.col("vec_id").alias("b"), F.col("v").alias("y")), "b").select("a", "b", "x", "y"))
    return full.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(table: DataFrame, least: float = 0.9, tables: int = TABLES, probes: int = PROBES,
                    id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Copies of one vector are folded first (a folded copy counts as linked with its copies and with all
    that its vector is linked with), so a vector that a third of the rows repeat is one node.  Rows whose
    vector is null, empty, zero or not finite, and rows without id, have no links and are their own
    component; vectors of different lengths are not compared; extra columns are ignored; ids are expected
    to be unique (a repeated id's rows each count)."""
    usable = stored(usable_vectors(table, id_col, vec_col), "lattice-vectors")
    member = usable.select("vec_id", F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))), 256).alias("h"))
    groups = stored(member.groupBy("h").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")), "lattice-groups")
    # one row of a repeated id is enough as the carrier of its vector
    reps = stored(usable.join(groups.select(F.col("node").alias("vec_id"), F.col("h").alias("_h"), "copies"), "vec_id")
                  .where(F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))), 256) == F.col("_h"))
                  .dropDuplicates(["vec_id"]), "lattice-reps")
    posts = stored(_postings(reps, probes, tables), "lattice-cells")
    stored_in = posts.where("own").select("cell", F.col("node").alias("a"))
    looks = posts.select("cell", F.col("node").alias("b"))
    pairs = (looks.join(stored_in, "cell").where("a <> b")
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = stored(_verified(pairs, reps, least), "lattice-links")
    comp = connected_components(links)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    n = (both.join(groups.select(F.col("node").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("n"))
         .withColumnRenamed("a", "node"))
    per_node = (groups.join(n, "node", "left").join(comp, "node", "left")
                .select("h", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("component", "node").alias("component_id")))
    linked = (member.join(per_node.where("n_links > 0"), "h").groupBy("vec_id")
              .agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")))
    ids = table.select(F.col(id_col).cast("bigint").alias("vec_id"))
    return (ids.join(linked, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
