"""Nearest neighbours by randomly rotated one-bit codes.

Every vector less the centroid is rotated at random and reduced to the signs of its coordinates, packed to
bits, with two scalars: its length and the cosine between it and its sign vector.  From bits and scalars
the inner product with a query is estimated together with an error bound; vectors whose upper bound
reaches the k-th best lower bound are compared exactly, all others are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stanceframe.llm.common import stored
from stanceframe.llm.lattice_dedup import _matrix, usable_vectors

SEED = 41
BOUND = 1.9  # narrow width of the error bound, in standard deviations of the estimate: may pass over true neighbours
SEARCH_BOUND = 3.0  # the width that search works with
DATA_BLOCK, QUERY_BLOCK = 8192, 2048


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every worker."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector over all rows, for each length of vectors (as many numbers as vectors have places)."""
    rows = (vectors.select(F.size("v").alias("n"), F.posexplode("v").alias("i", "x"))
            .groupBy("n", "i").agg(F.avg("x").alias("m")).collect())
    out: dict[int, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["n"], np.zeros(r["n"]))[r["i"]] = r["m"]
    return out


def codes(m: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, length of the residual, cosine of the residual and its sign vector)."""
    rest = (m - centre) @ rotation(m.shape[1])
    length = np.sqrt((rest * rest).sum(axis=1))
    signs = rest >= 0
    cos = np.abs(rest).sum(axis=1) / np.maximum(length, 1e-300) / np.sqrt(m.shape[1])
    return np.packbits(signs, axis=1), length, np.where(length > 0, cos, 1.0)


def index_vectors(vectors: DataFrame, centre: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, v, code, len, cos of every usable vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, m in _matrix(batch.column(1)):
                bits, length, cos = codes(m, centre[m.shape[1]])
                take = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([take.column(0), take.column(1), pa.array([b.tobytes() for b in bits], pa.binary()),
                                                  pa.array(length), pa.array(cos)], names=["vec_id", "v", "code", "len", "cos"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id bigint, v array<double>, code binary, len double, cos double")


def best_of_block(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, bits: np.ndarray, length: np.ndarray,
                  cos: np.ndarray, centre: np.ndarray, k: int, bound: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query (id, vector ids, scores, vectors compared exactly): the block's k best, ties to smaller ids."""
    dim = vectors.shape[1]
    signs = (np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    turned = queries @ rotation(dim)
    base = queries @ centre
    size = np.sqrt((queries * queries).sum(axis=1))
    spread = np.sqrt(np.maximum(1 - cos * cos, 0)) / cos / np.sqrt(max(dim - 1, 1))
    for lo in range(0, len(queries), 256):
        # estimate of <residual, query>: bits against the rotated query, divided by the sign vector's cosine
        raw = (signs @ turned[lo:lo + 256].T.astype(np.float32)).T
        guess = base[lo:lo + 256, None] + raw * (length / cos)
        err = bound * size[lo:lo + 256, None] * (length * spread) + 1e-5 * (np.abs(guess) + size[lo:lo + 256, None] * length)
        for j in range(len(guess)):
            own = ids == q_ids[lo + j]
            low = np.where(own, -np.inf, guess[j] - err[j])
            n = int((~own).sum())
            cut = np.partition(low, len(low) - k)[len(low) - k] if n > k else -np.inf
            rows = np.flatnonzero((guess[j] + err[j] >= cut) & ~own)
            score = (vectors[rows] * queries[lo + j]).sum(axis=1)
            best = np.lexsort((ids[rows], -score))[:k]
            yield int(q_ids[lo + j]), ids[rows[best]], score[best], len(rows)


def search(table: DataFrame, is_query, k: int = 20, bound: float = SEARCH_BOUND, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest inner product with every query row.

    ``is_query`` is a condition on ``vec_id``.  Null, empty, zero and non-finite vectors and null ids take
    no part, neither as queries nor as candidates; vectors of different lengths are not compared; with
    fewer than k candidates all are returned; ties go to the smaller id; rows of a repeated id are
    candidates one by one, and queries one by one, but never of each other.  Extra columns are ignored.

    Queries meet all rows in blocks of bounded size; each block pair returns its k best of every query."""
    vectors = stored(usable_vectors(table, id_col, vec_col), "search-vectors")
    centre = centroids(vectors)
    index = stored(index_vectors(vectors, centre), "search-index")
    total = index.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks, q_blocks = -(-total[0] // DATA_BLOCK) or 1, -(-total[1] // QUERY_BLOCK) or 1
    dim = F.size("v").alias("dim")
    block_of = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    # both sides come from one table: fresh names keep their columns apart
    data = index.select(F.col("vec_id").alias("d_id"), F.col("v").alias("d_v"), F.col("code").alias("d_code"), F.col("len").alias("d_len"),
                        F.col("cos").alias("d_cos"), F.size("v").alias("dim"), block_of(blocks).alias("block"),
                        F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"))
    queries = (index.where(is_query).select("vec_id", "v", dim, block_of(q_blocks).alias("q_block"),
                                            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("compared", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], q: pa.Table, d: pa.Table) -> pa.Table:
        if not len(q) or not len(d):
            return schema.empty_table()
        n = key[0].as_py()
        floats = lambda c: np.asarray(c.combine_chunks().flatten()).reshape(-1, n)
        bits = np.frombuffer(b"".join(d["d_code"].to_pylist()), np.uint8).reshape(len(d), -1)
        out = [(np.full(len(i), a), i, s, np.full(len(i), c)) for a, i, s, c in best_of_block(
            np.asarray(q["vec_id"]), floats(q["v"]), np.asarray(d["d_id"]), floats(d["d_v"]), bits, np.asarray(d["d_len"]),
            np.asarray(d["d_cos"]), centre[n], k, bound)]
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=schema)

    keys = ["dim", "block", "q_block"]
    found = (queries.groupBy(*keys).cogroup(data.groupBy(*keys))
             .applyInArrow(run, "query_id bigint, vec_id bigint, score double, compared bigint"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "compared"))
