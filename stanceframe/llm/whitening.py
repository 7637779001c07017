"""Embedding whitening with a weighted multiplicity covariance (operator 11).

A vector's entries become whole numbers x = floor(scale * c) + shift.  Rows of equal x are grouped; the groups,
with their number of rows or one as weight, are what the covariance is fitted on: exact sums first, then one pass
that centres a block of groups and multiplies it with itself.  The eigenvectors of that covariance reach the tasks,
which whiten every group once; the rows take their group's values back by a join on x.

Exactness: sums and deviations are whole numbers of any size.  A task centres x at the nearest whole number m of
the mean first (exact), then by the rest of the mean, so no large numbers cancel.

Defined results: rows whose vector is null or holds null, NaN or infinite entries are left out, as are
entries whose x fits no long (``LARGEST``).  Vectors of
different lengths have nothing in common, so every length is a fit of its own; empty vectors have no component.
Null and repeated ids and repeated rows stay as they are; a row gives a row per component.  A component without
variance (eigenvalue not above rounding, so one vector or constant entries too) has ``whitened`` null and takes no
part in ``identity_error``, which is null where no component has variance.  ``deviation`` is null where it does not fit
64 bits.  Empty tables give no rows; of other columns none is read, so their names may clash.

What reaches the driver is a d x d covariance and d sums per length d.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanceframe.llm.common import stored

#: A group with more than n / HOT rows is hot; there are fewer than HOT of them, so they may be broadcast.
HOT = 1000
#: Vectors of a block in a task.
BLOCK = 4096
#: Entries of this size or more, times the scale, fit no long and count as infinite.
LARGEST = 2.0**61
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


@dataclass(frozen=True)
class Fit:
    """One length's model: shift of mean, eigenvectors (rows), eigenvalues, trace."""
    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    live: np.ndarray  # components with variance

    @property
    def centre(self) -> np.ndarray:
        """The whole number nearest to each mean."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    def rest(self) -> list[int]:
        """n * (mean - centre), exact."""
        return [s - self.n * int(m) for s, m in zip(self.sums, self.centre, strict=True)]


def _pack(x: np.ndarray) -> list[bytes]:
    """Each row of whole numbers as bytes: the number of the least width that holds them all, then the entries."""
    size = np.abs(x).max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(x)
    low = -1
    for k, w in enumerate(_WIDTHS):
        high = np.iinfo(w).max
        rows = np.flatnonzero((size <= high) & (size > low))
        for r, line in zip(rows.tolist(), x[rows].astype(w), strict=True):
            out[r] = b"%d" % k + line.tobytes()
        low = high
    return out


def _unpack(keys: list[bytes], d: int, shift: int) -> np.ndarray:
    """The whole numbers x of packed rows of length d."""
    out = np.empty((len(keys), d), np.int64)
    kinds = np.array([k[0] for k in keys])
    for kind in np.unique(kinds).tolist():
        at = np.flatnonzero(kinds == kind)
        out[at] = np.frombuffer(b"".join(keys[i][1:] for i in at.tolist()), _WIDTHS[kind - 48]).reshape(len(at), d)
    return out + shift


def keyed(vectors: DataFrame, vector: str, keep: list[str], scale: int) -> DataFrame:
    """``keep`` columns, the packed x and its length d, of rows with finite vectors.

    What is packed is floor(scale * c); the shift is added where x is read."""
    def run(batches):
        for whole in batches:
            for lo in range(0, len(whole), BLOCK):
                batch = whole.slice(lo, BLOCK)
                rows = batch.column(len(keep))
                values = rows.flatten()
                flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
                flat = np.where(values.is_valid().to_numpy(zero_copy_only=False), flat, np.nan)
                size = np.array(rows.value_lengths().fill_null(-1))
                start = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
                keys: list[bytes | None] = [None] * len(batch)
                for d in np.unique(size[size >= 0]).tolist():
                    at = np.flatnonzero(size == d)
                    v = flat[start[at][:, None] + np.arange(d)]
                    fine = (np.abs(v) * scale < LARGEST).all(axis=1)  # false for NaN
                    at, v = at[fine], v[fine]
                    packed = _pack(np.floor(v * scale).astype(np.int64)) if d else [b"0"] * len(at)
                    for r, k in zip(at.tolist(), packed, strict=True):
                        keys[r] = k
                out = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(keys, pa.binary()), pa.array(size, pa.int32())],
                                                 names=[*keep, "x", "d"])
                yield out.filter(out.column("x").is_valid())
    src = vectors.select(*keep, F.col(vector).alias("vec__"))
    types = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "x binary", "d int"]))


def _by_length(batch, d_column: int):
    """(d, row numbers) of an Arrow batch, in blocks."""
    d = np.array(batch.column(d_column))
    for value in np.unique(d).tolist():
        at = np.flatnonzero(d == value)
        for lo in range(0, len(at), BLOCK):
            yield value, at[lo:lo + BLOCK]


def _weights(by: str) -> F.Column:
    if by not in ("counts", "one"):
        raise ValueError(f"weights by {by!r}: counts or one")
    return F.col("copies") if by == "counts" else F.lit(1).cast("bigint")


def _sums(groups: DataFrame, shift: int) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Per length: weight of all groups and exact sums of each entry."""
    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for d, at in _by_length(batch, 1):
                x = _unpack(batch.column(0).take(pa.array(at)).to_pylist(), d, shift)
                w = np.array(batch.column(2).take(pa.array(at))).astype(np.int64)
                big = float(np.abs(x).max()) * float(w.sum()) >= 2.0**62
                s = (x.astype(object) * w.astype(object)[:, None]).sum(axis=0) if big else w @ x
                have = total.setdefault(d, [0, [0] * d])
                have[0] += int(w.sum())
                have[1] = [a + int(b) for a, b in zip(have[1], s, strict=True)]
        rows = [(d, -1, n) for d, (n, _) in total.items()] + [(d, j, s) for d, (_, sums) in total.items() for j, s in enumerate(sums)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([Decimal(r[2]) for r in rows], pa.decimal128(38, 0))], names=["d", "j", "s"])
    rows = groups.select("x", "d", "w").mapInArrow(run, "d int, j int, s decimal(38,0)").groupBy("d", "j").agg(F.sum("s").alias("s"))
    out: dict[int, dict[int, int]] = {}
    for r in rows.toLocalIterator():
        out.setdefault(r["d"], {})[r["j"]] = int(r["s"])
    return {d: (s[-1], tuple(s[j] for j in range(d))) for d, s in out.items()}


def _centred(x: np.ndarray, centre: np.ndarray, rest: list[int], n: int) -> np.ndarray:
    """x - mean in double precision: exact up to the whole number next to the mean, then less the rest."""
    return (x - centre).astype(float) - np.array([r / n for r in rest])


def _moments(table: DataFrame, columns: tuple[str, str, str], read, second_only: bool = False) -> DataFrame:
    """Sums over tasks of weighted products of centred blocks: (d, i, j, v), i <= j.  ``read(d, rows)`` gives a block."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, at in _by_length(batch, 1):
                block = read(d, batch.column(0).take(pa.array(at)))
                w = np.array(batch.column(2).take(pa.array(at))).astype(float)
                part = (block * w[:, None]).T @ block
                total[d] = total[d] + part if d in total else part
        for d, m in total.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j], pa.float64())],
                                             names=["d", "i", "j", "v"])
    return table.select(*columns).mapInArrow(run, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v"))


def _matrices(rows: DataFrame) -> dict[int, np.ndarray]:
    cells: dict[int, list] = {}
    for r in rows.toLocalIterator():  # k^2 / 2 cells per length
        cells.setdefault(r["d"], []).append((r["i"], r["j"], r["v"]))
    out = {}
    for d, cs in cells.items():
        k = max(c[1] for c in cs) + 1
        m = np.zeros((k, k))
        for i, j, v in cs:
            m[i, j] = m[j, i] = v
        out[d] = m
    return out


def fit(groups: DataFrame, components: int, shift: int) -> dict[int, Fit]:
    """Models by vector length, from groups (x, d, w)."""
    sums = {d: v for d, v in _sums(groups, shift).items() if d}
    shapes = {d: Fit(n, s, np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(0, bool)) for d, (n, s) in sums.items()}
    about = {d: (f.centre, f.rest(), f.n) for d, f in shapes.items()}

    def read(d, keys):
        return _centred(_unpack(keys.to_pylist(), d, shift), *about[d])

    out = {}
    for d, m in _matrices(_moments(groups.where("d > 0"), ("x", "d", "w"), read)).items():
        n, s = sums[d]
        cov = m / n
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1], vectors[:, ::-1].T
        k = min(components, d)
        values, vectors = values[:k], vectors[:k]
        # the same sign on every run: the largest entry is positive
        vectors = vectors * np.where(vectors[np.arange(k), np.abs(vectors).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
        top = max(float(values[0]), 0.0)
        out[d] = Fit(n, s, vectors, np.maximum(values, 0.0), float(np.trace(cov)), values > top * d * 1e-14)
    return out


def whiten_groups(groups: DataFrame, fits: dict[int, Fit], shift: int) -> DataFrame:
    """(x, d, w, copies, z, deviation): every group's whitened entries and its deviation as text, once."""
    about = {d: (f.centre, f.rest(), f.n, f.vectors, np.where(f.live, np.sqrt(np.where(f.live, f.values, 1.0)), 1.0), f.live) for d, f in fits.items()}

    def run(batches):
        for batch in batches:
            for d, at in _by_length(batch, 1):
                rows = batch.take(pa.array(at))
                x = _unpack(rows.column(0).to_pylist(), d, shift)
                centre, rest, n, vectors, root, live = about[d]
                z = _centred(x, centre, rest, n) @ vectors.T / root
                y = x - centre
                bound = max(float(np.abs(y).max()), 1.0) * n + max(map(abs, rest))
                if bound * bound * d < 2.0**62:
                    dev = ((y * n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    dev = [sum((n * int(v) - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y.tolist()]
                dev = [v if v < 2**63 else None for v in dev]
                k = z.shape[1]
                flat = pa.array(z.ravel(), mask=np.tile(~live, len(z)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(z) * k + 1, k), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*rows.columns, lists, pa.array(dev, pa.int64())], names=["x", "d", "w", "copies", "z", "deviation"])
    return groups.select("x", "d", "w", "copies").mapInArrow(run, "x binary, d int, w bigint, copies bigint, z array<double>, deviation bigint")


def identity_errors(white: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Per length: largest absolute entry of the whitened groups' covariance minus the identity, measured on them."""
    live = {d: np.flatnonzero(f.live) for d, f in fits.items()}

    def z_of(d, lists):
        return np.array(lists.flatten().fill_null(0.0)).reshape(len(lists), -1)[:, live[d]]

    def means(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, at in _by_length(batch, 1):
                part = np.array(batch.column(2).take(pa.array(at))).astype(float) @ z_of(d, batch.column(0).take(pa.array(at)))
                total[d] = total[d] + part if d in total else part
        for d, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), d), pa.int32()), pa.array(np.arange(len(s)), pa.int32()), pa.array(s, pa.float64())], names=["d", "i", "v"])

    some = white.where(F.col("d").isin([d for d in fits if len(live[d])]))
    mean = {d: np.zeros(len(live[d])) for d in fits}
    for r in some.select("z", "d", "w").mapInArrow(means, "d int, i int, v double").groupBy("d", "i").agg(F.sum("v").alias("v")).toLocalIterator():
        mean[r["d"]][r["i"]] = r["v"] / fits[r["d"]].n
    cov = _matrices(_moments(some, ("z", "d", "w"), lambda d, lists: z_of(d, lists) - mean[d]))
    return {d: float(np.abs(m / fits[d].n - np.eye(len(m))).max()) for d, m in cov.items()}


def whiten(vectors: DataFrame, components: int = 32, weights: str = "counts", scale: int = 64, shift: int = 1_000_000,
           key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Whitened components of every row, from a fit on all rows (``counts``) or on the different vectors (``one``).

    Returns (key, component, n, deviation, whitened, explained, identity_error); the module says what nulls, ties, empty
    and odd inputs give."""
    spark = vectors.sparkSession
    rows = keyed(vectors, vector, [key], scale)
    groups = rows.where("d > 0").groupBy("x", "d").agg(F.count(F.lit(1)).alias("copies")).withColumn("w", _weights(weights))
    groups = stored(groups, "white-groups")
    fits = fit(groups, components, shift)
    if not fits:
        kind = dict(vectors.dtypes)[key]
        return spark.createDataFrame([], f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    white = stored(whiten_groups(groups, fits, shift), "white")
    errors = identity_errors(white, fits)
    model = spark.createDataFrame([(d, f.n, [float(e) / f.trace if f.trace > 0 else 0.0 for e in f.values], errors.get(d)) for d, f in fits.items()],
                                  "d int, n bigint, share array<double>, identity_error double")  # a row per length
    total = white.agg(F.sum("copies")).first()[0]
    hot = F.col("copies") * HOT > total
    few = F.broadcast(white.where(hot).select("x", "z", "deviation", "d"))  # fewer than HOT groups
    many = white.where(~hot).select("x", "z", "deviation", "d")
    marked = rows.where("d > 0").join(F.broadcast(white.where(hot).select("x", F.lit(True).alias("is_hot"))), "x", "left")
    back = (marked.where("is_hot").drop("d", "is_hot").join(few, "x")
            .unionByName(marked.where("is_hot IS NULL").drop("d", "is_hot").join(many, "x")))
    out = back.join(F.broadcast(model), "d")
    return (out.select(key, "n", "deviation", "share", "identity_error", F.posexplode("z").alias("at", "whitened"))
            .select(key, (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("share", F.col("at")).alias("explained"), "identity_error"))
