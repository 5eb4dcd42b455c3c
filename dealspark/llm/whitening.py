"""Embedding whitening: eigenvectors of a distributed covariance in float32, refined by matrix products in higher precision."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, named, release, stored

#: x = floor(SCALE * c) + SHIFT is a vector's entry as a whole number.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond it count as it, so that x is a long.
MOST = 1 << 62
#: Exact sums travel as hi * 2^LIMB + lo, both decimals.
LIMB = 90
#: Rounds of refinement at most; the error squares each round, so four or five do.
ROUNDS = 12
#: Up to PRECISE dimensions the refinement's numbers have BITS binary places.
PRECISE, BITS = 128, 160
#: Rows whose matrix is worked on at once.
BLOCK = 4096


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first entry, entries, remaining) of each row of the batch, and all entries: a row remains if its vector is not null
    nor empty and holds only finite entries."""
    column = batch.column(batch.schema.get_field_index("vector"))
    at = np.asarray(column.offsets, dtype=np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    n = np.diff(at)
    return at[:-1], n, np.asarray(column.is_valid()) & (n > 0) & (bad[at[1:]] == bad[at[:-1]]), values


def _whole(values: np.ndarray) -> np.ndarray:
    """c to x, exactly: both the product with a power of two and the floor are exact in double."""
    return np.clip(np.floor(values * SCALE), -float(MOST), float(MOST)).astype(np.int64) + SHIFT


def _matrices(batches: Iterable[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The remaining rows of d entries, up to BLOCK at once, with their x."""
    for batch in batches:
        first, n, fine, values = _rows(batch)
        keep = np.flatnonzero(fine & (n == d))
        for i in range(0, len(keep), BLOCK):
            own = keep[i : i + BLOCK]
            yield batch.take(pa.array(own)), _whole(values[first[own][:, None] + np.arange(d)])


def _sum(z: np.ndarray) -> np.ndarray:
    """Exact column sums, as Python's integers."""
    most = int(np.abs(z).max(initial=0))
    return (z.sum(0) if most * max(len(z), 1) < 1 << 62 else z.astype(object).sum(0)).astype(object)


def _gram(z: np.ndarray) -> np.ndarray:
    """Exact z'z of up to BLOCK rows: products in double while every sum stays under 2^53, by halves of the digits else."""
    most = int(np.abs(z).max(initial=0))
    real = lambda m: np.rint(m).astype(np.int64).astype(object)
    if most * most * max(len(z), 1) < 1 << 53:
        f = z.astype(np.float64)
        return real(f.T @ f)
    if most < 1 << 40:
        high, low = (z >> 20).astype(np.float64), (z & ((1 << 20) - 1)).astype(np.float64)
        mixed = real(high.T @ low)
        return real(high.T @ high) * (1 << 40) + (mixed + mixed.T) * (1 << 20) + real(low.T @ low)
    o = z.astype(object)
    return o.T @ o


def _emit(keys: dict[str, list[int]], sums: list[int]) -> pa.RecordBatch:
    exact = pa.decimal128(38, 0)
    limbs = {"hi": pa.array([Decimal(int(v) >> LIMB) for v in sums], exact), "lo": pa.array([Decimal(int(v) & ((1 << LIMB) - 1)) for v in sums], exact)}
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32()) for k, v in keys.items()} | limbs)


def _added(partials: DataFrame, *keys: str) -> DataFrame:
    """Tasks' partial sums added up by key."""
    return partials.groupBy(*keys).agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))


def _exact(row) -> int:
    return (int(row["hi"]) << LIMB) + int(row["lo"])


def moments(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """(n, d, S): the rows that remain, their entries, and the exact sum of x by dimension. Where vectors differ in length
    those of the commonest length remain, of equally common ones the longest. No rows: (0, 0, [])."""

    def run(batches):
        totals: dict[int, list] = {}
        for batch in batches:
            first, n, fine, values = _rows(batch)
            for d in np.unique(n[fine]).tolist():
                keep = np.flatnonzero(fine & (n == d))
                for i in range(0, len(keep), BLOCK):
                    x = _whole(values[first[keep[i : i + BLOCK]][:, None] + np.arange(d)])
                    count, sums = totals.get(d, (0, 0))
                    totals[d] = [count + len(x), sums + _sum(x)]
        for d, (count, sums) in totals.items():  # place -1 counts the rows
            yield _emit({"d": [d] * (d + 1), "j": list(range(-1, d))}, [count, *sums])

    parts = stored(_added(map_texts(vectors.select("vector"), run, "d int, j int, hi decimal(38,0), lo decimal(38,0)"), "d", "j"), "whitening-sums")
    most = parts.where("j = -1").orderBy(F.desc("hi"), F.desc("lo"), F.desc("d")).first()
    if most is None:
        release(parts)
        return 0, 0, []
    d = most["d"]
    sums = {r["j"]: _exact(r) for r in parts.where(F.col("d") == d).collect()}  # one row a dimension
    release(parts)
    return sums.pop(-1), d, [sums[j] for j in range(d)]


def covariance(vectors: DataFrame, n: int, d: int, sums: list[int]) -> np.ndarray:
    """n^2 times the covariance of x, exactly, as Python's integers.

    Rows are centred at the whole number next to the mean before they are multiplied; what is left of the mean, under one
    half, is taken off the sums. Tasks send d (d + 1) / 2 sums each, which Spark adds up by place."""
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    upper = np.triu_indices(d)

    def run(batches):
        total = None
        for _, x in _matrices(batches, d):
            part = _gram(x - centre)
            total = part if total is None else total + part
        if total is not None:
            yield _emit({"i": upper[0].tolist(), "j": upper[1].tolist()}, total[upper].tolist())

    out = np.zeros((d, d), dtype=object)
    parts = _added(map_texts(vectors.select("vector"), run, "i int, j int, hi decimal(38,0), lo decimal(38,0)"), "i", "j")
    for r in parts.collect():  # d (d + 1) / 2 rows
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = _exact(r)
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre, strict=True)], dtype=object)
    return n * out - np.outer(rest, rest)


def _chains(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Places of eigenvalues that follow each other within `width`, two or more at a time."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero((np.diff(values[order]) > width).astype(bool)) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def eigen(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), falling, of a symmetric matrix of Python's integers, to double precision.

    Float32 eigenvectors start; each round takes the Ogita-Aishima step: with R = I - X'X and S = X'VX, X gains X E, where
    E_ij = (S_ij + l_j R_ij) / (l_j - l_i), or R_ij / 2 where the two eigenvalues lie closer than the error bound. Those
    form clusters, whose directions the step can't tell: V less the cluster's mean eigenvalue is solved in the cluster's
    own subspace, where its differences are the largest numbers. Products are of whole numbers with BITS binary places up
    to PRECISE dimensions, in extended precision beyond."""
    d, most = len(exact), int(np.abs(exact).max(initial=0)) or 1
    whole = d <= PRECISE
    unit, tiny, least = (1 << BITS, 1e-36, 1e-28) if whole else (np.longdouble(1), 1e-17, 1e-9)  # least: of the gaps that rounding leaves readable
    fixed = lambda m: np.array([[int(np.ldexp(np.longdouble(x), 64)) << (BITS - 64) for x in row] for row in m], dtype=object).reshape(m.shape) if whole else m.astype(np.longdouble)
    down = lambda m: m >> BITS if whole else m  # noqa: E731  after a product
    over = lambda m, by: (m << BITS) // by if whole else m / by
    size = lambda m: float(np.sqrt((_real(m, unit) ** 2).sum()))
    v = (exact << BITS) // most if whole else _real(exact, most).astype(np.longdouble)
    x = fixed(np.linalg.eigh(_real(v, unit).astype(np.float32))[1])
    one = np.diag([unit] * d)
    for _ in range(ROUNDS):
        r, s = one - down(x.T @ x), down(x.T @ down(v @ x))
        r, s = (r + r.T) // 2 if whole else (r + r.T) / 2, (s + s.T) // 2 if whole else (s + s.T) / 2
        values = over(np.diag(s), unit - np.diag(r))
        bound = max(2 * (size(s - np.diag(values)) + size(v) * size(r)), least * size(v))
        gap = values[None, :] - values[:, None]
        far = np.abs(_real(gap, unit)) > bound
        # E less R / 2 is antisymmetric, so rounding in a narrow gap turns directions but leaves them orthogonal.
        turn = over(s + down((values[None, :] + values[:, None]) * r) // 2 if whole else s + (values[None, :] + values[:, None]) * r / 2, np.where(far, gap, unit))
        step = np.where(far, turn, 0 * unit) + (r // 2 if whole else r / 2)
        x = x + down(x @ step)
        chains = _chains(values, int(bound * unit) if whole else bound)
        for own in chains:
            y, mean = x[:, own], values[own].sum() // len(own) if whole else values[own].mean()
            t = _real(down(y.T @ (down(v @ y) - down(mean * y))), unit)
            if np.abs(t).max() > tiny:  # else they are one eigenvalue, and any directions will do
                turned = np.linalg.eigh(((t + t.T) / np.abs(t).max()).astype(np.float64))[1]
                x[:, own] = down(y @ fixed(turned))
        if np.abs(_real(step, unit)).max() < tiny:
            break
    r = one - down(x.T @ x)
    x = x + down(x @ (r // 2 if whole else r / 2))
    values = _real(np.diag(down(x.T @ down(v @ x))), unit)
    order = np.argsort(-values, kind="stable")
    x = _real(x[:, order], unit)
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(d)] < 0, -1, 1)  # the largest entry is positive
    return values[order] * np.longdouble(most), x


def _real(m: np.ndarray, unit) -> np.ndarray:
    """Fixed-point numbers as extended floats; whole numbers beyond those' range are divided exactly first."""
    if m.dtype != object:
        return m
    cut = max(0, int(unit).bit_length() - 80)
    top = np.vectorize(lambda a: np.longdouble(a >> cut), otypes=[np.longdouble])(m) if m.size else m.astype(np.longdouble)
    return top / np.longdouble(int(unit) >> cut)


def whiten(vectors: DataFrame, vector: str = "vector", components: int = 32) -> tuple[DataFrame, dict]:
    """(vectors' other columns, whitened array<double>, deviation long) of each remaining row, and the fit: n, values,
    explained, identity_error.

    Rows whose vector is null, empty, holds a null or a non-finite entry, or has not the commonest length, go. Entries are
    taken as x = floor(64 c) + 1,000,000 (beyond 2^62: that). The covariance is over all remaining rows, in exact whole
    numbers; only sums by dimension and by pair of dimensions reach the driver. Repeated rows count and come as often as
    they are there. A component without variance (rank below the dimension, one row, equal rows) has whitened null, and
    explained null if no component has any; the identity error is over the others, null if there are none. A deviation
    beyond long is null. Empty table: empty result. identity_error is measured on the whitened rows as written."""
    others = [c for c in vectors.columns if c != vector]
    plain = vectors.select(*[named(c).alias(f"c{i}") for i, c in enumerate(others)], named(vector).cast("array<double>").alias("vector"))
    n, d, sums = moments(plain)
    k = min(components, d)
    schema = T.StructType([*[T.StructField(f"c{i}", vectors.schema[c].dataType) for i, c in enumerate(others)], T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())])
    rename = [F.col(f"c{i}").alias(c) for i, c in enumerate(others)]
    if not n:
        return plain.sparkSession.createDataFrame([], schema).select(*rename, "whitened", "deviation"), {"n": 0, "values": [], "explained": [], "identity_error": None}
    exact = covariance(plain, n, d, sums)
    values, axes = eigen(exact)
    values, trace = values / (np.longdouble(n) * n), int(np.trace(exact)) / (n * n)
    live = values[:k] > len(values) * 1e-17 * max(values[0], 0)
    weights = np.where(live, axes[:, :k] / np.sqrt(np.where(live, values[:k], 1)), np.nan).astype(np.float64)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    left = np.array([(s - n * int(c)) / n for s, c in zip(sums, centre, strict=True)])
    total, dead = np.array(sums, dtype=object), np.flatnonzero(~live)

    def run(batches):
        for batch, x in _matrices(batches, d):
            near = x - centre
            y = (near - left) @ weights
            # n x - S = n (x - centre) - (S - n centre), small numbers first
            if n * (int(np.abs(near).max()) + 1) < 1 << 62 and d * (n * (int(np.abs(near).max()) + 1)) ** 2 < 1 << 63:
                own = n * near - (total - n * centre.astype(object)).astype(np.int64)
                off = (own * own).sum(1).tolist()
            else:
                off = [v if v < 1 << 63 else None for v in ((n * x.astype(object) - total) ** 2).sum(1).tolist()]
            flat = pa.array(y.ravel(), mask=np.isin(np.tile(np.arange(k), len(y)), dead))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * k), flat)
            keep = [batch.column(i) for i in range(batch.num_columns) if batch.schema.field(i).name != "vector"]
            yield pa.RecordBatch.from_arrays([*keep, lists, pa.array(off, pa.int64())], names=[f.name for f in schema])

    rows = stored(map_texts(plain, run, schema), "whitening")
    fit = {"n": n, "values": [float(e) for e in values[:k]], "explained": [float(e) / trace if trace > 0 else None for e in values[:k]], "identity_error": _identity_error(rows, n, np.flatnonzero(live))}
    return rows.select(*rename, "whitened", "deviation"), fit


def _identity_error(rows: DataFrame, n: int, live: np.ndarray) -> float | None:
    """The largest absolute entry of the whitened rows' covariance less the identity, from sums of their products."""
    k = len(live)
    if not k:
        return None

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                y = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, live]
                total += np.vstack([y.T @ y, y.sum(0)])
        yield pa.RecordBatch.from_pydict({"i": np.repeat(np.arange(k + 1, dtype=np.int32), k), "j": np.tile(np.arange(k, dtype=np.int32), k + 1), "v": total.ravel()})

    got = map_texts(rows.select("whitened"), run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((k + 1, k))
    for r in got:  # (k + 1) k rows
        m[r["i"], r["j"]] = r["v"] / n
    return float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())


def whitened_components(vectors: DataFrame, vector: str, id_column: str, components: int = 32) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each remaining row and component,
    numbered from 1; cases as in `whiten`. Columns besides the id and the vector are not read."""
    rows, fit = whiten(vectors.select(named(id_column), named(vector)), vector, components)
    explained = F.array(*[F.lit(e).cast("double") for e in fit["explained"]]).cast("array<double>")
    out = rows.select(named(id_column), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        named(id_column), (F.col("at") + 1).cast("int").alias("component"), F.lit(fit["n"]).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(fit["identity_error"]).cast("double").alias("identity_error"),
    )
