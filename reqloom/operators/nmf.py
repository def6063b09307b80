"""Non-negative matrix factorisation of sparse row tables, X ~ W H.

Alternating hierarchical least squares (Cichocki and Phan 2009), begun from a
randomised NNDSVDa (Boutsidis and Gallopoulos 2008). Only H (topics x terms) is
state: in each round every task solves its own rows' weights for the H it was
given and returns two small sums, W'X and W'W, from which the driver takes the
next H. Rows are never moved, and lineage doesn't grow. Several fits of a table,
or of its parts, go through their rounds together, so they share the reads. Small
matrices are fitted in one task, where a job a round would cost more than the work.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqloom.shipping import ship

#: Non-zeros up to which one task fits the whole matrix.
SMALL = 2_000_000
#: Partial sums that meet on the driver, at most; partitions' sums are first added up in so many groups.
GROUPS = 32
SWEEPS = 20


#: Rows whose weights are solved at once, so that they stay in a core's cache.
BLOCK = 2048
#: Bytes of sums that meet on the driver in a round, at most; more fits than that go one lot after the other.
MOST_SUMS = 256 << 20


class Sparse:
    """Rows of (columns, values), for products with dense matrices."""

    def __init__(self, sizes: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.sizes, self.columns, self.values = np.asarray(sizes, np.int64), np.asarray(columns, np.int64), np.asarray(values, float)
        self.rows = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.width = width

    def times(self, dense: np.ndarray) -> np.ndarray:
        """X @ dense, for dense of ``width`` rows."""
        across = np.ascontiguousarray(dense.T)
        return np.stack([np.bincount(self.rows, self.values * column[self.columns], len(self.sizes)) for column in across], axis=1).astype(float)  # bincount of nothing is whole numbers

    def transposed_times(self, dense: np.ndarray) -> np.ndarray:
        """X' @ dense, for dense with a row for each of X's."""
        across = np.ascontiguousarray(dense.T)
        return np.stack([np.bincount(self.columns, self.values * column[self.rows], self.width) for column in across], axis=1).astype(float)


def solve_weights(x: Sparse, h: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Each row's non-negative weights for the given H; a block of rows is done before its last sweep if a sweep leaves it as it is."""
    gram, target = h @ h.T, x.times(h.T)
    total, used = np.maximum(gram.sum(axis=1), 1e-12)[:, None], [j for j in range(len(h)) if gram[j, j] > 1e-12]
    w = np.empty_like(target)
    for at in range(0, len(target), BLOCK):
        wanted = np.ascontiguousarray(target[at : at + BLOCK].T)
        now = np.maximum(wanted, 0) / total
        for _ in range(sweeps):
            before = now.copy()
            for j in used:
                now[j] = np.maximum(0, now[j] + (wanted[j] - gram[j] @ now) / gram[j, j])
            if np.abs(now - before).max() <= 1e-14 * now.max():
                break
        w[at : at + BLOCK] = now.T
    return w


def improve_topics(h: np.ndarray, wx: np.ndarray, ww: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """H after least-squares sweeps for the sums W'X and W'W."""
    h = h.copy()
    for _ in range(sweeps):
        for j in range(len(h)):
            if ww[j, j] > 1e-12:
                h[j] = np.maximum(0, h[j] + (wx[j] - ww[j] @ h) / ww[j, j])
    return h


def begin_topics(small: np.ndarray, mean: float, k: int) -> np.ndarray:
    """NNDSVDa's H from a randomised SVD's small matrix B = Q'X."""
    _, s, vt = np.linalg.svd(small, full_matrices=False)
    h = np.zeros((k, small.shape[1]))
    for j in range(min(k, len(s))):
        pos, neg = np.maximum(vt[j], 0), np.maximum(-vt[j], 0)
        v = pos if np.linalg.norm(pos) >= np.linalg.norm(neg) or j == 0 and pos.sum() >= neg.sum() else neg
        h[j] = np.sqrt(s[j]) * v
    h[h < 1e-9] = max(mean, 1e-9)
    return h


def loss(square: float, wx: np.ndarray, ww: np.ndarray, h: np.ndarray) -> float:
    """|X - W H| from the sums."""
    return float(np.sqrt(max(0.0, square - 2 * (wx * h).sum() + (ww * (h @ h.T)).sum())))


def fit_local(x: Sparse, k: int, seed: int = 42, rounds: int = 300, tol: float = 1e-4) -> tuple[np.ndarray, list[float]]:
    """(H, losses) of one matrix in memory."""
    rng = np.random.default_rng(seed)
    square = float((x.values**2).sum())
    q, _ = np.linalg.qr(x.times(rng.normal(size=(x.width, k + 8))))
    q, _ = np.linalg.qr(x.times(x.transposed_times(q)))
    h = begin_topics(x.transposed_times(q).T, x.values.sum() / max(1, len(x.sizes) * x.width), k)
    losses: list[float] = []
    for _ in range(rounds):
        w = solve_weights(x, h)
        wx, ww = x.transposed_times(w).T, w.T @ w
        after = improve_topics(h, wx, ww)
        now = loss(square, wx, ww, after)
        if losses and now > losses[-1]:
            break  # the weights are solved only so closely
        h = after
        losses.append(now)
        if len(losses) > 1 and losses[-2] - losses[-1] <= tol * losses[0]:
            break
    return h, losses


def as_rows(terms: DataFrame, key: str, value: str = "tfidf") -> DataFrame:
    """(key, idx, val): each row's terms in term order."""
    packed = terms.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("term_id").alias("i"), F.col(value).cast("double").alias("x")))).alias("t"))
    return packed.select(key, F.transform("t", lambda t: t["i"]).alias("idx"), F.transform("t", lambda t: t["x"]).alias("val"))


def sparse(table: pa.Table | pa.RecordBatch, width: int) -> Sparse:
    """The rows of Arrow's lists ``idx`` and ``val``."""
    lists = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (table.column("idx"), table.column("val"))]
    return Sparse(pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False), *(x.flatten().to_numpy(zero_copy_only=False) for x in lists), width)


def _summed(rows: DataFrame, widths: dict[int, int], partial) -> dict[str, np.ndarray]:
    """The sums over all rows (part, idx, val) of what ``partial(part, sparse)`` returns for a part's rows: {name: array}, added in partition order."""
    context = rows.sparkSession.sparkContext
    tasks = max(1, context.defaultParallelism)  # each task's sums are as large as H
    schema = pa.schema([("grp", pa.int32()), ("at", pa.int32()), ("names", pa.list_(pa.string())), ("sums", pa.list_(pa.binary()))])

    def add(total: dict[str, np.ndarray], made: dict[str, np.ndarray]) -> None:
        for name, x in made.items():
            total[name] = total[name] + x if name in total else x

    def batch_of(grp: int, at: int, total: dict[str, np.ndarray]) -> dict:
        return {"grp": [grp], "at": [at], "names": [list(total)], "sums": [[np.ascontiguousarray(x).tobytes() for x in total.values()]]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            of = batch.column("part").to_numpy(zero_copy_only=False)
            for part in np.unique(of):
                mine = batch if (of == part).all() else batch.filter(pa.array(of == part))
                add(total, partial(int(part), sparse(mine, widths[int(part)])))
        if total:
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(batch_of(at % GROUPS, at, total), schema=schema)

    def read(row) -> dict[str, np.ndarray]:
        return {name: np.frombuffer(x) for name, x in zip(row["names"], row["sums"], strict=True)}

    def merge(group: pa.Table) -> pa.Table:
        total: dict[str, np.ndarray] = {}
        rows = sorted(group.to_pylist(), key=lambda r: r["at"])
        for row in rows:
            add(total, read(row))
        return pa.Table.from_pydict(batch_of(rows[0]["grp"], rows[0]["at"], total), schema=schema)

    ddl = "grp int, at int, names array<string>, sums array<binary>"
    made = rows.select("part", "idx", "val").coalesce(tasks).mapInArrow(run, ddl)
    if tasks > GROUPS:
        made = made.groupBy("grp").applyInArrow(merge, ddl)
    total: dict[str, np.ndarray] = {}
    for row in sorted(made.toArrow().to_pylist(), key=lambda r: r["at"]):  # at most GROUPS rows
        add(total, read(row))
    return total


def fit_parts(rows: DataFrame, widths: dict[int, int], ks: Sequence[int], seed: int = 42, rounds: int = 300, tol: float = 1e-4) -> dict[tuple[int, int], tuple[np.ndarray, list[float]]]:
    """(H, losses) of each part and k, of a table (part, idx, val) of any size; ``rows`` is read once a round, so hand in a stored table."""
    ship(rows.sparkSession)
    every = [(part, k) for part in sorted(widths) for k in ks]
    tasks = min(GROUPS, rows.sparkSession.sparkContext.defaultParallelism)
    size = lambda fit: 8 * (fit[1] + 8) * widths[fit[0]] * tasks
    out: dict[tuple[int, int], tuple[np.ndarray, list[float]]] = {}
    while every:
        n = max(1, int(np.searchsorted(np.cumsum([size(f) for f in every]), MOST_SUMS, "right")))
        mine, every = every[:n], every[n:]
        out |= _fit_lot(rows.where(F.col("part").isin(sorted({p for p, _ in mine}))), widths, mine, seed, rounds, tol)
    return out


def _fit_lot(rows: DataFrame, widths: dict[int, int], fits: list[tuple[int, int]], seed: int, rounds: int, tol: float) -> dict[tuple[int, int], tuple[np.ndarray, list[float]]]:
    def of_part(made):
        """What ``made(part, k, x)`` returns for all fits of a part, under their names."""
        return lambda part, x: {f"{what} {p} {k}": a.ravel() for p, k in fits if p == part for what, a in made(p, k, x).items()}

    omegas = {(p, k): np.random.default_rng(seed).normal(size=(widths[p], k + 8)) for p, k in fits}
    # a row-space basis by two passes: Y'X for Y = X omega, orthonormalised on the driver
    sums = _summed(rows, widths, of_part(lambda p, k, x: {"y": x.transposed_times(x.times(omegas[p, k])), "n": np.array([x.values.sum(), (x.values**2).sum(), float(len(x.sizes))])}))
    none = {f: (np.zeros((f[1], widths[f[0]])), []) for f in fits if f"n {f[0]} {f[1]}" not in sums}
    fits = [f for f in fits if f not in none]
    if not fits:
        return none
    bases = {(p, k): np.linalg.qr(sums[f"y {p} {k}"].reshape(widths[p], k + 8))[0] for p, k in fits}
    grams = _summed(rows, widths, of_part(lambda p, k, x: {"g": (lambda y: y.T @ y)(x.times(bases[p, k]))}))
    hs: dict[tuple[int, int], np.ndarray] = {}
    losses: dict[tuple[int, int], list[float]] = {f: [] for f in fits}
    squares = {}
    for p, k in fits:
        basis, (total, squares[p, k], n) = bases[p, k], sums[f"n {p} {k}"]
        values, vectors = np.linalg.eigh(grams[f"g {p} {k}"].reshape(basis.shape[1], basis.shape[1]))
        order = np.argsort(-values)
        small = (np.sqrt(np.maximum(values[order], 0))[:, None] * vectors[:, order].T) @ basis.T
        hs[p, k] = begin_topics(small, total / max(1.0, n * widths[p]), k)
    open_fits = list(fits)

    def sums_of(x: Sparse, h: np.ndarray) -> dict[str, np.ndarray]:
        w = solve_weights(x, h)
        return {"wx": x.transposed_times(w).T, "ww": w.T @ w}

    for _ in range(rounds):
        now_open = {f: hs[f] for f in open_fits}
        made = _summed(rows, widths, lambda part, x, held=now_open: {f"{what} {p} {k}": a.ravel() for (p, k), h in held.items() if p == part for what, a in sums_of(x, h).items()})
        for f in list(open_fits):
            p, k = f
            wx, ww = made[f"wx {p} {k}"].reshape(k, widths[p]), made[f"ww {p} {k}"].reshape(k, k)
            after = improve_topics(hs[f], wx, ww)
            now, before = loss(squares[f], wx, ww, after), losses[f]
            if before and now > before[-1]:
                open_fits.remove(f)
                continue
            hs[f] = after
            before.append(now)
            if len(before) > 1 and before[-2] - before[-1] <= tol * before[0]:
                open_fits.remove(f)
        if not open_fits:
            break
    return none | {f: (hs[f], losses[f]) for f in fits}


def fit_spread(rows: DataFrame, width: int, k: int, seed: int = 42, rounds: int = 300, tol: float = 1e-4) -> tuple[np.ndarray, list[float]]:
    """(H, losses) of a table (key, idx, val) of any size; ``rows`` is read once a round, so hand in a stored table."""
    return fit_parts(rows.select(F.lit(0).alias("part"), "idx", "val"), {0: width}, [k], seed, rounds, tol)[0, k]


def fit(rows: DataFrame, width: int, k: int, seed: int = 42, rounds: int = 300, tol: float = 1e-4, small: int = SMALL) -> tuple[np.ndarray, list[float]]:
    """(H, losses), in one task if the table has few non-zeros, else spread."""
    ship(rows.sparkSession)
    nnz = rows.agg(F.sum(F.size("idx"))).first()[0] or 0
    if not nnz:
        return np.zeros((k, width)), []
    if nnz > small:
        return fit_spread(rows, width, k, seed, rounds, tol)
    key = rows.columns[0]

    def run(group: pa.Table) -> pa.Table:
        h, losses = fit_local(sparse(group.sort_by(key), width), k, seed, rounds, tol)
        return pa.table({"h": pa.array([h.tobytes()], pa.binary()), "losses": pa.array([losses], pa.list_(pa.float64()))})

    made = rows.groupBy(F.lit(0).alias("one")).applyInArrow(run, "h binary, losses array<double>").first()
    return np.frombuffer(bytes(made["h"])).reshape(k, width), list(made["losses"])


def weights(rows: DataFrame, h: np.ndarray) -> DataFrame:
    """(key, weights): each row's weights for H, summing to one, or all zero."""
    ship(rows.sparkSession)
    key = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = shares(solve_weights(sparse(batch, h.shape[1]), h, 30))
                yield pa.RecordBatch.from_arrays([batch.column(0), as_lists(w)], [key, "weights"])

    return rows.mapInArrow(run, f"{key} string, weights array<double>")


def shares(w: np.ndarray) -> np.ndarray:
    """Rows that sum to one; all zero stays as it is."""
    total = w.sum(axis=1, keepdims=True)
    return np.divide(w, total, out=np.zeros_like(w), where=total > 0)


def as_lists(w: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], pa.int32()), pa.array(np.ascontiguousarray(w).ravel()))


def topic_terms(h: np.ndarray, terms: list[str], n: int) -> list[tuple[int, list[str], list[float]]]:
    """(topic, its ``n`` heaviest terms, their shares); rows of H sum to one, ties go by term."""
    out = []
    for topic, row in enumerate(h):
        share = row / row.sum() if row.sum() > 0 else row
        order = sorted(range(len(terms)), key=lambda i: (-share[i], terms[i]))[:n]
        out.append((topic, [terms[i] for i in order], [float(share[i]) for i in order]))
    return out
