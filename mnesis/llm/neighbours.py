"""Most similar vectors for every vector: randomly rotated one-bit codes (problem 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnesis.shared import materialise

#: Rows the cell centres are fitted on at most (those with the smallest hashes of their ids).
FIT_ROWS = 40_000
LIST_ROWS, BLOCK_ROWS = 600, 6000
#: Coarse centres at most; beyond, each is divided by one set of residuals into as many fine cells as keep a cell at
#: about ``LIST_ROWS`` rows. So every task holds ``MOST_LISTS`` centres and as many residuals at most.
MOST_LISTS = 4096
#: A vector also looks into the cells whose border is at most this far from it.
BORDER = 0.06
#: Width of the error bound of a one-bit estimate, in standard deviations.
EPSILON = 1.9
#: Groups of exact copies beyond this size are kept by their first members only; see ``nearest``.
MOST_COPIES = 64


@dataclass
class Cells:
    """Unit centres, residuals that divide each centre's cell, blocks of a cell's rows, and the random rotation.

    Cell ``i * len(residuals) + j`` lies around ``centres[i] + residuals[j]``.
    """

    centres: np.ndarray
    residuals: np.ndarray
    rows: np.ndarray  # expected in the cell of a centre
    shares: np.ndarray  # of the rows that lie nearest to each residual
    rotation: np.ndarray
    border_norm: np.ndarray  # distance between each two centres
    residual_norm: np.ndarray  # and each two residuals

    def blocks(self, cell: np.ndarray) -> np.ndarray:
        """Number of blocks that the rows of each cell are spread over."""
        i, j = np.divmod(cell, len(self.residuals))
        return np.maximum(1, np.ceil(self.rows[i] * self.shares[j] / BLOCK_ROWS)).astype(np.int64)

    def look(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own cell of each row; and the row and cell of every further cell whose border is near it."""
        f, row = len(self.residuals), np.arange(len(X))
        sims = X @ self.centres.T
        first = sims.argmax(axis=1)
        border = (sims[row, first][:, None] - sims) / self.border_norm[first]
        border[row, first] = -1
        q, centre = np.nonzero(border <= BORDER)
        if f == 1:
            away = centre != first[q]
            return first, q[away], centre[away]
        own = np.zeros(len(X), dtype=np.int64)
        qs, cells = [], []
        for lo in range(0, len(q), 4096):
            a, c = q[lo : lo + 4096], centre[lo : lo + 4096]
            R = X[a] - self.centres[c]
            d = (self.residuals**2).sum(axis=1)[None, :] - 2 * (R @ self.residuals.T)
            best = d.argmin(axis=1)
            k = np.arange(len(a))
            gap = (d - d[k, best][:, None]) / (2 * self.residual_norm[best])
            gap[k, best] = -1
            home = c == first[a]
            own[a[home]] = c[home] * f + best[home]
            r, j = np.nonzero(gap <= BORDER)
            away = ~(home[r] & (j == best[r]))
            qs.append(a[r][away])
            cells.append((c[r] * f + j)[away])
        return own, np.concatenate(qs), np.concatenate(cells)


def _means(sample: np.ndarray, k: int, rng: np.random.Generator, rounds: int, unit: bool) -> tuple[np.ndarray, np.ndarray]:
    """Centres of ``k`` clusters and the rows' nearest; a block of rows at a time."""
    centres = sample[rng.choice(len(sample), k, replace=False)].copy()

    def assign() -> np.ndarray:
        square = 0 if unit else (centres**2).sum(axis=1) / 2
        return np.concatenate([(sample[lo : lo + 2048] @ centres.T - square).argmax(axis=1) for lo in range(0, len(sample), 2048)])

    for _ in range(rounds):
        near = assign()
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=k)
        sums[n == 0] = sample[rng.choice(len(sample), int((n == 0).sum()))]
        centres = sums / (np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9) if unit else np.maximum(n, 1)[:, None])
    return centres, assign()


def _distances(x: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)
    return np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * (x @ x.T), 1e-9)).astype(np.float32)


def fit_cells(sample: np.ndarray, n_rows: int, seed: int = 7, rounds: int = 6, most_lists: int = MOST_LISTS) -> Cells:
    rng = np.random.default_rng(seed)
    d = sample.shape[1] if sample.size else 1
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.float32)
    none = np.zeros((1, d), np.float32)
    if not len(sample):
        return Cells(none, none, np.zeros(1), np.ones(1), rotation, np.ones((1, 1), np.float32), np.ones((1, 1), np.float32))
    lists = max(1, n_rows // LIST_ROWS)
    k = int(min(most_lists, lists, max(1, len(sample) // 4)))
    centres, near = _means(sample, k, rng, rounds, unit=True)
    f = int(min(most_lists, max(1, round(lists / k)), max(1, len(sample) // 4)))
    residuals, fine = _means(sample - centres[near], f, rng, rounds, unit=False) if f > 1 else (none, np.zeros(len(sample), int))
    return Cells(
        centres.astype(np.float32), residuals.astype(np.float32), np.bincount(near, minlength=k) / len(sample) * n_rows, np.bincount(fine, minlength=f) / len(sample),
        rotation, _distances(centres), _distances(residuals),
    )


_ROUTED = "cell int, block int, role int, id string, vec binary"


def _route(vectors: DataFrame, cells) -> DataFrame:
    """Each vector as a row of its own cell's block, and as a query to the other blocks it looks into."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = cells.value
        for pdf in batches:
            for lo in range(0, len(pdf), 1024):
                part = pdf.iloc[lo : lo + 1024]
                X = np.frombuffer(b"".join(part["vec"]), dtype="<f4").reshape(len(part), -1)
                own, q, cell = c.look(X)
                row = np.arange(len(X))
                ids = part["id"].to_numpy()
                n_blocks = c.blocks(own)
                at = np.array([hash_id(i) for i in ids]) % n_blocks
                more_q = np.flatnonzero(n_blocks > 1)
                q = np.concatenate((q, more_q))
                cell = np.concatenate((cell, own[more_q]))
                reps = c.blocks(cell)
                q, cell_r = np.repeat(q, reps), np.repeat(cell, reps)
                block = np.arange(len(q)) - np.repeat(np.cumsum(reps) - reps, reps)
                foreign = ~((cell_r == own[q]) & (block == at[q]))
                q, cell_r, block = q[foreign], cell_r[foreign], block[foreign]
                take = np.concatenate((row, q))
                yield pd.DataFrame({
                    "cell": np.concatenate((own, cell_r)).astype(np.int32), "block": np.concatenate((at, block)).astype(np.int32),
                    "role": np.concatenate((np.zeros(len(row)), np.ones(len(q)))).astype(np.int32), "id": ids[take], "vec": part["vec"].to_numpy()[take],
                })

    return vectors.mapInPandas(run, _ROUTED)


def hash_id(text: str) -> int:
    """A hash that is the same in every process."""
    import zlib

    return zlib.crc32(text.encode())


class _Block:
    """One-bit codes of a block's vectors, and the search over them."""

    def __init__(self, ids: np.ndarray, X: np.ndarray, rotation: np.ndarray):
        self.ids, self.X, self.rotation = ids, X, rotation
        self.order = np.argsort(np.argsort(ids))  # rank of each id, for ties
        d = X.shape[1]
        self.centre = X.mean(axis=0)
        R = (X - self.centre) @ rotation
        self.norm = np.linalg.norm(R, axis=1)
        self.codes = np.packbits(R > 0, axis=1)  # a bit for each dimension
        unit = R / np.maximum(self.norm, 1e-9)[:, None]
        # correction scalar: inner product of a unit vector and its code
        self.factor = np.maximum(np.abs(unit).sum(axis=1) / math.sqrt(d), 1e-3)
        self.error = self.norm * np.sqrt(np.maximum(1 - self.factor**2, 0)) / self.factor * EPSILON / math.sqrt(max(d - 1, 1))
        self.shift = X @ self.centre - self.centre @ self.centre
        self.signs = (np.unpackbits(self.codes, axis=1, count=d).astype(np.float32) * 2 - 1) / math.sqrt(d)

    def search(self, ids: np.ndarray, Q: np.ndarray, own: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, row and similarity of the best ``k`` rows of each query; ``own`` are the queries' rows here."""
        n = len(self.X)
        rows, cols, sims = [], [], []
        step = max(1, 1_000_000 // max(n, 1))
        rounding = np.float32(2 * self.X.shape[1] * np.finfo(np.float32).eps)  # of two inner products of unit vectors
        for lo in range(0, len(Q), step):
            q = Q[lo : lo + step]
            centred = (q - self.centre) @ self.rotation
            estimate = (centred @ self.signs.T) * (self.norm / self.factor) + (q @ self.centre)[:, None] + self.shift
            slack = np.linalg.norm(centred, axis=1)[:, None] * self.error
            if own is not None:
                estimate[np.arange(len(q)), own[lo : lo + step]] = -np.inf
            if n > k + 1:
                sure = np.partition(estimate - slack, n - k, axis=1)[:, n - k]  # the k-th best lower bound
                # of what reaches it, only what single precision can't tell from the k-th best or better
                near = q @ self.X.T
                near[estimate + slack < sure[:, None]] = -np.inf
                r, c = np.nonzero(near >= np.partition(near, n - k, axis=1)[:, n - k, None] - rounding)
            else:
                r, c = np.nonzero(estimate > -np.inf)
            exact = np.einsum("ij,ij->i", q[r].astype(np.float64), self.X[c].astype(np.float64))
            order = np.lexsort((self.order[c], -exact, r))
            r, c, exact = r[order], c[order], exact[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r, "left")
            best = rank < k
            rows.append(r[best] + lo)
            cols.append(c[best])
            sims.append(exact[best])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, int)
        return cat(rows), cat(cols), cat(sims)


_FOUND = "id string, near array<string>, sims array<double>"


def _search(routed: DataFrame, cells, k: int) -> DataFrame:
    """Best ``k`` of each block for each of its queries. A block's rows come before its queries; queries stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rotation = cells.value.rotation
        key, held, block = None, [], None

        def answers(ids, Q, own) -> pd.DataFrame:
            r, c, s = block.search(ids, Q, own, k)
            near = block.ids[c]
            cuts = np.flatnonzero(np.diff(r)) + 1
            if not len(r):
                return pd.DataFrame({"id": pd.Series(dtype=str), "near": pd.Series(dtype=object), "sims": pd.Series(dtype=object)})
            return pd.DataFrame({"id": ids[r[np.concatenate(([0], cuts))]], "near": np.split(near, cuts), "sims": np.split(s, cuts)})

        def close() -> Iterator[pd.DataFrame]:
            nonlocal block, held
            if block is None and held:
                ids = np.concatenate([h[0] for h in held])
                X = np.concatenate([h[1] for h in held])
                block, held = _Block(ids, X, rotation), []
                for lo in range(0, len(ids), 2048):
                    yield answers(ids[lo : lo + 2048], X[lo : lo + 2048], np.arange(lo, min(lo + 2048, len(ids))))

        for pdf in batches:
            if pdf.empty:
                continue
            cell, blk, role = (pdf[c].to_numpy() for c in ("cell", "block", "role"))
            X = np.frombuffer(b"".join(pdf["vec"]), dtype="<f4").reshape(len(pdf), -1)
            ids = pdf["id"].to_numpy()
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(blk) != 0) | (np.diff(role) != 0)) + 1
            for lo, hi in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(pdf)]))):
                if (cell[lo], blk[lo]) != key:
                    yield from close()
                    key, held, block = (cell[lo], blk[lo]), [], None
                if role[lo] == 0:
                    held.append((ids[lo:hi], X[lo:hi]))
                else:
                    yield from close()
                    if block is not None:
                        for at in range(lo, hi, 2048):
                            yield answers(ids[at : min(at + 2048, hi)], X[at : min(at + 2048, hi)], None)
        yield from close()

    return routed.mapInPandas(run, _FOUND)


def usable(vectors: DataFrame, id_column: str, vec_column: str, dimension: int) -> DataFrame:
    """``id, vec``: vectors that are not null, of the right length, finite and not all zero, scaled to unit length."""
    v = F.col(vec_column).cast("array<double>")
    ok = (F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(vec_column).isNotNull()).where(ok).select(F.col(id_column).cast("string").alias("id"), F.col(vec_column).alias("v"))

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            X = (X / np.linalg.norm(X, axis=1, keepdims=True)).astype("<f4")
            yield pd.DataFrame({"id": pdf["id"], "vec": [x.tobytes() for x in X]})

    return rows.mapInPandas(unit, "id string, vec binary")


def nearest(vectors: DataFrame, id_column: str, vec_column: str, dimension: int = 64, k: int = 5, most_lists: int = MOST_LISTS) -> DataFrame:
    """``id, near_id, similarity``: the ``k`` most similar other vectors of each usable vector.

    Cells are fitted on a bounded sample, in two levels where ``most_lists`` centres are too few for the
    rows, so a cell's rows do not grow with the table; every vector is indexed in its cell and searched for in
    that cell and in those whose border is near. Large cells are spread over blocks. In a block,
    inner products are estimated from one-bit codes of the randomly rotated residuals and their
    correction scalars; only rows whose error bound reaches the k-th best lower bound are compared
    exactly. Ties go to the smaller id. Ids must be unique. Members of a group of more than
    ``MOST_COPIES`` exact copies have its ``k`` first other members as neighbours; only the first
    ``k + 1`` of such a group take part in the search, which changes no one's result.
    """
    spark = vectors.sparkSession
    base = usable(vectors, id_column, vec_column, dimension)
    hashed = base.select("id", F.xxhash64("vec").alias("h1"), F.crc32("vec").alias("h2"))
    counts = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    extra, n_rows = None, seen.rows
    if seen.most > MOST_COPIES:
        keys = materialise(counts.where(F.col("n") > MOST_COPIES).select("h1", "h2"), "copied")
        salted = hashed.join(keys, ["h1", "h2"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(256)))
        few = salted.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
        few = few.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= k + 1).select("h1", "h2", "id", "r")
        few = materialise(few, "first-copies")
        heads = few.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("heads"))
        others = salted.select("id", "h1", "h2").join(few.select("id"), "id", "left_anti").join(heads, ["h1", "h2"])
        extra = others.select("id", F.explode(F.slice("heads", 1, k)).alias("near_id"), F.lit(1.0).alias("similarity"))
        base = base.join(others.select("id"), "id", "left_anti")
    # The rows with the smallest hashes. What passes the bound is little more than the sample, so that not every
    # partition sends that many rows to the driver.
    want = min(FIT_ROWS, max(2000, 40 * (n_rows // LIST_ROWS)))
    share = min(1.0, (1.2 * want + 500) / max(n_rows, 1))
    low = F.lit(min(int(2**64 * share) - 2**63, 2**63 - 1))
    # without hot copies the bound applies before vectors are scaled
    drawn = base if extra is not None else usable(vectors.where(F.xxhash64(F.col(id_column).cast("string")) <= low), id_column, vec_column, dimension)
    sample = drawn.where(F.xxhash64("id") <= low).orderBy(F.xxhash64("id"), "id").limit(want).select("vec").toPandas()
    X = np.frombuffer(b"".join(sample["vec"]), dtype="<f4").reshape(len(sample), -1) if len(sample) else np.zeros((0, dimension), np.float32)
    cells = spark.sparkContext.broadcast(fit_cells(X, n_rows, most_lists=most_lists))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(cells.value.centres) * len(cells.value.residuals) // 64)
    routed = _route(base, cells).repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "role")
    found = _search(routed, cells, k)
    pairs = F.transform(F.flatten(F.collect_list(F.zip_with("near", "sims", lambda i, s: F.struct((-s).alias("d"), i.alias("i"))))), lambda x: x)
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(pairs)), 1, k).alias("best"))
    out = best.select("id", F.explode("best").alias("b")).select("id", F.col("b.i").alias("near_id"), (-F.col("b.d")).alias("similarity"))
    return out if extra is None else out.unionByName(extra)


def neighbour_pairs(vectors: DataFrame, id_column: str, vec_column: str, dimension: int = 64, k: int = 5) -> DataFrame:
    """``id_lo, id_hi``: unordered pairs of which at least one is among the other's ``k`` most similar."""
    near = nearest(vectors, id_column, vec_column, dimension, k)
    return near.select(F.least("id", "near_id").alias("id_lo"), F.greatest("id", "near_id").alias("id_hi")).distinct()
