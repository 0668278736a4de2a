"""Most similar vectors for every vector: p-stable hash tables, multiprobe in their cells, exact cosines of all candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.runtime import drop_staged, staged

#: Rows that a cell aims at, copies counted; a worker holds one cell in memory. Smaller ones are compared whole.
CELL_ROWS, WHOLE_ROWS = 200_000, 2048
#: Cells of a table to which a row goes at most; the disk holds so many copies of the vectors at once.
COPIES = 3
#: Rows of a bucket that the number of fine functions aims at, and perturbed buckets that a row visits.
BUCKET_ROWS, PROBES = 40, 20
#: Tables are planned so that at most this share of the pairs of this cosine never become candidates, at any number of rows.
PLAN_COSINE, MISSED = 0.7, 0.06
#: Microseconds a row: a copy sent to its cell, a fine table, and a thousand candidates. They only choose between plans.
COPY_COST, TABLE_COST, CANDIDATE_COST = 85.0, 10.0, 15.0
#: Vectors of a kind from which the borders of the coarse functions are taken; all are indexed.
SAMPLE = 4096
#: Cosines computed at once.
BLOCK = 1_000_000


def probe_sets(m: int, probes: int) -> list[tuple[int, ...]]:
    """Perturbation sets over the 2m sorted boundary distances, in the order of their expected success."""
    exp = [0.0] * (2 * m + 1)
    for j in range(1, 2 * m + 1):
        if j <= m:
            exp[j] = j * (j + 1) / (4 * (m + 1) * (m + 2))
        else:
            k = 2 * m + 1 - j
            exp[j] = 1 - k / (m + 1) + k * (k + 1) / (4 * (m + 1) * (m + 2))
    sets = [s for n in (1, 2, 3) for s in combinations(range(1, 2 * m + 1), n) if not any(2 * m + 1 - j in s for j in s)]
    return sorted(sets, key=lambda s: sum(exp[j] for j in s))[:probes]


def _pairs_of_plan(m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances from the borders of m functions for 4,000 pairs of vectors of cosine PLAN_COSINE."""
    r = np.random.default_rng(seed)
    x, y = r.standard_normal((2, 4000, m))
    return x, PLAN_COSINE * x + math.sqrt(1 - PLAN_COSINE**2) * y


def probed_cells(cell: np.ndarray, margin: np.ndarray, copies: int) -> np.ndarray:
    """(n, copies): the cell of every row and those across its nearest borders, by squared distances, the likeliest first."""
    n, m = margin.shape
    copies = min(copies, 1 << m)
    if copies == 1:
        return cell[:, None]
    # a set with a border beyond the nearest ``copies`` - 1 comes after as many sets that it holds or that are nearer
    w = min(m, copies - 1)
    near = np.argsort(np.abs(margin), axis=1)[:, :w]
    cost = np.take_along_axis(margin, near, axis=1) ** 2
    flips = np.int64(1) << near.astype(np.int64)
    sets = np.array([[s >> j & 1 for j in range(w)] for s in range(1 << w)], dtype=np.int64)
    order = np.argsort(cost @ sets.T, axis=1, kind="stable")[:, :copies]
    return cell[:, None] ^ np.take_along_axis(flips @ sets.T, order, axis=1)


@lru_cache(maxsize=None)
def shared_cells(coarse: int, copies: int) -> np.ndarray:
    """Shares of the planned pairs that have 0, 1, 2, ... cells of a table in common."""
    bits = np.int64(1) << np.arange(coarse, dtype=np.int64)
    a, b = (probed_cells((p > 0) @ bits if coarse else np.zeros(len(p), np.int64), p, copies) for p in _pairs_of_plan(coarse, 17))
    return np.bincount((a[:, :, None] == b[:, None, :]).sum(axis=(1, 2)), minlength=copies + 1) / len(a)


@lru_cache(maxsize=None)
def meeting(m: int) -> float:
    """Share of the planned pairs of which one visits the bucket of the other in a fine table of m functions."""
    sets = [sum(1 << (j - 1) for j in s) for s in fine_sets(m)]
    x, y = _pairs_of_plan(m, 19)
    apart = (x > 0) != (y > 0)
    met = np.zeros(len(x), bool)
    for p in (x, y):
        rank = np.argsort(np.argsort(np.abs(p), axis=1), axis=1)
        met |= np.isin((apart * (np.int64(1) << rank)).sum(axis=1), sets)
    return float(met.mean())


@lru_cache(maxsize=None)
def fine_sets(m: int) -> list[tuple[int, ...]]:
    """The own bucket and the perturbed ones over the m nearer borders; the farther borders lie outside of all vectors."""
    return [(), *[s for s in probe_sets(m, PROBES) if max(s) <= m]]


def functions_of(rows: float) -> int:
    """Fine functions for a cell of so many rows."""
    return max(4, round(math.log2(rows / BUCKET_ROWS)))


def fine_tables(rows: float, reach: float) -> int:
    """Fine tables by which ``reach`` of the planned pairs of a cell become candidates."""
    return max(1, math.ceil(math.log(1 - reach) / math.log(max(1e-9, 1 - meeting(functions_of(rows)))) - 1e-9))


@lru_cache(maxsize=None)
def plan(n: int, off: float = 0.0) -> tuple[int, int, int, float]:
    """(coarse functions, copies, tables, reach in a cell) of the least cost by which all but MISSED planned pairs are candidates.

    More rows make more cells, which part more pairs; copies in probed cells and further tables make up for that, so the
    share found does not fall with the rows. A cell holds at most about CELL_ROWS; the share ``off`` of vectors off the grid
    takes four more bytes a number, so a cell holds less, and where they are many a table has a copy less.
    """
    best = None
    most, most_copies = CELL_ROWS / (1 + 4 * off), COPIES - (off > 0.2)
    least = max(0, math.ceil(math.log2(max(1.0, n / most))))
    for coarse in range(least, least + 4 if least else 1):
        for copies in range(1, min(most_copies, max(1, (1 << coarse) - 1)) + 1):
            rows = n * copies / (1 << coarse)
            if rows > most:
                continue
            shares = shared_cells(coarse, copies)
            tried = set()
            for reach in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1 - MISSED):
                whole = rows <= WHOLE_ROWS
                fine = 1 if whole else fine_tables(rows, reach)
                if fine in tried:
                    continue
                tried.add(fine)
                real = 1 - 1e-9 if whole else 1 - (1 - meeting(functions_of(rows))) ** fine
                never = float((shares * (1 - real) ** np.arange(len(shares))).sum())
                tables = max(1, math.ceil(math.log(MISSED) / math.log(never) - 1e-9))
                seen = rows if whole else rows * (len(fine_sets(functions_of(rows)))) / (1 << functions_of(rows))
                cost = copies * tables * (COPY_COST + fine * (TABLE_COST + CANDIDATE_COST * seen / 1000))
                if best is None or cost < best[0]:
                    best = (cost, (coarse, copies, tables, min(real, 1 - 1e-9)))
    return best[1]


class Hashes:
    """The random functions of all tables, drawn from a fixed seed; ``dim`` numbers each.

    A coarse function floor((a v + b) / w) has bins so wide that two hold all vectors, and its b puts the border between
    them at the median over ``sample``, so cells are of like size at every number of rows.
    """

    def __init__(self, dim: int, tables: int, coarse: int, sample: np.ndarray | None = None, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.tables, self.coarse = tables, coarse
        self.a = r.standard_normal((dim, tables * coarse)).astype(np.float32)
        self.median = np.median(sample @ self.a, axis=0).astype(np.float32) if sample is not None and len(sample) else np.zeros(tables * coarse, np.float32)

    def apply(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells n, distances n x coarse from the borders) of table ``t``."""
        at = slice(t * self.coarse, (t + 1) * self.coarse)
        margin = x @ self.a[:, at] - self.median[at]
        return (margin > 0) @ (np.int64(1) << np.arange(self.coarse, dtype=np.int64)) if self.coarse else np.zeros(len(x), np.int64), margin


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(n, -1) if n else np.zeros((0, 1), np.float32)


def usable_vectors(df: DataFrame, kind: str, id_col: str, vec_col: str) -> DataFrame:
    """(kind, id, v): rows with an id and a vector that is neither null, empty, all zero nor holds null, NaN or infinity."""
    v = F.col(vec_col).cast("array<float>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30)) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.lit(kind).alias("kind"), F.col(id_col).alias("id"), v.alias("v")).where(ok)


def _units(b: pa.RecordBatch) -> np.ndarray:
    x = _matrix(b.column("v"))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_SALT = np.int64(0x5851F42D4C957F2D)


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes."""
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())


def _bytes(col: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The matrix whose rows are a column of byte strings of one length, without nulls; a view where there is one chunk."""
    n, parts = len(col), []
    for c in col.chunks if isinstance(col, pa.ChunkedArray) else [col]:
        if len(c):
            c = c.cast(pa.large_binary())
            at = np.frombuffer(c.buffers()[1], dtype=np.int64)[c.offset : c.offset + len(c) + 1]
            parts.append(np.frombuffer(c.buffers()[2], dtype=np.uint8)[at[0] : at[-1]])
    flat = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return flat.view(kind).reshape(n, -1) if n else np.zeros((0, 0), kind)


def _hash_rows(h: Hashes, tag: int, t: int, copies: int, reach: float):
    """Each row with the cells of table ``t`` that it goes to; ``reach`` tells their search how much to find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cells = probed_cells(*h.apply(_unpack(b.column("q")), t), copies)
            for cell in cells.T:
                key = cell * _SALT + tag
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column("g"), b.column("q"), b.column("raw"), pa.array(np.full(len(key), reach, np.float32))], ["cell", "g", "q", "raw", "reach"])

    return run


class _Vectors:
    """The vectors of a cell, in one byte a number or, those off the grid, as 32-bit floats."""

    def __init__(self, q: np.ndarray, off: np.ndarray | None = None, raw: np.ndarray | None = None) -> None:
        """``raw``: the vectors, of length 1, of the rows ``off``."""
        self.q, self.raw, self.at = q, raw, None
        self.inv = np.concatenate([1 / np.linalg.norm(q[i : i + 4096].astype(np.float32), axis=1) for i in range(0, len(q), 4096)]).astype(np.float32)
        if off is not None and len(off):
            self.at = np.full(len(q), -1, np.int32)
            self.at[off], self.inv[off] = np.arange(len(off)), 1

    @classmethod
    def of(cls, t: pa.Table) -> _Vectors:
        q = _bytes(t.column("q"), np.int8)
        if "raw" not in t.column_names or t.column("raw").null_count == len(q):
            return cls(q)
        raw = t.column("raw")
        return cls(q, np.flatnonzero(raw.is_valid().to_numpy()), _bytes(raw.drop_null(), np.float32))

    def select(self, rows: np.ndarray) -> _Vectors:
        if self.at is None:
            return _Vectors(self.q[rows])
        at = self.at[rows]
        return _Vectors(self.q[rows], np.flatnonzero(at >= 0), self.raw[at[at >= 0]])

    def __len__(self) -> int:
        return len(self.q)

    def __getitem__(self, rows: np.ndarray | slice) -> np.ndarray:
        """Their vectors; times ``inv`` of length 1."""
        x = self.q[rows].astype(np.float32)
        if self.at is not None:
            at = self.at[rows]
            off = np.flatnonzero(at >= 0)
            if len(off):
                x[off] = self.raw[at[off]]
        return x


class _Best:
    """The k best candidates of every row so far, each once; those that may be among them are held and merged in bulk."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.cos, self.who = k, np.full((n, k), -np.inf, np.float32), np.full((n, k), -1, np.int32)
        self.least, self.held, self.count = np.full(n, -np.inf, np.float32), [], 0

    def first(self, rows: np.ndarray, cos: np.ndarray) -> None:
        """``cos``: rows x rows of rows that have no candidates yet."""
        top = np.argpartition(-cos, self.k - 1, axis=1)[:, : self.k] if len(rows) > self.k else np.broadcast_to(np.arange(len(rows)), cos.shape)
        best = np.take_along_axis(cos, top, axis=1)
        self.cos[rows, : top.shape[1]], self.who[rows, : top.shape[1]] = best, np.where(np.isfinite(best), rows[top], -1)
        self.least[rows] = self.cos[rows].min(axis=1)

    def add(self, rows: np.ndarray, others: np.ndarray, cos: np.ndarray) -> None:
        """``cos``: rows x others, candidates of each other; a pair may come more than once."""
        for by_row in (True, False):
            at = np.flatnonzero(cos > (self.least[rows][:, None] if by_row else self.least[others]))
            i, j = np.divmod(at.astype(np.int32), np.int32(len(others)))
            self.held.append((rows[i], others[j], cos.reshape(-1)[at]) if by_row else (others[j], rows[i], cos.reshape(-1)[at]))
            self.count += len(at)
        if self.count > 4 * len(self.least):
            self.merge()

    def merge(self) -> None:
        if not self.count:
            return
        a, b, c = (np.concatenate(z) for z in zip(*self.held, strict=True))
        self.held, self.count = [], 0
        new = np.flatnonzero((c > self.least[a]) & (self.who[a] != b[:, None]).all(axis=1))
        _, once = np.unique(a[new].astype(np.int64) << 32 | b[new], return_index=True)
        new = new[once]
        a, b, c = a[new], b[new], c[new]
        rows = np.unique(a)
        a = np.concatenate([a, np.repeat(rows, self.k)])
        b, c = np.concatenate([b, self.who[rows].reshape(-1)]), np.concatenate([c, self.cos[rows].reshape(-1)])
        o = np.lexsort((-c, a))
        begin = np.flatnonzero(np.diff(a[o], prepend=-1))
        top = o[begin[:, None] + np.arange(self.k)]
        self.cos[rows], self.who[rows] = c[top], b[top]
        self.least[rows] = self.cos[rows, -1]


def _fine_table(q: _Vectors, m: int, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(buckets n, distances n x m from the borders) by m p-stable functions of two bins, divided at the cell's medians."""
    a = r.standard_normal((q.q.shape[1], m)).astype(np.float32)
    p = np.concatenate([q[i : i + 4096] @ a for i in range(0, len(q), 4096)]) * q.inv[:, None]
    p -= np.median(p[:: max(1, len(p) // SAMPLE)], axis=0)
    return (p > 0) @ (np.int32(1) << np.arange(m, dtype=np.int32)), np.abs(p)


def search_cell(g: np.ndarray, q: _Vectors, k: int, reach: float = 1 - MISSED, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cosine): the k best of all candidates of every row of one cell, by exact cosines.

    ``g``: keys of vectors (equal vectors are one row), ``q``: their vectors. In each of the fine tables
    every row visits its own and its perturbed buckets; visitor and visited are candidates of each other. A cell of few
    rows is compared whole, and so is a row that has fewer than k candidates.
    """
    uniq, first = np.unique(g, return_index=True)
    if len(uniq) < len(g):
        g, q = uniq, q.select(first)
    n = len(g)
    if n < 2:
        return g[:0], g[:0], np.zeros(0, np.float32)
    inv = q.inv
    best = _Best(n, k)
    if n > WHOLE_ROWS:
        r, m = np.random.default_rng(seed), functions_of(n)
        for i in range(fine_tables(n, reach)):
            _visit(q, *_fine_table(q, m, r), best, i == 0)
    few = np.flatnonzero(~np.isfinite(best.least))
    for i in range(0, len(few), 256):
        own = few[i : i + 256]
        x = q[own]
        for r in range(0, n, 4096):
            part = np.arange(r, min(n, r + 4096))
            cos = (x @ q[part].T) * (inv[own][:, None] * inv[part])
            here = np.flatnonzero((own >= r) & (own < r + 4096))
            cos[here, own[here] - r] = -np.inf
            best.add(own, part, cos)
            best.merge()
    a, c = np.repeat(np.arange(n), k), best.cos.reshape(-1)
    keep = np.isfinite(c)
    return g[a[keep]], g[best.who.reshape(-1)[keep]], c[keep]


def _visit(q: _Vectors, key: np.ndarray, margin: np.ndarray, best: _Best, first: bool) -> None:
    """Compare the rows of each bucket with each other, then with all others that visit it."""
    (n, m), inv = margin.shape, q.inv
    short = np.uint16 if m <= 16 else np.int32  # numbers of 16 bits are sorted by radix
    by = np.argsort(key.astype(short), kind="stable").astype(np.int32)
    start = np.append(0, np.cumsum(np.bincount(key, minlength=1 << m)))
    flips = np.int32(1) << np.argsort(margin, axis=1).astype(np.int32)
    at = np.concatenate([key ^ sum(flips[:, j - 1] for j in s) for s in fine_sets(m)[1:]])
    who = (np.argsort(at.astype(short), kind="stable") % n).astype(np.int32)
    edges = np.append(0, np.cumsum(np.bincount(at, minlength=1 << m)))
    full = np.flatnonzero(np.diff(start))
    for visits in (False, True):
        for bucket in full:
            rows = by[start[bucket] : start[bucket + 1]]
            others = who[edges[bucket] : edges[bucket + 1]] if visits else rows
            if first and not visits and len(rows) <= 1024:
                x = q[rows]
                cos = (x @ x.T) * (inv[rows][:, None] * inv[rows])
                np.fill_diagonal(cos, -np.inf)
                best.first(rows, cos)
                continue
            for r in range(0, len(rows), 4096):
                part = rows[r : r + 4096]
                x, width = q[part].T, max(1, BLOCK // len(part))
                for v in range(0, len(others), width):
                    own = others[v : v + width]
                    cos = (q[own] @ x) * (inv[own][:, None] * inv[part])
                    if not visits:
                        cos[own[:, None] == part] = -np.inf
                    best.add(own, part, cos)
    best.merge()


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """All consecutive rows of equal keys from sorted batches, over the borders of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k) for k in keys]
        vals = [c.to_numpy(zero_copy_only=False) for c in cols]
        change = np.zeros(b.num_rows, dtype=bool)
        for v in vals:
            change[1:] |= v[1:] != v[:-1]
        now = tuple(v[0] for v in vals)
        change[0] = last is not None and now != last
        at = 0
        for c in np.flatnonzero(change).tolist() + [b.num_rows]:
            if c in (0,) and not change[0]:
                continue
            if c > at:
                held.append(b.slice(at, c - at))
            if c < b.num_rows and held:
                run, held = [pa.Table.from_batches(held)], []
                yield run.pop()  # the search of a large cell should be all that holds its batches
            at = c
        last = tuple(v[-1] for v in vals)
    if held:
        yield pa.Table.from_batches(held)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["cell"]):
            if t.num_rows < 2:
                continue
            reach = t.column("reach")[0].as_py() if "reach" in t.column_names else 1 - MISSED
            # functions differ from cell to cell, so a pair with two cells in common has independent chances
            seed = int(t.column("cell")[0].as_py()) & (2**63 - 1)
            g, q = t.column("g").to_numpy(), _Vectors.of(t)
            del t  # the batches, whose vectors are now in q
            a, b, c = search_cell(g, q, k, reach, seed)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c, pa.float32())], ["a", "b", "cosine"])

    return run


def quantised(x: np.ndarray) -> np.ndarray:
    """Vectors in one byte a number, each on the grid of 64 to 127 steps that fits it best (vectors on a grid: exactly)."""
    y = x / np.abs(x).max(axis=1, keepdims=True)
    # the three best scales by every fourth number, then the best of them by all
    part, errors = y[:, ::4], np.empty((64, len(x)), np.float32)
    for i in range(64):
        z = part * np.float32(127 - i)
        z -= np.rint(z)
        errors[i] = np.einsum("ij,ij->i", z, z) / (127 - i) ** 2
    best, scale = np.full(len(x), np.inf, np.float32), np.full(len(x), 127, np.float32)
    for i in np.sort(np.argpartition(errors, 2, axis=0)[:3], axis=0):
        by = (127 - i).astype(np.float32)
        z = y * by[:, None]
        z -= np.rint(z)
        e = np.einsum("ij,ij->i", z, z) / (by * by)
        better = e < 0.9 * best
        best[better], scale[better] = e[better], by[better]
    return np.rint(y * scale[:, None]).astype(np.int8)


#: Rounding of 32-bit floats, in steps of the grid.
ON_GRID = 1e-3


def off_grid(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows whose one-byte form is not the vector itself, but for the rounding of floats."""
    top = np.abs(x).argmax(axis=1)[:, None]
    step = np.take_along_axis(x, top, axis=1) / np.take_along_axis(q, top, axis=1)
    return (np.abs(x / step - q) > ON_GRID).any(axis=1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x = _units(b)
            q = quantised(x)
            off = off_grid(x, q)
            raw = pa.array([v.tobytes() if o else None for v, o in zip(x, off, strict=True)], pa.binary()) if off.any() else pa.nulls(len(x), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("kind"), b.column("id"), _binary(q), raw, pa.array(off)], ["g", "kind", "id", "q", "raw", "off"])


def _unpack(q: pa.Array) -> np.ndarray:
    x = _bytes(q, np.int8).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(vectors: DataFrame, k: int = 5, tables: int | None = None) -> DataFrame:
    """(kind, id, neighbour, cosine): for each id of each kind its k most similar others, nearly always all of them.

    ``vectors`` is the result of :func:`usable_vectors` (or a union of such). Only vectors of one length can be compared: a
    kind's most frequent length counts (of equally frequent ones the greater), rows of other lengths have no neighbours.
    Ids of equal vectors are each other's neighbours, smaller ids first. Repeats of an id count once. ``tables``: of each
    kind, in place of the planned number; more find more and cost more.

    1. Each vector goes, in one byte a number (one that this would change takes its 32-bit floats along), to its cell of a table and to the probed ones across its nearest borders
       (coarse p-stable functions; their number grows with the logarithm of the rows, so cells do not). What more cells
       part, more copies and tables bring together (:func:`plan`), so the share found stays with more rows, at more cost.
    2. A cell is searched whole: in each of its fine tables a row visits its own and its perturbed buckets in the order of
       estimated success. All it meets there are candidates, and the exact cosine of each is computed.
    3. The merged candidates are ranked by these exact cosines. The k best of a cell hold all of that cell that may be
       among the k best of the merged candidates, so only these are merged. Tables are searched one after the other, so that the disk holds the vectors and their copies of one
       table at most; the result is a written table, and what led to it is deleted.
    """
    spark = vectors.sparkSession
    vectors = vectors.withColumn("g", F.xxhash64("kind", "v"))
    lengths = vectors.groupBy("kind", F.size("v").alias("dim")).count().groupBy("kind").agg(F.max(F.struct("count", "dim")).alias("m"))
    sizes = {r["kind"]: (r["m"]["count"], r["m"]["dim"]) for r in lengths.collect()}
    if not sizes:
        return spark.createDataFrame([], "kind string, id string, neighbour string, cosine double")
    fits = None
    for kind, (_, dim) in sizes.items():
        one = (F.col("kind") == kind) & (F.size("v") == dim)
        fits = one if fits is None else fits | one
    packed = staged(vectors.where(fits).mapInArrow(_pack, "g long, kind string, id string, q binary, raw binary, off boolean"), "packed")
    hashes, plans = {}, {}
    off = {r["kind"]: r["off"] for r in packed.groupBy("kind").agg(F.avg(F.col("off").cast("double")).alias("off")).collect()}
    for kind, (n, dim) in sizes.items():
        coarse, copies, planned, reach = plan(n, math.ceil(off[kind] * 20 - 0.5) / 20)
        plans[kind] = copies, reach
        some = packed.where(F.col("kind") == kind).orderBy(F.xxhash64("g"), "id").limit(SAMPLE).select("q").toArrow()
        hashes[kind] = Hashes(dim, tables or planned, coarse, _unpack(some.column("q")))
    met = None
    for t in range(max(h.tables for h in hashes.values())):
        rows = None
        for tag, kind in enumerate(sorted(sizes)):
            if t >= hashes[kind].tables:
                continue
            part = packed.where(F.col("kind") == kind).select("g", "q", "raw").mapInArrow(_hash_rows(hashes[kind], tag, t, *plans[kind]), "cell long, g long, q binary, raw binary, reach float")
            rows = part if rows is None else rows.unionByName(part)
        part = staged(rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_search(k), "a long, b long, cosine float"), "best")
        # merged after every table, so that the disk never holds the candidates of many; one shuffle by a serves the
        # removal of repeats and the choice, and a hub's many candidates are never gathered
        found = (part if met is None else met.unionByName(part)).repartition("a").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
        merged = staged(found.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("r") <= k).drop("r"), "met")
        for done in (part, met):
            if done is not None:
                drop_staged(done)
        met = merged
    member = packed.select("g", "kind", "id").repartition("g").distinct()
    # of equal vectors, only the k + 1 smallest ids can be among the k best of another
    nb = member.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("id"))).where(F.col("r") <= k + 1)
    nb = nb.select(F.col("g").alias("b"), F.col("id").alias("neighbour"))
    twins = member.groupBy("g").count().where("count > 1").select(F.col("g").alias("a"), F.col("g").alias("b"), F.lit(1.0).cast("float").alias("cosine"))
    out = met.unionByName(twins).join(nb, "b").withColumnRenamed("a", "g").select("g", "neighbour", "cosine").join(member, "g").where("id <> neighbour")
    out = out.repartition("kind", "id").groupBy("kind", "id", "neighbour").agg(F.max("cosine").cast("double").alias("cosine"))
    near = staged(out.withColumn("r", F.row_number().over(Window.partitionBy("kind", "id").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("r") <= k).drop("r"), "near")
    drop_staged(packed)
    drop_staged(met)
    return near


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(kind, id_a, id_b), id_a < id_b, without repeats."""
    return near.select("kind", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
