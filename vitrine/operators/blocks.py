"""Exact nearest neighbours against blocks of items that lie once in the shared folder.

Items are numbered in the order of their identifiers and written in blocks. A task holds some queries and goes through all blocks,
with the k best of each query so far and the score that a further item must reach. So neither queries nor items are copied, and nothing but
the result leaves a task. Products are screened in single precision, with the error that it can have, and what passes is scored in double.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.plans.storage import write_parts

#: Queries that one task holds at once; items and queries of one multiplication.
QUERIES, ITEMS_AT, QUERIES_AT = 8_192, 4_096, 256
#: Scores are rounded to so many digits before they are compared, so that sums in another order rank alike.
DIGITS = 9


def rounded(x: np.ndarray) -> np.ndarray:
    scale = 10.0**DIGITS
    return np.copysign(np.floor(np.abs(x) * scale + 0.5), x) / scale + 0.0


@dataclass
class Items:
    """Blocks of items in a folder: positions in a block, the blocks that there are, the length of a vector."""

    folder: str
    size: int
    blocks: list[int]
    dim: int

    def read(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(pos ascending, vectors) of a block."""
        row = self._row(block, ["pos", "vec"])
        return np.frombuffer(row["pos"][0], np.int64), np.frombuffer(row["vec"][0], np.float64).reshape(-1, self.dim)

    def ids(self, pos: np.ndarray) -> np.ndarray:
        """The identifiers of items by position."""
        out = np.empty(len(pos), object)
        for block in np.unique(pos // self.size):
            row, mine = self._row(int(block), ["pos", "ids"]), pos // self.size == block
            out[mine] = np.array([*row["ids"][0], None], object)[np.searchsorted(np.frombuffer(row["pos"][0], np.int64), pos[mine])]
        return out

    def _row(self, block: int, columns: list[str]) -> dict:
        files, path = pyarrow.fs.FileSystem.from_uri(self.folder)
        return pyarrow.parquet.read_table(f"{path}/block={block}", filesystem=files, columns=columns, partitioning=None).to_pydict()


def write_items(numbered: DataFrame, item: str, size: int, vector: str = "v") -> Items:
    """Items with a distinct position ``pos`` in the order of the identifiers, written in blocks."""
    kind = numbered.schema[item].dataType.simpleString()

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        vec = np.stack(pdf[vector].to_numpy()).astype(np.float64)
        return pd.DataFrame({"block": pdf.block.iloc[:1].to_numpy(), "pos": [pdf.pos.to_numpy(np.int64).tobytes()], "ids": [pdf[item].tolist()], "vec": [vec.tobytes()]})

    rows = numbered.select(item, F.col(vector).cast("array<double>").alias(vector), "pos", F.floor(F.col("pos") / size).cast("int").alias("block"))
    folder = write_parts(rows.groupBy("block").applyInPandas(gather, f"block int, pos binary, ids array<{kind}>, vec binary"), "block", "items")
    files, path = pyarrow.fs.FileSystem.from_uri(folder)
    held = files.get_file_info(pyarrow.fs.FileSelector(path))
    blocks = sorted(int(f.base_name[6:]) for f in held if f.base_name.startswith("block="))
    out = Items(folder, size, blocks, 0)
    out.dim = len(out._row(blocks[0], ["vec"])["vec"][0]) // len(out._row(blocks[0], ["pos"])["pos"][0]) if blocks else 0
    return out


@dataclass
class Pairs:
    """Rows of queries with positions of items, in the order of the positions."""

    rows: np.ndarray
    pos: np.ndarray

    @classmethod
    def of(cls, lists: Sequence) -> Pairs:
        flat = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in lists]
        rows, pos = np.repeat(np.arange(len(flat)), [len(x) for x in flat]), np.concatenate([np.zeros(0, np.int64), *flat])
        order = np.argsort(pos, kind="stable")
        return cls(rows[order], pos[order])

    def within(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, index in pos) of the pairs whose position is in pos (ascending)."""
        lo, hi = np.searchsorted(self.pos, [pos[0], pos[-1] + 1])
        at = np.searchsorted(pos, self.pos[lo:hi])
        there = pos[at] == self.pos[lo:hi]
        return self.rows[lo:hi][there], at[there]


def _where(flags: np.ndarray) -> np.ndarray:
    """The flat indices of the true among flags that are nearly all false: by eight at once."""
    flat = flags.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    return at[flat[at]]


class Best:
    """The k best items of each query among those added; equal scores by position. Items must be added in the order of their positions."""

    def __init__(self, x: np.ndarray, k: int) -> None:
        self.x, self.x32, self.k = x, x.astype(np.float32), k
        self.norm = np.linalg.norm(x, axis=1)
        self.bar = np.full(len(x), np.finfo(np.float32).min, np.float32)
        self.kth = np.full(len(x), -np.inf)
        self.n = np.zeros(len(x), np.int64)
        self.score, self.pos = np.full((len(x), 2 * k + 16), -np.inf), np.zeros((len(x), 2 * k + 16), np.int64)
        self.largest = 0.0

    def add(self, pos: np.ndarray, y: np.ndarray, out: tuple[np.ndarray, np.ndarray]) -> None:
        """Adds items but for the pairs of queries and items in ``out``."""
        # an error bound of single precision, and twice what rounding moves
        self.largest = max(self.largest, float(np.linalg.norm(y, axis=1).max()))
        self.error = self.norm * self.largest * (y.shape[1] + 4) * 2.0**-23 + 2 * 10.0**-DIGITS + 1e-30
        for c0 in range(0, len(y), ITEMS_AT):
            part, part32 = y[c0 : c0 + ITEMS_AT], y[c0 : c0 + ITEMS_AT].astype(np.float32)
            mine = (out[1] >= c0) & (out[1] < c0 + ITEMS_AT)
            rows, cols = out[0][mine], out[1][mine] - c0
            order = np.argsort(rows, kind="stable")
            rows, cols = rows[order], cols[order]
            edge = np.searchsorted(rows, np.arange(0, len(self.x) + QUERIES_AT, QUERIES_AT))
            for i, r0 in enumerate(range(0, len(self.x), QUERIES_AT)):
                s = self.x32[r0 : r0 + QUERIES_AT] @ part32.T
                s[rows[edge[i] : edge[i + 1]] - r0, cols[edge[i] : edge[i + 1]]] = -np.inf
                self._take(r0, s, pos[c0 : c0 + ITEMS_AT], part)

    def _take(self, r0: int, s: np.ndarray, pos: np.ndarray, y: np.ndarray) -> None:
        r1 = r0 + len(s)
        bar = np.maximum(self.bar[r0:r1], self._below(r0, r1, self.kth[r0:r1]))
        new = self.n[r0:r1] == 0
        if s.shape[1] > self.k and new.any():
            # the k-th best of the first items is a first bar
            least = np.partition(s[new], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            bar[new] = np.maximum(bar[new], self._below(r0, r1, least.astype(np.float64), new, 2))
            self.bar[r0:r1] = bar
        r, c = np.divmod(_where(s >= bar[:, None]), s.shape[1])
        if not len(r):
            return
        exact = rounded(np.einsum("nd,nd->n", self.x[r0 + r], y[c]))
        count = np.bincount(r, minlength=r1 - r0)
        if (self.n[r0:r1] + count).max() > self.score.shape[1]:
            self._compact(r0, r1)
            if (more := int((self.n[r0:r1] + count).max() - self.score.shape[1])) > 0:
                self.score = np.pad(self.score, ((0, 0), (0, more)), constant_values=-np.inf)
                self.pos = np.pad(self.pos, ((0, 0), (0, more)))
        at = self.n[r0 + r] + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        self.score[r0 + r, at], self.pos[r0 + r, at] = exact, pos[c]
        self.n[r0:r1] += count

    def _below(self, r0: int, r1: int, kth: np.ndarray, which: np.ndarray | slice = slice(None), times: int = 1) -> np.ndarray:
        """What the single-precision score of an item of score kth reaches at least."""
        return np.maximum(kth - times * self.error[r0:r1][which], np.finfo(np.float32).min).astype(np.float32)

    def _compact(self, r0: int, r1: int) -> None:
        w = int(self.n[r0:r1].max(initial=0))
        if w <= self.k:
            return
        score, pos = self.score[r0:r1, :w], self.pos[r0:r1, :w]
        kth = np.partition(score, w - self.k, axis=1)[:, w - self.k]
        above, level = score > kth[:, None], score == kth[:, None]
        keep = (above | (level & (np.cumsum(level, axis=1) <= self.k - above.sum(1)[:, None]))) & (score > -np.inf)
        r, c = np.nonzero(keep)
        n = keep.sum(1)
        at = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
        kept = score[r, c], pos[r, c]
        self.score[r0:r1] = -np.inf
        self.score[r0 + r, at], self.pos[r0 + r, at] = kept
        self.n[r0:r1] = n
        self.kth[r0:r1] = np.maximum(self.kth[r0:r1], kth)

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, pos, score, rank from 1) of the k best of each query, in this order of queries and ranks."""
        for r0 in range(0, len(self.x), QUERIES_AT):
            self._compact(r0, min(r0 + QUERIES_AT, len(self.x)))
        row = np.repeat(np.arange(len(self.x)), self.n)
        held = np.arange(self.score.shape[1]) < self.n[:, None]
        pos, score = self.pos[held], self.score[held]
        order = np.lexsort((pos, -score, row))
        first = np.cumsum(self.n) - self.n
        return row, pos[order], score[order], np.arange(len(row)) - np.repeat(first, self.n) + 1


def search(items: Items, tops: Sequence[tuple[Best, slice]], seen: Pairs) -> None:
    """Adds all items to each of tops, by the slice of the vectors that it scores, without the seen pairs."""
    for block in items.blocks:
        pos, y = items.read(block)
        out = seen.within(pos)
        for best, cols in tops:
            best.add(pos, np.ascontiguousarray(y[:, cols]), out)


def means(items: Items, seen: Pairs, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, which) of n queries: the unit mean of the vectors of the seen items, and whether there is one of norm 1e-12 or more."""
    total, count = np.zeros((n, items.dim)), np.zeros(n)
    for block in items.blocks:
        pos, y = items.read(block)
        rows, at = seen.within(pos)
        count += np.bincount(rows, minlength=n)
        for d in range(items.dim):
            total[:, d] += np.bincount(rows, y[at, d], n)
    mean = total / np.maximum(count, 1)[:, None]
    norm = np.linalg.norm(mean, axis=1)
    return mean / np.maximum(norm, 1e-12)[:, None], (count > 0) & (norm >= 1e-12)


def batches_of(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """The rows of batches in pieces of n."""
    held: list[pd.DataFrame] = []
    for b in batches:
        while len(b):
            take = n - sum(map(len, held))
            held.append(b.iloc[:take])
            b = b.iloc[take:]
            if sum(map(len, held)) == n:
                yield pd.concat(held, ignore_index=True)
                held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def spread(queries: DataFrame, key: str) -> DataFrame:
    """The queries in as many partitions as give each task at most about QUERIES."""
    n = max(1, -(-queries.count() // QUERIES))
    return queries.repartition(max(n, min(queries.sparkSession.sparkContext.defaultParallelism, -(-n * QUERIES // 1_024))), key)


def fused(query: np.ndarray, item: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, rank) by the sum of the parts of each query and item, ties by item."""
    order = np.lexsort((item, query))
    query, item, part = query[order], item[order], part[order]
    first = np.nonzero((np.diff(query, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0))[0]
    if not len(first):
        return query, item, query
    query, item, score = query[first], item[first], rounded(np.add.reduceat(part, first))
    order = np.lexsort((item, -score, query))
    query, item = query[order], item[order]
    return query, item, np.arange(len(query)) - np.searchsorted(query, query) + 1


def weighted(channels: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray, float]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fusion.weighted of (query, item, score, weight) of each channel for n queries, renormalised over the channels that a query has."""
    parts, total = [], np.zeros(n)
    for query, item, score, weight in channels:
        lo, hi = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(lo, query, score)
        np.maximum.at(hi, query, score)
        total[np.unique(query)] += weight
        span = (hi - lo)[query] if len(query) else np.zeros(0)
        norm = np.where(span == 0, 1.0, (score - lo[query]) / np.where(span == 0, 1.0, span))
        parts.append((query, item, norm * weight))
    query, item, part = (np.concatenate(c) for c in zip(*parts))
    use = total[query] > 0
    return fused(query[use], item[use], part[use] / total[query[use]])
