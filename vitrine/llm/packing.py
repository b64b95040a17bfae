"""Fills containers of fixed capacity with items of varying size, in bounded space.

Each partition keeps WINDOWS containers open. An item goes into the open container that it fills best; if none has room, the fullest is
closed and a new one opened. What is still open at the ends of the partitions is merged: containers of FAN_IN partitions at a time by
best fit in falling order, then those that remain loose of FAN_IN such groups, and so on until one group is left. An item is split only if it alone exceeds the capacity: into full containers and a rest.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.plans.storage import materialize

WINDOWS = 64
FAN_IN = 64
#: A merged container at least this full is final.
FULL = 0.97
MAX_CAPACITIES = 1_000
_ROWS = "pack_name string, capacity bigint, container_id bigint, doc_id bigint, part int, n_tokens bigint, open boolean, task int"


class Window:
    """The open containers of one capacity, ordered by free room."""

    def __init__(self, capacity: int, windows: int, first_id: int) -> None:
        self.capacity, self.windows, self.next = capacity, windows, first_id
        self.free: list[tuple[int, int]] = []  # (room, container), sorted
        self.held: dict[int, list[tuple]] = {}

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, item: tuple, size: int) -> Iterator[tuple[int, tuple, int, bool]]:
        """Yields (container, item, size, open) of what is final; the rest stays held."""
        if size == 0:
            # takes no room, so it needs no holding: it joins the container with the least room, which may close later under its own id
            if not self.free:
                c = self.fresh()
                self.free.append((self.capacity, c))
                self.held[c] = []
            yield self.free[0][1], item, 0, True
            return
        i = bisect_left(self.free, (size, -1))
        if i == len(self.free):
            if len(self.free) >= self.windows:
                _, c = self.free.pop(0)
                for it, s in self.held.pop(c):
                    yield c, it, s, False
            c, room = self.fresh(), self.capacity
            self.held[c] = []
        else:
            room, c = self.free.pop(i)
        self.held[c].append((item, size))
        if room == size:
            for it, s in self.held.pop(c):
                yield c, it, s, False
        else:
            insort(self.free, (room - size, c))

    def rest(self) -> Iterator[tuple[int, tuple, int, bool]]:
        for c, items in self.held.items():
            for it, s in items:
                yield c, it, s, True


def best_fit_falling(sizes: list[tuple[int, int]], capacity: int) -> dict[int, int]:
    """Container of each (size, id), largest first into the fullest with room. The container's id is that of its first item."""
    free: list[tuple[int, int]] = []
    at: dict[int, int] = {}
    for size, i in sorted(sizes, key=lambda x: (-x[0], x[1])):
        j = bisect_left(free, (size, -1))
        if j == len(free):
            at[i], room = i, capacity
        else:
            room, at[i] = free.pop(j)
        insort(free, (room - size, at[i]))
    return at


def pack(sizes: DataFrame, capacities: DataFrame, windows: int = WINDOWS) -> DataFrame:
    """pack_name, container_id, doc_id, part, n_tokens: every item of ``sizes`` (doc_id, n_tokens) once for each row of ``capacities``
    (pack_name, capacity_tokens), in parts numbered from 0 if it exceeds the capacity. Null and negative sizes count as 0 and take no
    room. Capacities that are null or not positive hold nothing and are left out."""
    found = capacities.select("pack_name", F.col("capacity_tokens").cast("bigint")).where(F.col("capacity_tokens") > 0).distinct().limit(MAX_CAPACITIES + 1).collect()
    if len(found) > MAX_CAPACITIES:
        raise ValueError(f"more than {MAX_CAPACITIES} capacities")
    packs = sorted((r[0], r[1]) for r in found)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        open_ = {p: Window(p[1], windows, task << 32) for p in packs}
        cols = ["pack_name", "capacity", "container_id", "doc_id", "part", "n_tokens", "open", "task"]
        frame = lambda rows: pd.DataFrame(rows, columns=cols).astype({"doc_id": "Int64"})
        for b in batches:
            out = []
            docs = [None if d != d or d is None else int(d) for d in b.doc_id]
            for doc, size in zip(docs, b.n_tokens.fillna(0).astype("int64").clip(lower=0)):
                for p, w in open_.items():
                    whole, left = divmod(size, p[1])
                    for k in range(whole):
                        out.append((*p, w.fresh(), doc, k, p[1], False, task))
                    if left or not whole:
                        out += [(*p, c, d, k, s, o, task) for c, (d, k), s, o in w.place((doc, whole), left)]
            yield frame(out)
        yield frame([(*p, c, d, k, s, o, task) for p, w in open_.items() for c, (d, k), s, o in w.rest()])

    placed = materialize(sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("n_tokens").cast("bigint").alias("n_tokens")).mapInPandas(fill, _ROWS), "placed")
    # as many rows as there are partitions times open windows
    left = placed.where("open").groupBy("pack_name", "capacity", "container_id", "task").agg(F.sum("n_tokens").alias("size"))
    level = left.select("pack_name", "capacity", "container_id", F.col("task").cast("bigint").alias("part"), "size")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf.capacity.iloc[0])
        at = best_fit_falling(list(zip(pdf["size"], pdf.container_id)), capacity)
        target = pdf.container_id.map(at)
        filled = pdf["size"].groupby(target.to_numpy()).sum().sort_values(kind="stable")
        # the emptiest go on to the next level, as many as there are windows; the others are final
        loose = set(filled[filled < capacity * FULL].index[:windows])
        return pd.DataFrame({"pack_name": pdf.pack_name, "capacity": capacity, "container_id": pdf.container_id, "target": target, "part": pdf.part, "size": pdf["size"], "loose": [t in loose for t in target]})

    # each level merges FAN_IN parts into one, until one is left; no task takes more than FAN_IN * windows containers
    schema = "pack_name string, capacity bigint, container_id bigint, target bigint, part bigint, size bigint, loose boolean"
    parts = (placed.agg(F.max("task")).first()[0] or 0) + 1
    where = None
    while where is None or parts > 1:
        parts = -(-parts // FAN_IN)
        grouped = level.withColumn("part", F.floor(F.col("part") / FAN_IN))
        merged = materialize(grouped.groupBy("pack_name", "capacity", "part").applyInPandas(merge, schema), "merged")
        step = merged.select("pack_name", "capacity", "container_id", "target")
        if where is None:
            where = step.withColumnRenamed("target", "final")
        else:
            moves = step.select("pack_name", "capacity", F.col("container_id").alias("final"), "target")
            where = where.join(moves, ["pack_name", "capacity", "final"], "left").select("pack_name", "capacity", "container_id", F.coalesce("target", "final").alias("final"))
        level = merged.where("loose").groupBy("pack_name", "capacity", F.col("target").alias("container_id"), "part").agg(F.sum("size").alias("size"))
    closed = placed.where("NOT open").select("pack_name", "container_id", "doc_id", "part", "n_tokens")
    moved = placed.where("open").join(where, ["pack_name", "capacity", "container_id"], "left")
    return closed.unionByName(moved.select("pack_name", F.coalesce("final", "container_id").alias("container_id"), "doc_id", "part", "n_tokens"))
