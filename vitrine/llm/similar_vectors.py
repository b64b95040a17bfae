"""The k most similar vectors of every vector: inverted file of coarse centroids with product-quantised residuals, asymmetric distance
tables and exact reranking of all that the error of the codes leaves open.

Centroids and codebooks are fitted on a sample of at most SAMPLE vectors; every valid vector is indexed and every valid vector is a query.
Vectors of one direction are one entry of the index; of their products at most the k + 1 first can be in anyone's k nearest, so a hot
group of copies adds no more than that. Lists are gathered to shards of about SHARD entries (a longer list is split by hash over several
shards). A shard meets the queries that ask it in batches of about BLOCK, and each task searches one shard for one batch. Nothing whose
size grows with the data is broadcast or brought to the driver; what is, is bounded by LISTS and SAMPLE, or a number per shard.

Neighbours of cosine SURE or more are found wherever they lie (near_classes): the entries of a list are grouped around leaders, all pairs of
leaders are multiplied, and the members of two leaders only if their radii allow that cosine. Lists are gathered to blocks of about BLOCK
entries, each written once to the shared folder, and a task reads the blocks whose pairs it takes from there: nothing is sent for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs
import pyarrow.parquet
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vitrine.plans.storage import materialize, write_parts

DIM = 64
SAMPLE = 50_000
LISTS = 4_096
PARTS, CODES = 16, 256
SHARD = 32_768
BLOCK = 32_768
AT_ONCE = 256
SEED = 7
SALTS = 16
#: Digits to which cosines count as equal: copies of another length are copies.
DIGITS = 7
#: Neighbours of this cosine or more are found wherever they lie, whatever the number of probes.
SURE = 0.9
#: More than rounding takes from a product of unit vectors of single precision.
SLACK = 1e-5
#: Pairs that are multiplied exactly at a time.
PAIRS = 100_000
#: Entries of a list of this cosine or more to a leader form its group; so many entries are grouped at once.
CLOSE, GROUPED = 0.93, 4_096
#: Small collections are cut into blocks of at least so many entries, and tasks take at least so many pairs of entries.
LEAST_BLOCK, TASK_PAIRS = 1_024, 2_000_000_000
#: Leaders that are multiplied with so many others at a time, entries with as many where most of two leaders' members qualify.
TILE, TILE_ROWS = 4_096, 512


def _spread(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """An inner join on a key that may be most of the rows: facts, few per key, are repeated for each salt."""
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int"))
    return salted.join(facts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_s"]).drop("_s")


def is_valid(e: Column, dim: int = DIM) -> Column:
    """dim finite numbers, not all zero; null and everything else is not valid."""
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(e) == dim) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def directions(vectors: DataFrame, item: str, embedding: str, k: int, dim: int = DIM) -> tuple[DataFrame, DataFrame]:
    """(members, entries). members: item, cid of each valid vector; entries: cid, vec (unit vector, float bytes), n (members), first (the
    k + 1 smallest items). Rows without item are left out; of several vectors of one item the one that sorts first counts."""
    e = F.col(embedding).cast("array<float>")
    rows = vectors.select(F.col(item).cast("string").alias("item"), e.alias("e")).where(F.col("item").isNotNull() & is_valid(F.col("e"), dim))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # the one-element array binds the norm once for all elements
    scaled = F.transform(F.array(F.struct(F.col("e"), norm.alias("n"))), lambda p: F.transform(p["e"], lambda x: (x.cast("double") / p["n"]).cast("float") + F.lit(0.0).cast("float")))
    unit = rows.select("item", F.get(scaled, F.lit(0)).alias("u"))
    once = materialize(unit.groupBy("item").agg(F.min("u").alias("u")), "unit")
    groups = once.groupBy("u").agg(F.min("item").alias("cid"), F.count(F.lit(1)).alias("n"))
    lone = groups.where("n = 1").select("cid", "u", "n", F.array("cid").alias("first"))
    # only copies are ranked; row_number with a limit keeps k + 1 per task before it shuffles
    shared = groups.where("n > 1").select("u", "cid", "n")
    copies = _spread(once, shared, "u")
    top = copies.withColumn("r", F.row_number().over(W.partitionBy("u").orderBy("item"))).where(F.col("r") <= k + 1)
    many = top.groupBy("cid", "u", "n").agg(F.array_sort(F.collect_list("item")).alias("first"))
    members = copies.select("item", "cid").unionByName(groups.where("n = 1").select(F.col("cid").alias("item"), "cid"))
    return members, lone.unionByName(many)


@dataclass
class Codebook:
    """Coarse centroids (lists x dim) and, for each part of a residual, its codes (parts x codes x dim / parts)."""

    centroids: np.ndarray
    codes: np.ndarray


def _means(x: np.ndarray, n: int, rounds: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    """k-means from distinct random rows; an empty cluster keeps its centre."""
    n = min(n, len(x))
    c = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T - 0.5 * (c * c).sum(1)).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        found, start = np.unique(near[order], return_index=True)
        c[found] = np.add.reduceat(x[order], start, axis=0) / np.diff(np.append(start, len(x)))[:, None]
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def fit(sample: np.ndarray, lists: int, parts: int = PARTS, codes: int = CODES, rounds: int = 8, seed: int = SEED) -> Codebook:
    """Fits lists centroids and the codebooks of the residuals on sampled unit vectors."""
    rng = np.random.default_rng(seed)
    c = _means(sample, lists, rounds, rng, True)
    residual = sample - c[nearest(sample, c)]
    d = sample.shape[1] // parts
    books = [_means(np.ascontiguousarray(residual[:, j * d : (j + 1) * d]), codes, rounds, rng, False) for j in range(parts)]
    return Codebook(c, np.stack(books))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 4096] @ centroids.T).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def encode(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """List and codes (bytes) of each vector."""
    at = nearest(x, book.centroids)
    residual = x - book.centroids[at]
    parts, _, d = book.codes.shape
    out = np.empty((len(x), parts), np.uint8)
    for j in range(parts):
        k = book.codes[j]
        out[:, j] = (residual[:, j * d : (j + 1) * d] @ k.T - 0.5 * (k * k).sum(1)).argmax(1)
    return at, out


def search(q: np.ndarray, probes: list[np.ndarray], vec: np.ndarray, lists: np.ndarray, codes: np.ndarray, book: Codebook, k: int, rerank: int, least: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
    """Positions (-1 for none) and cosines of the k best entries of each query of cosine ``least`` or more in its probed lists, equal cosines
    by position.

    Tables of each query with all codes give the asymmetric products; the best ``rerank`` by these are compared exactly. The k-th of them is
    the bar: whatever in the probed lists can reach it by its product plus the error of its code is multiplied out.
    """
    order = np.argsort(lists, kind="stable")
    present, start = np.unique(lists[order], return_index=True)
    stop = np.append(start[1:], len(order))
    slot = {int(l): i for i, l in enumerate(present)}
    parts, n_codes, d = book.codes.shape
    flat = codes[order].astype(np.int32) + np.arange(parts, dtype=np.int32) * n_codes
    coded = book.centroids[lists[order]] + np.concatenate([book.codes[j][codes[order, j]] for j in range(parts)], axis=1)
    best, score = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf)
    rerank = max(k, min(rerank, len(order)))
    exact, ordered = vec.astype(np.float64), vec[order]
    error = np.linalg.norm(ordered - coded, axis=1) + SLACK
    # queries of one list come together, so that few lists are touched at a time
    by_centroid = np.argsort(nearest(q, book.centroids), kind="stable")
    for lo in range(0, len(q), AT_ONCE):
        which = by_centroid[lo : lo + AT_ONCE]
        x = q[which]
        by_list: dict[int, list[int]] = {}
        for i, at in enumerate(which):
            for l in probes[at]:  # noqa: E741
                by_list.setdefault(slot.get(int(l), -1), []).append(i)
        by_list.pop(-1, None)
        bar = np.full(len(x), least - SLACK)
        wanted = np.zeros(len(order), bool)
        if by_list:
            used = sorted(by_list)
            here = np.concatenate([np.arange(start[s], stop[s]) for s in used])
            left = np.concatenate([[0], np.cumsum([stop[s] - start[s] for s in used])])
            table = np.einsum("qpd,pcd->qpc", x.reshape(len(x), parts, d), book.codes, optimize=True).reshape(len(x), parts * n_codes)
            coarse = x @ book.centroids[present[used]].T
            seen = np.full((len(x), len(here)), -np.inf, np.float32)
            for c, s in enumerate(used):
                r = np.asarray(by_list[s])
                f = flat[start[s] : stop[s]]
                t = table[r]
                total = t[:, f[:, 0]]
                for j in range(1, parts):
                    total += t[:, f[:, j]]
                seen[r, left[c] : left[c + 1]] = total + coarse[r, c][:, None]
            top = np.argpartition(-seen, rerank - 1, axis=1)[:, :rerank] if seen.shape[1] > rerank else np.tile(np.arange(seen.shape[1]), (len(x), 1))
            cos = np.einsum("qd,qrd->qr", x.astype(np.float64), exact[order[here[top]]])
            cos[~np.isfinite(np.take_along_axis(seen, top, 1))] = -np.inf
            if cos.shape[1] >= k:
                bar = np.maximum(bar, np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k] - SLACK)
            wanted[here[(seen + error[here].astype(np.float32) >= bar[:, None]).any(0)]] = True
        cols = np.nonzero(wanted)[0]
        if not len(cols):
            continue
        product = x @ ordered[cols].T
        over = product >= bar[:, None]
        many = np.nonzero(over.sum(1) > 4 * k)[0]
        if len(many):
            bar[many] = np.maximum(bar[many], np.partition(product[many], len(cols) - k, axis=1)[:, len(cols) - k] - SLACK)
            over[many] = product[many] >= bar[many][:, None]
        row, col = np.nonzero(over)
        pos = order[cols[col]]
        cos = np.concatenate([np.einsum("nd,nd->n", x[row[i : i + PAIRS]].astype(np.float64), exact[pos[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)] or [np.zeros(0)])
        rank = np.lexsort((pos, -np.round(cos, DIGITS), row))
        row, pos, cos = row[rank], pos[rank], cos[rank]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < k
        best[which[row[kept]], place[kept]] = pos[kept]
        score[which[row[kept]], place[kept]] = cos[kept]
    return best, score


def shards_of(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, split): lists of these sizes are gathered in order to shards of at most ``most`` entries; a longer list is split over several."""
    first, split, shard, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, most
    for i, s in enumerate(sizes):
        if s > most:
            split[i] = -(-s // most)
            shard += room < most
            first[i] = shard
            shard, room = shard + split[i], most
        else:
            if s > room:
                shard, room = shard + 1, most
            first[i], room = shard, room - s
    return first, split


def leaders(x: np.ndarray) -> np.ndarray:
    """For each unit vector the position of its leader, a vector of cosine CLOSE or more or itself."""
    lead = np.full(len(x), -1)
    for lo in range(0, len(x), GROUPED):
        near = x[lo : lo + GROUPED] @ x[lo : lo + GROUPED].T >= CLOSE
        free = np.ones(len(near), bool)
        for i in range(len(near)):
            if free[i]:
                own = near[i] & free
                own[i] = True
                lead[lo + np.nonzero(own)[0]] = lo + i
                free &= ~own
    return lead


@dataclass
class Block:
    """Entries in the order of their groups, of which the first is the leader: start (one more than groups), radius (angle)."""

    cids: np.ndarray
    rank: np.ndarray
    vec: np.ndarray
    start: np.ndarray
    radius: np.ndarray


def read_block(folder: str, block: int, dim: int) -> Block:
    files, path = pyarrow.fs.FileSystem.from_uri(folder)
    if files.get_file_info(f"{path}/block={block}").type == pyarrow.fs.FileType.NotFound:  # no entry's hash fell there
        return Block(np.zeros(0, object), np.zeros(0, np.int64), np.zeros((0, dim), np.float32), np.zeros(1, np.int64), np.zeros(0))
    row = pyarrow.parquet.read_table(f"{path}/block={block}", filesystem=files, columns=["cids", "vec", "start", "radius"]).to_pydict()
    cids = np.array(row["cids"][0], object)
    rank = np.empty(len(cids), np.int64)
    rank[np.argsort(cids, kind="stable")] = np.arange(len(cids))
    return Block(cids, rank, np.frombuffer(row["vec"][0], np.float32).reshape(-1, dim), np.frombuffer(row["start"][0], np.int64), np.frombuffer(row["radius"][0], np.float64))


class Best:
    """The k best others of each entry among those added; bar: what an other's cosine must reach to be one of them."""

    def __init__(self, bar: np.ndarray, rank: np.ndarray, k: int) -> None:
        self.bar, self.rank, self.k = bar, rank, k
        self.rows, self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

    def add(self, entry: np.ndarray, other: np.ndarray, cos: np.ndarray) -> None:
        self.rows.append((entry, other, cos))
        self.held += len(entry)
        if self.held > 10 * PAIRS:
            self.kept()

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        entry, other, cos = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((self.rank[other], -np.round(cos, DIGITS), entry))
        entry, other, cos = entry[order], other[order], cos[order]
        place = np.arange(len(entry)) - np.searchsorted(entry, entry)
        last = place == self.k - 1
        self.bar[entry[last]] = np.maximum(self.bar[entry[last]], cos[last] - SLACK)
        kept = place < self.k
        self.rows, self.held = [(entry[kept], other[kept], cos[kept])], 0
        return self.rows[0]


def near(a: Block, b: Block, least: float, k: int, bar: np.ndarray) -> tuple[Best, Best]:
    """For each entry of a its k best of b, and for each of b its k best of a, of cosine ``least`` or more; a and b may be one. bar: what the
    others of a's entries must reach already; it is raised."""
    of_a = Best(bar, b.rank, k)
    of_b = of_a if a is b else Best(np.full(len(b.cids), least - SLACK), a.rank, k)

    def add(row: np.ndarray, col: np.ndarray) -> None:
        for lo in range(0, len(row), PAIRS):
            r, c = row[lo : lo + PAIRS], col[lo : lo + PAIRS]
            cos = np.einsum("nd,nd->n", a.vec[r].astype(np.float64), b.vec[c].astype(np.float64))
            of_a.add(r, c, cos)
            of_b.add(c, r, cos)

    def all_of(r0: int, r1: int, c0: int, c1: int) -> None:
        """Entries r0 to r1 with c0 to c1, as they stand."""
        for r in range(r0, r1, TILE_ROWS):
            for c in range(max(c0, r + 1) if a is b else c0, c1, TILE_ROWS):
                rows, cols = np.arange(r, min(r + TILE_ROWS, r1)), np.arange(c, min(c + TILE_ROWS, c1))
                product = a.vec[rows] @ b.vec[cols].T
                if a is b:
                    product[rows[:, None] >= cols] = -np.inf
                need, theirs = of_a.bar[rows], of_b.bar[cols]
                over = (product >= need[:, None]) | (product >= theirs)
                if over.sum() > 4 * k * (len(rows) + len(cols)):
                    if len(cols) > k:
                        need = np.maximum(need, np.partition(product, len(cols) - k, axis=1)[:, len(cols) - k] - SLACK)
                    if len(rows) > k:
                        theirs = np.maximum(theirs, np.partition(product, len(rows) - k, axis=0)[len(rows) - k] - SLACK)
                    over = (product >= need[:, None]) | (product >= theirs)
                i, j = np.nonzero(over)
                add(rows[i], cols[j])

    # x·y >= cos(angle + radius of x's group + radius of y's) of two leaders x, y, as one product
    angle = np.arccos(least - SLACK) + a.radius
    left = np.column_stack([a.vec[a.start[:-1]], -np.cos(angle), np.sin(angle)]).astype(np.float32)
    right = np.column_stack([b.vec[b.start[:-1]], np.cos(b.radius), np.sin(b.radius)]).astype(np.float32)
    n_a, n_b = np.diff(a.start), np.diff(b.start)
    for lo in range(0, len(left), TILE_ROWS):
        for at in range(lo if a is b else 0, len(right), TILE):
            part = right[at : at + TILE]
            met = np.flatnonzero(left[lo : lo + TILE_ROWS] @ part.T >= -SLACK)
            x, y = lo + met // len(part), at + met % len(part)
            if a is b:
                x, y = x[x <= y], y[x <= y]
            if not len(x):
                continue
            n = n_a[x] * n_b[y]
            r0, r1, c0, c1 = a.start[lo], a.start[min(lo + TILE_ROWS, len(left))], b.start[at], b.start[at + len(part)]
            if 10 * n.sum() > (r1 - r0) * (c1 - c0):
                all_of(r0, r1, c0, c1)
                continue
            for i in np.nonzero(n > PAIRS)[0]:
                all_of(a.start[x[i]], a.start[x[i] + 1], b.start[y[i]], b.start[y[i] + 1])
            x, y, n = x[n <= PAIRS], y[n <= PAIRS], n[n <= PAIRS]
            cut = np.searchsorted(np.cumsum(n) // PAIRS, np.arange(n.sum() // PAIRS + 2))
            for i, j in zip(cut, cut[1:]):
                pair = np.repeat(np.arange(i, j), n[i:j])
                place = np.arange(len(pair)) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
                row, col = a.start[x[pair]] + place // n_b[y[pair]], b.start[y[pair]] + place % n_b[y[pair]]
                kept = np.einsum("nd,nd->n", a.vec[row], b.vec[col]) >= least - SLACK
                if a is b:
                    kept &= row < col
                add(row[kept], col[kept])
    return of_a, of_b


def near_classes(indexed: DataFrame, sizes: np.ndarray, dim: int, k: int, least: float) -> DataFrame:
    """cid, other, cosine: for each entry (cid, vec, list) its k most similar other entries of cosine ``least`` or more, and others of it; all
    pairs of entries are compared. sizes: of each list."""
    spark, n = indexed.sparkSession, int(sizes.sum())
    first, split = shards_of(sizes, min(BLOCK, max(LEAST_BLOCK, -(-n // 8))))
    placing = spark.sparkContext.broadcast((first, split))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, split = placing.value
        for b in batches:
            at = b["list"].to_numpy()
            yield b.assign(block=(first[at] + b.part.to_numpy() % split[at]).astype("int32")).drop(columns="part")

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["list", "cid"], kind="stable")
        x, at = np.frombuffer(b"".join(pdf.vec), np.float32).reshape(-1, dim), pdf["list"].to_numpy()
        edge = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1, [len(at)]])
        lead = np.concatenate([lo + leaders(x[lo:hi]) for lo, hi in zip(edge, edge[1:])])
        # the leader is the first of its group that is not in an earlier one, so the order is the leaders' and then the members'
        order = np.argsort(lead, kind="stable")
        x, lead = x[order], lead[order]
        start = np.append(np.nonzero(np.diff(lead, prepend=-1))[0], len(lead))
        size = np.diff(start)
        cos = np.einsum("nd,nd->n", x.astype(np.float64), np.repeat(x[start[:-1]], size, axis=0))
        radius = np.where(size > 1, np.arccos(np.clip(np.minimum.reduceat(cos, start[:-1]) - 1e-6, -1, 1)), 0.0)
        return pd.DataFrame({"block": pdf.block.iloc[:1].to_numpy(), "cids": [pdf.cid.to_numpy()[order]], "vec": [x.tobytes()], "start": [start.astype(np.int64).tobytes()], "radius": [radius.tobytes()]})

    part = F.pmod(F.xxhash64("cid", F.lit("part")), F.lit(1 << 30)).alias("part")
    placed = indexed.select("cid", "vec", "list", part).mapInPandas(place, "cid string, vec binary, list int, block int")
    folder = write_parts(placed.groupBy("block").applyInPandas(gather, "block int, cids array<string>, vec binary, start binary, radius binary"), "block", "blocks")
    # a number for each pair of blocks with entries: those of the first with all, of the second with all from itself, ...
    held = np.unique(np.concatenate([np.arange(f, f + s) for f, s, size in zip(first, split, sizes) if size]))
    before = np.concatenate([[0], np.cumsum(np.arange(len(held), 0, -1))])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, at, bar = None, -1, None
        for ids in batches:
            for p in ids.id:
                i = int(np.searchsorted(before, p, "right")) - 1
                if i != at:
                    a, at = read_block(folder, held[i], dim), i
                    bar = np.full(len(a.cids), least - SLACK)
                b = a if p == before[i] else read_block(folder, held[i + p - before[i]], dim)
                of_a, of_b = near(a, b, least, k, bar)
                for best, own, others in [(of_a, a, b), (of_b, b, a)][: 1 if a is b else 2]:
                    entry, other, cos = best.kept()
                    yield pd.DataFrame({"cid": own.cids[entry], "other": others.cids[other], "cosine": cos})

    tasks = int(min(before[-1], max(24, n * n // 2 // TASK_PAIRS)))
    return spark.range(0, int(before[-1]), 1, tasks).mapInPandas(join, "cid string, other string, cosine double")


def class_neighbours(entries: DataFrame, k: int, probe_share: float, least_probes: int, rerank: int, least: float = -1.0) -> DataFrame:
    """cid, other, cosine: for each entry its k most similar other entries of cosine ``least`` or more: all of cosine SURE or more, the rest
    as found in the probed lists."""
    spark = entries.sparkSession
    entries = materialize(entries.select("cid", "u"), "entries")
    n = entries.count()
    schema = "cid string, other string, cosine double"
    if n < 2:
        return spark.createDataFrame([], schema)
    dim = len(entries.select("u").first()[0])
    share = min(1.0, 1.3 * SAMPLE / n)
    drawn = entries.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("u").limit(SAMPLE).toPandas()
    sample = np.array(drawn.u.tolist(), np.float32).reshape(-1, dim)
    if not len(sample):
        sample = np.array([entries.select("u").first()[0]], np.float32)
    book = fit(sample, max(1, min(LISTS, int(2 * n**0.5))), parts=PARTS if dim % PARTS == 0 else 1, codes=CODES if least < SURE else 1)
    n_lists = len(book.centroids)
    held = spark.sparkContext.broadcast(book)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b.u.tolist(), np.float32).reshape(-1, dim)
            at, codes = encode(x, held.value)
            yield pd.DataFrame({"cid": b.cid, "vec": [r.tobytes() for r in x], "list": at, "code": [r.tobytes() for r in codes]})

    indexed = materialize(entries.mapInPandas(index, "cid string, vec binary, list int, code binary"), "index")
    sizes = np.zeros(n_lists, np.int64)
    for row in indexed.groupBy("list").count().collect():  # at most LISTS rows
        sizes[row[0]] = row[1]
    found = near_classes(indexed, sizes, dim, k, max(SURE, least))
    if least < SURE:
        probed = probed_classes(indexed, sizes, dim, held, min(n_lists, max(least_probes, round(probe_share * n_lists))), k, rerank, least)
        found = found.unionByName(probed).groupBy("cid", "other").agg(F.max("cosine").alias("cosine"))
    best = W.partitionBy("cid").orderBy(F.round("cosine", DIGITS).desc(), "other")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def probed_classes(indexed: DataFrame, sizes: np.ndarray, dim: int, held: Broadcast, probes: int, k: int, rerank: int, least: float) -> DataFrame:
    """cid, other, cosine: for each entry (cid, vec, list, code) of an index with the codebook ``held`` its k most similar other entries in
    each shard of the ``probes`` nearest lists. sizes: of each list."""
    spark, n_lists = indexed.sparkSession, len(sizes)
    first, split = shards_of(sizes, SHARD)
    placing = spark.sparkContext.broadcast((first, split))
    shards = int((first + split).max())

    def asked(x: np.ndarray) -> np.ndarray:
        """The nearest lists of unit vectors."""
        sim = x @ held.value.centroids.T
        return np.argpartition(-sim, probes - 1, axis=1)[:, :probes] if probes < n_lists else np.tile(np.arange(n_lists), (len(x), 1))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, split = placing.value
        total = np.zeros(shards, np.int64)
        for b in batches:
            near = asked(np.frombuffer(b"".join(b.vec), np.float32).reshape(-1, dim))
            meets = np.zeros((len(near), shards), bool)
            for i, lists in enumerate(near):
                for l in lists:  # noqa: E741
                    meets[i, first[l] : first[l] + split[l]] = True
            total += meets.sum(0)
        yield pd.DataFrame({"shard": np.arange(shards, dtype=np.int32), "n": total})

    # a shard meets its queries in batches of about BLOCK: it is sent as often as its own queries need it, and to no others
    batches_of = np.ones(shards, np.int64)
    for row in indexed.select("vec").mapInPandas(count, "shard int, n bigint").groupBy("shard").agg(F.sum("n")).collect():  # as many rows as shards
        batches_of[row[0]] = max(1, -(-row[1] // BLOCK))
    taking = spark.sparkContext.broadcast(batches_of)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, split = placing.value
        for b in batches:
            near = asked(np.frombuffer(b"".join(b.vec), np.float32).reshape(-1, dim))
            out = []
            for cid, vec, part, lists in zip(b.cid, b.vec, b.part, near):
                to: dict[int, list[int]] = {}
                for l in lists:  # noqa: E741
                    for s in range(first[l], first[l] + split[l]):
                        to.setdefault(int(s), []).append(int(l))
                out += [(s, part % taking.value[s], cid, vec, ls) for s, ls in to.items()]
            yield pd.DataFrame(out, columns=["shard", "block", "qid", "vec", "lists"])

    drawn_part = lambda name: F.pmod(F.xxhash64("cid", F.lit(name)), F.lit(1 << 30)).alias("part")
    queries = indexed.select("cid", "vec", drawn_part("query")).mapInPandas(route, "shard int, block int, qid string, vec binary, lists array<int>")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, split = placing.value
        for b in batches:
            at = b["list"].to_numpy()
            shard = first[at] + b.part.to_numpy() % split[at]
            yield b.assign(shard=shard.astype("int32"), n=taking.value[shard].astype("int32")).drop(columns="part")

    placed = indexed.select("cid", "vec", "list", "code", drawn_part("part")).mapInPandas(place, "cid string, vec binary, list int, code binary, shard int, n int")
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"cid": right.qid.iloc[:0].to_numpy(object), "other": left.cid.iloc[:0].to_numpy(object), "cosine": np.zeros(0)})
        left = left.sort_values("cid", kind="stable")
        vec = np.frombuffer(b"".join(left.vec), np.float32).reshape(-1, dim)
        codes = np.frombuffer(b"".join(left.code), np.uint8).reshape(len(left), -1)
        q = np.frombuffer(b"".join(right.vec), np.float32).reshape(-1, dim)
        best, score = search(q, list(right.lists), vec, left["list"].to_numpy(), codes, held.value, k + 1, rerank, least)
        at, col = np.nonzero(best >= 0)
        ids = left.cid.to_numpy()
        found = pd.DataFrame({"cid": right.qid.to_numpy()[at], "other": ids[best[at, col]], "cosine": score[at, col]})
        return found[found.cid != found.other]

    return placed.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(look, "cid string, other string, cosine double")


def similar(vectors: DataFrame, item: str, embedding: str, k: int = 10, probe_share: float = 0.12, least_probes: int = 64, rerank: int = 200, least: float = -1.0) -> DataFrame:
    """item, other, cosine, place (1 to k): the k most similar other items of each item with a valid vector (equal cosines: smaller item
    first). Items with invalid vectors take no part; with fewer than k others all come out. Of those under ``least`` not all need come out."""
    members, entries = directions(vectors, item, embedding, k)
    entries = materialize(entries, "entries")
    found = class_neighbours(entries, k, probe_share, least_probes, rerank, least)
    first = entries.select("cid", "n", "first")
    # an entry with k + 1 members fills its members' places by itself
    own = _spread(members, first.where("n > 1").select("cid", "first"), "cid").select("item", F.explode("first").alias("other"), F.lit(1.0).alias("cosine")).where(F.col("item") != F.col("other"))
    others = found.join(first.select(F.col("cid").alias("other"), F.col("first").alias("theirs")), "other").select("cid", "theirs", "cosine")
    # to an entry with more than k members only copies of another length matter besides
    wanted = others.join(first.select("cid", "n"), "cid").where((F.col("n") <= k) | (F.round("cosine", DIGITS) >= 1)).select("cid", F.explode("theirs").alias("other"), "cosine")
    far = _spread(members, wanted, "cid").select("item", "other", "cosine")
    best = W.partitionBy("item").orderBy(F.round("cosine", DIGITS).desc(), "other")
    ranked = own.unionByName(far).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return ranked.select("item", "other", "cosine", F.col("place").cast("bigint").alias("place"))


def similar_pairs(vectors: DataFrame, item: str, embedding: str, least: float, k: int = 10) -> DataFrame:
    """item_a < item_b with cosine at least ``least`` of which one is among the k most similar of the other. From SURE on near_classes() finds
    them all and no list is probed; below, few lists are probed for the rest."""
    near = similar(vectors, item, embedding, k, probe_share=0.01, least_probes=8, rerank=64, least=least).where(F.col("cosine") >= least)
    return near.select(F.least("item", "other").alias("item_a"), F.greatest("item", "other").alias("item_b")).distinct()
