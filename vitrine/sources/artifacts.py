"""Artefacts and their manifests: vectors, factors and models on shared storage, policies as small JSON files.

Data goes through Spark's committer; a manifest is written last, so a half-written artefact has none and is refused.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.bpr import Factors
from vitrine.operators.learn import FEATURE_VERSION, Mlp
from vitrine.sources.files import write_json_atomic


class Incompatible(RuntimeError):
    """An artefact that exists but does not fit."""


class Missing(RuntimeError):
    """An artefact without a manifest."""


def file_digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


@dataclass(frozen=True)
class Manifest:
    """What an artefact holds; ``checks`` are digests or counts that a reader verifies."""

    kind: str
    version: str
    dataset_version: str
    checks: dict = field(default_factory=dict)

    def write(self, folder: str) -> None:
        write_json_atomic(os.path.join(folder, "manifest.json"), asdict(self))

    @staticmethod
    def read(folder: str, kind: str, dataset_version: str | None = None) -> Manifest:
        path = os.path.join(folder, "manifest.json")
        if not os.path.exists(path):
            raise Missing(folder)
        with open(path, encoding="utf-8") as f:
            m = Manifest(**json.load(f))
        if m.kind != kind or (dataset_version and m.dataset_version != dataset_version):
            raise Incompatible(f"{folder} holds {m.kind} of {m.dataset_version}")
        return m


def save_vectors(df: DataFrame, folder: str, dim: int, dataset_version: str) -> Manifest:
    """id and array<float> vectors as Parquet, with their number and dimension in the manifest."""
    df.write.mode("overwrite").parquet(os.path.join(folder, "data"))
    m = Manifest("vectors", "1", dataset_version, {"rows": df.sparkSession.read.parquet(os.path.join(folder, "data")).count(), "dim": dim})
    m.write(folder)
    return m


def load_vectors(spark: SparkSession, folder: str, column: str, dataset_version: str | None = None) -> DataFrame:
    m = Manifest.read(folder, "vectors", dataset_version)
    df = spark.read.parquet(os.path.join(folder, "data"))
    found = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size(column) != m.checks["dim"], 1)).alias("bad")).first()
    if found.n != m.checks["rows"] or found.bad:
        raise Incompatible(f"{folder}: {found.n} rows, {found.bad} of another dimension")
    return df


def save_ranker(model: Mlp, mean: np.ndarray, std: np.ndarray, folder: str, dataset_version: str) -> Manifest:
    """Weights and scaler of the pairwise ranker."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "ranker.npz")
    np.savez(path, mean=mean, std=std, **{f"{k}{i}": a for i, layer in enumerate(model.layers) for k, a in zip("wb", layer)})
    m = Manifest("ranker", FEATURE_VERSION, dataset_version, {"sha256": file_digest(path)})
    m.write(folder)
    return m


def load_ranker(folder: str, dataset_version: str | None = None) -> tuple[Mlp, np.ndarray, np.ndarray]:
    m = Manifest.read(folder, "ranker", dataset_version)
    path = os.path.join(folder, "ranker.npz")
    if m.version != FEATURE_VERSION or file_digest(path) != m.checks["sha256"]:
        raise Incompatible(f"{folder}: other features or changed weights")
    z = np.load(path)
    n = sum(k.startswith("w") for k in z.files)
    model = Mlp(len(z["mean"]), ())
    model.layers = [(z[f"w{i}"], z[f"b{i}"]) for i in range(n)]
    return model, z["mean"], z["std"]


def save_factors(factors: Factors, folder: str, dataset_version: str) -> Manifest:
    """User and item factors with their counts and dimension."""
    counts = {}
    for name in ("users", "items"):
        getattr(factors, name).write.mode("overwrite").parquet(os.path.join(folder, name))
        counts[name] = factors.users.sparkSession.read.parquet(os.path.join(folder, name)).count()
    first = factors.items.select("v").first()
    m = Manifest("factors", "bpr-v1", dataset_version, counts | {"dim": len(first[0]) if first else 0})
    m.write(folder)
    return m


def load_factors(spark: SparkSession, folder: str, dataset_version: str | None = None) -> Factors:
    m = Manifest.read(folder, "factors", dataset_version)
    out = Factors(*[spark.read.parquet(os.path.join(folder, name)) for name in ("users", "items")])
    for name in ("users", "items"):
        df = getattr(out, name)
        found = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size("v") != m.checks["dim"], 1)).alias("bad")).first()
        if found.n != m.checks[name] or found.bad:
            raise Incompatible(f"{folder}/{name}: {found.n} rows, {found.bad} of another dimension")
    return out


@dataclass(frozen=True)
class Policy:
    """Frozen weights of a ranking: channel weights that sum to 1, and the largest share a preference may add."""

    version: str
    weights: dict
    gamma: float = 0.0
    candidate_depth: int = 100

    def __post_init__(self) -> None:
        if any(w < 0 for w in self.weights.values()) or abs(sum(self.weights.values()) - 1) > 1e-6 or not 0 <= self.gamma <= 0.30 or self.candidate_depth < 1:
            raise ValueError(f"policy {self.version} is not valid")

    def save(self, path: str) -> None:
        write_json_atomic(path, asdict(self))

    @staticmethod
    def load(path: str) -> Policy:
        with open(path, encoding="utf-8") as f:
            return Policy(**json.load(f))


HYBRID_POLICY = Policy("hybrid-rec-v1", {"content": 0.6, "cf": 0.3, "popularity": 0.1})
PERSONAL_POLICY = Policy("personalized-search-v1", {"content": 0.0, "cf": 1.0}, gamma=0.30)


def register(existing: DataFrame, kind: str, version: str, dataset_version: str, path: str) -> DataFrame:
    """The registry table with this artefact in place of an older entry of the same kind and version."""
    row = existing.sparkSession.createDataFrame([(kind, version, dataset_version, path)], "kind string, version string, dataset_version string, path string")
    return existing.where(~((F.col("kind") == kind) & (F.col("version") == version))).unionByName(row)


def resolve_dataset_version(versions: DataFrame, preferred: str | None = None) -> str | None:
    """The preferred dataset version if it exists, else the newest, else None."""
    first = versions.orderBy((F.col("dataset_version") == F.lit(preferred)).desc_nulls_last(), F.col("created_at").desc(), "dataset_version").select("dataset_version").first()
    return first[0] if first else None
