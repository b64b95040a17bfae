from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from vitrine.operators.learn import Mlp
from vitrine.sources import artifacts as a


def test_vectors_round_trip_and_refusals(spark, tmp_path):
    d = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [0.0, 1.0])], "id string, v array<float>")
    folder = str(tmp_path / "v")
    with pytest.raises(a.Missing):
        a.load_vectors(spark, folder, "v")
    a.save_vectors(d, folder, 2, "v1")
    assert a.load_vectors(spark, folder, "v", "v1").count() == 2
    with pytest.raises(a.Incompatible):
        a.load_vectors(spark, folder, "v", "v2")
    a.Manifest("vectors", "1", "v1", {"rows": 3, "dim": 2}).write(folder)
    with pytest.raises(a.Incompatible):
        a.load_vectors(spark, folder, "v")


def test_ranker_round_trip(tmp_path):
    m, folder = Mlp(25), str(tmp_path / "r")
    a.save_ranker(m, np.zeros(25), np.ones(25), folder, "v1")
    again, mean, _ = a.load_ranker(folder, "v1")
    x = np.ones((3, 25))
    assert np.array_equal(m.score(x), again.score(x)) and len(mean) == 25
    with open(folder + "/ranker.npz", "ab") as f:
        f.write(b"x")
    with pytest.raises(a.Incompatible):
        a.load_ranker(folder)


def test_policies_and_registry(spark, tmp_path):
    path = str(tmp_path / "p.json")
    a.HYBRID_POLICY.save(path)
    assert a.Policy.load(path) == a.HYBRID_POLICY
    with pytest.raises(ValueError):
        a.Policy("bad", {"x": 0.5})
    none = spark.createDataFrame([], "kind string, version string, dataset_version string, path string")
    two = a.register(a.register(none, "k", "1", "d", "old"), "k", "1", "d", "new")
    assert [r.path for r in two.collect()] == ["new"]
    v = spark.createDataFrame([("v1", dt.datetime(2024, 1, 1)), ("v2", dt.datetime(2025, 1, 1))], "dataset_version string, created_at timestamp")
    assert a.resolve_dataset_version(v, "v1") == "v1" and a.resolve_dataset_version(v, "zz") == "v2" and a.resolve_dataset_version(v.limit(0)) is None
