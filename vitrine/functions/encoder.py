"""Text encoders: a protocol for models and a hashing encoder that needs none."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Encoder(Protocol):
    """Anything that turns texts into rows of a float matrix."""

    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


def encoder_udf(make: Callable[[], Encoder]):
    """A pandas UDF (text to array<float>) that builds the encoder once per task."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(list(np.asarray(model.encode(texts.fillna("").tolist()), np.float32)))

    return encode


def hashed_vector(terms: Column, dim: int = 64) -> Column:
    """Signed feature hashing of terms, scaled to unit length (all zero without terms); built-in expressions only."""
    cells = F.transform(terms, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dim)).alias("i"), F.when(F.pmod(F.xxhash64(F.lit("sign"), t), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = lambda c: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(c, lambda x: x["i"] == i), F.lit(0.0), lambda a, x: a + x["s"]))
    # one-element arrays bind a value once for the lambdas inside
    bind = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    norm = lambda r: F.greatest(F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    pair = bind(bind(cells, raw), lambda r: F.struct(r.alias("r"), norm(r).alias("n")))
    return bind(pair, lambda p: F.transform(p["r"], lambda x: (x / p["n"]).cast("float")))
