"""Vectors as array columns: products, norms, and a deterministic embedding by hashed words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets of the hashed embedding, and words whose bucket a worker remembers.
BUCKETS, REMEMBERED = 64, 100_000


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """A unit vector; one of zeros stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def _hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    buckets: dict[bytes, int] = {}
    for texts in batches:
        out = []
        for text in texts:
            words = text.encode().split() if text else []
            if len(buckets) > REMEMBERED:
                buckets.clear()
            for w in words:
                if w not in buckets:
                    buckets[w] = hashlib.md5(w).digest()[-1] % BUCKETS
            counts = np.bincount(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), minlength=BUCKETS).astype(np.float64)
            size = np.sqrt(counts @ counts)
            out.append(counts / size if size else counts)
        yield pd.Series(out)


def hashed_vectors(texts: list[str]) -> np.ndarray:
    """The same for a list of texts."""
    return np.array(list(next(_hashed(iter([pd.Series([t.lower() for t in texts], dtype=object)])))), np.float64).reshape(len(texts), BUCKETS)


def hashed_vector(text: Column) -> Column:
    """A stand-in for an embedding model: the unit vector of the counts of the text's words in lower case by a hash.

    One pass over Arrow batches; no row moves. A text without words, or null, has the zero vector.
    """
    return F.pandas_udf(_hashed, "array<double>")(F.lower(text))
