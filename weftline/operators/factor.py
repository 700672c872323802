"""Factors of large sparse matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def randomised_svd(rows: DataFrame, width: int, k: int, oversample: int = 10, power: int = 1, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(width, k) leading right singular vectors, and k singular values, of a sparse matrix with rows (at array<int>, value array<double>).

    Products A'(A X) are summed by tasks, which pass on only the rows of the result that they touch, and merged by slices of
    ``width``; the driver holds one width x (k + oversample)."""
    spark, slice_ = rows.sparkSession, 1024

    def product(x: np.ndarray) -> np.ndarray:
        shared, k = spark.sparkContext.broadcast(x), x.shape[1]

        def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                touched, at = np.unique(np.concatenate(p["at"].to_numpy()), return_inverse=True)
                out = np.zeros((len(touched), k))
                for own, value in zip(np.split(at, np.cumsum(p["at"].map(len))[:-1]), p["value"], strict=True):  # a row names a column once
                    out[own] += value[:, None] * (value @ shared.value[touched[own]])
                for s in np.unique(touched // slice_):
                    here = touched // slice_ == s
                    yield pd.DataFrame({"slice": [s], "at": [touched[here].astype(np.int64).tobytes()], "part": [out[here].tobytes()]})

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            first = int(pdf["slice"].iloc[0]) * slice_
            total, seen = np.zeros((slice_, k)), np.zeros(slice_, bool)
            for at, part in zip(pdf["at"], pdf["part"], strict=True):
                own = np.frombuffer(at, np.int64) - first
                total[own] += np.frombuffer(part).reshape(-1, k)
                seen[own] = True
            return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "at": [(np.flatnonzero(seen) + first).tobytes()], "part": [total[seen].tobytes()]})

        out, schema = np.zeros_like(x), "slice int, at binary, part binary"
        for r in rows.mapInPandas(partial, schema).groupBy("slice").applyInPandas(merge, schema).toLocalIterator():
            out[np.frombuffer(r["at"], np.int64)] = np.frombuffer(r["part"]).reshape(-1, k)
        shared.destroy()
        return out

    size = min(width, k + oversample)
    basis = np.random.default_rng(seed).standard_normal((width, size))
    for _ in range(power + 1):
        basis, _ = np.linalg.qr(product(basis))
    squares, turn = np.linalg.eigh(basis.T @ product(basis))
    return basis @ turn[:, ::-1][:, :k], np.sqrt(np.maximum(squares[::-1][:k], 0))
