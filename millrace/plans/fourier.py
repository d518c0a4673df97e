"""Fourier transform of series that no single task should hold.

A transform of any length n is a convolution with a chirp, and that is three transforms of a power of two, M >= 2n - 1.
With M = A * B, the place in a series is a + A * b and the frequency d + B * c, and one transform falls into

* for every a: B numbers, transformed over b, times exp(-2 pi i a d / M);
* for every d: A numbers, transformed over c.

The way back begins where the way there ends, with A numbers for every d, and falls apart alike. So the rows are
shuffled three times: by a, by d and by the second place; a task holds some values of a (or d) at a time, at most as
many numbers as one block has rows. Between the steps the numbers travel as tiles of the matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.spec import ident
from millrace.plans.ordered import RN, join_keys, number_rows

N = "__n"


class Shape:
    """How a series of n values is divided: M = A * B, and how many a or d one task takes."""

    def __init__(self, n: int, block: int):
        bits = max(2 * n - 2, 0).bit_length()
        self.n, self.m = n, 1 << bits
        self.a, self.b = 1 << bits // 2, 1 << bits - bits // 2
        self.rows = 1 << max(min(self.a, block // self.b).bit_length() - 1, 0)  # values of a in one task
        self.columns = 1 << max(min(self.b, block // self.a).bit_length() - 1, 0)  # values of d in one task

    def chirp(self, k: np.ndarray) -> np.ndarray:
        """exp(-pi i k^2 / n), with the square taken in whole numbers."""
        return np.exp(-1j * np.pi * (k * k % (2 * self.n)) / self.n)

    def twiddle(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """exp(-2 pi i x y / M) for all pairs."""
        return np.exp(-2j * np.pi * (np.multiply.outer(x, y) % self.m) / self.m)

    def tiles(self, matrix: np.ndarray) -> list[bytes]:
        """A matrix of some a by all d, cut into blocks of d."""
        return [np.ascontiguousarray(matrix[:, i:i + self.columns]).tobytes() for i in range(0, self.b, self.columns)]

    def forward(self, place: int, matrix: np.ndarray) -> list[bytes]:
        """The first half of a transform: the rows of the ``place``-th block of a, over b."""
        a = np.arange(len(matrix)) + place * self.rows
        return self.tiles(np.fft.fft(matrix, axis=1) * self.twiddle(a, np.arange(self.b)))


def magnitude_sums(df: DataFrame, keys: list[str], time: str, value: str, hot: DataFrame, block: int) -> DataFrame:
    """Per key of ``hot`` (keys and ``__n``, the number of rows): __s0, __s1, __s2, the sums of |X(f)|, f |X(f)| and
    f^2 |X(f)| over the frequencies f = 0 ... n // 2 of the real series in time order. A missing value makes them NaN."""
    by = [ident(k) for k in keys]
    fields = [df.schema[k] for k in keys]
    held = hot.select(*by, F.col(N).cast("long").alias(N)).collect()  # bounded, and local already
    shapes = {r[N]: Shape(r[N], block) for r in held}
    divided = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in (N, "__a", "__rows"))])
    counted = df.sparkSession.createDataFrame([(*r, shapes[r[N]].a, shapes[r[N]].rows) for r in held], divided)
    rows = join_keys(df.select(*by, time, ident(value).cast("double").alias("__x")), counted.select(*by), keys, "left_semi", hint=True)
    rows = join_keys(number_rows(rows, keys, [time]), counted, keys, hint=True).withColumn("__i", F.col(RN) - 1)
    rows = rows.select(*by, N, "__i", "__x", F.floor(F.pmod("__i", "__a") / F.col("__rows")).cast("int").alias("__p"))
    tile = T.StructType([*fields, T.StructField(N, T.LongType()), T.StructField("__p", T.IntegerType()), T.StructField("__q", T.IntegerType()), T.StructField("__kind", T.IntegerType()), T.StructField("__z", T.BinaryType())])
    names = [*keys, N, "__p", "__q", "__kind", "__z"]

    def out(key: tuple, place: int, kind: int, tiles: list[bytes]) -> pd.DataFrame:
        """Tiles of one block; what was the column block is the next step's place."""
        made = pd.DataFrame({"__p": range(len(tiles)), "__q": place, "__kind": kind, "__z": tiles})
        for name, v in zip([*keys, N], key):
            made[name] = v
        return made[names]

    def signal(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, place = key[-2], key[-1]
        s = shapes[n]
        i = pdf["__i"].to_numpy()
        matrix = np.zeros((s.rows, s.b), complex)
        matrix[(i & (s.a - 1)) - place * s.rows, i // s.a] = pdf["__x"].to_numpy(dtype="float64") * s.chirp(i)
        return out(key[:-1], place, 0, s.forward(place, matrix))

    def filtered(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The chirp that the signal is convolved with; it has no rows, only places."""
        n, place = key[-2], key[-1]
        s = shapes[n]
        i = np.add.outer(np.arange(s.rows) + place * s.rows, s.a * np.arange(s.b))
        k = np.minimum(i, s.m - i)
        return out(key[:-1], place, 1, s.forward(place, np.where(k < n, np.conj(s.chirp(np.where(k < n, k, 0))), 0)))

    def back(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Both transforms end, their product is taken, and the way back begins, for some d."""
        n, place = key[-2], key[-1]
        s = shapes[n]
        both = []
        for kind in (0, 1):
            part = pdf[pdf["__kind"] == kind].sort_values("__q")
            both.append(np.fft.fft(np.concatenate([np.frombuffer(z, complex).reshape(-1, s.columns) for z in part["__z"]]), axis=0))
        matrix = np.fft.ifft(both[0] * both[1], axis=0)
        matrix *= np.conj(s.twiddle(np.arange(s.a), np.arange(s.columns) + place * s.columns))
        return out(key[:-1], place, 0, [matrix[i:i + s.rows].tobytes() for i in range(0, s.a, s.rows)])

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, place = key[-2], key[-1]
        s = shapes[n]
        part = pdf.sort_values("__q")
        matrix = np.concatenate([np.frombuffer(z, complex).reshape(-1, s.columns) for z in part["__z"]], axis=1)
        size = np.abs(np.fft.ifft(matrix, axis=1))
        f = np.add.outer(np.arange(s.rows) + place * s.rows, s.a * np.arange(s.b))
        size, f = size[f <= n // 2], f[f <= n // 2].astype(float)
        return pd.DataFrame([[*key[:-2], size.sum(), (f * size).sum(), (f * f * size).sum()]], columns=[*keys, "__s0", "__s1", "__s2"])

    step = [*by, F.col(N), F.col("__p")]
    places = counted.select(*by, N, F.explode(F.sequence(F.lit(0), (F.col("__a") / F.col("__rows") - 1).cast("int"))).alias("__p"))
    there = rows.groupBy(*step).applyInPandas(signal, tile).unionByName(places.groupBy(*step).applyInPandas(filtered, tile))
    home = there.groupBy(*step).applyInPandas(back, tile)
    added = T.StructType([*fields, *(T.StructField(c, T.DoubleType()) for c in ("__s0", "__s1", "__s2"))])
    done = home.groupBy(*step).applyInPandas(sums, added)
    return done.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("__s0", "__s1", "__s2")])
