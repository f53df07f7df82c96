"""Vector functions."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import tokens_col

DOUBLES = T.ArrayType(T.DoubleType())


def dot_col(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm_col(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_col(a: Column, b: Column) -> Column:
    """True cosine; null where a vector is null, zero, or of another length."""
    lengths = norm_col(a) * norm_col(b)
    return F.when((F.size(a) == F.size(b)) & (lengths > 0), dot_col(a, b) / lengths)


def literal_col(vector: Column) -> Column:
    """A vector as text with eight decimals a component."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.8f", x.cast("double"))), ","), F.lit("]"))


def hash_dimension_col(token: Column, dim: int) -> Column:
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % dim).cast("int")


def hash_sign_col(token: Column) -> Column:
    return F.when(F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("int") % 2 == 1, -1.0).otherwise(1.0)


def hashed_components(df: DataFrame, id_col: str, text_col: str, dim: int = 256) -> DataFrame:
    """``id, dim, value``: the hashed embedding of each text as its components other than 0.

    A token's dimension and sign come from its SHA-256, its weight is 1 + ln(tf); the vector is
    scaled to length 1.  All in the JVM: one aggregation by (id, token), one by (id, dimension),
    one window of at most ``dim`` rows an id.  Repeated rows of an id add up, so ids must be unique.
    """
    from pyspark.sql import Window

    counted = df.select(F.col(id_col), F.explode(tokens_col(F.col(text_col))).alias("t")).groupBy(id_col, "t").agg(F.count("*").alias("tf"))
    parts = counted.select(id_col, hash_dimension_col(F.col("t"), dim).alias("dim"), (hash_sign_col(F.col("t")) * (1 + F.log(F.col("tf").cast("double")))).alias("w"))
    summed = parts.groupBy(id_col, "dim").agg(F.sum("w").alias("v")).where(F.abs("v") > 1e-12)
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(id_col)))
    return summed.select(id_col, "dim", (F.col("v") / length).alias("value"))


def hashed_tokens(tokens: list[str], dim: int = 256) -> list[tuple[int, float]]:
    """The components (dimension, value) of :func:`hashed_components` for one text's tokens."""
    summed: dict[int, float] = {}
    for token, tf in Counter(tokens).items():
        digest = hashlib.sha256(token.encode()).hexdigest()
        weight = (-1.0 if int(digest[8:10], 16) % 2 else 1.0) * (1 + math.log(tf))
        at = int(digest[:8], 16) % dim
        summed[at] = summed.get(at, 0.0) + weight
    kept = {d: v for d, v in summed.items() if abs(v) > 1e-12}
    length = math.sqrt(sum(v * v for v in kept.values()))
    return [(d, v / length) for d, v in kept.items()]


def digest_vector(text: str, dim: int) -> np.ndarray:
    """A stand-in vector made of the text's SHA-512, repeated, read as floats and scaled to length 1.

    Bytes that aren't finite numbers count as 0, so the length is 1 or, of all zeros, 0.
    """
    digest = hashlib.sha512(text.encode()).digest()
    raw = (digest * (dim * 4 // len(digest) + 1))[: dim * 4]
    v = np.nan_to_num(np.frombuffer(raw, "<f4").astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    peak = np.abs(v).max()
    v = v / peak if peak else v
    size = np.linalg.norm(v)
    return v / size if size else v


def digest_vector_udf(dim: int = 128):  # noqa: ANN201
    @F.pandas_udf(DOUBLES)
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else digest_vector(t, dim))

    return embed


def projection(source: int, target: int, model: str) -> np.ndarray:
    seed = int(hashlib.sha256(f"{model}:{target}".encode()).hexdigest()[:8], 16)
    return np.random.default_rng(seed).standard_normal((source, target)) / np.sqrt(target)


def project_udf(target: int, model: str = "hash"):  # noqa: ANN201
    """Vectors brought to ``target`` dimensions: a seeded Gaussian projection, scaled to length 1,
    where they are longer; zeros behind where they are shorter."""

    @F.pandas_udf(DOUBLES)
    def apply(vectors: pd.Series) -> pd.Series:
        matrices: dict[int, np.ndarray] = {}

        def one(v: np.ndarray | None) -> np.ndarray | None:
            if v is None:
                return None
            v = np.asarray(v, np.float64)
            if len(v) <= target:
                return np.concatenate([v, np.zeros(target - len(v))])
            if len(v) not in matrices:
                matrices[len(v)] = projection(len(v), target, model)
            out = v @ matrices[len(v)]
            size = np.linalg.norm(out)
            return out / size if size else out

        return vectors.map(one)

    return apply
