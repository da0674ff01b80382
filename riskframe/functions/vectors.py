"""Vector functions on ``array<float|double>`` columns."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.functions.columns import col
from riskframe.functions.text import token_codes, tokenize

#: Tokens that are counted into vectors at a time.
STRETCH = 1_000_000


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in double precision; 0 when either vector has no length."""
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def unit(a: Column | str) -> Column:
    """The vector scaled to length one; a zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(col(a), lambda x: x.cast("double") / n)).otherwise(
        F.transform(col(a), lambda x: F.lit(0.0))
    )


def token_buckets(c: Column | str, dim: int) -> Column:
    """For each token the integer of the first four md5 hex digits, modulo ``dim``."""
    return F.transform(
        tokenize(c), lambda t: (F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % F.lit(dim)).cast("int")
    )


def hashed_vector(c: Column | str, dim: int = 64) -> Column:
    """Hashed term-frequency vector of a text, scaled to length one.

    Tokens and buckets are JVM expressions; only lists of the smallest integers
    that hold a bucket cross to Arrow, where texts of about ``STRETCH`` tokens
    are counted at once, so what a task holds does not follow the length of a
    batch's texts. The vector of a row needs that row alone, so no shuffle is
    involved.
    """

    @F.pandas_udf("array<double>")
    def count_buckets(buckets: pd.Series) -> pd.Series:
        sizes = buckets.map(len).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        counts = np.zeros((len(sizes), dim))
        a = 0
        while a < len(sizes):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + STRETCH, "right")))
            if ends[b - 1] > ends[a] - sizes[a]:
                at = np.repeat(np.arange(b - a) * dim, sizes[a:b])
                at += np.concatenate(buckets.iloc[a:b].to_list())
                counts[a:b] = np.bincount(at, minlength=(b - a) * dim).reshape(b - a, dim)
            a = b
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        counts /= np.where(length > 0, length, 1.0)
        return pd.Series(list(counts))

    kind = "tinyint" if dim <= 1 << 7 else "smallint" if dim <= 1 << 15 else "int"
    return count_buckets(token_buckets(c, dim).cast(f"array<{kind}>"))


def text_vector(c: Column | str, dim: int = 64) -> Column:
    """The vector that `hashed_vector` gives, for whole tables of texts.

    Texts cross to Arrow as they are, their tokens are found in the bytes, and
    every distinct token of a stretch of texts is hashed once.
    """

    @F.arrow_udf("array<double>")
    def count_tokens(texts: pa.Array) -> pa.Array:
        counts = np.zeros((len(texts), dim))
        for a, words, codes, sizes in token_codes(texts):
            bucket = np.array([int.from_bytes(hashlib.md5(w.encode(), usedforsecurity=False).digest()[:2]) % dim for w in words.to_pylist()], np.int64)
            at = np.repeat(np.arange(len(sizes)) * dim, sizes) + bucket[codes]
            counts[a : a + len(sizes)] = np.bincount(at, minlength=len(sizes) * dim).reshape(-1, dim)
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        counts /= np.where(length > 0, length, 1.0)
        return pa.ListArray.from_arrays(np.arange(len(counts) + 1, dtype=np.int32) * dim, counts.ravel())

    return count_tokens(col(c))
