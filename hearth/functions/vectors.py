"""Vector functions: hashed text embedding, norm, distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from hearth.functions.blocks import DISTANCE_DECIMALS
from hearth.functions.text import as_column, bind, with_prefix

EMBED_DIM = 64
# vectors built at a time
VECTOR_ROWS = 1024


def l2_normalize(vector: Column | str) -> Column:
    """Unit-length vector as floats; a zero vector stays zero."""

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
        return bind(
            F.when(norm > 0, norm).otherwise(F.lit(1.0)),
            lambda n: F.transform(v, lambda x: (x / n).cast("float")),
        )

    return bind(as_column(vector).cast("array<double>"), scaled)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    gaps = F.zip_with(
        as_column(a), as_column(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))
    )
    return F.round(F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x), DISTANCE_DECIMALS)


def relevance(distance: Column | str) -> Column:
    return F.round(F.lit(1.0) - as_column(distance), DISTANCE_DECIMALS)


def bucket_vectors(dim: int) -> Callable[[Column], Column]:
    """Arrays of bucket numbers to unit vectors of their counts, whose cost per token does not depend on ``dim``."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            parts = [_unit_counts(lists.slice(low, VECTOR_ROWS), dim) for low in range(0, len(lists), VECTOR_ROWS)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    return run


def _unit_counts(lists: pa.Array, dim: int) -> pa.Array:
    sizes = pc.list_value_length(lists)
    rows = np.repeat(np.arange(len(lists)), sizes.fill_null(0).to_numpy(zero_copy_only=False))
    flat = rows * dim + lists.flatten().to_numpy(zero_copy_only=False)
    counts = np.bincount(flat, minlength=len(lists) * dim).reshape(len(lists), dim).astype(np.float64)
    norms = np.sqrt((counts**2).sum(axis=1, keepdims=True))
    unit = (counts / np.where(norms > 0, norms, 1.0)).astype(np.float32)
    ends = np.arange(len(lists) + 1, dtype=np.int32) * dim
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(unit.ravel()), mask=sizes.is_null())


def hash_embed(text: Column | str, dim: int = EMBED_DIM, prefix: str = "") -> Column:
    """Hashed token counts of a text as a unit vector; null for a null text.

    Tokens are cut and hashed natively; the bucket numbers of a batch of texts
    are counted in one pass.
    """
    words = F.split(F.lower(with_prefix(prefix, text) if prefix else as_column(text)), r"[^\p{L}\p{N}]+")
    buckets = F.transform(
        F.array_remove(words, ""),
        lambda word: F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"),
    )
    return bucket_vectors(dim)(buckets)


def embed_with(load: Callable[[], Callable[[list[str]], np.ndarray]], text: Column | str, prefix: str = "") -> Column:
    """Embed with a user model: ``load`` runs once per task and returns a batch function."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            vectors = np.asarray(encode([prefix + (t or "") for t in texts]), dtype=np.float64)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.Series(list((vectors / np.where(norms > 0, norms, 1.0)).astype(np.float32)))

    return run(as_column(text))
