"""Providers of embeddings as a plug-in: any object that turns texts into vectors, run by Arrow batches in the workers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions.tokens import ASCII, tokens


class Provider(Protocol):
    """identity names model and revision, so that vectors of different ones are never compared."""

    identity: str
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


#: Of this worker process: the providers it has made, by identity.
_made: dict[str, Provider] = {}


@dataclass(frozen=True)
class Embedder:
    """How a provider is made, and what it must be. make is called once in a worker process and kept there."""

    make: Callable[[], Provider]
    identity: str
    dimension: int

    def provider(self) -> Provider:
        known = _made.get(self.identity)
        if known is None:
            known = self.make()
            if known.identity != self.identity or known.dimension != self.dimension:
                raise ValueError(f"embedding_profile_mismatch: {known.identity} of {known.dimension} dimensions, not {self.identity} of {self.dimension}")
            _made[self.identity] = known
        return known

    def add(self, rows: DataFrame, text: str, name: str = "vector") -> DataFrame:
        """rows with the vector of a text column; null texts have none. Each distinct text of a batch is embedded once."""
        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            provider = self.provider()
            for texts in batches:
                distinct = list(texts.dropna().unique())
                vectors = np.asarray(provider.embed(distinct), float) if distinct else np.zeros((0, self.dimension))
                if vectors.shape != (len(distinct), self.dimension) or not np.isfinite(vectors).all():
                    raise ValueError(f"embedding_invalid: {self.identity} gave {vectors.shape} for {len(distinct)} texts")
                known = dict(zip(distinct, vectors, strict=True))
                yield texts.map(lambda t, known=known: known.get(t))

        return rows.withColumn(name, embed(F.col(text)))


@lru_cache(1 << 17)
def term_hash(term: str) -> int:
    """The first two bytes of a term's sha256; a worker keeps those of the terms that it met last."""
    return int.from_bytes(hashlib.sha256(term.encode()).digest()[:2], "big")


def hashed_counts(texts: pa.Array, dimension: int) -> np.ndarray:
    """A row for each lower-cased text: in each bucket the number of the text's distinct terms that hash to it."""
    found, row = tokens(texts, ASCII)
    coded = found.dictionary_encode()
    bucket = np.array([term_hash(t) % dimension for t in coded.dictionary.to_numpy(zero_copy_only=False).tolist()], np.int64)
    wide = max(1, len(bucket))
    # Sorting is several times as fast as unique, which hashes numbers.
    pair = np.sort(row * wide + coded.indices.to_numpy().astype(np.int64))
    pair = pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]]
    return np.bincount(pair // wide * dimension + bucket[pair % wide], minlength=len(texts) * dimension).reshape(len(texts), dimension).astype(float)


class HashingProvider:
    """The hashing embedding as a provider: counts of a text's distinct terms in the buckets of their hashes."""

    def __init__(self, dimension: int = 256):
        self.identity, self.dimension = f"hashing-{dimension}", dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        return hashed_counts(pa.array([t.lower() for t in texts], pa.string()), self.dimension)


HASHING = Embedder(HashingProvider, "hashing-256", 256)
