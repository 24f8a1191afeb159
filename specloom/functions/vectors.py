"""Vector functions on columns. Values are multiplied and summed as doubles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """Cosine, null where a vector is null, of zero length, or not finite."""
    c = F.try_divide(dot(a, b), norm(a) * (norm(b) if norm_b is None else norm_b))
    return F.when(~F.isnan(c), c)


def cosine_to(query, vector: Column) -> Column:
    """Cosine of each vector to one query, an Arrow batch at a time as a matrix product; null where a vector is null, of another length, of zero length or not finite, or the query is."""
    q = np.asarray(query, np.float32).astype(np.float64)

    @F.pandas_udf("double")
    def run(rows: pd.Series) -> pd.Series:
        out = np.full(len(rows), np.nan)
        fit = np.fromiter((r is not None and len(r) == len(q) for r in rows), bool, len(rows))
        if fit.any():
            x = np.concatenate(rows[fit].to_list()).astype(np.float64).reshape(-1, len(q))
            with np.errstate(all="ignore"):
                out[fit] = (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
        return pd.Series(np.where(np.isfinite(out), out, np.nan))

    return run(vector)


def constant(vector) -> Column:
    return F.array(*[F.lit(float(np.float32(v))).cast("float") for v in vector])


class HashingEncoder:
    """A deterministic encoder for tests and offline use: hashed words and their neighbours, weighted by sign, to unit length.

    Anything that maps a list of texts to a list of vectors can stand in its place."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            words = text.lower().split()
            for token in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
                row[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(lengths == 0, 1, lengths)).astype(np.float32).tolist()


# Names of encoder models and their dimensions; the first is the default.
MODELS = {"all-MiniLM-L6-v2": 384, "all-mpnet-base-v2": 768, "paraphrase-multilingual-MiniLM-L12-v2": 384}
_LOADERS: dict[str, Callable[[], Callable[[list[str]], list]]] = {}


def register_model(name: str, dimensions: int, load: Callable[[], Callable[[list[str]], list]]) -> None:
    """Make a model known. ``load`` runs once a worker and gives a function from texts to token vectors (a matrix and a mask a text, see ``pooled``) or to finished vectors."""
    MODELS[name], _LOADERS[name] = dimensions, load


def pooled(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors of texts: the mean of the vectors (text, token, dimension) of their tokens that the mask (text, token) keeps; zero where it keeps none."""
    weights = mask.astype(np.float64)[:, :, None]
    mean = (tokens * weights).sum(1) / np.maximum(weights.sum(1), 1)
    length = np.linalg.norm(mean, axis=1, keepdims=True)
    return mean / np.where(length == 0, 1, length)


class ModelEncoder:
    """The encoder of a named model, loaded when it is first called; until one is registered, the hashing stand-in of the model's dimensions. Travels to workers by its name."""

    def __init__(self, name: str | None = None):
        self.name = name or next(iter(MODELS))
        if self.name not in MODELS:
            raise ValueError(f"unknown model {self.name}")
        self.dimensions, self._load, self._run = MODELS[self.name], _LOADERS.get(self.name), None

    def __getstate__(self):
        return {**self.__dict__, "_run": None}

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if self._run is None:
            self._run = self._load() if self._load else HashingEncoder(self.dimensions)
        got = self._run(texts)
        out = pooled(*got) if isinstance(got, tuple) else np.asarray(got, np.float64)
        if out.shape != (len(texts), self.dimensions):
            raise ValueError(f"{self.name} gives {out.shape}, not {(len(texts), self.dimensions)}")
        return out.astype(np.float32).tolist()
