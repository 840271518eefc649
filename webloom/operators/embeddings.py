"""Embedding jobs with a pluggable encoder, and which rows need one."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], list[list[float]]]
_WORD = re.compile(r"\w+")


class HashedWords:
    """Bag of words by MD5, unit length: the encoder where no model is at hand; the same on every machine."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for w in _WORD.findall(text.lower()):
                row[int(hashlib.md5(w.encode()).hexdigest(), 16) % self.dim] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()


def pending(signatures: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Signatures (url_id, text, signature_hash) the model has no vector of the same hash for.  stored: url_id, signature_hash, embedding_model."""
    done = stored.where(F.col("embedding_model") == model).select("url_id", "signature_hash")
    return signatures.where("text <> ''").join(done, ["url_id", "signature_hash"], "left_anti")


def embed(rows: DataFrame, encoder: Encoder, model: str, batch: int = 256) -> DataFrame:
    """rows (url_id, text, signature_hash) with their vector and model; the encoder sees ``batch`` texts at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = [v for at in range(0, len(pdf), batch) for v in encoder(pdf.text.iloc[at : at + batch].tolist())]
            yield pd.DataFrame({"url_id": pdf.url_id, "signature_hash": pdf.signature_hash, "embedding": vectors, "embedding_model": model})

    return rows.select("url_id", "text", "signature_hash").mapInPandas(run, "url_id long, signature_hash string, embedding array<float>, embedding_model string")


def single_model(rows: DataFrame) -> str | None:
    """The one model of the rows; several are an error, none is None."""
    models = [r.embedding_model for r in rows.where("embedding_model is not null").select("embedding_model").distinct().limit(2).collect()]
    if len(models) > 1:
        raise ValueError("vectors of several models can't be compared: " + ", ".join(sorted(models)))
    return models[0] if models else None
