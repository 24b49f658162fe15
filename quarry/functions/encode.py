"""Text encoders: a small protocol, a deterministic hashing encoder, and the Arrow stage that runs one over a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType


class Encoder(Protocol):
    """Texts to vectors. An encoder that tells queries from documents also has encode_query and encode_document."""

    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


def encoding(encoder: Encoder, role: str):
    """The encoder's method for a role (query or document), else the one for any text."""
    return getattr(encoder, f"encode_{role}", None) or encoder.encode


def encoder_for(model: str, dimension: int = 0) -> Encoder:
    """The encoder of a model by its name. Only hashing-<dimension> needs no files; any other name raises, rather than pass for that model."""
    kind, _, n = model.partition("-")
    if kind != "hashing" or not n.isdigit() or int(n) < 1:
        raise ValueError(f"no files of the model {model!r} are at hand: give its encoder, or use hashing-<dimension>")
    if dimension not in (0, int(n)):
        raise ValueError(f"{model} has the dimension {n}, not {dimension}")
    return HashingEncoder(int(n))


class HashingEncoder:
    """Signed hashes of words and character trigrams, L2-normalised. It needs no model files."""

    def __init__(self, dimension: int = 256):
        if dimension <= 0:
            raise ValueError("the dimension must be positive")
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            words = (t or "").lower().split()
            for f in [*words, *(f"#{w}#"[k : k + 3] for w in words for k in range(len(w)))]:
                h = xxhash.xxh64_intdigest(f)
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(n, dimension) means of the token states (n, tokens, dimension) over the tokens that the mask has; zero without any."""
    weight = np.asarray(mask, np.float32)[:, :, None]
    return (np.asarray(states, np.float32) * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)


class PooledEncoder:
    """A token model as an encoder: mean-pooled states, L2-normalised unless that is turned off.

    tokenize(texts, max_length) gives (ids, mask), model(ids, mask) the token states; both are given, since no model weights are at hand.
    """

    def __init__(self, tokenize, model, dimension: int, *, normalize: bool = True, max_length: int = 512, query_prefix: str = "", document_prefix: str = ""):
        self.tokenize, self.model, self.dimension = tokenize, model, dimension
        self.normalize, self.max_length = normalize, max_length
        self.prefix = {"query": query_prefix, "document": document_prefix}

    def encode(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.dimension), np.float32)
        ids, mask = self.tokenize(texts, self.max_length)
        out = mean_pool(self.model(ids, mask), mask)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0) if self.normalize else out

    def _as(self, role: str, texts: list[str]) -> np.ndarray:
        p = self.prefix[role]
        return self.encode([t if not t or t.startswith(p) else p + t for t in texts])

    def encode_query(self, texts: list[str]) -> np.ndarray:
        return self._as("query", texts)

    def encode_document(self, texts: list[str]) -> np.ndarray:
        return self._as("document", texts)


def checked(vectors, rows: int, dimension: int) -> np.ndarray:
    """The encoder's answer as (rows, dimension) finite float32, else an error."""
    v = np.asarray(vectors, np.float32)
    if v.ndim != 2 or v.shape[0] != rows:
        raise ValueError(f"the encoder gave {v.shape} for {rows} texts")
    if v.shape[1] != dimension:
        raise ValueError(f"the encoder gave dimension {v.shape[1]}, not {dimension}")
    if not np.isfinite(v).all():
        raise ValueError("the encoder gave values that aren't finite")
    return v


def encode(df: DataFrame, encoder: Encoder, *, text: str, out: str = "vector", batch: int = 32, role: str = "document") -> DataFrame:
    """df with the vector of each text in place of the text. The other columns pass as Arrow columns, untouched."""
    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, text)
    schema = StructType([*rows.schema.fields[:-1], StructField(out, ArrayType(FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = encoding(encoder, role)
        for b in batches:
            texts = [t or "" for t in b.column(len(keep)).to_pylist()]
            vectors = [checked(call(texts[k : k + batch]), len(texts[k : k + batch]), encoder.dimension) for k in range(0, len(texts), batch)]
            flat = np.concatenate([v.reshape(-1) for v in vectors]) if vectors else np.zeros(0, np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * encoder.dimension), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], lists], names=[*keep, out])

    return rows.mapInArrow(run, schema)
