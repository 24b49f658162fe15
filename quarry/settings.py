"""Settings of the engine, with their defaults, from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path

from quarry.operators.ranking import Weights
from quarry.operators.retrieval import PREFETCH, RRF_K

# The number types of encoders.
DTYPES = ("float16", "bfloat16", "float32")
# Texts that mean yes.
YES = ("1", "true", "yes", "on")


@dataclass(frozen=True)
class ModelSpec:
    """What an encoder needs to know: its dimension, the texts put before queries and documents, and the longest sequence."""

    name: str
    dimension: int
    query_prefix: str = ""
    document_prefix: str = ""
    normalize: bool = True
    max_sequence_length: int = 512
    dtype: str = "float32"


# The models whose dimensions and prefixes are known.
MODELS = {
    s.name: s
    for s in (
        ModelSpec("paraphrase-multilingual-MiniLM-L12-v2", 384),
        ModelSpec("intfloat/multilingual-e5-base", 768, "query: ", "passage: "),
        ModelSpec("BAAI/bge-m3", 1024, dtype="float16"),
    )
}


def model_spec(name: str) -> ModelSpec:
    """A known model, or a hashing encoder (hashing-<dimension>); of any other the dimension isn't known (0)."""
    kind, _, size = name.rpartition("-")
    return MODELS.get(name) or ModelSpec(name, int(size) if kind == "hashing" and size.isdigit() else 0)


@dataclass(frozen=True)
class Settings:
    model: str = "hashing-256"
    revision: str = ""
    dimension: int = 256
    dtype: str = "float32"
    normalize: bool = True
    max_sequence_length: int = 512
    dense_batch_size: int = 32
    index_root: str = "index"
    prefetch: int = PREFETCH
    limit: int = 20
    limit_max: int = 100
    query_chars: int = 512
    rrf_k: int = RRF_K
    min_score: float | None = None
    weights: Weights = field(default_factory=Weights)

    def for_model(self, name: str) -> Settings:
        """These settings with another model and what follows from it."""
        s = model_spec(name)
        return replace(self, model=name, dimension=s.dimension or self.dimension, dtype=s.dtype, normalize=s.normalize, max_sequence_length=s.max_sequence_length)


def from_environment(env: Mapping[str, str] | None = None) -> Settings:
    """Settings from variables; what isn't set has its default, what can't be is an error that names the variable."""
    env = os.environ if env is None else env
    spec = model_spec(env.get("EMBEDDING_MODEL", Settings.model))

    def number(name: str, default, kind=int, least=None):
        try:
            value = kind(env.get(name, default))
        except ValueError:
            raise ValueError(f"{name} must be a number, not {env[name]!r}") from None
        if least is not None and value < least:
            raise ValueError(f"{name} must be {least} or more")
        return value

    dtype = env.get("EMBEDDING_DTYPE", spec.dtype).strip() or "float32"
    if dtype not in DTYPES:
        raise ValueError(f"Unsupported embedding dtype: {dtype}")
    w = Weights()
    yes = env.get("EMBEDDING_NORMALIZE")
    s = Settings(
        model=spec.name,
        revision=env.get("EMBEDDING_REVISION", "").strip(),
        dimension=number("EMBEDDING_DIMENSION", spec.dimension, least=1),
        dtype=dtype,
        normalize=spec.normalize if yes is None else yes.strip().lower() in YES,
        max_sequence_length=number("EMBEDDING_MAX_SEQ_LENGTH", spec.max_sequence_length, least=1),
        dense_batch_size=number("DENSE_BATCH_SIZE", 32, least=1),
        index_root=env.get("INDEX_ROOT", Settings.index_root),
        prefetch=number("SOURCE_CANDIDATE_LIMIT", PREFETCH, least=1),
        limit=number("RESULT_LIMIT_DEFAULT", 20, least=1),
        limit_max=number("RESULT_LIMIT_MAX", 100, least=1),
        weights=replace(
            w,
            hybrid=number("SOURCE_SCORE_HYBRID_WEIGHT", w.hybrid, float),
            exactness=number("SOURCE_SCORE_TEXT_EXACTNESS_WEIGHT", w.exactness, float),
            fields=number("SOURCE_SCORE_FIELD_WEIGHT", w.fields, float),
        ),
    )
    if s.limit > s.limit_max:
        raise ValueError("RESULT_LIMIT_DEFAULT is above RESULT_LIMIT_MAX")
    return s


def cached_model(name: str, revision: str | None = None, root: str | Path | None = None) -> Path | None:
    """The folder of a model's files in the local model cache, None if there is none; nothing is fetched.

    Looked for in this order: the revision asked for, the one that the cache calls main, the last one by name. A revision counts
    if its files have been fetched (config.json is there).
    """
    root = Path(root or Path(os.environ.get("HF_HOME") or Path.home() / ".cache" / "huggingface") / "hub")
    home = root / f"models--{name.replace('/', '--')}"
    main = home / "refs" / "main"
    known = sorted(p.parent.name for p in home.glob("snapshots/*/config.json"))
    wanted = [revision, main.read_text(encoding="utf-8").strip() if main.is_file() else None, *reversed(known)]
    return next((home / "snapshots" / r for r in wanted if r and r in known), None)
