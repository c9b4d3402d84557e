"""Embedding tables with a manifest: built by any provider, in Arrow batches, and checked before use."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_provider(dimensions: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A provider without a model: words hashed to signed dimensions. Alike in every process."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, text in enumerate(texts):
            for w in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % dimensions] += 1 if h >> 63 else -1
        return out

    return embed


def build_embeddings(units: DataFrame, key: str, provider: Callable[[list[str]], np.ndarray], batch: int = 128) -> DataFrame:
    """Units with unit-length vectors of their text; a zero vector stays zero, a null text has none."""
    kind = dict(units.dtypes)[key]

    def embed(frames):
        for pdf in frames:
            pdf = pdf[pdf["text"].notna()]
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                v = provider(part["text"].tolist())
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list((v / np.where(norm == 0, 1, norm)).astype(np.float32))})

    return units.select(key, "text").mapInPandas(embed, f"{key} {kind}, embedding array<float>")


def select_units(units: DataFrame, sections: list[str] | None = None, include_footnotes: bool = False) -> DataFrame:
    """Paragraphs to embed: all, or those of the sections and, on request, footnotes (alone, where no section is named)."""
    foot = F.col("footnote_id").isNotNull()
    if sections:
        return units.where(F.col("section").isin(sections) | (foot if include_footnotes else F.lit(False)))
    return units.where(foot) if include_footnotes else units


def manifest(vectors: DataFrame, key: str, **described) -> dict:
    """Rows, dimensions, an order-free checksum of keys and vectors, and whatever else describes the table."""
    mark = F.xxhash64(F.col(key).cast("string"), F.col("embedding").cast("string")).cast("decimal(38,0)")
    r = vectors.agg(F.count("*").alias("rows"), F.max(F.size("embedding")).alias("dimensions"), F.sum(mark).alias("checksum")).first()
    return {"rows": r.rows, "dimensions": r.dimensions, "checksum": str(r.checksum), **described}


def verify(vectors: DataFrame, key: str, expected: dict | str) -> None:
    """Raises where the table isn't the one that the manifest describes."""
    want = json.loads(expected) if isinstance(expected, str) else expected
    have = manifest(vectors, key)
    wrong = [k for k in have if have[k] != want.get(k)]
    if wrong:
        raise ValueError(f"embeddings differ from their manifest in {wrong}")
