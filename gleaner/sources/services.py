"""What the engine takes from outside: encoders, rerankers, generators.

The defaults need no model and no network: a hashing encoder and a generator that
returns its prompt.  Others plug in by the same signatures.
"""

from __future__ import annotations

import json
import urllib.request
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def __call__(self, pairs: list[tuple[str, str]]) -> np.ndarray: ...


class Generator(Protocol):
    def __call__(self, prompt: str) -> str: ...


class HashingEncoder:
    """Signed feature hashing of lower-case words into unit vectors."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.size), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % self.size] += 1 if h & 0x10000 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def encode(text: Column, encoder: Encoder | None = None, batch: int = 32) -> Column:
    """A vector (array<float>) for each text."""
    encoder = encoder or HashingEncoder()

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        rows = texts.fillna("").tolist()
        return pd.Series([v for i in range(0, len(rows), batch) for v in np.asarray(encoder(rows[i : i + batch]), np.float32)])

    return run(text)


def scorer(reranker: Reranker):
    """(question, text) -> score column for ranking.rerank()."""

    @F.pandas_udf("double")
    def run(questions: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(reranker(list(zip(questions, texts, strict=True))), float))

    return run


def answers(prompts: DataFrame, generator: Generator) -> DataFrame:
    """(query_id, answer, error) of ``prompts`` (query_id, prompt); a failed call
    gives its error instead of stopping the rest."""

    def run(batches):
        for rows in batches:
            out = []
            for query, prompt in zip(rows["query_id"], rows["prompt"], strict=True):
                try:
                    out.append((query, generator(prompt), None))
                except Exception as e:  # a service's failure is a result here
                    out.append((query, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["query_id", "answer", "error"])

    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {prompts.schema['query_id'].dataType.simpleString()}, answer string, error string")


class ChatService:
    """A generator over HTTP with ``messages``, and its list of models."""

    def __init__(self, url: str, model: str, timeout: float = 120.0):
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout

    def __call__(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}], "stream": False}).encode()
        request = urllib.request.Request(f"{self.url}/api/chat", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["message"]["content"]

    def models(self, timeout: float = 10.0) -> list[str]:
        with urllib.request.urlopen(f"{self.url}/api/tags", timeout=timeout) as reply:
            return [m["name"] for m in json.load(reply).get("models", [])]
