"""Real models behind the protocols of the operators; their packages are loaded when a model is first used."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator
from importlib import import_module

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .operators.vector import Embedder

#: Vectors of a request.
BATCH = 256


class LocalEmbedder(Embedder):
    """A sentence-transformers model, loaded once a worker."""

    def __init__(self, model: str, dims: int):
        self.name, self.dims, self._model = model, dims, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self._model is None:
            self._model = import_module("sentence_transformers").SentenceTransformer(self.name)
        return self._model.encode(texts, show_progress_bar=False).tolist()


class OpenAIEmbedder(Embedder):
    """The embeddings of the OpenAI API; the key is read from the environment of the worker."""

    def __init__(self, model: str, dims: int):
        self.name, self.dims = model, dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        client = import_module("openai").OpenAI()
        made: list[list[float]] = []
        for at in range(0, len(texts), BATCH):
            made += [d.embedding for d in client.embeddings.create(model=self.name, input=texts[at : at + BATCH]).data]
        return made


def embedder(provider: str, model: str = "", dims: int = 0) -> Embedder | None:
    """The engine that the settings name; None for 'none'."""
    made = {"local": LocalEmbedder, "openai": OpenAIEmbedder}
    if provider in ("", "none"):
        return None
    if provider not in made:
        raise ValueError(f"no embedding provider {provider!r}")
    return made[provider](model, dims)


def _openai(system: str, user: str, model: str) -> str:
    chat = import_module("openai").OpenAI().chat.completions
    said = chat.create(model=model, temperature=0.1, messages=[{"role": "system", "content": system}, {"role": "user", "content": user}])
    return said.choices[0].message.content or ""


def _anthropic(system: str, user: str, model: str) -> str:
    said = import_module("anthropic").Anthropic().messages.create(model=model, max_tokens=4096, system=system, messages=[{"role": "user", "content": user}])
    return "".join(part.text for part in said.content if part.type == "text")


def _ollama(system: str, user: str, model: str) -> str:
    where = os.environ.get("OLLAMA_URL", "http://localhost:11434").rstrip("/") + "/api/generate"
    body = json.dumps({"model": model, "system": system, "prompt": user, "stream": False}).encode()
    with urllib.request.urlopen(urllib.request.Request(where, body, {"Content-Type": "application/json"})) as answer:
        return json.load(answer).get("response", "")


class LanguageModel:
    """(system message, user message) to an answer, by provider and model."""

    PROVIDERS = {"openai": _openai, "anthropic": _anthropic, "ollama": _ollama}

    def __init__(self, provider: str, model: str):
        if provider not in self.PROVIDERS:
            raise ValueError(f"no provider {provider!r}")
        self.provider, self.model = provider, model

    def __call__(self, system: str, user: str) -> str:
        return self.PROVIDERS[self.provider](system, user, self.model)


def language_model(provider: str, model: str = "") -> LanguageModel | None:
    """The model that the settings name; None for 'none'."""
    return None if provider in ("", "none") else LanguageModel(provider, model)


def cross_encoder(model: str) -> Callable[[Column, Column], Column]:
    """A scorer of (query, content) for reranking, loaded once a worker."""

    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encoder = import_module("sentence_transformers").CrossEncoder(model)
        for query, content in pairs:
            yield pd.Series(encoder.predict(list(zip(query, content))), dtype=float)

    return lambda query, content: score(query, content)


def connect(store):
    """The store with the models that its settings name."""
    s = store.config()
    store.embedder = store.embedder or embedder(s["embedding.provider"], s["embedding.model"], int(s["embedding.dimensions"]))
    store.llm = store.llm or language_model(s["llm.provider"], s["llm.model"])
    if store.embedder and s["search.rerank"] == "true":
        store.scorer = store.scorer or cross_encoder(s["search.rerank_model"])
    return store
