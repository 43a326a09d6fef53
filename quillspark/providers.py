"""Embedding and generation providers.

A provider gives columns: ``embed`` turns a text column into an array<double> column, ``generate`` a prompt into an
answer.  The default is offline and deterministic.  Remote ones run in Arrow batches with retries.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import api_key
from .functions.prompts import SYSTEM
from .functions.vectors import hashed_embedding

BATCH, ATTEMPTS = 32, 3


def with_retries(call: Callable, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep, what: str = "embed batch"):
    """The call's result; waits 2, 4, ... seconds between failures."""
    if attempts < 1:
        raise ValueError("at least one attempt")
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            if attempt == attempts:
                raise RuntimeError(f"Failed to {what} after {attempts} attempts: {e}") from e
            wait(2**attempt)


def in_batches(texts: list[str], embed: Callable[[list[str]], list[list[float]]], size: int = BATCH, **retry) -> list[list[float]]:
    out: list[list[float]] = []
    for at in range(0, len(texts), size):
        part = texts[at : at + size]
        got = with_retries(lambda part=part: embed(part), **retry)
        if len(got) != len(part):
            raise RuntimeError(f"{len(part)} texts gave {len(got)} embeddings")
        out += got
    return out


class Offline:
    """Hashed token counts, and an extractive answer: the first block of the context."""

    name = "offline"

    def __init__(self, dim: int = 256) -> None:
        self.dim = dim

    def embed(self, text: Column | str, task: str = "RETRIEVAL_DOCUMENT") -> Column:
        return hashed_embedding(text, self.dim)

    def generate(self, prompt: Column | str) -> Column:
        context = F.regexp_extract(prompt, r"(?s)^CONTEXT:\n(.*)\n\nQUESTION:\n", 1)
        return F.btrim(F.element_at(F.split(context, "\n\n---\n\n"), 1))


class Remote:
    """Wraps factories of remote clients; a factory runs once in each task, never on the driver.

    Texts go in batches with retries; the embedding of a question is one call without.
    """

    def __init__(
        self,
        embedder: Callable[[], Callable[[list[str], str], list[list[float]]]],
        generator: Callable[[], Callable[[str], str]],
        name: str = "remote",
    ) -> None:
        self.embedder, self.generator, self.name = embedder, generator, name

    def embed(self, text: Column | str, task: str = "RETRIEVAL_DOCUMENT") -> Column:
        make = self.embedder

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            client = make()
            for texts in batches:
                if task == "RETRIEVAL_QUERY":
                    yield pd.Series([client([t], task)[0] for t in texts], dtype=object)
                else:
                    yield pd.Series(in_batches(texts.tolist(), lambda part: client(part, task)), dtype=object)

        return run(text)

    def generate(self, prompt: Column | str) -> Column:
        make = self.generator

        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            client = make()
            for prompts in batches:
                yield prompts.map(lambda p: (with_retries(lambda: client(p), what="generate") or "").strip())

        return run(prompt)


# The models that are used if no other is named.
GENERATION_MODEL = "gemini-2.5-flash"
EMBEDDING_MODEL = "gemini-embedding-001"


def genai_embedder(key: str, model: str) -> Callable[[list[str], str], list[list[float]]]:
    """Embeds a batch of texts for a task by the google-genai package."""
    from google import genai
    from google.genai import types

    models = genai.Client(api_key=key).models
    return lambda texts, task: [
        list(e.values) for e in models.embed_content(model=model, contents=texts, config=types.EmbedContentConfig(task_type=task)).embeddings
    ]


def genai_generator(key: str, model: str, system: str | None, temperature: float | None) -> Callable[[str], str]:
    """Answers a prompt under a system instruction by the google-genai package."""
    from google import genai
    from google.genai import types

    models = genai.Client(api_key=key).models
    given = {k: v for k, v in (("system_instruction", system), ("temperature", temperature)) if v is not None}
    return lambda prompt: models.generate_content(model=model, contents=prompt, config=types.GenerateContentConfig(**given)).text


class Gemini(Remote):
    """The remote provider; without a key it is refused before anything runs.

    ``flat`` has no system instruction and temperature 0, as the full-rebuild mode wants it.
    """

    def __init__(self, key: str | None = None, generation: str = GENERATION_MODEL, embedding: str = EMBEDDING_MODEL, flat: bool = False) -> None:
        found = api_key(key)
        system, temperature = (None, 0.0) if flat else (SYSTEM, None)
        super().__init__(partial(genai_embedder, found, embedding), partial(genai_generator, found, generation, system, temperature), f"gemini/{embedding}")


PROVIDERS = ("offline", "gemini")


def named(name: str, flat: bool = False):
    """The provider of a name."""
    if name not in PROVIDERS:
        raise OSError(f"no provider {name!r}: there are {', '.join(PROVIDERS)}")
    return Gemini(flat=flat) if name == "gemini" else Offline()
