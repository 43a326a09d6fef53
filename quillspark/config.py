"""Settings of the engine."""

from __future__ import annotations

import os
from dataclasses import dataclass

# Suffixes of supported files, defaults of the settings, names of the environment variables.
SUFFIXES = (".pdf", ".docx", ".txt", ".md", ".markdown", ".csv")
FLAT_SUFFIXES = (".pdf", ".docx", ".txt", ".md", ".csv")


@dataclass(frozen=True)
class Settings:
    top_k: int = 5
    min_score: float = 0.55
    chunk_size: int = 1000
    overlap: int = 150
    dim: int = 256

    def __post_init__(self) -> None:
        if not 0 < self.overlap < self.chunk_size:
            raise ValueError("overlap must lie between 0 and chunk_size")
        if self.top_k < 0:
            raise ValueError("top_k must not be negative")


def flat_settings() -> Settings:
    """Settings of the full-rebuild mode, from the environment: top 4 and no threshold."""
    env = os.environ.get
    return Settings(int(env("RETRIEVAL_TOP_K", "4")), float("-inf"), int(env("CHUNK_SIZE", "1000")), int(env("CHUNK_OVERLAP", "150")))


def api_key(given: str | None = None) -> str:
    """The given key, else the first of two variables that is set."""
    key = given or os.environ.get("GEMINI_API_KEY") or os.environ.get("GOOGLE_API_KEY")
    if not key:
        raise OSError("no API key: set GEMINI_API_KEY or GOOGLE_API_KEY")
    return key


def load_env(path: str = ".env") -> None:
    """Variables of a file of ``NAME=value`` lines that the environment does not set itself."""
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                name, found, value = line.strip().removeprefix("export ").partition("=")
                if found and name.strip().isidentifier():
                    os.environ.setdefault(name.strip(), value.strip().strip("'\""))
