"""Project configuration: a JSON file with defaults, and what init was told."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass, field, replace

from ..sources.files import FileRules

log = logging.getLogger("siftwell")
CONFIG_NAME = ".siftwell.json"
PROVIDERS = ("auto", "hash", "ollama", "transformers", "openai")


@dataclass
class Embedding:
    provider: str = "auto"
    model: str | None = None
    batch_size: int = 100
    ollama_url: str = "http://localhost:11434"
    openai_api_key: str | None = None


@dataclass
class Config:
    embedding: Embedding = field(default_factory=Embedding)
    files: FileRules = field(default_factory=FileRules)
    max_chunk_lines: int = 100
    overlap_lines: int = 10
    default_limit: int = 10


def _number(section: dict, key: str, default: int, low: float, high: float) -> int:
    value = section.get(key, default)
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
        raise ValueError(f"{key} must be from {low} to {high}")
    return int(value)


def _strings(section: dict, key: str, default: list[str]) -> list[str]:
    value = section.get(key, default)
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ValueError(f"{key} must be a list of strings")
    return list(value)


def parse_config(data: dict) -> Config:
    """A configuration from its JSON form; missing parts have their defaults, wrong ones raise ValueError."""
    if not isinstance(data, dict) or any(not isinstance(data.get(k, {}), dict) for k in ("embedding", "files", "chunking", "search")):
        raise ValueError("sections must be objects")
    e, f, c, s = (data.get(k, {}) for k in ("embedding", "files", "chunking", "search"))
    provider = e.get("provider", "auto")
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}")
    rules = FileRules()
    rules.include, rules.exclude = _strings(f, "include", rules.include), _strings(f, "exclude", rules.exclude)
    rules.extra_exclude = _strings(f, "extraExclude", [])
    rules.max_file_size = _number(f, "maxFileSize", 1_000_000, 0, float("inf"))
    rules.git_only = f.get("gitOnly", True)
    if not isinstance(rules.git_only, bool):
        raise ValueError("gitOnly must be true or false")
    embedding = Embedding(provider, e.get("model"), _number(e, "batchSize", 100, 1, 1000), e.get("ollamaUrl", Embedding.ollama_url), e.get("openaiApiKey"))
    return Config(embedding, rules, _number(c, "maxChunkLines", 100, 10, 500), _number(c, "overlapLines", 10, 0, 50), _number(s, "defaultLimit", 10, 1, 100))


def load_config(project: str) -> Config:
    """The project's configuration, made anew for each call; a missing or wrong file gives the defaults."""
    try:
        with open(os.path.join(project, CONFIG_NAME), encoding="utf-8") as f:
            return parse_config(json.load(f))
    except FileNotFoundError:
        return Config()
    except (OSError, ValueError) as error:
        log.warning("%s can't be used, defaults apply: %s", CONFIG_NAME, error)
        return Config()


def with_overrides(config: Config, overrides: dict | None) -> Config:
    """A configuration of its own: config with what init was told."""
    told = {k: v for k, v in (overrides or {}).items() if v is not None}
    embedding = {name: told[key] for name, key in (("provider", "embeddingProvider"), ("model", "embeddingModel")) if told.get(key)}
    files = {"exclude": config.files.exclude + list(told.get("excludePatterns", ())), "include": list(told.get("includePatterns", config.files.include))}
    return replace(config, embedding=replace(config.embedding, **embedding), files=replace(config.files, **files))
