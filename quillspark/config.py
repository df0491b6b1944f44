"""Configuration: defaults, profiles, environment and overrides, in this order."""

from __future__ import annotations

import os
from copy import deepcopy

DEFAULTS: dict = {
    "chunking": {"target_tokens": 600, "max_tokens": 800, "overlap_tokens": 100, "min_tokens": 40, "section_break_ratio": 1.0},
    "embedding": {"provider": "hashing", "dimension": 512, "batch_size": 32, "normalize": True},
    "retrieval": {"dense_k": 20, "lexical_k": 20, "rrf_k": 60, "candidates": 24, "fusion": "rrf"},
    "rerank": {"enabled": True, "provider": "lexical", "top_n": 5, "batch_size": 16},
    "generation": {"provider": "extractive", "max_chars_per_source": 2000, "max_context_chars": 12000, "max_tokens": 1024},
    "citations": {"min_sources": 1, "require_citations": True, "min_top_score": 0.10, "min_question_coverage": 0.60, "min_grounding": 0.30},
}
PROFILES: dict = {
    "offline": {},
    "full-retrieval": {
        "embedding": {"provider": "sentence-transformers", "dimension": 384},
        "rerank": {"provider": "cross-encoder"},
        "citations": {"min_top_score": -10.0},
    },
    "full": {
        "embedding": {"provider": "sentence-transformers", "dimension": 384},
        "rerank": {"provider": "cross-encoder"},
        "generation": {"provider": "hosted"},
        "citations": {"min_top_score": -10.0, "min_question_coverage": 0.45},
    },
}
NEEDS = {"sentence-transformers": "sentence_transformers", "cross-encoder": "sentence_transformers", "hosted": "a generator object"}
PREFIX = "QUILL_"


def merge(base: dict, extra: dict) -> dict:
    """Deep merge; ``extra`` wins."""
    out = deepcopy(base)
    for key, value in extra.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else deepcopy(value)
    return out


def _typed(old: object, text: str) -> object:
    if isinstance(old, bool):
        return text.strip().lower() in ("1", "true", "yes", "on")
    return type(old)(text) if isinstance(old, int | float) else text


def load_config(profile: str | None = None, overrides: dict | None = None, file: dict | None = None, env: dict | None = None) -> dict:
    """Effective settings. ``QUILL_<SECTION>__<KEY>`` of the environment overrides one value."""
    env = dict(os.environ) if env is None else env
    profile = profile or env.get(PREFIX + "PROFILE") or "offline"
    known = merge(PROFILES, (file or {}).get("profiles", {}))
    if profile not in known:
        raise ValueError(f"unknown profile {profile!r}; known: {', '.join(sorted(known))}")
    base = merge(DEFAULTS, {k: v for k, v in (file or {}).items() if k != "profiles"})
    config = merge(base, known[profile])
    for name, value in env.items():
        section, _, key = name.removeprefix(PREFIX).lower().partition("__")
        if name.startswith(PREFIX) and key and section in config and key in config[section]:
            config[section][key] = _typed(config[section][key], value)
    config = merge(config, overrides or {})
    check(config)
    return config | {"profile": profile}


def check(config: dict) -> None:
    from .operators.chunking import ChunkRules

    ChunkRules(**config["chunking"])
    if config["retrieval"]["fusion"] not in ("rrf", "dense_only", "lexical_only"):
        raise ValueError(f"unknown fusion {config['retrieval']['fusion']!r}")


def missing_requirements(config: dict, have: set[str]) -> list[str]:
    """What the chosen providers need and ``have`` lacks."""
    chosen = {config.get(s, {}).get("provider") for s in ("embedding", "rerank", "generation")}
    return sorted({NEEDS[p] for p in chosen if p in NEEDS} - have)
