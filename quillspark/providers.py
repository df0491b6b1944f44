"""Registries of embedders, rerankers and generators.

A provider is any picklable object with the method its stage calls: ``embed(texts)``,
``score(queries, passages)`` or ``write(asked, blocks, gates)``, a plan from questions and numbered passages to texts.
"""

from __future__ import annotations

from collections.abc import Callable

from .operators.answering import ExtractiveGenerator, Gates, Generated, written_by
from .operators.dense import HashingEmbedder


class ModelEmbedder:
    """Sentence-embedding model, loaded once per Python worker on first use."""

    def __init__(self, load: Callable[[], object], dimension: int, batch_size: int = 32, name: str = "model") -> None:
        self.load, self.dimension, self.batch_size, self.name = load, dimension, batch_size, name
        self._model = None

    @property
    def fingerprint(self) -> str:
        return f"model:{self.name}:{self.dimension}"

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}

    def embed(self, texts):
        import numpy as np

        self._model = self._model or self.load()
        parts = [self._model.encode(texts[i : i + self.batch_size]) for i in range(0, len(texts), self.batch_size)]
        return np.vstack(parts).astype("float32") if parts else np.zeros((0, self.dimension), "float32")


class PromptedGenerator:
    """A hosted or local text model behind ``complete(system, user) -> (text, input, output)``."""

    def __init__(self, complete: Callable[[str, str], tuple[str | None, int, int]], prompt, model: str = "hosted") -> None:
        self.complete, self.prompt, self.model = complete, prompt, model

    def generate(self, question: str, blocks: list[tuple[int, str]], gates: Gates) -> Generated:
        context = "\n\n".join(f"[S{n}]\n{body}" for n, body in blocks)
        system, user = self.prompt.render(question=question, context=context, refusal_marker=gates.refusal_marker)
        text, used, made = self.complete(system, user)
        return Generated(text, used, made, self.model)

    def write(self, asked, blocks, gates: Gates):
        return written_by(self.generate, asked, blocks, gates)


class FunctionReranker:
    """A pair scorer ``score(query, passage) -> float``, in batches of ``batch_size`` pairs."""

    def __init__(self, score_pairs: Callable[[list[tuple[str, str]]], list[float]], batch_size: int = 16) -> None:
        self.score_pairs, self.batch_size = score_pairs, batch_size

    def score(self, queries: list[str], passages: list[str]) -> list[float]:
        pairs = list(zip(queries, passages, strict=True))
        return [s for i in range(0, len(pairs), self.batch_size) for s in self.score_pairs(pairs[i : i + self.batch_size])]


EMBEDDERS: dict[str, Callable] = {"hashing": HashingEmbedder}
GENERATORS: dict[str, Callable] = {"extractive": ExtractiveGenerator}
RERANKERS: dict[str, Callable] = {"function": FunctionReranker}


def create(registry: dict[str, Callable], name: str, **options):
    if name not in registry:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(registry)) or 'none'}")
    return registry[name](**options)
