"""The query modules of the core."""

from __future__ import annotations

from averis.plans import corpora, delivery, evaluation, scoring, stream, texts, vectors


def modules() -> list:
    return [delivery, evaluation, corpora, texts, vectors, scoring, stream]
