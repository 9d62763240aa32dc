"""Operations of a training-data pipeline. Nothing else in the library imports this package."""

from __future__ import annotations


def queries() -> dict:
    from plinth.llm.entries import QUERIES

    return dict(QUERIES)


def oracles() -> dict[str, str]:
    from plinth.llm.entries import ORACLES

    return dict(ORACLES)
