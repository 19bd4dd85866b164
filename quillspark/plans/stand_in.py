"""Deterministic stand-in for the caller's rewriting model."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle

# Python workers get these functions by value, so they need not import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stand_in_rewriter():
    """Drops punctuation; answers nothing at all for texts that mention "this"."""
    def run(texts: pd.Series, hints: pd.Series) -> pd.Series:
        said = texts.str.replace(r"[.,?!;:]", "", regex=True)
        return said.where(~texts.str.contains("this", regex=False), "") + hints
    return run


def failing_rewriter():
    """Raises for texts that mention "this"."""
    def run(texts: pd.Series, hints: pd.Series) -> pd.Series:
        if texts.str.contains("this", regex=False).any():
            raise ValueError("model refused")
        return texts.str.replace(r"[.,?!;:]", "", regex=True)
    return run


def length_tokenizer():
    """One id per white-space token: its length in characters."""
    def run(texts: pd.Series) -> list[list[int]]:
        return [[len(w) for w in words] for words in texts.str.split()]
    return run
