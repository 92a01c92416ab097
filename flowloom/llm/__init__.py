"""Operators for preparing training text, each with its query on the driver's tables."""

from __future__ import annotations

from .common import ORACLES, QUERIES
from . import chat, context_mixing, decontaminate, jaccard_join, language, mixing, negatives, pii, quality, seed_extend, suffix, token_count, trie  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
