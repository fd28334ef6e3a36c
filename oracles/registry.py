"""Expected-result statements by query name."""
from __future__ import annotations

from quillfolio.plans.registry import QUERIES

from .base import formatted

ORACLES: dict[str, str] = {}


def oracle(name: str, body: str, *needs: str) -> None:
    ORACLES[name] = formatted(QUERIES[name].spec, body, *needs)
