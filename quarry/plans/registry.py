"""Registry of query plans: name → (spark builder, DuckDB oracle text or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Plan:
    name: str
    build: Builder
    oracle: str | None
    ops: tuple[str, ...]


PLANS: dict[str, Plan] = {}


def register(name: str, oracle: str | None, ops: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in PLANS:
            raise ValueError(f"duplicate plan {name}")
        PLANS[name] = Plan(name, fn, oracle, tuple(ops.split()))
        return fn
    return deco


def load_all() -> dict[str, Plan]:
    # importing the plan modules fills PLANS
    from . import querylog_plans  # noqa: F401
    for mod in ("constructs", "corpus_plans", "io_plans", "catalog_plans", "prompt_plans",
                "linking_plans", "scoring_plans", "slots_plans", "function_plans"):
        __import__(f"{__package__}.{mod}")
    return PLANS
