"""The defaults of all stages in one frozen object.

Operators take these values as keyword arguments, of() picks those that an operator knows: a run
with another window is ``zscore(series, **of(Series(window=14), zscore))``.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any


@dataclass(frozen=True)
class Stories:
    """Duplicate pairs and their split into stories."""

    k: int = 5
    days: int = 3
    threshold: float = 0.9
    max_size: int = 60
    start: float = 0.90
    step: float = 0.01
    cap: float = 0.98


@dataclass(frozen=True)
class Entities:
    """Candidate edges of forms and their batches."""

    k: int = 10
    threshold: float = 0.85
    max_size: int = 20
    start: float = 0.85
    step: float = 0.02
    cap: float = 0.99
    max_group: int = 20
    size: int = 100
    min_stories: int = 100
    shortest: int = 3


@dataclass(frozen=True)
class Series:
    """Daily series, outliers and bursts."""

    top_entities: int = 300
    window: int = 28
    threshold: float = 3.0
    min_stories: int = 5
    s: float = 2.0
    gamma: float = 1.0
    margin: int = 3


@dataclass(frozen=True)
class Network:
    """Co-occurrence graphs of the whole time and of months."""

    min_stories: int = 10
    min_pair: int = 5
    min_pmi: float = 1.0
    strong: int = 5
    alpha: float = 0.85
    quantile: float = 0.9


@dataclass(frozen=True)
class Params:
    """All stages."""

    stories: Stories = Stories()
    entities: Entities = Entities()
    series: Series = Series()
    network: Network = Network()


def of(stage: Stories | Entities | Series | Network, operator: Callable[..., Any]) -> dict[str, Any]:
    """The stage's values that ``operator`` has parameters for."""
    known = inspect.signature(operator).parameters
    return {f.name: getattr(stage, f.name) for f in fields(stage) if f.name in known}
