"""Declarative specifications that operators take instead of fixed column names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column


@dataclass(frozen=True)
class DimensionSpec:
    """A dimension: its name, id column, and the source columns that identify a row of it."""

    name: str
    id_column: str
    columns: tuple[str, ...]
    prefix: str = ""

    @property
    def key_prefix(self) -> str:
        return self.prefix or self.name


@dataclass(frozen=True)
class FactSpec:
    identifiers: tuple[str, ...]
    measures: tuple[str, ...]


@dataclass(frozen=True)
class LabelSpec:
    """Outcome components by name; the outcome holds if any component does."""

    outcome: str
    components: dict[str, Callable[[], Column]] = field(default_factory=dict)


@dataclass(frozen=True)
class BinSpec:
    column: str
    edges: tuple[float, ...]
    labels: tuple[str, ...]


@dataclass(frozen=True)
class ContextSpec:
    """A family of context nodes and the column that holds its values."""

    family: str
    column: str


@dataclass(frozen=True)
class MetricSpec:
    """A measure of a comparison; ``only`` restricts a source to one context value."""

    name: str
    column: str
    only: dict[str, str] = field(default_factory=dict)
