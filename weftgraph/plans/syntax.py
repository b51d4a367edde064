"""The statements of the graph language as data."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from ..model import VertexPattern
from ..operators.pattern import Condition, Hop


@dataclass(frozen=True)
class Ref:
    """Vertices that have a key, with a value if one is given (EXISTS if not)."""

    key: str
    value: Any


@dataclass(frozen=True)
class CreateVertex:
    attrs: dict[str, Any]
    type: str | None = None
    positional: tuple = ()


@dataclass(frozen=True)
class CreateEdge:
    source: Ref
    target: Ref
    attrs: dict[str, Any]
    both: bool


@dataclass(frozen=True)
class CreateType:
    name: str
    keys: tuple[str, ...]


@dataclass(frozen=True)
class ChangeVertex:
    at: Ref
    attrs: dict[str, Any]
    strict: bool = False  # every key must be there already
    type: str | None = None
    positional: tuple = ()


@dataclass(frozen=True)
class DropAttributes:
    at: Ref
    keys: tuple[str, ...]


@dataclass(frozen=True)
class DeleteVertex:
    at: Ref | None = None
    id: str | None = None


@dataclass(frozen=True)
class DeleteType:
    name: str | None = None
    id: str | None = None


@dataclass(frozen=True)
class DeleteEdge:
    source: Ref
    target: Ref
    keys: tuple[str, ...]


@dataclass(frozen=True)
class ChangeType:
    name: str
    new_name: str | None = None
    renamed: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class SelectTypes:
    name: str | None = None
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class SelectEdges:
    source: VertexPattern
    target: VertexPattern
    conditions: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class SelectVertices:
    pattern: VertexPattern


@dataclass(frozen=True)
class MatchPath:
    """The variable's pattern is the end of the path."""

    start: VertexPattern
    hops: tuple[Hop, ...]


@dataclass(frozen=True)
class MatchStar:
    """The variable's pattern is the subject that all hops start from."""

    subject: VertexPattern
    hops: tuple[Hop, ...]
