"""Statements and predicates of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field

Literal = int | float | str | None | tuple

INDEX_KINDS = ("SEQUENTIAL", "ISAM", "BTREE", "RTREE", "HASH", "INVERTED_TEXT", "MULTIMEDIA_SEQ", "MULTIMEDIA_INV")
PRIMARY_KINDS = ("ISAM", "SEQUENTIAL", "BTREE")
MEDIA_KINDS = ("MULTIMEDIA_SEQ", "MULTIMEDIA_INV")
FEATURES = ("SIFT", "ORB", "HOG", "MFCC", "CHROMA", "SPECTRAL")


@dataclass(frozen=True)
class Type:
    """kind: INT, FLOAT, DATE, VARCHAR or ARRAY; size: bytes of VARCHAR, dimensions of ARRAY."""

    kind: str
    size: int | None = None


@dataclass(frozen=True)
class Column:
    name: str
    type: Type
    key: bool = False
    index: str | None = None


@dataclass(frozen=True)
class Equals:
    column: str
    value: Literal


@dataclass(frozen=True)
class Between:
    column: str
    low: Literal
    high: Literal


@dataclass(frozen=True)
class Within:
    """Points at most radius away."""

    column: str
    point: tuple[float, ...]
    radius: float


@dataclass(frozen=True)
class Nearest:
    column: str
    point: tuple[float, ...]
    k: int


@dataclass(frozen=True)
class Matches:
    """Full-text search."""

    column: str
    query: str


@dataclass(frozen=True)
class SimilarTo:
    """Media similarity to a file."""

    column: str
    path: str


Predicate = Equals | Between | Within | Nearest | Matches | SimilarTo


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[Column, ...]


@dataclass(frozen=True)
class LoadData:
    table: str
    path: str
    mapping: dict[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class Select:
    table: str
    columns: tuple[str, ...] | None
    where: Predicate | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Delete:
    table: str
    where: Predicate


@dataclass(frozen=True)
class CreateIndex:
    table: str
    column: str | None
    kind: str
    language: str = "spanish"
    feature: str = "SIFT"
    directory: str | None = None
    pattern: str | None = None


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class DropIndex:
    column: str
    table: str


@dataclass(frozen=True)
class AddVirtual:
    table: str
    column: str
    sources: tuple[str, ...]


@dataclass(frozen=True)
class DropVirtual:
    table: str
    column: str


Statement = CreateTable | LoadData | Select | Insert | Delete | CreateIndex | DropTable | DropIndex | AddVirtual | DropVirtual
