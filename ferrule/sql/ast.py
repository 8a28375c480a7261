"""Syntax trees, immutable."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Literal:
    value: int | float | str | bool | None


@dataclass(frozen=True)
class Column:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Binary:
    op: str
    left: "Expr"
    right: "Expr"


@dataclass(frozen=True)
class Unary:
    op: str  # NOT or -
    operand: "Expr"


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple["Expr", ...]


Expr = Literal | Column | Binary | Unary | Star | Call


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Key:
    expr: Expr
    ascending: bool = True


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right or cross
    table: Table
    on: Expr | None


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    first: Table
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    order: tuple[Key, ...] = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, Expr], ...]
    where: Expr | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None = None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    nullable: bool = True


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str


@dataclass(frozen=True)
class DropTable:
    table: str


Statement = Select | Insert | Update | Delete | CreateTable | CreateIndex | DropTable


def parts(e: Expr):
    """``e`` and everything below it."""
    yield e
    for x in (e.left, e.right) if isinstance(e, Binary) else (e.operand,) if isinstance(e, Unary) else e.args if isinstance(e, Call) else ():
        yield from parts(x)
