"""Statements and declarations of procedural code."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..sql import ast as A


@dataclass
class Var:
    name: str
    type: str
    default: A.Node | None = None
    constant: bool = False
    not_null: bool = False


@dataclass
class CursorDecl:
    name: str
    params: list["Param"]
    query: A.Query


@dataclass
class TypeDecl:
    name: str
    kind: str  # RECORD, TABLE, VARRAY, INDEX BY
    fields: list[Var] = field(default_factory=list)
    element: str = ""
    limit: int | None = None


@dataclass
class ExceptionDecl:
    name: str


@dataclass
class Pragma:
    exception: str
    code: int


@dataclass
class Param:
    name: str
    type: str
    mode: str = "IN"
    default: A.Node | None = None


@dataclass
class Routine:
    name: str
    params: list[Param]
    returns: str | None
    block: "Block | None"


@dataclass
class Package:
    name: str
    declarations: list
    routines: list[Routine]
    init: list = field(default_factory=list)


@dataclass
class Trigger:
    name: str
    timing: str  # BEFORE, AFTER, INSTEAD OF
    events: list[str]
    table: tuple[str, ...]
    each_row: bool
    when: A.Node | None
    block: "Block"


@dataclass
class Block:
    declarations: list
    body: list
    handlers: list[tuple[list[str], list]]
    label: str | None = None


@dataclass
class Assign:
    target: A.Node
    value: A.Node


@dataclass
class If:
    branches: list[tuple[A.Node, list]]
    otherwise: list


@dataclass
class CaseStatement:
    operand: A.Node | None
    branches: list[tuple[A.Node, list]]
    otherwise: list | None


@dataclass
class Loop:
    body: list
    label: str | None = None
    condition: A.Node | None = None  # WHILE
    variable: str | None = None  # FOR
    low: A.Node | None = None
    high: A.Node | None = None
    reverse: bool = False
    query: A.Query | None = None
    cursor: A.Node | None = None


@dataclass
class Exit:
    label: str | None
    condition: A.Node | None
    again: bool = False  # CONTINUE


@dataclass
class Return:
    value: A.Node | None


@dataclass
class Raise:
    name: str | None


@dataclass
class Call:
    call: A.Node


@dataclass
class Sql:
    statement: A.Node


@dataclass
class SelectInto:
    query: A.Query
    targets: list[str]


@dataclass
class Open:
    cursor: str
    args: list[A.Node]
    query: A.Query | None = None


@dataclass
class Fetch:
    cursor: str
    targets: list[A.Node]


@dataclass
class Close:
    cursor: str


@dataclass
class Nothing:
    pass
