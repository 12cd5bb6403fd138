"""The syntax tree: expressions, queries and data-changing statements."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


class Node:
    pass


# expressions


@dataclass
class Literal(Node):
    value: str
    kind: str  # number, string, null, true, false, date, timestamp


@dataclass
class Interval(Node):
    value: str
    first: str
    second: str | None = None


@dataclass
class Column(Node):
    parts: tuple[str, ...]
    outer: bool = False  # marked (+)

    @property
    def name(self) -> str:
        return self.parts[-1]


@dataclass
class Star(Node):
    qualifier: tuple[str, ...] = ()


@dataclass
class Bind(Node):
    name: str


@dataclass
class Window(Node):
    partition: list[Node]
    order: list["Order"]
    frame: str | None = None  # lowered text apart from bounds' expressions
    bounds: list[tuple[str, Node | None]] = field(default_factory=list)


@dataclass
class Call(Node):
    name: str  # upper case; may be qualified
    args: list[Node]
    distinct: bool = False
    over: Window | None = None
    within: list["Order"] | None = None
    keep: tuple[str, list["Order"]] | None = None
    nulls: str | None = None  # IGNORE or RESPECT


@dataclass
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass
class Unary(Node):
    op: str  # -, +, NOT, PRIOR, CONNECT_BY_ROOT
    value: Node


@dataclass
class Case(Node):
    operand: Node | None
    whens: list[tuple[Node, Node]]
    default: Node | None


@dataclass
class Cast(Node):
    value: Node
    type: str


@dataclass
class Extract(Node):
    field: str
    value: Node


@dataclass
class Trim(Node):
    side: str
    chars: Node | None
    value: Node


@dataclass
class In(Node):
    value: Node
    items: list[Node] | "Query"
    negated: bool


@dataclass
class Between(Node):
    value: Node
    low: Node
    high: Node
    negated: bool


@dataclass
class Like(Node):
    value: Node
    pattern: Node
    escape: Node | None
    negated: bool


@dataclass
class Is(Node):
    value: Node
    what: str  # NULL, NAN, INFINITE
    negated: bool


@dataclass
class Exists(Node):
    query: "Query"


@dataclass
class Quantified(Node):
    op: str
    value: Node
    which: str  # ANY, ALL
    items: list[Node] | "Query"


@dataclass
class Scalar(Node):
    query: "Query"


@dataclass
class Tuple(Node):
    items: list[Node]


@dataclass
class AtZone(Node):
    value: Node
    zone: Node


@dataclass
class Order(Node):
    value: Node
    descending: bool = False
    nulls: str | None = None  # FIRST, LAST


# queries


@dataclass
class Item(Node):
    value: Node
    alias: str | None = None


@dataclass
class Table(Node):
    name: tuple[str, ...]
    alias: str | None = None


@dataclass
class Derived(Node):
    query: "Query"
    alias: str | None = None
    lateral: bool = False


@dataclass
class Join(Node):
    left: Node
    right: Node
    kind: str  # INNER, LEFT, RIGHT, FULL, CROSS
    on: Node | None = None
    using: list[str] | None = None
    natural: bool = False


@dataclass
class Pivot(Node):
    source: Node
    aggregates: list[tuple[Node, str | None]]
    columns: list[Node]
    values: list[tuple[Node, str | None]]
    alias: str | None = None


@dataclass
class Unpivot(Node):
    source: Node
    value: str
    label: str
    columns: list[tuple[Column, str | None]]
    keep_nulls: bool = False
    alias: str | None = None


@dataclass
class Grouping(Node):
    kind: str  # ROLLUP, CUBE, GROUPING SETS
    sets: list[list[Node]]


@dataclass
class Block(Node):
    items: list[Item]
    sources: list[Node]
    where: Node | None = None
    group: list[Node] | None = None
    having: Node | None = None
    distinct: bool = False
    start: Node | None = None
    connect: Node | None = None
    nocycle: bool = False
    into: list[str] | None = None


@dataclass
class SetOp(Node):
    op: str  # UNION, UNION ALL, INTERSECT, MINUS
    left: Node
    right: Node


@dataclass
class Cte(Node):
    name: str
    columns: list[str]
    query: "Query"


@dataclass
class Query(Node):
    body: Node  # Block, SetOp or Query
    ctes: list[Cte] = field(default_factory=list)
    order: list[Order] = field(default_factory=list)
    siblings: bool = False
    offset: Node | None = None
    fetch: Node | None = None
    with_ties: bool = False


# data changes


@dataclass
class Insert(Node):
    table: tuple[str, ...]
    columns: list[str]
    values: list[Node] | None
    query: Query | None


@dataclass
class Update(Node):
    table: tuple[str, ...]
    alias: str | None
    sets: list[tuple[list[str], Node]]
    where: Node | None


@dataclass
class Delete(Node):
    table: tuple[str, ...]
    alias: str | None
    where: Node | None


@dataclass
class Merge(Node):
    table: tuple[str, ...]
    alias: str | None
    source: Node
    on: Node
    sets: list[tuple[list[str], Node]] | None = None
    update_where: Node | None = None
    delete_where: Node | None = None
    columns: list[str] | None = None
    values: list[Node] | None = None
    insert_where: Node | None = None


def _parts(value: Any):
    if isinstance(value, Node):
        yield value
    elif isinstance(value, (list, tuple)):
        for x in value:
            yield from _parts(x)


def children(node: Node):
    assert is_dataclass(node)
    for f in fields(node):
        yield from _parts(getattr(node, f.name))


def walk(node: Node, into_queries: bool = True):
    """``node`` and everything below it, top down."""
    yield node
    for child in children(node):
        if into_queries or not isinstance(child, Query):
            yield from walk(child, into_queries)


def rewritten(node: Any, change, into_queries: bool = True) -> Any:
    """A copy in which ``change`` has replaced nodes, top down; what it returns None for is kept and entered."""
    if isinstance(node, Node):
        if isinstance(node, Query) and not into_queries:
            return node
        got = change(node)
        if got is not None:
            return got
        return replace(node, **{f.name: rewritten(getattr(node, f.name), change, into_queries) for f in fields(node)})
    if isinstance(node, list):
        return [rewritten(x, change, into_queries) for x in node]
    if isinstance(node, tuple):
        return tuple(rewritten(x, change, into_queries) for x in node)
    return node


def conjuncts(node: Node | None) -> list[Node]:
    if node is None:
        return []
    if isinstance(node, Binary) and node.op == "AND":
        return conjuncts(node.left) + conjuncts(node.right)
    return [node]


def conjunction(parts: list[Node]) -> Node | None:
    out = None
    for p in parts:
        out = p if out is None else Binary("AND", out, p)
    return out
