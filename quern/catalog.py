"""What the engine knows of names: tables, synonyms, sequences, object types, constraints."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from .errors import QuernError


@dataclass(frozen=True)
class Numbers:
    """Reserved numbers: the first ``left`` of them from ``first`` on, then, where the sequence cycles, rounds of ``size`` from ``restart`` on."""

    first: int
    increment: int
    left: int | None = None
    restart: int = 0
    size: int = 0

    def at(self, k: int) -> int:
        """The ``k``-th number, from 0."""
        if self.left is None or k < self.left:
            return self.first + k * self.increment
        return self.restart + (k - self.left) % self.size * self.increment

    def expression(self, k: str) -> str:
        """The same in the dialect, ``k`` being an expression."""
        plain = f"{self.first} + ({k}) * ({self.increment})"
        if self.left is None:
            return plain
        return f"CASE WHEN {k} < {self.left} THEN {plain} ELSE {self.restart} + MOD({k} - {self.left}, {self.size}) * ({self.increment}) END"


@dataclass
class Sequence:
    """Numbers in order; a statement reserves as many as it has rows."""

    name: str
    start: int = 1
    increment: int = 1
    last: int | None = None
    minimum: int | None = None
    maximum: int | None = None
    cycle: bool = False

    def reserve(self, count: int = 1) -> Numbers:
        """``count`` further numbers; a cycling sequence starts again at its other end, an exhausted one raises."""
        up = self.increment > 0
        bound, other = (self.maximum, self.minimum) if up else (self.minimum, self.maximum)
        restart = other if other is not None else (1 if up else -1)
        inside = lambda x: bound is None or (x <= bound if up else x >= bound)
        first = self.start if self.last is None else self.last + self.increment
        if not inside(first) and self.cycle:
            first = restart
        numbers = Numbers(first, self.increment)
        if bound is not None and count and not inside(first + (count - 1) * self.increment):
            if not self.cycle:
                raise QuernError(f"sequence {self.name} goes beyond {bound}")
            numbers = Numbers(first, self.increment, (bound - first) // self.increment + 1, restart, (bound - restart) // self.increment + 1)
        if count:
            self.last = numbers.at(count - 1)
        return numbers

    def nextval(self) -> int:
        return self.reserve().at(0)

    def current(self) -> int:
        if self.last is None:
            raise QuernError(f"sequence {self.name} has no current value yet")
        return self.last


@dataclass(frozen=True)
class Constraint:
    """kind: P (primary key), U (unique), R (reference), C (check)."""

    name: str
    table: str
    kind: str
    columns: tuple[str, ...] = ()
    references: str | None = None
    referenced_columns: tuple[str, ...] = ()
    condition: str | None = None
    delete_rule: str | None = None
    deferrable: bool = False


@dataclass
class Catalog:
    schema: str | None = None
    synonyms: dict[tuple[str, str], str] = field(default_factory=dict)  # (owner or PUBLIC, name) -> target
    sequences: dict[str, Sequence] = field(default_factory=dict)
    types: dict[str, T.DataType] = field(default_factory=dict)
    constraints: list[Constraint] = field(default_factory=list)
    views: dict[str, str] = field(default_factory=dict)

    def add_synonym(self, name: str, target: str, owner: str = "PUBLIC") -> None:
        self.synonyms[owner.lower(), name.lower()] = target.lower()

    def synonym(self, name: str) -> str | None:
        """The current schema's own synonym, else the public one; chains are followed."""
        seen = set()
        found = None
        while name not in seen:
            seen.add(name)
            owners = [o.lower() for o in (self.schema, "PUBLIC") if o]
            target = next((self.synonyms[o, name] for o in owners if (o, name) in self.synonyms), None)
            if target is None:
                return found
            found = name = target
        raise QuernError(f"synonym {name} is circular")

    def add_sequence(self, name: str, start: int = 1, increment: int = 1, **more) -> Sequence:
        self.sequences[name.lower()] = out = Sequence(name.lower(), start, increment, **more)
        return out

    def sequence(self, parts: tuple[str, ...]) -> Sequence:
        for key in (".".join(parts).lower(), parts[-1].lower(), self.synonym(parts[-1].lower())):
            if key in self.sequences:
                return self.sequences[key]
        raise QuernError(f"unknown sequence {'.'.join(parts)}")

    def add_types(self, declared: dict[str, dict[str, str]]) -> list[str]:
        """Object types by their attributes' Oracle types, in any order; returns the order they were built in."""
        from .types import spark_type

        needs = {t: {a.strip().lower() for a in attrs.values()} & declared.keys() for t, attrs in declared.items()}
        order: list[str] = []
        while len(order) < len(declared):
            ready = sorted(t for t in declared if t not in order and needs[t] <= set(order))
            if not ready:
                raise QuernError(f"object types depend on each other: {sorted(set(declared) - set(order))}")
            for t in ready:
                self.types[t] = T.StructType([T.StructField(a, spark_type(kind, self.types)) for a, kind in declared[t].items()])
            order += ready
        return order

    def constraint_order(self) -> list[Constraint]:
        """Primary keys, unique keys, references (referenced tables first; circles last), checks."""
        references = [c for c in self.constraints if c.kind == "R"]
        after: dict[str, set[str]] = {}
        for c in references:
            if c.references != c.table:
                after.setdefault(c.table, set()).add(c.references or "")
        rank: dict[str, int] = {}

        def depth(table: str, path: frozenset[str] = frozenset()) -> int:
            if table in rank:
                return rank[table]
            if table in path:
                return len(self.constraints)
            out = 1 + max((depth(t, path | {table}) for t in after.get(table, ())), default=0)
            if not path:
                rank[table] = out
            return out

        kinds = {"P": 0, "U": 1, "R": 2, "C": 3}
        return sorted(self.constraints, key=lambda c: (kinds[c.kind], depth(c.table) if c.kind == "R" else 0, c.table, c.name))
