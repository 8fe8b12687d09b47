"""Query trees. Nodes are frozen: equal trees are equal, and a tree is its own duplicate."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1


class Node:
    def children(self) -> tuple[Node, ...]:
        return ()

    def positive_terms(self) -> frozenset[Term]:
        """The terms a match can owe itself to: all leaves but those that a difference takes away."""
        return frozenset().union(*(c.positive_terms() for c in self.children()))

    def leaves(self) -> tuple[Node, ...]:
        """Distinct leaves, in order."""
        return tuple(dict.fromkeys(x for c in self.children() for x in c.leaves())) if self.children() or isinstance(self, _Many) else (self,)

    def duplicate(self) -> Node:
        return replace(self)


@dataclass(frozen=True)
class Term(Node):
    """Documents with exactly this term; `millis` bounds the evaluation of the request it stands in."""

    field: str
    term: str
    millis: int | None = field(default=None, compare=False)

    def positive_terms(self) -> frozenset[Term]:
        return frozenset([self])

    def __str__(self) -> str:
        return f"field: {self.field}; term: {self.term}"


@dataclass(frozen=True)
class Range(Node):
    """Documents with an integer token from start to end, both included."""

    field: str
    start: int
    end: int

    def __post_init__(self) -> None:
        for bound in (self.start, self.end):
            if not INT_MIN <= bound <= INT_MAX:
                raise ValueError(f"{bound} is no 32-bit integer")

    def __str__(self) -> str:
        return f"field: {self.field}; start: {self.start}; end: {self.end}"


@dataclass(frozen=True)
class MatchAll(Node):
    def __str__(self) -> str:
        return "<MatchAllQuery>"


@dataclass(frozen=True)
class Phrase(Node):
    """Documents with all terms of a field at the given distances from one place."""

    field: str
    terms: tuple[str, ...]
    positions: tuple[int, ...]

    def __post_init__(self) -> None:
        if self.field is None or self.terms is None or not self.terms:
            raise ValueError("a phrase needs a field and at least one term")
        if len(self.terms) != len(self.positions):
            raise ValueError("a phrase needs a position for each term")
        if any(t is None for t in self.terms):
            raise ValueError("a term of a phrase is missing")

    def positive_terms(self) -> frozenset[Term]:
        return frozenset(Term(self.field, t) for t in self.terms)

    def __str__(self) -> str:
        return f"field: {self.field}; terms: {list(self.terms)}; positions: {list(self.positions)}"


@dataclass(frozen=True)
class _Many(Node):
    nodes: tuple[Node, ...]

    def children(self) -> tuple[Node, ...]:
        return self.nodes


@dataclass(frozen=True)
class And(_Many):
    def __post_init__(self) -> None:
        if not self.nodes:
            raise ValueError("an intersection of nothing")

    def __str__(self) -> str:
        return " AND ".join(f"( {c} ) " for c in self.nodes)


@dataclass(frozen=True)
class Or(_Many):
    def __str__(self) -> str:
        return " OR ".join(f"( {c} ) " for c in self.nodes)


@dataclass(frozen=True)
class Difference(Node):
    left: Node
    right: Node

    def children(self) -> tuple[Node, ...]:
        return (self.left, self.right)

    def positive_terms(self) -> frozenset[Term]:
        return self.left.positive_terms()

    def __str__(self) -> str:
        return f"( {self.left} ) - ( {self.right} )"


@dataclass(frozen=True)
class Query:
    """A tree, what it was parsed from, and when, in seconds."""

    root: Node
    text: str
    now: int = field(default_factory=lambda: int(time.time()))


def normalised(node: Node) -> Node:
    """An equal query with nested intersections and unions flattened, equal children once, and what is plainly empty
    or all folded."""
    empty = Or(())
    if isinstance(node, Difference):
        left, right = normalised(node.left), normalised(node.right)
        if left == right or left == empty or isinstance(right, MatchAll):
            return empty
        return left if right == empty else Difference(left, right)
    if isinstance(node, _Many):
        kind, flat = type(node), []
        for child in map(normalised, node.nodes):
            flat += child.nodes if isinstance(child, kind) else [child]
        flat = list(dict.fromkeys(flat))
        if kind is And:
            if empty in flat:
                return empty
            flat = [c for c in flat if not isinstance(c, MatchAll)] or [MatchAll()]
        elif any(isinstance(c, MatchAll) for c in flat):
            return MatchAll()
        return flat[0] if len(flat) == 1 else kind(tuple(flat))
    if isinstance(node, Range) and node.start > node.end:
        return empty
    return node
