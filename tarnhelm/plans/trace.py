"""Provenance of a governed query as a DAG of operators, and matching it against an expected one."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field


@dataclass
class Trace:
    """Nodes are numbered operators; an edge goes from an input to the operator that read it."""

    ops: list[str] = field(default_factory=list)
    inputs: list[tuple[int, ...]] = field(default_factory=list)

    def add(self, op: str, *inputs: int) -> int:
        self.ops.append(op)
        self.inputs.append(inputs)
        return len(self.ops) - 1

    def edges(self) -> list[tuple[int, int]]:
        return [(p, i) for i, ps in enumerate(self.inputs) for p in ps]

    def rows(self) -> list[tuple[int, str, int | None, int | None]]:
        """(node, op, left input, right input)."""
        return [(i, op, *(list(self.inputs[i]) + [None, None])[:2]) for i, op in enumerate(self.ops)]

    def roots(self) -> list[int]:
        return [i for i, ps in enumerate(self.inputs) if not ps]

    def parents(self, node: int) -> tuple[int, ...]:
        return self.inputs[node]

    def children(self, node: int) -> list[int]:
        return [i for p, i in self.edges() if p == node]

    def reachable(self, start: Iterable[int], undirected: bool = False) -> set[int]:
        seen, todo = set(start), deque(start)
        while todo:
            n = todo.popleft()
            for m in [*self.children(n), *(self.parents(n) if undirected else ())]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    def components(self) -> list[set[int]]:
        left, out = set(range(len(self.ops))), []
        while left:
            out.append(self.reachable([min(left)], undirected=True))
            left -= out[-1]
        return out

    def has_match(self, expected: Iterable[tuple[str, str]]) -> bool:
        """Whether some reachable operator has all the expected in-edges.

        ``expected`` holds (input operator, operator) pairs that end at one operator name;
        edges that end at different names never match.
        """
        expected = list(expected)
        ends = {b for _, b in expected}
        if len(ends) != 1:
            return False
        end, need = ends.pop(), sorted(a for a, _ in expected)
        for n in self.reachable(self.roots()):
            have = sorted(self.ops[p] for p in self.inputs[n])
            if self.ops[n] == end and all(have.count(a) >= need.count(a) for a in need):
                return True
        return False
