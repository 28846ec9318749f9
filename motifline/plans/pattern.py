"""Query graphs."""

from __future__ import annotations

from dataclasses import dataclass, field


class PatternError(ValueError):
    """A query graph that cannot be matched as it is written."""


@dataclass(frozen=True)
class QueryGraph:
    """A small labelled undirected graph; vertices in file order."""

    labels: dict[int, int]
    edges: frozenset[tuple[int, int]]
    neighbours: dict[int, tuple[int, ...]] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        near: dict[int, set[int]] = {v: set() for v in self.labels}
        for a, b in self.edges:
            if a == b or a not in near or b not in near:
                raise PatternError(f"edge {a}-{b} is a loop or leads to no vertex of the query")
            near[a].add(b)
            near[b].add(a)
        object.__setattr__(self, "neighbours", {v: tuple(sorted(n)) for v, n in near.items()})
        if not self.labels:
            raise PatternError("a query needs a vertex")
        seen, todo = set(), [next(iter(self.labels))]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo.extend(self.neighbours[v])
        if len(seen) < len(self.labels):
            raise PatternError("the query graph is not connected")

    @classmethod
    def of(cls, labels: list[int] | dict[int, int], *edges: tuple[int, int]) -> QueryGraph:
        """From labels (numbered from 0 if a list) and edges."""
        named = labels if isinstance(labels, dict) else dict(enumerate(labels))
        return cls(named, frozenset((min(e), max(e)) for e in edges))

    def degree(self, v: int) -> int:
        return len(self.neighbours[v])

    def neighbour_labels(self, v: int) -> dict[int, int]:
        """How many neighbours of each label."""
        out: dict[int, int] = {}
        for n in self.neighbours[v]:
            out[self.labels[n]] = out.get(self.labels[n], 0) + 1
        return out


def parse_workload(text: str, unlabelled: bool = False) -> list[QueryGraph]:
    """Query graphs from text: a line ``id label<TAB>neighbour label ...`` a vertex, blank lines between graphs.

    Line ends may be LF or CRLF, and any number of blank lines separates. Ids are unique over all graphs.
    """
    graphs, block, seen = [], [], set()
    for line in [*text.splitlines(), ""]:
        if line.strip():
            block.append(line.split())
        elif block:
            labels, edges = {}, set()
            for parts in block:
                if len(parts) < 2 or len(parts) % 2:
                    raise PatternError(f"malformed line: {' '.join(parts)}")
                try:
                    numbers = [int(p) for p in parts]
                except ValueError as e:
                    raise PatternError(f"not a number in: {' '.join(parts)}") from e
                v = numbers[0]
                if v in seen:
                    raise PatternError(f"vertex {v} occurs twice in the workload")
                seen.add(v)
                labels[v] = 0 if unlabelled else numbers[1]
                edges |= {(min(v, w), max(v, w)) for w in numbers[2::2]}
            graphs.append(QueryGraph(labels, frozenset(edges)))
            block = []
    return graphs


def query_labels(workload: list[QueryGraph]) -> set[int]:
    """All labels that any query uses."""
    return {label for q in workload for label in q.labels.values()}
