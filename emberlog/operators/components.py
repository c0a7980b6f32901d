"""Connected components of a small bipartite graph on the driver."""

from __future__ import annotations


def connected(links: list[tuple]) -> list[tuple[list, list]]:
    """Components of (left, right) links, each as sorted lists; larger components first, then by the first left."""
    around: dict = {}
    for a, b in links:
        around.setdefault(("a", a), set()).add(("b", b))
        around.setdefault(("b", b), set()).add(("a", a))
    out, seen = [], set()
    for start in sorted(around, key=str):
        if start in seen:
            continue
        todo, part = [start], set()
        while todo:
            x = todo.pop()
            if x not in part:
                part.add(x)
                todo += around[x] - part
        seen |= part
        out.append((sorted(x for k, x in part if k == "a"), sorted(x for k, x in part if k == "b")))
    return sorted(out, key=lambda c: (-len(c[0]), str(c[0])))
