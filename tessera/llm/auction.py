"""Cheapest edits through a layered lattice, by the auction shortest-path algorithm.

A node is (layer, state). States say what a repaired conversation ends with: 0 nothing,
1 a system turn, 2 a user turn, 3 an assistant turn. Layer ``i`` has arcs ``(letter,
cost, state)`` into layer ``i + 1``; an insertion (``I``) stays in its layer and moves to
the only state that may follow. All costs are non-negative integers and every cycle
costs something.

Prices start dual feasible (``price[i] <= cost + price[j]`` on every arc): the sum of
what the layers below must cost at least. From an origin a path is grown along tight
arcs: if the price of its end is below the least ``cost + price[j]``, it is raised to it
and the path contracts by that node, else the path is extended to the node that gives
the minimum, until it reaches one whose price is final. Origins are taken from the last
layers to the first, ``STRIDE`` layers apart, and prices are kept, so the work is linear
in the layers. On the converged prices every cheapest path consists of tight arcs; those
that lead to the goal are traced, the least letter first.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

STATES = 4
NEXT = (2, 2, 3, 2)  # the state that an inserted or reroled turn leads to
ENDS = (0, 3)
INSERT, STRIDE = 3, 16
INFINITE = float("inf")

Arc = tuple[str, int, int]


def least_paths(layers: Sequence[Sequence[Sequence[Arc]]], goal: int | None, starts: Iterable[int], insert: bool = True) -> dict[int, tuple[int, str, list[int]]]:
    """For each start state with a way to the goal: its cost, the least of the cheapest
    paths' letters, and the states after each layer. Goal None is any state of ``ENDS``,
    with insertions after the last layer."""
    n = len(layers)
    end = STATES * (n + 1)
    out: list[list[tuple[str, int, int]]] = []
    for i in range(n + 1):
        for q in range(STATES):
            arcs = [("I", INSERT, STATES * i + NEXT[q])] if insert and (i < n or goal is None) else []
            if i < n:
                arcs += [(letter, cost, STATES * (i + 1) + to) for letter, cost, to in layers[i][q]]
            elif q in ENDS if goal is None else q == goal:
                arcs.append(("", 0, end))
            out.append(arcs)

    def leading(use) -> list[bool]:
        """Nodes with a path to the goal over the arcs that ``use`` lets through."""
        good = [False] * end + [True]
        for i in range(n, -1, -1):
            nodes = range(STATES * i, STATES * (i + 1))
            for _ in range(STATES):
                for x in nodes:
                    good[x] = good[x] or any(good[j] and use(x, cost, j) for _, cost, j in out[x])
        return good

    can = leading(lambda x, cost, j: True)
    price: list[float] = [INFINITE] * end + [0]
    final = [False] * end + [True]
    bound, below = 0, n + 1
    for origin in [*range(n, 0, -STRIDE), 0]:
        for i in range(below - 1, origin - 1, -1):
            if i < n:
                bound += min((cost for arcs in layers[i] for _, cost, _ in arcs), default=0)
            for x in range(STATES * i, STATES * (i + 1)):
                price[x] = bound if can[x] else INFINITE
        for x in range(STATES * origin, STATES * (origin + 1)):
            if can[x]:
                _auction(x, out, price, final)
        bound, below = min((price[x] for x in range(STATES * origin, STATES * (origin + 1)) if can[x]), default=0), origin

    good = leading(lambda x, cost, j: price[x] == cost + price[j])
    found = {}
    for q in starts:
        x, letters, states = q, [], []
        if not good[x]:
            continue
        while x != end:
            letter, _, j = min(a for a in out[x] if good[a[2]] and price[x] == a[1] + price[a[2]])
            letters.append(letter)
            if j != end and j // STATES > x // STATES:
                states.append(j % STATES)
            x = j
        found[q] = (int(price[q]), "".join(letters), states)
    return found


def _auction(origin: int, out: list[list[Arc]], price: list[float], final: list[bool]) -> None:
    path = [origin]
    while not final[path[-1]]:
        x = path[-1]
        best, to = min((cost + price[j], j) for _, cost, j in out[x])
        if price[x] < best:
            price[x] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    for x in path:
        final[x] = True
