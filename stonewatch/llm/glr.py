"""Weighted repair of symbol sequences by a generalised LR automaton.

`Automaton` builds the LR(0) item sets of a small grammar. `Repair` drives it over a sequence in
which every token may be kept, replaced, deleted, or preceded by an inserted one, each at a cost
and with a letter for the audit. Several analyses go on side by side as stacks that share their
lower cells: a cell is (state, cell below) and exists once, so equal stacks have the same top
and are merged, keeping the smallest (cost, audit).

The sequence is read from its end, with the grammar mirrored. An audit then grows at its front,
and of two audits with the same cost the smaller one stays the smaller, whatever is put before
both; grown at the end, `K` and `KI` would change places with what follows.

Rules for lists are given right-recursive: mirrored they are left-recursive, so that a list is
reduced as it goes and stacks stay low. A grammar whose stacks grow without end is refused.
"""

from __future__ import annotations

import heapq
from collections.abc import Hashable, Iterable, Mapping, Sequence

Rules = Sequence[tuple[str, Sequence[str]]]

#: Cost, order of the audit among those of the same place, and the audit as (letter, rest).
Entry = tuple[int, tuple, tuple | None]

END = "$"

#: Stack cells of one automaton; more are a sign of stacks that grow with every insertion.
MAX_CELLS = 10_000


class Automaton:
    """LR(0) states with one-token lookahead by what may follow a nonterminal (SLR).

    `rules` are (nonterminal, symbols); the first rule's nonterminal is the start. `shift`
    and `goto` map (state, symbol) to a state, `reduce` maps (state, lookahead) to rules.
    """

    def __init__(self, rules: Rules):
        self.rules = [("^", (rules[0][0],)), *((left, tuple(right)) for left, right in rules)]
        self.inner = {left for left, _ in self.rules}
        self.follow = self._follow()
        self.states: list[frozenset] = []
        self.step: dict[tuple[int, str], int] = {}
        self.reduce: dict[tuple[int, str], list[tuple[str, int]]] = {}
        self._add(frozenset({(0, 0)}))
        for at, state in enumerate(self.states):  # grows while it is walked
            for symbol in {s for item in self._closed(state) if (s := self._next(item))}:
                moved = frozenset((r, d + 1) for r, d in self._closed(state) if self._next((r, d)) == symbol)
                self.step[at, symbol] = self._add(moved)
            for rule, dot in self._closed(state):
                left, right = self.rules[rule]
                if dot == len(right) and rule:
                    for token in self.follow[left]:
                        self.reduce.setdefault((at, token), []).append((left, len(right)))
        self.accepting = {i for i, s in enumerate(self.states) if (0, 1) in s}
        self.tokens = sorted({s for _, right in self.rules for s in right} - self.inner)

    def _next(self, item: tuple[int, int]) -> str | None:
        right = self.rules[item[0]][1]
        return right[item[1]] if item[1] < len(right) else None

    def _closed(self, kernel: frozenset) -> set:
        items, todo = set(kernel), list(kernel)
        while todo:
            symbol = self._next(todo.pop())
            for rule, (left, _) in enumerate(self.rules):
                if left == symbol and (rule, 0) not in items:
                    items.add((rule, 0))
                    todo.append((rule, 0))
        return items

    def _add(self, kernel: frozenset) -> int:
        if kernel not in self.states:
            self.states.append(kernel)
        return self.states.index(kernel)

    def _follow(self) -> dict[str, set[str]]:
        """Tokens after each nonterminal, by sets grown until nothing changes; "" marks an empty word."""
        first: dict[str, set[str]] = {n: set() for n in self.inner}
        follow: dict[str, set[str]] = {n: set() for n in self.inner}
        follow["^"].add(END)

        def starts(symbols: Sequence[str]) -> set[str]:
            found: set[str] = set()
            for symbol in symbols:
                own = first[symbol] if symbol in self.inner else {symbol}
                found |= own - {""}
                if "" not in own:
                    return found
            return found | {""}

        size = -1
        while size != (size := sum(map(len, first.values())) + sum(map(len, follow.values()))):
            for left, right in self.rules:
                first[left] |= starts(right)
                for i, symbol in enumerate(right):
                    if symbol in self.inner:
                        after = starts(right[i + 1 :])
                        follow[symbol] |= after - {""} | (follow[left] if "" in after else set())
        return follow


class Repair:
    """Cheapest repairs of token sequences by the stacks of an automaton.

    `tokens` maps each kind of input token to its actions: (symbol or None for a deletion,
    cost, letter). `inserts` are actions possible before and after every token.
    """

    def __init__(
        self,
        rules: Rules,
        tokens: Mapping[Hashable, Sequence[tuple[str | None, int, str]]],
        inserts: Sequence[tuple[str, int, str]],
    ):
        if any(cost <= 0 for _, cost, _ in inserts):
            raise ValueError("an inserted token must cost something")
        if {i[2] for i in inserts} & {a[2] for actions in tokens.values() for a in actions}:
            raise ValueError("inserted tokens need letters of their own")
        self.machine = Automaton([(left, tuple(reversed(right))) for left, right in rules])
        self.tokens, self.inserts = tokens, inserts
        self.cells: dict[tuple[int, int], int] = {(0, -1): 0}
        self.below: list[tuple[int, int]] = [(0, -1)]
        self.moves: dict[tuple[int, str], tuple[int, ...]] = {}

    def _cell(self, state: int, below: int) -> int:
        key = (state, below)
        if key not in self.cells:
            if len(self.below) >= MAX_CELLS:
                raise ValueError("stacks grow without end: give list rules right-recursive")
            self.cells[key] = len(self.below)
            self.below.append(key)
        return self.cells[key]

    def _reduced(self, top: int, token: str) -> list[int]:
        """All tops that reductions before `token` lead to, the given one included."""
        found, todo = [top], [top]
        while todo:
            for left, size in self.machine.reduce.get((self.below[todo[-1]][0], token), ()):
                base = todo[-1]
                for _ in range(size):
                    base = self.below[base][1]
                state = self.machine.step.get((self.below[base][0], left))
                if state is not None and (new := self._cell(state, base)) not in found:
                    found.append(new)
                    todo.insert(0, new)
            todo.pop()
        return found

    def _shifted(self, top: int, token: str) -> tuple[int, ...]:
        key = (top, token)
        if key not in self.moves:
            made = (
                (self.machine.step.get((self.below[t][0], token)), t) for t in self._reduced(top, token)
            )
            self.moves[key] = tuple(self._cell(state, t) for state, t in made if state is not None)
        return self.moves[key]

    def _with_inserts(self, seeds: dict[int, Entry]) -> dict[int, Entry]:
        """All tops reachable by inserting tokens, cheapest first; orders become ranks."""
        best: dict[int, Entry] = {}
        queue = [(cost, order, top, audit) for top, (cost, order, audit) in seeds.items()]
        heapq.heapify(queue)
        while queue:
            cost, order, top, audit = heapq.heappop(queue)
            if top in best:
                continue
            best[top] = (cost, order, audit)
            for symbol, price, letter in self.inserts:
                for new in self._shifted(top, symbol):
                    if new not in best:
                        heapq.heappush(queue, (cost + price, (letter, *order), new, (letter, audit)))
        ranks = {order: (i,) for i, order in enumerate(sorted({order for _, order, _ in best.values()}))}
        return {top: (cost, ranks[order], audit) for top, (cost, order, audit) in best.items()}

    def best(self, sequence: Iterable[Hashable]) -> tuple[int, str]:
        """The smallest (cost, audit) over all repairs that the grammar accepts.

        `sequence` is given from its end. The time is linear in its length: audits are linked
        lists, compared by their letters since the last token and their rank there.
        """
        tops = self._with_inserts({0: (0, (), None)})
        for token in sequence:
            moved: dict[int, Entry] = {}
            for top, (cost, rank, audit) in tops.items():
                for symbol, price, letter in self.tokens[token]:
                    key = (cost + price, (letter, *rank))
                    for new in (top,) if symbol is None else self._shifted(top, symbol):
                        if new not in moved or key < moved[new][:2]:
                            moved[new] = (*key, (letter, audit))
            tops = self._with_inserts(moved)
        ends = [
            found
            for top, found in tops.items()
            if any(self.below[t][0] in self.machine.accepting for t in self._reduced(top, END))
        ]
        if not ends:
            raise ValueError("no repair is possible with these actions")
        cost, _, audit = min(ends, key=lambda e: e[:2])
        letters = []
        while audit is not None:
            letter, audit = audit
            letters.append(letter)
        return cost, "".join(letters)
