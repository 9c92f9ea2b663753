"""Weighted finite-state transducers over word classes: building, composing and running them.

An ``Automaton`` has arcs (label, cost, next state) and outputs at its final states. Labels are word classes;
a word's symbol is a set of classes, so an arc is taken by any word that has its class (the lexical
transducer, which maps a word to each of its classes, is composed on the fly). Costs are hundredths
of a natural logarithm and add up along a path: a match of weight w over a path of cost c scores
w * exp(-c / 100).

``Cascade`` composes a context transducer (word classes to word classes with a mark: plain, negated, reported)
with the rules, state by state while it runs: a composed state is the context's state and the set of the
rules' states with the least cost of each (determinised), and every transition is worked out once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable

#: Any word but a negation, any token at all.
GAP, ANY = "_", "."
#: Paths of a greater cost are given up: what scores less than a fifth of its weight.
WORST = 185
GAP_COST = 3
#: Composed transitions kept at most; beyond, they are worked out again.
CACHE = 300_000

_TOKEN = re.compile(r"\s*(?:(\{\d+,\d+\})|(@?[\w=]+|[().|?*+]))")


class Automaton:
    """Arcs by state from state 0; ``outputs`` of final states: (category, weight)."""

    def __init__(self) -> None:
        self.arcs: list[list[tuple[str | None, int, int]]] = [[]]
        self.outputs: dict[int, list[tuple[str, float]]] = {}

    def state(self) -> int:
        self.arcs.append([])
        return len(self.arcs) - 1

    def arc(self, a: int, label: str | None, b: int, cost: int = 0) -> None:
        self.arcs[a].append((label, cost, b))

    def add(self, rule: str, parts: dict[str, str], category: str, weight: float) -> None:
        """A path from the start for each sequence of classes that the rule allows. A rule is written in class names
        and plain words (matched as such), with ( | ) ? * + {m,n}, @NAME for one of parts, _ for a gap word."""
        tokens = [m[1] or m[2] for m in _TOKEN.finditer(rule)]
        if "".join(tokens) != re.sub(r"\s+", "", rule):
            raise ValueError(f"can't read the rule {rule}")
        end, at = self._either(tokens, 0, self.state_from(0), parts)
        if at != len(tokens):
            raise ValueError(f"can't read the rule {rule}")
        self.outputs.setdefault(end, []).append((category, weight))

    def state_from(self, a: int) -> int:
        b = self.state()
        self.arc(a, None, b)
        return b

    def _either(self, t: list[str], at: int, start: int, parts: dict[str, str]) -> tuple[int, int]:
        end = self.state()
        while True:
            last, at = self._sequence(t, at, self.state_from(start), parts)
            self.arc(last, None, end)
            if at < len(t) and t[at] == "|":
                at += 1
                continue
            return end, at

    def _sequence(self, t: list[str], at: int, a: int, parts: dict[str, str]) -> tuple[int, int]:
        while at < len(t) and t[at] not in "|)":
            begin = at
            at = self._skip(t, at)
            low, high = 1, 1
            if at < len(t) and (t[at] in "?*+" or t[at][0] == "{"):
                low, high = {"?": (0, 1), "*": (0, -1), "+": (1, -1)}.get(t[at]) or tuple(map(int, re.findall(r"\d+", t[at])))
                at += 1
            for _ in range(low):
                a = self._atom(t, begin, a, parts)
            if high < 0:
                loop = self.state_from(a)
                self.arc(self._atom(t, begin, loop, parts), None, loop)
                a = self.state_from(loop)
            else:
                out = self.state()
                self.arc(a, None, out)
                for _ in range(high - low):
                    a = self._atom(t, begin, a, parts)
                    self.arc(a, None, out)
                a = out
        return a, at

    def _skip(self, t: list[str], at: int) -> int:
        """The place after the atom at ``at``."""
        if t[at] != "(":
            return at + 1
        depth = 0
        while at < len(t):
            depth += (t[at] == "(") - (t[at] == ")")
            at += 1
            if not depth:
                return at
        raise ValueError("a bracket isn't closed")

    def _atom(self, t: list[str], at: int, a: int, parts: dict[str, str]) -> int:
        if t[at] == "(":
            return self._either(t, at + 1, a, parts)[0]
        if t[at][0] == "@":
            inner = [m[1] or m[2] for m in _TOKEN.finditer(parts[t[at][1:]])]
            return self._either(inner, 0, a, parts)[0]
        b = self.state()
        label = t[at]
        if label == GAP:
            self.arc(a, GAP, b, GAP_COST)
        else:
            self.arc(a, label if not label.islower() else "=" + label, b)
        return b

    def close(self) -> None:
        """Removes epsilon arcs, and moves outputs to the states that reach them without a word."""
        reach: list[dict[int, int]] = []
        for s in range(len(self.arcs)):
            best, todo = {s: 0}, [s]
            while todo:
                x = todo.pop()
                for label, cost, y in self.arcs[x]:
                    if label is None and best[x] + cost < best.get(y, WORST):
                        best[y] = best[x] + cost
                        todo.append(y)
            reach.append(best)
        arcs = [sorted({(label, c + cost, y) for x, c in best.items() for label, cost, y in self.arcs[x] if label is not None}) for best in reach]
        outputs = {s: out for s, best in enumerate(reach) if (out := [(k, w * math.exp(-c / 100)) for x, c in best.items() for k, w in self.outputs.get(x, ())])}
        # only states that a word leads to are kept
        used = sorted({0, *(y for a in arcs for *_, y in a)})
        number = {s: i for i, s in enumerate(used)}
        self.arcs = [[(label, c, number[y]) for label, c, y in arcs[s]] for s in used]
        self.outputs = {number[s]: out for s, out in outputs.items() if s in number}

    def always(self, labels: set[str]) -> bool:
        """Whether every path to an output has an arc with one of the labels (a closed automaton)."""
        seen, todo = {0}, [0]
        while todo:
            s = todo.pop()
            if s in self.outputs:
                return False
            for label, _, y in self.arcs[s]:
                if label not in labels and y not in seen:
                    seen.add(y)
                    todo.append(y)
        return True

    def words(self) -> set[str]:
        """Words that rules name."""
        return {label[1:] for a in self.arcs for label, *_ in a if label and label[0] == "="}


class Cascade:
    """``context`` composed with ``rules``. context(state, classes) gives its next state and the cost of a
    match that starts at the word."""

    def __init__(self, context: Callable[[tuple, frozenset[str]], tuple[tuple, int]], start: tuple, rules: Automaton, words: frozenset[str]) -> None:
        self.context, self.start, self.rules, self.not_gap = context, start, rules, words
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: list[dict[int, int]] = []
        self.out: list[dict[str, float]] = []
        self.size = 0
        self.first = self._number((self.start, (), ()))

    def _number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.next.append({})
            self.out.append(dict(state[2]))
        return n

    def _step(self, at: int, classes: frozenset[str]) -> int:
        context, subset, _ = self.states[at]
        context, cost = self.context(context, classes)
        gap = classes.isdisjoint(self.not_gap)
        best: dict[int, int] = {}
        arcs = self.rules.arcs
        for s, c in (*subset, (0, cost)):
            for label, extra, y in arcs[s]:
                if (label in classes or (label == GAP and gap) or label == ANY) and c + extra < best.get(y, WORST):
                    best[y] = c + extra
        out: dict[str, float] = {}
        for s, c in best.items():
            for category, weight in self.rules.outputs.get(s, ()):
                out[category] = max(out.get(category, 0.0), weight * math.exp(-c / 100))
        return self._number((context, tuple(sorted((s, c) for s, c in best.items() if arcs[s])), tuple(sorted(out.items()))))

    def run(self, symbols: Iterable[int], classes: list[frozenset[str]]) -> dict[str, float]:
        """The best score of each category over a sequence of symbols, which number ``classes``."""
        if self.size > CACHE:
            self.clear()
        at, best = self.first, {}
        for s in symbols:
            to = self.next[at].get(s)
            if to is None:
                to = self.next[at][s] = self._step(at, classes[s])
                self.size += 1
            at = to
            if self.out[at]:
                for k, w in self.out[at].items():
                    if w > best.get(k, 0.0):
                        best[k] = w
        return best
