"""A generalised LL recogniser with a graph-structured stack.

Grammars of several dialects are one grammar with several start symbols: they run together, share
the stack wherever they share a nonterminal, and the result is the set of start symbols that
accept the whole input. Ambiguity and left recursion are fine.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping


class Grammar:
    """Rules ``Name: alternative | alternative``, one per line; symbols are separated by blanks, ``%`` is the empty alternative; what isn't a rule's name is a terminal."""

    def __init__(self, text: str):
        rules = {}
        for line in text.strip().splitlines():
            if line.strip():
                name, _, alts = line.partition(": ")
                rules.setdefault(name.strip(), []).extend([a.split() for a in alts.split(" | ")])
        self.rules = {k: [() if a == ["%"] else tuple(a) for a in v] for k, v in rules.items()}
        self.nullable: set[str] = set()
        self.first: dict[str, set[str]] = {k: set() for k in self.rules}
        changed = True
        while changed:
            changed = False
            for k, alts in self.rules.items():
                for alt in alts:
                    seen, empty = self._first(alt)
                    if not seen <= self.first[k] or empty and k not in self.nullable:
                        self.first[k] |= seen
                        changed = True
                        if empty:
                            self.nullable.add(k)
        #: A slot is a place in an alternative: (symbol or None at the end, is it a rule).
        self.slots: list[tuple[str | None, bool]] = []
        self.starts: dict[str, list[tuple[int, frozenset, bool]]] = {}
        for k, alts in self.rules.items():
            self.starts[k] = []
            for alt in alts:
                seen, empty = self._first(alt)
                self.starts[k].append((len(self.slots), frozenset(seen), empty))
                self.slots += [(s, s in self.rules) for s in alt] + [(None, False)]

    def _first(self, alt: tuple[str, ...]) -> tuple[set[str], bool]:
        seen: set[str] = set()
        for s in alt:
            if s not in self.rules:
                return seen | {s}, False
            seen |= self.first[s]
            if s not in self.nullable:
                return seen, False
        return seen, True

    def accepted(self, starts: Iterable[str], tokens: str, classes: Mapping[str, frozenset]) -> frozenset:
        """Those of ``starts`` that derive ``tokens``; ``classes`` gives the terminals each token may stand for."""
        n, slots, of_rule = len(tokens), self.slots, self.starts
        stack: dict[tuple, list] = {}  # (rule, from): [return edges, ends found]
        work: list[tuple[int, tuple, int]] = []
        found = set()

        def call(rule: str, edge: tuple, i: int) -> None:
            key = (rule, i)
            node = stack.get(key)
            if node is None:
                stack[key] = node = [{edge}, set()]
                here = classes[tokens[i]] if i < n else frozenset()
                work.extend((slot, key, i) for slot, first, empty in of_rule[rule] if empty or here & first)
            elif edge not in node[0]:
                node[0].add(edge)
                for end in node[1]:
                    back(edge, end)

        def back(edge: tuple, end: int) -> None:
            slot, above = edge
            if above is None:
                if end == n:
                    found.add(slot)
            else:
                work.append((slot, above, end))

        for s in starts:
            call(s, (s, None), 0)
        while work:
            slot, key, i = work.pop()
            while True:
                symbol, is_rule = slots[slot]
                if symbol is None:
                    node = stack[key]
                    if i not in node[1]:
                        node[1].add(i)
                        for edge in list(node[0]):
                            back(edge, i)
                    break
                if is_rule:
                    call(symbol, (slot + 1, key), i)
                    break
                if i < n and symbol in classes[tokens[i]]:
                    slot, i = slot + 1, i + 1
                else:
                    break
        return frozenset(found)
