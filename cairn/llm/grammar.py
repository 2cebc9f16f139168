"""Table-driven LL(1) parsing from grammars in extended Backus-Naur form.

``Grammar`` compiles rules to one automaton each and these to a table from (state, token) to the states that take the
top's place. Where two branches could begin with one token, the one written first is taken. ``Tables`` runs token
streams over the table; stacks are shared cells with numbers, so a step seen before is one dictionary look-up.

Notation: ``name: body`` in one or more lines; 'x' and UPPER are tokens; ( ) groups, [ ] is optional, * and + repeat.
"""

from __future__ import annotations

import re


class GrammarError(ValueError):
    pass


class Grammar:
    def __init__(self, text: str, start: str):
        self.rules: dict[str, list] = {}
        for m in re.finditer(r"(?m)^(\w+):(.*(?:\n[ \t]+.*)*)", text):
            self.rules[m[1]] = re.findall(r"'[^']+'|\w+|[()\[\]|*+]", m[2])
        self.nullable: set[str] = set()
        while True:
            self.arcs: list[dict[str, int]] = []  # of each state, in order of the branches
            self.final: list[bool] = []
            self.start = {name: self._automaton(tokens, name) for name, tokens in self.rules.items()}
            empty = {name for name, state in self.start.items() if self.final[state]}
            if empty == self.nullable:
                break
            self.nullable = empty
        self.first: dict[str, set[str]] = {}
        for name in self.rules:
            self._first(name, ())
        self.table = [self._row(s) for s in range(len(self.arcs))]
        self.begin = self.start[start]

    # --- rules to automata

    def _automaton(self, tokens: list[str], name: str) -> int:
        nfa: list[list[tuple[str | None, int]]] = []

        def new() -> int:
            nfa.append([])
            return len(nfa) - 1

        at = 0

        def alternatives() -> tuple[int, int]:
            nonlocal at
            a, z = sequence()
            if at < len(tokens) and tokens[at] == "|":
                s, e = new(), new()
                nfa[s].append((None, a))
                nfa[z].append((None, e))
                while at < len(tokens) and tokens[at] == "|":
                    at += 1
                    a, z = sequence()
                    nfa[s].append((None, a))
                    nfa[z].append((None, e))
                return s, e
            return a, z

        def sequence() -> tuple[int, int]:
            s = e = new()
            while at < len(tokens) and tokens[at] not in ("|", ")", "]"):
                a, z = item()
                nfa[e].append((None, a))
                e = z
            return s, e

        def item() -> tuple[int, int]:
            nonlocal at
            t = tokens[at]
            at += 1
            if t in ("(", "["):
                a, z = alternatives()
                if at >= len(tokens) or tokens[at] != {"(": ")", "[": "]"}[t]:
                    raise GrammarError(f"{name}: unclosed {t}")
                at += 1
                if t == "[":
                    nfa[a].append((None, z))
            else:
                a, z = new(), new()
                nfa[a].append((t, z))
                if t in self.nullable:
                    nfa[a].append((None, z))
            if at < len(tokens) and tokens[at] in "*+":
                s, e = new(), new()
                nfa[s].append((None, a))
                nfa[z] += [(None, a), (None, e)]
                if tokens[at] == "*":
                    nfa[s].append((None, e))
                at += 1
                return s, e
            return a, z

        a, z = alternatives()
        if at != len(tokens):
            raise GrammarError(f"{name}: stray {tokens[at]}")

        def closure(states: list[int]) -> tuple[int, ...]:
            out: list[int] = []
            todo = list(reversed(states))
            while todo:
                s = todo.pop()
                if s not in out:
                    out.append(s)
                    todo += [t for label, t in reversed(nfa[s]) if label is None]
            return tuple(out)

        known: dict[frozenset[int], int] = {}

        def state(group: tuple[int, ...]) -> int:
            key = frozenset(group)
            if key not in known:
                known[key] = here = len(self.arcs)
                self.arcs.append({})
                self.final.append(z in key)
                moves: dict[str, list[int]] = {}
                for s in group:
                    for label, t in nfa[s]:
                        if label is not None:
                            moves.setdefault(label, []).append(t)
                for label, targets in moves.items():
                    self.arcs[here][label] = state(closure(targets))
            return known[key]

        return state(closure([a]))

    # --- automata to the table

    def _first(self, name: str, above: tuple[str, ...]) -> set[str]:
        if name in self.first:
            return self.first[name]
        if name in above:
            raise GrammarError(f"{name} begins with itself")
        out: set[str] = set()
        for label in self.arcs[self.start[name]]:
            out |= self._first(label, (*above, name)) if label in self.rules else {label}
        self.first[name] = out
        return out

    def _enter(self, state: int, token: str) -> tuple[int, ...] | None:
        """What takes the place of a state on top when the token is read; the last is the new top."""
        for label, target in self.arcs[state].items():
            if label == token and label not in self.rules:
                return (target,)
            if label in self.rules and token in self.first[label]:
                return (target, *self._enter(self.start[label], token))
        return None

    def _row(self, state: int) -> dict[str, tuple[int, ...]]:
        tokens: set[str] = set()
        for label in self.arcs[state]:
            tokens |= self.first[label] if label in self.rules else {label}
        # a state that is final and leads nowhere needn't be kept
        keep = lambda path: tuple(s for s in path if self.arcs[s] or not self.final[s])
        return {t.strip("'"): keep(self._enter(state, t)) for t in tokens}


class Tables:
    """Runs token streams; a stack is the number of a cell (state, number of the cell below)."""

    LIMIT = 400_000

    def __init__(self, grammar: Grammar):
        self.g = grammar
        self.clear()

    def clear(self) -> None:
        self.cells: list[tuple[int, int]] = [(-1, -1)]
        self.known: dict[tuple[int, int], int] = {}
        self.steps: dict[tuple[int, str], int] = {}
        self.lines: dict[tuple[int, tuple[str, ...]], int] = {}
        self.empty = 0
        self.begin = self.cell(self.g.begin, 0)

    def cell(self, state: int, below: int) -> int:
        key = (state, below)
        n = self.known.get(key)
        if n is None:
            n = self.known[key] = len(self.cells)
            self.cells.append(key)
        return n

    def step(self, stack: int, token: str) -> int:
        """The stack after a token, or -1 where it has no place."""
        key = (stack, token)
        found = self.steps.get(key)
        if found is None:
            found, at = -1, stack
            while at > 0:
                state, below = self.cells[at]
                path = self.g.table[state].get(token)
                if path is not None:
                    found = below
                    for s in path:
                        found = self.cell(s, found)
                    break
                if not self.g.final[state]:
                    break
                at = below
            self.steps[key] = found
        return found

    def line(self, stack: int, tokens: tuple[str, ...]) -> int:
        """The stack after a line of tokens, or -1 - k where token k has no place."""
        key = (stack, tokens)
        found = self.lines.get(key)
        if found is None:
            found = stack
            for k, t in enumerate(tokens):
                found = self.step(found, t)
                if found < 0:
                    found = -1 - k
                    break
            self.lines[key] = found
        return found

    def script_line(self, stack: int, tokens: tuple[str, ...]) -> int:
        """Like line, but a missing semicolon is put in before a line's first token, a closing brace and the end."""
        key = (stack, ("", *tokens))
        found = self.lines.get(key)
        if found is None:
            found = stack
            for k, t in enumerate(tokens):
                after = self.step(found, t)
                if after < 0 and (k == 0 or t in ("}", "EOF")):
                    ended = self.step(found, ";")
                    after = self.step(ended, t) if ended >= 0 else -1
                if after < 0:
                    found = -1 - k
                    break
                found = after
            self.lines[key] = found
        return found

    def complete(self, stack: int) -> bool:
        while stack > 0:
            state, stack = self.cells[stack]
            if not self.g.final[state]:
                return False
        return True
