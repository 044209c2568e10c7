"""Parser tables from grammars, and a recogniser that runs them over token streams.

A grammar is text: ``name : alternative | alternative ;`` with quoted literals, upper-case token classes, lower-case
rules, groups in parentheses, the suffixes ``? * +``, and ``x % y`` for one or more x separated by y. Optional parts are
expanded, so no rule but the start can be empty. The tables are those of an SLR(1) automaton; where they hold several
actions, the recogniser follows all of them on stacks that share their lower parts and are merged when they become
equal. A grammar need not be LR(1), but what is ambiguous in it should be settled within a few tokens: stacks that stay
apart for good would multiply. The bundled grammars write binary operators as flat lists for that reason.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

END = "$end"
_ITEM = re.compile(r"\s*(?:#[^\n]*\s*)*('(?:[^'\\]|\\.)*'|[A-Za-z_]\w*|[:;|()?*+%])")


@dataclass
class Tables:
    """``actions``: per state {terminal: int | tuple of int}, a state to shift to or ~production to reduce by;
    ``gotos``: per state {rule: state}; ``reductions``: (length, rule) of each production."""

    terminals: dict[str, int]
    actions: list[dict]
    gotos: list[dict[int, int]]
    reductions: list[tuple[int, int]]
    empty: bool
    conflicts: int = field(default=0, compare=False)


def _read(text: str) -> tuple[dict[str, list[tuple[str, ...]]], str, set[str]]:
    """Rules as lists of alternatives, the start, and the rules that may be empty."""
    tokens, at = [], 0
    text = re.sub(r"(?m)^\s*#.*$", "", text).rstrip()
    while at < len(text):
        m = _ITEM.match(text, at)
        if not m:
            raise ValueError(f"grammar: {text[at : at + 40]!r}")
        tokens.append(m[1])
        at = m.end()
    rules: dict[str, list[tuple[str, ...]]] = {}
    made: dict[tuple, str] = {}

    def fresh(kind: str, key: tuple, alternatives) -> str:
        if (kind, key) not in made:
            made[kind, key] = name = f"{kind}{len(made)}"
            rules[name] = alternatives(name)
        return made[kind, key]

    def alternatives(i: int) -> tuple[list[tuple[str, ...]], int]:
        out: list[tuple[str, ...]] = []
        while True:
            parts: list[list[tuple[str, ...]]] = []
            while tokens[i] not in ("|", ";", ")"):
                choice, i = item(i)
                parts.append(choice)
            out += [tuple(s for part in way for s in part) for way in product(*parts)]
            if tokens[i] != "|":
                return list(dict.fromkeys(out)), i
            i += 1

    def single(choice: list[tuple[str, ...]]) -> str:
        """One symbol for a choice of sequences."""
        if len(choice) == 1 and len(choice[0]) == 1:
            return choice[0][0]
        return fresh("group", tuple(choice), lambda _: list(choice))

    def item(i: int) -> tuple[list[tuple[str, ...]], int]:
        if tokens[i] == "(":
            choice, i = alternatives(i + 1)
        else:
            choice = [(tokens[i],)]
        i += 1
        while tokens[i] in ("?", "*", "+", "%"):
            mark = tokens[i]
            i += 1
            if mark == "?":
                choice = list(dict.fromkeys([*choice, ()]))
            elif mark == "%":
                apart, i = item(i)
                x, y = single(choice), single(apart)
                choice = [(fresh("list", (x, y), lambda me: [(x,), (me, y, x)]),)]
            else:
                x = single(choice)
                many = fresh("many", (x,), lambda me: [(x,), (me, x)])
                choice = [(many,)] if mark == "+" else [(many,), ()]
        return choice, i

    i, start = 0, tokens[0]
    while i < len(tokens):
        name = tokens[i]
        found, i = alternatives(i + 2)
        rules.setdefault(name, []).extend(found)
        i += 1
    empty = {name for name, found in rules.items() if () in found}
    if empty - {start}:
        raise ValueError(f"empty rules: {empty}")
    return rules, start, empty


def build(text: str) -> Tables:
    rules, start, empty = _read(text)
    names = list(rules)
    rule_no = {n: i for i, n in enumerate(names)}
    terminals = {END: 0}
    productions: list[tuple[int, tuple[int, ...]]] = [(-1, (~rule_no[start],))]  # rules are ~number in right sides
    for name in names:
        for way in rules[name]:
            if way:
                symbols = []
                for s in way:
                    if s in rule_no:
                        symbols.append(~rule_no[s])
                    else:
                        if s[0] != "'" and not s.isupper():
                            raise ValueError(f"no rule {s}")
                        symbols.append(terminals.setdefault(s[1:-1].replace("\\'", "'") if s[0] == "'" else s, len(terminals)))
                productions.append((rule_no[name], tuple(symbols)))
    by_rule: list[list[int]] = [[] for _ in names]
    for p, (lhs, _) in enumerate(productions):
        if lhs >= 0:
            by_rule[lhs].append(p)

    first: list[set[int]] = [set() for _ in names]
    changed = True
    while changed:
        changed = False
        for lhs, rhs in productions[1:]:
            new = first[~rhs[0]] if rhs[0] < 0 else {rhs[0]}
            if not new <= first[lhs]:
                first[lhs] |= new
                changed = True
    follow: list[set[int]] = [set() for _ in names]
    follow[rule_no[start]].add(0)
    changed = True
    while changed:
        changed = False
        for lhs, rhs in productions[1:]:
            for k, s in enumerate(rhs):
                if s < 0:
                    nxt = rhs[k + 1] if k + 1 < len(rhs) else None
                    new = follow[lhs] if nxt is None else first[~nxt] if nxt < 0 else {nxt}
                    if not new <= follow[~s]:
                        follow[~s] |= new
                        changed = True

    opened: list[list[int]] = []  # productions that a rule at the dot brings in
    for r in range(len(names)):
        seen, todo = {r}, [r]
        while todo:
            for p in by_rule[todo.pop()]:
                s = productions[p][1][0]
                if s < 0 and ~s not in seen:
                    seen.add(~s)
                    todo.append(~s)
        opened.append([p for q in seen for p in by_rule[q]])

    states: dict[frozenset, int] = {frozenset([(0, 0)]): 0}
    queue = [frozenset([(0, 0)])]
    actions: list[dict] = []
    gotos: list[dict[int, int]] = []
    conflicts = 0
    for kernel in queue:
        items = set(kernel)
        for p, dot in kernel:
            rhs = productions[p][1]
            if dot < len(rhs) and rhs[dot] < 0:
                items.update((q, 0) for q in opened[~rhs[dot]])
        moves: dict[int, set] = {}
        acts: dict[int, list[int]] = {}
        for p, dot in items:
            lhs, rhs = productions[p]
            if dot < len(rhs):
                moves.setdefault(rhs[dot], set()).add((p, dot + 1))
            elif lhs < 0:
                acts.setdefault(0, []).append(~0)
            else:
                for t in follow[lhs]:
                    acts.setdefault(t, []).append(~p)
        go: dict[int, int] = {}
        for s, target in moves.items():
            target = frozenset(target)
            if target not in states:
                states[target] = len(states)
                queue.append(target)
            if s < 0:
                go[~s] = states[target]
            else:
                acts.setdefault(s, []).append(states[target])
        conflicts += sum(len(a) > 1 for a in acts.values())
        actions.append({t: a[0] if len(a) == 1 else tuple(sorted(a)) for t, a in acts.items()})
        gotos.append(go)
    return Tables(terminals, actions, gotos, [(len(rhs), lhs) for lhs, rhs in productions], start in empty, conflicts)


def first_error(tables: Tables, tokens: list[int], optional_end: list[bool] | None = None, end_mark: int = -1) -> int | None:
    """The place of the first token at which no parse goes on; None if the stream is a sentence.

    ``tokens`` ends with the end token. With ``optional_end``, where a token can't be taken and its entry is true,
    ``end_mark`` is taken before it if that helps.
    """
    actions, gotos, reductions = tables.actions, tables.gotos, tables.reductions
    if len(tokens) == 1 and tables.empty:
        return None
    head = (0, None)
    heads = None  # more than one stack
    i, n = 0, len(tokens)
    inserted, marked = False, -1  # whether the mark is being taken, and the token it was last taken before
    while i < n:
        token = end_mark if inserted else tokens[i]
        if heads is None:
            before = head
            while True:
                act = actions[head[0]].get(token)
                if act.__class__ is int:
                    if act >= 0:
                        head = (act, head)
                        break
                    if act == -1:
                        return None
                    length, rule = reductions[~act]
                    for _ in range(length):
                        head = head[1]
                    head = (gotos[head[0]][rule], head)
                    continue
                break
            if act.__class__ is int:
                if inserted:
                    inserted = False
                else:
                    i += 1
                continue
            if act is not None:
                heads = [head]
        if heads is not None:
            nodes: dict[tuple[int, int], tuple] = {}
            shifted: dict[tuple[int, int], tuple] = {}
            todo = heads
            for node in todo:
                act = actions[node[0]].get(token)
                if act is None:
                    continue
                for a in (act,) if act.__class__ is int else act:
                    if a >= 0:
                        shifted.setdefault((a, id(node)), (a, node))
                    elif a == -1:
                        return None
                    else:
                        length, rule = reductions[~a]
                        below = node
                        for _ in range(length):
                            below = below[1]
                        state = gotos[below[0]][rule]
                        if (state, id(below)) not in nodes:
                            nodes[state, id(below)] = new = (state, below)
                            todo.append(new)
            if shifted:
                found = list(shifted.values())
                if len(found) == 1:
                    head, heads = found[0], None
                else:
                    heads = found
                if inserted:
                    inserted = False
                else:
                    i += 1
                continue
            heads = todo
        else:
            heads = [before] if before is head else [before, head]
        if marked == i or optional_end is None or not optional_end[i]:
            return i
        inserted, marked = True, i  # on the stacks as they stood before this token and those it has reduced
    return None
