"""Lowering by pieces: a module is cut into the statements at its top, and what one text gives is made once.

What a statement gives rests on its own text alone but for the number of its first line and, for a function that is named
nowhere else in it, its name. So a text that comes again (a preamble, generated code, copies) is looked up. A module where
that does not hold, or that cannot be cut so, is lowered whole: ``whole`` tells why a text is no piece.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from codeflux.operators import lower

#: A line that begins a statement: neither indented nor closing or continuing one.
START = re.compile(r"\n(?=[^\s#)\]}])(?!else\b|elif\b|except\b|finally\b)")
DEF = re.compile(r"def ([A-Za-z][A-Za-z0-9_]*)\(")
BLANK = re.compile(r"^[ \t]+$", re.MULTILINE)
#: Stands for the name of a function.
NAME = "ThisFunction0"
#: Texts held at once, in characters; beyond it all are forgotten.
MOST = 8_000_000
#: Depth of a tree below which any function can be lowered.
DEEP = 60


class Piece:
    """What one text gives: ``facts`` as of a module that is only this, ``lines`` in it, and late imports with their depth in
    the tree, in the order of which a module has them."""

    def __init__(self, facts: dict, lines: int, late: list[tuple[int, dict]], named: bool = False):
        self.facts, self.lines, self.late, self.named = facts, lines, late, named
        self.top = facts["imports"][: len(facts["imports"]) - len(late)]
        self.quiet = not (facts["imports"] or facts["classes"] or facts["globals"] or facts["side_effects"] or facts["call_assigns"])
        self.names = [f["qualname"] for f in facts["functions"]]


def whole(relpath: str, source: str) -> Piece:
    return Piece(lower.lower_module(relpath, source), 0, [])


def _late(tree: ast.Module) -> list[tuple[int, dict]]:
    """Late imports with their depth, breadth first as ``ast.walk`` goes."""
    found, level, depth = [], [(n, True) for n in tree.body], 1
    while level:
        found += [(depth, b) for n, top in level if isinstance(n, (ast.Import, ast.ImportFrom)) and not top for b in lower._bindings(n, True)]
        level, depth = [(c, False) for n, _ in level for c in ast.iter_child_nodes(n)], depth + 1
    return found


def _shallow(tree: ast.Module) -> bool:
    """Whether a tree is far from the depth at which a function cannot be lowered."""
    level, depth = [tree], 0
    while level and depth < DEEP:
        level, depth = [c for n in level for c in lower.children(n)], depth + 1
    return not level


def piece(text: str, named: bool, bodies: bool = True) -> Piece | None:
    """What a text gives, or None where it is no statement that stands for itself. Without ``bodies`` a function has its name
    alone, and is not compiled."""
    if BLANK.search(text):
        return None  # dedent, which is of whole modules, changes such lines
    try:
        tree = ast.parse(text)
        if any(not isinstance(s, (*lower.SCOPES, ast.ClassDef)) for s in tree.body) and "global" in text:
            return None
        bodies = bodies or not _shallow(tree)
        scopes, codes, sound = lower._compiled(text) if bodies else ({}, {}, True)
        if not sound:
            return None
        facts = lower.lower_tree("", tree, scopes, codes, bodies)
    except (SyntaxError, ValueError, RecursionError):
        return None
    if facts["failed"]:
        return None
    late = _late(tree) if any(i["lazy"] for i in facts["imports"]) else []
    return Piece(facts, text.count("\n"), late, named)


class Pieces:
    """Pieces by their text."""

    def __init__(self, most: int = MOST, bodies: bool = True):
        self.known: dict[str, Piece | None] = {}
        self.held, self.most, self.bodies = 0, most, bodies

    def full(self) -> bool:
        return self.held > self.most

    def forget(self) -> None:
        self.known, self.held = {}, 0

    def of(self, relpath: str, source: str | None) -> list[tuple[str, int, Piece]]:
        """(name of its function or empty, lines before it, piece) for the pieces of a module, or for it as a whole."""
        source = source or ""
        return self._cut(source) or [("", 0, whole(relpath, source))]

    def _cut(self, source: str) -> list[tuple[str, int, Piece]] | None:
        if not source or source[0].isspace() or source[0] == "﻿" or "\r" in source or "\f" in source or "\0" in source or "__future__" in source:
            return None
        out, at, known, hold = [], 0, self.known, ""
        for part in START.split(source):
            if hold:
                part, hold = f"{hold}\n{part}", ""
            if part[0] == "@" and "\n@" not in part and "\n" not in part or part[0] == "@" and part.rsplit("\n", 1)[-1][:1] == "@":
                hold = part  # a decorator goes with what it stands over
                continue
            name, text = "", part
            if (m := DEF.match(part)) and part.count(n := m.group(1)) == 1 and NAME not in part:
                name, text = n, f"def {NAME}{part[m.end(1):]}"
            try:
                p = known[text]
            except KeyError:
                p = known[text] = piece(text + "\n", bool(name), self.bodies)
                self.held += len(text) + 2000
            if p is None:
                return None
            out.append((name, at, p))
            at += p.lines
        if hold:
            return None
        seen: set[str] = set()
        n = 0
        for name, _, p in out:  # of two functions of one name the compiler's facts get mixed
            n += len(p.names)
            if name and len(p.names) == 1:
                seen.add(name)
            else:
                seen.update(name + q[len(NAME) :] for q in p.names) if name else seen.update(p.names)
        return out if len(seen) == n else None


def functions(parts: list[tuple[str, int, Piece]]) -> Iterator[dict]:
    """Functions of a module as ``lower_module`` gives them, for tests and for what reads them one by one."""
    for name, at, p in parts:
        for f in p.facts["functions"]:
            f = dict(f)
            if p.named:
                f["qualname"] = name + f["qualname"][len(NAME) :]
                f["simple"] = f["qualname"].rsplit(".", 1)[-1]
            shift = lambda row, *keys: row | {k: row[k] + at if row[k] else row[k] for k in keys}
            f = shift(f, "first_line", "last_line")
            yield f | {"blocks": [shift(b, "line_lo", "line_hi") for b in f["blocks"]], "ops": [shift(o, "line", "end") for o in f["ops"]]}


def module(relpath: str, parts: list[tuple[str, int, Piece]]) -> dict:
    """All but the functions of a module, as ``lower_module`` gives it."""
    if len(parts) == 1 and parts[0][1] == 0 and not parts[0][2].late and not parts[0][2].named:
        return parts[0][2].facts | {"relpath": relpath, "module_name": lower._module_name(relpath)}
    out = lower._empty(relpath)
    classes, late = {}, []
    for _, at, p in parts:
        out["imports"] += p.top
        late += p.late
        out["globals"] += p.facts["globals"]
        out["call_assigns"] += p.facts["call_assigns"]
        out["side_effects"] += [s | {"line": s["line"] + at} for s in p.facts["side_effects"]]
        classes |= {c["name"]: c for c in p.facts["classes"]}
    out["imports"] += [b for _, b in sorted(late, key=lambda x: x[0])]
    return out | {"classes": list(classes.values()), "globals": lower.once(out["globals"])}
