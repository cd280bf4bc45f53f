"""Symbols of Python source: functions with their measures, calls, imports, types, constants, notes and annotations."""

from __future__ import annotations

import ast
import io
import re
import tokenize

from ..functions.predicates import MARKERS
from ..schema import LANGUAGES, TOP

PAIRS = [tuple(p.split(":")) for r in LANGUAGES if r[0] == "python" for p in r[6].split()]
ACQUIRE, RELEASE = {a for a, _ in PAIRS}, {b for _, b in PAIRS}
_NOTE = re.compile(rf"(?i)(?:^|\s)(?:{'|'.join(MARKERS)})(?:\([^)]*\))?:")
_SHOUT = re.compile(r"[A-Z0-9_]*[A-Z][A-Z0-9_]*\Z")
_BOUNDARY = {"serves": "serves", "provides": "serves", "handles": "serves", "calls": "calls", "consumes": "calls", "uses": "calls"}
TRANSPORTS = frozenset("cli event ffi graphql grpc http https queue rest rpc soap sql webhook websocket ws".split())
PREFIX = "map:"
_LOOPS = (ast.For, ast.AsyncFor, ast.While, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
_FUNC = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPES = (*_FUNC, ast.ClassDef, ast.Lambda)


def parse_annotation(line: str, prefix: str = PREFIX) -> tuple[str, str, str] | None:
    """Boundary, transport and key of a comment line that says what is served or called; None for other lines."""
    m = re.search(rf"(?:^|\s){re.escape(prefix)}\s*(\S+)\s+(\S.*)$", line.rstrip())
    if not m or m[1].lower() not in _BOUNDARY:
        return None
    head, _, rest = m[2].partition(" ")
    named = head.lower() in TRANSPORTS
    if named and not rest.strip():
        return None
    key = rest.strip() if named else m[2].strip()
    return _BOUNDARY[m[1].lower()], head.lower() if named else "unspecified", key if len(key) <= 160 else key[:159] + "…"


def trip_count(node: ast.AST) -> int | None:
    """How often a loop over a range of literals runs."""
    it = node.iter if isinstance(node, (ast.For, ast.AsyncFor)) else node.generators[0].iter if hasattr(node, "generators") else None
    if not (isinstance(it, ast.Call) and isinstance(it.func, ast.Name) and it.func.id == "range"):
        return None
    args = [a.value for a in it.args if isinstance(a, ast.Constant) and isinstance(a.value, int)]
    if len(args) != len(it.args) or not 1 <= len(args) <= 2:
        return None
    return max(0, args[0] if len(args) == 1 else args[1] - args[0])


class _Walk(ast.NodeVisitor):
    def __init__(self, source: str):
        self.source, self.scope, self.owner = source, [], []
        self.out: dict[str, list[dict]] = {k: [] for k in ("funcs", "loops", "resources", "calls", "uses", "imports", "consts", "types")}
        self.loops, self.guards, self.bound = 0, 0, [{}]
        self.known: set[str] = set()

    def text(self, node: ast.AST | None) -> str | None:
        return None if node is None else ast.get_source_segment(self.source, node)

    @property
    def func(self) -> dict | None:
        return self.scope[-1] if self.scope else None

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.out["types"].append({"line": node.lineno, "name": node.name, "kind": "class"})
        self.owner.append(node.name)
        self.generic_visit(node)
        self.owner.pop()

    def _function(self, node: ast.FunctionDef) -> None:
        a = node.args
        args = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
        test = node.name.startswith("test") or any(o.startswith("Test") for o in self.owner)
        f = {"name": node.name, "line": node.lineno, "col": node.col_offset + 1, "ret": self.text(node.returns), "comment": (ast.get_docstring(node) or "").split("\n")[0][:100] or None, "start_line": node.lineno, "end_line": node.end_lineno, "test_ctx": test, "owner": self.owner[-1] if self.owner else None, "param_types": [t for t in (self.text(x.annotation) for x in args) if t], "body_lines": node.end_lineno - node.body[0].lineno + 1, "params": len(args), "branches": 0, "nodes": sum(1 for _ in ast.walk(node)), "recursive": False}
        f["ord"] = len(self.out["funcs"])
        self.out["funcs"].append(f)
        for d in [*node.decorator_list, *a.defaults, *(x for x in a.kw_defaults if x)]:
            self.visit(d)
        outer = self.loops, self.guards
        self.loops = self.guards = 0
        self.scope.append(f)
        self.bound.append({x.arg: self.text(x.annotation) for x in args if x.annotation is not None})
        owner, self.owner = self.owner, list(self.owner)
        for x in node.body:
            self.visit(x)
        self.owner = owner
        self.bound.pop()
        self.scope.pop()
        self.loops, self.guards = outer

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _branch(self, node: ast.AST) -> None:
        if self.func:
            self.func["branches"] += 1
        self.generic_visit(node)

    visit_If = visit_ExceptHandler = visit_match_case = _branch

    def _loop(self, node: ast.AST) -> None:
        self.loops += 1
        if self.func:
            kind = "for" if isinstance(node, (ast.For, ast.AsyncFor)) else "while" if isinstance(node, ast.While) else "comprehension"
            self.out["loops"].append({"ord": self.func["ord"], "line": node.lineno, "kind": kind, "depth": self.loops, "trip": trip_count(node)})
        self.generic_visit(node)
        self.loops -= 1

    visit_For = visit_AsyncFor = visit_While = visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = _loop

    def _with(self, node: ast.With) -> None:
        self.guards += 1
        for i in node.items:
            self.visit(i)
        self.guards -= 1
        for x in node.body:
            self.visit(x)

    visit_With = visit_AsyncWith = _with

    def _type_of(self, node: ast.AST) -> str | None:
        if isinstance(node, ast.Name):
            if node.id in ("self", "cls") and self.owner:
                return self.owner[-1]
            for b in reversed(self.bound):
                if node.id in b:
                    return b[node.id]
            return node.id if node.id in self.known else None
        return None

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            if isinstance(t, ast.Name):
                v = node.value
                made = v.func.id if isinstance(v, ast.Call) and isinstance(v.func, ast.Name) and v.func.id in self.known else None
                if made:
                    self.bound[-1][t.id] = made
                if not self.scope and not self.owner and _SHOUT.match(t.id):
                    self.out["consts"].append({"line": node.lineno, "name": t.id, "ty": None})
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if isinstance(node.target, ast.Name):
            self.bound[-1][node.target.id] = self.text(node.annotation)
            if not self.scope and not self.owner and _SHOUT.match(node.target.id):
                self.out["consts"].append({"line": node.lineno, "name": node.target.id, "ty": self.text(node.annotation)})
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        name, qualifier, recv = None, None, None
        if isinstance(node.func, ast.Name):
            name = node.func.id
        elif isinstance(node.func, ast.Attribute):
            name, qualifier, recv = node.func.attr, self.text(node.func.value), self._type_of(node.func.value)
        if name:
            caller = self.func["name"] if self.func else TOP
            self.out["calls"].append({"caller": caller, "line": node.lineno, "name": name, "qualifier": qualifier, "recv_type": recv, "test_ctx": bool(self.func and self.func["test_ctx"])})
            if self.func:
                if name == self.func["name"]:
                    self.func["recursive"] = True
                if name in ACQUIRE or name in RELEASE:
                    self.out["resources"].append({"ord": self.func["ord"], "line": node.lineno, "name": name, "pair": name, "acquire": name in ACQUIRE, "guarded": self.guards > 0})
        self.generic_visit(node)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        if isinstance(node.ctx, ast.Load) and node.attr[:1].isupper():
            self.out["uses"].append({"caller": self.func["name"] if self.func else TOP, "line": node.lineno, "name": node.attr, "qualifier": self.text(node.value), "recv_type": None, "test_ctx": bool(self.func and self.func["test_ctx"])})
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.out["imports"].append({"line": node.lineno, "module": a.name, "names": [], "reexport": False})

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        names = [a.name for a in node.names if a.name != "*"]
        self.out["imports"].append({"line": node.lineno, "module": "." * node.level + (node.module or ""), "names": names, "reexport": False})


def extract(source: str, prefix: str = PREFIX) -> dict[str, list[dict]] | None:
    """The symbol tables of one file; None where it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    w = _Walk(source)
    w.known = {n.name for n in ast.walk(tree) if isinstance(n, ast.ClassDef)} | {a.asname or a.name for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) for a in n.names if a.name[:1].isupper()}
    try:
        w.visit(tree)
    except RecursionError:
        return None
    out = w.out | {"notes": [], "annotations": []}
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.COMMENT:
                body = re.sub(r"^#+!?\s*", "", t.string).strip()
                if _NOTE.search(body):
                    one = " ".join(body.split())
                    out["notes"].append({"line": t.start[0], "text": one if len(one) <= 160 else one[:159] + "…"})
                if said := parse_annotation(body, prefix):
                    out["annotations"].append(dict(zip(("boundary", "transport", "key"), said)) | {"line": t.start[0], "function": owner_of(out["funcs"], t.start[0])})
    except (tokenize.TokenError, IndentationError):
        pass
    return out


def owner_of(funcs: list[dict], line: int, near: int = 10) -> str:
    """The innermost function around a line, else the nearest that starts within ``near`` lines below, else ''."""
    around = [f for f in funcs if f["start_line"] <= line <= f["end_line"]]
    if around:
        return max(around, key=lambda f: f["start_line"])["name"]
    below = [f for f in funcs if 0 < f["start_line"] - line <= near]
    return min(below, key=lambda f: f["start_line"])["name"] if below else ""
