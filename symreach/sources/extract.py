"""What one Python file holds: declarations, references, exports and facts; a pure function of its text.

A binder walks the module's statements in order and keeps, for each global name, the declarations that are live there:
branches merge, assignment replaces, del removes. A use at module or class level sees what is live at its
place; a use in a function sees what is live at the module's end."""

from __future__ import annotations

import ast
import json
import re
from dataclasses import dataclass, field

from .. import schema as S

BUILTIN_DYNAMIC = ("__import__",)
NOQA = re.compile(r"#\s*noqa(?P<codes>\s*:\s*[A-Z]+[0-9]+(?:[,\s]+[A-Z]+[0-9]+)*)?", re.I)


@dataclass
class Ref:
    src: int
    kind: str  # local, binding, use, starred, dynamic
    target: int = -1
    module: str | None = None
    decl: str | None = None
    star: bool = False
    chain: tuple = ()
    names: tuple = ()
    flags: int = 0

    def key(self) -> tuple:
        return (self.src, self.kind, self.target, self.module, self.decl, self.star, self.chain, self.names, self.flags)


@dataclass
class Node:
    name: str
    kind: str
    line: int
    column: int
    end_line: int
    end_column: int
    flags: int = 0
    imported: tuple | None = None  # module, decl, star
    bound: str | None = None
    overload: bool = False


@dataclass
class File:
    nodes: list[Node] = field(default_factory=list)
    refs: list[Ref] = field(default_factory=list)
    exports: dict[str, set[int]] = field(default_factory=dict)
    stars: list[tuple[int, str]] = field(default_factory=list)
    facts: list[tuple[str, int, str]] = field(default_factory=list)
    error: str | None = None


def absolute(module: str | None, level: int, name: str, package: bool) -> str | None:
    """The absolute module of a relative import in module `name`; None beyond the top."""
    if not level:
        return module
    parts = name.split(".")
    drop = level - 1 if package else level
    if drop > len(parts) or (drop == len(parts) and not module):
        return None
    base = parts[: len(parts) - drop]
    return ".".join([*base, *([module] if module else [])])


# --- dead ranges ----------------------------------------------------------------------------------------------

def truth(e: ast.expr, names: dict[str, bool]) -> bool | None:
    """The constant truth of an expression, None if it is open."""
    if isinstance(e, ast.Constant):
        return bool(e.value)
    if isinstance(e, (ast.List, ast.Tuple, ast.Set)) and not any(isinstance(x, ast.Starred) for x in e.elts):
        return bool(e.elts)
    if isinstance(e, ast.Dict) and all(k is not None for k in e.keys):
        return bool(e.keys)
    if isinstance(e, ast.Name):
        return names.get(e.id)
    if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.Not):
        v = truth(e.operand, names)
        return None if v is None else not v
    if isinstance(e, ast.BoolOp):
        values = [truth(x, names) for x in e.values]
        decisive = isinstance(e.op, ast.Or)
        return decisive if decisive in values else None if None in values else not decisive
    return None


def is_type_checking(e: ast.expr) -> bool:
    return (isinstance(e, ast.Name) and e.id == "TYPE_CHECKING") or (isinstance(e, ast.Attribute) and e.attr == "TYPE_CHECKING")


def constants(body: list[ast.stmt]) -> dict[str, bool]:
    """Names of a scope that are bound to values of one constant truth alone."""
    out: dict[str, bool] = {}
    plain = {}
    for s in body:
        if isinstance(s, ast.Assign) and all(isinstance(t, ast.Name) for t in s.targets):
            for t in s.targets:
                plain.setdefault(t.id, []).append(s.value)
        elif isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name) and s.value is not None:
            plain.setdefault(s.target.id, []).append(s.value)
    # The first name needs values that tell their truth without any other name.
    if not any(all(truth(v, out) is not None for v in values) for values in plain.values()):
        return out
    seen: dict[str, list] = {}
    for s in body:
        for x in ast.walk(s):
            if isinstance(x, (ast.Name, ast.arg)) and (isinstance(x, ast.arg) or isinstance(x.ctx, (ast.Store, ast.Del))):
                seen.setdefault(x.arg if isinstance(x, ast.arg) else x.id, []).append(None)
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                seen.setdefault(x.name, []).append(None)
            elif isinstance(x, ast.alias):
                seen.setdefault((x.asname or x.name).split(".")[0], []).append(None)
    for _ in range(len(plain) + 1):
        before = dict(out)
        for name, values in plain.items():
            got = {truth(v, out) for v in values}
            if len(values) == len(seen.get(name, [])) and len(got) == 1 and None not in got:
                out[name] = got.pop()
        if before == out:
            break
    return out


def ends(s: ast.stmt, names: dict[str, bool]) -> bool:
    """Whether a statement never goes on to the next."""
    if isinstance(s, (ast.Return, ast.Raise, ast.Continue, ast.Break)):
        return True
    if isinstance(s, ast.If):
        v = truth(s.test, names)
        body, other = any(ends(x, names) for x in s.body), any(ends(x, names) for x in s.orelse)
        return body if v is True else other if v is False else body and other
    if isinstance(s, (ast.With, ast.AsyncWith)):
        return any(ends(x, names) for x in s.body)
    if isinstance(s, ast.Try):
        return any(ends(x, names) for x in s.finalbody) or (any(ends(x, names) for x in [*s.body, *s.orelse]) and all(any(ends(x, names) for x in h.body) for h in s.handlers))
    return False


def dead_ranges(tree: ast.Module) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []

    def mark(body: list[ast.stmt]) -> None:
        if body:
            out.append((body[0].lineno, body[-1].end_lineno))

    def walk(body: list[ast.stmt], names: dict[str, bool]) -> None:
        for i, s in enumerate(body):
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                own = names | constants(s.body)
                walk(s.body, own)
            elif isinstance(s, (ast.If, ast.While)):
                v = None if is_type_checking(s.test) else truth(s.test, names)
                for dead, part in ((v is False, s.body), (v is True, s.orelse)):
                    mark(part) if dead else walk(part, names)
            else:
                for part in ("body", "orelse", "finalbody"):
                    walk(getattr(s, part, None) or [], names)
                for h in [*getattr(s, "handlers", []), *getattr(s, "cases", [])]:
                    walk(h.body, names)
            if ends(s, names):
                mark(body[i + 1 :])
                return

    walk(tree.body, constants(tree.body))
    return out


# --- the binder -------------------------------------------------------------------------------------------------

class Extractor:
    def __init__(self, source: str, module: str, package: bool):
        self.source, self.module, self.package = source, module, package
        self.lines = source.split("\n")
        self.file = File()
        self.live: dict[str, set[int]] = {}
        self.deferred: list = []
        self.modules: dict[int, str] = {}
        self.dead: list[tuple[int, int]] = []

    def run(self) -> File:
        f = self.file
        f.nodes.append(Node(self.module, "module", 1, 0, 1, 0))
        try:
            tree = ast.parse(self.source)
        except (SyntaxError, ValueError, RecursionError) as e:
            f.error = f"{type(e).__name__}: {e}"
            return f
        self.dead = dead_ranges(tree)
        self.block(tree.body)
        self.main_block(tree.body)
        f.exports = {k: set(v) for k, v in self.live.items() if v}
        for work in self.deferred:
            work()
        self.anchors()
        self.overloads()
        self.pins()
        seen = {}
        for r in f.refs:
            if not (r.kind == "local" and r.src == r.target):
                seen[r.key()] = r
        f.refs = sorted(seen.values(), key=lambda r: repr(r.key()))
        return f

    def flag(self, line: int) -> int:
        return S.EDGE_DEAD_BRANCH if any(a <= line <= b for a, b in self.dead) else 0

    def declare(self, name: str, kind: str, at, imported: tuple | None = None, column: int | None = None, width: int | None = None) -> int:
        column = at.col_offset if column is None else column
        end = at.end_lineno, at.end_col_offset
        if width is not None:
            end = at.lineno, column + width
        flags = S.DEAD_BRANCH if self.flag(at.lineno) else 0
        self.file.nodes.append(Node(f"{self.module}.{name}", kind, at.lineno, at.col_offset, *end, flags, imported, name))
        return len(self.file.nodes) - 1

    def bind(self, name: str, node: int) -> None:
        self.live[name] = {node}

    # statements at module level

    def block(self, body: list[ast.stmt]) -> None:
        for s in body:
            self.statement(s)

    def branches(self, *bodies) -> None:
        """Runs each from the same state; afterwards what is live in any is live."""
        start, out = {k: set(v) for k, v in self.live.items()}, {}
        for body in bodies:
            self.live = {k: set(v) for k, v in start.items()}
            body()
            for k, v in self.live.items():
                out.setdefault(k, set()).update(v)
        self.live = out

    def statement(self, s: ast.stmt) -> None:
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.function(s)
        elif isinstance(s, ast.ClassDef):
            self.klass(s)
        elif isinstance(s, (ast.Import, ast.ImportFrom)):
            self.imports(s)
        elif isinstance(s, ast.Assign):
            self.assign(s.targets, s.value)
        elif isinstance(s, ast.AnnAssign):
            self.annotated(s)
        elif isinstance(s, ast.AugAssign):
            self.augmented(s)
        elif hasattr(ast, "TypeAlias") and isinstance(s, ast.TypeAlias):
            node = self.declare(s.name.id, "type_alias", s.name)
            scope = {p.name for p in s.type_params}
            self.expr(s.value, node, [scope])
            self.bind(s.name.id, node)
        elif isinstance(s, (ast.If, ast.While)):
            self.expr(s.test, 0, [])
            self.branches(lambda: self.block(s.body), lambda: self.block(s.orelse))
        elif isinstance(s, (ast.For, ast.AsyncFor)):
            self.expr(s.iter, 0, [])
            self.target_uses(s.target, 0, [])
            self.branches(lambda: self.block(s.body), lambda: None)
            self.block(s.orelse)
        elif isinstance(s, (ast.With, ast.AsyncWith)):
            for item in s.items:
                self.expr(item.context_expr, 0, [])
                if item.optional_vars is not None:
                    self.target_uses(item.optional_vars, 0, [])
            self.block(s.body)
        elif isinstance(s, ast.Try) or s.__class__.__name__ == "TryStar":
            self.branches(lambda: (self.block(s.body), self.block(s.orelse)), *[lambda h=h: (self.expr(h.type, 0, []), self.block(h.body)) for h in s.handlers])
            self.block(s.finalbody)
        elif isinstance(s, ast.Match):
            self.expr(s.subject, 0, [])
            self.branches(lambda: None, *[lambda c=c: (self.pattern(c.pattern, 0, []), self.expr(c.guard, 0, []), self.block(c.body)) for c in s.cases])
        elif isinstance(s, ast.Delete):
            for t in s.targets:
                if isinstance(t, ast.Name):
                    self.use(t.id, 0, [], (), t.lineno)
                    self.live.pop(t.id, None)
                else:
                    self.expr(t, 0, [])
        else:
            for x in ast.iter_child_nodes(s):
                self.expr(x, 0, [])

    def function(self, s) -> None:
        line = self.lines[s.lineno - 1]
        m = re.search(rf"\b(?:async\s+)?def\s+({re.escape(s.name)})", line[s.col_offset :])
        end = s.col_offset + m.end(1) if m else s.end_col_offset
        node = self.declare(s.name, "function", s, width=end - s.col_offset)
        self.file.nodes[node].overload = any(_last(d) == "overload" for d in s.decorator_list)
        self.signature(s, node, [])
        self.decorator_facts(s, node)
        names = [a.arg for a in [*s.args.posonlyargs, *s.args.args, *s.args.kwonlyargs]]
        self.file.facts.append(("params", node, json.dumps(names)))
        self.bind(s.name, node)
        self.later(s, node, [])

    def later(self, s, owner: int, scopes: list[set]) -> None:
        """A function's body, once the module's end is known."""
        self.deferred.append(lambda: self.function_body(s, owner, scopes))

    def signature(self, s, owner: int, scopes: list[set]) -> None:
        for d in s.decorator_list:
            self.expr(d, owner, scopes)
        own = [*scopes, {p.name for p in getattr(s, "type_params", [])}]
        for p in getattr(s, "type_params", []):
            self.expr(getattr(p, "bound", None), owner, own)
        a = s.args
        for x in [*a.defaults, *a.kw_defaults]:
            self.expr(x, owner, scopes)
        for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg]:
            if x is not None:
                self.annotation(x.annotation, owner, own)
        self.annotation(s.returns, owner, own)

    def function_body(self, s, owner: int, scopes: list[set]) -> None:
        own = _locals(s)
        inner = [*scopes, own]
        aliases: dict[str, tuple] = {}
        body = s.body if isinstance(s.body, list) else [ast.Expr(s.body)]
        for x in body:
            self.nested(x, owner, inner, aliases)

    def nested(self, s: ast.stmt, owner: int, scopes: list[set], aliases: dict) -> None:
        """A statement in a function: no nodes; its imports are uses of the owner."""
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.signature(s, owner, scopes)
            own = _locals(s)
            for x in s.body:
                self.nested(x, owner, [*scopes, own], {k: v for k, v in aliases.items() if k not in own})
        elif isinstance(s, ast.ClassDef):
            for x in [*s.decorator_list, *s.bases, *[k.value for k in s.keywords]]:
                self.expr(x, owner, scopes, aliases)
            for x in s.body:
                self.nested(x, owner, scopes, aliases)
        elif isinstance(s, ast.Import):
            for a in s.names:
                aliases[(a.asname or a.name).split(".")[0]] = (a.name, None, a.asname or a.name.split(".")[0], a.asname is not None)
                self.file.refs.append(Ref(owner, "use", module=a.name, flags=self.flag(s.lineno)))
        elif isinstance(s, ast.ImportFrom):
            if (module := absolute(s.module, s.level, self.module, self.package)) is not None:
                for a in s.names:
                    if a.name != "*":
                        aliases[a.asname or a.name] = (module, a.name, a.asname or a.name, True)
                        self.file.refs.append(Ref(owner, "use", module=module, decl=a.name, flags=self.flag(s.lineno)))
        elif isinstance(s, ast.AnnAssign):
            self.annotation(s.annotation, owner, scopes)
            self.expr(s.value, owner, scopes, aliases)
            self.expr(s.target, owner, scopes, aliases)
        else:
            for x in ast.iter_child_nodes(s):
                if isinstance(x, ast.stmt):
                    self.nested(x, owner, scopes, aliases)
                elif isinstance(x, (ast.ExceptHandler, ast.match_case)):
                    for y in ast.iter_child_nodes(x):
                        self.nested(y, owner, scopes, aliases) if isinstance(y, ast.stmt) else self.expr(y, owner, scopes, aliases)
                else:
                    self.expr(x, owner, scopes, aliases)

    def klass(self, s: ast.ClassDef) -> None:
        line = self.lines[s.lineno - 1]
        m = re.search(rf"\bclass\s+({re.escape(s.name)})", line[s.col_offset :])
        end = s.col_offset + m.end(1) if m else s.end_col_offset
        node = self.declare(s.name, "class", s, width=end - s.col_offset)
        for d in s.decorator_list:
            self.expr(d, node, [])
        params = {p.name for p in getattr(s, "type_params", [])}
        for p in getattr(s, "type_params", []):
            self.expr(getattr(p, "bound", None), node, [params])
        for x in [*s.bases, *[k.value for k in s.keywords]]:
            self.expr(x, node, [params])
        for b in s.bases:
            if name := _dotted(b.value if isinstance(b, ast.Subscript) else b):
                self.base_fact(node, name)
        methods = [x.name for x in s.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
        self.file.facts.append(("methods", node, json.dumps(methods)))
        names = [a.arg for x in s.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) for a in [*x.args.posonlyargs, *x.args.args, *x.args.kwonlyargs]]
        self.file.facts.append(("class_params", node, json.dumps([x for x in dict.fromkeys(names) if x not in ("self", "cls")])))
        self.decorator_facts(s, node)
        self.class_body(s.body, node, [params])
        self.bind(s.name, node)

    def class_body(self, body: list[ast.stmt], owner: int, scopes: list[set]) -> None:
        """Statements see what is live here and the class's own names; methods see the module's end."""
        own: set[str] = set()
        for s in body:
            inside = [*scopes, own]
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.signature(s, owner, inside)
                self.later(s, owner, scopes)
                own.add(s.name)
            elif isinstance(s, ast.ClassDef):
                for x in [*s.decorator_list, *s.bases, *[k.value for k in s.keywords]]:
                    self.expr(x, owner, inside)
                self.class_body(s.body, owner, scopes)
                own.add(s.name)
            elif isinstance(s, (ast.Import, ast.ImportFrom)):
                self.nested(s, owner, inside, {})
                own.update((a.asname or a.name).split(".")[0] for a in s.names)
            else:
                if isinstance(s, ast.AnnAssign):
                    self.annotation(s.annotation, owner, inside)
                    self.expr(s.value, owner, inside)
                    self.target_uses(s.target, owner, inside)
                elif isinstance(s, (ast.Assign, ast.AugAssign)):
                    self.expr(s.value, owner, inside)
                    for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                        self.target_uses(t, owner, inside)
                else:
                    self.nested(s, owner, inside, {})
                own.update(x.id for x in ast.walk(s) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store))

    def assign(self, targets: list[ast.expr], value: ast.expr) -> None:
        made: list[tuple[str, int]] = []
        for t in targets:
            made += self.assign_one(t, value)
        if not made:
            self.expr(value, 0, [])
        for name, node in made:
            self.bind(name, node)
            if name == "__all__":
                self.all_entries(value, node)

    def assign_one(self, t: ast.expr, value: ast.expr) -> list[tuple[str, int]]:
        """Declares a target's names; each owns the value, or its part where both are tuples of one length."""
        if isinstance(t, ast.Name):
            node = self.declare(t.id, "variable", t)
            self.expr(value, node, [])
            self.value_facts(t.id, value, node)
            return [(t.id, node)]
        if isinstance(t, ast.Starred):
            return self.assign_one(t.value, value)
        if isinstance(t, (ast.Tuple, ast.List)):
            pairs = [(x, value) for x in t.elts]
            if isinstance(value, (ast.Tuple, ast.List)) and len(value.elts) == len(t.elts) and not any(isinstance(x, ast.Starred) for x in [*t.elts, *value.elts]):
                pairs = list(zip(t.elts, value.elts))
            return [y for x, v in pairs for y in self.assign_one(x, v)]
        self.expr(t, 0, [])
        self.expr(value, 0, [])
        return []

    def annotated(self, s: ast.AnnAssign) -> None:
        if isinstance(s.target, ast.Name):
            node = self.declare(s.target.id, "variable", s.target)
            self.annotation(s.annotation, node, [])
            self.expr(s.value, node, [])
            if s.value is not None:
                self.value_facts(s.target.id, s.value, node)
            self.bind(s.target.id, node)
            if s.target.id == "__all__" and s.value is not None:
                self.all_entries(s.value, node)
        else:
            self.annotation(s.annotation, 0, [])
            self.expr(s.value, 0, [])
            self.expr(s.target, 0, [])

    def augmented(self, s: ast.AugAssign) -> None:
        if isinstance(s.target, ast.Name):
            node = self.declare(s.target.id, "variable", s.target)
            self.use(s.target.id, node, [], (), s.lineno)
            self.expr(s.value, node, [])
            self.bind(s.target.id, node)
        else:
            self.expr(s.target, 0, [])
            self.expr(s.value, 0, [])

    def all_entries(self, value: ast.expr, node: int) -> None:
        if isinstance(value, (ast.List, ast.Tuple)) and all(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in value.elts):
            names = [x.value for x in value.elts]
            self.file.facts.append(("all", node, json.dumps(names)))
            self.deferred.append(lambda: [self.file.refs.append(Ref(node, "local", target=i)) for n in names for i in self.file.exports.get(n, ())])
        else:
            self.file.facts.append(("all", node, "[]"))

    def imports(self, s) -> None:
        for a in s.names:
            if isinstance(s, ast.Import):
                imported, name = (a.name, None, False), a.asname or a.name.split(".")[0]
            else:
                module = absolute(s.module, s.level, self.module, self.package)
                if module is None:
                    continue
                if a.name == "*":
                    node = self.declare(f"*{module}", "import", a, (module, None, True))
                    self.file.stars.append((node, module))
                    self.file.refs.append(Ref(node, "binding", module=module, star=True, flags=self.flag(s.lineno)))
                    continue
                imported, name = (module, a.name, False), a.asname or a.name
            node = self.declare(name, "import", a, imported)
            self.file.facts.append(("import", node, json.dumps([imported[0], imported[1], name])))
            self.file.refs.append(Ref(node, "binding", module=imported[0], decl=imported[1], flags=self.flag(s.lineno)))
            self.bind(name, node)

    # expressions

    def target_uses(self, t: ast.expr, owner: int, scopes: list[set]) -> None:
        """What a target that makes no node uses: subscripts' and attributes' values."""
        if isinstance(t, (ast.Tuple, ast.List)):
            for x in t.elts:
                self.target_uses(x, owner, scopes)
        elif isinstance(t, ast.Starred):
            self.target_uses(t.value, owner, scopes)
        elif not isinstance(t, ast.Name):
            self.expr(t, owner, scopes)

    def pattern(self, p, owner: int, scopes: list[set]) -> None:
        for x in ast.walk(p):
            if isinstance(x, ast.expr):
                self.expr(x, owner, scopes)

    def annotation(self, e, owner: int, scopes: list[set]) -> None:
        """An annotation: strings in it are expressions."""
        if e is None:
            return
        for x in ast.walk(e):
            if isinstance(x, ast.Constant) and isinstance(x.value, str):
                try:
                    parsed = ast.parse(x.value.strip(), mode="eval").body
                except (SyntaxError, ValueError):
                    continue
                for y in ast.walk(parsed):
                    if hasattr(y, "lineno"):
                        y.lineno = x.lineno
                # A quoted name is looked up late: it sees the module's end.
                self.deferred.append(lambda parsed=parsed: self.expr(parsed, owner, scopes))
        self.expr(e, owner, scopes)

    def expr(self, e, owner: int, scopes: list[set], aliases: dict | None = None) -> None:
        if e is None:
            return
        if isinstance(e, ast.Name):
            if isinstance(e.ctx, ast.Load):
                self.use(e.id, owner, scopes, (), e.lineno, aliases)
            return
        if isinstance(e, ast.Attribute):
            root, chain = e, []
            while isinstance(root, ast.Attribute):
                chain.append(root.attr)
                root = root.value
            if isinstance(root, ast.Name):
                self.use(root.id, owner, scopes, tuple(reversed(chain)), e.lineno, aliases)
            else:
                self.expr(root, owner, scopes, aliases)
            return
        if isinstance(e, ast.Call):
            self.call(e, owner)
        if isinstance(e, ast.Lambda):
            for x in [*e.args.defaults, *e.args.kw_defaults]:
                self.expr(x, owner, scopes, aliases)
            own = {a.arg for a in [*e.args.posonlyargs, *e.args.args, *e.args.kwonlyargs, e.args.vararg, e.args.kwarg] if a is not None}
            if owner == 0 or not scopes:
                self.deferred.append(lambda: self.expr(e.body, owner, [*scopes, own], aliases))
            else:
                self.expr(e.body, owner, [*scopes, own], aliases)
            return
        if isinstance(e, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            own: set[str] = set()
            for i, g in enumerate(e.generators):
                self.expr(g.iter, owner, scopes if i == 0 else [*scopes, own], aliases)
                own.update(x.id for x in ast.walk(g.target) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store))
                for c in g.ifs:
                    self.expr(c, owner, [*scopes, own], aliases)
            for x in [e.key, e.value] if isinstance(e, ast.DictComp) else [e.elt]:
                self.expr(x, owner, [*scopes, own], aliases)
            return
        if isinstance(e, ast.NamedExpr) and not scopes and owner == 0:
            node = self.declare(e.target.id, "variable", e.target)
            self.expr(e.value, node, scopes, aliases)
            self.bind(e.target.id, node)
            return
        for x in ast.iter_child_nodes(e):
            self.expr(x, owner, scopes, aliases)

    def use(self, name: str, owner: int, scopes: list[set], chain: tuple, line: int, aliases: dict | None = None) -> None:
        flag = self.flag(line)
        if aliases and name in aliases:
            module, decl, _, whole = aliases[name]
            self.member(owner, module, decl, name, whole, chain, flag)
            return
        if any(name in s for s in scopes):
            return
        found = self.live.get(name, ()) if not self.file.exports else self.file.exports.get(name, ())
        if not found and self.file.stars:
            # A star import may bring it.
            self.file.refs.append(Ref(owner, "starred", module=self.module, decl=name, flags=flag))
        for i in found:
            self.file.refs.append(Ref(owner, "local", target=i, flags=flag))
            if i in self.modules and chain:
                self.member(owner, self.modules[i], None, name, True, chain, flag)
            if (imported := self.file.nodes[i].imported) is not None:
                self.member(owner, imported[0], imported[1], name, imported[1] is not None or name != imported[0].split(".")[0], chain, flag)

    def member(self, owner: int, module: str, decl: str | None, bound: str, whole: bool, chain: tuple, flag: int) -> None:
        """A use of what an import binds. `import a.b` binds a: the chain must go on with b to load a.b."""
        if decl is None and not whole and "." in module:
            rest = tuple(module.split(".")[1:])
            if chain[: len(rest)] == rest:
                chain = chain[len(rest) :]
            else:
                module = bound
        self.file.refs.append(Ref(owner, "use", module=module, decl=decl, chain=chain, flags=flag))

    def dynamic_module(self, e: ast.expr) -> str | None:
        """The module that import_module("...") or __import__("...") of a plain string gives."""
        if not (isinstance(e, ast.Call) and e.args and isinstance(e.args[0], ast.Constant) and isinstance(e.args[0].value, str)):
            return None
        name, text = e.args[0].value, _dotted(e.func)
        if text in ("importlib.import_module", "import_module"):
            if not name.startswith("."):
                return name
            level = len(name) - len(name.lstrip("."))
            return absolute(name[level:] or None, level, self.module, self.package) if len(e.args) == 1 and not e.keywords else None
        if text == "__import__" and len(e.args) == 1 and not e.keywords:
            return name.split(".")[0]
        return None

    def call(self, e: ast.Call, owner: int) -> None:
        """Dynamic imports, and call sites with string arguments."""
        text = _dotted(e.func)
        args = [a.value if isinstance(a, ast.Constant) else None for a in e.args]
        kw = {k.arg: k.value for k in e.keywords if k.arg}
        lit = lambda x: x.value if isinstance(x, ast.Constant) else None
        flag = self.flag(e.lineno) | S.EDGE_DYNAMIC_IMPORT
        if text == "__import__" and args and isinstance(args[0], str):
            level = args[4] if len(args) > 4 else lit(kw["level"]) if "level" in kw else 0
            names = e.args[3] if len(e.args) > 3 else kw.get("fromlist")
            found = tuple(x.value for x in names.elts if isinstance(x, ast.Constant) and isinstance(x.value, str) and x.value) if isinstance(names, (ast.List, ast.Tuple)) else ()
            if isinstance(level, int) and (module := absolute(args[0] or None, level, self.module, self.package)):
                self.file.refs.append(Ref(owner, "dynamic", module=module, names=found, flags=flag))
        elif text in ("importlib.import_module", "import_module") and args and isinstance(args[0], str):
            name = args[0]
            level = len(name) - len(name.lstrip("."))
            anchor = e.args[1] if len(e.args) > 1 else kw.get("package")
            if level and anchor is not None:
                anchor = lit(anchor)
                module = absolute(name[level:] or None, level, anchor, True) if isinstance(anchor, str) else None
            else:
                module = absolute(name[level:] or None, level, self.module, self.package)
            if module:
                self.file.refs.append(Ref(owner, "dynamic", module=module, flags=flag))
        strings = [[a] if isinstance(a, str) else [x.value for x in e.args[i].elts if isinstance(x, ast.Constant) and isinstance(x.value, str)] if isinstance(e.args[i], (ast.List, ast.Tuple, ast.Set)) else None for i, a in enumerate(args)]
        if text and any(strings):
            self.file.facts.append(("call", owner, json.dumps([text, len(args), strings])))
        if text and owner:
            self.file.facts.append(("factory", owner, text))

    # facts and the last pass

    def decorator_facts(self, s, node: int) -> None:
        for d in s.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            name = _dotted(call.func if call else d)
            if name:
                kwargs = {k.arg: k.value.value for k in (call.keywords if call else []) if k.arg and isinstance(k.value, ast.Constant) and isinstance(k.value.value, str)}
                self.file.facts.append(("decorator", node, json.dumps([name, kwargs])))

    def base_fact(self, node: int, name: str) -> None:
        root, *rest = name.split(".")
        for i in self.live.get(root, ()):
            n = self.file.nodes[i]
            if n.imported is not None:
                module, decl, _ = n.imported
                base = root if decl is None and n.bound == module.split(".")[0] else module
                self.file.facts.append(("base", node, ".".join([base, *([decl] if decl else []), *rest])))
            elif not rest:
                self.file.facts.append(("base", node, n.name))

    def value_facts(self, name: str, value: ast.expr, node: int) -> None:
        if module := self.dynamic_module(value):
            self.modules[node] = module
            self.file.facts.append(("denotes", node, module))
        if isinstance(value, ast.Call) and (ctor := _dotted(value.func)):
            self.file.facts.append(("construction", node, ctor))
        if isinstance(value, (ast.List, ast.Tuple)) and value.elts and all(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in value.elts):
            self.file.facts.append(("literals", node, json.dumps([x.value for x in value.elts])))

    def main_block(self, body: list[ast.stmt]) -> None:
        """The lines of the first `if __name__ == "__main__"` at top level, either way round."""
        for s in body:
            if isinstance(s, ast.If) and isinstance(s.test, ast.Compare) and len(s.test.ops) == 1 and isinstance(s.test.ops[0], ast.Eq):
                sides = {getattr(x, "id", getattr(x, "value", None)) if isinstance(x, (ast.Name, ast.Constant)) else None for x in (s.test.left, s.test.comparators[0])}
                if sides == {"__name__", "__main__"}:
                    self.file.facts.append(("main_block", 0, json.dumps([s.lineno, s.body[-1].end_lineno])))
                    return

    def anchors(self) -> None:
        for i, n in enumerate(self.file.nodes):
            simple = n.bound or ""
            if i and ((n.kind in ("variable", "function") and len(simple) > 4 and simple.startswith("__") and simple.endswith("__")) or (n.imported and n.imported[0] == "__future__")):
                self.file.refs.append(Ref(0, "local", target=i))

    def overloads(self) -> None:
        last: dict[str, int] = {}
        for i, n in enumerate(self.file.nodes):
            if n.kind == "function" and not n.overload:
                last[n.name] = i
        for i, n in enumerate(self.file.nodes):
            if n.overload:
                if n.name in last:
                    self.file.refs.append(Ref(last[n.name], "local", target=i))
                for v in self.file.exports.values():
                    if len(v) > 1:
                        v.discard(i)

    def pins(self) -> None:
        """Imports that a noqa comment pins: a bare one, or one that names F401."""
        for n in self.file.nodes:
            if n.kind == "import":
                for k in range(n.line - 1, min(n.end_line, len(self.lines))):
                    m = NOQA.search(self.lines[k])
                    if m and (m["codes"] is None or "F401" in m["codes"].upper()):
                        n.flags |= S.NOQA


def _last(d: ast.expr) -> str:
    d = d.func if isinstance(d, ast.Call) else d
    return d.attr if isinstance(d, ast.Attribute) else d.id if isinstance(d, ast.Name) else ""


def _dotted(e: ast.expr) -> str | None:
    parts = []
    while isinstance(e, ast.Attribute):
        parts.append(e.attr)
        e = e.value
    return ".".join([e.id, *reversed(parts)]) if isinstance(e, ast.Name) else None


def _locals(s) -> set[str]:
    """Names that a function binds, without those that it declares global; names of nested scopes are not its own."""
    out = {a.arg for a in [*s.args.posonlyargs, *s.args.args, *s.args.kwonlyargs, s.args.vararg, s.args.kwarg] if a is not None}
    out |= {p.name for p in getattr(s, "type_params", [])}
    free: set[str] = set()

    def walk(x) -> None:
        for y in ast.iter_child_nodes(x):
            if isinstance(y, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                out.add(y.name)
            elif isinstance(y, (ast.Lambda, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
                out.update(z.target.id for z in ast.walk(y) if isinstance(z, ast.NamedExpr))
            else:
                if isinstance(y, ast.Name) and isinstance(y.ctx, (ast.Store, ast.Del)):
                    out.add(y.id)
                elif isinstance(y, ast.ExceptHandler) and y.name:
                    out.add(y.name)
                elif isinstance(y, (ast.MatchAs, ast.MatchStar)) and y.name:
                    out.add(y.name)
                elif isinstance(y, (ast.Global, ast.Nonlocal)):
                    free.update(y.names)
                elif isinstance(y, (ast.Import, ast.ImportFrom)):
                    out.update((a.asname or a.name).split(".")[0] for a in y.names)
                walk(y)

    for x in s.body if isinstance(s.body, list) else [s.body]:
        walk(ast.Module([x], []) if isinstance(x, ast.stmt) else x)
    return out - free


def extract(source: str, module: str, package: bool) -> File:
    return Extractor(source, module, package).run()
