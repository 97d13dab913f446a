"""Built-in plug-ins over a graph's facts; each is a few joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.names import basename, is_test_file, simple_name
from ..operators.closure import cut
from ..operators.lookups import find_declarations, first_variables, last_modules
from .plugins import GraphView, Ops, Plugin, dispatch_edges, subclasses

STRINGS = "array<string>"


def fact(view: GraphView, topic: str, value_type: str = STRINGS) -> DataFrame:
    """node_id, path and the value, parsed."""
    return view.facts_for(topic).select("node_id", "path", F.from_json("value", value_type).alias("v"))


def imported_names(view: GraphView) -> DataFrame:
    """(path, name, target): what each file's import names stand for, the last import of a name winning."""
    return view.once("imported_names", lambda: _imported_names(view))


def _imported_names(view: GraphView) -> DataFrame:
    d = fact(view, "import").select("path", "node_id", F.get("v", F.lit(2)).alias("name"), F.when(F.get("v", F.lit(1)).isNull() & (F.get("v", F.lit(2)) == F.split(F.get("v", F.lit(0)), "[.]")[0]), F.get("v", F.lit(2))).otherwise(F.concat_ws(".", F.get("v", F.lit(0)), F.get("v", F.lit(1)))).alias("target"))
    return d.groupBy("path", "name").agg(F.max_by("target", "node_id").alias("target"))


def spelled(view: GraphView, d: DataFrame, column: str) -> DataFrame:
    """d (path, ...) with full: the dotted name in the column with its first segment replaced by what the file imports under it, or else put below the file's module."""
    first, rest = F.split(column, "[.]")[0], F.regexp_extract(column, r"^[^.]*[.](.*)$", 1)
    names = imported_names(view)
    out = d.withColumn("_first", first).join(names.select("path", F.col("name").alias("_first"), "target"), ["path", "_first"], "left")
    modules = view.nodes.where("kind = 'module'").groupBy("path").agg(F.max("fqname").alias("_module"))
    out = out.join(modules, "path", "left")
    return out.withColumn("full", F.when(F.col("target").isNull(), F.concat_ws(".", "_module", column)).when(rest == "", F.col("target")).otherwise(F.concat_ws(".", "target", rest))).drop("_first", "target", "_module")


def decorated(view: GraphView) -> DataFrame:
    """node_id, path, name (as spelled), full and kwargs of each decorator."""
    return view.once("decorated", lambda: _decorated(view))


def _decorated(view: GraphView) -> DataFrame:
    d = view.facts_for("decorator").select("node_id", "path", F.get_json_object("value", "$[0]").alias("name"), F.from_json(F.get_json_object("value", "$[1]"), "map<string,string>").alias("kwargs"))
    return spelled(view, d, "name")


class Pytest(Plugin):
    """Tests and fixtures: flags by file and name, and edges from tests to the fixtures that their parameters name."""

    name = "pytest"

    def declare(self, registry) -> None:
        self.testcase = registry.nodes.declare("test/testcase", True, True, "a test")
        self.fixture = registry.nodes.declare("test/fixture", True, True, "a test fixture")

    def run(self, view: GraphView) -> Ops:
        nodes = view.nodes
        simple = simple_name(F.col("fqname"))
        in_tests = nodes.where(is_test_file(F.col("path")))
        tests = in_tests.where((F.col("kind") == "function") & simple.startswith("test") | (F.col("kind") == "class") & simple.startswith("Test")).select("node_id")
        hooks = nodes.where((basename(F.col("path")) == "conftest.py") & ~F.col("kind").isin("import", "type_alias")).select("node_id")
        marks = decorated(view).where(F.col("full").isin("pytest.fixture", "pytest_asyncio.fixture"))
        fixtures = marks.join(nodes.select("node_id", simple.alias("own")), "node_id").select("node_id", F.coalesce(F.element_at("kwargs", "name"), F.col("own")).alias("name"))
        flags = tests.select("node_id", F.lit(self.testcase).cast("long").alias("bits")).unionByName(fixtures.select("node_id", F.lit(self.fixture).cast("long").alias("bits"))).unionByName(hooks.select("node_id", F.lit(S.ENTRYPOINT).cast("long").alias("bits")))
        params = fact(view, "params").unionByName(fact(view, "class_params")).select("node_id", F.explode("v").alias("name")).join(tests, "node_id", "left_semi")
        edges = params.join(fixtures.select(F.col("node_id").alias("dst"), "name"), "name").select(F.col("node_id").alias("src"), "dst", F.lit(0).alias("flags")).distinct()
        return Ops(flags, edges)


class Unittest(Plugin):
    """Subclasses of unittest's cases are tests; modules that import unittest lead to the hooks that it calls by name."""

    name = "unittest"
    HOOKS = ("setUpModule", "tearDownModule", "load_tests")

    def declare(self, registry) -> None:
        self.testcase = registry.nodes.declare("test/testcase", True, True, "a test")

    def run(self, view: GraphView) -> Ops:
        found = subclasses_of(view, ["unittest.TestCase", "unittest.IsolatedAsyncioTestCase", "unittest.case.TestCase"])
        source = F.col("import.module")
        active = view.nodes.where((F.col("kind") == "import") & ((source == "unittest") | source.startswith("unittest."))).select("path").distinct()
        hooks = view.nodes.where((F.col("kind") == "function") & simple_name(F.col("fqname")).isin(*self.HOOKS)).select("path", F.col("node_id").alias("dst"))
        modules = view.nodes.where("kind = 'module'").select("path", F.col("node_id").alias("src"))
        edges = hooks.join(active, "path", "left_semi").join(modules, "path").select("src", "dst", F.lit(0).alias("flags"))
        return Ops(found.select("node_id", F.lit(self.testcase).cast("long").alias("bits")), edges)


def hierarchy(view: GraphView) -> tuple[DataFrame, DataFrame]:
    """(sub, super) between the project's classes, and (sub, name) of bases outside it."""
    bases = view.facts_for("base").select(F.col("node_id").alias("sub"), F.col("value").alias("name"))
    classes = view.nodes.where("kind = 'class'").select(F.col("fqname").alias("name"), F.col("node_id").alias("super"))
    return view.once("inside", lambda: bases.join(classes, "name").select("sub", "super")), view.once("outside", lambda: bases.join(classes, "name", "left_anti"))


def subclasses_of(view: GraphView, names: list[str]) -> DataFrame:
    """node_id of all classes below classes of those names, of the project or not; only outside ones' direct children count themselves."""
    inside, outside = hierarchy(view)
    direct = outside.where(F.col("name").isin(names)).select(F.col("sub").alias("node_id"))
    seeds = view.nodes.where((F.col("kind") == "class") & F.col("fqname").isin(names)).select("node_id").unionByName(direct)
    return subclasses(inside, seeds, **view.graph.how).unionByName(direct).distinct()


class InitSubclass(Plugin):
    """A class that defines __init_subclass__ keeps its subclasses alive."""

    name = "init_subclass"

    def run(self, view: GraphView) -> Ops:
        hooks = fact(view, "methods").where(F.array_contains("v", "__init_subclass__")).select(F.col("node_id").alias("super"))
        inside, _ = hierarchy(view)
        down = cut(inside.join(hooks, "super", "left_semi").select(F.col("super").alias("src"), F.col("sub").alias("dst")))
        reached = down
        while not reached.isEmpty():
            more = cut(reached.join(inside, reached["dst"] == inside["super"]).select("src", F.col("sub").alias("dst")).join(down, ["src", "dst"], "left_anti").distinct())
            if more.isEmpty():
                break
            down, reached = down.unionByName(more), more
        return Ops(edges=down.where("src <> dst").select("src", "dst", F.lit(S.EDGE_INIT_SUBCLASS).alias("flags")).distinct())


class ProjectScripts(Plugin):
    """Keeps alive what [project.scripts] names."""

    name = "project_scripts"

    def __init__(self, targets: list[str]):
        self.targets = targets

    def run(self, view: GraphView) -> Ops:
        if not self.targets:
            return Ops()
        names = view.nodes.sparkSession.createDataFrame([(x,) for x in self.targets], "name string")
        decls = find_declarations(view.nodes, names)
        rest = names.join(decls, "name", "left_anti").join(last_modules(view.nodes).withColumnRenamed("fqname", "name"), "name").select("node_id")
        return Ops.keep_alive(decls.select("node_id").unionByName(rest))


class DispatchApp(Plugin):
    """Apps of a framework: their variables lead to the handlers registered on them."""

    def __init__(self, name: str, classes: list[str], methods: list[str], seed: bool):
        self.name, self.classes, self.methods, self.seed = name, classes, methods, seed

    def run(self, view: GraphView) -> Ops:
        nodes = view.nodes
        own = subclasses_of(view, self.classes).join(nodes.select("node_id", "fqname"), "node_id").select(F.col("fqname").alias("full"))
        kinds = own.unionByName(nodes.sparkSession.createDataFrame([(c,) for c in self.classes], "full string"))
        made = spelled(view, view.facts_for("construction").select("node_id", "path", F.col("value").alias("ctor")), "ctor").join(kinds, "full", "left_semi").select("node_id").distinct()
        d = decorated(view).withColumn("parts", F.split("name", "[.]")).where(F.size("parts") == 2)
        handlers = d.where(F.get("parts", F.lit(1)).isin(self.methods)).select("node_id", "path", F.get("parts", F.lit(0)).alias("owner"))
        first = first_variables(nodes)
        apps = first if self.seed else first.join(made, "node_id", "left_semi")
        # Without an import of the framework, no variable is its app.
        tops = {c.rsplit(".", 1)[0] for c in self.classes}
        active = fact(view, "import").where(reduce(lambda a, b: a | b, [(F.get("v", F.lit(0)) == t) | F.get("v", F.lit(0)).startswith(f"{t}.") for t in tops])).select("path").distinct()
        edges = dispatch_edges(apps.join(active, "path", "left_semi"), handlers)
        kept = made
        if self.name in SHARED_TASKS:
            kept = kept.unionByName(decorated(view).where(F.col("full").isin(SHARED_TASKS[self.name])).select("node_id"))
        return Ops(Ops.keep_alive(kept).flags if self.seed else None, edges)


# Each framework's app classes, the decorators that register handlers, and whether apps are entry points.
FRAMEWORKS = {
    "flask": (
        ["flask.Flask"],
        """route get post put delete patch before_request after_request teardown_request teardown_appcontext
        before_first_request before_app_request after_app_request teardown_app_request before_app_first_request
        errorhandler app_errorhandler context_processor app_context_processor template_filter app_template_filter
        template_test app_template_test template_global app_template_global url_value_preprocessor
        app_url_value_preprocessor url_defaults app_url_defaults shell_context_processor record record_once""".split(),
        True,
    ),
    "fastapi": (["fastapi.FastAPI"], "get post put delete patch options head trace api_route websocket websocket_route middleware exception_handler on_event".split(), True),
    "typer": (["typer.Typer"], ["command", "callback"], False),
    "cyclopts": (["cyclopts.App"], ["command", "default"], False),
    "slack_bolt": (["slack_bolt.App", "slack_bolt.async_app.AsyncApp"], "event message command action shortcut view options error step function".split(), True),
    "fastmcp": (["fastmcp.FastMCP", "mcp.server.fastmcp.FastMCP"], ["tool", "resource", "prompt", "completion"], True),
    "celery": (["celery.Celery"], ["task"], True),
}
SHARED_TASKS = {"celery": ["celery.shared_task"]}


class MainBlock(Plugin):
    """Keeps alive modules with a main block and what is declared in the block."""

    name = "main_block"

    def run(self, view: GraphView) -> Ops:
        blocks = view.facts_for("main_block").select("path", F.from_json("value", "array<int>").alias("b")).select("path", F.get("b", F.lit(0)).alias("low"), F.get("b", F.lit(1)).alias("high"))
        inside = view.nodes.join(blocks, "path").where((F.col("kind") == "module") | F.col("start_line").between(F.col("low"), F.col("high")))
        return Ops.keep_alive(inside)


class MockPatch(Plugin):
    """Edges from what patches a dotted name in tests to that declaration."""

    name = "mock_patch"
    # Patching calls by their full names, and methods of a monkeypatch argument with their number of arguments.
    CALLS = ("unittest.mock.patch", "mock.patch")
    METHODS = {"monkeypatch.setattr": 2, "monkeypatch.delattr": 1}

    def run(self, view: GraphView) -> Ops:
        sites = call_sites(view)
        by_name = sites.where(F.col("full").isin(*self.CALLS))
        for spelling, arity in self.METHODS.items():
            by_name = by_name.unionByName(sites.where((F.col("spelled") == spelling) & (F.col("arity") == arity)))
        names = by_name.select("node_id", F.explode(F.get("strings", F.lit(0))).alias("name"))
        found = find_declarations(view.nodes, names.select("name")).unionByName(last_modules(view.nodes).select(F.col("fqname").alias("name"), "node_id")).withColumnRenamed("node_id", "dst")
        return Ops(edges=names.join(found, "name").select(F.col("node_id").alias("src"), "dst", F.lit(0).alias("flags")).where("src <> dst").distinct())


def call_sites(view: GraphView) -> DataFrame:
    """node_id (the declaration or module that calls), path, spelled, full, arity and strings (for each argument its strings or null)."""
    return view.once("call_sites", lambda: _call_sites(view))


def _call_sites(view: GraphView) -> DataFrame:
    d = view.facts_for("call").select("node_id", "path", F.get_json_object("value", "$[0]").alias("spelled"), F.get_json_object("value", "$[1]").cast("int").alias("arity"), F.from_json(F.get_json_object("value", "$[2]"), "array<array<string>>").alias("strings"))
    return spelled(view, d, "spelled")


def calls_to(view: GraphView, names: list[str], argument: int = 0) -> DataFrame:
    """(node_id, value) of calls to functions of those full names with strings as that argument."""
    return call_sites(view).where(F.col("full").isin(names)).select("node_id", F.explode(F.get("strings", F.lit(argument))).alias("value"))


def calls_on_attr(view: GraphView, attr: str, argument: int = 0) -> DataFrame:
    """(node_id, value) of calls of a method of any receiver."""
    own = call_sites(view).where(F.col("spelled").contains(".") & (F.substring_index("spelled", ".", -1) == attr))
    return own.select("node_id", F.explode(F.get("strings", F.lit(argument))).alias("value"))


def calls_on_var(view: GraphView, var: str, attr: str, arity: int, argument: int = 0) -> DataFrame:
    own = call_sites(view).where((F.col("spelled") == f"{var}.{attr}") & (F.col("arity") == arity))
    return own.select("node_id", F.explode(F.get("strings", F.lit(argument))).alias("value"))


def constructions(view: GraphView, names: list[str]) -> DataFrame:
    """(node_id, full) of variables that calls of those names make."""
    made = spelled(view, view.facts_for("construction").select("node_id", "path", F.col("value").alias("ctor")), "ctor")
    return made.where(F.col("full").isin(names)).select("node_id", "full")


def factories(view: GraphView, names: list[str]) -> DataFrame:
    """(node_id, kinds): declarations in whose text those are called, with the sorted names."""
    made = spelled(view, view.facts_for("factory").select("node_id", "path", F.col("value").alias("ctor")), "ctor").where(F.col("full").isin(names))
    return made.groupBy("node_id").agg(F.array_sort(F.collect_set("full")).alias("kinds"))


def decorated_decls(view: GraphView, names: list[str]) -> DataFrame:
    """(node_id, full, kwargs): one row for each declaration, the name that stands first in names winning."""
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("full"))
    own = decorated(view).where(F.col("full").isin(names)).withColumn("_rank", rank)
    best = own.groupBy("node_id").agg(F.min_by(F.struct("full", "kwargs"), "_rank").alias("x"))
    return best.select("node_id", "x.full", "x.kwargs")


def handler_decorators(view: GraphView, attrs: list[str], via: str | None = None) -> DataFrame:
    """(node_id, owner): declarations with @owner.attr, or @owner.via.attr."""
    parts = F.split("name", "[.]")
    d = decorated(view).select("node_id", parts.alias("parts")).where(F.size("parts") == (2 if via is None else 3))
    if via is not None:
        d = d.where(F.get("parts", F.lit(1)) == via)
    return d.where(F.element_at("parts", -1).isin(attrs)).select("node_id", F.get("parts", F.lit(0)).alias("owner")).distinct()


def classes_defining(view: GraphView, method: str) -> DataFrame:
    return fact(view, "methods").where(F.array_contains("v", method)).select("node_id").distinct()


def parameters(view: GraphView, ids: DataFrame, topic: str = "params") -> DataFrame:
    """(node_id, parameters) for each of ids; of other nodes an empty list. topic class_params: of classes' methods."""
    return ids.join(fact(view, topic).select("node_id", F.col("v").alias("parameters")), "node_id", "left").select("node_id", F.coalesce("parameters", F.array().cast(STRINGS)).alias("parameters"))


def dunder_all(view: GraphView) -> DataFrame:
    """(path, exports): the declarations that a module's last __all__ names; empty if it can't be read, no row without one."""
    last = fact(view, "all").groupBy("path").agg(F.max_by("v", "node_id").alias("names"))
    own = view.nodes.where("kind NOT IN ('module', 'external')").select("path", simple_name(F.col("fqname")).alias("name"), "node_id")
    hits = last.select("path", F.explode("names").alias("name")).join(own, ["path", "name"]).groupBy("path").agg(F.array_sort(F.collect_set("node_id")).alias("exports"))
    return last.select("path").join(hits, "path", "left").select("path", F.coalesce("exports", F.array().cast("array<bigint>")).alias("exports"))


def literal_entries(view: GraphView, name: str) -> DataFrame:
    """(path, entries): the strings of all lists of that name in a file, in order."""
    own = view.nodes.where(simple_name(F.col("fqname")) == name).select("node_id")
    lists = fact(view, "literals").join(own, "node_id", "left_semi").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("node_id", "v"))).alias("x"))
    return lists.select("path", F.flatten(F.transform("x", lambda y: y["v"])).alias("entries"))


def builtin(name: str, **options) -> Plugin:
    """A plug-in by name; KeyError for an unknown one."""
    if name in FRAMEWORKS:
        return DispatchApp(name, *FRAMEWORKS[name])
    return {"main_block": MainBlock, "mock_patch": MockPatch, "pytest": Pytest, "unittest": Unittest, "init_subclass": InitSubclass, "project_scripts": ProjectScripts}[name](**options)
