"""Static audit of strategy sources: does a decision read anything but the view it is given?

Sources are parsed, never run. Each function is interpreted in the order of its statements, with the tags of every name:

* `outside`: data from elsewhere than the view. A constructor's parameter is data if it, or what it is passed on to, is
  treated as a table somewhere; so are module-level tables.
* `view`: what came from the decision's own argument.
* `ahead`: later rows moved to earlier ones.
* `extreme`: the last or largest of outside data, for instance its last date.
* `summary`: a statistic of outside data.

Tags go through assignments, attributes of self, calls of functions of the same source and their results. Branches add
tags, and loop bodies are interpreted twice. Findings say what is done with such values.
"""

from __future__ import annotations

import ast
import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The names of the kinds of leaks.
CLASSES = ("future_indexing", "full_sample_fit", "full_sample_statistic", "survivorship_selection", "boundary_crossing_window", "target_in_features", "snooped_parameter", "point_in_time_bypass")
FINDING = "array<struct<leak_class:string,line:int,snippet:string,severity:string,explanation:string>>"


def _public(*kinds: type) -> set[str]:
    return {n for kind in kinds for n in dir(kind) if not n.startswith("_")}


#: Methods by what they do, from the public interface of pandas: what only tables have, what reduces a series or a window
#: of it to a number, and what makes windows. Other libraries spell these with a prefix or an underscore.
_BUILTIN = _public(dict, list, str, set, tuple, int, float, bytes)
TABLE = (_public(pd.DataFrame, pd.Series) - _BUILTIN) | {"group_by", "with_columns", "get_column", "iter_rows", "drop_nulls"}
REDUCE = (_public(pd.Series) & _public(pd.core.window.rolling.Rolling)) - {"apply", "agg", "aggregate", "rank", "corr", "cov", "pipe"} | {"first", "last"}
WINDOW = {n for n in _public(pd.DataFrame) if n in ("rolling", "expanding", "ewm", "resample")}
BACKWARD = {n for n in _public(pd.DataFrame) if n.startswith(("bfill", "backfill"))} | {"interpolate"}
SHIFT = {"shift", "lead", "diff", "pct_change"}
COLLECT = {"append", "extend", "insert", "add", "update", "hstack", "vstack", "column_stack", "concat", "assign", "with_columns", "join"}
READERS = {n for n in dir(pd) if n.startswith("read_")} | {"DataFrame", "Series"}
PREDICTS = "generate"
DEPTH = 5
#: Strings in a collection of the module from which it may be, and surely is, a list of names to trade.
FEW, MANY = 3, 10


@dataclass(frozen=True)
class Finding:
    leak_class: str
    line: int
    snippet: str
    severity: str
    explanation: str


def _is_window(name: str) -> bool:
    return name in WINDOW or name.startswith(("rolling_", "ewm_", "expanding_"))


def _negative(node: ast.AST) -> bool:
    return isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub)


def _called(node: ast.AST) -> str | None:
    """The name of what a call calls: of a function or of a method."""
    if not isinstance(node, ast.Call):
        return None
    return getattr(node.func, "attr", None) or getattr(node.func, "id", None)


Tags = frozenset


class _Audit:
    def __init__(self, source: str):
        self.lines, self.tree = source.splitlines(), ast.parse(source)
        self.functions = {f.name: f for f in self.tree.body if isinstance(f, ast.FunctionDef)}
        self.classes = {c.name: c for c in self.tree.body if isinstance(c, ast.ClassDef)}
        self.found: list[Finding] = []
        #: Constructor parameters (class, name) that are treated as tables somewhere.
        self.tables: set[str] = set()
        self.attributes: dict[str, dict[str, Tags]] = {c: {} for c in self.classes}
        self.globals: dict[str, Tags] = {}

    def run(self) -> list[Finding]:
        # Constructors are read until no further parameter turns out to be a table; then findings count.
        for _ in range(4):
            before = len(self.tables), str(sorted((c, n, *sorted(t)) for c, a in self.attributes.items() for n, t in a.items()))
            self._pass()
            if before == (len(self.tables), str(sorted((c, n, *sorted(t)) for c, a in self.attributes.items() for n, t in a.items()))):
                break
        self.found = []
        self._pass()
        return sorted(self.found, key=lambda f: (f.line, f.leak_class))

    def _pass(self) -> None:
        for node in self.tree.body:
            if isinstance(node, ast.Assign | ast.AnnAssign) and node.value is not None:
                tags = self.value(node.value, dict(self.globals), None, 0)
                things = self._named_things(node.value)
                if things >= FEW:
                    tags |= {"listed"} if things < MANY else {"listed", "many"}
                for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(t, ast.Name):
                        self.globals[t.id] = tags
        for name, cls in self.classes.items():
            methods = [f for f in cls.body if isinstance(f, ast.FunctionDef)]
            for f in sorted(methods, key=lambda f: f.name != "__init__"):
                self.function(f, self._arguments(f, name), name, 0)
        for f in self.functions.values():
            self.function(f, {}, None, 0)

    @staticmethod
    def _named_things(node: ast.AST) -> int:
        """Strings in a literal collection: names that were written down beforehand."""
        if isinstance(node, ast.Call) and len(node.args) == 1:
            node = node.args[0]
        items = node.keys if isinstance(node, ast.Dict) else getattr(node, "elts", [])
        return sum(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in items)

    def _arguments(self, f: ast.FunctionDef, cls: str) -> dict[str, Tags]:
        names = [a.arg for a in f.args.args + f.args.kwonlyargs if a.arg not in ("self", "cls")]
        if f.name == "__init__":
            return {n: Tags({f"from:{cls}.{n}"} | ({"outside"} if f"{cls}.{n}" in self.tables else set())) for n in names}
        if f.name == PREDICTS:
            return {n: Tags({"view"}) for n in names}
        return {}

    def note(self, node: ast.AST, leak: str, severity: str, why: str) -> None:
        line = getattr(node, "lineno", 0)
        snippet = self.lines[line - 1].strip() if 0 < line <= len(self.lines) else ""
        finding = Finding(leak, line, snippet, severity, why)
        if finding not in self.found:
            self.found.append(finding)

    # Statements

    def function(self, f: ast.FunctionDef, arguments: dict[str, Tags], cls: str | None, depth: int) -> Tags:
        """Tags of what the function returns."""
        self.decides = f.name == PREDICTS if depth == 0 else self.decides
        scope = {**self.globals, **arguments}
        out: set[str] = set()
        self._block(f.body, scope, cls, depth, out)
        if self.decides and depth == 0 and "ahead" in out:
            self.note(f, "target_in_features", "high", "the decision returns a value that was taken from later rows than its own")
        return Tags(out)

    def _block(self, body: list[ast.stmt], scope: dict[str, Tags], cls: str | None, depth: int, out: set[str]) -> None:
        for s in body:
            if isinstance(s, ast.Assign | ast.AnnAssign | ast.AugAssign):
                if s.value is None:
                    continue
                tags = self.value(s.value, scope, cls, depth)
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    self._store(t, tags if not isinstance(s, ast.AugAssign) else tags | self.value(t, scope, cls, depth), scope, cls, s)
            elif isinstance(s, ast.Return):
                if s.value is not None:
                    out |= self.value(s.value, scope, cls, depth)
            elif isinstance(s, ast.For):
                self._search(s)
                tags = self.value(s.iter, scope, cls, depth)
                self._store(s.target, tags, scope, cls, s)
                for _ in range(2):
                    self._block(s.body, scope, cls, depth, out)
                self._block(s.orelse, scope, cls, depth, out)
            elif isinstance(s, ast.While):
                self.value(s.test, scope, cls, depth)
                for _ in range(2):
                    self._block(s.body, scope, cls, depth, out)
            elif isinstance(s, ast.If):
                self.value(s.test, scope, cls, depth)
                other = dict(scope)
                self._block(s.body, scope, cls, depth, out)
                self._block(s.orelse, other, cls, depth, out)
                for n, tags in other.items():
                    scope[n] = scope.get(n, Tags()) | tags
            elif isinstance(s, ast.With):
                for item in s.items:
                    tags = self.value(item.context_expr, scope, cls, depth)
                    if item.optional_vars is not None:
                        self._store(item.optional_vars, tags, scope, cls, s)
                self._block(s.body, scope, cls, depth, out)
            elif isinstance(s, ast.Try):
                for part in (s.body, *[h.body for h in s.handlers], s.orelse, s.finalbody):
                    self._block(part, scope, cls, depth, out)
            elif isinstance(s, ast.FunctionDef):
                self._block(s.body, dict(scope), cls, depth, set())
            else:
                for n in ast.iter_child_nodes(s):
                    if isinstance(n, ast.expr):
                        self.value(n, scope, cls, depth)

    def _store(self, target: ast.AST, tags: Tags, scope: dict[str, Tags], cls: str | None, at: ast.stmt) -> None:
        if isinstance(target, ast.Name):
            scope[target.id] = tags
        elif isinstance(target, ast.Tuple | ast.List):
            for t in target.elts:
                self._store(t, tags, scope, cls, at)
        elif isinstance(target, ast.Starred):
            self._store(target.value, tags, scope, cls, at)
        elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self" and cls:
            own = self.attributes[cls]
            own[target.attr] = own.get(target.attr, Tags()) | tags
        elif isinstance(target, ast.Subscript):
            if "ahead" in tags:
                self.note(at, "target_in_features", "high", "a value of later rows is stored beside the features of an earlier one")
            if isinstance(target.value, ast.Name):
                scope[target.value.id] = scope.get(target.value.id, Tags()) | (tags & {"ahead", "outside"})

    # Expressions

    def value(self, node: ast.AST, scope: dict[str, Tags], cls: str | None, depth: int) -> Tags:
        if isinstance(node, ast.Name):
            tags = scope.get(node.id, Tags())
            if self.decides_here(depth) and node.id in self.globals and scope.get(node.id) == self.globals[node.id]:
                if "outside" in tags:
                    self.note(node, "point_in_time_bypass", "high", "the decision reads a table of the module instead of the view that it is given")
                elif "listed" in tags:
                    self.note(node, "survivorship_selection", "high" if "many" in tags else "medium", "the decision uses a list of names that was fixed beforehand, maybe with hindsight")
            return tags
        if isinstance(node, ast.Attribute):
            if isinstance(node.value, ast.Name) and node.value.id == "self" and cls:
                tags = self.attributes[cls].get(node.attr, Tags())
                if self.decides_here(depth) and "outside" in tags:
                    self.note(node, "point_in_time_bypass", "high", "the decision reads data that the object was given, instead of the view")
                return tags
            return self.value(node.value, scope, cls, depth)
        if isinstance(node, ast.Call):
            return self._call(node, scope, cls, depth)
        if isinstance(node, ast.Subscript):
            return self._subscript(node, scope, cls, depth)
        if isinstance(node, ast.Lambda):
            return self.value(node.body, scope, cls, depth)
        if isinstance(node, ast.ListComp | ast.SetComp | ast.GeneratorExp | ast.DictComp):
            inner = dict(scope)
            for g in node.generators:
                self._store(g.target, self.value(g.iter, inner, cls, depth), inner, cls, node)
                for test in g.ifs:
                    self.value(test, inner, cls, depth)
            parts = [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]
            return Tags().union(*[self.value(p, inner, cls, depth) for p in parts])
        tags: Tags = Tags()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.expr):
                tags |= self.value(child, scope, cls, depth)
        if isinstance(node, ast.BinOp | ast.Compare | ast.BoolOp | ast.UnaryOp | ast.Slice | ast.JoinedStr):
            return Tags(t for t in tags if not t.startswith("from:"))
        return tags

    def decides_here(self, depth: int) -> bool:
        return getattr(self, "decides", False)

    def _as_table(self, tags: Tags) -> None:
        self.tables |= {t[5:] for t in tags if t.startswith("from:")}

    def _subscript(self, node: ast.Subscript, scope: dict[str, Tags], cls: str | None, depth: int) -> Tags:
        tags = self.value(node.value, scope, cls, depth)
        key = node.slice
        named = isinstance(key, ast.Constant) and isinstance(key.value, str)
        mask = any(isinstance(n, ast.Compare) for n in ast.walk(key))
        if named or mask:
            self._as_table(tags)
        if isinstance(key, ast.Slice) and key.upper is None and isinstance(key.lower, ast.BinOp) and isinstance(key.lower.op, ast.Add) and any(isinstance(x, ast.Name) for x in ast.walk(key.lower)):
            self.note(node, "future_indexing", "high", "a slice that starts after the present position reads the rows that follow it")
            tags |= {"ahead"}
        inner = self.value(key, scope, cls, depth)
        if mask:
            self._selection(node, [key], tags, inner)
        if isinstance(key, ast.UnaryOp) and isinstance(key.op, ast.USub) and "outside" in tags:
            tags |= {"extreme"}
        return tags | (inner & {"ahead"})

    def _selection(self, node: ast.AST, conditions: list[ast.AST], data: Tags, inner: Tags) -> None:
        """A filter of data by conditions."""
        if "outside" not in data:
            return
        if "extreme" in inner:
            self.note(node, "survivorship_selection", "high", "names are chosen by the last state of all data, so those that had gone by then are missing")
        for c in (n for x in conditions for n in ast.walk(x) if isinstance(n, ast.Compare)):
            later = any(isinstance(op, ast.Eq | ast.Gt | ast.GtE) for op in c.ops)
            if later and self.decides_here(0) and any(isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.attr.startswith("as_of") for n in ast.walk(c)):
                self.note(node, "future_indexing", "high", "rows of the session that is about to be traded, or of later ones, are picked from outside data")

    def _call(self, node: ast.Call, scope: dict[str, Tags], cls: str | None, depth: int) -> Tags:
        name = _called(node)
        method = isinstance(node.func, ast.Attribute)
        base = self.value(node.func.value, scope, cls, depth) if method else Tags()
        given = [(a.value if isinstance(a, ast.Starred) else a) for a in node.args]
        args = [self.value(a, scope, cls, depth) for a in given]
        named = {k.arg: self.value(k.value, scope, cls, depth) for k in node.keywords}
        every = Tags().union(*args, *named.values())
        # A setting that is passed to a method does not make its result the caller's table.
        out = base | Tags(t for t in every if not (method and t.startswith("from:")))
        if method and name in TABLE:
            self._as_table(base)
        if method:
            out = self._method_of(node, name, base, every, out, scope)
        if name in READERS or (name or "").startswith(("read_", "scan_")):
            out |= {"outside"}
            if self.decides_here(depth):
                self.note(node, "point_in_time_bypass", "high", "data is read from a file on the way to a decision, instead of from the view")
        elif not method and name in ("max", "min", "sum", "sorted", "len"):
            if name in ("max", "min") and "key" in named and "outside" in every:
                self.note(node, "snooped_parameter", "high", "the best of several candidates is chosen by its result over all data")
            if "outside" in every and name in ("max", "sum"):
                out |= {"extreme"} if name == "max" else {"summary"}
            if name == "len":
                out = Tags()
        return out | self._into(node, name, method, args, named, scope, cls, depth)

    def _method_of(self, node: ast.Call, name: str, base: Tags, every: Tags, out: Tags, scope: dict[str, Tags]) -> Tags:
        values = [*node.args, *[k.value for k in node.keywords]]
        constant = {k.arg: getattr(k.value, "value", None) for k in node.keywords}
        if name in SHIFT and any(_negative(a) for a in values):
            self.note(node, "future_indexing", "high", "a negative shift moves the values of later rows to earlier ones")
            out |= {"ahead"}
        backward = {"backward", "bfill", "backfill"} & {getattr(v, "value", None) for v in values if isinstance(v, ast.Constant) and isinstance(v.value, str)}
        if name in BACKWARD or (name.startswith(("fill_n", "filln")) and backward):
            self.note(node, "future_indexing", "high", "a backward fill puts later values where earlier ones are missing")
            out |= {"ahead"}
        if name in ("reverse", "reversed") or name.startswith("sort") and any(k.arg in ("descending", "ascending") and getattr(k.value, "value", None) is (k.arg == "descending") for k in node.keywords) and "session_date" in {getattr(v, "value", None) for v in node.args}:
            out ^= {"turned"}
        if _is_window(name):
            if "turned" in base:
                self.note(node, "future_indexing", "high", "a window over rows in reverse order reads the rows that follow")
                out |= {"ahead"}
            if constant.get("center"):
                self.note(node, "boundary_crossing_window", "high", "a centred window reads rows after the one that it belongs to")
                out |= {"ahead"}
            elif "outside" in base:
                self.note(node, "boundary_crossing_window", "medium", "a window runs over data from outside the view, past the decision's session")
        if name.startswith(("fit", "partial_fit")) and (node.args or node.keywords) and "view" not in every:
            if "outside" in every | base or isinstance(node.func.value, ast.Call | ast.Name) and node.args and isinstance(node.args[0], ast.Name | ast.Attribute | ast.Subscript):
                self.note(node, "full_sample_fit", "high", "a transform is fitted to data that nothing restricts to what was visible")
                out |= {"outside"}
        if "outside" in base:
            inside = any(isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in REDUCE for a in values for n in ast.walk(a))
            if name in REDUCE or (name.startswith("agg") and inside):
                self.note(node, "full_sample_statistic", "high", "a statistic is taken of all sessions, also those after the decision")
                out |= {"summary"}
                if name in ("max", "last"):
                    out |= {"extreme"}
            if name in ("filter", "query", "where", "loc"):
                self._selection(node, values, base, every)
            if name in ("tail",):
                out |= {"extreme"}
        if "turned" in base and any(_is_window(_called(n) or "") for v in values for n in ast.walk(v)):
            self.note(node, "future_indexing", "high", "a window over rows in reverse order reads the rows that follow")
            out |= {"ahead"}
        if name in COLLECT and "ahead" in every:
            self.note(node, "target_in_features", "high", "a value of later rows is put among what the decision knows")
            if isinstance(node.func.value, ast.Name):
                scope[node.func.value.id] = scope.get(node.func.value.id, Tags()) | {"ahead"}
        return out

    def _into(self, node: ast.Call, name: str | None, method: bool, args: list[Tags], named: dict[str | None, Tags], scope: dict[str, Tags], cls: str | None, depth: int) -> Tags:
        """Tags of the result of a function or method of this source, interpreted with the tags of its arguments."""
        if depth >= DEPTH or name is None:
            return Tags()
        target, owner = None, None
        if not method:
            target = self.functions.get(name)
            if name in self.classes:
                owner = name
                target = next((f for f in self.classes[name].body if isinstance(f, ast.FunctionDef) and f.name == "__init__"), None)
        else:
            holder = node.func.value
            own = cls if isinstance(holder, ast.Name) and holder.id in ("self", "cls") else None
            for c in [own] if own else [x for x in (_called(holder), getattr(holder, "id", None)) if x in self.classes]:
                target = next((f for f in self.classes[c].body if isinstance(f, ast.FunctionDef) and f.name == name), None)
                owner = c
        if target is None or target.name == PREDICTS:
            return Tags()
        names = [a.arg for a in target.args.args if a.arg not in ("self", "cls")]
        bound = {**dict(zip(names, args)), **{k: v for k, v in named.items() if k}}
        before = len(self.found)
        result = self.function(target, bound, owner, depth + 1)
        new = self.found[before:]
        if "outside" in Tags().union(*bound.values()):
            derives = "summary" in result or any(f.leak_class == "full_sample_statistic" for f in new) or any(f.leak_class == "full_sample_statistic" and target.lineno <= f.line <= (target.end_lineno or 0) for f in self.found)
            if derives:
                self.note(node, "full_sample_fit", "high", "a method derives statistics from all data that it is given and they are kept")
        return result

    def _search(self, loop: ast.For) -> None:
        """A loop over candidate values that keeps the one with the best result."""
        many = isinstance(loop.iter, ast.List | ast.Tuple) or _called(loop.iter) in ("range", "product", "linspace", "arange")
        tried = {n.id for n in ast.walk(loop.target) if isinstance(n, ast.Name)}
        for n in ast.walk(loop):
            if not (isinstance(n, ast.If) and isinstance(n.test, ast.Compare)):
                continue
            compared = {x.id for x in ast.walk(n.test) if isinstance(x, ast.Name)}
            kept = [x for x in n.body if isinstance(x, ast.Assign)]
            renewed = {t.id for x in kept for y in x.targets for t in ast.walk(y) if isinstance(t, ast.Name)}
            keeps_candidate = any(tried & {v.id for v in ast.walk(x.value) if isinstance(v, ast.Name)} for x in kept)
            if many and keeps_candidate and compared & renewed:
                self.note(loop, "snooped_parameter", "medium" if self.decides_here(0) else "high", "a parameter is chosen by its result on the same data that it is then used on")


def audit_source(source: str) -> list[Finding]:
    """Findings by line; a source that does not parse has one of high severity."""
    try:
        return _Audit(source).run()
    except (SyntaxError, ValueError) as e:
        return [Finding("unparsable", getattr(e, "lineno", 0) or 0, "", "high", str(e))]


def findings(df: DataFrame, source_col: str = "source") -> DataFrame:
    """df with findings of each source and rejected (any of high severity); null sources have none."""

    @F.pandas_udf(T._parse_datatype_string(FINDING))
    def audit(sources: pd.Series) -> pd.Series:
        return sources.map(lambda s: [vars(f) for f in audit_source(s)] if s is not None else [])

    return df.withColumn("findings", audit(F.col(source_col))).withColumn("rejected", F.exists("findings", lambda f: f["severity"] == "high"))


def conforms(source: str) -> tuple[bool, str | None]:
    """(whether exactly one class defines generate(self, view), its name)."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return False, None
    found = [c.name for c in tree.body if isinstance(c, ast.ClassDef) and any(isinstance(f, ast.FunctionDef) and f.name == "generate" and len(f.args.args) == 2 for f in c.body)]
    return len(found) == 1, found[0] if len(found) == 1 else None


def conformance(df: DataFrame, source_col: str = "source") -> DataFrame:
    """df with ok and class of conforms(); a null source does not conform."""

    @F.pandas_udf("ok boolean, class string")
    def check(sources: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([conforms(s) if s is not None else (False, None) for s in sources], columns=["ok", "class"])

    out = df.withColumn("__c", check(F.col(source_col)))
    return out.select(*df.columns, "__c.ok", "__c.class")


def first_object(text: str) -> dict | None:
    """The first balanced JSON object in a text."""
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            if isinstance(value, dict):
                return value
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None


def object_in(text: Column) -> Column:
    """From the first { of a text on: what a JSON reader, which stops at the end of a value, can read."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def clamped(c: Column) -> Column:
    """A confidence as a number from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(0.0))))
