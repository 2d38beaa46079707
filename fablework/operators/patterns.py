"""Graph statements: MATCH, CREATE, MERGE, SET, DELETE and RETURN over nodes and edges as DataFrames.

Clauses work on a table of bindings, a struct column a variable, so a pattern is a chain of equi-joins on
element ids and a WHERE between two patterns becomes a join key. Under RETURN DISTINCT patterns without a common
variable are first reduced to the different values that the statement asks for, so equal ones do not multiply. Properties are JSON text by name, so
elements of one label may differ in their properties. What a statement writes is cut from its lineage
once, as new ids are random. Every write makes a new frame of all nodes or edges.

Supported: labels, types (``A|B``), property maps, both directions and none, several patterns a clause; in
expressions AND, OR, NOT, comparisons, IN, CONTAINS, STARTS WITH, ENDS WITH, IS [NOT] NULL; in RETURN
aliases, DISTINCT, count, collect, sum, avg, min, max, type, labels, elementId; ORDER BY, SKIP, LIMIT.
Anything else is a ``SyntaxError``, never left out. A property compares as a number with numbers, as text else.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..sources.readers import split_graph_statements

NODE = "element_id string, labels array<string>, props map<string,string>"
EDGE = "element_id string, start_node_id string, rel_type string, end_node_id string, props map<string,string>"
TOKEN = re.compile(r"""\s*(?:("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(\d+\.\d+|\d+)|([A-Za-z_]\w*|`[^`]+`)|(<=|>=|<>|\+=|[-<>=(){}\[\]:,.|*]))""")
CLAUSES = ("MATCH", "CREATE", "MERGE", "SET", "DETACH", "DELETE", "WHERE", "RETURN", "ORDER", "SKIP", "LIMIT")
AGGREGATES = {"count": F.count, "collect": F.collect_list, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


@dataclass
class Value:
    """An expression: its column, its JSON text where it can be stored, and whether it is a number."""

    column: Column
    stored: Column | None = None
    number: bool = False
    aggregate: bool = False


@dataclass
class Element:
    """A node or an edge of a pattern; ``way``: -1 to the left, 1 to the right, 0 either; ``tied``: its properties name variables."""

    name: str
    kinds: list[str] = field(default_factory=list)
    props: dict[str, Value] = field(default_factory=dict)
    way: int = 0
    tied: bool = False


def _plain(stored: Column) -> Column:
    """A JSON value as text: strings without their quotes."""
    return F.get_json_object(F.concat(F.lit("["), stored, F.lit("]")), "$[0]")


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _outside(names: Column):
    """Whether a map's entry has none of the names as its key."""
    return lambda entry: ~F.array_contains(names, entry["key"])


def _among(names: set[str]):
    return lambda key, _: key.isin(*names)


class _Reader:
    """Tokens of a statement, and the grammar's parts."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise SyntaxError(f"cannot read: {text[at:at + 40]}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at, self.fresh = 0, count()
        # (variable, property) of all expressions so far, without a property for the whole element
        self.used, self.aggregates = [], False

    def is_next(self, *words: str) -> bool:
        """Whether signs or words, in any case, come next."""
        return [t.upper() if k in (3, 4) else None for k, t in self.tokens[self.at : self.at + len(words)]] == list(words)

    def accept(self, *words: str) -> bool:
        if hit := self.is_next(*words):
            self.at += len(words)
        return hit

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            said = " ".join(t for _, t in self.tokens[self.at : self.at + 5])
            raise SyntaxError(f"expected {' '.join(words)}, found {said or 'the end'}")

    def word(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == 3:
            self.at += 1
            return self.tokens[self.at - 1][1].strip("`")
        raise SyntaxError("expected a name")

    def several(self, part) -> list:
        out = [part()]
        while self.accept(","):
            out.append(part())
        return out

    def literal(self):
        """A Python value; None with nothing taken if no literal comes next."""
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (0, "")
        if kind == 1:
            self.at += 1
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
        if kind == 2:
            self.at += 1
            return float(text) if "." in text else int(text)
        if self.accept("-"):
            return -self.literal()
        for word, value in (("TRUE", True), ("FALSE", False)):
            if self.accept(word):
                return value
        if self.accept("["):
            out = [] if self.is_next("]") else self.several(self.literal)
            self.expect("]")
            return out
        return None

    def any_of(self) -> Value:
        """OR of ANDs of comparisons."""
        out = self.all_of()
        while self.accept("OR"):
            out = Value(out.column | self.all_of().column)
        return out

    def all_of(self) -> Value:
        out = self.negated()
        while self.accept("AND"):
            out = Value(out.column & self.negated().column)
        return out

    def negated(self) -> Value:
        return Value(~self.negated().column) if self.accept("NOT") else self.compared()

    def compared(self) -> Value:
        a = self.operand()
        if self.accept("IS", "NOT", "NULL"):
            return Value(a.column.isNotNull())
        if self.accept("IS", "NULL"):
            return Value(a.column.isNull())
        if self.accept("IN"):
            values = self.literal()
            if not isinstance(values, list):
                raise SyntaxError("IN needs a list")
            texts = [v if isinstance(v, str) else json.dumps(v) for v in values]
            return Value(a.column.cast("string").isin(texts))
        for words, f in ((("CONTAINS",), F.contains), (("STARTS", "WITH"), F.startswith), (("ENDS", "WITH"), F.endswith)):
            if self.accept(*words):
                return Value(f(a.column, self.operand().column))
        for sign, f in (("=", "__eq__"), ("<>", "__ne__"), ("<=", "__le__"), (">=", "__ge__"), ("<", "__lt__"), (">", "__gt__")):
            if self.accept(sign):
                b = self.operand()
                x, y = (_number(v.column) if a.number or b.number else v.column.cast("string") for v in (a, b))
                return Value(getattr(x, f)(y))
        return a

    def operand(self) -> Value:
        if self.accept("("):
            out = self.any_of()
            self.expect(")")
            return out
        if self.accept("NULL"):
            return Value(F.lit(None).cast("string"), F.lit(None).cast("string"))
        if (v := self.literal()) is not None:
            shown = F.lit(json.dumps(v)) if isinstance(v, list) else F.lit(v)
            return Value(shown, F.lit(json.dumps(v, ensure_ascii=False)), isinstance(v, int | float) and not isinstance(v, bool))
        name = self.word()
        if self.accept("."):
            key = self.word()
            self.used.append((name, key))
            stored = F.col(f"`{name}`.props")[key]
            return Value(_plain(stored), stored)
        if not self.accept("("):
            self.used.append((name, None))
            return Value(F.col(f"`{name}`"))
        return self.call(name.lower())

    def call(self, name: str) -> Value:
        self.aggregates |= name in AGGREGATES
        if name == "count" and self.accept("*", ")"):
            return Value(F.count(F.lit(1)), number=True, aggregate=True)
        once = self.accept("DISTINCT")
        bare = self.tokens[self.at : self.at + 2][-1:] == [(4, ")")] and self.tokens[self.at][0] == 3  # a variable alone
        arg = self.operand().column
        self.expect(")")
        if name == "type":
            return Value(arg["rel_type"])
        if name == "labels":
            return Value(arg["labels"])
        if name == "elementid":
            return Value(arg["element_id"])
        if name not in AGGREGATES:
            raise SyntaxError(f"unknown function {name}")
        if bare:
            arg = arg["element_id"]
        if name == "count" and once:
            return Value(F.count_distinct(arg), number=True, aggregate=True)
        if name in ("sum", "avg"):
            arg = _number(arg)
        made = F.collect_set(arg) if name == "collect" and once else AGGREGATES[name](arg)
        return Value(F.sort_array(made) if name == "collect" else made, number=name in ("count", "sum", "avg"), aggregate=True)

    def element(self, open_: str, close: str) -> Element:
        self.expect(open_)
        named = self.at < len(self.tokens) and self.tokens[self.at][0] == 3
        out = Element(self.word() if named else f"__{next(self.fresh)}")
        while self.accept(":") or (out.kinds and self.accept("|")):
            out.kinds.append(self.word())
        if self.accept("{"):
            while not self.accept("}"):
                key = self.word()
                self.expect(":")
                seen = len(self.used)
                out.props[key] = value = self.operand()
                out.tied |= len(self.used) > seen
                if value.stored is None:
                    raise SyntaxError(f"{key} needs a literal or a property")
                self.accept(",")
        self.expect(close)
        return out

    def path(self) -> list[Element]:
        """Nodes and edges in turn."""
        out = [self.element("(", ")")]
        while self.is_next("-") or self.is_next("<", "-"):
            left = self.accept("<")
            self.expect("-")
            edge = self.element("[", "]") if self.is_next("[") else Element(f"__{next(self.fresh)}")
            self.expect("-")
            edge.way = -1 if left else 1 if self.accept(">") else 0
            out += [edge, self.element("(", ")")]
        return out


def _asked(statement: str) -> dict[str, set[str | None]] | None:
    """What a statement that reads asks of its variables: properties, and None for the whole element.

    None instead if equal rows count: only RETURN DISTINCT without aggregates takes them as one.
    """
    r, names = _Reader(statement), []
    while r.is_next("MATCH") or r.is_next("WHERE"):
        if r.accept("WHERE"):
            r.any_of()
        elif r.accept("MATCH"):
            names += [n for path in r.several(r.path) for n in {e.name for e in path}]
    if not r.accept("RETURN", "DISTINCT"):
        return None
    r.several(lambda: (r.any_of(), r.accept("AS") and r.word()))
    if r.aggregates:
        return None
    out: dict[str, set[str | None]] = {n: {None} for n in names if names.count(n) > 1}  # joined by its id
    for name, key in r.used:
        out.setdefault(name, set()).add(key)
    return out


def _reduced(bound: DataFrame, asked: dict[str, set[str | None]]) -> DataFrame:
    """Each binding of what is asked for once, with no other variables and properties."""
    kept = []
    for name in (c for c in bound.columns if asked.get(c)):
        of = F.col(f"`{name}`")
        if None not in asked[name]:
            empty = (F.lit(None).cast(f.dataType).alias(f.name) for f in bound.schema[name].dataType if f.name != "props")
            of = F.struct(*empty, F.map_filter(of["props"], _among(asked[name])).alias("props"))
        kept.append(of.alias(name))
    rows = bound.select("__one", *kept)
    # maps are no keys: elements are compared as text
    own = [c for c in rows.columns if c != "__one"]
    keys = [F.to_json(F.col(f"`{c}`")).alias(f"__as_{c}") for c in own]
    return rows.groupBy("__one", *keys).agg(F.lit(0), *(F.any_value(f"`{c}`").alias(c) for c in own)).select("__one", *(f"`{c}`" for c in own))


class Graph:
    """Nodes and edges that statements read and change; frames once handed out stay as they were."""

    def __init__(self, spark: SparkSession, nodes: DataFrame | None = None, edges: DataFrame | None = None):
        self.spark = spark
        self.nodes = spark.createDataFrame([], NODE) if nodes is None else nodes
        self.edges = spark.createDataFrame([], EDGE) if edges is None else edges

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> Graph:
        """From ``nodes(element_id, label, ...)`` and ``edges(start_node_id, rel_type, end_node_id, ...)``; other columns are properties.

        Edges of one type between the same ends share an id.
        """
        def props(df: DataFrame, known: tuple[str, ...]) -> Column:
            as_json = F.to_json(F.struct(*(c for c in df.columns if c not in known), F.lit(None).cast("string").alias("__")))
            items = F.from_json(as_json, "map<string,variant>")
            return F.transform_values(items, lambda _, v: F.to_json(v))

        n = nodes.select("element_id", F.array("label").alias("labels"), props(nodes, ("element_id", "label")).alias("props"))
        known = ("start_node_id", "rel_type", "end_node_id")
        e = edges.select(F.concat_ws("|", *known).alias("element_id"), *known, props(edges, known).alias("props"))
        return cls(nodes.sparkSession, n, e)

    def run_script(self, text: str) -> list[DataFrame]:
        """Run all statements in order; results of those that return something."""
        return [d for d in map(self.run, split_graph_statements(text)) if d is not None]

    def run(self, statement: str) -> DataFrame | None:
        """One statement; its rows where it returns some."""
        r, bound = _Reader(statement), self.spark.range(1).select(F.lit(True).alias("__one"))
        if not r.tokens:
            return None
        one, asked = bound, _asked(statement)
        while r.at < len(r.tokens):
            if r.accept("MATCH"):
                for path in r.several(r.path):
                    if asked is None or bound is one or any(e.tied or e.name in bound.columns for e in path):
                        bound = self._match(bound, path)
                    else:  # tied to the others by conditions alone
                        bound = _reduced(bound, asked).crossJoin(_reduced(self._match(one, path), asked).drop("__one"))
            elif r.accept("WHERE"):
                bound = bound.where(r.any_of().column)
            elif r.accept("CREATE"):
                bound = self._create(bound, r.several(r.path))
            elif r.accept("MERGE"):
                bound = self._merge(bound, r.path())
            elif r.accept("SET"):
                bound = self._set(bound, r)
            elif r.is_next("DELETE") or r.is_next("DETACH", "DELETE"):
                whole = r.accept("DETACH")
                r.expect("DELETE")
                self._delete(bound, r.several(r.word), whole)
            elif r.accept("RETURN"):
                return self._return(bound, r)
            else:
                raise SyntaxError(f"expected one of {', '.join(CLAUSES)}, found {r.tokens[r.at][1]}")
        return None

    def _fits(self, e: Element, is_node: bool) -> Column:
        """Whether the element bound to the name has the kinds and properties asked for."""
        at, out = F.col(f"`{e.name}`"), F.lit(True)
        if is_node:
            for k in e.kinds:
                out = out & F.array_contains(at["labels"], k)
        elif e.kinds:
            out = at["rel_type"].isin(e.kinds)
        for k, v in e.props.items():
            out = out & (at["props"][k] == v.stored)
        return out

    def _bind(self, bound: DataFrame, e: Element, where: Column | None = None) -> DataFrame:
        """``bound`` with a node for ``e``; ``where`` ties it to what is bound."""
        tied = self._fits(e, True) if where is None else self._fits(e, True) & where
        if e.name in bound.columns:
            return bound.where(tied)
        return bound.join(self.nodes.select(F.struct(*self.nodes.columns).alias(e.name)), tied)

    def _match(self, bound: DataFrame, path: list[Element]) -> DataFrame:
        bound, used = self._bind(bound, path[0]), []
        for before, edge, node in zip(path[::2], path[1::2], path[2::2], strict=False):
            here, e = F.col(f"`{before.name}`.element_id"), F.col(f"`{edge.name}`")
            if edge.name in bound.columns:
                raise SyntaxError(f"{edge.name} is bound already")
            known, near, far = self.edges.select(F.struct(*self.edges.columns).alias(edge.name)), f"__near{len(used)}", f"__far{len(used)}"
            ways = [("start_node_id", "end_node_id")] * (edge.way >= 0) + [("end_node_id", "start_node_id")] * (edge.way <= 0)
            ends = F.array_distinct(F.array(*(F.struct(e[a].alias("near"), e[b].alias("far")) for a, b in ways)))
            known = known.select(edge.name, F.explode(ends).alias("__end")).select(edge.name, F.col("__end.near").alias(near), F.col("__end.far").alias(far))
            bound = bound.join(known, (F.col(near) == here) & self._fits(edge, False))
            bound = self._bind(bound, node, F.col(f"`{node.name}`.element_id") == F.col(far)).drop(near, far)
            for other in used:  # an edge stands for one place of a pattern only
                bound = bound.where(F.col(f"`{other}`.element_id") != e["element_id"])
            used.append(edge.name)
        return bound

    def _create(self, bound: DataFrame, paths: list[list[Element]]) -> DataFrame:
        new: dict[str, bool] = {}
        for path in paths:
            for i, e in enumerate(path):
                is_node = i % 2 == 0
                if is_node and e.name in bound.columns:
                    continue
                given = [F.struct(F.lit(k).alias("key"), v.stored.alias("value")) for k, v in e.props.items()]
                held = F.filter(F.array(*given), lambda x: x["value"].isNotNull()) if given else F.array().cast("array<struct<key:string,value:string>>")
                own = [F.expr("uuid()").alias("element_id")]
                if is_node:
                    own.append(F.array(*map(F.lit, e.kinds)).cast("array<string>").alias("labels"))
                else:
                    if len(e.kinds) != 1 or e.way == 0:
                        raise SyntaxError("a new edge needs one type and a direction")
                    own += [F.lit(None).cast("string").alias("start_node_id"), F.lit(e.kinds[0]).alias("rel_type"), F.lit(None).cast("string").alias("end_node_id")]
                bound = bound.withColumn(e.name, F.struct(*own, F.map_from_entries(held).alias("props")))
                new[e.name] = is_node
        for path in paths:  # all nodes are bound now
            for a, e, b in zip(path[::2], path[1::2], path[2::2], strict=False):
                at, (a, b) = F.col(f"`{e.name}`"), (a, b) if e.way > 0 else (b, a)
                ends = {"start_node_id": F.col(f"`{a.name}`.element_id"), "end_node_id": F.col(f"`{b.name}`.element_id")}
                bound = bound.withColumn(e.name, F.struct(*(ends.get(c, at[c]).alias(c) for c in self.edges.columns)))
        bound = cut(bound)  # the ids are random
        for name, is_node in new.items():
            made = bound.select(f"`{name}`.*")
            if is_node:
                self.nodes = self.nodes.unionByName(made)
            else:
                self.edges = self.edges.unionByName(made)
        return bound

    def _merge(self, bound: DataFrame, path: list[Element]) -> DataFrame:
        """Rows for which the whole path is there keep it; for others it is made, once for equal ones."""
        bound = cut(bound.withColumn("__row", F.monotonically_increasing_id()))
        there = self._match(bound, path).select("__row").distinct()
        tied = [F.col(f"`{e.name}`.element_id") for e in path if e.name in bound.columns]
        asked = F.array(*tied, *(v.stored for e in path for v in e.props.values()), F.lit(""))
        lost = bound.join(there, "__row", "left_anti").withColumn("__asked", asked)
        first = lost.groupBy("__asked").agg(F.min("__row").alias("__row")).select("__row")
        self._create(bound.join(first, "__row", "left_semi"), [path])
        return self._match(bound, path).drop("__row")

    def _is_node(self, bound: DataFrame, name: str) -> bool:
        if name not in bound.columns:
            raise SyntaxError(f"{name} is not bound")
        return "labels" in bound.schema[name].dataType.names

    def _set(self, bound: DataFrame, r: _Reader) -> DataFrame:
        """Set properties, null takes one away; equal elements in several rows get the greatest value."""
        def one() -> tuple[str, str, Value]:
            name = r.word()
            r.expect(".")
            key = r.word()
            r.expect("=")
            value = r.operand()
            if value.stored is None:
                raise SyntaxError(f"{key} needs a literal or a property")
            return name, key, value

        bound, asked = cut(bound), r.several(one)
        for name in dict.fromkeys(n for n, _, _ in asked):
            own = {k: v.stored for n, k, v in asked if n == name}
            is_node = self._is_node(bound, name)
            new = bound.select(F.col(f"`{name}`.element_id").alias("element_id"), *(v.alias(f"__{k}") for k, v in own.items()))
            new = new.groupBy("element_id").agg(*(F.max(f"__{k}").alias(f"__{k}") for k in own), F.lit(True).alias("__hit"))
            old = self.nodes if is_node else self.edges
            replaced = F.array(*map(F.lit, own))
            kept = F.map_from_entries(F.filter(F.map_entries("props"), _outside(replaced)))
            said = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"__{k}").alias("value")) for k in own)), lambda x: x["value"].isNotNull())
            props = F.when(F.col("__hit"), F.map_concat(kept, F.map_from_entries(said))).otherwise(F.col("props"))
            changed = cut(old.join(new, "element_id", "left").withColumn("props", props).select(old.columns))
            if is_node:
                self.nodes = changed
            else:
                self.edges = changed
        return self._latest(bound)

    def _latest(self, bound: DataFrame) -> DataFrame:
        """Bindings with every element as it is now."""
        for name in [c for c in bound.columns if c not in ("__one", "__row")]:
            every = self.nodes if self._is_node(bound, name) else self.edges
            now = every.select(F.col("element_id").alias("__id"), F.struct(*every.columns).alias(name))
            bound = bound.withColumn("__id", F.col(f"`{name}`.element_id")).drop(name).join(now, "__id").drop("__id")
        return bound

    def _delete(self, bound: DataFrame, names: list[str], with_edges: bool) -> None:
        bound = cut(bound)
        for name in names:
            gone = bound.select(F.col(f"`{name}`.element_id").alias("element_id")).distinct()
            if self._is_node(bound, name):
                ends = lambda c: gone.withColumnRenamed("element_id", c)
                left = self.edges.join(ends("start_node_id"), "start_node_id", "left_anti").join(ends("end_node_id"), "end_node_id", "left_anti").select(self.edges.columns)
                if not with_edges and left.count() < self.edges.count():
                    raise ValueError(f"{name} still has edges")
                self.edges, self.nodes = cut(left), cut(self.nodes.join(gone, "element_id", "left_anti"))
            else:
                self.edges = cut(self.edges.join(gone, "element_id", "left_anti").select(self.edges.columns))

    def _return(self, bound: DataFrame, r: _Reader) -> DataFrame:
        once = r.accept("DISTINCT")

        def item() -> tuple[str, Value]:
            first = r.at
            value = r.any_of()
            text = "".join(t for _, t in r.tokens[first : r.at])
            return (r.word() if r.accept("AS") else text), value

        items = r.several(item)
        keys = [v.column.alias(n) for n, v in items if not v.aggregate]
        if any(v.aggregate for _, v in items):
            out = bound.groupBy(*keys).agg(*(v.column.alias(n) for n, v in items if v.aggregate))
            out = out.select(*(F.col(f"`{n}`") for n, _ in items))
        else:
            out = bound.select(*keys)
        if once:
            out = out.distinct()
        if r.accept("ORDER", "BY"):
            def key() -> Column:
                text = r.word()
                while r.accept("."):
                    text += "." + r.word()
                if text not in out.columns:
                    raise SyntaxError(f"ORDER BY {text}: not returned")
                c, down = F.col(f"`{text}`"), r.accept("DESC")
                r.accept("ASC")
                return c.desc_nulls_last() if down else c.asc_nulls_last()

            out = out.orderBy(*r.several(key))
        if r.accept("SKIP"):
            out = out.offset(r.literal())
        if r.accept("LIMIT"):
            out = out.limit(r.literal())
        if r.at < len(r.tokens):
            raise SyntaxError(f"unexpected {r.tokens[r.at][1]}")
        return out
