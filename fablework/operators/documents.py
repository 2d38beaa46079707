"""Schemaless documents to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame) -> DataFrame:
    """Explode the first array column, else expand the first struct column, until only scalars are left.

    Nulls and empty arrays give one null row; nested names are joined by dots.
    """
    while True:
        arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
        structs = [f for f in df.schema if isinstance(f.dataType, T.StructType)]
        if arrays:
            df = df.select(*(F.explode_outer(f"`{c}`").alias(c) if c == arrays[0] else F.col(f"`{c}`") for c in df.columns))
        elif structs:
            s = structs[0]
            wide = [F.col(f"`{s.name}`.`{f.name}`").alias(f"{s.name}.{f.name}") for f in s.dataType]
            df = df.select(*(x for c in df.columns for x in (wide if c == s.name else [F.col(f"`{c}`")])))
        else:
            return df


def natural_sort(df: DataFrame, first: list[str] = (), ignored: list[str] = ()) -> DataFrame:
    """Sort by ``first``, then by the other scalar columns in alphabetical order; nulls last."""
    scalar = [f.name for f in df.schema if not isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) and f.name not in ignored]
    keys = [*first, *sorted(c for c in scalar if c not in first)]
    return df.orderBy(*(F.col(f"`{c}`").asc_nulls_last() for c in keys))


#: The kinds of JSON scalars, as they name columns, and the kinds a scalar may be written as, exact first.
WIDER = {"int": ("int", "float"), "float": ("float",), "str": ("str",), "bool": ("bool",)}
CASTS = {"int": "long", "float": "double", "str": "string", "bool": "boolean"}


def _kind(v: Column) -> Column:
    """int, float, str, bool, null, list or dict, of a variant; null for none."""
    s = F.schema_of_variant(v)
    begins = lambda *names: s.rlike(f"^({'|'.join(names)})")
    return (F.when(begins("ARRAY"), "list").when(begins("OBJECT"), "dict").when(begins("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
            .when(begins("DOUBLE", "FLOAT", "DECIMAL"), "float").when(begins("BOOLEAN"), "bool").when(begins("STRING"), "str").when(s.isNotNull(), "null"))


def _items(v: Column) -> Column:
    """A value (v: variant, r: its text) as a list of such: null and empty ones have one null item, scalars and objects are their own."""
    none = F.array(F.lit(None).cast("struct<v:variant,r:string>"))
    values, texts = v["v"].cast("array<variant>"), F.from_json(v["r"], "array<string>")
    listed = F.transform(values, lambda x, i: F.struct(x.alias("v"), F.get(texts, i).alias("r")))
    kind = _kind(v["v"])
    return F.when(v["v"].isNull() | (kind == "null"), none).when(kind == "list", F.when(F.size(values) > 0, listed).otherwise(none)).otherwise(F.array(v))


def _under(v: Column, key: str) -> Column:
    """The value of a key of an object."""
    value = F.try_element_at(v["v"].cast("map<string,variant>"), F.lit(key))
    return F.struct(value.alias("v"), F.try_element_at(F.from_json(v["r"], "map<string,string>"), F.lit(key)).alias("r"))


def _kinds_of(df: DataFrame, columns: list[str], order: str) -> dict[str, dict]:
    """Of each variant column: kinds of its items, kinds of scalar first items, and nested keys with kinds, all as first met.

    One aggregation of all columns; what reaches the driver is as wide as the table is.
    """
    q = lambda c: F.col(f"`{c}`")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), _items(q(c)).alias("i")) for c in columns)))
    items = df.select(F.col(order).alias("o"), each.alias("x")).select("o", "x.c", F.get("x.i", F.lit(0)).alias("first"), F.posexplode("x.i").alias("p", "item"))
    items = items.where("item is not null").withColumns({"k": _kind(F.col("item.v")), "f": _kind(F.col("first.v"))})
    # a variant sorts its keys, its text has them as they were written
    nested = F.map_entries(F.when(F.col("k") == "dict", F.col("item.v").cast("map<string,variant>")).otherwise(F.create_map().cast("map<string,variant>")))
    rows = items.select("o", "p", "c", "k", "f", "item.r", F.explode_outer(nested).alias("e"))
    rows = rows.withColumn("q", F.array_position(F.json_object_keys("r"), F.col("e.key")))
    said = rows.groupBy("c", "k", "f", F.col("e.key").alias("key"), _kind(F.col("e.value")).alias("nk")).agg(F.min(F.struct("o", "p", "q")).alias("at"))
    out: dict[str, dict] = {c: {"items": [], "firsts": [], "nested": {}} for c in columns}
    for r in said.orderBy("at").collect():
        of = out[r["c"]]
        of["items"].append(r["k"])
        if r["f"] in CASTS:
            of["firsts"].append(r["f"])
        if r["key"] is not None:
            of["nested"].setdefault(r["key"], []).append(r["nk"])
    return out


def nested_key(kind: str, nested: dict[str, list[str]], merge: bool = True) -> str:
    """Where a bare scalar goes among a column's nested keys: the first of its own kind, else of a wider, else a key of its own."""
    fits = [k for wide in WIDER[kind] for k, kinds in nested.items() if wide in kinds] if merge else []
    return fits[0] if fits else f"_unspecified_{kind}"


def reconcile(df: DataFrame, json_col: str, order: str, merge: bool = True) -> DataFrame:
    """JSON objects of any shape, one a row, as a flat table: ``order`` and a column for each scalar path.

    A key may hold a scalar in one document, an object in another and a list of either in a third. Lists
    become rows, several lists in one document their product; null, missing and empty values one null row.
    Where other documents have objects, a bare scalar goes under the first nested key of its kind, met in
    the order of ``order``; without ``merge`` always under ``_unspecified_<kind>``. Kinds that differ in
    one column end as text, whole and broken numbers as doubles. Text that is no JSON object is an error.
    """
    q = lambda c: F.col(f"`{c}`")
    text = F.col(json_col)
    whole = F.from_json(text, "map<string,variant>", {"mode": "FAILFAST"})
    keys = df.select(F.col(order).alias("o"), F.posexplode(F.map_keys(whole)).alias("p", "k")).groupBy("k").agg(F.min(F.struct("o", "p")).alias("at"))
    pending = [r["k"] for r in keys.orderBy("at").select("k").collect()]
    df = df.select(F.col(order).alias("__order"), F.struct(F.parse_json(text).alias("v"), text.alias("r")).alias("__doc"))
    df = df.select("__order", *(_under(F.col("__doc"), k).alias(k) for k in pending))
    done: dict[str, str] = {}
    while pending:
        kinds = _kinds_of(df, pending, "__order")
        again = []
        for c in pending:
            of = kinds[c]
            df = df.withColumn("__first", _kind(F.get(_items(q(c)), F.lit(0))["v"])).select("*", F.explode(_items(q(c))).alias("__item")).drop(c)
            if of["nested"]:
                bare = {f: nested_key(f, of["nested"], merge) for f in dict.fromkeys(of["firsts"])}
                for k in dict.fromkeys([*of["nested"], *bare.values()]):
                    inside = F.when(_kind(F.col("__item.v")) == "dict", _under(F.col("__item"), k))
                    wrapped = [f for f, target in bare.items() if target == k]
                    value = inside.otherwise(F.when(F.col("__first").isin(wrapped), F.col("__item"))) if wrapped else inside
                    df = df.withColumn(f"{c}.{k}", value)
                    again.append(f"{c}.{k}")
            elif "list" in of["items"]:
                df = df.withColumn(c, F.col("__item"))
                again.append(c)
            else:
                found = set(of["items"]) - {"null"}
                done[c] = CASTS[found.pop()] if len(found) == 1 else "double" if found == {"int", "float"} else "string"
                df = df.withColumn(c, F.col("__item.v").cast(done[c]))
            df = df.drop("__first", "__item")
        pending = again
    return df.select(F.col("__order").alias(order), *map(q, done))


def tabular(json: Column) -> Column:
    """Whether the JSON text of a result can become rows.

    A list can if it is not empty and holds objects only; an object with a batch, ``cursor.firstBatch`` or ``firstBatch``,
    if that is a list that is not empty; another object if a field is a list that begins with a scalar or an object, which
    tells data from a bare status. All else cannot, nor can null and broken text.
    """
    v = F.try_parse_json(json)
    kind = lambda x: F.schema_of_variant(x)
    fields, items = F.try_variant_get(v, "$", "map<string,variant>"), F.try_variant_get(v, "$", "array<variant>")
    filled = lambda path: F.coalesce(F.size(F.try_variant_get(v, path, "array<variant>")) > 0, F.lit(False))
    first = lambda x: F.try_variant_get(x, "$[0]", "variant")
    begins = lambda x: F.coalesce(~kind(first(x)).rlike("^(ARRAY|VOID)"), F.lit(False))
    has = lambda name: F.map_contains_key(fields, name)
    is_list, is_object = kind(v).startswith("ARRAY"), kind(v).startswith("OBJECT")
    objects = (F.size(items) > 0) & F.forall(items, lambda x: F.coalesce(kind(x).startswith("OBJECT"), F.lit(False)))
    batch = F.when(has("cursor"), filled("$.cursor.firstBatch")).when(has("firstBatch"), filled("$.firstBatch"))
    other = F.exists(F.map_values(fields), begins)
    return F.coalesce(F.when(is_list, objects).when(is_object, F.coalesce(batch, other)), F.lit(False))
