"""Normalising model output to (s, r, o) triples, and moderation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_fence
from .tagger import dealt


def expand(s: Column, r: Column, o: Column) -> Column:
    """Array of (s, r, o) of three lists: equal lengths zip, lists of one repeat to zip, else the full product."""
    most = F.greatest(F.size(s), F.size(r), F.size(o))
    fits = lambda x: (F.size(x) == most) | (F.size(x) == 1)
    at = lambda x, i: F.when(F.size(x) == 1, F.get(x, F.lit(0))).otherwise(F.get(x, i))
    zipped = F.transform(F.sequence(F.lit(0), most - 1), lambda i: F.struct(at(s, i).alias("s"), at(r, i).alias("r"), at(o, i).alias("o")))
    product = F.flatten(F.transform(s, lambda a: F.flatten(F.transform(r, lambda b: F.transform(o, lambda c: F.struct(a.alias("s"), b.alias("r"), c.alias("o")))))))
    return F.when((F.size(s) == 0) | (F.size(r) == 0) | (F.size(o) == 0), F.slice(product, 1, 0)).when(fits(s) & fits(r) & fits(o), zipped).otherwise(product)


def expand_nested(subjects: Column, pairs: Column) -> Column:
    """Subjects times (r, o) pairs; pairs with a blank part are dropped."""
    ok = F.filter(pairs, lambda p: (F.length(p["r"]) > 0) & (F.length(p["o"]) > 0))
    return F.flatten(F.transform(subjects, lambda a: F.transform(ok, lambda p: F.struct(a.alias("s"), p["r"].alias("r"), p["o"].alias("o")))))


def _nested_list(item: Column) -> Column:
    """JSON text of the first value in key order that is a list and begins with an object, under any key; else null."""
    kinds = F.map_entries(F.from_json(item, "map<string,variant>"))
    is_pairs = lambda e: F.startswith(F.schema_of_variant(F.try_variant_get(e["value"], "$[0]", "variant")), F.lit("OBJECT"))
    key = F.get(F.filter(kinds, is_pairs), F.lit(0))["key"]
    return F.element_at(F.from_json(item, "map<string,string>"), key)


def parse(df: DataFrame, column: str) -> DataFrame:
    """Rows of (s, r, o) from JSON text: an object or array of objects with scalars or lists, or nested pair lists.

    Whether a value is a list is told by its kind, not by how its text begins. Text that is no JSON gives no row.
    """
    item = "s string, subject string, r string, relation string, o string, object string, object_ string"
    # reading JSON costs far more than reading rows, and each step's text is made once
    rows = dealt(df.select(F.col(column).alias("__raw"))).select(strip_fence(F.col("__raw")).alias("__text"))
    text, wrapped = F.col("__text"), F.col("__wrapped")
    rows = rows.select(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))).alias("__wrapped"))
    # parsers stop after a value: what follows it would break a list or an object around it
    valid = F.try_parse_json(F.concat(F.lit("["), wrapped, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), wrapped, F.lit("}"))).isNotNull()
    items = F.when(valid, F.from_json(wrapped, "array<string>"))
    x = rows.select(F.explode(items).alias("item")).select(
        F.from_json("item", item).alias("x"), F.from_json("item", "map<string,variant>").alias("kinds"), F.from_json(_nested_list(F.col("item")), "array<string>").alias("pairs"))

    def as_list(*names: str) -> Column:
        """The first of the fields that is not blank, as an array."""
        is_list = lambda c: F.startswith(F.schema_of_variant(F.element_at("kinds", c)), F.lit("ARRAY"))
        value = lambda c: F.when(is_list(c), F.from_json(F.col(f"x.{c}"), "array<string>")).otherwise(F.array(F.col(f"x.{c}")))
        return F.coalesce(*(F.when(F.col(f"x.{c}") != "", value(c)) for c in names), F.array().cast("array<string>"))

    s, r, o = as_list("s", "subject"), as_list("r", "relation"), as_list("o", "object", "object_")
    of = lambda p, *n: F.coalesce(*(F.nullif(F.get_json_object(p, f"$.{c}"), F.lit("")) for c in n))
    pairs = F.transform("pairs", lambda p: F.struct(of(p, "r", "relation").alias("r"), of(p, "o", "object", "object_").alias("o")))
    made = F.when(F.size("pairs") > 0, expand_nested(s, pairs)).otherwise(expand(s, r, o))
    return x.select(F.explode(made).alias("t")).select("t.*")


def moderate(df: DataFrame, labels: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows whose label is not set; unlabelled rows stay (fail open)."""
    return df.join(labels.groupBy(key).agg(F.max(flag).alias("__flag")), key, "left").where(F.coalesce("__flag", F.lit(0)) == 0).drop("__flag")


def moderation_counts(df: DataFrame, labels: DataFrame, key: str, flag: str, by: list[str] = ()) -> DataFrame:
    """(by, total, safe, removed): how many rows ``moderate`` keeps and takes out; rows are counted by key before the join."""
    rows = df.groupBy(*by, key).agg(F.count("*").alias("__n"))
    met = rows.join(labels.groupBy(key).agg(F.max(flag).alias("__flag")), key, "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = met.groupBy(*by).agg(count("__n").alias("total"), count(F.when(F.coalesce("__flag", F.lit(0)) == 0, F.col("__n"))).alias("safe"))
    return out.withColumn("removed", F.col("total") - F.col("safe"))


def from_decoded(text: Column, delimiter: str = " ") -> Column:
    """Array of (s, r, o) of a decoder's flat output: parts in threes, subject, object, relation.

    Parts are trimmed; threes with a blank part and an incomplete last three are dropped. Null gives null.
    """
    parts = F.transform(F.split(text, delimiter), lambda x: F.trim(x))
    n = F.floor(F.size(parts) / 3).cast("int")
    at = lambda i, k: F.get(parts, i * 3 + k)
    threes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(i, 0).alias("s"), at(i, 2).alias("r"), at(i, 1).alias("o")))
    full = lambda t: (F.length(t["s"]) > 0) & (F.length(t["r"]) > 0) & (F.length(t["o"]) > 0)
    return F.when(text.isNotNull(), F.when(n > 0, F.filter(threes, full)).otherwise(F.slice(threes, 1, 0)))


def parse_strict(df: DataFrame, column: str) -> DataFrame:
    """``parse`` that fails on text that is no JSON object or array, as a model's caller has to ask again."""
    df = dealt(df.select(column))
    text = strip_fence(F.col(column))
    whole = F.try_parse_json(text)
    bad = whole.isNull() | ~F.schema_of_variant(whole).rlike("^(OBJECT|ARRAY)")
    checked = F.when(F.col(column).isNotNull() & bad, F.raise_error(F.concat(F.lit("not JSON: "), F.substring(text, 1, 80)))).otherwise(F.col(column))
    return parse(df.withColumn(column, checked), column)


def unparsed(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is no JSON object or array: those that ``parse`` takes nothing from."""
    whole = F.try_parse_json(strip_fence(F.col(column)))
    return df.where(F.coalesce(~F.schema_of_variant(whole).rlike("^(OBJECT|ARRAY)"), F.lit(True)))


def moderate_texts(df: DataFrame, column: str, flags, size: int = 32) -> DataFrame:
    """Adds ``flagged`` by ``flags(list of texts) -> list of bool``, asked in batches of ``size``; a batch that fails passes."""
    kept = [c for c in df.columns if c != "flagged"]

    def run(frames):
        for frame in frames:
            for i in range(0, len(frame), size):
                part = frame.iloc[i : i + size]
                try:
                    said = [bool(x) for x in flags(part[column].tolist())]
                except Exception:  # the service is out: fail open
                    said = [False] * len(part)
                yield part.assign(flagged=said if len(said) == len(part) else [False] * len(part))

    return df.select(kept).mapInPandas(run, df.select(*kept, F.lit(False).alias("flagged")).schema)


def extract(df: DataFrame, column: str, extractor, tries: int = 1) -> DataFrame:
    """Rows of ``df`` times the (s, r, o) that ``extractor(text)`` gives; one that raises is asked ``tries`` times in all.

    A text that fails every time gives one row with nulls and the error's text.
    """
    kept = [c for c in df.columns if c not in ("s", "r", "o", "error")]

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for values, text in zip(frame[kept].itertuples(index=False), frame[column], strict=True):
                for left in range(tries - 1, -1, -1):
                    try:
                        rows += [(*values, *t, None) for t in (extractor(text) if text is not None else [])]
                        break
                    except Exception as e:
                        if not left:
                            rows.append((*values, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[*kept, "s", "r", "o", "error"])

    return df.mapInPandas(run, df.select(*kept, *(F.lit(None).cast("string").alias(c) for c in ("s", "r", "o", "error"))).schema)
