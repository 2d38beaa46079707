"""Keyed document collections on plain Parquet: each change writes a new version, readers take the last whole one.

A version is a folder of its own, complete once Spark's committer has marked it, so a reader never sees
half a write and a lost driver leaves the version before. One writer at a time.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyExists(ValueError):
    """A guarded insert met a key that is there."""


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key: the columns of ``new`` overlay those of ``old``, new keys are added; a null in ``new`` changes nothing."""
    a, b = old.withColumn("__old", F.lit(True)), new
    shared = [c for c in new.columns if c not in keys and c in old.columns]
    met = a.join(b.select(*keys, *(F.col(c).alias(f"__{c}") for c in new.columns if c not in keys)), keys, "full")
    kept = [F.coalesce(f"__{c}", c).alias(c) if c in shared else F.col(c) for c in old.columns]
    return met.select(*kept, *(F.col(f"__{c}").alias(c) for c in new.columns if c not in old.columns and c not in keys))


class Collection:
    """Rows with unique ``keys`` below ``path``."""

    KEEP = 2

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str | None = None):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.path)):
            return []
        found = [f.getPath() for f in self._fs.listStatus(self._path(self.path))]
        return sorted(int(p.getName()[1:]) for p in found if p.getName()[1:].isdigit() and self._fs.exists(self._path(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        if at := self.versions():
            return self.spark.read.parquet(f"{self.path}/v{at[-1]}")
        if self.schema is None:
            raise LookupError(f"no collection at {self.path}")
        return self.spark.createDataFrame([], self.schema)

    def replace(self, df: DataFrame) -> None:
        at = self.versions()
        df.write.mode("overwrite").parquet(f"{self.path}/v{(at[-1] if at else 0) + 1}")
        for old in at[: 1 - self.KEEP or None]:
            self._fs.delete(self._path(f"{self.path}/v{old}"), True)

    def insert(self, rows: DataFrame) -> None:
        """Add rows; a key that is there already, or twice in ``rows``, is an error."""
        self.guard(rows)
        if not rows.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise KeyExists(f"a key of {self.keys} occurs twice")
        self.replace(self.read().unionByName(rows, allowMissingColumns=True) if self.versions() or self.schema else rows)

    def guard(self, rows: DataFrame, field: str | None = None) -> None:
        """An error if any of the keys is there, or with ``field`` is there with a value of it."""
        if not self.versions():
            return
        old = self.read() if field is None else self.read().where(F.col(field).isNotNull())
        if not old.join(rows.select(self.keys).distinct(), self.keys, "left_semi").isEmpty():
            raise KeyExists(f"keys of {self.keys} exist" + (f" with {field}" if field else ""))

    def update(self, rows: DataFrame) -> None:
        """Set the columns of ``rows`` where keys match; other keys are left out."""
        old = self.read()
        self.replace(merge(old, rows.join(old.select(self.keys), self.keys, "left_semi"), self.keys))

    def upsert(self, rows: DataFrame, guarded: str | None = None) -> None:
        """Set or add; with ``guarded`` first an error if that field has a value for any of the keys."""
        if guarded:
            self.guard(rows, guarded)
        self.replace(merge(self.read(), rows, self.keys) if self.versions() or self.schema else rows)

    def unset(self, keys: DataFrame, field: str) -> None:
        old = self.read()
        met = old.join(keys.select(self.keys).distinct().withColumn("__hit", F.lit(True)), self.keys, "left")
        cleared = F.when(F.col("__hit").isNull(), F.col(field)).alias(field)
        self.replace(met.select(*(cleared if c == field else F.col(c) for c in old.columns)))

    def delete(self, condition: Column | str | None = None) -> None:
        condition = F.lit(True) if condition is None else F.expr(condition) if isinstance(condition, str) else condition
        self.replace(self.read().where(~F.coalesce(condition, F.lit(False))))

    def find(self, **equal) -> DataFrame:
        df = self.read()
        for c, v in equal.items():
            df = df.where(F.col(c) == v)
        return df

    def find_one(self, **equal):
        """A row or None."""
        return self.find(**equal).orderBy(*self.keys).first()

    def drop(self) -> None:
        self._fs.delete(self._path(self.path), True)

    def save_result(self, key: DataFrame, status: str, result: str) -> None:
        """Set the nested ``task`` (status, result) of keys; ``result`` is JSON text."""
        self.update(key.select(self.keys).withColumn("task", F.struct(F.lit(status).alias("status"), F.lit(result).alias("result"))))


class Payloads:
    """Posted score payloads in the order of arrival: add, look up by number, list."""

    def __init__(self, spark: SparkSession, path: str):
        self._at = Collection(spark, path, ["number"], "number long, payload string")

    def add(self, *payloads: str) -> list[int]:
        """The numbers of the new payloads; text that is no JSON is an error, and then none is added."""
        for p in payloads:
            json.loads(p)
        first = self._at.read().count()
        rows = [(first + i, p) for i, p in enumerate(payloads)]
        if rows:
            self._at.insert(self._at.spark.createDataFrame(rows, self._at.schema))
        return [n for n, _ in rows]

    def get(self, number: int) -> str | None:
        row = self._at.find_one(number=number)
        return row and row["payload"]

    def all(self) -> DataFrame:
        return self._at.read().orderBy("number")


def healthy(spark: SparkSession) -> bool:
    """Whether the session answers a query."""
    try:
        return spark.sql("SELECT 1 AS ok").first()["ok"] == 1
    except Exception:  # whatever is wrong, it does not answer
        return False


def run_command(spark: SparkSession, base: str, command: str) -> DataFrame | None:
    """One JSON command: insert, find, delete, drop or ping; documents are kept as (``_id``, ``doc``) JSON text.

    ``find`` takes equality filters on top-level scalars; ``delete`` takes those of its ``deletes``, an empty one for all.
    """
    said = json.loads(command)
    name = next(iter(said))
    if name == "ping":
        return None
    at = Collection(spark, f"{base}/{said[name]}", ["_id"], "_id string, doc string")

    def met(query: dict | None) -> Column:
        out = F.lit(True)
        for k, v in (query or {}).items():
            out &= F.get_json_object("doc", f"$.{k}") == (v if isinstance(v, str) else json.dumps(v))
        return out

    if name == "insert":
        at.insert(spark.createDataFrame([(str(d.get("_id") or uuid4().hex), json.dumps(d)) for d in said["documents"]], "_id string, doc string"))
    elif name == "find":
        return at.read().where(met(said.get("filter")))
    elif name == "delete":
        for d in said["deletes"]:
            at.delete(met(d.get("q")))
    elif name == "drop":
        at.drop()
    else:
        raise ValueError(f"unknown command {name}")
    return None


def post_payloads(df: DataFrame, column: str, url: str, timeout: float = 10.0) -> DataFrame:
    """POST each JSON text to ``url``: ``df`` with ``code``, the answer's status (null: no answer). Lazy, so written once."""
    kept = [c for c in df.columns if c != "code"]

    def run(frames):
        from urllib.error import HTTPError, URLError
        from urllib.request import Request, urlopen

        def send(body):
            try:
                with urlopen(Request(url, body.encode(), {"Content-Type": "application/json"}), timeout=timeout) as a:
                    return a.status
            except HTTPError as e:
                return e.code
            except (URLError, OSError):
                return None

        for frame in frames:
            yield frame.assign(code=[None if b is None else send(b) for b in frame[column]])

    return df.select(kept).mapInPandas(run, df.select(*kept, F.lit(None).cast("int").alias("code")).schema)


def read_timing(spark: SparkSession, path: str, current: DataFrame, run: str = "run_id") -> DataFrame:
    """Timings of earlier runs and of this one; a missing or broken file leaves this one's alone.

    Rows of the file that have this run's number are left out, so a run is never counted twice.
    """
    try:
        old = spark.read.csv(path, header=True, schema=current.schema, mode="FAILFAST", enforceSchema=False)
        old.foreach(lambda _: None)
    except Exception:
        return current
    return old.join(current.select(run).distinct(), run, "left_anti").select(current.columns).unionByName(current)


def append_timing(current: DataFrame, path: str) -> None:
    """Append this run's own rows, and no others, so the file does not grow by what it held."""
    current.write.mode("append").csv(path, header=True)


def name_contains(df: DataFrame, part: str, column: str = "function", absent: bool = False) -> DataFrame:
    """Rows whose name contains ``part`` in any case, or with ``absent`` does not; null contains nothing."""
    has = F.coalesce(F.contains(F.lower(column), F.lit(part.lower())), F.lit(False))
    return df.where(~has if absent else has)


def save_triples(triples: DataFrame, chunk: str, path: str) -> None:
    """A chunk's triples as JSON lines, to go on from."""
    triples.select("s", "r", "o", F.lit(chunk).alias("chunk")).write.mode("overwrite").json(path)


def load_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("s string, r string, o string, chunk string").json(path)


def save_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV with a header; quotes in texts are doubled, line breaks stay inside quotes. Replaces what is there."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=True, emptyValue="", nullValue="\\N")


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``save_csv`` wrote; null and empty texts stay apart."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True, emptyValue="", nullValue="\\N")


def save_tei(books: DataFrame, path: str, name: str = "path", tei: str = "tei") -> None:
    """Each book as XML text with a declaration in a folder of its own below ``path``, ``name=...``; null texts are left out."""
    text = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), F.col(tei)).alias("value")
    books.where(F.col(tei).isNotNull()).select(name, text).write.mode("overwrite").partitionBy(name).text(path)


def load_tei(spark: SparkSession, path: str) -> DataFrame:
    """(value, name): the files that ``save_tei`` wrote, each whole if a book is one row."""
    return spark.read.text(path, wholetext=True)
