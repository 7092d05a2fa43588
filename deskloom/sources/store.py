"""Tables in versions: each commit adds folders beside those there are, and one numbered log file then names what belongs to the new version.

A log file is made only if none of that number is there, so of two writers that start from one version the second fails and
changes nothing. Readers follow the last log file, and see one version or the other. Paths may be in any store that Spark reaches.

A folder of a table is a part, cut in one of three ways: by bucket of its clients, so that some can be rewritten; by month, so that reports
read theirs only; or by slices of a key's hash with a filter for each, so that a search reads the slices that may hold its keys.
"""

from __future__ import annotations

import calendar
import json
import tempfile
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from . import blooms


SLICE, MONTH = StructField("slice", IntegerType()), StructField("month", StringType())
MONTHLY = ("message",)  # tables cut by month


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``; a local one where that is unset, as in tests, and never on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or f"file://{tempfile.gettempdir()}/deskloom-stores"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def month(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM")


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """Rows with one value of a column together, but large values dealt over many tasks: a table may have one month or bucket only."""
    return rows.hint("rebalance", by)


class ConcurrentCommit(Exception):
    """Another writer has committed since this one read the state."""


class Store:
    """``buckets`` divide tables that have a client: what a commit touches is rewritten by bucket, the rest stays where it is."""

    def __init__(self, spark: SparkSession, uri: str, buckets: int = 64, keep: int = 3):
        self.spark, self.uri, self.buckets, self.keep = spark, uri.rstrip("/"), buckets, keep
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = lambda name: hadoop.Path(f"{self.uri}/{name}")
        self._files = hadoop.Path(self.uri).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path("log"))

    def _versions(self) -> list[int]:
        return sorted(
            int(f.getPath().getName()[:-5]) for f in self._files.listStatus(self._path("log")) if f.getPath().getName().endswith(".json")
        )

    def _read(self, version: int) -> dict:
        text = self.spark.read.text(f"{self.uri}/log/{version:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def state(self) -> dict:
        """version, watermark, schemas and the folders of each table; before the first commit version 0, watermark -1."""
        found = self._versions()
        return self._read(found[-1]) if found else {"version": 0, "watermark": -1, "tables": {}, "schemas": {}, "facts": {}}

    def bucket(self, client: Column) -> Column:
        return F.pmod(F.xxhash64(client), F.lit(self.buckets)).cast("int")

    def commit(
        self, base: dict, watermark: int, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None,
        rewrite: dict[str, tuple[DataFrame, Iterable[int]]] | None = None, keys: dict[str, str] | None = None, months: dict[str, str] | None = None, facts: dict | None = None,
    ) -> dict:
        """A new version after ``base``: tables replaced as a whole, appended to, or rewritten in the given buckets.

        Tables in ``keys`` are sliced by that column, those in ``months`` cut by the month of that time, others by bucket. ``facts`` are kept with the version.
        A failure before the log file is there leaves the old version.
        """
        state = {
            "version": base["version"] + 1, "watermark": watermark, "tables": {k: list(v) for k, v in base["tables"].items()},
            "schemas": dict(base["schemas"]), "facts": base.get("facts", {}) | (facts or {}),
        }
        own = uuid.uuid4().hex

        def put(name: str, df: DataFrame, held: list[int] | None = None) -> list:
            to, slices = f"{self.uri}/{name}/part={own}", None
            state["schemas"][name] = df.schema.jsonValue()
            if key := (keys or {}).get(name):
                slices = max(1, -(-df.count() // blooms.SLICE_ROWS))
                sliced = df.withColumn("slice", blooms.slice_of(blooms.key_hash(key), slices))
                _dealt(sliced, "slice").write.partitionBy("slice").parquet(to)
                written = self.spark.read.schema(StructType([*df.schema.fields, SLICE])).parquet(to)
                blooms.filters(written.select("slice", blooms.key_hash(key).alias("h")), slices).write.parquet(f"{self.uri}/{name}_filter/part={own}")
            elif time := (months or {}).get(name):
                df.withColumn("month", month(F.col(time))).transform(_dealt, "month").write.partitionBy("month").parquet(to)
            else:
                named = df.withColumn("bucket", self.bucket(F.col("client"))) if "client" in df.columns else df.withColumn("bucket", F.lit(0))
                _dealt(named, "bucket").write.partitionBy("bucket").parquet(to)
            return [own, held, slices]

        made = [(name, df, None) for name, df in [*(replace or {}).items(), *(append or {}).items()]]
        made += [(name, df, sorted(set(buckets))) for name, (df, buckets) in (rewrite or {}).items()]
        with ThreadPoolExecutor(max(1, len(made))) as pool:  # small writes, each of which waits for the last task of its own jobs
            parts = dict(zip((name for name, *_ in made), pool.map(lambda x: put(*x), made), strict=True))
        for name, part in parts.items():
            old = [] if name in (replace or {}) else state["tables"].get(name, [])
            if part[1] is not None:
                left = [[at, sorted(set(range(self.buckets) if held is None else held) - set(part[1])), n] for at, held, n in old]
                old = [x for x in left if x[1]]
            state["tables"][name] = [*old, part]
        self._log(state)
        self._sweep()
        return state

    def _log(self, state: dict) -> None:
        try:
            out = self._files.create(self._path(f"log/{state['version']:012d}.json"), False)
        except PySparkException as e:
            raise ConcurrentCommit(state["version"]) from e
        except Exception as e:  # py4j's own error where Spark doesn't translate it
            if "exist" in str(e).lower():
                raise ConcurrentCommit(state["version"]) from e
            raise
        out.write(json.dumps(state).encode())
        out.close()

    def _sweep(self) -> None:
        """Delete log files but the last ``keep``, and folders that none of those names."""
        versions = self._versions()
        old, kept = versions[: -self.keep], versions[-self.keep :]
        if not old:
            return
        live = {(name, at) for v in kept for name, parts in self._read(v)["tables"].items() for at, *_ in parts}
        for v in old:
            for name, at in {(name, at) for name, parts in self._read(v)["tables"].items() for at, *_ in parts} - live:
                self._files.delete(self._path(f"{name}/part={at}"), True)
                self._files.delete(self._path(f"{name}_filter/part={at}"), True)
            self._files.delete(self._path(f"log/{v:012d}.json"), False)

    def _of(self, name: str, state: dict, paths: list[str], *extra: StructField) -> DataFrame:
        schema = StructType.fromJson(state["schemas"][name])
        whole = StructType([*schema.fields, *extra, StructField("part", StringType())])
        return self.spark.read.schema(whole).option("basePath", f"{self.uri}/{name}").parquet(*paths)

    def table(self, name: str, state: dict | None = None, buckets: Iterable[int] | None = None, months: tuple[str, str] | None = None) -> DataFrame | None:
        """A table of a version, the last one unless given; only some buckets, or the months from one to another, if asked."""
        state = state or self.state()
        if name not in state["tables"]:
            return None
        schema, out, whole, by_month = StructType.fromJson(state["schemas"][name]), None, [], name in MONTHLY
        for at, held, _ in state["tables"][name]:
            path = f"{self.uri}/{name}/part={at}"
            wanted = held if buckets is None else sorted(set(buckets) & set(range(self.buckets) if held is None else held))
            if wanted is None:
                whole.append(path)
                continue
            part = self._of(name, state, [path], StructField("bucket", IntegerType())).where(F.col("bucket").isin(wanted)).select(schema.names)
            out = part if out is None else out.unionByName(part)
        if whole:
            part = self._of(name, state, whole, *([MONTH] if by_month else []))
            if by_month and months:
                part = part.where(F.col("month").between(*months))
            out = part.select(schema.names) if out is None else out.unionByName(part.select(schema.names))
        return self.spark.createDataFrame([], schema) if out is None else out

    def hits(self, name: str, keys: DataFrame, key: str, state: dict | None = None) -> list[tuple[str, int]]:
        """(part, slice) of a sliced table that may hold one of the keys."""
        state = state or self.state()
        parts = state["tables"].get(name, [])
        if not parts:
            return []
        schema = StructType([StructField("slices", IntegerType()), SLICE, StructField("bits", BinaryType()), StructField("part", StringType())])
        paths = [f"{self.uri}/{name}_filter/part={at}" for at, *_ in parts]
        known = self.spark.read.schema(schema).option("basePath", f"{self.uri}/{name}_filter").parquet(*paths)
        return blooms.hits(known, keys.select(blooms.key_hash(key).alias("h")), sorted({n for *_, n in parts}))

    def find(self, name: str, keys: DataFrame, key: str, state: dict | None = None) -> DataFrame | None:
        """The rows of a sliced table with one of the keys; only slices that may hold one are read, and None stands for none of them."""
        state = state or self.state()
        got = self.hits(name, keys, key, state)
        if not got:
            return None
        rows = self._of(name, state, [f"{self.uri}/{name}/part={at}/slice={n}" for at, n in got], SLICE)
        return rows.join(keys.select(key).distinct(), key, "left_semi").select(StructType.fromJson(state["schemas"][name]).names)

    def workspace(self) -> Workspace:
        return Workspace(self)

    def parts(self, name: str) -> int:
        return len(self.state()["tables"].get(name, []))

    def compact(self, name: str) -> dict:
        """Rewrite a table that many commits have added to as one folder."""
        base = self.state()
        return self.commit(base, base["watermark"], replace={name: self.table(name, base)}, months={"message": "created_at"})


class Workspace:
    """A folder of the store for tables that a commit is made from; no version names it."""

    def __init__(self, store: Store):
        self.store, self.at, self.n = store, f"work/{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.store.uri}/{self.at}/{self.n}"
        df.write.parquet(path)
        return self.store.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        self.store._files.delete(self.store._path(self.at), True)


def monthly_ranges(start: date, end: date) -> list[tuple[date, date]]:
    """The calendar months of a period, both ends inclusive; the first and the last may be partial."""
    out = []
    while start <= end:
        last = min(end, start.replace(day=calendar.monthrange(start.year, start.month)[1]))
        out.append((start, last))
        start = last + timedelta(days=1)
    return out


Sections = list[tuple[str, DataFrame]]


def write_sheets(sheets: dict[str, DataFrame | Sections], uri: str) -> list[str]:
    """Each frame as a folder of CSV files named like a workbook's sheet; names are made safe and distinct.

    A sheet of titled sections is a folder with one folder for each, numbered in order.
    """
    made: list[str] = []
    for name, content in sheets.items():
        safe = sheet_name(name, made)
        made.append(safe)
        parts = [("", content)] if isinstance(content, DataFrame) else [
            (f"/{i:02d} {sheet_name(title, [])}", df) for i, (title, df) in enumerate(content, 1)
        ]
        for tail, df in parts:
            df.write.mode("overwrite").option("header", True).csv(f"{uri.rstrip('/')}/{safe}{tail}")
    return made


def write_json(df: DataFrame, uri: str) -> None:
    """Records as lines of JSON; nulls are written too."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(uri)


def sheet_name(name: str, taken: list[str], longest: int = 31) -> str:
    """Without characters that sheets forbid, at most 31 long, and unlike the others whatever the case."""
    base = "".join("_" if c in "[]:*?/\\" else c for c in name).strip("'")[:longest] or "Sheet"
    used, out, i = {t.lower() for t in taken}, base, 2
    while out.lower() in used:
        tail = f"~{i}"
        out, i = base[: longest - len(tail)] + tail, i + 1
    return out
