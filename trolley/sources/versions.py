"""Versions of the processed tables.

A run writes its rows into folders of its own and publishes them with one manifest, a small
JSON document that names the folders of every table, part by part. The manifest is written
under another name and then renamed, without overwriting, as the last step: a reader sees all
tables of one run or none of it, and a run that dies leaves nothing behind but folders that no
manifest names. Parts that a run does not touch keep the folders they have, so neither history
nor the untouched part of a derived table is rewritten. Old manifests and the folders that only
they name are deleted some versions later.

Layout: ``_versions/v000000000007.json`` beside ``<table>/run=v000000000007-<run>-<n>/[<part column>=<part>/]``.
One writer at a time: of two that start from the same version, the second one's rename fails."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MANIFESTS = "_versions"
WHOLE = "all"       # the only part of a table without a part column
KEEP = 5            # versions that stay readable
MERGE_AT = 16       # folders of one part that an append may leave; beyond, they become one


class ConcurrentRun(RuntimeError):
    """Another run has published a version since this one started."""


def _fs(spark: SparkSession, path: str):
    """(file system, function text -> path) for any Hadoop URI."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at(path))) if fs.exists(at(path)) else []


def _join(base: str, *names: str) -> str:
    return "/".join([base.rstrip("/"), *names])


def _read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at(path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def published(spark: SparkSession, base: str) -> list[str]:
    """Names of the manifests, oldest first."""
    return [n for n in _children(spark, _join(base, MANIFESTS)) if n.startswith("v") and n.endswith(".json")]


def manifest(spark: SparkSession, base: str, name: str | None = None) -> dict:
    """The newest (or the named) manifest; an empty one where nothing was published."""
    names = [name] if name else published(spark, base)[-1:]
    if not names:
        return {"version": 0, "tables": {}, "settings": {}, "streams": {}}
    return json.loads(_read_text(spark, _join(base, MANIFESTS, names[0])))


def folders(tables: dict, name: str, parts=None) -> list[str]:
    """Folders of a table, of the given parts only if any are given."""
    of = tables.get(name, {})
    wanted = of if parts is None else [p for p in map(str, parts) if p in of]
    return [f for p in wanted for f in of[p]]


def read(spark: SparkSession, base: str, names: list[str], schema: T.StructType) -> DataFrame:
    """The rows of some folders with the columns of ``schema``; none for no folder."""
    if not names:       # a filter the optimizer sees through: joins and unions with it are dropped
        return spark.range(1).filter("false").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))
    table = names[0].split("/")[0]      # the folders of a run and of its parts are partition columns below it
    return (spark.read.schema(schema).option("basePath", _join(base, table)).parquet(*[_join(base, f) for f in names])
            .select(*schema.fieldNames()))


class Version:
    """The next version of the tables under ``base``, while it is written. ``load`` sees what was
    written so far; everybody else sees it from ``commit`` on. ``fresh`` starts from no table."""

    def __init__(self, spark: SparkSession, base: str, fresh: bool = False):
        self.spark, self.base = spark, base.rstrip("/")
        before = manifest(spark, base)
        self.number = before["version"] + 1
        self.tables = {} if fresh else {t: {p: list(f) for p, f in parts.items()} for t, parts in before["tables"].items()}
        self.settings = {} if fresh else dict(before["settings"])
        self.streams = dict(before["streams"])
        self.written: dict[str, dict[str, str]] = {}    # folders of this version
        self._name, self._n = f"v{self.number:012d}", 0
        self._run = uuid.uuid4().hex[:8]

    def load(self, name: str, schema: T.StructType, parts=None) -> DataFrame:
        return read(self.spark, self.base, folders(self.tables, name, parts), schema)

    def added(self, name: str, schema: T.StructType) -> DataFrame:
        """The rows of a table that this version has written."""
        return read(self.spark, self.base, list(self.written.get(name, {}).values()), schema)

    def _write(self, name: str, df: DataFrame, by: list[str], cluster_by: list[str]) -> dict[str, str]:
        folder = f"{name}/run={self._name}-{self._run}-{self._n}"
        self._n += 1
        if cluster_by:  # ranges of the keys: one task writes few folders, a hot one is split by its dates
            df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
        df.write.partitionBy(*by).parquet(_join(self.base, folder)) if by else df.write.parquet(_join(self.base, folder))
        if not by:
            return {WHOLE: folder}
        return {child.split("=", 1)[1]: f"{folder}/{child}" for child in _children(self.spark, _join(self.base, folder)) if "=" in child}

    def append(self, name: str, df: DataFrame, by=(), cluster_by=(), merge: Callable[[list[str]], DataFrame] | None = None) -> None:
        """Add rows. ``by``: the part column, then columns of sub-folders. Where a part has more
        than MERGE_AT folders, ``merge(parts)`` gives its rows, which become one folder."""
        of = self.tables.setdefault(name, {})
        new = self._write(name, df, list(by), list(cluster_by))
        self.written[name] = {**self.written.get(name, {}), **new}
        for part, folder in new.items():
            of.setdefault(part, []).append(folder)
        many = [p for p in new if len(of[p]) > MERGE_AT]
        if merge and many:
            of.update({p: [f] for p, f in self._write(name, merge(many), list(by), list(cluster_by)).items()})

    def replace(self, name: str, df: DataFrame, by=(), parts=None, cluster_by=()) -> None:
        """Rows of the whole table or, with ``parts``, of these parts; the others stay."""
        new = self._write(name, df, list(by), list(cluster_by))
        gone = set(map(str, parts)) if parts is not None else None
        kept = {} if gone is None else {p: f for p, f in self.tables.get(name, {}).items() if p not in gone}
        self.tables[name] = kept | {p: [f] for p, f in new.items()}
        self.written[name] = new

    def commit(self, keep: int = KEEP) -> int:
        """Publish all tables at once, then delete what only older versions name."""
        text = json.dumps({"version": self.number, "tables": self.tables, "settings": self.settings, "streams": self.streams})
        fs, at = _fs(self.spark, self.base)
        final, draft = _join(self.base, MANIFESTS, f"{self._name}.json"), _join(self.base, MANIFESTS, f".{self._name}-{self._run}")
        out = fs.create(at(draft), True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)     # no overwrite
        try:
            files.rename(fs.makeQualified(at(draft)), fs.makeQualified(at(final)), options)
        except Exception as e:
            fs.delete(at(draft), False)
            if fs.exists(at(final)):
                raise ConcurrentRun(f"version {self.number} of {self.base} was published by another run") from e
            raise
        expire(self.spark, self.base, keep)
        return self.number


def expire(spark: SparkSession, base: str, keep: int = KEEP) -> None:
    """Delete all but the newest ``keep`` manifests, and every folder of a run that none of these
    names (those of runs that died included). Called by the writer, after its commit."""
    names = published(spark, base)
    fs, at = _fs(spark, base)
    named = {n: manifest(spark, base, n)["tables"] for n in names}
    tables = {t for of in named.values() for t in of}
    used = {"/".join(f.split("/")[:2]) for n in names[-keep:] for parts in named[n].values() for listed in parts.values() for f in listed}
    for n in names[:-keep]:     # manifests first: nothing published names a deleted folder
        fs.delete(at(_join(base, MANIFESTS, n)), False)
    for table in tables:
        for folder in _children(spark, _join(base, table)):
            if f"{table}/{folder}" not in used:
                fs.delete(at(_join(base, table, folder)), True)
