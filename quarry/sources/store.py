"""Tables that are committed together: folders of Parquet files, and a manifest that says which make up a version.

A writer puts new folders beside the old ones and then renames one manifest into place, so readers see all tables of
one version or all of another, and a writer that stops half-way leaves the old version as it is. The number of the
manifest is the version: of two writers that start from one version the second finds its number taken and fails.
A table's rows are dealt into buckets by a key; an upsert or a delete rewrites the buckets that it touches, no others.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_dir: dict[str, str] = {}
#: Number of a bucket, a column of the files' folders only.
BUCKET = "_bucket"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, a folder that driver and executors share; in one process (tests) a temporary one if unset."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="quarry-"))


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"


class Conflict(RuntimeError):
    """Another writer has committed since."""


class Store:
    """Versioned tables in a folder. `buckets` is how many a table's rows are dealt into when it is first written."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        folder = self._at("_versions")
        if not self._fs.exists(folder):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(folder))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """The newest version, 0 if nothing was committed yet."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"tables": {}}
        stream = self._fs.open(self._at(f"_versions/v{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version)["tables"])

    def read(self, name: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table of one version, or some of its buckets."""
        table = self.manifest(version)["tables"][name]
        schema = T.StructType.fromJson(table["schema"])
        chosen = table["buckets"] if buckets is None else {str(b): table["buckets"][str(b)] for b in buckets if str(b) in table["buckets"]}
        paths = [f"{self.path}/{folder}" for _, folder in sorted(chosen.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, table: Mapping, key: list[Column] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(key or map(F.col, table["key"]))), F.lit(table["n"])).cast("int")

    def _written(self, rows: DataFrame, table: dict, dealt: bool = False) -> dict[str, str]:
        """Folders of the new buckets. Large buckets are several files, small ones one. `dealt` rows come by key already,
        so they are written where they are."""
        folder = f"data/{uuid.uuid4().hex}"
        placed = rows.withColumn(BUCKET, self.bucket(table))
        placed = placed if dealt else placed.hint("rebalance", BUCKET)
        placed.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(folder)) if f.isDirectory()]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith(BUCKET)}

    def replaced(self, name: str, rows: DataFrame, key: list[str], dealt: bool = False) -> tuple[str, dict]:
        """A change for commit: the table is these rows."""
        table = {"schema": json.loads(rows.schema.json()), "key": key, "n": self.buckets}
        return name, table | {"buckets": self._written(rows, table, dealt)}

    def upserted(self, name: str, rows: DataFrame | None, keys: DataFrame, version: int | None = None, dealt: bool = False) -> tuple[str, dict]:
        """A change for commit: the rows with one of `keys` (the table's key columns) go, and `rows` come.

        The new rows are computed whole before any old one goes: they are files by then. `dealt` rows come by key
        already and have no key that `keys` lacks, so they are computed once.
        """
        table = self.manifest(version)["tables"][name]
        keys = keys.select(*table["key"]).distinct()
        every = keys if rows is None or dealt else keys.unionByName(rows.select(*table["key"])).distinct()
        touched = [r[0] for r in every.select(self.bucket(table)).distinct().collect()]  # table["n"] numbers at most
        old = self.read(name, version, touched)
        same = [old[k].eqNullSafe(keys[k]) for k in table["key"]]
        left = old.join(keys, same, "left_anti")
        new = left if rows is None else left.unionByName(rows.select(*left.columns))
        kept = {b: folder for b, folder in table["buckets"].items() if int(b) not in touched}
        return name, table | {"buckets": kept | self._written(new, table, dealt)}

    def commit(self, changes: Iterable[tuple[str, dict]], based_on: int, drop: Iterable[str] = ()) -> int:
        """Makes all changes at once, on top of the version they were computed from. Conflict if that is not the newest."""
        tables = self.manifest(based_on)["tables"] | dict(changes)
        for name in drop:
            tables.pop(name, None)
        version = based_on + 1
        if self.version() != based_on:
            raise Conflict(f"version {version} of {self.path} was committed by another writer")
        self._fs.mkdirs(self._at("_versions"))
        draft, final = self._at(f"_versions/.{uuid.uuid4().hex}"), self._at(f"_versions/v{version:08d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"based_on": based_on, "tables": tables}).encode()))
        out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = rename
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, final, options)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise Conflict(f"version {version} of {self.path} was committed by another writer") from e
            raise
        return version

    def clean(self, keep: int = 1) -> int:
        """Deletes all but the newest `keep` manifests and every folder that none of these names. Not while a writer is at
        work: what it has not committed yet would go too. How many folders went."""
        kept = self.versions()[-keep:]
        used = {folder for v in kept for t in self.manifest(v)["tables"].values() for folder in t["buckets"].values()}
        for v in self.versions():
            if v not in kept:
                self._fs.delete(self._at(f"_versions/v{v:08d}.json"), False)
        gone = 0
        if self._fs.exists(self._at("data")):
            for folder in self._fs.listStatus(self._at("data")):
                name = f"data/{folder.getPath().getName()}"
                parts = [f"{name}/{p.getPath().getName()}" for p in self._fs.listStatus(folder.getPath()) if p.isDirectory()]
                for part in parts:
                    if part not in used:
                        self._fs.delete(self._at(part), True)
                        gone += 1
                if not any(part in used for part in parts):
                    self._fs.delete(folder.getPath(), True)
        return gone


def write_all(store: Store, tables: Mapping[str, tuple[DataFrame, list[str]]]) -> int:
    """All tables, with their keys, as one new version."""
    based_on = store.version()
    return store.commit([store.replaced(name, rows, key) for name, (rows, key) in tables.items()], based_on)
