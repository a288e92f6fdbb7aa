"""A catalog of tables as lists of immutable Parquet parts.

Every write puts its rows in new directories and then makes them visible with
one commit: a small numbered file that lists the parts of all tables. A commit
file is written under another name and renamed to the next number, which fails
if that number is taken; the highest number is the state. So a reader sees the
state before a write or the one after it, also of several tables at once, and a
writer that dies before its commit leaves nothing but unlisted directories.
Appending adds a part and rewrites nothing; a table of very many parts is
merged into one as it is appended to.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import listing
from weftline.operators.numbering import with_ids
from weftline.schema import LINKS, OWNED, TABLES, empty, migrate
from weftline.session import stage

#: Parts of a table from which appending merges them.
MANY_PARTS = 64
#: Commits that are kept for readers that have begun with them.
KEPT_COMMITS = 20


class StoreExists(ValueError):
    pass


class StoreNotFound(KeyError):
    pass


class DimensionMismatch(ValueError):
    pass


class InvalidCapsule(ValueError):
    """A capsule that fails its checks; the message names it and the first check."""


class ConcurrentWrite(RuntimeError):
    """A table that was to be replaced has been changed by another writer meanwhile."""


def data_dir(spark: SparkSession) -> str:
    """Where tables lie: the session's setting, else the environment, else the user's data directory."""
    return spark.conf.get("spark.weftline.data.dir", None) or os.environ.get("WEFTLINE_DATA_DIR") or os.path.join(os.path.expanduser("~"), ".local", "share", "weftline")


class Catalog:
    """Tables of one root directory. The root may be any file system that Hadoop reads and that renames atomically."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or data_dir(spark)
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path

    def _fs(self):
        return self._fs_path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs().exists(self._fs_path(path))

    def _commits(self) -> list[int]:
        fs, at = self._fs(), self._fs_path(f"{self.root}/_commits")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read_commit(self, number: int) -> dict[str, list[str]]:
        stream = self._fs().open(self._fs_path(f"{self.root}/_commits/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def state(self) -> tuple[int, dict[str, list[str]]]:
        """The number of the last commit and the parts of each table in it."""
        numbers = self._commits()
        return (numbers[-1], self._read_commit(numbers[-1])) if numbers else (0, {})

    def version(self, name: str) -> str | None:
        """What the table consists of now, or None if it was never written."""
        parts = self.state()[1].get(name)
        return None if parts is None else ",".join(parts)

    def read(self, name: str) -> DataFrame:
        """The table, empty if it was never written, with columns it lacks as nulls."""
        parts = self.state()[1].get(name)
        return empty(self.spark, name) if not parts else self._parts(name, parts)

    def _parts(self, name: str, parts: list[str]) -> DataFrame:
        return migrate(self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.root}/{p}" for p in parts)), name)

    def _put(self, name: str, df: DataFrame) -> str:
        at = f"{name}-{uuid.uuid4().hex}"
        migrate(df, name).write.parquet(f"{self.root}/{at}")
        return at

    def _claim(self, number: int, tables: dict[str, list[str]]) -> bool:
        """Whether the state became this commit; False if another writer took the number."""
        jvm = self.spark._jvm
        hadoop = jvm.org.apache.hadoop.fs
        fs = self._fs()
        fresh, final = self._fs_path(f"{self.root}/_commits/.{uuid.uuid4().hex}.tmp"), self._fs_path(f"{self.root}/_commits/{number:012d}.json")
        stream = fs.create(fresh, False)
        stream.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
        stream.close()
        context = hadoop.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(fresh), fs.makeQualified(final), self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
        except Py4JJavaError as err:
            fs.delete(fresh, False)
            if "FileAlreadyExists" in str(err.java_exception):
                return False
            raise
        return True

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, since: int | None = None) -> int:
        """Replace and append to tables, all at once; returns the commit's number.

        A replaced table must be as it was at commit `since`, by default as now.
        """
        replace, append = replace or {}, append or {}
        number, base = self.state()
        seen = base if since is None or since == number else self._read_commit(since) if since else {}
        merge = [n for n in append if n not in replace and len(base.get(n, [])) >= MANY_PARTS]
        expected = {**{n: seen.get(n) for n in replace}, **{n: base.get(n) for n in merge}}
        fresh = {n: [self._put(n, df)] for n, df in {**{n: self._parts(n, base[n]) for n in merge}, **replace}.items()}
        added = {n: self._put(n, df) for n, df in append.items()}
        while True:
            if changed := [n for n, parts in expected.items() if base.get(n) != parts]:
                raise ConcurrentWrite(", ".join(changed))
            tables = {**base, **fresh}
            for name, part in added.items():
                tables[name] = [*tables.get(name, []), part]
            if self._claim(number + 1, tables):
                return number + 1
            number, base = self.state()

    def write(self, name: str, df: DataFrame) -> None:
        """Replace the table."""
        self.commit(replace={name: df})

    def append(self, name: str, df: DataFrame) -> None:
        self.commit(append={name: df})

    def vacuum(self, keep: int = KEPT_COMMITS) -> int:
        """Delete old commits and the parts that none of the last `keep` lists; returns how many parts went.

        Not to be run while another process writes, whose parts no commit lists yet.
        """
        numbers = self._commits()
        kept = numbers[-keep:]
        used = {p for n in kept for parts in self._read_commit(n).values() for p in parts}
        fs, gone = self._fs(), 0
        for number in numbers[:-keep]:
            fs.delete(self._fs_path(f"{self.root}/_commits/{number:012d}.json"), False)
        for status in fs.listStatus(self._fs_path(self.root)):
            name = status.getPath().getName()
            if status.isDirectory() and name.rpartition("-")[0] in TABLES and name not in used:
                fs.delete(status.getPath(), True)
                gone += 1
        return gone

    # stores

    def list_stores(self) -> DataFrame:
        return listing.list_stores(self.read("stores"))

    def get_store(self, name: str) -> dict:
        found = self.read("stores").where(F.col("name") == name).limit(1).collect()
        if not found:
            raise StoreNotFound(name)
        return found[0].asDict()

    def create_store(self, name: str, dim: int = 1536, created_at=None) -> None:
        if not self.read("stores").where(F.col("name") == name).isEmpty():
            raise StoreExists(name)
        self.append("stores", self.spark.createDataFrame([(name, dim, created_at)], TABLES["stores"]))

    def delete_store(self, name: str) -> None:
        """Drop a store with all that belongs to it; links follow what they point to."""
        self.get_store(name)
        since = self.state()[0]
        self.commit(replace=delete_store({t: self.read(t) for t in ["stores", *OWNED, *LINKS]}, name), since=since)

    # rows

    def fresh_chunks(self, store: str, rows: DataFrame) -> DataFrame:
        """Chunks (content, source?, metadata?, seq) with the ids they will have, not yet added."""
        self.get_store(store)
        columns = [(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in ("content", "source", "metadata")]
        return with_ids(rows.select(*columns, "seq").withColumn("store", F.lit(store)), self.read("chunks"), "seq")

    def add_chunks(self, store: str, rows: DataFrame) -> DataFrame:
        """Append chunks (content, source?, metadata?, seq) and return them with their ids."""
        fresh = self.fresh_chunks(store, rows)
        self.append("chunks", fresh)
        return fresh

    def check_dims(self, key: str, rows: DataFrame, dim: int) -> None:
        bad = rows.where(F.size("embedding") != dim).limit(1).collect()
        if bad:
            raise DimensionMismatch(f"{key} {bad[0][key]}: expected {dim}")

    def set_embeddings(self, table: str, key: str, rows: DataFrame, dim: int) -> None:
        """Insert or replace vectors by key; all must have the given dimension.

        Vectors of new keys are appended; only if some key has a vector already is the table written anew.
        """
        self.check_dims(key, rows, dim)
        since, old, new = self.state()[0], self.read(table), migrate(rows, table)
        if old.join(new.select(key), key, "left_semi").isEmpty():
            self.append(table, new.dropDuplicates([key]))
        else:
            self.commit(replace={table: upsert(old, new, [key])}, since=since)

    # capsules

    def put_capsules(self, capsules: DataFrame) -> DataFrame:
        """Check and keep capsules; returns their references. One that is kept already is not kept again."""
        from weftline.operators.capsules import capsule_error, capsule_references, put_capsules

        faults = capsules.select("capsule_id", capsule_error().alias("error")).where("error is not null").limit(1).collect()
        if faults:
            raise InvalidCapsule(f"{faults[0]['capsule_id']}: {faults[0]['error']}")
        since, old = self.state()[0], self.read("capsules")
        references = stage(capsule_references(capsules))
        keys = ["capsule_id", "content_fingerprint"]
        new = put_capsules(old.limit(0), with_ids(references.drop("uri"), old, "capsule_id").select(*old.columns)).join(old.select(*keys), keys, "left_anti").select(*old.columns)
        new = stage(new)
        if not new.isEmpty():
            self.commit(append={"capsules": new}, since=since)
        return references.drop("body")

    def capsule_body(self, capsule_id: str, fingerprint: str | None = None) -> str | None:
        """The newest body of a capsule, or that with a fingerprint; checked against its fingerprint. None if there is none."""
        from weftline.operators.capsules import verified_capsules

        rows = verified_capsules(self.read("capsules").where(F.col("capsule_id") == capsule_id))
        if fingerprint is not None:
            rows = rows.where(F.col("content_fingerprint") == fingerprint)
        found = rows.orderBy(F.desc("id")).limit(1).collect()
        return found[0]["body"] if found else None

    def capsule_history(self, capsule_id: str) -> DataFrame:
        """All references of a capsule, newest first."""
        from weftline.operators.aggregates import history

        return history(self.read("capsules"), "capsule_id", capsule_id).drop("body")

    def list_capsules(self, project: str | None = None) -> DataFrame:
        """The newest reference of each capsule, of one project or of all."""
        from weftline.operators.capsules import latest_capsules

        return latest_capsules(self.read("capsules"), project).drop("body").orderBy("capsule_id")

    def info(self) -> dict:
        """The root, the commit and the number of parts of each table."""
        number, tables = self.state()
        return {"root": self.root, "commit": number, "tables": {t: len(tables.get(t, [])) for t in TABLES}}


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put in by key; keys of new are unique or the caller does not mind which holds."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys))


def delete_store(tables: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """The tables without a store: its own rows go, and links whose ends are gone follow."""
    out = {"stores": tables["stores"].where(F.col("name") != name)}
    for t in OWNED:
        if t in tables:
            out[t] = tables[t].where(F.col("store") != name)
    for t, ends in LINKS.items():
        if t in tables:
            kept = tables[t]
            for column, of in ends:
                gone = tables[of].where(F.col("store") == name).select(F.col("id").alias(column))
                kept = kept.join(gone, column, "left_anti")
            out[t] = kept
    return out
