"""A table of encrypted objects with revisions: an append-only log of commits over immutable parts.

A commit first writes its rows as a new part, then the log's next entry.  Entries are made whole or not at all, and no
entry is ever replaced: it is written aside and renamed to its number, which fails if the number is taken.  A writer that
comes second reads what was committed before it: if that touched its own object there is a conflict, else it takes
the next number.  Readers see the log up to one number, so what they read does not change under them; parts without an entry
are seen by no one.

An object has a kind, an id and a revision, 1 at first.  Its rows are sealed with all three as context, so rows of an
older revision do not open as those of a newer one.  Tables that are not there are empty.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offersieve.plans.digests import table_digest
from offersieve.schema import SCHEMA_VERSION
from offersieve.sources.vault import seal, unseal

_LOG = "version long, changes array<struct<op: string, kind: string, id: string, revision: long, part: string>>"
_ROWS = "kind string, id string, revision long, data binary, part string"
BACKUP_KIND, BACKUP_FORMAT = "offersieve-objects", 1


class Conflict(RuntimeError):
    """Someone else changed the object, or made one of that id, in the meantime."""


@dataclass(frozen=True)
class Change:
    op: str  # put or drop
    kind: str
    id: str
    revision: int
    part: str | None = None


def _context() -> Column:
    return F.concat_ws("|", "kind", "id", F.col("revision").cast("string"), F.lit(SCHEMA_VERSION))


class ObjectTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # ------------------------------------------------------------ files
    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        path, fs = self._file(name)
        return fs.exists(path)

    def _create(self, name: str, text: str) -> bool:
        """A file with this text, unless there is one of that name."""
        aside, fs = self._file(f"log/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        path, _ = self._file(name)
        try:
            if fs.getScheme() == "file":  # renaming replaces files there, links don't
                local = lambda p: unquote(urlparse(p.toUri().toString()).path)
                try:
                    os.link(local(aside), local(path))
                    return True
                except FileExistsError:
                    return False
            jvm = self.spark._jvm.org.apache.hadoop.fs
            how = self.spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
            how[0] = getattr(jvm, "Options$Rename").NONE
            jvm.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, path, how)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            fs.delete(aside, False)

    # ------------------------------------------------------------ the log
    def _log(self, version: int | None) -> DataFrame:
        log = self.spark.read.schema(_LOG).json(f"{self.path}/log") if self._there("log") else self.spark.createDataFrame([], _LOG)
        return log if version is None else log.where(F.col("version") <= version)

    def version(self) -> int:
        """The number of the last commit; 0 for none."""
        return self._log(None).agg(F.max("version")).first()[0] or 0

    def history(self) -> DataFrame:
        """(version, op, kind, id, revision) of every change."""
        return self._log(None).select("version", F.inline("changes")).drop("part")

    def snapshot(self, version: int | None = None) -> DataFrame:
        """(kind, id, revision, version, part) of the objects that were there after a commit, or are there now."""
        changes = self._log(version).select("version", F.inline("changes"))
        last = changes.groupBy("kind", "id").agg(F.max_by(F.struct("op", "revision", "version", "part"), "version").alias("c"))
        return last.where("c.op = 'put'").select("kind", "id", "c.revision", "c.version", "c.part")

    def _revision(self, kind: str, object_id: str) -> int:
        """The object's revision now; 0 if there is none, and minus the last one if it was dropped."""
        own = self.history().where((F.col("kind") == kind) & (F.col("id") == object_id))
        last = own.agg(F.max_by(F.struct("op", "revision"), "version")).first()[0]
        return 0 if last is None else last["revision"] if last["op"] == "put" else -last["revision"]

    def _commit(self, change: Change, expected: int) -> int:
        while True:
            version = self.version() + 1
            if self._revision(change.kind, change.id) != expected:
                raise Conflict(f"{change.kind} {change.id} is not at revision {expected} any more")
            entry = {"version": version, "changes": [change.__dict__]}
            if self._create(f"log/{version:020d}.json", json.dumps(entry) + "\n"):
                return version

    # ------------------------------------------------------------ objects
    def put(self, kind: str, records: DataFrame, key: bytes, object_id: str | None = None, revision: int = 0) -> tuple[str, int]:
        """Store records as an object, (id, revision) of it.

        Revision 0 makes a new object and conflicts with one of that id; another one must be that of the object now.
        """
        object_id = object_id or uuid.uuid4().hex
        now = self._revision(kind, object_id)
        if now != revision and not (revision == 0 and now < 0):
            raise Conflict(f"{kind} {object_id} is at revision {now}, not {revision}")
        part = uuid.uuid4().hex
        rows = records.select(F.lit(kind).alias("kind"), F.lit(object_id).alias("id"), F.lit(abs(now) + 1).cast("long").alias("revision"), F.to_json(F.struct("*")).alias("_json"))
        rows.select("kind", "id", "revision", seal(F.col("_json"), key, _context()).alias("data")).write.parquet(f"{self.path}/data/part={part}")
        self._file("log")[1].mkdirs(self._file("log")[0])
        self._commit(Change("put", kind, object_id, abs(now) + 1, part), now)
        return object_id, abs(now) + 1

    def drop(self, kind: str, object_id: str, revision: int) -> int:
        """Take an object away; the number of the commit. Earlier snapshots still have it."""
        return self._commit(Change("drop", kind, object_id, revision), revision)

    def rows(self, kind: str | None = None, object_id: str | None = None, version: int | None = None) -> DataFrame:
        """The sealed rows of a snapshot's objects."""
        live = self.snapshot(version)
        if kind is not None:
            live = live.where(F.col("kind") == kind)
        if object_id is not None:
            live = live.where(F.col("id") == object_id)
        if not self._there("data"):
            return self.spark.createDataFrame([], _ROWS)
        return self.spark.read.schema(_ROWS).parquet(f"{self.path}/data").join(live.drop("version"), ["kind", "id", "revision", "part"], "left_semi")

    def load(self, kind: str, key: bytes, schema: str, object_id: str | None = None, version: int | None = None) -> DataFrame:
        """(id, revision and the records' columns) of one kind; rows that don't open are left out."""
        opened = self.rows(kind, object_id, version).withColumn("_json", unseal(F.col("data"), key, _context())).where("_json is not null")
        return opened.select("id", "revision", F.from_json("_json", schema).alias("r")).select("id", "revision", "r.*")

    # ------------------------------------------------------------ backups
    def backup(self, target: str, created_at: str, secrets: tuple[str, ...] = ("secret",)) -> dict:
        """All objects but secrets, still sealed, with a manifest that `check_backup` reads."""
        rows = self.rows().where(~F.col("kind").isin(*secrets)).drop("part")
        rows.write.parquet(f"{target}/rows")
        kept = self.spark.read.parquet(f"{target}/rows")
        manifest = {
            "kind": BACKUP_KIND, "formatVersion": BACKUP_FORMAT, "createdAt": created_at, "schemaVersion": SCHEMA_VERSION, "includesSecrets": False,
            "objects": kept.select("kind", "id").distinct().count(), "digest": table_digest(kept.withColumn("data", F.hex("data"))),
        }
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{target}/manifest")
        return manifest

    def restore(self, source: str) -> int:
        """Put a backup's objects that are not there now; how many. Their revisions stay, as they are sealed with them."""
        manifest, problem = check_backup(self.spark, source)
        if problem:
            raise ValueError(problem)
        kept = self.spark.read.parquet(f"{source}/rows")
        wanted = kept.select("kind", "id", "revision").distinct().join(self.snapshot().select("kind", "id"), ["kind", "id"], "left_anti").collect()  # objects, not rows
        if wanted:
            part = uuid.uuid4().hex
            kept.join(self.snapshot().select("kind", "id"), ["kind", "id"], "left_anti").select("kind", "id", "revision", "data").write.parquet(f"{self.path}/data/part={part}")
            self._file("log")[1].mkdirs(self._file("log")[0])
            for r in wanted:
                self._commit(Change("put", r.kind, r.id, r.revision, part), self._revision(r.kind, r.id))
        return len(wanted)


def check_backup(spark: SparkSession, source: str) -> tuple[dict | None, str | None]:
    """(manifest, None) of a sound backup, or (None, what is wrong with it). Nothing is opened for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{source}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None, "no manifest"
    try:
        manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{source}/manifest").limit(2).collect()))
    except ValueError:
        return None, "the manifest is no JSON"
    if not isinstance(manifest, dict) or manifest.get("kind") != BACKUP_KIND:
        return None, "not a backup of objects"
    if manifest.get("formatVersion") != BACKUP_FORMAT:
        return None, "another format"
    if not all(isinstance(manifest.get(k), str) and manifest[k] for k in ("createdAt", "schemaVersion", "digest")):
        return None, "the manifest is not complete"
    if manifest["schemaVersion"].split(".")[0] != SCHEMA_VERSION.split(".")[0]:
        return None, "another schema version"
    if manifest.get("includesSecrets") is not False:
        return None, "a backup with secrets"
    rows = spark.read.schema("kind string, id string, revision long, data binary").parquet(f"{source}/rows")
    if table_digest(rows.withColumn("data", F.hex("data"))) != manifest["digest"]:
        return None, "rows are not those of the manifest"
    return manifest, None
