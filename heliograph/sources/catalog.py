"""Jobs, cases and analyses as an append-only log of states on shared storage.

A change of state is a new row; the newest row of a key is its state.  So
writers never overwrite one another, a run that died leaves its last state
behind, and unfinished work is found by a query.  Changes are small files, so
``compact`` gathers them into a snapshot from time to time: reads take the
newest snapshot and the changes since.  A snapshot appears by one rename.  What
it took up is deleted only with the next one, so a reader that still has the
snapshot before finds all that it lacks; a row that is read twice counts once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("job", "case", "analysis", "identity_check", "attachment_flow", "recipient_flow")
STATES = ("queued", "processing", "completed", "failed", "deleted")
LOG = "kind string, key string, state string, at timestamp, progress string, error string, target string, idempotency_key string, content_token string, detail string, phase string"


def create_or_read(spark: SparkSession, path: str, content: str) -> str:
    """Create a small file with this content unless it is there already; gives what the file holds.

    The content is written under another name first and then takes its name in
    one step that fails if the name is taken: a hard link on a local file
    system, a rename without overwriting on others.
    """
    part = f"{path}.{uuid.uuid4().hex}"
    if re.match(r"(file:)?/", path):
        path, part = (re.sub(r"^file:/+", "/", p) for p in (path, part))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part, "w", encoding="utf-8") as out:
            out.write(content)
        try:
            os.link(part, path)
        except FileExistsError:
            pass
        finally:
            os.unlink(part)
        with open(path, encoding="utf-8") as made:
            return made.read()
    jvm = spark._jvm
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(part)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(source, False)
    out.write(bytearray(content.encode()))
    out.close()
    if not store.rename(source, target):
        store.delete(source, False)
    return spark.read.text(path, wholetext=True).first()[0]


class Folder:
    """The few operations on a folder of a shared store that Spark's readers and writers do not have."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.path = root, spark._jvm.org.apache.hadoop.fs.Path
        self.store = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, below: str) -> list[str]:
        """Names in a folder, in order, without hidden ones; none if there is no such folder."""
        at = self.path(f"{self.root}/{below}")
        found = self.store.listStatus(at) if self.store.exists(at) else []
        return sorted(n for n in (f.getPath().getName() for f in found) if n[0] not in "._")

    def complete(self, name: str) -> bool:
        """Whether the table in a folder was written to its end."""
        return self.store.exists(self.path(f"{self.root}/{name}/_SUCCESS"))

    def rename(self, name: str, to: str) -> bool:
        """Whether it got the new name; not if there is one already."""
        target = self.path(f"{self.root}/{to}")
        return not self.store.exists(target) and self.store.rename(self.path(f"{self.root}/{name}"), target)

    def delete(self, name: str) -> None:
        self.store.delete(self.path(f"{self.root}/{name}"), True)


class Conflict(ValueError):
    """An idempotency key that was used for other content."""


class Catalog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.files = Folder(spark, folder)
        self.log(0)

    def log(self, rows: int | list[dict]) -> None:
        given = [] if isinstance(rows, int) else [tuple(r.get(c.split()[0]) for c in LOG.split(", ")) for r in rows]
        # a folder for each change: writers of one folder would clear each other's temporary files
        self.spark.createDataFrame(given, LOG).coalesce(1).write.parquet(f"{self.folder}/changes/{uuid.uuid4().hex}")

    def history(self) -> DataFrame:
        snapshots = self.files.names("snapshots")[-1:]
        paths = [f"{self.folder}/changes", *(f"{self.folder}/snapshots/{n}/states" for n in snapshots)]
        return self.spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(*paths).dropDuplicates()

    def compact(self, least: int = 1) -> bool:
        """Gather the changes into a new snapshot if there are at least ``least``; gives whether there is a new one."""
        snapshots = self.files.names("snapshots")
        changes = [c for c in self.files.names("changes") if self.files.complete(f"changes/{c}")]  # others are still being written
        taken = set()
        if snapshots:
            taken = {r["name"] for r in self.spark.read.schema("name string").parquet(f"{self.folder}/snapshots/{snapshots[-1]}/taken").collect()}
        if len(set(changes) - taken) < least:
            return False
        part, name = f".{uuid.uuid4().hex}", f"{int(snapshots[-1]) + 1 if snapshots else 0:012d}"
        rows = self.spark.read.schema(LOG).parquet(*(f"{self.folder}/changes/{c}" for c in changes))
        if snapshots:
            rows = rows.unionByName(self.spark.read.schema(LOG).parquet(f"{self.folder}/snapshots/{snapshots[-1]}/states"))
        rows.dropDuplicates().coalesce(1).write.parquet(f"{self.folder}/snapshots/{part}/states")
        self.spark.createDataFrame([(c,) for c in changes], "name string").coalesce(1).write.parquet(f"{self.folder}/snapshots/{part}/taken")
        if not self.files.rename(f"snapshots/{part}", f"snapshots/{name}"):
            self.files.delete(f"snapshots/{part}")  # another caller was faster
            return False
        for old in taken & set(changes):
            self.files.delete(f"changes/{old}")
        for old in snapshots[:-1]:
            self.files.delete(f"snapshots/{old}")
        return True

    def current(self, kind: str | None = None) -> DataFrame:
        """The newest state of every key that is not deleted, with the time it was created."""
        by_key = Window.partitionBy("kind", "key")
        rows = self.history().withColumn("created_at", F.min("at").over(by_key)).withColumn("__n", F.row_number().over(by_key.orderBy(F.desc("at"), F.desc(F.expr(f"array_position({_sql_array(STATES)}, state)")))))
        rows = rows.where("__n = 1 AND state <> 'deleted'").drop("__n")
        return rows if kind is None else rows.where(F.col("kind") == kind)

    def latest(self, kind: str, limit: int = 100) -> DataFrame:
        return self.current(kind).orderBy(F.desc("created_at"), F.desc("key")).limit(limit)

    def set_state(self, kind: str, key: str, state: str, **more: str | None) -> None:
        if kind not in KINDS or state not in STATES:
            raise ValueError("unknown kind or state")
        self.log([{"kind": kind, "key": key, "state": state, "at": datetime.now(UTC).replace(tzinfo=None), **more}])

    def admit(self, kind: str, key: str, idempotency_key: str | None, content_token: str) -> str:
        """Queue new work and give its key; the same idempotency key and content give the earlier key.

        The idempotency key is a file that only one caller can create, so of
        any number of callers at once one queues the work and the others get
        its key.  A caller that died in between leaves the file without a state;
        the next one with the same key then queues that work.
        """
        if idempotency_key is not None:
            if not re.fullmatch(r"[A-Za-z0-9._:-]{1,200}", idempotency_key):
                raise ValueError("malformed idempotency key")
            name = hashlib.sha256(f"{kind}:{idempotency_key}".encode()).hexdigest()
            claimed = json.loads(create_or_read(self.spark, f"{self.folder}-keys/{name}.json", json.dumps({"key": key, "token": content_token})))
            if claimed["token"] != content_token:
                raise Conflict(idempotency_key)
            if claimed["key"] != key:
                key = claimed["key"]
                if self.history().where((F.col("kind") == kind) & (F.col("key") == key)).limit(1).count():
                    return key
        self.set_state(kind, key, "queued", idempotency_key=idempotency_key, content_token=content_token)
        return key

    def unfinished(self, kind: str | None = None) -> DataFrame:
        """What a restart must take up again."""
        return self.current(kind).where("state IN ('queued', 'processing')")

    def target(self, kind: str, key: str) -> tuple[str | None, str | None]:
        """(reason why a target cannot be analysed, None) or (None, where its result is)."""
        found = self.current(kind).where(F.col("key") == key).limit(1).collect()
        if not found:
            return "target_deleted_or_unknown", None
        if found[0]["state"] != "completed":
            return f"target_{found[0]['state']}", None
        if not found[0]["detail"]:
            return "target_without_result", None
        return None, found[0]["detail"]


def _sql_array(values: tuple[str, ...]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"
