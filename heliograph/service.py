"""The engine as one object: submit packages, merge cases, run analyses, read results with filters.

A workspace is a folder on shared storage.  Results are Parquet tables in it,
states are in the catalog, and every read is a DataFrame with the filters of
``operators.filters``.  Work is queued first and done by ``work``, so a caller
may return at once and a restarted process takes up what was left.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.lineage import keep
from heliograph.operators import attachments, case_merge, filters, gate, identity, recipients, threads, timing
from heliograph.sources import export, packages
from heliograph.sources.catalog import Catalog

#: Changes of state that are gathered into a snapshot before more work is done.
MOST_CHANGES = 200
ANALYSES = ("analysis", "identity_check", "attachment_flow", "recipient_flow")


class Refused(ValueError):
    """A request that cannot be queued."""


def package_name(name: str) -> str:
    """The last part of an uploaded file's name, whatever separators it came with."""
    return name.replace("\\", "/").rsplit("/", 1)[-1].strip() or "upload.zip"


class Workspace:
    def __init__(self, spark: SparkSession, folder: str, limits: packages.Limits = packages.Limits(), max_upload: int = 500 << 20):
        self.spark, self.folder, self.limits, self.max_upload = spark, folder.rstrip("/"), limits, max_upload
        self.catalog = Catalog(spark, f"{self.folder}/catalog")
        self._now: tuple[str, str, dict] = ("job", "", {})

    # ------------------------------------------------------------------ requests

    def submit(self, content: bytes, name: str = "upload.zip", idempotency_key: str | None = None) -> str:
        """Queue a package; the same key with the same bytes gives the earlier job."""
        if len(content) > self.max_upload:
            raise Refused("upload_too_large")
        token = hashlib.sha256(content).hexdigest()
        key = self.catalog.admit("job", str(uuid.uuid4()), idempotency_key, token)
        if not self.catalog.history().where((F.col("kind") == "job") & (F.col("key") == key) & F.col("target").isNotNull()).limit(1).count():
            # each caller writes a copy of its own; the bytes are the same, and the newest state names one of them
            path = f"{self.folder}/upload/{key}-{uuid.uuid4().hex}"
            self.spark.createDataFrame([(package_name(name), bytearray(content))], "package string, content binary").write.parquet(path)
            self.catalog.set_state("job", key, "queued", target=package_name(name), detail=path)
        return key

    def create_case(self, jobs: list[str]) -> str:
        """Queue the merge of completed jobs, in the order given."""
        rows = {r["key"]: r["state"] for r in self.catalog.current("job").where(F.col("key").isin(jobs)).collect()}
        if not jobs:
            raise Refused("no_jobs")
        if unknown := [j for j in jobs if j not in rows]:
            raise Refused(f"unknown_jobs: {', '.join(unknown)}")
        listed = self.spark.createDataFrame([("case", j, rows[j]) for j in jobs], "case_id string, job_id string, status string")
        mails = None
        if all(rows[j] == "completed" for j in jobs):
            parts = [self._table("job", j, "forest").select(F.lit("case").alias("case_id"), "uid") for j in dict.fromkeys(jobs)]
            mails = parts[0]
            for part in parts[1:]:
                mails = mails.unionByName(part)
        if refused := case_merge.admit(listed, mails).collect():
            raise Refused(refused[0]["reason"])
        key = str(uuid.uuid4())
        self.catalog.set_state("case", key, "queued", target=",".join(jobs))
        return key

    def analyse(self, kind: str, target_kind: str, target: str, thresholds: dict | None = None) -> str:
        """Queue one of the four analyses over a job or a case."""
        filters.one_of("kind", kind, ANALYSES)
        filters.one_of("target", target_kind, ("job", "case"))
        limits = timing.thresholds(thresholds) if kind == "analysis" else {}
        reason, _ = self.catalog.target(target_kind, target)
        if reason:
            raise Refused(reason)
        key = str(uuid.uuid4())
        self.catalog.set_state(kind, key, "queued", target=f"{target_kind}:{target}", progress=",".join(f"{k}={v}" for k, v in limits.items()))
        return key

    def delete_job(self, key: str) -> None:
        self.catalog.set_state("job", key, "deleted")

    # ---------------------------------------------------------------------- work

    def work(self) -> int:
        """Do all that is queued or was left unfinished; gives the number of things done."""
        done = 0
        self.catalog.compact(MOST_CHANGES)
        doers: dict[str, Callable] = {"job": self._do_job, "case": self._do_case, **dict.fromkeys(ANALYSES, self._do_analysis)}
        for kind, do in doers.items():
            for row in self.catalog.unfinished(kind).orderBy("created_at").collect():
                if kind == "job" and row["target"] is None:
                    continue  # its bytes are still on the way
                more = {"target": row["target"], "progress": row["progress"]}
                self._now = (kind, row["key"], {"detail": row["detail"], **more})
                self.catalog.set_state(kind, row["key"], "processing", detail=row["detail"], **more)
                # jobs of Spark that run for it are found by its key
                self.spark.sparkContext.setJobGroup(row["key"], kind)
                try:
                    do(kind, row["key"], row["target"], row["progress"])
                    self.catalog.set_state(kind, row["key"], "completed", detail=f"{self.folder}/{kind}/{row['key']}", **more)
                except Refused as e:
                    self.catalog.set_state(kind, row["key"], "failed", error=str(e), **more)
                except Exception as e:
                    self.catalog.set_state(kind, row["key"], "failed", error=f"{type(e).__name__}: {str(e)[:500]}", **more)
                finally:
                    self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
                done += 1
        return done

    def _phase(self, name: str) -> None:
        """Say what is being done for the work at hand."""
        kind, key, more = self._now
        self.catalog.set_state(kind, key, "processing", phase=name, **more)

    def _save(self, kind: str, key: str, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{kind}/{key}/{name}")

    def _table(self, kind: str, key: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{kind}/{key}/{name}")

    def _do_job(self, kind: str, key: str, target: str, progress: str | None) -> None:
        self._phase("validating")
        named = self.catalog.history().where((F.col("kind") == "job") & (F.col("key") == key) & (F.col("state") == "queued") & F.col("detail").isNotNull())
        upload = self.spark.read.parquet(named.agg(F.max_by("detail", "at")).first()[0])
        entries = packages.scan(upload)
        broken = packages.violations(entries, self.limits).limit(1).collect()
        if broken:
            raise Refused(broken[0]["reason"])
        self._phase("parsing")
        mails = keep(packages.read_mails(upload, self.limits).withColumn("package", F.lit(key)).withColumnRenamed("package", "scope"), "mails")
        self._phase("threads")
        forest = threads.preorder(threads.build_forest(mails), [F.coalesce("date", F.lit("")), F.col("source_file")])
        self._phase("writing")
        self._save(kind, key, "forest", forest)
        listed = entries.where("entry_idx >= 0").select(F.lit(key).alias("scope"), "name", packages.is_mail(F.col("name")).alias("is_mail"))
        self._save(kind, key, "skipped", packages.skipped(entries))
        self._save(kind, key, "stats", threads.package_stats(self._table(kind, key, "forest"), listed))

    def _do_case(self, kind: str, key: str, target: str, progress: str | None) -> None:
        parts = None
        for pos, job in enumerate(target.split(",")):
            reason, _ = self.catalog.target("job", job)
            if reason:
                raise Refused(reason)
            inner = ["scope", "canonical_uid", "id_class", "parent_uid", "parent_ref", "chosen_pos", "missing_refs", "self_refs", "ambiguous_refs", "cycle_refs", "root_uid", "depth", "thread_pos", "entry_idx"]
            part = self._table("job", job, "forest").drop(*inner).withColumns({"case_id": F.lit(key), "job_pos": F.lit(pos), "job_id": F.lit(job)})
            parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
        self._phase("merging")
        nodes = case_merge.merge_case(parts).withColumnRenamed("case_id", "scope")
        self._phase("threads")
        nodes = threads.preorder(nodes, [F.coalesce("date", F.lit("")), F.col("sources")[0]["source_file"]])
        self._phase("writing")
        self._save(kind, key, "forest", nodes)
        saved = self._table(kind, key, "forest").withColumnRenamed("scope", "case_id")
        self._save(kind, key, "contributions", case_merge.contributions(saved, parts))
        self._save(kind, key, "stats", case_merge.case_stats(saved))

    def _do_analysis(self, kind: str, key: str, target: str, progress: str | None) -> None:
        target_kind, _, name = target.partition(":")
        reason, _ = self.catalog.target(target_kind, name)
        if reason:
            raise Refused(reason)
        mails = gate.with_roots(self._table(target_kind, name, "forest"))

        def save(table: str, df: DataFrame) -> None:
            self._phase(table)
            self._save(kind, key, table, df)

        load = lambda table: self._table(kind, key, table)
        if kind == "analysis":
            limits = {k: int(v) for k, v in (x.split("=") for x in progress.split(","))}
            save("findings", timing.findings(mails, limits=limits))
            save("timeline", timing.timeline(mails, load("findings")))
            save("stats", timing.stats(mails, load("findings")))
        elif kind == "identity_check":
            save("checked", identity.check_mails(identity.prepare(mails)))
            save("findings", identity.findings(load("checked")))
            save("flags", identity.review_flags(load("checked")))
            save("emails", identity.email_reports(load("checked")))
            save("threads", identity.thread_reports(load("checked"), load("findings")))
            save("stats", identity.stats(load("checked"), load("findings"), load("flags")))
        elif kind == "attachment_flow":
            save("prepared", attachments.prepare(mails))
            save("differences", attachments.differences(load("prepared")))
            save("events", attachments.events(load("differences")))
            save("reviews", attachments.reviews(load("prepared")))
            save("attachments", attachments.ledger(load("prepared")))
            save("emails", attachments.email_rows(load("prepared"), load("events"), load("reviews"), load("differences")))
            save("stats", attachments.stats(load("emails"), load("events"), load("reviews"), load("attachments")))
        else:
            save("prepared", recipients.prepare(mails))
            save("edges", recipients.edges(load("prepared")))
            save("events", recipients.events(load("edges")))
            save("reviews", recipients.reviews(load("prepared"), load("edges")))
            save("evidence", recipients.conflict_evidence(load("prepared")))
            save("variants", recipients.conflict_variants(load("prepared")))
            save("addresses", recipients.ledger(load("prepared")))
            save("emails", recipients.email_rows(load("prepared"), load("edges"), load("events"), load("reviews")))
            save("threads", recipients.thread_summaries(load("emails")))
            save("stats", recipients.stats(load("emails"), load("edges"), load("events"), load("reviews"), load("addresses")))

    # --------------------------------------------------------------------- reads

    def status(self, kind: str, key: str) -> dict | None:
        rows = self.catalog.current(kind).where(F.col("key") == key).limit(1).collect()
        return rows[0].asDict() if rows else None

    def running(self, key: str) -> dict[str, int]:
        """How far Spark is with the work of a key on this cluster: jobs, and tasks in all and done."""
        tracker = self.spark.sparkContext.statusTracker()
        jobs = [j for j in map(tracker.getJobInfo, tracker.getJobIdsForGroup(key)) if j]
        stages = [s for s in (tracker.getStageInfo(i) for j in jobs for i in j.stageIds) if s]
        return {"jobs": len(jobs), "tasks": sum(s.numTasks for s in stages), "tasks_done": sum(s.numCompletedTasks for s in stages)}

    def listing(self, kind: str) -> DataFrame:
        """The latest hundred."""
        return self.catalog.latest(kind)

    def result(self, kind: str, key: str, table: str) -> DataFrame:
        """A result table as it was saved."""
        reason, _ = self.catalog.target(kind, key)
        if reason:
            raise Refused(reason)
        return self._table(kind, key, table)

    def tree(self, kind: str, key: str, compact: bool = False, root: int | None = None) -> DataFrame:
        forest = self.result(kind, key, "forest")
        forest = forest if root is None else forest.where(F.col("root_uid") == root)
        if not compact:
            return export.public_rows(forest)
        return filters.compact_package_view(forest) if kind == "job" else filters.compact_case_view(forest.withColumnRenamed("scope", "case_id"))

    def tree_json(self, kind: str, key: str, root: int | None = None) -> str:
        """One thread, or one whole package or case, as nested JSON."""
        return export.forest_json(self.tree(kind, key, root=root))

    def export_tree(self, kind: str, key: str, folder: str) -> None:
        """A whole package or case as nested JSON in text files that follow one another."""
        export.write_forest_json(self.tree(kind, key), folder)

    def timeline(self, key: str, start: str | None = None, end: str | None = None, kind: str | None = None) -> DataFrame:
        return filters.filter_timeline(self.result("analysis", key, "timeline"), start, end, kind).orderBy(*timing.timeline_order())

    def identity_findings(self, key: str, kind: str | None = None, status: str | None = None, domain: str | None = None) -> DataFrame:
        return filters.filter_identity_findings(self.result("identity_check", key, "findings"), kind, status, domain)

    def identity_flags(self, key: str, domain: str | None = None) -> DataFrame:
        return filters.filter_identity_flags(self.result("identity_check", key, "flags"), domain)

    def identity_emails(self, key: str, kind: str | None = None, status: str | None = None, domain: str | None = None) -> DataFrame:
        return filters.filter_identity_emails(self.result("identity_check", key, "emails"), kind, status, domain)

    def identity_threads(self, key: str, kind: str | None = None, domain: str | None = None) -> DataFrame:
        return filters.filter_identity_threads(self.result("identity_check", key, "threads"), self.result("identity_check", key, "findings"), kind, domain)

    def attachment_events(self, key: str, kind: str | None = None, thread: int | None = None, filename: str | None = None, sha256: str | None = None) -> DataFrame:
        return filters.filter_attachment_events(self.result("attachment_flow", key, "events"), kind, thread, filename, sha256)

    def attachment_reviews(self, key: str, kind: str | None = None, thread: int | None = None, filename: str | None = None) -> DataFrame:
        return filters.filter_attachment_reviews(self.result("attachment_flow", key, "reviews"), kind, thread, filename)

    def attachment_ledger(self, key: str, sha256: str | None = None, filename: str | None = None) -> DataFrame:
        return filters.filter_attachment_ledger(self.result("attachment_flow", key, "attachments"), sha256, filename)

    def recipient_events(self, key: str, kind: str | None = None, thread: int | None = None, address: str | None = None) -> DataFrame:
        return filters.filter_recipient_events(self.result("recipient_flow", key, "events"), kind, thread, address)

    def recipient_reviews(self, key: str, kind: str | None = None, thread: int | None = None, address: str | None = None) -> DataFrame:
        return filters.filter_recipient_reviews(self.result("recipient_flow", key, "reviews"), self.result("recipient_flow", key, "prepared"), kind, thread, address)

    def recipient_evidence(self, key: str, uid: int | None = None) -> DataFrame:
        """Candidate parents beside the mails whose parent is missing or in conflict."""
        rows = self.result("recipient_flow", key, "evidence")
        return rows if uid is None else rows.where(F.col("uid") == uid)

    def recipient_variants(self, key: str, message_id: str | None = None) -> DataFrame:
        """Mails of other bytes that share an id."""
        rows = self.result("recipient_flow", key, "variants")
        return rows if message_id is None else rows.where(F.col("message_id") == message_id)

    def recipient_threads(self, key: str, thread: int | None = None, address: str | None = None) -> DataFrame:
        return filters.filter_recipient_threads(self.result("recipient_flow", key, "threads"), self.result("recipient_flow", key, "events"), thread, address)

    def recipient_addresses(self, key: str, address: str | None = None) -> DataFrame:
        return filters.filter_addresses(self.result("recipient_flow", key, "addresses"), address)


def upload(workspace: Workspace, path: str, idempotency_key: str | None = None) -> str:
    """Submit a local file."""
    with open(path, "rb") as f:
        return workspace.submit(f.read(), os.path.basename(path), idempotency_key)
