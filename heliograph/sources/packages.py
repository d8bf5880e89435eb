"""Packages: ZIP archives of mails, scanned and parsed without ever being unpacked to disk.

``scan`` lists the entries of every package with what the archive says about
them; ``violations`` holds the rules as plain predicates over that list, so
that they can be read, tested and pushed around like any query; ``read_mails``
parses the mails of the packages that broke none.

Packages are named by path, and a task reads of a file only what it needs: the
directory of entries for ``scan``, a run of entries for ``read_mails``, so that
a large package is read by many tasks.  A column ``content`` may hold the bytes
instead; then a package is read by one task.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.lineage import keep
from heliograph.sources.mime import PARSED, parse_mail, values_of_headers


@dataclass(frozen=True)
class Limits:
    entries: int = 10_000
    entry_bytes: int = 100 << 20
    total_bytes: int = 1 << 30
    ratio: int = 200


#: Declared bytes of the mails that a task reads of one package, and tasks at most.
PART_BYTES = 64 << 20
MOST_TASKS = 20_000
#: Mails and declared bytes of small packages that a task reads, about.
TASK_MAILS, TASK_BYTES = 2_000, 16 << 20
#: Bytes or mails that the reader gathers before it hands them to Spark.
_BATCH_BYTES, _BATCH_MAILS = 16 << 20, 200
_SMALL = 1 << 16

ENTRIES = "package string, entry_idx int, name string, size bigint, compressed bigint, mode int, encrypted boolean, is_dir boolean, error string"


def load(spark: SparkSession, path: str) -> DataFrame:
    """(package, length) of all archives under a path or glob; their bytes are left where they are."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select(F.col("path").alias("package"), "length")


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path in it."""
    scheme, mark, rest = path.partition(":/")
    if not mark or scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if mark else path
    return fs.FileSystem.from_uri(quote(path, safe=":/@?=&%+,;~"))


def _stream(package: str, content: bytes | None) -> BinaryIO:
    """The bytes of a package as a file in which one can seek: the given ones, else those at its path."""
    if content is not None:
        return io.BytesIO(content)
    store, path = store_of(package)
    file = store.open_input_file(path)
    # before the start of a small file the reader of archives seeks in vain, and takes Arrow's error for a broken archive
    return file if file.size() > _SMALL else io.BytesIO(file.read())


def _source(packages: DataFrame) -> DataFrame:
    return packages.select("package", *(["content"] if "content" in packages.columns else [F.lit(None).cast("binary").alias("content")]))


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in ENTRIES.split(", ")]
    for batch in batches:
        for package, content in zip(batch["package"], batch["content"], strict=True):
            try:
                with _stream(package, content) as file, zipfile.ZipFile(file) as archive:
                    infos = archive.infolist()
            except (zipfile.BadZipFile, zipfile.LargeZipFile, NotImplementedError, ValueError, struct.error):
                yield pd.DataFrame([(package, -1, None, None, None, None, None, None, "not_a_zip")], columns=columns)
                continue
            rows = [(package, i, x.filename, x.file_size, x.compress_size, x.external_attr >> 16, bool(x.flag_bits & 1), x.is_dir(), None) for i, x in enumerate(infos)]
            yield pd.DataFrame(rows or [(package, -1, None, None, None, None, None, None, None)], columns=columns)


def scan(packages: DataFrame) -> DataFrame:
    """Entries of each package in archive order; an unreadable or empty package is one row with index -1."""
    return _source(packages).mapInPandas(_entries, ENTRIES)


def safe_name(name: Column) -> Column:
    """Whether a member name stays inside its folder on any system.

    No blank name, back slash, drive or absolute path; after ``.`` and inner
    ``..`` are resolved nothing leads out; no segment ends in a dot or blank or
    is a device name.
    """
    kept = F.filter(F.split(name, "/"), lambda s: (s != "") & (s != "."))
    resolved = F.aggregate(
        kept,
        F.struct(F.array().cast("array<string>").alias("path"), F.lit(False).alias("out")),
        lambda acc, s: F.when(s != "..", F.struct(F.concat(acc["path"], F.array(s)).alias("path"), acc["out"].alias("out")))
        .when(F.size(acc["path"]) > 0, F.struct(F.slice(acc["path"], 1, F.size(acc["path"]) - 1).alias("path"), acc["out"].alias("out")))
        .otherwise(F.struct(acc["path"].alias("path"), F.lit(True).alias("out"))),
    )
    odd = F.exists(resolved["path"], lambda s: s.rlike(r"[. ]$") | s.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)"))
    return (F.trim(name) != "") & ~name.contains("\\") & ~name.rlike("^[a-zA-Z]:") & ~name.startswith("/") & ~resolved["out"] & (F.size(resolved["path"]) > 0) & ~odd


def special_mode(mode: Column) -> Column:
    """Whether the type bits name something else than a file or folder; without type bits it is a file."""
    kind = F.shiftrightunsigned(mode, 12).bitwiseAND(F.lit(15))
    return ~kind.isin(0, 4, 8)


def violations(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(package, entry_idx, reason): the first broken rule of each package that breaks any.

    The number of entries comes first, then the entries in order, each by the
    order of the rules below.  The running total is that of the entries so far.
    """
    order = Window.partitionBy("package").orderBy("entry_idx")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    named = Window.partitionBy("package", F.lower("name")).orderBy("entry_idx")
    e = entries.withColumn("__count", F.count_if(F.col("entry_idx") >= 0).over(Window.partitionBy("package"))).withColumn("__total", F.sum("size").over(so_far)).withColumn("__again", F.row_number().over(named) > 1)
    real = F.col("entry_idx") >= 0
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("__count") > limits.entries, "too_many_entries")
        .when(~real, None)
        .when(special_mode(F.col("mode")), "not_a_regular_file")
        .when(F.col("is_dir"), "directory")
        .when(F.col("encrypted"), "encrypted")
        .when(~safe_name(F.col("name")), "unsafe_name")
        .when(F.col("__again"), "duplicate_name")
        .when(F.col("size") < 0, "bad_size")
        .when(F.col("size") > limits.entry_bytes, "entry_too_large")
        .when(F.col("__total") > limits.total_bytes, "package_too_large")
        .when(F.floor(F.col("size") / F.greatest(F.col("compressed"), F.lit(1))) > limits.ratio, "compression_ratio")
    )
    found = e.withColumn("reason", reason).where("reason IS NOT NULL")
    first = F.min_by(F.struct("entry_idx", "reason"), "entry_idx")
    return found.groupBy("package").agg(first.alias("f")).select("package", "f.entry_idx", "f.reason")


def is_mail(name: Column) -> Column:
    return F.lower(name).endswith(".eml")


def skipped(entries: DataFrame) -> DataFrame:
    """Entries that are no mails."""
    return entries.where("entry_idx >= 0").where(~is_mail(F.col("name"))).select("package", "name", F.lit("not_eml").alias("reason"))


def read_capped(archive: zipfile.ZipFile, info: zipfile.ZipInfo, cap: int, chunk: int = 1 << 20) -> bytes:
    """Bytes of an entry, read in chunks and never beyond ``cap``; its size must be the declared one."""
    out = bytearray()
    with archive.open(info) as stream:
        while piece := stream.read(chunk):
            out += piece
            if len(out) > cap:
                raise ValueError("entry_too_large")
    if len(out) != info.file_size:
        raise ValueError("size_differs")
    return bytes(out)


def _mails(limits: Limits):
    """Reads the mails of (package, content, entries, first_uid); null entries stand for all mails."""
    names = [f.name for f in T.StructType.fromDDL(_READ).fields]

    def read(package: str, content: bytes | None, wanted: list[int] | None, first: int) -> Iterator[tuple[dict, int]]:
        with _stream(package, content) as file, zipfile.ZipFile(file) as archive:
            infos = archive.infolist()
            if wanted is None:
                wanted = [i for i, x in enumerate(infos) if x.filename.lower().endswith(".eml")]
            for uid, i in enumerate(wanted, first):
                row = {"package": package, "entry_idx": i, "uid": uid, "error": None, "source_file": infos[i].filename}
                try:
                    # the rules hold for declared sizes, so an entry may not be larger than it says
                    raw = read_capped(archive, infos[i], min(limits.entry_bytes, infos[i].file_size))
                except (ValueError, EOFError, zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as e:
                    yield dict.fromkeys(names) | row | {"error": str(e) or type(e).__name__}, 0
                else:
                    yield row | parse_mail(raw, infos[i].filename), len(raw)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for package, content, entries, first in zip(batch["package"], batch["content"], batch["entries"], batch["first_uid"], strict=True):
                for row, size in read(package, content, None if entries is None else [int(i) for i in entries], int(first)):
                    rows.append(row)
                    held += size
                    if len(rows) >= _BATCH_MAILS or held >= _BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return run


def parts(entries: DataFrame, broken: DataFrame) -> DataFrame:
    """(package, content, entries, first_uid): the mails of the packages that are not broken, in runs of about ``PART_BYTES``.

    ``uid`` counts the mails of a package in archive order.  The windows and
    the gathered runs are over names and sizes, and a sound package has no more
    entries than its limit.
    """
    order = Window.partitionBy("package").orderBy("entry_idx")
    mails = entries.where("entry_idx >= 0").where(is_mail(F.col("name"))).join(broken.select("package"), "package", "left_anti")
    numbered = mails.withColumn("uid", F.row_number().over(order) - 1).withColumn("__part", F.floor(F.sum("size").over(order) / PART_BYTES))
    runs = numbered.groupBy("package", "__part").agg(F.array_sort(F.collect_list("entry_idx")).alias("entries"), F.min("uid").cast("long").alias("first_uid"), F.sum("size").alias("bytes"))
    return runs.select("package", F.lit(None).cast("binary").alias("content"), "entries", "first_uid", "bytes")


def reading_tasks(runs: DataFrame) -> int:
    """How many tasks read the runs: as many as cores at least, as many as their mails and bytes ask for, and no more than runs.

    The runs are small rows that stand for much work; of small packages a task
    reads many, since starting a task costs more than such a package.
    """
    n, mails, size = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("entries").cast("long")), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    asked = max(runs.sparkSession.sparkContext.defaultParallelism, -(-mails // TASK_MAILS), -(-size // TASK_BYTES))
    return max(1, min(n, asked, MOST_TASKS))


_READ = f"package string, entry_idx int, error string, {PARSED}, uid bigint"


def read_mails(packages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Mails of the sound packages, with ``uid`` in archive order inside each package.

    A package that breaks a rule gives no mail, and so does one of which an
    entry turns out larger than declared while it is read.  Every mail is read
    and parsed once.
    """
    entries = keep(scan(packages), "entries")
    broken = violations(entries, limits)
    if "content" in packages.columns:
        tasks = _source(packages).join(broken.select("package"), "package", "left_anti").withColumn("entries", F.lit(None).cast("array<int>")).withColumn("first_uid", F.lit(0).cast("long"))
    else:
        runs = keep(parts(entries, broken), "runs")
        tasks = runs.repartition(reading_tasks(runs)).drop("bytes")
    read = keep(tasks.mapInPandas(_mails(limits), _READ), "read")
    lying = read.where("error IS NOT NULL").select("package").distinct()
    return values_of_headers(read.join(lying, "package", "left_anti").drop("error"))
