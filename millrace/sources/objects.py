"""The raw payload store as files: written by tasks, each name taken once.

A store is a root with a folder per bucket; the object of ``s3://bucket/key`` lies
at ``<root>/<bucket>/<key>``. Tasks write objects where the rows are, so bodies are
never shuffled. A name is taken by an exclusive create: of several writers of one key,
also of two runs of one task, one writes and the others find its object.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections import deque
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import key_checksum, uri_bucket, uri_key
from millrace.session import cut_lineage

INTEGRITY, CONFIGURATION, DENIED = "RawPayloadIntegrityError", "ConfigurationError", "RawPayloadAccessDenied"

#: Rows that a task holds at once.
ROWS = 200
#: Names that a task holds at once while it lists, and that the driver looks at before tasks do it.
NAMES, FEW_NAMES = 10_000, 1000
#: Objects that are worth a task of their own.
TASK_OBJECTS = 1000


class Store(Protocol):
    """What a store must offer; it is sent to the tasks."""

    def has(self, bucket: str) -> bool: ...

    def create(self, bucket: str, key: str, body: bytes) -> bool:
        """Writes a whole object, unless the key is taken: then False, and nothing is written."""
        ...

    def size(self, bucket: str, key: str) -> int | None:
        """Bytes of an object; None if there is none."""
        ...

    def read(self, bucket: str, key: str) -> bytes | None: ...


class FolderStore:
    """Buckets as folders on storage that every machine has mounted.

    An object is written under a name of its own and then linked to its key, which
    fails if the key is there: a reader sees whole objects only, and a writer that
    dies leaves a nameless file in ``.parts``, which no reader looks at.
    """

    def __init__(self, root: str):
        self.root = root.removeprefix("file://").rstrip("/") if root.startswith("file://") else root.removeprefix("file:").rstrip("/")
        if "://" in self.root:
            raise ValueError(f"not a folder: {root}")

    def provision(self, bucket: str) -> None:
        """Create a bucket; one that is there is left alone. Nothing else creates buckets."""
        os.makedirs(f"{self.root}/{bucket}", exist_ok=True)

    def has(self, bucket: str) -> bool:
        return bool(bucket) and os.path.isdir(f"{self.root}/{bucket}")

    def _path(self, bucket: str, key: str) -> str:
        # A step upwards would leave the bucket.
        if any(step in ("", ".", "..") or step.startswith(".parts") for step in key.split("/")):
            raise ValueError(f"not an object key: {key!r}")
        return f"{self.root}/{bucket}/{key}"

    def create(self, bucket: str, key: str, body: bytes) -> bool:
        path = self._path(bucket, key)
        if os.path.exists(path):
            return False
        # A folder for each process, as writers of one folder wait for each other.
        part = f"{self.root}/{bucket}/.parts/{os.getpid()}/{uuid.uuid4().hex}"
        flags = os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_CLOEXEC
        try:
            file = os.open(part, flags, 0o666)
        except FileNotFoundError:
            os.makedirs(os.path.dirname(part), exist_ok=True)
            file = os.open(part, flags, 0o666)
        try:
            try:
                left = memoryview(body)
                while left:
                    left = left[os.write(file, left) :]
            finally:
                os.close(file)
            try:
                os.link(part, path)
            except FileNotFoundError:
                os.makedirs(os.path.dirname(path), exist_ok=True)
                os.link(part, path)
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
        return True

    def size(self, bucket: str, key: str) -> int | None:
        try:
            return os.stat(self._path(bucket, key)).st_size
        except FileNotFoundError:
            return None

    def read(self, bucket: str, key: str) -> bytes | None:
        try:
            with open(self._path(bucket, key), "rb", buffering=0) as file:
                return file.read()
        except FileNotFoundError:
            return None

    def names(self, bucket: str, folder: str) -> Iterator[tuple[str, bool]]:
        """Keys in a folder of a bucket (``""``: the bucket), and whether each is a folder; without names that Spark's listing hides."""
        try:
            with os.scandir(f"{self.root}/{bucket}/{folder}") as entries:
                for entry in entries:
                    hidden = entry.name.startswith(".") or entry.name.endswith("._COPYING_") or (entry.name.startswith("_") and "=" not in entry.name)
                    if not hidden:
                        yield (f"{folder}/{entry.name}" if folder else entry.name), entry.is_dir()
        except FileNotFoundError:  # gone since it was listed
            return

    def state(self, bucket: str, key: str) -> tuple[int, int] | None:
        """Bytes of an object and the millisecond of its last change; None if there is none."""
        try:
            found = os.stat(f"{self.root}/{bucket}/{key}")
        except FileNotFoundError:
            return None
        return found.st_size, found.st_mtime_ns // 1_000_000


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_bucket": uri_bucket(F.col("storage_uri")), "_key": uri_key(F.col("storage_uri"))})


def _mapped(rows: DataFrame, answer, columns: list[str], schema: str) -> DataFrame:
    """``columns`` of ``rows`` and what ``answer`` gives for each row as lists of further columns, materialised once."""
    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    picked = rows.select(*columns, *[c for c in rows.columns if c.startswith("_")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                extra = [part.column(part.schema.get_field_index(c)).to_pylist() for c in part.schema.names[len(columns) :]]
                found = [answer(*values) for values in zip(*extra, strict=True)]
                answers = [pa.array(list(x)) for x in zip(*found, strict=True)]
                names = [f.split(" ")[0] for f in schema.split(", ")]
                types = {"outcome": pa.string(), "category": pa.string(), "stored_size": pa.int64(), "actual": pa.string()}
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in range(len(columns))] + [a.cast(types[n]) for a, n in zip(answers, names, strict=True)],
                    names=[*columns, *names],
                )

    return cut_lineage(picked.mapInArrow(run, f"{kept}, {schema}"))


def store_payloads(payloads: DataFrame, store: Store, body: str = "payload", columns: list[str] | None = None) -> DataFrame:
    """Write payloads to the objects their ``storage_uri`` names; what became of each row.

    ``outcome`` is ``created``, ``reused`` (an object of this size was there, or of no known size),
    ``conflict`` (one of another size was), ``vanished`` (the key was taken, and its
    object is gone), ``absent`` (no such bucket: it must be provisioned) or ``refused``
    (the address is none, or the body is null); the last four carry an error ``category`` and
    leave the store as it is. ``columns`` come along, ``storage_uri`` always.

    Rows may repeat a key: one creates it. The outcomes are materialised, so that
    reading them again writes nothing; they are the list of objects that this call
    answers for. A task that runs twice reports ``reused`` for what its first run
    created.
    """
    columns = ["storage_uri", *[c for c in columns or [] if c != "storage_uri"]]
    rows = _placed(payloads).withColumn("_body", F.col(body).cast("binary"))

    def put(bucket: str | None, key: str | None, data: bytes | None) -> tuple:
        if bucket is None or key is None or data is None:
            return "refused", DENIED, None
        if not store.has(bucket):
            return "absent", CONFIGURATION, None
        if store.create(bucket, key, bytes(data)):
            return "created", None, len(data)
        size = store.size(bucket, key)
        if size is None:
            return "vanished", INTEGRITY, None
        return ("reused", None, size) if size == len(data) else ("conflict", INTEGRITY, size)

    return _mapped(rows, put, columns, "outcome string, category string, stored_size bigint")


def check_objects(claims: DataFrame, store: Store, columns: list[str] | None = None, read: bool = False) -> DataFrame:
    """Look up the objects that ``storage_uri`` names: is one there, and with ``read``, are its bytes those its key promises?

    ``outcome`` is ``there``, ``vanished``, ``changed`` or ``refused``. Without ``read`` sizes
    alone are asked for; a key without a checksum is never ``changed``.
    """
    columns = ["storage_uri", *[c for c in columns or [] if c != "storage_uri"]]
    rows = _placed(claims).withColumn("_sum", key_checksum(F.col("_key")))

    def look(bucket: str | None, key: str | None, promised: str | None) -> tuple:
        if bucket is None or key is None:
            return "refused", DENIED, None, None
        if not read:
            size = store.size(bucket, key)
            return ("vanished", INTEGRITY, None, None) if size is None else ("there", None, size, None)
        data = store.read(bucket, key)
        if data is None:
            return "vanished", INTEGRITY, None, None
        actual = hashlib.sha256(data).hexdigest()
        wrong = promised is not None and actual != promised
        return ("changed" if wrong else "there"), (INTEGRITY if wrong else None), len(data), actual

    return _mapped(rows, look, columns, "outcome string, category string, stored_size bigint, actual string")


def copy_verified(moves: DataFrame, store: Store, columns: list[str] | None = None, write: bool = True) -> DataFrame:
    """Copy objects from ``storage_uri`` to ``target_uri`` if their bytes have the checksum ``promised``.

    Each object is read once, by the task that writes it. ``outcome`` is ``created``,
    ``reused`` (the target holds these bytes already), ``conflict`` (it holds others),
    ``vanished`` (no source), ``changed`` (other bytes than promised), ``verified`` (without
    ``write``), ``absent`` (no such bucket) or ``refused`` (an address that is none, or no
    checksum). Sources stay. The outcomes are materialised, so reading them again copies nothing.
    """
    columns = ["storage_uri", *[c for c in columns or [] if c != "storage_uri"]]
    to, as_key = uri_bucket(F.col("target_uri")), uri_key(F.col("target_uri"))
    rows = _placed(moves).withColumns({"_to": to, "_as": as_key, "_sum": F.col("promised")})

    def move(bucket: str | None, key: str | None, to: str | None, name: str | None, promised: str | None) -> tuple:
        if None in (bucket, key, to, name, promised):
            return "refused", DENIED, None, None
        if not store.has(bucket) or not store.has(to):
            return "absent", CONFIGURATION, None, None
        data = store.read(bucket, key)
        if data is None:
            return "vanished", None, None, None
        actual = hashlib.sha256(data).hexdigest()
        if actual != promised:
            return "changed", None, len(data), actual
        if not write:
            return "verified", None, len(data), actual
        if store.create(to, name, data):
            return "created", None, len(data), actual
        same = store.read(to, name) == data
        return ("reused" if same else "conflict"), (None if same else INTEGRITY), len(data), actual

    return _mapped(rows, move, columns, "outcome string, category string, stored_size bigint, actual string")


def _suits_file_scan(store: FolderStore, bucket: str, most: int) -> bool:
    """Whether a bucket has no more names than ``most``, and no empty object; no more are looked at."""
    folders, left = [""], most
    while folders:
        for key, is_folder in store.names(bucket, folders.pop()):
            left -= 1
            if left < 0:
                return False
            if is_folder:
                folders.append(key)
            elif (store.state(bucket, key) or (0,))[0] == 0:
                return False
    return True


def dealt_to(spark: SparkSession, rows: int) -> int:
    """Tasks that objects are dealt to: as many as shuffles have, but not for a handful each."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows // TASK_OBJECTS)


def _names(spark: SparkSession, store: FolderStore, bucket: str) -> tuple[DataFrame, int]:
    """``key`` of the objects of a bucket, and how many: tasks walk its folders, breadth first.

    A task that has met ``NAMES`` names below a folder hands on the folders it has not begun, and
    these are dealt to tasks of the next round. So rounds grow with what lies below
    one folder, not with the levels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(names: list[tuple[str, bool]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in names], pa.string()), pa.array([f for _, f in names], pa.bool_())], names=["key", "folder"])

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                waiting, met = deque([folder]), 0
                while waiting and met < NAMES:
                    listed = store.names(bucket, waiting.popleft())
                    while part := list(islice(listed, NAMES)):
                        met += len(part)
                        inner = [k for k, is_folder in part if is_folder]
                        kept = inner[: NAMES - len(waiting)]
                        waiting.extend(kept)
                        yield told([x for x in part if not x[1]] + [(k, True) for k in inner[len(kept) :]])
                yield told([(k, True) for k in waiting])

    folders, found, names = spark.range(0, 1, 1, 1).select(F.lit("").alias("key")), [], 0
    while True:
        level = cut_lineage(folders.mapInArrow(run, "key string, folder boolean"))
        found.append(level.where("NOT folder").select("key"))
        counts = dict(level.groupBy("folder").count().collect())
        names += counts.get(False, 0)
        if not (left := counts.get(True, 0)):
            return reduce(DataFrame.unionByName, found), names
        tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), left)
        folders = level.where("folder").select("key").repartition(tasks, "key")


def list_objects(spark: SparkSession, store: FolderStore, bucket: str) -> DataFrame:
    """``key, size_bytes, modified`` of a bucket; contents stay unread.

    A few objects are listed by Spark's own file scan. That holds every file in the driver,
    deals out some thirty to a task and leaves out empty ones, so the names of larger buckets,
    and of those with an empty object, are listed by tasks, and
    dealt evenly to the tasks that ask for size and time. Names are those of the time of the call, sizes and times those found when rows are read.
    """
    if _suits_file_scan(store, bucket, FEW_NAMES):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{store.root}/{bucket}")
        key = F.substring_index(F.col("path"), f"/{bucket}/", -1)
        return files.select(key.alias("key"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            there = [(k, *s) for k, s in ((k, store.state(bucket, k)) for k in keys) if s is not None]
            columns = [[row[k] for row in there] for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "size_bytes", "millis"])

    names, count = _names(spark, store, bucket)
    found = names.repartition(dealt_to(spark, count), "key").mapInArrow(run, "key string, size_bytes bigint, millis bigint")
    return found.select("key", "size_bytes", F.timestamp_millis("millis").alias("modified"))


class PassEnded(Exception):
    """A row that ends a pass; ``category`` says why."""

    def __init__(self, category: str, message: str):
        super().__init__(message)
        self.category = category


def end_on_conflict(outcomes: DataFrame) -> DataFrame:
    """The outcomes, unless one of them is an error: then the pass ends here, with the first by address."""
    worst = outcomes.where("category IS NOT NULL").agg(F.min(F.struct("category", "storage_uri", "outcome")).alias("w")).first().w
    if worst is not None:
        raise PassEnded(worst.category, f"{worst.outcome}: {worst.storage_uri}")
    return outcomes
