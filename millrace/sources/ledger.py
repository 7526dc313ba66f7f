"""A ledger of verified objects, so that only what changed is read again.

The ledger is a table (:mod:`millrace.sources.tables`) with a row for each check of an object: its
key, the size and time of change that the listing gave, the checksum its bytes had then
and what came of it. An object whose latest row agrees with the listing is not read.
The listing is taken before the bytes: an object that changes in between has
another time in the next listing and is read again. A change that keeps both size and
millisecond goes unseen; ``everything`` reads all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import cut_lineage
from millrace.sources import objects, tables

COLUMNS = "pass bigint, key string, size_bytes bigint, modified timestamp, actual string, outcome string, category string"

_STATE = ["size_bytes", "modified"]


def latest(ledger: DataFrame) -> DataFrame:
    """The last check of each key; checks of one key meet as one aggregate, however many there are."""
    rest = [c for c in ledger.columns if c not in ("key", "pass")]
    return ledger.groupBy("key").agg(F.max_by(F.struct("pass", *rest), "pass").alias("_last")).select("key", "_last.*")


def compared(listing: DataFrame, ledger: DataFrame, everything: bool = False) -> DataFrame:
    """What a pass has to tell: ``key, size_bytes, modified`` of the objects to read, and of those ``gone`` since the ledger knew them.

    The ledger's checks are aggregated once and meet the listing in one join; what is unchanged is dropped there.
    """
    known = latest(ledger.select("pass", "key", *_STATE, "outcome")).where("outcome <> 'vanished'")
    sides = listing.select("key", F.struct(*_STATE).alias("_now")).join(known.select("key", F.struct(*_STATE).alias("_then")), "key", "full_outer")
    same = F.lit(not everything)
    for c in _STATE:
        same = same & (F.col(f"_now.{c}") == F.col(f"_then.{c}"))
    told = sides.where(~F.coalesce(same, F.lit(False)))
    return told.select("key", *[F.coalesce("_now", "_then")[c].alias(c) for c in _STATE], F.col("_now").isNull().alias("gone"))


def changed_objects(listing: DataFrame, ledger: DataFrame, everything: bool = False) -> DataFrame:
    """Objects to read: those the ledger doesn't know, or knows with another size or time."""
    return compared(listing, ledger, everything).where("NOT gone").drop("gone")


def verify_changed(spark: SparkSession, store: objects.FolderStore, bucket: str, path: str, number: int, everything: bool = False) -> DataFrame:
    """Check what changed since the passes before, write it down, and return the rows of this pass.

    ``outcome`` is ``there``, ``changed`` (other bytes than the key promises), or ``vanished``
    (known to the ledger, no longer listed, told once). A pass that is repeated under its
    ``number``, as after a crash, reads nothing and returns what it wrote down then.
    """
    tables.create_table(spark, path, COLUMNS)
    if not tables.history(spark, path).where(F.col("batch") == f"pass-{number}").isEmpty():
        return tables.read_table(spark, path).where(F.col("pass") == number)
    before = tables.read_table(spark, path).where(F.col("pass") < number)
    found = cut_lineage(compared(objects.list_objects(spark, store, bucket), before, everything))
    address = F.concat(F.lit(f"s3://{bucket}/"), "key").alias("storage_uri")
    wanted = found.where("NOT gone").select(address, "key", *_STATE)
    checked = objects.check_objects(wanted.repartition(objects.dealt_to(spark, wanted.count()), "key"), store, ["key", *_STATE], read=True)
    gone = found.where("gone").select(
        "key", *_STATE, F.lit(None).cast("string").alias("actual"),
        F.lit("vanished").alias("outcome"), F.lit(objects.INTEGRITY).alias("category"),
    )
    rows = checked.select("key", *_STATE, "actual", "outcome", "category").unionByName(gone)
    tables.append(rows.withColumn("pass", F.lit(number).cast("bigint")), path, f"pass-{number}")
    return tables.read_table(spark, path).where(F.col("pass") == number)
