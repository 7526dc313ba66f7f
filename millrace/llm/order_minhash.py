"""Document fingerprints by Order MinHash, with DataFrame functions alone.

A document's elements are its k-mers of words, each with its occurrence number,
so that repeats count. In each of ``SLOTS`` slots the ``PICKED`` elements with the
smallest hashes are selected, put back into text order, and hashed as a tuple.
Two fingerprints agree in a slot if both the selection and its order agree, which
falls with the edit distance and not only with the set of k-mers.

Instead of hashing every element once per slot, a draw deals an element to one
slot, and a document's draws are ordered by round and then by hash. Round 0 deals
every element once; only documents too short to fill their slots by that go on
for more rounds. A slot that two documents fill in the same round compares the
same hashes, whatever their lengths, and the work is proportional to the text.

The texts are dealt once, by ranges of ids. Everything up to the selected draws
is computed where the text then is: the windows have the range among their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.operators.scaling import computed_once

KMER, SLOTS, PICKED = 3, 32, 2
#: Draws per slot that a document makes at least; a slot then lacks a second one in 8 of 100,000 cases.
DRAWS = 12
#: Bytes of text that a task takes on average, and ranges of ids in it. A word becomes two or
#: more rows of about 80 bytes that a task sorts, so this sets its memory; larger executors may take more.
TASK_BYTES, RANGES_PER_TASK = 2_000_000, 6

# --- fixed values: ASCII white space, which separates words ---------------------
_WHITE = r"[\x20\x09-\x0D]+"
# ---------------------------------------------------------------------------------


def kmers(texts: DataFrame, keys: list[str], k: int = KMER) -> DataFrame:
    """``keys, kmers`` of ``keys, text``: hashes in text order; all words as one k-mer if there are fewer than k."""
    words = F.transform(F.array_remove(F.split("text", _WHITE), ""), lambda w: F.xxhash64(w))
    own = computed_once(texts, _words=words).select(*keys, "_words")
    several = F.transform(
        F.slice("_words", 1, F.greatest(F.size("_words") - (k - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get("_words", i + j) for j in range(1, k)]),
    )
    whole = F.array(F.xxhash64(F.array_join(F.col("_words").cast("array<string>"), " ")))
    return own.where(F.size("_words") > 0).select(*keys, F.when(F.size("_words") >= k, several).otherwise(whole).alias("kmers"))


def tuples_of(texts: DataFrame, keys: list[str], slots: int = SLOTS, picked: int = PICKED, k: int = KMER) -> DataFrame:
    """``keys, slot, tuple`` of ``keys, text``: a row per document and slot that holds a draw.

    Nothing is shuffled if the rows are dealt by a subset of ``keys``.
    """
    rounds = F.ceil(F.lit(float(slots * DRAWS)) / F.size("kmers")).cast("int")
    each = kmers(texts, keys, k).select(*keys, rounds.alias("_rounds"), F.posexplode("kmers").alias("_pos", "_kmer"))
    # The hash leads the sort, so that its comparisons are cheap.
    occurrence = Window.partitionBy("_kmer", *keys).orderBy("_pos")
    numbered = each.select(*keys, "_rounds", "_pos", F.xxhash64("_kmer", F.row_number().over(occurrence)).alias("_element"))
    more = F.when(F.col("_rounds") > 1, F.sequence(F.lit(0), F.col("_rounds") - 1)).otherwise(F.array(F.lit(0)))
    drawn = numbered.select(*keys, "_pos", "_element", F.explode(more).alias("_round"))
    draw = F.xxhash64("_element", "_round")
    placed = drawn.select(
        *keys, "_pos", "_element", "_round", F.pmod(draw, F.lit(slots)).cast("int").alias("slot"), F.shiftrightunsigned(draw, 8).alias("_rank")
    ).withColumn("_lead", F.xxhash64(*keys, "slot"))
    order = Window.partitionBy("_lead", *keys, "slot").orderBy("_round", "_rank", "_pos")
    smallest = placed.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= picked)
    drawn_here = [F.struct(F.col("_pos").alias("p"), F.col("_element").alias("e"))]
    drawn_here += [F.struct(F.lead("_pos", j).over(order).alias("p"), F.lead("_element", j).over(order).alias("e")) for j in range(1, picked)]
    return (
        smallest.withColumn("_drawn", F.array(*drawn_here)).where("_place = 1")
        .withColumn("_drawn", F.array_sort(F.filter("_drawn", lambda x: x["p"].isNotNull())))
        .select(*keys, "slot", F.shiftright(F.xxhash64(F.array_join(F.transform("_drawn", lambda x: x["e"].cast("string")), " ")), 32).cast("int").alias("tuple"))
    )


def likeness(left: Column, right: Column) -> Column:
    """Share of slots in which two fingerprints agree."""
    same = F.aggregate(F.zip_with(left, right, lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(left)


def printed(tuples: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits per slot."""
    return F.array_join(F.transform(tuples, lambda t: F.lower(F.lpad(F.hex(F.pmod(t.cast("bigint"), F.lit(1 << 32))), 8, "0"))), "")


def range_starts(documents: DataFrame, count: int) -> list[int]:
    """Lowest ids of ranges of about as many documents each, fewer than ``count``."""
    shares = [i / count for i in range(1, count)]
    found = documents.agg(F.percentile_approx("id", shares, max(10_000, 20 * count))).first()[0] if shares else None
    return sorted(set(found or []))


def task_count(documents: DataFrame, task_bytes: int) -> int:
    """Tasks of ``task_bytes`` of text each, but not fewer than shuffles have."""
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))


def range_of(id_: Column, starts: list[int]) -> Column:
    """How many starts an id has reached, found in two steps."""
    step = max(1, int(len(starts) ** 0.5))
    groups = [starts[k : k + step] for k in range(0, len(starts), step)]
    if not groups:
        return F.lit(0)
    group = F.size(F.filter(F.array(*[F.lit(g[0]).cast("bigint") for g in groups]), lambda s: s <= id_))
    inside = F.get(F.array(*[F.array(*[F.lit(s).cast("bigint") for s in g]) for g in groups]), group - 1)
    return F.when(group == 0, 0).otherwise((group - 1) * step + F.size(F.filter(inside, lambda s: s <= id_)))


def with_next(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = TASK_BYTES) -> DataFrame:
    """``range, place, copy, id, text, next_text``: each document and the text after it in descending order of ids.

    After the last document comes the first; documents without an id come last,
    and rows of one id follow each other, both by a hash of their texts. The texts
    are shuffled once, by range. The first document of a range travels a second
    time, marked as ``copy``, to the range whose last document it follows. What is
    broadcast has a row for each range.
    """
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tasks = task_count(rows, task_bytes)
    count = RANGES_PER_TASK * tasks
    number = F.when(F.col("id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(count))).otherwise(
        range_of(F.col("id"), range_starts(rows.select("id"), count))
    ).cast("int")
    placed = rows.withColumn("range", number)
    heads = placed.groupBy("range").agg(F.max("id").alias("_id"), F.max(F.when(F.col("id").isNull(), F.xxhash64("text"))).alias("_hash"))
    every = Window.orderBy("range")
    heads = heads.withColumn("_goes", F.coalesce(F.lead("range").over(every), F.first("range").over(every)))
    heads = stored(heads, "fingerprint-ranges")
    is_head = (F.col("id") == F.col("_id")) | (F.col("id").isNull() & F.col("_id").isNull() & (F.xxhash64("text") == F.col("_hash")))
    stays = F.struct(F.col("range"), F.lit(False).alias("copy"))
    goes = F.struct(F.col("_goes").alias("range"), F.lit(True).alias("copy"))
    dealt = (
        placed.join(F.broadcast(heads), "range")
        .select("id", "text", F.explode(F.when(is_head, F.array(stays, goes)).otherwise(F.array(stays))).alias("_to"))
        .select(F.col("_to.range").alias("range"), F.col("_to.copy").alias("copy"), "id", "text")
        .where("range IS NOT NULL")
        .repartition(tasks, "range")
    )
    after = Window.partitionBy("range").orderBy("copy", F.col("id").desc_nulls_last(), F.xxhash64("text").desc(), "text")
    return dealt.select("range", F.row_number().over(after).alias("place"), "copy", "id", "text", F.lead("text").over(after).alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The last third of a text (rounded down) replaced by the first as many code points of the one after it."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def compare(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness.

    ``id, n_chars, edited_sha256, tuples, edited_tuples, near_edited, near_next``,
    one row per row in. Null texts are empty. Texts without a word have the
    fingerprint of zeros, and agree only with each other. A document that is
    alone follows itself. Equal texts have equal fingerprints. Other columns are
    not looked at.
    """
    rows = with_next(documents, id_col, text_col).withColumn("edited", F.when(~F.col("copy"), edited(F.col("text"), F.col("next_text"))))
    versions = F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))
    texts = rows.select("range", "place", F.explode(versions).alias("_v")).where("_v.text IS NOT NULL")
    texts = texts.select("range", (2 * F.col("place") + F.col("_v.which")).alias("version"), "_v.text")
    found = tuples_of(texts, ["range", "version"], slots).groupBy("range", F.shiftright("version", 1).alias("place")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("version") % 2 * slots + F.col("slot")).alias("k"), F.col("tuple")))).alias("_by")
    )

    def side(which: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: F.coalesce(F.element_at("_by", s + which * slots), F.lit(0)))

    whole = (
        rows.select("range", "place", "copy", "id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
        .join(found, ["range", "place"], "left")
        .withColumn("_by", F.coalesce("_by", F.create_map().cast("map<int,int>")))
        .select("range", "place", "copy", "id", "n_chars", "edited_sha256", side(0).alias("tuples"), side(1).alias("edited_tuples"))
    )
    after = Window.partitionBy("range").orderBy("place")
    return (
        whole.withColumn("_next", F.lead("tuples").over(after)).where(~F.col("copy"))
        .select(
            "id", "n_chars", "edited_sha256", "tuples", "edited_tuples",
            likeness(F.col("tuples"), F.col("edited_tuples")).alias("near_edited"), likeness(F.col("tuples"), F.col("_next")).alias("near_next"),
        )
    )
