"""Hash, verify, list and compare audit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.functions.canonical import canonical_json, entry_hash, with_canonical_json
from scrubline.functions.risk import NAME_WARNING
from scrubline.session import checkpoint_root

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
LIST_DEFAULT = 50
LIST_MOST = 200
EXPORT_MOST = 500
EXPORT_COLUMNS = ["id", "ts", "action", "resource", "outcome", "entry_hash"]
PANEL_COLUMNS = ["id", "ts", "actor", "role", "action", "resource", "outcome", "hash_valid"]
# ---------------------------------------------------------------------------

AUDIT_SCHEMA = (
    "id long, ts string, actor string, role string, action string, resource string, "
    "outcome string, metadata_json string, entry_hash string"
)
AUDIT_COLUMNS = [field.split()[0] for field in AUDIT_SCHEMA.split(", ")]

# Row numbers of monotonically_increasing_id: partition above, position below.
POSITION_BITS = 33


def utc_day(ts: Column) -> Column:
    """The UTC day of a time stamp's text, whatever the session's zone; null where it is none."""
    days = F.floor(F.unix_micros(F.try_to_timestamp(ts)) / F.lit(86_400_000_000))
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))


def with_entry_hash(
    df: DataFrame, key_order: list[str] | None = None, out: str = "entry_hash"
) -> DataFrame:
    """Hash every row's fields and metadata; null where the metadata is no JSON."""
    hashed = with_canonical_json(df, "metadata_json", "__canonical")
    return hashed.withColumn(out, entry_hash(F.col("__canonical"), key_order)).drop("__canonical")


def assign_ids(df: DataFrame, order_by: list[str], last_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Number the rows ``last_id + 1, …`` in the given order, without gaps.

    Rows are range-partitioned and sorted, so no task holds more than its share;
    give the order a distinct last key (the entry hash, say) and even one hot
    time stamp splits across tasks.  The sorted rows are checkpointed once, which
    fixes their positions for good: the counts per partition (one row each) are
    summed up and sent to every task, and an id is offset plus position.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    order = [F.col(c) for c in order_by]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = (
        ranged.sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    partition = F.shiftright("__at", POSITION_BITS)
    sizes = placed.groupBy(partition.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    # one row per partition: small by construction, so one window task will do
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    position = F.col("__at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return (
        placed.withColumn("__part", partition)
        .join(F.broadcast(offsets), "__part")
        .select((F.lit(last_id) + F.col("__offset") + position + 1).alias("id"), *df.columns)
    )


def next_id(df: DataFrame) -> DataFrame:
    """The highest id so far and the one to follow; an empty table starts at 1."""
    highest = F.coalesce(F.max("id"), F.lit(0))
    return df.agg(highest.alias("max_id"), (highest + 1).alias("next_id"))


def verify(df: DataFrame, key_order: list[str] | None = None) -> DataFrame:
    """Add ``hash_valid`` to every row in one pass over the table."""
    checked = with_entry_hash(df, key_order, "__expected")
    return checked.withColumn(
        "hash_valid", F.coalesce(F.col("__expected") == F.col("entry_hash"), F.lit(False))
    ).drop("__expected")


def verify_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """``hash_valid`` for each asked id; an id that is not there is not valid."""
    # project first, so that only asked rows are hashed
    found = verify(df.join(ids.select("id").distinct(), "id", "left_semi")).select("id", "hash_valid")
    return ids.join(found, "id", "left").select(
        *ids.columns, F.coalesce("hash_valid", F.lit(False)).alias("hash_valid")
    )


def _newest(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.col("id").desc()).limit(n)


def list_latest(df: DataFrame, n: int = LIST_DEFAULT) -> DataFrame:
    """The newest entries in ascending order, each with ``hash_valid``.

    ``n`` is held between 1 and 200.  Only the rows listed are hashed.
    """
    listed = _newest(df, max(1, min(n, LIST_MOST)))
    return verify(listed).withColumn("metadata_json", canonical_json(F.col("metadata_json"))).orderBy("id")


def audit_panel(df: DataFrame) -> DataFrame:
    """The dashboard's audit table: eight columns of the newest fifty entries."""
    return panel(_newest(df, LIST_DEFAULT))


def panel(rows: DataFrame) -> DataFrame:
    return verify(rows).select(*PANEL_COLUMNS).orderBy("id")


def export(df: DataFrame, actor: str, n: int | None = EXPORT_MOST) -> DataFrame:
    """Entries for export with who exported them; ``n`` None exports them all."""
    rows = df.select(*EXPORT_COLUMNS)
    if n is not None:
        rows = _newest(rows, n).orderBy("id")
    return rows.withColumn("exported_by", F.lit(actor))


def export_summary(exported: DataFrame, actor: str) -> DataFrame:
    return exported.agg(F.count(F.lit(1)).alias("count")).withColumn("exported_by", F.lit(actor))


def audit_metrics(df: DataFrame) -> DataFrame:
    """Total, failures and a map of counts by action, from one scan."""
    per_action = df.groupBy("action").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") != "ok").alias("failed")
    )
    return per_action.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_entries"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failure_count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("action", "n")))).alias("by_action"),
    )


def missing_entries(src: DataFrame, dst: DataFrame) -> DataFrame:
    """The rows a merge would insert: first of each hash in ``src``, absent in ``dst``.

    Rows without a hash stand for no entry that could be compared; they are left out and never folded into one.

    Both steps key on ``entry_hash``, so the rows are shuffled once, and only the
    hashes of ``dst`` are read.  Aggregating before the shuffle keeps many copies
    of one entry from meeting in one task.
    """
    rest = [c for c in src.columns if c != "entry_hash"]
    first = src.where(F.col("entry_hash").isNotNull()).groupBy("entry_hash").agg(F.min_by(F.struct(*rest), F.col("id")).alias("row"))
    return first.join(dst.select("entry_hash"), "entry_hash", "left_anti").select(
        *[F.col("entry_hash") if c == "entry_hash" else F.col("row")[c].alias(c) for c in src.columns]
    )


# bits of the filter for each hash in it, a power of two: one in sixteen hashes that are not in it passes all the same
BITS_EACH = 16
# with more hashes than this there is no filter: it is sent to every task, two bytes a hash
MOST_FILTERED = 16_000_000


def hash_filter(hashes: DataFrame, n: int) -> DataFrame:
    """(bucket, bits): a table of bits for ``n`` values of ``entry_hash``, as long as their number calls for."""
    at = _filter_place(n)
    found = hashes.where(F.col("entry_hash").isNotNull()).select(
        F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("at")
    )
    return found.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def _filter_place(n: int) -> Column:
    size = BITS_EACH << max(11, (max(n, 1) - 1).bit_length())
    return F.pmod(F.xxhash64("entry_hash"), F.lit(size).cast("long"))


def maybe_present(df: DataFrame, hashes: DataFrame, n: int) -> DataFrame:
    """The rows whose hash may be one of ``hashes``: all that are, and few others.

    ``n`` is how many hashes there are, counted beforehand; the filter takes two bytes for each.  It is looked at where the rows are read,
    so what does not pass is not shuffled.  Beyond ``MOST_FILTERED`` all rows pass.
    """
    if n > MOST_FILTERED:
        return df
    at = _filter_place(n)
    bits = hash_filter(hashes, n).select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    position = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.expr("(__byte >> cast(__position % 8 as int)) & 1") == 1
    looked_up = df.withColumn("__bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bits), "__bucket")
    return looked_up.withColumn("__byte", byte).withColumn("__position", position).where(hit).select(*df.columns)


def id_conflicts(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Same id, different hash: rows that would break a merge part-way."""
    left = src.select("id", F.col("entry_hash").alias("source_hash"))
    right = dst.select("id", F.col("entry_hash").alias("target_hash"))
    return left.join(right, "id").where(~F.col("source_hash").eqNullSafe(F.col("target_hash")))


def source_conflicts(src: DataFrame) -> DataFrame:
    """Ids that stand for several different entries within one table, with how many."""
    hashes = src.select("id", F.coalesce("entry_hash", F.lit("")).alias("h")).distinct()
    return hashes.groupBy("id").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1")


def leaky_metadata(df: DataFrame) -> DataFrame:
    """Rows whose stored warnings carry matched text, with those warnings."""
    warnings = F.from_json(F.get_json_object("metadata_json", "$.deid_warnings"), "array<string>")
    leaks = F.filter(warnings, lambda w: w.startswith(NAME_WARNING) & (F.length(w) > len(NAME_WARNING)))
    return df.select("id", leaks.alias("leaks")).where(F.size("leaks") > 0)


def audit_between(df: DataFrame, start: str, end: str) -> DataFrame:
    """Entries from ``start`` up to, not including, ``end``.

    A table partitioned by ``dt`` is pruned to the days concerned.
    """
    at = F.try_to_timestamp(F.col("ts"))
    rows = df.where((at >= F.to_timestamp(F.lit(start))) & (at < F.to_timestamp(F.lit(end))))
    if "dt" in df.columns:
        rows = rows.where((F.col("dt") >= utc_day(F.lit(start))) & (F.col("dt") <= utc_day(F.lit(end))))
    return rows
