"""Problem 6: references to records that do not exist.

Parents and children are put in long form, each row tagged with the parent table and
its key, and grouped by both. Groups without a parent flag are orphans. Whether a
parent came later or was deleted is decided on time buckets of each group, so that a
group of any size is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sijill.session import table


def plain_key(col: Column) -> Column:
    """Keys compared without case and surrounding white space."""
    return F.lower(F.regexp_replace(col.cast("string"), r"^[\s\p{Z}\uFEFF]+|[\s\p{Z}\uFEFF]+$", ""))


def parents(df: DataFrame, name: str, key: Column, at: Column | None = None, deleted: Column | None = None, tie: Column | None = None) -> DataFrame:
    """Tagged parent rows: parent_table, key, at, is_parent, deleted, tie."""
    null = F.lit(None)
    return df.select(
        F.lit(name).alias("parent_table"),
        key.alias("key"),
        (null if at is None else at).cast("timestamp").alias("at"),
        F.lit(True).alias("is_parent"),
        F.coalesce(deleted if deleted is not None else F.lit(False), F.lit(False)).alias("deleted"),
        (null if tie is None else tie).cast("long").alias("tie"),
        null.cast("string").alias("child_table"),
        null.cast("long").alias("row_key"),
    ).where(F.col("key").isNotNull())


def children(df: DataFrame, name: str, child_table: str, row_key: Column, key: Column, at: Column) -> DataFrame:
    """Tagged child rows; a null key refers to nothing and is left out."""
    return df.select(
        F.lit(name).alias("parent_table"),
        key.alias("key"),
        at.cast("timestamp").alias("at"),
        F.lit(False).alias("is_parent"),
        F.lit(False).alias("deleted"),
        F.lit(None).cast("long").alias("tie"),
        F.lit(child_table).alias("child_table"),
        row_key.cast("long").alias("row_key"),
    ).where(F.col("key").isNotNull())


def orphans(tagged: DataFrame, bucket: str = "day") -> DataFrame:
    """(child_table, row_key, parent_table, at, kind) of each broken reference.

    kind: missing, no parent has the key; late, parents exist but all after the child;
    deleted, the latest parent up to the child is a deletion (equal times: the highest
    tie). A child without a time is only checked for `missing`; a parent without a time
    exists but has no place in the order. Repeated rows are reported each. Empty tables
    give no rows or, without parents, `missing` for each child.

    Per (parent table, key, time bucket) one aggregate is made with map-side combine;
    the states are carried over the buckets of a key, of which there are as many as
    periods, not rows; rows are then ordered only inside their bucket.
    """
    slot = F.date_trunc(bucket, "at")
    state = F.max(F.when(F.col("is_parent") & F.col("at").isNotNull(), F.struct("at", "tie", "deleted")))
    per_slot = tagged.groupBy("parent_table", "key", slot.alias("slot")).agg(
        F.max("is_parent").alias("any_parent"),
        F.max(~F.col("is_parent")).alias("any_child"),
        F.max(F.col("is_parent") & F.col("at").isNull()).alias("undated"),
        F.min(F.when(F.col("is_parent"), F.col("at"))).alias("first_at"),
        state.alias("last_state"),
    )
    group = W.partitionBy("parent_table", "key")
    before = group.orderBy(F.col("slot").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    whole = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carried = (
        per_slot.select(
            "parent_table",
            "key",
            "slot",
            "any_child",
            F.max("any_parent").over(whole).alias("found"),
            F.max("undated").over(whole).alias("undated"),
            F.min("first_at").over(whole).alias("first_at"),
            F.max("last_state").over(before).alias("carry"),
            # only a bucket that holds parents and children needs its rows in order
            (F.col("any_parent") & F.col("any_child")).alias("mixed"),
        )
    ).where("any_child")
    kids = tagged.where(~F.col("is_parent")).withColumn("slot", slot)
    joined = kids.alias("c").join(carried.alias("g"), F.expr("c.parent_table = g.parent_table AND c.key = g.key AND c.slot <=> g.slot"))
    base = joined.select("c.parent_table", "c.key", "c.child_table", "c.row_key", "c.at", "c.slot", "g.found", "g.undated", "g.first_at", "g.carry", "g.mixed")
    # rows of mixed buckets: their parents are joined to them in order of time
    mixed_slots = carried.where("mixed").select("parent_table", "key", "slot")
    inside = (
        tagged.where(F.col("at").isNotNull())
        .withColumn("slot", slot)
        .join(mixed_slots, ["parent_table", "key", "slot"], "left_semi")
    )
    order = W.partitionBy("parent_table", "key", "slot").orderBy("at", F.col("is_parent").desc(), "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    here = F.last(F.when(F.col("is_parent"), F.struct("at", "tie", "deleted")), ignorenulls=True).over(order)
    settled = inside.withColumn("here", here).where(~F.col("is_parent")).groupBy("child_table", "row_key", "parent_table", "key", "at").agg(F.max("here").alias("here"))
    plain = base.where(~F.col("mixed") | F.col("at").isNull()).withColumn("state", F.col("carry"))
    mixed = (
        base.where(F.col("mixed") & F.col("at").isNotNull())
        .join(settled, ["child_table", "row_key", "parent_table", "key", "at"], "left")
        .withColumn("state", F.coalesce("here", "carry"))
        .drop("here")
    )
    kind = (
        F.when(~F.col("found"), F.lit("missing"))
        .when(F.col("at").isNotNull() & ~F.col("undated") & (F.col("first_at") > F.col("at")), F.lit("late"))
        .when(F.col("at").isNotNull() & F.col("state.deleted"), F.lit("deleted"))
    )
    return plain.unionByName(mixed).select("child_table", "row_key", "parent_table", "at", kind.alias("kind")).where(F.col("kind").isNotNull())


def count_mismatches(heads: DataFrame, head_key: str, stated: str, entries: DataFrame, entry_head: str, counted: Column) -> DataFrame:
    """Heads whose stated count isn't the number of different keys among their entries.

    Distinct (head, key) pairs combine before the shuffle and are spread by pair, so a
    head with a third of all entries costs no task more than others.
    """
    pairs = entries.select(F.col(entry_head).alias("__head"), counted.alias("__key")).where("__head IS NOT NULL AND __key IS NOT NULL").distinct()
    counts = pairs.groupBy("__head").agg(F.count(F.lit(1)).alias("__count"))
    return heads.where(F.col(stated).isNotNull()).join(counts, F.col(head_key) == F.col("__head"), "left").where(F.col(stated) != F.coalesce("__count", F.lit(0))).drop("__head", "__count")


def month(at: Column) -> Column:
    """The UTC month; sessions of this package run in UTC."""
    return F.date_format(at, "yyyy-MM")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    entries, chunks, runs = (table(spark, folder, n) for n in ("citation_registry", "chunks", "registry_runs"))
    tagged = (
        parents(chunks, "chunks", plain_key(F.col("chunk_id")), F.col("indexed_at"), F.col("is_deleted"), F.col("row_id"))
        .unionByName(children(entries, "chunks", "citation_registry", F.col("entry_id"), plain_key(F.col("chunk_id")), F.col("registered_at")))
        .unionByName(parents(runs, "registry_runs", F.col("registry_id").cast("string")))
        .unionByName(children(entries, "registry_runs", "citation_registry", F.col("entry_id"), F.col("registry_id").cast("string"), F.col("registered_at")))
    )
    broken = orphans(tagged).select(
        F.col("child_table").alias("table_name"),
        "row_key",
        month(F.col("at")).alias("period"),
        F.when(F.col("parent_table") == "registry_runs", F.lit("no_registry")).otherwise(F.col("kind")).alias("kind"),
    )
    counts = count_mismatches(runs, "registry_id", "chunk_count", entries.select(F.col("registry_id").alias("_run"), "chunk_id"), "_run", plain_key(F.col("chunk_id")))
    return broken.unionByName(counts.select(F.lit("registry_runs").alias("table_name"), F.col("registry_id").alias("row_key"), month(F.col("generated_at")).alias("period"), F.lit("count").alias("kind")))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans and wrong counts per table and month."""
    return p6_found(spark, folder).groupBy("table_name", "period", "kind").agg(F.count(F.lit(1)).alias("n_rows"))


_KEY = "lower(regexp_replace(chunk_id, '^[\\s\\p{Z}\\x{FEFF}]+|[\\s\\p{Z}\\x{FEFF}]+$', '', 'g'))"
P6_SQL = f"""
WITH c AS (SELECT {_KEY} AS k, indexed_at AS ts, coalesce(is_deleted, false) AS deleted, row_id FROM chunks WHERE chunk_id IS NOT NULL),
e AS (SELECT entry_id, registry_id, {_KEY} AS k, registered_at AS ts FROM citation_registry),
j AS (SELECT e.entry_id, any_value(e.ts) AS ts, any_value(e.k) AS ek, count(c.k) AS n, count(c.k) FILTER (WHERE c.ts IS NULL) AS undated, min(c.ts) AS first_at,
        arg_max(c.deleted, (c.ts, c.row_id)) FILTER (WHERE c.ts <= e.ts) AS deleted
      FROM e LEFT JOIN c ON c.k = e.k GROUP BY e.entry_id),
f AS (SELECT entry_id, ts, CASE WHEN n = 0 THEN 'missing' WHEN undated = 0 AND first_at > ts THEN 'late' WHEN deleted THEN 'deleted' END AS kind FROM j WHERE ek IS NOT NULL),
n AS (SELECT registry_id, count(DISTINCT k) AS n FROM e GROUP BY registry_id)
SELECT 'citation_registry' AS table_name, entry_id AS row_key, strftime(ts AT TIME ZONE 'UTC', '%Y-%m') AS period, kind FROM f WHERE kind IS NOT NULL
UNION ALL SELECT 'citation_registry', entry_id, strftime(ts AT TIME ZONE 'UTC', '%Y-%m'), 'no_registry' FROM e WHERE registry_id IS NOT NULL AND registry_id NOT IN (SELECT registry_id FROM registry_runs)
UNION ALL SELECT 'registry_runs', r.registry_id, strftime(r.generated_at AT TIME ZONE 'UTC', '%Y-%m'), 'count' FROM registry_runs r LEFT JOIN n USING (registry_id)
  WHERE r.chunk_count IS NOT NULL AND r.chunk_count <> coalesce(n.n, 0)
"""
