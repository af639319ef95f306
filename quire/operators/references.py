"""References to records that do not exist.

References and parent keys are co-partitioned on the key and sorted, and both sorted streams
are merged linearly: a left outer sort-merge join of every reference with the one summary row
of its key. The summary holds the validity intervals of the key, built from the times at which
its row came in and the times at which it was deleted, and tells missing, deleted and late apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

#: A key with at least this share of all references is salted; so at most HOT_KEYS keys are.
HOT_KEYS = 200
#: Pieces into which the references of a salted key are spread.
SALTS = 32


def clean_key(col: Column) -> Column:
    """The key without the blanks around it; case is kept."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def validity(parents: DataFrame, deletions: DataFrame | None) -> DataFrame:
    """One row per key: (key, has_row, first_in, ever_deleted, intervals).

    parents has (key, since), deletions (key, gone_at), both timestamps without zone.
    intervals is an array of (from, to): from the times in, each up to the next deletion
    after it (null: still valid). Null keys and keys that are blank are dropped. Times that are
    null don't bound anything. Repeated rows change nothing.
    """
    rows = parents.select(clean_key(F.col("key")).alias("key"), F.col("since").alias("t"), F.lit(0).alias("gone"))
    if deletions is not None:
        rows = rows.unionByName(deletions.select(clean_key(F.col("key")).alias("key"), F.col("gone_at").alias("t"), F.lit(1).alias("gone")))
    is_in, is_out = F.col("gone") == 0, F.col("gone") == 1
    summary = (
        rows.filter(F.col("key") != "")
        .groupBy("key")
        .agg(
            F.max(is_in).alias("has_row"),
            F.min(F.when(is_in, F.col("t"))).alias("first_in"),
            F.max(is_out).alias("ever_deleted"),
            # a parent key has as many times as it was imported or deleted, not as it was cited
            F.array_sort(F.collect_set(F.when(is_in, F.col("t")))).alias("ins"),
            F.array_sort(F.collect_set(F.when(is_out, F.col("t")))).alias("outs"),
        )
    )
    nxt = "transform(ins, i -> named_struct('from', i, 'to', array_min(filter(outs, o -> o > i))))"
    return summary.select("key", "has_row", "first_in", "ever_deleted", F.expr(nxt).alias("intervals"))


def _salted(refs: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spread the references of the few heaviest keys over SALTS partitions, and repeat their parents.

    The heavy keys hold at least 1/HOT_KEYS of all references each, so there are at most
    HOT_KEYS of them however large the data is, and only they reach the driver.
    """
    counts = materialize(refs.groupBy("key").agg(F.count("*").alias("n")))
    n = counts.agg(F.sum("n")).first()[0] or 0
    heavy = [r.key for r in counts.filter(F.col("n") * HOT_KEYS >= max(n, 10 * HOT_KEYS)).select("key").collect()] if n else []
    if not heavy:
        return refs.withColumn("salt", F.lit(0)), parents.withColumn("salt", F.lit(0))
    hot = F.col("key").isin(heavy)
    left = refs.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("ref_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    right = parents.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left, right


def resolve(refs: DataFrame, parents: DataFrame, deletions: DataFrame | None = None, salted: bool = True) -> DataFrame:
    """Every reference with what became of its key.

    refs has (ref_id, ref_field, key, at): at is a timestamp without zone or null. parents has
    (key, since), deletions (key, gone_at); other columns are ignored, so clashing names do no
    harm. References whose key is null or blank refer to nothing and are left out; the others
    come out once each, as (ref_id, ref_field, key, at, status), status being

    - missing: no row has the key, and the log doesn't know it;
    - deleted: no row has the key, but the deletion log has it;
    - late: the earliest row came in after the reference;
    - gap: there is a row, but at that time it was deleted and not yet back;
    - valid: none of these. A reference without a time is never late or in a gap.
    """
    refs = refs.select("ref_id", "ref_field", clean_key(F.col("key")).alias("key"), "at").filter(F.col("key") != "")
    known = validity(parents, deletions)
    left, right = _salted(refs, known) if salted else (refs.withColumn("salt", F.lit(0)), known.withColumn("salt", F.lit(0)))
    joined = left.join(right.hint("merge"), ["key", "salt"], "left")
    has = F.coalesce(F.col("has_row"), F.lit(False))
    covered = F.expr("exists(intervals, v -> v.from <= at and (v.to is null or v.to > at))")
    status = (
        F.when(~has & F.coalesce(F.col("ever_deleted"), F.lit(False)), "deleted")
        .when(~has, "missing")
        .when(F.col("first_in") > F.col("at"), "late")
        .when(F.col("at").isNotNull() & (F.size("intervals") > 0) & ~covered, "gap")
        .otherwise("valid")
    )
    return joined.select("ref_id", "ref_field", "key", "at", status.alias("status"))


def report(resolved: DataFrame) -> DataFrame:
    """References and orphans per field and month: (ref_field, month, status, n_refs).

    month is 'yyyy-MM' of the reference's time, 'unknown' without one.
    """
    month = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown"))
    return resolved.groupBy("ref_field", month.alias("month"), "status").agg(F.count("*").alias("n_refs"))


def orphans(resolved: DataFrame) -> DataFrame:
    """The references whose key is missing, deleted or came in late."""
    return resolved.filter(F.col("status").isin("missing", "deleted", "late"))
