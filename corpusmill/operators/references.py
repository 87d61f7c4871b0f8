"""References to records that do not exist, from signed change deltas.

A coming of a key while it is absent is +1, a deletion while it is present -1,
any other change 0; the running sum of these is the key's existence count, 0 or
1. References count +1 each. A reference is an orphan if the existence count of
its key at its time is 0, and keys with a positive reference count and a zero
existence count form the current orphan report.

The sums are kept at two levels, per (key, slot) and then inside the slot. A slot
is an hour, or a second where an hour of a key has over HOT rows; the references
of such a second are dealt out over SALTS parts, each with the second's changes.
So a key that holds a third of all rows is spread, whatever its times.

The state (changes, references, counts) can be written and is advanced by later
deltas: only the keys they touch are counted again. Changes and references may
arrive late and in any order.

Defined results: null keys are no references; a reference without a time is
held against nothing and so is an orphan; changes without a time or a key are
ignored; repeated rows count once; an empty table has no changes or references;
at one time a deletion comes before a coming, both before a reference.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from corpusmill.session import broadcast_if_small, checkpointed

_HOUR, _SECOND = 3_600_000_000, 1_000_000
#: Rows of one key within one hour over which the hour is split, and the parts of its references.
HOT, SALTS = 50_000, 32


class State(NamedTuple):
    """changes (key, t, sign), references (ref_table, ref_key, key, t), counts (key, existence, n_references)."""

    changes: DataFrame
    references: DataFrame
    counts: DataFrame


def signed_changes(created: DataFrame, deleted: DataFrame) -> DataFrame:
    """(key, t, sign) of changes, distinct: +1 for a coming, -1 for a deletion. Inputs: (key, t) each; t in microseconds."""
    return (
        created.select("key", "t", F.lit(1).alias("sign"))
        .unionByName(deleted.select("key", "t", F.lit(-1).alias("sign")))
        .where("key is not null and t is not null")
        .distinct()
    )


def _hours(changes: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(key, hour, last, n): the last change and the number of rows of each key and hour; the hot ones, or None."""
    hour = F.floor(F.col("t") / F.lit(_HOUR))
    last = F.max(F.struct("t", "sign")).alias("last")
    per = (
        changes.groupBy("key", hour.alias("hour")).agg(last, F.count(F.lit(1)).alias("n"))
        .unionByName(refs.groupBy("key", hour.alias("hour")).agg(F.lit(None).cast("struct<t:bigint,sign:int>").alias("last"), F.count(F.lit(1)).alias("n")))
        .groupBy("key", "hour").agg(F.max("last").alias("last"), F.sum("n").alias("n"))
    )
    per = checkpointed(per)
    hot = per.where(F.col("n") > HOT).select("key", "hour")
    return per, None if hot.isEmpty() else hot


def _with_slot(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Adds slot (microseconds at its start) and whether it is one of a split hour."""
    hour = F.floor(F.col("t") / F.lit(_HOUR))
    if hot is None:
        return rows.withColumn("slot", hour * F.lit(_HOUR)).withColumn("split", F.lit(False))
    marked = rows.withColumn("hour", hour).join(broadcast_if_small(hot.withColumn("split", F.lit(True))), ["key", "hour"], "left")
    second = F.floor(F.col("t") / F.lit(_SECOND)) * F.lit(_SECOND)
    return marked.withColumn("slot", F.when(F.col("split"), second).otherwise(hour * F.lit(_HOUR))).withColumn("split", F.coalesce("split", F.lit(False))).drop("hour")


def existence_at(references: DataFrame, changes: DataFrame) -> DataFrame:
    """references (key, t and others) with a time, with the existence count of their key at it."""
    others = [c for c in references.columns if c not in ("key", "t")]
    per, hot = _hours(changes, references)
    changes, references = _with_slot(changes, hot), _with_slot(references, hot)
    state = F.when(F.col("sign") > 0, 1).when(F.col("sign") < 0, 0)
    if hot is None:
        ends = per.select("key", (F.col("hour") * F.lit(_HOUR)).alias("slot"), F.lit(False).alias("split"), F.col("last.sign").alias("sign"))
    else:
        none = F.lit(None).cast("struct<t:bigint,sign:int>")
        by_slot = changes.groupBy("key", "slot", "split").agg(F.max(F.struct("t", "sign")).alias("last")).unionByName(references.groupBy("key", "slot", "split").agg(none.alias("last")))
        ends = by_slot.groupBy("key", "slot", "split").agg(F.max("last").alias("last")).select("key", "slot", "split", F.col("last.sign").alias("sign"))
    # level 1: what each slot adds to the count, and the sum of all slots before
    before = Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("state", state)
    ends = ends.withColumn("delta", F.coalesce(F.col("state") - F.coalesce(F.last("state", ignorenulls=True).over(before), F.lit(0)), F.lit(0)))
    carried = ends.select("key", "slot", "split", F.coalesce(F.sum("delta").over(before), F.lit(0)).cast("int").alias("state"))
    # level 2: inside the slot, the carried count first; of a split slot one copy for each part
    parts = F.explode(F.when(F.col("split"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    own = F.when(F.col("split"), F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    blank = [F.lit(None).cast(references.schema[c].dataType).alias(c) for c in others]
    key = ["key", "slot"]
    rows = (
        carried.select(*key, parts.alias("part"), F.lit(-(2**62)).alias("t"), F.lit(0).alias("kind"), "state", *blank)
        .unionByName(changes.select(*key, parts.alias("part"), "t", F.when(F.col("sign") < 0, 1).otherwise(2).alias("kind"), state.alias("state"), *blank))
        .unionByName(references.select(*key, own.alias("part"), "t", F.lit(3).alias("kind"), F.lit(None).cast("int").alias("state"), *others))
    )
    order = Window.partitionBy("key", "slot", "part").orderBy("t", "kind")
    earlier, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    delta = F.col("state") - F.coalesce(F.last("state", ignorenulls=True).over(earlier), F.lit(0))
    counted = rows.withColumn("delta", delta).withColumn("existence", F.sum("delta").over(upto))
    return counted.where("kind = 3").select("key", "t", *others, "existence")


def _distinct_references(references: DataFrame) -> DataFrame:
    return references.where("key is not null").select("ref_table", "ref_key", "key", "t").distinct()


def orphans(references: DataFrame, created: DataFrame, deleted: DataFrame) -> DataFrame:
    """The references (ref_table, ref_key, key, t; t in microseconds) without a living record, distinct.

    A record lives at t if it came at or before t and no deletion lies after its
    latest coming and at or before t.
    """
    return orphans_of(_distinct_references(references), signed_changes(created, deleted))


def orphans_of(references: DataFrame, changes: DataFrame) -> DataFrame:
    """The same from a state's distinct references and signed changes."""
    found = existence_at(references.where("t is not null"), changes).where("existence = 0")
    return found.select("ref_table", "ref_key", "key", "t").unionByName(references.where("t is null").select("ref_table", "ref_key", "key", "t"))


def _counts(references: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, existence, n_references) after all changes: the sum of all signed deltas of a key is its last state."""
    last = changes.groupBy("key").agg(F.max(F.struct("t", "sign")).alias("last")).select("key", F.when(F.col("last.sign") > 0, 1).otherwise(0).alias("existence"), F.lit(0).cast("bigint").alias("n"))
    refs = references.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", F.lit(0).alias("existence"), "n")
    return last.unionByName(refs).groupBy("key").agg(F.sum("existence").cast("int").alias("existence"), F.sum("n").alias("n_references"))


def state_of(references: DataFrame, created: DataFrame, deleted: DataFrame) -> State:
    """The state from all rows, each of its tables written once."""
    changes, refs = checkpointed(signed_changes(created, deleted)), checkpointed(_distinct_references(references))
    return State(changes, refs, checkpointed(_counts(refs, changes)))


def advance(state: State, references: DataFrame, created: DataFrame, deleted: DataFrame) -> State:
    """The state after more changes and references; keys they do not touch keep their counts as they are."""
    more, refs = checkpointed(signed_changes(created, deleted)), checkpointed(_distinct_references(references))
    touched = broadcast_if_small(checkpointed(more.select("key").unionByName(refs.select("key")).distinct()))
    changes, all_refs = state.changes.unionByName(more).distinct(), state.references.unionByName(refs).distinct()
    anew = _counts(all_refs.join(touched, "key", "left_semi"), changes.join(touched, "key", "left_semi"))
    counts = state.counts.join(touched, "key", "left_anti").unionByName(anew)
    return State(checkpointed(changes), checkpointed(all_refs), checkpointed(counts))


def orphaned_keys(counts: DataFrame) -> DataFrame:
    """The current report: keys that are referred to and do not exist."""
    return counts.where("n_references > 0 and existence = 0").select("key", "n_references")


def orphan_report(orphaned: DataFrame) -> DataFrame:
    """Orphan references and orphaned keys per table and month (yyyy-MM, null without a time)."""
    month = F.date_format(F.timestamp_micros("t"), "yyyy-MM")
    # by key first, so that a hot key is added up before the shuffle
    per_key = orphaned.groupBy("ref_table", month.alias("month"), "key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("ref_table", "month").agg(F.sum("n").alias("orphans"), F.count(F.lit(1)).alias("keys"))
