"""Which changes of a batch bring a name that another row holds at their time.

A row holds its name from the change that gave it until its next change of name or its deletion; rows of the table
hold theirs from the beginning. A change that wants a name is refused if, at its place in the order, the last row that took
the name is another one and still holds it. Who holds what depends on which earlier changes were refused, so verdicts
are worked out for all changes at once from the verdicts of the round before, until a round changes none. A verdict depends on
earlier changes only: whatever the first verdicts are, the first change is right after one round, and a state that stays
as it is equals that of applying the changes one by one. There are as many rounds as refusals hang on one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from .changes import numbered
from .running import last_before

BEFORE_ALL = -1
END = (1 << 63) - 1


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _spread(df: DataFrame) -> DataFrame:
    """For a join in a round: a broadcast would bring the rows to the driver anew in every round."""
    return df.hint("merge")


def _moments(known: DataFrame, batch: DataFrame, taken: DataFrame, first_id: int, low: int, high: int) -> DataFrame:
    """(key, name, user, seq, until, wants): who takes which name when, given refused changes; ``wants`` marks changes of the batch.

    ``until`` is null for a change that doesn't get the name, and ``END`` where it is held to the end.
    """
    rows = batch.join(_spread(taken.select("seq", F.lit(True).alias("no"))), "seq", "left")
    inserts = rows.where("op = 'insert'")
    born = numbered(inserts.where("no IS NULL"), "seq", "new_key", F.lit(first_id))
    born = _kept(born.select(F.col("new_key").alias("key"), "name", "user", "seq"), "numbered_inserts")
    starts = known.select("key", "name", "user", F.lit(BEFORE_ALL).cast("long").alias("seq")).unionByName(born)
    deletes = rows.where("op = 'delete'").select("key", F.col("seq").alias("gone"))
    deletes = deletes.join(_spread(starts.select("key", F.col("seq").alias("from"))), "key").where("gone > from")
    life = _kept(starts.join(_spread(deletes.groupBy("key").agg(F.min("gone").alias("gone"))), "key", "left"), "lives")
    given = rows.where("op IN ('update', 'patch') AND name IS NOT NULL").drop("user")
    given = given.join(_spread(life.select("key", F.col("user"), F.col("seq").alias("from"), "gone")), "key")
    given = given.where((F.col("seq") > F.col("from")) & (F.col("gone").isNull() | (F.col("seq") < F.col("gone"))))
    held = life.withColumn("no", F.lit(None).cast("boolean")).unionByName(given.select("key", "name", "user", "seq", "gone", "no"))
    held = _kept(held.withColumn("back", -F.col("seq")), "held_names")
    # the next change of name of the same row, looking from the end
    next_name = F.when(F.col("no").isNull(), F.col("seq"))
    held = last_before(held, ["key"], "back", next_name, "next", -high, -low)
    until = F.when(F.col("no").isNull(), F.coalesce(F.least("next", "gone"), F.lit(END)))
    moments = held.select("key", "name", "user", "seq", until.alias("until"))
    refused = inserts.where("no").select(F.lit(None).cast("long").alias("key"), "name", "user", "seq", F.lit(None).cast("long").alias("until"))
    return moments.unionByName(refused).withColumn("wants", F.col("seq") > BEFORE_ALL)


def taken_names(base: DataFrame, batch: DataFrame, name: str, user: str, key: str, last_id: int | None) -> DataFrame:
    """``seq`` of the refused ones of ``batch`` (seq, op, key, name, user), in which no seq is negative.

    Accepted inserts get the keys after ``last_id`` and the table's largest. The table is read once, for the few rows the batch can meet.
    """
    batch = _kept(batch, "named_changes")
    low, high = batch.agg(F.min("seq"), F.max("seq")).first()
    if low is None:
        return batch.select("seq")
    first_id = max(base.agg(F.max(key)).first()[0] or 0, last_id or 0) + 1
    wanted = batch.where("name IS NOT NULL").select(F.col("name").alias("_name")).distinct()
    met = batch.where("key IS NOT NULL").select(F.col("key").alias("_key")).distinct()
    rows = base.select(F.col(key).cast("long").alias("key"), F.col(name).alias("name"), F.col(user).alias("user"))
    rows = rows.join(wanted, rows["name"] == F.col("_name"), "left").join(met, rows["key"] == F.col("_key"), "left")
    known = _kept(rows.where("_name IS NOT NULL OR _key IS NOT NULL").select("key", "name", "user"), "known_names")
    taken = _kept(batch.select("seq").where(F.lit(False)), "taken_names")
    last = (0, None, None)  # what an empty table gives
    while True:
        moments = _kept(_moments(known, batch, taken, first_id, low, high), "name_moments")
        holder = F.when(F.col("until").isNotNull(), F.struct("key", "until"))
        seen = last_before(moments, ["name", "user"], "seq", holder, "holder", low, high)
        other = ~F.col("key").eqNullSafe(F.col("holder.key"))
        new = _kept(seen.where(F.col("wants") & other & (F.col("holder.until") > F.col("seq"))).select("seq"), "taken_names")
        mark = new.agg(F.count("seq"), F.bit_xor(F.xxhash64("seq")), F.sum("seq")).first()
        taken = new
        if mark == last:
            return taken
        last = mark
