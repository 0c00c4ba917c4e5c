"""Replicated records: versions, certainty, placement, discovery, quorums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.ranking import running
from weftline.operators.scan import ordered_scan

REPLICAS = 3
#: Ids in one answer to a worker that looks for work.
STEAL_LIMIT = 256


def last_writer_wins(df: DataFrame, key: str, version: list[str], keep: list[str]) -> DataFrame:
    """The newest revision of each record; versions compare field by field."""
    row = F.struct(*version, *keep)
    return df.groupBy(key).agg(F.max(row).alias("_r"), F.count("*").alias("revisions")).select(key, "_r.*", "revisions")


def put_class(df: DataFrame, key: str, version: list[str], order: str, content: str) -> DataFrame:
    """What each put of a record does, in the order of arrival: stored, unchanged, older or conflicting."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    v = F.struct(*version)
    held = F.max(v).over(before)
    # of puts with the held version, the first to arrive is what is held
    first = F.first(content).over(W.partitionBy(key, *version).orderBy(order))
    word = F.when(held.isNull() | (v > held), "stored").when(v < held, "older").when(F.col(content) == first, "unchanged").otherwise("conflicting")
    return df.withColumn("put", word)


def newest_reachable(reports: DataFrame, key: str, version: list[str], reachable: Column) -> DataFrame:
    """The newest version that some member still holds, else the newest of all."""
    v = F.struct(*version)
    out = reports.groupBy(key).agg(F.max(F.when(reachable, v)).alias("_reach"), F.max(v).alias("_any"))
    return out.select(key, F.coalesce("_reach", "_any").alias("_v"), F.col("_reach").isNotNull().alias("reachable")).select(key, "_v.*", "reachable")


def certain(placed: DataFrame, voters: DataFrame, key: str) -> DataFrame:
    """Whether enough holders answered that no newer version can exist; placed: key, worker."""
    joined = placed.join(F.broadcast(voters), "worker", "left")  # voters of a shard are few
    answered, member = F.coalesce("answered", F.lit(False)), F.coalesce("is_member", F.lit(False))
    out = joined.groupBy(key).agg(F.count("*").alias("placed"), F.count_if(answered).alias("heard"), F.bool_and(~member | answered).alias("_all"))
    quorum = F.floor(F.col("placed") / 2) + 1
    return out.select(key, "placed", "heard", ((F.col("heard") > F.col("placed") - quorum) | F.col("_all")).alias("certain"))


def missing(reported: DataFrame, held: DataFrame, key: str, version: list[str]) -> DataFrame:
    """Records whose newest reported version is not held."""
    newest = reported.groupBy(key).agg(F.max(F.struct(*version)).alias("_v")).select(key, "_v.*")
    return newest.join(held.select(key, *version), [key, *version], "left_anti")


def one_report(df: DataFrame, run: str, order: list[str]) -> DataFrame:
    """The newest word on each run."""
    w = W.partitionBy(run).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _key_hash(c: Column) -> Column:
    return F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 15), 16, 10).cast("bigint")


def placement(keys: DataFrame, key: str, workers: DataFrame, replicas: int = REPLICAS) -> DataFrame:
    """The replicas nearest to each key by XOR distance, with rank, and their quorum.

    The workers travel inside each row as one small array, so a key's candidates are ranked in
    place: nothing is shuffled and no row is repeated for each worker.
    """
    near = workers.agg(F.array_sort(F.collect_list(F.struct(_key_hash(F.col("worker")).alias("h"), "worker"))).alias("_w"))
    ranked = F.array_sort(F.transform("_w", lambda x: F.struct(x["h"].bitwiseXOR(F.col("_h")).alias("d"), x["worker"].alias("worker"))))
    placed = keys.withColumn("_h", _key_hash(F.col(key))).join(F.broadcast(near), F.lit(True))  # one row
    placed = placed.withColumn("_r", F.slice(ranked, 1, replicas))
    quorum = (F.floor(F.size("_r") / 2) + 1).cast("bigint").alias("quorum")
    return placed.select(*keys.columns, quorum, F.posexplode("_r").alias("rank", "_p")).select(*keys.columns, "quorum", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("_p.worker").alias("worker"))


def moved(keys: DataFrame, key: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys that are placed elsewhere after the voters changed, with whom they lose and gain."""
    a, b = (placement(keys, key, w).select(key, "worker") for w in (before, after))
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), [key, "worker"], "full_outer")
    return both.groupBy(key).agg(F.count_if(F.col("_b").isNull()).alias("lost"), F.count_if(F.col("_a").isNull()).alias("gained")).where("lost + gained > 0")


def repair_next(moved_keys: DataFrame, in_flight: DataFrame, key: str, most: int) -> DataFrame:
    """The moved keys to repair next, in order: as many as leave at most so many in flight."""
    busy = in_flight.select(key).distinct()
    room = max(0, most - busy.limit(most).count())
    return moved_keys.join(busy, key, "left_anti").orderBy(key).limit(room).select(key)


def joint_quorum(placed: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a write is stored by a quorum of every placement that it must satisfy; placed: keys, side, worker."""
    joined = placed.join(stored.withColumn("_s", F.lit(1)), [*keys, "worker"], "left")
    sides = joined.groupBy(*keys, "side").agg(F.count("*").alias("_n"), F.count("_s").alias("_k"))
    return sides.groupBy(*keys).agg(F.bool_and(F.col("_k") >= F.floor(F.col("_n") / 2) + 1).alias("durable"), F.sum("_k").alias("copies"))


def released_effects(writes: DataFrame, effect: str, stored: Column) -> DataFrame:
    """Effects all of whose writes are stored."""
    return writes.groupBy(effect).agg(F.count("*").alias("writes"), F.bool_and(stored).alias("_all")).where("_all").drop("_all")


def write_after(rows: DataFrame, successor: str, stored: str) -> DataFrame:
    """Superseded rows that may be written: their successor is stored."""
    done = rows.where(F.col(stored)).select(F.col("task_id").alias(successor))
    return rows.where(F.col(successor).isNotNull()).join(done, successor, "left_semi")


def ranked_candidates(df: DataFrame, key: str, me: str, limit: int) -> DataFrame:
    """Candidates by rank, then XOR distance to a worker, then age."""
    mine = F.conv(F.substring(F.sha2(F.lit(me), 256), 1, 15), 16, 10).cast("bigint")
    return df.withColumn("distance", _key_hash(F.col(key)).bitwiseXOR(mine)).orderBy(F.desc("rank"), "distance", "submitted_ms", key).limit(limit)


def staged_discovery(stages: list[DataFrame], key: str, order: list[str], limit: int) -> DataFrame:
    """Candidates from one stage after the other, each tried once, at the first stage that has it, up to limit."""
    tagged = None
    for k, df in enumerate(stages):
        part = df.withColumn("stage", F.lit(k))
        tagged = part if tagged is None else tagged.unionByName(part)
    once = tagged.groupBy(key).agg(F.min(F.struct("stage", *order)).alias("_s")).select(key, "_s.*")
    return once.orderBy("stage", *order, key).limit(limit)


def discovery_in_room(candidates: DataFrame, key: str, order: list[str], size: str, room: int, limit: int, page: int = 1024) -> DataFrame:
    """Of candidates in order (order and key tell them apart) those that one claimant takes: at most limit, and each only if its size still fits.

    Pages of candidates that still fit come to the driver, so each page's first is taken; at most
    limit rows are kept.
    """
    place, taken, last = [*order, key], [], None
    rows = candidates.select(*dict.fromkeys([*place, size]))
    while len(taken) < limit:
        fitting = rows.where(F.col(size) <= room)
        if last is not None:
            after = F.struct(*place) > F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(place, last, strict=True)))
            fitting = fitting.where(after)
        found = fitting.orderBy(*place).limit(page).collect()  # page rows at most
        for r in found:
            if len(taken) < limit and r[size] <= room:
                taken.append((r[key],))
                room -= r[size]
        if len(found) < page:
            break
        last = [found[-1][c] for c in place]
    return candidates.sparkSession.createDataFrame(taken, T.StructType([rows.schema[key]]))


def steal(df: DataFrame, urgent: Column, limit: int = STEAL_LIMIT) -> DataFrame:
    """The ids that a worker is offered: urgent ones first, then the oldest."""
    return df.withColumn("urgent", urgent).orderBy(F.desc("urgent"), "submitted_ms", "task_id").limit(limit)


def page_after(df: DataFrame, key: list[str], after: tuple, limit: int) -> DataFrame:
    """The next page of a keyset scan."""
    last = F.struct(*(F.lit(x).cast(df.schema[k].dataType).alias(k) for k, x in zip(key, after, strict=True)))
    return df.where(F.struct(*key) > last).orderBy(*key).limit(limit)


def set_digest(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """A digest of each key's set of ids, the same for the same set."""
    ids = F.array_sort(F.collect_set(F.col(member).cast("string")))
    coded = F.array_join(F.transform(ids, lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)), "")
    return df.groupBy(*keys).agg(F.sha2(coded, 256).alias("digest"), F.count_distinct(member).alias("members"))


def lasting_drift(beats: DataFrame, keys: list[str], order: str, differs: Column, least: int = 2) -> DataFrame:
    """Stretches of consecutive heartbeats that disagree, of at least so many."""
    marked = running(beats.withColumn("_bad", differs), keys, [order], (~F.col("_bad")).cast("bigint"), "sum", "_island")
    return marked.where("_bad").groupBy(*keys, "_island").agg(F.count("*").alias("beats"), F.min(order).alias("from_beat"), F.max(order).alias("to_beat")).where(F.col("beats") >= least).drop("_island")


def drift_asks(beats: DataFrame, keys: list[str], at: str, differs: str, persist: int, spacing: int) -> DataFrame:
    """Heartbeats at which a worker is asked anew: it has differed for persist since it began to, and was not asked within spacing."""

    def step(state: tuple[int | None, int | None], now: int, bad: bool) -> tuple[tuple[int | None, int | None], bool]:
        since, asked = state
        if not bad:
            return (None, asked), False
        since = now if since is None else since
        due = now - since >= persist and (asked is None or now - asked >= spacing)
        return (since, now if due else asked), due

    return ordered_scan(beats, keys, [at], lambda: (None, None), step, [at, differs], "due", T.BooleanType()).where("due").drop("due")


def rebuild(reports: DataFrame, workers: DataFrame, key: str, holder: str, version: list[str], order: str) -> DataFrame:
    """A new leader's records from what holders report (finished): one pipeline of deduplication, newest version, certainty and legality.

    Of each holder the newest word on a record counts, of equal versions the later report. A record
    is finished if its newest version is; one whose older version was finished and whose newest
    isn't has gone back illegally. Certainty is that of the workers on which the record is placed.
    """
    word = F.max(F.struct(*version, order, "finished")).alias("w")
    words = reports.groupBy(key, holder).agg(word).select(key, F.struct(*(F.col(f"w.{c}").alias(c) for c in version)).alias("v"), "w.finished")
    folded = words.groupBy(key, "v").agg(F.count("*").alias("holders"), F.bool_or("finished").alias("finished"))
    newest = folded.groupBy(key).agg(F.max(F.struct("v", "holders", "finished")).alias("n"), F.count_if("finished").alias("ended"))
    state = newest.select(key, *(F.col(f"n.v.{c}").alias(c) for c in version), F.col("n.holders").alias("holders"), F.col("n.finished").alias("finished"), (~F.col("n.finished") & (F.col("ended") > 0)).alias("illegal"))
    sure = certain(placement(state.select(key), key, workers), workers, key)
    return state.join(sure.select(key, "certain"), key)


def waiting_and_holder(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The waiting and the held generation of each key: the newest task in either state."""
    pick = lambda states: F.max(F.when(F.col("state").isin(*states), F.struct(order, "task_id")))["task_id"]
    return df.groupBy(*keys).agg(pick(("scheduled", "queued")).alias("waiting"), pick(("claimed", "running")).alias("holder"))


def hand_off(held: DataFrame, key: str, workers: DataFrame, me: int) -> DataFrame:
    """To whom a draining worker hands each of its records: those placed now, but itself."""
    return placement(held, key, workers).where(F.col("worker") != me)


def quorum_tally(votes: DataFrame, sides: DataFrame) -> DataFrame:
    """Votes counted once a worker among those admitted by a side's generation; passed if every side has a majority.

    votes: ballot, worker; sides: side, worker, admitted (generation), low, high.
    """
    once = votes.select("ballot", "worker").distinct()
    entitled = sides.where(F.col("admitted").between(F.col("low"), F.col("high")))
    total = entitled.groupBy("side").agg(F.count("*").alias("voters"))
    counted = once.join(F.broadcast(entitled), "worker").groupBy("ballot", "side").agg(F.count("*").alias("counted"))  # voters of a shard are few
    every = once.select("ballot").distinct().join(F.broadcast(total), F.lit(True)).join(counted, ["ballot", "side"], "left")  # two sides
    every = every.withColumn("counted", F.coalesce("counted", F.lit(0)))
    return every.groupBy("ballot").agg(F.sum("counted").alias("counted"), F.bool_and(2 * F.col("counted") > F.col("voters")).alias("passed"))


def roll_call(df: DataFrame, keys: list[str]) -> DataFrame:
    """The winner of each roll call: the lowest (timestamp, worker)."""
    return df.groupBy(*keys).agg(F.min(F.struct("at", "worker")).alias("_w")).select(*keys, F.col("_w.worker").alias("winner"), F.col("_w.at").alias("at"))
