"""What a leader decides, as relations over task state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.ranking import ranked, running
from weftline.operators.scan import ordered_scan

# The run states that end a run, and the legal edges between states.
TERMINAL = ("succeeded", "failed", "expired", "superseded", "cancelled", "lost", "orphaned")
EDGES = (
    ("scheduled", "queued"), ("scheduled", "cancelled"), ("scheduled", "expired"), ("scheduled", "superseded"), ("scheduled", "failed"),
    ("queued", "claimed"), ("queued", "cancelled"), ("queued", "expired"), ("queued", "superseded"), ("queued", "failed"),
    ("claimed", "queued"), ("claimed", "running"), ("claimed", "cancelled"), ("claimed", "expired"), ("claimed", "lost"),
    ("running", "succeeded"), ("running", "failed"), ("running", "cancelled"), ("running", "expired"), ("running", "lost"), ("running", "orphaned"),
)
#: The memory signal clears at this share of the soft limit, in percent.
CLEAR_PERCENT = 80


def insert_once(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first submission of each id; later ones record nothing."""
    first = F.min(F.struct(*order, *(c for c in df.columns if c not in order and c != key)))
    return df.groupBy(key).agg(first.alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in df.columns if c != key))


def admission(payload: Column, has_manifest: Column, has_key: Column, weight: Column, key_bytes: Column, in_use: Column, hard: int, limit: int) -> Column:
    """Why a submission is refused, by the first check that fails, or 'accepted'."""
    return (
        F.when(payload > hard, "payload_too_large")
        .when(has_manifest & has_key, "too_large")
        .when(weight > limit, "too_large")
        .when(has_key & (weight + key_bytes > limit), "key_backpressure")
        .when(in_use + payload > hard, "backpressure")
        .otherwise("accepted")
    )


def budget_in_order(df: DataFrame, keys: list[str], order: list[str], size: str, hard: int) -> DataFrame:
    """Greedy acceptance within each key: a row is accepted if it still fits; refused rows take no room."""

    def step(used: int, own: int) -> tuple[int, bool]:
        fits = used + own <= hard
        return (used + own if fits else used), fits

    rows = df.select(*keys, *order, F.col(size).cast("bigint").alias("_size"))
    return ordered_scan(rows, keys, [*order, "_size"], lambda: 0, step, ["_size"], "accepted", T.BooleanType()).drop("_size")


def hysteresis(df: DataFrame, keys: list[str], order: list[str], level: Column, soft: Column) -> DataFrame:
    """slow_down: raised above soft, cleared at CLEAR_PERCENT of it, else as before."""
    mark = F.when(level > soft, 1).when(100 * level <= CLEAR_PERCENT * soft, 0)
    return running(df, keys, order, mark, "last", "_mark").withColumn("slow_down", F.coalesce("_mark", F.lit(0)) == 1).drop("_mark")


def due_delayed(df: DataFrame, now: int) -> DataFrame:
    """Delayed tasks that may be released, with when they were due."""
    return df.where(F.col("delay_ms").isNotNull()).withColumn("due_ms", F.col("submitted_ms") + F.col("delay_ms")).where(F.col("due_ms") <= now)


def expired(df: DataFrame, claimed: DataFrame, now: int) -> DataFrame:
    """Tasks past their expiry that were never claimed."""
    due = df.where(F.col("expiry_ms").isNotNull()).withColumn("due_ms", F.col("submitted_ms") + F.col("expiry_ms")).where(F.col("due_ms") <= now)
    return due.join(claimed.select("task_id").distinct(), "task_id", "left_anti")


def fair_claim(df: DataFrame, policy: DataFrame, running: DataFrame, now: int, k: int) -> DataFrame:
    """The k tasks that one claim takes, and their place.

    Caps first; then starving tasks, oldest first; then priority tiers, in which each queue has
    weight turns a round. Of a queue only its first tasks can win, k or as many as the largest
    cap: each task of the scan keeps these before anything is shuffled, and the windows see no more.
    """
    most = max(k, policy.agg(F.max("max_running")).first()[0] or 0)  # a row for each queue
    df = df.join(F.broadcast(policy.select("queue", "age_ms")), "queue").withColumn("starving", F.col("age_ms").isNotNull() & (F.lit(now) - F.col("submitted_ms") > F.col("age_ms"))).drop("age_ms")
    df = df.withColumn("_first", F.row_number().over(W.partitionBy("queue", "starving").orderBy("ticket"))).where(F.col("_first") <= most).drop("_first")
    joined = df.join(F.broadcast(policy), "queue").join(F.broadcast(running), "queue", "left")  # a row for each queue
    room = F.col("max_running") - F.coalesce("running", F.lit(0))
    by_ticket = W.partitionBy("queue").orderBy("ticket")
    joined = joined.withColumn("_nth", F.row_number().over(by_ticket)).where(F.col("max_running").isNull() | (F.col("_nth") <= room))
    joined = joined.withColumn("_p", F.row_number().over(W.partitionBy("queue", "starving").orderBy("ticket")) - 1)
    ranked = joined.withColumns({"_tier": F.when(F.col("starving"), 0).otherwise(F.col("priority")), "_round": F.when(F.col("starving"), 0).otherwise(F.floor(F.col("_p") / F.col("weight")))})
    return ranked.orderBy(F.desc("starving"), F.desc("_tier"), "_round", "ticket").limit(k).select("task_id", "queue", "starving", F.col("_tier").alias("tier"), F.col("_round").alias("round"), "ticket")


def batch_fit(df: DataFrame, keys: list[str], order: list[str], size: str, room: int) -> DataFrame:
    """What a batch takes: leading rows that don't fit alone are passed over, then rows until the first that doesn't fit."""
    w = W.partitionBy(*keys).orderBy(*order)
    first = df.where(F.col(size) <= room).groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    after = df.join(first, keys).where(F.struct(*order) >= F.col("_first")).drop("_first")
    return after.withColumn("_run", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))).where(F.col("_run") <= room).drop("_run")


def requeued(events: DataFrame) -> DataFrame:
    """The waiting room of each queue after events (queue, at, task_id, expiry_ms, attempt): place and expiry.

    A task's newest event counts: tried again, it has gone to the back and has no expiry any more.
    """
    newest = events.groupBy("queue", "task_id").agg(F.max(F.struct("attempt", "at", "expiry_ms")).alias("e"))
    expiry = F.when(F.col("e.attempt") == 1, F.col("e.expiry_ms"))
    rows = newest.select("queue", "task_id", F.col("e.at").alias("_at"), F.col("e.attempt").alias("attempt"), expiry.alias("expiry_ms"))
    return ranked(rows, ["queue"], ["_at", "task_id"], "place").drop("_at")


def taken_queues(subscribed: Column, asked: Column) -> Column:
    """The queues of a claim: what the worker takes and is asked for; an empty list is every queue, and null is no queue in common."""
    both = F.array_sort(F.array_intersect(subscribed, asked))
    return F.when(F.size(subscribed) == 0, F.array_sort(asked)).when(F.size(asked) == 0, F.array_sort(subscribed)).when(F.size(both) > 0, both)


def arbitrate(asks: DataFrame, tasks: DataFrame) -> DataFrame:
    """Answers to named claims: the first asker of a claimable task wins; others are told why not.

    asks may say of the claimant is_leader, is_member, can_run and subscribed, and tasks of the task
    key_busy and queue_full; what isn't there is no hindrance.
    """
    defaults = {"is_leader": True, "is_member": True, "can_run": True, "subscribed": True}
    asks = asks.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in asks.columns})
    tasks = tasks.withColumns({c: F.lit(False) for c in ("key_busy", "queue_full") if c not in tasks.columns})
    able = F.col("is_leader") & F.col("is_member") & F.col("can_run") & F.col("subscribed")
    first = asks.where(able).groupBy("task_id").agg(F.min(F.struct("asked_ms", "worker")).alias("_first"))
    joined = asks.join(tasks, "task_id", "left").join(first, "task_id", "left")
    answer = (
        F.when(~F.col("is_leader"), "not_leader")
        .when(~F.col("is_member"), "not_member")
        .when(F.col("state").isNull(), "task_unknown")
        .when(F.col("state") == "superseded", "superseded")
        .when(F.col("state").isin(*TERMINAL), "finished")
        .when(F.col("state").isin("claimed", "running"), "already_selected")
        .when(F.col("state") == "scheduled", "not_ready")
        .when(~F.col("can_run"), "cannot_run")
        .when(~F.col("subscribed"), "not_subscribed")
        .when(F.col("key_busy"), "key_busy")
        .when(F.col("queue_full"), "queue_full")
        .when(F.col("_first") == F.struct("asked_ms", "worker"), "granted")
        .otherwise("already_selected")
    )
    return joined.select("task_id", "worker", answer.alias("answer"))


def illegal_transitions(history: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Changes of state that no edge allows."""
    spark = history.sparkSession
    edges = spark.createDataFrame(list(EDGES), "from_state string, state string")
    moved = history.withColumn("from_state", F.lag("state").over(W.partitionBy(*keys).orderBy(*order))).where("from_state is not null and from_state <> state")
    return moved.join(F.broadcast(edges), ["from_state", "state"], "left_anti")  # 21 rows


def retry_decision(newest: DataFrame, runs: DataFrame) -> DataFrame:
    """Whether a task whose newest run failed is tried again: losses don't count as tries."""
    lost = runs.where("state = 'lost'").groupBy("task_id").agg(F.count("*").alias("losses"))
    failed = newest.where("state = 'failed'").join(lost, "task_id", "left").withColumn("losses", F.coalesce("losses", F.lit(0)))
    return failed.withColumn("retried", F.col("attempt") - F.col("losses") <= F.col("max_retries"))


def overdue(held: DataFrame, silent: DataFrame, timeout_ms: int, now: int) -> DataFrame:
    """Claimed or running runs of workers that have been silent for the timeout."""
    live = held.where("state in ('claimed', 'running')")
    return live.join(silent, "worker").withColumn("due_ms", F.col("silent_from_ms") + timeout_ms).where(F.col("due_ms") <= now)


def loss_outcome(lost: DataFrame, waiting: DataFrame) -> DataFrame:
    """What becomes of runs lost with their worker, and whether they are replayed."""
    state = F.when(F.col("non_retriable") & ~F.col("ephemeral") & (F.col("state") == "running"), "orphaned").otherwise("lost")
    newer = waiting.select("definition", "coalescing_key").distinct().withColumn("_waits", F.lit(True))
    joined = lost.join(newer, ["definition", "coalescing_key"], "left").withColumn("becomes", state)
    return joined.withColumn("replayed", ~((F.col("becomes") == "orphaned") | F.col("ephemeral") | F.coalesce("_waits", F.lit(False)))).drop("_waits")


def forgettable(finished: DataFrame, held_composites: DataFrame, own_ttl: str, shard_ttl_ms: int, now: int) -> DataFrame:
    """Finished tasks past their own or the shard's retention whose composite, if any, is not held."""
    due = finished.where(F.col("finished_ms") + F.coalesce(F.col(own_ttl), F.lit(shard_ttl_ms)) <= now)
    return due.join(held_composites, "composite_id", "left_anti")


def blocked(tasks: DataFrame, runnable: DataFrame, ttl_ms: int, now: int) -> DataFrame:
    """Tasks newer than what workers run: skipped, or failed once blocked for the time allowed."""
    joined = tasks.join(F.broadcast(runnable), "definition", "left")  # a row for each definition
    too_new = F.coalesce(F.col("source_version") > F.col("runnable_version"), F.lit(False))
    return joined.where(too_new).withColumn("verdict", F.when(F.col("submitted_ms") + ttl_ms <= now, "MigrationError").otherwise("blocked"))


def claimable(df: DataFrame, now: int) -> DataFrame:
    """Rows that look claimable: not past expiry, queued, or scheduled with the delay over."""
    alive = F.col("expiry_ms").isNull() | (F.col("submitted_ms") + F.col("expiry_ms") > now)
    ready = (F.col("state") == "queued") | ((F.col("state") == "scheduled") & (F.col("delay_ms").isNull() | (F.col("submitted_ms") + F.col("delay_ms") <= now)))
    return df.where(alive & ready)


def status(state: Column) -> Column:
    """What a caller is told of the newest run's state; null where there is none."""
    return F.when(state.isNull(), "unknown").when(state.isin("scheduled", "queued", "claimed"), "pending").otherwise(state)


def newest_run(runs: DataFrame) -> DataFrame:
    """The run of each task with the highest attempt."""
    rest = [c for c in runs.columns if c not in ("task_id", "attempt")]
    return runs.groupBy("task_id").agg(F.max(F.struct("attempt", *rest)).alias("_r")).select("task_id", "_r.*")


def apply_reports(recorded: DataFrame, reports: DataFrame, asked_ms: int, in_flight_ms: int = 10_000) -> DataFrame:
    """What follows from a worker's report of its runs against the record of them."""
    both = recorded.join(reports.withColumn("_reported", F.lit(True)), ["run_id", "worker"], "full_outer")
    verdict = (
        F.when(F.col("state").isNull(), "rebuilt")
        .when(F.coalesce("_reported", F.lit(False)) & F.col("state").isin("claimed", "running"), "adopted")
        .when(F.coalesce("_reported", F.lit(False)) & (F.col("state") == "cancelled"), "tell_cancelled")
        .when(F.col("_reported").isNull() & F.col("state").isin("claimed", "running") & (F.col("decided_ms") + in_flight_ms > asked_ms), "in_flight")
        .when(F.col("_reported").isNull() & F.col("state").isin("claimed", "running"), "lost")
        .otherwise("ignored")
    )
    return both.select("run_id", "worker", verdict.alias("verdict"))


def backlog(df: DataFrame, key: str, order: list[str], refused: Column) -> DataFrame:
    """Buffered submissions that go through in order: a key's later ones wait behind one that is refused; those without a key don't wait."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    stopped = df.where(F.col(key).isNotNull()).withColumn("_stop", F.sum(refused.cast("bigint")).over(w)).where("_stop = 0").drop("_stop")
    return stopped.unionByName(df.where(F.col(key).isNull() & ~refused))
