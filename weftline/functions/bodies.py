"""User bodies in Python: vectorised tasks with retries, timeouts, hooks and outcomes.

Spark may run a body again after a loss, so bodies are to be idempotent; an at-most-once body
can't be promised here and `ephemeral` is only recorded. A body past its timeout is stopped where it
runs in the worker's main thread, by a timer signal; elsewhere its late result counts as a timeout.
"""

from __future__ import annotations

import asyncio
import contextlib
import inspect
import pickle
import signal
import threading
import time
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from dataclasses import dataclass
from typing import get_type_hints

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Body:
    """A function of one value, sync or async, with its options."""

    function: Callable
    returns: str
    retries: int = 0
    timeout_s: float | None = None
    process_init: Callable[[], None] | None = None
    before_run: Callable[[dict], None] | None = None
    after_run: Callable[[dict, bool], None] | None = None
    ephemeral: bool = False
    name: str | None = None
    queue: str | None = None
    retriable: bool = True
    result_ttl_s: float | None = None
    cancel_grace_s: float = 5.0

    def __post_init__(self) -> None:
        if len(inspect.signature(self.function).parameters) != 1:
            raise TypeError("a task takes exactly one argument")
        if self.retries < 0 or self.cancel_grace_s <= 0 or min(self.timeout_s or 1, self.result_ttl_s or 1) <= 0:
            raise ValueError("retries, times and the grace are not negative, and times not zero")

    @property
    def title(self) -> str:
        return self.name or self.function.__qualname__

    def local(self, value: object) -> object:
        """The body here and now; value and result go through a serializer, as they would on the way to a worker."""
        out = self.function(pickle.loads(pickle.dumps(value)))
        return pickle.loads(pickle.dumps(asyncio.run(out) if inspect.isawaitable(out) else out))


_info: ContextVar[dict] = ContextVar("run_info")


def run_info() -> dict:
    """What a body may know of its run: Spark's partition and attempt, and which try this is. LookupError outside a run."""
    return _info.get()


@contextlib.contextmanager
def _alarm(seconds: float | None, grace: float) -> Iterator[None]:
    """TimeoutError in the code inside once so many seconds have passed, and again after each grace that it lasts longer."""
    if seconds is None or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_: object) -> None:
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds, grace)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def task(returns: str, **options: object) -> Callable[[Callable], Body]:
    """Declare a body: its Spark type, and retries, timeout_s, hooks."""
    return lambda function: Body(function, returns, **options)


def _attempt(body: Body, value: object, info: dict) -> tuple[bool, object, str | None, str | None]:
    """(ok, value, failure kind, failure message) of one attempt; late results count as a timeout."""
    began = time.monotonic()
    try:
        _info.set(info)
        with _alarm(body.timeout_s, body.cancel_grace_s):
            out = body.function(value)
        if inspect.isawaitable(out):
            out = asyncio.run(asyncio.wait_for(out, body.timeout_s))
        if body.timeout_s is not None and time.monotonic() - began > body.timeout_s:
            return False, None, "TimeoutError", f"past {body.timeout_s} s"
        return True, out, None, None
    except (TimeoutError, asyncio.TimeoutError):
        return False, None, "TimeoutError", f"past {body.timeout_s} s"
    except Exception as e:  # a body's error is its outcome
        return False, None, type(e).__name__, str(e)


def run(df: DataFrame, body: Body, on: str, out: str = "outcome") -> DataFrame:
    """df with struct<ok, value, failure_kind, failure_message, attempts> of the body over a column."""
    fields = f"ok boolean, value {body.returns}, failure_kind string, failure_message string, attempts int"

    @F.pandas_udf(fields)
    def over(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        info = {"partition": context.partitionId(), "attempt": context.attemptNumber()} if context else {}
        if body.process_init:
            body.process_init()
        for batch in batches:
            rows = []
            for value in batch:
                for n in range(1, (body.retries if body.retriable else 0) + 2):
                    if body.before_run:
                        body.before_run(info | {"try": n})
                    result = _attempt(body, value, info | {"try": n})
                    if body.after_run:
                        body.after_run(info | {"try": n}, result[0])
                    if result[0]:
                        break
                rows.append((*result, n))
            yield pd.DataFrame(rows, columns=["ok", "value", "failure_kind", "failure_message", "attempts"])

    return df.withColumn(out, over(F.col(on)))


@dataclass(frozen=True)
class Reducer:
    """A function (item, previous) -> previous whose annotations are checked when it is declared."""

    function: Callable
    returns: str
    associative: bool = False
    tree: bool | None = None
    merge: Callable | None = None
    ephemeral: bool = False

    def __post_init__(self) -> None:
        hints = get_type_hints(self.function)
        names = list(inspect.signature(self.function).parameters)
        if len(names) != 2 or set(names) | {"return"} != set(hints):
            raise TypeError("a reducer takes an item and what came before, and annotates both and its result")
        item, previous, result = hints[names[0]], hints[names[1]], hints["return"]
        if self.ephemeral:
            raise TypeError("a reducer is a durable task")
        if previous != result:
            raise TypeError(f"a reducer returns what it takes as previous: {previous} is not {result}")
        if self.associative and item != previous:
            raise TypeError("an associative reducer folds its own results, so item and previous are of one type")
        if self.associative and self.merge is not None:
            raise TypeError("an associative reducer needs no merge")
        if self.in_tree and not self.associative and self.merge is None:
            raise TypeError("a tree needs an associative reducer or a merge")
        if self.merge is not None and not self.in_tree:
            raise TypeError("a merge is for a tree")

    @property
    def in_tree(self) -> bool:
        return self.associative if self.tree is None else self.tree


def reducer(returns: str, **options: object) -> Callable[[Callable], Reducer]:
    """Declare a reducer: its Spark type, and associative, tree, merge."""
    return lambda function: Reducer(function, returns, **options)


def reduce(df: DataFrame, keys: list[str], index: str, value: str, body: Reducer, out: str = "result") -> DataFrame:
    """Each key's values folded in order by a reducer of Python, the first item to begin with; rows stream, none is held."""
    from pyspark.sql.types import _parse_datatype_string

    from weftline.operators.scan import ordered_scan

    def step(previous: object, item: object) -> tuple[object, object]:
        now = item if previous is None else body.function(item, previous)
        return now, now

    rows = df.select(*keys, F.col(index).alias("_i"), F.col(value).alias("_v"))
    running = ordered_scan(rows, keys, ["_i"], lambda: None, step, ["_v"], out, _parse_datatype_string(body.returns))
    return running.groupBy(*keys).agg(F.count("*").alias("items"), F.max_by(out, "_i").alias(out))
