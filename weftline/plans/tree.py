"""Step plans: typed trees that are checked when built and compiled to DataFrame columns.

A plan is Task, Bound, Map, Group, Flow or Reduce. Building one checks shapes and reducers; no
data is looked at. compile() turns a plan into a column over the input, so that Catalyst sees
the whole composition as one projection.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEMS, VALUE = "items", "value"


class PlanError(ValueError):
    """A plan that can't be right whatever the data."""


@dataclass(frozen=True)
class Shape:
    """What a step takes or returns: a value of a type, or a list of items; None where unknown."""

    kind: str
    type: T.DataType | None = None

    def fits(self, other: Shape) -> bool:
        """Whether what has this shape may be fed to a step that takes other."""
        if self.kind != other.kind:
            return False
        return self.type is None or other.type is None or self.type == other.type


class Step:
    takes: Shape
    gives: Shape
    bound = False

    def column(self, given: Column) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Task(Step):
    """A body over one value."""

    body: Callable[[Column], Column]
    input: T.DataType | None = None
    output: T.DataType | None = None

    def __post_init__(self) -> None:
        if len(inspect.signature(self.body).parameters) != 1:
            raise PlanError("a task takes exactly one argument")

    @property
    def takes(self) -> Shape:
        return Shape(VALUE, self.input)

    @property
    def gives(self) -> Shape:
        return Shape(ITEMS, self.output.elementType) if isinstance(self.output, T.ArrayType) else Shape(VALUE, self.output)

    def column(self, given: Column) -> Column:
        return self.body(given)

    def bind(self, value: object) -> Bound:
        return Bound(self, value)

    @property
    def map(self) -> Map:
        return Map(self)


@dataclass(frozen=True)
class Bound(Step):
    """A task with a constant input: what came before is ignored."""

    task: Task
    value: object
    bound = True

    @property
    def takes(self) -> Shape:
        return Shape(VALUE)

    @property
    def gives(self) -> Shape:
        return self.task.gives

    def column(self, given: Column) -> Column:
        value = self.value if isinstance(self.value, Column) else F.lit(self.value)
        return self.task.body(value.cast(self.task.input) if self.task.input else value)


@dataclass(frozen=True)
class Map(Step):
    """A task over each item of a list, results in order."""

    task: Task

    @property
    def takes(self) -> Shape:
        return Shape(ITEMS, self.task.input)

    @property
    def gives(self) -> Shape:
        return Shape(ITEMS, self.task.output)

    def column(self, given: Column) -> Column:
        return F.transform(given, self.task.body)


@dataclass(frozen=True)
class Group(Step):
    """Different members over the same input; a struct of their results in member order."""

    members: tuple[Step, ...]

    def __post_init__(self) -> None:
        if not self.members:
            raise PlanError("a group has members")

    @property
    def takes(self) -> Shape:
        return self.members[0].takes

    @property
    def gives(self) -> Shape:
        return Shape(VALUE)

    def column(self, given: Column) -> Column:
        return F.struct(*(m.column(given).alias(f"m{k}") for k, m in enumerate(self.members)))


@dataclass(frozen=True)
class Reduce(Step):
    """A fold over items; a seed starts it. A tree folds chunks side by side and needs associativity or a merge."""

    merge: Callable[[Column, Column], Column]
    seed: object = None
    associative: bool = False
    tree: bool = False
    combine: Callable[[Column, Column], Column] | None = None
    chunk: int = 64
    type: T.DataType | None = None

    def __post_init__(self) -> None:
        if len(inspect.signature(self.merge).parameters) != 2:
            raise PlanError("a reducer takes what came before and an item")
        if self.tree and self.associative == (self.combine is not None):
            raise PlanError("a tree needs either an associative reducer or a merge")
        if self.chunk < 1:
            raise PlanError("a chunk holds an item at least")

    @property
    def takes(self) -> Shape:
        return Shape(ITEMS, self.type)

    @property
    def gives(self) -> Shape:
        return Shape(VALUE, self.type)

    def column(self, given: Column) -> Column:
        from weftline.operators.reduce import guarded, pairwise

        seed = None if self.seed is None else F.lit(self.seed).cast(self.type) if self.type else F.lit(self.seed)
        if not self.tree:
            return guarded(given, self.merge, seed)
        n = F.ceil(F.size(given) / self.chunk).cast("int")
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda k: guarded(F.slice(given, k * self.chunk + 1, F.lit(self.chunk)), self.merge, seed))
        return F.when(F.size(given) == 0, guarded(given, self.merge, seed)).otherwise(pairwise(parts, self.combine or self.merge))


@dataclass(frozen=True)
class Flow(Step):
    """Stages in sequence; the result is a struct of every stage's result."""

    stages: tuple[Step, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if not self.stages:
            raise PlanError("a flow has stages")
        if isinstance(self.stages[0], Reduce):
            raise PlanError("a flow doesn't start with a reduce")
        for before, after in zip(self.stages, self.stages[1:], strict=False):
            if not after.bound and not before.gives.fits(after.takes):
                raise PlanError(f"{before.gives} doesn't fit {after.takes}")

    @property
    def takes(self) -> Shape:
        return self.stages[0].takes

    @property
    def gives(self) -> Shape:
        return Shape(VALUE)

    def column(self, given: Column) -> Column:
        results: list[Column] = []
        for stage in self.stages:
            results.append(stage.column(results[-1] if results else given))
        return F.struct(*(r.alias(f"s{k}") for k, r in enumerate(results)))


def group(*members: Step) -> Group:
    return Group(members)


def flow(*stages: Step) -> Flow:
    return Flow(stages)


def describe(step: Step) -> str:
    """The plan as one line, for logs and tests."""
    if isinstance(step, Flow):
        return f"flow({', '.join(map(describe, step.stages))})"
    if isinstance(step, Group):
        return f"group({', '.join(map(describe, step.members))})"
    if isinstance(step, Map):
        return f"map({describe(step.task)})"
    return "bound" if isinstance(step, Bound) else "reduce" if isinstance(step, Reduce) else "task"
