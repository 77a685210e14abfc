"""Flows: named stages over an ordered DataFrame, and plain composition of transforms.

A flow is immutable; each method returns a new one.  Nothing runs until a
sink is called: stages only build one plan, which Catalyst optimises as a whole.  Schemas
are checked when a stage is added, since analysis is eager.
"""

from __future__ import annotations

import functools
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import errors, order as ordering, windows
from .state import State, cut_lineage

Transform = Callable[[DataFrame], DataFrame]


# -- composition ---------------------------------------------------------------------


def identity(df: DataFrame) -> DataFrame:
    return df


def pipe(*steps: Transform) -> Transform:
    """Left to right; at least one step."""
    if not steps:
        raise ValueError("pipe needs at least one step")
    return lambda df: functools.reduce(lambda d, f: d.transform(f), steps, df)


def compose(*steps: Transform) -> Transform:
    """Right to left; at least one step."""
    if not steps:
        raise ValueError("compose needs at least one step")
    return pipe(*reversed(steps))


def lift(name: str, expression: Callable[[DataFrame], Column] | Column) -> Transform:
    """A column expression as a transform that adds or replaces ``name``."""
    return lambda df: df.withColumn(name, expression(df) if callable(expression) else expression)


def lift_filter(predicate: Column) -> Transform:
    return lambda df: df.where(predicate)


def lift_flat_map(items: Column, name: str = "item", position: str = "pos") -> Transform:
    """An array expression as rows; empty arrays give none."""
    return lambda df: df.select("*", F.posexplode(items).alias(position, name))


def parallel(*steps: Transform) -> Callable[[DataFrame], tuple[DataFrame, ...]]:
    """Several results of one input.  A failure names its step."""

    def run(df: DataFrame) -> tuple[DataFrame, ...]:
        out = []
        for i, step in enumerate(steps):
            try:
                out.append(step(df))
            except Exception as e:
                raise errors.ProcessingError(f"Parallel step failed: {getattr(step, '__name__', i)}: {e}", "PARALLEL_STEP_ERROR", errors.retryable(str(e))) from e
        return tuple(out)

    return run


def merge(*sources: DataFrame) -> DataFrame:
    """All rows of all sources (UNION ALL by name), in no order."""
    if not sources:
        raise ValueError("merge needs a source; an empty one has a schema of its own")
    return functools.reduce(lambda a, b: a.unionByName(b), sources)


def zip_positions(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of two sides at equal positions; where one side is missing there is no row."""
    return left.join(right, list(by))


def hybrid(batch: Transform, streaming: Transform) -> Transform:
    """One step with a body for static and one for streaming frames."""
    return lambda df: streaming(df) if df.isStreaming else batch(df)


# -- flow --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Stage:
    name: str
    kind: str
    build_ms: float


@dataclass(frozen=True)
class Result:
    """success with data, or failure with an error; metadata tells stages and times."""

    success: bool
    data: object = None
    error: dict | None = None
    metadata: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Flow:
    """``df`` in ``order``; ``state`` holds each stage's result by name; ``context`` is any object."""

    df: DataFrame
    order: tuple[str | Column, ...] = ()
    context: object = None
    state: State = field(default_factory=State)
    stages: tuple[Stage, ...] = ()

    @classmethod
    def start(cls, df: DataFrame, order: Sequence[str | Column] = (), context: Callable[[], object] | object = None) -> Flow:
        """``context`` may be a function; it is called once per flow."""
        return cls(df, tuple(order), context() if callable(context) else context)

    def _next(self, name: str, kind: str, build: Callable[[], DataFrame], order: Sequence | None = None) -> Flow:
        if name in self.state:
            raise ValueError(f"there already is a stage named {name!r}")
        began = time.perf_counter()
        df = build()
        stage = Stage(name, kind, (time.perf_counter() - began) * 1000)
        return replace(self, df=df, order=self.order if order is None else tuple(order), state=self.state.with_key(name, df), stages=(*self.stages, stage))

    # whole-value and element stages
    def add(self, name: str, step: Callable[..., DataFrame]) -> Flow:
        """step(df) or step(df, state, context)."""
        wide = getattr(step, "__code__", None) is not None and step.__code__.co_argcount >= 3
        return self._next(name, "add", lambda: step(self.df, self.state, self.context) if wide else step(self.df))

    def map(self, name: str, **columns: Column) -> Flow:
        return self._next(name, "map", lambda: self.df.withColumns(columns))

    def select(self, name: str, *columns: str | Column, order: Sequence | None = None) -> Flow:
        return self._next(name, "map", lambda: self.df.select(*columns), order)

    def map_rows(self, name: str, function: Callable[[dict], object], data: T.DataType, index: str, strategy: errors.Strategy = errors.Strategy.FAIL_FAST, attempts: int = 1, backoff_ms: float = 0) -> Flow:
        """An opaque Python function per row in Arrow batches, as column ``result``; failures by ``strategy``."""
        return self._next(name, "map", lambda: errors.resolve(errors.attempt(self.df, function, data, index, attempts, backoff_ms), strategy))

    def flat_map(self, name: str, items: Column, item: str = "item", position: str = "pos") -> Flow:
        """Order becomes (parent's order, position)."""
        return self._next(name, "flat_map", lambda: lift_flat_map(items, item, position)(self.df), (*self.order, position))

    def flatten(self, name: str, column: str, item: str = "item", position: str = "pos") -> Flow:
        """One level of an array column."""
        return self.flat_map(name, F.col(column), item, position)

    def filter(self, name: str, predicate: Column) -> Flow:
        """Keeps rows where the predicate is true; an expression that fails fails the flow."""
        return self._next(name, "filter", lambda: self.df.where(predicate))

    def branch(self, name: str, condition: Callable[[DataFrame, State], bool] | bool, then: Transform, otherwise: Transform) -> Flow:
        """One condition per run; only the chosen side is planned."""
        chosen = condition(self.df, self.state) if callable(condition) else condition
        return self._next(name, "branch", lambda: (then if chosen else otherwise)(self.df))

    def tap(self, name: str, **metrics: Column) -> Flow:
        """Rows pass unchanged; metrics are observed when a sink runs (see observe.Observed)."""
        return self._next(name, "tap", lambda: self.df.observe(name, *(c.alias(n) for n, c in metrics.items())))

    # positions, batches, windows
    def take(self, name: str, n: int) -> Flow:
        return self._next(name, "take", lambda: ordering.take(self.df, n, self.order))

    def skip(self, name: str, n: int) -> Flow:
        return self._next(name, "skip", lambda: ordering.skip(self.df, n, self.order))

    def take_while(self, name: str, predicate: Column) -> Flow:
        return self._next(name, "take_while", lambda: ordering.take_while(self.df, predicate, self.order))

    def skip_while(self, name: str, predicate: Column) -> Flow:
        return self._next(name, "skip_while", lambda: ordering.skip_while(self.df, predicate, self.order))

    def batch(self, name: str, size: int) -> Flow:
        return self._next(name, "batch", lambda: windows.batch(self.df, size, self.order), ("batch",))

    def window(self, name: str, size: int, slide: int | None = None) -> Flow:
        return self._next(name, "window", lambda: windows.count_window(self.df, size, slide, self.order), ("window",))

    def checkpoint(self, name: str) -> Flow:
        """Fixes the present result; later stages read it instead of computing it again."""
        df = self.state.clone().with_checkpoint(name, self.df)
        return replace(self, df=df.stream(name), state=df, stages=(*self.stages, Stage(name, "checkpoint", 0.0)))

    # sinks
    def build(self) -> DataFrame:
        return self.df

    def _sorted(self) -> DataFrame:
        return self.df.orderBy(*self.order) if self.order else self.df

    def to_array(self) -> list[Row]:
        """All rows on the driver, in order: for results known to be small."""
        return self._sorted().collect()

    def for_each(self, function: Callable[[Row, int], None]) -> None:
        """Calls function(row, index) on the driver, in order, holding one partition at a time."""
        for i, row in enumerate(self._sorted().toLocalIterator()):
            function(row, i)

    def reduce(self, *aggregates: Column) -> Row:
        """An algebraic fold, as aggregates."""
        return self.df.agg(*aggregates).first()

    def fold(self, start: Column, step: Callable[[Column, Column], Column], columns: Sequence[str]) -> Column | object:
        """A left fold over all rows in order, inside one row: for small ordered inputs whose fold is not algebraic."""
        items = F.array_sort(F.collect_list(F.struct(*self.order, F.struct(*columns).alias("item"))))
        return self.df.agg(F.aggregate(F.transform(items, lambda x: x["item"]), start, step).alias("value")).first()["value"]

    def execute(self) -> Result:
        """Runs the flow once; errors become a failed result with a code.

        The data is a DataFrame fixed in the checkpoint folder, not rows on the driver; ``rows`` is its count.
        """
        trace, began = uuid.uuid4().hex, time.time()
        meta = {"trace_id": trace, "started": began, "stages": [{"name": s.name, "kind": s.kind, "span_id": uuid.uuid4().hex[:16], "build_ms": s.build_ms} for s in self.stages]}
        try:
            data = cut_lineage(self.df)
            rows = data.count()
            data = data.orderBy(*self.order) if self.order else data
        except errors.ProcessingError as e:
            return Result(False, error={"code": e.code, "message": str(e), "retryable": e.retryable}, metadata=meta | {"duration_ms": (time.time() - began) * 1000})
        except Exception as e:
            return Result(False, error={"code": "UNHANDLED_ERROR", "message": str(e), "retryable": errors.retryable(str(e))}, metadata=meta | {"duration_ms": (time.time() - began) * 1000})
        return Result(True, data, metadata=meta | {"duration_ms": (time.time() - began) * 1000, "rows": rows})

    def __iter__(self) -> Iterator[Row]:
        return self._sorted().toLocalIterator()


# -- step categories ------------------------------------------------------------------------

# Parts of step names, looked up in this order, and what is advised for each category.
CATEGORIES = {
    "io_bound": ("read", "write", "fetch", "api", "db", "database"),
    "aggregation": ("sort", "group", "aggregate", "sum", "count", "statistics"),
    "expansion": ("split", "chunk", "expand", "flatten", "flatmap"),
    "reduction": ("filter", "dedupe", "sample", "limit", "take"),
    "stateful": ("cache", "memo", "state", "rate", "throttle"),
}
ADVICE = {"pure_transform": (True, 0.9, "to_streaming"), "io_bound": (True, 0.95, "to_streaming"), "expansion": (True, 0.9, "manual"), "reduction": (True, 0.8, "hybrid"), "stateful": (True, 0.7, "manual"), "aggregation": (False, 0.3, "keep_batch")}


def categorize(name: Column) -> Column:
    """The category that a step's name suggests."""
    low, out = F.lower(name), None
    for category, parts in CATEGORIES.items():
        hit = functools.reduce(lambda a, b: a | b, (low.contains(p) for p in parts))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("pure_transform")


def advise(name: str) -> dict:
    """Category, whether streaming is recommended, how strongly, and how."""
    low = name.lower()
    category = next((c for c, parts in CATEGORIES.items() if any(p in low for p in parts)), "pure_transform")
    recommended, strength, approach = ADVICE[category]
    return {"category": category, "recommended": recommended, "strength": strength, "approach": approach}


# -- registry --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Registered:
    name: str
    build: Callable[..., DataFrame]
    input: T.StructType | None = None
    output: T.StructType | None = None
    tags: tuple[str, ...] = ()
    description: str = ""


def _misfit(what: str, df: DataFrame, schema: T.StructType | None) -> str | None:
    if schema is None:
        return None
    have = {f.name: f.dataType for f in df.schema.fields}
    bad = [f.name for f in schema.fields if have.get(f.name) != f.dataType]
    return f"{what} does not fit its schema: {', '.join(bad)}" if bad else None


class Registry:
    """Named flows with schemas and tags."""

    def __init__(self) -> None:
        self._flows: dict[str, Registered] = {}

    def register(self, name: str, build: Callable[..., DataFrame], input: T.StructType | None = None, output: T.StructType | None = None, tags: Sequence[str] = (), description: str = "") -> None:
        if name in self._flows:
            raise ValueError(f"a flow named {name!r} is already registered")
        self._flows[name] = Registered(name, build, input, output, tuple(tags), description)

    def get(self, name: str) -> Registered | None:
        return self._flows.get(name)

    def names(self) -> list[str]:
        return list(self._flows)

    def by_tags(self, *tags: str) -> list[Registered]:
        """Flows with any of the tags."""
        return [f for f in self._flows.values() if set(tags) & set(f.tags)]

    def execute(self, name: str, df: DataFrame, **arguments) -> Result:
        """Checks both schemas; never raises."""
        flow = self._flows.get(name)
        if flow is None:
            return Result(False, error={"code": "NOT_FOUND", "message": f"no flow named {name!r}", "retryable": False})
        try:
            problem = _misfit("input", df, flow.input)
            if problem:
                return Result(False, error={"code": "INVALID_INPUT", "message": problem, "retryable": False})
            out = flow.build(df, **arguments)
            problem = _misfit("output", out, flow.output)
            if problem:
                return Result(False, error={"code": "INVALID_OUTPUT", "message": problem, "retryable": False})
            return Result(True, out, metadata={"flow": name})
        except Exception as e:
            return Result(False, error={"code": "EXECUTION_ERROR", "message": str(e), "retryable": errors.retryable(str(e))})
