"""Batched inference: stages, their chaining, and failure per batch.

A *stage* is a function over a list of inputs. Whole requests are packed into batches (see
:mod:`queuemill.operators.packing`), each stage is called once per batch, and its answers are cut back
per request while the batch is still in hand, so no shuffle is needed to scatter them. Chained stages
run in one pass over the sorted rows: what a stage finishes flows into the next stage's open batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import partial
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema, to_arrow_type

from queuemill.functions.scalars import l2_normalize
from queuemill.operators import models
from queuemill.operators.packing import (
    PackRule,
    check_sizes,
    key_runs,
    number_batches,
    pack_ordered,
    sorted_by_queue,
)
from queuemill.operators.ordering import ordered_segments
from queuemill.session import cut_lineage, shuffle_partitions

Predictor = Callable[..., Sequence[Any]]
NO_INPUTS = "no inputs"
HOT_REQUESTS = 50_000  # a queue of so few is soon done by one task; sorting and storing it first costs more


def _type(returns: T.DataType | str) -> T.DataType:
    return T.DataType.fromDDL(returns) if isinstance(returns, str) else returns


@dataclass(frozen=True)
class Stage:
    """One step of a chain: a batch function, or a Column expression over a single input."""

    name: str
    returns: T.DataType | str
    batch_size: int = 32
    load: Callable[[], Predictor] | None = None
    expression: Callable[[Column], Column] | None = None
    key: str | None = None  # of a model that a worker keeps
    attempt: Callable[[Column], Column] | None = None

    @classmethod
    def from_function(
        cls, fn: Predictor, returns: T.DataType | str, batch_size: int = 32, name: str | None = None
    ) -> Stage:
        """``fn(inputs, batch_size=B)`` returns one answer per input, in order."""
        return cls(name or fn.__name__, returns, batch_size, load=lambda: fn)

    @classmethod
    def from_loader(
        cls, load: Callable[[], Predictor], returns: T.DataType | str, batch_size: int = 32,
        name: str | None = None,
    ) -> Stage:
        """``load()`` builds the predictor (reads a model) on the executor, once per Python worker: see
        :mod:`queuemill.operators.models`."""
        return cls(name or load.__name__, returns, batch_size, load=load, key=models.content_key(load))

    @classmethod
    def from_expression(
        cls, expression: Callable[[Column], Column], returns: T.DataType | str, name: str = "expression",
        attempt: Callable[[Column], Column] | None = None,
    ) -> Stage:
        """A pure function of one input as a Column: stays in the JVM and needs no batches.

        An input for which ``expression`` raises ends the job. ``attempt`` is its twin that gives NULL there (made of
        ``try_add``, ``try_cast`` and the like) and the same answers elsewhere: with it, a request with such an input
        fails by itself. An input that is not NULL then may not have NULL as its answer.
        """
        return cls(name, returns, expression=expression, attempt=attempt)

    def open(self) -> Predictor:
        """The predictor, on the worker that calls it."""
        return self.load() if self.key is None else models.loaded(self.key, self.load)

    def typed(self) -> Stage:
        """The same stage with its DDL text resolved, which needs a session."""
        return replace(self, returns=_type(self.returns))


def identity_stage() -> Stage:
    return Stage.from_expression(lambda x: x, "string", "identity")


def tag_stage(tag: int, returns: T.DataType | str) -> Stage:
    """Wrap each input as ``(tag, input)``; chained tags nest, the last one outermost."""
    wrapped = T.StructType(
        [T.StructField("stage", T.IntegerType()), T.StructField("value", _type(returns))]
    )
    return Stage.from_expression(
        lambda x: F.struct(F.lit(tag).alias("stage"), x.alias("value")), wrapped, f"tag_{tag}"
    )


# --- flat forms -----------------------------------------------------------------------------------


def flatten_inputs(df: DataFrame, inputs: str = "inputs") -> DataFrame:
    """One row per input, with its position in the request."""
    others = [name for name in df.columns if name != inputs]
    return df.select(*others, F.posexplode(inputs).alias("pos", "input"))


def scatter_results(
    df: DataFrame, output: str = "output", request_id: str = "request_id", pos: str = "pos"
) -> DataFrame:
    """Put flat answers back into one list per request, in input order.

    A group is one request's inputs, which came from a single row and fit into one again.
    """
    items = F.array_sort(F.collect_list(F.struct(pos, output)))
    return df.groupBy(request_id).agg(F.transform(items, lambda x: x[output]).alias("outputs"))


def _call(predictor: Predictor, inputs: list, batch_size: int, name: str) -> list:
    outputs = predictor(inputs, batch_size=batch_size)
    if len(outputs) != len(inputs):
        raise ContractError(
            f"stage {name!r} returned {len(outputs)} outputs for {len(inputs)} inputs"
        )
    return list(outputs)


class ContractError(ValueError):
    """A stage broke the one-answer-per-input rule; this ends the job instead of failing a batch."""


def _predict_flat(
    batches: Iterator[pa.RecordBatch], stage: Stage, column: str, out_type: pa.DataType
) -> Iterator[pa.RecordBatch]:
    predictor = stage.open()
    for batch in batches:
        inputs = batch.column(batch.schema.get_field_index(column)).to_pylist()
        outputs: list = []
        for lo in range(0, len(inputs), stage.batch_size):
            part = inputs[lo : lo + stage.batch_size]
            outputs.extend(_call(predictor, part, stage.batch_size, stage.name))
        yield batch.append_column("output", pa.array(outputs, out_type))


def predict(
    df: DataFrame, stage: Stage, column: str = "input", tasks: int | None = None
) -> DataFrame:
    """Add ``output`` to flat input rows. Batches are slices of each partition.

    There is no shuffle unless ``tasks`` asks to spread the rows over that many: worth it for a costly
    model over input that is read in few splits.
    """
    stage = stage.typed()
    if stage.expression is not None:
        return df.withColumn("output", (stage.attempt or stage.expression)(F.col(column)))
    schema = T.StructType([*df.schema.fields, T.StructField("output", stage.returns)])
    spread = df.repartition(tasks) if tasks else df
    return spread.mapInArrow(
        partial(_predict_flat, stage=stage, column=column, out_type=to_arrow_type(stage.returns)),
        schema,
    )


# --- packed requests ------------------------------------------------------------------------------


def _lengths(lists: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


class StageRunner:
    """Feeds one stage from sorted request rows; keeps only the batch that is still open."""

    def __init__(self, number: int, stage: Stage, rule: PackRule, packed: bool = False):
        self.number = number
        self.stage = stage
        self.rule = PackRule(
            stage.batch_size, rule.max_wait_us, rule.key, rule.time, rule.request_id, rule.size
        )
        self.packed = packed  # rows come with their batch_id
        self.predictor = stage.open()
        self.out_type = to_arrow_type(stage.returns)
        self.waiting: pa.Table | None = None
        self.waiting_key: Any = None
        self.waiting_number = 0

    def feed(self, table: pa.Table | None, last: bool) -> tuple[pa.Table | None, pa.Table | None]:
        """(rows whose batch succeeded, rows whose batch failed); an open batch stays inside."""
        parts = [part for part in (self.waiting, table) if part is not None and part.num_rows]
        if not parts:
            return None, None
        rows = pa.concat_tables(parts).combine_chunks()
        numbers, starts = self._batches(rows)
        done = rows.num_rows if last else starts[-1]
        self.waiting = None if last else rows.slice(done)
        if not last:
            self.waiting_key = rows[self.rule.key][done].as_py()
            self.waiting_number = int(numbers[done])
        return self._run(rows.slice(0, done), numbers[:done], [s for s in starts if s < done])

    def _batches(self, rows: pa.Table) -> tuple[np.ndarray, list[int]]:
        bounds = key_runs(rows[self.rule.key])
        if self.packed:
            numbers = rows["batch_id"].to_numpy().astype(np.int64)
            changed = np.concatenate([[True], numbers[1:] != numbers[:-1]])
            changed[bounds[:-1]] = True
            return numbers, np.flatnonzero(changed).tolist()
        sizes = _lengths(rows["_work"])
        times = rows[self.rule.time].to_numpy().astype(np.int64)
        check_sizes(sizes)
        numbers, offsets, _ = number_batches(sizes, times, bounds, None, self.rule)
        if self.waiting is not None and rows[self.rule.key][0].as_py() == self.waiting_key:
            numbers[: int(bounds[1])] += self.waiting_number
        return numbers, np.flatnonzero(offsets == 0).tolist()

    def _run(
        self, rows: pa.Table, numbers: np.ndarray, starts: list[int]
    ) -> tuple[pa.Table | None, pa.Table | None]:
        if rows.num_rows == 0:
            return None, None
        lists = rows["_work"]
        lengths = _lengths(lists)
        flat = pc.list_flatten(lists).to_pylist()
        edges = np.concatenate([[0], np.cumsum(lengths)])
        outputs: list[pa.Array] = []
        ok = np.ones(rows.num_rows, dtype=bool)
        batch_inputs = np.zeros(rows.num_rows, dtype=np.int64)
        began = np.zeros(rows.num_rows, dtype=np.int64)
        ended = np.zeros(rows.num_rows, dtype=np.int64)
        errors: list[str | None] = [None] * rows.num_rows
        for lo, hi in zip(starts, [*starts[1:], rows.num_rows]):
            inputs = flat[edges[lo] : edges[hi]]
            batch_inputs[lo:hi] = len(inputs)
            began[lo:hi] = time.time_ns() // 1000
            try:
                answered = _call(self.predictor, inputs, self.stage.batch_size, self.stage.name)
                outputs.append(pa.array(answered, self.out_type))
            except ContractError:
                raise
            except Exception as error:  # the whole batch fails, also by a wrong type; the others go on
                outputs.append(pa.nulls(len(inputs), self.out_type))
                ok[lo:hi] = False
                errors[lo:hi] = [str(error)] * (hi - lo)
            ended[lo:hi] = time.time_ns() // 1000
        answers = pa.ListArray.from_arrays(
            pa.array(edges, pa.int32()), pa.concat_arrays(outputs)
        )
        k = self.number
        scored = (
            rows.drop_columns(["_work"])
            .append_column("_work", answers)
            .append_column(f"stage{k}_batch_id", pa.array(numbers, pa.int64()))
            .append_column(f"stage{k}_batch_inputs", pa.array(batch_inputs, pa.int64()))
            .append_column(f"stage{k}_started_us", pa.array(began, pa.int64()))
            .append_column(f"stage{k}_ended_us", pa.array(ended, pa.int64()))
        )
        if ok.all():
            return scored, None
        mask = pa.array(ok)
        failed = scored.filter(pc.invert(mask)).drop_columns(["_work", "error"])
        failed = failed.append_column(
            "error", pa.array([e for e, good in zip(errors, ok) if not good], pa.string())
        )
        return scored.filter(mask), failed


def _fit(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """The columns of ``schema``, NULL where the rows never got that far."""
    columns = [
        table[field.name].cast(field.type)
        if field.name in table.column_names
        else pa.nulls(table.num_rows, field.type)
        for field in schema
    ]
    return pa.Table.from_arrays(columns, schema=schema)


def _close(table: pa.Table, reached: int, success: bool, schema: pa.Schema) -> pa.Table:
    """Set the outcome of rows that leave the chain after stage ``reached``."""
    table = table.drop_columns(["last_stage", "success"])
    table = table.append_column("last_stage", pa.array([reached] * table.num_rows, pa.int32()))
    table = table.append_column("success", pa.array([success] * table.num_rows, pa.bool_()))
    return _fit(table, schema)


def _run_chain(
    batches: Iterator[pa.RecordBatch],
    stages: list[tuple[int, Stage]],
    rule: PackRule,
    schema: pa.Schema,
    packed: bool,
) -> Iterator[pa.RecordBatch]:
    runners = [StageRunner(number, stage, rule, packed) for number, stage in stages]

    def push(table: pa.Table | None, last: bool) -> Iterator[pa.RecordBatch]:
        for runner in runners:
            table, failed = runner.feed(table, last)
            if failed is not None:
                yield from _close(failed, runner.number, False, schema).to_batches()
            if table is None and not last:
                return
        if table is not None:
            yield from _close(table, runners[-1].number, True, schema).to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        alive = table.filter(table["success"])
        if alive.num_rows:
            yield from push(alive, last=False)
        if alive.num_rows < table.num_rows:  # failed in an earlier pass: kept as they are
            failed = table.filter(pc.invert(table["success"])).drop_columns(["_work"])
            yield from _fit(failed, schema).to_batches()
    yield from push(None, last=True)


STAGE_COLUMNS = ("batch_id", "batch_inputs", "started_us", "ended_us")


def _stage_fields(number: int) -> list[T.StructField]:
    return [T.StructField(f"stage{number}_{name}", T.LongType()) for name in STAGE_COLUMNS]


def _chain_schema(df: DataFrame, stages: list[tuple[int, Stage]]) -> T.StructType:
    kept = [field for field in df.schema.fields if field.name not in ("_work", "batch_id")]
    added = [field for number, _ in stages for field in _stage_fields(number)]
    last = stages[-1][1].returns
    return T.StructType([*kept, *added, T.StructField("_work", T.ArrayType(last))])


def _python_stages(
    df: DataFrame, stages: list[tuple[int, Stage]], rule: PackRule, tasks: int
) -> DataFrame:
    """All given stages fused over rows sorted by queue: one shuffle for packing and predicting.

    Few bytes can mean much model time, so partitions are not merged by their size.
    """
    schema = _chain_schema(df, stages)
    return sorted_by_queue(df, rule, tasks).mapInArrow(
        partial(
            _run_chain, stages=stages, rule=rule, schema=to_arrow_schema(schema), packed=False
        ),
        schema,
    )


def _spread_stage(
    df: DataFrame, number: int, stage: Stage, rule: PackRule, tasks: int
) -> DataFrame:
    """One stage whose batches are numbered first, then spread over all tasks, whatever queue they are of.

    Rows carry their batch number; nothing is joined by id. They are stored in order before, so that the
    stage before this one runs once.
    """
    sized = df.withColumn("_size", F.coalesce(F.size("_work"), F.lit(0)))
    ordered = ordered_segments(sized, ["success", *rule.order], tasks)
    packing = replace(rule, batch_size=stage.batch_size, size="_size")
    packed = pack_ordered(ordered.filter("success"), packing)
    schema = _chain_schema(df, [(number, stage)])
    scored = (
        packed.repartition(tasks, rule.key, "batch_id")
        .sortWithinPartitions(rule.key, "batch_id", "batch_offset")
        .select(*df.columns, "batch_id")
        .mapInArrow(
            partial(
                _run_chain, stages=[(number, stage)], rule=rule,
                schema=to_arrow_schema(schema), packed=True,
            ),
            schema,
        )
    )
    missing = [f for f in schema.fields if f.name not in df.columns or f.name == "_work"]
    failed = ordered.filter("not success").withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in missing}
    )
    return scored.unionByName(failed.select(*schema.names))


def _expression_stage(df: DataFrame, number: int, stage: Stage) -> DataFrame:
    alive = F.col("success")
    fields = {f.name: F.lit(None).cast("bigint") for f in _stage_fields(number)}
    if stage.attempt is not None:
        return _attempted_stage(df, number, stage).withColumns(fields)
    return df.withColumns(
        {
            "_work": F.when(alive, F.transform("_work", stage.expression)),
            "last_stage": F.when(alive, F.lit(number)).otherwise(F.col("last_stage")),
            **fields,
        }
    )


def _attempted_stage(df: DataFrame, number: int, stage: Stage) -> DataFrame:
    """An expression stage by its twin: requests with an input that has no answer fail, all others go on."""
    alive = F.col("success")
    failed = alive & F.exists(
        F.arrays_zip(F.col("_work").alias("x"), F.col("_tried").alias("y")),
        lambda pair: pair["x"].isNotNull() & pair["y"].isNull(),
    )
    tried = df.withColumn("_tried", F.when(alive, F.transform("_work", stage.attempt)))
    judged = tried.withColumn("_failed", F.coalesce(failed, F.lit(False)))
    return judged.withColumns(
        {
            "_work": F.when(alive & ~F.col("_failed"), F.col("_tried")),
            "last_stage": F.when(alive, F.lit(number)).otherwise(F.col("last_stage")),
            "error": F.when(F.col("_failed"), F.lit(f"an input has no answer in stage {stage.name!r}")).otherwise(F.col("error")),
            "success": alive & ~F.col("_failed"),
        }
    ).drop("_tried", "_failed")


def _numbered(stages: Sequence[Stage]) -> list[tuple[int, Stage]]:
    return [(number, stage.typed()) for number, stage in enumerate(stages)]


def chain(
    df: DataFrame,
    stages: Sequence[Stage],
    max_wait_us: int | None = None,
    key: str = "queue_key",
    time_column: str = "received_us",
    request_id: str = "request_id",
    admit: Column | None = None,
    spread: bool | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Run every request's ``inputs`` through the stages; stage k reads what stage k-1 answered.

    Adds ``outputs``, ``success``, ``last_stage``, ``error`` and, per stage k, the batch it was
    predicted in: ``stage{k}_batch_id``, ``_batch_inputs``, ``_started_us``, ``_ended_us``. If a stage
    raises, all requests of that batch fail there and no later stage sees them; so do they if an answer has
    not the stage's type. An error in an expression stage ends the job, as in any other column, unless the stage
    has an ``attempt``: then only the requests with such inputs fail. ``max_wait_us`` counts by ``time_column`` at every stage.

    Without ``spread`` all stages run in one pass with one task per queue, and building the plan runs nothing.
    With it one queue may be more than a task can take: each stage's batches are numbered in a global order and
    spread over all tasks. Its rows are stored before every stage, so earlier stages run while the plan is built.
    The answers are the same. By default (None) requests are counted by queue, and those of hot queues
    (:func:`hot_queues`) are spread, all others go in one pass. ``tasks`` is the number of tasks of both (the
    session's shuffle partitions).

    Rows for which ``admit`` is not true pass by every stage (``success`` false, ``last_stage`` -1), so
    refused requests need no second read of the source. An empty list is answered at once with success and
    ``[]``; a NULL one is refused.
    """
    rule = PackRule(1, max_wait_us, key, time_column, request_id)
    admitted = F.lit(True) if admit is None else F.coalesce(admit, F.lit(False))
    tasks = tasks or shuffle_partitions(df.sparkSession)
    work = _begun(df, admitted)
    numbered = _numbered(stages)
    if spread is None and not df.isStreaming and any(stage.expression is None for _, stage in numbered):
        hot = hot_queues(df, key, tasks)
        if not hot.isEmpty():
            same = work[key].eqNullSafe(hot["_hot"])
            parts = [
                _through(work.join(F.broadcast(hot), same, how), numbered, rule, tasks, how == "left_semi")
                for how in ("left_semi", "left_anti")  # fewer hot queues than tasks
            ]
            return _answered(parts[0].unionByName(parts[1]))
    return _answered(_through(work, numbered, rule, tasks, bool(spread)))


def hot_queues(df: DataFrame, key: str, tasks: int, least: int | None = None) -> DataFrame:
    """Queues (``_hot``) with more requests than an equal share for each of ``tasks`` tasks, so fewer than those.

    Queues of up to ``least`` requests (``HOT_REQUESTS``) are never hot. Reads the key column alone, counted
    before it is shuffled; the counts are stored.
    """
    least = HOT_REQUESTS if least is None else least
    counts = cut_lineage(df.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_requests")))
    share = counts.agg(F.sum("_requests") / tasks).scalar()
    return counts.filter((F.col("_requests") > share) & (F.col("_requests") > least)).select("_hot")


def _through(
    work: DataFrame, stages: list[tuple[int, Stage]], rule: PackRule, tasks: int, spread: bool
) -> DataFrame:
    """Rows after all stages, either spread or in one pass per run of Python stages."""
    for python, group in groupby(stages, lambda item: item[1].expression is None):
        members = list(group)
        if not python:
            for number, stage in members:
                work = _expression_stage(work, number, stage)
        elif spread:
            for number, stage in members:
                work = _spread_stage(work, number, stage, rule, tasks)
        else:
            work = _python_stages(work, members, rule, tasks)
    return work


def _begun(df: DataFrame, admitted: Column) -> DataFrame:
    """Requests before the first stage; those without inputs take no part in it."""
    alive = admitted & F.coalesce(F.size("inputs") > 0, F.lit(False))
    return df.withColumns(
        {
            "_empty": admitted & F.coalesce(F.size("inputs") == 0, F.lit(False)),
            "_work": F.when(alive, F.col("inputs")),
            "success": alive,
            "last_stage": F.lit(-1),
            "error": F.when(admitted & F.col("inputs").isNull(), F.lit(NO_INPUTS)),
        }
    )


def _answered(work: DataFrame) -> DataFrame:
    nothing = F.array().cast(work.schema["_work"].dataType)
    return work.withColumns(
        {
            "_work": F.when(F.col("_empty"), nothing).otherwise(F.col("_work")),
            "success": F.col("_empty") | F.col("success"),
        }
    ).drop("_empty").withColumnRenamed("_work", "outputs")


def chain_as_read(
    df: DataFrame,
    stages: Sequence[Stage],
    time_column: str = "received_us",
    request_id: str = "request_id",
) -> DataFrame:
    """:func:`chain` without a queue order: batches are packed from each partition as it is read.

    Nothing is shuffled or counted, so this also runs on a stream. Which requests share a batch then depends
    on how the source is split; with a stage that fails for some inputs use :func:`chain` per trigger.
    """
    rule = PackRule(1, None, "_lane", time_column, request_id)
    work = _begun(df, F.lit(True)).withColumn("_lane", F.lit(0))
    for python, group in groupby(_numbered(stages), lambda item: item[1].expression is None):
        members = list(group)
        if python:
            schema = _chain_schema(work, members)
            work = work.mapInArrow(
                partial(
                    _run_chain, stages=members, rule=rule,
                    schema=to_arrow_schema(schema), packed=False,
                ),
                schema,
            )
        else:
            for number, stage in members:
                work = _expression_stage(work, number, stage)
    return _answered(work.drop("_lane"))


def predict_isolated(
    df: DataFrame, stage: Stage, max_wait_us: int | None = None, **options: Any
) -> DataFrame:
    """Pack and predict with one stage; a batch that raises fails alone."""
    return chain(df, [stage], max_wait_us, **options)


def stage_batch_log(scored: DataFrame, stage: int = 0, key: str = "queue_key") -> DataFrame:
    """One row per batch that stage ran, from the output of :func:`chain`."""
    prefix = f"stage{stage}_"
    failed_here = (~F.col("success")) & (F.col("last_stage") == stage)
    return (
        scored.filter(F.col(prefix + "batch_id").isNotNull())
        .groupBy(key, F.col(prefix + "batch_id").alias("batch_id"))
        .agg(
            F.count(F.lit(1)).alias("n_requests"),
            F.sum(F.size("inputs")).alias("predicted_in_batch_of"),
            F.min(prefix + "started_us").alias("started_us"),
            F.max(prefix + "ended_us").alias("ended_us"),
            F.bool_and(~failed_here).alias("batch_success"),
        )
    )


def infer_output_schema(example: list, functions: Iterable[Predictor]) -> list[T.DataType]:
    """Run the example through the chain; each stage's answer type, the next one's example."""
    types = []
    for fn in functions:
        example = list(fn(example, batch_size=len(example)))
        types.append(_value_type(example))
    return types


def output_types(examples: DataFrame, functions: Sequence[Predictor], inputs: str = "inputs") -> DataFrame:
    """:func:`infer_output_schema` on an executor, for the example in each row: stage, type (as DDL text).

    Give one example request; the functions see it whole.
    """

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for example in batch.column(0).to_pylist():
                types = [t.simpleString() for t in infer_output_schema(example, functions)]
                yield pa.RecordBatch.from_pydict(
                    {"stage": pa.array(range(len(types)), pa.int32()), "type": pa.array(types, pa.string())}
                )

    return examples.select(inputs).mapInArrow(infer, "stage int, type string")


def _value_type(values: list) -> T.DataType:
    """Spark type of some answers; tuples become structs with fields ``_1``, ``_2``, ..."""
    if values and all(isinstance(v, tuple) and len(v) == len(values[0]) for v in values):
        columns = zip(*values)
        return T.StructType(
            [T.StructField(f"_{i}", _value_type(list(c))) for i, c in enumerate(columns, start=1)]
        )
    return from_arrow_type(pa.array(values).type)


def embed_text(
    df: DataFrame, stage: Stage, text: str = "text", name: str = "embedding",
    tasks: int | None = None,
) -> DataFrame:
    """Text to unit-length vectors; the stage may return any scale."""
    scored = predict(df, stage, text, tasks)
    return scored.withColumn(name, l2_normalize(F.col("output"))).drop("output")
