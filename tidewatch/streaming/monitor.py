"""ST1: keep findings and the inbox up to date while sales files arrive."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, date, datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewatch.config import RiskConfig
from tidewatch.functions import expressions as X
from tidewatch.functions.expressions import rounded
from tidewatch.operators import inbox, quality, risk
from tidewatch.operators.periods import PERIOD_MONTHS, drop_pct, first_to_last, period_start
from tidewatch.operators.tokens import token_for
from tidewatch.schemas import ERROR, SALES
from tidewatch.sources.storage import store

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What the state of a bucket holds: an Arrow message of ``_CUSTOMERS``, and when to wake it.
_STATE = "customers binary, wake bigint"
#: Partial sums that a task made of one bucket, as an Arrow message of ``_SUMS``; heartbeats have no bucket.
_PARTIAL = "bucket int, _rows binary, heard timestamp"
_CHANGED = (
    "customer_name string, first_key bigint, newest int, "
    "period array<int>, quantity array<bigint>, revenue array<double>, cost_total array<double>"
)
_SUMS = pa.schema(
    [
        ("customer_name", pa.string()), ("period", pa.int32()), ("quantity", pa.int64()),
        ("revenue", pa.float64()), ("cost_total", pa.float64()), ("first_key", pa.int64()),
    ]
)
#: ``_CHANGED`` in Arrow: periods in order, as months since year 0. In the state, ``newest`` is the
#: newest period a customer was shown with.
_LISTS = {"period": pa.int32(), "quantity": pa.int64(), "revenue": pa.float64(), "cost_total": pa.float64()}
_CUSTOMERS = pa.schema(
    [("customer_name", pa.string()), ("first_key", pa.int64()), ("newest", pa.int32())]
    + [(name, pa.list_(pa.field("element", kind))) for name, kind in _LISTS.items()]
)
#: What the rules ask of the periods of a customer.
_NUMBERS = (
    "customer_name string, first_key bigint, periods bigint, max_drop double, "
    "current_quantity bigint, previous_quantity bigint, earlier_quantity bigint, "
    "first_quantity bigint, first_revenue double, first_cost_total double, "
    "last_quantity bigint, last_revenue double, last_cost_total double"
)
_SETTINGS = "name string, value string"

#: Rows that a task holds before it adds them up. Sums that are half as many are handed on.
_HELD = 100_000
#: Bytes of bundles that a Python task is handed at once.
_HANDED = 8 << 20
_MILLISECONDS_A_DAY = 86_400_000


def use_disk_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, so that its size is bound by disk, and hand tasks few bundles at once."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _HANDED)


def sales_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New sales files under ``path`` as they come."""
    reader = spark.readStream.schema(SALES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def month_start(number: Column) -> Column:
    return F.make_date(F.floor(number / 12).cast("int"), F.pmod(number, F.lit(12)) + 1, F.lit(1))


def _milliseconds(month: int) -> int:
    return (date(month // 12, month % 12 + 1, 1) - date(1970, 1, 1)).days * _MILLISECONDS_A_DAY


def _bundles(sums: pa.Table) -> Iterator[tuple[int, bytes]]:
    """Rows of ``_SUMS`` with their ``bucket``, as an Arrow message a bucket."""
    order = np.argsort(sums["bucket"].to_numpy(), kind="stable")
    rows = sums.take(pa.array(order)).combine_chunks()
    buckets, rows = rows["bucket"].to_numpy(), rows.select(_SUMS.names).cast(_SUMS).to_batches()[0]
    starts = np.append(0, np.flatnonzero(np.diff(buckets)) + 1).tolist()
    for start, end in zip(starts, [*starts[1:], len(buckets)]):
        yield int(buckets[start]), rows.slice(start, end - start).serialize().to_pybytes()


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per customer and period within a task, and a heartbeat: how new its newest sale is.

    Sums have no time of their own, so none is ever late; only heartbeats, which
    have no bucket, move the watermark.
    """
    keys = ["bucket", "customer_name", "period"]
    sums = [("quantity", "sum"), ("revenue", "sum"), ("cost_total", "sum"), ("first_key", "min")]
    columns = [*keys, *(name for name, _ in sums)]
    schema = pa.schema([("bucket", pa.int32()), ("_rows", pa.binary()), ("heard", pa.timestamp("us", "UTC"))])

    def added(rows: pa.Table) -> pa.Table:
        grouped = rows.group_by(keys).aggregate(sums).select([*keys, *(f"{name}_{how}" for name, how in sums)])
        return grouped.rename_columns(columns)

    def handed_on(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        buckets, messages = zip(*_bundles(rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets, pa.int32()), pa.array(messages, pa.binary()), pa.nulls(len(buckets), schema.field("heard").type)],
            schema=schema,
        )

    held, rows, newest = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        last = pc.max(batch.column("transaction_date")).as_py()
        newest = last if newest is None else max(newest, last)
        held.append(pa.Table.from_batches([batch]).select(columns))
        rows += batch.num_rows
        if rows >= _HELD:
            held = [added(pa.concat_tables(held))]
            rows = len(held[0])
            if rows >= _HELD // 2:
                yield from handed_on(held[0])
                held, rows = [], 0
    if rows:
        yield from handed_on(added(pa.concat_tables(held)))
    if newest is not None:
        heard = datetime(newest.year, newest.month, newest.day, tzinfo=UTC)
        yield pa.RecordBatch.from_pylist([{"heard": heard}], schema)


def _merged(held: pa.RecordBatch, rows: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """Customers with the sums of ``rows`` added, and which of them have such rows.

    The token of a customer that is new is the smallest key among these rows.
    """
    known = held.column("customer_name")
    fresh = rows.column("customer_name").filter(pc.invert(pc.is_in(rows.column("customer_name"), known)))
    names = pa.concat_arrays([known, fresh.unique()])
    owner = pc.index_in(rows.column("customer_name"), names).to_numpy()
    token = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(token, owner, rows.column("first_key").to_numpy())
    token[: len(known)] = held.column("first_key").to_numpy()
    newest = np.append(held.column("newest").to_numpy(), np.zeros(len(names) - len(known), np.int32))
    touched = np.zeros(len(names), bool)
    touched[owner] = True

    sizes = held.column("period").value_lengths().to_numpy()
    owner = np.append(np.repeat(np.arange(len(known)), sizes), owner)
    period, *sums = (np.append(held.column(c).flatten().to_numpy(), rows.column(c).to_numpy()) for c in _LISTS)
    order = np.lexsort((period, owner))
    owner, period = owner[order], period[order]
    starts = np.append(0, np.flatnonzero((owner[1:] != owner[:-1]) | (period[1:] != period[:-1])) + 1)
    ends = np.append(0, np.cumsum(np.bincount(owner[starts], minlength=len(names))))
    lists = [period[starts], *(np.add.reduceat(values[order], starts) for values in sums)]
    return _customers_of(names, token, newest, ends, lists), touched


def _customers_of(names, token, newest, ends, lists) -> pa.RecordBatch:
    offsets = pa.array(ends, pa.int32())
    columns = [names, pa.array(token, pa.int64()), pa.array(newest, pa.int32())]
    for field, values in zip(list(_CUSTOMERS)[3:], lists):
        columns.append(pa.ListArray.from_arrays(offsets, pa.array(values, field.type.value_type), type=field.type))
    return pa.RecordBatch.from_arrays(columns, schema=_CUSTOMERS)


def _opened(column: str):
    """Rows of ``_CHANGED`` from Arrow messages, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for message in batch.column(column):
                yield pa.ipc.read_record_batch(pa.py_buffer(message.as_py()), _CUSTOMERS)

    return run


def _numbers(step: int | None):
    """What the rules ask of each customer, from its lists of periods.

    With ``step``, the months of a period, periods without a row count as empty, up to ``newest``.
    A gap needs no rows of its own: sales drop to nothing in its first period, and all others in it
    have no base to drop from.
    """

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        size = batch.column("period").value_lengths().to_numpy()
        end = np.cumsum(size)
        start, last, at = end - size, end - 1, np.arange(end[-1])
        period, quantity, revenue, cost_total = (batch.column(c).flatten().to_numpy() for c in _LISTS)
        # The place of each period among all that count, and that of the last one, with or without a row.
        if step:
            place = (period - np.repeat(period[start], size)) // step
            goal = place[last] + np.maximum(batch.column("newest").to_numpy() - period[last], 0) // step
        else:
            place = at - np.repeat(start, size)
            goal = place[last]
        following = np.append(place[1:], 0)
        following[last] = goal + 1
        gap = following - place > 1
        after = np.where(gap, 0, np.append(quantity[1:], 0))
        based = quantity != 0
        moves = based.copy()
        moves[last] &= gap[last]
        drop = np.full(len(at), -np.inf)
        np.divide(quantity - after, quantity, out=drop, where=moves)
        drop = np.maximum.reduceat(drop, start)

        def back(places: int) -> pa.Array:
            value = np.zeros(len(size), np.int64)
            for number in range(3):
                own = np.maximum(last - number, start)
                value = np.where(place[own] == goal - places, quantity[own], value)
            return pa.array(value, mask=goal < places)

        sold = np.logical_or.reduceat(based, start)
        first = np.minimum.reduceat(np.where(based, at, end[-1] - 1), start)
        newest = np.maximum.reduceat(np.where(based, at, 0), start)
        columns = [batch.column("customer_name"), batch.column("first_key"), pa.array(goal + 1, pa.int64())]
        columns += [pa.array(drop, mask=np.isneginf(drop)), back(0), back(1), back(2)]
        for own in (first, newest):
            columns += [pa.array(values[own], mask=~sold) for values in (quantity, revenue, cost_total)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = [part.split()[0] for part in _NUMBERS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (measured(batch) for batch in batches if batch.num_rows)

    return run


class CustomerPeriods(StatefulProcessor):
    """Sums per period of the customers of a bucket, and when to look at them again.

    A customer that new rows touch is emitted with all periods, and with the newest
    period heard of. With ``silent`` a timer is set on the first period that a
    customer of the bucket has not been shown for: when the watermark gets there,
    these customers are emitted again without any row of their own, and the timer
    moves on. Customers come and go as one Arrow message, so that no value of
    theirs is handled by itself.
    """

    def __init__(self, months: int, silent: bool) -> None:
        self._months, self._silent = months, silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("customers", _STATE)

    def _load(self) -> tuple[pa.RecordBatch, int | None]:
        held = self._state.get()
        if held is None:
            return _customers_of(pa.array([], pa.string()), [], [], [0], [[] for _ in _LISTS]), None
        return pa.ipc.read_record_batch(pa.py_buffer(bytes(held[0])), _CUSTOMERS), held[1]

    def _save(self, customers: pa.RecordBatch, wake: int | None) -> None:
        """Keep the bucket, and wake it when the customer shown the shortest way is due again."""
        if self._silent:
            due = _milliseconds(pc.min(customers.column("newest")).as_py() + self._months)
            if due != wake:
                if wake is not None:
                    self._handle.deleteTimer(wake)
                self._handle.registerTimer(due)
            wake = due
        self._state.update((customers.serialize().to_pybytes(), wake))

    def _shown(self, customers: pa.RecordBatch, which: np.ndarray, heard: int | None) -> pa.RecordBatch:
        """The customers, of whom ``which`` are shown with the newest period heard of."""
        periods = customers.column("period")
        newest = periods.flatten().to_numpy()[np.cumsum(periods.value_lengths().to_numpy()) - 1]
        if self._silent and heard is not None:
            newest = np.maximum(newest, heard)
        newest = np.where(which, newest, customers.column("newest").to_numpy())
        return customers.set_column(2, _CUSTOMERS.field(2), pa.array(newest, pa.int32()))

    def _heard(self, timerValues) -> int | None:
        """The period of the watermark."""
        watermark = timerValues.getCurrentWatermarkInMs()
        if watermark <= 0:
            return None
        day = datetime.fromtimestamp(watermark / 1000, UTC)
        return (day.year * 12 + day.month - 1) // self._months * self._months

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        customers, wake = self._load()
        sums = [pa.ipc.read_record_batch(pa.py_buffer(bytes(row["_rows"])), _SUMS) for row in rows]
        customers, touched = _merged(customers, pa.Table.from_batches(sums).combine_chunks().to_batches()[0])
        customers = self._shown(customers, touched, self._heard(timerValues))
        yield Row(_changed=customers.filter(pa.array(touched)).serialize().to_pybytes())
        self._save(customers, wake)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        customers, _ = self._load()
        heard = self._heard(timerValues)
        due = customers.column("newest").to_numpy() < heard
        customers = self._shown(customers, due, heard)
        if due.any():
            yield Row(_changed=customers.filter(pa.array(due)).serialize().to_pybytes())
        self._save(customers, None)


class RiskMonitor:
    """ST1: findings of all customers so far, and what each batch changes.

    The state is Spark's own: per customer the sums of each period and a token, in
    buckets of customers, because what a batch pays for is the number of buckets it
    touches. Choose ``buckets`` so that one holds some dozens. The state lives in
    the checkpoint under ``directory`` and is read back from there, so nothing is
    logged beside it. Sums merge, so a late row corrects its own past
    period. A token's number is the id of the customer's first record, which no
    two customers share and which needs no count of all customers.

    Every batch writes what it changes to ``changes``: cards that hold now with
    their named texts, and customers whose card is withdrawn. The cost of a batch
    follows the customers it touches. With ``fill_empty_periods`` customers who stop
    ordering are touched when a period has passed without them.

    ``directory`` holds real names; what the methods return holds tokens only,
    but for ``dictionary``, ``inbox`` and ``changes``.
    """

    def __init__(
        self, spark: SparkSession, directory: str, config: RiskConfig = RiskConfig(), buckets: int = 1024
    ) -> None:
        if config.grain:
            raise ValueError("the monitor works on customers")
        self.spark, self.directory, self.config, self.buckets = spark, directory.rstrip("/"), config, buckets
        self._bind(
            buckets=buckets, period=config.period, prefix=config.prefix, fill_empty_periods=config.fill_empty_periods
        )

    def _bind(self, **settings) -> None:
        """Keep what the state is laid out by beside it, and refuse other values later."""
        path = f"{self.directory}/settings"
        rows = sorted((name, str(value)) for name, value in settings.items())
        try:
            known = self.spark.read.schema(_SETTINGS).parquet(path).collect()
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            self.spark.createDataFrame(rows, _SETTINGS).coalesce(1).write.parquet(path)
            return
        if sorted(map(tuple, known)) != rows:
            kept = ", ".join(f"{name}={value}" for name, value in sorted(map(tuple, known)))
            raise ValueError(f"the state in {self.directory} was made with {kept}")

    @property
    def checkpoint(self) -> str:
        return f"{self.directory}/checkpoint"

    # --- running ---------------------------------------------------------------------

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Run on ``stream``, whose ids are unique. ``trigger`` is passed on; by
        default the query takes what is there and stops."""
        valid, _ = quality.enforce_contract(stream)
        amount = F.col("quantity")
        rows = valid.select(
            F.pmod(F.xxhash64("customer_name"), F.lit(self.buckets)).cast("int").alias("bucket"),
            "customer_name",
            month_number(period_start(F.col("transaction_date"), self.config.period)).alias("period"),
            "transaction_date",
            amount.cast("bigint").alias("quantity"),
            (amount * F.col("unit_sales_price")).alias("revenue"),
            (amount * F.col("unit_cost")).alias("cost_total"),
            F.col("id").alias("first_key"),
        )
        keeper = CustomerPeriods(PERIOD_MONTHS[self.config.period], self.config.fill_empty_periods)
        changed = (
            rows.mapInArrow(_add_up, _PARTIAL)
            .withWatermark("heard", "0 seconds")
            .groupBy("bucket")
            .transformWithState(keeper, "_changed binary", "Append", "EventTime")
            .mapInArrow(_opened("_changed"), _CHANGED)
        )
        return (
            changed.writeStream.foreachBatch(self.absorb)
            .option("checkpointLocation", self.checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def start_errors(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """A second query on the same source: its rejected rows, appended once each to ``errors``."""
        _, rejected = quality.enforce_contract(stream)
        return (
            quality.as_errors(rejected, "load", F.col("id"))
            .writeStream.format("parquet")
            .option("checkpointLocation", f"{self.directory}/checkpoint-errors")
            .trigger(**(trigger or {"availableNow": True}))
            .start(f"{self.directory}/errors")
        )

    def absorb(self, changed: DataFrame, batch_id: int) -> None:
        """Write what one micro-batch changes. Running it again for the same number changes nothing."""
        path = f"{self.directory}/changes/batch_id={batch_id}"
        self._verdicts(changed).write.mode("overwrite").parquet(path)

    # --- rules -----------------------------------------------------------------------

    def _graded(self, customers: DataFrame) -> DataFrame:
        """One graded row per customer; healthy ones have no risk type. Nothing is moved."""
        step = PERIOD_MONTHS[self.config.period] if self.config.fill_empty_periods else None
        now = F.col("current_quantity")
        metrics = customers.mapInArrow(_numbers(step), _NUMBERS).select(
            "customer_name",
            "first_key",
            "periods",
            rounded(F.col("max_drop") * 100).alias("max_single_drop"),
            drop_pct(F.col("previous_quantity"), now).alias("last_drop"),
            drop_pct(F.col("earlier_quantity"), now).alias("two_period_drop"),
            *[
                F.try_divide(f"{which}_{total}", f"{which}_quantity").alias(f"{which}_{unit}")
                for which in ("first", "last")
                for total, unit in (("revenue", "price"), ("cost_total", "cost"))
            ],
        )
        masked = metrics.withColumns(first_to_last()).withColumn(
            "customer_id", token_for(F.col("first_key"), self.config.prefix)
        )
        graded = risk.grade(risk.classify(masked, self.config), self.config)
        return risk.with_evidence(graded, self.config).withColumn("pos", F.col("first_key"))

    def _cards(self, graded: DataFrame) -> DataFrame:
        """Named cards. All tokens in a card are its own and no digit of our wording follows one, so its
        row has all names and no pattern is compiled for a customer."""
        cards = inbox.drafted_cards(graded, "customer_name", "periods")

        def named(text):
            return F.replace(text, F.col("customer_id"), F.col("customer_name"))

        texts = {column: named(F.col(column)) for column in inbox.CARD_TEXTS}
        texts["action_steps"] = F.transform("action_steps", named)
        return cards.withColumns(texts).withColumn("share_link", X.share_link(F.col("body")))

    def _verdicts(self, customers: DataFrame) -> DataFrame:
        """Cards of customers at risk, and rows without one (``holds`` false) for all others."""
        cards = self._cards(self._graded(customers))
        known = ("customer_id", "customer_name", "periods", "pos")
        holds = F.col("risk_type").isNotNull()
        return cards.select(
            *known, holds.alias("holds"), *[F.when(holds, F.col(c)).alias(c) for c in cards.columns if c not in known]
        )

    # --- reading ---------------------------------------------------------------------

    def _customers(self) -> DataFrame:
        """The state of all buckets after the newest finished batch."""
        kept = self.spark.read.format("state-metadata").load(self.checkpoint)
        own = kept.where(F.col("operatorProperties").contains('"customers"')).select("operatorId").first()
        state = (
            self.spark.read.format("statestore")
            .option("operatorId", own["operatorId"])
            .option("stateVarName", "customers")
            .load(self.checkpoint)
        )
        return state.select("value.customers").mapInArrow(_opened("customers"), _CHANGED)

    def totals(self) -> DataFrame:
        """Sums per customer and period of all rows so far."""
        lists = F.inline(F.arrays_zip("period", "quantity", "revenue", "cost_total"))
        rows = self._customers().select("customer_name", "first_key", lists)
        return rows.withColumn("period", month_start(F.col("period")))

    def _current(self) -> DataFrame:
        customers = self._customers()
        if not self.config.fill_empty_periods:
            return self._graded(customers)
        # Stored, because the newest period is asked of the same rows.
        customers = store(customers, "customers")
        newest = customers.select(F.max(F.element_at("period", -1))).scalar()
        return self._graded(customers.withColumn("newest", newest))

    def findings(self) -> DataFrame:
        """Current findings, tokens only."""
        return risk.at_risk(self._current()).select(
            "customer_id", "risk_type", "severity", "evidence", "metric_value", "pos"
        )

    def inbox(self) -> DataFrame:
        """Current cards with real names."""
        return self._cards(risk.at_risk(self._current()))

    def dictionary(self) -> DataFrame:
        number = F.col("first_key")
        token = token_for(number, self.config.prefix)
        return self._customers().select(F.col("customer_name").alias("name"), token.alias("token"), number.alias("token_no"))

    def changes(self) -> DataFrame:
        """What each batch changed, by ``batch_id``; rows of a later batch replace those of a customer before."""
        return self.spark.read.option("basePath", f"{self.directory}/changes").parquet(f"{self.directory}/changes")

    def errors(self) -> DataFrame:
        return self.spark.read.schema(ERROR).parquet(f"{self.directory}/errors").distinct()


def latest(changes: DataFrame) -> DataFrame:
    """The newest row of each customer among ``RiskMonitor.changes``.

    Only keys and numbers are aggregated, so no text is sorted.
    """
    last = changes.groupBy("customer_id").agg(F.max("batch_id").alias("batch_id"))
    return changes.join(last, ["customer_id", "batch_id"], "left_semi")
