"""Exactly one copy of each message that was delivered at least once.

Identifiers are dictionary-encoded exactly: each new one gets the next ordinal. What has been admitted is kept
as one bitmap for each 32768 ordinals. A batch goes through two commits. The first appends the new identifiers
to the dictionary, the second the batch's own bits (of ordinals not set in any bitmap before). The arrivals
that are admitted are then read from the bits that the second commit put in force, so the bitmaps alone say what
was admitted: a batch that comes again under its name gives what it gave the first time, and identifiers
that a lost job left in the dictionary are still to be admitted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: ISO date and time with an offset; anything else is unreadable. Fixed values.
READABLE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?$"
#: Characters that count as white space when a key is tested for being blank. Fixed values.
BLANKS = "[\\u0009-\\u000d\\u001c-\\u0020\\u0085\\p{Z}]"
BITS = 32768
#: Parts of the dictionary and of the bitmaps before they are written together as one.
PARTS = 32
ATTEMPTS = 20


def instant(column: str) -> Column:
    """Microseconds since 1970 of an ISO string with any offset; null if it is missing or unreadable."""
    return F.expr(f"CASE WHEN trim({column}) RLIKE r'{READABLE}' THEN unix_micros(try_to_timestamp(trim({column}))) END")


def non_blank(key: Column) -> Column:
    return key.isNotNull() & (F.regexp_replace(key, BLANKS, "") != "")


def bit_set(bits: Column, bit: Column) -> Column:
    """Whether a bit of a bitmap (binary, null: none is set) is 1."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1, F.lit(False))


class Conflict(Exception):
    """Another writer published a version after the one that was read."""


class DeliveryLedger:
    """The identifiers seen so far, in a folder that all executors share.

    A version is a file version-N of names: parts of the dictionary (key, code), the next free code, and parts of the bitmaps
    (bucket, bits), one for each batch. It is put in force by a rename to its number, which fails if that
    number exists; a writer that lost reads the new version and begins again. Tables are complete
    before they are named, so a lost job leaves the old state.

    admit(batch) gives every row of the batch with ``admitted``: true for the one arrival of each
    identifier not seen before that comes first by (order, tie), false for every other row with an
    identifier. Rows whose key is null or blank have no identity: ``admitted`` is null and they are kept.
    name: a batch that is given again under the same name gives the same answer and changes nothing.
    tie_is_unique=False: rows may be equal in order and tie; the batch is then written once with a number
    for each row, so that exactly one of them is admitted.
    An empty batch leaves the state as it is. Columns of other names pass through untouched.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def state(self) -> dict:
        """The version in force."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        last = max((int(n.split("-", 1)[1]) for n in names if n.startswith("version-")), default=0)
        if not last:
            return {"version": 0, "dictionary": [], "next": 0, "seen": [], "batches": {}}
        stream = self._fs.open(self._path(f"version-{last}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, state: dict) -> dict:
        """Puts the version after state's in force, unless another writer did."""
        state = state | {"version": state["version"] + 1}
        draft = f"draft-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self._jvm.FileContext.getFileContext(self._path(draft).toUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(self._jvm.Options.Rename, 1)
        never[0] = self._jvm.Options.Rename.NONE
        try:
            context.rename(self._fs.makeQualified(self._path(draft)), self._fs.makeQualified(self._path(f"version-{state['version']}")), never)
        except Exception as error:
            self._fs.delete(self._path(draft), False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {state['version']} exists") from None
            raise
        return state

    def _read(self, parts: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str) -> str:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return name

    def dictionary(self, state: dict | None = None) -> DataFrame:
        return self._read((state or self.state())["dictionary"], "key string, code bigint")

    def seen(self, state: dict | None = None) -> DataFrame:
        """bucket, bits: the union of all batches."""
        parts = self._read((state or self.state())["seen"], "bucket bigint, bits binary")
        return parts.groupBy("bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))

    def admit(self, batch: DataFrame, key: str, order: Column, tie: Column, tie_is_unique: bool = True, name: str | None = None) -> DataFrame:
        name = name or uuid.uuid4().hex
        if not tie_is_unique:
            numbered = batch.withColumn("_number", F.monotonically_increasing_id())
            batch = self.spark.read.schema(numbered.schema).parquet(f"{self.folder}/{self._write(numbered, f'batch-{uuid.uuid4().hex}')}")
            tie = F.struct(tie.alias("tie"), F.col("_number"))
        arrivals = batch.select("*", F.col(key).alias("_key"), order.alias("_order"), tie.alias("_tie"))
        keyed = arrivals.filter(non_blank(F.col("_key")))
        rank = F.struct(F.col("_order").isNull().alias("late"), F.col("_order").alias("at"), F.col("_tie").alias("tie"))
        # a hot identifier shrinks to one row a task before anything is shuffled
        first = keyed.groupBy(F.col("_key").alias("key")).agg(F.min(rank).alias("first"))
        for attempt in range(ATTEMPTS):
            try:
                coded = self._encoded(first)
                bits = self._united(coded, name)
                break
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise
        offered = coded.withColumns({"bucket": F.floor(F.col("code") / BITS), "bit": F.col("code") % BITS})
        # the bits in force for this batch decide what it admits
        winner = offered.join(bits, "bucket").filter(bit_set(F.col("bits"), F.col("bit"))).select(F.col("key").alias("_key"), F.col("first").alias("_first"))
        joined = arrivals.withColumn("_rank", rank).join(winner, "_key", "left")
        best = F.col("_first").isNotNull() & F.col("_rank").eqNullSafe(F.col("_first"))
        return joined.withColumn("admitted", F.when(non_blank(F.col("_key")), best)).drop("_key", "_order", "_tie", "_rank", "_first", "_number")

    def _encoded(self, first: DataFrame) -> DataFrame:
        """key, code, first of the batch, after its new identifiers are in the dictionary in force.

        Codes count on from the next free one. A new identifier's is the number of new ones in the tasks before its own, a
        prefix sum over one row a task, and its place in its own task; nothing is sorted for it.
        """
        state, run = self.state(), uuid.uuid4().hex
        if state["dictionary"]:
            first = first.join(self.dictionary(state), "key", "left")
            first = first.sortWithinPartitions(F.col("code").isNotNull())  # so that the new ones of a task are numbered without gaps
        else:
            first = first.withColumn("code", F.lit(None).cast("bigint"))
        placed = first.withColumn("place", F.monotonically_increasing_id())
        placed = self.spark.read.schema(placed.schema).parquet(f"{self.folder}/{self._write(placed, f'placed-{run}')}")
        task, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
        sizes = placed.filter("code IS NULL").groupBy(task.alias("task")).agg(F.count("*").alias("n"))
        before = sizes.select("task", (F.sum("n").over(W.orderBy("task")) - F.col("n")).alias("before"))  # one row a task
        new = F.lit(state["next"]) + F.col("before") + inside
        coded = placed.withColumn("task", task).join(F.broadcast(before), "task", "left").select("key", "first", F.coalesce("code", new).alias("code"), F.col("code").isNull().alias("new"))
        added = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if added:
            part = self._write(coded.filter("new").select("key", "code"), f"dictionary-{run}")
            parts = [*state["dictionary"], part]
            if len(parts) > PARTS:
                parts = [self._write(self._read(parts, "key string, code bigint"), f"dictionary-{run}-all")]
            self._publish(state | {"dictionary": parts, "next": state["next"] + added})
        return coded.drop("new")

    def _united(self, coded: DataFrame, name: str) -> DataFrame:
        """bucket, bits that the batch of this name put in force: those of its codes that no bitmap had."""
        state, schema = self.state(), "bucket bigint, bits binary"
        if name not in state["batches"]:
            offered = coded.select(F.floor(F.col("code") / BITS).alias("bucket"), (F.col("code") % BITS).alias("bit"))
            unseen = offered.join(self.seen(state), "bucket", "left").filter(~bit_set(F.col("bits"), F.col("bit")))
            part = self._write(unseen.groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")), f"seen-{uuid.uuid4().hex}")
            if self._read([part], schema).isEmpty():
                return self._read([part], schema)
            parts = [*state["seen"], part]
            if len(parts) > PARTS:
                parts = [self._write(self.seen(state | {"seen": parts}), f"{part}-all")]
            state = self._publish(state | {"seen": parts, "batches": state["batches"] | {name: part}})
        return self._read([state["batches"][name]], schema)


def admit_deliveries(messages: DataFrame, ledger: DeliveryLedger, name: str | None = None) -> DataFrame:
    """Rows of messages (post_id, crawled_at, delivery_id and any others) with ``admitted``."""
    return ledger.admit(messages, "post_id", instant("crawled_at"), F.col("delivery_id"), name=name)
