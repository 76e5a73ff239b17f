"""Line deduplication with levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from aquatally.llm.util import add_columns, as_bytes, named, plain, quoted, small_batches, written

UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACES = b" \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def line_digest(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, or None if the key is shorter than ``min_chars``."""
    key = line.strip(SPACES)
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.translate(UPPER_TO_LOWER))


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Rows (doc, h1, h2): the distinct long line keys of each document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests = [], []
            for text in as_bytes(batch.column(1)):
                own = {line_digest(x, min_chars) for x in (text or b"").split(b"\n")}
                own.discard(None)
                counts.append(len(own))
                digests.extend(own)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc", *KEY]
            )

    small_batches(docs.sparkSession)
    source = docs.select(own_id(docs, id_col).alias("doc"), quoted(text_col).alias("text"))
    half = T.LongType()
    return source.mapInArrow(run, T.StructType([source.schema["doc"], *[T.StructField(k, half) for k in KEY]]))


def own_id(docs: DataFrame, id_col: str) -> Column:
    """The id as it is compared: whole numbers as long, others as they are."""
    kind = docs.select(quoted(id_col).alias("id")).schema["id"].dataType
    return quoted(id_col).cast("long") if isinstance(kind, T.IntegralType) else quoted(id_col)


def place(doc: Column, kind: T.DataType) -> Column:
    """A number that grows with the id or stays: of a text its first seven bytes."""
    if isinstance(kind, T.NumericType):
        return doc.cast("double")
    if isinstance(kind, T.StringType):
        first = F.hex(F.substring(F.encode(doc, "UTF-8"), 1, 7))
        return F.conv(F.rpad(first, 14, "0"), 16, 10).cast("double")
    return F.unix_micros(doc.cast("timestamp")).cast("double")


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, keeper), in levels of at most ``fan_in`` runs.

    A run is a bucketed, sorted table, so a batch merges with it without moving it.
    Batches come from the largest document ids down: the keeper of a key is the largest id
    of the first batch that has it.  Keys already in ``enough`` documents get no new rows.
    """

    def __init__(self, spark: SparkSession, buckets: int, enough: int, fan_in: int = 2):
        self.spark, self.buckets, self.enough, self.fan_in = spark, buckets, enough, fan_in
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.made = 0

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def add(self, keys: DataFrame) -> None:
        """Merge-anti-join the batch's keys (doc, h1, h2) with every run, then add its own run."""
        batch = (
            keys.groupBy(*KEY)
            .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("keeper"))
            .repartition(self.buckets, *KEY)
            .withColumn("before", F.lit(0).cast("long"))
        )
        for run in self.runs():
            batch = batch.join(run.select(*KEY, F.col("n_docs").alias("has")), KEY, "left").select(
                *KEY, "n_docs", "keeper", (F.col("before") + F.coalesce("has", F.lit(0))).alias("before")
            )
        # unseen keys (the anti-join proper), and seen ones whose count still matters
        self._save(batch.where(F.col("before") < self.enough), 0)
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            self._compact(level)
            level += 1

    def _save(self, rows: DataFrame, level: int) -> None:
        table = f"{self.name}_{self.made}"
        self.made += 1
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)  # known before it is written, so that a failed write is dropped too
        rows.select(*KEY, "n_docs", "keeper").write.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(table)

    def _compact(self, level: int) -> None:
        old = self.levels[level]
        self._save(self._merged([self.spark.table(t) for t in old]), level + 1)
        self.levels[level] = []
        for table in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.join(
                run.select(*KEY, F.col("n_docs").alias("n"), F.col("keeper").alias("k")), KEY, "full"
            ).select(
                *KEY,
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"),
                F.greatest("keeper", "k").alias("keeper"),
            )
        return out

    def frequent(self) -> DataFrame:
        """Keys in ``enough`` documents or more, with the document that keeps its lines."""
        return self._merged(self.runs()).where(F.col("n_docs") >= self.enough).select(*KEY, "keeper")

    def drop(self) -> None:
        for level in self.levels:
            for table in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.levels = [[]]


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
) -> DataFrame:
    """Drop lines found in ``min_docs`` documents or more, except in the largest id.

    A line's key is the line without surrounding ASCII white space, A-Z lower-cased; keys
    shorter than ``min_chars`` code points are never dropped.  The text becomes what is left
    (null becomes empty); adds ``n_lines`` and ``n_dropped``.  Rows with one id are one document; rows without an id are one
    document too, the smallest.  Ids are numbers, texts (by their UTF-8 bytes), dates or times.  Null text is an empty line.
    An empty table stays empty.  Columns called ``n_lines`` or ``n_dropped`` are replaced, others pass whatever their names.
    """
    spark = docs.sparkSession
    docs, names = plain(docs)
    id_col, text_col = names[id_col], names[text_col]
    # rows with one id are one document: a key counts once for it
    keys = line_keys(docs, id_col, text_col, min_chars)
    at = place(F.col("doc"), keys.schema["doc"].dataType)
    ids = docs.select(place(own_id(docs, id_col), keys.schema["doc"].dataType).alias("at"))
    cuts = ids.stat.approxQuantile("at", [i / batches for i in range(1, batches)], 0.01)
    number = F.lit(0)
    for cut in cuts:
        number = number + F.coalesce((at > cut).cast("int"), F.lit(0))
    keys = written(keys.distinct().withColumn("batch", number), "line-keys")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = LineRuns(spark, max(1, min(partitions, 100_000)), min_docs)
    try:
        for batch in range(len(cuts), -1, -1):
            runs.add(keys.where(F.col("batch") == batch))
        frequent = written(runs.frequent(), "line-frequent")
    finally:
        runs.drop()
    gone = (
        keys.join(frequent, KEY)
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("doc")
        .agg(F.collect_list(F.struct(*KEY)).alias("gone"))
    )
    out = _without_lines(docs, gone, id_col, text_col, min_chars)
    return named(out, names, ["n_lines", "n_dropped"])


def _without_lines(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    def step(texts: pa.Array, lost: pa.Array):
        kept, n_lines, n_dropped = [], [], []
        starts = lost.offsets.to_numpy()
        halves = lost.values
        digests = np.empty((len(halves), 2), dtype="<i8")
        digests[:, 0], digests[:, 1] = halves.field(0).to_numpy(), halves.field(1).to_numpy()
        packed = digests.tobytes()
        for i, text in enumerate(as_bytes(texts)):
            lines = (text or b"").split(b"\n")
            n_lines.append(len(lines))
            first, last = (starts[i], starts[i + 1]) if lost[i].is_valid else (0, 0)
            if first == last:
                kept.append(text or b"")
                n_dropped.append(0)
                continue
            drop = {packed[16 * j : 16 * j + 16] for j in range(first, last)}
            left = [x for x in lines if line_digest(x, min_chars) not in drop]
            kept.append(b"\n".join(left))
            n_dropped.append(len(lines) - len(left))
        return pa.array(kept, pa.binary()).cast(pa.string()), n_lines, n_dropped

    gone = gone.withColumnRenamed("doc", "__doc").withColumnRenamed("gone", "__gone")
    joined = docs.join(gone, own_id(docs, id_col).eqNullSafe(F.col("__doc")), "left")
    fields = f"`{text_col}` string, n_lines long, n_dropped long"
    return add_columns(joined.drop("__doc"), [text_col, "__gone"], fields, step).drop("__gone")
