"""Small helpers of the operators: whole-column Arrow maps and tables that cut lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aquatally.functions.dayvec import bind
from aquatally.sources import scratch


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns of ``df`` that do not clash, whatever their case, with ``names``."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ... and the new name of each: nothing an operator adds clashes with them."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.select(*[quoted(c).alias(n) for c, n in names.items()]), names


def named(df: DataFrame, names: dict[str, str], new: Sequence[str] = ()) -> DataFrame:
    """Columns of ``plain`` under their old names, and ``new`` ones, which replace old ones of that name."""
    taken = {n.lower() for n in new}
    old = [F.col(n).alias(c) for c, n in names.items() if c.lower() not in taken]
    return df.select(*old, *new)


def add_columns(
    df: DataFrame, inputs: Sequence[str], fields: str, step: Callable[..., Sequence], spent: Sequence[str] = ()
) -> DataFrame:
    """``df`` with the columns that ``step`` computes from Arrow arrays of ``inputs``.

    Other columns pass unchanged, but for inputs that are ``spent``; one whose name clashes with a new column is replaced.
    """
    small_batches(df.sparkSession)
    new = T.StructType.fromDDL(fields)
    kept = without(df, [*new.names, *spent])
    gone = [c for c in inputs if c not in kept]
    source = df.select(*[quoted(c) for c in kept], *[quoted(c) for c in gone])
    places = [(kept + gone).index(c) for c in inputs]
    schema = T.StructType([source.schema[c] for c in kept] + list(new.fields))
    width = len(kept)
    types = [arrow_type(f.dataType) for f in new.fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = step(*[batch.column(i) for i in places])
            arrays = [a if isinstance(a, pa.Array) else pa.array(a, type=t) for a, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays(list(batch.columns[:width]) + arrays, names=names)

    return source.mapInArrow(run, schema)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Texts go to Python few at a time: a batch counts rows, and a row may be a long document.

    The setting stays in the session, as plans are run after they are made.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, jobs hand Python at most ``rows`` rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def as_bytes(texts: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text."""
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, no step runs twice."""
    path = scratch.new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sum(values: Column, block: int = 64) -> Column:
    """Running sums of an array, by blocks, so that long arrays cost little more than their length."""
    none = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, none, lambda s, x: s + x)

    def over_blocks(blocks: Column) -> Column:
        def over_sums(sums: Column) -> Column:
            def sums_of(own: Column, k: Column) -> Column:
                head = total(F.slice(sums, F.lit(1), k))
                return bind(head, lambda h: F.transform(own, lambda _, i: h + total(F.slice(own, F.lit(1), i + 1))))

            return F.flatten(F.transform(blocks, sums_of))

        return bind(F.transform(blocks, total), over_sums)

    def over_values(bound: Column) -> Column:
        last = F.floor((F.size(bound) - 1) / block).cast("int")
        return bind(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(bound, k * block + 1, F.lit(block))), over_blocks)

    return bind(values, over_values)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
