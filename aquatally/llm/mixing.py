"""Mixing sources to target weights by balanced (cube) sampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aquatally.llm.util import add_columns, as_bytes, quoted, written


def count_words(texts: pa.Array) -> Sequence:
    """Runs of characters other than ASCII white space; a null text has none."""
    return ([len(t.split()) if t else 0 for t in as_bytes(texts)],)


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources by code point, null last, take ``weights`` in turn.  A target is the weight's share of
    all sizes; no target exceeds ``most`` times its source, and the excess is shared out by weight.
    Sources with the smallest size for their weight reach their limit first, so one running
    sum in that order finds the level at which the others stand.
    """
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("long")
    by_limit = W.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    table = (
        sizes.withColumn("weight", weight)
        .withColumn("limit", F.col("source_size") * most)
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("limits_before", F.sum("limit").over(by_limit) - F.col("limit"))
        .withColumn("weights_before", F.sum("weight").over(by_limit) - F.col("weight"))
        # a source stands at its limit if the level reached with it still open is above the limit
        .withColumn(
            "capped",
            F.col("limit") * (F.col("weights") - F.col("weights_before"))
            <= (F.col("total") - F.col("limits_before")) * F.col("weight"),
        )
        .withColumn("rest", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("limit"))).over(everything), F.lit(0)))
        .withColumn("open", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything))
    )
    target = F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(
        (F.col("rest") * F.col("weight")).cast("double") / F.col("open").cast("double")
    )
    return table.select("source", "source_size", target.alias("target"))


SPARE = 10


def flight(chances: np.ndarray, sizes: np.ndarray, draws: np.random.Generator, spare: int = SPARE) -> np.ndarray:
    """Cube method: chances moved to 0 or 1, keeping both their sum and the sum of chance times size.

    Three undecided units at a time span a direction that changes neither sum; a fair step
    along it decides one of them at least, and the next unit takes its place.  The last
    ``spare`` units and two more at most stay undecided.
    """
    out = chances.astype(float).copy()
    undecided = np.flatnonzero((out > 1e-9) & (out < 1 - 1e-9)).tolist()
    out[out <= 1e-9], out[out >= 1 - 1e-9] = 0.0, 1.0
    flying = undecided[: max(0, len(undecided) - spare)]
    coins = draws.random(len(flying) + 1)
    hand: list[tuple[int, float, float]] = []
    for turn, i in enumerate(flying):
        hand.append((i, out[i], float(sizes[i])))
        if len(hand) < 3:
            continue
        (_, _, s0), (_, _, s1), (_, _, s2) = hand
        along = (s1 - s2, s2 - s0, s0 - s1) if not s0 == s1 == s2 else (1.0, -1.0, 0.0)
        up = down = float("inf")
        for (_, p, _), u in zip(hand, along):
            if u > 0:
                up, down = min(up, (1 - p) / u), min(down, p / u)
            elif u < 0:
                up, down = min(up, p / -u), min(down, (1 - p) / -u)
        step = up if coins[turn] * (up + down) < down else -down
        left = []
        for (j, p, s), u in zip(hand, along):
            p += step * u
            if 1e-9 < p < 1 - 1e-9:
                left.append((j, p, s))
            else:
                out[j] = 0.0 if p <= 1e-9 else 1.0
        hand = left
    for j, p, _ in hand:
        out[j] = p
    return out


def land(chances: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Decides what a flight left: of all choices the one nearest to the sums that were owed,
    words first and documents second."""
    out = chances.copy()
    units = np.flatnonzero((out > 0) & (out < 1))
    choices = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
    words = np.abs(choices @ sizes[units] - out[units] @ sizes[units])
    number = np.abs(choices.sum(axis=1) - out[units].sum())
    scale = max(1.0, float(sizes[units].mean())) if len(units) else 1.0
    out[units] = choices[np.argmin(words / scale + number / 100)]
    return out


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    most: int = 3,
    group_rows: int = 8192,
    seed: int = 0,
) -> DataFrame:
    """How often each document row is taken so that sources reach their target weights.

    Returns (id, size, source, source_size, target, copies), one row per document row.  A row's expected copies are
    target / source_size, at most ``most``; the whole part is taken outright, the rest decided by
    a cube flight within groups of about ``group_rows`` rows of one source, then by flights
    over the few rows each left undecided, and by one landing per source.  Rows alike in id, text and source are one
    unit, taken as often as all of them, and share that out evenly: so however many there are, they
    are one row of a group.  Null text has size 0, null sources form a source of their own, and reruns
    agree.  An empty table gives no rows.
    """
    units = mixed_units(docs, id_col, text_col, source_col, weights, most, group_rows, seed)
    # a unit of very many rows is spread before it becomes rows again
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / group_rows))).alias("piece")
    pieces = units.select("*", piece)
    pieces = pieces.where(F.col("rows") <= group_rows).unionByName(
        pieces.where(F.col("rows") > group_rows).repartition("code", "piece")
    )
    last = F.least(F.col("rows"), (F.col("piece") + 1) * group_rows) - 1
    rows = pieces.withColumn("number", F.explode(F.sequence(F.col("piece") * group_rows, last)))
    return rows.select(
        F.col("id").alias(id_col), "code", "size", F.col("source").alias(source_col), "source_size", "target", _share().alias("copies")
    )


def _share() -> Column:
    """What the row ``number`` (from 0) of a unit of ``rows`` gets of the ``taken`` copies."""
    even = F.floor(F.col("taken") / F.col("rows"))
    return (even + (F.col("number") < F.col("taken") - even * F.col("rows")).cast("long")).cast("long")


def mixed_units(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], most: int, group_rows: int, seed: int
) -> DataFrame:
    """(id, code, source, size, source_size, target, rows, taken): how often ``rows`` rows alike are taken together."""
    ids = F.struct(F.xxhash64(quoted(id_col), quoted(text_col)).alias("code"), quoted(id_col).alias("id"))
    sized = add_columns(
        docs.select(ids.alias("unit"), quoted(source_col).alias("source"), quoted(text_col).alias("text")),
        ["text"],
        "size long",
        count_words,
    ).select("unit.code", "unit.id", "source", "size")
    sized = written(sized, "mix-sizes")
    alike = sized.groupBy("code", "source").agg(F.first("id").alias("id"), F.first("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("all_rows"))
    targets = source_targets(per_source.select("source", "source_size"), weights, most).join(
        per_source.select(F.col("source").alias("s"), "all_rows"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")
    targets = written(targets, "mix-targets")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.least(copies * F.col("rows"), F.lit(float(most)) * F.col("rows"))
    groups = F.ceil(F.col("all_rows") / group_rows).cast("long")
    units = (
        alike.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("id", F.col("id").cast("string"))  # pandas has no nulls in integers
        .withColumn("whole", F.floor(copies).cast("long"))
        .withColumn("chance", copies - F.floor(copies))
        .withColumn("place", F.pmod(F.xxhash64(F.lit(seed), "code"), groups))
        .drop("all_rows")
    )
    schema = "id string, code long, source string, size long, rows long, source_size long, target double, whole long, chance double, place long"
    units = written(units.groupBy("source", "place").applyInPandas(_flights(seed), schema), "mix-flight-0")
    decided = [units.where("chance = 0 or chance = 1")]
    rest, level = units.where("chance > 0 and chance < 1"), 0
    # a dozen rows at most are left of each group; 4096 groups' leftovers meet, then a source's
    for together in (4096, None):
        level += 1
        place = F.floor(F.col("place") / together) if together else F.lit(0).cast("long")
        last = together is None
        rest = written(
            rest.withColumn("place", place).groupBy("source", "place").applyInPandas(_flights(seed + level, last), schema),
            f"mix-flight-{level}",
        )
        decided.append(rest.where("chance = 0 or chance = 1"))
        rest = rest.where("chance > 0 and chance < 1")
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out.select(
        F.col("id").cast(sized.schema["id"].dataType).alias("id"),
        "code", "source", "size", "source_size", "target", "rows",
        (F.col("whole") + F.col("chance").cast("long")).alias("taken"),
    )


def mixed_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    most: int = 3,
    group_rows: int = 8192,
    seed: int = 0,
) -> DataFrame:
    """The rows of ``docs``, each repeated as often as ``mix`` takes it.

    Rows alike in id, text and source share out their copies evenly.  They are numbered part by part: each task of a
    written table numbers its own, and a sum over the parts' counts tells where a part begins.
    """
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # so that no name clashes
    col = lambda name: f"c{docs.columns.index(name)}"
    units = mixed_units(own, col(id_col), col(text_col), col(source_col), weights, most, group_rows, seed)
    units = units.where("taken > 0").select("code", F.col("source").alias("of"), "rows", "taken")
    met = own.withColumn("own", F.xxhash64(col(id_col), col(text_col))).join(
        units, (F.col("own") == F.col("code")) & F.col(col(source_col)).eqNullSafe(F.col("of"))
    )
    single = met.where("rows = 1").withColumn("copies", F.col("taken"))
    several = written(met.where("rows > 1").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "mix-alike")
    unit = [F.col("code"), F.col("of")]
    before = (
        several.groupBy(*unit, "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(W.partitionBy(*unit).orderBy("part")) - F.col("n"))
        .select(F.col("code").alias("k"), F.col("of").alias("s"), F.col("part").alias("p"), "before")
    )
    local = several.withColumn("local", F.row_number().over(W.partitionBy(*unit, "part").orderBy("row")) - 1)
    numbered = local.join(before, (F.col("code") == F.col("k")) & F.col("of").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    numbered = numbered.withColumn("number", F.col("local") + F.col("before")).withColumn("copies", _share())
    out = single.select(*own.columns, "copies").unionByName(numbered.select(*own.columns, "copies")).where("copies > 0")
    again = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select(*own.columns).toDF(*docs.columns)


def _flights(seed: int, last: bool = False):
    def fly(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # the order is the rows' own, so that a task run again decides alike
        rows = rows.sort_values(["code", "size", "chance"], kind="stable").reset_index(drop=True)
        draws = np.random.default_rng(xxhash.xxh3_64_intdigest(f"{seed}/{key[0]}/{key[1]}"))
        sizes = rows["size"].to_numpy(float)
        chances = flight(rows["chance"].to_numpy(float), sizes, draws)
        rows["chance"] = land(chances, sizes) if last else chances
        return rows

    return fly
