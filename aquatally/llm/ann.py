"""Nearest neighbours by inner product with collision-counting hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aquatally.llm.util import arrow_rows, quoted, written

PROJECTIONS = 128
COLLISIONS = 0.6  # share of the projections in which a vector must collide to be verified
VERIFIED = 0.2  # share of a block that is verified at least, and 20 * k vectors anyway
GROWTH, LONG = 1.05, 1.25  # each virtual rehash widens all windows by this factor, in long steps while far off
AHEAD = 6  # long steps that are tried at once
BLOCK, QUERIES = 8192, 256
STRIP, TOGETHER = 1024, 32  # vectors and queries whose collisions are counted at a time
PAIRS = 1 << 14  # candidates whose products are taken at a time
SPAN, LEAST = 8, 8  # blocks that one task searches at most; blocks times packs it has at least
CHUNK, TILE = 1 << 18, 1 << 24  # bytes of vectors in a row, and of queries or of their best rows in a task


def projections(size: int, seed: int = 8) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(size + 1, PROJECTIONS))


def hashed(vectors: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Projections of vectors lifted onto a sphere, where the nearest point has the largest product.

    A vector gets one more component that brings its length to ``longest``; a query gets a zero
    and that length, which changes no order among its products.
    """
    squares = np.einsum("ij,ij->i", vectors, vectors)
    if query:
        vectors = vectors * (longest / np.sqrt(squares))[:, None]
        extra = np.zeros(len(vectors))
    else:
        extra = np.sqrt(np.maximum(0.0, longest * longest - squares))
    return np.hstack([vectors, extra[:, None]]) @ projections(vectors.shape[1])


def products(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products, row by row, in double precision, summed component by component."""
    total = np.zeros(len(vectors))
    for x, y in zip(np.ascontiguousarray(vectors.T), np.ascontiguousarray(queries.T)):
        total += x * y
    return total


def candidates(ids: np.ndarray, rough: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the verified vectors that may, by rough products, be among the ``k`` best but the query's own."""
    rough[ids == own] = -np.inf
    if len(rough) > k:
        edge = np.partition(rough, len(rough) - k)[len(rough) - k]
        slack = 1e-9 * max(1.0, float(np.abs(rough[np.isfinite(rough)]).max(initial=0.0)))
        pick = np.flatnonzero(rough >= edge - slack)
    else:
        pick = np.arange(len(rough))
    return pick[ids[pick] != own]


def best(places: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of each query's place, best first, ties to the smaller id."""
    order = np.lexsort((ids, -scores, places))
    places = places[order]
    fit = np.arange(len(places)) - np.searchsorted(places, places) < k
    return places[fit], ids[order][fit], scores[order][fit]


class Block:
    """Sorted arrays of one block: for every projection the sorted values, and each vector's place."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, values: np.ndarray, places: np.ndarray):
        self.ids, self.vectors, self.values, self.places = ids, vectors, values, places

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray, longest: float) -> Block:
        h = hashed(vectors, longest, query=False).T
        kind = np.uint16 if len(ids) < 65536 else np.uint32
        places, values, own = np.empty(h.shape, kind), np.empty(h.shape), np.arange(len(ids), dtype=kind)
        for j, row in enumerate(h):
            order = np.argsort(row, kind="stable")
            places[j, order], values[j] = own, row[order]
        return Block(ids, vectors, values, places)

    def windows(self, queries: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and width, by projection and query, of the windows around the queries."""
        low = np.empty(queries.shape[::-1], np.int64)
        high = np.empty_like(low)
        for j, values in enumerate(self.values):
            order = np.argsort(queries[:, j])  # neighbours are looked up one after the other
            at, wide = queries[order, j], radius[order]
            low[j, order] = np.searchsorted(values, at - wide, "left")
            high[j, order] = np.searchsorted(values, at + wide, "right")
        return low, high - low

    def collisions(self, low: np.ndarray, width: np.ndarray) -> np.ndarray:
        """In how many projections each vector lies in the window of each query: a row per query."""
        kind = self.places.dtype
        low, width = low.T.astype(kind)[:, :, None], width.T.astype(kind)[:, :, None]
        count = np.empty((len(low), len(self.ids)), np.uint8 if PROJECTIONS < 256 else np.uint16)
        for start in range(0, len(self.ids), STRIP):  # a strip stays in the cache for all queries
            places = np.ascontiguousarray(self.places[:, start : start + STRIP])
            gap, inside = np.empty_like(places), np.empty(places.shape, bool)
            for first, size, row in zip(low, width, count[:, start : start + STRIP]):
                np.subtract(places, first, out=gap)  # places before the window wrap round to large numbers
                np.less(gap, size, out=inside)
                np.add.reduce(inside.view(np.uint8), axis=0, dtype=row.dtype, out=row)
        return count

    def verified(self, queries: np.ndarray, longest: float, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the query, places of the vectors that collide often enough with it, their rough products).

        A fifth of the block collides with each query, nearly all of it with one of many: they share one product.
        """
        h = hashed(queries, longest, query=True)
        enough = min(len(self.ids), max(20 * k, int(np.ceil(VERIFIED * len(self.ids)))))
        start = 0.1 * longest
        radius = np.full(len(queries), np.prod([start] + [LONG] * AHEAD))
        waiting, ahead = np.arange(len(queries)), AHEAD
        while len(waiting):
            low, width = self.windows(h[waiting], radius[waiting])
            # by their widths alone, how many vectors should collide often enough
            share = width / len(self.ids)
            mean, spread = share.sum(axis=0), np.sqrt((share * (1 - share)).sum(axis=0)) + 1e-9
            short = (COLLISIONS * PROJECTIONS - 0.5 - mean) / spread / math.sqrt(2)
            expected = np.array([0.5 * math.erfc(x) * len(self.ids) for x in short.tolist()])
            far, whole = expected <= enough / 20, mean >= PROJECTIONS
            if ahead:  # the first steps are jumped over, as fewer collide there; where too many do already they are taken
                radius[waiting[~far]], ahead = start, 0
                radius[waiting[far]] *= LONG
                continue
            ready = np.flatnonzero(whole | (expected >= enough))
            found = np.zeros(len(waiting), bool)
            for some in (ready[i : i + TOGETHER] for i in range(0, len(ready), TOGETHER)):
                rough = queries[waiting[some]] @ self.vectors.T
                for at, count, row in zip(some.tolist(), self.collisions(low[:, some], width[:, some]), rough):
                    hit = np.flatnonzero(count >= COLLISIONS * PROJECTIONS)
                    if len(hit) >= enough or whole[at]:
                        found[at] = True
                        yield int(waiting[at]), hit, row[hit]
            radius[waiting] *= np.where(far, LONG, GROWTH)
            waiting = waiting[~found]

    def nearest(self, own: np.ndarray, queries: np.ndarray, longest: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score) of the block's ``k`` nearest of each query."""
        done, waiting, rows = [], [], 0

        def exact() -> None:
            place, pick = np.repeat([q for q, _ in waiting], [len(p) for _, p in waiting]), np.concatenate([p for _, p in waiting])
            done.append(best(place, self.ids[pick], products(self.vectors[pick], queries[place]), k))
            waiting.clear()

        for q, hit, rough in self.verified(queries, longest, k):
            pick = hit[candidates(self.ids[hit], rough, own[q], k)]
            if len(pick):
                waiting.append((q, pick))
                rows += len(pick)
            if rows > PAIRS:
                exact()
                rows = 0
        if waiting:
            exact()
        return _joined(done)

    def search(self, own: np.ndarray, queries: np.ndarray, longest: float, k: int) -> Iterator[tuple]:
        """(query, ids, scores) of the block's nearest, for each query."""
        place, ids, scores = self.nearest(own, queries, longest, k)
        for q, name in enumerate(own.tolist()):
            yield name, ids[place == q], scores[place == q]


NONE = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)


def _joined(parts: list[tuple]) -> tuple:
    return tuple(np.concatenate(c) for c in zip(NONE, *parts))


class Tile:
    """Packs of queries, and the best rows they have met so far."""

    def __init__(self, longest: float, k: int):
        self.longest, self.k, self.packs, self.found = longest, k, [], []

    def add(self, own: np.ndarray, queries: np.ndarray) -> None:
        self.packs.append((own, queries))
        self.found.append(NONE)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Search a block of vectors for every pack."""
        block = Block.build(ids, vectors, self.longest)
        for i, (own, queries) in enumerate(self.packs):
            new = block.nearest(own, queries.astype(np.float64), self.longest, self.k)
            self.found[i] = best(*_joined([self.found[i], new]), self.k)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for (own, _), (place, ids, scores) in zip(self.packs, self.found):
            yield pa.RecordBatch.from_arrays([pa.array(own[place]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])


def cell(blocks: int, packs: int, most: int, wanted: int) -> tuple[int, int]:
    """Blocks and packs that meet in one task: at least ``wanted`` tasks if there is work for them, few copies of either.

    A pack goes to every span of blocks and brings its best rows back, a block goes to every tile of at most ``most`` packs.
    """
    wanted = max(1, min(wanted, blocks * packs // LEAST))
    choices = []
    for span in range(1, min(SPAN, blocks) + 1):
        spans = -(-blocks // span)
        tile = min(most, -(-packs // -(-wanted // spans)))
        tiles = -(-packs // tile)
        copied = tiles * blocks * BLOCK + 4 * spans * packs * QUERIES
        choices.append((-min(wanted, spans * tiles), copied, -(-blocks // spans), -(-packs // tiles)))  # as even as can be
    return min(choices)[2:]


def _matrix(column: pa.Array, kind: np.dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def nearest_by_product(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` nearest found.

    Every vector is indexed, in blocks of about 8192; a block keeps sorted arrays of 128 random
    projections.  Windows around the query widen until a fifth of the block collides with it in
    60 % of the projections; all such vectors are verified on the originals in double
    precision.  On isotropic random vectors, the hardest case, recall is about 0.95.  Each pack
    of queries meets each block of the index once.

    Vectors move in chunks of a quarter of a megabyte, and a task has a tile of packs and one block at a time: it sorts
    the block's projections where it searches them, and keeps the best rows of its queries over a span of blocks.

    Vectors that are null, zero, hold null or non-finite components, have no id, or have another length than most
    (ties: than the longer) take no part, nor do such queries.  Rows with the query's id are its own; rows
    that share an id but not the vector are spread over blocks.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession

    def sound(df: DataFrame) -> DataFrame:
        v, own = F.col("vector"), df.select(quoted(vector_col)).schema[0].dataType
        floats = isinstance(own, T.ArrayType) and own.elementType == T.FloatType()  # they move at half the size
        vector = quoted(vector_col).cast("array<float>" if floats else "array<double>")
        return df.select(quoted(id_col).cast("long").alias("id"), vector.alias("vector")).where(
            F.col("id").isNotNull()
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0)
        )

    def kind(df: DataFrame) -> np.dtype:
        return np.dtype(np.float32 if df.schema["vector"].dataType.elementType == T.FloatType() else np.float64)

    rows, asked = sound(vectors), sound(queries)
    wide = F.col("vector").cast("array<double>")
    square = F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x)
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(square)).alias("longest"))
    common = lengths.orderBy(F.col("n").desc(), F.col("length").desc()).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    most, total, longest = common
    rows, asked = rows.where(F.size("vector") == most), asked.where(F.size("vector") == most)
    blocks = -(-total // BLOCK)
    groups = max(1, -(-asked.count() // QUERIES))
    row_kind, query_kind = kind(rows), kind(asked)
    pack_bytes = QUERIES * max(query_kind.itemsize * most, 16 * k)
    span, tile = cell(blocks, groups, max(1, TILE // pack_bytes), 6 * spark.sparkContext.defaultParallelism)
    spans, tiles = -(-blocks // span), -(-groups // tile)

    def chunked(df: DataFrame, kind: np.dtype) -> DataFrame:
        """The rows of each code in the order of their ids, in chunks of a bounded size."""
        size = max(1, CHUNK // (kind.itemsize * most))

        def chunks(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            ids, own = table.column("id").to_numpy(), _matrix(table.column("vector").combine_chunks(), kind)
            order = np.argsort(ids, kind="stable")
            parts = [order[i : i + size] for i in range(0, len(order), size)]
            return pa.table(
                {
                    "code": pa.array([table.column("code")[0].as_py()] * len(parts), pa.int64()),
                    "part": pa.array(range(len(parts)), pa.int32()),
                    "ids": pa.array([ids[p].tobytes() for p in parts], pa.binary()),
                    "vectors": pa.array([own[p].tobytes() for p in parts], pa.binary()),
                }
            )

        return df.groupBy("code").applyInArrow(chunks, "code long, part int, ids binary, vectors binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by cell, its packs of queries first, then its blocks, chunk by chunk."""

        def units() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
            name, parts, size = None, [], 0

            def unit() -> tuple:
                kind = query_kind if name[1] < 0 else row_kind
                ids = np.concatenate([np.frombuffer(i, np.int64) for i, _ in parts])
                return *name, ids, np.concatenate([np.frombuffer(v, kind) for _, v in parts]).reshape(len(ids), -1)

            for batch in batches:
                for own, code, ids, v in zip(*(batch.column(c).to_pylist() for c in ("cell", "code", "ids", "vectors"))):
                    limit = 4 * (QUERIES if code < 0 else BLOCK)  # equal rows share a block, however many they are
                    if parts and (name != (own, code) or size + len(ids) // 8 > limit):
                        yield unit()
                        parts, size = [], 0
                    name = own, code
                    parts.append((ids, v))
                    size += len(ids) // 8
            if parts:
                yield unit()

        now, held = None, None
        for own, code, ids, v in units():
            if own != now:
                if held is not None:
                    yield from held.rows()
                now, held = own, Tile(longest, k)
            if code < 0:
                held.add(ids, v)
            else:
                held.meet(ids, v.astype(np.float64))
        if held is not None:
            yield from held.rows()

    block, pack = F.pmod(F.xxhash64("id", wide), F.lit(blocks)), F.pmod(F.xxhash64(F.lit(1), "id", wide), F.lit(groups))
    index = written(chunked(rows.withColumn("code", block), row_kind), "ann-index")
    packs = written(chunked(asked.withColumn("code", pack), query_kind), "ann-queries")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def met(df: DataFrame, code: Column) -> DataFrame:
        return df.select((F.col("tile") * spans + F.col("span")).cast("int").alias("cell"), code.alias("code"), "part", "ids", "vectors")

    code = F.col("code")
    cells = met(packs.withColumn("tile", F.floor(code / tile)).withColumn("span", every(spans)), code - groups).unionByName(
        met(index.withColumn("span", F.floor(code / span)).withColumn("tile", every(tiles)), code)
    )
    dealt = cells.repartitionById(spans * tiles, F.col("cell")).sortWithinPartitions("cell", "code", "part")
    with arrow_rows(spark, 16):  # one row is a whole chunk
        found = written(dealt.mapInArrow(search, "query_id long, vec_id long, score double"), "ann-found")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
