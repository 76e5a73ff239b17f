"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquatally.llm.graph import components
from aquatally.llm.util import arrow_rows, as_bytes, named, plain, quoted, small_batches, written

UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BRANCHES = 2
DEPTH = 6
SKETCH = 192
BLOCK = 512  # records of a node that one block holds
DENSE = 4  # candidates for each record of two blocks from which the blocks' sets are compared as a whole
SET_BYTES = 4 << 20  # hashes that a block with sets holds
DEVIATIONS = 4.3  # how far below the threshold a sketch may estimate a link
OUTSIDE = 256  # records outside a node's largest component that meet all of them at once
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)


def trees_for(recall: float, similarity: float) -> int:
    """Trees after which a pair at the threshold has met with the probability ``recall``.

    A pair stays together along a branch with the probability of its similarity, so the
    chance that a tree of any depth loses it is the fixed point of (1 - s + s x) ** branches.  What
    the sketches lose, in all trees at once, comes off what the trees may lose.
    """
    sketched = math.erfc(DEVIATIONS / math.sqrt(2)) / 2
    if 1 - recall <= sketched:
        raise ValueError(f"the sketches lose {sketched:.1e} of the links at the threshold")
    lost = 0.0
    for _ in range(10_000):
        lost = (1 - similarity + similarity * lost) ** BRANCHES
    return max(1, math.ceil(math.log(1 - recall - sketched) / math.log(lost)))


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the text's shingles; of a shorter text, of all its words."""
    parts = text.translate(UPPER_TO_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    own = np.array(list(map(xxhash.xxh3_64_intdigest, parts)), np.uint64)
    width = min(words, len(own))
    out = np.full(len(own) - width + 1, width, np.uint64)
    for i in range(width):
        out *= MULTIPLIER
        out ^= out >> np.uint64(29)
        out += own[i : len(own) - width + 1 + i]
    out *= SPREAD
    out ^= out >> np.uint64(32)
    out *= MULTIPLIER
    return np.unique(out >> np.uint64(16))


def minwise(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The smallest value of each of the random functions over a set."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * factors
        part += shifts
        np.minimum(out, part.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def packed(hashes: np.ndarray) -> bytes:
    """Six bytes per hash."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :6] = raw
    return full.view("<u8").ravel()


def set_id(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a whole set."""
    return int(np.array(xxhash.xxh3_64_intdigest(hashes.tobytes()), np.uint64).view(np.int64))


def matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """Fixed-size binaries as rows of numbers."""
    if len(column) == 0:
        return np.zeros((0, 1), dtype)
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


class NearJoin:
    """One join: parameters, the tables it builds, and the links it has confirmed."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, recall: float, small: int):
        self.spark = docs.sparkSession
        small_batches(self.spark)
        self.docs = docs.select(quoted(id_col).cast("long").alias("doc"), quoted(text_col).alias("text"))
        self.words, self.percent, self.small = words, percent, small
        self.trees = trees_for(recall, percent / 100)
        functions = max(SKETCH, self.trees * BRANCHES * DEPTH)
        draws = np.random.default_rng(20)
        self.factors = draws.integers(1, 2**63, functions, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = draws.integers(0, 2**63, functions, np.uint64) * np.uint64(2)
        share = percent / 100
        self.agree = SKETCH * max(0.0, share - DEVIATIONS * math.sqrt(share * (1 - share) / SKETCH))
        self.likely_agree = SKETCH * max(0.0, percent / 100 - 0.05)

    def signatures(self) -> DataFrame:
        """(doc, n_shingles, rec, coords, sketch); rec, the set's fingerprint, is null without words."""
        words, factors, shifts = self.words, self.factors, self.shifts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, recs, coords, sketches = [], [], [], []
                for text in as_bytes(batch.column(1)):
                    hashes = shingle_hashes(text or b"", words)
                    sizes.append(len(hashes))
                    if len(hashes) == 0:
                        recs.append(None), coords.append(None), sketches.append(None)
                        continue
                    least = minwise(hashes, factors, shifts)
                    recs.append(set_id(hashes))
                    coords.append(least.tobytes())
                    sketches.append((least[:SKETCH] & 0xFF).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(recs, pa.int64()),
                     pa.array(coords, pa.binary()), pa.array(sketches, pa.binary())],
                    names=["doc", "n_shingles", "rec", "coords", "sketch"],
                )

        return self.docs.mapInArrow(run, "doc long, n_shingles long, rec long, coords binary, sketch binary")

    def branch(self, rows: DataFrame, depth: int) -> DataFrame:
        """(node, tree, rec) of the children; ``rows`` has node, tree, rec, coords (at depth 0 only rec, coords).

        A child is named by its parent and by the value of one of the functions that the tree
        has at this depth; all records of a node branch by the same ones.
        """
        trees, step = self.trees, self.trees * BRANCHES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = matrix(batch.column(batch.num_columns - 1), "<u4")
                recs = batch.column(batch.num_columns - 2).to_numpy()
                nodes, owners, numbers = [], [], []
                for tree in range(trees):
                    if depth == 0:
                        mine, parent = np.arange(len(recs)), np.zeros(len(recs), np.uint64)
                    else:
                        mine = np.flatnonzero(batch.column(1).to_numpy() == tree)
                        parent = batch.column(0).to_numpy()[mine].view(np.uint64)
                    for j in range(BRANCHES):
                        at = depth * step + tree * BRANCHES + j
                        child = (parent + np.uint64(at + 1)) * MULTIPLIER
                        child ^= child >> np.uint64(31)
                        child = (child + values[mine, at].astype(np.uint64)) * SPREAD
                        child ^= child >> np.uint64(33)
                        nodes.append((child * MULTIPLIER).view(np.int64))
                        owners.append(recs[mine])
                        numbers.append(np.full(len(mine), tree, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(nodes)), pa.array(np.concatenate(numbers)), pa.array(np.concatenate(owners))],
                    names=["node", "tree", "rec"],
                )

        return rows.mapInArrow(run, "node long, tree int, rec long")

    def _blocks(self, rows: DataFrame, sketches: DataFrame) -> DataFrame:
        """Blocks of about BLOCK members (rec, comp, size, sketch) of each node; ``rows`` has node, rec, comp, n, alone."""
        blocks = F.ceil(F.col("n") / BLOCK).cast("long")
        return (
            rows.join(sketches, "rec")
            .withColumn("block", F.pmod(F.xxhash64("rec"), blocks))
            .groupBy("node", "block")
            .agg(F.sort_array(F.collect_list(F.struct("rec", "comp", "size", "sketch"))).alias("members"), F.max("alone").alias("alone"))
        )

    def likely(self, rows: DataFrame, sketches: DataFrame) -> DataFrame:
        """Pairs (a, b) of likely links: of each block, with the next one of its node, a spanning
        forest of the greatest agreements.  A record that is similar to another one without being
        in the forest comes as a pair with itself.
        """
        agree, likely, percent = self.agree, self.likely_agree, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for left, right in zip(batch.column(0), batch.column(1)):
                    rec, _, size, sketch = _members(left)
                    if right.is_valid:
                        more, _, sizes, other = _members(right)
                        rec, size, sketch = (np.concatenate(x) for x in ([rec, more], [size, sizes], [sketch, other]))
                    same = _agreements(sketch, sketch) * _fitting(size, size, percent)
                    np.fill_diagonal(same, 0)
                    alike = rec[(same >= agree).any(axis=1)]
                    p, q = _forest(same, likely)
                    a += [alike, np.minimum(rec[p], rec[q])]
                    b += [alike, np.maximum(rec[p], rec[q])]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        blocks = self._blocks(rows.withColumn("comp", F.col("rec")).withColumn("alone", F.lit(False)), sketches)
        after = blocks.select(F.col("node").alias("node2"), (F.col("block") - 1).alias("before"), F.col("members").alias("members2"))
        met = blocks.join(after, (F.col("node") == F.col("node2")) & (F.col("block") == F.col("before")), "left")
        return met.select("members", "members2").mapInArrow(run, "a long, b long").distinct()

    def crossing(self, rows: DataFrame, sketches: DataFrame) -> DataFrame:
        """(a, b, dense): pairs of one node and two components whose sketches agree.

        With ``alone`` set, a node's rows are compared with those outside its largest component only.
        Two blocks with many such pairs for each record give links to one record of each connected part, ``dense``, in
        place of the pairs: so the rows grow with the records of the blocks and not with their square.
        """
        agree, percent = self.agree, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, dense = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
                for left, right in zip(batch.column(0), batch.column(1)):
                    (rx, cx, nx, sx), (ry, cy, ny, sy) = _members(left), _members(right)
                    hit = (_agreements(sx, sy) >= agree) & (cx[:, None] != cy[None]) & _fitting(nx, ny, percent)
                    p, q = np.nonzero(hit)
                    one, other = np.minimum(rx[p], ry[q]), np.maximum(rx[p], ry[q])
                    many = len(p) > DENSE * (len(np.unique(p)) + len(np.unique(q)))
                    if many:
                        one, other = _spanning(one, other)
                    a.append(one)
                    b.append(other)
                    dense.append(np.full(len(one), many))
                arrays = [pa.array(np.concatenate(x)) for x in (a, b, dense)]
                yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "dense"])

        every = self._blocks(rows, sketches)
        fewer = self._blocks(rows.where("not alone or comp <> top"), sketches)
        others = fewer.select("node", F.col("block").alias("block2"), F.col("members").alias("members2"))
        met = every.join(others, "node").where("alone or block <= block2")
        return met.select("members", "members2").mapInArrow(run, "a long, b long, dense boolean").distinct()

    def within(self, rows: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs (a, b) that connect what links between two components of one cluster connect; ``rows`` has node, rec, comp, size.

        The whole sets of a cluster's records meet block by block, so what moves are blocks and not pairs;
        each two blocks are a task's row of their own.
        """
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for left, right in zip(batch.column(0), batch.column(1)):
                    (rx, cx, hx), (ry, cy, hy) = _with_sets(left), _with_sets(right)
                    shared = _shared(hx, hy)
                    nx, ny = np.array(list(map(len, hx))), np.array(list(map(len, hy)))
                    linked = (100 * shared >= percent * (nx[:, None] + ny[None] - shared)) & (cx[:, None] != cy[None])
                    p, q = np.nonzero(linked)
                    one, other = _spanning(np.minimum(rx[p], ry[q]), np.maximum(rx[p], ry[q]))
                    a.append(one)
                    b.append(other)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        bytes_ = F.sum("size") * 6
        clusters = rows.groupBy("node").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, bytes_ / SET_BYTES)).cast("long").alias("blocks"))
        blocks = (
            rows.join(clusters, "node")
            .join(sets, "rec")
            .withColumn("block", F.pmod(F.xxhash64("rec"), F.col("blocks")))
            .groupBy("node", "blocks", "block")
            .agg(F.collect_list(F.struct("rec", "comp", "hashes")).alias("members"))
        )
        blocks = written(blocks, "near-blocks")
        left = blocks.select("node", "block", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block2"), "members")
        right = blocks.select("node", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("block"), F.col("block").alias("block2"), F.col("members").alias("members2"))
        met = left.join(right, ["node", "block", "block2"]).select("members", "members2")
        with arrow_rows(self.spark, 4):  # a row is two blocks of sets
            return written(met.mapInArrow(run, "a long, b long"), "near-within")

    def set_table(self, wanted: DataFrame) -> DataFrame:
        """(rec, hashes) of the wanted records (rec, doc), from whole texts read again."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                recs, sets = [], []
                for rec, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                    hashes = shingle_hashes(text or b"", words)
                    if len(hashes) and set_id(hashes) == rec:  # not another row with this id
                        recs.append(rec)
                        sets.append(packed(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(recs, pa.int64()), pa.array(sets, pa.binary())], names=["rec", "hashes"])

        met = self.docs.join(wanted.withColumnRenamed("doc", "first"), F.col("doc").eqNullSafe(F.col("first")))
        return met.select("rec", "text").mapInArrow(run, "rec long, hashes binary")

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets are similar enough."""
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, one = None, None
            for batch in batches:
                keep = []
                a = batch.column(0).to_pylist()
                for i, rec in enumerate(a):
                    if rec != last:
                        last, one = rec, unpacked(batch.column(2)[i].as_py())
                    other = unpacked(batch.column(3)[i].as_py())
                    # both are sorted without repeats: a repeat of the merged list is shared
                    merged = np.concatenate([one, other])
                    merged.sort(kind="stable")
                    shared = int((merged[1:] == merged[:-1]).sum())
                    keep.append(100 * shared >= percent * (len(merged) - shared))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        one = sets.select(F.col("rec").alias("b"), F.col("hashes").alias("hb"))
        other = sets.select(F.col("rec").alias("a"), F.col("hashes").alias("ha"))
        met = pairs.join(one, "b").join(other, "a").select("a", "b", "ha", "hb")
        return met.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 75,
    recall: float = 0.9999,
    small: int = 2048,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) per document row.

    Documents are linked if ``percent`` % or more of their distinct ``words``-word shingles are
    shared; a component's id is its smallest document id.  Documents with the same set are
    one record.  Records branch along paths of minwise tokens, in independent trees; nodes
    of ``small`` records or fewer are compared exhaustively, larger ones branch on, and what is left
    after the last level is compared in blocks.  Before that, a spanning forest of the likeliest
    links of each block is confirmed: records already connected need no pair of their own, so
    a large group of near copies costs a tree and not its square, and a large node with few
    records outside one component is done when these have met all.  Full sets confirm every link: pair by
    pair where records have few candidates, and in blocks of sets where they have many.

    Rows without words have n_shingles 0 and stay alone.  Rows that share an id count as one
    document that stays or goes as a whole; rows without an id are kept.  Fewer words than
    ``words`` make one shingle.  An empty table gives no rows.
    """
    join = NearJoin(docs, id_col, text_col, words, percent, recall, small)
    signed = written(join.signatures(), "near-signed")
    records = written(
        signed.where("rec is not null")
        .groupBy("rec")
        .agg(F.min("doc").alias("doc"), F.max("n_shingles").alias("size"), F.max("coords").alias("coords"), F.max("sketch").alias("sketch")),
        "near-records",
    )
    sketches, values = records.select("rec", "size", "sketch"), records.select("rec", "coords")
    rows = written(join.branch(values, 0), "near-rows")
    live = written(_paired(rows), "near-live")
    # the likeliest links first: what they connect needs no further pairs
    likely = written(join.likely(live, sketches), "near-likely")
    wanted = (
        likely.select(F.explode(F.array("a", "b")).alias("rec"))
        .unionByName(live.where(F.col("n") > small).select("rec"))
        .distinct()
    )
    sets = written(join.set_table(wanted.join(records.select("rec", "doc"), "rec")), "near-sets")
    links = written(join.confirmed(likely.where("a <> b"), sets), "near-links")
    roots = written(components(links), "near-roots")
    # pairs between the components that are left of small nodes; larger ones branch on
    pairs, rows = [], live.select("node", "tree", "rec")
    for depth in range(DEPTH):
        rows = written(_ranked(_with_roots(rows, roots), small), "near-mixed")
        last = depth == DEPTH - 1
        pairs.append(written(join.crossing(rows if last else rows.where("done"), sketches), "near-pairs"))
        rows = rows.where("not done")
        if last or rows.isEmpty():
            break
        rows = join.branch(rows.join(values, "rec").select("node", "tree", "rec", "coords"), depth + 1).distinct()
    every = pairs[0]
    for part in pairs[1:]:
        every = every.unionByName(part)
    # records with many candidates each form clusters, whose sets are compared as a whole
    clusters = written(components(every.where("dense").select("a", "b")), "near-clusters")
    grouped = not clusters.isEmpty()
    every = every.where("not dense").select("a", "b")
    if grouped:
        every = _outside(every, clusters)
    every = written(every.distinct(), "near-open")
    # blocks that are no neighbours meet only here: what their records need is read now
    ends = every.select(F.explode(F.array("a", "b")).alias("rec")).unionByName(clusters.select(F.col("node").alias("rec"))).distinct()
    missing = written(ends.join(sets.select("rec"), "rec", "left_anti").join(records.select("rec", "doc"), "rec"), "near-missing")
    if not missing.isEmpty():
        sets = sets.unionByName(written(join.set_table(missing), "near-sets"))
    crossing = join.confirmed(every, sets)
    if grouped:
        own = clusters.select(F.col("node").alias("rec"), F.col("root").alias("cluster")).join(records.select("rec", "size"), "rec")
        crossing = crossing.unionByName(join.within(_with_roots(own, roots).withColumnRenamed("cluster", "node"), sets))
    links = crossing.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = written(components(written(links, "near-links")), "near-roots")
    groups = _with_roots(records.select("rec", "doc"), roots)
    least = groups.groupBy("comp").agg(F.min("doc").alias("component_id"))
    classes = groups.join(least, "comp").select(F.col("rec").alias("r"), "component_id")
    out = signed.select("doc", "n_shingles", "rec").join(classes, F.col("rec") == F.col("r"), "left")
    component = F.when(F.col("rec").isNull(), F.col("doc")).otherwise(F.col("component_id"))
    return out.select(
        F.col("doc").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        (F.col("doc").isNull() | F.col("doc").eqNullSafe(component)).alias("kept"),
    )


def _members(block: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    fields = block.values
    rec, comp, size = (fields.field(n).to_numpy() for n in ("rec", "comp", "size"))
    return rec, comp, size, matrix(fields.field("sketch"), "u1")


def _with_sets(block: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    fields = block.values
    return fields.field("rec").to_numpy(), fields.field("comp").to_numpy(), [unpacked(h) for h in fields.field("hashes").to_pylist()]


def _fitting(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets of these sizes can be similar enough."""
    return 100 * np.minimum(x[:, None], y[None]) >= percent * np.maximum(x[:, None], y[None])


def _shared(x: list[np.ndarray], y: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many hashes each set of one block shares with each one of another."""
    out = np.zeros((len(x), len(y)))
    whole = [np.concatenate(sets) for sets in (x, y)]
    owner = [np.repeat(np.arange(len(sets)), list(map(len, sets))) for sets in (x, y)]
    common = np.intersect1d(np.unique(whole[0]), np.unique(whole[1]))
    if len(common) == 0:
        return out
    place = [np.minimum(np.searchsorted(common, w), len(common) - 1) for w in whole]
    held = [common[p] == w for p, w in zip(place, whole)]
    place, owner = [p[h] for p, h in zip(place, held)], [o[h] for o, h in zip(owner, held)]
    for at in range(0, len(common), columns):
        sides = []
        for p, o, sets in zip(place, owner, (x, y)):
            mine = (p >= at) & (p < at + columns)
            grid = np.zeros((len(sets), min(columns, len(common) - at)), np.float32)
            grid[o[mine], p[mine] - at] = 1
            sides.append(grid)
        out += sides[0] @ sides[1].T
    return out


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the smallest node to each other one, for all nodes that the links (a, b) connect."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    near = np.zeros((len(nodes), len(nodes)), bool)
    near[place[: len(a)], place[len(a) :]] = True
    near |= near.T
    fresh = np.ones(len(nodes), bool)
    p, q = [], []
    for first in range(len(nodes)):
        if not fresh[first]:
            continue
        fresh[first] = False
        reached = [first]
        for i in reached:
            more = np.flatnonzero(near[i] & fresh)
            fresh[more] = False
            reached += more.tolist()
        p += [first] * (len(reached) - 1)
        q += reached[1:]
    return nodes[np.array(p, np.int64)], nodes[np.array(q, np.int64)]


def _agreements(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places each sketch of one block agrees with each one of another."""
    if len(x) * len(y) <= 4096:
        return (x[:, None, :] == y[None]).sum(axis=2, dtype=np.uint8)
    out = np.zeros((len(x), len(y)), np.uint8)
    for a, b in zip(x.T, y.T):
        out += a[:, None] == b[None]
    return out


def _forest(same: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the spanning forest of greatest agreements, none below ``least``."""
    n = len(same)
    if n == 2:
        return (np.array([0]), np.array([1])) if same[0, 1] >= least else (np.zeros(0, int), np.zeros(0, int))
    best, parent = same[0].astype(np.int64), np.zeros(n, np.int64)
    best[0] = -1
    out = np.zeros(n, bool)
    out[0] = True
    p, q = [], []
    for _ in range(n - 1):
        i = int(best.argmax())
        if best[i] < least:  # nothing near what is there: the next tree begins
            rest = np.flatnonzero(~out)
            if not (same[rest].max(axis=1) >= least).any():
                break
            i = int(rest[0])
        else:
            p.append(int(parent[i]))
            q.append(i)
        out[i] = True
        best[i] = -1
        nearer = (same[i] > best) & ~out
        best[nearer] = same[i][nearer]
        parent[nearer] = i
    return np.array(p, np.int64), np.array(q, np.int64)


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the component of their record; a record without links is its own."""
    met = rows.join(roots.withColumnRenamed("node", "__node"), F.col("rec") == F.col("__node"), "left")
    return met.withColumn("comp", F.coalesce("root", "rec")).drop("__node", "root")


def _outside(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pairs (a, b) that do not lie in one cluster."""
    for end in ("a", "b"):
        pairs = pairs.join(clusters.select(F.col("node").alias(end), F.col("root").alias(f"{end}_in")), end, "left")
    return pairs.where("a_in is null or b_in is null or a_in <> b_in").select("a", "b")


def _ranked(rows: DataFrame, small: int) -> DataFrame:
    """Rows of nodes that hold two components or more, with the node's size and largest component
    ``top``; ``alone`` if few records are outside it in a large node, ``done`` if it can be compared now."""
    parts = rows.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("c"))
    nodes = parts.groupBy("node").agg(
        F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("parts")
    )
    alone = (F.col("n") > small) & (F.col("n") - F.col("top.c") <= OUTSIDE)
    nodes = nodes.where("parts > 1").select(
        "node", "n", F.col("top.comp").alias("top"), alone.alias("alone"), ((F.col("n") <= small) | alone).alias("done")
    )
    return rows.join(nodes, "node")


def _paired(rows: DataFrame) -> DataFrame:
    """Rows of nodes that hold two records or more, with the node's size."""
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(nodes.where("n > 1"), "node")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The document rows of ``docs`` that stay: of each group the smallest id."""
    docs, names = plain(docs)  # so that none of its columns clashes
    gone = near_duplicates(docs, names[id_col], names[text_col], **options).where("not kept")
    gone = gone.select(F.col(names[id_col]).alias("gone")).distinct()
    return named(docs.join(gone, F.col(names[id_col]).cast("long") == F.col("gone"), "left_anti"), names)
