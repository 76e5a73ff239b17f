"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aquatally.llm.util import as_bytes, quoted, small_batches, without, written
from aquatally.sources import scratch

UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
START, END = np.uint64(0x5374617274), np.uint64(0x456E64)  # a word's hash is these with no greater chance than any other's
CHUNK_TOKENS = 1_500_000  # tokens that a task counts at once
SCORE_TOKENS = 500_000  # and that it scores at once
SHARD_BYTES = 16 << 20  # text per shard of the counts
WORDS_PER_SHARD = 1 << 20
SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
WORD = np.dtype([("count", "<u8"), ("total", "<u8"), ("weight", "<f8"), ("alone", "<f8")])


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and what all tokens share.

    ``pairs-N.keys.npy`` holds the sorted hashes of a shard's word pairs and ``.values.npy`` their counts;
    ``words-N`` likewise for words: count, tokens that followed, the weight left to the
    lower order, and the probability without a context.
    """

    folder: str
    shards: int
    spread: dict[int, int]  # words whose pairs are dealt over several shards; at most 4 * shards of them
    word_shards: int
    tokens: int
    vocabulary: int
    discounts: tuple[float, float, float]
    unseen: float  # probability of one unseen word without a context


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more; (0.5, 1, 1.5) where the numbers of rare counts give none."""
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        found = tuple(k + 1 - (k + 2) * y * b / a for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4))))
        if all(0 <= d <= k + 1 for k, d in enumerate(found)):
            return found
    return 0.5, 1.0, 1.5


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = before * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def shards_of(before: np.ndarray, keys: np.ndarray, shards: int, spread: dict[int, int]) -> np.ndarray:
    """Shard of each pair: by its first word; pairs of a very frequent first word by the pair, too."""
    own = (((before >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
    if spread:
        hot = np.array(sorted(spread), np.uint64)
        width = np.array([spread[int(w)] for w in hot], np.int64)
        at = np.minimum(np.searchsorted(hot, before), len(hot) - 1)
        mine = hot[at] == before
        own[mine] = (own[mine] + (keys[mine] >> np.uint64(40)).astype(np.int64) % width[at[mine]]) % shards
    return own


def _tokens(texts: list[bytes | None]) -> tuple[list[np.ndarray], int]:
    """Word hashes of each text, the end last."""
    out, total = [], 0
    for text in texts:
        parts = (text or b"").translate(UPPER_TO_LOWER).split()
        own = np.empty(len(parts) + 1, np.uint64)
        own[:-1] = np.array(list(map(xxhash.xxh3_64_intdigest, parts)), np.uint64)
        own[-1] = END
        out.append(own)
        total += len(own)
    return out, total


def _before(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The token before each one; the start before a text's first."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[0] = START
    out[ends[:-1]] = START
    return out


def _chunks(
    batches: Iterator[pa.RecordBatch], column: int, most: int
) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches and their tokens, about ``most`` at a time."""
    held, tokens, size = [], [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        own, n = _tokens(as_bytes(batch.column(column)))
        held.append(batch)
        tokens += own
        size += n
        if size >= most:
            yield held, tokens
            held, tokens, size = [], [], 0
    if held:
        yield held, tokens


def local_path(folder: str) -> str:
    """The path of a folder that all workers reach as files, for these map the arrays."""
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise RuntimeError(f"{folder} cannot be memory-mapped: name a mounted folder that all executors share")
    return unquote(parts.path) if parts.scheme else folder


def _save(path: str, values: np.ndarray) -> None:
    """Write beside, then rename: a task that is run again, or twice, leaves one whole file."""
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "wb") as out:
        np.save(out, values)
    os.replace(beside, path)


def _mapped(path: str) -> np.ndarray | None:
    """The array in a file, mapped and not read; None if there is no such file."""
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


def _looked_up(folder: str, kind: str, shard: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
    """Fill ``values`` for the ``keys`` found in the mapped arrays of their shards; keys are sorted."""
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for mine in np.split(order, cuts) if len(order) else []:
        path = f"{folder}/{kind}-{shard[mine[0]]:07d}"
        known = _mapped(path + ".keys.npy")
        if known is None or len(known) == 0:
            continue
        at = np.minimum(np.searchsorted(known, keys[mine]), len(known) - 1)
        hit = known[at] == keys[mine]
        values[mine[hit]] = _mapped(path + ".values.npy")[at[hit]]


def _frequent(docs: DataFrame, shards: int) -> dict[int, int]:
    """Over how many shards the pairs of each very frequent word are dealt.

    Each chunk names the words that make up a quarter of a shard's share there; so a word beyond half a
    share of all is named by some chunk, and at most ``4 * shards`` words pass the mark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens in _chunks(batches, 0, CHUNK_TOKENS):
            every = np.concatenate(tokens)
            word, count = np.unique(every, return_counts=True)
            some = count >= len(every) / (4 * shards)
            word, count = np.append(word[some], START), np.append(count[some], len(tokens))
            sizes = np.zeros(len(word), np.int64)
            sizes[0] = len(every)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count), pa.array(sizes)], names=["word", "n", "size"])

    if shards == 1:
        return {}
    found = written(docs.mapInArrow(run, "word long, n long, size long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("size").alias("size")), "lm-frequent")
    total = found.agg(F.sum("size")).first()[0] or 0
    rows = found.where(F.col("n") >= total / (4 * shards)).select("word", "n").collect()  # at most 4 * shards rows
    return {r.word & (2**64 - 1): min(shards, math.ceil(4 * shards * r.n / total)) for r in rows}


def _pair_blocks(docs: DataFrame, shards: int, spread: dict[int, int]) -> DataFrame:
    """(shard, words, lengths, followers, counts): each chunk's distinct pairs, packed by first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens in _chunks(batches, 0, CHUNK_TOKENS):
            word = np.concatenate(tokens)
            before = _before(word, np.cumsum([len(t) for t in tokens]))
            keys, first, count = np.unique(pair_keys(before, word), return_index=True, return_counts=True)
            word, before = word[first], before[first]
            shard = shards_of(before, keys, shards, spread)
            order = np.lexsort((before, shard))
            word, before, count, shard = word[order], before[order], count[order].astype("<u4"), shard[order]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = before[low:high]
                heads = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
                lengths = np.diff(np.append(heads, high - low)).astype("<u4")
                blobs = own[heads], lengths, word[low:high], count[low:high]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(shard[low])], pa.int64()), *[pa.array([b.tobytes()], pa.binary()) for b in blobs]],
                    names=["shard", "words", "lengths", "followers", "counts"],
                )

    return docs.mapInArrow(run, "shard long, words binary, lengths binary, followers binary, counts binary")


def _sums(by: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct numbers in ``by`` and the sums of the values of each."""
    order = np.argsort(by, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], by[order][1:] != by[order][:-1])))
    return by[order][heads], *[np.add.reduceat(v[order], heads) for v in values]


def _merged(blocks: DataFrame, folder: str) -> DataFrame:
    """Write every shard's sorted pairs; give each word's part of the statistics.

    (word, total, n1, n2, n3, kinds, count): tokens that followed the word, how many words followed it
    once, twice, more often; how many words it followed, and how often.  The row without
    a word has the numbers of pairs seen once, twice, three and four times in n1, n2, n3 and total.
    """
    names = ["word", "total", "n1", "n2", "n3", "kinds", "count"]

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        def column(name: str, dtype: str) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)

        before = np.repeat(column("words", "<u8"), column("lengths", "<u4"))
        word = column("followers", "<u8")
        keys, first = np.unique(pair_keys(before, word), return_inverse=True)
        count = np.bincount(first, column("counts", "<u4"), len(keys)).astype(np.int64)
        where = np.empty(len(keys), np.int64)
        where[first] = np.arange(len(word))
        before, word = before[where], word[where]
        path = f"{folder}/pairs-{key[0].as_py():07d}"
        _save(path + ".values.npy", count.astype("<u4" if count.max() < 2**32 else "<u8"))
        _save(path + ".keys.npy", keys)
        one = np.ones(len(keys), np.int64)
        led = _sums(before, count, *[(c * one) for c in (count == 1, count == 2, count >= 3)])
        ended = _sums(word, one, count)
        seen = np.bincount(np.minimum(count, 5), minlength=6)
        none, some = np.zeros(len(led[0]), np.int64), np.zeros(len(ended[0]), np.int64)
        columns = [
            np.concatenate([led[0], ended[0], [np.uint64(0)]]).view(np.int64),
            np.concatenate([led[1], some, [seen[4]]]),
            *[np.concatenate([led[k + 1], some, [seen[k]]]) for k in (1, 2, 3)],
            *[np.concatenate([none, ended[k], [0]]) for k in (1, 2)],
        ]
        hidden = np.zeros(len(columns[0]), bool)
        hidden[-1] = True
        arrays = [pa.array(columns[0], mask=hidden)] + [pa.array(c.astype(np.int64)) for c in columns[1:]]
        return pa.Table.from_arrays(arrays, names=names)

    return blocks.groupBy("shard").applyInArrow(merge, ", ".join(f"{n} long" for n in names))


def train(docs: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    """Count a bigram model over ``docs`` and write its arrays to the shared folder.

    Tokens are words, cut at ASCII white space with A-Z lower-cased, and one end per text.  Word pairs
    combine in each task's chunk, travel packed by their first word, and meet in shards sized by the input; a very
    frequent first word is dealt over several.  Each shard becomes two sorted files.  Null text
    counts as empty: one end.  Repeated rows count as often as they come.  An empty table gives
    a model in which all words are unseen.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch.new_path(spark, "lm")
    path = local_path(folder)
    os.makedirs(path, exist_ok=True)
    docs = docs.select(quoted(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / shard_bytes))
    spread = _frequent(docs, shards)
    parts = written(_merged(_pair_blocks(docs, shards, spread), path), "lm-parts")
    rare = parts.where("word is null").agg(*[F.sum(c) for c in ("n1", "n2", "n3", "total")]).first()
    d1, d2, d3 = discounts = discounts_of(*[x or 0 for x in rare])
    sums = [F.sum(c).alias(c) for c in ("total", "n1", "n2", "n3", "kinds", "count")]
    words = written(parts.where("word is not null").groupBy("word").agg(*sums), "lm-words")
    all_ = words.agg(
        F.sum("count"), F.sum((F.col("count") > 0).cast("long")), F.sum("kinds"), F.count(F.lit(1)),
        *[F.sum((F.col("kinds") == k).cast("long")) for k in (1, 2, 3, 4)], F.sum((F.col("kinds") >= 3).cast("long")),
    ).first()
    tokens, vocabulary, kinds, rows, k1, k2, k3, k4, more = [x or 0 for x in all_]
    e1, e2, e3 = discounts_of(k1, k2, k3, k4)
    unseen = (e1 * k1 + e2 * k2 + e3 * more) / max(1, kinds) / (vocabulary + 1) if kinds else 1.0 / (vocabulary + 1)
    word_shards = max(1, math.ceil(rows / WORDS_PER_SHARD))

    def write(key: tuple, table: pa.Table) -> pa.Table:
        column = {n: table.column(n).to_numpy() for n in table.column_names}
        hashes = column["word"].view(np.uint64)
        order = np.argsort(hashes)
        values = np.zeros(len(order), WORD)
        kinds_of, total = column["kinds"], column["total"]
        off = np.array([0.0, e1, e2, e3])[np.minimum(kinds_of, 3)]
        values["count"], values["total"] = column["count"], total
        values["weight"] = (d1 * column["n1"] + d2 * column["n2"] + d3 * column["n3"]) / np.maximum(1, total)
        values["alone"] = (kinds_of - off) / max(1, kinds) + unseen
        name = f"{path}/words-{key[0].as_py():07d}"
        _save(name + ".values.npy", values[order])
        _save(name + ".keys.npy", hashes[order])
        return pa.table({"n": [len(order)]})

    # the top bits of the hash, unsigned, so that a shard is a range
    shard = F.shiftrightunsigned("word", 32) * word_shards
    words = words.withColumn("shard", F.shiftrightunsigned(shard, 32))
    written(words.groupBy("shard").applyInArrow(write, "n long"), "lm-files")
    return Model(path, shards, spread, word_shards, tokens, vocabulary, discounts, unseen)


def word_values(model: Model, hashes: np.ndarray) -> np.ndarray:
    """Values of sorted word hashes; those of unseen words are theirs."""
    out = np.zeros(len(hashes), WORD)
    out["alone"] = model.unseen
    shard = ((hashes >> np.uint64(32)) * np.uint64(model.word_shards)) >> np.uint64(32)
    _looked_up(model.folder, "words", shard.astype(np.int64), hashes, out)
    return out


def pair_counts(model: Model, before: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each pair was seen; ``keys`` are sorted."""
    out = np.zeros(len(keys), np.int64)
    _looked_up(model.folder, "pairs", shards_of(before, keys, model.shards, model.spread), keys, out)
    return out


def probabilities(model: Model, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each word behind the one before it, training count of the word)."""
    known, place = np.unique(np.concatenate([word, before]), return_inverse=True)
    values = word_values(model, known)
    own, context = place[: len(word)], place[len(word) :]
    chance = np.where(values["total"] > 0, values["weight"], 1.0)[context] * values["alone"][own]
    keys, first, place = np.unique(pair_keys(before, word), return_index=True, return_inverse=True)
    count = pair_counts(model, before[first], keys)
    seen = count - np.array([0.0, *model.discounts])[np.minimum(count, 3)]
    chance += seen[place] / np.maximum(1, values["total"])[context]
    return chance, values["count"][own]


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_tokens, n_known, train_tokens, base_score, score and perplexity.

    ``score`` is the model's log10 probability of the whole text with its end, ``base_score`` that of
    single tokens with one added to every count, n_known the tokens that the model has seen.  Each task takes chunks of
    whole texts; their distinct words and pairs, in hash order, are looked up in the mapped arrays
    shard by shard, so a chunk goes through each file once, forwards.  Null text is only an end.  Rows are scored
    one by one.  Columns with the new names are replaced.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in SCORES.split(", ")]
    kept = [c for c in without(docs, [*names, "perplexity"]) if c.lower() != text_col.lower()]
    source = docs.select(*[quoted(c) for c in kept], quoted(text_col))
    width = len(kept)
    tokens, vocabulary = model.tokens, model.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in _chunks(batches, width, SCORE_TOKENS):
            sizes = np.array([len(t) for t in texts])
            word, ends = np.concatenate(texts), np.cumsum(sizes)
            chance, count = probabilities(model, _before(word, ends), word)
            heads = ends - sizes
            known = np.add.reduceat((count > 0).astype(np.int64), heads)
            base = np.add.reduceat(np.log10((count + 1.0) / (tokens + vocabulary + 1)), heads)
            whole = np.add.reduceat(np.log10(chance), heads)
            columns = [sizes, known, np.full(len(sizes), tokens), base, whole]
            at = 0
            for batch in held:
                mine = slice(at, at + batch.num_rows)
                at += batch.num_rows
                arrays = list(batch.columns[:width]) + [pa.array(c[mine]) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=kept + names)

    schema = source.select(*[quoted(c) for c in kept]).schema
    for field in SCORES.split(", "):
        schema = schema.add(*field.split())
    out = source.mapInArrow(run, schema)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    """Whether a document is kept from training, by its id; a missing id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document scored by a model of those that are not held out."""
    docs = docs.withColumn("held_out", held_out(quoted(id_col)))
    return score(docs, train(docs.where("not held_out"), text_col), text_col)
