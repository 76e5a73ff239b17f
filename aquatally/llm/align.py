"""Alignment of two tokenizers over a corpus: each distinct text once, pairs weighted by its copies."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquatally.llm.packing import _byte_names
from aquatally.llm.util import as_bytes, quoted, small_batches, written

#: How the byte-level vocabulary cuts texts before it merges: a fixed value of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_LINKS = 1_000_000  # links that a chunk holds
LONG_SPACE = " " * 10_000
MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
_LOADED: dict[tuple, TwoTokenizers] = {}


class TwoTokenizers:
    """Both tokenizers, and the bytes and decimal names of their ids."""

    def __init__(self, ranks_path: str, json_path: str, piece_path: str):
        import sentencepiece
        import tiktoken

        self.json_path, self.slow = json_path, None
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(json_path, encoding="utf-8") as f:
            names = json.load(f)["model"]["vocab"]
        code = {ord(c): b for b, c in _byte_names().items()}
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(name.translate(code), "latin-1") if all(ord(c) in code for c in name) else name.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # decimal ids with the mark behind them: within a group, and where its part of a side ends
        named = lambda size, mark: np.array([f"{i}{mark}" for i in range(size)], object)
        self.a_inner, self.a_last = named(len(self.a_bytes), ","), named(len(self.a_bytes), "|")
        self.b_inner, self.b_last = named(len(self.b_bytes), ","), named(len(self.b_bytes), ";")

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _a_ids(self, text: str) -> list[int]:
        if LONG_SPACE not in text:  # the fast form cuts by a pattern that goes back and forth in white space
            try:
                return self.a.encode_ordinary(text)
            except ValueError:
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both; none if the bytes of either do not make up the text behind a space."""
        if text:
            whole = " " + text
            a, b = self._a_ids(whole), self.b.encode(text)
            raw = whole.encode()
            if b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b)):
                return np.array(a, np.int64), np.array(b, np.int64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def aligned(self, text: str) -> tuple[int, int, int, str, np.ndarray]:
        """(tokens of A, of B, groups, the groups' text, the linked pairs as A * 2**32 + B)."""
        a, b = self.ids(text)
        if len(a) == 0:
            return 0, 0, 0, "", np.zeros(0, np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        a_at = np.searchsorted(b_ends, a_ends)
        a_cut = b_ends[np.minimum(a_at, len(b) - 1)] == a_ends  # both end here: a group ends
        b_at = np.searchsorted(a_ends, b_ends)
        b_cut = a_ends[np.minimum(b_at, len(a) - 1)] == b_ends
        # every byte stretch between two ends of either is one link
        ends = np.concatenate([a_ends, b_ends[~b_cut]])
        links = (a[np.searchsorted(a_ends, ends)] << 32) | b[np.searchsorted(b_ends, ends)]
        # a group's tokens of A come before those of B
        a_last, b_last = np.flatnonzero(a_cut), np.flatnonzero(b_cut)
        a_group = np.cumsum(a_cut) - a_cut
        b_group = np.cumsum(b_cut) - b_cut
        out = np.empty(len(a) + len(b), object)
        b_before = np.concatenate(([0], b_last + 1))
        out[np.arange(len(a)) + b_before[a_group]] = np.where(a_cut, self.a_last[a], self.a_inner[a])
        out[np.arange(len(b)) + a_last[b_group] + 1] = np.where(b_cut, self.b_last[b], self.b_inner[b])
        return len(a), len(b), len(a_last), "".join(out.tolist())[:-1], links


def two_tokenizers(*paths: str) -> TwoTokenizers:
    if paths not in _LOADED:
        _LOADED[paths] = TwoTokenizers(*paths)
    return _LOADED[paths]


def _packed(values: np.ndarray, dtype: str) -> bytes:
    return pa.compress(values.astype(dtype).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int, dtype: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def _aligned_texts(texts: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """Rows of distinct texts and, for each chunk of them, one row of its pairs.

    ``texts`` has text and copies.  A text's row has its digest, measures and its links as places in the
    chunk's list of pairs, frequent ones first; the chunk's row (no digest) has these pairs and
    their weighted numbers.
    """
    names = ["chunk", "digest", *MEASURES, "groups_sha256", "links", "pairs", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = two_tokenizers(*paths)

        def closed(rows: list[tuple]) -> pa.RecordBatch:
            # a text is in one chunk, so its digest names the chunk: a task that runs again names it alike
            chunk = int.from_bytes(rows[0][0][:8], "little", signed=True)
            sizes = np.array([len(r[5]) for r in rows])
            pairs, place = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True)
            copies = np.array([r[6] for r in rows], np.float64)
            plain = np.bincount(place, minlength=len(pairs))
            counts = np.bincount(place, np.repeat(copies, sizes), len(pairs)).astype(np.int64)
            order = np.argsort(-plain, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            own = np.split(rank[place], np.cumsum(sizes)[:-1])
            last = [len(pairs)]
            columns = [
                pa.array([chunk] * (len(rows) + 1), pa.int64()),
                pa.array([r[0] for r in rows] + [None], pa.binary()),
                *[pa.array([r[i] for r in rows] + [0], pa.int64()) for i in (1, 2, 3)],
                pa.array(sizes.tolist() + last, pa.int64()),
                pa.array([r[4] for r in rows] + [None], pa.string()),
                pa.array([_packed(x, "<u4") for x in own] + [None], pa.binary()),
                pa.array([None] * len(rows) + [_packed(pairs[order], "<i8")], pa.binary()),
                pa.array([None] * len(rows) + [_packed(counts[order], "<i8")], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        held, size = [], 0
        for batch in batches:
            for text, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b, groups, listed, links = two.aligned(text)
                sha = hashlib.sha256(listed.encode()).hexdigest() if a else ""
                held.append((hashlib.sha256(text.encode()).digest(), a, b, groups, sha, links, copies))
                size += len(links)
                if size >= CHUNK_LINKS:
                    yield closed(held)
                    held, size = [], 0
        if held:
            yield closed(held)

    fields = "chunk long, digest binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs binary, counts binary"
    return texts.mapInArrow(run, fields)


def _chunk_pairs(chunks: DataFrame) -> DataFrame:
    """(chunk, place, pair, n) from the packed pairs of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, size, pairs, counts in zip(*[c.to_pylist() for c in batch.columns]):
                columns = [np.full(size, chunk), np.arange(size), _unpacked(pairs, size, "<i8"), _unpacked(counts, size, "<i8")]
                for at in range(0, size, 65_536):
                    part = [pa.array(c[at : at + 65_536], pa.int64()) for c in columns]
                    yield pa.RecordBatch.from_arrays(part, names=["chunk", "place", "pair", "n"])

    packed = chunks.select("chunk", "n_links", "pairs", "counts")
    return packed.mapInArrow(run, "chunk long, place long, pair long, n long")


def pair_counts(chunk_pairs: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold the pair, and whether none of its B id's pairs has more."""
    counts = written(chunk_pairs.groupBy("pair").agg(F.sum("n").alias("n")), "align-counts")
    b = F.col("pair").bitwiseAND(F.lit(2**32 - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _measured(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """(digest, measures) of every distinct text, from its chunk's rows and the counts of the chunk's pairs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place, n, best = (right.column(c).to_numpy() for c in ("place", "n", "best"))
        total, top = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        total[place], top[place] = n, best
        bests, sums = [], []
        for size, links in zip(left.column("n_links").to_pylist(), left.column("links").to_pylist()):
            own = _unpacked(links, size, "<u4") if size else np.zeros(0, np.int64)
            bests.append(int(top[own].sum()))
            sums.append(int(total[own].sum()))
        kept = left.select(["digest", *MEASURES])
        kept = kept.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))
        return kept.append_column("groups_sha256", left.column("groups_sha256"))

    schema = "digest binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def align_documents(
    docs: DataFrame, ranks_path: str, json_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document row.

    A is a byte-level vocabulary (its ranks, and its json form for texts the fast library cannot take), which
    encodes the text behind a space; B is a piece vocabulary, which adds that space.  Offsets at which both end cut
    the tokens into groups; a link is a pair of tokens that share bytes, and a pair of ids counts
    the links of the whole corpus that hold it.  The text is shuffled once: equal texts are tokenised and
    aligned once and weigh their copies.  Pairs combine in chunks of about a million links and then over all;
    each chunk gets the counts of its own pairs back, and the measures are joined to the ids by the text's digest.

    Texts null, empty or not made up of either's bytes have zeros and an empty groups_sha256, and link nothing.
    Rows without an id and repeated rows are rows like any other.  Other columns are ignored.  An
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    own = docs.select(quoted(id_col).cast("long").alias("doc"), quoted(text_col).alias("text"))
    texts = own.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    rows = written(_aligned_texts(texts, (ranks_path, json_path, piece_path)), "align-texts")
    chunk_pairs = written(_chunk_pairs(rows.where("digest is null")), "align-pairs")
    counted = chunk_pairs.drop("n").join(pair_counts(chunk_pairs), "pair").select("chunk", "place", "n", "best")
    found = written(_measured(rows.where("digest is not null"), counted), "align-measures")
    named = own.select("doc", F.when(F.col("text") != "", F.unhex(F.sha2("text", 256))).alias("sha"))
    met = named.join(found, F.col("sha") == F.col("digest"), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*MEASURES, "n_best", "count_sum")]
    return met.select(F.col("doc").alias(id_col), *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
