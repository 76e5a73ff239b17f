"""Packing of token ids into windows: bounded-space best fit, then a merge of leftovers."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aquatally.llm.util import as_bytes, quoted, small_batches, written

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# A run of letters and the marks behind it are always separate tokens; an apostrophe may
# begin a token of marks and letters.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_KNOWN: dict[str, tuple] = {}


def _byte_names() -> dict[int, str]:
    """How byte-level vocabularies write a byte: printable Latin-1 as itself, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def word_ids(tokenizer_path: str, most: int = 500_000) -> Callable[[Sequence[bytes]], list[bytes]]:
    """A function from UTF-8 texts to their token ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it, so ids are looked up word by
    word, and the tokenizer sees a word once per worker; a word of plain Latin letters goes
    to its merges directly.  At ``most`` words the store starts anew, which bounds its memory
    and changes no result.
    """
    if tokenizer_path not in _KNOWN:
        tokenizer = Tokenizer.from_file(tokenizer_path)
        last = max(tokenizer.get_vocab().values())
        _KNOWN[tokenizer_path] = tokenizer, [struct.pack("<I", i) for i in range(last + 1)], {}
    tokenizer, packed, known = _KNOWN[tokenizer_path]
    merge, names = tokenizer.model.tokenize, _byte_names()

    def learn(words: set[bytes]) -> None:
        whole: list[bytes] = []
        split: list[tuple[bytes, bytes, bytes]] = []
        for word in words:
            text = word.decode("utf-8", "replace")
            core = text.rstrip(_MARKS)
            # up to Latin Extended-B a letter has one small letter, but for a dotted capital I
            if not core.isalpha() or not (core.isascii() or (max(core) < "\u0250" and "\u0130" not in core)):
                whole.append(word)
                continue
            key, tail = core.lower().encode(), text[len(core) :].encode()
            if key not in known:
                name = key.decode("latin-1")
                known[key] = b"".join([packed[t.id] for t in merge(name if name.isascii() else name.translate(names))])
            if tail and tail not in known:
                whole.append(tail)
            if key != word:
                split.append((word, key, tail))
        texts = [w.decode("utf-8", "replace") for w in whole]
        for word, e in zip(whole, tokenizer.encode_batch(texts, add_special_tokens=False)):
            known[word] = b"".join([packed[i] for i in e.ids])
        for word, key, tail in split:
            known[word] = known[key] + known[tail] if tail else known[key]

    def ids_of(texts: Sequence[bytes]) -> list[bytes]:
        words = [t.split() for t in texts]
        new = set(chain.from_iterable(words)).difference(known)
        if new:
            if len(known) > most:
                known.clear()
                new = set(chain.from_iterable(words))
            learn(new)
        return [b"".join(map(known.__getitem__, w)) for w in words]

    return ids_of


class OpenWindows:
    """A fixed number of open windows; items go to the fullest window that still takes them."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id = size, most, first_id
        self.room: list[tuple[int, int]] = []  # (free, window), sorted

    def full(self) -> int:
        """The id of a window of its own, for an item that fills it."""
        self.next_id += 1
        return self.next_id - 1

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) of an item shorter than a window."""
        at = bisect_left(self.room, (length, -1))
        if at == len(self.room):
            if len(self.room) >= self.most:
                del self.room[0]  # the fullest goes out
            free, window = self.size, self.full()
        else:
            free, window = self.room.pop(at)
        if free > length:
            insort(self.room, (free - length, window))
        return window, self.size - free


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
    open_windows: int = 64,
    with_ids: bool = False,
) -> DataFrame:
    """Cut documents into pieces and pack these into windows of ``window`` tokens.

    One row per piece: document, ``start`` among its ids, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset`` and, if asked for, the ``ids``.  A document's
    whole windows stand alone; its rest goes best-fit into one of ``open_windows`` open windows
    of the partition, and the fullest one is closed when none has room.  What is open at the
    end of a partition is merged with the leftovers of other partitions.  Null text counts as
    empty: only ``end_id``.  Rows are packed one by one, so repeated rows and null ids stay
    apart.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    fields = PIECE + ", open boolean" + (", ids array<long>" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer_path)
        windows = OpenWindows(window, open_windows, TaskContext.get().partitionId() << 32)
        held: dict[int, list[tuple]] = {}  # pieces of open windows, by window

        def table(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 8
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array([is_open] * len(rows), pa.bool_())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype("i8") for x in columns[7]], pa.list_(pa.int64())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            done: list[tuple] = []
            texts = [t or b"" for t in as_bytes(batch.column(1))]
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of(texts)):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    length = len(part) // 4
                    place, offset = windows.place(length) if length < window else (windows.full(), 0)
                    piece = (doc, start, length, zlib.crc32(part), total, place, offset, part if with_ids else None)
                    if length == window:
                        done.append(piece)
                    else:
                        held.setdefault(place, []).append(piece)
            still = {w for _, w in windows.room}
            for place in [w for w in held if w not in still]:
                done += held.pop(place)
            if done:
                yield table(done, False)
        rest = [p for pieces in held.values() for p in pieces]
        if rest:
            yield table(rest, True)

    small_batches(spark)
    source = docs.select(quoted(id_col).cast("long"), quoted(text_col))
    pieces = written(source.mapInArrow(run, fields), "pieces")
    moved = _merged_leftovers(pieces, window, open_windows)
    out = pieces.join(moved, pieces["sequence_id"] == moved["old"], "left").select(
        *[pieces[c] for c in pieces.columns if c not in ("sequence_id", "offset", "open")],
        F.coalesce(moved["new"], pieces["sequence_id"]).alias("sequence_id"),
        (pieces["offset"] + F.coalesce(moved["shift"], F.lit(0))).alias("offset"),
    )
    return out


def _merged_leftovers(pieces: DataFrame, window: int, open_windows: int, together: int = 256) -> DataFrame:
    """(old, new, shift): where each window left open by a partition goes.

    The windows left by ``together`` partitions meet in one task, which again packs them
    best-fit with a fixed number of open windows; only lengths move.
    """
    left = (
        pieces.where("open")
        .groupBy(F.col("sequence_id").alias("old"))
        .agg(F.sum("length").alias("filled"))
        .withColumn("meet", F.shiftright("old", 32) / together)
        .withColumn("meet", F.floor("meet"))
    )

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["filled", "old"], ascending=[False, True])
        windows = OpenWindows(window, 4 * open_windows, 0)
        first: dict[int, int] = {}
        new, shift = [], []
        for old, filled in zip(rows["old"].tolist(), rows["filled"].tolist()):
            place, offset = windows.place(filled)
            new.append(first.setdefault(place, old))
            shift.append(offset)
        return pd.DataFrame({"old": rows["old"], "new": new, "shift": shift})

    return left.groupBy("meet").applyInPandas(merge, "old long, new long, shift long")
