"""Removal of byte strings that an earlier document holds, by longest previous factors."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquatally.llm.util import as_bytes, quoted, small_batches, written

GRAM = 24  # bytes of an anchor
CHUNK = 1 << 22  # windows of a long document that are worked on at once
BASE = np.uint64(0x100000001B3)
MIXERS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
LOW = np.uint64((1 << 40) - 1)
POSITION = np.uint64((1 << 23) - 1)
BLOB = 16 << 20  # bytes of text whose anchors are combined before they move
GROUP = 8 << 20  # bytes of text that one group of documents holds
HOT = 1 << 18  # documents that make an anchor hot, in a table of up to HOT << HOT_BITS bytes
HOT_BITS = 24  # at most 2 ** HOT_BITS anchors are hot
HOT_ROW = 1 << 62  # the key of rows that name hot anchors
MOST = 200_000  # windows in suffix order at once, but for equal ones


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of all strings of GRAM bytes, by doubling."""
    one = data.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        power = BASE
        two = one[:-1] * power + one[1:]
        power = power * power
        four = two[:-2] * power + two[2:]
        power = power * power
        eight = four[:-4] * power + four[4:]
        power = power * power
        sixteen = eight[:-8] * power + eight[8:]
        out = sixteen[:-8] * power + eight[16:]
        out *= MIXERS[0]
        out ^= out >> np.uint64(29)
        out *= MIXERS[1]
        out ^= out >> np.uint64(32)
    return out


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): the anchors of a text and the window starts that each one serves.

    The anchor of a window of ``length`` bytes is the gram in it with the smallest hash, the
    leftmost of equals, so equal windows have equal anchors at equal places.
    """
    hashes, firsts, lasts = [], [], []
    total = len(data) - length + 1
    span = length - GRAM + 1
    for begin in range(0, max(total, 0), CHUNK):
        end = min(begin + CHUNK, total)
        own = gram_hashes(data[begin : end + length - 1])
        # the place in the low bits makes the leftmost of equal hashes the smallest
        least = (own & ~POSITION) | np.arange(len(own), dtype=np.uint64)
        reach = 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
        places = (least & POSITION).astype(np.int64)
        cuts = np.flatnonzero(np.diff(places)) + 1
        first = np.concatenate([[0], cuts])
        hashes.append(own[places[first]])
        firsts.append(first + begin)
        lasts.append(np.concatenate([cuts, [len(places)]]) - 1 + begin)
    if not hashes:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def anchor_keys(hashes: np.ndarray, slices: int) -> np.ndarray:
    """Slice of the anchor space above 40 bits of hash.  Collisions only cost: contents are compared later."""
    return ((hashes >> np.uint64(40)) % np.uint64(slices) << np.uint64(40)) | (hashes & LOW)


def longest_previous(windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each window (a suffix cut at its length) the longest prefix it shares with one of a smaller document.

    In suffix order the best partner is the nearest one above or below with a smaller document;
    one pass with a stack finds both.
    """
    n, width = windows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = windows
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    ranked = windows[order]
    differs = ranked[1:] != ranked[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    out = np.zeros(n, np.int64)
    own = docs[order].tolist()
    stack: list[tuple[int, int, int, int]] = []  # place, document, shared with the one below, with a smaller one
    for i, (doc, common) in enumerate(zip([*own, -(1 << 63)], [0, *shared.tolist(), 0])):
        while stack and doc < stack[-1][1]:
            place, _, below, smaller = stack.pop()
            out[order[place]] = max(smaller, common)
            common = min(common, below)
        if stack and doc == stack[-1][1]:
            smaller = min(common, stack[-1][3])
        else:
            smaller = common if stack else 0
        stack.append((i, doc, common, smaller))
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([sizes.tobytes(), *(a.tobytes() for a in arrays)]))


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[memoryview]]:
    """(ids, nameless, texts) of the documents in the rows of ``sent_texts``."""
    ids, sizes, nameless, body = _all(table.column("data").to_pylist(), np.int64, np.int64, np.uint8, np.uint8)
    edges, view = np.concatenate([[0], np.cumsum(sizes)]).tolist(), memoryview(body)
    return ids, nameless.astype(bool), [view[a:b] for a, b in zip(edges, edges[1:])]


def _all(blobs: list[bytes], *kinds: type) -> list[np.ndarray]:
    parts = [_unpack(b, *kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


class SuffixDedup:
    """The steps for one table; ``key`` is a slice of the anchor space if 0 or more, else ``-1 - group`` of documents.

    An anchor in ``hot_docs`` documents or more is hot: its windows are dealt one by one, by their own bytes.
    """

    def __init__(self, length: int, slices: int, groups: int, hot_docs: int):
        self.length, self.slices, self.groups, self.hot_docs = length, slices, groups, hot_docs
        self.hot = np.zeros(0, np.uint64)

    def group_of(self, docs: np.ndarray) -> np.ndarray:
        return docs % self.groups

    def _rows(self, key: list, data: list) -> pa.Table:
        return pa.table({"key": pa.array(key, pa.int64()), "data": pa.array(data, pa.binary())})

    def _by_group(self, docs: np.ndarray, *arrays: np.ndarray) -> tuple[list[int], list[bytes]]:
        """One row per group of documents, of arrays in the documents' order."""
        groups = self.group_of(docs)
        order = np.lexsort((docs, groups))
        groups = groups[order]
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
        keys, data = [], []
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                part = order[a:b]
                keys.append(-1 - int(groups[a]))
                data.append(_pack(docs[part], *(x[part] for x in arrays)))
        return keys, data

    def sent_texts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every blob of documents (doc, text, nameless) the whole texts, compressed together by group."""
        held: list[tuple[int, bytes, bool]] = []
        size = 0

        def blob() -> list[pa.RecordBatch]:
            doc, mark = np.array([x[0] for x in held], np.int64), np.array([x[2] for x in held], np.uint8)
            groups = self.group_of(doc)
            order = np.argsort(groups, kind="stable")
            keys, data = [], []
            for part in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
                texts = [held[i][1] for i in part.tolist()]
                sizes = np.array(list(map(len, texts)), np.int64)
                keys.append(-1 - int(groups[part[0]]))
                data.append(_pack(doc[part], sizes, mark[part], np.frombuffer(b"".join(texts), np.uint8)))
            return self._rows(keys, data).combine_chunks().to_batches()

        for batch in batches:
            for doc, text, nameless in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                held.append((doc, text or b"", nameless))
                size += len(text or b"")
                if size >= BLOB:
                    yield from blob()
                    held, size = [], 0
        if held:
            yield from blob()

    def sent_anchors(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every blob of documents its distinct anchors, by slice: those of one document with it, and
        those of several, which these documents need not hear of again, without."""
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        size = 0

        def blob() -> list[pa.RecordBatch]:
            key, doc = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = key[fresh], doc[fresh]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            count = np.diff(np.concatenate([start, [len(key)]]))
            several = np.repeat(count > 1, count)
            out_keys, out_data = self._by_group(doc[several], key[several])
            one = ~several
            # in the documents' order, so that equal neighbours compress
            order = np.lexsort((doc[one], key[one] >> np.uint64(40)))
            one_key, one_doc = key[one][order], doc[one][order]
            many, holders = key[start[count > 1]], count[count > 1].astype(np.uint32)
            one_slice, many_slice = one_key >> np.uint64(40), many >> np.uint64(40)
            present = np.unique(np.concatenate([one_slice, many_slice]))
            one_edges = [np.searchsorted(one_slice, present, side).tolist() for side in ("left", "right")]
            many_edges = [np.searchsorted(many_slice, present, side).tolist() for side in ("left", "right")]
            for s, a, b, c, d in zip(present.tolist(), *one_edges, *many_edges):
                out_keys.append(s)
                out_data.append(_pack(np.diff(one_doc[a:b], prepend=0), _five(one_key[a:b]), _five(many[c:d]), holders[c:d]))
            return self._rows(out_keys, out_data).combine_chunks().to_batches()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                data = np.frombuffer(text or b"", np.uint8)
                hashes, _, _ = anchors(data, self.length)
                keys.append(anchor_keys(hashes, self.slices))
                owners.append(np.full(len(hashes), doc, np.int64))
                size += len(data)
            if size >= BLOB:
                yield from blob()
                keys, owners, size = [], [], 0
        if keys:
            yield from blob()

    def repeated_anchors(self, table: pa.Table) -> pa.Table:
        """For a slice the anchors of two documents or more, told to the documents that sent them, and the hot ones."""
        key = table.column("key")[0].as_py()
        blobs = table.column("data").to_pylist()
        if key < 0:
            return self._rows([key] * len(blobs), blobs)
        docs, hashes, shared, holders = [], [], [], []
        for b in blobs:
            steps, one, many, count = _unpack(b, np.int64, np.uint8, np.uint8, np.uint32)
            docs.append(np.cumsum(steps))
            hashes.append(_from_five(one))
            shared.append(_from_five(many))
            holders.append(count)
        doc, own = np.concatenate(docs), np.concatenate(hashes)
        every = np.concatenate([own, *shared])
        every.sort()
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        place = np.searchsorted(twice, own)
        again = np.zeros(len(own), bool)
        inside = place < len(twice)
        again[inside] = twice[place[inside]] == own[inside]
        top = np.uint64(key) << np.uint64(40)
        keys, data = self._by_group(doc[again], own[again] | top)
        total = np.bincount(place[again], minlength=len(twice))
        several, many = np.concatenate([np.zeros(0, np.uint64), *shared]), np.concatenate([np.zeros(0, np.uint32), *holders])
        # what several blobs or one have by themselves; a key of one blob alone is not among the repeated ones
        alone, where = np.unique(several, return_inverse=True)
        sums = np.bincount(where, many, len(alone)).astype(np.int64)
        at = np.searchsorted(twice, alone)
        known = at < len(twice)
        known[known] = twice[at[known]] == alone[known]
        np.add.at(total, at[known], sums[known])
        hot = np.concatenate([twice[total >= self.hot_docs], alone[~known & (sums >= self.hot_docs)]])
        if len(hot):
            keys.append(HOT_ROW)
            data.append(_pack(hot | top))
        return self._rows(keys, data)

    def fragments(self, docs: pa.Table, told: pa.Table) -> pa.Table:
        """The surroundings of repeated anchors: bytes of all windows that an anchor serves, by slice.

        Of equal ones in this group only those of the smallest document move; the others are
        removed for certain.  Around a hot anchor the same goes for every single window, which moves
        to the slice of its own hash.
        """
        doc_of, keys = _all(told.column("data").to_pylist(), np.int64, np.uint64)
        order = np.lexsort((keys, doc_of))
        doc_of, keys = doc_of[order], keys[order]
        ids, _, texts = _texts(docs)
        first_doc: dict[bytes, int] = {}
        out: dict[int, list[tuple]] = {}
        gone: list[tuple[int, int, int]] = []
        for row in np.argsort(ids, kind="stable").tolist():
            doc = int(ids[row])
            a, b = np.searchsorted(doc_of, [doc, doc + 1])
            if a == b:
                continue
            raw = texts[row]
            hashes, firsts, lasts = anchors(np.frombuffer(raw, np.uint8), self.length)
            own = anchor_keys(hashes, self.slices)
            hot = np.isin(own, self.hot)
            for i in np.flatnonzero(np.isin(own, keys[a:b])).tolist():
                begin, end = int(firsts[i]), int(lasts[i]) + self.length
                part = bytes(raw[begin:end])
                name = xxhash.xxh3_128_digest(part)
                if first_doc.setdefault(name, doc) < doc:
                    gone.append((doc, begin, end))
                elif hot[i]:
                    for at in range(end - begin - self.length + 1):
                        one = part[at : at + self.length]
                        name = xxhash.xxh3_128_digest(one)
                        if first_doc.setdefault(name, doc) < doc:
                            gone.append((doc, begin + at, begin + at + self.length))
                        else:
                            low, high = struct.unpack("<QQ", name)
                            key = high % self.slices << 40 | low & int(LOW)
                            out.setdefault(key >> 40, []).append((doc, begin + at, self.length, key, one))
                else:
                    key = int(own[i])
                    out.setdefault(key >> 40, []).append((doc, begin, end - begin, key, part))
        rows_key, rows_data = self._covers(gone)
        for s, parts in out.items():
            doc, begin, size, key, body = zip(*parts)
            rows_key.append(s)
            rows_data.append(
                _pack(np.array(doc), np.array(begin), np.array(size), np.array(key, np.uint64), np.frombuffer(b"".join(body), np.uint8))
            )
        return self._rows(rows_key, rows_data)

    def _covers(self, spans: list[tuple[int, int, int]]) -> tuple[list[int], list[bytes]]:
        if not spans:
            return [], []
        doc, begin, end = (np.array(x, np.int64) for x in zip(*spans))
        return self._by_group(doc, begin, end)

    def covered(self, table: pa.Table) -> pa.Table:
        """For a slice the byte ranges that an earlier document holds, told to the documents."""
        key = table.column("key")[0].as_py()
        blobs = table.column("data").to_pylist()
        if key < 0:
            return self._rows([key] * len(blobs), blobs)
        doc, begin, size, own, body = _all(blobs, np.int64, np.int64, np.int64, np.uint64, np.uint8)
        at = np.concatenate([[0], np.cumsum(size)])
        raw = body.tobytes()
        number: dict[int, int] = {}
        view = memoryview(raw)
        names = (xxhash.xxh3_128_intdigest(view[a:b]) for a, b in zip(at.tolist(), at[1:].tolist()))
        content = np.fromiter((number.setdefault(x, len(number)) for x in names), np.int64, len(doc))
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, content, doc)
        later = doc > least[content]
        spans = list(zip(doc[later].tolist(), begin[later].tolist(), (begin + size)[later].tolist()))
        # contents whose anchor has others beside it may share some of their windows; equal windows
        # have equal anchors, so a few anchors at a time are put into suffix order
        sample = np.full(len(number), -1)
        sample[content[::-1]] = np.arange(len(content))[::-1]
        anchor = own[sample]
        _, inverse, count = np.unique(anchor, return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(count[inverse] > 1)
        mixed = mixed[np.argsort(anchor[mixed], kind="stable")]
        windows_of = size[sample[mixed]] - self.length + 1
        fresh = np.flatnonzero(np.concatenate([[True], np.diff(anchor[mixed]) != 0])) if len(mixed) else np.zeros(0, np.int64)
        runs_of: dict[int, list[tuple[int, int]]] = {}
        for part in _batches(fresh, np.concatenate([[0], np.cumsum(windows_of)]), len(mixed)):
            chosen, counts = mixed[part], windows_of[part]
            edges = np.concatenate([[0], np.cumsum(counts)])
            starts = np.repeat(at[sample[chosen]] - edges[:-1], counts) + np.arange(edges[-1])
            known = self.known(body, starts, np.repeat(least[chosen], counts))
            for i, c in enumerate(chosen.tolist()):
                hit = np.flatnonzero(known[edges[i] : edges[i + 1]])
                if len(hit):
                    cut = np.flatnonzero(np.diff(hit) > 1) + 1
                    runs_of[c] = [(int(x[0]), int(x[-1]) + self.length) for x in np.split(hit, cut)]
        for row in np.flatnonzero(~later & np.isin(content, list(runs_of))).tolist():
            for a, b in runs_of[int(content[row])]:
                spans.append((int(doc[row]), int(begin[row]) + a, int(begin[row]) + b))
        return self._rows(*self._covers(spans))

    def known(self, body: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which windows a smaller document has.  Many windows are dealt by a hash of their bytes, so that
        equal ones meet, and put into suffix order one part after the other."""
        every = np.lib.stride_tricks.sliding_window_view(body, self.length)
        if len(starts) <= 2 * MOST:
            return longest_previous(every[starts], docs) >= self.length
        factors = np.random.default_rng(50).integers(1, 1 << 63, self.length, dtype=np.uint64) | np.uint64(1)
        names = np.concatenate([every[starts[i : i + MOST]] @ factors for i in range(0, len(starts), MOST)])
        parts = -(-len(starts) // MOST)
        part = (names >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        out = np.zeros(len(starts), bool)
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            own = order[a:b]
            if len(own):
                out[own] = longest_previous(every[starts[own]], docs[own]) >= self.length
        return out


def _batches(starts: np.ndarray, edges: np.ndarray, total: int, most: int = MOST) -> Iterator[slice]:
    """Slices from some of ``starts`` to others, of about ``most`` windows each."""
    begin = 0
    for start in [*starts[1:].tolist(), total] if total else []:
        if edges[start] - edges[begin] >= most or start == total:
            yield slice(begin, start)
            begin = start


def _five(keys: np.ndarray) -> np.ndarray:
    """The low 40 bits of each key as five bytes."""
    return np.ascontiguousarray((keys & LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).ravel()


def _from_five(data: np.ndarray) -> np.ndarray:
    full = np.zeros((len(data) // 5, 8), np.uint8)
    full[:, :5] = data.reshape(-1, 5)
    return full.view("<u8").ravel().astype(np.uint64)


def next_prime(n: int) -> int:
    """The smallest prime from ``n`` on: ids in steps spread over that many groups all the same."""
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of a set of ranges."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(begin[1:] > end[:-1]) + 1
    return list(zip(begin[np.concatenate([[0], cut])].tolist(), end[np.concatenate([cut - 1, [len(end) - 1]])].tolist()))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, with_bytes: bool = False, hot_docs: int = HOT
) -> DataFrame:
    """Per document row: id, n_bytes, n_removed, spans (removed byte ranges), kept_sha256, and the kept bytes if asked for.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id;
    strings are judged on the input and never cross documents.  Null text is empty.  Rows
    with one id are one document, so they remove nothing from each other.  Rows without an id
    come after all others, in the order of a hash of their text.  An empty table gives no rows.

    Anchors sampled from every window tell which places can repeat at all.  Only the surroundings
    of anchors of two documents or more are compared, in suffix order, where the longest
    previous factor of each window decides.  Whatever many documents share is combined before it
    moves, so no task gets a row for each of them.  A hot anchor (more than a quarter of a million
    documents, and more than one in 2 ** 24 of all bytes) has its windows dealt one by one, by their own bytes, so that a phrase with
    different surroundings in every document is spread over all tasks.  At most 2 ** 24 anchors can be hot, as every
    document that holds one spends a byte of its own on it; their list goes to all tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    nameless = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(quoted(text_col)), 2)
    slim = docs.select(
        F.coalesce(quoted(id_col).cast("long"), nameless).alias("doc"),
        F.coalesce(quoted(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
        quoted(id_col).isNull().alias("nameless"),
    )
    total = docs.agg(F.sum(F.octet_length(quoted(text_col)))).first()[0] or 0
    groups = next_prime(max(8, total // GROUP))
    job = SuffixDedup(length, min(1 << 23, total // GROUP + 6), groups, max(hot_docs, total >> HOT_BITS))
    kind = "key long, data binary"

    sent = slim.select("doc", "text").mapInArrow(lambda b: job.sent_anchors(b), kind)
    told = written(sent.groupBy("key").applyInArrow(lambda t: job.repeated_anchors(t), kind), "suffix-anchors")
    hot = [_unpack(r["data"], np.uint64)[0] for r in told.where(F.col("key") == HOT_ROW).select("data").collect()]
    job.hot = np.concatenate([job.hot, *hot])
    told = told.where(F.col("key") < 0)
    by_group = slim.mapInArrow(lambda b: job.sent_texts(b), kind)
    met = by_group.groupBy("key").cogroup(told.groupBy("key"))
    found = met.applyInArrow(lambda d, t: job.fragments(d, t), kind)
    covers = written(found.groupBy("key").applyInArrow(lambda t: job.covered(t), kind), "suffix-covers")

    def finish(texts: pa.Table, ranges: pa.Table) -> pa.Table:
        doc, begin, end = _all(ranges.column("data").to_pylist(), np.int64, np.int64, np.int64)
        order = np.argsort(doc, kind="stable")
        doc, begin, end = doc[order], begin[order], end[order]
        ids, nameless, bodies = _texts(texts)
        rows: list[tuple] = []
        for row, body in enumerate(bodies):
            text = body.tobytes()
            a, b = np.searchsorted(doc, ids[row], "left"), np.searchsorted(doc, ids[row], "right")
            runs = merged(begin[a:b], end[a:b]) if a < b else []
            if runs:
                edges = [0, *(x for r in runs for x in r), len(text)]
                kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
            else:
                kept = text
            spans = [{"start": x, "end": y} for x, y in runs]
            rows.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
        columns = list(zip(*rows)) if rows else [()] * 5
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        id_array = pa.array(ids, pa.int64(), mask=nameless)
        out = {
            "id": id_array,
            "n_bytes": pa.array(columns[0], pa.int64()),
            "n_removed": pa.array(columns[1], pa.int64()),
            "spans": pa.array(columns[2], span),
            "kept_sha256": pa.array(columns[3], pa.string()),
        }
        if with_bytes:
            out["kept"] = pa.array(columns[4], pa.binary())
        return pa.table(out)

    schema = "id long, n_bytes long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept_sha256 string"
    out = by_group.groupBy("key").cogroup(covers.groupBy("key")).applyInArrow(finish, schema + (", kept binary" if with_bytes else ""))
    return out.withColumnRenamed("id", id_col)
