"""Secrets in text: fixed patterns, and a character network over further candidates."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquatally.llm.util import add_columns, quoted, small_batches, written

# The base rules.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "model")
#: What the network judges: long runs with letters and digits, the form that keys have.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Runs that are surely no key: numbered words and dates, or words and numbers between separators.
NUMBERED = re.compile(r"([A-Za-z][a-z]{3,}|[A-Z]{4,})[0-9]+")
DATE = re.compile(r"[0-9]{4}[-_/]?[01][0-9][-_/]?[0-3][0-9](T[0-9]{2,6}Z?)?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|v?[0-9]+")
VOWEL = re.compile("[aeiouyAEIOUY]")
LONG_WORD = re.compile(r"(?<![A-Za-z])[A-Za-z]{12,}")

WIDTH = 24  # characters of context on either side
CORE = 48  # characters of the candidate itself
LENGTH = WIDTH + CORE + WIDTH
CODES = 98  # padding, other, then the printable characters


def base_matches(text: str, longest: int) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself) of the base rules, leftmost and not
    overlapping per kind.  ``longest`` is the length of the text's longest word."""
    spans = []
    if "=" in text or ":" in text:
        lowered = text.lower()
        if any(w in lowered for w in ("passw", "secret", "token", "api")):
            spans += [(*m.span(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(*m.span(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if longest >= 32:
        spans += [(*m.span(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def other_candidates(text: str, longest: int, spans: list[tuple]) -> list[tuple[int, int]]:
    """Runs with both letters and digits that no base span touches."""
    if longest < 16:
        return []
    out = []
    at = 0
    ends = [s[1] for s in spans]
    for m in CANDIDATE.finditer(text):
        word = m[0]
        if word.isalpha() or not any(c.isdigit() for c in word) or not any(c.isalpha() for c in word):
            continue
        while at < len(spans) and ends[at] <= m.start():
            at += 1
        if not any(s[0] < m.end() and m.start() < s[1] for s in spans[at:]):
            out.append(m.span())
    return out


def ordinary(run: str) -> bool:
    """Whether a run is surely no key: a numbered word, a date, a slug, a path or a version.

    Of what lies between separators every part is letters or a number, and one part at least is a
    word: four letters or more, in small letters but for the first, with a vowel.
    """
    if DATE.fullmatch(run):
        return True
    if m := NUMBERED.fullmatch(run):
        return VOWEL.search(m[1]) is not None
    parts = [p for p in re.split("[-_/+=]", run) if p]
    if len(parts) < 2 or not all(PART.fullmatch(p) for p in parts):
        return False
    return any(len(p) >= 4 and p.isalpha() and p[1:].islower() and VOWEL.search(p) for p in parts)


def longest_word(text: str) -> int:
    return max(map(len, text.split()), default=0)


def labelled(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(label, start, end, shown) of the labelled findings of one text; ``shown`` characters before a finding
    are the key word of an assignment, which the window blanks.

    Of the other candidates only those that are surely no key are labelled: the rest may be keys
    without a key word, which the network is to judge.
    """
    longest = longest_word(text)
    spans = base_matches(text, longest)
    for start, end, kind, secret in spans:
        yield 1, secret, end, min(WIDTH, secret - start) if kind == "assign" else 0
    for start, end in other_candidates(text, longest, spans):
        if ordinary(text[start:end]):
            yield 0, start, end, 0
    if longest >= 12:
        at = 0
        for m in LONG_WORD.finditer(text):
            while at < len(spans) and spans[at][1] <= m.start():
                at += 1
            if not any(s[0] < m.end() and m.start() < s[1] for s in spans[at:]):
                yield 0, *m.span(), 0


def examples(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """Labelled windows of one text; the key word before an assigned secret is blanked."""
    for label, start, end, shown in labelled(text):
        found = window(text, start, end)
        found[WIDTH - shown : WIDTH] = 0
        yield label, found


class Sample:
    """Of all labelled findings told so far the ``most`` distinct ones of each label with the smallest hash."""

    def __init__(self, most: int):
        self.most = most
        self.kept: list[dict[int, np.ndarray]] = [{}, {}]
        self.edge = [1 << 64, 1 << 64]

    def add(self, text: str) -> None:
        for label, start, end, shown in labelled(text):
            # what the window shows, cheaply: of a long candidate both ends
            core = text[start:end] if end - start <= CORE else text[start : start + CORE // 2] + text[end - CORE // 2 : end]
            around = text[max(0, start - WIDTH) : start - shown], core, text[end : end + WIDTH]
            name = xxhash.xxh3_64_intdigest("\0".join([*around, str(shown)]).encode("utf-8", "surrogatepass"))
            kept = self.kept[label]
            if name >= self.edge[label] or name in kept:
                continue
            found = window(text, start, end)
            found[WIDTH - shown : WIDTH] = 0
            kept[name] = found.astype(np.uint8)
            if len(kept) >= 2 * self.most:
                names = sorted(kept)[: self.most]
                self.kept[label] = {n: kept[n] for n in names}
                self.edge[label] = names[-1] + 1

    def rows(self) -> Iterator[tuple[int, bytes]]:
        for label, kept in enumerate(self.kept):
            for name in sorted(kept)[: self.most]:
                yield label, kept[name].tobytes()


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets that keys are written in.
ALPHABETS = (
    UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_",
    LOWER + DIGITS, UPPER + DIGITS, DIGITS + "abcdef", DIGITS + "abcdef", DIGITS + "ABCDEF", DIGITS + "ABCDEF",
)
HEXADECIMAL = DIGITS + "abcdef"


def _text(draw: np.random.Generator, alphabet: str, n: int) -> str:
    return "".join(alphabet[i] for i in draw.integers(0, len(alphabet), n))


def key_like(draw: np.random.Generator) -> str:
    """A random key, of any usual alphabet and length."""
    while True:
        body = _text(draw, ALPHABETS[draw.integers(len(ALPHABETS))], int(draw.integers(20, 65)))
        ends = ("", "", "", "=", "==")[draw.integers(5)] if "+" in body or "/" in body else ""
        lead = ("", "", "", "", "sk_live_", "ghp_", "xoxb-", "pk-")[draw.integers(8)]
        if any(c.isdigit() for c in body) and any(c.isalpha() for c in body):
            return lead + body + ends


def look_alike(draw: np.random.Generator) -> str:
    """A long run with digits that is no key: a UUID, an order or book number, a date, a version, a path."""
    n = lambda k: _text(draw, DIGITS, k)
    pick = lambda *words: words[draw.integers(len(words))]
    word = lambda: "".join(_text(draw, "bcdfghklmnprstvw", 1) + _text(draw, "aeiou", 1) for _ in range(draw.integers(2, 5)))
    day = f"{draw.integers(1980, 2040)}-{draw.integers(1, 13):02d}-{draw.integers(1, 29):02d}"
    mark = pick("-", "-", "_", "/")
    case = pick(str, str, str.upper)
    kind = draw.integers(8)
    if kind == 0:
        digits = pick(HEXADECIMAL, HEXADECIMAL.upper())
        return "-".join(_text(draw, digits, k) for k in (8, 4, 4, 4, 12))
    if kind == 1:
        lead = pick("ORD", "ORDER", "INV", "PO", "RMA", "SKU", "TICKET", "CASE", "REF", "TRK", case(word()), _text(draw, UPPER, int(draw.integers(2, 5))))
        return mark.join([lead, pick(day[:4], n(4), n(6)), *[n(int(draw.integers(3, 8))) for _ in range(draw.integers(1, 3))]]).ljust(16, "0")
    if kind == 2:
        return pick("ISBN-", "ISBN", "isbn-", "ISBN-13-", "ISSN-", "EAN") + "-".join([pick("978", "979"), n(1), n(int(draw.integers(2, 5))), n(int(draw.integers(3, 6))), pick(n(1), "X")])
    if kind == 3:
        clock = pick("T" + n(6) + "Z", "T" + n(4), "T" + n(2) + "-" + n(2) + "-" + n(2) + "Z")
        return pick(day, day.replace("-", "")) + clock + pick("", "", mark + word())
    if kind == 4:
        return mark.join([word(), word(), pick("v", "r", "release-", "build") + n(1), n(int(draw.integers(1, 3))), pick(n(1), "rc" + n(1), "beta" + n(1))])
    if kind == 5:
        return mark.join([case(word()) for _ in range(draw.integers(2, 4))] + [pick(n(2), n(4), day)])
    if kind == 6:
        return pick("item", "page", "user", "id", "IMG_", "DSC", "tel", case(word())) + n(int(draw.integers(12, 20)))
    return "-".join([_text(draw, UPPER, int(draw.integers(1, 4))) + n(int(draw.integers(2, 5))) for _ in range(draw.integers(4, 6))])


def varied(x: np.ndarray, y: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each finding one more of its label with another core, and often in other surroundings.

    A corpus shows few forms of keys, and hardly any number that looks like one.  Surroundings are those
    of findings of either label, so that they tell nothing about the new core.
    """
    draw = np.random.default_rng(seed + 1)
    many = max(len(x) // 2, 2000)
    truth = (np.arange(2 * many) % 2).astype(float)
    new = x[draw.integers(0, len(x), 2 * many)].copy()
    for row, label in zip(new, truth.tolist()):
        core = key_like(draw) if label else look_alike(draw)
        edges = " ", " "
        if draw.random() < 0.5:
            edges = (" ", " "), ("(", ")"), ('"', '"'), (" ", "."), (" ", ","), (":", " "), ("\n", "\n"), ("=", "&")
            edges = edges[draw.integers(len(edges))]
        shown = window(edges[0] + core + edges[1], 1, 1 + len(core))
        row[WIDTH : WIDTH + CORE] = shown[WIDTH : WIDTH + CORE]
        row[WIDTH - 1], row[WIDTH + CORE] = shown[WIDTH - 1], shown[WIDTH + CORE]
    return np.concatenate([x, new]), np.concatenate([y, truth])


def codes(text: str) -> np.ndarray:
    """Network input of one piece of text: 0 pads, 1 stands for anything not printable ASCII."""
    raw = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.where((raw >= 32) & (raw < 127), raw - 29, 1)


def window(text: str, start: int, end: int) -> np.ndarray:
    """Codes of a candidate and what surrounds it; a long candidate shows its two ends."""
    out = np.zeros(LENGTH, np.int64)
    before = codes(text[max(0, start - WIDTH) : start])
    after = codes(text[end : end + WIDTH])
    out[WIDTH - len(before) : WIDTH] = before
    core = text[start:end]
    core = codes(core if len(core) <= CORE else core[: CORE // 2] + core[-CORE // 2 :])
    out[WIDTH : WIDTH + len(core)] = core
    out[WIDTH + CORE : WIDTH + CORE + len(after)] = after
    return out


@dataclass
class Network:
    """One convolution over embedded characters, the largest value of each filter, one unit."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    slope: float = 1.0  # calibration of the score
    shift: float = 0.0
    threshold: float = 1.0

    @staticmethod
    def fresh(seed: int, size: int = 8, span: int = 5, width: int = 24) -> Network:
        draw = np.random.default_rng(seed)
        return Network(
            draw.normal(0, 0.3, (CODES, size)),
            draw.normal(0, 1 / math.sqrt(size * span), (span * size, width)),
            np.zeros(width),
            draw.normal(0, 0.3, 2 * width),
            0.0,
        )

    def forward(self, x: np.ndarray) -> tuple:
        span = self.filters.shape[0] // self.embed.shape[1]
        grid = self.embed[x]
        views = np.lib.stride_tricks.sliding_window_view(grid, span, axis=1)  # rows, places, size, span
        flat = views.transpose(0, 1, 3, 2).reshape(len(x), -1, self.filters.shape[0])
        z = np.maximum(flat @ self.filters + self.bias, 0)
        # the candidate and its context are pooled apart
        inside = np.zeros(z.shape[1], bool)
        inside[WIDTH - span // 2 : WIDTH + CORE] = True
        pooled, where = [], []
        for part in (np.flatnonzero(inside), np.flatnonzero(~inside)):
            best = z[:, part].argmax(axis=1)
            where.append(part[best])
            pooled.append(np.take_along_axis(z, part[best][:, None, :], axis=1)[:, 0])
        features = np.concatenate(pooled, axis=1)
        return features @ self.weight + self.offset, features, where, flat

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of each window."""
        if len(x) == 0:
            return np.zeros(0)
        logits = np.concatenate([self.forward(x[i : i + 512])[0] for i in range(0, len(x), 512)])
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -50, 50)))


def held_back(y: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Rows held back and rows used: of each label a fifth is held back, of two or more at least one."""
    order = draw.permutation(len(y))
    held, used = [], []
    for label in (0, 1):
        own = order[y[order] == label]
        some = max(len(own) // 5, int(len(own) > 1))
        held.append(own[:some])
        used.append(own[some:])
    return np.concatenate(held), np.concatenate(used)


def train(x: np.ndarray, y: np.ndarray, seed: int = 0, rounds: int = 12, recall: float = 0.98) -> Network:
    """A network fitted to windows ``x`` with labels ``y``, calibrated on a fifth of each label held back.

    Calibration fits slope and shift of the logit on the held-back part; the threshold is the
    highest at which ``recall`` of its secrets are found, even if that is below one half.
    With a single secret none is held back, and the threshold is above every score.
    """
    draw = np.random.default_rng(seed)
    held, used = held_back(y, draw)
    net = Network.fresh(seed)
    names = ("embed", "filters", "bias", "weight", "offset")
    moments = {n: [np.zeros_like(np.asarray(getattr(net, n), float)) for _ in range(2)] for n in names}
    balance = np.where(y == 1, 0.5 / max(1, (y[used] == 1).sum()), 0.5 / max(1, (y[used] == 0).sum())) * len(used)
    step, size, span = 0, net.embed.shape[1], net.filters.shape[0] // net.embed.shape[1]
    for _ in range(rounds):
        draw.shuffle(used)
        for at in range(0, len(used), 128):
            pick = used[at : at + 128]
            logit, features, where, flat = net.forward(x[pick])
            error = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y[pick]) * balance[pick] / len(pick)
            grads = {"weight": features.T @ error, "offset": np.asarray(error.sum())}
            back = error[:, None] * net.weight * (features > 0)
            rows = np.arange(len(pick))[:, None]
            width = len(net.bias)
            d_filters, d_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
            d_bias = np.zeros(width)
            for half, places in enumerate(where):
                g = back[:, half * width : (half + 1) * width]
                d_bias += g.sum(axis=0)
                d_filters += np.einsum("rfk,rf->kf", flat[rows, places], g)
                to_input = (g[:, :, None] * net.filters.T[None]).reshape(len(pick), width, span, size)
                taken = x[pick][rows[:, :, None], places[:, :, None] + np.arange(span)]
                np.add.at(d_embed, taken, to_input)
            grads |= {"filters": d_filters, "bias": d_bias, "embed": d_embed}
            step += 1
            for n in names:
                m, v = moments[n]
                m += 0.1 * (grads[n] - m)
                v += 0.001 * (grads[n] ** 2 - v)
                change = 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(net, n, getattr(net, n) - change)
    logit = net.forward(x[held])[0] if len(held) else np.zeros(0)
    truth = y[held]
    if truth.min(initial=1) == truth.max(initial=0):
        net.threshold = 1.1 if truth.max(initial=0) == 0 else 0.5
        return net
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(net.slope * logit + net.shift, -50, 50)))
        net.slope -= 0.05 * float(((p - truth) * logit).mean())
        net.shift -= 0.05 * float((p - truth).mean())
    scores = np.sort(net.score(x[held][truth == 1]))
    net.threshold = float(scores[int((1 - recall) * len(scores))])
    return net


def labelled_findings(docs: DataFrame, text_col: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of at most ``most`` distinct windows of each label, the same on every run.

    Findings of the base rules are secrets; their key word is blanked in the window, so that the
    network learns the form of the secret and not the rule.  Ordinary candidates (slugs, paths,
    versions, dates, numbered words) are not, and neither are long words.  Other candidates have
    no label.  The bound is on the training sample alone.  Texts are read once: each task keeps the findings
    with the smallest hashes, and of these the sample is taken.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Sample(most)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                sample.add(text or "")
        labels, windows = zip(*sample.rows()) if any(sample.kept) else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(windows, pa.binary())], names=["label", "window"])

    found = docs.select(quoted(text_col).alias("text")).mapInArrow(run, "label int, window binary")
    found = written(found.distinct().withColumn("o", F.xxhash64("window")), "secret-findings")
    counts = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
    x, y = [], []
    for label in (0, 1):
        # hashes are spread evenly: below this one lie some four times the sample, and no task sends more of them to the driver
        share = min(1.0, (4 * most + 64) / max(1, counts.get(label, 0)))
        own = found.where((F.col("label") == label) & (F.col("o") <= F.lit(int((1 << 64) * share) - (1 << 63) - 1)))
        rows = own.orderBy("o", "window").limit(most).collect()
        x += [np.frombuffer(r["window"], np.uint8) for r in rows]
        y += [label] * len(rows)
    return np.array(x, np.int64).reshape(-1, LENGTH), np.array(y, float)


def find_secrets(
    docs: DataFrame, text_col: str = "text", findings: int = 4000, recall: float = 0.98, network: Network | None = None
) -> DataFrame:
    """``docs`` with ``secrets``: (kind, start, end, score) in code points, end exclusive.

    Spans come by start, then kind (assign, access, hex, model).  Base findings always stay; the
    network scores them and every other long run of letters and digits, and adds those of
    the latter that reach its threshold.  Without a ``network`` one is trained on at most ``findings``
    labelled findings of either label, and as many made ones: random keys of usual alphabets and lengths, and numbers that look like
    keys, in the surroundings of findings.  Its threshold finds ``recall`` of the held-back secrets.  Null or
    empty text has none.  Nothing is added if there are fewer than ten distinct labelled
    findings, none of one label, or a single secret, which leaves none to hold back.  A column called
    ``secrets`` is replaced.
    """
    net = network or fitted(docs, text_col, findings, recall)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def step(texts: pa.Array) -> Sequence[pa.Array]:
        found, windows = [], []
        for i, text in enumerate(texts.to_pylist()):
            if not text:
                continue
            longest = longest_word(text)
            spans = base_matches(text, longest)
            for start, end, name, secret in spans:
                found.append((i, start, end, name))
                windows.append(window(text, secret, end))
            for start, end in other_candidates(text, longest, spans):
                found.append((i, start, end, "model"))
                windows.append(window(text, start, end))
        scores = net.score(np.array(windows, np.int64).reshape(-1, LENGTH)).tolist()
        rows: list[list[dict]] = [[] for _ in range(len(texts))]
        for (i, start, end, name), score in zip(found, scores):
            if name != "model" or score >= net.threshold:
                rows[i].append({"kind": name, "start": start, "end": end, "score": score})
        for own in rows:
            own.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
        return (pa.array(rows, pa.list_(kind)),)

    fields = "secrets array<struct<kind: string, start: bigint, end: bigint, score: double>>"
    return add_columns(docs, [text_col], fields, step)


def fitted(docs: DataFrame, text_col: str = "text", findings: int = 4000, recall: float = 0.98) -> Network:
    x, y = labelled_findings(docs, text_col, findings)
    if len(x) < 10 or y.min() == y.max():
        net = Network.fresh(0)
        net.threshold = 1.1  # above every score
        return net
    return train(*varied(x, y), recall=recall)
