"""Periodic runs, language-model scoring and cross-tokenizer alignment."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aquatally.llm import align, lm, periodic, queries
from tests.llm import brute
from tests.llm.test_filters import DOCS, odd_texts

SF = "/root/testdata/sf0.001"


def periodic_words(r, n):
    """Words with planted runs: short alphabets, nested repeats, interrupted repeats."""
    kind = r.randrange(5)
    if kind == 0:
        return [r.choice("ab") for _ in range(n)]
    if kind == 1:
        return [r.choice("abc") for _ in range(max(1, n // 9))] * 9
    if kind == 2:  # a period that itself is full of runs
        part = (["x"] * r.randrange(1, 12) + [r.choice("yz") for _ in range(r.randrange(1, 6))]) * r.randrange(1, 4)
        part += [r.choice("xyz") for _ in range(r.randrange(30))]
        return [r.choice("xyz") for _ in range(r.randrange(20))] + (part * (n // len(part) + 1))[:n]
    if kind == 3:
        a, b = ["a"], ["a", "b"]
        while len(b) < r.randrange(10, 60):
            a, b = b, b + a
        return b * r.randrange(2, 9) + ["c"] + b[: r.randrange(len(b))] * 5
    part = [str(r.randrange(50)) for _ in range(r.randrange(1, 70))]
    out = (part * (n // len(part) + 1))[:n]
    for _ in range(r.randrange(3)):
        out[r.randrange(n)] = "break"
    return out


def test_runs_equal_brute_force():
    r = random.Random(5)
    for _ in range(400):
        words = periodic_words(r, r.randrange(1, 400))
        own = periodic._numbered([w.encode() for w in words], 0)
        assert [tuple(x) for x in periodic.find_runs(own, len(own)).tolist()] == brute.runs(words), words


def test_runs_of_many_documents(spark):
    r = random.Random(6)
    rows = [(i, " ".join(periodic_words(r, r.randrange(1, 120))), "h") for i in range(60)]
    rows += [(100 + i, t, "h") for i, t in enumerate(odd_texts(7, 60))]
    rows += [(None, "a " * 9, "h"), (None, "a " * 9, "h"), (900, " ".join(f"w{i % 701}" for i in range(6000)), "h")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("Runs", F.lit("clash")).withColumn("__in0", F.lit("clash"))
    out = periodic.with_runs(docs)
    assert "Runs" not in out.columns and len(out.columns) == len(docs.columns) + 2
    got = sorted((str(x.doc_id), x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in out.collect())
    want = []
    for d, t, _ in rows:
        w = brute.words(t)
        found = brute.runs(w)
        want.append((str(d), len(w), found, brute.collapsed(w, found)))
    assert got == sorted(want)
    assert any(p > 600 for _, _, found, _ in got for _, _, p in found)
    assert periodic.with_runs(docs.limit(0)).count() == 0
    short = periodic.collapse_runs(docs)
    assert short.columns == docs.columns
    left = {x.text for x in short.where("doc_id is null").collect()}
    assert left == {"a"}


def test_periodic_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {x.doc_id: x for x in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    looped = 0
    for x in docs:
        w = brute.words(x.text)
        n, h = len(w), zlib.crc32(str(x.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, looped = g % n, looped + 1
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found, y = brute.runs(w), got[x.doc_id]
        best = max(found, key=lambda q: (q[1], -q[0], -q[2]), default=None)
        assert y.n_runs == len(found)
        assert (y.start, y.length, y.period) == (best or (None,) * 3)
        assert y.exponent_milli == (1000 * best[1] // best[2] if best else None)
        listed = "".join(f"{s},{k},{q}\n" for s, k, q in found)
        assert y.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert y.collapsed_sha256 == hashlib.sha256(brute.collapsed(w, found).encode()).hexdigest()
    assert looped > 5 and any(y.n_runs for y in got.values())


def close(got, want):
    return abs(got - want) <= 1e-9 * max(1.0, abs(want))


def test_scoring_query_equals_sql(spark):
    import duckdb

    from aquatally.llm.oracles import oracle_sql

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = {x[0]: x for x in db.execute(oracle_sql()["op12_lm_scoring"]).fetchall()}
    got = queries.op12_lm_scoring(spark, SF).collect()
    assert len(got) == len(want) > 100
    for x in got:
        y = want[x.doc_id]
        assert tuple(x)[:5] == y[:5] and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 7 == 2)
        assert close(x.base_score, y[5]) and close(x.score, y[6])


def lm_rows(n=300):
    r = random.Random(8)
    texts = [" ".join(r.choice(["the", "The", "a", f"w{int(r.paretovariate(0.7)) % 500}"]) for _ in range(r.randrange(60))) for _ in range(n)]
    rows = [(i, t, "h") for i, t in enumerate(texts + odd_texts(9, 40))]
    return rows + [(None, "the w1", "h"), (None, "the w1", "h"), (5, None, None), (6, "", "h")]


@pytest.mark.parametrize("shard_bytes", [1 << 30, 700])
def test_scores_equal_brute_force(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 1500)
    monkeypatch.setattr(lm, "SCORE_TOKENS", 700)
    monkeypatch.setattr(lm, "WORDS_PER_SHARD", 90)
    rows = lm_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    model = lm.train(docs.where("doc_id % 3 <> 0"), shard_bytes=shard_bytes)
    assert (model.shards > 5 and len(model.spread) > 2) == (shard_bytes == 700)
    scored = lm.score(docs.withColumn("Score", F.lit("clash")).withColumn("__in0", F.lit(1)), model)
    assert "Score" not in scored.columns and {"source", "__in0", "perplexity"} <= set(scored.columns)
    want = brute.kneser_ney([t for d, t, _ in rows if d is not None and d % 3], [t for _, t, _ in rows])
    got = sorted((x.doc_id is None, x.doc_id or 0, x.n_tokens, x.n_known, x.base_score, x.score) for x in scored.collect())
    wanted = sorted((d is None, d or 0, *w) for (d, _, _), w in zip(rows, want))
    assert len(got) == len(wanted)
    for x, y in zip(got, wanted):
        assert x[:4] == y[:4] and close(x[4], y[4]) and close(x[5], y[5])


def test_probabilities_sum_to_one(spark):
    model = lm.train(spark.createDataFrame(lm_rows(), DOCS))
    hashed = lambda w: lm._tokens([w.encode()])[0][0][0]
    known = np.unique(np.concatenate(lm._tokens([(t or "").encode() for _, t, _ in lm_rows()])[0]))
    assert len(known) == model.vocabulary
    for before in (lm.START, hashed("the"), hashed("w1"), hashed("never seen")):
        words = np.append(known, hashed("unseen-word"))
        chance, _ = lm.probabilities(model, np.full(len(words), before), words)
        assert abs(chance.sum() - 1) < 1e-9 and chance.min() > 0


def test_scores_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "h")], DOCS)
    x = lm.score(docs, lm.train(docs.limit(0))).first()
    assert (x.n_tokens, x.n_known, x.train_tokens, x.base_score, x.score) == (3, 0, 0, 0.0, 0.0)
    assert lm.score(docs.limit(0), lm.train(docs)).count() == 0


def test_model_predicts_what_it_has_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = lm.train_and_score(docs).agg(*[F.sum(c) for c in ("base_score", "score", "n_tokens")]).first()
    assert scored[1] > 0.8 * scored[0]  # less negative: lower perplexity than single tokens have
    held = lm.train_and_score(docs).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert held[1] > held[0]


@pytest.fixture(scope="module")
def two():
    paths = [queries.tokenizer_path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align.two_tokenizers(*paths)


ODD = [
    "", " ", "a", "▁", "a▁b", "<s>x</s>", "<|endoftext|>", "<unk> <0x41>", "\x00a\x7f", "é́ñ 漢字한글 🙂‍🙂", "tab\t\tx\n\n y ",
    "don't we'LL 12345 67.89 x² ½", "   leading", " nb space", "x" * 3000, " line", "﻿bom", "ǅﬁK",
]


def test_tokens_equal_the_tokenizers(two):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    r = random.Random(3)
    letters = "abcXYZéÉİıßẞΣçÇñ’'s't're.,!?#$ 0123\n\t ́漢字한글ﬁǅ<|>▁"
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(1500)] + [" " * 20_001 + "x"]
    held = 0
    for text in texts:
        a = plain.encode(" " + text, add_special_tokens=False).ids
        assert two._a_ids(" " + text) == a
        b = two.b.encode(text)
        raw = (" " + text).encode()
        whole = text and b"".join(two.a_bytes[i] for i in a) == raw and b"".join(two.b_bytes[i] for i in b) == raw
        got = two.ids(text)
        assert (got[0].tolist(), got[1].tolist()) == ((a, b) if whole else ([], []))
        held += bool(whole)
    assert 100 < held < len(texts) - 2


def test_alignment_equals_brute_force(spark, two, monkeypatch):
    monkeypatch.setattr(align, "CHUNK_LINKS", 900)
    texts = ODD + [t for t in odd_texts(4, 80)] + [None, "the same text"] * 3 + ["the same text"] * 40
    rows = [(i if i % 7 else None, t, "h") for i, t in enumerate(texts)] + [(3, ODD[3], "h"), (3, ODD[3], "h")]
    docs = spark.createDataFrame(rows, DOCS).repartition(4).withColumn("digest", F.lit("clash")).withColumn("n_a", F.lit("clash"))
    out = align.align_documents(docs, *[queries.tokenizer_path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model")])
    want = brute.alignment([two.ids(t or "") for _, t, _ in rows], two.a_bytes, two.b_bytes)
    got = sorted((str(x.doc_id), *list(x)[1:]) for x in out.collect())
    assert got == sorted((str(d), *w) for (d, _, _), w in zip(rows, want))
    assert sum(x[4] > 0 for x in got) > 60 and any(x[1] == 0 for x in got)
    empty = align.align_documents(docs.limit(0), *[queries.tokenizer_path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model")])
    assert empty.count() == 0


def test_alignment_query(spark, two):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute.alignment([two.ids(x.text or "") for x in docs], two.a_bytes, two.b_bytes)
    got = sorted(tuple(x) for x in queries.op13_tokenizer_alignment(spark, SF).collect())
    assert got == sorted((x.doc_id, *w) for x, w in zip(docs, want))
