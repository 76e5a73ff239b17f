"""Quality rules, line dedup, suffix dedup and near-dedup against brute force, with odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from aquatally.llm import graph, line_dedup, near_dedup, quality_rules, suffix_dedup
from tests.llm import brute

DOCS = "doc_id long, text string, source string"
LONG = " ".join(f"word{i % 977}" for i in range(40_000))


def odd_texts(seed=0, n=60):
    """Texts with repeated passages, copies, short ones, odd spaces and letters beyond ASCII."""
    r = random.Random(seed)
    vocabulary = ["the", "of", "Wald", "Ärger", "niño", "été", "x", "漢字", "K", "İ", "ﬁn", "#tag", "a|b", "zero width"]
    passages = [" ".join(r.choice(vocabulary) + str(r.randrange(30)) for _ in range(25)) for _ in range(4)]
    out = [None, "", " ", "\n\n", "\t \x0b", "one", LONG, LONG + " end", "a" * 300, "a" * 200, "\n".join(["same line of the text"] * 7)]
    while len(out) < n:
        kind = r.randrange(6)
        if kind == 0 and len(out) > 12:
            out.append(r.choice(out[11:]))
        elif kind == 1 and len(out) > 12 and (old := r.choice(out[11:])):
            parts = old.split(" ")
            parts[r.randrange(len(parts))] = "changed"
            out.append(" ".join(parts))
        else:
            lines = []
            for _ in range(r.randrange(1, 6)):
                own = " ".join(r.choice(vocabulary) + str(r.randrange(200)) for _ in range(r.randrange(30)))
                lines.append(r.choice([own, r.choice(passages), " " + r.choice(passages).upper() + "\r", own + r.choice(passages)]))
            out.append("\n".join(lines))
    return out


def table(spark, texts, schema=DOCS):
    rows = [(i * 3 + 1, t, f"host{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema).repartition(3)


def test_measures_equal_the_rules(spark):
    texts = odd_texts()
    out = quality_rules.apply_rules(table(spark, texts)).collect()
    assert len(out) == len(texts)
    for row in out:
        n, chars, symbols, dup, again = brute.quality(row.text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, chars, symbols, dup, again)
        assert row.base_failed == (n < 10 or 100 * again > 20 * n)
        assert row.kept == (not row.base_failed and not row.host_failed and not row.habit_failed)


def test_bad_host_takes_its_documents_along(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(i, bad if i % 50 else good, "spam") for i in range(200)]
    rows += [(1000 + i, good if i % 20 else bad, f"host{i % 8}") for i in range(800)]
    rows += [(5000, bad, "new"), (5001, good, None)]  # one failure proves nothing against a new host
    out = quality_rules.apply_rules(spark.createDataFrame(rows, DOCS))
    got = {(r.source, r.text): (r.host_failed, r.kept) for r in out.collect()}
    assert got["spam", good] == (True, False)
    assert got["host0", good] == (False, True)
    assert got["new", bad] == (False, False)
    assert got[None, good] == (False, True)


def test_prior_shrinks_small_hosts(spark):
    rows = [("a", "r", 10_000, 9_900), ("b", "r", 10_000, 100), ("c", "r", 1, 1), ("d", "r", 10_000, 120), ("e", "r", 9_000, 95)]
    out = {r.host: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, rule string, n_docs long, n_failed long")).collect()}
    assert out["a"].host_failed and not out["b"].host_failed and not out["c"].host_failed
    assert abs(out["a"].shrunk_rate - 0.99) < 0.01 and out["c"].shrunk_rate < 0.9


def test_clashing_columns_are_replaced_or_kept(spark):
    docs = table(spark, odd_texts(n=20)).withColumn("N_Words", F.lit("x")).withColumn("kept", F.lit("y"))
    out = quality_rules.apply_rules(docs)
    assert sorted(c.lower() for c in out.columns).count("n_words") == 1 and dict(out.dtypes)["kept"] == "boolean"
    assert quality_rules.passing(docs).columns == docs.columns
    assert quality_rules.passing(docs).count() == out.where("kept").count()
    lines = line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit(None).cast("string")))
    assert lines.count() == 20 and dict(lines.dtypes)["n_lines"] == "bigint"


@pytest.mark.parametrize("step", [quality_rules.apply_rules, line_dedup.dedup_lines, suffix_dedup.remove_repeats, near_dedup.near_duplicates])
def test_empty_table(spark, step):
    assert step(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup(spark):
    texts = odd_texts(1)
    docs = table(spark, texts)
    # rows that share an id, rows that are the same, and rows without one
    docs = docs.unionByName(docs.where("doc_id % 2 = 0")).unionByName(docs.where("doc_id % 5 = 0").withColumn("doc_id", F.lit(None).cast("long")))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = line_dedup.dedup_lines(docs)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str)
    assert got == sorted(brute.line_dedup(rows), key=str)


def test_line_runs_compact_and_count(spark):
    runs = line_dedup.LineRuns(spark, 4, enough=3, fan_in=2)
    for batch in range(5, 0, -1):
        keys = [(batch * 10 + d, k, 0) for d in range(2) for k in range(6) if k % 3 or d == 0 and batch == 5]
        runs.add(spark.createDataFrame(keys, "doc long, h1 long, h2 long"))
    assert sum(len(level) for level in runs.levels) <= 3 and len(runs.levels) == 3
    assert {(r.h1, r.keeper) for r in runs.frequent().collect()} == {(k, 51) for k in (1, 2, 4, 5)}
    runs.drop()


def test_habit_of_a_host_takes_its_doubtful_documents_along(spark):
    prose, table_text = " ".join(f"word{i}" for i in range(30)), " ".join(f"a|b|{i}" for i in range(30))
    lines = "\n".join([f"the same line over again {i // 5}" for i in range(10)] + [f"own{i} line{i} of{i} text{i}" for i in range(20)])
    rows = [(i, table_text if i % 4 else prose, "tables") for i in range(400)]
    rows += [(1000 + i, prose if i % 20 else table_text, f"host{i % 7}") for i in range(1400)]
    rows += [(5000, table_text, None), (5001, "long" * 20 + " " + " ".join(["supercalifragilistic"] * 3 + [f"extraordinarily{i}" for i in range(9)]), "host1")]
    rows += [(6000 + i, lines, "host2") for i in range(3)]
    got = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(not r.base_failed for r in got.values() if r.doc_id < 6000)
    assert all(r.kept == (r.text == prose) and not r.host_failed for r in got.values() if r.source == "tables")
    assert all(r.kept for r in got.values() if r.source != "tables" and r.doc_id < 6000)  # a doubt alone is no verdict
    slim = quality_rules.apply_rules(spark.createDataFrame(rows, DOCS), with_text=False)
    assert "text" not in slim.columns and slim.where("kept").count() == sum(r.kept for r in got.values())


def test_rules_equal_sql_where_hosts_have_habits(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from aquatally.llm import oracles, queries

    r = random.Random(3)
    def text(host):
        words = [r.choice(["Wald", "a", "b|c", "#x", "niño", "some", "longer", "words"]) + str(r.randrange(50)) for _ in range(r.randrange(4, 40))]
        if host % 4 == 0:
            words = [w + "|" for w in words]
        if host % 4 == 1:
            words = words + ["\nthe line\n"] * r.randrange(6)
        if host % 4 == 2:
            words = [w * 4 for w in words]
        return " ".join(words)
    rows = [(i, text(i % 11) if i % 50 else None, f"h{i % 11}" if i % 13 else None) for i in range(900)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op1_quality_rules(spark, str(tmp_path))
    got = sorted(map(tuple, out.collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(oracles.QUALITY_RULES)
    assert [d[0] for d in want.description] == out.columns
    assert got == sorted(want.fetchall())
    assert sum(not r[-1] and not r[-2] for r in got) > 100


def test_columns_of_the_caller_pass_whatever_their_names(spark):
    texts = odd_texts(4, 30)
    odd = ["__doc", "__gone", "__host", "gone", "doc", "host", "c0", "c1", "id.with.dot", "h1", "habits", "keeper", "N_Lines"]
    docs = table(spark, texts)
    for name in odd:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    for step, new in ((line_dedup.dedup_lines, {"n_lines"}), (quality_rules.apply_rules, {"n_lines"}), (near_dedup.without_near_duplicates, set())):
        out = step(docs)
        left = [c for c in odd if c.lower() not in new]
        rows = out.select("doc_id", *[F.col(f"`{c}`") for c in left]).collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in left)
    assert near_dedup.without_near_duplicates(docs).columns == docs.columns


def test_line_dedup_of_text_ids(spark):
    texts = odd_texts(6)
    names = ["", "ä", "a", "a0", "Z", "abcdefgh1", "abcdefgh2", "漢"]
    rows = [(names[i] if i < len(names) else f"doc-{i * 7919 % 1000:04d}", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "`the.id` string, text string").repartition(3)
    got = sorted(map(str, ((r["the.id"], r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs, "the.id").collect())))
    order = {n: i for i, n in enumerate(sorted((n for n, _ in rows), key=str.encode))}
    back = {i: n for n, i in order.items()}
    want = brute.line_dedup([(order[n], t) for n, t in rows])
    assert got == sorted(str((back[d], *rest)) for d, *rest in want)


def test_a_failed_run_leaves_no_tables(spark, monkeypatch):
    def fails(self):
        raise ValueError("lost")

    monkeypatch.setattr(line_dedup.LineRuns, "frequent", fails)
    with pytest.raises(ValueError, match="lost"):
        line_dedup.dedup_lines(table(spark, odd_texts(n=20)))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_runs_")]


def test_suffix_dedup(spark):
    texts = odd_texts(2)
    out = suffix_dedup.remove_repeats(table(spark, texts), with_bytes=True).collect()
    want = brute.repeats([(i * 3 + 1, t) for i, t in enumerate(texts) if not (t or "").startswith("word0")])
    long_ids = {i * 3 + 1 for i, t in enumerate(texts) if (t or "").startswith("word0")}
    for r in out:
        if r.doc_id not in long_ids:
            assert (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) == want[r.doc_id]
            assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
    # the second long text repeats the first one but for its last word, whose space it has elsewhere
    second = max((r for r in out if r.doc_id in long_ids), key=lambda r: r.doc_id)
    assert second.n_removed == len(LONG) + 1 and bytes(second.kept) == b"end"


def test_suffix_dedup_ids(spark):
    text = "x".join(str(i) for i in range(60))
    rows = [(5, text, "a"), (5, text, "a"), (9, text, "b"), (None, text, "c"), (None, text, "c")]
    out = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect())
    n = len(text)
    assert out == [("5", 0), ("5", 0), ("9", n), ("None", n), ("None", n)]


@pytest.mark.parametrize("hot_docs", [400, 1 << 18])
def test_one_phrase_in_a_third_of_all_documents(spark, monkeypatch, hot_docs):
    """Its surroundings differ everywhere, but for some that two documents share."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9)))
    phrase = "posted by the editor on a fine day"
    asides = [(f"{word()} {word()}", f"{word()} {word()}") for _ in range(200)]
    texts = []
    for i in range(6000):
        before, after = r.choice(asides) if i % 9 == 0 else (f"{word()} {word()}", f"{word()} {word()}")
        texts.append(f"{word()} {before} {phrase} {after} {word()}" if i % 3 == 0 else " ".join(word() for _ in range(14)))
    texts[0] = f"aa {texts[0]} {texts[0]}"  # repeats within one document remove nothing
    sizes = []
    monkeypatch.setattr(suffix_dedup, "GROUP", 1 << 15)
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], DOCS).repartition(5)
    told = suffix_dedup.written

    def seen(df, name):
        out = told(df, name)
        if name == "suffix-anchors":
            sizes.append(out.where(f"key = {suffix_dedup.HOT_ROW}").count())
        return out

    monkeypatch.setattr(suffix_dedup, "written", seen)
    want = brute.repeats(list(enumerate(texts)))
    out = suffix_dedup.remove_repeats(docs, hot_docs=hot_docs).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, len(x.spans), x.kept_sha256) for x in out} == want
    assert (sizes[0] > 0) == (hot_docs == 400)


def test_many_windows_are_dealt_by_their_bytes(monkeypatch):
    r = np.random.default_rng(5)
    body = r.integers(97, 99, 3000).astype(np.uint8)
    starts, docs = r.integers(0, 2950, 4000), r.integers(0, 300, 4000)
    job = suffix_dedup.SuffixDedup(12, 1, 1, 1)
    whole = job.known(body, starts, docs)
    monkeypatch.setattr(suffix_dedup, "MOST", 100)
    assert whole.any() and not whole.all() and (job.known(body, starts, docs) == whole).all()


def test_anchors_depend_on_content_alone():
    r = np.random.default_rng(0)
    data = r.integers(97, 100, 5000).astype(np.uint8)
    data[1000:1400] = data[3000:3400]
    data[200:400] = 120
    hashes, first, last = suffix_dedup.anchors(data, 50)
    assert first[0] == 0 and last[-1] == len(data) - 50 and (first[1:] == last[:-1] + 1).all()
    served = {int(s): int(h) for h, a, b in zip(hashes, first, last) for s in range(a, b + 1)}
    for s in range(1000, 1350):
        assert served[s] == served[s + 2000]


def test_longest_previous_equals_all_pairs():
    r = np.random.default_rng(1)
    for _ in range(30):
        n = int(r.integers(1, 40))
        windows, docs = r.integers(0, 2, (n, 10)).astype(np.uint8), r.integers(0, 6, n)
        got = suffix_dedup.longest_previous(windows, docs)
        for i in range(n):
            best = 0
            for j in range(n):
                if docs[j] < docs[i]:
                    same = windows[i] == windows[j]
                    best = max(best, 10 if same.all() else int(same.argmin()))
            assert got[i] == best


def test_near_duplicates(spark):
    texts = odd_texts(3, 80)
    out = near_dedup.near_duplicates(table(spark, texts)).collect()
    want = brute.near([(i * 3 + 1, t) for i, t in enumerate(texts)])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_large_groups_branch_and_collapse(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(400):  # near copies, all different, more than one node takes
        own = list(base)
        own[r.randrange(300)] = f"x{i}"
        rows.append((1000 + i, " ".join(own), "a"))
    shared = " ".join(base[:60])
    for i in range(300):  # unlike but for one passage
        rows.append((5000 + i, shared + " " + " ".join(f"y{r.randrange(10**6)}" for _ in range(100)), "b"))
    rows += [(1, " ".join(base), "c"), (2, " ".join(base), "c"), (3, "", "c"), (4, None, "c"), (None, " ".join(base), "c")]
    docs = spark.createDataFrame(rows, DOCS)
    out = near_dedup.near_duplicates(docs, small=16).collect()
    got = {r.doc_id: r.component_id for r in out}
    assert all(got[1000 + i] == 1 for i in range(400)) and got[2] == 1 and got[None] == 1
    assert all(got[5000 + i] == 5000 + i for i in range(300)) and got[3] == 3 and got[4] == 4
    left = near_dedup.without_near_duplicates(docs, small=16)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "3", "4", "None", *map(str, range(5000, 5300))])


def test_threshold_is_exact(spark):
    def text(shared, own, name):
        return " ".join([f"s{i}" for i in range(shared + 4)] + [f"{name}{i}" for i in range(own)])

    # 30 shared of 40 is 75 %; 29 of 39 is less
    rows = [(1, text(30, 5, "a"), "h"), (2, text(30, 5, "b"), "h")]
    rows += [(3, text(29, 5, "c").replace("s", "t"), "h"), (4, text(29, 5, "d").replace("s", "t"), "h")]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    assert near_dedup.trees_for(0.9999, 0.75) == 5


def test_links_between_blocks_far_apart_are_confirmed(spark):
    # a family of unlike texts with one template fills nodes of 1,025 to 2,048 records; pairs are planted in it
    r = random.Random(8)
    own = lambda n: [f"o{r.randrange(10**9)}" for _ in range(n)]
    template = own(64)
    texts = []
    for _ in range(900):
        shared = template + own(18)
        texts += [" ".join(shared + own(12)) for _ in range(2)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    number = {}
    places = [[number.setdefault(x, len(number)) for x in s] for s in sets]
    held = np.zeros((len(texts), len(number)), np.float32)
    for row, own_places in zip(held, places):
        row[own_places] = 1
    held = held[:, held.sum(axis=0) > 1]
    shared, sizes = held @ held.T, np.array(list(map(len, sets)))
    linked = 100 * shared >= 75 * (sizes[:, None] + sizes[None] - shared)
    assert all(np.flatnonzero(row).tolist() == [i - i % 2, i - i % 2 + 1] for i, row in enumerate(linked))
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], DOCS).repartition(4)
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(docs).collect()}
    assert [i for i in range(len(texts)) if got[i] != i - i % 2] == []


def alike(m, seed=9):
    """Texts of one template, any two alike at 0.7; of every ten the first two are linked."""
    r = random.Random(seed)
    own = lambda n: [f"o{r.randrange(10**9)}" for _ in range(n)]
    template, texts, linked = own(80), [], {}
    for i in range(m):
        if i % 10 != 1:
            middle = own(8)
        else:
            linked[i] = i - 1
        texts.append(" ".join(template + middle + own(8)))
    return texts, linked


def test_candidates_grow_with_the_family_and_not_with_its_square(spark, monkeypatch):
    made = {}

    def counted(df, name):
        out = util_written(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    util_written = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", counted)
    rows = []
    for m in (1000, 2000):
        texts, linked = alike(m)
        made.clear()
        docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], DOCS).repartition(4)
        got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(docs).collect()}
        assert got == {i: linked.get(i, i) for i in range(m)}
        assert made["near-clusters"] >= 0.9 * m
        rows.append(sum(made[n] for n in ("near-likely", "near-pairs", "near-open", "near-blocks", "near-within")))
    # of 2,000,000 pairs; blocks of 512 records meet, so the rows of a record grow by one with every such block
    assert rows[1] < 12 * 2000 and rows[1] < 4 * rows[0], rows


def test_shared_hashes_and_forests_equal_sets():
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64)) for _ in range(30)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[12:]] for a in sets[:12]]
    for columns in (7, 4096):
        assert near_dedup._shared(sets[:12], sets[12:], columns).astype(int).tolist() == want
    assert near_dedup._shared(sets[:1], [np.array([99], np.uint64)]).tolist() == [[0.0]]
    a, b = r.integers(0, 40, 30), r.integers(0, 40, 30)
    p, q = near_dedup._spanning(a, b)
    assert components_of(p, q) == components_of(a, b) and len(p) <= 39 and (p < q).all()


def components_of(a, b):
    root = {int(x): int(x) for x in [*a, *b]}
    for _ in root:
        for x, y in zip(a.tolist(), b.tolist()):
            root[x] = root[y] = min(root[x], root[y])
    return {k: v for k, v in root.items() if any(k in (x, y) and x != y for x, y in zip(a.tolist(), b.tolist()))}


def test_components_of_few_links_need_no_rounds(spark, monkeypatch):
    # 200 nodes in a row, named in no order, take rounds of joins only where one task does not hold their links
    r = random.Random(11)
    names = r.sample(range(10**6), 200)
    chain = [*zip(names, names[1:]), (7, 7), (10**7, 10**7 + 1)]
    many = [(r.randrange(4000), r.randrange(4000)) for _ in range(3000)]
    made = []

    def counted(df, name):
        made.append(name)
        return util_written(df, name)

    util_written = graph.written
    monkeypatch.setattr(graph, "written", counted)
    for links, most in ((chain, graph.EDGES), (many, graph.EDGES), (many, 64)):
        made.clear()
        table = spark.createDataFrame(links, "a long, b long").repartition(5)
        got = graph.components(table, most).collect()
        root = {x: x for link in links for x in link}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            least, other = sorted((top(a), top(b)))
            root[other] = least
        linked = {x for a, b in links if a != b for x in (a, b)}
        assert sorted((x.node, x.root) for x in got) == sorted((x, top(x)) for x in linked)
        assert (len(made) == 1) == (most == graph.EDGES)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_move_compressed_by_group(monkeypatch):
    # what the two moves of op2's texts put on disk
    r = random.Random(12)
    words = [f"word{r.randrange(300)}" for _ in range(300)]
    docs = [(r.randrange(-50, 50), " ".join(r.choices(words, k=400)).encode(), i % 9 == 0) for i in range(200)]
    docs += [(3, b"", False), (3, None, False), (1 << 62, "é".encode(), True)]
    columns = [pa.array(c, t) for c, t in zip(zip(*docs), (pa.int64(), pa.binary(), pa.bool_()))]
    batches = pa.Table.from_arrays(columns, ["doc", "text", "nameless"]).to_batches(max_chunksize=20)
    job = suffix_dedup.SuffixDedup(50, 4, 7, 1000)
    raw = sum(len(t or b"") for _, t, _ in docs)
    for blob in (suffix_dedup.BLOB, raw // 4):
        monkeypatch.setattr(suffix_dedup, "BLOB", blob)
        sent = pa.Table.from_batches(list(job.sent_texts(iter(batches))))
        got = []
        for key in set(sent.column("key").to_pylist()):
            ids, nameless, texts = suffix_dedup._texts(sent.filter(pc.equal(sent.column("key"), key)))
            assert (-1 - ids % 7 == key).all()
            got += zip(ids.tolist(), map(bytes, texts), nameless.tolist())
        assert sorted(got) == sorted((d, t or b"", n) for d, t, n in docs)
        assert sum(map(len, sent.column("data").to_pylist())) < 0.5 * raw
