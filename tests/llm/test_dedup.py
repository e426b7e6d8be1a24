from __future__ import annotations

import random

import brute
import duckdb
import numpy as np
import pytest

from packetloom.llm import components, exact_dedup, line_dedup, lpf_dedup, queries, simhash


def made(spark, rows, schema="doc_id bigint, text string", parts=3):
    return spark.createDataFrame(rows, schema).coalesce(1) if parts == 1 else spark.createDataFrame(rows, schema).repartition(parts)


def duck(sf_dir, names, sql):
    con = duckdb.connect()
    for name in names:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


@pytest.mark.parametrize("name,names", [("op5_exact_dedup", ["documents"]), ("op8_url_filter", ["pages", "labels"])])
def test_matches_sql(llm_spark, sf_dir, name, names):
    columns, rows = duck(sf_dir, names, queries.ORACLES[name])
    mine = queries.QUERIES[name](llm_spark, sf_dir).select(columns).collect()
    assert sorted(map(str, map(tuple, mine))) == sorted(map(str, rows))


def test_binary_fuse_filter_has_no_false_negative():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 1000, 50_000):
        keys = rng.integers(0, 2**64, n, dtype=np.uint64)
        fuse = exact_dedup.BinaryFuse8.build(keys)
        assert fuse.probe(keys).all()
    others = rng.integers(0, 2**64, 50_000, dtype=np.uint64)
    assert fuse.probe(others).mean() < 0.01
    assert fuse.table.nbytes < 1.4 * n


def test_exact_groups_across_snapshot_and_batch(llm_spark):
    rows = [(1, "a b"), (2, "ab"), (3, " a  b "), (4, "c"), (10, "a\tb\n\x0b"), (11, "c"), (12, "a b"), (13, None), (14, "")]
    found = {r.doc_id: r for r in exact_dedup.exact_dedup(made(llm_spark, rows), split=9).collect()}
    assert {d: r.keep_id for d, r in found.items()} == {1: 3, 2: 3, 3: 3, 4: 4, 10: 3, 11: 4, 12: 12, 13: 13, 14: 13}
    assert found[1].group_size == 4 and found[3].kept and not found[10].kept
    for split in (0, 3, 100):
        again = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(made(llm_spark, rows), split=split).collect()}
        assert again == {d: r.keep_id for d, r in found.items()}


def test_exact_odd_rows(odd_docs, no_docs):
    rows = exact_dedup.exact_dedup(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    assert sum(r.kept for r in rows if r.doc_id == 4) == 1
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def line_texts(n, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcd") for _ in range(k)) for k in (1, 2, 3, 30, 60)] + [""]
    block = [rng.choice(pool) for _ in range(6)]
    texts = []
    for _ in range(n):
        lines = [f"{rng.choice(pool)} {rng.randint(0, 9) if rng.random() < 0.4 else ''}" for _ in range(rng.randint(0, 9))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(lines))
            lines[at:at] = block[rng.randint(0, 2) : rng.randint(3, 6)]
        texts.append("\n".join(lines))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_line_runs_against_brute_force(llm_spark, seed):
    texts = line_texts(60, seed)
    docs = made(llm_spark, list(enumerate(texts)), parts=1)
    mine = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert [mine[i] for i in range(len(texts))] == brute.lines_left(texts, line_dedup.MIN_LINES, line_dedup.MIN_WORDS)


def test_line_query_against_brute_force(llm_spark, sf_dir, tables):
    rows = tables("documents").select("doc_id", "text").collect()
    left = brute.lines_left([r.text for r in rows], line_dedup.MIN_LINES, line_dedup.MIN_WORDS)
    import hashlib

    want = {r.doc_id: hashlib.sha256(t.encode()).hexdigest() for r, t in zip(rows, left, strict=True)}
    assert {r.doc_id: r.kept_sha256 for r in queries.op1_line_dedup(llm_spark, sf_dir).collect()} == want


def test_line_odd_rows(odd_docs, no_docs):
    rows = line_dedup.dedup_lines(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert sorted(r.n_removed for r in rows if r.doc_id == 4) == [0, 3, 3]
    assert [r.text for r in rows if r.doc_id == 91] == [""]
    assert {r.fp for r in rows} == {1}
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_components(llm_spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    frame = llm_spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r.node: r.component for r in components.connected_components(frame).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert all(found[x] == find(x) for e in edges for x in e if e != (7, 7) or x in found)
    assert components.connected_components(frame.limit(0)).count() == 0


def test_simhash_query_against_brute_force(llm_spark, sf_dir, tables):
    rows = tables("documents").select("doc_id", "text").collect()
    prints = [brute.simhash(r.text) for r in rows]
    classes = brute.components([r.doc_id for r in rows], prints, 4)
    want = {(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, classes, strict=True)}
    assert {tuple(r) for r in queries.op4_simhash(llm_spark, sf_dir).collect()} == want


def test_vantage_forest_finds_every_link(llm_spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 50)
    monkeypatch.setattr(simhash, "LEAF_ROWS", 8)
    monkeypatch.setattr(simhash, "SLICE_PAIRS", 2_000)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    near = base.copy()
    for _ in range(5):
        flip = rng.random(len(near)) < 0.8
        near[flip] ^= np.uint64(1) << rng.integers(0, 64, flip.sum()).astype(np.uint64)
    prints = np.unique(np.concatenate((base, near, base[:60] ^ np.uint64(7))))
    frame = llm_spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp bigint")
    links = simhash.near_links(frame).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in links)
    root = {int(x): int(x) for x in prints.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    want = brute.components(list(range(len(prints))), [int(x) for x in prints], 4)
    groups: dict = {}
    for i, x in enumerate(prints.view(np.int64)):
        groups.setdefault(find(int(x)), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


@pytest.mark.parametrize("block", [1024, 5])
def test_similar_texts_against_brute_force(llm_spark, monkeypatch, block):
    """Recall of the candidates, and exactness of what is reported, on edited copies of many sizes."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)
    rng = random.Random(6)
    texts = []
    for _ in range(40):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(3, 400))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 8)):
            other = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                other[rng.randrange(len(other))] = "edit"
            texts.append(" ".join(other))
    want = brute.similar(list(range(len(texts))), texts, 5, 0.8)
    docs = made(llm_spark, list(enumerate(texts)), parts=1)
    found = {r.row: r.kept_row for r in simhash.similar_groups(docs).collect()}
    mine = [found.get(i, i) for i in range(len(texts))]
    sets = {(m, w) for m, w in zip(mine, want, strict=True)}
    # Never two of the true classes under one name.
    assert len({m for m, _ in sets}) == len(sets)
    gone = sum(w != i for i, w in enumerate(want))
    assert sum(m != i for i, m in enumerate(mine)) >= 0.95 * gone > 50


@pytest.mark.parametrize("often", [3, 10**9])
def test_similar_texts_with_edits_in_one_place(llm_spark, monkeypatch, often):
    """Truncated, extended and block-edited copies around the limit: all that brute force finds, nothing else."""
    monkeypatch.setattr(simhash, "OFTEN", often)
    rng = random.Random(8)
    frequent = " ".join(f"notice{i}" for i in range(12))

    def words(n):
        return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]

    texts = []
    for _ in range(30):
        n = rng.randint(30, 500)
        # One pair each, so that no link stands in for another.
        for share in (0.1, 0.14, 0.18, 0.22):
            base, k = words(n), int(share * n)
            at = rng.randint(0, n - k)
            copies = base[: n - k], base[k:], base + words(k), base[:at] + words(k // 2) + base[at + k // 2 :]
            texts += [" ".join(base), " ".join(rng.choice(copies)), " ".join([*words(n), frequent])]
    want = brute.similar(list(range(len(texts))), texts, 5, 0.8)
    docs = made(llm_spark, list(enumerate(texts)), parts=1)
    found = {r.row: r.kept_row for r in simhash.similar_groups(docs).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == want
    assert 20 < sum(w != i for i, w in enumerate(want)) < 120


def test_large_groups_below_the_limit_meet_under_rare_shingles(llm_spark):
    """A big family whose members are just too different: few rows of pairs are made, and similar pairs stay."""
    size, family = 100, 60
    rng = random.Random(13)
    # Sets of 100 that share 89 have 3 of them among their first 14: here only frequent shingles behind are alike.
    rows = [(f, 12 + f, family, i, size, i) for i in range(family) for f in range(9)]
    want = {(i, i + 1) for i in range(family, family + 20, 2)}
    for i, j in want:
        kept = sorted(rng.sample(range(21), 14))
        rows += [(1000 * i + k, k, 2, i, size, i) for k in kept] + [(1000 * i + k, at, 2, j, size, j) for at, k in enumerate(kept)]
    met = llm_spark.createDataFrame(rows, "shingle bigint, at int, texts bigint, id bigint, size bigint, part bigint")

    def joined(plan):
        found = [joined(plan.children().apply(k)) for k in range(plan.children().size())]
        own = plan.metrics().apply("numOutputRows").value() if plan.nodeName().endswith("Join") else 0
        return max([own, *found])

    llm_spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = simhash._candidates(met, 0.8)
        assert {tuple(r) for r in pairs.collect()} == want
        made_rows = joined(pairs._jdf.queryExecution().executedPlan())
    finally:
        llm_spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Two of nine shingles count, and those of the ten pairs.
    assert 0 < made_rows < 3 * family * (family - 1) // 2


def test_near_groups_follow_fingerprints_and_similarity(llm_spark):
    """Links of the forest count in the dedup stage too, alone and in chains with similar texts."""
    rng = random.Random(11)

    def words(n):
        return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]

    texts = ["", None, " \n"]
    for _ in range(12):
        # Fingerprints count repeats: these agree although their shingle sets hardly do.
        phrase, tail = words(5) * 40, words(60)
        texts += [" ".join(phrase + words(12)), " ".join(phrase + words(12)), " ".join(phrase[:60] + tail), " ".join(phrase + tail)]
        base = words(200)
        texts += [" ".join(base), " ".join(base[:180]), " ".join(words(50))]
    sets, prints = [brute.shingles(t or "", 5) for t in texts], [brute.simhash(t or "") for t in texts]

    def near(i, j):
        return (prints[i] ^ prints[j]).bit_count() <= 4

    def alike(i, j):
        return sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9

    ids = list(range(len(texts)))
    want = brute._classes(ids, lambda i, j: near(i, j) or alike(i, j))
    # Neither kind of link gives these classes alone.
    assert want != brute._classes(ids, near) and want != brute._classes(ids, alike)
    docs = made(llm_spark, list(enumerate(texts)), parts=1)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == set(want) and len(kept) < len(texts) - 20
    found = {r.row: r.kept_row for r in simhash.near_groups(docs).collect()}
    assert [found[i] for i in ids] == want


def test_near_duplicates_take_few_tasks(llm_spark):
    """Both kinds of links meet in one graph of row numbers: each task costs files and log lines, however few its rows."""
    rng = random.Random(12)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(120)] for _ in range(40)]
    texts = [" ".join(w if i else w[:110]) for w in base for i in range(2)] + [" ".join(base[0][:k]) for k in range(60, 120, 6)]
    docs, sc = made(llm_spark, list(enumerate(texts)), parts=1), llm_spark.sparkContext
    conf = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: llm_spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        llm_spark.conf.set(k, v)
    try:
        sc.setJobGroup("near-tasks", "tasks of the near-duplicate stage")
        assert simhash.drop_near_duplicates(docs).count() == 40
        tracker = sc.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup("near-tasks") for s in tracker.getJobInfo(job).stageIds}
        tasks = sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)
    finally:
        for k, v in before.items():
            llm_spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert tasks < 140 * 20


def test_simhash_odd_rows(odd_docs, no_docs):
    rows = simhash.simhash_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {0}
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and set(ids) >= {None, 0, 90} and not {1, 2, 91} & set(ids)
    assert simhash.drop_near_duplicates(no_docs).count() == 0
    assert simhash.simhash_groups(no_docs).count() == 0


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("crowd", [4096, 1])
def test_repeats_against_brute_force(llm_spark, keep, crowd):
    rng = random.Random(9)
    alphabet = "abcdefgh é"
    shared = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (399, 400, 450, 1200, 900)]
    texts = ["ab" * 900, "", "z" * 399, "z" * 401, "0123456789" * 90]
    for _ in range(40):
        part = list("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 700))))
        for _ in range(rng.randint(0, 3)):
            s = list(rng.choice(shared))
            if rng.random() < 0.5:
                s[rng.randrange(len(s))] = "X"
            at = rng.randint(0, len(part))
            part[at:at] = s
        texts.append("".join(part))
    texts += texts[10:14]
    docs = made(llm_spark, list(enumerate(texts)), parts=1)
    found = lpf_dedup.remove_repeats(docs, keep=keep, shard_fragments=crowd).collect()
    mine = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in found}
    want = brute.repeats_removed([t.encode() for t in texts], 400, keep)
    assert [mine[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("keep", ["none", "first"])
def test_crowded_repeats_beside_a_second_gram(llm_spark, keep):
    """A copy of a run, with its frequent line once more further left within the reach of a window."""
    found = {}
    for seed in range(12):
        rng = random.Random(seed)
        s, line, x, y = ("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (200, 60, 300, 100))
        found[seed] = [s + line + x, line + y + s + line + x]
    texts = [t for pair in found.values() for t in pair]
    docs = made(llm_spark, list(enumerate(texts)), parts=1)
    mine = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in
            lpf_dedup.remove_repeats(docs, keep=keep, shard_fragments=1).collect()}
    assert [mine[i] for i in range(len(texts))] == brute.repeats_removed([t.encode() for t in texts], 400, keep)


def test_repeats_query_against_brute_force(llm_spark, sf_dir, tables):
    import hashlib

    rows = tables("documents").select("doc_id", "text").collect()
    want = brute.repeats_removed([r.text.encode() for r in rows], 400)
    want = {
        (r.doc_id, len(r.text.encode()), n, s, hashlib.sha256(k).hexdigest(), n > 0, k.decode("utf-8", "replace"))
        for r, (n, s, k) in zip(rows, want, strict=True)
    }
    assert {tuple(r) for r in queries.op7_suffix_dedup(llm_spark, sf_dir).collect()} == want


@pytest.mark.parametrize("bits", [1 << 25, 2])
def test_texts_without_repeats_stay_where_they_are(llm_spark, monkeypatch, bits):
    """The filter of texts that travel misses none, passes few others, and when full changes no result."""
    monkeypatch.setattr(lpf_dedup, "FILTER_BITS", bits)
    rows = llm_spark.range(20_000).withColumnRenamed("id", "row")
    marked = lpf_dedup._marked(rows, rows.filter("row % 37 = 0"))
    assert marked.count() == 20_000 and marked.filter("row % 37 = 0 and not marked").count() == 0
    assert marked.filter("marked").count() == 20_000 if bits == 2 else marked.filter("marked").count() < 600
    assert lpf_dedup._marked(rows, rows.limit(0)).filter("marked").count() == 0
    shared = "".join(chr(97 + i * i % 23) + str(i) for i in range(200))
    docs = [(1, "first " + shared + " end"), (2, "lone text " * 3), (3, shared), (4, None), (5, "".join(map(str, range(300))))]
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in lpf_dedup.remove_repeats(made(llm_spark, docs)).collect()}
    n = len(shared)
    assert n >= 400 and out == {1: (n + 10, n, 1), 2: (30, 0, 0), 3: (n, n, 1), 4: (0, 0, 0), 5: (790, 0, 0)}


def test_repeats_odd_rows(odd_docs, no_docs):
    rows = lpf_dedup.remove_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.n_removed == r.n_bytes for r in rows if r.doc_id in (90, 91))
    assert lpf_dedup.remove_repeats(no_docs).count() == 0
