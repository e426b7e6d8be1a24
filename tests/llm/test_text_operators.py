from __future__ import annotations

import random
import zlib
from itertools import groupby

import brute
import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from packetloom.llm import decontaminate, packing, queries, secret_scan, simhash, token_counts, toxicity, url_reputation


def made(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


# Packing


@pytest.fixture(scope="module")
def reference_tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def check_pieces(pieces, ids_of):
    by_doc: dict = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    assert by_doc.keys() == ids_of.keys()
    for doc_id, mine in by_doc.items():
        ids, at = np.array([*ids_of[doc_id], packing.END_ID], np.uint32), 0
        for p in sorted(mine, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    lengths = []
    for _, mine in groupby(sorted(pieces, key=lambda p: (p.sequence_id, p.offset)), key=lambda p: p.sequence_id):
        at = 0
        for p in mine:
            assert p.offset == at
            at += p.length
        assert at <= packing.WIDTH
        lengths.append(at)
    return sum(map(packing.padded_length, lengths)) / sum(lengths) - 1


def test_packing_query_round_trip(llm_spark, sf_dir, tables, reference_tokenizer):
    rows = tables("documents").select("doc_id", "text").collect()
    ids = {r.doc_id: reference_tokenizer.encode(r.text or "", add_special_tokens=False).ids for r in rows}
    assert check_pieces(queries.op2_packing(llm_spark, sf_dir).collect(), ids) < 0.01


def test_encoder_equals_the_library(reference_tokenizer):
    odd = ["Héllo  wörld!! it's <|endoftext|> x", "foo<|endoftext|>bar", "ﬁne ǅ İstanbul ΣΑΣ naïvé áb", "...", "\n",
           "don't you're 12345 a1b2\x1c\x85 z\u00a0b", "ſtrange K ª º ŉ word.,;", "", "ÀÉÎ, ÿŸ?! (paren) x_y 日本語。", "a\u0301b e\u0301."]
    mine = packing.WordIds.of(packing.TOKENIZER).encode([t.encode() for t in odd])
    for text, ids in zip(odd, mine, strict=True):
        assert ids.tolist() == [*reference_tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_closing_marks_are_encoded_once(reference_tokenizer):
    """Any run of marks after a word is looked up as such: the library sees each run once, not each word."""
    rng, calls = random.Random(9), []

    class Counted:
        def encode(self, text, **options):
            calls.append(text)
            return reference_tokenizer.encode(text, **options)

    encoder = packing.WordIds(packing.TOKENIZER)
    encoder.tokenizer = Counted()
    marks = ["", "***", "$$$", ",%%%", "'", "&&&", "|>", '."', "!)"]
    words = ["".join(rng.choice("abcdeéßñXÄ") for _ in range(rng.randint(1, 9))) + rng.choice(marks) for _ in range(500)]
    text = "  " + " \n".join(words) + " "
    assert encoder.encode([text.encode()])[0].tolist()[:-1] == reference_tokenizer.encode(text, add_special_tokens=False).ids
    assert len(calls) <= len(marks)


@pytest.mark.parametrize("last", [True, False])
def test_monotone_queue_finds_the_least_cost(last):
    rng = random.Random(4)
    for _ in range(60):
        width = 64
        at = np.array([0, *sorted(rng.sample(range(1, 400), rng.randint(8, 60)))])
        at = np.unique(np.concatenate((at, np.arange(0, at[-1], 40))))
        penalty = np.array([rng.choice((0, 2, 16)) for _ in at])
        size = int(at[-1])
        cuts = packing.best_cuts(at, penalty, width, last, size)

        def cost(a, b):
            n = b - a
            least = 1 if last and b >= size - 2 * width else packing.LEAST_POWER
            return 0 if n & (n - 1) == 0 and n >= least else width - n

        best = [0] + [None] * (len(at) - 1)
        for j in range(1, len(at)):
            options = [best[i] + cost(int(at[i]), int(at[j])) for i in range(j) if at[j] - at[i] <= width]
            best[j] = min(options) + int(penalty[j]) + packing.SEQUENCE_COST
        end = int(np.searchsorted(at, cuts[-1]))
        mine = sum(
            cost(a, b) + int(penalty[np.searchsorted(at, b)]) + packing.SEQUENCE_COST
            for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        )
        assert mine == best[end] and cuts[0] == 0 and max(np.diff(cuts)) <= width
        assert end == len(at) - 1 if last else at[end] > size - width


def test_packing_odd_rows(llm_spark, odd_docs, no_docs, reference_tokenizer):
    packed = packing.pack_documents(odd_docs, with_ids=True).collect()
    rows = [r for r in odd_docs.collect() if r.doc_id != 4]
    ids = {r.doc_id: reference_tokenizer.encode(r.text or "", add_special_tokens=False).ids for r in rows}
    for doc_id, want in ids.items():
        mine = sorted((p for p in packed if p.doc_id == doc_id), key=lambda p: p.start)
        assert [i for p in mine for i in p.ids] == [*want, packing.END_ID]
    assert sum(p.start == 0 for p in packed if p.doc_id == 4) == 3
    assert packing.pack_documents(no_docs).count() == 0


def test_blocks_of_a_long_stream(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 5_000)
    rng = np.random.default_rng(3)
    marks = np.array([7], np.uint32)
    packer = packing.Packer(marks, packing.WIDTH, 0, True)
    docs = [rng.integers(2, 60, n).astype(np.uint32) for n in rng.integers(1, 4_000, 60)] + [np.full(30_000, 9, np.uint32)]
    rows = [r for i, d in enumerate(docs) for b in packer.add(i, d) for r in b.to_pylist()]
    rows += packer.flush(last=True).to_pylist()
    for i, d in enumerate(docs):
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [x for r in mine for x in r["ids"]] == d.tolist()
    sizes: dict = {}
    for r in rows:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert max(sizes.values()) <= packing.WIDTH
    assert sum(map(packing.padded_length, sizes.values())) < 1.03 * sum(sizes.values())


# Secrets

LEAKS = [
    'Password: "hunter22x" and passwd=short api_key = abc/DEF+123 token:x', "AKIA" + "Z9" * 9 + " x AKIA12", "f" * 23 + " " + "0a" * 20,
    "SECRET='s3cr3t_value' éé apikey=ABCDEFG", "ſecret=longvalue toKen=Kelvin123 KEY", "-----BEGIN RSA PRIVATE KEY-----",
    "ghp_" + "a1B2" * 10, "secret=AKIA" + "Q" * 16, "password password=abcdef", "tokentoken=====aaaaaa token = 'aaaaaa",
]


def test_secret_query_against_brute_force(llm_spark, sf_dir, tables):
    want = {(r.doc_id, *brute.secrets(r.text)) for r in tables("documents").select("doc_id", "text").collect()}
    found = queries.op6_secrets(llm_spark, sf_dir).collect()
    assert {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found} == want


def test_secret_spans_of_samples(llm_spark):
    rows = list(enumerate(LEAKS))
    found = {r.doc_id: r for r in secret_scan.secret_spans(made(llm_spark, rows)).collect()}
    for i, text in rows:
        spans = [(s["kind"], s["begin"], s["end"]) for s in found[i].base_spans]
        assert (found[i].n_assign, found[i].n_access, found[i].n_hex, secret_scan.span_digest(spans)) == brute.secrets(text)
        assert set(spans) <= {(s["kind"], s["begin"], s["end"]) for s in found[i].spans}
    assert {s["kind"] for i in (5, 6) for s in found[i].spans} == {"pem", "github"}


def test_trigram_queries_keep_every_match():
    texts = LEAKS + ["xoxb-" + "1" * 12, "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + ".c", "AIza" + "x" * 35, "rk_live_" + "Q" * 16, "plain"]
    for _, pattern, *_ in secret_scan.BASE_RULES + secret_scan.MORE_RULES:
        query = secret_scan.trigram_query(pattern)
        segment = secret_scan.Segment([t.encode() for t in texts], sorted({g for c in query for g in c}))
        hits = set(segment.candidates(query).tolist())
        assert hits >= {i for i, t in enumerate(texts) if regex.search(pattern.replace("(?ai:", "(?i:"), t, regex.ASCII)}
        assert query == secret_scan.ANY or len(hits) < len(texts)
    assert secret_scan.trigram_query("[0-9a-f]+") == secret_scan.ANY
    assert secret_scan.trigram_query("ab(cd|ef)?gh") == frozenset(
        map(frozenset, ([b"abg", b"bgh"], [b"abc", b"bcd", b"cdg", b"dgh"], [b"abe", b"bef", b"efg", b"fgh"]))
    )


def test_secret_odd_rows(odd_docs, no_docs):
    assert secret_scan.secret_spans(odd_docs).count() == odd_docs.count()
    assert secret_scan.secret_spans(no_docs).count() == 0


# Token counts


def test_tree_equals_full_recount():
    counter, rng = token_counts.Counter.of(token_counts.TOKENIZER), random.Random(1)
    for _ in range(400):
        alphabet = rng.choice(["ab 1.'s\n  ", "a b", "  \n\tx", "héß 's't9.!"])

        def some(sizes, letters=alphabet):
            return "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))

        text = some((0, 1, 5, 60, 400))
        tree = token_counts.TokenTree(text, counter)
        for _ in range(4):
            begin = rng.randint(0, len(text))
            end, new = min(len(text), begin + rng.choice((0, 1, 5, 40))), some((0, 1, 7, 80))
            tree.edit(begin, end, new)
            text = text[:begin] + new + text[end:]
            assert "".join(w for leaf in tree.leaves for w in leaf) == text
            assert tree.total == len(counter.model.encode(text, add_special_tokens=False).ids)


def test_edits_touch_little_of_a_long_text():
    counter = token_counts.Counter.of(token_counts.TOKENIZER)
    tree = token_counts.TokenTree("some plain words of a text, " * 5_000, counter)
    tree.edit(70_000, 70_004, "other")
    assert tree.encoded < 200


def test_token_query_against_full_recount(llm_spark, sf_dir, tables):
    model = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    model.encode_special_tokens = True

    def count(text):
        return len(model.encode(text, add_special_tokens=False).ids)

    found = {r.doc_id: r for r in queries.op9_token_counts(llm_spark, sf_dir).collect()}
    for r in tables("documents").select("doc_id", "text").collect():
        after, n = regex.subn(token_counts.PERSONAL, token_counts.REDACTED, r.text)
        mine = found[r.doc_id]
        assert (mine.n_tokens, mine.n_edits, mine.n_tokens_after) == (count(r.text), n, count(after))


def test_overlapping_and_odd_edits(llm_spark, odd_docs, no_docs):
    edits = [{"begin": 3, "end": 5, "new": "x"}, {"begin": 0, "end": 4, "new": None}, None, {"begin": None, "end": None, "new": "y"}]
    assert token_counts.chosen_edits(edits) == [(0, 4, "")]
    found = token_counts.edited_counts(token_counts.redaction_edits(odd_docs)).collect()
    assert len(found) == odd_docs.count() and {r.n_tokens for r in found if r.doc_id in (0, 1)} == {0}
    assert token_counts.edited_counts(token_counts.redaction_edits(no_docs)).count() == 0


# Decontamination


def test_contamination_against_brute_force(llm_spark):
    rng = random.Random(8)

    def prose(n):
        return " ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(n))

    items = [(i, prose(rng.randint(4, 30)).capitalize()) for i in range(25)] + [(90, None), (91, "  "), (92, "xyzzy")]
    rows = []
    for i in range(120):
        text = prose(rng.randint(0, 60))
        if i % 2:
            part = list(rng.choice(items[:25])[1].upper() if i % 6 == 1 else rng.choice(items[:25])[1])
            for _ in range(rng.randint(0, max(1, len(part) // 10))):
                part[rng.randrange(len(part))] = rng.choice("xyz ")
            at = rng.randint(0, len(text))
            text = text[:at] + "".join(part) + text[at:]
        rows.append((i, text))
    rows += [(500, "there is xyzzy in it"), (501, None)]
    benchmark = llm_spark.createDataFrame(items, "item_id bigint, text string")
    docs = made(llm_spark, rows)
    index = decontaminate.ItemIndex([i for i, t in items[:25]], [t.lower() for _, t in items[:25]], decontaminate.Q, decontaminate.EDIT_RATE)
    want = set()
    for d, text in rows:
        for n, (i, item) in enumerate(items[:25]):
            if brute.edit_distance_inside(item.lower(), (text or "").lower()) <= index.budget[n]:
                want.add((d, i))
    want.add((500, 92))
    for chars in (decontaminate.BLOCK_CHARS, 900):
        found = decontaminate.find_contamination(docs, benchmark, block_chars=chars).collect()
        assert len(found) == len(rows)
        assert {(r.doc_id, m.item_id) for r in found for m in r.matches} == want
    texts = dict(rows)
    for r in found:
        for m in r.matches:
            assert brute.edit_distance_inside(dict(items)[m.item_id].lower(), texts[r.doc_id][m.begin : m.end].lower()) == m.edits


def test_contamination_query_catches_every_whole_item(llm_spark, sf_dir, tables):
    items = {r.item_id: r.text.lower() for r in tables("benchmark").collect()}
    found = {r.doc_id: {m.item_id for m in r.matches} for r in queries.op3_decontamination(llm_spark, sf_dir).collect()}
    for r in tables("documents").select("doc_id", "text").collect():
        assert found[r.doc_id] >= {i for i, t in items.items() if t in r.text.lower()}


def test_contamination_odd_rows(llm_spark, tables, odd_docs, no_docs):
    benchmark = tables("benchmark")
    assert decontaminate.find_contamination(odd_docs, benchmark).count() == odd_docs.count()
    assert decontaminate.find_contamination(odd_docs, benchmark.limit(0)).filter("size(matches) = 0").count() == odd_docs.count()
    assert decontaminate.find_contamination(no_docs, benchmark).count() == 0
    assert decontaminate.drop_contaminated(odd_docs, benchmark).columns == odd_docs.columns


# Toxicity


def test_composed_transducer_names_patterns():
    lexicon = {"w:moron": 4.0}
    grammar = toxicity.Grammar(lexicon)

    def said(text):
        return [i for i, v in enumerate(grammar.features(text)[:8]) if v]

    assert said("what a moron") == [0]
    assert said("you are a moron") == [1]
    assert said("this is not a moron") == [2]
    assert said("this is not true. moron") == [0]
    assert said("somebody said moron") == [3]
    assert said("they will kill") == [5]
    assert said("Nothing to see here") == []


def test_toxicity_on_held_out_rows(llm_spark, tables):
    import pandas as pd

    docs, labels = tables("documents"), tables("labels")
    from pathlib import Path

    big = Path("/root/testdata/sf0.01")
    if big.exists():
        docs, labels = (llm_spark.read.parquet(f"{big}/{n}.parquet") for n in ("documents", "labels"))
    scored = toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, labels)).toPandas()
    assert (scored.held_out == [brute.held_out(i) for i in scored.doc_id]).all() and scored.score.between(0, 1).all()
    known = scored.merge(pd.DataFrame(labels.toPandas()), on="doc_id")
    test = known[known.held_out]
    assert (test.predicted == test.toxic).mean() > 0.97


@pytest.mark.parametrize("scale", [0.01, 1.0, 30.0])
def test_separable_rows_do_not_break_the_fit(scale):
    rng = np.random.default_rng(2)
    y = (rng.random(3000) < 0.1).astype(float)
    x = np.zeros((3000, toxicity.FEATURES))
    x[:, 0] = y * rng.uniform(1, 4, 3000) * scale
    x[:, 8] = x[:, 0]
    w = toxicity._logistic(x, y)
    p = 1 / (1 + np.exp(-(np.hstack((x, np.ones((3000, 1)))) @ w)))
    assert np.isfinite(w).all() and (scale < 1 or ((p > 0.5) == (y == 1)).all())


def plain_patterns(text, lexicon):
    """The features by the definition of a clause, without states: scopes are looked up in the words before."""
    sums, clauses, hits = [0.0] * 8, [0.0], 0
    words = []
    for word in toxicity.TOKEN.findall(text):
        if word in ".!?;:\n":
            words, clauses = [], [*clauses, 0.0]
            continue
        low = word.lower()
        terms = [f"w:{low}"] + [f"p:{low[:n]}" for n in toxicity.PREFIXES if len(low) > n]
        odds = max((lexicon[t] for t in terms if t in lexicon), default=None)
        kind = (
            "insult" if odds is not None else "threat" if low in toxicity.THREATS else "not" if low in toxicity.NEGATIONS
            else "said" if low in toxicity.REPORTS else "you" if low in toxicity.TARGETS else ""
        )
        if kind in ("insult", "threat"):
            if "not" in words[-toxicity.NEGATION_SCOPE :]:
                pattern, share = 2, 0.5
            elif "said" in words:
                pattern, share = 3, 0.5
            elif "you" in words[-toxicity.TARGET_SCOPE :]:
                pattern, share = 1, 1.5
            else:
                pattern, share = 0, 1.0
            weight = odds if kind == "insult" else 1.0
            sums[pattern + 4 * (kind == "threat")] += weight
            clauses[-1] += weight * share
            hits += 1
        words.append(kind)
    return [np.log1p(s) for s in sums] + [np.log1p(max(clauses)), np.log1p(hits)]


def test_toxicity_query_against_a_plain_scorer(llm_spark, sf_dir, tables):
    docs, labels = tables("documents"), tables("labels")
    model = toxicity.fit_toxicity(docs, labels)
    lexicon = model.lexicon | {"w:the": 1.25, "p:verl": 0.5}
    rng = random.Random(8)
    words = [*sorted(toxicity.THREATS | toxicity.NEGATIONS | toxicity.REPORTS | toxicity.TARGETS), "the", "verlassen", "x", ".", ";", "\n"]
    texts = [r.text for r in docs.collect()] + [" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(400)]
    grammar = toxicity.Grammar(lexicon)
    for text in texts:
        assert np.allclose(grammar.features(text), plain_patterns(text, lexicon))
    for r in queries.op10_toxicity(llm_spark, sf_dir).join(docs.select("doc_id", "text"), "doc_id").collect():
        z = model.bias + float(np.dot(model.weights, plain_patterns(r.text, model.lexicon)))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == brute.held_out(r.doc_id)


def test_fit_takes_one_row_per_id(llm_spark):
    rows = [(i, f"plain words number {i} of a clean text") for i in range(40)] + [(100 + i, f"you idiot number {i}") for i in range(40)]
    labels = llm_spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows], "doc_id bigint, toxic int")
    once, often = made(llm_spark, rows), made(llm_spark, rows + rows[:3] * 500)
    assert toxicity.fit_toxicity(once, labels) == toxicity.fit_toxicity(often, labels)


@pytest.mark.parametrize("name", ["__row", "__ROW"])
def test_filters_keep_a_column_of_any_name(llm_spark, name):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12)), i * 10) for i in range(20)]
    docs = made(llm_spark, rows, f"doc_id bigint, text string, {name} bigint")
    benchmark = llm_spark.createDataFrame([(1, rows[3][1])], "item_id bigint, text string")
    left = decontaminate.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == [r for r in rows if r[0] != 3]
    assert sorted(map(tuple, simhash.drop_near_duplicates(docs).collect())) == rows


def test_scores_depend_on_the_text_only(llm_spark, tables):
    model = toxicity.ToxicModel({"w:idiot": 5.0}, [1.0] * 10, -2.0)
    rows = [(1, "you idiot"), (2, "you idiot"), (3, None), (4, "")]
    found = {r.doc_id: r.score for r in toxicity.toxicity_scores(made(llm_spark, rows), model).collect()}
    assert found[1] == found[2] > 0.5 > found[3] == found[4] > 0


def test_toxicity_without_labels(llm_spark, tables, odd_docs, no_docs):
    none = tables("labels").limit(0)
    model = toxicity.fit_toxicity(odd_docs, none)
    found = toxicity.toxicity_scores(odd_docs, model).collect()
    assert len(found) == odd_docs.count() and {r.score for r in found} == {0.5}
    one = llm_spark.createDataFrame([(i, 0) for i in range(60)], "doc_id bigint, toxic int")
    assert toxicity.toxicity_scores(odd_docs, toxicity.fit_toxicity(odd_docs, one)).filter("predicted = 1").count() == 0
    assert toxicity.toxicity_scores(no_docs, model).count() == 0
    assert toxicity.keep_clean(odd_docs, toxicity.ToxicModel(bias=-1.0)).columns == odd_docs.columns


# URL filter


def test_url_rules_and_odd_urls(llm_spark):
    cases = {
        "http://A.COM/x": ("a.com", "/x", "com/", "allow"),
        "https://example.com/en/1?q#f": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "https://www.example.com/en/2": ("www.example.com", "/en/2", "www.example.com/en/", "allow"),
        "https://x.www.example.com/en/2": ("x.www.example.com", "/en/2", "www.example.com/en/", "allow"),
        "http://q.net/es/": ("q.net", "/es/", "net/es/", "block"),
        "http://q.net/es": ("q.net", "/es", None, "allow"),
        "http://com": ("com", "", None, "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "no scheme.com/en": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://É.org?x": ("É.org", "", None, "allow"),
    }
    pages = llm_spark.createDataFrame(
        [(i, u, "h", "r") for i, u in enumerate(cases)] * 2, "page_id bigint, url string, host string, rule string"
    )
    labels = llm_spark.createDataFrame([], "page_id bigint, good int")
    found = url_reputation.filter_urls(pages, labels).collect()
    assert len(found) == 2 * len(cases)
    want = list(cases.values())
    assert all((r.host, r.path, r.rule, r.verdict) == want[r.page_id] for r in found)
    assert url_reputation.filter_urls(pages.limit(0), labels).count() == 0


def test_reputation_shrinks_and_blocks_on_evidence(llm_spark):
    pages, labels = [], []
    for n, (host, good, bad) in enumerate([("bad.org", 0, 40), ("good.org", 40, 0), ("new.org", 0, 1), ("mixed.org", 20, 20)]):
        for i in range(good + bad):
            pages.append((1000 * n + i, f"http://{host}/{i}"))
            labels.append((1000 * n + i, int(i < good)))
    pages.append((9999, "http://bad.org/unlabelled"))
    frames = llm_spark.createDataFrame(pages, "page_id bigint, url string"), llm_spark.createDataFrame(labels, "page_id bigint, good int")
    found = {r.page_id: r for r in url_reputation.filter_urls(*frames).collect()}
    assert found[9999].verdict == found[0].verdict == "block"
    assert found[1000].verdict == found[2000].verdict == found[3000].verdict == "allow"
    assert found[0].good_mean < found[2000].good_mean < found[1000].good_mean
