"""Lexical search, collocations and personal data against brute force, and on null, empty, repeated and long rows."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora.llm import boosting, collocations, lexical, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and a to in kelp moss fern iris opal onyx jade ruby Zinc Ärger naïve x1 22".split()


def corpus(n, seed, longest=60):
    rng = np.random.default_rng(seed)
    chance = 1 / np.arange(1, len(WORDS) + 1)
    rows = [(i, " ".join(rng.choice(WORDS, rng.integers(0, longest), p=chance / chance.sum())), "en", "s", 1) for i in range(n)]
    return rows + [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (3, rows[3][1], "en", "s", 1),
                   (None, "kelp moss, kelp moss.", "en", "s", 1), (n + 2, "the " * 3000 + "kelp", "en", "s", 1)]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(rows, items, k):
    docs = [(d, collections.Counter(terms(t))) for d, t, *_ in rows]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in docs:
            m = 75 + (25 * sum(c.values()) * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored)[:k])]
    return collections.Counter(out)


@pytest.mark.parametrize("small", [{}, {"block": 64, "chunk": 8, "short": 4, "sample": 2, "query_terms": 12}])
def test_search_matches_brute_force(spark, small):
    rows = corpus(300, 5)
    items = [(1, "kelp moss fern"), (2, "the THE of unknown"), (3, None), (4, "nothing here"), (5, "ruby zinc naïve Ärger 22 x1"),
             (5, "onyx"), (None, "jade jade jade a")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("x")).withColumn("score", F.lit("y"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("q", F.lit("z"))
    told = lexical.ranked(docs, asked, k=7, **small)
    assert collections.Counter(tuple(r) for r in told.collect()) == brute_search(rows, items, 7)
    assert lexical.ranked(docs.limit(0), asked).count() == 0 and lexical.ranked(docs, asked.limit(0)).count() == 0


def test_search_skips_chunks():
    rng = np.random.default_rng(3)
    n, lists = 20_000, 6
    sizes = np.full(n, lists)
    tfs = np.where(rng.random(n * lists) < 0.02, 9, 1)
    tfs[:lists] = 50
    searcher = lexical.Searcher([(np.arange(lists), np.ones(lists, dtype=np.int64))], np.arange(1, lists + 1) * 100, n, 10 * n, k=1)
    searcher.add(np.arange(n), np.full(n, 10), sizes, np.tile(np.arange(lists), n), tfs)
    assert searcher.best[0][0].tolist() == [0] and searcher.skipped > searcher.walked


def brute_phrases(rows, least, covered, first):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in found.items():
            score, k = min((10 ** 6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= covered * a for q, b in found.items()):
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:first])]
    return sorted(out)


def test_collocations_match_brute_force(spark):
    rows = corpus(200, 6) + [(1000 + i, "Moss. green fern, MOSS green fern! x\tmoss green\nfern the of", lang, "s", 1)
                             for i in range(12) for lang in (None, "und", "", "de")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1)).withColumn("phrase", F.lit("x"))
    for least, covered, first in ((10, 50, 2000), (3, 80, 25)):
        told = collocations.collocations(docs, least, covered, first).collect()
        assert sorted(tuple(r) for r in told) == brute_phrases(rows, least, covered, first)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_heads_cross_tasks(spark):
    """One very common first word, its pairs spread over many tasks."""
    rows = [("en", "a", None, None, 900)] + [("en", "a", f"w{i:03}", None, i + 10) for i in range(90)] + [
        ("en", "a", f"w{i:03}", f"v{j}", j + 1) for i in range(90) for j in range(5)]
    stream = spark.createDataFrame(rows, "lang string, w1 string, w2 string, w3 string, f long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        told = collocations.with_heads(stream, collocations.WORDS, "one", "two").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(told) == 540 and {r.one for r in told} == {900}
    assert all(r.two == int(r.w2[1:]) + 10 for r in told if r.w3)


PRIVATE = ["write to ann.b@mail.example.com now", "call +1 (555) 123-4567 today", "host 10.0.0.1.", "pay 4111111111111111 now",
           "4111111111111111 5500005555555559 both", "a@b", "@", "1.2.3.400", "+12345", "1" * 30, "x@y.z@w.v", "é +49 30 1234567890",
           "1.2.3.4.5.6.7.8", "4111-1111-1111-1111", "+" * 500, "1." * 3000, "a" * 20000 + "@b.c", None, ""]


def brute_private(text):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[1])))


def check_digit(digits):
    return next(digits + c for c in "0123456789" if pii.luhn(digits + c))


@pytest.fixture(scope="module")
def private(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abdegiklmnorstu"), 5))
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(PRIVATE)]
    for i in range(400):
        some = [f"{word()}.{word()}@{word()}.com", f"+{number(2)} ({number(3)}) {number(3)}-{number(4)}", check_digit(number(15)),
                ".".join(map(str, rng.integers(1, 255, 4))), f"{number(3)}", f"{number(4)}-{number(2)}", f"{number(6)}.{number(1)}"]
        text = [word() for _ in range(20)]
        text[int(rng.integers(20))] = some[i % 7]
        rows.append((100 + i, " ".join(text), "en", "s", 1))
    return rows, spark.createDataFrame(rows, SCHEMA).withColumn("spans", F.lit("x")).withColumn("hash", F.lit(1))


def test_private_base_spans_match_brute_force(private):
    rows, docs = private
    told = {r.doc_id: r for r in pii.digest(pii.personal_spans(docs, None)).collect()}
    for d, text, *_ in rows:
        base = brute_private(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert told[d].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and told[d].spans == joined, text
        assert [told[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in base) for k in pii.KINDS]


def test_private_candidates_are_learned_and_calibrated(spark, private):
    rows, docs = private
    model = pii.trained(docs)
    two = f"see {check_digit('482917365082914')} {check_digit('715938260471853')} there"
    found = pii.added(two, pii.base_spans(two), model)
    assert [(a, b) for a, _, b, _ in sorted(found)] == [(4, 20), (21, 37)]
    clean = [" ".join(f"{k}{i}" for k in ("ab", "cd", "ef")) + f" in 19{i:02} at page {i * 37} of {i}.5 and 2020-01-{i:02}" for i in range(10, 30)]
    assert not any(pii.added(t, pii.base_spans(t), model) for t in clean)
    told = {r.doc_id: r.text for r in pii.redacted(docs, model).collect()}
    assert told[0] == "write to <EMAIL> now" and told[17] is None and told[2] == "host <IP>."
    assert pii.redacted(docs, model).columns == docs.columns
    base = {r.doc_id: r.base_sha256 for r in pii.digest(pii.personal_spans(docs, None)).collect()}
    assert all(base[r.doc_id] == r.base_sha256 for r in pii.digest(pii.personal_spans(docs, model)).collect())
    assert pii.trained(docs.limit(0)) is None and pii.trained(docs.filter("doc_id = 5")) is None
    assert pii.digest(pii.personal_spans(docs.limit(0), model)).count() == 0


def test_boosted_trees_learn_what_no_line_can():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = boosting.BoostedTrees().fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0) == y[3000:]).mean() > 0.95


def test_private_model_is_fitted_on_every_proposal(private):
    """All examples of every text are counted, and sums over Spark give the trees of the rows in memory."""
    rows, docs = private
    crowded = " ".join(f"+{i} (555) 123-4567," for i in range(10, 60))
    docs = docs.union(docs.limit(1).select(F.lit(999).cast(docs.schema[0].dataType).alias("doc_id"), F.lit(crowded).alias("text"),
                                           *[F.col(c) for c in docs.columns[2:]]))
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    every = [(row, label, hashes[d] % 3 == 0) for d, text, *_ in [*rows, (999, crowded)]
             for row, label in pii.examples(text or "", hashes[d] & 0xFFFFFFFF)]
    told = pii.counted_examples(docs).collect()
    expected = collections.Counter((bytes(min(int(v), pii.TOP) for v in row), label, held) for row, label, held in every)
    assert {(bytes(r.x), r.y, r.held): r.n for r in told} == expected
    x = np.array([[min(int(v), pii.TOP) for v in row] for row, _, held in every if not held], dtype=float)
    y = np.array([label for _, label, held in every if not held])
    model, alone = pii.trained(docs, few=0), boosting.BoostedTrees().fit(x, y)
    assert (pii.trained(docs).trees.values == model.trees.values).all()
    assert all((a == b).all() for a, b in zip(model.trees.edges, alone.edges))
    assert (model.trees.cuts == alone.cuts).all() and np.allclose(model.trees.values, alone.values)
