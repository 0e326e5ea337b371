from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ctxlake.llm import dedup, knn, language, lookalike, mixing, ocr, queries, runs, split, sql, tokenizer
from tests.oracle import compare

WORDS = ["pump", "index", "river", "stone", "cloud", "paper", "light", "north", "queue", "table", "glass", "money", "bread", "train", "water", "plant"]


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, queries.queries()[name], sql.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql())))
def test_query_runs(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    assert df.count() > 0


# ---------------------------------------------------------------- 1


def prose(rng, n):
    return [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]


def test_near_pairs_equal_brute_force(spark):
    rng, texts = random.Random(4), []
    for i in range(60):
        base = prose(rng, rng.randrange(30, 120))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            w = list(base)
            for _ in range(rng.randrange(1, 9)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    texts += [texts[0]] * 3 + [None, "", "too short", texts[5].upper()]
    df = spark.createDataFrame([(i, 0, t, "x") for i, t in enumerate(texts)], "gid long, part int, text string, print string")
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= 20:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 2 >= len(sets[a] | sets[b])}
    assert {tuple(r) for r in dedup.near_pairs(df, 3, 20, 0.5).collect()} == want
    # The same with every band taken for a large one, in blocks of a few records.
    assert {tuple(r) for r in dedup.near_pairs(df, 3, 20, 0.5, sample_of=1, many=1, block=2).collect()} == want


def test_hot_band(spark):
    """A cluster of many different variants goes through blocks, with production parameters, and loses no pair."""
    rng = random.Random(12)
    base = prose(rng, 120)
    texts = []
    for i in range(500):
        w = list(base)
        w[i % 120] = f"x{i}"
        texts.append(" ".join(w))
    texts += [" ".join(prose(rng, 60)) for _ in range(100)]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "gid long, part int, text string")
    pairs = dedup.near_pairs(df, 3, 20, 0.5)
    assert pairs.count() == pairs.distinct().count() == 500 * 499 // 2 and pairs.agg(F.max("b")).first()[0] == 499


def test_groups_with_the_parameters_of_the_pairs(spark, sf):
    """p1_groups gives the membership behind p1_found: every pair is in one group, and every group of several is held together by pairs."""
    groups = {(r.item_kind, r.item_id): r.group_id for r in queries.p1_groups(spark, sf).collect()}
    pairs = [tuple(r) for r in queries.p1_found(spark, sf).collect()]
    assert pairs and all(groups[k, a] == groups[k, b] for k, a, b in pairs)
    paired = {(k, x) for k, a, b in pairs for x in (a, b)}
    sizes = Counter((k, g) for (k, _), g in groups.items())
    assert all((sizes[k, g] > 1) == ((k, i) in paired) for (k, i), g in groups.items())


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000 + i, 5000) for i in range(300)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.group_id for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_classes_are_written_out(spark):
    """Texts with the same shingles but other case and white space, more than 141 of them, and a class near to them."""
    rng = random.Random(6)
    one = prose(rng, 60)
    other = [*one[:50], *prose(rng, 10)]
    texts = [(" " * (1 + i % 3)).join(w.upper() if j == i // 3 else w for j, w in enumerate(one)) for i in range(160)]
    texts += [(" " * (1 + i % 2)).join(w.upper() if j == i // 2 else w for j, w in enumerate(other)) for i in range(80)] + [texts[3]] * 3
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "gid long, part int, text string")
    got = [tuple(r) for r in dedup.near_pairs(df, 3, 20, 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))}


def test_near_pairs_keep_parts_apart_and_take_nothing(spark):
    t = " ".join(prose(random.Random(1), 40))
    assert dedup.near_pairs(spark.createDataFrame([(1, 0, t), (2, 1, t)], "gid long, part int, text string")).count() == 0
    assert dedup.near_pairs(spark.createDataFrame([], "gid long, part int, text string")).count() == 0


def test_estimate_is_near_truth():
    rng = np.random.default_rng(0)
    for j in (0.3, 0.5, 0.8):
        n = 2000
        both = int(2 * n * j / (1 + j))
        h = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = h[:n], np.concatenate([h[:both], h[n : 2 * n - both]])
        r = dedup.registers(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        assert abs(dedup.estimate(r[:1], r[1:], np.array([n]), np.array([n]))[0] - j) < 0.12


# ---------------------------------------------------------------- 2


@pytest.mark.parametrize("n,most", [(500, 2002), (501, 2005), (1, 5)])
def test_limit(n, most):
    assert split.limit_chars(n) == most and round(most / 4) <= n < round((most + 1) / 4)


def test_range_maximum_equals_brute_force():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 7, 500).astype(np.int8)
    table = split.RangeMax(s, 200)
    for _ in range(500):
        lo = int(rng.integers(0, 499))
        hi = int(rng.integers(lo + 1, min(500, lo + 200) + 1))
        assert table.best(lo, hi) == max(range(lo, hi), key=lambda i: (s[i], i))


def test_pieces():
    rng = random.Random(3)
    texts = ["x" * 9000, "é" * 3000, " ".join(prose(rng, 900)), ". ".join(" ".join(prose(rng, 9)) for _ in range(300)), "a\n\n" * 3000, "word " * 200_000]
    for t in texts:
        t = t.strip()
        ps = split.pieces(t, 500, 50)
        assert ps[0][0] == 0 and ps[-1][1] == len(t)
        for (a, b), (c, d) in zip(ps, ps[1:]):
            assert a < c <= b < d and b - c <= 200
            assert not unicodedata.combining(t[b])
        assert all(round(len(t[a:b].strip()) / 4) <= 500 for a, b in ps)
    t = ("One sentence here. " * 150).strip()
    assert all(t[a:b].rstrip().endswith(".") for a, b in split.pieces(t, 500, 50))


def test_windows_wider_than_a_block_and_early_boundaries():
    t = "word " * 200_000
    ps = split.pieces(t.strip(), 70_000, 50)
    assert ps[-1][1] == len(t) - 1 and all(t[b - 1] == " " for _, b in ps[:-1])
    # Nothing but a long number in the second half of the window: it goes whole into the next piece.
    t = "Some words here. More of them follow now. " * 10 + "f" * 1900
    first, second, *_ = split.pieces(t, 500, 0)
    assert t[first[1] :] == "f" * 1900 and second == (first[1], len(t))
    assert split.pieces("ab cd " * 40, 10, 50)[-1][1] == 240


def test_split_rows(spark):
    rows = [(1, None), (2, ""), (3, " " * 5000), (4, " " + "w " * 1000 + "w "), (5, "w " * 2000), (5, "w " * 2000), (6, "a" * 2002), (7, "a" * 2003)]
    df = spark.createDataFrame(rows, "chunk_id long, text string").withColumn("piece_index", F.lit("clash")).withColumn("id", F.lit(0))
    out = split.split_oversized(df)
    got = Counter(r.chunk_id for r in out.where("piece_index = 0").collect())
    assert got == {5: 2, 7: 1}
    assert out.where("piece_tokens > 500").count() == 0
    assert split.split_oversized(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 3


def runs_by_definition(rows, gap, least=1.0):
    once = {}
    for s, ts, q, b in rows:
        k = re.sub(r"[^a-z]", "", (b or "").lower())
        if s is not None and k and q is not None and ts is not None:
            once[q] = min(once.get(q, (ts, s, k)), (ts, s, k))
    out, run = [], None
    for s, ts, q, k in sorted((s, ts, q, k) for q, (ts, s, k) in once.items()):
        if run and run[0] == s and ts - run[4] <= gap and runs.similarity(run[1], k) >= least:
            run[3], run[4], run[5] = q, ts, run[5] + 1
        else:
            run = [s, k, q, q, ts, 1]
            out.append(run)
    return {(r[0], r[1], r[2], r[3], r[5]) for r in out}


@pytest.mark.parametrize("seed,least", [(1, 1.0), (2, 1.0), (3, 0.6), (4, 0.6)])
def test_runs_equal_definition(spark, seed, least):
    rng, t, rows = random.Random(seed), 0, []
    for q in range(3000):
        t += rng.choice([0, 1, 30, 700]) if rng.random() < 0.3 else rng.choice([0, 5])
        rows.append((rng.choice(["hot"] * 8 + ["a", "b", None]), t, q, rng.choice(["read"] * 6 + ["Read ", "edit", "edits", "bash_test", None, "--"])))
    rows += rows[:40]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id string, t long, seq long, bucket string").withColumn("ts", F.timestamp_seconds("t")).withColumn("key", F.lit(1))
    got = {(r.session_id, r.bucket, r.first_seq, r.last_seq, r.n_events) for r in runs.collapse_runs(df, min_similarity=least).collect()}
    assert got == runs_by_definition([(s, t, q, b) for s, t, q, b in rows], 600, least)


def test_doubt_about_an_anchor_ends_in_a_slice():
    """A long session without gaps leaves few rows to the second pass, though similar events join runs."""
    rng = random.Random(2)
    keys = [rng.choice(["read", "reads", "edit", "edits", "bashtest", "grep"]) for _ in range(20_000)]
    batch = pa.RecordBatch.from_pydict({"session_id": ["s"] * len(keys), "key": keys, "us": list(range(len(keys))), "seq": list(range(len(keys)))})
    out = [r for b in runs._first_pass(10**9, 0.6, frozenset(keys))(iter([batch])) for r in b.to_pylist()]
    assert sum(r["edge"] > 0 for r in out) < 60 and sum(r["n_events"] for r in out) == len(keys)


def test_runs_of_nothing(spark):
    df = spark.createDataFrame([(None, 1, "a")], "session_id string, seq long, bucket string").withColumn("ts", F.lit(None).cast("timestamp"))
    assert runs.collapse_runs(df).count() == 0 and runs.collapse_runs(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 4

LEX = {"en": "the index of the library shows one narrow table under normal load", "de": "der bericht beschreibt die lieferung unter normaler last", "fr": "le livre contient la page selon les notes"}


def _words(spark):
    return spark.createDataFrame([(g, w, 100 + i) for g, t in LEX.items() for i, w in enumerate(t.split())], "lang string, word string, freq long")


def test_languages(spark):
    en, de, fr = ((LEX[k].capitalize() + ". ") for k in ("en", "de", "fr"))
    items = [("p", 1, en * 3), ("p", 2, de * 3), ("p", 3, en * 4 + de * 4), ("p", 4, en * 4 + fr), ("p", 5, None), ("p", 6, ""), ("p", 7, "0f3a9b 77aa01\n| 1 | 2 |"), ("p", 8, en * 3), ("p", 8, en * 3), ("p", 9, de * 3000)]
    labels = [("p", 1, "en-GB", 1), ("p", 2, "English", 1), ("p", 3, "en", 1), ("p", 4, "eng", 1), ("p", 5, "en", 1), ("p", 8, "xx", 2), ("p", 8, "en", 1), ("p", 9, "de", 1), ("p", 9, "German", 1)]
    df = spark.createDataFrame(items, "item_kind string, item_id long, text string").withColumn("label", F.lit("clash")).withColumn("segments", F.lit(0))
    lb = spark.createDataFrame(labels, "item_kind string, item_id long, lang string, labelled_at long")
    got = {(r.item_id, r.lang) for r in language.mislabelled(df, _words(spark), lb).collect()}
    assert got == {(2, "de"), (3, "en"), (3, "de"), (8, "en")}
    assert language.languages(df.limit(0), _words(spark), lb).count() == 0
    assert language.languages(df, _words(spark).limit(0), lb).count() == 0


@pytest.mark.parametrize("label,code", [("EN", "en"), ("de-AT", "de"), ("fra", "fr"), ("Russian", "ru"), ("und", None), ("", None), (None, None), ("??", None), ("nl_BE", "nl")])
def test_label_codes(spark, label, code):
    assert spark.range(1).select(language.label_code(F.lit(label).cast("string")).alias("c")).first().c == code


def test_held_out_words_by_ngrams():
    m = language.Model([(g, w, 100.0) for g, t in {"en": "reading writing walking talking singing", "de": "lesung schreibung haltung deckung leistung"}.items() for w in t.split()])
    assert m.langs[int(m.score("jumping").argmax())] == "en" and m.langs[int(m.score("wertung").argmax())] == "de"


def test_unseen_words_and_short_sentences(spark, sf):
    words = spark.read.parquet(f"{sf}/word_list.parquet")
    unseen = {1: ("en", "Photosynthesis converts sunlight into chemical energy."), 2: ("de", "Wissenschaftler untersuchten mikroskopische Organismen gründlich."), 3: ("es", "Los investigadores analizaron distintos fenómenos atmosféricos."),
              4: ("it", "Gli scienziati studiarono parecchi fenomeni atmosferici."), 5: ("nl", "Onderzoekers bestudeerden verschillende verschijnselen."), 6: ("ru", "Учёные исследовали различные явления природы."), 7: ("en", "Where are they?")}
    rows = [("p", i, t) for i, (_, t) in unseen.items()] + [("p", 20, "| a | to |\n| in | 12 |"), ("p", 21, "0f3a9b77aa01 9c9c"), ("p", 22, "12 34")]
    got = {r.item_id: r for r in language.segments(spark.createDataFrame(rows, "item_kind string, item_id long, text string"), words).collect()}
    assert {i: [s.lang for s in r.segments] for i, r in got.items()} == {i: [g] for i, (g, _) in unseen.items()} | {20: [], 21: [], 22: []}
    assert all(0.2 < got[i].segments[0].confidence < 1 for i in unseen)


def test_places_of_segments(spark, sf):
    """A stretch of unseen words within known ones is found by n-grams; every segment can be cut out by its place."""
    words = spark.read.parquet(f"{sf}/word_list.parquet")
    known = {r.lang: r.w for r in words.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list("word")), 1, 60).alias("w")).collect()}
    en = " ".join(" ".join(known["en"][i : i + 8]).capitalize() + "." for i in range(0, 40, 8))
    de = "Wissenschaftler untersuchten mikroskopische Organismen gründlich. Verschiedene Forschungseinrichtungen veröffentlichten umfangreiche Untersuchungsergebnisse."
    text = f"{en} {de} {en}"
    (r,) = language.segments(spark.createDataFrame([("p", 1, text)], "item_kind string, item_id long, text string"), words).collect()
    assert [s.lang for s in r.segments] == ["en", "de", "en"] and [text[s.begin : s.end] for s in r.segments] == [en, de, en]


# ---------------------------------------------------------------- 5


def test_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    x = np.concatenate([x, x[:150] + 0.15 * rng.standard_normal((150, 16)).astype(np.float32), x[:20]])
    rows = [(i, "m", [float(a) for a in v * rng.uniform(0.1, 9)]) for i, v in enumerate(x)]
    rows += [(2000, "m", None), (2001, "m", []), (2002, "m", [0.0] * 16), (2003, "m", [1.0] * 4), (2004, "m", [None] + [1.0] * 15), (2005, None, [1.0] * 16), (2006, "n", rows[0][2]), (2007, "m", [float("nan")] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "chunk_id long, model string, vector array<float>").withColumn("v", F.lit(1)).withColumn("near", F.lit(1))
    y = np.array([r[2] for r in rows[: len(x)]], np.float32).astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -2)
    want = {(min(i, j), max(i, j)) for i in range(len(s)) for j in sorted(range(len(s)), key=lambda j: (-round(s[i, j], 9), j))[:5] if s[i, j] >= 0.9}
    got = {tuple(r) for r in knn.near_pairs(df, list_size=64, probes=6, block=50).collect()}
    assert not got - want and len(got) >= 0.97 * len(want)
    near = {(r.id, r.other) for r in knn.neighbours(df, k=5, query_every=20, list_size=64, probes=1000).collect() if r.id < 2000}
    true = {(i, int(j)) for i in range(0, len(s), 20) for j in sorted(range(len(s)), key=lambda j: (-round(s[i, j], 9), j))[:5]}
    assert len(near & true) >= 0.97 * len(true)


def test_no_pair_is_lost_among_many_lists(spark):
    """Pairs just above the least cosine, whose members lie in different lists; one list far larger than the others."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 32))
    x[2500:] = x[0] + 0.3 * rng.standard_normal((500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal((1500, 32))
    away -= (away * x[:1500]).sum(1, keepdims=True) * x[:1500]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 0.93, (1500, 1))
    x = np.concatenate([x, cos * x[:1500] + np.sqrt(1 - cos**2) * away]).astype(np.float32)
    df = spark.createDataFrame([(i, "m", v.tolist()) for i, v in enumerate(x)], "chunk_id long, model string, vector array<float>")
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, 1, kind="stable")[:, :5]
    want = {(min(i, j), max(i, j)) for i in range(len(s)) for j in top[i].tolist() if s[i, j] >= 0.9}
    for how in ({}, {"block": 4}):
        assert {tuple(r) for r in knn.near_pairs(df, list_size=8, **how).collect()} == want


def test_long_lists_are_cut_up_without_loss(spark, monkeypatch):
    """Few shared centroids and many vectors in clusters: units fit lists of their own, no pair is lost and most comparisons are saved."""
    monkeypatch.setattr(knn, "LOCAL_SIZE", 40)
    rng = np.random.default_rng(8)
    heads = rng.standard_normal((60, 24))
    x = (heads[rng.integers(0, 60, 3000)] + 0.35 * rng.standard_normal((3000, 24))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = knn.fit_centroids(x, 4)
    seen = []
    real = knn.scan
    monkeypatch.setattr(knn, "scan", lambda q, b, *a: (seen.append(len(q) * len(b)), real(q, b, *a))[1])
    own = (x @ c.T).argmax(1)
    row = lambda role: pa.RecordBatch.from_arrays([pa.array(["m"] * 3000), *(pa.array([0] * 3000, pa.int32()) for _ in range(3)), pa.array([role] * 3000, pa.int32()), pa.array(own.astype(np.int32)), pa.array(np.arange(3000)), pa.array([v.tobytes() for v in x], pa.binary())], names=["model", "group", "block", "slice", "role", "list", "id", "v"])
    got = {}
    for b in knn._every(5, 0.9, {"m": c}, 8)(iter([row(0), row(1)])):
        for r in b.to_pylist():
            got.setdefault(r["q"], []).append((round(-r["cosine"], 4), r["o"]))
    sim = x @ x.T
    np.fill_diagonal(sim, -1)
    want = {i: sorted((round(-float(sim[i, j]), 4), j) for j in np.flatnonzero(sim[i] >= 0.9))[:5] for i in range(3000)}
    assert got.keys() == {i for i, w in want.items() if w}
    assert all(np.allclose([c for c, _ in sorted(g)], [c for c, _ in want[i]], atol=3e-4) for i, g in got.items())
    assert sum(seen) < 3000 * 3000 / 4


def test_hot_copies_of_a_vector(spark):
    df = spark.createDataFrame([(i, "m", [1.0, 2.0, 3.0]) for i in range(200)] + [(500 + i, "m", [1.0, 2.0, 3.1 + i]) for i in range(3)], "chunk_id long, model string, vector array<float>")
    n = knn.neighbours(df, k=3)
    assert n.where("id < 200").count() == 600 and n.where("id < 200").agg(F.max("other")).first()[0] == 3
    assert knn.neighbours(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 6


LEXICON = WORDS + """lantern meadow harbour kitchen ledger folder docket window scanner tunnel valve engine report permit budget closed loaded tested
stored copied sorted listed merged needed filled posted lowest oldest modest forest molten golden sudden hollow follow mellow yellow castle bottle settle kettle""".split()


def _clean(rng, n=14):
    return " ".join(rng.choice(["Northern", "Quiet", "Heavy"]) + " " + " ".join(rng.choice(LEXICON) for _ in range(7)) + "." for _ in range(n))


def _scans(spark):
    rng = random.Random(8)
    trusted = [(f"t{i}", _clean(rng)) for i in range(60)]
    confuse = {"e": "c", "o": "0", "l": "1", "s": "5", "t": "f"}

    def noisy(t, k):
        w = t.split(" ")
        for i in rng.sample(range(len(w)), k):
            for a, b in confuse.items():
                if a in w[i][1:]:
                    w[i] = w[i][0] + w[i][1:].replace(a, b, 1)
                    break
        return " ".join(w)

    items = [("page", i, f"d{i // 4}", noisy(_clean(rng), 30)) for i in range(40)] + [("page", 100 + i, f"c{i // 4}", f"Acme Works · internal paper · rev 7\n\n{_clean(rng)}\n\n- {i + 3} -") for i in range(12)]
    items += [("page", 200, "x", None), ("page", 201, "x", ""), ("page", 202, None, "  \n"), ("page", 203, "x", "The quiet riv-\ner and the pump."), ("page", 204, "x", _clean(rng) + "\n\nprice  73\n134\ncount  26.47"), ("page", 205, "x", "stone " * 60_000)]
    return spark.createDataFrame(items, "item_kind string, item_id long, key string, text string").withColumn("line", F.lit(1)), spark.createDataFrame(trusted, "key string, text string")


def test_damage(spark):
    items, trusted = _scans(spark)
    got = {}
    for r in ocr.damage(items, trusted).collect():
        got.setdefault(r.item_id, set()).add(r.defect)
    assert sum("misread" in got.get(i, ()) for i in range(40)) >= 38
    assert all(got[100 + i] == {"running_line", "page_number"} for i in range(12))
    assert got[203] == {"broken_word"} and not {200, 201, 202, 204, 205} & got.keys()
    assert ocr.damage(items.limit(0), trusted).count() == 0
    assert "misread" not in {r.defect for r in ocr.damage(items, trusted.limit(0)).collect()}


def test_repair(spark):
    items, trusted = _scans(spark)
    out = {r.item_id: r.text for r in ocr.repair(items, trusted).collect()}
    assert "Acme" not in out[100] and not re.search(r"- \d+ -", out[100]) and out[203] == "The quiet river and the pump."
    assert out[200] is None and out[201] == "" and "\n" not in out[0]
    words = set(LEXICON) | {"northern", "quiet", "heavy"}
    left = [w for i in range(40) for w in re.findall(r"[^\W_]+", out[i].lower()) if w not in words]
    assert len(left) < 0.15 * 40 * 30, Counter(left).most_common(30)


def test_marks_at_line_ends():
    known = {w: 9 for w in "a well known state of the art river long standing plan over look overlook pre war".split()} | {"pre-war": 9}
    rng = random.Random(3)
    reader = ocr.Reader(known, ocr.Editor.train(ocr.examples_from(Counter(), Counter(), {w: rng.randint(5, 99) for w in LEXICON})))
    for before, after, has in [
        ("a well-\nknown plan", "a well-known\nplan", False),
        ("state-\nof-the-art", "state-of-the-art\n", False),
        ("pre-\nwar", "pre-war\n", False),
        ("the riv-\ner plan", "the river\nplan", True),
        ("over-\nlook a", "overlook\na", True),
        ("long\xad\nstanding", "longstanding\n", True),
        ("stand¬  \ning, then", "standing,\nthen", True),
        ("12-\n13", "12-\n13", False),
    ]:
        assert reader.joined(before) == (after, has)
    found = reader.tokens("a ri ver of the plan")
    assert [w for _, _, w in found] == ["ri ver", "ver"] or {w for _, _, w in found} == {"ri ver", "ver"}


def test_signs_inside_names():
    grams = frozenset(f"^{w}$"[i : i + 3] for w in ["wextam", "sansan", "torin"] for i in range(len(w)))
    reader = ocr.Reader({"the": 9}, ocr.Editor(["", "-"], np.zeros((ocr.ROWS, 2)), {}), grams)
    words = {"^wext@m": "wextam", "san~san": "sansan", "tor|in": "torin", "x@y": "", "qq@zz": "", "wextam": "", "wex@tam@x": ""}
    reader.correct(set(words))
    assert {w: reader.memo[w] for w in words} == words


def test_running_lines_of_two_rows_and_any_form(spark):
    rng = random.Random(5)
    head = lambda i: f"Annual survey of the northern harbour\nPrepared for the council, second edition.\n\n{_clean(rng)}\n\nSurvey\n\n| {i} |"
    items = [("page", i, "d", head(i)) for i in range(5)] + [("page", 10 + i, "e", _clean(rng)) for i in range(5)]
    items += [("chunk", i, "f", "Same passage here\n" + "Same text below it, all of it.") for i in range(4)]
    df = spark.createDataFrame(items, "item_kind string, item_id long, key string, text string")
    trusted = spark.createDataFrame([(f"t{i}", _clean(rng)) for i in range(60)], "key string, text string")
    got = {}
    for r in ocr.damage(df, trusted).collect():
        got.setdefault((r.item_kind, r.item_id), set()).add(r.defect)
    assert all(got.get(("page", i)) == {"running_line", "page_number"} for i in range(5)) and len(got) == 5
    out = {r.item_id: r.text for r in ocr.repair(df.where("item_kind = 'page'"), trusted).collect()}
    assert not any(w in out[i] for i in range(5) for w in ("Annual", "Prepared", "Survey", "|"))


def test_signatures_find_two_misread_words():
    a = ocr.signatures("the annual survey of every harbour and of every river in the northern half".split())
    b = ocr.signatures("the annua1 survey of every harb0ur and of every river in the northern half".split())
    assert len(set(a) & set(b)) == 1
    assert len(set(ocr.signatures(["one", "two", "three"])) & set(ocr.signatures(["one", "twc", "three"]))) == 1


@pytest.mark.parametrize("line,is_number", [("12", True), ("- 12 -", True), ("[7]", True), ("Page 3 / 90", True), ("Seite 4", True), ("стр. 9", True), ("Pagc 12", True), ("xiv", True), ("— 5", True), ("12/40", True), ("recipe  73", False), ("v1.2.3", False), ("#4421", False), ("mix", False), ("", False), ("a 12", False)])
def test_page_numbers(line, is_number):
    assert ocr.page_number(line) is is_number


@pytest.mark.parametrize("noisy,true,ops", [("tbe", "the", ["", "=h", ""]), ("clay", "day", ["-", "=d", "", ""]), ("mdex", "index", ["=in", "", "", ""]), ("b.ig", "big", ["", "-", "", ""])])
def test_align(noisy, true, ops):
    got = ocr.align(noisy, true)
    assert got == ops
    write = {"": lambda c: c, "-": lambda c: ""}
    assert "".join(write[o](c) if o in write else o[1:] if o[0] == "=" else c + o[1:] for c, o in zip(noisy, got)) == true


# ---------------------------------------------------------------- 7


def test_ids_equal_public_library(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(6)
    texts = [None, "", " ", "\n\n \t", "<|endoftext|>", "it's  a test x", "日本語 текст نص 🙂🇳🇴", "a" * 3000, "=" * 500 + " " * 300, "x y\x1cz", "don't DON'T we'll"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1200), rng.randrange(0x4E00, 0x4F00), 10, 32, 32])) for _ in range(rng.randrange(1, 400))) for _ in range(150)]
    texts += texts[:20]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokenizer.encode(df).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in tokenizer.count_tokens(df).collect()} == {i: len(x) for i, x in got.items()}
    assert tokenizer.encode(df.limit(0)).count() == 0


def test_vocabulary_is_shipped(spark, tmp_path):
    import shutil

    away = tmp_path / "shipped_bpe.tiktoken"
    shutil.copy(tokenizer.vocabulary_path(), away)
    spark.sparkContext.addFile(str(away))
    df = spark.createDataFrame([(1, "the pump"), (2, None)], "doc_id long, text string")
    same = {tuple(map(str, r)) for r in tokenizer.encode(df).collect()}
    assert {tuple(map(str, r)) for r in tokenizer.encode(df, path="/nowhere/shipped_bpe.tiktoken").collect()} == same
    assert tokenizer.ship(df, tokenizer.vocabulary_path()) == tokenizer.vocabulary_path()


def test_trie_walk_survives_a_small_memo(monkeypatch):
    b = tokenizer.TrieBPE(tokenizer.vocabulary_path())
    want = b.encode_batch(["one two three four five six"])
    monkeypatch.setattr(tokenizer, "MEMO_WORDS", 3)
    b.memo = {}
    assert b.encode_batch(["one two", " three four five six"]) == [want[0][:2], want[0][2:]]


# ---------------------------------------------------------------- 8


def _mix(spark):
    rng = random.Random(9)
    docs = [(i, rng.choice(["web"] * 6 + ["code"] * 3 + ["notes"]), rng.randrange(5, 200)) for i in range(900)]
    t = spark.createDataFrame([("web", 0.5, 1), ("code", 0.2, 2), ("notes", 0.3, 2), ("none", 0.05, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    return docs, spark.createDataFrame(docs, "doc_id long, source string, n_tokens long"), t


def test_mix_equals_definition(spark):
    docs, df, t = _mix(spark)
    total = sum(d[2] for d in docs)
    got = {r.doc_id: r for r in mixing.mix(df, t).collect()}
    for s, share, most in (("web", 0.5, 1), ("code", 0.2, 2), ("notes", 0.3, 2)):
        own = [d for d in docs if d[1] == s]
        supply = sum(d[2] for d in own)
        grant = min(share * total, most * supply)
        used = sum(got[d[0]].n_tokens * got[d[0]].repeats for d in own if d[0] in got)
        assert grant - 1e-6 <= used < grant + 200 and max((got[d[0]].repeats for d in own if d[0] in got), default=0) <= most
        ats = sorted((got[d[0]]["at"], d[2]) for d in own if d[0] in got)
        assert all(a + n == b for (a, n), (b, _) in zip(ats, ats[1:]))
    rep = {r.source: r for r in mixing.shares(df, t).collect()}
    assert rep["none"].short and rep["none"].used_docs == 0 and rep["notes"].short and not rep["code"].short
    assert abs(sum(r.reached_share for r in rep.values()) - 1) < 1e-4


def test_curriculum(spark):
    docs, df, t = _mix(spark)
    c = mixing.curriculum(df, t).collect()
    pos = [r.position for r in c]
    assert pos == sorted(pos) and 0 <= pos[0] and pos[-1] <= 1
    half = lambda s: sum(r.n_tokens for r in c if r.source == s and r.position < 0.5) / sum(r.n_tokens for r in c if r.source == s)
    assert abs(half("web") - 0.6) < 0.03 and abs(half("code") - 0.4) < 0.06
    flat = spark.createDataFrame([(s, [(0.0, 1.0), (0.5, 1.0), (1.0, 1.0)]) for s in ("web", "code", "notes")], "source string, knots array<struct<t:double,w:double>>")
    c = mixing.curriculum(df, t, schedule=flat).collect()
    assert abs(sum(r.n_tokens for r in c if r.source == "web" and r.position < 0.5) / sum(r.n_tokens for r in c if r.source == "web") - 0.5) < 0.02


def test_mix_in_order_of_first_use(spark, sf):
    rows = queries.p8_mix(spark, sf).collect()
    uses = queries.p8_order(spark, sf).collect()
    first = {}
    for u in uses:
        first.setdefault(u.doc_id, u.position)
    assert [r.position for r in rows] == sorted(r.position for r in rows) and {r.doc_id: r.position for r in rows} == first
    assert Counter(u.doc_id for u in uses) == {r.doc_id: r.repeats for r in rows}
    assert {r.source: r.used_tokens for r in queries.p8_shares(spark, sf).collect() if r.used_tokens} == dict(sum((Counter({u.source: u.n_tokens}) for u in uses), Counter()))


def test_first_query_of_the_mix_gives_positions():
    assert next(n for n in queries.queries() if n.startswith("p8_")) == "p8_order"


def test_mix_of_dirty_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "web", "one two"), (2, None, "x"), (3, "web", None), (4, "web", ""), (5, "other", "z"), (1, "web", "one two")], "doc_id long, source string, text string").withColumn("n_tokens", F.lit(7))
    t = spark.createDataFrame([("web", 1.0, None), ("web", None, 3)], "source string, target_share double, max_repeats int")
    s = mixing.sized(docs)
    assert [(r.doc_id, r.repeats) for r in mixing.mix(s, t).collect()] == [(1, 1), (1, 1)]
    assert mixing.mix(mixing.sized(docs.limit(0)), t).count() == 0 and mixing.shares(mixing.sized(docs.limit(0)), t).count() == 1
    assert mixing.mix(s, t.limit(0)).count() == 0


# ---------------------------------------------------------------- 9

SAME = ["Café fish A-B", "Café ﬁsh A‑B", "Ｃafé fish A-B", "Саfé fi​sh А‐B", "C­afé ﬁsh Α-Β"]
OTHER = ["Cafe fish A-B", "café fish A-B", "Café fish A-B²", "Café fish A-B2", "Café  fish A-B"]


def test_lookalikes(spark):
    rows = [(i, t) for i, t in enumerate(SAME + OTHER)] + [(50, SAME[0]), (60, None), (61, ""), (62, "​ ⁠"), (63, " "), (64, "x" * 200_000), (65, "х" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit(1)).withColumn("class_id", F.lit(1))
    got = {tuple(r) for r in lookalike.lookalike_pairs(df).collect()}
    n = len(SAME)
    want = {(a, b) for a in range(n) for b in range(a + 1, n)} | {(i, 50) for i in range(1, n)} | {(64, 65)}
    assert got == want
    forms = {r.doc_id: (r.class_id, r.canonical) for r in lookalike.unify(df).collect()}
    assert {forms[i] for i in (*range(n), 50)} == {(0, SAME[0])} and len({forms[n + i] for i in range(len(OTHER))}) == len(OTHER)
    assert all(forms[i] == (None, None) for i in (60, 61, 62, 63)) and len(forms) == len(rows)
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0


def test_lookalikes_with_accents(spark):
    """Composed and decomposed spelling, and the Latin letter with the same accent; another accent is a difference."""
    letters = "".join(t[0] for t in (lookalike.CYRILLIC, lookalike.GREEK, lookalike.ARMENIAN))
    every = [c for c in map(chr, range(0x370, 0x2000)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0] in letters]
    assert {*"όΌΆΈΫўЎЌѐӓЁї"} <= set(every)
    texts = [f"{form} {i} word" for i, c in enumerate(every) for form in (c, unicodedata.normalize("NFD", c))]
    more = ["λόγος ὁ", unicodedata.normalize("NFD", "λόγος ὁ"), "Ά", "Á", "À", "А", "ў", "y̆", "y", "й", unicodedata.normalize("NFD", "й"), "и"]
    df = spark.createDataFrame(list(enumerate(texts + more)), "doc_id long, text string")
    n = len(texts)
    want = {(i, i + 1) for i in range(0, n, 2) if texts[i] != texts[i + 1]} | {(n + a, n + b) for a, b in ((0, 1), (2, 3), (6, 7), (9, 10))}
    assert {tuple(r) for r in lookalike.lookalike_pairs(df).collect()} == want
    forms = {r.doc_id: r.class_id for r in lookalike.unify(df).collect()}
    assert all(forms[a] == forms[b] for a, b in want) and len(set(forms.values())) == len(forms) - len(want)
