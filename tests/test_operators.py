from __future__ import annotations

import json
import random
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxlake.backends import Backends
from ctxlake.config import EngineConfig
from ctxlake.functions import text as T
from ctxlake.functions import tokens as K
from ctxlake.operators import activity, audit, boilerplate, chunking, compress, distill, pack, pages, retrieval, sessions, store


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("text,n", [("", 0), (None, 0), ("hi", 1), ("a" * 400, 100), ("a" * 10, 2), ("a" * 14, 4), ("é" * 6, 2)])
def test_text_tokens(spark, text, n):
    assert one(spark, T.text_tokens("t"), t=text) == n


@pytest.mark.parametrize("w,h,n", [(2880, 1800, 2049), (0, 5, 0), (-3, 4, 0), (800, 600, 640), (1, 1, 1), (1275, 1650, 2534)])
def test_image_tokens(spark, w, h, n):
    assert one(spark, K.image_tokens(F.col("w"), F.col("h")), w=w, h=h) == n


def test_page_cost_is_image_plus_text(spark):
    assert one(spark, K.page_host_tokens(F.lit(612), F.lit(792), F.col("t")), t="x" * 40) == 2534 + 10


def test_lines_and_space(spark):
    assert one(spark, T.split_lines("t"), t="a\r\nb\x0bc\n") == ["a", "b", "c"]
    assert one(spark, T.split_lines("t"), t="") == []
    assert one(spark, T.strip("t"), t=" \x1c x  ") == "x"


def test_cosine_of_odd_vectors(spark):
    c = lambda a, b: spark.sql(f"SELECT {a} AS a, {b} AS b").select(K.cosine(F.col("a"), F.col("b")).alias("x")).first().x
    assert c("array(1f, 0f)", "array(0f, 0f)") == 0
    assert abs(c("array(1f, 1f)", "array(2f, 2f)") - 1) < 1e-9


def test_otsu_of_two_peaks(spark):
    df = spark.createDataFrame([("a", 20)] * 50 + [("a", 230)] * 50 + [("b", 7)] * 3, "k string, v int")
    assert {r.k: r.threshold for r in pages.otsu(df, "k", "v").collect()} == {"a": 124, "b": 128}


def _pages(spark, rows):
    return spark.createDataFrame([(d, i, t) for d, ts in rows.items() for i, t in enumerate(ts)], "doc_key string, page_index int, text string")


def test_boilerplate(spark):
    ten = [f"head {i}\nbody {i}\nFooter" + ("\nmark" if i % 2 else "") for i in range(10)]
    df = _pages(spark, {"a": ten, "b": ["x\nFooter"] * 2, "c": ["y" * 500] * 5})
    assert [(r.doc_key, r.line, r.n_pages) for r in boilerplate.find(df).collect()] == [("a", "Footer", 10)]
    out = {(r.doc_key, r.page_index): r.text for r in boilerplate.strip_pages(df).collect()}
    assert out["a", 0] == "head 0\nbody 0" and out["b", 0] == "x\nFooter"
    assert [tuple(r) for r in boilerplate.manifest(df).collect()] == [("a", "Footer", 10)]


def words_by_definition(text, size, overlap):
    """The cut between words, written from its definition."""
    out, cur, n = [], [], 0
    for w in text.split():
        if cur and n + len(w) + 1 > size:
            out.append(" ".join(cur))
            keep, k = [], 0
            for p in reversed(cur):
                if not overlap or k + len(p) + 1 > overlap:
                    break
                keep, k = [p, *keep], k + len(p) + 1
            cur, n = keep, k
        cur.append(w)
        n += len(w) + 1
    return out + ([" ".join(cur)] if cur else [])


def test_word_cut_equals_definition():
    rng = random.Random(1)
    for _ in range(300):
        t = " ".join("x" * rng.choice([1, 2, 5, 9, 30]) for _ in range(rng.randrange(0, 120)))
        size, over = rng.choice([(40, 0), (40, 10), (80, 20), (20, 19)])
        assert chunking.cut_words(t, size, over) == words_by_definition(t, size, over)


def test_chunks(spark):
    df = spark.createDataFrame([(1, "short"), (2, None), (3, " \n\n "), (4, "a" * 1500 + "\n\n" + "b" * 600 + "\n\nc"), (5, "word " * 900)], "doc_id long, text string")
    out = {}
    for r in chunking.chunk(df).orderBy("doc_id", "chunk_index").collect():
        out.setdefault(r.doc_id, []).append(r.text)
    assert out[1] == ["short"] and 2 not in out and 3 not in out
    assert out[4] == ["a" * 1500, "a" * 200 + "\n\n" + "b" * 600 + "\n\nc"]
    assert len(out[5]) == 3 and all(len(t) <= 2202 for t in out[5])


def test_ranking(spark, tmp_path):
    docs = spark.createDataFrame([(1, "apples grow in a variety of climates"), (2, "a variety of trains run to the coast"), (3, "bread needs flour and water"), (4, None)], "doc long, text string")
    q = spark.createDataFrame([(1, "flour bread"), (2, "nothing here matches")], "q long, question string")
    index = retrieval.build(docs, "doc", str(tmp_path / "index"))
    top = retrieval.top_k(retrieval.normalised(retrieval.scores(index, q), q), index.lengths, q, 2)
    got = {(r.q, r["rank"]): (r.doc, r.score) for r in top.collect()}
    assert got[1, 1] == (3, 1.0) and got[2, 1] == (1, 0.0) and len(got) == 4
    again = retrieval.opened(spark, str(tmp_path / "index"))
    assert again.totals.first().n == 4 and {(r.doc, r.dl) for r in again.lengths.collect()} == {(1, 7), (2, 8), (3, 5), (4, 0)}
    assert {(r.term, r.f) for r in again.postings.where("doc = 2").collect()} == {("a", 1), ("variety", 1), ("of", 1), ("trains", 1), ("run", 1), ("to", 1), ("the", 1), ("coast", 1)}
    plan = retrieval.scores(index, q)._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan or "term IN" in plan or "term#" in plan and plan.count("Exchange hashpartitioning") <= 1
    assert retrieval.scores(index, q.limit(0)).count() == 0
    words = spark.createDataFrame([(1, "b a b\nB c"), (2, ""), (3, None)], "doc long, text string")
    assert {(r.doc, r.term, r.f) for r in retrieval.postings(words, "doc").collect()} == {(1, "a", 1), (1, "b", 3), (1, "c", 1)}


def test_blend_keeps_score_without_vector(spark):
    s = spark.createDataFrame([(1, 1, 0.8), (1, 2, 0.6)], "q long, doc long, score double")
    v = spark.createDataFrame([(1, "m", [1.0, 0.0]), (3, "m", [0.0, 2.0]), (4, "n", [1.0])], "doc long, model string, vector array<float>")
    asked = spark.createDataFrame([(1, "m", [0.0, 1.0])], "q long, model string, qv array<float>")
    cos = retrieval.cosines(v, asked)
    assert {r.doc: r.score for r in retrieval.blend(s, cos).collect()} == {1: 0.4, 2: 0.6, 3: 0.5}
    assert [(r.doc, r.score, r["rank"]) for r in retrieval.cosine_top(v, asked, 1).collect()] == [(3, 1.0, 1)]
    docs = spark.createDataFrame([(3, "p", 0, " " + "y" * 400), (2, "q", 1, None)], "chunk_id long, source_path string, chunk_index int, text string")
    best = spark.createDataFrame([(1, 3, 0.5, 1), (1, 2, 0.1, 2)], "q long, doc long, score double, rank int")
    assert {r.doc: r.preview for r in retrieval.answers(best, docs).collect()} == {3: "y" * 299 + "...", 2: None}


@pytest.mark.parametrize(
    "text,out",
    [
        ("", ""),
        (" \n ", " \n "),
        ("same\n" * 50, "same\n    (same line, 49 times more)"),
        ("a\nb\na", "a\nb\na"),
        ("## main...origin\n M a.py\n?? b.py", "## main...origin\n M a.py\n?? b.py"),
        ("On branch dev\nChanges not staged for commit:\n  (use \"git add\")\n\tmodified:   src/a.py\n\tdeleted:    b.py\n\nUntracked files:\n  (use \"git add <file>...\" to include in what will be committed)\n\tnew.txt\n\tother.txt\n\nno changes added to commit\n", "branch dev; 4 paths in all\n  deleted (1): b.py\n  modified (1): src/a.py\n  untracked (2): new.txt, other.txt"),
    ],
)
def test_compress(spark, text, out):
    assert one(spark, compress.compress(F.col("t")), t=text) == out


def test_compress_numbered_lines(spark):
    t = "\n".join(f"line {i}" for i in range(200))
    out = one(spark, compress.compress(F.col("t")), t=t).split("\n")
    assert out[0] == "line 0" and out[40] == "    (155 lines left out)" and out[-1] == "line 199" and len(out) == 46
    assert one(spark, compress.compress(F.col("t")), t="\n".join(f"l{i}" for i in range(45))) == "\n".join(f"l{i}" for i in range(45))


@pytest.mark.parametrize("tool,cmd,b", [("Edit", None, "edit"), ("Grep", None, "read"), ("Bash", "cd x && PYTEST -q", "bash_test"), ("Bash", "Git push", "bash_git"), ("Bash", "ls", "bash_infra"), ("WebFetch", None, "web"), ("Ask", "pytest", "other"), (None, None, "other")])
def test_bucket(spark, tool, cmd, b):
    assert one(spark, activity.bucket(F.col("a"), F.col("c")), a=tool, c=cmd) == b


@pytest.mark.parametrize("bs,m", [(["edit", "bash_test"] * 2, "debug"), (["edit"] * 3 + ["read"], "code"), (["read"] * 6, "review"), (["bash_infra", "bash_git"], "infra"), (["other"], "general")])
def test_mode(spark, bs, m):
    df = spark.createDataFrame([("s", i, b) for i, b in enumerate(bs)] + [(None, 99, "edit")], "session_id string, seq long, bucket string")
    got = {r.session_id: (r.n, r["mode"]) for r in activity.modes(df).collect()}
    assert got["s"] == (len(bs), m) and got[None][0] == len(bs) + 1 and len(got) == 2


def test_window_of_all_sessions(spark):
    df = spark.createDataFrame([(f"s{i % 3}", i, "edit") for i in range(40)], "session_id string, seq long, bucket string")
    w = activity.windows(df, 10).collect()
    assert sorted(r.seq for r in w if r.session_id is None) == list(range(30, 40)) and sum(r.session_id is not None for r in w) == 30
    assert activity.windows(df.limit(0), 10).count() == 0


def test_activity_is_recorded(spark):
    log = spark.createDataFrame([(7, "s", None, "Read", "read")], "seq long, session_id string, ts timestamp, tool_name string, bucket string")
    new = spark.createDataFrame([("s", 2, "Bash", "git push"), ("t", 1, "Edit", None)], "session_id string, t long, tool_name string, command string").withColumn("ts", F.timestamp_seconds("t"))
    assert [(r.seq, r.session_id, r.bucket) for r in activity.recorded(log, new).collect()] == [(9, "s", "bash_git"), (8, "t", "edit"), (7, "s", "read")]
    assert {r.seq for r in activity.recorded(log, new, EngineConfig(activity_keep=2)).collect()} == {8, 9}
    assert activity.recorded(log.limit(0), new).count() == 2


def test_recording_in_micro_batches(spark, tmp_path):
    from ctxlake.streaming import activity as streams
    from ctxlake.streaming.run import parquet_stream

    schema = "session_id string, ts timestamp, tool_name string, command string"
    where = str(tmp_path / "log")
    for i in range(3):
        rows = [("s", i * 10 + k, "Edit", None) for k in range(4)]
        spark.createDataFrame(rows, "session_id string, t long, tool_name string, command string").select("session_id", F.timestamp_seconds("t").alias("ts"), "tool_name", "command").coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))
        q = streams.recording(parquet_stream(spark, str(tmp_path / "calls"), schema), where, cfg=EngineConfig(activity_keep=6)) if i == 2 else None
    q.awaitTermination()
    log = streams.recorded_log(spark, where)
    assert sorted(r.seq for r in log.collect()) == list(range(7, 13)) and log.where("bucket = 'edit'").count() == 6


def test_audit(spark):
    p = "This paragraph is long enough to be compared with others."
    df = spark.createDataFrame([("a", p + "\n\nshort"), ("b", "x\n\n" + p.upper().replace(" ", "\n"))], "path string, text string")
    d = audit.duplicates(df).collect()
    assert [(r.occurrences, r.snippet) for r in d] == [(2, "a: " + p.lower()[:60] + "...")]
    assert d[0].locations == ["a: " + p.lower()[:60] + "...", "b: " + p.lower()[:60] + "..."]
    many = spark.createDataFrame([(f"f{i:03}", p) for i in range(50)], "path string, text string")
    (one_,) = audit.duplicates(many).collect()
    assert one_.occurrences == 50 and len(one_.locations) == 20 and one_.snippet.startswith("f000") and audit.places(many).count() == 50


def test_orphans(spark):
    note = lambda *rows: spark.createDataFrame(list(rows), "path string, text string")
    notes = note(("memory/used.md", ""), ("memory/lost.md", "about lost"), ("memory/é😀.md", None), ("memory/a.b.md", ""), ("memory/inside.md", "a.b"), ("memory/.md", ""), (None, "lost"))
    others = note(("c", "see usedful things 😀é😀"), ("d", None), ("memory/x", "outsideinsider"), ("memory/é😀.md", "é😀"))
    assert {r.path for r in audit.orphans(notes, others.unionByName(notes)).collect()} == {"memory/lost.md"}
    assert {r.path for r in audit.orphans(notes, others.limit(0)).collect()} == {r.path for r in notes.collect()} - {None}
    assert audit.orphans(notes.limit(0), others).count() == 0
    rng = random.Random(1)
    stems = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) for _ in range(200)]
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 60))) for _ in range(12)]
    got = {r.path for r in audit.orphans(note(*((f"m/{x}.md", None) for x in stems)), note(*((f"t{i}", t) for i, t in enumerate(texts)))).collect()}
    assert got == {f"m/{x}.md" for x in stems if not any(x in t for t in texts)}


def test_audit_report(spark):
    p = "This paragraph is long enough to be compared with others."
    notes = spark.createDataFrame([("NOTES.md", p + "\n\n" + p)], "path string, text string")
    memory = spark.createDataFrame([(f"m/topic{i}.md", "") for i in range(15)], "path string, text string")
    coding = [(r.kind, r.n) for r in audit.report(notes, "code", memory).collect()]
    assert coding == [("size", 1), ("repeated", 1)] + [("orphan", 15)] * 10
    assert [r.kind for r in audit.report(notes, "infra", memory).collect()] == ["size"] + ["orphan"] * 10 + ["repeated"]
    assert {r.kind for r in audit.report(notes, "infra").collect()} == {"size", "repeated"}


@pytest.mark.parametrize("rule,path,hit", [("*.pyc", "a/b.pyc", True), ("build/", "x/build/y", True), ("build/", "build", False), ("/top.txt", "a/top.txt", False), ("a/**/z", "a/b/c/z", True), ("doc?", "docs", True), ("f[0-9].txt", "a/f7.txt", True), ("f[!0-9].txt", "a/f7.txt", False), ("f[]x].txt", "f].txt", True), ("a[/]b", "a/b", False), ("[ab", "[ab", True), (".pytest_cache/", "x/.pytest_cache/v", True)])
def test_ignore_rules(spark, rule, path, hit):
    assert one(spark, pack.ignored(F.col("p"), (rule,)), p=path) is hit


def test_pack(spark):
    rows = [("src/a.py", b"x = 1\r\n"), ("src/b.bin", bytes(range(256))), ("docs/c.pdf", b"%PDF"), ("a-b", b"t"), ("a/b", b"t"), ("__pycache__/m.pyc", b"t")]
    df = pack.pack(spark.createDataFrame(rows, "path string, content binary"))
    assert {r.path: (r.route, r.text) for r in df.collect()} == {"src/a.py": ("text", "x = 1\n"), "src/b.bin": ("skip", None), "docs/c.pdf": ("distill", None), "a-b": ("text", "t"), "a/b": ("text", "t")}
    assert [r.path for r in pack.by_path(df.where("path LIKE 'a%'")).collect()] == ["a/b", "a-b"]


def test_files_that_are_no_text(spark):
    """By suffix, though their bytes are text."""
    rows = [(f"x/f{suffix}", b"plain") for suffix in (".zip", ".tar", ".gz", ".exe", ".dll", ".so", ".dylib", ".bin", ".db", ".sqlite", ".sqlite3", ".mp4", ".mp3", ".mov", ".ICO", ".class", ".txt")] + [(".pytest_cache/f.txt", b"a"), ("a/.DS_Store", b"a")]
    got = {r.path: r.route for r in pack.pack(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert {k for k, v in got.items() if v == "text"} == {"x/f.class", "x/f.txt", "a/.DS_Store"} and ".pytest_cache/f.txt" not in got and len(got) == 18


def test_packed_document(spark, tmp_path):
    rows = [("b.py", b"x ]]> y"), ("a/s.pdf", b"%PDF"), ("a/bad.png", b"i"), ("a/gone.png", b"i"), ('q"&<.txt', b"t"), ("z.db", b"t")]
    done = spark.createDataFrame([("a/s.pdf", "from the scan", 3, None), ("a/bad.png", None, None, "ValueError: no image"), ("other.pdf", "x", 1, None)], "path string, text string, tokens int, error string")
    p = pack.pack(spark.createDataFrame(rows, "path string, content binary"), distilled=done)
    got = {r.path: r for r in p.collect()}
    assert (got["a/s.pdf"].route, got["a/s.pdf"].text, got["a/s.pdf"].tokens) == ("distill", "from the scan", 3) and len(got) == 6
    assert [tuple(r) for r in pack.skipped(p).collect()] == [("a/bad.png", "not distilled: ValueError: no image"), ("a/gone.png", "not distilled"), ("z.db", "no text")]
    md = "\n".join(r.section for r in pack.document(p).collect())
    assert md.startswith("# Packed tree: 3 files, about 6 tokens\n\n## a/s.pdf (distilled)\n\n```\nfrom the scan\n```\n") and md.index("## b.py") < md.index('## q"')
    xml = "\n".join(r.section for r in pack.document(p, "xml").collect())
    tree = ElementTree.fromstring(xml)
    assert [(f.get("path"), f.get("distilled"), f.text.strip()) for f in tree] == [("a/s.pdf", "true", "from the scan"), ("b.py", None, "x ]]> y"), ('q"&<.txt', None, "t")]
    pack.write_document(p, str(tmp_path / "doc"), "xml")
    assert "\n".join(f.read_text().rstrip("\n") for f in sorted((tmp_path / "doc").glob("part-*")) if f.read_text()) == xml


def _shown(spark):
    page = lambda k, text: (k, 0, "native_text", text, None, None, 100, 10, [], 0, [])
    rows = [page("h1", "short text"), page("h2", "long " * 10_000)]
    df = spark.createDataFrame(rows, "doc_key string, page_index int, method string, text string, ocr_confidence double, ocr_word_count int, raw_tokens_est int, distilled_tokens_est int, warnings array<string>, image_count int, figures array<string>")
    return sessions.shown_documents(pages.documents(df).withColumn("rendered_text", F.col("text")).withColumn("source_path", F.concat(F.lit("/"), F.col("doc_key"), F.lit(".pdf"))).withColumn("handle", F.lit(5)))


READS = [(1, "s", "h1", 1, "/x/h1.PDF", None), (2, "s", "h1", 2, "/x/h1.pdf", None), (2, "s", "h1", 2, "/x/h1.pdf", None), (3, "t", "h1", 1, "/x/h1.pdf", 4), (4, "t", "h1", 3, "/x/h1.pdf", None), (5, None, "h1", 4, "/x/h1.pdf", None), (6, None, "h1", 5, "/x/h1.pdf", None), (7, "s", "h2", 6, "/x/h2.pdf", None), (8, "s", "h2", 7, "/x/h2.pdf", None), (9, "s", "gone", 1, "/x/g.pdf", None), (10, "s", None, 1, "/x/a.py", None), (11, "s", "h1", 9, None, None)]
WANT = {1: "whole", 2: "again", 3: "range", 4: "whole", 5: "whole", 6: "whole", 7: "large", 8: "again", 9: "failed", 10: "suffix", 11: "suffix"}


def _events(df):
    none = F.lit(None).cast("string")
    return df.select("id", "session_id", "content_hash", F.timestamp_seconds("t").alias("seen_at"), "file_path", none.alias("pages"), "offset", none.alias("limit"))


def test_decisions(spark):
    df = spark.createDataFrame(READS, "id long, session_id string, content_hash string, t long, file_path string, offset int")
    out = sessions.decisions(_events(df), _shown(spark)).collect()
    assert {r.id: r.branch for r in out} == WANT and len(out) == len(WANT)
    told = {r.id: json.loads(r.response)["hookSpecificOutput"] for r in out if r.response}
    assert {r.id for r in out if r.decision == "deny"} == told.keys() == {i for i, b in WANT.items() if b in ("whole", "large", "again")}
    text = {i: t["permissionDecisionReason"] for i, t in told.items()}
    assert text[1].startswith("[ctxlake] /h1.pdf: 100 -> 10 tokens (10.0x); pages by method: native_text 1.") and text[1].endswith("short text")
    assert "short text" not in text[2] and "expand 5" in text[2] and len(text[7]) < 6500 and text[7].endswith("[cut here] All of it: expand 5.")


def test_decisions_of_a_stream(spark, tmp_path):
    """The same over a folder of part files, one micro-batch each."""
    from ctxlake.streaming.activity import decision_stream
    from ctxlake.streaming.run import drain, parquet_stream

    schema = "id long, session_id string, content_hash string, t long, file_path string, offset int"
    for i, part in enumerate((READS[:2], READS[2:7], READS[7:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "reads"))
    stream = parquet_stream(spark, str(tmp_path / "reads"), schema)
    out = drain(decision_stream(_events(stream), _shown(spark)), "append").collect()
    got = {}
    for r in out:
        got.setdefault(r.id, r.branch)
    assert got == WANT
    one = parquet_stream(spark, next(str(f) for f in (tmp_path / "reads").glob("*.parquet")), schema)
    assert drain(one, "append").count() > 0


def test_expand(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "handle long, rendered_text string")
    asked = spark.createDataFrame([(2,), (9,), (2,)], "handle long")
    assert {tuple(r) for r in sessions.expand(docs, asked).collect()} == {(2, True, "two"), (9, False, None)}


def test_run_log(spark, tmp_path):
    row = ("h", 0, "vision", "text", 50.0, 9, 100, 10, ["w"], 0, [])
    df = spark.createDataFrame([row], "doc_key string, page_index int, method string, text string, ocr_confidence double, ocr_word_count int, raw_tokens_est int, distilled_tokens_est int, warnings array<string>, image_count int, figures array<string>")
    docs = pages.documents(df).withColumn("source_path", F.lit("/h.pdf")).withColumn("source_type", F.lit("pdf")).withColumn("duration_ms", F.lit(5))
    runs = pages.run_rows(docs, "hook")
    for _ in range(2):
        pages.append_runs(runs, str(tmp_path / "runs"))
    log = spark.read.parquet(str(tmp_path / "runs"))
    assert log.select("run_id").distinct().count() == 2 and log.where("ts IS NULL").count() == 0
    first = pages.recent_runs(log, limit=1).first()
    assert (first.source_path, first.trigger, first.vision_calls, first.status, first.ratio) == ("/h.pdf", "hook", 1, "ok", 10.0)
    assert pages.recent_runs(log, "2999-01-01").count() == 0 and pages.savings(log).first().saved_tokens == 180
    j = json.loads(docs.select(pages.result_json()).first()[0])
    assert list(j) == "source_path source_type page_count method_counts raw_tokens_est distilled_tokens_est compression_ratio duration_ms warnings pages_with_uncaptured_images pages_with_described_figures figure_count text".split() and j["method_counts"] == {"vision": 1}


def test_words_of_a_recogniser(spark):
    boxes = [{"text": " a ", "conf": "90"}, {"text": "b", "conf": "-1"}, {"text": "  ", "conf": "50"}, {"text": "c", "conf": "x"}, {"text": "d", "conf": "70.5"}, {"text": "e", "conf": None}]
    df = spark.createDataFrame([(boxes,), ([],)], "w array<struct<text:string,conf:string>>")
    assert [tuple(r.r) for r in df.select(pages.words_read(F.col("w")).alias("r")).collect()] == [("a d", 80.25, 2), ("", 0.0, 0)]


def test_image_is_prepared(spark):
    from ctxlake.functions import images

    rgb = np.full((6, 8, 3), 200, np.uint8)
    rgb[2:4, 2:6] = (40, 50, 60)
    out = images.prepared(rgb, small=4)
    assert out.shape == (6, 8) and (out[2:4, 2:6] == 0).all() and out.sum() == 255 * 40
    assert images.prepared(rgb, small=100).shape == (12, 16) and set(np.unique(images.prepared(rgb, small=100))) == {0, 255}
    flat = images.enlarged(np.full((5, 5), 77, np.uint8))
    assert flat.shape == (10, 10) and (flat == 77).all() and images.threshold(np.eye(256)[7]) == 128
    df = spark.createDataFrame([(1, 8, 6, rgb.tobytes()), (2, 9, 9, b"x"), (3, None, 6, None)], "id long, width int, height int, rgb binary")
    got = {r.id: r for r in images.prepare(df, small=4).collect()}
    assert got[1].pixels == out.tobytes() and got[2].error and got[3].error and got[2].pixels is None


def test_image_files(spark):
    import struct
    import zlib

    from ctxlake.sources import images

    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (7, 5, 3), np.uint8)
    assert (images.load(images.png(x)) == x).all() and images.size(images.png(x)) == (5, 7)
    g = x[:, :, 0]
    assert (images.load(images.png(g))[:, :, 1] == g).all()
    assert (images.load(b"P6\n# c\n5 7 255\n" + x.tobytes()) == x).all() and (images.load(b"P5 5 7 255 " + g.tobytes())[:, :, 2] == g).all()
    # Every row filter, made from the pixels by its definition.
    rows, above = b"", [0] * 15
    for y in range(7):
        line, kind = x[y].ravel().tolist(), y % 5
        left = lambda r, i: r[i - 3] if i >= 3 else 0

        def guess(i, kind=kind, line=line, above=above):
            a, b, c = left(line, i), above[i], left(above, i)
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            return (0, a, b, (a + b) // 2, near)[kind]

        rows += bytes([kind]) + bytes((v - guess(i)) & 255 for i, v in enumerate(line))
        above = line
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + b"crc0"
    data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 5, 7, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")
    assert (images.load(data) == x).all()
    df = spark.createDataFrame([("a.png", data), ("b.png", b"\x89PNG\r\n\x1a\nxx"), ("c.jpg", b"?"), ("d.png", None)], "path string, content binary")
    got = {r.path: r for r in images.images(df).collect()}
    assert got["a.png"].rgb == x.tobytes() and all(got[k].error for k in ("b.png", "c.jpg", "d.png"))


def test_weak_pass_is_repeated_with_the_prepared_image():
    from ctxlake.sources import images

    x = np.full((4, 4, 3), 90, np.uint8)
    x[1:3] = 120
    seen = []

    def ocr(image):
        seen.append(np.unique(images.load(image)).tolist())
        return ("read", 95.0, 9) if seen[-1] == [0, 255] else ("", 0.0, 0)

    assert distill.recognise(images.png(x), Backends(ocr=ocr), distill.DEFAULT, True, "")[:4] == ("ocr", "read", 95.0, 9) and seen == [[90, 120], [0, 255]]


def test_crop_box_equals_expression(spark):
    rng = random.Random(4)
    boxes = [tuple(rng.uniform(-80, 700) for _ in range(4)) for _ in range(300)]
    df = spark.createDataFrame(boxes, "x0 double, y0 double, x1 double, y1 double")
    c = K.crop(F.struct("x0", "y0", "x1", "y1"), F.lit(792.0), F.lit(1275), F.lit(1650), 150.0)
    assert [tuple(r.c) for r in df.select(c.alias("c")).collect()] == [distill.crop_box(b, 792.0, (1275, 1650), 150.0) for b in boxes]


def test_chunks_with_services(spark):
    packed = spark.createDataFrame([("a.md", "text", "one two"), ("b.bin", "skip", None)], "path string, route string, text string")
    rows = chunking.chunk_rows(packed)
    assert [(r.source_path, r.chunk_index, r.text) for r in rows.collect()] == [("a.md", 0, "one two")] and rows.where("indexed_at IS NULL OR chunk_id IS NULL").count() == 0
    ok = chunking.embedded(rows, Backends(embed=lambda ts, kind: [[float(len(t)), 1.0] for t in ts]), "m").first()
    assert ok.vector == [7.0, 1.0] and ok.error is None
    assert "no embedding service" in chunking.embedded(rows, Backends(), "m").first().error
    assert chunking.embedded(rows, Backends(embed=lambda ts, kind: []), "m").first().error
    df = spark.createDataFrame([(1, "abcd"), (2, None)], "id long, text string")
    assert {tuple(r) for r in chunking.exact_counts(df, Backends(count_tokens=len)).collect()} == {(1, 1, 4, None), (2, 0, 0, None)}
    assert all(r.exact is None and "no counting service" in r.error for r in chunking.exact_counts(df, Backends()).collect())


def test_published_sizes(spark):
    """The sizes that are published for samples of this kind: token costs exactly, savings as lower bounds."""
    lines = "\n".join(f"tests/test_{i}.py {'.' * 40} [{i:3}%]" for i in range(30))
    run = f"=== test session starts ===\ncollected 169 items\n{lines}\n169 passed in 2.31s"
    before, after = one(spark, F.struct(T.text_tokens("a"), T.text_tokens(compress.compress(F.col("a")))), a=run)
    assert 1 - after / before > 0.9
    status = "On branch main\nYour branch is up to date.\n\nChanges not staged for commit:\n  (use \"git add <file>...\" to update what will be committed)\n  (use \"git restore <file>...\" to discard changes in working directory)\n" + "".join(f"\tmodified:   src/module_{i}/file_{i}.py\n" for i in range(8)) + "\nUntracked files:\n  (use \"git add <file>...\" to include in what will be committed)\n" + "".join(f"\tnotes_{i}.txt\n" for i in range(4))
    before, after = one(spark, F.struct(T.text_tokens("a"), T.text_tokens(compress.compress(F.col("a")))), a=status)
    assert 1 - after / before > 0.5
    page = one(spark, K.page_host_tokens(F.lit(612.0), F.lit(792.0), F.col("a")), a="x" * 248)  # a letter-size page: 2,534 and its text
    assert page == 2534 + 62 and 25 * page / (25 * 62) > 33
    assert one(spark, K.image_tokens(F.lit(2880), F.lit(1800)), a="") == 2049


def test_shared_folder(spark):
    from types import SimpleNamespace

    from ctxlake import runtime

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_folder(cluster)
    cluster.conf.get = lambda k, d=None: "hdfs:///shared/" if k == "spark.checkpoint.dir" else d
    assert runtime.shared_folder(cluster) == "hdfs:///shared"
    where = runtime.new_folder(spark, "test")
    assert runtime.is_folder(spark, where) and not runtime.is_folder(spark, where + "x") and where.startswith(runtime.shared_folder(spark))


def test_index_in_versions(spark, tmp_path):
    from ctxlake.operators import flows

    tree = lambda *rows: spark.createDataFrame([(p, t.encode()) for p, t in rows], "path string, content binary")
    root = str(tmp_path / "store")
    embed = Backends(embed=lambda ts, kind: [[float("pump" in t), float("valve" in t)] for t in ts])
    assert flows.current(spark, root) is None
    v = flows.index_tree(tree(("a.md", "the pump runs"), ("b.md", "the valve leaks"), ("c.md", "nothing of note")), root, embed, "m")
    assert v.number == 1 and v.chunks.count() == 3 and v.vectors.where("error IS NULL").count() == 3
    ids = {r.source_path: r.chunk_id for r in v.chunks.collect()}
    v = flows.index_tree(tree(("b.md", "the valve is new"), ("a.md", "")), root)
    assert v.number == 2 and {(r.source_path, r.text) for r in v.chunks.collect()} == {("b.md", "the valve is new"), ("c.md", "nothing of note")}
    assert {r.chunk_id for r in v.vectors.collect()} == {ids["c.md"]}
    v = flows.index_tree(tree(("d.md", "a pump and a valve")), root, embed, "m")
    assert v.vectors.where("error IS NULL").count() == v.chunks.count() == 3
    (tmp_path / "store" / "v9").mkdir()
    assert flows.current(spark, root).number == 3
    q = spark.createDataFrame([(1, "valve")], "q long, question string")
    assert [r.source_path for r in flows.ask(v, q, 2).orderBy("rank").collect()] == ["b.md", "d.md"]
    assert [(r.source_path, r.score) for r in flows.ask(v, q, 1, embed, "m").collect()] == [("b.md", 1.0)]
    broken = flows.index_tree(tree(("d.md", "again")), root, Backends(embed=lambda ts, kind: 1 / 0), "m")
    assert broken.chunks.count() == 3 and broken.vectors.where("error LIKE 'ZeroDivisionError%'").count() == 1


def test_tree_holds_every_file(spark, tmp_path):
    from ctxlake.sources import files

    want = {"a.py": b"1", "pkg/__init__.py": b"2", ".env": b"3", ".git/objects/ab": b"4", "x [1]/_y/z.txt": b"", "x [1]/a+b %20.txt": b"", "é/full+.txt": b"6", "none.txt": b"", "deep/er/.keep": b"5"}
    for k, v in want.items():
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_bytes(v)
    got = files.tree(spark, str(tmp_path)).collect()
    assert {r.path: bytes(r.content) for r in got} == want and len(got) == len(want)
    assert files.ignore_file(spark, str(tmp_path)) is None
    (tmp_path / ".gitignore").write_text("é\n*.x\n")
    assert files.ignore_rules(files.ignore_file(spark, str(tmp_path)), ("a",)) == ("a", "é", "*.x")


def test_command_line(spark, tmp_path, monkeypatch):
    import io

    from ctxlake.__main__ import run

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.md").write_text("the pump runs, see topic")
    (tmp_path / "t" / "x.log").write_text("no")
    (tmp_path / "t" / ".gitignore").write_text("*.log\n.gitignore\n")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "topic.md").write_text("")
    (tmp_path / "m" / "lost.md").write_text("")

    def call(*argv):
        out = io.StringIO()
        code = run(list(map(str, argv)), out, spark)
        return code, [json.loads(x) if x.startswith("{") else x for x in out.getvalue().splitlines() if x]

    assert call("pack", tmp_path / "t", "--out", tmp_path / "doc")[1] == [{"route": "text", "files": 1, "tokens": 6}]
    assert call("index", tmp_path / "t", tmp_path / "s")[1] == [{"files": 3, "chunks": 3}]
    code, rows = call("query", tmp_path / "s", "pump", "--top", 1)
    assert code == 0 and [r["source_path"] for r in rows] == ["a.md"]
    assert call("query", tmp_path / "none", "pump")[0] == 1
    assert [r["finding"] for r in call("audit", tmp_path / "t", "--memory", tmp_path / "m")[1] if r["kind"] == "orphan"] == ["lost.md"]
    spark.createDataFrame([("s", 1, "edit")], "session_id string, seq long, bucket string").write.parquet(str(tmp_path / "log"))
    assert call("mode", tmp_path / "log", "--session", "s")[1] == [{"session_id": "s", "n": 1, "mode": "code"}]
    monkeypatch.setattr("sys.stdin", io.StringIO("same\n" * 50))
    assert call("compress")[1] == ["same", "    (same line, 49 times more)"]


def test_latest_and_replace(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 3, "new"), ("m", 2, None)], "k string, id long, v string")
    assert {tuple(r) for r in store.latest(df, "k", "id").collect()} == {("k", 3, "new"), ("m", 2, None)}


def test_rereads(spark):
    df = spark.createDataFrame([(1, "s", "h", 5), (2, "s", "h", 6), (2, "s", "h", 6), (3, None, "h", 7), (4, "t", "h", 8)], "id long, session_id string, content_hash string, seen_at long")
    assert {r.id: r.reread for r in sessions.rereads(df).collect()} == {1: False, 2: True, 3: False, 4: False}


def make_pdf(texts: list[list[str]], image_on: set[int] = frozenset()) -> bytes:
    """A small PDF: one text line for each string, and an image of 80 x 80 points on some pages."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /XObject /Subtype /Image /Width 4 /Height 4 >>\nstream\nxxxx\nendstream"}
    kids = []
    for i, lines in enumerate(texts):
        body = "BT /F1 12 Tf 72 720 Td " + " 0 -14 Td ".join(f"({x}) Tj" for x in lines) + " ET"
        body += " q 80 0 0 80 300 100 cm /Im1 Do Q" if i in image_on else ""
        page, content = 10 + 2 * i, 11 + 2 * i
        kids.append(f"{page} 0 R")
        objects[page] = f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents {content} 0 R /Resources << /XObject << /Im1 3 0 R >> >> >>".encode()
        objects[content] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body.encode("latin-1"))
    objects[2] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in sorted(objects.items())) + b"%%EOF"


def test_pdf_with_fonts_and_compressed_objects():
    import zlib

    from ctxlake.sources import pdf

    table = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0416> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0066> <00660069>] endbfrange"
    body = b"BT /F1 12 Tf 72 720 Td <00010010 0011 0012> Tj 0 -14 Td [<0020> -250 <0021> 20 <0002>] TJ /F2 9 Tf 0 -14 Td (caf\\351 \\200\\(1\\)) Tj /F3 9 Tf 0 -14 Td <0001> Tj ET q 10 0 0 20 30 40 cm /Im Do Q"
    packed = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 300 400] /Resources 9 0 R >>"), (3, b"<< /Type /Page /Parent 2 0 R /Contents 20 0 R >>"), (9, b"<< /Font 10 0 R /XObject << /Im 22 0 R >> >>"),
              (10, b"<< /F1 11 0 R /F2 12 0 R /F3 13 0 R >>"), (11, b"<< /Type /Font /Subtype /Type0 /ToUnicode 21 0 R >>"), (12, b"<< /Type /Font /Subtype /Type1 >>"), (13, b"<< /Type /Font /Subtype /Type0 >>")]
    head, at = [], 0
    for n, o in packed:
        head.append(f"{n} {at}")
        at += len(o) + 1
    head = " ".join(head).encode() + b" "
    held = zlib.compress(head + b"\n".join(o for _, o in packed))
    stream = lambda n, d, x: b"%d 0 obj\n<< /Length %d %s>>\nstream\n%s\nendstream\nendobj\n" % (n, len(x), d, x)
    data = b"%PDF-1.5\n" + stream(30, b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode " % (len(packed), len(head)), held) + stream(20, b"/Filter /FlateDecode ", zlib.compress(body)) + stream(21, b"", table) + stream(22, b"/Subtype /Image ", b"x") + b"%%EOF"
    (page,) = pdf.parse(data)
    assert page.text == "Жabc\nf fi😀\ncafé €(1)" and (page.width, page.height) == (300, 400) and page.boxes == [(30, 40, 40, 60)]


def test_distill(spark, tmp_path):
    from ctxlake.sources import files, pdf

    (tmp_path / "a.pdf").write_bytes(make_pdf([["A text layer that is long enough", "second line", "Footer"], ["Another page with enough words", "Footer"], ["Third page with some words too", "Footer"], ["A fourth page with its own words", "Footer"], []], {1}))
    (tmp_path / "broken.pdf").write_bytes(b"no pdf")
    (tmp_path / "scan.png").write_bytes(b"img")
    (tmp_path / "notes.txt").write_bytes(b"skip me")
    found = files.distillable(spark, str(tmp_path))
    assert found.count() == 3
    b = Backends(ocr=lambda i: ("weak", 40.0, 1), ocr_retry=lambda i: ("a better reading", 90.0, 9), rasterise=lambda d, i, dpi: b"page", crop=lambda i, box: b"part", measure=lambda i: (800, 600))
    empty = spark.createDataFrame([], distill.ROW + ", options string")
    out = distill.distill(found, empty, b)
    rows = {(r.path.rsplit("/", 1)[-1], r.page_index): r for r in out.collect()}
    assert rows["a.pdf", 0].text == "A text layer that is long enough\nsecond line" and rows["a.pdf", 0].method == "native_text"
    assert rows["a.pdf", 1].figures == ["a better reading"] and rows["a.pdf", 4].method == "ocr" and rows["scan.png", 0].raw_tokens_est == 640
    assert rows["broken.pdf", None].error.startswith("ValueError")
    total = distill.scan_totals(out).first()
    assert (total.ok, total.failed) == (2, 1)
    again = distill.distill(found, out.where("error IS NULL").drop("cached"), b)
    assert {r.path.rsplit("/", 1)[-1] for r in again.where("cached").collect()} == {"a.pdf", "scan.png"}
    spark.dataSource.register(pdf.PdfPages)
    assert spark.read.format("pdfpages").load(str(tmp_path)).where("error IS NULL").count() == 5


def test_route_without_services():
    m, text, *_ , notes = distill.recognise(b"", Backends(ocr=lambda i: ("x", 10.0, 1)), distill.DEFAULT, True, "")
    assert m == "ocr_degraded" and text == "x" and notes


def test_event_windows(spark, tmp_path):
    from ctxlake.streaming.activity import events_per_window
    from ctxlake.streaming.run import drain

    rows = [(1, "2020-01-01 00:01:00", "a"), (1, "2020-01-01 00:01:00", "a"), (2, "2020-01-01 00:11:00", "a"), (3, "2020-01-01 05:00:00", "b")]
    spark.createDataFrame(rows, "seq long, ts string, bucket string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("seq long, ts timestamp, bucket string").parquet(str(tmp_path / "e"))
    got = {(str(r.start)[11:16], r.bucket): r.n for r in drain(events_per_window(s), "append").collect()}
    assert got == {("00:00", "a"): 1, ("00:10", "a"): 1}
