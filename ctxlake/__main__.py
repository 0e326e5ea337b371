"""python -m ctxlake COMMAND: pack, index, query, mode, audit and compress from a shell, with a local session. Each is a call of the operators."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ctxlake", description=__doc__)
    p.add_argument("--master", default="local[*]")
    c = p.add_subparsers(dest="command", required=True)
    x = c.add_parser("pack", help="one document of a tree")
    x.add_argument("folder")
    x.add_argument("--include")
    x.add_argument("--exclude")
    x.add_argument("--style", choices=("markdown", "xml"), default="markdown")
    x.add_argument("--out", required=True, help="folder of text files")
    x = c.add_parser("index", help="chunks and keyword index of a tree")
    x.add_argument("folder")
    x.add_argument("store")
    x = c.add_parser("query", help="the best chunks for a question")
    x.add_argument("store")
    x.add_argument("question")
    x.add_argument("--top", type=int, default=5)
    x = c.add_parser("mode", help="what a session is doing, from its log (Parquet)")
    x.add_argument("log")
    x.add_argument("--session")
    x = c.add_parser("audit", help="sizes, repeated paragraphs and orphans of notes")
    x.add_argument("folder")
    x.add_argument("--memory")
    x.add_argument("--mode", default="general")
    x = c.add_parser("compress", help="command output from standard input, shorter")
    x.add_argument("--kind", choices=("git-status", "pytest", "install", "generic"))
    return p


def run(argv: list[str] | None = None, out=sys.stdout, spark=None) -> int:
    a = parser().parse_args(argv)
    from ctxlake.functions.text import text_tokens
    from ctxlake.operators import activity, audit, compress, flows, pack
    from ctxlake.runtime import session
    from ctxlake.sources import files

    s = spark or session(a.master)
    show = lambda rows: print(*[json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False) for r in rows], sep="\n", file=out)
    if a.command == "pack":
        rules = files.ignore_rules(files.ignore_file(s, a.folder), pack.EXCLUDES)
        packed = pack.pack(files.tree(s, a.folder), a.include, a.exclude, rules)
        pack.write_document(packed, a.out, a.style)
        show(packed.groupBy("route").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens")).orderBy("route").collect())
        show(pack.skipped(packed).collect())
    elif a.command == "index":
        v = flows.index_tree(files.tree(s, a.folder), a.store)
        show(v.chunks.agg(F.countDistinct("source_path").alias("files"), F.count("*").alias("chunks")).collect())
    elif a.command == "query":
        v = flows.current(s, a.store)
        if v is None:
            print("nothing is indexed here", file=sys.stderr)
            return 1
        show(flows.ask(v, s.createDataFrame([(1, a.question)], "q long, question string"), a.top).orderBy("rank").collect())
    elif a.command == "mode":
        modes = activity.modes(s.read.parquet(a.log))
        show(modes.where(F.col("session_id").isNull() if a.session is None else F.col("session_id") == a.session).collect())
    elif a.command == "audit":
        notes = lambda folder: files.tree(s, folder).where("path LIKE '%.md'").select("path", pack.decode(F.col("content")).alias("text"))
        show(audit.report(notes(a.folder), a.mode, notes(a.memory) if a.memory else None).collect())
    else:
        t = sys.stdin.read()
        r = s.createDataFrame([(t,)], "t string").select(compress.compress(F.col("t"), F.lit(a.kind) if a.kind else None).alias("o")).select("o", text_tokens("o").alias("n")).first()
        print(r.o, file=out)
        print(f"now {r.n} tokens", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(run())
