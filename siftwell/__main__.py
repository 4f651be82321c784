"""python -m siftwell COMMAND ...: search, usages, grep, outline, index, eval, serve, access, cache."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F

from siftwell.front import answers, roots
from siftwell.front.corpus import Corpus
from siftwell.front.settings import Settings, prune
from siftwell.front.tools import CONTENTS, Engine, serve
from siftwell.operators import evaluate, lookup, rank
from siftwell.operators.manifest import Folder
from siftwell.session import session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftwell", description=__doc__)
    p.add_argument("--root", default=".", help="the tree to answer from")
    p.add_argument("--stores", help="the folder of the indexes (by default that of the user)")
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("search", "query"), ("usages", "symbol"), ("grep", "pattern"), ("outline", "path"), ("eval", "probes")):
        c = sub.add_parser(name)
        c.add_argument("what", metavar=what, nargs="?" if name == "outline" else None, default="")
        c.add_argument("--path")
        c.add_argument("--limit", type=int)
        c.add_argument("--content", choices=CONTENTS, default="code")
    for name in ("index", "serve"):
        sub.add_parser(name)
    a = sub.add_parser("access")
    a.add_argument("what", choices=("add", "remove", "list", "forget"), nargs="?", default="list")
    a.add_argument("folder", nargs="?")
    c = sub.add_parser("cache")
    c.add_argument("what", choices=("status", "clean", "clear", "auto"), nargs="?", default="status")
    c.add_argument("days", nargs="?")
    return p


def _access(settings: Settings, root: Path, what: str, folder: str | None) -> str:
    repo = roots.repository(root)
    if what == "add":
        settings.grant(repo, roots._checked(Path(folder or ".").resolve()))
        settings.save()
    elif what in ("remove", "forget"):
        settings.revoke(repo, Path(folder).resolve() if what == "remove" and folder else None)
        settings.save()
    return "\n".join([f"Sessions in {repo} may also read:", *(f"  {d}{'' if d.is_dir() else '  (not on disk)'}" for d in settings.granted(repo))])


def _cache(settings: Settings, stores: Folder, what: str, days: str | None) -> str:
    if what == "auto" and days:
        if days != "off" and not (days.isdigit() and int(days) > 0):
            raise ValueError("a number of days, or off")
        settings.days = None if days == "off" else int(days)
        settings.save()
    if what == "clean":
        n, size = prune(stores, settings.days)
        return f"removed {answers.counted(n, 'store')} ({size / (1 << 20):.1f} MB)"
    if what == "clear":
        return f"removed {sum(1 for x in stores.names() if stores.drop(x) is None)} stores"
    size = sum(stores.age_and_size(x)[1] for x in stores.names())
    return f"{stores.root}: {answers.counted(len(stores.names()), 'store')}, {size / (1 << 20):.1f} MB; " + (f"stores not used for {answers.counted(settings.days, 'day')} are removed" if settings.days else "only outdated stores are removed")


def evaluated(corpus: Corpus, probes: str, limit: int, content: str = "code") -> str:
    """Recall and mean reciprocal rank of a file of probes, by file and by lines."""
    p = evaluate.read_probes(corpus.spark, probes)
    asked = p.select("query_id", "text", F.lit(content).alias("content"), F.lit(None).cast("string").alias("path_filter"))
    hits = corpus.documented(asked, limit * 8).select("query_id", "rank", "path", "start_line", "end_line").cache()
    out = ""
    for label, ranks in (("file", evaluate.file_ranks(p, hits, limit)), ("span", evaluate.span_ranks(p, hits, corpus.texts, limit))):
        r = rank.evaluated(ranks.select(F.col("query_id").alias("probe_id"), "rank")).first()
        if r.probes:
            out += f"{label}  {r.probes} probes  " + "  ".join(f"R@{k} {r[f'recall_{k}']:.3f}" for k in (1, 3, 5, 10, 20)) + f"  MRR {r.mrr:.3f}\n"
    hits.unpersist()
    return out


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    root, where = Path(a.root).resolve(), roots.folders()
    settings = Settings(where["settings"])
    if a.command == "access":
        return print(_access(settings, root, a.what, a.folder))
    spark, stores = session(), a.stores or f"file://{where['stores']}"
    if a.command == "cache":
        return print(_cache(settings, Folder(spark, stores), a.what, a.days))
    engine = Engine(spark, root, settings, stores)
    if a.command == "serve":
        for reply in serve(engine, sys.stdin):
            print(reply, flush=True)
        return None
    corpus = engine.corpus(root)
    most = 30 if a.command == "search" else 200
    limit = min(max(1, getattr(a, "limit", None) or (rank.LIMIT if a.command == "search" else 20 if a.command == "eval" else lookup.BUDGET)), most)
    if a.command == "search":
        return print(answers.search(corpus, a.what, a.content, a.path, limit))
    if a.command == "usages":
        return print(answers.usages_of(corpus, a.what, a.path, limit))
    if a.command == "grep":
        return print(answers.grep(corpus, a.what, a.path, limit))
    if a.command == "outline":
        return print(answers.outline_of(corpus, a.what))
    if a.command == "eval":
        return print(evaluated(corpus, a.what, limit, a.content))
    return print(f"{corpus.files.count()} files, {corpus.chunks.count()} chunks in {len(corpus.store.manifest.live())} segments")


if __name__ == "__main__":
    main()
