"""Text answers. Each takes a few bounded rows to the driver: the hits shown, the
lines of an outline, the entries of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import analyze
from siftwell.functions import text as T
from siftwell.front.corpus import SHEETS, Corpus
from siftwell.operators import extent, lookup, outline, rank, usages
from siftwell.operators.chunker import text_lines

SNIPPET, SKIM, CANDIDATES, ENTRIES, NAMES = 12, 4, 15, 80, 6
KIND_NOTES = {"Code": "", "Test": ", tests or fixtures", "Docs": ", docs", "Config": ", config"}


def counted(n: int, word: str) -> str:
    return f"{n} {word}" if n == 1 else f"{n} {word}s"


def nothing_indexed(corpus: Corpus) -> str | None:
    """What to say of a root without files, else None."""
    if not corpus.files.isEmpty():
        return None
    return f"Nothing is indexed under {corpus.root}: no source files were found there. This is almost certainly the wrong folder, not an empty project."


def _numbered(lines: list[str], first: int) -> str:
    return "".join(f"{first + i:>5}| {x.rstrip()}\n" for i, x in enumerate(lines))


def _window(corpus: Corpus, query: str, lines: list[str], size: int) -> int:
    """Where the best snippet of ``size`` lines begins."""
    if len(lines) <= size:
        return 0
    frame = corpus.spark.createDataFrame([(i + 1, x) for i, x in enumerate(lines)], "line int, text string")
    terms = analyze.query_terms(corpus.question(query)).select("term").distinct()
    found = analyze.index_terms(frame, "line").join(terms, "term", "left_semi").select("line", "term")
    marked = frame.join(found, "line", "left").groupBy("line").agg(F.array_join(F.sort_array(F.collect_set("term")), " ").alias("content")).withColumn("key", F.lit(1))  # terms of one line
    known = [r.term for r in terms.orderBy("term").limit(64).collect()]
    best = lookup.snippet_window(marked, known, size, "key").first() if known else None
    return best.first_line - 1 if best else 0


def search(corpus: Corpus, query: str, content: str = "code", path: str | None = None, limit: int = rank.LIMIT, lines: int = SNIPPET) -> str:
    if (said := nothing_indexed(corpus)) is not None:
        return said
    asked = corpus.question(query, content, path)
    hits = corpus.documented(asked, limit).cache()
    rows = {r["rank"]: r for r in hits.orderBy("rank").limit(limit).collect()}
    if not rows:
        outside = corpus.search(corpus.question(query, content), 1).first() if path else None
        return f"No matches under `{path}`, but there are matches elsewhere, first in {outside.path}. Drop or change `path`." if outside else "No matches. Try the words the code itself would use."
    out = "A document has a section by that name:\n\n" if rows[1].from_page else ""
    shown = [(r["rank"], r.detail, r.confident) for r in rank.presented(hits.drop("path", "kind", "from_page")).orderBy("rank").collect()]
    name = query.strip()
    if not rows[1].declares and not rows[1].from_page and name.replace("_", "a").isalnum() and corpus.usages(usages.needle(name)).isEmpty():
        shown = [(k, "Skim", c) for k, _, c in shown if rows[k].coverage + 1.2e-7 >= 1.0][: rank.FULL_SNIPPETS]
        if not shown:
            return f"Nothing in the code is named `{name}` (whole word, case-sensitive), and the words it is made of occur together nowhere. Check the spelling, or search by what it does."
        out += f"Nothing in the code is named `{name}` (whole word, case-sensitive). Its words occur together in:\n\n"
    elif not shown[0][2]:
        out += "Low confidence: few of the query's words occur together anywhere. Rephrase with the technical terms the code would use.\n\n"
    names = {r["rank"]: r.names for r in extent.span_names(hits, corpus.chunks).collect()}
    asked_for = {r["rank"]: r for r in corpus.line_of(hits, asked).collect()}
    texts = {r.file_id: r.text for r in corpus.texts.join(hits.select("file_id").distinct(), "file_id", "left_semi").collect()}  # files of the hits shown
    for k, detail, _ in shown:
        hit, all_ = rows[k], text_lines(texts.get(rows[k].file_id) or "")
        start, end, target = hit.start_line, hit.end_line, asked_for.get(k) if detail == "Declaration" else None
        if target:
            start, end = _section(all_, target.line) if hit.kind == "Docs" else extent.declaration_extent(all_, target.line)
        out += f"{hit.path}:{start}-{end}" + ("" if target or not names.get(k) else "  " + ", ".join(names[k])) + "\n"
        body, size = all_[start - 1 : end], extent.DECLARATION_LINES if target else lines if detail in ("Snippet", "Declaration") else min(lines, SKIM)
        if detail == "Heading" or lines == 0 or not body:
            continue
        first = 0 if target else _window(corpus, query, body, size)
        out += _numbered(body[first : first + size], start + first)
        if len(body) > size:
            out += f"       ... {len(body) - size} more lines, to {end}\n" if target else f"       ... {size} of {len(body)} lines shown\n"
        if target and hit.kind != "Docs":
            n = usages.totals(corpus.usages(usages.needle(target.name))).first()
            others = n.lines - n.declarations
            out += f"       named on {counted(others, 'other line')} across {counted(n.files, 'file')} (`usages` lists them)\n" if others else "       not named anywhere else in the code\n"
        out += "\n"
    hits.unpersist()
    return out


def _section(lines: list[str], heading: int) -> tuple[int, int]:
    """First and last line of the section that a heading opens (one page)."""
    level, fenced, end = len(lines[heading - 1]) - len(lines[heading - 1].lstrip("#")), False, len(lines)
    for i in range(heading, len(lines)):
        body = lines[i].lstrip()
        fenced ^= body.startswith(("```", "~~~"))
        marks = len(body) - len(body.lstrip("#"))
        if not fenced and 0 < marks <= level and body[marks : marks + 1] == " ":
            end = i
            break
    return heading, max(heading, max((i + 1 for i in range(end) if lines[i].strip()), default=heading))


def _listing(found: DataFrame, title: str, listed: str, limit: int) -> str:
    n = usages.totals(found).first()
    others = n.lines - n.declarations
    out = f"`{title}`: " + (f"{counted(n.declarations, 'declaration')}, {counted(others, 'other line')}" if n.declarations else counted(n.lines, "line")) + f" in {counted(n.files, 'file')}\n"
    rows = usages.answered(found, limit).orderBy("place", "path", "line").collect()
    declared = [r for r in rows if r.role == "declared"]
    if declared:
        out += "\nDeclared:\n" + "".join(f"{r.path}:{r.line}  {r.content}\n" for r in declared)
    out += f"\n{listed}:\n"
    for place in sorted({r.place for r in rows if r.role == "shown"}):
        own = [r for r in rows if r.place == place]
        out += f"{own[0].path}\n" + "".join(f"{r.line:>6}  {f'[{r.inside}] ' if r.inside else ''}{r.content}\n" for r in own if r.role == "shown")
        also = [str(r.line) for r in own if r.role == "also"]
        out += f"        also lines {', '.join(also)}\n" if also else ""
    left = [r for r in rows if r.role == "unshown"]
    if left:
        files = found.where(~F.col("declares")).select("file_id").distinct().count()
        more = files - len({r.file_id for r in rows if r.role == "shown"}) - len(left)
        out += "\nNot shown (pass `path` to see): " + ", ".join(f"{r.path} ({r.line})" for r in left) + (f", and {counted(more, 'more file')}" if more > 0 else "") + "\n"
    return out


def _elsewhere(corpus: Corpus, n: usages.Needle, path: str | None) -> str | None:
    shown = f"/{n.said}/" if n.kind == usages.PATTERN else f"`{n.said}`"
    if path is None:
        return None
    if corpus.files.where(F.col("path").contains(path)).isEmpty():
        return f"No indexed file has `{path}` in its path, so {shown} was not looked for."
    r = usages.elsewhere(corpus.usages(n)).first()
    if not r.files:
        return None
    return f"Nothing for {shown} under `{path}`, but {counted(r.lines, 'line')} in {counted(r.files, 'file')} elsewhere: {', '.join(r.named)}{', ...' if r.files > len(r.named) else ''}. Drop or change `path`."


def usages_of(corpus: Corpus, symbol: str, path: str | None = None, limit: int = lookup.BUDGET) -> str:
    if (said := nothing_indexed(corpus)) is not None:
        return said
    n = usages.needle(symbol)
    if not n.asked:
        return "`symbol` is empty."
    if n.qualified:
        whole = usages.Needle(usages.TEXT, n.asked, n.asked)
        written = corpus.usages(whole, path)
        if usages.is_written_in_quotes(written, n):
            return _listing(written, n.asked, "Used", limit) + f"\nFound as text, since the code writes `{n.asked}` in quotes; ask for `{n.said}` alone for the identifier.\n"
    found = corpus.usages(n, path)
    if not found.isEmpty():
        return (f"`{n.asked}` read as the identifier `{n.said}`.\n" if n.qualified else "") + _listing(found, n.said, "Used", limit)
    if n.qualified and path and usages.is_written_in_quotes(corpus.usages(whole), n):
        return _elsewhere(corpus, whole, path) or ""
    if outside := _elsewhere(corpus, n, path):
        return outside
    if n.kind == usages.WORD:
        return (f"`{n.asked}` is not written in quotes anywhere, and there are no" if n.qualified else "No") + f" whole-word occurrences of `{n.said}` in code or documents. Matching is case-sensitive; use search for a fuzzy lookup."
    return f"No occurrences of `{n.said}` as written. Matching is exact and case-sensitive; try a shorter fragment, or search."


def grep(corpus: Corpus, pattern: str, path: str | None = None, limit: int = lookup.BUDGET) -> str:
    if (said := nothing_indexed(corpus)) is not None:
        return said
    if not pattern:
        return "`pattern` is empty."
    n = usages.Needle(usages.PATTERN, pattern, pattern)
    try:
        found = corpus.usages(n, path)
    except ValueError as e:
        return f"`{pattern}` is not a regular expression: {e}"
    if not found.isEmpty():
        return _listing(found, f"/{pattern}/", "Matched", limit)
    return _elsewhere(corpus, n, path) or f"No line matches /{pattern}/ in the indexed files. Lines are matched one at a time, case-sensitively unless the expression opens with (?i)."


def _file(corpus: Corpus, row) -> str:
    one = corpus.files.where(F.col("file_id") == row.file_id)
    n = T.explode_lines(corpus.texts.where(F.col("file_id") == row.file_id).select("text")).count()
    out = f"{row.path}  ({n} lines{KIND_NOTES.get(row.kind, '')})\n"
    declared = corpus.declared.where(F.col("file_id") == row.file_id)
    blocks = outline.rule_blocks(declared).orderBy("first").collect() if not one.where(F.col("path").rlike(SHEETS)).isEmpty() else []
    if blocks:
        spans = "".join(f"{(str(b.first) if b.first == b['last'] else f'{b.first}-{b.last}'):>11}  {b.block}  ({b.n})\n" for b in blocks)
        return out + f"  {sum(b.n for b in blocks)} rules in {len(blocks)} blocks; `search` a name, or `usages` a class, for its rule:\n" + spans
    rows = corpus.outline_of(one).orderBy("line").collect()  # one file's declarations
    return out + ("".join(f"{r.line:>6}  {'  ' * r.depth}{r.text}\n" for r in rows) or "  (no declarations recognised; read the file, or search within it with `path`)\n")


def _folder(corpus: Corpus, prefix: str) -> str:
    entries = outline.directory_rollup(corpus.files.withColumn("root_id", F.lit(0)), prefix)
    below = entries.where("entry <> ''").orderBy("entry").limit(ENTRIES).collect()
    n_below, here = entries.where("entry <> ''").count(), entries.where("entry = ''").first()
    n_here = here.files if here else 0
    out = f"{prefix or './'}  ({n_here} files here, {n_below} directories)\n" + "".join(f"  {r.entry}  ({r.files} files)\n" for r in below)
    room = max(0, ENTRIES - n_below)
    own = corpus.files.where(F.col("path").startswith(prefix) & ~F.substring("path", len(prefix) + 1, 1 << 20).contains("/")).orderBy("path").limit(room)
    lines = corpus.chunks.groupBy("file_id").agg(F.max("end_line").alias("n"))
    named = outline.first_names(corpus.chunks, NAMES)
    for r in own.join(lines, "file_id", "left").join(named, "file_id", "left").orderBy("path").collect():
        k = 1 if r.kind == "Docs" else NAMES
        names = r.names or []
        out += f"  {r.path[len(prefix):]}  ({r.n or 0} lines)  {', '.join(names[:k])}{', ...' if r.more or len(names) > k else ''}\n"
    rest = n_here + n_below - ENTRIES
    return out + (f"  ... {rest} entries not shown; ask for a subdirectory\n" if rest > 0 else "")


def outline_of(corpus: Corpus, asked: str = "") -> str:
    if (said := nothing_indexed(corpus)) is not None:
        return said
    path = asked.strip().replace("\\", "/").removeprefix("./").strip("/")
    how, found = outline.lookup_path(corpus.files, asked)
    if how == "root":
        return _folder(corpus, "")
    if how == "folder":
        return _folder(corpus, path + "/")
    some = found.orderBy("path").limit(CANDIDATES).collect()
    if len(some) == 1:
        return _file(corpus, some[0])
    if some:
        n = found.count()
        return f"`{path}` matches {n} files; ask for one:\n" + "".join(f"  {r.path}\n" for r in some) + (f"  ... and {n - CANDIDATES} more\n" if n > CANDIDATES else "")
    out = f"No indexed file or directory matches `{path}`.\n"
    parents = [path[: i] for i, c in enumerate(path) if c == "/"][::-1]
    holder = next(((p, n) for p in parents if (n := corpus.files.where(F.col("path").startswith(p + "/")).count())), None)
    beside = holder[0] + "/" if holder and parents and holder[0] == parents[0] else None
    near = outline.near_names(corpus.spark.createDataFrame([(1, path, beside)], "query_id long, asked string, beside string"), corpus.files)
    names = [r.path for r in near.join(corpus.files.select("file_id", "path"), "file_id").orderBy("rank").collect()]
    out += "Closest names:\n" + "".join(f"  {x}\n" for x in names) if names else ""
    return out + (f"`{holder[0]}` exists and holds {holder[1]} files; outline it for the list.\n" if holder else "")


__all__ = ["Window", "grep", "nothing_indexed", "outline_of", "search", "usages_of"]
