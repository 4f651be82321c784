"""The four tools: their schemas, the checks of their arguments, and the loop that
answers requests, one JSON message a line."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession

from siftwell import __version__
from siftwell.front import answers, roots
from siftwell.front.corpus import Corpus
from siftwell.front.settings import Settings
from siftwell.operators.lookup import BUDGET
from siftwell.operators.rank import LIMIT

CONTENTS = ("code", "docs", "config", "all")
OPEN_ROOTS = 4


def _schema(required: str, **properties: dict) -> dict:
    text = {"type": "string"}
    return {"type": "object", "properties": {**{k: {**text, **v} for k, v in properties.items()}, "root": {**text, "description": "Another folder to look in."}}, "required": [required]}


TOOLS = {
    "search": ("Find code by what it does or what it is called.", _schema("query", query={"description": "What the code does, or an identifier."}, path={"description": "Only files whose path contains this."}, content={"enum": list(CONTENTS)}, limit={"type": "integer", "minimum": 1, "maximum": 30, "default": LIMIT})),
    "usages": ("Where an identifier is declared and used, or a text is written.", _schema("symbol", symbol={"description": "An identifier, or literal text."}, path={}, limit={"type": "integer", "minimum": 1, "maximum": 200, "default": BUDGET})),
    "grep": ("Lines that match a regular expression without look-around.", _schema("pattern", pattern={}, path={}, limit={"type": "integer", "minimum": 1, "maximum": 200, "default": BUDGET})),
    "outline": ("What a file declares, or what a folder holds.", _schema("path", path={"description": "A file or folder; empty for the root."})),
}


def _limit(arguments: dict, tool: str) -> int:
    rule = TOOLS[tool][1]["properties"]["limit"]
    asked = arguments.get("limit")
    return min(max(asked, rule["minimum"]), rule["maximum"]) if isinstance(asked, int) and not isinstance(asked, bool) and asked >= 0 else rule["default"]


def answer(corpus: Corpus, tool: str, arguments: dict, within: str | None) -> str:
    """The text answer to a call. Unknown contents are ignored, limits clamped; a
    missing question raises ``ValueError``."""
    said = lambda key: arguments.get(key) if isinstance(arguments.get(key), str) else None
    if tool == "search":
        if not (said("query") or "").strip():
            raise ValueError("`query` is required.")
        content = said("content") if said("content") in CONTENTS else "code"
        body = answers.search(corpus, said("query"), content, within, _limit(arguments, tool))
        return body if corpus.store.vectors() is not None else body.rstrip("\n") + "\n(lexical ranking only: the index has no vectors)"
    if tool == "outline":
        return answers.outline_of(corpus, within or "")
    key, run = ("symbol", answers.usages_of) if tool == "usages" else ("pattern", answers.grep)
    if said(key) is None:
        raise ValueError(f"`{key}` is required.")
    return run(corpus, said(key), within, _limit(arguments, tool))


class Engine:
    """Open roots by path, the least recently used going first; the home stays."""

    def __init__(self, spark: SparkSession, home: Path, settings: Settings, stores: str | None = None, most: int = OPEN_ROOTS, open_: Callable[..., Corpus] = Corpus) -> None:
        self.spark, self.home, self.settings, self.stores, self.most, self.open_ = spark, home.resolve(), settings, stores, most, open_
        self.opened: OrderedDict[Path, Corpus] = OrderedDict()

    def corpus(self, root: Path) -> Corpus:
        kept = f"{self.stores}/{roots.store_name(root)}" if self.stores else None
        self.opened[root] = self.opened.pop(root, None) or self.open_(self.spark, str(root), kept)
        while len(self.opened) > self.most:
            self.opened.pop(next(r for r in self.opened if r not in (self.home, root)))
        return self.opened[root]

    def call(self, params: dict) -> dict:
        tool, arguments = params.get("name"), params.get("arguments") or {}
        text = lambda body, **more: {"content": [{"type": "text", "text": body}], **more}
        if tool not in TOOLS:
            return text(f"Unknown tool `{tool}`. The tools are {', '.join(f'`{t}`' for t in TOOLS)}.", isError=True)
        try:
            root = roots.resolve(self.home, arguments.get("root"), arguments.get("path"))
            if root.elsewhere and not self.settings.allows(self.home, root.path):
                return text(self.settings.refusal(self.home, root.path), **({} if tool == "outline" else {"isError": True}))
            return text(roots.heading(self.home, root) + answer(self.corpus(root.path), tool, arguments, root.within))
        except ValueError as e:
            return text(str(e), isError=True)


def serve(engine: Engine, lines: Iterable[str]) -> Iterator[str]:
    """A reply for each request. Lines that aren't JSON objects, and notifications,
    get none."""
    for line in lines:
        try:
            message = json.loads(line)
        except ValueError:
            continue
        if not isinstance(message, dict) or message.get("id") is None:
            continue
        params = message.get("params") if isinstance(message.get("params"), dict) else {}
        method, reply = message.get("method"), {"jsonrpc": "2.0", "id": message["id"]}
        if method == "initialize":
            reply["result"] = {"protocolVersion": params.get("protocolVersion") or "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "siftwell", "version": __version__}, "instructions": f"Answers are about {engine.home}. For another checkout pass it as `root`."}
        elif method == "ping":
            reply["result"] = {}
        elif method == "tools/list":
            reply["result"] = {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s) in TOOLS.items()]}
        elif method == "tools/call":
            reply["result"] = engine.call(params)
        else:
            reply["error"] = {"code": -32601, "message": "method not found"}
        yield json.dumps(reply)
