"""Which folder a request is about, and which repository that folder belongs to."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Root:
    """A folder to answer from, the part of it asked for, and whether it is another
    folder than the home of the session."""

    path: Path
    within: str | None
    elsewhere: bool


@dataclass(frozen=True)
class Worktree:
    path: Path
    branch: str | None


def checkout(folder: Path) -> Path | None:
    """The nearest folder at or above with a ``.git`` in it."""
    return next((p for p in (folder, *folder.parents) if (p / ".git").exists()), None)


def git_folder(top: Path) -> Path | None:
    """The ``.git`` folder that a checkout and its worktrees share."""
    dot = top / ".git"
    if dot.is_dir():
        return dot.resolve()
    if not dot.is_file():
        return None
    said = dict(x.split(":", 1) for x in dot.read_text().splitlines() if ":" in x).get("gitdir")
    if said is None:
        return None
    own = (top / said.strip()).resolve()
    shared = own / "commondir"
    return (own / shared.read_text().strip()).resolve() if shared.is_file() else own


def repository(folder: Path) -> Path:
    """The main checkout of the repository a folder is in; without one, the folder."""
    top = checkout(folder)
    shared = git_folder(top) if top else None
    return shared.parent if shared is not None and shared.name == ".git" else top or folder


def worktrees(root: Path) -> list[Worktree]:
    """The linked worktrees of a main checkout that are still on disk, by path."""
    out = []
    for entry in sorted((root / ".git" / "worktrees").glob("*/gitdir")):
        path = Path(entry.read_text().strip()).parent
        head = entry.parent / "HEAD"
        said = head.read_text().strip() if head.is_file() else ""
        if path.is_dir():
            out.append(Worktree(path, said.removeprefix("ref: refs/heads/") if said.startswith("ref: refs/heads/") else None))
    return sorted(out, key=lambda w: w.path)


def too_wide(root: Path, home: Path | None = None) -> bool:
    """Whether a root is a drive, the user's home, or above it."""
    home = (home or Path(os.path.expanduser("~"))).resolve()
    return root == root.parent or home == root or root in home.parents


def _checked(root: Path) -> Path:
    if too_wide(root):
        raise ValueError(f"root {root} is too wide to index: name a repository, or a folder that holds a few of them")
    return root


def _below(top: Path, path: Path) -> str | None:
    return None if path == top else path.relative_to(top).as_posix()


def resolve(home: Path, root: str | None = None, path: str | None = None) -> Root:
    """What a request with these arguments is about. ``root`` names another folder,
    read as its checkout; an absolute ``path`` may name one too. Raises ``ValueError``
    for what doesn't exist, lies outside any repository, or is too wide."""
    home = home.resolve()
    root, path = (root or "").strip(), (path or "").strip().replace("\\", "/")
    if root:
        target = (home / root).resolve()
        if not target.exists():
            raise ValueError(f"root `{root}` does not exist (looked for {target})")
        folder = target if target.is_dir() else target.parent
        top = checkout(folder) or folder
        parts = [x for x in (_below(top, folder), path if path and not os.path.isabs(path) else None) if x]
        return Root(_checked(top), "/".join(parts) or None, top != home)
    if not os.path.isabs(path):
        return Root(home, path or None, False)
    asked = Path(os.path.normpath(path))
    there = next(p for p in (asked, *asked.parents) if p.exists())
    folder = there if there.is_dir() else there.parent
    top, inside = checkout(folder), home == folder or home in folder.parents
    if top is not None and inside and top != home and home in top.parents:
        hidden = any(x.startswith(".") for x in top.relative_to(home).parts)
        top = top if hidden or (home / ".git").exists() else home  # a checkout within a checkout stands apart
    elif inside:
        top = home
    if top is None:
        raise ValueError(f"`{path}` is outside {home} and inside no repository; pass `root` to search elsewhere")
    return Root(_checked(top), _below(top, asked), top != home)


def store_name(root: Path) -> str:
    """The name of a root's index among the stores of a user."""
    return hashlib.sha256(root.as_posix().encode()).hexdigest()[:16]


def folders() -> dict[str, Path]:
    """Where stores and settings are kept, by the conventions of the system."""
    home = Path(os.path.expanduser("~"))
    base = lambda name, default: Path(os.environ.get(name) or home / default) / "siftwell"
    return {"stores": base("XDG_CACHE_HOME", ".cache") / "stores", "settings": base("XDG_CONFIG_HOME", ".config") / "settings.json"}


def heading(home: Path, root: Root) -> str:
    """The line that opens an answer where it isn't plain which folder it is about."""
    if root.elsewhere:
        return f"in {root.path}:\n\n"
    linked = worktrees(home)
    names = ", ".join(f"{w.path} ({w.branch})" if w.branch else str(w.path) for w in linked)
    return f"Answering from {home} (main checkout). Worktrees: {names}. To ask about one, pass it as `root`.\n\n" if linked else ""
