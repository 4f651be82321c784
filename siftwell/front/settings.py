"""Settings of a user: which folders a repository's sessions may read besides it,
and how long unused stores are kept."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from siftwell.front.roots import git_folder, repository, worktrees
from siftwell.operators.manifest import FORMAT, Folder

DEFAULT_DAYS, LEFT_ASIDE_S = 30, 3600


class Settings:
    def __init__(self, file: Path) -> None:
        self.file = file
        try:
            self.said = json.loads(file.read_text())
        except FileNotFoundError:
            self.said = {}
        if not isinstance(self.said, dict):
            raise ValueError(f"{file} is not a JSON object; fix or delete it")

    def save(self) -> None:
        self.file.parent.mkdir(parents=True, exist_ok=True)
        aside = self.file.with_suffix(".json.tmp")
        aside.write_text(json.dumps(self.said, indent=2) + "\n")
        os.replace(aside, self.file)

    def _access(self) -> dict[str, list[str]]:
        table = self.said.get("access")
        return table if isinstance(table, dict) else {}

    def granted(self, repo: Path) -> list[Path]:
        dirs = self._access().get(repo.as_posix())
        return [Path(d) for d in dirs if isinstance(d, str)] if isinstance(dirs, list) else []

    def grant(self, repo: Path, folder: Path) -> bool:
        if folder in self.granted(repo):
            return False
        self.said["access"] = {**self._access(), repo.as_posix(): [x.as_posix() for x in (*self.granted(repo), folder)]}
        return True

    def revoke(self, repo: Path, folder: Path | None = None) -> bool:
        """Takes back one folder, or with none all that a repository was given."""
        had = self.granted(repo)
        left = [] if folder is None else [d for d in had if d != folder]
        self.said["access"] = {k: v for k, v in self._access().items() if k != repo.as_posix()} | ({repo.as_posix(): [d.as_posix() for d in left]} if left else {})
        return len(left) < len(had)

    def allows(self, home: Path, top: Path) -> bool:
        """Whether sessions at ``home`` may read ``top``: below it, another checkout of
        the same repository, or below a granted folder."""
        repo = repository(home)
        below = lambda d: d == top or d in top.parents
        same = (top / ".git").exists() and (repo / ".git").exists() and git_folder(top) == git_folder(repo)
        return below(home) or same or any(map(below, self.granted(repo)))

    def refusal(self, home: Path, top: Path) -> str:
        repo = repository(home)
        readable = [str(home)] + [f"{w.path} (worktree)" for w in worktrees(repo) if w.path != home] + [str(d) for d in self.granted(repo)]
        return f"`{top}` is outside this repository, and sessions here have not been given access to it. Run, in {repo}:\n    siftwell access add \"{top}\"\nReadable now: {', '.join(readable)}."

    @property
    def days(self) -> int | None:
        """Days after which an unused store goes; None for never."""
        cache = self.said.get("cache")
        days = cache.get("clean_after_days", DEFAULT_DAYS) if isinstance(cache, dict) else DEFAULT_DAYS
        return days or None

    @days.setter
    def days(self, value: int | None) -> None:
        self.said["cache"] = {"clean_after_days": value or 0}


def standing(stores: Folder, name: str, now: float) -> str:
    """'current', 'outdated' (another format) or 'left_aside' (no manifest, an hour
    after its last change) of one store below ``stores``."""
    numbers = [x for x in stores.names(name, "manifests") if x.isdigit()]
    if not numbers:
        return "left_aside" if now - stores.age_and_size(name)[0] > LEFT_ASIDE_S else "current"
    try:
        said = json.loads(stores.read_text(name, "manifests", max(numbers, key=int)))
    except ValueError:
        return "outdated"
    return "current" if said.get("format") == FORMAT else "outdated"


def prune(stores: Folder, days: int | None, now: float | None = None) -> tuple[int, int]:
    """Removes stores that are outdated, left aside, or unused for ``days`` (None keeps
    those). The stores removed, and their bytes."""
    now = time.time() if now is None else now
    count = size = 0
    for name in stores.names():
        used, held = stores.age_and_size(name)
        if stores.exists(name, "manifests"):
            used = max(used, stores.age_and_size(name, "manifests")[0])
        if standing(stores, name, now) != "current" or (days is not None and now - used > days * 86_400):
            stores.drop(name)
            count, size = count + 1, size + held
    return count, size
