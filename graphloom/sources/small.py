"""Small stores in JSON files: notes, threads, baskets and the registry of repositories. Each write is whole or not at all."""

from __future__ import annotations

import hashlib
import os
import re
import secrets
import shutil
import threading
from dataclasses import dataclass, field
from datetime import UTC, datetime
from urllib.parse import urlsplit

from graphloom.sources import git
from graphloom.sources.store import read_json, write_json


@dataclass
class Rows:
    """Rows with an `id`, in the order that they were first stored; a missing file has none."""

    path: str
    _lock: threading.RLock = field(default_factory=threading.RLock)

    def all(self) -> list[dict]:
        with self._lock:
            return read_json(self.path, [])

    def get(self, id: str) -> dict | None:
        return next((r for r in self.all() if r["id"] == id), None)

    def add(self, row: dict) -> dict:
        """Stores a row under a new id."""
        return self.put(row | {"id": secrets.token_hex(6)})

    def put(self, row: dict) -> dict:
        """Stores a row in the place of the one with its id, or as the last."""
        with self._lock:
            rows = self.all()
            at = next((i for i, r in enumerate(rows) if r["id"] == row["id"]), len(rows))
            rows[at : at + 1] = [row]
            write_json(self.path, rows)
        return row

    def delete(self, id: str) -> None:
        with self._lock:
            rows = self.all()
            if any(r["id"] == id for r in rows):
                write_json(self.path, [r for r in rows if r["id"] != id])


class Notes(Rows):
    """Notes on lines of a change (scope, file, side, line, text, resolved)."""

    def resolve(self, id: str, resolved: bool = True) -> None:
        with self._lock:
            note = self.get(id)
            if note is None:
                raise KeyError(f"no note {id}")
            self.put(note | {"resolved": resolved})


@dataclass
class Baskets:
    """Ordered items (with a `key`) and an introduction, by name."""

    path: str
    _lock: threading.RLock = field(default_factory=threading.RLock)

    def get(self, name: str) -> dict:
        with self._lock:
            return read_json(self.path, {}).get(name, {"intro": "", "items": []})

    def _write(self, name: str, basket: dict) -> None:
        write_json(self.path, read_json(self.path, {}) | {name: basket})

    def add(self, name: str, item: dict) -> bool:
        """Whether the item is new; one of the same key stays where it is."""
        with self._lock:
            b = self.get(name)
            if any(x["key"] == item["key"] for x in b["items"]):
                return False
            self._write(name, b | {"items": [*b["items"], item]})
            return True

    def remove(self, name: str, key: str) -> None:
        with self._lock:
            b = self.get(name)
            self._write(name, b | {"items": [x for x in b["items"] if x["key"] != key]})

    def move(self, name: str, key: str, to: int) -> None:
        """To a place from 0, or the nearest that there is."""
        with self._lock:
            b = self.get(name)
            item = [x for x in b["items"] if x["key"] == key]
            rest = [x for x in b["items"] if x["key"] != key]
            at = max(0, min(to, len(rest)))
            self._write(name, b | {"items": [*rest[:at], *item, *rest[at:]]})

    def introduce(self, name: str, intro: str) -> None:
        with self._lock:
            self._write(name, self.get(name) | {"intro": intro})


def parse_url(arg: str) -> tuple[str, str, str] | None:
    """Host, owner and name of a git URL (scheme://… or user@host:path); None for a local path."""
    if "://" in arg:
        parts = urlsplit(arg)
        host, path = parts.hostname or "local", parts.path
    elif m := re.match(r"^[^@/\s]+@([^:/\s]+):(.+)$", arg):
        host, path = m.groups()
    else:
        return None
    steps = [x for x in path.rstrip("/").removesuffix(".git").split("/") if x and x != "."]
    return (host, steps[-2] if len(steps) > 1 else "_", steps[-1]) if steps else None


def repo_id(name: str, key: str) -> str:
    slug = re.sub("[^a-z0-9]+", "-", name.lower()).strip("-") or "repo"
    return f"{slug}-{hashlib.sha256(key.encode()).hexdigest()[:6]}"


class Registry(Rows):
    """Repositories by id: local checkouts, and URLs that are cloned below a folder."""

    def __init__(self, path: str, clones: str):
        super().__init__(path)
        self.clones = clones

    def register(self, arg: str) -> dict:
        """The entry of a path or URL; what is registered already stays as it is."""
        if found := parse_url(arg):
            if ".." in found:
                raise ValueError(f"not a usable git URL: {arg}")
            row = {"id": repo_id(found[2], arg), "name": found[2], "url": arg, "clone": os.path.join(self.clones, *found)}
        else:
            top = git.top(os.path.abspath(arg))
            row = {"id": repo_id(os.path.basename(top), top), "name": os.path.basename(top), "path": top}
        with self._lock:
            if have := self.get(row["id"]):
                return have
            if "clone" in row:
                os.makedirs(os.path.dirname(row["clone"]), exist_ok=True)
                git.run(os.path.dirname(row["clone"]), "clone", "--filter=blob:none", "--quiet", arg, row["clone"])
            return self.put(row | {"added": datetime.now(UTC).isoformat()})

    def forget(self, id: str) -> None:
        """Drops an entry, and its clone where it has one below the folder of clones; a local checkout is never touched."""
        with self._lock:
            row = self.get(id)
            self.delete(id)
        if not row or "clone" not in row:
            return
        inside = os.path.relpath(row["clone"], self.clones)
        if inside == "." or inside.startswith(".."):
            raise ValueError(f"{row['clone']} is outside of {self.clones}: left alone")
        shutil.rmtree(row["clone"], ignore_errors=True)
