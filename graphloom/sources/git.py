"""Git repositories that the driver can read: revisions, trees, and diffs of commits or the working tree."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from graphloom.sources import diffs

#: In the place of a revision: the working tree, untracked files included.
WORKTREE = ""
#: A file is binary where a NUL stands in so many of its first bytes.
SNIFFED = 8000
#: Bytes of blobs in one row's neighbourhood: a tree is handed over in batches of about that size.
BATCH = 64 << 20


def run(repo: str, *args: str) -> bytes:
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")} | {"LC_ALL": "C", "GIT_TERMINAL_PROMPT": "0"}
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, env=env)
    if done.returncode:
        raise RuntimeError(f"git {' '.join(args)}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def top(folder: str) -> str:
    """The repository that holds a folder."""
    return run(folder, "rev-parse", "--show-toplevel").decode().strip()


def resolve(repo: str, ref: str) -> str:
    """The commit that a reference names; "" where there is none."""
    try:
        return run(repo, "rev-parse", "--verify", "--quiet", ref + "^{commit}").decode().strip()
    except RuntimeError:
        return ""


def head(repo: str) -> str:
    return resolve(repo, "HEAD")


def default_base(repo: str) -> str:
    """The first of origin/HEAD, main and master that is there, else HEAD."""
    return next((ref for ref in ("origin/HEAD", "main", "master") if resolve(repo, ref)), "HEAD")


def merge_base(repo: str, a: str, b: str = "HEAD") -> str:
    return run(repo, "merge-base", a, b).decode().strip()


def files(repo: str, rev: str = WORKTREE) -> list[str]:
    """Paths of a commit's tree, or of the working tree without what git ignores."""
    out = run(repo, "ls-tree", "-r", "-z", "--name-only", rev) if rev else run(repo, "ls-files", "--cached", "--others", "--exclude-standard", "-z")
    paths = [p for p in dict.fromkeys(out.decode(errors="surrogateescape").split("\0")) if p]
    return paths if rev else [p for p in paths if os.path.lexists(os.path.join(repo, p))]


def content(repo: str, path: str) -> bytes | None:
    """Bytes of a file of the working tree; of a link, where it points; None for what is neither."""
    at = os.path.join(repo, path)
    if os.path.islink(at):
        return os.readlink(at).encode()
    if not os.path.isfile(at):
        return None
    with open(at, "rb") as f:
        return f.read()


def _blobs(repo: str, rev: str, paths: list[str]) -> Iterator[tuple[str, bytes]]:
    if not rev:
        for p in paths:
            if (data := content(repo, p)) is not None:
                yield p, data
        return
    asked = "".join(f"{rev}:{p}\n" for p in paths if "\n" not in p).encode(errors="surrogateescape")
    out = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input=asked, capture_output=True, check=True).stdout
    at = 0
    for p in (p for p in paths if "\n" not in p):
        end = out.index(b"\n", at)
        words = out[at:end].rsplit(b" ", 2)
        at = end + 1
        if words[-1] == b"missing" or len(words) < 3:
            continue
        size = int(words[2])
        if words[1] == b"blob":
            yield p, out[at : at + size]
        at += size + 1


def tree(spark: SparkSession, repo: str, rev: str = WORKTREE, below: str = "") -> DataFrame:
    """path and content of a revision's files, or of those below a folder, whose paths then begin there."""
    lead = f"{below}/" if below not in ("", ".") else ""
    paths = [p for p in files(repo, rev) if p.startswith(lead)]
    rows = [(p[len(lead) :], bytearray(data)) for p, data in _blobs(repo, rev, paths)]
    return spark.createDataFrame(rows, "path string, content binary")


def texts(spark: SparkSession, repo: str, rev: str, paths: list[str], below: str = "") -> DataFrame:
    """path (below a folder) and text of some files of a revision; those that aren't there, or aren't text, have none."""
    lead = f"{below}/" if below not in ("", ".") else ""
    there = set(files(repo, rev)) if rev else None
    rows = [(p[len(lead) :], data.decode(errors="replace").removesuffix("\n")) for p, data in _blobs(repo, rev, [lead + p for p in paths if there is None or lead + p in there]) if b"\0" not in data[:SNIFFED]]
    return spark.createDataFrame(rows, "path string, text string")


def untracked(repo: str) -> Iterator[tuple[str, str, str, bool, list[dict[str, int]]]]:
    """Files that git neither has nor ignores, as added; links have no hunks, and neither have binary or empty files."""
    for p in run(repo, "ls-files", "--others", "--exclude-standard", "-z").decode(errors="surrogateescape").split("\0"):
        at = os.path.join(repo, p)
        if not p or os.path.isdir(at) and not os.path.islink(at) or not os.path.lexists(at):
            continue
        data = b"" if os.path.islink(at) else content(repo, p) or b""
        binary = b"\0" in data[:SNIFFED]
        lines = data.count(b"\n") + (bool(data) and not data.endswith(b"\n"))
        yield "", p, "added", binary, [] if binary or not lines else [{"old_start": 0, "old_lines": 0, "new_start": 1, "new_lines": lines}]


def diff(spark: SparkSession, repo: str, base: str, rev: str = WORKTREE) -> DataFrame:
    """file_diffs from a base to a commit, or to the working tree with what is staged, not staged and untracked."""
    args = ["-c", "core.quotepath=off", "diff", "--no-color", "--no-ext-diff", "--src-prefix=a/", "--dst-prefix=b/", "-U0", "-M", base, *([rev] if rev else [])]
    rows = list(diffs.parse(run(repo, *args).decode(errors="replace")))
    if not rev:
        rows += untracked(repo)
    name = f"{base}..{rev}"
    return spark.createDataFrame([(name, *r) for r in rows], diffs.SCHEMA)
