"""From a repository to its findings, and from two revisions to what a reviewer reads.

A snapshot is produced of the sources, the churn and the rules, kept by an engine under (revision, root), and stored
with its basis: a commit's name, or the fingerprint of the working tree's files. A store's snapshot of the same
basis is read instead of produced again.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import build, graphdiff, inbox, prognoses, smells
from graphloom.plans.checkpoints import stored
from graphloom.plans.engine import Engine
from graphloom.sources import diffs, frontends, git, store
from graphloom.sources.binding import Graph
from graphloom.streaming.live import fingerprint

TABLES = ("decls", "edges", "files", "packages", "imports")
CHURN_DAYS = 90


@dataclass
class Snapshot:
    graph: Graph
    findings: DataFrame
    basis: str
    restored: bool = False


@dataclass
class Comparison:
    base: Snapshot
    head: Snapshot
    files: DataFrame  # file diffs of the root
    changes: dict[str, DataFrame]  # what `graphdiff.between` gives
    units: DataFrame


class Project:
    """One repository. `store` is a folder for snapshots; without it, nothing is kept beyond the engine's cache."""

    def __init__(self, spark: SparkSession, folder: str, store: str = "", capacity: int = 8, workers: int = 2):
        self.spark, self.repo, self.store = spark, git.top(folder), store
        pool = lambda name: spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        self.engine = Engine(self._fill, capacity=capacity, workers=workers, enter=pool)

    def roots(self, rev: str = git.WORKTREE) -> list[tuple[str, str]]:
        """(folder, language) of every project of a revision."""
        paths = self.spark.createDataFrame([(p,) for p in git.files(self.repo, rev)], "path string")
        return [(r.dir, r.lang) for r in frontends.roots(paths).collect()]

    def basis(self, rev: str, root: str) -> str:
        """What a load reads: a commit, or the working tree's fingerprint and the commit that churn counts from."""
        return rev or f"{fingerprint(os.path.join(self.repo, root))} {git.head(self.repo)}"

    def churn(self, rev: str, root: str) -> DataFrame | None:
        """path below the root, and commits that touched it in the window up to the last one."""
        if not git.head(self.repo):
            return None
        return frontends.below(diffs.commits(self.spark, self.repo, rev or "HEAD", CHURN_DAYS), root)

    def produce(self, rev: str = git.WORKTREE, root: str = ".") -> Snapshot:
        basis = self.basis(rev, root)  # before files are read, so an edit meanwhile leaves the snapshot out of date
        files = git.tree(self.spark, self.repo, rev, root)
        graph = frontends.load(files, os.path.basename(self.repo if root in ("", ".") else root), churn=self.churn(rev, root))
        return Snapshot(graph, stored(smells.union(graph)), basis)

    def snapshot(self, rev: str = git.WORKTREE, root: str = ".") -> Snapshot:
        """The snapshot of a revision's root, from the cache, the store or its sources."""
        return self.engine.get((git.resolve(self.repo, rev) if rev else rev, root))

    def refresh(self) -> None:
        """The working tree has changed: what is cached of it is loaded again."""
        for key in self.engine.cached():
            if key[0] == git.WORKTREE:
                self.engine.refresh(key)

    def prognoses(self, rev: str = git.WORKTREE, root: str = ".") -> DataFrame:
        return prognoses.find(self.snapshot(rev, root).graph)

    def compare(self, base: str, head: str = git.WORKTREE, root: str = ".", roots: list[str] | None = None) -> Comparison:
        """Both sides are loaded at once; one that lacks the root reads as empty. Files of other `roots` within it are left out."""
        with ThreadPoolExecutor(2) as pool:
            sides = [pool.submit(self._settled, rev, root) for rev in (base, head)]
        b, h = (s.result() for s in sides)
        if b is None and h is None:
            raise frontends.NoProject(f"no project in {root} at either revision")
        if b is None or h is None:
            other = frontends.empty((b or h).graph)
            nothing = Snapshot(other, smells.union(other), "")
            b, h = b or nothing, h or nothing
        files = stored(self._below(git.diff(self.spark, self.repo, base, head), root, roots))
        paths = {s: sorted({r[0] for r in files.select(f"{s}_path").collect()} - {""}) for s in ("old", "new")}  # of a diff that was read on the driver
        texts = [git.texts(self.spark, self.repo, rev, paths[s], root) for s, rev in (("old", base), ("new", head))]
        changes = graphdiff.between(b.graph, h.graph) | {"findings_delta": smells.delta(b.findings, h.findings)}
        return Comparison(b, h, files, changes, build.build(b.graph, h.graph, files, *texts, h.graph.lang in ("go", "")))

    def review(self, base: str = "", root: str = ".") -> Comparison:
        """The working tree against where it left the default branch, or a base."""
        return self.compare(base or git.merge_base(self.repo, git.default_base(self.repo)), git.WORKTREE, root)

    def folders(self, base: str, head: str = git.WORKTREE) -> list[str]:
        """Folders of the roots of either revision, so one that a change adds or removes is among them."""
        return sorted({d for rev in (base, head) for d, _ in self.roots(rev)})

    def reading(self, base: str = "", head: str = git.WORKTREE, change: str = "worktree", reviewed: DataFrame | None = None) -> DataFrame:
        """What an inbox says of a change, summed over the roots of both sides; `reviewed` are (key), ids of units."""
        base = base or git.merge_base(self.repo, git.default_base(self.repo))
        found: dict[str, list[DataFrame]] = {"units": [], "introduced": [], "files": []}
        folders = self.folders(base, head)
        for root in folders:
            c = self.compare(base, head, root, folders)
            at = [F.lit(self.repo).alias("repo"), F.lit(change).alias("change"), F.lit(root).alias("root")]
            found["units"].append(stored(c.units.select(*at, F.col("id").alias("key"), "lane", "risk")))
            found["introduced"].append(c.changes["findings_delta"].where("change = 'introduced'").select(*at))
            # every root counts the whole diff
            found["files"].append(git.diff(self.spark, self.repo, base, head).select(*at, *(n.alias(c) for c, n in build.counts().items())))
        units, introduced, files = (reduce(DataFrame.unionByName, parts) for parts in found.values())
        marks = reviewed if reviewed is not None else self.spark.createDataFrame([], "key string")
        return inbox.readings(units, introduced, files, marks.select(F.lit(self.repo).alias("repo"), "key"))

    def close(self) -> None:
        self.engine.close()

    def _settled(self, rev: str, root: str) -> Snapshot | None:
        try:
            return self.snapshot(rev, root)
        except frontends.NoProject:
            return None

    def _below(self, files: DataFrame, root: str, roots: list[str] | None) -> DataFrame:
        if roots is not None:
            known = self.spark.createDataFrame([(d,) for d in sorted({*roots, root or "."})], "dir string")
            return inbox.scoped(files, known).where(F.col("root") == (root or ".")).drop("root")
        if root in ("", "."):
            return files
        cut = lambda c: F.when(F.startswith(c, F.lit(root + "/")), F.substr(c, F.lit(len(root) + 2))).otherwise(F.lit(""))
        return files.withColumns({c: cut(c) for c in ("old_path", "new_path")}).where("old_path <> '' or new_path <> ''")

    def _fill(self, key: tuple[str, str]) -> Snapshot:
        rev, root = key
        basis = self.basis(rev, root)
        if self.store and (found := self._restored(rev, root, basis)):
            return found
        made = self.produce(rev, root)
        if self.store:
            for name, table in [*((n, getattr(made.graph, n)) for n in TABLES), ("findings", made.findings)]:
                store.save(table.withColumns({"module": F.lit(made.graph.module), "lang": F.lit(made.graph.lang)}), f"{self.store}/{name}", self.repo, root, rev or "worktree", made.basis, 0)
        return made

    def _restored(self, rev: str, root: str, basis: str) -> Snapshot | None:
        tables = {n: store.load(self.spark, f"{self.store}/{n}", self.repo, root, rev or "worktree", basis) for n in (*TABLES, "findings")}
        if tables["decls"] is None:
            return None
        first = tables["decls"].first()
        g = Graph(self.spark, None, module=first.module, lang=first.lang)
        for n in TABLES:
            # a table without rows isn't stored
            g.given[n] = tables[n].drop("module", "lang") if tables[n] is not None else self.spark.createDataFrame([], frontends.SCHEMAS[n])
        found = tables["findings"].drop("module", "lang") if tables["findings"] is not None else smells.union(g)
        return Snapshot(g, found, basis, True)
