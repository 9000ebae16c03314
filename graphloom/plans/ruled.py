"""Queries that run the operators of rules over the graph's tables; DuckDB's texts state the rules anew."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.hashes import LEVELS, changed_leaves, digest_tree, fnv1a64
from graphloom.operators import build, evidence, graphdiff, handoff, inbox, items, layout, prognoses, sites, smells
from graphloom.plans import oracle, portable, walked
from graphloom.plans.checkpoints import folder, stored
from graphloom.plans.portable import TREE
from graphloom.sources import diffs, frontends
from graphloom.sources.binding import Graph, both_kept, bound, versions
from graphloom.streaming import live

#: Scopes of all kinds, some without their parts.
SCOPES = "select k, case k % 6 when 0 then 'wt' when 1 then 'commit:' || substr(id, 1, 7) when 2 then 'pr:' || cast(k as string) || '@' || name when 3 then 'pr:' || cast(k as string) || '@a@b' when 4 then 'pr:' || cast(k as string) else name end as scope from {decls}"

#: A tree's paths, with sources of all languages, hidden folders and files that nobody watches.
LISTING = (
    "select path, size, mtime from ({tree}) t union all select case k % 12 when 0 then 'src/a' || cast(k as string) || '.mts' when 1 then '.cache/x' || cast(k as string) || '.py' when 2 then 'jl/src/m' || cast(k as string) || '.jl' when 3 then 'doc/p' || cast(k as string) || '.md' when 4 then 'x' || cast(k as string) || '/Cargo.lock' when 5 then 'web/node_modules/y' || cast(k as string) || '.js'"
    " when 6 then 'rs/_t/l' || cast(k as string) || '.rs' when 7 then 'go.mod.bak' || cast(k as string) when 8 then 'w' || cast(k as string) || '.jsx' when 9 then 'a/.b/c/s' || cast(k as string) || '.cjs' when 10 then 'py/z' || cast(k as string) || '.py' else 'notes' || cast(k as string) || '.toml' end as path, k % 900 as size, k * 11 as mtime from {decls}"
).replace("{tree}", TREE)

#: The same listing after some saves, with files gone and new ones.
LATER = "select path, case when size % 57 = 3 then size + 1 else size end as size, case when size % 57 = 4 then mtime + 1 else mtime end as mtime from ({listing}) l where size % 101 <> 7 union all select path || '.ts' as path, size, mtime from ({listing}) l where size % 101 = 8".replace("{listing}", LISTING)

#: Commits: events of a kind are a repository's, on a file of its user's.
COMMITS = "select event_type as repo, cast(event_id as string) as sha, ts, 'f' || cast(user_id % 150 as string) as path from {events}"

#: Source lines: what declares a declaration, what names its callees (in comments, in longer words, or as calls), and others. Files end before some of their declarations.
SOURCE = """
with c as (select src, dst, row_number() over (partition by src order by dst) as r from (select distinct src, dst from {edges} where kind = 'caller') x),
  d as (select id, path, start_line, end_line, k, substr(name, position('.' in name) + 1) as short, name from {decls} where k % 31 <> 5),
  l as (select d.path, d.start_line as line, case when d.k % 3 = 0 then 'def ' || d.short || '(' when d.k % 3 = 1 then '  func (x T' || cast(d.k % 20 as string) || ') ' || d.short || '()' else d.short || ' = ' end || case when d.k % 5 = 1 then coalesce(z.short, '') || ')' else ')' end as text, 0 as o from d left join c on c.src = d.id and c.r = 1 left join d z on z.id = c.dst
    union all select d.path, d.start_line + c.r as line, case c.r % 4 when 1 then case when d.k % 2 = 0 then '  // ' || z.short else '  ' || z.short || '()' end when 2 then 'x' || z.short || ' + 1' when 3 then '  return a.' || z.short || '(1) + ' || z.short else '#' || z.short end as text, 1 as o from c join d on d.id = c.src join d z on z.id = c.dst where d.start_line + c.r <= d.end_line)
select path, line, min(text) as text from l group by path, line
"""
CALLS = "select distinct src, dst from {edges} where kind = 'caller'"

#: Notes on lines of both sides and on units, of several changes; keys of units as they are now, and what the page shows.
MARGIN = """
select 'n' || cast(k as string) as id, case k % 5 when 0 then 'pr:7@aaa' when 1 then 'pr:7@bbb' when 2 then 'pr:8@aaa' when 3 then 'wt' else 'pr:7@bbb' end as scope, case when k % 13 = 0 then 'tools' else '.' end as root, k % 7 = 0 as resolved,
  case when k % 4 = 0 then id || '@' || cast(k % 3 as string) else '' end as unit_key, path as file, case when k % 6 = 0 then '-' else '+' end as side, start_line as line, case when k % 9 = 0 then '' when k % 10 = 1 then 'other' else name end as text from {decls}
"""
MARGIN_UNITS = "select id || '@0' as unit_key from {decls} where k % 8 = 0"
MARGIN_LINES = "select path as file, side, start_line as line, case when k % 22 = 5 then 'edited' else name end as text from {decls} d, (select '+' as side union all select '-' as side) s where k % 17 <> 2"
MARGIN_SHOWN = "select path as file, '+' as side, start_line as line from {decls} where k % 3 <> 0"

#: Files of a change, whose sources are of Go by name; some are none, or in neither version.
DIFF_FILES = """
with p as (select path, max(k) as k from (select path, k from {base_decls} union all select path, k from {head_decls}) x group by path)
select case when k % 11 = 0 then '' else name end as old_path, case when k % 13 = 0 then '' else name end as new_path from (select k, case when k % 5 = 0 then replace(path, '.src', '.md') when k % 7 = 0 then 'new/' || replace(path, '.src', '.go') else replace(path, '.src', '.go') end as name from p) x where k % 143 <> 0
"""

#: Whole files of a change, with their texts' lines.
WHOLE_FILES = """
select case k % 9 when 0 then 'go.sum' when 1 then 'm' || cast(k as string) || '/go.mod' when 2 then 'a/testdata/' || cast(k as string) || '.txt' when 3 then 'Manifest.toml' when 4 then 'doc/' || cast(k as string) || '.md' when 5 then 'in/' || cast(k as string) || '.go' when 6 then 'x/' || cast(k as string) || '_test.go' when 7 then 'go.mod' else 'img/' || cast(k as string) || '.png' end as path, k,
  case k % 4 when 0 then 'added' when 1 then 'deleted' when 2 then 'renamed' else 'modified' end as status, k % 9 = 8 as binary, k % 23 = 0 as generated, k % 60 as added, k % 37 as deleted, case when k % 50 = 7 then 2100 else k % 5 end as old_n, case when k % 50 = 7 then 2000 else k % 3 end as new_n
from {decls} where k % 9 not in (0, 3, 7) or k < 9
"""


def _graph(spark: SparkSession, sf_dir: str, *names: str) -> Graph:
    return bound(spark, sf_dir).kept(*names) if names else bound(spark, sf_dir)


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).sql(SCOPES).select("k", handoff.scope_text(F.col("scope")).alias("text"))


def watched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).sql(LISTING).where(frontends.watched(F.col("path"))).select("path").distinct()


def project_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontends.roots(_graph(spark, sf_dir).sql(TREE).select("path"))


def roots_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of either version, by folder."""
    trees = [frontends.roots(g.sql(TREE).select("path")).select("dir") for g in versions(spark, sf_dir)]
    return trees[0].union(trees[1]).distinct()


def churn_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.windowed(_graph(spark, sf_dir).sql(COMMITS), 7)


def churn_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a stream of the events, as it stands after what is there now."""
    # a pattern, as a stream's path that is none must be a folder
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")
    at = f"{folder(spark)}/churn-{uuid.uuid4().hex}"
    kept = live.Churn(spark, f"{at}/kept", 7)
    kept.follow(spark.sql(COMMITS, events=events), f"{at}/checkpoint").awaitTermination()
    return kept.now()


def insets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _graph(spark, sf_dir).decls
    rect = [F.col(c).cast("double") for c in ("k", "start_line", "lines", "complexity")]
    moved = layout.inset(*rect, (F.col("k") % 9).cast("double") + 0.5)
    return d.select("id", *(c.alias(n) for c, n in zip(moved, "xywh", strict=True)))


def related_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related places of prognoses, with the first prognosis of each place's own, in the order that all are shown in."""
    g = _graph(spark, sf_dir, "decls", "edges", "files", "imports", "refs")
    every = stored(prognoses.union(g))
    own = every.select(F.col("target").alias("id"), F.struct(F.lit(0) - F.col("level"), "lens", F.col("key")).alias("rank"))
    rel = stored(evidence.related(g, least=20, share=5))
    first = rel.hint("merge").join(own, "id").where(F.col("rank.key") != F.col("key")).groupBy("key", "pos").agg(F.min("rank").alias("rank"))
    return rel.hint("merge").join(first, ["key", "pos"], "left").select("key", "pos", "id", F.coalesce("rank.key", F.lit("")).alias("own_key"))


def unit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of units' cards by their keys, and of hops by both ends."""
    g = _graph(spark, sf_dir)
    units = g.decls.select("id", F.lit("").alias("parent"), F.concat(F.lit("u"), fnv1a64(F.concat("id", F.lit("@"), "shape"))).alias("block"))
    hops = g.sql(CALLS).select(F.col("src").alias("id"), F.col("dst").alias("parent"), F.concat(F.lit("h"), fnv1a64(F.concat("dst", F.lit("\0"), "src"))).alias("block"))
    return units.unionByName(hops)


def _row():
    return F.concat_ws(" ", "path", F.col("size").cast("string"), F.col("mtime").cast("string"))


def fingerprint_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of a listing by top folder, down to leaves of it."""
    rows = _graph(spark, sf_dir).sql(LISTING).withColumn("root", F.split_part("path", F.lit("/"), F.lit(1))).distinct()
    return digest_tree(rows, ["root"], "path", _row())


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two listings, by descending their trees: only rows of unequal leaves are compared."""
    g = _graph(spark, sf_dir, "decls")
    old, new = (stored(g.sql(q).distinct()) for q in (LISTING, LATER))
    leaves = changed_leaves(*(stored(digest_tree(t, [], "path", _row())) for t in (old, new)), [])
    leaf = F.substr(F.sha2("path", 256), F.lit(1), F.lit(LEVELS[0]))
    a, b = (t.withColumn("node", leaf).join(leaves, "node", "left_semi").select("path", "size", "mtime") for t in (old, new))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("path").distinct()


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir, "decls", "edges")
    lines = spark.sql(SOURCE, decls=g.decls.hint("merge"), edges=g.edges.hint("merge"))
    return sites.call_sites(lines, g.decls, g.sql(CALLS))


def margin_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open notes of pull request 7 in the root, with what has become of them."""
    g = _graph(spark, sf_dir, "decls")
    return sites.notes_on(*(g.sql(q) for q in (MARGIN, MARGIN_UNITS, MARGIN_LINES, MARGIN_SHOWN)), scope="pr:7@ccc", root=".")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = versions(spark, sf_dir)
    files = spark.sql(DIFF_FILES, base_decls=base.decls, head_decls=head.decls)
    for g in (base, head):
        g.given["files"] = g.files.withColumn("path", F.replace("path", F.lit(".src"), F.lit(".go")))
        g.__dict__.pop("files", None)
    return build.routed(files, base, head).select("old_path", "new_path", "path", "whole", "generated")


def file_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _graph(spark, sf_dir).sql(WHOLE_FILES)
    hunk = F.array(F.struct(F.lit(1).alias("old_start"), F.col("deleted").alias("old_lines"), F.lit(1).alias("new_start"), F.col("added").alias("new_lines")))
    files = f.select("path", F.when(F.col("status") == "renamed", F.concat(F.lit("was/"), "path")).otherwise(F.col("path")).alias("old_path"), F.col("path").alias("new_path"), "status", "binary", "generated", hunk.alias("hunks"))
    # n lines of a word each; the new text of a Go file has comments more, and every other one a word more
    text = lambda n, word: F.when(n > 0, F.array_join(F.array_repeat(word, n.cast("int")), "\n")).otherwise(F.lit(""))
    old = f.select(F.when(F.col("status") == "renamed", F.concat(F.lit("was/"), "path")).otherwise(F.col("path")).alias("path"), text(F.col("old_n"), F.lit("a")).alias("text"))
    new = f.select("path", F.when(F.endswith("path", F.lit(".go")) & (F.col("old_n") > 0) & (F.col("old_n") < 2000), F.concat(text(F.col("old_n"), F.lit("a // x")), F.when(F.col("k") % 2 == 0, F.lit("\nb")).otherwise(F.lit("")))).otherwise(text(F.col("new_n"), F.lit("c"))).alias("text"))
    return build.file_units(files, old, new).select("id", "change", "lane", "risk", "reasons", "added", "deleted")


def finding_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir, "decls", "edges", "files", "imports", "refs")
    excerpts = handoff.excerpt(walked.file_lines(g), g.decls)
    made = items.finding_items(smells.union(g), "wt", "tools", excerpts)
    return made.select("key", "title", "place", "body", "check", F.array_join("code", "\n").alias("code"))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of findings (two kinds), of threads of two steps, and of lines."""
    g = _graph(spark, sf_dir, "decls", "edges", "files", "imports", "refs")
    found = stored(smells.union(g))
    lines = g.decls.select(F.lit("line").alias("of"), items.line_key(F.col("path"), F.when(F.col("test"), "-").otherwise("+"), F.col("start_line")).alias("key"))
    threads = g.sql(CALLS).select(F.lit("thread").alias("of"), items.thread_key(F.array("dst", "src")).alias("key"))
    return found.select(F.lit("finding").alias("of"), items.finding_key().alias("key")).unionByName(found.select(F.lit("smell").alias("of"), items.smell_key().alias("key"))).unionByName(lines).unionByName(threads)


#: Changes of three kinds over two roots, and what their pull requests say of them.
CHANGED = "select id, path as file, k, 'c' || cast(k % 3 as string) as change, case when b % 2 = 0 then '.' else 'tools' end as root from {head_decls} where k % 17 = 0 or k % 29 = 0"
PULLS = "select 'c' || cast(k % 40 as string) as change, k % 3 = 0 as ready, lines as added, complexity as deleted, case when k % 4 <> 0 then k % 90 end as pr_added, case when k % 4 <> 0 then k % 70 end as pr_deleted, k from {decls}"


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = both_kept(*versions(spark, sf_dir))
    units = spark.sql(CHANGED, head_decls=head.decls)
    delta = graphdiff.findings_delta(base, head).where("change = 'introduced'").drop("change")
    introduced = delta.join(units.select(F.col("id").alias("decl"), "change", "root"), "decl").select("change", "root")
    return items.summaries(units, introduced, units.select("change", "root", (F.col("k") % 50).alias("added"), (F.col("k") % 31).alias("deleted")))


def shown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.change_lines(_graph(spark, sf_dir).sql(PULLS)).select("k", "shown_added", "shown_deleted")


def lens_heats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heat of every declaration through each lens."""
    g = _graph(spark, sf_dir, "decls", "edges", "files", "imports", "refs")
    found = smells.union(g).where("decl <> ''").groupBy(F.col("decl").alias("id")).agg(F.sum(F.get(F.array(*map(F.lit, items.WEIGHTS)), F.col("severity").cast("int"))).alias("weight"), F.max("severity").alias("worst"))
    d = stored(g.decls.join(g.files.select("pkg", "path", "churn"), ["pkg", "path"]).join(found, "id", "left").select("id", "churn", "complexity", "worst", (100 * F.coalesce("weight", F.lit(0)) / F.greatest("lines", F.lit(1))).alias("smells"), (F.col("churn") * F.col("complexity")).alias("hotspot")))
    tops = F.broadcast(d.agg(F.max("churn").alias("top_churn"), F.max("hotspot").alias("top_hotspot")))  # one row
    none = F.lit(0)
    values = {"smells": none, "complexity": none, "churn": F.col("top_churn"), "hotspot": F.col("top_hotspot")}
    heats = [F.struct(F.lit(n).alias("lens"), items.heat(n, F.col(n), top, F.col("worst") if n == "smells" else None).alias("heat")) for n, top in values.items()]
    return d.crossJoin(tops).select("id", F.explode(F.array(*heats)).alias("h")).select("id", "h.*")


def _source_lines(decls: DataFrame, edited: bool) -> DataFrame:
    """path, line and text of files whose lines tell their declaration, with blank ones between; some are other in the later version."""
    mark = F.when(F.lit(edited) & (F.col("k") % 46 == 0), "!").otherwise("")
    after = F.lead("start_line").over(Window.partitionBy("path").orderBy("start_line"))
    upto = decls.select("path", "start_line", "end_line", F.concat("name", mark, F.lit(":")).alias("said"), F.greatest("end_line", F.coalesce(after - 1, F.col("end_line"))).alias("upto"))
    lines = upto.withColumn("line", F.explode(F.sequence("start_line", "upto")))
    return lines.select("path", "line", F.when(F.col("line") <= F.col("end_line"), F.concat("said", (F.col("line") - F.col("start_line")).cast("string"))).otherwise("").alias("text"))


def merged_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a change in which a declaration that has moved is one."""
    from graphloom.plans.registry import _units

    base, head = both_kept(*versions(spark, sf_dir), "decls", "edges")
    made = build.merged_moves(stored(_units(base, head)), base, head, _source_lines(base.decls, False), _source_lines(head.decls, True))
    return made.select("id", "file", "change", "lane", "risk", "reasons")


#: Items of baskets: two repositories, kinds that are known and one that isn't.
BASKET = "select pkg as basket, k as pos, 'r' || cast(k % 2 as string) as repo, case when k % 2 = 0 then 'zeta' else 'alpha' end as repo_name, case k % 6 when 0 then 'thread' when 1 then 'note' when 2 then 'prognosis' when 3 then 'finding' when 4 then 'introduced' else 'extra' end as kind, id from {decls}"


def basket_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handoff.grouped(_graph(spark, sf_dir).sql(BASKET)).select("basket", "kind", "id", "place")


#: Roots of projects in a tree, some within others.
NESTED = "select '.' as dir union select split_part(path, '/', 1) as dir from {head_decls} where k % 3 = 0 and path like '%/%' union select split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as dir from {head_decls} where k % 5 = 0 and path like '%/%/%'"
#: Units of changes in five repositories, over two roots; c0 is a working tree, the others are pull requests, and one isn't read yet.
INBOX_UNITS = "select id as key, lane, risk, added, deleted, 'r' || cast(length(file) % 5 as string) as repo, 'c' || cast(length(name) % 4 as string) as change, case when length(id) % 3 = 0 then 'tools' else '.' end as root from {units}"
INBOX_CHANGES = "select distinct repo, change, case when change <> 'c0' then cast(substr(change, 2) as bigint) end as number from {inbox_units} union select distinct repo, 'c9' as change, cast(9 as bigint) as number from {inbox_units}"
INBOX_REPOS = "select distinct repo, case repo when 'r0' then 'zeta' when 'r1' then 'beta' else 'alpha' end as name from {inbox_units} union select 'r9' as repo, 'empty' as name from {inbox_units}"
INBOX_FILES = "select repo, change, root, added, deleted from {inbox_units}"
INBOX_MARKS = "select repo, key from {inbox_units} where length(key) % 4 = 0"
CARD_ROOTS = "select 'r' || cast(length(path) % 5 as string) as repo, pkg as dir, case length(pkg) % 3 when 0 then 'go' when 1 then 'python' else 'rust' end as lang, churn > 3 as ready from {files}"
CARD_PROGNOSES = "select 'r' || cast(length(key) % 5 as string) as repo, level from {all_prognoses}"


def scoped_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both paths of every changed file by the root that holds them, below it."""
    base, head = versions(spark, sf_dir)
    files = spark.sql(DIFF_FILES, base_decls=base.decls, head_decls=head.decls)
    return inbox.scoped(files, spark.sql(NESTED, head_decls=head.decls)).select("root", "old_path", "new_path")


def _inbox(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Units of the inbox's changes, and what each change asks of a reader."""
    base, head = both_kept(*versions(spark, sf_dir))
    units = stored(spark.sql(INBOX_UNITS, units=portable._units(spark, base, head)))
    delta = graphdiff.findings_delta(base, head).where("change = 'introduced'")
    introduced = delta.select(F.col("decl").alias("key")).join(units, "key").select("repo", "change", "root")
    of_units = lambda sql: spark.sql(sql, inbox_units=units)
    return units, inbox.readings(units, introduced, of_units(INBOX_FILES), of_units(INBOX_MARKS))


def inbox_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, read = _inbox(spark, sf_dir)
    made = inbox.inbox(spark.sql(INBOX_CHANGES, inbox_units=units), spark.sql(INBOX_REPOS, inbox_units=units), read)
    roots = F.array_join(F.transform("roots", lambda r: F.concat(r["dir"], F.lit(":"), r["units"].cast("string"))), ",")
    return made.withColumn("roots", F.coalesce(roots, F.lit("")))


def repo_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = versions(spark, sf_dir)
    units = stored(spark.sql(INBOX_UNITS, units=portable._units(spark, base, head)))
    g = bound(spark, sf_dir, base.sources).kept("decls", "edges", "files", "imports", "refs")
    levels = spark.sql(CARD_PROGNOSES, all_prognoses=prognoses.union(g))
    pulls = spark.sql(INBOX_CHANGES, inbox_units=units).where("number is not null")
    made = inbox.cards(spark.sql(INBOX_REPOS, inbox_units=units), g.sql(CARD_ROOTS), levels, pulls)
    return made.withColumn("langs", F.array_join("langs", ", "))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sc20_scope": scopes,
    "flt15_watched": watched_files,
    "src03_roots": project_roots,
    "set05_roots_union": roots_of_both,
    "src22_churn": churn_window,
    "st07_churn_stream": churn_stream,
    "tm02_inset": insets,
    "ui08_related_refs": related_refs,
    "ui10_unit_ids": unit_ids,
    "sc18_fingerprint_tree": fingerprint_tree,
    "sc18_changed_files": changed_files,
    "sc19_named_sites": call_sites,
    "ui04_margin_notes": margin_notes,
    "rv01_routes": routes,
    "rv05_file_units": file_units,
    "ui01_finding_items": finding_items,
    "sc16_keys": keys,
    "agg14_summary": summary,
    "ui06_pull_lines": shown_lines,
    "sc07_lens_heats": lens_heats,
    "win11_basket_groups": basket_groups,
    "flt09_scoped_diffs": scoped_diffs,
    "en10_inbox": inbox_rows,
    "en10_cards": repo_cards,
    "rv11_merged_moves": merged_moves,
}

_WINDOW = "select c.repo, c.path, count(distinct c.sha) as churn from {commits} c where c.ts >= (select max(l.ts) from {commits} l where l.repo = c.repo) - interval 7 days group by c.repo, c.path"
_ROOTS = portable.ROOTS
_DECLARES = r"'^(func |def |fn |pub fn |function |export function |async function |export async function )'"
ORACLES = {
    "sc20_scope": "select k, case when scope = 'wt' then 'working tree' when scope like 'commit:%' then 'commit ' || scope[8:] when scope like 'pr:%' then 'PR #' || regexp_extract(scope, '^pr:([^@]*)', 1) || ' at ' || regexp_extract(scope, '^pr:[^@]*@(.*)$', 1) else scope end as text from {scopes}",
    "flt15_watched": r"select distinct path from {listing} where regexp_matches(path, '(^|/)(go\.mod|go\.sum|Project\.toml|Manifest\.toml|package\.json|tsconfig\.json|pyproject\.toml|setup\.py|Cargo\.toml|Cargo\.lock)$|\.(go|jl|[cm]?ts|tsx|[cm]?js|jsx|py|rs)$') and not regexp_matches(path, '(^|/)(\.[^/]*|vendor|testdata|node_modules)/')",
    "src03_roots": _ROOTS,
    "set05_roots_union": f"select dir from ({_ROOTS.replace('{tree}', '{base_tree}')}) union select dir from ({_ROOTS.replace('{tree}', '{head_tree}')})",
    "src22_churn": _WINDOW,
    "st07_churn_stream": _WINDOW,
    "tm02_inset": "select id, case when lines <= 2 * d then k + lines / 2 else k + d end as x, case when complexity <= 2 * d then start_line + complexity / 2 else start_line + d end as y, greatest(lines - 2 * d, 0.0::double) as w, greatest(complexity - 2 * d, 0.0::double) as h from (select id, k::double as k, start_line::double as start_line, lines::double as lines, complexity::double as complexity, (k % 9)::double + 0.5::double as d from {decls})",
    "ui08_related_refs": "select r.key, r.pos, r.id, coalesce((select arg_min(p.key, (-p.level, p.lens, p.key)) from {all_prognoses} p where p.target = r.id and p.key <> r.key), '') as own_key from {related} r",
    "sc18_fingerprint_tree": """with files_ as (select distinct split_part(path, '/', 1) as root, substr(sha256(path), 1, 4) as leaf, path || ' ' || size || ' ' || mtime as entry from {listing}),
        t as (select root, 4 as level, leaf as node, sha256(string_agg(entry, chr(10) order by entry)) as digest from files_ group by root, leaf),
        t3 as (select root, 3 as level, node[:3] as node, sha256(string_agg(node || digest, chr(10) order by node)) as digest from t group by root, node[:3]),
        t2 as (select root, 2 as level, node[:2] as node, sha256(string_agg(node || digest, chr(10) order by node)) as digest from t3 group by root, node[:2]),
        t1 as (select root, 1 as level, node[:1] as node, sha256(string_agg(node || digest, chr(10) order by node)) as digest from t2 group by root, node[:1]),
        t0 as (select root, 0 as level, '' as node, sha256(string_agg(node || digest, chr(10) order by node)) as digest from t1 group by root)
        select * from t union all select * from t3 union all select * from t2 union all select * from t1 union all select * from t0""",
    "sc18_changed_files": "select distinct path from ((select distinct path, size, mtime from {listing} except select path, size, mtime from {later}) union (select distinct path, size, mtime from {later} except select path, size, mtime from {listing}))",
    "sc19_named_sites": rf"""with s as (select path, line, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from {{source}}),
        n as (select id, path, start_line, end_line, split_part(name, '.', -1) as short from {{decls}}),
        p as (select c.src, c.dst, a.path, a.start_line, a.end_line, a.short as own, z.short as callee, a.end_line <= coalesce((select max(line) from s where s.path = a.path), 0) as inside from {{calls}} c join n a on a.id = c.src join n z on z.id = c.dst),
        m as (select p.*, s.line as line_at, regexp_matches(s.t, {_DECLARES}) as declares, case when regexp_matches(s.t, {_DECLARES}) and contains(s.t, own || '(') then s.t[:instr(s.t, own || '(') - 1] || s.t[instr(s.t, own || '(') + length(own):] else s.t end as rest from p join s on s.path = p.path and s.line between p.start_line and p.end_line where p.inside and not regexp_matches(s.t, '^(//|#|/\*|\*)')),
        b as (select src, dst, arg_min(line_at, (declares, line_at)) as line from m where regexp_matches(rest, '\b' || callee || '\b') group by src, dst)
        select p.src, p.dst, coalesce(b.line, start_line) as line, b.line is not null as found, case when not inside then null when b.line is null then start_line else greatest(b.line - 2, start_line) end as first, case when not inside then null when b.line is null then least(start_line + 4, end_line) else least(b.line + 2, end_line) end as last from p left join b on p.src = b.src and p.dst = b.dst""",
    "ui04_margin_notes": """select n.id, n.file, n.side, n.line, case when case when n.unit_key <> '' then n.unit_key not in (select unit_key from {margin_units}) else n.text <> '' and coalesce(l.text, '') <> n.text end then 'outdated' when s.file is null then 'stray' else 'current' end as status, s.file is null as stray
        from {margin} n left join {margin_lines} l on l.file = n.file and l.side = n.side and l.line = n.line left join {margin_shown} s on s.file = n.file and s.side = n.side and s.line = n.line where n.scope like 'pr:7@%' and n.root = '.' and not n.resolved""",
    "rv01_routes": """with b as (select distinct replace(path, '.src', '.go') as path from {base_files}), h as (select replace(path, '.src', '.go') as path, bool_or(generated) as generated from {head_files} group by all)
        select old_path, new_path, case when new_path <> '' then new_path else old_path end as path, (case when new_path <> '' then new_path else old_path end) not like '%.go' or (old_path not in (select path from b) and new_path not in (select path from h)) or coalesce(generated, false) as whole, coalesce(generated, false) as generated from {diff_files} left join h on h.path = new_path""",
    "rv05_file_units": """select path as id, case status when 'added' then 'added' when 'deleted' then 'removed' when 'renamed' then 'moved' else 'modified' end as change,
        cast(case when generated or name in ('go.sum') then 4 when path in ('go.mod', 'Project.toml') then 0 when name = 'Manifest.toml' then 4 when path like '%/testdata/%' then 2 when name = 'go.mod' then 3 when not go then 3 when same then 4 when path like '%\\_test.go' escape '\\' then 2 else 1 end as bigint) as lane,
        least(added + deleted, 40) // 4 as risk, array_to_string(list_filter([case when status = 'renamed' then 'renamed from was/' || path end, case when "binary" then 'binary' when old_n * now_n > 4000000 then 'too large to show' end,
          case when generated then 'generated' when name = 'go.sum' then 'checksums' when path in ('go.mod', 'Project.toml') then 'dependencies' when name = 'Manifest.toml' then 'resolved versions' when path like '%/testdata/%' then 'test fixture' when name = 'go.mod' then 'dependencies; in another module' when go and same then 'comments or layout only' when go then 'in another module' end], lambda x: x is not null), '; ') as reasons, added, deleted
        from (select *, split_part(path, '/', -1) as name, path like '%.go' as go, path like '%.go' and old_n between 1 and 1999 and k % 2 = 1 as same, case when path like '%.go' and old_n between 1 and 1999 then old_n + 1 - k % 2 else new_n end as now_n from {whole_files})""",
}
_LABEL = "case rule " + " ".join(f"when '{k}' then '{v}'" for k, v in items.LABELS.items()) + " end"
_WHY = "case rule " + " ".join(f"when '{k}' then '" + v.replace("'", "''") + "'" for k, v in items.WHY.items()) + " end"
ORACLES |= {
    "ui01_finding_items": f"""select f.rule || ':' || coalesce(nullif(f.decl, ''), nullif(f.file, ''), f.package) || case when f.target <> '' then '->' || f.target else '' end as key, {_LABEL} || ': ' || subject as title, case when f.file = '' then subject else 'tools/' || f.file || case when f.line > 0 then ':' || f.line else '' end end as place,
        case when detail <> '' then detail || '. ' else '' end || {_WHY} || case when f.target <> '' then ' Other package: ' || f.target || '.' else '' end as body, 'Re-read the code: the ' || lower({_LABEL}) || ' no longer applies to ' || subject || ', and the build and tests still pass.' as "check", coalesce(c.code, '') as code
        from {{findings}} f left join ({walked.ORACLES['ui02_decl_lines']}) c on c.id = f.decl""",
    "sc16_keys": "select 'finding' as of, rule || ':' || case when decl <> '' then decl when file <> '' then file else package end || case when target = '' then '' else '->' || target end as key from {findings} union all select 'smell', array_to_string([rule, decl, file, subject], '|') from {findings} union all select 'line', path || '|' || case when test then '-' else '+' end || '|' || start_line from {decls} union all select 'thread', dst || ' > ' || src from {calls}",
    "agg14_summary": "with u as (select change, count(*) as units, count(distinct root) as roots from {changed} group by change), i as (select c.change, count(*) as introduced from {delta} d join {changed} c on c.id = d.decl where d.change = 'introduced' group by c.change), f as (select change, root, sum(k % 50) as added, sum(k % 31) as deleted from {changed} group by change, root) select u.change, units, roots, coalesce(introduced, 0) as introduced, (select max(added) from f where f.change = u.change)::bigint as added, (select max(deleted) from f where f.change = u.change)::bigint as deleted from u left join i on u.change = i.change",
    "rv11_merged_moves": """with r as (select * from {units} where change = 'removed' and kind <> ''), a as (select * from {units} where change = 'added' and kind <> ''),
        p1 as (select m.from_id as r, m.to_id as u from {moved} m where m.from_id in (select id from r) and m.to_id in (select id from a)),
        p2 as (select x.r, y.u from (select name, kind, min(id) as r from r where id not in (select r from p1) group by name, kind having count(*) = 1) x join (select name, kind, min(id) as u from a where id not in (select u from p1) group by name, kind having count(*) = 1) y on x.name = y.name and x.kind = y.kind),
        p as (select p.*, b.path as from_file, greatest(b.lines, 1) = greatest(h.lines, 1) and h.k % 46 <> 0 as same from (select * from p1 union all select * from p2) p join {base_decls} b on b.id = p.r join {head_decls} h on h.id = p.u)
        select u.id, u.file, case when p.same then 'moved' when not p.same then 'modified' else u.change end as change, case when p.same then 4 else u.lane end as lane, case when p.same then 0 else u.risk end as risk,
          case when p.u is null then u.reasons when p.same or u.reasons = '' then 'moved from ' || p.from_file else 'moved from ' || p.from_file || '; ' || u.reasons end as reasons from {units} u left join p on p.u = u.id where u.id not in (select r from p)""",
    "ui06_pull_lines": "select k, case when ready or pr_added is null then added else pr_added end as shown_added, case when ready or pr_deleted is null then deleted else pr_deleted end as shown_deleted from {pulls}",
    "sc07_lens_heats": """with w as (select decl as id, sum([1, 3, 9][severity + 1]) as weight, max(severity) as worst from {findings} where decl <> '' group by decl),
        d as (select d.id, f.churn, d.complexity, w.worst, 100 * coalesce(w.weight, 0)::double / greatest(d.lines, 1) as smells, f.churn * d.complexity as hotspot from {decls} d join {files} f on d.pkg = f.pkg and d.path = f.path left join w on w.id = d.id)
        select id, 'smells' as lens, cast(least(case when smells <= 0 then 0 when smells <= 1 then 1 when smells <= 3 then 2 when smells <= 6 then 3 when smells <= 12 then 4 else 5 end, coalesce([2, 4, 5][worst + 1], 5)) as bigint) as heat from d
        union all select id, 'complexity', case when complexity <= 0 then 0 when complexity <= 5 then 1 when complexity <= 10 then 2 when complexity <= 15 then 3 when complexity <= 20 then 4 else 5 end from d
        union all select id, 'churn', case when churn <= 0 then 0 else least(5, 1 + floor(4.999 * churn / (select max(churn) from d))) end from d
        union all select id, 'hotspot', case when hotspot <= 0 then 0 else least(5, 1 + floor(4.999 * hotspot / (select max(hotspot) from d))) end from d""",
    "win11_basket_groups": "select basket, kind, id, row_number() over (partition by basket order by repo_name, repo, coalesce(list_position(['finding', 'prognosis', 'introduced', 'note', 'thread'], kind), 6), kind, pos) as place from {basket}",
    "flt09_scoped_diffs": """select r.dir as root, case when o then case when r.dir = '.' then old_path else substr(old_path, length(r.dir) + 2) end else '' end as old_path, case when n then case when r.dir = '.' then new_path else substr(new_path, length(r.dir) + 2) end else '' end as new_path
        from (select f.old_path, f.new_path, r.dir, f.old_path <> '' and (r.dir = '.' or starts_with(f.old_path, r.dir || '/')) and not exists (select 1 from {nested} z where z.dir <> '.' and z.dir <> r.dir and (r.dir = '.' or starts_with(z.dir, r.dir || '/')) and starts_with(f.old_path, z.dir || '/')) as o,
          f.new_path <> '' and (r.dir = '.' or starts_with(f.new_path, r.dir || '/')) and not exists (select 1 from {nested} z where z.dir <> '.' and z.dir <> r.dir and (r.dir = '.' or starts_with(z.dir, r.dir || '/')) and starts_with(f.new_path, z.dir || '/')) as n from {diff_files} f, {nested} r) r where o or n""",
    "en10_inbox": """select c.repo, c.change, c.number, coalesce(u.units, 0)::bigint as units, coalesce(i.n, 0)::bigint as introduced, coalesce(l.added, 0)::bigint as added, coalesce(l.deleted, 0)::bigint as deleted, coalesce(u.done, 0)::bigint as done, coalesce(u.contract, 0)::bigint as contract, coalesce(u.logic, 0)::bigint as logic,
          coalesce(u.max_risk, 0)::bigint as max_risk, coalesce(u.roots, '') as roots, u.units is not null as ready, p.name as repo_name, coalesce(u.contract + u.logic, 0) > 0 as needs_reading,
          row_number() over (order by coalesce(u.contract + u.logic, 0) > 0 desc, coalesce(u.max_risk, 0) desc, p.name, c.repo, c.number nulls first) as pos
        from {inbox_changes} c join {inbox_repos} p on c.repo = p.repo
        left join (select repo, change, sum(n) as units, sum(done) as done, sum(contract) as contract, sum(logic) as logic, max(risk) as max_risk, string_agg(root || ':' || n, ',' order by root) as roots from (
          select repo, change, root, count(*) as n, count(*) filter (marked) as done, count(*) filter (not marked and lane = 0) as contract, count(*) filter (not marked and lane = 1) as logic, max(risk) as risk from (select u.*, (u.repo, u.key) in (select (repo, key) from {inbox_marks}) as marked from {inbox_units} u) group by repo, change, root) group by repo, change) u on u.repo = c.repo and u.change = c.change
        left join (select u.repo, u.change, count(*) as n from {delta} d join {inbox_units} u on u.key = d.decl where d.change = 'introduced' group by u.repo, u.change) i on i.repo = c.repo and i.change = c.change
        left join (select repo, change, max(added) as added, max(deleted) as deleted from (select repo, change, root, sum(added) as added, sum(deleted) as deleted from {inbox_units} group by repo, change, root) group by repo, change) l on l.repo = c.repo and l.change = c.change
        where c.number is not null or u.units > 0""",
    "en10_cards": """select p.repo, p.name, coalesce((select string_agg(lang || case lang when 'go' then ' (typed)' else ' (named)' end, ', ' order by dir, lang) from (select lang, min(dir) as dir from {card_roots} c where c.repo = p.repo group by lang)), '') as langs,
          coalesce((select bool_or(ready) from {card_roots} c where c.repo = p.repo), false) as ready, (select count(*) from {card_prognoses} g where g.repo = p.repo and level = 3) as fix_first, (select count(*) from {card_prognoses} g where g.repo = p.repo and level = 2) as fix_soon,
          (select count(*) from {card_prognoses} g where g.repo = p.repo and level = 1) as convenient, (select count(*) from {inbox_changes} c where c.repo = p.repo and c.number is not null) as pulls from {inbox_repos} p""",
}
_BYTES = "list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(range(0, octet_length(encode({0})) ), lambda i: ('0x' || substr(hex({0}), (2 * i + 1)::int, 2))::uhugeint)), lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"
_HEX = "ltrim(printf('%08x', ({0} // 4294967296)::bigint) || printf('%08x', ({0} % 4294967296)::bigint), '0')"
ORACLES["ui10_unit_ids"] = f"with t as (select id, '' as parent, 'u' as kind, id || '@' || shape as t from {{decls}} union all select src, dst, 'h', dst || chr(0) || src from {{calls}}), f as (select *, {_BYTES.format('t')} as f from t) select id, parent, kind || {_HEX.format('f')} as block from f"


def oracle_sql() -> dict[str, str]:
    more = {
        "scopes": SCOPES, "listing": LISTING, "later": LATER, "commits": COMMITS, "source": SOURCE, "calls": CALLS, "margin": MARGIN, "margin_units": MARGIN_UNITS, "margin_lines": MARGIN_LINES, "margin_shown": MARGIN_SHOWN,
        "diff_files": DIFF_FILES, "whole_files": WHOLE_FILES, "tree": TREE, "base_tree": TREE.replace("{decls}", "{base_decls}"), "head_tree": TREE.replace("{decls}", "{head_decls}"), "all_prognoses": oracle.ALL_PROGNOSES, "file_lines": walked.DUCK_LINES, "findings": oracle.FINDINGS, "delta": oracle.DIFFS["findings_delta"], "changed": CHANGED, "pulls": PULLS, "basket": BASKET, "units": oracle.UNITS,
    }
    more |= {"nested": NESTED, "inbox_units": INBOX_UNITS, "inbox_changes": INBOX_CHANGES, "inbox_repos": INBOX_REPOS, "inbox_marks": INBOX_MARKS, "card_roots": CARD_ROOTS, "card_prognoses": CARD_PROGNOSES}
    more |= walked.EVIDENCE | {"related": walked.ORACLES["pg14_related"]}
    return {n: oracle.ctes(t, **oracle.SHARED, **more) for n, t in ORACLES.items()}
