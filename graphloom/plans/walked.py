"""Queries that run the operators of walks, review, stores and handoffs over all declarations; DuckDB's texts state their rules anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ordered import numbered, prefixes
from graphloom.functions.scalars import join_path, split_path
from graphloom.operators import evidence, graphdiff, handoff, prognoses, review, smells, walks
from graphloom.plans import oracle
from graphloom.plans.portable import TREE
from graphloom.sources import store
from graphloom.sources.binding import BASE, HEAD, RAW, Graph, bound, sources_of, versions

#: Paths of callers, three steps each; some name a declaration that isn't there, some come back to their first.
STEPS = """
with up as (select dst, min(src) as src from {edges} where kind = 'caller' group by dst),
  s as (select d.id as thread, d.k, a.src as one, b.src as two from {decls} d join up a on a.dst = d.id join up b on b.dst = a.src)
select thread, 1 as pos, thread as id from s union all select thread, 2 as pos, case when k % 11 = 0 then 'gone' else one end as id from s
union all select thread, 3 as pos, case when k % 7 = 0 then thread else two end as id from s
"""

#: A line's text: blank, a package clause, or another. Files go past the end of their last declaration.
LINE = "case when line % 7 = 0 then ' ' when line % 11 = 0 then 'package x' else 'line ' || cast(line as string) end"
DUCK_LINES = "select path, line, case when line % 7 = 0 then ' ' when line % 11 = 0 then 'package x' else 'line ' || line end as text from (select path, unnest(range(1, max(end_line) + 6)) as line from {decls} group by path)"

#: Baskets of a package's declarations, in order, and a move in each: its fifth to the second place, or beyond the end.
ITEMS = "select pkg as basket, id as key, cast(row_number() over (partition by pkg order by k) as bigint) as pos from {decls}"
MOVES = "select basket, key, case when length(basket) % 2 = 0 then 2 else 100000 end as to_pos from {items} where pos = 5"

#: Lines that a task makes of a file at a time.
CHUNK = 4096

LACKING = " and b % 5 <> 3"


def file_lines(g: Graph) -> DataFrame:
    """Lines 1 to five past the last declaration of every file, made by many tasks: what a small table explodes into would else be made where its few rows are."""
    ends = g.decls.groupBy("path").agg((F.max("end_line") + 5).alias("last"))
    chunks = ends.select("path", "last", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("last") - 1) / CHUNK))).alias("c"))
    dealt = chunks.repartition(int(g.spark.conf.get("spark.sql.shuffle.partitions")), "path", "c")
    upto = F.least(F.col("last"), (F.col("c") + 1) * CHUNK)
    return dealt.select("path", F.explode(F.sequence(F.col("c") * CHUNK + 1, upto)).alias("line")).select("path", "line", F.expr(LINE).alias("text"))


def _starts(g: Graph) -> DataFrame:
    return g.decls.select(F.col("id").alias("thread"), F.array("id").alias("ids"))


def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bound(spark, sf_dir).kept()
    return walks.next_steps(g, _starts(g)).select("thread", "id", "via")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bound(spark, sf_dir).kept()
    return walks.next_steps(g, _starts(g)).select("thread", "id", "pos")


def followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bound(spark, sf_dir).kept()
    return walks.replay(g.sql(STEPS), g).withColumn("pos", F.col("pos").cast("bigint"))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = versions(spark, sf_dir)
    steps = base.decls.select(F.col("id").alias("thread"), F.lit(1).cast("bigint").alias("pos"), "id")
    return walks.resolve(steps, head, graphdiff.moved(base, head)).select("id", "status", "now")


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bound(spark, sf_dir).kept()
    return walks.ring(g, g.decls)


def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.closure(bound(spark, sf_dir))


def file_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = bound(spark, sf_dir).sql(TREE)
    return tree.select("path", review.file_lane(F.col("path"), F.col("size") % 13 == 0, F.col("size") % 5 == 0).alias("lane"))


def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bound(spark, sf_dir).files
    return store.prunable(f.select(F.when(F.contains("pkg", F.lit("internal")), "inner").otherwise("outer").alias("repo"), F.col("test").cast("string").alias("root"), F.when(F.endswith("path", F.lit("economy.src")), "").otherwise(F.col("path")).alias("rev"), F.col("churn").alias("used")))


def basket_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = bound(spark, sf_dir).sql(ITEMS)
    return store.move_each(items, spark.sql(MOVES, items=items).withColumnRenamed("to_pos", "to"))


def loose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bound(spark, sf_dir)
    return review.loose(file_lines(g), g.decls).select("path", F.col("line").cast("bigint").alias("line"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bound(spark, sf_dir)
    return handoff.excerpt(file_lines(g), g.decls).select("id", F.array_join("code", "\n").alias("code"))


def path_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join_path(F.col("id"), F.concat("name", F.lit("~%x")))
    return bound(spark, sf_dir).decls.select("id", joined.alias("joined"), F.array_join(split_path(joined), "|").alias("parts"))


def missing_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations that head adds where base lacks some roots."""
    src = sources_of(spark, sf_dir)
    raw = spark.sql(RAW, part=src["part"])
    return graphdiff.added(Graph(spark, spark.sql(BASE + LACKING, raw=raw), src), Graph(spark, spark.sql(HEAD, raw=raw), src))


def dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages with a twentieth of the code, as none of the binding's has half of it."""
    return prognoses.dominant(bound(spark, sf_dir), share=5)


def untested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that no test reaches, in a graph without the tests of most packages."""
    return smells.untested_package(_fewer_tests(spark, sf_dir))


def untested_prognoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prognoses.untested_package(_fewer_tests(spark, sf_dir))


FEWER = "select * from {raw} where not test or (b = 11 and k % 10 = 1)"


def _fewer_tests(spark: SparkSession, sf_dir: str) -> Graph:
    g = bound(spark, sf_dir)
    return Graph(spark, spark.sql(FEWER, raw=g.raw), g.sources)


def _repo_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.plans import portable

    return portable._tables(spark, sf_dir)["repo_units"]()


def _unit_order() -> list:
    return [F.col("lane"), F.desc("risk"), F.col("file"), F.col("name"), F.col("id")]


def findings_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = smells.union(bound(spark, sf_dir).kept())
    order = [F.desc("severity"), *map(F.col, ("package", "file", "line", "rule", "decl", "target"))]
    return numbered(found, order).select("rule", "decl", "target", "file", "package", "pos")


def units_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(_repo_units(spark, sf_dir).drop("repo", "reviewed"), _unit_order()).select("id", "pos")


def render_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that need reading, as long as fewer than 3,000 lines stand before them."""
    u = _repo_units(spark, sf_dir).where("lane <= 1 and not reviewed")
    return numbered(u, _unit_order(), running=F.col("added") + F.col("deleted")).where("before < 3000").select("id")


def evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = numbered(bound(spark, sf_dir).files, [F.desc("churn"), F.col("pkg"), F.col("path")], "r")
    return f.where("r > 32 and not test").select("pkg", "path")


def dsm_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(walks.layers(bound(spark, sf_dir)), [F.desc("layer"), F.col("pkg")]).select("pkg", "layer", "pos")


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bound(spark, sf_dir)
    v = g.decls.join(g.files.select("pkg", "path", "churn"), ["pkg", "path"]).select("id", (F.col("complexity") * F.col("churn")).alias("v"))
    top = F.broadcast(v.agg(F.max("v").alias("top")))  # one row
    share = 1 + F.floor(F.lit(4.999) * F.col("v") / F.col("top"))
    return v.crossJoin(top).select("id", F.when(F.col("v") <= 0, 0).otherwise(F.least(F.lit(5), share)).cast("bigint").alias("heat"))


def nested_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders with a go.mod that lie in no other such folder: an equi-join on a path's folders."""
    dirs = bound(spark, sf_dir).sql(TREE).where("path like '%/go.mod'").select(F.expr("substr(path, 1, length(path) - 7)").alias("dir")).distinct()
    above = dirs.select("dir", F.explode(prefixes(F.col("dir"))).alias("up"))
    inner = above.join(dirs.select(F.col("dir").alias("up")), "up", "left_semi").select("dir")
    return dirs.join(inner, "dir", "left_anti")


def scope_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in a root that changes, by its folder, and in none of the roots nested in it."""
    f = bound(spark, sf_dir).files
    tops = f.where("churn > 2").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("dir")).distinct()
    own = f.select("pkg", "path", F.split_part("path", F.lit("/"), F.lit(1)).alias("dir")).join(tops, "dir").where(F.contains("path", F.lit("/")))
    rel = F.substr("path", F.length("dir") + F.lit(2))
    return own.where(~F.startswith(rel, F.lit("promo"))).select("pkg", rel.alias("path"))


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest of the known prefixes that a declaration's path begins with, by an equi-join on its own prefixes."""
    g = bound(spark, sf_dir)
    known = g.files.select(F.substring("path", 1, 2).alias("owner")).union(g.files.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("owner"))).distinct()
    # a path is looked up once, however many declarations are in it
    each = g.decls.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.length("path")), lambda n: F.substr("path", F.lit(1), n))).alias("owner"))
    best = each.join(known, "owner").groupBy("path").agg(F.max("owner").alias("owner"))
    return g.decls.select("id", "path").hint("merge").join(best, "path").select("id", "owner")


def prognosis_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.facts(bound(spark, sf_dir).kept(), least=20, share=5)


def prognosis_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.related(bound(spark, sf_dir).kept(), least=20, share=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "gr01_next": next_steps,
    "win05_candidates": candidates,
    "gr02_follow": followed,
    "gr03_resolve": resolved,
    "gr04_ring": ring,
    "gr06_closure": closure,
    "rv06_file_lanes": file_lanes,
    "snk02_prune": pruned,
    "snk06_basket_move": basket_moves,
    "rv04_loose_lines": loose_lines,
    "ui02_decl_lines": excerpts,
    "sc17_path_codec": path_codec,
    "gd07_missing_root": missing_root,
    "pg05_dominant_twentieth": dominant,
    "sm10_untested_few_tests": untested,
    "pg11_untested_few_tests": untested_prognoses,
    "pg13_facts": prognosis_facts,
    "pg14_related": prognosis_related,
    "win02_findings_order": findings_order,
    "win04_units_order": units_order,
    "win09_render_budget": render_budget,
    "win10_dsm_order": dsm_order,
    "win13_lru_evict": evicted,
    "sc07_heat": heat,
    "src08_nested_modules": nested_modules,
    "flt09_scope_files": scope_files,
    "gr07_owner": owners,
}

_CODE = "replace(replace({0}, '%', '%25'), '~', '%7E')"
#: A walk in the order of names, a row a step: its stack of (package, next import, layer so far), layers (-1 while there is none) and what has been met.
LAYERS = """
with recursive p as (select row_number() over (order by pkg) as i, pkg from {packages}),
  m as (select p.i, list(q.i order by q.i) as to from p join {imports} x on x.src = p.pkg join p q on q.pkg = x.dst group by p.i),
  c as (select list(coalesce(m.to, []) order by p.i) as to from p left join m on p.i = m.i),
  w as (select 0 as step, cast([] as struct(i bigint, n bigint, high bigint)[]) as stack, list_transform(range(0, (select count(*) from p)), lambda x: -1::bigint) as layer, list_transform(range(0, (select count(*) from p)), lambda x: false) as met
    union all select step + 1,
      case when len(stack) = 0 then [{{'i': list_position(met, false)::bigint, 'n': 0::bigint, 'high': 0::bigint}}]
        when t.n = len(c.to[t.i]) then case when len(stack) = 1 then [] else list_append(stack[:-3], {{'i': stack[-2].i, 'n': stack[-2].n, 'high': greatest(stack[-2].high, t.high + 1)}}) end
        when met[c.to[t.i][t.n + 1]] then list_append(stack[:-2], {{'i': t.i, 'n': t.n + 1, 'high': greatest(t.high, greatest(layer[c.to[t.i][t.n + 1]], 0) + 1)}})
        else list_concat(stack[:-2], [{{'i': t.i, 'n': t.n + 1, 'high': t.high}}, {{'i': c.to[t.i][t.n + 1], 'n': 0::bigint, 'high': 0::bigint}}]) end,
      case when len(stack) > 0 and t.n = len(c.to[t.i]) then list_transform(layer, lambda x, k: case when k = t.i then t.high else x end) else layer end,
      case when len(stack) = 0 then list_transform(met, lambda x, k: x or k = list_position(met, false)) when t.n < len(c.to[t.i]) then list_transform(met, lambda x, k: x or k = c.to[t.i][t.n + 1]) else met end
    from (select *, stack[-1] as t from w) w, c where len(stack) > 0 or list_contains(met, false))
select p.pkg, l.layer[p.i] as layer from p, (select arg_max(layer, step) as layer from w) l
"""

#: What DuckDB's texts of facts and related places share; packages that hold a twentieth stand in for those that hold half.
EVIDENCE = {
    "unstable": oracle.SMELLS["unstable_dep"], "large": oracle.SMELLS["large_file"], "bare": oracle.SMELLS["untested_package"],
    "most": "select * from (select *, sum(lines) over () as total from {pkg_lines}) where total >= 1000 and lines * 100 >= total * 5",
    "exporting": "select d.pkg, count(*) as n, count(*) filter (d.exported) as exp from {decls} d join {files} f on d.pkg = f.pkg and d.path = f.path where not f.test and d.pkg in (select dst from {imports}) group by d.pkg having count(*) >= 8 and count(*) filter (d.exported) * 100 > count(*) * 60",
    "crowd": f"select *, count(*) over (partition by pkg) as n, row_number() over (partition by pkg order by params desc, id) as pos from {{decls}} where params > 5 and {oracle.FUNCS}",
}
_LABEL = "case when starts_with(d.id, d.pkg || '.' || d.name || '(') then d.name || substr(d.id, length(d.pkg || '.' || d.name) + 1) else d.name end"
_CALLED = """select case when busy then 'hotspot:' else 'complex:' end || id as key, id, 'calls it, so a change in behaviour reaches it' as why from {measured} where not test and complexity > 10
          union all select 'untested:' || id, id, 'calls it; its own tests may reach it indirectly' from {measured} where not test and complexity > 10 and tests = 0
          union all select 'params:' || id, id, 'calls it, and would change with its parameters' from {crowd} where n < 3"""
ORACLES = {
    "gr05_layers": "select pkg, layer from {layers}",
    "win10_dsm_order": "select pkg, layer, row_number() over (order by layer desc, pkg) as pos from {layers}",
    "gr01_next": "select dst as thread, src as id, min(kind) as via from {edges} where src <> dst group by dst, src",
    "win05_candidates": "select x.dst as thread, x.src as id, row_number() over (partition by x.dst order by d.test, coalesce(c.n, 0) desc, x.src) as pos from (select distinct src, dst from {edges} where src <> dst) x join {decls} d on x.src = d.id left join (select dst, count(*) as n from {edges} where kind = 'caller' group by dst) c on c.dst = x.src",
    # a step stays if none up to it is missing, repeated, or without an edge to the one before
    "gr02_follow": "select s.thread, cast(s.pos as bigint) as pos, s.id from {steps} s where not exists (select 1 from {steps} b where b.thread = s.thread and b.pos <= s.pos and (b.id not in (select id from {decls}) or exists (select 1 from {steps} r where r.thread = b.thread and r.id = b.id and r.pos < b.pos) or (b.pos > 1 and not exists (select 1 from {steps} p join {edges} e on e.dst = p.id where p.thread = b.thread and p.pos = b.pos - 1 and e.src = b.id))))",
    "gr03_resolve": "select b.id, case when h.id is not null then 'current' when m.to_id is not null then 'moved' else 'gone' end as status, coalesce(h.id, m.to_id, '') as now from {base_decls} b left join {head_decls} h on b.id = h.id left join {moved} m on b.id = m.from_id",
    "gr04_ring": "select start, id, cast(min(hop) as bigint) as hop from (with recursive r as (select id as start, id, 0 as hop from {decls} union select r.start, e.src, r.hop + 1 from r join {edges} e on e.dst = r.id and e.kind = 'caller' where r.hop < 3) select * from r) where id <> start group by start, id",
    "gr06_closure": "select src, dst from (with recursive c as (select src, dst from {imports} union select c.src, i.dst from c join {imports} i on c.dst = i.src) select * from c) where src <> dst",
    "rv06_file_lanes": "select path, cast(case when size % 13 = 0 or split_part(path, '/', -1) = 'go.sum' then 4 when path in ('go.mod', 'Project.toml') then 0 when split_part(path, '/', -1) = 'Manifest.toml' then 4 when starts_with(path, 'testdata/') or contains(path, '/testdata/') then 2 when split_part(path, '/', -1) = 'go.mod' then 3 when path not like '%.go' then 3 when size % 5 = 0 then 4 when path like '%\\_test.go' escape '\\' then 2 else 1 end as bigint) as lane from {tree}",
    "snk02_prune": "select repo, root, rev, used from (select case when contains(pkg, 'internal') then 'inner' else 'outer' end as repo, cast(test as varchar) as root, path as rev, churn as used, row_number() over (partition by contains(pkg, 'internal'), test order by churn desc, path) as r from {files} where path not like '%economy.src') where r > 4",
    "snk06_basket_move": "select basket, key, row_number() over (partition by basket order by p, moved) as pos from (select i.basket, i.key, m.key is not null as moved, case when m.key is null then i.pos - cast(i.pos > 5 as int) when m.to_pos > n then n - 0.5 else m.to_pos - 0.5 end as p from (select *, count(*) over (partition by basket) as n from {items}) i left join {moves} m on i.basket = m.basket and i.key = m.key)",
    "rv04_loose_lines": "select l.path, l.line from {file_lines} l where trim(l.text) <> '' and l.text not like 'package %' and not exists (select 1 from {decls} d where d.path = l.path and l.line between d.start_line and d.end_line)",
    "ui02_decl_lines": "select id, case when n > 40 then array_to_string(t[1:40], chr(10)) || chr(10) || '… ' || (n - 40) || ' more lines' else array_to_string(t, chr(10)) end as code from (select d.id, count(*) as n, list(l.text order by l.line) as t from {decls} d join {file_lines} l on l.path = d.path and l.line between d.start_line and d.end_line group by d.id)",
    "sc17_path_codec": f"select id, {_CODE.format('id')} || '~' || {_CODE.format('(name || chr(126) || chr(37) || chr(120))')} as joined, id || '|' || name || '~%x' as parts from {{decls}}",
    "gd07_missing_root": oracle.DIFFS["added"],
    "pg13_facts": """with c as (select m.*, case when busy then 'hotspot:' else 'complex:' end || id as own_key from {measured} m where not test and complexity > 10),
        k as (select own_key as key, * from c union all select 'untested:' || id as key, * from c where tests = 0),
        r as (select x.id, x.users, x.pkgs, coalesce(t.tests, 0) as tests from (select id, sum(n) as users, count(*) as pkgs from {calling} group by id having sum(n) >= 20) x join {decls} d on x.id = d.id left join {callers} t on x.id = t.id where not d.test),
        u as (select 'unstable:' || package || '>' || target as key, measure, limit_value from {unstable})
        select key, 0::bigint as pos, 'paths through it (complexity)' as label, complexity::bigint as value, 10::bigint as limit_value from k union all select key, 1, 'commits to its file lately', churn, 0 from k union all select key, 2, 'lines', lines, 60 from k union all select key, 3, 'tests that call it', tests, 0 from k
        union all select 'reach:' || id, 0, 'declarations that use it', users::bigint, 50 from r union all select 'reach:' || id, 1, 'packages that use it', pkgs, 0 from r union all select 'reach:' || id, 2, 'tests that call it', tests, 0 from r
        union all select key, 0, 'instability of the imported package, %', measure, 0 from u union all select key, 1, 'instability of this package, %', limit_value, 0 from u
        union all select 'dominant:' || pkg, unnest([0, 1, 2]), unnest(['share of the module''s lines, %', 'lines', 'files']), unnest([lines * 100 // total, lines, n_files])::bigint, unnest([50, 0, 0]) from {most}
        union all select 'wide:' || pkg, unnest([0, 1, 2]), unnest(['declarations exported, %', 'exported', 'declarations']), unnest([exp * 100 // n, exp, n])::bigint, unnest([60, 0, 0]) from {exporting}
        union all select 'params:' || pkg, unnest([0, 1]), unnest(['functions with too many parameters', 'most parameters in one']), unnest([count(*), max(params)])::bigint, unnest([3, 5]) from {crowd} where n >= 3 group by pkg
        union all select 'params:' || id, 0, 'parameters', params, 5 from {crowd} where n < 3
        union all select 'large-file:' || l.file, unnest([0, 1]), unnest(['lines of code', 'commits lately']), unnest([l.measure, f.churn])::bigint, unnest([l.limit_value, 0]) from {large} l join {files} f on l.package = f.pkg and l.file = f.path
        union all select 'untested-pkg:' || l.pkg, unnest([0, 1]), unnest(['lines', 'test files']), unnest([l.lines, 0])::bigint, 0 from {bare} u join {pkg_lines} l on u.package = l.pkg""",
    "pg14_related": f"""select key, pos, id, name, why from (select *, row_number() over (partition by key order by rank, id) as pos from (
        select t.key, row((0)::bigint, '', (0)::bigint) as rank, d.id, {_LABEL} as name, t.why from ({_CALLED}) t join {{edges}} e on e.dst = t.id and e.kind = 'caller' join {{decls}} d on e.src = d.id where not d.test
        union all select 'reach:' || id, row((-n)::bigint, "from", (0)::bigint), "from", substr("from", 6), {oracle.plural('n', 'declaration')} || ' here call it' from (select *, sum(n) over (partition by id) as callers from {{calling}}) c where callers >= 20 and id in (select id from {{decls}} where not test)
        union all select 'dominant:' || f.pkg, row((-f.lines)::bigint, f.path, (0)::bigint), f.path, split_part(f.path, '/', -1), f.lines || ' lines, ' || {oracle.plural('f.churn', 'commit')} || ' lately' from {{most}} m join {{files}} f on f.pkg = m.pkg where not f.test
        union all select 'wide:' || d.pkg, row((coalesce(o.n, 0))::bigint, d.path, (d.start_line)::bigint), d.id, {_LABEL}, case when o.n is null then 'no caller in other packages of the module' else 'used ' || {oracle.plural('o.n', 'time')} || ' from other packages' end
          from {{exporting}} x join {{decls}} d on d.pkg = x.pkg join {{files}} f on f.pkg = d.pkg and f.path = d.path left join (select c.id, sum(c.n)::bigint as n from {{calling}} c join {{decls}} t on c.id = t.id where c."from" <> t.pkg group by c.id) o on o.id = d.id where d.exported and not f.test
        union all select 'unstable:' || package || '>' || target, row((0)::bigint, '', (0)::bigint), target, substr(target, 6), 'the less stable package it imports' from {{unstable}}
        union all select 'params:' || pkg, row((-params)::bigint, id, (0)::bigint), id, {_LABEL}, 'takes ' || params || ' parameters' from {{crowd}} d where n >= 3 and pos > 1
        union all select 'large-file:' || l.file, row((-d.lines)::bigint, '', (d.start_line)::bigint), d.id, {_LABEL}, d.lines || ' lines' from {{large}} l join {{decls}} d on d.pkg = l.package and d.path = l.file)) where pos <= 8""",
    "pg05_dominant_twentieth": oracle.PROGNOSES["dominant"].replace("total * 50", "total * 5"),
    "sm10_untested_few_tests": oracle.SMELLS["untested_package"],
    "pg11_untested_few_tests": oracle.PROGNOSES["untested_package"],
}


def oracle_sql() -> dict[str, str]:
    more = {"steps": STEPS, "file_lines": DUCK_LINES, "items": ITEMS, "moves": MOVES, "tree": TREE, "layers": LAYERS, **EVIDENCE}
    own = {"gd07_missing_root": {"base_raw": BASE + LACKING}}
    out = {n: oracle.ctes(t, **oracle.SHARED, **more, **own.get(n, {})) for n, t in ORACLES.items()}
    # the graph with fewer tests: its tables are those of the others, over other rows
    for n in ("sm10_untested_few_tests", "pg11_untested_few_tests"):
        out[n] = oracle.ctes(ORACLES[n], **oracle.SHARED, full_raw=RAW, raw=FEWER.replace("{raw}", "{full_raw}"))
    return out
