"""Queries of imports and names: a TypeScript workspace made of the graph's files and edges, and links of references by name.

DuckDB's texts state the rules anew: candidates of each specifier as lists, re-exports by recursion, links by all pairs of a name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import linking
from graphloom.plans import oracle
from graphloom.plans.checkpoints import cut
from graphloom.sources import modules
from graphloom.sources.binding import Graph, bound

#: A package a brand, a source a file, and a barrel in each.
TS_FILES = "select distinct 'packages/' || split_part(path, '/', 1) || '/src/' || replace(split_part(path, '/', 2), '.src', '.ts') as path from {decls} union select distinct 'packages/' || split_part(path, '/', 1) || '/src/index.ts' as path from {decls}"

#: What sources import, in six ways by their declaration's number; barrels hand on their files and barrels beside them, some both ways.
TS_SPECS = """
with e as (select 'packages/' || split_part(a.path, '/', 1) || '/src/' || replace(split_part(a.path, '/', 2), '.src', '.ts') as path, a.k % 6 as way, split_part(z.path, '/', 1) as b, replace(split_part(z.path, '/', 2), '.src', '') as t
    from {edges} x join {decls} a on x.src = a.id join {decls} z on x.dst = z.id where x.kind = 'caller'),
  p as (select distinct split_part(path, '/', 1) as b, cast(substr(split_part(path, '/', 1), 2) as int) as n, replace(split_part(path, '/', 2), '.src', '') as t from {decls})
select distinct path, case way when 0 then '../../' || b || '/src/./' || t when 1 then '~/' || b || '/src/' || t || '.js' when 2 then 'packages/' || b || '/src/' || t when 3 then '@shop/' || b when 4 then '@shop/' || b || '/' || t else 'react-' || b end as spec, false as handed from e
union select 'packages/' || b || '/src/index.ts' as path, './' || t as spec, true as handed from p
union select 'packages/' || b || '/src/index.ts' as path, '@shop/b' || cast(n + 1 as string) as spec, true as handed from p where n % 4 <> 3
union select 'packages/' || b || '/src/index.ts' as path, '@shop/b' || cast(n - 1 as string) as spec, true as handed from p where n % 4 = 2
"""

#: Project files: aliases at the top, others in every seventh package, and each package's exports.
TS_PROJECT = """
with p as (select distinct split_part(path, '/', 1) as b, cast(substr(split_part(path, '/', 1), 2) as int) as n from {decls})
select 'tsconfig.json' as path, '{{ // aliases\n "compilerOptions": {{"baseUrl": ".", "paths": {{"~/*": ["gone/*", "packages/*"],}} }} }}' as text
union all select 'packages/' || b || '/tsconfig.json' as path, '{{"compilerOptions": {{"paths": {{"#/*": ["src/*"]}} }} }}' as text from p where n % 7 = 0
union all select 'packages/' || b || '/package.json' as path, '{{"name": "@shop/' || b || '", "exports": {{".": {{"types": "./dist/index.d.ts"}}, "./*": {{"import": "./dist/*.mjs"}} }} }}' as text from p
"""

#: Declarations under names that several share, references by them, and packages that files import.
SHORT = "case when {0}.kind = 'method' then 'm' || cast({0}.k % 97 as string) else 'n' || cast({0}.k % 61 as string) end"
NAMED_DECLS = f"select id as dst, {SHORT.format('d')} as short, pkg as to, path as at, exported, kind = 'method' as member from {{decls}} d"
NAMED_REFS = f"select distinct a.id as src, {SHORT.format('a')} as own, a.kind = 'method' as own_member, a.path, a.pkg, {SHORT.format('z')} as short, x.kind from {{edges}} x join {{decls}} a on x.src = a.id join {{decls}} z on x.dst = z.id"
NAMED_VISIBLE = "select distinct a.path, z.pkg as to from {edges} x join {decls} a on x.src = a.id join {decls} z on x.dst = z.id join {imports} i on i.src = a.pkg and i.dst = z.pkg where x.kind = 'caller'"


def _specs(g: Graph) -> DataFrame:
    return g.spark.sql(TS_SPECS, decls=g.decls.hint("merge"), edges=g.edges)


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bound(spark, sf_dir).kept("decls", "edges")
    project = g.sql(TS_PROJECT)
    # specifiers are read many times, so edges meet declarations once
    return modules.resolved(g.sql(TS_FILES), cut(_specs(g)), cut(modules.configs(project)), cut(modules.packages(project)))


def import_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that each import names."""
    return _named(spark, sf_dir).select("path", "spec", "file")


def barrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that each source reaches by its imports, through barrels."""
    return modules.reached(_named(spark, sf_dir))


def named_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bound(spark, sf_dir).kept("decls", "edges", "imports")
    # stored declarations are packed, so that Spark takes them for small; all stay with the tasks
    decls = g.decls.hint("merge")
    refs, target = spark.sql(NAMED_REFS, decls=decls, edges=g.edges), g.sql(NAMED_DECLS)
    return linking.named(refs, target, spark.sql(NAMED_VISIBLE, decls=decls, edges=g.edges, imports=g.imports))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"src15_import_files": import_files, "gr06_barrels": barrels, "jn07_named_links": named_links}

RESOLVED = """
with t as (select path, spec, handed, split_part(path, '/', 2) as own, regexp_replace(path, '/[^/]*$', '') as dir from {ts_specs}),
  pk as (select distinct split_part(path, '/', 2) as b from {ts_files}),
  w as (select spec, arg_max(b, length(b)) as b from (select distinct spec from t) join pk on spec = '@shop/' || b or starts_with(spec, '@shop/' || b || '/') group by spec),
  c as (select t.*, list_concat(
      case when starts_with(spec, '.') then [array_to_string(list_transform(list_reduce(list_transform(string_split(dir || '/' || spec, '/'), lambda x: [x]), lambda a, x: case when x[1] = '..' then a[1:len(a) - 1] when x[1] in ('.', '') then a else list_concat(a, x) end), lambda x: x), '/')] else [] end,
      case when starts_with(spec, '.') or cast(substr(own, 2) as int) % 7 = 0 then [] when starts_with(spec, '~/') then ['gone/' || substr(spec, 3), 'packages/' || substr(spec, 3), spec] else [spec] end,
      case when w.b is null then [] when spec = '@shop/' || w.b then ['packages/' || w.b || '/dist/index', 'packages/' || w.b || '/src/index', 'packages/' || w.b || '/index']
        else list_transform(['/dist', '/src', '', '/src'], lambda f: 'packages/' || w.b || f || substr(spec, length('@shop/' || w.b) + 1)) end) as targets from t left join w using (spec)),
  u as (select path, spec, handed, unnest(targets) as target, generate_subscripts(targets, 1) as rank from c),
  f as (select path, spec, handed, rank, unnest([target, target || '.ts', target || '/index.ts', regexp_replace(target, '\\.[^./]*$', '') || '.ts']) as file, unnest([1, 2, 3, 4]) as form from u)
select f.path, spec, handed, arg_min(f.file, rank * 10 + form) as file from f join {ts_files} k on k.path = f.file group by f.path, spec, handed
"""
ORACLES = {
    "src15_import_files": "select path, spec, file from {resolved}",
    "gr06_barrels": "select distinct r.path, c.file from {resolved} r join (with recursive c as (select distinct file as start, file from {resolved} union select c.start, h.file from c join {resolved} h on h.handed and h.path = c.file) select * from c) c on c.start = r.file",
    "jn07_named_links": """select src, dst, kind from (select *, min(far) over (partition by src, short, kind) as best from
        (select r.src, r.short, r.kind, d.dst, case when d.at = r.path then 0 else 1 end as far, d.member, count(*) over (partition by r.src, r.short, r.kind) as n
          from {named_refs} r join {named_decls} d on d.short = r.short and d.dst <> r.src and (d.to = r.pkg or d.exported and exists (select 1 from {named_visible} v where v.path = r.path and v.to = d.to))) where not (member and n > 1)) where far = best""",
}


def oracle_sql() -> dict[str, str]:
    more = {"ts_files": TS_FILES, "ts_specs": TS_SPECS, "named_refs": NAMED_REFS, "named_decls": NAMED_DECLS, "named_visible": NAMED_VISIBLE, "resolved": RESOLVED}
    return {n: oracle.ctes(t, **oracle.SHARED, **more) for n, t in ORACLES.items()}
