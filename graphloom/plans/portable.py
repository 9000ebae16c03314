"""Operators that one SQL text states for both engines: Spark runs it over the graph's DataFrames, DuckDB over CTEs.

Names in braces are tables of `graphloom.sources.binding`; those with base_ or head_ are of the edited versions.
The units and prognoses tables here are those of the operators, which have texts of their own for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import graphdiff, prognoses, smells
from graphloom.plans import oracle
from graphloom.plans.checkpoints import stored
from graphloom.sources.binding import TABLES, Graph, both_kept, bound, versions

#: Files of a listing, as a repository's tree would give them.
TREE = """select case k % 9 when 0 then 'svc' || cast(k % 40 as string) || '/go.mod' when 1 then 'lib' || cast(k % 30 as string) || '/Project.toml' when 2 then 'web/p' || cast(k % 25 as string) || '/package.json'
  when 3 then 'vendor/x' || cast(k as string) || '/go.mod' when 4 then 'a/testdata/' || cast(k as string) || '/go.mod' when 5 then 'py' || cast(k % 20 as string) || '/pyproject.toml' when 6 then '_tmp/' || cast(k as string) || '/go.mod'
  when 7 then 'rs' || cast(k % 15 as string) || '/Cargo.toml' else 'src/f' || cast(k as string) || '.go' end as path, k as size, k * 7 as mtime from {decls}"""

#: Notes and reviewed marks on units.
NOTES = "select id, path as file, cast(start_line as bigint) as line, case when k % 3 = 0 then 'base' else 'head' end as side, k % 5 = 0 as resolved, 'review:' || cast(k % 4 as string) || '@' || substr(id, 1, 6) as scope, name as text from {head_decls} where k % 29 = 0"
REVIEWED = "select id from {head_decls} where k % 4 = 0"

#: A repository for every ten packages, to roll units up.
REPO_UNITS = "select u.*, 'repo' || cast(length(u.file) % 5 as string) as repo, r.id is not null as reviewed from {units} u left join {reviewed} r on u.id = r.id"

#: Roots of projects by patterns on paths.
ROOTS = """select dir, lang from (select distinct substr(path, 1, length(path) - length(base) - 1) as dir, case base when 'go.mod' then 'go' when 'Project.toml' then 'julia' when 'package.json' then 'typescript' when 'pyproject.toml' then 'python' when 'Cargo.toml' then 'rust' end as lang
      from (select path, case when path like '%/go.mod' then 'go.mod' when path like '%/Project.toml' then 'Project.toml' when path like '%/package.json' then 'package.json' when path like '%/pyproject.toml' then 'pyproject.toml' when path like '%/Cargo.toml' then 'Cargo.toml' end as base from {tree}
        where not (path like '.%' or path like '%/.%' or path like '!_%' escape '!' or path like '%/!_%' escape '!' or path like 'vendor/%' or path like '%/vendor/%' or path like 'testdata/%' or path like '%/testdata/%' or path like 'node_modules/%' or path like '%/node_modules/%')) x where base is not null) y"""

SQL: dict[str, str] = {
    "src08_nested_modules": """select distinct substr(a.path, 1, length(a.path) - 7) as dir from {tree} a where a.path like '%/go.mod' and not exists (select 1 from {tree} b where b.path like '%/go.mod' and b.path <> a.path and a.path like substr(b.path, 1, length(b.path) - 6) || '%')""",
    "src11_fixed_args": "select pkg, fixed_param as param, count(distinct fixed_value) as n_values, min(fixed_value) as first_value, count(*) as sites from {decls} where fixed_param <> '' group by pkg, fixed_param having count(distinct fixed_value) = 1",
    "snk03_reviewed_units": "select u.id, u.lane from {units} u where exists (select 1 from {reviewed} r where r.id = u.id)",
    "flt01_production": "select e.dst as id, e.src from {edges} e join {decls} d on e.src = d.id where not d.test and e.kind = 'caller'",
    "flt02_surface": "select d.id, d.exported from {decls} d join {files} f on d.pkg = f.pkg and d.path = f.path where not f.test",
    "flt03_importable": "select pkg, case when substr(pkg, 5) || '/' like '%/internal/%' or name = 'main' then false else true end as importable from {packages}",
    "flt04_has_tests": "select pkg, bool_or(test) as has_tests from {files} group by pkg",
    "flt06_dead_candidates": "select id from {decls} where kind <> 'method' and not (kind = 'func' and (name = 'init' or (name = 'main' and pkg_name = 'main'))) and (not exported or pkg_name = 'main')",
    "flt07_span_hits": "select d.id, h.start, h.n from {head_decls} d join {head_hunks} h on d.path = h.path and ((h.n = 0 and d.start_line <= h.start and h.start + 1 <= d.end_line) or (h.n > 0 and h.start <= d.end_line and h.start + h.n - 1 >= d.start_line))",
    "flt08_loose_lines": "select h.path, h.start from {base_hunks} h where not exists (select 1 from {head_decls} d where d.path = h.path and d.start_line <= h.start and h.start <= d.end_line)",
    "flt09_scope_files": "select f.pkg, substr(f.path, length(r.dir) + 2) as path from {files} f join (select distinct split_part(path, '/', 1) as dir from {files} where churn > 2) r on f.path like r.dir || '/%' where f.path not like r.dir || '/promo%'",
    "flt10_fixtures": "select path from {tree} where path like 'testdata/%' or path like '%/testdata/%'",
    "flt11_map_scope": "select d.id, coalesce(p.pkg, q.pkg, f.pkg) as pkg from (select id, case k % 3 when 0 then pkg when 1 then substr(pkg, 6) else path end as wanted from {decls}) d left join {packages} p on d.wanted = p.pkg left join {packages} q on d.wanted = q.rel left join (select path, min(pkg) as pkg from {files} group by path) f on d.wanted = f.path",
    "flt12_structure_findings": "select rule, package, target, decl from {findings} where rule in ('unstable-dep', 'envious-func', 'untested-package')",
    "flt13_needs_reading": "select u.id from {units} u where u.lane <= 1 and not exists (select 1 from {reviewed} r where r.id = u.id)",
    "flt14_outdated_notes": "select n.id, n.scope, split_part(n.scope, '@', 1) as same_change from {notes} n where not n.resolved and not exists (select 1 from {units} u where u.id = n.id and u.lane < 4)",
    "jn01_decl_lookup": "select e.src, e.dst, d.path, f.lines from {edges} e join {decls} d on e.dst = d.id join {files} f on d.pkg = f.pkg and d.path = f.path",
    "jn04_imported_by": "select p.pkg, i.src from {packages} p join {imports} i on i.dst = p.pkg",
    "jn05_full_outer": "select coalesce(h.id, b.id) as id, case when b.id is null then 'added' when h.id is null then 'removed' when h.shape <> b.shape or h.signature <> b.signature then 'changed' else 'same' end as change from {head_decls} h full outer join {base_decls} b on h.id = b.id",
    "jn06_pair_moves": "select o.id as from_id, n.id as to_id from (select name, kind, shape, min(id) as id from {gone} where shape <> '' group by name, kind, shape having count(*) = 1) o join (select name, kind, shape, min(id) as id from {come} where shape <> '' group by name, kind, shape having count(*) = 1) n on o.name = n.name and o.kind = n.kind and o.shape = n.shape",
    "jn09_apply_churn": "select d.id, coalesce(f.churn, 0) as churn from {decls} d left join {files} f on d.pkg = f.pkg and d.path = f.path",
    "jn10_attach_smells": "select f.rule, coalesce(u.id, v.id) as unit from {head_findings} f left join {units} u on f.decl = u.id left join (select file, min(id) as id from {units} group by file) v on f.file = v.file and f.decl = '' where coalesce(u.id, v.id) is not null",
    "jn11_second_pairs": "select o.id as from_id, n.id as to_id from (select name, kind, min(id) as id from {gone} where id not in (select from_id from {moved}) and lines > 0 group by name, kind having count(*) = 1) o join (select name, kind, min(id) as id from {come} where id not in (select to_id from {moved}) and lines > 0 group by name, kind having count(*) = 1) n on o.name = n.name and o.kind = n.kind",
    "jn12_not_in_basket": "select id from {decls} d where exists (select 1 from {findings} f where f.decl = d.id) and not exists (select 1 from {notes} b where b.id = d.id)",
    "jn13_calls_between_tiles": "select a.k as from_tile, z.k as to_tile from {edges} e join {decls} a on e.src = a.id join {decls} z on e.dst = z.id where e.kind = 'caller' and a.k <> z.k and a.lines > 0 and z.lines > 0",
    "agg01_package_lines": "select pkg, cast(coalesce(sum(case when not test then lines end), 0) as bigint) as lines from {files} group by pkg",
    "agg03_package_refs": "select a.pkg as src, r.pkg as dst, cast(sum(r.n) as bigint) as n from {refs} r join {decls} a on r.decl = a.id where not a.test group by a.pkg, r.pkg",
    "agg05_tested_from_outside": "select distinct r.pkg from {refs} r join {decls} a on r.decl = a.id where a.test and a.pkg <> r.pkg",
    "agg07_worst_by_decl": "select decl, count(*) as n, max(severity) as worst from {findings} where decl <> '' group by decl",
    "agg10_split_callers": "select e.dst as id, count(case when d.test then 1 end) as tests, count(case when d.test then null else 1 end) as prod from {base_edges} e left join {head_decls} d on e.src = d.id where e.kind = 'caller' group by e.dst",
    "agg11_gained": "select x.dst as id, count(*) as n from {edges_added} x left join {head_decls} c on x.src = c.id where not coalesce(c.test, false) group by x.dst",
    "agg12_new_callers": "select x.dst as id, count(distinct x.src) as n from {edges_added} x join {head_decls} c on x.src = c.id where x.kind = 'caller' and not c.test group by x.dst",
    "agg13_changed_lines": "select path, cast(sum(n) as bigint) as n from {head_hunks} group by path",
    "agg15_reading": "select repo, count(*) as units, count(case when reviewed then 1 end) as done, count(case when not reviewed and lane = 0 then 1 end) as contract, count(case when not reviewed and lane = 1 then 1 end) as logic, max(risk) as risk from {repo_units} group by repo",
    "agg16_census": "select level, count(*) as n from {prognoses} group by level",
    "agg17_sections": "select lane, count(*) as n, count(case when reviewed then 1 end) as reviewed from {repo_units} group by lane",
    "agg18_shared_names": "select id, count(*) over (partition by lower(name)) > 1 as shared from {units}",
    "agg19_chips": "select (select count(*) from {come}) as decls, (select count(*) from {edges_added}) as edges, (select count(*) from {head_findings}) as smells",
    "agg20_callers_text": "select id, case when n = 0 then 'no callers' when n = 1 then '1 caller' else cast(n as string) || ' callers' end as label from (select d.id, count(e.src) as n from {decls} d left join {edges} e on e.dst = d.id and e.kind = 'caller' group by d.id) x",
    "agg21_unreviewed": "select repo, count(*) - count(case when reviewed then 1 end) as unreviewed from {repo_units} group by repo",
    "win01_duplicate_ids": "select id, k, row_number() over (partition by pkg, name order by path, k) as ordinal from {decls}",
    "win02_findings_order": "select rule, decl, target, file, package, row_number() over (order by severity desc, package, file, line, rule, decl, target) as pos from {findings}",
    "win04_units_order": "select id, row_number() over (order by lane, risk desc, file, name, id) as pos from {units}",
    "win06_inbox_order": "select repo, row_number() over (order by case when sum(case when lane <= 1 and not reviewed then 1 else 0 end) > 0 then 0 else 1 end, max(risk) desc, repo) as pos from {repo_units} group by repo",
    "win08_lane_cap": "select id, lane from (select id, lane, row_number() over (partition by lane order by risk desc, file, name, id) as r from {units}) x where r <= 60",
    "win09_render_budget": "select id from (select id, sum(added + deleted) over (order by lane, risk desc, file, name, id rows between unbounded preceding and 1 preceding) as before_it from {repo_units} where lane <= 1 and not reviewed) x where coalesce(before_it, 0) < 3000",
    "win12_fold_rows": """select key, seq, kept from (select key, seq, len, pos, changed, first_run, last_run, case when changed or len <= 7 then true when first_run then pos > len - 3 when last_run then pos <= 3 else pos <= 3 or pos > len - 3 end as kept
      from (select key, seq, changed, run, count(*) over (partition by key, run) as len, row_number() over (partition by key, run order by seq) as pos, run = min(run) over (partition by key) as first_run, run = max(run) over (partition by key) as last_run
        from (select key, seq, changed, sum(case when changed then 1 else 0 end) over (partition by key order by seq) * 2 + case when changed then 0 else 1 end as run
          from (select path as key, k as seq, k % 29 = 0 as changed from {decls}) a) b) c) d""",
    "win13_lru_evict": "select pkg, path from (select pkg, path, test, row_number() over (order by churn desc, pkg, path) as r from {files}) x where r > 32 and not test",
    "set03_touched_union": "select id, min(pos) as pos from (select id, 0 as pos from {new_lines} union all select id, 1 as pos from {old_lines}) x group by id",
    "gr07_owner": "select d.id, max(f.prefix) as owner from {decls} d join (select distinct substr(path, 1, 2) as prefix from {files} union select distinct split_part(path, '/', 1) from {files}) f on d.path like f.prefix || '%' group by d.id",
    "sc01_tier": "select id, case when lines > 120 then 2 when lines > 60 then 1 else 0 end as severity, case when lines > 120 then 'high limit' else 'limit' end as word from {decls}",
    "sc02_percent": "select pkg, cast(round(i * 100) as bigint) as pct from {instability}",
    "sc03_names": "select pkg, substr(pkg, 6) as rel, split_part(pkg, '/', -1) as short_name from {packages}",
    "sc04_band": "select id, least(case when complexity >= 3 then 1 else 0 end + case when complexity >= 6 then 1 else 0 end + case when complexity >= 10 then 1 else 0 end + case when complexity >= 20 then 1 else 0 end, 5) as band from {decls}",
    "sc06_lens_value": "select f.pkg, f.path, cast(100 * coalesce(sum(case s.severity when 0 then 1 when 1 then 3 else 9 end), 0) as double) / greatest(max(f.lines), 1) as smells from {files} f left join {findings} s on s.package = f.pkg and s.file = f.path group by f.pkg, f.path",
    "sc07_heat": "select id, case when v <= 0 then 0 else least(5, 1 + cast(floor(cast(4.999 as double) * v / top) as bigint)) end as heat from (select d.id, d.complexity * f.churn as v, max(d.complexity * f.churn) over () as top from {decls} d join {files} f on d.pkg = f.pkg and d.path = f.path) x",
    "sc08_complexity_reason": "select h.id, case when b.id is not null and h.complexity <> b.complexity then 'complexity ' || cast(h.complexity as string) || ' (' || case when h.complexity > b.complexity then '+' else '' end || cast(h.complexity - b.complexity as string) || ')' when h.complexity > 10 then 'complexity ' || cast(h.complexity as string) else '' end as reason from {head_decls} h left join {base_decls} b on h.id = b.id",
    "sc15_plural": "select pkg, cast(count(*) as string) || case when count(*) = 1 then ' file' else ' files' end as text from {files} group by pkg",
    "ui04_notes_by_line": "select file, side, line, count(*) as n from {notes} where not resolved group by file, side, line",
    "ui05_first_line": "select path, coalesce(min(case when test then null else start_line end), min(start_line)) as first_line from {decls} group by path",
    "ui06_change_lines": "select id, case when added + deleted > 0 then added else 0 end as added, case when added + deleted > 0 then deleted else 0 end as deleted from {units}",
    "ui07_accept_noise": "select id from {units} where lane = 4 union select id from {reviewed}",
    "ui09_inbox_split": "select repo, case when sum(case when lane <= 1 and not reviewed then 1 else 0 end) > 0 then 'Needs reading' else 'Skim' end as part from {repo_units} group by repo",
    "ui10_unit_cards": "select id, lane, risk, change || ' ' || kind as label from {units}",
    "ui11_atlas_base": "select id from {units} where change <> 'added'",
    "rv07_lanes": "select id, lane from {units}",
    "rv08_risks": "select id, risk from {units}",
    "rv10_removed_callers": "select g.id, e.src from {gone} g join {base_edges} e on e.dst = g.id and e.kind = 'caller' join {head_decls} h on h.id = e.src",
    "rv12_line_counts": "select id, added, deleted from {units}",
    "rv14_chips": "select u.id, count(f.rule) as smells, coalesce(max(g.n), 0) as new_callers, max(case when u.reasons like '%signature changed%' then 1 else 0 end) as resigned from {units} u left join {head_findings} f on f.decl = u.id left join (select x.dst as id, count(distinct x.src) as n from {edges_added} x where x.kind = 'caller' group by x.dst) g on g.id = u.id group by u.id",
    "tm05_dsm": "select a.pkg as row_pkg, r.pkg as col_pkg, cast(sum(r.n) as bigint) as n, max(case when u.target is not null then 1 else 0 end) as bad from {refs} r join {decls} a on r.decl = a.id join {imports} i on i.src = a.pkg and i.dst = r.pkg left join {unstable} u on u.package = a.pkg and u.target = r.pkg where not a.test group by a.pkg, r.pkg",
    "tm04_marks": "select p.key, d.k as tile from {prognoses} p join {decls} d on p.target = d.id where d.lines > 0",
}


def _units(spark, base, head, gained=None):
    from graphloom.plans.registry import _units as made

    return made(base, head, gained)


def _tables(spark: SparkSession, sf_dir: str, text: str = "") -> dict[str, Callable[[], DataFrame]]:
    """Tables beyond those of a graph, each made when a query names it; those that several of `text`'s need are stored first."""
    base, head = versions(spark, sf_dir)
    g = bound(spark, sf_dir, base.sources)
    gained = None
    if "{edges_added}" in text:
        both_kept(base, head, "decls", "edges")
        gained = stored(graphdiff.edges_added(base, head)) if "{units}" in text else graphdiff.edges_added(base, head)

    def hunks(side: Graph, k: int) -> DataFrame:
        from graphloom.plans.registry import hunks as made

        return made(side, k)

    def lines(side: Graph, k: int) -> DataFrame:
        from graphloom.operators.review import touched_lines

        return touched_lines(side.decls, hunks(side, k))

    made: dict[str, Callable[[], DataFrame]] = {n: (lambda n=n: getattr(g, n)) for n in TABLES}
    made |= {f"{s}_{n}": (lambda side=side, n=n: getattr(side, n)) for s, side in (("base", base), ("head", head)) for n in TABLES}
    made |= {
        "documents": lambda: spark.read.parquet(f"{sf_dir}/documents.parquet"),
        "tree": lambda: g.sql(TREE),
        "findings": lambda: smells.union(g.kept()),
        "head_findings": lambda: smells.union(head.kept()),
        "unstable": lambda: smells.unstable_dep(g),
        "instability": lambda: smells.instability(g),
        "prognoses": lambda: prognoses.union(g.kept()),
        "moved": lambda: graphdiff.moved(base, head),
        "gone": lambda: base.decls.join(head.decls.select("id"), "id", "left_anti"),
        "come": lambda: head.decls.join(base.decls.select("id"), "id", "left_anti"),
        "edges_added": lambda: graphdiff.edges_added(base, head) if gained is None else gained,
        "head_hunks": lambda: hunks(head, 17),
        "base_hunks": lambda: hunks(base, 19),
        "new_lines": lambda: lines(head, 17),
        "old_lines": lambda: lines(base, 19),
        "units": lambda: _units(spark, base, head, gained),
        "notes": lambda: spark.sql(NOTES, head_decls=head.decls),
        "reviewed": lambda: spark.sql(REVIEWED, head_decls=head.decls),
        "repo_units": lambda: spark.sql(REPO_UNITS, units=_units(spark, base, head), reviewed=spark.sql(REVIEWED, head_decls=head.decls)),
    }
    return made


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = _tables(spark, sf_dir, text)
        made = {n: make() for n, make in tables.items() if "{" + n + "}" in text}
        # what a text reads twice is made once
        return spark.sql(text, **{n: stored(df) if n in ("units", "repo_units") and text.count("{" + n + "}") > 1 else df for n, df in made.items()})

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _query(t) for n, t in SQL.items()}


EXTRA = {
    "tree": TREE,
    "findings": oracle.FINDINGS,
    "head_findings": oracle.of_side(oracle.FINDINGS, "head"),
    "unstable": oracle.SMELLS["unstable_dep"],
    "prognoses": oracle.ALL_PROGNOSES,
    "edges_added": oracle.DIFFS["edges_added"],
    "units": oracle.UNITS,
    "notes": NOTES,
    "reviewed": REVIEWED,
    "repo_units": REPO_UNITS,
}


def oracle_sql() -> dict[str, str]:
    return {n: oracle.ctes(t, **oracle.SHARED, **EXTRA) for n, t in SQL.items()}
