"""What the operators' queries should return, in DuckDB's SQL over the same tables."""

from __future__ import annotations

from graphloom.sources.binding import ctes

ELIGIBLE = "not test and not generated"
FUNCS = ELIGIBLE + " and kind in ('func', 'method')"
PUBLIC = "(not contains(substr(pkg, 5) || '/', '/internal/') and pkg_name <> 'main')"


def finding(source: str, rule: str, severity: str, detail: str, measure: str = "0", limit: str = "0", target: str = "''") -> str:
    return row(source, rule, severity, "pkg", "path", "start_line", "id", "name", target, measure, limit, detail)


def row(source, rule, severity, package, file, line, decl, subject, target, measure, limit, detail) -> str:
    return (
        f"select '{rule}' as rule, cast({severity} as bigint) as severity, {package} as package, {file} as file, cast({line} as bigint) as line, {decl} as decl, {subject} as subject, "
        f"{target} as target, cast({measure} as bigint) as measure, cast({limit} as bigint) as limit_value, {detail} as detail from {source}"
    )


def tiered(source: str, rule: str, value: str, warn: int, high: int, text: str) -> str:
    over = f"{value} > {high}"
    args = (f"case when {over} then 2 else 1 end", f"{text} || case when {over} then 'high limit {high}' else 'limit {warn}' end", value, f"case when {over} then {high} else {warn} end")
    return finding(f"{source} and {value} > {warn}", rule, *args)


OUTSIDE = """select distinct e.dst as id from {edges} e join {decls} a on e.src = a.id join {decls} z on e.dst = z.id where a.pkg <> z.pkg"""
USED = """select id from {outside} union select c.id from {decls} c join {outside} o on o.id = c.pkg || '.' || split_part(c.signature, ', ', 1) where c.kind = 'const'"""
INSTABILITY = """select p.pkg, p.name, p.rel, coalesce(a.n, 0) as ca, coalesce(c.n, 0) as ce, case when coalesce(a.n, 0) + coalesce(c.n, 0) > 0 then coalesce(c.n, 0) / (coalesce(a.n, 0) + coalesce(c.n, 0)) else 0.0 end as i
from {packages} p left join (select src as pkg, count(*) as n from {imports} group by src) c on p.pkg = c.pkg left join (select dst as pkg, count(*) as n from {imports} group by dst) a on p.pkg = a.pkg"""
ENVY = """select decl, own, n, pkg as other from (select r.decl, r.pkg, r.n, d.pkg as home, coalesce(max(case when r.pkg = d.pkg then r.n end) over (partition by r.decl), 0) as own,
  row_number() over (partition by r.decl order by case when r.pkg = d.pkg then 1 else 0 end, r.n desc, r.pkg) as pos from {refs} r join {decls} d on r.decl = d.id) where pos = 1 and pkg <> home and n > own and n >= 4"""
TALLY = """select pkg, recv, sum(n) as methods, arg_min(delegates, (-n, delegates)) filter (delegates <> '') as field, max(n) filter (delegates <> '') as n
from (select pkg, split_part(name, '.', 1) as recv, delegates, count(*) as n from {decls} where kind = 'method' and not test and not generated group by all) group by pkg, recv"""
CALLERS = "select e.dst as id, count(*) filter (d.test) as tests, count(*) filter (not d.test) as prod from {edges} e join {decls} d on e.src = d.id where e.kind = 'caller' group by e.dst"
HOT = "select greatest(2, coalesce((select churn from (select churn, row_number() over (order by churn) as r, count(*) over () as n from {files} where not test and churn > 0) where r = n * 3 // 4 + 1), 2)) as hot"
MEASURED = "select d.*, f.churn, coalesce(c.tests, 0) as tests, coalesce(c.prod, 0) as prod, f.churn >= h.hot as busy, h.hot from {decls} d join {files} f on d.pkg = f.pkg and d.path = f.path left join {callers} c on d.id = c.id, {hot} h"
PKG_LINES = "select pkg, coalesce(sum(lines) filter (not test), 0) as lines, count(*) filter (not test) as n_files from {files} group by pkg"
CALLING = "select e.dst as id, d.pkg as \"from\", count(*) as n from {edges} e join {decls} d on e.src = d.id where e.kind = 'caller' and not d.test group by e.dst, d.pkg"

SMELLS = {
    "long_func": tiered("{decls} where " + FUNCS, "long-func", "lines", 60, 120, "lines || ' lines, '"),
    "complex_func": tiered("{decls} where " + FUNCS, "complex-func", "complexity", 10, 20, "'complexity ' || complexity || ', '"),
    "deep_nesting": finding("{decls} where nesting > 4 and " + FUNCS, "deep-nesting", "1", "'nesting ' || nesting || ', limit 4'", "nesting", "4"),
    "many_params": finding("{decls} where params > 5 and " + FUNCS, "many-params", "1", "params || ' params, limit 5'", "params", "5"),
    "large_file": row("{files} where lines > 600 and not test and not generated", "large-file", "case when lines > 1200 then 2 else 1 end", "pkg", "path", "0", "''", "path", "''", "lines", "case when lines > 1200 then 1200 else 600 end", "lines || ' lines, ' || case when lines > 1200 then 'high limit 1200' else 'limit 600' end"),
    "unused_export": finding(f"{{decls}} where exported and kind <> 'method' and pkg_name <> 'main' and not {PUBLIC} and {ELIGIBLE} and id not in (select id from {{used}})", "unused-export", "0", "'no use outside its package'"),
    "dead_code": finding(f"{{decls}} where {ELIGIBLE} and kind <> 'method' and not (kind = 'func' and (name = 'init' or name = 'main' and pkg_name = 'main')) and not (exported and pkg_name <> 'main') and id not in (select dst from {{edges}} where kind = 'caller')", "dead-code", "case when kind = 'func' then 1 else 0 end", "'no references'"),
    "envious_func": finding(f"(select * from {{decls}} where {FUNCS} and pkg_name <> 'main') d join {{envy}} v on d.id = v.decl", "envious-func", "0", "v.n || ' refs to ' || substr(other, 6) || ', ' || own || ' to own package'", "v.n", "own", "other"),
    "unstable_dep": row("{imports} m join {instability} p on m.src = p.pkg join {instability} q on m.dst = q.pkg where q.name <> 'main' and q.i > p.i", "unstable-dep", "1", "m.src", "''", "0", "''", "p.rel", "m.dst", "round(q.i * 100)", "round(p.i * 100)", "format('imports {{}} (I={{:.2f}}) from I={{:.2f}}', q.rel, q.i, p.i)"),
    "untested_package": row("{packages} where name <> 'main' and pkg not in (select pkg from {files} where test) and pkg not in (select r.pkg from {refs} r join {decls} d on r.decl = d.id where d.test and d.pkg <> r.pkg)", "untested-package", "0", "pkg", "''", "0", "''", "rel", "''", "0", "0", "'no test refers to it'"),
    "pass_through": finding(f"{{decls}} where {FUNCS} and forwards <> '' and name <> 'init' and not (pkg_name = 'main' and name = 'main')", "pass-through", "0", "'only calls ' || forwards || ' with its own arguments'"),
    "fixed_arg": finding(f"{{decls}} where {FUNCS} and fixed_param <> '' and not escapes and calls >= 3 and not (exported and {PUBLIC})", "fixed-arg", "0", "fixed_param || ' is ' || fixed_value || ' at all ' || calls || ' production call sites'", "calls", "3"),
    "middle_man": finding(f"(select d.*, t.n, t.methods, t.field from {{decls}} d join {{tally}} t on d.pkg = t.pkg and d.name = t.recv where {ELIGIBLE} and kind = 'type' and not deprecated and t.methods >= 3 and 2 * t.n >= t.methods)", "middle-man", "0", "n || ' of ' || methods || ' methods only call ' || field || '''s'"),
}
FINDINGS = " union all ".join(SMELLS.values())


def prognosis(source, key, lens, level, target, name, file, line, title, summary) -> str:
    return f"select {key} as key, '{lens}' as lens, cast({level} as bigint) as level, {target} as target, {name} as name, {file} as file, cast({line} as bigint) as line, {title} as title, {summary} as summary from {source}"


def plural(n: str, word: str) -> str:
    return f"{n} || ' {word}' || case when {n} = 1 then '' else 's' end"


DECL = ("id", "name", "path", "start_line")
PKG = ("pkg", "substr(pkg, 6)", "''", "0")
PARAMS = f"(select *, count(*) over (partition by pkg) as n, row_number() over (partition by pkg order by params desc, id) as pos from {{decls}} where params > 5 and {FUNCS}) where n < 3 or pos = 1"
PROGNOSES = {
    "hotspot": prognosis("{measured} where not test and complexity > 10 and busy", "'hotspot:' || id", "health", "1 + (complexity > 15)::int + (complexity > 20)::int", *DECL, "'Hard to follow, and it keeps changing'", "name || ' has ' || complexity || ' paths through it and its file changed in ' || " + plural("churn", "commit") + " || ' lately.'"),
    "complex": prognosis("{measured} where not test and complexity > 10 and not busy", "'complex:' || id", "health", "1", *DECL, "'Hard to follow'", "name || ' has ' || complexity || ' paths through it, past the limit of 10.'"),
    "untested": prognosis("{measured} where not test and complexity > 10 and tests = 0", "'untested:' || id", "tests", "1 + (busy and complexity > 15)::int", *DECL, "'Complex, and no test calls it'", "name || ' has ' || complexity || ' paths and no test calls it directly.'"),
    "reach": prognosis("(select d.*, c.callers, c.pkgs from {decls} d join (select id, sum(n) as callers, count(*) as pkgs from {calling} group by id) c on d.id = c.id where not d.test and callers >= 50)", "'reach:' || id", "reach", "1", *DECL, "'Many places depend on this'", "name || ' is used by ' || " + plural("callers", "declaration") + " || ' in ' || " + plural("pkgs", "package") + " || '.'"),
    "dominant": prognosis("(select *, sum(lines) over () as total from {pkg_lines}) where total >= 1000 and lines * 100 >= total * 50", "'dominant:' || pkg", "structure", "2", *PKG, "'One package holds most of the code'", "substr(pkg, 6) || ' holds ' || (lines * 100 // total) || '% of the module''s code, in ' || " + plural("n_files", "file") + " || '.'"),
    "wide": prognosis("(select d.pkg, count(*) as n, count(*) filter (d.exported) as exp from {decls} d join {files} f on d.pkg = f.pkg and d.path = f.path where not f.test and d.pkg in (select dst from {imports}) group by d.pkg) where n >= 8 and exp * 100 > n * 60", "'wide:' || pkg", "structure", "1", *PKG, "'Exports most of what it holds'", "substr(pkg, 6) || ' exports ' || exp || ' of its ' || n || ' declarations.'"),
    "unstable": prognosis("(" + SMELLS["unstable_dep"] + ")", "'unstable:' || package || '>' || target", "structure", "2", "package", "substr(package, 6)", "''", "0", "'Depends on something that changes more than it does'", "substr(package, 6) || ' imports ' || substr(target, 6) || ', which is less stable.'"),
    "params": prognosis(PARAMS, "'params:' || case when n >= 3 then pkg else id end", "tests", "case when n >= 3 then 2 else 1 end", *DECL, "case when n >= 3 then 'The same data passed around by hand' else 'Too many parameters' end", "case when n >= 3 then n || ' functions in ' || substr(pkg, 6) || ' take more than 5 parameters, up to ' || params || ' in ' || name || '.' else name || ' takes ' || params || ' parameters.' end"),
    "large_file": prognosis("(select l.*, f.churn, h.hot, split_part(l.file, '/', -1) as base from (" + SMELLS["large_file"] + ") l join {files} f on l.package = f.pkg and l.file = f.path, {hot} h)", "'large-file:' || file", "tests", "1 + (severity = 2 or churn >= hot)::int", "file", "base", "file", "0", "'A file doing too many things'", "base || ' has ' || measure || ' lines of code, past ' || limit_value || '.'"),
    "untested_package": prognosis("(select l.pkg, l.lines from (" + SMELLS["untested_package"] + ") u join {pkg_lines} l on u.package = l.pkg)", "'untested-pkg:' || pkg", "tests", "1 + (lines >= 200)::int", *PKG, "'No tests at all'", "'Nothing tests ' || substr(pkg, 6) || ' (' || lines || ' lines).'"),
}
ALL_PROGNOSES = " union all ".join(PROGNOSES.values())
CLI = "select key, key || chr(9) || case level when 3 then 'fix first' when 2 then 'fix soon' else 'when convenient' end || chr(9) || title || chr(9) || case when file = '' or file = name then name when line = 0 then name || ' (' || file || ')' else name || ' (' || file || ':' || line || ')' end as text from (" + ALL_PROGNOSES + ")"
HEATS = """select id, (case when cx > 0 and churn >= hot then least(cx + 1, 5) else cx end)::bigint as health, ((prod >= 1)::int + (prod >= 3)::int + (prod >= 10)::int + (prod >= 30)::int + (prod >= 100)::int)::bigint as reach,
  (1 + round(i * 4))::bigint as structure, greatest(case when cx > 0 and tests = 0 then cx else 0 end, case when params > 5 then 3 else 0 end)::bigint as tests
from (select m.*, s.i, case when kind in ('func', 'method') then (complexity >= 3)::int + (complexity >= 6)::int + (complexity >= 10)::int + (complexity >= 20)::int else 0 end as cx from {measured} m join {instability} s on m.pkg = s.pkg)"""

GONE = "select * from {base_decls} where id not in (select id from {head_decls})"
COME = "select * from {head_decls} where id not in (select id from {base_decls})"
MOVED = """select o.id as from_id, n.id as to_id, o.path as from_path, n.path as to_path, o.name, o.kind
from (select *, count(*) over (partition by name, kind, shape) as c from {gone}) o join (select *, count(*) over (partition by name, kind, shape) as c from {come}) n on o.name = n.name and o.kind = n.kind and o.shape = n.shape
where o.c = 1 and n.c = 1 and o.shape <> ''"""
RENAMED = "select b.id, coalesce(m.to_id, b.id) as to_id from {base_decls} b left join {moved} m on b.id = m.from_id"
OLD_EDGES = "select distinct coalesce(s.to_id, e.src) as src, coalesce(d.to_id, e.dst) as dst, e.kind from {base_edges} e left join {renamed} s on e.src = s.id left join {renamed} d on e.dst = d.id"
CHANGED = """select h.id, h.signature <> b.signature as sig_changed, h.complexity <> b.complexity as complexity_changed, h.lines <> b.lines as lines_changed, h.shape <> b.shape as shape_changed, h.complexity - b.complexity as complexity_delta, h.lines - b.lines as lines_delta
from {head_decls} h join {renamed} r on h.id = r.to_id join {base_decls} b on b.id = r.id where h.signature <> b.signature or h.complexity <> b.complexity or h.lines <> b.lines or h.shape <> b.shape"""


def of_side(sql: str, side: str) -> str:
    for n in ("decls", "edges", "files", "packages", "imports", "refs", "outside", "used", "instability", "envy", "tally"):
        sql = sql.replace("{" + n + "}", "{" + f"{side}_{n}" + "}")
    return sql


_KEY = "rule || '|' || case when decl <> '' then '' else package end || '|' || case when decl <> '' then '' else file end || '|' || subject || '|' || target"
_SORT = "severity desc, package, file, line, rule, decl, target"


def _pass(key: str, b: str, h: str) -> tuple[str, str]:
    rn = f"row_number() over (partition by {key} order by {_SORT}) as rn"
    num = lambda t: f"(select *, {rn} from {t})"
    anti = lambda x, y: f"select x.* exclude rn from {num(x)} x anti join {num(y)} y using ({key}, rn)"
    return anti(b, h), anti(h, b)


_b1, _h1 = _pass("identity, decl", "{base_found}", "{head_found}")
_b2, _h2 = _pass("identity", "{base_left}", "{head_left}")
DELTA_PARTS = {"base_found": f"select *, {_KEY} as identity from ({of_side(FINDINGS, 'base')})", "head_found": f"select *, {_KEY} as identity from ({of_side(FINDINGS, 'head')})", "base_left": _b1, "head_left": _h1}
DELTA = f"select 'fixed' as change, * exclude identity from ({_b2}) union all select 'introduced' as change, * exclude identity from ({_h2})"

#: Spans of lines that the edit changed, by side.
HUNKS = {side: f"select path, start_line as start, greatest(lines, 1) as n from {{{side}_decls}} where k % 29 = 0 or k % 23 = 0 or k % {k} = 0" for side, k in (("base", 19), ("head", 17))}
LINES = "select d.id, cast(sum(least(d.end_line, h.start + h.n - 1) - greatest(d.start_line, h.start) + 1) as bigint) as lines from {%s_decls} d join {%s_hunks} h on d.path = h.path and h.start <= d.end_line and h.start + h.n - 1 >= d.start_line group by d.id"
TOUCHED = "select distinct d.id from {head_decls} d join {head_hunks} h on d.path = h.path and case when h.n = 0 then d.start_line <= h.start and h.start + 1 <= d.end_line else h.start <= d.end_line and h.start + h.n - 1 >= d.start_line end"
UNITS = f"""
with t as (select id from {{old_lines}} union select id from {{new_lines}}),
hc as (select e.dst as id, count(*) filter (not coalesce(c.test, false)) as prod, count(*) filter (coalesce(c.test, false)) as tests from {{head_edges}} e left join {{head_decls}} c on e.src = c.id where e.kind = 'caller' group by e.dst),
bc as (select e.dst as id, count(*) filter (not c.test) as prod, count(*) filter (c.test) as tests from {{base_edges}} e join {{head_decls}} c on e.src = c.id where e.kind = 'caller' group by e.dst),
gain as (select x.dst as id, count(*) as n from (select src, dst, kind from {{head_edges}} except select src, dst, kind from {{old_edges}}) x left join {{head_decls}} c on x.src = c.id where not coalesce(c.test, false) group by x.dst),
u as (select t.id, b.id is not null as was, h.id is not null as here, coalesce(h.name, b.name) as name, coalesce(h.path, b.path) as file, b.path as o_path, coalesce(h.kind, b.kind) as kind, coalesce(h.pkg, b.pkg) as pkg, coalesce(h.pkg_name, b.pkg_name) as pkg_name,
  coalesce(h.exported, b.exported) as exported, coalesce(h.test, b.test) as test, coalesce(h.data, b.data) as data, coalesce(b.shape = h.shape, false) as same, coalesce(b.signature <> h.signature, false) as resigned, coalesce(b.path <> h.path, false) as elsewhere,
  h.complexity as cx, h.complexity - b.complexity as delta, coalesce(case when h.id is null then bc.prod else hc.prod end, 0) as prod, coalesce(case when h.id is null then bc.tests else hc.tests end, 0) as tests, coalesce(gain.n, 0) as gained, coalesce(o.lines, 0) as deleted, coalesce(n.lines, 0) as added
  from t left join {{base_decls}} b on t.id = b.id left join {{head_decls}} h on t.id = h.id left join hc on t.id = hc.id left join bc on t.id = bc.id left join gain on t.id = gain.id left join {{old_lines}} o on t.id = o.id left join {{new_lines}} n on t.id = n.id),
v as (select *, here and kind in ('func', 'method') as func, here and kind in ('func', 'method') and not test and tests = 0 as bare, case when not was then 'added' when not here then 'removed' when same and elsewhere then 'moved' else 'modified' end as change from u)
select id, name, file, kind, change, cast(case when same then 4 when test then 2 when exported and {PUBLIC} and (change <> 'modified' or resigned) then 0 when data then 3 else 1 end as bigint) as lane,
 cast(case when same then 0 else least(added + deleted, 40) // 4 + case when resigned then 6 else 0 end + case when here then 0 else 4 end + 3 * least(prod, 10) + case when was and here then 2 * least(gained, 5) else 0 end + case when exported and not test then 4 else 0 end
   + case when func then cx // 2 + case when was and delta <> 0 then 2 * greatest(delta, 0) else 0 end else 0 end + case when bare then 5 else 0 end end as bigint) as risk,
 case when same then case when elsewhere then 'moved from ' || o_path else 'comments or layout only' end else array_to_string(list_filter([case when resigned then 'signature changed' end, case when prod + tests > 0 then {plural("(prod + tests)", "caller")} || case when tests > 0 then ' (' || tests || ' in tests)' else '' end end,
   case when was and here and gained > 0 then {plural("gained", "new reference")} end, case when data then 'long string literal' end, case when exported and not test then 'exported' end,
   case when func and was and delta <> 0 then 'complexity ' || cx || ' (' || case when delta > 0 then '+' else '' end || delta || ')' when func and cx > 10 then 'complexity ' || cx end, case when bare then 'no direct test' end], lambda x: x is not null), '; ') end as reasons, cast(added as bigint) as added, cast(deleted as bigint) as deleted from v
"""

SHARED = {"outside": OUTSIDE, "used": USED, "instability": INSTABILITY, "envy": ENVY, "tally": TALLY, "callers": CALLERS, "hot": HOT, "measured": MEASURED, "pkg_lines": PKG_LINES, "calling": CALLING, "gone": GONE, "come": COME, "moved": MOVED, "renamed": RENAMED, "old_edges": OLD_EDGES}
SHARED |= {f"{side}_{n}": of_side(SHARED[n], side) for side in ("base", "head") for n in ("outside", "used", "instability", "envy", "tally")}
SHARED |= DELTA_PARTS | {f"{s}_hunks": q for s, q in HUNKS.items()} | {"old_lines": LINES % ("base", "base"), "new_lines": LINES % ("head", "head")}

EDGE = "select src, dst, kind from {head_edges}"
DIFFS = {
    "added": "select id, kind, path from {come} where id not in (select to_id from {moved})",
    "removed": "select id, kind, path from {gone} where id not in (select from_id from {moved})",
    "moved": "select * from {moved}",
    "changed": CHANGED,
    "edges_added": EDGE + " except select src, dst, kind from {old_edges}",
    "edges_removed": "select src, dst, kind from {old_edges} except " + EDGE,
    "imports_added": "select src, dst from {head_imports} except select src, dst from {base_imports}",
    "imports_removed": "select src, dst from {base_imports} except select src, dst from {head_imports}",
    "findings_delta": DELTA,
}


def sql(text: str) -> str:
    return ctes(text, **SHARED)
