"""Binds the star-schema tables to a code graph, in SQL that Spark and DuckDB both run.

part → declarations, brand → packages, brand and type → files, consecutive lines of an order → edges,
events → commits. A second snapshot (base) differs from the first (head) by fixed remainders of keys.
Braces hold the names of tables; `Graph` fills them with DataFrames and `ctes` with names of CTEs.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.checkpoints import stored

MODULE = "shop"

RAW = """
with r as (select p_partkey as k, cast(substr(p_brand, 7) as int) as b, p_type as pt, p_size as z, p_partkey % 5 as m,
    cast(floor(p_partkey / 5) as bigint) % 20 as t, cast(floor(p_retailprice * 10) as bigint) % 150 as lines from {part})
select k, b, (case when b % 3 = 0 then 'shop/internal/b' else 'shop/b' end) || cast(b as string) as pkg,
  case when b % 10 = 0 then 'main' else 'b' || cast(b as string) end as pkg_name,
  'b' || cast(b as string) || '/' || lower(pt) || '.src' as path, pt = 'PROMO' as test, pt = 'STANDARD' and b % 5 = 0 as generated,
  case m when 1 then 'method' when 3 then 'type' when 4 then 'const' else 'func' end as kind,
  case m when 1 then 'T' || cast(t as string) || '.m' || cast(k as string) when 3 then 'T' || cast(t as string)
    when 4 then 'C' || cast(k as string) else 'f' || cast(k as string) end as name,
  k % 2 = 0 as exported, k % 41 = 0 as data, lines,
  cast(case when m < 3 then floor(z / 2) else 0 end as bigint) as complexity, cast(case when m < 3 then z % 7 else 0 end as bigint) as nesting,
  cast(case when m < 3 then k % 9 else 0 end as bigint) as params,
  case when m = 4 then 'T' || cast(t as string) || ', const' else 'sig' || cast(k % 9 as string) end as signature,
  's' || cast(z as string) || '-' || cast(k % 7 as string) as shape,
  case when m < 3 and k % 31 = 0 then 'inner' else '' end as forwards,
  case when m = 1 and t % 2 = 0 and k % 3 <> 0 then (case when k % 7 = 0 then 'out' else 'inner' end) else '' end as delegates,
  k % 97 = 0 as deprecated, cast(k % 6 as bigint) as calls, k % 17 = 3 as escapes,
  case when m < 3 and k % 13 = 0 then 'p0' else '' end as fixed_param, case when m < 3 and k % 13 = 0 then 'v' || cast(k % 3 as string) else '' end as fixed_value
from r
"""

HEAD = "select * from {raw} where k % 19 <> 0"

BASE = """
select k, b, case when k % 23 = 0 then 'shop/b' || cast(b + 100 as string) else pkg end as pkg,
  case when k % 23 = 0 then 'b' || cast(b + 100 as string) else pkg_name end as pkg_name,
  case when k % 23 = 0 then 'b' || cast(b + 100 as string) || '/old.src' else path end as path, test, generated, kind, name, exported, data,
  case when k % 29 = 0 then lines + 7 else lines end as lines, case when k % 29 = 0 and complexity > 0 then complexity + 3 else complexity end as complexity,
  nesting, params, case when k % 29 = 0 then signature || '!' else signature end as signature, case when k % 58 = 0 then shape || 'x' else shape end as shape,
  forwards, delegates, deprecated, calls, escapes, fixed_param, fixed_value
from {raw} where k % 17 <> 0
"""

DECLS = """
select k, b, pkg || '.' || name || case when row_number() over (partition by pkg, name order by path, k) > 1
    then '#' || cast(row_number() over (partition by pkg, name order by path, k) as string) else '' end as id,
  name, kind, pkg, pkg_name, path, test, generated, exported, data,
  cast(1 + coalesce(sum(lines + 1) over (partition by path order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as start_line,
  cast(greatest(lines, 1) + coalesce(sum(lines + 1) over (partition by path order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as end_line,
  lines, complexity, nesting, params, signature, shape, forwards, delegates, deprecated, calls, escapes, fixed_param, fixed_value, k as ord
from {raw}
"""

#: Edges by keys, which are the same in all versions.
PAIRS = """
with p as (select lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as s,
    case when l_quantity = 50 then l_partkey % 5 else l_partkey end as d, l_linenumber as w, l_returnflag as f, l_quantity as q from {lineitem}),
  e as (select s, d, 'caller' as kind, cast(sum(w) as bigint) as n from p where s <> d and f = 'R' and q >= 45 group by s, d
    union all select s, d, 'user' as kind, cast(sum(w) as bigint) as n from p where s <> d and f = 'A' and q >= 48 group by s, d)"""

EDGES = PAIRS + """
select a.id as src, z.id as dst, e.kind, e.n from e join {decls} a on e.s = a.k join {decls} z on e.d = z.k
"""

FILES = """
with f as (select pkg, path, bool_or(test) as test, bool_or(generated) as generated, cast(sum(lines) as bigint) as lines from {decls} group by pkg, path),
  o as (select pkg, path, row_number() over (order by pkg, path) - 1 as file_no from f),
  c as (select user_id % 150 as file_no, count(*) as churn from {events}
    where ts >= (select max(ts) from {events}) - interval 7 days group by user_id % 150)
select f.pkg, f.path, f.test, f.generated, f.lines, cast(coalesce(c.churn, 0) as bigint) as churn
from f join o on f.pkg = o.pkg and f.path = o.path left join c on o.file_no = c.file_no
"""

PACKAGES = "select pkg, max(pkg_name) as name, substr(pkg, 6) as rel from {decls} group by pkg"

IMPORTS = """
select distinct a.pkg as src, z.pkg as dst from {edges} e join {decls} a on e.src = a.id join {decls} z on e.dst = z.id
where e.kind = 'caller' and not a.test and a.pkg <> z.pkg and (a.b * 7 + z.b * 3) % 11 = 0
"""

REFS = "select e.src as decl, z.pkg as pkg, cast(sum(e.n) as bigint) as n from {edges} e join {decls} z on e.dst = z.id where e.kind = 'caller' group by e.src, z.pkg"

#: Tables of one snapshot, in order of need.
TABLES = {"decls": DECLS, "edges": EDGES, "files": FILES, "packages": PACKAGES, "imports": IMPORTS, "refs": REFS}
SOURCES = ("part", "lineitem", "events")

_one_at_a_time = Lock()


@dataclass
class Graph:
    """The tables of a snapshot as DataFrames, each planned when first asked for."""

    spark: SparkSession
    raw: DataFrame | None
    sources: dict[str, DataFrame] = field(default_factory=dict)
    given: dict[str, DataFrame] = field(default_factory=dict)
    module: str = MODULE
    lang: str = ""

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        known = {**{n: getattr(self, n) for n in TABLES if "{" + n + "}" in text}, **{n: d for n, d in self.sources.items() if "{" + n + "}" in text}}
        if "{raw}" in text:
            known["raw"] = self.raw
        return self.spark.sql(text, **known, **more)

    def kept(self, *names: str) -> Graph:
        """The same graph with its tables (or some of them) stored, those that need no other at once: for plans that read them many times."""

        def keep(name: str) -> None:
            if name not in self.given:
                if name == "edges":
                    self._pair()
                self.given[name] = stored(self._table(name))
                self.__dict__.pop(name, None)

        wanted = names or ("decls", "edges", "files", "imports", "refs")
        for name in wanted[:2]:
            keep(name)
        with ThreadPoolExecutor(3) as pool:
            list(pool.map(keep, wanted[2:]))
        return self

    def _pair(self) -> None:
        """Stores the edges by keys, once for all versions that have the same sources."""
        with _one_at_a_time:
            if "pairs" not in self.sources and "lineitem" in self.sources:
                self.sources["pairs"] = stored(self.sql(PAIRS + " select * from e"))

    def _table(self, name: str) -> DataFrame:
        if name in self.given:
            return self.given[name]
        if name == "edges" and "pairs" in self.sources:
            by = lambda end, key: self.decls.select(F.col("id").alias(end), F.col("k").alias(key))
            return self.sources["pairs"].hint("merge").join(by("src", "s"), "s").hint("merge").join(by("dst", "d"), "d").select("src", "dst", "kind", "n")
        if name == "imports":
            return self.spark.sql(IMPORTS, decls=self.decls.hint("merge"), edges=self.edges)
        return self.sql(TABLES[name])

    decls = cached_property(lambda self: self._table("decls"))
    edges = cached_property(lambda self: self._table("edges"))
    files = cached_property(lambda self: self._table("files"))
    packages = cached_property(lambda self: self._table("packages"))
    imports = cached_property(lambda self: self._table("imports"))
    refs = cached_property(lambda self: self._table("refs"))


def both_kept(base: Graph, head: Graph, *names: str) -> tuple[Graph, Graph]:
    """Two graphs with their tables stored at the same time."""
    with ThreadPoolExecutor(2) as pool:
        return tuple(pool.map(lambda g: g.kept(*names), (base, head)))


def sources_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in SOURCES}


def bound(spark: SparkSession, sf_dir: str, sources: dict[str, DataFrame] | None = None) -> Graph:
    """The graph of all declarations, with the sources of others where they are given."""
    src = sources_of(spark, sf_dir) if sources is None else sources
    return Graph(spark, spark.sql(RAW, part=src["part"]), src)


def versions(spark: SparkSession, sf_dir: str) -> tuple[Graph, Graph]:
    """Base and head of the edited graph."""
    src = sources_of(spark, sf_dir)
    raw = spark.sql(RAW, part=src["part"])
    return Graph(spark, spark.sql(BASE, raw=raw), src), Graph(spark, spark.sql(HEAD, raw=raw), src)


def _needs(text: str, names: dict[str, str]) -> list[str]:
    out: list[str] = []
    for n, sql in names.items():
        if "{" + n + "}" in text:
            out += [x for x in [*_needs(sql, {k: v for k, v in names.items() if k != n}), n] if x not in out]
    return out


def ctes(text: str, **more: str) -> str:
    """`text` for DuckDB: names in braces become CTEs, with those that they need. base_* and head_* are the versions' tables."""
    names: dict[str, str] = {"raw": RAW, **TABLES}
    for side, sql in (("base", BASE), ("head", HEAD)):
        names[f"{side}_raw"] = sql
        for n, t in TABLES.items():
            for other in ("raw", *TABLES):
                t = t.replace("{" + other + "}", "{" + f"{side}_{other}" + "}")
            names[f"{side}_{n}"] = t
    names |= more
    used = _needs(text, names)
    fill = {n: n for n in (*names, *SOURCES, "documents")}
    body = ",\n".join(f"{n} as ({names[n].format(**fill)})" for n in used)
    own = text.strip().format(**fill)
    if body and own[:5].lower() == "with ":  # its own CTEs come after those that it needs
        return f"with {body},\n{own[5:]}"
    return (f"with {body}\n" if body else "") + own
