"""Queries over keys, texts and layouts, for which the engines' functions have different names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import handoff, layout, prognoses, review, smells
from graphloom.plans import oracle
from graphloom.sources.binding import bound, versions


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line (from 1) and text."""
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("doc_id", (F.col("at") + 1).cast("bigint").alias("line"), "text")


def unit_keys(spark, sf_dir):
    d = bound(spark, sf_dir).decls
    return d.select("id", review.unit_key(F.col("id"), F.concat_ws("\n", "signature", "shape")).alias("key"))


def normalised(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.trim(F.regexp_replace("text", "[ \t\n\r]+", " ")).alias("norm"))


def fingerprints(spark, sf_dir):
    f = bound(spark, sf_dir).files
    rows = F.sort_array(F.collect_list(F.concat_ws("|", "path", F.col("lines").cast("string"), F.col("churn").cast("string"))))
    return f.groupBy("pkg").agg(F.sha2(F.array_join(rows, "\n"), 256).alias("fingerprint"))


def generated_header(spark, sf_dir):
    """Whether the first five lines of the first 512 bytes say that a tool wrote the text."""
    head = F.substring_index(F.substring(F.col("text").cast("binary"), 1, 512).cast("string"), "\n", 5)
    return _documents(spark, sf_dir).select("doc_id", head.rlike("(?i)@generated|code generated|do not edit|auto-?generated").alias("generated"))


def call_sites(spark, sf_dir):
    """The first line of each text that names a word."""
    return _lines(spark, sf_dir).where(F.col("text").rlike(r"(^|[^A-Za-z])the($|[^A-Za-z])")).groupBy("doc_id").agg(F.min("line").alias("line"))


def excerpts(spark, sf_dir):
    """The first lines of each text, with a last one that counts the rest."""
    most = 40
    t = F.split("text", "\n")
    more = F.size(t) - most
    return _documents(spark, sf_dir).select("doc_id", F.array_join(F.when(more > 0, F.concat(F.slice(t, 1, most), F.array(F.concat(F.lit("… "), more.cast("string"), F.lit(" more lines"))))).otherwise(t), "\n").alias("code"))


def thread_text(spark, sf_dir):
    """Each declaration's callers and users in order, as one text."""
    g = bound(spark, sf_dir)
    e = g.edges.select("dst", "src").distinct()
    e = e.join(g.decls.select(F.col("id").alias("src"), "path", "start_line"), "src")
    row = F.format_string("%s · %s:%d", "src", "path", "start_line")
    return e.groupBy("dst").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("src", row.alias("t")))), lambda x: x["t"]), " ← ").alias("text"))


def edited(spark, sf_dir):
    """key, old_text and new_text of each document; every fifth line is edited in the new one."""
    t = F.split("text", "\n")
    new = F.transform(t, lambda x, i: F.when(i % 5 == 4, F.concat(x, F.lit(" edited"))).otherwise(x))
    return _documents(spark, sf_dir).select(F.col("doc_id").alias("key"), F.col("text").alias("old_text"), F.array_join(new, "\n").alias("new_text"))


def line_diffs(spark, sf_dir):
    return review.diff_texts(edited(spark, sf_dir))


def treemap(spark, sf_dir):
    d = bound(spark, sf_dir).decls
    items = d.select(F.col("pkg").alias("parent"), "id", F.col("lines").cast("double").alias("weight"), F.lit(0.0).alias("px"), F.lit(0.0).alias("py"), F.lit(1000.0).alias("pw"), F.lit(600.0).alias("ph"))
    return layout.place(items)


def atlas(spark, sf_dir):
    return layout.atlas(bound(spark, sf_dir).decls)


def handoffs(spark, sf_dir):
    """A text for each package's findings of the highest severity."""
    g = bound(spark, sf_dir).kept()
    f = smells.union(g).where("severity = 2")
    pos = F.row_number().over(Window.partitionBy("package").orderBy("file", "line", "rule", "decl"))
    none = F.array().cast("array<string>")
    return handoff.render(f.select(F.col("package").alias("basket"), pos.alias("pos"), F.col("package").alias("repo"), prognoses.rel_of(F.col("package")).alias("repo_name"), F.lit("finding").alias("kind"), F.concat_ws(": ", "rule", "subject").alias("title"), F.concat_ws(":", "file", F.col("line").cast("string")).alias("place_text"), F.lit("wt").alias("scope"), F.col("detail").alias("body"), none.alias("steps"), F.lit("").alias("check"), none.alias("code")))


def complexity_points(spark, sf_dir):
    base, head = versions(spark, sf_dir)
    both = head.decls.where("kind in ('func', 'method')").select("id", "complexity").join(base.decls.select("id", F.col("complexity").alias("old")), "id", "left")
    d = F.col("complexity") - F.col("old")
    points = F.floor(F.col("complexity") / 2) + F.when(d > 0, 2 * d).otherwise(0)
    return both.select("id", points.cast("bigint").alias("points"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sc09_unit_keys": unit_keys,
    "sc14_norm": normalised,
    "sc18_fingerprints": fingerprints,
    "flt16_generated_header": generated_header,
    "sc19_call_sites": call_sites,
    "ui02_excerpts": excerpts,
    "ui03_thread_text": thread_text,
    "rv03_line_diffs": line_diffs,
    "rv09_complexity_points": complexity_points,
    "tm01_treemap": treemap,
    "tm03_atlas": atlas,
    "snk07_handoff": handoffs,
}

ORACLES = {
    # the first 512 bytes: as many code points as their bytes fit in, and more do no harm behind the last whole one
    "flt16_generated_header": r"select doc_id, regexp_matches(array_to_string(string_split(h, chr(10))[1:5], chr(10)), '(?i)@generated|code generated|do not edit|auto-?generated') as generated from (select doc_id, list_reduce(list_prepend('', list_filter(list_transform(range(1, 513), lambda n: substr(text, 1, n)), lambda x: strlen(x) <= 512)), lambda a, x: x) as h from {documents})",
    "sc09_unit_keys": "select id, id || '@' || substr(sha256(signature || chr(10) || shape), 1, 12) as key from {decls}",
    "sc14_norm": "select doc_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) as norm from {documents}",
    "sc18_fingerprints": "select pkg, sha256(string_agg(path || '|' || lines || '|' || churn, chr(10) order by path || '|' || lines || '|' || churn)) as fingerprint from {files} group by pkg",
    "sc19_call_sites": "select doc_id, min(i) as line from (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from {documents}) where regexp_matches(t, '(^|[^A-Za-z])the($|[^A-Za-z])') group by doc_id",
    "ui02_excerpts": "select doc_id, case when len(t) > 40 then array_to_string(t[1:40], chr(10)) || chr(10) || '… ' || (len(t) - 40) || ' more lines' else array_to_string(t, chr(10)) end as code from (select doc_id, string_split(text, chr(10)) as t from {documents})",
    "ui03_thread_text": "select dst, string_agg(src || ' · ' || path || ':' || start_line, ' ← ' order by src) as text from (select distinct e.dst, e.src, d.path, d.start_line from {edges} e join {decls} d on e.src = d.id) group by dst",
    "rv09_complexity_points": "select h.id, cast(h.complexity // 2 + greatest(coalesce(h.complexity - b.complexity, 0), 0) * 2 as bigint) as points from {head_decls} h left join {base_decls} b on h.id = b.id where h.kind in ('func', 'method')",
}


_ITEM = "chr(10) || '#### ' || rule || ': ' || subject || chr(10) || chr(10) || 'Where: `' || file || ':' || line || '`' || chr(10) || 'Scope: working tree' || chr(10) || case when detail <> '' then chr(10) || detail || chr(10) else '' end"
ORACLES["snk07_handoff"] = (
    "select package as basket, '# Handoff' || chr(10) || chr(10) || 'Goal: resolve each item below.' || chr(10) || chr(10) || count(*) || ' item' || case when count(*) = 1 then '' else 's' end || ', in the order to work through.' || chr(10) || chr(10) || '- Repos: ' || substr(package, 6) || chr(10) || chr(10) || '## ' || substr(package, 6) || chr(10) || chr(10) || '### Findings' || chr(10) || "
    f"string_agg({_ITEM}, '' order by file, line, rule, decl) as text from ({oracle.FINDINGS}) where severity = 2 group by package"
)


def oracle_sql() -> dict[str, str]:
    return {n: oracle.sql(t) for n, t in ORACLES.items()}
