"""The thirteen smell rules, as projections of a snapshot's tables; `find` is their union in order of severity."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import fixed2, importable, percent, rel_of, tier
from graphloom.sources.binding import Graph

# Limits of the rules, and (warn, high) pairs.
LONG_FUNC, COMPLEX_FUNC, LARGE_FILE = (60, 120), (10, 20), (600, 1200)
DEEP_NESTING, MANY_PARAMS, ENVY_REFS, FIXED_CALLS, MIDDLE_METHODS = 4, 5, 4, 3, 3
INFO, WARN, HIGH = 0, 1, 2
COLUMNS = ("rule", "severity", "package", "file", "line", "decl", "subject", "target", "measure", "limit_value", "detail")


def _values(**values: Column | str | int) -> list[Column]:
    """The columns of a finding, with their types."""
    kinds = {"severity": "bigint", "line": "bigint", "measure": "bigint", "limit_value": "bigint"}
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [lit(values[n]).cast(kinds.get(n, "string")).alias(n) for n in COLUMNS]


def _row(df: DataFrame, *values: Column | str | int) -> DataFrame:
    return df.select(*_values(**dict(zip(COLUMNS, values, strict=True))))


@dataclass(frozen=True)
class Rule:
    """What a rule says of a declaration outside tests and generated files; `needs` names what is joined to it first."""

    when: Column
    finding: Column
    needs: tuple[str, ...] = ()


def _rule(rule: str, severity: Column | int, when: Column | str, detail: Column | str, measure: Column | int = 0, limit: Column | int = 0, target: Column | str = "", needs: tuple[str, ...] = ()) -> Rule:
    values = _values(rule=rule, severity=severity, package=F.col("pkg"), file=F.col("path"), line=F.col("start_line"), decl=F.col("id"), subject=F.col("name"), target=target, measure=measure, limit_value=limit, detail=detail)
    return Rule(F.expr(when) if isinstance(when, str) else when, F.struct(*values), needs)


def eligible(g: Graph) -> DataFrame:
    return g.decls.where("not test and not generated")


def funcs(g: Graph) -> DataFrame:
    return eligible(g).where(F.col("kind").isin("func", "method"))


def large_file(g: Graph) -> DataFrame:
    severity, limit, word = tier(F.col("lines"), *LARGE_FILE)
    f = g.files.where(F.col("lines") > LARGE_FILE[0]).where("not test and not generated")
    return _row(f, "large-file", severity, F.col("pkg"), F.col("path"), 0, "", F.col("path"), "", F.col("lines"), limit, F.format_string("%d lines, %s %d", "lines", word, limit))


def used_outside(g: Graph) -> DataFrame:
    """Ids of declarations used from another package; a constant is used where its type is."""
    ends = g.decls.select("id", "pkg")
    direct = g.edges.join(ends.select(F.col("id").alias("src"), F.col("pkg").alias("from")), "src").join(ends.select(F.col("id").alias("dst"), F.col("pkg").alias("to")), "dst").where(F.col("from") != F.col("to")).select(F.col("dst").alias("id")).distinct()
    consts = g.decls.where("kind = 'const'").select("id", F.concat_ws(".", "pkg", F.split_part("signature", F.lit(", "), F.lit(1))).alias("type_id"))
    return direct.union(consts.join(direct.withColumnRenamed("id", "type_id"), "type_id", "left_semi").select("id")).distinct()


def called(g: Graph) -> DataFrame:
    return g.edges.where("kind = 'caller'").select(F.col("dst").alias("id")).distinct()


def envied(g: Graph) -> DataFrame:
    """id of a function that refers more to another package than to its own: that package, references to it and to its own."""
    d = funcs(g).where("pkg_name <> 'main'")
    r = g.refs.join(d.select(F.col("id").alias("decl"), F.col("pkg").alias("home")), "decl")
    own = F.coalesce(F.sum(F.when(F.col("pkg") == F.col("home"), F.col("n"))), F.lit(0))
    # the largest count, then the least package: a struct's order with the sign turned
    best = F.min(F.when(F.col("pkg") != F.col("home"), F.struct((-F.col("n")).alias("n"), "pkg")))
    top = r.groupBy("decl").agg(own.alias("envy_own"), best.alias("best")).select(F.col("decl").alias("id"), "envy_own", (-F.col("best.n")).alias("envy_n"), F.col("best.pkg").alias("envy_of"))
    return top.where((F.col("envy_n") > F.col("envy_own")) & (F.col("envy_n") >= ENVY_REFS))


def judged(g: Graph, rules: Sequence[Rule]) -> DataFrame:
    """Findings of rules about declarations, which are read once, whatever the number of rules."""
    needs = {n for r in rules for n in r.needs}
    d = eligible(g)
    if "used" in needs:
        d = d.join(used_outside(g).withColumn("used", F.lit(True)), "id", "left")
    if "called" in needs:
        d = d.join(called(g).withColumn("called", F.lit(True)), "id", "left")
    if "envied" in needs:
        d = d.join(envied(g), "id", "left")
    if "middle" in needs:
        t = middle_tally(g).where((F.col("methods") >= MIDDLE_METHODS) & (2 * F.col("n") >= F.col("methods")))
        d = d.join(t.select("pkg", F.col("recv").alias("name"), "methods", "field", F.col("n").alias("middle_n")), ["pkg", "name"], "left")
    found = F.array_compact(F.array(*(F.when(r.when, r.finding) for r in rules)))
    return d.select(F.explode(found).alias("f")).select("f.*")


def instability(g: Graph) -> DataFrame:
    """pkg and the share of its imports among its links, 0 where it has none."""
    ce = g.imports.groupBy(F.col("src").alias("pkg")).agg(F.count(F.lit(1)).alias("ce"))
    ca = g.imports.groupBy(F.col("dst").alias("pkg")).agg(F.count(F.lit(1)).alias("ca"))
    both = g.packages.join(ce, "pkg", "left").join(ca, "pkg", "left").na.fill(0, ["ce", "ca"])
    return both.select("pkg", "name", "rel", "ca", "ce", F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(F.lit(0.0)).alias("i"))


def unstable_dep(g: Graph) -> DataFrame:
    i = instability(g)
    p, q = i.select(F.col("pkg").alias("src"), F.col("rel").alias("p_rel"), F.col("i").alias("ip")), i.select(F.col("pkg").alias("dst"), F.col("rel").alias("q_rel"), F.col("name").alias("q_name"), F.col("i").alias("iq"))
    d = g.imports.join(p, "src").join(q, "dst").where("q_name <> 'main' and iq > ip")
    return _row(d, "unstable-dep", WARN, F.col("src"), "", 0, "", F.col("p_rel"), F.col("dst"), percent(F.col("iq")), percent(F.col("ip")), F.format_string("imports %s (I=%s) from I=%s", "q_rel", fixed2(F.col("iq")), fixed2(F.col("ip"))))


def untested_package(g: Graph) -> DataFrame:
    tested = g.files.where("test").select("pkg")
    tests = g.decls.where("test").select(F.col("id").alias("decl"), F.col("pkg").alias("home"))
    outside = g.refs.join(tests, "decl").where(F.col("pkg") != F.col("home")).select("pkg")
    p = g.packages.where("name <> 'main'").join(tested, "pkg", "left_anti").join(outside, "pkg", "left_anti")
    return _row(p, "untested-package", INFO, F.col("pkg"), "", 0, "", F.col("rel"), "", 0, 0, "no test refers to it")


def middle_tally(g: Graph) -> DataFrame:
    """pkg, receiver, methods, field delegated to most (ties to the least name) and how often."""
    m = g.decls.where("kind = 'method' and not test and not generated").withColumn("recv", F.split_part("name", F.lit("."), F.lit(1)))
    per = m.groupBy("pkg", "recv", "delegates").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.when(F.col("delegates") != "", F.struct((-F.col("n")).alias("n"), "delegates")))
    return per.groupBy("pkg", "recv").agg(F.sum("n").alias("methods"), best.alias("best")).select("pkg", "recv", "methods", F.coalesce("best.delegates", F.lit("")).alias("field"), F.coalesce(-F.col("best.n"), F.lit(0)).alias("n"))


def _tiered(rule: str, value: str, limits: tuple[int, int], text: str) -> Rule:
    severity, limit, word = tier(F.col(value), *limits)
    return _rule(rule, severity, _func() & (F.col(value) > limits[0]), F.format_string(text + ", %s %d", F.col(value), word, limit), F.col(value), limit)


def _func() -> Column:
    return F.col("kind").isin("func", "method")


@cache
def decl_rules(module: str) -> dict[str, Rule]:
    """Columns need a session, so these are made when first asked for."""
    main, public = F.col("pkg_name") == "main", importable(F.col("pkg"), F.col("pkg_name"), module)
    alive = (F.col("kind") == "method") | ((F.col("kind") == "func") & ((F.col("name") == "init") | ((F.col("name") == "main") & main))) | (F.col("exported") & ~main)
    unused = F.col("exported") & (F.col("kind") != "method") & ~main & ~public & F.col("used").isNull()
    entry = (F.col("name") == "init") | (main & (F.col("name") == "main"))
    fixed = _func() & (F.col("fixed_param") != "") & ~F.col("escapes") & (F.col("calls") >= FIXED_CALLS) & ~(F.col("exported") & public)
    envy = F.format_string("%d refs to %s, %d to own package", "envy_n", rel_of(F.col("envy_of"), module), "envy_own")
    return {
        "long_func": _tiered("long-func", "lines", LONG_FUNC, "%d lines"),
        "complex_func": _tiered("complex-func", "complexity", COMPLEX_FUNC, "complexity %d"),
        "deep_nesting": _rule("deep-nesting", WARN, _func() & (F.col("nesting") > DEEP_NESTING), F.format_string(f"nesting %d, limit {DEEP_NESTING}", "nesting"), F.col("nesting"), DEEP_NESTING),
        "many_params": _rule("many-params", WARN, _func() & (F.col("params") > MANY_PARAMS), F.format_string(f"%d params, limit {MANY_PARAMS}", "params"), F.col("params"), MANY_PARAMS),
        "unused_export": _rule("unused-export", INFO, unused, "no use outside its package", needs=("used",)),
        "dead_code": _rule("dead-code", F.when(F.col("kind") == "func", WARN).otherwise(INFO), ~alive & F.col("called").isNull(), "no references", needs=("called",)),
        "envious_func": _rule("envious-func", INFO, F.col("envy_n").isNotNull(), envy, F.col("envy_n"), F.col("envy_own"), F.col("envy_of"), needs=("envied",)),
        "pass_through": _rule("pass-through", INFO, _func() & (F.col("forwards") != "") & ~entry, F.format_string("only calls %s with its own arguments", "forwards")),
        "fixed_arg": _rule("fixed-arg", INFO, fixed, F.format_string("%s is %s at all %d production call sites", "fixed_param", "fixed_value", "calls"), F.col("calls"), FIXED_CALLS),
        "middle_man": _rule("middle-man", INFO, (F.col("kind") == "type") & ~F.col("deprecated") & F.col("methods").isNotNull(), F.format_string("%d of %d methods only call %s's", "middle_n", "methods", "field"), needs=("middle",)),
    }


#: The rules by name; those of `decl_rules` are about declarations, the others have functions of their own.
RULES = ("long_func", "complex_func", "deep_nesting", "many_params", "large_file", "unused_export", "dead_code", "envious_func", "unstable_dep", "untested_package", "pass_through", "fixed_arg", "middle_man")
OTHERS = {"large_file": large_file, "unstable_dep": unstable_dep, "untested_package": untested_package}


def union(g: Graph, rules: Sequence[str] = RULES) -> DataFrame:
    """Findings of the named rules."""
    known = decl_rules(g.module)
    parts = [OTHERS[r](g) for r in rules if r in OTHERS]
    if own := [known[r] for r in rules if r in known]:
        parts.append(judged(g, own))
    return reduce(DataFrame.unionByName, parts)


def _one(rule: str) -> Callable[[Graph], DataFrame]:
    return lambda g: union(g, (rule,))


long_func, complex_func, deep_nesting, many_params = _one("long_func"), _one("complex_func"), _one("deep_nesting"), _one("many_params")
unused_export, dead_code, envious_func = _one("unused_export"), _one("dead_code"), _one("envious_func")
pass_through, fixed_arg, middle_man = _one("pass_through"), _one("fixed_arg"), _one("middle_man")


def find(g: Graph, rules: Sequence[str] = RULES) -> DataFrame:
    """All findings, worst first, then by package, file, line, rule and declaration."""
    return union(g, rules).orderBy(F.desc("severity"), "package", "file", "line", "rule", "decl", "target")


def delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """change (introduced or fixed) and the findings that one side has beyond the other.

    Findings pair one for one in order, first those of the same identity and declaration, then what is
    left by identity alone. An identity leaves out package and file where a declaration is named.
    """
    moved = F.col("decl") != ""
    identity = F.concat_ws("|", "rule", F.when(moved, F.lit("")).otherwise(F.col("package")), F.when(moved, F.lit("")).otherwise(F.col("file")), "subject", "target")
    order = [F.desc("severity"), "package", "file", "line", "rule", "decl", "target"]
    both = base.withColumn("change", F.lit("fixed")).unionByName(head.withColumn("change", F.lit("introduced"))).withColumn("identity", identity)
    for keys in (["identity", "decl"], ["identity"]):
        group, place = Window.partitionBy(*keys), Window.partitionBy(*keys, "change").orderBy(*order)
        pairs = F.least(F.count_if(F.col("change") == "fixed").over(group), F.count_if(F.col("change") == "introduced").over(group))
        both = both.withColumns({"pairs": pairs, "place": F.row_number().over(place)}).where("place > pairs").drop("pairs", "place")
    return both.select("change", *COLUMNS)
