"""URL filters: rules by host and path, and a tree of path templates for URLs that no rule fits.

Templates: digits and long hexadecimal runs of a path's segments become wildcards. Level by level,
under one parent (a host and the template so far), a segment with a small share of a parent with many
segments is variable and becomes `*`; branches whose rejection rate is close to their parent's, or of which
nothing is known while something is of their parent, are statistically alike and merge to `~`. From DEPTH
levels on, the rest of a template whose labelled URLs are all rejected or none is `**`; the others go on as
deep as their paths.

A template's purity is the share of rejected URLs among its labelled ones, smoothed by the rate of what
stands above it: the template without its last segment, the host, the host's last two labels, its last one, and
1/2, each of them smoothed by the next with the weight of PRIOR URLs. A template is rejected where
its purity is at least LEAST. So one of which nothing is known goes where its host goes, and a host of
which nothing is known where its domain does.

Labels are what rules say of the URLs that they fit. All of it is DataFrame operations: rows are first
counted by host and masked path, which is written once, and each level is a count and a join, so a host with a
third of all rows is pre-aggregated before it is shuffled; joins with domains are salted.

Defined cases: a null URL, or one without `://`, has an empty host and path, which share one template;
rows that repeat are judged alike and count each; an empty table gives an empty one; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpointed

#: (action, host, path): a rule fits the host, its subdomains, and paths that start with its own.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEPTH = 3
#: A parent with at least so many segments has variable ones: those of less than this share.
MANY, SMALL = 16, 0.1
#: The purity that rejects, standard errors within which rates are alike, and URLs that the rate above counts as much as.
LEAST, NEAR, PRIOR = 0.8, 1.0, 2.0
#: Parts into which the hosts of a domain are dealt.
SALTS = 32


def parse(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path) and its action; nulls where none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the last that fits is the longest
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def masked(path: Column) -> Column:
    """The path with hexadecimal runs of 8 or more and runs of digits as wildcards."""
    return F.regexp_replace(F.regexp_replace(path, r"\b[0-9a-f]{8,}\b", "<h>"), "[0-9]+", "<n>")


def smoothed(bad: Column, seen: Column, above: Column) -> Column:
    return (bad + PRIOR * above) / (seen + PRIOR)


def host_rates(paths: DataFrame) -> DataFrame:
    """host, prior (its domain's rate) and rate of every host of rows (host, seen, bad)."""
    both = [F.sum(c).alias(c) for c in ("seen", "bad")]
    hosts = paths.groupBy("host").agg(*both)
    domain = F.substring_index("host", ".", -2)
    hosts = hosts.withColumns({"domain": domain, "salt": F.pmod(F.xxhash64("host"), F.lit(SALTS))})
    domains = hosts.groupBy("domain").agg(*both).withColumns({"top": F.substring_index("domain", ".", -1), "salt": F.pmod(F.xxhash64("domain"), F.lit(SALTS))})
    tops = domains.groupBy("top").agg(*both)
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt")
    tops = tops.select("top", smoothed(F.col("bad"), F.col("seen"), F.lit(0.5)).alias("top_rate"), salts)
    domains = domains.join(tops, ["top", "salt"]).select("domain", smoothed(F.col("bad"), F.col("seen"), F.col("top_rate")).alias("prior"), salts)
    return hosts.join(domains, ["domain", "salt"]).select("host", "prior", smoothed(F.col("bad"), F.col("seen"), F.col("prior")).alias("rate"))


def templates(labelled: DataFrame) -> DataFrame:
    """host, masked, template, labelled, blocked, purity of rows (host, masked, blocked 1, 0 or null)."""
    paths = labelled.groupBy("host", "masked").agg(F.count(F.lit(1)).alias("n"), F.count("blocked").alias("seen"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("bad"))
    parts = F.filter(F.split("masked", "/"), lambda s: s != "")
    paths = checkpointed(paths.withColumn("parts", parts))
    tree = paths.join(host_rates(paths), "host").withColumn("prefix", F.lit("")).withColumn("rest", F.lit(False))
    closed, level = None, 0
    while True:
        if level >= DEPTH:
            of = tree.groupBy("host", "prefix").agg((F.coalesce((F.sum("bad") > 0) & (F.sum("bad") < F.sum("seen")), F.lit(False)) & (F.max(F.size("parts")) > level)).alias("mixed"))
            tree = checkpointed(tree.join(of, ["host", "prefix"]))
            done = tree.where("not mixed").drop("mixed").withColumn("rest", F.size("parts") > level)
            closed = done if closed is None else closed.unionByName(done)
            tree = tree.where("mixed").drop("mixed")
            if tree.isEmpty():
                break
        tree = checkpointed(tree.withColumn("part", F.get("parts", F.lit(level))))
        branch = tree.where(F.col("part").isNotNull()).groupBy("host", "prefix", "part").agg(*(F.sum(c).alias(c) for c in ("n", "seen", "bad")))
        parent = branch.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("p_parts"), *(F.sum(c).alias(f"p_{c}") for c in ("n", "seen", "bad")))
        both = branch.join(parent, ["host", "prefix"])
        rate = F.try_divide("p_bad", "p_seen")
        near = F.abs(F.try_divide("bad", "seen") - rate) <= NEAR * F.sqrt(F.try_divide(rate * (1 - rate), F.col("seen")))
        alike = (F.col("p_seen") > 0) & ((F.col("seen") == 0) | near)
        variable = (F.col("p_parts") >= MANY) & (F.col("n") < SMALL * F.col("p_n"))
        named = both.select("host", "prefix", "part", "seen", "bad", F.when(variable, F.lit("*")).when((F.col("p_parts") > 1) & alike, F.lit("~")).otherwise(F.col("part")).alias("named"))
        node = named.groupBy("host", "prefix", "named").agg(F.sum("seen").alias("node_seen"), F.sum("bad").alias("node_bad"))
        named = named.drop("seen", "bad").join(node, ["host", "prefix", "named"])
        tree = tree.join(named, ["host", "prefix", "part"], "left")
        below = F.col("named").isNotNull()
        tree = tree.withColumns(
            {
                "prefix": F.concat("prefix", F.coalesce(F.concat(F.lit("/"), "named"), F.lit(""))),
                "prior": F.when(below, F.col("rate")).otherwise(F.col("prior")),
                "rate": F.when(below, smoothed(F.col("node_bad"), F.col("node_seen"), F.col("rate"))).otherwise(F.col("rate")),
            }
        )
        tree = tree.drop("part", "named", "node_seen", "node_bad")
        level += 1
    tree = closed.withColumn("template", F.concat("prefix", F.when(F.col("rest"), F.lit("/**")).otherwise(F.lit(""))))
    of = tree.groupBy("host", "template").agg(F.sum("seen").alias("labelled"), F.sum("bad").alias("blocked"))
    return tree.select("host", "masked", "template", "prior").join(of, ["host", "template"]).select("host", "masked", "template", "labelled", "blocked", smoothed(F.col("blocked"), F.col("labelled"), F.col("prior")).alias("purity"))


def judge(pages: DataFrame, id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page."""
    host, path = parse(F.col(url))
    rows = pages.select(F.col(id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, action = apply_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "action": action, "masked": masked(F.col("path"))})
    blocked = F.when(F.col("action") == "block", 1).when(F.col("action") == "allow", 0)
    known = templates(rows.select("host", "masked", blocked.alias("blocked")))
    joined = rows.join(known, ["host", "masked"], "left")
    verdict = F.coalesce("action", F.when(F.col("purity") >= LEAST, F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
