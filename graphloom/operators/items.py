"""What a page or a handoff says of findings, changes and tiles: items with checks, keys, sums of a change's roots, heats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of rules, and why they matter.
LABELS = {
    "long-func": "Long function", "complex-func": "Complex function", "deep-nesting": "Deep nesting", "many-params": "Many parameters", "large-file": "Large file", "unused-export": "Unused export", "dead-code": "Dead code",
    "envious-func": "Leans on another package", "unstable-dep": "Imports a less stable package", "untested-package": "Untested package", "pass-through": "Pass-through", "fixed-arg": "Same argument everywhere", "middle-man": "Middle man",
}
WHY = {
    "long-func": "A long function is hard to hold in your head.",
    "complex-func": "Many paths to read and to test.",
    "deep-nesting": "Deep control flow hides the main path.",
    "many-params": "A long parameter list means the function does several jobs.",
    "large-file": "A large file usually mixes several concerns.",
    "unused-export": "Exported but unused outside its package: API surface nobody uses.",
    "dead-code": "Declared and never referenced: weight with no value.",
    "envious-func": "Most of its references go to one other package; it may belong there.",
    "unstable-dep": "Imports a package that changes more freely than itself, so that package's changes ripple into this one.",
    "untested-package": "No test refers to it: changes land unguarded.",
    "pass-through": "It only hands its arguments to another function: a layer that adds an interface and no behaviour.",
    "fixed-arg": "Every caller passes the same value: make it the default and drop the parameter.",
    "middle-man": "Half or more of its methods only hand the call to one field: callers could use that field directly.",
}
# Upper ends of heats by lens (others are relative), what a finding weighs by severity, and the hottest that a worst severity allows.
BANDS = {"smells": (1, 3, 6, 12), "complexity": (5, 10, 15, 20)}
WEIGHTS, CAPS = (1, 3, 9), (2, 4, 5)


def _told(rule: Column, texts: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in texts.items() for x in kv)), rule), F.lit(""))


def _first(*columns: str) -> Column:
    """The first of some texts that isn't empty."""
    return F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in columns), F.lit(""))


def finding_key() -> Column:
    return F.concat("rule", F.lit(":"), _first("decl", "file", "package"), F.when(F.col("target") != "", F.concat(F.lit("->"), "target")).otherwise(F.lit("")))


def smell_key() -> Column:
    return F.concat_ws("|", "rule", "decl", "file", "subject")


def thread_key(ids: Column) -> Column:
    return F.array_join(ids, " > ")


def line_key(file: Column, side: Column, line: Column) -> Column:
    return F.concat_ws("|", file, side, line.cast("string"))


def finding_items(findings: DataFrame, scope: str, root: str = ".", excerpts: DataFrame | None = None) -> DataFrame:
    """key, scope, title, place, body, check and code of findings; excerpts are (id, code array) of declarations."""
    rule = F.col("rule")
    label = F.when(_told(rule, LABELS) != "", _told(rule, LABELS)).otherwise(rule)
    path = F.col("file") if root in ("", ".") else F.concat(F.lit(root + "/"), "file")
    place = F.when(F.col("file") == "", F.col("subject")).when(F.col("line") > 0, F.concat(path, F.lit(":"), F.col("line").cast("string"))).otherwise(path)
    body = F.concat(F.when(F.col("detail") != "", F.concat("detail", F.lit(". "))).otherwise(F.lit("")), _told(rule, WHY), F.when(F.col("target") != "", F.concat(F.lit(" Other package: "), "target", F.lit("."))).otherwise(F.lit("")))
    check = F.concat(F.lit("Re-read the code: the "), F.lower(label), F.lit(" no longer applies to "), "subject", F.lit(", and the build and tests still pass."))
    none = F.array().cast("array<string>")
    f = findings.withColumn("code", none) if excerpts is None else findings.hint("merge").join(excerpts.select(F.col("id").alias("decl"), "code"), "decl", "left").withColumn("code", F.coalesce("code", none))
    return f.select(finding_key().alias("key"), F.lit(scope).alias("scope"), F.concat(label, F.lit(": "), "subject").alias("title"), place.alias("place"), body.alias("body"), check.alias("check"), "code")


def summaries(units: DataFrame, introduced: DataFrame, files: DataFrame, keys: Sequence[str] = ("change",)) -> DataFrame:
    """change, units, roots, introduced, added and deleted: sums over the roots of each change, which `keys` tell apart.

    units are (change, root, …), introduced (change, root), files (change, root, added, deleted). Units and introduced findings
    add up; every root reads the same diff, so lines don't, and the root with most counts.
    """
    u = units.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum("n").alias("units"), F.count(F.lit(1)).alias("roots"))
    i = introduced.groupBy(*keys).agg(F.count(F.lit(1)).alias("introduced"))
    f = files.groupBy(*keys, "root").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted")).groupBy(*keys).agg(F.max("added").alias("added"), F.max("deleted").alias("deleted"))
    return u.join(i, list(keys), "full").join(f, list(keys), "full").na.fill(0)


def change_lines(changes: DataFrame) -> DataFrame:
    """`changes` with the lines that are shown: git's own count once a change is ready, until then what its pull request says, if it has one."""
    said = ~F.col("ready") & F.col("pr_added").isNotNull()
    return changes.withColumns({"shown_added": F.when(said, F.col("pr_added")).otherwise(F.col("added")), "shown_deleted": F.when(said, F.col("pr_deleted")).otherwise(F.col("deleted"))})


def heat(lens: str, value: Column, top: Column, worst: Column | None = None) -> Column:
    """0 to 5: by fixed bands for findings and complexity, else by the share of the hottest; `worst` is the severity that caps it."""
    if lens in BANDS:
        out = F.lit(5)
        for i, limit in reversed(list(enumerate(BANDS[lens], 1))):
            out = F.when(value <= limit, i).otherwise(out)
    else:
        out = F.least(F.lit(5), 1 + F.floor(F.lit(4.999) * value / top))
    out = F.when(value <= 0, 0).otherwise(out)
    if worst is not None:
        cap = F.coalesce(F.get(F.array(*map(F.lit, CAPS)), worst.cast("int")), F.lit(CAPS[-1]))
        out = F.least(out, cap)
    return out.cast("bigint")
