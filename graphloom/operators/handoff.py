"""A basket of findings, prognoses and notes as one text for whoever works on them."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import spans

# Kinds in the order that they are shown, with their headings.
KINDS = {"finding": "Findings", "prognosis": "Prognoses", "introduced": "Introduced by this change", "note": "Notes", "thread": "Threads"}


def kind_rank(kind: Column) -> Column:
    out = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        out = F.when(kind == k, i).otherwise(out)
    return out


def scope_text(scope: Column) -> Column:
    """How a scope (wt, commit:sha or pr:n@sha) reads."""
    rest = F.substr(scope, F.lit(4))
    number = F.substring_index(rest, "@", 1)
    return (
        F.when(scope == "wt", "working tree")
        .when(F.startswith(scope, F.lit("commit:")), F.concat(F.lit("commit "), F.substr(scope, F.lit(8))))
        .when(F.startswith(scope, F.lit("pr:")), F.concat(F.lit("PR #"), number, F.lit(" at "), F.substr(rest, F.length(number) + 2)))
        .otherwise(scope)
    )


def grouped(items: DataFrame) -> DataFrame:
    """Items (basket, pos, repo, repo_name, kind, …) with their place: by repository, kind and the order of the user."""
    order = Window.partitionBy("basket").orderBy("repo_name", "repo", kind_rank(F.col("kind")), "kind", "pos")
    return items.withColumn("place", F.row_number().over(order).cast("bigint"))


def fence(lines: list[str]) -> str:
    """Backticks, three or one more than any run inside."""
    longest = max([2, *(len(run) for x in lines for run in "".join(c if c == "`" else " " for c in x).split())])
    return "`" * (longest + 1)


def _item(x: dict) -> str:
    out = f"\n#### {x['title']}\n\n"
    out += f"Where: `{x['place_text']}`\n" if x["place_text"] else ""
    out += f"Scope: {x['scope']}\n" if x["scope"] else ""
    out += f"\n{x['body']}\n" if x["body"] else ""
    if len(x["steps"]):
        out += "\nSteps:\n" + "".join(f"{i}. {s}\n" for i, s in enumerate(x["steps"], 1))
    out += f"\nCheck: {x['check']}\n" if x["check"] else ""
    if len(x["code"]):
        f = fence(list(x["code"]))
        out += "\nCode:\n\n" + f + "\n" + "\n".join(x["code"]) + "\n" + f + "\n"
    return out


def render(items: DataFrame, goal: str = "") -> DataFrame:
    """basket and text of items (basket, pos, repo, repo_name, kind, title, place_text, scope, body, steps, check, code)."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("place")
        n = len(t)
        text = f"# Handoff\n\nGoal: {goal.strip() or 'resolve each item below.'}\n\n{n} item{'' if n == 1 else 's'}, in the order to work through.\n\n- Repos: {', '.join(dict.fromkeys(t['repo_name']))}\n"
        repo = kind = None
        for x in t.to_dict("records"):
            if x["repo"] != repo:
                text += f"\n## {x['repo_name']}\n"
                kind = None
            if x["kind"] != kind:
                text += f"\n### {KINDS.get(x['kind'], x['kind'])}\n"
            repo, kind = x["repo"], x["kind"]
            text += _item(x)
        return pd.DataFrame({"basket": [t["basket"].iloc[0]], "text": [text]})

    shown = grouped(items).withColumn("scope", F.when(F.col("scope") != "", scope_text(F.col("scope"))).otherwise(""))
    return shown.groupBy("basket").applyInPandas(run, "basket string, text string")


def excerpt(lines: DataFrame, decls: DataFrame, most: int = 40) -> DataFrame:
    """id and the first lines of a declaration's source (path, line, text), with a last one that counts the rest."""
    met = spans.inside(lines, decls.select("id", "path", "start_line", "end_line"))
    # of a block, too, no more than the first lines are kept
    cut = met.select("id", F.size("own").alias("n"), F.slice("own", 1, most).alias("own"))
    found = cut.groupBy("id").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("own"))), 1, most).alias("l")).withColumn("t", F.transform("l", lambda x: x["text"]))
    more = F.col("n") - most
    return found.select("id", F.when(more > 0, F.concat("t", F.array(F.concat(F.lit("… "), more.cast("string"), F.lit(" more lines"))))).otherwise(F.col("t")).alias("code"))
