"""URL filters by rules and, beyond them, by a path-template tree. DataFrame operations only.

The tree has a node for every host and, below it, a level for every path segment. A segment with a digit is variable and
becomes a wildcard at once. Level by level, the branches of a node are compared by their shares of blocked labelled urls: a
branch whose share is more than z standard errors from the node's keeps its name, all others are similar (or have no
labels) and merge into the wildcard branch. Among many branches z grows to sqrt(2 ln branches), so that chance sets none
apart. A template is rejected when its share of blocked labelled urls, smoothed by the overall share, reaches ``reject``.
Labels are the verdicts of the rules, and of further known urls if there are any.

Leaves are the distinct paths of a host; each level is one small query over them that is written before the next, down to
the last level at which a node has labels and more than one leaf. Below that all segments are wildcards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize, release
from tessera.llm.skew import skew_join

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. Of equally long rules, blocking ones go first, then by text."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block", [-ord(c) for c in r[0]])):
        name, _, rest = text.partition("/")
        fits = F.concat(F.lit("."), host).endswith(f".{name}") & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments that aren't empty, those with a digit as wildcards."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike("[0-9]"), "*").otherwise(s))


def templates(leaves: DataFrame, z: float) -> DataFrame:
    """``leaves(host, segments, labelled, blocked)``, a row for each path of a host, with ``template``: the path generalised.

    Rows without labels anywhere below their host end in wildcards; an empty table gives an empty result; further columns
    pass through.
    """
    todo = leaves.withColumn("template", F.lit(""))
    done, level = [], 0
    while True:
        segment = F.coalesce(F.get("segments", F.lit(level)), F.lit(""))
        todo = materialize(todo.withColumn("segment", segment), "level")
        branch = todo.groupBy("host", "template", "segment").agg(F.sum("labelled").alias("labelled_b"), F.sum("blocked").alias("blocked_b"), F.count("*").alias("leaves_b"))
        branch = materialize(branch, "branches")
        node = branch.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("labelled_b").alias("labelled_n"), F.sum("blocked_b").alias("blocked_n"), F.sum("leaves_b").alias("leaves_n"))
        share = F.try_divide("blocked_n", "labelled_n")
        error = F.sqrt(F.try_divide(share * (1 - share), "labelled_b"))
        apart = F.abs(F.try_divide("blocked_b", "labelled_b") - share) > F.greatest(F.lit(z), F.sqrt(2 * F.ln("children"))) * error
        goes = F.when(F.col("segment") == "", "").when((F.col("labelled_b") > 0) & apart, F.concat(F.lit("/"), "segment")).otherwise("/*")
        settled = (F.col("labelled_n") == 0) | (F.col("leaves_n") == 1)
        named = skew_join(branch, node, ["host", "template"]).select("host", "template", "segment", goes.alias("goes"), settled.alias("settled"))
        moved = skew_join(todo, named, ["host", "template", "segment"])
        left = F.size("segments") - F.lit(level)
        ends = F.col("settled") | (left <= 1)
        rest = F.when(F.col("settled"), F.repeat(F.lit("/*"), F.greatest(left, F.lit(0)))).otherwise(F.col("goes"))
        moved = materialize(moved.select(*leaves.columns, F.concat("template", rest).alias("template"), ends.alias("_ends")), "level")
        release(todo, branch)
        done.append(moved.where("_ends").drop("_ends"))
        todo, level = moved.where("NOT _ends").drop("_ends"), level + 1
        if todo.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def judge(
    pages: DataFrame, rules: list[tuple[str, str]], *, known: DataFrame | None = None, z: float = 2.0, smoothing: float = 10.0, reject: float = 0.7
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template`` of every row of ``pages(page_id, url)``.

    ``rules`` are ("host/path", "allow" or "block") in number small enough for one expression; ``known(url, verdict)`` are
    labelled urls beyond those that the rules decide. A null url and one without
    ``://`` have empty host and path, fit no rule and share the template of the empty host; a host without any label is
    judged by the overall share. Without labels at all every template passes. Repeated rows are each judged and each
    counted; an empty table gives an empty result; further columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = materialize(rows.select("*", rule.alias("rule"), says.alias("says"), segments(F.col("path")).alias("segments")), "urls")
    labelled = rows.select("host", "segments", "says")
    if known is not None:
        labelled = labelled.unionByName(known.select(host.alias("host"), segments(path).alias("segments"), F.col("verdict").alias("says")))
    counts = [F.count("*").alias("n"), F.count("says").alias("labelled"), F.count(F.when(F.col("says") == "block", 1)).alias("blocked")]
    leaves = materialize(labelled.groupBy("host", "segments").agg(*counts), "leaves")
    total = leaves.agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).first()
    overall = (total["blocked"] or 0) / total["labelled"] if total["labelled"] else 0.0

    leaves = materialize(templates(leaves, z), "templates")
    whole = leaves.groupBy("host", "template").agg(F.sum("labelled").alias("labelled_t"), F.sum("blocked").alias("blocked_t"))
    purity = (F.col("blocked_t") + F.lit(smoothing * overall)) / (F.col("labelled_t") + F.lit(smoothing))
    whole = whole.select("host", "template", F.when(purity >= reject, "block").otherwise("allow").alias("verdict"))
    named = skew_join(leaves, whole, ["host", "template"]).select("host", "segments", F.concat("host", "template").alias("template"), "verdict")
    found = skew_join(rows, named, ["host", "segments"], counts=leaves)
    return found.select("page_id", "host", "path", "rule", F.coalesce("says", "verdict").alias("verdict"), "template")


def oracle_sql(rules: list[tuple[str, str]], *, levels: int = 4, z: float = 2.0, smoothing: float = 10.0, reject: float = 0.7) -> str:
    """DuckDB SQL for ``judge`` over the view ``pages``, for paths of up to ``levels`` segments."""
    cases = {True: [], False: []}
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block", [-ord(c) for c in r[0]]), reverse=True):
        name, _, rest = text.partition("/")
        for verdict, out in cases.items():
            out.append(f"WHEN ends_with('.' || host, '.{name}') AND starts_with(path, '/{rest}') THEN '{says if verdict else text}'")
    steps = []
    for i in range(1, levels + 1):
        steps.append(
            f"""branch_{i} AS (SELECT host, template, coalesce(s[{i}], '') AS segment, sum(labelled) AS lb, sum(blocked) AS bb FROM at_{i - 1} GROUP BY ALL),
node_{i} AS (SELECT host, template, count(*) AS children, sum(lb) AS ln, sum(bb) AS bn FROM branch_{i} GROUP BY ALL),
to_{i} AS (SELECT b.*, CASE WHEN segment = '' THEN '' WHEN lb > 0 AND abs(bb / lb - bn / ln) > greatest({z}, sqrt(2 * ln(children))) * sqrt((bn / ln) * (1 - bn / ln) / lb)
  THEN '/' || segment ELSE '/*' END AS goes FROM branch_{i} b JOIN node_{i} n ON b.host = n.host AND b.template = n.template),
at_{i} AS (SELECT l.* REPLACE (l.template || t.goes AS template) FROM at_{i - 1} l JOIN to_{i} t ON l.host = t.host AND l.template = t.template AND coalesce(l.s[{i}], '') = t.segment)"""
        )
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest_of FROM pages),
named AS (SELECT page_id, translate(regexp_extract(rest_of, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest_of, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE {" ".join(cases[False])} END AS rule, CASE {" ".join(cases[True])} END AS says,
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS s FROM named),
at_0 AS (SELECT host, s, count(says) AS labelled, count(CASE WHEN says = 'block' THEN 1 END) AS blocked, '' AS template FROM ruled GROUP BY host, s),
{", ".join(steps)},
judged AS (SELECT host, template, CASE WHEN (sum(blocked) + {smoothing} * coalesce((SELECT sum(blocked) / sum(labelled) FROM at_0), 0)) / (sum(labelled) + {smoothing}) >= {reject} THEN 'block' ELSE 'allow' END AS verdict
  FROM at_{levels} GROUP BY ALL)
SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.says, j.verdict) AS verdict, p.host || a.template AS template
FROM ruled p JOIN at_{levels} a ON p.host = a.host AND p.s = a.s JOIN judged j ON a.host = j.host AND a.template = j.template
"""
