"""URL filter: path-template tree per host, DataFrame functions only.

A url's path is a chain of segments; digit runs read as ``#``. Going down the tree of each host, to the
end of the deepest path, the branches below a node are generalised into one wildcard
``*`` if they are variable (many, hardly repeated), or if they are statistically similar: a
chi-square test on their pages' labels (block, allow, none) finds no difference to all branches of
the node together (two such branches at least). Labels come from the rules, so that a template
mixes ruled and unruled pages of the same kind.

A node's smoothed labelled purity is (blocked + PRIOR * purity of its parent) / (blocked + allowed +
UNLABELLED * other pages + PRIOR), above the host ``BASE``: labels reach templates without labels of
their own through the tree, and unlabelled pages are weak evidence of harmless ones, so that one
blocked folder does not condemn a host's others. A template is rejected if its purity passes
``REJECT``. A page's rule, if one fits, always goes first.

At scale: only ``url`` is read; pages are counted by (host, shaped path) map-side first, and the
tree works on these counts, level by level; paths that have ended leave the loop. It has as many rounds
as the deepest path has segments. The only join on all pages is by (host, shaped path), which adaptive
execution can split.

Cases: null url, or none with ``://`` → empty host and path, no rule, the template of the empty
host; repeated rows are judged alike and count each; ties between rules go to the longest rule
string; empty table → empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Scratch

#: The rules (verdict, host, path) of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Weight of the parent's purity, in pages; of an unlabelled page, in allowed ones; purity above hosts.
PRIOR, UNLABELLED, BASE = 4, 0.25, 0.25
REJECT = 0.6
#: Two degrees of freedom, one in a hundred.
CHI_SQUARE = 9.21
VARIABLE_BRANCHES = 16
#: Levels that the SQL goes down (the DataFrame form goes down all).
SQL_LEVELS = 8


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, ruled (its verdict) and the path's shape."""
    return (pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
            .withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
            .select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"),
                    F.regexp_replace("path", "[0-9]+", "#").alias("shape")))


def purity_of(above: Column) -> Column:
    """Smoothed purity of a group of pages (n, of which b blocked and a allowed) below ``above``."""
    n, b, a = (F.sum(c) for c in "nba")
    return (b + PRIOR * above) / (b + a + UNLABELLED * (n - b - a) + PRIOR)


def template_tree(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host, shape → its template and the template's purity."""
    counts = scratch("counts", pages.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("ruled") == "block", 1)).alias("b"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("a")))
    hosts = counts.groupBy("host").agg(purity_of(F.lit(BASE)).alias("purity"))
    # the segments after the first slash; an empty path has none
    segments = F.split("shape", "/")
    tree = scratch("level0", counts.join(hosts, "host").withColumns(
        {"segments": F.slice(segments, F.lit(2), F.size(segments)), "template": F.lit("")}))
    out, node = [], ["host", "template"]
    for k in range(1, (tree.agg(F.max(F.size("segments"))).first()[0] or 0) + 1):
        out.append(tree.filter(F.size("segments") < k))
        alive = tree.filter(F.size("segments") >= k).withColumn("s", F.element_at("segments", k))
        branches = alive.groupBy(*node, "s").agg(*[F.sum(c).alias(c) for c in "nba"], F.max("purity").alias("above"))
        nodes = branches.groupBy(*node).agg(F.count("*").alias("branches"), *[F.sum(c).alias("t" + c) for c in "nba"])

        def part(own: Column, all_: Column) -> Column:
            expected = F.col("n") * all_ / F.col("tn")
            return F.when(all_ > 0, (own - expected) * (own - expected) / expected).otherwise(F.lit(0.0))

        distance = reduce(lambda x, y: x + y, [part(F.col("b"), F.col("tb")), part(F.col("a"), F.col("ta")),
                                               part(F.col("n") - F.col("b") - F.col("a"), F.col("tn") - F.col("tb") - F.col("ta"))])
        variable = (F.col("branches") >= VARIABLE_BRANCHES) & (F.col("branches") * 2 > F.col("tn"))
        tested = branches.join(nodes, node).select(*node, "s", *"nba", "above", variable.alias("variable"), (distance <= CHI_SQUARE).alias("similar"))
        alike = tested.groupBy(*node).agg(F.count(F.when(F.col("similar"), 1)).alias("alike"))
        label = F.when(F.col("variable") | (F.col("similar") & (F.col("alike") >= 2)), F.lit("*")).otherwise(F.col("s"))
        named = scratch(f"names{k}", tested.join(alike, node).withColumn("label", label))
        below = named.groupBy(*node, "label").agg(purity_of(F.max("above")).alias("purity"))
        tree = scratch(f"level{k}", alive.drop("purity").join(named.select(*node, "s", "label"), [*node, "s"]).join(below, [*node, "label"])
                       .withColumn("template", F.concat("template", F.lit("/"), "label")).select(tree.columns))
    return reduce(DataFrame.unionByName, [*out, tree]).select("host", "shape", "template", "purity")


def judge(pages: DataFrame, rules=RULES, *, scratch: Scratch | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every row of ``pages``."""
    rows = parsed(pages, rules)
    verdict = F.coalesce("ruled", F.when(F.col("purity") > REJECT, "block").otherwise("allow"))
    return rows.join(template_tree(rows, scratch or Scratch(pages.sparkSession, "urls")), ["host", "shape"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")


def oracle_sql(rules=RULES) -> str:
    """The same verdicts as DuckDB SQL over ``pages`` (paths of up to ``SQL_LEVELS`` segments)."""
    def purity(above: str) -> str:
        return f"(sum(b) + {PRIOR} * {above}::DOUBLE) / (sum(b) + sum(a) + {UNLABELLED}::DOUBLE * (sum(n) - sum(b) - sum(a)) + {PRIOR})"

    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{}}" for _, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])))
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = cases.format(*[f"'{h + p}'" for _, h, p in order])
    ruled = cases.format(*[f"'{v}'" for v, _, _ in order])
    sql = f"""WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
p AS (SELECT *, CASE {rule} END AS rule, CASE {ruled} END AS ruled, regexp_replace(path, '[0-9]+', '#', 'g') AS shape FROM u),
c0 AS (SELECT host, shape, string_split(shape, '/')[2:] AS g, '' AS t, count(*)::DOUBLE AS n, count(*) FILTER (WHERE ruled = 'block')::DOUBLE AS b,
  count(*) FILTER (WHERE ruled = 'allow')::DOUBLE AS a FROM p GROUP BY ALL),
h0 AS (SELECT host, {purity(str(BASE))} AS q FROM c0 GROUP BY host),
x0 AS (SELECT * FROM c0 JOIN h0 USING (host))"""
    for k in range(1, SQL_LEVELS + 1):
        parts = " + ".join(f"(CASE WHEN {t} > 0 THEN ({o} - n * {t} / tn) * ({o} - n * {t} / tn) / (n * {t} / tn) ELSE 0 END)"
                           for o, t in (("b", "tb"), ("a", "ta"), ("(n - b - a)", "(tn - tb - ta)")))
        sql += f""",
v{k} AS (SELECT *, g[{k}] AS s FROM x{k - 1} WHERE len(g) >= {k}),
b{k} AS (SELECT host, t, s, sum(n) AS n, sum(b) AS b, sum(a) AS a, max(q) AS q FROM v{k} GROUP BY ALL),
n{k} AS (SELECT host, t, count(*) AS branches, sum(n) AS tn, sum(b) AS tb, sum(a) AS ta FROM b{k} GROUP BY ALL),
d{k} AS (SELECT host, t, s, n, b, a, q, branches >= {VARIABLE_BRANCHES} AND branches * 2 > tn AS variable, ({parts}) <= {CHI_SQUARE} AS near FROM b{k} JOIN n{k} USING (host, t)),
m{k} AS (SELECT host, t, count(*) FILTER (WHERE near) AS alike FROM d{k} GROUP BY ALL),
l{k} AS (SELECT d{k}.*, CASE WHEN variable OR (near AND alike >= 2) THEN '*' ELSE s END AS label FROM d{k} JOIN m{k} USING (host, t)),
p{k} AS (SELECT host, t, label, {purity('max(q)')} AS q FROM l{k} GROUP BY host, t, label),
x{k} AS (SELECT host, shape, g, t || '/' || label AS t, n, b, a, p{k}.q FROM v{k} JOIN (SELECT host, t, s, label FROM l{k}) USING (host, t, s) JOIN p{k} USING (host, t, label))"""
    ends = " UNION ALL ".join(f"SELECT host, shape, t, q FROM x{k} WHERE len(g) = {k}" for k in range(SQL_LEVELS + 1))
    return sql + f""",
e AS ({ends})
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN q > {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, t AS template
FROM p JOIN e USING (host, shape)"""
