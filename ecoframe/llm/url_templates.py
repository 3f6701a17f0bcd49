"""URL filters by a path-template tree (native).

Explicit rules (a host, which stands for its subdomains too, and a path prefix) decide first, the longest one that fits. All
other URLs are judged by their template: path segments are generalised to wildcards by their form, and, level by level down
the tree of a host, the rare children of a node with many become one wildcard. Sibling templates of a host that differ in one
literal segment are merged where their labelled rates don't differ significantly.

The purity of a template is its labelled rate smoothed towards that of its tree parent, whose rate is smoothed towards its own
parent, and so on over the host and the hosts of the same domain (which weigh as one average host) to the rate of all labelled
pages: a template with few labels speaks with the voice of the nearest labelled node above it. A template is blocked if this
purity reaches `reject` and some page of its host is labelled bad; the rates of other hosts alone block nothing.

Pages are counted per (host, form of the path) before anything is shuffled; the tree is built from these counts by grouped sums
and salted joins, so a hot host is a set of counted rows and never one group. The first LEVELS segments can become wildcards
for their rarity; those behind are told by their form alone. Labels are the verdicts of the rules and, if given, `label` (true:
bad) of a table.

Defined results: a null URL or one without `://` has empty host and path, fits no rule and is allowed, whatever is labelled;
repeated rows get equal verdicts; ties don't arise, since only sums decide; a path of any length is judged whole; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecoframe.llm.common import cut

#: (verdict, rule): a host, then a path from its first slash on.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tree levels that are counted.
LEVELS = 7
SALTS = 16


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), r"^(?s:.*)$", 0)


def match(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest fitting rule as struct (verdict, rule), or null."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, tail = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + tail)
        row = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        found = F.when(fits, row) if found is None else found.when(fits, row)
    return found if found is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def form(path: Column) -> Column:
    """The segments of a path, variable ones as wildcards by their form."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    shape = lambda s: (
        F.when(s.rlike(r"^[0-9]+$"), "<n>").when(s.rlike(r"^[0-9]+\.[A-Za-z]+$"), F.concat(F.lit("<n>."), F.substring_index(s, ".", -1)))
        .when(s.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "<id>").when(s.rlike(r"[0-9]"), "<v>").otherwise(s))
    return F.transform(parts, shape)


def domain(host: Column) -> Column:
    """The last two labels of a host, what hosts of one pattern share."""
    return F.substring_index(host, ".", -2)


def templates(counted: DataFrame, most_children: int = 32, least_share: float = 0.02) -> DataFrame:
    """Adds `template` to (host, form, n, ...): of a node with over `most_children` children, those with less than `least_share` of its pages become one wildcard.

    Nodes with so many children are fewer than children by that factor; they are repeated once for each of SALTS salts, over which
    the children of a hot node are dealt.
    """
    tree = counted.withColumn("node", F.lit(""))
    deepest = counted.agg(F.max(F.size("form"))).first()[0] or 0
    for level in range(min(LEVELS, deepest)):
        tree = cut(tree.withColumn("part", F.get("form", F.lit(level))))
        children = tree.filter(F.col("part").isNotNull()).groupBy("host", "node", "part").agg(F.sum("n").alias("pages"))
        nodes = children.groupBy("host", "node").agg(F.sum("pages").alias("total"), F.count("*").alias("children"))
        nodes = nodes.filter(F.col("children") > most_children).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        children = children.withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(SALTS)).cast("int"))
        rare = children.join(nodes, ["host", "node", "salt"]).filter(F.col("pages") < F.col("total") * least_share)
        rare = rare.select("host", "node", "part", F.lit("*").alias("open"))
        tree = tree.join(rare, ["host", "node", "part"], "left").withColumn(
            "node", F.when(F.col("part").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), F.coalesce("open", "part")))).drop("part", "open")
    rest = F.array_join(F.transform(F.slice("form", LEVELS + 1, F.greatest(F.size("form"), F.lit(1))), lambda s: F.concat(F.lit("/"), s)), "")
    return tree.withColumn("template", F.concat("node", rest)).drop("node")


def _smoothed(bad: Column, labelled: Column, base: Column, smoothing: float) -> Column:
    return (bad + base * smoothing) / (labelled + smoothing)


def purity(tree: DataFrame, smoothing: float = 8.0, least: int = 20, z: float = 2.0) -> DataFrame:
    """Per (host, template): pages, labelled, bad, merged (the branch that it joined), purity, host_bad (bad pages of the host) and
    level (the tree level of the nearest labelled node: 0 is the host, null none)."""
    leaves = cut(tree.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")]))
    overall = leaves.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).first()
    prior = overall["bad"] / overall["labelled"] if overall["labelled"] else 0.0
    # The branch: the template with its first literal segment open.
    branch = F.regexp_replace("template", r"^((?:/(?:<[^/]*|\*))*)/[^/<*][^/]*", "$1/+")
    pools = leaves.filter(F.col("labelled") >= least).groupBy("host", branch.alias("branch")).agg(
        F.sum("bad").alias("pool_bad"), F.sum("labelled").alias("pool_labelled"))
    # Labelled nodes of all hosts, and of domains, which weigh as one average host.
    segments = F.split("template", "/", -1)
    depth = F.size(segments) - 1
    prefix = F.array_join(F.slice(segments, 1, F.col("level") + 1), "/")
    nodes = leaves.filter(F.col("labelled") > 0).withColumn("level", F.explode(F.sequence(F.lit(0), F.least(F.lit(LEVELS), depth))))
    nodes = nodes.groupBy("host", "level", prefix.alias("prefix")).agg(F.sum("bad").alias("node_bad"), F.sum("labelled").alias("node_labelled"))
    domains = nodes.filter("level = 0").groupBy(domain(F.col("host")).alias("domain")).agg(
        _smoothed(F.sum("node_bad") / F.count("*"), F.sum("node_labelled") / F.count("*"), F.lit(prior), smoothing).alias("base"))
    above = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.least(F.lit(LEVELS), F.greatest(depth - 1, F.lit(0))))))
    above = above.withColumn("prefix", prefix).join(nodes, ["host", "level", "prefix"]).groupBy("host", "template").agg(
        F.array_sort(F.collect_list(F.struct("level", "node_bad", "node_labelled"))).alias("above"))
    rows = leaves.withColumns({"branch": branch, "domain": domain(F.col("host"))}).join(pools, ["host", "branch"], "left").join(
        above, ["host", "template"], "left").join(domains, ["domain"], "left")
    rate = F.col("pool_bad") / F.col("pool_labelled")
    error = F.sqrt(rate * (1 - rate) / F.greatest(F.col("labelled"), F.lit(1)))
    alike = F.coalesce((F.col("labelled") >= least) & (F.abs(F.col("bad") / F.greatest(F.col("labelled"), F.lit(1)) - rate) <= z * error + F.lit(1e-9)), F.lit(False))
    bad, labelled = F.when(alike, F.col("pool_bad")).otherwise(F.col("bad")), F.when(alike, F.col("pool_labelled")).otherwise(F.col("labelled"))
    above = F.coalesce("above", F.array().cast("array<struct<level:int,node_bad:bigint,node_labelled:bigint>>"))
    base = F.aggregate(above, F.coalesce("base", F.lit(float(prior))), lambda p, x: _smoothed(x["node_bad"], x["node_labelled"], p, smoothing))
    return rows.select(
        "host", "template", "n", "labelled", "bad", F.when(alike, F.col("branch")).alias("merged"), _smoothed(bad, labelled, base, smoothing).alias("purity"),
        F.coalesce(F.get(above, F.lit(0))["node_bad"], F.lit(0)).alias("host_bad"),
        F.when(F.col("labelled") > 0, depth).otherwise(F.try_element_at(above, F.lit(-1))["level"]).alias("level"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labels: DataFrame | None = None, reject: float = 0.9) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity and level (of the nearest labelled node) of every row of `pages`. `labels`: page_id, label."""
    host, path = parse(F.col("url"))
    rows = pages.select(F.col("page_id").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", match(F.col("host"), F.col("path"), rules)).withColumn("form", form(F.col("path")))
    seen = rows.withColumn("label", F.col("hit.verdict") == "block")
    if labels is not None:
        given = labels.groupBy(F.col("page_id").alias("labelled_id")).agg(F.max(F.col("label").cast("boolean")).alias("given"))
        seen = seen.join(given, F.col("page_id") == F.col("labelled_id"), "left").withColumn("label", F.coalesce("label", "given"))
    counted = seen.groupBy("host", "form").agg(F.count("*").alias("n"), F.count("label").alias("labelled"),
                                               F.coalesce(F.sum(F.col("label").cast("int")), F.lit(0)).alias("bad"))
    tree = cut(templates(counted))
    judged = tree.select("host", "form", "template").join(purity(tree).select("host", "template", "purity", "host_bad", "level"), ["host", "template"])
    return rows.join(judged, ["host", "form"], "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when((F.col("host") != "") & (F.col("host_bad") > 0) & (F.col("purity") >= reject), "block").otherwise("allow")).alias("verdict"),
        "template", "purity", "level")
