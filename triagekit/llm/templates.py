"""URL filter: rules for hosts and paths, and templates of paths that labelled urls show to be bad.

A tree of templates is grown per host, one path segment at a time. A segment is variable by its form (numbers,
hexadecimal names, long strings) or because too few urls of its node share it; variable segments become a
wildcard, the others stay literal branches. Branches of a node whose urls are alike - what labels say of them, and
whether they go on - by a chi-square test are merged. A template is rejected when the share of bad labels
among its labelled urls, smoothed by a prior, reaches a threshold; templates without evidence are allowed.

All steps are DataFrame operations. Urls are reduced to distinct shapes first, so the tree is grown on counts; a
node has a bounded number of literal branches; joins broadcast the few heavy hosts, nodes and shapes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagekit.llm.skew import join_by_weight
from triagekit.sources.store import materialize

ALLOW, BLOCK = "allow", "block"
WILDCARD, DEEPER = "*", "**"

# --- fixed values: forms of variable segments, and chi-square at 1 % for 1 to 5 degrees of freedom -----------
VARIABLE = r"^(?:[0-9][0-9._-]*|(?=[^0-9]*[0-9])[0-9A-Fa-f-]{8,}|.{41,})$"
EXTENSION = r"^(.+)(\.[A-Za-z]{1,5})$"
CHI_SQUARE = (6.635, 9.210, 11.345, 13.277, 15.086)


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreeRules:
    """How a template tree is grown and judged.

    A segment is literal with at least ``least_urls`` urls and ``least_share`` of its node's. Paths are told apart
    by ``depth`` segments; what is deeper is one wildcard. Smoothing counts as ``prior_urls`` labelled urls
    of which ``prior_bad`` are bad.
    """

    least_urls: int = 8
    least_share: float = 0.02
    depth: int = 6
    prior_urls: float = 2.0
    prior_bad: float = 0.5
    reject_at: float = 0.9


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies between the first ``://`` and ``/``, ``?`` or ``#``, A-Z lower-cased, and what follows up to ``?`` or ``#``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(F.regexp_extract(text, parts, 1), upper, upper.lower()), F.regexp_extract(text, parts, 2)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null; of equally long ones the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def shape_of(path: Column, depth: int) -> Column:
    """The path with a wildcard for each segment that is variable by its form; extensions stay."""

    def general(segment: Column) -> Column:
        stem, extension = F.regexp_extract(segment, EXTENSION, 1), F.regexp_extract(segment, EXTENSION, 2)
        by_stem = F.when((extension != "") & stem.rlike(VARIABLE), F.concat(F.lit(WILDCARD), F.lower(extension))).otherwise(segment)
        return F.when(segment.rlike(VARIABLE), WILDCARD).otherwise(by_stem)

    segments = F.split(F.substr(path, F.lit(2)), "/", -1)
    kept = F.transform(F.slice(segments, 1, depth), general)
    deeper = F.when(F.size(segments) > depth, F.array(F.lit(DEEPER))).otherwise(F.array().cast("array<string>"))
    return F.when(path == "", "").otherwise(F.concat(F.lit("/"), F.array_join(F.concat(kept, deeper), "/")))


def _outcomes(x: Column) -> list[Column]:
    """Urls of a branch by label (bad, good, none), ending here or going on; going on is counted over all labels."""
    return [x["bad"], x["good"], x["n"] - x["bad"] - x["good"]]


def _statistic(a: Column, b: Column) -> Column:
    """Whether two branches differ, by chi-square over labels and over whether urls go on."""

    def chi(cells: list[tuple[Column, Column]]) -> tuple[Column, Column]:
        total, filled = F.lit(0.0), F.lit(-1)
        for x, y in cells:
            gap = x * F.sqrt(b["n"] / a["n"]) - y * F.sqrt(a["n"] / b["n"])
            total = total + F.when(x + y > 0, gap * gap / (x + y)).otherwise(0.0)
            filled = filled + (x + y > 0).cast("int")
        return total, filled

    labels, df_labels = chi(list(zip(_outcomes(a), _outcomes(b))))
    on, df_on = chi([(a["more"], b["more"]), (a["n"] - a["more"], b["n"] - b["more"])])
    limit = F.element_at(F.array(*[F.lit(x) for x in CHI_SQUARE]), df_labels + df_on)
    return (df_labels + df_on > 0) & (labels + on > F.when(df_labels + df_on > 0, limit))


def _merged(branches: Column) -> Column:
    """Groups of like branches: the largest first, each joins the first group that it does not differ from."""
    group = "array<struct<names: array<string>, n: bigint, bad: bigint, good: bigint, more: bigint>>"

    def add(groups: Column, x: Column) -> Column:
        place = F.array_position(F.transform(groups, lambda g: ~_statistic(g, x)), F.lit(True))
        own = F.struct(F.array(x["name"]).alias("names"), *[x[c].alias(c) for c in ("n", "bad", "good", "more")])
        joined = F.transform(
            groups,
            lambda g, i: F.when(
                i + 1 == place,
                F.struct(
                    F.concat(g["names"], F.array(x["name"])).alias("names"), *[(g[c] + x[c]).alias(c) for c in ("n", "bad", "good", "more")]
                ),
            ).otherwise(g),
        )
        return F.when(place > 0, joined).otherwise(F.concat(groups, F.array(own)))

    order = F.array_sort(F.transform(branches, lambda x: F.struct(
        (-x["n"]).alias("place"), x["name"].alias("name"), x["n"].alias("n"), x["bad"].alias("bad"), x["good"].alias("good"), x["more"].alias("more")
    )))
    return F.aggregate(order, F.array().cast(group), add)


def _piece(names: Column) -> Column:
    sorted_names = F.array_sort(names)
    return F.when(F.size(names) == 1, names[0]).otherwise(F.concat(F.lit("{"), F.array_join(sorted_names, "|"), F.lit("}")))


def _grow(tree: DataFrame, level: int, how: TreeRules) -> DataFrame:
    """Extend the node of every shape that has a segment at ``level``."""
    live = tree.where(F.size("segments") > level).withColumn("segment", F.col("segments")[level])
    ended = tree.where(F.size("segments") <= level)
    going_on = F.sum(F.when(F.size("segments") > level + 1, F.col("n")).otherwise(0)).alias("more")
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
    counts = live.groupBy("host", "node", "node_n", "segment").agg(*sums, going_on, F.sum("rows").alias("rows"))
    enough = (F.col("n") >= how.least_urls) & (F.col("n") >= F.col("node_n") * how.least_share)
    named = counts.withColumn("name", F.when(enough, F.col("segment")).otherwise(WILDCARD))
    branches = named.groupBy("host", "node", "name").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good", "more", "rows")])
    # At most 1 / least_share literal branches and the wildcard for any node.
    nodes = branches.groupBy("host", "node").agg(
        F.collect_list(F.struct("name", "n", "bad", "good", "more")).alias("branches"), F.sum("rows").alias("weight")
    )
    groups = nodes.select("host", "node", "weight", _merged(F.col("branches")).alias("groups"))
    entries = F.flatten(F.transform("groups", lambda g: F.transform(
        g["names"], lambda x: F.struct(x, F.struct(_piece(g["names"]).alias("piece"), g["n"].alias("n")))
    )))
    found = materialize(groups.select("host", "node", "weight", F.map_from_entries(entries).alias("pieces")), "template-nodes")
    total = found.agg(F.sum("weight")).first()[0] or 0
    met = join_by_weight(live, found, ["host", "node"], total, "weight")
    piece = F.coalesce(F.try_element_at("pieces", F.col("segment")), F.try_element_at("pieces", F.lit(WILDCARD)))
    grown = met.withColumn("_p", piece).withColumn("node", F.concat("node", F.lit("/"), F.col("_p.piece"))).withColumn("node_n", F.col("_p.n"))
    return ended.unionByName(grown.select(*tree.columns))


def template_tree(urls: DataFrame, how: TreeRules = TreeRules()) -> DataFrame:
    """``host, shape, n, template, bad, good, purity`` of every distinct shape.

    ``urls`` has ``host, path, bad``, the last true, false or null where there is no label.
    """
    shapes = urls.groupBy("host", shape_of(F.col("path"), how.depth).alias("shape")).agg(
        F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")
    )
    segments = F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split(F.substr("shape", F.lit(2)), "/", -1))
    tree = shapes.select("*", segments.alias("segments"), F.lit(1).cast("long").alias("rows"), F.lit("").alias("node"))
    tree = materialize(tree, "template-shapes")
    hosts = tree.groupBy("host").agg(F.sum("n").alias("node_n"), F.sum("rows").alias("weight"))
    size = tree.agg(F.max(F.size("segments")), F.sum("rows")).first()
    tree = materialize(join_by_weight(tree, hosts, ["host"], size[1] or 0, "weight"), "template-tree")
    for level in range(size[0] or 0):  # at most depth + 1
        tree = materialize(_grow(tree, level, how), "template-tree")
    purity = (F.col("bad") + how.prior_urls * how.prior_bad) / (F.col("bad") + F.col("good") + how.prior_urls)
    judged = tree.groupBy("host", "node").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum("rows").alias("weight"))
    judged = judged.withColumn("purity", purity)
    named = tree.select("host", "shape", "n", "node")
    return join_by_weight(materialize(named, "template-names"), judged, ["host", "node"], size[1] or 0, "weight").withColumnRenamed("node", "template")


def filter_urls(
    pages: DataFrame, rules: list[Rule], labels: Column | None = None, how: TreeRules = TreeRules(),
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` per row of ``pages``.

    ``labels`` says whether a url is known to be bad (true), known to be good (false) or not known (null); without
    it, urls that a rule decides are the labelled ones. A url that a rule fits has the rule's verdict, any other
    that of its template.

    A null url or one without ``://`` has empty host and path; such urls are one host's. Repeated rows and null
    ids get a row each and count each. Very long urls are judged by their first ``how.depth`` segments, each told
    apart as a whole, and a wildcard. No rows give no rows. Other columns are ignored, whatever their names.
    """
    host, path = host_and_path(F.col(url_col))
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    label = labels if labels is not None else F.lit(None).cast("boolean")
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), label.alias("bad"))
    urls = urls.select("*", rule.alias("rule"), verdict.alias("ruled"))
    if labels is None:
        urls = urls.withColumn("bad", F.col("ruled") == BLOCK)
    urls = materialize(urls.withColumn("shape", shape_of(F.col("path"), how.depth)), "urls")
    tree = materialize(template_tree(urls, how), "templates")
    total = tree.agg(F.sum("n")).first()[0] or 0
    table = tree.select("host", "shape", "n", "template", "purity")
    met = join_by_weight(urls, table, ["host", "shape"], total)
    method = F.when(F.col("purity") >= how.reject_at, BLOCK).otherwise(ALLOW)
    return met.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity")
