"""URL filters: explicit host and path rules, and block decisions carried to the aliases of blocked pages.

Addresses are nodes: host in lower case, path and query, no fragment. The normal form of an address has no leading www. or
m. label, no port 80 or 443, no . or .. segments, no closing slash, and of its query only what doesn't just track the
visitor; pages that differ in another parameter are no aliases. An edge joins a page's address as written to what
it stands for: the target of a canonical link in its HTML, the target of a meta refresh, and that of a redirect; another
joins each of these addresses to its normal form. Relative targets are resolved against the page's base link or address.
Connected components of these edges are classes of aliases, and the rules are applied to all addresses in them, whether
pages or not: as written, and where no rule fits, in the normal form, but with the closing slash. A page that no rule fits
is blocked if an address of its class is blocked by a rule and none is allowed by one: an explicit allow, of the page or in
its class, comes first. All other pages are allowed.

Nulls, ties, repeats: a null URL or one without :// has an empty host and path, fits no rule, has no aliases and is
allowed; null HTML has no links; targets with a scheme but no :// and those without a host are no addresses; rows with one
address share its class; an empty table gives an empty result; columns beyond page_id, url and html don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, settle, table, whole
from .components import connected_components

#: (rule, verdict); a rule is a host and, from its first slash on, a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Query parameters that say where a visitor comes from, not what the page is.
TRACKING = r"\A(utm_[^=]*|ref|fbclid|gclid|msclkid|mc_cid|mc_eid|sessionid|sid)(=|\z)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(whole(url), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(whole(url), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    """The query with its question mark, '' without one."""
    return F.regexp_replace(F.regexp_extract(whole(url), r"(?s)\A.*?://[^?#]*(\?[^#]*)", 1), r"\A\?\z", "")


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as a struct (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def normal_host(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.(?=[^.]+\.)", "")


def without_dots(path: Column) -> Column:
    """The path without its . and .. segments; one that ends in them keeps a closing slash."""

    def step(stack: Column, x: Column) -> Column:
        # the empty segment before the first slash stays
        above = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(1)))
        return F.when(x == "..", above).when(x == ".", stack).otherwise(F.concat(stack, F.array(x)))

    parts = F.split(F.concat(path, F.when(path.rlike(r"/\.\.?\z"), "/").otherwise("")), "/", -1)
    return F.when(path.rlike(r"/\.\.?(/|\z)"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")).otherwise(path)


def address(url: Column) -> Column:
    """The node of an address; null for an empty host. A host has no slash or question mark, a path is empty or begins with a slash."""
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query_of(url)))


def node_host(node: Column) -> Column:
    return F.regexp_extract(node, r"\A[^/?]*", 0)


def node_path(node: Column) -> Column:
    return F.regexp_extract(node, r"(?s)\A[^/?]*([^?]*)", 1)


def node_query(node: Column) -> Column:
    return F.regexp_extract(node, r"(?s)\A[^?]*(.*)", 1)


def normal_query(query: Column) -> Column:
    kept = F.filter(F.split(F.substring(query, 2, 1 << 30), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    return F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")


def normal_address(node: Column) -> Column:
    """What an address stands for; null for null."""
    return F.concat(normal_host(node_host(node)), F.regexp_replace(without_dots(node_path(node)), r"/+$", ""), normal_query(node_query(node)))


def resolved(target: Column, node: Column) -> Column:
    """The node that a target, absolute or relative to a node, leads to; null if it leads to none."""
    full = F.when(target.startswith("//"), F.concat(F.lit("x:"), target)).when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target)
    path, query = F.regexp_extract(target, r"(?s)\A[^?#]*", 0), F.regexp_extract(target, r"(?s)\A[^?#]*(\?[^#]+)", 1)
    folder = F.concat(node_host(node), F.regexp_replace(node_path(node), r"[^/]*\z", ""))
    beside = F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), path, query)
    same = F.when(query == "", node).otherwise(F.concat(node_host(node), node_path(node), query))
    other = F.when(path == "", same).when(path.startswith("/"), F.concat(node_host(node), path, query)).otherwise(beside)
    relative = F.when((target != "") & ~target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), other)
    to = F.when(full.isNotNull(), address(full)).otherwise(relative)
    return F.concat(node_host(to), without_dots(node_path(to)), node_query(to))


def links_of(html: Column) -> Column:
    """base: the HTML's base link, null if it has none; targets: those of its canonical link and its meta refresh."""
    base = F.regexp_extract(html, r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    canonical = F.regexp_extract(html, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.regexp_extract(html, r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    return F.struct(F.when(base != "", base).alias("base"), F.filter(F.array(canonical, refresh), lambda x: x != "").alias("targets"))


def classified(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Per row of pages: page_id, host, path, rule and verdict. redirects: further edges (from_url, to_url)."""
    html = pages["html"] if "html" in pages.columns else F.lit("")
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("address"), links_of(whole(html)).alias("links"))
    seen = seen.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    seen = settle(seen)

    linked = seen.filter(F.size("links.targets") > 0).select(F.col("address").alias("a"), "links.base", F.explode("links.targets").alias("to"))
    linked = linked.select("a", F.coalesce(resolved(F.col("base"), F.col("a")), F.col("a")).alias("base"), "to").select("a", resolved(F.col("to"), F.col("base")).alias("b"))
    if redirects is not None:
        ends = redirects.select(address(F.col("from_url")).alias("a"), "to_url")
        linked = linked.unionByName(ends.select("a", resolved(F.col("to_url"), F.col("a")).alias("b")))
    linked = settle(linked.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct())
    nodes = seen.select(F.col("address").alias("node")).unionByName(linked.select(F.explode(F.array("a", "b")).alias("node")))
    nodes = nodes.filter(F.col("node").isNotNull()).distinct().withColumn("key", normal_address(F.col("node")))
    # an address stands in the class of its normal form by itself; what is left to connect are the ends of links, and
    # normal forms that are addresses and have another normal form
    forms = nodes.select(F.col("key").alias("node")).distinct().filter(normal_address(F.col("node")) != F.col("node")).join(nodes, "node", "left_semi")
    edges = linked.select(normal_address(F.col("a")).alias("a"), normal_address(F.col("b")).alias("b")).unionByName(forms.select(F.col("node").alias("a"), normal_address(F.col("node")).alias("b")))
    classes = connected_components(edges, "string").withColumnRenamed("node", "key")
    # the words of all rules that hold within a class, be its addresses pages or not.
    # A normal form is judged in the spellings that lead to it, as rules may end in the slash that it lacks.
    host, path = node_host(F.col("node")), node_path(F.col("node"))
    fit = F.coalesce(fitting_rule(host, path, rules), fitting_rule(normal_host(host), without_dots(path), rules))
    judged = nodes.withColumn("fit", fit).filter(F.col("fit").isNotNull()).join(classes, "key", "left").withColumn("component", F.coalesce("component", "key"))
    votes = judged.groupBy("component").agg(F.max(F.col("fit.verdict") == "allow").alias("any_allowed"), F.max(F.col("fit.verdict") == "block").alias("any_blocked"))
    blocked = votes.filter(F.col("any_blocked") & ~F.col("any_allowed")).select("component", F.lit(True).alias("blocked"))
    free = seen.filter(F.col("fit").isNull()).withColumn("key", normal_address(F.col("address"))).join(classes, "key", "left")
    free = free.withColumn("component", F.coalesce("component", "key")).join(blocked, "component", "left")
    out = free.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("blocked"), "block").otherwise("allow").alias("verdict"))
    return out.unionByName(seen.filter(F.col("fit").isNotNull()).select("page_id", "host", "path", "fit.rule", "fit.verdict"))


def op4_redirect_filter(spark, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
