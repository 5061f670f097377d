"""Address filters with redirect equivalence: block decisions reach every alias of a blocked address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, lower_ascii, written
from .components import connected

#: (verdict, host, path): a rule fits its host and all subdomains when the path starts with the rule's; the longest wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_PARTS = "://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for NULL."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits (earlier ones win ties), else NULL. `rules` is a short list of settings."""
    fits = None
    for verdict, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        test = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(test, value) if fits is None else fits.when(test, value)
    return fits if fits is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def address(url: Column) -> Column:
    """The address without its fragment, which no server sees: the node that stands for it among links."""
    return F.substring_index(url, "#", 1)


def _resolved(base: Column, target: Column) -> Column:
    """A link's target as a full address."""
    scheme, host = F.regexp_extract(base, "^([^:/?#]+):", 1), F.regexp_extract(base, _PARTS, 1)
    folder = F.regexp_extract(path_of(base), "^(.*/)?", 1)
    site = F.concat(scheme, F.lit("://"), host)
    return F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)) \
        .when(target.startswith("/"), F.concat(site, target)) \
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Redirect (meta refresh) and canonical-link edges (source_url, target_url) that pages state in their markup. NULLs give none."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0)),
                    lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b|\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    tagged = pages.where(F.col(url).contains("://")).select(F.col(url).alias("source_url"), F.explode(tags).alias("tag"))
    target = F.coalesce(*[F.nullif(F.regexp_extract("tag", p, 1), F.lit("")) for p in (
        r"(?i)\bhref\s*=\s*[\"']\s*([^\"'>\s]+)", r"(?i)\bhref\s*=\s*([^\"'>\s]+)", r"(?i)\burl\s*=\s*[\"']?\s*([^\"'>\s;]+)")])
    return tagged.select("source_url", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("t")).where("t is not null") \
        .select("source_url", _resolved(F.col("source_url"), F.col("t")).alias("target_url"))


def judge_urls(cameras: DataFrame, links: DataFrame, image_url: str = "image_url", rules=RULES) -> DataFrame:
    """Camera records with the host and path of their image address, the rule that fits, and a verdict.

    `links` (source_url, target_url) are redirect and canonical-link edges; addresses joined by any chain of them are aliases.
    An address's own rule decides. Without one it is blocked when an alias is blocked by a rule and no alias is allowed by a
    rule (explicit allow takes precedence in the whole class), and allowed otherwise.

    Adds host, path, rule, verdict (columns of these names are replaced) and keeps every row. A NULL or `://`-less address has empty
    host and path, no alias, and is allowed. Repeated and reversed links count once; an empty links table leaves the rules alone.
    """
    nodes = links.select(address(F.col("source_url")).alias("a"), address(F.col("target_url")).alias("b"))
    linked = connected(nodes)
    own = matching_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    marked = linked.select("node", "root", F.coalesce(own, F.lit("")).alias("v"))
    classes = marked.groupBy("root").agg(F.max(F.col("v") == "block").alias("block"), F.max(F.col("v") == "allow").alias("allow")) \
        .where("block and not allow").select("root")
    node, spread, fit = (fresh(cameras, s) for s in ("node", "spread", "fit"))
    blocked = written(marked.where("v = ''").join(classes, "root").select(F.col("node").alias(node), F.lit(True).alias(spread)), "blocked")
    url = F.col(image_url)
    judged = cameras.withColumn(node, address(url)).join(blocked, node, "left") \
        .withColumns({"host": host_of(url), "path": path_of(url)})
    return judged.withColumn(fit, matching_rule(F.col("host"), F.col("path"), rules)).withColumns({
        "rule": F.col(fit)["rule"],
        "verdict": F.coalesce(F.col(fit)["verdict"], F.when(F.col(spread), "block").otherwise("allow"))}).drop(node, spread, fit)
