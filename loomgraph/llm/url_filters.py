"""URL filters with redirect equivalence, native expressions only.

Rules allow or block a host with its subdomains, under a path prefix; the
longest fitting rule decides, and allow where two of one length disagree.  Pages whose addresses are tied by redirects
(``<meta http-equiv=refresh>`` and an optional table of crawled redirects) or by
canonical links are aliases: connected components over these edges.  A component
with an address that a rule blocks is blocked; an address that a rule allows
stays allowed, whatever its aliases; all else is allowed.

An address is host, path and query: scheme and fragment make no difference.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no
rule, has no aliases and is allowed.  Null html has no links.  Links to other
schemes are ignored.  Repeated pages share their verdict.  Extra columns pass; results replace
columns of their names, and ``__rid``, ``__u``, ``__to``, ``__node``, ``__bad`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, let

#: Fixed values of the default query: (verdict, rule).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MOST_INLINE = 500


def parts(url: Column) -> Column:
    """struct(host, path, node): node is the address, null without a host."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")

    def of(r: Column) -> Column:
        host = F.translate(F.regexp_extract(r, r"^([^/?#]*)", 1), UPPER, UPPER.lower())
        path = F.regexp_extract(r, r"^[^/?#]*([^?#]*)", 1)
        tail = F.regexp_extract(r, r"^[^/?#]*([^#]*)", 1)
        return let(host, lambda h: F.struct(h.alias("host"), path.alias("path"), F.when(h != "", F.concat(h, tail)).alias("node")))

    return let(rest, of)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest fitting rule, or null."""
    known = F.array(*[F.struct(F.lit(len(r)).alias("size"), F.lit(v == "allow").alias("first"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.split("/", 1)[0]).alias("h"), F.lit("/" + r.split("/", 1)[1]).alias("p")) for v, r in rules])
    fits = lambda x: ((host == x["h"]) | host.endswith(F.concat(F.lit("."), x["h"]))) & path.startswith(x["p"])
    return F.array_max(F.filter(known, fits))


def with_rules(df: DataFrame, rules: list[tuple[str, str]], key: str) -> DataFrame:
    """``df`` (host, path, ...) plus rule and rule_verdict; ``key`` names a row."""
    if len(rules) <= MOST_INLINE:
        got = df.withColumn("__r", rule_of(F.col("host"), F.col("path"), rules)) if rules else df.withColumn("__r", F.lit(None).cast("struct<rule:string,verdict:string>"))
        return got.withColumns({"rule": F.col("__r.rule"), "rule_verdict": F.col("__r.verdict")}).drop("__r")
    table = df.sparkSession.createDataFrame([(r.split("/", 1)[0], "/" + r.split("/", 1)[1], r, v) for v, r in rules], "h string, p string, rule string, verdict string")
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = (
        df.select(key, "path", F.explode(tails).alias("h"))
        .join(table, "h")
        .where(F.col("path").startswith(F.col("p")))
        .groupBy(key)
        .agg(F.max(F.struct(F.length("rule").alias("size"), (F.col("verdict") == "allow").alias("first"), "rule", "verdict")).alias("r"))
    )
    return df.join(best, key, "left").withColumns({"rule": F.col("r.rule"), "rule_verdict": F.col("r.verdict")}).drop("r")


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"""(?i)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 1)
    single = F.regexp_extract(tag, rf"""(?i)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 2)
    bare = F.regexp_extract(tag, rf"""(?i)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 3)
    return F.concat(quoted, single, bare)


def linked_urls(html: Column) -> Column:
    """Targets of canonical links and of refresh redirects, as written."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tied = F.filter(tags, lambda t: t.rlike(r"""(?i)^<link\b.*\srel\s*=\s*["']?[^"'>]*\bcanonical\b""") | t.rlike(r"""(?i)^<meta\b.*http-equiv\s*=\s*["']?\s*refresh\b"""))
    refresh = lambda t: F.regexp_extract(_attribute(t, "content"), r"(?i)url\s*=\s*['\"]?([^'\"]*)", 1)
    target = F.transform(tied, lambda t: F.trim(F.when(t.rlike(r"(?i)^<link"), _attribute(t, "href")).otherwise(refresh(t))))
    return F.when(html.rlike(r"(?i)canonical|http-equiv"), F.array_remove(target, "")).otherwise(F.array().cast("array<string>"))


def resolve(url: Column, target: Column) -> Column:
    """An absolute form of a link's target; null for other schemes."""
    scheme = F.substring_index(url, "://", 1)
    root = F.regexp_extract(url, r"^([\s\S]*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*/)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]] = RULES,
    *,
    redirects: DataFrame | None = None,
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``pages`` less their html, plus host, path, rule and verdict.

    ``redirects`` may add (src, dst) pairs of urls that a crawler followed."""
    final = Scratch(pages.sparkSession)
    own = [c for c in pages.columns if c not in (html_col, "host", "path", "rule", "verdict")]
    url = F.col(url_col)
    src = pages.select(F.monotonically_increasing_id().alias("__rid"), *own, parts(url).alias("__u"), linked_urls(F.col(html_col)).alias("__to"))
    src = src.select("__rid", *own, "__u.host", "__u.path", F.col("__u.node").alias("__node"), "__to")
    # stored, so that one numbering of the rows holds
    judged = final.table(src) if len(rules) > MOST_INLINE else src
    judged = final.table(with_rules(judged, rules, "__rid"))
    with Scratch(pages.sparkSession) as scratch:
        bad = blocked_addresses(judged, rules, redirects, url, scratch, final)
    verdict = F.coalesce("rule_verdict", F.lit("allow"))
    if bad is not None:
        judged = judged.join(bad, "__node", "left")
        verdict = F.coalesce("rule_verdict", F.when(F.col("__bad"), F.lit("block")), F.lit("allow"))
    return judged.select(*own, "host", "path", "rule", verdict.alias("verdict"))


def blocked_addresses(judged: DataFrame, rules: list, redirects: DataFrame | None, url: Column, scratch: Scratch, final: Scratch) -> DataFrame | None:
    """(__node, __bad) of every address tied to one that a rule blocks; None without ties."""
    links = judged.where(F.size("__to") > 0).select("__node", url.alias("__url"), F.explode("__to").alias("t"))
    links = links.select(F.col("__node").alias("a"), resolve(F.col("__url"), F.col("t")).alias("u"))
    links = links.select("a", parts(F.col("u"))["node"].alias("b"), "u")
    if redirects is not None:
        links = links.unionByName(redirects.select(parts(F.col("src"))["node"].alias("a"), parts(F.col("dst"))["node"].alias("b"), F.col("dst").alias("u")))
    links = scratch.table(links.where("a is not null and b is not null and a <> b").distinct())
    if links.isEmpty():
        return None
    # addresses get numbers of their own: a hash of 64 bits would tie strangers at scale
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    nodes = scratch.table(nodes.withColumn("id", F.monotonically_increasing_id()))
    edges = links.join(nodes.select(F.col("node").alias("a"), F.col("id").alias("src")), "a").join(nodes.select(F.col("node").alias("b"), F.col("id").alias("dst")), "b")
    comp = scratch.table(connected_components(edges, scratch).join(nodes, "id").select("node", "comp"))
    # an alias that was never crawled can be blocked as well
    targets = links.select(F.col("b").alias("node"), parts(F.col("u")).alias("p")).select("node", "p.host", "p.path").distinct()
    seen = judged.where("__node is not null").select(F.col("__node").alias("node"), "rule_verdict").unionByName(with_rules(targets, rules, "node").select("node", "rule_verdict"))
    down = scratch.table(comp.join(seen.where("rule_verdict = 'block'").select("node").distinct(), "node", "left_semi").select("comp").distinct())
    return final.table(comp.join(down, "comp", "left_semi").select(F.col("node").alias("__node"), F.lit(True).alias("__bad")))
