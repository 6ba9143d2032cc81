"""URL filter: host and path rules, spread to aliases along redirect and canonical-link edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlane.operators.graph import connected_components
from epochlane.operators.skew import join_spread
from epochlane.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are written into the expression; more go through a join on host suffixes.
INLINE_RULES = 256
SALTS = 16
#: Entities that occur in URLs; the ampersand's come last, as they start the others.
ENTITIES = {"&quot;": '"', "&#34;": '"', "&apos;": "'", "&#39;": "'", "&lt;": "<", "&gt;": ">", "&#47;": "/", "&#x2F;": "/", "&#x2f;": "/", "&#58;": ":", "&#x3A;": ":", "&#61;": "=", "&#x3D;": "=", "&#63;": "?", "&#x3F;": "?", "&#38;": "&", "&#x26;": "&", "&amp;": "&"}

Rule = tuple[str, str]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def _with_rule_inline(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, path = _split(rule)
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return df.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.verdict")}).drop("_best")


def _with_rule_joined(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    table = df.sparkSession.createDataFrame([(*_split(r), r, v) for r, v in rules], "_host string, _path string, rule string, rule_verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = df.select("host", "path").distinct().withColumn("_host", F.explode(F.array_distinct(suffixes)))
    hit = near.join(table, "_host").where(F.col("path").startswith(F.col("_path")))
    best = hit.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), "rule", "rule_verdict")).alias("b")).select("host", "path", "b.rule", "b.rule_verdict")
    return df.join(best, ["host", "path"], "left")


def with_rule(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """df (host, path) with `rule` and `rule_verdict` of the longest rule that fits, else nulls.

    A rule is host + path, as in "example.org/es/"; it fits its host and every
    subdomain when the path starts with the rule's path. Rules are code, not data:
    their number doesn't grow with the pages. Of equal rules an allow wins.
    """
    said: dict[str, str] = {}
    for rule, verdict in rules:
        said[rule] = "allow" if "allow" in (verdict, said.get(rule)) else verdict
    once = list(said.items())
    return _with_rule_inline(df, once) if len(once) <= INLINE_RULES else _with_rule_joined(df, once)


def normal_form(url: Column) -> Column:
    """One text for URLs that name the same page: host and path and query without scheme, fragment,
    trailing slashes and utm_ parameters. Null where there is no host."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    return F.when(host_of(url) != "", F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, quoted or bare; empty where there is none."""
    pattern = rf"""(?is)(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


def unescaped(text: Column) -> Column:
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def without_dots(path: Column) -> Column:
    """A path with its segments . and .. carried out."""
    def step(kept: Column, segment: Column) -> Column:
        return F.when(segment == ".", kept).when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(segment)))

    parts = F.split(path, "/")
    # the first segment is what stands before the leading slash, and stays
    walked = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, 1, 1), step)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(walked, "/")).otherwise(path)


def resolved(target: Column, url: Column) -> Column:
    """The absolute URL that a link target names on the page url; null for other schemes, and for
    targets that are empty or a fragment of the page itself."""
    scheme, base, path = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path_of(url)
    folder = F.concat(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1), F.lit("/"))
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*([?][^#]*)?", 1)
    absolute = target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return (
        F.when(base == "", F.when(absolute & target.contains("://"), target))
        .when(absolute, F.when(target.contains("://"), target))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when((target == "") | target.startswith("#"), F.lit(None))
        .when(target.startswith("?"), F.concat(base, path, rest))
        .when(target.startswith("/"), F.concat(base, without_dots(own), rest))
        .otherwise(F.concat(base, without_dots(F.concat(folder, own)), rest))
    )


def link_targets(url: Column, html: Column) -> Column:
    """Array of absolute URLs that a page's canonical links and refresh redirects name; may be empty.

    A link is canonical if `canonical` is one of the words of its rel. Entities in targets are
    decoded; relative targets are taken from the page's own URL."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))

    def target(tag: Column) -> Column:
        canonical = tag.rlike(r"(?i)^<link") & F.array_contains(F.split(F.trim(F.lower(attribute(tag, "rel"))), r"\s+"), "canonical")
        refresh = tag.rlike(r"(?i)^<meta") & (F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh")
        to = F.regexp_extract(unescaped(attribute(tag, "content")), r"""(?is)^[\s\d.]*[;,]?\s*url\s*=\s*["']?([^"']*)""", 1)
        return F.btrim(F.when(canonical, unescaped(attribute(tag, "href"))).when(refresh, to), F.lit(" \t\n\f\r"))

    return F.array_compact(F.transform(F.filter(F.transform(tags, target), lambda t: t.isNotNull()), lambda t: resolved(t, url)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): normal forms joined by a canonical link or a refresh redirect."""
    at = pages.select("url", F.explode(link_targets(F.col("url"), F.col("html"))).alias("to"))
    return at.select(normal_form(F.col("url")).alias("src"), normal_form(F.col("to")).alias("dst")).where("src <> dst").distinct()


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """pages (page_id, url, html; other columns are ignored) with host, path, rule and verdict.

    A page with a fitting rule takes its verdict. Any other takes its alias group's:
    pages and link targets of equal normal form, or joined by redirect and canonical
    links over any number of steps. An explicit allow in the group wins over a block;
    with neither, the verdict is allow. One row per page row; null urls have empty
    host and path, no rule and verdict allow. An empty table gives an empty table.
    `alias_group` is the least normal form of the group, null for pages without a rule or a link.
    """
    kept = pages.select("page_id", "url", "html")
    own = with_rule(kept.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), normal_form(F.col("url")).alias("form")), rules)
    groups = connected_components(materialise(alias_edges(kept)))
    slashed = F.concat(F.lit("://"), F.col("node"))
    nodes = with_rule(groups.withColumns({"host": host_of(slashed), "path": path_of(slashed)}), rules)
    # a trailing slash is part of a rule but not of a normal form, so the pages' own verdicts count too
    said = own.where("rule is not null and form is not null").groupBy("form").agg(F.max(F.col("rule_verdict") == "allow").alias("a"), F.max(F.col("rule_verdict") == "block").alias("b"))
    per_node = nodes.join(said.withColumnRenamed("form", "node"), "node", "full").select(
        "node", F.coalesce("component", "node").alias("alias_group"),
        (F.coalesce("a", F.lit(False)) | F.coalesce(F.col("rule_verdict") == "allow", F.lit(False))).alias("a"),
        (F.coalesce("b", F.lit(False)) | F.coalesce(F.col("rule_verdict") == "block", F.lit(False))).alias("b"))
    per_node = materialise(per_node)
    decided = per_node.groupBy("alias_group").agg(F.max("a").alias("allowed"), F.max("b").alias("blocked"))
    spread = join_spread(per_node.select("node", "alias_group"), materialise(decided), ["alias_group"], "node").where("allowed or blocked")
    spread = spread.select(F.col("node").alias("form"), "alias_group", "allowed", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = own.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(spread, ["form", "salt"], "left")
    method = F.when(F.col("allowed"), "allow").when(F.col("allowed") == False, "block").otherwise("allow")  # noqa: E712
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "alias_group")
