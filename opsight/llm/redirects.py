"""URL filter with redirect equivalence.

Every URL is judged by the longest rule that fits it. URLs joined by a redirect or by a canonical link are names of
one resource: the connected components over these edges carry a block to all aliases. An explicit allow takes precedence: a URL
that an allow rule fits stays allowed, whatever its aliases are. The decision of a URL counts also if it is only the
target of a link and no page was fetched from it.

An address (node) is host, path and query of a URL; scheme and fragment are left out. Edges come from the HTML (a canonical `link` in
it, a `meta` refresh) and from a table of observed redirects, if given. Only pages that have an edge enter the graph; components
are found by contraction rounds over written tables (see `components`), nodes have numbers, not hashes, so two addresses never meet by chance.
Blocked addresses are joined back to the pages by address: a page whose address is hot is one side of a left join that AQE can split.

Edge cases: a null URL or one without `://` has an empty host and path, no rule and no address (its own links still count
through its page id, if that isn't null); comments, scripts and styles hold no links; an empty or unusable target is no edge; a null html has
none; repeated rows are judged each for itself; tables may be empty; only the named columns are read, others are not returned.
"""

from __future__ import annotations

import html as _html
import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

AZ, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host between the first :// and the next / ? # with A-Z lower-cased, path up to ? or #; empty without ://."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(u, PARTS, 1), AZ, LOW), F.regexp_extract(u, PARTS, 2)


def address(url: Column) -> Column:
    """Host, path (at least /) and query of a URL; null without ://."""
    host, path = url_parts(url)
    whole = F.concat(host, F.when(path == "", "/").otherwise(path), F.coalesce(F.regexp_extract(url.cast("string"), PARTS, 3), F.lit("")))
    return F.when(url.contains("://"), whole)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule; nulls if none fits. Rules are (verdict, "host/path"), a short list."""
    cases = F.when(F.lit(False), None)
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        cases = cases.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
    return cases


HIDDEN = r"(?s)<!--.*?-->|(?i:<(script|style)\b.*?</\1\s*>)"
LINK_TAGS = r"(?is)(<(?:link|meta)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)"
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))""")
REFRESH = re.compile(r"""^\s*[\d.]*\s*[;,]?\s*url\s*=\s*(?:"([^"]*)"|'([^']*)'|(.*))$""", re.I | re.S)


def link_target(tag: str) -> str | None:
    """The target of a canonical link tag or of a refresh meta tag; None for others."""
    at = {}
    for m in ATTRIBUTE.finditer(tag):
        at.setdefault(m[1].lower(), _html.unescape(next((g for g in m.groups()[1:] if g is not None), "")))
    if tag[1:5].lower() == "link":
        return at.get("href") if "canonical" in at.get("rel", "").lower().split() else None
    if at.get("http-equiv", "").strip().lower() == "refresh":
        m = REFRESH.match(at.get("content", ""))
        return next((g for g in m.groups() if g is not None), None) if m else None
    return None


def _targets(batches):
    """(key, url, tags) -> (key, target): absolute URLs of what a page's tags point to."""
    for b in batches:
        keys, targets = [], []
        for key, url, tags in zip(*(c.to_pylist() for c in b.columns)):
            for tag in tags or ():
                href = link_target(tag)
                if href is None or not href.strip():
                    continue
                try:
                    full = urljoin(url or "", href.strip())
                except ValueError:
                    continue
                if "://" in full:
                    keys.append(key)
                    targets.append(full)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(targets, pa.string())], names=["key", "target"])


def page_links(pages: DataFrame) -> DataFrame:
    """(key, target) of pages (key, url, html): canonical links and refreshes. Pages without a trace of one are left out on the JVM."""
    some = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select(
        "key", "url", F.regexp_extract_all(F.regexp_replace("html", HIDDEN, ""), F.lit(LINK_TAGS), F.lit(1)).alias("tags"))
    return some.where(F.size("tags") > 0).mapInArrow(_targets, "key string, target string")


def blocked_addresses(edges: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(key) of all addresses that share a component of `edges` (src, dst) with an address that a rule blocks."""
    edges = materialise(edges.where("src is not null and dst is not null and src <> dst").distinct(), "url-edges")
    names = edges.select(F.explode(F.array("src", "dst")).alias("key")).distinct()
    nodes = materialise(names.withColumn("node", F.monotonically_increasing_id()), "url-nodes")
    numbered = (edges.join(nodes.select(F.col("key").alias("src"), F.col("node").alias("a")), "src")
                .join(nodes.select(F.col("key").alias("dst"), F.col("node").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    host, path = url_parts(F.concat(F.lit("://"), F.col("key")))
    judged = nodes.join(connected_components(numbered), "node").withColumn("own", rule_of(host, path, rules)["verdict"])
    bad = judged.where("own = 'block'").select("root").distinct()
    return judged.join(bad, "root").select("key")


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None,
                 id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict) of each page. `redirects` (src, dst) are absolute URLs of observed HTTP redirects."""
    src = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    # A page without an address takes part under its id; NUL keeps that apart from every address.
    src = src.withColumn("key", F.coalesce(address(F.col("url")), F.concat(F.lit("\0"), F.col("id").cast("string"))))
    links = page_links(src.select("key", "url", "html")).select(F.col("key").alias("src"), address(F.col("target")).alias("dst"))
    if redirects is not None:
        links = links.unionByName(redirects.select(address(F.col("src")).alias("src"), address(F.col("dst")).alias("dst")))
    blocked = blocked_addresses(links, rules).withColumn("hit", F.lit(True))
    host, path = url_parts(F.col("url"))
    own = src.select("id", "key", host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("own"))
    return own.join(blocked, "key", "left").select(
        "id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))
