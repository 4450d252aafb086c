"""URL filters: path rules, and trust and distrust that spread over the host graph (operator 1)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import cut

ALLOW, BLOCK = "allow", "block"
#: So many rules become one expression; longer lists are a table that meets the hosts' parent domains.
MOST_RULES = 500
DAMPING, ROUNDS, CUT_EVERY = 0.85, 20, 5
#: A host's edges are dealt to this many keys, 63 at most: those in use are bits of a number.
SALTS = 32
#: A host with any distrust is blocked when that is this many times its trust. There is no least amount: what
#: reaches a host is divided by the links into the blocked one, so any fixed amount would spare linkers to large hosts.
BLOCK_RATIO = 1.5
#: Absolute and protocol-relative addresses in a page's attributes.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>\\]+)"""


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of an address; both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(action, rule), or null.

    A rule such as ``example.org/en/`` fits the host, its subdomains, and paths that start with its path.
    """
    found = []
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<action:string,rule:string>")


def with_rules(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Rows (host, path, ...) with fit, the longest rule that fits; of equally long ones the first in order.

    A long list meets the distinct addresses by each domain that a host ends with, so a page is compared with
    the rules of its own domains only.
    """
    if len(rules) <= MOST_RULES:
        return rows.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    table = rows.sparkSession.createDataFrame([(action, rule, rule.partition("/")[0], "".join(rule.partition("/")[1:])) for action, rule in rules], "action string, rule string, site string, start string")
    labels = F.split("host", r"\.")
    sites = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = rows.select("host", "path").distinct().select("host", "path", F.explode(sites).alias("site"))
    best = F.min_by(F.struct("action", "rule"), F.struct(-F.length("rule"), "rule"))
    found = asked.join(table, "site").where(F.col("path").startswith(F.col("start"))).groupBy("host", "path").agg(best.alias("fit"))
    return rows.join(found, ["host", "path"], "left").select(*rows.columns, "fit")


def parent(host: Column) -> Column:
    """The host without its first label, where at least two labels are left."""
    rest = F.substring(host, F.instr(host, ".") + 1, F.length(host))
    return F.when((F.instr(host, ".") > 0) & (F.instr(rest, ".") > 0), rest)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between hosts from rows (host, html): page links, and a host's tie to its parent domain.

    Links of one page to one host count once a page; ties have the weight of one link in each direction.
    """
    linked = pages.where("html is not null and host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), ascii_lower))).alias("dst"))
    counted = linked.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = pages.where("host <> ''").select("host").distinct()
    ties = hosts.select(F.col("host").alias("src"), parent(F.col("host")).alias("dst")).where("dst is not null")
    both = ties.union(ties.select("dst", "src")).withColumn("weight", F.lit(1.0))
    return counted.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _dealt(edges: DataFrame, end: str, other: str) -> DataFrame:
    """Edges with a salt of their other end, so that the edges of a host with very many are no hot key in a join."""
    return edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).withColumnRenamed(end, "host")


def _shares(edges: DataFrame, end: str, other: str) -> DataFrame:
    """(host, salt, to, share): each edge's part of the weight of all edges of the host at ``end``."""
    own = _dealt(edges, end, other)
    parts = own.groupBy("host", "salt").agg(F.sum("weight").alias("weight"))
    whole = parts.groupBy("host").agg(F.sum("weight").alias("whole"), F.collect_set("salt").alias("salts"))
    dealt = whole.select("host", "whole", F.explode("salts").alias("salt"))
    return own.join(dealt, ["host", "salt"]).select("host", "salt", F.col(other).alias("to"), (F.col("weight") / F.col("whole")).alias("share"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from rows (host, trust, distrust).

    Trust flows along links, distrust against them, both in the same rounds. Seeds are not scaled to the
    size of the graph, so a host's scores depend on its surroundings only. Sums are combined before each
    shuffle, and lineage is cut every few rounds. A host's edges are dealt to SALTS keys, and its scores go
    to those of them that it has edges under, so a hub is no hot key and other hosts are not copied more
    often than they have edges.
    """
    forward = _shares(edges, "src", "dst").select("host", "salt", "to", F.col("share").alias("t"), F.lit(0.0).alias("d"))
    backward = _shares(edges, "dst", "src").select("host", "salt", "to", F.lit(0.0).alias("t"), F.col("share").alias("d"))
    flows = cut(forward.union(backward).groupBy("host", "salt", "to").agg(F.sum("t").alias("t"), F.sum("d").alias("d")))
    score = ("trust", "distrust")
    start = seeds.select("host", *(F.col(c) * (1 - damping) for c in score), F.lit(0).cast("bigint").alias("salts")).toDF("host", *score, "salts")
    keys = flows.groupBy("host").agg(F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")).select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"), "salts")
    summed = lambda df: df.groupBy("host").agg(*(F.sum(c).alias(c) for c in score), F.max("salts").alias("salts"))
    under = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda salt: F.getbit("salts", salt) == 1)
    base = cut(summed(start.union(keys)))
    now = base
    for k in range(1, rounds + 1):
        held = now.where("trust > 0 or distrust > 0").select("host", *score, F.explode(under).alias("salt"))
        moved = flows.join(held, ["host", "salt"]).select(F.col("to").alias("host"), (F.col("t") * F.col("trust") * damping).alias("trust"), (F.col("d") * F.col("distrust") * damping).alias("distrust"), F.lit(0).cast("bigint").alias("salts"))
        now = summed(moved.union(base))
        if k % CUT_EVERY == 0:
            now = cut(now)
    return now.where("trust > 0 or distrust > 0").select("host", *score)


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = BLOCK_RATIO) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) for every page.

    A rule's action is final. Of the other pages those on blocked hosts are blocked. Seeds are the hosts with
    pages that rules judge: trusted by the share of allowed ones among them, distrusted by that of blocked
    ones. A host whose distrust is just ``ratio`` times its trust is blocked. Pages without a host, and hosts that
    nothing speaks against, are allowed; null and repeated ids are judged by their address alone, page by page.
    Links are taken from whole pages of any length; a null page has none. Other columns, whatever their names, are
    not read, and an empty table gives an empty one.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), F.col(html_col).cast("string").alias("html"))
    rows = with_rules(rows, rules)
    judged = rows.where("host <> ''").groupBy("host").agg(F.count_if(F.col("fit.action") == ALLOW).alias("a"), F.count_if(F.col("fit.action") == BLOCK).alias("b"))
    share = lambda c: F.when(F.col("a") + F.col("b") > 0, F.col(c) / (F.col("a") + F.col("b"))).otherwise(F.lit(0.0))
    scores = spread(host_edges(rows.select("host", "html")), judged.select("host", share("a").alias("trust"), share("b").alias("distrust")))
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= F.col("trust") * ratio)
    plain = rows.select(id_col, "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.action").alias("action"))
    joined = plain.join(scores, "host", "left")
    return joined.select(id_col, "host", "path", "rule", F.coalesce("action", F.when(bad, BLOCK), F.lit(ALLOW)).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
