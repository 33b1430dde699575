"""URL filters: a rule list, then association rules that FP-growth in rounds mines from labelled URLs."""

from __future__ import annotations

from functools import reduce
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, stored

#: Rules that may be mined: in this share and this number of labelled URLs at least, counted with their label.
MIN_SUPPORT = 0.002
MIN_COUNT = 5
#: A rule's confidence must be so high that its URLs have this many times the odds of its label among all labelled URLs.
#: To block takes more than to allow, which is the verdict without a rule, too.
BLOCK_ODDS = 4
ALLOW_ODDS = 2
#: An index of this many rows at most is broadcast; a larger one is joined by shuffle.
BROADCAST_RULES = 20_000
BAD, GOOD = "label=bad", "label=good"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as a string, and its verdict; both null if none does. A rule fits its host and all
    subdomains where the path starts with the rule's."""
    none = (F.lit(None).cast("string"),) * 2
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        none = F.when(fits, F.lit(r.host + r.path)).otherwise(none[0]), F.when(fits, F.lit(r.verdict)).otherwise(none[1])
    return none


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The set of a URL's tokens: scheme, host, parent domain, every part of the host, every folder with its depth, file
    name, extension, every query key and pair, fragment. Numbers are identifiers and give none."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)\z", 1), F.lit(""))
    steps = F.split(path, "/", -1)
    query = F.split(F.regexp_extract(rest, r"(?s)^\?([^#]*)", 1), "&", -1)
    one = lambda kind, v: F.array(F.struct(F.lit(kind).alias("k"), v.alias("v")))
    many = lambda kind, found: F.transform(found, lambda x: F.struct(F.lit(kind).alias("k"), x.alias("v")))
    folders = F.slice(steps, 2, F.greatest(F.size(steps) - 2, F.lit(0)))
    every = F.concat(
        one("scheme=", F.regexp_extract(ascii_lower(F.coalesce(url, F.lit(""))), r"(?s)^([a-z0-9+.-]*)://", 1)),
        one("host=", host),
        one("domain=", F.regexp_extract(host, r"([^.]+\.[^.]+)\z", 1)),
        many("part=", F.split(host, "\\.", -1)),
        F.transform(folders, lambda x, i: F.struct(F.concat(F.lit("dir"), (i + 1).cast("string"), F.lit("=")).alias("k"), x.alias("v"))),
        one("file=", F.regexp_replace(F.element_at(steps, -1), r"(?s)\.[^.]*\z", "")),
        one("ext=", F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})\z", 1)),
        many("query=", F.transform(query, lambda x: F.regexp_extract(x, r"(?s)^([^=]*)", 1))),
        many("pair=", F.filter(query, lambda x: x.rlike(r"(?s)=.*[^0-9]"))),
        one("fragment=", F.regexp_extract(rest, r"(#)", 1)),
    )
    named = F.filter(every, lambda x: (x["v"] != "") & ~x["v"].rlike(r"\A[0-9]+\z"))
    return F.array_distinct(F.transform(named, lambda x: F.concat(x["k"], x["v"])))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, block_odds: int = BLOCK_ODDS, allow_odds: int = ALLOW_ODDS) -> DataFrame:
    """``(verdict, parts, confidence, support)`` of each token combination that tells bad or good URLs, from
    ``labelled(tokens, bad)``. A URL fits a rule if it has a token of each of its ``parts``.

    FP-growth: a basket's items stand from the most frequent on, and the baskets that hold a set of items, cut before the
    most frequent of them and counted where they are equal, are the base in which it grows. Tokens that mark the very same
    labelled URLs are one item. A set that marks the same labelled URLs as a part of it is left: its counts are that part's, and
    every URL that it fits, the part fits with the same verdict. All that grows from it is left likewise. So no URL loses
    a verdict, and nested folders give rules by their depth and not by its subsets. Labels of one kind teach nothing.
    """
    labelled = stored(labelled.withColumn("_q_row", F.monotonically_increasing_id()), "labelled")
    n, bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    good = n - bad
    least = max(MIN_COUNT, ceil(min_support * n))
    each = labelled.select("_q_row", "bad", F.explode("tokens").alias("t"))
    rows = F.sum(F.xxhash64("_q_row").cast("decimal(38,0)"))
    marked = each.groupBy("t").agg(F.count("*").alias("n"), rows.alias("s"), F.sum(F.xxhash64("_q_row", F.lit(1)).cast("decimal(38,0)")).alias("z")).where(F.col("n") >= least)
    items = stored(marked.groupBy("n", "s", "z").agg(F.min("t").alias("item"), F.array_sort(F.collect_list("t")).alias("part")).select("n", "item", "part"), "items")
    if not bad or not good or items.isEmpty():
        return labelled.limit(0).select(F.lit("block").alias("verdict"), F.array(F.array(F.lit(""))).alias("parts"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"))
    of = items.select((-F.col("n")).alias("n"), "item", F.explode("part").alias("t"))
    held = each.join(of, "t").groupBy("_q_row", "bad").agg(F.array_sort(F.collect_set(F.struct("n", "item")))["item"].alias("items"))
    none = F.array().cast("array<string>")
    base = held.groupBy(none.alias("ante"), "items").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g"))
    found: list[DataFrame] = []
    while True:
        # Without an item that the baskets hold more often, a set is in no further base.
        grown = stored(base.select("ante", "items", "b", "g", F.posexplode("items").alias("at", "x")), "grown")
        sets = grown.groupBy("ante", "x").agg(F.sum("b").alias("b"), F.sum("g").alias("g")).where(F.greatest("b", "g") >= least)
        sets = sets.withColumn("set", F.array_append("ante", F.col("x")))
        if found:
            parts = sets.select("set", (F.col("b") + F.col("g")).alias("n"), F.explode(F.transform("set", lambda x: F.array_remove("set", x))).alias("less"))
            fewer = found[-1].select(F.col("set").alias("less"), (F.col("b") + F.col("g")).alias("less_n"))
            whole = parts.join(fewer, "less").where("less_n > n").groupBy("set").count().where(F.col("count") == F.size("set"))
            sets = sets.join(whole.select("set"), "set")
        sets = stored(sets.select("ante", "x", "set", "b", "g"), "sets")
        if sets.isEmpty():
            break
        found.append(sets)
        cut = grown.where("at > 0").join(sets.select("ante", "x", "set"), ["ante", "x"])
        base = cut.groupBy(F.col("set").alias("ante"), F.slice("items", 1, F.col("at")).alias("items")).agg(F.sum("b").alias("b"), F.sum("g").alias("g"))
    if not found:
        return labelled.limit(0).select(F.lit("block").alias("verdict"), F.array(F.array(F.lit(""))).alias("parts"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"))
    every = reduce(DataFrame.union, [x.select("set", "b", "g") for x in found])
    told = lambda verdict, own, other, fits: F.when((F.col(own) >= least) & fits, F.struct(F.lit(verdict).alias("verdict"), F.col(own).alias("have"), F.col(other).alias("not_have")))
    b, g = F.col("b"), F.col("g")
    both = F.array(told("block", "b", "g", b * good >= block_odds * g * bad), told("allow", "g", "b", g * bad >= allow_odds * b * good))
    rules = every.select("set", F.inline(F.filter(both, lambda x: x.isNotNull())))
    rules = rules.select("verdict", "set", (F.col("have") / (F.col("have") + F.col("not_have"))).alias("confidence"), (F.col("have") / n).alias("support"))
    parts = rules.select("*", F.explode("set").alias("item")).join(items.select("item", "part"), "item")
    return parts.groupBy("verdict", "set", "confidence", "support").agg(F.array_sort(F.collect_list("part")).alias("parts")).select("verdict", "parts", "confidence", "support")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Token sets of the pages whose document has a quality label. The number that ends the url's path is the doc_id: the
    html of such pages holds that document's text."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    number = F.expr("try_cast(regexp_extract(_q_path, '/([0-9]+)(/|[.][a-z]+)?\\\\z', 1) as bigint)")
    urls = pages.select(tokens(F.col("url"), host, path).alias("tokens"), path.alias("_q_path")).select("tokens", number.alias("doc_id"))
    known = labels.where("quality is not null").groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("bad"))
    return urls.where("doc_id is not null").join(known, "doc_id").select("tokens", "bad")


def indexed(rules: DataFrame) -> DataFrame:
    """The inverted index ``(_q_t, _q_verdict, _q_parts)``: each rule under the tokens of its rarest part, that is the one
    of fewest rules."""
    numbered = rules.select("verdict", "parts", F.xxhash64("verdict", "parts").alias("rule"), F.explode("parts").alias("part"))
    use = numbered.groupBy("part").agg(F.count("*").alias("n"))
    rarest = numbered.join(use, "part").groupBy("rule", "verdict", "parts").agg(F.min_by("part", F.struct("n", "part")).alias("part"))
    return rarest.select(F.explode("part").alias("_q_t"), F.col("verdict").alias("_q_verdict"), F.col("parts").alias("_q_parts"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, min_support: float = MIN_SUPPORT, block_odds: int = BLOCK_ODDS, allow_odds: int = ALLOW_ODDS) -> DataFrame:
    """Every row of ``pages`` as ``page_id, host, path, rule, verdict, mined``.

    The rule list decides where it fits. Elsewhere a url is blocked if a mined rule of bad URLs fits it, and allowed if
    not; ``mined`` is 'block' if such a rule fits, 'allow' if only rules of good URLs do, else null. Mined rules stand
    in an inverted index; a url's tokens are looked up in it and the rest of the rule is then checked.

    A url that is null or has no ``://`` has empty host and path, no tokens and is allowed; a url of any length is
    parsed whole. Labels that are null are none, and a doc_id labelled twice counts by its mean (0.5 is good); without
    labels of both kinds, or an empty table of them, nothing is mined. Repeated rows are judged one by one; of listed
    rules of equal length that fit, the verdict that sorts last wins. An empty table of pages gives an empty result.
    Columns other than page_id and url are ignored, whatever their names.
    """
    index = stored(indexed(stored(mine(labelled_urls(pages, labels), min_support, block_odds, allow_odds), "rules")), "index")
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", F.col("url").alias("_q_url"), host.alias("host"), path.alias("path")).withColumn("_q_row", F.monotonically_increasing_id())
    looked = rows.withColumn("_q_tokens", tokens(F.col("_q_url"), F.col("host"), F.col("path")))
    looked = looked.withColumn("_q_t", F.explode_outer("_q_tokens")).join(index, "_q_t", "left")
    fits = F.forall("_q_parts", lambda part: F.arrays_overlap(part, F.col("_q_tokens")))
    # 'block' sorts after 'allow'
    judged = looked.groupBy("_q_row", "page_id", "host", "path").agg(F.max(F.when(fits, F.col("_q_verdict"))).alias("mined"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.col("mined"), F.lit("allow"))})
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined")
