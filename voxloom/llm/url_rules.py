"""URL filtering by association rules.

Given rules label the pages they fit. FP-growth over the tokens of labelled URLs finds combinations
of tokens that go with a label; rules with enough support and confidence, none of whose parts says
as much already, are kept. Tokens that are on the same labelled URLs form a class, of which one is
mined for all, so the combinations don't multiply. Rules are matched by an inverted index over all
members of the classes: a URL's tokens are joined with the rules', and a rule holds if each of its classes has
a member there, as if every combination of members were a rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.scratch import saved

#: (verdict, host, path) of the given rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Least share of labelled URLs, least confidence.
SUPPORT, CONFIDENCE = 0.005, 0.8
#: Rows of the rules' index up to which it is broadcast; beyond it, they are joined by a shuffle.
BROADCAST_RULES = 20_000
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER)
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits, else null. Equally long ones: the first listed."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def query_of(url: Column) -> Column:
    """The query string of a URL, without ``?``; empty where there is none, without ``://`` or for null."""
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return F.regexp_extract(after, r"^[^?#]*\?([^#]*)", 1)


def url_tokens(host: Column, path: Column, query: Column | None = None) -> Column:
    """Distinct tokens: the host's labels and suffixes, all path segments and the keys of the query; digits in a segment or key count as 0."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, n - k + 1, k), ".")))
    plain = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.regexp_replace(x, "[0-9]+", "0")))
    segments = plain("seg:", F.split(path, "/"))
    keys = plain("query:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))) if query is not None else F.array().cast("array<string>")
    name = F.transform(labels, lambda x: F.concat(F.lit("label:"), x))
    return F.array_distinct(F.concat(F.when(n > 0, suffixes).otherwise(F.array().cast("array<string>")), name, segments, keys))


def one_of_equals(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (tokens, verdict) with one token, the first in code-point order, for each class of tokens on the same rows; and (kept, token) of the classes."""
    rows = labelled.withColumn("row", F.monotonically_increasing_id())
    rows = saved(rows, "url-labelled")
    each = rows.select(F.explode("tokens").alias("token"), F.xxhash64("row").alias("h"), F.xxhash64("row", F.lit(1)).alias("g"))
    marks = saved(each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g")), "url-marks")
    first = marks.groupBy("n", "h", "g").agg(F.min("token").alias("kept"))
    classes = saved(marks.join(first.hint("merge"), ["n", "h", "g"]).select("kept", "token"), "url-classes")
    kept = rows.select("row", F.explode("tokens").alias("token")).join(first.select(F.col("kept").alias("token")).hint("merge"), "token")
    # A URL's tokens, so no more than its text.
    tokens = kept.groupBy("row").agg(F.array_sort(F.collect_list("token")).alias("kept"))
    return rows.join(tokens.hint("merge"), "row", "left").select(F.coalesce("kept", F.array().cast("array<string>")).alias("tokens"), "verdict"), classes


def mine_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(left array<string>, verdict, confidence, support) from rows (tokens, verdict).

    All combinations with the support are rules if their confidence is enough. A rule is pruned if a
    rule for the same verdict on a part of its tokens is at least as confident.
    """
    baskets = labelled.select(F.array_union("tokens", F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
    n = baskets.count()
    found = FPGrowth(itemsCol="items", minSupport=support).fit(baskets).freqItemsets
    mark = F.filter("items", lambda x: x.startswith("verdict:"))
    sets = found.select(F.array_sort(F.filter("items", lambda x: ~x.startswith("verdict:"))).alias("left"), F.substring(F.get(mark, F.lit(0)), 9, 99).alias("verdict"), "freq").where("size(left) > 0")
    sets = saved(sets, "url-sets")
    whole = sets.where("verdict is null").select("left", F.col("freq").alias("all"))
    rules = sets.where("verdict is not null").join(whole.hint("merge"), "left")
    rules = saved(rules.select("left", "verdict", (F.col("freq") / F.col("all")).alias("confidence"), (F.col("freq") / F.lit(max(1, n))).alias("support")), "url-rules")
    # By size: the best confidence among a rule's parts is that of its parts without one token, or of theirs.
    sizes = [r["k"] for r in rules.select(F.size("left").alias("k")).distinct().orderBy("k").collect()]
    best, kept = None, []
    for k in sizes:
        own = rules.where(F.size("left") == k)
        if best is not None:
            part = own.select("left", "verdict", F.explode(F.transform("left", lambda x: F.array_except("left", F.array(x)))).alias("part"))
            theirs = part.join(best.withColumnRenamed("left", "part").hint("merge"), ["part", "verdict"]).groupBy("left", "verdict").agg(F.max("best").alias("theirs"))
            own = own.join(theirs.hint("merge"), ["left", "verdict"], "left")
        else:
            own = own.withColumn("theirs", F.lit(None).cast("double"))
        own = saved(own, "url-rules")
        kept.append(own.where((F.col("confidence") >= confidence) & (F.col("theirs").isNull() | (F.col("theirs") < F.col("confidence")))).drop("theirs"))
        best = own.select("left", "verdict", F.greatest("confidence", F.coalesce("theirs", F.lit(0.0))).alias("best"))
    return reduce(DataFrame.unionAll, kept) if kept else rules


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict, mined of each page.

    The verdict is that of the longest given rule; else that of the most confident mined rule, then
    the best supported, then the first by its tokens; else ``default``. Null, empty and malformed
    URLs have no host and get the default. Rows that repeat an id are judged each; long URLs are read
    whole. If no page, or pages of one verdict only, are labelled, mined rules say what those pages
    support. Other columns are ignored; an empty table gives an empty result.
    """
    url = F.col(f"`{url_col}`")
    host, path = host_and_path(url)
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"), query_of(url).alias("query"))
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("given", verdict)
    rows = saved(rows, "url-rows")
    tokens = url_tokens(F.col("host"), F.col("path"), F.col("query"))
    labelled, classes = one_of_equals(rows.where("given is not null").select(tokens.alias("tokens"), F.col("given").alias("verdict")))
    if labelled.isEmpty():
        return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", F.lit(default)).alias("verdict"), F.lit(None).cast("array<string>").alias("mined"))
    mined = saved(mine_rules(labelled), "url-mined")
    parts = mined.withColumn("need", F.size("left")).withColumn("kept", F.explode("left"))
    index = saved(parts.join(classes.hint("merge"), "kept"), "url-index")
    if index.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    # URLs with the same tokens are judged once; their count doesn't matter then.
    open_rows = rows.where("given is null").select(tokens.alias("tokens"), "id", "host", "path")
    baskets = open_rows.select("tokens").distinct()
    rule_key = ["tokens", "left", "verdict", "need", "confidence", "support"]
    # Of the members of a class that a URL has, the first stands in its rule.
    members = baskets.withColumn("token", F.explode("tokens")).join(index, "token").groupBy(*rule_key, "kept").agg(F.min("token").alias("member"))
    hits = members.groupBy(*rule_key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("member")).alias("own")).where("n = need")
    best = hits.groupBy("tokens").agg(F.min_by(F.struct("verdict", "own"), F.struct(-F.col("confidence"), -F.col("support"), F.col("own"))).alias("best"))
    judged = open_rows.join(best, "tokens", "left").select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.col("best.own").alias("mined"))
    fixed = rows.where("given is not null").select("id", "host", "path", "rule", F.col("given").alias("verdict"), F.lit(None).cast("array<string>").alias("mined"))
    return fixed.unionAll(judged).withColumnRenamed("id", id_col)
