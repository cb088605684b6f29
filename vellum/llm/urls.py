"""URL filtering by association rules.

Explicit rules come first.  For the URLs they leave open, Spark's FP-growth mines
combinations of URL tokens that go with a label; rules are kept that have enough support,
confidence, and lift over the label's share of all labelled URLs, unless one with fewer
tokens says the same with no less confidence.  Rules are matched by an inverted index:
each is filed under its rarest token, each distinct set of tokens looks up its own
tokens, and the surest rule whose tokens it has decides.

Tokens that occur in the very same labelled URLs are mined as one, so that a long URL
which repeats does not make a pattern of each subset of its tokens.  Whichever of them
stand in a URL, the rule fits it, as it would by the patterns that were not written out.

With a longest rule, rows of many tokens are mined in parts: tokens are dealt into groups,
a row goes to each set of at most that many groups of its tokens, and a part gives the
patterns that have a token in each of its groups.  So each pattern is counted once, over
all rows that hold it, and no part meets a row with more than a few tokens.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import materialise, swept

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Splits a URL at its first ``://``: host, path, query.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
#: (verdict, host, path) of the query's explicit rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def parse(url: Column) -> tuple[Column, Column, Column]:
    """Lower-case host, path and query; all empty without ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2), part(3)


def explicit(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """``struct(rule, verdict)`` of the longest fitting rule, else null.  The list is a
    short parameter; equal lengths go by the longer host, then by order in the list."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(host: Column, path: Column, query: Column) -> Column:
    """Sorted distinct tokens: host labels, path segments (digits as #), query keys."""
    kind = lambda k, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(k), x))
    steps = F.split(F.regexp_replace(F.translate(path, UPPER, LOWER), "[0-9]+", "#"), "[/.]")
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_sort(F.array_distinct(F.concat(kind("h:", F.split(host, r"\.")), kind("p:", steps), kind("q:", keys))))


def classes(labelled: DataFrame, support: float, least: int = 1) -> DataFrame:
    """``token, kind`` of tokens in that share of rows and so many: ``kind`` is the first of the tokens that occur in
    the same rows of ``labelled(tokens, verdict)``, told by their number and by sums over
    them."""
    row = F.xxhash64("tokens", "verdict")
    sets = labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n")).select("tokens", "n", row.alias("r"), F.xxhash64(F.lit(7), "tokens", "verdict").alias("q"))
    seen = sets.select(F.explode("tokens").alias("token"), "n", "r", "q").groupBy("token").agg(F.sum("n").alias("n"), F.bit_xor("r").alias("r"), F.bit_xor("q").alias("q"))
    total = F.broadcast(labelled.agg(F.count("*").alias("total")))  # one row
    common = seen.crossJoin(total).where((F.col("n") >= F.col("total") * support) & (F.col("n") >= least))
    first = common.groupBy("n", "r", "q").agg(F.min("token").alias("kind"))
    return materialise(common.join(first, ["n", "r", "q"]).select("token", "kind"), "token-kinds")


def kinds(sets: DataFrame, known: DataFrame) -> DataFrame:
    """``tokens`` with the sorted distinct ``kinds`` of their frequent tokens."""
    each = sets.select("tokens", F.explode("tokens").alias("token")).join(known, "token")
    return each.groupBy("tokens").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


#: Tokens of a row that are mined together whatever the longest rule, and of a group beyond.
NARROW, GROUP = 12, 3


def parts(tokens: Column, groups: int, longest: int | None) -> Column:
    """The parts a row goes to, each a sorted array of at most ``longest`` groups."""
    own = F.array_sort(F.array_distinct(F.transform(tokens, lambda k: group_of(k, groups))))
    level = F.transform(own, lambda g: F.array(g))
    levels = [level]
    for _ in range(1, min(longest or 1, groups)):
        more = lambda t: F.transform(F.filter(own, lambda g: g > F.element_at(t, -1)), lambda g: F.concat(t, F.array(g)))
        level = F.flatten(F.transform(level, more))
        levels.append(level)
    return F.concat(*levels)


def group_of(token: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(groups)).cast("int")


def frequent_sets(baskets: DataFrame, fewest: int, widest: int, longest: int | None = None) -> DataFrame:
    """``baskets(kinds, verdict)`` to ``kinds, verdict, freq``: each set of at most
    ``longest`` kinds that ``fewest`` rows or more hold, and with each verdict; the verdict
    is null where all rows that hold the set are counted."""
    groups = ceil(widest / GROUP) if longest and widest > NARROW else 1
    name = lambda part: F.array_join(part, ".")
    named = lambda part, item: F.concat(name(part), F.lit(":"), item)
    here = F.filter("kinds", lambda k: F.array_contains("part", group_of(k, groups)))
    items = F.concat(F.transform(here, lambda k: named(F.col("part"), k)), F.array(named(F.col("part"), F.concat(F.lit("y:"), "verdict"))))
    pieces = materialise(baskets.select("kinds", "verdict", F.explode(parts(F.col("kinds"), groups, longest)).alias("part")).select(items.alias("items")), "baskets")
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, min(1.0, (fewest - 0.5) / max(1, pieces.count())))).fit(pieces)
    bare = F.transform("items", lambda x: F.regexp_replace(x, "^[0-9.]*:", ""))
    found = model.freqItemsets.select(bare.alias("items"), F.substring_index(F.col("items")[0], ":", 1).alias("part"), "freq")
    is_label = lambda x: x.startswith("y:")
    sets = found.select(
        F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("kinds"), F.substring(F.get(F.filter("items", is_label), 0), 3, 1 << 20).alias("verdict"), "part", "freq",
    )
    whole = name(F.array_sort(F.array_distinct(F.transform("kinds", lambda k: group_of(k, groups))))) == F.col("part")
    short = F.size("kinds") <= longest if longest else F.lit(True)
    return materialise(sets.where((F.size("kinds") > 0) & short & whole).drop("part"), "frequent-sets")


def wilson(hits: Column, of: Column, z: float = 1.96) -> Column:
    """The lower bound of a share's 95 % interval."""
    p = hits / of
    return (p + z * z / (2 * of) - z * F.sqrt((p * (1 - p) + z * z / (4 * of)) / of)) / (1 + z * z / of)


def mine(labelled: DataFrame, known: DataFrame, support: float = 0.002, confidence: float = 0.7, lift: float = 1.1, least: int = 1, surely: float = 0.0, longest: int | None = None) -> DataFrame:
    """``labelled(tokens, verdict)`` to ``kinds, verdict, confidence, support, pages, rarest``.

    A rule rests on at least ``least`` labelled rows that it is right on.  With ``surely``,
    the lower bound of its confidence is at least that and the label's own share.  Without
    ``longest`` rules may have any number of tokens, of which similar rows make a pattern
    of each subset; with it, time grows with the rows times the sets of so many groups."""
    counted = labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n"))
    of = materialise(kinds(counted.select("tokens").distinct(), known), "kinds")
    none = F.array().cast("array<string>")
    baskets = materialise(labelled.join(of, "tokens", "left").select(F.coalesce("kinds", none).alias("kinds"), "verdict"), "label-baskets")
    total, widest = baskets.agg(F.count("*"), F.max(F.size("kinds"))).first()
    sets = frequent_sets(baskets, max(ceil(total * support), least, 1), widest or 0, longest)
    share = F.broadcast(baskets.groupBy("verdict").agg((F.count("*") / F.lit(total)).alias("share")))  # a row a verdict
    held = sets.where("verdict IS NULL").select("kinds", F.col("freq").alias("held"))
    said = sets.where("verdict IS NOT NULL").join(held, "kinds").join(share, "verdict")
    sure = F.col("freq") / F.col("held")
    rules = said.where((sure >= confidence) & (sure / F.col("share") >= lift)).select("kinds", "verdict", sure.alias("confidence"), (F.col("freq") / F.lit(total)).alias("support"), F.col("freq").alias("pages"), "held", "share")
    if surely:
        rules = rules.where(wilson(F.col("pages"), F.col("held")) >= F.greatest(F.lit(surely), "share"))
    rules = materialise(rules.drop("held", "share"), "rules")
    drop_one = F.explode(F.transform("kinds", lambda x: F.array_remove("kinds", x)))
    shorter = rules.select(F.col("kinds").alias("fewer"), "verdict", F.col("confidence").alias("as_sure"))
    implied = (
        rules.select("kinds", "verdict", "confidence", drop_one.alias("fewer"))
        .join(shorter, ["fewer", "verdict"])
        .where("as_sure >= confidence")
        .select("kinds", "verdict")
        .distinct()
    )
    kept = rules.join(implied, ["kinds", "verdict"], "left_anti")
    single = held.where(F.size("kinds") == 1).select(F.col("kinds")[0].alias("kind"), F.col("held").alias("freq"))
    filed = (
        kept.select("*", F.explode("kinds").alias("kind"))
        .join(single, "kind")
        .groupBy("kinds", "verdict", "confidence", "support", "pages")
        .agg(F.min_by("kind", F.struct("freq", "kind")).alias("rarest"))
    )
    return materialise(filed, "rule-index")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens, kinds`` to ``tokens, mined``: the surest rule, then the one with more
    support, then more tokens; sets that no rule fits are not returned."""
    index = rules.select(F.col("rarest").alias("kind"), F.col("kinds").alias("need"), "verdict", "confidence", "support", "pages")
    best = F.struct("confidence", "support", F.size("need").alias("n"), "verdict", "pages")
    return (
        sets.select("tokens", "kinds", F.explode("kinds").alias("kind"))
        .join(index, "kind")
        .where(F.size(F.array_except("need", "kinds")) == 0)
        .groupBy("tokens")
        .agg(F.max(best).alias("best"))
        .select("tokens", F.col("best.verdict").alias("mined"), F.col("best.pages").alias("pages"))
    )


def judge(pages: DataFrame, rules=RULES, support: float = 0.002, confidence: float = 0.7, lift: float = 1.1, default: str = "allow", labels: DataFrame | None = None, least: int = 1, surely: float = 0.0, longest: int | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, pages: the labelled rows that
    a mined rule which decides is right on, else null.

    The labels that are mined are ``labels(url, verdict)`` or, by default, the verdicts of
    the explicit rules on all pages; URLs that neither a rule nor a mined rule fits get
    ``default``.  Null and scheme-less URLs have an empty host and path.  Rows that repeat
    are judged alike; an empty table, or one without labels, mines no rule.
    """
    host, path, query = parse(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), explicit(host, path, rules).alias("hit"), tokens(host, path, query).alias("tokens"))
    if labels is None:
        seen = rows.where("hit IS NOT NULL").select("tokens", F.col("hit.verdict").alias("verdict"))
    else:
        seen = labels.where("verdict IS NOT NULL").select(tokens(*parse(F.col("url"))).alias("tokens"), "verdict")
    with swept(pages.sparkSession) as keep:
        known = classes(seen, support, least)
        open_sets = kinds(rows.where("hit IS NULL").select("tokens").distinct(), known)
        # written, so that the join's sides are plain shuffles, whose skew is split
        mined = materialise(match(open_sets, mine(seen, known, support, confidence, lift, least, surely, longest)), "mined")
        keep.append(mined)
    return rows.join(mined, "tokens", "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.when(F.col("hit").isNotNull(), F.col("hit.verdict")).otherwise(F.coalesce("mined", F.lit(default))).alias("verdict"), F.when(F.col("hit").isNull(), F.col("pages")).alias("pages"),
    )
