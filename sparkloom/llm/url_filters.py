"""URL filters: rules first, then a path-template tree of each host.

Paths become templates level by level: segments that are ids by their shape,
segments of a place with many children that hardly repeat, and siblings with
enough labels whose share of bad pages is statistically alike all turn into a
wildcard; a sibling with few labels stays as it is.  A
template is blocked if its purity, the labelled share of good pages smoothed
towards its host's and that towards all pages', is too low.  DataFrame functions
only; joins on a host are salted, and everything but the first and the last
step runs over the distinct paths, not the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A place whose children are this many and come up less often than REPEATS each
#: is variable: those of its children that do come up less often and whose bad
#: share is like the place's become a wildcard.
CHILDREN, REPEATS = 8, 4
#: Standard errors within which a child's bad share is like its siblings', and the
#: labelled pages it must have for that to say anything.
ALIKE, EVIDENCE = 2.0, 5
#: Pages of the prior that smooths a purity, and the purity a template needs.
PRIOR, PURITY = 5.0, 0.5
SALT = 16

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
#: Shapes of ids: digits with or without an ending, long hexadecimal words.
DIGITS, ENDED, HEX = "^[0-9]+$", r"^[0-9]+(\.[A-Za-z0-9]+)$", "^[0-9a-fA-F-]*[0-9][0-9a-fA-F-]*$"


def host_of(url: Column) -> Column:
    """From the first :// to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest (verdict, rule) that fits as struct(verdict, rule), else null.
    A rule is host/path: it fits its host and subdomains where the path starts
    with its own."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + start))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """The segments of a path with ids as wildcards."""

    def shaped(s):
        return F.when(s.rlike(DIGITS), "*").when(s.rlike(ENDED), F.concat(F.lit("*"), F.regexp_extract(s, ENDED, 1))).when((F.length(s) >= 8) & s.rlike(HEX), "*").otherwise(s)

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shaped)


def _salted(left: DataFrame, right: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """An inner join whose hot keys are spread over SALT tasks; ``right`` has few
    rows of a key."""
    left = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALT).cast("long")))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def templates(paths: DataFrame) -> DataFrame:
    """``paths`` (host, path_key, segs, n, labelled, bad: a row for each distinct
    host and segs) with ``template``.

    A round judges one level.  Paths that end, and those of a place below which all
    are one path, are done: nothing can merge there.  So the rounds are as many as the
    segments that two different paths share, however long one path is.
    """
    done, level, rest = [], 0, paths
    whole = [F.xxhash64("segs"), F.xxhash64(F.lit(1), "segs")]
    while not rest.isEmpty():
        level += 1
        done.append(rest.where(F.size("segs") < level))
        here = rest.where(F.size("segs") >= level).withColumn("prefix", F.array_join(F.slice("segs", 1, level - 1), "/")).withColumn("child", F.element_at("segs", level))
        ends = [f(h).alias(f"{f.__name__}{i}") for i, h in enumerate(whole) for f in (F.min, F.max)]
        child = here.groupBy("host", "prefix", "child").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), *ends)
        one = (F.min("min0") == F.max("max0")) & (F.min("min1") == F.max("max1"))
        place = child.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("all_n"), ((F.sum("bad") + 1.0) / (F.sum("labelled") + 2.0)).alias("share"), one.alias("one"))
        judged = _salted(child, place.where("not one"), ["host", "prefix"], F.col("child"))
        judged = judged.withColumn("close", F.expr(f"abs(bad - labelled * share) <= {ALIKE} * sqrt(labelled * share * (1 - share)) + 1e-9"))
        judged = judged.withColumn("variable", F.expr(f"children >= {CHILDREN} and all_n < {REPEATS} * children and n < {REPEATS} and close"))
        judged = judged.withColumn("alike", F.expr(f"close and labelled >= {EVIDENCE}"))
        judged = written(judged.select("host", "prefix", "child", "variable", "alike"), "judged")
        pairs = judged.groupBy("host", "prefix").agg(F.count_if("alike").alias("alikes"))
        merged = _salted(judged, pairs, ["host", "prefix"], F.col("child")).select("host", "prefix", "child", F.expr("variable or (alike and alikes >= 2)").alias("wild"))
        wild = F.expr(f"transform(segs, (s, i) -> case when i = {level - 1} and wild then '*' else s end)")
        # Children of places that are done have no row in ``merged``.
        both = written(here.join(merged, ["host", "prefix", "child"], "left").withColumn("segs", F.when(F.col("wild"), wild).otherwise(F.col("segs"))).drop("prefix", "child"), "paths")
        done.append(both.where("wild is null").drop("wild"))
        rest = both.where("wild is not null").drop("wild")
    out = rest
    for ended in done:
        out = out.unionByName(ended)
    return out.withColumn("template", F.concat(F.lit("/"), F.array_join("segs", "/")))


def judged_urls(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame, purity: float = PURITY, prior: float = PRIOR) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for each row of
    ``pages`` (page_id, url); ``labels`` (page_id, bad 0 or 1) judge some.

    verdict: the longest fitting rule's, else block where the template's purity
    is below ``purity``, else allow.  Null urls and urls without :// have an empty
    host and path, which make a host of their own.  Repeated pages come back as
    often as they are given; of repeated labels the worst counts.  Without
    labels every purity is 0.5 and nothing is blocked but by rules.
    """
    known = labels.select(F.col("page_id").alias("_page"), F.col("bad").cast("int").alias("bad")).dropna().groupBy("_page").agg(F.max("bad").alias("bad"))
    urls = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    urls = urls.withColumn("segs", segments(F.col("path"))).withColumn("path_key", F.array_join("segs", "/"))
    counted = urls.join(known, urls["page_id"] == known["_page"], "left")
    paths = counted.groupBy("host", "path_key").agg(F.first("segs").alias("segs"), F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = templates(written(paths, "paths"))
    of_template = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    of_host = tree.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    of_all = tree.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2.0)).alias("share"))
    scored = _salted(of_template, of_host, ["host"], F.col("template")).join(F.broadcast(of_all))  # one row
    smooth = f"(host_bad + {prior} * share) / (host_labelled + {prior})"
    scored = scored.select("host", "template", F.expr(f"1 - (bad + {prior} * ({smooth})) / (labelled + {prior})").alias("purity"))
    tree = tree.select("host", "path_key", "template").join(scored, ["host", "template"])
    out = _salted(urls, written(tree, "tree"), ["host", "path_key"], F.col("page_id"))
    found = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumn("_rule", found)
    method = F.when(F.col("purity") < purity, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"), "template", "purity")
