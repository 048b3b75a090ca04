"""URL filters: longest matching host rules, and association rules mined from labels.

A stated rule names a host suffix and the beginning of a path; the longest one that
fits decides. Every other url is judged by token combinations: Spark's FP-growth mines
labelled urls for sets of tokens that go with a bad label, rules below the least
support and confidence are pruned, and a url is blocked if it holds all tokens of one.
Nothing else is pruned but rules of more than LONGEST tokens that hold all tokens of
another rule: whatever they block, that one blocks. In particular the lift counts for
nothing, so rules are found however large the share of bad labels is.

Rules are found through an inverted index on their rarest token: urls send only tokens
that index a rule, so that frequent ones ("https", "com") meet no rule by themselves.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordina.session import written

# Fixed values: (verdict, host, beginning of the path).
STATED = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BAD = "label=bad"
LEAST_SUPPORT = 0.002
LEAST_CONFIDENCE = 0.8
LEAST_LIFT = 2.0  # no rule is held to it; tests name it
SALTS = 32
LONGEST = 4  # tokens of rules that stay even if a shorter one says the same


def host_of(url: Column) -> Column:
    """Between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def stated_rule(host: Column, path: Column, stated=STATED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, by length of its text; null if none fits."""
    fits, verdict = None, None
    for kind, name, start in sorted(stated, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        on = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, says = F.lit(name + start), F.lit(kind)
        fits = F.when(on, rule) if fits is None else fits.when(on, rule)
        verdict = F.when(on, says) if verdict is None else verdict.when(on, says)
    return fits, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens: the scheme, host labels, path words and query names, each marked with its part.

    Numbers become `#`, so that urls that differ by a number share their tokens.
    """
    plain = F.lower(F.coalesce(url, F.lit("")))
    parts = {
        "s": F.regexp_extract(plain, r"(?s)^(.*?)://", 1),
        "h": host_of(url),
        "p": path_of(F.lower(url)),
        "q": F.regexp_replace(F.regexp_extract(plain, r"(?s)\?([^#]*)", 1), "=[^&]*", ""),
        "f": F.regexp_extract(plain, r"(?s)#(.*)$", 1),
    }
    def marked(part: str, text: Column) -> Column:
        words = F.split(F.regexp_replace(text, "[0-9]+", "#"), "[^\\p{L}#]+")
        return F.transform(F.filter(words, lambda t: t != ""), lambda t: F.concat(F.lit(f"{part}:"), t))

    found = [marked(part, text) for part, text in parts.items()]
    return F.array_distinct(F.concat(*found))


def mine(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(rule_id, tokens, support, confidence): token sets that go with a bad label.

    `labels` (page_id, bad) covers some pages; repeated ids count as bad if any row does.
    Sets have at least LEAST_SUPPORT of the labelled pages and LEAST_CONFIDENCE; one of
    more than LONGEST tokens is left out only if another set is a part of it.
    """
    known = labels.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = pages.select("page_id", tokens_of(F.col("url")).alias("tokens")).join(known, "page_id")
    items = F.when(F.col("bad"), F.array_union("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens"))
    model = FPGrowth(itemsCol="items", minSupport=LEAST_SUPPORT, minConfidence=LEAST_CONFIDENCE).fit(rows.select(items.alias("items")))
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), "support", "confidence")
    rules = written(rules.withColumn("rule_id", F.xxhash64(F.concat_ws(" ", "tokens"))), "rules")
    long = F.size("tokens") > LONGEST
    # A part of a long rule that is itself long and left out has a part that stays.
    index = rules.select(F.col("tokens").alias("part"), F.col("tokens")[0].alias("token"))
    entry = rules.where(long).select("rule_id", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    implied = entry.where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0))
    return rules.join(implied.select("rule_id").distinct(), "rule_id", "left_anti").select("tokens", "support", "confidence", "rule_id")


def matches(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_key, rule_id) for each of `pages` (page_key, tokens) and the least rule it satisfies."""
    used = rules.select(F.explode("tokens").alias("token")).distinct()
    rows = pages.select("page_key", F.explode("tokens").alias("token")).join(used, "token", "left_semi")
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    listed = rules.select("rule_id", "tokens", F.explode("tokens").alias("token")).join(often, "token")
    # A rule with a token that no url has matches nothing and needs no entry.
    index = listed.groupBy("rule_id").agg(F.min(F.struct("n", "token")).alias("m"), F.first("tokens").alias("needed"))
    index = index.select("rule_id", "needed", F.col("m.token").alias("token"))
    entry = pages.select("page_key", "tokens", F.explode("tokens").alias("token"))
    found = entry.join(index, "token").where(F.size(F.array_except("needed", "tokens")) == 0)
    return found.groupBy("page_key").agg(F.min("rule_id").alias("rule_id"))


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) for each row of `pages` (page_id, url).

    `rule` is the stated rule, else null; then `mined` holds the tokens of the mined rule
    that blocks the url, and a url without one is allowed. A null url, or one without
    `://`, has an empty host and path and no mined rule. Rows with equal or null ids
    stay rows: urls, not ids, are matched. Without labels nothing is mined. Other
    columns are ignored; an empty table gives no rows.
    """
    url = F.col("url")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = stated_rule(F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("stated"))
    rules = mine(pages, labels)
    tokens = F.when(F.col("rule").isNull() & url.contains("://"), tokens_of(url))
    rows = rows.withColumn("tokens", tokens)
    shapes = rows.where("tokens IS NOT NULL").select("tokens").withColumn("page_key", F.xxhash64("tokens"))
    shapes = shapes.groupBy("page_key").agg(F.first("tokens").alias("tokens"))
    hits = matches(shapes, rules).join(rules.select("rule_id", F.concat_ws(" ", "tokens").alias("mined")), "rule_id")
    # Many urls have one shape, and all with a stated rule have none: both are dealt out.
    hits = hits.select("page_key", "mined", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("page_key", F.when(F.col("tokens").isNotNull(), F.xxhash64("tokens")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    rows = rows.withColumn("page_key", F.coalesce("page_key", F.xxhash64("page_id", "url", F.lit("none"))))
    out = rows.join(hits, ["page_key", "salt"], "left")
    return out.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("stated", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "mined",
    )
