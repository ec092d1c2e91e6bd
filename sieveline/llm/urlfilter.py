"""URL filters: rules indexed by their rarest literal token, in DataFrame operations alone.

A rule is a regular expression over ``host + path`` with tokens (runs of a-z and 0-9) that every
match holds whole. How often a token occurs is counted over the distinct URLs, each rule is filed
under its rarest token, and a URL tries only the rules filed under one of its own tokens. Host rules
fit a host and its subdomains where the path starts with theirs; the longest wins and goes before
any pattern rule. A URL that no rule fits is allowed.

Every distinct URL is judged once, so a URL that fills a third of the rows costs what any other does.
The rule table joins by token and is as large as the rules are; the optimizer measures it.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the
path follows up to ``?``, ``#`` or the end. A null URL or one without ``://`` has empty host and path.
Repeated rows stay repeated, ids may be null, and other columns are ignored.
"""

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "rule string, verdict string, pattern string, tokens array<string>, rank int"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def host_rule(host: str, path: str, verdict: str) -> tuple:
    """A rule for a host, its subdomains, and the paths that start with ``path``."""
    # Only the end of a path may fall inside a longer token.
    whole = re.findall(r"[a-z0-9]+", host) + re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())
    end = re.escape(path) if path else "(?=/|$)"
    return (f"{host}{path}", verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{end}", sorted(set(whole)), len(host + path))


def pattern_rule(name: str, pattern: str, tokens: list[str], verdict: str = "block") -> tuple:
    """A rule of any pattern; ``tokens`` must stand whole in whatever it matches."""
    return (name, verdict, pattern, sorted(set(tokens)), 0)


def word_rule(word: str) -> tuple:
    """Blocks URLs that hold a word as a token of its own."""
    return pattern_rule(word, rf"(?i)(?:^|[^a-z0-9]){word}(?:[^a-z0-9]|$)", [word])


HOST_RULES = (
    host_rule("com", "/", "allow"),
    host_rule("example.com", "/en/", "block"),
    host_rule("www.example.com", "/en/", "allow"),
    host_rule("net", "/es/", "block"),
    host_rule("net", "/fr/", "block"),
)
PATTERN_RULES = (
    pattern_rule("spam-farm", r"^(?:[^/]*\.)?spam-farm\.", ["spam", "farm"]),
    pattern_rule("link-farm", r"^(?:[^/]*\.)?link-farm\.", ["link", "farm"]),
    *(word_rule(w) for w in ("casino", "porn", "viagra", "xxx")),
)


def rule_table(spark: SparkSession, rules: tuple) -> DataFrame:
    """Rules as a table; a large list of rules comes as a table with the same columns instead."""
    columns = ["rule", "verdict", "pattern"]
    structs = [
        F.struct(
            *[F.lit(v).alias(c) for c, v in zip(columns, r)],
            F.array(*[F.lit(t) for t in r[3]]).cast("array<string>").alias("tokens"),
            F.lit(r[4]).alias("rank"),
        )
        for r in rules
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _tokens(subject: Column) -> Column:
    parts = F.split(lower_ascii(subject), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def indexed(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """The rules with ``token``, the rarest of theirs in the column ``token`` of ``tokens``."""
    spread = rules.select("*", F.explode("tokens").alias("token"))
    wanted = spread.select("token").distinct()
    counts = tokens.join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = spread.join(counts, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.col("token")))
    keys = ["rule", "verdict", "pattern", "rank"]
    return ranked.groupBy(*keys).agg(rarest.alias("token"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (of the host rule that won, else null), pattern_rule, verdict of every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    urls = rows.select("url").distinct()
    subjects = urls.select("url", F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("subject"))
    tokens = subjects.select("url", "subject", F.explode(_tokens(F.col("subject"))).alias("token"))
    candidates = tokens.join(indexed(rules, tokens.select("token")), "token")
    fits = candidates.where(F.expr("subject rlike pattern"))
    best = fits.groupBy("url").agg(
        F.max(F.when(F.col("rank") > 0, F.struct("rank", "rule", "verdict"))).alias("host_rule"),
        F.max(F.when(F.col("rank") == 0, F.struct("verdict", "rule"))).alias("other"),
    )
    return rows.join(best, "url", "left").select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("host_rule.rule").alias("rule"),
        F.col("other.rule").alias("pattern_rule"),
        F.coalesce("host_rule.verdict", "other.verdict", F.lit("allow")).alias("verdict"),
    )
