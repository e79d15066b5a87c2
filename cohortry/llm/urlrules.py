"""URL filter rules, indexed by their rarest literal token.

A rule is a pattern with literal tokens. Each rule is filed under the one of its literal tokens that the fewest URLs hold; a URL's
tokens fetch candidate rules by an equi-join, and only those candidates run their regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii


@dataclass(frozen=True)
class Rule:
    """`name` is host plus path for a site rule (fits the host, its subdomains and every path that starts so). A word rule has
    no slash: it fits an address that holds the word as a whole token."""

    action: str
    name: str

    @property
    def site(self) -> bool:
        return "/" in self.name

    def regex(self) -> str:
        if self.site:
            host, _, path = self.name.partition("/")
            return rf"^([^/]*\.)?{re.escape(host.lower())}/{re.escape(path)}"
        return rf"(^|[^A-Za-z0-9])(?i:{re.escape(self.name)})([^A-Za-z0-9]|$)"

    def literals(self) -> list[str]:
        """Tokens that every fitting address holds whole. The last token of a path that has no closing slash may go on."""
        words = re.findall(r"[a-z0-9]+", self.name.lower())
        return words[:-1] if self.site and re.search(r"[A-Za-z0-9]$", self.name) else words


#: The site rules of the query, then word rules that judge the rest.
SITE_RULES = (
    Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/"),
)
WORD_RULES = tuple(Rule("block", w) for w in ("adserver", "banner", "casino", "doubleclick", "malware", "phishing", "poker", "porn", "torrent", "viagra", "xxx"))


def address(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to / ? # or the end, A-Z lowered; path from there up to ? or #. Else both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def judge(pages: DataFrame, rules: Sequence[Rule] = SITE_RULES + WORD_RULES, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, rule, verdict, word.

    The longest fitting site rule decides (`rule` names it); without one, a fitting word rule blocks or allows (`word` names it; block
    wins over allow, then the first word), else `default`. Null urls and urls without :// have an empty address and get the default. Repeated rows give repeated rows.
    Equal urls are judged once. Rules live in the driver's program, so the rule index is as small as that list and not a function of the pages.
    """
    spark = pages.sparkSession
    page = pages.select(F.col(key).alias(key), F.col(url).alias("_url"))
    host, path = address(F.col("_url"))
    addresses = page.select("_url").distinct().select("_url", F.concat(host, path).alias("_address"))
    tokens = addresses.select("_url", "_address", F.explode(F.array_distinct(F.split(lower_ascii(F.col("_address")), "[^a-z0-9]+"))).alias("_token"))
    literals = {r: r.literals() for r in rules}
    if any(not v for v in literals.values()):
        raise ValueError("each rule needs a whole literal token: " + ", ".join(r.name for r, v in literals.items() if not v))
    known = sorted({t for v in literals.values() for t in v})
    count = {} if not known else {r["_token"]: r["n"] for r in tokens.filter(F.col("_token").isin(known)).groupBy("_token").agg(F.count("*").alias("n")).collect()}
    filed = [(min(v, key=lambda t: (count.get(t, 0), t)), r.name, r.action, r.site, r.regex(), len(r.name)) for r, v in literals.items()]
    index = spark.createDataFrame(filed, "_token string, _rule string, _action string, _site boolean, _regex string, _length int")
    index = F.broadcast(index) if len(filed) <= 10_000 else index
    fits = tokens.join(index, "_token").filter(F.expr("_address rlike _regex"))
    best = fits.groupBy("_url").agg(
        F.max(F.when(F.col("_site"), F.struct("_length", "_rule", "_action"))).alias("_best"),
        F.min(F.when(~F.col("_site"), F.struct((F.col("_action") != "block").alias("_allow"), "_rule", "_action"))).alias("_word"),
    )
    return page.join(best, "_url", "left").select(
        key, host.alias("host"), path.alias("path"), F.col("_best._rule").alias("rule"),
        F.coalesce(F.col("_best._action"), F.col("_word._action"), F.lit(default)).alias("verdict"),
        F.when(F.col("_best").isNull(), F.col("_word._rule")).alias("word"),
    )


def oracle(rules: Sequence[Rule] = SITE_RULES + WORD_RULES) -> str:
    """Every rule against every page: the plain form of `judge`, for DuckDB."""
    sites = ", ".join(f"('{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}', '{r.name}', '{r.action}')" for r in rules if r.site)
    words = ", ".join(f"('{r.name}')" for r in rules if not r.site)
    return f"""
with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from a),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
r as (select * from (values {sites}) as t(rule_host, rule_path, rule, action)),
s as (select p.*, (select arg_max(struct_pack(rule := r.rule, action := r.action), length(r.rule)) from r
                   where (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host)) and starts_with(p.path, r.rule_path)) as best,
      (select min(w) from (values {words}) as t(w) where regexp_matches(p.host || p.path, '(^|[^A-Za-z0-9])' || w || '([^A-Za-z0-9]|$)', 'i')) as hit from p)
select page_id, host, path, best.rule as rule, case when best is not null then best.action when hit is not null then 'block' else 'allow' end as verdict,
       case when best is null then hit end as word from s"""
