"""URL filters: allow-list and robots rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.text import let
from offerloom.functions.urls import DEFAULT_SUFFIXES, add_domain
from offerloom.plans.checkpoints import materialize
from offerloom.plans.joins import lookup_join

# Hosts with more rules than this are matched by joining path prefixes.
RULES_PER_ROW = 1_000


def allowed_semi(
    df: DataFrame,
    allowed: DataFrame,
    url: str = "url",
    domain: str | None = None,
    suffixes: Sequence[str] = DEFAULT_SUFFIXES,
    costly: bool = False,
) -> DataFrame:
    """Rows whose URL has a registered domain on the allow-list; ``costly`` as in ``lookup_join``."""
    if domain is None:
        return allowed_semi(add_domain(df, url, "_domain", suffixes), allowed, url, "_domain", costly=costly).drop("_domain")
    listed = allowed.select(F.col("domain").alias(domain)).distinct()
    return lookup_join(df, listed, [domain], "left_semi", costly).select(*df.columns)


def _authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"\A[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))


def _unquoted(text: Column) -> Column:
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.when(text.contains("%"), F.coalesce(decoded, text)).otherwise(text)


def _target(url: Column) -> Column:
    """Path, query and fragment of a URL, unquoted; ``/`` if there is none of them."""
    target = F.regexp_extract(url, r"(?s)\A[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(.*)", 1)
    return let(target, lambda t: F.when(t == "", F.lit("/")).otherwise(_unquoted(t)))


def rules_for_agent(rules: DataFrame, agent: str) -> DataFrame:
    """Per host, the rules of the first section naming the agent, else of ``*``."""
    name = F.lit(agent.split("/")[0].lower())
    is_default = F.col("agent") == "*"
    fitting = rules.filter(is_default | name.contains(F.lower("agent")))
    section = fitting.groupBy("host").agg(F.min(F.struct(is_default, "rule_no", "agent"))["agent"].alias("agent"))
    chosen = lookup_join(fitting, section, ["host", "agent"], "left_semi")
    # An empty path in a rule forbids nothing.
    return chosen.select("host", "rule_no", _unquoted(F.col("path")).alias("path"), ((F.col("path") == "") | F.col("allow")).alias("allow"))


def robots_filter(df: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """Rows whose URL the robots rules of its host allow; no fitting rule allows.

    The rule with the smallest number whose path is a prefix decides.  Hosts
    with an ordinary number of rules carry them as one array joined to the URL
    rows; the few with more are looked up by the prefixes of the path instead,
    so no row grows with the rules of one host.
    """
    applicable = materialize(rules_for_agent(rules, agent))
    sizes = applicable.groupBy("host").agg(F.count("*").alias("_n"))
    large = sizes.filter(F.col("_n") > RULES_PER_ROW).select("host")
    listed = (
        lookup_join(applicable, large, ["host"], "left_anti")
        .groupBy("host")
        .agg(F.sort_array(F.collect_list(F.struct("rule_no", "path", "allow"))).alias("_rules"))
    )
    targets = df.withColumn("host", _authority(F.col(url))).withColumn("_target", _target(F.col(url)))
    judged = lookup_join(targets, listed, ["host"], "left")
    fitting = F.filter("_rules", lambda r: F.col("_target").startswith(r["path"]))
    allowed = judged.filter(F.coalesce(F.get(fitting, F.lit(0))["allow"], F.lit(True)))
    if large.isEmpty():
        return allowed.select(*df.columns)
    verdicts = _prefix_verdicts(
        lookup_join(targets, large, ["host"], "left_semi"), lookup_join(applicable, large, ["host"], "left_semi")
    )
    forbidden = verdicts.filter(~F.col("allow")).select("host", "_target")
    return lookup_join(allowed, forbidden, ["host", "_target"], "left_anti").select(*df.columns)


def _prefix_verdicts(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """First fitting rule per distinct (host, target), by an equi-join on path prefixes."""
    by_path = rules.groupBy("host", "path").agg(F.min(F.struct("rule_no", "allow")).alias("_rule"))
    lengths = by_path.groupBy("host").agg(F.collect_set(F.length("path")).alias("_lengths"))
    distinct = lookup_join(targets.select("host", "_target").distinct(), lengths, ["host"], "inner")
    prefixes = distinct.select(
        "host",
        "_target",
        F.explode(F.filter("_lengths", lambda n: n <= F.length("_target"))).alias("_n"),
    ).withColumn("path", F.expr("left(_target, _n)"))
    hits = lookup_join(prefixes, by_path, ["host", "path"], "inner")
    return hits.groupBy("host", "_target").agg(F.min("_rule")["allow"].alias("allow"))
