"""Hosts against tables of domains and of robots rules: joins on the parts of a name or a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A robots text counts up to so many characters, as crawlers read them; so do addresses against rules.
MOST_ROBOTS, MOST_PATH = 500_000, 2000


def suffixes(host: Column) -> Column:
    """A host name and every name that it lies under: ``a.b.c`` gives a.b.c, b.c and c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def domain_of(rows: DataFrame, domains: DataFrame, host: str = "host", name: str = "under") -> DataFrame:
    """rows with ``name``: the longest domain of a table (domain) that the host equals or lies under; null where there is none.

    Each distinct host asks for its own names by an equi-join, so a table of any number of domains
    costs no more than its rows, and a host that all rows share is asked for once.
    """
    asked = rows.select(F.col(host).alias("_host")).where(F.col("_host").isNotNull()).distinct().select("_host", F.explode(suffixes(F.col("_host"))).alias("domain"))
    known = domains.select("domain").distinct()
    found = asked.join(known, "domain").groupBy("_host").agg(F.max_by("domain", F.length("domain")).alias(name))
    return rows.join(found, F.col(host) == F.col("_host"), "left").drop("_host")


def wanted(rows: DataFrame, include: DataFrame | None, exclude: DataFrame | None, host: str = "host") -> DataFrame:
    """rows whose host is, or lies under, a domain to include (None: any), and none to exclude."""
    out = rows
    if include is not None:
        out = domain_of(out, include, host, "_in").where(F.col("_in").isNotNull()).drop("_in")
    if exclude is not None:
        out = domain_of(out, exclude, host, "_out").where(F.col("_out").isNull()).drop("_out")
    return out


# ---- robots ----------------------------------------------------------------------------------


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """The rules of each host (host, body) for an agent: host, place, allow, pattern, head and regex.

    A group is one or more user-agent lines and the rules after them. The groups of the longest agent name within ``agent`` hold,
    else those of ``*``. Empty patterns say nothing. ``head`` is a pattern's text up to its first ``*`` or closing ``$``; ``regex`` is null for
    plain prefixes. Of several texts of a host the least counts.
    """
    own = robots.where("host is not null and body is not null").groupBy("host").agg(F.min("body").alias("body"))
    lines = own.select("host", F.posexplode(F.split(F.substring("body", 1, MOST_ROBOTS), r"\r\n|\r|\n")).alias("place", "line"))
    cut = lines.select("host", "place", F.regexp_replace("line", "#.*", "").alias("line"))
    field = F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1)))
    said = cut.select("host", "place", field.alias("field"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow"))
    # the lines of one text, which is bounded
    in_order = Window.partitionBy("host").orderBy("place")
    is_agent = F.col("field") == "user-agent"
    opens = is_agent & F.coalesce(F.lag("field").over(in_order) != "user-agent", F.lit(True))
    groups = said.withColumn("opens", opens.cast("int")).withColumn("grp", F.sum("opens").over(in_order))
    name = F.lower(F.col("value"))
    agents = groups.where(is_agent & (F.col("grp") > 0)).select("host", "grp", F.when(name == "*", 0).when((name != "") & F.contains(F.lit(agent.lower()), name), F.length(name)).alias("fit")).where("fit is not null")
    best = agents.withColumn("best", F.max("fit").over(Window.partitionBy("host"))).where("fit = best").select("host", "grp").distinct()
    rules = groups.where(~is_agent & (F.col("value") != "")).join(best, ["host", "grp"])
    pattern = F.col("value")
    head = F.regexp_extract(F.regexp_replace(pattern, r"\$$", ""), r"^([^*]*)", 1)
    quoted = F.regexp_replace(F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([\\.+?^${}()|\[\]])", r"\\$1"), r"\*+", ".*")
    regex = F.when(pattern.rlike(r"[*]|\$$"), F.concat(F.lit("(?s)^"), quoted, F.when(pattern.endswith("$"), "$").otherwise("")))
    return rules.select("host", "place", (F.col("field") == "allow").alias("allow"), pattern.alias("pattern"), head.alias("head"), regex.alias("regex"))


def robots_allowed(pages: DataFrame, robots: DataFrame, agent: str = "*", longest: bool = True) -> DataFrame:
    """host, url and allowed of pages (host, url) by the robots texts of hosts (host, body); hosts without one, and addresses that no rule holds for, are allowed.

    ``longest``: of the rules that hold for an address the one with the longest pattern decides, an allowing one of equals;
    otherwise the first in the text. An address meets only the rules whose plain head it begins with, by an equi-join on the heads of
    the lengths that its host's rules have; patterns with ``*`` or ``$`` are then tried on those.
    """
    rules = robots_rules(robots, agent)
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("head")).alias("lengths"))
    path = F.regexp_extract("url", r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^#]*)", 1)
    rows = pages.select("host", "url", F.substring(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), 1, MOST_PATH).alias("path"))
    distinct = rows.where("host is not null").select("host", "path").distinct()
    asked = distinct.join(lengths, "host").select("host", "path", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("path")).select("host", "path", F.expr("substring(path, 1, n)").alias("head"))
    met = asked.join(rules, ["host", "head"]).where(F.col("regex").isNull() | F.expr("rlike(path, regex)"))
    order = F.struct(F.length("pattern"), F.col("allow")) if longest else F.struct(-F.col("place"))
    decided = met.groupBy("host", "path").agg(F.max_by("allow", order).alias("_allow"))
    return rows.join(decided, ["host", "path"], "left").select("host", "url", F.coalesce("_allow", F.lit(True)).alias("allowed"))
