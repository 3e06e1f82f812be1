"""Walks along links that pages name themselves, such as resumption tokens: list ranking by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import released, written


def walked(pages: DataFrame) -> DataFrame:
    """domain, token and rank (0, 1, ...) of the landed pages that a walk from each domain's first page reads.

    pages has domain, token (null or empty: the first page), next_token and ok. A walk goes from a page to the one its
    next_token names. It ends before a page that is not ok or has not landed, after one without a next token, and at one that it has
    read already. Of several pages of one token the one with the least next token counts, one that is ok before others.

    Round k follows 2^k links at once, so a chain of n pages takes about log2(n) rounds, each a join; a round's table is written out.
    """
    token = F.coalesce("token", F.lit(""))
    own = pages.where("domain is not null").select("domain", token.alias("token"), F.nullif("next_token", F.lit("")).alias("next"), F.coalesce("ok", F.lit(False)).alias("ok"))
    one = own.groupBy("domain", "token").agg(F.min(F.struct((~F.col("ok")).alias("bad"), F.coalesce("next", F.lit("")).alias("next"))).alias("x"))
    good = written(one.where("not x.bad").select("domain", "token", F.nullif("x.next", F.lit("")).alias("next")), "tokens")
    jumps = written(good.where("next is not null").join(good.select("domain", F.col("token").alias("next")), ["domain", "next"], "left_semi").select("domain", "token", "next"), "jumps")
    reached = written(good.where("token = ''").select("domain", "token", F.lit(0).cast("bigint").alias("rank")), "reached")
    step = 1
    while True:
        further = reached.join(jumps, ["domain", "token"]).select("domain", F.col("next").alias("token"), (F.col("rank") + step).alias("rank"))
        fresh = written(further.join(reached.select("domain", "token"), ["domain", "token"], "left_anti").groupBy("domain", "token").agg(F.min("rank").alias("rank")), "further")
        if fresh.isEmpty():
            released(good, jumps, fresh)
            return reached
        longer = written(reached.unionByName(fresh), "reached")
        second = jumps.select("domain", F.col("token").alias("next"), F.col("next").alias("after"))
        doubled = written(jumps.join(second, ["domain", "next"]).select("domain", "token", F.col("after").alias("next")), "jumps")
        released(reached, fresh, jumps)
        reached, jumps, step = longer, doubled, 2 * step


def harvested(pages: DataFrame, records: DataFrame, most: int | None = None) -> DataFrame:
    """Records (domain, token, position, ...) of the pages that a walk reads, with rank; of each domain the first ``most`` in the walk's order."""
    from ..operators.scan import numbered

    found = records.withColumn("token", F.coalesce("token", F.lit(""))).join(walked(pages), ["domain", "token"])
    return found if most is None else numbered(found, ["rank", "position"], ["domain"], "_n").where(F.col("_n") <= most).drop("_n")
