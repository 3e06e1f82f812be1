"""The language of a text by rank-order n-gram profiles.

A profile is a language's commonest n-grams of 1 to 3 characters, by rank; a text's distance from it is how far its own
n-grams are out of place, an unknown one as far as the profile is long.
"""

from __future__ import annotations

from collections import Counter
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: N-grams of a language's profile, of a text's, and characters of a text that are judged, as the reference judges them.
PROFILE, OWN, JUDGED = 400, 300, 2000
#: Distinct n-grams that a task counts before it passes them on.
_KEEP = 200_000


def ngrams(text: str) -> Counter:
    """Counts of the n-grams of a text's words of letters, in lower case, a space on either side."""
    words = Counter("".join([c if c.isalpha() else " " for c in text.lower()]).split())
    out: Counter = Counter()
    for word, n in words.items():
        padded = f" {word} "
        for c in word:
            out[c] += n
        for a, b in pairwise(padded):
            out[a + b] += n
        for k in range(len(padded) - 2):
            out[padded[k : k + 3]] += n
    return out


def _first(counts: Counter, n: int) -> list[str]:
    """The n commonest n-grams, equals in the order of their characters."""
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]]


def profiles(rows: DataFrame, text: str = "text", language: str = "lang", size: int = PROFILE) -> dict[str, dict[str, int]]:
    """Ranks of each language's commonest n-grams, from all labelled rows. What comes to the driver is ``size`` n-grams a language."""

    def count(batches):
        held: dict[str, Counter] = {}

        def passed():
            for name, own in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1).to_pylist()):
                held.setdefault(name, Counter()).update(ngrams(t.as_py()))
                if sum(map(len, held.values())) > _KEEP:
                    yield from passed()
        yield from passed()

    labelled = rows.select(F.col(text).alias("text"), F.col(language).alias("lang")).where("text is not null and lang is not null")
    counts = labelled.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    out: dict[str, dict[str, int]] = {}
    for r in counts.withColumn("place", place).where(F.col("place") <= size).collect():
        out.setdefault(r["lang"], {})[r["gram"]] = r["place"] - 1
    return dict(sorted(out.items()))


def nearest(text: str | None, known: dict[str, dict[str, int]]) -> tuple[str | None, float]:
    """The language whose profile is nearest, and how much nearer it is than the second (0 to 1); null where there are no letters."""
    own = _first(ngrams((text or "")[:JUDGED]), OWN)
    if not own or not known:
        return None, 0.0
    far = {}
    for name, ranks in known.items():
        places = np.array([ranks.get(g, -1) for g in own])
        far[name] = int(np.where(places < 0, len(ranks), np.abs(places - np.arange(len(own)))).sum())
    (name, least), *rest = sorted(far.items(), key=lambda x: (x[1], x[0]))
    return name, 1.0 if not rest else 1 - least / max(1, rest[0][1])


def detected(text: Column, known: dict[str, dict[str, int]]) -> Column:
    """Struct of lang and margin of a text."""

    @F.pandas_udf("lang string, margin double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([nearest(t, known) for t in texts], columns=["lang", "margin"])

    return judge(F.left(text, F.lit(JUDGED)))  # no more of a text than is judged


def page_language(tag: Column, text: Column, known: dict[str, dict[str, int]], least: float = 0.0) -> Column:
    """A page's own language tag; where it has none the nearest profile's, if it is nearer than others by ``least``."""
    found = detected(F.when(tag.isNull() | (tag == ""), text), known)
    return F.coalesce(F.nullif(tag, F.lit("")), F.when(found["margin"] >= least, found["lang"]))
