"""Result links of search engines' pages, by rules of nested elements, in one pass over a page's elements.

A rule names an element that holds a result, and the elements to find in it, each the first within the one before; the last is the link.
While a page is read, every open result waits for one tag; an element looks only at the results that wait for its own.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .dom import parse


class Rule(NamedTuple):
    """Steps of (tag, class or None); ``href_has``: what the link's address must hold."""

    steps: tuple[tuple[str, str | None], ...]
    href_has: str = ""


# fixed values: where the engines' pages have their results
ENGINES = {
    "duckduckgo": Rule((("a", "result__url"),)),
    "duckduckgo_lite": Rule((("a", None),), "uddg="),
    "bing": Rule((("li", "b_algo"), ("h2", None), ("a", None))),
    "yahoo": Rule((("div", "algo"), ("a", None))),
    "google": Rule((("div", "g"), ("a", None))),
}


def _fits(classes: str | None, wanted: str | None) -> bool:
    return wanted is None or wanted == classes or wanted in (classes or "").split()


def result_links(html: str | None, rules: dict[str, Rule]) -> list[dict]:
    """engine, position (1, 2, ... of an engine's results) and href of every result of a page, in the order in which the results begin."""
    page = parse(html).page
    opening: dict[str, list[tuple[str, Rule]]] = {}
    for name, rule in rules.items():
        opening.setdefault(rule.steps[0][0], []).append((name, rule))
    waiting: dict[str, list[list]] = {}  # by tag: [where it ends, next step, rule, number of the result]
    found: list[tuple[str, str | None]] = []

    def took(result: list, at: int) -> None:
        """A result's awaited element: the link, or the scope of the next step."""
        _, step, rule, number = result
        if step == len(rule.steps):
            href = page.held[at].get("href")
            if href and rule.href_has in href:
                found[number] = (found[number][0], href)
        else:
            waiting.setdefault(rule.steps[step][0], []).append([page.end[at], step + 1, rule, number])

    for at, tag in enumerate(page.tags):
        if tag is None or tag not in waiting and tag not in opening:
            continue
        classes = page.held[at].get("class")
        for result in waiting.pop(tag, ()):
            if at < result[0]:
                if _fits(classes, result[2].steps[result[1] - 1][1]):
                    took(result, at)
                else:
                    waiting.setdefault(tag, []).append(result)
        for name, rule in opening.get(tag, ()):
            if _fits(classes, rule.steps[0][1]):
                found.append((name, None))
                took([page.end[at], 1, rule, len(found) - 1], at)
    counted: Counter = Counter()
    out = []
    for name, href in found:
        if href:
            counted[name] += 1
            out.append({"engine": name, "position": counted[name], "href": href})
    return out


def search_results(pages: DataFrame, rules: dict[str, Rule] | None = None, keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """keep, engine, position, href and target of the valid results of pages (html, engine).

    A page is read by its engine's rule, one without an engine by all; a page of an unknown engine has none. Redirects of engines are unwrapped; what is no
    address of a page is left out, as the reference leaves it out.
    """
    known = rules or ENGINES

    @F.pandas_udf("array<struct<engine:string,position:bigint,href:string>>")
    def read(html: pd.Series, engine: pd.Series) -> pd.Series:
        return pd.Series([result_links(h, known if e is None else {k: r for k, r in known.items() if k == e}) for h, e in zip(html, engine)])

    each = pages.select(*keep, F.explode(read("html", "engine")).alias("x")).select(*keep, "x.engine", "x.position", "x.href")
    return each.withColumn("target", urls.unwrap_redirect(F.col("href"))).where(urls.is_valid_result(F.col("target")))
