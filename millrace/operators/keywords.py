"""Keyword matching: lists, counts, boolean expressions compiled to Columns, snippets and relevance."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import count_of, let, squeeze, whole_word_count


def parse_keywords(raw: str | None) -> list[str]:
    """A JSON list or scalar, or text cut at commas and line ends; order kept, each once."""
    if not raw or not raw.strip():
        return []
    try:
        value = json.loads(raw)
        items = [str(x) for x in value] if isinstance(value, list) else [str(value)]
    except ValueError:
        items = re.split(r"[,\n]", raw)
    return list(dict.fromkeys(x.strip() for x in items if x.strip()))


def parse_filter(raw: str | None) -> list[str]:
    return [x.strip().lower() for x in (raw or "").split(",") if x.strip()]


@dataclass(frozen=True)
class Expression:
    """A parsed boolean expression; ``match`` makes it a Column over a text."""

    kind: str  # term, not, and, or, empty
    term: str = ""
    parts: tuple[Expression, ...] = ()

    def match(self, text: Column, case_sensitive: bool = False) -> Column:
        if self.kind == "empty":
            return F.lit(False)
        if self.kind == "term":
            return F.contains(text if case_sensitive else F.lower(text), F.lit(self.term if case_sensitive else self.term.lower()))
        inner = [p.match(text, case_sensitive) for p in self.parts]
        if self.kind == "not":
            return ~inner[0]
        out = inner[0]
        for c in inner[1:]:
            out = out & c if self.kind == "and" else out | c
        return out


OPERATORS = ("AND", "OR", "NOT")


def boolean_terms(text: str) -> list[str]:
    """The quoted phrases and words of an expression that are no operators, negated and unread ones included; each once."""
    found = [m["phrase"] or m["word"] for m in re.finditer(r'"(?P<phrase>[^"]+)"|(?P<word>\w+)', text)]
    return list(dict.fromkeys(t for t in found if t.upper() not in OPERATORS))


def _scan(text: str) -> list[str]:
    """Brackets, quoted phrases, operators and other words of an expression.

    A bracket stands alone wherever it is, so inside quotes it has spaces around it. An operator
    ends where a word would, so ``AND-x`` is an operator and a word.
    """
    out, at = [], 0
    while at < len(text):
        c, end = text[at], at + 1
        if c == '"' and (close := text.find('"', end)) > end:
            out.append("".join(f" {x} " if x in "()" else x for x in text[at : close + 1]))
            end = close + 1
        elif c in "()":
            out.append(c)
        elif not c.isspace():
            operator = next((w for w in OPERATORS if text[at : at + len(w)].upper() == w and not re.match(r"\w", text[at + len(w) : at + len(w) + 1])), "")
            end = at + len(operator)
            while not operator and end < len(text) and not text[end].isspace() and text[end] not in "()":
                end += 1
            out.append(text[at:end])
        at = end
    return out


def parse_boolean(text: str) -> Expression:
    """OR binds less than AND, AND less than NOT; words of operators in any case; quotes hold a phrase.

    What follows a complete expression without an operator is not read. A missing operand is false, so
    ``war OR`` is war, ``war AND`` nothing and ``NOT`` everything.
    """
    tokens, at = _scan(text), 0

    def word() -> str | None:
        return tokens[at].upper() if at < len(tokens) else None

    def chain(operator: str, inner) -> Expression:
        nonlocal at
        parts = [inner()]
        while word() == operator:
            at += 1
            parts.append(inner())
        return parts[0] if len(parts) == 1 else Expression(operator.lower(), parts=tuple(parts))

    def atom() -> Expression:
        nonlocal at
        if at == len(tokens):
            return Expression("empty")
        token = tokens[at]
        at += 1
        if token == "(":
            inner = either()
            if word() == ")":
                at += 1
            return inner
        return Expression("term", token.strip('"'))

    def negated() -> Expression:
        nonlocal at
        if word() == "NOT":
            at += 1
            return Expression("not", parts=(atom(),))
        return atom()

    def either() -> Expression:
        return chain("OR", lambda: chain("AND", negated))

    return either()


def occurrences(text: Column, term: str, exact: bool = False, case_sensitive: bool = False) -> Column:
    text = F.coalesce(text, F.lit(""))
    if exact:
        return whole_word_count(text, term, case_sensitive)
    return count_of(text, F.lit(term)) if case_sensitive else count_of(F.lower(text), F.lit(term.lower()))


def snippet(text: Column, terms: list[str], around: int = 10) -> Column:
    """Words around the first one that holds the term found earliest; else the first 150 characters."""

    def cut(flat: Column, low: Column, found: Column) -> Column:
        # a term of one word lies within the word that it first occurs in, so that word's place is the number of spaces before
        before = F.left(low, found["at"] - 1)
        spaces = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
        bound = F.struct(F.split(flat, " ").alias("words"), F.when(F.contains(found["term"], F.lit(" ")), 0).otherwise(spaces).cast("int").alias("hit"))

        def around_word(s: Column) -> Column:
            words, hit = s["words"], s["hit"]
            start, end = F.greatest(hit - around, F.lit(0)), F.least(hit + around, F.size(words))
            body = F.array_join(F.slice(words, start + 1, F.greatest(end - start, F.lit(0))), " ")
            return F.concat(F.when(start > 0, "... ").otherwise(""), body, F.when(end < F.size(words), " ...").otherwise(""))

        plain = F.when(F.length(flat) > 150, F.concat(F.left(flat, F.lit(150)), F.lit("..."))).otherwise(flat)
        return F.when(found.isNull(), plain).otherwise(let(bound, around_word))

    def earliest(low: Column) -> Column:
        # the least place wins; of equal places the term given first
        return F.array_min(F.array_compact(F.array(*[F.when(F.instr(low, t.lower()) > 0, F.struct(F.instr(low, t.lower()).alias("at"), F.lit(k).alias("k"), F.lit(t.lower()).alias("term"))) for k, t in enumerate(terms)])))

    def whole(flat: Column) -> Column:
        return let(F.lower(flat), lambda low: let(F.struct(low.alias("low"), earliest(low).alias("found")), lambda s: cut(flat, s["low"], s["found"])))

    return let(squeeze(text), whole)


def relevance(in_title: Column, in_description: Column, in_url: Column, body_hits: Column, body: Column) -> Column:
    """35 for the title, 15 for the description, 10 for the URL, and up to 40 by density, not rounded."""
    words = F.regexp_count(F.coalesce(body, F.lit("")), F.lit(r"\S+"))
    density = F.least(F.lit(40.0), F.coalesce(F.try_divide(body_hits, words) * 2000, F.lit(0.0)))  # words are counted once
    return F.when(in_title, 35.0).otherwise(0.0) + F.when(in_description, 15.0).otherwise(0.0) + F.when(in_url, 10.0).otherwise(0.0) + density


def round_score(score: Column) -> Column:
    """Rounded to one decimal by the exact binary value, ties to even.

    Twenty times the score is 16 and 4 times it, both exact, and their sum is kept with its error: an
    odd sum is a tie or the error decides.
    """

    def decide(x: Column) -> Column:
        total = x * 16 + x * 4
        other = total - x * 16
        error = (x * 16 - (total - other)) + (x * 4 - other)
        half = F.floor((total - 1) / 2)
        odd = half + F.when(error > 0, 1).when(error < 0, 0).otherwise(half % 2)
        return F.when(total % 2 == 1, odd).otherwise(F.floor((total + 1) / 2)) / 10.0

    return let(score, decide)


#: From so many terms on a text is scanned once for all of them; an automaton of more characters than this is refused.
MANY, MOST_CHARACTERS = 40, 8 << 20


def counter_of(terms: list[str], case_sensitive: bool = False):
    """A function of a text Column: how often each term is in it, without overlaps, from one pass over the text."""
    if sum(map(len, terms)) > MOST_CHARACTERS:
        raise ValueError(f"the terms have over {MOST_CHARACTERS} characters")
    wanted = terms if case_sensitive else [t.lower() for t in terms]

    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton, places = ahocorasick.Automaton(), {}
        for i, t in enumerate(wanted):
            places.setdefault(t, []).append(i)
        for t, own in places.items():
            if t:
                automaton.add_word(t, (len(t), own))
        automaton.make_automaton()
        for batch in texts:
            out = []
            for text in batch:
                n, ends = [0] * len(wanted), {}
                for end, (size, own) in automaton.iter(text if case_sensitive else text.lower()) if len(automaton) else ():
                    if end - size >= ends.get(own[0], -1):
                        ends[own[0]] = end
                        for i in own:
                            n[i] += 1
                out.append(n)
            yield pd.Series(out)

    return F.pandas_udf(count, "array<bigint>")


def analysis(df, terms: list[str], title="title", description="description", body="body", url="url", exact=False, case_sensitive=False, expression: str | None = None):
    """Adds found_in_*, occurrences, matched_keywords, matched, snippet and relevance_score to pages.

    No terms means that everything matches, with no occurrences and a relevance of 100.
    """
    fields = {k: F.coalesce(F.col(c), F.lit("")) for k, c in (("title", title), ("description", description), ("body", body), ("url", url))}
    if not terms and not expression:
        return df.withColumns({"occurrences": F.lit(0).cast("bigint"), "matched_keywords": F.array().cast("array<string>"), "matched": F.lit(True), "snippet": F.left(fields["body"], F.lit(150)), "relevance_score": F.lit(100.0)})
    parsed = parse_boolean(expression) if expression else None
    terms = boolean_terms(expression) if parsed else terms
    scanned = len(terms) > MANY and not exact
    if scanned:
        scan = counter_of(terms, case_sensitive)
        df = df.withColumns({f"_n_{k}": scan(c) for k, c in fields.items()})
    else:
        # each count once, however many columns are made of it
        df = df.withColumns({f"_n_{k}_{i}": occurrences(c, t, exact, case_sensitive) for k, c in fields.items() for i, t in enumerate(terms)}) if terms else df
    n = {k: [] if scanned else [F.col(f"_n_{k}_{i}") for i in range(len(terms))] for k in fields}
    total = lambda cs: sum(cs[1:], cs[0])
    hits = {k: F.aggregate(f"_n_{k}", F.lit(0).cast("bigint"), lambda a, x: a + x) if scanned else total(cs) for k, cs in n.items()}
    named = F.array_compact(F.transform(F.array(*map(F.lit, terms)), lambda t, i: F.when(sum((F.get(f"_n_{k}", i) for k in fields), F.lit(0)) > 0, t))) if scanned else F.array_compact(F.array(*[F.when(sum((n[k][i] for k in fields), F.lit(0)) > 0, F.lit(t)) for i, t in enumerate(terms)]))
    if parsed:
        named, matched = F.array_sort(named), parsed.match(F.concat_ws("\n", *fields.values()), case_sensitive)
    elif scanned or exact or case_sensitive or any(not t or "\n" in t for t in terms):
        matched = F.size(named) > 0
    else:
        # a filter on this reaches the scan, where each mention of a field would extract it anew: name each once
        matched = let(F.lower(F.concat_ws("\n", *fields.values())), lambda text: F.greatest(*(F.contains(text, F.lit(t.lower())) for t in terms), F.lit(False)))
    out = df.withColumns({f"found_in_{k}": c > 0 for k, c in hits.items()} | {"occurrences": hits["title"] + hits["description"] + hits["body"] + (hits["url"] > 0).cast("bigint"), "matched_keywords": named, "matched": matched, "snippet": snippet(fields["body"], terms), "_body_hits": hits["body"]})
    score = F.when(F.col("matched"), round_score(relevance(F.col("found_in_title"), F.col("found_in_description"), F.col("found_in_url"), F.col("_body_hits"), fields["body"]))).otherwise(0.0)
    return out.withColumn("relevance_score", score).drop("_body_hits", *[f"_n_{k}" for k in fields], *[f"_n_{k}_{i}" for k in fields for i in range(len(terms))])


def any_keyword(text: Column, keywords: list[str]) -> Column:
    """Whether one of the keywords is anywhere in a text, in any case."""
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(k.lower()))
    return out


def term_frequency(text: Column, keyword: str) -> Column:
    """Occurrences of the keyword's words, over their number; null without a keyword."""
    words = [w for w in re.split(r"\W+", keyword.lower()) if w]
    if not words:
        return F.lit(None).cast("double")
    total = F.lit(0).cast("bigint")
    for w in words:
        total = total + count_of(F.lower(F.coalesce(text, F.lit(""))), F.lit(w))
    return total / float(len(words))
