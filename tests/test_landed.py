"""Rules of hosts, walks, result lists, running sums and languages against plain versions."""

import itertools
import random
import re
from urllib.robotparser import RobotFileParser

import pytest
from millrace.operators import hosts, language, scan
from millrace.sources import dom, results, walks
from pyspark.sql import functions as F


@pytest.mark.parametrize("by", [(), ("g",)])
def test_running_sums_of_a_hot_group(spark, by):
    """One group holds nine tenths of all rows, with ties, nulls and equal rows; it lies over several partitions."""
    rng = random.Random(6)
    rows = [(rng.choice([None, "hot", *["hot"] * 17, "rare"]), rng.choice([None, *range(200)]), rng.choice([None, *range(-5, 9)])) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "g string, o long, v long")
    found = scan.running(frame, F.col("v"), ["o"], by, "before", parts=7).collect()
    assert sorted(map(repr, ((r.g, r.o, r.v) for r in found))) == sorted(map(repr, rows))
    groups = {}
    for r in found:
        groups.setdefault(r.g if by else 0, []).append(r)
    for own in groups.values():
        # by the order, the sums of a group are a running sum: equals of the order stand in some order
        key = lambda r: (r.o is not None, r.o or 0)
        total = 0
        for _, same in itertools.groupby(sorted(own, key=key), key):
            left = list(same)
            while left:
                now = min((r for r in left if r.before == total), key=lambda r: (r.v or 0) != 0)  # a zero keeps the sum for the next one
                total += now.v or 0
                left.remove(now)
    numbers = sorted(r.n for r in scan.numbered(frame, ["o"], (), "n", 5).collect())
    assert numbers == list(range(5, 3005))
    assert scan.running(frame.where("g = 'none'"), F.col("v"), ["o"], by).collect() == []


def test_a_hot_group_is_several_tasks(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("g"), F.col("id").alias("o"))
    plan = scan.running(rows, F.lit(1), ["o"], ["g"], parts=8)
    assert plan.where("before <> o").count() == 0
    share = scan.running(rows, F.lit(1), ["o"], ["g"], parts=8).select(F.floor(F.col("before") / 2500).alias("b")).groupBy("b").count().count()
    assert share == 8


def test_domains_by_suffix(spark):
    rng = random.Random(2)
    names = ["a", "b", "co", "uk", "bbc", "com", "x"]
    table = {".".join(rng.choices(names, k=rng.randint(1, 3))) for _ in range(25)}
    rows = [".".join(rng.choices(names, k=rng.randint(1, 4))) for _ in range(400)] + ["notbbc.com", "", ".", None, "a..b"]
    found = hosts.domain_of(spark.createDataFrame([(h, k) for k, h in enumerate(rows)], "host string, domain long"), spark.createDataFrame([(t,) for t in [*table, "com"]], "domain string")).collect()
    assert len(found) == len(rows)
    for r in found:
        fits = [t for t in [*table, "com"] if r.host is not None and (r.host == t or r.host.endswith("." + t))]
        assert r.under == (max(fits, key=len) if fits else None)
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "domain string")
    pages = spark.createDataFrame([("www.bbc.com",), ("bbc.com",), ("notbbc.com",), ("m.bad.bbc.com",), (None,)], "host string")
    assert sorted(r.host for r in hosts.wanted(pages, frame(["bbc.com"]), frame(["bad.bbc.com"])).collect()) == ["bbc.com", "www.bbc.com"]
    assert hosts.wanted(pages, None, frame([])).count() == 5


def plain_robots(body, agent, path):
    """The rules of the group that fits best, the longest that holds; an allowing one of equals."""
    groups, last = [], None
    for line in re.split(r"\r\n|\r|\n", body):
        m = re.match(r"\s*([^:]*?)\s*:(.*)", line.split("#")[0])
        field, value = (m[1].lower().strip(), m[2].strip()) if m else ("", "")
        if field == "user-agent":
            if last != "user-agent":
                groups.append(([], []))
            groups[-1][0].append(value.lower())
        elif field in ("allow", "disallow") and groups:
            groups[-1][1].append((field == "allow", value))
        if field in ("user-agent", "allow", "disallow"):
            last = field
    fit = lambda names: max((0 if n == "*" else len(n) for n in names if n == "*" or n and n in agent), default=-1)
    best = max((fit(n) for n, _ in groups), default=-1)
    rules = [r for names, own in groups if best >= 0 and fit(names) == best for r in own if r[1]]
    holds = [(len(p), allow) for allow, p in rules if re.match("".join(".*" if c == "*" else "$" if c == "$" and k == len(p) - 1 else re.escape(c) for k, c in enumerate(p)), path)]
    return max(holds)[1] if holds else True


def robots_text(rng, wild):
    lines = []
    for _ in range(rng.randint(1, 4)):
        lines += [f"User-agent: {rng.choice(['*', 'bot', 'other', 'goodbot'])}" for _ in range(rng.randint(1, 2))]
        for _ in range(rng.randint(0, 4)):
            value = "/" + "/".join(rng.choices(["a", "b.c", "x?y", "(z)", "a+"], k=rng.randint(0, 3)))
            if wild:
                value = rng.choice([value, value + "*", value.replace("a", "*"), value + "$", "*" + value, ""])
            lines.append(f"{rng.choice(['Allow', 'Disallow', 'disallow ', 'Crawl-delay', '# no'])}: {value}{rng.choice(['', ' # why', ' '])}")
        lines += rng.choice([[], [""], ["Sitemap: https://e.com/s.xml"]])
    return rng.choice(["\n", "\r\n"]).join(lines)


def test_robots_of_many_hosts(spark):
    rng = random.Random(11)
    texts = {f"h{k}": robots_text(rng, True) for k in range(60)}
    paths = ["/" + "/".join(rng.choices(["a", "b.c", "x?y", "(z)", "aa", "a+"], k=rng.randint(0, 4))) for _ in range(40)]
    pages = spark.createDataFrame([(h, f"https://{h}{p}#f") for h in [*texts, "none"] for p in paths] + [("h1", "https://h1"), (None, "x")], "host string, url string")
    robots = spark.createDataFrame([*texts.items(), ("empty", None), (None, "x")], "host string, body string")
    found = hosts.robots_allowed(pages, robots, "goodbot").collect()
    assert len(found) == len(paths) * 61 + 2
    for r in found:
        path = re.sub(r"^https://[^/]*|#f$", "", r.url) or "/"
        assert r.allowed == (r.host not in texts or plain_robots(texts[r.host], "goodbot", path)), (texts.get(r.host), path)


def test_robots_by_the_first_rule(spark):
    """Without wildcards and in the order of the text, as the standard library reads them, for hosts with one group of rules."""
    rng = random.Random(12)
    texts = {f"h{k}": "User-agent: *\n" + "\n".join(f"{rng.choice(['Allow', 'Disallow'])}: /{'/'.join(rng.choices('abc', k=rng.randint(1, 3)))}" for _ in range(5)) for k in range(40)}
    paths = ["/" + "/".join(rng.choices("abcd", k=rng.randint(0, 4))) for _ in range(30)]
    pages = spark.createDataFrame([(h, f"https://{h}{p}") for h in texts for p in paths], "host string, url string")
    found = hosts.robots_allowed(pages, spark.createDataFrame(list(texts.items()), "host string, body string"), longest=False).collect()
    for r in found:
        rules = RobotFileParser()
        rules.parse(texts[r.host].splitlines())
        assert r.allowed == rules.can_fetch("bot", r.url), (texts[r.host], r.url)


def test_walks_against_one_step_at_a_time(spark):
    """Chains, broken links, pages that did not land, repeated tokens and rings."""
    rng = random.Random(5)
    rows = []
    for d in range(30):
        n = rng.choice([1, 2, 3, 17, 64, 65])
        tokens = [None, *[f"t{k}" for k in range(1, n)]]
        for k, t in enumerate(tokens):
            following = tokens[k + 1] if k + 1 < n else rng.choice([None, "", "gone", *tokens[1:2]])
            if k and rng.random() < 0.02:
                continue
            rows.append((f"d{d}", t, following, rng.random() > 0.03))
            if rng.random() < 0.1:
                rows.append((f"d{d}", t, "t1", False))
    rows += [(None, None, "x", True), ("headless", "t1", None, True), ("ring", None, "a", True), ("ring", "a", "b", True), ("ring", "b", "a", True)]
    rng.shuffle(rows)
    found = {(r.domain, r.token): r.rank for r in walks.walked(spark.createDataFrame(rows, "domain string, token string, next_token string, ok boolean")).collect()}
    landed = {}
    for d, t, following, ok in rows:
        if d is not None and ok:
            landed[d, t or ""] = min(landed.get((d, t or ""), "~"), following or "")
    expected = {}
    for d in {d for d, _ in landed}:
        at, rank = "", 0
        while (d, at) in landed and (d, at) not in expected:
            expected[d, at] = rank
            at, rank = landed[d, at] or "\0", rank + 1
    assert found == expected and max(found.values()) > 10


def test_harvest_has_a_bound(spark):
    pages = spark.createDataFrame([("d", None, "a", True), ("d", "a", "b", True), ("d", "b", None, False)], "domain string, token string, next_token string, ok boolean")
    records = spark.createDataFrame([("d", t, p, f"{t}{p}") for t in (None, "a", "b") for p in range(3)], "domain string, token string, position int, url string")
    assert sorted(r.url for r in walks.harvested(pages, records).collect()) == ["None0", "None1", "None2", "a0", "a1", "a2"]
    assert sorted(r.url for r in walks.harvested(pages, records, 4).collect()) == ["None0", "None1", "None2", "a0"]


def plain_results(root, rule):
    """By looking for each step below the one before."""
    fits = lambda n, step: n.tag == step[0] and (step[1] is None or step[1] in n.attrs.get("class", "").split() or step[1] == n.attrs.get("class"))
    out = []
    for n in root.walk():
        if fits(n, rule.steps[0]):
            for step in rule.steps[1:]:
                n = next((x for x in n.walk() if fits(x, step)), None) if n is not None else None
            if n is not None and n.attrs.get("href") and rule.href_has in n.attrs["href"]:
                out.append(n.attrs["href"])
    return out


def test_results_against_a_search():
    rng = random.Random(7)

    def tree(depth=0):
        out = []
        for _ in range(rng.randint(0, 4)):
            t = rng.choice(["div", "li", "a", "h2", "span", "p"])
            href = f" href='/{rng.randint(0, 99)}{rng.choice(['', '?uddg=1'])}'" if t == "a" and rng.random() < 0.9 else ""
            out.append(f"<{t} class='{rng.choice(['g', 'dd algo', 'b_algo', 'result__url', ''])}'{href}>{tree(depth + 1) if depth < 5 else 'x'}" + (f"</{t}>" if rng.random() < 0.9 else ""))
        return "".join(out)

    hits = 0
    for _ in range(300):
        page = tree()
        found = results.result_links(page, results.ENGINES)
        for name, rule in results.ENGINES.items():
            own = [x for x in found if x["engine"] == name]
            assert [x["href"] for x in own] == plain_results(dom.parse(page), rule) and [x["position"] for x in own] == list(range(1, len(own) + 1))
            hits += len(own)
    assert hits > 500 and results.result_links(None, results.ENGINES) == []


def test_results_are_unwrapped_and_valid(spark):
    pages = [
        ("u1", '<a class="result__url" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fe.org%2Fa&rut=1">x</a><a class="result__url" href="https://duckduckgo.com/y">own</a><a class="result__url" href="https://e.org/f.PDF">file</a>', "duckduckgo"),
        ("u2", "<div class='dd algo'><p><a href='https://r.search.yahoo.com/_y/RU=https%3a%2f%2ft.net%2fb/RK=2'></a></p><a href='https://no.net'></a></div>", "yahoo"),
        ("u3", "<li class=b_algo><h2>none</h2><h2><a href='https://e.org'></a></h2></li><li class=b_algo><h2><a href='https://e.org/2'></a></h2></li>", "bing"),
        ("u4", "<div class=g><a href='https://e.org/g'></a></div>", None),
        ("u5", "<div class=g><a href='https://e.org/g'></a></div>", "unknown"),
        ("u6", None, "bing"),
    ]
    found = results.search_results(spark.createDataFrame(pages, "url string, html string, engine string")).collect()
    assert sorted((r.url, r.engine, r.target) for r in found) == [("u1", "duckduckgo", "https://e.org/a"), ("u2", "yahoo", "https://t.net/b"), ("u3", "bing", "https://e.org/2"), ("u4", "google", "https://e.org/g")]


def test_language_of_held_out_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) >= 40")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    known = language.profiles(rows.where(~held))
    assert set(known) == {"de", "en", "es", "fr"} and all(len(x) <= language.PROFILE and sorted(x.values()) == list(range(len(x))) for x in known.values())
    found = rows.where(held).select("lang", language.detected(F.col("text"), known).alias("x")).collect()
    assert len(found) > 200 and sum(r.lang == r.x.lang for r in found) >= 0.95 * len(found)
    assert language.nearest(None, known) == language.nearest(" 12 !", known) == (None, 0.0) and language.nearest("the", {}) == (None, 0.0)
    tagged = spark.createDataFrame([("it", "the and of"), (None, "the and of the thing that was"), ("", None)], "tag string, body string")
    assert [r[0] for r in tagged.select(language.page_language(F.col("tag"), F.col("body"), known)).collect()] == ["it", "en", None]


def test_profiles_are_plain_ranks(spark):
    from collections import Counter

    rows = [("ab abc", "x"), ("abc, ABC!", "x"), ("é", "y"), (None, "y"), ("z", None)]
    known = language.profiles(spark.createDataFrame(rows, "text string, lang string"), size=6)
    total = Counter()
    for text, _ in rows[:2]:
        for word in re.findall("[a-z]+", text.lower()):
            for n in (1, 2, 3):
                padded = word if n == 1 else f" {word} "
                total.update(padded[k : k + n] for k in range(len(padded) - n + 1))
    assert list(known["x"]) == [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:6]] and list(known["y"]) == [" é", " é ", "é", "é "]
