"""Alignment, voting and resampling against plain versions, and on awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import public_tokenizers
import sentencepiece
import tokenizers
from millrace.llm import align, importance, voting
from millrace.llm.common import table
from millrace.llm.queries import llm_oracle_sql
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TEXTS = "doc_id bigint, text string, rank string, unit array<int>"
ODD = [None, "", " ", "   ", "one two", "one two", "a  b   c ", "\n\tx\r\n y", "é ß  ñ\x00 <|endoftext|> <s> <0x41>", "x▁y z", "▁", "naïve 漢字 テスト 😀 é", "don't   stop  now", "aaaa" * 500, "=" * 300 + " ### ,,", "a\x1cb \x85 c", " lead", "trail ", "Ünïcödé, wörds. \nNew line", "1234567 89,000.00 $%&"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(None if k == 3 else k // 2 if k in (4, 5) else k, t, "r", [1]) for k, t in enumerate(ODD)], TEXTS)


def plain_alignment(rows):
    """The contract, token by token, with whole texts given to the libraries."""
    first = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbol = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    found = []
    for doc, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        told_a = [bytes(symbol[c] for c in first.id_to_token(i)) for i in a]
        told_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(told_a) == b"".join(told_b) == b" " + text.encode():
            found.append((doc, [], [], [], []))
            continue
        ends = lambda told: np.cumsum([len(x) for x in told]).tolist()
        end_a, end_b = ends(told_a), ends(told_b)
        links, groups, i, j = [], [], 0, 0
        for x, (stop, t) in enumerate(zip(end_a, told_a)):
            links += [(a[x], b[y]) for y, (other, u) in enumerate(zip(end_b, told_b)) if other - len(u) < stop and stop - len(t) < other] if len(a) < 400 else [(a[x], b[y]) for y in range(max(0, np.searchsorted(end_b, stop - len(t)) - 1), min(len(b), np.searchsorted(end_b, stop) + 2)) if end_b[y] - len(told_b[y]) < stop and stop - len(t) < end_b[y]]
        for stop in sorted(set(end_a) & set(end_b)):
            x, y = end_a.index(stop) + 1, end_b.index(stop) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        found.append((doc, a, b, groups, links))
    count = Counter(p for *_, links in found for p in set(links))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(n, top.get(x, 0))
    return [(doc, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for doc, a, b, groups, links in found]


def aligned(docs, **settings):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in align.align(docs, **settings).collect()), key=repr)


def test_alignment_of_odd_texts(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    expected = sorted(plain_alignment(rows), key=repr)
    assert aligned(odd) == expected
    assert aligned(odd.repartition(3), unit_chars=40) == expected  # counts meet from many units
    assert sum(r[1] == 0 for r in expected) == 4  # null, empty, two with U+2581
    assert aligned(odd.where("doc_id = -5")) == []


def test_alignment_of_documents(spark):
    docs = table(spark, DATA, "documents").where("doc_id < 120")
    assert aligned(docs, unit_chars=30_000) == sorted(plain_alignment([(r.doc_id, r.text) for r in docs.collect()]), key=repr)


def test_random_strings_align(spark):
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "a", "the", "Straße", ".", ",", "'s", "12", "€", "　", " ", "_", "-", "é", "中", "▁", "🙂", "\t", "<s>", "​", "Z", "…"]
    docs = spark.createDataFrame([(k, "".join(rng.choices(bits, k=rng.randint(1, 30)))) for k in range(1500)], "doc_id bigint, text string")
    assert aligned(docs) == sorted(plain_alignment([(r.doc_id, r.text) for r in docs.collect()]), key=repr)


def test_long_texts_align(spark):
    """A token-rich text of megabytes and one stretch of 200,000 characters."""
    word = "".join(random.Random(4).choices("abcdefgh", k=200_000))
    docs = spark.createDataFrame([(1, "some words, and more. " * 100_000), (2, word)], "doc_id bigint, text string")
    found = {r[0]: r for r in aligned(docs)}
    assert found[1][1:4] == (500_000 + 1, 500_000 + 1, 500_000 + 1) or found[1][3] > 400_000
    assert found[2][4] >= max(found[2][1:3]) and found[2][3] > 1000


def test_quality_on_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    found = {r.doc_id: r for r in voting.quality(docs, voting.fit_quality_model(docs, labels)).collect()}
    known = [(found[r.doc_id], r.quality) for r in labels.collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    held = [(r, y) for r, y in known if r.held_out]
    assert len(held) > 100 and sum(r.predicted == y for r, y in held) >= 0.97 * len(held)


def test_votes_against_a_plain_search(spark):
    """Scores from every labelled vector in turn, in float64, ties of the last neighbour included."""
    docs, labels = (table(spark, DATA, n) for n in ("documents", "labels"))
    model = voting.fit_quality_model(docs, labels, neighbours=7)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    scores = model.scores(texts)
    for text, score in zip(texts, scores):
        counts = next(voting._counts([text], len(model.idf)))[0]
        latent = (np.log1p(counts.astype(np.float32)) * model.idf) @ model.directions
        near = np.rint(model.vectors @ (latent / np.linalg.norm(latent)) * 65536)
        last = sorted(near)[-7]
        own = [(n * w, y) for n, w, y in zip(near, model.weights, model.labels) if n >= last and n > 0]
        assert abs(score - sum(w * y for w, y in own) / sum(w for w, _ in own)) < 0.02
    assert list(model.scores([texts[3]] * 3 + texts)[:3]) == [scores[3]] * 3
    assert model.scores(["x" * 3_000_000, "no no no " * 200_000, "\x00"]).shape == (3,)


def plain_classes(text):
    """Runs of equal character classes; a repeated word is a class of its own."""
    out, before, at = [], None, 0
    text += "\n"
    while at < len(text):
        stop = at
        while stop < len(text) and text[stop] not in " \n\t\r\x0b\x0c":
            stop += 1
        if stop == at:
            out.append(32 if text[at] == " " else 10)
            at += 1
            continue
        word = text[at:stop]
        out += [127] * len(word) if word == before else [97 if c.islower() and c.isascii() or not c.isascii() else 65 if c.isupper() else 48 if c.isdigit() else ord(c) for c in word]
        before, at = word, stop
    return [c for k, c in enumerate(out) if k == 0 or c != out[k - 1]]


def test_classes_against_plain_ones():
    texts = ["Two two two  Words, 42!!", "", " x", "é é ÉÉ\n\nA|b | | c", "again", "again again", "!!!! ????"]
    kind, own = voting._classes(texts)
    for k, t in enumerate(texts):
        assert kind[own == k].tolist() == plain_classes(t)


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (9, None), (11, 5), (12, 1), (16, 0)], "doc_id bigint, quality int")
    found = voting.quality(odd, voting.fit_quality_model(odd, labels)).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in odd.collect()) and all(0 <= r.score <= 1 for r in found)
    none = voting.fit_quality_model(odd, labels.where("doc_id = -1"))
    assert {r.score for r in voting.quality(odd, none).collect()} == {0.5}
    assert voting.quality(odd.where("doc_id = -5"), none).collect() == []
    assert voting.fit_quality_model(odd.where("doc_id = -5"), labels).scores([""])[0] <= 1


def resampled(docs, target):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in importance.resample(docs, target).collect()), key=repr)


def plain_resampling(rows, target):
    import re

    upper = {c: c + 32 for c in range(65, 91)}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(upper))
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = (Counter(bucket(w) for x in texts for w in cut(x)) for texts in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for doc, text in rows:
        own = [gain(bucket(w)) for w in cut(text)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long_enough = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for rank, x in enumerate(long_enough[: 10 * len(long_enough) // 100], 1):
        x[4] = rank
    return sorted(map(tuple, out), key=repr)


def test_resampling_against_a_plain_one(spark, odd):
    docs, bench = (table(spark, DATA, n) for n in ("documents", "benchmark"))
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100_000))
    target = [r.text for r in bench.collect()]
    rows = [(r.doc_id, r.text) for r in both.collect()]
    assert resampled(both, bench) == plain_resampling(rows, target)
    twice = both.unionByName(spark.createDataFrame([(5, "one more row of a known id " * 9)] * 2 + [(None, "without an id " * 30)], "doc_id bigint, text string"))
    assert resampled(twice, bench) == plain_resampling([(r.doc_id, r.text) for r in twice.collect()], target)
    assert resampled(odd.where("doc_id = -5"), bench) == []
    assert resampled(odd, bench.where("item_id is null")) == plain_resampling([(r.doc_id, r.text) for r in odd.collect()], [])


def test_runs_of_several_words(spark):
    docs = spark.createDataFrame([(1, "A b c"), (2, None), (3, "one")], "doc_id bigint, text string")
    found = {r.doc_id: r.buckets for r in importance.features(docs, 3, 10_000, ("doc_id",)).collect()}
    runs = ["a", "b", "c", "a b", "b c", "a b c"]
    assert found == {1: [zlib.crc32(x.encode()) % 10_000 for x in runs], 2: [], 3: [zlib.crc32(b"one") % 10_000]}


def test_resampling_sql(spark):
    c = duckdb.connect()
    for n in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{DATA}/{n}.parquet'")
    docs, bench = (table(spark, DATA, n) for n in ("documents", "benchmark"))
    assert resampled(docs, bench) == sorted(c.execute(llm_oracle_sql()["op13_resampling"]).fetchall(), key=repr)
