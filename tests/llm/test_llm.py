"""Each operator against brute force, a round trip or labels, and on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
import xxhash
from millrace.llm import chunks, decontaminate, jpeg, langid, lmscore, media, neardup, packing, rangecoder, secrets, sharding, substrings, tokenfile, tokens
from millrace.llm.common import table

DATA = "/root/testdata/sf0.001"
AWKWARD = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "é ß  ñ\x00\n\ttoken=abcdef123456"), (None, "no id here"), (5, "word " * 3000), (6, "?!"), (7, "one two")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(2)
    base = [r.text for r in rows.orderBy("doc_id").limit(12).collect()]
    extra = []
    for k, t in enumerate(base):
        w = t.split()
        if len(w) > 60:
            w[rng.randrange(len(w))] = "changed"
        extra.append((10_000 + k, " ".join(w), "en"))
    return rows.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, lang string"))


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, "en", "x", [1]) for i, t in AWKWARD], "doc_id bigint, text string, lang string, shard string, slot array<int>")


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("doc_id = -5")


def runs(name, docs, spark):
    bench = table(spark, DATA, "benchmark")
    return {
        "op1": lambda: secrets.scan_secrets(docs, secrets.fit_secret_model(docs)),
        "op2": lambda: neardup.near_duplicates(docs),
        "op3": lambda: decontaminate.contamination(docs, bench),
        "op4": lambda: substrings.drop_repeats(docs),
        "op5": lambda: lmscore.score(docs),
        "op6": lambda: sharding.shard_by_bytes(docs),
        "op7": lambda: media.media_features(media.encode_media(docs)),
        "op8": lambda: packing.pack(docs),
        "op9": lambda: tokenfile.token_digest(docs),
        "op10": lambda: langid.identify_language(docs, langid.fit_language_model(docs)),
    }[name]().collect()


@pytest.mark.parametrize("name", [f"op{i}" for i in range(1, 11)])
def test_awkward_and_empty(spark, awkward, empty, name):
    rows = runs(name, awkward, spark)
    assert Counter(r.doc_id for r in rows if name != "op8" or r.piece == 0) == Counter(i for i, _ in AWKWARD)
    assert runs(name, empty, spark) == []


def test_secrets_base(docs, spark):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    kinds = [(assign, lambda m: len(m[2]) >= 6), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    model = secrets.fit_secret_model(docs)
    found = {r.doc_id: r for r in secrets.scan_secrets(docs, model).collect()}
    for r in docs.collect():
        spans = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in p.finditer(r.text) if ok(m))
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert found[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(found[r.doc_id].spans.split(","))


def test_automaton_prefers_its_format():
    rng = random.Random(0)
    key = lambda: "ghp_" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(36))
    keys, words = secrets.Automaton.learn([key() for _ in range(150)]), secrets.Automaton.learn(["".join(rng.choice("etaoin") for _ in range(rng.randint(8, 14))) for _ in range(150)])
    assert len(keys.moves) > 1
    model = secrets.SecretModel({"assign": keys}, words)
    assert sum(model.accepts(key()) for _ in range(40)) >= 38 and not model.accepts("notationinationate")


def test_learned_spans_on_labelled_forms(spark):
    """Tokens that no rule finds are found by the format of labelled ones; words of prose are not."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    draw = lambda kinds, n: "".join(rng.choices(kinds, k=n))
    forms = {
        "prefixed": lambda: "ghp_" + draw(letters + "0123456789", 36),
        "dashed": lambda: "sk-" + draw(letters + "0123456789", 24),
        "parts": lambda: ".".join(draw(letters + "0123456789_-", rng.randint(20, 30)) for _ in range(3)),
        "short": lambda: draw("0123456789ABCDEF", 16),
    }
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    model = secrets.fit_secret_model(docs, labelled={k: [f() for _ in range(200)] for k, f in forms.items()})
    prose = [r.text for r in docs.collect() if r.text]
    hits = Counter()
    for k, form in enumerate(list(forms) * 75):
        words, token = prose[k].split()[:40], forms[form]()
        at = rng.randrange(len(words) + 1)
        start = len(" ".join(words[:at])) + (at > 0)
        hits[form] += (start, 3, start + len(token)) in [x[:3] for x in model.spans(" ".join([*words[:at], token, *words[at:]]))]
    assert all(hits[f] >= 0.9 * 75 for f in forms), hits
    learned = [t for text in prose for _, kind, _, t in model.spans(text) if kind == 3]
    assert len(learned) <= sum(len(t.split()) for t in prose) / 2000, len(learned)  # words in capitals look like short keys


def test_rules_kinds_give_formats_with_places(spark):
    """On the given table the automata of the rules' kinds have a state for each place of a format, add no false span, and know unseen strings of their kind with the rule switched off."""
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    model = secrets.fit_secret_model(docs)
    assert all(len(a.moves) > 20 for a in model.credentials.values()) and len(model.ordinary.moves) > 5
    found = [x for r in docs.collect() for x in model.spans(r.text or "")]
    assert not [x for x in found if x[1] == 3]
    for kind in (0, 2):
        own = sorted({t for _, k, _, t in found if k == kind})
        random.Random(1).shuffle(own)
        half = secrets.SecretModel({"half": secrets.Automaton.learn(own[: len(own) // 2])}, model.ordinary)
        unseen = own[len(own) // 2 :]
        assert len(unseen) > 40 and sum(map(half.accepts, unseen)) >= 0.9 * len(unseen)
        assert not any(half.accepts(t[:-1]) or half.accepts(t + "0") for t in unseen if len(t) == 40)


def test_lengths_tell_places_apart():
    """A fixed format folds to a chain whose only end is its length; one of any length to a loop."""
    rng = random.Random(2)
    fixed = secrets.Automaton.learn(["".join(rng.choices("0123456789abcdef", k=24)) for _ in range(100)])
    assert len(fixed.moves) == 25 and [k for k, n in enumerate(fixed.ends) if n] == [24]
    loop = secrets.Automaton.learn([rng.choice("ab") * rng.choice([6, 7, 8, 9, 10, 11, 12, 13, 14, 15]) for _ in range(20)])
    assert len(loop.moves) < 10
    assert secrets.Automaton.learn([]).finish(loop.background()).log_likelihood("abc", strict=True) == -math.inf


def test_spans_of_many_credentials_are_told_apart():
    text = " ".join(f"token={k:08d} word{k}" for k in range(4000))
    spans = secrets.base_spans(text)
    assert len(spans) == 4000 and [t for _, _, t in secrets.other_tokens(text, spans)] == [f"word{k}" for k in range(4000) if k > 9]


def test_near_duplicates_against_all_pairs(docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    idf = neardup.idf_table(docs)
    sets = {i: neardup.weighted_sets([t.encode()])[1:] for i, t in rows.items()}
    sets = {i: (h, neardup.weights(h, n, idf)) for i, (h, n) in sets.items()}
    parent = {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sorted(rows), 2):
        if rows[i] == rows[j] or neardup.similarity(sets[i], sets[j]) >= neardup.LEAST:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()} == {i: root(i) for i in rows}


def test_large_bucket_finds_the_hub(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(1, 400):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(300)] = f"x{k}_{rng.random()}"
        rows.append((k, " ".join(w)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.class_id for r in out} == {0}


def test_large_buckets_lose_no_pair(spark):
    """Pairs that share a template's bucket and are alike to each other, but not to its centre."""
    rng = random.Random(3)
    base, texts = [f"w{i}" for i in range(250)], []
    for pair in range(120):
        own = list(base)
        at = rng.randrange(10, 100)
        own[at : at + 30] = [f"p{pair}x{i}" for i in range(30)]
        for member in range(2):
            w = list(own)
            at = rng.randrange(150, 230)
            w[at : at + 8] = [f"m{pair}x{member}x{i}" for i in range(8)]
            texts.append(" ".join(w))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    idf = neardup.idf_table(docs)
    sets = [(h, neardup.weights(h, n, idf)) for _, h, n in (neardup.weighted_sets([t.encode()]) for t in texts)]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(root[:], 2):
        if neardup.similarity(sets[i], sets[j]) >= neardup.LEAST:
            root = [min(root[i], root[j]) if r == max(root[i], root[j]) else r for r in root]
    assert len(set(root)) == 120
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()} == dict(enumerate(root))


def test_near_duplicates_by_text_not_by_id(spark):
    """Different texts of one doc_id are judged apart, and texts without any doc_id have classes too."""
    rng = random.Random(4)
    prose = lambda: [f"w{rng.randrange(10**6)}" for _ in range(200)]
    near = lambda w: [*w[:100], "other", *w[101:]]
    p, q, r = prose(), prose(), prose()
    rows = [(1, p), (1, q), (2, near(p)), (3, near(q)), (None, near(near(p))), (None, r), (None, near(r)), (5, prose())]
    docs = spark.createDataFrame([(i, " ".join(w), [k]) for k, (i, w) in enumerate(rows)], "doc_id bigint, text string, key array<int>")
    found = neardup.near_duplicates(docs).collect()
    ids = Counter((x.doc_id, x.class_id) for x in found)
    nameless = {c for (i, c) in ids if i is None and c != 1}
    assert len(nameless) == 1 and nameless.copy().pop() < 0
    assert ids == Counter({(1, 1): 2, (2, 1): 1, (3, 1): 1, (None, 1): 1, (None, nameless.pop()): 2, (5, 5): 1})
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and len({x.key[0] for x in kept.collect()} & {0, 2, 4}) == 1 and kept.count() == 4


def test_decontamination_against_scan(docs, spark):
    bench = table(spark, DATA, "benchmark")
    items = {r.item_id: decontaminate.words_of((r.text or "").encode()) for r in bench.collect()}
    windows = {}
    for i, w in items.items():
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    found = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    split = {r.doc_id: r for r in decontaminate.contamination(docs, bench, block_bytes=2000).collect()}
    for r in docs.collect():
        w = decontaminate.words_of(r.text.encode())
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= own
        expected = (r.doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
        assert tuple(found[r.doc_id]) == expected == tuple(split[r.doc_id])


def test_rows_are_judged_alike_by_one_block_and_many(spark):
    bench = spark.createDataFrame([(k, " ".join(f"b{k}w{i}" for i in range(30))) for k in range(6)], "item_id bigint, text string")
    rows = [(None, "b1w3 " * 2 + " ".join(f"b1w{i}" for i in range(20))), (7, " ".join(f"b2w{i}" for i in range(15))), (7, "clean text of the same id"), (8, None), (None, "clean")]
    docs = spark.createDataFrame([(i, t, [k], "x") for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, found array<int>, items string")
    for size in (10**6, 200):
        kept = decontaminate.drop_contaminated(docs, bench, block_bytes=size)
        assert kept.columns == docs.columns and sorted(r.found[0] for r in kept.collect()) == [2, 3, 4]


def test_short_items_at_any_place(spark):
    items = [["alpha"], ["beta", "gamma"], [f"t{k}" for k in range(12)]]
    filler = [f"f{k}" for k in range(40)]
    rows, expected = [], {}
    for k, item in enumerate(items):
        for at in (0, 17, 40):  # start, middle and end
            doc = len(rows)
            rows.append((doc, " ".join(filler[:at] + item + filler[at:])))
            expected[doc] = (doc, 40 + len(item), len(item), 1, hashlib.sha256(str(k).encode()).hexdigest(), 20 * len(item) >= 40 + len(item))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: tuple(r) for r in decontaminate.contamination(docs, bench).collect()} == expected


def plain_repeats(rows):
    seen, expected = set(), {}
    for i, text in sorted(rows):
        w = text.encode().split()
        gone = set()
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if k in seen:
                gone |= set(range(a, a + 20))
            seen.add(k)
        expected[i] = (i, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return expected


def test_substrings_against_scan(docs):
    expected = plain_repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: tuple(r) for r in substrings.drop_repeats(docs).collect()} == expected


def test_substrings_of_hot_prefixes(spark, monkeypatch):
    """Few words, so prefixes are frequent, in varied and in equal contexts; chunks meet two at a time."""
    monkeypatch.setattr(chunks, "CHUNK_DOCS", 24)
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(45)]
    rows = []
    for i in range(160):
        w = rng.choices("abcd", k=rng.randint(0, 12)) + rng.choices(["x", "x", "x", "y"], k=rng.randint(0, 60)) + passage[rng.randint(0, 9) : rng.randint(25, 45)] * rng.randint(0, 2) + [f"u{rng.randrange(9)}" for _ in range(rng.randint(0, 30))]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = plain_repeats(rows)
    assert sum(x[2] for x in expected.values()) > 2000
    for hot, fan in ((4, 2), (1, 3), (10**9, 10**9)):
        assert {r.doc_id: tuple(r) for r in substrings.drop_repeats(docs, hot, fan).collect()} == expected


def test_lm_base_and_tree(docs):
    words = {r.doc_id: [*lmscore.words_of(r.text.encode()), b""] for r in docs.collect()}
    counts = Counter(w for i, own in words.items() if not lmscore.held_out(i) for w in own)
    n, v = sum(counts.values()), len(counts)
    for r in lmscore.score(docs).collect():
        own = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert r.score < 0
    assert np.allclose((10.0 ** lmscore.fit_suffix_tree(docs).logp).sum(axis=1), 1, atol=1e-3)


def test_tree_equals_one_counted_plainly(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "CHUNK_DOCS", 20)
    monkeypatch.setattr(lmscore, "FAN", 3)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randint(0, 120))) for _ in range(150)]
    texts[70] = bytes(rng.sample(list(texts[71].encode("latin-1")), len(texts[71]))).decode("latin-1")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tree, depth = lmscore.fit_suffix_tree(docs), lmscore.DEPTH
    symbols = lambda t: [0] * depth + [int(tree.symbol[b]) for w in lmscore.words_of(t.encode()) for b in w + b" "] + [0]
    counts: dict[tuple, Counter] = {}
    for i, t in enumerate(texts):
        s = symbols(t)
        for j in range(depth, len(s) if not lmscore.held_out(i) else 0):
            for k in range(depth + 1):
                counts.setdefault(tuple(s[j - k : j]), Counter())[s[j]] += 1
    root = np.array([counts[()][x] + 0.5 for x in range(lmscore.SYMBOLS)])
    states = {(): root / root.sum()}

    def longest(context):
        return next(context[k:] for k in range(len(context) + 1) if context[k:] in states)

    for c in sorted((c for c in counts if c), key=len):
        n, shorter = sum(counts[c].values()), states[longest(c[1:])]
        if n >= lmscore.LEAST_COUNT and sum(m * math.log(m / n / shorter[x]) for x, m in counts[c].items()) >= lmscore.LEAST_GAIN:
            states[c] = np.array([(counts[c][x] + lmscore.SMOOTHING * shorter[x]) / (n + lmscore.SMOOTHING) for x in range(lmscore.SYMBOLS)])
    assert {len(c) for c in states} == set(range(depth + 1))
    found = {r.doc_id: r.score for r in lmscore.score(docs).collect()}
    for i, t in enumerate(texts):
        s = symbols(t)
        extra = sum(tree.extra[b] for w in lmscore.words_of(t.encode()) for b in w + b" ")
        expected = extra + sum(math.log10(states[longest(tuple(s[j - depth : j]))][s[j]]) for j in range(depth, len(s)))
        assert found[i] == pytest.approx(expected, rel=1e-4)
    assert found[70] < found[71]


def test_tree_grows_with_the_corpus(spark):
    """More contexts pass the tests on more text, without a bound."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    kept = []
    for share in (8, 1):
        tree = spark.sparkContext.broadcast(lmscore.fit_suffix_tree(docs.where(f"doc_id % {share} = 0")))
        table_of = lmscore._states_table(docs.where(f"doc_id % {share} = 0"), tree, 16).collect()
        kept.append(sum(len(r.context4) + len(r.context5) for r in table_of) // 8)
    assert kept[1] > 3 * kept[0] > 0


def test_shards(docs):
    rows = sharding.shard_by_bytes(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    mean, most = sum(sizes.values()) / 8, max(r.size for r in rows)
    assert all(abs(s - mean) <= most + 1 for s in sizes.values())
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id])) for r in rows)


def test_shards_against_a_plain_sort(docs):
    """Shards in order hold the rows in order of hash and id, cut where the bytes are an eighth more, as near as whole rows allow."""
    key = lambda r: (xxhash.xxh64(r.text.encode(), seed=42).intdigest() + (1 << 63)) % (1 << 64)
    texts = docs.collect()
    ordered = sorted(texts, key=lambda r: (key(r), r.doc_id))
    found = sorted(sharding.shard_by_bytes(docs).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in found] == [r.doc_id for r in ordered]
    total, largest, at = sum(r.size for r in found), max(r.size for r in found), 0
    for k in range(1, 8):
        at = sum(r.size for r in found if r.shard < k)
        assert abs(at - total * k / 8) <= largest


def test_a_hot_text_is_split(spark):
    rows = sharding.shard_by_bytes(spark.range(2000).selectExpr("id AS doc_id", "'the same text' AS text")).collect()
    assert max(Counter(r.shard for r in rows).values()) - min(Counter(r.shard for r in rows).values()) <= 2


def test_jpeg_round_trip_and_features(docs):
    payloads = [media.payload_of(x) for x in (b"", b"a", bytes(range(256)) * 9, np.random.default_rng(0).integers(0, 256, 210_000, dtype=np.uint8).tobytes())]
    for frames, p in zip(jpeg.read_all(jpeg.encode(payloads)), payloads):
        assert b"".join(t.tobytes() for _, t in frames) == p
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    for r in media.media_features(media.encode_media(docs)).collect():
        p = media.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


def plain_jpeg(rng, width, height, sampling, restart):
    """A baseline frame of random coefficients, coded symbol by symbol; and its luminance DC levels."""
    dc_table, ac_table = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(11, -1, -1))), ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15), None)
    symbols = [0, 0xF0, *(r << 4 | n for r in range(16) for n in range(1, 8) if (r, n) != (0, 0))]
    ac_table = (ac_table[0], tuple(symbols[: sum(ac_table[0])]))
    dc, ac = jpeg.huffman_codes(*dc_table), jpeg.huffman_codes(*ac_table)
    bits: list[str] = []

    def put(code, n):
        bits.append(format(code, f"0{n}b") if n else "")

    def number(v):
        n = abs(v).bit_length()
        return n, v if v >= 0 else v + (1 << n) - 1

    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    if len(sampling) == 1:
        hm = vm = 1
        sampling = [(1, 1)]
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    levels = np.zeros((down * sampling[0][1], across * sampling[0][0]), int)
    scan, pred, marks = b"", [0] * len(sampling), 0

    def flush():
        joined = "".join(bits)
        joined += "1" * (-len(joined) % 8)
        bits.clear()
        return int(joined, 2).to_bytes(len(joined) // 8, "big").replace(b"\xff", b"\xff\x00")

    for m in range(across * down):
        if restart and m and m % restart == 0:
            scan += flush() + bytes((0xFF, 0xD0 + marks % 8))
            marks, pred = marks + 1, [0] * len(sampling)
        for c, (h, v) in enumerate(sampling):
            for y, x in itertools.product(range(v), range(h)):
                value = rng.randint(-60, 60)
                n, raw = number(value - pred[c])
                pred[c] = value
                put(*dc[n])
                put(raw, n)
                if c == 0:
                    levels[m // across * v + y, m % across * h + x] = value
                k = 1
                while k < 64:
                    symbol = rng.choice(ac_table[1])
                    run, size = symbol >> 4, symbol & 15
                    if rng.random() < 0.3 or size and k + run > 63 or symbol == 0xF0 and k + 16 > 63:
                        symbol = size = 0
                    put(*ac[symbol])
                    if size:
                        raw = rng.randrange(1 << size)
                        put(raw, size)
                        k += run + 1
                    else:
                        k = k + 16 if symbol == 0xF0 else 64
    scan += flush()
    segment = lambda mark, body: bytes((0xFF, mark)) + (len(body) + 2).to_bytes(2, "big") + body
    parts = b"".join(bytes((c + 1, h << 4 | v, 0)) for c, (h, v) in enumerate(sampling))
    head = b"\xff\xd8" + segment(0xDB, b"\x10" + b"\x00\x05" * 64) + segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + parts)
    head += b"".join(segment(0xC4, bytes([kind, *t[0], *t[1]])) for kind, t in ((0x00, dc_table), (0x10, ac_table)))
    if restart:
        head += segment(0xDD, restart.to_bytes(2, "big"))
    sos = segment(0xDA, bytes([len(sampling)]) + b"".join(bytes((c + 1, 0)) for c in range(len(sampling))) + b"\x00\x3f\x00")
    return head + sos + scan + b"\xff\xd9", np.clip((levels * 5 + 4) // 8 + 128, 0, 255)[: -(-height // 8), : -(-width // 8)]


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_frames_of_other_encoders(sampling):
    rng = random.Random(len(sampling) * 10 + sampling[0][0])
    made = [plain_jpeg(rng, w, h, sampling, r) for w, h, r in ((40, 24, 0), (17, 65, 3), (8, 8, 0), (100, 50, 2))]
    for (_, levels), ((frame, thumb),) in zip(made, jpeg.read_all([data for data, _ in made])):
        assert thumb.shape == levels.shape and (thumb == levels).all()
        rows, columns = (np.arange(8) * thumb.shape[0]) // 8, (np.arange(9) * thumb.shape[1]) // 9
        assert media.difference_hash(thumb) == media.difference_hash(levels.astype(np.uint8)) and len(rows) + len(columns) == 17


def test_features_computed_plainly():
    payload = np.random.default_rng(1).integers(0, 256, 576 * 3, dtype=np.uint8)
    ((_, thumb),) = jpeg.read_all(jpeg.encode([payload.tobytes()]))[0]
    grid = payload.reshape(-1, 24).tolist()
    n = len(grid)
    cell = lambda y, x: [grid[a][b] for a in range(y * n // 8, (y + 1) * n // 8) for b in range(x * 24 // 9, (x + 1) * 24 // 9)]
    mean = [[sum(c) / len(c) for c in (cell(y, x) for x in range(9))] for y in range(8)]
    bits = "".join("1" if mean[y][x] > mean[y][x + 1] else "0" for y in range(8) for x in range(8))
    assert media.difference_hash(thumb) == f"{int(bits, 2):016x}"


def test_broken_media_are_null(spark):
    good = jpeg.encode([media.payload_of(b"x")])[0]
    rows = spark.createDataFrame([(1, 0, None), (2, 0, bytearray(b"\xff\xd8junk")), (3, 1, bytearray(good))], "doc_id bigint, n_bytes bigint, media binary")
    assert [r.payload_bytes for r in media.media_features(rows).orderBy("doc_id").collect()] == [None, None, 576]
    rng = random.Random(8)
    for _ in range(1500):  # headers changed at random give a frame or none, but no other error
        bad = bytearray(good)
        for _ in range(2):
            bad[rng.randrange(2, 180)] = rng.randrange(256)
        media._frames([bytes(bad)[: rng.randint(20, len(bad))] if rng.random() < 0.2 else bytes(bad)])


def test_packing(docs):
    enc = tokens.Encoder(tokens.default_vocabulary())
    ids = {r.doc_id: enc.tokenizer.encode(r.text, add_special_tokens=False).ids + [2] for r in docs.collect()}
    rows = packing.pack(docs).collect()
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.piece == 0 or r.length == 1024
    assert max(at.values()) <= 1024 and sum(at.values()) == sum(map(len, ids.values()))
    assert len(at) <= 1.06 * -(-sum(at.values()) // 1024) + 2


@pytest.mark.parametrize("limit", [1, 2, 7, 1000])
def test_best_fit_against_a_plain_model(limit):
    """Equal sizes and equal free spaces included: of equals, the bin that has been so longest."""
    rng = random.Random(limit)
    bins, opened, clock, made = packing.BestFit(64, limit), [], itertools.count(), itertools.count()
    for _ in range(3000):
        size = rng.choice([1, 8, 8, 16, 30, 33, 63, 64, rng.randint(1, 64)])
        fits = [b for b in opened if b["free"] >= size]
        if not fits and len(opened) >= limit:
            opened.remove(min(opened, key=lambda b: (b["free"], b["since"])))
        chosen = min(fits, key=lambda b: (b["free"], b["since"])) if fits else {"id": next(made), "free": 64}
        expected = (chosen["id"], 64 - chosen["free"])
        opened = [b for b in opened if b is not chosen]
        chosen |= {"free": chosen["free"] - size, "since": next(clock)}
        opened += [chosen] if chosen["free"] else []
        assert bins.add(size) == expected


def test_range_coder():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 50257, 9000), np.zeros(5), np.tile(np.arange(70), 130), rng.zipf(1.3, 13_000) % 50_000):
        ids = ids.astype(np.uint32)
        blocks, checks = rangecoder.encode_blocks(ids)
        assert (rangecoder.decode_blocks(blocks, len(ids), checks) == ids).all()
    bad = [blocks[0][:40] + b"\x55\xaa" + blocks[0][42:], *blocks[1:]]
    with pytest.raises(rangecoder.CorruptBlock):
        rangecoder.decode_blocks(bad, len(ids), checks)


def test_token_files(docs):
    enc, start = tokens.encoder(tokens.default_vocabulary()), 0
    found = {r.doc_id: r for r in tokenfile.token_digest(docs).collect()}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        own = np.array(enc.tokenizer.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        assert tuple(found[r.doc_id]) == (r.doc_id, start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)


def test_segments_code_phrases(docs):
    """Each distinct word's ids are coded once and its number wherever it stands; what has too many phrases is coded by its ids."""
    enc = tokens.Encoder(tokens.default_vocabulary())
    texts = [r.text for r in docs.collect()]
    phrases, numbers, counts = enc.phrases(pa.array(texts * 3))
    ids = np.frombuffer(b"".join([phrases[k] for k in numbers]), "<u4")
    assert ids.tobytes() == b"".join(enc.each(texts)) * 3 and len(counts) == 3 * len(texts) and counts.sum() == len(numbers)
    coded = []
    for most in (1 << 22, len(phrases) + 1, len(phrases), 1):
        sizes, n, blocks, checks = tokenfile.code_segment(phrases, numbers, most)
        assert (tokenfile.decode_segment(sizes, n, blocks, checks, len(ids)) == ids).all()
        coded.append((n, sum(map(len, blocks))))
    assert coded[0] == coded[1] and coded[2] == coded[3] and coded[2][0] == len(ids) + len(np.unique(ids))
    assert coded[0][0] < 0.6 * len(ids) and coded[0][1] < min(len(ids), coded[2][1])


def test_range_coder_learns_from_all_blocks():
    """What one block has taught need not be learned by the next; ids may have up to 22 bits."""
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 1 << 22, 5000).astype(np.uint32)
    ids = np.concatenate([passage, *[passage[k : k + 700] for k in rng.integers(0, 4300, 400)]])
    blocks, checks = rangecoder.encode_blocks(ids, 22)
    assert (rangecoder.decode_blocks(blocks, len(ids), checks, 22) == ids).all()
    assert sum(map(len, blocks)) * 8 < 12 * len(ids)  # 22 bits an id where each block begins anew
    for bits in (16, 23):
        with pytest.raises(ValueError):
            rangecoder.encode_blocks(ids, bits)


def test_words_cut_where_pieces_begin():
    """White space of every kind and length, and marks after letters, as the library cuts them."""
    plain, enc = tokenizers.Tokenizer.from_file(tokens.default_vocabulary()), tokens.Encoder(tokens.default_vocabulary())
    texts = [a + b + c for a in ("", "x", "x!", "\t", "é'") for b in ("", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t ", "\t\n", " \t", "   ", "\n\n\n", "\x85 ", "\xa0", "\x1c\n", "\u3000 ") for c in ("", "y", "'s", "$$$ z", "y\n", "_y", "×", "y×.", "''", "y's!", "y!'s", "ǅ, 1")]
    rng = random.Random(1)
    texts += ["".join(rng.choice(texts) for _ in range(4)) for _ in range(3000)]
    for t, ids in zip(texts, enc.each(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_equals_the_library(docs):
    """Ids are those of a tokenizer that nobody has set up otherwise, strings of special tokens included."""
    plain, enc = tokenizers.Tokenizer.from_file(tokens.default_vocabulary()), tokens.Encoder(tokens.default_vocabulary())
    texts = ["it's a  test\n\n x", "½ Ⅷ ٣ 中文", "<|endoftext|> ok", "a <|endoftext|>b <|endoftext|>", " a\x1cb\x85c", "don't WE'LL 12ab_c", "a\nb\n\nc\n\n\nd \n e\n", "\n", " ", "   ", "", " lead", "trail ", "a  b   c", "x\r\ny\t\tz", "日本 語 テスト"]
    rng = random.Random(0)
    texts += ["".join(rng.choice(" \n\t'sabé中1_.,<| \x1c") for _ in range(rng.randint(1, 30))) for _ in range(4000)] + [r.text for r in docs.collect()]
    for _ in range(2):  # with empty and with filled stores
        for t, ids in zip(texts, enc.each(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_language_on_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = langid.identify_language(docs, langid.fit_language_model(docs)).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def test_language_against_plain_bayes(spark, monkeypatch):
    """Counts of n-grams of characters, kept by n-gram and not by bucket."""
    rows = table(spark, DATA, "documents").select("doc_id", "text", "lang").collect()
    rows += [(10**6 + k, t, k % 2 and "ru" or "zh") for k, t in enumerate(["мама мыла раму", "中文字符測試", "рама мыла маму", "測試字符", "где моя мама", "字符"] * 4)]
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id bigint, text string, lang string")
    monkeypatch.setattr(langid, "_STEP", 1000)

    def grams(text):
        s = " " + "".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c for c in text)
        return [s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i] != " " or s[i + n - 1] != " "]

    counts: dict[str, Counter] = {}
    for i, t, k in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1 and k is not None and t is not None:
            counts.setdefault(k, Counter()).update(grams(t))
    bins = 1 << 22  # hardly any two n-grams share a bucket
    model = langid.fit_language_model(docs, bins=bins)
    assert model.languages == sorted(counts)
    for i, t, _ in rows[::7] + rows[-6:]:
        own = grams(t)
        score = [sum(math.log((c[g] + 0.05) / (c.total() + 0.05 * bins)) for g in own) for k, c in sorted(counts.items())]
        (lang,), (p,) = model.predict([t])
        assert lang == sorted(counts)[int(np.argmax(score))]
        assert p == pytest.approx(1 / sum(math.exp(x - max(score)) for x in score), abs=0.02)


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, DATA, "documents")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, DATA)
        assert kept.columns == docs.columns and kept.count() <= before.count()
    out = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
