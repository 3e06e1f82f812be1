"""Secret scan: rules for known forms, and probabilistic automata inferred from labelled credentials.

Rules find the base spans. What they find labels credentials by kind; from a bounded sample of
those, and of ordinary tokens, one prefix tree per kind is folded into a probabilistic automaton
by merging states whose outgoing frequencies a Hoeffding test cannot tell apart. Every other token of
six or more credential characters is then scored: it becomes a span of kind ``learned`` if the best
credential automaton explains its format much better than the automaton of ordinary tokens.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings_of

KINDS = ("assign", "access", "hex", "learned")
#: Bound of the training sample: distinct strings of each kind.
SAMPLE_PER_KIND = 400
#: A token becomes a span from this log-likelihood ratio on (natural logarithm), in all and by character.
LEAST_RATIO, LEAST_RATE = 12.0, 0.55
# fixed values: the three forms and the least lengths
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_VALUE_LEAST = 6
#: Candidates and ordinary tokens: maximal runs of credential characters, as long as an assigned value at least.
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
#: A state that meets unseen characters less often than this has none.
LEAST_NEW = 0.02
#: Decisions on tokens that a worker keeps, and the longest token that it keeps; the longest string of the training sample.
KEEP_TOKENS, LONGEST_KEPT, LONGEST_LEARNED = 200_000, 64, 256
#: Classes of characters and their sizes; within a class all characters are equally likely.
_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "_", ".", "=", "-")
_CLASS = {c: k for k, cs in enumerate(_CLASSES) for c in cs}
_WITHIN = [math.log(len(cs)) for cs in _CLASSES]


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) of the rules' matches, leftmost and non-overlapping by kind."""
    out = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= _VALUE_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def other_tokens(text: str, spans: list) -> list[tuple[int, int, str]]:
    """Tokens that touch no base span. Both are in order of their starts, so each is passed once."""
    out, reach, k = [], 0, 0  # reach: the furthest end of the spans that start before the token ends
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while k < len(spans) and spans[k][0] < end:
            reach = max(reach, spans[k][2])
            k += 1
        if reach <= start:
            out.append((start, end, m[0]))
    return out


class Automaton:
    """A probabilistic automaton over character classes, that also knows the characters of each move.

    States hold counts of visits, ends and moves, and how many characters still followed at each visit. ``learn`` builds the prefix tree of the sample and
    merges, in breadth-first order, each state on the border into the finished state nearest in length that the
    Hoeffding test does not tell from it: neither by ends and moves, along their subtrees, nor by the distributions of what follows, which
    tell places in a format apart even where the tree has thinned out to single strings.
    """

    def __init__(self):
        self.moves: list[dict[int, list]] = [{}]  # class -> [state, count]
        self.chars: list[Counter] = [Counter()]
        self.visits, self.ends = [0], [0]
        self.left: list[Counter] = [Counter()]  # characters that followed -> visits

    @classmethod
    def learn(cls, sample: list[str], alpha: float = 0.05) -> Automaton:
        a = cls()
        for word in sorted(sample):
            state = 0
            a.visits[0] += 1
            a.left[0][len(word)] += 1
            for at, c in enumerate(word, 1):
                k = _CLASS.get(c, 0)
                if k not in a.moves[state]:
                    a.moves[state][k] = [len(a.moves), 0]
                    a.moves.append({})
                    a.chars.append(Counter())
                    a.visits.append(0)
                    a.ends.append(0)
                    a.left.append(Counter())
                edge = a.moves[state][k]
                edge[1] += 1
                a.chars[state][c] += 1
                state = edge[0]
                a.visits[state] += 1
                a.left[state][len(word) - at] += 1
            a.ends[state] += 1
        a._fold(alpha)
        a._prune()
        return a

    def _differ(self, f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > bound * (n1**-0.5 + n2**-0.5)

    def _length_gap(self, p: int, q: int) -> float:
        """How far apart the distributions of what follows are, at the length where they are furthest."""
        m, n, x, y, far = self.visits[p], self.visits[q], 0, 0, 0.0
        if not (m and n):
            return 0.0
        for k in sorted(self.left[p].keys() | self.left[q].keys()):
            x, y = x + self.left[p][k], y + self.left[q][k]
            far = max(far, abs(x / m - y / n))
        return far

    def _compatible(self, p: int, q: int, bound: float) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if self._differ(self.ends[p], self.visits[p], self.ends[q], self.visits[q], bound):
                return False
            for k in self.moves[p].keys() | self.moves[q].keys():
                x, y = self.moves[p].get(k), self.moves[q].get(k)
                if self._differ(x[1] if x else 0, self.visits[p], y[1] if y else 0, self.visits[q], bound):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def _absorb(self, p: int, q: int) -> None:
        """Adds the tree below q to p, state by state."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            self.chars[p] += self.chars[q]
            self.left[p] += self.left[q]
            for k, (to, n) in self.moves[q].items():
                if k in self.moves[p]:
                    self.moves[p][k][1] += n
                    todo.append((self.moves[p][k][0], to))
                else:
                    self.moves[p][k] = [to, n]

    def _fold(self, alpha: float) -> None:
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        done = [0]
        while True:
            finished = set(done)
            border = [(r, k) for r in done for k, (to, _) in sorted(self.moves[r].items()) if to not in finished]
            if not border:
                return
            r, k = border[0]
            q = self.moves[r][k][0]
            # the nearest in length first, so that single strings go where they belong
            for gap, p in sorted((self._length_gap(p, q), p) for p in done):
                if gap <= bound * (max(1, self.visits[p]) ** -0.5 + self.visits[q] ** -0.5) and self._compatible(p, q, bound):
                    self.moves[r][k][0] = p
                    self._absorb(p, q)
                    break
            else:
                done.append(q)

    def _prune(self) -> None:
        """Keep only the states that folding has left."""
        order, at = [0], {0: 0}
        for q in order:
            for _, (to, _) in sorted(self.moves[q].items()):
                if to not in at:
                    at[to] = len(order)
                    order.append(to)
        self.moves = [{k: [at[to], n] for k, (to, n) in self.moves[q].items()} for q in order]
        self.chars, self.visits, self.ends, self.left = ([own[q] for q in order] for own in (self.chars, self.visits, self.ends, self.left))

    def background(self) -> dict[str, float]:
        """Log probability of each character, by how often the sample has its class."""
        counts = [1 + sum(moves[k][1] for moves in self.moves if k in moves) for k in range(len(_CLASSES))]
        return {c: math.log(counts[k] / sum(counts)) - _WITHIN[k] for c, k in _CLASS.items()}

    def finish(self, background: dict[str, float]) -> Automaton:
        """Next state and log probability of each character in each state, and the log probability of each state's end.

        A character that a state has not seen is likely as its class is, if the state has met many
        different ones for its visits. Otherwise it is as unlikely as the visits are many, and leads
        to a last state where characters have their background, the same for all automata.
        """
        lost = len(self.moves)
        self.steps, self.stops = [], []
        for moves, chars, seen, ends in zip(self.moves, self.chars, self.visits, self.ends):
            new = len(chars) / (seen + len(chars)) if seen else 1.0  # that the next character is one not met here
            rest = math.log(0.5 / (seen + 0.5))
            row = {}
            for c, k in _CLASS.items():
                if c in chars or k in moves and new >= LEAST_NEW:
                    p = (1 - new) * chars[c] / seen + new * (moves[k][1] / seen / len(_CLASSES[k]) if k in moves else 0)
                    row[c] = (moves[k][0], math.log(p))
                else:
                    row[c] = (lost, rest + background[c])
            self.steps.append(row)
            self.stops.append(math.log(ends / seen) if ends else rest)
        self.steps.append({c: (lost, p) for c, p in background.items()})
        self.stops.append(0.0)
        return self

    def log_likelihood(self, word: str, strict: bool = False) -> float:
        """Natural logarithm of the probability of the word; strict: minus infinity for a word that leaves the format, or ends where no learned one did."""
        state, total, steps = 0, 0.0, self.steps
        for c in word:
            state, p = steps[state][c]
            total += p
        return -math.inf if strict and (state == len(self.moves) or not self.ends[state]) else total + self.stops[state]


class SecretModel:
    def __init__(self, credentials: dict[str, Automaton], ordinary: Automaton):
        background = ordinary.background()
        self.credentials, self.ordinary = {k: a.finish(background) for k, a in credentials.items()}, ordinary.finish(background)
        self.known: dict[str, bool] = {}

    def accepts(self, token: str) -> bool:
        """Whether some credential automaton explains the token's format much better than the ordinary one."""
        found = self.known.get(token)
        if found is None:
            found = self._accepts(token)
            if len(token) <= LONGEST_KEPT:
                if len(self.known) >= KEEP_TOKENS:
                    self.known.clear()
                self.known[token] = found
        return found

    def _accepts(self, token: str) -> bool:
        if not self.credentials:
            return False
        gain = max(a.log_likelihood(token, strict=True) for a in self.credentials.values()) - self.ordinary.log_likelihood(token)
        return gain >= LEAST_RATIO and gain >= LEAST_RATE * len(token)

    def spans(self, text: str) -> list[tuple[int, int, int, str]]:
        """All spans: those of the rules, and the learned ones."""
        found, known = base_spans(text), self.known
        if not any([known[t] if t in known else self.accepts(t) for t in set(_TOKEN.findall(text))]):
            return found
        return sorted(found + [(a, 3, b, t) for a, b, t in other_tokens(text, found) if self.accepts(t)])


_HALF = 1 << 63


def _rank(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode()) - _HALF


def fit_secret_model(docs: DataFrame, per_kind: int = SAMPLE_PER_KIND, labelled: dict[str, list[str]] | None = None) -> SecretModel:
    """Automata from the ``per_kind`` distinct strings of each kind with the least hashes, of up to LONGEST_LEARNED characters, and from ``labelled`` credentials of other kinds.

    Every token of every text is ranked; each task keeps its own least hashes, so that what is
    exchanged and collected is bounded whatever the input. Tokens that no rule labels are the
    ordinary ones; those of letters and those with other characters are sampled apart.
    """

    def label(batches):
        least: list[dict[str, int]] = [{}, {}, {}, {}, {}]
        tops, hashed = [_HALF] * 5, xxhash.xxh64_intdigest

        def add(kind: int, value: str) -> None:
            if len(value) <= LONGEST_LEARNED and value not in least[kind] and (h := _rank(value)) < tops[kind]:
                own = least[kind]
                own[value] = h
                if len(own) >= 2 * per_kind:
                    keep = sorted(own.items(), key=lambda x: (x[1], x[0]))[:per_kind]
                    least[kind], tops[kind] = dict(keep), keep[-1][1] + 1

        for batch in batches:
            for text in strings_of(batch.column("text")):
                spans = base_spans(text)
                for _, kind, _, value in spans:
                    add(kind, value)
                ordinary = {t for _, _, t in other_tokens(text, spans)} if spans else set(_TOKEN.findall(text))
                for value in ordinary:
                    kind = 3 if value.isalpha() else 4
                    if hashed(value.encode()) - _HALF < tops[kind]:
                        add(kind, value)
        rows = [(k, h, v) for k, own in enumerate(least) for v, h in sorted(own.items(), key=lambda x: (x[1], x[0]))[:per_kind]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["kind", "rank", "value"])

    found = docs.select("text").where(F.col("text").isNotNull()).mapInArrow(label, "kind int, rank long, value string")
    found = found.distinct().persist()
    sample = {k: [r["value"] for r in found.where(F.col("kind") == k).orderBy("rank", "value").limit(per_kind).collect()] for k in range(5)}
    found.unpersist()
    credentials = {KINDS[k]: sample[k] for k in range(3)} | (labelled or {})
    return SecretModel({k: Automaton.learn(own) for k, own in credentials.items() if own}, Automaton.learn(sample[3] + sample[4]))


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def scan_secrets(docs: DataFrame, model: SecretModel) -> DataFrame:
    """Per row of docs (doc_id, text): n_assign, n_access, n_hex, base_sha256, spans, n_learned.

    Spans are kind:start:end in code points, end exclusive. Null and empty texts have no spans;
    repeated rows give repeated results; an empty table gives no rows; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in strings_of(batch.column("text")):
                spans = model.spans(text)
                base = [s for s in spans if s[1] < 3]
                kinds = [s[1] for s in spans]
                for c, v in zip(out, (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), kinds.count(3))):
                    c.append(v)
            kinds_of = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out, kinds_of)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long")


def redact_secrets(docs: DataFrame, model: SecretModel, mark: str = "[SECRET]") -> DataFrame:
    """Rows of docs, all columns, with every span of the text replaced by ``mark``; n_chars follows the text where there is such a column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def redact(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for a, _, b, _ in shared.value.spans(text):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join(out) + text[at:] if out else text

    def run(batches):
        for batch in batches:
            texts = [redact(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array(texts, c.type) if n == "text" else pa.array([None if t is None else len(t) for t in texts], c.type) if n == "n_chars" else c for n, c in zip(names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
