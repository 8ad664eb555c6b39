"""Secret scan: fixed patterns, and probabilistic automata inferred from labelled credentials that score every other candidate.

Grammar inference: the labelled values, written in character classes, make a prefix tree; its states are merged while
their frequencies of ending and going on agree statistically (Hoeffding bounds, states in the order of their first
strings). The values are learned whole. One automaton is learned from credentials and one from ordinary values; a candidate's score is the difference
of its log likelihoods.

Cases: a null or empty text has no spans; texts are read whole; repeated rows are scanned alike, rows with a null id too;
spans that start together come in the order of the kinds; an empty table gives an empty result; other columns stay, but
those named as the results of a scan are replaced.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh

#: The fixed patterns (fixed values), with the least length of what is judged.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "format")
#: Words without one of which a text cannot have an assignment.
CLUES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Candidates of the automata: every maximal run of the characters that credentials are written in, from this length on.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")

#: Character classes: hex digits apart from other letters, each sign its own.
CLASSES = {**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "U")}
ALPHABET = "dhlU+/_.=-$"
_TO_CLASS = str.maketrans(CLASSES)


def classes(value: str) -> str:
    return value.translate(_TO_CLASS)


@dataclass
class State:
    ends: int = 0
    passes: int = 0
    next: dict[str, int] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton by state merging. alpha sets how unlikely a wrong refusal to merge is. The prefix
    tree holds the strings whole."""

    def __init__(self, strings: Iterable[str], alpha: float = 0.05):
        self.states = [State()]
        for s in strings:
            at = 0
            for c in s:
                state = self.states[at]
                state.passes += 1
                state.counts[c] = state.counts.get(c, 0) + 1
                if c not in state.next:
                    state.next[c] = len(self.states)
                    self.states.append(State())
                at = state.next[c]
            self.states[at].passes += 1
            self.states[at].ends += 1
        self.alpha = alpha
        self._merge_all()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            p, q = self.states[a], self.states[b]
            if self._differ(p.ends, p.passes, q.ends, q.passes):
                return False
            for c in p.counts.keys() | q.counts.keys():
                if self._differ(p.counts.get(c, 0), p.passes, q.counts.get(c, 0), q.passes):
                    return False
                if c in p.next and c in q.next and p.next[c] != q.next[c]:
                    todo.append((p.next[c], q.next[c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a. b is the root of a tree, so this ends."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            p, q = self.states[a], self.states[b]
            p.ends += q.ends
            p.passes += q.passes
            for c, n in q.counts.items():
                p.counts[c] = p.counts.get(c, 0) + n
                if c in p.next:
                    todo.append((p.next[c], q.next[c]))
                else:
                    p.next[c] = q.next[c]

    def _merge_all(self) -> None:
        red = [0]
        while True:
            blue = sorted({(self.states[r].next[c], r, c) for r in red for c in self.states[r].next if self.states[r].next[c] not in red})
            if not blue:
                break
            b, parent, c = blue[0]
            for r in red:
                if self._compatible(r, b):
                    self.states[parent].next[c] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
        number = {r: i for i, r in enumerate(red)}
        # What is left, as log probabilities with a small share for what was never seen.
        self.moves: list[dict[str, tuple[float, int]]] = []
        self.stops: list[float] = []
        for r in red:
            s = self.states[r]
            total = s.passes + 0.5 * (len(ALPHABET) + 1)
            self.moves.append({c: (math.log((s.counts.get(c, 0) + 0.5) / total), number[s.next[c]] if c in s.next else number[r]) for c in ALPHABET})
            self.stops.append(math.log((s.ends + 0.5) / total))
        del self.states

    def log_likelihood(self, text: str) -> float:
        at, total = 0, 0.0
        for c in text:
            step, at = self.moves[at].get(c, (-10.0, at))
            total += step
        return total + self.stops[at]


def labelled_values(seed: int = 5, each: int = 60) -> list[tuple[str, bool]]:
    """Labelled credentials and ordinary values, made by rule: a stand-in for a labelled table where there is none.

    True: random hex, letters with digits, base64, prefixed and dotted tokens. False: words in several cases, paths,
    host names, dates, rulers, version strings.
    """
    r = random.Random(seed)
    lower, upper, digits, low_hex = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    pick = lambda chars, lo, hi: "".join(r.choice(chars) for _ in range(r.randint(lo, hi)))
    word = lambda lo=2, hi=9: "".join(r.choice(("an", "er", "th", "in", "on", "re", "st", "en", "ti", "ou", "le", "d", "s", "h", "qu")) for _ in range(r.randint(lo, hi)))
    good = [
        lambda: pick(low_hex, 16, 64),
        lambda: pick(lower + upper + digits, 20, 48),
        lambda: pick(lower + upper + digits + "+/", 24, 64) + r.choice(("", "=", "==")),
        lambda: r.choice(("sk_live_", "ghp_", "xoxb-", "pk_test_", "glpat-")) + pick(lower + upper + digits, 16, 40),
        lambda: "AKIA" + pick(upper + digits, 14, 18),
        lambda: ".".join(pick(lower + upper + digits + "_-", 16, 40) for _ in range(3)),
        lambda: "-".join(pick(low_hex, n, n) for n in (8, 4, 4, 4, 12)),
    ]
    bad = [
        lambda: word(6, 14),
        lambda: word(3, 6).capitalize() + word(3, 8),
        lambda: word(6, 14).upper() + r.choice(("", ".")),
        lambda: "-".join(word() for _ in range(r.randint(2, 5))),
        lambda: "_".join(word() for _ in range(r.randint(2, 5))),
        lambda: "/".join([r.choice(("", "//www." + word() + ".example.com"))] + [word() for _ in range(r.randint(2, 6))]) + r.choice(("", ".html", "/", "/" + pick(digits, 1, 5))),
        lambda: ".".join(word() for _ in range(r.randint(2, 4))) + r.choice((".", ".com", ".org")),
        lambda: r.choice("-=_.") * r.randint(16, 60),
        lambda: f"{pick(digits, 4, 4)}-{pick(digits, 2, 2)}-{pick(digits, 2, 2)}" + r.choice(("", "-" + word())),
        lambda: pick(digits, 12, 20),
        lambda: "...".join(word() for _ in range(3)),
    ]
    return [(make(), True) for make in good for _ in range(each)] + [(make(), False) for make in bad for _ in range(each)]


#: Log likelihood ratio from which a candidate counts as a credential.
THRESHOLD = 8.0


@dataclass
class FormatModel:
    credential: Automaton
    ordinary: Automaton
    threshold: float = THRESHOLD

    def score(self, value: str) -> float:
        written = classes(value)
        return self.credential.log_likelihood(written) - self.ordinary.log_likelihood(written)


def fit(labelled: Iterable[tuple[str, bool]], bound: int = 2000, threshold: float = THRESHOLD) -> FormatModel:
    """From (value, is a credential); at most bound values of each label, those with the smallest hashes, so the fit stays small."""
    kept: dict[bool, list[str]] = {True: [], False: []}
    for value, secret in labelled:
        if value:
            kept[bool(secret)].append(value)
    smallest = lambda values: sorted(values, key=lambda v: hashlib.sha1(v.encode()).digest())[:bound]
    return FormatModel(*(Automaton(sorted(map(classes, smallest(kept[k])))) for k in (True, False)), threshold)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of kind) of the fixed patterns, by start, then kind."""
    found = []
    lowered = text.lower()
    if any(clue in lowered for clue in CLUES):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # A run of hex digits of that length lies within a candidate of at least that length.
    for c in CANDIDATE.finditer(text):
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text, c.start(), c.end()) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found, key=lambda f: (f[0], f[2]))


def all_spans(text: str, model: FormatModel, base: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, int]]:
    """The base spans, and what is likely a credential by its format: of every candidate the stretches outside the
    base spans, all of them if they are likely one when joined, else each by itself. They are judged without the base
    spans, or a path with a hex id would be one."""
    base = base_spans(text) if base is None else base
    added = []
    for c in CANDIDATE.finditer(text):
        inside = [(s, e) for s, e, _ in base if s < c.end() and c.start() < e]
        outer = _outside(c.start(), c.end(), inside)
        if len(outer) > 1 and _likely(joined := "".join(text[lo:hi] for lo, hi in outer), 0, len(joined), model):
            added += [(lo, hi, 3) for lo, hi in outer if text[lo:hi].strip(".=-")]
            continue
        added += [f for lo, hi in outer if (f := _likely(text, lo, hi, model))]
    return sorted([*base, *added], key=lambda f: (f[0], f[2]))


def _outside(lo: int, hi: int, inside: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches of lo..hi that no span covers."""
    out = []
    for s, e in sorted(inside):
        if s > lo:
            out.append((lo, s))
        lo = max(lo, e)
    return [*out, (lo, hi)] if lo < hi else out


def _likely(text: str, lo: int, hi: int, model: FormatModel) -> tuple[int, int, int] | None:
    """The span of the value in lo..hi, without signs at its ends, if it is likely a credential."""
    value = text[lo:hi].strip(".=-")
    if len(value) < 16 or model.score(value) < model.threshold:
        return None
    lo += text[lo:hi].index(value)
    return lo, lo + len(value), 3


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, model: FormatModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all without it), n_assign, n_access, n_hex, n_format, base_sha256 and spans."""
    own = ("n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans")
    keep = [c for c in (keep or docs.columns) if c not in own]
    n = len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [[], [], [], []], [], []
            for text in batch.column(n).to_pylist():
                base = base_spans(text or "")
                found = all_spans(text or "", model, base)
                for k in range(4):
                    counts[k].append(sum(f[2] == k for f in found))
                digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=[*keep, *own])

    kinds = docs.select(*keep).schema
    for name in own:
        kinds = kinds.add(name, "long" if name.startswith("n_") else "string")
    return docs.select(*keep, F.col(text_col).alias(fresh("text", docs))).mapInArrow(run, kinds)


def redact(docs: DataFrame, model: FormatModel, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by the mark; spans that overlap are replaced as one."""
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text or not (spans := all_spans(text, model)):
            return text
        out, done = [], 0
        for lo, hi, _ in spans:
            if lo >= done:
                out += [text[done:lo], mark]
            done = max(done, hi)
        return "".join(out) + text[done:]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op7_grammar_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), fit(labelled_values()), keep=["doc_id"])
