"""Secrets in texts: fixed patterns, and formats inferred from what the patterns found.

Credentials of each kind are put into a prefix tree, and states whose relative frequencies are
statistically compatible are merged, which leaves a small probabilistic automaton of the format.
A further automaton is inferred from ordinary tokens. Every token that a labelled value could be
is then scored by the odds of the formats against the ordinary; those as likely as the labelled ones
are secrets too. What a state has seen is smoothed towards even odds, so that a format known from a
few credentials says less than one known from many; no number of them is too small.
"""

from __future__ import annotations

import hashlib
import math
import re
import statistics
from collections import defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, by_batch, sampled

#: The kinds in order, their patterns and least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "format")

#: Tokens that are scored: runs of the signs that a labelled value may have, of its least length;
#: so are a run's pieces between '=', without dots around, and their pieces between dots.
TOKEN, SPLIT, DOTS = re.compile(r"[A-Za-z0-9+/_.=-]{8,}"), re.compile("[^=]{8,}"), re.compile("[^.]{8,}")
#: Different credentials of a kind, and documents with ordinary tokens, that are learned from at
#: most, and the longest values taken into that sample; they are learned and scored whole.
CREDENTIALS, ORDINARY, SAMPLED = 400, 1_000, 4_096
#: Level of the merge test, the weight of even odds over so many signs and the end, and the share of
#: a state's probability left for what it has not seen, the same in all automata.
ALPHA, EVEN, SIGNS, REST = 0.05, 1.0, 68, 0.02
UNSEEN = math.log(REST / SIGNS)
#: Least odds, in nats; how many deviations of the labelled credentials' odds the bar lies below
#: their mean, and the least deviation, as a share of the mean.
ODDS, BELOW, LEAST_SPREAD = 12.0, 3.0, 0.05
#: Tokens that a task remembers the outcome of, and their length at most.
_KNOWN, _KNOWN_LENGTH = 50_000, 64

_WORDS = ("passw", "secret", "token", "api")


class Automaton(NamedTuple):
    """Per state: log probability to end, and of each symbol with the state it leads to.

    A symbol that a state has not seen has UNSEEN and leads to the first state.
    """

    end: list[float]
    moves: list[dict[str, tuple[float, int]]]

    def log_likelihood(self, token: str) -> float:
        state, total, unseen = 0, 0.0, (UNSEEN, 0)
        for symbol in token:
            p, state = self.moves[state].get(symbol, unseen)
            total += p
        return total + self.end[state]


class Formats(NamedTuple):
    """Automata by kind with their bars, and the automaton of ordinary tokens."""

    kinds: dict[str, tuple[Automaton, float]]
    ordinary: Automaton | None


def infer(strings: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the prefix tree of ``strings``, breadth first."""
    count, ends, edges = [0], [0], [{}]  # edges: symbol -> [state, times]
    for s in strings:
        state = 0
        count[0] += 1
        for symbol in s:
            edge = edges[state].get(symbol)
            if edge is None:
                edge = edges[state][symbol] = [len(count), 0]
                count.append(0)
                ends.append(0)
                edges.append({})
            edge[1] += 1
            state = edge[0]
            count[state] += 1
        ends[state] += 1
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > width * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(a: int, b: int) -> bool:
        work = [(a, b)]
        while work:
            a, b = work.pop()
            n, m = count[a], count[b]
            if not n or not m:
                continue
            if differ(ends[a], n, ends[b], m):
                return False
            for symbol in edges[a].keys() | edges[b].keys():
                one, two = edges[a].get(symbol), edges[b].get(symbol)
                if differ(one[1] if one else 0, n, two[1] if two else 0, m):
                    return False
                if one and two and one[0] != two[0]:
                    work.append((one[0], two[0]))
        return True

    def fold(a: int, b: int) -> None:
        work = [(a, b)]
        while work:
            a, b = work.pop()
            count[a] += count[b]
            ends[a] += ends[b]
            for symbol, (state, times) in edges[b].items():
                own = edges[a].get(symbol)
                if own is None:
                    edges[a][symbol] = [state, times]
                else:
                    own[1] += times
                    if own[0] != state:
                        work.append((own[0], state))

    kept = [0]
    while True:
        seen = set(kept)
        rim = [(a, s, e[0]) for a in kept for s, e in sorted(edges[a].items()) if e[0] not in seen]
        if not rim:
            break
        parent, symbol, state = rim[0]
        same = next((a for a in kept if compatible(a, state)), None)
        if same is None:
            kept.append(state)
        else:
            edges[parent][symbol][0] = same
            fold(same, state)
    number = {state: i for i, state in enumerate(kept)}
    log = lambda x, n: max(UNSEEN, math.log((1 - REST) * (x + EVEN / SIGNS) / (n + EVEN)))
    return Automaton(
        [log(ends[a], count[a]) for a in kept],
        [{s: (log(t, count[a]), number[b]) for s, (b, t) in edges[a].items()} for a in kept],
    )


def learned(strings: list[str], ordinary: Automaton) -> tuple[Automaton, float]:
    """An automaton of one kind's credentials, and the odds from which on a token has its format.

    The bar follows from the odds of all credentials in an automaton inferred from the other half of
    them, a single one's from its own.
    """
    own = infer(strings)
    halves = [strings[::2], strings[1::2]] if len(strings) > 1 else [strings, strings]
    odds = []
    for fitted, held in (halves, halves[::-1]):
        other = infer(fitted)
        odds += [other.log_likelihood(s) - ordinary.log_likelihood(s) for s in held]
    mean = statistics.fmean(odds)
    return own, max(ODDS, mean - BELOW * max(statistics.pstdev(odds), LEAST_SPREAD * mean))


def base(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the value) of what the fixed patterns match."""
    found, low = [], text.lower() if text.isascii() else text.casefold()
    if any(word in low for word in _WORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text)
                  if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def margin(formats: Formats, token: str) -> float:
    """How far the odds of the token's likeliest format lie above its bar."""
    ordinary = formats.ordinary.log_likelihood(token)
    return max(a.log_likelihood(token) - ordinary - bar for a, bar in formats.kinds.values())


def parts(formats: Formats, token: str) -> list[tuple[int, int]]:
    """(start, end) of the secrets in a token: the whole, or pieces one of which has a larger margin."""
    return _parts(formats, token, 0)[1]


def _parts(formats: Formats, token: str, level: int) -> tuple[float, list[tuple[int, int]]]:
    """The largest margin and the spans; pieces lie between '=' first, then between dots."""
    whole, found, best = margin(formats, token), [], -math.inf
    for m in (SPLIT, DOTS)[level].finditer(token) if level < 2 else ():
        piece = m.group().strip(".")
        if ASSIGN_LEAST <= len(piece) < len(token) or level == 0 and len(piece) == len(token):
            first = m.start() + m.group().find(piece)
            own, spans = _parts(formats, piece, level + 1)
            best = max(best, own)
            found += [(first + a, first + b) for a, b in spans]
    if found and best >= whole:
        return best, found
    return whole, [(0, len(token))] if whole >= 0 else []


def scan(text: str, formats: Formats | None, known: dict[str, list]) -> list[tuple]:
    """Spans of ``base``, and of other tokens that have a format, sorted by start and kind."""
    found = base(text)
    if formats and formats.kinds:
        more, taken = [], [(s, e) for s, _, e, _ in found]
        for m in TOKEN.finditer(text):
            token = m.group()
            hits = known.get(token)
            if hits is None:
                hits = parts(formats, token)
                if len(token) <= _KNOWN_LENGTH:
                    if len(known) >= _KNOWN:
                        known.clear()
                    known[token] = hits
            for a, b in hits:
                a, b = a + m.start(), b + m.start()
                if not any(s < b and a < e for s, e in taken):
                    more.append((a, 3, b, a))
        found = sorted(found + more)
    return found


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> Formats:
    """Formats of the credentials in ``docs`` that the patterns label.

    Learned from at most CREDENTIALS different credentials of each kind, and from the tokens of at
    most ORDINARY documents without any; both are those that hash lowest. Values of more than
    SAMPLED characters are not learned from. A table without credentials has no formats.
    """
    stages = Stages(docs.sparkSession, "secrets")

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = set()
        for t in batch.column(0).to_pylist():
            rows |= {(KINDS[kind], t[at:end]) for _, kind, end, at in base(t or "") if end - at <= SAMPLED}
        rows = sorted(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], ["kind", "value"]
        )

    own = docs.select(F.col(text).alias("text"))
    labelled = stages.save(by_batch(own, label, "kind string, value string").distinct(), "labelled")
    kinds = {}
    for kind in KINDS[:3]:
        rows = labelled.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(CREDENTIALS)
        kinds[kind] = [r.value for r in rows.collect()]

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = set()
        for t in batch.column(0).to_pylist():
            if t and not base(t):
                rows |= {m.group() for m in TOKEN.finditer(t) if len(m.group()) <= SAMPLED}
        return pa.RecordBatch.from_arrays([pa.array(sorted(rows), pa.string())], ["value"])

    some = sampled(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "id", ORDINARY, "text")
    plain = by_batch(some.select("text"), tokens, "value string").distinct()
    plain = [r.value for r in plain.orderBy(F.xxhash64("value"), "value").limit(4 * CREDENTIALS).collect()]
    ordinary = infer(sorted(plain))
    return Formats({kind: learned(strings, ordinary) for kind, strings in kinds.items() if strings}, ordinary)


def find(docs: DataFrame, formats: Formats | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row.

    Spans are kind:start:end in code points, end exclusive, sorted by start and kind, joined by
    commas; base_sha256 is over those of the patterns alone. The span of an assignment reaches
    from its word to the end of its value. Null and empty texts have no spans. Repeated rows are
    reported each; other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    known: dict[str, list] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = defaultdict(list)
        for t in batch.column(1).to_pylist():
            spans = scan(t or "", formats, known)
            for i, name in enumerate(KINDS[:3]):
                out[f"n_{name}"].append(sum(k == i for _, k, _, _ in spans))
            told = [f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans if k < 3]
            out["base_sha256"].append(hashlib.sha256(",".join(told).encode()).hexdigest())
            out["spans"].append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans))
        columns = [pa.array(x, pa.string() if isinstance(x[0], str) else pa.int64()) for x in out.values()]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *out])

    return by_batch(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), work, schema)


def redact(docs: DataFrame, formats: Formats | None, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents with the values of all spans replaced by ``mark``; other columns unchanged."""
    at, names, known = docs.columns.index(text), docs.columns, {}

    def hidden(t: str | None) -> str | None:
        spans = scan(t, formats, known) if t else []
        out, last = [], 0
        for _, _, end, start in sorted(spans, key=lambda s: (s[3], s[2])):
            if end <= last:
                continue
            out += [t[last:max(start, last)], mark] if start >= last else []
            last = end
        return "".join(out) + t[last:] if out else t

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        columns[at] = pa.array([hidden(t) for t in columns[at].to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays(columns, names)

    return by_batch(docs, work, docs.schema)
