"""Secret scans: fixed patterns, and probabilistic automata inferred from the credentials these find.

The distinct values of the fixed patterns are labelled credentials. For each kind, a
prefix tree over character classes is built from a bounded sample of them, and
statistically compatible states are merged (Hoeffding bound), red-blue order. Every
other token of a text that could be a credential is then scored by the likelihood of
its format per character under each automaton, and its span is added where that
reaches what the labelled credentials of the kind themselves reach.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, text_or_empty, written

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: What could be a credential: a maximal run of these characters, unless it is of letters alone, as words are, without a capital inside.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]*?(?:[0-9+/_=-]|[a-z][A-Z])[A-Za-z0-9+/_.=-]*")
NO_WORD = re.compile(r"[0-9+/_=-]|[a-z][A-Z]")
#: Fewest characters of a candidate; each kind's automaton takes none shorter than the labelled credentials it is learnt from.
LEAST_CHARS = 8
#: Most distinct credentials of a kind that an automaton is inferred from, those of the smallest hashes, and most characters of one: longer ones are scored but not learnt from. Both bound what reaches the driver.
SAMPLE, LEARN_CHARS = 1000, 200
#: Confidence of the merging test, and the share of labelled credentials that may score below the threshold.
ALPHA, BELOW = 0.01, 0.02
#: Credentials of a kind below which no automaton is inferred.
LEAST = 5


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the fixed patterns, in order of start and then of kind."""
    out = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in WORDS):
            out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if any(len(w) >= 32 for w in text.split()):
        out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of what is left of the runs beside base spans, without marks at its ends."""
    out = []
    for m in CANDIDATE.finditer(text):
        a, end = m.span()
        if end - a < LEAST_CHARS:
            continue
        for s, t, *_ in [*(x for x in base if x[0] < end and a < x[1]), (end, end)]:
            v = text[a:s].rstrip(".=-_") if s > a else ""
            at = a + len(v) - len(v.lstrip(".=-_"))
            v = text[at : a + len(v)]
            if len(v) >= LEAST_CHARS and NO_WORD.search(v):
                out.append((at, at + len(v), v))
            a = max(a, t)
    return out


def symbols(value: str) -> str:
    """Classes of the characters: digit d, a-f h, g-z l, A-F H, G-Z U, others as they are."""
    return "".join("d" if c.isdigit() else "h" if "a" <= c <= "f" else "l" if "a" <= c <= "z" else "H" if "A" <= c <= "F" else "U" if "A" <= c <= "Z" else c for c in value)


#: Characters of each class; another character is a class of its own.
CLASS_SIZE = {"d": 10, "h": 6, "l": 20, "H": 6, "U": 20}


class Automaton:
    """A probabilistic automaton, inferred by merging compatible states of a prefix tree."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.through: list[dict[str, int]] = [{}]  # how often each symbol leaves a state
        self.ends: list[int] = [0]
        for s in strings:
            q = 0
            for c in s:
                self.through[q][c] = self.through[q].get(c, 0) + 1
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({}), self.through.append({}), self.ends.append(0)
                q = self.next[q][c]
            self.ends[q] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.through[q].values())

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.through[a].keys() | self.through[b].keys():
                if self._differ(self.through[a].get(c, 0), n, self.through[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b] and self.next[a][c] != self.next[b][c]:
                    pairs.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.through[b].items():
                self.through[a][c] = self.through[a].get(c, 0) + n
                if c in self.next[a]:
                    pairs.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge(self) -> None:
        red = [0]
        while True:
            blue = [(self._total(t), q, c, t) for q in red for c, t in self.next[q].items() if t not in red]
            if not blue:
                break
            _, q, c, t = max(blue, key=lambda x: (x[0], -x[3]))
            for r in red:
                if self._compatible(r, t):
                    self.next[q][c] = r
                    self._fold(r, t)
                    break
            else:
                red.append(t)
        self.states = len(red)

        self._drop_merged()

    def _drop_merged(self) -> None:
        """Keeps the states that can still be reached, which are what is scored with."""
        number, todo = {0: 0}, [0]
        for q in todo:
            for t in self.next[q].values():
                if t not in number:
                    number[t] = len(number)
                    todo.append(t)
        self.next = [{c: number[t] for c, t in self.next[q].items()} for q in todo]
        self.through, self.ends = [self.through[q] for q in todo], [self.ends[q] for q in todo]

    def score(self, value: str) -> float:
        """Mean log2-likelihood of a character of the format against characters drawn evenly from 67; a step never seen costs 12 bits."""
        q, total, s = 0, 0.0, symbols(value)
        for c in s:
            n = self._total(q) if q is not None else 0
            k = self.through[q].get(c, 0) if q is not None else 0
            if not k:
                total -= 12
                q = self.next[0].get(c)
                continue
            total += math.log2(k / n / CLASS_SIZE.get(c, 1) * 67)
            q = self.next[q][c]
        return total / max(1, len(s))


def infer(values: dict[str, list[str]]) -> dict[str, tuple[Automaton, float, int]]:
    """For each kind its automaton, its threshold and its shortest credential: half of the sample is learnt from, the other half sets the threshold."""
    out = {}
    for kind, found in sorted(values.items()):
        found = sorted(found)
        if len(found) >= LEAST:
            learn = Automaton([symbols(v) for v in found[::2]])
            scores = sorted(learn.score(v) for v in found[1::2])
            out[kind] = (learn, max(0.5, scores[int(BELOW * len(scores))]), min(map(len, found)))
    return out


SCANNED = "base array<struct<start:int,end:int,kind:string,value:string>>, other array<struct<start:int,end:int,value:string>>"


def scan(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, base spans and candidates of every row: the one pass over whole texts. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
        run_ = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
        for b in batches:
            base = [base_spans(t) for t in b.column("text").to_pylist()]
            other = [candidates(t, s) for t, s in zip(b.column("text").to_pylist(), base)]
            cols = [
                b.column("doc_id"),
                pa.array([[dict(zip(("start", "end", "kind", "value"), s)) for s in x] for x in base], span),
                pa.array([[dict(zip(("start", "end", "value"), s)) for s in x] for x in other], run_),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "base", "other"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("string").alias("text")).mapInArrow(run, f"doc_id long, {SCANNED}")


def learn(scanned: DataFrame) -> dict[str, tuple[Automaton, float, int]]:
    """Automata from the distinct values in all rows; at most SAMPLE of a kind, of at most LEARN_CHARS characters, reach the driver."""
    found = scanned.select(F.explode("base").alias("s")).select("s.kind", "s.value").where(F.char_length("value") <= LEARN_CHARS).distinct()
    values: dict[str, list[str]] = {}
    for kind in KINDS[:3]:
        some = found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(SAMPLE)
        values[kind] = [r["value"] for r in some.toLocalIterator()]
    return infer(values)


def added(other: list, automata: dict[str, tuple[Automaton, float, int]]) -> list[tuple[int, int, str]]:
    return [(s["start"], s["end"], "format") for s in other if any(len(s["value"]) >= shortest and a.score(s["value"]) >= least for a, least, shortest in automata.values())]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{e}" for a, e, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per row.

    Null and empty texts have no spans. Repeated rows each give a row. Where fewer than
    LEAST credentials of a kind are in the table, that kind has no automaton and adds
    nothing. An empty table gives no rows; other columns are left out.
    """
    scanned = written(scan(docs), "scanned")
    automata = learn(scanned)  # bounded by SAMPLE, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, base, other in zip(*[b.column(c).to_pylist() for c in ("doc_id", "base", "other")]):
                fixed = [(s["start"], s["end"], s["kind"]) for s in base]
                n = [sum(k == kind for *_, k in fixed) for kind in KINDS[:3]]
                rows.append((d, *n, hashlib.sha256(joined(fixed).encode()).hexdigest(), joined(fixed + added(other, automata))))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scanned.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by a mark."""
    out, at = [], 0
    for a, e, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()} REMOVED]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; spans in their texts are masked, and n_chars, where there is such a column, follows.

    Null and empty texts stay as they are, as do all other columns; long texts are read
    whole; repeated rows are alike; an empty table gives no rows.
    """
    automata = learn(written(scan(docs), "scanned"))
    counts = "n_chars" in docs.columns
    plain = [f.name for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = b.column("text").to_pylist()
            new = []
            for t in texts:
                base = base_spans(t or "")
                other = [{"start": a, "end": e, "value": v} for a, e, v in candidates(t or "", base)]
                spans = [s[:3] for s in base] + added(other, automata)
                new.append(masked(t, spans) if spans else t)
            b = b.set_column(plain.index("text"), "text", pa.array(new, b.schema.field("text").type))
            if counts:
                k = plain.index("n_chars")
                n = [len(x) if x is not None and x is not t else old for x, t, old in zip(new, texts, b.column(k).to_pylist())]
                b = b.set_column(k, "n_chars", pa.array(n, b.schema.field(k).type))
            yield b

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
