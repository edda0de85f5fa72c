"""Substring dedup: suffix automata of reference shards, which stream documents for matching statistics.

A window is `least` consecutive words. What an earlier document may hold is narrowed
down by hashes: the smallest hash among a window's short word runs (its minimiser)
must occur in several documents; stretches of windows of one minimiser are looked up
whole, and window by window where stretches of one minimiser differ. For what is left
the earliest document that holds it becomes the reference. Reference passages are
dealt into shards of bounded size, a suffix automaton is built of each, and the
passages of documents that refer to it stream through it. The automaton alone decides:
a word goes if its match is at least `least` long in a document of smaller id.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, partitions, spread_join, table, text_or_empty, written
from .op6_exact import row_key

LEAST = 50
#: Words of the runs whose hashes windows are looked up by.
RUN = 8
#: Words of references aimed at in a shard, and words that stream through one automaton in a task.
SHARD_WORDS, PART_WORDS = 100_000, 2_000_000
#: Where rows without a doc_id stand: behind all others.
LAST = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for k, b in enumerate((_BASE, _BACK)):
            _POWERS[k] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))])
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any stretches of a sequence of numbers, from one running sum."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers(len(values) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words of a text: where they are in its UTF-8 bytes, and their hashes."""

    def __init__(self, text: str | None):
        self.data = np.frombuffer((text or "").encode(), np.uint8)
        inside = np.concatenate([[False], ~_SPACE[self.data], [False]])
        self.starts, self.ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
        self.n = len(self.starts)

    def rolling(self) -> Rolling:
        return Rolling(Rolling(self.data.astype(np.uint64) + np.uint64(1)).of(self.starts, self.ends))

    def joined(self, keep: np.ndarray | None = None) -> bytes:
        """The words, or those kept, with one blank between."""
        raw = self.data.tobytes()
        if keep is None:
            return b" ".join(raw.split())
        return b" ".join([raw[a:e] for a, e in zip(self.starts[keep].tolist(), self.ends[keep].tolist())])


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values."""
    n, step, y = len(x) - width + 1, 1, x
    while 2 * step <= width:
        y = np.minimum(y[:-step], y[step:])
        step *= 2
    return np.minimum(y[:n], y[width - step : width - step + n])


def stretches(words: Words, least: int) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of a text, and of its stretches of windows that share a minimiser: first window, end, minimiser, hash of their words."""
    rolling = words.rolling()
    run = min(RUN, least)
    at = np.arange(words.n - run + 1)
    m = least_of(rolling.of(at, at + run), least - run + 1)
    cut = np.flatnonzero(m[1:] != m[:-1]) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(m)]])
    return rolling, starts, ends, m[starts].view(np.int64), rolling.of(starts, ends + least - 1).view(np.int64)


STRETCH = "array<struct<m:bigint,s:bigint>>"


def scanned(docs: DataFrame, least: int) -> DataFrame:
    """rid, ord, doc_id, n_words, whole (hash of its words joined) and stretches of each row of docs (doc_id, ord, rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, whole, ms, ss, at = [], [], [], [], [0]
            for t in b.column("text").to_pylist():
                w = Words(t)
                n.append(w.n)
                whole.append(hashlib.sha256(w.joined()).hexdigest())
                if w.n >= least:
                    _, _, _, m, s = stretches(w, least)
                    ms.append(m), ss.append(s)
                at.append(at[-1] + (len(ms[-1]) if w.n >= least else 0))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (ms, ss)], ["m", "s"])
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("ord"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(whole, pa.string()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)],
                ["rid", "ord", "doc_id", "n_words", "whole", "stretches"],
            )

    return docs.select("rid", "ord", "doc_id", "text").mapInArrow(run, f"rid long, ord long, doc_id long, n_words long, whole string, stretches {STRETCH}")


def shared_stretches(scan: DataFrame) -> DataFrame:
    """rid, ord, s, first (the smallest ord with the stretch s), again (a larger one has it, too), open (other stretches have its minimiser) of stretches whose minimiser several documents have."""
    each = scan.select("rid", "ord", F.explode("stretches").alias("x")).select("rid", "ord", "x.m", "x.s").distinct()
    of_m = each.groupBy("m").agg(F.min("ord").alias("a"), F.max("ord").alias("z"), (F.min("s") < F.max("s")).alias("open"), F.count(F.lit(1)).alias("n")).where("a < z").select("m", "open", "n")
    of_m = written(of_m, "minimisers")
    total = scan.agg(F.coalesce(F.sum(F.size("stretches")), F.lit(0))).first()[0]
    some = written(spread_join(each, of_m, "m", "n", total).select("rid", "ord", "s", "open"), "stretches")
    of_s = written(some.groupBy("s").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count(F.lit(1)).alias("n")), "firsts")
    return spread_join(some, of_s, "s", "n", some.count()).select("rid", "ord", "s", "first", (F.col("last") > F.col("first")).alias("again"), "open")


def open_windows(candidates: DataFrame, least: int) -> DataFrame:
    """w, rid, ord of the windows of the stretches that no earlier document has as they are but that differ from others of their minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, order, text, found in zip(*(b.column(c).to_pylist() for c in ("rid", "ord", "text", "found"))):
                wanted = np.array([x["s"] for x in found if x["open"] and x["first"] == order], np.int64)
                if len(wanted):
                    rolling, starts, ends, _, s = stretches(Words(text), least)
                    here = np.isin(s, wanted)
                    at = spread(starts[here], ends[here])
                    w = np.unique(rolling.of(at, at + least).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.full(len(w), rid, np.int64)), pa.array(np.full(len(w), order, np.int64))], ["w", "rid", "ord"])

    return candidates.select("rid", "ord", "text", "found").mapInArrow(run, "w long, rid long, ord long")


def spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of some ranges, one after the other."""
    sizes = ends - starts
    last = np.cumsum(sizes)
    return np.repeat(starts - (last - sizes), sizes) + np.arange(last[-1] if len(last) else 0)


def passages(candidates: DataFrame, shards: int, least: int) -> DataFrame:
    """shard, asked, rid, ord, start, words of the runs of windows that are references, or, asked, refer to a document of the shard.

    `candidates` has rid, ord, text, found (stretches) and windows (w, first) of each row.
    """

    def shard(order: np.ndarray) -> np.ndarray:
        return (mixed(order.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)

    def runs(of: np.ndarray) -> list[tuple[int, int, int]]:
        """(first window, end, shard) of the runs of equal shards, -1 being none."""
        cut = np.flatnonzero(of[1:] != of[:-1]) + 1
        return [(a, e, k) for a, e, k in zip([0, *cut.tolist()], [*cut.tolist(), len(of)], of[np.concatenate([[0], cut]).astype(int)].tolist()) if k >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for rid, order, text, found, windows in zip(*(b.column(c).to_pylist() for c in ("rid", "ord", "text", "found", "windows"))):
                words = Words(text)
                if words.n < least:
                    continue
                rolling, starts, ends, _, s = stretches(words, least)
                n = words.n - least + 1
                first, held = np.full(n, -1, np.int64), np.zeros(n, bool)
                known = {x["s"]: x for x in found}
                for a, e, k in zip(starts.tolist(), ends.tolist(), s.tolist()):
                    if k in known:
                        x = known[k]
                        if x["first"] < order:
                            first[a:e] = x["first"]
                        else:
                            held[a:e] = x["again"]
                if windows:
                    keys, firsts = np.array([x["w"] for x in windows], np.int64), np.array([x["first"] for x in windows], np.int64)
                    up = np.argsort(keys)
                    at = np.arange(n)
                    w = rolling.of(at, at + least).view(np.int64)
                    k = np.minimum(np.searchsorted(keys[up], w), len(keys) - 1)
                    there = (keys[up][k] == w) & (first < 0)
                    first[there & (firsts[up][k] < order)] = firsts[up][k][there & (firsts[up][k] < order)]
                    held |= there & (firsts[up][k] == order)
                mine = int(shard(np.array([order], np.int64))[0])
                for asked, of in ((False, np.where(held, mine, -1)), (True, np.where(first >= 0, shard(first), -1))):
                    for a, e, k in runs(of):
                        rows.append((k, asked, rid, order, a, bytes(words.data[words.starts[a] : words.ends[e + least - 2]])))
                        size += len(rows[-1][-1])
                if size > 4_000_000:
                    yield batch(rows)
                    rows, size = [], 0
        yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["shard", "asked", "rid", "ord", "start", "words"])

    return candidates.mapInArrow(run, "shard int, asked boolean, rid long, ord long, start long, words binary")


class SuffixAutomaton:
    """Of several sequences of words, added in ascending order of their documents; each state knows the first document of its words."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def _new(self, length: int, doc: int, following: dict[bytes, int]) -> int:
        self.next.append(following), self.link.append(0), self.length.append(length), self.first.append(doc)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """A state for the words that reach q by way of p alone."""
        r = self._new(self.length[p] + 1, self.first[q], dict(self.next[q]))
        self.link[r], self.link[q] = self.link[q], r
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = r
            p = self.link[p]
        return r

    def add(self, words: list[bytes], doc: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            now, p = self._new(self.length[last] + 1, doc, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = now

    def spans(self, words: list[bytes], doc: int, least: int) -> list[tuple[int, int]]:
        """Maximal spans of words whose windows of `least` words all occur in a document before this one."""
        following, link, length, first = self.next, self.link, self.length, self.first
        out: list[tuple[int, int]] = []
        state, match = 0, 0
        for i, word in enumerate(words):
            while state and word not in following[state]:
                state = link[state]
                match = length[state]
            if word in following[state]:
                state = following[state][word]
                match += 1
            while state and length[link[state]] >= least:  # the state of the last `least` words
                state = link[state]
                match = length[state]
            if match >= least and first[state] < doc:
                a = i + 1 - least
                if out and a <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((a, i + 1))
        return out


def matched(found: DataFrame, least: int) -> DataFrame:
    """rid, start, end: spans of words to remove, from the passages of all shards."""
    spark = found.sparkSession
    size = F.length("words").cast("double") / 6
    parts = found.groupBy("shard").agg(F.ceil(F.greatest(F.sum(F.when(F.col("asked"), size).otherwise(0.0)), F.lit(1.0)) / PART_WORDS).cast("int").alias("parts"))
    one, each = F.array(F.pmod(F.xxhash64("rid", "start"), F.col("parts")).cast("int")), F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = found.join(parts, "shard").select("shard", F.explode(F.when(F.col("asked"), one).otherwise(each)).alias("part"), "asked", "ord", "rid", "start", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton = None, SuffixAutomaton()
        for b in batches:
            rows = []
            for shard, part, asked, order, rid, start, words in zip(*(b.column(c).to_pylist() for c in ("shard", "part", "asked", "ord", "rid", "start", "words"))):
                if (shard, part) != now:
                    now, automaton = (shard, part), SuffixAutomaton()
                if asked:
                    rows += [(rid, start + a, start + e) for a, e in automaton.spans(words.split(), order, least)]
                else:
                    automaton.add(words.split(), order)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], ["rid", "start", "end"])

    return dealt.repartition(partitions(spark), "shard", "part").sortWithinPartitions("shard", "part", "asked", "ord").mapInArrow(run, "rid long, start long, end long")


class Repeats:
    """What documents repeat of earlier ones: `scan` has a row for each of them, `spans` (rid, spans) the words to remove where there are some."""

    def __init__(self, docs: DataFrame, least: int = LEAST):
        self.least = least
        key = row_key(docs["doc_id"], text_or_empty().cast("string").cast("binary"))
        self.key = F.xxhash64(key)  # of equal rows the same; if others share it, they are looked at for each other's candidates and no more
        named = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), self.key.alias("rid"), text_or_empty().cast("string").alias("text"))
        self.scan = written(scanned(named, least), "scan")
        found = written(shared_stretches(self.scan), "found")
        lists = found.groupBy("rid").agg(F.collect_list(F.struct("s", "first", "again", "open")).alias("found"))
        self.candidates = written(named.hint("merge").join(lists.hint("merge"), "rid").dropDuplicates(["rid", "ord", "text"]), "candidates")
        windows = open_windows(self.candidates, least)
        firsts = written(windows.groupBy("w").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").drop("last"), "windows")
        again = written(spread_join(windows, firsts, "w", "n", found.count() * least).select("rid", "ord", "w", "first"), "again")
        held = found.where("first = ord AND again").count() * (least // 2) + again.where("first = ord").count()
        shards = max(1, -(-held // SHARD_WORDS))
        lists = again.groupBy("rid").agg(F.collect_list(F.struct("w", "first")).alias("windows"))
        found = written(passages(self.candidates.join(lists, "rid", "left"), shards, least), "passages")
        spans = matched(found, least).groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        self.spans = written(spans, "spans")


def kept_words(n: int, spans: list) -> np.ndarray:
    keep = np.ones(n, bool)
    for x in spans or []:
        keep[x["start"] : x["end"]] = False
    return keep


def digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row.

    Null and empty texts have no words. Rows without a doc_id stand behind all others and
    repeat nothing of each other, nor do rows of the same doc_id. Repeated rows have equal
    results. Texts of any length count whole. An empty table gives no rows; other columns
    are left out, whatever their names.
    """
    r = Repeats(docs, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, kept = [], []
            for t, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                w = Words(t)
                keep = kept_words(w.n, spans)
                removed.append(int((~keep).sum()))
                kept.append(hashlib.sha256(w.joined(keep)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["rid", "n_removed", "kept"])

    cut = r.candidates.join(r.spans, "rid").select("rid", "text", "spans").mapInArrow(run, "rid long, n_removed long, kept string")
    return r.scan.join(cut, "rid", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256"))


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The table with the words removed from its texts; where none is, a text stays as it is. Other columns stay."""
    r = Repeats(docs, least)
    rid, spans = free_name(docs, "rid"), free_name(docs, "spans")
    plain = docs.columns
    text = plain.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for t, s in zip(b.column(text).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                w = Words(t) if s else None
                new.append(w.joined(kept_words(w.n, s)).decode() if w else t)
            yield pa.RecordBatch.from_arrays([*b.columns[:text], pa.array(new, b.schema.field(text).type), *b.columns[text + 1 : -1]], names=plain)

    joined = docs.withColumn(rid, r.key).join(r.spans.toDF(rid, spans), rid, "left").select(*[F.col(f"`{c}`") for c in plain], spans)
    return joined.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM v GROUP BY h),
g AS (SELECT doc_id, i, 1 AS hit FROM v JOIN f USING (h) WHERE first < doc_id),
k AS (SELECT p.doc_id, p.i, p.w, max(coalesce(hit, 0)) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.i = p.i),
s AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, sha256(coalesce(string_agg(CASE WHEN gone = 0 THEN w END, ' ' ORDER BY i), '')) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept, sha256('')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""
