"""Byte-level BPE: DuckDB recursive queries in every task encode and decode.

Every task cuts its texts into the pieces of the pattern. A piece that isn't a token
itself is cut once more where two bytes meet that are neighbours in no token: no
merge ever crosses there. Each distinct part that the worker doesn't know yet goes to
DuckDB, running inside the task's worker. There, rows of token positions join the
merge table; per step and part the leftmost pair of the smallest rank is contracted,
until no pair of a part is in the table. Decoding joins the ids to the table of token
bytes and puts them together by an ordered aggregation.
"""
from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks
from .common import table

#: Bytes of the parts of one recursive query and of a window of a longer part, and ids of one decoding query: these bound a query's memory.
ENCODE_BYTES, WINDOW, DECODE_IDS = 400_000, 4096, 200_000
#: Tokens on either side of a border of windows that are contracted anew.
SEAM = 8
#: Memory that a worker's DuckDB may use.
MEMORY = "300MB"

# The recursion keeps the latest tokens of each part alone. Other places of the contracted
# pair in a part are contracted in the same step, unless that could put off a pair of
# smaller rank: `risks` has the neighbours with which a fresh token makes such a pair.
CONTRACT = """
WITH RECURSIVE state(part, toks) USING KEY (part) AS (
    SELECT part, toks FROM words
    UNION
    (WITH pairs AS (
        SELECT part, unnest(range(1, len(toks))) AS pos, unnest(toks[:-2])::BIGINT AS a, unnest(toks[2:]) AS b FROM state WHERE len(toks) > 1),
    hits AS (SELECT p.part, p.pos, m.rank FROM pairs p JOIN merges m ON m.pair = p.a * 65536 + p.b),
    least AS (SELECT part, min(rank) AS rank FROM hits GROUP BY part),
    places AS (SELECT h.part, h.pos, h.rank, row_number() OVER (PARTITION BY h.part ORDER BY h.pos) AS i FROM hits h JOIN least l ON h.part = l.part AND h.rank = l.rank),
    apart AS (SELECT part, pos, rank, i FROM (SELECT *, min(pos) OVER (PARTITION BY part, pos - i) AS head FROM places) WHERE (pos - head) % 2 = 0),
    beside AS (SELECT k.part, k.rank, s.toks[k.pos - 1] AS x, s.toks[k.pos + 2] AS y FROM apart k JOIN state s ON s.part = k.part
        WHERE k.rank IN (SELECT merged FROM risks) AND k.part IN (SELECT part FROM apart WHERE i > 1)),
    risky AS (SELECT n.part FROM beside n JOIN risks r ON r.merged = n.rank AND r.before = n.x
        UNION SELECT n.part FROM beside n JOIN risks r ON r.merged = n.rank AND r.after = n.y
        UNION SELECT n.part FROM beside n JOIN risks r ON r.merged = n.rank AND r.after = n.rank),
    chosen AS (SELECT part, pos, rank FROM apart WHERE i = 1 OR part NOT IN (SELECT part FROM risky)),
    counts AS (SELECT part, count(*) AS n, min(pos) AS pos, min(rank) AS rank FROM chosen GROUP BY part),
    spread AS (SELECT s.part, unnest(range(1, len(s.toks) + 1)) AS pos, unnest(s.toks) AS tok FROM state s WHERE s.part IN (SELECT part FROM counts WHERE n > 1))
    SELECT s.part, s.toks[:c.pos - 1] || [c.rank] || s.toks[c.pos + 2:] FROM state s JOIN counts c ON s.part = c.part WHERE c.n = 1
    UNION ALL
    SELECT t.part, list(coalesce(c.rank, t.tok) ORDER BY t.pos) FROM spread t
        LEFT JOIN chosen c ON c.part = t.part AND c.pos = t.pos LEFT JOIN chosen d ON d.part = t.part AND d.pos = t.pos - 1
        WHERE d.part IS NULL GROUP BY t.part)
)
SELECT part, toks AS ids FROM state ORDER BY part
"""

DECODE = """
SELECT run, string_agg(v.hex, '' ORDER BY pos) AS hex
FROM (SELECT run, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM runs) t JOIN vocab v USING (id)
GROUP BY run
"""


class RankBpe:
    """Encoder and decoder of one rank file, in one worker."""

    def __init__(self, file: str, pattern: str):
        import duckdb
        import regex

        self.pieces_of = regex.compile(pattern).findall
        with open(file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.stays: dict[tuple[int, int], bool] = {}
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.inside = np.zeros((256, 256), bool)  # two bytes that are neighbours in some token
        for t in self.ranks:
            self.inside[list(t[:-1]), list(t[1:])] = True
        con = self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        con.execute("SET preserve_insertion_order = false")
        items = sorted(self.ranks.items(), key=lambda x: x[1])
        # a pair may merge if its bytes together are a token: every cut of every token into two tokens
        cuts = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in items for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, r = np.array(cuts, np.int64).reshape(-1, 3).T
        before, after = b > r, a > r  # a merged token that is the second, or the first, of a pair of smaller rank
        none = lambda x: pa.nulls(int(x.sum()), pa.int32())
        whole = lambda x: pa.array(x.astype(np.int32))
        risks = {"merged": [whole(b[before]), whole(a[after])], "before": [whole(a[before]), none(after)], "after": [none(before), whole(b[after])]}
        made = {
            "vocab": pa.table({"id": pa.array([r for _, r in items], pa.int32()), "hex": [t.hex() for t, _ in items]}),
            "merges": pa.table({"pair": pa.array(a * 65536 + b), "rank": whole(r)}),
            "risks": pa.table({k: pa.chunked_array(v) for k, v in risks.items()}),
        }
        for name, rows in made.items():
            con.register("made", rows)
            con.execute(f"CREATE TABLE {name} AS SELECT * FROM made")
            con.unregister("made")
        self.texts = chunks.ChunkEncoder(self.encode_chunks)
        self.parts = chunks.IdStore(self.contract)

    def encode_chunks(self, new: list[str]) -> list[bytes]:
        # a chunk of letters, or of a blank and letters, is one piece of the pattern
        cut = [[c] if c.isalpha() or (c[0] == " " and c[1:].isalpha()) else self.pieces_of(c) for c in new]
        pieces = list({p for c in cut for p in c})
        ids = dict(zip(pieces, self.encode_pieces([p.encode() for p in pieces])))
        return [ids[c[0]] if len(c) == 1 else b"".join([ids[p] for p in c]) for c in cut]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece: its own if it is a token, else those of its parts."""
        whole = [self.ranks.get(p) for p in pieces]
        out = [b"" if w is None else w.to_bytes(4, "little") for w in whole]
        rest = [i for i, w in enumerate(whole) if w is None and pieces[i]]
        if not rest:
            return out
        data = np.frombuffer(b"".join([pieces[i] for i in rest]), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(pieces[i]) for i in rest])])
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ~self.inside[data[:-1], data[1:]]
        cut[at] = True
        cuts = np.flatnonzero(cut)
        dealt = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        ids, ends = self.parts.gather(self.parts.numbers(dealt.dictionary.to_pylist())[dealt.indices.to_numpy()])
        raw, ends = ids.astype("<u4", copy=False).tobytes(), (ends[np.searchsorted(cuts, at)] * 4).tolist()
        for i, a, e in zip(rest, ends, ends[1:]):
            out[i] = raw[a:e]
        return out

    def contract(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part, as bytes; one that is longer than a window goes in windows."""
        out = [b""] * len(parts)
        short = [i for i, p in enumerate(parts) if len(p) <= WINDOW]
        for i, x in zip(short, self._contracted([parts[i] for i in short])):
            out[i] = x
        for i, p in enumerate(parts):
            if len(p) > WINDOW:
                out[i] = self._windows(p)
        return out

    def _text(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def _tokens(self, parts: list[bytes]) -> list[array]:
        return [array("I", x) for x in self._contracted(parts)]

    def _stay(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Whether two tokens side by side stay as they are."""
        if len(self.stays) > 200_000:
            self.stays.clear()
        new = [x for x in set(pairs) if x not in self.stays]
        for x, got in zip(new, self._tokens([self._text(x) for x in new])):
            self.stays[x] = tuple(got) == x
        return [self.stays[x] for x in pairs]

    def _windows(self, part: bytes) -> bytes:
        """Ids of a part that is longer than a window.

        A sequence of tokens is the one that contraction ends in if each two neighbours
        stay as they are when contracted by themselves: the first contraction across a
        border of tokens would happen to the two beside it alone as well. So windows are
        contracted apart, the tokens around their borders together, and neighbours there
        are tested. Where they don't stay, the next window is contracted once more from
        the last tokens that are settled.
        """
        parts = [part[k : k + WINDOW] for k in range(0, len(part), WINDOW)]
        done, own = array("I"), False  # own: the last tokens are those of the last window alone
        for first in range(0, len(parts), 500):  # bounds what waits for its borders
            some = self._tokens(parts[first : first + 500])
            seams = self._tokens([self._text([*a[-SEAM:], *b[:SEAM]]) for a, b in zip(some, some[1:])])
            asked = [[(a[-SEAM - 1], m[0]), (m[-1], b[SEAM])] if min(len(a), len(b)) > 2 * SEAM else [] for a, m, b in zip(some, seams, some[1:])]
            stay = iter(self._stay([x for p in asked for x in p]))
            good = [bool(p) and all([next(stay) for _ in p]) for p in asked]
            for i, now in enumerate(some):
                if not done:
                    done, own = now[:], True
                elif i and own and good[i - 1]:
                    del done[-SEAM:]
                    done.extend(seams[i - 1])
                    done.extend(now[SEAM:])
                else:
                    own = self._join(done, now, parts[first + i])
        return done.tobytes()

    def _join(self, done: array, now: array, text: bytes) -> bool:
        """Appends a window, given by its own tokens and its text, to settled tokens; whether the last tokens are still the window's own."""
        for k in (SEAM, 8 * SEAM):
            (m,) = self._tokens([self._text([*done[-k:], *now[:k]])])
            pairs = [(x, m[0]) for x in done[-k - 1 : -k]] + [(m[-1], x) for x in now[k : k + 1]]
            if all(self._stay(pairs)):
                del done[-k:]
                done.extend(m)
                done.extend(now[k:])
                return len(now) > k + SEAM + 1
        k = SEAM
        while True:
            (m,) = self._tokens([self._text(done[-k:]) + text])
            if len(done) <= k or all(self._stay([(done[-k - 1], m[0])])):
                del done[-k:]
                done.extend(m)
                return False
            k *= 2

    def _contracted(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part by the recursive query. Parts of like length go together, as they end in like steps."""
        out: list[bytes] = [b""] * len(parts)
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        k = 0
        while k < len(order):
            stop, size = k, 0
            while stop < len(order) and (stop == k or size + len(parts[order[stop]]) <= ENCODE_BYTES):
                size += len(parts[order[stop]])
                stop += 1
            some = order[k:stop]
            offsets = np.concatenate([[0], np.cumsum([len(parts[i]) for i in some])]).astype(np.int32)
            flat = self.byte_id[np.frombuffer(b"".join([parts[i] for i in some]), np.uint8)]
            self.con.register("words", pa.table({"part": pa.array(range(len(some)), pa.int32()), "toks": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}))
            got = self.con.sql(CONTRACT).to_arrow_table()
            self.con.unregister("words")
            ids = got.column("ids").combine_chunks()
            raw, at = ids.flatten().to_numpy().astype("<u4").tobytes(), ids.offsets.to_numpy()
            at = ((at - at[0]) * 4).tolist()
            for i, a, e in zip(some, at, at[1:]):
                out[i] = raw[a:e]
            k = stop
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each text from its ids. A text goes in runs of positions, some runs at a time."""
        runs = [(i, k, min(k + DECODE_IDS, len(x) // 4)) for i, x in enumerate(ids) for k in range(0, len(x) // 4, DECODE_IDS)]
        parts: list[list[bytes]] = [[] for _ in ids]
        k = 0
        while k < len(runs):
            stop, size = k, 0
            while stop < len(runs) and (stop == k or size + runs[stop][2] - runs[stop][1] <= DECODE_IDS):
                size += runs[stop][2] - runs[stop][1]
                stop += 1
            some = runs[k:stop]
            offsets = np.concatenate([[0], np.cumsum([e - a for _, a, e in some])]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join([ids[i][a * 4 : e * 4] for i, a, e in some]), "<i4"))
            self.con.register("runs", pa.table({"run": pa.array(range(len(some)), pa.int32()), "ids": pa.ListArray.from_arrays(pa.array(offsets), flat)}))
            got = dict(self.con.execute(DECODE).fetchall())
            self.con.unregister("runs")
            for r, (i, _, _) in enumerate(some):
                parts[i].append(bytes.fromhex(got[r]))
            k = stop
        return [p[0] if len(p) == 1 else b"".join(p) for p in parts]


_WORKER: dict[tuple[str, str], RankBpe] = {}


def worker_bpe(file: str, pattern: str) -> RankBpe:
    if (file, pattern) not in _WORKER:
        _WORKER[file, pattern] = RankBpe(file, pattern)
    return _WORKER[file, pattern]


def encode_decode(docs: DataFrame, file: str, pattern: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row, and with `keep` the ids (array<int>) and the decoded bytes.

    Null text counts as empty: no ids. Repeated rows and equal ids give a row each; an
    empty table gives none; other columns are left out, whatever their names. Very long
    texts are encoded and decoded whole. No shuffle; a task holds its dictionaries of
    chunks and parts, which are bounded, and some rows.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(file, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                some = b.slice(k, 2000)
                ids = bpe.texts.lists(some.column("text"))
                back = bpe.decode(ids)
                cols = [
                    some.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    cols += [pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), pa.array(back, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode_decode(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
