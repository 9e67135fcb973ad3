"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte goes if a string of ``MATCH`` bytes that covers it also starts in a document with a smaller
id. Suffixes are sorted where strings can repeat:

* Of every ``MATCH``-byte window the 16-byte gram with the smallest hash (the leftmost of equals) is its
  anchor, so equal windows have the same anchor at the same place; about one byte in 19 is an anchor.
  Anchors are dealt by hash to parts, and those whose gram stands in one document only are left out.
* The suffixes at the anchors that are left (``MATCH`` bytes of them, and the bytes before that a window
  can reach) are sorted in runs. Runs are front-coded: of each suffix the length of the prefix that it has
  in common with the one before, and the rest. They are cut at splitters, quantiles of a sample by hash,
  and each range of suffixes is exchanged to one task.
* A task merges the front-coded runs by a loser tree. Each head carries the length of its common prefix with
  the last suffix put out; the longer one wins without a look at the text, and only equal lengths compare
  further bytes, from that length on.
* Common prefixes of neighbours give, for every reach to the left of the anchor, the intervals of suffixes that
  agree to the right; sorted left contexts give those that agree to the left. Suffixes that agree in both have
  the same window, and the smallest id among them decides.

Skew: equal texts are folded to their smallest id before all this. Equal contexts are folded within a run.
Grams that are frequent within one batch of texts (``OFTEN``), or over all (``MOST`` entries), never meet in
a task: their windows are folded by content in the batch and then by an aggregate with partial sums, and go
back to their documents by a join that can split.

Only splitters (as many as ranges) go through the driver. Texts are read in slices, so memory doesn't follow a
text's length. ``run_bytes`` and ``part_bytes`` can be raised with the executors' memory.

Defined results: null texts count as empty; texts under ``MATCH`` bytes lose nothing. Repeated rows of one id
don't remove from one another and each get a row. A null id neither removes nor loses bytes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abaculus.llm.shared import Workspace, broadcast_if_small, give_back, prepare_workers

MATCH, GRAM = 50, 16
REACH = MATCH - GRAM  # the bytes of a window that can stand before its anchor
SLICE, RUN_BYTES, PART_BYTES = 1 << 20, 2 << 20, 8 << 20
RUN_ENTRIES, RANGE_ENTRIES = 1 << 16, 1 << 16
#: Anchors with one gram in one batch of texts, and over all, beyond which their windows are folded by content.
OFTEN, MOST = 64, 100_000
SAMPLE = 64  # one gram in so many is sampled for the splitters
LEAST_PARTS = 32
GONE_ROWS = 400_000  # documents with removed spans that are broadcast at most

MEMBER = "array<struct<doc_id: long, mark: long, pos: long>>"
FOUND = f"part int, kind string, data binary, doc_id long, mark long, pos long, often boolean, prefix long, content binary, ahead int, o_lo int, o_hi int, members {MEMBER}"


def dump(*arrays: np.ndarray) -> bytes:
    return b"".join(x for a in arrays for x in (struct.pack("<2sQ", a.dtype.str[1:].encode(), a.nbytes), a.tobytes()))


def load(data: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<2sQ", data, at)
        size = np.dtype(kind.decode()).itemsize
        out.append(np.frombuffer(data, kind.decode(), n // size, at + 10))
        at += 10 + n
    return out


# --- anchors -------------------------------------------------------------------------------------


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place of ``b``."""
    x = b.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    h = x[:-8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h += x[8:]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def anchors(b: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window, last window) of the anchors in ``b``; ``end[i]`` is where the text at i ends."""
    none = np.empty(0, np.int64)
    if len(b) < MATCH:
        return none, none.astype(np.uint64), none, none
    h = gram_hashes(b)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    wide, width = 1, MATCH - GRAM + 1
    while wide * 2 <= width:
        key, wide = np.minimum(key[:-wide], key[wide:]), wide * 2
    key = np.minimum(key[: len(key) - (width - wide)], key[width - wide :])
    start = np.flatnonzero(np.arange(len(key)) + MATCH <= end[: len(key)])
    at = (key[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(at):
        return none, none.astype(np.uint64), none, none
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.r_[new[1:], len(at)] - 1
    return at[new], h[at[new]], start[new], start[last]


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Lists of (doc_id, mark, offset, bytes) of about ``most`` bytes; a longer text comes in overlapping slices."""
    held, out = 0, []
    for batch in batches:
        ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, value in enumerate(batch.column(2)):
            data = value.as_buffer()
            view = memoryview(data) if data is not None else b""
            for at in range(0, max(len(view) - MATCH, 0) + 1, SLICE):
                piece = bytes(view[at : at + SLICE + MATCH - 1])
                if len(piece) < MATCH:
                    continue
                out.append((ids[i], marks[i], at, piece))
                held += len(piece)
                if held >= most:
                    yield out
                    held, out = 0, []
    if out:
        yield out


def _empty(**columns) -> dict:
    return {"part": 0, "kind": "", "data": None, "doc_id": None, "mark": None, "pos": None, "often": None, "prefix": None, "content": None, "ahead": None, "o_lo": None, "o_hi": None, "members": None} | columns


_FOUND = pa.schema([
    ("part", pa.int32()), ("kind", pa.string()), ("data", pa.binary()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("pos", pa.int64()), ("often", pa.bool_()), ("prefix", pa.int64()),
    ("content", pa.binary()), ("ahead", pa.int32()), ("o_lo", pa.int32()), ("o_hi", pa.int32()), ("members", pa.list_(pa.struct([("doc_id", pa.int64()), ("mark", pa.int64()), ("pos", pa.int64())]))),
])


def _classes(parts: int, rows: Iterator[tuple[bytes, int, int, int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Rows (content, ahead, o_lo, o_hi, doc_id, mark, pos) folded by content; each keeps its members."""
    held: dict[tuple, list] = {}
    for content, ahead, lo, hi, doc, mark, pos in rows:
        held.setdefault((content, ahead, lo, hi), []).append({"doc_id": doc, "mark": mark, "pos": pos})
    out = [_empty(part=zlib.crc32(k[0]) % parts, kind="class", content=k[0], ahead=k[1], o_lo=k[2], o_hi=k[3], members=m) for k, m in held.items()]
    for at in range(0, len(out), 2048):
        yield pa.RecordBatch.from_pylist(out[at : at + 2048], _FOUND)


def _deal_anchors(parts: int, run_bytes: int, most_in_batch: int):
    """Texts to blocks of anchors by part: hash (what the part doesn't tell), document and place; and classes of frequent grams."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _texts(batches, run_bytes):
            size = np.array([len(t[3]) for t in texts])
            first = np.cumsum(size) - size
            b = np.frombuffer(b"".join(t[3] for t in texts), np.uint8)
            place, h, lo, hi = anchors(b, np.repeat(first + size, size))
            if not len(place):
                continue
            text = np.searchsorted(first, place, "right") - 1
            by = np.argsort(h, kind="stable")
            new = np.flatnonzero(np.r_[True, np.diff(h[by]) != 0])
            count = np.diff(np.r_[new, len(by)])
            often = np.zeros(len(h), bool)
            often[by] = np.repeat(count > most_in_batch, count)
            part = (h % np.uint64(parts)).astype(np.int32)
            short = (h // np.uint64(parts)) & np.uint64((1 << 48) - 1)
            ids, marks = np.array([t[0] for t in texts], np.int64), np.array([t[1] for t in texts], np.int64)
            offset = np.array([t[2] for t in texts], np.int64)
            pos = place - first[text] + offset[text]
            sampled = h >> np.uint64(40) & np.uint64(SAMPLE - 1) == 0
            prefix = np.frombuffer(b.tobytes() + bytes(8), np.uint8)[place[sampled][:, None] + np.arange(8)] if sampled.any() else np.empty((0, 8), np.uint8)
            prefixes = np.zeros(len(h), np.int64)
            prefixes[sampled] = (prefix.copy().view(">u8").ravel() ^ np.uint64(1 << 63)).astype(np.int64)
            order = np.lexsort((short, part))
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            out = []
            for p in range(parts):
                at = order[cuts[p] : cuts[p + 1]]
                if not len(at):
                    continue
                few, many, some = at[~often[at]], at[often[at]], at[sampled[at] & ~often[at]]
                used, text_at = np.unique(text[few], return_inverse=True)
                many_first = np.flatnonzero(np.r_[True, np.diff(short[many]) != 0]) if len(many) else np.empty(0, np.int64)
                where = pos[few].astype(np.uint32 if not len(few) or pos[few].max() < 1 << 32 else np.int64)
                if len(few) and where.max() < 1 << 16:
                    where = where.astype(np.uint16)
                data = dump(
                    (short[few] >> np.uint64(32)).astype(np.uint16), (short[few] & np.uint64(0xFFFFFFFF)).astype(np.uint32), text_at.astype(np.uint16 if len(used) < 1 << 16 else np.uint32), where, ids[used], marks[used],
                    short[many][many_first], np.minimum.reduceat(ids[text[many]], many_first) if len(many) else ids[:0], np.maximum.reduceat(ids[text[many]], many_first) if len(many) else ids[:0], short[some], prefixes[some],
                )
                out.append(_empty(part=p, kind="block", data=data))
            for at in range(0, len(out), 512):
                yield pa.RecordBatch.from_pylist(out[at : at + 512], _FOUND)
            raw = b.tobytes()
            hot = np.flatnonzero(often)
            yield from _classes(parts, ((raw[lo[i] : hi[i] + MATCH], int(place[i] - lo[i]), int(place[i] - hi[i]), int(place[i] - lo[i]), int(ids[text[i]]), int(marks[text[i]]), int(pos[i])) for i in hot))
        give_back()

    return deal


def _keep_repeated(table: pa.Table, most: int) -> pa.Table:
    """The anchors of one part whose gram stands in two documents; frequent ones are marked. Classes pass."""
    kinds = np.array(table.column("kind").to_pylist())
    blocks = [load(d) for d in table.filter(pa.array(kinds == "block")).column("data").to_pylist()]
    out = [table.filter(pa.array(kinds == "class"))]
    if blocks:
        join = lambda i: np.concatenate([x[i] for x in blocks])
        short = np.concatenate([x[0].astype(np.uint64) << np.uint64(32) | x[1] for x in blocks])
        doc, mark = (np.concatenate([x[i][x[2]] for x in blocks]) for i in (4, 5))
        pos = np.concatenate([x[3].astype(np.int64) for x in blocks])
        both, low, high = np.r_[short, join(6)], np.r_[doc, join(7)], np.r_[doc, join(8)]
        by = np.argsort(both, kind="stable")
        new = np.flatnonzero(np.r_[True, np.diff(both[by]) != 0])
        if len(by):
            count = np.diff(np.r_[new, len(by)])
            repeated = np.minimum.reduceat(low[by], new) < np.maximum.reduceat(high[by], new)
            often = (np.add.reduceat((by >= len(short)).astype(int), new) > 0) | (count > most)
            flag = np.zeros(len(both), np.int8)
            flag[by] = np.repeat(np.where(repeated, 1 + often, 0), count)
            kept = np.flatnonzero(flag[: len(short)])
            n = len(kept)
            null = lambda kind: pa.nulls(n, kind)
            columns = {"part": pa.array(np.zeros(n, np.int32)), "kind": pa.array(["pos"] * n, pa.string()), "doc_id": pa.array(doc[kept]), "mark": pa.array(mark[kept]), "pos": pa.array(pos[kept]), "often": pa.array(flag[kept] == 2)}
            out.append(pa.table([columns.get(f.name, null(f.type)) for f in _FOUND], schema=_FOUND))
            some, prefix = join(9), join(10)
            grams = both[by][new]
            hit = flag[by][new][np.minimum(np.searchsorted(grams, some), len(grams) - 1)] == 1
            rows = [_empty(kind="sample", prefix=int(p)) for p in prefix[hit]]
            out.append(pa.Table.from_pylist(rows, _FOUND))
    give_back()
    return pa.concat_tables([t.cast(_FOUND) for t in out])


# --- front-coded runs ----------------------------------------------------------------------------


def contexts(b: np.ndarray, place: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place the MATCH bytes from it on and the REACH bytes before it, nearest first, both filled with
    zeros beyond the text (``begin`` to ``end``), and a last byte that holds the length."""
    padded = np.concatenate([np.zeros(REACH, np.uint8), b, np.zeros(MATCH, np.uint8)])
    right = np.lib.stride_tricks.sliding_window_view(padded, MATCH)[place + REACH]
    left = np.lib.stride_tricks.sliding_window_view(padded, REACH)[place][:, ::-1]
    out = []
    for side, room in ((right, end - place), (left, place - begin)):
        n = np.minimum(room, side.shape[1])
        out.append(np.concatenate([np.where(np.arange(side.shape[1]) < n[:, None], side, 0), n[:, None]], axis=1, dtype=np.uint8, casting="unsafe"))
    return out[0], out[1]


def sort_order(side: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(side).view(f"S{side.shape[1]}").ravel(), kind="stable")


def common(side: np.ndarray) -> np.ndarray:
    """Lengths of the common prefix of each row and the one before (0 for the first); rows end with their length."""
    if not len(side):
        return np.empty(0, np.uint8)
    differ = side[1:] != side[:-1]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), side.shape[1])
    return np.r_[0, np.minimum(n, np.minimum(side[1:, -1], side[:-1, -1]))].astype(np.uint8)


def front_coded(right: np.ndarray, left: np.ndarray, doc: np.ndarray, mark: np.ndarray, pos: np.ndarray) -> bytes:
    """A sorted run: (suffixes: common prefix, length, rest), (left contexts of each suffix), (members of each context)."""
    new = np.r_[True, (right[1:] != right[:-1]).any(axis=1)]
    new_context = new | np.r_[True, (left[1:] != left[:-1]).any(axis=1)]
    at, at_context = np.flatnonzero(new), np.flatnonzero(new_context)
    suffix, lcp = right[at], common(right[at])
    length = suffix[:, -1]
    rest = suffix[:, :MATCH][(np.arange(MATCH) >= lcp[:, None]) & (np.arange(MATCH) < length[:, None])]
    contexts_of = np.diff(np.r_[np.searchsorted(at_context, at), len(at_context)]).astype(np.uint32)
    members_of = np.diff(np.r_[at_context, len(right)]).astype(np.uint32)
    return zstandard.ZstdCompressor(level=1).compress(dump(lcp, length, rest, contexts_of, left[at_context].ravel(), members_of, doc, mark, pos))


class Run:
    """A front-coded run read again."""

    def __init__(self, data: bytes):
        lcp, length, rest, self.contexts_of, left, self.members_of, self.doc, self.mark, self.pos = load(zstandard.ZstdDecompressor().decompress(data))
        self.length, self.left = length, left.reshape(-1, REACH + 1)
        self.lcp, self.suffixes = lcp.tolist(), []
        ends = np.cumsum(length.astype(np.int64) - lcp).tolist()
        raw, at, suffix = rest.tobytes(), 0, b""
        for n, end in zip(self.lcp, ends, strict=True):
            suffix = suffix[:n] + raw[at:end]
            self.suffixes.append(suffix)
            at = end


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Sorted runs (strings, common prefix of each with the one before) merged by a loser tree: (run, place in it,
    common prefix with the string put out before) of all strings in order.

    ``same[r]`` is the common prefix of run r's head and the last string put out (-1: the run is at its end). All losers on
    the winner's path have lost to it, so these lengths are known there; bytes before them are never compared again.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    strings = [s for s, _ in runs] + [[]] * (leaves - len(runs))
    shared = [c for _, c in runs] + [[]] * (leaves - len(runs))
    head = [0] * leaves
    same = [0 if s else -1 for s in strings]
    loser = [0] * leaves

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of the heads of two runs with equal ``same``; the loser gets its common prefix with the winner."""
        n = same[a]
        if n < 0:
            return a, b
        x, y = strings[a][head[a]], strings[b][head[b]]
        most = min(len(x), len(y))
        while n + 8 <= most and x[n : n + 8] == y[n : n + 8]:
            n += 8
        while n < most and x[n] == y[n]:
            n += 1
        if (y[n] < x[n]) if n < most else (len(y) < len(x)):
            a, b = b, a
        same[b] = n
        return a, b

    winners = list(range(leaves)) if leaves > 1 else [0]
    level, at = winners, leaves // 2
    while len(level) > 1:
        following = []
        for i in range(0, len(level), 2):
            a, b = level[i], level[i + 1]
            if same[a] < same[b]:
                a, b = b, a
            elif same[a] == same[b]:
                a, b = play(a, b)
            following.append(a)
            loser[at + i // 2] = b
        level, at = following, at // 2
    w = level[0]
    out_run, out_at, out_same = [], [], []
    while same[w] >= 0:
        i = head[w]
        out_run.append(w), out_at.append(i), out_same.append(same[w])
        i += 1
        head[w] = i
        same[w] = shared[w][i] if i < len(strings[w]) else -1
        node = (leaves + w) // 2
        while node:
            b = loser[node]
            if same[b] > same[w]:
                loser[node], w = w, b
            elif same[b] == same[w]:
                w, loser[node] = play(w, b)
            node //= 2
    return out_run, out_at, out_same


def reaches(suffix_of: np.ndarray, same: np.ndarray, length: np.ndarray, left: np.ndarray, least_doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each reach o to the left: (o, contexts that have such a window, smallest document with that window for each of them).

    ``same`` and ``length`` are of the sorted suffixes, ``suffix_of`` the suffix of each context, ``left`` the contexts' left bytes.
    """
    by_left = sort_order(left)
    left_same = common(left[by_left])
    for o in range(REACH + 1):
        has = np.flatnonzero((length[suffix_of] >= MATCH - o) & (left[:, -1] >= o))
        if not len(has):
            continue
        right_id = np.cumsum(same < MATCH - o)[suffix_of[has]]
        left_id = np.empty(len(left), np.int64)
        left_id[by_left] = np.cumsum(left_same < o)
        key = right_id * (len(left) + 1) + left_id[has]
        by = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.r_[True, np.diff(key[by]) != 0])
        least = np.empty(len(has), np.int64)
        least[by] = np.repeat(np.minimum.reduceat(least_doc[has][by], new), np.diff(np.r_[new, len(by)]))
        yield o, has, least


def _merge_range(table: pa.Table) -> pa.Table:
    """The runs of one range merged; (doc_id, mark, lo, hi) of the bytes around each anchor that stand in a smaller document too."""
    runs = [Run(d) for d in table.column("data").to_pylist()]
    run, at, same = (np.array(x, np.int64) for x in merge_runs([(r.suffixes, r.lcp) for r in runs]))
    stack = lambda f: np.concatenate([f(r) for r in runs])
    suffixes = np.cumsum([0, *(len(r.suffixes) for r in runs)])[run] + at
    length, contexts_of, members_of = stack(lambda r: r.length)[suffixes], stack(lambda r: r.contexts_of).astype(np.int64), stack(lambda r: r.members_of).astype(np.int64)
    place = np.empty(len(suffixes), np.int64)
    place[suffixes] = np.arange(len(suffixes))
    suffix_of = np.repeat(place, contexts_of)  # contexts and members stay as the runs have them
    context_of = np.repeat(np.arange(len(members_of)), members_of)
    doc, pos = stack(lambda r: r.doc), stack(lambda r: r.pos)
    least_doc = np.minimum.reduceat(doc, np.cumsum(members_of) - members_of)
    far, near = np.full(len(doc), -1), np.full(len(doc), -1)
    for o, has, least in reaches(suffix_of, same, length, stack(lambda r: r.left), least_doc):
        first = np.full(len(members_of), np.iinfo(np.int64).max)
        first[has] = least
        hit = doc > first[context_of]
        far[hit] = o
        near[hit & (near < 0)] = o
    hit = np.flatnonzero(far >= 0)
    give_back()
    return pa.table({"doc_id": doc[hit], "mark": stack(lambda r: r.mark)[hit], "lo": (pos - far)[hit], "hi": (pos - near + MATCH)[hit]})


def _cut_runs(splitters: np.ndarray, parts: int):
    """Texts with the places of their anchors to front-coded runs by range, and classes of frequent grams."""

    def sorted_run(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        right, left, doc, mark, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        by = sort_order(np.concatenate([right, left], axis=1))
        right, left, doc, mark, pos = right[by], left[by], doc[by], mark[by], pos[by]
        prefix = (np.ascontiguousarray(right[:, :8]).view(">u8").ravel() ^ np.uint64(1 << 63)).astype(np.int64)
        cuts = np.r_[0, np.searchsorted(prefix, splitters, "left"), len(prefix)]
        rows = [_empty(part=n, kind="run", data=front_coded(right[a:z], left[a:z], doc[a:z], mark[a:z], pos[a:z])) for n, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
        for at in range(0, len(rows), 64):
            yield pa.RecordBatch.from_pylist(rows[at : at + 64], _FOUND)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            for i in range(batch.num_rows):
                doc, mark, b = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), np.frombuffer(batch.column(2)[i].as_buffer() or b"", np.uint8)
                for column, often in ((3, False), (4, True)):
                    pos = np.unique(np.array(batch.column(column)[i].as_py(), np.int64))
                    for a in range(0, len(pos), 1 << 14):
                        some = pos[a : a + (1 << 14)]
                        base, top = max(0, int(some[0]) - REACH), min(len(b), int(some[-1]) + MATCH)
                        right, left = contexts(b[base:top], some - base, np.zeros(len(some), np.int64), np.full(len(some), top - base))
                        if often:
                            cut_out = lambda k: left[k, : left[k, -1]][::-1].tobytes() + right[k, : right[k, -1]].tobytes()  # noqa: B023, E731
                            yield from _classes(parts, ((cut_out(k), int(left[k, -1]), max(0, MATCH - int(right[k, -1])), int(left[k, -1]), doc, mark, int(some[k])) for k in range(len(some))))
                        else:
                            held.append((right, left, np.full(len(some), doc), np.full(len(some), mark), some))
                            n += len(some)
                if n >= RUN_ENTRIES:
                    yield from sorted_run(held)
                    held, n = [], 0
        if held:
            yield from sorted_run(held)
        give_back()

    return cut


# --- frequent grams ------------------------------------------------------------------------------


def _of_classes(classes: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, mark, lo, hi) from classes of equal contexts: their windows are folded by content over all classes."""
    first = F.col("members")[0]
    windows = classes.select(first.alias("key"), F.array_min(F.transform("members", lambda m: m["doc_id"])).alias("low"), F.array_max(F.transform("members", lambda m: m["doc_id"])).alias("high"), "content", "ahead", F.explode(F.sequence("o_lo", "o_hi")).alias("o"))
    windows = windows.select("key", "low", "high", "o", F.substring("content", F.col("ahead") - F.col("o") + 1, F.lit(MATCH)).alias("window"))
    repeated = ws.write(windows.groupBy("window").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first < last").select("window", "first"), "windows")
    hits = windows.join(broadcast_if_small(repeated), "window").where(F.col("first") < F.col("high")).groupBy("key").agg(F.collect_list(F.struct("o", "first")).alias("hits"))  # REACH + 1 at most
    members = classes.select(first.alias("key"), "members").join(hits, "key").select("hits", F.explode("members").alias("m"))
    before = members.select("m", F.transform(F.filter("hits", lambda h: h["first"] < F.col("m.doc_id")), lambda h: h["o"]).alias("o")).where(F.size("o") > 0)
    return before.select("m.doc_id", "m.mark", (F.col("m.pos") - F.array_max("o")).alias("lo"), (F.col("m.pos") - F.array_min("o") + MATCH).alias("hi"))


# --- the operator --------------------------------------------------------------------------------


def repeated_spans(docs: DataFrame, ws: Workspace, run_bytes: int = RUN_BYTES, part_bytes: int = PART_BYTES, often: int = OFTEN, most: int = MOST) -> DataFrame:
    """(doc_id, mark, spans) of ``docs`` (doc_id, mark, text), distinct in their keys: the merged spans to remove, as an array of (lo, hi)."""
    spark = docs.sparkSession
    data = docs.select("doc_id", "mark", F.col("text").cast("binary").alias("data"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-total // part_bytes))
    dealt = data.mapInArrow(_deal_anchors(parts, run_bytes, often), FOUND)
    found = ws.write(dealt.groupBy("part").applyInArrow(lambda table: _keep_repeated(table, most), FOUND), "found")
    anchored = found.where("kind = 'pos'")
    n = anchored.where("not often").count()
    ranges = max(1, -(-n // RANGE_ENTRIES))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = found.where("kind = 'sample'").agg(F.percentile_approx("prefix", shares, 10 * ranges)).first()[0] if shares else []
    splitters = np.unique(np.array(cuts or [], np.int64))
    places = anchored.groupBy("doc_id", "mark").agg(*[F.collect_list(F.when(c, F.col("pos"))).alias(a) for c, a in ((~F.col("often"), "few"), (F.col("often"), "many"))])  # of one text
    runs = data.join(places, ["doc_id", "mark"]).select("doc_id", "mark", "data", "few", "many").mapInArrow(_cut_runs(splitters, parts), FOUND)
    runs = ws.write(runs, "runs")
    merged = runs.where("kind = 'run'").select("part", "data").groupBy("part").applyInArrow(_merge_range, "doc_id long, mark long, lo long, hi long")
    columns = ("content", "ahead", "o_lo", "o_hi", "members")
    classes = found.where("kind = 'class'").select(*columns).union(runs.where("kind = 'class'").select(*columns))
    spans = merged.union(_of_classes(classes, ws)).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # of one text
    return ws.write(spans.mapInArrow(_merge_spans, "doc_id long, mark long, spans binary"), "spans")


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching spans of each document as one, packed as pairs of longs."""
    for batch in batches:
        out = []
        for spans in batch.column(2):
            lo, hi = (spans.values.field(n).to_numpy() for n in (0, 1))
            by = np.argsort(lo, kind="stable")
            lo, hi = lo[by], np.maximum.accumulate(hi[by])
            new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
            out.append(np.stack([lo[new], hi[np.r_[new[1:] - 1, len(hi) - 1]]], axis=1).astype(np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "mark", "spans"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for data, packed, whole in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            view = memoryview(data.as_buffer() or b"")
            spans = [(0, len(view))] if whole and len(view) >= MATCH else np.frombuffer(packed or b"", np.int64).reshape(-1, 2).tolist()
            edges = [0, *(x for span in spans for x in span), len(view)]
            kept = [view[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)]
            digest = hashlib.sha256()
            for part in kept:
                digest.update(part)
            removed = sum(z - a for a, z in spans)
            for name, x in (("n_bytes", len(view)), ("n_removed", removed), ("n_spans", len(spans)), ("kept_sha256", digest.hexdigest()), ("kept", b"".join(kept) if batch.num_columns > 4 else None)):
                rows[name].append(x)
        types = {"kept_sha256": pa.string(), "kept": pa.binary()}
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[c], types.get(c, pa.int64())) for c in rows]], ["doc_id", *rows])


def remove_repeats(docs: DataFrame, with_kept: bool = False, **sizes: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept`` (bytes; a cut can fall inside a
    character) is null unless asked for. ``sizes`` are those of ``repeated_spans``."""
    spark = docs.sparkSession
    prepare_workers(spark)
    ws = Workspace(spark, "suffix-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = docs.where("doc_id is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.xxhash64("text").alias("hash"))
    known = ws.write(known.distinct(), "known")

    # ids that stand for several texts are told apart by a mark
    repeated = ws.write(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again")), "repeated")
    if repeated.isEmpty():
        marked = lambda df, h: df.withColumn("mark", F.lit(0).cast("long"))
    else:
        of = broadcast_if_small(repeated)
        marked = lambda df, h: df.join(of, "doc_id", "left").withColumn("mark", F.when(F.col("again"), h).otherwise(0)).drop("again")
    docs, known = marked(docs, F.xxhash64("text")), marked(known, F.col("hash"))

    # of equal texts the smallest id takes part; the others lose all
    groups = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    copies = ws.write(known.join(broadcast_if_small(ws.write(groups, "groups")), "digest").where("doc_id > first").select("doc_id", "mark").distinct(), "copies")
    few = broadcast_if_small(copies, GONE_ROWS)
    first = docs.where("doc_id is not null").where(F.octet_length("text") >= MATCH).join(few, ["doc_id", "mark"], "left_anti").select("doc_id", "mark", "text")
    spans = repeated_spans(first, ws, **sizes)
    gone = ws.write(spans.withColumn("whole", F.lit(False)).unionByName(copies.select("doc_id", "mark", F.lit(None).cast("binary").alias("spans"), F.lit(True).alias("whole"))), "gone")
    with_spans = docs.join(broadcast_if_small(gone, GONE_ROWS), ["doc_id", "mark"], "left").select("doc_id", F.col("text").cast("binary").alias("data"), "spans", F.coalesce("whole", F.lit(False)).alias("whole"), *[F.lit(True).alias("with_kept")] * with_kept)
    return with_spans.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
