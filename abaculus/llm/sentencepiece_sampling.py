"""Sampled SentencePiece segmentation: forward filtering, backward sampling, and lossless decoding.

No piece of the model crosses from a word into the blank or the punctuation that
follows it, so the lattice of a text falls apart into units (blanks and the word
after them, a run of other characters, a line break). Each distinct unit of a batch is
filtered forward once: the log weight of a position is the log-sum over the
pieces that end there. Every occurrence is then sampled backward, with random
numbers that are a hash of the row's key, the unit's place and the step, so a
row's segmentation depends on its key and text only, not on batch or partition.

The model is a merge list, so a piece's weight follows Zipf's law over its rank,
``(rank + 1) ** -inverse_temperature``. Characters that are no piece fall back to
UTF-8 bytes, and so does a literal U+2581, which keeps decoding lossless.

Defined results: null counts as empty, and an empty text has no pieces; rows with
a null key are seeded as key 0; repeated rows get equal segmentations; extra
columns are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abaculus.llm.shared import give_back, prepare_workers

MODEL = "piece_bpe_32k.model"
#: Units that no piece crosses: words, other characters, line breaks. For a model with pieces that
#: do cross these, whole runs between blanks are the units.
FINE_UNIT = re.compile(r"\n| *(?:[^\W_]|(?<=²)\.)+| *(?:[^\w \n]|_)+| +")
COARSE_UNIT = re.compile(r" *[^ ]+| +")
CUT = re.compile(r"(?<=[^ ]) ")
CHUNK_CHARS = 300_000  # texts are worked off in slices of so many characters, a longer one in slices of whole units
MEMO_UNITS = 100_000  # units whose lattices a worker keeps (about 0.5 KB each)
_BASE = np.uint64(0x100000001B3)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PieceTable:
    """The model's pieces as a hash table of their prefixes, and the bytes each id decodes to."""

    def __init__(self, path: str, inverse_temperature: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        texts: dict[str, int] = {}
        decoded: list[bytes] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                decoded.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                decoded.append(b"")
            else:
                texts[piece.replace("▁", " ")] = i
                decoded.append(piece.replace("▁", " ").encode())
        self.unit = FINE_UNIT if all(FINE_UNIT.findall(t) == [t] for t in texts) else COARSE_UNIT
        self.logp = np.array([-inverse_temperature * np.log(1 + max(0.0, -sp.get_score(i))) if decoded[i] and not sp.is_byte(i) else 0.0 for i in range(n)])
        self.byte_logp = -inverse_temperature * np.log(n)
        self.lengths = np.array([len(b) for b in decoded])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(decoded), np.uint8)
        self.dtype = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.longest = max(map(len, texts))
        prefixes = {t[:k]: texts.get(t[:k], -1) for t in texts for k in range(1, len(t) + 1)}
        keys = np.zeros(len(prefixes), np.uint64)
        with np.errstate(over="ignore"):
            for r, p in enumerate(prefixes):
                h = 0
                for c in p:
                    h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
                keys[r] = h
        self.bits = 20
        self.slot_key = np.zeros(1 << self.bits, np.uint64)
        self.slot_piece = np.full(1 << self.bits, -2, np.int32)  # -2: no prefix, -1: prefix only
        self.probes = 1
        self.memo = Lattices(self)
        for h, at, piece in zip(keys, self._slot(keys), prefixes.values()):
            step = 1
            while self.slot_piece[at] != -2:
                at, step = (at + 1) & ((1 << self.bits) - 1), step + 1
            self.slot_key[at], self.slot_piece[at], self.probes = h, piece, max(self.probes, step)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id, -1 (prefix of pieces) or -2 (neither) per prefix hash."""
        at = self._slot(h)
        out = np.where(self.slot_key[at] == h, self.slot_piece[at], -2)
        for _ in range(self.probes - 1):
            at = (at + 1) & ((1 << self.bits) - 1)
            out = np.where((out == -2) & (self.slot_key[at] == h), self.slot_piece[at], out)
        return out

    def encode(self, texts: list[str], keys: np.ndarray, seed: int = 0) -> list[np.ndarray]:
        """Sampled ids of each text."""
        out: list[np.ndarray] = []
        group: list[tuple[int, str, int]] = []
        size, parts = 0, [[] for _ in texts]

        def flush() -> None:
            if group:
                for (row, _, _), ids in zip(group, self._sample(group, keys, seed)):
                    parts[row].append(ids)
                group.clear()

        for row, text in enumerate(texts):
            begin, place, body = 0, 0, " " + text if text else ""
            while begin < len(body):
                cut = CUT.search(body, begin + CHUNK_CHARS)
                piece = body[begin : cut.start() if cut else len(body)]
                group.append((row, piece, begin))
                begin, size = begin + len(piece), size + len(piece)
                if size >= CHUNK_CHARS:
                    flush()
                    size = 0
        flush()
        for p in parts:
            out.append(np.concatenate(p) if p else np.zeros(0, self.dtype))
        return out

    def _sample(self, group: list[tuple[int, str, int]], keys: np.ndarray, seed: int) -> list[np.ndarray]:
        lists = [self.unit.findall(body) for _, body, _ in group]
        counts = np.array([len(x) for x in lists])
        unit = self.memo.numbers(lists)
        first = np.cumsum(counts) - counts
        place = np.arange(len(unit)) - np.repeat(first, counts) + np.repeat(np.array([b for _, _, b in group]), counts)
        row_key = _mix(keys.astype(np.int64).view(np.uint64)[[r for r, _, _ in group]] + np.uint64(seed))
        noise = _mix(np.repeat(row_key, counts) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ids, per_unit = self.memo.sample(unit, noise)
        ends = np.cumsum(per_unit)[np.cumsum(counts) - 1]
        return np.split(ids.astype(self.dtype), ends[:-1])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the bytes of all pieces, less the blank put before the first word."""
        ids = ids.astype(np.int64)
        lengths = self.lengths[ids]
        skip = np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths)
        return self.bytes[np.arange(int(lengths.sum())) + skip].tobytes().decode()[1:]


class Appended:
    """An array that others are added to; its room doubles, so adding costs what is added."""

    def __init__(self, dtype: type):
        self.room, self.n = np.empty(1 << 16, dtype), 0

    def add(self, more: np.ndarray) -> None:
        end = self.n + len(more)
        if end > len(self.room):
            wider = np.empty(max(end, 2 * len(self.room)), self.room.dtype)
            wider[: self.n] = self.room[: self.n]
            self.room = wider
        self.room[self.n : end] = more
        self.n = end


class Lattices:
    """The filtered lattices of the units seen: per node its first incoming piece, per piece its
    share among those that end at its node (cumulative) and the node before it."""

    def __init__(self, table: PieceTable):
        self.table = table
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.final = Appended(np.int32)  # last node of each unit
        self.first = Appended(np.int32)  # first piece that ends at a node; -1 where a unit begins
        self.cum, self.piece, self.before = Appended(np.float64), Appended(np.int32), Appended(np.int32)
        self.uses = Appended(np.int32)

    def numbers(self, lists: list[list[str]]) -> np.ndarray:
        """Numbers of the units of all lists, in order; unseen units are filtered and added."""
        number = self.number
        if len(number) > MEMO_UNITS:  # keep those seen again, if that frees enough
            again = [u for u, n in zip(number, self.uses.room.tolist()) if n > 1]
            self.clear()
            number = self.number
            if 0 < len(again) < MEMO_UNITS // 2:
                self._add(again)
        fresh = set(filterfalse(number.__contains__, chain.from_iterable(lists)))
        if fresh:
            self._add(sorted(fresh))
        out = np.concatenate([np.fromiter(map(number.__getitem__, units), np.int64, len(units)) for units in lists])
        self.uses.room[: self.uses.n] += np.bincount(out, minlength=self.uses.n).astype(np.int32)
        return out

    def _add(self, units: list[str]) -> None:
        """Forward filtering of new units."""
        table = self.table
        sizes = np.array([len(u) for u in units])
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = len(points)
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(units)), sizes)
        until = np.repeat(begin + sizes, sizes)
        at, h = np.arange(n), np.zeros(n, np.uint64)
        froms, pieces, widths = [], [], []
        single = np.zeros(n, bool)
        for k in range(1, table.longest + 1):
            h = h * _BASE + (points[at + k - 1] + 1).astype(np.uint64)
            found = table.find(h)
            hit = found >= 0
            froms.append(at[hit]), pieces.append(found[hit].astype(np.int64)), widths.append(np.full(int(hit.sum()), k))
            if k == 1:
                single[at[hit]] = True
            alive = (found != -2) & (at + k < until[at])
            at, h = at[alive], h[alive]
            if not len(at):
                break
        lone = np.flatnonzero(~single)  # characters that fall back to bytes: coded as -1 - code point
        froms.append(lone), pieces.append(-1 - points[lone]), widths.append(np.ones(len(lone), np.int64))
        start, piece, width = np.concatenate(froms), np.concatenate(pieces), np.concatenate(widths)
        rel = start - begin[owner[start]] + width
        order = np.argsort((rel * (n + 1) + start + width) * 32 + width)  # by distance, end and width: one order, whatever the batch
        start, piece, width, rel = start[order], piece[order], width[order], rel[order]
        n_bytes = 1 + (points > 0x7F).astype(int) + (points > 0x7FF) + (points > 0xFFFF)
        weight = np.where(piece >= 0, table.logp[np.maximum(piece, 0)], table.byte_logp * n_bytes[start])
        node = start + owner[start] + width  # a unit of n characters has n + 1 nodes
        before = node - width
        alpha = np.zeros(n + len(units))
        state = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])  # first piece of each end node
        spans = np.diff(np.r_[state, len(node)])
        total = np.empty(len(node))
        levels = np.searchsorted(rel[state], np.arange(1, int(sizes.max(initial=0)) + 2))
        for a, b in zip(levels[:-1], levels[1:]):
            lo, hi = state[a], state[b - 1] + spans[b - 1]
            v = alpha[before[lo:hi]] + weight[lo:hi]
            heads = state[a:b] - lo
            top = np.maximum.reduceat(v, heads)
            alpha[node[state[a:b]]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, spans[a:b])), heads))
            total[lo:hi] = v
        cum = np.exp(total - alpha[node])
        left, k = state[spans > 1], 1
        while len(left):  # running sums inside a state, one rank at a time
            cum[left + k] += cum[left + k - 1]
            k += 1
            left = left[spans[np.searchsorted(state, left)] > k]
        cum[state + spans - 1] = 2.0  # the last piece takes what is left
        nodes, edges = self.first.n, self.cum.n
        first = np.full(n + len(units), -1, np.int32)
        first[node[state]] = state + edges
        self.number.update(zip(units, range(self.final.n, self.final.n + len(units))))
        self.final.add(begin + np.arange(len(units)) + sizes + nodes)
        self.first.add(first)
        self.cum.add(cum)
        self.piece.add(piece)
        self.before.add(before + nodes)
        self.uses.add(np.zeros(len(units), np.int32))

    def sample(self, unit: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling: ids of all occurrences in order, and their number per occurrence."""
        final, first, cum, piece, before = (a.room for a in (self.final, self.first, self.cum, self.piece, self.before))
        active, node, step = np.arange(len(unit)), final[unit], 0
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        steps = np.zeros(len(unit), np.int64)
        while len(active):
            u = (_mix(noise[active] + np.uint64((step + 1) * 0xD1B54A32D192ED03 % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = first[node]
            late = np.flatnonzero(cum[edge] <= u)
            while len(late):
                edge[late] += 1
                late = late[cum[edge[late]] <= u[late]]
            taken.append((active, piece[edge]))
            steps[active] += 1
            node = before[edge]
            more = first[node] >= 0
            active, node, step = active[more], node[more], step + 1
        offset = np.cumsum(steps) - steps
        pieces = np.empty(int(steps.sum()), np.int64)
        for k, (who, chosen) in enumerate(taken):
            pieces[offset[who] + steps[who] - 1 - k] = chosen
        if not (pieces < 0).any():
            return pieces, steps
        owner = np.repeat(np.arange(len(unit)), steps)
        points = -1 - pieces
        widths = np.where(pieces < 0, 1 + (points > 0x7F).astype(int) + (points > 0x7FF) + (points > 0xFFFF), 1)
        out = np.repeat(pieces, widths)
        low = np.flatnonzero(out < 0)
        nth = (np.arange(len(out)) - np.repeat(np.cumsum(widths) - widths, widths))[low]
        kinds, which = np.unique(out[low], return_inverse=True)
        spelled = np.zeros((len(kinds), 4), np.int64)
        for i, p in enumerate(kinds.tolist()):
            b = chr(-1 - p).encode()
            spelled[i, : len(b)] = list(b)
        out[low] = self.table.byte_ids[spelled[which, nth]]
        return out, np.bincount(owner, widths, len(unit)).astype(np.int64)


@lru_cache(maxsize=2)
def piece_table(path: str, inverse_temperature: float = 1.0) -> PieceTable:
    return PieceTable(path, inverse_temperature)


def encode(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", path: str | None = None, seed: int = 0, inverse_temperature: float = 1.0) -> DataFrame:
    """``docs`` with n_pieces, ids (little-endian unsigned 16-bit; 32-bit for models beyond 65,536 pieces),
    ids_crc32 (of the ids as 32-bit integers) and lossless (the ids decode to the text)."""
    path = path or model_path()
    prepare_workers(docs.sparkSession)

    @F.pandas_udf("n_pieces long, ids binary, ids_crc32 long, lossless boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table = piece_table(path, inverse_temperature)
        for keys, texts in batches:
            texts = [t or "" for t in texts]
            rows = table.encode(texts, keys.fillna(0).to_numpy(np.int64), seed)
            yield pd.DataFrame(
                [(len(r), r.tobytes(), zlib.crc32(r.astype("<u4").tobytes()), table.decode(r) == t) for r, t in zip(rows, texts)],
                columns=["n_pieces", "ids", "ids_crc32", "lossless"],
            )
        table.memo.clear()
        give_back()

    kept = [c for c in docs.columns if c not in ("n_pieces", "ids", "ids_crc32", "lossless")]
    found = docs.select(*kept, run(F.coalesce(F.col(key_col).cast("long"), F.lit(0)), F.coalesce(F.col(text_col), F.lit(""))).alias("_enc"))
    return found.select(*kept, "_enc.n_pieces", "_enc.ids", "_enc.ids_crc32", "_enc.lossless")


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the text that its ids stand for, as ``decoded``."""
    path = path or model_path()
    prepare_workers(encoded.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = piece_table(path)
        for batch in batches:
            yield pd.Series([table.decode(np.frombuffer(b or b"", table.dtype)) for b in batch])

    return encoded.withColumn("decoded", run(F.col(ids_col)))
