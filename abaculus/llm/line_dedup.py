"""Fuzzy line deduplication: candidates by pairs of words, edit similarity, one occurrence per group.

Lines are normalised (lower case, runs of anything but letters and digits become
one blank). Equal lines are one class, reduced by an aggregate with partial sums.
A class has as keys its ``KEYS`` longest distinct pairs of neighbouring words, ties in
the order of a hash: a fixed order, so similar lines choose the same ones, and long pairs
are rare. Words of more than ``LONG_WORD`` characters (and lines without blanks) are cut
at characters that a hash picks. An edit spoils too many of these in short lines: those of
up to ``SHORT`` characters choose among all pairs of their words, and with one or two words
they also have bands of MinHash registers over their character pairs.

A passage that many different lines quote brings all of these together by its pairs, however many they are.
Lines that share a key, and whose lengths allow it, are first compared by sketches of 32 bytes, bucket by
bucket in sorted order, so that only lines of near lengths meet. Short lines: a bit per character triple;
an edit spoils three, so this rules out none that may be similar. Longer ones: one-permutation MinHash over
words of five characters and more, four bits of each of 64 registers, of which ``LEAST_AGREE`` must agree
(lines with fewer than ``LEAST_WORDS`` such words are not ruled out). What the sketches leave connected is a
bucket of its own, known by its lines, so what several keys bring together counts once; lines without a partner
leave. Only then are texts fetched, once for each line and bucket, and the lines verified by edit similarity on the
whole normalised lines, many at once. Each line is first compared with its closest by the sketch, then all pairs
follow whose ends are not in one group yet, so near copies don't make the square of their number. Tasks give links only, no more than lines. A bucket of more
than two times ``PART`` lines or ``CHARS`` characters is dealt out as pairs of parts. Of each connected group the
occurrence with the smallest (doc_id, line number) stays.

Defined results: a null or empty text has no lines; lines without letters and
digits are never dropped; lines of equal texts and repeated rows count as copies
(rows of one doc_id share line numbers: the copies at the kept number stay);
null ids order first; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abaculus.llm.grouping import PAIR_BUCKET, components
from abaculus.llm.shared import Workspace, broadcast_if_small, prepare_workers

KEYS = 6
SHORT = 40
SHORT_GRAM, SHORT_BANDS, SHORT_ROWS = 2, 24, 3
LONG_WORD = 16
REGISTERS, SKETCH_WORD, LEAST_WORDS, LEAST_AGREE = 64, 5, 8, 28
CHUNK_CHARS, CHUNK_LINES = 300_000, 4096  # characters and lines of texts worked off at once (a longer line at once, too)
PART, CHARS, PAIRS = 1024, 4_000_000, 400_000  # lines and characters of a part of a large bucket; pairs that are worked off at once
BATCH, CELLS, LONG, JUMP = 2048, 1 << 22, 200, 8  # pairs of lines compared at once; words of their table of characters; characters from which on words are tried first; words that may be put in before one of them
PLAIN, AT_ONCE = 320, 8192  # lines of up to so many characters are compared as they are; pairs whose texts are held at once
ROWS, TEXTS = 200_000, 16_000_000  # rows and bytes of whole buckets that a task works off at once (a larger bucket at once, too)
PLACES = 250_000  # documents whose wanted lines are broadcast; beyond that the join shuffles
NIBBLES = np.uint64(0x1111111111111111)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_DETOUR = np.array([np.random.default_rng(b).permutation(128) for b in range(128)])  # where an empty register looks, in order


@lru_cache(maxsize=1)
def alphanumeric() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x110000)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def normalised(line: str) -> str:
    points = np.frombuffer(line.lower().encode("utf-32-le", "replace"), np.uint32)
    return " ".join(np.where(alphanumeric()[points], points, 32).astype("<u4").tobytes().decode("utf-32-le").split())


def short_keys(lines: list[str]) -> np.ndarray:
    """Band keys (lines x SHORT_BANDS) of non-empty normalised lines: one-permutation MinHash over their character pairs.

    A line is framed by blanks, so that its ends weigh as much as its middle. Empty registers take the value
    of the first full one of their own fixed order, which is the same register for two lines with equal full ones.
    """
    size, gram = SHORT_BANDS * SHORT_ROWS, SHORT_GRAM
    texts = [" " + x + " " * (gram - 1) for x in lines]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    h = np.zeros(len(points) - gram + 1, np.uint64)
    for j in range(gram):
        h = h * np.uint64(0x110000 | 1) + points[j : j + len(h)]
    inside = np.repeat(ends - gram, lengths)[: len(h)] >= np.arange(len(h))
    h, line = _mix(h + np.uint64(_BASE))[inside], np.repeat(np.arange(len(lines)), lengths - gram + 1)
    registers = np.full(len(lines) * size, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(registers, line * size + ((h >> np.uint64(32)) % np.uint64(size)).astype(np.int64), _mix(h))
    registers = registers.reshape(len(lines), size)
    full = registers < np.iinfo(np.uint64).max
    look, at = _DETOUR[:size], np.arange(size)
    look = look[look < size].reshape(size, size)
    for i in np.flatnonzero(~full.all(1)):
        empty = at[~full[i]]
        registers[i, empty] = registers[i, look[empty, full[i][look[empty]].argmax(1)]]
    keys = np.tile(np.arange(1, SHORT_BANDS + 1, dtype=np.uint64) * np.uint64(_BASE), (len(lines), 1))
    for j in range(SHORT_ROWS):
        keys = _mix(keys * np.uint64(_BASE) + registers[:, j::SHORT_ROWS])
    return keys.view(np.int64)


def triples(lines: list[str]) -> np.ndarray:
    """A bit of 256 for every triple of neighbouring characters (lines x 4)."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.array([len(x) for x in lines])
    bits = np.zeros((len(lines), 256), np.uint8)
    if len(points) > 2:
        h = _mix((points[:-2] * np.uint64(0x110001) + points[1:-1]) * np.uint64(0x110001) + points[2:])
        line = np.repeat(np.arange(len(lines)), lengths)[:-2]
        inside = np.repeat(np.cumsum(lengths) - 3, lengths)[:-2] >= np.arange(len(h))
        bits[line[inside], (h[inside] >> np.uint64(56)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.int64)


def all_pair_keys(word: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The KEYS longest distinct pairs of a short line's words, neighbours or not."""
    i, j = np.triu_indices(len(word), 1)
    pair, long = _mix(word[i] * np.uint64(_BASE) + word[j]), np.minimum(length[i] + length[j], 63).astype(np.uint64)
    order = np.unique(((np.uint64(63) - long) << np.uint64(46)) | (pair >> np.uint64(18)))[:KEYS]
    return _mix(order).view(np.int64)


def words_of(points: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of every word, words of more than LONG_WORD characters cut where a hash of two neighbours picks."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin > LONG_WORD
    if long.any():
        within = np.zeros(len(points) + 1, np.int8)
        within[begin[long] + 1], within[end[long]] = 1, -1
        at = np.flatnonzero(np.cumsum(within[:-1]))
        pair = points[at - 1].astype(np.uint64) * np.uint64(0x110000) + points[at]
        cuts = at[_mix(pair + np.uint64(_BASE)) >> np.uint64(62) == 0]
        begin, end = np.sort(np.r_[begin, cuts]), np.sort(np.r_[end, cuts])
    return begin, end


def pair_keys(word: np.ndarray, length: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, line) of the KEYS longest distinct pairs of neighbouring words of every line (fewer than CHUNK_LINES)."""
    same = line[1:] == line[:-1]
    pair = _mix(word[:-1] * np.uint64(_BASE) + word[1:])[same]
    short_first = (np.uint64(63) - np.minimum(length[:-1] + length[1:], 63).astype(np.uint64))[same]
    order = np.sort((line[:-1][same].astype(np.uint64) << np.uint64(52)) | (short_first << np.uint64(46)) | (pair >> np.uint64(18)))
    order = order[np.diff(order, prepend=~order[:1]) != 0]
    owner = (order >> np.uint64(52)).astype(np.int64)
    counts = np.bincount(owner, minlength=CHUNK_LINES)
    chosen = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts) < KEYS
    return _mix(order[chosen] & np.uint64((1 << 52) - 1)).view(np.int64), owner[chosen]


def sketch(word: np.ndarray, length: np.ndarray, line: np.ndarray, n_lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Per line the number of words of SKETCH_WORD characters and more, and four bits of each of their registers."""
    long = length >= SKETCH_WORD
    word, line = word[long], line[long]
    most = np.iinfo(np.uint64).max
    registers = np.full(n_lines * REGISTERS, most, np.uint64)
    np.minimum.at(registers, line * REGISTERS + (word >> np.uint64(58)).astype(np.int64), _mix(word + np.uint64(_BASE)))
    registers, counts = registers.reshape(n_lines, REGISTERS), np.bincount(line, minlength=n_lines)
    at = np.where(registers < most, np.arange(REGISTERS, dtype=np.uint8), np.uint8(255))
    following = np.minimum.accumulate(np.c_[at, np.where(at < 255, at + np.uint8(REGISTERS), 255).astype(np.uint8)][:, ::-1], axis=1)[:, ::-1][:, :REGISTERS]
    # an empty register takes the next full one's value; without a word all are full ones of zeros
    four = np.take_along_axis((registers >> np.uint64(60)).astype(np.uint8), (following % REGISTERS).astype(np.int64), axis=1)
    return counts, np.ascontiguousarray(four[:, 0::2] | four[:, 1::2] << 4).view(np.int64)


@lru_cache(maxsize=2)
def powers_of(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, np.uint64))


def flat(lists: list[np.ndarray]) -> pa.Array:
    """The lists as an Arrow column."""
    ends = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists)))


def chunk_table(lines: list[str]) -> pd.DataFrame | None:
    """place (in ``lines``), hash and size of the normalised line, n_words, code and keys of those with a word."""
    points = np.frombuffer("\n".join(lines).lower().encode("utf-32-le", "replace"), np.uint32)
    inside = alphanumeric()[points]
    begin, end = words_of(points, inside)
    if not len(begin):
        return None
    line = np.cumsum(points == 10)[begin]
    room = max(2 * CHUNK_CHARS, len(points) + 1)
    powers, inverse = powers_of(_BASE, room), powers_of(_INVERSE, room)
    sums = np.r_[np.uint64(0), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[: len(points)])]
    word = _mix((sums[end] - sums[begin]) * inverse[begin])
    length = end - begin
    counts, code = sketch(word, length, line, len(lines))
    keys, owner = pair_keys(word, length, line)
    # the normalised lines: words, and of what follows a word one blank
    after = np.zeros_like(inside)
    after[1:] = inside[:-1] & ~inside[1:]
    kept = inside | after
    norm, at = np.where(inside, points, 32)[kept].astype("<u4"), np.cumsum(kept)
    held, head = np.unique(line, return_index=True)
    first, last = at[begin[head]] - 1, at[end[np.r_[head[1:], len(line)] - 1] - 1]
    size = last - first
    hashes = [xxhash.xxh3_128_digest(norm[a:b].tobytes()) for a, b in zip(first.tolist(), last.tolist())]
    stops = np.cumsum(np.bincount(owner, minlength=len(lines)))
    starts = np.r_[0, stops[:-1]][held].tolist()
    stops = stops[held].tolist()
    own = [keys[i:j] for i, j in zip(starts, stops)]
    code = code[held]
    if len(few := np.flatnonzero(size <= SHORT)):
        texts, stop = [norm[first[i] : last[i]].tobytes().decode("utf-32-le") for i in few.tolist()], np.r_[head[1:], len(line)]
        code[few] = triples(texts)
        for i in few.tolist():
            if stop[i] - head[i] > 2:
                own[i] = all_pair_keys(word[head[i] : stop[i]], length[head[i] : stop[i]])
        if lone := [(i, t) for i, t in zip(few.tolist(), texts) if stop[i] - head[i] <= 2]:
            for (i, _), k in zip(lone, short_keys([t for _, t in lone])):
                own[i] = np.r_[own[i], k]
    return pd.DataFrame({"place": held, "hash": hashes, "size": size.astype(np.int32), "n_words": counts[held].astype(np.int32), "code": list(code), "keys": own})


def trimmed(a: str, b: str) -> tuple[str, str]:
    """What equal beginnings and ends leave of two lines, the shorter one first."""
    for step in (1, -1):  # the length of the equal beginning, by halving; then of the equal end
        low, high = 0, min(len(a), len(b))
        while low < high:
            k = (low + high + 1) // 2
            same = a[low:k] == b[low:k] if step == 1 else a[len(a) - k : len(a) - low] == b[len(b) - k : len(b) - low]
            low, high = (k, high) if same else (low, k - 1)
        a, b = (a[low:], b[low:]) if step == 1 else (a[: len(a) - low], b[: len(b) - low])
    return (b, a) if len(a) > len(b) else (a, b)


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is ``most`` or less: bit-parallel, on what equal beginnings and ends leave."""
    if abs(len(a) - len(b)) > most:
        return False
    a, b = trimmed(a, b)
    if not a or len(b) <= most:
        return len(b) <= most
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, score, left = whole, 0, len(a), len(b)  # bits where the column's differences are +1 and -1
    for c in b:
        equal = at.get(c, 0)
        across = (((equal & more) + more) ^ more) | equal
        up, down = less | (whole & ~(across | more)), more & across
        left -= 1
        if up & last:
            score += 1
            if score - left > most:
                return False
        elif down & last:
            score -= 1
        up, down = (up << 1 | 1) & whole, down << 1 & whole
        equal |= less
        more, less = down | (whole & ~(equal | up)), up & equal
    return score <= most


def spread(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all lines, and where each begins and how many it has."""
    sizes = np.array([len(x) for x in lines], np.int64)
    return np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32), np.cumsum(sizes) - sizes, sizes


def distances(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Edit distances of the pairs of lines a and b at once, exact up to ``band`` and never too small: the bit-parallel table in 64-bit words.

    A line is ``sizes`` of the ``points`` from ``starts`` on. Only words with cells up to ``band`` from the diagonal are worked
    on. ``a`` comes in descending order of size, none of it empty; no pair differs in size by more than ``band``.
    """
    n, rows, size_a, size_b = len(a), np.arange(len(a)), sizes[a], sizes[b]
    of_a, line_a = np.unique(a, return_inverse=True)
    of_b, line_b = np.unique(b, return_inverse=True)
    letter = np.zeros(int(points.max()) + 1, np.int64)
    letter[points] = 1
    letters = int(letter.sum())
    letter = np.cumsum(letter) - 1
    words, wide = -(-int(size_a[0]) // 64), int(size_b.max())
    if n > 1 and words * len(of_a) * (letters + 1) > CELLS:
        half = n // 2
        return np.r_[distances(points, starts, sizes, a[:half], b[:half], band), distances(points, starts, sizes, a[half:], b[half:], band)]

    def laid(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = sizes[lines]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(np.arange(len(lines)), size), place, letter[points[np.repeat(starts[lines], size) + place]]

    line, place, code = laid(of_b)
    codes_b = np.full((wide, len(of_b)), letters)
    codes_b[place, line] = code
    codes_b = codes_b[:, line_b] + line_a * (letters + 1)
    line, place, code = laid(of_a)
    equal = np.zeros(words * len(of_a) * (letters + 1), np.uint64)
    np.bitwise_or.at(equal, ((place >> 6) * len(of_a) + line) * (letters + 1) + code, np.uint64(1) << (place & 63).astype(np.uint64))
    equal = equal.reshape(words, -1)
    one, top = np.uint64(1), np.uint64(63)
    reach = [int((size_a > 64 * w).sum()) for w in range(words + 1)]  # so many pairs have a word w
    more, less = [np.full(k, 2**64 - 1, np.uint64) for k in reach], [np.zeros(k, np.uint64) for k in reach]
    ones, none, ups, downs = np.ones(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    last, score, low_end = ((size_a - 1) & 63).astype(np.uint64), np.zeros(n, np.int64), -1  # score: below the lowest word in the band
    for t in range(wide):
        while low_end < min(words - 1, (t + band) // 64):
            low_end += 1
            score[: reach[low_end]] += np.minimum(64, size_a[: reach[low_end]] - 64 * low_end)
            bit = np.where(size_a > 64 * (low_end + 1), top, last)
        up_in, down_in, at = ones, none, codes_b[t]
        for w in range(max(0, (t - band) // 64), low_end + 1):
            k = reach[w]
            p, m, e = more[w], less[w], equal[w].take(at[:k])
            v = e | m
            e |= down_in[:k]
            across = (((e & p) + p) ^ p) | e
            up, down = m | ~(across | p), p & across
            start = reach[w + 1] if w < low_end else 0
            if start < k:
                ups[start:k], downs[start:k] = up[start:], down[start:]
            shifted, low = up << one | up_in[:k], down << one | down_in[:k]
            up_in, down_in = up >> top, down >> top
            more[w], less[w] = low | ~(v | shifted), shifted & v
        score += ((ups >> bit & one).astype(np.int64) - (downs >> bit & one).astype(np.int64)) * (t < size_b)
    return score


def few(pairs: int, band: int) -> bool:
    """Whether the calls for so many pairs at once take longer than the pairs one by one."""
    return pairs < 14 * (band // 32 + 1)


def near_by_words(x: str, y: str, most: int) -> bool:
    """Whether ``most`` edits are enough for what differs between words that both lines hold once, in the same order."""
    a, b = x.split(" "), y.split(" ")
    at_a, at_b = ({w: i for i, w in enumerate(words) if seen[w] == 1} for words, seen in ((a, Counter(a)), (b, Counter(b))))
    edits, i, j = 0, 0, 0
    for w, k in [*at_a.items(), ("", len(a))]:
        m = at_b.get(w, -1) if k < len(a) else len(b)
        if j <= m <= j + k - i + JUMP or k == len(a):
            if a[i:k] != b[j:m]:
                edits += max(sum(map(len, a[i:k])) + k - i, sum(map(len, b[j:m])) + m - j)
                if edits > most:
                    return False
            i, j = k + 1, m + 1
    return True


def all_within(a: list[str], b: list[str], similarity: float) -> np.ndarray:
    """Whether each pair of lines has the edit similarity."""
    linked, left = np.zeros(len(a), bool), []
    for i, (x, y) in enumerate(zip(a, b)):
        most = int(max(len(x), len(y)) * (1 - similarity) + 1e-9)
        if abs(len(x) - len(y)) <= most:
            x, y = trimmed(x, y)
            if len(y) <= most or len(y) > LONG and near_by_words(x, y, most):
                linked[i] = True
            elif x:
                left.append((len(x), i, x, y, most))
    left.sort(key=lambda p: p[:2], reverse=True)
    start = 0
    while start < len(left):  # lines of near sizes go together, at most BATCH pairs
        size, stop = left[start][0], start + 1
        while stop < len(left) and stop - start < BATCH and left[stop][0] >= 0.8 * size - 32:
            stop += 1
        batch, start = left[start:stop], stop
        if few(len(batch), max(p[4] for p in batch)):
            for _, i, x, y, most in batch:
                linked[i] = within(x, y, most)
        else:
            most, at = np.array([p[4] for p in batch]), np.arange(len(batch))
            linked[[p[1] for p in batch]] = distances(*spread([p[k] for k in (2, 3) for p in batch]), at, at + len(batch), int(most.max())) <= most
    return linked


def likely(t: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows i and j: whether they may be similar, and how far apart their sketches are."""
    size_i, size_j = t["size"][i], t["size"][j]
    big, small = np.maximum(size_i, size_j), np.minimum(size_i, size_j)
    edits = big * (1 - similarity) + 1e-9
    far, only_i, only_j = np.zeros(len(i), np.int32), np.zeros(len(i), np.int32), np.zeros(len(i), np.int32)
    short = big <= SHORT
    for c in ("c0", "c1", "c2", "c3"):
        x, y = t[c][i], t[c][j]
        d = x ^ y
        d |= d >> np.uint64(1)
        far += np.bitwise_count((d | d >> np.uint64(2)) & NIBBLES)
        if short.any():
            only_i += np.bitwise_count(x & ~y)
            only_j += np.bitwise_count(y & ~x)
    alike = (np.minimum(t["n_words"][i], t["n_words"][j]) < LEAST_WORDS) | (far <= REGISTERS - LEAST_AGREE) | (small <= SHORT)
    alike = np.where(short, np.maximum(only_i, only_j) <= 3 * edits, alike)
    return alike & (big - small <= edits), np.where(short, only_i + only_j, np.where(small <= SHORT, REGISTERS, far))


def bucket_pairs(t: dict[str, np.ndarray], similarity: float, closest: bool, few: int = PAIR_BUCKET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of rows in the order of (bucket, part_a, part_b, size), whole buckets.

    ``closest``: all pairs of buckets of up to ``few`` rows, and of a larger one each row with its closest. Else all pairs of different ``comp``, which
    may change between two steps; with ``own``, those of one part only where that part is dealt with itself.
    """
    n, node = len(t["node"]), t["node"]
    new = np.ones(n, bool)
    new[1:] = (t["bucket"][1:] != t["bucket"][:-1]) | (t["part_a"][1:] != t["part_a"][:-1]) | (t["part_b"][1:] != t["part_b"][:-1])
    rank = np.cumsum(new) - 1
    order = rank << 32 | t["size"]
    end = np.searchsorted(order, rank << 32 | (t["size"] / similarity + 1).astype(np.int64), "right")
    counts, small = end - np.arange(n) - 1, np.bincount(rank)[rank] <= few
    if not closest:
        first = np.flatnonzero(new)
        counts *= (np.minimum.reduceat(t["comp"], first) < np.maximum.reduceat(t["comp"], first))[rank]
    best = np.full(n, np.iinfo(np.int64).max)
    sums, at = np.cumsum(counts), 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS, "right")))
        some = counts[at:stop]
        i = np.repeat(np.arange(at, stop), some)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
        at = stop
        if not closest:
            differ = t["comp"][i] != t["comp"][j]
            if "own" in t:
                differ &= (t["own"][i] != t["own"][j]) | (t["part_a"][i] == t["part_b"][i])
            i, j = i[differ], j[differ]
        if not len(i):
            continue
        alike, far = likely(t, i, j, similarity)
        i, j, far = i[alike], j[alike], far[alike].astype(np.int64)
        given = small[i] if closest else np.ones(len(i), bool)
        yield node[i[given]], node[j[given]]
        i, j, far = i[~given], j[~given], far[~given]
        np.minimum.at(best, i, far << 40 | j)
        np.minimum.at(best, j, far << 40 | i)
    found = np.flatnonzero(best < np.iinfo(np.int64).max)
    yield node[found], node[best[found] & (1 << 40) - 1]


def join_groups(comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Put the groups of rows i and j together: ``comp`` is the first row of each row's group."""
    while len(i):
        a, b = comp[i], comp[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(comp, np.maximum(a, b), np.minimum(a, b))
        while (comp[comp] != comp).any():
            comp[:] = comp[comp]


def all_near(t: dict[str, np.ndarray], lines: list[str], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether each pair of rows has the edit similarity."""
    linked = np.zeros(len(i), bool)
    size_i, size_j = t["size"][i], t["size"][j]
    big, small = np.maximum(size_i, size_j), np.minimum(size_i, size_j)
    most = (big * (1 - similarity) + 1e-9).astype(np.int64)
    plain, able = big <= PLAIN, big - small <= most
    linked[plain & able & (big <= most)] = True  # without any letter in common
    left = np.flatnonzero(plain & able & ~linked & (small > 0))
    left = left[np.argsort(-small[left], kind="stable")]
    for at in range(0, len(left), BATCH):
        p = left[at : at + BATCH]
        if few(len(p), int(most[p].max())):
            linked[p] = [within(lines[x], lines[y], z) for x, y, z in zip(i[p].tolist(), j[p].tolist(), most[p].tolist())]
            continue
        a, b = np.where(size_i[p] <= size_j[p], i[p], j[p]), np.where(size_i[p] <= size_j[p], j[p], i[p])
        held, place = np.unique(np.r_[a, b], return_inverse=True)
        linked[p] = distances(*spread([lines[x] for x in held.tolist()]), place[: len(p)], place[len(p) :], int(most[p].max())) <= most[p]
    long = np.flatnonzero(~plain & able)
    for at in range(0, len(long), AT_ONCE):
        p = long[at : at + AT_ONCE]
        linked[p] = all_within([lines[x] for x in i[p].tolist()], [lines[x] for x in j[p].tolist()], similarity)
    return linked


def crowds_of(t: dict[str, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of rows with a partner by the sketches: a bucket of whose lines all were here falls into what these connect."""
    n = len(t["node"])
    t = t | {"node": np.arange(n), "nodes": t["node"], "comp": np.arange(n)}
    for i, j in bucket_pairs(t, similarity, False):
        for at in range(0, len(i), AT_ONCE):
            join_groups(t["comp"], i[at : at + AT_ONCE], j[at : at + AT_ONCE])
    comp, key = t["comp"], _mix(t["nodes"].astype(np.uint64) + np.uint64(_BASE))
    total = np.zeros(n, np.uint64)
    np.add.at(total, comp, key)  # known by its lines, whatever key brought them together
    row = np.flatnonzero(np.bincount(comp, minlength=n)[comp] > 1)
    return row, np.where(t["part_a"][row] < 0, _mix(total[comp[row]]).view(np.int64), t["bucket"][row])


def links_of(t: dict[str, np.ndarray], lines: list[str], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect all rows whose lines are similar, one less than rows in each group."""
    n = len(t["node"])
    same, ends = np.unique(t["node"], return_inverse=True)[1], []
    t = t | {"node": np.arange(n), "comp": np.arange(n)}

    def tried(i: np.ndarray, j: np.ndarray) -> None:
        pair = np.minimum(same[i], same[j]) << 32 | np.maximum(same[i], same[j])
        _, one, back = np.unique(pair, return_index=True, return_inverse=True)  # two lines may meet in several buckets
        linked = all_near(t, lines, i[one], j[one], similarity)[back]
        a, b = i[linked], j[linked]
        if len(a):
            before = t["comp"].copy()
            join_groups(t["comp"], a, b)
            ends.append(spanning(before[a], before[b], a, b))

    found = [np.sort(np.c_[i, j], axis=1) for i, j in bucket_pairs(t, similarity, True, 2)]
    first = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    tried(first[:, 0], first[:, 1])
    new = np.r_[True, (t["bucket"][1:] != t["bucket"][:-1]) | (t["part_a"][1:] != t["part_a"][:-1]) | (t["part_b"][1:] != t["part_b"][:-1])]
    rank = np.cumsum(new) - 1
    if len(large := np.flatnonzero(np.bincount(rank)[rank] > 2)):
        done = first[:, 0] << 32 | first[:, 1]
        some = {c: x[large] for c, x in t.items()}
        for i, j in bucket_pairs(some, similarity, False):
            i, j = np.minimum(i, j), np.maximum(i, j)
            fresh = ~np.isin(i << 32 | j, done)
            i, j = i[fresh], j[fresh]
            most = 1
            while len(i):  # of two groups one pair, then more while these are not linked
                a, b = t["comp"][i], t["comp"][j]
                between = np.minimum(a, b) << 32 | np.maximum(a, b)
                order = np.argsort(between, kind="stable")
                order = order[a[order] != b[order]]
                i, j, between = i[order], j[order], between[order]
                begins = np.flatnonzero(np.diff(between, prepend=-1))
                now = np.arange(len(i)) - np.repeat(begins, np.diff(np.r_[begins, len(i)])) < most
                tried(i[now], j[now])
                i, j, most = i[~now], j[~now], 4 * most
            some["comp"][:] = t["comp"][large]
    return tuple(np.concatenate([x[k] for x in ends]) if ends else np.zeros(0, np.int64) for k in (0, 1))


def spanning(group_a: np.ndarray, group_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (a, b) between groups those that are enough to connect what all connect."""
    root: dict[int, int] = {}
    kept = []
    for k, (x, y) in enumerate(zip(group_a.tolist(), group_b.tolist())):
        while x in root:
            root[x] = x = root.get(root[x], root[x])
        while y in root:
            root[y] = y = root.get(root[y], root[y])
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return a[kept], b[kept]


def in_buckets(members: DataFrame, chars: Column, work: Callable[[dict[str, np.ndarray], pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``work`` gives for whole buckets of members (bucket, in_bucket, node, size, n_words, c0 to c3 and others): columns, and the table."""
    parts = F.ceil(F.greatest(F.col("in_bucket") / PART, chars / CHARS)).cast("int")
    own = F.when(F.col("parts") <= 2, 0).otherwise(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = members.withColumn("parts", parts).withColumn("own", own).withColumn("with", F.explode(F.when(F.col("parts") <= 2, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    whole = F.col("with") < 0
    dealt = dealt.withColumns({"part_a": F.when(whole, -1).otherwise(F.least("own", "with")), "part_b": F.when(whole, -1).otherwise(F.greatest("own", "with"))})
    names = ["bucket", "part_a", "part_b", "own", "node", "size", "n_words", "c0", "c1", "c2", "c3"]
    dealt = dealt.select(*names, *[c for c in members.columns if c == "line"]).repartition("bucket", "part_a", "part_b").sortWithinPartitions("bucket", "part_a", "part_b", "size", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            t = {c: table.column(c).to_numpy() for c in names}
            t |= {c: t[c].view(np.uint64) for c in ("c0", "c1", "c2", "c3")} | {c: t[c].astype(np.int64) for c in ("size", "n_words")}
            return work(t, table)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS and sum(b.nbytes for b in held) < TEXTS:
                continue
            # what follows the last change may go on in the next batch
            last = [batch.column(c)[-1].as_py() for c in names[:3]]
            for k in range(len(held) - 1, -1, -1):
                key = np.stack([held[k].column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names[:3]])
                other = np.flatnonzero((key != np.array(last)[:, None]).any(0))
                if len(other):
                    cut = int(other[-1]) + 1
                    yield done([*held[:k], held[k].slice(0, cut)])
                    held = [b for b in (held[k].slice(cut), *held[k + 1 :]) if b.num_rows]
                    break
        if held:
            yield done(held)

    return dealt.mapInArrow(run, schema)


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, hash and size of the normalised line, n_words, c0 to c3 and keys of every line with a word."""

    def table(ids: list, numbers: list[int], lines: list[str]) -> Iterator[pa.RecordBatch]:
        if (found := chunk_table(lines)) is not None:
            place, code = found["place"].to_numpy(), np.stack(found["code"].to_list())
            columns = {"doc_id": pa.array(ids, pa.int64()).take(pa.array(place)), "line_no": pa.array(np.array(numbers, np.int32)[place])}
            columns |= {"hash": pa.array(found["hash"].to_list(), pa.binary())} | {c: pa.array(found[c].to_numpy()) for c in ("size", "n_words")}
            columns |= {f"c{i}": pa.array(np.ascontiguousarray(code[:, i])) for i in range(4)} | {"keys": flat(found["keys"].to_list())}
            yield pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, lines, held = [], [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for i, line in enumerate(text.as_py().split("\n")):
                    ids.append(doc_id), numbers.append(i), lines.append(line)
                    held += len(line)
                    if held >= CHUNK_CHARS or len(lines) >= CHUNK_LINES - 1:
                        yield from table(ids, numbers, lines)
                        ids, numbers, lines, held = [], [], [], 0
            if ids:
                yield from table(ids, numbers, lines)

    prepare_workers(docs.sparkSession)
    rows = docs.where("text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    codes = ", ".join(f"c{i} long" for i in range(4))
    return rows.mapInArrow(run, f"doc_id long, line_no int, hash binary, size int, n_words int, {codes}, keys array<long>")


def shared_keys(members: DataFrame) -> DataFrame:
    """(bucket, node, in_bucket) of the (node, bucket) whose bucket holds two nodes or more; one exchange serves the counts and the join."""
    dealt = members.repartition("bucket")
    counts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("in_bucket")).where("in_bucket > 1")
    return dealt.join(counts.hint("shuffle_hash"), "bucket")


def crowds(members: DataFrame, similarity: float) -> DataFrame:
    """Distinct (node, bucket, chars), the buckets whose lines are compared: of members (bucket, in_bucket, node, size, n_words, c0 to c3) what the sketches leave."""

    def work(t: dict[str, np.ndarray], table: pa.Table) -> pa.RecordBatch:
        row, bucket = crowds_of(t, similarity)
        return pa.RecordBatch.from_arrays([pa.array(t["node"][row]), pa.array(bucket), pa.array(t["size"][row])], ["node", "bucket", "chars"])

    return in_buckets(members, F.lit(0), work, "node long, bucket long, chars long").distinct()


def shared_buckets(ws: Workspace, members: DataFrame) -> DataFrame:
    """(node, bucket, size, weight) of the (node, bucket, chars): how many lines and characters the bucket has."""
    dealt = members.repartition("bucket")
    counts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("chars").alias("weight"))
    return ws.write(dealt.drop("chars").join(counts.hint("shuffle_hash"), "bucket"), "members")


def links(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b), enough of the similar lines of members (as for ``crowds``, and weight and line) to connect all of them."""

    def work(t: dict[str, np.ndarray], table: pa.Table) -> pa.RecordBatch:
        a, b = (t["node"][x] for x in links_of(t, table.column("line").to_pylist(), similarity))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return in_buckets(members, F.col("weight"), work, "a long, b long")


def line_texts(ws: Workspace, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, line), the normalised lines of ``wanted`` (node, hash, first: struct of doc_id and line_no)."""
    places = wanted.groupBy(F.col("first.doc_id").alias("first_id")).agg(F.collect_list(F.struct("node", "first.line_no", "hash")).alias("places"))
    places = ws.write(places, "wanted")  # lines of one document
    source = docs.where("text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = source.join(broadcast_if_small(places, PLACES), F.col("doc_id").eqNullSafe(F.col("first_id"))).select("text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, lines = [], []
            for text, places in zip(batch.column("text"), batch.column("places")):
                cut = text.as_py().split("\n")
                for at in places.as_py():
                    line = normalised(cut[at["line_no"]]) if at["line_no"] < len(cut) else ""
                    if xxhash.xxh3_128_digest(line.encode("utf-32-le", "replace")) == at["hash"]:  # rows of one doc_id may have different texts
                        nodes.append(at["node"]), lines.append(line)
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "line": pa.array(lines, pa.string())})

    return met.mapInArrow(run, "node long, line string")


def fuzzy_lines(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, line_no and kept of every line with a word."""
    ws = Workspace(docs.sparkSession, "line-dedup")
    lines = ws.write(line_table(docs), "lines")
    sketch = ["size", "n_words", "c0", "c1", "c2", "c3"]
    classes = lines.groupBy("hash").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), *[F.first(c).alias(c) for c in (*sketch, "keys")])
    classes = ws.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    lines = ws.write(lines.select("doc_id", "line_no", "hash"), "places")
    ws.drop("lines")
    met = shared_keys(classes.select("node", F.explode("keys").alias("bucket"))).join(classes.select("node", *sketch), "node")
    members = shared_buckets(ws, crowds(met, similarity))
    nodes = members.select("node").distinct()  # all that have a partner left
    wanted = ws.write(nodes.join(classes.select("node", "hash", "first", *sketch), "node"), "partners")
    texts = ws.write(line_texts(ws, docs, wanted.select("node", "hash", "first")).dropDuplicates(["node"]), "texts")
    met = members.withColumnRenamed("size", "in_bucket").join(wanted.select("node", *sketch).join(texts, "node"), "node")
    labels = components(ws, ws.write(links(met, similarity), "links"), "comps")
    grouped = classes.join(labels, "node", "left").select("hash", "first", F.coalesce("comp", "node").alias("comp"))
    keep = grouped.groupBy("comp").agg(F.min("first").alias("keep"))
    of_hash = grouped.join(keep, "comp").select("hash", "keep")
    return lines.join(of_hash, "hash").select("doc_id", "line_no", F.struct("doc_id", "line_no").eqNullSafe(F.col("keep")).alias("kept"))


def per_document(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_lines, n_dropped and dropped_lines (line numbers, ascending) of every distinct doc_id."""
    drops = fuzzy_lines(docs, similarity).where("not kept").groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("dropped_lines"))
    lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n", -1)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lines.cast("long").alias("n_lines")).groupBy("doc_id").agg(F.max("n_lines").alias("n_lines"))
    drops = drops.withColumnRenamed("doc_id", "drop_id")
    none = F.array().cast("array<int>")
    out = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")), "left")
    return out.select("doc_id", "n_lines", F.size(F.coalesce("dropped_lines", none)).cast("long").alias("n_dropped"), F.coalesce("dropped_lines", none).alias("dropped_lines"))


def without_lines(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs`` whose texts lack the ``dropped_lines`` of ``decisions`` (doc_id, dropped_lines)."""
    drops = decisions.where(F.size("dropped_lines") > 0).select(F.col("doc_id").alias("_drop_id"), F.col("dropped_lines").alias("_drops"))
    cut = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("_drops"))
    text = F.when(F.col("_drops").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.element_at(cut, i + 1)), "\n"))
    joined = docs.join(broadcast_if_small(drops, 50_000), F.col("doc_id") == F.col("_drop_id"), "left")
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])
