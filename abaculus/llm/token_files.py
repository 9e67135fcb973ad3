"""Token-id files: one shared zstandard dictionary, one frame per document, random access by index.

A file is::

    magic (8 bytes), SHA-256 of the dictionary (32 bytes)
    one zstandard frame per document: its ids as little-endian unsigned 16-bit integers
    index: per document id, whether it has one (0: a null id), first frame byte, frame bytes, ids (five little-endian 64-bit integers)
    footer: first index byte, number of documents (two 64-bit integers), magic

The dictionary is trained on the serialized ids of a bounded sample of documents
(``sample_docs`` with the smallest hash of the id, ``sample_bytes`` of each); it
only serves compression. Documents are dealt by ranges of the id and sorted, so
file order is id order; sums per file give every file its first id position.

Texts are encoded by the tokenizers library. The model splits a text into parts
(words with the blank before them, digits, other characters, white space) and
encodes each on its own, so a worker splits Latin texts itself, remembers the
parts and gives the library only those that are new; any other text, and one
that holds a special token, is encoded whole.

Defined results: null counts as empty, and an empty text is the end id alone;
repeated ids are ordered by the hash of their text; rows with a null id come
first and are read back with a null id; extra columns are ignored; an empty table makes no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from abaculus.llm.shared import Workspace, open_fs, prepare_workers, publish, smallest_hashes

MAGIC = b"ABTOKEN2"
MODEL = "byte_bpe_50k.json"
END_ID = 2
#: Fixed value: the splitter of byte-level BPE vocabularies of this family, in this module's syntax.
SPLITTER = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Latin texts, without the few characters that the library's splitter and this one class differently.
SAFE = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*")
#: SPLITTER for safe texts: its classes as plain ranges, words first, runs that nothing after them can shorten.
SAFE_SPLITTER = re.compile(r" ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]++|'(?:s|t|re|ve|m|ll|d)| ?[0-9]++| ?[^\s0-9A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]++|\s+(?!\S)|\s+")
MEMO_PARTS = 500_000  # parts that a worker remembers (about 0.2 KB each)
SLICE_CHARS = 400_000  # characters of the texts that are split at once
JOINED = 200  # new words given to the library as one text


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def little(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 16-bit integers."""
    a = array("H", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Encoder:
    """Ids of texts as bytes (unsigned 16-bit), with a memory of the splitter's parts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are stored in 16 bits")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        blank = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0][:1]
        self.begins = np.zeros(1 << 16, bool)  # ids that begin with a blank
        self.begins[[i for t, i in vocabulary.items() if t.startswith(blank)]] = True
        self.parts: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [little(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words with a blank before them, many to a text: a word ends where the next id begins with a blank."""
        groups, out = [words[i : i + JOINED] for i in range(0, len(words), JOINED)], []
        for group, raw in zip(groups, self._ids(["".join(g) for g in groups])):
            ids = np.frombuffer(raw, np.uint16)
            cuts = np.append(2 * np.flatnonzero(self.begins[ids]), len(raw)).tolist()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])] if len(cuts) == len(group) + 1 else self._ids(group)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The texts' ids, split and looked up in slices of SLICE_CHARS characters (a longer text is a slice)."""
        out, begin, held = [], 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= SLICE_CHARS:
                out += self._encode(texts[begin : i + 1])
                begin, held = i + 1, 0
        return out + self._encode(texts[begin:])

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [SAFE_SPLITTER.findall(t) if SAFE.fullmatch(t) and not any(s in t for s in self.special) else None for t in texts]
        if len(self.parts) > MEMO_PARTS:
            self.parts.clear()
        found = [c and list(map(self.parts.get, c)) for c in cut]  # one look-up a part; again only where a part is new
        new = [bool(f) and None in f for f in found]
        fresh = sorted({p for c, f, n in zip(cut, found, new) if n for p, ids in zip(c, f) if ids is None})
        words = [p for p in fresh if p[0] == " " and p[1:].isalpha()]
        other = [p for p in fresh if not (p[0] == " " and p[1:].isalpha())]
        self.parts.update(zip(words, self._words(words)))
        self.parts.update(zip(other, self._ids(other)))
        known = self.parts.__getitem__
        return [self._ids([t])[0] if f is None else b"".join(map(known, c) if n else f) for t, c, f, n in zip(texts, cut, found, new)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def serialized(texts: list[str], path: str, end_id: int) -> list[bytes]:
    end = little([end_id])
    return [ids + end for ids in encoder(path).encode(texts)]


def train_dictionary(docs: DataFrame, path: str, end_id: int, sample_docs: int = 1000, sample_bytes: int = 8192, size: int = 65536) -> bytes:
    """A zstandard dictionary of at most ``size`` bytes."""
    import zstandard

    chosen = smallest_hashes(docs.select("doc_id"), sample_docs, "doc_id").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"ids": [b[:sample_bytes] for b in serialized(batch["text"].tolist(), path, end_id)]})

    rows = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "ids binary").limit(2 * sample_docs).collect()
    samples = sorted(bytes(r["ids"]) for r in rows)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they serve as they are
        return b"".join(samples)[:size]


def _dictionary(content: bytes, level: int | None = None):
    """The dictionary, digested once for all frames where a level to compress at is given."""
    import zstandard

    found = zstandard.ZstdCompressionDict(content)
    if level is not None:
        found.precompute_compress(level=level)
    return found


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, level: int = 3) -> DataFrame:
    """Write the files into ``folder``; returns (shard, uri, n_docs, n_tokens) per file."""
    spark, path = docs.sparkSession, path or model_path()
    prepare_workers(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    content = train_dictionary(texts, path, end_id)
    publish(f"{folder}/dictionary", lambda out: out.write(content), 0)
    digest, shared = hashlib.sha256(content).digest(), spark.sparkContext.broadcast(content)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        task, index = TaskContext.get(), []
        uri, tokens = f"{folder}/part-{task.partitionId():06d}.tok", 0
        compressor = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(shared.value, level), write_checksum=True)

        def body(out) -> None:
            out.write(MAGIC + digest)
            at = len(MAGIC) + len(digest)
            for batch in batches:
                for doc_id, known, ids in zip(batch["doc_id"], batch["known"], serialized(batch["text"].tolist(), path, end_id)):
                    frame = compressor.compress(ids)
                    out.write(frame)
                    index.append((int(doc_id), int(known), at, len(frame), len(ids) // 2))
                    at += len(frame)
            out.write(np.array(index, "<i8").tobytes())
            out.write(struct.pack("<QQ", at, len(index)) + MAGIC)

        publish(uri, body, task.taskAttemptId())
        yield pd.DataFrame({"shard": [task.partitionId()], "uri": [uri], "n_docs": [len(index)], "n_tokens": [sum(r[4] for r in index)]})

    ordered = texts.withColumn("text", F.coalesce("text", F.lit(""))).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered = ordered.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text")  # pandas has no null integers
    return ordered.mapInPandas(run, "shard long, uri string, n_docs long, n_tokens long")


class TokenFile:
    """Random access to one file: any document's ids by its place in the index."""

    def __init__(self, uri: str, dictionary: bytes):
        import zstandard

        store, path = open_fs(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        at, n, magic = struct.unpack("<QQ8s", self.file.read_at(24, size - 24))
        head = self.file.read_at(40, 0)
        if magic != MAGIC or head[:8] != MAGIC or head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not a token file of this dictionary")
        self.index = np.frombuffer(self.file.read_at(size - 24 - at, at), "<i8").reshape(n, 5)
        self._decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def ids(self, place: int) -> np.ndarray:
        _, _, at, length, _ = self.index[place].tolist()
        return np.frombuffer(self._decompress(self.file.read_at(length, at)), "<u2")


def read(spark: SparkSession, shards: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids (null unless ``with_ids``) and ids_crc32 of every document in the files of ``shards``."""
    prepare_workers(spark)
    ordered = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one small row per file
    based = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(ordered), F.lit(0)))

    def frame(out: list) -> pd.DataFrame:
        found = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])
        return found.assign(doc_id=pd.array([r[0] for r in out], "Int64"))  # a float would round large ids beside a null

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = open_fs(f"{folder}/dictionary")
        with store.open_input_file(path) as f:
            dictionary = f.read()
        for batch in batches:
            for uri, start in zip(batch["uri"], batch["base"]):
                tokens = TokenFile(uri, dictionary)
                out, held = [], 0
                for place, (doc_id, known, *_) in enumerate(tokens.index.tolist()):
                    ids = tokens.ids(place)
                    out.append((doc_id if known else None, start, len(ids), ids.tobytes() if with_ids else None, zlib.crc32(ids.astype("<u4").tobytes())))
                    start, held = start + len(ids), held + len(ids)
                    if len(out) == 500 or held >= 1 << 20:
                        yield frame(out)
                        out, held = [], 0
                yield frame(out)

    parts = max(1, based.count())
    return based.where("n_docs > 0").repartition(parts, "shard").mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    ws = Workspace(docs.sparkSession, "token-files")
    shards = ws.write(write(docs, ws.at("files"), path), "shards")
    return read(docs.sparkSession, shards, ws.at("files"), with_ids)
