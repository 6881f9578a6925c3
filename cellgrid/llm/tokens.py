"""Tokenization of whole texts, and token-ID files with a shared compression dictionary.

File format: a folder with two tables. ``dictionary`` has one row: the zstandard
dictionary and its SHA-256. ``blocks`` has a row for each run of documents in
order of ``doc_id``: shard, block, first and last ``doc_id``, id counts, the
dictionary's hash, an index (``doc_id``, byte offset, id count a document) and
the payload, one frame a document. One short document is read by pruning blocks
on their ``doc_id`` range and inflating a single frame.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import run_dir, stored, table, width
from .words import BYTE, SPACE, mix, places, texts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pre-tokenizer never looks across these runs, so each is encoded by itself.
_RUN = re.compile(f" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
#: White space outside ASCII, in UTF-8.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Bounds of what an encoder remembers, and the bytes it encodes at once.
_KNOWN_RUNS, _KNOWN_IDS, _BATCH_BYTES = 600_000, 3_000_000, 1 << 18
#: Runs that the tokenizer gets as one sequence.
_SEQUENCE = 1000
#: ASCII letters, and ASCII marks other than the apostrophe: the pre-tokenizer parts them wherever they meet.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = 2

#: Bounds of the dictionary: documents of the sample, characters of one of them, bytes of the dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 20_000, 1 << 16
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096
_INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("count", "<u4")])
_NO_ID = -(1 << 63)


class Encoder:
    """Token ids of whole texts.

    Runs between spaces recur, so each is encoded once and found again by a
    64-bit hash of its bytes (two of the at most 600,000 remembered runs
    are confused with a chance of one in ten million). Strings of special
    tokens inside a text are ordinary text.
    """

    def __init__(self, path: str = VOCABULARY) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each id: a byte-level token has a letter for each byte.
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self._forget()

    def _forget(self) -> None:
        self.runs, self.ids, self.used = 0, np.empty(1 << 20, np.uint32), 0
        self.at, self.n = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        # An open hash table of twice to four times as many places as runs: hash, number of the run.
        self.keys, self.number = np.zeros(1 << 18, np.uint64), np.zeros(1 << 18, np.int32)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each run, -1 of one not met before; a hash is never 0."""
        mask = np.uint64(len(self.keys) - 1)
        place = hashes & mask
        found = self.keys[place]
        out = np.where(found == hashes, self.number[place], np.int32(-1))
        todo = np.flatnonzero((found != hashes) & (found != 0))
        place = place[todo]
        while len(todo):
            place = (place + np.uint64(1)) & mask
            found = self.keys[place]
            hit = found == hashes[todo]
            out[todo[hit]] = self.number[place[hit]]
            on = ~hit & (found != 0)
            todo, place = todo[on], place[on]
        return out

    def _enter(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        place = hashes & mask
        while len(hashes):
            free = self.keys[place] == 0
            self.keys[place[free]] = hashes[free]
            own = self.keys[place] == hashes
            self.number[place[own]] = numbers[own]
            hashes, numbers, place = hashes[~own], numbers[~own], (place[~own] + np.uint64(1)) & mask

    def _learn(self, hashes: np.ndarray, texts: list[bytes]) -> None:
        """Encode runs not met before, in sequences of many; the bytes of the ids tell the runs apart."""
        words = [t.decode() for t in texts]
        asked = [words[i : i + _SEQUENCE] for i in range(0, len(words), _SEQUENCE)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(asked, is_pretokenized=True, add_special_tokens=False)])
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))) + 1
        new, end = len(texts), self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(2 * end - self.used, np.uint32)])
        if self.runs + new > len(self.at):
            more = np.empty(2 * new + self.runs, np.int64)
            self.at, self.n = np.concatenate([self.at[: self.runs], more]), np.concatenate([self.n[: self.runs], more])
        self.ids[self.used : end] = ids
        self.n[self.runs : self.runs + new] = np.diff(ends, prepend=0)
        self.at[self.runs : self.runs + new] = self.used + ends - self.n[self.runs : self.runs + new]
        if 2 * (self.runs + new) > len(self.keys):
            on = self.keys != 0
            keys, number = self.keys[on], self.number[on]
            size = 1 << int(4 * (self.runs + new) - 1).bit_length()
            self.keys, self.number = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._enter(keys, number)
        self._enter(hashes, np.arange(self.runs, self.runs + new, dtype=np.int32))
        self.runs, self.used = self.runs + new, end

    def _batch(self, data: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
        """Ids of the texts between ``cuts``, which hold no white space outside ASCII."""
        if not len(data):
            return [np.empty(0, np.uint32)] * (len(cuts) - 1)
        inside = ~SPACE[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[cuts] = True
        turn = inside[1:] != inside[:-1]
        start = np.zeros(len(data), bool)  # of a word
        start[0] = inside[0]
        start[1:] = turn & inside[1:]
        new = begins[:-1]
        start |= new & inside
        first = np.flatnonzero(start)
        led = first[(first > 0) & ~new[first]]  # words after white space in their text
        edge = begins.copy()
        edge[1:-1] |= turn & inside[:-1]  # white space after a word
        edge[led - 1] = True
        edge[led] |= data[led - 1] != 0x20
        kind = _KIND[data]
        edge[1:-1] |= (kind[1:] + kind[:-1] == 3) & (kind[1:] != 0) & (kind[:-1] != 0)
        starts = np.flatnonzero(edge[:-1])
        sizes = np.diff(np.append(starts, len(data)))
        value = BYTE[data] * places(int(sizes.max()))[np.arange(len(data)) - np.repeat(starts, sizes)]
        hashes = np.maximum(mix(np.add.reduceat(value, starts) + sizes.astype(np.uint64)), np.uint64(1))
        if self.runs > _KNOWN_RUNS or self.used > _KNOWN_IDS:
            self._forget()
        k = self._find(hashes)
        missing = np.flatnonzero(k < 0)
        if len(missing):
            unseen, one = np.unique(hashes[missing], return_index=True)
            whole = data.tobytes()
            self._learn(unseen, [whole[a : a + n] for a, n in zip(starts[missing[one]].tolist(), sizes[missing[one]].tolist(), strict=True)])
            k[missing] = self._find(hashes[missing])
        n = self.n[k]
        to = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[k] - (to - n), n) + np.arange(int(to[-1]))]
        bounds = np.append(0, to)[np.searchsorted(starts, cuts)]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each row of a string column; a null row has none."""
        data, offsets = texts(column)
        rows, i = len(offsets) - 1, 0
        while i < rows:
            j = min(rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + _BATCH_BYTES, side="right")) - 1))
            part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if len(part) > 2 * _BATCH_BYTES or _WIDE.search(part):
                for a, b in zip(cuts, cuts[1:], strict=False):
                    yield self.by_runs(part[a:b].tobytes().decode())
            else:
                yield from self._batch(part, cuts)
            i = j

    def by_runs(self, text: str) -> np.ndarray:
        """Ids of one text with any white space and of any length, run by run."""
        runs = _RUN.findall(text)
        out: list[np.ndarray] = [np.empty(0, np.uint32)]
        for i in range(0, len(runs), 1 << 18):
            some = runs[i : i + (1 << 18)]
            unique = list(dict.fromkeys(some))
            ids = dict(zip(unique, self.plain(unique), strict=True))
            out += [ids[r] for r in some]
        return np.concatenate(out)

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.column(pa.array([text], pa.string())))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of this process: the tasks of one worker share what it remembers."""
    return Encoder(path)


def trained_dictionary(docs: DataFrame, path: str, end: int, kind: str) -> bytes:
    """A dictionary from serialized ids of a bounded sample of documents, the first by hash; empty for too few.

    One pass: of all texts those below a hash that about twice the sample lies
    below, each different one once.
    """
    mark = F.xxhash64("doc_id", "text")
    below = min(1.0, 2 * SAMPLE_DOCS / max(1, docs.count()))
    some = docs.filter((mark <= int((below - 0.5) * float((1 << 64) - 4096))) & F.length("text").between(1, SAMPLE_CHARS)).groupBy(mark.alias("mark")).agg(F.min("text").alias("text"))
    encode = encoder(path)
    samples = [np.append(encode(r[1]), np.uint32(end)).astype(kind).tobytes() for r in sorted(some.collect())[:SAMPLE_DOCS]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b""


def frames(docs: DataFrame, shared: bytes, path: str, end: int, kind: str) -> DataFrame:
    """``(doc_id, tie, n, frame)``: each text's ids with ``end``, in one compressed frame, where the text is read."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)
        for part in parts:
            n, out = [], []
            for own in encode.column(part.column("text")):
                ids = np.append(own, np.uint32(end))
                n.append(len(ids))
                out.append(press.compress(ids.astype(kind).tobytes()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "tie", "n", "frame"])

    tie = F.concat(F.rpad(F.left(F.coalesce("text", F.lit("")), F.lit(16)), 16, "\0"), F.lpad(F.hex(F.xxhash64("text")), 16, "0"))
    return docs.withColumn("tie", tie).mapInArrow(run, "doc_id long, tie string, n long, frame binary")


def write_token_files(docs: DataFrame, out: str, path: str = VOCABULARY, end: int = 2) -> None:
    """Encode every whole text of ``docs(doc_id, text, ...)``, append ``end`` and write the format above to ``out``.

    Null texts are empty. Rows are in order of ``doc_id`` (null first), those of
    one by the first characters and a hash of the text; repeated rows are written
    as often as they come. Other columns are ignored. Ids take two bytes, or
    four for a vocabulary above 65,536. Frames are shuffled, not texts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "<u2" if max(len(encoder(path).bytes), end + 1) <= 1 << 16 else "<u4"
    shared = trained_dictionary(docs, path, end, kind)
    mark = hashlib.sha256(shared).hexdigest()
    spark.createDataFrame([(mark, bytearray(shared), kind)], "sha256 string, dictionary binary, kind string").coalesce(1).write.parquet(f"{out}/dictionary")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        index: list[tuple[int, int, int]] = []
        held: list[bytes] = []
        at = 0

        def flushed() -> pa.RecordBatch:
            n = sum(c for _, _, c in index)
            row = {"shard": shard, "block": block, "first_doc": index[0][0], "last_doc": index[-1][0], "n_docs": len(index), "before": before, "n_ids": n, "dictionary_sha256": mark, "index": np.array(index, _INDEX).tobytes(), "payload": b"".join(held)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("dictionary_sha256", pa.string()), ("index", pa.binary()), ("payload", pa.binary())]))

        for part in parts:
            for doc, n, frame in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n", "frame")), strict=True):
                index.append((_NO_ID if doc is None else doc, at, n))
                held.append(frame)
                at += len(frame)
                if at >= BLOCK_BYTES or len(index) >= BLOCK_DOCS:
                    yield flushed()
                    block, before = block + 1, before + sum(c for _, _, c in index)
                    index, held, at = [], [], 0
        if index:
            yield flushed()

    kinds = "shard int, block int, first_doc long, last_doc long, n_docs int, before long, n_ids long, dictionary_sha256 string, index binary, payload binary"
    # Written first, since dividing into ranges reads its input twice.
    encoded = stored(frames(docs, shared, path, end, kind), "frames")
    ordered = encoded.repartitionByRange(width(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "n", "frame").mapInArrow(run, kinds).write.option("compression", "none").parquet(f"{out}/blocks")


def read_token_files(spark: SparkSession, out: str, only: list[int] | None = None) -> DataFrame:
    """``(doc_id, start, ids)`` of the documents in ``out``, or of ``only`` some; ``start``: ids of all documents before."""
    mark, shared, kind = spark.read.parquet(f"{out}/dictionary").first()
    shared, wanted = bytes(shared), None if only is None else set(only)
    if hashlib.sha256(shared).hexdigest() != mark:
        raise ValueError("the dictionary does not match its hash")
    blocks = spark.read.parquet(f"{out}/blocks")
    # A row for each shard, as many as the writer had partitions.
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    first = totals.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("shard_start"))
    if wanted is not None:
        near = F.lit(False)
        for i in sorted(wanted):
            near = near | F.lit(i).between(F.col("first_doc"), F.col("last_doc"))
        blocks = blocks.filter(near)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)
        for part in parts:
            for row in part.to_pylist():
                if row["dictionary_sha256"] != mark:
                    raise ValueError("a block was written with another dictionary")
                index = np.frombuffer(row["index"], _INDEX)
                stops = [*index["offset"][1:].tolist(), len(row["payload"])]
                starts = np.cumsum(index["count"], dtype=np.int64) - index["count"] + row["shard_start"] + row["before"]
                pick = [k for k in range(len(index)) if wanted is None or int(index["doc_id"][k]) in wanted]
                ids = [np.frombuffer(inflate.decompress(row["payload"][int(index["offset"][k]) : stops[k]]), kind).astype("<u4") for k in pick]
                docs = [None if (d := int(index["doc_id"][k])) == _NO_ID else d for k in pick]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts[pick], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())], ["doc_id", "start", "ids"])

    return blocks.join(F.broadcast(first), "shard").select("dictionary_sha256", "index", "payload", "before", "shard_start").mapInArrow(run, "doc_id long, start long, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read from the files written for all documents."""
    out = f"{run_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), out)
    back = read_token_files(spark, out)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def pieces(docs: DataFrame, capacity: int, path: str = VOCABULARY, end: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: texts with ``end``, cut from the end into ``capacity`` ids where longer."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for part in parts:
            rows = []
            for doc, own in zip(part.column("doc_id").to_pylist(), encode.column(part.column("text")), strict=True):
                ids = np.append(own, np.uint32(end))
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
