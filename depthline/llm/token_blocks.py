"""Token ids in files of static range asymmetric numeral system (rANS) blocks.

``write_tokens`` encodes whole texts, sorts documents by id over range partitions
(the shards) and packs each shard's ids into blocks of whole documents.  One
frequency table, counted over all ids and scaled to ``2**SCALE_BITS``, serves every
block.  A block is cut into segments; each segment is coded on its own by
interleaved lanes, and the block's head lists every segment's byte offset and first
token (the checkpoints), so segments decode in parallel.  Each segment carries
checksums of its coded words and of its ids, which the reader verifies.

The files are rows of a Parquet table ``blocks`` (one binary block a row, with the
documents it holds) beside a table ``frequencies``; Spark's commit protocol makes
them survive lost executors.  Ids are counted while they are packed: each task's counts
stand in its first row and are summed in Spark.  Only the frequency table (a row for each
id of the vocabulary) goes through the driver.

Block layout, little-endian: ``b"RANB"``, u32 version, u32 segments, then per segment
u32 byte offset and u32 first token; then segments: u32 ids, u32 lanes, u32 words,
u32 crc32 of the words, u32 crc32 of the ids as u32, lane states u64, words u32.

Defined results: a null text counts as empty and yields the end id alone; ids of null
sort first; rows with equal ids are ordered by text, and each is a document of its own;
an empty table gives empty files; a block holds whole documents, so a very long text makes
a long block of more segments; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depthline.llm.common import Scratch, scratch_path, stored, text_of

SCALE_BITS = 18
LANES = 1024
SEGMENT = 1 << 18
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sII")
_PART = struct.Struct("<IIIII")


class FrequencyTable:
    """Static frequencies over ``2**SCALE_BITS``; every id that occurs has at least 1."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray, size: int):
        self.freq = np.zeros(size, np.uint64)
        self.freq[ids] = freqs
        self.base = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))

    @staticmethod
    def scaled(counts: np.ndarray) -> np.ndarray:
        """Frequencies of positive counts, summing to ``2**SCALE_BITS``."""
        total, full = int(counts.sum()), 1 << SCALE_BITS
        out = np.maximum(1, (counts.astype(np.float64) * full / max(total, 1)).astype(np.int64))
        order = np.argsort(-out, kind="stable")
        over = int(out.sum()) - full
        if over < 0:
            out[order[0]] -= over
        for i in order:
            if over <= 0:
                break
            cut = min(over, int(out[i]) - 1)
            out[i] -= cut
            over -= cut
        return out


def encode_segment(ids: np.ndarray, table: FrequencyTable, lanes: int = LANES) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n))
    # (q << SCALE_BITS) + (y - q f) + base is y + q (2**SCALE_BITS - f) + base.
    full_scale, shift = np.uint64(1 << SCALE_BITS), np.uint64(63 - SCALE_BITS)
    x, chunks = np.full(lanes, LOW, np.uint64), []
    freq, base = table.freq[ids], table.base[ids]
    limit, word = freq << shift, np.uint64(32)
    for at in range((n - 1) // lanes * lanes, -1, -lanes):
        f = freq[at : at + lanes]
        y = x[: len(f)]
        full = np.flatnonzero(y >= limit[at : at + lanes])
        if len(full):
            high = y[full]
            chunks.append(high.astype(np.uint32))
            y[full] = high >> word
        q = y // f
        y += q * (full_scale - f) + base[at : at + lanes]
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    body = words.astype("<u4").tobytes()
    return _PART.pack(n, lanes, len(words), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + x.astype("<u8").tobytes() + body


def decode_segment(data: memoryview, table: FrequencyTable) -> np.ndarray:
    n, lanes, n_words, crc_words, crc_ids = _PART.unpack_from(data)
    at = _PART.size
    x = np.frombuffer(data, "<u8", lanes, at).astype(np.uint64)
    body = data[at + 8 * lanes : at + 8 * lanes + 4 * n_words]
    if zlib.crc32(body) != crc_words:
        raise ValueError("damaged segment: the checksum of its words differs")
    words = np.frombuffer(body, "<u4").astype(np.uint64)
    mask, scale, out, p = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.empty(n, np.uint32), 0
    for start in range(0, n, lanes):
        k = min(lanes, n - start)
        y = x[:k]
        slot = y & mask
        s = table.symbol[slot]
        out[start : start + k] = s
        y = table.freq[s] * (y >> scale) + slot - table.base[s]
        low = y < LOW
        c = int(np.count_nonzero(low))
        if c:
            y[low] = (y[low] << np.uint64(32)) | words[p : p + c]
            p += c
        x[:k] = y
    if zlib.crc32(out.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("damaged segment: the checksum of its ids differs")
    return out


def encode_block(ids: np.ndarray, table: FrequencyTable) -> bytes:
    parts = [encode_segment(ids[i : i + SEGMENT], table) for i in range(0, len(ids), SEGMENT)]
    at, marks = _HEAD.size + 8 * len(parts), b""
    for i, part in enumerate(parts):
        marks += struct.pack("<II", at, i * SEGMENT)
        at += len(part)
    return _HEAD.pack(b"RANB", 1, len(parts)) + marks + b"".join(parts)


def decode_block(block: bytes, table: FrequencyTable, first: int = 0, count: int | None = None) -> np.ndarray:
    """Ids ``first .. first + count`` of a block; only the segments that hold them are decoded."""
    magic, version, n = _HEAD.unpack_from(block)
    if magic != b"RANB" or version != 1:
        raise ValueError("not a block of this format")
    marks = np.frombuffer(block, "<u4", 2 * n, _HEAD.size).reshape(n, 2)
    view = memoryview(block)
    stop = None if count is None else first + count
    use = [i for i in range(n) if int(marks[i, 1]) + SEGMENT > first and (stop is None or int(marks[i, 1]) < stop)]
    if not use:
        return np.zeros(0, np.uint32)
    out = np.concatenate([decode_segment(view[int(marks[i, 0]) :], table) for i in use])
    skip = first - int(marks[use[0], 1])
    return out[skip : None if count is None else skip + count]


#: Closing marks that the vocabulary's own splitting parts from a letter before them.
TAIL = ".,!?;:#*$%&|"


class WordEncoder:
    """Encodes texts with the tokenizers library, each word once.

    The vocabulary's own pre-tokenizer never joins over white space, nor a letter with a
    closing mark after it, and lower-cases; so a text's ids are those of its words, taken
    in lower case, and a word's those of its core and the marks that close it.  Words not seen before go to
    the library, words of letters alone many at a time: each ends with a word-end id,
    which gives the bounds (where the count differs, the words go one by one).  ``limit``
    bounds the memory of the look-up, not what is encoded.
    """

    def __init__(self, path: str, dtype: str, limit: int = 1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.code, self.limit = Tokenizer.from_file(path), "H" if dtype == "<u2" else "I", limit
        self.words: dict[str, bytes] = {"": b""}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _single(self, parts: list[str]) -> None:
        for i in range(0, len(parts), 10_000):
            for w, e in zip(parts[i : i + 10_000], self.tokenizer.encode_batch_fast(parts[i : i + 10_000], add_special_tokens=False)):
                self.words[w] = array(self.code, e.ids).tobytes()

    def _many(self, parts: list[str]) -> None:
        for i in range(0, len(parts), 2_000):
            part = parts[i : i + 2_000]
            ids = array(self.code, self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids)
            stops = np.flatnonzero(self.ends[np.frombuffer(ids, np.uint16 if self.code == "H" else np.uint32)]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                self._single(part)
                continue
            data, stops = ids.tobytes(), (stops * ids.itemsize).tolist()
            self.words.update(zip(part, map(data.__getitem__, map(slice, [0, *stops], stops))))

    @staticmethod
    def _split(text: str) -> list[str]:
        # Special tokens are found by their exact letters; combining marks (two lead bytes) may
        # compose with a lower-case letter alone, so such texts keep their case.
        if text.isascii():
            text = text if "<|" in text else text.lower()
        elif "<|" not in text:
            raw = text.encode("utf-8", "surrogatepass")
            if b"\xcc" not in raw and b"\xcd" not in raw:
                text = raw.lower().decode("utf-8", "surrogatepass")
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")

    def _learn(self, new: set[str]) -> None:
        known, parts, closed = self.words, set(), []
        for w in new:
            core = w.rstrip(TAIL)
            if len(core) < len(w) and core and core[-1].isalpha() and len(core[-1].lower()) == 1:
                closed.append((w, core, w[len(core) :]))
                parts.add(core)
                parts.add(w[len(core) :])
            else:
                parts.add(w)
        parts = parts.difference(known)
        # Words of letters alone give one part each.
        letters = [w for w in parts if w.isalpha()]
        self._many(letters)
        if len(letters) < len(parts):
            self._single([w for w in parts if not w.isalpha()])
        get = known.__getitem__
        known.update((w, get(core) + get(tail)) for w, core, tail in closed)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._split(t) for t in texts]
        if len(self.words) > self.limit:
            self.words = {"": b""}
        known = self.words
        new = set().union(*split).difference(known)
        if new:
            self._learn(new)
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]


_ENCODERS: dict[tuple, WordEncoder] = {}


def _encoder(path: str, dtype: str) -> WordEncoder:
    """One per Python worker, kept between tasks."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = WordEncoder(path, dtype)
    return _ENCODERS[path, dtype]


_PLACES = "shard int, block int, at long, doc_ids array<long>, lengths array<int>, total long"


def _pack(path: str, dtype: str, end_id: int, block_ids: int, size: int):
    """Blocks of ids of a task's documents and, at its last block, how often the task has each id."""

    def run(batches):
        encoder, end = _encoder(path, dtype), np.array([end_id], dtype).tobytes()
        shard, block, at = TaskContext.get().partitionId(), 0, 0
        width, counts = len(end), np.zeros(size, np.int64)
        doc_ids, lengths, parts, total = [], [], [], 0

        def row(last: bool):
            data = b"".join(parts)
            np.add(counts, np.bincount(np.frombuffer(data, dtype), minlength=size), out=counts)
            used = np.flatnonzero(counts) if last else np.zeros(0, np.int64)
            made = {"shard": [shard], "block": [block], "at": [at], "doc_ids": [doc_ids], "lengths": [lengths], "total": [total], "ids": [data], "used": [used], "counts": [counts[used]]}
            return pd.DataFrame(made)

        for batch in batches:
            # A row goes on only when a next one comes, so the last one is known.
            texts, ids = batch["t"].tolist(), batch["doc_id"].astype("Int64").tolist()
            for lo in range(0, len(texts), 256):
                for doc_id, coded in zip(ids[lo : lo + 256], encoder.encode(texts[lo : lo + 256])):
                    if total >= block_ids:
                        yield row(False)
                        block, at = block + 1, at + total
                        doc_ids, lengths, parts, total = [], [], [], 0
                    doc_ids.append(None if doc_id is pd.NA else doc_id)
                    lengths.append(len(coded) // width + 1)
                    parts += (coded, end)
                    total += lengths[-1]
        if doc_ids:
            yield row(True)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, vocab_size: int | None = None, block_ids: int = 2 * SEGMENT) -> None:
    """Encode every text of ``docs``, append ``end_id`` to each and write the files under ``path``."""
    from tokenizers import Tokenizer

    size = max(vocab_size or Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    spark = docs.sparkSession
    with Scratch(spark):
        ordered = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("t")).repartitionByRange("doc_id", "t").sortWithinPartitions("doc_id", "t")
        blocks = stored(ordered.mapInPandas(_pack(tokenizer_path, dtype, end_id, block_ids, size), f"{_PLACES}, ids binary, used array<int>, counts array<long>"), "token-ids")

        def count(batches):
            """One task's share of the counts, a row for each id it has."""
            total = np.zeros(size, np.int64)
            for batch in batches:
                for used, n in zip(batch["used"], batch["counts"]):
                    total[used] += n
            used = np.flatnonzero(total)
            yield pd.DataFrame({"id": used, "n": total[used]})

        summed = blocks.select("used", "counts").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        counts = summed.orderBy("id").toPandas()
        ids, freqs = counts["id"].to_numpy(np.int64), FrequencyTable.scaled(counts["n"].to_numpy(np.int64)) if len(counts) else np.zeros(0, np.int64)
        spark.createDataFrame(pd.DataFrame({"id": ids, "frequency": freqs, "size": np.full(len(ids), size)}), "id long, frequency long, size long").coalesce(1).write.parquet(f"{path}/frequencies")
        table = FrequencyTable(ids, freqs, size)

        def code(batches):
            for batch in batches:
                # A block at a time, so that no more than one coded block waits to be written.
                for i, ids in enumerate(batch.column("ids")):
                    data = encode_block(np.frombuffer(ids.as_buffer(), dtype), table)
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:-1], pa.array([data], pa.binary())], names=[*batch.schema.names[:-1], "data"])

        places = [f.split()[0] for f in _PLACES.split(", ")]
        blocks.select(*places, "ids").mapInArrow(code, f"{_PLACES}, data binary").write.parquet(f"{path}/blocks")


def _read(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:
    listed = spark.read.parquet(f"{path}/frequencies").orderBy("id").toPandas()
    table = FrequencyTable(listed["id"].to_numpy(np.int64), listed["frequency"].to_numpy(np.int64), int(listed["size"].max()) if len(listed) else 1)
    blocks = spark.read.parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("total").alias("n"))
    first = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    placed = blocks.join(first, "shard").select((F.col("at") + F.col("first")).alias("at"), "doc_ids", "lengths", "data")

    def run(batches):
        for batch in batches:
            for at, doc_ids, lengths, data in zip(batch["at"], batch["doc_ids"], batch["lengths"], batch["data"]):
                ids = decode_block(data, table)
                ends = np.cumsum(np.asarray(lengths, np.int64))
                if len(ids) != int(ends[-1]):
                    raise ValueError("damaged block: its ids do not match its documents")
                yield rows(int(at), doc_ids, ids, ends)

    return placed.mapInPandas(run, schema)


def _ids(values) -> pd.Series:
    return pd.Series([None if v is None or v != v else int(v) for v in values], dtype="Int64")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` as the files hold them."""

    def rows(at, doc_ids, ids, ends):
        starts = np.concatenate(([0], ends[:-1]))
        return pd.DataFrame({"doc_id": _ids(doc_ids), "start": at + starts, "ids": [ids[a:b].astype(np.int32) for a, b in zip(starts, ends)]})

    return _read(spark, path, rows, "doc_id long, start long, ids array<int>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files."""

    def rows(at, doc_ids, ids, ends):
        starts, raw = np.concatenate(([0], ends[:-1])), memoryview(ids.astype("<u4").tobytes())
        return pd.DataFrame({"doc_id": _ids(doc_ids), "start": at + starts, "n_tokens": ends - starts, "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends)]})

    return _read(spark, path, rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_report(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the files to the shared folder and read the digests back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return token_digests(docs.sparkSession, path)
