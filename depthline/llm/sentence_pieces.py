"""SentencePiece encoding and decoding by suffix-array matching.

Per Arrow batch the texts are cut into units (a run of spaces and the word after it;
no piece reaches over one), and units not seen before are indexed together: the
suffixes of the concatenated units are sorted, every piece of the vocabulary is
found by binary search as a range of suffixes, and the ranges give edges
``(position, length) -> piece`` sorted by position.  The edges are then relaxed.  The
public model is a BPE model, so relaxing takes the edges in the model's merge order:
in each unit the best-scored edge over two adjacent symbols, leftmost first, until
none is left.  Characters without a piece fall back to bytes.

Ids equal the library's.  Defined results: a null text counts as empty and has no ids;
text holding the space mark itself (U+2581) decodes to spaces, as in the library; every
other text decodes to itself; repeated rows each get their ids; an empty table gives an
empty table; long texts are cut into units like any other.  Only ``doc_id`` and ``text`` are
read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from depthline.llm.common import text_of

MARK = "▁"
#: Closing marks tried as a separate unit.
TAIL = ".,!?;:#*$%&|"
_NONE = np.int64(1 << 30)
#: Units longer than this are relaxed with a heap, the others side by side.
LONG = 48
#: Characters indexed at a time.
CHUNK = 300_000


class PieceMatcher:
    def __init__(self, model_path: str, limit: int = 800_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
        self.alphabet = {c: k + 1 for k, c in enumerate(sorted({c for i in plain for c in names[i]}))}
        self.width = max(len(names[i]) for i in plain)
        self.step = self.width + 2
        self.single = {names[i]: i for i in plain if len(names[i]) == 1}
        self.pieces = np.array(plain, np.int64)
        self.lengths = np.array([len(names[i]) for i in plain], np.int64)
        codes = np.zeros((len(plain), self.width), ">u2")
        for row, i in enumerate(plain):
            codes[row, : len(names[i])] = [self.alphabet[c] for c in names[i]]
        self.low = self._rows(codes)
        high = codes.copy()
        high[np.arange(self.width)[None, :] >= self.lengths[:, None]] = 0xFFFF
        self.high = self._rows(high)
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.rank = np.full(size, _NONE, np.int64)
        self.rank[order] = np.arange(len(order))
        self.by_rank = np.array(order, np.int64)
        self.bytes_of = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else names[i].replace(MARK, " ").encode() for i in range(size)]
        self.newline = "\n" in self.alphabet
        self.units = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if self.newline else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")
        self.pairs = {names[i][k : k + 2] for i in plain for k in range(len(names[i]) - 1)}
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        self.limit = limit

    @staticmethod
    def _rows(codes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(codes).view(f"S{2 * codes.shape[1]}").ravel()

    def edges(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted edge keys ``position * step + length``, their ranks, unit starts and unit lengths."""
        chars = "\0".join(units) + "\0"
        points = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), "<u4")
        distinct, inverse = np.unique(points, return_inverse=True)
        text = np.array([self.alphabet.get(chr(p), 0) if p else 0 for p in distinct], np.uint16)[inverse]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        padded = np.concatenate((text, np.zeros(self.width, np.uint16))).astype(">u2")
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.width)[: len(text)]
        begin = np.flatnonzero(text)
        suffixes = self._rows(windows[begin])
        index = np.argsort(suffixes, kind="stable")
        suffixes = suffixes[index]
        lo, hi = np.searchsorted(suffixes, self.low, "left"), np.searchsorted(suffixes, self.high, "right")
        n = hi - lo
        hit = np.flatnonzero(n)
        n = n[hit]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = begin[index[np.repeat(lo[hit], n) + within]]
        keys = at * self.step + np.repeat(self.lengths[hit], n)
        order = np.argsort(keys)
        return keys[order], np.repeat(self.rank[self.pieces[hit]], n)[order], starts, sizes

    def _find(self, keys: np.ndarray, ranks: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        length = stop - start
        want = start * self.step + np.minimum(length, self.width + 1)
        k = np.searchsorted(keys, want)
        k[k == len(keys)] = 0
        good = (keys[k] == want) & (length <= self.width) if len(keys) else np.zeros(len(want), bool)
        return np.where(good, ranks[k] if len(keys) else 0, _NONE)

    def _relax(self, keys, ranks, starts, sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols ``(unit, start, stop)`` of short units, all units advancing together."""
        unit = np.repeat(np.arange(len(sizes)), sizes)
        begin = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        stop = begin + 1
        done = []
        rank = np.full(len(begin), _NONE, np.int64)
        same = np.flatnonzero(unit[1:] == unit[:-1])
        rank[same] = self._find(keys, ranks, begin[same], stop[same + 1])
        while len(begin):
            heads = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), heads)
            live = (best >> 32) < _NONE
            counts = np.diff(np.concatenate((heads, [len(begin)])))
            if not live.all():
                over = np.repeat(~live, counts)
                done.append((unit[over], begin[over], stop[over]))
                keep = ~over
                shift = np.cumsum(over)
                pick = (best[live] & 0xFFFFFFFF).astype(np.int64)
                pick = pick - shift[pick]
                unit, begin, stop, rank = unit[keep], begin[keep], stop[keep], rank[keep]
            else:
                pick = (best & 0xFFFFFFFF).astype(np.int64)
            if not len(pick):
                break
            stop[pick] = stop[pick + 1]
            keep = np.ones(len(begin), bool)
            keep[pick + 1] = False
            pick = pick - np.arange(len(pick))
            unit, begin, stop, rank = unit[keep], begin[keep], stop[keep], rank[keep]
            for k in (pick, pick[pick > 0] - 1):
                rank[k] = _NONE
                k = k[k + 1 < len(begin)]
                k = k[unit[k] == unit[k + 1]]
                rank[k] = self._find(keys, ranks, begin[k], stop[k + 1])
        if not done:
            return unit, begin, stop
        out = [np.concatenate(x) for x in zip(*done)]
        order = np.argsort(out[1], kind="stable")
        return out[0][order], out[1][order], out[2][order]

    def _relax_long(self, keys, ranks, start: int, size: int) -> list[tuple[int, int]]:
        """The same for one long unit, with a heap over its adjacent symbols."""
        lo, hi = np.searchsorted(keys, [start * self.step, (start + size) * self.step])
        table = dict(zip(keys[lo:hi].tolist(), ranks[lo:hi].tolist()))
        stop = list(range(start + 1, start + size + 1))
        before, alive = list(range(-1, size - 1)), [True] * size
        heap = []

        def push(i: int) -> None:
            j = stop[i] - start
            if j < size:
                length = stop[j] - (start + i)
                r = table.get((start + i) * self.step + length) if length <= self.width else None
                if r is not None:
                    heapq.heappush(heap, (r, i, stop[i], stop[j]))

        for i in range(size):
            push(i)
        while heap:
            _, i, mid, end = heapq.heappop(heap)
            if not alive[i] or stop[i] != mid or stop[mid - start] != end:
                continue
            alive[mid - start] = False
            stop[i] = end
            if end - start < size:
                before[end - start] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [(start + i, stop[i]) for i in range(size) if alive[i]]

    def _learn(self, units: list[str]) -> None:
        """Find the ids of units and remember them."""
        keys, ranks, starts, sizes = self.edges(units)
        chars = "\0".join(units) + "\0"
        short = np.flatnonzero(sizes <= LONG)
        _, begin, stop = self._relax(keys, ranks, starts[short], sizes[short])
        long = [s for k in np.flatnonzero(sizes > LONG) for s in self._relax_long(keys, ranks, int(starts[k]), int(sizes[k]))]
        if long:
            begin = np.concatenate((begin, [a for a, _ in long]))
            stop = np.concatenate((stop, [b for _, b in long]))
            order = np.argsort(begin)
            begin, stop = begin[order], stop[order]
        found = self._find(keys, ranks, begin, stop)
        ids = np.where(found < _NONE, self.by_rank[np.minimum(found, len(self.by_rank) - 1)], -1)
        if (ids < 0).any():
            parts = []
            cut = np.flatnonzero(ids < 0)
            last, counts = 0, np.ones(len(ids), np.int64)
            for k in cut:
                raw = np.frombuffer(chars[int(begin[k])].encode("utf-8", "surrogatepass"), np.uint8)
                parts += [ids[last:k], self.byte_ids[raw]]
                counts[k] = len(raw)
                last = k + 1
            bounds = np.searchsorted(begin, np.concatenate((starts, [len(chars)])))
            ends = np.concatenate(([0], np.cumsum(counts)))[bounds]
            ids = np.concatenate([*parts, ids[last:]])
        else:
            ends = np.searchsorted(begin, np.concatenate((starts, [len(chars)])))
        raw, ends = ids.astype("<u2" if len(self.rank) <= 1 << 16 else "<u4"), ends.tolist()
        data, w = raw.tobytes(), raw.itemsize
        self.parts.update((u, data[w * a : w * b]) for u, a, b in zip(units, ends, ends[1:]))

    def _cut(self, unit: str) -> tuple[str, str]:
        """A unit as core and closing marks, where no piece joins the two."""
        core = unit.rstrip(TAIL)
        tail = unit[len(core) :]
        return (core, tail) if tail and core and core[-1] + tail[0] not in self.pairs else (unit, "")

    @property
    def dtype(self) -> str:
        return "<u2" if len(self.rank) <= 1 << 16 else "<u4"

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.units.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > self.limit // 3:
            self.known.clear()
        if len(self.parts) > self.limit:
            self.parts = {"": b""}
        known, parts = self.known, self.parts
        cut = [(u, *self._cut(u)) for u in {u for units in split for u in units if u not in known}]
        part, size = [], 0
        for u in {x for _, *both in cut for x in both if x not in parts}:
            part.append(u)
            size += len(u) + 1
            if size >= CHUNK:
                self._learn(part)
                part, size = [], 0
        if part:
            self._learn(part)
        for u, core, tail in cut:
            known[u] = parts[core] + parts[tail] if tail else parts[core]
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, units)), self.dtype) for units in split]

    def decode(self, ids: np.ndarray) -> str:
        get = self.bytes_of.__getitem__
        text = b"".join(map(get, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_MATCHERS: dict[str, PieceMatcher] = {}


def matcher(path: str) -> PieceMatcher:
    """One per Python worker, kept between tasks."""
    if path not in _MATCHERS:
        _MATCHERS[path] = PieceMatcher(path)
    return _MATCHERS[path]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("t"))


def _over(batches, model_path: str):
    """Batches of bounded text, so one Arrow batch of long texts does not pile up."""
    m = matcher(model_path)
    for batch in batches:
        for lo in range(0, len(batch), 1024):
            part = batch.iloc[lo : lo + 1024]
            texts = part["t"].tolist()
            yield m, part["doc_id"].astype("Int64"), texts, m.encode(texts)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids`` of every text."""

    def run(batches):
        for _, doc_id, _, ids in _over(batches, model_path):
            yield pd.DataFrame({"doc_id": doc_id.to_numpy(), "ids": [x.astype(np.int32) for x in ids]})

    return _texts(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` of encoded documents."""

    def run(batches):
        m = matcher(model_path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").to_numpy(), "text": [m.decode(np.asarray([] if x is None else x, np.int64)) for x in batch["ids"]]})

    return coded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def piece_report(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document ``n_tokens``, the crc32 of its ids as little-endian u32, and whether decoding gives the text back."""

    def run(batches):
        for m, doc_id, texts, ids in _over(batches, model_path):
            yield pd.DataFrame({
                "doc_id": doc_id.to_numpy(),
                "n_tokens": [len(x) for x in ids],
                "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
                "round_trip": [m.decode(x) == t for x, t in zip(ids, texts)],
            })

    return _texts(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
