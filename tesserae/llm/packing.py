"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing.

Documents are tokenised where they are read. A document longer than a window fills whole windows
first; what is left of it and all shorter documents are cut into parts of at most ``PARTS[0]`` ids and
partitioned, block by block, into as many windows as their ids need at least: partial partitions with
opposing imbalances are merged, largest imbalance first, until one near-equal partition remains. While a
window exceeds the capacity, the number of windows rises. Where sizes are such that it rises by more
than ``ENOUGH`` of the windows, shorter parts are tried as well, and the fewest windows count. A block
ends with as many ids as its windows hold; the document there is cut and goes on in the next block.

Defined cases: a null or empty text is a document of its end id alone; repeated rows are packed each
on its own; ties are broken by position; an empty table gives an empty result; further columns are
ignored. A block holds ``BLOCK`` windows of such parts, or a single very long document and those before it.
"""

from __future__ import annotations

import heapq
import itertools
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tesserae.llm.blocks import flat, ranges, text_blocks, words
from tesserae.llm.slices import Slices

WINDOW, END_ID = 2048, 1
#: Windows of a block; ids of a part, at first and where that leaves too much padding; share of windows that may be added without further tries.
BLOCK, PARTS, ENOUGH = 128, (512, 256, 128, 64), 0.015
#: Share of a block's windows that its ids fill at most, so that they need not be exactly equal.
FILL = 0.993
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words whose ids a worker remembers at most, and bytes of them.
CACHE, CACHE_BYTES = 1 << 19, 1 << 24
#: Words that are encoded as one text.
TOGETHER = 256


def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` near-equal windows by multiway differencing; every index occurs once.

    Merges only note which part of either side goes where; the windows are read off from the last
    merge down to the single sizes.
    """
    n = len(sizes)
    sums: list[np.ndarray] = []
    for x in sizes.tolist():
        alone = np.zeros(k, np.int64)
        alone[-1] = x
        sums.append(alone)
    merges: list[tuple[int, int, np.ndarray]] = []
    heap = [(-x, i) for i, x in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        merged = sums[a] + sums[b][::-1]  # the fullest part of one meets the emptiest of the other
        order = np.argsort(merged, kind="stable")
        merged = merged[order]
        merged -= merged[0]
        heapq.heappush(heap, (-int(merged[-1]), len(sums)))
        merges.append((a, b, order))
        sums[a] = sums[b] = merged[:0]
        sums.append(merged)
    out: list[list[int]] = [[] for _ in range(k)]
    where: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)} if heap else {}
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, order = merges[node - n]
        mine = np.empty(k, np.int64)
        mine[order] = where.pop(node)
        where[a], where[b] = mine, mine[::-1]
    for i, at in where.items():
        out[int(at[-1])].append(i)
    return out


def levelled(sizes: np.ndarray, window: int, most: int | None = None) -> list[list[int]] | None:
    """Indices of ``sizes`` (none above ``window``) in near-equal windows; their number rises until none exceeds the capacity, or gives up above ``most``."""
    k, tries = -(-int(sizes.sum()) // window), 0
    while most is None or k <= most:
        parts = differencing(sizes, k)
        if max(int(sizes[p].sum()) for p in parts if p) <= window:
            return [p for p in parts if p]
        tries += 1
        k += 1 if tries < 8 else max(1, k // 32)
    return None


def pack(sizes: np.ndarray, window: int = WINDOW, parts: tuple[int, ...] = PARTS) -> list[list[tuple[int, int, int]]]:
    """Windows of (index, start, length) pieces; a size above ``window`` fills whole windows first."""
    full = [[(i, s, window)] for i, n in enumerate(sizes.tolist()) for s in range(0, n - window + 1, window)]
    rest = sizes % window
    items = np.flatnonzero(rest)
    if not len(items):
        return full
    least, best = -(-int(rest.sum()) // window), None
    for part in parts:
        count = -(-rest[items] // min(part, window))
        own, nth = np.repeat(items, count), ranges(np.zeros(len(items), np.int64), count)
        each, more = np.repeat(rest[items] // count, count), np.repeat(rest[items] % count, count)
        length = each + (nth < more)
        start = (sizes - rest)[own] + nth * each + np.minimum(nth, more)
        found = levelled(length, window, len(best) - 1 if best is not None else None)
        if found is not None:
            best = [[(int(own[j]), int(start[j]), int(length[j])) for j in w] for w in found]
        if best is not None and len(best) <= least + max(1, int(least * ENOUGH)):
            break
    return full + best


class WordEncoder:
    """Ids of whole texts from ids of their words: the tokenizer's pieces never cross white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known = Slices()
        self.table, self.begin, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), 0

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each).

        Words of ASCII letters are one piece each, which a token that ends a word closes; so many of them are
        encoded as one text and told apart by those tokens. All others are encoded one by one.
        """
        plain = [k for k, w in enumerate(new) if w.isalpha()]
        other = [k for k, w in enumerate(new) if not w.isalpha()]
        joined = self.encoded([b" ".join(new[k] for k in plain[i : i + TOGETHER]).decode() for i in range(0, len(plain), TOGETHER)])
        flat_ids = np.fromiter(itertools.chain.from_iterable(joined), np.int64, sum(map(len, joined)))
        ends = np.flatnonzero(self.closes[flat_ids]) if len(flat_ids) else np.zeros(0, np.int64)
        if len(ends) != len(plain):
            plain, other, flat_ids, ends = [], list(range(len(new))), flat_ids[:0], ends[:0]
        rest = self.encoded([new[k].decode("utf-8", "replace") for k in other])
        sizes = np.zeros(len(new), np.int64)
        sizes[plain], sizes[other] = np.diff(ends, prepend=-1), [len(x) for x in rest]
        begin, ids = np.cumsum(sizes) - sizes, np.empty(int(sizes.sum()), np.uint32)
        ids[ranges(begin[plain], sizes[plain])] = flat_ids
        ids[ranges(begin[other], sizes[other])] = np.fromiter(itertools.chain.from_iterable(rest), np.uint32, sum(map(len, rest)))
        return ids, sizes

    def learn(self, new: list[bytes]) -> None:
        ids, sizes = self.ids_of(new)
        while self.used + len(ids) > len(self.table):
            self.table = np.append(self.table, np.zeros(len(self.table), np.uint32))
        self.table[self.used : self.used + len(ids)] = ids
        self.begin = np.append(self.begin, self.used + np.cumsum(sizes))
        self.used += len(ids)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, offsets of the rows in them) for UTF-8 rows."""
        starts, ends, first = words(data, offsets)
        lengths = ends - starts
        packed = data[ranges(starts, lengths)]
        at = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(lengths, out=at[1:])
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)]).dictionary_encode()
        part, edges = flat(column.dictionary)
        code, h = self.known.find(part, edges[:-1], edges[1:])
        new = np.flatnonzero(code < 0)
        if self.known.count + len(new) > CACHE or self.known.used + int((edges[new + 1] - edges[new]).sum()) > CACHE_BYTES:
            self.forget()
            new = np.arange(len(code))
        if len(new):
            self.learn([x.as_py() for x in column.dictionary.take(pa.array(new))])
            code[new] = self.known.add(part, edges[new], edges[new + 1], h[new])
        code = code[column.indices.to_numpy()]
        sizes = self.begin[code + 1] - self.begin[code]
        return self.table[ranges(self.begin[code], sizes)], np.append(0, np.cumsum(sizes))[first]


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file, kept between tasks."""
    return WordEncoder(path)


def windows(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    ``with_ids`` adds the piece's ids themselves. Sequence numbers are unique, not gapless: the
    partition's number and a running number within it. No shuffle is needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode, sequence = encoder(path), (TaskContext.get().partitionId() << 36)
        held: list[tuple[int, int, np.ndarray, int]] = []  # id, ids before, ids, ids of the whole document
        short = whole = 0  # ids that are left beside full windows, and all ids

        def out() -> pa.RecordBatch:
            nonlocal sequence
            sizes = np.array([len(x[2]) for x in held], np.int64)
            ids = np.concatenate([x[2] for x in held]).astype("<u4")
            raw, begin = memoryview(ids.tobytes()), np.cumsum(sizes) - sizes
            found = pack(sizes, window)
            which, start, length = (np.array([p[c] for w in found for p in w], np.int64) for c in range(3))
            per = np.array([len(w) for w in found], np.int64)
            before = np.cumsum(length) - length
            first = np.cumsum(per) - per
            at = ((begin[which] + start) * 4).tolist()
            blobs = [raw[i : i + 4 * n] for i, n in zip(at, length.tolist(), strict=True)]
            names, base, total = (np.array([x[c] for x in held], np.int64) for c in (0, 1, 3))
            crc = np.array([zlib.crc32(x) for x in blobs], np.int64)
            columns = [names[which], base[which] + start, length, crc, total[which], sequence + np.repeat(np.arange(len(per)), per), before - np.repeat(before[first], per)]
            sequence += len(found)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns] + ([pa.array([bytes(x) for x in blobs], pa.binary())] if with_ids else []), [x.split()[0] for x in SCHEMA.split(", ")] + (["ids"] if with_ids else []))

        for batch in batches:
            for names, data, offsets in text_blocks(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)):
                ids, at = encode(data, offsets)
                for name, i, j in zip(names.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own, total = np.append(ids[i:j], np.uint32(end_id)), j - i + 1
                    over = short + total % window - int(BLOCK * window * FILL)
                    if over < 0:
                        held.append((name, 0, own, total))
                        short, whole = short + total % window, whole + total
                        if whole >= 4 * BLOCK * window:
                            yield out()
                            short = whole = 0
                        continue
                    held.append((name, 0, own[: total - over], total))
                    yield out()
                    short = whole = over
                    if over:
                        held.append((name, total - over, own[total - over :], total))
        if held:
            yield out()

    return docs.select(doc_id, text).mapInArrow(run, SCHEMA + (", ids binary" if with_ids else ""))
