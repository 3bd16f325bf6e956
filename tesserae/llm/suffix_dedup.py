"""Exact removal of repeated byte strings with a column-wise multi-document suffix construction.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller id. Where a 50-byte window's least 20-byte hash (its anchor) lies depends on the window's own
bytes only, so equal windows have equal anchors, and the windows of a text fall into runs with one
anchor. Only runs whose anchor occurs in two documents can matter; the pieces of text under them go to
one bucket per anchor. There the Burrows-Wheeler transform of the collection of pieces is built column
by column: each round inserts one more symbol of every piece, from its end, and updates the transform
and the common prefixes of neighbouring suffixes, reading both from end to end and writing them
anew. Equal pieces of a bucket are one. Suffixes whose common prefix reaches the length are equal windows; the smallest document among
them goes back to the blocks of documents, which mark and cut. Of pieces that differ, only the stretches enter whose
windows have a hash that occurs elsewhere in their bucket; hashes leave windows out, they never join two.

A block sends an anchor once and a piece once, however often it holds them, so what a common passage
sends grows with the number of blocks, not with its copies. Within a bucket 31 bits tell anchors apart,
as a bucket holds about as many anchors as a block; two anchors with one name are handled as one. A block
sends its pieces in the order of their anchors and bytes, so the answers need no names. The anchors and
pieces are candidate search only; whether two windows are equal is decided on their bytes.

Defined cases: null and empty texts have no bytes and lose none; texts shorter than ``LENGTH`` lose
none; of repeated rows with one id none is smaller, so they keep their text; an empty table gives an
empty result; further columns are ignored; long texts are handled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.blocks import flat, groups, mix, powers, prefix_sums, ranges, slice_hashes
from tesserae.llm.session import bucket_count

LENGTH, ANCHOR = 50, 20
#: Rows that one document block, and pieces that one construction, hold.
BLOCK_ROWS, PIECES = 512, 1 << 16
#: Blocks send a row to nearly every bucket; beyond so many blocks they grow instead, up to so many rows or bytes of text.
MANY, LARGE_ROWS, LARGE_BYTES = 512, 4096, 16 << 20


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield at, to
        at = to


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, first window, number of windows) of the runs of windows with one anchor, in text order."""
    found = []
    for i, j in slices(offsets):
        base, part, at = offsets[i], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = len(part) - LENGTH + 1
        if n < 1:
            continue
        sums = prefix_sums(part)
        _, down = powers(len(part))
        low = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: len(part) - ANCHOR + 1])
        width, have = LENGTH - ANCHOR + 1, 1
        while have < width:
            more = min(have, width - have)
            low = np.minimum(low[: len(low) - more], low[more:])
            have += more
        row = np.repeat(np.arange(j - i), np.diff(at))
        inside = row[:n] == row[LENGTH - 1 :]
        new = np.ones(n, bool)
        new[1:] = (low[1:] != low[:-1]) | ~inside[:-1] | (row[1:n] != row[: n - 1])
        new &= inside
        edge = np.flatnonzero(new | ~inside)
        length = np.diff(np.append(edge, n))
        keep = inside[edge]
        edge, length = edge[keep], length[keep]
        # Periodic text can keep one anchor for long; such runs are split, which changes no window.
        parts = -(-length // width)
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        edge, length = np.repeat(edge, parts) + nth * width, np.minimum(np.repeat(length, parts) - nth * width, width)
        found.append((low[edge], row[edge] + i, edge + base, length))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def by_bucket(bucket: np.ndarray, buckets_of: str, entries: list[np.ndarray], block: int) -> pa.Table:
    """Rows (bucket, block, blobs...) with the entries of each bucket as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts, ends = groups(bucket)
    out = {buckets_of: pa.array(bucket[starts].astype(np.int32), pa.int32()), "block": pa.array(np.full(len(starts), block), pa.int32())}
    for k, e in enumerate(entries):
        e = e[order]
        out[f"e{k}"] = pa.array([e[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary())
    return pa.table(out)


class Collection:
    """Transform and common prefixes of a collection of strings, built one symbol of each per round.

    The state is two sequences with an entry for each suffix, the symbol before it and the prefix it shares with the
    suffix before; a round reads both from end to end and writes both anew with one suffix more of each string. They
    are kept in memory: a collection has at most ``PIECES`` strings of under 2 * LENGTH - ANCHOR bytes, and executors
    have no folder of their own to write to.
    """

    def __init__(self, strings: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.strings, self.starts, self.lengths = strings, starts, lengths
        # Symbols are numbered as far as they occur, so that they nearly always fit a byte.
        used = np.flatnonzero(np.bincount(strings[ranges(starts, lengths)], minlength=256))
        self.number = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
        self.number[used] = 1 + np.arange(len(used))

    def build(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(common prefix with the suffix before, string, offset in it) of the suffixes of LENGTH symbols or more, in order.

        Common prefixes are counted up to LENGTH; a string's end is smaller than any byte.
        """
        n = len(self.starts)
        # Round 0: the empty suffixes, in the order of the strings; the symbol before each is the string's last.
        alive = at = np.arange(n)
        transform, prefixes = self.symbol(alive, 0), np.zeros(n, np.uint8)
        for j in range(1, int(self.lengths.max()) + 1 if n else 0):
            alive = alive[self.lengths[alive] >= j]
            by_symbol, rank = self.ranks(transform)
            spot = rank[at[alive]]  # of the new suffix among those that begin with a symbol
            low = self.shared(transform, prefixes, by_symbol, spot)
            after = spot + 1
            has = after < len(by_symbol)
            low_after = self.shared(transform, prefixes, by_symbol, after[has])
            fresh = np.zeros(n + len(by_symbol), bool)
            fresh[n + spot] = True
            old = ~fresh
            grown = np.empty(len(fresh), transform.dtype), np.empty(len(fresh), np.uint8)
            grown[0][old], grown[1][old] = transform, prefixes
            grown[0][n + spot], grown[1][n + spot] = self.symbol(alive, j), low
            grown[1][n + after[has]] = low_after
            transform, prefixes = grown
            at = np.empty_like(at)
            at[alive] = n + spot
        return self.long_suffixes(transform, prefixes)

    @staticmethod
    def ranks(transform: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions by the symbol before them, without those of whole strings, and the place of each position among them."""
        by_symbol = np.argsort(transform, kind="stable")
        by_symbol = by_symbol[len(transform) - int(np.count_nonzero(transform)) :]
        rank = np.zeros(len(transform), np.int64)
        rank[by_symbol] = np.arange(len(by_symbol))
        return by_symbol, rank

    def symbol(self, which: np.ndarray, j: int) -> np.ndarray:
        """The symbol before the suffix of length j, from 1 up; 0 where the suffix is the whole string."""
        at = self.lengths[which] - j - 1
        return np.where(at >= 0, self.number[self.strings[self.starts[which] + np.maximum(at, 0)]], 0).astype(self.number.dtype)

    @staticmethod
    def shared(transform: np.ndarray, prefixes: np.ndarray, by_symbol: np.ndarray, spot: np.ndarray) -> np.ndarray:
        """Common prefix with the suffix before of those at ``spot``: one more than the least prefix between what they extend."""
        here, before = by_symbol[spot], by_symbol[np.maximum(spot - 1, 0)]
        same = np.flatnonzero((spot > 0) & (transform[here] == transform[before]))
        same = same[np.argsort(before[same])]
        out = np.zeros(len(spot), np.uint8)
        if len(same):
            # Every second reduction, over what lies between two spans, is left out.
            span = np.column_stack([before[same] + 1, here[same] + 1]).ravel()
            least = np.minimum.reduceat(np.append(prefixes, np.uint8(0)), span)[::2]
            out[same] = np.minimum(least, LENGTH - 1) + 1
        return out

    def long_suffixes(self, transform: np.ndarray, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Steps back from the end of every string, which is the first suffix, to the suffix that is the string."""
        n = len(self.starts)
        _, rank = self.ranks(transform)
        at, spots, owners, offsets = np.arange(n), [], [], []
        alive = np.arange(n)
        for j in range(1, int(self.lengths.max()) + 1 if n else 0):
            alive = alive[self.lengths[alive] >= j]
            at[alive] = n + rank[at[alive]]
            if j >= LENGTH:
                spots.append(at[alive])
                owners.append(alive)
                offsets.append(self.lengths[alive] - j)
        if not spots:
            none = np.zeros(0, np.int64)
            return none, none, none
        spot = np.concatenate(spots)
        order = np.argsort(spot)
        spot = spot[order]
        # Shorter suffixes may stand between two long ones; what these share is the least on the way.
        edges = np.append(0, spot[:-1] + 1)
        return np.minimum.reduceat(prefixes[: spot[-1] + 1], edges), np.concatenate(owners)[order], np.concatenate(offsets)[order]


def least_documents(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For every window of every piece, piece by piece, the smallest document that holds an equal window."""
    windows = lengths - LENGTH + 1
    begin = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), np.int64)
    prefixes, owner, offset = Collection(text, starts, lengths).build()
    if len(owner):
        first = np.flatnonzero(prefixes < LENGTH)
        first = first if len(first) and first[0] == 0 else np.append(0, first)
        least = np.minimum.reduceat(docs[owner], first)
        out[begin[owner] + offset] = np.repeat(least, np.diff(np.append(first, len(owner))))
    return out


def content_order(data: np.ndarray, start: np.ndarray, lengths: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order of distinct pieces by key and bytes, the same wherever their block is read again."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(order) else order
    if len(tied):
        which = order[tied]
        n, width = lengths[which], -(-(2 * LENGTH - ANCHOR) // 8) * 8
        padded = np.zeros(len(which) * width, np.uint8)
        padded[ranges(np.arange(len(which)) * width, n)] = data[ranges(start[which], n)]
        words = padded.view(">u8").astype(np.uint64).reshape(len(which), -1)
        order[tied] = which[np.lexsort((n, *words.T[::-1], key[which]))]
    return order


def distinct_pieces(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first piece of each distinct content, the distinct number of every piece)."""
    lengths = (count + LENGTH - 1).astype(np.int64)
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data[ranges(start, lengths)])]).dictionary_encode()
    code = column.indices.to_numpy()
    first = np.full(len(column.dictionary), -1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return first, code


def shared_windows(data: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first window in it, number of windows) of the runs of windows whose hash occurs at another place of the pieces as well."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(windows + LENGTH - 1, out=at[1:])
    found = []
    for i, j in slices(at):
        n = windows[i:j]
        here = ranges(at[i:j] - at[i], n)
        found.append(slice_hashes(data[ranges(starts[i:j], n + LENGTH - 1)], here, here + LENGTH))
    _, number, count = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    again = count[number.ravel()] > 1
    begin = np.cumsum(windows) - windows
    opens, closes = again.copy(), again.copy()
    opens[1:] &= ~again[:-1]
    closes[:-1] &= ~again[1:]
    opens[begin] = again[begin]
    closes[begin[1:] - 1] = again[begin[1:] - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    piece = np.searchsorted(begin, first, "right") - 1
    return piece, first - begin[piece], last - first + 1


def block_count(docs: DataFrame, text: str, rows: int | None) -> int:
    """Blocks of ``BLOCK_ROWS`` rows, but of more where they would be over ``MANY``: what they exchange has a row for each two of them."""
    rows = docs.count() if rows is None else rows
    blocks = bucket_count(rows, BLOCK_ROWS, 8)
    if blocks <= MANY:
        return blocks
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("binary")))).first()[0] or 0
    return min(blocks, max(MANY, bucket_count(rows, LARGE_ROWS, 1), bucket_count(size, LARGE_BYTES, 1)))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, rows: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 per document; ``with_text`` adds the kept bytes."""
    blocks = block_count(docs, text, rows)
    placed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.pmod(F.xxhash64(doc_id), F.lit(blocks)).cast("int").alias("block"))

    def keys_of(anchor: np.ndarray) -> np.ndarray:
        """The bucket of each anchor and, in the lowest 31 bits, its name there."""
        h = mix(anchor)
        return ((h >> np.uint64(32)) % np.uint64(blocks) << np.uint64(31)) | ((h & np.uint64(0xFFFFFFFF)) >> np.uint64(1))

    def parts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (key >> np.uint64(31)).astype(np.int64), (key & np.uint64(0x7FFFFFFF)).astype(np.uint32)

    def anchors(group: pa.Table) -> pa.Table:
        data, offsets = flat(group["text"])
        anchor, row, _, _ = runs(data, offsets)
        doc = group["doc_id"].to_numpy()[row]
        key = keys_of(anchor)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first, ends = groups(key)
        several = doc[first] != doc[ends - 1]
        bucket, name = parts(key[first])
        # The lowest bit says whether the block itself has the anchor in two documents.
        return by_bucket(bucket, "bucket", [(name << np.uint32(1)) | several.astype(np.uint32)], group["block"][0].as_py())

    def shared(group: pa.Table) -> pa.Table:
        values = [np.frombuffer(x, np.uint32) for x in group["e0"].to_pylist()]
        block = np.repeat(group["block"].to_numpy(), [len(v) for v in values])
        value = np.concatenate(values)
        order = np.argsort(value >> np.uint32(1), kind="stable")
        value, block = value[order], block[order]
        anchor = value >> np.uint32(1)
        first, ends = groups(anchor)
        size = ends - first
        several = (size > 1) | (np.bitwise_or.reduceat(value & np.uint32(1), first) > 0)
        hit = np.repeat(several, size)
        out = by_bucket(block[hit], "to", [anchor[hit]], group["bucket"][0].as_py())
        return out.select(["to", "block", "e0"]).rename_columns(["block", "bucket", "e0"])

    def anchor_set(group: pa.Table) -> np.ndarray:
        """The keys that a block is told, each once."""
        found = [np.frombuffer(x, np.uint32) for x in group["e0"].to_pylist()]
        bucket = np.repeat(group["bucket"].to_numpy().astype(np.uint64), [len(x) for x in found])
        return np.unique((bucket << np.uint64(31)) | np.concatenate(found)) if found else np.zeros(0, np.uint64)

    def pieces(texts: pa.Table, group: pa.Table) -> pa.Table:
        empty = by_bucket(np.zeros(0, np.int64), "bucket", [np.zeros(0, np.uint32)] * 4, 0)
        if not texts.num_rows or not group.num_rows:
            return empty
        data, offsets = flat(texts["text"])
        key, row, start, count = matched(data, offsets, anchor_set(group))
        if not len(start):
            return empty
        first, code = distinct_pieces(data, start, count)
        doc = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(doc, code, texts["doc_id"].to_numpy()[row])
        lengths = (count + LENGTH - 1)[first].astype(np.int64)
        order = content_order(data, start[first], lengths, key[first])
        bucket, name = parts(key[first])
        packed = [data[i : i + n].tobytes() for i, n in zip(start[first][order].tolist(), lengths[order].tolist(), strict=True)]
        bucket = bucket[order]
        edges, ends = groups(bucket)
        column = lambda x: pa.array([x[order][i:j].tobytes() for i, j in zip(edges, ends, strict=True)], pa.binary())
        return pa.table({"bucket": pa.array(bucket[edges].astype(np.int32)), "block": pa.array(np.full(len(edges), texts["block"][0].as_py()), pa.int32()), "e0": column(name), "e1": column(doc), "e2": column(lengths.astype(np.uint8)), "e3": pa.array([b"".join(packed[i:j]) for i, j in zip(edges, ends, strict=True)], pa.binary())})

    def matched(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        anchor, row, start, count = runs(data, offsets)
        key = keys_of(anchor)
        at = np.minimum(np.searchsorted(wanted, key), max(len(wanted) - 1, 0))
        hit = np.flatnonzero(wanted[at] == key) if len(wanted) else np.zeros(0, np.int64)
        return key[hit], row[hit], start[hit], count[hit]

    def least(group: pa.Table) -> pa.Table:
        names = [np.frombuffer(x, np.uint32) for x in group["e0"].to_pylist()]
        anchor = np.concatenate(names)
        doc = np.concatenate([np.frombuffer(x, np.int64) for x in group["e1"].to_pylist()])
        lengths = np.concatenate([np.frombuffer(x, np.uint8) for x in group["e2"].to_pylist()]).astype(np.int64)
        text = np.frombuffer(b"".join(group["e3"].to_pylist()), np.uint8)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(anchor, kind="stable")
        windows = lengths - LENGTH + 1
        begin = np.append(0, np.cumsum(windows))
        low = np.empty(begin[-1], np.int64)
        at, sorted_anchor = 0, anchor[order]
        while at < len(order):
            # Whole anchors only; one with more pieces than a construction holds is split by the windows' bytes.
            to = min(len(order), at + PIECES)
            if to < len(order):
                to = int(np.searchsorted(sorted_anchor, sorted_anchor[to]))
                to = to if to > at else int(np.searchsorted(sorted_anchor, sorted_anchor[at], "right"))
            part = order[at:to]
            low[ranges(begin[part], windows[part])] = least_of(text, starts[part], lengths[part], doc[part], anchor[part])
            at = to
        edges = begin[np.append(0, np.cumsum([len(x) for x in names]))]
        e1 = [low[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
        # The anchors go back with the answers, so that the block knows its pieces again.
        e0 = [np.unique(x).tobytes() for x in names]
        return pa.table({"block": group["block"], "bucket": group["bucket"], "e0": pa.array(e0, pa.binary()), "e1": pa.array(e1, pa.binary())})

    def rivals(anchor: np.ndarray) -> np.ndarray:
        """The pieces whose anchor has several; a single piece shares its windows with no other and needs no construction."""
        _, own, count = np.unique(anchor, return_inverse=True, return_counts=True)
        return np.flatnonzero(count[own] > 1)

    def least_of(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, doc: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if len(starts) <= PIECES:
            # Equal pieces of several blocks are one, with the smallest of their documents.
            first, code = distinct_pieces(text, starts, lengths - LENGTH + 1)
            low = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(low, code, doc)
            windows = (lengths - LENGTH + 1)[first]
            found = np.repeat(low, windows)
            begin, several = np.cumsum(windows) - windows, rivals(anchor[first])
            if len(several):
                # Of these only the runs of windows that may occur elsewhere matter; equal ones are one again.
                which, at, n = shared_windows(text, starts[first][several], windows[several])
                which = several[which]
                if len(which):
                    part, number = distinct_pieces(text, starts[first][which] + at, n)
                    least = np.full(len(part), np.iinfo(np.int64).max)
                    np.minimum.at(least, number, low[which])
                    size = n[part]
                    value, edge, tried = np.repeat(least, size), np.cumsum(size) - size, rivals(anchor[first][which][part])
                    value[ranges(edge[tried], size[tried])] = least_documents(text, (starts[first][which] + at)[part][tried], (size + LENGTH - 1)[tried], least[tried])
                    found[ranges(begin[which] + at, n)] = value[ranges(edge[number], n)]
            return found[ranges(begin[code], windows[code])]
        windows = lengths - LENGTH + 1
        at = ranges(starts, windows)
        owner = np.repeat(doc, windows)
        part = slice_hashes(text, at, at + LENGTH) % np.uint64(-(-len(at) // PIECES) * 2)
        out = np.empty(len(at), np.int64)
        for p in range(int(part.max()) + 1):
            mine = np.flatnonzero(part == p)
            if len(mine):
                first, code = distinct_pieces(text, at[mine], np.ones(len(mine), np.int64))
                low = np.full(len(first), np.iinfo(np.int64).max)
                np.minimum.at(low, code, owner[mine])
                out[mine] = least_documents(text, at[mine][first], np.full(len(first), LENGTH), low)[code]
        return out

    def cut_out(texts: pa.Table, group: pa.Table) -> pa.Table:
        data, offsets = flat(texts["text"])
        ids = texts["doc_id"].to_numpy()
        gone = np.zeros(len(data) + 1, np.int8)
        if group.num_rows and len(data):
            key, row, start, count = matched(data, offsets, anchor_set(group))
            if len(start):
                first, code = distinct_pieces(data, start, count)
                order = content_order(data, start[first], (count + LENGTH - 1)[first].astype(np.int64), key[first])
                low = np.frombuffer(b"".join(group.sort_by("bucket")["e1"].to_pylist()), np.int64)
                windows = count[first][order]
                begin = np.empty(len(order), np.int64)
                begin[order] = np.cumsum(windows) - windows
                spots = ranges(start, count)
                value = low[ranges(begin[code], count)]
                hit = spots[value < np.repeat(ids[row], count)]
                gone[hit] += 1  # a place is the start of one window at most
                gone[hit + LENGTH] -= 1
        removed = np.cumsum(gone, dtype=np.int8)[:-1] > 0
        opens = removed.copy()
        opens[1:] &= ~removed[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        opens[inner] = removed[inner]
        kind = np.int32 if len(data) < 1 << 31 else np.int64
        total, spans = (np.append(kind(0), np.cumsum(x, dtype=kind)) for x in (removed, opens))
        kept = [data[i:j][~removed[i:j]].tobytes() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        out = {"doc_id": ids, "n_bytes": np.diff(offsets), "n_removed": np.diff(total[offsets]).astype(np.int64), "n_spans": np.diff(spans[offsets]).astype(np.int64), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    seen = placed.groupBy("block").applyInArrow(anchors, "bucket int, block int, e0 binary").groupBy("bucket").applyInArrow(shared, "block int, bucket int, e0 binary")
    sent = placed.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(pieces, "bucket int, block int, e0 binary, e1 binary, e2 binary, e3 binary")
    told = sent.groupBy("bucket").applyInArrow(least, "block int, bucket int, e0 binary, e1 binary")
    return placed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))
