"""Exact repeats of long word windows across documents, by super-k-mer partitioning.

The minimiser of a window of k words is the smallest hash among its m-word pieces.  Consecutive windows with one minimiser
travel as one packed string (a super-k-mer) to the bucket that the minimiser names; equal windows have equal minimisers, so
they meet there, where sorting finds every window's smallest document.  Each task first folds equal strings of its own: only
the smallest document's copy travels, the others are repeats already, so a passage that a third of all documents share is sent
once by each task.  Buckets grow in number with the text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named as column
from .wordhash import CHUNK, Known, Words, chunks, groups, long_windows, mix, pieces, slices, texts_of, windows

#: Bytes of packed strings that a task gathers before it sends them, and that a bucket should hold.
GATHER, BUCKET = 24 << 20, 16 << 20
#: Bytes of text that one task joins to what is to be removed.
JOINED = 64 << 20
#: Pieces that a task counts together, how often one must stand among them to be reported, and in all to be frequent (or once in
#: 2**20 words, if that is more: the list of the frequent never has more than 2**20 entries).
COUNTED, OFTEN, FREQUENT = 1 << 22, 8, 4096
_OUT = ["bucket", "strings", "doc", "version", "lo", "hi"]
_RANGES = ["doc", "version", "lo", "hi"]
_OUT_TYPE = "bucket int, strings binary, doc long, version long, lo int, hi int"


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for every i with a full range."""
    if len(x) < width:
        return x[:0]
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :])


def super_kmers(w: Words, k: int, m: int, frequent: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window, last window (as word numbers) and minimiser of each run of windows with one minimiser."""
    of = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    piece = windows(w.hash, m)
    order = (piece >> np.uint64(1)) | (frequent.has(piece).astype(np.uint64) << np.uint64(63))
    low = sliding_minimum(order, k - m + 1)
    ok = np.flatnonzero(of[: len(low)] == of[k - 1 :]) if len(low) else np.zeros(0, np.int64)
    if not len(ok):
        return ok, ok, ok, low[ok]
    new = np.concatenate([[True], (np.diff(ok) != 1) | (low[ok[1:]] != low[ok[:-1]]) | (of[ok[1:]] != of[ok[:-1]])])
    at = np.flatnonzero(new)
    first, last = ok[at], ok[np.concatenate([at[1:], [len(ok)]]) - 1]
    return of[first], first, last, low[first]


def _cut_up(batch: pa.RecordBatch, k: int) -> Iterator[tuple[list[int], list[int], Words]]:
    """The words of a batch's texts, about CHUNK bytes at a time: row of the batch and number of the first word of each text;
    longer texts come in pieces that share k - 1 words."""
    for start, stop, own in groups(texts_of(batch, 1)):
        if len(own[0]) > CHUNK:
            for p, first in pieces(own[0], k - 1):
                yield [start], [first], Words([p], fold=False)
        else:
            yield list(range(start, stop)), [0] * len(own), Words(own, fold=False)


def _count(k: int, m: int):
    """(piece, n) of pieces of m words that stand OFTEN times or more among COUNTED ones of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            x = np.concatenate(held)
            held.clear()
            x.sort()
            lead = x[: max(len(x) - OFTEN + 1, 0)]
            value = np.unique(lead[lead == x[OFTEN - 1 :]])
            n = np.searchsorted(x, value, "right") - np.searchsorted(x, value, "left")
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["piece", "n"])

        for batch in slices(batches):
            for _, _, w in _cut_up(batch, k):
                n = np.diff(w.first)
                of = np.repeat(np.arange(len(n)), n)
                piece = windows(w.hash, m)
                held.append(piece[(of[: len(piece)] == of[m - 1 :][: len(piece)]) & (n[of[: len(piece)]] >= k)] if len(piece) else piece)
                size += len(held[-1])
                if size >= COUNTED:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _send(k: int, m: int, buckets: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, known = zstandard.ZstdCompressor(level=6), Known(frequent.value)
        held: dict[bytes, list] = {}  # string -> [smallest document, its version and places, minimiser]
        size = 0
        repeats: list[tuple[int, int, int, int]] = []

        def flush():
            nonlocal held, size, repeats
            if repeats:
                doc, version, lo, hi = (np.array(c) for c in zip(*repeats, strict=True))
                n = len(doc)
                yield pa.RecordBatch.from_arrays([pa.array((mix(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)), pa.nulls(n, pa.binary()), pa.array(doc), pa.array(version), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], _OUT)
            if held:
                strings = sorted(held)  # like strings side by side take less room
                of = (mix(np.array([held[s][2] for s in strings], dtype=np.uint64)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(of, kind="stable")
                at = np.flatnonzero(np.concatenate([[True], np.diff(of[order]) != 0]))
                for part in np.split(order, at[1:]):
                    own = [strings[j] for j in part]
                    place = np.array([(j, held[s][0], v, p) for j, s in enumerate(own) for v, p in held[s][1]], dtype=np.int64)
                    head = np.array([len(own), len(place)], dtype=np.int64).tobytes() + np.array([len(s) for s in own], dtype=np.int64).tobytes() + place.tobytes()
                    blob = pack.compress(head + b"".join(own))
                    yield pa.RecordBatch.from_arrays([pa.array([int(of[part[0]])], pa.int32()), pa.array([blob]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32())], _OUT)
            held, size, repeats = {}, 0, []

        for batch in slices(batches):
            ids, versions = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for rows, shift, w in _cut_up(batch, k):
                text, first, last, low = super_kmers(w, k, m, known)
                packed, begin, end = w.packed()
                own_version, own_shift = [versions[r] for r in rows], np.array(shift, dtype=np.int64)
                p_all, q_all = first - w.first[text] + own_shift[text], last - w.first[text] + own_shift[text]
                for t, p, q, a, b, x in zip(text.tolist(), p_all.tolist(), q_all.tolist(), begin[first].tolist(), end[last + k - 1].tolist(), low.tolist(), strict=True):
                    s, doc = packed[a:b], ids[rows[t]]
                    have = held.get(s)
                    if have is None:
                        held[s] = [doc, [(own_version[t], p)], x]
                        size += b - a + 150
                    elif doc == have[0]:
                        have[1].append((own_version[t], p))
                    elif doc > have[0]:
                        repeats.append((doc, own_version[t], p, q + k))
                    else:
                        repeats += [(have[0], v, r, r + q - p + k) for v, r in have[1]]
                        have[0], have[1] = doc, [(own_version[t], p)]
                if size > GATHER or len(repeats) > 500_000:
                    yield from flush()
        yield from flush()

    return run


def _settle(k: int):
    """Word ranges of the windows that start in a smaller document too; local repeats pass through.

    Equal windows stand in one bucket, so a task, which may have several, keeps them packed and settles one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[int, list[bytes]] = {}
        for b in batches:
            blobs = b.column(1)
            if blobs.null_count:
                yield pa.RecordBatch.from_arrays([b.column(c) for c in range(2, 6)], _RANGES).filter(blobs.is_null())
            own = b.filter(blobs.is_valid())
            for bucket, blob in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True):
                packed.setdefault(bucket, []).append(blob)
        for bucket in list(packed):
            yield from _settled(packed.pop(bucket), k)

    return run


def _settled(blobs: list[bytes], k: int) -> Iterator[pa.RecordBatch]:
    """What _settle() finds in one bucket."""
    unpack = zstandard.ZstdDecompressor()
    strings: list[bytes] = []
    places = []
    for blob in blobs:
        raw = unpack.decompress(blob)
        n, p = np.frombuffer(raw, dtype=np.int64, count=2)
        length = np.frombuffer(raw, dtype=np.int64, count=n, offset=16)
        place = np.frombuffer(raw, dtype=np.int64, count=4 * p, offset=16 + 8 * n).reshape(-1, 4).copy()
        place[:, 0] += len(strings)
        places.append(place)
        at = 16 + 8 * n + 32 * p
        for e in (at + np.cumsum(length)).tolist():
            strings.append(raw[at:e])
            at = e
    place = np.concatenate(places)
    doc = np.zeros(len(strings), dtype=np.int64)
    doc[place[:, 0]] = place[:, 1]
    value, string, offset, begin, end = [], [], [], [], []
    for own, w in chunks(list(range(len(strings))), strings, fold=False):
        n = np.diff(w.first) - k + 1
        of = np.repeat(np.arange(len(own)), n)
        shift = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        first = w.first[of] + shift
        value.append(long_windows(w, k)[first])
        string.append(of + own[0])
        offset.append(shift)
        text_at = w.start[w.first[of]]
        begin.append(w.start[first] - text_at)
        end.append(w.end[first + k - 1] - text_at)
    value, string, offset, begin, end = (np.concatenate(x) for x in (value, string, offset, begin, end))
    _, value = np.unique(value, return_inverse=True)
    while True:
        order = np.lexsort((doc[string], value))
        new = np.concatenate([[True], value[order][1:] != value[order][:-1]])
        group = np.cumsum(new) - 1
        head = order[np.flatnonzero(new)][group]  # a window of the group's smallest document
        other = np.empty(len(order), dtype=np.int64)
        other[order] = head
        hit = np.flatnonzero(doc[string] > doc[string[other]])  # in order of string and offset
        if not len(hit):
            return
        o = other[hit]
        new = np.concatenate([[True], (np.diff(string[hit]) != 0) | (np.diff(offset[hit]) != 1) | (np.diff(string[o]) != 0) | (np.diff(offset[o]) != 1)])
        at = np.flatnonzero(new)
        first, last = hit[at], hit[np.concatenate([at[1:], [len(hit)]]) - 1]
        same = [strings[s][a:b] == strings[t][c:d] for s, a, b, t, c, d in zip(string[first].tolist(), begin[first].tolist(), end[last].tolist(), string[other[first]].tolist(), begin[other[first]].tolist(), end[other[last]].tolist(), strict=True)]
        if all(same):
            break
        # windows of one hash that differ: their groups are told apart by the text itself
        mixed = np.zeros(int(value.max()) + 1, dtype=bool)
        for x, y in zip(first[~np.array(same)].tolist(), last[~np.array(same)].tolist(), strict=True):
            mixed[value[x : y + 1]] = True
        number: dict[bytes, int] = {}
        for x in np.flatnonzero(mixed[value]).tolist():
            value[x] = len(mixed) + number.setdefault(strings[string[x]][begin[x] : end[x]], len(number))
    rank = np.argsort(place[:, 0], kind="stable")
    place = place[rank]
    lo, n = np.searchsorted(place[:, 0], string[first]), None
    n = np.searchsorted(place[:, 0], string[first], "right") - lo
    row = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    start, stop = np.repeat(offset[first], n) + place[row, 3], np.repeat(offset[last] + k, n) + place[row, 3]
    yield pa.RecordBatch.from_arrays([pa.array(place[row, 1]), pa.array(place[row, 2]), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], _RANGES)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out: list[list] = [[], [], [], []]
        for doc, text, ranges in zip(b.column(0).to_pylist(), texts_of(b, 1), b.column(2).to_pylist(), strict=True):
            n, parts = 0, []
            ranges = sorted((r["lo"], r["hi"]) for r in ranges or [])
            gone = at = 0
            for lo, hi in ranges:
                gone, at = gone + max(hi - max(lo, at), 0), max(at, hi)
            for piece, _ in pieces(text or b"", 0):
                words = piece.split()
                if ranges:
                    kept, at = [], 0
                    for lo, hi in ranges:
                        kept += words[at : max(lo - n, at)]
                        at = max(at, hi - n)
                    parts += kept + words[at:]
                else:
                    parts += words
                n += len(words)
            for c, v in zip(out, (doc, n, gone, b" ".join(parts)), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _cut(batches):
        digest = pa.array([hashlib.sha256(x).hexdigest() for x in texts_of(b, 3)])
        yield pa.RecordBatch.from_arrays([*b.columns[:3], digest], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 50, m: int = 10) -> DataFrame:
    """Word ranges (doc, version, lo, hi; hi excluded) covered by windows of k words that also start in a smaller document.

    version is the 64-bit hash of the text, which tells rows with one doc_id apart.
    """
    return _repeats(docs, id_col, text_col, k, m, docs.agg(F.coalesce(F.sum(F.octet_length(column(text_col).cast("string"))), F.lit(0))).first()[0])


def _repeats(docs: DataFrame, id_col: str, text_col: str, k: int, m: int, volume: int) -> DataFrame:
    named = _versions(docs, id_col, text_col).filter("doc is not null")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = max(parts, math.ceil(3.3 * volume / BUCKET))
    least = max(FREQUENT, volume >> 22)  # words are four bytes or more, mostly
    counted = named.select("doc", "text").mapInArrow(_count(k, m), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    often = [r["piece"] for r in counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "piece").limit(1 << 20).select("piece").collect()]
    frequent = docs.sparkSession.sparkContext.broadcast(np.array(often, dtype=np.int64).view(np.uint64))
    sent = named.mapInArrow(_send(k, m, 2 * places, frequent), _OUT_TYPE)
    return sent.repartition(places, "bucket").mapInArrow(_settle(k), "doc long, version long, lo int, hi int")


def _versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = column(text_col).cast("string")
    return docs.select(column(id_col).cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("version"))


def _with_ranges(docs: DataFrame, id_col: str, text_col: str, k: int, m: int) -> DataFrame:
    volume = docs.agg(F.coalesce(F.sum(F.octet_length(column(text_col).cast("string"))), F.lit(0))).first()[0]
    places = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(volume / JOINED))
    found = _repeats(docs, id_col, text_col, k, m, volume).repartition(places, "doc", "version")
    ranges = found.groupBy("doc", "version").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    text = _versions(docs, id_col, text_col).repartition(places, "doc", "version")
    return text.join(ranges, ["doc", "version"], "left").select("doc", "text", "ranges")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 50, m: int = 10) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space).

    Words are cut at white space and compared unchanged.  A word goes if a window of k words that covers it also starts in a
    document with a smaller doc_id; windows are those of the input.  A null text has no words; texts under k words stay whole.
    Rows with one doc_id never make each other's windows repeats, and rows that repeat one another come back as often as they
    are given.  A row with a null doc_id is kept whole and repeats nothing.  An empty table gives no rows.
    """
    return _with_ranges(docs, id_col, text_col, k, m).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 50, m: int = 10) -> DataFrame:
    """As dedup, with the SHA-256 of the kept words instead of themselves."""
    return _with_ranges(docs, id_col, text_col, k, m).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
