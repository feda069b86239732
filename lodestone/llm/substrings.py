"""Exact removal of repeated 100-byte strings: suffixes of a difference cover are ranked first, and only tied ones are sorted with their text, one suffix bucket at a time.

The cover samples 6 of 31 positions of a document. Any two positions have one
distance below 31 at which both are sampled, so two equal 100-byte strings hold
two sampled suffixes that agree in 70 bytes. The first pass ranks the sampled
suffixes by those 70 bytes and sends nothing but the ranks; suffixes without a
tie settle there. The second pass sends the text around each tie to the bucket
of its rank, where the windows on it are sorted and compared byte by byte.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small
from .near_duplicates import _BASE, _INVERSE, mix, powers

LENGTH = 100
#: A perfect difference set: every number below PERIOD is one difference of two members, modulo PERIOD.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes by which sampled suffixes are ranked: what is left of a window after the largest distance.
DEPTH = LENGTH - PERIOD + 1
#: Bytes of text in one block, in one suffix bucket of the ranking, and sorted at once.
BLOCK_BYTES, BUCKET_BYTES, SORT_BYTES = 2 << 20, 32 << 20, 4 << 20
#: Blocks that share a rank from which on its windows are dealt in parts of QUARTER by what follows.
HOT_BLOCKS, QUARTER = 64, 8
#: Most rows of a table of copies that is broadcast; beyond it, the join shuffles.
BROADCAST_ROWS = 100_000
_NONE = -(1 << 62)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_FAR = 128


@lru_cache(2)
def _powers(base: np.uint64, n: int) -> np.ndarray:
    return powers(base, n)


def hashes(data: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """64-bit hashes of data[start : start + length], start being in ascending order; a chunk of the text at a time."""
    out = np.zeros(len(start), np.uint64)
    length = np.broadcast_to(length, start.shape)
    for a in range(0, len(data), BLOCK_BYTES):
        i, j = np.searchsorted(start, (a, a + BLOCK_BYTES))
        if i < j:
            piece = data[a : a + BLOCK_BYTES + LENGTH]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, BLOCK_BYTES + LENGTH)[: len(piece)], dtype=np.uint64)])
            at = start[i:j] - a
            out[i:j] = mix((sums[at + length[i:j]] - sums[at]) * _powers(_INVERSE, BLOCK_BYTES + LENGTH)[at])
    return out


def bucket_of(key: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """The range of the rank order, out of ``buckets``, that a key of so many bits lies in."""
    return (((key >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _pack(block_bytes: int):
    """Documents in compressed blocks of about ``block_bytes``; a longer document is a block of its own."""

    def block(number: int, ids: list[int], texts: list[bytes]):
        head = np.array([len(ids), *ids, *map(len, texts)], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([zstandard.compress(head.tobytes() + b"".join(texts), 3)], pa.binary())], ["block", "body"])

    def run(batches):
        number, size = TaskContext.get().partitionId() << 32, 0
        ids: list[int] = []
        texts: list[bytes] = []
        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes()
                if ids and size + len(raw) > block_bytes:
                    yield block(number, ids, texts)
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(d)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield block(number, ids, texts)

    return run


def _open(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, bytes) of a block."""
    raw = zstandard.decompress(body)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    return head[:n], np.concatenate([[0], np.cumsum(head[n:])]), np.frombuffer(raw, np.uint8, offset=8 + 16 * n)


def samples(ids: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, row, hash of DEPTH bytes) of the cover's suffixes; each document has its own phase, so that a pair of copies shares one sample a period."""
    phase = (mix(ids.astype(np.uint64)) % np.uint64(PERIOD)).astype(np.int64)
    places, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(data), BLOCK_BYTES):
        b = min(a + BLOCK_BYTES, len(data))
        row = np.repeat(np.arange(len(ids)), np.diff(np.clip(offsets, a, b)))
        at = np.arange(a, b)
        keep = _IN_COVER[(at - offsets[row] + phase[row]) % PERIOD] & (at + DEPTH <= offsets[row + 1])
        places.append(at[keep])
        rows.append(row[keep])
    at = np.concatenate(places)
    return at, np.concatenate(rows), hashes(data, at, DEPTH)


def _ranked(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> np.uint64(64 - bits)


def _keys(buckets: int, bits: int):
    """(bucket, block, keys): each block's distinct keys in order, as differences in planes of bytes."""

    def run(batches):
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = np.unique(_ranked(samples(*_open(body))[2], bits))
                bucket = bucket_of(key, bits, buckets)
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(key) else np.zeros(1, int)
                blobs = [zstandard.compress(np.diff(key[a:b], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(blobs), block)), pa.array(blobs, pa.binary())], ["bucket", "block", "keys"])

    return run


def _ties(hot: int):
    """Ranks of one bucket: for each block, which of its keys are tied with another block's (1), and which are those of ``hot`` blocks or more (2)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.cumsum(np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64) for b in rows["keys"]]
        key = np.concatenate(parts)
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0, [True]]))
        size = np.diff(new)
        code = np.empty(len(key), np.uint8)
        code[order] = np.repeat((size > 1).astype(np.uint8) + (size >= hot), size)
        ends = np.cumsum([len(p) for p in parts])
        mine = [code[b - len(p) : b] for p, b in zip(parts, ends, strict=True)]
        some = np.array([c.any() for c in mine], bool)
        return pd.DataFrame({"block": rows["block"].to_numpy()[some], "bucket": rows["bucket"].to_numpy()[some], "codes": [zstandard.compress(c.tobytes(), 3) for c, s in zip(mine, some, strict=True) if s]})

    return run


def _spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, step) of the elements of runs of these lengths."""
    which = np.repeat(np.arange(len(lengths)), lengths)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run starts in rows of (equal, ..., rising by one) columns: the first column must stay, the others must rise by one."""
    same, *rising = columns
    return np.concatenate([[True], (np.diff(same) != 0) | np.any([np.diff(c) != 1 for c in rising], axis=0)]) if len(same) else np.zeros(0, bool)


def later(owner: np.ndarray, doc: np.ndarray, place: np.ndarray, start: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which windows have an equal one with a smaller (doc, place). ``start`` ascends in data; windows of one owner follow each other."""
    value = hashes(data, start, LENGTH)
    order = np.argsort(value, kind="stable")
    new = np.concatenate([[True], np.diff(value[order]) != 0]) if len(order) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    lead = order[head][group]
    least_doc = np.minimum.reduceat(doc[order], head)[group] if len(head) else doc
    own = np.where(doc == least_doc, place, np.iinfo(np.int64).max)
    least = np.minimum.reduceat(own[order], head)[group] if len(head) else place
    repeat = (doc != least_doc) | (place != least)
    # equal hashes are confirmed on the bytes, a run of windows at a time
    other = np.flatnonzero(lead != np.arange(len(lead)))
    if len(other):
        begin = np.flatnonzero(_runs(owner[other], start[other], start[lead[other]]))
        count = np.diff(np.append(begin, len(other)))
        for a in range(0, len(begin), 4096):
            which, step = _spread(count[a : a + 4096] + LENGTH - 1)
            first = other[begin[a : a + 4096]]
            if (data[start[first][which] + step] != data[start[lead[first]][which] + step]).any():
                return _later_by_bytes(doc, place, start, data)
    return repeat


def _later_by_bytes(doc: np.ndarray, place: np.ndarray, start: np.ndarray, data: np.ndarray) -> np.ndarray:
    """later() without hashes, for the case that two different windows hash alike."""
    least: dict[bytes, tuple[int, int]] = {}
    windows = [data[s : s + LENGTH].tobytes() for s in start]
    keys = list(zip(doc.tolist(), place.tolist(), strict=True))
    for w, k in zip(windows, keys, strict=True):
        least[w] = min(least.get(w, k), k)
    return np.array([least[w] != k for w, k in zip(windows, keys, strict=True)], bool)


def _spans(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first, start, stop) of the byte ranges of windows in order."""
    begin = np.flatnonzero(_runs(owner, place))
    last = np.append(begin[1:], len(owner)) - 1
    return begin, place[begin], place[last] + LENGTH


def _contexts(buckets: int, bits: int, key_buckets: int):
    """The text around tied suffixes by bucket of their rank, and repeats found within the block as rows without text.

    Windows that the block itself shows to be repeats are not sent, so that a
    passage of a third of all documents costs each block one copy.
    """

    def run(batches):
        for batch in batches:
            for block, body, ties in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids, offsets, data = _open(body)
                at, row, h = samples(ids, offsets, data)
                key, which, count = np.unique(_ranked(h, bits), return_inverse=True, return_counts=True)
                code = np.zeros(len(key), np.uint8)
                begin = np.searchsorted(bucket_of(key, bits, key_buckets), [t["bucket"] for t in ties or ()])
                for a, t in zip(begin, ties or (), strict=True):
                    got = np.frombuffer(zstandard.decompress(t["codes"]), np.uint8)
                    code[a : a + len(got)] = got
                low, high = np.maximum(at - PERIOD + 1, offsets[row]), np.minimum(at, offsets[row + 1] - LENGTH)
                pick = np.flatnonzero(((code > 0) | (count > 1))[which] & (low <= high))
                at, row, h, low, high, code = at[pick], row[pick], h[pick], low[pick], high[pick], code[which[pick]]
                n = len(data) + 1
                window = np.flatnonzero(np.cumsum(np.bincount(low, minlength=n) - np.bincount(high + 1, minlength=n)) > 0)
                owner = np.searchsorted(offsets, window, "right") - 1
                place = window - offsets[owner]
                repeat = later(owner, ids[owner], place, window, data)
                if repeat.any():
                    of = owner[repeat]
                    first, start, stop = _spans(of, place[repeat])
                    dealt = np.full(len(first), block % buckets, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(dealt), pa.array(np.full(len(first), block)), pa.nulls(len(first), pa.binary()), pa.array(of[first].astype(np.int32)), pa.array(start), pa.array(stop)], ["bucket", "block", "blob", "row", "start", "stop"])
                far = code > 1
                anchor, deep = [at[code == 1]], [np.zeros((code == 1).sum(), bool)]
                rows, lows, highs = [row[code == 1]], [low[code == 1]], [high[code == 1]]
                for back in range(0, PERIOD, QUARTER):
                    anchor.append(at[far] - back)
                    deep.append(np.ones(far.sum(), bool))
                    rows.append(row[far])
                    lows.append(np.maximum(low[far], at[far] - back - QUARTER + 1))
                    highs.append(np.minimum(high[far], at[far] - back))
                anchor, deep, row, low, high = (np.concatenate(x) for x in (anchor, deep, rows, lows, highs))
                left = window[~repeat]
                i, j = np.searchsorted(left, low), np.searchsorted(left, high, "right") - 1
                keep = i <= j
                anchor, deep, row, low, high = anchor[keep], deep[keep], row[keep], left[i[keep]], left[j[keep]]
                order = np.argsort(anchor, kind="stable")
                anchor, deep, row, low, high = anchor[order], deep[order], row[order], low[order], high[order]
                bucket = bucket_of(hashes(data, anchor, np.where(deep, LENGTH - QUARTER + 1, DEPTH)), 64, buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, offset = bucket[order], (anchor - low + _FAR * deep)[order].astype(np.uint8)
                row, low, high = row[order], low[order], high[order]
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, int)
                blobs = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    of, step = _spread(high[a:b] - low[a:b] + LENGTH)
                    parts = (ids[row[a:b]], low[a:b] - offsets[row[a:b]], row[a:b].astype(np.int32), (high[a:b] - low[a:b] + 1).astype(np.uint8), offset[a:b], data[low[a:b][of] + step])
                    blobs.append(zstandard.compress(np.int64(b - a).tobytes() + b"".join(p.tobytes() for p in parts), 3))
                none = np.zeros(len(blobs), np.int64)  # not null, as pandas would turn all numbers into floats
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(blobs), block)), pa.array(blobs, pa.binary()), pa.array(none.astype(np.int32)), pa.array(none), pa.array(none)], ["bucket", "block", "blob", "row", "start", "stop"])

    return run


def _unpack(blob: bytes) -> list[np.ndarray]:
    """[doc, place, row, windows, offset, bytes] of a blob."""
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8, []
    for kind in (np.int64, np.int64, np.int32, np.uint8, np.uint8):
        out.append(np.frombuffer(raw, kind, n, at).astype(np.int64))
        at += n * np.dtype(kind).itemsize
    return [*out, np.frombuffer(raw, np.uint8, offset=at)]


def _sort_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Repeats of one suffix bucket, and those that the blocks found: tied suffixes are taken rank by rank, about SORT_BYTES of text at a time."""
    known = rows["blob"].isna()
    found = [rows.loc[known, ["block", "row", "start", "stop"]]]
    sent = rows.loc[~known]
    if not len(sent):
        return found[0]
    parts = [_unpack(b) for b in sent["blob"]]
    doc, place, row, windows, offset = (np.concatenate([p[i] for p in parts]) for i in range(5))
    block = np.repeat(sent["block"].to_numpy(), [len(p[0]) for p in parts])
    data = np.concatenate([p[5] for p in parts])
    del parts
    length = windows + LENGTH - 1
    first = np.cumsum(length) - length
    rank = hashes(data, first + offset % _FAR, np.where(offset >= _FAR, LENGTH - QUARTER + 1, DEPTH))
    order = np.argsort(rank, kind="stable")
    new = np.concatenate([[True], np.diff(rank[order]) != 0])
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    order, group = order[sizes[group] > 1], group[sizes[group] > 1]
    size = np.cumsum(length[order])
    turn = size // SORT_BYTES
    begin = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0])) if len(order) else np.zeros(0, int)
    begin = begin[np.concatenate([[True], np.diff(turn[begin]) != 0])] if len(begin) else begin
    for a, b in zip(begin, np.append(begin, len(order))[1:], strict=True):
        mine = order[a:b]
        mine = mine[np.lexsort((place[mine], row[mine], block[mine], doc[mine]))]
        # a window that several suffixes hold is taken once
        owner = np.cumsum(np.concatenate([[0], (np.diff(doc[mine]) != 0) | (np.diff(block[mine]) != 0) | (np.diff(row[mine]) != 0)]))
        base = owner << 40
        end = np.maximum.accumulate(base + place[mine] + windows[mine])
        skip = np.clip(np.concatenate([[0], end[:-1]]) - base - place[mine], 0, windows[mine])
        left = np.flatnonzero(skip < windows[mine])
        mine, owner, skip = mine[left], owner[left], skip[left]
        of, step = _spread(length[mine] - skip)
        text = data[(first[mine] + skip)[of] + step]
        size = length[mine] - skip
        of, step = _spread(windows[mine] - skip)
        spot = (place[mine] + skip)[of] + step
        repeat = np.flatnonzero(later(owner[of], doc[mine][of], spot, (np.cumsum(size) - size)[of] + step, text))
        if len(repeat):
            head, start, stop = _spans(owner[of[repeat]], spot[repeat])
            head = mine[of[repeat[head]]]
            found.append(pd.DataFrame({"block": block[head], "row": row[head].astype(np.int32), "start": start, "stop": stop}))
    return pd.concat(found)


def _remove(with_text: bool):
    def run(batches):
        for batch in batches:
            for body, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, offsets, data = _open(body)
                of: dict[int, list[tuple[int, int]]] = {}
                for s in spans or ():
                    of.setdefault(s["row"], []).append((s["start"], s["stop"]))
                out = []
                for i, d in enumerate(ids.tolist()):
                    raw = memoryview(data[offsets[i] : offsets[i + 1]])
                    kept, at, removed, runs, end = [], 0, 0, 0, -1
                    for start, stop in sorted(of.get(i, ())):
                        if start > end:
                            kept.append(raw[at:start])
                            runs += 1
                            end = start
                        if stop > end:
                            removed += stop - end
                            end = stop
                        at = max(at, end)
                    kept.append(raw[at:])
                    rest = b"".join(kept)
                    out.append((None if d == _NONE else d, len(raw), removed, runs, rest if with_text else None, hashlib.sha256(rest).hexdigest()))
                columns = list(zip(*out, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return run


def whole_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, sha): documents of LENGTH bytes or more whose whole text a smaller doc_id has too."""
    keyed = docs.where(F.octet_length("text") >= LENGTH).select("doc_id", F.sha2(F.col("text"), 256).alias("sha"))
    first = keyed.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("sha", "first")
    return keyed.join(small(cut(first), BROADCAST_ROWS), "sha").where("doc_id > first").select("doc_id", "sha").distinct()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, block_bytes: int = BLOCK_BYTES, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes, null unless ``with_text``), kept_sha256.

    Matches never cross documents, may overlap, and are judged on the input.
    Order is by doc_id, then by start; a null doc_id comes first. Rows that
    repeat a doc_id count as one document: neither is earlier than the other
    at the same start. Null texts are empty; an empty table gives an empty one.
    Other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(total // BUCKET_BYTES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
    bits = min(56, max(40, total.bit_length() + 10))
    copies = cut(whole_copies(docs))
    listed = small(copies, BROADCAST_ROWS).withColumnsRenamed({"doc_id": "of", "sha": "of_sha"})
    same = (F.col("doc_id") == F.col("of")) & (F.sha2(F.col("text"), 256) == F.col("of_sha"))
    blocks = cut(docs.join(listed, same, "left_anti").mapInArrow(_pack(block_bytes), "block long, body binary"))

    keys = blocks.mapInArrow(_keys(buckets, bits), "bucket int, block long, keys binary")
    ties = keys.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_ties(hot_blocks), "block long, bucket int, codes binary")
    ties = ties.groupBy("block").agg(F.collect_list(F.struct("bucket", "codes")).alias("ties"))
    spans = "block long, row int, start long, stop long"
    sent = blocks.join(ties, "block", "left").mapInArrow(_contexts(2 * buckets, bits, buckets), "bucket int, block long, blob binary, row int, start long, stop long")
    found = sent.repartition(2 * buckets, "bucket").groupBy("bucket").applyInPandas(_sort_bucket, spans)
    found = found.groupBy("block").agg(F.collect_list(F.struct("row", "start", "stop")).alias("spans"))
    done = blocks.join(found, "block", "left").select("body", "spans").mapInArrow(_remove(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")

    size = F.octet_length("text").cast("long")
    none = F.lit("").cast("binary")
    gone = docs.join(listed, same, "left_semi").select("doc_id", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.when(F.lit(with_text), none).alias("kept"), F.sha2(none, 256).alias("kept_sha256"))
    return done.unionByName(gone).withColumn("doc_id", F.when(F.col("doc_id") != _NONE, F.col("doc_id")).cast(kind))
