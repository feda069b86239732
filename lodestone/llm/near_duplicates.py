"""Near duplicates by HyperMinHash: compressed registers are banded, compared with a collision correction, and links confirmed on full sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import byte_blocks, frugal
from .common import arrow_batches, cut, small

WORDS = 5
REGISTERS, ROWS = 128, 4
MANTISSA = 10
#: Two registers of different minima agree by chance about this often.
CHANCE = 0.17 / (1 << MANTISSA)
#: An estimate so far under the threshold is over four standard errors off: about 2 in 100,000 true links are lost to it.
MARGIN = 0.16
#: Rows and shingles of a bucket in one block.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
BROADCAST_ROWS = 200_000

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1 << 62, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1 << 62, 1 << 63, REGISTERS, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, out=out)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct 5-word shingles of each row, in order; fewer words make one shingle, none make none."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], blank[:-1]]) | edge[:-1]
    start = np.flatnonzero(~blank & before)
    after = np.concatenate([blank[1:], [True]]) | edge[1:]
    end = np.flatnonzero(~blank & after) + 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low + np.uint64(1)) * powers(_BASE, len(low)), dtype=np.uint64)])
    word = mix((sums[end] - sums[start]) * powers(_INVERSE, len(low))[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(offsets, start, "right") - 1
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    size = np.minimum(count, WORDS)
    at = np.arange(len(word))
    heads = at[at - first[row] <= count[row] - size[row]]
    value = size[row[heads]].astype(np.uint64)
    for k in range(WORDS):
        inside = k < size[row[heads]]
        value = mix(value + np.where(inside, word[np.minimum(heads + k, len(word) - 1)], np.uint64(0)))
    rows_of = row[heads]
    order = np.lexsort((value, rows_of))
    value, rows_of = value[order], rows_of[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (rows_of[1:] != rows_of[:-1])])
    return rows_of[new], value[new]


def registers(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """rows x REGISTERS: of each minimum the leading zeros and the bits after the leading one, in 16 bits."""
    out = np.zeros((rows, REGISTERS), np.uint16)
    have, first = np.unique(row, return_index=True)
    if not len(have):
        return out
    for j in range(REGISTERS):
        least = np.minimum.reduceat(value * _MUL[j] + _ADD[j], first) | np.uint64(1)
        bits = np.frexp((least >> np.uint64(11)).astype(np.float64))[1]
        zeros = np.where(bits > 0, 53 - bits, 63).astype(np.uint64)
        fraction = ((least << zeros) >> np.uint64(63 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
        out[have, j] = ((zeros << np.uint64(MANTISSA)) | fraction).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less what chance makes equal."""
    return np.clip(((a == b).mean(axis=-1) - CHANCE) / (1 - CHANCE), 0, 1)


def _sign(batches):
    frugal()
    for batch in batches:
        for a, b, data, offsets in byte_blocks(batch.column(1), 1 << 18, 512):
            row, value = shingles(data, offsets)
            rows = b - a
            size = np.bincount(row, minlength=rows)
            have, first = np.unique(row, return_index=True)
            prints = np.zeros((2, rows), np.uint64)
            if len(have):
                prints[0, have] = np.add.reduceat(mix(value + np.uint64(1)), first)
                prints[1, have] = np.add.reduceat(mix(value ^ _BASE), first)
            bands = registers(row, value, rows).view(np.int64)
            sig = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), bands.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, rows), pa.array(size.astype(np.int64)), *(pa.array(p.view(np.int64)) for p in prints), sig], ["doc_id", "n_shingles", "f1", "f2", "sig"])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (128-bit fingerprint of the set), sig (bands of four 16-bit registers)."""
    kind = dict(docs.dtypes)[id_col]
    arrow_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(_sign, f"doc_id {kind}, n_shingles long, f1 long, f2 long, sig array<long>")


def _likely(least: float):
    def run(batches):
        frugal()
        for batch in batches:
            if batch.num_rows:
                a, b = (np.array(batch.column(i).flatten()).reshape(batch.num_rows, -1).view(np.uint16) for i in (2, 3))
                keep = pa.array(estimate(a, b) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _set(text: str | None) -> set[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))} if words else set()


def _confirm(percent: int):
    def run(batches):
        frugal()
        last, held = None, set()
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            keep = []
            for i in range(batch.num_rows):
                x = a[i].as_py()
                if x != last:
                    last, held = x, _set(ta[i].as_py())
                other = _set(tb[i].as_py())
                both = len(held & other)
                keep.append(100 * both >= percent * (len(held) + len(other) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class representatives whose whole sets are similar enough."""
    sigs = reps.select("rep", "sig")
    rated = pairs.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    kind = dict(pairs.dtypes)["a"]
    likely = cut(rated.mapInArrow(_likely(percent / 100 - MARGIN), f"a {kind}, b {kind}"))
    right = texts.toDF("b", "tb").join(small(likely, BROADCAST_ROWS), "b")
    left = texts.toDF("a", "ta").join(small(likely.select("a").distinct(), BROADCAST_ROWS), "a")
    both = right.join(left, "a").select("a", "b", "ta", "tb")
    return cut(both.mapInArrow(_confirm(percent), f"a {kind}, b {kind}").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links reach, by alternating large and small stars until nothing changes."""
    edges, seen = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), None
    while True:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(low, "u")
        edges = cut(kept.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(kept.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def _undecided(least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        frugal()
        """Rows of one block of a bucket that have a likely partner of another component, not met in an earlier band.

        The block's own rows meet all rows outside the bucket's main component;
        two of those meet in the own block of the larger one.
        """
        sig = np.array(rows["sig"].tolist(), np.int64)
        regs = sig.view(np.uint16)
        rep, comp, size, out = rows["rep"].to_numpy(), rows["comp"].to_numpy(), rows["n_shingles"].to_numpy(), rows["outside"].to_numpy(bool)
        band, head = rows["band"].iloc[0], rows["head"].to_numpy()
        left, right = np.flatnonzero(out & (rep != head)), np.flatnonzero(rows["own"].to_numpy(bool) & (rep != head))
        wanted = np.zeros(len(rows), bool)
        for i in left:
            j = right[(comp[right] != comp[i]) & ((rep[right] > rep[i]) | ~out[right]) & (np.minimum(size[right], size[i]) >= least * np.maximum(size[right], size[i]))]
            j = j[~(sig[j, :band] == sig[i, :band]).any(axis=1)]
            j = j[estimate(regs[j], regs[i]) >= least]
            wanted[j] = True
            wanted[i] |= len(j) > 0
        return rows.loc[wanted, ["band", "key", "block", "own", "outside", "rep", "comp"]]

    return run


def _sets(batches):
    frugal()
    for batch in batches:
        for first, end, data, offsets in byte_blocks(batch.column(1), 1 << 20, 512):
            row, value = shingles(data, offsets)
            at = np.searchsorted(row, np.arange(end - first + 1)) * 8
            held = pa.Array.from_buffers(pa.large_binary(), end - first, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(value)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), held.cast(pa.binary())], ["rep", "set"])


def _bridges(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        frugal()
        """Pairs of one block of a bucket whose whole sets are similar enough, as many as it takes to join their components."""
        sets = [np.frombuffer(x, np.uint64) for x in rows["set"]]
        size = np.array([len(x) for x in sets])
        start = np.cumsum(size) - size
        terms, ids = np.unique(np.concatenate(sets), return_inverse=True)
        rep = rows["rep"].to_numpy()
        label = np.unique(rows["comp"].to_numpy(), return_inverse=True)[1]
        right = rows["own"].to_numpy(bool)
        seen, found = np.zeros(len(terms), bool), []
        for i in np.flatnonzero(rows["outside"].to_numpy(bool)):
            mine = ids[start[i] : start[i] + size[i]]
            seen[mine] = True
            both = np.add.reduceat(seen[ids], start, dtype=np.int64)
            seen[mine] = False
            for j in np.flatnonzero(right & (label != label[i]) & (100 * both >= percent * (size + size[i] - both))):
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    found.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def link(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Documents of equal sets form a class, stood for by its smallest id, so
    copies cost one row each. Each bucket of a band first links its members to
    its smallest one. Buckets whose members then still lie in different
    components are compared block by block, across components only, so no
    bucket is capped and no group meets in one task. Every link is confirmed on
    the whole sets. Null and empty texts have an empty set and link with
    nothing; a null id stays alone; rows that repeat an id share its component;
    an empty table gives an empty one. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(signatures(docs))
    kind = dict(docs.dtypes)["doc_id"]
    reps = cut(signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")))
    bands = reps.select("rep", "n_shingles", F.posexplode("sig").alias("band", "key"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    shared = bands.groupBy("band", "key").agg(F.min("rep").alias("head"), F.count("*").alias("n"), blocks.alias("blocks")).where("n > 1")
    members = cut(bands.join(shared, ["band", "key"]).select("band", "key", "blocks", "head", "rep"))
    stars = members.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    links = confirmed(stars, texts, reps, percent)
    roots = components(links)

    named = members.join(roots.toDF("rep", "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    # the largest component of a bucket is joined already: its rows need to meet the others only, and stay in one block each
    parts = named.groupBy("band", "key", "comp").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("band", "key").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.count("*").alias("n")).where("n > 1").select("band", "key", "main")
    rest = named.join(open_, ["band", "key"]).withColumns({"home": F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), "outside": F.col("comp") != F.col("main")})
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    met = rest.join(reps.select("rep", "n_shingles", "sig"), "rep").withColumn("block", F.explode(F.when(F.col("outside"), everywhere).otherwise(F.array("home"))))
    met = met.select("band", "key", "block", (F.col("home") == F.col("block")).alias("own"), "outside", "head", "rep", "comp", "n_shingles", "sig")
    group = ["band", "key", "block"]
    # the comparison costs time, not bytes, so its tasks are not merged by size
    tasks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    open_rows = cut(met.repartition(tasks, *group).groupBy(*group).applyInPandas(_undecided(percent / 100 - MARGIN), f"band int, key long, block int, own boolean, outside boolean, rep {kind}, comp {kind}"))
    wanted = texts.toDF("rep", "text").join(small(open_rows.select("rep").distinct(), BROADCAST_ROWS), "rep")
    sets = wanted.mapInArrow(_sets, f"rep {kind}, set binary").where("length(set) > 0")
    more = cut(open_rows.join(sets, "rep").groupBy(*group).applyInPandas(_bridges(percent), f"a {kind}, b {kind}").distinct())
    if not more.isEmpty():
        roots = components(links.unionByName(confirmed(more, texts, reps, percent)))

    classes = reps.select("f1", "f2", "rep").join(roots.toDF("rep", "root"), "rep", "left").select("f1", "f2", F.coalesce("root", "rep").alias("root"))
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2"], "left")
    root = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", root.alias("component_id"), root.eqNullSafe(F.col("doc_id")).alias("kept"))
