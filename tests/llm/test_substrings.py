"""Repeated bytes against brute force on planted repeats over many small blocks, hot ranks and odd ids."""

import hashlib
import random
import re

import numpy as np

from lodestone.llm import substrings


def by_hand(rows):
    """(n_bytes, n_removed, n_spans, sha) of each row, from the smallest (id, start) of every 100-byte string."""
    least, out = {}, []
    ids = [-1 if k is None else k for k, _ in rows]
    raw = [(t or "").encode() for _, t in rows]
    for k, b in zip(ids, raw, strict=True):
        for i in range(len(b) - 99):
            least[b[i : i + 100]] = min(least.get(b[i : i + 100], (k, i)), (k, i))
    for k, b in zip(ids, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if least[b[i : i + 100]] != (k, i):
                gone[i : i + 100] = b"\x01" * 100
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def planted():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, passage, base = prose(16)[:90], prose(60), prose(120)
    texts = [None, "", "x" * 99, "x" * 100, "y" * 450, "z" * 99 + "é" * 80, base, base]
    for _ in range(60):
        texts.append("\n".join([prose(draw.randint(5, 40)), line, prose(draw.randint(0, 30))]))  # one line, ever other surroundings
        at = draw.randint(0, len(base) - 5)
        texts.append(base[:at] + word() + base[at + draw.randint(0, 40) :])
        texts.append(prose(draw.randint(0, 9)) + passage[draw.randint(0, 60) :] + prose(3))
    texts.append(passage + " " + passage)
    draw.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def test_planted_repeats_over_blocks_and_hot_ranks(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id")
    for size, hot in ((1 << 20, 64), (1500, 3)):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.deduplicate(docs, block_bytes=size, hot_blocks=hot).collect()}
        assert got == {k: want for (k, _), want in zip(rows, by_hand(rows), strict=True)}


def test_ids_that_are_null_or_repeat(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (4, text), (4, text), (4, "a " + text[50:]), (7, text[:150] * 2), (9, text[:99])]
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(by_hand(rows))
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(k) for k, _ in rows)


def test_windows_that_hash_alike_are_told_apart(monkeypatch):
    data = np.frombuffer(b"".join(bytes([65 + i % 3]) * 100 + bytes([97 + i]) for i in range(9)), np.uint8)
    start = np.arange(len(data) - 99)
    zero = np.zeros(len(start), np.int64)
    want = substrings.later(zero, zero, start, start, data)
    monkeypatch.setattr(substrings, "hashes", lambda data, start, length: np.zeros(len(start), np.uint64))
    assert want.sum() == 6 and (substrings.later(zero, zero, start, start, data) == want).all()
