"""Segmentations against all of them by brute force, ties, whole texts and decoding."""

import itertools
import random
import time

import numpy as np
import pytest

from lodestone.llm import pieces as module
from lodestone.llm.pieces import MARK, Lattice
from lodestone.llm.queries import PIECES


@pytest.fixture(scope="module")
def pieces():
    return Lattice(PIECES)


def _all(pieces: Lattice, text: str):
    """Every segmentation by brute force: (score, ids)."""
    if not text:
        return [(0.0, ())]
    out = []
    for n in range(1, len(text) + 1):
        if hit := pieces.ids.get(text[:n]):
            out += [(hit[1] + s, (hit[0], *i)) for s, i in _all(pieces, text[n:])]
    if text[0] not in pieces.ids:
        raw = tuple(pieces.bytes[b] for b in text[0].encode())
        out += [(pieces.penalty * len(raw) + s, (*raw, *i)) for s, i in _all(pieces, text[1:])]
    return out


def test_n_best_against_all_segmentations(pieces):
    for text in (f"{MARK}then", f"{MARK}{MARK}banana", f"{MARK}ça🙂b", "x", "-----", "aaaa"):
        want = sorted((s for s, _ in _all(pieces, text)), reverse=True)
        for n in (1, 3, 7):
            got = pieces.n_best(text, n)
            assert [s for s, _ in got] == pytest.approx(want[:n])
            assert all((s, i) in _all(pieces, text) for s, i in got) and len({i for _, i in got}) == len(got)


def test_ties_take_time_in_proportion(pieces):
    for text in ("-" * 1000, "." * 1000, "a" * 1000, "=" * 20_000):
        began = time.time()
        assert len(pieces.n_best(text, 3)) == 3 and time.time() - began < 0.5 + len(text) / 5000


def test_many_segments_at_once_equal_one_by_one(pieces, monkeypatch):
    monkeypatch.setattr(module, "CELLS", 4000)
    draw = random.Random(3)
    words = list(dict.fromkeys(MARK + "".join(draw.choice("abcdeßéо🙂\nt") for _ in range(draw.randint(0, 44))) for _ in range(400)))
    score, loss, flat, ends = pieces.solve(words)
    for i, w in enumerate(words):
        found = pieces.n_best(w, 2)
        mine = flat[ends[i - 1] if i else 0 : ends[i]].tolist()
        assert score[i] == pytest.approx(found[0][0]) and pieces.decode(mine) == w.replace(MARK, " ")[1:]
        assert loss[i] == pytest.approx(found[0][0] - found[1][0] if len(found) > 1 else np.inf, abs=1e-6)
        assert tuple(mine) == found[0][1] or loss[i] < 1e-9


def test_whole_texts(pieces):
    for text in ("to be", "a b", "then he--", "x\ny z"):
        parts = [_all(pieces, p) for p in pieces.segment.findall((MARK + text).replace(" ", MARK))]
        want = sorted((sum(s for s, _ in c) for c in itertools.product(*parts)), reverse=True)
        whole = {tuple(i for _, ids in c for i in ids): sum(s for s, _ in c) for c in itertools.product(*parts)}
        for n in (1, 3, 5):
            ((found, scores),) = pieces.encode([text], n)
            assert scores == pytest.approx(want[:n]) and len({tuple(i) for i in found}) == len(found)
            assert [whole[tuple(i.tolist())] for i in found] == pytest.approx(scores)


def test_every_segmentation_decodes_to_the_text(pieces):
    texts = ["", " ", "a  b\n\tc", "   three", "🙂 é\x00", "word " * 500, "no mark", "ends  ", "日本語のテキスト", "́ e", "-" * 3000]
    for (found, scores), text in zip(pieces.encode(texts), texts, strict=True):
        assert len(found) == len(scores) and all(pieces.decode(ids.tolist()) == text for ids in found)
        assert scores == sorted(scores, reverse=True)
    for text, together in zip(texts[:-3], pieces.encode(texts[:-3]), strict=True):  # with a text of another split in the batch or not
        assert pieces.encode([text])[0][1] == pytest.approx(together[1])


def test_texts_with_the_mark_itself(pieces):
    ((found, _),) = pieces.encode([f"a{MARK}b"])
    assert pieces.decode(found[0].tolist()) == "a b"


def test_tables(spark):
    rows = [(1, "to be"), (2, None), (3, ""), (3, ""), (4, f"a{MARK}b")]
    done = module.encode(spark.createDataFrame(rows, "doc_id long, text string"), PIECES)
    got = {r["doc_id"]: r for r in done.collect()}
    assert got[2]["segmentations"] is None and got[2]["scores"] is None and got[2]["round_trip"] is None
    assert got[3]["segmentations"] == [[]] and got[3]["scores"] == [0.0] and got[1]["round_trip"] and not got[4]["round_trip"]
    assert len(got[1]["segmentations"]) == 3 and done.count() == len(rows)
    back = {r["doc_id"]: r["text"] for r in module.decode(done.selectExpr("doc_id", "get(segmentations, 1) AS ids"), PIECES).collect()}
    assert back == {1: "to be", 2: None, 3: None, 4: "a b"}


def test_bytes_between_pieces_decode_as_each_run_by_itself(pieces):
    """Runs of byte pieces, cut short or not, between others; and every piece is found by its leading bits, alone or not."""
    draw, plain = random.Random(5), list(pieces.ids.values())
    for _ in range(200):
        ids = [draw.choice(plain)[0] if draw.random() < 0.5 else pieces.bytes[draw.choice((0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0xFF))] for _ in range(12)]
        want, run = [], b""
        for i in [*ids, None]:
            b = next((b for b, k in pieces.bytes.items() if k == i), None)
            if b is None:
                want, run = [*want, run.decode("utf-8", "replace"), "" if i is None else pieces.texts[i]], b""
            else:
                run += bytes([b])
        assert pieces.decode(ids) == "".join(want).replace(MARK, " ")[1:]
    assert np.array_equal(pieces.first[(pieces.codes >> np.uint64(42)).astype(np.int64)], np.searchsorted(pieces.codes >> np.uint64(42), pieces.codes >> np.uint64(42)))
