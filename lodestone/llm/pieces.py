"""N-best segmentation over a piece lattice by forward Viterbi and backward A-star, and decoding."""

from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import frugal
from .common import arrow_batches

#: The mark that stands for a space in piece vocabularies.
MARK = "▁"
N_BEST = 3
#: Bytes of text, and cells of a lattice, that are worked on at once.
TEXT_BYTES, CELLS = 3 << 20, 500_000
#: Longer segments are searched one by one.
LONG = 40
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = -1e300


def _width(raw: np.ndarray) -> np.ndarray:
    """How many bytes a character has in UTF-8."""
    return 1 + (raw >= 0x80) + (raw >= 0x800) + (raw >= 0x10000)


class Lattice:
    """Pieces and scores of a vocabulary file. Characters without a piece go to byte pieces at a fixed penalty.

    A segmentation's score is the sum of its pieces' log probabilities, as in a
    unigram model. A file of merges has ranks in their place, which are no
    probabilities; they count as ranks of a Zipf law, so that a piece's
    probability falls with one over its rank. The best segmentation need not be
    the one that merging finds. Texts are taken as they are: of the file's
    normalisation only the leading mark is applied.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes, found = {}, {}
        for i, text in enumerate(self.texts):
            if model.is_byte(i):
                self.bytes[int(text[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                found[text] = (i, model.get_score(i))
        byte_of = {i: bytes([b]) for b, i in self.bytes.items()}
        #: What each id stands for, in UTF-8.
        self.raw = [byte_of.get(i) or t.encode() for i, t in enumerate(self.texts)]
        self.unknown = model.unk_id()
        if found and all(score == int(score) <= 0 for _, score in found.values()):  # merge ranks
            whole = math.log(sum(1 / (2 - score) for _, score in found.values()))
            found = {t: (i, -math.log(2 - score) - whole) for t, (i, score) in found.items()}
        self.ids: dict[str, tuple[int, float]] = found
        self.penalty = min((score for _, score in found.values()), default=0.0) - 10
        self.longest = max(map(len, self.ids), default=1)
        straddling = any(re.search(rf"[^{MARK}]{MARK}", t) for t in self.ids)
        #: Pieces never run from a character on to a mark, so a text falls apart before each run of marks.
        self.segment = re.compile(r"(?s).+" if straddling else rf"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.apart = not straddling
        # the vocabulary for array look-ups: hashes in order with id and score, and a table that most other strings miss
        texts = list(self.ids)
        code = np.array([self._code(np.array([ord(c) for c in t], np.uint64)) for t in texts], np.uint64)
        order = np.argsort(code)
        self.codes = code[order]
        self.code_ids = np.array([self.ids[t][0] for t in texts], np.int32)[order]
        self.code_scores = np.array([self.ids[t][1] for t in texts], np.float64)[order]
        self.maybe = np.zeros(1 << 22, bool)
        leading = (self.codes >> np.uint64(42)).astype(np.int64)
        self.maybe[leading] = True
        self.first = np.zeros(1 << 22, np.int32)
        self.first[leading[::-1]] = np.arange(len(leading), dtype=np.int32)[::-1]

    @staticmethod
    def _code(characters: np.ndarray) -> np.uint64:
        code = np.zeros(1, np.uint64)
        for c in characters:
            code = (code + c + np.uint64(1)) * _BASE
        return code[0]

    def n_best(self, text: str, n: int = N_BEST) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations, best first.

        Forward Viterbi scores are the exact cost still to come of a partial
        segmentation that was built from the end. So each partial segmentation
        stands for a different whole one of exactly its estimate, only the n
        best ones need be open, and ties cannot pile up.
        """
        size, pieces = len(text), self.ids
        best, into = [_NONE] * (size + 1), [[] for _ in range(size + 1)]
        best[0] = 0.0
        for at in range(size):
            here = best[at]
            for end in range(at + 1, min(at + self.longest, size) + 1):
                if hit := pieces.get(text[at:end]):
                    into[end].append((at, hit[1], (hit[0],)))
                    best[end] = max(best[end], here + hit[1])
            if text[at] not in pieces:
                raw = self._raw(text[at])
                into[at + 1].append((at, self.penalty * len(raw), raw))
                best[at + 1] = max(best[at + 1], here + self.penalty * len(raw))
        open_ = [(best[size], size, 0.0, None)]
        while (k := next((i for i, x in enumerate(open_) if x[1]), None)) is not None:
            _, at, done, path = open_.pop(k)
            more = [(done + score + best[start], start, done + score, (ids, path)) for start, score, ids in into[at]]
            open_ = sorted(open_ + more, key=lambda x: -x[0])[:n]
        out = []
        for score, _, _, path in open_:
            ids: list[int] = []
            while path:
                ids.extend(path[0])
                path = path[1]
            out.append((score, tuple(ids)))
        return out

    def _batch(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of many segments of one length: score of the best segmentation, what the second best loses against it, and the ids of the best.

        ids has a column for each character: the id of the piece that starts
        there, -1 for none, -2 - c for the bytes of character c. The second
        best is the best one through any arc that the best leaves out, by
        forward and backward scores.
        """
        rows, size = chars.shape
        width = min(self.longest, size)
        chars = np.ascontiguousarray(chars.T)
        arc = np.full((size + 1, width + 1, rows), _NONE)  # by end and length; the rows lie side by side
        piece = np.full((size + 1, width + 1, rows), -1, np.int32)
        code = np.zeros((size, rows), np.uint64)
        for length in range(1, width + 1):
            code = (code[: size - length + 1] + chars[length - 1 :] + np.uint64(1)) * _BASE
            at, r = np.nonzero(self.maybe[(code >> np.uint64(42)).astype(np.int64)])
            want = code[at, r]
            hit = self.first[(want >> np.uint64(42)).astype(np.int64)]
            same = self.codes[hit] == want
            if not same.all():  # another piece of the same leading bits, or none
                other = np.flatnonzero(~same)
                hit[other] = np.minimum(np.searchsorted(self.codes, want[other]), len(self.codes) - 1)
                same[other] = self.codes[hit[other]] == want[other]
                at, r, hit = at[same], r[same], hit[same]
            arc[at + length, length, r] = self.code_scores[hit]
            piece[at + length, length, r] = self.code_ids[hit]
        at, r = np.nonzero(piece[1:, 1] < 0)
        raw = chars[at, r].astype(np.int64)
        arc[at + 1, 1, r], piece[at + 1, 1, r] = self.penalty * _width(raw), -2 - raw
        best, rest = np.full((size + 1, rows), _NONE), np.full((size + 1, rows), _NONE)
        best[0] = rest[size] = 0
        chosen = np.ones((size + 1, rows), np.int64)
        for end in range(1, size + 1):
            k = min(width, end)
            here = arc[end, 1 : k + 1]
            here += best[end - k : end][::-1]  # from here on: the best that ends with this arc
            best[end] = here[0]
            for j in range(1, k):
                chosen[end, here[j] > best[end]] = j + 1
                np.maximum(best[end], here[j], out=best[end])
        for end in range(size, 0, -1):
            k = min(width, end)
            here = arc[end, 1 : k + 1]
            here += rest[end]  # the best through this arc
            tail = here - best[end - k : end][::-1]
            rest[end - k : end] = np.maximum(rest[end - k : end], tail[::-1])
        ids = np.full((rows, size), -1, np.int32)
        live, at = np.arange(rows), np.full(rows, size)
        while len(live):
            length = chosen[at, live]
            arc[at, length, live] = _NONE
            ids[live, at - length] = piece[at, length, live]
            at = at - length
            live, at = live[at > 0], at[at > 0]
        return best[size], best[size] - arc.reshape(-1, rows).max(axis=0), ids

    def solve(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of many segments: score of the best segmentation, loss of the second best, and the ids of the best of all in a row with their ends."""
        score, loss, count = np.zeros(len(segments)), np.zeros(len(segments)), np.zeros(len(segments), np.int64)
        size = np.array([len(s) for s in segments])
        chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length in np.unique(size[size <= LONG]):
            which = np.flatnonzero(size == length)
            step = max(1, CELLS // int((length + 1) * (min(self.longest, length) + 1)))
            for a in range(0, len(which), step):
                mine = which[a : a + step]
                chars = np.array([segments[i] for i in mine], f"U{length}").view(np.uint32).reshape(len(mine), length).astype(np.uint64)
                score[mine], loss[mine], ids = self._batch(chars)
                wide = np.where(ids >= 0, 1, np.where(ids == -1, 0, _width(-2 - ids.astype(np.int64))))
                count[mine] = wide.sum(axis=1)
                chunks.append((mine, ids, wide))
        slow = {i: self.n_best(segments[i], 2) for i in np.flatnonzero(size > LONG)}
        for i, found in slow.items():
            score[i], count[i] = found[0][0], len(found[0][1])
            loss[i] = found[0][0] - found[1][0] if len(found) > 1 else np.inf
        ends = np.cumsum(count)
        flat = np.zeros(int(ends[-1]) if len(segments) else 0, np.int32)
        for mine, ids, wide in chunks:
            at = (ends[mine] - count[mine])[:, None] + np.cumsum(wide, axis=1) - wide
            one = ids >= 0
            flat[at[one]] = ids[one]
            for r, c in zip(*np.nonzero(ids < -1), strict=True):
                flat[at[r, c] : at[r, c] + wide[r, c]] = self._raw(chr(-2 - ids[r, c]))
        for i, found in slow.items():
            flat[ends[i] - count[i] : ends[i]] = found[0][1]
        return score, np.where(loss > -_NONE / 2, np.inf, loss), flat, ends

    def _raw(self, character: str) -> tuple[int, ...]:
        return tuple(self.bytes.get(b, self.unknown) for b in character.encode("utf-8", "surrogatepass"))

    def _segments(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(segment numbers of all texts in a row, the different segments, first segment of each text)."""
        if self.apart and not pc.any(pc.match_substring_regex(texts, f"[\\x00{MARK}]")).as_py():
            marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)), " ", "\x00 ")
            while pc.any(pc.match_substring(marked, " \x00 ")).as_py():  # runs of spaces stay together
                marked = pc.replace_substring(marked, " \x00 ", "  ")
            parts = pc.split_pattern(marked, "\x00")
            coded = parts.flatten().dictionary_encode()
            number, first = coded.indices.to_numpy(), parts.offsets.to_numpy()
            keep = np.ones(len(number), bool)
            keep[first[:-1]] = False  # what stands before the first mark
            return number[keep], pc.replace_substring(coded.dictionary, " ", MARK).to_pylist(), first - np.arange(len(first))
        known: dict[str, int] = {}
        number, first = [], [0]
        for text in texts.to_pylist():
            number += [known.setdefault(s, len(known)) for s in self.segment.findall((MARK + text).replace(" ", MARK))]
            first.append(len(number))
        return np.array(number, np.int64), list(known), np.array(first)

    def encode(self, texts: list[str], n: int = N_BEST) -> list[tuple[list[np.ndarray], list[float]]]:
        """The n best segmentations of each whole text, and their scores. An empty text has one, without pieces.

        A text's next best differ from its best in the segments of least loss,
        so only those are searched for more than their best.
        """
        number, names, first = self._segments(pa.array(texts, pa.large_string()))
        used = np.unique(number)
        place = np.zeros(len(names), np.int64)
        place[used] = np.arange(len(used))
        names = [names[i] for i in used]
        score, loss, flat, ends = self.solve(names)
        number = place[number]
        begin, count = (ends - np.diff(ends, prepend=0))[number], np.diff(ends, prepend=0)[number]
        stop = np.cumsum(count)
        ids = flat[np.repeat(begin - (stop - count), count) + np.arange(int(stop[-1]) if len(stop) else 0)]
        near = loss[number]
        others: dict[int, list[tuple[float, tuple[int, ...]]]] = {}
        out = []
        for text, a, b in zip(texts, first[:-1], first[1:], strict=True):
            if not text:
                out.append(([np.zeros(0, np.int32)], [0.0]))
                continue
            weakest = range(b - a) if b - a < n else np.argpartition(near[a:b], n - 2)[: n - 1] if n > 1 else ()
            singles = []
            for w in weakest:
                if (word := number[a + w]) not in others:
                    mine = tuple(flat[begin[a + w] : begin[a + w] + count[a + w]].tolist())
                    others[word] = [(max(0.0, score[word] - s), i) for s, i in self.n_best(names[word], n) if i != mine][: n - 1]
                singles += [(float(x), int(a + w), k) for k, (x, _) in enumerate(others[word])]
            singles = sorted(singles)[: n - 1]
            ways = sorted((sum(x for x, _, _ in c), c) for k in range(1, n) for c in combinations(singles, k) if len({w for _, w, _ in c}) == k)[: n - 1]
            best = ids[stop[a] - count[a] : stop[b - 1]]
            found = [best]
            for _, chosen in ways:
                parts, at = [], 0
                for _, w, k in sorted(chosen, key=lambda x: x[1]):
                    here = stop[w] - count[w] - (stop[a] - count[a])
                    parts += [best[at:here], np.array(others[number[w]][k][1], np.int32)]
                    at = here + count[w]
                found.append(np.concatenate([*parts, best[at:]]))
            base = float(score[number[a:b]].sum())
            out.append((found, [base, *(base - x for x, _ in ways)]))
        return out

    def decode(self, ids) -> str:
        """The text of the ids: encode() and decode() restore any text without the mark itself."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")[1:]


_loaded: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _loaded:
        _loaded[path] = Lattice(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST) -> DataFrame:
    """Per document: doc_id, segmentations (the ids of the n best, best first), scores, round_trip (whether decoding the best gives the text back).

    Whole texts; a null text gives nulls; an empty one has one segmentation,
    without pieces. Segmentations of equal score come in the order of the
    search. round_trip is false only where the text holds the mark itself. Rows
    may repeat; an empty table gives an empty one; other columns are ignored.
    ``model`` must exist on every worker.
    """
    kinds = (pa.list_(pa.list_(pa.int32())), pa.list_(pa.float64()), pa.bool_())

    def run(batches):
        frugal()
        pieces = lattice(model)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            ends, a = np.cumsum(sizes), 0
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TEXT_BYTES, "right")))
                texts = batch.column(1).slice(a, b - a).to_pylist()
                done = iter(pieces.encode([t for t in texts if t is not None], n))
                rows = [None if t is None else next(done) for t in texts]
                columns = ([r and r[0] for r in rows], [r and r[1] for r in rows], [r and pieces.decode(r[0][0].tolist()) == t for r, t in zip(rows, texts, strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "segmentations", "scores", "round_trip"])
                a = b

    kind = dict(docs.dtypes)[id_col]
    arrow_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, segmentations array<array<int>>, scores array<double>, round_trip boolean")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of piece ids; null ids give a null text, ids outside the vocabulary an error."""

    def run(batches):
        pieces = lattice(model)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"doc_id {kind}, text string")
