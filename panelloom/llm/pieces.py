"""Unigram segmentation over a double-array trie, with byte fallback.

The vocabulary (pieces with scores) is read from a SentencePiece model file, and
its scores are taken for log probabilities. In a file of a merge vocabulary, such
as the one of the registered query, they are negated merge ranks: the best-scoring
sequence is then the one of the smallest sum of ranks, which the library's own
merges need not choose. A text is normalised as the model says (white space to the marker, a
dummy marker in front), cut where runs of markers begin, and every cut, which
no piece spans, gets its best-scoring sequence of pieces by Viterbi. Characters
outside the vocabulary become byte pieces, or the unknown piece where the model
has none.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import held, spread

MARK = "▁"
#: The penalty below the lowest score that an unknown character costs.
UNKNOWN_PENALTY = 10.0
#: Cuts that a worker keeps, of up to so many characters.
CACHE_CUTS, KEPT_CUT = 200_000, 48
#: New cuts from which they are segmented in lockstep, and the cuts of texts that are looked through together.
LOCKSTEP, TOGETHER = 64, 1 << 18
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: (number, value)."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class DoubleArray:
    """Trie of byte strings in two integer arrays; slot 0 is the root.

    The child of slot s by byte c is base[s] + c + 1 if check there is s; the value
    of a key hangs on code 0."""

    def __init__(self, keys: dict[bytes, int]):
        kids: dict[bytes, set[int]] = {b"": set()}
        for key in keys:
            for i, c in enumerate(key):
                kids.setdefault(key[:i], set()).add(c + 1)
            kids.setdefault(key, set()).add(0)
        size = 1 << 16
        base, check = [0] * size, [-1] * size
        check[0] = 0
        free = 1
        todo: list[tuple[bytes, int]] = [(b"", 0)]
        for prefix, slot in todo:
            codes = sorted(kids[prefix])
            while check[free] >= 0:
                free += 1
            at = max(1, free - codes[0])
            while True:
                while at + 258 >= size:
                    base += [0] * size
                    check += [-1] * size
                    size *= 2
                if all(check[at + c] < 0 for c in codes):
                    break
                at += 1
            base[slot] = at
            for c in codes:
                check[at + c] = slot
                if c:
                    todo.append((prefix + bytes([c - 1]), at + c))
                else:
                    base[at] = -1 - keys[prefix]
        while check and check[-1] < 0:
            check.pop()
            base.pop()
        pad = 258
        self.base, self.check = base + [0] * pad, check + [-1] * pad
        #: The value of the key that ends in a slot, or -1: one look-up less for each step.
        self.value = [-1 - self.base[b] if c >= 0 and self.check[b] == s and self.base[b] < 0 else -1 for s, (b, c) in enumerate(zip(base, check, strict=True))] + [-1] * pad

    def prefixes(self, data: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, value) of every key that begins at the given byte, shortest first."""
        base, check, slot = self.base, self.check, 0
        n = len(data)
        while True:
            here = base[slot]
            if slot and check[here] == slot and base[here] < 0:
                yield at, -1 - base[here]
            if at == n:
                return
            to = here + data[at] + 1
            if check[to] != slot:
                return
            slot, at = to, at + 1


class UnigramPieces:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, model: bytes, cache: int = CACHE_CUTS):
        pieces: list[tuple[str, float, int]] = []
        self.dummy_prefix, self.squeeze, self.escape = True, True, True
        for number, value in _fields(model):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("only models without a character map are supported")
                self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.pieces = [p for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        self.scores = [s for _, s, _ in pieces]
        self.unk = self.kinds.index(UNKNOWN)
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        known = {p.encode(): i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER)}
        self.trie = DoubleArray(known)
        self.unk_score = min((s for _, s, k in pieces if k == NORMAL), default=0.0) - UNKNOWN_PENALTY
        # cuts in front of marker runs are exact only if no piece has a marker after another character
        usable = [p for p, _, k in pieces if k in (NORMAL, USER)]
        self.cuttable = not any(MARK in p.lstrip(MARK) for p in usable) and bool(self.byte_id)
        # a line feed that no piece has is always on its own
        self.cut = (_CUT if any("\n" in p for p in usable) else _CUT_LINES).findall
        self.limit, self.seen = cache, _Cuts(self)

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    def viterbi(self, cut: str) -> list[int]:
        """Ids of the best sequence; the earlier found one wins a tie, that is the longer last piece."""
        data = cut.encode("utf-8", "replace")
        n = len(data)
        base, check, value, scores, unk_score = self.trie.base, self.trie.check, self.trie.value, self.scores, self.unk_score
        best, back, piece_of = [-1e300] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            lead = data[at]
            after = at + (1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4)
            score, single, slot, end = best[at], False, 0, at
            while end < n:  # down the trie along the text
                to = base[slot] + data[end] + 1
                if check[to] != slot:
                    break
                slot, end = to, end + 1
                piece = value[slot]
                if piece >= 0:
                    new = score + scores[piece]
                    if new > best[end]:
                        best[end], back[end], piece_of[end] = new, at, piece
                    if end == after:
                        single = True
            if not single and score + unk_score > best[after]:
                best[after], back[after], piece_of[after] = score + unk_score, at, -1
            at = after
        out: list[int] = []
        end, joined = n, False
        while end > 0:
            at, piece = back[end], piece_of[end]
            if piece >= 0:
                out.append(piece)
            elif self.byte_id:
                out += [self.byte_id[b] for b in reversed(data[at:end])]
            elif not joined:
                out.append(self.unk)  # a run of unknown characters is one unknown piece
            joined = piece < 0
            end = at
        return out[::-1]

    def viterbi_many(self, cuts: list[str]) -> list[bytes]:
        """Ids of the best sequence of each cut, as ``viterbi`` finds them, in lockstep: all cuts
        go on by a byte at a time, so that a step is a few array operations. For vocabularies with byte pieces."""
        if not hasattr(self, "arrays"):
            self.arrays = tuple(np.array(x, dtype=np.int64) for x in (self.trie.base, self.trie.check, self.trie.value)), np.array(self.scores), np.array([self.byte_id.get(b, self.unk) for b in range(256)], dtype="<u4")
        (base, check, value), scores, byte_id = self.arrays
        coded = [c.encode("utf-8", "replace") for c in cuts]
        size = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        order = np.argsort(-size, kind="stable")  # the longest first: those that reach a byte are a beginning
        size, wide = size[order], int(size.max()) + 1
        data = np.zeros((len(cuts), wide), dtype=np.int64)
        data[np.arange(wide) < size[:, None]] = np.frombuffer(b"".join([coded[k] for k in order.tolist()]), np.uint8)
        best = np.full(data.shape, -1e300)
        best[:, 0] = 0.0
        back, piece_of = np.full(data.shape, -1), np.full(data.shape, -1)
        for at in range(wide - 1):
            row = np.arange(np.searchsorted(-size, -at, side="left"))
            lead = data[row, at]
            row = row[lead >> 6 != 2]  # characters begin here
            lead = data[row, at]
            after = at + np.where(lead < 128, 1, np.where(lead < 224, 2, np.where(lead < 240, 3, 4)))
            score, single = best[row, at], np.zeros(len(row), dtype=bool)
            live, slot, end = np.arange(len(row)), np.zeros(len(row), dtype=np.int64), at
            while len(live):  # down the trie along the texts
                inside = end < size[row[live]]
                live, slot = live[inside], slot[inside]
                if not len(live):
                    break
                to = base[slot] + data[row[live], end] + 1
                fits = check[to] == slot
                live, slot, end = live[fits], to[fits], end + 1
                ends = np.flatnonzero(value[slot] >= 0)
                of, piece = live[ends], value[slot[ends]]
                single[of[after[of] == end]] = True
                new = score[of] + scores[piece]
                better = new > best[row[of], end]
                of, piece = of[better], piece[better]
                best[row[of], end], back[row[of], end], piece_of[row[of], end] = new[better], at, piece
            of = np.flatnonzero(~single)
            of = of[score[of] + self.unk_score > best[row[of], after[of]]]
            best[row[of], after[of]], back[row[of], after[of]], piece_of[row[of], after[of]] = score[of] + self.unk_score, at, -1
        rows, begins, ends, pieces = [], [], [], []
        row, end = np.arange(len(cuts)), size
        while len(row):
            at = back[row, end]
            rows.append(row)
            begins.append(at)
            ends.append(end)
            pieces.append(piece_of[row, end])
            row, end = row[at > 0], at[at > 0]
        row, begin, end, piece = (np.concatenate(x) for x in (rows, begins, ends, pieces))
        by = np.lexsort((begin, row))
        row, begin, end, piece = row[by], begin[by], end[by], piece[by]
        n = np.where(piece < 0, end - begin, 1)
        ids = np.repeat(piece, n)
        unknown = np.flatnonzero(ids < 0)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        ids[unknown] = byte_id[data[np.repeat(row, n)[unknown], place[unknown]]]
        raw = ids.astype("<u4").tobytes()
        stop = 4 * np.cumsum(np.bincount(np.repeat(row, n), minlength=len(cuts)))
        out = [b""] * len(cuts)
        for k, a, b in zip(order.tolist(), [0, *stop[:-1].tolist()], stop.tolist(), strict=True):
            out[k] = raw[a:b]
        return out

    def learn(self, cuts: list[list[str]]) -> None:
        """Segment the cuts that are not known yet, together."""
        new = list({c for x in cuts for c in x if c not in self.seen and len(c) <= KEPT_CUT})
        if len(new) < LOCKSTEP:
            return  # one by one, as they come
        if len(self.seen) + len(new) > self.limit:
            self.seen.clear()
            new = list({c for x in cuts for c in x if len(c) <= KEPT_CUT})[: self.limit]
        self.seen.update(zip(new, self.viterbi_many(new), strict=True))

    def cuts_of(self, text: str | None) -> list[str]:
        text = self.normalise(text or "")
        return self.cut(text) if self.cuttable else [text] * bool(text)  # without byte pieces a run of unknown characters could span a cut

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null counts as empty."""
        return b"".join(map(self.seen.__getitem__, self.cuts_of(text)))

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """As ``encode``, the new cuts of many texts at once."""
        out: list[bytes] = []
        held: list[list[str]] = []
        size = 0
        for k, text in enumerate(texts):
            held.append(self.cuts_of(text))
            size += len(held[-1])
            if k == len(texts) - 1 or size >= TOGETHER:
                if self.cuttable:
                    self.learn(held)
                out += [b"".join(map(self.seen.__getitem__, x)) for x in held]
                held, size = [], 0
        return out

    def decode(self, ids: bytes | list[int]) -> str:
        """Text of the ids: markers to spaces, byte pieces to their bytes, the dummy marker dropped."""
        ids = np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else list(ids)
        if not hasattr(self, "raw"):
            byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
            self.raw = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else byte_of[i] if k == BYTE else p.replace(MARK, " ").encode() for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))]
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


class _Cuts(dict):
    """Ids of the cuts seen, found by Viterbi where missing; long cuts are not kept."""

    def __init__(self, codec: UnigramPieces):
        self.codec = codec

    def __missing__(self, cut: str) -> bytes:
        ids = np.array(self.codec.viterbi(cut), dtype="<u4").tobytes()
        if len(cut) <= KEPT_CUT:
            if len(self) >= self.codec.limit:
                self.clear()
            self[cut] = ids
        return ids


_CUT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_CUT_LINES = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
def pieces_of(path: str) -> UnigramPieces:
    """The encoder of a model file, built once in each worker."""

    def build() -> UnigramPieces:
        with open(path, "rb") as f:
            return UnigramPieces(f.read())

    return held(f"pieces-{path}", build)


def piece_table(docs: DataFrame, model: str, keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """Encode docs(doc_id, text) and decode again; one row for every row.

    Columns: doc_id, n_pieces, n_byte_pieces, ids_crc32 (ids as little-endian
    32-bit integers), round_trip (the decoded text equals the input), then ``keep``
    and, if wanted, the ids as binary. Null and empty texts have no pieces and
    decode to the empty text (round_trip is true for both). Repeated rows are
    each returned; an empty table gives an empty result. A very long text is cut as
    others are; a cut without spaces is segmented whole, in time and memory in
    proportion to its length. Of sequences that score the same the first found holds.
    """
    types = dict(docs.dtypes)
    out = "doc_id long, n_pieces int, n_byte_pieces int, ids_crc32 long, round_trip boolean" + "".join(f", `{c}` {types[c]}" for c in keep) + (", ids binary" if with_ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pieces_of(model)
        byte_piece = np.zeros(len(codec.pieces), dtype=bool)
        byte_piece[list(codec.byte_id.values())] = True
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = codec.encode_many(texts)
            arrays = [np.frombuffer(x, "<u4") for x in ids]
            columns = [
                batch.column(0),
                pa.array([len(a) for a in arrays], pa.int32()),
                pa.array([int(byte_piece[a].sum()) for a in arrays], pa.int32()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array([codec.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                *batch.columns[2:],
            ]
            names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip", *keep]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    return spread(rows).mapInArrow(run, out)
