"""Token ids in bit-plane files.

A file is a Parquet table of segments. A segment holds the ids of whole
documents in ascending doc_id order: ids are cut into fixed-size blocks, each
block is transposed into bit planes (or byte planes), and every plane is a
zstandard frame of its own. The chunk index in front of the frames has the
number of ids, of planes and the length of every frame of each block, so one
block, or one plane of it, can be read alone.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import Workspace, held, spread

END_ID = 1
BLOCK_IDS = 1 << 14
#: Documents join a segment until it has this many ids; one document is never cut.
SEGMENT_IDS = 1 << 18
#: Documents aimed at for one shard, that is one task and one file.
SHARD_DOCS = 20_000
#: More documents make larger shards beyond this many (their bounds are literals of the plan).
MAX_SHARDS = 20_000
#: Words whose ids a worker keeps in each of two generations.
CACHE_WORDS = 200_000
MAGIC = b"BPT1"

# Characters of texts that may be encoded word by word: printable ASCII, plain white
# space, Latin-1 and Latin Extended-A, all of them equal to their NFC form.
_OTHER = re.compile("[^\t\n\r -~¡-įı-ſ]")
# The tokenizer's own pattern for what is one word to the merges (a fixed value), for those characters.
_LETTER = "".join(c for c in map(chr, range(0x180)) if c.isalpha())
_NUMBER = "".join(c for c in map(chr, range(0x180)) if c.isnumeric())
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+").findall


# Masks and shifts of the transposition of an 8 x 8 bit matrix in a 64-bit word (fixed values).
_SWAPS = ((0x00AA00AA00AA00AA, 7), (0x0000CCCC0000CCCC, 14), (0x00000000F0F0F0F0, 28))


def _transposed(x: np.ndarray) -> np.ndarray:
    """Each word seen as eight bytes of eight bits, rows and columns swapped; twice gives the words back."""
    for mask, shift in _SWAPS:
        moved = (x ^ (x >> np.uint64(shift))) & np.uint64(mask)
        x = x ^ moved ^ (moved << np.uint64(shift))
    return x


def _to_bits(part: np.ndarray, width: int) -> np.ndarray:
    """Bit planes (width, bytes) of ids, the lowest bit first; eight ids to a byte, the last byte filled up with 0."""
    raw = np.zeros((-(-len(part) // 8) * 8, 4), dtype=np.uint8)
    raw[: len(part)] = part.view(np.uint8).reshape(-1, 4)
    words = np.ascontiguousarray(raw[:, : -(-width // 8)].T).view("<u8")
    return _transposed(words).view(np.uint8).reshape(len(words), -1, 8).transpose(0, 2, 1).reshape(-1, words.shape[1])[:width]


def _from_bits(planes: np.ndarray, n: int) -> np.ndarray:
    """Ids (n, 4 bytes) of 32 bit planes."""
    words = np.ascontiguousarray(planes.reshape(4, 8, -1).transpose(0, 2, 1)).reshape(4, -1).view("<u8")
    return np.ascontiguousarray(_transposed(words).view(np.uint8).reshape(4, -1)[:, :n].T)


def pack_ids(ids: np.ndarray, block: int = BLOCK_IDS, planes: str = "bit", level: int = 3) -> bytes:
    """Unsigned 32-bit ids to planes with a chunk index. An empty array gives no blocks."""
    zip_ = zstandard.ZstdCompressor(level=level)
    index, frames = [], []
    for k in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[k : k + block], dtype="<u4")
        width = max(1, int(part.max()).bit_length())
        rows = _to_bits(part, width) if planes == "bit" else part.view(np.uint8).reshape(-1, 4)[:, : (width + 7) // 8].T
        packed = [zip_.compress(np.ascontiguousarray(r).tobytes()) for r in rows]
        index.append(struct.pack(f"<IB{len(packed)}I", len(part), len(packed), *map(len, packed)))
        frames += packed
    head = b"".join(index)
    return struct.pack("<4sBII", MAGIC, planes == "bit", len(index), len(head)) + head + b"".join(frames)


def unpack_ids(data: bytes) -> np.ndarray:
    magic, bit, blocks, size = struct.unpack_from("<4sBII", data)
    if magic != MAGIC:
        raise ValueError("not a bit-plane segment")
    at, body, unzip, out = 13, 13 + size, zstandard.ZstdDecompressor(), []
    for _ in range(blocks):
        n, count = struct.unpack_from("<IB", data, at)
        sizes = struct.unpack_from(f"<{count}I", data, at + 5)
        at += 5 + 4 * count
        rows = np.zeros((32, -(-n // 8)) if bit else (4, n), dtype=np.uint8)
        for p, length in enumerate(sizes):
            rows[p] = np.frombuffer(unzip.decompress(data[body : body + length]), dtype=np.uint8)
            body += length
        out.append((_from_bits(rows, n) if bit else np.ascontiguousarray(rows.T)).reshape(-1).view("<u4"))
    return np.concatenate(out) if out else np.empty(0, "<u4")


def _byte_letters() -> list[str]:
    """Letters that byte-level vocabularies write bytes with: printable ones stand for
    themselves, the others for 256 and on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordEncoder(dict):
    """Ids of whole texts by the tokenizers library; maps a white-space separated
    word to its ids and asks the library's model for new ones only.

    The tokenizer drops white space and its pieces never span it, so the ids of a
    text are those of its words. That holds for texts of the plain characters above,
    which the normaliser only lower-cases; any other text, and any that holds one of
    the tokenizer's added tokens, goes to the library whole. When the words are too
    many, those not asked for since the last time go (two generations)."""

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.code = "H" if self.tok.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = "<u2" if self.code == "H" else "<u4"
        self.limit = cache
        self.old: dict[str, bytes] = {}
        self.letters = _byte_letters()
        added = [re.escape(x.content) for x in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)", re.I)

    def __missing__(self, word: str) -> bytes:
        raw = self.old.get(word)
        if raw is None:
            tokenize, ids = self.model.tokenize, array(self.code)
            if word.isascii() and word.isalpha():
                ids.extend([t.id for t in tokenize(word)])
            else:
                for part in _PARTS(word):
                    if not part.isascii():
                        part = "".join([self.letters[b] for b in part.encode()])
                    ids.extend([t.id for t in tokenize(part)])
            raw = ids.tobytes()
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = raw
        return raw

    def encode(self, text: str | None) -> bytes:
        """Little-endian ids (of ``dtype``) of a text; null counts as empty."""
        text = text or ""
        if _OTHER.search(text) or self.added.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


def encoder(path: str) -> WordEncoder:
    return held(f"tokens-{path}", lambda: WordEncoder(path))


def write_token_files(docs: DataFrame, space: Workspace, tokenizer: str, end_id: int = END_ID, per_shard: int = SHARD_DOCS, name: str = "tokens", planes: str = "bit") -> DataFrame:
    """Encode docs(doc_id, text) and write the segments; returns the table of segments.

    Null text counts as empty (its ids are the end id alone); a null doc_id sorts
    first. Rows that repeat a doc_id are all kept, ordered by their ids; they share a
    shard, as shards part the order of doc_id, and stream through its task one segment
    at a time. A very long text is encoded whole and makes a segment of its own size."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds, shards = _bounds(rows, per_shard)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        width = bytes([int(enc.dtype[-1])])
        cuts = np.array(bounds, dtype=np.int64)
        for batch in batches:
            ids = pa.array([width + enc.encode(t.as_py()) + end for t in batch.column(1)], pa.binary())
            doc = batch.column(0)
            at = np.searchsorted(cuts, doc.fill_null(-(1 << 63)).to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([doc, pa.array(at), ids], ["doc_id", "shard", "ids"])

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, docs_, size, first, seg = -1, [], [], 0, 0, 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_pylist([{"shard": shard, "segment": seg, "first_id": first, "n_ids": len(ids), "docs": docs_, "payload": pack_ids(ids, planes=planes)}], schema=_SEGMENT)

        for batch in batches:
            for doc, at, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (at != shard or size >= SEGMENT_IDS):
                    yield out()
                    first, seg = (0, 0) if at != shard else (first + size, seg + 1)
                    held, docs_, size = [], [], 0
                if at != shard:
                    shard, first, seg = at, 0, 0
                ids = _widen(raw)
                held.append(ids)
                docs_.append({"doc_id": doc, "n": len(ids)})
                size += len(ids)
        if held:
            yield out()

    coded = spread(rows).mapInArrow(encode, "doc_id long, shard int, ids binary")
    dealt = coded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids")
    return space.write(dealt.mapInArrow(segments, "shard int, segment int, first_id long, n_ids long, docs array<struct<doc_id:long,n:long>>, payload binary"), name, codec="uncompressed")


_SEGMENT = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64())]))), ("payload", pa.binary())])


def _widen(raw: bytes) -> np.ndarray:
    """Ids of a document on their way: the first byte is their width in bytes."""
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype("<u4")


def _bounds(rows: DataFrame, per_shard: int) -> tuple[list[int], int]:
    """Quantiles of doc_id that part the shards (one number for each task to come)."""
    shards = min(MAX_SHARDS, max(1, -(-rows.select("doc_id").count() // per_shard)))
    if shards == 1:
        return [], 1
    cuts = rows.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 100 * shards)).first()[0] or []
    cuts = sorted(set(cuts))
    return cuts, len(cuts) + 1


def read_token_files(stored: DataFrame) -> DataFrame:
    """(doc_id, shard, in_shard, n_tokens, ids_crc32) of every stored document, from the files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, docs, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = unpack_ids(payload)
                n = np.array([d["n"] for d in docs], dtype=np.int64)
                ends = np.cumsum(n)
                starts = ends - n
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([d["doc_id"] for d in docs], pa.int64()), pa.array(np.full(len(n), shard, np.int32)), pa.array(starts + first), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "shard", "in_shard", "n_tokens", "ids_crc32"])

    return stored.select("shard", "first_id", "docs", "payload").mapInArrow(run, "doc_id long, shard int, in_shard long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, space: Workspace, tokenizer: str, **options) -> DataFrame:
    """Write the files, read them back: (doc_id, start, n_tokens, ids_crc32) of every row.

    start counts the ids of all documents before. An empty table gives an empty result."""
    stored = write_token_files(docs, space, tokenizer, **options)
    # one row for each shard, so the running sum is over a short table
    total = stored.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    base = total.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    return read_token_files(stored).join(base, "shard").select("doc_id", (F.col("base") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32")
