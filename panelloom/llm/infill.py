"""Fill-in-the-middle: texts cut in three at unit borders and dealt anew behind sentinels.

A unit is a word with the white space before it; white space that ends a text is a
unit of its own. Counting the units of a text leaves a sparse index behind: every
so many units a checkpoint with the byte and the code point where it stands. A cut
at unit u is then found by a binary search of the checkpoints and a short rescan
from the one before it, so a text is read once whatever its length, and the index
is small beside it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import release, spread

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SUFFIX_FIRST = 42, 50, 80
#: Units between checkpoints, and bytes of a text that are looked at together.
EVERY, CHUNK = 64, 1 << 20
#: Bytes of texts in one Arrow batch of results (a longer text is a batch of its own).
BATCH_BYTES = 32 << 20

_UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of UTF-8 that continue a code point.
_INNER = bytes(range(0x80, 0xC0))


class Checkpoints:
    """Sparse index of a text: ``n`` units, and (unit, byte, code point) after every so many of them."""

    __slots__ = ("chars", "n", "places", "text", "units")

    def __init__(self, text: bytes, every: int = EVERY, chunk: int = CHUNK):
        self.text, self.n = text, 0
        self.units, self.places, self.chars = [0], [0], [0]
        raw = np.frombuffer(text, dtype=np.uint8)
        points = 0
        for start in range(0, len(raw), chunk):
            piece = raw[start : start + chunk + 1]  # and the byte after it
            white = _WHITE[piece]
            last = start + len(piece) == len(raw)
            if last:
                white = np.append(white, True)
            size = len(white) - 1
            ends = np.flatnonzero(white[1:] & ~white[:-1]) + 1
            if last and white[size - 1]:
                ends = np.append(ends, size)
            mine = ends[(-self.n - 1) % every :: every]
            if len(mine):
                lead = np.cumsum((piece[:size] & 0xC0) != 0x80)
                self.units += range(self.n + (-self.n - 1) % every + 1, self.n + len(ends) + 1, every)
                self.places += (mine + start).tolist()
                self.chars += (lead[mine - 1] + points).tolist()
                points += int(lead[-1])
            else:
                points += int(np.count_nonzero((piece[:size] & 0xC0) != 0x80))
            self.n += len(ends)
            if last:
                break

    def cut(self, unit: int) -> tuple[int, int]:
        """(byte, code point) after so many units."""
        k = bisect_right(self.units, unit) - 1
        at = self.places[k]
        for _ in range(unit - self.units[k]):
            at = _UNIT.match(self.text, at).end()
        return at, self.chars[k] + len(self.text[self.places[k] : at].translate(None, _INNER))


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The first four 32-bit numbers of the sha256 of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def rearrange(text: bytes, numbers: list[int], rate: int = RATE, suffix_first: int = SUFFIX_FIRST, every: int = EVERY) -> tuple[int, str, int | None, int | None, list[bytes]]:
    """(units, form, code points of the prefix, of the middle, the pieces of the output)."""
    index = Checkpoints(text, every)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not text or p in text or s in text or m in text or numbers[2] % 100 >= rate:
        return index.n, "plain", None, None, [text]
    a, b = sorted(x % (index.n + 1) for x in numbers[:2])
    (at, chars), (to, more) = index.cut(a), index.cut(b)
    prefix, middle, suffix = text[:at], text[at:to], text[to:]
    if numbers[3] % 100 < suffix_first:
        return index.n, "spm", chars, more - chars, [s, suffix, p, prefix, m, middle]
    return index.n, "psm", chars, more - chars, [p, prefix, s, suffix, m, middle]


def _strings(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.binary()).view(pa.string())


def infill(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of docs(doc_id, text).

    ``n`` is the number of units; ``form`` is plain, psm (prefix, suffix, middle) or
    spm (suffix, prefix, middle) and ``output`` the text in that form. ``rate`` per cent
    of the texts are rearranged, ``suffix_first`` per cent of those as spm; both are
    drawn by the id. Null and empty texts are plain, of no unit and empty output; texts
    that hold a sentinel are plain. A null id draws as an empty one. Rows that repeat
    are each returned, rows that share an id draw alike; an empty table gives an
    empty result; extra columns are ignored. A very long text is handled whole: it is
    counted in pieces, and beside it stands its index of one place for ``EVERY`` units."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        for batch in batches:
            texts = batch.column(1).view(pa.binary())
            ids, counts, forms, before, inside, out, size = [], [], [], [], [], [], 0
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                n, form, x, y, pieces = rearrange(texts[k].as_py() or b"", draws(doc_id, seed), rate, suffix_first)
                ids.append(doc_id)
                counts.append(n)
                forms.append(form)
                before.append(x)
                inside.append(y)
                out.append(b"".join(pieces))
                size += len(out[-1])
                if size >= BATCH_BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), _strings(out)], names)
                    ids, counts, forms, before, inside, out, size = [], [], [], [], [], [], 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The exact text from an output and its form, as an expression: sentinels occur where they were put only."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def infill_digests(docs: DataFrame) -> DataFrame:
    """What ``infill`` made, with sha256 of the outputs and of the texts rebuilt from them."""
    made = infill(docs)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


_UNITS_SQL = r"regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')"

#: The same by DuckDB, on the whole table.
SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || doc_id) AS h FROM documents),
  u AS (SELECT *, {_UNITS_SQL} AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
  c AS (SELECT doc_id, t, len(units) AS n, LEAST(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, GREATEST(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b, units,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
  p AS (SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c)
  SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
