"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text is built. A text is cut
greedily into longest matches against each automaton; the language whose
automaton needs the fewest phrases, normalised by the logarithm of its training
length, wins. Many texts are parsed in lockstep: one step moves every lane of a
batch one character on, in every automaton at once.
"""

from __future__ import annotations

import math
import random
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import id_hash_mod, release, spread

FOLDS, HELD_OUT = 4, 2
#: The automata are fitted on at most this many documents and characters of each language, whole texts all of them.
SAMPLE_DOCS = 60
SAMPLE_CHARS = 40_000
#: Longer texts are taken for a language without shorter ones only, and then the shortest alone.
SAMPLE_TEXT = 10_000
#: Characters times languages that are parsed at once; a longer text is parsed by itself.
AT_ONCE = 4_000_000
#: Characters of a lane of the lockstep parse.
LANE = 512
UNDETERMINED = "und"
_SPACE, _UNKNOWN = 1, 0


def _kinds() -> np.ndarray:
    """Of every code point: 1 letter, 2 mark, 0 other."""
    first = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    return np.array([1 if c == "L" else 2 if c == "M" else 0 for c in first], dtype=np.uint8)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(unicodedata.normalize("NFC", text).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions by state of the smallest automaton that reads every substring; state 1 is the root, 0 is none."""
    n = len(codes)
    link, length = [0] * (2 * n + 2), [0] * (2 * n + 2)
    step: list[dict[int, int]] = [{}, {}]
    last = 1
    for c in codes:
        cur = len(step)
        step.append({})
        length[cur] = length[last] + 1
        p = last
        while p and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if not p:
            link[cur] = 1
        else:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length[clone], link[clone] = length[p] + 1, link[q]
                while p and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


def double_array(steps: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, target) so that state s goes by class c to target[base[s] + c] where owner[base[s] + c] is s.

    Its size follows the number of transitions, whatever the number of classes: states
    of many transitions take the first of some pseudo-random places that suits, states
    of one fill the gaps."""
    total = sum(map(len, steps))
    size = 3 * total + 2 * width + 16
    base = np.zeros(len(steps), dtype=np.int32)
    owner, target = np.zeros(size + width, dtype=np.int32), np.zeros(size + width, dtype=np.int32)
    taken = bytearray(size)
    dice = random.Random(1)
    for s in sorted((s for s, to in enumerate(steps) if len(to) > 1), key=lambda s: -len(steps[s])):
        classes = list(steps[s])
        while True:
            at = dice.randrange(size - width)
            if not any([taken[at + c] for c in classes]):
                break
        base[s] = at
        for c, to in steps[s].items():
            taken[at + c] = 1
            owner[at + c], target[at + c] = s, to
    single = [s for s, to in enumerate(steps) if len(to) == 1]
    if single:
        c, to = (np.array(x) for x in zip(*[next(iter(steps[s].items())) for s in single], strict=True))
        gaps = np.flatnonzero(np.frombuffer(taken, np.uint8)[width:] == 0)[: len(single)] + width
        base[single] = gaps - c
        owner[gaps], target[gaps] = single, to
    return base, owner, target


class CrossParser:
    """Automata of all languages side by side in one table."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.kinds = kinds = _kinds()
        points = {k: code_points(v) for k, v in samples.items()}
        seen = sorted({int(x) for p in points.values() for x in np.unique(p) if kinds[x]})
        self.classes = np.where(kinds > 0, _UNKNOWN, _SPACE).astype(np.uint16 if len(seen) < 65_000 else np.uint32)
        self.classes[seen] = np.arange(2, 2 + len(seen))
        self.width = 2 + len(seen)
        steps: list[dict[int, int]] = [{}]
        self.roots, self.weight = [], []
        for lang in self.langs:
            codes = self.encode(points[lang])
            at = len(steps) - 1
            own = suffix_automaton([c for c in codes.tolist() if c != _UNKNOWN])
            steps += [{c: to + at for c, to in x.items()} for x in own[1:]]
            self.roots.append(at + 1)
            self.weight.append(math.log2(len(codes) + 2))
        self.base, owner, target = double_array(steps, self.width)
        self.moves = owner.astype(np.int64) << 32 | target  # both in one look
        self.root = np.array(self.roots, dtype=np.int32)
        # Where a phrase ends the next begins at the root; a class that a language has not is a phrase of its own.
        self.again = np.tile(self.root, (self.width, 1))
        self.strange = np.ones(self.again.shape, dtype=bool)
        for k, root in enumerate(self.roots):
            for c, to in steps[root].items():
                self.again[c, k], self.strange[c, k] = to, False

    def encode(self, points: np.ndarray) -> np.ndarray:
        """Classes of the characters; anything but letters is one space."""
        c = self.classes[points]
        if not len(c):
            return c
        space = c == _SPACE
        keep = np.ones(len(c), dtype=bool)
        keep[1:] = ~(space[1:] & space[:-1])
        return c[keep]

    def _step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states, phrases ended) after each lane (row) reads its class, in every language (column)."""
        found = self.moves.take(self.base.take(state) + c[:, None])
        miss = (found >> 32) != state
        to = np.where(miss, self.again[c], found.astype(np.int32))
        ended = (miss & (state != self.root)).view(np.int8) + (miss & self.strange[c]).view(np.int8)
        return to, ended

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (column) against each language (row): greedy longest matches over the whole text.

        Long texts are parsed in lanes at once, each as if a phrase began with it. Then
        each lane is parsed again from the state in which the lane before it ended,
        until the states meet (from there on both parses are the same), and so on
        while an end changes."""
        langs = len(self.langs)
        total = np.zeros((langs, len(coded)), dtype=np.int64)
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        if not langs or not sizes.sum():
            return total
        flat = np.concatenate(coded).astype(np.int32)
        ends = np.cumsum(sizes)
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(len(coded)), lanes)
        number = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = (ends - sizes)[text] + number * LANE
        size = np.minimum(LANE, ends[text] - start)
        order = np.argsort(-size, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        steps = int(size.max())
        # one row for each step of all lanes, the longest lanes first
        read = flat[np.minimum(start[order] + np.arange(steps)[:, None], len(flat) - 1)]
        seen = np.zeros((steps, len(order), langs), dtype=np.int32)
        count = np.zeros((steps, len(order), langs), dtype=np.int8)
        state = np.repeat(self.root[None, :], len(order), axis=0)
        lives = np.searchsorted(-size[order], -np.arange(steps), side="left")
        for t, live in enumerate(lives.tolist()):
            state, count[t, :live] = self._step(state[:live], read[t, :live])
            seen[t, :live] = state
        last = size - 1
        todo = np.flatnonzero(number > 0)
        while len(todo):
            state = seen[last[todo - 1], rank[todo - 1]]
            changed = np.zeros(len(text), dtype=bool)
            live = np.flatnonzero((state != self.root).any(axis=1))
            lane, state, t = todo[live], state[live], 0
            while len(lane):
                at = rank[lane]
                old = seen[t, at]
                state, count[t, at] = self._step(state, read[t, at])
                seen[t, at] = state
                t += 1
                apart = (state != old).any(axis=1)
                out = apart & (size[lane] == t)
                changed[lane[out]] = True
                go = apart & ~out
                lane, state = lane[go], state[go]
            after = np.flatnonzero(changed) + 1
            after = after[after < len(text)]
            todo = after[number[after] > 0]
        ended = count.sum(axis=0, dtype=np.int64)[rank]
        full = np.flatnonzero(sizes > 0)
        first = (np.cumsum(lanes) - lanes)[full]
        total[:, full] = np.add.reduceat(ended, first, axis=0).T
        final = first + lanes[full] - 1
        total[:, full] += (seen[last[final], rank[final]] != self.root).T
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        part: list[str] = []
        size = 0
        for text in texts:
            if part and (size + len(text or "")) * max(1, len(self.langs)) > AT_ONCE:
                out += self._predict(part)
                part, size = [], 0
            part.append(text or "")
            size += len(part[-1])
        return out + self._predict(part)

    def _predict(self, texts: list[str]) -> list[tuple[str, float]]:
        lettered, coded = [], []
        for t in texts:
            points = code_points(t)
            lettered.append(bool(np.any(self.kinds[points] == 1)))
            coded.append(self.encode(points))
        cost = self.phrases(coded) * np.array(self.weight, dtype=float).reshape(-1, 1)
        out = []
        for k, ok in enumerate(lettered):
            if not ok or not self.langs:
                out.append((UNDETERMINED, 0.0))
                continue
            order = np.argsort(cost[:, k], kind="stable")
            best, second = float(cost[order[0], k]), float(cost[order[1], k]) if len(order) > 1 else math.inf
            out.append((self.langs[order[0]], 1.0 if math.isinf(second) else second / (best + second) if best + second else 0.5))
        return out


def _shared(docs: DataFrame, samples: dict[str, str]):
    """The parser, built once and sent to the workers; its size follows the sample's bound and the number of languages."""
    return docs.sparkSession.sparkContext.broadcast(CrossParser(samples))


def training_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, sample_text: int = SAMPLE_TEXT) -> dict[str, str]:
    """Labelled texts of each language outside the held-out fold: at most ``sample_docs``
    documents (lowest hash of doc_id) of together ``sample_chars`` characters at most.

    Texts are taken whole. Those over ``sample_text`` characters are left out, unless a
    language has no other; then the shortest of them is its sample. What reaches the
    driver grows with the number of languages only."""
    able = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_hash_mod("doc_id", FOLDS) != HELD_OUT))
    size = F.length("text") + 1  # and a line feed between texts
    over = F.when(size > min(sample_text, sample_chars), size).otherwise(0)
    order = Window.partitionBy("lang").orderBy("over", "name", "doc_id", "size", "body")
    listed = able.select("doc_id", "lang", size.alias("size"), over.alias("over"), F.xxhash64("doc_id").alias("name"), F.xxhash64("text").alias("body"))
    # Of each language the first few of every task only are sorted together.
    first = listed.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_docs)
    sums = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = first.withColumn("sum", sums).where((F.col("k") == 1) | ((F.col("over") == 0) & (F.col("sum") <= sample_chars)))
    # Of few rows: sample_docs of each language at most.
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("body").alias("_body"), "k"))
    same = (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.xxhash64("text") == F.col("_body"))
    rows = able.join(chosen, same).groupBy("lang", "k").agg(F.min("text").alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.k)):
        out.setdefault(r.lang, []).append(r.text)
    return {lang: "\n".join(texts) for lang, texts in out.items()}


def identify(docs: DataFrame, samples: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs(doc_id, text[, lang]), then ``keep``.

    held_out is true where crc32(doc_id as text) mod 4 is 2 (false for a null id).
    lang_pred is ``und`` with score 0 where the text is null or has no letter, and
    where there is nothing to learn from. Ties go to the first language in
    alphabetic order. Whole texts are parsed, very long ones by themselves in lanes
    that are joined to one parse; a row that repeats is returned again; an empty
    table gives an empty result."""
    shared = _shared(docs, training_samples(docs) if samples is None else samples)
    types = dict(docs.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        parser = shared.value
        for batch in batches:
            found = parser.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64()), *batch.columns[3:]], ["doc_id", "held_out", "lang_pred", "score", *keep])

    held = F.coalesce(id_hash_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("_text"), *keep)
    return spread(rows).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double" + "".join(f", `{c}` {types[c]}" for c in keep))


def of_known_language(docs: DataFrame, samples: dict[str, str] | None = None) -> DataFrame:
    """The rows of docs whose language is determined, with all their columns as they are.

    Rows of null text or without a letter go; every other row stays, repeats included."""
    shared = _shared(docs, training_samples(docs) if samples is None else samples)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        parser = shared.value
        for batch in batches:
            yield batch.filter(pa.array([x != UNDETERMINED for x, _ in parser.predict(batch.column(at).to_pylist())], pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)
