"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed mask names the token positions that count and ignores the rest, so a
substituted token on an ignored position leaves the hash alone. Hashes of every
position of the documents are joined with those of the benchmark; each hit gives
a diagonal (where the item would begin in the document). On every diagonal with
a hit, tokens are compared one by one, and a passage counts as leaked if some
window of WINDOW tokens (the whole item, if shorter) agrees in a share of at
least SIMILARITY. Equal texts are looked at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import Workspace, small_side, spread, unused

#: Offsets that count. Whatever tokens are substituted, a window of 11 to 20 tokens that agrees in
#: a share of SIMILARITY holds one of these seeds whole (all substitutions were tried).
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 6, 7, 8), (0, 1, 3, 7, 8, 9), (0, 1, 2, 3, 7, 8))
#: The same for items of SHORTEST to 10 tokens; used only if the benchmark has such. Of shorter
#: items no token may differ, so all of them are the mask.
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 2, 4), (0, 2, 3, 4))
SHORTEST, LONG = 5, 11
#: An item that has one seed at more places than this repeats itself; where it is hit, all diagonals are compared.
MANY_PLACES = 16
#: Seeds of the benchmark are broadcast up to so many bytes, as the other side has a row for every token.
SEED_BYTES = 32 << 20
WINDOW = 20
SIMILARITY = 0.8
#: Tokens are runs of letters and digits, in lower case.
_GAP = r"[^\p{L}\p{N}]+"


def token_hashes(text: Column) -> Column:
    """Hash of every token of a text; an empty array for a null or tokenless one."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _GAP), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, key: str, masks: tuple[tuple[int, ...], ...], hashes: str = "_h") -> DataFrame:
    """(key, _pos, _seed): for every position and mask, the hash of the tokens that count."""
    span = max(m[-1] for m in masks) + 1
    shifted = [F.slice(F.col(hashes), k + 1, F.size(hashes)).alias(f"t{k}") for k in range(span)]
    spans = rows.select(key, F.posexplode(F.arrays_zip(*shifted)).alias("_pos", "_t"))
    each = [F.when(F.col(f"_t.t{m[-1]}").isNotNull(), F.xxhash64(F.lit(len(m) * 100 + i), *[F.col(f"_t.t{k}") for k in m])) for i, m in enumerate(masks)]
    return spans.select(key, "_pos", F.explode(F.array(*each)).alias("_seed")).where("_seed is not null")


def aligned(hashes: str, items: str, diagonal: str) -> Column:
    """Array of 0 and 1: does token i of the item equal token i + diagonal of the document?"""
    before = F.least(F.greatest(-F.col(diagonal), F.lit(0)), F.size(items))
    ahead = F.array_repeat(F.lit(None).cast("long"), before)
    doc = F.concat(ahead, F.slice(hashes, F.greatest(F.col(diagonal), F.lit(0)) + 1, F.size(items) - before))
    return F.zip_with(F.col(items), F.slice(doc, F.lit(1), F.size(items)), lambda t, d: F.when(t == d, 1).otherwise(0))


def best_window(hits: str, length: Column) -> Column:
    """Largest number of agreeing tokens in a window of the given length, by a sum that moves along."""
    leaving = F.slice(F.concat(F.array_repeat(F.lit(0), length), F.col(hits)), F.lit(1), F.size(hits))
    moves = F.zip_with(F.col(hits), leaving, lambda come, go: come - go)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))
    step = lambda acc, x: F.struct((acc["now"] + x).alias("now"), F.greatest(acc["top"], acc["now"] + x).alias("top"))
    return F.aggregate(moves, start, step, lambda acc: acc["top"])


def text_key(text: Column) -> Column:
    """By what texts are told apart: equal texts are looked at once, whatever their ids."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def leaked_texts(docs: DataFrame, benchmark: DataFrame, space: Workspace) -> DataFrame:
    """(_body, item_id, doc_start, n_agree, n_window), one row for each different text with a leaked item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), token_hashes(F.col("text")).alias("_item")).where(F.size("_item") > 0)
    items = space.write(items.select("item_id", "_item", F.xxhash64("_item").alias("_which")).distinct(), "items")
    texts = spread(docs.select(text_key(F.col("text")).alias("_body"), F.col("text").cast("string").alias("text")))
    parts = []
    size = F.size("_item")
    kinds = [("long", size >= LONG, MASKS), ("short", size.between(SHORTEST, LONG - 1), SHORT_MASKS)]
    kinds += [(f"of-{n}", size == n, (tuple(range(n)),)) for n in range(1, SHORTEST)]
    for name, chosen, masks in kinds:
        some = items.where(chosen)
        if some.isEmpty():
            continue
        places = seeds(some.select(F.struct("item_id", "_which").alias("_i"), F.col("_item").alias("_h")), "_i", masks)
        # All places of a seed; null for those of an item that has it over and over.
        at = F.when(F.size("_all") <= MANY_PLACES, F.col("_all")).otherwise(F.array(F.lit(None).cast("int")))
        known = space.write(places.groupBy("_seed", "_i").agg(F.collect_list("_pos").alias("_all")).select("_seed", "_i.item_id", "_i._which", F.explode(at).alias("_at")), f"seeds-{name}")
        found = seeds(texts.select("_body", token_hashes(F.col("text")).alias("_h")), "_body", masks)
        # few positions pass, so the diagonals are small beside the documents
        parts.append(found.join(small_side(known, 40, SEED_BYTES), "_seed").select("_body", "item_id", "_which", (F.col("_pos") - F.col("_at")).alias("_diagonal")))
    if not parts:
        parts.append(texts.limit(0).select("_body", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("long").alias("_which"), F.lit(0).alias("_diagonal")))
    pairs = parts[0]
    for more in parts[1:]:
        pairs = pairs.unionByName(more)
    pairs = space.write(pairs.distinct(), "diagonals")
    bodies = space.write(pairs.select("_body").distinct(), "bodies")
    tokens = texts.join(small_side(bodies, 16), "_body", "left_semi").dropDuplicates(["_body"]).select("_body", token_hashes(F.col("text")).alias("_h"))
    lined = pairs.join(items.select("item_id", "_which", "_item").withColumnRenamed("item_id", "_id"), F.col("item_id").eqNullSafe(F.col("_id")) & (pairs["_which"] == items["_which"])).select("_body", "item_id", "_item", "_diagonal")
    every = F.sequence(1 - F.size("_item"), F.size("_h") - 1)
    diagonals = F.when(F.col("_diagonal").isNull(), every).otherwise(F.array("_diagonal"))
    each = lined.join(tokens, "_body").select("_body", "item_id", "_item", "_h", F.explode(diagonals).alias("_diagonal"))
    compared = each.select("_body", "item_id", "_diagonal", aligned("_h", "_item", "_diagonal").alias("_hits"))
    width = F.least(F.size("_hits"), F.lit(WINDOW))
    scored = compared.select("_body", "item_id", "_diagonal", best_window("_hits", width).alias("_agree"), width.alias("_width"))
    enough = scored.where(F.col("_agree") >= F.ceil(F.col("_width") * F.lit(SIMILARITY) - F.lit(1e-9)))
    best = enough.groupBy("_body", "item_id").agg(F.max(F.struct("_agree", (-F.col("_diagonal")).alias("_back"), "_width")).alias("b"))
    return best.select("_body", "item_id", (-F.col("b._back")).alias("doc_start"), F.col("b._agree").alias("n_agree"), F.col("b._width").alias("n_window"))


def leaks(docs: DataFrame, benchmark: DataFrame, space: Workspace) -> DataFrame:
    """(doc_id, item_id, doc_start, n_agree, n_window) of every leaked benchmark item.

    One row for each document and item: the diagonal with the most agreeing tokens,
    the first of equals; doc_start counts tokens and is negative where the document
    begins inside the item. Items of fewer than SHORTEST tokens leak where all their
    tokens stand in a row, of whatever length the document; items without a token
    never. Null texts have no tokens; a very long text is one array of token
    hashes, its positions are rows. A null doc_id or item_id is carried. Rows that
    share an id are one document (one item): each is compared, the best row is
    returned. Empty tables give an empty result; extra columns are ignored.
    """
    found = space.write(leaked_texts(docs, benchmark, space), "leaked-texts")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("_body"))
    # The copies of a text are a hot key here; the join has partial sums above it only, so AQE splits it.
    best = rows.join(small_side(found, 32), "_body").groupBy("doc_id", "item_id").agg(F.max(F.struct("n_agree", (-F.col("doc_start")).alias("_back"), "n_window")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b._back")).alias("doc_start"), F.col("b.n_agree").alias("n_agree"), F.col("b.n_window").alias("n_window"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, space: Workspace) -> DataFrame:
    """The rows of docs whose text has no leaked item, all columns kept.

    Texts decide, not ids: a clean row stays whatever other row shares its id, and
    rows without an id are like others. Null texts are clean."""
    (name,) = unused(docs, "leaked")
    bad = space.write(leaked_texts(docs, benchmark, space).select(F.col("_body").alias(name)).distinct(), "leaked")
    return docs.join(small_side(bad, 16), text_key(docs["text"]) == F.col(name), "left_anti")
