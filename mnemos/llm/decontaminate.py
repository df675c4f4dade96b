"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is `size` consecutive words of a benchmark item (a shorter item is one window). It is the
set of its word shingles, each at a known place. A document that holds the window holds them all, so
with shingles ordered from rare to common (by the number of documents that have them, over all
documents) the rarest one is the whole prefix that must be joined. A document position that has it
fixes where the window would start; windows that would reach over either end of the document are
dropped by length and position, and the rest are verified word for word.

Benchmark items go to the tasks in blocks of bounded size, one pass over the documents each, so a
benchmark of any size can be joined and documents are never shuffled.
"""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm.words import LOWER_ALNUM, U, Words, append, covered, pieces, rolled, sheltered, texts_of, windows

#: Words of a shingle, words of a window, bytes of item text in a block.
SHINGLE, WINDOW, BLOCK_BYTES = 5, 10, 8 << 20


def item_blocks(benchmark: DataFrame, most: int = BLOCK_BYTES):
    """Lists of (item_id, text), each of about `most` bytes; one after the other on the driver."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // most
    for k in range(n):
        part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.select("item_id", "text").collect()]


def item_windows(items: list[tuple], size: int = WINDOW) -> dict[tuple, set]:
    """The items of each distinct window, a tuple of words."""
    found = defaultdict(set)
    for item, text in items:
        if item is None or text is None:
            continue
        w = text.encode().translate(LOWER_ALNUM).split()
        for i in range(max(1, len(w) - size + 1) if w else 0):
            found[tuple(w[i : i + size])].add(item)
    return found


def shingle_hashes(words: tuple, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of a window's shingles in order; a shorter window is one shingle."""
    return rolled(Words([b" ".join(words)], LOWER_ALNUM).hash, min(shingle, len(words)))


def _lengths(grams: dict) -> dict[int, np.ndarray]:
    """Sorted shingle hashes by shingle length."""
    by = defaultdict(set)
    for words, hashes in grams.items():
        by[min(SHINGLE, len(words))].update(hashes.tolist())
    return {n: np.array(sorted(x), U) for n, x in by.items()}


def _lookup(keys: np.ndarray):
    """A function from hashes to the positions of those that are among keys, and their ranks."""
    seen = np.zeros(1 << 20, bool)
    seen[(keys >> U(44)).astype(np.int64)] = True

    def find(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(seen[(h >> U(44)).astype(np.int64)])
        rank = np.searchsorted(keys, h[at]).clip(max=len(keys) - 1)
        good = keys[rank] == h[at]
        return at[good], rank[good]

    return find


def document_frequency(documents: DataFrame, lengths: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """In how many documents each of the given shingles occurs, by (length, hash). Shingles in none are left out."""

    def count(batches):
        total = {n: np.zeros(len(k), np.int64) for n, k in lengths.items()}
        finds = {n: _lookup(k) for n, k in lengths.items()}
        for batch in batches:
            for part in pieces(batch):
                words = Words(texts_of(part), LOWER_ALNUM)
                owner = words.text_of()
                for n, find in finds.items():
                    at, rank = find(rolled(words.hash, n))
                    good = owner[at] == owner[at + n - 1]
                    pairs = np.unique(owner[at[good]] * len(lengths[n]) + rank[good])
                    np.add.at(total[n], pairs % len(lengths[n]), 1)
        for n, c in total.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n)), pa.array(lengths[n][some].view(np.int64)), pa.array(c[some])], ["n", "h", "c"])

    rows = documents.select("text").mapInArrow(count, "n long, h long, c long").groupBy("n", "h").agg(F.sum("c").alias("c")).collect()
    return {(r.n, r.h % (1 << 64)): r.c for r in rows}


def prefixes(grams: dict, frequency: dict) -> dict[tuple[int, int], list[tuple]]:
    """Rarest shingle -> [(window's words, place of the shingle in it)]. Windows with a shingle that no document has are left out."""
    index = defaultdict(list)
    for words, hashes in grams.items():
        n = min(SHINGLE, len(words))
        rare = min((frequency.get((n, h), 0), h, i) for i, h in enumerate(hashes.tolist()))
        if rare[0]:
            index[n, rare[1]].append((words, rare[2]))
    return index


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents with n_words, n_hit, hits (a bit for each word inside an occurrence of a window) and items (sorted distinct ids of items with occurring windows).

    Null or empty text: no words, no hits. Items without text or id are ignored; an empty benchmark hits
    nothing. Repeated documents and items each count as they stand; a window of several items names
    them all. Other columns pass unchanged, but those named n_words, n_hit, hits or items are replaced.
    """
    out = documents.withColumns({"hits": F.lit(None).cast("binary"), "items": F.array().cast("array<string>")})
    for items in item_blocks(benchmark, block_bytes):
        found = item_windows(items, size)
        grams = {w: shingle_hashes(w) for w in found}
        lengths = _lengths(grams)
        index = prefixes(grams, document_frequency(documents, lengths)) if lengths else {}
        keys = {n: np.array(sorted(h for m, h in index if m == n), U) for n in {m for m, _ in index}}
        plan = {n: [[(i, b" ".join(w), len(w), [str(x) for x in found[w]]) for w, i in index[n, h]] for h in k.tolist()] for n, k in keys.items()}
        out = _marked(out, keys, plan)
    return out


def _marked(df: DataFrame, keys: dict, plan: dict) -> DataFrame:
    def mark(batch: pa.RecordBatch) -> list:
        words = Words(texts_of(batch), LOWER_ALNUM)
        owner, count = words.text_of(), words.counts
        starts, sizes, names = defaultdict(list), defaultdict(list), defaultdict(set)
        for n, k in keys.items():
            at, rank = _lookup(k)(rolled(words.hash, n))
            for p, r in zip(at.tolist(), rank.tolist(), strict=True):
                t = owner[p]
                for i, text, length, items in plan[n][r]:
                    s = p - i
                    if s < words.first[t] or s + length > words.first[t + 1]:
                        continue
                    raw = words.bytes[words.start[s] : words.end[s + length - 1]]
                    if raw == text or raw.split() == text.split():
                        starts[t].append(s - words.first[t])
                        sizes[t].append(length)
                        names[t].update(items)
        hits, items, n_hit = [], [], []
        for t, (old, had) in enumerate(zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)):
            on = np.zeros(count[t], bool) if old is None else np.unpackbits(np.frombuffer(old, np.uint8), count=count[t]).astype(bool)
            for length in set(sizes.get(t, ())):
                on |= covered(np.array([s for s, m in zip(starts[t], sizes[t], strict=True) if m == length]), length, count[t])
            n_hit.append(int(on.sum()))
            hits.append(np.packbits(on).tobytes() if n_hit[-1] else None)
            items.append(sorted({*had, *names.get(t, ())}))
        return [pa.array(count, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))]

    return append(df, mark, "n_words long, n_hit long, hits binary, items array<string>", ("hits", "items"))


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no window of an item occurs in, with their own columns, whatever their names are.

    Documents without words stay, and so do all if the benchmark is empty; long texts are read whole; repeated rows stay or go together.
    """
    plain, own = sheltered(documents, ("text",))
    return own(contamination(plain, benchmark).where(F.col("hits").isNull()).select(*plain.columns))


def digest(marked: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
