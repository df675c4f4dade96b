"""Substring deduplication by level-wise doubling of repeated word windows.

Level 1 looks at short windows, level 2 at windows of about twice that length, and so on to the
length asked for. A window is a candidate at a level only if the windows of the level before that it
contains are repeated, so only what is repeated at one length is extended to the next; the loop ends
when no candidates survive or the length is reached. (A window of 13 is reached from 7: two windows
of 7 that overlap in a word.) At the first level not all windows are compared: among the short
windows inside each window of the next length only the one with the least hash is, which equal longer
windows have in common, so nothing is lost and three quarters of the rows are not shuffled.

At each level a task first merges the windows of all documents it sees. A window that it saw in
several documents is known to be repeated, and only its smallest doc_id still has to be compared with
other tasks, so a passage that a third of all documents share brings one row per task and batch.
Windows are compared by 64 bits of hash on the way and by 96 bits at the last level.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemos.llm.words import SPACES, U, Words, append, covered, mix, packed, pieces, rolled, sheltered, sliding_min, texts_of, unpacked, windows

#: Words of a window; most windows that a task merges at a time.
WINDOW, MERGE = 13, 4_000_000
_ONE = U(0x2545F4914F6CDD1D)


def levels(window: int = WINDOW, first: int | None = None) -> list[int]:
    """Window lengths, each at most twice the one before: [7, 13] for 13, [7, 13, 25, 50] for 50."""
    out = [window]
    while out[0] > (first or 7):
        out.insert(0, (out[0] + 1) // 2)
    return out


def _level_hashes(words: Words, short: int, long: int) -> np.ndarray:
    """For each place, the least hash of the windows of `short` words inside the window of `long` words there."""
    return sliding_min(rolled(words.hash, short), long - short + 1) if len(words) >= long else np.empty(0, U)


def _merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray, first: bool):
    """Rows of a batch for the comparison with other tasks.

    Gives (kind, doc, a, b) arrays of what must be looked up, then (doc, a) of what is known already.
    Kind 1 at the first level: seen in several documents; else kind 0, with the smallest doc.
    """
    order = np.lexsort((doc, b, a))
    doc, a, b = doc[order], a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    least = doc[start]
    several = doc[np.append(start[1:], len(doc)) - 1] != least if len(start) else np.empty(0, bool)
    known = several[group] if first else doc != least[group]
    known &= np.concatenate(([True], (doc[1:] != doc[:-1]) | new[1:])) if len(doc) else True
    return (several.astype(np.int8) if first else np.zeros(len(start), np.int8), least, a[start], b[start]), (doc[known], a[known])


def _rows(found, kind_known: int = 2):
    """Record batches of merged windows: key columns k and j, doc, kind, and a document's known windows packed in one row."""
    (kind, doc, a, b), (kdoc, ka) = found
    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(doc, pa.int64()), pa.array(kind, pa.int8()), pa.nulls(len(doc), pa.binary())], ["k", "j", "doc", "kind", "known"])
    if len(kdoc):
        order = np.argsort(kdoc, kind="stable")
        kdoc, ka = kdoc[order], ka[order]
        start = np.flatnonzero(np.r_[True, kdoc[1:] != kdoc[:-1]])
        end = np.append(start[1:], len(kdoc))
        ids = kdoc[start]
        key = mix(ids.view(U) * _ONE)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids, pa.int64()), pa.array(ids, pa.int64()), pa.array(np.full(len(ids), kind_known, np.int8)), pa.array([packed(ka[s:e]) for s, e in zip(start, end, strict=True)], pa.binary())], ["k", "j", "doc", "kind", "known"])


_ROW = "k long, j long, doc long, kind byte, known binary"


def _collected(batches, hashes, first: bool):
    """Rows of all batches of a task; hashes(part) gives (doc, a, b) of its candidate windows."""
    have, n = [], 0
    for batch in batches:
        for part in pieces(batch):
            got = hashes(part)
            have.append(got)
            n += len(got[0])
            if n >= MERGE:
                yield from _rows(_merged(*(np.concatenate(x) for x in zip(*have, strict=True)), first))
                have, n = [], 0
    if have:
        yield from _rows(_merged(*(np.concatenate(x) for x in zip(*have, strict=True)), first))


def _ids(batch: pa.RecordBatch, words: Words, at: np.ndarray):
    """The doc_id of each place and whether there is one."""
    column = batch.column("doc_id")
    ids = np.asarray(column.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    there = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)
    owner = words.text_of()[at]
    return ids[owner], there[owner], owner


def _first_level(docs: DataFrame, short: int, long: int) -> DataFrame:
    def hashes(batch):
        words = Words(texts_of(batch), SPACES)
        at = windows(words, long)
        doc, there, _ = _ids(batch, words, at)
        a = _level_hashes(words, short, long)[at]
        pairs = np.unique(np.rec.fromarrays([doc[there], a[there]], names="d,a"))
        return pairs.d.copy(), pairs.a.copy(), pairs.d.view(U) * U(0)

    rows = docs.select("doc_id", "text").mapInArrow(lambda b: _collected(b, hashes, True), _ROW)
    w = Window.partitionBy("k", "j")
    return (
        rows.withColumns({"least": F.min("doc").over(w), "most": F.max("doc").over(w), "several": F.max(F.col("kind") == 1).over(w)})
        .where("kind = 2 or kind = 0 and (least < most or several)")
        .select("doc", F.when(F.col("kind") == 0, F.col("k")).alias("h"), "known")
    )


def _next_level(found: DataFrame, docs: DataFrame, short: int, length: int, longer: int | None) -> DataFrame:
    """Windows of `length` all of whose compared windows of `short` words are repeated: those that start in a smaller document too.

    longer: the next length, if this level isn't the last: then, as at the first level, all repeated windows stay.
    """

    def hashes(batch):
        words = Words(texts_of(batch), SPACES)
        at = windows(words, longer or length)
        lists = batch.column("hs").to_pylist(), batch.column("ks").to_pylist()
        good = np.unique(np.concatenate([np.empty(0, U), *(np.array(x, np.int64).view(U) for x in lists[0] if x), *(unpacked(x) for x in lists[1] if x)]))
        least = _level_hashes(words, short, length)
        alive = np.isin(least, good)
        if longer:
            own = np.where(alive, rolled(words.hash, length), ~U(0))
            a = sliding_min(own, longer - length + 1)
            dead = sliding_min(alive.astype(np.int8), longer - length + 1) == 0
            at = at[~dead[at]]
            a = a[at]
            b = a * U(0)
        else:
            at = at[alive[at]]
            a, b = rolled(words.hash, length)[at], rolled(words.hash, length, _ONE)[at] >> U(32)
        doc, there, _ = _ids(batch, words, at)
        return doc[there], a[there], b[there]

    # All columns go in, so that this join and the last one can share one exchange of the texts.
    rows = _with(docs, found).mapInArrow(lambda b: _collected(b, hashes, bool(longer)), _ROW)
    w = Window.partitionBy("k", "j")
    if longer:
        marked = rows.withColumns({"least": F.min("doc").over(w), "most": F.max("doc").over(w), "several": F.max(F.col("kind") == 1).over(w)}).where("kind = 2 or kind = 0 and (least < most or several)")
    else:
        marked = rows.withColumn("least", F.min("doc").over(w)).where("kind = 2 or least < doc")
    return marked.select("doc", F.when(F.col("kind") == 0, F.col("k")).alias("h"), "known")


def _with(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the windows found in them; sorted within partitions, so that a task that runs again sees the same batches."""
    per = found.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("h").alias("hs"), F.collect_list("known").alias("ks"))
    return docs.join(per, docs["doc_id"] == per["_doc"], "left").drop("_doc").sortWithinPartitions("doc_id", F.length("text"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, first: int | None = None) -> DataFrame:
    """(doc, h, known): hashes of windows of doc that start in a document with a smaller doc_id too, one in h or several packed in known."""
    steps = levels(window, first)
    if len(steps) == 1:
        steps = [max(1, window // 2), window]
    found = _first_level(docs, steps[0], steps[1])
    for i in range(1, len(steps)):
        found = _next_level(found, docs, steps[i - 1], steps[i], steps[i + 1] if i + 1 < len(steps) else None)
    return found


def deduplicated(docs: DataFrame, window: int = WINDOW, first: int | None = None) -> DataFrame:
    """docs with n_words, n_removed, kept_text and kept_sha256.

    A word goes if a window of `window` words around it also starts in a document with a smaller doc_id;
    windows are judged on the texts as they come in. kept_text is the text itself if no word goes, else
    the kept words joined by one space. Null and empty texts have no words (kept_text null or as it is); texts
    shorter than a window lose nothing; repeats within one document, or in rows with the same doc_id, count
    for nothing; a row without doc_id is neither compared nor changed. Rows and other columns stay, whatever their names
    are, but columns with these four names are replaced. An empty table stays empty.
    """
    names = "n_words long, n_removed long, kept_text string, kept_sha256 string, hs int, ks int"

    def cut(batch):
        words = Words(texts_of(batch), SPACES)
        at = windows(words, window)
        own = rolled(words.hash, window)[at]
        owner = words.text_of()[at]
        keys = [np.concatenate([np.array(h or (), np.int64).view(U), unpacked(k)]) for h, k in zip(batch.column("hs").to_pylist(), batch.column("ks").to_pylist(), strict=True)]
        salt = mix(np.arange(len(keys), dtype=U) * _ONE)
        gone_keys = np.concatenate([np.empty(0, U), *(k ^ s for k, s in zip(keys, salt, strict=True))])
        gone = covered(at[np.isin(own ^ salt[owner], gone_keys)], window, len(words))
        removed, texts, digests = [], [], []
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            a, b = words.first[i], words.first[i + 1]
            g = gone[a:b]
            removed.append(int(g.sum()))
            kept = [words.word(p) for p in (np.flatnonzero(~g) + a).tolist()] if removed[-1] else words.bytes[words.start[a] : words.end[b - 1]].split() if b > a else []
            joined = b" ".join(kept)
            digests.append(hashlib.sha256(joined).hexdigest())
            texts.append(joined if removed[-1] else text)
        none = pa.nulls(len(texts), pa.int32())
        return [pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests, pa.string()), none, none]

    plain, own = sheltered(docs.select(*(c for c in docs.columns if c.lower() not in {"n_words", "n_removed", "kept_text", "kept_sha256"})))
    return own(append(_with(plain, repeated_windows(plain, window, first)), cut, names, ("doc_id", "hs", "ks")).drop("hs", "ks"))
