"""Quality classifier by compression.

Two zstandard dictionaries are built from good and from bad labelled texts: from every text the same number of
pieces, as far as it has them, drawn by hash from the whole of it. A whole text is compressed
block by block with each; the difference of the two sizes as a share of their sum says which kind of
text it is more like, and a logistic curve fitted on labelled texts that the dictionaries have not
seen turns it into a probability. For the curve, dictionaries are made of either half of the labelled texts and each
half is compared by the other's; texts are scored by dictionaries of all labelled texts.
"""

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemos.llm.graph import cut
from mnemos.llm.words import U, append, mix, pieces, texts_of

#: Labelled rows of each class that the classifier is fitted on at most, bytes of a piece in a dictionary, bytes of a dictionary for each text of its class, bytes of a block, zstandard level.
SAMPLE, PIECE, SHARE, BLOCK, LEVEL = 4000, 200, 1000, 1024, 3
#: Least number of labelled rows of each class to fit on; with fewer the score is 0.5 for every text. Penalty of the curve's slope, which only tells with few rows.
LEAST, RIDGE = 4, 0.1


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def labelled_sample(labels: DataFrame, column: str = "quality", most: int = SAMPLE) -> DataFrame:
    """(doc_id, _label, _half): at most `most` ids of each label 0 and 1, chosen by a hash, in two halves."""
    given = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (remainder(F.col("doc_id"), 3) != 1)).groupBy("doc_id").agg(F.max(column).cast("int").alias("_label"))
    parts = [given.where(F.col("_label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    place = F.row_number().over(Window.partitionBy("_label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return parts[0].unionByName(parts[1]).withColumn("_half", (place - 1) % 2)


def drawn(text: bytes, seed: int) -> list[tuple[int, int, bytes]]:
    """Hashes, places and pieces of a whole text, in the order of their hashes."""
    n = -(-len(text) // PIECE)
    h = mix(np.arange(n, dtype=U) + mix(np.array([seed % (1 << 64)], U)))
    return [(int(h[i]) >> 1, int(i), text[i * PIECE : (i + 1) * PIECE]) for i in np.argsort(h)]


def _dictionary(ranked: list[tuple[int, int, int, int, bytes]], size: int) -> bytes:
    """Of (rank in the text, hash, text, place, piece) the first that there is room for: all texts' first ones, then their second ones, and so on; neighbours are joined again."""
    chosen, n = [], 0
    for _, _, text, i, piece in sorted(ranked):
        n += len(piece) + 1
        if n > size:
            break
        chosen.append((text, i, piece))
    chosen.sort()
    return b"".join(p if k and chosen[k - 1][:2] == (text, i - 1) else b"\n" + p for k, (text, i, p) in enumerate(chosen)) or b" "


def _compressors(good: bytes, bad: bytes) -> tuple:
    out = []
    for content in (good, bad):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
    return tuple(out)


def difference(text: bytes, compressors: tuple) -> float:
    """(bad - good) / (bad + good) of the compressed sizes of the whole text; positive: more like good texts. 0 for an empty text."""
    sizes = [0, 0]
    for a in range(0, len(text), BLOCK):
        for i, c in enumerate(compressors):
            sizes[i] += len(c.compress(text[a : a + BLOCK])) - 2
    return (sizes[1] - sizes[0]) / max(1, sum(sizes))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, the slope of standardised differences with a ridge."""
    scale = max(1e-9, float(x.std()))
    z, w = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([RIDGE, 1e-9])
        w = w + np.linalg.solve(h, z.T @ (y - p) - np.array([RIDGE, 0]) * w)
    return float(w[0] / scale), float(w[1])


NEUTRAL = {"good": b" ", "bad": b" ", "slope": 0.0, "intercept": 0.0}


def _curve(good: bytes, bad: bytes, x: np.ndarray, y: np.ndarray, prior: float | None) -> dict:
    slope, intercept = _logistic(x, y)
    if prior is not None and 0 < prior < 1:
        had = float(y.mean())
        intercept += math.log(prior / (1 - prior)) - math.log(had / (1 - had))
    return {"good": good, "bad": bad, "slope": slope, "intercept": intercept}


def fitted(sample: list[tuple[bytes, int]], prior: float | None = None) -> dict:
    """The model of texts and labels that are at hand. prior: the share of label 1, if the sample's is not it."""
    by = {k: [t for t, y in sample if y == k and t.strip()] for k in (0, 1)}
    if min(map(len, by.values())) < LEAST:
        return NEUTRAL

    def of(texts: list[bytes]) -> bytes:
        return _dictionary([(r, h, s, i, p) for s, t in enumerate(texts) for r, (h, i, p) in enumerate(drawn(t, s))], SHARE * len(texts))

    pairs = [[of(by[k][half::2]) for k in (1, 0)] for half in (0, 1)]
    compressors = [_compressors(*x) for x in pairs]
    found = [(difference(t, compressors[1 - half]), float(k)) for half in (0, 1) for k in (0, 1) for t in by[k][half::2]]
    return _curve(*(of(by[k]) for k in (1, 0)), np.array([x for x, _ in found]), np.array([y for _, y in found]), prior)


def scored(documents: DataFrame, model: dict) -> DataFrame:
    """documents with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5).

    A null or empty text has no difference of sizes: its score is the curve's value at 0. Long texts are compressed
    whole; repeated rows are scored each; columns named score or predicted are replaced, others stay.
    """

    def make(batch):
        compressors = _compressors(model["good"], model["bad"])
        x = np.array([difference(t, compressors) for t in texts_of(batch)])
        p = 1 / (1 + np.exp(-np.clip(model["slope"] * x + model["intercept"], -500, 500)))
        return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

    return append(documents, make, "score double, predicted int")


def trained(documents: DataFrame, labels: DataFrame, column: str = "quality") -> dict:
    """The model of the labelled rows whose crc32(doc_id) mod 3 isn't 1; the share of label 1 comes from all of them.

    Whole texts are used: pieces are drawn from them, and differences are computed, where the texts are. Only the chosen
    ids meet the documents, so texts are not shuffled.
    """
    given = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (remainder(F.col("doc_id"), 3) != 1))
    prior = given.agg(F.avg(column)).first()[0]
    chosen = documents.select("doc_id", "text").join(F.broadcast(labelled_sample(labels, column)), "doc_id")
    texts = cut(chosen.select("text", F.xxhash64("doc_id").alias("_seed"), "_label", "_half"))
    sizes = {(r["_half"], r["_label"]): r["n"] for r in texts.where(F.col("text").rlike(r"[^\x09-\x0D\x20]")).groupBy("_half", "_label").agg(F.count("*").alias("n")).collect()}

    def draw(batches):
        for batch in batches:
            for part in pieces(batch):
                found = [
                    (half, y, r, h, seed, i, p)
                    for t, seed, y, half in zip(texts_of(part), *(part.column(c).to_pylist() for c in ("_seed", "_label", "_half")), strict=True)
                    if t.strip()
                    for r, (h, i, p) in enumerate(drawn(t, seed))
                ]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["half", "y", "r", "h", "s", "i", "p"])

    found = texts.mapInArrow(draw, "half int, y int, r int, h long, s long, i int, p binary")

    def dictionary(label: int, halves: tuple) -> bytes:
        size = SHARE * sum(sizes.get((half, label), 0) for half in halves)
        first = found.where((F.col("y") == label) & F.col("half").isin(*halves)).orderBy("r", "h", "s", "i", "p").limit(2 * size // PIECE + 2)
        return _dictionary([(x.r, x.h, x.s, x.i, bytes(x.p)) for x in first.collect()], size)

    if any(not sizes.get((half, label)) for half in (0, 1) for label in (0, 1)):
        return NEUTRAL
    pairs = [[dictionary(k, (half,)) for k in (1, 0)] for half in (0, 1)]

    def differences(batches):
        compressors = [_compressors(*x) for x in pairs]
        for batch in batches:
            for part in pieces(batch):
                some = [(y, difference(t, compressors[1 - half])) for t, y, half in zip(texts_of(part), *(part.column(c).to_pylist() for c in ("_label", "_half")), strict=True) if t.strip()]
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in some], pa.int32()), pa.array([x for _, x in some], pa.float64())], ["y", "x"])

    rows = sorted(texts.mapInArrow(differences, "y int, x double").collect())
    y, x = np.array([float(r.y) for r in rows]), np.array([r.x for r in rows])
    if min((y == 0).sum(), (y == 1).sum()) < LEAST:
        return NEUTRAL
    return _curve(*(dictionary(k, (0, 1)) for k in (1, 0)), x, y, prior)
