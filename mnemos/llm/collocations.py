"""Collocations: phrases that occur together more often than their parts would have them, found level by level.

A pass over the texts counts the phrases of k words, but only those whose first and last k - 1 words are both frequent: these are
known from a bit table of the frequent phrases of the level before, of one size whatever the corpus, that is broadcast. A phrase that the
table lets through by mistake is counted and then left out like any rare one, so tables of levels are exact. Cuts are scored by joins with them.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemos.functions.shared import spilled
from mnemos.llm.graph import cut
from mnemos.llm.words import U, Words, mix, pieces, rolled, texts_of

#: Words of the longest phrase; least occurrences; hundredths of a phrase's occurrences within a longer one from which on it is dropped; rows of each language.
LONGEST, LEAST, WITHIN, TOP = 3, 10, 50, 2000
#: Bits of the table of frequent phrases; parts that a language is dealt to before its best rows meet.
BITS, PARTS = 1 << 27, 256
#: Bytes that end a piece; white space, pieces' ends and A-Z in the byte table.
ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(32 if b in ENDS or b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = np.isin(np.arange(256), list(ENDS))
#: Bytes of texts that a task counts at a time.
PART = 1 << 20


def _gathered(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of slices one after another, and where each begins and the last ends."""
    at = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(at[-1], dtype=np.int32 if max(at[-1], len(raw)) < 1 << 31 else np.int64)
    place += np.repeat((start - at[:-1]).astype(place.dtype), size)
    return raw[place], at


def _language_hash(names: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(n, digest_size=8).digest(), "little") for n in names], U)


class Pieces:
    """The words of several texts with their languages: hashes, the piece that each word stands in, and phrases as bytes."""

    def __init__(self, texts: list[bytes], languages: list[bytes]):
        self.words = w = Words(texts, TABLE)
        whole = np.frombuffer(b"\n".join(texts), np.uint8)
        self.piece = np.cumsum(_END[whole])[w.start] if len(w) else np.empty(0, np.int64)
        self.names, self.language = np.unique(np.array(languages, object), return_inverse=True) if languages else (np.empty(0, object), np.empty(0, np.int64))
        self.owner = self.language[w.text_of()]
        self.salt = _language_hash(list(self.names))[self.owner] if len(w) else np.empty(0, U)
        # All words with one space after each, so that a phrase is one slice whatever stood between its words.
        spaced, self.at = _gathered(np.append(np.frombuffer(w.bytes, np.uint8), np.uint8(32)), w.start, w.end - w.start + 1)
        if len(w):
            spaced[self.at[1:] - 1] = 32
        self.spaced = spaced

    def starts(self, k: int) -> np.ndarray:
        """The words at which a phrase of k words starts within its piece."""
        n = len(self.words) - k + 1
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1 :]) if n > 0 else np.empty(0, np.int64)

    def hashes(self, k: int) -> np.ndarray:
        """Hashes of the k words from each word on, and the language."""
        return mix(rolled(self.words.hash, k) ^ self.salt[: max(0, len(self.words) - k + 1)])

    def phrases(self, start: np.ndarray, k: int) -> pa.Array:
        raw, at = _gathered(self.spaced, self.at[start], self.at[start + k] - 1 - self.at[start])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])


def _binary(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return texts_of(batch, column)


def _counted(docs: DataFrame, k: int, bits) -> DataFrame:
    """(lang, phrase, n) of the phrases of k words, not summed up yet; with bits, of those whose two parts of k - 1 words are in the table."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, PART):
                found = Pieces(texts_of(part), _binary(part, "lang"))
                start = found.starts(k)
                if k > 1:
                    place = found.hashes(k - 1) % U(BITS)
                    known = (bits.value[(place >> U(3)).astype(np.int64)] >> (place & U(7)).astype(np.uint8)) & 1
                    start = start[(known[start] & known[start + 1]) > 0]
                owner = found.owner[start]
                for i, name in enumerate(found.names):
                    counts = found.phrases(start[owner == i], k).value_counts()
                    if len(counts):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(counts), pa.binary()).cast(pa.string()), counts.field("values").cast(pa.large_string()).cast(pa.string()), counts.field("counts")], ["lang", "phrase", "n"])

    return docs.mapInArrow(run, "lang string, phrase string, n long")


def _bit_table(level: DataFrame, k: int) -> np.ndarray:
    """A bit for the hash of each phrase of a level, in BITS / 8 bytes; the driver gets at most BITS / 64 numbers."""

    def run(batches):
        for batch in batches:
            found = Pieces([x + b"\n" for x in _binary(batch, "phrase")], _binary(batch, "lang"))
            place = np.unique(found.hashes(k)[found.words.first[:-1]] % U(BITS)) if batch.num_rows else np.empty(0, U)
            yield pa.RecordBatch.from_arrays([pa.array((place >> U(6)).astype(np.int64)), pa.array((U(1) << (place & U(63))).view(np.int64))], ["at", "bit"])

    rows = level.select("lang", "phrase").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def levels(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, f) of the phrases of 1, 2, ... words with at least `least` occurrences, and (lang, n): all words of each language."""
    texts = docs.select("text", F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"))
    out, total, bits = [], None, None
    for k in range(1, longest + 1):
        summed = _counted(texts, k, bits).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if k == 1:
            summed = spilled(summed)
            total = cut(summed.groupBy("lang").agg(F.sum("f").alias("n")))
        level = spilled(summed.where(F.col("f") >= least)) if k > 1 else summed.where(F.col("f") >= least)
        out.append(level)
        if k < longest:
            bits = docs.sparkSession.sparkContext.broadcast(_bit_table(level, k))
    return out, total


def _words(first: int, n: int) -> Column:
    return F.array_join(F.slice("_w", first, n), " ")


def cuts(level: DataFrame, k: int, tables: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of a level's phrases of k words: the cut with the lowest score, the earliest of equals. score: millionths of a squared over l r, rounded down."""
    rows = level.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("_w"))
    for i in range(1, k):
        for name, part, table in ((f"_l{i}", _words(1, i), tables[i - 1]), (f"_r{i}", _words(i + 1, k), tables[k - i - 1])):
            known = table.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias(name))
            rows = rows.withColumn("_part", part).join(known, (F.col("lang") == F.col("_lang")) & (F.col("_part") == F.col("_phrase"))).drop("_lang", "_phrase", "_part")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = lambda i: F.call_function("div", (wide("a") * wide("a")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), wide(f"_l{i}") * wide(f"_r{i}"))
    best = F.array_min(F.array(*(F.struct(score(i).cast("long").alias("score"), F.lit(i).alias("k"), F.col(f"_l{i}").alias("l"), F.col(f"_r{i}").alias("r")) for i in range(1, k))))
    return rows.withColumn("_best", best).select("lang", "phrase", "a", "_best.l", "_best.r", "_best.score")


def inner_counts(tables: list[DataFrame]) -> DataFrame:
    """(lang, phrase, most): of each phrase of two or more words inside a longer one of the tables, the most occurrences of such a one."""
    parts = []
    for k in range(3, len(tables) + 1):
        shorter = F.array_distinct(F.array(*(_words(i, size) for size in range(2, k) for i in range(1, k - size + 2))))
        parts.append(tables[k - 1].withColumn("_w", F.split("phrase", " ")).select("lang", F.explode(shorter).alias("phrase"), "f"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, within: int = WITHIN, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language of docs (lang, text), by score, then a, then phrase.

    Null and empty texts have no words, and a null language is `und`; long texts are read whole; repeated rows count each; ties in all of score and a go by the
    phrase's bytes; other columns aren't read, whatever their names are. No documents, or no frequent phrases: no rows. The products of counts
    may have up to 38 digits.
    """
    tables, total = levels(docs, longest, least)
    found = cuts(tables[1], 2, tables)
    for k in range(3, longest + 1):
        found = found.unionByName(cuts(tables[k - 1], k, tables))
    if longest > 2:
        found = found.join(inner_counts(tables), ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * within)).drop("most")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top).drop("_part")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
