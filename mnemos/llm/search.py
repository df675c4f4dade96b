"""Exact top-k search by BM25 with block-max WAND.

The documents are searched in shards of bounded size. A shard has an inverted index of the queries' terms, built from
whole texts: postings by term in document order, and for each term's list the greatest weight in each block of `BLOCK`
documents. Weights use the number of documents, their mean length and the document frequencies of all documents, so
scores do not depend on the shards.

A document can be the pivot of a query only if the bounds of the lists that meet there reach the k-th score so far. Lists
that are rare in the shard are merged, so their share in a document is known exactly; lists that most documents are
in count with their block's maximum. Where the sum stays below the k-th score, the long lists are not read: their cursors
skip to the next part of the shard with a pivot. There the lists are added up; pivots that still can reach the k-th score are scored in
double precision, always in the order of the terms, the most promising `FIRST` at a time. The k-th score goes on from shard to shard of a
task. Documents of a shard are ordered by their heaviest frequent term and length, which makes neighbours alike and the maxima tight.
Only each task's top k leave it, and they are merged exactly.

Queries go to the tasks in groups of bounded size, each with a pass over the documents and a result of its own.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemos.llm.graph import cut
from mnemos.llm.words import LOWER_ALNUM, U, Words, pieces, texts_of

#: BM25's saturation and length weight; results of a query; documents of a block and of a part; pivots scored at a time; queries whose bounds are added up at once.
K1, B, TOP, BLOCK, PART, FIRST, TOGETHER = 1.2, 0.75, 10, 16, 512, 32, 256
#: Bytes of query text in a group; bytes of a shard; bytes whose words are counted at once; a list is long if it has one in so many documents of the shard.
GROUP_BYTES, SHARD_BYTES, FEW_BYTES, LONG = 48 << 20, 24 << 20, 1 << 20, 16
#: What bounds in single precision are widened by.
SLACK = 1e-4


def _postings(texts: list[bytes], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place among the terms, count), sorted, of the given terms, and the texts' lengths in words."""
    wide = max(1, len(terms))
    keys, counts, lengths = [], [], []
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64) // FEW_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # a few at a time stay in the processor's cache
        words = Words(texts[a:b], LOWER_ALNUM)
        distinct, which = np.unique(words.hash, return_inverse=True)
        place = np.searchsorted(terms, distinct).clip(max=wide - 1)
        known = terms[place] == distinct if len(terms) else np.zeros(len(distinct), bool)
        some = known[which]
        key, n = np.unique((words.text_of()[some] + a) * wide + place[which[some]], return_counts=True)
        keys.append(key)
        counts.append(n)
        lengths.append(words.counts)
    key = np.concatenate(keys)
    return key // wide, key % wide, np.concatenate(counts), np.concatenate(lengths)


def _bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of the texts, sorted; the terms' places and counts, text after text; and where each text begins."""
    terms = np.unique(Words(texts, LOWER_ALNUM).hash)
    owner, at, times, _ = _postings(texts, terms)
    return terms, at, times, np.searchsorted(owner, np.arange(len(texts) + 1))


def query_groups(queries: DataFrame, most: int = GROUP_BYTES):
    """Lists of (query_id, text), about `most` bytes each."""
    total = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // most
    for k in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k)
        yield [(r[0], (r[1] or "").encode()) for r in part.select("query_id", "text").collect()]


def statistics(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Document frequency of each term, number of documents and mean length, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        terms = shared.value
        total, rows, length = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for part in pieces(batch):
                _, at, _, n = _postings(texts_of(part), terms)
                total += np.bincount(at, minlength=len(terms))
                rows, length = rows + len(n), length + int(n.sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1, -2]), pa.array(np.r_[total[some], rows, length])], ["i", "c"])

    sums = docs.select("text").mapInArrow(count, "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    i, c = sums["i"].to_numpy(), sums["c"].to_numpy()
    frequency = np.zeros(len(terms), np.int64)
    frequency[i[i >= 0]] = c[i >= 0]
    rows = int(c[i == -1].sum())
    return frequency, rows, max(1.0, float(c[i == -2].sum()) / max(1, rows))


def _runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places first[i] .. last[i] - 1, run after run, and the runs' sizes."""
    size = last - first
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum()), size


class Best:
    """The k best (score, doc_id) that a task has found for a query; a doc_id counts once, with its best score."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0)

    @property
    def least(self) -> float:
        """What a further document must reach."""
        return self.scores[-1] if len(self.ids) == self.k else 1e-6

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.r_[self.ids, ids], np.r_[self.scores, scores]
        ranked = np.lexsort((ids, -scores))
        keep = ranked[np.sort(np.unique(ids[ranked], return_index=True)[1])][: self.k]
        self.ids, self.scores = ids[keep], scores[keep]


class Shard:
    """The inverted index of some documents over the given terms, with weights and block maxima."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], terms: np.ndarray, idf: np.ndarray, mean: float):
        doc, at, n, length = _postings(texts, terms)
        weight = idf[at] * n * (K1 + 1) / (n + K1 * (1 - B + B * length[doc] / mean))
        self.terms = len(terms)
        # By document, for scoring in full: always in the order of the terms.
        self.at, self.weight, self.begin = at, weight, np.searchsorted(doc, np.arange(len(texts) + 1))
        size = np.bincount(at, minlength=len(terms))
        long = np.flatnonzero(size * LONG >= max(1, len(texts)))
        self.long = np.full(len(terms), -1)
        self.long[long] = np.arange(len(long))
        is_long = self.long[at] >= 0
        table = np.zeros((len(texts), len(long)), np.float32)
        table[doc[is_long], self.long[at[is_long]]] = weight[is_long]
        self.own = np.lexsort((length, table.argmax(axis=1))) if len(long) else np.arange(len(texts))
        self.ids = ids[self.own]
        self.table = table[self.own]
        self.blocks = np.maximum.reduceat(self.table, np.arange(0, len(texts), BLOCK)) if len(texts) else table
        # By term, for the lists that are not long.
        rank = np.empty(len(texts), np.int64)
        rank[self.own] = np.arange(len(texts))
        doc, at, weight = rank[doc[~is_long]], at[~is_long], weight[~is_long]
        order = np.argsort(at * max(1, len(texts)) + doc)
        self.list_doc, self.list_weight = doc[order], weight[order]
        self.first = np.searchsorted(at[order], np.arange(len(terms) + 1))

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Scores of documents, rounded to 6 digits. asked: how often the query has each term."""
        own = self.own[docs]
        place, size = _runs(self.begin[own], self.begin[own + 1])
        return np.round(np.bincount(np.repeat(np.arange(len(docs)), size), self.weight[place] * asked[self.at[place]], len(docs)), 6)

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], best: list[Best]) -> None:
        """Adds the shard's results for some queries (terms, counts) to the best ones."""
        n, wide = len(self.ids), 1 + SLACK
        asked_long = np.zeros((self.table.shape[1], len(queries)), np.float32)
        merged = np.zeros((len(queries), n), np.float32)
        for j, (term, times) in enumerate(queries):
            there = self.long[term]
            asked_long[there[there >= 0], j] = times[there >= 0]
            place, size = _runs(self.first[term], self.first[term + 1])
            merged[j] = np.bincount(self.list_doc[place], self.list_weight[place] * np.repeat(times, size), n)
        least = np.array([b.least for b in best])
        pivot = (merged + np.repeat(self.blocks @ asked_long, BLOCK, axis=0)[:n].T) * wide >= least[:, None]
        # The long lists move to the parts of the shard with a pivot only.
        full = np.zeros_like(merged)
        for a in range(0, n, PART):
            which = np.flatnonzero(pivot[:, a : a + PART].any(axis=1))
            full[which, a : a + PART] = (merged[which, a : a + PART] + (self.table[a : a + PART] @ asked_long[:, which]).T) * wide
        pivot &= full >= least[:, None]
        asked = np.zeros(self.terms)
        for j in np.flatnonzero(pivot.any(axis=1)).tolist():
            docs, term = np.flatnonzero(pivot[j]), queries[j][0]
            asked[term] = queries[j][1]
            while len(docs):  # the most promising ones first, until no other can be among the best
                some = np.argpartition(-full[j, docs], FIRST)[:FIRST] if len(docs) > FIRST else np.arange(len(docs))
                best[j].add(self.ids[docs[some]], self.scores(docs[some], asked))
                docs = np.delete(docs, some)
                docs = docs[full[j, docs] >= best[j].least]
            asked[term] = 0


def searched(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, doc_id, score, rank): the k documents with the highest BM25 scores for each query (query_id, text).

    A query is a bag of words: a term counts as often as it stands in it. Scores are rounded to 6 digits before they are compared; equal
    ones go by doc_id. Documents that share no term with a query (or whose score is rounded to 0) aren't its results, so queries
    without terms or matches have no rows. Null texts have no words; documents and queries without ids are left out (the former still
    count in the statistics). Of rows with one doc_id the best counts; a query that stands in several rows is answered for each text,
    and the best k of all its answers stay. Other columns are neither read nor returned; empty tables give no rows.
    """
    found = []
    for group in query_groups(queries.where("query_id is not null"), GROUP_BYTES):
        terms, at, times, first = _bags([t for _, t in group])
        frequency, rows, mean = statistics(docs, terms)
        idf = np.log(1 + (rows - frequency + 0.5) / (frequency + 0.5))
        found.append(_shards(docs, [i for i, _ in group], first, at, times, terms, idf, mean, k))
    out = found[0]
    for more in found[1:]:  # each group's result is written before the next, so that the plan does not grow with the groups
        out = cut(out).unionByName(more)
    best = out.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _shards(docs: DataFrame, ids: list, first: np.ndarray, at: np.ndarray, times: np.ndarray, terms: np.ndarray, idf: np.ndarray, mean: float, k: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), first, at, times, terms, idf))

    def search(batches):
        ids, first, at, times, terms, idf = shared.value
        bags = [(at[a:b], times[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        best = [Best(k) for _ in bags]
        for batch in batches:
            for part in pieces(batch, SHARD_BYTES):
                there = np.asarray(part.column("doc_id").is_valid().to_numpy(zero_copy_only=False), bool)
                own = np.asarray(part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), np.int64)[there]
                shard = Shard(own, [t for t, y in zip(texts_of(part), there, strict=True) if y], terms, idf, mean)
                for i in range(0, len(bags), TOGETHER):
                    shard.search(bags[i : i + TOGETHER], best[i : i + TOGETHER])
        sizes = [len(b.ids) for b in best]
        if sum(sizes):
            columns = np.repeat(ids, sizes), np.concatenate([b.ids for b in best]), np.concatenate([b.scores for b in best])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(search, "query_id long, doc_id long, score double")
