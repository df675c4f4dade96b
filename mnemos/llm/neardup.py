"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: in round i every shingle of a document falls into a hashed bin with a hashed value, and a bin
keeps the least (round, value) it got. Rounds go on until all bins are full; from round `t` on, round
t + j puts every shingle into bin j, so no more than 2t rounds are needed and even tiny sets fill
every bin. Agreement of two sketches is concentrated around the Jaccard similarity.

Banding: `BANDS` bands of `ROWS` bins; documents that agree in a band belong to one family (chains
included). The chance to miss a pair at similarity 0.85 is (1 - 0.85^ROWS)^BANDS, under 4e-6 here.

Verification: documents with the same set are one class beforehand (sizes and SHA-256 digests of the full
sets are equal), and one member stands for it. First every document is compared with its hub, the smallest
document that it agrees with in a band: a hub's documents are cut into blocks of bounded size, the hub's set goes to each, and one task
counts the exact intersections of all full sets in a block, range after range of hashes, and returns at most a spanning forest of the links. Mostly this joins
a family to one component. Families that it leaves in several are compared whole if they fit in a block. In larger ones documents meet on the rarest shingles of their sets: of n shingles so many
that two sets as similar as asked must share one of them. Shingles that stand for the same documents are one group, and only groups with documents of several
components are compared, block by block; so a template that many documents share costs nothing where the rest of them differs. Neither
candidate pairs nor all links of a group become rows. Links are closed to components.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm.graph import components, cut
from mnemos.llm.words import LOWER_SPACES, U, Words, append, mix, packed, pieces, rolled, texts_of, windows

#: Words of a shingle; bins of a band and bands; least similarity in percent; documents and shingles of a block; most rows of ids that are broadcast.
SHINGLE, ROWS, BANDS, PERCENT, BLOCK, BLOCK_SHINGLES, BROADCAST_IDS = 5, 8, 40, 85, 256, 4_000_000, 1_000_000
#: Shingles of a block pair that are met at once, and how many of those that are shared go into one matrix product.
RANGE_SHINGLES, WIDTH = 1 << 18, 4096
#: Least similarity in percent, bins of a band and bands of the deduplication of a corpus; a pair at 0.80 is missed with a chance under 6e-6.
CORPUS_PERCENT, CORPUS_ROWS, CORPUS_BANDS = 80, 6, 40
#: Buckets in which shingles are counted to tell rare ones; any counts give an order that all documents share.
BUCKET_BITS = 20
_FULL = ~U(0)
_GOLD = U(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) of all texts, distinct and sorted; a text of fewer words has its whole sequence as one shingle."""
    words = Words(texts, LOWER_SPACES)
    at = windows(words, SHINGLE)
    owner, h = [words.text_of()[at]], [rolled(words.hash, SHINGLE)[at]]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(words.counts == n)
        owner.append(short)
        h.append(rolled(words.hash, n)[words.first[short]] if len(short) else np.empty(0, U))
    owner, h = np.concatenate(owner), np.concatenate(h)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def similarity_sketch(owner: np.ndarray, h: np.ndarray, n: int, bins: int) -> np.ndarray:
    """n x bins of (round << 32 | value); rows of empty sets stay at the largest value."""
    out = np.full(n * bins, _FULL, U)
    there = np.zeros(n, bool)
    there[owner] = True
    for i in range(2 * bins):
        if not len(h):
            break
        z = mix(h + U((i + 1) * int(_GOLD) & (1 << 64) - 1))
        bin_ = ((z >> U(32)) * U(bins) >> U(32)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(out, owner * bins + bin_, (U(i) << U(32)) | (z & U(0xFFFFFFFF)))
        waiting = np.flatnonzero(there)
        full = (out.reshape(n, bins)[waiting] != _FULL).all(axis=1)
        if full.any():
            there[waiting[full]] = False
            stay = there[owner]
            owner, h = owner[stay], h[stay]
    return out.reshape(n, bins)


def sketched(docs: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, digest, bands): size and SHA-256 of the full set, hashes of the bands (none for an empty set)."""

    def make(batch):
        texts = texts_of(batch)
        owner, h = shingle_sets(texts)
        n = np.bincount(owner, minlength=len(texts))
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        digests = [hashlib.sha256(packed(h[a:b])).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        sketch = similarity_sketch(owner, h, len(texts), rows * bands).reshape(len(texts), bands, rows)
        key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U)), sketch.shape[:2])
        for r in range(rows):
            key = mix(key * _GOLD + sketch[:, :, r])
        size = np.where(n > 0, bands, 0)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(key[n > 0].reshape(-1).view(np.int64)))
        return [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), lists]

    return append(docs.select("doc_id", "text"), make, "n_shingles long, digest binary, bands array<long>").drop("text")


def _shared_shingles(sets: list[np.ndarray]):
    """(set, number of the shingle) by number, and how many numbers: of the shingles that several of the sorted sets have, range after range of hashes."""
    ranges = 1 + sum(map(len, sets)) // RANGE_SHINGLES
    starts = np.array([(i << 64) // ranges for i in range(1, ranges)], U)
    cuts = [np.r_[0, np.searchsorted(s, starts), len(s)] for s in sets]
    for i in range(ranges):
        parts = [s[c[i] : c[i + 1]] for s, c in zip(sets, cuts, strict=True)]
        h = np.concatenate(parts)
        if not len(h):
            continue
        order = np.argsort(h, kind="stable")
        owner, h = np.repeat(np.arange(len(sets)), [len(p) for p in parts])[order], h[order]
        group = np.cumsum(np.r_[False, h[1:] != h[:-1]])
        several = np.bincount(group) > 1
        there = several[group]
        yield owner[there], (np.cumsum(several) - 1)[group[there]], int(several.sum())


def _forest(percent: int):
    """A function from the sets of a block pair to links, a spanning forest of those that hold."""

    def links(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("doc_id").to_numpy(), np.int64)
        sets = [np.frombuffer(x.as_buffer(), U) for x in table.column("shingles")]
        n = np.array([len(s) for s in sets], np.int64)
        common = np.zeros((len(ids), len(ids)))
        for owner, group, size in _shared_shingles(sets):
            for a in range(0, size, WIDTH):
                part = slice(*np.searchsorted(group, (a, a + WIDTH)))
                x = np.zeros((len(ids), min(WIDTH, size - a)), np.float32)
                x[owner[part], group[part] - a] = 1
                common += x @ x.T
        linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        # Documents of one label are joined already, so a link to a label is given once.
        label = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
        seen, out = np.zeros(len(ids), bool), []
        for start in np.argsort(ids):
            if seen[start]:
                continue
            edge = np.flatnonzero(label == label[start]).tolist()
            seen[edge] = True
            while edge:
                x = edge.pop()
                new = np.flatnonzero(linked[x] & ~seen)
                if len(new):
                    out.extend((ids[x], ids[new[i]]) for i in np.unique(label[new], return_index=True)[1])
                    new = np.flatnonzero(np.isin(label, label[new]) & ~seen)
                    seen[new] = True
                    edge.extend(new.tolist())
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return links


def _on_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs joined with rows by doc_id: these go to every task if they are few, else both sides are shuffled."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def _links(docs: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within groups, from rows placed (doc_id, label, blocks: array of struct<group, lo, hi>): a forest of the labels in each of these blocks."""

    def make(batch):
        texts = texts_of(batch)
        owner, h = shingle_sets(texts)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [pa.array([packed(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())]

    sets = append(_on_ids(docs.select("doc_id", "text").where("text is not null"), placed, "inner"), make, "shingles binary").drop("text")
    return sets.select("doc_id", "label", "shingles", F.inline("blocks")).groupBy("group", "lo", "hi").applyInArrow(_forest(percent), "a long, b long")


def _cut_in_blocks(members: DataFrame) -> DataFrame:
    """members (doc_id, group, n_shingles) with `blocks`, how many blocks their group needs, and `block`, theirs."""
    need = members.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    return members.join(need, "group").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))


def _rare(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(doc_id, label, group, n_shingles): of each of the members (doc_id, label) the rarest shingles of its set, as groups.

    Of n shingles the n - ceil(percent n / 100) + 1 that come first by the count of their bucket, and then their hash, are looked at: two sets of at least that
    similarity have one of these in common.
    """
    texts = _on_ids(docs.select("doc_id", "text").where("text is not null"), members, "inner")

    def count(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for part in pieces(batch):
                total += np.bincount((shingle_sets(texts_of(part))[1] >> U(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counts = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << BUCKET_BITS, np.int64)
    table[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def rarest(batches):
        for batch in batches:
            for part in pieces(batch):
                sets = texts_of(part)
                owner, h = shingle_sets(sets)
                order = np.lexsort((h, shared.value[(h >> U(64 - BUCKET_BITS)).astype(np.int64)], owner))
                owner, h = owner[order], h[order]
                n = np.bincount(owner, minlength=len(sets))
                first = np.searchsorted(owner, np.arange(len(sets)))
                keep = np.arange(len(owner)) - first[owner] < (n + 1 + (-percent * n) // 100)[owner]
                of = pa.array(owner[keep])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(of).cast(pa.int64()), part.column("label").take(of).cast(pa.int64()), pa.array(h[keep].view(np.int64)), pa.array(n[owner[keep]])], ["doc_id", "label", "group", "n_shingles"])

    return texts.select("doc_id", "label", "text").mapInArrow(rarest, "doc_id long, label long, group long, n_shingles long")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of `_rare` in groups with several labels; of groups with the same documents one."""
    rows = cut(rows)
    sums = [F.sum(F.xxhash64(F.lit(i), "doc_id").cast("decimal(20,0)")).alias(f"s{i}") for i in (1, 2)]
    several = rows.groupBy("group").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"), *sums).where("least < most")
    one = several.groupBy("n", "s1", "s2").agg(F.min("group").alias("group")).select("group")
    return rows.join(one, "group", "left_semi").select("doc_id", "label", "group", "n_shingles")


def _block_links(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links within groups (doc_id, label, group, n_shingles), every block of a group with every other."""
    place = lambda i: F.struct("group", F.least("block", i).alias("lo"), F.greatest("block", i).alias("hi"))
    blocks = _cut_in_blocks(members).select("doc_id", "label", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), place)).alias("place"))
    return _links(docs, cut(blocks.groupBy("doc_id").agg(F.min("label").alias("label"), F.collect_set("place").alias("blocks"))), percent)


def components_of(docs: DataFrame, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs (doc_id, text).

    Null and empty texts have the empty set and are linked with nothing; texts of fewer than five words
    are one shingle. Equal sets are linked. Rows with the same doc_id count as one document. A row
    without doc_id is linked with nothing: component_id null, kept true.
    """
    sketches = cut(sketched(docs, rows, bands))
    known = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = cut(known.groupBy("n_shingles", "digest").agg(F.min("doc_id").alias("rep")))
    standing = known.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("band"))
    hubs = standing.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("most")).where("hub < most")
    stars = cut(standing.join(hubs, "band").where("doc_id <> hub").select("doc_id", "hub").distinct())
    sizes = classes.select(F.col("rep").alias("doc_id"), "n_shingles")
    part = lambda lo, hi: F.struct("group", F.lit(lo).alias("lo") if isinstance(lo, int) else lo.alias("lo"), hi.alias("hi"))

    nearest = _cut_in_blocks(stars.groupBy("doc_id").agg(F.min("hub").alias("group")).join(sizes, "doc_id"))
    own = nearest.select("doc_id", part(0, F.col("block")).alias("place"))
    of_hub = nearest.groupBy("group").agg(F.max("blocks").alias("blocks")).select(F.col("group").alias("doc_id"), F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: part(0, i))).alias("place"))
    placed = cut(own.unionByName(of_hub).groupBy("doc_id").agg(F.collect_list("place").alias("blocks")).withColumn("label", F.col("doc_id")))
    first = cut(_links(docs, placed, percent))

    families = components(stars.select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))).select(F.col("node").alias("doc_id"), F.col("label").alias("group"))
    joined = components(first).withColumnRenamed("node", "doc_id")
    members = families.join(joined, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    open_ = members.groupBy("group").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("group")
    waiting = cut(_cut_in_blocks(members.join(open_, "group", "left_semi").join(sizes, "doc_id").select("doc_id", "label", "group", "n_shingles")))
    whole = waiting.where("blocks = 1").select("doc_id", "label", F.array(part(0, F.col("block"))).alias("blocks"))
    links = first.unionByName(_links(docs, cut(whole), percent))
    large = waiting.where("blocks > 1").select("doc_id", "label")
    if not large.isEmpty():
        links = links.unionByName(_block_links(docs, _shared(_rare(docs, large, percent)), percent))
    labels = components(links)

    of_class = classes.join(labels, classes["rep"] == labels["node"], "left").select("n_shingles", "digest", F.coalesce("label", "rep").alias("of"))
    return (
        sketches.drop("bands")
        .join(of_class, ["n_shingles", "digest"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("of"))).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def representatives(docs: DataFrame, percent: int = CORPUS_PERCENT, rows: int = CORPUS_ROWS, bands: int = CORPUS_BANDS) -> DataFrame:
    """docs without those that are linked, directly or by others, with a document of smaller doc_id.

    Texts without words and rows without doc_id are linked with nothing and stay; long texts are read whole; rows with one doc_id are one
    document and stay or go together; all columns pass unchanged; an empty table stays empty.
    """
    gone = cut(components_of(docs.select("doc_id", "text"), percent, rows, bands).where("not kept").select("doc_id").distinct())
    return _on_ids(docs, gone, "left_anti").select(*docs.columns)
