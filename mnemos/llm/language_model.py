"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants stand in three levels. A context of two words, the word before and a class of the one before that (one of
65,536, by a hash), has a restaurant whose parent is that of the word before alone, and all of these share one parent, the words
without context, over a uniform base with one place for unseen words. The end of a text is a word; it also stands twice
before the first one. A word before that is so frequent that its restaurant would not fit in a task (`PER_BUCKET`) has several,
each for a part of the classes. Every training token is a customer, so what is gathered grows with the corpus.

Seating is sampled by Gibbs sweeps. Customers first sit down one after another. Then in each round one customer of every dish, drawn at
random, is unseated - whether a table falls free depends on customers and tables of the dish, the sizes of its tables are summed out by
generalised Stirling numbers - and seated again given all others and the parent. Customers that tables send to the parent or take
back follow in the same round. After `BURN` sweeps the predictive probabilities of `SAMPLES` sweeps are averaged. Random numbers
are hashes of the dish and the round, so a score depends on the texts alone and not on partitions or on tasks that run again.

Plan: (1) words are counted, for the corpus size and the frequent words. (2) Tasks cut their texts to chunks, count each
chunk's context-word triples, and deal them by context to buckets of about `PER_BUCKET` tokens, packed, one row for a chunk and bucket. A bucket seats
its restaurants over its own word frequencies and passes the tables of each word on. (3) These are summed by word, the root is seated, and
buckets get the words' probabilities and counts back. (4) Buckets sample again over these, score the triples, and
give each chunk's texts their sums, which are added up by chunk and place; a row of each chunk says which texts these are.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemos.llm.graph import cut
from mnemos.llm.words import LOWER_SPACES, U, Words, mix, pieces, texts_of

#: Tokens of a bucket and of a chunk; burn-in sweeps, averaged sweeps and rounds of a sweep; strength of all restaurants; seed.
PER_BUCKET, CHUNK, BURN, SAMPLES, ROUNDS, STRENGTH, SEED = 2_000_000, 2_000_000, 2, 3, 2, 1.0, 7
#: Bytes of all texts that a bucket has at least one token for: more texts make larger buckets, so that the list of frequent words stays bounded.
BYTES_A_TOKEN_OF_BUCKET = 1 << 22
#: Customers of a dish up to which the chance that one sits alone is exact; discounts before they are estimated.
EXACT, DISCOUNT = 128, 0.75
#: Most words that a task counts before it passes the sums on; most texts of a chunk.
MERGE, TEXTS, ROWS = 4_000_000, 65_000, 10_000
END = mix(np.array([0xE0D], U))[0]
_GOLD = U(0x9E3779B97F4A7C15)


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, each text's end after its words, and where each text begins (one entry more)."""
    words = Words(texts_of(batch), LOWER_SPACES)
    n = batch.num_rows
    out = np.empty(len(words) + n, U)
    place = np.arange(len(words)) + words.text_of()
    out[place] = words.hash
    ends = words.first[1:] + np.arange(n)
    out[ends] = END
    return out, np.r_[0, ends + 1]


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, c): each token's hash and count."""

    def count(batches):
        have, n = [], 0

        def sums():
            h, where = np.unique(np.concatenate([x for x, _ in have]), return_inverse=True)
            return h, np.bincount(where, weights=np.concatenate([y for _, y in have])).astype(np.int64)

        def rows(h, c):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        for batch in batches:
            for part in pieces(batch):
                h, c = np.unique(tokens(part)[0], return_counts=True)
                have.append((h, c))
                n += len(h)
                if n > MERGE:
                    have = [sums()]
                    n = len(have[0][0])
                    if n > MERGE // 2:
                        yield rows(*have[0])
                        have, n = [], 0
        if have:
            yield rows(*sums())

    return texts.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value, byte by byte: all first bytes of an array's numbers, then all second ones, and so on."""
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpacked(data: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 8 * len(types)
    for n, t in zip(np.frombuffer(raw, np.int64, len(types)).tolist(), types, strict=True):
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(t).reshape(n))
        at += n * size
    return out


def _steps(a: np.ndarray) -> np.ndarray:
    """Sorted hashes as the steps between them; a running sum takes them back."""
    return np.diff(a, prepend=U(0))


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each value in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.searchsorted(keys, h).clip(max=len(keys) - 1)
    return at, keys[at] == h


def _changes(*arrays: np.ndarray) -> np.ndarray:
    """Which entries differ in one of the arrays from the entry before."""
    out = np.ones(len(arrays[0]), bool)
    out[1:] = False
    for a in arrays:
        out[1:] |= a[1:] != a[:-1]
    return out


def contexts(h: np.ndarray, first: np.ndarray, hot: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token the restaurant of the word before it and the class of the word before that. parts: restaurants of each word in hot."""
    before, two = np.empty_like(h), np.empty_like(h)
    before[1:] = h[:-1]
    before[first[:-1]] = END
    two[1:] = before[:-1]
    two[first[:-1]] = END
    kind = (mix(two + U(1)) >> U(48)).astype(np.uint16)
    place, known = _find(hot, before)
    share = kind % np.where(known, parts[place] if len(parts) else 1, 1)
    return mix(before + share.astype(U) * _GOLD), kind


def _dealt(r: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash; it grows with the hash."""
    return ((r >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def chunk_rows(docs: DataFrame, buckets: int, hot: np.ndarray, parts: np.ndarray) -> DataFrame:
    """(bucket, part, data): the triples of a chunk in a bucket and their training counts (part -1), the places in the chunk of the texts they stand
    in (part -3), and of each chunk, in any bucket, its texts' keys (part -2)."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, parts))

    def row(bucket, part, data):
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["bucket", "part", "data"])

    def emit(have):
        columns = list(zip(*have, strict=True))
        have.clear()
        h, r, kind, owner, learn, k1, k2 = (np.concatenate(columns.pop(0)) for _ in range(7))
        chunk = np.bitwise_xor.reduce(mix(k1.view(U) + np.arange(len(k1), dtype=U) * _GOLD), keepdims=True)
        yield row(int(_dealt(chunk, buckets)[0]), -2, packed(chunk, k1, k2))
        # Equal triples mostly come together, all of a bucket's surely; what doesn't is merged in the bucket.
        order = np.argsort((r >> U(24) << U(24)) | (mix(h + kind * _GOLD) >> U(40)), kind="stable").astype(np.int32)
        h = h[order]
        r = r[order]
        kind, owner = kind[order], owner[order]
        del order
        at = np.flatnonzero(_changes(r, kind, h))
        r, kind, h, times = r[at], kind[at], h[at], np.diff(np.append(at, len(owner)))
        counts = np.add.reduceat(learn[owner].astype(np.int64), at)
        edge = np.searchsorted(_dealt(r, buckets), np.arange(buckets + 1))
        token_edge = np.append(at, len(owner))[edge]
        for b in np.flatnonzero(np.diff(edge)).tolist():
            s, e = edge[b], edge[b + 1]
            run = np.flatnonzero(_changes(r[s:e]))
            words, word = np.unique(h[s:e], return_inverse=True)
            yield row(b, -1, packed(chunk, _steps(r[s:e][run]), np.diff(np.append(run, e - s)).astype(np.uint32), kind[s:e], _steps(words), word.astype(np.uint32), counts[s:e].astype(np.uint32)))
            yield row(b, -3, packed(chunk, times[s:e].astype(np.uint32), owner[token_edge[b] : token_edge[b + 1]].astype(np.uint16)))

    def deal(batches):
        have, n, texts = [], 0, 0
        for batch in batches:
            for part in (p.slice(i, ROWS) for p in pieces(batch) for i in range(0, p.num_rows, ROWS)):
                h, first = tokens(part)
                r, kind = contexts(h, first, *shared.value)
                columns = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_learn", "_k1", "_k2"))
                have.append((h, r, kind, np.repeat(np.arange(texts, texts + part.num_rows, dtype=np.int32), np.diff(first)), *columns))
                n, texts = n + len(h), texts + part.num_rows
                if n >= CHUNK or texts + ROWS > TEXTS:
                    yield from emit(have)
                    n, texts = 0, 0
        if have:
            yield from emit(have)

    return docs.select("text", "_learn", "_k1", "_k2").mapInArrow(deal, "bucket int, part int, data binary")


# Seating


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on key and step alone."""
    return (mix(key + U((step * 1_000_003 + SEED) * int(_GOLD) & (1 << 64) - 1)) >> U(11)).astype(float) / (1 << 53)


def alone_table(discount: float) -> np.ndarray:
    """[c, t]: the chance that a customer sits alone if c customers sit at t tables, by generalised Stirling numbers."""
    log = np.full((EXACT + 1, EXACT + 2), -np.inf)
    out = np.zeros((EXACT + 1, EXACT + 2))
    log[1, 1], out[1, 1] = 0.0, 1.0
    t = np.arange(1, EXACT + 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(2, EXACT + 1):
            joined = log[c - 1, 1:] + np.log(np.maximum(c - 1 - discount * t, 0))
            log[c, 1:] = np.logaddexp(log[c - 1, :-1], joined)
            out[c, 1:] = np.where(np.isfinite(log[c, 1:]), np.exp(log[c - 1, :-1] - log[c, 1:]), 0.0)
    return np.nan_to_num(out)


class Seating:
    """Customers c and tables t of dishes, in restaurants `room`; key: what a dish's random numbers are hashed from.

    A customer opens a table in proportion to (strength + discount * all tables of the room) * base, and joins one in proportion to
    customers - discount * tables of the dish.
    """

    def __init__(self, c: np.ndarray, room: np.ndarray, rooms: int, key: np.ndarray, discount: float):
        self.c, self.room, self.rooms, self.key, self.discount = c.astype(np.int64), room, rooms, key, discount
        self.t = np.minimum(self.c, 1)
        self.alone = alone_table(discount)
        self.total = np.bincount(room, self.t, rooms)

    def _opens(self, i: np.ndarray, t: np.ndarray, n: np.ndarray, base: np.ndarray, left=0) -> np.ndarray:
        """The chance that a further customer of dish i, of which n sit at t tables, opens one."""
        new = (STRENGTH + self.discount * (self.total[self.room[i]] - left)) * base[i]
        return np.where(n > 0, new / (new + np.maximum(n - self.discount * t, 1e-9)), 1.0)

    def _lone(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The chance that one of c customers at t tables sits alone; beyond EXACT customers the limit for many."""
        return np.where(c <= EXACT, self.alone[c.clip(0, EXACT), t.clip(0, EXACT + 1)], np.minimum(1.0, self.discount * (t - 1) / np.maximum(c, 1)))

    def start(self, base: np.ndarray) -> None:
        """All customers sit down one after another; from the 64th of a dish on, up to a sixteenth as many as sit already at once."""
        n, active, step = np.minimum(self.c, 1), np.flatnonzero(self.c > 1), 0
        while len(active):
            many = np.minimum(np.where(n[active] < 64, 1, n[active] // 16), self.c[active] - n[active])
            opened = np.floor(many * self._opens(active, self.t[active], n[active], base) + uniform(self.key[active], -1 - step)).astype(np.int64)
            self.t[active] += opened
            n[active] += many
            self.total += np.bincount(self.room[active], opened, self.rooms)
            active, step = active[n[active] < self.c[active]], step + 1

    def round(self, base: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One customer of each dish with several is unseated and seated again. Gives these dishes, and whether a table fell free and was opened."""
        i = np.flatnonzero(self.c > 1)
        left = uniform(self.key[i], 2 * step) < self._lone(self.c[i], self.t[i])
        t = self.t[i] - left
        opened = uniform(self.key[i], 2 * step + 1) < self._opens(i, t, self.c[i] - 1, base, left)
        self.t[i] = t + opened
        self.total += np.bincount(self.room[i], opened.astype(np.int64) - left, self.rooms)
        return i, left, opened

    def moved(self, leaving: np.ndarray, coming: np.ndarray, base: np.ndarray, step: int) -> None:
        """Customers of dishes go and others come, those of a dish at once."""
        i = np.flatnonzero(leaving)
        if len(i):
            rest = self.c[i] - leaving[i]
            gone = np.floor(leaving[i] * self._lone(self.c[i], self.t[i]) + uniform(self.key[i], 2 * step)).astype(np.int64)
            t = np.minimum(np.maximum(self.t[i] - gone, np.minimum(rest, 1)), rest)
            self.total += np.bincount(self.room[i], t - self.t[i], self.rooms)
            self.c[i], self.t[i] = rest, t
        i = np.flatnonzero(coming)
        if len(i):
            opened = np.floor(coming[i] * self._opens(i, self.t[i], self.c[i], base) + uniform(self.key[i], 2 * step + 1)).astype(np.int64)
            opened = np.minimum(np.where(self.c[i] == 0, np.maximum(opened, 1), opened), coming[i])
            self.total += np.bincount(self.room[i], opened, self.rooms)
            self.c[i], self.t[i] = self.c[i] + coming[i], self.t[i] + opened

    def predictive(self, base: np.ndarray, customers: np.ndarray) -> np.ndarray:
        """The probability of each dish for the next customer. customers: of each room."""
        return (np.maximum(self.c - self.discount * self.t, 0) + (STRENGTH + self.discount * self.total[self.room]) * base) / (STRENGTH + customers[self.room])


class Bucket:
    """The restaurants of a bucket: its triples from all chunks, merged, and who they belong to."""

    def __init__(self, rows: list[bytes]):
        parts = [unpacked(x, U, U, np.uint32, np.uint16, U, np.uint32, np.uint32) for x in rows]
        self.chunks = [(int(p[0][0]), len(p[3])) for p in parts]
        names, room = np.unique(np.concatenate([np.cumsum(p[1]) for p in parts]), return_inverse=True)
        room = np.repeat(room.astype(np.int32), np.concatenate([p[2] for p in parts]))
        h = np.concatenate([np.cumsum(p[4])[p[5]] for p in parts])
        kind, counts = np.concatenate([p[3] for p in parts]), np.concatenate([p[6] for p in parts])
        del parts
        # By restaurant and word, and then by class.
        bits = U(max(1, int(len(names) - 1).bit_length()))
        order = np.argsort((room.astype(U) << (U(64) - bits)) | (mix(h) >> bits)).astype(np.int32)
        pair = (np.cumsum(_changes(room[order], h[order])) - 1).astype(np.int32)
        again = np.argsort(pair.astype(U) << U(16) | kind[order]).astype(np.int32)
        order, pair = order[again], pair[again]
        del again
        new = _changes(pair, kind[order])
        self.place = np.empty(len(order), np.int32)
        self.place[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.c = np.add.reduceat(counts[order].astype(np.int64), at)
        self.pair = pair[at]
        order = order[at]
        room, kind, h = room[order].astype(np.int64), kind[order], h[order]
        del order, pair, counts, new, at
        first = np.flatnonzero(_changes(self.pair))
        self.room1 = room[first].astype(np.int32)
        self.words, word = np.unique(h[first], return_inverse=True)
        self.word = word.astype(np.int32)
        self.room2 = np.unique(room << 16 | kind, return_inverse=True)[1].astype(np.int32)
        r = names[room]
        self.key1 = mix(r[first] ^ mix(h[first]))
        self.key2 = mix(mix(r + (kind.astype(U) + U(1)) * _GOLD) ^ mix(h + _GOLD))

    def seated(self, base: np.ndarray, discounts: tuple[float, float]) -> None:
        """All customers sit down, for the first time. base: probability of each of the words."""
        self.base = base[self.word]
        rooms1, rooms2 = int(self.room1.max()) + 1, int(self.room2.max()) + 1
        self.low = Seating(self.c, self.room2, rooms2, self.key2, discounts[1])
        self.low.start(self.base[self.pair])
        self.high = Seating(np.bincount(self.pair, self.low.t), self.room1, rooms1, self.key1, discounts[0])
        self.high.start(self.base)
        self.customers2 = np.bincount(self.room2, self.c, rooms2)

    def above(self) -> np.ndarray:
        """The probability of each pair's word after the word before alone."""
        return self.high.predictive(self.base, np.bincount(self.room1, self.high.c, self.high.rooms))

    def sweep(self, number: int) -> None:
        for k in range(ROUNDS):
            step = 2 * (number * ROUNDS + k)
            i, left, opened = self.low.round(self.above()[self.pair], step)
            pair = self.pair[i]
            self.high.moved(np.bincount(pair, left, len(self.base)).astype(np.int64), np.bincount(pair, opened, len(self.base)).astype(np.int64), self.base, step)
            self.high.round(self.base, step + 1)

    def scores(self) -> np.ndarray:
        """The probability of each triple."""
        return self.low.predictive(self.above()[self.pair], self.customers2)


def _shared_out(a: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """The parts of sorted hashes by bucket."""
    edge = np.searchsorted(_dealt(a, buckets), np.arange(buckets + 1))
    return [(b, slice(edge[b], edge[b + 1])) for b in np.flatnonzero(np.diff(edge)).tolist()]


def _estimated(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once and twice else 0.5


def tables_of(chunks: DataFrame, buckets: int) -> DataFrame:
    """(part, bucket, data, c0, a1, a2, b1, b2): for each bucket and part of the words, the words and, of each, its tables in the bucket and its training count;
    tables in all; dishes of one and of two customers in the restaurants of one word and of two."""

    def sums(table: pa.Table) -> pa.Table:
        bucket = Bucket(table.column("data").to_pylist())
        n = np.bincount(bucket.word[bucket.pair], bucket.c, len(bucket.words)).astype(np.int64)
        bucket.seated((n + 0.5) / (n.sum() + 0.5 * (len(n) + 1)), (DISCOUNT, DISCOUNT))
        bucket.sweep(0)
        tables = np.bincount(bucket.word, bucket.high.t, len(bucket.words)).astype(np.int64)
        few = [int((x == k).sum()) for x in (bucket.high.c, bucket.c) for k in (1, 2)]
        out = []
        for part, s in _shared_out(bucket.words, buckets):
            out.append((part, table.column("bucket")[0].as_py(), packed(_steps(bucket.words[s]), tables[s].astype(np.uint32), n[s].astype(np.uint32)), int(tables[s].sum()), *few))
            few = [0, 0, 0, 0]
        names = ("part", "bucket", "data", "c0", "a1", "a2", "b1", "b2")
        return pa.table({c: pa.array([x[k] for x in out], pa.int32() if k < 2 else pa.binary() if k == 2 else pa.int64()) for k, c in enumerate(names)})

    return chunks.where("part = -1").groupBy("bucket").applyInArrow(sums, "part int, bucket int, data binary, c0 long, a1 long, a2 long, b1 long, b2 long")


class Root:
    """The words without context of one part: customers are the tables of all buckets. v: distinct training words, all in all (a guess at first)."""

    def __init__(self, rows: list[bytes], discount: float):
        parts = [unpacked(x, U, np.uint32, np.uint32) for x in rows]
        self.sizes = [len(p[0]) for p in parts]
        words, self.place = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
        customers, self.counts = (np.bincount(self.place, np.concatenate([p[k] for p in parts]), len(words)).astype(np.int64) for k in (1, 2))
        # The base is uniform and has about as many places as there are tables: a new table's weight is close to the discount.
        self.seating = Seating(customers, np.arange(len(words)), len(words), mix(words + _GOLD), discount)
        self.seating.total = np.zeros(len(words))
        base = np.full(len(words), discount / STRENGTH)
        self.seating.start(base)
        for i in range((BURN + SAMPLES) * ROUNDS):
            self.seating.total = np.zeros(len(words))
            self.seating.round(base, i)


def word_shares(tables: DataFrame) -> tuple[DataFrame, tuple, int, int]:
    """(bucket, part, data): probabilities and counts of the words of each row of tables, in its order; discounts of the restaurants of one
    word and of two; training tokens; distinct training words."""
    a1, a2, b1, b2, c0 = (x or 0 for x in tables.agg(*(F.sum(c) for c in ("a1", "a2", "b1", "b2", "c0"))).first())

    def totals(table: pa.Table) -> pa.Table:
        root = Root(table.column("data").to_pylist(), DISCOUNT)
        return pa.table({"t": [int(root.seating.t.sum())], "v": [int((root.counts > 0).sum())], "n": [int(root.counts.sum())]})

    t, v, n = (x or 0 for x in tables.select("part", "data").groupBy("part").applyInArrow(totals, "t long, v long, n long").agg(F.sum("t"), F.sum("v"), F.sum("n")).first())
    unseen = (STRENGTH + DISCOUNT * t) / (v + 1) / (STRENGTH + c0)

    def shares(table: pa.Table) -> pa.Table:
        root = Root(table.column("data").to_pylist(), DISCOUNT)
        p = np.maximum(root.seating.c - DISCOUNT * root.seating.t, 0) / (STRENGTH + c0) + unseen
        p, counts = p[root.place], root.counts[root.place].astype(np.uint32)
        cuts = np.r_[0, np.cumsum(root.sizes)]
        data = [packed(p[a:b].astype(np.float32), counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"bucket": table.column("bucket"), "part": table.column("part"), "data": pa.array(data, pa.binary())})

    rows = tables.select("part", "bucket", "data").groupBy("part").applyInArrow(shares, "bucket int, part int, data binary")
    return rows, (_estimated(a1, a2), _estimated(b1, b2)), n, v


def text_sums(chunks: DataFrame, shares: DataFrame, discounts: tuple, n: int, v: int) -> DataFrame:
    """(_k1, _k2, tokens, known, base, value): the sums of a chunk's texts over all their tokens."""

    def score(table: pa.Table) -> pa.Table:
        part, data = np.array(table.column("part").to_pylist()), table.column("data").to_pylist()
        out = []  # chunk, its texts' keys, sums of its texts in this bucket
        for i in np.flatnonzero(part == -2):
            chunk, k1, k2 = unpacked(data[i], U, np.int64, np.int32)
            out.append((int(chunk[0]), packed(k1, k2), None))
        rows = [data[i] for i in np.flatnonzero(part == -1)]
        if rows:
            bucket = Bucket(rows)
            answers = [unpacked(data[i], np.float32, np.uint32) for i in np.argsort(part, kind="stable") if part[i] >= 0]
            p, counts = (np.concatenate([a[k] for a in answers]) for k in (0, 1))
            bucket.seated(p.astype(float), discounts)
            total = np.zeros(len(bucket.c))
            for i in range(BURN + SAMPLES):
                bucket.sweep(i)
                if i >= BURN:
                    total += bucket.scores()
            value = np.log10(total / SAMPLES)
            c = counts[bucket.word[bucket.pair]].astype(float)
            base, known = np.log10((c + 0.5) / (n + 0.5 * (v + 1))), c > 0
            at = 0
            place = {int(c[0]): rest for c, *rest in (unpacked(data[i], U, np.uint32, np.uint16) for i in np.flatnonzero(part == -3))}
            for chunk, n_triples in bucket.chunks:
                times, text = place[chunk]
                triple = np.repeat(bucket.place[at : at + n_triples], times)
                at += n_triples
                size = np.bincount(text)
                there = np.flatnonzero(size)
                known_here, *sums = (np.bincount(text, x[triple])[there] for x in (known, base, value))
                out.append((chunk, None, packed(there.astype(np.uint16), size[there].astype(np.uint32), known_here.astype(np.uint32), *sums)))
        return pa.table({"chunk": pa.array(np.array([x[0] for x in out], U).view(np.int64)), "keys": pa.array([x[1] for x in out], pa.binary()), "sums": pa.array([x[2] for x in out], pa.binary())})

    def added(table: pa.Table) -> pa.Table:
        k1, k2 = next(unpacked(x, np.int64, np.int32) for x in table.column("keys").to_pylist() if x)
        total = np.zeros((4, len(k1)))
        parts = [unpacked(x, np.uint16, np.uint32, np.uint32, np.float64, np.float64) for x in table.column("sums").to_pylist() if x]
        for text, *sums in sorted(parts, key=lambda x: tuple(y[0] for y in x)):  # always in the same order
            total[:, text] += np.array(sums, float)
        columns = [k1, k2, total[0].astype(np.int64), total[1].astype(np.int64), total[2], total[3]]
        return pa.table({c: pa.array(x) for c, x in zip(("_k1", "_k2", "tokens", "known", "base", "value"), columns, strict=True)})

    rows = chunks.unionByName(shares).groupBy("bucket").applyInArrow(score, "chunk long, keys binary, sums binary")
    return rows.groupBy("chunk").applyInArrow(added, "_k1 long, _k2 int, tokens long, known long, base double, value double")


def scored(documents: DataFrame, training, per_bucket: int = PER_BUCKET) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of documents.

    training: a Column, true for rows to learn from (others, and rows where it is null, are held out). A null text
    is an empty one: its end is its only token. base_score is the sum of the tokens' log10 add-a-half unigram
    probabilities, score the model's log10 probability of the text. Repeated rows are learned and scored each; equal texts have equal
    scores. Long texts are scored whole. With nothing to learn from, every word is unseen. Other columns are neither read nor
    returned; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    docs = documents.select("doc_id", text.alias("text"), F.coalesce(training, F.lit(False)).alias("_learn"), F.xxhash64(text).alias("_k1"), F.hash(text).alias("_k2"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    per_bucket = max(per_bucket, size // BYTES_A_TOKEN_OF_BUCKET)
    hot = max(2, per_bucket // 4)
    listed = F.collect_list(F.when(F.col("c") >= hot, F.struct("h", "c")))
    rows, frequent = word_counts(docs).agg(F.coalesce(F.sum("c"), F.lit(0)), listed).first()
    hot_words = np.array([x.h for x in frequent], np.int64).view(U)
    order = np.argsort(hot_words)
    parts = -(-np.array([x.c for x in frequent], np.int64)[order] // hot)
    buckets = 1 + rows // per_bucket
    chunks = chunk_rows(docs, buckets, hot_words[order], parts)
    shares, discounts, n, v = word_shares(cut(tables_of(chunks, buckets)))
    sums = text_sums(chunks, shares, discounts, n, v).groupBy("_k1", "_k2").agg(*(F.sum(c).alias(c) for c in ("tokens", "known", "base", "value")))
    head = docs.drop("text")
    same = head.groupBy("_k1", "_k2").agg(F.count("*").alias("rows"))
    each = lambda c: F.col(c) / F.col("rows")
    return (
        head.join(sums.join(same, ["_k1", "_k2"]), ["_k1", "_k2"]).select(
            "doc_id",
            (~F.col("_learn")).alias("held_out"),
            each("tokens").cast("long").alias("n_tokens"),
            each("known").cast("long").alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            each("base").alias("base_score"),
            each("value").alias("score"),
        )
    )
