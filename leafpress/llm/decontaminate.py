"""Benchmark decontamination by greedy string tiling.

Words are compared as hashes of lower-cased letters and digits, so punctuation doesn't matter. Runs of `seed`
words that a text shares with a benchmark item make the pair a candidate. For a candidate, search
lengths fall from the longest possible to `seed`: at each, Karp-Rabin hashes of the unmarked words
find equal runs, which are checked word by word, and marked in both texts unless already taken.
The share of the item's words under tiles is the coverage; since tiles may lie in any order, a
reordered passage is covered as well as a straight one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.llm.common import ALNUM_WORDS, ROW, persist, row_keys, shingles, shuffle_partitions, texts, words

#: A benchmark of at most so many bytes of text goes whole to every executor; a larger one stays dealt by its seeds.
BLOCK_BYTES = 4 << 20
#: Bits of the filter of a larger benchmark's seeds, and parts among which an item's candidates are dealt.
FILTER_BITS, SALTS = 1 << 26, 16
SEED, COVERAGE = 5, 0.6
SCHEMA = "doc_id long, item_id long, coverage double, tiles int, matched_words int, item_words int, longest int"
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _runs(free: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """Stretches of at least s free places."""
    at = 0
    while at < len(free):
        if not free[at]:
            at += 1
            continue
        end = at
        while end < len(free) and free[end]:
            end += 1
        if end - at >= s:
            yield at, end
        at = end


def _hashes(x: list[int], free: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """(Karp-Rabin hash, place) of every window of s free words."""
    top = pow(_BASE, s - 1, 1 << 64)
    for a, b in _runs(free, s):
        h = 0
        for i in range(a, a + s):
            h = (h * _BASE + x[i]) & _MASK
        yield h, a
        for i in range(a + s, b):
            h = ((h - x[i - s] * top) * _BASE + x[i]) & _MASK
            yield h, i - s + 1


def _extend(text: list[int], item: list[int], a: int, b: int, tf: list[bool], pf: list[bool]) -> int:
    k = 0
    while a + k < len(text) and b + k < len(item) and tf[a + k] and pf[b + k] and text[a + k] == item[b + k]:
        k += 1
    return k


def tiles(text: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in text, place in item, length) of non-overlapping tiles, longest first."""
    tf, pf, out = [x >= 0 for x in text], [True] * len(item), []
    s = min(len(item), sum(tf))
    while s >= least:
        where = defaultdict(list)
        for h, b in _hashes(item, pf, s):
            where[h].append(b)
        found, longest = [], 0
        for h, a in _hashes(text, tf, s) if where else ():
            for b in where.get(h, ()):
                k = _extend(text, item, a, b, tf, pf)
                if k >= s:
                    found.append((k, a, b))
                    longest = max(longest, k)
        if not found:
            if s == least:
                break
            s = max(least, s // 2)
            continue
        if longest > s:  # a longer match was met first: search for it
            s = longest
            continue
        for k, a, b in sorted(found, key=lambda f: (-f[0], f[2], f[1])):
            if all(tf[a : a + k]) and all(pf[b : b + k]):
                out.append((a, b, k))
                tf[a : a + k] = [False] * k
                pf[b : b + k] = [False] * k
        if s == least:
            break
        s = max(least, s // 2)
    return out


class _Block:
    """A block of benchmark items: their words and seeds."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.ids = [i for i, _ in items]
        self.words: list[list[int]] = [[] for _ in items]
        hashes, owner = [], []
        self.sizes = set()
        for lo, hi, buf, offs in texts(pa.array([t for _, t in items], pa.string())):
            doc, h, _, _ = words(buf, offs, ALNUM_WORDS)
            at = np.searchsorted(doc, np.arange(hi - lo + 1))
            for i in range(hi - lo):
                own = h[at[i] : at[i + 1]]
                self.words[lo + i] = (own >> np.uint64(1)).tolist()
                if not len(own):
                    continue
                k = min(seed, len(own))
                self.sizes.add(k)
                s = shingles(np.zeros(len(own), np.int64), own, k)[1]
                hashes.append(s)
                owner.append(np.full(len(s), lo + i))
        h, o = (np.concatenate(hashes), np.concatenate(owner)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.lexsort((o, h))
        self.seeds, self.owner = h[order], o[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.seeds >> np.uint64(44)] = True


def _covered(text: list[int], item: list[int], seed: int, coverage: float) -> tuple | None:
    """(coverage, tiles, matched words, words of the item, longest tile), or None where too little is covered."""
    found = tiles(text, item, min(seed, len(item)))
    matched = sum(t[2] for t in found)
    if found and matched >= coverage * len(item):
        return matched / len(item), len(found), matched, len(item), max(t[2] for t in found)
    return None


def _around(own: np.ndarray, places: list[int], m: int) -> list[int]:
    """Only words that may lie under a tile are looked at: an item's length m around each seed; -1 parts the spans."""
    span: list[list[int]] = []
    for x in sorted(places):
        a, b = max(0, x - m), min(len(own), x + m)
        if span and a <= span[-1][1]:
            span[-1][1] = max(b, span[-1][1])
        else:
            span.append([a, b])
    return [w for a, b in span for w in [*own[a:b].tolist(), -1]]


def _pairs(block: _Block, column: pa.Array, seed: int, coverage: float) -> Iterator[tuple]:
    """(row, item, coverage, ...) of each text and item that covers enough."""
    for lo, hi, buf, offs in texts(column):
        doc, h, _, _ = words(buf, offs, ALNUM_WORDS)
        at = np.searchsorted(doc, np.arange(hi - lo + 1))
        near: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k in block.sizes:
            if len(h) < k:
                continue
            place = np.flatnonzero(doc[: len(h) - k + 1] == doc[k - 1 :])
            s = shingles(doc, h, k)[1]
            hit = np.flatnonzero(block.filter[s >> np.uint64(44)])
            left, right = np.searchsorted(block.seeds, s[hit], side="left"), np.searchsorted(block.seeds, s[hit], side="right")
            for x, a, b in zip(place[hit], left, right):
                for o in block.owner[a:b]:
                    near[int(doc[x]), int(o)].append(int(x - at[doc[x]]))
        for (d, o), places in near.items():
            own = h[at[d] : at[d + 1]] >> np.uint64(1)
            found = _covered(_around(own, places, len(block.words[o])), block.words[o], seed, coverage)
            if found:
                yield lo + d, block.ids[o], *found


_NAMES = ["doc_id", "item_id", "coverage", "tiles", "matched_words", "item_words", "longest"]
_KINDS = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=_NAMES)


def _match(items, seed: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(items.value, seed)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[i], *rest) for i, *rest in _pairs(block, batch.column(1), seed, coverage)]
            if rows:
                yield _rows(rows)

    return run


def _clean(items, seed: int, coverage: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(items.value, seed)
        for batch in batches:
            keep = np.ones(len(batch), bool)
            keep[[i for i, *_ in _pairs(block, batch.column(text_at), seed, coverage)]] = False
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


# --- a benchmark beyond BLOCK_BYTES -------------------------------------------------------------


def _item_seeds(seed: int):
    """item_id, its words (63-bit hashes), the length of its seeds and the seeds themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lo, hi, buf, offs in texts(batch.column(1)):
                doc, h, _, _ = words(buf, offs, ALNUM_WORDS)
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    own = h[at[i] : at[i + 1]]
                    if len(own):
                        k = min(seed, len(own))
                        s = np.unique(shingles(np.zeros(len(own), np.int64), own, k)[1].view(np.int64))
                        rows.append((batch.column(0)[lo + i].as_py(), (own >> np.uint64(1)).astype("<i8").tobytes(), k, s.tolist()))
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["item_id", "item", "k", "seeds"])

    return run


def _seed_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for batch in batches:
        at = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)
        np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])


def _or(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for batch in batches:
        for own in batch.column("bits"):
            bits |= np.frombuffer(own.as_py(), np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])


def _doc_seeds(found, sizes: list[int]):
    """Of texts with a seed in the filter: row, id, words, and their seeds' hashes and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(found.value, np.uint8)
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for lo, hi, buf, offs in texts(batch.column(1)):
                doc, h, _, _ = words(buf, offs, ALNUM_WORDS)
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                own: dict[int, list] = defaultdict(list)
                for k in sizes:
                    if len(h) < k:
                        continue
                    place = np.flatnonzero(doc[: len(h) - k + 1] == doc[k - 1 :])
                    s = shingles(doc, h, k)[1]
                    bit = s >> np.uint64(64 - FILTER_BITS.bit_length() + 1)
                    for x in np.flatnonzero(bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1):
                        d = int(doc[place[x]])
                        own[d].append({"seed": int(s[x].view(np.int64)), "k": k, "place": int(place[x] - at[d])})
                for d, seeds in own.items():
                    rows.append((task << 40 | row + lo + d, batch.column(0)[lo + d].as_py(), (h[at[d] : at[d + 1]] >> np.uint64(1)).astype("<i8").tobytes(), seeds))
            row += len(batch)
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("seed", pa.int64()), ("k", pa.int32()), ("place", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["row", "doc_id", "words", "seeds"])

    return run


def _tile(seed: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, item_id, own, item, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "words", "item", "places"))):
                item = np.frombuffer(item, "<i8").tolist()
                found = _covered(_around(np.frombuffer(own, "<i8"), places, len(item)), item, seed, coverage)
                if found:
                    rows.append((doc_id, item_id, *found))
            if rows:
                yield _rows(rows)

    return run


def _dealt(base: DataFrame, items: DataFrame, seed: int, coverage: float) -> DataFrame:
    """As _match, without the benchmark in one place: seeds meet in a join, and the candidates' words follow them."""
    spark = base.sparkSession
    parts = shuffle_partitions(spark)
    known = persist(items.mapInArrow(_item_seeds(seed), "item_id long, item binary, k int, seeds array<long>").withColumn("no", F.monotonically_increasing_id()), "items")
    bits = known.select(F.explode("seeds").alias("seed")).mapInArrow(_seed_filter, "bits binary")
    bits = bits.repartition(8).mapInArrow(_or, "bits binary").coalesce(1).mapInArrow(_or, "bits binary").first()[0]  # of FILTER_BITS, whatever the benchmark
    sizes = [r[0] for r in known.select("k").distinct().collect()]  # at most `seed` of them
    found = persist(base.mapInArrow(_doc_seeds(spark.sparkContext.broadcast(bits), sizes), "row long, doc_id long, words binary, seeds array<struct<seed: bigint, k: int, place: int>>"), "found")
    # A seed that many texts and items hold is dealt over parts by the text, with its items beside each.
    salt = F.array(*[F.lit(i) for i in range(SALTS)])
    seeds = known.select("no", "k", F.explode("seeds").alias("seed"), salt.alias("salts")).select("no", "k", "seed", F.explode("salts").alias("salt"))
    hits = found.select("row", F.explode("seeds").alias("s")).select("row", "s.*", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    pairs = hits.join(seeds, ["seed", "k", "salt"]).groupBy("row", "no", "salt").agg(F.sort_array(F.collect_set("place")).alias("places"))  # as long as the text at most
    wide = pairs.join(found.select("row", "doc_id", "words"), "row")
    wide = wide.join(known.select("no", "item_id", "item", F.explode(salt).alias("salt")), ["no", "salt"])
    return wide.select("doc_id", "item_id", "words", "item", "places").repartition(parts).mapInArrow(_tile(seed, coverage), SCHEMA)


def _small(items: DataFrame):
    """The benchmark's (id, text) rows as a broadcast value, where they are few enough; else None."""
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    if size > BLOCK_BYTES:
        return None
    rows = [tuple(r) for r in items.orderBy("i", "t").collect()]
    return items.sparkSession.sparkContext.broadcast(rows)


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    return benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))


def contamination(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id) whose tiles of at least `seed` words cover `coverage` of the item's words.

    Items of fewer words than `seed` must occur whole; items without words, and null or empty texts,
    match nothing. Rows with equal or null ids, and repeated rows, are judged one by one; so are repeated
    items. An empty table on either side gives no pairs, and other columns are not looked at. A
    benchmark of at most BLOCK_BYTES goes to the executors, and documents are read once, without a
    shuffle. A larger one is joined by its seeds, of which a filter of a fixed size lets through
    those that may occur; only texts with such a seed send their words.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = _items(benchmark, item_col, item_text)
    small = _small(items)
    return _dealt(base, items, seed, coverage) if small is None else base.mapInArrow(_match(small, seed, coverage), SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, text_col: str = "text", item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, that hold no benchmark item; each row is judged by its own text, whatever its id."""
    items = _items(benchmark.select(F.lit(0).alias("i"), F.col(item_text).alias("t")), "i", "t")
    small = _small(items)
    if small is not None:
        return docs.mapInArrow(_clean(small, seed, coverage, docs.columns.index(text_col)), docs.schema)
    keyed = row_keys(docs)
    texts_ = keyed.select(ROW, F.col(text_col).cast("string").alias("text")).toDF("doc_id", "text")
    hit = _dealt(texts_, items, seed, coverage).select(F.col("doc_id").alias(ROW)).distinct()
    return keyed.join(hit, ROW, "left_anti").drop(ROW)
