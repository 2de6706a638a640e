"""N-gram Jaccard join with prefix filters under several global token orders.

1. Every task turns its texts into sets of 5-word shingle hashes and deals the tokens out by hash
   range, packed as arrays (5 bytes a token), with equal sets of a task sent once.
2. Each hash range counts its tokens. A token of one set can't be shared, so only tokens of two
   sets or more go back to their unit of documents. A set that keeps under three quarters of its
   tokens has no partner; the rest keep their shared tokens, which is all that an exact
   intersection needs.
3. Order 1 is (document frequency, hash), order 2 the hash upwards, order 3 the hash downwards. Two
   sets of similarity t share a token in the first n - ceil(t n) + 1 under every order. A pair that does
   so under all three is verified by the exact intersection; there is no other way to a link.
4. Pairs are tried in two rounds, for a large group of near copies must cost its size and not its
   square. The first round tries sets with the same first token of an order against a few of each
   component met so far. The second tries all pairs that share a prefix token of order 1, by length and
   position, but those inside a component of the first round, which need no look: only the token's
   sets outside its largest component are held against all others, and a token with many of them
   is dealt over blocks of both sides. Components of all links are the classes.

Token hashes are cut to 43 to 56 bits (40 and those of the hash range), so two sets of a and b shingles
share a wrong token with a probability under ab / 2^43; the sets' sizes are those of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.llm.common import ROW, SPACE_WORDS, join_by_key, persist, row_keys, shingles, shuffle_partitions, texts, words
from leafpress.llm.components import connected_components

#: Tokens and sets of one unit, the piece of a task that is packed at once.
UNIT_TOKENS, UNIT_SETS = 1_000_000, 60_000
#: The most sets on one side of a block.
BLOCK = 1024
#: In a block, components that a set is tried against, and members of each.
RECENT, TRIES = 8, 24


def needed(n: np.ndarray | int, pct: int):
    """Shared tokens that a set of n tokens needs at least: ceil(pct n / 100)."""
    return -(-pct * n // 100)


def text_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text; fewer than k words make one shingle, no words none."""
    for lo, hi, buf, offs in texts(column):
        doc, h, _, _ = words(buf, offs, SPACE_WORDS)
        at = np.searchsorted(doc, np.arange(hi - lo + 1))
        sdoc, s = shingles(doc, h, k)
        sat = np.searchsorted(sdoc, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            m = at[i + 1] - at[i]
            if m >= k:
                yield np.unique(s[sat[i] : sat[i + 1]])
            elif m:
                yield shingles(np.zeros(m, np.int64), h[at[i] : at[i + 1]], int(m))[1]
            else:
                yield h[:0]


def _pack(bits: int, k: int, pct: int):
    shift = np.uint64(24 - bits)

    def unit(no: int, ids: list, of: list, sets: list, sigs: list) -> Iterator[pa.RecordBatch]:
        n = np.array([len(s) for s in sets], np.int64)
        p = n - needed(n, pct) + 1
        low = np.array([s[q - 1] if len(s) else 0 for s, q in zip(sets, p)], np.uint64) >> shift
        high = np.array([s[len(s) - q] if len(s) else 0 for s, q in zip(sets, p)], np.uint64) >> shift
        info = b"".join(x.tobytes() for x in (np.array([len(ids), len(sets)], np.int64), np.array(ids, np.int64), np.array(of, np.int64), n, low, high)) + b"".join(sigs)
        buckets, blobs, kinds = [no % (1 << bits)], [info], [1]
        if n.sum():
            tok = np.concatenate(sets) >> shift
            idx = np.repeat(np.arange(len(sets)), n)
            bucket = (tok >> np.uint64(40)).astype(np.uint16 if bits <= 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            tok, idx, bucket = tok[order], idx[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1 if bucket[0] else 1)) if len(bucket) else []
            if len(cuts) == 0 or cuts[0] != 0:
                cuts = np.concatenate([[0], cuts])
            for a, b in zip(cuts, [*cuts[1:], len(tok)]):
                t, i = tok[a:b], idx[a:b]
                blobs.append((t & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (t >> np.uint64(32)).astype(np.uint8).tobytes() + np.diff(i, prepend=0).astype(np.uint16).tobytes())
                buckets.append(int(bucket[a]))
                kinds.append(0)
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([no] * len(buckets), pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "unit", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 20
        ids, of, sets, sigs, where, total = [], [], [], [], {}, 0
        for batch in batches:
            for doc_id, s in zip(batch.column(0).to_pylist(), text_sets(batch.column(1), k)):
                sig = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if sig not in where:
                    where[sig] = len(sets)
                    sets.append(s)
                    sigs.append(sig)
                    total += len(s)
                ids.append(doc_id)
                of.append(where[sig])
                if total >= UNIT_TOKENS or len(sets) >= UNIT_SETS or len(ids) >= 4 * UNIT_SETS:
                    yield from unit(no, ids, of, sets, sigs)
                    no += 1
                    ids, of, sets, sigs, where, total = [], [], [], [], {}, 0
        if ids:
            yield from unit(no, ids, of, sets, sigs)

    return run


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a hash range, the tokens of two sets or more, sent back to their units; other rows pass."""
    through = pdf[pdf.kind == 1]
    out = [(u, 1, b) for u, b in zip(through.unit, through.blob)]
    rows = pdf[pdf.kind == 0]
    if len(rows):
        bucket, toks, idxs = np.uint64(rows.bucket.iloc[0]), [], []
        for blob in rows.blob:
            n = len(blob) // 7
            toks.append(np.frombuffer(blob, np.uint32, n).astype(np.uint64) | np.frombuffer(blob, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32))
            idxs.append(np.cumsum(np.frombuffer(blob[5 * n :], np.uint16).astype(np.uint32), dtype=np.uint32))
        every = np.sort(np.concatenate(toks))
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        df = np.diff(np.append(first, len(every)))
        shared, df = every[first][df > 1], df[df > 1].astype(np.uint32)
        del every, first
        if len(shared):
            for u, t, i in zip(rows.unit, toks, idxs):
                at = np.minimum(np.searchsorted(shared, t), len(shared) - 1)
                keep = shared[at] == t
                if keep.any():
                    out.append((u, 0, (t[keep] | bucket << np.uint64(40)).tobytes() + df[at[keep]].tobytes() + i[keep].astype(np.uint32).tobytes()))
    return pd.DataFrame(out, columns=["unit", "kind", "blob"])


def _gather(pct: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        info = pdf[pdf.kind == 1].blob.iloc[0]
        d, m = np.frombuffer(info, np.int64, 2)
        ids, of = np.frombuffer(info, np.int64, d, 16), np.frombuffer(info, np.int64, d, 16 + 8 * d)
        n, low, high = (np.frombuffer(info, t, m, 16 + 16 * d + 8 * m * j) for j, t in enumerate((np.int64, np.uint64, np.uint64)))
        sigs = [info[x : x + 16] for x in range(16 + 16 * d + 24 * m, len(info), 16)]
        docs = pd.DataFrame({"doc_id": ids, "n": n[of], "sig": [sigs[x] for x in of]})
        kept = []
        blobs = pdf[pdf.kind == 0].blob
        if len(blobs):
            size = [len(b) // 16 for b in blobs]
            tok = np.concatenate([np.frombuffer(b, np.uint64, c) for b, c in zip(blobs, size)])
            df = np.concatenate([np.frombuffer(b, np.uint32, c, 8 * c) for b, c in zip(blobs, size)])
            idx = np.concatenate([np.frombuffer(b, np.uint32, c, 12 * c) for b, c in zip(blobs, size)])
            have = np.bincount(idx, minlength=m)
            alive = (have >= needed(n, pct)) & (n > 0)
            sel = alive[idx]
            tok, df, idx = tok[sel], df[sel], idx[sel]
            order = np.lexsort((tok, idx))
            tok, df, idx = tok[order], df[order], idx[order]
            ends = np.cumsum(np.bincount(idx, minlength=m)) if len(idx) else np.zeros(m, int)
            for x in np.flatnonzero(alive):
                a, b = ends[x] - have[x], ends[x]
                t, f = tok[a:b], df[a:b]
                slots = int(n[x] - needed(n[x], pct) + 1 - (n[x] - have[x]))
                chosen = np.lexsort((t, f))[:slots]
                k2, k3 = int((t <= low[x]).sum()), int((t >= high[x]).sum())
                if slots < 1 or not k2 or not k3:  # the prefix of an order holds tokens of its own only
                    continue
                firsts = [int(v) << 2 | o for o, v in enumerate((t[chosen[0]], t[0], t[-1]))]
                kept.append((sigs[x], int(n[x]), t.tobytes(), t[chosen].astype(np.int64).tolist(), int(n[x] - have[x]), k2, k3, firsts))
        sets = pd.DataFrame(kept, columns=["sig", "n", "tokens", "prefix", "lone", "k2", "k3", "firsts"])
        out = pd.concat([docs.assign(kind=0), sets.assign(kind=1)])
        for c in ("doc_id", "lone", "k2", "k3", "n"):
            out[c] = out[c].astype("Int64")
        return out[["kind", "doc_id", "sig", "n", "tokens", "prefix", "lone", "k2", "k3", "firsts"]].astype({"tokens": object, "prefix": object, "firsts": object}).where(lambda x: x.notna(), None)

    return run


def similar(a: np.ndarray, b: np.ndarray, na: int, nb: int, pct: int) -> bool:
    """Exact: 100 |a & b| >= pct |a | b|. a and b are the shared tokens of sets of na and nb tokens."""
    if 100 * min(na, nb) < pct * max(na, nb):
        return False
    both = np.concatenate([a, b])
    both.sort()
    i = int((both[1:] == both[:-1]).sum())
    return 100 * i >= pct * (na + nb - i)


def meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted arrays share a value."""
    if not len(a) or not len(b):
        return False
    return bool((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).any())


class TokenSet:
    """A set with its prefixes under the three orders."""

    __slots__ = ("first", "high", "low", "n", "tokens")

    def __init__(self, tokens: bytes, n: int, prefix, k2: int, k3: int):
        self.tokens, self.n = np.frombuffer(tokens, np.uint64), n
        self.first = np.sort(np.asarray(prefix, np.int64)).view(np.uint64)
        self.low, self.high = self.tokens[:k2], self.tokens[len(self.tokens) - k3 :]

    def links(self, other: TokenSet, pct: int) -> bool:
        """By length, then the three prefixes one after another, then the exact intersection."""
        if 100 * min(self.n, other.n) < pct * max(self.n, other.n):
            return False
        if not (meet(self.low, other.low) and meet(self.high, other.high) and meet(self.first, other.first)):
            return False
        return similar(self.tokens, other.tokens, self.n, other.n, pct)


def _block_links(pct: int):
    """Connections inside a block of sets with the same first token of an order: each set against a few earlier ones of a few components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("sig").sort_values(["n", "sig"])
        sets = [TokenSet(*r) for r in zip(pdf.tokens, pdf.n, pdf.prefix, pdf.k2, pdf.k3)]
        sig = pdf.sig.to_list()
        groups: list[list[int]] = []  # the one that was joined last stands last
        for i in range(len(sets)):
            for x in range(len(groups) - 1, max(-1, len(groups) - 1 - RECENT), -1):
                g = groups[x]
                some = g if len(g) <= TRIES else g[:: len(g) // TRIES + 1] + g[-4:]
                j = next((j for j in reversed(some) if sets[i].links(sets[j], pct)), None)
                if j is not None:
                    g.append(i)
                    groups.append(groups.pop(x))
                    break
            else:
                groups.append([i])
        # What verified links connect hangs on one set, so that few rounds join the blocks.
        out = [(sig[i], min(sig[j] for j in g)) for g in groups if len(g) > 1 for i in g]
        return pd.DataFrame([x for x in out if x[0] != x[1]], columns=["a", "b"])

    return run


def _candidates(pct: int):
    """Pairs of different components that share a token of order 1, by length and position: a block's visitors against its residents."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["token", "b", "c"], kind="stable")
        where = pdf[["token", "b", "c"]].to_numpy()
        n, pos, visits = pdf.n.to_numpy(), pdf.pos.to_numpy(), pdf.visits.to_numpy()
        sig, label = pdf.sig.to_numpy(), pd.factorize(pdf.label)[0]
        cuts = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]).any(axis=1), [True]]))
        out = set()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            here = lo + np.flatnonzero(~visits[lo:hi])
            m, p, own = n[here], pos[here], label[here]
            for x in lo + np.flatnonzero(visits[lo:hi]):
                less, more = np.minimum(m, n[x]), np.maximum(m, n[x])
                overlap = -(-pct * (m + n[x]) // (100 + pct))
                room = np.minimum(m - p, n[x] - pos[x])
                for y in here[(own != label[x]) & (100 * less >= pct * more) & (room >= overlap)]:
                    out.add((sig[x], sig[y]) if sig[x] < sig[y] else (sig[y], sig[x]))
        return pd.DataFrame(list(out), columns=["a", "b"])

    return run


def _meetings(labelled: DataFrame, pct: int, parts: int) -> DataFrame:
    """Candidate pairs (a, b) of the labelled prefix tokens of order 1.

    Inside a token's largest component nobody needs to meet. Every other set visits all sets of the token.
    Residents and visitors are dealt over blocks of at most about BLOCK each, so that a hot token is
    spread over as many groups as it has pairs of blocks; tokens of one component go at once.
    """
    each = labelled.groupBy("token", "label").agg(F.count("*").alias("own"))
    tokens = each.groupBy("token").agg(F.sum("own").alias("all"), F.max(F.struct("own", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    nb, nv = F.ceil(F.col("all") / BLOCK).cast("int").alias("nb"), F.ceil((F.col("all") - F.col("top.own")) / BLOCK).cast("int").alias("nv")
    met = labelled.join(tokens.select("token", nb, nv, F.col("top.label").alias("top")), "token")
    spread = lambda n, salt: F.pmod(F.xxhash64("sig", F.lit(salt)), F.col(n)).cast("int")
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = ["token", "sig", "n", "pos", "label"]
    residents = met.select(*cells, spread("nb", 1).alias("b"), steps("nv").alias("c"), F.lit(False).alias("visits"))
    visitors = met.where("label <> top").select(*cells, steps("nb").alias("b"), spread("nv", 2).alias("c"), F.lit(True).alias("visits"))
    part = F.pmod(F.xxhash64("token", "b", "c"), F.lit(4 * parts)).alias("part")
    return residents.unionByName(visitors).groupBy(part).applyInPandas(_candidates(pct), "a binary, b binary").distinct()


def _verify(pct: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sides = [[TokenSet(*r) for r in zip(*(pdf[f"{c}{s}"] for c in ("tokens", "n", "prefix", "k2", "k3")))] for s in "ab"]
            yield pdf.loc[[x.links(y, pct) for x, y in zip(*sides)], ["a", "b"]]

    return run


def ngram_jaccard_components(docs: DataFrame, k: int = 5, pct: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents under links 100 |A & B| >= pct |A | B| of their k-word shingle sets.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable by links), one row per input
    row. Null and empty texts, and texts of white space only, have no shingles and no links; a text
    of fewer than k words is one shingle. Repeated rows stay repeated. Rows with a null id take part
    under id null and get component_id null unless a linked document has an id. Other columns of
    the input are not looked at. pct must be from 1 to 100.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    bits = min(16, max(3, math.ceil(math.log2(4 * parts))))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = base.mapInArrow(_pack(bits, k, pct), "bucket int, unit long, kind int, blob binary")
    counted = packed.groupBy("bucket").applyInPandas(_count, "unit long, kind int, blob binary")
    made: list[str] = []  # the folder that is of no use any more once the next stands
    table = persist(counted.groupBy("unit").applyInPandas(_gather(pct), "kind int, doc_id long, sig binary, n long, tokens binary, prefix array<long>, lone long, k2 long, k3 long, firsts array<long>"), "sets", made)
    members = persist(table.where("kind = 0").select("doc_id", "n", "sig"), "members")
    sets = persist(table.where("kind = 1").drop("kind", "doc_id").dropDuplicates(["sig"]), "shared", made)

    keys = sets.select("sig", F.explode("firsts").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    block = F.pmod(F.xxhash64("sig", "key"), F.ceil(F.col("size") / BLOCK).cast("long"))
    blocks = keys.join(sizes, "key").select("sig", "key", block.alias("block")).join(sets.select("sig", "n", "tokens", "prefix", "k2", "k3"), "sig")
    links = persist(blocks.groupBy("key", "block").applyInPandas(_block_links(pct), "a binary, b binary"), "links")
    near = connected_components(links)

    posts = sets.select("sig", "n", "lone", F.posexplode("prefix").alias("i", "token")).select("sig", "n", "token", (F.col("lone") + F.col("i")).alias("pos"))
    labelled = posts.join(near.select(F.col("node").alias("sig"), "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    side = lambda s: sets.select(F.col("sig").alias(s), *[F.col(c).alias(f"{c}{s}") for c in ("tokens", "n", "prefix", "k2", "k3")])
    more = _meetings(labelled, pct, parts).join(side("a"), "a").join(side("b"), "b").mapInPandas(_verify(pct), "a binary, b binary")
    more = persist(more, "verified", made)

    # Two steps: sets hang on the label of their cheap links, and labels on the least of those that more links join.
    first = near.select(F.col("node").alias("sig"), "label")
    of = lambda c: first.select(F.col("sig").alias(c), F.col("label").alias(f"l{c}"))
    bridges = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    joined = connected_components(bridges).select(F.col("node").alias("label"), F.col("label").alias("top"))
    # A set or a label may have a third of all rows: they are dealt when they meet their one value.
    firsts = persist(members.groupBy("sig").agg(F.count("*").alias("size")).join(first, "sig"), "firsts", made)
    named = join_by_key(members, firsts, "sig", "doc_id").select("doc_id", "n", F.coalesce("label", "sig").alias("label"))
    named = persist(named, "named", made)
    tops = persist(named.groupBy("label").agg(F.count("*").alias("size")).join(joined, "label"), "tops")
    named = join_by_key(named, tops, "label", "doc_id").select("doc_id", "n", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("real"), F.coalesce("top", "label").alias("label"))
    named = persist(named, "topped", made)
    least = persist(named.groupBy("label").agg(F.min("real").alias("least"), F.count("*").alias("size")), "least")
    return join_by_key(named, least, "label", "doc_id").select(
        F.col("real").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("real")).alias("component_id")
    )


def keep_one_each(docs: DataFrame, k: int = 5, pct: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each class: the one with the smallest id (null ids last), and of equal ids any one.

    Rows are told apart by a number of their own, so repeated and null ids do no harm. Texts without
    words are alike to nothing and all stay.
    """
    keyed = row_keys(docs)
    classes = ngram_jaccard_components(keyed.select(ROW, text_col), k, pct, ROW, text_col).select(F.col("doc_id").alias(ROW), "component_id")
    named = classes.join(keyed.select(ROW, F.col(id_col).alias("id")), ROW)
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", ROW)).alias("first"))
    return keyed.join(first.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_semi").drop(ROW)
