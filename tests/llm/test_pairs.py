"""Similarity operators against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafpress.llm import jaccard_join as J
from leafpress.llm import simhash as S
from leafpress.llm.common import join_by_key
from leafpress.llm.components import connected_components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def word_sets(rows, k=5):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    return out


def classes(rows, pct=75):
    sets = word_sets(rows)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= pct * len(x | y):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for a in range(len(sets)):
        groups[find(a)].append(a)
    out = []
    for members in groups.values():
        least = min((sets[a][0] for a in members if sets[a][0] is not None), default=None)
        out += [(sets[a][0], len(sets[a][1]), least) for a in members]
    return collections.Counter(out)


def got(df):
    return collections.Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def test_documents(spark, documents):
    assert got(J.ngram_jaccard_components(documents)) == classes([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])


def test_nasty_and_empty(nasty, nothing):
    assert got(J.ngram_jaccard_components(nasty)) == classes([(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()])
    assert J.ngram_jaccard_components(nothing).count() == 0


@pytest.mark.parametrize("pct", [75, 50])
def test_near_the_threshold(spark, pct):
    """Edited copies around the threshold, a chain of them, and a passage that unrelated texts share."""
    rng = random.Random(pct)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for g in range(6):
        base = [word() for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 15 + 1)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
            if rng.random() < 0.2:
                base = w  # the chain moves on
    rows += [" ".join([*(word() for _ in range(30)), passage, *(word() for _ in range(rng.randint(0, 40)))]) for _ in range(40)]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(J.ngram_jaccard_components(df, pct=pct)) == classes(rows, pct)


def test_verified_links_only(spark):
    """Every cheap link is verified: two long texts that share most words in another order stay apart."""
    w = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[150:] + w[:150])), (3, " ".join(reversed(w)))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in J.ngram_jaccard_components(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_orders_lose_no_link():
    """Every similar pair meets in the prefixes of all three orders, and a pair that misses one of them is no link."""
    rng, pct = random.Random(3), 75
    pool = [np.uint64(rng.getrandbits(56)) for _ in range(60)]
    sets = [np.array(sorted(rng.sample(pool, rng.randint(1, 40))), np.uint64) for _ in range(20)]
    sets += [np.unique(np.append(np.delete(s, rng.randrange(len(s))), rng.choice(pool))) for s in sets for _ in range(6)]
    df = collections.Counter(t for s in sets for t in s.tolist())
    made = []
    for s in sets:
        p = len(s) - J.needed(len(s), pct) + 1
        made.append(J.TokenSet(s.tobytes(), len(s), sorted(s.tolist(), key=lambda t: (df[t], t))[:p], p, p))
    found = 0
    for i, a in enumerate(made):
        for j, b in enumerate(made[:i]):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            want = 100 * both >= pct * (len(sets[i]) + len(sets[j]) - both)
            found += want
            assert a.links(b, pct) == want
            if want:
                assert J.meet(a.first, b.first) and J.meet(a.low, b.low) and J.meet(a.high, b.high)
    assert found > 100
    assert not J.TokenSet(made[0].tokens.tobytes(), made[0].n, [1], len(made[0].tokens), 1).links(made[0], pct)


def test_hot_tokens_in_blocks(spark, monkeypatch):
    """A token of many sets is dealt over blocks of both sides, and no pair of them is missed."""
    monkeypatch.setattr(J, "BLOCK", 3)
    rng = random.Random(8)
    labels = [rng.randrange(9) for _ in range(40)]
    rows = [(bytes([i]), 20, t, p, bytes([100 + labels[i]])) for i in range(40) for t, p in ((7, 0), (8 + i % 2, 1))] + [(bytes([99]), 200, 7, 0, bytes([99]))]
    df = spark.createDataFrame(rows, "sig binary, n long, token long, pos long, label binary")
    got = {(r.a[0], r.b[0]) for r in J._meetings(df, 75, 4).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if labels[i] != labels[j]}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    rows = connected_components(df).collect()
    assert {r.node: r.label for r in rows} == want and len(rows) == len(want)
    assert connected_components(df.limit(0)).count() == 0


def test_fingerprints(documents, nasty):
    for df in (documents, nasty):
        rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
        order = sorted(((-(2**63) if r.doc_id is None else r.doc_id), r.text.encode()) for r in rows)[::-1]
        want = collections.Counter()
        for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
            t, after = t.decode(), after.decode()
            k = len(t) // 3
            want[(None if i == -(2**63) else i, len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest())] += 1
        out = S.simhash_edited(df).collect()
        assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
        prints = np.array([int(r.fingerprint, 16) for r in out], np.uint64)
        assert [r.n_near for r in out] == [int((np.bitwise_count(prints ^ p) <= 3).sum()) - 1 for p in prints]
        assert all(0 <= r.near_edited <= 1 and r.near_edited == 1 - bin(int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).count("1") / 64 for r in out)
    by_text = collections.defaultdict(set)
    text = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    for r in S.simhash_edited(documents).collect():
        by_text[text[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprint_votes(spark):
    """The lanes' sums against votes one by one."""
    df = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog the quick fox")], "id long, text string")
    w = df.first().text.split()
    terms = spark.createDataFrame([(w[i], w[i + 1] if i + 1 < len(w) else None) for i in range(len(w))], "a string, b string")
    votes = [0] * 64
    for r in terms.select("a", "b", F.xxhash64("a", "b").alias("h")).collect():
        for i in range(64):
            votes[i] += (1 if r.h >> i & 1 else -1) * (len(r.a) + len(r.b or ""))
    want = sum(1 << i for i in range(64) if votes[i] > 0)
    assert S.fingerprints(df, ["id"], "text").first().fp & (2**64 - 1) == want


@pytest.mark.parametrize("radius, blocks", [(0, 3), (1, 4), (3, 6), (5, 8)])
def test_near_fingerprints(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(30)]
    all_ = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(8)] + base
    signed = [x - (1 << 64) if x >> 63 else x for x in all_]
    want = {(a, b) for a in set(signed) for b in set(signed) if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= radius}
    rows = S.near_fingerprints(spark.createDataFrame([(x,) for x in [*signed, None]], "fp long"), radius, blocks).collect()
    assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want)


def test_single_and_empty(spark, nothing):
    assert S.simhash_edited(nothing).count() == 0
    r = S.simhash_edited(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_join_by_key(spark, tmp_path):
    rows = spark.range(6000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id = 1 THEN NULL ELSE concat('k', id) END AS k")
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    rows.where("k <> 'k2'").groupBy("k").agg(F.count("*").alias("size"), F.min("id").alias("least")).write.parquet(f"{tmp_path}/values")
    out = join_by_key(rows, spark.read.parquet(f"{tmp_path}/values"), "k", "id")
    assert out.columns == ["id", "k", "least"]
    got = {r.id: r.least for r in out.collect()}
    assert len(got) == out.count() == 6000
    assert got == {i: 0 if i % 3 == 0 else None if i in (1, 2) else i for i in range(6000)}
