import random

from pyspark.sql import functions as F

from leafpress.operators import editing as E
from leafpress.operators import reading as R
from leafpress.operators import structure as S


def test_pairing_equals_a_stack(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for flow in range(20):
        stack = []
        for pos in range(60):
            m = rng.choice("BEx")
            rows.append((flow, pos, m))
            if m == "B":
                stack.append(pos)
            elif m == "E":
                want.add((flow, stack.pop() if stack else None, pos))
        want |= {(flow, b, None) for b in stack}
    df = spark.createDataFrame(rows, "flow int, pos long, m string")
    got = S.pair_nested(df, F.col("m") == "B", F.col("m") == "E", ["flow"]).select("flow", "begin_pos", "end_pos").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_list_counters(spark):
    rng = random.Random(5)
    rows, want = [], []
    for lst in range(10):
        counts = [0] * 10
        for pos in range(50):
            level = rng.randint(1, 4)
            counts[level] += 1
            for deeper in range(level + 1, 10):
                counts[deeper] = 0
            rows.append((lst, pos, level))
            want.append((lst, pos, counts[level]))
    df = S.list_counters(spark.createDataFrame(rows, "lst int, pos long, level int"), ["lst"])
    assert sorted(tuple(r) for r in df.select("lst", "pos", "counter").collect()) == want


def test_chapters(spark):
    rng = random.Random(7)
    heads = [(0, i, rng.randint(1, 5), 40) for i in sorted(rng.sample(range(40), 25))]
    got = {r.block_ix: (r.parent_ix, r.end_ix) for r in R.chapters(spark.createDataFrame(heads, "doc_id int, block_ix long, level int, n_blocks long")).collect()}
    for _, i, level, n in heads:
        parents = [j for _, j, k, _ in heads if j < i and k < level]
        ends = [j for _, j, k, _ in heads if j > i and k <= level]
        assert got[i] == (max(parents, default=None), min(ends, default=n))


def test_budget_prefix(spark):
    df = spark.createDataFrame([(1, 0, "x" * 10), (1, 1, "y" * 10), (2, 0, "z" * 600)], "doc_id int, block_ix long, text string").withColumn("n16", F.length("text").cast("long"))
    got = {r.doc_id: (r.next_ix, r.units, r.used16, r.error) for r in R.budget_prefix(df, 15, 512).collect()}
    assert got == {1: (1, 1, 10, None), 2: (0, 0, 600, "budget too small")}


def test_find_offsets(spark):
    import re

    texts = ["ab12cd3", "", "1", "no digits", "9x9", "😀7😀"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted((r.doc_id, r.start, r.match) for r in R.find_regex(df, "[0-9]+", ["doc_id"]).collect())
    assert got == [(i, m.start(), m.group()) for i, t in enumerate(texts) for m in re.finditer("[0-9]+", t)]


def test_merge_intervals(spark):
    df = spark.createDataFrame([(1, 0, 3), (1, 2, 5), (1, 7, 9), (1, 5, 6), (2, 1, 2)], "k int, start long, end long")
    assert sorted(tuple(r) for r in R.merge_intervals(df, ["k"]).collect()) == [(1, 0, 6, 3), (1, 7, 9, 1), (2, 1, 2, 1)]


def test_style_chain_stops_at_cycles_and_kinds(spark):
    df = spark.createDataFrame([("a", "b", "p"), ("b", "c", "p"), ("c", "a", "p"), ("x", "c", "r"), ("y", "none", "p")], "style_id string, based_on string, kind string")
    got = {}
    for r in S.style_chain(df).collect():
        got.setdefault(r.style_id, {})[r.distance] = r.ancestor
    assert got == {"a": {0: "a", 1: "b", 2: "c"}, "b": {0: "b", 1: "c", 2: "a"}, "c": {0: "c", 1: "a", 2: "b"}, "x": {0: "x"}, "y": {0: "y"}}


def test_unreachable(spark):
    nodes = spark.createDataFrame([(1, i) for i in "abcde"], "doc_id int, id string")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "d", "e"), (1, "c", "a")], "doc_id int, source string, target string")
    roots = spark.createDataFrame([(1, "a")], "doc_id int, id string")
    assert sorted(r.id for r in S.unreachable(nodes, edges, roots).collect()) == ["d", "e"]


def test_insert_then_delete_is_nothing(spark):
    df = spark.createDataFrame([(1, 0, "a😀bc"), (1, 1, "")], "doc_id int, block_ix long, text string")
    there = E.insert_text(df, F.lit(3), F.lit("XY"), F.col("block_ix") == 0)
    assert there.where("block_ix = 0").first().text == "a😀XYbc"
    back = E.delete_range(there, F.lit(3), F.lit(5), F.col("block_ix") == 0)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_toggle(spark):
    rows = [(1, True, None, None), (1, True, None, None), (2, True, None, None), (3, None, False, None), (3, True, None, None), (4, None, None, True), (5, None, None, None)]
    df = spark.createDataFrame(rows, "run int, flag boolean, direct boolean, fallback boolean")
    got = {r.run: (r.value, r.source) for r in S.toggle(df, ["run"], "flag", "direct", "fallback").collect()}
    assert got == {1: (False, "styles"), 2: (True, "styles"), 3: (False, "direct"), 4: (True, "defaults"), 5: (False, "none")}


def test_unreachable_follows_long_chains(spark):
    nodes = spark.range(82).selectExpr("1 as doc_id", "id")
    edges = spark.range(79).selectExpr("1 as doc_id", "id as source", "id + 1 as target")
    assert sorted(r.id for r in S.unreachable(nodes, edges, nodes.where("id = 0")).collect()) == [80, 81]


def test_style_chain_follows_long_chains(spark):
    rows = [(f"s{i}", f"s{i + 1}", "p") for i in range(39)] + [("s39", None, "p")]
    got = S.style_chain(spark.createDataFrame(rows, "style_id string, based_on string, kind string")).where("style_id = 's0'").collect()
    assert sorted((r.distance, r.ancestor) for r in got) == [(i, f"s{i}") for i in range(40)]


def test_queries_call_their_operators(spark, sf, monkeypatch):
    from leafpress import catalogue
    from leafpress.functions import values as V

    called = []
    for module, name in ((S, "accepted"), (S, "pair_ranges"), (V, "mean_colour")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name, **b: called.append(n) or f(*a, **b))
    for name in ("accept_revisions", "orphan_spans", "gradient_stops"):
        catalogue.QUERIES[name](spark, sf)
    assert called == ["accepted", "pair_ranges", "mean_colour"]


def test_many_hits(spark):
    """Places and contexts of hits far beyond a context's pieces, and a text of 100,000 hits in linear time."""
    import random
    import re
    import time

    from leafpress.operators import reading

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab cd" if i % 2 else "a") * rng.choice((1, 1, 3)) for _ in range(rng.randint(0, 300))) for i in range(30)] + ["", None, "no such", "é😀a漢a", "ab " * 40 + "x" * 100 + "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, texts[1])], "k int, text string")
    for pattern in ("a+", "[ab] ?", "a"):
        want = []
        for i, t in [*enumerate(texts), (1, texts[1])]:
            want += [(i, n, m.group(), m.start(), t[max(0, m.start() - 40) : m.start()], t[m.end() : m.end() + 40]) for n, m in enumerate(re.finditer(pattern, t or ""))]
        assert sorted(map(tuple, reading.find_regex(df, pattern, ["k"]).collect())) == sorted(want)
    began = time.time()
    many = spark.createDataFrame([(0, "cat dog " * 100_000)], "k int, text string")
    assert reading.find_regex(many, "dog", ["k"]).agg(F.max("start")).first()[0] == 8 * 99_999 + 4
    assert time.time() - began < 60
