"""Hashes, pairs and groups against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lumaforge.operators import components, hamming, skew
from lumaforge.operators import perceptual as ph


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def frame(spark, values):
    return spark.createDataFrame([(i, signed(v)) for i, v in enumerate(values)], "img_id bigint, h bigint")


def distance(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def greedy(values, t):
    """Sequential rule: first unused leads, later unused within t of the leader join."""
    used, out = set(), {}
    for i, v in enumerate(values):
        if i in used:
            continue
        members = [j for j in range(i, len(values)) if j not in used and distance(v, values[j]) <= t]
        used.update(members)
        if len(members) > 1:
            out[i] = members
    return out


def groups(spark, values, t, **kw):
    rows = ph.duplicate_groups(frame(spark, values), t, **kw).collect()
    out = {}
    for r in rows:
        assert r.distance == distance(values[r.leader_id], values[r.member_id])
        out.setdefault(r.leader_id, []).append(r.member_id)
    return {k: sorted(v) for k, v in out.items()}


def clustered(seed, n=120):
    rnd = random.Random(seed)
    centers = [rnd.getrandbits(64) for _ in range(5)]
    out = []
    for _ in range(n):
        v = rnd.choice(centers) if rnd.random() < 0.8 else rnd.getrandbits(64)
        for _ in range(rnd.randrange(0, 7)):
            v ^= 1 << rnd.randrange(64)
        out.append(v)
    # A third of the images are copies of one hash.
    return out + [out[3]] * (n // 2)


@pytest.mark.parametrize("limit,depth", [(2000, 3), (3, 3), (3, 1)])
@pytest.mark.parametrize("threshold", [0, 5, 11])
def test_groups_equal_sequential_scan(spark, threshold, limit, depth):
    """With no component small enough for one task, the parallel rounds decide."""
    values = clustered(threshold)
    got = groups(spark, values, threshold, bucket_limit=limit, max_depth=depth, component_rows=0)
    assert got == greedy(values, threshold)


@pytest.mark.parametrize("component_rows", [3, 50_000])
@pytest.mark.parametrize("threshold", [0, 5, 16, 30])
def test_groups_by_components_equal_sequential_scan(spark, threshold, component_rows):
    values = clustered(threshold + 1)
    assert groups(spark, values, threshold, component_rows=component_rows) == greedy(values, threshold)


def drifting(n, seed=4):
    """Each hash differs from the one before in three bits that it does not share with the one before that."""
    rnd, out, last = random.Random(seed), [0], []
    while len(out) < n:
        bits = rnd.sample([b for b in range(64) if b not in last], 3)
        out.append(out[-1] ^ sum(1 << b for b in bits))
        last = bits
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("shuffled", [False, True])
def test_chain_of_drifting_hashes_takes_logarithmic_rounds(spark, shuffled):
    values = drifting(2000)
    if shuffled:
        random.Random(1).shuffle(values)
    distinct = ph.cut_lineage(ph.distinct_hashes(frame(spark, values)))
    rounds = []
    got = {r.ord: r.leader for r in ph.find_leaders(distinct, 3, small_edges=0, rounds=rounds).collect()}
    want = {m: lead for lead, members in greedy(values, 3).items() for m in members if m != lead}
    assert got == want and len(rounds) <= 12


@pytest.mark.parametrize("small", [0, 1000])
def test_components_of_a_star_a_ring_and_a_path(spark, small):
    edges = [(0, k) for k in range(1, 30)] + [(100 + k, 100 + (k + 1) % 40) for k in range(40)] + [(500 - k, 499 - k) for k in range(60)] + [(7, 7)]
    frame_ = ph.cut_lineage(spark.createDataFrame(edges, "a long, b long"))
    got = {r.id: r.component for r in components.connected(frame_, small).collect()}
    want = {k: 0 for k in range(30)} | {100 + k: 100 for k in range(40)} | {500 - k: 440 for k in range(61)}
    assert got == want


@pytest.mark.parametrize("threshold,tile", [(5, 4096), (5, 2), (0, 4096), (16, 4096), (16, 3), (22, 50)])
def test_pairs_equal_brute_force_once_each(spark, threshold, tile):
    values = list(dict.fromkeys(clustered(7)))
    distinct = ph.distinct_hashes(frame(spark, values)).cache()
    rows = ph.similar_pairs(distinct, threshold, tile).collect()
    distinct.unpersist()
    want = sorted(
        (i, j, distance(values[i], values[j]))
        for i in range(len(values)) for j in range(i + 1, len(values)) if distance(values[i], values[j]) <= threshold
    )
    assert sorted((r.a, r.b, r.distance) for r in rows) == want


@pytest.mark.parametrize("threshold", [0, 1, 5, 16, 22, 40, 63])
def test_chunks_miss_no_pair(threshold):
    """Whatever the number of hashes, two within the threshold meet in some chunk within its radius."""
    rnd = random.Random(threshold)
    for n in (10, 10**5, 10**7, 10**9):
        chunks = hamming.chunking(threshold, n)
        assert sum(c.near for c in chunks) <= hamming.MOST_KEYS
        for _ in range(200):
            apart = sum(1 << b for b in rnd.sample(range(64), threshold))
            assert any(bin(apart & c.mask).count("1") <= c.radius for c in chunks)


def test_wide_chunks_spare_candidates(spark):
    """At a threshold of 16, a quarter of the comparisons of all with all, and less than bands of four bits give."""
    chunks = hamming.chunking(16, 10**6)
    share = sum(c.near / 2**c.width for c in chunks)
    assert share < 0.3 and min(c.width for c in chunks) >= 8
    assert hamming.chunking(5, 10**9)[0].width >= 20


def test_salted_joins_equal_plain_ones(spark):
    big = spark.createDataFrame([(k % 7 if k % 3 else 0, k, {"a": k}) for k in range(300)], "key long, v long, m map<string,long>")
    counts = big.groupBy("key").agg(F.count("*").alias("n")).where("key != 5").withColumn("name", F.concat(F.lit("k"), "key"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = skew.join_counted(big, counts, ["key"], "n", how, hot_rows=10)
        plain = big.join(counts.drop("n"), ["key"], how)
        assert salted.columns == plain.columns
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))
    text = skew.join_counted(big, counts, ["key"], "n", hot_rows=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in text and "broadcast" not in text.lower()


def test_small_blocks_and_hot_keys_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ph, "BLOCK_ROWS", 2)
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    values = clustered(9)
    assert groups(spark, values, 6, bucket_limit=2, max_depth=2, component_rows=4) == greedy(values, 6)


def test_not_connected_components(spark):
    a, b, c = 0, 0b11111, 0b1111111111
    assert groups(spark, [a, b, c], 5) == {0: [0, 1]}


def test_literal_groups(spark):
    values = [0, 1, (1 << 64) - 1, 0xFFFFFFFFFFFFFF0F]
    assert groups(spark, values, 5) == {0: [0, 1], 2: [2, 3]}


def test_no_groups(spark):
    assert groups(spark, [0, (1 << 64) - 1], 5) == {}
    assert ph.duplicate_groups(frame(spark, [0]).where("false")).count() == 0


def test_exact_duplicates(spark):
    rows = ph.exact_duplicates(frame(spark, [5, 6, 5, 5])).collect()
    assert sorted((r.first_id, r.n, r.member_id) for r in rows) == [(0, 3, 0), (0, 3, 2), (0, 3, 3)]


def test_distance_and_text(spark):
    texts = ["0000000000000000", "0000000000000001", "000000000000000f", "ffffffffffffffff", "abc", "zzzzzzzzzzzzzzzz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("h", ph.parse_hash(F.col("t")))
    got = {r.t: (r.d, r.x) for r in df.select(
        "t", ph.hamming_distance(F.lit(0).cast("long"), F.col("h")).alias("d"), ph.hash_hex(F.col("h")).alias("x")
    ).collect()}
    assert [got[t][0] for t in texts] == [0, 1, 4, 64, None, None]
    assert all(got[t][1] == t for t in texts[:4])
    one = df.where("t = '0000000000000001'").select(ph.similarity(F.lit(0).cast("long"), F.col("h"))).first()[0]
    assert 0.9 < one < 1.0


def test_flat_image_hashes_to_ones(spark):
    px = spark.range(1).selectExpr(
        "id AS img_id", "12 AS w", "10 AS h", "explode(sequence(0, 119)) AS k"
    ).selectExpr("img_id", "w", "h", "k % 12 AS x", "cast(k div 12 AS int) AS y", "7 AS r", "7 AS g", "7 AS b")
    row = ph.average_hash(px).select(ph.hash_hex(F.col("h"))).first()
    assert row[0] == "ffffffffffffffff"


@pytest.mark.parametrize("threshold,rows", [(0, 7), (5, 7), (16, 50), (22, 20), (30, 1000), (63, 5)])
def test_leaders_of_prefixes_equal_sequential_scan(spark, threshold, rows):
    """In rounds over the first open hashes, whether few of them lead or all."""
    rnd = random.Random(threshold)
    values = list(dict.fromkeys(clustered(threshold + 2) + [rnd.getrandbits(64) for _ in range(60)]))
    distinct = ph.cut_lineage(ph.distinct_hashes(frame(spark, values)))
    got = {r.ord: r.leader for r in ph.lead_prefixes(distinct, threshold, rows).collect()}
    assert got == {m: lead for lead, members in greedy(values, threshold).items() for m in members if m != lead}


def test_dense_groups_look_for_no_links(spark, monkeypatch):
    """At a wide threshold a few rounds over leaders replace the comparison of all with all; narrow ones still link."""
    monkeypatch.setattr(hamming, "linking_edges", None)
    rnd = random.Random(8)
    values = list(dict.fromkeys(rnd.getrandbits(64) for _ in range(3000)))
    distinct = ph.cut_lineage(ph.distinct_hashes(frame(spark, values)))
    got = {r.ord: r.leader for r in ph.find_leaders(distinct, 22, prefix_rows=1000).collect()}
    assert got == {m: lead for lead, members in greedy(values, 22).items() for m in members if m != lead}
    rounds = []
    ph.lead_prefixes(distinct, 22, 1000, rounds).count()
    assert len(rounds) <= 3 and sum(rounds) < 1000
    assert hamming.in_squares(22, 740_000) and not hamming.in_squares(5, 740_000)


@pytest.mark.parametrize("threshold,tile", [(0, 3), (5, 2), (16, 40), (22, 1000)])
@pytest.mark.parametrize("gain", [30, 1e-9])
def test_squares_and_chunks_find_the_same_pairs(spark, monkeypatch, threshold, tile, gain):
    monkeypatch.setattr(hamming, "SQUARE_GAIN", gain)
    values = list(dict.fromkeys(clustered(9)))
    distinct = ph.cut_lineage(ph.distinct_hashes(frame(spark, values)))
    assert hamming.in_squares(threshold, len(values)) == (gain > 1)
    want = sorted(
        (i, j, distance(values[i], values[j]))
        for i in range(len(values)) for j in range(i + 1, len(values)) if distance(values[i], values[j]) <= threshold
    )
    assert sorted((r.a, r.b, r.distance) for r in ph.similar_pairs(distinct, threshold, tile).collect()) == want


def test_copies_of_a_row_in_squares_do_not_grow_with_the_rows():
    """At a threshold of 16 a hash is shuffled once per part, not under hundreds of keys."""
    assert hamming.in_squares(16, 123_000) and hamming.in_squares(16, 740_000)
    assert hamming.parts_of(10**4, 12) == hamming.parts_of(10**7, 12) == hamming.PARTS
    assert 10**9 / hamming.parts_of(10**9, 12) <= hamming.PART_ROWS
