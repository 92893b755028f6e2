"""Against brute force: all pairs of sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from documents_fixture import documents  # noqa: F401
from postlens.llm import setjoin, shingles
from postlens.llm.components import components


def word_sets(text, width):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = [word_sets(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i, (id_, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(id_)
    low = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((id_, len(sets[i]), low[find(i)] if sets[i] else id_) for i, (id_, _) in enumerate(rows)), key=repr)


def families(seed, n_base, copies, length, vocabulary=3000):
    """Bases with copies of growing distance: words replaced, ends cut, passages shared between families."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for b in range(n_base):
        base = [rng.choice(words) for _ in range(length)]
        if b % 2:
            base[10:70] = passage
        for c in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + length // 40)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if c % 3 == 1:
                text = text[: len(text) - rng.randrange(1, length // 5)]
            if c % 5 == 2:
                text = text[rng.randrange(1, length // 8) :]
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ODD = [
    (900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE "), (905, "one two"), (906, "one\ttwo"), (907, "two one"),
    (908, "É one two three"), (909, "é one two three"), (None, "one two"), (None, None), (910, "a b c d e f"), (910, "a b c d e f"),
    (911, "w " * 3000), (912, "w " * 4000), (None, "alone in the world"),
]


@pytest.mark.parametrize("width,percent,seed", [(4, 85, 1), (5, 80, 2), (3, 95, 3)])
def test_components_match_brute_force(documents, width, percent, seed):
    rows = families(seed, 4, 14, 130) + families(seed + 10, 6, 4, 30) + ODD
    assert found(setjoin.similar_groups(documents(rows), width, percent)) == brute(rows, width, percent)


def test_split_lists_and_pivots_lose_nothing(documents, monkeypatch):
    """Bounds so small that lists go out in pieces and pivots are met in several places."""
    monkeypatch.setattr(setjoin, "SPLIT_PIVOT", 3)
    rows = families(5, 2, 40, 100)
    assert found(setjoin.similar_groups(documents(rows), 4, 85)) == brute(rows, 4, 85)


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_blocks_of_lists_lose_no_pair(spark, monkeypatch, percent):
    """Every pair that sizes and positions allow meets exactly once, whether its list is cut into blocks or not."""
    rng = random.Random(percent)
    join = setjoin._Join.__new__(setjoin._Join)
    join.similarity = setjoin.Similarity(percent)
    entries = [
        (token, star, n, rng.randrange(9), rng.randrange(max(1, n * percent // 100 - 3), n + 1), size)
        for token, size in ((1, 300), (2, 40), (3, 2)) for star in range(size) for n in [rng.choice([1, 2, 7, 100, 101, rng.randrange(1, 900)])]
    ]
    kind = "token long, star long, n int, root long, rest int, length long"
    expected = sorted(
        (x[0], x[1], y[1], x[2], y[2]) for x in entries for y in entries
        if x[0] == y[0] and x[1] < y[1] and x[3] != y[3] and 100 * min(x[2], y[2]) >= percent * max(x[2], y[2])
        and (100 + percent) * min(x[4], y[4]) >= percent * (x[2] + y[2])
    )
    for long_list in (0, 64, 10_000):
        monkeypatch.setattr(setjoin, "LONG_LIST", long_list)
        assert sorted(map(tuple, join.meeting(spark.createDataFrame(entries, kind)).collect())) == expected


def test_blocks_skip_most_pairs_of_a_long_list(spark):
    """A passage that unlinked sets of many sizes share at many positions: few pairs meet that sizes and positions rule out."""
    join = setjoin._Join.__new__(setjoin._Join)
    join.similarity = setjoin.Similarity(85)
    for size in (500, 4000):
        rng = random.Random(1)
        sizes = [rng.randrange(40, 40 + size) for _ in range(size)]
        entries = [(1, i, n, i, n if i % 2 else rng.randrange(n * 85 // 100, n) + 1, size) for i, n in enumerate(sizes)]
        rows = spark.createDataFrame(entries, "token long, star long, n int, root long, rest int, length long")
        met, allowed = (join.meeting(rows, filtered=f).count() for f in (False, True))
        assert met < size * (size - 1) / 2 * 0.15 and met < 3 * allowed


def test_one_copy_of_a_hot_set_is_compared(documents, monkeypatch):
    """Although the bitmap lets all rows pass, a set that many rows have comes out of one of them."""
    monkeypatch.setattr(setjoin, "_wanted", lambda ids: np.full(1 << (setjoin.FILTER_BITS - 6), -1, np.int64))
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(300)] + [(300 + i, " ".join([*base, *"xyz"[: i + 1]])) for i in range(3)] + ODD
    docs = documents(rows).select(F.col("doc_id").alias("row"), "text")
    join = setjoin._Join(docs, 4, 85)
    sids = {r.n: r.sid for r in join.rows.where("row >= 299 and row < 303").collect()}
    pairs = docs.sparkSession.createDataFrame([(sids[58], sids[57], 1.0), (sids[59], sids[57], 1.0)], "a long, b long, reach double")
    named = join.rows.where("sid is not null").groupBy("sid").agg(F.min("row").alias("row"))
    assert join._together(pairs, named, False).count() == 3
    assert join.compared(pairs).count() == 2
    assert found(setjoin.similar_groups(documents(rows), 4, 85)) == brute(rows, 4, 85)


def test_a_long_list_in_pieces_keeps_single_entries(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(setjoin, "SPLIT_LIST", 2)
    n = 40
    batches = [
        setjoin._batch(
            token=np.full(4, 7), split=np.full(4, -1, np.int32), sid=np.arange(i, i + 4) // 20, place=np.full(4, (3 << 32) | 50)
        )
        for i in range(0, n, 4)
    ]
    out = pa.Table.from_batches(list(setjoin._lists(setjoin.Similarity(85))(iter(batches)))).to_pydict()
    assert set(out["sid"]) == {0, 1}


def test_empty_table(documents):
    assert found(setjoin.similar_groups(documents([]))) == []


def test_shingles_do_not_depend_on_the_batch():
    texts = [b"A b  c d e", None, b"", b"a B c", b"x " * 900, "é ü".encode()]
    whole = shingles.shingle_sets(texts, 4)
    for text, expected in zip(texts, whole):
        assert (shingles.shingle_sets([text], 4)[0] == expected).all()
    assert len({shingles.set_id(s) for s in whole}) == 5  # two are empty


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (None, 3)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 200)}


def test_one_row_of_each_group_stays(spark):
    """Ids that are null or repeat: every text stays once."""
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    rows = [(1, text), (1, text), (None, text), (None, text), (5, text + " tail"), (5, other), (7, other)]
    rows += [(None, other + " more"), (8, None), (8, None), (9, " "), (None, "a b"), (None, "a b"), (3, "A  B")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_row": F.lit(1), "id": F.lit(2), "component_id": F.lit(3)})
    out = setjoin.one_of_each_group(docs)
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert kept == sorted([(1, text), (5, other), (8, None), (8, None), (9, " "), (3, "A  B")], key=repr)
    assert setjoin.one_of_each_group(docs.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, text)] * 3, "doc_id long, text string")
    assert setjoin.one_of_each_group(nameless).count() == 1


@pytest.fixture
def many_partitions(spark):
    """Seven shuffle partitions that stay apart, whatever little they hold."""
    values = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_the_bitmap_takes_a_job_not_one_for_each_partition(spark, many_partitions):
    ids = [*range(0, 5000, 7), None]
    df = spark.createDataFrame([(i,) for i in ids], "row long")
    context = spark.sparkContext
    context.setJobGroup("bitmap", "the bitmap of wanted rows")
    try:
        bits = setjoin._wanted(df)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("bitmap")) <= 2  # its shuffle and its rows
    places = [r.h for r in df.select(F.xxhash64("row").alias("h")).collect()]
    expected = np.zeros(1 << (setjoin.FILTER_BITS - 6), np.uint64)
    for h in places:
        expected[(h % (1 << setjoin.FILTER_BITS)) >> 6] |= np.uint64(1 << (h & 63))
    assert (bits.view(np.uint64) == expected).all()
    assert not setjoin._wanted(df.limit(0)).any()


def test_the_driver_gets_levels_of_the_sketch_not_parts_of_it(spark, many_partitions, monkeypatch):
    texts = [" ".join(f"w{i} v{j}" for j in range(40)) for i in range(60)] + ["a b c d"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(5)
    join = setjoin._Join(docs, 4, 85)
    got = []
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: got.extend(rows := collect(self)) or rows)
    level, heavy, ways = setjoin._sketch(join.profile, join.tasks)
    assert sum(len(x) for r in got for x in r if isinstance(x, (bytes, bytearray))) == 2 << setjoin.SKETCH_BITS
    shingle = np.concatenate(shingles.shingle_sets([t.encode() for t in texts], 4))
    counts = np.bincount((shingle >> np.uint64(64 - setjoin.SKETCH_BITS)).astype(np.int64), minlength=1 << setjoin.SKETCH_BITS)
    assert (level == (np.log2(counts + 1.0) * 64).astype(np.uint16)).all()
    assert not len(heavy) and not len(ways)


def test_the_sketch_names_lists_that_are_split(spark):
    size = (1 << setjoin.SKETCH_BITS) // setjoin._BLOCKS
    block = np.full(size, 3, np.int64)
    block[5], block[9] = 2 * setjoin.SPLIT_LIST + 20, 2 * setjoin.SPLIT_LIST - 1
    blocks = [(k, bytearray((block if k == 2 else np.full(size, 3, np.int64)).tobytes())) for k in range(setjoin._BLOCKS)]
    level, heavy, ways = setjoin._sketch(spark.createDataFrame(blocks, "n int, sketch binary"), 3)
    assert heavy.tolist() == [2 * size + 5] and ways.tolist() == [2]
    assert level[0] == 128 and level[2 * size + 5] == level[2 * size + 9] == int(64 * np.log2(2 * setjoin.SPLIT_LIST))
