"""WARC archives, shards, batches and nearest vectors."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import itertools
import random
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from documents_fixture import documents  # noqa: F401
from postlens.llm import neighbours, packing, sharding, warc

PAGES = "page_id long, url string, html string"


def _pages():
    big, odd = "é" * 700 + "x" * 40_000, "\r\n\r\nWARC/1.1\r\n\r\n" * 100
    return [
        (1, None, None), (2, "a\r\nb", ""), (3, "u", odd), (4, "u", odd), (5, "u", big), (5, "u", big), (6, "v", big), (None, "w", big),
        (7, "v", "z" * 999), (8, "v", "z" * 999), (None, "q", "y" * 2000), (None, "q", "y" * 2000), (9, "u", "a" * 16_300), (10, "u", "b" * 200_000),
    ]


def test_archives_round_trip(spark):
    rows = _pages()
    groups = collections.defaultdict(list)
    for page, _, html in rows:
        groups[html or ""].append(page)
    expected = []
    for page, _, html in rows:
        data, ids = (html or "").encode(), [i for i in groups[html or ""] if i is not None]
        revisit = len(data) >= 1000 and bool(ids) and page != max(ids)
        kind, to = ("revisit", max(ids)) if revisit else ("response", None)
        expected.append((page, len(data), hashlib.sha1(data).hexdigest(), kind, to, None))
    pages = spark.createDataFrame(rows, PAGES).withColumns({"digest": F.lit(1), "payload": F.lit("x"), "uri": F.lit(2)})
    for settings in ({}, {"segment": 100, "chunk": 7}):
        found = warc.round_trip(pages, **settings).drop("uri").collect()
        assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_payloads_come_back_and_archives_are_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "é" * 9000), (2, "v", "short")], PAGES)
    warc.write_pages(pages, str(tmp_path / "w"), segment=500)
    found = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert found == {1: "é" * 9000, 2: "short"}
    files = [p for p in (tmp_path / "w").iterdir() if p.suffix == ".txt"]
    assert all(f["content-length"] == str(len(b)) for p in files for f, b in warc.parsed(p.read_bytes()))
    (tmp_path / "z").mkdir()
    for p in files:
        data = p.read_bytes()
        (tmp_path / "z" / f"{p.stem}.gz").write_bytes(gzip.compress(data[:0]) + gzip.compress(data))
    assert warc.read_archives(spark, str(tmp_path / "z")).count() == 2


def test_damage_is_reported(spark, tmp_path):
    def record(kind, name, block, **fields):
        lines = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{name}>", **{k.replace("_", "-"): v for k, v in fields.items()}}
        head = "".join(f"{k}: {v}\r\n" for k, v in lines.items())
        return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    part = {"WARC_Segment_Origin_ID": "<urn:uuid:s>"}
    (tmp_path / "a.warc").write_bytes(
        record("response", "ok", http + b"3;x=y\r\nabc\r\n0\r\n\r\n") + record("response", "cut", http + b"9\r\nabc\r\n0\r\n\r\n")
        + record("response", "sum", http + b"0\r\n\r\n", WARC_Payload_Digest="sha1:00")
        + record("continuation", "s3", b"c", WARC_Segment_Number=3, WARC_Segment_Total_Length=3, **part)
        + record("response", "s", b"a", WARC_Segment_Number=1)
        + record("response", "t", b"HTTP/1.1 200 OK\r\n\r\nab", WARC_Segment_Number=1)
        + record("continuation", "t2", b"c", WARC_Segment_Number=2, WARC_Segment_Total_Length=99, WARC_Segment_Origin_ID="<urn:uuid:t>")
        + record("revisit", "r", b"", WARC_Refers_To="<urn:uuid:nowhere>") + record("warcinfo", "i", b"x")
    )
    records = warc.read_archives(spark, str(tmp_path))
    found = {r.record_id: r for r in records.collect()}
    assert bytes(found["ok"].payload) == b"abc" and found["ok"].error is None
    assert found["cut"].error.startswith("framing") and found["sum"].error == "digest"
    assert found["s"].error == "segment missing" and found["t"].error == "22 of 99 bytes"
    assert [r.error for r in warc.resolved(records).where("record_type = 'revisit'").collect()] == ["reference"]


def test_damaged_headers_are_rows(spark, tmp_path):
    """Every damaged record is one row with its error; the records around it are read."""
    def record(name, lines, block=b"HTTP/1.1 200 OK\r\n\r\nab", length=None):
        own = "".join(f"{x}\r\n" for x in [f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Type: response", *lines])
        size = f"Content-Length: {len(block)}\r\n" if length is None else length
        return f"WARC/1.0\r\n{own}{size}\r\n".encode() + block + b"\r\n\r\n"

    sha1 = base64.b32encode(hashlib.sha1(b"ab").digest()).decode()
    parts = [
        record("a", []), record("b", [], length=""), record("c", [], length="Content-Length: many\r\n"), record("d", ["Page-Id: seven"]),
        record("e", ["WARC-Segment-Number: x"]), record("f", ["Page-Id: -3", f"WARC-Payload-Digest: sha1:{sha1}"]),
        record("g", [], length="Content-Length: 999999\r\n"), record("h", ["WARC-Payload-Digest: sha256:00"]), b"some bytes\r\n\r\n",
        record("i", ["WARC-Segment-Number: 1", "WARC-Segment-Total-Length: 99999999999999999999"]), record("j", [])[:-9],
    ]
    expected = {
        "a": None, "b": "header: content-length", "c": "header: content-length", "d": "header: page-id", "e": "header: warc-segment-number",
        "f": None, "g": "cut off", "h": None, None: "no record", "i": "segment missing", "j": "cut off",
    }
    data = b"".join(parts)
    packed = b"".join(map(gzip.compress, parts))
    for name, content in (("x.warc", data), ("y.warc.gz", packed), ("z.warc.gz", packed[:-15]), ("empty.warc", b""), ("text", b"hello")):
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_bytes(content)
    for folder in ("x.warc", "y.warc.gz"):
        rows = warc.read_archives(spark, str(tmp_path / folder)).collect()
        assert {r.record_id: r.error for r in rows} == expected and len(rows) == len(parts)
        assert {r.record_id: r.page_id for r in rows if r.record_id in ("a", "d", "f")} == {"a": None, "d": None, "f": -3}
        assert {bytes(r.payload) for r in rows if r.error is None} == {b"ab"}
        assert warc.resolved(warc.read_archives(spark, str(tmp_path / folder), payloads=False)).count() == len(parts)
    assert {r.record_id for r in warc.read_archives(spark, str(tmp_path / "z.warc.gz")).collect()} >= set("abcdefghi")
    assert warc.read_archives(spark, str(tmp_path / "empty.warc")).count() == 0
    assert [r.error for r in warc.read_archives(spark, str(tmp_path / "text")).collect()] == ["no record"]


def test_archives_are_unpacked_piece_by_piece():
    """100 MB in one gzip member or in many are read with a few megabytes."""
    block = bytes(1 << 20)
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    for data in (gzip.compress(record) * 100, gzip.compress(record * 100)):
        tracemalloc.start()
        found = sum(len(b) for _, b, error in warc.read_records(warc._plain(data)) if error is None)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == 100 << 20 and peak < 12 << 20
    plain = warc._plain(record * 3 + b"x" * 5_000_000)
    assert [(len(b), error) for _, b, error in warc.read_records(plain)] == [(1 << 20, None)] * 3 + [(0, "no record")]


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_shares_are_even_and_few_slots_move():
    names = [f"s{i}" for i in range(9)]
    table = sharding.lookup_table(names, 1009)
    counts = np.bincount(table)
    assert counts.sum() == 1009 and counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = (table != fewer) & (table != 8)
    assert moved.mean() < 0.1
    shuffled = sharding.lookup_table(names[::-1], 1009)
    assert [names[i] for i in table] == [names[::-1][i] for i in shuffled]
    weighted = np.bincount(sharding.lookup_table(["a", "b"], 1009, [3, 1]))
    assert abs(weighted[0] / weighted[1] - 3) < 0.05
    for bad in ((names, 1000), ([], 7), (["a", "a"], 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def _slot(key, part, slots):
    """Where a row goes, by a plain calculation: the hash of the key is the seed of that of the part."""
    seed = 42 if key is None else xxhash.xxh64_intdigest(key.encode(), seed=42)
    h = xxhash.xxh64_intdigest(part.to_bytes(8, "little"), seed=seed)
    return (h - (h >> 63 << 64)) % slots


def test_placing_rows(spark, documents):
    rows = [(i, "t") for i in range(2000)] + [(None, "x"), (None, "x"), (5, "t")]
    docs = documents(rows).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 50)))
    names = [f"n{i}" for i in range(8)]
    out = sharding.placed(docs, names, F.col("source"), slots=1009, spread=F.col("doc_id"), ways=64, split={"s7": 1, "s8": 3})
    table = sharding.lookup_table(names, 1009)
    found = out.collect()
    assert len(found) == len(rows) and {c.lower() for c in out.columns} == {c.lower() for c in docs.columns} | {"slot", "shard"}
    for r in found:
        h = 42 if r.doc_id is None else xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little"), seed=42)
        part = (h - (h >> 63 << 64)) % {"s7": 1, "s8": 3}.get(r.source, 64)
        assert r["slot"] == _slot(r.source, part, 1009) and r.shard == names[table[r["slot"]]]
    assert len({r.shard for r in found if r.source is None}) > 4  # a third of the rows has no source
    assert len({r.shard for r in found if r.source == "s7"}) == 1
    whole = sharding.placed(docs, names, F.col("source"), slots=1009)
    assert all(r["slot"] == _slot(r.source, 0, 1009) for r in whole.collect())
    assert sharding.placed(docs.limit(0), names, F.col("source"), slots=1009).count() == 0
    with pytest.raises(ValueError):
        sharding.placed(docs, names, F.col("source"), spread=F.col("doc_id"), ways=0)


def test_rows_keep_their_shards_when_the_table_grows(spark, documents):
    names = [f"n{i}" for i in range(16)]
    few, many = (documents([(i, "t") for i in range(n)]).withColumn("source", F.lit("s")) for n in (100, 5000))
    at = [{r.doc_id: r.shard for r in sharding.placed(d, names, F.col("source"), spread=F.col("doc_id")).collect()} for d in (few, many)]
    assert all(at[1][i] == shard for i, shard in at[0].items())
    assert max(collections.Counter(at[1].values()).values()) < 2 * 5000 / 16



def test_bounds_have_the_least_padding():
    rng = random.Random(6)
    for _ in range(20):
        lengths = sorted(rng.choices(range(1, 40), k=25))
        kinds = sorted(set(lengths))
        k = rng.randrange(1, 5)

        def padding(bounds):
            return sum(min(b for b in bounds if b >= n) - n for n in lengths)

        counts = np.array([lengths.count(n) for n in kinds])
        bounds = packing.best_bounds(np.array(kinds), counts, counts * np.array(kinds), k)
        best = min(padding([*x, kinds[-1]]) for n in range(k) for x in itertools.combinations(kinds[:-1], n))
        assert len(bounds) <= k and bounds[-1] == kinds[-1] and padding(bounds) == best


@pytest.mark.parametrize("most, padding", [(50_000, 0), (1, 50)])
def test_long_texts_have_the_least_padding_too(spark, monkeypatch, most, padding):
    monkeypatch.setattr(packing, "MOST_LENGTHS", most)
    rows = spark.createDataFrame([(i, 1000 if i < 50 else 1001) for i in range(90)], "doc_id long, n long")
    found = packing.packed(rows, F.col("n"), buckets=2).collect()
    assert len(found) == 90 and sum(r.padding for r in found) == padding


def test_bounds_do_not_depend_on_the_number_of_lengths(spark):
    """Beyond 50,000 distinct lengths the bounds still have the least padding: the lengths are halved."""
    rows = spark.range(1, 50_101).select((F.col("id") + 1_000_000).alias("n"))
    assert packing.bucket_bounds(rows, "n", 2) == [1_025_050, 1_050_100]


def test_batches(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "_PER_TASK", 40)
    rng = random.Random(7)
    rows = [(i, "w " * rng.choice([1, 3, 10, 11, 60, 400])) for i in range(500)]
    rows += [(None, None), (None, None), (3, ""), (7, " \n"), (900, "w " * 3000)]
    out = packing.packed(documents(rows), packing.word_count(F.col("text")), buckets=4, budget=1000)
    found = out.collect()
    assert len(found) == len(rows) and sum(r.n_tokens for r in found) == sum(len((t or "").split()) for _, t in rows)
    batches = collections.defaultdict(list)
    for r in found:
        assert r.padding == r.bound - r.n_tokens >= 0
        batches[r.bucket, r.batch_id].append(r)
    full = collections.Counter()
    for (bucket, _), members in batches.items():
        assert sorted(r.place for r in members) == list(range(len(members)))
        size = max(1, 1000 // max(1, members[0].bound))
        assert len(members) <= size
        full[bucket] += len(members) < size
    assert max(full.values()) <= 1 and len({b for b, _ in batches}) == 4
    assert packing.packed(documents([]), packing.word_count(F.col("text"))).count() == 0
    assert packing.packed(documents([(1, None)]), packing.word_count(F.col("text"))).first().batch_id == 0


def test_rows_without_id_are_not_one_slice(spark, monkeypatch):
    monkeypatch.setattr(packing, "_PER_TASK", 40)
    rows = spark.createDataFrame([(None, 7)] * 900 + [(i, 7) for i in range(100)], "doc_id long, n long")
    out = packing.packed(rows, F.col("n"), budget=70)
    found = out.collect()
    assert sorted((r.batch_id, r.place) for r in found) == [(b, p) for b in range(100) for p in range(10)]
    assert "monotonically_increasing_id" in out._jdf.queryExecution().optimizedPlan().toString()


def _cosines(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q, x in good:
        if q is not None and q % 50 == 0:
            near = [
                (-float(x @ y) / (np.linalg.norm(x) * np.linalg.norm(y)), i is None, i or 0)
                for i, y in good if i != q and len(y) == len(x)
            ]
            out += [(q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(near)[:k], 1)]
    return sorted(out, key=lambda x: x[:2])


@pytest.mark.parametrize("carried", [32, 1])
def test_nearest_match_brute_force(spark, monkeypatch, carried):
    monkeypatch.setattr(neighbours, "_CARRIED", carried)
    draw = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=17) * (10.0 if i % 7 else 1e-3)]) for i in range(400)]
    rows += [(i + 400, [2 * x for x in rows[i][1]]) for i in range(0, 60, 7)]  # ties
    rows += [(1001, None), (1002, []), (1003, [0.0] * 17), (1004, [float("nan")] * 17), (1005, [None] + [1.0] * 16), (None, [1.0] * 17)]
    rows += [(1050, [1.0, 0.0, 0.0]), (1051, [1.0, 1.0, 0.0]), (1100, [1.0])]
    rows += [(None, [2 * x for x in rows[i][1]]) for i in (0, 0, 49, 50, 100)]  # near, without id
    for kind in ("double", "float"):
        table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"block": F.lit(1), "id": F.lit(2), "dim": F.lit(3)})
        found = neighbours.nearest(table, F.col("vec_id") % 50 == 0, 5, query_block=3, vector_block=64).collect()
        found, expected = sorted(found, key=lambda r: r[:2]), _cosines(rows, 5)
        assert [(r.query_id, r["rank"], r.vec_id) for r in found] == [x[:3] for x in expected]
        assert [r.score for r in found] == pytest.approx([x[3] for x in expected], abs=1e-12)
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_a_carried_bar_spares_recomputation():
    draw = np.random.default_rng(4)

    def side(first, vectors):
        codes, scales, errors = neighbours.quantised(vectors)
        ids = np.arange(first, first + len(vectors))
        return {"ids": ids, "named": np.ones(len(ids), bool), "codes": codes, "scales": scales, "errors": errors, "vectors": vectors}

    q, tiles = side(0, draw.normal(size=(64, 32))), [side(1000 * i, draw.normal(size=(500, 32))) for i in range(1, 9)]
    heaps = [[] for _ in q["ids"]]
    carried = [neighbours.search_tile(q, v, 5, heaps) for v in tiles]
    alone = [neighbours.search_tile(q, v, 5, [[] for _ in q["ids"]]) for v in tiles]
    assert carried[0] == alone[0] and 3 * sum(carried[4:]) < sum(alone[4:])
