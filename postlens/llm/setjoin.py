"""N-gram Jaccard join: all links between documents whose sets of word shingles are similar, and their components.

The method is an index of prefix shingles whose lists are ordered by position, together with answers derived from those
of a very similar set. Both steps skip parts of a list by position, without looking at the pairs in them:

1. Every document becomes a set of 64-bit shingle hashes; equal sets are one set from here on. A sketch of fixed size
   counts all shingles, and each set orders its shingles from rare to frequent.
2. Only a prefix of that order is indexed: similar sets share a shingle of their prefixes. Lists with a single set are
   dropped. In a list, a set is tried first with the *pivot*: the set of about its size that has the shingle earliest.
   Two positions bound the overlap, so most pairs are skipped without being looked at.
3. Sets linked to a pivot form a *star* with known distances to its centre. A long list is cut into *blocks* by size. The
   position of an entry bounds the sizes it can be linked with, so it meets only the blocks of those sizes, and there only
   the entries whose own positions admit its size. For two stars that meet only the centres are compared. The distance of the centres bounds that of all members (the Jaccard distance is a metric): often all
   are linked or none can be. For the rest, a set's overlaps with all members of a star are derived from its overlap
   with the centre and the few shingles in which a member differs from the centre.

Nothing is capped: each step skips only pairs that cannot be links, or whose sets are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import checkpointed, pieces_of, settled, spare_name, texts, written
from postlens.llm.components import components
from postlens.llm.shingles import mix, set_id, shingle_sets

_U = np.uint64
#: Size of the sketch and of the filter of wanted documents, as powers of two: both are broadcast.
SKETCH_BITS, FILTER_BITS = 18, 23
#: A list with more entries than this is split; so is a pivot with more partners.
SPLIT_LIST, SPLIT_PIVOT = 100_000, 4_000
#: A list with more entries than this is cut into blocks, so many for each factor in size that links may bridge.
LONG_LIST, BLOCKS_PER_CLASS = 64, 2
#: The split of a list that is in one piece.
WHOLE = -1
#: Marks a shingle of the pivot that its partner lacks.
_LACKS = _U(0x5DEECE66D1234567)
_BLOCKS = 64
_ROWS = 100_000


class Similarity:
    """Jaccard similarity of at least ``percent`` per cent, in whole numbers."""

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent must be in 1..100")
        self.percent = percent

    def prefix(self, n: int) -> int:
        return n - (self.percent * n + 99) // 100 + 1 if n else 0

    def overlap_sql(self, n: str) -> str:
        """The least overlap of a link whose sizes sum to ``n``."""
        p = self.percent
        return f"(({p} * ({n}) + {99 + p}) div {100 + p})"

    def partner_sizes_sql(self) -> tuple[str, str]:
        """The least and the largest size of a set that one with ``n`` shingles, ``rest`` from the shared one on, can be linked with."""
        p = self.percent
        return f"(({p} * n + 99) div 100)", f"least(100 * n div {p}, {100 + p} * rest div {p} - n)"

    def block_sql(self, n: str) -> str:
        """The block of a size; blocks go up with sizes."""
        if self.percent == 100:
            return f"int({n})"
        return f"int(floor(ln({n}) * {float(BLOCKS_PER_CLASS / -np.log(self.percent / 100))!r}D))"

    def possible(self, n_a, rest_a, n_b, rest_b):
        """For arrays: sizes and positions allow a link. ``rest`` counts the shingles from the shared one on."""
        p = self.percent
        least = (p * (n_a + n_b) + 99 + p) // (100 + p)
        return (np.minimum(rest_a, rest_b) >= least) & (100 * n_a >= p * n_b) & (100 * n_b >= p * n_a)

    def size_class(self, n: np.ndarray) -> np.ndarray:
        """Sets of one class are close enough in size to be linked."""
        if self.percent == 100:
            return n
        return np.floor(np.log(n) / -np.log(self.percent / 100) + 1e-9).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose texts (of one column) have about 4 MB, or which are one longer text."""
    for batch in batches:
        for part in pieces_of(batch.column(column)):
            yield batch.slice(part.start, part.stop - part.start)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def _profile(width: int):
    """Per document its set's size and name; per task the sketch of its shingles, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        shift = _U(64 - SKETCH_BITS)
        for batch in _pieces(batches, 1):
            sets = shingle_sets(texts(batch.column(1)), width)
            if sets:
                counts += np.bincount((np.concatenate(sets) >> shift).astype(np.int64), minlength=1 << SKETCH_BITS)
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.nulls(n, pa.binary()),
                ],
                ["row", "n", "sid", "sketch"],
            )
        if counts.any():
            parts = [x.tobytes() for x in counts.astype(np.uint32).reshape(_BLOCKS, -1)]
            nothing = pa.nulls(_BLOCKS, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [nothing, pa.array(range(_BLOCKS), pa.int32()), nothing, pa.array(parts, pa.binary())],
                ["row", "n", "sid", "sketch"],
            )

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            values = np.frombuffer(data, np.uint32 if len(data) == 4 * (1 << SKETCH_BITS) // _BLOCKS else np.int64)
            total[block] = total.get(block, 0) + values.astype(np.int64)
    return total


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if total := _totals(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
            ["n", "sketch"],
        )


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of whole blocks: 64 times the logarithm of each count, and those counts that may split a list."""
    for block, counts in _totals(batches).items():
        heavy = np.flatnonzero(counts >= 2 * SPLIT_LIST)
        yield _batch(
            n=np.array([block], np.int32), level=[(np.log2(counts + 1.0) * 64).astype(np.uint16).tobytes()],
            place=[heavy + block * len(counts)], count=[counts[heavy]],
        )


def _sketch(profile: DataFrame, tasks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often shingles of each hash range occur, as a level, and the ranges of lists that are split, with their splits.

    Tasks sum the blocks, whose parts are dealt by block in two rounds. Only levels (half a MB) and heavy ranges come here.
    """
    parts = profile.where("sketch is not null").select("n", "sketch", F.pmod(F.spark_partition_id(), F.lit(isqrt(tasks))).alias("part"))
    parts = parts.repartition(tasks, "n", "part").select("n", "sketch").mapInArrow(_summed, "n int, sketch binary")
    parts = parts.repartition(min(tasks, _BLOCKS), "n").mapInArrow(_levels, "n int, level binary, place array<long>, count array<long>")
    level = np.zeros((_BLOCKS, (1 << SKETCH_BITS) // _BLOCKS), np.uint16)
    places, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row in parts.collect():
        level[row["n"]] = np.frombuffer(row["level"], np.uint16)
        places.append(np.array(row["place"], np.int64))
        counts.append(np.array(row["count"], np.int64))
    place, count = np.concatenate(places), np.concatenate(counts)
    usual = round(2 ** (float(np.median(level)) / 64)) - 1
    ways = (count - 2 * usual) // SPLIT_LIST
    return level.ravel(), place[ways > 1], ways[ways > 1]


def _prefixes(width: int, similarity: Similarity, sketch):
    """Index entries: shingle, split, set, and size and position in one number. A task skips sets it has had before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, heavy, ways = sketch.value
        splits = np.ones(len(level), np.int64)
        splits[heavy] = ways
        shift = _U(64 - SKETCH_BITS)
        seen: set[int] = set()
        for batch in _pieces(batches, 0):
            tokens, sids, places = [], [], []
            for shingles in shingle_sets(texts(batch.column(0)), width):
                n = len(shingles)
                sid = set_id(shingles) if n else None
                if sid is None or sid in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(sid)
                p = similarity.prefix(n)
                key = (level[(shingles >> shift).astype(np.int64)].astype(np.uint64) << _U(52)) | (shingles >> _U(12))
                first = np.argpartition(key, p - 1)[:p] if p < n else np.arange(n)
                tokens.append(shingles[first[np.lexsort((shingles[first], key[first]))]])
                sids.append(np.full(p, sid, np.int64))
                places.append((np.arange(p, dtype=np.int64) << 32) | n)
            if tokens:
                token, sid, place = np.concatenate(tokens), np.concatenate(sids), np.concatenate(places)
                ways = splits[(token >> shift).astype(np.int64)]
                split = (mix(sid.view(np.uint64)) % ways.astype(np.uint64)).astype(np.int32)
                split[ways == 1] = WHOLE
                for i in range(0, len(token), _ROWS):
                    s = slice(i, i + _ROWS)
                    yield _batch(token=token[s].view(np.int64), split=split[s], sid=sid[s], place=place[s])

    return run


def _lists(similarity: Similarity):
    """Of entries sorted by shingle and position: those of lists with several sets, each with its pivot, if it has one.

    Entries of a list that is taken in pieces all stay, as their partners may be in another piece.
    """

    def closed(token, split, sid, place, piece=False) -> pa.RecordBatch | None:
        fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (split[1:] != split[:-1])))
        run = np.cumsum(fresh) - 1
        order = np.lexsort((sid, run))  # equal sets of one list once
        again = np.zeros(len(run), bool)
        again[order[1:]] = (run[order[1:]] == run[order[:-1]]) & (sid[order[1:]] == sid[order[:-1]])
        keep = ~again & (piece | (split != WHOLE) | (np.bincount(run[~again])[run] > 1))
        token, split, sid, place, run = token[keep], split[keep], sid[keep], place[keep], run[keep]
        if not len(run):
            return None
        n, at = place & 0xFFFFFFFF, place >> 32
        group = run * 4096 + similarity.size_class(n)
        _, first, back = np.unique(group, return_index=True, return_inverse=True)
        pivot = first[back]
        fits = (sid[pivot] != sid) & similarity.possible(n, n - at, n[pivot], n[pivot] - at[pivot])
        return pa.RecordBatch.from_arrays(
            [pa.array(token), pa.array(sid), pa.array(n.astype(np.int32)), pa.array((n - at).astype(np.int32)),
             pa.array(sid[pivot], mask=~fits)],
            ["token", "sid", "n", "rest", "pivot"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        piece = None  # the list of which pieces have gone out
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held:
                columns = [np.concatenate(x) for x in zip(*held, columns)]
            token, split = columns[:2]
            end = np.flatnonzero((token[1:] != token[:-1]) | (split[1:] != split[:-1]))
            cut = int(end[-1]) + 1 if len(end) else 0
            if not cut and len(token) > 4 * SPLIT_LIST:
                cut, piece = len(token), (int(token[0]), int(split[0]))
            if cut:
                old = piece and ((token[:cut] == piece[0]) & (split[:cut] == piece[1]))
                if found := closed(*(c[:cut] for c in columns), False if old is None else old):
                    yield found
            held = [[c[cut:] for c in columns]] if cut < len(token) else []
        if held:
            old = piece and ((held[0][0] == piece[0]) & (held[0][1] == piece[1]))
            if found := closed(*held[0], False if old is None else old):
                yield found

    return run


def _wanted(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (1 MB) of hashed row numbers, one word of 64 bits per group."""
    place = F.pmod(F.xxhash64("row"), F.lit(1 << FILTER_BITS))
    words = (
        ids.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, int(pmod(xxhash64(row), 64)))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    )
    # One job, and no more than 2 MB: a job for each partition would keep the driver busier than the words do.
    found = words.toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _kept_sets(width: int, wanted, part: bool):
    """The sets of the wanted documents, or a part of them. ``place`` is the row's hash, made by Spark.

    The part has the shingles of the lowest quarter of all hashes, cut to 32 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in _pieces(batches, 0):
            place = batch.column(1).to_numpy() % (1 << FILTER_BITS)
            asked = pa.array(((bits[place >> 6] >> (place & 63)) & 1).astype(bool))
            found = shingle_sets(texts(batch.column(0).filter(asked)), width)
            full = [len(s) > 0 for s in found]
            found = [s for s in found if len(s)]
            if not found:
                continue
            sids, sizes = [set_id(s) for s in found], [len(s) for s in found]
            if part:
                found = [(s[: np.searchsorted(s, _U(1 << 62))] >> _U(30)).astype(np.uint32) for s in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sids, pa.int64()), batch.column(1).filter(asked).filter(pa.array(full)), pa.array(sizes, pa.int32()),
                    pa.array([s.tobytes() for s in found], pa.binary()),
                ],
                ["sid", "place", "n", "shingles"],
            )

    return run


def _met(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[list[tuple]]:
    """Per batch of rows sorted so that a pivot precedes its partners: partner, pivot and their sizes and shingles."""
    name, n_pivot, pivot = None, 0, np.zeros(0, kind)
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            key, partner, reach, n, data = (batch.column(k)[i].as_py() for k in range(5))
            shingles = np.frombuffer(data, kind)
            if partner is None:
                name, n_pivot, pivot = key, n, shingles
            elif key == name:
                out.append((partner, key, reach, n, n_pivot, shingles, pivot))
        yield out


def _shared(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of x are in y (both ascending), and their places there."""
    if not len(y):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return y[at] == x, at


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that parts of the sets leave within reach: all shingles outside the parts may be shared."""
    for rows in _met(batches, np.uint32):
        kept = []
        for a, b, reach, n_a, n_b, x, y in rows:
            most = int(_shared(x, y)[0].sum()) + min(n_a - len(x), n_b - len(y))
            if 1 - most / (n_a + n_b - most) <= reach + 1e-9:
                kept.append((a, b, reach))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in kept], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "reach"]
        )


def _overlaps(widest: float):
    """Of rows sorted so that a pivot precedes its partners: the overlap of each partner with it, and the difference.

    A difference lists what the partner has more than the pivot, then (marked) what it lacks; it is left out where the
    distance is above ``widest``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _met(batches, np.uint64):
            out = []
            for a, b, _, n_a, n_b, x, y in rows:
                same, at = _shared(x, y)
                both = int(same.sum())
                diff = None
                if 1 - both / (n_a + n_b - both) <= widest:
                    lacks = np.ones(n_b, bool)
                    lacks[at[same]] = False
                    diff = np.concatenate([x[~same], y[lacks] ^ _LACKS]).view(np.int64)
                out.append((a, b, n_a, n_b, both, diff))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["a", "b", "n_a", "n_b", "both", "diff"]
            )

    return run


class _Join:
    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.spark, self.width, self.similarity = docs, docs.sparkSession, width, Similarity(percent)
        self.limit = 1 - percent / 100
        self.tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.profile = checkpointed(
            docs.select("row", "text").mapInArrow(_profile(width), "row long, n int, sid long, sketch binary")
        )
        self.rows = self.profile.where("sketch is null").select("row", "n", "sid")

    def index(self) -> DataFrame:
        sketch = self.spark.sparkContext.broadcast(_sketch(self.profile, self.tasks))
        entries = self.docs.select("text").mapInArrow(
            _prefixes(self.width, self.similarity, sketch), "token long, split int, sid long, place long"
        )
        lists = entries.repartition(self.tasks, "token", "split").sortWithinPartitions("token", "split", "place", "sid")
        return written(
            lists.mapInArrow(_lists(self.similarity), "token long, sid long, n int, rest int, pivot long"), "index"
        )

    def compared(self, pairs: DataFrame) -> DataFrame:
        """Sizes, overlap, Jaccard distance ``d`` and difference of pairs ``a, b, reach``; b should be in many pairs.

        Pairs farther apart than ``reach`` may be missing: parts of the sets, an eighth of their bytes, rule out most.
        ``diff`` has what a has more than b, then what it lacks; it is null where the distance is too large to matter.
        """
        pairs = settled(pairs.groupBy("a", "b").agg(F.max("reach").alias("reach")))
        named = self.rows.join(self._sids(pairs), "sid").groupBy("sid").agg(F.min("row").alias("row"))
        named = settled(named)
        parts = self._together(pairs, named, True)
        hopeful = settled(parts.mapInArrow(_hopeful, "a long, b long, reach double"))
        named = settled(named.join(self._sids(hopeful), "sid"))
        found = self._together(hopeful, named, False).mapInArrow(
            _overlaps(2 * self.limit + 1e-9), "a long, b long, n_a int, n_b int, both int, diff array<bigint>"
        )
        return checkpointed(found.withColumn("d", F.expr("1 - both / (n_a + n_b - both)")))

    @staticmethod
    def _sids(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()

    def _filter(self, named: DataFrame):
        return self.spark.sparkContext.broadcast(_wanted(named))

    def _together(self, pairs: DataFrame, named: DataFrame, part: bool) -> DataFrame:
        """Each pivot's set (or part of it) in front of those of its partners; a pivot with many partners, several times.

        A set is taken from the row ``named`` for it, however many rows have it. The bitmap of these rows keeps most other
        rows from being shuffled; those that it lets pass meet no need.
        """
        wanted = self._filter(named)
        place = named.select("sid", F.xxhash64("row").alias("place"))
        ways = pairs.groupBy("b").agg(F.expr(f"1 + count(1) div {SPLIT_PIVOT}").alias("ways"))
        pairs = pairs.join(ways, "b").withColumn("split", F.pmod(F.xxhash64("a"), "ways").cast("int"))
        needs = pairs.select(F.col("a").alias("sid"), F.col("b").alias("key"), "split", F.col("a").alias("partner"), "reach")
        needs = needs.unionByName(
            pairs.groupBy("b", "split").agg(F.lit(None).cast("long").alias("partner"), F.lit(0.0).alias("reach"))
            .select(F.col("b").alias("sid"), F.col("b").alias("key"), "split", "partner", "reach")
        )
        sets = self.docs.select("text", F.xxhash64("row").alias("place")).mapInArrow(
            _kept_sets(self.width, wanted, part), "sid long, place long, n int, shingles binary"
        )
        dealt = needs.join(place, "sid").join(sets, ["sid", "place"]).repartition(self.tasks, "key", "split")
        dealt = dealt.sortWithinPartitions("key", "split", F.asc_nulls_first("partner"))
        return dealt.select("key", "partner", "reach", "n", "shingles")

    def links(self) -> DataFrame:
        """``a, b``: links that connect all sets that chains of links connect."""
        p, limit = self.similarity.percent, self.limit
        at_least = self.similarity.overlap_sql("n_a + n_b")
        index = self.index()
        tried = self.compared(
            index.where("pivot is not null").select(F.col("sid").alias("a"), F.col("pivot").alias("b"), F.lit(limit).alias("reach"))
        )
        near = tried.where(f"both >= {at_least}")
        links = near.select("a", "b")
        star = near.groupBy("a").agg(F.min(F.struct("d", "b")).alias("s"))
        star = star.select(F.col("a").alias("sid"), F.col("s.b").alias("star"), F.col("s.d").alias("far"))
        # A centre may belong to another star itself; its members' distances stay those to it. Two steps up from a set
        # lead to its root: sets of one root are connected, whatever the other links are.
        above = star.select(F.col("sid").alias("star"), F.col("star").alias("above"))
        star = star.join(above, "star", "left").select(
            "sid", "star", "far",
            F.expr("case when above = sid then least(sid, star) else coalesce(above, star) end").alias("root"),
        )
        placed = (
            index.select("token", "sid", "n", "rest").join(star, "sid", "left")
            .select(
                "token", "sid", "n", "rest", F.coalesce("root", "sid").alias("root"),
                F.coalesce("star", "sid").alias("star"), F.coalesce("far", F.lit(0.0)).alias("far"),
            )
        )
        mixed = placed.groupBy("token").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("length")
        ).where("low < high")
        placed = settled(placed.join(mixed.select("token", "length"), "token"))
        # Members of one star and size are one entry of a list.
        entries = placed.groupBy("token", "star", "n").agg(
            F.min("root").alias("root"), F.max("rest").alias("rest"), F.first("length").alias("length")
        )
        met = settled(self.meeting(entries).select("a", "b", "n_x", "n_y").distinct())
        if met.isEmpty():
            return links
        members = settled(placed.select("star", "sid", "n", "far").distinct())
        size = members.groupBy("star").agg(F.max("far").alias("far"), F.count("*").alias("size"))
        side = lambda c: size.select(F.col("star").alias(c), F.col("far").alias(f"far_{c}"), F.col("size").alias(f"size_{c}"))
        asked = settled(met.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b"))
        known = self.compared(asked.select("a", "b", F.expr(f"{limit} + far_a + far_b").alias("reach")))
        links = links.unionByName(known.where(f"both >= {at_least}").select("a", "b"))
        open_ = known.where(f"both < {at_least}").select("a", "b", "d").join(asked, ["a", "b"])
        open_ = open_.where(f"far_a + far_b > 0 and d <= {limit} + far_a + far_b + 1e-9")
        # The larger star keeps its centre as the set to derive answers from; the members of the other are asked about.
        swap = F.col("size_a") > F.col("size_b")
        open_ = settled(
            open_.select(
                F.when(swap, F.col("b")).otherwise(F.col("a")).alias("asked"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("star"),
                F.when(swap, F.col("far_a")).otherwise(F.col("far_b")).alias("radius"), "d",
            )
        )
        if open_.isEmpty():
            return links
        asking = open_.join(members.withColumnRenamed("star", "asked"), "asked").where(f"d <= {limit} + radius + far + 1e-9")
        asking = settled(asking.select("asked", "star", "radius", "sid").distinct())
        tested = self.compared(
            asking.select(F.col("sid").alias("a"), F.col("star").alias("b"), F.expr(f"{limit} + radius").alias("reach"))
        )
        links = links.unionByName(tested.where(f"both >= {at_least}").select("a", "b"))
        tested = tested.where(f"both < {at_least}").withColumnsRenamed({"a": "sid", "b": "star"}).join(asking, ["sid", "star"])
        tested = tested.where(f"radius > 0 and d <= {limit} + radius + 1e-9").select(
            "sid", "star", "asked", F.col("n_a").alias("n"), F.col("n_b").alias("n_star"), "both", F.col("diff").alias("own")
        )
        return links.unionByName(self.derived(tested, near, members, met))

    def meeting(self, entries: DataFrame, filtered: bool = True) -> DataFrame:
        """Pairs of entries ``token, star, n, root, rest, length`` that may be linked, as ``token, a, b, n_x, n_y``.

        Of a long list, the entry x goes to the cells (block of its size, block of a size it admits), and y to the cells
        (block of a size it admits, block of its size): they meet in one cell if their blocks admit each other, else in none.
        What is left to the filter is the difference between a size and its block. A short list is one cell.
        """
        p, block = self.similarity.percent, self.similarity.block_sql
        low, high = self.similarity.partner_sizes_sql()
        entries = entries.where(f"{low} <= {high}")  # the others are too far back to be linked with any set
        short = f"length <= {LONG_LIST}"
        own = F.expr(f"if({short}, 0, {block('n')})")
        admitted = F.explode(F.expr(f"if({short}, array(0), sequence({block(low)}, {block(high)}))"))
        x = entries.select("*", own.alias("row")).select("*", admitted.alias("column")).alias("x")
        y = entries.select("*", own.alias("column")).select("*", admitted.alias("row")).alias("y")
        meet = "x.token = y.token and x.row = y.row and x.column = y.column and x.star < y.star"
        if filtered:
            meet += (
                f" and x.root <> y.root and 100 * x.n >= {p} * y.n and 100 * y.n >= {p} * x.n"
                f" and least(x.rest, y.rest) >= {self.similarity.overlap_sql('x.n + y.n')}"
            )
        return x.join(y, F.expr(meet)).select(
            F.col("x.token").alias("token"), F.col("x.star").alias("a"), F.col("y.star").alias("b"), F.col("x.n").alias("n_x"),
            F.col("y.n").alias("n_y"),
        )

    def derived(self, tested: DataFrame, near: DataFrame, members: DataFrame, met: DataFrame) -> DataFrame:
        """Links of the tested sets with members of a star, from their overlap with its centre and two differences.

        With the centre p, overlap(y, c) = overlap(y, p) - |p without c| + |what the differences of y and c to p share|.
        As y is no link of p, a link of y and c needs more shared than a known part of the difference of c. So one of
        the first entries of that difference, all but that part, is shared: only sets that share one are paired.
        """
        p = self.similarity.percent
        sizes = met.select(F.col("a").alias("star"), F.col("n_x").alias("n_c"), F.col("b").alias("asked"), F.col("n_y").alias("n"))
        sizes = sizes.unionByName(
            met.select(F.col("b").alias("star"), F.col("n_y").alias("n_c"), F.col("a").alias("asked"), F.col("n_x").alias("n"))
        )
        tested = settled(tested)
        around = members.join(tested.select("star").distinct(), "star").select(F.col("sid").alias("a"), F.col("star").alias("b"))
        around = settled(near.join(around, ["a", "b"]).select(
            F.col("a").alias("c"), F.col("b").alias("star"), F.col("n_a").alias("n_c"),
            F.expr("n_b - both").alias("lacks"), F.expr("n_a - both").alias("more"), F.col("diff").alias("theirs"),
        ))
        first = F.expr(f"int(lacks + more - (100 * lacks + {p} * more) div {100 + p})")
        ours = tested.join(sizes, ["star", "asked", "n"]).select("sid", "star", "n_c", F.explode("own").alias("shingle"))
        theirs = around.select("c", "star", "n_c", F.explode(F.slice("theirs", F.lit(1), first)).alias("shingle"))
        pairs = ours.join(theirs, ["star", "n_c", "shingle"]).select("sid", "star", "c").distinct()
        pairs = pairs.join(tested.select("sid", "star", "n", "both", "own").distinct(), ["sid", "star"]).join(around, ["star", "c"])
        overlap = F.col("both") - F.col("lacks") + F.size(F.array_intersect("own", "theirs"))
        return pairs.where((100 + p) * overlap >= p * (F.col("n") + F.col("n_c"))).select(F.col("sid").alias("a"), F.col("c").alias("b"))


def similar_groups(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles`` (size of its set) and ``component_id``.

    Two documents are linked when the Jaccard similarity of their sets of ``width``-word shingles is at least
    ``percent`` per cent; ``component_id`` is the smallest id reachable by links, the own id included.

    * Null, empty and blank texts have an empty set, no links, and their own id as component.
    * Rows with equal ids or equal texts all stay; equal texts share a component.
    * A null id takes part in links but is nobody's smallest id, so its component is null only if all ids in it are.
    * An empty table gives no rows. Other columns of ``docs`` are not read, whatever their names.

    Sets have 64-bit names and shingles 64-bit hashes: with n sets a false merge has a chance of n² / 2^65.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    join = _Join(narrow, width, percent)
    links = join.links()
    roots = components(links)
    sets = join.rows.where("sid is not null").groupBy("sid").agg(F.min("row").alias("low"))
    sets = sets.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    lows = sets.groupBy("root").agg(F.min("low").alias("component_id"))
    sets = sets.join(lows, "root").select("sid", "component_id")
    out = join.rows.join(sets, "sid", "left").select(
        F.col("row"), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("row")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumnRenamed("row", id_col)


def one_of_each_group(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` but for near duplicates: of all rows that links connect, one stays. See ``similar_groups``.

    The row with the smallest id stays; rows without id come after all others. Rows are told apart by a number of their own:
    of rows that repeat an id, or have none, each is judged by its own text, and of wholly equal rows one stays. Texts
    without words link with nothing and stay.
    """
    row = spare_name(docs, "_row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = similar_groups(numbered.select(F.col(row).alias("id"), F.col(text_col).alias("text")), width, percent, "id", "text")
    groups = groups.select(F.col("id").alias("row"), "component_id")
    ids = numbered.select(F.col(row).alias("row"), F.col(id_col).alias("id"))
    rank = F.struct(F.col("id").isNull().alias("nameless"), "id", "row")
    first = groups.join(ids, "row").groupBy("component_id").agg(F.min(rank).alias("first")).select("first.row")
    gone = groups.select("row").join(first, "row", "left_anti").withColumnRenamed("row", row)
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
