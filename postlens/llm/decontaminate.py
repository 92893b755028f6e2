"""Benchmark decontamination with DataFrame operations only.

The windows of the benchmark (13 words, normalised) are a hash set that is broadcast. Scanning every window of every
document would hash each word 13 times, so a window is scanned where its *anchor*, its longest word, occurs: a set of
literals finds the documents and the places. Each window found there is looked up by hash and verified word by word.

A benchmark beyond the checked bounds is neither broadcast nor made literals: the hashes of all windows of the documents
are then joined with those of the benchmark, and what they find is verified word by word in the texts. Both ways give the
same rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import spare_name

#: Separators in a text without A-Z: every ASCII character other than letters and digits.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words and separators of a text as it is, with A-Z.
RAW_WORD, RAW_GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A benchmark is broadcast up to this many distinct windows and characters in them.
MAX_WINDOWS, MAX_CHARS = 50_000, 16_000_000


def _split(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def exact_words(text: Column) -> Column:
    """The words, A-Z in lower case."""
    return _split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _folded_words(text: Column) -> Column:
    """As many words, all letters in lower case: only used to find candidates, and faster than ``exact_words``."""
    return _split(F.lower(text))


def windows(benchmark: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: their words, length, hashes, anchor with its place, and the ids of the items they occur in."""
    words = benchmark.select(
        F.col(id_col).cast("string").alias("item"), exact_words(F.col(text_col).cast("string")).alias("w")
    ).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    # A window near the end of a shorter item would be cut off: such an item is one window from its first word.
    words = words.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("words"))
    longest = F.array_max(F.transform("words", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"))))
    return (
        words.groupBy("words").agg(F.collect_set("item").alias("items"))
        .withColumn("off", -longest["i"])
        .select(
            "words", "items", "off", F.size("words").alias("len"), F.lower(F.col("words")[F.col("off")]).alias("anchor"),
            *_hashes(F.col("words")),
        )
    )


def _hashes(words: Column) -> tuple[Column, Column]:
    return F.xxhash64(words).alias("h1"), F.xxhash64(F.lit("second"), words).alias("h2")


def _near_anchors(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, row, n_words, start, len, items`` of every hit, and one row without hit per document."""
    anchors = [r["anchor"] for r in wanted.select("anchor").distinct().collect()]
    places = F.broadcast(wanted.select("anchor", "off", "len").distinct())
    lookup = F.broadcast(wanted.select("h1", "words", "items"))
    none = F.array().cast("array<int>")

    def anchored(words: Column) -> Column:
        at = F.transform(words, lambda w, i: F.when(F.lower(w).isin(anchors), i).otherwise(-1))
        return F.filter(at, lambda i: i >= 0)

    found = F.exists("w", lambda w: w.isin(anchors)) if anchors else F.lit(False)
    rows = rows.select("id", "row", "text", _folded_words(F.col("text")).alias("w"))
    rows = rows.select("id", "row", F.size("w").alias("n_words"), F.when(found, exact_words(F.col("text"))).alias("x"))
    at = F.concat(F.array(F.lit(-1)), F.coalesce(anchored(F.col("x")), none) if anchors else none)
    rows = rows.select("id", "row", "n_words", "x", F.explode(at).alias("at"))
    key = F.when(F.col("at") >= 0, F.lower(F.col("x")[F.col("at")]))
    rows = rows.withColumn("anchor", key).join(places, "anchor", "left")
    inside = (F.col("at") >= F.col("off")) & (F.col("at") - F.col("off") + F.col("len") <= F.col("n_words"))
    rows = rows.withColumn("start", F.when(inside, F.col("at") - F.col("off")))
    rows = rows.withColumn("words", F.when(F.col("start").isNotNull(), F.slice("x", F.col("start") + 1, F.col("len"))))
    rows = rows.withColumn("h1", F.when(F.col("start").isNotNull(), F.xxhash64("words"))).drop("x")
    return rows.join(lookup, ["h1", "words"], "left").where("at = -1 or items is not null").select(
        "id", "row", "n_words", "start", "len", "items"
    )


def _all_windows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same rows for a benchmark of any size.

    Only ids, places and hashes of the documents' windows are shuffled. Places found go back to the rows by id and hash of
    the text; the words there must be those of the window, so no hit rests on a hash.
    """
    rows = rows.withColumn("body", F.xxhash64("text"))
    lengths = [r["len"] for r in wanted.select("len").distinct().collect()]  # at most the window's size of them

    def of_length(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n))
        return F.coalesce(
            F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(n).alias("len"), *_hashes(F.slice("w", s + 1, n)))),
            F.array().cast("array<struct<start:int,len:int,h1:bigint,h2:bigint>>"),
        )

    scanned = rows.select("id", "body", exact_words(F.col("text")).alias("w"))
    places = F.concat(*map(of_length, lengths)) if lengths else of_length(1)
    scanned = scanned.select("id", "body", F.explode(places).alias("s")).select("id", "body", "s.*")
    hits = scanned.join(wanted.select("h1", "h2", "words", "items"), ["h1", "h2"])
    hits = hits.groupBy(F.col("id").alias("of"), F.col("body").alias("of_body")).agg(
        F.collect_set(F.struct("start", "len", "words", "items")).alias("places")
    )
    rows = rows.join(hits, F.col("id").eqNullSafe(F.col("of")) & F.col("body").eqNullSafe(F.col("of_body")), "left")
    rows = rows.select("id", "row", "places", exact_words(F.col("text")).alias("w"))
    same = F.filter("places", lambda p: F.slice("w", p["start"] + 1, p["len"]) == p["words"])
    nothing = F.struct(
        F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("len"),
        F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("array<string>").alias("items"),
    )
    found = F.concat(F.array(nothing), F.coalesce(same, F.array().cast(
        "array<struct<start:int,len:int,words:array<string>,items:array<string>>>"
    )))
    rows = rows.select("id", "row", F.size("w").alias("n_words"), F.explode(found).alias("p"))
    return rows.select("id", "row", "n_words", "p.start", "p.len", "p.items")


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 13, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text",
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``hits``.

    A word is hit if it lies in an occurrence of a window; ``hits`` has the occurrences as (start, length) in words. A
    document is contaminated if at least one word in ``one_in`` is hit.

    * Null, empty and wordless texts have no words and no hits. A null or wordless item has no window.
    * Rows with equal ids stay apart. An item given twice counts once; one without id hits words but is not counted.
    * An empty benchmark hits nothing, an empty table gives no rows. Other columns are not read, whatever their names.
    """
    wanted = windows(benchmark, size)
    bound = wanted.limit(max_windows + 1).agg(
        F.count("*").alias("n"), F.sum(F.length(F.array_join("words", " "))).alias("chars")
    ).first()
    small = bound["n"] <= max_windows and (bound["chars"] or 0) <= MAX_CHARS
    rows = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text")
    )
    found = (_near_anchors if small else _all_windows)(rows, wanted)
    found = found.groupBy("row", "id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "len")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["start"] + x["len"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(acc["end"], x["start"]))).alias("n"),
        ),
        lambda acc: acc["n"].cast("long"),
    )
    found = found.withColumn("n_hit", covered)
    return found.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "hits",
    )


def _without_spans(text: Column, hits: Column) -> Column:
    """The text without its hit words, each with what separates it from the next word."""
    parts = F.regexp_extract_all(text, F.lit(f"{RAW_WORD}|{RAW_GAP}"), F.lit(0))
    first = F.when(text.rlike(f"^{RAW_GAP}"), 1).otherwise(0)

    def stays(part: Column, i: Column) -> Column:
        word = F.floor((i - first) / 2)
        return ~F.exists(hits, lambda h: (word >= h["start"]) & (word < h["start"] + h["len"]))

    return F.array_join(F.filter(parts, stays), "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", **settings) -> DataFrame:
    """``docs`` without its contaminated documents, or with the hit spans cut out of those (``remove='spans'``).

    Documents with hits below the share stay as they are. Texts are told apart by id and content; columns, their order
    and repeated rows stay. See ``contamination`` for the settings and the odd cases.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    id_col, text_col = settings.get("id_col", "doc_id"), settings.get("text_col", "text")
    key, body, spans = (spare_name(docs, n) for n in ("_id", "_hash", "_hits"))
    named = docs.select(
        F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")).alias("pair"), F.col(text_col)
    )
    bad = contamination(named, benchmark, **{**settings, "id_col": "pair"}).where("contaminated")
    bad = bad.groupBy(F.col("pair.id").alias(key), F.col("pair.hash").alias(body)).agg(F.first("hits").alias(spans))
    same = docs[id_col].eqNullSafe(bad[key]) & (F.xxhash64(docs[text_col]) == bad[body])
    if remove == "documents":
        return docs.join(bad, same, "left_anti")
    text = F.when(F.col(spans).isNull(), docs[text_col]).otherwise(_without_spans(docs[text_col], F.col(spans)))
    return docs.join(bad, same, "left").select(*(text.alias(c) if c == text_col else docs[c] for c in docs.columns))
