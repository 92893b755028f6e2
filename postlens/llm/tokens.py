"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens: each leaf is a run of pre-tokens with its characters and tokens,
each inner node the sums of its children. An edit finds its leaves by descending the tree, re-encodes from the boundary
before the edited region (with the context that the pre-token pattern looks at) up to the first old boundary after it
that is a boundary again, and updates the sums above the leaves it replaced. All other text is left alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A public byte-level BPE vocabulary of ranks, and the pattern that splits text before its merges (fixed value).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A pre-token depends on this many characters from its end on: white space and contractions look ahead.
CONTEXT = 2
#: Pre-tokens of a new leaf; a leaf may grow to twice as many.
LEAF = 32
_CACHE = 200_000
STATE = "doc_id long, text string, n_tokens long, chars array<int>, tokens array<int>"


class Encoder:
    """Token counts of pre-tokens, of which the latest are remembered."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= 32:
                if len(self.known) >= _CACHE:
                    self.known.clear()
                self.known[piece] = n
        return n

    def pieces(self, text: str, start: int) -> Iterator[str]:
        return (m.group() for m in self.pattern.finditer(text, start))


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Tree:
    """The segment tree of one text. ``chars`` and ``tokens`` are heaps: node i has the children 2i and 2i + 1."""

    def __init__(self, encoder: Encoder, text: str, chars: list[int] | None = None, tokens: list[int] | None = None):
        self.encoder, self.text = encoder, text
        if chars is None:
            pieces = encoder.pattern.findall(text)
            self._build(*_leaves([len(p) for p in pieces], [encoder.count(p) for p in pieces], LEAF))
        else:
            self.chars, self.tokens = chars, tokens
            self.width = len(chars) // 2

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.width = 1 << max(0, len(chars) - 1).bit_length()
        out = []
        for leaves in (chars, tokens):
            level = np.zeros(self.width, np.int64)
            level[: len(leaves)] = leaves
            levels = [level]
            while len(level) > 1:
                level = level[0::2] + level[1::2]
                levels.append(level)
            out.append([0, *np.concatenate(levels[::-1]).tolist()])
        self.chars, self.tokens = out

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character at a position (the last one at the end of the text), and where it starts."""
        node, start = 1, 0
        position = min(position, self.chars[1] - 1)
        while node < self.width:
            node *= 2
            if position - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node and (more_chars or more_tokens):
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def edit(self, start: int, length: int, insert: str) -> int:
        """Replace ``length`` characters from ``start`` on; returns how many characters were encoded again.

        Places outside the text are moved to its nearest end.
        """
        size = len(self.text)
        low = min(max(start, 0), size)
        high = min(max(start + max(length, 0), low), size)
        shift = len(insert) - (high - low)
        text = self.text[:low] + insert + self.text[high:]
        first, begin = self.leaf_at(max(0, low - CONTEXT)) if size else (0, 0)
        last, end = first, begin + self.chars[self.width + first]
        position, lengths, counts = begin, [], []
        pieces = self.encoder.pieces(text, begin)
        while True:
            # On to the first old boundary that lies after the edit and not before where encoding has come to.
            while last < self.width - 1 and (end < high or end + shift < position):
                last += 1
                end += self.chars[self.width + last]
            if position == end + shift and end >= high:
                break
            piece = next(pieces, None)
            if piece is None:
                break
            lengths.append(len(piece))
            counts.append(self.encoder.count(piece))
            position += len(piece)
        self.text = text
        self._replace(first, last, lengths, counts)
        return position - begin

    def _replace(self, first: int, last: int, lengths: list[int], counts: list[int]) -> None:
        """Leaves ``first`` to ``last`` get the pre-tokens: spread over them if they fit, else the tree is built anew."""
        room = last - first + 1
        if len(lengths) <= 2 * LEAF * room:
            new = _leaves(lengths, counts, max(1, -(-len(lengths) // room)))
            for i in range(room):
                self._set(first + i, new[0][i] if i < len(new[0]) else 0, new[1][i] if i < len(new[1]) else 0)
        else:
            new = _leaves(lengths, counts, LEAF)
            old = [heap[self.width :] for heap in (self.chars, self.tokens)]
            self._build(*(a[:first] + b + a[last + 1 :] for a, b in zip(old, new)))


def _leaves(lengths: list[int], counts: list[int], size: int) -> tuple[list[int], list[int]]:
    if not lengths:
        return [], []
    at = np.arange(0, len(lengths), size)
    return np.add.reduceat(lengths, at).tolist(), np.add.reduceat(counts, at).tolist()


def _state(id_: int | None, tree: Tree | None) -> tuple:
    if tree is None:
        return id_, None, 0, None, None
    return id_, tree.text, tree.n_tokens, tree.chars, tree.tokens


_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
_NAMES = ["doc_id", "text", "n_tokens", "chars", "tokens"]


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def counted(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The state of every row of ``docs``: id, text, ``n_tokens`` and its tree (``STATE``).

    A null text has no tree and 0 tokens, an empty one an empty tree. Rows with equal ids each have a state. Other
    columns are not read. The vocabulary is a file of ranks that is at the same path on all machines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                rows.append(_state(batch.column(0)[i].as_py(), None if text is None else Tree(own, text)))
                size += len(text or "")
                if size > 4 << 20:
                    yield _rows(rows, _NAMES, _TYPES)
                    rows, size = [], 0
            yield _rows(rows, _NAMES, _TYPES)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, STATE)


def edited(state: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The state after the edits: ``STATE`` with ``n_before``, ``n_edits`` and ``reencoded`` (characters).

    ``edits`` has ``doc_id, seq, start, length, insert``. Those of a document are applied in order of ``seq`` (then of
    start, length and insert), each to the text the one before has left. Null start and length count as 0, a null
    insert as empty. A document with a null text is edited as if it were empty, once it has an edit. Edits without a
    document, or with a null id, do nothing; every row of a repeated id is edited. A document is held by one task while
    its edits stream past it.
    """
    left = state.selectExpr(
        "doc_id", "text", "chars", "tokens", "cast(null as long) as seq", "cast(null as long) as start",
        "cast(null as long) as length", "cast(null as string) as insert", "0 as kind",
    )
    right = edits.where("doc_id is not null").selectExpr(
        "cast(doc_id as long) as doc_id", "cast(null as string) as text", "cast(null as array<int>) as chars",
        "cast(null as array<int>) as tokens", "cast(seq as long) as seq", "cast(coalesce(start, 0) as long) as start",
        "cast(coalesce(length, 0) as long) as length", "cast(insert as string) as insert", "1 as kind",
    )
    tasks = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows without an id have no edits: they are spread by their text.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    rows = left.unionByName(right).repartition(tasks, "doc_id", spread)
    rows = rows.sortWithinPartitions("doc_id", "kind", "seq", "start", "length", "insert")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        names, types = [*_NAMES, "n_before", "n_edits", "reencoded"], [*_TYPES, pa.int64(), pa.int64(), pa.int64()]
        held: list[list] = []  # trees of the rows of one id: tree, tokens before, edits, characters
        current = None
        out: list[tuple] = []
        size = 0

        def close() -> None:
            nonlocal held, size
            for tree, before, n, again in held:
                out.append((*_state(current, tree), before, n, again))
                size += len(tree.text) if tree else 0
            held = []

        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                key = column["doc_id"][i].as_py()
                if key != current or key is None:
                    close()
                    current = key
                if size > 4 << 20:
                    yield _rows(out, names, types)
                    out, size = [], 0
                if column["kind"][i].as_py() == 0:
                    text = column["text"][i].as_py()
                    tree = None if text is None else Tree(own, text, column["chars"][i].as_py(), column["tokens"][i].as_py())
                    held.append([tree, tree.n_tokens if tree else 0, 0, 0])
                else:
                    start, length, insert = (column[c][i].as_py() for c in ("start", "length", "insert"))
                    for entry in held:
                        entry[0] = entry[0] or Tree(own, "")
                        entry[2] += 1
                        entry[3] += entry[0].edit(start, length, insert or "")
        close()
        yield _rows(out, names, types)

    return rows.mapInArrow(run, f"{STATE}, n_before long, n_edits long, reencoded long")
