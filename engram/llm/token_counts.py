r"""Edit-aware token counts: a segment tree of pre-tokens per document, re-encoding only what an edit touches.

A byte-level BPE first cuts a text into pre-tokens by a pattern and then encodes each alone, so a document's token count
is a sum over pre-tokens. A leaf of the tree stands for a run of about ``LEAF`` pre-tokens; every node holds the sums of
its subtree (code points, tokens, pre-tokens, leaves). An edit (replace a span by a string)

1. finds the pre-token that the span touches by descending the sums and begins at the one before it: the pattern looks no
   further ahead;
2. cuts and counts from there in the edited text until a cut falls on an old cut behind the span. From such a place the
   pattern gives the same pre-tokens as before, whatever stands before it;
3. splits the tree at both places and joins what is left with the new leaves. Only nodes on the paths to those places get
   new sums, about the logarithm of the number of leaves; subtrees behind, between and before stay as they are.

So apart from copying the text itself the work is that of the edit and its surroundings, and the counts are exactly those
of encoding the whole text anew. ``trees`` gives a table with a tree per document (code points and tokens of its
pre-tokens); ``apply`` reads such a table, applies edits, and returns the same columns, so a later edit goes on from
there without encoding the document again. ``with_edits`` joins a table of edits to it. Each document is a row on its
own; only that join shuffles.

Defined cases: null and empty texts have no leaf and no tokens. A span is cut to the text; a null start is the end of the
text, a null end the start of the span; a null replacement is empty. Edits of a document are applied by ``seq``, equal
ones by start, end and replacement; edits of unknown ids do nothing, those of a null id neither. Special tokens' strings
in a text are ordinary text. A very long text is one row: its tree takes some 100 bytes a pre-token. Repeated rows are
counted each. No rows give no rows. Only the named columns are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import id_and_text, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-token pattern of this vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of a leaf.
LEAF = 32
CACHED = 300_000
#: A pre-token is one number: code points above, tokens in the lower half.
HALF = 32
TOKENS = (1 << HALF) - 1
#: Rows whose trees exist at once.
ROWS = 32


class _Known(dict):
    """Code points and tokens of each pre-token, as one number so that both add up at once; emptied when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        found = self[piece] = len(piece) << HALF | len(self.encode(piece))
        return found


class Counter:
    """Tokens of a pre-token, in one process; remembered up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern)
        self.known = _Known(self.encoding.encode_ordinary)

    def __call__(self, piece: str) -> int:
        return self.known[piece] & TOKENS


class _Node:
    """A leaf of the segment tree with the sums of all leaves under it; in the order of the text: left, own, right.

    ``own`` are the leaf's pre-tokens, packed.
    """

    __slots__ = ("chars", "tokens", "pieces", "leaves", "own", "sums", "left", "right")

    def __init__(self, own: list[int], left: _Node | None = None, right: _Node | None = None):
        total = sum(own)
        self.own, self.sums = own, (total >> HALF, total & TOKENS)
        self.hang(left, right)

    def hang(self, left: _Node | None, right: _Node | None) -> _Node:
        self.left, self.right = left, right
        self.chars, self.tokens = self.sums
        self.pieces, self.leaves = len(self.own), 1
        for side in (left, right):
            if side is not None:
                self.chars += side.chars
                self.tokens += side.tokens
                self.pieces += side.pieces
                self.leaves += side.leaves
        return self


def _balanced(leaves: list[list[int]], lo: int, hi: int) -> _Node | None:
    if lo == hi:
        return None
    middle = (lo + hi) // 2
    return _Node(leaves[middle], _balanced(leaves, lo, middle), _balanced(leaves, middle + 1, hi))


def _leaves(pieces: list[int]) -> list[list[int]]:
    """Leaves of about equal numbers of pre-tokens."""
    n = -(-len(pieces) // LEAF)
    return [pieces[len(pieces) * k // n : len(pieces) * (k + 1) // n] for k in range(n)]


class Tree:
    """Token counts of one text. ``encoded``: pre-tokens counted so far; ``touched``: nodes whose sums were set by edits."""

    def __init__(self, text: str, counter: Counter, pieces: list | None = None):
        self.text, self.counter, self.encoded, self.touched = text, counter, 0, 0
        if pieces is None:
            packed = list(map(counter.known.__getitem__, counter.cut.findall(text)))
            self.encoded = len(packed)
        else:
            packed = [x if isinstance(x, int) else x[0] << HALF | x[1] for x in pieces]
        leaves = _leaves(packed)
        self.root = _balanced(leaves, 0, len(leaves))

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def pieces(self) -> int:
        return self.root.pieces if self.root else 0

    def every(self) -> list[tuple[int, int]]:
        """Code points and tokens of all pre-tokens."""
        return [(x >> HALF, x & TOKENS) for x in self.packed()]

    def packed(self) -> list[int]:
        found, waiting, node = [], [], self.root
        while waiting or node:
            if node:
                waiting.append(node)
                node = node.left
            else:
                node = waiting.pop()
                found += node.own
                node = node.right
        return found

    def _leaf(self, place: int) -> tuple[int, list[int]]:
        """Where the leaf with code point ``place`` (or the last) begins, and its pre-tokens."""
        node, start, found = self.root, 0, (0, [])
        while node:
            begin = start + (node.left.chars if node.left else 0)
            if place < begin:
                node = node.left
                continue
            found = (begin, node.own)
            if place < begin + node.sums[0]:
                break
            start, node = begin + node.sums[0], node.right
        return found

    def _piece(self, place: int) -> tuple[int, int]:
        """Where the pre-token with code point ``place`` (or the last) begins and ends."""
        end, own = self._leaf(place)
        begin = end
        for piece in own:
            begin, end = end, end + (piece >> HALF)
            if place < end:
                break
        return begin, end

    def _split(self, node: _Node | None, place: int) -> tuple[_Node | None, _Node | None]:
        """Leaves before and behind ``place``, the border of two leaves."""
        if node is None:
            return None, None
        self.touched += 1
        begin = node.left.chars if node.left else 0
        if place <= begin:
            before, behind = self._split(node.left, place)
            return before, node.hang(behind, node.right)
        before, behind = self._split(node.right, place - begin - node.sums[0])
        return node.hang(node.left, before), behind

    def _join(self, one: _Node | None, other: _Node | None) -> _Node | None:
        """Both one after another. The root is one of the two, drawn by their numbers of leaves, which keeps the tree flat."""
        if one is None or other is None:
            return one or other
        self.touched += 1
        draw = (one.leaves * 0x9E3779B97F4A7C15 ^ other.leaves * 0xD6E8FEB86659FD93 ^ one.chars * 0xA0761D6478BD642F) >> 13
        if draw % (one.leaves + other.leaves) < one.leaves:
            return one.hang(one.left, self._join(one.right, other))
        return other.hang(self._join(one, other.left), other.right)

    def edit(self, start: int | None, end: int | None, replacement: str | None) -> None:
        """Replace code points [start, end) of the text."""
        replacement, size = replacement or "", len(self.text)
        start = size if start is None else max(0, min(start, size))
        end = start if end is None else max(start, min(end, size))
        new, shift = self.text[:start] + replacement + self.text[end:], len(replacement) - (end - start)
        begin = self._piece(max(0, start - 1))[0]
        begin = self._piece(begin - 1)[0] if begin else 0
        border, fresh, place = self._piece(max(0, end - 1))[1], [], begin
        for match in self.counter.cut.finditer(new, begin):
            fresh.append(self.counter.known[match[0]])
            place = match.end()
            if place >= start + len(replacement) and place - shift >= end:
                if place - shift > border:
                    border = self._piece(place - shift - 1)[1]
                if place - shift == border:
                    break
        else:
            border = size
        self.encoded += len(fresh)
        self._replace(begin, border, fresh)
        self.text = new

    def _replace(self, begin: int, border: int, fresh: list[int]) -> None:
        """Put new pre-tokens between two old cuts. The leaves at both ends keep what lies outside."""
        first, head = self._leaf(begin)
        last, tail = self._leaf(max(0, border - 1))
        end = last + (sum(tail) >> HALF)
        kept, at = [], first
        while at < begin:
            kept.append(head[len(kept)])
            at += kept[-1] >> HALF
        behind, at = [], end
        while at > border:
            behind.append(tail[-1 - len(behind)])
            at -= behind[-1] >> HALF
        before, rest = self._split(self.root, first)
        after = self._split(rest, end - first)[1]
        leaves = _leaves(kept + fresh + behind[::-1])
        self.root = self._join(self._join(before, _balanced(leaves, 0, len(leaves))), after)


_TREE = "doc_id long, text string, piece_chars array<int>, piece_tokens array<int>"
_PIECES = ("piece_chars", "piece_tokens")


def _shared_ranks(df: DataFrame, path: str):
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _counter(ranks: bytes) -> Counter:
    return Counter({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())})


def _columns(trees: list[Tree]) -> dict[str, pa.Array]:
    pieces = [t.packed() for t in trees]
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int32))
    flat = np.concatenate([np.array(p, dtype=np.int64) for p in pieces]) if pieces else np.empty(0, np.int64)
    halves = (flat >> HALF).astype(np.int32), (flat & TOKENS).astype(np.int32)
    return {"text": pa.array([t.text for t in trees], pa.string())} | {name: pa.ListArray.from_arrays(offsets, pa.array(half)) for name, half in zip(_PIECES, halves, strict=True)}


def _read(chars: pa.ListArray, tokens: pa.ListArray) -> list[list[int]]:
    """The packed pre-tokens of each row."""
    flat = (chars.flatten().to_numpy().astype(np.int64) << HALF | tokens.flatten().to_numpy()).tolist()
    ends = np.cumsum(chars.value_lengths().to_numpy()).tolist()
    return [flat[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]


def trees(docs: DataFrame, path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text, piece_chars, piece_tokens``, which ``apply`` goes on from."""
    shared = _shared_ranks(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                columns = _columns([Tree(text, counter) for text in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *columns.values()], names=["doc_id", *columns])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, _TREE)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """``trees`` with the rows of ``edits`` (doc_id, seq, start, end, replacement) of each document as one array."""
    rows = edits.filter("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("edited_id"),
        F.struct(F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("replacement").cast("string").alias("replacement")).alias("edit"),
    )
    lists = rows.groupBy("edited_id").agg(F.sort_array(F.collect_list("edit")).alias("edits"))
    own = F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement")))
    return trees.join(lists, trees["doc_id"] == lists["edited_id"], "left").select(*[trees[c] for c in ("doc_id", "text", *_PIECES)], own.alias("edits"))


def apply(trees: DataFrame, edits_col: str = "edits", path: str = RANKS) -> DataFrame:
    """The columns of ``trees`` after the edits in an array column of (start, end, replacement), applied in order, and
    ``n_tokens, n_pretokens, tokens_before, pretokens_before, chars_before, reencoded`` (pre-tokens counted anew)."""
    shared = _shared_ranks(trees, path)
    numbers = ("n_tokens", "n_pretokens", "tokens_before", "pretokens_before", "chars_before", "reencoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part, done, rows = batch.slice(start, ROWS), [], []
                for text, pieces, edits in zip(part.column(1).to_pylist(), _read(part.column(2), part.column(3)), part.column(4).to_pylist(), strict=True):
                    tree = Tree(text, counter, pieces)
                    before = (tree.tokens, tree.pieces, len(text))
                    for edit in edits or ():
                        tree.edit(edit["start"], edit["end"], edit["replacement"])
                    done.append(tree)
                    rows.append((tree.tokens, tree.pieces, *before, tree.encoded))
                columns = _columns(done) | dict(zip(numbers, (pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns.values()], names=["doc_id", *columns])

    edits = F.col(edits_col).cast("array<struct<start:bigint,end:bigint,replacement:string>>").alias("edits")
    read = trees.select("doc_id", "text", *_PIECES, edits)
    return read.mapInArrow(run, f"{_TREE}, {', '.join(f'{n} long' for n in numbers)}")


def example_edits(text: Column) -> Column:
    """The edits of the registered query: a word put in at a third, a tenth taken out at a half, the end extended; places
    are of the text as the edits before it left it."""
    n, put = F.length(text), " (edited) "
    third, half, tenth = (F.floor(n / k) for k in (3, 2, 10))
    spans = [(third, third, put), (half, half + tenth, ""), (n + len(put), n + len(put), "\nThe end.")]
    return F.array(*[F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(new).alias("replacement")) for a, b, new in spans])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = trees(table(spark, sf_dir, "documents"))
    done = apply(kept.withColumn("edits", example_edits(F.col("text"))))
    return done.select(
        "doc_id", F.col("chars_before").alias("n_chars"), F.col("pretokens_before").alias("n_pretokens"), F.col("tokens_before").alias("n_tokens"),
        F.length("text").cast("long").alias("edited_chars"), F.col("n_tokens").alias("edited_tokens"), "reencoded",
    )
