"""SentencePiece encoding and decoding with forward states shared by the prefixes of words.

Texts are cut into marked words (runs of the mark U+2581 and what follows, up to the next mark): no piece reaches over
such a cut. Of each block of texts the distinct words are sorted, which is a trie in depth-first order: each word keeps
the forward states of the prefix that it shares with the word before and computes only the rest.

* For a *unigram* vocabulary the forward state of a prefix is its best score (Viterbi).
* For a *BPE* vocabulary the segmentation of best score isn't the model's encoding. The forward state of a prefix is then
  the one last piece of its BPE encoding: the piece that ends there and is compatible with the last piece of what stands
  before it. A pair is compatible when BPE leaves its concatenation as that pair; encodings are exactly the sequences of
  which all neighbours are compatible.

Both are exactly what the public library gives for the same model file. A prefix keeps its last piece only; ids are read
off backwards once a word ends. Everything is per task: there is no shuffle. Memory is a block of texts (cut by
characters between words), caches that are emptied when full (at ``CACHED_WORDS`` words or ``CACHED_CHARS``
code points of them), and for the longest unbroken word some 100 bytes per code point.

Defined cases: null and empty texts have no ids. A character outside the vocabulary becomes its bytes, or one unknown
id for a run of them if the model has no bytes. A very long text is encoded in runs of about ``BLOCK_CHARS``. U+2581 in a text decodes to a space, as in the library. Repeated rows
are encoded each; no rows give no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import id_and_text, in_blocks, lean, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A block of texts is closed at so many characters; longer texts are encoded in runs of about as many.
BLOCK_CHARS = 1_000_000
#: Words remembered between blocks, and compatible pairs; both are emptied when full.
CACHED_WORDS, CACHED_CHARS, CACHED_PAIRS = 300_000, 6_000_000, 300_000
#: What an unknown character costs below the worst piece (unigram).
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces in the order of their ids, with what encoding and decoding need. Its size is that of the model file."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    unigram: bool
    dummy_prefix: bool
    byte_fallback: bool
    unk_surface: str

    @staticmethod
    def read(path: str = MODEL, unigram: bool | None = None) -> Vocabulary:
        """``unigram``: take the pieces as a unigram model, or not; by default what the file says."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normaliser, trainer = model.normalizer_spec, model.trainer_spec
        if normaliser.precompiled_charsmap or normaliser.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix or trainer.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models without normalisation are supported")
        if any(x.type == 4 for x in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        return Vocabulary(
            tuple(x.piece for x in model.pieces), tuple(x.score for x in model.pieces), tuple(x.type for x in model.pieces),
            trainer.model_type == 1 if unigram is None else unigram, normaliser.add_dummy_prefix, trainer.byte_fallback, trainer.unk_surface,
        )


class _Lengths(dict):
    """Lengths, from 2, of the pieces that end in a text of up to three characters, the longest first."""

    def __init__(self, pieces: dict[str, int]):
        super().__init__()
        self.pieces = pieces
        self.tails: dict[str, set[int]] = {}
        for piece in pieces:
            if len(piece) > 2:
                self.tails.setdefault(piece[-3:], set()).add(len(piece))

    def __missing__(self, tail: str) -> tuple[int, ...]:
        if len(self) > CACHED_PAIRS:
            self.clear()
        two = {2} if len(tail) > 1 and tail[-2:] in self.pieces else set()
        found = self[tail] = tuple(sorted(self.tails.get(tail, set()) | two, reverse=True))
        return found


class Encoder:
    """Encodes and decodes in one process."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.ids = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.kinds[i] == 1}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = vocabulary.kinds.index(2)
        self.bytes_at = {int(p[3:5], 16): i for i, p in enumerate(vocabulary.pieces) if vocabulary.kinds[i] == 6}
        self.worst = min((vocabulary.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.coded = {p: np.int32(i).tobytes() for p, i in self.ids.items()}
        self.lengths = _Lengths(self.ids)
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.follow: defaultdict[str, dict[str, bool]] = defaultdict(dict)
        self.pairs = 0
        letters = set("".join(self.ids))
        alone = "".join(c for c in "\n\t\r" if c not in letters)  # in no piece, so nothing joins them
        whole = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.units = re.compile(r"(?s).+" if whole else f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        self.cut_at = None if whole else MARK
        self.out = [self._surface(i) for i in range(len(vocabulary.pieces))]

    # -- encoding ---------------------------------------------------------------------------------------------------

    def _bpe(self, text: str) -> list[str]:
        """Plain BPE of a short text: the best-scored neighbouring pair that is a piece is joined, the left one of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.v.scores[i] > best):
                    best, at = self.v.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        """Whether BPE leaves the concatenation as these two; ``left`` is empty at the start of a word."""
        known = self.follow[left][right] = self._bpe(left + right) == ([left, right] if left else [right])
        self.pairs += 1
        return known

    def _bpe_states(self, word: str, last: list[str], after: list[dict[str, bool]]) -> None:
        """Extend ``last`` (last piece of each prefix; ``after``: what may follow it) to the whole word.

        A prefix that no longer piece fits ends in one character.
        """
        lengths, ids, follow = self.lengths, self.ids, self.follow
        for at in range(len(last), len(word) + 1):
            piece = word[at - 1]
            for length in lengths[word[at - 3 if at > 3 else 0 : at]]:
                if length <= at:
                    longer = word[at - length : at]
                    known = after[at - length].get(longer)
                    if known or known is None and longer in ids and self._compatible(last[at - length], longer):
                        piece = longer
                        break
            last.append(piece)
            after.append(follow[piece])

    def _unigram_states(self, word: str, last: list[str], score: list[float]) -> None:
        """Extend the best score of each prefix, and the last piece that it comes from."""
        for at in range(len(last), len(word) + 1):
            best, chosen = None, ""
            for length in range(min(self.longest, at), 0, -1):
                piece = word[at - length : at]
                i = self.ids.get(piece)
                gain = self.v.scores[i] if i is not None else self.worst if length == 1 else None
                if gain is not None and (best is None or score[at - length] + gain > best):
                    best, chosen = score[at - length] + gain, piece
            last.append(chosen)
            score.append(best)

    def _back(self, last: list[str], at: int) -> bytes:
        """The ids of a word, read off its prefixes' last pieces from its end."""
        pieces, coded = [], self.coded
        while at:
            piece = last[at]
            pieces.append(coded.get(piece) or self._spell(piece))
            at -= len(piece)
        pieces.reverse()
        return b"".join(pieces)

    def _spell(self, piece: str) -> bytes:
        """Ids, as 32-bit integers, of a character that is no piece."""
        found = [self.bytes_at[b] for b in piece.encode()] if self.v.byte_fallback else [self.unknown]
        return np.array(found, dtype=np.int32).tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode words that aren't remembered: in sorted order, from the end of the prefix shared with the one before."""
        fresh = sorted(words - self.words.keys())
        if len(self.words) + len(fresh) > CACHED_WORDS or self.held > CACHED_CHARS:
            self.words.clear()
            self.held, fresh = 0, sorted(words)
        self.held += sum(map(len, fresh))
        if self.pairs > CACHED_PAIRS:
            self.follow.clear()
            self.pairs = 0
        before, last, score, after = "", [""], [0.0], [self.follow[""]]
        for word in fresh:
            shared = len(before)
            if not word.startswith(before):
                shared, most = 0, min(shared, len(word))
                while shared < most and before[shared] == word[shared]:
                    shared += 1
            del last[shared + 1 :], score[shared + 1 :], after[shared + 1 :]
            if self.v.unigram:
                self._unigram_states(word, last, score)
            else:
                self._bpe_states(word, last, after)
            self.words[word] = self._back(last, len(word))
            before = word

    def _runs(self, text: str) -> Iterator[list[str]]:
        """The units of a text, in runs of about BLOCK_CHARS."""
        marked = (MARK if self.v.dummy_prefix else "") + text.replace(" ", MARK) if text else ""
        start = 0
        while start < len(marked):
            end = marked.find(self.cut_at, start + BLOCK_CHARS) if self.cut_at else -1
            while 0 < end and marked[end - 1] == MARK:  # a run of marks isn't cut
                end = marked.find(self.cut_at, end + 1)
            end = len(marked) if end < 0 else end
            yield self.units.findall(marked, start, end)
            start = end

    def encode_block(self, texts: list[str]) -> list[np.ndarray]:
        found = []
        if sum(map(len, texts)) <= 2 * BLOCK_CHARS:
            units = [[u for run in self._runs(t) for u in run] for t in texts]
            self.learn({u for us in units for u in us})
            found = [b"".join(map(self.words.__getitem__, us)) for us in units]
        else:
            for text in texts:
                parts = []
                for run in self._runs(text):
                    self.learn(set(run))
                    parts.append(b"".join(map(self.words.__getitem__, run)))
                found.append(b"".join(parts))
        if not self.v.byte_fallback:
            return [self._joined(np.frombuffer(x, dtype=np.int32)) for x in found]
        return [np.frombuffer(x, dtype=np.int32) for x in found]

    def _joined(self, ids: np.ndarray) -> np.ndarray:
        """A run of unknown ids is one, over the ends of words too."""
        again = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[np.concatenate(([True], ~again))] if len(ids) else ids

    def encode(self, text: str | None) -> list[int]:
        return self.encode_block([text or ""])[0].tolist()

    # -- decoding ---------------------------------------------------------------------------------------------------

    def _surface(self, i: int) -> bytes:
        kind, piece = self.v.kinds[i], self.v.pieces[i]
        if kind == 6:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == 3 else self.v.unk_surface.encode() if kind == 2 else piece.replace(MARK, " ").encode()

    def decode(self, ids) -> str:
        whole = b"".join(map(self.out.__getitem__, ids))
        if self.v.dummy_prefix and whole.startswith(b" ") and len(ids) and self.v.kinds[ids[0]] == 1:
            whole = whole[1:]
        return whole.decode("utf-8", "replace")


def encode(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids, decoded_sha256, round_trip`` (decoding gives the very text)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for block in (block for batch in batches for block in in_blocks(batch, BLOCK_CHARS)):
            texts = block.column("text").to_pylist()
            ids = encoder.encode_block(texts)
            decoded = [encoder.decode(x.tolist()) for x in ids]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            columns = [
                block.column("doc_id"),
                pa.array(np.diff(offsets).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                pa.array([t == s for t, s in zip(decoded, texts, strict=True)]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: ``doc_id, text``; null ids decode to the empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(path))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            texts = [encoder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    ids = F.col(ids_col).cast("array<int>").alias("ids")
    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), ids).mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
