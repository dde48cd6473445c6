"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1/-1 (hashed from the letter, so every task has the same). An n-gram is bound from
the permuted vectors of its letters: rotate^(n-1)(first) * ... * last. A text is bundled: the sum of the vectors of its
n-grams. The profile of a language is the sum over its training texts, each scaled to length 1 so that no long text
stands for the language; a text gets the language whose profile has the greatest cosine with its vector.

Profiles are learnt from at most ``per_language`` texts of each language (a documented bound on training rows: those
with a letter and the smallest hash of their id), whole texts each, and only from rows that training may see. Rows are
counted per language first; only those whose hash is below what makes ``per_language`` certain enough are ranked, some
hundreds per language whatever the data. Vectors are added up per language and dimension before anything reaches the
driver: one vector per language. That, the count of each language and the ids of the training rows are what is broadcast. All
of it is bounded by ``languages`` (the most frequent ones of the training rows are learnt, a documented bound: there are
fewer real languages), so a column full of something else can't make it grow: 3 million ids and 32 MB of vectors at
most. Prediction reads every whole text once, without a shuffle.

Letters (Unicode category L) are lower-cased; every run of other characters is one space, so n-grams know where words
begin and end.

Defined cases: null texts and texts without a letter are ``und`` with score 0; digits, numerals such as "Ⅷ"
and marks aren't letters. A very long text is read in runs of ``RUN_CHARS``. Equal cosines: the smaller language name.
Rows with a null id or language aren't learnt from. Of rows that repeat a training id and language, the one with the
smallest text is learnt from; all are predicted. Without any training row every text is ``und``. Other columns don't
matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import table

DIMENSIONS, N = 1024, 3
PER_LANGUAGE, LANGUAGES = 400, 8_192
#: Vectors are added up as whole numbers of this fraction, so sums don't depend on the order of rows.
UNIT = 2.0**40
#: n-gram vectors that a task remembers; emptied when full.
CACHED = 40_000
#: Texts of one matrix product, and rows whose vectors are held at once.
BLOCK, ROWS = 64, 1024
#: A text's n-grams are counted in runs of so many characters.
RUN_CHARS = 1_000_000
_OTHER = regex.compile(r"\P{L}+")
#: A letter for the engine's regexp, and code points that it doesn't know yet.
LETTER = r"[\p{L}\p{Cn}]"


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


class Bundler:
    """Text to hypervector, in one process."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = N):
        self.dimensions, self.n = dimensions, n
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((0, dimensions), dtype=np.float32)
        self.filled = 0

    def letter(self, code: int) -> np.ndarray:
        known = self.letters.get(code)
        if known is None:
            bits = b"".join(xxhash.xxh3_128_digest(f"{code}|{k}".encode()) for k in range((self.dimensions + 127) // 128))
            known = np.unpackbits(np.frombuffer(bits, dtype=np.uint8))[: self.dimensions].astype(np.int8) * 2 - 1
            if len(self.letters) < CACHED:
                self.letters[code] = known
        return known

    def _bound(self, gram: tuple[int, ...]) -> np.ndarray:
        vector = np.ones(self.dimensions, dtype=np.int8)
        for k, code in enumerate(gram):
            vector = vector * np.roll(self.letter(code), self.n - 1 - k)
        return vector.astype(np.float32)

    def _rows_of(self, keys: list[int]) -> list[int]:
        if self.filled + len(keys) > CACHED:
            self.rows, self.filled = {}, 0
        for key in keys:
            if key not in self.rows:
                if self.filled == len(self.vectors):
                    self.vectors = np.concatenate((self.vectors, np.empty((max(2048, self.filled), self.dimensions), np.float32)))
                self.vectors[self.filled] = self._bound(tuple(key >> (21 * (self.n - 1 - k)) & 0x1FFFFF for k in range(self.n)))
                self.rows[key], self.filled = self.filled, self.filled + 1
        return [self.rows[k] for k in keys]

    def _grams(self, text: str) -> Iterator[np.ndarray]:
        """The n-gram keys of a text, run by run; nothing without a letter."""
        whole, tail = f"{text} ", " "
        for start in range(0, len(whole), RUN_CHARS):
            run = _OTHER.sub(" ", whole[start : start + RUN_CHARS].lower())
            run = tail + (run[1:] if tail.endswith(" ") and run.startswith(" ") else run)
            tail = run[-(self.n - 1) :]
            codes = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            count = len(codes) - self.n + 1
            if count > 0 and not run.isspace():
                keys = np.zeros(count, dtype=np.int64)
                for k in range(self.n):
                    keys = keys << 21 | codes[k : k + count]
                yield keys

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A row per text, the sum of the vectors of all its n-grams; whether the text has a letter."""
        sums = np.zeros((len(texts), self.dimensions), dtype=np.float64)
        any_letter = np.zeros(len(texts), dtype=bool)
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0
        for k, text in enumerate(texts):
            for keys in self._grams(text) if text else ():
                any_letter[k] = True
                grams, times = np.unique(keys, return_counts=True)
                for part in range(0, len(grams), CACHED // 4):
                    waiting.append((k, grams[part : part + CACHED // 4], times[part : part + CACHED // 4]))
                    size += len(waiting[-1][1])
                    if len(waiting) >= BLOCK or size >= 4 * CACHED:
                        self._add(sums, waiting)
                        waiting, size = [], 0
        if waiting:
            self._add(sums, waiting)
        return sums, any_letter

    def _add(self, sums: np.ndarray, waiting: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """One product of counts and vectors for a block of texts."""
        grams, column = np.unique(np.concatenate([g for _, g, _ in waiting]), return_inverse=True)
        row = np.repeat(np.arange(len(waiting)), [len(g) for _, g, _ in waiting])
        for part in range(0, len(grams), CACHED // 4):
            inside = (column >= part) & (column < part + CACHED // 4)
            width = min(CACHED // 4, len(grams) - part)
            counts = np.zeros((len(waiting), width), dtype=np.float32)
            counts[row[inside], column[inside] - part] = np.concatenate([t for _, _, t in waiting])[inside]
            rows = self._rows_of(grams[part : part + width].tolist())
            np.add.at(sums, [k for k, _, _ in waiting], counts @ self.vectors[rows])


def profiles(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit vector per language from the training rows (``held_out`` ones are never read); at most ``per_language`` each, of at most ``languages`` languages."""
    usable = ~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.coalesce(F.col(text_col).cast("string").rlike(LETTER), F.lit(False))
    seen = docs.filter(usable).select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"))
    seen = seen.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) / F.lit(float(2**31)))
    enough = per_language + 10 * math.sqrt(per_language) + 50  # fewer than per_language come of it about once in 10^20 times
    shares = seen.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(languages).select("lang", (F.lit(enough) / F.col("rows")).alias("share"))
    few = seen.join(F.broadcast(shares), "lang").filter("draw < share").select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = few.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_language).select("doc_id", "lang")
    texts = docs.filter(usable).select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def bundles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundler, sums = Bundler(), {}
        for frame in frames:
            for start in range(0, len(frame), ROWS):
                part = frame.iloc[start : start + ROWS]
                vectors, any_letter = bundler.bundle(part["text"].tolist())
                for lang, vector in zip(part["lang"][any_letter], vectors[any_letter], strict=True):
                    sums[lang] = sums.get(lang, 0) + np.rint(vector / max(np.linalg.norm(vector), 1e-12) * UNIT).astype(np.int64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    parts = rows.mapInPandas(bundles, "lang string, vector array<long>").select("lang", F.posexplode("vector").alias("place", "value"))
    summed = parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    whole = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("all")).select("lang", F.col("all.value").alias("vector"))
    found = {row["lang"]: np.array(row["vector"], dtype=np.float64) for row in whole.collect()}
    return {lang: (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32) for lang, v in sorted(found.items())}


def identify(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``; the score is the cosine, at least 0."""
    shared = docs.sparkSession.sparkContext.broadcast((list(known), np.stack(list(known.values())) if known else np.zeros((0, DIMENSIONS), np.float32)))

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, vectors = shared.value
        bundler = Bundler()
        for frame in frames:
            langs, scores = np.full(len(frame), "und", dtype=object), np.zeros(len(frame))
            for start in range(0, len(frame) if names else 0, ROWS):
                sums, any_letter = bundler.bundle(frame["text"].iloc[start : start + ROWS].tolist())
                cosines = sums @ vectors.T / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
                at = start + np.flatnonzero(any_letter)
                langs[at] = np.array(names, dtype=object)[cosines[any_letter].argmax(axis=1)]
                scores[at] = cosines[any_letter].max(axis=1).clip(0.0, 1.0)
            yield frame[["doc_id", "held_out"]].assign(lang_pred=langs, score=scores)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, profiles(docs))
