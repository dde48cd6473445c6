"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A text is cut into passages of up to ``PASSAGE_WORDS`` words. A passage is encoded from its words: which words they are
(folded to lower-case letters and hashed into ``LEXICON`` counts), what they look like (case, symbols, digits, endings,
hashed word shapes) and how they repeat; never from labels, language, source or id. A small network maps it to a hidden
vector h, a gated attention gives its weight

    a = softmax over the document's passages of w . (tanh(V h) * sigmoid(U h)),

and the score is sigmoid(c . sum(a h) + c0). All of it is learnt from document labels alone, by full-batch Adam with a
fixed seed, on every passage of a bounded sample of labelled rows: those with the smallest hash of their id, as many as
``MAX_TRAINING`` and, in that order, ``MAX_TRAINING_CHARS`` code points allow (the first always). These bounds limit what
the driver gathers (some 600 bytes a passage, 60 MB in all). Scoring reads every passage of every text, once, without a
shuffle.

Defined cases: null and empty texts are one passage without words. A very long text is cut into words run by run; 64
bytes a passage are kept until its last one. Labels with null id or quality are ignored, several labels of one document
vote (a tie counts as 1). Of rows that repeat a labelled id, the one with the smallest text is learnt from. Without any
training label every score is 0.5. Repeated rows are scored each; no rows give no rows. Only id and text are read, so
other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import id_and_text, in_blocks, lean, mixed, packed, table

PASSAGE_WORDS = 64
MAX_TRAINING, MAX_TRAINING_CHARS = 3000, 40_000_000
#: Passages whose intermediate values training holds at once (a document's are never parted).
FIT_PASSAGES = 32_768
HIDDEN, ATTENTION, SHAPES, LEXICON = 16, 8, 32, 128
STEPS, RATE, DECAY, SEED = 300, 0.02, 1e-3, 7
THRESHOLD = 0.3
#: A block of texts is closed at so many words; words remembered between blocks, emptied when full; code points cut at once.
BLOCK_WORDS, CACHED_WORDS, RUN_CHARS = 200_000, 100_000, 1_000_000
#: Passages whose features exist at once.
PART = 512
_SPACE = re.compile(r"\s")
_LOOKS = 14
_OF_WORDS = _LOOKS + SHAPES
_AGAIN = 4
FEATURES = _OF_WORDS + _AGAIN + LEXICON
_ALPHA, _UPPER, _DIGIT, _LOWER, _WORD, _STOP, _JOIN = (1 << k for k in range(7))


def held_out(doc_id: Column, modulus: int = 5, remainder: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


class _Characters:
    """What is asked about characters, looked up by code point; filled in as code points come up."""

    def __init__(self) -> None:
        self.kinds, self.folded, self.known = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)

    def of(self, codes: np.ndarray) -> np.ndarray:
        for code in np.unique(codes[~self.known[codes]]).tolist():
            c = chr(code)
            asked = (c.isalpha(), c.isupper(), c.isdigit(), c.islower(), c.isalnum() or c == "_", c in ".,;:?", c in "'-")
            self.kinds[code], self.known[code] = sum(1 << k for k, yes in enumerate(asked) if yes), True
            if len(c.lower()) == 1:
                self.folded[code] = ord(c.lower())
        return self.kinds[codes]


def word_features(words: list[str], characters: _Characters) -> tuple[np.ndarray, np.ndarray]:
    """A row of looks and shape, and a lexicon bucket, of each (non-empty) word; a few passes over all their characters."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    kinds, first = characters.of(codes), np.cumsum(n) - n
    owner, place = np.repeat(np.arange(len(words)), n), np.arange(len(codes)) - np.repeat(first, n)
    last = first + n - 1

    def count(yes: np.ndarray) -> np.ndarray:
        return np.add.reduceat(yes.astype(np.int64), first)

    def some(at: np.ndarray) -> np.ndarray:
        return np.bincount(owner[at], minlength=len(words)) > 0

    def run_place(of: np.ndarray) -> np.ndarray:
        """How many equal values stand directly before each, in its word."""
        begins = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (place[1:] == 0))))
        return np.arange(len(of)) - np.repeat(begins, np.diff(np.append(begins, len(of))))

    def hashed(values: np.ndarray, chosen: np.ndarray, buckets: int) -> np.ndarray:
        """A bucket for the chosen values of each word, in their order."""
        at = np.cumsum(chosen) - chosen
        total = mixed(values.astype(np.uint64) | (at - at[first][owner]).astype(np.uint64) << np.uint64(32)) * chosen.astype(np.uint64)
        return (mixed(np.add.reduceat(total, first)) % np.uint64(buckets)).astype(np.int64)

    alpha, upper, digit = ((kinds & k) > 0 for k in (_ALPHA, _UPPER, _DIGIT))
    letters, uppers, digits = count(alpha), count(upper), count(digit)
    plain, joins = (kinds & _WORD) > 0, (kinds & _JOIN) > 0
    parts = np.where(plain, 0, np.where(joins, 1, 2))
    once = np.flatnonzero((parts != 2) | (run_place(parts) == 0))  # runs of other symbols count once
    inside = np.flatnonzero((parts[once[:-2]] == 0) & (parts[once[1:-1]] == 2) & (parts[once[2:]] == 0) & (owner[once[:-2]] == owner[once[2:]])) if len(once) > 2 else np.empty(0, np.int64)
    rows = np.zeros((len(words), _OF_WORDS), dtype=np.float32)
    looks = (
        np.minimum(n, 40) / 10, letters / n, uppers / n, digits / n, (n - letters - digits) / n, upper[first] & (uppers == 1), (uppers == letters) & (letters > 1),
        letters == 0, (n > 1) & ~plain[last] & ~plain[last - 1], (kinds[last] & _STOP) > 0, (kinds[first] & _LOWER) > 0, some(once[inside]),
        some(np.flatnonzero(run_place(codes) == 2)), n > 20,
    )
    rows[:, :_LOOKS] = np.stack(looks, axis=1)
    shape = np.where(upper, ord("A"), np.where(alpha, ord("a"), np.where(digit, ord("0"), codes)))
    kept = run_place(shape) < np.where(alpha | digit, 1, 3)
    rows[np.arange(len(words)), _LOOKS + hashed(shape, kept, SHAPES)] = 1
    return rows, hashed(characters.folded[codes], np.where(letters[owner] > 0, alpha, True), LEXICON).astype(np.uint8)


class _Rows(dict):
    """Row of each word; words that weren't known are noted."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.fresh.append(word)
        return row


class PassageEncoder:
    """Texts to passage features, in one process."""

    def __init__(self) -> None:
        self.characters = _Characters()
        self._forget()

    def _forget(self) -> None:
        self.rows, self.table, self.buckets = _Rows(), np.empty((0, _OF_WORDS), dtype=np.float32), np.empty(0, dtype=np.uint8)

    def _ids(self, words: list[list[str]]) -> np.ndarray:
        if len(self.rows) > CACHED_WORDS:
            self._forget()
        ids = np.fromiter((i for ws in words for i in map(self.rows.__getitem__, ws)), dtype=np.int64, count=sum(map(len, words)))
        if self.rows.fresh:
            known, total = len(self.rows) - len(self.rows.fresh), len(self.rows)
            if total > len(self.table):  # room for twice as many, so that growing costs little in all
                more = 2 * total - len(self.table)
                self.table = np.concatenate((self.table, np.empty((more, _OF_WORDS), dtype=np.float32)))
                self.buckets = np.concatenate((self.buckets, np.empty(more, dtype=np.uint8)))
            self.table[known:total], self.buckets[known:total] = word_features(self.rows.fresh, self.characters)
            self.rows.fresh = []
        return ids

    def _features(self, words: list[list[str]], sizes: np.ndarray) -> np.ndarray:
        """Features of passages that hold ``words`` one after another."""
        ids, out = self._ids(words), np.zeros((len(sizes), FEATURES), dtype=np.float32)
        full = np.flatnonzero(sizes)
        if len(full):
            n = sizes[full].astype(np.float64)
            starts, owner = np.concatenate(([0], np.cumsum(sizes[full])[:-1])), np.repeat(np.arange(len(full)), sizes[full])
            out[full, :_OF_WORDS] = np.add.reduceat(self.table[ids], starts, axis=0) / n[:, None]
            key = np.sort(owner * (len(self.rows) + 1) + ids)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            times, who = np.diff(np.append(first, len(key))), key[first] // (len(self.rows) + 1)
            most = np.maximum.reduceat(times, np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))))
            again = np.bincount(owner[1:][(ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])], minlength=len(full))
            out[full, _OF_WORDS : _OF_WORDS + _AGAIN] = np.stack((np.bincount(who, minlength=len(full)) / n, again / n, most / n, np.log1p(n) / 4), axis=1)
            counts = np.bincount(owner * LEXICON + self.buckets[ids], minlength=len(full) * LEXICON).reshape(len(full), LEXICON)
            out[full, _OF_WORDS + _AGAIN :] = counts / n[:, None]
        return out

    def encode(self, texts: list[str], project: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> tuple[np.ndarray, np.ndarray]:
        """``project`` of the features of all passages, and the number of passages of each text (at least 1)."""
        out, per_text, waiting, sizes = [], np.zeros(len(texts), dtype=np.int64), [], []

        def close() -> None:
            out.append(project(self._features(waiting, np.array(sizes, dtype=np.int64))))
            waiting.clear()
            sizes.clear()

        for k, text in enumerate(texts):
            rest: list[str] = []
            for words in self._runs(text):
                words = rest + words
                whole = len(words) // PASSAGE_WORDS * PASSAGE_WORDS
                rest = words[whole:]
                for lo in range(0, whole, PART * PASSAGE_WORDS):
                    part = words[lo : min(whole, lo + PART * PASSAGE_WORDS)]
                    waiting.append(part)
                    sizes.extend([PASSAGE_WORDS] * (len(part) // PASSAGE_WORDS))
                    per_text[k] += len(part) // PASSAGE_WORDS
                    if len(sizes) >= PART:
                        close()
            if rest or not per_text[k]:
                waiting.append(rest)
                sizes.append(len(rest))
                per_text[k] += 1
            if len(sizes) >= PART:
                close()
        if sizes or not out:
            close()
        return np.concatenate(out), per_text

    @staticmethod
    def _runs(text: str) -> Iterator[list[str]]:
        """The words of a text, in runs of about RUN_CHARS code points."""
        start = 0
        while start < len(text):
            found = _SPACE.search(text, start + RUN_CHARS)
            end = found.start() if found else len(text)
            yield text[start:end].split()
            start = end


class Model:
    """Gated attention over a document's passages; numpy only."""

    def __init__(self, features: int = FEATURES, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(features), np.ones(features)
        self.w = {
            "W": r.normal(0, features**-0.5, (features, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
            "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "a": r.normal(0, ATTENTION**-0.5, ATTENTION), "c": r.normal(0, HIDDEN**-0.5, HIDDEN), "c0": np.zeros(1),
        }

    def project(self, x: np.ndarray) -> np.ndarray:
        """What the first layer makes of features; the standardising is folded into its weights."""
        scaled = self.w["W"] / self.scale[:, None]
        return x @ scaled.astype(np.float32) + (self.w["b"] - self.mean @ scaled)

    def _forward(self, first: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        h = np.tanh(first)
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        logit = (t * g) @ w["a"]
        e = np.exp(logit - np.maximum.reduceat(logit, starts)[owner])
        weight = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["c0"], -40, 40)))
        return {"h": h, "t": t, "g": g, "weight": weight, "z": z, "score": score}

    def _gradients(self, x: np.ndarray, sizes: np.ndarray, label: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """What some of the ``n`` documents, of standardised features ``x``, add to the gradients of the mean loss."""
        starts, owner = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(len(sizes)), sizes)
        w = self.w
        f = self._forward(x @ w["W"].astype(x.dtype) + w["b"], starts, owner)
        d = (f["score"] - label) / n
        dz = d[:, None] * w["c"]
        dweight = (f["h"] * dz[owner]).sum(axis=1)
        dlogit = f["weight"] * (dweight - np.add.reduceat(f["weight"] * dweight, starts)[owner])
        dt, dg = dlogit[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2), dlogit[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["weight"][:, None] * dz[owner] + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh.astype(x.dtype), "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ dlogit, "c": f["z"].T @ d, "c0": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> Model:
        ends = np.cumsum(sizes)
        bounds = np.searchsorted(ends, np.arange(0, ends[-1], FIT_PASSAGES), side="right")
        docs = [slice(lo, hi) for lo, hi in pairwise(np.unique([*bounds, len(sizes)]))]
        rows = [slice(ends[d.start] - sizes[d.start], ends[d.stop - 1]) for d in docs]
        self.mean = sum(x[r].sum(axis=0, dtype=np.float64) for r in rows) / len(x)
        self.scale = np.sqrt(sum(((x[r] - self.mean) ** 2).sum(axis=0) for r in rows) / len(x)) + 0.05
        mean, scale = self.mean.astype(np.float32), self.scale.astype(np.float32)
        standard = [(x[r] - mean) / scale for r in rows] if len(rows) == 1 else ()
        m, v = ({k: np.zeros_like(p) for k, p in self.w.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            w, grads = self.w, {k: np.zeros_like(p) for k, p in self.w.items()}
            for part, r, own in zip(docs, rows, standard or ((x[r] - mean) / scale for r in rows), strict=True):
                for k, grad in self._gradients(own, sizes[part], label[part], len(label)).items():
                    grads[k] += grad
            for k, grad in grads.items():
                grad = grad + DECAY * w[k] * (k not in ("b", "c0"))
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.99 * v[k] + 0.01 * grad**2
                w[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def score(self, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Score of each document from what the first layer made of its passages."""
        starts, owner = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(len(sizes)), sizes)
        return self._forward(first, starts, owner)["score"]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_TRAINING, most_chars: int = MAX_TRAINING_CHARS) -> Model | None:
    """Learn from the labels of rows that aren't held out; None without any."""
    seen = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label_col).cast("double").alias("label")).filter("label IN (0.0, 1.0) AND label_id IS NOT NULL")
    votes = seen.filter(~held_out(F.col("label_id"))).groupBy("label_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    chosen = votes.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    texts = id_and_text(docs, id_col, text_col)
    sized = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).groupBy("label_id", "label").agg(F.max(F.length("text")).cast("long").alias("chars"))
    so_far = F.sum("chars").over(Window.orderBy(F.xxhash64("label_id"), "label_id")) - F.col("chars")  # over ``most`` rows
    chosen = sized.withColumn("so_far", so_far).filter((F.col("so_far") == 0) | (F.col("so_far") + F.col("chars") <= most_chars)).select("label_id", "label")
    bags = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    @lean
    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = PassageEncoder()
        for frame in frames:
            x, sizes = encoder.encode(frame["text"].tolist(), lambda found: found.astype(np.float16))
            bags = np.split(x, np.cumsum(sizes)[:-1]) if len(sizes) else []
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "bag": [b.tobytes() for b in bags]})

    rows = sorted((r["doc_id"], r["label"], bytes(r["bag"])) for r in bags.mapInPandas(encode, "doc_id long, label double, bag binary").collect())
    if not rows:
        return None
    x = [np.frombuffer(b, dtype=np.float16).reshape(-1, FEATURES) for _, _, b in rows]
    return Model().fit(np.concatenate(x), np.array([len(b) for b in x]), np.array([y for _, y, _ in rows]))


def _scorer(model: Model | None, docs: DataFrame):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, model = PassageEncoder(), shared.value
        for batch in batches:
            scores, others = [np.empty(0)], [name for name in batch.schema.names if name != "text"]
            for block in in_blocks(batch, BLOCK_WORDS, lambda chars: chars // 6 + 1):
                scores.append(model.score(*encoder.encode(block.column("text").to_pylist(), model.project)) if model else np.full(block.num_rows, 0.5))
            yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(np.concatenate(scores))], names=[*others, "score"])

    return score


def classify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    rows = id_and_text(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = rows.mapInArrow(_scorer(model, docs), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns, without a shuffle."""
    row = packed(docs)
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), row.alias("row"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, score double"
    return rows.mapInArrow(_scorer(model, docs), schema).filter(F.col("score") >= threshold).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
