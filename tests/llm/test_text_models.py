"""Operators in free style: LM scoring, SentencePiece, quality, language, token counts."""

import base64
import math
import random
import re
import subprocess
import sys
from collections import Counter
from dataclasses import replace
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram.llm import language_id, lm_scoring, quality, sentence_pieces, token_counts
from engram.llm.common import in_blocks

DATA = "/root/testdata/sf0.01"
NEEDS_DATA = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
CLASH = ("block", "n_words", "score", "held_out", "label", "ids", "n_tokens", "lang_pred")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH})


# -- LM scoring -------------------------------------------------------------------------------------------------------


def backoff_brute(rows, order, alpha, least):
    words = [(t or "").encode().lower().split() for _, t in rows]
    f = {k: Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1)) for k in range(1, order + 1)}
    n = sum(map(len, words))

    def s(w, i, k):
        if k == 1:
            return f[1][(w[i],)] / n
        gram = tuple(w[i - k + 1 : i + 1])
        return f[k][gram] / f[k - 1][gram[:-1]] if f[k][gram] >= least else alpha * s(w, i, k - 1)

    return sorted((i if i is not None else -1, len(w), f"{sum(math.log(s(w, j, min(order, j + 1))) for j in range(len(w))):.4f}".replace("-0.0000", "0.0000")) for (i, _), w in zip(rows, words, strict=True))


@pytest.mark.parametrize(("order", "chars"), [(1, 10**6), (2, 10**6), (2, 300), (3, 200)])
def test_backoff_equals_brute_force_over_any_blocks(spark, order, chars):
    r = random.Random(order)
    rows = [(i, " ".join(r.choice(["a", "B", "b", "cc", "d e", "É"]) for _ in range(r.randint(0, 30)))) for i in range(80)]
    rows += [(3, "a a a"), (3, "a a a"), (None, "b b"), (99, None), (100, ""), (101, " \t\n"), (102, "w " * 3000)]
    got = lm_scoring.score(frame(spark, rows), order=order, block_chars=chars).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, f"{r.log_score:.4f}".replace("-0.0000", "0.0000")) for r in got) == backoff_brute(rows, order, 0.4, 2)
    assert {r.mean_log_score for r in got if r.n_words == 0} == {None}


@pytest.mark.parametrize(("fan_out", "chars"), [(2, 120), (3, 40), (2, 5)])
def test_backoff_in_levels_equals_brute_force(spark, fan_out, chars):
    r = random.Random(chars)
    rows = [(i, " ".join(r.choice(["a", "B", "cc", "d", "É"]) for _ in range(r.randint(0, 12)))) for i in range(40)] + [(50, "w " * 60), (None, None)]
    got = lm_scoring.score(frame(spark, rows), block_chars=chars, fan_out=fan_out).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, f"{r.log_score:.4f}".replace("-0.0000", "0.0000")) for r in got) == backoff_brute(rows, 3, 0.4, 2)


@pytest.mark.parametrize("blocks", [1, 2, 256, 257, 2_500, 83_000, 8_300_000])
def test_a_block_sends_no_more_rows_however_many_blocks_there_are(blocks):
    levels, wide, groups = lm_scoring._plan(blocks, blocks, lm_scoring.FAN_OUT)
    assert wide <= lm_scoring.FAN_OUT and wide**levels >= blocks and groups[0] == blocks and groups[levels] == 1 and len(groups) == levels + 1
    assert all(groups[n] <= wide * groups[n + 1] for n in range(levels)) and (levels == 1) == (blocks <= lm_scoring.FAN_OUT)


def test_registered_scoring_backs_off_from_trigrams(spark, tmp_path):
    rows = [(1, "a b c"), (2, "a b c"), (3, "x b c"), (4, "a b d"), (None, "c"), (6, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = lm_scoring.query(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, f"{r.log_score:.4f}") for r in got) == backoff_brute(rows, 3, 0.4, 2)


def test_blocks_without_a_word(spark):
    got = lm_scoring.score(frame(spark, [(1, None), (None, " "), (1, "")]), block_chars=1).collect()
    assert sorted((str(r.doc_id), r.n_words, r.log_score, r.mean_log_score) for r in got) == [("1", 0, 0.0, None)] * 2 + [("None", 0, 0.0, None)]


def test_backoff_of_nothing(spark):
    assert lm_scoring.score(frame(spark, [])).count() == 0


# -- SentencePiece ----------------------------------------------------------------------------------------------------

ALPHABET = [" ", "  ", "a", "b", "the", "ing", "\n", "▁", "é", "日", "😀", "aa", "0", "1", ".", ",", "\t", "er", "on", "http", "://", "    ", "\x00", "ﷺ", "S"]


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_bpe_is_what_the_library_gives(monkeypatch):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    encoder = sentence_pieces.Encoder(sentence_pieces.Vocabulary.read())
    texts = [*random_texts(3000), "", " ", "x" * 5000, "ab " * 4000]
    ids = [x.tolist() for x in encoder.encode_block(texts)]
    assert ids == library.encode(texts)
    assert [encoder.decode(x) for x in ids] == [library.decode(x) for x in ids]
    monkeypatch.setattr(sentence_pieces, "BLOCK_CHARS", 7)
    monkeypatch.setattr(sentence_pieces, "CACHED_WORDS", 50)
    monkeypatch.setattr(sentence_pieces, "CACHED_PAIRS", 20)
    small = sentence_pieces.Encoder(sentence_pieces.Vocabulary.read())
    assert [small.encode(t) for t in texts[:400]] == ids[:400]


def test_a_million_unbroken_characters_in_bounded_memory():
    code = (
        "import base64, random, resource, sentencepiece\n"
        "from engram.llm import sentence_pieces as s\n"
        "text = base64.b64encode(random.Random(1).randbytes(750_000)).decode()\n"
        "library = sentencepiece.SentencePieceProcessor(model_file=s.MODEL)\n"
        "encoder, before = s.Encoder(s.Vocabulary.read()), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "ids = encoder.encode(text)\n"
        "print(len(text), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, ids == library.encode(text))\n"
    )
    chars, megabytes, same = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split()
    assert int(chars) == 1_000_000 and int(megabytes) < 500 and same == "True"


def test_a_task_encodes_a_large_batch_in_bounded_memory():
    code = (
        "import random, re\n"
        "from types import SimpleNamespace as N\n"
        "import pyarrow as pa\n"
        "from engram.llm import sentence_pieces as s\n"
        "size = lambda what: int(re.search(what + r':\\s+(\\d+)', open('/proc/self/status').read())[1]) // 1024\n"
        "s.id_and_text = lambda *_: N(mapInArrow=lambda run, schema: run)\n"
        "run = s.encode(N(sparkSession=N(sparkContext=N(broadcast=lambda x: N(value=x)))))\n"
        "list(run(iter([pa.RecordBatch.from_pydict({'doc_id': [0], 'text': ['слово']})])))\n"
        "r = random.Random(1); words = [''.join(r.choices('абвгдежзик', k=6)) for _ in range(50)]\n"
        "texts = pa.array((' '.join(r.choices(words, k=7000)) for _ in range(400)), pa.string())\n"
        "batch = pa.RecordBatch.from_arrays([pa.array(range(400)), texts], names=['doc_id', 'text'])\n"
        "before, rows, right = size('VmRSS'), 0, True\n"
        "for out in run(iter([batch])):\n"
        "    rows += out.num_rows; right &= all(out.column(4).to_pylist())\n"
        "print(rows, right, size('VmHWM') - before)\n"
    )
    rows, right, peak = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split()
    assert (rows, right) == ("400", "True") and int(peak) < 100


def test_blocks_of_a_batch_lose_no_row_and_are_closed_by_code_points():
    texts = ["", "ж" * 3, "a" * 9, "", "b", "", "c" * 4, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["doc_id", "text"])
    assert [b.column("doc_id").to_pylist() for b in in_blocks(batch, 4)] == [[0, 1, 2], [3, 4, 5, 6], [7]]
    assert [b.num_rows for b in in_blocks(batch, 2, lambda n: 1)] == [2, 2, 2, 2]
    assert not list(in_blocks(batch.slice(0, 0), 4))


def test_unigram_finds_the_best_score():
    r = random.Random(3)
    pieces = ["<unk>", "<s>", "▁", *"abc", *{"".join(r.choice("▁abc") if k == 0 else r.choice("abc") for k in range(r.randint(2, 4))) for _ in range(40)}]
    scores = [0.0, 0.0] + [-r.uniform(1, 9) for _ in pieces[2:]]
    v = sentence_pieces.Vocabulary(tuple(pieces), tuple(scores), (2, 3) + (1,) * (len(pieces) - 2), True, True, False, " ⁇ ")
    encoder = sentence_pieces.Encoder(v)

    def best(word):
        found = {0: 0.0}
        for at in range(1, len(word) + 1):
            found[at] = max(found[k] + (scores[encoder.ids[word[k:at]]] if word[k:at] in encoder.ids else encoder.worst) for k in range(at) if word[k:at] in encoder.ids or at - k == 1)
        return found[len(word)]

    for _ in range(300):
        text = "".join(r.choice("abc ") for _ in range(r.randint(1, 25)))
        marked = "▁" + text.replace(" ", "▁")
        assert sum(scores[i] for i in encoder.encode(text)) == pytest.approx(best(marked))
        assert encoder.decode(encoder.encode(text)) == text
    assert encoder.encode("xyz") == [encoder.ids["▁"], 0]
    with pytest.raises(IndexError):
        replace(v, kinds=())
        sentence_pieces.Encoder(replace(v, kinds=()))


def test_encoding_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, ""), (4, "▁"), (5, "long " * 50_000)]
    got = sentence_pieces.encode(frame(spark, rows)).collect()
    assert len(got) == 7 and [r.round_trip for r in got] == [True] * 5 + [False, True]
    assert [r.n_tokens for r in got][3:5] == [0, 0] and all(len(r.ids) == r.n_tokens for r in got)
    back = sentence_pieces.decode(sentence_pieces.encode(frame(spark, rows))).collect()
    assert [r.text for r in back] == ["a b", "a b", "x", "", "", " ", "long " * 50_000]
    assert sentence_pieces.encode(frame(spark, [])).count() == 0


# -- quality and language ---------------------------------------------------------------------------------------------


@NEEDS_DATA
def test_quality_on_held_out_labels(spark):
    got = quality.query(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    judged = got.filter("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in judged) / len(judged) > 0.95
    good = [r for r in judged if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.97
    assert got.count() == 1000


def test_quality_edges(spark):
    rows = [(1, None), (1, ""), (None, "x y"), (7, "word " * 20_000), (8, "\x00\n\n")]
    assert {r.score for r in quality.classify(frame(spark, rows), None).collect()} == {0.5}
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["Good.", "fine", "text"] if i % 2 else ["###", "!!", "$$a"]) for _ in range(90))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(frame(spark, docs), labels)
    got = {x.doc_id: x for x in quality.classify(frame(spark, docs), model).collect()}
    assert all(got[i].predicted == i % 2 for i in range(60)) and got[0].held_out == (__import__("zlib").crc32(b"0") % 5 == 0)
    scored = quality.classify(frame(spark, rows), model).collect()
    assert len(scored) == 5 and all(0 <= x.score <= 1 for x in scored)
    kept = quality.keep_good(frame(spark, docs), model)
    assert kept.columns == frame(spark, docs).columns and {x.doc_id for x in kept.collect()} == {i for i in range(60) if i % 2}
    assert quality.classify(frame(spark, []), model).count() == 0 and quality.train(frame(spark, docs), labels.limit(0)) is None


def looks_brute(word):
    """What a word looks like, character by character."""
    n, letters, upper, digits = len(word), sum(map(str.isalpha, word)), sum(map(str.isupper, word)), sum(map(str.isdigit, word))
    return [
        min(n, 40) / 10, letters / n, upper / n, digits / n, (n - letters - digits) / n, word[0].isupper() and upper == 1, upper == letters > 1, letters == 0,
        bool(re.search(r"[^\w\s]{2,}$", word)), word[-1] in ".,;:?", word[0].islower(), bool(re.search(r"\w[^\w\s'-]+\w", word)), bool(re.search(r"(.)\1\1", word)), n > 20,
    ]


def shape_brute(word):
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", lambda m: m[1] if m[1] in "aA0" else m[1] * min(3, len(m[0])), kinds)


def test_word_features_equal_brute_force():
    r = random.Random(4)
    words = ["".join(r.choice("aabBÉ0²日#!'-_.,?😀/") for _ in range(r.randint(1, 9))) for _ in range(4000)]
    words += ["a" * 70 + "00" + "#" * 5 + "B", "aaa", "#", "a--b", "a#-#b", "a##b", "İx"]
    rows, buckets = quality.word_features(words, quality._Characters())
    assert np.allclose(rows[:, : quality._LOOKS], [looks_brute(w) for w in words])
    groups, lexicon = {}, {}
    for w, row, bucket in zip(words, rows[:, quality._LOOKS :], buckets, strict=True):
        assert row.sum() == 1
        groups.setdefault(shape_brute(w), set()).add(row.argmax())
        letters = "".join(c.lower() if len(c.lower()) == 1 else c for c in w if c.isalpha())
        lexicon.setdefault(letters or w, set()).add(bucket)
    assert {len(x) for x in groups.values()} == {1} == {len(x) for x in lexicon.values()}
    assert len(set().union(*groups.values())) == quality.SHAPES and len(set().union(*lexicon.values())) == quality.LEXICON


def test_passages_equal_brute_force_however_they_are_cut(monkeypatch):
    r = random.Random(5)
    texts = [" ".join(r.choice(["the", "The", "x##", "a1", "#"]) for _ in range(n)) for n in (0, 1, 63, 64, 65, 500)] + ["one  two\n\n two two"]
    whole, sizes = quality.PassageEncoder().encode(texts)
    want = []
    for text in texts:
        words = text.split()
        for k in range(0, max(1, len(words)), 64):
            own = words[k : k + 64]
            looks = np.mean([looks_brute(w) for w in own], axis=0) if own else np.zeros(quality._LOOKS)
            again = [len(set(own)) / len(own), sum(a == b for a, b in zip(own, own[1:], strict=False)) / len(own), max(map(own.count, own)) / len(own), math.log1p(len(own)) / 4] if own else [0] * 4
            want.append([*looks, *again])
    got = np.concatenate((whole[:, : quality._LOOKS], whole[:, quality._OF_WORDS : quality._OF_WORDS + 4]), axis=1)
    assert sizes.tolist() == [1, 1, 1, 1, 2, 8, 1] and np.allclose(got, want, atol=1e-6)
    assert np.allclose(whole[1:, quality._OF_WORDS + 4 :].sum(axis=1), 1)
    for name, value in (("RUN_CHARS", 9), ("PART", 2), ("CACHED_WORDS", 1)):
        monkeypatch.setattr(quality, name, value)
    assert np.allclose(quality.PassageEncoder().encode(texts)[0], whole)


def score_brute(model, x):
    """Gated attention over one document's passages, one after another."""
    w, hs, logits = model.w, [], []
    for row in (x - model.mean) / model.scale:
        h = np.tanh(row @ w["W"] + w["b"])
        hs.append(h)
        logits.append(sum(a * math.tanh(v) / (1 + math.exp(-u)) for a, v, u in zip(w["a"], h @ w["V"], h @ w["U"], strict=True)))
    e = [math.exp(x - max(logits)) for x in logits]
    z = sum(a / sum(e) * h for a, h in zip(e, hs, strict=True))
    return 1 / (1 + math.exp(-(z @ w["c"] + w["c0"][0])))


def test_scores_and_gradients_equal_brute_force(monkeypatch):
    r = np.random.default_rng(0)
    x, sizes, y = r.normal(size=(9, quality.FEATURES)), np.array([2, 3, 4]), np.array([0.0, 1.0, 1.0])
    model = quality.Model()
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 0.05
    docs = np.split(x, [2, 5])
    assert np.allclose(model.score(model.project(x), sizes), [score_brute(model, d) for d in docs], atol=1e-5)
    loss = lambda: -np.mean([math.log(p if t else 1 - p) for p, t in zip((score_brute(model, d) for d in docs), y, strict=True)])
    grads = model._gradients((x - model.mean) / model.scale, sizes, y, 3)
    for name, p in model.w.items():
        for at in r.choice(p.size, size=min(5, p.size), replace=False):
            old, ends = p.flat[at], []
            for step in (1e-5, -1e-5):
                p.flat[at] = old + step
                ends.append(loss())
            p.flat[at] = old
            assert abs((ends[0] - ends[1]) / 2e-5 - grads[name].flat[at]) < 1e-5
    before = loss()
    monkeypatch.setattr(quality, "STEPS", 60)
    model = quality.Model().fit(x.astype(np.float32), sizes, y)
    assert loss() < 0.3 * before


def test_training_is_bounded_and_repeated_ids_count_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.Model, "fit", lambda self, x, sizes, label: seen.append((sizes.tolist(), label.tolist())) or self)
    docs = [(i, "word " * 64) for i in range(1, 30)] + [(1, "a"), (1, "zz " * 640), (2, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, quality int")
    quality.train(frame(spark, docs), labels)
    free = [i for i in range(1, 30) if __import__("zlib").crc32(str(i).encode()) % 5]
    assert seen[-1] == ([1] * len(free), [float(i % 2) for i in free])
    quality.train(frame(spark, docs), labels, most=4)
    quality.train(frame(spark, docs), labels, most_chars=1000)
    assert len(seen[-2][0]) == 4 and 1 <= len(seen[-1][0]) <= 3


def test_training_reads_every_passage_and_parts_change_nothing(spark, monkeypatch):
    seen, fit = [], quality.Model.fit
    monkeypatch.setattr(quality.Model, "fit", lambda self, x, sizes, label: seen.append(sizes.tolist()) or fit(self, x, sizes, label))
    monkeypatch.setattr(quality, "STEPS", 20)
    docs = [(i, "word " * (64 * 100 + 1) if i == 1 else "!! x " * (40 * i)) for i in range(1, 9)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, quality int")
    whole = quality.train(frame(spark, docs), labels)
    assert 101 in seen[0]
    monkeypatch.setattr(quality, "FIT_PASSAGES", 3)
    parts = quality.train(frame(spark, docs), labels)
    scores = [m.score(*quality.PassageEncoder().encode([t for _, t in docs], m.project)) for m in (whole, parts)]
    assert np.allclose(*scores, atol=1e-3) and np.allclose(whole.scale, parts.scale)


@NEEDS_DATA
def test_language_on_held_out_rows(spark):
    got = language_id.query(spark, DATA).filter("held_out").join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_language_edges(spark, monkeypatch):
    rows = [(i, "der die das und nicht" if i % 2 else "the of and this with", "de" if i % 2 else "en") for i in range(40)]
    df = spark.createDataFrame([*rows, (50, None, "de"), (51, "123 !!", "en"), (None, "the of", None), (52, "", None)], "doc_id long, text string, lang string").withColumns({"nth": F.lit(0), "part": F.lit(0)})
    known = language_id.profiles(df)
    assert list(known) == ["de", "en"]
    got = {r.doc_id: r for r in language_id.identify(df, known).collect()}
    assert all(got[i].lang_pred == ("de" if i % 2 else "en") for i in range(40)) and got[None].lang_pred == "en"
    assert [(got[i].lang_pred, got[i].score) for i in (50, 51, 52)] == [("und", 0.0)] * 3
    assert {r.lang_pred for r in language_id.identify(df, {}).collect()} == {"und"}
    assert language_id.profiles(df.limit(0)) == {} and language_id.identify(df.limit(0), known).count() == 0


def test_rows_without_a_letter_use_up_no_bound(spark):
    rows = [(i, [None, "", "123 _!", "der die"][i % 4], "de") for i in range(80)] + [(None, "der", "de")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = language_id.profiles(df, per_language=1)
    assert list(one) == ["de"] and np.allclose(one["de"], language_id.profiles(df)["de"])


def test_only_letters_make_a_language(spark):
    rows = [(i, "der die das" if i % 2 else "the of and", "de" if i % 2 else "en") for i in range(40)]
    known = language_id.profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = [(1, "²½①Ⅷ"), (2, "١٢ 3_4"), (3, "\u0301"), (4, "²the"), (5, "ªº"), (6, "日")]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(frame(spark, odd), known).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[4] == "en" and "und" not in (got[5], got[6])


def test_profiles_and_predictions_equal_brute_force(spark, monkeypatch):
    """Training rows drawn by hash, repeated ids once, a long text in runs, sums per language, cosines one by one."""
    monkeypatch.setattr(language_id, "RUN_CHARS", 50)
    r = random.Random(8)
    words = {"aa": ["ba", "bo", "be"], "bb": ["ki", "ko", "ba"], "cc": ["zu", "be", "ko"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(r.choice([1, 5, 400]))), lang) for i in range(300) for lang in [r.choice(list(words))]]
    rows += [(4000, "ba " * 3000, "aa"), (4000, "ba bo", "aa"), (7, rows[7][1], rows[7][2]), (None, "zu zu", "aa"), (4001, None, "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bound = {}

    def vector(text):
        run = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        run = " ".join(run.split()).join("  ")
        grams = [run[i : i + 3] for i in range(len(run) - 2)]
        b = language_id.Bundler()
        for g in set(grams) - bound.keys():
            bound[g] = b._bound(tuple(map(ord, g))).astype(np.float64)
        return sum(bound[g] * n for g, n in Counter(grams).items())

    texts = {}
    for i, text, lang in rows:
        if i is not None and text and __import__("zlib").crc32(str(i).encode()) % 4 != 2:
            texts[i, lang] = min(text, texts.get((i, lang), text))
    sums = {}
    for (_, lang), text in texts.items():
        v = vector(text)
        sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
    known = language_id.profiles(df)
    assert list(known) == sorted(sums) and all(np.allclose(known[x], sums[x] / np.linalg.norm(sums[x]), atol=1e-6) for x in sums)
    assert len(language_id.identify(df, known).collect()) == len(rows)
    for row in language_id.identify(df.filter("doc_id < 60"), known).collect():
        v = vector(next(t for i, t, _ in rows if i == row.doc_id))
        cosines = {x: float(v @ known[x] / np.linalg.norm(v)) for x in known}
        assert row.lang_pred == max(sorted(cosines), key=cosines.get) and abs(row.score - max(cosines.values())) < 1e-5
    few = language_id.profiles(df, per_language=1)
    assert all(any(np.allclose(few[lang], vector(t) / np.linalg.norm(vector(t)), atol=1e-6) for (_, x), t in texts.items() if x == lang) for lang in few)


def test_a_language_column_full_of_something_else_and_a_really_long_text(spark):
    rows = [(i, "the and of the", "en") for i in range(30)] + [(100 + i, "der und die das", "de") for i in range(30)] + [(200 + i, "los que de la", f"https://x/{i}") for i in range(200)]
    known = language_id.profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=2)
    assert sorted(known) == ["de", "en"]
    long = [(1, "der und die das " * 400_000), (2, "123 " * 100_000), (3, "x" * 1_000_000)]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(frame(spark, long), known).collect()}
    assert got[1] == "de" and got[2] == "und" and got[3] in known


def test_bundle_is_the_sum_of_bound_ngrams_however_it_is_cut(monkeypatch):
    text = "Hello, wörld! 12 ab" * 30
    whole, _ = language_id.Bundler().bundle([text])
    b = language_id.Bundler()
    run = " " + language_id._OTHER.sub(" ", f"{text} ".lower())
    want = sum(b._bound(tuple(map(ord, run[i : i + 3]))) for i in range(len(run) - 2))
    assert np.array_equal(whole[0], want)
    monkeypatch.setattr(language_id, "CACHED", 16)
    monkeypatch.setattr(language_id, "BLOCK", 2)
    assert np.array_equal(language_id.Bundler().bundle([text, None, text])[0][[0, 2]], [want, want])
    monkeypatch.setattr(language_id, "RUN_CHARS", 7)
    assert np.array_equal(language_id.Bundler().bundle([text])[0][0], want)


# -- token counts -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter({base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.RANKS, "rb"))})


def test_edits_count_as_encoding_anew(counter, monkeypatch):
    r = random.Random(3)
    letters = [" ", "  ", "a", "b", "'s", "'", "\n", "\n\n", "é", "日", "1", "23", ".", "!!", "\t", "the", " the", "ll", "'ll", "'r", "e"]
    draw = lambda n: "".join(r.choice(letters) for _ in range(n))
    for _ in range(1500):
        monkeypatch.setattr(token_counts, "LEAF", r.choice([1, 2, 3, 32]))
        tree = token_counts.Tree(draw(r.randint(0, 60)), counter)
        for _ in range(6):
            start = r.randint(0, len(tree.text))
            end, put = min(len(tree.text), start + r.choice([0, 0, 1, 2, 5, 60])), draw(r.choice([0, 1, 2, 5]))
            want = tree.text[:start] + put + tree.text[end:]
            tree.edit(start, end, put)
            assert tree.text == want and tree.tokens == len(counter.encoding.encode_ordinary(want))
            assert tree.every() == [(len(p), counter(p)) for p in counter.cut.findall(want)]
            assert tree.pieces == len(tree.every()) and all(0 < len(leaf) <= 2 * token_counts.LEAF for leaf in leaves_of(tree.root))
            tree = r.choice([tree, token_counts.Tree(want, counter, tree.every())])


def leaves_of(node):
    return [*leaves_of(node.left), node.own, *leaves_of(node.right)] if node else []


def test_an_edit_touches_a_path_of_a_long_text(counter):
    most = []
    for n in (1_000, 32_000, 1_000_000):
        text = "some words and more " * (n // 20)
        tree = token_counts.Tree(text, counter)
        r, before = random.Random(n), tree.encoded
        for _ in range(20):
            tree.touched = 0
            at = r.choice([0, len(tree.text), r.randint(0, len(tree.text))])
            tree.edit(at, at + 3, "x")
            most.append((n, tree.touched))
        assert tree.encoded - before < 20 * 10
        tree.touched, before = 0, tree.encoded
        tree.edit(n // 4, n // 2, "")  # a long span goes without being read
        assert tree.encoded - before < 10 and tree.touched < 150
        assert tree.tokens == len(counter.encoding.encode_ordinary(tree.text))
    assert max(t for n, t in most if n == 1_000_000) < 150


def test_counting_rows(spark, counter, tmp_path):
    rows = [(1, "a b c"), (1, "a b c"), (None, "<|endoftext|>"), (2, None), (3, ""), (4, "word " * 30_000)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(token_counts.query(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    count = lambda t: len(counter.encoding.encode_ordinary(t))
    for (_, text), row in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), got, strict=True):
        text = text or ""
        n = len(text)
        assert (row.n_chars, row.n_tokens, row.n_pretokens) == (n, count(text), len(counter.cut.findall(text)))
        for start, end, put in [(n // 3, n // 3, " (edited) "), (n // 2, n // 2 + n // 10, ""), (n + 10, n + 10, "\nThe end.")]:
            text = text[:start] + put + text[end:]
        assert (row.edited_chars, row.edited_tokens) == (len(text), count(text))
    assert got[-1].reencoded < 0.02 * got[-1].n_pretokens
    assert token_counts.trees(frame(spark, [])).count() == 0


def test_kept_trees_take_a_table_of_edits(spark, counter, tmp_path):
    rows = [(1, "one two three"), (2, "a b"), (2, "a b"), (3, None), (None, "x"), (4, "left alone")]
    token_counts.trees(frame(spark, rows)).write.parquet(f"{tmp_path}/trees")
    edits = [(1, 2, 0, 3, "ONE"), (1, 1, None, None, " four"), (2, 1, 1, -5, None), (2, 2, 0, 1, "zz"), (3, 1, 5, 9, "new"), (9, 1, 0, 1, "?"), (None, 1, 0, 1, "?")]
    table = spark.createDataFrame(edits, "doc_id int, seq int, start int, end int, replacement string").withColumns({c: F.lit(1) for c in ("text", "edits", "edited_id")})
    first = token_counts.apply(token_counts.with_edits(spark.read.parquet(f"{tmp_path}/trees"), table))
    want = {1: "ONE two three four", 2: "zz b", 3: "new", None: "x", 4: "left alone"}
    got = first.collect()
    assert len(got) == 6 and all(r.text == want[r.doc_id] and r.n_tokens == len(counter.encoding.encode_ordinary(r.text)) for r in got)
    assert {r.reencoded for r in got if r.doc_id in (4, None)} == {0}
    again = token_counts.apply(token_counts.with_edits(first, table.filter("doc_id = 1 AND seq = 1"))).filter("doc_id = 1").first()
    assert again.text == "ONE two three four four" and again.n_tokens == len(counter.encoding.encode_ordinary(again.text))
    assert token_counts.apply(token_counts.with_edits(first, table.limit(0))).count() == 6
