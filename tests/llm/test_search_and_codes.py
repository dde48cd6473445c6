"""SimHash near-dedup, ranked lexical search and vector codes against brute force, with nulls, ties, empty tables and clashing names."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from engram.llm import lexical_search, simhash, vector_codes

DATA = "/root/testdata/sf0.001"
NEEDS_DATA = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


# -- SimHash ------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest position reachable over links of at most 3 bits."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_of_whole_texts_in_pieces():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 700):
        text = "".join(r.choice(["Ab", "ñu", "x" * 40]) + r.choice([" ", "\t\n ", "\r", "\x0b"]) for _ in range(n))
        assert {simhash.fingerprint(text, piece) for piece in (1, 7, 100, 1 << 20)} == {plain_fingerprint(text)}
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_golay_code_is_perfect_and_its_keys_meet():
    golay = simhash.Golay()
    assert (np.bincount(golay.index(np.arange(1 << 23))) == 2048).all()
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 3000)
    near = golay.near(words)
    assert {len(set(x)) for x in near.tolist()} == {1, 6}
    prints, far = (rng.integers(0, 2**64, 3000, dtype=np.uint64) for _ in range(2))
    far = prints.copy()
    for _ in range(3):
        far ^= np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)
    at, key, _ = simhash.keys(prints, golay)
    other, met, own = simhash.keys(far, golay)
    assert {x for x, _ in set(zip(at.tolist(), key.tolist(), strict=True)) & set(zip(other[own].tolist(), met[own].tolist(), strict=True))} == set(range(3000))


@pytest.mark.parametrize("side", [4, 20_000])
def test_links_of_fingerprints_equal_brute_force(spark, side):
    r = random.Random(side)
    base = [r.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << k for k in set(r.sample(range(64), r.randint(0, 6)))) for b in base for _ in range(40)} | {r.getrandbits(64) for _ in range(100)} | {0, 7, 15}
    dense = {base[0] ^ (m << 20) for m in range(200)}  # one group that hangs together
    prints = sorted(prints | dense)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long").repartition(3), side).collect()
    at = {p: i for i, p in enumerate(signed)}
    parent = list(range(len(signed)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        assert (prints[at[a]] ^ prints[at[b]]).bit_count() <= 3
        x, y = find(at[a]), find(at[b])
        parent[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(signed))] == plain_components(prints)


def test_compare_joins_cells_over_batches():
    import pandas as pd

    r = random.Random(3)
    rows = sorted((c, r.getrandbits(6), True) for c in range(9) for _ in range(c * 3))
    frame = pd.DataFrame(rows, columns=["cell", "print", "own"])
    whole = {tuple(x) for f in simhash._compare(iter([frame])) for x in f.to_numpy().tolist()}
    for step in (1, 2, 5, 17):
        cut = [frame[i : i + step] for i in range(0, len(frame), step)]
        got = {tuple(x) for f in simhash._compare(iter(cut)) for x in f.to_numpy().tolist()}
        ends = {x for e in whole for x in e}
        assert {x for e in got for x in e} == ends


def test_simhash_components_of_documents(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    base = [r.choice(words) for _ in range(400)]
    texts = ["", None, "  ", "one", "ONE", "two words", "a b c", "A  b\tc"]
    for _ in range(25):
        edited = list(base)
        for _ in range(r.randint(0, 2)):
            edited[r.randrange(400)] = r.choice(words)
        texts.append(" ".join(edited))
    rows = [(k + 5, t, 0) for k, t in enumerate(texts)] + [(7, "another row of this id", 1), (None, "a b c", 1), (None, "nobody else", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print int")
    got = simhash.components(docs).collect()
    assert Counter((x.doc_id, x.fingerprint) for x in got) == Counter((i, f"{plain_fingerprint(t):016x}") for i, t, _ in rows)
    part = plain_components([plain_fingerprint(t) for _, t, _ in rows])
    least = {}
    for (i, _, _), p in zip(rows, part, strict=True):
        if i is not None:
            least[p] = min(i, least.get(p, i))
    want = Counter((i, f"{plain_fingerprint(t):016x}", least.get(p)) for (i, t, _), p in zip(rows, part, strict=True))
    assert Counter((x.doc_id, x.fingerprint, x.component_id) for x in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({(x.doc_id) for x in got if x.kept}) + sum(x.doc_id is None and x.kept for x in got) + 1  # id 7 has two rows
    assert simhash.components(docs.limit(0)).collect() == []


@NEEDS_DATA
def test_simhash_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [plain_fingerprint(d.text) for d in docs]
    part = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, DATA).collect()}
    assert got == {d.doc_id: (f"{p:016x}", docs[c].doc_id) for d, p, c in zip(docs, prints, part, strict=True)}


# -- lexical search -----------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_search(docs, items, k):
    said = [(i, Counter(plain_terms(t))) for i, t in docs]
    said = [(i, c) for i, c in said if c]
    n, total = len(said), sum(c.total() for _, c in said)
    df = Counter(t for _, c in said for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(plain_terms(text)), []
        for i, c in said:
            m = 100 - 75 + (75 * c.total() * n) // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in asked.items() if t in c)
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_terms():
    text = "Don't STOP: naïve Ünïcode_x 3.14\x00a\x7fb ÄÖ　z y"
    assert [t.decode() for t in lexical_search.terms(text)] == plain_terms(text)
    assert lexical_search.terms(None) == lexical_search.terms("") == lexical_search.terms(".,;") == []


@pytest.mark.parametrize(("block_docs", "group_items"), [(7, 3), (40, 100), (1000, 1)])
def test_search_equals_brute_force(spark, block_docs, group_items):
    r = random.Random(block_docs)
    words = [f"t{i}" for i in range(40)] + ["Été", "niño"]
    draw = lambda n: " ".join(words[min(int(r.expovariate(0.12)), 41)] for _ in range(n))
    docs = [(k * 7 % 601, draw(r.randint(0, 30))) for k in range(300)] + [(700 + k, "tie tie break") for k in range(30)] + [(900, None), (901, "..."), (None, draw(12)), (902, draw(5000)), (903, "tie"), (903, "tie"), (-5, "tie tie break"), (None, "tie tie break")]
    items = [(k, draw(r.randint(1, 12))) for k in range(8)] + [(20, "tie break T1 t1"), (21, None), (22, "never said"), (23, ""), (24, "Tie")]
    texts = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"block": F.lit("x"), "term": F.lit(1)})
    found = lexical_search.search(texts.repartition(3), spark.createDataFrame([*items, (None, "tie")], "item_id long, text string"), 10, block_docs=block_docs, group_items=group_items)
    assert sorted(map(tuple, found.collect())) == plain_search(docs, items, 10)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert lexical_search.search(d, i).collect() == []


def test_best_opens_few_nodes_and_keeps_ties():
    term = np.zeros(4096, dtype=np.int64)
    gain = np.ones(4096, dtype=np.int64)
    gain[[100, 4000, 17]] = 5, 9, 5
    levels = lexical_search.tree(term, np.arange(4096), gain, 4096)
    assert len(levels) == 3
    opened = []
    for level in levels:
        level.children = (lambda f: lambda above, wanted: opened.append(above) or f(above, wanted))(level.children)
    ids = np.arange(4096)[::-1].copy()
    assert lexical_search.best(levels, np.array([2]), ids, 2) == [(18, 95), (10, 3995)]
    assert len(opened) <= 10


# -- vector codes -------------------------------------------------------------------------------------------------------


def plain_codes(rows, rounds=6):
    kept = [(i, lab, [math.floor(4096 * x) for x in v]) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    d = len(kept[0][2]) // 8
    part = lambda v, p: v[p * d : (p + 1) * d]
    books = [[part(v, p) for _, _, v in kept[:16]] for p in range(8)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda j: (gap(x, book[j]), j))
    for _ in range(rounds):
        for p in range(8):
            met = {}
            for _, _, v in kept:
                met.setdefault(near(part(v, p), books[p]), []).append(part(v, p))
            for j, xs in met.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, lab, v in kept:
        code = [near(part(v, p), books[p]) for p in range(8)]
        out.append((i, lab, "".join(f"{c:02x}" for c in code), sum(gap(part(v, p), books[p][c]) for p, c in enumerate(code))))
    sums = Counter()
    for _, lab, _, e in out:
        sums[lab] += e
    return sorted((str(i), str(lab), c, e, sums[lab]) for i, lab, c, e in out), books


def test_screening_never_loses_the_nearest():
    rng = np.random.default_rng(5)
    for scale in (3, 5_000, 1 << 24):
        books = rng.integers(-scale, scale, (8, 16, 8))
        books[:, 9] = books[:, 4]
        x = rng.integers(-scale, scale, (400, 64))
        x[:50] = (books[:, 3] + books[:, 4]).reshape(-1) // 2 + rng.integers(-1, 2, (50, 64))
        x[50:60] = books[:, 9].reshape(-1)
        chosen, errors = vector_codes.nearest(x, books)
        gaps = ((x.reshape(-1, 8, 1, 8) - books) ** 2).sum(axis=3)
        assert (chosen == gaps.argmin(axis=2)).all() and (errors == gaps.min(axis=2)).all()
        assert vector_codes.screened(x.reshape(-1, 8, 8).transpose(1, 0, 2), books).sum(axis=2).mean() < 4


def test_codes_equal_brute_force(spark):
    r = random.Random(6)
    rows = [(k * 11 % 409, [r.gauss(0, 1) for _ in range(16)], r.choice([0, 1, None])) for k in range(200)]
    rows += [(500 + k, [0.25] * 16, 2) for k in range(20)] + [(None, [1.0] * 16, None), (3, [r.random() for _ in range(16)], 0)]
    dropped = [(600, None, 0), (0, [None, *[0.0] * 15], 0), (1, [math.nan] * 16, 1), (2, [math.inf] * 16, 1), (4, [], 1)]
    made = spark.createDataFrame([(i, v, lab, 1) for i, v, lab in rows + dropped], "vec_id long, embedding array<double>, label int, code int")
    want, books = plain_codes(rows)
    got = vector_codes.compress(made.repartition(3)).collect()
    assert sorted((str(x.vec_id), str(x.label), x.code, x.error, x.label_error) for x in got) == want
    assert {x.codebooks_sha256 for x in got} == {vector_codes.digest(np.array(books))}
    numbers = vector_codes._integers(vector_codes.quantised(made))
    back = vector_codes.decode(vector_codes.compress(made), vector_codes.learn(numbers)).filter("vec_id = 500").first()
    code = next(x.code for x in got if x.vec_id == 500)
    assert back.vector == [c / 4096 for p in range(8) for c in books[p][int(code[2 * p : 2 * p + 2], 16)]]


def test_codes_of_few_short_and_no_vectors(spark):
    made = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0), (2, [1.0] * 9, 0), (3, [1e30] * 9, None)], "vec_id long, embedding array<float>, label int")
    got = vector_codes.compress(made).collect()
    assert len(got) == 3 and all(r.error == 0 for r in got)
    assert vector_codes.compress(made.limit(0)).collect() == []
