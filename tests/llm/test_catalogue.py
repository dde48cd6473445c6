"""The registered queries over whole small tables: oracle where there is one, contract columns and held-out rows elsewhere."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import pytest

from engram.llm import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall())


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in catalogue.QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_query_equals_its_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))


def test_fingerprint_contract(spark, texts):
    ids = list(texts)
    for r in catalogue.QUERIES["op7_fingerprints"](spark, DATA).collect():
        text, after = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 and isinstance(r.edited_fingerprint, str)


def test_classifier_contracts(spark, texts):
    held = lambda i, m: zlib.crc32(str(i).encode()) % m
    quality = catalogue.QUERIES["op6_quality"](spark, DATA).collect()
    assert {r.doc_id for r in quality} == set(texts) and all(r.held_out == (held(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.3) for r in quality)
    language = catalogue.QUERIES["op9_language_id"](spark, DATA).collect()
    assert {r.doc_id for r in language} == set(texts) and all(r.held_out == (held(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in language)


def test_token_contracts(spark, texts):
    pieces = catalogue.QUERIES["op5_sentence_pieces"](spark, DATA).collect()
    assert {r.doc_id: r.decoded_sha256 for r in pieces} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    counted = catalogue.QUERIES["op10_token_counts"](spark, DATA).collect()
    assert {r.doc_id: r.n_chars for r in counted} == {i: len(t) for i, t in texts.items()} and all(r.reencoded <= r.n_pretokens + 30 for r in counted)
