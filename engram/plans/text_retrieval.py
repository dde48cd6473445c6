"""Queries: text functions over documents and conversations, vectors, fusion, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions import text as T
from engram.functions.vector import cosine, embedder, l2, top_k
from engram.operators.nearest import IvfIndex, by_occurrences
from engram.operators.nearest import top_k as block_top_k
from engram.operators.retrieval import BUDGET, HEADER, LIMIT, PER_SOURCE, RRF_K, first, fuse, line, pack, ranks
from engram.session import stored
from engram.sources import views
from engram.sources.text_index import COVER, TextIndex

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = views.oracle(oracle)
        return f

    return register


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


_TOKENS = r"list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}_]{2,}'), lambda t: lower(t))"
_SENTENCES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query("normalise_text", r"SELECT doc_id, sha256(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '^\s+|\s+$', '', 'g')) AS folded FROM documents")
def normalise_text(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.sha2(T.normalise("text"), 256).alias("folded"))


@query("tokenize", f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS tokens, sha256(array_to_string({_TOKENS}, ' ')) AS words FROM documents")
def tokenize(spark, sf_dir):
    found = F.transform(T.tokens(F.col("text")), F.lower)
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.size(found).cast("long").alias("tokens"), F.sha2(F.array_join(found, " "), 256).alias("words"))


@query("reindex_tokens", f"SELECT doc_id, CAST(len(list_distinct({_TOKENS})) AS BIGINT) AS distinct_tokens FROM documents")
def reindex_tokens(spark, sf_dir):
    found = F.array_distinct(F.transform(T.tokens(F.col("text")), F.lower))
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.size(found).cast("long").alias("distinct_tokens"))


_TERMS = f"SELECT doc_id, t, i FROM (SELECT doc_id, unnest({_TOKENS}) AS t, generate_subscripts({_TOKENS}, 1) AS i FROM documents)"


@query(
    "build_or_query",
    f"SELECT d.doc_id, coalesce(q.q, '') AS q FROM documents d LEFT JOIN (SELECT doc_id, string_agg(t, ' or ' ORDER BY i) AS q FROM (SELECT doc_id, t, min(i) AS i, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS n "
    f"FROM ({_TERMS}) GROUP BY doc_id, t) WHERE n <= 24 GROUP BY doc_id) q ON d.doc_id = q.doc_id",
)
def build_or_query(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", T.or_query(F.col("text")).alias("q"))


_QUERY = ("the", "of", "und", "que", "les")


@query(
    "fulltext_search",
    f"SELECT doc_id, score FROM (SELECT doc_id, CAST(len(list_filter({_TOKENS}, lambda t: t IN {_QUERY})) AS BIGINT) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id DESC LIMIT {PER_SOURCE}",
)
def fulltext_search(spark, sf_dir):
    """Occurrences of any of the terms, from the stored index; the best of all documents (a top-k)."""
    return TextIndex.stored(_docs(spark, sf_dir, "doc_id", "text")).search(list(_QUERY), PER_SOURCE)


#: Queries of every benchmark item: its first five distinct words, as (first or second) and (third or fourth) and fifth.
_ITEM_WORDS = f"SELECT item_id, t, CAST(row_number() OVER (PARTITION BY item_id ORDER BY min(i)) AS INTEGER) AS n FROM (SELECT item_id, unnest({_TOKENS}) AS t, generate_subscripts({_TOKENS}, 1) AS i FROM benchmark) GROUP BY item_id, t"


@query(
    "fulltext_cover_rank",
    f"WITH q AS (SELECT item_id, t, (n - 1) // 2 AS g FROM ({_ITEM_WORDS}) WHERE n <= 5), e AS (SELECT q.item_id, d.doc_id, d.i, q.g FROM ({_TERMS}) d JOIN q ON d.t = q.t), "
    # from each entry forward to the first of every group, then the latest start for each end: the mirror image of the engine's sweep
    "g AS (SELECT DISTINCT item_id, g FROM q), p AS (SELECT DISTINCT item_id, doc_id, i FROM e), "
    "f AS (SELECT p.item_id, p.doc_id, p.i AS s, g.g, min(CASE WHEN e.g IS NOT NULL THEN p.i END) OVER (PARTITION BY p.item_id, p.doc_id, g.g ORDER BY p.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt "
    "FROM p JOIN g ON p.item_id = g.item_id LEFT JOIN e ON e.item_id = p.item_id AND e.doc_id = p.doc_id AND e.i = p.i AND e.g = g.g), "
    "c AS (SELECT item_id, doc_id, max(s) AS s, z FROM (SELECT item_id, doc_id, s, max(nxt) AS z FROM f GROUP BY item_id, doc_id, s HAVING count(nxt) = count(*)) GROUP BY item_id, doc_id, z), "
    "w AS (SELECT c.item_id, c.doc_id, c.s, c.z, count(*) AS n FROM c JOIN p ON p.item_id = c.item_id AND p.doc_id = c.doc_id AND p.i BETWEEN c.s AND c.z GROUP BY ALL), "
    f"r AS (SELECT item_id AS query_id, doc_id, CAST(sum({COVER} // (1 + z - s - (n - 1))) AS BIGINT) / 1e9 AS score, count(*) AS covers FROM w GROUP BY ALL) "
    f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS place FROM r) WHERE place <= {PER_SOURCE}",
)
def fulltext_cover_rank(spark, sf_dir):
    """Ranked conjunctions by cover density: every benchmark item asks all documents through the stored index."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.posexplode(T.terms(F.col("text"), 5)).alias("n", "term"))
    queries = items.select("query_id", F.floor(F.col("n") / 2).cast("int").alias("nth"), "term")
    return TextIndex.stored(_docs(spark, sf_dir, "doc_id", "text")).rank(queries, PER_SOURCE)


@query("fulltext_index", f"SELECT t AS term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM ({_TERMS}) GROUP BY t")
def fulltext_index(spark, sf_dir):
    """What the stored index holds, per term."""
    return TextIndex.stored(_docs(spark, sf_dir, "doc_id", "text")).terms()


@query("sentence_split", f"SELECT doc_id, CAST(len({_SENTENCES}) AS BIGINT) AS sentences, sha256(array_to_string({_SENTENCES}, '|')) AS cut FROM documents")
def sentence_split(spark, sf_dir):
    rows = _docs(spark, sf_dir, "doc_id", "text").withColumn("s", T.sentences(F.col("text")))
    return rows.select("doc_id", F.size("s").cast("long").alias("sentences"), F.sha2(F.array_join("s", "|"), 256).alias("cut"))


@query("token_estimate", "SELECT doc_id, CAST(greatest(1, (length(text) + 3) // 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("strip_punct", r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[\s.,;:!?]+$', '')) AS chars FROM documents")
def strip_punct(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.length(T.strip_punctuation(F.col("text"))).cast("long").alias("chars"))


_NEEDLES = ["100%", "a_b", "%%% the", "c\\d", "THAT IT.", "ción de"]


@query("ilike_any_literal", "SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower(text), lower('{n}'))" for n in _NEEDLES))
def ilike_any_literal(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "text").filter(T.like_any(F.col("text"), _NEEDLES)).select("doc_id")


_PROBES = ["the of", "re:^of the", "LICENSED UNDER", "re:token = .[0-9a-f]+", "re:\\d{3}-\\d{4}"]


@query(
    "needle_match",
    "SELECT d.doc_id, n.needle, CASE WHEN starts_with(n.needle, 're:') THEN regexp_matches(d.text, '(?im)' || substr(n.needle, 4)) ELSE contains(lower(d.text), lower(n.needle)) END AS found "
    f"FROM documents d, (SELECT unnest([{", ".join(repr(n).replace(chr(92) * 2, chr(92)) for n in _PROBES)}]) AS needle) n",
)
def needle_match(spark, sf_dir):
    rows = _docs(spark, sf_dir, "doc_id", "text").withColumn("needle", F.explode(F.array(*map(F.lit, _PROBES))))
    return rows.select("doc_id", "needle", T.matches(F.col("needle"), F.col("text")).alias("found"))


_END = r"(?:$|[^\p{L}\p{M}\p{N}_])"


@query(
    "classify_sentences",
    f"SELECT kind, count(*) AS sentences FROM (SELECT CASE WHEN s LIKE '%?' THEN 'question' WHEN regexp_matches(s, '(?i)^(?:{T.GREETING}){_END}') THEN 'greeting' "
    rf"WHEN regexp_matches(s, '(?i)(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])(?:{T.HEDGE}){_END}') THEN 'hedged' ELSE 'plain' END AS kind FROM (SELECT unnest({_SENTENCES}) AS s FROM (SELECT text FROM conversations UNION ALL "
    "SELECT unnest(['Hallo! Wie geht es?', 'Vielleicht mag ich Tee. Danke.', 'Hi there. I think so.', 'Hiér. Okay.']) AS text))) GROUP BY kind",
)
def classify_sentences(spark, sf_dir):
    own = spark.range(1).select(F.explode(F.array(*map(F.lit, ["Hallo! Wie geht es?", "Vielleicht mag ich Tee. Danke.", "Hi there. I think so.", "Hiér. Okay."]))).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text").union(own).select(F.explode(T.sentences(F.col("text"))).alias("s"))
    return rows.groupBy(T.sentence_kind(F.col("s")).alias("kind")).agg(F.count(F.lit(1)).alias("sentences"))


@query("content_ref", "SELECT doc_id, left(sha256(coalesce(text, '')), 12) AS ref FROM documents")
def content_ref(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", T.content_ref(F.col("text")).alias("ref"))


# -- vectors ----------------------------------------------------------------------------------------------------------

_SIM = "round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6)"


def _embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")


@query(
    "vector_topk",
    f"SELECT * FROM (SELECT q.vec_id AS query_id, d.vec_id, {_SIM} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, d.vec_id) AS place "
    "FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0) WHERE place <= 10",
)
def vector_topk(spark, sf_dir):
    """The stated query set (ids divisible by 20) against all rows, in blocks."""
    rows = _embeddings(spark, sf_dir)
    return top_k(rows.filter("vec_id % 20 = 0"), rows, 10)


@query(
    "vector_topk_per_group",
    f"SELECT * FROM (SELECT q.vec_id AS query_id, d.vec_id, {_SIM} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, d.vec_id) AS place "
    "FROM embeddings q JOIN embeddings d ON q.label = d.label WHERE q.vec_id % 20 = 0) WHERE place <= 10",
)
def vector_topk_per_group(spark, sf_dir):
    return _same_label(spark, sf_dir, 10)


def _same_label(spark, sf_dir, k):
    """Nearest rows of a query's own subject, by blocks of the subject."""
    rows = _embeddings(spark, sf_dir)
    return top_k(rows.filter("vec_id % 20 = 0"), rows, k, group_col="label")


def vector_ivf(spark, sf_dir):
    """The same query set over an inverted file: approximate, so without an oracle; a test measures its recall."""
    rows = _embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("payload"))
    path = stored(rows, "ivf embeddings", lambda own: IvfIndex(spark, own).build(rows))
    return IvfIndex(spark, path).search(rows.filter("id % 20 = 0"), 10).select("query_id", "vec_id", F.col("score").alias("similarity"), "place")


QUERIES["vector_ivf"] = vector_ivf


@query(
    "l2_normalise",
    "SELECT vec_id, CAST(len(u) AS BIGINT) AS dims, round(u[1], 6) AS head, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS norm FROM "
    "(SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS u FROM embeddings)",
)
def l2_normalise(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).select("vec_id", l2(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.size("u").cast("long").alias("dims"), F.round(F.col("u")[0], 6).alias("head"), F.round(cosine(F.col("u"), F.col("u")), 6).alias("norm"))


_NEAR = (
    f"WITH v AS (SELECT * FROM (SELECT q.vec_id AS query_id, d.vec_id AS fact_id, {_SIM} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, d.vec_id) AS n "
    "FROM embeddings q JOIN embeddings d ON q.label = d.label WHERE q.vec_id % 20 = 0) WHERE n <= 8), "
    "a AS (SELECT * FROM (SELECT q.doc_id AS query_id, d.doc_id AS fact_id, row_number() OVER (PARTITION BY q.doc_id ORDER BY d.doc_id DESC) AS n "
    "FROM v_docs q JOIN v_docs d ON q.label = d.label AND q.source = d.source AND q.lang = d.lang WHERE q.doc_id % 20 = 0) WHERE n <= 8), "
    "b AS (SELECT coalesce(v.query_id, a.query_id) AS query_id, coalesce(v.fact_id, a.fact_id) AS fact_id, v.similarity, "
    "concat_ws('+', CASE WHEN v.fact_id IS NOT NULL THEN 'vector' END, CASE WHEN a.fact_id IS NOT NULL THEN 'anchor' END) AS matched_by "
    "FROM v FULL JOIN a ON v.query_id = a.query_id AND v.fact_id = a.fact_id) "
)


@query("neighbour_search", _NEAR + "SELECT * FROM b")
def neighbour_search(spark, sf_dir):
    """Nearest by vector and anchored ones (same source and language as predicate), merged by id."""
    near = _same_label(spark, sf_dir, 8).select("query_id", F.col("vec_id").alias("fact_id"), "similarity")
    docs = views.table(spark, sf_dir, "v_docs").select("doc_id", "label", "source", "lang")
    asked = docs.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    last = Window.partitionBy("label", "source", "lang").orderBy(F.desc("doc_id"))  # the 8 that any query of the group can get
    offered = docs.withColumn("n", F.row_number().over(last)).filter("n <= 8").select("label", "source", "lang", F.col("doc_id").alias("fact_id"))
    met = asked.join(offered, ["label", "source", "lang"])
    anchored = met.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fact_id")))).filter("n <= 8").select("query_id", "fact_id", F.lit("anchor").alias("anchor"))
    both = near.withColumn("vector", F.lit("vector")).join(anchored, ["query_id", "fact_id"], "full_outer")
    return both.select("query_id", "fact_id", "similarity", F.concat_ws("+", "vector", "anchor").alias("matched_by"))


@query("neighbour_floor", _NEAR + "SELECT * FROM b WHERE matched_by <> 'vector' OR similarity >= 0.35")
def neighbour_floor(spark, sf_dir):
    return neighbour_search(spark, sf_dir).filter("matched_by <> 'vector' OR similarity >= 0.35")


@query("hash_embed", None)
def hash_embed(spark, sf_dir):
    """Hashed embedding of every whole text (SQL has no blake2b); its norm and number of buckets in use."""
    rows = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", embedder()(F.col("text")).alias("v"))
    return rows.select("doc_id", F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("buckets"), F.round(cosine(F.col("v"), F.col("v")), 4).alias("norm"))


# -- retrieval --------------------------------------------------------------------------------------------------------

_CONTENT = "'Dokument auf ' || lang || ' aus ' || source || ' mit ' || n_chars || ' Zeichen.'"
_HITS = (
    f"WITH v AS (SELECT q.vec_id AS query_id, 'vector' AS source, d.vec_id AS fact_id, -{_SIM} AS score FROM embeddings q JOIN v_docs d0 ON q.vec_id = d0.doc_id JOIN embeddings d ON q.label = d.label JOIN v_docs x ON x.doc_id = d.vec_id WHERE q.vec_id % 20 = 0), "
    f"t AS (SELECT doc_id, label, t, count(*) AS n, min(i) AS i FROM (SELECT doc_id, label, unnest({_TOKENS}) AS t, generate_subscripts({_TOKENS}, 1) AS i FROM v_docs) GROUP BY ALL), "
    "q AS (SELECT doc_id, label, t FROM (SELECT doc_id, label, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM t WHERE doc_id % 20 = 0) WHERE k <= 24), "
    "f AS (SELECT q.doc_id AS query_id, 'fulltext' AS source, t.doc_id AS fact_id, CAST(-sum(t.n) AS DOUBLE) AS score FROM q JOIN t ON q.label = t.label AND q.t = t.t GROUP BY ALL), "
    "g AS (SELECT q.doc_id AS query_id, 'graph' AS source, d.doc_id AS fact_id, CAST(1 AS DOUBLE) AS score FROM v_docs q JOIN v_docs d ON q.source = d.source AND q.label = d.label WHERE q.doc_id % 20 = 0), "
    "r AS (SELECT query_id, source, fact_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score, fact_id) AS place FROM "
    f"(SELECT * FROM v UNION ALL SELECT * FROM f UNION ALL SELECT * FROM g)) WHERE place <= {PER_SOURCE}), "
    f"u AS (SELECT query_id, fact_id, sum(1.0::DOUBLE / ({RRF_K} + place)) AS score, string_agg(source || ':' || place, ',' ORDER BY source) AS sources FROM r GROUP BY ALL), "
    f"h AS (SELECT query_id, fact_id, score, sources, place FROM (SELECT u.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fact_id) AS place FROM u JOIN documents d ON u.fact_id = d.doc_id WHERE d.lang <> 'es') WHERE place <= {LIMIT}) "
)


def _ranked(spark, sf_dir):
    """Three sources for each query document: nearest vectors, term occurrences, same source; ranked within each."""
    docs = views.table(spark, sf_dir, "v_docs")
    asked = docs.filter("doc_id % 20 = 0")
    rows = lambda df, payload: df.select(F.col("doc_id").alias("id"), F.col("label").alias("group"), payload.alias("payload"))
    hits = lambda found, source: found.select("query_id", F.lit(source).alias("source"), F.col("vec_id").alias("fact_id"), (-F.col("score")).alias("score"))
    vector = hits(block_top_k(rows(asked, F.col("embedding")), rows(docs, F.col("embedding")), PER_SOURCE), "vector")
    hashed = lambda words: F.transform(words, lambda t: F.xxhash64(F.lower(t)))
    said, terms = rows(docs, hashed(T.tokens(F.col("text")))), rows(asked, hashed(T.terms(F.col("text"))))
    fulltext = hits(block_top_k(terms, said, PER_SOURCE, by_occurrences), "fulltext")
    own = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "label", F.col("source").alias("from"))
    first_ids = Window.partitionBy("label", "source").orderBy("doc_id")  # hits of this source are equally good, so these are all that rank
    offered = docs.select("doc_id", "label", "source").withColumn("n", F.row_number().over(first_ids)).filter(F.col("n") <= PER_SOURCE)
    graph = own.join(offered.select(F.col("doc_id").alias("fact_id"), "label", F.col("source").alias("from")), ["label", "from"]).select("query_id", F.lit("graph").alias("source"), "fact_id", F.lit(1.0).alias("score"))
    return ranks(vector.union(fulltext).union(graph), F.col("score"))


def _recalled(spark, sf_dir):
    visible = _docs(spark, sf_dir, "doc_id", "lang").filter("lang <> 'es'").select(F.col("doc_id").alias("fact_id"))
    return first(fuse(_ranked(spark, sf_dir)), visible)


@query("source_ranks", _HITS + "SELECT query_id, source, fact_id, place FROM r")
def source_ranks(spark, sf_dir):
    return _ranked(spark, sf_dir).withColumn("place", F.col("place").cast("long"))


@query("rrf_fusion", _HITS + "SELECT query_id, fact_id, round(score, 6) AS score FROM u")
def rrf_fusion(spark, sf_dir):
    return fuse(_ranked(spark, sf_dir)).select("query_id", "fact_id", F.round("score", 6).alias("score"))


def _told(sources):
    return F.array_join(F.transform(F.map_entries(sources), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")


@query("rrf_sources", _HITS + "SELECT query_id, fact_id, sources FROM u")
def rrf_sources(spark, sf_dir):
    return fuse(_ranked(spark, sf_dir)).select("query_id", "fact_id", _told("sources").alias("sources"))


@query("hybrid_recall", _HITS + "SELECT query_id, fact_id, round(score, 6) AS score, sources, place FROM h")
def hybrid_recall(spark, sf_dir):
    """The whole of stage 3: three sources, fusion, visibility, limit."""
    return _recalled(spark, sf_dir).select("query_id", "fact_id", F.round("score", 6).alias("score"), _told("sources").alias("sources"), F.col("place").cast("long").alias("place"))


_LINES = (
    _HITS.replace("WITH v AS", "WITH RECURSIVE v AS", 1)
    + f", l AS (SELECT h.query_id, h.place, h.fact_id, '- ' || {_CONTENT} || ' (seit ' || strftime(DATE '2024-01-01' + CAST(h.fact_id % 365 AS INTEGER), '%Y-%m-%d') || ', Fakt ' || h.fact_id || ')' AS line FROM h JOIN documents d ON h.fact_id = d.doc_id), "
    "c AS (SELECT *, greatest(1, (length(line) + 3) // 4) AS cost FROM l), "
    f"w AS (SELECT query_id, 0::BIGINT AS place, {max(1, (len(HEADER) + 3) // 4)}::BIGINT AS used, false AS kept FROM (SELECT DISTINCT query_id FROM c) "
    f"UNION ALL SELECT w.query_id, c.place, CASE WHEN w.used + c.cost <= {BUDGET // 4} THEN w.used + c.cost ELSE w.used END, w.used + c.cost <= {BUDGET // 4} FROM w JOIN c ON w.query_id = c.query_id AND c.place = w.place + 1) "
)


def _packed(spark, sf_dir):
    docs = _docs(spark, sf_dir, "doc_id", "lang", "source", "n_chars")
    content = F.concat(F.lit("Dokument auf "), "lang", F.lit(" aus "), "source", F.lit(" mit "), F.col("n_chars").cast("string"), F.lit(" Zeichen."))
    ranked = _recalled(spark, sf_dir).join(docs, F.col("fact_id") == F.col("doc_id"))
    since = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("fact_id") % 365).cast("int"))
    return pack(ranked.select("query_id", "place", "fact_id", line(content, since, F.col("fact_id")).alias("line")), BUDGET // 4)


@query(
    "inject_budget",
    _LINES + "SELECT w.query_id, max(w.used) AS tokens_used, coalesce(string_agg(c.fact_id::VARCHAR, ',' ORDER BY c.place) FILTER (w.kept), '') AS included, "
    "coalesce(string_agg(c.fact_id::VARCHAR, ',' ORDER BY c.place) FILTER (NOT w.kept), '') AS dropped FROM w LEFT JOIN c ON w.query_id = c.query_id AND w.place = c.place WHERE w.place > 0 GROUP BY w.query_id",
)
def inject_budget(spark, sf_dir):
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return _packed(spark, sf_dir).select("query_id", F.col("tokens_used").cast("long").alias("tokens_used"), join("included").alias("included"), join("dropped").alias("dropped"))


@query(
    "render_context",
    _LINES + f"SELECT w.query_id, '{HEADER}' || chr(10) || string_agg(c.line, chr(10) ORDER BY c.place) AS text FROM w JOIN c ON w.query_id = c.query_id AND w.place = c.place WHERE w.kept GROUP BY w.query_id",
)
def render_context(spark, sf_dir):
    return _packed(spark, sf_dir).filter("text <> ''").select("query_id", "text")
