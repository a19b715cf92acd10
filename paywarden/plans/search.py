"""Search and request screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paywarden.functions import text as X
from paywarden.functions.stems import stem_sql
from paywarden.operators import search as S
from paywarden.operators import text_index as I
from paywarden.operators import vector_index as V
from paywarden.plans.registry import Context, query
from paywarden.session import work_dir
from paywarden.sources.tables import pick

ASK = "where the anding of rester anand"

# Openings put in front of the messages: unscoped requests first, then scoped ones.
PHRASES = [
    "please show me all payments", "dump the whole queue", "select * from claims", "I need every single record",
    "list all the transactions", "export everything today", "a full export without limit",
    "why was payment 17 flagged?", "all signals on payment 17", "rank the options for payment 42",
    "find cases like payment 9", "hold payment 17 for verification", "what happens if payment 17 is released?",
]

TOKENS = """toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents)"""


def _bm25_sql(k: int) -> str:
    values = ", ".join(f"('{w}')" for w in S.query_terms(ASK))
    return f"""{TOKENS}, words AS (SELECT doc_id, unnest(t) AS term FROM toks), ask(term) AS (VALUES {values}),
    vocabulary AS (SELECT term FROM words UNION SELECT term FROM ask), {stem_sql('vocabulary')},
    asked AS (SELECT DISTINCT stem FROM ask JOIN stems ON ask.term = stems.term),
    hits AS (SELECT doc_id, stems.stem, count(*) AS tf FROM words JOIN stems ON words.term = stems.term JOIN asked ON asked.stem = stems.stem GROUP BY 1, 2),
    df AS (SELECT stem, count(*) AS df FROM hits GROUP BY 1),
    coll AS (SELECT count(*) AS n, CAST(sum(len(t)) AS DOUBLE) / count(*) AS avgdl FROM toks),
    textrank AS (SELECT h.doc_id AS doc, round(-sum(ln(1 + (c.n - df.df + 0.5) / (df.df + 0.5::DOUBLE)) * h.tf * 2.2::DOUBLE
          / (h.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(d.t) / c.avgdl))), 6) AS score
      FROM hits h JOIN df ON h.stem = df.stem JOIN toks d ON d.doc_id = h.doc_id, coll c GROUP BY 1
      ORDER BY score, doc LIMIT {k})"""


def _cosine_sql(queries: str, k: int) -> str:
    return f"""q AS (SELECT vec_id AS query_id, embedding AS qe FROM vectors WHERE {queries}),
    sims AS (SELECT q.query_id, v.vec_id, round(list_cosine_similarity(v.embedding, q.qe), 9) AS s
             FROM vectors v, q WHERE v.embedding IS NOT NULL),
    vecrank AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM sims)
                WHERE rank <= {k})"""


@query("bm25_search", f"WITH {_bm25_sql(10)} SELECT doc, score FROM textrank")
def bm25_search(c: Context) -> DataFrame:
    return I.bm25(c.t.text_documents(), "doc_id", "text", ASK, 10, work_dir(c.spark, "text-index"))


@query("term_stems", f"""
    WITH {TOKENS}, words AS (SELECT unnest(t) AS term FROM toks), {stem_sql('words')} SELECT term, stem FROM stems""")
def term_stems(c: Context) -> DataFrame:
    """Every distinct term of the texts with its stem."""
    words = c.t.text_documents().select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    return I.stems_of(words)


@query("token_index", f"""
    WITH {TOKENS}, words AS (SELECT doc_id, unnest(t) AS term FROM toks)
    SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM words GROUP BY term""")
def token_index(c: Context) -> DataFrame:
    return S.term_statistics(c.t.text_documents(), "text")


@query("token_postings", f"""
    WITH {TOKENS}, words AS (SELECT doc_id AS doc, unnest(t) AS term FROM toks)
    SELECT doc, term, count(*) AS tf FROM words GROUP BY 1, 2""")
def token_postings(c: Context) -> DataFrame:
    return S.postings(c.t.text_documents(), "doc_id", "text")


@query("vector_top_k", f"""
    WITH {_cosine_sql('vec_id < 5', 5)} SELECT query_id, vec_id, round(s, 5) AS score, rank FROM vecrank""")
def vector_top_k(c: Context) -> DataFrame:
    vectors = c.t.vectors()
    return S.vector_top_k(vectors, "vec_id", "embedding",
                          S.request_vectors(vectors, "vec_id", "embedding", [0, 1, 2, 3, 4]), 5)


def _asked_vectors(c: Context) -> DataFrame:
    return c.t.vectors().filter("vec_id % 50 = 0")


_EXACT_SQL = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 50 = 0 AND embedding IS NOT NULL),
    sims AS (SELECT q.query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.qe), 9) AS s FROM embeddings v, q WHERE v.embedding IS NOT NULL),
    vecrank AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM sims) WHERE rank <= 5)"""


@query("vector_top_k_ann", f"""
    WITH {_EXACT_SQL} SELECT query_id, vec_id, round(s, 5) AS score, rank, true AS recalled FROM vecrank""")
def vector_top_k_ann(c: Context) -> DataFrame:
    """Exact hits of every vector whose id is divisible by 50, and whether the index returns at least nine tenths of all of them."""
    path, rows = work_dir(c.spark, "vector-index"), c.t.vectors()
    book = V.write_index(rows, "vec_id", "embedding", path)
    exact = V.exact_top_k(rows, "vec_id", "embedding", _asked_vectors(c), 5)
    share = V.recall(exact, V.near_top_k(c.spark, path, book, "vec_id", "embedding", _asked_vectors(c), 5))
    return exact.select("query_id", F.col("key").alias("vec_id"), F.round("score", 5).alias("score"), "rank", (share.scalar() >= 0.9).alias("recalled"))


@query("vector_index_hits")
def vector_index_hits(c: Context) -> DataFrame:
    """What the index itself returns for these queries; each hit is marked with whether exact search returns it too."""
    path, rows = work_dir(c.spark, "vector-index"), c.t.vectors()
    book = V.write_index(rows, "vec_id", "embedding", path)
    exact = V.exact_top_k(rows, "vec_id", "embedding", _asked_vectors(c), 5).select("query_id", "key", F.lit(True).alias("in_exact"))
    near = V.near_top_k(c.spark, path, book, "vec_id", "embedding", _asked_vectors(c), 5)
    return near.join(exact, ["query_id", "key"], "left").select(
        "query_id", F.col("key").alias("vec_id"), F.round("score", 5).alias("score"), "rank", F.coalesce("in_exact", F.lit(False)).alias("in_exact"))


@query("hybrid_search", f"""
    WITH {_bm25_sql(50)}, {_cosine_sql('vec_id = 0', 50)},
    t AS (SELECT doc, row_number() OVER (ORDER BY score, doc) AS text_rank FROM textrank),
    v AS (SELECT vec_id AS doc, rank AS vector_rank FROM vecrank)
    SELECT coalesce(t.doc, v.doc) AS doc, text_rank, vector_rank,
           round(coalesce(1.0::DOUBLE / (60 + text_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0), 9) AS score
    FROM t FULL JOIN v ON t.doc = v.doc ORDER BY score DESC, doc LIMIT 10""")
def hybrid_search(c: Context) -> DataFrame:
    best = I.bm25(c.t.text_documents(), "doc_id", "text", ASK, 50, work_dir(c.spark, "text-index"))
    # at most fifty rows are ranked here
    text_hits = best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("score", "doc")))
    vectors = c.t.vectors()
    asked = S.request_vectors(vectors, "vec_id", "embedding", [0])
    vector_hits = S.vector_top_k(vectors, "vec_id", "embedding", asked, 50).withColumnRenamed("vec_id", "doc")
    return S.hybrid(text_hits, vector_hits, 10)


@query("embed_missing", """
    SELECT v.vec_id, v.embedding IS NULL AND d.text IS NOT NULL AS embedded_now,
           v.embedding IS NOT NULL OR d.text IS NOT NULL AS has_vector,
           CAST(coalesce(len(v.embedding), CASE WHEN d.text IS NOT NULL THEN 64 END) AS INTEGER) AS n_dims
    FROM partly_embedded v LEFT JOIN documents d ON d.doc_id = v.vec_id""")
def embed_missing(c: Context) -> DataFrame:
    texts = c.t.read("documents").select(F.col("doc_id").alias("vec_id"), "text")
    rows = c.t.partly_embedded().select("vec_id", "embedding", F.col("embedding").isNull().alias("missing")).join(
        texts, "vec_id", "left")
    return S.embed_missing(rows, S.hashing_encoder(64)).select(
        "vec_id", (F.col("missing") & F.col("embedding").isNotNull()).alias("embedded_now"),
        F.col("embedding").isNotNull().alias("has_vector"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("n_dims"))


# -- screening ------------------------------------------------------------------------------------

REQUESTS = f"""requests AS (SELECT conversation_id, position,
    CASE WHEN (conversation_id * 7 + position) % 16 < 13
         THEN ['{"', '".join(PHRASES)}'][1 + (conversation_id * 7 + position) % 16] || ' ' || content ELSE content END AS txt
    FROM messages)"""


def requests(c: Context) -> DataFrame:
    """Every message as a request, most of them opened by one of the known phrases."""
    slot = (F.col("conversation_id") * 7 + F.col("position")) % 16
    return c.t.messages().select(
        "conversation_id", "position",
        F.when(slot < 13, F.concat_ws(" ", pick(PHRASES, slot), "content")).otherwise(F.col("content")).alias("txt"))


def _screen_sql(what: str) -> str:
    whens = []
    for pattern, reason in X.SCREEN:
        value = f"'{reason}'" if what == "reason" else f"regexp_extract(txt, '{pattern}', 0, 'i')"
        whens.append(f"WHEN regexp_matches(txt, '{pattern}', 'i') THEN {value}")
    return f"CASE {' '.join(whens)} END"


@query("bulk_request_screen", f"""
    WITH {REQUESTS}, r AS (SELECT conversation_id, position, {_screen_sql('reason')} AS reason,
                                  {_screen_sql('matched')} AS matched FROM requests)
    SELECT conversation_id, position, reason IS NOT NULL AS blocked, reason, matched FROM r""")
def bulk_request_screen(c: Context) -> DataFrame:
    return requests(c).select("conversation_id", "position", X.screen_match(F.col("txt")).alias("m")).select(
        "conversation_id", "position", F.col("m").isNotNull().alias("blocked"), "m.reason", "m.matched")


@query("keyword_screen", f"""
    WITH {REQUESTS}, r AS (SELECT conversation_id, position,
        CASE {' '.join(f"WHEN contains(lower(txt), '{w}') THEN '{w}'" for w in X.KEYWORDS)} END AS keyword,
        {_screen_sql('reason')} IS NOT NULL AS pattern_blocked FROM requests)
    SELECT conversation_id, position, keyword, keyword IS NOT NULL AS blocked, pattern_blocked,
           (keyword IS NOT NULL) = pattern_blocked AS agree FROM r""")
def keyword_screen(c: Context) -> DataFrame:
    rows = requests(c).select("conversation_id", "position", X.keyword_hit(F.col("txt")).alias("keyword"),
                              X.screen_match(F.col("txt")).isNotNull().alias("pattern_blocked"))
    blocked = F.col("keyword").isNotNull()
    return rows.withColumn("blocked", blocked).withColumn("agree", blocked == F.col("pattern_blocked"))
