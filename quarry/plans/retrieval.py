"""Queries: the retrieval channels, fusion, selection and the whole of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import RetrievalConfig
from quarry.functions import text as T
from quarry.operators import agentic, graph, retrieve, vectorindex
from quarry.operators.providers import LetterEmbedder, ScriptedChat, embed
from quarry.operators.shared import written
from quarry.plans.catalogue import query
from quarry.plans.data import Tables
from quarry.plans.sql import CHUNKS, COSINE, EDGES, ENTITIES, EXPAND, KEYWORD_HITS, KEYWORDS, STOP, VECTOR, with_

LIMIT = RetrievalConfig.top_k * RetrievalConfig.candidate_factor
def _score():
    return F.round("score", 6).alias("score")


@query(with_(VECTOR, select="SELECT qid, chunk_id, round(score, 6) AS score, rank FROM vector"))
def vector_topk(t: Tables) -> DataFrame:
    return retrieve.vector_topk(t.vector_queries(), t.vectors(), LIMIT).select("qid", "chunk_id", _score(), "rank")


@query(with_(VECTOR, select="SELECT qid, chunk_id, round(score, 6) AS score, rank FROM vector"))
def vector_index_topk(t: Tables) -> DataFrame:
    """The same neighbours from vectors kept by cell: the nearest cells, then those that could hold better ones."""
    index = vectorindex.build(t.vectors())
    return index.search(t.vector_queries(), LIMIT, exact=True).select("qid", "chunk_id", _score(), "rank")


@query(with_(COSINE, select="SELECT qid, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scored JOIN embeddings q ON q.vec_id = qid AND q.label = doc_id QUALIFY rank <= 15"))
def vector_topk_filtered(t: Tables) -> DataFrame:
    q = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"), F.col("label").cast("string").alias("doc_filter"))
    return retrieve.vector_topk(q, t.vectors(), LIMIT).select("qid", "chunk_id", _score(), "rank")


@query(with_(COSINE, select="SELECT qid, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scored WHERE score >= 0.3 QUALIFY rank <= 15"))
def vector_min_score(t: Tables) -> DataFrame:
    return retrieve.vector_topk(t.vector_queries(), t.vectors(), LIMIT, RetrievalConfig.min_score).select("qid", "chunk_id", _score(), "rank")


@query("SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(t: Tables) -> DataFrame:
    """Exact cosine of every vector and the next by built-in functions: the check on the block path."""
    a = t.embeddings.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    b = t.embeddings.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    pairs = a.join(b, F.col("b_id") == F.col("a_id") + 1)
    return pairs.select("a_id", "b_id", F.round(retrieve.cosine(F.col("a"), F.col("b")), 6).alias("score"))


@query(with_(VECTOR, "base AS (SELECT qid, chunk_id, -1 AS v, rank FROM vector WHERE rank <= 5)", "variants AS (SELECT (qid // 500) * 500 AS qid, chunk_id, CAST(qid % 500 // 100 AS INTEGER) AS v, rank FROM vector WHERE qid % 500 <> 0)", "firsts AS (SELECT qid, chunk_id, min((v, rank)) AS first_at FROM (SELECT * FROM base WHERE qid % 500 = 0 UNION ALL SELECT * FROM variants) GROUP BY 1, 2)", select="SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY first_at, chunk_id) AS INTEGER) AS rank FROM firsts"))
def expanded_vector(t: Tables) -> DataFrame:
    """The hundred-numbered queries after each five-hundredth count as its variants."""
    hits = retrieve.vector_topk(t.vector_queries(), t.vectors(), LIMIT)
    base = hits.where("qid % 500 = 0 and rank <= 5")
    variants = hits.where("qid % 500 <> 0").select((F.floor(F.col("qid") / 500) * 500).alias("qid"), "chunk_id", "rank", F.floor(F.col("qid") % 500 / 100).cast("int").alias("variant_no"))
    return retrieve.expand_variants(base, variants)


@query(with_(KEYWORDS, select="SELECT qid, string_agg(w, ' ' ORDER BY i) AS keywords FROM kws GROUP BY 1"))
def extract_keywords(t: Tables) -> DataFrame:
    return t.text_queries().select("qid", F.array_join(T.keywords(F.col("text")), " ").alias("keywords")).where("keywords <> ''")


@query(with_(CHUNKS, KEYWORDS, KEYWORD_HITS, select="SELECT qid, chunk_id, score, rank FROM keyword", recursive=True))
def keyword_topk(t: Tables) -> DataFrame:
    return retrieve.keyword_topk(t.text_queries(), t.stored_chunks(), LIMIT).select("qid", "chunk_id", "score", "rank")


_FILTERED_HITS = KEYWORD_HITS.replace("cand AS (SELECT DISTINCT qid, chunk_id FROM kws JOIN toks USING (w) WHERE", "cand AS (SELECT DISTINCT qid, chunk_id FROM kws JOIN toks USING (w) JOIN chunks USING (chunk_id) WHERE doc_id = qid AND")


@query(with_(CHUNKS, KEYWORDS, _FILTERED_HITS, select="SELECT qid, chunk_id, score, rank FROM keyword", recursive=True))
def keyword_topk_filtered(t: Tables) -> DataFrame:
    """Every question within the one document whose id is the question's."""
    asked = t.text_queries().withColumn("doc_filter", F.col("qid").cast("string"))
    return retrieve.keyword_topk(asked, t.stored_chunks(), LIMIT).select("qid", "chunk_id", "score", "rank")


_NAMES = """names AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT n_name FROM nation UNION SELECT DISTINCT r_name FROM region),
 toks AS (SELECT DISTINCT name, unnest(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+')) AS tok FROM names),
 asked AS (SELECT n_nationkey AS qid, 'Who sells a red widget in ' || n_name || ' or elsewhere in ' || r_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey),
 terms AS (SELECT DISTINCT qid, lower(w) AS w FROM (SELECT qid, unnest(string_split(text, ' ')) AS w FROM asked) WHERE length(w) >= 3)"""
_FUZZY = _NAMES + """, near AS (SELECT qid, name, w, min(levenshtein(w, tok)) AS d FROM terms, toks WHERE levenshtein(w, tok) <= CASE WHEN length(w) <= 4 THEN 1 ELSE 2 END GROUP BY 1, 2, 3),
 fscored AS (SELECT qid, lower(name) AS entity_key, name, round(sum(1 - d / length(w)), 6) AS score FROM near WHERE length(name) >= 3 GROUP BY 1, 2, 3),
 fuzzy AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, length(name) DESC, entity_key) AS INTEGER) AS rank FROM fscored QUALIFY rank <= 10)"""


def _named(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("name")).unionByName(t.nation.select(F.col("n_name").alias("name"))).unionByName(t.region.select(F.col("r_name").alias("name"))).distinct()
    return names.select(F.lower("name").alias("entity_key"), "name")


@query(with_(_NAMES, select="SELECT qid, count(*) AS n_terms, string_agg(w || '~' || CASE WHEN length(w) <= 4 THEN 1 ELSE 2 END, ' ' ORDER BY w) AS terms FROM terms GROUP BY 1"))
def fuzzy_terms(t: Tables) -> DataFrame:
    each = t.name_queries().select("qid", F.explode(T.fuzzy_terms(F.col("text"))).alias("x")).select("qid", "x.word", "x.within").distinct()
    lists = each.groupBy("qid").agg(F.count("*").alias("n_terms"), F.array_sort(F.collect_list(F.struct("word", F.concat_ws("~", "word", F.col("within").cast("string")).alias("s")))).alias("l"))
    return lists.select(F.col("qid").cast("int").alias("qid"), "n_terms", F.array_join(F.transform("l", lambda x: x["s"]), " ").alias("terms"))


@query(with_(_FUZZY, select="SELECT qid, entity_key, name, score, rank FROM fuzzy"))
def fuzzy_entities(t: Tables) -> DataFrame:
    found = retrieve.fuzzy_entities(t.name_queries(), _named(t))
    return found.select(F.col("qid").cast("int").alias("qid"), "entity_key", "name", "score", "rank")


_ENTITY_CHANNEL = """heads AS (SELECT o_orderkey AS chunk, lower(n_name) AS entity_key, o_orderkey AS ord FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
 placed AS (SELECT qid, chunk, min((rank, ord)) AS first_at FROM fuzzy JOIN heads USING (entity_key) GROUP BY 1, 2)"""
_NATIONS = _FUZZY.replace("SELECT n_nationkey AS qid, 'Who sells a red widget in ' || n_name || ' or elsewhere in ' || r_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey", "SELECT a.n_nationkey AS qid, 'from ' || a.n_name || ' to' || coalesce(' ' || b.n_name, '') AS text FROM nation a LEFT JOIN nation b ON b.n_nationkey = a.n_nationkey + 1")


@query(with_(_NATIONS, _ENTITY_CHANNEL, select="SELECT qid, chunk AS chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY first_at, chunk) AS INTEGER) AS rank FROM placed"))
def entity_channel(t: Tables) -> DataFrame:
    """The orders of the nations that each question names, in the nations' order."""
    c = t.customer.join(F.broadcast(t.places()), F.col("c_nationkey") == F.col("n_nationkey"))
    links = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.lower("n_name").alias("entity_key"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("ord"))
    found = retrieve.fuzzy_entities(t.nation_queries(), _named(t))
    return retrieve.entity_channel(found, links).select(F.col("qid").cast("int").alias("qid"), "chunk_id", "rank")


#: Two channels over the vectors: nearest, and nearest within the query's own label.
_TWO = VECTOR + """, same AS (SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scored JOIN embeddings q ON q.vec_id = qid AND q.label = doc_id QUALIFY rank <= 15),
 parts AS (SELECT qid, chunk_id, 0 AS c, 'vector' AS channel, rank, 1.0 / (60 + rank) AS part FROM vector UNION ALL SELECT qid, chunk_id, 1, 'keyword', rank, 0.6 / (60 + rank) FROM same),
 fused AS (SELECT qid, chunk_id, sum(part) AS score, string_agg(channel, '+' ORDER BY channel) AS source, min((c, rank)) AS first_at FROM parts GROUP BY 1, 2),
 ranked AS (SELECT qid, chunk_id, score, source, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first_at) AS INTEGER) AS pos FROM fused)"""


def _two(t: Tables) -> dict[str, DataFrame]:
    own = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"), F.col("label").cast("string").alias("doc_filter"))
    return {"vector": retrieve.vector_topk(t.vector_queries(), t.vectors(), LIMIT), "keyword": retrieve.vector_topk(own, t.vectors(), LIMIT)}


@query(with_(_TWO, select="SELECT qid, chunk_id, round(score, 5) AS score, pos FROM ranked"))
def rrf_fusion(t: Tables) -> DataFrame:
    return retrieve.rrf(_two(t)).select("qid", "chunk_id", F.round("score", 5).alias("score"), "pos")


@query(with_(_TWO, select="SELECT qid, chunk_id, source FROM ranked"))
def channel_provenance(t: Tables) -> DataFrame:
    return retrieve.rrf(_two(t)).select("qid", "chunk_id", "source")


@query(with_(_TWO, select="SELECT qid, chunk_id, pos FROM ranked JOIN embeddings ON vec_id = chunk_id QUALIFY row_number() OVER (PARTITION BY qid, label ORDER BY pos) <= 3"))
def per_doc_cap(t: Tables) -> DataFrame:
    ranked = retrieve.rrf(_two(t)).join(t.vectors().drop("embedding"), "chunk_id")
    return retrieve.per_doc_cap(ranked, RetrievalConfig.per_doc_cap).select("qid", "chunk_id", "pos")


@query("""WITH b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS bag FROM benchmark)
 SELECT a.item_id AS a_id, b.item_id AS b_id, round(len(list_intersect(a.bag, b.bag)) / len(a.bag), 6) AS share FROM b a JOIN b ON a.item_id <> b.item_id WHERE len(list_intersect(a.bag, b.bag)) / len(a.bag) >= 0.25""")
def near_dup_pairs(t: Tables) -> DataFrame:
    """Ordered pairs of benchmark passages of which the first is contained in the second by a quarter.

    If a quarter of n words is shared, one of the n - ceil(n / 4) + 1 rarest is: only these are
    looked up, so the commonest words of a passage, on which all would meet, don't count."""
    bags = t.benchmark.select("item_id", F.array_distinct(T.words(F.lower("text"))).alias("bag"))
    rows = bags.select("item_id", F.size("bag").alias("n"), F.explode("bag").alias("w"))
    uses = rows.groupBy("w").agg(F.count("*").alias("uses"))
    rarest = Window.partitionBy("item_id").orderBy("uses", "w")
    asked = rows.join(uses, "w").withColumn("nth", F.row_number().over(rarest)).where("nth <= n - ceil(n * 0.25) + 1")
    met = asked.select(F.col("item_id").alias("a_id"), "w").join(rows.select(F.col("item_id").alias("b_id"), "w"), "w").where("a_id <> b_id").select("a_id", "b_id").distinct()
    both = met.join(bags.toDF("a_id", "a"), "a_id").join(bags.toDF("b_id", "b"), "b_id")
    share = F.size(F.array_intersect("a", "b")) / F.size("a")
    return both.where(share >= 0.25).select("a_id", "b_id", F.round(share, 6).alias("share"))


@query(with_(CHUNKS, KEYWORDS, KEYWORD_HITS, """cand_rows AS (SELECT k.qid, k.rank, k.chunk_id, c.doc_id, list_distinct(list_filter(regexp_split_to_array(lower(c.text), '\\s+'), lambda w: w <> '')) AS bag FROM keyword k JOIN chunks c USING (chunk_id)),
 fold(qid, n, ids, docs, bags, took) AS (
  SELECT DISTINCT qid, 0, CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]), CAST([] AS VARCHAR[][]), -1 FROM cand_rows
  UNION ALL
  SELECT f.qid, f.n + 1, CASE WHEN ok THEN list_append(ids, chunk_id) ELSE ids END, CASE WHEN ok THEN list_append(docs, doc_id) ELSE docs END, CASE WHEN ok THEN list_append(bags, bag) ELSE bags END, CASE WHEN ok THEN f.n + 1 ELSE -1 END
  FROM (SELECT fold.*, c.chunk_id, c.doc_id, c.bag, len(ids) < 5 AND len(list_filter(docs, lambda d: d = c.doc_id)) < 3 AND len(list_filter(bags, lambda b: len(list_intersect(c.bag, b)) / len(c.bag) >= 0.6)) = 0 AS ok FROM fold JOIN cand_rows c ON c.qid = fold.qid AND c.rank = fold.n + 1) f)""",
 select="SELECT f.qid, CAST(len(f.ids) AS INTEGER) AS place, k.chunk_id, k.rank AS pos FROM fold f JOIN keyword k ON k.qid = f.qid AND k.rank = f.took", recursive=True))
def greedy_select(t: Tables) -> DataFrame:
    chunks = t.stored_chunks()
    hits = written(retrieve.keyword_topk(t.text_queries(), chunks, LIMIT), "hits")
    ranked = hits.select("qid", "chunk_id", F.col("rank").alias("pos")).join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id")
    return retrieve.greedy_select(ranked, RetrievalConfig.top_k).select("qid", "place", "chunk_id", "pos")


_TOP3 = "hits AS (SELECT k.qid, k.rank AS place, c.doc_id, c.idx, k.chunk_id, c.text, k.score FROM keyword k JOIN chunks c USING (chunk_id) WHERE k.rank <= 3)"


@query(with_(CHUNKS, KEYWORDS, KEYWORD_HITS, _TOP3, select='SELECT h.qid, h.place, c.chunk_id, c.idx AS "index" FROM hits h JOIN chunks c ON c.doc_id = h.doc_id AND c.idx BETWEEN h.idx - 1 AND h.idx + 1', recursive=True))
def neighbor_window(t: Tables) -> DataFrame:
    chunks = t.stored_chunks()
    hits = retrieve.keyword_topk(t.text_queries(), chunks, 3).join(chunks.select("chunk_id", "doc_id", "index"), "chunk_id").withColumnRenamed("rank", "place")
    return retrieve.neighbours(hits, chunks, 1).select("qid", "place", "chunk_id", "index")


@query(with_(CHUNKS, KEYWORDS, KEYWORD_HITS, _TOP3, """near AS (SELECT h.qid, h.place, h.score, c.chunk_id, c.idx, row_number() OVER (PARTITION BY h.qid, c.chunk_id ORDER BY h.place, c.idx) AS n FROM hits h JOIN chunks c ON c.doc_id = h.doc_id AND c.idx BETWEEN h.idx - 1 AND h.idx + 1
   WHERE NOT EXISTS (SELECT 1 FROM hits x WHERE x.qid = h.qid AND x.chunk_id = c.chunk_id)),
 sizes AS (SELECT qid, max(place) AS size FROM hits GROUP BY 1)""", select="""SELECT qid, place, chunk_id, 'keyword' AS source FROM hits UNION ALL
 SELECT qid, CAST(size + row_number() OVER (PARTITION BY qid ORDER BY place, idx, chunk_id) AS INTEGER), chunk_id, 'neighbor' FROM near JOIN sizes USING (qid) WHERE n = 1""", recursive=True))
def neighbor_expand(t: Tables) -> DataFrame:
    chunks = t.stored_chunks()
    hits = retrieve.keyword_topk(t.text_queries(), chunks, 3).join(chunks.select("chunk_id", "doc_id", "index", "text"), "chunk_id").withColumnRenamed("rank", "place").withColumn("source", F.lit("keyword"))
    return retrieve.with_neighbours(hits, chunks, RetrievalConfig()).select("qid", "place", "chunk_id", "source")


@query(with_(CHUNKS, KEYWORDS, KEYWORD_HITS, _TOP3, select="SELECT qid, string_agg('[KEYWORD | doc:' || doc_id || '] ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context FROM hits GROUP BY 1", recursive=True))
def format_context(t: Tables) -> DataFrame:
    chunks = t.stored_chunks()
    hits = retrieve.keyword_topk(t.text_queries(), chunks, 3).join(chunks, "chunk_id").withColumnRenamed("rank", "place").withColumn("source", F.lit("keyword"))
    return retrieve.format_context(hits)


@query(with_(CHUNKS, KEYWORDS, KEYWORD_HITS, """cases AS (SELECT b.item_id || '/' || d.doc_id AS case_id, b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
 firsts AS (SELECT case_id, min(k.rank) AS place FROM cases LEFT JOIN (SELECT qid, rank, doc_id FROM keyword JOIN chunks USING (chunk_id)) k ON k.qid = cases.qid AND k.doc_id = cases.doc_id GROUP BY 1)""",
 select="SELECT count(*) AS n, round(avg(CASE WHEN place IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / place, 0.0)), 6) AS mrr FROM firsts", recursive=True))
def hit_rate_mrr(t: Tables) -> DataFrame:
    """Keyword search judged by the documents that hold each passage."""
    chunks = t.stored_chunks()
    hits = retrieve.keyword_topk(t.text_queries(), chunks, LIMIT).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    held = retrieve.holders(t.documents, t.text_queries().withColumnRenamed("text", "passage"))
    cases = held.select(F.concat_ws("/", F.col("qid").cast("string"), F.col("doc_id").cast("string")).alias("case_id"), "qid", F.col("doc_id").alias("expected"))
    cases = written(cases, "cases")
    results = hits.join(cases.select("qid", "case_id").distinct(), "qid").select("case_id", F.col("rank").alias("place"), "doc_id")
    return retrieve.hit_rate_mrr(cases, results)


def _name_mentions(chunks: DataFrame) -> DataFrame:
    tokens = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    # a chunk of 800 characters holds at most 115 names of six letters, so positions fit in 1000
    found = chunks.select("chunk_id", "doc_id", "index", F.posexplode(F.filter(tokens, lambda w: w.rlike("^[A-Z][a-z]{5,}$"))).alias("pos", "name"))
    return graph.mentions_of(found.select("name", F.lit("CONCEPT").alias("type"), "chunk_id", F.col("doc_id").cast("string").alias("doc_id"), (F.col("doc_id") * 1_000_000_000 + F.col("index") * 1000 + F.col("pos")).alias("ord")))


def _name_evidence(mentions: DataFrame) -> DataFrame:
    """The first name of each chunk is related to the others."""
    pairs = mentions.groupBy("chunk_id").agg(F.min(F.struct("ord", "name")).alias("head"))
    return graph.evidence_of(mentions.join(pairs, "chunk_id").select(F.col("head.name").alias("source"), F.lit("WITH").alias("relation"), F.col("name").alias("target"), "chunk_id", "ord"))


def _hybrid_inputs(t: Tables) -> tuple[DataFrame, ...]:
    """Chunks of documents with offline embeddings, and a graph of all their capitalised words."""
    chunks = written(embed(t.chunks(), LetterEmbedder()), "chunks")
    mentions = written(_name_mentions(chunks), "mentions")
    evidence = _name_evidence(mentions)
    queries = embed(t.text_queries(), LetterEmbedder()).select("qid", "text", F.col("embedding").alias("vec"), F.lit(None).cast("string").alias("doc_filter"))
    return written(queries, "questions"), chunks, mentions, written(graph.edge_rollup(evidence), "edges"), written(graph.entity_facts(mentions), "entities")


_LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: CAST(length(lower(text)) - length(replace(lower(text), c, '')) AS DOUBLE))"
_HYBRID_GRAPH = r"""all_names AS (SELECT chunk_id, doc_id, idx, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{5,}')) AS names FROM chunks),
 mentions AS (SELECT lower(name) AS entity_key, name, 'CONCEPT' AS type, chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, doc_id * 1000000000 + idx * 1000 + pos - 1 AS ord FROM (SELECT chunk_id, doc_id, idx, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM all_names)),
 heads AS (SELECT chunk_id, arg_min(name, ord) AS head FROM mentions GROUP BY 1),
 evidence AS (SELECT lower(head) AS src_key, 'WITH' AS relation, entity_key AS dst_key, chunk_id, ord FROM mentions JOIN heads USING (chunk_id) WHERE lower(head) <> entity_key)"""
_HYBRID_VECTOR = f"""asked AS (SELECT item_id AS qid, text, {_LETTERS} AS e FROM benchmark),
 vscored AS (SELECT qid, chunk_id, round(list_cosine_similarity(a.e, c.e), 12) AS score FROM asked a, (SELECT chunk_id, {_LETTERS} AS e FROM chunks) c),
 vec AS (SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM vscored WHERE score >= 0.3 QUALIFY rank <= 15)"""
_HYBRID_NAMED = r"""word_lists AS (SELECT qid, list_filter(regexp_split_to_array(regexp_replace(text, '[+\-&|!(){}\[\]^"~*?:\\/]', ' ', 'g'), '\s+'), lambda w: length(w) >= 3)[1:12] AS ws FROM asked),
 terms AS (SELECT DISTINCT qid, lower(w) AS w FROM (SELECT qid, unnest(ws) AS w FROM word_lists)),
 ascii AS (SELECT qid, w, regexp_replace(w, '[^\x00-\x7F]', '#', 'g') AS a FROM terms),
 near AS (SELECT qid, entity_key, name, w, levenshtein(a, entity_key) AS d FROM ascii, entities WHERE levenshtein(a, entity_key) <= CASE WHEN length(w) <= 4 THEN 1 ELSE 2 END),
 fscored AS (SELECT qid, entity_key, name, round(sum(1 - d / length(w)), 6) AS score FROM near GROUP BY 1, 2, 3),
 spoken AS (SELECT qid, entity_key, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, length(name) DESC, entity_key) AS INTEGER) AS rank FROM fscored QUALIFY rank <= 10),
 placed AS (SELECT qid, chunk_id, min((n.rank, l.ord, chunk_id)) AS first_at FROM spoken n JOIN (SELECT entity_key, chunk_id, min(ord) AS ord FROM mentions GROUP BY 1, 2) l USING (entity_key) GROUP BY 1, 2),
 entity AS (SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY first_at) AS INTEGER) AS rank FROM placed)"""
_HYBRID_FUSED = """seeds AS (SELECT qid, chunk_id FROM vec UNION SELECT qid, chunk_id FROM entity)""", EXPAND, r"""expanded AS (SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM hop QUALIFY rank <= 5),
 parts AS (SELECT qid, chunk_id, 0 AS c, 'vector' AS channel, rank, 1.0::DOUBLE / (60 + rank) AS part FROM vec UNION ALL SELECT qid, chunk_id, 1, 'entity_name', rank, 1.3::DOUBLE / (60 + rank) FROM entity
   UNION ALL SELECT qid, chunk_id, 2, 'graph', rank, 0.8::DOUBLE / (60 + rank) FROM expanded UNION ALL SELECT qid, chunk_id, 3, 'keyword', rank, 0.6::DOUBLE / (60 + rank) FROM keyword),
 fused AS (SELECT qid, chunk_id, sum(part) AS score, string_agg(channel, '+' ORDER BY channel) AS source, min((c, rank)) AS first_at FROM parts GROUP BY 1, 2),
 ranked AS (SELECT qid, chunk_id, score, source, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first_at) AS INTEGER) AS pos FROM fused),
 cand_rows AS (SELECT r.qid, r.pos, r.chunk_id, c.doc_id, list_distinct(list_filter(regexp_split_to_array(lower(c.text), '\s+'), lambda w: w <> '')) AS bag FROM ranked r JOIN chunks c USING (chunk_id)),
 fold(qid, n, ids, docs, bags, took) AS (
  SELECT DISTINCT qid, 0, CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]), CAST([] AS VARCHAR[][]), -1 FROM cand_rows
  UNION ALL
  SELECT f.qid, f.n + 1, CASE WHEN ok THEN list_append(ids, chunk_id) ELSE ids END, CASE WHEN ok THEN list_append(docs, doc_id) ELSE docs END, CASE WHEN ok THEN list_append(bags, bag) ELSE bags END, CASE WHEN ok THEN f.n + 1 ELSE -1 END
  FROM (SELECT fold.*, c.chunk_id, c.doc_id, c.bag, len(list_filter(docs, lambda d: d = c.doc_id)) < 3 AND len(list_filter(bags, lambda b: len(list_intersect(c.bag, b)) / len(c.bag) >= 0.6)) = 0 AS ok FROM fold JOIN cand_rows c ON c.qid = fold.qid AND c.pos = fold.n + 1 WHERE len(ids) < 5) f),
 kept AS (SELECT f.qid, CAST(len(f.ids) AS INTEGER) AS place, r.chunk_id, c.doc_id, c.idx, r.score, r.source FROM fold f JOIN ranked r ON r.qid = f.qid AND r.pos = f.took JOIN chunks c USING (chunk_id)),
 near_chunks AS (SELECT k.qid, k.place, k.score, c.chunk_id, c.doc_id, c.idx, row_number() OVER (PARTITION BY k.qid, c.chunk_id ORDER BY k.place, c.idx) AS n FROM kept k JOIN chunks c ON c.doc_id = k.doc_id AND c.idx BETWEEN k.idx - 1 AND k.idx + 1
   WHERE k.place <= 3 AND NOT EXISTS (SELECT 1 FROM kept x WHERE x.qid = k.qid AND x.chunk_id = c.chunk_id)),
 sizes AS (SELECT qid, max(place) AS size FROM kept GROUP BY 1),
 found AS (SELECT qid, place, chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, score, source FROM kept
   UNION ALL SELECT qid, CAST(size + row_number() OVER (PARTITION BY qid ORDER BY place, idx, chunk_id) AS INTEGER), chunk_id, CAST(doc_id AS VARCHAR), score, 'neighbor' FROM near_chunks JOIN sizes USING (qid) WHERE n = 1)"""
_LEVEL = """{0} AS (SELECT pair_id, source, target, other AS node, min(list_append(path, other)) AS path FROM {1} JOIN step ON seed = node
   WHERE node <> target AND other <> source AND {2} GROUP BY 1, 2, 3, 4)"""


def _levels() -> list[str]:
    """Breadth first, four steps; a node counts where it is met first."""
    out = []
    for n in range(1, 5):
        unmet = [f"NOT EXISTS (SELECT 1 FROM h{m} x WHERE x.pair_id = h{n - 1}.pair_id AND x.node = other)" for m in range(1, n)]
        out.append(_LEVEL.format(f"h{n}", f"h{n - 1}", " AND ".join(unmet) or "true"))
    return out


_HYBRID_PATHS = """pairs AS (SELECT a.qid || ':' || a.rank AS pair_id, a.qid, a.rank AS nth, a.entity_key AS source, b.entity_key AS target FROM spoken a JOIN spoken b ON b.qid = a.qid AND b.rank = a.rank + 1 WHERE a.rank <= 3),
 step AS (SELECT DISTINCT seed, other FROM both_ways),
 h0 AS (SELECT pair_id, source, target, source AS node, [source] AS path FROM pairs)""", *_levels(), """ways AS (SELECT pair_id, path FROM h1 WHERE node = target UNION ALL SELECT pair_id, path FROM h2 WHERE node = target UNION ALL SELECT pair_id, path FROM h3 WHERE node = target UNION ALL SELECT pair_id, path FROM h4 WHERE node = target),
 path_rows AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY nth) - 1 AS INTEGER) AS n, pair_id, path FROM ways JOIN pairs USING (pair_id)),
 path_texts AS (SELECT qid, n, string_agg(name, ' -[WITH]-> ' ORDER BY i) AS text FROM (SELECT qid, n, unnest(path) AS entity_key, generate_subscripts(path, 1) AS i FROM path_rows) JOIN entities USING (entity_key) GROUP BY 1, 2)"""
_HYBRID = (CHUNKS, KEYWORDS, KEYWORD_HITS, _HYBRID_GRAPH, EDGES, ENTITIES, _HYBRID_VECTOR, _HYBRID_NAMED, *_HYBRID_FUSED, *_HYBRID_PATHS)


@query(with_(*_HYBRID, select="""SELECT qid, place, chunk_id, doc_id, round(score, 5) AS score, source FROM found
 UNION ALL SELECT qid, CAST(coalesce(top, 0) + n + 1 AS INTEGER), 'path:' || n, '(graph relationship)', 1.0, 'path' FROM path_texts LEFT JOIN (SELECT qid, max(place) AS top FROM found GROUP BY 1) USING (qid)""", recursive=True))
def hybrid_retrieve(t: Tables) -> DataFrame:
    found = retrieve.hybrid(*_hybrid_inputs(t))
    return found.select("qid", "place", "chunk_id", "doc_id", F.round("score", 5).alias("score"), "source")


@query(with_(*_HYBRID, select="SELECT qid, 'path:' || n AS chunk_id, text, 1.0::DOUBLE AS score, 'path' AS source FROM path_texts", recursive=True))
def path_entries(t: Tables) -> DataFrame:
    """Relationship paths between the names of a question, as rows after its hits."""
    mentions = written(_name_mentions(t.chunks()), "mentions")  # neither texts nor vectors of chunks are needed
    edges, entities = written(graph.edge_weights(_name_evidence(mentions)), "edges"), written(graph.entity_names(mentions), "entities")
    named = written(retrieve.fuzzy_entities(t.text_queries(), entities), "named")
    paths = retrieve.path_entries(named, edges, entities)
    return paths.select("qid", F.concat(F.lit("path:"), F.col("n").cast("string")).alias("chunk_id"), "text", F.lit(1.0).alias("score"), F.lit("path").alias("source"))


@query()
def hybrid_with_model(t: Tables) -> DataFrame:
    """The whole of it: follow-ups condensed, other wordings, a wider pool ranked by a (scripted) model."""
    queries, *rest = _hybrid_inputs(t)
    said = F.struct(F.lit("user").alias("role"), F.col("text"))
    asked = queries.withColumn("history", F.when(F.col("qid") % 2 == 0, F.array(said)))
    config = RetrievalConfig(condense=True, expansion=True, rerank=True)
    found = retrieve.hybrid(asked, *rest, config, model=ScriptedChat.assistant(), embedder=LetterEmbedder())
    return found.select("qid", "place", "chunk_id", "doc_id", F.round("score", 5).alias("score"), "source")


@query()
def agentic_loop(t: Tables) -> DataFrame:
    chunks = t.stored_chunks()

    def search(q: DataFrame) -> DataFrame:
        hits = retrieve.keyword_topk(q, chunks, RetrievalConfig.top_k)
        return hits.join(chunks.select("chunk_id", "text"), "chunk_id").select("qid", F.col("rank").alias("place"), "chunk_id", "text", F.col("score").cast("double").alias("score"))

    asked = t.text_queries().select("qid", F.posexplode(F.slice(F.split("text", r"\. "), 1, 4)).alias("sub_no", "text"))
    found = agentic.run(asked, search, ScriptedChat.word_overlap(), ScriptedChat.first_half(), lambda df: written(df, "agentic"))
    return found.select("qid", "sub_no", "pos", "chunk_id", "relevance")


@query(f"SELECT item_id AS qid, count(*) FILTER (WHERE length(w) >= 3 AND w NOT IN ({STOP})) AS n_keywords FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS w FROM benchmark) GROUP BY 1")
def stopword_filter(t: Tables) -> DataFrame:
    from quarry.config import STOPWORDS

    words = t.text_queries().select("qid", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("w"))
    return words.groupBy("qid").agg(F.count_if((F.length("w") >= 3) & ~F.col("w").isin(*STOPWORDS)).alias("n_keywords"))
