"""Operators against plain-Python models, and fall-backs."""

import difflib
import itertools
import json
import math
import os
import random
import uuid
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.config import IngestConfig, RetrievalConfig
from quarry.corpus import Corpus
from quarry.functions import text as T
from quarry.operators import agentic, chunking, extraction, graph, providers, retrieve, store, structural, textindex
from quarry.operators.shared import written


# --- chunks --------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_windows_cover_the_text(text, size, overlap):
    pieces = list(chunking.windows(text, size, overlap))
    body = text.strip()
    assert all(p and p == p.strip() and len(p) <= size for p in pieces)
    at = 0
    for piece in pieces:  # every piece is found in order
        found = body.find(piece, max(0, at - size - overlap))
        assert found >= 0
        at = found
    assert sorted(set("".join(pieces)) - set(" \n")) == sorted(set(body) - set(" \n"))


def test_window_rules():
    early = "a" * 10 + "\n\n" + "b" * 60 + ". " + "c" * 60
    assert len(next(chunking.windows(early, 100, 10))) == 100  # an early break hides the sentence
    late = "a" * 70 + "\n\n" + "b" * 80
    assert next(chunking.windows(late, 100, 10)) == "a" * 70
    sentence = "a" * 70 + ". " + "b" * 80
    assert next(chunking.windows(sentence, 100, 10)) == "a" * 70 + "."
    short = "x" * 60 + ". tail"
    assert list(chunking.windows(short, 100, 10)) == ["x" * 60 + ".", ("x" * 9 + ". tail")]
    assert list(chunking.windows("  \n", 100, 10)) == [] and list(chunking.windows(None, 100, 10)) == []


def test_chunk_ids_and_index(spark):
    blocks = spark.createDataFrame([("d", 0, "one"), ("d", 1, " "), ("d", 2, "two"), ("e", 0, "x" * 900)], "doc_id string, block_no int, text string")
    rows = sorted((r["doc_id"], r["index"], r["text"][:3], r["chunk_id"]) for r in chunking.chunk_documents(blocks).collect())
    assert [r[:3] for r in rows] == [("d", 0, "one"), ("d", 1, "two"), ("e", 0, "xxx"), ("e", 1, "xxx")]
    assert all(r[3] == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r[0]}:{r[1]}")) for r in rows)


# --- expressions ---------------------------------------------------------------------------


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_text_expressions(spark):
    assert one(spark, T.normalize_key(F.col("a")), a=" New  York\t") == "new york"
    assert one(spark, T.keywords(F.col("a")), a="What is the Red widget, the RED bolt_2 of X?") == ["red", "widget", "bolt_2"]
    assert [tuple(x) for x in one(spark, T.fuzzy_terms(F.col("a")), a='Acme~ "Corporation" of it')] == [("acme", 1), ("corporation", 2)]
    assert one(spark, T.year_of(F.col("a")), a="in 12024 or 1988-02") == "1988"
    assert one(spark, T.relation_label(F.col("a")), a="--order date!") == "HAS_ORDER_DATE"
    assert [one(spark, T.key_type(F.col("a")), a=k) for k in ("Chapter", "hostname", "zzz", "customer_name", "update")] == ["THREAT_ACTOR", "PERSON", None, "PERSON", "DATE"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def met(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    asked = rows.select("w", F.explode(T.near_probe(F.col("w"), F.lit(2))).alias("key"))
    found = asked.join(rows.select(F.col("w").alias("v"), F.explode(T.near_index(F.col("w"))).alias("key")), "key")
    return {(r["w"], r["v"]) for r in found.select("w", "v").distinct().collect()}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=5), min_size=2, max_size=6, unique=True))
def test_keys_find_all_near_words(spark, words):
    pairs = met(spark, words)
    assert all((a, b) in pairs for a in words for b in words if distance(a, b) <= 2)


def test_keys_of_long_words(spark):
    """Around and beyond the length where the keys change, and for a word of thousands of letters."""
    rng = random.Random(2)
    words = set()
    for n in (22, 23, 24, 25, 26, 27, 40, 3000):
        base = "".join(rng.choices("abcdefgh", k=n))
        words.add(base)
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(1, 2)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
            words.add("".join(w))
    words = sorted(words)
    pairs = met(spark, words)
    near = [(a, b) for a in words for b in words if abs(len(a) - len(b)) <= 2 and (len(a) < 100 or a == b) and distance(a, b) <= 2]
    assert len(near) > 300 and all(p in pairs for p in near)
    keys = spark.createDataFrame([("z" * 2000,)], "w string").select(F.size(T.near_index(F.col("w"))), F.size(T.near_probe(F.col("w"), F.lit(2)))).first()
    assert max(keys) <= 100


# --- structure -----------------------------------------------------------------------------


def test_walk():
    w = structural.Walk({"company": {"name": "Acme"}, "orders": [{"sku": "A1", "note": "x"}], "when": None})
    assert list(w.kinds.values()) == [("Acme", "ORGANIZATION"), ("A1", "PRODUCT")]
    assert w.edges == [("Acme", "HAS_ORDERS", "A1")] and w.coverage == 2 / 4
    two = structural.Walk({"buyer": "John", "seller": "Jane", "year": 1988, "ok_date": True})
    assert two.edges == [("John", "HAS_SELLER", "Jane"), ("John", "HAS_YEAR", "1988")] and two.kinds["1988"] == ("1988", "DATE")
    event = structural.Walk({"name": "Breach", "date": "March 2021", "long_city": "x" * 101})
    assert event.kinds["breach"][1] == "EVENT" and len(event.kinds) == 2 and event.coverage == 1.0
    wrap = structural.Walk({"customer": {"name": "Ann"}, "supplier": {"name": "Bob"}})
    assert wrap.edges == [("Ann", "HAS_SUPPLIER", "Bob")] * 2  # nesting and sibling both count as evidence
    deep = {"name": "bottom"}
    for _ in range(7):
        deep = {"x": deep}
    assert structural.Walk(deep).kinds == {} and structural.Walk("text").coverage == 0.0


def test_extract_records_survives_bad_json(spark):
    rows = spark.createDataFrame([("{", 1), (None, 2), ('{"city": "Rome"}', 3)], "record string, k int")
    got = {r["k"]: r for r in structural.extract_records(rows).collect()}
    assert got[1]["entities"] == [] and got[2]["coverage"] == 0.0 and got[3]["entities"][0]["type"] == "LOCATION"


def test_odd_numbers_and_depth_do_not_end_the_job(spark):
    texts = ['{"year": Infinity, "company": "Acme"}', '{"year": 1e999, "city": "Rome"}', '{"year": NaN, "company": "Globex"}', "[" * 100_000, '{"a":' * 50_000 + "1" + "}" * 50_000, '{"year": ' + "9" * 5000 + "}", '{"year": 1988.0, "company": "X"}']
    got = structural.extract_records(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, record string"))
    names = {r["i"]: [e["name"] for e in r["entities"]] for r in got.collect()}
    assert names == {0: ["Acme"], 1: ["Rome"], 2: ["Globex"], 3: [], 4: [], 5: [], 6: ["1988", "X"]}


def test_parse_extraction(spark):
    reply = {"entities": [{"name": " Acme ", "type": "organization"}, {"name": "acme", "type": "PERSON"}, {"name": "X"}, {"name": "Rome"}], "relationships": [{"source": "ACME", "relation": "based in", "target": "Rome"}, {"source": "Acme", "relation": "is", "target": "acme"}, {"source": "Acme", "relation": "", "target": "Rome"}, {"source": "Acme", "relation": "r", "target": "Oslo"}]}
    rows = spark.createDataFrame([("```json\n" + json.dumps(reply) + "\n```",), ("no json",), (None,)], "reply string")
    good, bad, none = (r for r in extraction.parse_extraction(rows).collect())
    assert [tuple(e) for e in good["entities"]] == [("Acme", "ORGANIZATION"), ("Rome", "CONCEPT")]
    assert [tuple(e) for e in good["relations"]] == [("ACME", "BASED_IN", "Rome")]
    assert bad["entities"] == none["entities"] == [] and bad["relations"] == []


# --- graph ---------------------------------------------------------------------------------


def small_graph(spark):
    names = [("Acme", "CONCEPT", "c1", "d1"), ("ACME ", "ORGANIZATION", "c2", "d1"), ("acme", "PERSON", "c3", "d2"), ("Bob", "weird", "c1", "d1"), ("Rome", "LOCATION", "c3", "d2"), ("1999", "DATE", "c1", "d1"), (" ", "DATE", "c1", "d1")]
    mentions = graph.mentions_of(spark.createDataFrame([(*x, n) for n, x in enumerate(names)], "name string, type string, chunk_id string, doc_id string, ord bigint"))
    pairs = [("Bob", "KNOWS", "Acme", "c1"), ("acme", "KNOWS", "bob", "c2"), ("Bob", "KNOWS", "Acme", "c1"), ("Acme", "IN", "Rome", "c3"), ("Bob", "IN", "bob", "c1"), ("Bob", "IN", "Oslo", "c1"), ("Bob", "AT", "1999", "c1")]
    evidence = graph.evidence_of(spark.createDataFrame([(*x, n) for n, x in enumerate(pairs)], "source string, relation string, target string, chunk_id string, ord bigint"))
    return mentions, graph.known_ends(evidence, mentions)


def test_roll_ups(spark):
    mentions, evidence = small_graph(spark)
    rows = {r["entity_key"]: r for r in graph.entity_facts(mentions).collect()}
    assert (rows["acme"]["name"], rows["acme"]["type"], rows["acme"]["n_chunks"]) == ("Acme", "ORGANIZATION", 3)
    assert rows["bob"]["type"] == "CONCEPT" and "" not in rows
    edges = {tuple(r) for r in graph.edge_rollup(evidence).collect()}
    assert edges == {("bob", "acme", "KNOWS", 3, 2), ("acme", "rome", "IN", 1, 1), ("bob", "1999", "AT", 1, 1)}


def test_expansion_paths_delete_and_merge(spark):
    mentions, evidence = small_graph(spark)
    edges, entities = graph.edge_rollup(evidence), graph.entity_facts(mentions)
    seeds = spark.createDataFrame([(1, "c2")], "qid int, chunk_id string")
    got = [(r["chunk_id"], r["score"]) for r in graph.expand(seeds, mentions, edges, entities, 5, ("DATE",)).orderBy("rank").collect()]
    assert got == [("c1", 3), ("c3", 1)]
    assert graph.expand(seeds, mentions, edges, entities, 0, ()).count() == 0
    pairs = spark.createDataFrame([("a", "1999", "rome"), ("b", "bob", "bob"), ("c", "rome", "nowhere")], "pair_id string, source string, target string")
    assert [(r["pair_id"], r["hops"], r["path"]) for r in graph.shortest_paths(pairs, edges, 4).collect()] == [("a", 3, ["1999", "bob", "acme", "rome"])]
    assert graph.shortest_paths(pairs, edges, 2).count() == 0
    drawn = graph.path_lines(graph.shortest_paths(pairs, edges, 4), edges, entities).collect()
    assert [r["text"] for r in drawn] == ["1999 -[AT]-> Bob -[KNOWS]-> Acme -[IN]-> Rome"]
    appears = spark.createDataFrame([("rome", "d7"), ("paris", "d7"), ("paris", "d8"), ("oslo", "d8"), ("1999", "d9"), ("rome", "d9")], "entity_key string, doc_id string")
    facts = entities.select("entity_key", "name").unionByName(spark.createDataFrame([("paris", "Paris"), ("oslo", "Oslo")], "entity_key string, name string"))
    far = spark.createDataFrame([("a", "1999", "rome"), ("d", "acme", "paris"), ("e", "rome", "oslo"), ("f", "acme", "oslo")], "pair_id string, source string, target string")
    found = graph.shortest_paths(far, edges, 4, appears)
    titles = spark.createDataFrame([("d7", "Seven"), ("d9", None)], "doc_id string, title string")
    drawn = {(r["pair_id"], r["hops"], r["text"]) for r in graph.path_lines(found, edges, facts, appears, titles).collect()}
    assert drawn == {
        ("a", 2, "1999 -[APPEARS_IN]-> d9 -[APPEARS_IN]-> Rome"), ("d", 3, "Acme -[IN]-> Rome -[APPEARS_IN]-> Seven -[APPEARS_IN]-> Paris"),
        ("e", 4, "Rome -[APPEARS_IN]-> Seven -[APPEARS_IN]-> Paris -[APPEARS_IN]-> d8 -[APPEARS_IN]-> Oslo"),
    }
    chunks = spark.createDataFrame([("c1", "d1"), ("c2", "d1"), ("c3", "d2")], "chunk_id string, doc_id string")
    m, e, c = graph.delete_documents(spark.createDataFrame([("d1",)], "doc_id string"), mentions, evidence, chunks)
    assert {r[0] for r in m.select("entity_key").collect()} == {"acme", "rome"} and e.count() == 1 and c.count() == 1
    merges = spark.createDataFrame([("acme", "bob"), ("acme", "nobody")], "keep string, absorb string")
    m, e = graph.merge_entities(mentions, evidence, merges)
    assert {tuple(r)[:3] for r in graph.edge_rollup(e).collect()} == {("acme", "rome", "IN"), ("acme", "1999", "AT")}
    assert {r["entity_key"]: r["name"] for r in graph.entity_facts(m).collect()}["acme"] == "Acme"


# --- fusion and selection ------------------------------------------------------------------


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=8, unique=True), st.lists(st.integers(0, 8), max_size=8, unique=True))
def test_rrf_model(spark, a, b):
    table = lambda ids: spark.createDataFrame([(1, f"c{x}", n) for n, x in enumerate(ids, 1)], "qid int, chunk_id string, rank int")
    got = [(r["chunk_id"], round(r["score"], 9)) for r in retrieve.rrf({"vector": table(a), "keyword": table(b)}).orderBy("pos").collect()]
    score = {}
    for weight, ids in ((1.0, a), (0.6, b)):
        for n, x in enumerate(ids, 1):
            score[f"c{x}"] = score.get(f"c{x}", 0.0) + weight / (60 + n)
    assert got == [(k, round(v, 9)) for k, v in sorted(score.items(), key=lambda p: -round(p[1], 12))]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.text("ab c", max_size=8)), max_size=12), st.integers(1, 5))
def test_greedy_model(spark, items, size):
    ranked = spark.createDataFrame([(1, n, f"c{n}", d, t) for n, (d, t) in enumerate(items, 1)], "qid int, pos int, chunk_id string, doc_id string, text string")
    got = [r["pos"] for r in retrieve.greedy_select(ranked, size, 0.6, 2).orderBy("place").collect()]
    kept = []
    for n, (doc, text) in enumerate(items, 1):
        bag = set(text.split())
        if not bag or len(kept) >= size or any(len(bag & o) / len(bag) >= 0.6 for _, _, o in kept) or sum(d == doc for _, d, _ in kept) >= 2:
            continue
        kept.append((n, doc, bag))
    assert got == [k[0] for k in kept]


def test_vector_blocks_and_filters(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 2)
    monkeypatch.setattr(retrieve, "VECTOR_BLOCK", 5)
    rows = [(n, n % 2, [math.cos(n), math.sin(n)]) for n in range(12)]
    vectors = spark.createDataFrame(rows, "chunk_id int, doc_id int, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(n, [math.cos(n), math.sin(n)], None if n else "1") for n in range(5)], "qid int, vec array<float>, doc_filter string")
    for most in (retrieve.BROADCAST_BYTES, 0):  # sent to all executors, and dealt out in blocks
        monkeypatch.setattr(retrieve, "BROADCAST_BYTES", most)
        got = {}
        for r in retrieve.vector_topk(queries, vectors, 3, 0.1).collect():
            got.setdefault(r["qid"], []).append((r["rank"], r["chunk_id"]))
        for n in range(5):
            near = [(-math.cos(n - m), m) for m in range(12) if math.cos(n - m) >= 0.1 and (n or m % 2 == 1)]
            assert [c for _, c in sorted(got[n])] == [m for _, m in sorted(near)[:3]]
    same = spark.createDataFrame([(n, 0, [1.0, 2.0]) for n in range(9)], "chunk_id int, doc_id int, embedding array<float>").repartition(4)
    assert [r["chunk_id"] for r in retrieve.vector_topk(queries.where("qid = 1"), same, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert retrieve.vector_topk(queries.limit(0), vectors, 3).count() == 0


# --- providers, agentic loop, stores, streaming ----------------------------------------------


def test_retry():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise providers.ModelError("busy", 503)
        return "ok"

    assert providers.with_retry(flaky, 3, 1.0, waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(providers.ModelError):
        providers.with_retry(lambda: (_ for _ in ()).throw(providers.ModelError("no", 404)), 3, 1.0, waits.append)
    assert len(waits) == 2


def test_failing_models_give_nothing(spark):
    def broken(_):
        raise RuntimeError("down")

    rows = spark.createDataFrame([("p",)], "text string")
    assert extraction.extract_with_model(rows, providers.ScriptedChat(broken), "text", base_delay=0.0).first()["entities"] == []
    second = providers.ScriptedChat(lambda p: "from the other")
    assert providers.ask(rows, providers.ScriptedChat(broken), "text", 2, 0.0, second).first()["reply"] == "from the other"
    seen = extraction.extract_with_model(rows, providers.ScriptedChat(lambda p: json.dumps({"entities": [{"name": p[-40:].split("\n")[-1] + "ens", "type": "LAW"}]})), "text").first()
    assert [tuple(e) for e in seen["entities"]] == [("pens", "LAW")]  # the text comes last in the prompt


def test_grades_and_variants(spark):
    rows = spark.createDataFrame([(1, p, r) for r in ['[{"index": 0, "score": 7}, {"index": 2, "score": 5}]'] for p in (1, 2, 3)] + [(2, 1, "bad")], "qid int, place int, reply string")
    assert [(r["qid"], r["place"], r["relevance"]) for r in agentic.grade(rows).orderBy("qid", "place").collect()] == [(1, 1, 7.0), (1, 3, 5.0), (2, 1, None)]
    assert [r["place"] for r in agentic.rerank(rows.where("qid = 1")).orderBy("new_place").collect()] == [1, 3, 2]
    texts = spark.createDataFrame([(1, "q", '["a", " ", "b"]'), (2, "q", "oops"), (3, "q", "[]")], "qid int, text string, reply string")
    assert [(r["qid"], r["text"]) for r in agentic.sub_questions(texts).orderBy("qid", "sub_no").collect()] == [(1, "a"), (1, "b"), (2, "q"), (3, "q")]


def test_agentic_loop_rewords_until_enough(spark):
    found = {"alpha beta": [], "beta": [("c1", "alpha beta")], "same": [("c2", "nothing")]}

    def search(q):
        rows = [(k, n, c, t, 1.0) for k, text in [(r["qid"], r["text"]) for r in q.collect()] for n, (c, t) in enumerate(found.get(text, []), 1)]
        return spark.createDataFrame(rows, "qid string, place int, chunk_id string, text string, score double")

    asked = spark.createDataFrame([(1, 0, "alpha beta"), (2, 0, "same")], "qid int, sub_no int, text string")
    last_word = providers.ScriptedChat(lambda p: p.split()[-1])
    out = agentic.run(asked, search, providers.ScriptedChat.word_overlap(), last_word, lambda df: written(df, "t"), RetrievalConfig())
    assert [(r["qid"], r["chunk_id"], r["relevance"]) for r in out.collect()] == [(1, "c1", 10.0)]


def test_session_tables_are_cleared(spark):
    """Intermediate tables lie in a folder of the session, which can be removed as a whole."""
    from quarry.operators import shared

    other = spark.newSession()
    kept = written(other.range(3), "kept")
    assert shared.session_folder(spark) in kept.inputFiles()[0] and kept.count() == 3
    real, folder = shared.session_folder, shared.session_folder(spark) + "-x"
    shared.session_folder = lambda _: folder
    try:
        gone = written(other.range(3), "gone")
        shared.clear(spark)
    finally:
        shared.session_folder = real
    with pytest.raises(Exception):
        gone.count()
    assert kept.count() == 3


def test_mistakes_in_the_code_are_not_soft(spark, monkeypatch):
    vectors = letters(spark, [(1, "alpha", None)])
    docs = spark.createDataFrame([("d1", "alpha beta gamma")], "doc_id string, text string")
    corpus = Corpus.build(spark, docs, providers.HashEmbedder(16), *(x.limit(0) for x in small_graph(spark)))
    for error, soft in ((RuntimeError, True), (TypeError, False), (KeyError, False)):
        monkeypatch.setattr(retrieve, "fuzzy_entities", lambda *_, error=error: (_ for _ in ()).throw(error("broken")))
        if soft:
            assert corpus.retrieve(vectors, RetrievalConfig(min_score=0.0)).count() == 1
        else:
            with pytest.raises(error):
                corpus.retrieve(vectors, RetrievalConfig(min_score=0.0))


def test_prompts_hold_the_task(spark):
    """A model is told what to do; grades below the configured threshold go; options reach the model."""
    asked = spark.createDataFrame([(1, 0, "alpha beta")], "qid int, sub_no int, text string")
    hits = spark.createDataFrame([("1/0", n, f"c{n}", t, 1.0) for n, t in ((1, "alpha"), (2, "alpha beta"))], "qid string, place int, chunk_id string, text string, score double")
    grader = providers.ScriptedChat(lambda p: providers.ScriptedChat.word_overlap().chat(p) if p.startswith(agentic.GRADE_TASK) and "[1] alpha beta" in p else "no task")
    reworder = providers.ScriptedChat(lambda p: "alpha" if p.startswith(agentic.REWORD_TASK) and "Question: alpha beta" in p else "")
    for threshold, want in ((5.0, {"c1", "c2"}), (6.0, {"c2"})):
        out = agentic.run(asked, lambda q: hits, grader, reworder, lambda df: written(df, "t"), RetrievalConfig(grade_threshold=threshold, max_retries=1))
        assert {r["chunk_id"] for r in out.collect()} == want
    assert providers.build_options() == {} and providers.build_options(temperature=0.0, max_tokens=5, stop=["x"]) == {"temperature": 0.0, "num_predict": 5, "stop": ["x"]}

    class Echo:
        def chat(self, prompt, options=None):
            return json.dumps(options)

    rows = spark.createDataFrame([("p",)], "text string")
    assert providers.ask(rows, Echo(), "text").first()["reply"] == "null"
    assert providers.ask(rows, Echo(), "text", options=providers.build_options(seed=1)).first()["reply"] == '{"seed": 1}'


def test_stores(spark):
    jobs = spark.createDataFrame([(n, "done" if n < 4 else "queued", n) for n in range(6)], "job_id int, status string, at int")
    assert sorted(r["job_id"] for r in store.prune_finished(jobs, 2).collect()) == [2, 3, 4, 5]
    assert store.can_cancel("queued") and not store.can_cancel("done")
    with pytest.raises(ValueError):
        RetrievalConfig(top_k=21)


def letters(spark, rows):
    queries = spark.createDataFrame(rows, "qid int, text string, doc_filter string")
    return providers.embed(queries, providers.HashEmbedder(16)).withColumnRenamed("embedding", "vec")


def test_corpus(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "Acme sells widgets in Rome. " * 3), ("d2", "Bob repairs engines.")], "doc_id string, text string")
    mentions, evidence = small_graph(spark)
    embedder = providers.HashEmbedder(16)
    corpus = Corpus.build(spark, docs, embedder, mentions, evidence)
    again = corpus.ingest(docs, embedder)
    assert again.chunks.count() == corpus.chunks.count() == 2 and again.documents.count() == 2
    queries = letters(spark, [(1, "who repairs engines", None)])
    assert corpus.retrieve(queries).where("place = 1").first()["doc_id"] == "d2"
    reply = corpus.answer(queries, providers.ScriptedChat(lambda p: p)).first()["reply"]
    assert "doc:d2" in reply and "user: who repairs engines" in reply and "`d2` — Bob repairs engines." in reply
    assert corpus.delete(docs.where("doc_id = 'd1'").select("doc_id")).chunks.count() == 1


def test_ingest_writes_the_graph_and_carries_places(spark, tmp_path):
    """Blocks of files become chunks with their page or record and a graph: by structure where the
    fields are known, else by the model; a second time changes nothing, a changed file replaces its own."""
    from quarry.sources import parsers

    embedder, calls = providers.HashEmbedder(16), providers.ScriptedChat.capitalised_names()
    files = [("a.json", json.dumps([{"company": "Acme", "city": "Rome"}, {"zzz": "Unknown Thing", "qqq": 1}])), ("b.txt", "Meeting with Globex about Initech."), ("c.txt", "Meeting with Globex about Initech.")]

    def blocks(some):
        rows = spark.createDataFrame([(n, bytearray(t.encode())) for n, t in some], "path string, content binary")
        return parsers.parse_files(rows).withColumn("doc_id", F.regexp_replace("path", r"\.\w+$", "")).drop("path", "error")

    none = spark.createDataFrame([], "doc_id string, text string")
    m, e = (x.limit(0) for x in small_graph(spark))
    corpus = Corpus.build(spark, none, embedder, m, e).ingest(blocks(files[:2]), embedder, calls)
    twice = corpus.ingest(blocks(files), embedder, calls)
    assert corpus.duplicates().count() == 0
    assert [(r["doc_id"], r["duplicate_of"]) for r in twice.duplicates().collect()] == [("c", "b")]  # c holds what b does, and stays
    for c, copies in ((corpus, "b"), (twice, "bc")):
        assert {(r["doc_id"], r["record"]) for r in c.chunks.collect()} == {("a", 0), ("a", 1), *((d, None) for d in copies)}
        assert {(r["name"], r["doc_id"]) for r in c.mentions.collect()} == {("Acme", "a"), ("Rome", "a"), ("Unknown", "a"), ("Thing", "a"), *((n, d) for n in ("Meeting", "Globex", "Initech") for d in copies)}
        words = {(r["token"], r["chunk_id"]) for r in textindex.words_of(c.chunks).collect()}
        assert {(r["token"], r["chunk_id"]) for r in c.postings.collect()} == words
        assert [(r["src_key"], r["relation"], r["dst_key"]) for r in c.evidence.collect()] == [("acme", "HAS_CITY", "rome")]
    changed = twice.ingest(blocks([("a.json", '{"company": "Hooli"}')]), embedder, calls)
    assert {r["name"] for r in changed.mentions.collect()} == {"Hooli", "Meeting", "Globex", "Initech"} and changed.evidence.count() == 0
    known = {r["chunk_id"] for r in changed.chunks.collect()}
    assert {r["chunk_id"] for r in changed.mentions.collect()} <= known
    changed.save(str(tmp_path / "c"))
    opened = Corpus.open(spark, str(tmp_path / "c")).checked()
    assert opened.chunks.count() == 3 and opened.postings.count() == changed.postings.count()
    with pytest.raises(ValueError):
        Corpus(spark, changed.documents, changed.chunks.union(changed.chunks), changed.postings, changed.mentions, changed.evidence).checked()


def test_later_documents_come_after_earlier_ones(spark):
    """The first name, type and direction stay, whatever the ids of documents that come later."""
    embedder = providers.HashEmbedder(16)
    none = spark.createDataFrame([], "doc_id string, text string")

    def model(prompt):
        text = prompt.partition("\n\nText:\n")[2] or prompt
        found = {"first": ("ACME", "ORGANIZATION", "ACME", "Rome"), "later": ("Acme", "PERSON", "Rome", "acme")}["first" if "first" in text else "later"]
        return json.dumps({"entities": [{"name": found[0], "type": found[1]}, {"name": "Rome", "type": "LOCATION"}], "relationships": [{"source": found[2], "relation": "IN", "target": found[3]}]})

    docs = lambda *ids: spark.createDataFrame([(d, f"the {'first' if d.startswith('z') else 'later'} text of {d}", f"Title {d}") for d in ids], "doc_id string, text string, title string")
    empty = Corpus.build(spark, none, embedder, *(x.limit(0) for x in small_graph(spark)))
    corpus = empty
    for ids in (("z9", "z8"), ("a1", "b2"), ("c3",)):
        corpus = corpus.ingest(docs(*ids), embedder, providers.ScriptedChat(model))
    facts = {r["entity_key"]: (r["name"], r["type"], r["n_docs"]) for r in graph.entity_facts(corpus.mentions).collect()}
    assert facts == {"acme": ("ACME", "ORGANIZATION", 5), "rome": ("Rome", "LOCATION", 5)}
    assert [tuple(r)[:4] for r in graph.edge_rollup(corpus.evidence).collect()] == [("acme", "rome", "IN", 5)]
    assert len({r["ord"] for r in corpus.mentions.collect()}) == corpus.mentions.count() == 10
    assert {(r["doc_id"], r["title"], r["batch"]) for r in corpus.documents.collect()} == {("z9", "Title z9", 0), ("z8", "Title z8", 0), ("a1", "Title a1", 1), ("b2", "Title b2", 1), ("c3", "Title c3", 2)}


def test_command_line(spark, tmp_path):
    from quarry.__main__ import arguments, run

    docs = spark.createDataFrame([("d1", "Acme sells widgets in Rome."), ("d2", "Bob repairs engines.")], "doc_id string, text string")
    folder, cases = str(tmp_path / "c"), tmp_path / "cases.json"
    Corpus.build(spark, docs, providers.HashEmbedder(64), *small_graph(spark)).save(folder)
    cases.write_text(json.dumps([{"query": "Bob repairs engines", "expected_doc_id": "d2"}, {"query": "nothing", "expected_doc_id": "d9"}]))
    assert run(spark, arguments([folder, "evaluate", str(cases)])) == ["cases 2, hit rate at 5 50.0%, mean reciprocal rank 0.500"]
    assert any("Rome" in line for line in run(spark, arguments([folder, "low-evidence"])))
    assert run(spark, arguments([folder, "dedupe", "--threshold", "0.2"])) == []  # each of another type
    run(spark, arguments([folder, "merge", "Acme", " BOB", str(tmp_path / "d")]))
    assert "bob" not in {r["entity_key"] for r in Corpus.open(spark, str(tmp_path / "d")).mentions.collect()}
    with pytest.raises(ValueError, match="Nobody"):
        run(spark, arguments([folder, "merge", "Acme", "Nobody", str(tmp_path / "e")]))


def test_retrieval_steps_with_a_model(spark, monkeypatch):
    """Condensing, other wordings and ranking anew are asked for; a channel that fails is left empty."""
    docs = spark.createDataFrame([("d1", "Acme sells widgets in Rome."), ("d2", "Bob repairs engines."), ("d3", "Engines need oil.")], "doc_id string, text string")
    embedder = providers.HashEmbedder(16)
    corpus = Corpus.build(spark, docs, embedder, *small_graph(spark))
    prompts = spark.sparkContext.accumulator(0)

    def answer(prompt):
        prompts.add(1)
        if prompt.startswith("Conversation"):
            assert "user: about Bob" in prompt
            return "what does Bob repair"
        if "other ways" in prompt:
            return '["engines oil", "Bob engines"]'
        return '[{"index": 0, "score": 1}, {"index": 1, "score": 9}]'

    rows = letters(spark, [(1, "and what does he do", None)]).withColumn("history", F.array(F.struct(F.lit("user").alias("role"), F.lit("about Bob").alias("text"))))
    config = RetrievalConfig(min_score=0.0, condense=True, expansion=True, rerank=True)
    plain = corpus.retrieval(rows, RetrievalConfig(min_score=0.0))
    found = corpus.retrieval(rows, config, model=providers.ScriptedChat(answer), embedder=embedder)
    assert {"condense", "vector", "expansion", "rerank", "paths", "total"} <= set(found.timings) and "condense" not in plain.timings
    assert {r["doc_id"] for r in found.results.collect()} >= {"d2"} and prompts.value >= 3
    assert ("Bob", "CONCEPT") in {(r["name"], r["type"]) for r in found.related.collect()}

    def failing(*_):
        raise RuntimeError("down")

    monkeypatch.setattr(retrieve, "keyword_topk", failing)
    left = corpus.retrieve(rows, RetrievalConfig(min_score=0.0))
    assert left.count() and not left.where("source like '%keyword%'").count()
    with pytest.raises(RuntimeError):
        corpus.retrieve(rows, RetrievalConfig(min_score=0.0, fail_soft=False))


def test_smart_retrieval_in_steps(spark):
    docs = spark.createDataFrame([("d1", "alpha beta gamma"), ("d2", "delta epsilon")], "doc_id string, text string")
    embedder = providers.HashEmbedder(16)
    corpus = Corpus.build(spark, docs, embedder, *(x.limit(0) for x in small_graph(spark)))

    def answer(prompt):
        if prompt.startswith("Split"):
            return '["alpha beta", "delta epsilon"]'
        return providers.ScriptedChat.word_overlap().chat(prompt)

    config = RetrievalConfig(agentic=True, min_score=0.0, max_retries=0)
    assert corpus.smart_retrieval(letters(spark, [(1, "alpha", None)]), providers.ScriptedChat(answer), embedder, config).related.count() == 0  # there is no graph
    found = corpus.smart_retrieve(letters(spark, [(1, "alpha and delta", None)]), providers.ScriptedChat(answer), embedder, config)
    assert {r["doc_id"] for r in found.collect()} == {"d1", "d2"}


def test_keyword_filter_comes_before_the_limit(spark):
    chunks = spark.createDataFrame([(f"c{n:03}", "a" if n < 40 else "b", n, "widget") for n in range(60)], "chunk_id string, doc_id string, index int, text string")
    asked = spark.createDataFrame([(1, "widget", "b"), (2, "widget", None)], "qid int, text string, doc_filter string")
    rows = retrieve.keyword_topk(asked, chunks, 15, 15).collect()
    assert {r["chunk_id"] for r in rows if r["qid"] == 1} == {f"c{n:03}" for n in range(40, 55)} and sum(r["qid"] == 2 for r in rows) == 15


def test_greedy_in_slices(spark):
    """Many near copies before the first other text: later slices are reached, with the same outcome."""
    rows = [(1, n, f"c{n}", f"d{n}", "same words here" if n < 300 else f"other{n} text{n}") for n in range(1, 320)] + [(2, 1, "x", "d", "alone")]
    ranked = spark.createDataFrame(rows, "qid int, pos int, chunk_id string, doc_id string, text string")
    for first in (4, 1000):
        got = [(r["qid"], r["place"], r["pos"]) for r in retrieve.greedy_select(ranked, 3, first=first).orderBy("qid", "place").collect()]
        assert got == [(1, 1, 1), (1, 2, 300), (1, 3, 301), (2, 1, 1)]


def test_holders_of_passages(spark):
    docs = spark.createDataFrame([(1, "xx one two three four five six seven yy"), (2, "one two"), (3, "stone twofold"), (4, "ab"), (5, None)], "doc_id int, text string")
    passages = spark.createDataFrame([(1, "e two three four five six s"), (2, "one two"), (3, "b"), (4, "absent words are not in any text here"), (5, "")], "qid int, passage string")
    assert {tuple(r) for r in retrieve.holders(docs, passages).collect()} == {(1, 1), (2, 1), (2, 2), (2, 3), (3, 4)}
    assert retrieve.holders(docs, passages.limit(0)).count() == 0


def test_job_log(spark, tmp_path):
    log = store.JobLog(spark, str(tmp_path / "jobs"), every=3)
    assert log.status("j") is None and not log.request_cancel("j")
    log.add("j", "processing")
    assert [log.progress("j", str(n)) for n in range(6)] == [False, False, True] * 2
    assert log.status("j") == "processing" and log.request_cancel("j") and log.is_cancelled("j") and not log.request_cancel("j")


def test_row_numbers_over_ranges(spark):
    rows = spark.createDataFrame([("a" if n % 3 else "b", (n * 37) % 1000) for n in range(1000)], "f string, k int").repartition(7)
    got = chunking.row_numbers(rows, "f", ["k"]).collect()
    for name in "ab":
        mine = sorted((r["k"], r["n"]) for r in got if r["f"] == name)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_streaming(spark, tmp_path):
    from quarry.streaming import ingest

    landing, root = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    (landing / "a.txt").write_text("first text")
    (landing / "b.csv").write_text("k,v\n1,2\n")
    (landing / "bad.json").write_text("{")
    (landing / "skip.bin").write_text("x")
    ingest.run_available(spark, str(landing), root)
    (landing / "c.txt").write_text("third")
    (landing / "a.html").write_text("<p>newer text</p>")  # the same document again
    ingest.run_available(spark, str(landing), root, IngestConfig())
    rows = sorted((r["doc_id"], r["text"], r["rows"]) for r in ingest.current_chunks(spark, root).collect())
    assert rows == [("a", "newer text", None), ("b", "k: 1; v: 2", "1-2"), ("c", "third", None)]
    assert {r["doc_id"] for r in spark.read.parquet(f"{root}/chunks/batch=1").collect()} == {"a", "c"}  # a batch writes its own rows
    assert [r["path"].rpartition("/")[2] for r in spark.read.parquet(f"{root}/failures").collect()] == ["bad.json"]
    # two files of one document in a batch: the newer one; documents that come again empty or unreadable have nothing
    for at, (name, text) in enumerate((("e.txt", "older"), ("e.md", "newest"), ("e.log", "old"), ("c.md", " \n"), ("b.json", "{"))):
        (landing / name).write_text(text)
        os.utime(landing / name, (1_700_000_000, 1_700_000_000 + (at if name != "e.log" else 0)))
    ingest.run_available(spark, str(landing), root)
    rows = sorted((r["doc_id"], r["text"]) for r in ingest.current_chunks(spark, root).collect())
    assert rows == [("a", "newer text"), ("e", "newest")]


def test_every_name_of_a_chunk_is_an_entity(spark):
    """Names beyond the eighth become mentions and edges too, each chunk's in their order."""
    from quarry.plans import retrieval

    names = [f"N{a}letter" for a in "abcdefghijkl"]
    docs = spark.createDataFrame([(1, " ".join(names)), (2, f"Abcdef {names[0]}")], "doc_id bigint, text string")

    class Tables:
        def chunks(self):
            return chunking.chunk_documents(chunking.single_blocks(docs))

        def text_queries(self):
            return spark.createDataFrame([(1, "who")], "qid bigint, text string")

    _, _, mentions, edges, entities = retrieval._hybrid_inputs(Tables())
    assert {r["entity_key"] for r in entities.collect()} == {n.lower() for n in names} | {"abcdef"}
    orders = [r["name"] for r in mentions.where("doc_id = '1'").orderBy("ord").collect()]
    assert orders == names
    assert edges.count() == 12


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85, 1.0])
def test_similar_names_against_all_pairs(spark, threshold):
    chance = random.Random(5)
    names = {"".join(chance.choice("abcé ") for _ in range(chance.randint(1, 14))).strip() for _ in range(150)} - {""}
    names |= {f"Supplier#{n:05d}" for n in range(40)} | {"Acme Corp", "ACME corp.", "Acme Corporation", "aa", "aaa", "aaaa"}
    rows = [(n.lower() + "|" + n, n, kind) for n in sorted(names) for kind in ("X", "Y") if kind == "X" or len(n) % 2] + [("z", "Acme Corp", None)]
    found = graph.similar_names(spark.createDataFrame(rows, "entity_key string, name string, type string"), threshold).collect()
    expected = {}
    for (ka, a, ta), (kb, b, tb) in itertools.combinations(sorted(rows), 2):
        r = difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()
        if ta == tb and ta is not None and r >= threshold:
            expected[ka, kb, ta] = round(r, 6)
    assert {(r["a_key"], r["b_key"], r["type"]): r["ratio"] for r in found} == expected
    assert len(found) == len(expected)


def test_shortest_paths_against_all_paths(spark):
    """Of all shortest paths the least by its nodes, over as many hops as are asked for."""
    chance = random.Random(3)
    names = [chance.choice("abcé") + f"{n}" for n in range(40)]
    edges = {tuple(chance.sample(names, 2)) for _ in range(46)}
    near = {n: sorted({b if a == n else a for a, b in edges if n in (a, b)}) for n in names}
    pairs = [(f"{n}", *chance.sample(names, 2)) for n in range(60)] + [("same", names[0], names[0]), ("none", names[0], "nowhere")]
    expected = {}
    for pair, source, target in pairs:
        paths = [[source]] if source != target and source in near and target in near else []
        while paths and pair not in expected and len(paths[0]) <= 6:
            paths = [[*path, other] for path in paths for other in near[path[-1]] if other not in path]
            whole = [path for path in paths if path[-1] == target]
            if whole:
                expected[pair] = (len(whole[0]) - 1, min(whole))
    table, frame = spark.createDataFrame(pairs, "pair_id string, source string, target string"), spark.createDataFrame([*edges], "src_key string, dst_key string")
    for hops in (1, 3, 4, 6):
        found = {r["pair_id"]: (r["hops"], r["path"]) for r in graph.shortest_paths(table, frame, hops).collect()}
        assert found == {pair: x for pair, x in expected.items() if x[0] <= hops}
    assert {x[0] for x in expected.values()} >= {1, 2, 3, 4, 5, 6}


def test_pairs_that_have_met_go_no_further(spark, monkeypatch):
    """What is written of a search doesn't hold the neighbours of a hub for pairs that are next to each other."""
    sizes = []

    def counted(df, label, *by):
        table = written(df, label, *by)
        sizes.append(table.count() if label == "path-level" else 0)
        return table

    monkeypatch.setattr(graph, "written", counted)
    edges = spark.range(1, 500).select(F.format_string("leaf%d", "id").alias("src_key"), F.lit("hub").alias("dst_key"))
    pairs = spark.createDataFrame([("a", "leaf1", "hub"), ("b", "leaf2", "leaf3")], "pair_id string, source string, target string")
    found = {r["pair_id"]: r["path"] for r in graph.shortest_paths(pairs, edges, 4).collect()}
    assert found == {"a": ["leaf1", "hub"], "b": ["leaf2", "hub", "leaf3"]}
    assert 0 < sum(sizes) < 10


def _odd_names():
    chance = random.Random(8)
    names = {"".join(chance.choice("ab ") for _ in range(chance.randint(1, 12))).strip() for _ in range(60)} - {""}
    names |= {f"Supplier#{n:05d}" for n in range(0, 900, 11)} | {f"{'ab' * k}{n}" for k in (3, 5) for n in range(12)} | {"x" * 210 + c for c in "abc"} | {"alone"}
    return [(n.lower() + "|" + n, n, kind) for n in sorted(names) for kind in ("X", "Y") if kind == "X" or len(n) % 2] + [("z", "Acme Corp", None), ("n", None, "X")]


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_similar_classes_against_all_pairs(spark, threshold, monkeypatch):
    """One row per name with the number of its links and its class, from many small blocks."""
    from quarry.operators import names

    monkeypatch.setattr(names, "BLOCK", (4, 16))
    rows = _odd_names()
    links, classes = Counter(), {(k, t): {(k, t)} for k, n, t in rows if t and n}
    for (ka, a, ta), (kb, b, tb) in itertools.combinations(sorted(r for r in rows if r[1] and r[2]), 2):
        if ta == tb and difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() >= threshold:
            links.update([(ka, ta), (kb, tb)])
            whole = classes[ka, ta] | classes[kb, tb]
            classes.update(dict.fromkeys(whole, whole))
    found = graph.similar_classes(spark.createDataFrame(rows, "entity_key string, name string, type string"), threshold).collect()
    assert {(r["entity_key"], r["type"]): (r["class_id"], r["n_links"]) for r in found} == {x: (min(whole)[0], links[x]) for x, whole in classes.items()}
    assert len(found) == len(classes)


def test_names_of_one_pattern_are_dealt_to_several_tasks(spark):
    """Names that differ in digits only used to meet in one task; a row for each link isn't made either."""
    from quarry.operators import names

    rows = spark.range(1500).select(F.format_string("supplier#%09d", "id").alias("entity_key"), F.format_string("Supplier#%09d", "id").alias("name"), F.lit("X").alias("type"))
    sizes = [len(r["a_keys"]) * len(r["b_keys"]) for r in names._block_pairs(rows, 0.85).collect()]
    assert len(sizes) >= 15 and max(sizes) < 500**2
    assert graph.similar_classes(rows, 0.85).count() == 1500


def test_classes_of_long_chains(spark):
    from quarry.operators import names

    edges = [("X", f"{n:03d}", f"{n + 1:03d}") for n in range(40)] + [("X", f"{n:03d}", f"{n - 1:03d}") for n in range(99, 60, -1)] + [("Y", "1", "0")]
    found = {(r["type"], r["entity_key"]): r["class_id"] for r in names._components(spark.createDataFrame(edges, "type string, a string, b string")).collect()}
    assert found == {("X", f"{n:03d}"): "000" if n <= 40 else "060" for n in range(100) if n <= 40 or n >= 60} | {("Y", "1"): "0", ("Y", "0"): "0"}


# --- records of the graph: what is counted where it lies, and chunks of several records -------


def _odd_tables(folder, sf_dir):
    """The small tables with an order, a customer, a part and a supplier listed twice, in two readings."""
    import os

    import duckdb

    db = duckdb.connect()
    odd = {
        "orders": "SELECT * FROM T UNION ALL SELECT * REPLACE ((o_custkey + 7) % 150 AS o_custkey) FROM T WHERE o_orderkey < 40",
        "customer": "SELECT * FROM T UNION ALL SELECT * REPLACE (upper(c_name) AS c_name, (c_nationkey + 3) % 25 AS c_nationkey) FROM T WHERE c_custkey % 10 = 3",
        "part": "SELECT * FROM T UNION ALL SELECT * REPLACE ('old ' || p_name AS p_name) FROM T WHERE p_partkey % 20 = 1",
        "supplier": "SELECT * FROM T UNION ALL SELECT * REPLACE ('Late' || s_name AS s_name) FROM T WHERE s_suppkey = 4",
        "lineitem": "SELECT * FROM T UNION ALL SELECT * FROM T WHERE l_orderkey % 9 = 2",
    }
    for name in ("region", "nation", *odd):
        db.sql(f"COPY ({odd.get(name, 'SELECT * FROM T').replace('FROM T', f'''FROM '{sf_dir}/{name}.parquet' ''')}) TO '{os.path.join(folder, name)}.parquet' (FORMAT parquet)")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(folder, name)}.parquet'")
    return db


def test_graph_of_tables_with_keys_listed_twice(spark, sf_dir, tmp_path):
    """Chunks of several records count once; the paths that spare shuffles give what SQL gives."""
    import __spark_entry__ as entry

    db = _odd_tables(str(tmp_path), sf_dir)
    for name in ("low_evidence", "relation_counts", "appears_in", "graph_expand", "job2_refresh_graph"):
        ours = entry.queries()[name](spark, str(tmp_path))
        columns = [c for c in ours.columns if not c.endswith("_type")]
        theirs = db.sql(entry.oracle_sql()[name])
        if name == "job2_refresh_graph":  # of equal places in the order of arrival SQL leaves open which end came first
            undirected = lambda r: (*sorted(r[:2]), *r[2:])
            columns = ["src_key", "dst_key", "relation", "weight", "n_chunks"]
        else:
            undirected = tuple
        want = sorted(undirected(r) for r in theirs.select(", ".join(f'"{c}"' for c in columns)).fetchall())
        assert sorted(undirected(tuple(r)) for r in ours.select(columns).collect()) == want, name


def test_records_are_not_shuffled_by_chunk(spark, sf_dir):
    """Mentions of chunks with one record are counted without their chunk ids; lines are dealt out once."""
    from quarry.plans.data import Tables

    t = Tables(spark, sf_dir)
    plan = graph.entity_facts(t.stored_mentions().where("alone"), docs=False)._jdf.queryExecution().executedPlan().toString()
    assert "chunk_id" not in plan.split("Union")[0]
    assert t.stored_records().where("not alone").count() == 0 < t.stored_records().count()


def test_selection_takes_texts_slice_by_slice(spark):
    """With the chunks beside them only the slices that are looked at get texts; the rows kept are the same."""
    rows = [(1, n, f"c{n}", f"d{n // 7}", "same words here" if n % 3 else f"a{n} b{n} c{n}") for n in range(1, 60)] + [(2, n, f"c{n}", f"d{n // 7}", f"w{n} v{n}") for n in range(1, 5)]
    ranked = spark.createDataFrame(rows, "qid int, pos int, chunk_id string, doc_id string, text string")
    chunks = spark.createDataFrame([(f"c{n}", f"d{n // 7}", "same words here" if n % 3 else f"a{n} b{n} c{n}") for n in range(1, 60)], "chunk_id string, doc_id string, text string")
    one = ranked.where("qid = 1")
    want = sorted((r["place"], r["chunk_id"]) for r in retrieve.greedy_select(one, 6, first=4).collect())
    got = retrieve.greedy_select(one.drop("doc_id", "text"), 6, first=4, chunks=chunks)
    assert sorted((r["place"], r["chunk_id"]) for r in got.collect()) == want and len(want) == 6 and max(int(c[1:]) for _, c in want) > 4  # beyond the first slice


def test_keywords_of_free_and_bound_questions(spark):
    """A word's chunks beyond the pool stay where they are; questions bound to a document still find theirs."""
    chunks = spark.createDataFrame([(f"c{n:03d}", n % 5, f"common word number{n}") for n in range(40)], "chunk_id string, doc_id int, text string")
    asked = spark.createDataFrame([(1, "common number39", None), (2, "common", "4")], "qid int, text string, doc_filter string")
    got = {(r["qid"], r["chunk_id"]) for r in retrieve.keyword_topk(asked, chunks, 3, pool=4).collect()}
    assert got == {(1, "c000"), (1, "c001"), (1, "c002"), (2, "c004"), (2, "c009"), (2, "c014")}
    plan = retrieve.keyword_topk(asked.drop("doc_filter"), chunks, 3, pool=4)
    assert plan.where("qid = 1").count() == 3


def test_vectors_beyond_the_kth_best_are_not_held(spark):
    """Small blocks of queries and vectors, in any number of batches, give the neighbours of one comparison."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    v, q = rng.integers(-2, 3, (5000, 4)).astype("float32"), rng.integers(-2, 3, (700, 4)).astype("float32")
    asked = pa.table({"qid": pa.array(range(700)), "vec": pa.array(list(q), pa.list_(pa.float32())), "doc_filter": pa.array([None] * 700, pa.string())})
    rows = pa.table({"chunk_id": pa.array(range(5000)), "doc_id": pa.array(["d"] * 5000), "embedding": pa.array(list(v), pa.list_(pa.float32()))})
    got = {}
    for batch in retrieve._nearest(asked, rows.to_batches(3000), 3, 0.0):
        for r in batch.to_pylist():
            got.setdefault(r["qid"], []).append(r["chunk_id"])
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    s = np.round(unit(q.astype(float)) @ unit(v.astype(float)).T, 12)
    assert all(sorted(got[n]) == sorted(np.lexsort((np.arange(5000), -s[n]))[:3].tolist()) for n in range(700))
    assert retrieve.QUERY_BLOCK * retrieve.SCORED_VECTORS * 8 <= 8 << 20


def test_texts_leave_a_task_in_small_batches(spark, monkeypatch):
    """Chunks of texts and visible texts of pages are made a few rows at a time, in the same order."""
    import pyarrow as pa

    from quarry.operators import chunking
    from quarry.sources import parsers

    sizes = []
    real = pa.RecordBatch

    class Seen:
        @staticmethod
        def from_arrays(arrays, names):
            sizes.append(len(arrays[0]))
            return real.from_arrays(arrays, names)

    held = {}

    class Rows:
        """Stands for a table: keeps the function that would run in its tasks."""

        columns = ["doc_id", "text"]
        schema = spark.createDataFrame([], "doc_id bigint, text string").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, shape):
            held["run"] = run

    whole = real.from_pylist([{"doc_id": n, "text": f"<p>text {n}</p>"} for n in range(1000)])
    for module, make in ((chunking, chunking.chunk_blocks), (parsers, parsers.html_texts)):
        make(Rows())
        monkeypatch.setattr(module.pa, "RecordBatch", Seen)
        ids = [i for out in held["run"]([whole]) for i in out.column(0).to_pylist()]
        monkeypatch.undo()
        assert ids == list(range(1000)) and max(sizes) <= 256


def test_replies_of_a_small_table_are_parsed_by_all_cores(spark, sf_dir):
    """The parts lie in one split of a file; their replies don't all come from one task."""
    import __spark_entry__ as entry

    for name in ("parse_relations", "parse_extraction"):
        tasks = entry.queries()[name](spark, sf_dir).select(F.spark_partition_id().alias("n")).distinct().count()
        assert tasks >= spark.sparkContext.defaultParallelism, name


def test_a_reply_is_parsed_once_whatever_is_asked_of_it(spark):
    """What a caller filters, or Spark infers from an explode, stays above the parsing."""
    rows = spark.createDataFrame([("{}",)], "reply string").repartition(2)
    for made in (lambda df: df.select(F.inline("relations")), lambda df: df.select(F.inline("entities")), lambda df: df.where(F.size("relations") > 1)):
        plan = made(extraction.parse_extraction(rows))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_expansion_scores_no_chunk_too_few(spark, monkeypatch, seed):
    """The best chunks, found by bounds from any number of entities, are those of scoring every chunk."""
    rng = random.Random(seed)
    names = [f"e{min(int(rng.expovariate(0.12)), 60):02d}" for _ in range(700)]
    mentions = [(n, n, "DATE" if n == "e03" else "CONCEPT", f"c{rng.randrange(180):03d}", "d", k) for k, n in enumerate(names)]
    edges = [(a, b, "R", rng.choice([1, 1, 1, 2, 5, 40])) for a, b in {tuple(sorted(rng.sample(names, 2))) for _ in range(400)} if a != b]
    seeds = [(q, f"c{rng.randrange(180):03d}") for q in range(6) for _ in range(q + 1)]
    bags = {}
    for m in mentions:
        bags.setdefault(m[3], set()).add(m[0])
    want, reached = set(), 0
    for q in range(6):
        mine = {c for p, c in seeds if p == q}
        own, weight = set().union(*(bags.get(c, set()) for c in mine)), Counter()
        for a, b, _, w in edges:
            for x, y in ((a, b), (b, a)):
                if x in own and y not in own and y != "e03":
                    weight[y] += w
        scores = {c: sum(weight[e] for e in bag) for c, bag in bags.items() if any(e in weight for e in bag)}
        reached += len(scores)
        want |= {(q, c, scores[c], n + 1) for n, c in enumerate(sorted(scores, key=lambda c: (-scores[c], c))[:5])}
    m = spark.createDataFrame(mentions, "entity_key string, name string, type string, chunk_id string, doc_id string, ord bigint")
    e = spark.createDataFrame(edges, "src_key string, dst_key string, relation string, weight bigint")
    s = spark.createDataFrame(seeds, "qid bigint, chunk_id string").distinct()
    for entities in (2, 1000):
        monkeypatch.setattr(graph, "BAR_ENTITIES", entities)
        got = graph.expand(s, m, e, graph.entity_names(m), 5, ("DATE",))
        assert {tuple(r) for r in got.select("qid", "chunk_id", "score", "rank").collect()} == want
    weighed = spark.read.parquet(_session_tables(spark, "chosen-keys")[-1]).select("qid", "chunk_id").distinct().count()
    assert len(want) <= weighed < reached / 2  # not every chunk that is reached


def _session_tables(spark, label):
    from quarry.operators.shared import session_folder

    folder = session_folder(spark).removeprefix("file://")
    return sorted((os.path.join(folder, n) for n in os.listdir(folder) if n.startswith(f"{label}-")), key=os.path.getmtime)


def test_texts_of_their_own_are_numbered_where_they_are_cut(spark):
    """Documents whose ids come once are not shuffled; rows that share an id, or have none, are numbered together."""
    rows = [(1, "one. " * 400), (2, " \n"), (3, "three. " * 300), (3, "other. " * 300), (None, "none. " * 200), (None, "void"), (4, "four")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(map(str, chunking.chunk_documents(chunking.single_blocks(docs)).select("chunk_id", "doc_id", "index").collect()))
    assert sorted(map(str, chunking.chunk_texts(docs).select("chunk_id", "doc_id", "index").collect())) == want
    once = chunking.chunk_texts(docs.where("doc_id in (1, 2, 4)"))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString() and once.count() > 2


def test_no_name_is_too_long_and_no_year_too_odd(spark, sf_dir, tmp_path):
    """Every named field of a record counts, as in SQL; a record without a key is no chunk."""
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    odd = {
        "part": "SELECT * REPLACE (CASE WHEN p_partkey % 20 = 1 THEN repeat('long name ', 12) || p_partkey ELSE p_name END AS p_name) FROM T",
        "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 50 = 1 THEN NULL ELSE o_orderkey END AS o_orderkey, o_orderdate - INTERVAL (CASE WHEN o_orderkey % 50 = 2 THEN 200 WHEN o_orderkey % 50 = 3 THEN -200 ELSE 0 END) YEAR AS o_orderdate) FROM T",
        "lineitem": "SELECT * REPLACE (CASE WHEN l_orderkey % 50 = 1 THEN NULL ELSE l_linenumber END AS l_linenumber) FROM T",
    }
    for name in ("region", "nation", "customer", "supplier", *odd):
        db.sql(f"COPY ({odd.get(name, 'SELECT * FROM T').replace('FROM T', f'''FROM '{sf_dir}/{name}.parquet' ''')}) TO '{tmp_path}/{name}.parquet'")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    theirs = db.sql(entry.oracle_sql()["entity_rollup"])
    columns, want = theirs.columns, sorted(theirs.fetchall())
    assert sorted(map(tuple, entry.queries()["entity_rollup"](spark, str(tmp_path)).select(columns).collect())) == want
    assert any(len(row[0]) > 100 for row in want) and {"1795", "2195"} <= {row[0] for row in want}
