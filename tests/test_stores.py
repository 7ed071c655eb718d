"""Graph and keyword index kept up batch by batch, against roll-ups of everything."""

import json
import random
import time

from pyspark.sql import functions as F

from quarry.operators import graphstore, store, textindex
from quarry.streaming import ingest
from quarry.streaming.progress import EVENTS, StreamProgress

MENTIONS = "entity_key string, name string, type string, chunk_id string, doc_id string, ord bigint"
EVIDENCE = "src_key string, relation string, dst_key string, chunk_id string, ord bigint"


def made_batches(rng, n):
    """(mentions, evidence, replaced documents) of each batch; documents may come again."""
    out, known = [], []
    for number in range(n):
        docs = [f"d{number}-{i}" for i in range(4)] + (rng.sample(known, 2) if len(known) > 3 else [])
        mentions, evidence = [], []
        for doc in docs:
            for c in range(rng.randint(0, 3)):
                chunk = f"{doc}:{c}"
                keys = rng.choices("abcdefgh", k=rng.randint(1, 5))
                for k in keys:
                    mentions.append((k, rng.choice([k, k.upper()]), rng.choice(["CONCEPT", "CONCEPT", "PERSON", "EVENT"]), chunk, doc, len(mentions)))
                for _ in range(rng.randint(0, 4)):
                    a, b = rng.choice("abcdefghz"), rng.choice("abcdefgh")
                    if a != b:
                        evidence.append((a, rng.choice(["R", "S"]), b, chunk, len(evidence)))
        out.append((mentions, evidence, [d for d in docs if d in known]))
        known += [d for d in docs if d not in known]
    return out


def plain_graph(made):
    """What stands after all batches, rolled up in order of arrival."""
    rows, ties = [], []
    for number, (mentions, evidence, replaced) in enumerate(made):
        gone = {r[4] for r in rows if r[5] in replaced}
        rows = [r for r in rows if r[5] not in replaced]
        ties = [t for t in ties if t[4] not in gone]
        rows += [(number, *m[:3], m[3], m[4], m[5]) for m in mentions]
        ties += [(number, *e[:3], e[3], e[4]) for e in evidence]
    rows.sort(key=lambda r: (r[0], r[6]))
    ties.sort(key=lambda t: (t[0], t[5]))
    entities, edges = {}, {}
    for _, key, name, kind, chunk, _, _ in rows:
        e = entities.setdefault(key, [name, None, set()])
        e[1] = e[1] or (kind if kind != "CONCEPT" else None)
        e[2].add(chunk)
    for _, src, relation, dst, chunk, _ in ties:
        e = edges.setdefault((min(src, dst), max(src, dst), relation), [src, dst, 0, set()])
        e[2] += 1
        e[3].add(chunk)
    return (
        {(k, name, kind or "CONCEPT", len(chunks)) for k, (name, kind, chunks) in entities.items()},
        {(s, d, key[2], w, len(chunks)) for key, (s, d, w, chunks) in edges.items() if s in entities and d in entities},
    )


def test_graph_of_batches_equals_the_whole(spark, tmp_path):
    rng = random.Random(4)
    made = made_batches(rng, 6)
    root = f"{tmp_path}/graph"
    for number, (mentions, evidence, replaced) in enumerate(made):
        rows = [spark.createDataFrame(mentions, MENTIONS), spark.createDataFrame(evidence, EVIDENCE)]
        again = spark.createDataFrame([(d,) for d in replaced], "doc_id string") if replaced else None
        for _ in range(2 if number == 3 else 1):  # a finished batch that comes again changes nothing
            graphstore.add_batch(spark, root, number, *rows, replaced=again)
        if number in (2, 4):
            assert graphstore.compact(spark, root) == number
        entities, edges = plain_graph(made[: number + 1])
        assert {tuple(r) for r in graphstore.entities(spark, root).collect()} == entities
        assert {tuple(r) for r in graphstore.edges(spark, root).collect()} == edges
    assert any(replaced for *_, replaced in made)


def test_unfinished_batches_are_not_seen(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/graph"
    empty = spark.createDataFrame([], MENTIONS), spark.createDataFrame([], EVIDENCE)
    assert graphstore.entities(spark, root).count() == graphstore.edges(spark, root).count() == 0
    assert graphstore.compact(spark, root) == -1
    graphstore.add_batch(spark, root, 0, *empty)
    one = spark.createDataFrame([("a", "A", "PERSON", "c", "d", 0)], MENTIONS)
    with monkeypatch.context() as m:
        m.setattr(graphstore, "_finish", lambda *_: None)
        graphstore.add_batch(spark, root, 1, one, empty[1])
    assert graphstore.last(spark, root)[0] == 0 and graphstore.entities(spark, root).count() == 0
    graphstore.add_batch(spark, root, 1, one, empty[1], mark="x")
    assert graphstore.last(spark, root) == (1, "x") and graphstore.entities(spark, root).count() == 1


def test_index_reads_the_buckets_of_its_words(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("chunk_id"), "text")
    textindex.postings(docs).write.partitionBy("bucket").parquet(f"{tmp_path}/postings")
    index = spark.read.parquet(f"{tmp_path}/postings")
    words = [r["token"] for r in textindex.words_of(docs).select("token").distinct().orderBy("token").limit(2000).collect()]
    for asked in (words[:3], words, ["nowhere-to-be-found"], []):
        terms = spark.createDataFrame([(w,) for w in asked], "token string")
        found = textindex.lookup(index, terms)
        want = textindex.words_of(docs).join(terms, "token", "left_semi")
        assert sorted(map(tuple, found.select("token", "chunk_id").collect())) == sorted(map(tuple, want.select("token", "chunk_id").collect()))
    few = textindex.lookup(index, spark.createDataFrame([(words[0],)], "token string"))
    scan = next(line for line in few._jdf.queryExecution().explainString(few.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n") if "PartitionFilters" in line)
    assert "bucket" in scan  # folders of other buckets are left out
    got = {r["token"]: (r["n_chunks"], r["n_docs"]) for r in textindex.frequencies(index).collect()}
    assert got == {r["token"]: (r["n"], r["n"]) for r in textindex.words_of(docs).groupBy("token").agg(F.count("*").alias("n")).collect()}


def test_progress_and_cancelling_of_a_stream(spark, tmp_path):
    """Every batch is noted with its rows; a run that is cancelled ends early and the next one finishes the rest."""
    landing, root = tmp_path / "in", f"{tmp_path}/out"
    landing.mkdir()
    for n in range(5):
        (landing / f"f{n}.txt").write_text(f"text {n}")
    listener = StreamProgress()
    spark.streams.addListener(listener)
    try:
        asked = []
        ingest.run_available(spark, f"{landing}", root, cancelled=lambda: asked.append(1) or len(asked) > 1, files_per_batch=1)
        first = ingest.batches.current_documents(spark, root, spark.createDataFrame([], "doc_id string, path string").schema).count()
        assert first < 5  # five batches take longer than asking twice
        ingest.run_available(spark, f"{landing}", root, files_per_batch=1)
        for _ in range(50):  # events come on a thread of their own
            if sum(e[1] == "done" for e in listener.events) == 2:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sorted(r["text"] for r in ingest.current_chunks(spark, root).collect()) == [f"text {n}" for n in range(5)]
    kinds = [e[1] for e in listener.events]
    assert kinds.count("done") == 2 and kinds[0] == "processing"
    batches_seen = [json.loads(e[2]) for e in listener.events if e[2] and "batch" in json.loads(e[2])]
    assert {b["batch"] for b in batches_seen if b["rows"]} >= {4} and all(b["seconds"] >= 0 for b in batches_seen)
    listener.save(spark, f"{tmp_path}/jobs")
    saved = spark.read.schema(EVENTS).json(f"{tmp_path}/jobs")
    assert [(r["job_id"], r["status"]) for r in store.latest_status(saved).collect()] == [(f"ingest of {landing}", "done")]
    assert not listener.events
