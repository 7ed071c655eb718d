"""The jobs: two runs over growing input, runs that break off, and reruns that change nothing."""

import collections
import hashlib
import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import ingest_documents, refresh_graph, settings
from quarry.functions import text as T
from quarry.operators import chunking, graphstore, textindex
from quarry.streaming import batches

SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def files_under(spark, folder):
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length").collect()
    return {(r["path"], r["length"]) for r in rows if "/checkpoint/" not in r["path"]}


def add(spark, folder, rows):
    spark.createDataFrame([(d, t, lang, source, len(t or "")) for d, t, lang, source in rows], SHAPE).coalesce(1).write.mode("append").parquet(folder)


def expected(spark, rows):
    """The catalogue of what rows (in order of arrival) leave."""
    last = {d: (t, lang, source) for d, t, lang, source in rows if d is not None and (t or "").strip()}
    docs = spark.createDataFrame([(d, t) for d, (t, _, _) in last.items()], "doc_id bigint, text string")
    cut = chunking.chunk_documents(chunking.single_blocks(docs)).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n")).collect()
    n_chunks, n_words = collections.Counter(r["doc_id"] for r in cut), collections.Counter()
    for r in cut:
        n_words[r["doc_id"]] += r["n"]
    least = {}
    for d, (t, _, _) in last.items():
        least[t] = min(d, least.get(t, d))
    return {(d, source, lang, hashlib.sha256(t.encode()).hexdigest(), n_chunks[d], n_words[d], least[t] if least[t] != d else None) for d, (t, lang, source) in last.items()}


FIRST = [(1, "alpha beta. " * 150, "en", "s1"), (2, "gamma delta", "en", "s2"), (3, "alpha beta. " * 150, "de", None), (None, "no id", "en", "s1"), (4, "  \n", "en", "s1"), (5, None, "en", "s1"), (6, "to be replaced " * 90, "fr", "s2")]
SECOND = [(6, "new text of six", "fr", "s3"), (7, "gamma delta", None, "s1"), (8, "last one. " * 200, "en", "s1"), (2, "gamma delta", "en", "s2"), (9, "", "en", "s1")]


def test_documents_arrive_in_two_runs(spark, tmp_path):
    config = ingest_documents.Settings(documents=f"{tmp_path}/documents.parquet", output=f"{tmp_path}/store", buckets=8)
    add(spark, config.documents, FIRST)
    got = {tuple(r) for r in ingest_documents.run(spark, config).collect()}
    assert got == expected(spark, FIRST)
    before = files_under(spark, config.output)
    add(spark, config.documents, SECOND)
    got = {tuple(r) for r in ingest_documents.run(spark, config).collect()}
    assert got == expected(spark, FIRST + SECOND)
    after = files_under(spark, config.output)
    assert before < after and all("/batch=1/" in path for path, _ in after - before)  # only what is new was written
    rejected = [tuple(r) for r in spark.read.parquet(f"{config.output}/rejected").select("batch", "doc_id", "reason").collect()]
    assert sorted(rejected, key=str) == sorted([(0, None, "no id"), (0, 4, "blank text"), (0, 5, "blank text"), (1, 9, "blank text")], key=str)
    # chunks and postings are those of the current texts
    docs = spark.createDataFrame([(d, t) for d, t, *_ in [*FIRST[:3], *SECOND[:4]]], "doc_id bigint, text string").dropDuplicates()
    want = chunking.chunk_documents(chunking.single_blocks(docs))
    chunks = batches.current(spark, config.output, "chunks").select("chunk_id", "doc_id", "index", "text")
    assert {tuple(r) for r in chunks.collect()} == {tuple(r) for r in want.select("chunk_id", "doc_id", "index", "text").collect()}
    postings = batches.current(spark, config.output, "postings").select("token", "chunk_id")
    assert collections.Counter(map(tuple, postings.collect())) == collections.Counter(map(tuple, textindex.postings(want).select("token", "chunk_id").collect()))
    ingest_documents.run(spark, config)
    assert files_under(spark, config.output) == after


def test_of_two_rows_in_a_batch_the_newer_file_counts(spark, tmp_path):
    config = ingest_documents.Settings(documents=f"{tmp_path}/documents.parquet", output=f"{tmp_path}/store")
    add(spark, config.documents, [(1, "older", "en", "a"), (1, "older", "en", "a")])
    add(spark, config.documents, [(1, "newer", "en", "b")])
    got = ingest_documents.run(spark, config).collect()
    assert [(r["doc_id"], r["source"], r["content_hash"]) for r in got] == [(1, "b", hashlib.sha256(b"newer").hexdigest())]


def test_a_batch_that_breaks_off_is_repeated(spark, tmp_path, monkeypatch):
    config = ingest_documents.Settings(documents=f"{tmp_path}/documents.parquet", output=f"{tmp_path}/store", files_per_batch=1)
    add(spark, config.documents, FIRST)
    ingest_documents.run(spark, config)
    add(spark, config.documents, SECOND)
    real = batches.write

    def failing(rows, root, table, number, *by):
        if table == "documents":
            raise OSError("the disk is gone")
        real(rows, root, table, number, *by)

    monkeypatch.setattr(batches, "write", failing)
    with pytest.raises(Exception, match="disk is gone"):
        ingest_documents.run(spark, config)
    schema = spark.read.parquet(config.documents).schema
    assert {tuple(r) for r in ingest_documents.catalogue(spark, config, schema).collect()} == expected(spark, FIRST)
    monkeypatch.setattr(batches, "write", real)
    got = {tuple(r) for r in ingest_documents.run(spark, config).collect()}
    assert got == expected(spark, FIRST + SECOND)


def test_nothing_to_ingest(spark, tmp_path):
    config = ingest_documents.Settings(documents=f"{tmp_path}/documents.parquet", output=f"{tmp_path}/store")
    add(spark, config.documents, [])
    assert ingest_documents.run(spark, config).collect() == []


# --- graph ---------------------------------------------------------------------------------


def copy_tables(spark, sf_dir, folder, most):
    for name in refresh_graph.TABLES:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        key = {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(name)
        (rows.where(F.col(key) <= most) if key else rows).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_graph_grows_with_the_orders(spark, sf_dir, tmp_path, monkeypatch):
    tables = f"{tmp_path}/tables"
    config = refresh_graph.Settings(tables=tables, output=f"{tmp_path}/graph", compact_every=3)
    whole = sorted(map(tuple, refresh_graph.run(spark, refresh_graph.Settings(tables=sf_dir, output=f"{tmp_path}/whole")).collect()))
    keys = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").collect())
    sizes = []
    for number, share in enumerate((0.2, 0.5, 0.6, 1.0)):
        copy_tables(spark, sf_dir, tables, keys[int(share * len(keys)) - 1])
        if number == 1:  # this run breaks off before its mark and is repeated
            monkeypatch.setattr(graphstore, "_finish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                refresh_graph.run(spark, config)
            monkeypatch.undo()
            assert refresh_graph.graph(spark, config).count() == sizes[0]
        got = refresh_graph.run(spark, config)
        sizes.append(got.count())
        assert graphstore.last(spark, config.output) == (number, str(keys[int(share * len(keys)) - 1]))
    assert sizes == sorted(sizes) and sorted(map(tuple, got.collect())) == whole
    assert graphstore.last(spark, config.output, "base")[0] == 2
    seen = files_under(spark, config.output)
    assert sorted(map(tuple, refresh_graph.run(spark, config).collect())) == whole
    assert files_under(spark, config.output) == seen


def test_settings_come_from_file_and_command_line(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"documents": "a", "chunk_size": 100}))
    got = settings.load(spark, ingest_documents.Settings, f"file://{tmp_path}/c.json", {"output": "b", "chunk_size": None, "buckets": 3})
    assert got == ingest_documents.Settings(documents="a", output="b", chunk_size=100, buckets=3)
    with pytest.raises(TypeError):
        settings.load(spark, ingest_documents.Settings, None, {"unknown": 1})
    for job in (ingest_documents, refresh_graph):
        with pytest.raises(ValueError):
            job.run(spark, job.Settings())
    for name, kind in (("ingest_documents", ingest_documents.Settings), ("refresh_graph", refresh_graph.Settings)):
        settings.load(spark, kind, f"{settings.__file__.rsplit('/', 1)[0]}/{name}.json", {})


def test_command_line(tmp_path, sf_dir):
    """The job as it is run from a shell, with its own session."""
    out = subprocess.run(
        [sys.executable, "-m", "jobs.refresh_graph", "--tables", sf_dir, "--output", f"{tmp_path}/graph"],
        capture_output=True, text=True, timeout=300, cwd=settings.__file__.rsplit("/jobs/", 1)[0],
    )
    assert out.returncode == 0, out.stderr[-2000:]
    assert "batch 0: orders above -1" in out.stderr and (tmp_path / "graph" / "marks").is_dir()


def test_texts_of_different_ids_are_not_dealt_out_by_id(spark, tmp_path, monkeypatch):
    """Only documents whose id comes more than once in a batch are brought together."""
    config = ingest_documents.Settings(documents=f"{tmp_path}/documents.parquet", output=f"{tmp_path}/store", buckets=8)
    add(spark, config.documents, [(1, "alpha beta. " * 150, "en", "s1"), (2, "gamma", "en", "s2"), (2, "delta " * 300, "de", "s2"), (None, "no id", "en", "s1")])
    brought = []
    real = batches.latest_of_each
    monkeypatch.setattr(batches, "latest_of_each", lambda rows, *by: brought.append({r["doc_id"] for r in rows.select("doc_id").collect()}) or real(rows, *by))
    assert {r["doc_id"] for r in ingest_documents.run(spark, config).collect()} == {1, 2}
    add(spark, config.documents, [(3, "epsilon", "en", "s1"), (4, "zeta. " * 300, "en", "s1")])
    ingest_documents.run(spark, config)
    assert brought == [{2}]


def test_ids_of_postings_are_made_after_they_were_dealt_out(spark):
    docs = spark.createDataFrame([(n, f"word{n % 7} common. " * (50 * n)) for n in range(1, 12)], "doc_id bigint, text string")
    chunks = chunking.chunk_texts(docs)
    made = textindex.numbered_postings(chunks, 8)
    assert collections.Counter(map(tuple, made.collect())) == collections.Counter(map(tuple, textindex.postings(chunks, 8).select(made.columns).collect()))
    dealt = made._jdf.queryExecution().optimizedPlan().toString().partition("RebalancePartitions")
    assert "sha1" in dealt[0] and "sha1" not in dealt[2].partition("MapInArrow")[0]
