import hashlib
import io
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import media as M
from quarry.llm import urlfilter as U


def test_netpbm_and_bmp_round_trips():
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (4, 3, 3), np.uint8)
    for image in (grey, colour):
        assert (M.decode(M.to_bmp(image)) == image).all()
    assert (M.decode(b"P5 # note\n7 5\n255\n" + grey.tobytes()) == grey).all()
    assert (M.decode(b"P6\n3 4\n255\n" + colour.tobytes()) == colour).all()
    assert (M.decode(b"P2\n7 5\n255\n" + " ".join(map(str, grey.ravel())).encode()) == grey).all()
    assert M.decode(b"P1\n2 2\n10\n01").tolist() == [[0, 255], [255, 0]]
    assert M.decode(b"P4\n3 1\n" + bytes([0b01000000])).tolist() == [[255, 0, 255]]
    assert M.decode(b"P5\n1 1\n65535\n\xff\xff").tolist() == [[255]]


def odd_pictures():
    cut_palette = bytearray(M.to_bmp(np.full((2, 3), 200, np.uint8)))
    cut_palette[46:50] = (100).to_bytes(4, "little")
    narrow = bytearray(M.to_bmp(np.zeros((2, 3), np.uint8)))
    narrow[18:22] = (-3).to_bytes(4, "little", signed=True)
    texts = [
        b"P5 99999999999999999999 2\n255\n", b"P2 1 1 255 99999999999999999999", b"P5 1 1 0 a", b"P5 1 1 70000 a", b"P2 1 1 5 9", b"P5 1 1 5 a", b"P1 2 1 07", b"P2 1 1 255 -5", b"P2 1 1 255 x",
        b"P5 1000000 1000000 255\nabc", b"P4 800 800\nabc", b"P6 1 1 255\nab", b"P3 1 1 255 1 2", b"P5 1" + b"0" * 5000 + b" 1 255 ", b"P5", b"P5 1 1", b"P7 1 1", b"BM", b"BM" + b"\0" * 70, b"", b"GIF89a",
    ]
    return [*texts, bytes(cut_palette), bytes(narrow), M.to_bmp(np.zeros((2, 3), np.uint8))[:-9]]


def test_pictures_that_are_none_give_nulls(spark):
    """Every unreadable picture is a row of nulls beside good ones; one without pixels has no features."""
    bad = odd_pictures()
    good = [M.to_pgm(bytes(range(64)) * 9), b"P5 0 0 255\n", b"P2 1 1 5 5", M.to_pgm(bytes(64) * 70_000)]
    rows = [(i, 0, bytearray(x)) for i, x in enumerate(bad + good)] + [(None, 0, None)]
    got = {r["doc_id"]: r for r in M.tiles(spark.createDataFrame(rows, "doc_id bigint, n_bytes bigint, media binary")).collect()}
    assert len(got) == len(rows)
    for i in [*range(len(bad)), None]:
        assert (got[i]["samples"], got[i]["tile"], got[i]["dhash"]) == (None, None, None), rows[i or 0]
    first, none, one, tall = (got[len(bad) + k] for k in range(4))
    assert first["dhash"] and np.load(io.BytesIO(first["tile"])).shape == (16, 16)
    assert (bytes(none["samples"]), none["tile"], none["dhash"]) == (b"", None, None)
    assert bytes(one["samples"]) == b"\xff" and len(tall["samples"]) == 64 * 70_000


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32 - 1))
def test_area_resize_against_brute_force(h, w, th, tw, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w), np.uint8)
    fine = np.kron(image.astype(float), np.ones((th, tw)))  # every target cell is a whole number of these
    want = fine.reshape(th, h, tw, w).mean(axis=(1, 3))
    assert np.abs(M.area_resize(image, th, tw) - want).max() <= 0.5 + 1e-9


def test_tiles_of_texts(spark):
    rows = [(1, "hello"), (2, ""), (3, None), (1, "hello"), (None, "é" * 100), (5, "x" * 70_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, tile string")
    got = {r["doc_id"]: r for r in M.tiles(M.store_texts(docs)).collect()}
    for doc_id, text in rows:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 or (64 if not data else 0))
        r = got[doc_id]
        assert r["n_bytes"] == len(data) and bytes(r["samples"]) == payload == M.payload_of(data)
        assert bytes(r["media"]) == M.to_pgm(payload)
        assert np.load(io.BytesIO(bytes(r["tile"]))).shape == (16, 16) and len(r["dhash"]) == 16
    bad = spark.createDataFrame([(1, 3, bytearray(b"P9")), (2, 0, None), (3, 0, bytearray(b"P5\n0 0\n255\n"))], "doc_id bigint, n_bytes bigint, media binary")
    assert [r["dhash"] for r in M.tiles(bad).collect()] == [None, None, None]
    assert M.tiles(M.store_texts(docs.limit(0))).count() == 0


def test_media_query(spark, sf_dir):
    from quarry.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op5_media"](spark, sf_dir).collect():
        payload = M.payload_of(texts[r["doc_id"]])
        media = M.to_pgm(payload)
        assert (r["payload_bytes"], r["payload_sha256"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert r["feature"].startswith(M.difference_hash(M.decode(media)))


def brute_judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [None, "", "com/", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?q#f", "https://a.www.example.com/en/", "https://xexample.com/en/1", "http://example.com/en", "ftp://b.net/es/1", "ftp://net/fr/", "x://net?://com/", "http://u:p@h.net:80/fr/", "http://é.net/fr/ü", "http://a..com/", "http://h.org/\nnet/", "a" * 5_000 + "://b.com/" + "y" * 9_000, "http://" + "a." * 200 + "net/es/"]


def test_judge_edge_cases(spark):
    rows = [(n, u, "x") for n, u in enumerate(URLS)] + [(None, "http://com/", "x"), (4, URLS[4], "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule string")
    got = sorted((r["page_id"] if r["page_id"] is not None else -1, r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in U.judge(pages, U.rule_table(spark)).collect())
    want = []
    for n, u, _ in rows:
        h, p, rule, v = brute_judge(u, U.RULES)
        want.append((n if n is not None else -1, h, p, rule or "", v))
    assert got == sorted(want)
    assert U.judge(pages.limit(0), U.rule_table(spark)).count() == 0
    assert {r["verdict"] for r in U.judge(pages, U.rule_table(spark, ())).collect()} == {"allow"}


def test_bloom_never_loses_a_key(spark):
    from pyspark.sql import functions as F

    keys = spark.range(3_000).select(F.concat(F.lit("k"), "id").alias("key"))
    asked = spark.range(30_000).select(F.concat(F.lit("k"), "id").alias("key"))
    hits = U.possible_hits(asked, keys)
    assert hits.join(keys, "key").count() == 3_000
    assert hits.count() < 3_300


def test_urls_query(spark, sf_dir):
    from quarry.llm.queries import QUERIES

    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op7_urls"](spark, sf_dir).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_judge(urls[r["page_id"]], U.RULES)


def test_integral_in_blocks(monkeypatch):
    """Sums in blocks of rows equal those at once, for tall and wide pictures and in colour."""
    rng = np.random.default_rng(4)
    for shape in ((1000, 64), (3, 500), (70, 9, 3), (1, 1)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        whole = M.area_resize(image, 16, 16), M.grey(image)
        monkeypatch.setattr(M, "ROWS_AT_ONCE", 7)
        assert np.array_equal(M.area_resize(image, 16, 16), whole[0]) and np.array_equal(M.grey(image), whole[1])
        monkeypatch.undo()


def test_hosts_of_very_many_labels(spark):
    urls = [(1, "http://" + "a." * 50_000 + "www.example.com/en/x"), (2, "http://" + "a." * 50_000 + "net/es/"), (3, "http://" + "." * 1000 + "/")]
    pages = spark.createDataFrame(urls, "page_id bigint, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge(pages, U.rule_table(spark)).collect()}
    assert got == {1: ("www.example.com/en/", "allow"), 2: ("net/es/", "block"), 3: (None, "allow")}
    assert {r["verdict"] for r in U.judge(pages, U.rule_table(spark, ())).collect()} == {"allow"}
