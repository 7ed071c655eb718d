"""The queries of the corpus operators: ``opN_<name>``(spark, sf_dir), and their SQL where SQL
can express them.  Each applies its operator with production parameters to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, brown, langid, linededup, media, mixing, ordermin, packing, pii, resampling, simhash, urlfilter
from quarry.llm.common import table


def tokenizer_file(name: str) -> tuple[str, str]:
    """Place of a public vocabulary file on this machine, and the public split pattern."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = tokenizer_file("word_bpe_49k.json")
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), path)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.size("dropped_lines").cast("bigint").alias("n_dropped"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(table(spark, sf_dir, "documents"))
    made = media.tiles(stored)
    return made.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("bigint").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "dhash", F.sha2("tile", 256)).alias("feature"),
    )


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (declared language, source as host) and pages (markup, host of the address)."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = langid.fit(docs)
    of_docs = langid.identify(docs, model, ["doc_id"], "lang", F.col("source"))
    of_pages = langid.identify(pages.withColumnRenamed("html", "text"), model, ["page_id"], None, urlfilter.host_of(F.col("url")))
    none = F.lit(None).cast("bigint")
    rest = ("lang_found", "confidence", "accepted")
    return of_docs.select("doc_id", none.alias("page_id"), *rest).unionByName(of_pages.select(none.alias("doc_id"), "page_id", *rest))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(bpe.ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array_join(F.transform("pii_findings", lambda f: f["kind"]), ",")
    return done.select("doc_id", "text", F.size("pii_findings").cast("bigint").alias("n_found"), kinds.alias("kinds"))


def op10_ordermin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprint_documents(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.mix(table(spark, sf_dir, "documents"))
    return planned.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_brown": op2_brown,
    "op3_packing": op3_packing,
    "op4_lines": op4_lines,
    "op5_media": op5_media,
    "op6_langid": op6_langid,
    "op7_urls": op7_urls,
    "op8_bpe": op8_bpe,
    "op9_pii": op9_pii,
    "op10_ordermin": op10_ordermin,
    "op11_mixing": op11_mixing,
    "op12_resampling": op12_resampling,
}

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urlfilter.RULES)

#: The other operators hash, cluster, tokenise or permute in ways that DuckDB's SQL has no functions for.
ORACLE_SQL: dict[str, str] = {
    "op7_urls": f"""WITH rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests)
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (VALUES {_RULES}) r(h, p, v) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) = 1""",
    "op11_mixing": f"""WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
 l AS (SELECT max(level) AS level FROM (SELECT (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w)),
 t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * level) AS target FROM w, l),
 r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS rate,
   ('0x' || substr(sha256('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS draw
   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r""",
    # a byte of a word goes into the crc by one exclusive or and eight shifts
    "op12_resampling": f"""WITH words AS (SELECT 0 AS kind, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM documents
  UNION ALL SELECT 1, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
 bytes AS (SELECT word, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT word FROM words)),
 buckets AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(b, lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1]))),
   lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % {resampling.BUCKETS} AS bucket FROM bytes),
 hits AS (SELECT kind, doc_id, bucket, count(*) AS n FROM words JOIN buckets USING (word) GROUP BY ALL),
 sums AS (SELECT bucket, sum(n) FILTER (kind = 0) AS s, sum(n) FILTER (kind = 1) AS t FROM hits GROUP BY bucket),
 gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + {resampling.BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + {resampling.BUCKETS})::DOUBLE))) AS gain FROM sums),
 weighed AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM hits JOIN gains USING (bucket) WHERE kind = 0 GROUP BY doc_id),
 scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN weighed USING (doc_id)),
 ranked AS (SELECT doc_id, CASE WHEN n <= {resampling.PERCENT} * m // 100 THEN n END AS rank FROM (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS n, count(*) OVER () AS m FROM scored WHERE n_features >= {resampling.LEAST_WORDS}))
SELECT scored.*, rank FROM scored LEFT JOIN ranked USING (doc_id)""",
}
