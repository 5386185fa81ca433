"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caregrid.llm import alignment, ann, id_files, langid, license_scan, line_dedup, mixing, packing, periodic, pii, simhash, topk, toxicity
from caregrid.llm.common import read, stored


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = pii.find(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind_order"] + 1), s["start"], s["end"])), ",")

    def count(i, kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind_order"] == i))).cast("long").alias(f"n_{kind}")

    counts = [count(i, k) for i, k in enumerate(pii.KINDS)]
    return f.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = license_scan.scan(read(spark, sf_dir, "documents"))
    base = F.filter("hits", lambda h: h["phrase"])
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    start = F.transform(base, lambda h: h["start"])
    return s.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
                    labels(base).alias("base_labels"), labels(F.col("hits")).alias("labels"), "score")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = langid.identify(read(spark, sf_dir, "documents"))
    return p.select("doc_id", (langid.fold() == langid.HELD_OUT).alias("held_out"), "lang_pred", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(read(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.near_groups(read(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.plan(stored(mixing.sized(read(spark, sf_dir, "documents")), "mix-sizes"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    s = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return s.select("doc_id", (toxicity.fold() == toxicity.HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.deduplicated(read(spark, sf_dir, "documents"))
    return d.select("doc_id", "__lines.n_lines", "__lines.n_dropped", F.sha2("__lines.kept", 256).alias("kept_sha256"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by the checksum h of its id goes on, from a word a, with p words over and over."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.floor(h / 10).alias("g"),
                    F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")).alias("words"))
    n = F.when(F.size("words") > 0, F.size("words"))
    d = d.withColumn("a", (F.col("g") % n).cast("int"))
    d = d.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = n - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest)), " ")
    return d.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = periodic.find_runs(with_repeats(read(spark, sf_dir, "documents")))
    r = r.withColumn("top", periodic.strongest())
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    return r.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
                    F.expr("top.length * 1000 div top.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    folder = id_files.write_ids(read(spark, sf_dir, "documents"), lambda: packing.encoder(path))
    return id_files.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
    rows, _ = alignment.align(read(spark, sf_dir, "documents"), lambda: alignment.byte_level(a), lambda: alignment.sentence_pieces(b), digest=True)
    return rows.withColumnRenamed("groups", "groups_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_pii, op2_license, op3_packing, op4_langid, op5_simhash, op6_ann, op7_mixing, op8_topk, op9_toxicity, op10_line_dedup,
        op11_periodic, op12_token_files, op13_alignment, pipeline)}

SQL: dict[str, str] = {
    "op8_topk": """
WITH v AS (SELECT DISTINCT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
           WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 40 GROUP BY key
      HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND (doc_id IS NULL OR doc_id < largest) AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r""",
}
