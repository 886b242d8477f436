"""The registered queries of this subpackage and their SQL, over the given tables."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import compression, decontaminate, fm, language, lexical, licenses, mixing, ngram, oracles, prefixtrie, simhash, textcnn, topk, warc
from foldwise.llm.common import crc_bucket, table


def op1_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component (2 bits, 3-word shingles) of every document."""
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return groups.select("doc_id", "fingerprint", "component_id")


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, compression ratios and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "whole_ratio", "chunk_ratio", "band"]
    return compression.compression_rules(docs, out="r").select("doc_id", *[F.col(f"r.{n}").alias(n) for n in names])


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix of sources (targets: square roots of the document counts)."""
    mixed = mixing.pfair_mix(table(spark, sf_dir, "documents").select("doc_id", "source"), out="m")
    return mixed.select("doc_id", "source", "m.block", "m.release", "m.deadline", "m.slot", "m.position")


def op4_text_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = textcnn.train_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = textcnn.toxicity_scores(docs, model, out="t")
    return scored.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "t.score", "t.predicted", "t.language_threshold", "t.flagged")


def op5_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and of every page, from text, declared markup language, address suffix and host.

    Documents have a doc_id, pages a page_id; a document's source stands for its host.  Text likelihoods are learnt
    from the documents' lang outside the held-out remainder."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language.train_text_model(docs)
    none = lambda kind: F.lit(None).cast(kind)
    rows = docs.select("doc_id", none("bigint").alias("page_id"), "text", none("string").alias("html"), none("string").alias("url"), "source").unionByName(
        pages.select(none("bigint").alias("doc_id"), "page_id", none("string").alias("text"), F.coalesce("html", F.lit("")).alias("html"), "url", none("string").alias("source")))
    found = language.language_fusion(rows, model, text="text", markup="html", url="url", host="source", out="l")
    return found.select("doc_id", "page_id", "l.language", F.round("l.posterior", 6).alias("posterior"), "l.text_language", "l.declared", "l.host", "l.n_words", "l.kept")


def op6_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the bigram model of the training rows."""
    return ngram.lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and detections of every document."""
    scan = licenses.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), out="s")
    base, found = F.col("s.base"), F.col("s.detections")
    starts = F.transform(base, lambda d: d["first"].cast("bigint"))
    return scan.select("doc_id", "s.n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                       licenses.label_list(base).alias("base_labels"), licenses.label_list(base, found).alias("labels"), F.col("s.score").alias("score"))


def op8_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to zstandard WARC archives and read back from them."""
    directory, manifest = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    records = warc.read_archives(spark, directory, manifest)
    sound = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat(F.col("archive"), F.lit(": "), F.col("error"))))
    return records.select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words found in every document."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs, items, out="c")
    return found.select("doc_id", "c.n_words", "c.n_hit", F.size("c.items").cast("bigint").alias("n_items"),
                        decontaminate.items_digest(F.col("c.items")).alias("items_sha256"), "c.contaminated")


def op10_factor_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = fm.train_quality(docs, table(spark, sf_dir, "labels"))
    scored = fm.quality_scores(docs, model, out="q")
    return scored.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "q.score", "q.predicted")


def op11_term_at_a_time_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors by integer inner product for every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, topk.queries_by_id(vectors, every=50), k=5)


def op12_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return lexical.lexical_search(docs, items, k=10)


def op13_double_array_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie over the rebuilt conversations."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefixtrie.prefix_trie(prefixtrie.rebuilt(prefixtrie.conversations(turns)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over documents, stage by stage."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash_bk_tree, op2_compression_bands, op3_pfair_mix, op4_text_cnn, op5_language_fusion, op6_elias_fano_lm, op7_license_rules, op8_zstd_warc, op9_benchmark_decontamination, op10_factor_machine, op11_term_at_a_time_topk, op12_max_sketch_search, op13_double_array_trie, pipeline)}

ORACLES = {"op7_license_rules": oracles.licenses_sql(), "op8_zstd_warc": oracles.WARC_SQL, "op9_benchmark_decontamination": oracles.CONTAMINATION_SQL,
           "op11_term_at_a_time_topk": oracles.TOPK_SQL, "op12_max_sketch_search": oracles.LEXICAL_SQL, "op13_double_array_trie": oracles.TRIE_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
