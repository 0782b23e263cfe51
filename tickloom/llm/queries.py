"""The registered training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bytecnn, clusters, codes, fertility, katz, merkle, mixing, packing, pii, repeats, sharding, simhash, store
from .common import spread


def documents(spark: SparkSession, sf_dir: str, python: bool = True) -> DataFrame:
    """The whole table; for operators whose work is in Python on all cores, however the file is split."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spread(docs) if python else docs


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table, on all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id, fp_copies for every document: radius 2, shingles of 3 words."""
    return simhash.near_duplicates(documents(spark, sf_dir), words=3, radius=2, seed=42)


def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document."""
    return merkle.against_edits(documents(spark, sf_dir, python=False))


def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document; fold 2 of 7 is held out."""
    return katz.score(documents(spark, sf_dir), folds=7, fold=2)


def op4_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, n_tokens, chars_per_token, byte_share, token_entropy for every document."""
    return fertility.score(documents(spark, sf_dir))


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, bytes, key, depth, shard, shard_bytes, shard_docs for every document: shards of at most 4 MiB."""
    return sharding.shard(documents(spark, sf_dir, python=False), 4 << 20)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece: sequences of at most 4096 tokens."""
    return packing.pack(documents(spark, sf_dir), capacity=4096, end_id=1)


def op7_bilstm_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every document."""
    return pii.scan(documents(spark, sf_dir))


def op8_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified for every document, read back from the store's files."""
    return store.write_and_verify(documents(spark, sf_dir), end_id=2)


def op9_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every document."""
    return mixing.mix(documents(spark, sf_dir, python=False), seed=42)


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; fitted on at most 1200 documents of each label outside the held-out fold."""
    docs = documents(spark, sf_dir)
    net = bytecnn.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), bytecnn.Sample(documents=1200, chunks=12))
    return bytecnn.score(docs, net, threshold=0.3)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every whole vector: 8 parts, 16 entries each, 6 rounds."""
    return codes.digest(*codes.compress(embeddings(spark, sf_dir), parts=8, entries=16, many=6, scale=4096))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document: strings of 50 bytes that a document with a smaller id has too are removed."""
    return repeats.digest(repeats.remove_repeats(documents(spark, sf_dir), length=50))


def op13_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector of 64 components: 16 centroids, 3 rounds."""
    return clusters.digest(*clusters.cluster(embeddings(spark, sf_dir), centroids=16, many=3, scale=64, dims=64))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_merkle": op2_merkle,
        "op3_katz_backoff": op3_katz_backoff,
        "op4_fertility_rules": op4_fertility_rules,
        "op5_extendible_shards": op5_extendible_shards,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_bilstm_pii": op7_bilstm_pii,
        "op8_content_store": op8_content_store,
        "op9_systematic_mix": op9_systematic_mix,
        "op10_byte_cnn": op10_byte_cnn,
        "op11_vector_codes": op11_vector_codes,
        "op12_suffix_dedup": op12_suffix_dedup,
        "op13_exponion_clusters": op13_exponion_clusters,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_extendible_shards": sharding.oracle(4 << 20),
        "op9_systematic_mix": mixing.oracle(42),
        "op11_vector_codes": codes.oracle(),
        "op12_suffix_dedup": repeats.oracle(50),
        "op13_exponion_clusters": clusters.oracle(),
    }
