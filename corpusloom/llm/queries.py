"""The queries over whole tables, their SQL where DuckDB can express it, and the pipeline."""

from __future__ import annotations

from corpusloom.llm.common import Scratch, table
from corpusloom.llm import clusters, decontamination, fingerprints, near_dup, repeats, repetition, sharding, snapshots
from corpusloom.llm.clusters import cluster_vectors
from corpusloom.llm.decontamination import find_contamination
from corpusloom.llm.fingerprints import fingerprint_documents
from corpusloom.llm.language import identify_language
from corpusloom.llm.licenses import scan_licenses
from corpusloom.llm.near_dup import near_duplicates
from corpusloom.llm.packing import pack
from corpusloom.llm.quality import gumbel_top_k, score_quality
from corpusloom.llm.repeats import remove_repeats
from corpusloom.llm.repetition import judge_repetition
from corpusloom.llm.sharding import shard_documents
from corpusloom.llm.snapshots import later_snapshot, snapshot_difference
from corpusloom.llm.token_counts import count_tokens


def op1_language_id(spark, sf_dir):
    return identify_language(spark, table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(spark, table(spark, sf_dir, "documents")).drop("text_hash")


def op3_decontamination(spark, sf_dir):
    return find_contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


def op4_suffix_array_dedup(spark, sf_dir):
    return remove_repeats(spark, table(spark, sf_dir, "documents"))


def op5_sharding(spark, sf_dir):
    return shard_documents(spark, table(spark, sf_dir, "documents"))


def op6_fingerprints(spark, sf_dir):
    return fingerprint_documents(spark, table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return pack(spark, table(spark, sf_dir, "documents"))


def op8_license_scans(spark, sf_dir):
    return scan_licenses(spark, table(spark, sf_dir, "documents")).drop("hits")


def op9_quality_classifier(spark, sf_dir):
    scored = Scratch(spark).put(score_quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return gumbel_top_k(scored, 0.5)


def op10_token_counts(spark, sf_dir):
    return count_tokens(spark, table(spark, sf_dir, "documents"))


def op11_snapshot_difference(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return snapshot_difference(spark, docs, later_snapshot(docs))


def op12_centroid_clustering(spark, sf_dir):
    return cluster_vectors(spark, table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark, sf_dir):
    return judge_repetition(spark, table(spark, sf_dir, "documents")).drop("longest", "spans")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_minhash_near_dedup, op3_decontamination, op4_suffix_array_dedup, op5_sharding, op6_fingerprints, op7_packing, op8_license_scans, op9_quality_classifier, op10_token_counts, op11_snapshot_difference, op12_centroid_clustering, op13_quality_rules)}
ORACLE: dict[str, str] = {"op2_minhash_near_dedup": near_dup.SQL, "op3_decontamination": decontamination.SQL, "op4_suffix_array_dedup": repeats.SQL, "op5_sharding": sharding.SQL, "op6_fingerprints": fingerprints.SQL, "op11_snapshot_difference": snapshots.SQL, "op12_centroid_clustering": clusters.SQL, "op13_quality_rules": repetition.SQL}
