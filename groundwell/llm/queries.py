"""The dealt operators over the given tables, one query each."""

from pyspark.sql import DataFrame, SparkSession

from groundwell.llm.block_naming import exact_groups
from groundwell.llm.histogram_packing import pack, packing_digest
from groundwell.llm.hyperdimensional import language_of
from groundwell.llm.importance_resampling import resample, resampling_digest
from groundwell.llm.kd_shards import metadata_shards
from groundwell.llm.ngram_trie import score_documents
from groundwell.llm.periodic_runs import find_runs, runs_digest
from groundwell.llm.positional_index import decontaminate
from groundwell.llm.positive_unlabelled import score_toxicity
from groundwell.llm.sentence_rules import license_digest, license_scan
from groundwell.llm.swap_packing import pack as pack_by_swaps
from groundwell.llm.swap_packing import packing_digest as swap_digest
from groundwell.llm.vantage_points import near_groups
from groundwell.llm.weak_labels import score_quality

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentence_rules(spark, sf_dir):
    return license_digest(license_scan(table(spark, sf_dir, "documents")))


def op2_ngram_trie(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))


def op3_positive_unlabelled(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_block_naming(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


def op5_vantage_points(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents")).drop("uid")


def op6_kd_shards(spark, sf_dir):
    return metadata_shards(table(spark, sf_dir, "documents"))


def op7_hyperdimensional(spark, sf_dir):
    return language_of(table(spark, sf_dir, "documents"))


def op8_weak_labels(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"))


def op9_positional_index(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_histogram_packing(spark, sf_dir):
    return packing_digest(pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op11_suffix_runs(spark, sf_dir):
    return runs_digest(find_runs(table(spark, sf_dir, "documents"), tails=True))


def op12_swap_packing(spark, sf_dir):
    return swap_digest(pack_by_swaps(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER)))


def op13_importance_resampling(spark, sf_dir):
    return resampling_digest(resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentence_rules,
        op2_ngram_trie,
        op3_positive_unlabelled,
        op4_block_naming,
        op5_vantage_points,
        op6_kd_shards,
        op7_hyperdimensional,
        op8_weak_labels,
        op9_positional_index,
        op10_histogram_packing,
        op11_suffix_runs,
        op12_swap_packing,
        op13_importance_resampling,
    )
}
