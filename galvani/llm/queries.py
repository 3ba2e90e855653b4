"""The queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .collocations import mine_phrases
from .common import read
from .decontaminate import find_benchmark_copies
from .fingerprints import near_copies
from .langid import language_digest
from .licenses import license_digest
from .mixing import mix_digest
from .negatives import mine_negatives
from .ngram_join import join_by_ngrams
from .oracles import ORACLE_SQL
from .packing import pack_documents
from .quality import quality_digest
from .secrets import secret_digest
from .substring_dedup import repeated_passages
from .warc import warc_round_trip

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_license_scan": lambda spark, d: license_digest(read(spark, d, "documents")),
    "op2_secret_scan": lambda spark, d: secret_digest(read(spark, d, "documents")),
    "op3_language_id": lambda spark, d: language_digest(read(spark, d, "documents")),
    "op4_quality": lambda spark, d: quality_digest(read(spark, d, "documents"), read(spark, d, "labels")),
    "op5_decontamination": lambda spark, d: find_benchmark_copies(read(spark, d, "documents"), read(spark, d, "benchmark")),
    "op6_packing": lambda spark, d: pack_documents(read(spark, d, "documents")),
    "op7_substring_dedup": lambda spark, d: repeated_passages(read(spark, d, "documents")),
    "op8_winnowing": lambda spark, d: near_copies(read(spark, d, "documents")),
    "op9_warc": lambda spark, d: warc_round_trip(read(spark, d, "pages")),
    "op10_ngram_join": lambda spark, d: join_by_ngrams(read(spark, d, "documents")),
    "op11_mixing": lambda spark, d: mix_digest(read(spark, d, "documents")),
    "op12_hard_negatives": lambda spark, d: mine_negatives(read(spark, d, "embeddings")),
    "op13_collocations": lambda spark, d: mine_phrases(read(spark, d, "documents")),
}
