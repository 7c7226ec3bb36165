"""The queries of this subpackage and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.divergence import OP13_SQL, op13_divergence
from tidemark.llm.fingerprints import op9_rare_features
from tidemark.llm.language import op3_language
from tidemark.llm.merges import op6_merge_replay
from tidemark.llm.ngram_join import op4_ngram_join
from tidemark.llm.packing import op7_curve_packing
from tidemark.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from tidemark.llm.records import op1_token_records
from tidemark.llm.secrets import op5_secrets
from tidemark.llm.suffix_tree import op8_suffix_tree
from tidemark.llm.toolcalls import OP2_SQL, op2_tool_calls
from tidemark.llm.topk import OP10_SQL, op10_ball_tree
from tidemark.llm.toxicity import op12_toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_token_records": op1_token_records,
    "op2_tool_calls": op2_tool_calls,
    "op3_language": op3_language,
    "op4_ngram_join": op4_ngram_join,
    "op5_secrets": op5_secrets,
    "op6_merge_replay": op6_merge_replay,
    "op7_curve_packing": op7_curve_packing,
    "op8_suffix_tree": op8_suffix_tree,
    "op9_rare_features": op9_rare_features,
    "op10_ball_tree": op10_ball_tree,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_toxicity": op12_toxicity,
    "op13_divergence": op13_divergence,
}

ORACLE: dict[str, str] = {"op2_tool_calls": OP2_SQL, "op10_ball_tree": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op13_divergence": OP13_SQL}
