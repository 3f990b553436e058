"""The operators of this package as queries over the driver's tables: (spark, sf_dir) -> DataFrame."""

import public_tokenizers
from pyspark.sql import functions as F

from tipoff.llm import chosen_path, collocations, conversation_audit, line_dedup, mixing, packing, pii, quality_gam, quality_rules, simhash, token_counts, topk, toxicity
from tipoff.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
SEQUENCE = 2048
CONTEXT = 1024
SHINGLE, MAX_BITS = 3, 3
SIMILAR = 80  # hundredths of the union that linked sets of shingles share

QUERIES = {}
ORACLES = {"op2_line_dedup": line_dedup.ORACLE, "op3_quality_rules": quality_rules.ORACLE, "op7_exact_top_k": topk.ORACLE}
ORACLES |= {"op11_conversation_audit": conversation_audit.ORACLE, "op12_chosen_path_dedup": chosen_path.ORACLE, "op13_collocations": collocations.ORACLE}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark, sf_dir):
    found = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op2_line_dedup(spark, sf_dir):
    found = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), counts=("n_lines", "n_dropped"))
    return found.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


@query
def op3_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


@query
def op4_quality_gam(spark, sf_dir):
    return quality_gam.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_hilbert_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), length=SEQUENCE)


@query
def op6_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=SHINGLE, max_bits=MAX_BITS)
    return found.select("doc_id", "fingerprint", "component_id")


@query
def op7_exact_top_k(spark, sf_dir):
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op8_source_mixing(spark, sf_dir):
    found = mixing.mix(table(spark, sf_dir, "documents"))
    each = found.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query
def op10_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=CONTEXT)


@query
def op11_conversation_audit(spark, sf_dir):
    damaged = conversation_audit.damaged(table(spark, sf_dir, "conversations"))
    return conversation_audit.audit_conversations(damaged, present=F.col("present"))


@query
def op12_chosen_path_dedup(spark, sf_dir):
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), percent=SIMILAR)


@query
def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
