"""The registered queries of this subpackage: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat_rotation, cotraining, decontamination, host_rules, langid, merge_dropout, ppm, secret_index, source_tries, suffix_dedup, superminhash, turn_trie, url_gbt


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_perspectives(spark, sf_dir):
    return chat_rotation.rotate(table(spark, sf_dir, "conversations"))


def op2_cotraining(spark, sf_dir):
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_superminhash(spark, sf_dir):
    return superminhash.group_near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85).drop("th")


def op4_merge_dropout(spark, sf_dir):
    encoded = merge_dropout.encode(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


def op5_viterbi_langid(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"), spans=False)


def op6_column_suffixes(spark, sf_dir):
    """Beside the columns of the contract, the bytes in repeated strings of 200 bytes, about 50 short words; they stay."""
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"), passage=200)


def op7_ppm(spark, sf_dir):
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op8_host_rules(spark, sf_dir):
    return host_rules.apply_host_rules(table(spark, sf_dir, "documents"))


def op9_containment(spark, sf_dir):
    found = decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.transform("items", lambda i: i.cast("string")), ",")
    return found.select("doc_id", (F.col("share") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), ids.alias("item_ids"), F.col("share").alias("containment"))


def op10_url_trees(spark, sf_dir):
    return url_gbt.filter_urls(table(spark, sf_dir, "pages"))


def op11_source_tries(spark, sf_dir):
    return source_tries.audit(table(spark, sf_dir, "documents"))


def op12_trigram_secrets(spark, sf_dir):
    return secret_index.digest(secret_index.scan_secrets(table(spark, sf_dir, "documents")))


def op13_partition_refinement(spark, sf_dir):
    return turn_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_perspectives, op2_cotraining, op3_superminhash, op4_merge_dropout, op5_viterbi_langid, op6_column_suffixes, op7_ppm, op8_host_rules, op9_containment, op10_url_trees, op11_source_tries, op12_trigram_secrets, op13_partition_refinement)}


def oracle_sql() -> dict[str, str]:
    return {"op1_perspectives": chat_rotation.ORACLE_SQL, "op3_superminhash": superminhash.ORACLE_SQL, "op6_column_suffixes": suffix_dedup.oracle_sql(), "op8_host_rules": host_rules.ORACLE_SQL, "op9_containment": decontamination.ORACLE_SQL, "op11_source_tries": source_tries.ORACLE_SQL, "op12_trigram_secrets": secret_index.oracle_sql(), "op13_partition_refinement": turn_trie.ORACLE_SQL}
