"""The registered queries opN_<name>: each applies its operator with
production parameters to its whole table and returns the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from triage.llm import (decontam, jaccard, langid, merkle, packing, periodic_runs, pitman_yor, quality,
                        simhash, token_alignment, token_counts, training_order, url_trees)
from triage.llm.common import saved, table


def held_out(doc_id, divisor: int, remainder: int):
    """crc32(doc_id as text) mod divisor = remainder; false without a doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def q_op1(spark, sf_dir):
    pages, fields = table(spark, sf_dir, "pages"), ["url", "html"]
    return merkle.audit(merkle.records(pages, "page_id", fields), merkle.records(merkle.damaged(pages), "page_id", fields))


def q_op2(spark, sf_dir):
    return pitman_yor.score(table(spark, sf_dir, "documents"), held_out("doc_id", 5, 1))


def q_op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.train(docs), ["doc_id"])
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def q_op4(spark, sf_dir):
    return decontam.digest(decontam.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"]))


def q_op5(spark, sf_dir):
    found = jaccard.Jaccard(words=4, percent=85).documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def q_op6(spark, sf_dir):
    out = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


def q_op7(spark, sf_dir):
    return quality.judged(table(spark, sf_dir, "documents"), ["doc_id"])


def q_op8(spark, sf_dir):
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut)


def q_op9(spark, sf_dir):
    """Writes the shards and reads them back from slot 0."""
    shards = training_order.materialised(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return training_order.read_from(saved(shards, "training-order")).drop("ids")


def q_op10(spark, sf_dir):
    return url_trees.verdicts(table(spark, sf_dir, "pages"))


def q_op11(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def q_op12(spark, sf_dir):
    return periodic_runs.digest(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), periodic_runs.planted))


def q_op13(spark, sf_dir):
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.alignment(table(spark, sf_dir, "documents"), a, b, keep_groups=False)


QUERIES = {
    "op1_merkle_audit": q_op1,
    "op2_pitman_yor": q_op2,
    "op3_langid": q_op3,
    "op4_decontamination": q_op4,
    "op5_jaccard_join": q_op5,
    "op6_token_counts": q_op6,
    "op7_quality": q_op7,
    "op8_packing": q_op8,
    "op9_training_order": q_op9,
    "op10_url_trees": q_op10,
    "op11_simhash": q_op11,
    "op12_periodic_runs": q_op12,
    "op13_token_alignment": q_op13,
}

#: DuckDB SQL where SQL can express the result.
SQL: dict[str, str] = {"op1_merkle_audit": merkle.SQL}
