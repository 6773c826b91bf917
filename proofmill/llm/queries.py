"""The queries of this package: production parameters, whole tables."""

from __future__ import annotations

from proofmill.llm.common import read
from proofmill.llm.oracles import SQL  # noqa: F401

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_byte_shards(spark, sf_dir):
    from proofmill.llm.shards import byte_shards

    return byte_shards(read(spark, sf_dir, "documents"), 8)


@query
def op2_minmax_near_dedup(spark, sf_dir):
    from proofmill.llm.minmax import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), k=4).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op3_exact_dedup(spark, sf_dir):
    from proofmill.llm.exact import exact_duplicates

    return exact_duplicates(read(spark, sf_dir, "documents"))


@query
def op4_benchmark_decontamination(spark, sf_dir):
    from proofmill.llm.decontaminate import contamination

    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op5_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from proofmill.llm.bytebpe import round_trip

    out = round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op6_ans_token_files(spark, sf_dir):
    import public_tokenizers

    from proofmill.llm.tokenfile import token_files

    return token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 49_408, 2)


@query
def op7_url_vocabulary(spark, sf_dir):
    from proofmill.llm.urlfilter import url_verdicts

    return url_verdicts(read(spark, sf_dir, "pages"))


@query
def op8_byte_cnn_language(spark, sf_dir):
    from proofmill.llm.bytecnn import learn_languages, predict_languages

    docs = read(spark, sf_dir, "documents")
    return predict_languages(docs, learn_languages(docs))


@query
def op9_licence_scan(spark, sf_dir):
    from proofmill.llm.licences import licence_scan

    return licence_scan(read(spark, sf_dir, "documents"))


@query
def op10_latent_quality(spark, sf_dir):
    from proofmill.llm.latent import quality_scores

    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op11_exact_whitening(spark, sf_dir):
    from proofmill.llm.whitening import whitened_components

    return whitened_components(read(spark, sf_dir, "embeddings"))


@query
def op12_turn_alignment(spark, sf_dir):
    from proofmill.llm.turns import damaged, repair_conversations

    return repair_conversations(damaged(read(spark, sf_dir, "conversations")), key="conv").withColumnRenamed("conv", "conv_id")


@query
def op13_toxic_segments(spark, sf_dir):
    from proofmill.llm.toxic import learn_toxicity, toxicity_scores

    docs = read(spark, sf_dir, "documents")
    return toxicity_scores(docs, learn_toxicity(docs, read(spark, sf_dir, "labels")))
