import base64
import hashlib
import re

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from proofmill.llm.latent import quality_scores
from tests.llm.test_decontaminate import expected
from tests.llm.test_minmax import components

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality_scores(docs, labels).where("predicted = 1").collect()}
    seen, one = set(), []
    for k in sorted(good):
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", texts[k] or "")
        if norm not in seen:
            seen.add(norm)
            one.append(k)
    rows = [(k, texts[k]) for k in one]
    apart = [k for (k, _, _, kept) in components(rows, 5) if kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {k for (k, _, n, *_) in expected([(k, texts[k]) for k in apart], items) if not n}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for k in clean:
        ids = np.array(library.encode_ordinary(texts[k]), "<u4").tobytes()
        want[k] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[k].encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    assert 0 < len(clean) < len(apart) < len(one) < len(good) < len(texts)


def test_all_but_the_last_stage_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
