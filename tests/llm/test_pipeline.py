"""The pipeline against a brute-force version, stage by stage."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
from common import edge_docs, empty_docs
from conftest import SF
from lakeweave.llm import bpe, language_id, mixing
from lakeweave.llm.queries import tokenizer
from test_table_operators import components_of
from test_text_operators import quality_figures

import __spark_entry__
import corpus_pipeline


def test_stages(spark):
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    assert all(f.columns == docs.columns for f in out[:-1])
    kept = [{r.doc_id for r in f.select("doc_id").collect()} for f in out]
    texts = {r.doc_id: r.text for r in docs.collect()}

    assert kept[1] == {d for d, text in texts.items() if quality_figures(text)[6]}
    judged = {r.doc_id: r for r in language_id.language_id(out[1]).collect()}
    assert kept[2] == {d for d, r in judged.items() if r.lang_pred != "und" and r.score >= language_id.LEAST_SCORE}
    assert kept[3] == {d for d, _, c, k in components_of([(d, texts[d]) for d in kept[2]], 5, 80) if k}
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix(out[3]).collect()}
    assert Counter(r.doc_id for r in out[4].collect()) == +Counter(taken)

    path, pattern = tokenizer()
    tik = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    final = out[5].collect()
    assert len(final) == sum(taken.values())
    for r in final:
        ids = np.array(tik.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (bytes(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) == (ids, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    whole = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.ids_sha256) for r in whole.collect()) == Counter((r.doc_id, r.ids_sha256) for r in final)


def test_edges(spark):
    for docs in (edge_docs(spark), empty_docs(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.collect()


def test_registered():
    names = __spark_entry__.queries()
    found = defaultdict(list)
    for n in names:
        if n.startswith("op") and n[2].isdigit():
            found[int(n[2:].split("_")[0])].append(n)
    assert sorted(found) == list(range(1, 11)) and all(len(x) == 1 for x in found.values()) and "pipeline" in names
