"""The corpus pipeline, stage by stage, against brute force."""

import zlib

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from coterie.llm import bpe, secrets
from tests_llm_shared import brute_components, check_packed, plain_fingerprint


def stages():
    return dict(corpus_pipeline.STAGES)


def test_stages_of_small_data(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = results[name] = spark.read.parquet(str(tmp_path / name))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "secret_scan", "pack"]
    for name in ("language_id", "simhash_dedup", "secret_scan"):
        assert results[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    known = {r["doc_id"]: r for r in results["language_id"].collect()}
    assert all(known[i] == before[i] for i in known) and all(i in known for i, r in before.items() if len(r["text"] or "") > 200)
    prints = {i: plain_fingerprint(r["text"] or "") for i, r in known.items()}
    kept = {r["doc_id"]: r for r in results["simhash_dedup"].collect()}
    assert set(kept) == set(brute_components(prints).values()) and all(kept[i] == known[i] for i in kept)
    clean = {r["doc_id"]: r for r in results["secret_scan"].collect()}
    assert set(clean) == set(kept)
    for i, r in clean.items():
        assert not secrets.find(r["text"]) and r["n_chars"] == len(r["text"])
        assert r["text"] == kept[i]["text"] or secrets.find(kept[i]["text"])
    rows = results["pack"].collect()
    check_packed(rows)
    library = Tokenizer.from_file(bpe.default_vocabulary())
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(clean)
    for i, r in clean.items():
        ids = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in pieces[i]) and sum(p["length"] for p in pieces[i]) == len(ids)


def test_stages_take_odd_rows(spark, docs, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
        out = stage(spark, docs, "")
        assert out.count() > 0
        if name != "pack":
            assert out.columns == docs.columns and out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    check_packed(rows)
