"""The queries themselves: names, types, rows, folds and thresholds of their results; stages on awkward rows."""

import zlib

import corpus_pipeline
import pytest

from lodestone.llm import mixing, queries

CONTRACT = {
    "op1_html_blocks": ("pages", "page_id", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}),
    "op3_toxicity": ("documents", "doc_id", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    "op4_suffix_dedup": ("documents", "doc_id", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}),
    "op5_ngram_jaccard": ("documents", "doc_id", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}),
    "op6_media_chunks": ("documents", "doc_id", {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}),
    "op7_best_fit_packing": ("documents", None, {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}),
    "op8_kmeans_tree": ("embeddings", None, {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}),
    "op9_pitman_yor": ("documents", "doc_id", {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}),
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract(spark, sf_dir, name):
    table, key, columns = CONTRACT[name]
    got = queries.QUERIES[name](spark, sf_dir)
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in columns} == columns
    rows = got.select(*columns).collect()
    whole = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if key:
        assert sorted(r[key] for r in rows) == sorted(r[0] for r in whole.select(key).collect())
    if "held_out" in columns:
        modulus, fold = (4, 2) if name == "op3_toxicity" else (5, 1)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == fold) for r in rows)
    if name == "op3_toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    if name == "op8_kmeans_tree":
        assert {r["query_id"] for r in rows} <= {r[0] for r in whole.where("vec_id % 20 = 0").select("vec_id").collect()}
        assert all(r["query_id"] != r["vec_id"] and 1 <= r["rank"] <= 20 for r in rows)


def test_stages_on_awkward_rows(spark, sf_dir):
    """Nulls anywhere, empty and repeated texts, clashing columns, and no rows at all."""
    names = ["_gone", "_lines", "epoch", "position", "repeats", "uid", "score", "spans", "component_id", "length"]
    rows = [(1, "some words here\nand more of them\nand some", "en", "s", 3), (2, None, "en", "s", None), (3, "", None, None, 0), (None, "no id", "en", "s", 5), (1, "some words here\nand more of them\nand some", "en", "s", 3), (4, "  \n ", "en", "t", 4)]
    df = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    for table in (df, df.limit(0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == df.columns, name
            kept = out.collect()
            assert all(list(r)[5:] == names for r in kept)
            docs = spark.createDataFrame(kept, df.schema) if kept else df.limit(0)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        ids = {r["doc_id"] for r in packed.collect()}
        assert ids == ({1, 2, 3, 4, None} if table is df else set())


def test_mixing_of_many_sources(spark, monkeypatch):
    """The numbers of many sources are joined, and give what broadcast ones give."""
    df = spark.createDataFrame([(i, "w" * (i % 90), f"s{i % 37}" if i % 41 else None) for i in range(900)], "doc_id long, text string, source string")
    want = sorted(map(repr, mixing.mix(df, max_repeats=1.8, block_docs=4).collect()))
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert sorted(map(repr, mixing.mix(df, max_repeats=1.8, block_docs=4).collect())) == want
