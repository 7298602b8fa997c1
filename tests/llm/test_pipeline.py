"""The pipeline's stages, each on its own input."""

import re

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, n=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = [docs.collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"file://{tmp_path}/{i}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        kept.append(docs.collect())
    start, clean, lines, near, mixed, packed = kept
    ids = lambda rows: {r["doc_id"] for r in rows}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    assert ids(clean) <= ids(start) and len(ids(start) - ids(clean)) <= 2 * len(toxic) + 5
    by = {r["doc_id"]: r for r in clean}
    seen = set()
    for r in sorted(clean, key=lambda r: r["doc_id"]):
        s = [x.strip(" \t\n\x0b\x0c\r") for x in r["text"].split("\n")]
        s = [x for x in s if x]
        gone = set()
        for i in range(len(s) - 1):
            if (s[i], s[i + 1]) in seen:
                gone |= {i, i + 1}
            seen.add((s[i], s[i + 1]))
        left = [x for i, x in enumerate(s) if i not in gone]
        found = [x for x in lines if x["doc_id"] == r["doc_id"]]
        if gone and not left:
            assert not found
        else:
            got = [x.strip(" \t\n\x0b\x0c\r") for x in found[0]["text"].split("\n")]
            assert [x for x in got if x] == left and found[0]["n_chars"] == len(found[0]["text"]) and found[0]["source"] == by[r["doc_id"]]["source"]
    sets = {r["doc_id"]: shingles(r["text"]) for r in lines}
    order = sorted(sets)
    parent = {i: i for i in order}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in order:
        for j in order:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert ids(near) == {i for i in order if root(i) == i}
    assert ids(mixed) == ids(near) and len(mixed) >= len(near)
    assert ids(packed) == ids(mixed)
    assert sum(r["length"] for r in packed if r["piece"] >= 0) > 0 and max(r["offset"] + r["length"] for r in packed) <= 1024


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
