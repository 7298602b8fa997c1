"""Operators on a small table with every awkward case, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import html_extraction, kmeans_tree, line_dedup, media, mixing, ngram_jaccard, pitman_yor, queries, suffix_dedup, toxicity, vector_packing

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("uid", T.StringType()), T.StructField("d", T.IntegerType()), T.StructField("score", T.StringType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def rows():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(250)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = "\n".join(say(12) for _ in range(5))
    base = say(220)
    out = [(i, f"{say(r.randint(3, 60))}\n{passage if i % 3 == 0 else say(20)}\n{say(r.randint(0, 30))}", f"s{0 if i % 3 else i % 5}") for i in range(40)]
    for i in range(40, 60):
        words = base.split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        out.append((i, " ".join(words).title() if i % 2 else " ".join(words), "near"))
    out += [(60, None, "s1"), (61, "", "s1"), (62, "   \n\t ", None), (63, "one", "s1"), (64, "one", "s1"), (65, "One two", None), (None, "null id here", "s2"), (None, None, None)]
    out += [(70, out[0][1], "s0"), (70, out[0][1], "s0"), (0, out[0][1], "s0")]
    out += [(71, "x" * 5000, "long"), (72, say(9000), "long"), (73, "a\n" * 300, "long"), (74, "<|endoftext|> and é中\U0001f600  double  spaces   x", "odd")]
    return [(*x, "u", 1, "s") for x in out]


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(5, "doc_id")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(*values):
    return repr(values)


def test_ngram_jaccard(spark, data, docs, none):
    def sets(n):
        out = []
        for x in data:
            w = WORD.findall(lower(x[1] or ""))
            out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
        return out

    for n, num, block in ((3, 90, 2048), (5, 80, 4)):
        s = sets(n)
        parent, links = list(range(len(s))), [0] * len(s)

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(s)):
            for j in range(i):
                if s[i] and s[j] and 100 * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
                    parent[root(i)] = root(j)
                    links[i] += 1
                    links[j] += 1
        least = {}
        for i, x in enumerate(data):
            if x[0] is not None:
                least[root(i)] = min(least.get(root(i), x[0]), x[0])
        want = sorted(key(x[0], len(s[i]), links[i], least.get(root(i))) for i, x in enumerate(data))
        got = ngram_jaccard.jaccard_groups(docs, n=n, num=num, den=100, block_rows=block)
        assert sorted(key(*r) for r in got.collect()) == want
    assert ngram_jaccard.jaccard_groups(none).collect() == []
    kept = ngram_jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {60, 61, 62, None} <= ids and 70 not in ids and 64 not in ids and 63 in ids


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def test_words_and_lines_of_equal_polynomials_differ(spark):
    x, y = thue_morse(1024), thue_morse(1024, "ba")
    df = spark.createDataFrame([(1, f"{x} b c d"), (2, f"{y} b c d")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_jaccard.jaccard_groups(df, n=3, num=90, den=100).collect())) == [(1, 2, 0, 1), (2, 2, 0, 2)]
    lines = spark.createDataFrame([(1, f"{x}\nsecond"), (2, f"{y}\nsecond")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(lines).collect()) == [(1, f"{x}\nsecond"), (2, f"{y}\nsecond")]
    model = pitman_yor.score_texts(df.withColumn("learn", F.col("doc_id") == 1), "learn").collect()
    assert {r["doc_id"]: r["n_known"] for r in model} == {1: 5, 2: 4}


def test_clashing_columns(spark):
    names = ["_gone", "_lines", "epoch", "position", "repeats", "uid", "node", "sig", "lost", "d", "s", "h", "b", "length", "piece", "a.b"]
    df = spark.createDataFrame([(i, f"one {i}\ntwo words\nthree words", "s", *names) for i in range(3)], ["doc_id", "text", "source", *[f"c{i}" for i in range(len(names))]]).toDF("doc_id", "text", "source", *names)
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "_gone_", "_lines_"] and sorted(r["_gone_"] or [] for r in out.collect()) == [[], [1, 2], [1, 2]]
    assert all(list(r)[3:-2] == names for r in out.collect())
    mixed = mixing.mix(df, max_repeats=2.0)
    assert mixed.columns == [*df.columns, "epoch_", "position_", "repeats_"] and mixed.count() == 3
    kept = ngram_jaccard.keep_one(df)
    assert kept.columns == df.columns and kept.count() == 3
    assert toxicity.keep_clean(df, df.selectExpr("doc_id", "0 toxic"), 2.0).columns == df.columns
    assert vector_packing.pack(df.withColumnRenamed("doc_id", "length_").drop("length").withColumnRenamed("length_", "length"), queries.tokenizer_path(), id_col="length").count() == 3


def test_hot_signatures(spark, monkeypatch):
    """Signatures that many sets of a task share go by count and members; the result is the same."""
    r = random.Random(12)
    base = [f"w{r.randrange(900)}" for _ in range(160)]
    table = []
    for i in range(120):
        words = list(base)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(160)] = f"x{r.randrange(900)}"
        table.append((i, " ".join(words)))
    table += [(200 + i, " ".join(f"w{r.randrange(900)}" for _ in range(60)) + " " + " ".join(base[:60])) for i in range(40)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3, "doc_id")
    want = sorted(map(tuple, ngram_jaccard.jaccard_groups(df, turns=2).collect()))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in table]
    links = [sum(100 * len(a & b) >= 80 * len(a | b) for b in sets) - 1 for a in sets]
    assert [x[2] for x in want] == links
    hot = lambda: [pa.RecordBatch.from_pydict({"id": [x[0] for x in table], "text": [x[1] for x in table]})]
    sent = lambda: pa.Table.from_batches([b.cast(ngram_jaccard.MESSAGE) for b in ngram_jaccard._signatures(5, 80, 100, 4, 0, 1)(hot())])
    monkeypatch.setattr(ngram_jaccard, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 0)}))}))

    def shared():
        t = sent()
        got = [ngram_jaccard._shared(4)((pa.scalar(p),), t.filter(pa.compute.equal(t.column("part"), p))) for p in range(4)]
        rows = [x for g in got for x in g.to_pylist()]
        count = {x["sig"]: x["n"] for x in rows if x["node"] is None}
        return sorted((x["sig"], x["node"], x["need"], x["n"] if x["n"] is not None else count[x["sig"]]) for x in rows if x["node"] is not None)

    plain = shared()
    monkeypatch.setattr(ngram_jaccard, "HOT", 20)
    assert shared() == plain and plain


def brute_repeats(texts, n):
    seen = {}
    for t in texts:
        for i in range(len(t) - n + 1):
            seen[t[i : i + n]] = seen.get(t[i : i + n], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("length,k,hot", [(50, 16, 200_000), (30, 8, 3), (200, 32, 2)])
def test_suffix_dedup(docs, data, none, length, k, hot):
    texts = [(x[1] or "").encode() for x in data]
    want = []
    for x, t, gone in zip(data, texts, brute_repeats(texts, length), strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))
        want.append(key(x[0], len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove_repeats(docs, length=length, k=k, hot=hot)
    assert sorted(key(r[0], r[1], r[2], [tuple(s) for s in r[3]], r[4]) for r in got.collect()) == sorted(want)
    assert suffix_dedup.remove_repeats(none).collect() == []


def test_media(docs, data, none):
    got = {}
    for r in media.media_column(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for x in data:
        t = (x[1] or "").encode()
        p = t + b"\xff" * ((-len(t)) % 576 if t else 576)
        facts = (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert facts in [(r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got[x[0]]]
    same = {(r["payload_sha256"], r["media_sha256"], r["media_bytes"], r["feature"]) for v in got.values() for r in v}
    assert len(same) == len({s[0] for s in same}) and sum(map(len, got.values())) == len(data)
    assert media.media_column(none).collect() == []


def test_packing(docs, data, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = {}
    for x in data:
        ids = [*tok.encode(x[1] or "", add_special_tokens=False).ids, 2]
        want.setdefault(x[0], []).append(np.array(ids, "<u4").tobytes())
    got = vector_packing.pack(docs, queries.tokenizer_path()).collect()
    pieces, bins = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, all_ids in want.items():
        expected = []
        for b in all_ids:
            n, at, piece = len(b) // 4, 0, 0
            while at < n:
                length = (n % 1024 or 1024) if piece == 0 else 1024
                expected.append((piece, at, length, zlib.crc32(b[4 * at : 4 * (at + length)])))
                at, piece = at + length, piece + 1
        assert sorted(expected) == sorted(pieces[i])
    total = 0
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
    assert len(bins) <= -(-total // 1024) + 1
    assert vector_packing.pack(none, queries.tokenizer_path()).collect() == []


@pytest.mark.parametrize("run", [1, 2, 3])
def test_line_dedup(docs, data, none, run):
    blank = " \t\n\x0b\x0c\r"
    got = {}
    out = line_dedup.dedup_lines(docs, run=run)
    assert out.columns == [*docs.columns, "_gone", "_lines"]
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["_lines"]))
    seen = set()
    for x in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0)):
        if x[1] is None:
            assert (None, 0) in got[x[0]]
            continue
        lines = x[1].split("\n")
        index = [i for i, s in enumerate(lines) if s.strip(blank)]
        words = [lines[i].strip(blank) for i in index]
        gone = set()
        for i in range(len(words) - run + 1):
            w = tuple(words[i : i + run])
            if w in seen:
                gone |= set(range(i, i + run))
            seen.add(w)
        kept = "\n".join(s for i, s in enumerate(lines) if i not in {index[j] for j in gone})
        if x[0] is not None:  # rows with a null id come in any order among themselves
            assert (kept, len(words)) in got[x[0]], x[0]
    assert line_dedup.dedup_lines(none).collect() == []


@pytest.mark.parametrize("run,alone", [(2, 13), (3, 1), (2, 50)])
def test_line_dedup_of_long_lines(spark, data, run, alone):
    blank = " \t\n\x0b\x0c\r"
    long = " ".join(f"w{i}" for i in range(60))
    own = [(200, long, "s1"), (201, f"new above\n  {long}\t\nnew below", "s1"), (202, f"{long}\n{long}", "s1"), (203, f"{' '.join(long.split()[:49])}\nx", "s1"), (204, f"{' '.join(long.split()[:49])}\ny", "s1")]
    table = [x for x in data if x[0] is not None and x[1] is not None and x[0] not in (0, 70)] + [(*x, "u", 0, "k") for x in own]
    out = line_dedup.dedup_lines(spark.createDataFrame(table, SCHEMA).repartition(5, "doc_id"), run=run, alone=alone)
    got = {r["doc_id"]: (r["text"], r["_gone"]) for r in out.collect()}
    seen = set()
    for x in sorted(table):
        lines = x[1].split("\n")
        index = [i for i, s in enumerate(lines) if s.strip(blank)]
        words = [lines[i].strip(blank) for i in index]
        gone = set()
        for width in (run, 1):
            for i in range(len(words) - width + 1):
                w = tuple(words[i : i + width])
                if width == 1 and len(WORD.findall(w[0])) < alone:
                    continue
                if w in seen:
                    gone |= set(range(i, i + width))
                seen.add(w)
        kept = "\n".join(s for i, s in enumerate(lines) if i not in {index[j] for j in gone})
        assert got[x[0]] == (kept, sorted(gone) or None), x[0]
    assert got[200][0] == long and got[201][0] == "new above\nnew below" and got[202][0] == ""
    assert (got[204][0] == "y") == (alone <= 49)
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(out, gone="g", lines="l", alone=0)


def test_mixing(docs, data, none):
    tokens = lambda t: len((t or "").encode()) // 4 + 1
    total = {}
    for x in data:
        total[x[2]] = total.get(x[2], 0) + tokens(x[1])
    for args in ({"max_repeats": 2.5}, {"target_entropy": 0.9}, {"max_repeats": 1.7, "budget": float(sum(total.values()))}):
        got = mixing.mix(docs, block_docs=3, **args).collect()
        used, r = {}, {}
        for x in got:
            used[x["source"]] = used.get(x["source"], 0) + tokens(x["text"])
            r[x["source"]] = x["repeats"]
            assert 0 <= x["position"] <= 1
        assert set(r) <= set(total)
        biggest = max(tokens(x[1]) for x in data)
        for s, n in used.items():
            assert n <= r[s] * total[s] + 1e-6 and n >= min(int(r[s]) * total[s], r[s] * total[s]) - 1e-6, s
            assert n >= r[s] * total[s] - biggest - 1
        if "budget" not in args:
            assert min(r.values()) == pytest.approx(1) and sorted(key(x["doc_id"], x["text"]) for x in got if x["epoch"] == 0) == sorted(key(x[0], x[1]) for x in data)
        again = mixing.mix(docs.repartition(2), block_docs=3, **args).collect()
        assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.mix(none, max_repeats=2.0).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs)


def test_language_model(docs, data, none):
    got = pitman_yor.score_texts(docs.withColumn("learn", F.col("doc_id") % 4 != 1), "learn").collect()
    end = object()
    train, texts = {}, []
    for x in data:
        w = [*WORD.findall(lower(x[1] or "")), end]
        learn = x[0] is not None and x[0] % 4 != 1
        texts.append((x[0], learn, w))
        if learn:
            for t in w:
                train[t] = train.get(t, 0) + 1
    n, v = sum(train.values()), len(train)
    want = sorted(key(i, learn, len(w), sum(t in train for t in w), n, round(float(sum(np.log10((train.get(t, 0) + 0.5) / (n + 0.5 * (v + 1))) for t in w)), 6)) for i, learn, w in texts)
    assert sorted(key(r["doc_id"], r["train"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    held = [r for r in got if not r["train"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    nothing = pitman_yor.score_texts(docs, "false").collect()
    assert len(nothing) == len(data) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"]) for r in nothing)
    assert pitman_yor.score_texts(none, "true").collect() == []


def test_language_model_learns_pairs(spark):
    table = [(i, "maing left" if i % 2 else "boing right", True) for i in range(60)]
    table += [(100, "maing left", False), (101, "maing right", False), (102, "boing left", False), (103, "boing right", False)]
    df = spark.createDataFrame(table, "doc_id long, text string, learn boolean")
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score_texts(df.repartition(3, "doc_id"), "learn").collect()}
    assert got[100] > got[101] + 1 and got[103] > got[102] + 1  # the words before end alike: one class
    again = {r["doc_id"]: r["score"] for r in pitman_yor.score_texts(df.repartition(7), "learn").collect()}
    assert all(abs(again[i] - got[i]) < 1e-6 for i in got)


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 12))
    x[100:140] = x[100]
    table = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    odd = [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12), (2060, [1.0] * 11 + [None]), (2080, [float("inf")] + [0.0] * 11), (2100, [1.0, 2.0]), (None, [1.0] * 12), (2120, [])]
    table += [(a, b, "c") for a, b in odd] + [table[40]]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, leaf string")
    asked = df.where("vec_id % 20 = 0")
    got = {}
    for r in kmeans_tree.search(df, asked, k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 20))
    hit = 0
    for q, found in got.items():
        s = (x * x[q]).sum(axis=1)
        order = [int(i) for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hit += len({f[1] for f in found} & set(order))
    assert hit >= 0.9 * 20 * len(got)
    few = kmeans_tree.search(df.where("vec_id < 5"), df.where("vec_id = 0"), k=20)
    assert sorted(r["vec_id"] for r in few.collect()) == [1, 2, 3, 4]
    assert kmeans_tree.search(df.limit(0), df.limit(0)).collect() == []
    kmeans_tree.BLOCK, keep = 16, kmeans_tree.BLOCK
    try:
        cut = kmeans_tree.search(df, asked, k=20)
        again = {}
        for r in cut.collect():
            again.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert {q: [f[1] for f in sorted(v)] for q, v in again.items()} == {q: [f[1] for f in v] for q, v in got.items()}
    finally:
        kmeans_tree.BLOCK = keep


def test_toxicity(spark, docs, none):
    r = random.Random(5)
    fine = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    bad = ["zorp", "zorping", "quag", "quagged"]
    table = []
    for i in range(900):
        w = [r.choice(fine) for _ in range(r.randint(5, 60))]
        if i % 4 == 0:
            w[r.randrange(len(w))] = r.choice(bad)
        table.append((i, " ".join(w) + ".", int(i % 4 == 0)))
    df = spark.createDataFrame(table, "doc_id long, text string, toxic int")
    labels = df.where("doc_id % 3 <> 0").select("doc_id", "toxic")
    got = {x["doc_id"]: x for x in toxicity.score_toxicity(df.drop("toxic"), labels).collect()}
    right = [(got[i]["score"] >= 0.5) == bool(y) for i, _, y in table if i % 3 == 0]
    assert np.mean(right) > 0.97
    for i, text, y in table:
        for s in got[i]["spans"]:
            assert text[s["start"] : s["end"]].strip() in text
        if y and i % 3 == 0 and got[i]["spans"]:
            assert any(text[s["start"] : s["end"]] in bad for s in got[i]["spans"])
    odd = toxicity.score_toxicity(docs, labels.where("false")).collect()
    assert len(odd) == docs.count() and all(0 <= x["score"] <= 1 for x in odd)
    awkward = toxicity.keep_clean(docs, labels, 0.99)
    assert awkward.columns == docs.columns and awkward.count() > 0
    assert toxicity.score_toxicity(none, labels).collect() == []


def test_toxicity_keeps_the_rate_of_all_labelled_rows(spark):
    r = random.Random(8)
    say = lambda: " ".join(r.choice(["pale", "moon", "tree", "road", "lake", "hill"]) for _ in range(12))
    table = [(i, f"{say()} {'zorp' if i % 20 == 0 and i % 40 else ''}.", int(i % 20 == 0)) for i in range(2400)]
    df = spark.createDataFrame(table, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    whole, part = (toxicity.fit(*toxicity.training_sample(df, labels, "doc_id", "text", "toxic", rows)) for rows in (3000, 120))
    a, b = (m.score(np.zeros(0), np.zeros(0, np.int64), 1)[0] for m in (whole, part))
    assert a < 0.1 and 0.5 < b / a < 2


def test_toxicity_learns_from_long_texts(spark):
    r = random.Random(9)
    say = lambda n: " ".join(r.choice(["pale", "moon", "tree", "road", "lake", "hill"]) for _ in range(n))
    table = [(i, f"{say(15_000)} zorp." if i % 4 == 0 else f"{say(20)}.", int(i % 4 == 0)) for i in range(120)]
    df = spark.createDataFrame(table, "doc_id long, text string, toxic int")
    asked = spark.createDataFrame([(1, "pale moon zorp."), (2, "pale moon tree.")], "doc_id long, text string")
    sample = lambda most: toxicity.training_sample(df, df, "doc_id", "text", "toxic", 3000, most)
    assert sorted(sample(1 << 30)[0]) == sorted(t for _, t, _ in table)
    sizes = [len(t) for t in sample(200_000)[0]]
    assert sum(sizes) >= 200_000 > sum(sizes[:-1])
    got = {x["doc_id"]: x["score"] for x in toxicity.score_toxicity(df.drop("toxic").unionByName(asked.withColumn("doc_id", -F.col("doc_id"))), df.select("doc_id", "toxic")).collect()}
    assert got[-1] > got[-2]


def test_main_text(spark):
    long = " ".join(f"word{i % 91}." for i in range(9000))
    pages = [
        (1, "u", f"<body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><article><h1>Title here</h1><p>{'Some text of the article, told at length. ' * 3}</p><p>More of it follows &amp; ends here, as it should.</p></article><div class='comments'><p>nice one</p></div><footer>&copy; me</footer>"),
        (2, "u", None),
        (None, None, ""),
        (3, "u", f"<html><body><article><p>{long}</p></article>"),
        (3, "u", f"<html><body><article><p>{long}</p></article>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = html_extraction.main_text(df, ["page_id", "url"]).collect()
    first = next(r for r in got if r["page_id"] == 1)
    assert "Home" not in first["text"] and "nice one" not in first["text"] and "me" not in first["text"].split()
    assert first["text"].endswith("More of it follows & ends here, as it should.") and first["n_chars"] == len(first["text"])
    assert [r["text"] for r in got if r["page_id"] == 2] == [""] and [r["text"] for r in got if r["page_id"] is None] == [""]
    assert [r["text"] for r in got if r["page_id"] == 3] == [long, long]
    assert html_extraction.main_text(df.limit(0), ["page_id"]).collect() == []


def test_labeller_on_new_made_pages():
    from lodestone.llm import html_blocks, html_training

    parsed = [html_blocks.blocks(p) for p in html_training.pages(200, seed=77)]
    y = np.array([html_extraction.MARK in b.text for p in parsed for b in p])
    for p in parsed:
        for b in p:
            b.text = b.text.replace(html_extraction.MARK, "") or "x"
    got = html_extraction.trained().label(html_blocks.vectors(parsed), np.array([len(p) for p in parsed])) >= 0.5
    assert (got == y).mean() > 0.95
