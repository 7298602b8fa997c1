"""The rolling scan against brute force, and its work against the size of sets."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from lodestone.functions import windows
from lodestone.operators import scan

KNOWN = "set_id string, file_id long, slice_index long, length long, md5 string, crc32 long"


def slices(files, size):
    """Rows of KNOWN of (set, id, data)."""
    cut = [(s, f, i, d[i * size : (i + 1) * size]) for s, f, d in files for i in range(-(-len(d or b"") // size))]
    return [(s, f, i, len(b), hashlib.md5(b).hexdigest(), zlib.crc32(b)) for s, f, i, b in cut]


def brute(files, known, size):
    of = {(k[0], k[3], k[4]) for k in known}
    places = ((s, p, a, n, hashlib.md5(d[a : a + n]).hexdigest()) for s, p, d in files if d for n in range(1, size + 1) for a in (range(len(d) - n + 1) if n == size else [len(d) - n]) if a >= 0)
    return {x for x in places if (x[0], x[3], x[4]) in of}


def awkward(r, size):
    base = [(s, 100 * (s == "b") + i, bytes(r.choices(b"ab", k=r.choice([0, 1, size - 1, size, size + 3, 5 * size]))) if i % 5 else b"\0" * (i * 9)) for s in "ab" for i in range(30)]
    moved = [(s, f, b"x" * (f % 4) + d) for s, f, d in base] + [("a", 500, None), ("a", 501, b""), ("c", 502, b"of no set" * 9), (None, 503, b"\0" * 99)]
    return base, moved + moved[3:6]  # some paths twice


def test_short_slices_of_all_lengths(spark):
    """A set whose files end in a thousand ways is scanned in seconds: one walk for all lengths."""
    r = random.Random(6)
    ends = [("s", i, r.randbytes(1024 + i)) for i in range(1, 1000)]
    moved = [("s", 5000 + i, b"xy" + ends[i * 16][2] if i % 2 else r.randbytes(3000)) for i in range(60)]
    known = slices(ends, 1024)
    began = time.perf_counter()
    found = scan.hits(spark.createDataFrame(moved, "set_id string, path long, data binary"), spark.createDataFrame(known, KNOWN), 1024)
    got = {(x["path"], x["offset"], x["length"]) for x in found.collect()}
    assert time.perf_counter() - began < 60
    assert got >= {(5000 + i, at, n) for i in range(1, 60, 2) for at, n in ((2, 1024), (1026, i * 16 + 1))}
    assert {p for p, _, n in got if n > 3} == set(range(5001, 5060, 2))


@pytest.mark.parametrize("small", [False, True])
def test_hits_by_brute_force(spark, monkeypatch, small):
    """Odd files, in one block and one table or in many."""
    size = 16
    base, moved = awkward(random.Random(7), size)
    known = slices(base, size)
    for k, v in {"TABLE": 20, "FILE_BYTES": 300, "HELD": 10}.items() if small else ():
        monkeypatch.setattr(scan, k, v)
    found = scan.hits(spark.createDataFrame(moved, "set_id string, path long, data binary"), spark.createDataFrame(known, KNOWN), size)
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(moved, known, size)


def test_checksums_by_lanes_and_from_ends():
    data = np.random.default_rng(8).integers(0, 256, 9000, dtype=np.uint8)
    for size in (1, 2, 7, 33):
        assert windows._rolled(data, size).tolist() == windows._registers(data, size).tolist()
        assert windows.window_crcs(data, size).tolist() == [zlib.crc32(data[i : i + size].tobytes()) for i in range(9000 - size + 1)]
    lengths = np.array([70, 40, 40, 1, 0])
    ends = np.cumsum(lengths)
    got = {n: found.tolist() for n, found in windows.end_crcs(data, ends, lengths, 99)}
    assert got == {n: [zlib.crc32(data[e - n : e].tobytes()) for e, x in zip(ends, lengths, strict=True) if x >= n] for n in range(1, 71)}
    assert [n for n, _ in windows.end_crcs(data, ends, lengths, 3)] == [1, 2, 3]


def test_copies_are_ranked_in_proportion(spark):
    """Places and slices of the same bytes: a row for each place, not one for each pair."""
    n = 30_000
    found = spark.range(n).selectExpr("'s' as set_id", "id * 2 as path", "16l as offset", "16l as length", "'m' as md5")
    known = spark.range(n).selectExpr("'s' as set_id", "id + 7 as file_id", "id % 3 as slice_index", "16l as length", "'m' as md5", "0l as crc32")
    began = time.perf_counter()
    got = {x["path"]: (x["file_id"], x["slice_index"], x["rank"]) for x in scan.ranked(found, known, 16).collect()}
    assert time.perf_counter() - began < 60 and len(got) == n
    for p, told in got.items():
        own = 7 <= p < n + 7
        assert told == ((p, (p - 7) % 3, 0 if (p - 7) % 3 == 1 else 1) if own else (7, 0, 2))


def test_ranks_by_brute_force(spark):
    size = 16
    base, moved = awkward(random.Random(9), size)
    base += [("a", None, b"no name's own bytes" * 3), ("a", None, base[0][2])]
    moved += [("a", p, base[i][2] + base[i + 1][2]) for p in (3, None) for i in (10, 12)]  # files of one path, and of none
    moved.append(("a", 600, b"no name's own bytes" * 3))
    known = slices(base, size)
    at = {(s, p, a, m) for s, p, a, _, m in brute(moved, known, size)}
    best = {}
    for s, p, a, m in at:
        rank = lambda f, i: 2 if f is None or f != p else int(i * size != a)  # noqa: B023, E731
        ranks = [(rank(f, i), f is None, f or 0, i) for x, f, i, _, d, _ in known if (x, d) == (s, m)]
        best[s, p, a] = min([*ranks, best.get((s, p, a), (9,))])
    want = {(*place, None if null else f, i, k) for place, (k, null, f, i) in best.items()}
    found = scan.hits(spark.createDataFrame(moved, "set_id string, path long, data binary"), spark.createDataFrame(known, KNOWN), size)
    got = [tuple(x) for x in scan.ranked(found, spark.createDataFrame(known + known[:9], KNOWN), size).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_copies_are_harvested_in_proportion(spark):
    """Places and lost slices of the same bytes: each slice is mended once, whatever the number of places."""
    n = 30_000
    found = spark.range(n).selectExpr("'s' as set_id", "id as path", "16l as offset", "16l as length", "'m' as md5")
    known = spark.range(n).selectExpr("'s' as set_id", "id as file_id", "0l as slice_index", "16l as length", "if(id % 10 = 0, 'other', 'm') as md5", "0l as crc32")
    lost = known.selectExpr("set_id", "file_id", "slice_index", "file_id % 4 = 0 as valid")
    began = time.perf_counter()
    got = scan.harvested(lost, found, known).collect()
    assert time.perf_counter() - began < 60 and len(got) == n
    assert all(x["in_place"] == (x["file_id"] % 4 == 0) and x["valid"] == (x["file_id"] % 4 == 0 or x["file_id"] % 10 != 0) for x in got)


@pytest.mark.parametrize("name", ["scan_harvest", "scan_ranked", "scan_repairability", "scan_runs", "scan_shifted"])
def test_queries_on_many_lengths(spark, tmp_path, name):
    """Two sets of files of seven hundred lengths with copies: as the SQL says, and in seconds."""
    import duckdb

    from lodestone.plans import queries

    r = random.Random(11)
    texts = ["".join(r.choices("abcdefgh ", k=1030 + i)) for i in range(700)]
    rows = [(i, texts[i // 5 * 3 if i % 5 == 0 else i], f"src{i % 2}") for i in range(700)] + [(700, "", "src0"), (707, "", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    began = time.perf_counter()
    got = queries.QUERIES[name](spark, str(tmp_path))
    columns, got = got.columns, [tuple(x) for x in got.collect()]
    assert time.perf_counter() - began < 60
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert got and sorted(got) == sorted(want)


def test_runs_of_a_moved_file(spark):
    """A file that was moved on by some bytes is one run; one with bytes between its slices is several."""
    r, size = random.Random(10), 16
    data = r.randbytes(10 * size + 5)
    moved = [("s", 1, b"xyz" + data), ("s", 2, data[: 3 * size] + b"?" + data[3 * size :]), ("s", 3, data[size : 2 * size] * 2)]
    known = spark.createDataFrame(slices([("s", 1, data)], size), KNOWN)
    chosen = scan.ranked(scan.hits(spark.createDataFrame(moved, "set_id string, path long, data binary"), known, size), known, size)
    got = {}
    for x in scan.chained(chosen, size).orderBy("path", "offset").collect():
        got.setdefault((x["path"], x["run"]), []).append((x["offset"], x["slice_index"], x["rank"]))
    assert got == {
        (1, 1): [(3 + i * size, i, 1) for i in range(11)],
        (2, 1): [(i * size, i, 2) for i in range(3)],
        (2, 2): [(i * size + 1, i, 2) for i in range(3, 11)],
        (3, 1): [(0, 1, 2), (size, 1, 2)],
    }


@pytest.mark.parametrize("small", [False, True])
def test_held_by_brute_force(spark, monkeypatch, small):
    """What is held anywhere, in one block and one table or in many."""
    size = 16
    base, moved = awkward(random.Random(12), size)
    known = slices(base, size)
    for k, v in {"TABLE": 20, "FILE_BYTES": 300, "HELD": 10, "ROWS": 7}.items() if small else ():
        monkeypatch.setattr(scan, k, v)
    moved, known = spark.createDataFrame(moved, "set_id string, path long, data binary"), spark.createDataFrame(known, KNOWN)
    got = [tuple(x) for x in scan.held(moved, known, size).collect()]
    want = brute([tuple(x) for x in moved.collect()], [tuple(x) for x in known.collect()], size)
    assert len(got) == len(set(got)) and set(got) == {(s, n, m) for s, _, _, n, m in want}
    assert {tuple(x) for x in scan.hits(moved, known, size).collect()} == want


def test_checksums_that_clash():
    """Other bytes of a slice's checksum, before it and between its places, hide it from no one."""
    import pyarrow as pa

    size = 16
    first = b"the bytes of it!"
    # four last bytes that bring another beginning to the same checksum, bit by bit
    crcs = {i: zlib.crc32(b"another one " + (1 << i if i >= 0 else 0).to_bytes(4, "little")) for i in range(-1, 32)}
    rows, want, end = [(crcs[i] ^ crcs[-1], 1 << i) for i in range(32)], zlib.crc32(first) ^ crcs[-1], 0
    for bit in range(32):
        pivot = next(x for x in rows if x[0] >> bit & 1)
        rows = [(x[0] ^ pivot[0], x[1] ^ pivot[1]) if x[0] >> bit & 1 else x for x in rows if x is not pivot]
        if want >> bit & 1:
            want, end = want ^ pivot[0], end ^ pivot[1]
    other = b"another one " + end.to_bytes(4, "little")
    assert zlib.crc32(other) == zlib.crc32(first) and other != first
    left = pa.table({"set_id": ["s"], "path": [1], "data": [other + first + first + other + first]})
    right = pa.table({"whole": [np.array([zlib.crc32(first)], "<u4").tobytes()], "short": [b""]})
    got = scan._find(size, False)(None, left, right).to_pydict()
    assert sorted(got["md5"]) == sorted(hashlib.md5(x).hexdigest() for x in (first, other))
    assert scan._find(size, True)(None, left, right).to_pydict()["offset"] == [0, 16, 32, 48, 64]


def test_repairability_of_runs_of_one_byte(spark, tmp_path):
    """Where every place of a file is a hit, the scan tells what is held, not where: no row for each byte."""
    from lodestone.plans import queries

    n = 600_000
    rows = [(i, "a" * n if i % 7 == 0 else f"{i:05}" * 300, "s") for i in range(1, 23)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in queries.QUERIES["scan_repairability"](spark, str(tmp_path)).collect()]
    slices_of = -(-n // 1024)
    assert got == [("s", 2 * 2, (3 * slices_of + 19 * 2 + 5) // 10, "repairable")]  # files 11 and 22 are lost
    store = spark._jsparkSession.sharedState().statusStore()
    told = []
    for e in range(store.executionsCount() - 1, -1, -1):
        run = store.executionsList().apply(e)
        nodes = store.planGraph(run.executionId()).allNodes()
        scans = [nodes.apply(i) for i in range(nodes.size()) if nodes.apply(i).name().startswith("FlatMapCoGroupsInArrow")]
        if scans:
            values = store.executionMetrics(run.executionId())
            metrics = scans[0].metrics()
            told = [values.get(m.accumulatorId()).get() for m in (metrics.apply(i) for i in range(metrics.size())) if m.name() == "number of output rows"]
            break
    assert [int(x.replace(",", "")) for x in told] == [2]  # a whole slice and the last one
