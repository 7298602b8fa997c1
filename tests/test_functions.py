import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import crc, galois, keys, names, times
from lodestone.operators import parity
from lodestone.sources import containers, packets


def test_crc_algebra():
    r = random.Random(1)
    for _ in range(40):
        a, b = r.randbytes(r.randint(0, 300)), r.randbytes(r.randint(0, 300))
        assert crc.combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
        assert crc.uncombine(zlib.crc32(a + b), zlib.crc32(b), len(b)) == zlib.crc32(a)
        assert crc.unpad(zlib.crc32(a + b"\0" * 9), 9) == zlib.crc32(a)
    data = r.randbytes(1000)
    padded = [zlib.crc32(data[i : i + 64].ljust(64, b"\0")) for i in range(0, 1000, 64)]
    assert crc.fold(padded, 64, 1000) == zlib.crc32(data)


def test_field():
    f = galois.field()
    r = np.random.default_rng(2)
    a, b, c = r.integers(1, 65536, (3, 200))
    assert (f.mul(a, f.inv(a)) == 1).all()
    assert (f.mul(a, b ^ c) == f.mul(a, b) ^ f.mul(a, c)).all()
    assert f.pow(0, 0) == 1 and f.pow(0, 3) == 0
    with pytest.raises(ZeroDivisionError):
        f.inv(0)
    m = r.integers(0, 65536, (12, 12))
    assert (f.matmul(m, f.invert(m)) == np.eye(12)).all()
    assert galois.constants(3).tolist() == [2, 4, 16]
    assert len(galois.constants(32768)) == len(set(galois.constants(32768).tolist()))


def test_cauchy_code():
    f, n, size = galois.field(), 5, 64
    r = random.Random(3)
    data = [r.randbytes(size) for _ in range(n)]
    words = np.stack([parity.words(d, size) for d in data])
    units = dict(enumerate(data))
    for row in (5, 6, 7):
        units[row] = f.matmul(f.inv(row ^ np.arange(n))[None, :], words)[0].astype("<u2").tobytes()
    for lost in ((0, 1, 2), (1, 5, 4), (0,)):
        assert parity.cauchy_decode(n, {k: v for k, v in units.items() if k not in lost}, size) == data


def test_plan_skips_singular_and_counts():
    chosen, inverse = parity.plan(10, [1, 3], [7, 2, 5])
    assert chosen == [2, 5] and inverse.shape == (2, 2)
    with pytest.raises(ValueError):
        parity.plan(10, [1, 3, 4], [1, 2])


def test_tree_hash_known_value():
    # Fixed value: the tree hash of no data
    assert keys.blake2sp(b"").hex() == "dd0e891776933f43c7d032b08a917e25741f8aa9a12c12e1cac8801500f2ca4f"
    assert keys.password_state("p", b"s" * 16, 2, None) == "unverifiable"
    check = keys.derive("p", b"s" * 16, 2)[2]
    assert keys.password_state("p", b"s" * 16, 2, check) == "verified"
    assert keys.password_state("q", b"s" * 16, 2, check) == "wrong"


def test_names(spark):
    n = F.col("n")
    df = spark.createDataFrame([("a.part02.rar",), ("x.vol1+2.par2",), ("b.part9.rar",), ("c.r00",), ("c.s00",), ("c.a00",), ("d.003",), ("plain",)], "n string")
    got = {r["n"]: r for r in df.select("n", names.set_hint(n).alias("h"), names.old_volume_index(n).alias("v"), names.next_volume(n).alias("x"), names.recovery_base(n).alias("b")).collect()}
    assert got["a.part02.rar"]["h"] == "a" and got["a.part02.rar"]["x"] == "a.part03.rar" and got["b.part9.rar"]["x"] == "b.part10.rar"
    assert [got[k]["v"] for k in ("c.r00", "c.s00", "c.a00", "d.003", "plain")] == [1, 101, 999, 2, None]
    assert got["x.vol1+2.par2"]["b"] == "x"


def test_paths(spark):
    p = F.col("p")
    df = spark.createDataFrame([("C:\\a\\..\\b\x00c", 0), ("../x", 1), ("../../x", 1), ("/etc", 3), ("a/./b", 0)], "p string, d int")
    got = [tuple(r) for r in df.select(names.sanitized(p), names.safe_link(p, F.col("d"))).collect()]
    assert got[0][0] == "a/b" and [g[1] for g in got] == [False, True, False, False, True]
    taken = spark.createDataFrame([("a.txt", ["a.txt", "a(1).txt"])], "n string, t array<string>")
    assert taken.select(names.free_name(F.col("n"), F.col("t"), 5)).first()[0] == "a(2).txt"


def test_globs():
    import re

    assert re.search(names.glob_regex("a/**/b?.txt", paths=True), "a/x/y/b1.txt")
    assert re.search(names.glob_regex("a/**/b?.txt", paths=True), "a/b1.txt")
    assert not re.search(names.glob_regex("a/*.txt", paths=True), "a/x/b.txt")
    assert re.search(names.glob_regex("*.RAR", ignore_case=True), "x.rar")
    assert not re.search(names.first_fit_regex("*.rar"), "a.rar.rar") and re.search(names.first_fit_regex("*.rar"), "a.rar")


def test_times(spark):
    dos = (44 << 25) | (2 << 21) | (29 << 16) | (12 << 11) | (30 << 5) | 5
    r = spark.createDataFrame([(dos, 133500000000000000, 5)], "d long, w long, z long").select(times.from_dos(F.col("d")).cast("string"), times.from_windows(F.col("w")).cast("string"), times.from_dos(F.lit(0)).isNull()).first()
    assert r[0] == "2024-02-29 12:30:10" and r[1].startswith("2024-01-17") and r[2]


def test_numbers_and_records():
    assert containers.vint(b"\xac\x02") == (300, 2)
    for bad in (b"\x80" * 10, b"\x80", b"\xff" * 9 + b"\x7f"):
        with pytest.raises(ValueError):
            containers.vint(bad)
    assert list(containers.records(b"no header here", 0)) == []


def test_packets_resync_and_fold(spark, tmp_path):
    s = hashlib.md5(b"set").digest()
    fid = packets.file_id(b"q" * 16, 10, "x.bin")
    other = packets.file_id(b"r" * 16, 10, "y.bin")
    whole = packets.encode("main", s, packets.main_body(8, [fid]))
    file = packets.encode("file", s, packets.file_body(fid, b"f" * 16, b"q" * 16, 10, "x.bin"))
    stray = packets.encode("file", s, packets.file_body(other, b"f" * 16, b"r" * 16, 10, "y.bin"))
    sums = packets.encode("slices", s, packets.slices_body(fid, [(b"1" * 16, 7), (b"2" * 16, 8)]))
    good = packets.encode("recovery", s, (3).to_bytes(4, "little") + b"12345678")
    short = packets.encode("recovery", s, (4).to_bytes(4, "little") + b"1234")
    broken = bytearray(file)
    broken[70] ^= 1
    data = b"junk" + whole + bytes(broken) + packets.MAGIC + b"x" + file + file + stray + sums + good + short
    assert [r["type"] for r in packets.scan(data)] == ["main", "file", "file", "file", "slices", "recovery", "recovery"]
    with pytest.raises(ValueError):
        list(packets.scan(data, most=3))
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.par2").write_bytes(data)
    (tmp_path / "in" / "b.txt").write_bytes(b"no packets")
    found = packets.sets(packets.packets(spark, str(tmp_path / "in")))
    assert [r["name"] for r in found["files"].collect()] == ["x.bin"]
    assert found["slices"].count() == 2 and [r["exponent"] for r in found["recovery"].collect()] == [3]
    kinds = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in containers.listing(spark, str(tmp_path / "in")).collect()}
    assert kinds == {"a.par2": "recovery", "b.txt": "other"}
    with pytest.raises(ValueError):
        containers.listing(spark, str(tmp_path / "in"), most=1)


def test_three_cycle_is_renames_not_swaps(spark):
    from lodestone.operators import placement

    w = spark.createDataFrame([(i, n, 1, n * 2, n * 3) for i, n in enumerate("abc")], "file_id long, name string, length long, md5_16k string, md5_full string")
    d = spark.createDataFrame([("b", 1, "aa", "aaa"), ("c", 1, "bb", "bbb"), ("a", 1, "cc", "ccc")], "path string, length long, md5_16k string, md5_full string")
    assert {r["class"] for r in placement.plan(w, d).collect()} == {"rename"}


def test_window_checksums():
    import zlib

    import numpy as np

    from lodestone.functions import windows

    data = np.random.default_rng(5).integers(0, 256, 3000, dtype=np.uint8)
    for size in (1, 2, 3, 7, 64, 100, 1023, 3000):
        got = windows.window_crcs(data, size)
        assert got.tolist() == [zlib.crc32(data[i : i + size].tobytes()) for i in range(3000 - size + 1)]
    keep, windows.SEGMENT = windows.SEGMENT, 50
    try:
        assert windows.window_crcs(data, 17).tolist() == [zlib.crc32(data[i : i + 17].tobytes()) for i in range(3000 - 16)]
    finally:
        windows.SEGMENT = keep
    assert windows.window_crcs(data[:4], 5).tolist() == []


def test_header_facts(spark):
    from lodestone.sources import containers, headers

    magic = containers.SIGNATURES["archive5"]
    digest = bytes(range(32))
    extra = headers.extra_record(headers.EXTRA_HASH, b"\0" + digest) + headers.extra_record(headers.EXTRA_LINK, b"\1\0" + headers.number(4) + b"x/yz")
    whole = magic + headers.record(headers.MAIN, headers.main_fields(3, solid=True))
    whole += headers.record(headers.FILE, headers.file_fields("dir/ä.txt", 10, attributes=33, mtime=5, crc=7, method=3), headers.SPLIT_AFTER, extra, b"0123456789")
    ends = [len(whole)]
    whole += headers.record(headers.SERVICE, headers.file_fields("CMT", None))
    whole += headers.record(headers.END, headers.number(1))
    broken = bytearray(whole)
    broken[ends[0] + 6] ^= 1
    secret = magic + headers.record(headers.ENCRYPTION, headers.number(0) + headers.number(0) + b"\x0f" + bytes(16)) + b"noise" * 9
    rows = [("whole", whole), ("broken", bytes(broken)), ("cut", whole[: ends[0] - 12]), ("secret", secret), ("other", b"PK.."), ("none", None), ("bare", magic)]
    found = headers.header_facts(spark.createDataFrame(rows, "path string, content binary"))
    by = {}
    for r in found.orderBy("path", "place").collect():
        by.setdefault(r["path"], []).append(r)
    assert [r["kind"] for r in by["whole"]] == ["main", "file", "service", "end"] and [r["kind"] for r in by["broken"]] == ["main", "file"]
    assert [r["kind"] for r in by["secret"]] == ["encryption"] and by["secret"][0]["encrypted"] and not set(by) & {"other", "none", "bare"}
    f = by["whole"][1]
    assert (f["name"], f["unpacked_size"], f["data_size"], f["attributes"], f["mtime"], f["crc32"], f["method"]) == ("dir/ä.txt", 10, 10, 33, 5, 7, 3)
    assert f["split_after"] and not f["split_before"] and f["blake2"] == digest.hex() and f["link"] == "x/yz" and not f["encrypted"]
    assert whole[f["data_offset"] : f["data_offset"] + f["data_size"]] == b"0123456789" and by["whole"][2]["unpacked_size"] is None
    v = {r["path"]: r for r in headers.volume_facts(found).collect()}
    assert v["whole"]["volume"] == 3 and v["whole"]["solid"] and v["whole"]["closed"] and v["whole"]["more_volumes"] and not v["broken"]["closed"] and v["secret"]["encrypted"]
    import hashlib

    assert headers.password_check(b"12345678" + hashlib.sha256(b"12345678").digest()[:4]) and not headers.password_check(b"123456789012")


def test_numbers_and_texts(spark):
    from pyspark.sql import functions as F

    from lodestone.functions import names, scalars

    row = spark.range(1).select(
        scalars.bit_length(F.lit(0)), scalars.bit_length(F.lit(255)), scalars.decimal_width(F.lit(0)), scalars.checked_volume(F.lit(1 << 20)), scalars.align16(F.lit(17)), scalars.align16(F.lit("18446744073709551615").cast("decimal(20,0)")),
        scalars.over_limit(F.lit(5), F.lit(None).cast("long"), F.lit(9), 5, 10, 8), names.made_by_create(F.lit(".a.tmp")), names.group_key(F.lit("d"), F.lit("data.bin"), F.lit("m")), names.group_key(F.lit("d"), F.lit("a.part1.rar"), F.lit("m")),
        names.after_traversal(F.lit("C:/x"), drives=False), names.after_traversal(F.lit("../../..x")), names.after_traversal(F.lit("a/../\x00b")),
    ).first()
    assert list(map(lambda x: int(x) if hasattr(x, "quantize") else x, row)) == [0, 8, 1, None, 32, None, "dictionary", True, "d:m", "d:a", "C:/x", "..x", ""]
