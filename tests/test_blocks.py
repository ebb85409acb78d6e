"""Disk arrays, volumes and containers on byte fixtures."""

import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from tracefield.operators import container as ct
from tracefield.operators import fsmeta as fs
from tracefield.operators import raid as rd

STRIPE = "array_id string, disk int, stripe_no bigint, data binary"


def xor(*bufs):
    out = bytearray(max(map(len, bufs)))
    for b in bufs:
        for i, x in enumerate(b):
            out[i] ^= x
    return bytes(out)


def volume(blocks):
    return b"".join(bytes(r.data) for r in blocks.orderBy("block_no").collect())


def test_raid0(spark):
    unit = 65536
    rows = [("a", d, s, bytearray([d + s]) * unit) for d in range(3) for s in range(10)]
    got = volume(rd.raid0(spark.createDataFrame(rows, STRIPE), 3))
    assert got == b"".join(bytes([d + s]) * unit for s in range(10) for d in range(3))


def test_raid1_is_the_input(spark):
    data = b"identical mirror data" * 1000
    units = [data[i : i + 4096] for i in range(0, len(data), 4096)]
    s = spark.createDataFrame([("a", d, i, bytearray(u)) for d in (0, 1) for i, u in enumerate(units)], STRIPE)
    bad = spark.createDataFrame([("a", 0, 5), ("a", 1, 2)], "array_id string, disk int, bad_sectors int")
    assert volume(rd.raid1(s, bad)) == data
    assert rd.best_member(bad).first().disk == 1


@pytest.mark.parametrize("layout", ["left", "right"])
@pytest.mark.parametrize("lost", [None, 0, 1, 2])
def test_raid5_round_trip(spark, layout, lost):
    rng = random.Random(4)
    unit, n, stripes = 64, 3, 7
    data = rng.randbytes(unit * (n - 1) * stripes)
    rows = []
    for s in range(stripes):
        par = s % n if layout == "left" else n - 1 - s % n
        parts = [data[(s * (n - 1) + i) * unit : (s * (n - 1) + i + 1) * unit] for i in range(n - 1)]
        cells = parts[:par] + [xor(*parts)] + parts[par:]
        rows += [("a", d, s, bytearray(c)) for d, c in enumerate(cells) if d != lost]
    b = rd.raid5(spark.createDataFrame(rows, STRIPE), n, layout)
    assert volume(b) == data
    assert rd.rebuild_confidence(b).first().confidence == 1.0


def test_raid5_two_lost_fails(spark):
    rows = [("a", 0, 0, bytearray(b"x" * 8))]
    b = rd.raid5(spark.createDataFrame(rows, STRIPE), 3)
    assert [r.data for r in b.collect()] == [None, None]
    assert rd.rebuild_confidence(b).first().confidence == 0.0


def test_raid_level_compat_order(spark):
    a, b = bytearray(b"A" * 4096), bytearray(b"B" * 4096)
    rows = [("a", d, s, x) for s in (0, 1) for d, x in enumerate((a, b, bytearray(xor(a, b))))]
    s = spark.createDataFrame(rows, STRIPE)
    blocks = s.withColumnRenamed("stripe_no", "block_no")
    assert rd.raid_level(blocks, s).first().level == "RAID5"
    assert rd.raid_level(blocks, s, compat=True).first().level == "RAID0"


def test_raid10_picks_members_by_key(spark):
    """Best members, unreadable units, a unit and a stripe that no disk has; no bytes go through the choice."""
    rows = [("a", 0, 0, b"p0"), ("a", 1, 0, b"p1"), ("a", 2, 0, None), ("a", 3, 0, b"q3"), ("a", 0, 2, None), ("a", 1, 2, None), ("a", 2, 2, b"r2"), ("a", 3, 2, b"r3")]
    s = spark.createDataFrame([(a, d, n, None if x is None else bytearray(x)) for a, d, n, x in rows], STRIPE)
    bad = spark.createDataFrame([("a", 0, 5), ("a", 1, 4), ("a", 2, 1)], "array_id string, disk int, bad_sectors int")
    out = rd.raid10(s, bad, 4)
    assert {r.block_no: bytes(r.data) for r in out.collect()} == {0: b"p1", 1: b"q3", 2: bytes(2), 3: bytes(2), 4: bytes(2), 5: b"r3"}
    assert "min_by(data" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_raid_level_of_repeated_content(spark):
    """The first stripe of both arrays is four equal units; only the later ones tell parity and plain stripes from mirrors."""
    a, b, c = (random.Random(i).randbytes(64) for i in range(3))
    later = {"five": [(a, b, c, xor(xor(a, b), c)), (b, c, xor(b, c), bytes(64))], "plain": [(a, b, c, bytes(64)), (b, a, xor(a, c), c)]}
    rows = [(k, d, n, bytearray(u)) for k, more in later.items() for n, units in enumerate([(a, a, a, a), *more]) for d, u in enumerate(units)]
    s = spark.createDataFrame(rows, STRIPE)
    blocks = s.withColumnRenamed("stripe_no", "block_no")
    assert {r.array_id: r.level for r in rd.raid_level(blocks, s).collect()} == {"five": "RAID5", "plain": "RAID0"}
    assert {r.mirrored for r in rd.mirror_compare(blocks).collect()} == {False}
    assert {r.mirrored for r in rd.mirror_compare(blocks, (0, 256, 2560)).collect()} == {True}


def test_vendor_marks(spark):
    rows = [("a", 0, bytearray(b"Intel Raid ISM Cfg Sig. x"), bytearray(b""), 100), ("a", 1, bytearray(b"zz"), bytearray(b"..\xa9\x2b\x4e\xfc"), 1000), ("a", 2, bytearray(b"z"), bytearray(b"z"), 9)]
    got = rd.raid_signature(spark.createDataFrame(rows, "array_id string, disk int, head binary, tail binary, size bigint")).orderBy("disk").collect()
    assert [(r.vendor, r.offset) for r in got] == [("intel_matrix", 0), ("linux_mdadm_1x", 996), (None, None)]


def test_ntfs_boot_sector(spark):
    b = bytearray(512)
    b[0:3], b[3:11] = b"\xeb\x52\x90", b"NTFS    "
    struct.pack_into("<HB", b, 0x0B, 512, 8)
    struct.pack_into("<QQQ", b, 0x28, 1_000_000, 1000, 500000)
    struct.pack_into("<I", b, 0x48, 0x12345678)
    df = spark.createDataFrame([("v", b)], "id string, data binary")
    r = fs.ntfs_boot(df, "id").first()
    assert (r.bytes_per_sector, r.sectors_per_cluster, int(r.total_sectors), r.serial) == (512, 8, 1_000_000, 0x12345678)
    assert int(r.mft_offset) == 1000 * 4096 and int(r.total_size) == 512_000_000
    assert df.select(fs.fs_detect(df.data)).first()[0] == "NTFS"


def test_ext4_superblock(spark):
    b = bytearray(2048)
    struct.pack_into("<I", b, 1024 + 4, 100000)
    struct.pack_into("<I", b, 1024 + 0x18, 1)
    struct.pack_into("<H", b, 1024 + 0x38, 0xEF53)
    b[1024 + 0x78 : 1024 + 0x78 + 14] = b"TestEXT4Volume"
    df = spark.createDataFrame([("v", b)], "id string, data binary")
    r = fs.ext4_super(df, "id").first()
    assert (r.blocks, r.block_size, r.total_size, r.label) == (100000, 2048, 204_800_000, "TestEXT4Volume")
    assert df.select(fs.fs_detect(df.data)).first()[0] == "EXT4"


def test_mft_record(spark):
    rec = bytearray(1024)
    rec[0:4] = b"FILE"
    struct.pack_into("<HH", rec, 0x14, 56, 1)
    struct.pack_into("<IIQ", rec, 56, 0x80, 24, 1024)
    struct.pack_into("<I", rec, 80, 0xFFFFFFFF)
    img = bytearray(4096) + rec + bytearray(1024) + rec[:500]
    df = spark.createDataFrame([("v", img)], "id string, data binary")
    from pyspark.sql import functions as F

    rows = fs.mft_scan(fs.mft_records(df, "id", F.lit(4096).cast("bigint")), "id").collect()
    assert [(r.inode, r.name, r.size, r.is_deleted, r.is_directory) for r in rows] == [(0, "MFT_Record_0", 1024, False, False)]


@pytest.mark.parametrize("sizes", [[100], [1000], [1024], [5000], [1, 3000, 700, 1023]])
def test_file_table_of_a_chunked_volume(spark, sizes):
    """Any chunk sizes give the records of the whole volume; a lost chunk costs the records it touches only."""
    rng = random.Random(sum(sizes))
    data = rng.randbytes(2500) + b"".join(b"FILE" + rng.randbytes(1020) for _ in range(12)) + b"FILE rest"
    rows, at = [], 0
    while at < len(data):
        n = rng.choice(sizes)
        rows.append(("v", at, bytearray(data[at : at + n])))
        at += n
    rng.shuffle(rows)
    tables = spark.createDataFrame([("v", 2500)], "image_id string, mft_offset bigint")
    schema = "image_id string, base_offset bigint, data binary"
    read = lambda r: {x.record_no: bytes(x.record) for x in fs.mft_slices(spark.createDataFrame(r, schema), tables).collect()}
    assert read(rows) == {i: data[2500 + 1024 * i : 3524 + 1024 * i] for i in range(12)}
    lost = next(r for r in rows if r[1] >= 2500 + 1024)
    touched = {i for i in range(12) if lost[1] < 3524 + 1024 * i and lost[1] + len(lost[2]) > 2500 + 1024 * i}
    assert set(read([r for r in rows if r is not lost])) == set(range(12)) - touched


def test_volume_bytes_do_not_meet_in_one_task(spark, monkeypatch):
    """The chunks of a volume are not shuffled by its name, and torn records go to partitions by their bytes."""
    monkeypatch.setattr(fs, "PART_BYTES", 1 << 12, raising=False)
    chunks = spark.createDataFrame([("v", 1000 * i, bytearray(b"x" * 1000)) for i in range(40)], "image_id string, base_offset bigint, data binary")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = fs.mft_slices(chunks, spark.createDataFrame([("v", 0)], "image_id string, mft_offset bigint"))
        plan = out._jdf.queryExecution().toString()
        assert not re.search(r"hashpartitioning\(image_id#\d+, \d", plan)
        assert re.search(r"hashpartitioning\(image_id#\d+, record_no#\d+L, 11\), REPARTITION_BY_NUM", plan)
        assert out.count() == 39
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def atom(kind, body=b"", size=None):
    return struct.pack(">I", len(body) + 8 if size is None else size) + kind + body


@pytest.mark.parametrize("step", [5, 64, 997])
def test_atoms_over_chunks_are_those_of_the_whole_file(spark, step):
    """Nested, wide, open-ended, overlong and random atoms; headers and zero runs over chunk edges; long chains."""
    rng = random.Random(step)
    wide = lambda kind, body: struct.pack(">I", 1) + kind + struct.pack(">Q", len(body) + 16) + body
    trak = atom(b"trak", atom(b"mdia", atom(b"minf", atom(b"stbl", atom(b"stsz", bytes(40)) + wide(b"free", b"x")))))
    files = {
        "chain": b"".join(atom(rng.choice([b"free", b"moof", b"mdat"]), rng.randbytes(rng.choice([0, 3, 40]))) for _ in range(120)),
        "nested": atom(b"ftyp", b"isom") + atom(b"moov", trak + atom(b"mvhd", bytes(20)) + trak) + wide(b"mdat", rng.randbytes(300)),
        "open": atom(b"ftyp", b"isom") + atom(b"moov", atom(b"trak", atom(b"edts", size=0) + bytes(30))) + struct.pack(">I", 0) + b"moov" + atom(b"mvhd", b"12") + bytes(50),
        "over": atom(b"free", b"1") + atom(b"moov", atom(b"trak", b"123", size=400)) + atom(b"mdat", b"m" * 100, size=0xFFFFFFFF),
        "zeros": bytes(200), "short": b"\0\0\0", "eight": atom(b"free"), "noise": rng.randbytes(3000), "small": bytes(rng.choice([0, 0, 0, 8, 9, 12, 1]) for _ in range(2000)),
    }
    rows = [(n, i, at, bytearray(d[at : at + step])) for n, d in files.items() for i, at in enumerate(range(0, len(d), step))]
    rng.shuffle(rows)
    chunks = spark.createDataFrame(rows, "image_id string, chunk_no bigint, base_offset bigint, data binary")
    got = sorted(tuple(-1 if x is None else x for x in r) for r in ct.atom_walk_chunks(chunks, 256).collect())
    assert got == sorted(tuple(-1 if x is None else x for x in (n, *a)) for n, d in files.items() for a in ct.walk_atoms(d, 0, len(d)))


def test_mp4_without_moov(spark):
    good = atom(b"ftyp", b"isom" + b"\0" * 12) + atom(b"free") + atom(b"mdat", b"m" * 100)
    bad = atom(b"ftyp", b"isom") + atom(b"mdat", b"m" * 100, size=0xFFFFFFFF)
    files = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(bad))], "file_id bigint, data binary")
    atoms = ct.atom_walk(files)
    assert [(r.atom_type, r.offset, r.size) for r in atoms.filter("file_id = 1").orderBy("offset").collect()] == [("ftyp", 0, 24), ("free", 24, 8), ("mdat", 32, 108)]
    assert [r.atom_type for r in atoms.filter("file_id = 2").collect()] == ["ftyp"]
    sizes = files.selectExpr("file_id", "cast(octet_length(data) as bigint) as file_size")
    flags = {r.file_id: set(r.flags) for r in ct.atom_flags(atoms, sizes).collect()}
    assert flags[1] == {"MISSING_ATOMS", "METADATA_CORRUPTION"}
    assert flags[2] == {"MISSING_ATOMS", "METADATA_CORRUPTION", "STRUCTURE_CORRUPTION"}


def scan_brute(d, tag):
    out, at = [], 0
    while at < len(d) - 8:
        p = d.find(tag, at)
        if p == -1:
            break
        if p >= 4 and 8 <= struct.unpack_from(">I", d, p - 4)[0] <= len(d) - (p - 4):
            size = struct.unpack_from(">I", d, p - 4)[0]
            out.append((p - 4, size))
            at = p - 4 + size
        else:
            at = p + 1
    return out


@pytest.mark.parametrize("chunk", [5, 33, 1 << 20])
def test_atom_scan_against_brute_force(spark, chunk):
    rng = random.Random(9)
    d = b"".join(rng.choice([atom(b"mdat", b"x" * rng.randrange(40)), atom(b"moov", atom(b"mdat", b"y" * 9)), b"mdat", b"\0\0\0\x14mdat", rng.randbytes(11), struct.pack(">I", 60) + b"moov"]) for _ in range(120))
    rows = [("i", k, k * chunk, bytearray(d[k * chunk : (k + 1) * chunk])) for k in range(-(-len(d) // chunk))]
    chunks = spark.createDataFrame(rows, "image_id string, chunk_no bigint, base_offset bigint, data binary")
    got = ct.atom_scan(chunks, ["moov", "mdat"], span=256).collect()
    for t in ("moov", "mdat"):
        assert sorted((r.offset, r.size) for r in got if r.atom_type == t) == scan_brute(d, t.encode())


def test_moov_mdat_matching_against_brute_force(spark):
    rng = random.Random(11)
    moov = [(img, i * 10, int(rng.choice([1000, 5000, 20000, 21000, 90000]) * rng.uniform(0.8, 1.2))) for img in "ab" for i in range(60)]
    mdat = [(img, 5 + i * 10, int(rng.choice([1000, 5000, 20000, 22000, 400000]) * rng.uniform(0.8, 1.2))) for img in "ab" for i in range(60)]
    m = spark.createDataFrame(moov, "image_id string, offset bigint, expected bigint")
    x = spark.createDataFrame(mdat, "image_id string, offset bigint, size bigint")
    want = set()
    for img in "ab":
        free = sorted(((o, s) for i, o, s in mdat if i == img))
        for _, off, exp in sorted(r for r in moov if r[0] == img):
            fit = [(abs(s - 8 - exp), s, o) for o, s in free if abs(s - 8 - exp) < exp * 0.2]
            if fit:
                low = min(f[0] for f in fit)
                _, s, o = min((f for f in fit if f[0] == low), key=lambda f: f[2])
                free.remove((o, s))
                want.add((img, off, o))
    for block in (20_000, 7):
        got = [(r.image_id, r.moov_offset, r.mdat_offset) for r in ct.match_moov_mdat(m, x, block=block).collect()]
        assert len(got) == len(want) and set(got) == want, block


def test_moov_mdat_matching_where_all_sizes_compete(spark):
    """One image, 10,000 movies, sizes within one tolerance, a third of them equal."""
    rng = random.Random(5)
    size = lambda: 50_000 if rng.random() < 0.33 else rng.randrange(48_000, 52_000)
    n = 10_000
    moov = [("a", i * 10, size()) for i in rng.sample(range(n), n)]
    mdat = [("a", 5 + i * 10, size() + 8) for i in rng.sample(range(n), n)]
    by_size: dict[int, list[int]] = {}
    for _, off, s in sorted(mdat):
        by_size.setdefault(s - 8, []).append(off)
    want = set()
    for _, off, exp in sorted(moov):
        for gap in range(int(exp * 0.2)):
            near = [(by_size[s][0], s) for s in {exp - gap, exp + gap} if by_size.get(s)]
            if near:
                best, s = min(near)
                by_size[s].pop(0)
                want.add((off, best))
                break
    m = spark.createDataFrame(moov, "image_id string, offset bigint, expected bigint")
    x = spark.createDataFrame(mdat, "image_id string, offset bigint, size bigint")
    for block in (20_000, 2_500):
        got = [(r.moov_offset, r.mdat_offset) for r in ct.match_moov_mdat(m, x, block=block).collect()]
        assert len(got) == len(want) and set(got) == want, block


def test_moov_mdat_matching_of_thousands_takes_one_round(spark, monkeypatch):
    """More media than 20,000 on one image, all of near sizes: nothing is handed from block to block."""
    n, rounds = 21_000, []
    one = ct._propose
    monkeypatch.setattr(ct, "_propose", lambda *a: (rounds.append(1), one(*a))[1])
    i = spark.range(n)
    m = i.select(F.lit("a").alias("image_id"), F.col("id").alias("offset"), (F.lit(50_000) + F.col("id") % 1_000).alias("expected"))
    x = i.select(F.lit("a").alias("image_id"), (F.col("id") + n).alias("offset"), (F.lit(50_508) + F.col("id") % 1_000).alias("size"))
    got = ct.match_moov_mdat(m, x)
    assert got.count() == n and got.select("mdat_offset").distinct().count() == n
    assert len(rounds) == 1
