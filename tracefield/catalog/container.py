"""Registered container and filesystem queries, over bytes composed from the given rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefield.operators import container as ct
from tracefield.operators import fsmeta as fs
from tracefield.operators import ordered as od
from tracefield.sources import tables as tb

QUERIES, ORACLE = {}, {}


def be(x, n):
    return F.lpad(F.hex(x.cast("bigint")), 2 * n, "0")


def le(x, n):
    h = be(x, n)
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(n - 1, -1, -1)])


def zeros(n):
    return F.repeat(F.lit("00"), F.lit(n))


def asc(s):
    return F.lit(s.encode().hex())


# --- movie files: text as media bytes -----------------------------------------
def mp4_files(spark, d):
    """ftyp, moov (mvhd, trak with a sample table) and mdat around each text.

    By file id: the atoms change order or lack, the media atom has a 64-bit, an
    open or an overlong size.
    """
    i, n = F.col("file_id"), F.octet_length("data")
    k = (i % 4).cast("bigint")
    stsz = F.concat(be(20 + 4 * k, 4), asc("stsz"), zeros(4), F.when(k == 0, be(F.lit(100), 4)).otherwise(be(F.lit(0), 4)),
                    F.when(k == 0, be(F.floor(n / 100) + 1, 4)).otherwise(be(k, 4)), F.repeat(be(F.floor(n / 3), 4), k.cast("int")))
    mvhd = F.concat(be(F.lit(32), 4), asc("mvhd"), zeros(8), be(i + 1000, 4), zeros(4), be(n * 2, 4), zeros(4))
    moov = F.concat(be(8 + 32 + 8 + 20 + 4 * k, 4), asc("moov"), mvhd, be(8 + 20 + 4 * k, 4), asc("trak"), stsz)
    long = i % 7 == 1
    over = F.when(i % 11 == 0, 5000).otherwise(0)
    head = F.when(long, F.concat(be(F.lit(1), 4), asc("mdat"), be(16 + n + over, 8))).when(i % 7 == 2, F.concat(zeros(4), asc("mdat"))).otherwise(
        F.concat(be(8 + n + over, 4), asc("mdat")))
    mdat = F.concat(head, F.hex("data"))
    ftyp = F.concat(be(F.lit(24), 4), asc("ftypisom"), zeros(12))
    free = F.concat(be(F.lit(8), 4), asc("free"))
    body = F.when(i % 3 == 0, F.concat(ftyp, moov, mdat)).when(i % 3 == 1, F.concat(ftyp, mdat, moov)).otherwise(F.concat(ftyp, free, mdat))
    return tb.ev_bytes(spark, d).select("file_id", F.unhex(body).alias("data"), F.unhex(moov).alias("moov"))


ATOMS = f"""p as (select file_id, size as n, 68 + 4*(file_id % 4) as ml, case when file_id % 7 = 1 then 16 else 8 end as h, file_id % 7 = 2 as to_end,
   file_id % 11 = 0 and file_id % 7 <> 2 as over, file_id % 3 as o from {tb.EV_BYTES}),
 q as (select *, 24 + h + n + case o when 2 then 8 else ml end as file_size, case o when 0 then 24 + ml when 1 then 24 else 32 end as md,
   case when o = 0 then 24 when o = 1 and not over and not to_end then 24 + h + n end as mo from p),
 atoms as (select file_id, 'ftyp' as atom_type, 0 as "offset", 24 as size, 8 as header_size, 0 as level, null::bigint as parent_offset from q
  union all select file_id, 'free', 24, 8, 8, 0, null from q where o = 2
  union all select file_id, 'mdat', md, case when to_end then file_size - md else h + n end, h, 0, null from q where not over
  union all select file_id, 'moov', mo, ml, 8, 0, null from q where mo is not null
  union all select file_id, 'mvhd', mo + 8, 32, 8, 1, mo from q where mo is not null
  union all select file_id, 'trak', mo + 40, ml - 40, 8, 1, mo from q where mo is not null
  union all select file_id, 'stsz', mo + 48, ml - 48, 8, 2, mo + 40 from q where mo is not null)"""
QUERIES["g6_atom_walk"] = lambda spark, d: ct.atom_walk(mp4_files(spark, d))
ORACLE["g6_atom_walk"] = f"with {ATOMS} select * from atoms"



def g6_chunks(spark, d):
    """The same files cut in chunks of 1,021 bytes."""
    f = mp4_files(spark, d).select(F.col("file_id").alias("image_id"), "data")
    n = F.ceil(F.octet_length("data") / 1021).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.cast("bigint").alias("chunk_no"), (i.cast("bigint") * 1021).alias("base_offset"), F.substring("data", i * 1021 + 1, F.lit(1021)).alias("data")))
    chunks = tb.checkpoint(f.select("image_id", F.inline(cut)))
    return ct.atom_walk_chunks(chunks, 1 << 14).withColumnRenamed("image_id", "file_id")


QUERIES["g6_atom_walk_chunks"] = g6_chunks
ORACLE["g6_atom_walk_chunks"] = ORACLE["g6_atom_walk"]


def avi_files(spark, d):
    """RIFF files around each text: header list and movie list, either lacking by file id; every 13th is cut short."""
    i, n = F.col("file_id"), F.octet_length("data")
    hdrl = F.when(i % 5 == 1, F.lit("")).otherwise(F.concat(asc("LIST"), le(F.lit(68), 4), asc("hdrl"), asc("avih"), le(F.lit(56), 4), zeros(56)))
    body = F.concat(asc("00dc"), le(n, 4), F.hex("data"), F.repeat(F.lit("00"), (n % 2).cast("int")))
    movi = F.when(i % 5 == 2, F.lit("")).otherwise(F.concat(asc("LIST"), le(12 + n + n % 2, 4), asc("movi"), body))
    size = 4 + F.when(i % 5 == 1, 0).otherwise(76) + F.when(i % 5 == 2, 0).otherwise(20 + n + n % 2)
    whole = F.concat(asc("RIFF"), le(size + F.when(i % 13 == 7, 1000).otherwise(0), 4), asc("AVI "), hdrl, movi)
    return tb.ev_bytes(spark, d).select("file_id", F.unhex(whole).alias("data"))


RIFF = f"""p as (select file_id, size as n, size % 2 as pad, case when file_id % 5 = 1 then 0 else 76 end as h, case when file_id % 5 = 2 then 0 else 20 + size + size % 2 end as m
   from {tb.EV_BYTES} where file_id % 13 <> 7),
 chunks as (select file_id, 'AVI ' as chunk, 0 as "offset", 4 + h + m as size, 0 as level, null::bigint as parent_offset from p
  union all select file_id, 'hdrl', 12, 68, 1, 0 from p where h > 0 union all select file_id, 'avih', 24, 56, 2, 12 from p where h > 0
  union all select file_id, 'movi', 12 + h, m - 8, 1, 0 from p where m > 0 union all select file_id, '00dc', 24 + h, n, 2, 12 + h from p where m > 0)"""
QUERIES["g6_riff_walk"] = lambda spark, d: ct.riff_walk(avi_files(spark, d))
ORACLE["g6_riff_walk"] = f"with {RIFF} select * from chunks"
QUERIES["r13_avi_flags"] = lambda spark, d: (lambda f: ct.avi_flags(ct.riff_walk(f), f).withColumn("flags", F.array_join("flags", ",")))(avi_files(spark, d))
ORACLE["r13_avi_flags"] = f"""select file_id, case when file_id % 13 = 7 then 'NOT_AVI,HDRL_MISSING,MOVI_MISSING' when file_id % 5 = 1 then 'HDRL_MISSING' when file_id % 5 = 2 then 'MOVI_MISSING' else '' end as flags from {tb.EV_BYTES}"""

QUERIES["g6_moov_structure"] = lambda spark, d: ct.moov_structure(ct.atom_walk(mp4_files(spark, d))).withColumn("damage", F.array_join("damage", ","))
ORACLE["g6_moov_structure"] = f"""with {ATOMS} select file_id, mo is not null as has_moov, mo is not null as has_mvhd, case when mo is null then 0 else 1 end::bigint as tracks,
 case when mo is null then 'HEADER_DAMAGE' else '' end as damage from q where exists (select 1 from atoms a where a.file_id = q.file_id)"""


def seconds(spark, d):
    """Movie headers of both versions, made of the file's key and size."""
    f = tb.ev_files(spark, d).select("file_id", "size")
    i, n = F.col("file_id"), F.col("size")
    head = F.concat(be(F.lit(108), 4), asc("mvhd"))
    v0 = F.concat(head, zeros(4), zeros(8), be(i % 3 * 300, 4), be(n, 4), zeros(80))
    v1 = F.concat(head, F.lit("01000000"), zeros(16), be(i % 3 * 300, 4), be(n * 5000000000, 8), zeros(80))
    moov = F.concat(zeros(4), asc("moov"), F.when(i % 5 == 4, F.lit("")).when(i % 2 == 0, v0).otherwise(v1))
    return f.select("file_id", ct.movie_seconds_udf(F.unhex(moov)).alias("x")).select("file_id", "x.*")


QUERIES["r12_movie_seconds"] = seconds
ORACLE["r12_movie_seconds"] = f"""select file_id, case when file_id % 5 <> 4 then file_id % 2 end::int as version, case when file_id % 5 <> 4 then file_id % 3 * 300 end::bigint as time_scale,
 case when file_id % 5 <> 4 and file_id % 3 > 0 then size * (case when file_id % 2 = 0 then 1 else 5000000000 end)::double / (file_id % 3 * 300)::double end as seconds from {tb.EV_FILES}"""

QUERIES["r12_expected_mdat"] = lambda spark, d: mp4_files(spark, d).select("file_id", ct.expected_mdat_udf(F.col("moov")).alias("x")).select("file_id", "x.*")
ORACLE["r12_expected_mdat"] = f"""select file_id, floor((case when file_id % 4 = 0 then 100*(size // 100 + 1) when size // 3 = 0 then 10485760 else (file_id % 4)*(size // 3) end)::double * 1.1::double)::bigint as expected_mdat,
 size*2 as duration, file_id + 1000 as created, 1 as tracks from {tb.EV_BYTES}"""

NEED = ["ftyp", "moov", "mdat", "stsz"]


def sizes(spark, d):
    return mp4_files(spark, d).select("file_id", F.octet_length("data").cast("bigint").alias("file_size"))


def flagged(spark, d):
    return ct.atom_flags(ct.atom_walk(mp4_files(spark, d)), sizes(spark, d), NEED)


FLAGS = f"""{ATOMS}, g as (select q.file_id, file_size, mo is not null as has_moov, not over as has_mdat, coalesce(mo < md and not over, false) as moov_first,
   24 + case when o = 2 then 8 else 0 end + case when over then 0 when to_end then file_size - md else h + n end + case when mo is not null then ml else 0 end as covered, mo, over from q),
 flagged as (select *, list_filter([case when over or mo is null then 'MISSING_ATOMS' end, case when abs(covered - file_size) > 1024 then 'TRUNCATED_FILE' end,
   case when not has_moov then 'METADATA_CORRUPTION' end, case when not has_mdat then 'STRUCTURE_CORRUPTION' end], lambda x: x is not null) as flags from g)"""
QUERIES["r13_atom_flags"] = lambda spark, d: flagged(spark, d).select("file_id", "file_size", "has_moov", "has_mdat", "moov_first", F.array_join("flags", ",").alias("flags"))
ORACLE["r13_atom_flags"] = f"with {FLAGS} select file_id, file_size, has_moov, has_mdat, moov_first, array_to_string(flags, ',') as flags from flagged"

SCORES = f"""{FLAGS}, sc as (select *, greatest(1.0::double - case when list_contains(flags, 'MISSING_ATOMS') then 0.4::double else 0 end - case when list_contains(flags, 'TRUNCATED_FILE') then 0.2::double else 0 end, 0) as structure,
  greatest(1.0::double - case when not has_moov then 0.6::double else 0 end - case when list_contains(flags, 'METADATA_CORRUPTION') then 0.3::double else 0 end, 0) as metadata,
  greatest(1.0::double - case when not has_mdat then 0.5::double else 0 end, 0) as playback from flagged), scored as (select *, structure*0.4 + metadata*0.3 + playback*0.3 as overall from sc)"""
QUERIES["r14_integrity_scores"] = lambda spark, d: ct.integrity_scores(flagged(spark, d)).select("file_id", *[F.round(c, 6).alias(c) for c in ("structure", "metadata", "playback", "overall")])
ORACLE["r14_integrity_scores"] = f"with {SCORES} select file_id, round(structure, 6) as structure, round(metadata, 6) as metadata, round(playback, 6) as playback, round(overall, 6) as overall from scored"


def r15(spark, d):
    p = ct.repair_plan(ct.integrity_scores(flagged(spark, d)))
    return p.select("file_id", "severity", F.array_join("tools", ",").alias("tools"), F.array_join("strategies", ",").alias("strategies"), "success_rate", "risk", F.array_join("recommendations", "|").alias("recommendations"))


QUERIES["r15_repair_plan"] = r15
ORACLE["r15_repair_plan"] = f"""with {SCORES} select file_id, case when overall >= 0.8 then 'minimal' when overall >= 0.6 then 'mild' when overall >= 0.3 then 'moderate' else 'severe' end as severity,
 case when overall >= 0.8 then 'ffmpeg' when overall >= 0.6 then 'untrunc,ffmpeg' when overall >= 0.3 then 'mp4recover,untrunc,ffmpeg' else 'photorec,mp4recover,ai_enhancement' end as tools,
 case when overall >= 0.8 then 'container_remux' when overall >= 0.6 then 'header_reconstruction,container_remux' when overall >= 0.3 then 'deep_scan,fragment_recovery,ai_enhancement' else 'fragment_recovery,deep_scan,custom_algorithms' end as strategies,
 case when overall >= 0.8 then 0.9 when overall >= 0.6 then 0.7 when overall >= 0.3 then 0.5 else 0.2 end::double as success_rate,
 case when overall >= 0.8 then 'low' when overall >= 0.6 then 'medium' when overall >= 0.3 then 'high' else 'critical' end as risk,
 array_to_string(list_filter([case when mo is null then 'Critical: moov atom missing - try mp4recover for deep scan' end, case when mo is null then 'Use photorec for fragment recovery if other tools fail' end,
  case when list_contains(flags, 'TRUNCATED_FILE') then 'File appears truncated - check for additional fragments' end, case when list_contains(flags, 'TRUNCATED_FILE') then 'Use FFmpeg with -avoid_negative_ts make_zero' end,
  case when not moov_first and has_moov and has_mdat then 'moov atom after mdat - use FFmpeg to optimize structure' end,
  case when overall < 0.5 then 'Severe corruption detected - try multiple tools in sequence' end, case when overall < 0.5 then 'Consider AI-enhanced repair for best quality recovery' end], lambda x: x is not null), '|') as recommendations from scored"""

QUERIES["r19_reorder_atoms"] = lambda spark, d: ct.reorder_atoms(ct.atom_walk(mp4_files(spark, d)))
ORACLE["r19_reorder_atoms"] = f"""with {ATOMS} select file_id, atom_type, "offset" as old_offset, a.size, (case atom_type when 'ftyp' then 0 when 'moov' then 24 else 24 + ml end)::bigint as new_offset
 from atoms a join q using (file_id) where level = 0 and atom_type in ('ftyp','moov','mdat') and mo is not null and not over""".replace("a.size", "a.size as size")

QUERIES["u2_missing_atoms"] = lambda spark, d: ct.missing_atoms(ct.atom_walk(mp4_files(spark, d)), sizes(spark, d), NEED)
ORACLE["u2_missing_atoms"] = f"with {ATOMS} select file_id, unnest(['moov', 'stsz']) as atom_type from q where mo is null union all select file_id, 'mdat' from q where over"


def j4(spark, d):
    i = tb.index_rows(spark, d)
    m = i.groupBy("file_id").agg(F.min("slot").alias("mdat_offset"), ((F.max("slot") - F.min("slot")) * 0.75).cast("bigint").alias("mdat_size"))
    return ct.chunk_offsets_in_mdat(i.select("file_id", "offset"), m).withColumn("invalid_ratio", F.round("invalid_ratio", 6))


QUERIES["j4_chunk_offsets_in_mdat"] = j4
ORACLE["j4_chunk_offsets_in_mdat"] = f"""with m as (select file_id, min(slot) as a, floor((max(slot) - min(slot))*0.75)::bigint as z from {tb.INDEX} group by 1)
select i.file_id, count(*) as offsets, count(*) filter (not ("offset" >= a + 8 and "offset" < a + z)) as invalid, round(count(*) filter (not ("offset" >= a + 8 and "offset" < a + z))/count(*), 6) as invalid_ratio
from {tb.INDEX} i join m on m.file_id = i.file_id group by 1"""


def movie_image(spark, d):
    """The movie files one after another, per language, as one image each."""
    f = mp4_files(spark, d).join(tb.ev_bytes(spark, d).select("file_id", F.col("ext").alias("image_id")), "file_id")
    c = f.select("image_id", F.col("file_id").alias("chunk_no"), "data")
    s = c.select("image_id", "chunk_no", F.octet_length("data").cast("bigint").alias("n"))
    o = od.running_sum(s, ["image_id"], ["chunk_no"], F.floor(F.col("chunk_no") / 512), F.col("n"), "base_offset", include_current=False)
    # chunk numbers must be dense so that neighbours can be found
    o = od.dense_index(o, ["image_id"], ["chunk_no"], F.floor(F.col("chunk_no") / 512), "dense")
    return c.join(o.select("image_id", "chunk_no", "base_offset", "dense"), ["image_id", "chunk_no"]).select("image_id", F.col("dense").alias("chunk_no"), "base_offset", "data")


def r11(spark, d):
    chunks = movie_image(spark, d)
    return ct.atom_scan(chunks, ["moov", "mdat"], span=1 << 16)


QUERIES["r11_atom_scan"] = r11


def j3(spark, d):
    f = mp4_files(spark, d).select("file_id", ct.expected_mdat_udf(F.col("moov")).alias("x"), F.octet_length("data").alias("n"))
    s = tb.ev_files(spark, d).select("file_id", F.col("ext").alias("image_id"), "size")
    moov = f.join(s, "file_id").select("image_id", F.col("file_id").alias("offset"), F.col("x.expected_mdat").alias("expected"))
    mdat = s.select("image_id", F.col("file_id").alias("offset"), (F.col("size") + 8).alias("size"))
    return ct.match_moov_mdat(moov, mdat)


QUERIES["j3_match_moov_mdat"] = j3


# --- volumes ---------------------------------------------------------------------
def volumes(spark, d):
    """A 2 KiB volume start per order: NTFS, EXT4 or neither, by key."""
    o = tb.spread(tb.load(spark, d, "orders").select("o_orderkey", "o_custkey"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    spc = F.element_at(F.array(F.lit(1), F.lit(8), F.lit(16)), (k % 3 + 1).cast("int"))
    ntfs = F.concat(F.lit("EB5290"), asc("NTFS    "), le(F.lit(512), 2), le(spc, 1), zeros(0x28 - 0x0E), le(k * 1000 + 7, 8), le(c + 3, 8), le(k + 500000, 8), zeros(8), le(c * 65537 + 1, 8), zeros(2048 - 0x50))
    label = F.rpad(F.hex(F.concat(F.lit("vol"), c.cast("string"))), 32, "0")
    ext4 = F.concat(zeros(1024), zeros(4), le(k + 100000, 4), zeros(16), le(k % 4, 4), zeros(0x38 - 0x1C), F.lit("53EF"), zeros(0x78 - 0x3A), label, zeros(1024 - 0x88))
    alt = F.concat(F.lit("EB5290"), zeros(100), asc("xNTFS"), zeros(2048 - 108))
    kind = k % 4
    return o.select("o_orderkey", F.unhex(F.when(kind == 0, ntfs).when(kind == 1, ext4).when(kind == 2, alt).otherwise(zeros(2048))).alias("data"))


QUERIES["f7_fs_detect"] = lambda spark, d: volumes(spark, d).select("o_orderkey", fs.fs_detect(F.col("data")).alias("fs"))
ORACLE["f7_fs_detect"] = "select o_orderkey, case o_orderkey % 4 when 0 then 'NTFS' when 1 then 'EXT4' when 2 then 'NTFS' else 'UNKNOWN' end as fs from orders"
QUERIES["f8_ntfs_boot"] = lambda spark, d: (lambda x: x.select("o_orderkey", *[F.col(c).cast("bigint").alias(c) for c in x.columns[1:]]))(fs.ntfs_boot(volumes(spark, d).filter(F.substring("data", 4, 4) == F.lit(b"NTFS")), "o_orderkey"))
ORACLE["f8_ntfs_boot"] = """select o_orderkey, 512 as bytes_per_sector, s as sectors_per_cluster, o_orderkey*1000 + 7 as total_sectors, o_custkey + 3 as mft_cluster, o_orderkey + 500000 as mirror_cluster, o_custkey*65537 + 1 as serial,
 512*s as cluster_size, (o_orderkey*1000 + 7)*512 as total_size, (o_custkey + 3)*512*s as mft_offset from (select *, case o_orderkey % 3 when 0 then 1 when 1 then 8 else 16 end as s from orders where o_orderkey % 4 = 0)"""
QUERIES["f9_ext4_super"] = lambda spark, d: fs.ext4_super(volumes(spark, d).filter(fs.fs_detect(F.col("data")) == "EXT4"), "o_orderkey")
ORACLE["f9_ext4_super"] = """select o_orderkey, o_orderkey + 100000 as blocks, 1024*(1 << (o_orderkey % 4)::int) as block_size, (o_orderkey + 100000)*1024*(1 << (o_orderkey % 4)::int) as total_size, 'vol' || o_custkey as label from orders where o_orderkey % 4 = 1"""


def mft_rows(spark, d):
    """A file-table record per file entry: name, size and flags from the entry."""
    e = tb.spread(tb.fs_entries(spark, d))
    name = F.concat(F.lit("f"), F.col("inode").cast("string"), F.lit(".dat"))
    n = F.length(name)
    wide = F.hex(F.encode(name, "UTF-16LE"))
    alen = (24 + 66 + 2 * n + 6).cast("bigint")
    fname = F.concat(le(F.lit(0x30), 4), le(alen, 4), zeros(16), zeros(64), le(n, 1), zeros(1), wide, zeros(6))
    data = F.concat(le(F.lit(0x80), 4), le(F.lit(24), 4), le(F.floor("size"), 8), zeros(8))
    flags = F.when(F.col("is_deleted"), 0).otherwise(1) + F.when(F.col("inode") % 10 == 0, 2).otherwise(0)
    mark = F.when(F.col("inode") % 17 == 16, asc("BAAD")).otherwise(asc("FILE"))
    body = F.concat(mark, zeros(16), le(F.lit(56), 2), le(flags, 2), zeros(32), F.when(F.col("inode") % 9 == 0, F.lit("")).otherwise(fname), data, F.lit("FFFFFFFF"))
    return e.select(F.lit("vol").alias("image_id"), F.col("inode").alias("record_no"), F.unhex(F.rpad(body, 2048, "0")).alias("record"))


def ntfs_volume(spark, d):
    """A volume as chunks of many sizes: a boot sector, a hole, and the file table, two of three records cut over chunks."""
    boot = F.concat(F.lit("EB5290"), asc("NTFS    "), le(F.lit(512), 2), le(F.lit(8), 1), zeros(0x28 - 0x0E), le(F.lit(10**9), 8), le(F.lit(5), 8), zeros(512 - 0x38))
    first = spark.range(1).select(F.lit("vol").alias("image_id"), F.lit(0).cast("bigint").alias("base_offset"), F.unhex(boot).alias("data"))
    n = F.col("record_no")
    cut = F.when(n % 3 == 0, F.lit(fs.RECORD)).otherwise(1 + n * 37 % (fs.RECORD - 1)).cast("int")
    at, rec = n * fs.RECORD + 5 * 4096, F.col("record")
    two = F.array(F.struct(at.alias("base_offset"), F.substring(rec, F.lit(1), cut).alias("data")), F.struct((at + cut).alias("base_offset"), F.substring(rec, cut + 1, fs.RECORD - cut).alias("data")))
    return first.unionByName(mft_rows(spark, d).select("image_id", F.inline(two)))


def f10(spark, d):
    """The composed volume is stored first, as a real image would be; its boot sector tells where the table begins."""
    chunks = tb.checkpoint(ntfs_volume(spark, d))
    boots = chunks.filter("base_offset = 0")
    return fs.mft_scan(fs.mft_slices(chunks, fs.ntfs_boot(boots, "image_id")), "image_id")


QUERIES["f10_mft_scan"] = f10
ORACLE["f10_mft_scan"] = f"""select 'vol' as image_id, inode, name, '/MFT_' || inode || '/' || name as path, floor(size)::bigint as size, inode % 10 = 0 as is_directory, is_deleted
 from (select *, case when inode % 9 = 0 then 'MFT_Record_' || inode else 'f' || inode || '.dat' end as name from {tb.FS} where inode % 17 <> 16)"""
