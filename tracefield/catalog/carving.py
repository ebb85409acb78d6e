"""Registered carving and imaging queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracefield.catalog.bytestats import VALIDATED, _mime, validated
from tracefield.operators import carving as cv
from tracefield.operators import imaging as im
from tracefield.operators import reports as rp
from tracefield.sources import signatures as sg
from tracefield.session import small_table, work_dir
from tracefield.sources import tables as tb

QUERIES, ORACLE = {}, {}

# page markup as signatures: name, ext, header, footer, max size, footer search offset
PAGE_SIGNATURES = [
    ("HTML Page", ".html", b"<!DOCTYP".hex(), b"</html>".hex(), 4096, 64),
    ("Script", ".js", b"<script".hex(), b"</script>".hex(), 600, 8),
    ("Title", ".txt", b"<title>".hex(), b"</title>".hex(), 200, 7),
    ("Percent run", ".bin", b"%%".hex(), "", 16, 0),
    ("Percent long", ".bin", b"%%%".hex(), "", 16, 0),
    ("Paragraph", ".txt", b"<p".hex(), b"</p>".hex(), 2000, 2),
    ("Page seam", ".bin", b"><!DO".hex(), "", 64, 0),
]


def sigs(spark):
    return sg.signatures_of(spark, PAGE_SIGNATURES)


IMG_BYTES = f"""(select pos, array_to_string([h, lead(h,1) over w, lead(h,2) over w, lead(h,3) over w, lead(h,4) over w, lead(h,5) over w,
   lead(h,6) over w, lead(h,7) over w, lead(h,8) over w], '') as s from
  (select base_offset + i as pos, h from (select base_offset, unnest(range(len(l))) as i, unnest(l) as h from
    (select base_offset, regexp_extract_all(hex(encode(html)), '..') as l from {tb.EV_IMAGE}))) window w as (order by pos))"""
SIG_ROWS = "(values " + ", ".join(
    f"('{n}', '{h.upper()}', '{f.upper()}', {m}, {o})" for n, _, h, f, m, o in PAGE_SIGNATURES
) + ") s(name, header, footer, max_size, fso)"
HITS_SQL = f"""hits as (select s.name, pos as "offset", length(header)//2 as header_len, length(footer)//2 as footer_len, max_size, fso
   from {IMG_BYTES} b join {SIG_ROWS} on starts_with(b.s, s.header)),
  feet as (select s.name, pos as foot from {IMG_BYTES} b join {SIG_ROWS} on s.footer <> '' and starts_with(b.s, s.footer)),
  total as (select sum(strlen(html))::bigint as size from pages)"""


def paired_sql(agg):
    return f"""paired as (select h.*, (select {agg}(foot) from feet f where f.name = h.name and foot >= "offset" + fso and foot + footer_len <= "offset" + max_size) as footer_offset from hits h)"""


CUT_SQL = """cut as (select 'pages' as image_id, name, "offset" as start_offset,
   case when footer_offset is not null then footer_offset + footer_len else least("offset" + max_size, size) end as end_offset,
   footer_offset is not null or footer_len = 0 as is_complete from paired, total),
  carved as (select *, end_offset - start_offset as size from cut where end_offset > start_offset)"""


def j1(spark, d):
    return cv.match_signatures(tb.ev_image(spark, d), sigs(spark))


QUERIES["j1_match_signatures"] = j1
ORACLE["j1_match_signatures"] = f"""with {HITS_SQL} select 'pages' as image_id, name, "offset", header_len from hits"""


def j1_long(spark, d):
    """A list of thousands of signatures: the page marks and every word of 5 to 9 letters of the documents."""
    words = tb.load(spark, d, "documents").select(F.explode(F.expr("regexp_extract_all(text, '(?<![A-Za-z])[a-z]{5,9}(?![A-Za-z])', 0)")).alias("w")).distinct()
    listed = words.select(F.col("w").alias("name"), F.col("w").cast("binary").alias("header"))
    return cv.match_signatures(tb.ev_image(spark, d), listed.unionByName(sigs(spark).select("name", "header")))


QUERIES["j1_match_signatures_join"] = j1_long
ORACLE["j1_match_signatures_join"] = f"""with words as (select distinct w from (select unnest(regexp_extract_all(' ' || regexp_replace(text, '[^A-Za-z]', '  ', 'g') || ' ', ' ([a-z]{{5,9}}) ', 1)) as w from
    (select regexp_replace(text, '([^\x00-\x7f])', ' \1 ', 'g') as text from documents))),
  listed as (select w as name, hex(encode(w)) as header from words union all select name, header from {SIG_ROWS}),
  spots as (select pos, n, substr(s, 1, 2 * n) as part from {IMG_BYTES} b, (select distinct length(header) // 2 as n from listed) l where length(s) >= 2 * n)
  select 'pages' as image_id, name, pos as "offset", n as header_len from spots join listed on part = header"""


def x4(spark, d):
    rows = cv.scan_by_udtf(tb.ev_image(spark, d), [bytes.fromhex(s[2]) for s in PAGE_SIGNATURES])
    table = small_table(spark, [(k, s[0]) for k, s in enumerate(PAGE_SIGNATURES)], "pid int, name string")
    return rows.join(table, "pid").select("image_id", "name", "offset")


QUERIES["x4_scan_udtf"] = x4
ORACLE["x4_scan_udtf"] = f"""with {HITS_SQL} select 'pages' as image_id, name, "offset" from hits"""

QUERIES["u3_dedup_offsets"] = lambda spark, d: cv.dedup_offsets(j1(spark, d))
ORACLE["u3_dedup_offsets"] = f"""with {HITS_SQL} select 'pages' as image_id, "offset", name, header_len from
 (select *, row_number() over (partition by "offset" order by header_len desc, name) as rn from hits) where rn = 1"""


def carved(spark, d, mode="first", dedup=False):
    return cv.carve(tb.ev_image(spark, d), sigs(spark), mode, dedup=dedup, span=1 << 16)


for _mode, _agg in (("first", "min"), ("last", "max")):
    QUERIES[f"j2_pair_footers_{_mode}"] = lambda spark, d, m=_mode: carved(spark, d, m).filter("is_complete").select("name", "start_offset", "end_offset")
    ORACLE[f"j2_pair_footers_{_mode}"] = f"with {HITS_SQL}, {paired_sql(_agg)}, {CUT_SQL} select name, start_offset, end_offset from carved where is_complete"

CARVED = f"with {HITS_SQL}, {paired_sql('min')}, {CUT_SQL} "
QUERIES["r1_carve"] = carved
ORACLE["r1_carve"] = CARVED + "select image_id, name, start_offset, end_offset, is_complete, size from carved"


def r1_bytes(spark, d):
    chunks = tb.ev_image(spark, d)
    ranges = cv.carve(chunks, sigs(spark), span=1 << 16)
    return cv.carved_bytes(ranges, chunks, 1 << 14).select("name", "start_offset", F.octet_length("content").alias("size"), F.md5("content").alias("md5"))


QUERIES["r1_carved_bytes"] = r1_bytes
ORACLE["r1_carved_bytes"] = CARVED + """, img as (select string_agg(hex(encode(html)), '' order by page_id) as hx from pages)
 select name, start_offset, size, md5(unhex(substr(hx, 2*start_offset+1, 2*size))) as md5 from carved, img"""

QUERIES["a1_carving_stats"] = lambda spark, d: cv.carving_stats(carved(spark, d))
ORACLE["a1_carving_stats"] = CARVED + """select name, count(*) as files, count(*) filter (is_complete) as complete, min(size) as min_size, max(size) as max_size,
 (sum(size) // count(*))::bigint as mean_size, sum(size)::bigint as total_size from carved group by 1"""

QUERIES["f17_carve_filters"] = lambda spark, d: cv.carve_filters(
    carved(spark, d).withColumn("confidence", F.when(F.col("is_complete"), 0.9).otherwise(0.5)),
    include=["HTML Page", "Script", "Title"], exclude=["Title"], min_size=100, max_size=4000, min_confidence=0.6,
).select("name", "start_offset", "size")
ORACLE["f17_carve_filters"] = CARVED + "select name, start_offset, size from carved where name in ('HTML Page', 'Script') and size between 100 and 4000 and is_complete"


def r2(spark, d):
    parts = carved(spark, d).filter("is_complete").groupBy("image_id", "name", F.col("start_offset").alias("offset")).agg(F.max("size").alias("size"))
    return cv.fragmented(parts, ["image_id", "name"], 3000, 5, span=1 << 16)


QUERIES["r2_carve_fragmented"] = r2
ORACLE["r2_carve_fragmented"] = CARVED + """, l as (select *, case when start_offset - lag(end_offset) over w <= 3000 then 0 else 1 end as st from carved
   where is_complete window w as (partition by name order by start_offset)),
  g as (select *, sum(st) over (partition by name order by start_offset) as run from l)
 select image_id, name, count(*) as fragments, min(start_offset) as start_offset, max(end_offset) as end_offset, sum(size)::bigint as bytes
 from g group by image_id, name, run having count(*) > 1 and count(*) <= 5"""


# --- imaging ---------------------------------------------------------------------
QUERIES["s5_read_sectors"] = lambda spark, d: im.read_sectors(tb.ev_bytes(spark, d), "file_id").select("file_id", "sector", F.md5("bytes").alias("md5"))
ORACLE["s5_read_sectors"] = f"""select file_id, i as sector, md5(unhex(rpad(substr(hx, (1024*i+1)::bigint, 1024), 1024, '0'))) as md5
 from (select file_id, hx, unnest(range((size - 1) // 512 + 1)) as i from {tb.EV_BYTES})"""


def s6(spark, d):
    pages = tb.load(spark, d, "pages")
    n = pages.count()
    files = tb.load(spark, d, "orders").select(
        "o_orderkey",
        F.transform(F.sequence(F.lit(0), F.col("o_custkey") % 4), lambda i: (F.col("o_orderkey") * 7 + i * 13) % n).alias("chain"),
    )
    clusters = pages.select(F.col("page_id").alias("cluster_no"), F.encode("html", "utf-8").alias("data"))
    return im.read_clusters(files, "o_orderkey", "chain", clusters).select("o_orderkey", F.md5("content").alias("md5"))


QUERIES["s6_read_clusters"] = s6
ORACLE["s6_read_clusters"] = """select o_orderkey, md5(string_agg(html, '' order by i)) as md5 from
 (select o_orderkey, i, (o_orderkey*7 + i*13) % (select count(*) from pages) as c from (select o_orderkey, unnest(range(o_custkey % 4 + 1)) as i from orders))
 join pages on page_id = c group by 1"""

QUERIES["w9_bad_sector_runs"] = lambda spark, d: im.bad_sector_runs(tb.bad_sectors(spark, d), 4096)
ORACLE["w9_bad_sector_runs"] = f"""with r as (select min(sector) as run_start, max(sector) as run_end, count(*) as run_length from
 (select sector, sector - row_number() over (order by sector) as g from {tb.BAD}) group by g)
 select *, lead(run_start) over (order by run_start) - run_end - 1 as gap_to_next from r"""


def j6(spark, d):
    present = tb.load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sector")).agg(
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("bad")
    ).filter("bad = 0").select("sector", F.unhex(F.md5(F.col("sector").cast("string"))).alias("data"))
    total = tb.load(spark, d, "orders").agg(F.max("o_orderkey") + 1).first()[0]
    return im.zero_fill(present, total, 16).select("sector", F.hex("data").alias("data"), "readable")


QUERIES["j6_zero_fill"] = j6
ORACLE["j6_zero_fill"] = """with good as (select l_orderkey from lineitem group by 1 having count(*) filter (l_returnflag = 'R') = 0)
select s as sector, case when g.l_orderkey is not null then upper(md5(s::varchar)) else repeat('00', 16) end as data, g.l_orderkey is not null as readable
from (select unnest(range((select max(o_orderkey) + 1 from orders))) as s) left join good g on g.l_orderkey = s"""


def j5(spark, d):
    p = tb.load(spark, d, "pages")
    want = F.md5(F.when(F.col("page_id") % 17 == 0, "x").otherwise(F.col("html")))
    expected = p.filter("page_id % 19 <> 3").select((F.when(F.col("page_id") % 23 == 5, F.col("page_id") + 1000000000).otherwise(F.col("page_id"))).alias("chunk_no"), want.alias("digest"))
    return im.verify_image(tb.ev_image(spark, d), expected)


QUERIES["j5_verify_image"] = j5
ORACLE["j5_verify_image"] = """with e as (select case when page_id % 23 = 5 then page_id + 1000000000 else page_id end as c, md5(case when page_id % 17 = 0 then 'x' else html end) as w from pages where page_id % 19 <> 3)
select coalesce(page_id, c) as chunk_no, case when page_id is null then 'missing' when c is null then 'unexpected' when md5(html) <> w then 'mismatch' else 'ok' end as state
from pages full join e on page_id = c"""

QUERIES["a42_image_hashes"] = lambda spark, d: im.chunk_hashes(tb.ev_image(spark, d)).select("chunk_no", "size", "md5", "sha1", "sha256", "crc32")
# crc32 byte by byte over a table made by its rule; no SQL has sha512 here, tests hold it against a library
ORACLE["a42_image_hashes"] = """with bits as (select i, list_reduce(list_prepend(i, range(8)), lambda c, r: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)) as v from range(256) t(i)),
 rule as (select list(v order by i) as entries from bits),
 sums as (select page_id, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen(html)), lambda k: ('0x' || substr(h, 2*k + 1, 2))::bigint)),
   lambda c, b: xor(c >> 8, entries[1 + (xor(c, b) & 255)]))) as crc32 from (select page_id, html, hex(encode(html)) as h from pages), rule)
select page_id as chunk_no, strlen(html) as size, md5(html) as md5, sha1(html) as sha1, sha256(html) as sha256, crc32 from pages join sums using (page_id)"""
QUERIES["a42_hash_root"] = lambda spark, d: im.hash_root(tb.ev_image(spark, d), 64, 3)
ORACLE["a42_hash_root"] = """with a as (select page_id // 64 as n, sha256(string_agg(sha256(html), '' order by page_id)) as h from pages group by 1),
 b as (select n // 64 as m, sha256(string_agg(h, '' order by n)) as h from a group by 1)
select 'pages' as image_id, m // 64 as part, sha256(string_agg(h, '' order by m)) as root from b group by 2"""


def s17(spark, d):
    """The image written to shared storage and read back, each chunk checked."""
    path = f"{work_dir(spark)}/image-{uuid.uuid4().hex}"
    im.write_image(tb.ev_image(spark, d), path)
    return im.read_written_image(spark, path).select("image_id", "chunk_no", F.octet_length("data").alias("size"), F.md5("data").alias("md5"), "sound")


QUERIES["s17_written_image"] = s17
ORACLE["s17_written_image"] = "select 'pages' as image_id, page_id as chunk_no, strlen(html) as size, md5(html) as md5, true as sound from pages"
QUERIES["s17_image_index"] = lambda spark, d: im.image_index(tb.ev_image(spark, d)).select("chunk_no", "size", "offset")
ORACLE["s17_image_index"] = f"""select chunk_no, n as size, base_offset as "offset" from {tb.EV_IMAGE}"""


# --- validation reports -------------------------------------------------------
QUERIES["a2_recovery_stats"] = lambda spark, d: rp.recovery_stats(validated(spark, d)).withColumn("success_pct", F.round("success_pct", 6))
ORACLE["a2_recovery_stats"] = f"""select count(*) as total, count(*) filter (len(errors) = 0) as valid, count(*) filter (len(errors) > 0) as corrupted,
 sum(size)::bigint as bytes, round(count(*) filter (len(errors) = 0) * 100.0 / count(*), 6)::double as success_pct from {VALIDATED}"""
QUERIES["a3_type_breakdown"] = lambda spark, d: rp.type_breakdown(validated(spark, d))
ORACLE["a3_type_breakdown"] = f"""select file_type, count(*) as files from (select coalesce(split_part({_mime}, '/', 1), nullif(ext, ''), 'unknown') as file_type from {VALIDATED}) group by 1"""
QUERIES["k7_failures_head"] = lambda spark, d: rp.failures_head(validated(spark, d), "file_id", 50).select("file_id", F.array_join("errors", ",").alias("errors"), "more")
ORACLE["k7_failures_head"] = f"""select file_id, array_to_string(errors, ',') as errors, (greatest((select count(*) from {VALIDATED} where len(errors) > 0) - 50, 0))::bigint as more
 from {VALIDATED} where len(errors) > 0 order by file_id limit 50"""
