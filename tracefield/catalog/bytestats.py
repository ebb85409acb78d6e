"""Registered byte-statistics and file-type queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefield.catalog.text import ORACLE as TEXT_ORACLE
from tracefield.functions import bytesops as by
from tracefield.functions import filetypes as ft
from tracefield.functions import fixed_values as fv
from tracefield.functions import textops as tx
from tracefield.sources import tables as tb

QUERIES, ORACLE = {}, {}
BYTES = tb.byte_rows(tb.EV_BYTES)
HIST = f"(select file_id, b, count(*)::bigint as n from {BYTES} group by all)"
ENT = "log2(sum(n)) - sum(n*log2(n))/sum(n)"
K = ["file_id"]


def a5(spark, d):
    return by.entropy_of(by.byte_histogram(tb.ev_bytes(spark, d), K), K).select(
        "file_id", "size", F.round("entropy", 6).alias("entropy")
    )


QUERIES["a5_entropy"] = a5
ORACLE["a5_entropy"] = f"select file_id, sum(n)::bigint as size, round({ENT}, 6) as entropy from {HIST} group by 1"


def x2(spark, d):
    return tb.ev_bytes(spark, d).select("file_id", F.round(by.entropy_udf(F.col("data")), 6).alias("entropy"))


QUERIES["x2_entropy_udf"] = x2
ORACLE["x2_entropy_udf"] = f"select file_id, round({ENT}, 6) as entropy from {HIST} group by 1"


def a6(spark, d):
    p = by.byte_profile(by.byte_histogram(tb.ev_bytes(spark, d), K), K)
    return p.select("file_id", "distinct_bytes", "top_byte", *[
        F.round(c, 6).alias(c) for c in ("null_ratio", "printable_ratio", "high_ratio", "top_share")])


QUERIES["a6_byte_profile"] = a6
ORACLE["a6_byte_profile"] = f"""
select file_id, count(*) as distinct_bytes, arg_max(b, (n * 1000 + 255 - b)) as top_byte,
 round(coalesce(sum(n) filter (b = 0), 0) / sum(n), 6) as null_ratio,
 round(coalesce(sum(n) filter (b between 32 and 126), 0) / sum(n), 6) as printable_ratio,
 round(coalesce(sum(n) filter (b >= 128), 0) / sum(n), 6) as high_ratio, round(max(n) / sum(n), 6) as top_share
from {HIST} group by 1"""

BLOCK_SQL = f"""(select file_id, pos // 1024 as block_no, b, count(*) as n from {tb.byte_rows(tb.CIPHER)} group by all)"""
BLOCK_ENT = f"(select file_id, block_no, sum(n)::bigint as size, {ENT} as e from {BLOCK_SQL} group by 1, 2)"


def a7(spark, d):
    return by.entropy_blocks(tb.cipher_files(spark, d), K, 1024).withColumn("entropy", F.round("entropy", 6))


QUERIES["a7_entropy_blocks"] = a7
ORACLE["a7_entropy_blocks"] = f"""
select file_id, block_no, size, round(e, 6) as entropy, e > 7.5 as encrypted, e > 6.0 and e <= 7.5 as compressed from {BLOCK_ENT}"""


def a8(spark, d):
    files = tb.cipher_files(spark, d)
    whole = by.entropy_of(by.byte_histogram(files, K), K)
    s = by.entropy_summary(by.entropy_blocks(files, K, 1024), K, whole)
    return s.select("file_id", "verdict", *[F.round(c, 6).alias(c) for c in s.columns if c.endswith("entropy")])


QUERIES["a8_entropy_summary"] = a8
ORACLE["a8_entropy_summary"] = f"""
select b.file_id, case when fe > 7.8 then 'encrypted' when fe > 7.0 then 'compressed' when fe > 5.0 then 'mixed' else 'plain' end as verdict,
 round(min(e), 6) as min_entropy, round(max(e), 6) as max_entropy, round(avg(e), 6) as mean_entropy,
 round(var_pop(e), 6) as var_entropy, round(stddev_pop(e), 6) as std_entropy, round(any_value(fe), 6) as file_entropy
from {BLOCK_ENT} b join (select file_id, {ENT} as fe from
  (select file_id, b, sum(n) as n from {BLOCK_SQL} group by all) group by 1) w on w.file_id = b.file_id group by b.file_id, fe"""


def a9(spark, d):
    return by.section_entropy(tb.ev_bytes(spark, d), K).withColumn("entropy", F.round("entropy", 6))


QUERIES["a9_section_entropy"] = a9
ORACLE["a9_section_entropy"] = f"""
with sec as (select r.file_id, case when size < 10 then 9 else least(pos // (size // 10), 9) end as section, b, count(*) as n
  from {BYTES} r join {tb.EV_BYTES} f on r.file_id = f.file_id group by all),
 ent as (select file_id, section, {ENT} as e from sec group by 1, 2)
select f.file_id, s.section, round(coalesce(e, 0.0), 6) as entropy
from {tb.EV_BYTES} f cross join (select unnest(range(10)) as section) s left join ent on ent.file_id = f.file_id and ent.section = s.section"""


def a10(spark, d):
    s = by.byte_freq_stats(by.byte_histogram(tb.ev_bytes(spark, d), K), K)
    return s.select("file_id", "max", "min", "unique", "singletons", "above_mean", F.col("median").cast("double").alias("median"),
                    *[F.round(c, 6).alias(c) for c in ("mean", "var", "std")])


QUERIES["a10_byte_freq_stats"] = a10
ORACLE["a10_byte_freq_stats"] = f"""
with dense as (select f.file_id, v.b, coalesce(h.n, 0) as n from {tb.EV_BYTES} f cross join (select unnest(range(256)) as b) v
  left join {HIST} h on h.file_id = f.file_id and h.b = v.b),
 m as (select file_id, avg(n) as mu from dense group by 1)
select d.file_id, max(n) as max, min(n) as min, count(*) filter (n > 0) as unique, count(*) filter (n = 1) as singletons,
 count(*) filter (n > mu) as above_mean, median(n)::double as median, round(any_value(mu), 6) as mean,
 round(sum(n*n)/256 - avg(n)*avg(n), 6) as var, round(sqrt(sum(n*n)/256 - avg(n)*avg(n)), 6) as std from dense d join m on m.file_id = d.file_id group by 1"""


def a11(spark, d):
    return by.ngram_counts(tb.ev_bytes(spark, d), ["ext"], 2)


QUERIES["a11_ngram_counts"] = a11
ORACLE["a11_ngram_counts"] = f"""
select ext, ('0x' || a || b)::bigint as gram, count(*) as n
from (select ext, unnest(l[:-2]) as a, unnest(l[2:]) as b from (select ext, regexp_extract_all(hx, '..') as l from {tb.EV_BYTES})) group by all"""


def c19(spark, d):
    return by.extract_strings(tb.ev_bytes(spark, d), "file_id")


QUERIES["c19_extract_strings"] = c19
ORACLE["c19_extract_strings"] = f"""
select file_id, m[i] as value, (list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: strlen(x))), 0))::bigint as "offset"
from (select file_id, m, g, unnest(range(1, len(m) + 1)) as i from (select file_id,
  regexp_extract_all(text, '[\\x20-\\x7e]{{4,}}') as m, regexp_split_to_array(text, '[\\x20-\\x7e]{{4,}}') as g from {tb.EV_FILES}))"""

CHIST = f"(select file_id, b, count(*) as n from {tb.byte_rows(tb.CIPHER)} group by all)"


def m20(spark, d):
    r = by.randomness(tb.cipher_files(spark, d), "file_id")
    return r.select("file_id", F.round("entropy", 6).alias("entropy"), F.round("chi_square", 4).alias("chi_square"), "verdict", "confidence")


QUERIES["m20_randomness"] = m20
ORACLE["m20_randomness"] = f"""
with s as (select file_id, {ENT} as e, sum(n*n)*256/sum(n) - sum(n) as chi from {CHIST} group by 1),
 blk as (select file_id, substr(hx, (32*i+1)::bigint, 32) as piece from (select file_id, hx, unnest(range(length(hx)//32)) as i from {tb.CIPHER})),
 rep as (select file_id, max(c) > 1 as repeats from (select file_id, piece, count(*) as c from blk group by all) group by 1),
 v as (select s.*, case when e > 7.9 and chi < 310.457 then 'stream_cipher' when e > 7.5 and coalesce(repeats, false) then 'block_cipher' else 'none' end as verdict
  from s left join rep on rep.file_id = s.file_id)
select file_id, round(e, 6) as entropy, round(chi, 4) as chi_square, verdict,
 case verdict when 'stream_cipher' then 0.6 when 'block_cipher' then 0.5 else 0.0 end::double as confidence from v"""


def f14(spark, d):
    return by.binary_type(tb.cipher_files(spark, d), "file_id")


QUERIES["f14_binary_type"] = f14
ORACLE["f14_binary_type"] = f"""
with s as (select file_id, {ENT} as e, coalesce(sum(n) filter (b = 0), 0)/sum(n) as z,
  coalesce(sum(n) filter (b between 32 and 126), 0)/sum(n) as p from {CHIST} group by 1),
 h as (select file_id, count(distinct b) as k from {tb.byte_rows(tb.CIPHER)} where pos < 64 group by 1)
select c.file_id, case when e > 7.5 then 'compressed_or_encrypted' when z > 0.5 then 'sparse_data' when p > 0.7 then 'text_like_binary'
 when length(hx)//2 > 64 and k > 10 then 'structured_binary' else 'unknown_binary' end as binary_type
from {tb.CIPHER} c left join s on s.file_id = c.file_id left join h on h.file_id = c.file_id"""


# --- file types ---------------------------------------------------------------
def has(hx, token):
    return f"regexp_matches({hx}, '^(?:..)*?{token.hex().upper()}')"


def starts(sig, off=0):
    return f"substr(hx, {2 * off + 1}, {len(sig)}) = '{sig.upper()}'"


def f1(spark, d):
    return tb.typed_files(spark, d).select("file_id", ft.detect_type(F.col("data")).alias("file_type"))


_zip = (f"case when length(hx) > 60 and {has('substr(hx,1,60)', b'word/')} then 'DOCX' when length(hx) > 60 and {has('substr(hx,1,60)', b'xl/')} "
        f"then 'XLSX' when length(hx) > 60 and {has('substr(hx,1,60)', b'ppt/')} then 'PPTX' else 'ZIP' end")
TYPE_SQL = "case " + " ".join(
    f"when {starts(s, o)} then {_zip if k in ('ZIP', 'DOCX') else repr(k)}" for s, o, k in fv.TYPE_SIGNATURES
) + " else 'UNKNOWN' end"
QUERIES["f1_detect_type"] = f1
ORACLE["f1_detect_type"] = f"select file_id, {TYPE_SQL} as file_type from {tb.TYPED}"


def f2(spark, d):
    return tb.typed_files(spark, d).select("file_id", ft.magic_type(F.col("data")).alias("file_type"))


QUERIES["f2_magic_type"] = f2
ORACLE["f2_magic_type"] = f"""select file_id, case when {starts('FFD8')} then 'jpeg' when {starts('89504E470D0A1A0A')} then 'png'
 when {starts('25504446')} then 'pdf' when {starts('4D5A')} then 'executable' else 'unknown' end as file_type from {tb.TYPED}"""


def f3(spark, d):
    return tb.typed_files(spark, d).select("file_id", ft.container_type(F.col("data")).alias("container"))


QUERIES["f3_container_type"] = f3
ORACLE["f3_container_type"] = f"""select file_id, case when length(hx) < 16 then 'UNKNOWN'
 when {starts('66747970', 4)} then case when substr(hx,17,8) in ('{b'qt  '.hex().upper()}', '{b'mov '.hex().upper()}') then 'MOV' else 'MP4' end
 when {starts('52494646')} and {starts(b'AVI '.hex(), 8)} then 'AVI'
 when {starts('1A45DFA3')} then case when {has('substr(hx,1,200)', b'webm')} then 'WEBM' else 'MKV' end
 when {starts('464C56')} then 'FLV' else 'UNKNOWN' end as container from {tb.TYPED}"""


def f4(spark, d):
    return tb.typed_files(spark, d).select("file_id", ft.detect_codec(F.col("data")).alias("codec"))


QUERIES["f4_detect_codec"] = f4
ORACLE["f4_detect_codec"] = "select file_id, case " + " ".join(
    f"when {has('substr(hx,1,2048)', bytes.fromhex(h))} then '{n}'" for n, h in fv.CODEC_SIGNATURES
) + f" end as codec from {tb.TYPED}"


def f5(spark, d):
    return tb.typed_files(spark, d).select("file_id", ft.format_by_content(F.col("data")).alias("format"))


FORMAT_SQL = "case " + " ".join(
    f"when length(hx)//2 > {o + len(s) // 2} and {starts(s, o)} then '{e}'" for e, s, o, _ in fv.VIDEO_FORMATS if s
) + " end"
QUERIES["f5_format_by_content"] = f5
ORACLE["f5_format_by_content"] = f"select file_id, {FORMAT_SQL} as format from {tb.TYPED}"


def f6(spark, d):
    return tb.typed_files(spark, d).select(
        "file_id", ft.validate_format(F.concat(F.lit("."), "ext"), F.col("data")).alias("state")
    )


QUERIES["f6_validate_format"] = f6
_known = ",".join(f"'{e[1:]}'" for e, *_ in fv.VIDEO_FORMATS)
_mis = " or ".join(f"(ext = '{e[1:]}' and not ({starts(s, o)}))" for e, s, o, _ in fv.VIDEO_FORMATS if s)
ORACLE["f6_validate_format"] = f"""select file_id, case when hx = '' then 'empty' when ext not in ({_known}) and {FORMAT_SQL} is null then 'unrecognised'
 when {_mis} then 'signature mismatch' else 'valid' end as state from {tb.TYPED}"""


def f15(spark, d):
    return tb.typed_files(spark, d).select("file_id", ft.is_binary(F.col("data")).alias("is_binary"))


QUERIES["f15_is_binary"] = f15
ORACLE["f15_is_binary"] = f"select file_id, {has('substr(hx,1,2048)', bytes(1))} as is_binary from {tb.TYPED}"


def validated(spark, d):
    e = ft.recovered_errors(F.col("ext"), F.col("data"))
    return tb.typed_files(spark, d).select(
        "file_id", "ext", F.octet_length("data").cast("bigint").alias("size"), ft.mime_of(F.col("ext")).alias("mime"), e.alias("errors")
    )


VALIDATED = f"""(select file_id, ext, length(hx)//2 as size, list_filter([case when hx = '' then 'empty' end,
 case when ext = 'jpg' and not ({starts('FFD8FF')}) then 'jpeg header' end,
 case when ext = 'jpg' and right(hx, 4) <> 'FFD9' then 'jpeg footer' end,
 case when ext = 'png' and not ({starts('89504E470D0A1A0A')}) then 'png header' end,
 case when ext = 'pdf' and not ({starts('255044462D')}) then 'pdf header' end,
 case when ext = 'zip' and not ({starts('504B0304')}) then 'zip header' end], lambda x: x is not null) as errors from {tb.TYPED})"""


def f16(spark, d):
    return validated(spark, d).select("file_id", F.array_join("errors", ",").alias("errors"), (F.size("errors") == 0).alias("valid"))


QUERIES["f16_validate_recovered"] = f16
ORACLE["f16_validate_recovered"] = f"select file_id, array_to_string(errors, ',') as errors, len(errors) = 0 as valid from {VALIDATED}"


def f25(spark, d):
    c = F.col("data")
    mp4 = F.col("ext").isin("mp4", "mov")
    return tb.typed_files(spark, d).filter(F.col("ext").isin("mp4", "mov", "avi")).select(
        "file_id", "ext", F.array_join(F.when(mp4, ft.mp4_issues(c)).otherwise(ft.avi_issues(c)), ",").alias("issues")
    )


QUERIES["f25_container_integrity"] = f25
ORACLE["f25_container_integrity"] = f"""
select file_id, ext, array_to_string(list_filter(case when hx = '' then ['empty'] when ext in ('mp4', 'mov')
 then [case when not {has('hx', b'ftyp')} then 'missing ftyp' end, case when not {has('hx', b'moov')} then 'missing moov' end]
 else [case when not ({starts('52494646')}) then 'missing RIFF header' end, case when not {has('substr(hx,1,24)', b'AVI ')} then 'missing AVI identifier' end] end,
 lambda x: x is not null), ',') as issues from {tb.TYPED} where ext in ('mp4', 'mov', 'avi')"""


def f26(spark, d):
    li = tb.load(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        ft.frame_corrupt(F.col("l_discount") * 6, F.col("l_tax") / 10, F.col("l_quantity")).alias("corrupt"),
        ft.frame_corrupt(F.col("l_discount") * 6, F.col("l_tax") / 10, F.col("l_quantity"), 0.01).alias("corrupt_strict"),
    )


QUERIES["f26_frame_flags"] = f26
ORACLE["f26_frame_flags"] = """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
 l_discount*6 > 0.5 or l_tax/10 < 0.005 or l_quantity < 5 as corrupt, l_discount*6 > 0.5 or l_tax/10 < 0.01 or l_quantity < 5 as corrupt_strict from lineitem"""


def f27(spark, d):
    data = F.col("data")
    head = F.substring(data, 1, 512)
    return tb.typed_files(spark, d).select(
        "file_id", "ext", F.octet_length(data).cast("bigint").alias("size"), ft.mime_of(F.col("ext")).alias("mime"),
        F.octet_length(head).alias("header_size"), F.round(by.entropy_udf(head), 6).alias("header_entropy"),
        ft.detect_type(data).alias("signature"),
    )


def f27_text(spark, d):
    """Text features of the text files, over the whole text, and how old each file is at the newest one's time."""
    files = tb.ev_files(spark, d).select("file_id", "text", "size", ft.mime_of(F.lit("txt")).alias("mime"))
    stats = tx.text_stats(files)
    changed = F.timestamp_seconds(F.col("file_id") * 3600)
    newest = F.timestamp_seconds(F.lit(files.agg(F.max("file_id")).first()[0] * 3600))
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    return stats.select(
        "file_id", "size", "mime", "chars", "words", "lines", F.round("avg_word_length", 6).alias("avg_word_length"),
        letters.alias("letters"), digits.alias("digits"), F.date_diff(newest, changed).alias("age_days"),
    )


QUERIES["f27_text_features"] = f27_text
ORACLE["f27_text_features"] = f"""select f.file_id, size, 'text/plain' as mime, chars, words, lines, avg_word_length, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as letters,
 length(regexp_replace(text, '[^0-9]', '', 'g')) as digits, datediff('day', make_timestamp(f.file_id * 3600000000), (select make_timestamp(max(file_id) * 3600000000) from {tb.EV_FILES})) as age_days
 from {tb.EV_FILES} f join ({TEXT_ORACLE['a12_text_stats']}) s on s.file_id = f.file_id"""

_mime = "case ext " + " ".join(f"when '{k}' then '{v}'" for k, v in ft.MIME_BY_EXTENSION.items()) + " end"
HEAD_ENT = f"""(select file_id, {ENT} as he from (select file_id, b, count(*) as n from {tb.byte_rows(tb.TYPED)} where pos < 512 group by all) group by 1)"""
QUERIES["f27_file_features"] = f27
ORACLE["f27_file_features"] = f"""
select t.file_id, ext, length(hx)//2 as size, {_mime} as mime, least(length(hx)//2, 512) as header_size,
 round(coalesce(he, 0.0), 6) as header_entropy, {TYPE_SQL} as signature from {tb.TYPED} t left join {HEAD_ENT} h on h.file_id = t.file_id"""


def c12(spark, d):
    return tb.typed_files(spark, d).select("file_id", ft.repair_priority(F.concat(F.lit("."), "ext")).alias("priority"))


QUERIES["c12_repair_priority"] = c12
_pro = ",".join(f"'{e[1:]}'" for e, _, _, p in fv.VIDEO_FORMATS if p)
ORACLE["c12_repair_priority"] = f"""select file_id, case when ext not in ({_known}) then 1 when ext in ({_pro}) then 8
 when ext in ('mp4','mov','mkv') then 7 when ext in ('avi','wmv','flv') then 5 else 3 end as priority from {tb.TYPED}"""


def c3(spark, d):
    data = by.hex_bytes(F.concat(F.lit(" "), F.md5(F.col("o_orderkey").cast("string")), F.lit(" \n")))
    o = tb.load(spark, d, "orders").select("o_orderkey", data.alias("data"))
    c = F.col("data")
    return o.select(
        "o_orderkey", by.byte_at(c, 3).alias("b3"), by.le_uint(c, 0, 2).alias("le16"), by.le_uint(c, 2, 4).alias("le32"),
        by.le_uint(c, 4, 8).cast("string").alias("le64"), by.be_uint(c, 1, 4).alias("be32"), by.be_uint(c, 8, 8).cast("string").alias("be64"),
        by.le_uint(c, 14, 4).alias("past_end"),
    )


def _le(o, n):
    return "('0x' || " + " || ".join(f"substr(h, {2 * (o + i) + 1}, 2)" for i in range(n - 1, -1, -1)) + ")::uhugeint"


QUERIES["c3_endian_decode"] = c3
ORACLE["c3_endian_decode"] = f"""select o_orderkey, ('0x' || substr(h, 7, 2))::int as b3, {_le(0, 2)}::bigint as le16, {_le(2, 4)}::bigint as le32,
 ({_le(4, 8)})::varchar as le64, ('0x' || substr(h, 3, 8))::bigint as be32, (('0x' || substr(h, 17, 16))::uhugeint)::varchar as be64,
 null::bigint as past_end from (select o_orderkey, md5(o_orderkey::varchar) as h from orders)"""
