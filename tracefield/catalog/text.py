"""Registered text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefield.functions import fixed_values as fv
from tracefield.functions import textops as tx
from tracefield.sources import tables as tb

QUERIES, ORACLE = {}, {}


def sql_list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_hits(text, words):
    return f"len(list_filter({sql_list(words)}, lambda w: contains({text}, w)))"


SP = tx.SPACE
WORDS_SQL = "list_filter(regexp_split_to_array(@t, '" + SP + "+'), lambda w: w <> '')"


def f12(spark, d):
    return tx.keyword_moderation(tb.ev_files(spark, d)).select(
        "file_id", "flagged", "category", "severity", "confidence", "needs_review"
    )


QUERIES["f12_keyword_moderation"] = f12
ORACLE["f12_keyword_moderation"] = f"""
select file_id, flagged, case when flagged > 3 then 'VIOLENCE' else 'SAFE' end as category,
 case when flagged > 3 then 'MEDIUM' else 'LOW' end as severity,
 case when flagged > 3 then 0.7 when flagged > 0 then 0.8 else 0.95 end::double as confidence,
 flagged > 3 as needs_review
from (select file_id, {sql_hits('lower(text)', fv.MODERATION_KEYWORDS)}::int as flagged from {tb.EV_FILES})"""


def f13(spark, d):
    return tb.ev_files(spark, d).select("file_id", tx.text_type(F.col("text")).alias("text_type"))


QUERIES["f13_text_type"] = f13
ORACLE["f13_text_type"] = f"""
select file_id, case when {sql_hits('lower(text)', fv.LOG_WORDS)} > 0 then 'log_file'
 when {sql_hits('lower(text)', fv.SQL_WORDS)} > 0 then 'sql_file'
 when length(text) - length(replace(text, ',', '')) > length(text) - length(replace(text, ' ', '')) and contains(text, chr(10)) then 'csv_data'
 when regexp_matches(text, '^{SP}*[{{\\[]') then 'json_data'
 when {sql_hits('lower(text)', fv.HTML_WORDS)} > 0 then 'html_file' else 'plain_text' end as text_type
from {tb.EV_FILES}"""


def a12(spark, d):
    return tx.text_stats(tb.ev_files(spark, d)).select(
        "file_id", "chars", "words", "lines", "paragraphs", "unique_words",
        F.round("avg_word_length", 6).alias("avg_word_length"),
    )


QUERIES["a12_text_stats"] = a12
ORACLE["a12_text_stats"] = f"""
select file_id, length(text) as chars, len(w) as words, length(text) - length(replace(text, chr(10), '')) + 1 as lines,
 len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '{tx.NON_SPACE}'))) as paragraphs,
 len(list_distinct({WORDS_SQL.replace('@t', 'lower(text)')})) as unique_words,
 case when len(w) > 0 then round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6) else 0.0 end as avg_word_length
from (select *, {WORDS_SQL.replace('@t', 'text')} as w from {tb.EV_FILES})"""


def c1(spark, d):
    return tx.entities(tb.ev_files(spark, d), "file_id")


QUERIES["c1_entities"] = c1
_c1 = []
for kind, pat, conf in fv.ENTITY_PATTERNS:
    _c1.append(f"""select file_id, '{kind}' as entity_type, m[i] as entity,
   (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::bigint as start_pos,
   (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))))::bigint as end_pos,
   {conf}::double as confidence
 from (select file_id, m, g, unnest(range(1, len(m) + 1)) as i from
   (select file_id, regexp_extract_all(text, '{pat}') as m, regexp_split_to_array(text, '{pat}') as g from {tb.EV_FILES}))""")
ORACLE["c1_entities"] = "\nunion all\n".join(_c1)


def c2(spark, d):
    m = tx.entities_map(tb.ev_files(spark, d), "file_id")
    return m.select("file_id", *[F.array_join(c, "|").alias(c) for c in m.columns[1:]])


QUERIES["c2_entities_map"] = c2
ORACLE["c2_entities_map"] = f"""
select file_id, array_to_string(regexp_extract_all(text, '{fv.MAP_EMAIL}'), '|') as emails,
 array_to_string(regexp_extract_all(text, '{fv.MAP_URL}'), '|') as urls,
 array_to_string(regexp_extract_all(text, '{fv.MAP_IP}'), '|') as ip_addresses,
 array_to_string(regexp_extract_all(text, '{fv.MAP_PHONE}'), '|') as phone_numbers
from {tb.EV_FILES}"""


# address-shaped strings made from row keys: BTC-like, ETH-like and broken ones
_ADDR_SPARK = """case o_orderkey % 4
  when 0 then concat('1', substring(translate(upper(md5(cast(o_orderkey as string))), '0', 'Z'), 1, cast(20 + o_custkey % 16 as int)))
  when 1 then concat('0x', md5(cast(o_orderkey as string)), substring(md5(cast(o_custkey as string)), 1, 8))
  when 2 then concat('0x', md5(cast(o_orderkey as string)))
  else concat('1O0l', upper(md5(cast(o_orderkey as string)))) end"""
_ADDR_DUCK = """case o_orderkey % 4
  when 0 then '1' || substr(translate(upper(md5(o_orderkey::varchar)), '0', 'Z'), 1, (20 + o_custkey % 16)::int)
  when 1 then '0x' || md5(o_orderkey::varchar) || substr(md5(o_custkey::varchar), 1, 8)
  when 2 then '0x' || md5(o_orderkey::varchar)
  else '1O0l' || upper(md5(o_orderkey::varchar)) end"""


def addresses(spark, d):
    return tb.load(spark, d, "orders").select("o_orderkey", F.expr(_ADDR_SPARK).alias("addr"))


def f18(spark, d):
    return addresses(spark, d).select(
        "o_orderkey", "addr", tx.btc_valid(F.col("addr")).alias("btc_ok"), tx.eth_valid(F.col("addr")).alias("eth_ok")
    )


QUERIES["f18_address_valid"] = f18
ORACLE["f18_address_valid"] = f"""
select o_orderkey, addr, length(addr) between 26 and 35 and regexp_matches(addr, '{fv.BTC_CHARSET}') as btc_ok,
 regexp_matches(addr, '{fv.ETH_PATTERN}') as eth_ok from (select o_orderkey, {_ADDR_DUCK} as addr from orders)"""


def c22(spark, d):
    notes = tb.load(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("pay "), F.expr(_ADDR_SPARK), F.lit(" then "), F.col("o_orderpriority"), F.lit(".")).alias("text")
    )
    docs = tb.ev_files(spark, d).select(F.col("file_id").alias("o_orderkey"), "text")
    return tx.wallet_addresses(notes.unionByName(docs), "o_orderkey")


QUERIES["c22_wallet_addresses"] = c22
ORACLE["c22_wallet_addresses"] = f"""
select * from (select o_orderkey, address, case when regexp_matches(address, '{fv.ETH_PATTERN}') then 'ETH'
  when length(address) between 26 and 35 and regexp_matches(address, '{fv.BTC_CHARSET}') then 'BTC' end as currency
 from (select o_orderkey, unnest(regexp_extract_all(text, '{fv.WALLET_TOKEN}')) as address from
  (select o_orderkey, 'pay ' || {_ADDR_DUCK} || ' then ' || o_orderpriority || '.' as text from orders
   union all select file_id, text from {tb.EV_FILES}))) where currency is not null"""


def f21(spark, d):
    return tx.suspicious_strings(tb.ev_files(spark, d), "file_id")


QUERIES["f21_suspicious_strings"] = f21
ORACLE["f21_suspicious_strings"] = f"""
select file_id, unnest(list_filter({sql_list(fv.SUSPICIOUS_TERMS)}, lambda w: contains(lower(text), w))) as term from {tb.EV_FILES}"""


def marked_files(spark, d):
    """The files with a key marker in front, chosen by file id; two ids in twelve get none."""
    lead = F.lit(b"")
    for i, (_, h) in enumerate(fv.KEY_MARKERS):
        lead = F.when(F.col("file_id") % 12 == i, F.unhex(F.lit(h))).otherwise(lead)
    return tb.ev_bytes(spark, d).select("file_id", F.concat(F.encode(F.lit("x"), "utf-8"), lead, F.col("data")).alias("data"))


MARKED = "(select file_id, '78' || case file_id % 12 " + " ".join(
    f"when {i} then '{h.upper()}'" for i, (_, h) in enumerate(fv.KEY_MARKERS)
) + f" else '' end || hx as hx from {tb.EV_BYTES})"


def c20(spark, d):
    return tx.key_material(marked_files(spark, d), "file_id")


QUERIES["c20_key_material"] = c20
# byte-exact: a hex hit counts only at an even place
ORACLE["c20_key_material"] = " union all ".join(
    f"select file_id, '{n}' as algorithm, 0.8::double as confidence from {MARKED} "
    f"where regexp_matches(hx, '^(?:..)*?{h.upper()}')"
    for n, h in fv.KEY_MARKERS
)


# tool logs written from order lines
_TLOG_SPARK = """concat('Found ', cast(l_linenumber as string), ' atoms\\nmdat size: ', cast(l_partkey as string),
  case when l_suppkey % 2 = 0 then concat('\\nDuration: ', cast(cast(l_quantity as int) as string), '.5') else '' end,
  case when l_suppkey % 3 = 0 then '\\nfound 2 TRACKS' else '' end,
  '\\nVideo codec: ', case when l_returnflag = 'A' then 'h264' else 'hevc' end,
  case when l_returnflag = 'R' then concat('\\nframe= ', cast(l_orderkey as string), ' Error: corrupt block\\nframe=x error invalid data') else '' end,
  repeat('\\nmissing packet, failed', cast(l_quantity / 10 as int)))"""
_TLOG_DUCK = """'Found ' || l_linenumber || ' atoms' || chr(10) || 'mdat size: ' || l_partkey ||
  case when l_suppkey % 2 = 0 then chr(10) || 'Duration: ' || l_quantity::int || '.5' else '' end ||
  case when l_suppkey % 3 = 0 then chr(10) || 'found 2 TRACKS' else '' end ||
  chr(10) || 'Video codec: ' || case when l_returnflag = 'A' then 'h264' else 'hevc' end ||
  case when l_returnflag = 'R' then chr(10) || 'frame= ' || l_orderkey || ' Error: corrupt block' || chr(10) || 'frame=x error invalid data' else '' end ||
  repeat(chr(10) || 'missing packet, failed', floor(l_quantity / 10)::int)"""


def tool_logs(spark, d):
    return tb.load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(_TLOG_SPARK).alias("log")
    )


_TLOGS = f"(select l_orderkey, l_linenumber, l_partkey, l_suppkey, {_TLOG_DUCK} as log from lineitem)"


def c16(spark, d):
    m = tool_logs(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", tx.parse_tool_log(F.col("log")).alias("m"))
    return m.select("l_orderkey", "l_linenumber", "l_partkey", *[F.col("m")[n].alias(n) for n, _ in fv.TOOL_LOG_FIELDS])


QUERIES["c16_parse_tool_log"] = c16
ORACLE["c16_parse_tool_log"] = "select l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    f"nullif(regexp_extract(log, '(?i){p}', 1), '') as {n}" for n, p in fv.TOOL_LOG_FIELDS
) + f" from {_TLOGS}"


def c17(spark, d):
    return tool_logs(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", tx.log_error_score(F.col("log")).alias("score"))


QUERIES["c17_log_error_score"] = c17
_occ = " + ".join(
    f"(length(lower(log)) - length(replace(lower(log), '{w}', ''))) // {len(w)}" for w in fv.LOG_ERROR_WORDS
)
ORACLE["c17_log_error_score"] = f"""
select l_orderkey, l_linenumber, l_partkey, case when n = 0 then 1.0 when n <= 2 then 0.8 when n <= 5 then 0.6 when n <= 10 then 0.4 else 0.2 end::double as score
from (select *, {_occ} as n from {_TLOGS})"""


def c18(spark, d):
    t = F.col("log")
    return tool_logs(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(tx.corruption_share(t), 6).alias("corruption"),
        F.array_join(tx.error_frames(t).cast("array<string>"), ",").alias("frames"),
    )


QUERIES["c18_text_corruption"] = c18
ORACLE["c18_text_corruption"] = f"""
select l_orderkey, l_linenumber, l_partkey, round(least({sql_hits('lower(log)', fv.CORRUPTION_WORDS)} * 0.1::double, 1.0), 6) as corruption,
 array_to_string(list_filter(list_transform(list_filter(string_split(log, chr(10)),
   lambda x: contains(lower(x), 'frame=') and contains(lower(x), 'error')),
   lambda x: regexp_extract(x, 'frame=\\s*(\\d+)(?:\\s|$)', 1)), lambda x: x <> ''), ',') as frames from {_TLOGS}"""
