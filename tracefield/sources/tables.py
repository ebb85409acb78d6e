"""The given parquet tables, recast as evidence tables.

Each view exists twice: as a DataFrame (functions) and as a SQL subquery
(upper-case constants) that the independent check runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefield.operators.ordered import running_sum
from tracefield.session import checkpoint


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work on a few-split input every core.

    A small file is one split and would keep one core busy; a scan that already
    has a split per core (any large input) is returned as it is, unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ev_files(spark, sf_dir):
    """Text files: path, extension, content, byte size."""
    return spread(load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")).select(
        F.col("doc_id").alias("file_id"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"),
        F.col("lang").alias("ext"),
        "text",
        F.octet_length("text").cast("bigint").alias("size"),
    )


EV_FILES = """(select doc_id as file_id, source || '/' || doc_id || '.' || lang as path, lang as ext,
  text, strlen(text)::bigint as size from documents)"""


def ev_bytes(spark, sf_dir):
    """The same files as bytes."""
    return spread(load(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select(
        F.col("doc_id").alias("file_id"),
        F.col("lang").alias("ext"),
        F.col("text").cast("binary").alias("data"),
    )


EV_BYTES = """(select doc_id as file_id, lang as ext, hex(encode(text)) as hx, strlen(text)::bigint as size
  from documents)"""

def ev_image(spark, sf_dir):
    """Pages in id order as one byte image: (image_id, chunk_no, base_offset, data)."""
    stored = load(spark, sf_dir, "pages").select("page_id", "html")
    pages = spread(stored).select(
        F.lit("pages").alias("image_id"),
        F.col("page_id").alias("chunk_no"),
        F.col("html").cast("binary").alias("data"),
    )
    # offsets come from lengths only; the bytes themselves never enter a sort
    sizes = stored.select(
        F.lit("pages").alias("image_id"), F.col("page_id").alias("chunk_no"), F.octet_length("html").cast("bigint").alias("n")
    )
    offsets = running_sum(
        sizes, ["image_id"], ["chunk_no"], F.floor(F.col("chunk_no") / 4096), F.col("n"),
        "base_offset", include_current=False,
    ).drop("n")
    return pages.join(offsets, ["image_id", "chunk_no"])


EV_IMAGE = """(select 'pages' as image_id, page_id as chunk_no, html,
  (coalesce(sum(strlen(html)) over (order by page_id rows between unbounded preceding and 1 preceding), 0))::bigint as base_offset,
  strlen(html)::bigint as n from pages)"""


# what the packets carry in front of their properties, and the hosts they name
PAYLOAD_LEADS = [
    b"GET /", b"HTTP/1.1 200 ", b"\x16\x03\x01", b"220 ready ", b"USER x", b"EHLO y", b"\x00\x01\x00\x00",
    b"x cmd=", b"1 UNION SELECT ", b"<script>", b"\x90\x90\x90\x90", b"RCPT TO:msf_", b"plain ",
]
HOSTS = [".example.com", ".bit.ly", ".mybit.ly", ".duckdns.org", "t.co", ".a.tinyurl.com", ".example.org"]


def _lead():
    leads = F.array(*[F.lit(x.hex()) for x in PAYLOAD_LEADS])
    return F.element_at(leads, (F.col("event_id") % len(PAYLOAD_LEADS) + 1).cast("int"))


def net_packets(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.col("event_id").alias("packet_id"),
        "ts",
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("src_ip"),
        (F.lit(1024) + F.col("user_id")).alias("src_port"),
        F.concat(F.lit("192.168.1."), k).alias("dst_ip"),
        (F.lit(20) + F.col("event_id") % 40).alias("dst_port"),
        F.col("event_type").alias("protocol"),
        F.round(F.col("value") * 100).cast("bigint").alias("size"),
        F.when(F.col("event_id") % 2 == 0, "inbound").otherwise("outbound").alias("direction"),
        F.concat(F.unhex(_lead()), F.col("props").cast("binary")).alias("payload"),
        F.concat(
            F.lit("h"), F.col("user_id").cast("string"),
            F.element_at(F.array(*[F.lit(x) for x in HOSTS]), (F.col("event_id") % len(HOSTS) + 1).cast("int")),
        ).alias("host"),
    )


NET = """(select event_id as packet_id, ts, '10.0.0.' || user_id as src_ip, 1024 + user_id as src_port,
  '192.168.1.' || json_extract_string(props, '$.k') as dst_ip, 20 + event_id % 40 as dst_port,
  event_type as protocol, round(value*100)::bigint as size,
  case when event_id % 2 = 0 then 'inbound' else 'outbound' end as direction,
  list_extract(@leads, (event_id % @nleads + 1)::bigint) || hex(encode(props)) as payload,
  'h' || user_id || list_extract(@hosts, (event_id % @nhosts + 1)::bigint) as host from events)"""
NET = (
    NET.replace("@leads", "[" + ",".join(f"'{x.hex().upper()}'" for x in PAYLOAD_LEADS) + "]")
    .replace("@nleads", str(len(PAYLOAD_LEADS)))
    .replace("@hosts", "[" + ",".join(f"'{x}'" for x in HOSTS) + "]")
    .replace("@nhosts", str(len(HOSTS)))
)


def tx_edges(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    o = load(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("tx_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("from_addr"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("to_addr"),
        F.col("l_extendedprice").alias("value"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("fee"),
        F.col("o_orderdate").alias("ts"),
        F.col("l_linenumber").alias("leg"),
    )


TX = """(select l_orderkey as tx_id, 'C' || o_custkey as from_addr, 'S' || l_suppkey as to_addr,
  l_extendedprice as value, l_extendedprice * l_tax as fee, o_orderdate as ts, l_linenumber as leg
  from lineitem join orders on l_orderkey = o_orderkey)"""


def tx_graph(spark, sf_dir):
    """Payments both ways: customer to supplier, and back for returned lines."""
    li = load(spark, sf_dir, "lineitem")
    o = load(spark, sf_dir, "orders")
    c = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    s = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    legs = F.array(
        F.struct(c.alias("from_addr"), s.alias("to_addr"), F.col("o_orderdate").alias("ts")),
        F.when(
            F.col("l_returnflag") == "R",
            F.struct(s.alias("from_addr"), c.alias("to_addr"), F.col("l_shipdate").alias("ts")),
        ),
    )
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("tx_id"),
        F.col("l_extendedprice").alias("value"),
        F.inline(F.filter(legs, lambda x: x.isNotNull())),
    )


GRAPH = """(select l_orderkey as tx_id, l_extendedprice as value, 'C' || o_custkey as from_addr, 'S' || l_suppkey as to_addr, o_orderdate as ts
  from lineitem join orders on l_orderkey = o_orderkey union all
  select l_orderkey, l_extendedprice, 'S' || l_suppkey, 'C' || o_custkey, l_shipdate
  from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R')"""


def tx_inputs(spark, sf_dir):
    """Inputs spent together: the stock addresses (part and supplier) of one order."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("tx_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_suppkey").cast("string")).alias("addr"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_shipdate").alias("ts"),
    )


TX_INPUTS = """(select l_orderkey as tx_id, 'P' || l_partkey || '.' || l_suppkey as addr, l_extendedprice as value, l_shipdate as ts from lineitem)"""


def intel(spark, sf_dir):
    """Black list: suppliers with a negative balance."""
    return (
        load(spark, sf_dir, "supplier")
        .filter("s_acctbal < 0")
        .select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("addr"))
    )


INTEL = "(select 'S' || s_suppkey as addr from supplier where s_acctbal < 0)"


def fs_entries(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    ship = (
        load(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.max("l_shipdate").alias("modified"))
    )
    return o.join(ship, o.o_orderkey == ship.l_orderkey).select(
        F.col("o_orderkey").alias("inode"),
        F.concat(F.lit("/vol/"), F.col("o_orderkey").cast("string")).alias("path"),
        F.col("o_orderdate").alias("created"),
        "modified",
        (F.col("o_orderstatus") == "F").alias("is_deleted"),
        F.col("o_totalprice").alias("size"),
    )


FS = """(select o_orderkey as inode, '/vol/' || o_orderkey as path, o_orderdate as created, modified,
  o_orderstatus = 'F' as is_deleted, o_totalprice as size
  from orders join (select l_orderkey, max(l_shipdate) as modified from lineitem group by 1) on l_orderkey = o_orderkey)"""


def repair_runs(spark, sf_dir):
    flag = F.col("l_returnflag")
    return load(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scenario_id"),
        F.when(flag == "A", "untrunc").when(flag == "N", "ffmpeg").otherwise("mp4recover").alias("tool"),
        (F.col("l_linestatus") == "F").alias("success"),
        (1 - F.col("l_discount") * 5).alias("quality"),
        F.col("l_quantity").alias("file_size_mb"),
        (F.col("l_discount") * 10).alias("severity"),
        F.col("l_shipdate").alias("completed_at"),
        F.col("l_extendedprice").alias("seconds"),
        F.col("l_suppkey").alias("host"),
        F.col("l_partkey").alias("asset"),
    )


RUNS = """(select l_orderkey * 10 + l_linenumber as scenario_id,
  case l_returnflag when 'A' then 'untrunc' when 'N' then 'ffmpeg' else 'mp4recover' end as tool,
  l_linestatus = 'F' as success, 1 - l_discount*5 as quality, l_quantity as file_size_mb,
  l_discount*10 as severity, l_shipdate as completed_at, l_extendedprice as seconds, l_suppkey as host,
  l_partkey as asset from lineitem)"""


def scenarios(spark, sf_dir):
    """Repair scenarios: one per order line, container and codec from part and flags."""
    li = load(spark, sf_dir, "lineitem")
    pr = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    n = F.col("l_partkey") % 4
    c = F.col("l_suppkey") % 4
    return li.join(pr, li.l_orderkey == pr.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scenario_id"),
        F.col("l_partkey").alias("asset"),
        (F.col("l_quantity") * 25).alias("file_size_mb"),
        (F.col("l_quantity") * 6).alias("duration_seconds"),
        (F.col("l_tax") * 100).alias("bitrate_mbps"),
        F.when(n == 0, 3840).otherwise(1280).alias("width"),
        F.when(n == 0, 2160).otherwise(720).alias("height"),
        (F.col("l_discount") * 10).alias("corruption_severity"),
        (F.col("l_returnflag") == "R").alias("header_corruption"),
        (F.col("l_returnflag") == "A").alias("metadata_corruption"),
        (F.col("l_linestatus") == "F").alias("stream_corruption"),
        (F.col("l_linenumber") > 4).alias("fragment_corruption"),
        F.when(n == 0, "mp4").when(n == 1, "mov").when(n == 2, "avi").otherwise("mkv").alias("container_format"),
        F.when(c == 0, "h264").when(c == 1, "h265").when(c == 2, "ProRes 422").otherwise("vp9").alias("video_codec"),
        F.when(F.col("o_orderpriority").startswith("1"), "high_quality")
        .when(F.col("o_orderpriority").startswith("5"), "fast")
        .otherwise("balanced").alias("quality_requirements"),
        F.when(F.col("o_orderpriority").startswith("5"), 1200).otherwise(3600).alias("max_processing_time"),
        (F.col("l_linenumber") == 1).alias("reference_file_available"),
        F.when(F.col("l_linenumber") > 5, F.array(F.lit("fragmented"), F.lit("tail")))
        .otherwise(F.array(F.lit("tail"))).alias("corruption_patterns"),
        F.lit(3).alias("available_tools"),
        F.col("l_shipdate").alias("ts"),
    )


SCEN = """(select l_orderkey*10 + l_linenumber as scenario_id, l_partkey as asset, l_quantity*25 as file_size_mb,
  l_quantity*6 as duration_seconds, l_tax*100 as bitrate_mbps,
  case when l_partkey % 4 = 0 then 3840 else 1280 end as width,
  case when l_partkey % 4 = 0 then 2160 else 720 end as height,
  l_discount*10 as corruption_severity, l_returnflag = 'R' as header_corruption,
  l_returnflag = 'A' as metadata_corruption, l_linestatus = 'F' as stream_corruption,
  l_linenumber > 4 as fragment_corruption,
  case l_partkey % 4 when 0 then 'mp4' when 1 then 'mov' when 2 then 'avi' else 'mkv' end as container_format,
  case l_suppkey % 4 when 0 then 'h264' when 1 then 'h265' when 2 then 'ProRes 422' else 'vp9' end as video_codec,
  case substr(o_orderpriority,1,1) when '1' then 'high_quality' when '5' then 'fast' else 'balanced' end as quality_requirements,
  case substr(o_orderpriority,1,1) when '5' then 1200 else 3600 end as max_processing_time,
  l_linenumber = 1 as reference_file_available,
  case when l_linenumber > 5 then ['fragmented','tail'] else ['tail'] end as corruption_patterns,
  3 as available_tools, l_shipdate as ts
  from lineitem join orders on l_orderkey = o_orderkey)"""


def op_log(spark, sf_dir):
    t = F.col("event_type")
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("entry_id"),
        "ts",
        F.when(t == "error", "ERROR").when(t == "purchase", "AUDIT").when(t == "signup", "INFO")
        .when(t == "view", "WARN").otherwise("DEBUG").alias("level"),
        t.alias("operation"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("context"),
        F.col("props").alias("message"),
        F.col("value"),
    )


LOG = """(select event_id as entry_id, ts, case event_type when 'error' then 'ERROR' when 'purchase' then 'AUDIT'
  when 'signup' then 'INFO' when 'view' then 'WARN' else 'DEBUG' end as level, event_type as operation,
  'u' || user_id as context, props as message, value from events)"""


def jobs(spark, sf_dir):
    """Jobs: an order is a job, its last shipment the end time, its customer the workflow."""
    o = load(spark, sf_dir, "orders")
    ship = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("finished"), F.count(F.lit(1)).alias("units")
    )
    s = F.col("o_orderstatus")
    return o.join(ship, o.o_orderkey == ship.l_orderkey).select(
        F.col("o_orderkey").alias("job_id"),
        F.concat(F.lit("wf"), (F.col("o_custkey")).cast("string")).alias("workflow_id"),
        F.when(s == "F", "COMPLETED").when(s == "P", "RUNNING").otherwise("QUEUED").alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.col("o_orderdate").alias("started"),
        F.when(s == "F", F.col("finished")).alias("finished"),
        "units",
    )


JOBS = """(select o_orderkey as job_id, 'wf' || o_custkey as workflow_id,
  case o_orderstatus when 'F' then 'COMPLETED' when 'P' then 'RUNNING' else 'QUEUED' end as status,
  substr(o_orderpriority,1,1)::int as priority, o_orderdate as started,
  case when o_orderstatus = 'F' then finished end as finished, units
  from orders join (select l_orderkey, max(l_shipdate) as finished, count(*) as units from lineitem group by 1)
  on l_orderkey = o_orderkey)"""


def index_rows(spark, sf_dir):
    """Frame index per asset: offsets run over quantities; every 50th is off by -7."""
    li = load(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("file_id"), "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey",
        F.col("l_quantity").cast("bigint").alias("size"),
        F.col("l_extendedprice").alias("tie"),
    )
    summed = running_sum(
        li, ["file_id"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "tie"],
        F.trunc("l_shipdate", "year"), F.col("size"), "offset",
    )
    bent = F.when(F.col("l_orderkey") % 50 == 0, F.col("offset") - 60).otherwise(F.col("offset"))
    # written once: the users of this table walk it several times
    return checkpoint(summed.select("file_id", "size", bent.alias("offset"), F.col("offset").alias("slot")))


INDEX = """(select file_id, size, case when ok % 50 = 0 then slot - 60 else slot end as "offset", slot from
  (select l_partkey as file_id, l_quantity::bigint as size, l_orderkey as ok,
   (sum(l_quantity::bigint) over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice
     rows unbounded preceding))::bigint as slot from lineitem))"""


def bad_sectors(spark, sf_dir):
    return (
        load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
        .select(F.col("l_orderkey").alias("sector")).distinct()
    )


BAD = "(select distinct l_orderkey as sector from lineitem where l_returnflag = 'R')"


def series(spark, sf_dir):
    """Minute averages per event type; minutes without an event are absent."""
    return (
        load(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("name"), F.date_trunc("minute", "ts").alias("minute"))
        .agg(F.avg("value").alias("x"))
        .withColumn("idx", F.floor(F.unix_micros(F.col("minute").cast("timestamp")) / 60000000))
        .select("name", "idx", "x")
    )


SERIES = """(select event_type as name, (epoch_us(date_trunc('minute', ts)) // 60000000)::bigint as idx, avg(value) as x
  from events group by 1, 2)"""


def vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


# (hex lead, hex tail, extension) given to the files by ``file_id % len``; the rest is the text
FILE_LEADS = [
    ("FFD8FFE000104A46", "FFD9", "jpg"),
    ("FFD8FFE000104A46", "", "jpg"),
    ("89504E470D0A1A0A", "", "png"),
    ("474946383761", "", "gif"),
    ("424D", "", "bmp"),
    ("255044462D312E34", "0A2525454F46", "pdf"),
    ("D0CF11E0A1B11AE1", "", "doc"),
    ("504B0304140006000000776F72642F", "504B0506", "zip"),
    ("504B0304140006000000786C2F", "504B0506", "zip"),
    ("504B030414000600", "504B0506", "zip"),
    ("0000001866747970717420200000", "", "mov"),
    ("00000018667479706D703432" + "0000000000000167", "", "mp4"),
    ("0000001866747970" + "6D703432" + "6D6F6F76", "", "mp4"),
    ("52494646000000004156492044697658", "", "avi"),
    ("1A45DFA3010000007765626D", "", "mkv"),
    ("1A45DFA301000000", "", "mkv"),
    ("464C5601", "", "flv"),
    ("4D5A9000", "", "exe"),
    ("4944330400", "", "mp3"),
    ("3026B2758E66CF11", "", "wmv"),
    ("000001B000000140", "", "mpg"),
    ("000001B3", "", "mpg"),
    ("", "", "txt"),
    ("", "", "mp4"),
    ("", "", "jpg"),
]


def typed_files(spark, sf_dir):
    """Files with real magic bytes around their text: (file_id, ext, data); every 50th is empty."""
    n = len(FILE_LEADS)
    i = F.col("file_id") % n
    pick = lambda j: F.element_at(F.array(*[F.lit(x[j]) for x in FILE_LEADS]), (i + 1).cast("int"))
    body = F.concat(F.unhex(pick(0)), F.col("data"), F.unhex(pick(1)))
    return ev_bytes(spark, sf_dir).select(
        "file_id",
        pick(2).alias("ext"),
        F.when(F.col("file_id") % 50 == 49, F.unhex(F.lit(""))).otherwise(body).alias("data"),
    )


def _pick(j):
    return "list_extract([" + ",".join(f"'{x[j]}'" for x in FILE_LEADS) + f"], (file_id % {len(FILE_LEADS)} + 1)::bigint)"


TYPED = f"""(select file_id, {_pick(2)} as ext,
  case when file_id % 50 = 49 then '' else {_pick(0)} || hx || {_pick(1)} end as hx from {EV_BYTES})"""


def cipher_files(spark, sf_dir):
    """Bytes with the look of ciphertext: 4096 hash bytes, repeated 16-byte blocks, or plain text."""
    i = F.col("file_id")
    dig = F.expr("concat_ws('', transform(sequence(1, 128), k -> sha2(concat(cast(file_id as string), ':', cast(k as string)), 256)))")
    blk = F.expr("concat_ws('', transform(sequence(1, 64), k -> md5(concat(cast(file_id as string), ':', cast(k % 40 as string)))))")
    return ev_bytes(spark, sf_dir).select(
        "file_id",
        F.when(i % 3 == 0, F.unhex(dig)).when(i % 3 == 1, F.unhex(blk)).otherwise(F.col("data")).alias("data"),
    )


CIPHER = f"""(select file_id, case file_id % 3
   when 0 then upper(array_to_string(list_transform(range(1, 129), lambda k: sha256(file_id || ':' || k)), ''))
   when 1 then upper(array_to_string(list_transform(range(1, 65), lambda k: md5(file_id || ':' || (k % 40))), ''))
   else hx end as hx from {EV_BYTES})"""


def byte_rows(source: str) -> str:
    """SQL: one row per byte of a (file_id, hx) subquery."""
    return f"""(select file_id, pos, ('0x' || h)::integer as b from
  (select file_id, unnest(range(len(l))) as pos, unnest(l) as h from
   (select file_id, regexp_extract_all(hx, '..') as l from {source})))"""
