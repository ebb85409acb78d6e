"""Network traffic: counts, flows, anomalies, enrichment.

Plain aggregates combine on the map side, so a host with a third of the
packets costs no more than any other. Distinct counts go through (key, value)
pairs first. Ordered steps use time buckets (see ``ordered``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefield.functions import fixed_values as fv
from tracefield.operators import ordered as od
from tracefield.session import checkpoint


def protocol_distribution(packets: DataFrame) -> DataFrame:
    g = packets.groupBy("protocol").agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum("size").alias("bytes"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )
    ends = (
        packets.select("protocol", F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
        .distinct()
        .groupBy("protocol")
        .agg(F.count(F.lit(1)).alias("endpoints"))
    )
    total = packets.agg(F.count(F.lit(1))).scalar()
    return g.join(ends, "protocol").withColumn("share", F.col("packets") * 100.0 / total)


def traffic_volume(packets: DataFrame) -> DataFrame:
    inbound = F.col("direction") == "inbound"
    return packets.agg(
        F.sum("size").alias("total_bytes"),
        F.sum(F.when(inbound, F.col("size")).otherwise(0)).alias("inbound_bytes"),
        F.sum(F.when(inbound, 0).otherwise(F.col("size"))).alias("outbound_bytes"),
    )


def host_traffic(packets: DataFrame) -> DataFrame:
    def end(ip, port):
        return F.concat_ws(":", ip, F.col(port).cast("string"))

    return (
        packets.select(F.explode(F.array(end("src_ip", "src_port"), end("dst_ip", "dst_port"))).alias("host"), "size")
        .groupBy("host")
        .agg(F.sum("size").alias("bytes"))
    )


def top_talkers(packets: DataFrame, k: int = 10) -> DataFrame:
    return host_traffic(packets).orderBy(F.desc("bytes"), "host").limit(k)


FLOW = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol"]


def flows(packets: DataFrame) -> DataFrame:
    """One row per directed 5-tuple."""
    return packets.groupBy(*FLOW).agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count(F.lit(1)).alias("packets"),
        F.sum("size").alias("bytes"),
    )


def flow_segments(packets: DataFrame, per_segment: int = 1024, bucket: str = "hour") -> DataFrame:
    """Payload in time order, cut into numbered segments of ``per_segment`` packets.

    The whole stream of a flow is its segments in order; no cell holds an
    unbounded flow.
    """
    numbered = od.dense_index(packets, FLOW, ["ts", "packet_id"], F.date_trunc(bucket, "ts"), "_i")
    return (
        numbered.withColumn("segment", F.floor(F.col("_i") / per_segment))
        .groupBy(*FLOW, "segment")
        .agg(
            F.min("ts").alias("start_ts"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("_i", F.hex("payload").alias("p")))), lambda x: x["p"]
                ),
                "",
            ).alias("payload_hex"),
        )
    )


def bidirectional_flows(packets: DataFrame) -> DataFrame:
    a = F.concat_ws(":", "src_ip", F.col("src_port").cast("string"))
    b = F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string"))
    fwd = a <= b
    return (
        packets.select(F.least(a, b).alias("end_a"), F.greatest(a, b).alias("end_b"), fwd.alias("fwd"), "protocol", "size", "ts")
        .groupBy("end_a", "end_b", "protocol")
        .agg(
            F.sum(F.col("fwd").cast("bigint")).alias("packets_ab"),
            F.sum((~F.col("fwd")).cast("bigint")).alias("packets_ba"),
            F.sum(F.when(F.col("fwd"), F.col("size")).otherwise(0)).alias("bytes_ab"),
            F.sum(F.when(F.col("fwd"), 0).otherwise(F.col("size"))).alias("bytes_ba"),
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("end_ts"),
        )
    )


def contact_network(packets: DataFrame) -> DataFrame:
    return (
        packets.groupBy(F.least("src_ip", "dst_ip").alias("node_a"), F.greatest("src_ip", "dst_ip").alias("node_b"))
        .agg(F.count(F.lit(1)).alias("contacts"), F.sum("size").alias("weight"))
    )


def port_scan(packets: DataFrame, ports: int) -> DataFrame:
    return (
        packets.select("src_ip", "dst_ip", "dst_port").distinct()
        .groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("ports"))
        .filter(F.col("ports") >= ports)
    )


def ddos(packets: DataFrame, window: str, sources: int) -> DataFrame:
    return (
        packets.select("dst_ip", "src_ip", F.window("ts", window).start.alias("window_start")).distinct()
        .groupBy("dst_ip", "window_start").agg(F.count(F.lit(1)).alias("sources"))
        .filter(F.col("sources") >= sources)
    )


def unusual_protocols(packets: DataFrame, share_pct: float) -> DataFrame:
    return protocol_distribution(packets).filter(F.col("share") < share_pct)


def exfiltration(packets: DataFrame, k: float) -> DataFrame:
    hosts = packets.filter("direction <> 'inbound'").groupBy("src_ip").agg(F.sum("size").alias("out_bytes"))
    limit = hosts.agg(F.avg("out_bytes") + k * F.stddev_pop("out_bytes")).scalar()
    return hosts.filter(F.col("out_bytes") > limit)


def protocol_by_payload(packets: DataFrame) -> DataFrame:
    """Every protocol whose marker the payload starts with, in table order; the first is primary."""
    tests = []
    for name, marks in fv.PROTOCOL_SIGNATURES:
        cond = F.lit(False)
        for m in marks:
            cond = cond | F.startswith(F.col("payload"), F.unhex(F.lit(m.encode("latin-1").hex())))
        tests.append(F.when(cond, F.lit(name)))
    found = F.filter(F.array(*tests), lambda x: x.isNotNull())
    return packets.select("packet_id", F.posexplode(found).alias("rank", "app_protocol")).withColumn(
        "is_primary", F.col("rank") == 0
    )


def malicious_payload(packets: DataFrame) -> DataFrame:
    tests = [
        F.when(F.contains(F.col("payload"), F.unhex(F.lit(p.hex()))), F.lit(n)) for n, p in fv.MALICIOUS_PATTERNS
    ]
    return packets.select(
        "packet_id", "src_ip", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("threat")
    )


def extractable_flows(flow_rows: DataFrame, protocol: str = "app_protocol") -> DataFrame:
    p = F.col(protocol)
    route = (
        F.when(p.isin("HTTP", "HTTPS", "TLS"), "web").when(p == "FTP", "ftp").when(p == "SMTP", "mail")
    )
    return flow_rows.withColumn("route", route).filter("route is not null")


def suspicious_domains(packets: DataFrame, domains: DataFrame) -> DataFrame:
    """Packets whose host is, or ends in ``.``, a listed domain.

    Every dotted suffix of a distinct host meets the list in an equi-join, so
    neither side has to be small.
    """
    parts = F.split("host", r"\.")
    hosts = packets.select("host").distinct()
    flagged = (
        hosts.select(
            "host",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size(parts)),
                    lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
                )
            ).alias("domain"),
        )
        .join(domains, "domain", "left_semi")
        .select("host").distinct()
    )
    return packets.join(flagged, "host", "left_semi")


def ip_to_long(ip: Column) -> Column:
    p = F.split(ip, r"\.")
    return ((p[0].cast("bigint") * 256 + p[1].cast("bigint")) * 256 + p[2].cast("bigint")) * 256 + p[3].cast("bigint")


def geo_enrich(packets: DataFrame, ranges: DataFrame, ip: str = "dst_ip") -> DataFrame:
    """Attach ``country, isp, is_vpn`` of the range holding the address.

    ``ranges(ip_from, ip_to, country, isp, is_vpn)`` must not overlap. An as-of
    join: distinct addresses and range starts are ordered together, each /16 for
    itself (so at most 65,536 addresses a window, whatever the ranges), and every
    address sees the last range that began; then the packets meet the addresses.
    """
    held = F.struct("ip_to", "country", "isp", "is_vpn")
    starts = ranges.select(F.col("ip_from").alias("_pos"), F.lit(0).alias("_side"), F.lit(None).cast("string").alias(ip), held.alias("_range"))
    ips = packets.select(ip).distinct().select(ip_to_long(F.col(ip)).alias("_pos"), F.lit(1).alias("_side"), ip).filter("_pos is not null")
    both = starts.unionByName(ips.withColumn("_range", F.lit(None).cast(starts.schema["_range"].dataType)))
    seen = od.carry_last(both, [], ["_pos", "_side", ip], F.shiftright("_pos", 16), F.col("_range"), "_last")
    placed = seen.filter((F.col("_side") == 1) & (F.col("_pos") <= F.col("_last.ip_to"))).select(ip, "_last.country", "_last.isp", "_last.is_vpn")
    return packets.join(placed, ip, "left")


def rate_per_tick(counters: DataFrame, keys: list[str], order: str, counter: str, bucket: Column) -> DataFrame:
    """Counter minus previous counter; the first tick counts from zero."""
    lagged = od.lag_value(counters, keys, [order], bucket, F.col(counter), "_prev")
    return lagged.withColumn("rate", F.col(counter) - F.coalesce("_prev", F.lit(0))).drop("_prev")


def periodic_flows(packets: DataFrame, max_cv: float, min_gaps: int) -> DataFrame:
    """Endpoint pairs whose gaps between packets hardly vary."""
    keys = ["src_ip", "dst_ip"]
    t = packets.select(*keys, "packet_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    order = ["t", "packet_id"]
    gaps = od.lag_value(od.dealt(t, keys, order), keys, order, F.col("_part"), F.col("t"), "prev")
    cv = F.col("sd_gap") / F.col("mean_gap")
    return (
        gaps.filter("prev is not null")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("gaps"),
            F.avg(F.col("t") - F.col("prev")).alias("mean_gap"),
            F.stddev_pop(F.col("t") - F.col("prev")).alias("sd_gap"),
        )
        .filter((F.col("gaps") >= min_gaps) & (F.col("mean_gap") > 0) & (cv < max_cv))
        .withColumn("cv", cv)
    )


SEVERITY = {"exfiltration": 0.9, "ddos": 0.8, "malicious_traffic": 0.8, "port_scan": 0.6, "unusual_protocol": 0.4}


def union_anomalies(packets: DataFrame, ports=5, window="1 day", sources=8, share_pct=5.0, k=2.0) -> DataFrame:
    """The five detectors under one schema (kind, subject, severity, detail); the packets are read once."""
    packets = checkpoint(packets)

    def shape(df, kind, subject, detail):
        return df.select(
            F.lit(kind).alias("kind"), subject.alias("subject"), F.lit(SEVERITY[kind]).alias("severity"),
            detail.cast("bigint").alias("detail"),
        )

    bad = malicious_payload(packets).groupBy("src_ip", "threat").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        shape(port_scan(packets, ports), "port_scan", F.concat_ws(">", "src_ip", "dst_ip"), F.col("ports")),
        shape(ddos(packets, window, sources), "ddos",
              F.concat_ws("@", "dst_ip", F.date_format("window_start", "yyyy-MM-dd")), F.col("sources")),
        shape(bad, "malicious_traffic", F.concat_ws(":", "src_ip", "threat"), F.col("n")),
        shape(unusual_protocols(packets, share_pct), "unusual_protocol", F.col("protocol"), F.col("packets")),
        shape(exfiltration(packets, k), "exfiltration", F.col("src_ip"), F.col("out_bytes")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rank_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("severity"), F.desc("detail"), "kind", "subject")


def hourly_bursts(events: DataFrame, ts: str, n: int = 10) -> DataFrame:
    return (
        events.groupBy(F.date_trunc("hour", ts).cast(events.schema[ts].dataType).alias("first_seen"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter(F.col("occurrences") > n)
        .select(
            "first_seen", (F.col("first_seen") + F.expr("interval 1 hour")).alias("last_seen"), "occurrences",
            F.lit(0.8).alias("confidence"), F.lit(0.6).alias("suspicion"), F.lit("MEDIUM").alias("threat_level"),
        )
    )


def common_entities(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def timeline(entries: DataFrame) -> DataFrame:
    """Created / modified (only if it differs) / accessed events of file entries."""
    ev = F.array(
        F.struct(F.col("created").alias("ts"), F.lit("FILE_CREATED").alias("event"), F.lit(0.9).alias("confidence"), F.lit("STRONG").alias("evidence")),
        F.when(
            F.col("modified") != F.col("created"),
            F.struct(F.col("modified").alias("ts"), F.lit("FILE_MODIFIED").alias("event"), F.lit(0.9).alias("confidence"), F.lit("STRONG").alias("evidence")),
        ),
        F.struct(F.col("accessed").alias("ts"), F.lit("FILE_ACCESSED").alias("event"), F.lit(0.7).alias("confidence"), F.lit("MODERATE").alias("evidence")),
    )
    rows = F.filter(ev, lambda e: e.isNotNull() & e["ts"].isNotNull())
    return entries.select("path", F.inline(rows)).orderBy("ts", "path", "event")


def unified_timeline(*sources: DataFrame) -> DataFrame:
    """Sources already shaped (ts, source, subject, event), merged and time-ordered."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.orderBy("ts", "source", "subject", "event")
