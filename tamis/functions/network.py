"""Packets, flows and netflow: parsing, derived columns, aggregation to flows, sentences for language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Services of well-known ports; protocol numbers.
PORTS = {20: "FTP-data", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 67: "DHCP", 68: "DHCP", 80: "HTTP", 110: "POP3", 123: "NTP", 143: "IMAP", 161: "SNMP", 179: "BGP", 443: "HTTPS", 445: "SMB", 465: "SMTPS", 993: "IMAPS", 995: "POP3S", 1080: "SOCKS", 3306: "MySQL", 3389: "RDP", 5900: "VNC", 6881: "BitTorrent", 8080: "HTTP-alt", 8443: "HTTPS-alt", 137: "NetBIOS-NS", 138: "NetBIOS-DGM", 139: "NetBIOS-SSN", 1900: "SSDP", 3128: "HTTP-proxy", 5060: "SIP", 6666: "IRC", 6667: "IRC", 6697: "IRC-TLS", 10240: "Mirai-C2", 23231: "Mirai-report"}
PROTOCOLS = {6: "TCP", 17: "UDP", 1: "ICMP"}
FLAGS = {"fin": 0, "syn": 1, "rst": 2, "psh": 3, "ack": 4, "urg": 5}
KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol_int"]
#: Columns that a model sees, by kind of table.
PACKET_COLUMNS = ["protocol_int", "src_port", "dst_port", "pkt_len", "ttl", "tcp_flag_syn", "tcp_flag_ack", "tcp_flag_fin", "tcp_flag_rst", "tcp_flag_psh", "tcp_flag_urg", "interarrival_ms"]
FLOW_COLUMNS = ["protocol_int", "src_port", "dst_port", "pkt_count", "total_bytes", "mean_pkt_len", "max_pkt_len", "duration_ms", "mean_iat_ms", "std_iat_ms", "syn_count", "ack_count", "fin_count", "rst_count", "psh_count", "mean_ttl"]
NETFLOW_COLUMNS = ["proto_int", "dir_fwd", "dir_bwd", "dir_bi", "dur", "sport", "dport", "stos", "dtos", "tot_pkts", "tot_bytes", "src_bytes", "bytes_per_pkt", "src_byte_ratio"]
CIC_COLUMNS = ["Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Flow IAT Mean", "Flow IAT Std", "SYN Flag Count", "ACK Flag Count", "FIN Flag Count", "RST Flag Count", "Packet Length Mean"]
#: The botnet of each scenario.
BOTNETS = {1: "Neris", 2: "Neris", 3: "Rbot", 4: "Rbot", 5: "Virut", 6: "Menti", 7: "Sogou", 8: "Murlo", 9: "Neris", 10: "Rbot", 11: "Rbot", 12: "NSIS.ay", 13: "Virut"}


def port(c: Column) -> Column:
    """Decimal or 0x hexadecimal port; anything else is -1."""
    t = F.lower(F.trim(c.cast("string")))
    return F.coalesce(F.when(t.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(t, 3, 8), 16, 10).cast("bigint")).otherwise(t.try_cast("bigint")), F.lit(-1).cast("bigint"))


def lookup(c: Column, table: dict, default: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], default)


def port_label(c: Column) -> Column:
    name = F.create_map(*[F.lit(x) for kv in PORTS.items() for x in kv])[c.cast("int")]
    return F.when(name.isNull(), c.cast("bigint").cast("string")).otherwise(F.concat(c.cast("bigint").cast("string"), F.lit("("), name, F.lit(")")))


def protocol_name(c: Column) -> Column:
    return lookup(c, PROTOCOLS, F.lit("OTHER"))


def botnet_family(scenario: Column) -> Column:
    """The botnet of a scenario; null for an unknown one."""
    return F.create_map(*[F.lit(x) for kv in BOTNETS.items() for x in kv])[scenario.cast("int")]


def flag_bits(flags: Column) -> dict[str, Column]:
    return {f"tcp_flag_{name}": flags.bitwiseAND(1 << bit).cast("boolean").cast("int") for name, bit in FLAGS.items()}


def flow_id(*columns: str) -> Column:
    return F.concat_ws("_", *[F.col(c).cast("string") for c in columns])


def label_kind(c: Column) -> Column:
    """Botnet before Normal before Background; any other label raises."""
    has = lambda w: c.rlike(f"(?i){w}")
    return F.when(has("botnet"), "Botnet").when(has("normal"), "Normal").when(has("background"), "Background").otherwise(F.raise_error(F.concat(F.lit("unknown label kind: "), F.coalesce(c, F.lit("null")))))


def internal_host(src: Column, dst: Column, prefix: str) -> Column:
    """The destination if only it is internal, else the source."""
    return F.when(dst.startswith(prefix) & ~src.startswith(prefix), dst).otherwise(src)


def derived(rows: DataFrame) -> DataFrame:
    """proto_int, direction flags, bytes per packet and source share; a zero denominator gives null."""
    d, p = F.trim("dir"), F.lower("proto")
    return rows.withColumns({
        "proto_int": F.when(p == "tcp", 6).when(p == "udp", 17).when(p == "icmp", 1).otherwise(0),
        "dir_fwd": d.isin("->", "?>").cast("int"), "dir_bwd": d.isin("<-", "<?").cast("int"), "dir_bi": d.isin("<->", "<?>").cast("int"),
        "bytes_per_pkt": F.try_divide("tot_bytes", "tot_pkts"), "src_byte_ratio": F.try_divide("src_bytes", "tot_bytes"),
    })


def interarrival(packets: DataFrame, capture: list[str], order: list[str], width_us: int = 10_000_000) -> DataFrame:
    """interarrival_us since the packet before in the capture; the first has 0.

    Packets are ordered inside stretches of width_us (a row without time is a stretch of its own, before the others), so
    a task holds one stretch and not the capture; the last time of the stretch before is carried over."""
    p = packets.withColumns({"_c": F.to_json(F.struct(*capture)), "_b": F.floor(F.col("time_us") / width_us)})
    ends = p.groupBy("_c", "_b").agg(F.max("time_us").alias("_end"))
    ends = ends.select("_c", F.coalesce("_b", F.lit(-(2**62))).alias("_b"), F.lag("_end").over(W.partitionBy("_c").orderBy("_b")).alias("_last"))
    p = p.withColumn("_b", F.coalesce("_b", F.lit(-(2**62)))).join(ends, ["_c", "_b"])
    before = F.coalesce(F.lag("time_us").over(W.partitionBy("_c", "_b").orderBy(*order)), "_last")
    return p.withColumn("interarrival_us", F.coalesce(F.col("time_us") - before, F.lit(0))).drop("_c", "_b", "_last")


def flows(packets: DataFrame, key: list[str] = KEY, order: list[str] | None = None) -> DataFrame:
    """One row for each 5-tuple. Packets have time_us (integer microseconds), pkt_len, ttl, flags, label.

    Gaps come from a window over the key; their mean and population deviation from integer moments, so the result does
    not depend on the order of addition; the sum of squares becomes a double by its two 64-bit halves, as engines with 128-bit
    integers have it, since equal gaps leave only that rounding. Deviation is 0 unless there are two gaps or more; mean_ttl is 0 without ttl."""
    w = W.partitionBy(*key).orderBy("time_us", *(order or []))
    gap = (F.col("time_us") - F.lag("time_us").over(w)).cast("decimal(20,0)")
    g = packets.withColumn("gap", gap).groupBy(*key).agg(
        F.count("*").alias("pkt_count"), F.sum("pkt_len").alias("total_bytes"), F.max("pkt_len").alias("max_pkt_len"), F.min("time_us").alias("start_us"),
        (F.max("time_us") - F.min("time_us")).alias("duration_us"), F.count("gap").alias("gaps"), F.sum("gap").alias("s1"), F.sum((F.col("gap") * F.col("gap")).cast("decimal(38,0)")).alias("s2"),
        *[F.sum(f"tcp_flag_{f}").alias(f"{f}_count") for f in ("syn", "ack", "fin", "rst", "psh")], (F.avg("ttl") if "ttl" in packets.columns else F.lit(0.0)).alias("mean_ttl"), F.max("label").alias("label"))
    high, low = F.expr("s2 div 18446744073709551616BD"), F.expr("s2 % 18446744073709551616BD")
    n, s1, s2 = F.col("gaps").cast("double"), F.col("s1").cast("double"), low.cast("double") + high.cast("double") * 2.0**64
    return g.withColumns({
        "mean_pkt_len": F.col("total_bytes") / F.col("pkt_count"), "duration_ms": F.col("duration_us") / 1000,
        "mean_iat_ms": F.when(n > 0, s1 / n / 1000).otherwise(0.0), "std_iat_ms": F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), s2 / n - (s1 / n) * (s1 / n))) / 1000).otherwise(0.0),
    }).drop("gaps", "s1", "s2")


def first_packets(packets: DataFrame, k: int, key: list[str], order: list[str], value: str) -> DataFrame:
    """The first k values of each flow in order, padded with zeros to k."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    got = packets.withColumn("_r", rank).where(F.col("_r") <= k).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v")))).alias("a"))
    values = F.transform("a", lambda s: s["v"])
    return got.select(*key, F.slice(F.concat(values, F.array_repeat(F.lit(0).cast("bigint"), k)), 1, k).alias("first_values"))


def fixed(c: Column, digits: int) -> Column:
    """A number with so many decimals, rounded from its exact binary value (a true tie goes to the even digit)."""
    return F.replace(F.format_number(c.cast("double"), digits), F.lit(","), F.lit(""))


# The sentences are fixed values.
def flow_sentence() -> Column:
    tcp = F.format_string(". TCP flags observed: SYN=%d, ACK=%d, FIN=%d, RST=%d, PSH=%d", *[F.col(f"{f}_count") for f in ("syn", "ack", "fin", "rst", "psh")])
    body = F.format_string("A %s flow from port %s to port %s, with %d packets totaling %d bytes over %s ms (mean inter-arrival %s ms, std %s ms; mean packet size %s bytes)", "protocol", port_label(F.col("src_port")), port_label(F.col("dst_port")), "pkt_count", "total_bytes", fixed(F.col("duration_ms"), 1), fixed(F.col("mean_iat_ms"), 2), fixed(F.col("std_iat_ms"), 2), fixed(F.col("mean_pkt_len"), 0))
    return F.concat(body, F.when(F.col("protocol") == "TCP", tcp).otherwise(""), F.lit("."))


def flow_pairs() -> Column:
    """key=value form of a flow."""
    flags = F.format_string(", flags=[SYN:%d ACK:%d FIN:%d RST:%d]", *[F.col(f"{f}_count") for f in ("syn", "ack", "fin", "rst")])
    body = F.format_string("Network flow: proto=%s, src=%s, dst=%s, pkts=%d, bytes=%d, duration_ms=%s, mean_iat_ms=%s, std_iat_ms=%s, mean_pkt_len=%s", "protocol", port_label(F.col("src_port")), port_label(F.col("dst_port")), "pkt_count", "total_bytes", fixed(F.col("duration_ms"), 1), fixed(F.col("mean_iat_ms"), 2), fixed(F.col("std_iat_ms"), 2), fixed(F.col("mean_pkt_len"), 1))
    return F.concat(body, F.when(F.col("protocol") == "TCP", flags).otherwise(""))


def netflow_sentence() -> Column:
    body = F.format_string("A %s flow from port %s to port %s (direction %s), lasting %s s with %d packets totaling %d bytes, of which the source sent %d bytes", F.upper("proto"), port_label(F.col("sport")), port_label(F.col("dport")), F.trim("dir"), fixed(F.col("dur"), 3), F.col("tot_pkts").cast("bigint"), F.col("tot_bytes").cast("bigint"), F.col("src_bytes").cast("bigint"))
    state = F.trim("state")
    return F.concat(body, F.when((state != "") & (F.lower(state) != "nan"), F.concat(F.lit("; connection state "), state)).otherwise(""), F.lit("."))


def cic_sentence(columns: list[str]) -> Column:
    """A flow of a labelled flow table in words; a column that the table lacks counts as 0."""
    c = lambda name, kind: (F.col(f"`{name}`") if name in columns else F.lit(0)).cast(kind)
    n, x = (lambda name: c(name, "bigint")), (lambda name: c(name, "double"))
    return F.format_string(
        "A flow on destination port %s, lasting %s ms, with %d forward packets (%d bytes) and %d backward packets (%d bytes). Mean inter-arrival %s us (std %s us); mean packet size %s bytes. TCP flags observed: SYN=%d, ACK=%d, FIN=%d, RST=%d.",
        port_label(n("Destination Port")), fixed(x("Flow Duration") / 1000, 2), n("Total Fwd Packets"), n("Total Length of Fwd Packets"), n("Total Backward Packets"), n("Total Length of Bwd Packets"),
        fixed(x("Flow IAT Mean"), 1), fixed(x("Flow IAT Std"), 1), fixed(x("Packet Length Mean"), 0), *[n(f"{f} Flag Count") for f in ("SYN", "ACK", "FIN", "RST")])


def packet_sentence() -> Column:
    """A packet in words; the flags only for TCP."""
    flags = F.array_compact(F.array(*[F.when(F.col(f"tcp_flag_{f}") == 1, f.upper()) for f in ("syn", "ack", "fin", "rst", "psh", "urg")]))
    flags = F.concat(F.lit(", flags=["), F.when(F.size(flags) > 0, F.array_join(flags, ",")).otherwise("none"), F.lit("]"))
    body = F.format_string("Packet: protocol=%s, src_port=%s, dst_port=%s, pkt_len=%d, ttl=%d, interarrival_ms=%s", "protocol", port_label(F.col("src_port")), port_label(F.col("dst_port")), "pkt_len", "ttl", fixed(F.col("interarrival_ms"), 2))
    return F.concat(body, F.when(F.col("protocol") == "TCP", flags).otherwise(""))


def significant(c: Column, digits: int = 4) -> Column:
    """A number with so many significant digits, without trailing zeros; an exponent where it is below -4 or needs one."""
    science = F.format_string(f"%.{digits - 1}e", c)
    power = F.regexp_extract(science, "e([+-][0-9]+)$", 1).cast("int")
    bare = lambda s: F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"[.]?0+$", "")).otherwise(s)
    out = F.when(c == 0, "0")
    for e in range(-4, digits):
        out = out.when(power == e, bare(F.format_string(f"%.{digits - 1 - e}f", c)))
    return out.otherwise(F.concat(bare(F.regexp_extract(science, "^[^e]+", 0)), F.regexp_extract(science, "e.*$", 0)))


def statistic_sentence(values: dict[str, Column]) -> Column:
    """name=value pairs of a row of statistics."""
    return F.concat(F.lit("Packet stats: "), F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), v) for k, v in values.items()]))
