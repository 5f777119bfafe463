"""Host files rendered from the tables and parsed back into raw samples and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustloom.operators import normalize, series, snapshots
from trustloom.plans.tables import table


def text(*parts):
    """Concatenation of literals and columns as text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _events(spark, folder):
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("host"), F.col("event_id").alias("ts"), "event_type", "value",
        F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("bigint").alias("k"))


def _file(rows, name, content):
    return rows.select("host", "ts", (name if not isinstance(name, str) else F.lit(name)).alias("file"),
                       content.alias("content"))


def _meminfo(spark, folder):
    return snapshots.meminfo(_file(_events(spark, folder), "/proc/meminfo", text(
        "MemTotal:       ", F.col("ts") + 1000, " kB\nMemFree:  ", F.col("k"), " kB\nHugePages_Free:    ", F.col("k") % 3, "\n")))


def meminfo(spark, folder):
    return _meminfo(spark, folder).select("ts", "attr", "value")


def memory_metrics(spark, folder):
    out = normalize.normalize(_meminfo(spark, folder), normalize.mapping_table(spark))
    return out.select("host", "path", "metric", "ts", F.col("v_num").alias("value"))


def _process_files(spark, folder):
    letter = F.create_map(*[F.lit(x) for x in ("click", "R", "error", "Z", "purchase", "S", "signup", "D", "view", "I")])
    rows = _events(spark, folder)
    return _file(rows.withColumn("ts", F.expr("ts DIV 100")),
                 text("/proc/", F.col("k"), "/stat"),
                 text(F.col("k"), " (", F.col("event_type"), " x) ", F.element_at(letter, F.col("event_type")), " 1 ", F.col("k"), " 3"))


def process_counts(spark, folder):
    out = snapshots.process_counts(_process_files(spark, folder))
    return normalize.normalize(out, normalize.mapping_table(spark)).select("host", "ts", "metric", F.col("v_num").alias("value"))


def process_fields(spark, folder):
    return snapshots.process_fields(_process_files(spark, folder)).groupBy("attr", "value").agg(F.count(F.lit(1)).alias("n"))


MINUTE_NS = 60 * 10**9


def _cpu_periods(spark, folder, **cut):
    t = F.expr(f"ts DIV {MINUTE_NS}")
    content = text("cpu  ", t * 3, " 0 ", t, " ", t * 5 + F.col("k"), " ", t, " 0 0 0 ", t, " 0\ncpu0 1 2 3 4 5 6 7 8 9 10\nctxt ", t, "\n")
    rows = _events(spark, folder).withColumn("ts", F.col("ts") * MINUTE_NS)
    times = snapshots.cpu_times(_file(rows, "/proc/stat", content), 1)
    return snapshots.cpu_periods(times, **cut)


def _cpu_percent(spark, folder, **cut):
    return _cpu_periods(spark, folder, **cut).filter("entity = 'cpu'").select(
        "host", F.expr(f"ts DIV {MINUTE_NS}").alias("ts"), "user_perc", "system_all_perc", "idle_all_perc", "guest_all_perc", "total_period")


def cpu_percent(spark, folder):
    """Counters that grow with the event number, one a minute; percents against the tick before."""
    return _cpu_percent(spark, folder)


def cpu_percent_cut(spark, folder):
    """The same with every cpu's series cut into short pieces, as a hot one is."""
    return _cpu_percent(spark, folder, chunk_rows=3)


def cpu_metrics(spark, folder):
    """Times of all cpus as metrics, by way of raw rows."""
    raw = snapshots.cpu_raw(_cpu_periods(spark, folder))
    out = normalize.normalize(raw, normalize.mapping_table(spark))
    return out.select("host", "path", "entity", "metric", F.expr(f"ts DIV {MINUTE_NS}").alias("ts"), F.col("v_num").alias("value"))


def load_and_uptime(spark, folder):
    rows = _events(spark, folder)
    load = snapshots.loadavg(_file(rows, "/proc/loadavg", text(F.col("value"), " 0.5 1.25 ", F.col("k"), "/", F.col("ts"), " 77\n")))
    up = snapshots.uptime(_file(rows, "/proc/uptime", text(F.col("ts"), ".5 ", F.col("value"), "\n")))
    return load.unionByName(up).select("ts", "category", "attr", "value")


def _swap_raw(spark, folder):
    return snapshots.swaps(_file(_events(spark, folder), "/proc/swaps", text(
        "Filename Type Size Used Priority\n/dev/sda", F.col("k") % 4, " partition ", F.col("ts"), " ", F.col("k"), " -2\n")))


def swap_metrics(spark, folder):
    raw = _swap_raw(spark, folder)
    metrics = normalize.normalize(raw, normalize.mapping_table(spark)).unionByName(normalize.type_literals(raw))
    return metrics.select("host", "entity", "metric", "ts", F.col("v_num").alias("number"), F.col("v_str").alias("label"))


def _disk_files(spark, folder):
    rows = _events(spark, folder).withColumn("ts", F.col("ts") * 1_000_000)
    e = F.expr("ts DIV 1000000")
    return (_file(rows, "/proc/mounts", text("/dev/sda1 / ext4 rw 0 0\n/dev/sdb /x ext4 rw 0 0\n/dev/sdc2 /y xfs ro 0 0\n"))
            .unionByName(_file(rows, "/proc/partitions", text("major minor #blocks name\n\n8 1 ", e, " sda1\n8 16 5 sdb\n")))
            .unionByName(_file(rows, "/proc/diskstats", text(
                "8 1 sda1 1 2 3 ", e * 2, " 4 5 6 ", F.col("k"), " 0 ", e, " 9 0 0 0 0\n8 2 sda2 1 2 3 4 5 6 7 8 9 10 11 0 0 0 0\n"))))


def disk_busy(spark, folder):
    return snapshots.disk_busy(snapshots.disks(_disk_files(spark, folder))).select(
        "host", "entity", "ts", "size", "fs_vfstype", "period_reading", "perc_reading", "perc_io", "perc_writting")


def disk_metrics(spark, folder):
    """Disks with their usage and swaps as one set of disk metrics."""
    busy = snapshots.disk_busy(snapshots.disks(_disk_files(spark, folder))).withColumns({
        "blocks": F.col("size"), "frag_size": F.lit(2048), "blocks_free": F.floor(F.col("size") / 2), "blocks_avail": F.floor(F.col("size") / 4)})
    raw = normalize.disk_raw(snapshots.filesystem_usage(busy)).unionByName(_swap_raw(spark, folder).withColumn("ts", F.col("ts") * 1_000_000))
    metrics = normalize.normalize(raw, normalize.mapping_table(spark)).unionByName(normalize.type_literals(raw))
    return metrics.select("host", "entity", "metric", F.expr("ts DIV 1000000").alias("ts"), F.col("v_num").alias("number"), F.col("v_str").alias("label"))


def filesystem_usage(spark, folder):
    rows = table(spark, folder, "part").select(
        "p_partkey", (F.col("p_size") * 100).alias("blocks"), F.lit(4096).alias("frag_size"),
        (F.col("p_size") * F.when(F.col("p_partkey") % 9 == 0, 100).otherwise(40)).alias("blocks_free"),
        (F.col("p_size") * F.when(F.col("p_partkey") % 9 == 0, 0).otherwise(30)).alias("blocks_avail"))
    return snapshots.filesystem_usage(rows).select("p_partkey", "total", "used", "free_user", F.round("usage_user", 6).alias("usage_user"))


def paired_lines(spark, folder):
    raw = snapshots.paired_lines(_file(_events(spark, folder), "/proc/net/snmp", text(
        "Ip: Forwarding Ttl\nIp: ", F.col("k"), " 64\nTcp: Rto Max\nTcp: 200 ", F.col("ts"), "\n")), "%/net/snmp", "snmp")
    return raw.select("ts", "attr", "value")


def snmp_metrics(spark, folder):
    raw = snapshots.paired_lines(_file(_events(spark, folder), "/proc/net/snmp", text(
        "Ip: click view\nIp: ", F.col("k"), " 64\n")), "%/net/snmp", "snmp")
    catalog = table(spark, folder, "events").select(F.concat(F.lit("snmp_Ip"), "event_type").alias("name")).filter(
        "name <> 'snmp_Ipview'").distinct()
    return normalize.snmp_metrics(raw, catalog).select("host", "metric", "ts", F.col("v_num").alias("value"))


def hex_cache(spark, folder):
    raw = snapshots.hex_cache(_file(_events(spark, folder), "/proc/net/stat/arp_cache", text(
        "entries allocs\n", F.lower(F.hex("ts")), " 0a\n00ff ", F.lower(F.hex("k")), "\n")), "%arp_cache", "arp-cache")
    return raw.select("ts", "entity", "attr", "value")


def arp_gateway(spark, folder):
    """Interfaces whose gateway is in the ARP table of their host and tick."""
    rows = _events(spark, folder)
    arp = snapshots.arp(_file(rows, "/proc/net/arp", text(
        "IP address HW type Flags HW address Mask Device\n10.0.0.", F.col("k") % 5, " 0x1 0x2 aa:bb * eth0\n")))
    gateways = rows.select("host", "ts", F.lit("eth0").alias("entity"), F.lit("10.0.0.1").alias("gateway"))
    return normalize.gateway_in_arp(gateways, arp).select("host", "ts", F.col("v_num").alias("gw_in_arp"))


def route_table(spark, folder):
    out = snapshots.routes(_file(_events(spark, folder), "/proc/net/route", text(
        "Iface Destination Gateway Flags RefCnt Use Metric Mask MTU Window IRTT\neth0 0000A8C0 0100A8",
        F.lpad(F.hex("k"), 2, "0"), " 0003 0 0 100 00FFFFFF 0 0 0\n")))
    return out.select("ts", "if_name", "dst", "gateway", "mask", "metric")


def interface_counters(spark, folder):
    raw = snapshots.net_dev(_file(_events(spark, folder), "/proc/net/dev", text(
        "Inter-|   Receive\n face |bytes\n  eth0: ", F.col("ts"), " ", F.col("k"), " 3 4 5 6 7 8 9 10 11 12 13 14 15 16\n")))
    out = normalize.normalize(raw, normalize.mapping_table(spark))
    return out.select("entity", "metric", "ts", F.col("v_num").alias("value"))


def interface_columns(spark, folder):
    """All sixteen counters of an interface, as raw rows."""
    rows = snapshots.net_dev(_file(_events(spark, folder), "/proc/net/dev", text(
        "Inter-|   Receive\n face |bytes\n  eth0: ", F.col("ts"), " ", F.col("k"), " 3 4 5 6 7 8 9 10 11 12 13 14 15 16\n")))
    return rows.select("entity", "attr", "ts", "value")


def interface_attributes(spark, folder):
    rows = _events(spark, folder)
    status = snapshots.dns_servers(_file(rows, "/resolvectl", text(
        "Global\n Protocols: x\nCurrent DNS Server: 9.9.9.9\nLink 2 (eth0)\nCurrent DNS Server: 1.1.1.", F.col("k"), "\nLink 3 (eth1)\n")))
    plain = snapshots.resolver(_file(rows, "/etc/resolv.conf", text("# x\nnameserver 8.8.8.8\nnameserver 8.8.4.4\n")))
    leases = snapshots.dhcp_servers(_file(rows, "/var/lib/dhcp/a.leases", text(
        'lease {\n interface "eth1";\n option dhcp-server-identifier 10.0.0.1;\n}\nlease {\n interface "eth1";\n option dhcp-server-identifier 10.0.0.', F.col("k"), ";\n}\n")))
    interfaces = rows.select("host", "ts", F.explode(F.array(F.lit("eth0"), F.lit("eth1"))).alias("if_name"),
                             F.when(F.col("k") % 2 == 0, "1").when(F.col("k") % 3 == 0, "772").otherwise("9999").alias("type_code"))
    return snapshots.interface_attributes(interfaces, status, plain, leases)


def route_attributes(spark, folder):
    rows = _events(spark, folder).select("ts", F.when(F.col("k") % 2 == 0, text("10.0.", F.col("k"), ".0")).alias("dst"),
                                         F.lit(24).alias("dst_len"), (F.col("k") % 6).alias("proto"), F.when(
        F.col("k") % 2 == 0, 0).otherwise(253).alias("scope"), F.lit(1).alias("type"))
    return snapshots.route_attributes(rows).select("ts", "key", "proto", "scope", "type")


def sysctl(spark, folder):
    rows = _events(spark, folder)
    files = _file(rows, "/proc/sys/net/ipv4/tcp_mem", text(F.col("k"), "\t2\t", F.col("ts"), "\n")).unionByName(
        _file(rows, "/proc/sys/net/core/rmem_max", text(F.col("k"), "\n")))
    return snapshots.sysctl(files).select("ts", "attr", "value")


def sensors(spark, folder):
    rows = _events(spark, folder).select(
        "host", "ts", F.when(F.col("k") % 3 == 0, "fans").when(F.col("k") % 3 == 1, "coretemp").otherwise("thermal").alias("kind"),
        F.lit("hwmon0_temp1").alias("sensor"), F.lit(None).cast("string").alias("label"), (F.col("k") * 1000).alias("input"),
        F.when(F.col("k") % 2 == 0, 90_000).alias("max"), F.lit(None).cast("int").alias("crit"))
    return snapshots.sensors(rows).drop("host", "entity")


def sensor_metrics(spark, folder):
    """Zones, fans and core sensors as one set of sensor metrics with their kind."""
    rows = _events(spark, folder).select(
        "host", "ts", F.when(F.col("k") % 3 == 0, "fans").when(F.col("k") % 3 == 1, "coretemp").otherwise("thermal").alias("kind"),
        text("hwmon", F.col("k") % 4, "_temp1").alias("sensor"), F.lit(None).cast("string").alias("label"), (F.col("k") * 1000).alias("input"),
        F.when(F.col("k") % 2 == 0, 90_000).alias("max"), F.lit(None).cast("int").alias("crit"))
    raw = normalize.sensor_raw(snapshots.sensors(rows))
    metrics = normalize.normalize(raw, normalize.mapping_table(spark)).unionByName(normalize.type_literals(raw))
    return metrics.select("host", "entity", "metric", "ts", F.col("v_num").alias("number"), F.col("v_str").alias("label"))


def vm_metrics(spark, folder):
    """Hypervisor attributes of a machine per host with two cpus and two interfaces."""
    rows, e = _events(spark, folder), F.col("event_type")
    attr = (F.when(e == "click", "Guest/CPU/Load/User").when(e == "view", "Guest/RAM/Usage/Free").when(e == "error", "Net/Rate/Rx")
            .when(e == "signup", text("Net/", F.col("k") % 3, "/Status")).otherwise("accessible"))
    value = F.when(e == "signup", F.when(F.col("k") % 2 == 0, "UP").otherwise("Down")).otherwise(F.col("k").cast("string"))
    raw = rows.select("host", "ts", F.lit("vm1").alias("entity"), attr.alias("attr"), value.alias("value"))

    def child(path, name, prefix=None):
        return F.struct(F.lit(path).alias("path"), F.lit(name).alias("child"), F.lit(prefix).cast("string").alias("prefix"))
    cpus = [child("/node/vm/cpus/cpu", f"cpu{i}") for i in range(2)]
    interfaces = [child("/node/vm/net/if", f"eth{i}", f"Net/{i}") for i in range(2)]
    children = rows.select("host").distinct().select("host", F.lit("vm1").alias("entity"), F.explode(F.array(*cpus, *interfaces)).alias("c")).select(
        "host", "entity", "c.path", "c.child", "c.prefix")
    out = normalize.vm_metrics(raw, children, normalize.mapping_table(spark))
    return out.select("host", "path", "entity", "metric", "ts", F.col("v_num").alias("number"), F.col("v_str").alias("label"))


def forwarder_interface(spark, folder):
    """Interface metrics of a local and a remote forwarder per host, with the rate of the forwarder itself."""
    rows, e = _events(spark, folder), F.col("event_type")
    local = F.col("k") % 2 == 0
    interface = F.when(e != "view", text("Gig", F.col("k") % 3))
    attr = (F.when(e == "view", "/sys/vector_rate").when(e == "click", F.when(local, "/if/rx-packets").otherwise("/if/rx/T0/packets"))
            .when(e == "error", F.when(local, "/if/tx-bytes").otherwise("/if/tx/T0/bytes"))
            .when(e == "signup", F.when(local, "/if/rx-miss").otherwise("/if/rx-no-buf/T0")).otherwise("/if/unknown"))
    raw = rows.select("host", F.expr("ts DIV 20").alias("ts"), F.when(local, "localhost").otherwise("kb1").alias("entity"), interface.alias("interface"),
                      attr.alias("attr"), F.col("k").cast("string").alias("value"))
    out = normalize.forwarder_interfaces(raw, normalize.mapping_table(spark))
    return out.groupBy("host", "entity", "metric").agg(F.round(F.sum("v_num"), 9).alias("value"), F.count(F.lit(1)).alias("n"))


def _typed_catalog(spark, folder):
    """A catalogue of the event types, some with another type in a later subservice."""
    kinds = table(spark, folder, "events").select("event_type").distinct()
    place = F.struct("event_type", "copy")
    return kinds.select("event_type", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).select(
        F.when(F.col("copy") == 0, "bm").otherwise("other").alias("subservice"), F.col("event_type").alias("name"),
        F.when(F.col("event_type") == "view", "str").when((F.col("event_type") == "click") & (F.col("copy") == 1), "int").otherwise("float").alias("type"),
        place.alias("place"))


def typed_metrics(spark, folder):
    """Raw values cast by the catalogue's type of their metric: the type of the last subservice that names it counts."""
    events = _events(spark, folder).filter("event_type <> 'signup'")
    raw = events.select("host", "ts", F.lit("x").alias("category"), F.lit("").alias("entity"), F.col("event_type").alias("attr"), F.col("value").cast("string").alias("value"))
    mapping = events.select(F.lit("x").alias("category"), F.col("event_type").alias("attr"), F.lit("/node/bm").alias("path"), F.col("event_type").alias("metric"),
                            F.lit(2.0).alias("divisor")).distinct()
    out = normalize.normalize(raw, mapping, normalize.metric_types(_typed_catalog(spark, folder)))
    return out.select("ts", "metric", "v_num", F.col("v_str").isNotNull().alias("text"))


def metric_defaults(spark, folder):
    """Every metric of every user: its newest value, or 0 or the empty text where it has none."""
    samples = _events(spark, folder).filter("k % 4 = 0").select(
        "host", F.lit("/node/bm").alias("path"), F.lit("").alias("entity"), F.col("event_type").alias("metric"), "ts", F.col("ts").alias("seq"),
        F.when(F.col("event_type") != "view", F.col("k").cast("double")).alias("v_num"), F.when(F.col("event_type") == "view", text("k", F.col("k"))).alias("v_str"))
    nodes = _events(spark, folder).select("host", F.lit("/node/bm").alias("path"), F.lit("").alias("entity")).distinct()
    out = normalize.with_defaults(nodes, _typed_catalog(spark, folder), series.newest(samples))
    return out.select("host", "metric", "value")


def present_entities(spark, folder):
    """Event types of a user that are still there at the user's newest day."""
    rows = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("host"), F.lit("x").alias("category"), F.col("event_type").alias("entity"),
        F.unix_date(F.to_date("ts")).alias("ts"), "event_id")
    return snapshots.present_entities(rows).select("host", "entity", "event_id")


def guest_metrics(spark, folder):
    rows = _events(spark, folder).select(
        "host", "ts", (F.col("k") > 20).alias("online"), F.when(F.col("event_type") == "view", "state").otherwise("Net/Rate/Rx").alias("attr"),
        F.when(F.col("event_type") == "view", F.lit("Running")).otherwise(F.col("k").cast("string")).alias("value"),
        F.when(F.col("event_type") != "view", F.lit(4)).alias("scale"))
    return snapshots.guest_metrics(rows).select("ts", "attr", "value")


def worker_sums(spark, folder):
    cells = F.when(F.col("k") % 2 == 0, F.array(
        F.struct(F.col("k").alias("packets"), F.col("ts").alias("bytes")),
        F.struct(F.lit(1).cast("bigint").alias("packets"), F.lit(2).cast("bigint").alias("bytes"))))
    rows = _events(spark, folder).select("host", "ts", F.lit("eth0").alias("entity"), F.lit("/if/rx").alias("attr"),
                                         F.array("k", "ts").alias("counters"), cells.alias("cells"))
    return snapshots.worker_sums(rows).select("ts", "attr", "value")


def error_counters(spark, folder):
    rows = _events(spark, folder).select("host", "ts", text("/err/ip", F.col("k") % 7, "-input/bad ", F.col("event_type")).alias("path"),
                                         F.array("k", "ts").alias("counters"))
    return snapshots.error_counters(rows).select("ts", "node", "error", "value")


def forwarder_errors(spark, folder):
    """Interface error metrics and the allocation error sum of a forwarder."""
    e = F.col("event_type")
    attr = (F.when(e == "click", "/err/ip4-input/out of buffers (drop)/Gig0/8")
            .when(e == "view", "/err/Gig0/8-output/interface is down/Gig0/8")
            .when(e == "error", "/err/dpdk-input/rx buf alloc failed no physmem/")
            .when(e == "signup", "/err/other/unknown/Gig0/8").otherwise("/err/dpdk-input/rx packets dropped due to alloc error/"))
    raw = _events(spark, folder).select("host", F.expr("ts DIV 50").alias("ts"), F.lit("remote1").alias("entity"), attr.alias("attr"),
                                        F.col("k").cast("string").alias("value"))
    both = normalize.kb_errors(spark, raw).unionByName(normalize.allocation_errors(raw))
    return both.groupBy("host", "entity", "metric").agg(F.sum("v_num").alias("value"), F.count(F.lit(1)).alias("n"))


def forwarder_memory(spark, folder):
    e = F.col("event_type")
    attr = (F.when(e == "click", "/mem/statseg/total").when(e == "view", "/mem/statseg/used")
            .when(e == "error", "/buffer-pools/default-numa-0/available").when(e == "signup", "/buffer-pools/default-numa-0/used")
            .otherwise("/buffer-pools/default-numa-0/cached"))
    raw = _events(spark, folder).select("host", F.lit(0).cast("bigint").alias("ts"), F.lit("kb1").alias("entity"), attr.alias("attr"),
                                        F.col("k").cast("string").alias("value"))
    return normalize.kb_memory(raw).select("host", "metric", F.round("v_num", 9).alias("value"))


def forwarder_paths(spark, folder):
    e = F.col("event_type")
    path = (F.when(e == "click", "/if/rx/Gig0/T0/packets").when(e == "view", "/nat44/total-users")
            .otherwise("/sys/vector_rate"))
    return snapshots.forwarder_paths(_events(spark, folder).withColumn("path", path)).select("ts", "entity", "attr")


def trace_namespaces(spark, folder):
    elements = F.array(
        F.struct(F.lit("ns").alias("name"), F.create_map(F.lit("id"), F.col("k").cast("string")).alias("key")),
        F.struct(F.lit("node").alias("name"), F.when(F.col("k") % 2 == 0, F.create_map(
            F.lit("id"), F.col("host"))).alias("key")),
        F.struct(F.lit("HopLimit").alias("name"), F.lit(None).cast("map<string,string>").alias("key")))
    rows = snapshots.trace_namespaces(_events(spark, folder).select("host", "ts", elements.alias("elem"), F.col("k").cast("string").alias("value")))
    out = normalize.normalize(rows.withColumn("category", F.lit("ioam/gnmi")), normalize.mapping_table(spark))
    return out.select("ts", "entity", "metric", F.col("v_num").alias("value"))


def interface_flags(spark, folder):
    rows = _events(spark, folder).select("ts", (F.col("ts") * 7 % 65536).cast("int").alias("flags"))
    return snapshots.interface_flags(rows).select("ts", *snapshots.FLAG_BITS)


def activity_states(spark, folder):
    e = F.col("event_type")
    rows = _events(spark, folder).select(
        "host", F.when(e == "click", "vm").when(e == "view", "kb").otherwise("ioam").alias("type"),
        F.when(F.col("k") % 5 == 0, "localhost").otherwise(text("n", F.col("k"))).alias("name"),
        F.when(F.col("k") % 3 == 0, "Running").when(F.col("k") % 3 == 1, "synced").alias("status")).distinct()
    return normalize.activity_states(rows).groupBy("active", F.regexp_extract("fullname", r"/(\w+)\[name=[^\]]*\]$", 1).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    meminfo, memory_metrics, process_counts, process_fields, cpu_percent, cpu_percent_cut, cpu_metrics, load_and_uptime, swap_metrics, disk_busy, disk_metrics,
    filesystem_usage, paired_lines, snmp_metrics, hex_cache, arp_gateway, route_table, interface_counters,
    interface_attributes, route_attributes, sysctl, sensors, sensor_metrics, present_entities, guest_metrics, vm_metrics, forwarder_interface, typed_metrics, metric_defaults, interface_columns, worker_sums,
    error_counters, forwarder_errors, forwarder_memory, forwarder_paths, trace_namespaces, interface_flags,
    activity_states)}

E = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS host, event_id AS ts, event_type, value,
                 CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""


def _pairs(*items: str) -> str:
    """Rows of (attr, value) per event."""
    return " UNION ALL ".join(f"SELECT ts, {i} FROM e" for i in items)


def _perc(part: str) -> str:
    return f"CAST(coalesce(round_even(({part}) * 1.0 / nullif(total, 0) * 100.0, 0), 0) AS BIGINT)"


ORACLE = {
    "meminfo": f"""{E} SELECT ts, 'MemTotal' AS attr, CAST(ts + 1000 AS VARCHAR) AS value FROM e
        UNION ALL SELECT ts, 'MemFree', CAST(k AS VARCHAR) FROM e UNION ALL SELECT ts, 'HugePages_Free', CAST(k % 3 AS VARCHAR) FROM e""",
    "memory_metrics": f"""{E} SELECT host, '/node/bm/mem' AS path, 'total' AS metric, ts, (ts + 1000) / 1000 AS value FROM e
        UNION ALL SELECT host, '/node/bm/mem', 'free', ts, k / 1000 FROM e
        UNION ALL SELECT host, '/node/bm/mem', 'pages_free', ts, CAST(k % 3 AS DOUBLE) FROM e""",
    "process_counts": f"""{E}, c AS (SELECT host, ts // 100 AS t, count(*) AS total_count,
            count(*) FILTER (event_type = 'click') AS run_count, count(*) FILTER (event_type = 'purchase') AS sleep_count,
            count(*) FILTER (event_type = 'view') AS idle_count, count(*) FILTER (event_type = 'signup') AS wait_count,
            count(*) FILTER (event_type = 'error') AS zombie_count, 0::BIGINT AS dead_count FROM e GROUP BY 1, 2)
        SELECT host, t AS ts, metric, CAST(n AS DOUBLE) AS value FROM
            (UNPIVOT c ON total_count, run_count, sleep_count, idle_count, wait_count, zombie_count, dead_count INTO NAME metric VALUE n)""",
    "process_fields": f"""{E}, f AS (
        SELECT 'comm' AS attr, event_type || ' x' AS value FROM e
        UNION ALL SELECT 'state', CASE event_type WHEN 'click' THEN 'R' WHEN 'error' THEN 'Z' WHEN 'purchase' THEN 'S' WHEN 'signup' THEN 'D' ELSE 'I' END FROM e
        UNION ALL SELECT 'ppid', '1' FROM e UNION ALL SELECT 'pgrp', CAST(k AS VARCHAR) FROM e UNION ALL SELECT 'sid', '3' FROM e)
        SELECT attr, value, count(*) AS n FROM f GROUP BY 1, 2""",
    "cpu_percent": f"""{E}, c AS (SELECT host, ts, ts * 2 AS u, ts AS s, ts * 6 + k AS i, ts AS g FROM e),
        d AS (SELECT host, ts, u - lag(u, 1, u) OVER w AS u, s - lag(s, 1, s) OVER w AS s, i - lag(i, 1, i) OVER w AS i,
                     g - lag(g, 1, g) OVER w AS g FROM c WINDOW w AS (PARTITION BY host ORDER BY ts)),
        t AS (SELECT *, u + s + i + g AS total FROM d)
        SELECT host, ts, {_perc('u')} AS user_perc, {_perc('s')} AS system_all_perc, {_perc('i')} AS idle_all_perc,
               {_perc('g')} AS guest_all_perc, total AS total_period FROM t""",
    "load_and_uptime": f"""{E} SELECT ts, 'loadavg' AS category, '1min' AS attr, CAST(value AS VARCHAR) AS value FROM e
        UNION ALL SELECT ts, 'loadavg', '5min', '0.5' FROM e UNION ALL SELECT ts, 'loadavg', '15min', '1.25' FROM e
        UNION ALL SELECT ts, 'loadavg', 'runnable', CAST(k AS VARCHAR) FROM e UNION ALL SELECT ts, 'loadavg', 'total', CAST(ts AS VARCHAR) FROM e
        UNION ALL SELECT ts, 'uptime', 'up', ts || '.5' FROM e UNION ALL SELECT ts, 'uptime', 'idle', CAST(value AS VARCHAR) FROM e""",
    "swap_metrics": f"""{E} SELECT host, '/dev/sda' || (k % 4) AS entity, 'total_user' AS metric, ts, ts / 1000 AS number, NULL AS label FROM e
        UNION ALL SELECT host, '/dev/sda' || (k % 4), 'swap_used', ts, CAST(k AS DOUBLE), NULL FROM e
        UNION ALL SELECT host, '/dev/sda' || (k % 4), 'type', ts, NULL, 'swap' FROM e""",
    "disk_busy": f"""{E}, d AS (SELECT host, ts, k, ts - lag(ts) OVER w AS wall, k - lag(k) OVER w AS dk FROM e
                          WINDOW w AS (PARTITION BY host ORDER BY ts))
        SELECT host, 'sda1' AS entity, ts * 1000000 AS ts, ts AS size, 'ext4' AS fs_vfstype, coalesce(wall * 2, 0) AS period_reading,
               CASE WHEN wall IS NULL THEN 0 ELSE 200 END AS perc_reading, CASE WHEN wall IS NULL THEN 0 ELSE 100 END AS perc_io,
               CAST(coalesce(round_even(dk * 1.0 / wall * 100.0, 0), 0) AS BIGINT) AS perc_writting FROM d""",
    "filesystem_usage": """
        WITH p AS (SELECT p_partkey, p_size * 100 * 4096 / 1024 AS total,
                          p_size * CASE WHEN p_partkey % 9 = 0 THEN 100 ELSE 40 END * 4096 / 1024 AS root,
                          p_size * CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE 30 END * 4096 / 1024 AS free_user FROM part)
        SELECT p_partkey, total, total - root AS used, free_user, coalesce(round(
               CASE WHEN total - root + free_user <> 0 THEN (total - root) / (total - root + free_user) * 100 END, 6), 0) AS usage_user FROM p""",
    "paired_lines": f"""{E} SELECT ts, 'IpForwarding' AS attr, CAST(k AS VARCHAR) AS value FROM e UNION ALL SELECT ts, 'IpTtl', '64' FROM e
        UNION ALL SELECT ts, 'TcpRto', '200' FROM e UNION ALL SELECT ts, 'TcpMax', CAST(ts AS VARCHAR) FROM e""",
    "snmp_metrics": f"{E} SELECT host, 'snmp_Ipclick' AS metric, ts, CAST(k AS DOUBLE) AS value FROM e",
    "hex_cache": f"""{E} SELECT ts, 'cpu0' AS entity, 'entries' AS attr, CAST(ts AS VARCHAR) AS value FROM e
        UNION ALL SELECT ts, 'cpu0', 'allocs', '10' FROM e UNION ALL SELECT ts, 'cpu1', 'entries', '255' FROM e
        UNION ALL SELECT ts, 'cpu1', 'allocs', CAST(k AS VARCHAR) FROM e""",
    "arp_gateway": f"{E} SELECT host, ts, CASE WHEN k % 5 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS gw_in_arp FROM e",
    "route_table": f"{E} SELECT ts, 'eth0' AS if_name, '192.168.0.0' AS dst, k || '.168.0.1' AS gateway, '255.255.255.0' AS mask, '100' AS metric FROM e",
    "interface_counters": f"""{E} SELECT 'eth0' AS entity, 'rx_bytes' AS metric, ts, CAST(ts AS DOUBLE) AS value FROM e
        UNION ALL SELECT 'eth0', 'rx_packets', ts, CAST(k AS DOUBLE) FROM e UNION ALL SELECT 'eth0', 'rx_error', ts, 3.0 FROM e
        UNION ALL SELECT 'eth0', 'rx_drop', ts, 4.0 FROM e UNION ALL SELECT 'eth0', 'tx_bytes', ts, 9.0 FROM e
        UNION ALL SELECT 'eth0', 'tx_packets', ts, 10.0 FROM e UNION ALL SELECT 'eth0', 'tx_error', ts, 11.0 FROM e
        UNION ALL SELECT 'eth0', 'tx_drop', ts, 12.0 FROM e""",
    "interface_columns": f"""{E}, n AS (SELECT unnest(range(1, 17)) AS i, unnest({list(snapshots.NET_FIELDS)}) AS attr)
        SELECT 'eth0' AS entity, attr, ts, CASE i WHEN 1 THEN ts WHEN 2 THEN k ELSE i END::VARCHAR AS value FROM e, n""",
    "cpu_metrics": f"""{E}, w AS (SELECT *, ts AS t, lag(ts) OVER (PARTITION BY host ORDER BY ts) AS b, lag(k) OVER (PARTITION BY host ORDER BY ts) AS pk FROM e),
        p AS (SELECT host, t, t - coalesce(b, t) AS d, k - coalesce(pk, k) AS dk FROM w),
        c AS (SELECT host, t, 'cpu' AS entity, 2 * d AS user_, d AS sys, 6 * d + dk AS idle, d AS guest, 10 * d + dk AS total FROM p
              UNION ALL SELECT host, t, 'cpu0', 0, 0, 0, 0, 0 FROM p),
        m AS (SELECT host, t, entity, unnest(['idle_time', 'system_time', 'user_time', 'guest_time']) AS metric, unnest([idle, sys, user_, guest]) AS v, total FROM c)
        SELECT host, '/node/bm/cpus/cpu' AS path, entity, metric, t AS ts, CASE WHEN total = 0 THEN 0 ELSE round_even(v / total * 100, 0) END::DOUBLE AS value FROM m""",
    "sensor_metrics": f"""{E}, s AS (SELECT host, ts, k, 'hwmon' || (k % 4) || '_temp1' AS entity, k % 3 AS kind FROM e)
        SELECT host, entity, CASE kind WHEN 0 THEN 'input_fanspeed' ELSE 'input_temp' END AS metric, ts, CASE kind WHEN 0 THEN k * 1000 ELSE k END::DOUBLE AS number, NULL AS label FROM s
        UNION ALL SELECT host, entity, 'max_temp', ts, CASE WHEN k % 2 = 0 THEN 90 ELSE 0 END, NULL FROM s WHERE kind = 1
        UNION ALL SELECT host, entity, 'critical_temp', ts, 0, NULL FROM s WHERE kind = 1
        UNION ALL SELECT host, entity, 'type', ts, NULL, CASE kind WHEN 0 THEN 'fan' WHEN 1 THEN 'cpu' ELSE 'zone' END FROM s""",
    "disk_metrics": f"""{E}, w AS (SELECT *, lag(ts) OVER o AS b, lag(k) OVER o AS pk FROM e WINDOW o AS (PARTITION BY host ORDER BY ts)),
        d AS (SELECT host, ts, coalesce(round_even((ts - b) * 2.0 / (ts - b) * 100, 0), 0) AS r, coalesce(round_even((k - pk)::DOUBLE / (ts - b) * 100, 0), 0) AS w,
                     coalesce(round_even((ts - b)::DOUBLE / (ts - b) * 100, 0), 0) AS io FROM w),
        m AS (SELECT host, ts, 'sda1' AS entity, unnest(['total_user', 'free_user', 'read_time', 'write_time', 'io_time', 'discard_time']) AS metric,
                     unnest([ts * 2.0::DOUBLE / 1000, (ts // 4) * 2.0::DOUBLE / 1000, r::DOUBLE, w::DOUBLE, io::DOUBLE, 0.0::DOUBLE]) AS number FROM d)
        SELECT host, entity, metric, ts, number, NULL AS label FROM m
        UNION ALL SELECT host, 'sda1', 'type', ts, NULL, 'ext4' FROM e
        UNION ALL SELECT host, '/dev/sda' || (k % 4), 'total_user', ts, ts / 1000.0::DOUBLE, NULL FROM e
        UNION ALL SELECT host, '/dev/sda' || (k % 4), 'swap_used', ts, k::DOUBLE, NULL FROM e
        UNION ALL SELECT host, '/dev/sda' || (k % 4), 'type', ts, NULL, 'swap' FROM e""",
    "vm_metrics": f"""{E}, i AS (SELECT unnest(range(2)) AS i)
        SELECT host, '/node/vm/cpus/cpu' AS path, 'vm1:cpu' || i AS entity, 'user_time' AS metric, ts, k::DOUBLE AS number, NULL AS label FROM e, i WHERE event_type = 'click'
        UNION ALL SELECT host, '/node/vm/mem', 'vm1', 'free', ts, k / 1000.0::DOUBLE, NULL FROM e WHERE event_type = 'view'
        UNION ALL SELECT host, '/node/vm/net/if', 'vm1:eth' || i, 'rx_bytes', ts, k / 1000.0::DOUBLE, NULL FROM e, i WHERE event_type = 'error'
        UNION ALL SELECT host, '/node/vm/net/if', 'vm1:eth' || (k % 3), 'state', ts, NULL, CASE WHEN k % 2 = 0 THEN 'up' ELSE 'down' END FROM e
                  WHERE event_type = 'signup' AND k % 3 < 2
        UNION ALL SELECT host, '/node/vm/net', 'vm1', 'ssh', ts, k::DOUBLE, NULL FROM e WHERE event_type NOT IN ('click', 'view', 'error', 'signup')""",
    "forwarder_interface": f"""{E}, r AS (SELECT host, ts // 20 AS ts, CASE WHEN k % 2 = 0 THEN 'localhost' ELSE 'kb1' END AS kb, event_type AS t, k, 'Gig' || (k % 3) AS i FROM e),
        i AS (SELECT DISTINCT host, ts, kb, i FROM r WHERE t <> 'view'),
        m AS (SELECT host, kb || ':' || i AS entity, CASE WHEN t = 'click' THEN 'rx_packets' WHEN t = 'error' THEN 'tx_bytes' WHEN kb = 'kb1' THEN 'rx_no_buffer' ELSE 'rx_drop' END AS metric,
                     CASE WHEN t = 'error' THEN k / 1e6 ELSE k END AS v FROM r WHERE t IN ('click', 'error', 'signup')
              UNION ALL SELECT r.host, r.kb || ':' || i.i, 'vector_rate', k FROM r JOIN i USING (host, ts, kb) WHERE t = 'view')
        SELECT host, entity, metric, round(sum(v), 9) AS value, count(*) AS n FROM m GROUP BY 1, 2, 3""",
    "typed_metrics": f"""{E} SELECT ts, event_type AS metric, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN trunc(value / 2) ELSE value / 2 END AS v_num,
               event_type = 'view' AS text FROM e WHERE event_type <> 'signup'""",
    "metric_defaults": f"""{E}, h AS (SELECT DISTINCT host FROM e), m AS (SELECT DISTINCT event_type AS metric FROM e),
        n AS (SELECT host, event_type AS metric, arg_max(k, ts) AS k FROM e WHERE k % 4 = 0 GROUP BY 1, 2)
        SELECT host, metric, CASE WHEN metric = 'view' THEN coalesce('k' || k, '') ELSE coalesce(k, 0)::DOUBLE::VARCHAR END AS value
        FROM h CROSS JOIN m LEFT JOIN n USING (host, metric)""",
    "interface_attributes": f"""{E} SELECT host, ts, if_name, CASE WHEN k % 2 = 0 THEN 'ether' WHEN k % 3 = 0 THEN 'loopback' ELSE 'unknown' END AS type,
               CASE if_name WHEN 'eth0' THEN '1.1.1.' || k ELSE '8.8.8.8' END AS dns_server,
               CASE if_name WHEN 'eth1' THEN '10.0.0.' || k ELSE '' END AS dhcp_server
        FROM e, (VALUES ('eth0'), ('eth1')) AS i(if_name)""",
    "route_attributes": f"""{E} SELECT ts, CASE WHEN k % 2 = 0 THEN '10.0.' || k || '.0/24' ELSE 'default' END AS key,
               CASE k % 6 WHEN 0 THEN 'unspec' WHEN 1 THEN 'redirect' WHEN 2 THEN 'kernel' WHEN 3 THEN 'boot' WHEN 4 THEN 'static' ELSE 'PROTO_5' END AS proto,
               CASE WHEN k % 2 = 0 THEN 'universe' ELSE 'link' END AS scope, 'unicast' AS type FROM e""",
    "sysctl": f"""{E} SELECT ts, 'net.ipv4.tcp_mem_min' AS attr, CAST(k * 4096 AS VARCHAR) AS value FROM e
        UNION ALL SELECT ts, 'net.ipv4.tcp_mem_pressure', '8192' FROM e UNION ALL SELECT ts, 'net.ipv4.tcp_mem_max', CAST(ts * 4096 AS VARCHAR) FROM e
        UNION ALL SELECT ts, 'net.core.rmem_max', CAST(k AS VARCHAR) FROM e""",
    "sensors": f"""{E} SELECT ts, CASE k % 3 WHEN 0 THEN 'sensors/fans' WHEN 1 THEN 'sensors/coretemp' ELSE 'sensors/thermal' END AS category,
               'temp1' AS label, CAST(CASE k % 3 WHEN 0 THEN k * 1000 ELSE k END AS DOUBLE) AS input,
               CASE WHEN k % 3 = 1 THEN CASE WHEN k % 2 = 0 THEN 90.0::DOUBLE ELSE 0.0::DOUBLE END END AS max,
               CASE WHEN k % 3 = 1 THEN 0.0::DOUBLE END AS critical FROM e""",
    "present_entities": """
        WITH d AS (SELECT *, CAST(ts AS DATE) AS day FROM events),
        l AS (SELECT user_id, max(day) AS day FROM d GROUP BY 1),
        a AS (SELECT DISTINCT user_id, event_type FROM d JOIN l USING (user_id, day))
        SELECT CAST(user_id AS VARCHAR) AS host, event_type AS entity, event_id FROM events JOIN a USING (user_id, event_type)""",
    "guest_metrics": f"""{E} SELECT ts, CASE event_type WHEN 'view' THEN 'state' ELSE 'Net/Rate/Rx' END AS attr,
               CASE event_type WHEN 'view' THEN 'Running' ELSE CAST(k / 4 AS VARCHAR) END AS value FROM e WHERE k > 20 OR event_type = 'view'""",
    "worker_sums": f"""{E} SELECT ts, '/if/rx-bytes' AS attr, ts + 2 AS value FROM e WHERE k % 2 = 0
        UNION ALL SELECT ts, '/if/rx-packets', k + 1 FROM e WHERE k % 2 = 0 UNION ALL SELECT ts, '/if/rx', k + ts FROM e WHERE k % 2 = 1""",
    "error_counters": f"{E} SELECT ts, 'ip' || (k % 7) || '-input' AS node, 'bad ' || event_type AS error, k + ts AS value FROM e WHERE k % 7 <> 6",
    "forwarder_errors": f"""{E}, m AS (
        SELECT host, 'remote1:Gig0/8' AS entity, CASE event_type WHEN 'click' THEN 'ip4_input_out_of_buffers' ELSE 'if_down' END AS metric, k AS v
        FROM e WHERE event_type IN ('click', 'view')
        UNION ALL SELECT host, 'remote1', 'dpdk_alloc_errors', coalesce(sum(k) FILTER (event_type IN ('error', 'purchase')), 0) FROM e GROUP BY host, ts // 50)
        SELECT host, entity, metric, CAST(sum(v) AS DOUBLE) AS value, count(*) AS n FROM m GROUP BY 1, 2, 3""",
    "forwarder_memory": f"""{E}, m AS (SELECT host, max(k) FILTER (event_type = 'click') AS t, max(k) FILTER (event_type = 'view') AS u,
            max(k) FILTER (event_type = 'error') AS f, max(k) FILTER (event_type = 'signup') AS b, max(k) FILTER (event_type = 'purchase') AS c FROM e GROUP BY 1),
        w AS (SELECT host, t / 1e6 AS total, t / 1e6 - u / 1e6 AS free, CAST(f + b AS DOUBLE) AS buffer_total, CAST(f AS DOUBLE) AS buffer_free,
                     CAST(c AS DOUBLE) AS buffer_cache FROM m)
        SELECT host, metric, round(value, 9) AS value FROM (UNPIVOT w ON total, free, buffer_total, buffer_free, buffer_cache INTO NAME metric VALUE value)""",
    "forwarder_paths": f"""{E} SELECT ts, CASE event_type WHEN 'click' THEN 'Gig0' ELSE '' END AS entity,
               CASE event_type WHEN 'click' THEN '/if/rx/T0/packets' ELSE '/sys/vector_rate' END AS attr FROM e WHERE event_type <> 'view'""",
    "trace_namespaces": f"""{E} SELECT ts, k || ':' || CASE WHEN k % 2 = 0 THEN host ELSE '' END AS entity, 'hop_limit' AS metric,
               CAST(k AS DOUBLE) AS value FROM e""",
    "interface_flags": f"""{E}, f AS (SELECT ts, CAST(ts * 7 % 65536 AS INTEGER) AS w FROM e)
        SELECT ts, {", ".join(f"w & {bit} <> 0 AS {name}" for name, bit in snapshots.FLAG_BITS.items())} FROM f""",
    "activity_states": f"""{E}, s AS (SELECT DISTINCT host, CASE event_type WHEN 'click' THEN 'vm' WHEN 'view' THEN 'kb' ELSE 'ioam' END AS kind,
            CASE WHEN k % 5 = 0 THEN 'localhost' ELSE 'n' || k END AS name, CASE k % 3 WHEN 0 THEN 'Running' WHEN 1 THEN 'synced' END AS st FROM e)
        SELECT CASE kind WHEN 'vm' THEN coalesce(st = 'Running', false) WHEN 'kb' THEN name = 'localhost' OR coalesce(st, '') = 'synced'
               ELSE coalesce(st = 'synced', false) END AS active, kind, count(*) AS n FROM s GROUP BY 1, 2""",
}
ORACLE["cpu_percent_cut"] = ORACLE["cpu_percent"]
