"""Landed host snapshots (``host, ts, file, content``) -> raw samples.

Raw samples are ``host, ts, category, entity, attr, value`` with text values.
Every parser explodes the lines of one file inside its row; only counts per tick,
deltas between ticks and the disk join shuffle, all keyed by host and tick.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trustloom.functions.hof import let
from trustloom.functions.scalar import hex_to_int, little_endian_ip, ratio_percent
from trustloom.functions.skew import CHUNK_ROWS, drop_halo, split_series
from trustloom.session import staged

RAW = ("host", "ts", "category", "entity", "attr", "value")

# Process state letters and their counters.
PROCESS_STATES = {
    "R": "run_count", "S": "sleep_count", "D": "wait_count", "T": "stopped_count",
    "t": "ts_count", "X": "dead_count", "Z": "zombie_count", "P": "parked_count",
    "I": "idle_count",
}

# Fields of a process stat line after the pid.
PROCESS_FIELDS = (
    "comm state ppid pgrp sid tty_nr tty_pgrp flags min_flt cmin_flt maj_flt cmaj_flt utime stime "
    "cutime cstime priority nice num_threads itrealvalue starttime vsize rss rsslim startcode "
    "endcode startstack kstk_esp kstk_eip signal blocked sigignore sigcatch wchan nswap cnswap "
    "exit_signal processor rt_priority policy delayacct_blkio_ticks gtime cgtime").split()

# Columns of the counter files.
CPU_FIELDS = ("user nice system idle iowait irq softirq steal guest guest_nice").split()
CPU_TIMES = ("user nice system idle iowait irq softirq steal guest guest_nice system_all idle_all "
             "guest_all total").split()
NET_FIELDS = ("rx_bytes rx_packets rx_errs rx_drop rx_fifo rx_frame rx_compressed rx_multicast "
              "tx_bytes tx_packets tx_errs tx_drop tx_fifo tx_cols tx_carrier tx_compressed").split()
ARP_FIELDS = ("type flags link_addr mask dev").split()
ROUTE_FIELDS = ("if_name dst gateway flags ref_cnt use metric mask mtu win irtt").split()
SWAP_FIELDS = ("type size used priority").split()
MOUNT_FIELDS = ("fs_spec fs_file fs_vfstype fs_mntops").split()
DISK_FIELDS = (
    "device_major device_minor device_name reads_completed reads_merged sectors_read time_reading "
    "writes_completed writes_merged sectors_written time_writting current_io time_io "
    "time_io_weighted discards_completed discards_merged sectors_discarded time_discarding").split()

# Sysctl files with three parts and their suffixes.
SYSCTL_TRIPLES = {
    "net.ipv4.tcp_mem": ("_min", "_pressure", "_max"),
    "net.ipv4.tcp_rmem": ("_min", "_default", "_max"),
    "net.ipv4.tcp_wmem": ("_min", "_default", "_max"),
}
PAGE_BYTES = 4096

# Interface flag bits.
FLAG_BITS = {
    "broadcast": 0x2, "debug": 0x4, "point_to_point": 0x10, "notrailers": 0x20, "running": 0x40,
    "noarp": 0x80, "promisc": 0x100, "allmulticast": 0x200, "lb_master": 0x400, "lb_slave": 0x800,
    "multicast_support": 0x1000, "portselect": 0x2000, "automedia": 0x4000, "dynamic": 0x8000,
}

# Link type codes.
LINK_TYPES = {
    "0": "netrom", "1": "ether", "2": "eether", "3": "ax25", "4": "pronet", "5": "chaos",
    "6": "ieee802", "7": "arcnet", "8": "appletlk", "15": "dlci", "19": "atm", "23": "metricom",
    "24": "ieee1394", "27": "eui64", "32": "infiniband", "256": "slip", "257": "cslip",
    "258": "slip6", "259": "cslip6", "260": "rsrvd", "264": "adapt", "270": "rose", "271": "x25",
    "272": "hwx25", "280": "can", "512": "ppp", "513": "hdlc", "516": "lapb", "517": "ddcmp",
    "518": "rawhdlc", "768": "tunnel", "769": "tunnel6", "770": "frad", "771": "skip",
    "772": "loopback", "773": "localtlk", "774": "fddi", "775": "bif", "776": "sit",
    "777": "ipddp", "778": "ipgre", "779": "pimreg", "780": "hippi", "781": "ash",
    "782": "econet", "783": "irda", "784": "fcpp", "785": "fcal", "786": "fcpl",
    "787": "fcfabric", "800": "ieee802_tr", "801": "ieee80211", "802": "ieee802_prism",
    "803": "ieee80211_radiotap", "804": "ieee802154", "820": "phonet", "821": "phonet_pipe",
    "822": "caif",
}

# Route codes of the kernel's routing interface.
ROUTE_PROTO = {"0": "unspec", "1": "redirect", "2": "kernel", "3": "boot", "4": "static",
               "8": "gated", "9": "ra", "10": "mrt", "11": "zebra", "12": "bird", "13": "dnrouted",
               "14": "xorp", "15": "ntk", "16": "dhcp"}
ROUTE_SCOPE = {"0": "universe", "200": "site", "253": "link", "254": "host", "255": "nowhere"}
ROUTE_TYPE = {"0": "unspec", "1": "unicast", "2": "local", "3": "broadcast", "4": "anycast",
              "5": "multicast", "6": "blackhole", "7": "unreachable", "8": "prohibit", "9": "throw",
              "10": "nat", "11": "xresolve"}


def file_lines(snapshots: DataFrame, file: str, skip: int = 0) -> DataFrame:
    """``host, ts, file, no, line`` of the non-empty lines of matching files (LIKE pattern)."""
    return (snapshots.filter(F.col("file").like(file))
            .select("host", "ts", "file", F.posexplode(F.split("content", "\n")).alias("no", "line"))
            .filter((F.col("no") >= skip) & (F.trim("line") != "")))


def fields(line: str = "line") -> Column:
    return F.split(F.trim(F.col(line)), r"\s+")


def raw(df: DataFrame, category: str, entity: Column, attr: Column, value: Column) -> DataFrame:
    return df.select("host", "ts", F.lit(category).alias("category"), entity.alias("entity"),
                     attr.alias("attr"), value.cast("string").alias("value"))


def named_fields(df: DataFrame, category: str, entity: Column, names: Sequence[str],
                 values: Column) -> DataFrame:
    """One raw row per name and the value at its position; missing positions give none."""
    array = F.array(*[F.lit(n) for n in names])
    pairs = F.arrays_zip(F.slice(array, F.lit(1), F.least(F.size(array), F.size(values))).alias("n"),
                         F.slice(values, F.lit(1), F.least(F.size(array), F.size(values))).alias("v"))
    out = df.select("host", "ts", entity.alias("entity"), F.explode(pairs).alias("p"))
    return out.select("host", "ts", F.lit(category).alias("category"), "entity",
                      F.col("p.n").alias("attr"), F.col("p.v").alias("value"))


def meminfo(snapshots: DataFrame) -> DataFrame:
    pattern = r"^\s*([^:]+):\s+(\S+)"
    lines = file_lines(snapshots, "%meminfo")
    return raw(lines, "meminfo", F.lit(""), F.regexp_extract("line", pattern, 1),
               F.regexp_extract("line", pattern, 2)).filter("attr <> ''")


def processes(snapshots: DataFrame) -> DataFrame:
    """``host, ts, pid, comm, state, values`` of every process stat line."""
    pattern = r"^(\d+) .*\(([^()]*)\)\s*(.*)$"
    lines = file_lines(snapshots, "%/proc/%/stat").filter(F.col("line").rlike(pattern))
    rest = F.split(F.trim(F.regexp_extract("line", pattern, 3)), r"\s+")
    return lines.select("host", "ts", F.regexp_extract("line", pattern, 1).alias("pid"),
                        F.regexp_extract("line", pattern, 2).alias("comm"),
                        rest[0].alias("state"), rest.alias("values"))


def process_fields(snapshots: DataFrame) -> DataFrame:
    rows = processes(snapshots)
    return named_fields(rows, "stats", F.col("pid"), PROCESS_FIELDS,
                        F.concat(F.array("comm"), "values"))


def process_counts(snapshots: DataFrame) -> DataFrame:
    """Processes per state and in total of each host and tick."""
    counts = [F.count_if(F.col("state") == letter).alias(name)
              for letter, name in PROCESS_STATES.items()]
    wide = processes(snapshots).groupBy("host", "ts").agg(
        F.count(F.lit(1)).alias("proc_count"), *counts)
    names = ["proc_count", *PROCESS_STATES.values()]
    long = wide.unpivot(["host", "ts"], names, "attr", "n")
    return raw(long, "stats_global", F.lit(""), F.col("attr"), F.col("n"))


def cpu_times(snapshots: DataFrame, ms_per_tick: int = 100) -> DataFrame:
    """One row per cpu and tick with the derived times in milliseconds."""
    lines = file_lines(snapshots, "%/proc/stat").filter(F.col("line").rlike(r"^cpu\d*\s"))
    v = {name: fields()[i + 1].cast("bigint") for i, name in enumerate(CPU_FIELDS)}
    user, nice = v["user"] - v["guest"], v["nice"] - v["guest_nice"]
    idle_all, system_all = v["idle"] + v["iowait"], v["system"] + v["irq"] + v["softirq"]
    guest_all = v["guest"] + v["guest_nice"]
    derived = {**v, "user": user, "nice": nice, "system_all": system_all, "idle_all": idle_all,
               "guest_all": guest_all,
               "total": user + nice + system_all + idle_all + v["steal"] + guest_all}
    return lines.select("host", "ts", fields()[0].alias("entity"),
                        *[(derived[name] * ms_per_tick).alias(f"{name}_time") for name in CPU_TIMES])


def cpu_periods(times: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add period and percent of every time against the tick before; the first tick has 0."""
    cut = split_series(times, ["host", "entity"], ["ts"], 2, chunk_rows)
    w = Window.partitionBy("host", "entity", "_chunk").orderBy("ts")
    periods = {f"{n}_period": F.col(f"{n}_time") - F.coalesce(
        F.lag(f"{n}_time").over(w), F.col(f"{n}_time")) for n in CPU_TIMES}
    out = drop_halo(cut.withColumns(periods))
    return out.withColumns({f"{n}_perc": ratio_percent(
        F.col(f"{n}_period"), F.col("total_period")) for n in CPU_TIMES if n != "total"})


def cpu_raw(periods: DataFrame) -> DataFrame:
    names = [c for c in periods.columns if c not in ("host", "ts", "entity")]
    long = periods.unpivot(["host", "ts", "entity"], names, "attr", "n")
    return raw(long, "stat/cpu", F.col("entity"), F.col("attr"), F.col("n"))


def stat_counters(snapshots: DataFrame) -> DataFrame:
    """First value of the non-cpu lines of the stat file."""
    lines = file_lines(snapshots, "%/proc/stat").filter(
        ~F.col("line").startswith("cpu") & ~F.col("file").rlike(r"/proc/\d+/stat$"))
    return raw(lines, "stat", F.lit(""), fields()[0], fields()[1])


def loadavg(snapshots: DataFrame) -> DataFrame:
    lines = file_lines(snapshots, "%loadavg").filter("no = 0")
    values = F.concat(F.slice(fields(), 1, 3), F.split(fields()[3], "/"))
    return named_fields(lines, "loadavg", F.lit(""), ["1min", "5min", "15min", "runnable", "total"],
                        values)


def swaps(snapshots: DataFrame) -> DataFrame:
    lines = file_lines(snapshots, "%swaps", skip=1)
    return named_fields(lines, "swaps", fields()[0], SWAP_FIELDS, F.slice(fields(), 2, 4))


def uptime(snapshots: DataFrame) -> DataFrame:
    return named_fields(file_lines(snapshots, "%uptime").filter("no = 0"), "uptime", F.lit(""),
                        ["up", "idle"], fields())


def disks(snapshots: DataFrame) -> DataFrame:
    """Mounted devices with their partition size and counters, joined per host and tick."""
    mount_values = F.slice(fields(), 1, 4)
    mounts = file_lines(snapshots, "%mounts").select(
        "host", "ts", F.element_at(F.split(fields()[0], "/"), -1).alias("entity"),
        *[F.get(mount_values, F.lit(i)).alias(n) for i, n in enumerate(MOUNT_FIELDS)])
    mounts = mounts.filter(F.col("entity").rlike(r"\d$")).groupBy("host", "ts", "entity").agg(
        *[F.max(n).alias(n) for n in MOUNT_FIELDS])
    partitions = file_lines(snapshots, "%partitions", skip=2).select(
        "host", "ts", fields()[3].alias("entity"), fields()[2].cast("bigint").alias("size"))
    counters = file_lines(snapshots, "%diskstats").select("host", "ts", fields().alias("f")).select(
        "host", "ts", F.col("f")[2].alias("entity"),
        *[F.get(F.col("f"), F.lit(i)).cast("bigint").alias(n)
          for i, n in enumerate(DISK_FIELDS) if n != "device_name"])
    keys = ["host", "ts", "entity"]
    return mounts.join(partitions, keys).join(counters, keys)


def disk_busy(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Percent of the wall time each disk spent reading, writing, in io and discarding."""
    rows = staged(rows, "disks")  # sizes of the series are counted first; the joins behind the rows run once
    cut = split_series(rows, ["host", "entity"], ["ts"], 2, chunk_rows)
    w = Window.partitionBy("host", "entity", "_chunk").orderBy("ts")
    wall_ms = (F.col("ts") - F.lag("ts").over(w)) / 1_000_000
    kinds = ("writting", "reading", "io", "discarding")
    out = cut.withColumn("_wall", wall_ms).withColumns({
        f"period_{k}": F.coalesce(F.col(f"time_{k}") - F.lag(f"time_{k}").over(w), F.lit(0))
        for k in kinds})
    return drop_halo(out).withColumns({
        f"perc_{k}": ratio_percent(F.col(f"period_{k}"), F.col("_wall")) for k in kinds}).drop("_wall")


def filesystem_usage(rows: DataFrame) -> DataFrame:
    """KB totals from ``blocks, frag_size, blocks_free, blocks_avail``; usage 0 when empty."""
    def kb(blocks: str) -> Column:
        return F.col(blocks) * F.col("frag_size") / 1024
    total, root, user = kb("blocks"), kb("blocks_free"), kb("blocks_avail")
    used = total - root
    return rows.withColumns({
        "total": total, "free_root": root, "free_user": user, "used": used,
        "total_user": used + user,
        "usage_user": F.coalesce(F.try_divide(used, used + user) * 100, F.lit(0.0))})


def paired_lines(snapshots: DataFrame, file: str, category: str) -> DataFrame:
    """Files whose lines alternate between names and values under one prefix."""
    lines = F.split(F.regexp_replace("content", r"\s+$", ""), "\n")
    pairs = let(lines, lambda all_: F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor(F.size(all_) / 2).cast("int") - 1, F.lit(0))),
        lambda k: F.struct(F.split(F.trim(F.get(all_, k * 2)), r"\s+").alias("n"),
                           F.split(F.trim(F.get(all_, k * 2 + 1)), r"\s+").alias("v"))))
    rows = (snapshots.filter(F.col("file").like(file)).select("host", "ts", F.explode(pairs).alias("b"))
            .filter("b.v IS NOT NULL")
            .select("host", "ts", F.rtrim(F.regexp_replace(F.col("b.n")[0], ":$", "")).alias("prefix"),
                    F.explode(F.slice(F.arrays_zip(F.col("b.n").alias("n"), F.col("b.v").alias("v")),
                                      F.lit(2), F.size("b.v"))).alias("p")))
    return raw(rows.filter("p.n IS NOT NULL AND p.v IS NOT NULL"), category, F.lit(""),
               F.concat("prefix", "p.n"), F.col("p.v"))


def hex_cache(snapshots: DataFrame, file: str, category: str) -> DataFrame:
    """Cache files with a header line and one hexadecimal row per cpu."""
    lines = F.split(F.regexp_replace("content", r"\s+$", ""), "\n")
    names = F.split(F.trim(lines[0]), r"\s+")
    rows = (snapshots.filter(F.col("file").like(file))
            .select("host", "ts", names.alias("names"), F.posexplode(F.slice(
                lines, F.lit(2), F.size(lines))).alias("cpu", "line"))
            .select("host", "ts", "cpu", F.explode(F.arrays_zip(
                F.col("names").alias("n"), fields().alias("v"))).alias("p")))
    return raw(rows.filter("p.v IS NOT NULL"), category, F.concat(F.lit("cpu"), F.col("cpu").cast("string")),
               F.col("p.n"), hex_to_int(F.col("p.v")))


def arp(snapshots: DataFrame) -> DataFrame:
    lines = file_lines(snapshots, "%/net/arp", skip=1)
    return named_fields(lines, "net/arp", fields()[0], ARP_FIELDS, F.slice(fields(), 2, 5))


def routes(snapshots: DataFrame) -> DataFrame:
    """Route table rows with decoded destination, gateway and mask."""
    lines = file_lines(snapshots, "%/net/route", skip=1)
    out = {name: F.get(fields(), F.lit(i)) for i, name in enumerate(ROUTE_FIELDS)}
    for name in ("dst", "gateway", "mask"):
        out[name] = little_endian_ip(out[name])
    return lines.select("host", "ts", (F.col("no") - 1).alias("entry"),
                        *[c.alias(n) for n, c in out.items()])


def net_dev(snapshots: DataFrame) -> DataFrame:
    lines = file_lines(snapshots, "%/net/dev", skip=2)
    spaced = F.split(F.trim(F.regexp_replace("line", ":", ": ")), r"\s+")
    return named_fields(lines, "net/dev", F.regexp_replace(spaced[0], ":$", ""), NET_FIELDS,
                        F.slice(spaced, 2, 16))


def lookup(code: Column, table: Mapping[str, str], default: Column) -> Column:
    """Name of a code, the default for unknown ones."""
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code.cast("string")), default)


def dns_servers(snapshots: DataFrame) -> DataFrame:
    """``host, ts, if_name, server`` of the resolver status; ``global`` before the first link."""
    sections = F.split("content", r"\n(?=Link )")
    rows = snapshots.filter(F.col("file").like("%resolvectl%")).select(
        "host", "ts", F.explode(sections).alias("s"))
    link = F.regexp_extract("s", r"^Link \d+ \(([^)]*)\)", 1)
    server = F.regexp_extract("s", r"Current DNS Server:\s*(\S+)", 1)
    return rows.select("host", "ts", F.when(link == "", "global").otherwise(link).alias("if_name"),
                       server.alias("server")).filter("server <> ''")


def resolver(snapshots: DataFrame) -> DataFrame:
    """``host, ts, server``: first name server of the resolver file."""
    return snapshots.filter(F.col("file").like("%resolv.conf")).select(
        "host", "ts", F.regexp_extract("content", r"(?m)^nameserver.*?(\S+)\s*$", 1).alias("server"))


def dhcp_servers(snapshots: DataFrame) -> DataFrame:
    """``host, ts, if_name, server`` of the lease files; the last lease of an interface wins."""
    leases = snapshots.filter(F.col("file").like("%leases")).select(
        "host", "ts", "file", F.posexplode(F.split("content", r"(?=lease \{)")).alias("pos", "s"))
    rows = leases.select(
        "host", "ts", "file", "pos", F.regexp_extract("s", r'interface "([^"]+)"', 1).alias("if_name"),
        F.regexp_extract("s", r"dhcp-server-identifier\s+([^;\s]+)", 1).alias("server"))
    return (rows.filter("if_name <> '' AND server <> ''").groupBy("host", "ts", "if_name")
            .agg(F.max_by("server", F.struct("file", "pos")).alias("server")))


def interface_attributes(interfaces: DataFrame, links: DataFrame, fallback: DataFrame,
                         leases: DataFrame) -> DataFrame:
    """Link type, DNS and DHCP server of ``host, ts, if_name, type_code`` rows."""
    keys = ["host", "ts", "if_name"]
    return (interfaces
            .join(links.withColumnRenamed("server", "_dns"), keys, "left")
            .join(fallback.withColumnRenamed("server", "_any"), ["host", "ts"], "left")
            .join(leases.withColumnRenamed("server", "_dhcp"), keys, "left")
            .select(*keys, lookup(F.col("type_code"), LINK_TYPES, F.lit("unknown")).alias("type"),
                    F.coalesce("_dns", "_any", F.lit("")).alias("dns_server"),
                    F.coalesce("_dhcp", F.lit("")).alias("dhcp_server")))


def route_attributes(rows: DataFrame) -> DataFrame:
    """Names of the codes in ``proto, scope, type`` and the route key of ``dst, dst_len``."""
    def named(column: str, table: Mapping[str, str]) -> Column:
        code = F.col(column)
        return lookup(code, table, F.concat(F.lit(f"{column.upper()}_"), code.cast("string")))
    return rows.withColumns({
        "key": F.coalesce(F.concat("dst", F.lit("/"), F.col("dst_len").cast("string")),
                          F.lit("default")),
        "proto": named("proto", ROUTE_PROTO), "scope": named("scope", ROUTE_SCOPE),
        "type": named("type", ROUTE_TYPE)})


def sysctl(snapshots: DataFrame) -> DataFrame:
    """Kernel parameters by dotted name; memory pages become bytes, triples get suffixes."""
    rows = snapshots.filter(F.col("file").like("%/proc/sys/%")).select(
        "host", "ts", F.replace(F.regexp_extract("file", r"/proc/sys/(.*)$", 1), F.lit("/"), F.lit("."))
        .alias("name"), F.trim(F.regexp_replace("content", r"\s+$", "")).alias("text"))
    suffixes = F.create_map(*[x for k, v in SYSCTL_TRIPLES.items() for x in (
        F.lit(k), F.array(*[F.lit(s) for s in v]))])
    mine = F.try_element_at(suffixes, F.col("name"))
    parts = F.when(mine.isNotNull(), F.arrays_zip(
        mine.alias("suffix"), F.split("text", r"\s+").alias("v"))).otherwise(
        F.array(F.struct(F.lit("").alias("suffix"), F.col("text").alias("v"))))
    long = rows.select("host", "ts", "name", F.explode(parts).alias("p")).filter("p.v IS NOT NULL")
    value = F.when(F.col("name") == "net.ipv4.tcp_mem",
                   (F.col("p.v").cast("bigint") * PAGE_BYTES).cast("string")).otherwise(F.col("p.v"))
    return raw(long, "proc/sys", F.lit(""), F.concat("name", "p.suffix"), value)


def sensors(readings: DataFrame) -> DataFrame:
    """Sensor rows in degrees from ``host, ts, kind, sensor, label, input, max, crit``.

    Inputs are thousandths of a degree except for fans; missing limits are 0.
    """
    def degrees(column: str) -> Column:
        return F.coalesce(F.col(column) / 1000, F.lit(0.0))
    fan = F.col("kind") == "fans"
    return readings.select(
        "host", "ts", F.concat(F.lit("sensors/"), "kind").alias("category"),
        F.col("sensor").alias("entity"), F.coalesce("label", F.regexp_extract("sensor", r"([^_]+)$", 1))
        .alias("label"),
        F.when(fan, F.col("input").cast("double")).otherwise(degrees("input")).alias("input"),
        F.when(F.col("kind") == "coretemp", degrees("max")).alias("max"),
        F.when(F.col("kind") == "coretemp", degrees("crit")).alias("critical"))


def present_entities(rows: DataFrame, keys: Sequence[str] = ("host", "category")) -> DataFrame:
    """Drop entities that are absent from the newest tick of their host and category.

    The newest tick is an aggregate with a map-side part, so no key is sorted.
    """
    last = rows.groupBy(*keys).agg(F.max("ts").alias("_last"))
    alive = (rows.select(*keys, "entity", "ts").join(last, list(keys))
             .filter(F.col("ts") == F.col("_last")).select(*keys, "entity").distinct())
    return rows.join(alive, [*keys, "entity"], "left_semi")


def guest_metrics(rows: DataFrame) -> DataFrame:
    """Hypervisor metrics ``value/scale``; an offline machine keeps its state only."""
    online = F.col("online")
    return (rows.filter(online | (F.col("attr") == "state"))
            .withColumn("value", F.when(F.col("scale").isNull(), F.col("value")).otherwise(
                (F.col("value").try_cast("double") / F.col("scale")).cast("string"))))


def worker_sums(rows: DataFrame) -> DataFrame:
    """Sums over the workers of plain counters and of ``packets, bytes`` cells.

    ``host, ts, entity, attr, counters ARRAY<BIGINT>, cells ARRAY<STRUCT<packets, bytes>>``.
    """
    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + x)
    values = F.when(F.col("cells").isNotNull(), F.array(
        F.struct(F.concat("attr", F.lit("-bytes")).alias("attr"),
                 total(F.transform("cells", lambda c: c["bytes"])).alias("value")),
        F.struct(F.concat("attr", F.lit("-packets")).alias("attr"),
                 total(F.transform("cells", lambda c: c["packets"])).alias("value")))).otherwise(
        F.array(F.struct(F.col("attr").alias("attr"), total(F.col("counters")).alias("value"))))
    return rows.select("host", "ts", "entity", F.explode(values).alias("v")).select(
        "host", "ts", "entity", "v.attr", "v.value")


def error_counters(rows: DataFrame) -> DataFrame:
    """``/err/node/error`` counters summed over workers; nodes with a 6 in their name are dropped."""
    node, error = F.split("path", "/")[2], F.split("path", "/")[3]
    return (rows.select("host", "ts", node.alias("node"), error.alias("error"), F.aggregate(
        F.col("counters"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("value"))
        .filter(~F.contains(F.col("node"), F.lit("6"))))


def forwarder_paths(rows: DataFrame) -> DataFrame:
    """Split interface paths: ``entity`` is the third segment, which leaves the path; NAT roots drop."""
    parts = F.split("path", "/")
    root = parts[1]
    is_if = root == "if"
    return (rows.filter(~root.isin("nat44", "nat64"))
            .withColumn("entity", F.when(is_if, F.get(parts, F.lit(3))).otherwise(F.lit("")))
            .withColumn("attr", F.when(is_if, F.array_join(F.filter(
                parts, lambda _, i: i != 3), "/")).otherwise(F.col("path"))))


def trace_namespaces(rows: DataFrame) -> DataFrame:
    """In-band trace updates: index ``namespace:node`` and the last path element as attribute."""
    elements = F.col("elem")
    node = F.coalesce(F.get(elements, F.lit(1))["key"]["id"], F.lit(""))
    return rows.select(
        "host", "ts", F.concat_ws(":", elements[0]["key"]["id"], node).alias("entity"),
        F.element_at(F.transform(elements, lambda e: e["name"]), -1).alias("attr"), "value")


def interface_flags(rows: DataFrame, column: str = "flags") -> DataFrame:
    """The flag word as one boolean per flag."""
    return rows.withColumns({name: F.col(column).bitwiseAND(F.lit(bit)) != 0
                             for name, bit in FLAG_BITS.items()})
