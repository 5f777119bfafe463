"""Raw samples -> vendor-neutral metric samples by a mapping table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.functions.local import local_table
from trustloom.functions.scalar import cast_by_type, default_value

# Raw category | raw attribute | path | metric | divisor.
METRIC_MAPPING = """
stat/cpu | idle_all_perc | /node/bm/cpus/cpu | idle_time | 1
stat/cpu | system_all_perc | /node/bm/cpus/cpu | system_time | 1
stat/cpu | user_perc | /node/bm/cpus/cpu | user_time | 1
stat/cpu | guest_all_perc | /node/bm/cpus/cpu | guest_time | 1
sensors/thermal | temperature | /node/bm/sensors/sensor | input_temp | 1
sensors/fans | input | /node/bm/sensors/sensor | input_fanspeed | 1
sensors/fans | temperature | /node/bm/sensors/sensor | input_temp | 1
sensors/coretemp | input | /node/bm/sensors/sensor | input_temp | 1
sensors/coretemp | max | /node/bm/sensors/sensor | max_temp | 1
sensors/coretemp | critical | /node/bm/sensors/sensor | critical_temp | 1
diskstats | fs_vfstype | /node/bm/disks/disk | type | 1
diskstats | total | /node/bm/disks/disk | total_user | 1000
diskstats | free_user | /node/bm/disks/disk | free_user | 1000
diskstats | perc_reading | /node/bm/disks/disk | read_time | 1
diskstats | perc_writting | /node/bm/disks/disk | write_time | 1
diskstats | perc_io | /node/bm/disks/disk | io_time | 1
diskstats | perc_discarding | /node/bm/disks/disk | discard_time | 1
swaps | size | /node/bm/disks/disk | total_user | 1000
swaps | used | /node/bm/disks/disk | swap_used | 1
meminfo | MemTotal | /node/bm/mem | total | 1000
meminfo | MemFree | /node/bm/mem | free | 1000
meminfo | MemAvailable | /node/bm/mem | available | 1000
meminfo | Buffers | /node/bm/mem | buffers | 1000
meminfo | Cached | /node/bm/mem | cache | 1000
meminfo | Active | /node/bm/mem | active | 1000
meminfo | Inactive | /node/bm/mem | inactive | 1000
meminfo | HugePages_Total | /node/bm/mem | pages_total | 1
meminfo | HugePages_Free | /node/bm/mem | pages_free | 1
meminfo | HugePages_Rsvd | /node/bm/mem | pages_reserved | 1
meminfo | Hugepagesize | /node/bm/mem | pages_size | 1000
stats_global | proc_count | /node/bm/proc | total_count | 1
stats_global | run_count | /node/bm/proc | run_count | 1
stats_global | sleep_count | /node/bm/proc | sleep_count | 1
stats_global | idle_count | /node/bm/proc | idle_count | 1
stats_global | wait_count | /node/bm/proc | wait_count | 1
stats_global | zombie_count | /node/bm/proc | zombie_count | 1
stats_global | dead_count | /node/bm/proc | dead_count | 1
net/dev | rx_errs | /node/bm/net/if | rx_error | 1
net/dev | tx_errs | /node/bm/net/if | tx_error | 1
net/dev | carrier_up_count | /node/bm/net/if | up_count | 1
net/dev | carrier_down_count | /node/bm/net/if | down_count | 1
net/dev | carrier_changes | /node/bm/net/if | changes_count | 1
net/dev | operstate | /node/bm/net/if | state | 1
net/dev | numa_node | /node/bm/net/if | numa | 1
net/dev | local_cpulist | /node/bm/net/if | cpulist | 1
net/dev | tx_queue_len | /node/bm/net/if | tx_queue | 1
ioam/gnmi | HopLimit | /node/bm/net/ioam/namespace | hop_limit | 1
ioam/gnmi | IngressId | /node/bm/net/ioam/namespace | ingress_id | 1
ioam/gnmi | EgressId | /node/bm/net/ioam/namespace | egress_id | 1
ioam/gnmi | Timestamp | /node/bm/net/ioam/namespace | timestamp | 1
ioam/gnmi | TimestampSub | /node/bm/net/ioam/namespace | timestamp_sub | 1
vms | cpu | /node/vm/cpus/cpu | cpu_count | 1
vms | Guest/CPU/Load/User | /node/vm/cpus/cpu | user_time | 1
vms | Guest/CPU/Load/Kernel | /node/vm/cpus/cpu | system_time | 1
vms | Guest/CPU/Load/Idle | /node/vm/cpus/cpu | idle_time | 1
vms | Guest/RAM/Usage/Total | /node/vm/mem | total | 1000
vms | Guest/RAM/Usage/Free | /node/vm/mem | free | 1000
vms | Guest/RAM/Usage/Cache | /node/vm/mem | cache | 1000
vms | accessible | /node/vm/net | ssh | 1
vms | {}/Status | /node/vm/net/if | state | 1
vms | Net/Rate/Rx | /node/vm/net/if | rx_bytes | 1000
vms | Net/Rate/Tx | /node/vm/net/if | tx_bytes | 1000
kb | /sys/num_worker_threads | /node/kb/proc | worker_count | 1
kb/local | /sys/vector_rate | /node/kb/net/if | vector_rate | 1
kb/local | /if/rx-packets | /node/kb/net/if | rx_packets | 1
kb/local | /if/rx-bytes | /node/kb/net/if | rx_bytes | 1000000
kb/local | /if/rx-error | /node/kb/net/if | rx_error | 1
kb/local | /if/rx-miss | /node/kb/net/if | rx_drop | 1
kb/local | /if/tx-packets | /node/kb/net/if | tx_packets | 1
kb/local | /if/tx-bytes | /node/kb/net/if | tx_bytes | 1000000
kb/local | /if/tx-error | /node/kb/net/if | tx_error | 1
kb/remote | /sys/vector_rate | /node/kb/net/if | vector_rate | 1
kb/remote | /if/rx/T0/packets | /node/kb/net/if | rx_packets | 1
kb/remote | /if/rx/T0/bytes | /node/kb/net/if | rx_bytes | 1000000
kb/remote | /if/rx-error/T0 | /node/kb/net/if | rx_error | 1
kb/remote | /if/rx-no-buf/T0 | /node/kb/net/if | rx_no_buffer | 1
kb/remote | /if/rx-miss/T0 | /node/kb/net/if | rx_drop | 1
kb/remote | /if/tx/T0/packets | /node/kb/net/if | tx_packets | 1
kb/remote | /if/tx/T0/bytes | /node/kb/net/if | tx_bytes | 1000000
kb/remote | /if/tx-error/T0 | /node/kb/net/if | tx_error | 1
"""

# Interface attributes that are metrics under their own name.
SAME_NAME = (
    "rx_packets rx_bytes rx_drop tx_packets tx_bytes tx_drop mtu wireless dns_server dhcp_server "
    "type driver bus_info ufo tx-checksum-ipv4 tx-checksum-ip-generic tx-checksum-ipv6 "
    "tx-generic-segmentation tx-lockless rx-gro rx-lro tx-tcp-segmentation tx-gso-robust "
    "tx-tcp-ecn-segmentation tx-tcp6-segmentation tx-gre-segmentation tx-gre-csum-segmentation "
    "tx-udp-segmentation rx-hashing rx-checksum wireless_protocol broadcast debug point_to_point "
    "notrailers running noarp promisc allmulticast multicast_support").split()

# Type literal of a sensor or disk by its raw category.
TYPE_LITERALS = {"sensors/thermal": "zone", "sensors/fans": "fan", "sensors/coretemp": "cpu",
                 "swaps": "swap"}

# Forwarder error node | error text | metric; {} stands for the interface.
ERROR_MAPPING = """
ip4-input | out of buffers (drop) | ip4_input_out_of_buffers
ip4-input | ip4 destination lookup miss | ip4_input_destination_lookup_miss
ip4-input | fragment chain too long (drop) | ip4_input_fragment_chain_too_long
{}-output | interface is down | if_down
{}-output | interface is deleted | if_deleted
{}-output | no buffers to segment GSO | gso_no_buffers
"""

# Allocation error counters that are summed.
ALLOCATION_ERRORS = (
    "/err/dpdk-input/rx buf alloc from free list failed/",
    "/err/dpdk-input/rx buf alloc failed no physmem/",
    "/err/dpdk-input/rx packets dropped due to alloc error/")

MAPPING_COLUMNS = "category STRING, attr STRING, path STRING, metric STRING, divisor DOUBLE"


def mapping_table(spark: SparkSession, text: str = METRIC_MAPPING) -> DataFrame:
    """The metric mapping as rows."""
    rows = []
    for line in text.strip().splitlines():
        category, attr, path, metric, divisor = [part.strip() for part in line.split("|")]
        rows.append((category, attr, path, metric, float(divisor)))
    if text is METRIC_MAPPING:
        rows += [("net/dev", name, "/node/bm/net/if", name, 1.0) for name in SAME_NAME]
    return local_table(spark, rows, MAPPING_COLUMNS)


def normalize(raw: DataFrame, mapping: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Metric samples of raw samples: one join on the mapping, numbers divided, text kept.

    States are lower-cased as one vendor writes them capitalised. With a catalogue (``name, type``, see :func:`metric_types`) values are
    cast by type: integers are cut off, text stays text, metrics that it does not name are dropped.
    """
    joined = raw.filter("value IS NOT NULL").join(mapping, ["category", "attr"])
    number = F.col("value").try_cast("double") / F.col("divisor")
    text = F.when(F.col("metric") == "state", F.lower("value")).otherwise(F.col("value"))
    if catalog is not None:
        joined = joined.join(catalog.select(F.col("name").alias("metric"), F.col("type").alias("_type")), "metric")
        number = cast_by_type(number.cast("string"), F.col("_type"))
        known = F.col("_type") == "str"
    else:
        known = number.isNull()
    return joined.select(
        "host", "path", "entity", "metric", "ts", F.col("ts").alias("seq"), number.alias("v_num"),
        F.when(known, text).alias("v_str"))


def metric_types(catalog: DataFrame) -> DataFrame:
    """One row per metric name: the last of the subservices that have it (``place`` is the order of the catalogue)."""
    rest = [c for c in catalog.columns if c not in ("name", "place")]
    return catalog.groupBy("name").agg(F.max_by(F.struct(*rest), "place").alias("_r")).select("name", *[F.col(f"_r.{c}") for c in rest])


def with_defaults(nodes: DataFrame, catalog: DataFrame, newest: DataFrame) -> DataFrame:
    """``host, path, entity, metric, value``: the newest value of every metric that the catalogue has for a node, as text.

    ``nodes`` has ``host, path, entity``, ``catalog`` has ``subservice, name, type``. A metric without a sample has 0, or the empty
    text.
    """
    wanted = nodes.withColumn("subservice", F.element_at(F.split("path", "/"), -1)).join(
        catalog.select("subservice", F.col("name").alias("metric"), "type"), "subservice")
    return (wanted.join(newest.select("host", "path", "entity", "metric", "v_num", "v_str"), ["host", "path", "entity", "metric"], "left")
            .select("host", "path", "entity", "metric", default_value(F.col("v_num"), F.col("v_str"), F.col("type")).alias("value")))


def sensor_raw(rows: DataFrame) -> DataFrame:
    """Raw rows of the wide sensor readings: a thermal zone has a temperature, other kinds inputs and limits."""
    named = rows.withColumn("temperature", F.when(F.col("category") == "sensors/thermal", F.col("input"))).withColumn(
        "input", F.when(F.col("category") != "sensors/thermal", F.col("input")))
    long = named.unpivot(["host", "ts", "category", "entity"], ["temperature", "input", "max", "critical"], "attr", "number")
    return long.filter("number IS NOT NULL").select("host", "ts", "category", "entity", "attr", F.col("number").cast("string").alias("value"))


def disk_raw(rows: DataFrame) -> DataFrame:
    """Raw ``diskstats`` rows of disks with their usage and busy percents; absent columns give none."""
    names = [n for n in ("fs_vfstype", "total", "free_user", "perc_reading", "perc_writting", "perc_io", "perc_discarding") if n in rows.columns]
    text = rows.select("host", "ts", "entity", *[F.col(n).cast("string").alias(n) for n in names])
    return text.unpivot(["host", "ts", "entity"], names, "attr", "value").filter("value IS NOT NULL").select(
        "host", "ts", F.lit("diskstats").alias("category"), "entity", "attr", "value")


def below(entity: Column, child: Column) -> Column:
    """The name of a cpu or an interface of a machine or forwarder."""
    return F.concat(entity, F.lit(":"), child)


def vm_metrics(raw: DataFrame, children: DataFrame, mapping: DataFrame) -> DataFrame:
    """Metrics of virtual machines, their cpus and their interfaces.

    ``raw`` has ``host, ts, entity`` (the machine), ``attr, value``; ``children`` has ``host, entity, path, child, prefix``: the cpus, and the
    interfaces with the prefix of their attributes. Attributes of the machine count for all its cpus or interfaces; a mapping
    attribute ``{}/Name`` is that of the interface with the prefix before the name.
    """
    mapping = mapping.filter("category = 'vms'").drop("category")
    own = F.col("path").isin("/node/vm/mem", "/node/vm/net")
    rows = raw.filter("value IS NOT NULL")
    machine = rows.join(mapping.filter(own), "attr").withColumn("_name", F.col("entity"))
    shared = rows.join(mapping.filter(~own & ~F.col("attr").startswith("{}/")), "attr").join(
        children.drop("prefix"), ["host", "entity", "path"]).withColumn("_name", below(F.col("entity"), F.col("child"))).drop("child")
    last = F.substring_index("attr", "/", -1)
    split = rows.filter(F.contains("attr", F.lit("/"))).withColumns({
        "prefix": F.expr("left(attr, length(attr) - length(substring_index(attr, '/', -1)) - 1)"), "attr": F.concat(F.lit("{}/"), last)})
    single = (split.join(mapping.filter(~own), "attr").join(children, ["host", "entity", "path", "prefix"])
              .withColumn("_name", below(F.col("entity"), F.col("child"))).drop("child", "prefix"))
    return _measured(machine.unionByName(shared).unionByName(single), F.col("_name"))


def forwarder_interfaces(raw: DataFrame, mapping: DataFrame) -> DataFrame:
    """Metrics of forwarder interfaces from ``host, ts, entity`` (the forwarder), ``interface, attr, value``.

    Attributes without an interface count for all interfaces that the forwarder has at the tick. The local forwarder writes other
    attributes than remote ones.
    """
    mapping = mapping.filter("category IN ('kb/local', 'kb/remote') AND path = '/node/kb/net/if'")
    rows = raw.filter("value IS NOT NULL").withColumn("category", F.when(F.col("entity") == "localhost", "kb/local").otherwise("kb/remote"))
    mapped = rows.join(mapping, ["category", "attr"])
    present = rows.filter("interface IS NOT NULL").select("host", "ts", "entity", "interface").distinct()
    shared = mapped.filter("interface IS NULL").drop("interface").join(present, ["host", "ts", "entity"])
    return _measured(mapped.filter("interface IS NOT NULL").unionByName(shared), below(F.col("entity"), F.col("interface")))


def _measured(mapped: DataFrame, entity: Column) -> DataFrame:
    number = F.col("value").try_cast("double") / F.col("divisor")
    text = F.when(F.col("metric") == "state", F.lower("value")).otherwise(F.col("value"))
    return mapped.select("host", "path", entity.alias("entity"), "metric", "ts", F.col("ts").alias("seq"), number.alias("v_num"),
                         F.when(number.isNull(), text).alias("v_str"))


def type_literals(raw: DataFrame) -> DataFrame:
    """One ``type`` sample per sensor or swap and tick."""
    table = F.create_map(*[F.lit(x) for kv in TYPE_LITERALS.items() for x in kv])
    rows = raw.filter(F.col("category").isin(*TYPE_LITERALS)).select(
        "host", "ts", "category", "entity").distinct()
    path = F.when(F.col("category") == "swaps", "/node/bm/disks/disk").otherwise(
        "/node/bm/sensors/sensor")
    return rows.select("host", path.alias("path"), "entity", F.lit("type").alias("metric"), "ts",
                       F.col("ts").alias("seq"), F.lit(None).cast("double").alias("v_num"),
                       F.element_at(table, F.col("category")).alias("v_str"))


def snmp_metrics(raw: DataFrame, catalog: DataFrame) -> DataFrame:
    """Protocol counters under ``snmp_`` names, catalogue names only."""
    names = catalog.select(F.col("name").alias("metric")).distinct()
    rows = raw.filter("category = 'snmp'").withColumn("metric", F.concat(F.lit("snmp_"), "attr"))
    return rows.join(names, "metric", "left_semi").select(
        "host", F.lit("/node/bm/net").alias("path"), F.lit("").alias("entity"), "metric", "ts",
        F.col("ts").alias("seq"), F.col("value").try_cast("double").alias("v_num"),
        F.lit(None).cast("string").alias("v_str"))


def gateway_in_arp(gateways: DataFrame, arp_rows: DataFrame) -> DataFrame:
    """1 when the interface's gateway is in the host's ARP table of the tick, else 0.

    ``gateways`` has ``host, ts, entity, gateway``; ARP entities are addresses.
    """
    known = arp_rows.select("host", "ts", F.col("entity").alias("gateway"),
                            F.lit(1.0).alias("_hit")).distinct()
    return gateways.join(known, ["host", "ts", "gateway"], "left").select(
        "host", F.lit("/node/bm/net/if").alias("path"), "entity",
        F.lit("gw_in_arp").alias("metric"), "ts", F.col("ts").alias("seq"),
        F.coalesce("_hit", F.lit(0.0)).alias("v_num"), F.lit(None).cast("string").alias("v_str"))


# Forwarder memory and buffer attributes by column.
KB_MEMORY = {"/mem/statseg/total": "mem_total", "/mem/statseg/used": "mem_used",
             "/buffer-pools/default-numa-0/available": "buffer_free",
             "/buffer-pools/default-numa-0/used": "buffer_used",
             "/buffer-pools/default-numa-0/cached": "buffer_cache"}


def kb_memory(raw: DataFrame) -> DataFrame:
    """Forwarder memory: free is total less used, buffer total is free plus used; bytes to MB."""
    table = F.create_map(*[F.lit(x) for kv in KB_MEMORY.items() for x in kv])
    rows = raw.filter(F.col("attr").isin(*KB_MEMORY)).withColumn(
        "_c", F.element_at(table, F.col("attr")))
    wide = rows.groupBy("host", "ts", "entity").pivot("_c", list(KB_MEMORY.values())).agg(
        F.max(F.col("value").try_cast("double")))
    out = wide.select(
        "host", "ts", "entity", (F.col("mem_total") / 1e6).alias("total"),
        (F.col("mem_total") / 1e6 - F.col("mem_used") / 1e6).alias("free"),
        (F.col("buffer_free") + F.col("buffer_used")).alias("buffer_total"),
        F.col("buffer_free"), F.col("buffer_cache"))
    names = ["total", "free", "buffer_total", "buffer_free", "buffer_cache"]
    return out.unpivot(["host", "ts", "entity"], names, "metric", "v_num").filter(
        "v_num IS NOT NULL").select(
        "host", F.lit("/node/kb/mem").alias("path"), "entity", "metric", "ts",
        F.col("ts").alias("seq"), "v_num", F.lit(None).cast("string").alias("v_str"))


def kb_errors(spark: SparkSession, raw: DataFrame, text: str = ERROR_MAPPING) -> DataFrame:
    """Interface error metrics from ``/err/node/error/interface`` attributes."""
    rows = [tuple(p.strip() for p in line.split("|")) for line in text.strip().splitlines()]
    table = local_table(spark, rows, "node STRING, error STRING, metric STRING")
    errors = sorted({r[1] for r in rows})
    shape = r"^/err/(.+?)/(" + "|".join(
        e.replace("(", r"\(").replace(")", r"\)") for e in errors) + ")/(.*)$"
    interface = F.regexp_extract("attr", shape, 3)
    node = F.regexp_extract("attr", shape, 1)
    parts = raw.filter(F.col("attr").rlike(shape)).select(
        "host", "ts", F.concat("entity", F.lit(":"), interface).alias("entity"),
        F.when(node == F.concat(interface, F.lit("-output")), "{}-output").otherwise(node).alias("node"),
        F.regexp_extract("attr", shape, 2).alias("error"), "value")
    return parts.join(table, ["node", "error"]).select(
        "host", F.lit("/node/kb/net/if").alias("path"), "entity", "metric", "ts",
        F.col("ts").alias("seq"), F.col("value").try_cast("double").alias("v_num"),
        F.lit(None).cast("string").alias("v_str"))


def allocation_errors(raw: DataFrame) -> DataFrame:
    """Sum of the allocation error counters per forwarder and tick; absent counters add 0."""
    total = F.sum(F.when(F.col("attr").isin(*ALLOCATION_ERRORS), F.col("value").try_cast("double")))
    return raw.groupBy("host", "ts", "entity").agg(
        F.coalesce(total, F.lit(0.0)).alias("v_num")).select(
        "host", F.lit("/node/kb/net/if").alias("path"), "entity",
        F.lit("dpdk_alloc_errors").alias("metric"), "ts", F.col("ts").alias("seq"), "v_num",
        F.lit(None).cast("string").alias("v_str"))


def activity_states(latest: DataFrame) -> DataFrame:
    """``host, fullname, active`` of machines, forwarders and trace nodes from their newest status.

    ``latest`` has ``host, type, name, status``.
    """
    name, status = F.col("name"), F.col("status")
    active = (F.when(F.col("type") == "vm", status == "Running")
              .when(F.col("type") == "kb", (name == "localhost") | (F.coalesce(status, F.lit("")) == "synced"))
              .when(F.col("type") == "ioam", status == "synced"))
    below: Column = F.when(F.col("type") == "ioam", "/bm/net/ioam").otherwise(
        F.concat(F.lit("/"), "type"))
    return latest.select("host", F.concat(
        F.lit("/node[name="), "host", F.lit("]"), below, F.lit("[name="), name, F.lit("]"))
        .alias("fullname"), F.coalesce(active, F.lit(False)).alias("active"))
