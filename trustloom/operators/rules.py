"""Table-driven symptom rules over metric series.

A rule is one or more clauses joined by ``and`` or ``or``. Rule text becomes clause rows with column expressions. What rules need of a
series (range and values over the newest n samples, dynamicity) is computed once per sample for the few n in use, whatever the number
of rules; rules then meet the samples in their rows. Only rules that combine metrics need the samples of a tick together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from trustloom.functions.hof import let
from trustloom.functions.local import local_table
from trustloom.functions.paths import full_name, parent_path
from trustloom.functions.scalar import half_even, severity_weight
from trustloom.functions.skew import (CHUNK_ROWS, drop_halo, running_total,
                                      split_series)
from trustloom.operators.series import SERIES, typed
from trustloom.session import staged

SAMPLES_PER_MIN = 20
TICK = ("host", "path", "entity", "ts", "seq")
# Rules of at most this many clauses are decided by one plain expression.
FLAT_CLAUSES = 4

# The shipped rules as name | path | severity | rule.
SHIPPED_RULES = """
Free memory available (TESTING) | /node/bm/mem | Orange | free>50
Free CPU (TESTING) | /node/bm/cpus/cpu | Orange | idle_time>90
Free VM CPU (TESTING) | /node/vm/cpus/cpu | Orange | idle_time>90
Swap volume in use | /node/bm/disks/disk | Red | swap_used!=0
No free memory available | /node/bm/mem | Orange | free<50
No free memory available for 1 min | /node/bm/mem | Red | 1min(free)<50
No free memory available | /node/vm/mem | Orange | free<50
No free memory available for 1 min | /node/vm/mem | Red | 1min(free)<50
No free hugepages available | /node/bm/mem | Orange | pages_free==0
Bare Metal CPU High Load (Idle <70%) | /node/bm/cpus/cpu | Red | idle_time<70
No CPU idle time for 1 min | /node/bm/cpus/cpu | Orange | 1min(idle_time)<=1
No CPU idle time for 5 min | /node/bm/cpus/cpu | Red | 5min(idle_time)<=1
No CPU idle time for 1 min | /node/vm/cpus/cpu | Orange | 1min(idle_time)<=1
No CPU idle time for 5 min | /node/vm/cpus/cpu | Red | 5min(idle_time)<=1
Sensor reached maximum temperature | /node/bm/sensors/sensor | Orange | input_temp>=max_temp
Sensor reached critical temperature | /node/bm/sensors/sensor | Red | input_temp>=critical_temp
Low Fan Speed | /node/bm/sensors/sensor | Red | input_fanspeed<100
Zombie Threads | /node/bm/proc | Orange | zombie_count>0
No SSH access to VM | /node/vm/net | Orange | ssh==0
No ARP Entry For Default Gateway | /node/bm/net/if | Red | (state=="up") and (gw_in_arp==0)
Non-standard Ethernet MTU | /node/bm/net/if | Red | (mtu!=1500) and (type=="ether")
Interface Flapping | /node/bm/net/if | Red | 1min(dynamicity(changes_count))>=6
Receive Errors Peak | /node/bm/net/if | Orange | 1min(dynamicity(rx_error))>100
Receive Drops Peak | /node/bm/net/if | Orange | 1min(dynamicity(rx_drop))>10000
Transmit Errors Peak | /node/bm/net/if | Orange | 1min(dynamicity(tx_error))>100
Transmit Drops Peak | /node/bm/net/if | Orange | 1min(dynamicity(tx_drop))>100
No Buffers available for GSO | /node/kb/net/if | Orange | dynamicity(gso_no_buffers)>0
Packet dropped due to missing mbuf | /node/kb/net/if | Orange | dynamicity(rx_no_buffer)>0
Missing buffer in ip4-input | /node/kb/net/if | Orange | dynamicity(ip4_input_out_of_buffers)>0
Fragment chain too long | /node/kb/net/if | Orange | dynamicity(ip4_input_fragment_chain_too_long)>0
Destination lookup miss | /node/kb/net/if | Orange | dynamicity(ip4_input_destination_lookup_miss)>0
Receive Errors Peak | /node/kb/net/if | Orange | 1min(dynamicity(rx_error))>100
Receive Drops Peak | /node/kb/net/if | Orange | 1min(dynamicity(rx_drop))>10000
Transmit Errors Peak | /node/kb/net/if | Orange | 1min(dynamicity(tx_error))>100
Transmit Drops Peak | /node/kb/net/if | Orange | 1min(dynamicity(tx_drop))>100
Low Buffer Availability | /node/kb/mem | Orange | (buffer_free/buffer_total)<0.1
DPDK Buffer Alloc Errors | /node/kb/net/if | Orange | dynamicity(dpdk_alloc_errors)>0
Average process number greater than expected - (Remote Code Execution) | /node/bm/proc | Red | 1min(dynamicity(sleep_count))+1min(dynamicity(run_count))>210
Anomalous Outbound Traffic - (Data Exfiltration) | /node/bm/net/if | Red | 1min(dynamicity(tx_packets))>4000
"""

RULE_COLUMNS = "name STRING, path STRING, severity STRING, rule STRING"


def rule_table(spark: SparkSession, text: str = SHIPPED_RULES) -> DataFrame:
    """Rule rows from lines of ``name | path | severity | rule``."""
    rows = [tuple(part.strip() for part in line.split("|", 3))
            for line in text.strip().splitlines()]
    return local_table(spark, rows, RULE_COLUMNS)


def valid_severity(rules: DataFrame) -> DataFrame:
    """Upper-case the severity and drop rules with an unknown one."""
    return (rules.withColumn("severity", F.upper("severity"))
            .filter(F.col("severity").isin("GREEN", "ORANGE", "RED")))


FEATURE = r"(?:([15])min\()?(dynamicity\()?(?:([15])min\()?([A-Za-z_][\w-]*)\)*"


def _opens(text: Column) -> Column:
    """Opening less closing brackets."""
    return F.regexp_count(text, F.lit(r"\(")) - F.regexp_count(text, F.lit(r"\)"))


def clause_table(rules: DataFrame, samples_per_min: int = SAMPLES_PER_MIN) -> DataFrame:
    """One row per operand of each clause.

    Operands have a role: ``a`` and ``b`` on the left, ``r`` for a metric on the
    right. ``valid`` is false for all operands of a rule if any part of it is not of the
    supported form: a rule is taken or refused as a whole.
    """
    text = F.regexp_replace("rule", r"\s*(>=|<=|==|!=|<|>)\s*", "$1")
    joiner = (F.when(text.rlike(r"\sor\s") & text.rlike(r"\sand\s"), "mixed")
              .when(text.rlike(r"\sor\s"), "or").otherwise("and"))
    base = (valid_severity(rules)
            .withColumn("rule_id", F.sha1(F.concat_ws("|", "name", "path", "severity", "rule")))
            .withColumn("joiner", joiner)
            .withColumn("_parts", F.split(text, r"\s+(?:and|or)\s+"))
            .withColumn("clauses", F.size("_parts"))
            .select("*", F.posexplode("_parts").alias("clause_no", "clause")).drop("_parts"))
    sides = r"^(.*?)(>=|<=|==|!=|<|>)(.*)$"
    left, right = F.regexp_extract("clause", sides, 1), F.regexp_extract("clause", sides, 3)
    # Brackets around a clause open on the left and close on the right; those around the left side are inside it.
    lead, open_ = F.length(F.regexp_extract(left, r"^\(*", 0)), _opens(left)
    inner = lead - open_
    closed = (open_ >= 0) & (inner >= 0) & (_opens(right) == -open_) & (F.length(F.regexp_extract(left, r"\)*$", 0)) >= inner)
    base = base.withColumns({
        "_left": F.substring(left, lead + 1, F.greatest(F.length(left) - lead - F.greatest(inner, F.lit(0)), F.lit(0))),
        "_right": F.regexp_replace(right, r"\)+$", ""), "op": F.regexp_extract("clause", sides, 2), "_closed": closed})
    second = F.regexp_extract("_left", rf"^{FEATURE}\s*([-+/])\s*(.+)$", 6)
    base = base.withColumns({
        "_second": second,
        "transform": F.nullif(F.regexp_extract("_left", rf"^{FEATURE}\s*([-+/])\s*(.+)$", 5),
                              F.lit("")),
        "rhs_num": F.col("_right").try_cast("double"),
        "rhs_str": F.nullif(F.regexp_extract("_right", "^[\"'](.*)[\"']$", 1), F.lit(""))})
    right_metric = F.when(F.col("rhs_num").isNull() & F.col("rhs_str").isNull(), F.col("_right"))
    operands = F.filter(F.array(
        F.struct(F.lit("a").alias("role"), F.col("_left").alias("text")),
        F.struct(F.lit("b").alias("role"), F.nullif("_second", F.lit("")).alias("text")),
        F.struct(F.lit("r").alias("role"), right_metric.alias("text"))),
        lambda o: o["text"].isNotNull())
    out = base.withColumn("operands", F.size(operands)).withColumn("_o", F.explode(operands))
    piece = F.col("_o.text")
    # The first operand of a transform is what stands before its sign.
    piece = F.when((F.col("_o.role") == "a") & F.col("transform").isNotNull(), F.regexp_extract(
        piece, rf"^({FEATURE})\s*[-+/]\s*.+$", 1)).otherwise(F.trim(piece))
    whole = f"^{FEATURE}$"
    minute = F.coalesce(F.nullif(F.regexp_extract(piece, whole, 1), F.lit("")),
                        F.nullif(F.regexp_extract(piece, whole, 3), F.lit("")))
    metric = F.regexp_extract(piece, whole, 4)
    sound = (metric != "") & (F.col("op") != "") & (F.col("joiner") != "mixed") & F.col("_closed") & (_opens(piece) == 0)
    return out.select(
        "rule_id", "name", "path", "severity", "rule", "joiner", "clauses", "clause_no",
        "operands", "transform", "op", "rhs_num", "rhs_str", F.col("_o.role").alias("role"),
        metric.alias("metric"),
        (F.regexp_extract(piece, whole, 2) != "").alias("dynamicity"),
        F.coalesce(minute.cast("int") * samples_per_min, F.lit(1)).alias("n"),
        sound.alias("_sound")).withColumn("valid", F.bool_and("_sound").over(Window.partitionBy("rule_id"))).drop("_sound")


def rejected_rules(clauses: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rules that use an unknown metric or an unsupported form, with the reason."""
    known = catalog.select(F.col("name").alias("metric")).distinct()
    unknown = (clauses.join(known, "metric", "left_anti")
               .select("rule_id", "name", "rule", F.concat(F.lit("unknown metric "), "metric")
                       .alias("reason")))
    malformed = (clauses.filter(~F.col("valid"))
                 .select("rule_id", "name", "rule", F.lit("unsupported form").alias("reason")))
    return unknown.unionByName(malformed).distinct()


def compare(op: Column, left: Column, right: Column) -> Column:
    return (F.when(op == "<", left < right).when(op == "<=", left <= right)
            .when(op == "==", left == right).when(op == "!=", left != right)
            .when(op == ">", left > right).when(op == ">=", left >= right))


NOW = "struct<n:int,nums:bigint,low:double,high:double,texts:bigint,first:string,last:string,numbers:array<double>,words:array<string>>"


def series_states(samples: DataFrame, steady: dict[int, set[str]], moving: list[int], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Samples with what rules ask of their series, in one pass over it.

    ``over`` has an entry for every n of ``steady`` with what is asked of the newest n values: the range of the numbers or words and how
    many there are, or the values themselves (``number, word, numbers, words``); ``moves`` has the dynamicity for every n of
    ``moving``. Entries are there once a series has n samples.
    """
    cut = split_series(samples, SERIES, ("ts", "seq"), max([1, *steady, *moving]) + 1, chunk_rows)
    w = Window.partitionBy(*SERIES, "_chunk").orderBy("ts", "seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.coalesce((F.lag("v_str").over(w) != F.col("v_str")).cast("int"), F.lit(0))
    rows = cut.withColumns({"_len": F.row_number().over(w), "_step": step}).withColumns({
        "_steps": F.sum("_step").over(upto), "_nums": F.count("v_num").over(upto), "_texts": F.count("v_str").over(upto)})

    def recent(n: int):
        return w.rowsBetween(-(n - 1), 0)

    def held(count: str, n: int) -> Column:
        return F.col(count) - F.coalesce(F.lag(count, n).over(w), F.lit(0))

    def ranged(n: int) -> Column:
        frame, asked = recent(n), steady[n]

        def maybe(kind: str, value: Column) -> Column:
            return value if kind in asked else F.lit(None)
        return F.when(F.col("_len") >= n, F.struct(
            F.lit(n), held("_nums", n), maybe("number", F.min("v_num").over(frame)), maybe("number", F.max("v_num").over(frame)),
            held("_texts", n), maybe("word", F.min("v_str").over(frame)), maybe("word", F.max("v_str").over(frame)),
            maybe("numbers", F.collect_list("v_num").over(frame)), maybe("words", F.collect_list("v_str").over(frame))).cast(NOW))

    def moved(n: int) -> Column:
        back = F.coalesce(F.lag("v_num", n).over(w), F.lag("v_num", n - 1).over(w) if n > 1 else F.col("v_num"))
        mean = F.avg("v_num").over(recent(n)) if n > 1 else F.col("v_num")
        changes = F.col("_steps") - F.coalesce(F.lag("_steps", n - 1).over(w), F.lit(0)) if n > 1 else F.lit(0)
        change = F.col("v_num") - back
        value = (F.when(F.col("vtype") == "str", (changes > 0).cast("double"))
                 .when((F.col("counter") != 0) & (F.col("vtype") == "float"), half_even(change, 2))
                 .when(F.col("counter") != 0, change)
                 .when(F.col("vtype") == "float", half_even(mean, 2))
                 .otherwise(mean.cast("bigint").cast("double")))
        return F.when(F.col("_len") >= n, F.struct(F.lit(n).alias("n"), value.alias("value")))

    def known(entries: list[Column], kind: str) -> Column:
        return F.filter(F.array(*entries), lambda e: e.isNotNull()) if entries else F.array().cast(kind)
    rows = rows.withColumns({"over": known([ranged(n) for n in sorted(steady)], f"array<{NOW}>"),
                             "moves": known([moved(n) for n in moving], "array<struct<n:int,value:double>>")})
    return drop_halo(rows).select(*TICK, "metric", "v_num", "v_str", "over", "moves")


def _every(op: Column, low: Column, high: Column, values: Column, constant: Column) -> Column:
    """Whether all values of a range compare so with the constant."""
    return (F.when(op == "<", high < constant).when(op == "<=", high <= constant).when(op == ">", low > constant)
            .when(op == ">=", low >= constant).when(op == "==", (low == constant) & (high == constant))
            .when(op == "!=", ~F.array_contains(values, constant)))


def _states(item: Column, operand: Column) -> Column:
    """What a sample says about an operand: ``feature`` to calculate with, and ``held``, its comparison with the constant."""
    op, number, word, n = operand["op"], operand["rhs_num"], operand["rhs_str"], operand["n"]
    now = F.coalesce(compare(op, item["v_num"], number), compare(op, item["v_str"], word), F.lit(False))
    over, move = (F.get(F.filter(item[part], lambda e: e["n"] == n), F.lit(0)) for part in ("over", "moves"))

    def sustained(o: Column) -> Column:
        return F.coalesce(F.when((o["nums"] == n) & number.isNotNull(), _every(op, o["low"], o["high"], o["numbers"], number))
                          .when((o["texts"] == n) & word.isNotNull(), _every(op, o["first"], o["last"], o["words"], word)), F.lit(False))
    moving = let(move, lambda m: F.struct(m["value"].alias("feature"), F.coalesce(compare(op, m["value"], number), F.lit(False)).alias("held"), m.isNotNull().alias("ready")))
    steady = let(over, lambda o: F.struct(F.lit(None).cast("double").alias("feature"), sustained(o).alias("held"), o.isNotNull().alias("ready")))
    return F.when(operand["dynamicity"], moving).when(n > 1, steady).otherwise(
        F.struct(item["v_num"].alias("feature"), now.alias("held"), F.lit(True).alias("ready")))


OPERAND = ("role", "metric", "dynamicity", "n", "op", "rhs_num", "rhs_str")


class Metric(NamedTuple):
    """A column of wide samples (``host, ts, seq`` and a column per metric) and the series it holds: numbers, or texts if ``vtype`` is ``str``."""

    column: str
    path: str
    entity: str
    metric: str
    vtype: str
    counter: int


def _stored_clauses(clauses: DataFrame) -> DataFrame:
    """The clauses of valid rules with weight, number of operands and whether they look back."""
    clauses = clauses.filter("valid").withColumn("_operands", F.count(F.lit(1)).over(Window.partitionBy("rule_id")))
    return staged(clauses.withColumns({"weight": severity_weight(F.col("severity")), "_window": (F.col("n") > 1) | F.col("dynamicity")}), "clauses")


def rule_hits(samples: DataFrame, clauses: DataFrame, chunk_rows: int = CHUNK_ROWS, layout: Sequence[Metric] = ()) -> DataFrame:
    """Ticks at which a rule fires: ``rule_id, name, severity, weight`` plus host, path, entity, ts, seq.

    ``samples`` has a row per sample; with a ``layout`` it has a row per tick of a host and the columns that the layout names, each of
    which is a sample of the tick (see :func:`_wide_hits`). The metrics of one entity are sampled at the same ticks. Rules of one operand
    are decided in the sample's row; the samples of other rules' metrics are gathered per tick once, and all these rules are decided in the
    tick's row. Neither shuffle grows with the number of rules. No valid rule gives no rows.
    """
    clauses = _stored_clauses(clauses)
    if layout:
        return _wide_hits(samples, layout, clauses, chunk_rows)
    samples = typed(samples)
    shapes = clauses.groupBy("n", "dynamicity", (F.col("op") == "!=").alias("unequal"), F.col("rhs_num").isNotNull().alias("number")).agg(
        F.bool_or(F.col("_operands") > 1).alias("several")).collect()  # a few window lengths
    steady: dict[int, set[str]] = {}
    for r in shapes:
        if r["n"] > 1 and not r["dynamicity"]:
            steady.setdefault(r["n"], set()).add(("number" if r["number"] else "word") + ("s" if r["unequal"] else ""))
    moving = sorted({r["n"] for r in shapes if r["dynamicity"]})

    def metrics(which: Column) -> DataFrame:
        return clauses.filter(which).select("path", "metric").distinct()
    rule = ["rule_id", "name", "severity", "weight"]
    operand = F.struct(*OPERAND).alias("o")
    plain = samples.select(*TICK, "metric", "v_num", "v_str", F.array().cast(f"array<{NOW}>").alias("over"),
                           F.array().cast("array<struct<n:int,value:double>>").alias("moves"))
    kept = None
    if steady or moving:
        watched = samples.join(metrics(F.col("_window")), ["path", "metric"], "left_semi")
        kept = series_states(watched, steady, moving, chunk_rows)
    single, item = F.col("_operands") == 1, F.struct("v_num", "v_str", "over", "moves")

    now = clauses.filter(single & ~F.col("_window")).select("path", "metric", *rule, "op", "rhs_num", "rhs_str")
    held = F.coalesce(compare(F.col("op"), F.col("v_num"), F.col("rhs_num")), compare(F.col("op"), F.col("v_str"), F.col("rhs_str")), F.lit(False))
    hits = samples.join(now, ["path", "metric"]).filter(held).select(*rule, *TICK)
    if kept is not None:
        mine = clauses.filter(single & F.col("_window")).select("path", "metric", *rule, operand)
        state = kept.join(mine, ["path", "metric"]).withColumn("_state", _states(item, F.col("o")))
        hits = hits.unionByName(state.filter(F.col("_state.ready") & F.col("_state.held")).select(*rule, *TICK))
    if not any(r["several"] for r in shapes):
        return hits
    used = metrics(~single)
    items = plain.join(used, ["path", "metric"], "left_semi")
    if kept is not None:
        items = items.join(metrics(F.col("_window")), ["path", "metric"], "left_anti").unionByName(
            kept.join(used, ["path", "metric"], "left_semi"))
    return hits.unionByName(_combined(items, clauses.filter(~single), rule))


def _combination(sign: Column, a: Column, b: Column) -> Column:
    """Both operands of a transform as one number; without a sign the first."""
    return (F.when(sign == "+", a + b).when(sign == "-", a - b)
            .when(sign == "/", F.when(b == 0, F.lit(0.0)).otherwise(a / b)).otherwise(a))


def _wide_hits(ticks: DataFrame, layout: Sequence[Metric], clauses: DataFrame, chunk_rows: int) -> DataFrame:
    """:func:`rule_hits` over wide samples: the sides of clauses are items of an array in the tick's row, in which all rules are decided.

    The windows of all series are taken in one pass over the ticks of a host, and each only for what the rules on its metric ask. No sample
    is a row of its own; a tick meets the rules of the layout's paths by a join without a key, and only hits come out of it. A side is
    what stands before a number in a clause; the plan grows with the different sides, not with the numbers that rules compare them with.
    """
    if len({m[1:4] for m in layout}) < len(layout):
        raise ValueError("a layout names a series twice")
    series = local_table(ticks.sparkSession, [m[1:4] for m in layout], "path string, entity string, metric string")
    rule, places = ["path", "entity", "rule_id", "name", "severity", "weight", "joiner"], series.select("path", "entity").distinct()
    operand, count = F.struct("metric", "dynamicity", "n"), F.first("operands")
    # Clauses at each entity of their path; one with an operand that the layout lacks is never met.
    parts = (clauses.join(places, "path").join(series.withColumn("known", F.lit(1)), ["path", "entity", "metric"], "left").groupBy(*rule, "clause_no")
             .agg(*[F.first(c).alias(c) for c in ("clauses", "transform", "op", "rhs_num", "rhs_str")],
                  *[F.max(F.when(F.col("role") == role, operand)).alias(role) for role in "abr"],
                  ((count == 1) & ~F.bool_or("dynamicity")).alias("plain"), (F.count(F.lit(1)) == count).alias("whole"), (F.count("known") == count).alias("known"))
             .filter("whole AND known"))
    word, window = F.when(F.col("plain"), F.col("rhs_str")), F.col("plain") & (F.col("a.n") > 1)
    ask = F.when(word.isNotNull(), F.col("op")).when(window, F.when(F.col("op").isin("<", "<="), "<").when(F.col("op").isin(">", ">="), ">").otherwise(F.col("op")))
    about = ["path", "entity", "plain", "transform", "a", "b", "r", "ask", "word"]
    parts = staged(parts.withColumns({"ask": ask, "word": word}).withColumn("side", F.to_json(F.struct(*about))), "parts")
    asked = parts.groupBy("side").agg(*[F.first(c).alias(c) for c in about], F.max("clauses").alias("clauses")).collect()  # sides, not rules
    states, spots = _wide_states(ticks, layout, asked, chunk_rows)
    coded = F.col("word").isNotNull() | F.col("r").isNotNull()  # sides that are compared with 0
    op, number = F.when(F.col("word").isNotNull(), "==").otherwise(F.col("op")), F.when(coded, 0.0).otherwise(F.col("rhs_num"))
    wanted = parts.join(spots, "side").groupBy(*rule).agg(F.collect_list(F.struct(
        *[op.isin(*ops).alias(name) for name, ops in (("less", ("<", "<=", "!=")), ("same", ("<=", "==", ">=")), ("more", (">", ">=", "!=")))],
        number.alias("number"), F.when(number.isNotNull(), F.col("item")).alias("item"), "list")).alias("parts"), F.first("clauses").alias("clauses"))
    wanted = staged(wanted.withColumn("enough", F.when(F.col("joiner") == "or", 1).otherwise(F.col("clauses"))).filter(
        F.size("parts") >= F.col("enough")), "rules")

    def fires(part: dict[str, Column]) -> Column:
        """True, or else false or NULL."""
        left, right = F.get("_items", part["item"]), part["number"]
        held = F.when(left < right, part["less"]).when(left == right, part["same"]).when(left.isNotNull(), part["more"])
        return held | ~F.array_contains(F.get("_lists", part["list"]), right) if "_lists" in states.columns else held
    names, most = wanted.schema["parts"].dataType.elementType.fieldNames(), max([1, *[r["clauses"] for r in asked]])
    if most > FLAT_CLAUSES:
        flat, fired = wanted, F.size(F.filter("parts", lambda part: fires({c: part[c] for c in names})))
    else:
        flat = wanted.select(*rule, "enough", *[F.get("parts", F.lit(i))[c].alias(f"_{i}_{c}") for i in range(most) for c in names])
        fired = sum((F.when(fires({c: F.col(f"_{i}_{c}") for c in names}), 1).otherwise(0) for i in range(most)), F.lit(0))
    return states.join(flat, fired >= F.col("enough")).select("rule_id", "name", "severity", "weight", *TICK)


def _wide_states(ticks: DataFrame, layout: Sequence[Metric], asked: Sequence[Row], chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """Ticks with the value of every asked side in ``_items``, and a table of the place that a ``side`` has in it (``item``).

    Of a window ``<`` asks the greatest value, ``>`` the least and ``==`` the one that all have; for ``!=`` all are in ``_lists``
    (``list``). A side against another metric is -1, 0 or 1, as it is less, equal or greater, and one that compares with a word is 0 where
    it holds. An item is NULL where a series is shorter than the window or a value is missing.
    """
    columns = {m[1:4]: m for m in layout}

    def operand(r: Row, role: str) -> tuple[Metric, int, bool]:
        return columns[r["path"], r["entity"], r[role]["metric"]], r[role]["n"], r[role]["dynamicity"]
    operands = {operand(r, role) for r in asked for role in "abr" if r[role]}
    cut = split_series(ticks, ["host"], ("ts", "seq"), max([1, *[n for _, n, _ in operands]]) + 1, chunk_rows)
    w = Window.partitionBy("host", "_chunk").orderBy("ts", "seq")

    def recent(n: int):
        return w.rowsBetween(-(n - 1), 0)
    steps = {f"_step_{m.column}": F.coalesce((F.lag(m.column).over(w) != F.col(m.column)).cast("int"), F.lit(0))
             for m, _, dynamic in operands if dynamic and m.vtype == "str"}
    # The extremes of n rows are those of some shorter runs that cover them, so their cost grows with the root of n.
    runs: dict[str, Column] = {}
    backs: dict[str, Column] = {}

    def extreme(m: Metric, n: int, pick: str) -> Column:
        size = math.isqrt(n)
        run, value = f"_{pick}_{n}_{m.column}", F.col(m.column)
        runs[run] = F.when(F.count(value).over(recent(size)) == size, (F.max if pick == "most" else F.min)(value).over(recent(size)))
        offsets = [*range(0, n - size, size), n - size]
        backs.update({f"{run}_{o}": F.lag(run, o).over(w) for o in offsets})
        ends = [F.col(f"{run}_{o}") for o in offsets]
        return F.when(reduce(Column.__and__, [e.isNotNull() for e in ends]), (F.greatest if pick == "most" else F.least)(*ends))
    none = F.lit(None).cast("double")

    def moved(m: Metric, n: int) -> Column:
        if m.vtype == "str":
            return ((F.sum(f"_step_{m.column}").over(w.rowsBetween(-(n - 2), 0)) if n > 1 else F.lit(0)) > 0).cast("double")
        value = F.col(m.column)
        if m.counter:
            change = value - F.coalesce(F.lag(value, n).over(w), F.lag(value, n - 1).over(w) if n > 1 else value)
            return half_even(change, 2) if m.vtype == "float" else change
        mean = F.avg(value).over(recent(n)) if n > 1 else value
        return half_even(mean, 2) if m.vtype == "float" else mean.cast("bigint").cast("double")

    def feature(r: Row, role: str) -> Column:
        """A number to calculate with."""
        if not r[role]:
            return none
        m, n, dynamic = operand(r, role)
        if dynamic:
            return F.when(F.col("_len") >= n, moved(m, n))
        return none if n > 1 or m.vtype == "str" else F.col(m.column)

    def item(r: Row) -> Column:
        if not r["plain"]:
            left, right = _combination(F.lit(r["transform"]), feature(r, "a"), feature(r, "b")), feature(r, "r")
            return F.when(left < right, -1.0).when(left == right, 0.0).when(left > right, 1.0) if r["r"] else left
        m, n, _ = operand(r, "a")
        value, ask, word = F.col(m.column), r["ask"], r["word"]
        if (m.vtype == "str") != (word is not None):
            return none
        if n == 1:
            return F.when(compare(F.lit(ask), value, F.lit(word)), 0.0) if word is not None else value
        if word is not None and ask == "!=":
            every = F.collect_list(value).over(recent(n))
            return F.when((F.size(every) == n) & ~F.array_contains(every, word), 0.0)
        least, most = (extreme(m, n, pick) if ask[0] in asks else None for pick, asks in (("least", ">="), ("most", "<=")))
        if word is None:
            return most if least is None else least if most is None else F.when(least == most, least)
        ends = [compare(F.lit(ask), end, F.lit(word)) for end in (least, most) if end is not None]
        return F.when(reduce(Column.__and__, ends), 0.0)
    items, lists, spots = [], [], []
    for r in asked:
        listed = r["plain"] and r["ask"] == "!=" and r["word"] is None
        if listed:
            m, n, _ = operand(r, "a")
            every = F.collect_list(m.column if m.vtype != "str" else none).over(recent(n))
            lists.append(F.when(F.size(every) == n, every))
        else:
            items.append(item(r))
        spots.append((r["side"], None if listed else len(items) - 1, len(lists) - 1 if listed else None))
    rows = cut.withColumns({**steps, **runs, "_len": F.row_number().over(w)}).withColumns(backs)
    arrays = {"_items": (items, "double")} | ({"_lists": (lists, "array<double>")} if lists else {})
    states = rows.select("host", "ts", "seq", "_chunk", "_halo", *[F.array(*x).cast(f"array<{kind}>").alias(name) for name, (x, kind) in arrays.items()])
    return drop_halo(states), local_table(ticks.sparkSession, spots, "side string, item int, list int")


def _combined(items: DataFrame, clauses: DataFrame, rule: list[str]) -> DataFrame:
    """Rules of several operands, decided in the row of a tick, which holds one entry per metric of the entity."""
    ticks = items.groupBy(*TICK).agg(F.collect_list(F.struct("metric", "v_num", "v_str", "over", "moves")).alias("items"))
    parts = clauses.groupBy("path", *rule, "joiner", "clause_no").agg(F.struct(
        F.first("operands").alias("operands"), F.first("transform").alias("transform"), F.first("op").alias("op"), F.first("rhs_num").alias("rhs_num"),
        F.bool_or("dynamicity").alias("moving"), F.collect_list(F.struct(*OPERAND)).alias("o")).alias("clause"))
    wanted = parts.groupBy("path", *rule, "joiner").agg(F.collect_list("clause").alias("parts"))

    def fires(clause: Column) -> Column:
        def stated(o: Column) -> Column:
            item = F.get(F.filter("items", lambda i: i["metric"] == o["metric"]), F.lit(0))
            return let(item, lambda i: F.when(i.isNotNull(), let(_states(i, o), lambda x: F.struct(
                o["role"].alias("role"), x["feature"].alias("feature"), x["held"].alias("held"), x["ready"].alias("ready")))))

        def decided(states: Column) -> Column:
            def side(role: str) -> Column:
                return F.get(F.filter(states, lambda x: x["role"] == role), F.lit(0))["feature"]
            computed = compare(clause["op"], _combination(clause["transform"], side("a"), side("b")), F.coalesce(clause["rhs_num"], side("r")))
            plain = (clause["operands"] == 1) & ~clause["moving"]
            return (F.size(states) == clause["operands"]) & F.when(plain, F.forall(states, lambda x: x["held"])).otherwise(F.coalesce(computed, F.lit(False)))
        return let(F.filter(F.transform(clause["o"], stated), lambda x: x.isNotNull() & x["ready"]), decided)
    hit = F.when(F.col("joiner") == "or", F.exists("parts", fires)).otherwise(F.forall("parts", fires))
    return ticks.join(wanted, "path").filter(hit).select(*rule, *TICK)


def active_hits(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Drop hits of nodes that are inactive or whose immediate parent is; a root never fires."""
    named = hits.withColumn("fullname", full_name(F.col("host"), F.col("path"), F.col("entity")))
    state = nodes.select("host", "fullname", "active")
    parent = state.select("host", F.col("fullname").alias("parent"),
                          F.col("active").alias("parent_active"))
    return (named.withColumn("parent", parent_path(F.col("fullname")))
            .join(state, ["host", "fullname"])
            .join(parent, ["host", "parent"])
            .filter(F.col("active") & F.col("parent_active"))
            .drop("active", "parent_active"))


def symptom_rows(hits: DataFrame) -> DataFrame:
    """Symptom instances: id, node full name and start tick of each hit."""
    return hits.select(
        F.sha1("name").alias("symptom_id"), "name", "severity", "weight", "host", "path", "entity",
        full_name(F.col("host"), F.col("path"), F.col("entity")).alias("node"), "ts", "seq")


def symptom_intervals(states: DataFrame, keys: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Start, stop and tick count of each run of true ``hit`` rows along (ts, seq).

    A change counter numbers the runs. It is a running total, cut for hot keys,
    and the runs are then plain aggregates.
    """
    w = Window.partitionBy(*keys, "_chunk").orderBy("ts", "seq")
    cut = split_series(states, keys, ("ts", "seq"), 2, chunk_rows)
    marked = drop_halo(cut.withColumn("_turn", F.coalesce(
        (F.lag("hit").over(w) != F.col("hit")).cast("bigint"), F.lit(0))))
    numbered = running_total(marked, keys, ("ts", "seq"), "_turn", "_run",
                             chunk_rows)
    return (numbered.filter("hit").groupBy(*keys, "_run")
            .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("stop_ts"),
                 F.count(F.lit(1)).alias("ticks")).drop("_run"))


def activated_log(symptoms: DataFrame, rules: DataFrame, scores: DataFrame) -> DataFrame:
    """The seven columns of the activation log: node, rule, path, severity, weight, text, score."""
    texts = valid_severity(rules).select("name", "path", "severity", "rule").distinct()
    return (symptoms.join(texts, ["name", "path", "severity"])
            .join(scores.select(F.col("fullname").alias("node"), "health_score"), "node")
            .select("node", F.col("name").alias("activated_rule"), "path", "severity", "weight",
                    "rule", F.col("health_score").alias("new_health_score")))
