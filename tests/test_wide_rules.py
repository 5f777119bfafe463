"""Rules over one row per tick against the same rules over one row per sample."""

import random

import pytest
from pyspark.sql.types import StructType
from test_rules import SAMPLES

from trustloom.operators import rules

NS = 3600 * 10**9 // 4
LAYOUT = [rules.Metric("a0", "/p", "", "a", "float", 0), rules.Metric("b0", "/p", "", "b", "int", 1), rules.Metric("f0", "/p", "", "f", "float", 1), rules.Metric("i0", "/p", "", "i", "int", 0),
          rules.Metric("s0", "/p", "", "s", "str", 0), rules.Metric("a1", "/q", "x:1", "a", "float", 0), rules.Metric("a2", "/q", "x:2", "a", "float", 0), rules.Metric("s2", "/q", "x:2", "s", "str", 0)]
OPS = {"<": (3, 2), "<=": (2, 1), ">": (1, 2), ">=": (2, 3), "==": (2, 1), "!=": (2, 3)}
RULES = "\n".join(
    [f"{k}{n}{op}{m} | {path} | Red | {f'{n}min({m})' if n else m}{op}{limit}" for op, limits in OPS.items() for k, limit in enumerate(limits) for n in (0, 1, 5) for path, m in (("/p", "a"), ("/q", "a"))]
    + [f'{n}{op}s | /p | Orange | {f"{n}min(s)" if n else "s"}{op}"up"' for op in OPS for n in (0, 1, 5)]
    + [f"{n}{m}{op} | /p | Green | {f'{n}min(dynamicity({m}))' if n else f'dynamicity({m})'}{op}{limit}"
       for n in (0, 1, 5) for m, limit in (("a", 1.67), ("b", 0), ("f", 0), ("i", 2), ("s", 0)) for op in (">", "<=", "!=")]
    + ["r1 | /p | Red | a>=b", "r2 | /p | Red | (a+b)>3", "r3 | /p | Red | a-b<=0", "r4 | /p | Red | (a/b)<0.7", "r5 | /p | Red | 1min(dynamicity(b))+1min(dynamicity(f))>0",
       "r6 | /p | Red | dynamicity(b)==i", "r7 | /p | Red | 1min(a)>b", 'r8 | /p | Red | (a+b)=="x"', "r9 | /p | Red | s>b", 'm1 | /p | Red | a=="up"', "m2 | /p | Red | s>1",
       'c1 | /p | Red | (a>1) and (s=="up")', "c2 | /p | Red | (a>2) or (b==0)", 'c3 | /p | Red | (1min(s)!="up") and (b<2)', "c4 | /p | Red | (zz>1) or (a>2)", "c5 | /p | Red | (zz>1) and (a>2)",
       'c6 | /q | Red | (a>1) and (s=="up")', "c7 | /none | Red | a>1", "c8 | /p | Red | zz>0"])
MANY = 'd1 | /p | Red | (a>1) and (b>=0) and (s=="up") and (1min(a)<4) and (f!=9)\nd2 | /p | Red | (a>2) or (b==7) or (1min(b)!=1) or (s=="none") or (5min(a)!=9)'


def inputs(spark, hosts=3, ticks=45, seed=5):
    """The same random samples as wide rows and as one row each."""
    draw, wide, long = random.Random(seed), [], []
    for h in range(hosts):
        for t in range(ticks):
            row = [draw.choice(["up", "up", "up", "down", None] if m.vtype == "str" else [1.0, 2.0, 2.0, 3.0, 3.0, draw.choice([None, float("nan") if m.path == "/q" else 2.5])]) for m in LAYOUT]
            wide.append((f"h{h}" if h else None, t * NS, t, *row))
            long += [(wide[-1][0], m.path, m.entity, m.metric, t * NS, t, None if m.vtype == "str" else v, v if m.vtype == "str" else None, m.vtype, m.counter, "") for m, v in zip(LAYOUT, row)]
    columns = ", ".join(f"{m.column} {'string' if m.vtype == 'str' else 'double'}" for m in LAYOUT)
    return spark.createDataFrame(wide, StructType.fromDDL(f"host string, ts bigint, seq bigint, {columns}")), spark.createDataFrame(long, SAMPLES)


def hits(samples, clauses, **how):
    return sorted(map(str, rules.rule_hits(samples, clauses, **how).collect()))


@pytest.mark.parametrize("text", [RULES, MANY])
def test_wide_samples_give_the_hits_of_single_ones(spark, text):
    wide, long = inputs(spark)
    clauses = rules.clause_table(rules.rule_table(spark, text), samples_per_min=3)
    want = hits(long, clauses)
    assert hits(wide, clauses, layout=LAYOUT) == want != []
    assert hits(wide, clauses, layout=LAYOUT, chunk_rows=10) == want


def test_wide_samples_without_rules(spark):
    wide, _ = inputs(spark, hosts=1, ticks=3)
    assert hits(wide, rules.clause_table(rules.rule_table(spark, "bad | /p | Red | a*b>2")), layout=LAYOUT) == []
    assert hits(wide, rules.clause_table(rules.rule_table(spark, "other | /none | Red | a>2")), layout=LAYOUT) == []
    with pytest.raises(ValueError):
        hits(wide, rules.clause_table(rules.rule_table(spark)), layout=[*LAYOUT, LAYOUT[0]])


def test_samples_of_the_shipped_rules_are_no_rows(spark):
    """Before, 47 rows were made of every tick, and the windows were taken and the metrics gathered again per sample."""
    from trustloom.plans.rule_queries import shipped_rules_on_lineitem
    plan = shipped_rules_on_lineitem(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1 and plan.count("Repartition") == 1
