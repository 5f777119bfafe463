"""Rules against plain loops over random series, and the grammar of rule texts."""

import random

from trustloom.operators import rules

SAMPLES = "host string, path string, entity string, metric string, ts bigint, seq bigint, v_num double, v_str string, vtype string, counter int, unit string"


def series(seed=3):
    draw = random.Random(seed)
    rows = []
    for host in ("h1", "h2"):
        for t in range(40):
            rows.append((host, "/p", "", "a", t, t, draw.choice([1.0, 2.0, 3.0, None]), None, "float", 0, ""))
            rows.append((host, "/p", "", "b", t, t, float(draw.randint(0, 2)), None, "int", 1, ""))
            rows.append((host, "/p", "", "s", t, t, None, draw.choice(["up", "down"]), "str", 0, ""))
    return rows


def fired(spark, text, rows=None, **cut):
    clauses = rules.clause_table(rules.rule_table(spark, text), samples_per_min=3)
    hits = rules.rule_hits(spark.createDataFrame(rows or series(), SAMPLES), clauses, **cut)
    return sorted((r["name"], r["host"], r["ts"]) for r in hits.collect())


def test_sustained_comparisons(spark):
    tests = {"<": lambda v: v < 3, "<=": lambda v: v <= 2, ">": lambda v: v > 1, ">=": lambda v: v >= 2, "==": lambda v: v == 2, "!=": lambda v: v != 2}
    limit = {"<": 3, "<=": 2, ">": 1, ">=": 2, "==": 2, "!=": 2}
    text = "\n".join([f"{op} | /p | Red | 1min(a){op}{limit[op]}" for op in tests] + ['up | /p | Red | 1min(s)=="up"', 'not up | /p | Red | 1min(s)!="up"'])
    rows, want = series(), []
    for host in ("h1", "h2"):
        a = [r[6] for r in rows if r[0] == host and r[3] == "a"]
        s = [r[7] for r in rows if r[0] == host and r[3] == "s"]
        for t in range(2, 40):
            want += [(op, host, t) for op, test in tests.items() if all(v is not None and test(v) for v in a[t - 2:t + 1])]
            want += [("up", host, t)] * all(v == "up" for v in s[t - 2:t + 1]) + [("not up", host, t)] * all(v != "up" for v in s[t - 2:t + 1])
    assert fired(spark, text) == sorted(want)


def test_rules_of_several_metrics(spark):
    text = """
    both | /p | Red | (a>1) and (s=="up")
    any | /p | Red | (a>2) or (b==0)
    sum | /p | Red | (a+b)>3
    pair | /p | Red | a>b
    held | /p | Red | (1min(s)!="up") and (b<2)
    """
    rows, want = series(), []
    for host in ("h1", "h2"):
        a, b, s = ([r[6] if m != "s" else r[7] for r in rows if r[0] == host and r[3] == m] for m in "abs")
        for t in range(40):
            known = a[t] is not None
            want += [("both", host, t)] * (known and a[t] > 1 and s[t] == "up") + [("any", host, t)] * (known and a[t] > 2 or b[t] == 0)
            want += [("sum", host, t)] * (known and a[t] + b[t] > 3) + [("pair", host, t)] * (known and a[t] > b[t])
            want += [("held", host, t)] * (t >= 2 and all(v != "up" for v in s[t - 2:t + 1]) and b[t] < 2)
    assert fired(spark, text) == sorted(want)


def test_cut_series_give_the_same_hits(spark):
    rows = [(*r[:4], r[4] * 3600 * 10**9 // 4, *r[5:]) for r in series()]
    text = "a | /p | Red | 1min(a)!=2\nb | /p | Red | 1min(dynamicity(b))>0\nc | /p | Red | (1min(s)==\"up\") or (a>2)"
    assert fired(spark, text, rows) == fired(spark, text, rows, chunk_rows=10) != []


def test_grammar(spark):
    sound = ["a>1", "(a>1)", "((a>1))", "(a)>1", "(a/b)>1", "1min(a)>1", "dynamicity(a)>1", "1min(dynamicity(a))>1", "(1min(dynamicity(a)))>1", "a>=b",
             "(a+b)>=1", "1min(dynamicity(a))+1min(dynamicity(b))>2", "(a>1) or (b>2) or (s==\"x\")"]
    refused = ["dynamicity(a>2", "dynamicity(a>2)", "a*b>2", "(a>1", "a)>1", "a>1)", "1min(a>1", "max(a)>1", "a", "a//b>1", "a%b>1", "(a>1) and (b>2) or (a>3)",
               "1min(dynamicity(a)>1", "a>1 and zombie", "((a)>1"]
    text = "\n".join(f"{i} | /p | Red | {rule}" for i, rule in enumerate(sound + refused))
    got = {int(r["name"]): r["valid"] for r in rules.clause_table(rules.rule_table(spark, text)).select("name", "valid").distinct().collect()}
    assert [i for i in range(len(sound)) if not got[i]] == [] and [rule for i, rule in enumerate(refused, len(sound)) if got[i]] == []


def test_refused_rules_give_no_rows(spark):
    assert fired(spark, "bad | /p | Red | a*b>2") == []
    assert fired(spark, "unknown | /p | Purple | a>2") == []
