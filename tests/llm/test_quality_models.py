"""The quality models against plain loops: boosted tables, scores as sums of table entries, path lengths of trees."""

import bisect
import math
import random

import numpy as np

from trustloom.llm import additive, forest

SCHEMA = "doc_id bigint, text string, ratios string, score int, quality int, held_out string"


def plain_leaves(g, h, splits):
    """Steps per bin of the tree that is cut where it gains most, cut by cut."""
    def worth(a, b):
        return sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1.0)
    parts = [(0, len(g))]
    for _ in range(splits):
        cuts = [(worth(a, c) + worth(c, b) - worth(a, b), -a, c, a, b) for a, b in parts for c in range(a + 1, b)]
        if not cuts or max(cuts)[0] <= 1e-9:
            break
        most = max(cuts)[0]
        _, _, c, a, b = min((x for x in cuts if x[0] >= most - 1e-12), key=lambda x: (x[3], x[2]))
        parts.remove((a, b))
        parts += [(a, c), (c, b)]
    return [next(sum(g[a:b]) / (sum(h[a:b]) + 1.0) for a, b in parts if a <= i < b) for i in range(len(g))]


def plain_square(g, h):
    """Steps per cell: one cut of the rows, then one of the columns on each side."""
    def worth(x, y):
        return x * x / (y + 1.0)
    best, step = 1e-15, [[0.0] * len(g[0]) for _ in g]
    whole = worth(sum(map(sum, g)), sum(map(sum, h)))
    for at in range(1, len(g)):
        gain, table = -whole, [[0.0] * len(g[0]) for _ in g]
        for rows in (range(at), range(at, len(g))):
            gs, hs = ([sum(m[r][c] for r in rows) for c in range(len(g[0]))] for m in (g, h))
            cuts = [(worth(sum(gs[:c]), sum(hs[:c])) + worth(sum(gs[c:]), sum(hs[c:])), -c) for c in range(1, len(gs))]
            most = max(cuts, default=(worth(sum(gs), sum(hs)), 0))
            cut = -most[1]
            gain += most[0]
            for r in rows:
                for c in range(len(gs)):
                    own = slice(0, cut) if c < cut else slice(cut, None)
                    table[r][c] = sum(gs[own]) / (sum(hs[own]) + 1.0)
        if gain > best:
            best, step = gain, table
    return step


def test_boosted_tables_equal_plain_loops():
    draw = random.Random(3)
    rows = [[draw.choice([0.0, 0.1, 0.4, draw.random()]), draw.random(), draw.choice([1.0, 2.0])] for _ in range(120)]
    good = [r[0] + r[1] * (r[2] == 1.0) + draw.gauss(0, 0.2) > 0.5 for r in rows]
    model = additive.fit_additive(np.array(rows), np.array(good), rounds=4, pair_rounds=3, rate=0.3)
    base = math.log(sum(good) / (len(good) - sum(good)))
    assert abs(model.base - base) < 1e-12
    bins = [[bisect.bisect_right(model.edges[f].tolist(), r[f]) for r in rows] for f in range(3)]
    cells = [[bisect.bisect_right(model.coarse[f].tolist(), r[f]) for r in rows] for f in range(3)]
    tables = [[0.0] * (len(e) + 1) for e in model.edges]
    squares = [[[0.0] * (len(model.coarse[g]) + 1) for _ in range(len(model.coarse[f]) + 1)] for f, g, _ in model.pairs]
    total = [base] * len(rows)

    def slopes():
        p = [1 / (1 + math.exp(-t)) for t in total]
        return [y - q for y, q in zip(good, p)], [q * (1 - q) for q in p]
    for _ in range(4):
        for f in range(3):
            slope, curve = slopes()
            g, h = ([sum(v for v, b in zip(values, bins[f]) if b == i) for i in range(len(tables[f]))] for values in (slope, curve))
            for i, step in enumerate(plain_leaves(g, h, 2)):
                tables[f][i] += 0.3 * step
                for r, b in enumerate(bins[f]):
                    total[r] += 0.3 * step * (b == i)
    for f in range(3):
        assert np.allclose(model.tables[f], tables[f], atol=1e-9)
    for _ in range(3):
        for (f, g_, _), table in zip(model.pairs, squares):
            slope, curve = slopes()
            g, h = ([[sum(v for v, a, b in zip(values, cells[f], cells[g_]) if (a, b) == (i, j)) for j in range(len(table[0]))] for i in range(len(table))]
                    for values in (slope, curve))
            step = plain_square(g, h)
            for i in range(len(table)):
                for j in range(len(table[0])):
                    table[i][j] += 0.3 * step[i][j]
            for r in range(len(rows)):
                total[r] += 0.3 * step[cells[f][r]][cells[g_][r]]
    assert model.pairs and all(np.allclose(t, own, atol=1e-9) for (_, _, t), own in zip(model.pairs, squares))
    assert np.allclose(model.scores(np.array(rows)), [1 / (1 + math.exp(-t)) for t in total], atol=1e-9)


def test_scores_are_sums_of_table_entries():
    draw = np.random.default_rng(4)
    model = additive.fit_additive(draw.random((200, 4)), draw.random(200) < 0.6, rounds=6, pair_rounds=2)
    fresh = draw.random((80, 4)) * 1.4 - 0.2
    for row, score in zip(fresh, model.scores(fresh)):
        total = model.base + sum(t[bisect.bisect_right(e.tolist(), x)] for e, t, x in zip(model.edges, model.tables, row))
        total += sum(t[bisect.bisect_right(model.coarse[f].tolist(), row[f]), bisect.bisect_right(model.coarse[g].tolist(), row[g])] for f, g, t in model.pairs)
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-12


def test_path_lengths_are_walks_down_the_trees():
    draw = np.random.default_rng(5)
    rows = np.concatenate([draw.normal(size=(300, 3)), [[9.0, 9.0, 9.0]], np.zeros((40, 3))])
    grown = forest.grow_forest(rows, trees=25, subsample=64, seed=1)
    h = [0.0, 0.0, *[2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n for n in range(2, 65)]]
    assert abs(grown.typical - h[64]) < 1e-12
    for row, score in zip(rows, grown.scores(rows)):
        lengths = []
        for feature, value, length in zip(grown.feature, grown.value, grown.length):
            node, steps = 0, 0
            while feature[node] >= 0:
                node, steps = 2 * node + 1 + int(row[feature[node]] >= value[node]), steps + 1
            # A leaf adds what the rows it kept would still need: a whole number of rows.
            assert min(abs(length[node] - steps - more) for more in h) < 1e-9
            lengths.append(length[node])
        assert abs(score - 2 ** (-np.mean(lengths) / grown.typical)) < 1e-12
    assert grown.scores(rows[300:301])[0] > np.quantile(grown.scores(rows[:300]), 0.95)


def test_very_long_texts_are_scored(spark):
    words = "the of and reason winter holding market under about several open".split()
    long = " ".join(words[i % 11] + str(i % 97) for i in range(400_000))
    rows = [(1, long, "x", 1, 2, "y"), (2, "w" * 2_000_000, "x", 1, 2, "y"), (3, None, "x", 1, 2, "y"), (4, "", "x", 1, 2, "y"), (None, long, "x", 1, 2, "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id bigint, quality int")
    scores = additive.quality_scores(docs, labels).collect()
    assert len(scores) == 5 and all(0 <= r.score <= 1 for r in scores)
    found = {r.doc_id: r for r in forest.quality_rules(docs, labels).collect()}
    assert (found[1].n_words, found[2].n_words, found[3].n_words, found[4].n_words) == (400_000, 1, 0, 0) and found[1].base_failed
