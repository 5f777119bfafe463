"""Operators of the training-data subpackage against brute force on small tables with odd rows."""

import collections
import heapq
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F


from trustloom.llm import additive, exact, forest, lines, mixing, near, packing, secrets, sharding, stats, substrings, words
from trustloom.llm.components import components, forest_roots

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Extra columns have names that the operators use themselves.
SCHEMA = "doc_id bigint, text string, source string, doc string, size int, shard int, rid int, id string, mark int, n int"


def rows_of(texts):
    return [(i, t, s, "x", 1, 2, 3, "y", 4, 5) for i, (t, s) in enumerate(texts)]


def make_texts(seed=0, n=120):
    draw = random.Random(seed)
    vocabulary = [w + e for w in "the of and in Zeta ünder Straße 漢字 token be or not lines ore ran".split() for e in ("", "er", ".", "!")]

    def prose(k):
        out = [draw.choice(vocabulary) for _ in range(k)]
        return " ".join(w + ("\n" if draw.random() < 0.08 else "") for w in out)
    passage, line = prose(60), "A Line that many Documents share, word for word"
    out = []
    for i in range(n):
        text = prose(draw.choice([0, 1, 2, 5, 30, 90, 200]))
        if i % 5 == 0:
            text = text + "\n" + line.upper() + " \n" + text[:20]
        if i % 7 == 0:
            text = text + " " + passage + " " + prose(3)
        if i % 11 == 0 and out:
            text = (out[-1][0] or "").replace("  ", " \t\n")
        if i % 13 == 0 and out:
            text = (out[0][0] or "") + " end"
        out.append((text, f"s{i % 4}" if i % 9 else None))
    return out + [(None, "s1"), ("", "s2"), ("   \n\t", None), ("x" * 5000, "s1"), (prose(6000), "s0"), (out[3][0], "s3")]


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows and repeated ids."""
    texts = [("same text of words", "a")] * 3 + [(None, None)] * 2 + [("other words here", "a")]
    rows = rows_of(texts) + rows_of(texts)[:2]
    rows = [(None if i in (1, 5) else r[0], *r[1:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_arrays():
    texts = ["a b", "", None, " c", "d", "é 漢字\n", "x"]
    data, offsets = words.text_bytes(pa.array(texts))
    first, last, borders = words.word_bounds(data, offsets)
    found = [bytes(data[a:b]).decode() for a, b in zip(first, last)]
    assert found == [w for t in texts for w in WORD.findall(t or "")]
    assert np.diff(borders).tolist() == [len(WORD.findall(t or "")) for t in texts]
    h = words.word_hashes(data, first, last)
    assert len(set(h.tolist())) == len(set(found))
    twice = np.concatenate([h, h])
    windows = words.window_hashes(twice, 3)
    assert (windows[:len(h) - 2] == windows[len(h):]).all()
    assert [len(b) for b in (words.window_hashes(h[:2], 3), words.window_hashes(h[:3], 3))] == [0, 1]


def test_exact(spark, docs, texts, odd, empty):
    found = {r.doc.doc_id: r for r in exact.exact_groups(docs, first_bytes=2, growth=2).collect()}
    groups = collections.defaultdict(list)
    for i, (t, _) in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    for members in groups.values():
        for i in members:
            assert (found[i].keep_id, found[i].group_size, found[i].kept) == (min(members), len(members), i == min(members))
    kept = exact.exact_dedup(docs)
    assert kept.dtypes == docs.dtypes and kept.count() == len(groups)
    assert exact.exact_dedup(odd).count() == 3
    assert exact.exact_dedup(odd).filter("text is not null and text like 'same%'").first().doc_id == 0
    assert exact.exact_dedup(empty).count() == 0


def brute_components(texts, size, percent):
    sets = []
    for t, _ in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[j:j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sets, [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("block", [256, 4])
def test_near(docs, texts, odd, empty, block, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", block)
    sets, want = brute_components(texts, 3, 85)
    found = {r.id: r for r in near.near_components(docs, 3, 85).collect()}
    for i, root in enumerate(want):
        assert (found[i].n_shingles, found[i].component_id, found[i].kept) == (len(sets[i]), root, root == i)
    if block == 256:
        kept = near.near_dedup(docs, 3, 85)
        assert kept.dtypes == docs.dtypes and kept.count() == len(set(want))
        assert near.near_components(odd).filter("kept").count() == 4  # two null texts stand alone
        assert near.near_dedup(empty).count() == 0


def test_bayes_bounds_keep_similar_pairs():
    rule = near.NearRule(5, 80)
    assert 1 - (1 - 0.8 ** near.BAND_ROWS) ** rule.bands >= 1 - near.MISS
    for n, least in rule.least_matches():
        draws = np.random.default_rng(1).binomial(n, 0.8, 20_000)
        assert 0.3 * n < least and (draws < least).mean() < 1e-3


def test_components(spark):
    draw = random.Random(3)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint").repartition(5)).collect()}
    a, b = np.array([x for x in links if x[0] != x[1]]).T
    assert found == dict(zip(*(x.tolist() for x in forest_roots(a, b))))


def test_lines(docs, texts, odd, empty):
    found = {r.doc.doc_id: r for r in lines.line_dedup(docs).collect()}
    key = lambda line: line.strip("\x20\x09\n\x0B\x0C\r").translate(LOWER)
    holders = collections.defaultdict(set)
    for i, (t, _) in enumerate(texts):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    for i, (t, _) in enumerate(texts):
        split = (t or "").split("\n")
        keep = [x for x in split if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i]
        assert (found[i].n_lines, found[i].n_dropped, found[i].kept_text) == (len(split), len(split) - len(keep), "\n".join(keep))
    assert lines.line_dedup(odd).count() == odd.count() and lines.line_dedup(empty).count() == 0


def test_perfect_hash_is_minimal():
    draw = np.random.default_rng(5)
    for n in (1, 2, 7, 1000, 20_000):
        h1, h2 = (draw.integers(0, 1 << 64, n, dtype=np.uint64) for _ in range(2))
        assert sorted(lines.slots_of(h1, h2, lines.perfect_hash(h1, h2), n).tolist()) == list(range(n))


@pytest.mark.parametrize("cell_bytes", [1 << 22, 3000])
def test_substrings(docs, texts, odd, empty, cell_bytes, monkeypatch):
    monkeypatch.setattr(substrings, "CELL_BYTES", cell_bytes)
    split = [WORD.findall(t or "") for t, _ in texts]
    count = collections.Counter(tuple(w[j:j + 35]) for w in split for j in range(len(w) - 34))
    found = {r.doc.doc_id: r for r in substrings.substring_dedup(docs).collect()}
    for i, w in enumerate(split):
        gone = set()
        for j in range(len(w) - 34):
            if count[tuple(w[j:j + 35])] > 1:
                gone.update(range(j, j + 35))
        assert found[i].kept_text == " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (found[i].n_words, found[i].n_removed) == (len(w), len(gone))
    if cell_bytes > 3000:
        assert substrings.substring_dedup(odd, window=3).agg(F.sum("n_removed")).first()[0] == 4 * 4 + 4
        assert substrings.substring_dedup(empty).count() == 0


def brute_targets(sizes, factor=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, total = set(), factor * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def test_buckets_stay_below_the_limit():
    cells = [-(-size // substrings.CELL_BYTES) for size in (0, 10**9, 10**12, 10**14, 10**16)]
    assert [substrings.bucket_count(c, 200) for c in cells] == [200, 200, 50_000, 50_000, 50_000] and substrings.bucket_count(1, 10**6) == 50_000


def test_no_table_stays_in_the_catalogue(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    assert substrings.substring_dedup(docs).count() == docs.count() and {t.name for t in spark.catalog.listTables()} == before


def test_mixing(docs, texts, odd, empty):
    sizes = collections.defaultdict(int)
    for t, s in texts:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    got = mixing.mixed_sources(docs, block_tokens=8, shard_tokens=1000).collect()
    taken = collections.defaultdict(int)
    for r in got:
        i = r.doc.doc_id
        assert r.size == len(WORD.findall(texts[i][0] or "")) and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(want[texts[i][1]]) and r.source_size == sizes[texts[i][1]]
        taken[texts[i][1]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 8 * 4 for s in sizes)
    again = {r.doc.doc_id: r.taken for r in mixing.mixed_sources(docs.repartition(7), block_tokens=8, shard_tokens=1000).collect()}
    assert again == {r.doc.doc_id: r.taken for r in got}
    emitted = mixing.mixed_texts(docs, block_tokens=8, shard_tokens=1000)
    assert emitted.columns == docs.columns
    per_doc = collections.defaultdict(int)
    for r in emitted.collect():
        w, whole = WORD.findall(r.text), WORD.findall(texts[r.doc_id][0])
        per_doc[r.doc_id] += len(w)
        assert not collections.Counter(w) - collections.Counter(whole)
    assert all(per_doc[r.doc.doc_id] == r.taken for r in got)
    assert mixing.mixed_sources(odd).count() == odd.count() and mixing.mixed_texts(empty).count() == 0


def test_quotas_are_the_highest_quotients(spark):
    draw = random.Random(4)
    rows = []
    for i in range(400):
        size, blocks = draw.choice([1, 64]), draw.choice([1, 3, 40, 900])
        rows.append((i, 0, size, blocks, blocks * draw.choice([0.0, 0.3, 1.0, 1.0, 2.0]) * (1 + mixing.TIE_SHARE * draw.random()), 2 * blocks))
    parties = spark.createDataFrame(rows, "place bigint, shard bigint, block int, blocks bigint, votes double, most bigint").repartition(3)
    got = {r.place: r.quota for r in mixing.quotas(parties).collect()}
    for size in (1, 64):
        own = [r for r in rows if r[2] == size]
        house = int(sum(r[4] for r in own) / (1 + mixing.TIE_SHARE / 2) + 0.5)
        heap = [(-r[4] / 0.5, r[0], 0, r) for r in own]
        heapq.heapify(heap)
        want = collections.Counter()
        for _ in range(house):
            _, i, k, r = heapq.heappop(heap)
            want[i] += 1
            if k + 1 < r[5]:
                heapq.heappush(heap, (-r[4] / (k + 1.5), i, k + 1, r))
        assert {r[0]: got[r[0]] for r in own} == {r[0]: want[r[0]] for r in own}


def test_many_tiny_sources_are_near_their_targets(spark):
    draw = random.Random(6)
    texts = [("w " * draw.randint(*((40, 60) if i % 2 else (5, 25))), f"s{i:05}") for i in range(2_000)]
    rows = mixing.mixed_sources(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()
    assert abs(sum(r.taken for r in rows) / sum(r.target for r in rows) - 1) < 0.001
    assert all(abs(r.taken - r.target) <= max(1, r.target / 8) and r.taken <= 2 * r.size for r in rows)


def test_secrets(spark, empty):
    long_key, access = "Abc" + "k9" * 12, "AKIA" + "Q" * 16
    texts = ["password = 'hunter22' token=ab secret=token:abcdefgh", f"é漢 {access} and {access[:18]}", "deadbeef" * 3 + " x " + "deadbeef" * 2, None, "",
             f"user: someone1 then {long_key} at https://db.example.org/x", f"only {long_key} here", f"user: someone1\n\n{long_key}",
             "see https://db.example.org/x", f"login=abcd {'pad ' * 200}{long_key}", "PASSWORD:" + long_key]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = {r.id: r for r in secrets.secret_spans(frame).collect()}
    base = {i: [(s.rank, s.start, s.stop) for s in found[i].base] for i in found}
    linked = {i: {s.rank: texts[i][s.start:s.stop] for s in found[i].linked} for i in found}
    assert [texts[0][s:e] for _, s, e in base[0]] == ["password = 'hunter22"]  # secret=token is a failing match that uses up "token"
    assert [(k, texts[1][s:e]) for k, s, e in base[1]] == [(1, access)]
    assert [(k, texts[2][s:e]) for k, s, e in base[2]] == [(2, "deadbeef" * 3)]
    assert base[3] == base[4] == [] and base[10] == [(0, 0, 9 + len(long_key))]
    assert linked[5] == {3: "user: someone1", 4: long_key, 5: "https://db.example.org"}
    assert all(not linked[i] for i in (0, 1, 2, 3, 4, 6, 7, 8, 9, 10))
    assert secrets.secret_spans(empty).count() == 0


def test_query_links_secrets_over_the_whole_scope(spark, tmp_path):
    key = "aB3" + "xY9z" * 6
    texts = [f"login=abcd {'pad ' * 900}{key} {'pad ' * 900}https://db.example.org/x", f"login=abcd\n\n{'pad ' * 9}{key}", f"only {key}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.spans for r in secrets.op6_linked_secrets(spark, str(tmp_path)).collect()}
    assert [s.split(":")[0] for s in found[0].split(",")] == ["linked_identifier", "linked_key", "linked_endpoint"]
    assert found[1] == found[2] == ""


def test_packing(spark, docs, texts, odd, empty):
    path = packing.vocabulary_path()
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, (t, _) in enumerate(texts)}
    pieces = [Row(**{**p.asDict(), "ids": packing.unpacked_ids(p.ids, path).tolist()}) for p in packing.packed(docs, path, with_ids=True).collect()]
    back, held = collections.defaultdict(dict), collections.defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) <= 2048 and p.doc_tokens == len(want[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        back[p.doc_id][p.start] = p.ids
        held[p.sequence_id].append((p.offset, p.length))
    assert {i: [x for s in sorted(b) for x in b[s]] for i, b in back.items()} == want
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert sorted(held) == list(range(len(held)))
    assert packing.packed(odd, path).count() == odd.count() and packing.packed(empty, path).count() == 0
    assert packing.packed(empty, path, with_ids=True).collect() == []


def test_word_encoder_follows_the_tokenizer():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    odd = ["a<|endoftext|>b", "it's  we'LL §x y§", "é ́x ΑΣ ΑΣΑ 'S", "İstanbul 'sfoo", "", "  ", "\x1c a\x85b", "y" * 300, "a\x00b  c"]
    ids, borders = packing.WordEncoder(packing.vocabulary_path()).encode(pa.array(odd))
    assert [ids[a:b].tolist() for a, b in zip(borders[:-1], borders[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in odd]


def test_column_generation_is_near_the_bound():
    draw = np.random.default_rng(7)
    units, counts = np.arange(1, 129), draw.integers(0, 60, 128) + 1
    runs = packing.pattern_places(units, counts, 128)
    fill, at = collections.defaultdict(int), 0
    for unit, count in zip(units.tolist(), counts.tolist()):
        own = runs["unit"] == unit
        starts, first, per = runs["rank"][own], runs["sequence"][own], runs["per"][own]
        for k in range(count):
            r = np.searchsorted(starts, k, side="right") - 1
            fill[int(first[r] + (k - starts[r]) // per[r])] += unit
    assert max(fill.values()) <= 128 and sorted(fill) == list(range(len(fill)))
    assert len(fill) <= 1.02 * (units * counts).sum() / 128 + 5


def test_text_stats(texts):
    column = pa.array([t for t, _ in texts])
    found = stats.text_stats(*words.text_bytes(column))
    for i, (t, _) in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[j:j + 8]) for j in range(len(w) - 7)]
        count, covered, seen, dup = collections.Counter(windows), set(), set(), 0
        for j, x in enumerate(windows):
            if count[x] > 1:
                covered.update(range(j, j + 8))
        for line in t.split("\n"):
            dup += bool(WORD.search(line)) and line in seen
            seen.add(line)
        want = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": dup,
                "n_repeat_words": len(covered), "n_distinct": len(set(w)), "n_pairs": len(set(zip(w, w[1:]))), "n_echo": sum(a == b for a, b in zip(w, w[1:]))}
        assert {k: int(found[k][i]) for k in want} == want


def labelled(spark, n=600):
    draw = random.Random(11)
    rows, marks = [], []
    for i in range(n):
        good = draw.random() < 0.9
        w = [draw.choice("the of and reason winter holding market under about several open".split()) + draw.choice(["", "s", "ed", "ing"]) for _ in range(draw.randrange(40, 120))]
        if not good:
            w = [x + draw.choice(["###", "&&&", "$$$"]) for x in w] if i % 2 else [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "s", "x", 1, 2, 3, "y", 4, 5))
        marks.append((i, int(good)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks + [(None, 1), (3, None)], "doc_id bigint, quality int"), dict(marks)


def test_quality_rules(spark, odd, empty):
    frame, labels, marks = labelled(spark)
    found = forest.quality_rules(frame, labels).collect()
    judged = [(r.kept, marks[r.doc_id]) for r in found if not r.base_failed]
    assert sum(k for k, m in judged if m) >= 0.98 * sum(m for _, m in judged)
    assert sum(not k for k, m in judged if not m) >= 0.5 * sum(not m for _, m in judged)
    none = labels.limit(0)
    assert all(r.kept != r.base_failed for r in forest.quality_rules(frame, none).collect())
    assert forest.quality_rules(odd, labels).filter("kept").count() == 0 and forest.quality_rules(empty, labels).count() == 0


def plain_threshold(rows, most_lost=forest.MOST_GOOD_LOST):
    n_good, n_bad = sum(g for _, g in rows), sum(not g for _, g in rows)
    levels = sorted({a for a, _ in rows}, reverse=True)
    best, limit = 0.0, float("inf")
    for i, a in enumerate(levels):
        lost, caught = sum(g and x >= a for x, g in rows) / n_good, sum(not g and x >= a for x, g in rows) / n_bad
        if lost <= most_lost and caught - lost > best:
            best, limit = caught - lost, (a + levels[i + 1]) / 2 if i + 1 < len(levels) else a
    return limit


def test_threshold_of_anomalies_counts_all_labelled_rows(spark):
    frame, labels, marks = labelled(spark)
    found = forest.quality_rules(frame, labels, model_rows=40).collect()
    rows = [(r.anomaly, bool(marks[r.doc_id])) for r in found if not r.base_failed]
    limit = plain_threshold(rows)
    assert len(rows) > 400 and limit < 1
    assert all(r.kept == (not r.base_failed and r.anomaly < limit) for r in found)


def test_threshold_equals_the_plain_one(spark):
    draw = random.Random(5)
    for case in range(3):
        rows = [(draw.randrange(60) / 60 if case else draw.random(), draw.random() < 0.8) for _ in range(500)]
        rows = [(a if g else min(1.0, a + 0.3), g) for a, g in rows]
        got = forest.calibrated(spark.createDataFrame(rows, "anomaly double, good boolean"), 0.05)
        assert got == plain_threshold(rows, 0.05)
    one_kind = spark.createDataFrame([(0.5, True), (0.7, True)], "anomaly double, good boolean")
    assert forest.calibrated(one_kind) == float("inf") == forest.calibrated(one_kind.limit(0))


def test_quality_classifier(spark, odd, empty):
    frame, labels, marks = labelled(spark)
    found = additive.quality_scores(frame, labels).collect()
    unseen = [(r.predicted, marks[r.doc_id]) for r in found if r.held_out]
    assert {r.doc_id for r in found if r.held_out} == {i for i in marks if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([p == m for p, m in unseen]) >= 0.95 and all(0 <= r.score <= 1 for r in found)
    kept = additive.accepted(frame, labels)
    assert kept.dtypes == frame.dtypes and {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.predicted}
    assert additive.quality_scores(odd, labels).count() == odd.count() and additive.accepted(empty, labels).count() == 0
    assert {r.score for r in additive.quality_scores(odd, labels.limit(0)).collect()} == {0.5}


def test_sharding(docs, texts, odd, empty):
    found = sharding.best_fit_shards(docs, shards=5).collect()
    load, slots, where = collections.defaultdict(int), collections.defaultdict(list), collections.defaultdict(set)
    for r in found:
        text = texts[r.doc_id][0] or ""
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    heaviest = max(len(t or "") for t, _ in texts)
    assert max(load.values()) <= max(1.05 * sum(load.values()) / 5, 2 * heaviest)
    split = sharding.best_fit_shards(odd, shards=4)  # one group holds most: it is dealt out
    assert split.select("shard").distinct().count() >= 3 and split.count() == odd.count()
    assert sharding.best_fit_shards(empty).count() == 0


def test_best_fit_decreasing_matches_the_plain_rule():
    draw = random.Random(2)
    for _ in range(30):
        sizes = sorted((draw.randrange(1, 60) for _ in range(draw.randrange(1, 80))), reverse=True)
        bins = []
        for s in sizes:
            fit = [b for b in bins if b >= s]
            if fit:
                bins.remove(min(fit))
                bins.append(min(fit) - s)
            else:
                bins.append(100 - s)
        count = collections.Counter(sizes)
        order = np.array(sorted(count, reverse=True))
        runs, opened = sharding.best_fit_decreasing(order, np.array([count[s] for s in order.tolist()]), 100)
        assert opened == len(bins)
        left = collections.Counter()
        for k, s in enumerate(sizes):
            r = np.searchsorted(runs[:, 0], k, side="right") - 1
            left[int(runs[r, 1] + (k - runs[r, 0]) // runs[r, 2])] += s
        assert sorted(100 - v for v in left.values()) == sorted(bins)


def test_digest_columns(spark):
    import __spark_entry__ as entry
    folder = "/root/testdata/sf0.001"
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"]
    assert len(names) == 14
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name in ("op2_line_dedup", "op4_substring_dedup", "op6_linked_secrets"):
        rows = entry.queries()[name](spark, folder).collect()
        digest = "base_sha256" if name.startswith("op6") else "kept_sha256"
        assert len(rows) == docs and all(re.fullmatch("[0-9a-f]{64}", r[digest]) for r in rows)
