"""Every stage of the corpus pipeline against a plain version on its own input."""

import collections
import os
import random
import re
from urllib.parse import urlparse

import corpus_pipeline
import pytest
from test_operators import WORD, brute_components, brute_targets, make_texts
from tokenizers import Tokenizer

from trustloom.llm.packing import unpacked_ids, vocabulary_path
from trustloom.session import recorded, staged

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    draw = random.Random(4)
    texts = [((t or "") if len(t or "") < 5000 else t[:4000], s) for t, s in make_texts(seed=3, n=150)]
    prose = [(" ".join(draw.choice("the of and reason winter holding market under about several open".split()) + draw.choice(["", "s", "ed"])
                       for _ in range(draw.randrange(40, 90))), f"s{i % 4}") for i in range(250)]
    junk = [(" ".join(w + "###" for w in t.split()), s) for t, s in prose[:60]]
    rows = [(i, t, "en", s, len(t)) for i, (t, s) in enumerate(texts + prose + junk)]
    bad = set(range(len(texts) + len(prose), len(rows)))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(len(rows)) if i % 5], "doc_id bigint, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, docs, folder), name)
        out.append((name, docs.dtypes, docs.collect(), after.dtypes, after.collect()))
        docs = after
    return folder, bad, out


def test_order_and_columns(stages):
    names = [name for name, *_ in stages[2]]
    assert names == ["quality_classifier", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(before == after for _, before, _, after, _ in stages[2][:-1])


def test_quality_keeps_clean_rows(stages):
    _, _, before, _, after = stages[2][0]
    kept, bad = {r.doc_id for r in after}, stages[1]
    clean = {r.doc_id for r in before if r.doc_id not in bad}
    assert len(clean & kept) >= 0.98 * len(clean) and len(bad & kept) <= 0.05 * len(bad)
    assert set(after) <= set(before)


def test_exact(stages):
    _, _, before, _, after = stages[2][1]
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r)
    assert sorted(after) == sorted(first.values())


def test_near(stages):
    _, _, before, _, after = stages[2][2]
    ordered = sorted(before, key=lambda r: r.doc_id)
    _, roots = brute_components([(r.text, r.source) for r in ordered], 5, 80)
    assert sorted(after) == [r for i, r in enumerate(ordered) if roots[i] == i]


def test_mixing(stages):
    _, _, before, _, after = stages[2][3]
    sizes, taken = collections.defaultdict(int), collections.defaultdict(int)
    for r in before:
        sizes[r.source] += len(WORD.findall(r.text))
    for r in after:
        taken[r.source] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 64 for s in sizes)
    twice = collections.Counter(r.doc_id for r in after)
    assert max(twice.values()) <= 2
    for r in before:
        words = collections.Counter(WORD.findall(r.text))
        assert all(not collections.Counter(WORD.findall(a.text)) - words for a in after if a.doc_id == r.doc_id)


def test_packing(stages):
    _, _, before, _, after = stages[2][4]
    tokenizer = Tokenizer.from_file(vocabulary_path())
    want, got, fill = collections.Counter(), collections.Counter(), collections.defaultdict(int)
    for r in before:
        want[r.doc_id] += len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    for p in after:
        got[p.doc_id] += p.length
        fill[p.sequence_id] += p.length
    assert want == got and max(fill.values()) <= 2048 and sum(fill.values()) >= 0.9 * 2048 * (len(fill) - 1)


def test_sequences_can_be_rebuilt_from_the_last_table(stages):
    _, _, before, _, after = stages[2][4]
    tokenizer = Tokenizer.from_file(vocabulary_path())
    want, got, at = collections.Counter(), collections.Counter(), collections.defaultdict(dict)
    for r in before:
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
        want.update((r.doc_id, s, tuple(ids[s:s + 2048])) for s in range(0, len(ids), 2048))
    for p in after:
        ids = unpacked_ids(p.ids, vocabulary_path()).tolist()
        got[p.doc_id, p.start, tuple(ids)] += 1
        at[p.sequence_id][p.offset] = ids
    assert got == want and max(collections.Counter(d for d, s, _ in got.elements() if s == 0).values()) > 1
    for parts in at.values():
        sequence = [x for offset in sorted(parts) for x in parts[offset]]
        assert all(sequence[o:o + len(ids)] == ids for o, ids in parts.items())


def test_run_gives_the_same_pieces(spark, stages):
    rows = corpus_pipeline.run(spark, stages[0]).drop("sequence_id", "offset")
    def key(r):
        return r.doc_id, r.start, r.length, r.ids_crc32
    assert sorted(map(key, rows.collect())) == sorted(map(key, stages[2][-1][-1]))


def test_an_empty_table_goes_through_all_stages(spark, stages, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{stages[0]}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and "ids" in out.columns


def test_only_the_last_table_stays(spark, stages):
    with recorded() as tables:
        corpus_pipeline.run(spark, stages[0])
    assert len(tables) > 5 and [os.path.isdir(urlparse(t).path) for t in tables] == [False] * (len(tables) - 1) + [True]
