"""Every stage of the pipeline against a plain version of its rule, on whole small tables."""

import random
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from discloom.llm import decontaminate, mixing
from discloom.llm.decontaminate import normal

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i] * (len(text) + 1)
        for j, d in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
    return min(row)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Good documents with copies, near copies and benchmark items, and bad ones."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    sentence = lambda n: " ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    items = [(i, sentence(9)) for i in range(6)]
    rows, labels = [], []

    def add(text, quality, source="s0"):
        rows.append((len(rows), text, "en", source, len(text or "")))
        if rng.random() < 0.7:
            labels.append((len(rows) - 1, quality, 0))

    for i in range(160):
        add(sentence(rng.randint(20, 60)), 1, f"s{i % 3}")
    for i in range(60):
        add(" ".join([word().upper()] * 30) + "!!!", 0, f"s{i % 3}")
    for i in range(15):
        add(rows[i][1], 1)
        changed = rows[i][1].split() + [word()]
        add(" ".join(changed), 1, "s1")
    for i in range(12):
        item = list(items[i % 6][1])
        item[3] = "#"
        add(sentence(15) + " " + "".join(item) + "\n" + sentence(15), 1)
    rows += [(len(rows), None, None, None, None), (len(rows) + 1, "", "en", "s0", 0)]
    folder = tmp_path_factory.mktemp("tables")
    for name, data, schema in (("documents", rows, SCHEMA), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(data, schema).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder), rows, items


@pytest.fixture(scope="module")
def stages(spark, tables):
    """What each stage gets and gives."""
    folder, rows, _ = tables
    docs, out = spark.createDataFrame(rows, SCHEMA), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        out[name] = ({r.doc_id: r for r in docs.collect()}, after.collect())
        docs = spark.createDataFrame(out[name][1], after.schema)
        if name != "sharding":
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def test_the_classifier_rejects_bad_documents_and_keeps_good_ones(stages):
    before, after = stages["quality"]
    kept = {r.doc_id for r in after}
    shouted = {i for i, r in before.items() if r.text and r.text.endswith("!!!")}
    assert not kept & shouted
    assert len({i for i, r in before.items() if r.text and i not in shouted} - kept) <= 2


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near-duplicates"]
    root = {i: i for i in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {}
    for i, r in before.items():
        w = (r.text or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    for a in before:
        for b in before:
            if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in after) == sorted({find(i) for i in before}) and len(after) < len(before)


def test_documents_with_benchmark_items_go(stages, tables):
    before, after = stages["decontamination"]
    items = [normal(t) for _, t in tables[2]]
    held = {i for i, r in before.items() if r.text and any(least_edits(x, normal(r.text)) <= int(len(x) * decontaminate.RATE) for x in items)}
    assert len(held) >= 8 and {r.doc_id for r in after} == set(before) - held


def test_mixing_and_sharding_keep_every_row(stages):
    before, after = stages["mixing"]
    assert sorted(after) == sorted(before.values()) and [r.doc_id for r in after] != sorted(before)
    before, after = stages["sharding"]
    assert sorted((r[:5] for r in after), key=str) == sorted((tuple(r) for r in before.values()), key=str)
    homes, sizes = defaultdict(set), defaultdict(int)
    for r in after:
        homes[r.text].add(r.shard)
        sizes[r.shard] += len((r.text or "").encode()) + 1
    assert all(len(x) == 1 for x in homes.values()) and set(sizes) <= set(range(16))
    assert max(sizes.values()) - min(sizes.values()) <= 200


def test_shards_are_in_the_order_of_the_mixture(spark, tables, stages, tmp_path):
    before, after = stages["sharding"]
    plan = mixing.mix(spark.createDataFrame(list(before.values()), SCHEMA)).orderBy("slot", "in_block").collect()
    nth = {r.doc_id: i for i, r in enumerate(plan)}
    assert len({r.source for r in plan}) > 2 and len(nth) == len(after)
    assert [r.doc_id for r in sorted(after, key=lambda r: r.mix_place)] == sorted(nth, key=nth.get)
    # Files one after another.
    corpus_pipeline.sharding_stage(spark, spark.createDataFrame(list(before.values()), SCHEMA), tables[0]).write.parquet(str(tmp_path / "out"))
    rows = [(r["shard"], nth[r["doc_id"]]) for f in sorted((tmp_path / "out").glob("*.parquet")) for r in pq.read_table(str(f)).to_pylist()]
    assert rows == sorted(rows) and len(rows) == len(nth) and len({s for s, _ in rows}) == 16


def test_the_whole_pipeline(spark, tables, stages):
    got = corpus_pipeline.run(spark, tables[0])
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in stages["sharding"][1])


def test_empty_tables_and_more_columns(spark, tables):
    folder, rows, _ = tables
    docs = spark.createDataFrame(rows[:40], SCHEMA).selectExpr("*", "1 AS shard", "'x' AS quality_score", "2 AS k1", "3 AS slot", "4 AS id", "5 AS k", "6 AS n", "7 AS i")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
        more = stage(spark, docs, folder)
        assert more.columns[: len(docs.columns)] == docs.columns and more.count() > 30


def test_stages_with_nulls_repeats_equal_ids_and_very_long_texts(spark, tables):
    folder, rows, _ = tables
    good = next(t for _, t, *_ in rows if t and len(t) > 200 and not t.endswith("!!!"))
    words = [f"{w}{i}" for i, w in enumerate((good.split() * 2000)[:120_000])]
    odd = [(None, None, None, None, None), (None, "", "", "", 0), (7, " ".join(words[:50]), None, None, 1), (7, " ".join(words[100:150]), "en", "a", 1), (7, " ".join(words[100:150]), "en", "a", 1)]
    odd += [(8, " ".join(words), "en", "a", 1), (None, " ".join(words[200:260]), "en", "b", 1), (None, " ".join(words[300:360]), "en", "b", 1)]
    docs = spark.createDataFrame(odd, SCHEMA).repartition(3)
    out = {name: stage(spark, docs, folder).collect() for name, stage in corpus_pipeline.STAGES}
    of = lambda name: sorted((tuple(r)[:5] for r in out[name]), key=str)
    assert set(of("quality")) <= set(odd) and len(of("decontamination")) == len(odd)
    assert of("near-duplicates") == sorted(set(odd), key=str)
    assert of("mixing") == of("sharding") == sorted(odd, key=str)
    assert len({r.mix_place for r in out["sharding"]}) == len(odd) and len({r.shard for r in out["sharding"] if r.text and r.text.startswith(words[100])}) == 1
