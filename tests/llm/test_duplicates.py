"""Exact and near duplicates, components, decontamination, pipeline."""

import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tablediff.llm import decontaminate, exact_dedup, simhash, similar
from tablediff.llm.components import components

SF = "/root/testdata/sf0.001"
WORDS = "one two three four five six seven eight nine ten".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash") for i, t in rows], DOCS)


CASES = [(5, "a b"), (3, "ab"), (9, " a\tb\n"), (1, None), (2, ""), (7, "   "), (8, "x"), (8, "x"), (None, "x"), (None, "solo"), (11, "y" * 50_000)]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1), lambda c: F.lit("same")])
def test_exact(spark, digest):
    found = exact_dedup.find_copies(frame(spark, CASES), digest=digest).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert len(found) == len(CASES)
    assert all(by[i][0].keep_id == 9 and by[i][0].group_size == 3 for i in (3, 5, 9)) and by[9][0].kept and not by[3][0].kept
    assert all(by[i][0].keep_id == 7 for i in (1, 2, 7)) and by[7][0].kept
    assert sum(r.kept for r in by[8]) == 1 and by[8][0].group_size == 3
    assert sorted((r.keep_id is None, r.kept) for r in by[None]) == [(False, False), (True, True)]


def test_exact_drops_copies_only(spark):
    kept = exact_dedup.drop_copies(frame(spark, CASES)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 7), (False, 8), (False, 9), (False, 11), (True, 0)]
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "digest"}
    assert exact_dedup.find_copies(frame(spark, CASES).limit(0)).count() == 0


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.lit("same"), lambda c: F.substring(exact_dedup.sha256(c), 1, 1)])
def test_exact_state_goes_on(spark, tmp_path, digest):
    state, seen = f"file://{tmp_path}/state", []
    for rows in ([(1, "a"), (2, "b")], [(3, "a"), (4, "c"), (2, "b")], [(9, " zz"), (0, "a"), (5, "a  "), (None, "c"), (6, None)]):
        seen += rows
        found = exact_dedup.find_copies(frame(spark, rows), state, digest).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((i is None, i or 0) for i, _ in seen)
        groups = {}
        for i, t in seen:
            groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), i is None, i or 0))
        for own in groups.values():
            keep = min(own)
            of = [r for r in found if r.keep_id == (None if keep[1] else keep[2])]
            assert len(of) == len(own) and all(r.group_size == len(own) for r in of) and sum(r.kept for r in of) == 1
            assert next(r.doc_id for r in of if r.kept) == of[0].keep_id


def test_exact_equals_sql(spark):
    duckdb.sql(f"create or replace view documents as select * from '{SF}/documents.parquet'")
    df = exact_dedup.op3_exact_dedup(spark, SF)
    want = duckdb.sql(f"select {', '.join(df.columns)} from ({exact_dedup.OP3_SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def brute_fingerprint(text):
    words = simhash.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    pieces = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    n = len(fps)
    label = list(range(n))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                label[root(i)] = root(j)
    least = {}
    for i in range(n):
        least[root(i)] = min(least.get(root(i), 1 << 62), ids[i])
    return {ids[i]: least[root(i)] for i in range(n)}


def test_simhash_equals_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("one two three four five six seven eight nine ten".split()) for _ in range(200)) for _ in range(6)]
    rows = [(i, base[i % 6] + (" tail" if i % 4 == 0 else "") + (" Tail" if i % 5 == 0 else "")) for i in range(60)] + [(100, None), (101, ""), (102, " \t"), (103, "One two"), (104, "word " * 30_000)]
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    fps = [brute_fingerprint(t or "") for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    found = simhash.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in found} == {i: f for (i, _), f in zip(rows, fps)}
    assert {r.doc_id: r.component_id for r in found} == want
    assert {r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()} == set(want.values())
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [simhash.HOT_SUBTREE, 20])
def test_trie_keeps_every_link(spark, hot):
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (150, k)).astype(np.uint64), axis=1) for b in rng.integers(0, 2**63, 4, dtype=np.uint64) for k in (1, 2, 3)]))
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), hot=hot).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 * 2 * len(fps) for r in edges)
    forest = simhash.Forest(len(fps))
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    forest.join(np.array([at[r.a] for r in edges]), np.array([at[r.b] for r in edges]))
    want = simhash.Forest(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2)
        want.join(np.full(len(near), i), near)
    assert (forest.label == want.label).all()


def test_components_of_few_links_take_few_tasks(spark):
    keys = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in keys}
    executors = spark.sparkContext._jsc.sc().statusStore().executorList
    tasks = lambda: sum((e := executors(True)).apply(k).totalTasks() for k in range(executors(True).size()))
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        began = tasks()
        links = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
        assert {r.root for r in components(links).collect()} == {0} and tasks() - began < 2500
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80), (80, 90), (7, 7), (None, 3)], "a long, b long")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == dict.fromkeys(range(41), 0) | {80: 80, 90: 80}
    assert components(links.limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    items = [[word() for _ in range(rng.randint(12, 50))] for _ in range(25)]
    text = lambda n: [word() for _ in range(n)]
    rows = [(i, " ".join(text(120))) for i in range(60)]
    for i, w in enumerate(items):
        rows.append((100 + i, " ".join(text(90) + [x.upper() + "," for x in w] + text(90))))
        gaps = [x if k % 6 else word() for k, x in enumerate(w)]
        rows.append((200 + i, " ".join(text(30) + gaps + text(40))))
        rows.append((300 + i, " ".join(text(50) + w[: len(w) // 3] + text(50))))
    rows += [(400, None), (401, ""), (None, " ".join(items[0])), (402, " ".join(items[1] * 1 + text(40_000)))]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, " ... "), (None, "x")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(frame(spark, rows), bench).collect()}
    copies, near = {(100 + i, i) for i in range(25)} | {(402, 1)}, {(200 + i, i) for i in range(25)}
    assert copies <= found and len(near & found) >= 0.9 * len(near) and not found - copies - near
    kept = {r.doc_id for r in decontaminate.keep_uncontaminated(frame(spark, rows), bench).collect()}
    assert {*range(60), *range(300, 325), 400, 401} <= kept and not kept & {d for d, _ in copies}
    assert decontaminate.find_contamination(frame(spark, rows).limit(0), bench).count() == 0
    assert decontaminate.find_contamination(frame(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_of_long_items(spark):
    rng = random.Random(4)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n)]
    items = [text(n) for n in (40, 65, 129, 300, 1500)]
    rows = [(i, " ".join(text(70 + i) + w + text(500))) for i, w in enumerate(items)]
    rows += [(10 + i, " ".join(text(70) + [x if k % 8 else "other" for k, x in enumerate(w)] + text(90))) for i, w in enumerate(items)]
    rows += [(20 + i, " ".join(text(70) + w[: len(w) // 2] + text(900))) for i, w in enumerate(items)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(frame(spark, rows), bench).collect()}
    assert found == {(i, i) for i in range(5)} | {(10 + i, i) for i in range(5)}


def test_decontamination_finds_every_close_copy(spark):
    rng = random.Random(9)
    texts = [w for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if len(w := decontaminate.words(r.text)) > 60]
    common = [w for t in texts[:40] for w in t]
    items, rows = [], []
    for n in [rng.randint(4, 7) for _ in range(120)] + [rng.randint(8, 15) for _ in range(120)] + [rng.randint(16, 24) for _ in range(60)]:
        source, other = rng.sample(texts, 2)
        at, to = rng.randrange(len(source) - n), rng.randrange(len(other))
        items.append(source[at : at + n])
        copy = list(items[-1])
        if len(items) % 2 and n >= decontaminate.SHORT:
            for k in rng.sample(range(n), decontaminate.allowed(n)):
                copy[k] = rng.choice(common)
        rows.append((1000 + len(rows), " ".join(other[:to] + copy + other[to:])))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(frame(spark, rows), bench).collect()}
    missed = [i for i in range(len(items)) if (1000 + i, i) not in found]
    print("found of 4-7, 8-15, 16-24 words:", *(hi - lo - sum(lo <= i < hi for i in missed) for lo, hi in ((0, 120), (120, 240), (240, 300))))
    assert not missed


def brute_contamination(rows, items):
    """Every pair of a row and an item of SHORT words at least, by the longest common subsequence at every word that the item has."""
    out = set()
    for d, text in rows:
        own = decontaminate.words(text)
        for i, item in items:
            n, seen = len(item), set(item)
            at = np.array([k for k, w in enumerate(own) if w in seen])
            for k in at:
                region = [own[x] for x in at[(at >= k) & (at < k + n + n // 4)]]
                share = decontaminate.lcs(item, region) / n if len(region) >= decontaminate.PARAPHRASE * n else 0
                if share >= decontaminate.COPY or share >= decontaminate.PARAPHRASE and decontaminate.lcs(item[-6:], region) >= decontaminate.ANSWER * 6:
                    out.add((d, i))
                    break
    return out


def test_paraphrases_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASSAGES_PER_BLOCK", 9)  # several blocks, and several passes
    monkeypatch.setattr(decontaminate, "BLOCKS_PER_PASS", 2)
    rng = random.Random(5)
    bench = sorted((r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    items = [(i, decontaminate.words(t)) for i, t in bench]
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(330).collect()]
    common, rows = [w for _, ws in items for w in ws], []
    for d, text in enumerate(texts):
        own = text.split()
        if d % 3:
            words = rng.choice(items)[1]
            keep = {*rng.sample(range(len(words)), round(len(words) * rng.uniform(0.62, 0.85))), *range(len(words) - 6, len(words))}
            at = rng.randrange(len(own))
            own[at:at] = [x for k, w in enumerate(words) for x in ([w] if k in keep else [rng.choice(common)][: rng.random() < 0.7])]
        rows.append((d, " ".join(own)))
    rows.append(rows[1])
    frames = frame(spark, rows), spark.createDataFrame([*bench, (1000, bench[3][1])], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(*frames).collect()}
    assert {d for d, i in found if i == 1000} == {d for d, i in found if i == bench[3][0]}
    found, want = {x for x in found if x[1] != 1000}, brute_contamination(rows, items)
    print("recall", len(found & want) / len(want), "of", len(want), "besides", len(found - want))
    assert len(want) > 150 and len(found & want) >= 0.95 * len(want) and len(found - want) <= 0.05 * len(want)


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.lcs(a, b) == best[-1][-1]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert kept.join(docs, "doc_id", "left_anti").count() == 0
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.where("round_trip").count() == docs.count() > 100


def brute_near(rows):
    """Labels by every pair of rows whose sets of five-word shingles overlap by 0.8."""
    sets = []
    for _, t in rows:
        w = simhash.WORD.findall((t or "").translate(simhash.LOWER))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                label = [label[j] if k == label[i] else k for k in label]
    least = {}
    for k, (d, _) in zip(label, rows):
        least[k] = min(least.get(k, d), d)
    return {d: least[k] for k, (d, _) in zip(label, rows)}


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(8)
    text = lambda n: [rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(n)]
    rows = []
    for g in range(8):
        base = text(300)
        for k in range(12 if g else 60):
            copy = list(base)
            for at in rng.sample(range(300), k % 4):
                copy[at] = "edit" + str(rng.randrange(10**6))
            rows.append((len(rows), " ".join(copy)))
    rows += [(500, None), (501, ""), (502, " \t"), (503, "two words"), (504, "Two  words"), (505, "other words"), (506, "word " * 40_000), (507, "word " * 41_000)]
    rows += [(600 + i, " ".join(text(80))) for i in range(60)]
    found = {r.doc_id: r.component_id for r in similar.near_copies(frame(spark, rows)).collect()}
    want = brute_near(rows)
    assert found == want and len(set(want.values())) == 8 + 4 + 60
    more = frame(spark, [*rows, (3, rows[3][1]), (None, rows[3][1]), (None, None)])
    kept = similar.keep_one(more)
    assert kept.columns == more.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted([(False, d) for d in set(want.values())] + [(True, 0)] * 2)
    assert similar.near_copies(frame(spark, rows).limit(0)).count() == 0


def test_long_fingerprint():
    rng = random.Random(5)
    t = " ".join(str(rng.randrange(10**6)) for _ in range(700))
    h = similar.shingles(t)
    salted = [[(int(x) + int(s)) & (1 << 64) - 1 for x in h] for s in similar.SALTS[:, 0]]
    mix = lambda z: (z := (z ^ z >> 30) * similar.MIX_1 & (1 << 64) - 1, z := (z ^ z >> 27) * similar.MIX_2 & (1 << 64) - 1, z ^ z >> 31)[-1]
    want = [[sum(mix(z) >> (8 * j + b) & 1 for z in row) for j in range(8) for b in range(8)] for row in salted]
    assert similar._ones(h).reshape(-1, 64).tolist() == want


@pytest.mark.parametrize("bits", [(3, 1, 2), (0, 0, 0)])
def test_false_candidates_do_not_stand_in_for_near_copies(spark, monkeypatch, bits):
    rng = random.Random(6)
    text = [rng.choice(WORDS) + str(rng.randrange(999)) for _ in range(200)]
    rows = [(0, " ".join(rng.choice(WORDS) + str(rng.randrange(999)) for _ in range(200))), (1, " ".join(text)), (2, " ".join([*text[:-1], "edit"]))]
    # in the second section all three come near, the similar ones by way of the other at most; in the others none do
    fps = [[(7 << 4 * i) if t != 1 else bits[i] for t in range(similar.SECTIONS)] for i in range(3)]
    real, made = similar.sketches, spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id long, fp array<int>")
    monkeypatch.setattr(similar, "sketches", lambda docs, shingle: real(docs, shingle).drop("fp").join(made, "doc_id"))
    assert {r.doc_id: r.component_id for r in similar.near_copies(frame(spark, rows)).collect()} == {0: 0, 1: 1, 2: 1}


def test_all_pairs_equal_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, 40, dtype=np.uint64)
    value = np.concatenate([base, base, *(base ^ (np.uint64(1) << rng.integers(0, 21, 40).astype(np.uint64)) for _ in range(6))]) << np.uint64(32)
    group, comp = (value >> np.uint64(53)).astype(np.int64), rng.integers(0, 60, len(value))
    found = [(int(x), int(y)) for a, b in similar.all_pairs(group, value, comp, 11) for x, y in zip(a, b)]
    near = (group[:, None] == group) & (np.bitwise_count(value[:, None] ^ value) <= 2) & (comp[:, None] != comp)
    assert len(found) == len(set(found)) and {(min(p), max(p)) for p in found} == {(int(x), int(y)) for x, y in np.argwhere(near) if x < y}


def test_short_near_copies_equal_brute_force(spark):
    rng = random.Random(12)
    text = lambda n: [rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(n)]
    rows = []
    for n in [8, 8, 13, 18, 23, 28, 33] * 8:
        base = text(n)
        cut = (n - 4) // 5  # leaves four fifths of the shingles
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base, *text((n - 4) // 4)])), (len(rows) + 2, " ".join(base[: n - cut]))]
    found = {r.doc_id: r.component_id for r in similar.near_copies(frame(spark, rows)).collect()}
    want = brute_near(rows)
    print("found", sum(d != c and found[d] == c for d, c in want.items()), "of", sum(d != c for d, c in want.items()))
    assert found == want


@pytest.mark.parametrize("breaks", ["staging", "stream", "after"])
def test_a_call_that_was_broken_off_is_run_again(spark, tmp_path, monkeypatch, breaks):
    state, calls = f"file://{tmp_path}/state", [[(1, "a b"), (2, "c")], [(3, "ab"), (4, "d"), (4, "d"), (None, "c")]]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    whole = exact_dedup.find_copies(make(sum(calls, []))).collect()
    exact_dedup.find_copies(make(calls[0]), state).collect()
    with monkeypatch.context() as m:
        fail = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
        if breaks == "after":
            m.setattr(exact_dedup, "_end_call", fail)
        else:
            m.setattr(exact_dedup, "keyed_state", fail)
        with pytest.raises(RuntimeError):
            exact_dedup.find_copies(make(calls[1]), state)
    if breaks == "staging":
        (tmp_path / "state" / "staged" / "call=1" / "_SUCCESS").unlink()
    again = exact_dedup.find_copies(make(calls[1]), state).collect()
    told = lambda rows: sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows), key=str)
    assert told(again) == told(whole)
    # and a call of other rows after one that was broken off is a call of its own
    assert {r.call for r in exact_dedup.find_copies(make([(9, "z")]), state).collect()} == {0, 1, 2}
