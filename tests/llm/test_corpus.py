"""Operators over the whole corpus, against brute force on fixtures with every odd case."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagequarry.llm import common, graph, lattice, mixing, quality, simhash, warc
from tests.llm.conftest import ROWS

PAGES = [
    (1, "u1", "a" * 1000), (2, "u2", "a" * 1000), (3, "u3", "a" * 999), (4, "u4", "a" * 999), (5, None, None), (6, "u6", ""), (7, "u\r\nWARC-Type: revisit", "é" * 500),
    (8, "u8", "é" * 500), (None, "u9", "a" * 1000), (2, "u2", "a" * 1000), (10, "u10", "x" * 100_000), (11, "u11", "b" * 2000), (11, "other", "c" * 2000),
]


def test_warc_records_and_archive(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("mine"))
    headers, payloads = warc.write_archive(pages)
    assert payloads.count() == len({h or "" for *_, h in PAGES})
    read = warc.read_archive(headers, payloads)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read.collect())
    owner = defaultdict(list)
    for p, _, h in PAGES:
        owner[h or ""].append(-1 if p is None else p)
    want = Counter()
    for p, _, h in PAGES:
        data = (h or "").encode()
        last = max(owner[h or ""])
        revisit = len(data) >= 1000 and last != (-1 if p is None else p)
        want[(p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None)] += 1
    assert got == want
    for r in warc.original(read).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert b"\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in head and (b"WARC-Type: revisit" in head) == (b"\r\nWARC-Profile: http" in head)
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and len(body) == size + 4 and body.endswith(b"\r\n\r\n")


def test_damage_is_noticed(spark):
    headers, payloads = warc.write_archive(spark.createDataFrame(PAGES[:2], "page_id long, url string, html string"))
    spoiled = payloads.withColumn("payload", F.encode(F.lit("other"), "UTF-8"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(headers, spoiled).collect()


def test_archive_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archive(*warc.write_archive(empty)).collect() == []


def water(sizes):
    """Targets by repeated sharing: what is over three times a source's size is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    return target


def check_mix(out, rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    goal = water(sizes)
    taken = defaultdict(int)
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goal[r.source])
        taken[r.source] += r.taken
    return goal, taken


def test_mixing(spark, hostile, nothing):
    rng = np.random.default_rng(0)
    rows = [(k, "w " * int(rng.integers(0, 40)), ["a", "b", "c", "d", None][int(rng.choice(5, p=[0.5, 0.2, 0.1, 0.15, 0.05]))]) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    goal, taken = check_mix(out, rows)
    assert all(abs(goal[s] - taken[s]) <= 1 for s in goal) and len(out) == 3000
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    for s in goal:  # complete epochs come first
        mine = [r for r in out if r.source == s and r.size]
        assert len({r.taken // r.size for r in mine}) <= 2
    odd = mixing.mix(hostile.withColumn("size", F.lit("x"))).collect()
    goal, taken = check_mix(odd, [(d, t, s) for d, t, _, s, _ in ROWS])
    assert len(odd) == len(ROWS) and all(abs(goal[s] - taken[s]) <= 2 for s in goal)
    assert mixing.mix(nothing).collect() == []


def test_mixing_one_sort_bin_among_many(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN_ROWS", 50)
    rows = [(k, "w " * (1 + k % 17), "abc"[k % 3]) for k in range(2000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    goal, taken = check_mix(out, rows)
    assert all(abs(goal[s] - taken[s]) <= 1 for s in goal)


def test_mixing_takes_the_least_keys(spark, monkeypatch):
    """Against a plain sort of each source: whole documents of the least keys, the next one in part, the others not at all."""
    monkeypatch.setattr(mixing, "BIN_ROWS", 20)
    monkeypatch.setattr(mixing, "BINS", 8)
    rng = np.random.default_rng(9)
    # letterless texts have a twentieth of the weight, so their keys are far larger than the others'
    rows = [(k, ("w " if rng.random() < 0.3 else "12345 67 ") * int(rng.integers(1, 30)), "abcd"[int(rng.choice(4, p=[0.6, 0.2, 0.1, 0.1]))]) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in mixing.mix(docs).collect()}
    keys = {r.doc_id: (r.key, r.size) for r in mixing.sized(docs).collect()}
    for (k, t, _) in rows[:200]:
        u = ((chained(mixing.SEED, k, t) >> 12) + 0.5) / 2**52
        assert keys[k][0] == pytest.approx(-np.log(u) / max(0.05, sum(map(str.isalpha, t)) / len(t)))
    for source in "abcd":
        mine = sorted((k for k, _, s in rows if s == source), key=lambda k: keys[k][0])
        whole = sum(keys[k][1] for k in mine)
        epochs, rest = divmod(round(out[mine[0]].target), whole)
        for k in mine:
            part = min(keys[k][1], rest)
            assert out[k].taken == epochs * keys[k][1] + part
            rest -= part


def test_mixing_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW_SOURCES", 5)
    rows = [(k, "w " * (k % 13), f"host{k * 7919 % 211}" if k % 3 else None) for k in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    goal, taken = check_mix(out, rows)
    assert len(out) == 3000 and all(abs(goal[s] - taken[s]) <= 1 for s in goal)


def test_mixture_repeats_and_cuts(spark, hostile, nothing):
    odd = hostile.withColumn("words", F.lit("mine")).withColumn("size", F.lit(7))
    got = mixing.mixture(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert {r.words for r in rows} == {"mine"} and {r.size for r in rows} == {7}
    words, want = defaultdict(int), defaultdict(int)
    for r in rows:
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    for r in mixing.mix(hostile).collect():
        want[r.source] += r.taken
    assert {s: n for s, n in want.items() if n} == dict(words)
    assert mixing.mixture(nothing).collect() == []


def simhash_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(runs))


def linked(items, link):
    """Smallest name reachable, by union-find over all pairs."""
    root = {n: n for n, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if link(x, y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in root}


def test_simhash_components(spark, hostile, nothing):
    out = simhash.components(hostile.withColumn("fp", F.lit("x"))).collect()
    want = {}
    for d, t, *_ in ROWS:
        want.setdefault(f"{simhash_by_hand(t):016x}", set()).add(d)
    assert len(out) == len(ROWS)
    for r in out:
        assert r.doc_id in want[r.fingerprint]
        ids = [x for f, s in want.items() if bin(int(f, 16) ^ int(r.fingerprint, 16)).count("1") <= 3 for x in s if x is not None]
        assert r.component_id == (min(ids) if ids else None)
    assert simhash.components(nothing).collect() == []


def test_trie_join_finds_every_pair():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    value = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for c in centre]))
    group = (value % np.uint64(3)).astype(np.int64)
    a, b = simhash.trie_join(value, group)
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    near = np.bitwise_count(value[:, None] ^ value[None, :]) <= 3
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(near & (group[:, None] == group[None, :]), 1)), strict=True)}
    assert got == want and len(want) > 500


@pytest.mark.parametrize("n", [10, 1 << 25, 1 << 34])
def test_masks_put_near_fingerprints_together(n):
    rng = np.random.default_rng(0)
    for _ in range(200):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not flips & m for m in simhash.masks(n))


def test_dense_groups_are_cut_into_blocks(spark, monkeypatch):
    """Fingerprints of one dense group, several parts of it: the same components as over all pairs."""
    monkeypatch.setattr(simhash, "PART_ROWS", 40)
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(24, int(rng.integers(0, 5)), replace=False)) for _ in range(300)} | {int(x) for x in rng.integers(0, 1 << 62, 100)})
    rows = spark.createDataFrame([(k, f) for k, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.labelled(rows).collect()}
    want = linked(list(enumerate(fps)), lambda x, y: bin(x ^ y).count("1") <= 3)
    assert got == {f: want[k] for k, f in enumerate(fps)}


def test_one_document_of_each_group_stays(spark, hostile, nothing):
    odd = hostile.withColumn("simhash_row", F.lit("mine"))
    got = simhash.deduplicated(odd)
    assert got.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in got.collect()]
    ids = {r.component_id for r in simhash.components(hostile).collect()}
    assert {d for d, _ in rows} == ids and len(rows) == len(set(rows)) and (1, ROWS[0][1]) in rows
    assert simhash.deduplicated(nothing).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 164)] + [(k, 1) for k in range(2, 60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 165)} | {k: 1 for k in range(1, 60)}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hot_keys_join_whole(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    classes = rows.groupBy("k").agg(F.count("*").alias("n"), (F.min("id") * 2).alias("v"))
    out = common.join_classes(rows, classes, "k", "n")
    assert out.count() == 6000 and out.filter("k = 0").count() == 2000 and out.columns == ["k", "id", "v"]


def test_wide_classes_of_hot_keys_join_whole(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.lit("x").alias("salt"))
    classes = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("v"))
    out = common.join_salted(rows, classes, "k", "n")
    assert sorted(map(tuple, out.select("id", "k", "salt", "v").collect())) == sorted((k, 0 if k % 3 == 0 else k, "x", 0 if k % 3 == 0 else k) for k in range(6000))


def vectors(rng, n=150):
    base = rng.normal(size=(n, 24))
    rows = []
    for k, v in enumerate(base):
        rows.append((len(rows), v.tolist(), k % 2))
        for _ in range(int(rng.integers(0, 4))):
            rows.append((len(rows), (v + rng.normal(size=24) * 0.2).tolist(), k % 2))
        if k % 5 == 0:
            rows.append((len(rows), v.tolist(), k % 2))
    return rows


def brute(rows):
    names = [r[0] for r in rows]
    good = [r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1] or []) for r in rows]
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    link = lambda i, j: good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= 0.93
    n = [sum(i != j and link(i, j) for j in range(len(rows))) for i in range(len(rows))]
    return names, n, linked([(k, k) for k in range(len(rows))], link)


@pytest.mark.parametrize("part_rows", [1024, 3])
def test_lattice_near_duplicates(spark, monkeypatch, part_rows):
    monkeypatch.setattr(lattice, "PART_ROWS", part_rows)
    rows = vectors(np.random.default_rng(4))
    rows += [(len(rows) + k, v, lb) for k, (v, lb) in enumerate([(None, 1), ([0.0] * 24, 1), ([None] + [1.0] * 23, 1), ([float("nan")] * 24, 1), ([float("inf")] * 24, 0), (rows[0][1], None), ([1e-100] * 24, 0), ([], 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1)])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit("x"))
    out = {r.vec_id: r for r in lattice.near_duplicates(frame).collect()}
    names, n, component = brute(rows)
    assert len(out) == len(rows)
    assert sum(out[k].n_links for k in names) >= 0.99 * sum(n) and all(out[k].n_links <= n[k] for k in names)
    assert np.mean([out[k].component_id == component[k] for k in names]) > 0.99
    assert all(out[k].kept == (out[k].component_id == k) for k in names)


def test_lattice_points_are_nearest():
    x = np.random.default_rng(0).normal(size=(300, 8)) * 2
    near = lattice.nearest_e8(x)
    best = ((x - near) ** 2).sum(axis=1)
    for v in lattice.SHORTEST:
        assert (((x - near - v) ** 2).sum(axis=1) >= best - 1e-9).all()
    assert len(lattice.SHORTEST) == 240 and np.allclose((lattice.SHORTEST**2).sum(axis=1), 2)


def test_lattice_of_nothing_and_of_null_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert lattice.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    got = lattice.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (None, None, None)], schema)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter({(None, 3, 4, False): 2, (4, 3, 4, True): 2, (None, 0, None, True): 1})


def quality_docs(spark, n=400):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(["th", "er", "ing", "on", "ou", "st"], int(rng.integers(1, 4))))
    rows, marks = [], []
    for k in range(n):
        words = [word() for _ in range(int(rng.integers(8, 120)))]
        bad = k % 4 == 0
        text = [" ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join(w + "***" for w in words), " ".join(words[k // 12 % 3] for _ in words)][0 if not bad else 1 + k // 4 % 3]
        rows.append((k, text))
        if k % 2 == 0:
            marks.append((k, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")


def test_quality_keeps_clean_documents(spark, hostile, nothing, labels, no_labels):
    docs, marks = quality_docs(spark)
    out = quality.resample(docs, marks).collect()
    bad = {r.doc_id for r in out if r.doc_id % 4 == 0}
    kept = {r.doc_id for r in out if r.kept}
    assert len(out) == 400 and len(kept & bad) <= 4 and len({r.doc_id for r in out} - bad - kept) <= 4
    odd = hostile.withColumn("quality_key", F.lit("mine"))
    some = quality.selected(odd, labels)
    assert some.columns == odd.columns and {r.quality_key for r in some.collect()} <= {"mine"}
    assert quality.selected(hostile, no_labels).count() == len(ROWS)  # nothing learned: nothing rejected
    assert quality.resample(nothing, no_labels).collect() == [] and quality.selected(nothing, labels).collect() == []


def test_quality_reads_labelled_texts_whole(spark):
    rng = np.random.default_rng(2)
    vocabulary = np.array(["".join(rng.choice(["th", "er", "ing", "on", "ou", "st"], int(rng.integers(1, 4)))) for _ in range(500)])
    clean = lambda n: " ".join(rng.choice(vocabulary, n))
    rows = [(k, clean(5_000) + (" " + clean(7_000).upper().replace(" ", "!! ") if k % 4 == 0 else " " + clean(7_000))) for k in range(60)]
    assert min(t.find("!!") for k, t in rows if k % 4 == 0) > 20_000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(60) if k % 8 < 5], "doc_id long, quality int")
    model = quality.learn(docs, marks)
    ratio = dict(zip([k for k, _ in rows], model.mean_ratio([t for _, t in rows]), strict=True))
    marked = {r.doc_id: r.quality == 1 for r in marks.collect()}
    assert model.ratio.tolist() == quality.log_ratio(quality.counts([t for k, t in rows if marked.get(k)]), quality.counts([t for _, t in rows])).tolist()
    known = sorted(marked)
    want = quality.calibrate(np.array([ratio[k] for k in known]), np.array([marked[k] for k in known]), np.ones(len(known)))
    assert (model.slope, model.level) == pytest.approx(want) and model.learned
    assert {r.doc_id for r in quality.resample(docs, marks).collect() if r.kept} == {k for k in range(60) if k % 4}


def chained(*values):
    """Spark's xxhash64 of an int, a long and a string, by another library."""
    h = 42
    for v, width in zip(values, (4, 8, None), strict=True):
        h = xxhash.xxh64_intdigest(v.encode() if width is None else v.to_bytes(width, "little", signed=True), h)
    return h


def test_quality_draw_recomputed_plainly(spark):
    """Ratios, weights, keys and the draw again, from dictionaries of n-grams and a plain sort."""
    rng = np.random.default_rng(7)
    rows, marks = [], []
    for k in range(300):  # the share of shouted words rises with k, and with it the odds that a row is labelled bad
        words = ["".join(rng.choice(["th", "er", "ing", "on", "ou", "st"], int(rng.integers(1, 4)))) for _ in range(40)]
        rows.append((k, " ".join(w.upper() if rng.random() < k / 300 else w for w in words)))
        marks.append((k, int(rng.random() > (k / 300) ** 2)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.resample(docs, labels).collect()}

    def grams(text):
        data = b" " + text.encode() + b" "
        return [int.from_bytes(data[k : k + 4].ljust(4), "big") * 0x9E3779B97F4A7C15 % 2**64 >> 64 - quality.BUCKET_BITS for k in range(len(data))
                if data[k : k + 2].strip() or k == len(data) - 2 and data[k : k + 1].strip()]

    def repeated(text):
        words = text.lower().split()
        return [quality.SAME if a == b else quality.NEXT for a, b in zip(words, words[1:])]

    def model(texts):
        out = []
        for of, n in ((grams, 1 << quality.BUCKET_BITS), (repeated, 2)):
            count = Counter(g for t in texts for g in of(t))
            total = sum(count.values())
            out.append(lambda g, count=count, total=total, n=n: np.log((count[g] + 1) / (total + n)))
        return out

    good = dict(marks)
    target, raw = model([t for k, t in rows if good[k]]), model([t for _, t in rows])
    ratio = {}
    for k, t in rows:
        own = [(0, g) for g in grams(t)] + [(1, g) for g in repeated(t)]
        ratio[k] = sum(target[j](g) - raw[j](g) for j, g in own) / len(grams(t))
        assert out[k].log_ratio == pytest.approx(ratio[k], abs=0.02), (k, out[k].log_ratio, ratio[k])
    slope = np.polyfit([out[k].log_ratio for k in good], [out[k].log_weight for k in good], 1)
    x, y = np.array([out[k].log_ratio for k in good]), np.array(list(good.values()))
    fit = quality.calibrate(x, y == 1, np.ones(len(x)))
    assert slope[0] > 0 and slope[0] == pytest.approx(fit[0], rel=1e-6)
    p = 1 / (1 + np.exp(-(fit[0] * x + fit[1])))
    assert abs((p - y).sum()) < 1e-3 and abs(((p - y) * x).sum()) < 0.05  # the best fit's slopes are level
    odds, shift = fit[0] * x + fit[1], slope[1] - fit[1]
    share = (1 / (1 + np.exp(-(odds + shift)))).mean()  # the shift is where the corpus's share maps to itself
    assert np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())) == pytest.approx(shift, abs=1e-2)
    key = {}
    for k, t in rows:
        u = ((chained(quality.SEED, k, t) >> 12) + 0.5) / 2**52
        key[k] = out[k].log_weight - np.log(-np.log(u))
        assert out[k].key == pytest.approx(key[k])
    most = round(sum(1 / (1 + np.exp(-r.log_weight)) for r in out.values()))
    assert {k for k, r in out.items() if r.kept} == set(sorted(key, key=key.get)[-most:])
    assert {k for k, r in out.items() if r.kept} != set(sorted(key, key=lambda k: out[k].log_weight)[-most:])  # the noise decides


def test_quality_inclusion_rises_with_weight(spark):
    """Over many seeds: likelier documents are kept more often, those of even odds now and then."""
    n, seeds = 200, 300
    at = spark.range(n).withColumn("text", F.lit("t")).join(spark.range(seeds).withColumnRenamed("id", "seed"))
    u = (F.shiftrightunsigned(F.xxhash64(F.col("seed").cast("int"), "id", "text"), 12).cast("double") + 0.5) / float(1 << 52)
    noise = np.zeros((seeds, n))
    for r in at.select("id", "seed", (-F.log(-F.log(u))).alias("g")).collect():
        noise[r.seed, r.id] = r.g
    some = [r.g for r in spark.range(n).withColumn("text", F.lit("t")).select(quality.gumbel(F.col("id"), F.col("text"), 17).alias("g")).collect()]
    assert np.allclose(sorted(some), sorted(noise[17])) and abs(noise.mean() - 0.5772) < 0.02
    weight = np.linspace(-6, 6, n)
    kept = np.argsort(np.argsort(weight + noise, axis=1), axis=1) >= n // 2
    share = kept.mean(axis=0).reshape(10, -1).mean(axis=1)
    assert (np.diff(share) >= 0).all() and share[0] < 0.02 and share[-1] > 0.98 and 0.2 < share[4] < 0.8


def test_quality_ties_and_repeated_rows(spark, hostile, labels):
    out = quality.resample(hostile.withColumn("key", F.lit("x")), labels).collect()
    assert len(out) == len(ROWS)
    by = defaultdict(set)
    for r in out:
        if r.doc_id == 6:
            by[r.doc_id].add((r.key, r.kept))
    assert len(by[6]) == 1


def test_kth_largest(spark):
    values = [float(x) for x in np.random.default_rng(0).normal(size=3000)] + [0.5] * 200
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    order = sorted(values, reverse=True)
    for k in (1, 2, 900, 1000, 1100, 3200):
        assert quality.kth_largest(rows, "v", k, most=64) == order[k - 1]
