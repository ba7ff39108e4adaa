"""Operators on edge cases, and against SQL or brute force on small tables."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import chat, decontamination, jaccard, langid, lm, mixing, quality, queries, sharding, tokenfiles, toxicity, workspace
from lodestone.llm.bytecontext import ContextTree, pieces
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, term string, n long, root long, label int"
LONG = "word%d " * 40_000 % tuple(range(40_000))


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


@pytest.fixture(scope="module")
def edge(spark):
    some = "The quick Brown fox jumps over the lazy dog and runs away from here now " * 6
    rows = [
        (1, some, "en", "a"), (2, some, "en", "a"), (2, some, "en", "a"), (3, some + "extra", "en", None), (4, None, "en", "a"), (5, "", None, "b"),
        (None, some, "en", "a"), (None, None, None, None), (6, LONG, "de", "a"), (7, " \n\t ", "de", "b"), (8, "Ünï \\<|im_end|> $$$ 123", "fr", "b"), (9, "one", "en", "b"),
    ]
    return spark.createDataFrame([(*r, 1, 0.5, "t", 1, 1, 0) for r in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def items(spark):
    return spark.createDataFrame([(1, "quick brown FOX jumps over the lazy dog and runs away"), (2, "one"), (3, None), (None, "word5 word6"), (2, "one")], "item_id long, text string")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


def test_toxicity(spark, edge, empty):
    assert toxicity.fold("Іdi0t, m0r0n 2024!") == " idiot moron 2024 "
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " lowe": 4.0}, [" village idiot "], (-3.0, 2.0, 1.0, 0.0))
    assert set(lexicon.matches(toxicity.fold("an 1diot loweish")).values()) == {5.0, 4.0}
    assert not lexicon.matches(toxicity.fold("the village idiot"))
    assert lexicon.score("you idiot") > 0.5 > lexicon.score("")
    for docs in (edge, empty):
        out = toxicity.score(docs, lexicon, "_s")
        assert out.count() == docs.count() and not out.where("_s is null").count()
    labels = spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, label int")
    assert toxicity.train(edge, labels).entries == {}


def test_drop_toxic_of_edge_cases(spark, edge, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edge, empty):  # too few labels for an entry, so everything stays as it is
        kept = toxicity.drop_toxic(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, docs.collect()))


def brute_lexicon(rows):
    """Entries, exceptions and features of a lexicon by definition, from ``(text, label)``."""
    docs = [(set(toxicity.fold(t).split()), label) for t, label in rows]
    n = [sum(x == k for _, x in docs) for k in (0, 1)]
    count = Counter((w, x) for d, x in docs for w in d)
    both = defaultdict(lambda: [0, 0])
    for (w, x), c in count.items():
        for e in {f" {w} "} | {f" {w[:k]}" for k in range(4, min(10, len(w) - 1) + 1)}:
            both[e][x] += c
    entries = {}
    for e, (c, t) in both.items():
        want = (t + c) * n[1] / sum(n)
        weight = math.log((t + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))
        if t >= 3 and weight >= 2 and 2 * (t * math.log(t / want) + (c * math.log(c / (t + c - want)) if c else 0)) >= 15:
            entries[e] = weight

    def found(folded):
        return {k: max(entries[e] for e in entries if folded.startswith(e, k)) for k in range(len(folded)) if any(folded.startswith(e, k) for e in entries)}

    pairs = defaultdict(lambda: [0, 0])
    for t, label in rows:
        f, mine = toxicity.fold(t), set()
        w = f.split()
        for k in found(f):
            i = f[: k + 1].count(" ") - 1
            mine |= {f" {w[i]} {w[i + 1]} "} if i + 1 < len(w) else set()
            mine |= {f" {w[i - 1]} {w[i]} "} if i else set()
        for p in mine:
            pairs[p][label] += 1
    spared = {p for p, (c, t) in pairs.items() if not t and c >= 3}

    def features(text):
        f = toxicity.fold(text)
        at = {k: w for k, w in found(f).items() if not any(f.startswith(p, s) and s <= k < s + len(p) - 1 for p in spared for s in range(max(0, k - 60), k + 1))}
        total = sum(at.values())
        return math.log1p(total), math.log1p(100 * total / max(1, len(f.split()))), max(at.values(), default=0.0)

    return entries, spared, features


def test_toxicity_against_brute_force(spark):
    rng = np.random.default_rng(4)
    plain = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(360):
        w, label = list(rng.choice(plain, int(rng.integers(1, 30)))), i % 3 == 0
        if label:
            w[int(rng.integers(0, len(w)))] = str(rng.choice(["idiot", "m0ron", "Ідіоt", "lowlifes", "lowlifer"]))
        elif i % 40 == 1:
            w += ["village", "idiot", "song"]
        rows.append((i, " ".join(w), int(label)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    lexicon = toxicity.train(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, label int"))
    fold_of = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(3)).alias("f")).collect()}
    entries, spared, features = brute_lexicon([(t, x) for i, t, x in rows if fold_of[i] < 2])
    assert lexicon.entries.keys() == entries.keys() and all(abs(lexicon.entries[e] - w) < 1e-9 for e, w in entries.items()) and len(entries) > 3
    assert set(lexicon.exceptions) == spared and spared
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lexicon).collect()}
    for i, t, _ in rows:
        x = features(t)
        assert np.allclose(lexicon.features(t), x)
        assert abs(got[i] - 1 / (1 + math.exp(-(lexicon.curve[0] + sum(a * b for a, b in zip(lexicon.curve[1:], x, strict=True)))))) < 1e-9


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = toxicity.op1_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.95 * len(got)


def test_sharding(spark, edge, empty):
    for docs in (edge, empty):
        s = sharding.ingest(docs, target_bytes=1 << 16, base_bytes=1 << 10)
        assert sorted(map(repr, s.read().collect())) == sorted(map(repr, docs.collect())) and len(s.versions()) == 1
    s = sharding.ShardSet(spark, sharding.scratch(spark, "t"), target_bytes=1 << 20)
    for k in range(4):
        s.append(edge.coalesce(1))
        assert s.versions()[-1] == k + 1
    assert s.compact() == 5 and s.manifest().where("path <> ''").count() == 1
    assert s.read(4).count() == s.read().count() == 4 * edge.count()  # the version before the merge stays readable
    with pytest.raises(Exception, match="exist"):
        s._commit(s.manifest(), "", 4)


def test_sharding_of_two_writers(spark, edge):
    s = sharding.ShardSet(spark, sharding.scratch(spark, "t"))
    s.append(edge)
    base = s.versions()[-1]
    first, second = s._write(edge.limit(1)), s._write(edge.limit(2))
    schema = edge.schema.json()
    s._commit(s.manifest(base).unionByName(first), schema, base)
    with pytest.raises(Exception, match="exist"):
        s._commit(s.manifest(base).unionByName(second), schema, base)
    assert s.read().count() == edge.count() + 1 and s.read(base).count() == edge.count()
    runs = lambda: {x.getPath().getName() for x in s._fs.listStatus(s._path(f"{s.root}/data"))}
    assert len(runs()) == 3
    s.vacuum()
    assert len(runs()) == 3  # the loser's files may belong to a write that goes on
    s.vacuum(abandoned_s=0)
    assert len(runs()) == 2 and s.read().count() == edge.count() + 1
    assert not [x for x in s._fs.listStatus(s._path(f"{s.root}/manifest")) if x.getPath().getName().startswith("_")]


def brute_hits(text, bench):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = set(), set()
    for i, t in bench:
        b = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        n = min(10, len(b))
        for k in range(len(b) - n + 1) if n else []:
            for p in range(len(w) - n + 1):
                if w[p : p + n] == b[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add("" if i is None else str(i))
    return len(w), len(hit), len(found)


def test_decontamination(spark, edge, empty):
    small = edge.where("doc_id is null or doc_id <> 6")
    bench = [(r["item_id"], r["text"]) for r in items(spark).collect()]
    got = decontamination.contamination(small, items(spark))
    assert sorted((r["n_words"], r["n_hit"], r["n_items"]) for r in got.collect()) == sorted(brute_hits(r["text"], bench) for r in small.collect())
    kept = decontamination.drop_contaminated(edge, items(spark))
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 7, 8, None}
    assert decontamination.contamination(empty, items(spark)).count() == 0
    assert decontamination.drop_contaminated(edge, items(spark).limit(0)).count() == edge.count()
    assert decontamination.drop_contaminated(empty, items(spark)).count() == 0


def brute_near(texts, bench, window=10, slop=3, tenths=8):
    """Windows and items that each text holds about, by definition."""
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    docs, out = [word(t) for t in texts], []
    freq = Counter(x for d in docs for x in d)
    variants = {(i, tuple(word(t))) for i, t in bench if word(t)}
    for d in docs:
        found = set()
        for i, w in variants:
            n = min(window, len(w))
            for s in range(len(w) - n + 1):
                known = sorted((at for at in range(s, s + n) if freq[w[at]]), key=lambda at: (freq[w[at]], at))
                if len(known) < 2:
                    continue
                a, b = known[:2]
                for p in range(len(d)):
                    if d[p] != w[a] or w[b] not in d[max(0, p - a + b - slop) : max(0, p - a + b + slop + 1)]:
                        continue
                    there = sum(w[at] in d[max(0, p - a + at - slop) : max(0, p - a + at + slop + 1)] for at in range(s, s + n))
                    if 10 * there >= tenths * n:
                        found.add((i, w, s))
        out.append((len(found), len({i for i, _, _ in found})))
    return out


def test_decontamination_by_proximity(spark):
    rng = np.random.default_rng(2)
    bench = [(i, " ".join(f"b{x}" for x in rng.integers(0, 60, int(rng.integers(1, 25))))) for i in range(12)] + [(3, "b1 b2 b3 unknown b5")]
    texts = [None, "", "b1"]
    for i in range(60):  # passages with words put in, left out, exchanged and replaced
        w = bench[i % 12][1].split()
        for _ in range(i // 12):
            p = int(rng.integers(0, len(w)))
            w = [w[:p] + ["x"] + w[p:], w[:p] + w[p + 1 :] or ["y"], w[:p] + [f"b{rng.integers(0, 60)}"] + w[p + 1 :]][int(rng.integers(0, 3))]
        texts.append(" ".join([*(f"c{x}" for x in range(i % 3)), *w, *(f"b{x}" for x in rng.integers(0, 60, 8))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontamination.contamination(docs, spark.createDataFrame(bench, "item_id long, text string")).orderBy("doc_id").collect()
    want = brute_near(texts, bench)
    assert [(r["n_near"], r["n_near_items"]) for r in got] == want and sum(n for n, _ in want) > 100


def test_decontamination_of_a_document_that_begins_inside_an_item(spark):
    w = [f"t{i}" for i in range(12)]
    common = " ".join(x for x in w if x not in ("t5", "t7"))  # so that words 5 and 7 are the rarest of every window
    texts = [" ".join(w[2:]), *[f"{common} x"] * 6, " ".join(w[1:11]), " ".join(w[:10]), " ".join(w[3:])]
    bench = [(1, " ".join(w))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontamination.contamination(docs, spark.createDataFrame(bench, "item_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"]) for r in got] == [brute_hits(t, bench) for t in texts]
    assert [r["contaminated"] for r in got] == [True, *[False] * 6, True, True, False]


def test_mixing(spark, edge, empty):
    assert mixing.exponent_for([100, 100], max_repeats=2) == 0.0
    w = mixing.weights([900, 50, 50], mixing.exponent_for([900, 50, 50], target_entropy=0.9))
    assert abs(mixing.entropy(w) - 0.9) < 1e-4
    a = mixing.exponent_for([900, 100], max_repeats=1.5)
    w = mixing.weights([900, 100], a)
    assert abs(w[1] * mixing.least_budget([900, 100], w) / 100 - 1.5) < 1e-3
    out = mixing.mix(edge)
    assert out.where("epoch = 0").count() == edge.count()
    drawn = mixing.draw(edge, out)
    assert drawn.columns == edge.columns and drawn.count() == out.count() >= edge.count()
    count = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows)
    assert count(mixing.draw(edge, out, ordered=True).collect()) == count(drawn.collect()) >= count(edge.collect())
    assert mixing.mix(empty).count() == 0 and mixing.draw(empty, mixing.mix(empty)).count() == 0


def test_mixing_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rows = [(i, "w " * (1 + i % 5), "big" if i % 4 else "small") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, max_repeats=3.0, budget=6000)
    got = mixed.collect()
    by = defaultdict(list)
    for r in got:
        by[r["source"], r["epoch"]].append(r)
    for source in ("big", "small"):
        whole = [sorted(by[source, e], key=lambda r: (r["block_start"], r["position"])) for e in range(max(e for s, e in by if s == source) + 1)]
        ids, all_ids = [[r["doc_id"] for r in x] for x in whole], {i for i, _, s in rows if s == source}
        blocks = [list(dict.fromkeys(r["block"] for r in x)) for x in whole]
        assert len(whole) >= 2 and all(set(x) == all_ids and len(x) == len(all_ids) for x in ids[:-1]) and set(ids[-1]) <= all_ids
        assert len({tuple(x) for x in ids}) == len(ids) and len({tuple(x) for x in blocks}) == len(blocks) and len(blocks[0]) > 4  # each epoch is another permutation
        drawn = sum(r["n_tokens"] for x in whole for r in x)
        assert whole[0][0]["budget"] - 5 < drawn <= whole[0][0]["budget"]
        at = 0
        for x in whole:  # blocks stand one behind another
            for k, r in enumerate(x):
                assert r["position"] > 1 or r["block_start"] == at
                at += r["n_tokens"]
    out = [r["source"] for r in mixing.draw(docs, mixed, ordered=True).collect()]
    half = Counter(out[: len(out) // 2])
    assert len(out) == len(got) and abs(half["small"] / (len(out) // 2) - out.count("small") / len(out)) < 0.1  # the sources interleave


def test_quality_statistics(spark, edge, empty):
    got = quality.base_statistics(edge).collect()
    for r in got:
        w, text = words(r["text"]), r["text"] or ""
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        covered = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
    assert quality.judge(edge).count() == edge.count() and quality.judge(empty).count() == 0


def binned(v, share, width):
    """Upper edge of the bin in which the share of the values is reached."""
    bins = np.sort(np.ceil(np.asarray(v) / width))
    return bins[max(0, math.ceil(share * len(bins) - 1e-9) - 1)] * width


def brute_mcd(rows):
    """Squared distances of ``(lang, source, features)`` by the method's definition, group by group."""
    floor = np.array(list(quality.FEATURES.values()))
    factor = lambda c, scale=1.0: np.linalg.cholesky(scale * c + np.diag(floor**2))
    logdet = lambda c: 2 * np.log(np.diag(factor(c))).sum()
    moments = lambda x: (x.mean(0), x.T @ x / len(x) - np.outer(x.mean(0), x.mean(0)))

    def dist(x, m, l):
        return (np.linalg.solve(l, (x - m).T) ** 2).sum(0)

    def concentrate(x, m, c):
        v = np.log(dist(x, m, factor(c)) + 1e-9)
        return moments(x[np.ceil(v / 0.01) * 0.01 <= binned(v, quality.SUPPORT, 0.01) + 1e-6])

    def estimate(x):
        med = np.array([binned(v, 0.5, 0.005) for v in x.T])
        scale = np.maximum(floor, 1.4826 * np.array([binned(v, 0.5, 0.005) for v in np.abs(x - med).T]))
        _, t = moments(np.tanh((x - med) / scale))
        r = np.sqrt(np.maximum(np.diag(t), 1e-6))
        tries = [(med, np.diag(scale**2)), moments(x), (med, t * np.outer(scale, scale) / np.outer(r, r))]
        for _ in range(quality.TRIAL):
            tries = [concentrate(x, m, c) for m, c in tries]
        m, c = min(tries, key=lambda e: round(logdet(e[1]), 7))
        while logdet((new := concentrate(x, m, c))[1]) < logdet(c) - quality.SETTLED:
            m, c = new
        return m, c

    x = np.array([r[2] for r in rows], float).reshape(-1, len(floor))
    out = np.zeros(len(x))
    for g in {r[:2] for r in rows}:
        own, lang = np.array([r[:2] == g for r in rows]), np.array([r[0] == g[0] for r in rows])
        (m, c), (ml, cl) = estimate(x[own]), estimate(x[lang])
        w = own.sum() / (own.sum() + quality.SHRINK)
        out[own] = dist(x[own], w * m + (1 - w) * ml, factor(w * c + (1 - w) * cl, quality.CONSISTENCY))
    return out


def test_quality_distance(spark):
    rng = np.random.default_rng(1)
    x = rng.multivariate_normal(np.zeros(5), np.eye(5) + 0.5, 640).round(6)
    x[:60] = 12 + x[:60] / 4  # a tenth of the documents stand together far away
    lang = ["en" if i % 8 else "de" for i in range(640)]
    rows = [(i, lang[i], None if i % 5 else "b", *map(float, v)) for i, v in enumerate(x)] + [(900, None, "c", *[3.0] * 5)]
    points = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"{c} double" for c in quality.FEATURES))
    got = np.array([r["d2"] for r in quality.robust_distance(points).orderBy("doc_id").collect()])
    want = brute_mcd([(r[1], r[2], r[3:]) for r in rows])
    assert np.allclose(got, want, rtol=1e-5, atol=1e-5)
    assert (got[:60] > quality.CUT).all() and (got[60:] > quality.CUT).mean() < 0.03


def test_quality_verdict_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality.judge(docs).orderBy("doc_id").collect()
    stats = quality._features(quality.base_statistics(docs)).orderBy("doc_id").collect()
    good = [not r["base_failed"] for r in got]
    want = brute_mcd([(r["lang"], r["source"], [r[c] for c in quality.FEATURES]) for r, g in zip(stats, good, strict=True) if g])
    d2 = np.array([r["d2"] for r in got if not r["base_failed"]])
    assert np.allclose(d2, want, rtol=1e-4, atol=1e-5)
    assert [r["kept"] for r in got if not r["base_failed"]] == (want <= quality.CUT).tolist() and not any(r["kept"] for r in got if r["base_failed"])


def brute_groups(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard(spark, edge, empty, k, percent):
    rng = np.random.default_rng(k)
    rows, base = [], [f"w{x}" for x in rng.integers(0, 1000, 60)]
    for i in range(160):  # near copies of all lengths up to 60, about the boundary sizes too
        w = base[: int(rng.integers(1, 61))] if i % 2 else base[:30]
        for _ in range(int(rng.integers(0, 3))):
            w = [*w[: (p := int(rng.integers(0, len(w))))], f"x{rng.integers(0, 5)}", *w[p + int(rng.integers(0, 2)) :]]
        rows.append((i, " ".join(w)))
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows, k, percent)
    if k == 5:
        return
    out = {(r["doc_id"], r["component_id"]) for r in jaccard.similar_groups(edge, k, percent).collect()}
    assert {(1, 1), (2, 1), (4, 4), (5, 5), (7, 7), (None, None)} <= out
    kept = jaccard.one_of_each(edge)
    assert kept.columns == edge.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 4, 5, 6, 7, 8, 9]
    assert jaccard.one_of_each(empty).count() == 0


def test_jaccard_of_ids(spark):
    big = 2**53 + 1  # neighbours that floats can't tell apart, beside a null id
    rows = [(big, "a2 b2 c2 d2 e2 f2"), (big + 1, "g2 h2 i2 j2 k2 l2"), (None, "a2 b2 c2 d2 e2 f2"), (big + 2, "g2 h2 i2 j2 k2 l2")]
    # an id on two texts ties their classes together; a row without words stays by itself
    rows += [(5, "a b c d e f"), (1, "a b c d e f"), (5, "g h i j k l"), (3, "g h i j k l"), (5, ""), (7, "m n o p q r")]
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    want = [(1, True, 1), (3, True, 1), (5, False, 5), (5, True, 1), (5, True, 1), (7, True, 7), (big, True, big), (big + 1, True, big + 1), (big + 2, True, big + 1)]
    assert sorted((r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in got if r["doc_id"]) == want
    assert [(r["doc_id"], r["component_id"]) for r in got if not r["doc_id"]] == [(None, None)]


def test_jaccard_of_large_groups(spark, monkeypatch):
    from lodestone.llm import workspace

    # blocks of few sets, few centres and hot keys, so that every way is taken
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    monkeypatch.setattr(jaccard, "CENTRES", 2)
    monkeypatch.setattr(workspace, "HOT_ROWS", 4)
    rng = np.random.default_rng(5)
    common = [f"c{x}" for x in range(60)]
    rows = []
    for i in range(150):  # one group of shared passages whose members link in chains, in small parts and not at all
        own = [f"o{i % 9}_{x}" for x in range(int(rng.integers(0, 40)))]
        w = common + own
        w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 3)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[3][1]) for i in range(30)]
    for k, percent in ((3, 90), (5, 80)):
        got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows, k, percent)


def test_names_of_columns_that_operators_use(spark):
    names = ["lost", "lose", "again", "_lose", "_again", "_bad_id", "_md5", "_id", "_source", "_copies", "_copy", "_m", "_toxicity", "_lang", "toxicity", "bad_id", "md5", "copies", "copy", "v", "root", "item", "term", "row_id", "n_tokens", "block", "epoch"]
    rows = spark.createDataFrame([(1, "one two three four five six", "en", "a", 6, *names), (2, "one two three four five six", "en", "a", 6, *names), (3, None, None, None, None, *names)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([(1, "nine ten"), (2, "three four")], "item_id long, text string")
    outs = {
        "jaccard": (jaccard.one_of_each(rows), {1, 3}),
        "decontamination": (decontamination.drop_contaminated(rows, bench), {3}),
        "mixing": (mixing.draw(rows, mixing.mix(rows)), {1, 2, 3}),
        "toxicity": (toxicity.drop_toxic(spark, rows, SF), {1, 2, 3}),
        "sharding": (sharding.ingest(rows).read(), {1, 2, 3}),
    }
    for name, (out, ids) in outs.items():
        assert out.columns == rows.columns, name
        got = out.collect()
        assert {r["doc_id"] for r in got} == ids and all([r[n] for n in names] == names for r in got), name
    assert [r["_lang"] for r in langid.identify(rows, None).collect()] == ["_lang"] * 3


def token_path(name="word_bpe_49k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_token_files(spark, edge, empty):
    from tokenizers import Tokenizer

    path = token_path()
    t = Tokenizer.from_file(path)
    for docs in (edge, empty):
        out = tokenfiles.scratch(spark, "tok")
        tokenfiles.write_tokens(docs, out, path, 2)
        got = tokenfiles.with_crc32(tokenfiles.read_tokens(spark, out)).orderBy("start").collect()
        want = []
        for d in docs.collect():
            ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 2]
            want.append((d["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_tokens"], r["ids_crc32"])) for r in got)
        order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
        assert order == sorted(order) and [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]


def test_tokens_of_any_text_equal_the_tokenizer():
    import random
    import sys
    import unicodedata

    import pyarrow as pa
    from tokenizers import Tokenizer

    hard = [
        "Don't STOP İstanbul, ΑΣ é ́x <|endoftext|> it's, A\xa0B x y naïve. 12,3.. ...", "ﬁ, ǅ. ß ẞ __a _b. a_", "%%% a%%% 'll we'll.", "GAZİ, İ. Dİ! CUMHURİYETİ.. İİ?",
        "J\u030c, T\u0308. <|ENDOFTEXT|>. \u0958, \u1112\u1161\u11ab. 한글, ﾊﾝｶｸ. ½, ²x. x².", "", None, " \n", "a", "\x00, \x1c. a\x1cb.",
    ]
    letters = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    hard += [" ".join(f"a{c}, {c}{c}. X{c}" for c in letters if len(c.lower()) > 1 or c.isalpha() and not unicodedata.normalize("NFC", c).lower().isalpha())]
    rng = random.Random(7)
    near = [c for c in letters if unicodedata.category(c)[0] in "LMNPSZ"]
    signs = list(".,!?;:%$*&#|'_- \t\n") + ["\u0301", "\u0307", "İ", "Σ", "'s", "'ll", "<|endoftext|>"]
    for _ in range(4000):
        hard.append("".join(rng.choice(rng.choice((near, signs, signs, "abcXYZéü"))) for _ in range(rng.randrange(40))))
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        t, own = Tokenizer.from_file(token_path(name)), tokenfiles.encoder(token_path(name))
        assert own.wordwise == (name == "word_bpe_49k.json")
        for _ in range(2):  # the second time from what is kept
            ids, n = own.encode(pa.array(hard, pa.string()))
            at = np.cumsum(n) - n
            for k, text in enumerate(hard):
                assert ids[at[k] : at[k] + n[k]].tolist() == t.encode(text or "", add_special_tokens=False).ids, ascii(text)
    parts = list(tokenfiles.portions(pa.record_batch({"text": pa.array(["x" * (tokenfiles.TEXT_BYTES + 1), None, "", "a", "b" * tokenfiles.TEXT_BYTES])})))
    assert [p.num_rows for p in parts] == [1, 3, 1] or sum(p.num_rows for p in parts) == 5
    kept = tokenfiles._Kept(2)
    assert [kept.get_all([b"%d" % i], lambda ks: [k + b"!" for k in ks]) for i in (1, 2, 3, 1, 4, 1)] == [[b"%d!" % i] for i in (1, 2, 3, 1, 4, 1)]


def test_token_files_have_indexes_and_prune(spark):
    docs = spark.range(0, 200_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("a word "), F.col("id").cast("string")).alias("text")).coalesce(1)
    out = tokenfiles.scratch(spark, "prune")
    tokenfiles.write_tokens(docs, out, token_path(), 2)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = next(f for f in spark.read.orc(out).inputFiles())
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1000 and reader.getStripes().size() >= 1
    wanted = spark.sparkContext._gateway.new_array(jvm.boolean, 6)
    wanted[0], wanted[1] = True, True
    index = reader.rows().readRowIndex(0, wanted, wanted)
    groups = index.getRowGroupIndex()[1].getEntryCount()  # column 1 is doc_id
    assert groups > 1 and index.getBloomFilterIndex()[1].getBloomFilterCount() == groups
    found = tokenfiles.read_tokens(spark, out).where("doc_id = 150000")
    assert [r["doc_id"] for r in found.collect()] == [150_000] and tokenfiles.read_tokens(spark, out).where("doc_id = 150001").count() == 0

    def scanned(condition):
        df = spark.read.orc(out).where(condition).select("doc_id", "n_tokens")
        plan = df._jdf.queryExecution().executedPlan()
        plan.execute().count()
        return plan.collectLeaves().head().metrics().apply("numOutputRows").value()

    assert scanned("doc_id = 150000") <= 2000 and scanned("doc_id between 1000 and 5000") <= 6000  # of 100,000 rows: row groups by range
    assert scanned("doc_id = 150001") == 0  # between two ids of a row group: the Bloom filter


def test_chat(spark, empty):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", None), (1, 1, "assistant", r"\<|turn|> \\|"), (1, 2, "assistant", "<|im_end|>\n"), (1, 3, None, ""), (2, 1, "a\nb", "é\U0001f600"), (None, 1, "assistant", "x")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    for r in chat.read_conversations(chat.format_conversations(turns)).collect():
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [tuple(t) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss_text"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_of_long_texts_and_of_many_turns(spark):
    rows = [(7, 0, "user", LONG * 4), (7, 1, "assistant", "é<|" * 100_000), *[(8, k, ("user", "assistant")[k % 3 > 0], f"t{k}\\") for k in range(3000)]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_conversations(chat.format_conversations(turns)).collect():
        own = [x for x in rows if x[0] == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == [x[2:] for x in own]
        assert r["loss_text"] == "".join(x[3] for x in own if x[2] == "assistant")


def test_chat_query_with_its_own_conversation_in_the_table(spark, tmp_path):
    rows = [(-1, 0, "user", "mine"), (-1, 5, "assistant", None), (3, 0, "assistant", "x"), (3, 0, "assistant", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.op8_chat_format(spark, str(tmp_path)).collect()}
    assert got == {-1: (4, len(chat.TRICKY)), 3: (2, 2)}


def test_language_id(spark, edge, empty):
    d = "/root/testdata/sf0.01"
    got = langid.op9_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    model = langid.train(edge)
    out = langid.identify(edge, model).collect()
    assert {r["lang_pred"] for r in out if r["text"] is None or not r["text"].strip()} == {"und"} and len(out) == edge.count()
    assert langid.identify(empty, langid.train(empty)).count() == 0
    # one context after another: escapes share out what is left
    tree = ContextTree(__import__("pandas").DataFrame({"depth": [0], "ctx": [0]}))
    counts = np.zeros((1, 256), np.float32)
    counts[0, :2] = 3, 1
    p = langid.Languages._probabilities(tree, counts)[0]
    assert abs(p[0] - 3 / 6) < 1e-9 and abs(p[1] - 1 / 6) < 1e-9 and abs(p.sum() - 1) < 1e-9


def test_language_id_against_brute_force(spark):
    texts = {"aa": ["abracadabra", "abba", "a"], "bb": ["barb", "brr ab", "cab"]}
    rows = [(i, k, t) for i, (k, t) in enumerate((k, t) for k, ts in texts.items() for t in ts)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    depth = langid.DEPTH
    every = {(bytes(depth) + t.encode())[i - d : i] for ts in texts.values() for t in ts for i in range(depth, depth + len(t)) for d in range(depth + 1)}

    def probability(counts, ctx, byte):
        seen = counts[ctx]
        n, u = sum(seen.values()), len(seen)
        short = (lambda b: probability(counts, ctx[1:], b)) if ctx else (lambda b: 1 / 256)
        if not n:
            return short(byte)
        return seen[byte] / (n + u) if byte in seen else u / (n + u) * short(byte) / (1 - sum(map(short, seen)))

    for k, name in enumerate(model.names):
        counts = defaultdict(Counter)
        for t in texts[name]:
            raw = bytes(depth) + t.encode()
            for i in range(depth, len(raw)):
                for d in range(depth + 1):
                    counts[raw[i - d : i]][raw[i]] += 1
        for text in ("abra", "zab", "barbara", "brr"):
            raw, bits = bytes(depth) + text.encode(), 0.0
            for i in range(depth, len(raw)):
                ctx = next(raw[i - d : i] for d in range(depth, -1, -1) if raw[i - d : i] in every)
                bits -= math.log2(probability(counts, ctx, raw[i]))
            assert abs(model.lengths([text.encode()])[0, k] - bits) < 1e-3


def brute_ctw(train, text, depth):
    """Weighted probabilities from block probabilities, by definition."""
    counts = defaultdict(lambda: [0, 0])
    for t in train:
        raw = bytes(depth) + t
        for i in range(depth, len(raw)):
            for d in range(depth + 1):
                ctx = raw[i - d : i]
                for bit in range(8):
                    counts[ctx, bit, raw[i] >> (8 - bit)][(raw[i] >> (7 - bit)) & 1] += 1
    seen = {k[0] for k in counts}

    def block(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def longer(ctx):
        return [c for c in seen if len(c) == len(ctx) + 1 and c.endswith(ctx)]

    def weighted(ctx, bit, head):
        own = block(*counts.get((ctx, bit, head), (0, 0)))
        return own if not longer(ctx) else np.logaddexp(own, sum(weighted(c, bit, head) for c in longer(ctx))) - math.log(2)

    def predict(ctx, path, bit, head):
        a, b = counts.get((ctx, bit, head), (0, 0))
        kt = (b + 0.5) / (a + b + 1)
        if not longer(ctx):
            return kt
        stop = 1 / (1 + math.exp(sum(weighted(c, bit, head) for c in longer(ctx)) - block(a, b)))
        nxt = path[len(path) - len(ctx) - 1 :]
        return stop * kt + (1 - stop) * (predict(nxt, path, bit, head) if nxt in seen else 0.5)

    raw, total = bytes(depth) + text, 0.0
    for i in range(depth, len(raw)):
        for bit in range(8):
            one = predict(b"", raw[i - depth : i], bit, raw[i] >> (8 - bit))
            total += math.log10(one if (raw[i] >> (7 - bit)) & 1 else 1 - one)
    return total


def test_mixing_tells_rows_by_their_maps(spark):
    rows = [
        (1, "one text", "a", {"k": "x"}, [{"m": 1}], ({"s": 1},)), (1, "one text", "a", {"k": "y"}, [{"m": 1}], ({"s": 1},)), (1, "one text", "a", {"k": "y"}, [{"m": 2}], ({"s": 1},)),
        (1, "one text", "a", {"k": "y"}, [{"m": 2}], ({"s": 2},)), (2, "one text", "a", {"k": "z", "l": None}, None, None), (2, "one text", "a", None, [None], (None,)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tags map<string,string>, deep array<map<string,long>>, inner struct<m: map<string,long>>")
    out = mixing.draw(docs, mixing.mix(docs))
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    turned = spark.createDataFrame([(1, {"a": 1, "b": 2}), (1, {"b": 2, "a": 1})], "doc_id long, tags map<string,long>")
    assert turned.select(mixing._row_hash(turned)).distinct().count() == 1


def test_lm_against_brute_force(spark):
    texts = ["abab", "abc", "ba"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model, _ = lm.train(docs)
    for t in ("abab", "cab", "", "zé"):
        assert abs(model.log10([t.encode()])[0] - brute_ctw([x.encode() for x in texts], t.encode(), lm.DEPTH)) < 1e-4


def test_lm_scores_contexts_beyond_the_sent_ones(spark, monkeypatch):
    monkeypatch.setattr(lm, "NODES", 9)  # the texts have more contexts
    texts = ["abab", "abc", "ba", "abcabd", "zé"]
    docs = spark.createDataFrame([*enumerate(texts), (4, texts[4])], "doc_id long, text string")
    model, words_ = lm.train(docs.where("doc_id < 3"))
    got = [(r["doc_id"], r["score"]) for r in lm.score(docs, model, words_).collect()]
    assert sorted(i for i, _ in got) == [0, 1, 2, 3, 4, 4]
    for i, score in got:
        assert abs(score - brute_ctw([x.encode() for x in texts[:3]], texts[i].encode(), lm.DEPTH)) < 1e-4


def test_lm_sends_frequent_grams(spark, monkeypatch):
    monkeypatch.setattr(lm, "NODES", 9)
    texts = ["abab", "abc", "ba"]
    raw = [t.encode() for t in texts]
    docs = spark.createDataFrame([*enumerate(texts), (3, "abcabd")], "doc_id long, text string")
    for most in (1 << 20, 3, 0):  # all, some and none of the grams of training
        monkeypatch.setattr(lm, "GRAMS", most)
        model, words_ = lm.train(docs.where("doc_id < 3"))
        scores, rare = model.scored(raw)
        assert len(model.codes) - 1 <= most and bool(rare) == (most < 5)  # there are five: if all are sent, nothing is left to join
        if not rare:
            assert np.allclose(scores, [brute_ctw(raw, t, lm.DEPTH) for t in raw], atol=1e-4)
        for r in lm.score(docs, model, words_).collect():
            assert abs(r["score"] - brute_ctw(raw, [*raw, b"abcabd"][r["doc_id"]], lm.DEPTH)) < 1e-4


def test_lm_base(spark, edge, empty, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 3)  # so that most words go through the shuffled join
    model, counts = lm.train(edge.where("doc_id < 8"))
    c = Counter()
    rows = edge.collect()
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] < 8:
            c.update([*words(lower(r["text"])), None])
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        w = [*words(lower(r["text"])), None]
        want.append((r["doc_id"] or -1, len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)))
    got = [(r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in lm.score(edge, model, counts).collect()]
    assert sorted(got) == sorted(want)
    none, counts = lm.train(empty)
    assert lm.score(empty, none, counts).count() == 0
    assert lm.score(edge, none, counts).where("abs(base_score) > 1e-9 or n_known > 0").count() == 0


def test_lm_keeps_large_counts():
    import pandas as pd

    contexts = ContextTree(pd.DataFrame({"depth": [0, 1], "ctx": [0, 97]}))
    seen = pd.DataFrame({"depth": [0, 0, 1, 1], "ctx": [0, 0, 97, 97], "sym": [97, 98, 97, 98], "n": [10**12, 3, 10**12 - 7, 2]})
    counts = contexts.dense(seen)
    assert counts[0, 97] - counts[1, 97] == 7 and counts[0, 98] == 3


def test_pieces_keep_context():
    from lodestone.llm import bytecontext

    texts = [b"abcdef", b"", b"x" * (bytecontext.PIECE + 5)]
    seen = Counter()
    for flat, at, owner in pieces(texts, 3):
        seen.update(owner.tolist())
        assert ((flat[at] != 0) | (owner == 1)).all()
    assert seen == {0: 6, 2: bytecontext.PIECE + 5}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == docs.columns and 0 < out.select("doc_id").distinct().count() < docs.count()
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {tuple(w[k : k + 10]) for w in (word(t) for _, t in bench) for k in range(max(1, len(w) - 9)) if w}
    for r in out.dropDuplicates(["doc_id"]).collect():
        w = word(r["text"])
        assert not any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    groups = brute_groups([(r["doc_id"], r["text"]) for r in out.dropDuplicates(["doc_id"]).collect()], 5, 80)
    assert all(i == g for i, (_, g) in groups.items())


def test_exceptions_cover_the_same_words_in_linear_time():
    """Nested and repeated exceptions against a walk of all places, and a text of five megabytes."""
    entries, exceptions = {" bad ": 2.0, " awful ": 3.0}, [" not bad ", " not bad at all ", " bad at "]
    lexicon = toxicity.Lexicon(entries, exceptions)
    draw = random.Random(3)
    for _ in range(300):
        text = toxicity.fold(" ".join(draw.choice(["bad", "not", "at", "all", "awful", "x"]) for _ in range(draw.randrange(40))))
        covered = {k for e in exceptions for k in _places(text, e) for k in range(k, k + len(e) - 1)}
        want = {k: w for e, w in entries.items() for k in _places(text, e) if k not in covered}
        assert lexicon.matches(text) == want
    long = toxicity.fold("not bad at all awful " * 250_000)
    start = time.monotonic()
    assert len(lexicon.matches(long)) == 250_000
    assert time.monotonic() - start < 30


def _places(text, entry):
    return [k for k in range(len(text)) if text.startswith(entry, k)]


def test_least_count_never_passes_its_bound(spark):
    """A count whose rows don't fit ends the head, also when rarer counts would fit."""
    counts = [5] + [2] * 20 + [1] * 3
    df = spark.createDataFrame([(n,) for n in counts], "n long")
    for most in (1, 10, 20, 21, 23, 24, 100):
        least = workspace.least_count(df, "n", most)
        assert sum(n >= least for n in counts) == (24 if most >= 24 else 21 if most >= 21 else 1)
    assert workspace.least_count(df.limit(0), "n", 5) > 1 << 62


def test_jaccard_with_an_order_of_few_frequent_shingles(spark, monkeypatch):
    """Links don't depend on how many shingles the order knows."""
    rows = [(i, " ".join(["the same words open every text of this table", *(f"w{(i // 2) * 7 + j}" for j in range(30))])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(i, 37, i - i % 2) for i in range(200)]
    for late in (0, 3, 1 << 20):
        monkeypatch.setattr(jaccard, "LATE", late)
        got = sorted(tuple(r) for r in jaccard.similar_groups(docs, 3, 90).select("doc_id", "n_shingles", "component_id").collect())
        assert got == want


def test_drop_contaminated_equals_the_hits(spark):
    """The rows that go are those that the whole operator calls contaminated."""
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    told = decontamination.contamination(docs, items)
    kept = decontamination.drop_contaminated(docs, items)
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in told.where("not contaminated").select("doc_id").collect())
    assert 0 < kept.count() < docs.count()
