"""The manifest, phrases and pieces on edge cases, and against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import collocations, merkle, piecebpe

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string, phrase string, n long, id long, ids array<int>"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, "a", "en", 5, f"Text {i} of a hot source") for i in range(300)]
    rows += [(7, "a", "en", 5, "text 7 again"), (7, "a", "en", 5, "Text 7 of a hot source"), (None, "a", None, None, None), (None, None, None, None, ""), (5, None, "en", 1, None), (1, "b", "de", 0, "Ünï ▁ ▁▁x\n\n  é日本𓀀\x00")]
    rows += [(i, "c", "en", 1, "x" * i) for i in range(17)] + [(9, "", "en", 2, "wort" * 30_000 + " so lang, so. " * 9_000)]
    rows += [(i, f"s{i}", "en", 1, "ONE") for i in range(40)]
    return spark.createDataFrame([(*r, "x", "y", "z", 1, 2, [3]) for r in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(digests, size=16):
    """The root of some digests and, for each, its steps as (left, right) pairs."""
    level, where, steps = list(digests), list(range(len(digests))), [[] for _ in digests]
    while len(level) > 1:
        for i, at in enumerate(where):
            low = at // size * size
            steps[i].append(("".join(level[low:at]), "".join(level[at + 1 : low + size])))
        level = [sha("".join(level[k : k + size])) for k in range(0, len(level), size)]
        where = [at // size for at in where]
    return level[0], steps


def brute_manifest(rows):
    leaves = defaultdict(list)
    for r in rows:
        fields = [r["doc_id"], r["source"], r["lang"], r["n_chars"]]
        tampered = lower(r["text"]) if r["text"] is not None and zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0 else r["text"]
        leaf, found = (sha("".join(map(told, [*fields, t]))) for t in (r["text"], tampered))
        leaves[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, found, r["doc_id"]))
    sources = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(leaves[s], key=lambda x: x[:3]), *brute_tree([x[2] for x in sorted(leaves[s], key=lambda x: x[:3])])) for s in sources}
    root, tops = brute_tree([trees[s][1] for s in sources])
    for s, top in zip(sources, tops, strict=True):
        members, subroot, steps = trees[s]
        for (_, _, leaf, found, doc), own in zip(members, steps, strict=True):
            for left, right in own + top:
                found = sha(left + found + right)
            yield doc, leaf, subroot, root, sha("".join(a + b for a, b in own + top)), found, found == root


def test_merkle_against_brute_force(spark, edge, empty, tmp_path):
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_manifest(edge.collect())))
    none = merkle.build(empty.select("doc_id", "source", F.lit("").alias("leaf")))
    assert none.root is None and merkle.prove(none).count() == 0


def test_merkle_of_one_row_and_of_other_runs(spark, edge):
    one = merkle.build(edge.limit(1).select("doc_id", "source", merkle.leaf_of().alias("leaf")))
    row = merkle.prove(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] == one.root and row["proof"] == []
    pairs = merkle.prove(merkle.build(edge.select("doc_id", "source", merkle.leaf_of().alias("leaf")), fanout=2))
    assert pairs.where(merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).count() == edge.count()
    assert pairs.where("size(proof) > 12").count() > 0


def brute_phrases(rows, least, top, share):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        out = []
        for p, a in found.items():
            if any(100 * b >= share * a for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            out.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(out)[:top], 1):
            yield lang, rank, p.decode(), -a, left, right, n[lang], -score


def phrase_rows():
    rnd = random.Random(3)
    words = ["New", "york", "city", "hall", "the", "of", "é", "b", "c"]
    rows = [("".join(w + rnd.choice([" ", " ", " ", "\t", ", ", "\n", "  "]) for w in rnd.choices(words, [9, 9, 9, 9, 9, 5, 5, 2, 1], k=rnd.randrange(40))), rnd.choice(["en", "de", None, "und"])) for _ in range(400)]
    return rows + [("new york city hall. " * 50, "en"), ("same same same same same " * 40, "fr"), (None, "en"), ("", None), (" .,\n", "en"), ("new york", "en"), ("a " * 100_000, "long")]


@pytest.mark.parametrize("buckets", [1 << 16, None])
def test_collocations_against_brute_force(spark, empty, buckets, monkeypatch):
    monkeypatch.setattr(collocations, "FAN_IN", 2)  # sums in several rounds
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, n long, phrase string, h long").repartition(7)
    got = collocations.collocations(docs, least=5, top=25, buckets=buckets)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_phrases(rows, 5, 25, 80))
    assert collocations.collocations(empty).count() == 0


def test_full_buckets_drop_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 64)
    rows = phrase_rows()[:-1]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = collocations.collocations(docs, least=5, top=25, buckets=64)  # nearly every bucket is full
    assert sorted(map(tuple, got.collect())) == sorted(brute_phrases(rows, 5, 25, 80))


def test_blocks_of_texts():
    block = collocations._Block(pa.array(["A b,c", "", None, "d", " e\tf\n\ng"]), pa.array(["x", "x", "x", None, "x"]))
    assert block.words.take(pa.array(block.id)).to_pylist() == ["a", "b", "c", "d", "e", "f", "g"]
    assert block.langs.take(pa.array(block.id)).to_pylist() == ["x", "x", "x", "und", "x", "x", "x"]
    assert block.joined.tolist() == [True, False, False, False, True, False]


def test_tally_sums_what_it_holds(monkeypatch):
    monkeypatch.setattr(collocations, "HELD_ROWS", 10)
    tally, seen = collocations._Tally(), Counter()
    for k in range(40):
        t = pa.table([pa.array(["en"] * 3), pa.array([f"p{i}" for i in (0, 1, k)], pa.large_string()), pa.array([0, 1, k]), pa.array([1, 2, 5])], collocations.COUNTED)
        for b in tally.add(t):
            seen.update({p: n for p, n in zip(b["phrase"].to_pylist(), b["n"].to_pylist(), strict=True)})
    for b in tally.rest():
        for p, n in zip(b["phrase"].to_pylist(), b["n"].to_pylist(), strict=True):
            seen[p] += n
    assert seen["p0"] == 45 and seen["p1"] == 85 and sum(seen.values()) == 320


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def check_texts(own, library, texts):
    ids, n = own.encode(pa.array(texts, pa.string()))
    at = np.concatenate([[0], np.cumsum(n)])
    want = library.encode([t or "" for t in texts])
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == want[k], t
    whole = [[1, *w, 2] for w in want]
    said = own.decode(np.array([i for w in whole for i in w], np.int64), np.array(list(map(len, whole)), np.int64))
    assert [t.decode() for t in said] == (library.decode(whole) if whole else [])


def test_pieces_equal_the_library(model, library):
    own, rnd = piecebpe.pieces(model), random.Random(5)
    for texts in ([], [None], [""], ["", None, " ", "  ", "\n", "\na", "▁x", " ▁ ", "\x00é", "日本𓀀", "<s></s>", "<0x41>", " " * 40 + "abc" + " " * 17, "a" * 5000, "ab" * 3000 + "𓀀" * 50]):
        check_texts(own, library, texts)
    some = ["e", "t", "a", "the", "ing", " ", "  ", "▁", "\n", "1", "=", "==", "-", "é", "日", "𓀀", "\x00", "aa", "//", "ly", "tion", "s", "er", "re"]
    for pool, most in ((some, 60), (list(own.ids), 12)):  # the pieces themselves, side by side
        check_texts(own, library, ["".join(rnd.choices(pool, k=rnd.randrange(most))) for _ in range(4000)])
    check_texts(own, library, ["".join(chr(rnd.choice([rnd.randrange(1, 0x250), rnd.randrange(0x4E00, 0x5000), rnd.randrange(0x1F300, 0x1F700)])) for _ in range(30)) for _ in range(1000)])


def test_any_ids_decode_as_in_the_library(model, library):
    own, rnd = piecebpe.pieces(model, piecebpe.Surface), random.Random(6)
    draw = [lambda: rnd.choice([0, 1, 2]), lambda: rnd.randrange(3, 259), lambda: rnd.randrange(0xE3, 0xF3), lambda: rnd.randrange(0x83, 0xC3), lambda: rnd.randrange(259, 32000), lambda: 28705]
    lists = [[rnd.choice(draw)() for _ in range(rnd.randrange(9))] for _ in range(6000)]
    said = own.decode(np.array([i for x in lists for i in x]), np.array(list(map(len, lists))))
    for x, t in zip(lists, said, strict=True):
        assert t.decode() == library.decode(x), x


def test_encode_and_decode_tables(spark, edge, empty, model, library, tmp_path):
    rows = edge.collect()
    got = {}
    for r in piecebpe.decode(piecebpe.encode(edge, model), model).collect():
        got.setdefault(r["id"], []).append((r["ids"], r["text"]))
    want = {}
    for r in rows:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.setdefault(r["doc_id"], []).append((ids, library.decode(ids)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    lists = spark.createDataFrame([(1, None), (2, []), (3, [1, 2])], "id long, ids array<int>")
    assert [r["text"] for r in piecebpe.decode(lists, model).orderBy("id").collect()] == [None, "", ""]
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    digests = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in piecebpe.op13_piece_bpe(spark, str(tmp_path)).collect()}
    assert digests == {(k, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), sha(t)) for k, v in want.items() for i, t in v}
    assert piecebpe.encode(empty, model).count() == 0
