"""Shards, near duplicates, licences, quality, languages, tokens and mixture on awkward rows and against brute force."""

import hashlib
import random
import tracemalloc
import zlib
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import SCHEMA, awkward, normal, oracle

from tessera.llm import bpe, kd_shards, license_scan, partenum, pfair_mix, ppm, quality_rules
from tessera.llm.common import components, ranked


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def near_copies(spark, seed=3, groups=12):
    """Groups of texts with a few words changed, so that links of every strength occur."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([5, 9, 20, 60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            mine = list(words)
            for _ in range(rng.randrange(0, max(2, len(words) // 25) + 1)):
                mine[rng.randrange(len(mine))] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(mine)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_classes(rows, n, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))]
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if find(j) == find(k) and sets[j][0] is not None]
        out.append((i, len(s), (min(ids) if ids else None) if s else i))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, n, percent):
    df = near_copies(spark, seed=n)
    got = partenum.ngram_jaccard_join(df, n=n, percent=percent)
    assert sorted(map(tuple, got.collect()), key=str) == brute_classes([tuple(r) for r in df.collect()], n, percent)


def test_jaccard_join_in_blocks_and_with_hot_signatures(spark, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK_NODES", 3)
    monkeypatch.setattr(partenum, "HOT_EVERY", 1)
    monkeypatch.setattr(partenum, "HOT_COUNT", 4)
    df = near_copies(spark, seed=11)
    got = partenum.ngram_jaccard_join(df, n=4, percent=85)
    assert sorted(map(tuple, got.collect()), key=str) == brute_classes([tuple(r) for r in df.collect()], 4, 85)


def test_jaccard_join_of_a_star_with_hot_signatures(spark, monkeypatch):
    """Every copy links with the base text, and hardly any two copies with each other."""
    monkeypatch.setattr(partenum, "HOT_EVERY", 1)
    monkeypatch.setattr(partenum, "HOT_COUNT", 4)
    rng, base, rows = random.Random(5), [f"w{k}" for k in range(300)], []
    for k in range(400):
        mine = list(base)
        for at in rng.sample(range(4, 292, 8), 6):
            mine[at] = f"z{rng.randrange(10**9)}"
        rows.append((k + 1, " ".join(mine)))
    df = spark.createDataFrame([(0, " ".join(base)), *rows], "doc_id long, text string")
    got = sorted(map(tuple, partenum.ngram_jaccard_join(df, n=4, percent=85).collect()), key=str)
    assert got == brute_classes([tuple(r) for r in df.collect()], 4, 85) and {r[2] for r in got} == {0}


def test_jaccard_join_awkward(spark):
    df = awkward(spark)
    got = partenum.ngram_jaccard_join(df, n=4, percent=85)
    assert sorted(map(tuple, got.collect()), key=str) == brute_classes([(r.doc_id, r.text) for r in df.collect()], 4, 85)
    assert partenum.ngram_jaccard_join(empty(spark)).count() == 0
    kept = {r.doc_id for r in partenum.deduplicate(df, n=5, percent=80).collect()}
    assert {1, 4, 5, 7} <= kept and not {2, 8} & kept


def test_one_row_of_each_class_stays(spark):
    """Ids that repeat within a class or between classes, and null ids."""
    texts = [" ".join(f"{x}{k}" for k in range(50)) for x in "abcd"]
    rows = [(1, texts[0])] * 30 + [(None, texts[0])] * 3 + [(None, texts[1])] * 4 + [(5, texts[0]), (5, texts[2]), (9, texts[2]), (None, texts[3]), (2, ""), (2, None), (None, "")]
    got = partenum.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), n=5, percent=80)
    want = [(1, texts[0]), (None, texts[1]), (5, texts[2]), (None, texts[3]), (2, ""), (2, None), (None, "")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("size", [1, 2, 3, 5, 6, 7, 9, 13, 40, 200, 1000])
def test_similar_sets_share_a_signature(size, percent):
    """Equal sets are one node and need none."""
    rng = np.random.default_rng(size)
    bands = partenum.Bands(percent)
    for _ in range(40):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = a.copy()
        for _ in range(rng.integers(0, size // 5 + 2)):
            c = np.unique(np.r_[np.delete(b, rng.integers(len(b), size=rng.integers(0, 2))), rng.integers(0, 2**63, rng.integers(0, 2), dtype=np.uint64)])
            if len(c) and 100 * len(np.intersect1d(a, c)) >= percent * len(np.union1d(a, c)):
                b = c
        assert np.array_equal(a, b) or len(np.intersect1d(partenum.signatures(a, bands), partenum.signatures(b, bands)))


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_are_fewer_than_shingles(percent):
    rng = np.random.default_rng(percent)
    bands = partenum.Bands(percent)
    for size in [60, 61, 75, 90, 100, 130, 200, 300, 450, 600, 900, 1500, 2200, 3300, 5000]:
        got = [len(partenum.signatures(np.unique(rng.integers(0, 2**63, size, dtype=np.uint64)), bands)) for _ in range(10)]
        assert max(got) <= 0.75 * size


@pytest.mark.parametrize("parts", [1, 16, 211])
def test_links_between_texts_of_a_template(spark, parts):
    """Pairs that share one word more than all texts of a template: 57 of 65 shingles, against 56 of 66."""
    rng = random.Random(parts)
    common = [f"c{k}" for k in range(59)]
    own = lambda n: [f"o{rng.randrange(10**12)}" for _ in range(n)]
    texts = [common + own(5) for _ in range(8000)]
    for k in range(300):
        texts += [[*common, f"pair{k}", *own(4)] for _ in range(2)]
    rng.shuffle(texts)
    rows = list(enumerate(map(" ".join, texts)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = dict(partenum.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), n=4, percent=85).select("doc_id", "component_id").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    first = {}
    want = {i: first.setdefault(t[59], i) if t[59].startswith("pair") else i for i, t in enumerate(texts)}
    assert got == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 3), *[(100, k) for k in range(101, 130)], (129, 60)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {k: v for k, v in got.items() if k < 10} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 1, 8: 1}
    assert {v for k, v in got.items() if k >= 60} == {60}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranked(spark):
    df = spark.range(1000).selectExpr("if(id < 900, 'hot', cast(id % 3 as string)) as g", "id * 7919 % 1000 as k", "id")
    got = ranked(df, ["g"], ["k"], "r", "t").toPandas()
    for _, part in got.groupby("g"):
        assert part.sort_values("r").k.is_monotonic_increasing and sorted(part.r) == list(range(len(part)))


def test_shards(spark):
    sf = "/root/testdata/sf0.01"
    got = kd_shards.op1_kd_shards(spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    assert sorted(got.doc_id) == sorted(docs.index)
    assert all(r.size_ == len(docs[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in got.rename(columns={"size": "size_"}).itertuples())
    assert set(got.shard) <= set(range(24)) and got.grown_shard.isna().all() and set(got.law) == {"bytes"}
    assert all(sorted(p.slot) == list(range(len(p))) for _, p in got.groupby("shard"))
    assert got.groupby("text_crc32").shard.nunique().max() == 1


def test_shards_have_equal_bytes_even_of_copies(spark):
    rows = [(k, "copy " * 40 if k % 3 == 0 else f"text {k} " * (1 + k % 60)) for k in range(3000)]
    got = kd_shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=24).toPandas()
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 24 and by.max() - by.min() < 0.06 * by.mean()
    assert len(kd_shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), target_bytes=100_000).select("shard").distinct().collect()) >= 5


def brute_shards(rows, leaves, whole, first=0):
    """Shards by a plain recursive k-d tree. rows: (dimensions, hash of the text, id, size)."""
    if leaves == 1 or not rows:
        return {r[2]: first for r in rows}
    spread = [(max(r[0][d] for r in rows) - min(r[0][d] for r in rows)) / max(1, whole[d]) for d in range(len(whole))]
    d = spread.index(max(spread))
    rows = sorted(rows, key=lambda r: (r[0][d], r[1], r[2]))
    goal, at = sum(r[3] for r in rows) * (leaves // 2) / leaves, 0
    for k, r in enumerate(rows):
        if at + r[3] >= goal:
            break
        at += r[3]
    k += goal - at > at + rows[k][3] - goal
    return brute_shards(rows[:k], leaves // 2, whole, first) | brute_shards(rows[k:], leaves - leaves // 2, whole, first + leaves // 2)


@pytest.mark.parametrize(("leaves", "bins"), [(24, 4096), (7, 4), (130, 64)])
def test_shards_equal_a_recursive_tree(spark, monkeypatch, leaves, bins):
    """Without tolerances every cut lies where a sort of the node's rows puts it."""
    from pyspark.sql import functions as F

    for name, value in (("TOLERANCE", 0), ("COPIES", 0), ("BINS", bins), ("REWRITE", 2)):
        monkeypatch.setattr(kd_shards, name, value)
    rng = random.Random(leaves)
    texts = ["é\n" * rng.randrange(40) + "x" * rng.choice([0, 3, 50, 400]) + f"{rng.randrange(60)}" for _ in range(900)] + ["copy"] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = dict(df.select("doc_id", F.xxhash64("text")).collect())
    size = lambda t: len(t.encode())
    rows = [((size(t), size(t) - len(t), t.count("\n")), hashes[k], k, size(t) + 8) for k, t in enumerate(texts)]
    whole = [max(r[0][d] for r in rows) - min(r[0][d] for r in rows) for d in range(3)]
    got = dict(kd_shards.kd_shards(df, shards=leaves).select("doc_id", "shard").collect())
    assert got == brute_shards(rows, leaves, whole)


def test_shards_awkward(spark):
    got = kd_shards.kd_shards(awkward(spark), shards=5).toPandas()
    assert len(got) == 16 and all(sorted(p.slot) == list(range(len(p))) for _, p in got.groupby("shard"))
    assert got[got.doc_id == 4].iloc[0]["size"] == 8
    assert kd_shards.kd_shards(empty(spark), shards=24).count() == 0
    assert kd_shards.kd_shards(empty(spark), target_bytes=10).count() == 0


def test_licences_awkward(spark):
    df = awkward(spark)
    got = license_scan.license_scan(df)
    assert normal(got.drop("blocks").toPandas()) == normal(oracle(license_scan.ORACLE, documents=df.select("doc_id", "text").toPandas()))
    row = got.where("doc_id = 11").first()
    assert (row.n_base, row.labels, row.score, len(row.blocks)) == (2, "mit", 1.0, 1)
    assert license_scan.license_scan(empty(spark)).count() == 0


def test_licences_find_reworded_notices(spark):
    texts = ["work is licensed under gnu general public license version 3", "mit license", "apache mit license mit license apache license", "licensed, CC by-nc 4.0!", "licensed cc by nc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(df).collect()}
    assert got[0].labels == "gpl" and got[0].score > 0.8
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 1, 5, "apache,mit")
    assert got[3].labels == "cc-by-nc" and got[3].base_labels == "" and got[4].labels == ""
    assert normal(license_scan.license_scan(df).drop("blocks").toPandas()) == normal(oracle(license_scan.ORACLE, documents=df.toPandas()))


def test_licences_find_wrapped_notices(spark):
    """Notices as they are published, wrapped and in the middle of long lines; and short ones that only resemble."""
    import textwrap

    filler = " ".join(f"word{k}" for k in range(150))
    texts, want = [], []
    for label, _, text in license_scan.TEMPLATES:
        notice = " ".join(text.split())
        for shape in (textwrap.fill(notice, 40), textwrap.fill("# " + notice, 72).replace("\n", "\n# "), f"{filler} {notice} {filler}", f"{filler}\n{textwrap.fill(notice, 75)}"):
            texts.append(shape)
            want.append(label)
    texts += ["Released under the GPL License.", "Licensed under CC BY 4.0.", "Permission is hereby denied, free of charge, to any person obtaining a copy of software"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(df).collect()}
    assert all(w in got[k].labels.split(",") and got[k].score == 1.0 for k, w in enumerate(want))
    assert [got[k].labels for k in range(len(want), len(texts))] == ["", "", ""]
    assert normal(license_scan.license_scan(df).drop("blocks").toPandas()) == normal(oracle(license_scan.ORACLE, documents=df.toPandas()))


def test_quality_awkward(spark):
    df = awkward(spark)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = quality_rules.quality_rules(df).select(cols)
    assert normal(got.toPandas()) == normal(oracle(quality_rules.ORACLE, documents=df.select("doc_id", "text", "source").toPandas()))
    assert quality_rules.quality_rules(empty(spark)).count() == 0
    assert quality_rules.apply_quality_rules(empty(spark)).columns == empty(spark).columns


def test_quality_removes_lines_that_a_host_repeats(spark):
    body = lambda k, n: " ".join(f"word{k}x{j}" for j in range(n))
    rows = [(k, f"Subscribe  to our LETTER now\n{body(k, 60)}", "h") for k in range(30)] + [(100, "\n".join(["subscribe to our letter now"] * 12), "h"), (101, f"Subscribe to our letter now\n{body(101, 60)}", "other")]
    rows += [(200 + k, f"only here\n{body('same', 70)}", "h") for k in range(40)]  # copies of a document count like others
    rows += [(300 + k, f"and here\n{body('few', 70)}", "h") for k in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert got[0].kept and got[0].n_removed == 5 and not got[100].kept and got[101].n_removed == 0 and not got[200].kept and got[200].n_removed == 72 and got[300].kept and got[300].n_removed == 0
    kept = {r.doc_id: r.text for r in quality_rules.apply_quality_rules(df).collect()}
    assert kept[0] == body(0, 60) and 100 not in kept and 200 not in kept and kept[300] == rows[-1][1]
    assert len(kept) == 46
    assert normal(quality_rules.quality_rules(df).drop("n_removed", "gone_lines").toPandas()) == normal(oracle(quality_rules.ORACLE, documents=df.toPandas()))


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ppm.op7_ppm_language(spark, "/root/testdata/sf0.01").toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def slow_length(trees, text, order):
    """Code length by walking contexts byte by byte."""
    total = 0.0
    for i in range(len(text)):
        for k in range(min(order, i), -1, -1):
            n = trees[k].get(text[i - k : i])
            if n is None:
                continue
            whole = sum(n.values()) + len(n)
            if text[i] in n:
                total -= np.log2(n[text[i]] / whole)
                break
            total -= np.log2(len(n) / whole)
        else:
            total += 8.0
    return total


def test_code_lengths_equal_a_walk_of_the_tree():
    rng = random.Random(5)
    samples = {lang: [" ".join(rng.choice(words) for _ in range(50)).encode() for _ in range(8)] for lang, words in (("a", ["the", "then", "other", "thé"]), ("b", ["der", "das", "und", "ander"]))}
    model = ppm.fit(samples, order=3)
    texts = ["the other und", "zzz ander", "é", "", "thén" * 40]
    got = ppm.code_lengths(model, pa.array(texts))
    for j, lang in enumerate(model.langs):
        trees = [{} for _ in range(4)]
        for s in samples[lang]:
            for i in range(len(s)):
                for k in range(min(3, i) + 1):
                    n = trees[k].setdefault(s[i - k : i], {})
                    n[s[i]] = n.get(s[i], 0) + 1
        assert np.allclose(got[:, j], [slow_length(trees, t.encode(), 3) for t in texts], rtol=1e-4)


def test_long_texts_are_scored_whole(monkeypatch):
    model = ppm.fit({"a": [b"abcabcabd" * 20], "b": [b"xyzxyzab" * 20]}, order=2)
    text = pa.array(["abcabd" * 500, None, "xyz" * 100])
    whole = ppm.code_lengths(model, text)
    monkeypatch.setattr(ppm, "SLICE_BYTES", 64)
    assert np.allclose(ppm.code_lengths(model, text), whole, rtol=1e-5)


def test_scoring_holds_little_beside_its_input():
    """Executors have hardly more than their heap and two workers' input left."""
    rng = random.Random(5)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(n))
    languages = ppm.learn({x: [text(x, 300).encode() for _ in range(4)] for x in ("abcdefgh", "ijklmnop", "qrstuvwx", "efghijkl")})
    for texts in ([text("abcdijkl", 150) for _ in range(1500)], [text("abcdijkl", 1000) * 150]):
        tracemalloc.start()
        languages.lengths(pa.array(texts))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 16 << 20


def test_languages_are_the_same_in_parts(spark, monkeypatch):
    df = awkward(spark)
    rows = lambda: sorted(map(str, ppm.identify_languages(df, df).drop("score", "bits_per_byte").collect()))
    whole = rows()
    monkeypatch.setattr(ppm, "PART_ROWS", 2)
    assert rows() == whole and len(whole) == 16


def test_every_label_has_a_model(spark):
    """Seventy languages, and one whose texts are all longer than what is taken of a text."""
    rng = random.Random(2)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)] for k in range(70)}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(100 * j + k, text(lang, 30), lang) for j, lang in enumerate(words) for k in range(6)]
    words["long"] = ["".join(rng.choice("αβγδεζηθικλμνξο") for _ in range(6)) for _ in range(40)]
    rows += [(10_000 + k, text("long", 3000), "long") for k in range(3)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(k, text(lang, 20), lang) for k, lang in enumerate(words)], "doc_id long, text string, want string")
    got = ppm.identify_languages(asked, train).collect()
    assert len(got) == 71 and all(r.lang_pred == r.want and r.is_usual for r in got)
    junk = spark.createDataFrame([(1, " ".join("".join(rng.choice("qxzjkvwy0123") for _ in range(8)) for _ in range(50)))], "doc_id long, text string")
    assert not ppm.identify_languages(junk, train).first().is_usual


def test_tables_of_contexts_lose_none():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 2**40, 5000, dtype=np.uint64))
    model = ppm.Model(["a"])
    keys, rows = ppm._table(codes)
    model.keys, model.rows = [keys], [rows]
    assert (ppm._find(model, 0, codes) == np.arange(len(codes))).all()
    others = np.setdiff1d(rng.integers(0, 2**40, 5000, dtype=np.uint64), codes)
    assert (ppm._find(model, 0, others) == -1).all()


def test_languages_awkward(spark):
    df = awkward(spark)
    got = ppm.identify_languages(df, df)
    assert got.columns == [*df.columns, "lang_pred", "score", "bits_per_byte", "is_usual"] and got.count() == 16
    assert {r.lang_pred for r in got.where("text is null or trim(text) = ''").collect()} == {"und"}
    assert ppm.identify_languages(df, empty(spark)).where("lang_pred <> 'und'").count() == 0
    assert ppm.identify_languages(empty(spark), df).count() == 0


def test_tokens_equal_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    t = Tokenizer.from_file(path)
    df = awkward(spark).select("doc_id", "text").union(spark.createDataFrame([(20, "it's we'll  \r\n x9 ÀÉ  z​…"), (21, "a<|endoftext|>b <|endoftext|>"), (22, "﻿a\x00b")], "doc_id long, text string"))
    for size in (bpe.CHUNK_BYTES, 100):
        monkeypatch.setattr(bpe, "CHUNK_BYTES", size)
        got = bpe.encode_decode(df, path).toPandas()
        want = []
        for i, text in ((r.doc_id, r.text or "") for r in df.collect()):
            ids = t.encode(text, add_special_tokens=False).ids
            want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t.decode(ids, skip_special_tokens=False)))
        mine = [("None" if r.doc_id != r.doc_id else str(int(r.doc_id)), r.n_tokens, hashlib.sha256(r.ids).hexdigest(), r.decoded) for r in got.itertuples()]
        assert sorted(mine) == sorted(want)
    assert bpe.encode_decode(empty(spark), path).count() == 0


def test_workers_keep_no_tokenizer():
    """Spark keeps its workers, and what they hold counts against the operators that come next."""
    path, schema = bpe.default_tokenizer(), pa.schema([("k", pa.list_(pa.int64())), ("n", pa.int64()), ("i", pa.binary()), ("t", pa.string())])
    assert bpe.added_tokens(path) and bpe._tokenizer.cache_info().currsize
    none = pa.table({k: pa.array([], pa.binary()) for k in ("keys", "sizes", "codes", "counts", "ids")})
    pieces = SimpleNamespace(value=(np.zeros(1, np.int64), np.zeros(0, np.uint8)))
    assert bpe._texts(schema, pieces)(none, none).num_rows == 0
    assert not bpe._tokenizer.cache_info().currsize and not bpe.added_tokens.cache_info().currsize


def test_words_split_where_the_library_may_not_join():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    rng = random.Random(1)
    alphabet = ["a", "é", "1", "'s", "'", " ", "  ", "\n", "\t", " ", " ", "　", "\x1c", "\x85", "!", "_", "中", "́", "‍"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        words = bpe.split_words(text, None)
        assert "".join(words) == text
        assert [i for w in words for i in t.encode(w, add_special_tokens=False).ids] == t.encode(text, add_special_tokens=False).ids


def brute_mix(parts, blocks):
    """Earliest deadline first, slot by slot, over growing j."""
    done, out, left = dict.fromkeys(parts, 0), [], dict(blocks)
    while any(left.values()):
        live = {k: parts[k] for k in parts if left[k]}
        whole, own, t = sum(live.values()), dict.fromkeys(live, 0), 0
        while all(left[k] for k in live):
            ready = [k for k in live if own[k] * whole // live[k] <= t]
            k = min(ready, key=lambda k: (-(-(own[k] + 1) * whole // live[k]), -live[k], k))
            out.append((k, done[k]))
            own[k], done[k], left[k], t = own[k] + 1, done[k] + 1, left[k] - 1, t + 1
            assert all(abs(own[s] - t * live[s] / whole) < 1 for s in live)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_schedule_equals_earliest_deadline_first(seed):
    rng = random.Random(seed)
    names = [f"s{k}" for k in range(rng.randrange(1, 6))]
    parts = pfair_mix.whole_parts({k: rng.random() + 0.05 for k in names}, 40)
    blocks = {k: rng.randrange(0, 60) for k in names}
    slots = {}
    for k, first, end, base, own, length, within in pfair_mix.phases(parts, blocks):
        for b in range(first, end):
            q, r = divmod(b - first, own)
            slots[base + q * length + within[r]] = (k, b)
    assert [slots[t] for t in sorted(slots)] == brute_mix(parts, blocks) and sorted(slots) == list(range(sum(blocks.values())))


@pytest.mark.parametrize("count", [2, 21, 101])
def test_schedule_keeps_to_the_exact_weights(count):
    """At any slot each source is less than a block from its share by the weights that are given, not rounded ones."""
    weights = {"half": 0.5, "tiny": 0.0001, "small": 0.0009} | {f"s{k:03}": 0.499 / count for k in range(count)}
    blocks = {"half": 30_000, "tiny": 3, "small": 200} | {f"s{k:03}": 25_000 // count for k in range(count)}
    exact = {k: Fraction(w) for k, w in weights.items()}
    done, ends = dict.fromkeys(blocks, 0), sorted({Fraction(n) / exact[k] for k, n in blocks.items()})
    at, v, live = Fraction(0), Fraction(0), sum(exact.values())  # T(v) = at; slope ``live`` up to the next end
    for t, (k, b, slot) in enumerate(pfair_mix.schedule(weights, blocks), 1):
        assert slot == t - 1 and b == done[k]
        done[k] += 1
        while ends and at + (ends[0] - v) * live <= t:
            at, v = at + (ends[0] - v) * live, ends[0]
            ends, live = ends[1:], sum(exact[s] for s, n in blocks.items() if Fraction(n) / exact[s] > v)
        if t % 499 == 0 or t > 49_990:
            now = v + (t - at) / live if live else v
            assert all(abs(done[s] - min(exact[s] * now, n)) < 1 for s, n in blocks.items())
    assert done == blocks


@pytest.mark.parametrize("seed", range(8))
def test_exact_schedule_equals_periodic_one_while_no_source_runs_out(seed):
    rng = random.Random(seed)
    parts = pfair_mix.whole_parts({f"s{k}": rng.random() + 0.05 for k in range(rng.randrange(1, 6))}, 40)
    blocks = {k: rng.randrange(300, 500) for k in parts}
    # A window has 41 slots at most: those of these slots end before the first share is used up.
    until = int(min(n * sum(parts.values()) / parts[k] for k, n in blocks.items())) - 41
    got = [(k, b) for k, b, _ in pfair_mix.schedule({k: float(n) for k, n in parts.items()}, blocks)]
    assert got[:until] == brute_mix(parts, blocks)[:until] and len(set(got)) == sum(blocks.values())


def test_every_one_of_many_sources_has_its_weight(spark):
    """The smallest of 400 sources has the largest weight: its rows come at its own rate."""
    rows = [(k, f"t{k}", f"s{k % 400:03}") for k in range(4000)] + [(4000 + k, f"u{k}", "tail") for k in range(9)]
    weights = {f"s{k:03}": 1.0 for k in range(400)} | {"tail": 400.0}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pfair_mix.mix_sources(df, weights=weights, block=1).toPandas()
    assert sorted(got.doc_id) == list(range(4009)) and sorted(got.mix_slot) == list(range(4009))
    assert sorted(got[got.source == "tail"].mix_slot // 2) == list(range(9))
    # From slot 18 on the 400 others have a slot each of every 400.
    per = got[(got.source != "tail") & (got.mix_slot >= 18)].assign(turn=lambda x: (x.mix_slot - 18) // 400)
    assert per.groupby(["source", "turn"]).size().max() <= 2


def test_weights_of_zero_come_last():
    got = [k for k, _, _ in pfair_mix.schedule({"a": 0.0, "b": 0.3, "c": 0}, {"a": 2, "b": 5, "c": 2})]
    assert got == ["b"] * 5 + ["a", "c"] * 2
    with pytest.raises(ValueError, match="negative"):
        list(pfair_mix.schedule({"a": -1.0}, {"a": 1}))


def test_mixture(spark):
    rows = [(k, f"t{k}", "hot" if k % 3 else f"s{k % 5}") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pfair_mix.mix_sources(df, block=16).toPandas()
    assert sorted(got.doc_id) == list(range(4000)) and got.mix_position.is_unique
    assert (got.mix_slot == got.mix_position // 16).all() and got.groupby("mix_slot").source.nunique().max() == 1
    aw = pfair_mix.mix_sources(awkward(spark), block=2)
    assert aw.count() == 16 and aw.select("mix_position").distinct().count() == 16
    assert pfair_mix.mix_sources(empty(spark)).count() == 0
    order = [r.doc_id for r in pfair_mix.mixed(df, block=16).collect()]
    assert order == got.sort_values("mix_position").doc_id.tolist()
