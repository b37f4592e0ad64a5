"""URL lists, vectors and archives."""

import io
from datetime import date, timedelta

import numpy as np
import pytest
from helpers import awkward, normal, oracle

from tessera.llm import additive_quantiser, pfair_mix, queries, url_lists, warc
from tessera.llm.common import fresh_path


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, sf, name):
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet").toPandas() for t in ("documents", "pages")}
    assert normal(queries.QUERIES[name](spark, sf).toPandas()) == normal(oracle(queries.ORACLES[name], **tables))


def test_lists_as_of(spark):
    d = lambda k: date(2024, 1, 1) + timedelta(k)
    entries = [("bad", "x.org", d(5), "add"), ("bad", "x.org", d(10), "remove"), ("bad", "x.org", d(20), "add"), ("spam", "b.x.org", d(8), "add"), ("bad", "y.org", d(3), "add"), ("bad", "y.org", d(3), "remove"), ("bad", None, d(1), "add"), (None, "x.org", d(1), "add"), ("bad", "z.org", None, "add"), ("bad", "x.org", d(6), "noise")]
    entries = spark.createDataFrame(entries, "list string, domain string, day date, action string")
    urls = ["http://X.org/a", "https://u:p@b.x.org:8080/?q", "http://y.org", "http://notx.org", None, "", "mailto:x.org", "http://x.org./", "http://[::1]/"]
    rows = [(u, d(k), "clash") for u in urls for k in (4, 5, 9, 10, 19, 20, 400)] + [("http://x.org", None, "clash"), (urls[0], d(5), "clash")]
    caps = spark.createDataFrame(rows, "url string, fetched date, lists string")
    got = url_lists.temporal_list_join(caps, entries).collect()
    assert len(got) == len(rows)

    def want(u, day):
        host = {0: "x.org", 1: "b.x.org", 2: "y.org", 3: "notx.org", 7: "x.org"}.get(urls.index(u)) if u in urls else "x.org"
        if host is None or day is None:
            return []
        x = (d(5) <= day < d(10) or day >= d(20)) and (host == "x.org" or host.endswith(".x.org"))
        return (["bad"] if x else []) + (["spam"] if host == "b.x.org" and day >= d(8) else [])

    for r in got:
        assert r.lists == want(r.url, r.fetched) and r.n_active == len(r.lists)
    assert url_lists.temporal_list_join(caps.limit(0), entries).count() == 0
    assert url_lists.temporal_list_join(caps, entries.limit(0)).where("n_active > 0").count() == 0


def test_hosts_of_very_many_labels(spark):
    """Every parent that an entry names is looked up, however many labels the host has."""
    d = date(2024, 1, 1)
    deep = ".".join(f"l{k}" for k in range(400))
    caps = spark.createDataFrame([(f"http://{deep}/", d), (f"http://x.{deep}/", d), ("http://l399/", d)], "url string, fetched date")
    entries = [("far", "l398.l399", d, "add"), ("host", deep, d, "add"), ("mid", deep.split(".", 200)[-1], d, "add")]
    got = [r.lists for r in url_lists.temporal_list_join(caps, spark.createDataFrame(entries, "list string, domain string, day date, action string")).orderBy("url").collect()]
    assert got == [["far", "host", "mid"], [], ["far", "host", "mid"]]
    short = spark.createDataFrame(entries[:1], "list string, domain string, day date, action string")
    assert [r.lists for r in url_lists.temporal_list_join(caps, short).orderBy("url").collect()] == [["far"], [], ["far"]]


def brute(x, ids, queries, top):
    out = []
    for q in sorted(queries):
        i = int(np.flatnonzero(ids == q)[0])
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[ids == q] = np.inf
        out += [(q, r + 1, int(ids[k]), d[k]) for r, k in enumerate(np.lexsort((ids, d))[:top]) if np.isfinite(d[k])]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[1000:1400] = x[999]  # one vector four hundred times
    ids = np.arange(3000) * 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = additive_quantiser.nearest_neighbours(df, df.where("vec_id % 100 = 0")).toPandas().sort_values(["query_id", "rank"])
    want = brute(x.astype(np.float64), ids, [i for i in ids if i % 100 == 0], 10)
    right = {(q, v) for q, _, v, _ in want}
    assert len(got) == len(want) and len(right & set(zip(got.query_id, got.vec_id, strict=True))) >= 0.9 * len(right)
    exact = {(q, v): d for q, _, v, d in want}
    assert all(abs(exact[q, v] - s) < 1e-12 for q, v, s in zip(got.query_id, got.vec_id, got.score, strict=True) if (q, v) in exact)


@pytest.mark.parametrize("noise", [0.001, 0.02])
def test_neighbours_in_a_tight_cluster(spark, noise):
    """A third of the vectors are near copies of one: no neighbour is lost among them."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12288, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0] + noise * rng.normal(size=x[::3].shape).astype(np.float32)
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = additive_quantiser.nearest_neighbours(df, df.where("vec_id % 100 = 0")).toPandas().sort_values(["query_id", "rank"])
    want = brute(x.astype(np.float64), ids, [i for i in ids if i % 100 == 0], 10)
    hits = {(q, v) for q, _, v, _ in want} & set(zip(got.query_id, got.vec_id, strict=True))
    assert len(got) == len(want) == len(hits)


def test_recall_of_the_query(spark):
    """The query itself, on all embeddings: blocks are full there."""
    import pandas as pd

    table = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet").sort_values("vec_id")
    x, ids = np.array(table.embedding.tolist(), np.float64), table.vec_id.to_numpy()
    got = additive_quantiser.op6_additive_quantiser(spark, "/root/testdata/sf0.1").toPandas()
    want = brute(x, ids, [i for i in ids if i % 100 == 0], 10)
    hits = {(q, v) for q, _, v, _ in want} & set(zip(got.query_id, got.vec_id, strict=True))
    assert len(got) == len(want) and len(hits) >= 0.9 * len(want)


def test_the_index_alone_finds_most(spark, monkeypatch):
    """What lookup tables put first, without the exact search of the rest."""
    monkeypatch.setattr(additive_quantiser, "within", lambda q, x, books, score, errors, worst: np.zeros(score.shape, bool))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8000, 32)).astype(np.float32) + 4 * rng.normal(size=(40, 32)).astype(np.float32)[rng.integers(0, 40, 8000)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = additive_quantiser.nearest_neighbours(df, df.where("vec_id % 100 = 0")).toPandas()
    want = {(q, v) for q, _, v, _ in brute(x.astype(np.float64), np.arange(8000), range(0, 8000, 100), 10)}
    assert len(want & set(zip(got.query_id, got.vec_id, strict=True))) >= 0.9 * len(want)


def test_neighbours_of_very_large_and_small_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    x[100:200] *= 1e200
    x[200:] *= 1e-200
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, additive_quantiser.nearest_neighbours(df, df.where("vec_id % 20 = 0"), top=5).collect()))
    want = []
    for q in range(0, 300, 20):
        gap = np.abs(x - x[q])
        d = np.array([np.ldexp(np.sqrt((np.ldexp(g, -int(np.frexp(g.max())[1])) ** 2).sum()), int(np.frexp(g.max())[1])) for g in gap])
        d[q] = np.inf
        want += [(q, r + 1, int(k), d[k]) for r, k in enumerate(np.lexsort((np.arange(300), d))[:5])]
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-14, atol=0)


def test_neighbours_awkward(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0]), (8, [0.0, 1.0]), (9, [1.0, 0.0]), (100, [0.5, 0.5]), (200, None), (300, [0.0, 0.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "q", 1.0) for r in rows], "vec_id long, embedding array<double>, query_id string, score double")
    got = [tuple(r) for r in additive_quantiser.nearest_neighbours(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got] == [(0, 1, 7), (0, 2, 9), (0, 3, 100), (0, 4, 8), (100, 1, 0), (100, 2, 0), (100, 3, 7), (100, 4, 8), (100, 5, 9)]
    assert additive_quantiser.nearest_neighbours(df.limit(0), df).count() == 0 and additive_quantiser.nearest_neighbours(df, df.limit(0)).count() == 0


def test_beam_search_beats_greedy():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    books = additive_quantiser.fit(x, books=4, words=32)
    error = lambda beam: ((x - sum(books[m][additive_quantiser.encode(x, books, beam)[0][:, m]] for m in range(4))) ** 2).sum()
    assert error(4) <= error(1)
    codes, norms = additive_quantiser.encode(x, books)
    assert np.allclose(norms, (sum(books[m][codes[:, m]] for m in range(4)) ** 2).sum(1), rtol=1e-3, atol=1e-3)


def test_archives_round_trip(spark):
    big = "<p>long</p>" * 100_000
    rows = [(1, "http://a/é\r\nX: y", "a" * 100), (2, None, "a" * 100), (3, "u", "a" * 99), (4, "u", "a" * 99), (5, "u", None), (6, "u", ""), (7, "u", big), (None, "u", "a" * 100), (None, None, "b" * 200), (None, "v", "b" * 200), (1, "w", "a" * 100), (8, "ü", "日本" * 50)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, payload string")
    folder = fresh_path(spark, "test-warc")
    got = warc.read_archives(spark, warc.write_archives(pages, folder)).collect()
    assert sorted((r.row_id or "", r.url or "", bytes(r.payload or b"")) for r in got if r.record_type == "response") == sorted((str(i or ""), u or "", (h or "").encode()) for i, u, h in rows if (i, h) not in {(2, "a" * 100), (None, "a" * 100)})
    assert sorted(((r.row_id or "", r.refers_to) for r in got if r.record_type == "revisit")) == [("", "1"), ("2", "1")]
    mine = spark.createDataFrame([(r.row_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    assert normal(mine.toPandas()) == normal(oracle(warc.ORACLE, pages=pages.select("page_id", "url", "html").toPandas()))
    none = warc.write_archives(pages.limit(0), fresh_path(spark, "test-warc"))
    assert warc.read_archives(spark, none).count() == 0


def test_archive_begins_with_its_dictionary(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    listed = warc.write_archives(pages, str(tmp_path)).collect()
    data = open(listed[0].path.removeprefix("file:"), "rb").read()
    assert data[:4] == warc.DICTIONARY_FRAME.to_bytes(4, "little")
    plain = sum(len(r.html.encode()) for r in pages.collect())
    assert sum(r.stored_bytes for r in listed) < plain and sum(r.records for r in listed) == pages.count()
    at = len(data) - 30
    damaged = io.BytesIO(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(Exception):  # noqa: B017  the frame's checksum, or the record's digest
        list(warc.read_records(damaged))


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language ID", "quality rules", "n-gram Jaccard join", "mixing", "BPE"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, sf), "test-stage")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > sizes[0] // 2
    last = p.STAGES[-1][1](spark, docs, sf)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == sizes[-1]
    odd = awkward(spark).select(columns)
    for _, stage in p.STAGES:
        odd = p.materialize(stage(spark, odd, sf), "test-stage")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, awkward(spark).select(columns).limit(0), sf).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """run() on small texts with planted noise, shared lines and near copies, against plain Python stage by stage."""
    import hashlib
    import random
    import re
    from collections import Counter

    from test_documents_ops import brute_classes
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from tessera.llm import bpe, ppm

    rng = random.Random(9)
    stock = {"en": [f"wo{a}{b}d" for a in "aeiou" for b in "lrnst"], "fr": [f"mé{a}{b}e" for a in "aeiou" for b in "lrnst"]}
    body = lambda lang, n: " ".join(rng.choice(stock[lang]) + rng.choice(["", "s", "er"]) for _ in range(n))
    rows = []
    for k in range(240):
        lang = "fr" if k % 4 == 0 else "en"
        lines = [body(lang, 40), body(lang, 60)] + (["Follow us  on the NETWORK today"] if k % 3 else [])
        rows.append([k, "\n".join(lines), None if k % 50 == 7 else lang, f"h{k % 3}"])
    for k in range(240, 270):  # near copies, with one word changed
        words = rows[k - 240][1].split(" ")
        words[5] = "changed"
        rows.append([k, " ".join(words), rows[k - 240][2], "h0"])
    rows += [[300 + k, " ".join("".join(rng.choice("qxzjkv0189") for _ in range(7)) for _ in range(80)), None, "h1"] for k in range(5)]
    rows += [[310, "short text", "en", "h2"], [311, None, "en", "h2"], [312, "12 34 " * 60, None, "h2"]]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = p.run(spark, str(tmp_path)).collect()

    from pyspark.sql import functions as F

    model = ppm.learn(ppm.training_sample(docs, "lang", "text", F.col("doc_id")))
    kept = []
    for i, t, lang, s in rows:
        if t and any(c.isalpha() for c in t):
            bits = model.lengths(__import__("pyarrow").array([t]))[0]
            if bits.min() <= model.longest(model.langs[int(bits.argmin())], len(t.encode())):
                kept.append((i, t, s))
    assert not {r[0] for r in kept} & {300, 301, 302, 303, 304, 311, 312} and {r[0] for r in kept} >= set(range(270))
    key = lambda line: " ".join(w.lower() for w in line.split())
    often = Counter((s, x) for _, t, s in kept for x in {key(line) for line in t.split("\n")})
    hosts = Counter(s for *_, s in kept)
    gone = {(s, x) for (s, x), n in often.items() if n > 20 and 100 * n > 2 * hosts[s] and x}
    clean = []
    for i, t, s in kept:
        lines = t.split("\n")
        left = [x for x in lines if (s, key(x)) not in gone]
        words, windows = t.split(), Counter(zip(t.split(), t.split()[1:], t.split()[2:], strict=False))
        covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        if len(words) >= 50 and len(covered) <= 0.5 * len(words) and sum(len(x.split()) for x in left) >= 0.3 * len(words):
            clean.append((i, "\n".join(left), s))
    assert gone and len(clean) < len(kept)
    unique = [(i, t, s) for (i, t, s), low in zip(clean, [c for _, _, c in sorted(brute_classes([(i, t) for i, t, _ in clean], 5, 80), key=lambda r: r[0])], strict=True) if i == low]
    assert {r[0] for r in unique} == set(range(240)) - {r[0] for r in rows[:240] if not any(c[0] == r[0] for c in clean)}
    t = Tokenizer.from_file(bpe.default_tokenizer())
    want = {}
    for i, text, _ in unique:
        ids = t.encode(text, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
    texts = spark.createDataFrame([(i, x, s) for i, x, s in unique], "doc_id long, text string, source string")
    order = [r.doc_id for r in pfair_mix.mix_sources(texts).orderBy("mix_position").collect()]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.mix_position)] == order
    assert re.fullmatch(r"[0-9a-f]{64}", got[0].ids_sha256)


def test_pipeline_keeps_the_order_of_the_mixture(spark, tmp_path, monkeypatch):
    """run()'s rows have the places that the mixing stage's weights give them."""
    import corpus_pipeline as p

    rows = [(k, f"text {k}", "en", "hot" if k < 150 else "cold", 8) for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")

    def order(mixing):
        monkeypatch.setattr(p, "STAGES", [("mixing", mixing), ("BPE", p.tokens)])
        got = sorted((r.mix_position, r.doc_id) for r in p.run(spark, str(tmp_path)).collect())
        assert [k for k, _ in got] == list(range(200)) and sorted(i for _, i in got) == list(range(200))
        return [i for _, i in got]

    mix = lambda weights: lambda spark, docs, sf_dir: pfair_mix.mixed(docs, weights=weights, block=1).select(p.COLUMNS)
    for share, weights in ((0.75, {"hot": 3, "cold": 1}), (0.5, {"hot": 1, "cold": 1})):
        hot = np.cumsum([i < 150 for i in order(mix(weights))])[:99]
        assert (abs(hot - share * np.arange(1, 100)) < 1).all()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert order(p.mixture) == [r.doc_id for r in pfair_mix.mix_sources(docs).orderBy("mix_position").collect()]
    assert order(p.mixture) != order(lambda spark, docs, sf_dir: docs.orderBy("doc_id"))
