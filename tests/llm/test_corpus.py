"""Corpus operators against brute force, DuckDB, tiktoken and round trips, on small fixtures with awkward rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from quarry.llm import bpe, chat_format, components, hash_forest, language_id, license_scan, line_dedup, mixing, ngram_jaccard, queries, shingles, token_counts, topk_search
from quarry.llm.common import numbered
from tests.conftest import SF
from tests.test_queries import compare

PATH = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(bpe.load_ranks(PATH)), special_tokens={})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    compare(queries.QUERIES[name](spark, SF), duck, queries.ORACLES[name])


# Connected components


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5)]
    best = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                best[a] = best[b] = min(best[a], best[b])
    out = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == best


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# N-gram Jaccard join


def _shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def _jaccard_brute(rows):
    sets = [(i, _shingles(t)) for i, t in rows]
    comp = {i: i for i, _ in sets}
    pairs = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    for _ in range(len(sets)):
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return sorted((i, len(s), comp[i]) for i, s in sets)


def _near_copies(rng, base, n, most):
    out = []
    for _ in range(n):
        ws = list(base)
        for _ in range(rng.randrange(most)):
            ws[rng.randrange(len(ws))] = rng.choice(WORDS)
        out.append(" ".join(ws))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_ngram_jaccard(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "One two", "one TWO", "a b c d", "a b c d e", "A B c d e", "é É x", " ".join(WORDS * 30)]
    passage = [rng.choice(WORDS) for _ in range(60)]
    for _ in range(8):  # families around the limit, and a passage that many share
        base = [rng.choice(WORDS) for _ in range(rng.choice([30, 80, 200]))]
        texts += _near_copies(rng, base, 14, 9)
        texts.append(" ".join(passage + [rng.choice(WORDS) for _ in range(100)]))
    texts += [texts[20]] * 30 + _near_copies(rng, [rng.choice(WORDS) for _ in range(120)], 80, 6)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, sig string, n int, `group` string").repartition(7)
    out = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard_join(df).collect())
    assert out == _jaccard_brute(rows)


def test_ngram_jaccard_edges(spark):
    schema = "doc_id long, text string"
    assert ngram_jaccard.ngram_jaccard_join(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f")]
    out = sorted(((r.doc_id, r.component_id) for r in ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert out == [(3, 3), (7, 3), (7, 3), (None, None)]


def test_ngram_jaccard_lets_small_groups_ask_large_ones(spark, monkeypatch):
    made, real = {}, ngram_jaccard.written
    monkeypatch.setattr(ngram_jaccard, "written", lambda df, name: made.setdefault(name, real(df, name)) if name == "members" else real(df, name))
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"x{rng.random()}" for _ in range(30))) for i in range(20)]
    # Most share a key with many others, some with none.
    rows += [(100 + i, " ".join(w if rng.random() > 0.03 else f"y{rng.random()}" for w in base)) for i in range(120)]
    out = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == _jaccard_brute(rows)
    sizes = made["members"].groupBy("group").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).collect()
    sizes.sort(key=lambda r: -r["size"])
    assert sizes[0]["size"] >= 4 and sizes[-1]["size"] == 1
    assert all(a["high"] < b["low"] for a in sizes for b in sizes if a["size"] >= 2 * b["size"])


def test_ngram_jaccard_of_repeated_ids(spark):
    """An id with two texts is two documents; neither lends the other its links."""
    a, b = "a b c d e f g", "q r s t u v w"
    rows = [(1, a, "x"), (1, b, "y"), (2, b, "z"), (3, a, None), (None, a, "w"), (4, "", "v"), (4, None, "v")]
    out = ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=["text", "source"]).collect()
    assert len(out) == len(rows)
    got = {(r.doc_id, r.kept.text, r.kept.source): r for r in out}
    assert got[1, a, "x"]["class"] == got[3, a, None]["class"] != got[1, b, "y"]["class"] == got[2, b, "z"]["class"]
    assert [got[k].component_id for k in ((1, a, "x"), (3, a, None), (2, b, "z"), (None, a, "w"), (4, "", "v"))] == [1, 1, 1, None, 4]
    assert got[None, a, "w"]["class"] is None and got[4, None, "v"]["class"] is None


def test_shingle_sets_of_slices():
    texts = ["A b c d e f g", "", "x y", "a B c d E f g", "q " * 9]
    import pyarrow as pa

    (_, _, buf, offs), *_ = shingles.slices(pa.array(texts))
    tokens, at = shingles.shingle_sets(buf, offs)
    assert np.diff(at).tolist() == [3, 0, 1, 3, 1]
    assert (tokens[at[0] : at[1]] == tokens[at[3] : at[4]]).all()


# Searches


def _vectors(rng, n=600, d=8):
    v = [[float(x) for x in rng.normal(size=d)] for _ in range(n)]
    v[10] = v[20] = v[30] = v[40]
    rows = list(enumerate(v)) + [(50, v[50]), (1000, None), (1001, []), (1002, [float("nan")] * d), (1003, [1.0, None] * (d // 2)), (1004, [float("inf")] * d), (1005, [0.0] * d), (None, v[0])]
    return rows, {i: x for i, x in enumerate(v)} | {1005: [0.0] * d}


def _brute(valid, every, k, score):
    out = []
    for q in sorted(valid):
        if q % every == 0:
            ranked = sorted(((-score(valid[q], x), i) for i, x in valid.items() if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    return out


def test_exact_top_k(spark, monkeypatch):
    for name, value in (("PER_PIVOT", 64), ("RING", 16), ("BLOCK", 8), ("TILE", 4), ("TOGETHER", 1)):
        monkeypatch.setattr(topk_search, name, value)
    rows, valid = _vectors(np.random.default_rng(1))
    df = spark.createDataFrame([(i, x, 1, "t") for i, x in rows], "vec_id long, embedding array<double>, pivot int, tile string").repartition(5)
    ints = {i: [int(np.floor(256 * c)) for c in x] for i, x in valid.items()}
    want = _brute(ints, 50, 5, lambda a, b: sum(p * q for p, q in zip(a, b, strict=True)))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.exact_top_k(df).collect()) == want


@pytest.mark.parametrize("search", [topk_search.exact_top_k, hash_forest.nearest])
def test_searches_of_little(spark, search):
    schema = "vec_id long, embedding array<float>"
    assert search(spark.createDataFrame([], schema)).count() == 0
    assert search(spark.createDataFrame([(0, None)], schema)).count() == 0
    assert search(spark.createDataFrame([(0, [1.0, 2.0])], schema)).count() == 0
    out = search(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [3.0, 3.0])], schema)).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in out] == [(0, 2), (0, 1)]


def test_nearest_recall(spark):
    df = spark.read.parquet(SF.replace("0.001", "0.01") + "/embeddings.parquet")
    valid = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    want = _brute(valid, 20, 20, lambda a, b: float(a @ b))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in hash_forest.nearest(df).collect()]
    assert all(abs(valid[q] @ valid[i] - s) < 1e-12 for q, _, i, s in got)
    hit = {(q, i) for q, _, i, _ in want} & {(q, i) for q, _, i, _ in got}
    assert len(got) == len(want) and len(hit) / len(want) >= 0.9


def test_exact_top_k_prunes(spark, monkeypatch):
    """Where vectors cluster, the bound keeps queries out of most annuli, and the results are those of brute force."""
    for name, value in (("PER_PIVOT", 50), ("RING", 16), ("BLOCK", 16), ("TILE", 8)):
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(3)
    centres = 20 * rng.normal(size=(12, 6))
    v = {i: [float(x) for x in centres[i % 12] + rng.normal(size=6)] for i in range(960)}
    v |= {960 + i: v[0] for i in range(200)}  # one vector that many rows have
    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>").repartition(5)
    out = topk_search.exact_top_k(df).collect()
    ints = {i: [int(np.floor(256 * c)) for c in x] for i, x in v.items()}
    want = _brute(ints, 50, 5, lambda a, b: sum(p * q for p, q in zip(a, b, strict=True)))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == want
    assert np.mean([r.scored for r in out]) < 0.7 * len(v)


def test_exact_top_k_refuses_what_does_not_fit(spark):
    df = spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e9, 2e9])], "vec_id long, embedding array<double>")
    with pytest.raises(ArithmeticError):
        topk_search.exact_top_k(df)


def test_nearest_ties_and_bad_rows(spark):
    """With a chance next to 1 and few vectors every neighbour is met, so places and ties are those of brute force."""
    rows, valid = _vectors(np.random.default_rng(2))
    del valid[1005]
    rows += [(10, valid[10]), (600, valid[40]), (601, valid[40])]
    valid |= {600: valid[40], 601: valid[40]}
    df = spark.createDataFrame([(i, x, 1, 0.5, 7) for i, x in rows], "vec_id long, embedding array<double>, tree int, score double, query_id int").repartition(3)
    want = _brute(valid, 20, 20, lambda a, b: float(np.dot(a, b)))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in hash_forest.nearest(df, sure=1 - 1e-12).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(got, want, strict=True))


def test_nearest_stops_where_neighbours_stand_out(spark):
    """Near neighbours end the ascent early: far fewer vectors are met, at the same recall."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(80, 32))
    v = {i: centres[i % 80] + 0.1 * rng.normal(size=32) for i in range(4000)}
    v = {i: x / np.linalg.norm(x) for i, x in v.items()}
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in v.items()], "vec_id long, embedding array<double>")
    out = hash_forest.nearest(df, every=200).collect()
    want = _brute(v, 200, 20, lambda a, b: float(np.dot(a, b)))
    hit = {(q, i) for q, _, i, _ in want} & {(r.query_id, r.vec_id) for r in out}
    assert len(hit) / len(want) >= 0.9 and np.mean([r.scored for r in out]) < len(v)  # brute force


def test_nearest_looks_around_among_many_under_one_prefix(spark):
    """More than START alike strings: those around a query are not the first ones, and the ascent looks at all."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=8)
    v = {i: base + 1e-4 * rng.normal(size=8) for i in range(3000)}
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in v.items()], "vec_id long, embedding array<double>")
    out = hash_forest.nearest(df, every=300).collect()
    want = _brute(v, 300, 20, lambda a, b: float(np.dot(a, b)))
    hit = {(q, i) for q, _, i, _ in want} & {(r.query_id, r.vec_id) for r in out}
    assert len(hit) / len(want) >= 0.9


@pytest.mark.parametrize("search", [topk_search.exact_top_k, hash_forest.nearest])
def test_searches_of_several_lengths(spark, search):
    """Vectors are searched among those of their length, a lone one finds nothing."""
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (100, [1.0]), (101, [4.0]), (102, [2.0]), (200, [1.0] * 5)]
    out = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in out) == [(0, 1, 1), (100, 1, 101), (100, 2, 102)]


# License scan


def test_templates_are_all_there():
    assert set(license_scan.TEMPLATES) - set(license_scan.NOTICES) == {
        "Apache-2.0", "Artistic", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2", "GPL-3", "ISC", "LGPL-2.1", "LGPL-3", "MIT", "MPL-2.0", "Unlicense", "Zlib"
    }
    assert len(license_scan.NOTICES) == 14 and all(len(t) > 600 for k, t in license_scan.TEMPLATES.items() if k not in license_scan.NOTICES)


def test_license_scan_edges(spark):
    long = " ".join(["filler"] * 5000) + " " + license_scan.TEMPLATES["MIT/grant"] + " end"
    rows = [(1, "x Released under the MIT License. y"), (2, None), (3, ""), (4, "released UNDER the mit license"), (5, "released under the license"), (6, long), (None, "Released under the MIT License."), (7, "Licensed under")]
    df = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, license string")
    out = {(r.doc_id, r.license): (r.containment, r.word_pos) for r in license_scan.license_scan(df).collect()}
    assert set(license_scan.NOTICES) < set(license_scan.TEMPLATES) and len(license_scan.TEMPLATES["GPL-3"]) > 30_000
    assert out == {(1, "MIT/line"): (1.0, 1), (4, "MIT/line"): (1.0, 0), (6, "MIT/grant"): (1.0, 5000)}
    again = df.unionByName(df).withColumns({"shingle": F.lit(1), "span": F.lit("s"), "w": F.lit(2), "part": F.lit(3)}).repartition(5)
    assert {(r.doc_id, r.license): (r.containment, r.word_pos) for r in license_scan.license_scan(again).collect()} == out
    assert license_scan.license_scan(df.limit(0)).count() == 0 and license_scan.license_scan(df, templates={}).count() == 0


def test_license_scan_equals_brute_force(spark, duck):
    """Whole, cut and changed licenses in other text, ragged at every stride, against SQL over all windows."""
    rng = random.Random(8)
    rows = []
    for name, text in license_scan.TEMPLATES.items():
        ws = text.split()
        for share in (0.0, 0.02, 0.04):
            kept = [w for w in ws if rng.random() >= share]
            rows.append((len(rows), " ".join(["own"] * rng.randrange(40) + kept + ["words"] * rng.randrange(9)), name))
        rows.append((len(rows), " ".join(ws[: rng.randrange(len(ws))]), name))
    df = spark.createDataFrame(rows, "doc_id long, text string, license string").repartition(4)
    duck.register("scanned", df.toPandas())
    compare(license_scan.license_scan(df), duck, license_scan.oracle().replace("FROM documents", "FROM scanned"))


# Language ID


def test_language_decoding_equals_a_plain_version():
    """Margins, losses and the nearest codeword, recomputed trigram by trigram."""
    import pyarrow as pa

    rng = random.Random(6)
    said = {"en": ["the cat and the dog", "a house in the wood"], "de": ["der Hund und die Katze", "ein Haus im Wald"], "fr": ["le chat et le chien", "une maison"], "xx": ["zz qq zz"]}
    counts = {k: np.zeros(language_id.SLOTS) for k in said}

    def slots(text):
        b = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()]
        grams = [b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)]
        return [1 + int(shingles.mix(np.array([g], np.uint64))[0] % (language_id.SLOTS - 1)) for g in grams if g != 0x202020]

    for k, texts in said.items():
        for t in texts:
            for x in slots(t):
                counts[k][x] += 1
    model = language_id.Model(counts)
    texts = ["the dog", "Die Katze!", "le chien et une maison", "zz", "ab", "", "12   34", "and der le " * 100] + ["".join(rng.choice("abcdez é ") for _ in range(30)) for _ in range(40)]
    (_, _, buf, offs), *_ = shingles.slices(pa.array(texts))
    best, score, lead = model.decode(model.margins(buf, offs))
    share = {k: (counts[k] + 0.5) / (counts[k].sum() + 0.5 * language_id.SLOTS) for k in said}
    codes = {k: list(c) for k, c in zip(sorted(said), model.codes, strict=True)}
    for d, text in enumerate(texts):
        own = slots(text)
        losses = []
        for k in sorted(said):
            loss = 0.0
            for bit in range(len(codes[k])):
                plus, minus = ([x for x in said if codes[x][bit] == s] for s in (1, -1))
                margin = sum(np.log(np.mean([share[x][g] for x in plus])) - np.log(np.mean([share[x][g] for x in minus])) for g in own)
                margin *= language_id.WEIGHT * min(len(own), language_id.FULL_EVIDENCE) / max(len(own), 1) / len(codes[k]) * 4
                loss += np.log1p(np.exp(-margin * codes[k][bit]))
            losses.append(loss)
        p = np.exp(min(losses) - np.array(losses))
        p /= p.sum()
        assert abs(p.max() - score[d]) < 1e-3 and abs(np.sort(p)[-1] - np.sort(p)[-2] - lead[d]) < 2e-3
        assert lead[d] < 2e-3 or best[d] == int(p.argmax())


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12, 40):
        m = language_id.codewords(n)
        assert (m @ m.T - m.shape[1] * np.eye(n)).max() < m.shape[1] and m.shape[0] == n


def test_language_accuracy(spark):
    df = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    out = language_id.identify_languages(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 100 and np.mean([r.lang == r.lang_pred for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark):
    rows = [(i, "the cat and the dog", "en", 1) for i in range(20)] + [(100 + i, "der Hund und die Katze", "de", 1) for i in range(20)]
    rows += [(200, None, "en", 1), (201, "", "en", 1), (202, "12 34 !?", "en", 1), (203, "und die Katze", None, 1), (None, "the dog", "xx", 1), (204, "the dog " * 50_000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = {r.doc_id: r for r in language_id.identify_languages(df).collect()}
    assert [out[i].lang_pred for i in (200, 201, 202, 203, None, 204)] == ["und", "und", "und", "de", "en", "en"]
    assert out[200].score == 0.0 and out[200].ambiguous and len(out) == len(rows)
    nothing = language_id.identify_languages(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert language_id.identify_languages(df.limit(0)).count() == 0


def test_columns_of_any_name_are_carried(spark, reference):
    df = spark.createDataFrame([(1, "the cat", "a", 2, "k"), (2, None, "b", 3, "k")], "doc_id long, text string, _text string, _letter int, kept string")
    for out in (language_id.predict(df, language_id.Model({})), bpe.bpe_encode(df, PATH, P.PATTERN)):
        got = {r.doc_id: r for r in out.collect()}
        assert set(df.columns) < set(out.columns) and (got[2]["_text"], got[2]["_letter"], got[1].kept, got[1].text) == ("b", 3, "k", "the cat")


# Line dedup


def test_line_dedup(spark):
    rows = [(i, "http://A.example.com/x", f"menu\nown {i}\n\n menu \ntail", "h") for i in range(40)] + [(100 + i, "https://b.org", f"menu\nother {i}", "h") for i in range(3)]
    rows += [(200, None, "menu\nx", "h"), (201, "http://a.example.com", None, "h"), (202, "http://a.example.com:80/", "", "h"), (None, "http://a.example.com", "menu\nz", "h"), (203, "no url", "menu", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, text string, host string")
    out = {r.page_id: (r.text, r.lines_dropped) for r in line_dedup.line_dedup(df, text_col="text").collect()}
    assert all(out[i] == (f"own {i}\n", 3) for i in range(40)) and all(out[100 + i] == (f"other {i}", 1) for i in range(3))
    assert out[200] == ("menu\nx", 0) and out[201] == (None, 0) and out[202] == ("", 0) and out[None] == ("z", 1) and out[203] == ("menu", 0)
    assert line_dedup.line_dedup(df.limit(0), text_col="text").count() == 0


def test_line_dedup_on_small_hosts(spark):
    """The ratio holds on hosts of any size; what one page says alone stays."""
    rows = [(i, "http://a.b", f"own {i}\nfooter") for i in range(9)] + [(50, "http://one.page", "all\nits\nlines")]
    rows += [(60 + i, "http://c.d", f"own {i}\nseldom" if i < 2 else f"own {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, text string")
    out = {r.page_id: r.text for r in line_dedup.line_dedup(df, text_col="text").collect()}
    assert all(out[i] == f"own {i}" for i in range(9)) and out[50] == "all\nits\nlines" and out[60] == "own 0\nseldom"
    kept = {r.page_id: r.text for r in line_dedup.line_dedup(df, text_col="text", min_pages=10).collect()}
    assert kept[0] == "own 0\nfooter"


def test_line_dedup_of_repeats_and_clashing_columns(spark):
    """A page that is there 20 times is one page; columns with the operator's names pass through."""
    names = ["page_id long", "url string", "text string", "host string", "gone string", "page string", "id long", "t1 long", "_host string", "lines string", "lines_dropped long"]
    more = ("h", "g", "p", 7, 8, "_h", "l", 9)
    rows = [(1, "http://a.b", "x\ny", *more)] * 20 + [(10 + i, "http://a.b", f"own {i}\nfooter", *more) for i in range(20)]
    df = spark.createDataFrame(rows, ", ".join(names)).repartition(6)
    out = line_dedup.line_dedup(df, text_col="text")
    assert sorted(out.columns) == sorted(df.columns) and len(set(out.columns)) == len(out.columns)
    got = out.collect()
    assert sorted(r.text for r in got) == sorted(["x\ny"] * 20 + [f"own {i}" for i in range(20)])
    assert {(r.host, r.gone, r.page, r.id, r.t1, r["_host"], r.lines) for r in got} == {more[:7]}


def test_line_dedup_of_a_long_page(spark):
    long = "\n".join(x for i in range(50_000) for x in (f"line {i}", "menu"))
    rows = [(1, "http://a.b", long), (2, "http://a.b", "menu\nshort")]
    out = {r.page_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "page_id long, url string, text string"), text_col="text").collect()}
    assert out[1].lines_dropped == 50_000 and out[1].text.split("\n")[-1] == "line 49999" and out[2].text == "short"


# Chat formatting


def test_chat_format(spark):
    said = defaultdict(list)
    rng = random.Random(3)
    chain = [("user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(9)]
    said |= {1: chain[:2], 2: chain[:5], 3: chain, 4: chain[:3] + [("user", "else")], 5: chain, 6: [("user", None)], 7: [("user", "")], 8: chain[:1], 9: [(None, "t0")]}
    said[10] = [("user", f"long {k}") for k in range(700)]
    said[11] = said[10][:600]
    rows = [(c, t, r, x, 1) for c, ts in said.items() for t, (r, x) in enumerate(ts)] + [(None, 0, "user", "lost", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int")
    out = defaultdict(str)
    for r in chat_format.format_chats(df).orderBy("conv_id", "part").collect():
        out[r.conv_id] += r.text
        assert r.n_turns == len(said[r.conv_id])
    kept = [c for c, ts in said.items() if not any(o != c and said[o][: len(ts)] == ts and (len(said[o]) > len(ts) or o < c) for o in said)]
    assert dict(out) == {c: "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in said[c]) for c in kept}
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_format_of_turns_without_order(spark):
    """100,000 turns under one number or none, repeated rows and a very long turn: pieces are cut by running number."""
    many = [(1, None if k % 2 else 7, "user", f"t{k % 30_000:05d}") for k in range(100_000)]
    rows = [*many, (2, 0, "user", "x" * 300_000), *[(3, 1, "user", "same")] * 3000]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    digests = chat_format.prefix_digests(df)
    sizes = {r.conv_id: (r.n, r.m, r.d) for r in digests.groupBy("conv_id").agg(F.count("pos").alias("n"), F.max("pos").alias("m"), F.countDistinct("pos").alias("d")).collect()}
    assert sizes == {1: (100_000,) * 3, 2: (1, 1, 1), 3: (3000,) * 3}
    out = defaultdict(str)
    for r in chat_format.format_chats(df).orderBy("conv_id", "part").collect():
        out[r.conv_id] += r.text
    order = sorted(many, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    assert out[1] == "".join(f"<|im_start|>user\n{t}<|im_end|>\n" for _, _, _, t in order)
    assert len(out[2]) > 300_000 and out[3].count("same") == 3000


# Token counts


@pytest.mark.parametrize("block", [4, 10, 64, 1 << 20])
def test_token_counts(spark, tmp_path, block):
    rng = random.Random(block)
    files, want = {}, []
    for f in range(4):
        docs = [[rng.randrange(5) for _ in range(rng.choice([0, 0, 1, 3, 40]))] for _ in range(30)]
        tail = [] if f else [1, 2, 3]
        files[f"f{f}.tokens"] = [x for d in docs for x in [*d, 9]] + tail
        want += [(f"f{f}.tokens", k, len(d), True) for k, d in enumerate(docs)] + ([(f"f{f}.tokens", 30, 3, False)] if tail else [])
    files["empty.tokens"] = []
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes() + (b"\x01" if name == "f1.tokens" else b""))
    out = token_counts.token_counts(spark, f"file://{tmp_path}", 9, block_bytes=block).collect()
    assert sorted((r.file, r.ordinal, r.n_tokens, r.closed) for r in out) == sorted(want)


def test_token_files_of_odd_documents(spark, tmp_path):
    """Nulls, repeats, extra columns and a text longer than a block; ids that do not fit are refused."""
    encode = lambda texts: (np.array([ord(c) for c in t or ""], np.int64) for t in texts)
    rows = [(1, "ab", 0, "f"), (1, "ab", 0, "f"), (2, None, 1, "f"), (None, "xyz", 2, "f"), (3, "", 3, "f"), (4, "q" * 5000, 4, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ordinal int, file string").repartition(2)
    manifest = token_counts.write_token_files(df, f"file://{tmp_path}/a", encode, 60000)
    out = manifest.join(token_counts.token_counts(spark, f"file://{tmp_path}/a", 60000, block_bytes=256), ["file", "ordinal"])
    assert sorted(((r.doc_id, r.n_tokens) for r in out.collect()), key=str) == sorted([(1, 2), (1, 2), (2, 0), (None, 3), (3, 0), (4, 5000)], key=str)
    with pytest.raises(ValueError, match="does not fit"):
        token_counts.write_token_files(df, f"file://{tmp_path}/b", encode, 70000)
    for bad in ("\U0001f600", chr(60000)):
        with pytest.raises(Exception, match="is above"):
            token_counts.write_token_files(df.withColumn("text", F.lit(bad)), f"file://{tmp_path}/c", encode, 60000)


def test_token_counts_of_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(bpe.load_ranks(PATH)), special_tokens={})
    out = {r.doc_id: r.n_tokens for r in queries.op7_token_counts(spark, SF).collect()}
    assert out == {i: len(enc.encode_ordinary(t or "")) for i, t in docs.items()}


# Mixing


def _filled(sizes, weights, cap=3):
    total, open_, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * left / w >= cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = weights[i] * left / w
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
            open_.discard(i)
    return target


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 50, 300])), rng.choice(["a", "b", "c", "c", "c", "c", "c", "D", None])) for i in range(3000)]
    rows += [(9001, None, "a"), (9002, "x", "tiny"), (9003, "  y", "é"), (None, "p q r", "b"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, part int")
    out = mixing.mix(df, leaf=128, fan_in=4).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
    order = sorted((s for s in by if s is not None)) + [None]
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    want = dict(zip(order, _filled(sizes, [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    for s, rs in by.items():
        assert abs(rs[0].target - want[s]) < 1e-6 * max(1, want[s]) and rs[0].source_size == sum(r["size"] for r in rs)
        assert abs(sum(r.taken for r in rs) - want[s]) <= 300
        assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 for r in rs)
    key = lambda rs: sorted(((r.doc_id, r["size"], r.taken) for r in rs), key=str)
    assert key(mixing.mix(df.repartition(9), leaf=128, fan_in=4).collect()) == key(out)
    assert mixing.mix(df.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(df.where("size(split(text, 'w')) = 1 and text = ''")).collect())


def test_mixing_deals_repeats_to_many_leaves(spark):
    """An id, or null, that most rows have is in no leaf more often than others are."""
    rows = [(7, "w w w", "a")] * 3000 + [(None, "w w", "a")] * 2000 + [(i, "w", "b") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    nth = numbered(df, ["doc_id", "text"]).groupBy("doc_id", "text").agg(F.count_distinct("nth").alias("d"), F.min("nth").alias("low"), F.max("nth").alias("high"), F.count(F.lit(1)).alias("n"))
    assert all((r.d, r.low, r.high) == (r.n, 0, r.n - 1) for r in nth.collect())
    out = mixing.mix(df, leaf=64, fan_in=8).collect()
    assert len(out) == len(rows)
    marks = numbered(df.where("doc_id = 7"), ["doc_id"]).select(F.pmod(F.xxhash64(F.lit("leaf"), F.xxhash64(F.lit(0), "doc_id", F.lit(3).cast("long"), "nth")), F.lit(47)).alias("leaf"))
    assert marks.groupBy("leaf").count().agg(F.max("count")).first()[0] < 160
    taken = sum(r.taken for r in out if r.source == "a")
    assert abs(taken - next(r.target for r in out if r.source == "a")) <= 3


# BPE


def test_bpe_of_odd_texts(reference):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c  \n\t é漢😀'stdLL.12,\r\x0b ") for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["", " ", "  ", "\n ", " \n", "a \n b", "a\n ", "x" * 3000, "<|endoftext|>", " lead", "trail ", "it's we'll"]
    vocabulary, _ = bpe.encoder(PATH, P.PATTERN)
    for t, ids in zip(texts, bpe.encode_texts(texts, PATH, P.PATTERN), strict=True):
        assert ids.tolist() == reference.encode_ordinary(t)
        assert vocabulary.decode(ids) == t.encode()


def test_bpe_of_long_matches(reference):
    rng = random.Random(7)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "abcdefghijklmnop", "漢字仮名あいう", "aA1-") for n in (500, 513, 2000)] + ["".join(rng.choice("etaoinshr") for _ in range(200_000))]
    for t, ids in zip(texts, bpe.encode_texts(texts, PATH, P.PATTERN), strict=True):
        assert ids.tolist() == reference.encode_ordinary(t)
    vocabulary, _ = bpe.encoder(PATH, P.PATTERN)
    for t in texts[:-1]:  # both ways to merge give the same
        raw = t.encode()[:500]
        ids, n = vocabulary.merge(vocabulary.first[np.frombuffer(raw, np.uint8)][None])
        assert ids[0, : n[0]].tolist() == vocabulary.merge_wide(raw).tolist()


def test_other_patterns_meet_texts_whole(spark):
    pattern = r"\w+|\W"
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=dict(bpe.load_ranks(PATH)), special_tokens={})
    texts = ["a  b c", " lead", "x\n y ", ""]
    assert [ids.tolist() for ids in bpe.encode_texts(texts, PATH, pattern)] == [own.encode_ordinary(t) for t in texts]


def test_bpe_frames(spark, reference):
    rows = [(1, "Hello  world\n", 5), (2, None, 5), (3, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = bpe.bpe_encode(df, PATH, P.PATTERN)
    got = {r.doc_id: r for r in bpe.bpe_decode(out, PATH, P.PATTERN).collect()}
    assert got[1].tokens == reference.encode_ordinary("Hello  world\n") and got[1].decoded == "Hello  world\n" and got[2].tokens == [] and got[2].decoded == ""
    assert all(r.round_trip for r in got.values())
    d = {r.doc_id: r for r in bpe.bpe_digests(df, PATH, P.PATTERN).collect()}
    assert d[1].ids_sha256 == hashlib.sha256(np.array(got[1].tokens, "<u4").tobytes()).hexdigest() and d[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.bpe_digests(df.limit(0), PATH, P.PATTERN).count() == 0
    twice = bpe.bpe_digests(df.unionByName(df), PATH, P.PATTERN, keep=["doc_id"]).collect()
    assert len(twice) == 6 and len({tuple(r) for r in twice}) == 3


# Pipeline


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "12 34", "en", "src0", 5), (None, "no id here at all", "en", "src0", 17), (10**6 + 1, None, None, None, 0)], docs.schema)
    at = docs.unionByName(extra)
    counts = []
    for _, stage in C.STAGES:
        at = stage(spark, at, SF)
        rows = at.collect()
        at = spark.createDataFrame(rows, at.schema)
        counts.append(len(rows))
    assert counts[0] == docs.count() + 1 and counts[1] == counts[0] and counts[2] < counts[1]
    assert all(r.round_trip for r in rows) and {"doc_id", "n_tokens", "tokens"} <= set(at.columns)


def test_copies_are_not_boilerplate(spark):
    """Copies stay whole for the near-duplicate stage; a line on many distinct texts goes."""
    import corpus_pipeline as C

    clean = "one clean document\nwith a second line"
    only = [(i, clean, "en", "copied", len(clean)) for i in range(30)]
    mixed = [(100 + i, clean, "en", "mixed", len(clean)) for i in range(20)] + [(200 + i, f"own line {i}\nfooter", "en", "mixed", 0) for i in range(40)]
    docs = spark.createDataFrame(only + mixed, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in C.drop_boilerplate(spark, docs, SF).collect()}
    assert all(out[i] == clean for i, *_ in only + mixed[:20])
    assert all(out[200 + i] == f"own line {i}" for i in range(40))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates_keep_other_texts(spark):
    """A repeated or missing id loses no text: one row of each group of near-duplicates stays, and all without words."""
    import corpus_pipeline as C

    a, b, c = "a b c d e f g h", "q r s t u v w x", "one two three four five six"
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, b, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "t", 1), (5, c, "en", None, 1), (6, "", "en", "s", 0), (6, "", "en", "s", 0), (7, None, None, None, None)]
    out = C.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(1, a), (1, b), (5, c), (6, ""), (6, ""), (7, None)], key=str)


def test_stages_carry_columns_of_any_name(spark):
    """Stages of the pipeline return an input's columns as they are, those included that they use names of inside."""
    import corpus_pipeline as C

    extra = {"row": "r", "doc": "d", "score": "0.5", "ambiguous": "yes", "lines_dropped": "7", "copies": "9", "host": "h", "kept": "k", "nth": "n"}
    words = ["the", "cat", "and", "dog", "house", "wood", "in", "a", "of", "with"]
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + f" {i}", "en", "s", 0, *extra.values()) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS + ", " + ", ".join(f"{c} string" for c in extra))
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all({c: r[c] for c in extra} == extra for r in got)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert C.encode(spark, docs, SF).count() == 20


def test_pipeline_mixing_counts_equal_rows(spark):
    import corpus_pipeline as C

    rows = [(1, "w " * 3, "en", "a", 6)] * 200 + [(1, "w w", "en", "a", 3), (None, "w", "en", "b", 1), (3, "w w w w", "en", None, 7)] + [(100 + i, "w", "en", "b", 1) for i in range(500)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    out = C.mix_sources(spark, docs, SF).collect()
    targets = {r.source: r.target for r in mixing.mix(docs).collect()}
    words = defaultdict(int)
    for r in out:
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - t) <= 4 for s, t in targets.items()) and set(out[0].asDict()) == set(docs.columns)


def test_lines_of_a_source_go_by_their_rate(spark):
    """Lines planted on 3, 4.9, 5.1, 9 and 40 % of a source's distinct texts: those over one in twenty go."""
    import corpus_pipeline as C

    rates = {"l3": 30, "l49": 49, "l51": 51, "l9": 90, "l40": 400}
    rows = [(i, "\n".join([f"own line {i}", *(k for j, (k, n) in enumerate(rates.items()) if (i * 7 + j * 131) % 1000 < n)]), "en", "s", 0) for i in range(1000)]
    out = C.drop_boilerplate(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    left = [x for r in out for x in r.text.split("\n")]
    assert {k: left.count(k) for k in rates} == {"l3": 30, "l49": 49, "l51": 0, "l9": 0, "l40": 0} and len(out) == 1000


def test_null_source_is_deduplicated(spark):
    import corpus_pipeline as C

    rows = [(None, f"own line {i}\nfooter", "en", None, 0) for i in range(30)]
    out = C.drop_boilerplate(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert sorted(r.text for r in out) == sorted(f"own line {i}" for i in range(30)) and all(r.n_chars == len(r.text) for r in out)


def test_clear_keeps_what_is_asked_for(spark):
    """A run's intermediates go, those of another one at the same time and what is written outside stay."""
    from threading import Thread

    from quarry.llm.common import clear, intermediates, written

    others = []

    def other():
        with intermediates() as made:
            others.append((written(spark.range(3), "other"), made))

    with intermediates() as made:
        a = written(spark.range(5), "a")
        t = Thread(target=other)
        t.start()
        t.join()
    b = written(a.where("id > 0"), "b")
    assert len(made) == 1
    clear(spark, made)
    assert b.count() == 4 and others[0][0].count() == 3 and len(others[0][1]) == 1 and not made
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        a.collect()
