import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import aggregates as A
from quarry.operators import answers as W
from quarry.operators import charts, etl
from quarry.operators import retrieval as R
from quarry.plans import recall
from quarry.sources import catalog as C
from quarry.sources.star import STAR


@pytest.mark.parametrize(("scores", "limits", "keep"), [
    ([0.95, 0.9, 0.8, 0.2, 0.18, 0.15], {}, 3), ([0.6, 0.5, 0.3, 0.28], {}, 2), ([0.9, 0.1], {}, 1), ([0.9, 0.88, 0.86, 0.84, 0.82, 0.8, 0.78], {}, 7),
    ([0.9, 0.89, 0.1, 0.09], {"least": 2}, 2), ([0.9, 0.88, 0.86, 0.84, 0.82], {"most": 3}, 3), ([0.9, 0.8], {"least": 5}, 2),
])
def test_cliff(spark, scores, limits, keep):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "qid int, id int, score double")
    assert R.cliff_cut(df, **limits).first().keep == keep
    assert R.cliff_top_k(df, **limits).count() == keep


def test_cliff_of_nothing(spark):
    assert R.cliff_cut(spark.createDataFrame([], "qid int, id int, score double")).count() == 0


@pytest.mark.parametrize(("lengths", "parents", "expected"), [
    ([300, 50], None, [352]), ([100, 100], None, [202]), ([790, 50], None, [790, 50]), ([300, 300], None, [300, 300]),
    ([100, 100], [0, 1], [100, 100]), ([100, 100], [0, 0], [202]), ([100, 100, 300], None, [202, 300]), ([150, 100, 700], None, [252, 700]),
])
def test_merge_short(spark, lengths, parents, expected):
    rows = [(1, i, parents[i] if parents else None, "x" * n) for i, n in enumerate(lengths)]
    out = etl.merge_short(spark.createDataFrame(rows, "doc_id int, chunk_index int, parent_index int, text string")).orderBy("chunk_index").collect()
    assert [len(r.text) for r in out] == expected and [r.chunk_index for r in out] == list(range(len(expected)))


def test_splitter():
    text = "\n\n".join(["word " * 60, "other " * 50, "z" * 1200])
    parts = etl.split_text(text, 512, 64)
    assert all(0 < len(p) <= 512 for p in parts) and "".join(parts).count("z") == 1200


def test_chunks_of_edge_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "long enough text")], "doc_id int, text string")
    assert [r.doc_id for r in etl.chunked(docs).collect()] == [4]


def _aligned(spark, md, blocks, kind):
    schema = "doc_id int, markdown string, blocks array<struct<page_idx:int,y:double,body:string,ref:string>>"
    return etl.aligned_originals(spark.createDataFrame([(1, md, blocks)], schema), kind).first().markdown


def test_tables_get_their_originals(spark):
    t = "<table><tr><td>1</td></tr></table>"
    assert _aligned(spark, f"a\n{t}\nb", [(0, 1.0, t, "![p0](u)"), (1, 0.0, None, "![p1](v)")], "table") == f"a\n{t}\n\n![p0](u)\n\n\n![p1](v)\n\nb"
    out = _aligned(spark, f"x\n{t}\n\ny\n{t}\n", [(0, 0.0, t, "![1](u)"), (1, 0.0, t, "![2](v)")], "table")
    assert out.index("![1]") < out.rindex("</table>") < out.index("![2]")
    assert _aligned(spark, "text", [(0, 1.0, None, "![p](u)")], "table").endswith("## Table originals\n![p](u)")
    assert "Table originals" in _aligned(spark, t, [(0, 1.0, "<table><tr><td>other</td></tr></table>", "![p](u)")], "table")
    assert _aligned(spark, f"x {t}", [], "table") == f"x {t}"


def test_formulas_get_their_originals(spark):
    out = _aligned(spark, "a $x$ b\n$$ E = mc^2 $$\nc", [(0, 1.0, "$$E=mc^2$$", "![f](u)"), (0, 2.0, "$$other$$", "![g](v)")], "formula")
    assert out.index("$$\n\n![f](u)") < out.index("\nc") < out.index("## Formula originals\n![g](v)")


REAL = "http://store/images/p4.png"


@pytest.mark.parametrize(("text", "valid", "expected"), [
    ("a ![alt](http://...url.../) b", [REAL], "a alt b"), ("a ![alt](http://...URL.../) b", [], "a alt b"), ("x http://...url.../ y", [], "x y"),
    (f"a ![alt]({REAL}) b", [REAL], f"a ![alt]({REAL}) b"), (f"a ![alt]({REAL}) b", [], "a alt b"), ("plain", [], "plain"),
])
def test_sanitized_images(spark, text, valid, expected):
    df = spark.createDataFrame([(text, valid)], "t string, v array<string>")
    assert df.select(X.sanitized_images(F.col("t"), F.col("v"))).first()[0] == expected


@pytest.mark.parametrize(("md", "ref", "has", "lacks"), [
    ("This part shows EV160.\n![](images/fig1.png)", "images/fig1.png", "EV160", "![]"), ("Not this.\n\nBMS here.\n![](i/2.png)", "i/2.png", "BMS", "Not this"),
    ("A.![](i/0.png)\nhigh voltage.\n![](i/1.png)", "i/1.png", "high voltage", "![]"),
])
def test_image_context(spark, md, ref, has, lacks):
    out = spark.createDataFrame([(md, ref)], "m string, r string").select(X.image_context(F.col("m"), F.col("r"))).first()[0]
    assert has in out and lacks not in out


def test_image_context_without_reference(spark):
    assert spark.createDataFrame([("text", "x.png")], "m string, r string").select(X.image_context(F.col("m"), F.col("r"))).first()[0] == ""


def test_image_urls(spark):
    rows = [(1, 1, '["a","b"]'), (1, 2, '["b","c"]'), (2, 1, ""), (3, 1, "not json"), (4, 1, None)]
    out = {r.qid: r.urls for r in R.image_urls(spark.createDataFrame(rows, "qid int, rank int, image_urls string")).collect()}
    assert out == {1: ["a", "b", "c"], 2: [], 3: [], 4: []}


def test_rrf_and_parents(spark):
    lists = [spark.createDataFrame(x, "qid int, id int, rank int") for x in ([(1, 10, 1), (1, 11, 2)], [(1, 11, 1), (1, 12, 2)])]
    out = R.rrf(lists, 2).orderBy("rank").collect()
    assert [r.id for r in out] == [11, 10] and abs(out[0].score - (1 / 61 + 1 / 62)) < 1e-12
    hits = spark.createDataFrame([(1, 1, "child", "parent", "d", 3), (1, 2, "own", "", None, 0)], "qid int, rank int, text string, parent_text string, doc_name string, page_number int")
    assert R.parent_context(hits).first().context == "[Source: d, page 3]\nparent\n\n---\n\n[Source: unknown]\nown"


def test_cache_key(spark):
    df = spark.createDataFrame([(["a", "b"], "r1"), (["b", "a"], "r1"), (["a", "b"], "r2")], "c array<string>, role string")
    a, b, c = (r[0] for r in df.select(R.cache_key(F.lit("q"), F.col("c"), F.lit(None), F.lit(None), F.lit(False), F.col("role"))).collect())
    assert a == b != c


def test_token_cost_and_json(spark):
    usage = spark.createDataFrame([("m", None, None), ("m", 10, 20)], "model string, prompt_tokens int, completion_tokens int")
    r = A.token_cost(usage).first()
    assert (r.input, r.output, r.calls) == (10, 20, 2) and abs(r.cost_usd - (10 * 0.4e-6 + 20 * 1.2e-6)) < 1e-12
    df = spark.createDataFrame([('so {"score": 0.8, "reason": "ok"}',), ("none",), (None,)], "t string")
    assert [(r.s.score, r.s.reason) for r in df.select(X.score_in(F.col("t")).alias("s")).collect()] == [(0.8, "ok"), (0.0, ""), (0.0, "")]


def test_empty_feedback(spark):
    r = A.feedback_totals(spark.createDataFrame([], "rating int")).first()
    assert (r.total, r.praise_rate) == (0, 0.0)


def test_linked_feedback(spark):
    df = spark.createDataFrame([(1, "t", 1, "good"), (2, "t", 1, None)], "id int, trace string, rating int, comment string")
    assert [(r.rating, r.comment) for r in A.linked_feedback(df, "t", -1, "late").orderBy("id").collect()] == [(-1, "good | late"), (1, None)]


def test_catalog(spark):
    assert STAR.table("orders").key_columns() == ["o_orderkey", "o_custkey"]
    frames = STAR.frames(spark)
    assert C.columns_of(frames["columns"], "part").count() == len(STAR.table("part").columns)
    assert len(C.nested_table(frames["tables"], frames["columns"], "region").first()["columns"]) == 2
    assert C.merged(frames["metrics"], frames["metrics"].where("name <> 'cr_count'"), ["name"]).count() == 3
    by_table, examples, metrics = recall.merged_info(STAR, ["customer.c_mktsegment"], ["issue_count"], [("nation.n_name", "FRANCE")])
    assert set(by_table) == {"customer", "orders", "nation"} and "c_custkey" in by_table["customer"] and metrics == ["issue_count"] and examples == {"nation.n_name": ["FRANCE"]}
    assert recall.pruned(STAR, by_table, "bad") == by_table and set(recall.pruned(STAR, by_table, {"orders": []})) == {"orders"}


def test_charts(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert charts.recommend(df) == "bar" and charts.recommend(df.select("k")) == "table"
    assert charts.axis(df, "nope", None) == ("k", "v")
    assert charts.option(df, "pie")["data"] == [{"name": "a", "value": 1}, {"name": "b", "value": 2}]


def test_images_are_rewritten(spark):
    schema = "doc_id int, markdown string, images array<struct<name:string,summary:string>>"
    md = "a ![](images/p1.jpg) b ![own](p2.png)"
    df = spark.createDataFrame([(7, md, [("p1.jpg", "a plan"), ("p2.png", None), ("p3.gif", "left over")]), (8, "none", None)], schema)
    out = {r.doc_id: r.markdown for r in etl.rewritten_images(df, "http://store/b").collect()}
    assert out[7] == "a ![a plan](http://store/b/images/7/p1.jpg) b ![own](http://store/b/images/7/p2.png)\n\n## Document images\n![left over](http://store/b/images/7/p3.gif)"
    assert out[8] == "none"


def test_responses_of_all_forms(spark):
    rows = ['{"results": {"a.pdf": {"md_content": "", "md": ""}, "b.pdf": {"md": "two", "content_list": "[]"}}}', '{"results": [{"md": "old", "blocks": [{"page_number": 3}, {}]}]}', '{"md": "flat"}', '{"other": 1}', '{"results": {}}']
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, raw string")
    out = {r.doc_id: (r.markdown, r.pages, r.content_list) for r in etl.decoded_responses(df).collect()}
    assert out == {0: ("two", [], "[]"), 1: ("old", [3, 0], None), 2: ("flat", [], None), 3: ('{"other": 1}', [], None), 4: ("", [], None)}


def test_pages_of_a_reader_are_joined(spark):
    df = spark.createDataFrame([(1, 1, "b", "iv"), (1, 0, "a", "12"), (2, 0, None, None)], "doc_id int, part int, text string, page_label string")
    assert {r.doc_id: (r.text, r.pages) for r in etl.joined_pages(df).collect()} == {1: ("a\n\nb", [12, 0]), 2: ("", [0])}


def test_blocks_and_parsers(spark):
    raw = '[{"type": "table", "page_idx": 1, "bbox": [0, 5.5, 1, 1], "table_body": "<table/>"}, {"type": "text", "text": "x"}, {"type": "equation", "text": "$a$"}]'
    out = etl.parsed_blocks(spark.createDataFrame([(1, raw), (2, "no json"), (3, None)], "doc_id int, raw string")).collect()
    assert sorted((r.kind, r.page_idx, r.y, r.body) for r in out) == [("equation", 0, 0.0, "$a$"), ("table", 1, 5.5, "<table/>")]
    files = spark.createDataFrame([("a", b"long enough text"), ("b", b"short")], "path string, content binary")
    assert {r.path: r.text for r in etl.parse_files(files, fallback=lambda data: "other reader").collect()} == {"a": "long enough text", "b": "other reader"}
    assert etl.chunker("semantic") is etl.semantic_chunks and etl.chunker(None) is etl.chunked and etl.chunker("odd") is etl.chunked


def _plain_split(text, size, overlap, separators):
    """The recursive splitter in plain words: cut at the first separator there is, fill pieces up, start each with what
    fits of the end of the one before."""
    sep = next((s for s in separators if s in text), "")
    rest = separators[separators.index(sep) + 1 :] if sep else ()
    units = []
    for part in text.split(sep) if sep else [text[i : i + size] for i in range(0, len(text), size)]:
        units += [part] if len(part) <= size else _plain_split(part, size, 0, rest)
    pieces, first, at = [], 0, 0
    while at < len(units):
        while at < len(units) and (at == first or len(sep.join(units[first : at + 1])) <= size):
            at += 1
        pieces.append(sep.join(units[first:at]))
        if at < len(units):
            while first < at and (len(sep.join(units[first:at])) > overlap or len(sep.join(units[first : at + 1])) > size):
                first += 1
    return [p.strip() for p in pieces if p.strip()]


def test_splitters_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect() if r.text and len(r.text.strip(" ")) >= etl.MIN_TEXT}
    want = sorted((d, i, c) for d, t in texts.items() for i, c in enumerate(_plain_split(t, 512, 64, etl.SEPARATORS)))
    assert sorted((r.doc_id, r.chunk_index, r.text) for r in etl.chunked(docs).collect()) == want
    got = sorted((r.doc_id, r.chunk_index, r.parent_index, r.text, r.parent_text) for r in etl.parent_child(docs).collect())
    plain = []
    for d, t in texts.items():
        n = 0
        for p, parent in enumerate(_plain_split(t, 2048, 128, ("\n\n", "\n"))):
            for c in _plain_split(parent, 512, 64, etl.SEPARATORS):
                plain.append((d, n, p, c, parent))
                n += 1
    assert got == sorted(plain)
    records = etl.chunk_records(etl.parent_child(docs), docs.select("doc_id", F.lit("n").alias("doc_name"), F.array(F.lit(4)).alias("pages"))).collect()
    assert {(r.id, r.page_number) for r in records} == {(f"{d}_{n}", 4 if n == 0 else 0) for d, n, *_ in plain} and all(r.text in r.parent_text or r.parent_text for r in records)


def test_semantic_chunks_equal_a_plain_version(spark):
    import re
    import zlib

    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 4000")
    want = []
    for d, t in ((r.doc_id, r.text) for r in docs.collect()):
        parts = [(i, s) for i, s in enumerate(re.split(r"(?<=[.!?。！？])\s+", t)) if s.strip(" ")]
        vs = []
        for _, s in parts:
            slots = [zlib.crc32(w.encode()) % etl.DIM for w in re.findall(r"\w+", s[: etl.EMBED_MAX].lower())]
            v = np.bincount(slots, minlength=etl.DIM).astype(np.float32) if slots else np.zeros(etl.DIM, np.float32)
            vs.append((v / max(float(np.sqrt((v * v).sum())), 1e-12)).astype(np.float32).astype(float))
        norm = [float(np.sqrt(v @ v)) for v in vs]
        far = [0.0] + [1 - (a @ b / (x * y) if x * y > 0 else 1.0) for a, b, x, y in zip(vs, vs[1:], norm, norm[1:], strict=False)]
        inner = [f for (i, _), f in zip(parts, far, strict=True) if i > 0]
        limit = np.percentile(inner, 0.3) if inner else None
        nth, at = 0, {}
        for (i, s), f in zip(parts, far, strict=True):
            nth += i > 0 and limit is not None and f > limit + 1e-9
            at.setdefault(nth, []).append(s)
        want += [(d, n, " ".join(x)) for n, x in at.items()]
    got = {(r.doc_id, r.chunk_index, r.text) for r in etl.semantic_chunks(docs).collect()}
    assert len(got & set(want)) >= 0.99 * len(want)  # distances that tie but for rounding may fall on either side


def test_semantic_chunks_stay_in_their_rows(spark):
    docs = spark.createDataFrame([(1, "One two. One two. Three four. Five"), (2, None), (3, "  "), (4, "\u3000! A b. A b. C d.")], "doc_id long, text string")
    out = etl.semantic_chunks(docs)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.chunk_index): r.text for r in out.collect()}
    assert {k for k in got if k[0] in (2, 3)} == set() and got[1, 0] == "One two. One two." and got[1, 1] == "Three four." and got[1, 2] == "Five"
    assert out.dtypes == [("doc_id", "bigint"), ("chunk_index", "bigint"), ("text", "string")]


def test_chunks_leave_a_task_in_small_batches():
    held = []

    class Rows:  # what mapInArrow is given
        def __init__(self, schema):
            self.schema = schema

        def mapInArrow(self, run, schema):  # noqa: N802
            held.append(run)

    import pyarrow as pa
    from pyspark.sql import types as T

    etl._pieces(Rows(T.StructType.fromDDL("doc_id long, text string")), lambda c, known: ([(0, x)] * 3 for x in c[0]), "int")
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(["x"] * 2000)], names=["doc_id", "text"])
    sizes = [len(b) for b in held[0](iter([batch]))]
    assert sum(sizes) == 6000 and max(sizes) <= 3 * etl.EMBED_ROWS


def test_dense_search_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 5))
    v[7] = v[9] = v[11]
    rows = [(i, [float(x) for x in y], i % 3) for i, y in enumerate(v)] + [(900, None, 0), (901, [0.0] * 5, 0), (902, [1.0], 0), (903, [1.0, None, 1.0, 1.0, 1.0], 0)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>, kind int").repartition(4)
    queries = spark.createDataFrame([(f"q{i}", [float(x) for x in v[i]]) for i in range(0, 300, 20)] + [("zero", [0.0] * 5)], "qid string, qvector array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for kinds in (None, [1, 2]):
        want = {(f"q{q}", r + 1): i for q in range(0, 300, 20) for r, i in enumerate(sorted((i for i in range(300) if not kinds or i % 3 in kinds), key=lambda i: (-round(unit[q] @ unit[i], 12), i))[:10])}
        assert {(r.qid, r["rank"]): r.id for r in R.dense_search(corpus, queries, 10, {"kind": kinds}).collect()} == want
    plan = R.dense_search(corpus, queries, 10)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_search_in_portions(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, vector array<double>")
    queries = corpus.selectExpr("id AS qid", "vector AS qvector")
    want = sorted(map(tuple, R.dense_search(corpus, queries, 3).collect()))
    monkeypatch.setattr(R, "BROADCAST_ROWS", 7)
    assert sorted(map(tuple, R.dense_search(corpus, queries, 3).collect())) == want


@pytest.mark.parametrize("sent", [10_000, 1])
def test_texts_are_embedded_and_compared_in_one_worker(spark, monkeypatch, sent):
    monkeypatch.setattr(R, "BROADCAST_ROWS", sent)
    monkeypatch.setattr(R, "TEXTS_AT_ONCE", 3)
    monkeypatch.setattr(R, "CORPUS_TILE", 7)
    texts = [(i, " ".join(f"w{i % j}" for j in range(2, 9))) for i in range(60)] + [(60, None), (61, ""), (62, "...")]
    corpus = spark.createDataFrame(texts, "id long, text string").repartition(2)
    queries = spark.createDataFrame([(1, "w1 w2 w0"), (2, "w5"), (3, "")], "qid long, qtext string")
    vectors = corpus.withColumn("vector", etl.hashed_embedding(F.col("text"), most=None))
    want = R.dense_search(vectors, queries.withColumn("qvector", etl.hashed_embedding(F.col("qtext"), most=None)), 9)
    out = R.dense_search(corpus, queries, 9, embed=etl.whole_texts())
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and out.count() == 18
    plan = R.dense_search(corpus, queries, 9, embed=etl.whole_texts())._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and (sent == 1 or plan.count("MapInArrow") == 1)


def test_hybrid_search_degrades(spark):
    corpus = spark.createDataFrame([(1, "red apple", [1.0, 0.0]), (2, "green pear", [0.0, 1.0])], "id long, text string, vector array<double>")
    queries = spark.createDataFrame([(9, "apple", [0.1, 1.0])], "qid long, qtext string, qvector array<double>")
    ids = lambda df: [r.id for r in df.orderBy("rank").collect()]
    assert ids(R.hybrid_search(corpus.drop("text"), queries)) == [2, 1] and ids(R.hybrid_search(corpus.drop("vector"), queries)) == [1]
    assert R.hybrid_search(corpus.select("id"), queries).count() == 0
    supposed = lambda q: q.select("qid", F.array(F.lit(1.0), F.lit(0.0)).alias("qvector"))
    assert ids(R.retrieve(corpus, queries, top=2, hyde=supposed, reranked=False)) == [1, 2] and ids(R.retrieve(corpus, queries, top=1)) == [1]


def test_recall_equals_brute_force(spark):
    import re
    import zlib

    import numpy as np

    def embed(t):
        v = np.bincount([zlib.crc32(w.encode()) % etl.DIM for w in re.findall(r"\w+", t.lower())], minlength=etl.DIM).astype(float)
        return v / max(np.linalg.norm(v), 1e-12)

    keywords = [("issues by business line", 0), ("severity", 1), ("status of changes", 2)]
    columns = [(f"{t}.{c.name}", "; ".join(x for x in (c.name, c.description, ", ".join(c.aliases)) if x)) for t, c in STAR.all_columns()]
    want = {}
    for k, pos in keywords:
        near = sorted(((-round(float(embed(k) @ embed(t)), 6), i) for i, t in columns))[:5]
        want |= {i: (pos, -s) for s, i in near if -s >= 0.3 and i not in want}
    got = {r.id: (r.pos, round(r.score, 6)) for r in recall.recall_columns(spark.createDataFrame(keywords, "keyword string, pos int"), STAR.frames(spark)["columns"]).collect()}
    assert {i: p for i, (p, _) in got.items()} == {i: p for i, (p, _) in want.items()} and all(abs(got[i][1] - want[i][1]) < 1e-5 for i in want)
    values = spark.createDataFrame([("a", "BUILDING"), ("b", "MACHINERY"), ("c", "HOUSEHOLD"), ("d", "heavy machinery parts")], "id string, value string")
    found = recall.recall_values(spark.createDataFrame([("building machinery", 0)], "keyword string, pos int"), values).collect()
    assert {r.id for r in found} == {"a", "b", "d"} and max(found, key=lambda r: r.score).id == "a"


def test_metrics_are_pruned_and_told(spark):
    assert recall.pruned_metrics(["a", "b"], ["b", "c"]) == ["b"] and recall.pruned_metrics(["a"], "bad") == recall.pruned_metrics(["a"], []) == ["a"]
    told = recall.prompt_context(STAR, {"nation": ["n_name", "n_regionkey"]}, {"nation.n_name": list("abcdefg")}, ["issue_count"])
    assert "e.g. a, b, c, d, e\n" in told and "-> region.r_regionkey" in told and told.endswith("metric issue_count = COUNT(*) of orders")


def test_half_even_rounding(spark):
    import random

    rng = random.Random(1)
    xs = [1.005, 2.675, 0.285, 1.115, 0.125, 0.375, -0.125, 2.5, 0.0, 1e9 + 0.005] + [rng.randrange(10**6) / 1000 for _ in range(3000)] + [rng.random() * 10 for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    for places in (2, 3, 6):
        got = [r[0] for r in df.select(X.round_half_even(F.col("x"), places)).collect()]
        assert got == [round(x, places) for x in xs] + [None]


def test_names_of_columns(spark):
    r = spark.createDataFrame([("orders.o_orderkey",)], "n string").select(X.table_of(F.col("n")), X.column_of(F.col("n"))).first()
    assert tuple(r) == ("orders", "o_orderkey")


def test_image_urls_are_urls(spark):
    df = spark.createDataFrame([("![a](http://x/1.png) ![b](images/x.png) ![c](http://x/1.png) ![d](https://y/2)",)], "t string")
    assert df.select(X.image_urls_in(F.col("t"))).first()[0] == ["http://x/1.png", "https://y/2"]
    assert df.select(X.decoded_image(F.lit("data:image/png;base64,aGk=")), X.decoded_image(F.lit("aGk="))).first() == (b"hi", b"hi")


def test_records(spark, tmp_path):
    from quarry.sources import records as K

    store = spark.createDataFrame([("u:1", '[{"role": "user"}]'), ("u:2", "broken")], "key string, value string")
    assert K.history(store, "key", "value", "u:1") == [{"role": "user"}] and K.history(store, "key", "value", "u:2") == K.history(store, "key", "value", "u:3") == []
    assert K.table_or_empty(spark, f"file://{tmp_path}/none", "a int").count() == 0
    rows = spark.createDataFrame([(1, None, [1, 2])], "id int, note string, xs array<int>")
    assert K.report(rows).first().value == '{"id":1,"note":null,"xs":[1,2]}'
    assert K.notifications(spark.createDataFrame([("d", "t", "c", "upload")], "doc_name string, doc_type string, category string, action string")).first().is_read is False
    with pytest.raises(ValueError, match="unknown metrics"):
        W.computed_metrics(rows, {"none": ("note",)})
    assert W.computed_metrics(rows.withColumn("note", F.lit("a b")), {"tokens": ("note",)}).first().tokens == 2


def test_channels_are_dispatched(spark):
    asked = []
    search = lambda f: asked.append(dict(f)) or spark.range(1)
    assert len(W.dispatched("change_review", search, lambda: spark.range(2))) == 2 and asked == [{"doc_type": "spec_doc"}]
    assert len(W.dispatched("graph_rag", search, lambda: spark.range(2))) == 1 and len(asked) == 1
    with pytest.raises(ValueError, match="unknown channel"):
        W.dispatched("other", search, lambda: spark.range(1))


def test_rewriting_has_defaults(spark):
    rows = ['```json\n{"queries": ["a", "b"], "intent": "sql"}\n```', '{"queries": []}', "no json", None]
    out = spark.createDataFrame([(r,) for r in rows], "r string").select(W.rewritten(F.lit("q"), F.col("r")).alias("w")).collect()
    assert [(x.w.queries, x.w.intent) for x in out] == [(["a", "b"], "sql")] + [(["q"], "knowledge_qa")] * 3
