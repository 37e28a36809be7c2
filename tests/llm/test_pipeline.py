import pytest
from test_duplicates import brute_classes
from test_text_models import naive_spans

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Every stage against what it should have done with the rows it got, and run() against the stages."""
    from kvlake.llm.language import op4_language
    from kvlake.llm.pii import op6_pii
    from kvlake.llm.quality import op3_quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        out[name] = docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == columns or name == "packing"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "personal_data", "packing"]
    ids = {name: {r[0] for r in frame.select("doc_id").collect()} for name, frame in out.items()}
    assert ids["quality"] == {r["doc_id"] for r in op3_quality(spark, SF).collect() if r["predicted"]}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = {i for i, q in labels.items() if q == 1}
    assert len(clean & ids["quality"]) >= 0.97 * len(clean)
    (tmp_path / "t").mkdir()
    out["quality"].write.parquet(str(tmp_path / "t" / "documents.parquet"))
    language = {r["doc_id"]: r for r in op4_language(spark, str(tmp_path / "t")).collect()}
    assert ids["language"] == {i for i, r in language.items() if r["lang_pred"] != "und" and r["score"] >= 0.4}
    rows = out["language"].select("doc_id", "text").orderBy("doc_id").collect()
    classes = brute_classes([r["text"] for r in rows], 5, 80, 100)
    assert ids["near_duplicates"] == {rows[i]["doc_id"] for i, (_, c) in classes.items() if c == i}
    before = {r["doc_id"]: r["text"] for r in out["near_duplicates"].collect()}
    (tmp_path / "p").mkdir()
    out["near_duplicates"].write.parquet(str(tmp_path / "p" / "documents.parquet"))
    spans = {r["doc_id"]: [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s] for r in op6_pii(spark, str(tmp_path / "p")).collect()}
    assert sum(map(len, spans.values())) > 0
    for r in out["personal_data"].collect():
        assert set(naive_spans(before[r["doc_id"]])) <= set(spans[r["doc_id"]])
        # Character by character: what a span covers goes, its kind stands where spans begin that no other has covered.
        text, want, end = before[r["doc_id"]], [], 0
        begins = {}
        for kind, a, b in spans[r["doc_id"]]:
            begins.setdefault(a, (kind, b))
            begins[a] = (begins[a][0], max(begins[a][1], b))
        for i, c in enumerate(text):
            if i in begins:
                if i >= end:
                    want.append(f"<{begins[i][0]}>")
                end = max(end, begins[i][1])
            if i >= end:
                want.append(c)
        assert r["text"] == "".join(want) and r["n_chars"] == len(r["text"])
    assert ids["packing"] == ids["personal_data"] == ids["near_duplicates"]
    final = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, final.drop("sequence_id", "offset").collect())) == sorted(map(tuple, out["packing"].drop("sequence_id", "offset").collect()))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_odd_tables(spark, make_docs, odd_texts, stage):
    """Empty tables, tables of nulls, and odd texts with columns of clashing names."""
    run = dict(corpus_pipeline.STAGES)[stage]
    for texts in ([], [None, None], ["", None, "one", "one"], [t for t in odd_texts if len(t or "") < 10_000]):
        docs = make_docs(texts)
        out = run(spark, docs, SF)
        rows = out.collect()
        assert stage == "packing" or out.columns == docs.columns
        assert texts or not rows


def test_run_on_an_empty_table(spark, make_docs, tables):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, tables(documents=make_docs([]), labels=labels)).count() == 0


def test_repeated_rows_and_odd_texts(spark, make_docs, odd_texts):
    docs = make_docs([*odd_texts, "same row here", "same row here"], [*range(len(odd_texts)), 900, 900])
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.where("doc_id = 900").count() == 1 and kept.columns == docs.columns
    assert corpus_pipeline.near_duplicates(spark, make_docs([]), SF).count() == 0
    assert corpus_pipeline.personal_data(spark, docs, SF).count() == docs.count()
