"""Literal rows for each rule, the edges above all."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import answers, candidates, clean, evaluate, negatives, querygen, rank, training


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, t {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_normal_line(spark):
    rows = ["", "a", " ab  c ", "- 12 -", "-12-", "12", "— — —", "***", "3–", "No. 5", "　é x "]
    assert values(spark, rows, T.normal_line) == ["", "", "ab c", "- 12 -", "", "", "", "", "", "No. 5", "é x"]


def test_lines(spark):
    assert values(spark, ["a\r\nb\rc\x0bd e", None], T.lines) == [["a", "b", "c", "d", "e"], []]


def test_tokens(spark):
    assert values(spark, ["Élan vital-3", None, "A a"], T.tokens) == [["lan", "vital", "3"], [], ["a", "a"]]


def test_confidence(spark):
    rows = ["Confidence: 95", "confidence 0.95", "none", None, "confidence is somewhere 3", "confidence 400"]
    assert values(spark, rows, T.confidence) == [0.95, 0.95, 0.2, 0.2, 0.2, 1.0]


def test_json_list(spark):
    assert values(spark, ["[1,2]", " ", None], lambda c: T.json_list(c, "int")) == [[1, 2], [], []]


def test_boilerplate_at_its_edges(spark):
    def page(doc, i, text):
        return (doc, i, text)

    rows = [page("a", i, f"Header\nline {i} x\nline {i} X" if i < 8 else f"line {i} x") for i in range(100)]  # 8 of 100: just enough
    rows += [page("b", i, f"Header\nown {i} x") for i in range(7)]  # 7: too few
    rows += [page("c", i, "Foot" if i < 8 else "") for i in range(101)]  # 8 of 101: less than 0.08
    df = spark.createDataFrame(rows, "doc_id string, page_idx int, ocr_text string")
    got = {(r.doc_id, r.page_idx): r.ocr_text_clean for r in clean.clean_pages(df).collect()}
    assert got["a", 0] == "line 0 x"
    assert got["b", 0] == "Header\nown 0 x"
    assert got["c", 0] == "Foot"
    assert got["c", 50] == ""
    again = clean.clean_pages(spark.createDataFrame([(d, p, t) for (d, p), t in got.items()], "doc_id string, page_idx int, ocr_text string"))
    assert {(r.doc_id, r.page_idx): r.ocr_text_clean for r in again.collect()}["a", 0] == "line 0 x"


def test_summary_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id string, ocr_text_len int, ocr_text_clean_len int, ocr_reduction int")
    r = clean.clean_summary(df).first()
    assert (r.rows, r.error_pages, r.avg_clean_length) == (0, 0, 0.0)


def test_flatten_ocr(spark):
    rows = [
        json.dumps({"rec_texts": [" a ", "", "b", "c"], "rec_scores": [0.5, 0.9, "x"], "rec_boxes": [[1], [2], [3]]}),
        json.dumps({"res": {"rec_texts": ["a"], "rec_scores": [0.5, 1], "rec_boxes": []}}), "{}", "broken",
    ]
    got = [tuple(r) for r in values(spark, rows, clean.flatten_ocr)]
    assert got == [("a\nb", 0.5, 3), ("a", 0.5, 0), ("", 0.0, 0), ("", 0.0, 0)]


@pytest.mark.parametrize(("n", "want"), [(49, -5.0), (50, -1.0), (119, -1.0), (120, 3.0), (3500, 3.0), (3501, 1.0)])
def test_score_by_length(spark, n, want):
    s, _ = candidates.score(F.col("t"), F.lit(0))
    assert values(spark, ["x" * n], lambda c: s) == [want]


def test_score_features(spark):
    df = spark.createDataFrame([("5 N·m and 90° turn\nOVERVIEW OF ALL\n• one ３４", b) for b in (7, 8, 19, 20)], "t string, b int")
    s, reasons = candidates.score(F.col("t"), F.col("b"))
    got = [(r[0], r[1]) for r in df.select(s, reasons).collect()]
    # units 1, numbers 3 (wide digits count), bullets 2 (the middle dot is one), keyword 'overview', a title in capitals; 90° then a blank is no unit
    base = -5 + 0.6 + 0.24 + 0.5 + 1.2 + 0.4
    assert [g[0] for g in got] == [pytest.approx(base + x) for x in (0, 2, 2, 3)]
    assert got[3][1] == "too_short;dense_boxes;very_dense_boxes;unit_hits=1;bullet_hits=2;high_value=overview;upper_titles=1"


def test_page_type(spark):
    rows = ["a workspace payload", "PAYLOAD overview", "overview contents", "contents", "none", None]
    assert values(spark, rows, candidates.page_type) == ["layout", "fact", "semantic", "navigation", "generic", "generic"]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.integers(1, 400), min_size=1, max_size=25))
def test_quotas_stay_in_bounds(counts):
    q = candidates.settle(counts, 500, 25, 90)
    assert all(25 <= x <= 90 for x in q.values())
    assert sum(q.values()) == max(25 * len(q), min(90 * len(q), 500))


def test_quotas_in_both_ways_agree(spark):
    for counts in ({f"d{i}": 10 * (i % 5 + 1) ** 3 for i in range(25)}, {f"d{i}": 10 + i for i in range(8)}):
        df = spark.createDataFrame([(d,) for d, n in counts.items() for _ in range(n)], "doc_id string")
        got = {r.doc_id: r.selected_quota for r in candidates.allocate_quotas(df).collect()}
        assert got == candidates.settle(dict(sorted(counts.items())), 500, 25, 90)


def test_selection_caps_navigation_and_fills(spark):
    rows = [("a", i, f"contents page {i} " + "x" * 130, 0) for i in range(40)] + [("a", 100 + i, "sensor " + "x" * 200, 0) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id string, page_idx int, ocr_text_clean string, num_boxes int").withColumn("ocr_text_clean_len", F.length("ocr_text_clean"))
    scored = candidates.score_pages(df)
    quotas = spark.createDataFrame([("a", 25)], "doc_id string, selected_quota int")
    got = candidates.select_candidates(scored, quotas, 25).collect()
    assert len(got) == 25
    assert sum(r.page_type == "fact" for r in got) == 3


def test_refine(spark):
    rows = [("x" * 119, "fact", 50.0, False), ("x" * 120, "fact", 0.0, True), ("license agreement " + "x" * 200, "fact", 50.0, False), ("contents " * 30, "navigation", 50.0, False), ("emergency stop " * 20, "navigation", 9.9, False), ("emergency stop " * 20, "navigation", 10.0, True), ("certificate " + "x" * 200, "fact", 9.0, False), ("certificate " + "x" * 1300, "fact", 9.0, True), ("y" * 130, "odd", 99.0, False)]
    df = spark.createDataFrame([(t, len(t), k, s, w) for t, k, s, w in rows], "ocr_text_clean string, ocr_text_clean_len int, page_type string, page_score double, want boolean")
    assert [r.want for r in df.withColumn("got", candidates.keeps()).where("got <> want").collect()] == []


def test_query_families(spark):
    rows = [("d", 0, "Title here\nthe payload is 7 kg", "fact"), ("d", 1, "", "layout"), ("d", 2, "Heading only", "navigation"), ("e", 0, "", "generic"), ("e", 1, "Maintenance plan", "semantic")]
    df = spark.createDataFrame(rows, "doc_id string, page_idx int, ocr_text_clean string, page_type string").withColumns({"ocr_text_clean_len": F.length("ocr_text_clean"), "page_score": F.lit(1.0)})
    got = [(r.query_id, r.query_source, r.query_en) for r in querygen.generate_queries(df).orderBy("query_id").collect()]
    assert got == [
        ("auto_00001", "fact_keyword", "What specification about payload is given on this page?"), ("auto_00002", "fact_page_lookup", "Which page mentions payload related specifications?"),
        ("auto_00003", "fact_number_unit", "Which page contains the specification value 7 kg?"), ("auto_00004", "layout_fallback", "Which page contains diagram or layout information?"),
        ("auto_00005", "layout_fallback2", "Which page looks like a schematic or layout page?"), ("auto_00006", "navigation_heading", "Which page contains navigation information about 'Heading only'?"),
        ("auto_00007", "generic_topic", "Which page contains information about this topic?"), ("auto_00008", "semantic_keyword", "Which page describes maintenance related information?"), ("auto_00009", "semantic_topic", "What maintenance topic is mainly explained on this page?"),
    ]
    assert {r.query_source for r in querygen.filter_queries(querygen.generate_queries(df)).collect()} == {"fact_keyword", "fact_page_lookup", "fact_number_unit", "layout_fallback", "layout_fallback2", "navigation_heading", "semantic_keyword", "semantic_topic"}


def test_bm25_fills_and_counts_repeats(spark):
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(["apple pear", "apple apple fig", "plum", "", "kiwi", None, "date nut oil"])], "src_id long, text string")
    q = spark.createDataFrame([(1, "apple apple"), (2, "nothing"), (3, "")], "query_id long, query_en string")
    got = {}
    for r in rank.bm25_topk(corpus, q, 3, ["src_id"]).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.src_id, r.score))
    assert [x[0] for x in got[1]] == [1, 0, 2]
    assert got[1][2][1] == 0.0
    assert got[2] == got[3] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    once = {r.src_id: r.score for r in rank.bm25_scores(corpus, spark.createDataFrame([(1, "apple")], "query_id long, query_en string"), ["src_id"]).collect()}
    assert got[1][0][1] == pytest.approx(2 * once[1], abs=2e-6)


def test_topk_is_nested_and_ties_go_to_the_key(spark):
    s = spark.createDataFrame([(1, i, 0.5) for i in range(9)], "query_id long, src_id long, score double")
    three, four = ({r.src_id for r in rank.top_k(s, k, ["src_id"]).collect()} for k in (3, 4))
    assert three == {0, 1, 2} and three < four


def gold_of(spark, rows):
    return spark.createDataFrame(rows, "query_id string, query_en string, query_type string, gold_doc_id string, gold_page_idx int")


def test_evaluate_without_hits(spark):
    gold = gold_of(spark, [("q1", "a", "fact", "d", 1), ("q2", "b", "fact", "d", 2)])
    hits = spark.createDataFrame([("q1", 1, "d", 2, 0.9), ("q1", 2, "d", 1, 0.8)], "query_id string, rank int, doc_id string, page_idx int, score double")
    d = {r.query_id: r for r in evaluate.evaluate(hits, gold).collect()}
    assert (d["q1"].top1_doc_hit, d["q1"].top1_exact_hit, d["q1"].top5_exact_hit, d["q1"].retrieved_page_idxs) == (True, False, True, "[2,1]")
    assert (d["q2"].top1_doc_id, d["q2"].top5_doc_hit, d["q2"].retrieved_scores) == (None, False, "[]")
    s = json.loads(evaluate.summary_json(evaluate.evaluate(hits, gold)).first().summary)
    assert s["num_queries"] == 2 and s["top5_exact_recall"] == 0.5 and s["by_query_type"][0]["query_type"] == "fact"


def test_best_run_ties_go_to_the_name(spark):
    row = lambda q, *h: (q, *h)
    shape = "query_id string, top1_doc_hit boolean, top1_exact_hit boolean, top5_doc_hit boolean, top5_exact_hit boolean"
    runs = evaluate.union_runs({"b": spark.createDataFrame([row("q", True, False, True, True)], shape), "a": spark.createDataFrame([row("q", True, False, True, True)], shape)})
    assert evaluate.best_by_query(runs).first().run_name == "a"


def test_labels(spark):
    hits = spark.createDataFrame([("q1", 3, "d", 7)], "query_id string, rank int, doc_id string, page_idx int")
    said = spark.createDataFrame([("q1", "rank=3"), ("q2", "rank=3"), ("q3", "doc,12"), ("q4", "skip"), ("q5", "what"), ("q6", None)], "query_id string, directive string")
    got = {r.query_id: tuple(r)[1:] for r in evaluate.apply_labels(said, hits).collect()}
    assert got == {"q1": ("d", 7, "bm25_top3"), "q2": ("", -1, "skip"), "q3": ("doc", 12, "manual"), "q4": ("", -1, "skip"), "q5": ("", -1, "skip"), "q6": ("", -1, "skip")}


def test_negatives(spark):
    gold = gold_of(spark, [("q0", "a", "t", "d", 0), ("q1", "a", "t", "d", 2), ("q2", "a", "t", "one", 0), ("q3", "a", "t", "d", 5)])
    pages = spark.createDataFrame([("d", 0), ("d", 1), ("d", 2), ("d", 5), ("one", 0)], "doc_id string, page_idx int")
    pick = lambda df: sorted((r.query_id, r.neg_page_idx, r.neg_source) for r in df.collect())
    assert pick(negatives.adjacent_negatives(gold, pages)) == [("q0", 1, "adjacent_next"), ("q1", 1, "adjacent_prev")]
    assert pick(negatives.adjacent_negatives(gold, mode="unchecked")) == [("q0", 1, "adjacent_next"), ("q1", 1, "adjacent_prev"), ("q2", 1, "adjacent_next"), ("q3", 4, "adjacent_prev")]
    assert pick(negatives.far_negative(gold, pages)) == [("q0", 5, "same_doc_far"), ("q1", 5, "same_doc_far"), ("q3", 0, "same_doc_far")]
    hits = spark.createDataFrame([("q0", 1, "d", 0), ("q0", 2, "d", 5), ("q1", 1, "d", 2)], "query_id string, rank int, doc_id string, page_idx int")
    assert pick(negatives.first_wrong(hits, gold, "bm25_hard")) == [("q0", 5, "bm25_hard")]
    large = negatives.trainset("large", gold, pages, hits).collect()
    assert sorted(r.sample_id for r in large if r.query_id == "q0") == ["q0_adjacent_next", "q0_bm25"]  # the farthest page repeats the lexical one
    v4 = negatives.trainset("v4", gold, pages, hits, base=negatives.trainset("v1", gold, pages, hits, vision=hits))
    assert {r.neg_source for r in v4.collect()} >= {"bm25_hard", "adjacent_next", "adjacent_prev"}
    assert negatives.trainset("v3", gold, pages, hits, base=negatives.trainset("large", gold, pages, hits)).count() == len(large)


def test_split_and_weights(spark):
    df = spark.createDataFrame([(f"q{i % 10}", "a" if i % 4 else "b") for i in range(40)], "query_id string, query_type string")
    s = training.split_by_query(df, 0.25, 1)
    assert s.where("is_val").select("query_id").distinct().count() == 2
    assert s.groupBy("query_id").agg(F.count_distinct("is_val").alias("n")).where("n > 1").isEmpty()
    assert training.split_by_query(df.where("query_id in ('q0', 'q1')"), 0.9, 20).where("is_val").select("query_id").distinct().count() == 1
    w = training.balanced_weights(df)
    drawn = {r.query_type: r.n for r in training.weighted_draw(w, 4000).groupBy("query_type").agg(F.count("*").alias("n")).collect()}
    assert sum(drawn.values()) == 4000 and abs(drawn["a"] - 2000) < 200


def test_losses_and_pooling(spark):
    t = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [0.0, 1.0], [1.0, 0.0])], "q array<double>, p array<double>, n array<double>")
    assert training.hinge_loss(t).first().loss == 0.6
    b = spark.createDataFrame([(0, 0, [1.0, 0.0], [1.0, 0.0]), (0, 1, [0.0, 1.0], [0.0, 1.0])], "batch int, i int, q array<double>, p array<double>")
    assert training.info_nce(b).first().loss == pytest.approx(0.0, abs=1e-5)
    p = spark.createDataFrame([([[1.0], [4.0]], [1, 1]), ([[1.0], [4.0]], [1, 0]), ([[3.0]], [1])], "v array<array<double>>, m array<int>")
    assert [r[0][0] for r in p.select(training.position_pool(F.col("v"), F.col("m"))).collect()] == [pytest.approx(3.0), 1.0, 3.0]
    h = spark.createDataFrame([(1, 2.5), (2, 2.3), (3, 2.3)], "epoch int, val_loss double")
    assert training.best_epoch(h).first().best_epoch == 2


def test_answers(spark):
    rows = ["<one concise answer> 5 kg </one concise answer><confidence>0.9</confidence>", "Answer: yes\nConfidence: 0.5", "7", "Same\nsame\n\nOther", "Confidence: 0.7", None]
    assert values(spark, rows, answers.extract) == ["5 kg", "yes", "", "Same\nOther", "", ""]
    q = values(spark, ["The payload is three kilograms in all, nothing else is known", "Confidence: 0.7", "", "it is common knowledge"], lambda c: F.round(answers.quality(c, F.lit("payload?")), 6))
    assert q == [pytest.approx(x) for x in (1.0, 0.20, 0.40, 0.45)]


def test_answer_lines_count_once(spark):
    many = "\n".join(f"Line {i % 3000}" if i % 2 else f"LINE {i % 3000}" for i in range(9000))
    want = "\n".join(f"Line {i}" if i % 2 else f"LINE {i}" for i in range(3000))
    assert values(spark, ["b\nA\nB\na\nc\n\nC\nb", "x\ny", many], answers.extract) == ["b\nA\nc", "x\ny", want]


def test_answers_are_extracted_once(spark):
    """However often the rules use a text, the plan has its extraction once; else plan and time grow with a power of the number of uses."""
    df = spark.createDataFrame([("a", "b")], "t string, q string").select(answers.quality(F.col("t"), F.col("q")).alias("quality"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?is)</?confidence>") == 1


def test_answer_choice(spark):
    df = spark.createDataFrame([("q", "rated payload?", "x", "", "", 0.0, "The rated payload is 3 kg, as the table on this page says in so many words")], "query_id string, question string, single string, stitched string, per_page string, per_page_blend double, joint string")
    r = answers.select_answer(df).first()
    assert (r.selected_strategy, r.selection_score) == ("multi_image_joint", pytest.approx(0.35 + 0.75 * 1.0))


def test_prompts(spark):
    for mode in ("per_page", "joint", "stitched", "single"):
        (p,) = values(spark, ["How?"], lambda c, m=mode: answers.prompt(c, m))
        assert p.endswith("Question: How?")
