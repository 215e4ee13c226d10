"""Segmentation against all ways to cut a run, and keywords of Chinese samples."""

import math
from collections import Counter
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from siftmark.functions.fixed import BUSINESS_TERMS
from siftmark.operators import generate, segment


def ways(run):
    for k in range(len(run)):
        for cuts in combinations(range(1, len(run)), k):
            edge = [0, *cuts, len(run)]
            yield [run[a:b] for a, b in zip(edge[:-1], edge[1:])]


@settings(max_examples=250, deadline=None)
@given(st.dictionaries(st.text("客户名称单", min_size=1, max_size=4), st.integers(1, 50), max_size=14), st.text("客户名称单x", min_size=1, max_size=9))
def test_best_path_against_all_ways(words, run):
    s = segment.Segmenter(words)
    worth = lambda way: sum(s.cost.get(w, s.unknown) if len(w) == 1 else s.cost.get(w, -math.inf) for w in way)
    got = s.best(run)
    assert "".join(got) == run and math.isclose(worth(got), max(map(worth, ways(run))), rel_tol=1e-12)


SENTENCES = ["客户名称是四川公司", "请核对客户名称和联系人", "联系人的电话", "合同金额与客户名称", "付款节点和合同金额", "合同金额很高", "四川公司的联系人", "四川公司很好"]


def test_a_learned_dictionary_and_keywords(spark):
    rows = [(i, s * 3, "客户资料", None) for i, s in enumerate(SENTENCES * 3)] + [(99, None, None, "plain words here"), (100, "", "", "")]
    df = spark.createDataFrame(rows, "id long, text string, sensitive_type string, description string")
    known = segment.learned(df, least=5, bound=3.0)
    assert {"四川", "公司"} <= set(known) or "四川公司" in known
    s = segment.Segmenter(known, BUSINESS_TERMS)
    for run in SENTENCES:
        for term in BUSINESS_TERMS:
            longer = [t for t in BUSINESS_TERMS if term in t and t != term and t in run]
            if term in run and not longer:
                assert term in s.best(run), (run, term, s.best(run))
    long = "本次会议讨论了客户名称和合同金额以及付款节点的安排并且决定下周与四川公司的联系人见面讨论具体的细节问题"
    got = {r.word: r.score for r in generate.keywords(spark.createDataFrame([(1, long, "", "")], "id long, text string, sensitive_type string, description string"), "id", top=60, dictionary=known).collect()}
    assert {"客户名称", "合同金额", "付款节点", "联系人"} <= set(got) and got["客户名称"] > 80 and "的" not in got
    plain = {r.word for r in generate.keywords(spark.createDataFrame([(1, long, "", "")], "id long, text string, sensitive_type string, description string"), "id", terms=(), top=60).collect()}
    assert plain == set()  # without a dictionary a long run is no word


def test_points_by_rank(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b", "c"]), (2, ["b", "c"]), (3, ["c"]), (4, [])], "id long, words array<string>")
    got = Counter({(r.id, r.word): r.points for r in segment.best_words(df, "id", "words", 2).collect()})
    assert got == {(1, "a"): 60, (1, "b"): 59, (2, "b"): 60, (2, "c"): 59, (3, "c"): 60}


def test_segmented_columns(spark):
    df = spark.createDataFrame([(1, ["ab", None, ""], "x"), (2, None, "y")], "id long, runs array<string>, `a b` string")
    out = segment.segmented(df, "runs", {"a": 1, "b": 1, "ab": 5})
    assert out.columns == ["id", "runs", "a b", "cut"] and {r.id: r.cut for r in out.collect()} == {1: ["ab"], 2: []}


def test_keywords_move_samples_not_words(spark):
    from siftmark.operators import generate

    rows = spark.range(40).selectExpr("id AS doc_id", "concat('alpha beta gamma delta token ', id) AS text", "'a' AS sensitive_type", "'b' AS description")
    plan = generate.keywords(rows, "doc_id", terms=["token"])._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning(") == 1


def test_patterns_of_rules_run_behind_their_literals(spark):
    from siftmark.operators import generate

    rows = spark.createDataFrame([(1, "mail me@example.org", "", "", ""), (2, "APIKEY: ABCDEFGH12345678901", "", "", ""), (3, None, None, None, None)], "doc_id long, text string, sensitive_type string, risk_level string, description string")
    made = generate.rules(rows, "doc_id")
    assert {r.doc_id for r in made.where("rule_type = 'regex' AND rule_name = 'email'").collect()} == {1}
    plan = made._jdf.queryExecution().analyzed().toString()
    assert "_folded#" in plan
