"""Response shapes, attempts and the ledger."""

import pytest

from themescope.functions.responses import read_labels, read_responses
from themescope.operators import attempts as att, joins
from themescope.schemas import RESPONSES

SHAPES = [
    ('{"topics":["a"," b ","a"],"sentiment":"Negative"}', ["a", "b"], "Negative"),
    ('["x","y"]', ["x", "y"], "Neutral"),
    ('[1,{"topics":["z"]}]', ["z"], "Neutral"),
    ('[{"topics":["q"]},{"topics":["r"]}]', ["q"], "Neutral"),
    ('"text"', None, "Neutral"),
    ("5", None, "Neutral"),
    ("{bad", None, "Neutral"),
    ("", None, "Neutral"),
    (None, None, "Neutral"),
    ('{"topics":[7,null,true]}', ["7", "true"], "Neutral"),
    ('{"topics":["1","2","3","4","5","6"]}', ["1", "2", "3", "4", "5"], "Neutral"),
    ('{"topics":["  ","\\t\\u00a0"]}', None, "Neutral"),
    ('{"topics":["a"],"sentiment":"negative"}', ["a"], "Neutral"),
    ('{"topics":["a"]} trailing', None, "Neutral"),
    ('{"topics":["a"]}]', None, "Neutral"),
    ('{"topics":["a"]},{"topics":["b"]}', None, "Neutral"),
    ('{"topics":"plain"}', None, "Neutral"),
    ("[]", None, "Neutral"),
    ("{}", None, "Neutral"),
    ('{"topics":["\\u00a0caf\\u00e9 \\"x\\" "],"sentiment":"Positive"}', ['café "x"'], "Positive"),
]


def test_shapes(spark):
    rows = spark.createDataFrame([(i, raw) for i, (raw, _, _) in enumerate(SHAPES)], "i int, raw string")
    got = {r.i: (r.topics, r.ok, r.sentiment) for r in read_responses(rows).collect()}
    for i, (raw, topics, sentiment) in enumerate(SHAPES):
        assert got[i] == (topics, topics is not None, sentiment), raw


def test_quote_and_reason(spark):
    raw = ['{"topics":["a"],"supporting_quote":null}', '{"topics":["a"],"supporting_quote":"%s","reason":"r"}' % ("q" * 161)]
    got = read_responses(spark.createDataFrame([(r,) for r in raw], "raw string")).collect()
    assert sorted((len(r.supporting_quote), r.reason) for r in got) == [(0, ""), (160, "r")]


def test_labels(spark):
    raw = ['{"label":"  Late fees "}', '[3,{"label":"Fees"}]', '["Fees"]', '{"label":" "}', "junk", None]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    assert [r.label for r in read_labels(rows).orderBy("i").collect()] == ["Late fees", "Fees", None, None, None, None]


GOOD, OTHER = '{"topics":["t"]}', '{"topics":["u"]}'


def attempt(cid, rank, n, status=200, error=None, raw=None):
    return ("d", cid, f"m{rank}", rank, n, status, error, raw, 10, 1)


CASES = {
    1: ([attempt(1, 0, 0, raw=GOOD)], "m0", None),
    2: ([attempt(2, 0, 0, 429), attempt(2, 0, 1, raw=GOOD)], "m0", None),
    3: ([attempt(3, 0, 0, 404), attempt(3, 1, 0, raw=OTHER)], "m1", None),
    4: ([attempt(4, 0, 0, 503), attempt(4, 0, 1, None, "APITimeoutError"), attempt(4, 1, 0, 404)], "", "m1 - 404"),
    5: ([attempt(5, 1, 0, raw=OTHER), attempt(5, 0, 0, raw=GOOD)], "m0", None),
    # After a fatal error the model gets no second try, whatever was recorded.
    6: ([attempt(6, 0, 0, 404), attempt(6, 0, 1, raw=GOOD), attempt(6, 1, 0, raw=OTHER)], "m1", None),
    # Attempts beyond the limit do not count.
    7: ([attempt(7, 0, 0, 429), attempt(7, 0, 1, 429), attempt(7, 0, 2, raw=GOOD)], "", "m0 - 429"),
    8: ([attempt(8, 0, 0, raw="{}"), attempt(8, 1, 0, raw=OTHER)], "m1", None),
}


@pytest.fixture(scope="module")
def resolved(spark):
    rows = [row for attempts, _, _ in CASES.values() for row in attempts]
    return att.resolve_attempts(spark.createDataFrame(rows, RESPONSES)).persist()


def test_resolution(resolved):
    got = {r.complaint_id: (r.model_version, r.error) for r in resolved.collect()}
    assert got == {cid: (model, error) for cid, (_, model, error) in CASES.items()}


def test_one_shuffle(spark, plan):
    rows = spark.createDataFrame([CASES[1][0][0]], RESPONSES)
    assert plan(att.resolve_attempts(rows)).split("(1)")[0].count("Exchange") == 1


def test_ledger(resolved):
    row = att.run_ledger(resolved, resumed_from=5).first()
    assert (row.rows_in, row.rows_out, row.newly_processed, row.failed) == (13, 11, 6, 2)
    assert (row.total_topics, row.prompt_tokens, row.completion_tokens) == (6, 60, 6)
    assert row.failure_samples == "m1 - 404\nm0 - 429"
    assert {r.model_version: r.served for r in att.model_usage(resolved).collect()} == {"m0": 3, "m1": 3}


def test_missing_result_is_a_failure(spark, resolved):
    rows = spark.createDataFrame([("d", 1), ("d", 99)], "dataset_id string, complaint_id long")
    joined = joins.attach_results(rows, resolved, joins.RUN_KEY)
    assert {r.complaint_id: r.extraction_ok for r in joined.collect()} == {1: True, 99: False}
    assert [r.complaint_id for r in joins.successful(joined).collect()] == [1]


def test_ids_of_another_data_set_are_not_done(spark):
    todo = spark.createDataFrame([("a", 1), ("b", 1)], "dataset_id string, complaint_id long")
    done = spark.createDataFrame([("a", 1)], "dataset_id string, complaint_id long")
    assert [tuple(r) for r in joins.not_done(todo, done).collect()] == [("b", 1)]


def test_duplicate_truth(spark):
    truth = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "complaint_id long, pos int, label string")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "complaint_id long")
    got = joins.last_truth(ids, truth, "label", "pos").collect()
    assert {r.complaint_id: r.label for r in got} == {1: "b", 2: "c", 3: None}
    with pytest.raises(Exception, match="more than once"):
        joins.with_truth(ids, truth, "label").collect()


def test_source_match(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "complaint_id long")
    row = joins.truth_match(ids(1, 1, 2, 3), ids(1, 2, 2)).first()
    assert (row.predicted_ids, row.matched_ids, row.matches) == (3, 2, True)
    assert joins.truth_match(ids(1, 2), ids(1)).first().matches is False
    assert joins.truth_match(ids(), ids(1)).first().matches is False
