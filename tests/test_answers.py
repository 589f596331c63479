"""Exact scores of answers by rule."""

import json

from tracequarry.operators import scoring

NEW, OTHER, GUESS, SECOND, KNOWN = (f"{c * 8}-1111-4222-8333-{c * 12}" for c in "abcde")


def scores(truth, given, context="", kinds=None):
    x = scoring.exact(truth, given, context, kinds)
    return x["match"], x["match_strict"], x["text_match"], x["outcome_match"]


def both(truth, given, **more):
    return scores(json.dumps(truth), json.dumps(given), **more)[:2]


def test_types_and_order():
    assert both({"a": 1, "b": [1.0, None]}, {"b": [1, None], "a": 1.0}) == (True, True)
    assert both({"a": True}, {"a": 1}) == both({"a": None}, {"a": False}) == both({"a": "1"}, {"a": 1}) == (False, False)
    assert both({"l": [3, 1, 1, 2]}, {"l": [1, 2, 3, 1]}) == (True, False)
    assert both({"l": [3, 1, 1]}, {"l": [3, 3, 1]}) == both({"l": [1]}, {"l": [1, 1]}) == (False, False)
    assert both({"l": [{"a": 1}, {"a": 2}]}, {"l": [{"a": 2}, {"a": 1}]}) == (False, False)
    assert scores("{1: 'a'}", '{"1": "a"}')[:2] == (True, True)


def test_groups_in_texts():
    assert both({"m": "one of ['b', 'a'], not {c, d}"}, {"m": "one of ['a', 'b'], not {d, c}"}) == (True, False)
    assert both({"m": "of [a, b]"}, {"m": "of [a, c]"}) == both({"m": "of [a, b]"}, {"m": "of {a, b}"}) == (False, False)
    assert both({"m": f"of [{NEW}, x, {OTHER}]", "id": OTHER}, {"m": f"of [{GUESS}, {SECOND}, x]", "id": SECOND}) == (True, False)


def test_one_for_one():
    assert both({"a": NEW, "b": [NEW, OTHER]}, {"a": GUESS, "b": [GUESS, SECOND]}) == (True, True)
    assert both({"a": NEW, "b": [OTHER, NEW]}, {"a": GUESS, "b": [GUESS, SECOND]}) == (True, False)
    assert both({"a": NEW, "b": NEW}, {"a": GUESS, "b": SECOND}) == both({"a": NEW, "b": OTHER}, {"a": GUESS, "b": GUESS}) == (False, False)
    assert both({NEW: {"n": 1}, OTHER: {"n": 2}}, {GUESS: {"n": 2}, SECOND: {"n": 1}}) == (True, True)
    assert both({NEW: {"n": 1, "l": [3, 4]}, OTHER: {"n": 2, "l": [5, 6]}, "first": NEW}, {GUESS: {"n": 1, "l": [4, 3]}, SECOND: {"n": 2, "l": [5, 6]}, "first": SECOND}) == (False, False)


def test_known_and_new():
    assert both({"id": NEW}, {"id": KNOWN}, context=KNOWN) == both({"id": KNOWN}, {"id": NEW}, context=KNOWN) == (False, False)
    assert both({"id": KNOWN}, {"id": KNOWN}, context=KNOWN) == both({"id": NEW}, {"id": NEW}) == (True, True)
    assert both({"at": "2026-01-02T03:04:05.5"}, {"at": "2024-01-02 03:04"}) == (True, True)
    assert both({"at": "2026-01-02"}, {"at": "2024-01-02 03:04"}) == both({"at": "2026-01-02"}, {"at": "2026-01-03"}, kinds={"uuid"}) == (False, False)
    assert both({"due": "2026-01-05", "made": "2026-01-01"}, {"due": "2026-01-01", "made": "2026-01-01"}, context="2026-01-01") == (True, True)
    assert both({"at": 1788453640}, {"at": 5}) == both({"k": "U1:1788453640"}, {"k": "U1:123456789"}) == (True, True)
    assert both({"at": 1788453640}, {"at": 5}, context="1788453640") == both({"k": "U1:17884536401234567"}, {"k": "U1:17884536401234568"}) == (False, False)


def test_outcome_and_text():
    assert scores("{'success': False, 'error': 'x'}", '{"success": false, "error": "y"}') == (False, False, False, True)
    assert scores("{'success': True}", '{"success": 1}') == (False,) * 4
    assert scores("{'success': True}", "```python\n{'success':  True}\n```") == (True,) * 4
    assert scores("some   text", "some text") == (True,) * 4 and scores("some text", None) == (False,) * 4
    assert scores("None", "None") == (True,) * 4 and scores("None", "{'success': True}")[3] is False
    x = scoring.exact(f"{{'id': '{NEW}'}}", "prose", "")
    assert (x["kind"], x["generated"], x["predicted"], x["parsed"]) == ("message", True, True, False)


def test_values_that_stand_for_others():
    t, g = f"{{'a': '{NEW}', 'b': ['{OTHER}', 'x']}}", f"{{'b': ['x', '{SECOND}'], 'a': '{GUESS}'}}"
    assert scoring.bound(t, g, "", None) == {NEW: GUESS, OTHER: SECOND}
    assert scoring.bound(t, "no value", "", None) is None


def test_mutations_are_spread_over_tasks(spark):
    """A small table, of one partition, whose answers take long; truths that follow each other, repeat or are no value."""
    truth = lambda i: f"{{'success': True, 'message': 'Order {NEW} of [b, a].', 'id': '{NEW}', 'of': '{KNOWN}', 'n': {i}, 'l': [1, {i + 2}], 'r': [{{'x': 1}}, {{'x': 2}}]}}"
    rows = [(truth(i // 2), f"order {KNOWN}", ["uuid"]) for i in range(40)] + [("no value", "", None), ("{'a': [[[[" + "1" * 300 + "]]]]}", "", None), (None, None, None)]
    x = scoring.scorer_mutations(spark.createDataFrame(rows, "truth string, context string, shapes array<string>").coalesce(1))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    above, _, below = x._jdf.queryExecution().optimizedPlan().toString().partition(f"Repartition {tasks}, true")
    assert tasks > 1 and "Python" in above and below and "Python" not in below
    want = {}
    for t, c, s in rows:
        for rule, gen in scoring.mutated(t or "", c or "", s and set(s)).items():
            got = scoring.exact(t or "", gen, c or "", s and set(s))
            bad = any(v is not None and got[n] != v for n, v in zip(("match", "match_strict", "text_match", "outcome_match"), scoring.MUTATIONS[rule], strict=True))
            n, wrong = want.get(rule, (0, 0))
            want[rule] = (n + 1, wrong + bad)
    assert {r.rule: (r.n, r.violations) for r in x.collect()} == want and want["changed_number"][0] >= 40
