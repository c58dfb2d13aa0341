"""Every operator on nulls, empty and very long texts, ties, repeated rows, clashing columns, and on empty tables."""

import pytest

from conftest_llm import OPERATORS, STAGES


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(odd, labels, name):
    out = OPERATORS[name](odd, labels)
    assert out.count() == (odd.count() if name != "packing" else sum(1 for _ in odd.collect()) + extra_pieces(out))


def extra_pieces(out):
    return out.where("piece > 0").count()


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(none, labels, name):
    assert OPERATORS[name](none, labels.where("false")).collect() == []


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_keeps_columns(odd, none, labels, name):
    out = STAGES[name](odd, labels)
    assert out.dtypes == odd.dtypes and out.count() > 0
    assert STAGES[name](none, labels).count() == 0


def test_repeated_rows_become_one(odd, labels):
    ids = [r["doc_id"] for r in STAGES["near_duplicates"](odd, labels).collect()]
    assert ids.count(6) == 0 and ids.count(5) == 1 and ids.count(7) == 0 and ids.count(None) == 2


def test_texts_without_id_stand_alone(odd, labels):
    rows = {r["doc_id"]: r for r in OPERATORS["near_duplicates"](odd, labels).collect()}
    assert rows[None]["component_id"] is None and rows[None]["kept"]
    assert rows[1]["n_shingles"] == 0 and rows[3]["n_shingles"] == 1 and rows[6]["component_id"] == 5
