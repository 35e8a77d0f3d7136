import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.functions import deep

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(), c, max_size=4), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_same_as_the_standard_library(v):
    text = json.dumps(v)
    assert deep._built(text, dict) == v and deep._built(json.dumps(v, indent=2, ensure_ascii=False), dict) == v
    assert deep._deep_text(v, False) == json.dumps(v, ensure_ascii=False) and deep._deep_text(v, True) == json.dumps(v, ensure_ascii=False, sort_keys=True)
    assert json.loads(deep.canonical(v)) == v


@pytest.mark.parametrize("bad", ["", "{", "[1,]", '{"a" 1}', "{a:1}", "01", "1 2", "[1", '{"a":1,}', "NaN", "tru", '"a', "[1}", '{"a":1]', "-"])
def test_what_is_no_json(bad):
    with pytest.raises(ValueError):
        json.loads(bad, parse_constant=deep._reject)
    with pytest.raises(ValueError):
        list(deep.events(bad))


def test_twenty_thousand_levels():
    text = '{"a": [' * 10_000 + "1.0" + "]}" * 10_000
    v = deep.loads(text)
    assert deep.dumps(v) == text and deep.canonical(v) == text.replace("1.0", "1")
    assert deep.loads('{"b": 1, "a": 2}', list) == [("b", 1), ("a", 2)]
