import pytest
from oracle import differences, views

from weftline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name, tmp_path):
    df = queries.QUERIES[name](spark, sf)
    if name in queries.SQL:
        assert differences(views(sf), df, queries.SQL[name], str(tmp_path / "out")) == 0
    else:
        assert df.count() > 0
