"""Every catalogue query against its SQL on the small tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tamarack import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in table.to_pylist()), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, con, name):
    got = plans.QUERIES[name](spark, sf_dir).toArrow()
    if name in plans.ORACLES:
        want = con.sql(plans.ORACLES[name]).to_arrow_table()
        assert rows(got) == rows(want)
    else:
        assert got.num_rows > 0


def test_oracles_have_queries():
    assert set(plans.ORACLES) <= set(plans.QUERIES)


def test_lda_topics_keep_rare_words(spark, tmp_path):
    """A document of words that are rarer than 600 others has topics, and topics are returned."""
    common = " ".join(f"common{i}" for i in range(600))
    texts = [(1, common), (2, common), (3, " ".join(f"rare{i}" for i in range(40))), (4, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in plans.QUERIES["lda_topics"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    for i in (1, 2, 3):
        assert len(got[i]["topics"]) == 5 and sum(got[i]["topics"]) == pytest.approx(1)
        assert got[i]["topics"][got[i]["leading"]] == max(got[i]["topics"])
    assert max(got[3]["topics"]) > 0.5 and got[4]["leading"] is None
