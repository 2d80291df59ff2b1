"""The registered queries at the smallest scale against their SQL in DuckDB."""

import duckdb
import pytest

from termloom.plans import catalog

SF = "/root/testdata/sf0.001"
#: Those that take long for little; they are held against SQL at a larger scale by the driver.
QUICK = [n for n in catalog.SQL if n not in ("fuzzy_candidates", "fuzzy_tokens")]


def norm(rows, names):
    return sorted(repr(tuple(x for _, x in sorted(zip(names, r)))) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = norm([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    expected = norm(cur.fetchall(), names)
    if name == "knn_cosine":  # ids and ranks; the last of four places of a similarity may differ
        near = lambda rows, names: {(r[names.index("query_id")], r[names.index("rn")]): (r[names.index("vector_id")], r[names.index("similarity")]) for r in rows}
        a, b = near([tuple(r) for r in df.collect()], df.columns), near(con.execute(catalog.SQL[name]).fetchall(), names)
        assert set(a) == set(b) and all(a[k][0] == b[k][0] and abs(a[k][1] - b[k][1]) < 2e-4 for k in a)
        return
    assert got == expected


def test_broken_rows_are_counted(spark):
    assert all(r.violations > 0 for r in catalog.QUERIES["validate_kb"](spark, SF).collect())


@pytest.mark.parametrize("name", ["scan_synonyms", "scan_drugs", "token_sort_ratio", "token_set_ratio", "vec_index_roundtrip", "edit_suggestions", "fuzzy_score"])
def test_query_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_whole_table_in_the_vector_index(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id", "cast(label AS string)", "size(embedding)").collect()
    got = catalog.QUERIES["vec_index_roundtrip"](spark, SF).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(map(tuple, e)) and {r["count"] for r in got} == {len(e)}
