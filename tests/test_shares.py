"""Frequency limits as shares of a party's records."""

import duckdb
import pytest

from tessera.plans import catalogue
from tessera.plans import fixture_sql as S


@pytest.mark.parametrize(("sf", "alice"), [("sf0.001", 134), ("sf0.01", 667)])
def test_limits_follow_the_party(spark, sf, alice):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    expected = {}
    for share in (0.02, 0.03, 0.04, 0.05, 0.06, 0.07):
        sql = catalogue.with_(S.PARTIES, S.signed(S.SIGNATURES, catalogue.LOW, int(share * alice)), catalogue._PAIRS) + S.assessment("pairs")
        expected[share] = con.execute(sql).fetchall()[0]
    got = {r["drop_ratio"]: tuple(r)[1:] for r in catalogue.QUERIES["drop_ratio_metrics"](spark, f"/root/testdata/{sf}").collect()}
    one = catalogue.QUERIES["psig_share_metrics"](spark, f"/root/testdata/{sf}").first()
    assert set(got) == set(expected) and tuple(one) == (0.05, *got[0.05])
    for share, row in expected.items():
        assert got[share] == pytest.approx(row)
