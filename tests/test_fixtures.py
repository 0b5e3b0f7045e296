"""Counts at sf0.01 that were measured in DuckDB before anything here was written."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ferrywell.operators import cdc, cleaning, reconcile
from ferrywell.plans import loads
from ferrywell.plans.inputs import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def strict(spark):
    return cleaning.clean_strict(table(spark, SF, "dirty_events"))


def test_strict_cleaning(strict):
    assert strict.cleaned.count() == 9_876
    reasons = {r.reason: r["count"] for r in strict.quarantine.groupBy("reason").count().collect()}
    assert reasons == {cleaning.EMPTY: 103, cleaning.DUPLICATE: 247, cleaning.OUTLIER: 24}
    assert dict(strict.cleaned.dtypes)["user_txt"] == "double"
    assert dict(strict.cleaned.dtypes)["amount_txt"] == "string"


def test_every_row_is_kept_somewhere(spark, strict):
    assert strict.cleaned.count() + strict.quarantine.count() == table(spark, SF, "dirty_events").count() == 10_250


def test_profiles_differ(spark):
    dirty = table(spark, SF, "dirty_events")
    nulls = {}
    for profile in ("strict", "basic"):
        cells = cleaning.null_tokens(cleaning.trim_cells(dirty), profile)
        rows = cleaning.dedup_rows(cleaning.drop_empty_rows(cells))
        assert rows.count() == 9_900
        nulls[profile] = rows.where("type_txt is null").count()
    assert nulls == {"strict": 1_114, "basic": 654}


def test_change_feed(spark):
    feed, base = table(spark, SF, "change_feed"), table(spark, SF, "cdc_base")
    counts = cdc.cdc_counts(feed).first()
    assert (counts.inserts, counts.updates, counts.deletes) == (8_250, 3_750, 1_500)
    applied = cdc.cdc_apply(base, feed, ["k"])
    assert applied.agg(F.count("*"), F.sum("price")).first()[:] == (14_250, Decimal("3576881111.47"))
    assert cdc.broken_changes(table(spark, SF, "change_log")).count() == 140


def test_incremental_counts(spark):
    versions, old = table(spark, SF, "orders_versioned"), table(spark, SF, "target_orders")
    assert loads.resume_point(old, "updated_at") == "1999-12-31 00:00:00"
    assert loads.incremental_extract(versions, old, "updated_at").count() == 4_007


def test_reconciliation(spark):
    columns = ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_quantity"]
    source, target = table(spark, SF, "lineitem").select(columns), table(spark, SF, "target_lineitem")
    verdict = reconcile.reconcile(source, target).first()
    assert (verdict.source_rows, verdict.target_rows, verdict.row_count_diff) == (60_000, 59_936, 64)
    assert not verdict.overall_passed
    price = reconcile.reconcile_sums(source, target).where("column_name = 'l_extendedprice'").first()
    assert (price.source_sum, price.target_sum) == ("3183256271.630000000", "3180143181.840000000")
    assert reconcile.reconcile(source, source).first().overall_passed
