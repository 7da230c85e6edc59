"""Views over the tables carry what a query uses."""

from spanwise.plans import fixtures

SF = "/root/testdata/sf0.001"


def test_views_project_one_narrow_table(spark):
    flat, folded, envelopes = fixtures.view(spark, SF, "spans"), fixtures.spans(spark, SF), fixtures.view(spark, SF, "envelopes")
    files = {f for frame in (flat, folded, envelopes) for f in frame.inputFiles()}
    assert files and all("/numbered-" in f for f in files)
    plan = folded.select("trace_id", "span_id")._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema") :]
    assert "okey" in read and "l_extendedprice" not in read
    assert fixtures.stored_spans(spark, SF).exceptAll(folded).isEmpty()


def test_span_table_stores_no_second_copy_of_the_spans(spark, tmp_path):
    import os

    from spanwise.plans import catalog, fixtures

    for file in os.listdir("/root/testdata/sf0.001"):
        os.symlink(f"/root/testdata/sf0.001/{file}", tmp_path / file)
    assert catalog.QUERIES["span_table"](spark, str(tmp_path)).count() > 0
    assert not [k for k in fixtures._stored if k[1:] == (str(tmp_path), "spans")]


def test_unchecked_edges_are_found_once_for_their_two_readers(spark):
    from spanwise.plans import catalog_audit, fixtures

    sf = "/root/testdata/sf0.001"
    unchecked = catalog_audit._evidence(spark, sf, fixtures.spans(spark, sf))["unchecked"]
    assert "Join" not in unchecked._jdf.queryExecution().optimizedPlan().toString()
