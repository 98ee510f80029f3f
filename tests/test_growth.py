"""What a query's plan must hold to, so that its memory doesn't grow with the input."""

import hashlib

import pyarrow as pa
import pytest

from palimpsest.functions import text as X
from palimpsest.operators import pages
from palimpsest.plans import queries as Q

SF = "/root/testdata/sf0.001"


def planned(df):
    """The plan before any stage has run, in which sizes of tables are guessed from their files."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["known_tokens", "field_report", "pdf_tables", "pdf_html"])
def test_rows_exploded_of_texts_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in planned(Q.QUERIES[name](spark, SF))


def test_flat_fingerprint_has_no_limit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "FLAT", 10)
    rows = [("b", "2é"), ("a", "1"), ("a", ""), (None, "x" * 100)]
    spark.createDataFrame(rows, "url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = Q.QUERIES["catalog_fingerprint"](spark, str(tmp_path)).first().fingerprint
    assert got == hashlib.sha256("".join(f"{p}\n{t}\n" for p, t in sorted((p or "", t) for p, t in rows)).encode()).hexdigest()


def test_fingerprint_of_nothing(spark):
    assert X.streamed_fingerprint(spark.createDataFrame([], "p string, t string"), "p", "t").first().fingerprint == hashlib.sha256().hexdigest()


def test_nodes_of_pages_are_handed_on_in_small_batches():
    html = "<ul>" + "<li>x</li>" * 500 + "</ul>"
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(40)), "html": [html] * 39 + [None]})
    sizes = [b.num_rows for b in pages._read([batch, batch], "page_id")]
    assert sum(sizes) == 2 * 39 * 1001 and max(sizes) <= pages.HELD + 1001 < 39 * 1001


def test_matches_of_prose_blocks_are_found_once_a_pass(spark):
    plan = planned(Q.QUERIES["prose_blocks"](spark, SF))
    assert plan.count("regexp_extract_all(") == 1


@pytest.mark.parametrize("name", ["marker_warnings", "loop_markers"])
def test_markers_are_read_where_a_text_is(spark, name):
    assert "Exchange" not in planned(Q.QUERIES[name](spark, SF))
