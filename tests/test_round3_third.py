"""What the third pass over the findings of round 3 changed: steps that were worked out more than once."""

import contextlib
import io

from moorage.operators import merge, retrieval, search_index
from moorage.plans import surface_queries


def plan(df) -> str:
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain()
    return out.getvalue()


def test_rows_are_merged_with_one_fold_and_two_shuffles(spark):
    held = [(1, "f", 0, 0, "a b", "x", "1"), (1, "f", 0, 0, "a b", "y", "2"), (1, "f", 1, 0, "A.B", "x", "3"), (1, "f", 1, 1, "ab", "z", "4"), (1, "f", 2, 0, ".", "x", "5"), (1, "f", 2, 0, "ab", "w", " "), (None, "f", 0, 0, "c", "x", "6"), (2, None, 0, 0, "c", "x", "7")]
    cells = spark.createDataFrame(held, "form_id long, field string, rank int, row int, row_key string, column string, value string")
    merged = merge.merged_rows(cells)
    assert plan(merged).count("ArrowEvalPython") == 1
    assert plan(merged).count("Exchange") == 2
    assert sorted(merged.collect()) == [(1, "f", "ab", "x", "1"), (1, "f", "ab", "y", "2"), (1, "f", "ab", "z", "4")]


def test_texts_are_cleaned_once_for_folding_and_tokens(spark, tmp_path):
    spark.createDataFrame([(1, "A-b 12 page 3 가나다는"), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    stats = surface_queries.sql_text_stats(spark, str(tmp_path))
    assert plan(stats).count("NO_TEXT") == 1
    assert sorted((r.doc_id, r.folded_chars, r.n_tokens) for r in stats.collect()) == [(1, 8, 4), (2, 0, 0), (3, 0, 0)]


def test_index_scores_documents_in_their_rows(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, [f"t{i % 7}", f"t{i % 5}", "all", ""][: i % 4 + 1]) for i in range(60)] + [(60, [])], "d long, tokens array<string>")
    queries = spark.createDataFrame([("a", "t1"), ("a", "all"), ("b", "t3"), ("b", "t4"), ("c", "none")], "query string, term string")
    search_index.build_index(docs, "d", docs["tokens"], str(tmp_path), block=4, part=20, buckets=2)
    found = search_index.search_index(spark, str(tmp_path), queries, "d", 4)
    assert "LeftSemi" not in plan(found)
    rows = lambda df: sorted((r.query, r.d, round(r.score, 9), r["rank"]) for r in df.collect())
    got = rows(found)
    monkeypatch.setattr(retrieval, "SENT_PAIRS", 0)
    assert len(got) == 8
    assert got == rows(search_index.search_index(spark, str(tmp_path), queries, "d", 4))
