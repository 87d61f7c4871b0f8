from datetime import datetime
from difflib import SequenceMatcher

from corpusmill.plans import evals


def test_whole_texts_across_months(spark, tmp_path):
    # the same first lines, other texts; months without documents between; a source of one document
    rows = [(k, f"title\n{'abcdefg'[k % 7] * 9} {k} tail {'xyz'[k % 3] * k}", "h" if k % 4 else None, datetime(2024, 1 + (k * k) % 11, 1 + k % 28, k % 24)) for k in range(60)]
    rows += [(100, "one", "single", datetime(2024, 5, 1)), (101, None, "h", datetime(2024, 5, 2)), (102, "undated", "h", None), (103, "title\nx", "h", datetime(2024, 1, 1, 9)), (104, "title\ny", "h", datetime(2024, 1, 1, 9))]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, posted_at timestamp").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    kept = [(s or "", at, k, t) for k, t, s, at in rows if t is not None and at is not None]
    for a, b in zip(sorted(kept), sorted(kept)[1:]):
        if a[0] == b[0]:
            want[a[2]] = round(SequenceMatcher(None, a[3], b[3]).ratio(), 6)
    got = evals.adjacent_similarity(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r["doc_id"]: r["similarity"] for r in got} == want
