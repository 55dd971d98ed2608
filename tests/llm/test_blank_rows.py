"""The substring stage drops a text only if it took something from it and left nothing but white space."""

from __future__ import annotations

import corpus_pipeline


def test_blank_rows_stay(spark):
    passage = " ".join(f"Word{i} of one long passage stands here." for i in range(8))
    rows = [(0, passage), (1, "\n" + passage), (2, ""), (3, "  "), (4, "\n"), (5, None), (6, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.remove_repeated_passages(spark, df, "")
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {0: passage, 2: "", 3: "  ", 4: "\n", 5: None}
