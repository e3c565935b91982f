"""The ingest stream over a table that is a folder of files."""

from datetime import datetime

import pytest

from mailweave.plans import ingesting


@pytest.mark.parametrize("files", [1, 3])
def test_stream_reads_a_folder_of_documents(spark, tmp_path, files):
    docs = spark.createDataFrame([(i, f"word{i} text", "en", "src1", 10) for i in range(1, 10)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    events = [(5 * i, datetime(2024, 1, 1), i) for i in range(1, 10)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    rows = ingesting.stream_ingest(spark, str(tmp_path)).collect()
    assert {(r.id, r.body_text) for r in rows} == {(i, f"word{i} text") for i in range(1, 10)}
