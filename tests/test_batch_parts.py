"""What a classifier is given at one time is bounded in bytes, whatever the number of rows in an Arrow batch."""

import pandas as pd
import pyarrow as pa

from paperloom.operators import judge


def test_parts_are_bounded_and_whole():
    texts = ["x" * (judge.PART // 2), "é" * judge.PART, None, "", *["y" * 1000] * 3000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["state"])
    got = [p.column("state").to_pylist() for p in judge.parts(batch, "state")]
    assert [t for part in got for t in part] == texts
    assert all(len(part) == 1 or sum(len((t or "").encode()) for t in part) <= judge.PART for part in got)
    assert len(got) <= 2 + 2 + 3000 * 1000 // judge.PART + 1


def test_a_classifier_gets_parts(spark):
    class Sizes:
        def judge_batch(self, requests):
            size = str(requests.state.str.len().sum())
            return pd.DataFrame({"doc_id": requests.doc_id, "name": requests.name, "value": size, "confidence": 1.0, "input_tokens": None, "error": None})

    rows = spark.range(0, 40, 1, 1).selectExpr("id as doc_id", "'a' as name", "repeat('z', 200000) as state")
    got = judge.judge(rows, Sizes()).collect()
    assert len(got) == 40 and max(int(r.value) for r in got) <= judge.PART
