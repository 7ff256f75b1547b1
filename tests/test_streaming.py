"""Incremental ingest: new files are picked up once, with the batch operators."""

from __future__ import annotations

import json
import uuid

from conftest import delivery, match_doc

from crease.streaming.ingest import start_ingest


def test_incremental_ingest_appends_new_files_once(spark, tmp_path):
    landing, target = tmp_path / "landing", tmp_path / "out"
    (landing / "ipl").mkdir(parents=True)
    o = [[delivery(), delivery()]]
    (landing / "ipl" / "1.json").write_text(json.dumps(match_doc([("T1", o)])))
    (landing / "ipl" / "x.json").write_text("{broken")
    name = f"ingest-{uuid.uuid4().hex[:8]}"
    q = start_ingest(spark, str(landing), str(target), name=name)
    q.awaitTermination(120)
    (landing / "ipl" / "2.json").write_text(json.dumps(match_doc([("T1", o), ("T2", o)])))
    q = start_ingest(spark, str(landing), str(target), name=name)
    q.awaitTermination(120)
    fact = spark.read.parquet(str(target / "fact_ball"))
    assert sorted((r.match_id, r.n) for r in fact.groupBy("match_id").count().withColumnRenamed("count", "n").collect()) == [("1", 2), ("2", 4)]
    assert [r.match_id for r in spark.read.parquet(str(target / "quarantine")).collect()] == ["x"]
