from __future__ import annotations

import json
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)  # for Python workers


@pytest.fixture(scope="session")
def spark():
    from crease.session import build_session

    s = build_session("local[4]", app="crease-tests", extra={"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()


def docs_frame(spark, docs: dict):
    """{path: dict or raw text} -> DataFrame(path, text)."""
    rows = [(p, d if isinstance(d, str) else json.dumps(d)) for p, d in docs.items()]
    return spark.createDataFrame(rows, "path string, text string")


def delivery(batter="A", bowler="X", non_striker="B", runs=(0, 0, 0), **extra) -> dict:
    d = {"batter": batter, "bowler": bowler, "non_striker": non_striker,
         "runs": {"batter": runs[0], "extras": runs[1], "total": runs[2]}}
    d.update(extra)
    return d


def match_doc(innings, teams=("T1", "T2"), registry=None, event=None, gender="male", version="1.1.0",
              season="2024", venue="Ground", city=None, dates=("2024-04-01",), **info_extra) -> dict:
    """innings: list of (team, overs) where overs is a list of delivery lists (over i = position i)."""
    names = {"A", "B", "C", "X", "Y"}
    info = {
        "event": event if event is not None else {"name": "Indian Premier League"},
        "gender": gender, "season": season, "dates": list(dates), "teams": list(teams), "venue": venue,
        "registry": {"people": registry if registry is not None else {n: f"id-{n}" for n in sorted(names)}},
    }
    if city is not None:
        info["city"] = city
    info.update(info_extra)
    inns = [{"team": team, "overs": [{"over": i, "deliveries": ds} for i, ds in enumerate(overs)]} for team, overs in innings]
    return {"meta": {"data_version": version}, "info": info, "innings": inns}
