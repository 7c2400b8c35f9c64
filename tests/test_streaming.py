import json

import pytest
from tests.test_documents import MATCH

from rinkflow.schemas import PBP_DOCUMENT
from rinkflow.sources import documents as D
from rinkflow.streaming import ingest


def test_landed_files_are_taken_once(spark, tmp_path):
    landed, target, state = tmp_path / "landed", str(tmp_path / "out"), str(tmp_path / "state")
    landed.mkdir()

    def land(name, doc):
        (landed / name).write_text(doc if isinstance(doc, str) else json.dumps(doc))

    def run():
        ingest.ingest_available(spark, str(landed), target, PBP_DOCUMENT, state, files_per_batch=1)

    land("1.json", {**MATCH, "id": 1})
    land("2.json", '{"id": 2, "plays": [')
    run()
    land("3.json", {**MATCH, "id": 3})
    run()
    run()
    plays = ingest.ingested(spark, target, "plays")
    assert sorted(r["game_id"] for r in plays.select("game_id").collect()) == [1] * 5 + [3] * 5
    status = ingest.ingested(spark, target, "status")
    assert sorted(r["state"] for r in status.collect()) == ["complete", "complete", "failed"]
    batch = D.flatten_pbp(D.split_bad(D.read_documents(spark, str(landed), PBP_DOCUMENT).cache())[0])
    a = {tuple(r) for r in plays.select("game_id", "event_id", "event_type", "x_coord").collect()}
    assert a == {tuple(r) for r in batch.select("game_id", "event_id", "event_type", "x_coord").collect()}


@pytest.mark.parametrize("log", ["offsets/0", "commits/0", "metadata"])
def test_unreadable_state_starts_fresh(spark, tmp_path, log):
    landed, target, state = tmp_path / "landed", str(tmp_path / "out"), tmp_path / "state"
    landed.mkdir()

    def run():
        return ingest.ingest_available(spark, str(landed), target, PBP_DOCUMENT, str(state))

    (landed / "1.json").write_text(json.dumps({**MATCH, "id": 1}))
    assert run() == 0 and run() == 0
    broken = state / "generation=0" / log
    assert ingest.sound_state(spark, str(state / "generation=0"))
    broken.write_text('v1\n{"batch')
    broken.with_name(f".{broken.name}.crc").unlink()
    (landed / "2.json").write_text(json.dumps({**MATCH, "id": 2}))
    with pytest.warns(UserWarning, match="unreadable state"):
        assert run() == 1
    assert run() == 1
    plays = ingest.ingested(spark, target, "plays")
    assert sorted(r["game_id"] for r in plays.select("game_id").collect()) == [1] * 5 + [2] * 5
    assert ingest.ingested(spark, target, "status").count() == 2
