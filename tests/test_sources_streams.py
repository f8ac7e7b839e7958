import json

import pytest

from maskwright.sources import records
from maskwright.streaming.detection import analysed, windowed_counts
from maskwright.streaming.stateful import lasting_dictionary, low_runs


def test_dialects_and_modes(spark, tmp_path):
    rows = [{"tokens": ["a", "b"], "bio_labels": ["O", "B-CITY"]}, {"tokens": ["a"], "bio_labels": ["O", "O"], "language": "en"}, {"tokens": ["a"], "bio_labels": ["B-NOPE"]}]
    p = tmp_path / "x.jsonl"
    p.write_text("\n".join(map(json.dumps, rows)) + "\n")
    assert records.read_jsonl(spark, str(p)).count() == 1
    assert [r._reject_reason for r in records.read_jsonl(spark, str(p), mode="report").collect()] == [None, "unlike lengths", "unknown label"]
    with pytest.raises(Exception, match="rejected row"):
        records.read_jsonl(spark, str(p), mode="strict").collect()
    assert records.dialect_of(["source_text", "entities", "tokens", "bio_labels"]) == "spans"


def test_literal_spans_and_texts(spark, tmp_path):
    spark.createDataFrame([("Ada Bo", "[[0, 3, 'NAME_1'], [4, 6, 'NAME_2']]")], "unmasked_text string, span_labels string").write.parquet(str(tmp_path / "p"))
    assert [tuple(e) for e in records.read_span_parquet(spark, str(tmp_path / "p")).first().entities] == [(0, 3, "NAME"), (4, 6, "NAME")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes("﻿perché".encode())
    (tmp_path / "t" / "b.txt").write_bytes("caffé".encode("latin-1"))
    assert sorted(r.text for r in records.read_texts(spark, str(tmp_path / "t")).collect()) == ["caffé", "perché"]
    assert records.manifest(spark, str(tmp_path / "t")).count() == 2


def test_publish_once(spark, tmp_path):
    d = spark.createDataFrame([(1, "é"), (2, None)], "a int, b string")
    assert records.publish(d, str(tmp_path / "out")) and not records.publish(d.orderBy("b"), str(tmp_path / "out"))
    with pytest.raises(ValueError):
        records.publish(d.limit(1), str(tmp_path / "out"))
    assert records.options({"tags": "A, B"}, {"keep": "no", "tags": "C"}, defaults={"keep": True, "port": 1}) == {"tags": ["A", "B"], "keep": False, "port": 1}


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    src = str(tmp_path / "turns")
    spark.createDataFrame([(1, 0, "mail a@b.it"), (1, 1, "again A@b.it and c@d.it"), (2, 0, "none")], "conv_id long, turn long, text string").write.parquet(src)
    stream = spark.readStream.schema("conv_id long, turn long, text string").parquet(src)
    a = analysed(stream, labels=["EMAIL"], grouped=False)
    got = {(r.conv_id, r.turn): r.anonymized_text for r in _drain(a.select("conv_id", "turn", "anonymized_text"), "t1")}
    assert got[1, 1] == "again [EMAIL_1] and [EMAIL_2]" and got[2, 0] == "none"
    ents = a.selectExpr("conv_id", "inline(entities)").select("conv_id", "label", "value")
    assert sorted((r.value.lower(), r.ph) for r in _drain(lasting_dictionary(ents), "t2")) == [("a@b.it", "[EMAIL_1]"), ("c@d.it", "[EMAIL_2]")]


def test_windowed_counts(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 3,0) AS ts, 'k' AS kind FROM range(10)").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(src)
    assert sorted(r.n for r in _drain(windowed_counts(stream, "ts", "kind", "10 minutes"), "t3", "complete")) == [3, 3, 4]


def test_a_file_of_mixed_dialects(spark, tmp_path):
    import json

    good = [
        {"tokens": ["VAT", "1"], "bio_labels": ["O", "B-PIVA"], "source_text": "VAT 1", "template_id": 7}, {"mbert_tokens": ["a"], "mbert_token_classes": ["O"]}, {"source_text": "In Roma.", "entities": [{"value": "Roma", "label": "CITY", "start": 3, "end": 7}], "language": "fr"},
        {"tokens": ["x"], "bio_labels": ["O"], "source_text": "x", "entities": [], "mbert_tokens": None}]
    bad = ["{", '{"tokens": 5, "bio_labels": ["O"]}', '{"tokens": ["a"]}', '"text"', '{"mbert_tokens": [], "mbert_token_classes": []}']
    path = tmp_path / "m.jsonl"
    path.write_text("\n".join([*map(json.dumps, good), "", *bad]))
    rows, rejects = records.read_mixed(spark, str(path))
    got = sorted((r.dialect, r.tokens, r.labels, r.language, r.template_id) for r in rows.collect())
    assert got == [("native", ["VAT", "1"], ["O", "B-PIVA"], "it", "7"), ("native", ["x"], ["O"], "it", None), ("spans", ["In", "Roma", "."], ["O", "B-CITY", "O"], "fr", None), ("token", ["a"], ["O"], "?", None)]
    assert sorted((r.line, r._reject_reason) for r in rejects.collect()) == sorted(zip(bad, ["not JSON", "missing arrays", "no known dialect", "no known dialect", "no tokens"], strict=True))
    with pytest.raises(Exception, match="rejected row"):
        records.read_mixed(spark, str(path), strict=True)[0].collect()
    path.write_text("\n".join(map(json.dumps, good)))
    assert records.read_mixed(spark, str(path), strict=True)[0].count() == 4


def _runs(spark, stream, path, table):
    """What a stream adds to a table in one run over all there is; a later call goes on from the checkpoint."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/{table}-state").option("path", f"{path}/{table}").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.read.parquet(f"{path}/{table}")


def test_state_lasts_over_restarts_and_agrees_with_the_batch(spark, tmp_path):
    values = {"a": [5, 1, 1, 1, 7, 1, 2, None, 0, 0], "b": [1, 9, 1, 9, 1, 1, 1, 1, 1, 1]}
    rows = [(k, i, float(v) if v is not None else None) for k, vs in values.items() for i, v in enumerate(vs)]
    d = spark.createDataFrame(rows, "k string, id long, v double").selectExpr("k", "id", "timestamp_seconds(id) AS ts", "v")
    src = str(tmp_path / "src")
    (tmp_path / "src").mkdir()
    stream = spark.readStream.schema(d.schema).parquet(src)
    for part in ("id < 3", "id BETWEEN 3 AND 5", "id > 5"):  # a run of low samples goes over the cuts
        d.where(part).coalesce(1).write.mode("append").parquet(src)
        got = _runs(spark, low_runs(stream, "k", "ts", "v", "id", 3.0), str(tmp_path), "low")
    want = [("a", 2), ("a", 6), ("a", 9), ("b", 5)]
    assert sorted((r.key, r.id) for r in got.collect()) == want == sorted((r.key, r.id) for r in low_runs(d.repartition(5), "k", "ts", "v", "id", 3.0).collect())


def test_numbers_of_a_dictionary_go_on_after_a_restart(spark, tmp_path):
    src = str(tmp_path / "src")
    (tmp_path / "src").mkdir()
    stream = spark.readStream.schema("conv_id long, label string, value string").parquet(src)
    for part in ([(1, "EMAIL", "a@b.it"), (1, "CITY", "Roma"), (2, "EMAIL", "a@b.it")], [(1, "EMAIL", "A@B.it"), (1, "EMAIL", "c@d.it"), (1, None, "x")], [(1, "CITY", "roma "), (1, "CITY", "Bari"), (2, "CITY", "Bari")]):
        spark.createDataFrame(part, "conv_id long, label string, value string").coalesce(1).write.mode("append").parquet(src)
        got = _runs(spark, lasting_dictionary(stream), str(tmp_path), "names")
    assert sorted((r.conv_id, r.value, r.ph) for r in got.collect()) == [(1, "Bari", "[CITY_2]"), (1, "Roma", "[CITY_1]"), (1, "a@b.it", "[EMAIL_1]"), (1, "c@d.it", "[EMAIL_2]"), (2, "Bari", "[CITY_1]"), (2, "a@b.it", "[EMAIL_1]")]
