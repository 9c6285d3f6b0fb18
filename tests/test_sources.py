import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.kernels import dynamics, filters, prescription
from earshot.sources import audio, schemas, tables


def test_listeners_and_pairs(spark, tmp_path):
    ears = {"L1": {"name": "L1", "audiogram_cfs": [250, 500], "audiogram_levels_l": [10, 20], "audiogram_levels_r": [30, None]}}
    (tmp_path / "l.json").write_text(json.dumps(ears))
    row = tables.read_listeners(spark, str(tmp_path / "l.json")).first()
    assert row.listener == "L1" and row.left.levels == [10, 20] and row.right.levels == [30, None]
    (tmp_path / "p.json").write_text(json.dumps({"S1": ["L1", "L2"], "S2": []}))
    assert tables.read_pairs(spark, str(tmp_path / "p.json")).count() == 2


def test_jsonl_appends(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a")], "id int, name string")
    tables.write_jsonl(rows, path)
    tables.write_jsonl(rows, path)
    assert tables.read_jsonl(spark, path, "id int, name string").count() == 2


def test_results(spark, tmp_path):
    path = str(tmp_path / "scores")
    rows = spark.createDataFrame([(0.5, "L1", "S1")], "score double, listener string, scene string")
    with pytest.raises(KeyError):
        tables.write_results(rows, path, ["scene", "haspi"])
    work = spark.createDataFrame([("S1", "L1"), ("S1", "L2")], "scene string, listener string")
    assert tables.unfinished(work, spark, path, ["scene", "listener"], schemas.SCORE).count() == 2
    tables.write_results(rows, path, ["scene", "listener", "score"])
    assert tables.read_scores(spark, path).first().key == "S1_L1"
    assert [r.listener for r in tables.unfinished(work, spark, path, ["scene", "listener"], schemas.SCORE).collect()] == ["L2"]
    with pytest.raises(Exception, match="exist"):
        tables.write_results(rows, path, ["scene", "listener", "score"])


def test_rooms(spark, tmp_path):
    (tmp_path / "R00001_t.rpf").write_text("ProjectName=R00001_t;\nsourcePositions=(1.5,-2,3);\nreceiverPositions=[0,0,1]\n")
    row = tables.read_rooms(spark, str(tmp_path)).first()
    assert row.room == "R00001" and row.sourcePositions == [1.5, -2, 3] and row.receiverPositions == [0, 0, 1] and row.sourceViewVectors is None


@pytest.mark.parametrize("floating", [True, False])
def test_wav_round_trip(spark, tmp_path, floating):
    x = np.round(np.sin(np.arange(40)) * 16384) / 32768
    (tmp_path / "a.wav").write_bytes(audio.encode_wav(16000, np.stack([x, -x], axis=1), floating=floating))
    row = audio.read_wavs(spark, str(tmp_path), offset=5, n_samples=10).first()
    assert row.sample_rate == 16000 and np.allclose(row.left, x[5:15]) and np.allclose(row.right, -x[5:15])
    again = audio.encoded(audio.read_wavs(spark, str(tmp_path)), floating=floating).first()
    assert bytes(again.content) == (tmp_path / "a.wav").read_bytes()


def test_wav_strict():
    with pytest.raises(ValueError):
        audio.encode_wav(8000, np.array([1.5]), floating=False, strict=True)


def test_butterworth():
    b, a = filters.butter(2, 0.5)
    assert b == pytest.approx([0.29289322, 0.58578644, 0.29289322]) and a == pytest.approx([1, 0, 0.17157288], abs=1e-7)
    b, a = filters.butter(1, 0.5, "high")
    assert b == pytest.approx([0.5, -0.5]) and a == pytest.approx([1, 0], abs=1e-9)


def test_filter_state_carries_on():
    x = np.random.default_rng(0).normal(size=50)
    b, a = filters.butter(3, 0.2)
    whole, _ = filters.lfilter(b, a, x)
    one, z = filters.lfilter(b, a, x[:20])
    two, _ = filters.lfilter(b, a, x[20:], z)
    assert np.allclose(np.concatenate([one, two]), whole)


def test_compressor():
    unit = dynamics.Compressor(1000, threshold=0.5, attenuation=0.1, attack=5, release=20)
    quiet, gain, _ = unit.run(np.full(200, 0.1))
    assert np.allclose(quiet, 0.1) and gain == pytest.approx(1)
    x = np.full(900, 2.0)
    loud, gain, _ = unit.run(x)
    assert gain == pytest.approx(2 * 0.1 + 0.9 * 0.5, abs=1e-3) and abs(loud[-1]) < 2
    one, g, tail = unit.run(x[:123])
    two, _, _ = unit.run(x[123:], g, tail)
    assert np.allclose(np.concatenate([one, two]), loud)


def test_compressor_meets_published_levels():
    unit = dynamics.Compressor(44100)
    x = np.arange(1.0, 11.0)
    assert unit.levels(x, np.zeros(unit.window)).sum() == pytest.approx(0.9799197751960967, abs=1e-7)
    # sample by sample, above and below a threshold
    unit = dynamics.Compressor(44100, threshold=0.1, attenuation=0.2)
    gain, wanted = 1.0, []
    for rms, v in zip(unit.levels(x, np.zeros(unit.window)), x, strict=True):
        a, r = 1 / (0.005 * 44100), 1 / (0.020 * 44100)
        gain = gain * (1 - a) + (rms * 0.2 + 0.8 * 0.1) * a if rms > 0.1 else r + gain * (1 - r)
        wanted.append(gain * v)
    assert np.allclose(unit.run(x)[0], wanted)


def test_crossover_is_all_pass():
    x = np.zeros(4096)
    x[0] = 1
    bands = dynamics.crossover(x, [500, 2000], 16000)
    assert len(bands) == 3 and np.abs(np.fft.rfft(bands.sum(axis=0))) == pytest.approx(1, abs=1e-3)


def test_nalr_filter():
    assert prescription.nalr_filter(None, 16000).tolist() == [0] * 110 + [1] + [0] * 110
    h = prescription.nalr_filter(np.full(6, 20.0), 16000)
    assert abs(np.fft.rfft(h, 4096)[1000:1500]).mean() == pytest.approx(10, rel=0.02)


def test_stream_of_levels(spark, tmp_path):
    from earshot.streaming import levels

    path = str(tmp_path / "events")
    spark.createDataFrame([(1, f"2024-01-01 00:0{i}:00", i % 2, "a", float(i)) for i in range(8)], "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp")).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    query = levels.windowed_levels(stream).writeStream.format("memory").queryName("levels").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n for r in spark.table("levels").collect()) == [3, 5]


def test_stream_of_chunks_equals_the_whole(spark, tmp_path):
    from earshot.streaming import levels

    x = np.sin(np.arange(300) / 3) * 2
    path = str(tmp_path / "chunks")
    spark.createDataFrame([("s", i, x[i * 100 : (i + 1) * 100].tolist()) for i in range(3)], "signal_id string, chunk long, x array<double>").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    query = levels.compressed_chunks(stream, rate=1000, threshold=0.5).writeStream.format("memory").queryName("chunks").outputMode("append").start()
    for _ in range(300):  # timers keep such a stream at work, so it never says that all is done
        if spark.table("chunks").count() == 3:
            break
        time.sleep(0.2)
    query.stop()
    got = np.concatenate([r.x for r in spark.table("chunks").orderBy("chunk").collect()])
    assert np.allclose(got, dynamics.Compressor(1000, threshold=0.5).run(x)[0])
