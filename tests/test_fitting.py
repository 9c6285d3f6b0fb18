import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import fitting
from earshot.functions.audiogram import audiogram, band_overlap
from earshot.kernels import ears, haspi

FREQUENCIES, LEVELS = (250, 500, 1000, 2000, 4000, 8000), (30.0, 40.0, 50.0, 60.0, 70.0, 80.0)


def fitted(spark, losses=LEVELS, **how):
    gram = audiogram(F.array(*[F.lit(float(v)) for v in losses]), FREQUENCIES)
    gains = fitting.compressive_gains(gram, LEVELS, bands=FREQUENCIES, edges=(250, 8000), **how)
    gated = fitting.gated_gains(gains, LEVELS, gate=45.0, slope=1.0, bands=6)
    row = spark.range(1).select(gains.alias("gains"), gated.alias("gated")).first()
    return np.array(row.gains), np.array(row.gated)


def test_threshold_published_sums():
    assert fitting.threshold_db([30, 40, 50, 60, 70, 80]).sum() == pytest.approx(237.52941176470588)
    assert fitting.threshold_db([35, 55, 50, 60, 70, 80]).sum() == pytest.approx(235.02941176470588)


@pytest.mark.parametrize("how, wanted", [({}, 2140.1762291737905), ({"rated_at": 30.0}, 2140.1762291737905), ({"most": 120.0}, 2383.502544963264)])
def test_compressive_published_sums(spark, how, wanted):
    # published sums are of two equal ears
    assert 2 * fitted(spark, **how)[0].sum() == pytest.approx(wanted)


def test_gate(spark):
    gains, gated = fitted(spark)
    assert gated.shape == gains.shape == (6, 6)
    assert (gated[:, 2:] == gains[:, 2:]).all()
    door = (gains[:, 1] + gains[:, 2]) / 2
    assert gated[:, :2] == pytest.approx(np.stack([door - 15, door - 5], axis=1))


def test_no_loss_no_audiogram_and_unknown_level(spark):
    assert not fitted(spark, losses=(0,) * 6)[0].any()
    missing = F.when(F.lit(False), audiogram(F.array(*[F.lit(v) for v in LEVELS]), FREQUENCIES))
    assert spark.range(1).select(fitting.compressive_gains(missing, LEVELS, bands=FREQUENCIES, edges=(250, 8000)).alias("v")).first().v is None
    with pytest.raises(ValueError, match="more edges"):
        fitting.compressive_gains(missing, LEVELS, bands=FREQUENCIES)
    with pytest.raises(ValueError, match="none of the input levels"):
        fitted(spark, rated_at=33.0)


def test_overlap(spark):
    row = spark.range(1).select(band_overlap(*[F.lit(float(v)) for v in (10, 20, 19, 29)]).alias("v")).first()
    assert row.v == pytest.approx(0.1)


def test_better_ear(spark):
    rng = np.random.default_rng(1)
    clean = rng.uniform(-1, 1, 3000).tolist()
    noisy = (np.array(clean) + rng.uniform(-1, 1, 3000)).tolist()
    gram = audiogram(F.array(*[F.lit(20.0)] * 8))
    frame = spark.createDataFrame([(1, clean, noisy, clean, clean), (2, clean, noisy, clean, None), (3, None, noisy, clean, None)], "seed long, reference_left array<double>, processed_left array<double>, reference_right array<double>, processed_right array<double>")
    frame = frame.withColumns({"levels_left": ears.hearing_levels(gram), "levels_right": ears.hearing_levels(gram)})
    both, one, none = ears.better_ear(frame, "hasqi", rate=16_000, seed_col="seed").orderBy("seed").collect()
    assert both.hasqi == both.hasqi_right > both.hasqi_left
    assert one.hasqi == one.hasqi_left and one.hasqi_right is None and none.hasqi is None
    with pytest.raises(ValueError, match="weights"):
        ears.better_ear(frame, "haspi", rate=16_000, seed_col="seed")
    networks = haspi.Networks(np.ones((2, 11, 4)), np.ones((2, 5)))
    found = ears.better_ear(frame, "haspi", rate=16_000, seed_col="seed", networks=networks).orderBy("seed").collect()
    assert found[0].haspi == max(found[0].haspi_left, found[0].haspi_right) and found[2].haspi is None
