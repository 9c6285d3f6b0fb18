import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshot.functions import arrays as A
from earshot.functions import audiogram as G
from earshot.functions import keys as K
from earshot.functions import text as X


def one(spark, expression, **columns):
    row = spark.range(1).select(*[(F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<double>")).alias(k) for k, v in columns.items()])
    return row.select(expression.alias("v")).first().v


def test_levels(spark):
    x = F.col("x")
    assert one(spark, A.rms(x), x=[3.0, 4.0]) == pytest.approx(np.sqrt(12.5))
    assert one(spark, A.rms(x), x=[]) == 0
    assert one(spark, A.level_db(x), x=[0.0]) is None
    assert one(spark, A.clip_count(x), x=[1.5, -2.0, 1.0]) == 2
    assert one(spark, A.to_pcm16(x), x=[2.0, -2.0, 0.5, -0.00002]) == [32767, -32768, 16384, 0]
    assert one(spark, A.standardised(x), x=[2.0, 2.0]) == [0, 0]
    assert one(spark, A.first_argmax(x), x=[1.0, 5.0, 5.0]) == 1


def test_sums_and_pads(spark):
    x, y = F.col("x"), F.col("y")
    assert one(spark, A.added(x, y), x=[1.0], y=[1.0, 2.0]) == [2, 2]
    assert one(spark, A.added_to_shorter(x, y), x=[1.0], y=[1.0, 2.0]) == [2]
    assert one(spark, A.mixed(F.array(x, y)), x=[1.0], y=[1.0, 2.0]) == [2, 2]
    assert one(spark, A.padded(x, 3), x=[1.0]) == [1, 0, 0]
    assert one(spark, A.padded_front(x, F.lit(3)), x=[1.0]) == [0, 0, 1]
    with pytest.raises(Exception, match="longer"):
        one(spark, A.padded(x, 1), x=[1.0, 2.0])


def test_mix_reaches_the_ratio(spark):
    rng = np.random.default_rng(0)
    t, n = rng.normal(size=50), rng.normal(size=50) * 7
    out = np.array(one(spark, A.mixed_at_snr(F.col("x"), F.col("y"), F.lit(3.0)), x=t.tolist(), y=n.tolist()))
    noise = out - t
    assert 10 * np.log10((t**2).sum() / (noise**2).sum()) == pytest.approx(3)


def test_frames(spark):
    x = F.col("x")
    assert one(spark, A.frames(x, 2, 1), x=[1.0, 2.0, 3.0]) == [[1, 2]]
    assert one(spark, A.frames(x, 2, 1, last=True), x=[1.0, 2.0, 3.0]) == [[1, 2], [2, 3]]
    assert one(spark, A.frames(x, 4, 1, last=True), x=[1.0, 2.0, 3.0]) == []


@settings(max_examples=15, deadline=None)
@given(st.floats(-1, 6))
def test_interpolation(spark, at):
    xs, ys = [0.0, 1.0, 2.5, 4.0], [1.0, -1.0, 3.0, 2.0]
    got = one(spark, A.interpolated(F.col("x"), F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys))), x=at)
    assert got == pytest.approx(np.interp(at, xs, ys))


def gram(levels, frequencies=(2000, 3000)):
    return G.audiogram(F.array(*[F.lit(v).cast("double") for v in levels]), frequencies)


@pytest.mark.parametrize("level, label", [(10, "NOTHING"), (20, "MILD"), (40, "MODERATE"), (80, "SEVERE")])
def test_severity(spark, level, label):
    assert one(spark, G.severity(gram([level, level])), x=1) == label


def test_severity_without_levels(spark):
    assert one(spark, G.severity(gram([90, 90], (250, 500))), x=1) == "NOTHING"
    assert one(spark, G.severity(gram([None, 80])), x=1) == "SEVERE"


def test_audiogram_checks(spark):
    for bad in (gram([1]), gram([1, 2], (500, 500)), gram([1, 2], (500, 250))):
        with pytest.raises(Exception, match="frequencies"):
            one(spark, bad["levels"], x=1)


def test_nalr(spark):
    levels = F.array(*[F.lit(float(v)) for v in (45, 45, 35, 45, 60, 65)])
    gains = one(spark, G.nalr_gains(levels), x=1)
    base = 0.05 * (45 + 35 + 45)
    assert gains == pytest.approx([max(0, base + 0.31 * h + b) for h, b in zip((45, 45, 35, 45, 60, 65), G.NALR_BIAS, strict=True)])
    assert one(spark, G.nalr_gains(F.array(*[F.lit(0.0)] * 6)), x=1) == [0] * 6


def test_keys(spark):
    assert one(spark, K.md5_seed(F.col("x")), x="S06001") == int(hashlib.md5(b"S06001").hexdigest(), 16) % 10**8 == 50854399
    assert tuple(one(spark, K.signal_parts(F.col("x")), x="S1_L2_E3_b")) == ("S1", "L2", "E3_b")
    assert one(spark, K.numbered("S", F.lit(7)), x=1) == "S00007"
    assert [one(spark, K.split_of(F.lit(n)), x=1) for n in (0, 1, 49999, 50000, 50001, 59999)] == ["test", "train", "test", "test", "valid", "test"]
    with pytest.raises(Exception, match="cannot parse"):
        one(spark, K.strict_parts(F.col("x"), 4), x="a_b_c")


def edit_table(r, h):
    """(cost, -hits) by the plain dynamic program."""
    d = [[(i + j, 0) if not i or not j else None for j in range(len(h) + 1)] for i in range(len(r) + 1)]
    for i in range(1, len(r) + 1):
        for j in range(1, len(h) + 1):
            c, k = d[i - 1][j - 1]
            match = r[i - 1] == h[j - 1]
            d[i][j] = min((c + (not match), k - match), (d[i - 1][j][0] + 1, d[i - 1][j][1]), (d[i][j - 1][0] + 1, d[i][j - 1][1]))
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_alignment(r, h):
    hits, subs, dels, ins = X.align(r, h)
    assert (subs + dels + ins, -hits) == edit_table(r, h)
    assert hits + subs + dels == len(r) and hits + subs + ins == len(h) and min(subs, dels, ins) >= 0


@pytest.mark.parametrize("number, words", [("0", "zero"), ("21", "twenty one"), ("105", "one hundred five"), ("1000", "one thousand"), ("2001", "two thousand one"), ("3.14", "three point one four"), ("1200000", "one million, two hundred thousand")])
def test_numbers(number, words):
    assert X.spoken(number) == words


def test_normal_form(spark):
    text = X.normalised(F.col("x"), contractions={"don't": "do not", "i'm": "i am"})
    assert one(spark, text, x="I don't <unk> like,  21 things!") == "I DO NOT LIKE THINGS"
    assert one(spark, text, x="105 well-known (things) \u2019em [noise] caf\u00e9") == "WELL - KNOWN THINGS EM CAF"


def test_contractions_of_a_file(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("Gonna,Going To\nuh\ngonna,other\n")
    table = X.read_contractions(spark, str(path))
    assert table == {"gonna": "going to", "uh": ""}
    assert one(spark, X.normalised(F.col("x"), contractions=table), x="uh I'm gonna go") == "I'M GOING TO GO"


def test_si_snr_of_equal_signals(spark):
    import numpy as np

    x = np.sin(np.arange(50.0))
    z = x - x.mean()
    t = (z * z).sum() * z / ((z**2).sum() + 1e-8)
    wanted = 20 * np.log10(1e-8 + np.linalg.norm(t) / (np.linalg.norm(z - t) + 1e-8))
    assert one(spark, A.si_snr(F.col("x"), F.col("x")), x=x.tolist()) == pytest.approx(wanted, abs=0.01)
