from earshot.functions import registry


def test_functions_in_sql(spark):
    registry.register(spark)
    row = spark.sql(
        "SELECT align_words(array('a', 'b'), array('a', 'c', 'b')) AS w, numbers_spoken('7 cats') AS n, "
        "signal_delay(array(1D, 2D, 0D, 0D), array(0D, 1D, 2D, 0D)) AS d, loudness(array(0D), 8000) AS l, stoi(array(1D), array(1D), 10000) AS s, signal_delay(null, array(1D)) AS none"
    ).first()
    assert tuple(row.w) == (2, 0, 0, 1) and row.n == "seven cats" and row.d == 1 and row.l == -80 and row.s is None and row.none is None
