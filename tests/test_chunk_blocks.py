from pyspark.sql import functions as F

from msgspark.functions.chunks import TEXT_BLOCK, _blocks, _slice


def test_slices_of_short_blocks(spark):
    text = "".join(chr(97 + i % 26) + ("é" if i % 7 == 0 else "") for i in range(3000))
    assert TEXT_BLOCK < 600  # little of a block lies before the slice
    spans = [(0, 10), (250, 262), (255, 256), (256, 900), (1000, 1602), (len(text) - 5, len(text) + 40)]
    row = spark.createDataFrame([(text,)], "t string").select(
        *(_slice(_blocks(F.col("t")), F.lit(a), F.lit(b)).alias(f"c{a}") for a, b in spans)
    ).first()
    assert list(row) == [text[a:b] for a, b in spans]
