"""Date texts dispatched by shape give what trying every layout in order gives."""

import datetime as dt
import random

from pyspark.sql import functions as F

from logweave.functions import timefn as tf

#: One strftime form, or several, that each layout can fit, clock and fraction included.
FORMS = ["%Y/%m/%d", "%Y.%m.%d %H:%M", "%m/%d/%Y %H:%M:%S", "%d/%m/%Y", "%m-%d-%Y %H:%M:%S.%f", "%d-%m-%Y", "%d-%b-%Y %H:%M",
         "%d %b %Y", "%d %B %Y %H:%M:%S", "%b %d, %Y", "%b %d %Y %H:%M", "%B %d, %Y %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S,%f",
         "%d/%b/%Y:%H:%M:%S +0200", "%d/%b/%Y:%H:%M:%S -0730", "%d %b %Y %H:%M:%S +0000", "%b %d %H:%M:%S %Y",
         "%Y-%m-%d %I:%M %p", "%Y/%m/%d %I:%M:%S %p", "%m/%d/%Y %I:%M %p", "%d/%m/%Y %I:%M:%S %p", "%Y%m%d", "%Y%m%dT%H%M%S",
         "%Y%m%d%H%M%S", "%Y-%m-%dT%H:%M:%S", "%a, %d %b %Y %H:%M:%S +0100"]
ODD = ["", "2024", "port 2024", "192.168.2001.7", "1999/13/45", "30/02/2020", "v2.0.2021", "a-b-2020", "20241301", "2024010", "202401011",
       "1 Foo 2020", "May 2020", "1/1/2020 25:00", "1/1/2020 10:00 xm", "2020-1-1 1:2:3,4", "1.2.3.2020", "2020/1/1 1:2:3.1234567",
       "Mai 3 2020", "２０２０/1/1", "2020 / 1 / 1", " 3/4/2020\t10:00 ", "0003/4/2020", "2020/1/1/1", "JAN 3, 2020", "3 jan 2020"]


def every_layout(c):
    text = F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), tf.WEEKDAY, "")
    tried = F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in tf.TEXT_TIME_LAYOUTS])
    return F.coalesce(F.when(c.rlike(tf.ISO_TEXT), c.try_cast("timestamp")),
                      F.when(c.rlike(tf.DATED_TEXT) & (F.length(text) <= 64), tried))


def test_shapes_lose_no_layout(spark):
    chance = random.Random(7)
    texts = list(ODD)
    for _ in range(1200):
        at = dt.datetime(1700, 1, 1) + dt.timedelta(seconds=chance.randrange(17_000_000_000), microseconds=chance.randrange(10**6))
        text = at.strftime(chance.choice(FORMS))
        if chance.random() < 0.4:  # fields without their leading zero
            text = "".join(c for i, c in enumerate(text) if not (c == "0" and (i == 0 or text[i - 1] in "/ -.") and text[i + 1:i + 2].isdigit()))
        if chance.random() < 0.2:  # a damaged text
            k = chance.randrange(len(text))
            text = text[:k] + chance.choice("0 9/-:,.aT") + text[k + chance.randrange(2):]
        texts.append(text)
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    pairs = df.select("t", tf.to_timestamp_any(F.col("t")).cast("string").alias("got"), every_layout(F.col("t")).cast("string").alias("want")).collect()
    assert [r for r in pairs if r.got != r.want] == []
    assert sum(r.got is not None for r in pairs) > 800


def test_each_form_has_one_or_two_layouts_to_try(spark):
    at = dt.datetime(2024, 4, 3, 9, 15, 2, 120000)
    df = spark.createDataFrame([(at.strftime(f),) for f in FORMS] + [("host-2024.example",), ("10.2.2024.1",)], "t string")
    shape = tf.text_shape(F.col("t"))
    tries = sum(F.when(shape.isin(list(shapes)), len(layouts)).otherwise(0) for shapes, layouts in tf.LAYOUT_FAMILIES.items())
    got = [r.n for r in df.select(tries.alias("n")).collect()]
    assert max(got) <= 3 and got[-2:] == [0, 0]


def test_families_share_no_shape():
    shapes = [shape for family in tf.LAYOUT_FAMILIES for shape in family]
    assert len(shapes) == len(set(shapes))
    assert sorted(sum(tf.LAYOUT_FAMILIES.values(), [])) == sorted(tf.TEXT_TIME_LAYOUTS)
