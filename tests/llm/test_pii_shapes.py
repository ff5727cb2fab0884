"""Pseudonyms: texts made of repeats end, more formats of dates, capitals, and the inverse permutation in plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from turnloom.llm import pii

SHAPES = ["a@b" + ".c" * 100_000, "a@" + "b-" * 5_000 + "c.d", "1 " * 3_000, "4111 1111 1111 1111 " * 500, "1.1." * 5_000, "DE89 " * 3_000]


@pytest.mark.parametrize("shape", SHAPES, ids=[s[:8] for s in SHAPES])
def test_texts_of_repeats_end(spark, shape):
    out = pii.pseudonymised(spark.createDataFrame([(1, shape)], "doc_id long, text string"), "k").first()
    assert len(out.text) == len(shape)


def replaced(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymised(df, "key").orderBy("doc_id").collect()]


def test_more_formats(spark):
    iso, slashed, dashed, again, version, mail, lower = replaced(spark, "on 2020-03-12 x", "on 2020/03/12 x", "on 12-03-2020 x", "12.03.2020", "v1.2.3.4", "Jo.Doe7@x.org", "jo.doe7@x.org")
    day = iso[3:13]
    assert day != "2020-03-12" and slashed == f"on {day.replace('-', '/')} x"
    y, m, d = day.split("-")
    assert dashed == f"on {d}-{m}-{y} x" and again == f"{d}.{m}.{y}"
    assert version == "v1.2.3.4"
    assert mail.endswith("@x.org") and mail.lower() == lower and mail != lower and mail != "Jo.Doe7@x.org"


def test_permutation_is_inverted_by_its_rounds_backwards(spark):
    a, b = 250, 292
    df = spark.range(0, a * b, 7).select((F.col("id") / b).cast("long").alias("l"), (F.col("id") % b).alias("r"))
    mixed = df.select("l", "r", pii._feistel(F.col("l"), F.col("r"), F.lit(a).cast("bigint"), F.lit(b).cast("bigint"), F.lit("t"), "key").alias("m")).collect()

    def noise(i, half, most):
        return int(hashlib.sha256(f"key|{i}|t|{half}".encode()).hexdigest()[:15], 16) % most

    for row in mixed:
        left, right = row.m.l, row.m.r
        for i in reversed(range(pii.ROUNDS)):
            if i % 2 == 0:
                left = (left - noise(i, right, a)) % a
            else:
                right = (right - noise(i, left, b)) % b
        assert (left, right) == (row.l, row.r)
    assert len({(r.m.l, r.m.r) for r in mixed}) == len(mixed)
