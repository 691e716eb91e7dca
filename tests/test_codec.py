import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import codec

NUMBERS = [0, 1, 127, 128, 129, 16383, 16384, 2**34, 2**62, *range(0, 5000, 7)]


def one(spark, values, make):
    return spark.createDataFrame([(values,)], "v array<bigint>").select(make(F.col("v"))).first()[0]


def test_known_bytes(spark):
    assert one(spark, [824, 5, 214577], codec.encode) == [6, 184, 133, 13, 12, 177]
    assert one(spark, [], codec.encode) == []


def test_round_trip(spark):
    assert one(spark, NUMBERS, lambda v: codec.decode(codec.encode(v))) == NUMBERS
    assert one(spark, [], lambda v: codec.decode(codec.encode(v))) == []


def test_an_incomplete_number_is_dropped(spark):
    assert one(spark, [133, 6], lambda v: codec.decode(v.cast("array<int>"))) == [5]


def test_negative_numbers_are_refused(spark):
    with pytest.raises(Exception, match="negative"):
        one(spark, [1, -2, 3], codec.encode)


def test_widths(spark):
    assert one(spark, [0, 127, 128, 16383, 16384, 2**21, 2**28, 2**62], lambda v: F.transform(v, codec.byte_width)) == [1, 1, 2, 2, 3, 4, 5, 9]


@settings(deadline=None, max_examples=10)
@given(rows=st.dictionaries(st.tuples(st.sampled_from("ab"), st.integers(0, 2000)), st.integers(1, 300), min_size=1, max_size=40), block=st.sampled_from([1, 7, 1 << 16]))
def test_posting_lists_survive_both_codings(spark, rows, block):
    postings = spark.createDataFrame([(t, o, tf) for (t, o), tf in rows.items()], "term string, ord bigint, tf bigint")
    want = sorted((t, o, tf) for (t, o), tf in rows.items())
    for encode, decode in ((codec.encode_streams, codec.decode_streams), (codec.encode_interleaved, codec.decode_interleaved)):
        assert sorted(map(tuple, decode(encode(postings, block)).collect())) == want


def test_blocks_join_to_the_stream_of_the_list(spark):
    postings = spark.createDataFrame([("t", o, tf) for o, tf in ((3, 1), (9, 2), (10, 1), (500, 40), (100000, 3))], "term string, ord bigint, tf bigint")
    whole = codec.encode_streams(postings, 1 << 40).first()
    parts = codec.encode_streams(postings, 64).orderBy("block").collect()
    assert [x for p in parts for x in p.gap_stream] == whole.gap_stream
    assert [x for p in parts for x in p.tf_stream] == whole.tf_stream


def test_dense_lists_take_little_more_than_a_byte(spark):
    postings = spark.range(20000).select(F.lit("t").alias("term"), F.col("id").alias("ord"), F.lit(1).cast("bigint").alias("tf"))
    row = codec.encode_streams(postings).select(F.size("gap_stream"), F.size("tf_stream")).first()
    assert row[0] + row[1] < 2.1 * 20000


def test_streams_that_do_not_fit_are_refused(spark):
    for more in ([], [129, 130]):
        bad = spark.createDataFrame([("t", 0, [131], more)], "term string, block bigint, gap_stream array<int>, tf_stream array<int>")
        with pytest.raises(Exception, match="another length"):
            codec.decode_streams(bad).collect()
