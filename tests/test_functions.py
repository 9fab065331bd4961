from pyspark.sql import functions as F

from discloom.functions import binary as B
from discloom.functions import timecode as T


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(bytearray(v) if isinstance(v, bytes) else v).alias(k) for k, v in values.items()))
    got = df.select(column.alias("x")).first()["x"]
    return bytes(got) if isinstance(got, bytearray) else got


def test_bits_are_reversed_both_ways(spark):
    data, back = bytes([0x00, 0xFF, 0x80, 0x01, 0xB2, 0xCA]), bytes([0x00, 0xFF, 0x01, 0x80, 0x4D, 0x53])
    assert one(spark, B.reverse_bits(F.col("d")), d=data) == back
    assert one(spark, B.reverse_bits_vectorised(F.col("d")), d=data) == back
    every = bytes(range(256))
    expected = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
    assert one(spark, B.reverse_bits(F.col("d")), d=every) == expected == bytes(B.REVERSED_BYTES)


def test_integers(spark):
    for n, safe in ((0, b"\0\0\0\0"), (127, b"\0\0\0\x7f"), (128, b"\0\0\1\0"), (323, b"\0\0\2\x43")):
        assert one(spark, B.sync_safe(F.col("n")), n=n) == safe
    assert one(spark, B.be_uint(F.col("d"), 1, 4), d=b"\0\xff\xff\xff\xfe") == 0xFFFFFFFE
    assert one(spark, B.be_uint(F.col("d"), 3, 4), d=b"\0\xff\xff\xff\xfe") is None
    assert one(spark, B.be_bytes(F.col("n"), 2), n=0x12345) == b"\x23\x45"
    assert one(spark, B.le_bytes(F.col("n"), 8), n=0x0102) == b"\x02\x01" + bytes(6)


def test_texts(spark):
    assert one(spark, B.lossy_field(F.col("d")), d=b" AB\0\0") == "AB"
    assert one(spark, B.latin_field(F.col("d")), d=b"A\xe9\0B") == "Aé"
    assert one(spark, B.strict_text(F.col("d"), F.lit(2)), d=b"xx ab \0y") == " ab "
    assert one(spark, B.strict_text(F.col("d"), F.lit(2)), d=b"xx\xff\0") is None
    assert one(spark, B.strict_text(F.col("d"), F.lit(0)), d=b"ab\0") is None
    assert one(spark, B.lossy_text(F.col("d")), d=b"a\xffb\0c") == "a�b"
    assert one(spark, B.latin_bytes(F.col("t")), t="a中é") == b"a?\xe9"
    assert one(spark, B.sanitized(F.col("t")), t=' a/b:"c"\x01\x85 ') == "a_b__c___"


def test_channels_and_padding(spark):
    assert [bytes(x) for x in one(spark, B.channels(F.col("d"), 3), d=bytes(range(8)))] == [b"\0\3\6", b"\1\4\7", b"\2\5"]
    assert one(spark, B.nul_padded(F.col("d"), 4), d=b"ab") == b"ab\0\0"


def test_timecodes_and_dimensions(spark):
    assert one(spark, T.frame_count(F.col("m"), F.col("s"), F.col("f")), m=1, s=2, f=3) == 4653
    c = one(spark, T.clock(F.col("n")), n=300 * 4500 + 76)
    assert (c["m"], c["s"], c["f"]) == (300, 1, 1)
    assert one(spark, T.in_range(F.col("n").cast("int"), F.lit(1), F.lit(2)), n=None) is True
    assert one(spark, T.in_range(F.col("n"), F.lit(1), F.lit(2)), n=2) is False
    assert one(spark, T.genre_name(F.lit(1), F.col("n")), n=24) == "Rhythm & Blues"
    assert one(spark, T.genre_name(F.lit(2), F.col("n")), n=24) is None
    assert one(spark, T.genre_name(F.lit(1), F.col("n")), n=29) is None
    assert one(spark, T.frame_format_name(F.col("n")), n=9) == "Unknown (9)"
    assert one(spark, T.sectors_of_three_frames(F.col("n")), n=1) is None
    assert [one(spark, T.channel_hint(F.col("n")), n=n) for n in range(4)] == [2, 5, 6, 2]
    assert one(spark, T.character_set(F.col("n")), n=0x0B) == "SHIFT_JISX0213"
