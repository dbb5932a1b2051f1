import math
import random

from pyspark.sql import functions as F

from canlake.functions import codec


def bits_of(data, start, size, big):
    """Independent bit loop."""
    if not 1 <= size <= 64:
        return 0
    raw, bit = 0, start
    for k in range(size):
        byte, at = divmod(bit, 8)
        b = data[byte] >> at & 1 if byte < 8 else 0
        if big:
            raw = raw << 1 | b
            bit = bit + 15 if bit % 8 == 0 else bit - 1
        else:
            raw |= b << k
            bit += 1
    return raw


def signed64(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_extract_and_pack_match_a_bit_loop(spark):
    rnd = random.Random(1)
    rows = [(k, bytes(rnd.randrange(256) for _ in range(8)), rnd.randrange(0, 80), rnd.randrange(0, 66), rnd.random() < 0.5) for k in range(800)]
    rows += [(900, bytes([0x34, 0x12, 0, 0, 0, 0, 0, 0]), 0, 16, False), (901, b"\xff" * 8, 7, 64, True), (902, b"\xff" * 8, 0, 64, False)]
    df = codec.with_words(spark.createDataFrame(rows, "k int, data binary, start_bit int, size int, big_endian boolean")).withColumn("raw", codec.extract_raw())
    mask, bits = codec.field_bits()
    got = {r["k"]: r for r in df.withColumn("mask", mask).withColumn("bits", bits).withColumn("back", codec.word_to_data(F.col("bits"))).collect()}
    for k, data, start, size, big in rows:
        want = bits_of(data, start, size, big)
        assert got[k]["raw"] == signed64(want), rows[k] if k < 800 else k
        if 1 <= size <= 64 and start < 64:
            assert bits_of(bytes(got[k]["back"]), start, size, big) == want or start + size > 64 or big


def test_physical_both_ways(spark):
    rows = [
        (0, 0xFFFF, 16, True, 0.5, 1.0, 0.5), (1, 0xFFFF, 16, False, 0.5, 1.0, 32768.5), (2, -1, 64, False, 1.0, 0.0, 2.0**64), (3, -1, 64, True, 1.0, 0.0, -1.0),
        (4, 1, 1, True, 1.0, 0.0, -1.0), (5, 3000, 16, False, 0.25, 0.0, 750.0),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "k int, raw long, size int, signed boolean, factor double, offset double")
    got = {r["k"]: r["v"] for r in df.select("k", codec.to_physical().alias("v")).collect()}
    assert got == {r[0]: r[6] for r in rows}
    back = [
        (0, 2.5, 8, False, 1.0, 0.0, 3), (1, -2.5, 8, True, 1.0, 0.0, 0xFD), (2, 1e30, 8, False, 1.0, 0.0, 255), (3, -1e30, 8, True, 1.0, 0.0, 0x80), (4, 1e30, 64, True, 1.0, 0.0, (1 << 63) - 1),
        (5, math.nan, 8, False, 1.0, 0.0, 0), (6, 5.0, 8, False, 0.0, 0.0, 255), (7, 7.0, 63, False, 1.0, 0.0, 7), (8, -3.0, 1, True, 1.0, 0.0, 1), (9, 12.0, 0, False, 1.0, 0.0, 12),
    ]
    df = spark.createDataFrame([r[:6] for r in back], "k int, phys double, size int, signed boolean, factor double, offset double")
    got = {r["k"]: r["v"] for r in df.select("k", codec.from_physical().alias("v")).collect()}
    assert got == {r[0]: r[6] for r in back}


def test_texts(spark):
    df = spark.createDataFrame([("0A ff",), ("1G",), ("",), ("1 2 3 4 5 6 7 8 9",)], "t string")
    assert [r[0] for r in df.select(F.hex(codec.parse_hex_bytes(F.col("t")))).collect()] == ["0AFF000000000000", None, None, None]
    ids = spark.createDataFrame([(0x12, False), (0x1234, False), (0x18DA10F2, True)], "id long, e boolean")
    assert [r[0] for r in ids.select(codec.render_id(F.col("id"), F.col("e"))).collect()] == ["012", "1234", "18DA10F2x"]
    v = spark.createDataFrame([(1234.5,), (12.34,), (1.234,), (None,)], "v double")
    assert [r[0] for r in v.select(codec.format_value(F.col("v"))).collect()] == ["1235", "12.3", "1.23", None]
