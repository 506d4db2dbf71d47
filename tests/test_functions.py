import time

import pytest
from pyspark.sql import functions as F

from arborfold.functions import clock, crypto, paths, signatures, values
from arborfold.operators import auth
from arborfold.sources import store


def test_positions_between():
    live = [(0, 1), (1, 1)]
    for _ in range(20):
        mid = values.insert_position(live, 1)
        assert live[0][0] * mid[1] < mid[0] * live[0][1] and mid[0] * live[1][1] < live[1][0] * mid[1]
        live[1] = mid
    assert values.insert_position([], 0) == (1, 1)
    assert values.insert_position([(5, 2)], 0) == (1, 1) and values.insert_position([(5, 2)], 1) == (3, 1)


def test_build_paths():
    assert paths.build("a", 1, "", "b") == "a.1.b"
    with pytest.raises(ValueError, match="component"):
        paths.build("a.b")


def test_permission_order(spark):
    rows = [("Read", 0), ("Write", 5), ("Write", 1), ("Admin", 4_000_000_000), ("Admin", 0)]
    df = spark.createDataFrame(rows, "t string, p long").withColumn("r", auth.rank(F.col("t"), F.col("p")))
    ranks = [r["r"] for r in df.collect()]
    assert ranks == sorted(ranks) and len(set(ranks)) == 5
    assert [r["x"] for r in df.select(auth.allowed(F.col("r"), F.lit(True)).alias("x")).collect()] == [False, False, False, True, True]


def test_encryption(spark):
    key = crypto.derive_key("pw", b"salt")
    df = spark.createDataFrame([("secret",), (None,), ("",)], "t string").select("t", crypto.encrypt(F.col("t"), key).alias("d"))
    assert all(r["t"] == r["x"] for r in df.select("t", crypto.decrypt(F.col("d"), key).alias("x")).collect())
    assert all(r["x"] is None for r in df.select(crypto.decrypt(F.col("d"), crypto.derive_key("no", b"salt")).alias("x")).collect())


def test_saved_folder_and_places(spark, tmp_path):
    assert store.load(spark, str(tmp_path / "none"), ["a"]) is None
    df = spark.createDataFrame([("t", "e", 1)], "tree_id string, entry_id string, height int")
    store.save({"entries": df}, str(tmp_path / "s"))
    assert store.load(spark, str(tmp_path / "s"), ["entries"])["entries"].collect() == df.collect()
    spark.createDataFrame([(99, "parquet")], "version int, form string").write.mode("overwrite").parquet(str(tmp_path / "s" / "_version"))
    with pytest.raises(ValueError, match="version 99"):
        store.load(spark, str(tmp_path / "s"), ["entries"])
    assert store.reader(spark, f"parquet:{tmp_path / 's'}")("entries").count() == 1
    store.set_metadata(spark, str(tmp_path), {"device": "a"})
    store.set_metadata(spark, str(tmp_path), {"device": "b"})
    assert store.get_metadata(spark, str(tmp_path)) == {"device": "b"}
    df.createOrReplaceTempView("mem")
    assert store.reader(spark, "memory:")("mem").count() == 1
    with pytest.raises(ValueError, match="expected"):
        store.reader(spark, "ftp://x")


def test_signatures_equal_the_standard():
    """The first three test vectors of RFC 8032, 7.1."""
    vectors = [
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
        ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
    ]
    for seed, public, message, signature in vectors:
        seed, public, message, signature = map(bytes.fromhex, (seed, public, message, signature))
        assert signatures.public_key(seed) == public and signatures.sign(seed, message) == signature
        assert signatures.verify(public, message, signature) and not signatures.verify(public, message + b"x", signature)
        assert not signatures.verify(public, message, signature[:-1]) and not signatures.verify(b"short", message, signature)
        assert signatures.parse_key(signatures.key_text(public)) == public
    for bad in ("ed25519:AAAA", "rsa:" + "A" * 43):
        try:
            signatures.parse_key(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_clocks():
    c = clock.FixedClock(1_735_689_600_000, 10)
    assert (c.now_millis(), c.now_millis(), c.now_seconds()) == (1_735_689_600_000, 1_735_689_600_010, 1_735_689_600)
    c.hold()
    assert c.now_millis() == c.now_millis() == 1_735_689_600_030 and c.now_rfc3339() == "2025-01-01T00:00:00.030Z"
    c.advance(1000)
    c.hold(False)
    assert c.now_millis() == 1_735_689_601_030 and c.now_millis() == 1_735_689_601_040
    assert abs(clock.SystemClock().now_millis() / 1000 - time.time()) < 5 and clock.SystemClock().now_rfc3339().endswith("Z")


def test_present_and_text_of_times(spark):
    got = spark.range(3).select(clock.now_millis().alias("ms"), clock.now_seconds().alias("s"), clock.rfc3339(F.lit(-1).cast("bigint")).alias("t")).distinct().collect()
    assert len(got) == 1 and got[0]["ms"] // 1000 == got[0]["s"] and got[0]["t"] == "1969-12-31T23:59:59.999Z"


def test_places_that_are_none(spark):
    for url in ("http://x", "unix:/run/x", "", "nonsense", "parquet:"):
        try:
            store.reader(spark, url)
            raise AssertionError(url)
        except store.UnknownPlace as e:
            assert "expected" in str(e)
