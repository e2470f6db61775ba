import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from matchloom.functions import strings as S
from matchloom.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,want", [("Lumière & Fils SARL", "lumiere and fils sarl"), ("p.v.t", "p v t"), ("O'Neil’s", "oneils"), (None, ""), ("ß", ""), ("ﬁne ½", "fine 1 2"), ("東京", ""), ("  A  b ", "a b")])
def test_fold(spark, text, want):
    assert one(spark, text, T.fold) == want


def test_fold_follows_compatibility_decomposition(spark):
    def slow(text):
        flat = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in flat.replace("&", " and ").replace("'", "").replace("’", "")).split())

    texts = ["x" + "".join(map(chr, range(a, a + 16))) + "y" for a in itertools.chain(range(0xA0, 0x600, 16), range(0x1E00, 0x2200, 16), range(0xFB00, 0xFB10, 16), range(0x1D400, 0x1D800, 16), range(0x1F100, 0x1F200, 16), range(0x10280, 0x10300, 16), range(0xE0100, 0xE0120, 16))]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.fold(F.col("x")).alias("y")).collect()
    assert [(r["x"], r["y"]) for r in rows if r["y"] != slow(r["x"])] == []


def test_names_and_addresses(spark):
    assert one(spark, "Sharma Traders Private Limited", T.normalize_name) == one(spark, "Sharma Traders Pvt. Ltd.", T.normalize_name)
    assert one(spark, "Summit Hardware Corporation", T.name_core) == "summit hardware"
    assert one(spark, "The Company", T.name_core) == "the co"
    assert one(spark, "12 MG Road", T.normalize_address) == one(spark, "12 MG Rd.", T.normalize_address)
    assert one(spark, "5 Rue Rivoli, Paris 75001", T.postcodes) == ["75001"]
    assert one(spark, "x 1234567, 411001 12345", T.postcodes) == ["12345", "411001"]
    assert one(spark, None, T.numbers) == []


def test_string_scores():
    rng = random.Random(3)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for k, y in enumerate(b, 1):
                prev, row[k] = row[k], prev + 1 if x == y else max(row[k], row[k - 1])
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert S.common_length(a, b) == lcs(a, b)
        short, long_ = sorted((a, b), key=len)
        cuts = [long_[max(0, k):k + len(short)] for k in range(1 - len(short), len(long_))] if short else []
        slow = max([S.ratio(short, c) for c in cuts if c], default=float(a == b))
        if len(a) != len(b):
            assert S.partial_ratio(a, b) == pytest.approx(slow)
    assert S.ratio("", "") == 1 and S.token_set_ratio("", "a") == 0 and S.token_set_ratio("a b", "b a c") == 1
    assert S.partial_ratio("bakery", "the bakery shop") == 1 and S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6) and S.jaro_winkler("abc", "xyz") == 0
