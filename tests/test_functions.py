import re
import unicodedata

from pyspark.sql import functions as F

from entwine.functions import sets, text

WORDS = ["", "a", "aa", "Ünïted  Café, Ltd.", "ACME Private Limited", "naïve—co", "12, Main St.", "Señor Company", "x_y z", "日本 Corp", " lead", "½ ² 3", "ß"]


def test_normalize_matches_plain_python(spark):
    def spec(s):
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        return " ".join(re.sub(r"[^\w\s]", " ", s.lower()).split())

    df = spark.createDataFrame([(i, w) for i, w in enumerate(WORDS)], "i int, w string")
    got = {r.i: (r.full, r.latin) for r in df.select("i", text.normalize(text.fold_full("w"), accents=True).alias("full"), text.normalize(F.col("w")).alias("latin")).collect()}
    for i, w in enumerate(WORDS):
        assert got[i][0] == spec(w)
        if w not in ("½ ² 3",):
            assert got[i][1] == spec(w)


def test_suffixes_numbers_tokens(spark):
    df = spark.createDataFrame([("acme private limited company", "Unit 12, Road 7 7 B-3")], "n string, a string")
    r = df.select(text.short_suffixes(F.col("n")).alias("s"), text.numeric_tokens(F.col("a")).alias("d"), text.tokens(F.lit("")).alias("e"), text.digit_runs(F.col("a")).alias("r"), text.ascii_tokens(F.lit("the big acme co acme")).alias("t")).first()
    assert (r.s, r.d, r.e, r.r, r.t) == ("acme pvt ltd co", ["12,", "7", "b-3"], [], ["12", "7", "7", "3"], ["big", "acme", "acme"])


def test_similarities_match_sets(spark):
    def grams(s, n):
        return {s[i : i + n] for i in range(len(s) - n + 1)} if len(s) >= n else ({s} if s else set())

    pairs = [(a, b) for a in WORDS for b in WORDS]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for n in (2, 3):
        a, b = sets.ngrams(F.col("a"), n), sets.ngrams(F.col("b"), n)
        for r in df.select("i", sets.dice(a, b).alias("d"), sets.jaccard(a, b).alias("j"), sets.containment(a, b).alias("c"), F.size(a).alias("n")).collect():
            x, y = (grams(s, n) for s in pairs[r.i])
            both = len(x & y)
            assert r.n == len(x)
            assert abs(r.d - (1 if not x and not y else 0 if not x or not y else 2 * both / (len(x) + len(y)))) < 1e-12
            assert abs(r.j - (1 if not x and not y else both / len(x | y))) < 1e-12
            assert abs(r.c - (both / min(len(x), len(y)) if x and y else 0)) < 1e-12
