"""Text rules against plain Python on random texts."""

import random
import re
import struct

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import text as tx
from tests.test_text import column, plain_format, plain_slug

ALPHABET = "abcXYZ019 _-.,;!?#%&/()\t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ​ 　éÉßüñçøİıſǅσΣςЖжअआि中文한😀👍🏽ﬁ½²Ⅷ①ª́̈⃝‿"


def texts(seed, count, low=0, high=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(low, high))) for _ in range(count)]


def test_slugify(spark):
    values = texts(1, 3000) + texts(2, 300, 60, 200)
    got = column(spark, values, tx.slugify)
    assert [(v, g) for v, g in zip(values, got) if g != plain_slug(v)] == []


def test_clean_title(spark):
    values = texts(3, 3000)
    got = column(spark, values, tx.clean_title)
    assert [(v, g) for v, g in zip(values, got) if g != re.sub(r"\s+", " ", v.strip())] == []


def test_join_lines(spark):
    values = [texts(seed, 5) for seed in range(10, 300)]
    got = column(spark, values, tx.join_lines, "array<string>")
    assert got == ["\n".join(line.rstrip() for line in lines) for lines in values]


def test_strip_and_split(spark):
    values = texts(5, 2000)
    assert column(spark, values, tx.strip) == [v.strip() for v in values]
    want = [[p.strip() for p in v.split(",") if p.strip()] for v in values]
    assert column(spark, values, tx.split_list) == want


def doubles(seed, count):
    rng = random.Random(seed)
    wild = [struct.unpack("d", rng.randbytes(8))[0] for _ in range(count)]
    near = [rng.choice([1, -1]) * rng.uniform(1, 10) * 10 ** rng.randint(-6, 12) for _ in range(count)]
    cents = [rng.randint(-10**9, 10**9) / 100 for _ in range(count)]
    return [v for v in wild if v == v] + near + cents


def test_format_scalar(spark):
    values = [v for v in doubles(1, 2000) if abs(v) < 1e15]
    got = column(spark, values, lambda c: tx.format_scalar(c, T.DoubleType()), "double")
    assert [(v, g) for v, g in zip(values, got) if g != plain_format(v)] == []


def test_double_text_reads_back(spark):
    """The text has Python's shape and names the same number. Its digits may be longer: Java 17
    does not always find the shortest ones."""
    values = doubles(2, 2000)
    got = column(spark, values, tx.double_text, "double")
    assert [float(g) for g in got] == values
    assert [("e" in g) for g in got] == [("e" in str(v)) for v in values]
    assert sum(g == str(v) for g, v in zip(got, values)) > 0.9 * len(values)


def test_whole_words(spark):
    values = texts(7, 1500) + [f"{a}by{b}" for a in ALPHABET for b in (" ", "é", "_", "-")]
    got = column(spark, values, lambda c: tx.has_word(F.lower(c), "by"), "string")
    assert got == [re.search(r"\bby\b", v.lower()) is not None for v in values]
