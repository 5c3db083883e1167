"""Column functions on small hand-made vectors."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from voxtable.functions import numbers as N
from voxtable.functions import text as X
from voxtable.functions import units as U


@pytest.fixture(scope="module")
def one(spark):
    base = spark.range(1)

    def value(*columns):
        row = base.select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()
        return row[0] if len(row) == 1 else tuple(row)

    return value


def array(*values):
    return F.array(*map(F.lit, values))


def test_units(one):
    assert one(U.unit_string(array(0, 5))) == chr(983040) + chr(983045)
    assert one(U.unit_mark(F.lit(3)), U.unit_string(array(1, 2), "mark"), U.spaced(array(1, 2))) == ("<extra_id_3>", "<extra_id_1><extra_id_2>", "1 2")
    assert one(U.string_units(U.unit_string(array(0, 7, 65533)))) == [0, 7, 65533]
    with pytest.raises(Exception, match="private use"):
        one(U.unit_char(F.lit(65534)))


def test_units_of_both_areas(one):
    assert one(U.unit_string(array(65536))) == chr(0x100000)
    assert one(U.string_units(U.unit_string(array(65533, 65536, 128657, 131069)))) == [65533, 65536, 128657, 131069]
    for i in (-1, 65535, 131070, 131071, 131072):
        with pytest.raises(Exception, match="private use"):
            one(U.unit_char(F.lit(i)))


def test_runs(one):
    assert one(U.collapse(array(1, 1, 2, 2, 1))) == [1, 2, 1]
    assert one(U.detokenize(array(3, 3, -1, 3, 4), as_labels=True)) == [3, 4]
    assert one(U.detokenize(array(3, 3, -1, 3, 4), as_labels=True, deduplicate=False)) == [3, 3, 3, 4]
    assert one(U.collapse_chars(F.lit("aab\n\nc" + chr(983041) * 3))) == "ab\nc" + chr(983041)
    assert one(U.masked(array(1, 2), F.array(F.lit(True), F.lit(False)))) == [1, -1]


def test_lengths(one):
    assert one(N.pooled_length(F.lit(10), 4), N.pooled_length(F.lit(3), 4), N.pooled_length(F.lit(10), 4, 2)) == (2, 0, 4)
    assert one(N.padded_size(F.lit(37005)), N.hours_of_frames(F.lit(180000))) == (37056, 1.0) and N.padded_size(37005) == 37056
    assert one(N.seconds_of_samples(F.lit(8000)), N.seconds_of_bytes(F.lit(32000)), N.seconds_between(F.lit(1), F.lit(3.5))) == (0.5, 1.0, 2.5)
    assert one(N.length_mask(F.lit(2), F.lit(3)), N.length_mask(F.lit(0), F.lit(2))) == ([True, True, False], [False, False])
    assert one(N.halve_mask(N.length_mask(F.lit(3), F.lit(5))), N.halve_mask(N.length_mask(F.lit(1), F.lit(1)))) == ([True, True], [])


def test_numbers(one):
    inf = float("inf")
    assert one(*(N.nan_to_num(F.lit(x)) for x in (float("nan"), inf, -inf, 2.0))) == (0.0, N.LARGEST, -N.LARGEST, 2.0)
    assert one(N.argmin(array(3, 1, 1)), N.squared_distance(array(1.0, 2.0), array(4.0, 6.0)), N.dot(array(1, 2), array(3, 4))) == (1, 25.0, 11.0)
    assert math.isclose(one(0.98 * F.lit(1.0) + 0.02 * F.lit(10.0)), 1.18)


def test_paths(one):
    assert one(X.stem(F.lit("/a/b.c.wav")), X.stem(F.lit(".hidden")), X.basename(F.lit("a/b")), X.stem(F.lit("x"))) == ("b.c", ".hidden", "b", "x")
    assert one(X.last_part(F.lit("/d/p225_001_mic2.flac")), X.path_join(F.lit("/r"), F.lit("a.wav")), X.path_join(F.lit("/r/"), F.lit("a")), X.path_join(F.lit("/r"), F.lit("/a"))) == ("mic2", "/r/a.wav", "/r/a", "/a")
    assert one(X.strip(F.lit(" \t\n a b\x0b \n"))) == "a b"
    assert one(X.contains_any(F.lit("x/librispeech-pc/y"), {"librispeech-pc": F.lit("keyed")}, F.lit("placed"))) == "keyed"


def test_templates(one):
    assert one(X.fill("{a} to {b}, {a}{{}}", {"a": F.lit("{b}"), "b": F.lit("x")})) == "{b} to x, {b}{}"
    with pytest.raises(KeyError):
        X.fill("{missing}", {})
    message = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("text")))
    assert one(X.chat_prompt(message)) == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n"
    assert one(X.chat_prompt(message, generate=False)) == "<|im_start|>user\nhi"


def test_text(one):
    assert one(*(X.cut_at_stop(F.lit(t)) for t in ("a<\\s>b", "a\\nb", "a\nb", "a<END>", "abc"))) == ("a", "a", "a", "a", "abc")
    assert one(X.normalize_basic(F.lit("Hello, [noise] World (um)!  It's"))) == "hello world it s"
    assert one(X.normalize(F.lit("ﬁne ½ [x]A"))) .strip().startswith("fine")
    assert one(X.normalize_english(F.lit("Uh, I won't pay $1,000 to Mr. Smith [laughs]"))).split() == ["i", "will", "not", "pay", "$1000", "to", "mister", "smith"]
