import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioloom.functions import guards, places, tables, text, vectors


def one(spark, value, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], f"v {kind}").select(f(F.col("v"))).collect()]


def test_control_characters(spark):
    assert one(spark, ["Hello\x00World\x08!", "a\tb\nc\rd\x7f\x9f", None], text.drop_control) == ["HelloWorld!", "a\tb\nc\rd", None]


def test_space(spark):
    assert one(spark, ["  张   三   \n\n\n  李   四  ", "Ａ１　x", ""], text.tidy_space) == ["张 三\n\n李 四", "A1 x", ""]


def test_space_like_plain_python(spark):
    rng = random.Random(3)
    given = ["".join(rng.choice(" \t\n\r\x0b\x1c\u2028\x85　ab ") for _ in range(rng.randrange(20))) for _ in range(300)]

    def plain(t):
        t = unicodedata.normalize("NFKC", t)
        t = "\n".join(re.sub(r"[ \t]+", " ", x.strip()) for x in t.splitlines())
        return re.sub(r"\n{3,}", "\n\n", t).strip()

    assert one(spark, given, text.tidy_space) == [plain(t) for t in given]


def test_masks(spark):
    assert one(spark, ["13812345678", "x13812345678,13987654321.", "113812345678"], text.mask_phone) == ["138****5678", "x138****5678,139****4321.", "113812345678"]
    assert one(spark, ["110101199003072345", "11010119900307234X"], text.mask_national_id) == ["110101********2345", "110101********234X"]
    given = ["user@example.com", "ab@b.co.", "a@b.co", "no at", "x.y+z@q-r.org and me@here.cn"]
    want = ["u**r@example.com", "a*@b.co.", "a*@b.co", "no at", "x***z@q-r.org and m*@here.cn"]
    assert one(spark, given, text.mask_email) == want
    found = re.compile(r"([a-zA-Z0-9_.+-]+)@([a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)")
    rng = random.Random(8)
    given = ["".join(rng.choice("ab.-_+@ c@") for _ in range(rng.randrange(40))) for _ in range(600)] + ["x@y.z@w.com", None, ""]
    want = [t and found.sub(lambda m: (m[1][0] + "*" if len(m[1]) <= 2 else m[1][0] + "*" * (len(m[1]) - 2) + m[1][-1]) + "@" + m[2], t) for t in given]
    assert one(spark, given, text.mask_email) == want


def test_lines_like_splitlines(spark):
    rng = random.Random(5)
    given = ["".join(rng.choice("ab\n\r\x0b\x0c\x1c\x85 ") for _ in range(rng.randrange(12))) for _ in range(300)]
    got = one(spark, given, text.lines)
    assert [g for g in got] == [t.splitlines() or [] if t else [] for t in given]


def test_forms(spark):
    assert one(spark, ["  Page 12 of 9 "], text.margin_form) == ["page#of#"]
    assert one(spark, [" A b\tC "], text.dedup_form) == ["abc"]
    assert one(spark, ["²", "½", "...", "_", "é", "中"], text.has_word) == [True, True, False, True, True, True]
    assert one(spark, ["secret99", "short"], text.mask_key) == ["secr***99", "***"]


def test_tables(spark):
    rows = [[["a", "b"], ["1"], ["2", "3", "4"]], []]
    got = one(spark, rows, tables.markdown, "array<array<string>>")
    assert got == ["| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | 3 | 4 |", ""]
    assert one(spark, [[["a"], ["1"]], []], tables.html, "array<array<string>>") == ["<table border='1'>\n  <thead>\n    <tr><th>a</th></tr>\n  </thead>\n  <tbody>\n    <tr><td>1</td></tr>\n  </tbody>\n</table>", "<table></table>"]
    table = "| k | k |  |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n| short |\nnot a row\n| a---b | x | y |"
    assert one(spark, [table, "no table", "| only |"], tables.records) == [[{"k": "2"}], [], []]


def test_vectors(spark):
    texts = ["", "abc", "文本", "x" * 500]
    got = one(spark, texts, lambda c: vectors.text_hash_vector(c, 5))
    for t, v in zip(texts, got, strict=True):
        seed = int(hashlib.md5(t.encode()).hexdigest(), 16)
        assert v == [round(((seed + i * 10007) % 20003) / 10000 - 1, 6) for i in range(5)]
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([], []), ([0.0], [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("name", ["../evil", "..", "a/b", "a\\b", ".hidden", "", "x" * 65, "a\n"])
def test_bad_collection_names(spark, name):
    assert one(spark, [name, "good_1-x"], guards.is_collection_name) == [False, True]


def test_addresses(spark):
    given = ["http://127.0.0.1/x", "https://10.0.0.1", "http://8.8.8.8/", "file:///etc/passwd", "http://user@172.16.3.4:80/", "http://[::1]/", "https://example.org/a", "http://localhost/", None]
    assert one(spark, given, guards.is_public_url) == [False, False, True, False, False, False, True, False, False]
    assert one(spark, ["../../x y", "___", "ok.txt"], guards.safe_name) == ["x_y", "file", "ok.txt"]
    assert one(spark, ["a/b.json", "/abs", "a/../b", ""], guards.safe_key) == ["a/b.json", None, None, None]


def test_places(spark):
    assert one(spark, [[10.0, 20.0, 30.0, 40.0]], lambda c: places.page_box(c, F.lit(100), F.lit(0)), "array<double>") == [[0.1, 20.0, 0.3, 40.0]]
    corners = [[[10.0, 10.0], [120.0, 10.0], [120.0, 30.0], [10.0, -5.0]]]
    assert one(spark, corners, lambda c: places.corners_box(c, F.lit(100), F.lit(100)), "array<array<double>>") == [[0.1, 0.0, 1.0, 0.3]]
    assert one(spark, [[0.0, 0.1, 1.0, 0.2], [0.0, 0.5, 1.0, 0.6], [0.1], None], places.in_margin, "array<double>") == [True, False, False, False]


def test_small_rules(spark):
    assert one(spark, ["# c\n A = 'x y' \nB=1=2\n\nno\nA=later\nC=\"q\""], text.settings) == [{"A": "x y", "B": "1=2", "C": "q"}]
    assert one(spark, ["30000/1001", "25/0", "x"], places.frame_rate) == [29.97, 25.0, None]
    assert one(spark, [" few words ", "x" * 30, None], lambda c: places.is_scanned(c, F.lit(2))) == [True, False, True]
