import random

import pytest
from pyspark.sql import functions as F

from quillrank.functions.edits import (
    allowed_edits, edits_within_two, may_be_near, most_keys, probe_keys, vocabulary_keys,
)
from quillrank.functions.keys import decimal_text, embedding_key, results_key
from quillrank.functions.text import (
    build_text, clean_list, first_non_empty, split_words, synopsis_authors, synopsis_subjects,
    synopsis_year, term_frequencies, tokenize, tokenize_list,
)


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {t}" for n, (t, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], schema)
    assert names == df.columns
    return df.select(column.alias("x")).first()["x"]


def test_tokens_keep_order_repeats_and_inner_marks(spark):
    text = "A the The cat's b.c 1.5 Café. (x-y) don’t"
    got = one(spark, tokenize(F.col("s")), s=("string", text))
    assert got == ["a", "the", "the", "cat's", "b.c", "1.5", "café", "x", "y", "don’t"]
    assert one(spark, tokenize(F.col("s")), s=("string", None)) == []
    assert one(spark, tokenize(F.col("s")), s=("string", " .,;")) == []


# Cases of the Unicode word boundary rules.
SEGMENTED = [
    ("can't stop", ["can't", "stop"]), ("3.14 and 1,234.5", ["3.14", "and", "1,234.5"]), ("a.b a:b", ["a.b", "a:b"]),
    ("ab''c", ["ab", "c"]), ("1a2 a1.2b", ["1a2", "a1.2b"]), ("a.1 1.a", ["a", "1", "1", "a"]), ("x,y", ["x", "y"]),
    ("snake_case _x_ _", ["snake_case", "_x_"]), ("漢字かな", ["漢", "字", "か", "な"]), ("カタカナ漢", ["カタカナ", "漢"]),
    ("東京タワー", ["東", "京", "タワー"]), ("テキストabc", ["テキスト", "abc"]), ("テキスト_abc", ["テキスト_abc"]),
    ("한국어 텍스트", ["한국어", "텍스트"]), ("Привет, мир!", ["привет", "мир"]), ("e\u0301te\u0301", ["e\u0301te\u0301"]),
    ("co\u00adop", ["co\u00adop"]), ("ภาษาไทย x", ["ภาษาไทย", "x"]), ("", []), (None, []), ("- . ! ", []),
    ("a\u200bb", ["a", "b"]), ("l’été d'or", ["l’été", "d'or"]), ("w" * 600, ["w" * 255, "w" * 255, "w" * 90]),
]


def test_words_by_the_unicode_rules(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SEGMENTED)], "i int, t string")
    found = {r["i"]: r["w"] for r in rows.select("i", tokenize(F.col("t"), "unicode").alias("w")).collect()}
    assert found == {i: words for i, (_, words) in enumerate(SEGMENTED)}
    lists = rows.select(tokenize_list(F.array(F.lit("漢字"), F.lit(None), F.lit("a b")), "unicode").alias("w")).first()["w"]
    assert lists == ["漢", "字", "a", "b"]
    with pytest.raises(ValueError):
        tokenize(F.col("t"), "other")


def test_term_frequencies_count_runs(spark):
    got = one(spark, term_frequencies(F.col("a")), a=("array<string>", list("abacaba")))
    assert [(r["term"], r["tf"]) for r in got] == [("a", 4), ("b", 2), ("c", 1)]
    assert one(spark, term_frequencies(F.col("a")), a=("array<string>", [])) == []


def test_text_defaults(spark):
    assert one(spark, build_text(F.col("a"), F.col("b")), a=("string", "T"), b=("string", None)) == "T. "
    pick = first_non_empty(F.col("a"), F.col("b"))
    assert one(spark, pick, a=("string", ""), b=("string", "x")) == "x"
    assert one(spark, pick, a=("string", None), b=("string", None)) == ""
    assert one(spark, clean_list(F.col("a")), a=("array<string>", ["x", "", None, "y"])) == ["x", "y"]
    assert one(spark, clean_list(F.col("a")), a=("array<string>", None)) == []
    assert one(spark, split_words(F.col("a")), a=("string", "  two words \n x")) == ["two", "words", "x"]


def test_synopsis_parts(spark):
    full = "Title by Ann B, Carl. Published in 1999. Subjects: Math, , Art.\n"
    assert one(spark, synopsis_authors(F.col("s")), s=("string", full)) == ["Ann B", "Carl"]
    assert one(spark, synopsis_year(F.col("s")), s=("string", full)) == "1999"
    assert one(spark, synopsis_subjects(F.col("s")), s=("string", full)) == ["Math", "Art"]
    assert one(spark, synopsis_subjects(F.col("s")), s=("string", "subject: one")) == ["one"]
    assert one(spark, synopsis_authors(F.col("s")), s=("string", "nothing here")) == []
    assert one(spark, synopsis_year(F.col("s")), s=("string", "nothing here")) is None


def test_keys_match_python(spark):
    import hashlib

    key = results_key(F.col("q"), F.col("n"), F.col("t"))
    for t in (0.0, 0.02, 1.0, 0.0005, 0.00012, 1e-05, 2.5e-07, 0.123456789):
        raw = f"books|5|{t}"
        assert one(spark, decimal_text(F.col("t")), t=("double", t)) == str(t)
        want = "res:" + hashlib.sha256(raw.encode()).hexdigest()
        assert one(spark, key, q=("string", "books"), n=("int", 5), t=("double", t)) == want
    plain = one(spark, embedding_key(F.col("q")), q=("string", "a"))
    scoped = one(spark, embedding_key(F.col("q"), "model"), q=("string", "a"))
    assert plain != scoped and plain.startswith("emb:")


def python_distance(a: str, b: str) -> int:
    """Unrestricted edit distance with adjacent swaps, by the textbook table."""
    last = {}
    big = len(a) + len(b)
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            i1, j1 = last.get(b[j - 1], 0), match
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, match = 0, j
            d[i + 1][j + 1] = min(
                d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1,
                d[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1),
            )
        last[a[i - 1]] = i
    return d[len(a) + 1][len(b) + 1]


def test_distance_and_keys_agree_with_brute_force(spark):
    import random

    rng = random.Random(5)
    words = {"ab", "ba", "a", "teh", "the", "ca", "abc"}
    for _ in range(60):
        size = rng.choice([2, 3, 4, 5, 6, 7, 8, 18, 19, 20, 21, 22, 23, 30])
        base = "".join(rng.choice("abé") for _ in range(size))
        words.add(base)
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randint(1, 2)):
                at = rng.randrange(len(w)) if w else 0
                kind = rng.randrange(4)
                if kind == 0 and len(w) > 1:
                    w.pop(at)
                elif kind == 1:
                    w.insert(at, rng.choice("abé"))
                elif kind == 2 and at + 1 < len(w):
                    w[at], w[at + 1] = w[at + 1], w[at]
                elif w:
                    w[at] = rng.choice("abé")
            words.add("".join(w))
    words.discard("")
    df = spark.createDataFrame([(w,) for w in sorted(words)], "w string").repartition(8)
    left, right = df.withColumnRenamed("w", "l"), df.withColumnRenamed("w", "r")
    pairs = left.crossJoin(right).select(
        "l", "r", edits_within_two(F.col("l"), F.col("r")).alias("d"),
        F.arrays_overlap(probe_keys(F.col("l")), vocabulary_keys(F.col("r"))).alias("meet"),
    ).collect()
    assert len(pairs) == len(words) ** 2
    for row in pairs:
        want = python_distance(row["l"], row["r"])
        assert row["d"] == min(3, want), row
        size = len(row["l"])
        allowed = 0 if size <= 2 else 1 if size <= 5 else 2
        if want <= allowed:
            assert row["meet"], row


def test_long_words_have_few_keys_and_meet_all_neighbours(spark):
    import random

    rng, pairs = random.Random(11), []
    for size in [*range(7, 25)] * 40:
        word = "".join(rng.choice("abc") for _ in range(size))
        other = word
        for _ in range(2):
            at = rng.choice([rng.randrange(len(other)), len(other) // 2])  # often at the cut
            swapped = other[:at - 1] + other[at] + other[at - 1] + other[at + 1:] if 0 < at < len(other) else other
            other = rng.choice([
                swapped, other[:at] + other[at + 1:], other[:at] + "z" + other[at:], other[:at] + "y" + other[at + 1:]])
        pairs.append((word, other))
    found = spark.createDataFrame(pairs, "l string, r string").select(
        "l", "r", edits_within_two(F.col("l"), F.col("r")).alias("d"),
        F.arrays_overlap(probe_keys(F.col("l")), vocabulary_keys(F.col("r"))).alias("meet"),
        F.size(probe_keys(F.col("l"))).alias("probes"), F.size(vocabulary_keys(F.col("r"))).alias("keys"),
    ).collect()
    assert not [r for r in found if r["d"] <= 2 and len(r["l"]) > 5 and not r["meet"]]
    assert max(r["probes"] for r in found) <= 211
    assert all(r["keys"] <= max(46, len(r["r"]) + 2) for r in found)


def test_numbers_have_few_keys_and_meet_all_neighbours(spark):
    rng, pairs = random.Random(5), []
    for n in range(6000):
        word = "".join(rng.choice("0123456789" if n % 3 else "012") for _ in range(rng.randrange(4, 13)))
        other = word
        for _ in range(2):
            at, new = rng.randrange(len(other)), rng.choice("0123456789a")
            swapped = other[:at] + other[at + 1 : at + 2] + other[at] + other[at + 2 :]
            other = rng.choice([swapped, other[:at] + other[at + 1 :] or new, other[:at] + new + other[at:],
                                other[:at] + new + other[at + 1 :]])
        pairs += [(word, other), (other, word)]
    found = spark.createDataFrame(pairs, "l string, r string").repartition(8).select(
        "l", "r", edits_within_two(F.col("l"), F.col("r")).alias("d"), allowed_edits(F.col("l")).alias("allowed"),
        F.arrays_overlap(probe_keys(F.col("l")), vocabulary_keys(F.col("r"))).alias("meet"),
        F.size(probe_keys(F.col("l"))).alias("probes"), F.size(vocabulary_keys(F.col("r"))).alias("keys"),
        most_keys(F.col("r")).alias("most"),
    ).collect()
    near = [r for r in found if r["d"] <= r["allowed"]]
    assert len(near) > 5000 and all(r["meet"] for r in near)
    assert max(r["probes"] for r in found) <= 211 and all(r["keys"] <= r["most"] for r in found)
    assert all(r["keys"] <= len(r["r"]) + 2 for r in found if len(r["r"]) >= 6 and r["r"].isdigit())


def test_the_filter_of_candidates_keeps_all_neighbours(spark):
    draw = random.Random(9)
    words = ["".join(draw.choice("abcd") for _ in range(draw.randint(1, 8))) for _ in range(150)]
    words += [w[:i] + w[i + 1] + w[i] + w[i + 2:] for w in words for i in range(0, len(w) - 1, 3)] + ["ca", "abc", "abdc", "bacd"]
    rows = spark.createDataFrame([(w,) for w in sorted(set(words))], "l string")
    pairs = rows.crossJoin(rows.withColumnRenamed("l", "r")).withColumn("edits", edits_within_two(F.col("l"), F.col("r")))
    for allowed in (0, 1, 2):
        kept = may_be_near(F.col("l"), F.col("r"), F.lit(allowed))
        near, lost, dropped = pairs.agg(
            F.count_if(F.col("edits") <= allowed), F.count_if((F.col("edits") <= allowed) & ~kept), F.count_if(~kept)).first()
        assert near > 0 and lost == 0 and dropped > 0
    # Four plain edits and no swap: nothing that has to be moved.
    far = spark.createDataFrame([("garden", "gwtuxn")], "l string, r string")
    assert far.select(may_be_near(F.col("l"), F.col("r"), F.lit(2))).first()[0] is False
