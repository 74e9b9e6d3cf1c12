"""Spelling variants: exact neighbours at one edit through pairs of trie nodes.

Every word is a path in a trie of all words and, reversed, in a second trie. Nodes are
numbered; a pair (prefix node, suffix node) of integers says what a word is on both
sides of a gap. Two words differ by one replaced code point if they have such a pair
around one position; a word is another one with a code point inserted if its pair around
a position equals the other's pair around the gap between two positions. Nodes are
equal only if their strings are, so a common pair is a neighbour, without any check.

Numbering: words are sorted in ranges, one for each task. Along sorted words a task
keeps the nodes of the current path and gives new numbers where a word leaves the path of
the one before. A path that goes on from one range into the next is known by the
edges of the ranges, one short row each; the numbers of its first nodes are replaced.

All rows with one pair meet in one group. It holds at most one word without a gap and
one word for each letter in the gap, so groups are bounded by the alphabet. A group
gives each of its words the number of its neighbours there and the best one, and these
add up over the pairs of a word. A gap within a run of equal letters is taken at the
run's first position only, so two words never meet twice.

Defined results: a null or empty text has no words. Rows are counted one by one, also
with equal ids or texts; a null id is the empty string before the colon. Words may be
as long as texts. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.tables import text_rows, written
from quillrank.sources.workspace import bucket_count, store

#: Bits of a node number below the number of its range.
_NODE_BITS = 42
#: A task passes its counts on when they hold so many characters.
_HELD_CHARACTERS = 4_000_000


@dataclass(frozen=True)
class SpellingConfig:
    """``length``: code points of a word at least; ``times``: its occurrences at least.

    A neighbour is a word's form if it occurs ``ratio`` times as often. One in
    ``modulus`` of the pairs of document and run has a code point left out.
    """

    length: int = 7
    times: int = 2
    ratio: int = 10
    modulus: int = 31


# ---------------------------------------------------------------- words


def varied(run: str, prefix: int, modulus: int) -> str:
    """The run, or what is left of it without one code point; ``prefix`` is the checksum of the id and colon."""
    h = zlib.crc32(run.encode(), prefix)
    if h % modulus:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(documents: DataFrame, cfg: SpellingConfig = SpellingConfig()) -> DataFrame:
    """``word, n``: results of runs in all texts with their occurrences, counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shorter runs cannot give a word that is long enough.
        runs = re.compile(f"[a-zÀ-ÿ]{{{cfg.length},}}").findall
        held, size = Counter(), 0

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for number, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                # Lower-casing bytes changes A to Z alone.
                found = Counter(runs((text.as_py() or "").encode().lower().decode()))
                prefix = zlib.crc32(f"{'' if number is None else number}:".encode())
                for word, n in found.items():
                    word = varied(word, prefix, cfg.modulus)
                    if len(word) >= cfg.length:
                        if word not in held:
                            size += len(word) + 50
                        held[word] += n
                if size > _HELD_CHARACTERS:
                    yield counted()
                    held, size = Counter(), 0
        if held:
            yield counted()

    counts = text_rows(documents).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= cfg.times)


# ---------------------------------------------------------------- tries


def common_prefix(a: str, b: str) -> int:
    """Number of code points in which two strings begin alike."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:  # halving, as slices compare fast
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def trie_nodes(keyed: DataFrame, key: str) -> DataFrame:
    """The rows with ``nodes``: the numbers of the trie nodes on the path of the string ``key``.

    The root is -1. Strings are distinct; equal prefixes have equal nodes, others different ones.
    """
    others = [c for c in keyed.columns if c != key]
    spark = keyed.sparkSession
    sorted_rows = (
        keyed.repartitionByRange(bucket_count(spark), key).sortWithinPartitions(key)
        .withColumn("_range", F.spark_partition_id())
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, path, following = "", [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            base = batch.column("_range")[0].as_py() << _NODE_BITS
            found = []
            for string in batch.column(key).to_pylist():
                same = common_prefix(before, string)
                path = path[:same] + list(range(base + following, base + following + len(string) - same))
                following += len(string) - same
                before = string
                found.append(path)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*others, key, "_range")), pa.array(found, pa.list_(pa.int64()))],
                [*others, key, "_range", "nodes"])

    fields = ", ".join(f"`{c}` {kind}" for c, kind in [*[(c, dict(keyed.dtypes)[c]) for c in others], (key, "string")])
    numbered = written(sorted_rows.mapInArrow(number, f"{fields}, _range int, nodes array<long>"), "trie")
    # One row for each range: its first string, and its last one with the path.
    edges = numbered.groupBy("_range").agg(
        F.min(key).alias("first"), F.max(key).alias("last"), F.max_by("nodes", key).alias("nodes")
    ).orderBy("_range").collect()
    carried, last, path = [], "", []
    for edge in edges:
        same = common_prefix(last, edge["first"])
        base = edge["_range"] << _NODE_BITS
        entered = path[:same]
        carried.append((edge["_range"], entered))
        # The path of the last string with the numbers that came over from earlier ranges.
        path = [entered[n - base] if n - base < same else n for n in edge["nodes"]]
        last = edge["last"]
    known = spark.createDataFrame(carried, "_range int, _entered array<long>")
    base = F.shiftleft(F.col("_range").cast("long"), _NODE_BITS)
    place = lambda n: (n - base + 1).cast("int")
    nodes = F.transform("nodes", lambda n: F.when(
        n - base < F.size("_entered"), F.element_at("_entered", place(n))).otherwise(n))
    return numbered.join(known, "_range").select(*others, key, nodes.alias("nodes"))


def numbered_words(counts: DataFrame) -> DataFrame:
    """``id, word, n, prefixes, suffixes``: a word's nodes before and after each of its positions.

    The id is the word's last node in the forward trie; ids ascend as words do.
    ``prefixes[i]`` stands for its first i code points, ``suffixes[i]`` for those from i on.
    """
    root = F.array(F.lit(-1).cast("long"))
    forward = written(
        trie_nodes(counts, "word").select(
            F.element_at("nodes", -1).alias("id"), "word", "n", F.concat(root, "nodes").alias("prefixes")),
        "forward-trie")
    backward = trie_nodes(forward.select("id", F.reverse("word").alias("turned")), "turned").select(
        "id", F.reverse(F.concat(root, "nodes")).alias("suffixes"))
    return forward.join(backward, "id")


# ---------------------------------------------------------------- neighbours


def node_pairs(numbered: DataFrame) -> DataFrame:
    """``p, s, id, n, gap``: every word under its pairs of nodes.

    ``gap`` is 0 for a pair without a code point left out, else 1 or, at the first of a
    run of equal letters, 2: only there an inserted code point counts.
    """
    length = F.size("prefixes") - 1
    whole = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(
        F.get("prefixes", i).alias("p"), F.get("suffixes", i).alias("s"), F.lit(0).alias("gap")))
    left_out = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(
        F.get("prefixes", i).alias("p"), F.get("suffixes", i + 1).alias("s"),
        F.when((i > 0) & (F.get("letters", i) == F.get("letters", i - 1)), 1).otherwise(2).alias("gap")))
    # Letters once as an array, as a long word would be searched again for each of them.
    split = numbered.withColumn("letters", F.split("word", ""))
    return split.select("id", "n", F.inline(F.concat(whole, left_out))).select("p", "s", "id", "n", "gap")


def neighbours(pairs: DataFrame) -> DataFrame:
    """``id, n_near, best``: number of near words and the one of largest n, the smallest id among equals.

    ``best`` is ``(n, -id)``.
    """
    member = F.struct("gap", "n", (-F.col("id")).alias("minus"))
    groups = pairs.groupBy("p", "s").agg(F.collect_list(member).alias("held")).where(F.size("held") > 1)
    # Replaced code points: all words with a gap. The two best of them serve every member.
    gapped = F.filter("held", lambda m: m["gap"] > 0)
    inserted = F.filter("held", lambda m: m["gap"] == 2)
    plain = F.filter("held", lambda m: m["gap"] == 0)
    value = lambda m: F.struct(m["n"].alias("n"), m["minus"].alias("minus"))
    ranked = lambda ms: F.reverse(F.array_sort(F.transform(ms, value)))
    groups = groups.select(
        "held", ranked(gapped).alias("gapped"), ranked(inserted).alias("inserted"), ranked(plain).alias("plain"),
    )
    rows = groups.select(F.inline("held"), "gapped", "inserted", "plain")
    own = F.struct(F.col("n"), F.col("minus"))
    other = F.when(F.get("gapped", F.lit(0)) == own, F.get("gapped", F.lit(1))).otherwise(F.get("gapped", F.lit(0)))
    shorter = F.get("plain", F.lit(0))
    count = (
        F.when(F.col("gap") == 0, F.size("inserted"))
        .when(F.col("gap") == 1, F.size("gapped") - 1).otherwise(F.size("gapped") - 1 + F.size("plain"))
    )
    best = (
        F.when(F.col("gap") == 0, F.get("inserted", F.lit(0)))
        .when(F.col("gap") == 1, other).otherwise(F.greatest(other, shorter))
    )
    return (
        rows.select((-F.col("minus")).alias("id"), count.alias("near"), best.alias("best")).where("near > 0")
        .groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """``id, root`` for every ``id, form``: the end of the chain of forms.

    Forms are more frequent than their words, so chains are short; each step doubles
    the part that is known.
    """
    current = store(forms.select("id", F.col("form").alias("root")), "spelling-roots").df
    while True:
        onward = current.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        step = store(
            current.join(onward, "root", "left").select("id", F.coalesce("_next", "root").alias("root"),
                                                        F.col("_next").isNotNull().alias("_moved")),
            "spelling-roots", totals={"moved": F.count_if("_moved")})
        current = step.df.drop("_moved")
        if not step.totals["moved"]:
            return current


def group_variants(documents: DataFrame, cfg: SpellingConfig = SpellingConfig()) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the documents."""
    numbered = written(numbered_words(words(documents, cfg)), "spelling-words")
    near = neighbours(node_pairs(numbered))
    named = numbered.select("id", "word")
    frequent = F.col("best.n") >= cfg.ratio * F.col("n")
    found = written(
        numbered.select("id", "word", "n").join(near, "id", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(frequent, -F.col("best.minus")).alias("form"), F.when(frequent, F.col("best.n")).alias("form_n")),
        "spelling-neighbours")
    ends = roots(found.where(F.col("form").isNotNull()).select("id", "form"))
    form_names = named.select(F.col("id").alias("form"), F.col("word").alias("_form"))
    root_names = named.select(F.col("id").alias("root"), F.col("word").alias("_root"))
    changed = ends.join(found.select("id", "form"), "id").join(form_names, "form").join(root_names, "root")
    return found.drop("form").join(changed.select("id", "_form", "_root"), "id", "left").select(
        "word", F.col("_form").alias("form"), F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
