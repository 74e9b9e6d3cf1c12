"""Vector codes, packing and spelling variants against brute force and the tokenizer library."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from test_operators import SCHEMA, docs, empty  # noqa: F401  fixtures

from quillrank.llm import codebooks, packing, queries, spelling
from quillrank.llm.encoding import vocabulary_path

# ---------------------------------------------------------------- vector codes

VECTORS = "vec_id long, embedding array<double>, label int, code string, error string, ints int, sums long"


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    ints = np.floor(np.array([r[1] for r in kept]) * 4096).astype(np.int64)
    cut = ints.reshape(len(kept), parts, -1)
    books = cut[:entries].transpose(1, 0, 2).copy()

    def assign():
        distance = ((cut[:, :, None, :] - books[None]) ** 2).sum(-1)
        return distance.argmin(-1), distance.min(-1)

    for _ in range(rounds):
        index, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = cut[index[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    index, distance = assign()
    errors = distance.sum(1)
    by_label = Counter()
    for r, e in zip(kept, errors):
        by_label[r[2]] += int(e)
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    return Counter((r[0], "".join(f"{i:02x}" for i in row), int(e), by_label[r[2]], digest)
                   for r, row, e in zip(kept, index, errors))


def vector_rows(n=700, width=64, seed=3):
    rng = np.random.RandomState(seed)
    centres = rng.normal(size=(9, width))
    rows = []
    for i in range(n):
        v = centres[i % 9] * 0.2 + rng.normal(size=width) * (0.02 if i % 2 else 0.2)
        rows.append((i * 3 % 2100, v.astype(np.float32).astype(float).tolist(), None if i % 7 == 0 else i % 4))
    rows += [rows[5], rows[5], (None, rows[9][1], 2), (9000, None, 1), (9001, [1.0] * (width - 1) + [None], 1),
             (9002, [float("nan")] * width, 1), (9003, [float("inf")] + [0.0] * (width - 1), 2), (9004, [], 1),
             (9005, [0.5] * 8, 1), (9006, [0.0] * width, None)]
    return rows


def coded(spark, rows):
    table = spark.createDataFrame([r + ("x", "y", 1, 2) for r in rows], VECTORS).repartition(5)
    found = codebooks.code_vectors(table).collect()
    return Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in found)


def test_codes_equal_full_scans(spark):
    rows = vector_rows()
    assert coded(spark, rows) == brute_codes(rows)


def test_codes_of_few_tied_and_no_rows(spark, monkeypatch):
    few = [(i, [float(i % 2)] * 16, None) for i in range(6)]  # entries twice: ties go to the lower index
    assert coded(spark, few) == brute_codes(few)
    assert coded(spark, []) == Counter()
    assert coded(spark, [(1, None, 1)]) == Counter()
    monkeypatch.setattr(codebooks, "_SMALL", 0)  # the join that spreads labels
    rows = vector_rows(60)
    assert coded(spark, rows) == brute_codes(rows)
    with pytest.raises(Exception, match="too large"):
        coded(spark, [(1, [1e9] * 8, 1)])


def test_resting_parts_compare_moved_entries_only(monkeypatch):
    rng = np.random.RandomState(1)
    points = rng.randint(-50, 50, (400, 4)).astype(np.int64)
    book = rng.randint(-50, 50, (16, 4)).astype(np.int64)
    held, distance = codebooks.scan_entries(points, book, np.arange(16))
    following, moved = book.copy(), np.zeros(16, bool)
    following[[2, 7, 11]] = rng.randint(-50, 50, (3, 4))
    moved[[2, 7, 11]] = True
    looked = []
    scan = codebooks.scan_entries
    monkeypatch.setattr(codebooks, "scan_entries", lambda p, b, w: looked.append((len(p), len(w))) or scan(p, b, w))
    got = codebooks.assign_part(points, following, moved, held, distance)
    want = scan(points, following, np.arange(16))
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    again = int(moved[held].sum())
    assert looked == [(again, 16), (400 - again, 3)]


# ---------------------------------------------------------------- packing


def least_sequences(items, capacity):
    """Exact number by search over sequences that hold the largest piece."""
    seen = {}

    def solve(rest):
        if not rest:
            return 0
        if rest not in seen:
            first, others, best = rest[-1], rest[:-1], 99
            for size in range(len(others) + 1):
                for chosen in set(combinations(others, size)):
                    if first + sum(chosen) <= capacity:
                        left = Counter(others)
                        left.subtract(chosen)
                        best = min(best, 1 + solve(tuple(sorted(left.elements()))))
            seen[rest] = best
        return seen[rest]

    return solve(tuple(sorted(items)))


def counts_of(items, capacity):
    counts = [0] * (capacity + 1)
    for n in items:
        counts[n] += 1
    return counts


def test_reduction_keeps_the_optimum():
    rng = np.random.RandomState(5)
    reduced = 0
    for case in range(250):
        capacity = int(rng.randint(6, 30))
        low = max(1, capacity // int(rng.randint(2, 6)))
        items = rng.randint(low, capacity + 1, int(rng.randint(1, 9))).tolist()
        fixed, rest = packing.reduce_counts(counts_of(items, capacity), capacity)
        left = [n for n, k in enumerate(rest) for _ in range(k)]
        assert sum(r.times for r in fixed) + least_sequences(left, capacity) == least_sequences(items, capacity)
        reduced += len(left) < len(items)
    assert reduced > 100


def naive_best_fit(items, capacity):
    rooms = []
    for n in sorted(items, reverse=True):
        fitting = [i for i, r in enumerate(rooms) if r >= n]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_best_fit_on_counts_equals_one_piece_at_a_time():
    rng = np.random.RandomState(6)
    for case in range(200):
        capacity = int(rng.randint(5, 80))
        items = rng.randint(1, capacity + 1, int(rng.randint(0, 120))).tolist()
        runs = packing.best_fit(counts_of(items, capacity), capacity)
        rooms = sorted(r for run in runs for r in [capacity - sum(n * k for n, k in run.content)] * run.times)
        assert rooms == naive_best_fit(items, capacity)
        held = Counter()
        for run in runs:
            for n, k in run.content:
                held[n] += k * run.times
        assert held == Counter(items)


def test_plan_of_many_pieces_stays_small():
    rng = np.random.RandomState(7)
    counts = [0, *(rng.randint(0, 10**9, 1024) // np.arange(1, 1025)).tolist()]
    runs = packing.plan_runs(counts, 1024)
    assert len(runs) < 6000
    total = sum(n * k for n, k in enumerate(counts))
    assert -(-total // 1024) <= sum(r.times for r in runs) < 1.001 * total / 1024 + 1


def packed_by_library(rows):
    from tokenizers import Tokenizer

    library, out = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json")), []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        at, piece = 0, 0
        while at < len(ids):
            end = at + ((len(ids) - at - 1) % 1024 + 1 if piece == 0 else 1024)
            part = np.array(ids[at:end], "<u4").tobytes()
            out.append((doc_id, piece, at, end - at, zlib.crc32(part)))
            at, piece = end, piece + 1
    return Counter(out)


def check_places(found):
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by_sequence)


def test_packing(spark, docs, empty):  # noqa: F811
    extra = [(800 + i, "word " * (i * 37 % 2600)) for i in range(150)]
    extra += [(990, "<|endoftext|> a<|endoftext|>"), (991, "x" + " " * 1_500_000 + "y")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).repartition(6)
    found = packing.pack_documents(table.withColumn("_task", table["text"])).collect()
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    want = packed_by_library([(r["doc_id"], r["text"]) for r in table.collect()])
    assert Counter(tuple(r[n] for n in names) for r in found) == want
    sequences, tokens = check_places(found), sum(r["length"] for r in found)
    assert sequences <= 1.05 * tokens / 1024 + 1
    assert packing.pack_documents(empty).collect() == []


def test_packing_query_reads_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op12_best_fit_packing(spark, sf).collect()
    assert {r["doc_id"] for r in found} == {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sequences, tokens = check_places(found), sum(r["length"] for r in found)
    assert sequences <= 1.01 * tokens / 1024 + 1


# ---------------------------------------------------------------- spelling


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    # Words that are equal without some code point, kept apart by length and place.
    near = {w: set() for w in n}
    gaps = {}
    for w in n:
        for i in range(len(w)):
            gaps.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    for held in gaps.values():
        for a in held:
            near[a] |= held - {a}
    for w in n:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def variants(table):
    names = ("word", "form", "root", "n", "n_near", "form_n")
    return Counter(tuple(r[c] for c in names) for r in spelling.group_variants(table).collect())


def spelling_rows():
    rng = np.random.RandomState(8)
    base = ["abcdefgh", "aaaaaaaa", "abababab", "spelling", "straßenfest", "déjàvuwort", "zzzzzzzzz", "prefixes"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(40):
            w = base[min(int(rng.exponential(2)), len(base) - 1)]
            for _ in range(rng.choice(3, p=[0.75, 0.2, 0.05])):
                at, kind = rng.randint(len(w)), rng.randint(3)
                letter = "abcdßé"[rng.randint(6)]
                w = w[:at] + (letter if kind else "") + w[at + (kind != 1) :]
            words.append(w.upper() if rng.rand() < 0.1 else w)
        rows.append((i, " ".join(words) + " 1-2"))
    long = "".join("abcde"[i * i % 5] for i in range(30_000))
    return rows + [(None, "nothing nothing"), (None, "nothing nothing"), (5, None), (6, ""), (7, rows[3][1]), (7, rows[3][1]),
                   (8, f"{long} {long}"), (9, f"{long}x {long}x {long[:-1]} {long[:-1]}")]


def test_variants_equal_brute_force(spark, monkeypatch):
    rows = spelling_rows()
    table = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows],
                                  "doc_id long, text string, word string, n long, id string, nodes long").repartition(7)
    want = brute_variants(rows)
    assert len([w for w in want if w[1]]) > 100 and any(w[1] and w[1] != w[2] for w in want)
    assert variants(table) == want
    # Many short ranges, whose paths go on from one to the next, and counts passed on early.
    monkeypatch.setattr(spelling, "bucket_count", lambda spark: 40)
    monkeypatch.setattr(spelling, "_HELD_CHARACTERS", 1000)
    assert variants(table) == want


def test_variants_of_real_and_empty_tables(spark, empty):  # noqa: F811
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert variants(table) == brute_variants([(r["doc_id"], r["text"]) for r in table.collect()])
    assert variants(empty) == Counter()


def test_nodes_are_equal_where_prefixes_are(spark, monkeypatch):
    monkeypatch.setattr(spelling, "bucket_count", lambda spark: 25)
    rng = np.random.RandomState(9)
    words = sorted({"".join(rng.choice(list("ab"), rng.randint(1, 12))) for _ in range(400)})
    rows = spelling.trie_nodes(spark.createDataFrame([(w, 1) for w in words], "word string, n int"), "word").collect()
    node = {}
    for r in rows:
        assert len(r["nodes"]) == len(r["word"])
        for i, number in enumerate(r["nodes"], 1):
            assert node.setdefault(r["word"][:i], number) == number
    assert len(set(node.values())) == len(node)
    ends = sorted((r["word"], r["nodes"][-1]) for r in rows)
    assert [n for _, n in ends] == sorted(n for _, n in ends)
