"""Every operator against a brute-force version, and on nulls, empty texts, repeats and odd columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillrank.llm import (
    encoding, language, licenses, mixing, neighbours, quality, simhash, suffixes, tokencount, toxicity,
)

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "fp string, size string, _id string, spans string, anchor string, score string, n long, kept string")
EXTRA = ("x", "y", None, "z", "a", "b", 7, "k")

PROSE = [" ".join(f"w{(i * 7 + j * j) % 61}" for j in range(30 + i % 90)) for i in range(60)]
SHARED = "this long passage stands in several of the documents and is repeated word for word " * 6


def rows_for_tests():
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t)) for i, t in enumerate(PROSE)]
    rows += [(100 + i, f"start {i} " + SHARED + f" end {i}", "en", "s0", 1) for i in range(5)]
    rows += [(200, PROSE[3], "en", None, 1), (200, PROSE[3], "en", None, 1), (201, SHARED, None, "s1", None),
             (201, SHARED, None, "s1", None), (300, None, "en", "s1", None), (301, "", "de", "s2", 0),
             (301, "", "de", "s2", 0), (302, " \t\n", "de", "s2", 3), (303, "12 345 !!", None, "s2", 3),
             (None, "no id here " + SHARED, None, None, None), (None, None, None, None, None),
             (304, "Привет, мир! Ünïcödé 漢字 🙂 stupid\n" * 40, "en", "s9", 1), (305, "a" * 3000, "en", "s9", 1),
             (306, "long " + "".join(f"word{i % 1009} " for i in range(30_000)), "de", "s1", 1)]
    return [r + EXTRA for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_for_tests(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1 if i % 4 else 0, 1 if i % 5 == 0 else 0) for i in range(60)] + [(None, 1, 1), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def matched(result, docs, expected, names):
    """Rows as a multiset: those that ``expected(text)`` gives for every row."""
    got = Counter((r["doc_id"], *(r[n] for n in names)) for r in result.collect())
    want = Counter((i, *expected(t or "")) for i, t in texts(docs))
    assert got == want


def brute_base(text):
    words = SPACED.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(marked), failed)


def test_quality_base_rules(docs, labels):
    found = quality.judge_quality(docs, quality.fit_quality(docs, labels))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    matched(found, docs, brute_base, names)
    assert not found.where("base_failed and kept").count()


def test_quality_ratio_is_that_of_the_multinomials(spark):
    good = [(i, " ".join(f"g{(i + j) % 40}" for j in range(80))) for i in range(40)]
    junk = [(100 + i, " ".join(f"j{(i * j) % 35}" for j in range(80))) for i in range(40)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    cfg = quality.QualityConfig()
    model = quality.fit_quality(docs, labels, cfg)
    # Hash buckets hardly collide here, so the ratio can be counted with plain n-grams.
    trusted = {int(i) for i in quality.trusted_ids(labels, cfg.trusted_limit)[::2]}

    def grams(text):
        words = text.split()
        return words + list(zip(words, words[1:]))

    raw = Counter(g for _, t in good + junk for g in grams(t))
    fine = Counter(g for i, t in good if i in trusted for g in grams(t))
    total = {id(c): sum(c.values()) + cfg.smoothing * cfg.buckets for c in (raw, fine)}
    ratio = lambda g: np.log((fine[g] + cfg.smoothing) / total[id(fine)] / ((raw[g] + cfg.smoothing) / total[id(raw)]))
    rows = {r["doc_id"]: r for r in quality.judge_quality(docs, model, cfg).collect()}
    close = [abs(rows[i]["score"] - np.mean([ratio(g) for g in grams(t)])) < 0.05 for i, t in good + junk]
    assert np.mean(close) > 0.9
    assert all(rows[i]["kept"] for i, t in good if not rows[i]["base_failed"])
    assert not any(rows[i]["kept"] for i, _ in junk)


def test_quality_learns_from_all_trusted_documents(spark):
    """More of them than the 20,000 that were once taken."""
    docs = spark.range(20_400).select(
        F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda j: F.xxhash64("id", j)), " ").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    found = quality.fit_quality(docs, labels)
    every = quality.fit_quality(docs, labels, quality.QualityConfig(trusted_limit=30_000, broadcast_rows=0))
    assert (found.log_ratio == every.log_ratio).all() and found.threshold == every.threshold
    halves = {r["doc_id"]: r["fitted"] for r in quality.trusted_halves(labels).df.collect()}
    assert halves == {i: i % 2 == 0 for i in range(20_400)}


def test_quality_quantile_is_that_of_all_scores(spark):
    values = [(i * 37 % 101) / 7 for i in range(500)]
    scores = spark.createDataFrame([(v,) for v in values], "score double")
    for share in (0.0, 0.002, 0.3, 1.0):
        assert quality.low_quantile(scores, share) == pytest.approx(np.quantile(values, share), abs=1e-12)
    assert quality.low_quantile(scores.limit(0), 0.5) is None


def test_toxicity_learns_and_ignores_the_held_out_fold(spark):
    rude = ["stupid", "idiot", "trash"]
    rows, marks = [], []
    for i in range(600):
        words = [f"w{(i * 13 + j * j) % 211}" for j in range(40)]
        if i % 6 == 0:
            words[i % 40] = rude[i % 3].title() + ","
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    flipped = spark.createDataFrame(
        [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in marks], "doc_id long, toxic int"
    )
    model = toxicity.fit_toxicity(docs, labels)
    other = toxicity.fit_toxicity(docs, flipped)
    assert model[0] == other[0] and (model[1] == other[1]).all() and (model[2] == other[2]).all()
    assert len(model[1]) < 500  # L1 leaves few weights
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in marks)
    held = [i for i, _ in marks if found[i]["held_out"]]
    assert np.mean([found[i]["predicted"] == (i % 6 == 0) for i in held]) > 0.97


def test_learning_takes_one_text_per_id(spark):
    texts = [(i, f"{'bad vile' if i % 2 else 'kind calm'} words number{i} " * 20) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in texts], "doc_id long, quality int, toxic int")
    bias, numbers, weights = toxicity.fit_toxicity(docs, labels)
    again = toxicity.fit_toxicity(docs.union(docs).union(docs), labels)
    assert again[0] == bias and (again[1] == numbers).all() and (again[2] == weights).all()
    # Other texts under a labelled id add to the raw counts, and no second score to the threshold.
    more = docs.union(docs.where("doc_id = 0"))
    assert quality.fit_quality(more, labels) is not None


def test_toxicity_ftrl_step_by_step():
    cfg = toxicity.ToxicityConfig(bits=3, epochs=1, alpha=0.5, l1=0.1, l2=0.2)
    sets, marks = [np.array([1, 4]), np.array([1]), np.array([4, 5])], np.array([1.0, 0.0, 1.0])
    z, n = dict.fromkeys(range(9), 0.0), dict.fromkeys(range(9), 0.0)

    def weight(i):
        l1 = 0.0 if i == 8 else cfg.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((cfg.beta + n[i] ** 0.5) / cfg.alpha + cfg.l2)

    for features, label in zip(sets, marks):
        at = [*features, 8]
        old = {i: weight(i) for i in at}
        g = 1 / (1 + np.exp(-sum(old.values()))) - label
        for i in at:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / cfg.alpha * old[i]
            n[i] += g * g
    bias, weights = toxicity.train(sets, marks, cfg)
    assert np.allclose([*weights, bias], [weight(i) for i in range(9)])


def brute_repeats(all_texts, length):
    raw = [(t or "").encode() for _, t in all_texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        cover = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[: len(r)] > 0
        spans = int(np.sum(gone[1:] & ~gone[:-1])) + int(gone[:1].any())
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("cfg", [
    suffixes.RepeatConfig(), suffixes.RepeatConfig(length=60, seed=16, batches=5, run_windows=50, group_rows=1),
    suffixes.RepeatConfig(length=30, seed=30, batches=1),
])
def test_suffix_repeats(docs, cfg):
    some = docs.where("doc_id is null or doc_id != 306")
    got = Counter(tuple(r) for r in suffixes.cut_repeats(some, cfg).collect())
    every = texts(some)
    assert got == Counter((i, *want) for (i, _), want in zip(every, brute_repeats(every, cfg.length)))


def test_suffix_levels_merge_geometrically(spark, docs):
    cfg = suffixes.RepeatConfig(length=60, seed=16, batches=7)
    entries = suffixes.sparse_suffixes(docs, cfg).cache()
    family = suffixes.SuffixFamily(spark)
    ranks, found = [], []
    for number in range(7):
        if number == 4:  # taken up again by the folders of its levels
            family = suffixes.SuffixFamily(spark, family.levels)
        found.append(family.add(entries.where(f"batch = {number}")))
        ranks.append([rank for rank, _ in family.levels])
    assert ranks == [[0], [1], [1, 0], [2], [2, 0], [2, 1], [2, 1, 0]]

    # What the scans have found are the entries of the anchors that occur twice.
    held, marked = {}, set()
    for r in entries.collect():
        held.setdefault(r["anchor"], Counter())[r["content"]] += 1
        marked |= {r["anchor"]} if r["inside"] else set()
    want = {(a, c): (n, len(by)) for a, by in held.items() if sum(by.values()) > 1 or a in marked for c, n in by.items()}
    got = {(r["anchor"], r["content"]): (r["n"], r["contents"]) for r in suffixes.matched_entries(found).collect()}
    # An anchor that stays alone after its last scan keeps the number it had then.
    assert got.keys() == want.keys()
    assert all((got[k][0] > 1, got[k][1]) == (want[k][0] > 1, want[k][1]) for k in want)


def test_suffix_long_passages_across_documents(spark):
    rng = np.random.RandomState(4)
    words = [f"v{i}" for i in rng.randint(0, 10**6, 4000)]
    passages = [" ".join(words[i * 80 : i * 80 + 80]) for i in range(12)]
    assert all(len(p) > 400 for p in passages)
    rows = []
    for i in range(80):
        own = [f"u{x}" for x in rng.randint(0, 10**9, 200)]
        rows.append((i, " ".join(own[:100]) + " " + (passages[i % 12] + " " if i < 40 else "") + " ".join(own[100:])))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = Counter(tuple(r) for r in suffixes.cut_repeats(table).collect())
    assert got == Counter((i, *want) for (i, _), want in zip(rows, brute_repeats(rows, 400)))
    assert all((r[2] >= len(passages[r[0] % 12])) == (r[0] < 40) for r in got)


def test_suffix_cut_texts_keep_columns(docs):
    kept = suffixes.without_repeats(docs)
    assert kept.columns == docs.columns
    rows = {r["doc_id"]: r for r in kept.where("doc_id < 200 and doc_id >= 100").collect()}
    assert rows[101]["text"] == "start 1 end 1".replace("1 end", "1  end") or "this long" not in rows[101]["text"]
    assert rows[101]["n_chars"] == len(rows[101]["text"]) and rows[101]["anchor"] == "a"


def brute_fingerprint(text):
    words = SPACED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints_and_components(docs):
    rows = simhash.near_duplicates(docs).collect()
    want = {(i, t): brute_fingerprint(t or "") for i, t in texts(docs)}
    assert Counter((r["doc_id"], r["fp"] % 2**64) for r in rows) == Counter(
        (i, want[i, t]) for i, t in texts(docs))
    least = {}
    for (i, _), fp in want.items():
        if i is not None:
            least[fp] = min(i, least.get(fp, i))
    assert all(r["component_id"] <= least.get(r["fp"] % 2**64, 0) or r["doc_id"] is None for r in rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r["component_id"] for r in rows})


@pytest.mark.parametrize("task_rows", [5, 40, 20_000])
def test_simhash_trie_join_finds_all_links(spark, task_rows):
    rng = np.random.RandomState(3)
    values = set()
    for centre in rng.randint(0, 2**62, 12).tolist() + [0]:
        values.add(centre)
        for _ in range(30):
            v = centre
            for bit in rng.randint(0, 64, rng.randint(0, 5)).tolist():
                v ^= 1 << bit
            values.add(v)
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), simhash.SimHashConfig(task_rows=task_rows))
    root = {r["node"] % 2**64: r["root"] for r in simhash.components(edges).collect()}
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    got, want = {}, {}
    for i, v in enumerate(values):
        got.setdefault(root.get(v, signed[i]), set()).add(v)
        want.setdefault(find(i), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 500)]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain + star, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 500)}}


def brute_targets(sizes, weights, share, cap):
    """Resharing of the excess until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > cap * sizes[s]]
        if not over:
            return {**fixed, **{s: rest * weight[s] / w for s in free}}
        fixed.update({s: cap * sizes[s] for s in over})


def test_mixing(docs):
    # Without the one text that is longer than all others of its source together.
    docs = docs.where("doc_id is null or doc_id != 306")
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for r in docs.select("source", "text").collect():
        sizes[r["source"]] += len(SPACED.findall(r["text"] or ""))
    want = brute_targets(sizes, (3, 1, 2), 1.5, 2)
    assert len(rows) == docs.count()
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(30, 0.01 * want[s])
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    mixed = mixing.take(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in rows)


def test_mixing_budget_is_met_exactly_where_it_can_be():
    rng = np.random.RandomState(1)
    for _ in range(40):
        lengths = np.unique(rng.randint(1, 60, 7))
        counts = rng.randint(1, 5, len(lengths))
        budget = int(rng.randint(1, (lengths * counts).sum() + 1))
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = mixing._knapsack(lengths, counts, budget)
        assert (got <= counts).all()
        assert abs(int((got * lengths).sum()) - budget) == min(abs(s - budget) for s in sums if s <= 2 * budget)
    for case in range(400):  # whole sources of 1 to 30 documents
        sizes = rng.randint(1, 10 ** int(rng.randint(1, 4)) + 1, int(rng.randint(1, 31)))
        lengths, counts = np.unique(sizes, return_counts=True)
        budget = int(rng.randint(0, sizes.sum() + 1))
        sums = {0}
        for n in sizes.tolist():
            sums |= {s + n for s in sums}
        got = mixing.fit_counts(lengths, counts, budget, 20_000)
        assert (got <= counts).all()
        assert abs(int((got * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)
    lengths, counts = np.arange(1, 400), np.full(399, 50)
    for budget in (7, 12_345, 1_000_003, 3_990_000):
        got = mixing.fit_counts(lengths, counts, budget, 20_000)
        assert (got <= counts).all() and int((got * lengths).sum()) == min(budget, int((lengths * counts).sum()))


def brute_phrases(text):
    words = licenses.words_of(text)
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return (len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))


def test_license_phrases(spark, docs):
    more = ["CC-BY cc by, CC BY", "GNU General\nPublic License; all rights reserved All rights all rights reserved", "cc cc by",
            "general public public license general public license", "Cc by general public"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(more)], "doc_id long, text string")
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels"]
    for table in (rows, docs):
        matched(licenses.scan_licenses(table), table, brute_phrases, names)


def test_license_templates_are_found_when_reworded(spark):
    mit = licenses.TEMPLATES["mit"]
    half = mit.replace("free of charge, ", "").replace("including without limitation ", "incl. ")
    rows = [(1, "x " * 50 + mit + " y" * 50), (2, half), (3, " ".join(mit.split()[:8])), (4, "Permission is granted")]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["labels"] == "mit" and found[1]["score"] == 1.0
    span = found[1]["spans"][0]
    assert (span["first"], span["stop"]) == (50, 50 + len(licenses.words_of(mit)))
    assert found[2]["labels"] == "mit" and 0.6 < found[2]["score"] < 1
    assert found[3]["labels"] == "" and found[4]["labels"] == ""


def test_license_matching_statistics():
    automaton = licenses.LicenseAutomaton()
    every = [licenses.words_of(t) for t in [*licenses.TEMPLATES.values(), *licenses.PHRASES]]
    text = licenses.words_of(licenses.TEMPLATES["isc"] + " the rights to use copy modify " + " ".join(licenses.TEMPLATES["bsd"].split()[3:15]))
    _, matches = automaton.stream([automaton.vocabulary[w] for w in text], 0, 1)
    ends = {a + n: n for a, n, _ in matches}
    grams = {tuple(t[i : i + n]) for t in every[: len(licenses.TEMPLATES)] for i in range(len(t)) for n in range(1, len(t) - i + 1)}
    for stop, size in ends.items():
        assert tuple(text[stop - size : stop]) in grams
        assert stop == len(text) or tuple(text[stop - size : stop + 1]) not in grams


def test_token_counts_equal_the_library(docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    count = lambda t: (len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 4096)
    rows = tokencount.count_tokens(docs)
    matched(rows, docs, count, ["n_bytes", "n_tokens", "over_limit"])
    cut = {r["doc_id"]: r["fit_bytes"] for r in tokencount.count_tokens(docs, limit=40).collect()}
    for i, t in texts(docs):
        if i is not None and t and len(model.encode(t)) > 40:
            part = t.encode()[: cut[i]].decode()
            assert len(model.encode(part)) <= 40
            assert len(model.encode(t[: len(part) + 25])) > 40


def test_token_counts_of_every_prefix():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, counter = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.PrefixCounter(path)
    for word in ("internationalisation", "aaaaaaaaaaaaaaab", "漢字🙂naïveté", "x\n\ty", "<s></s><unk>", "0000000000"):
        assert counter.prefixes("▁" + word)[2:] == [len(model.encode(word[:i])) for i in range(1, len(word) + 1)]


def test_codec_equals_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def digests(text):
        ids = library.encode(text, add_special_tokens=False).ids
        plain = library.decode(ids, skip_special_tokens=False)
        return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest())

    odd = ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "don't  we'll\r\n\n \t x", "\x00\x7f", "🙂🙂 ́e", "ab" * 900, "I'VE 12345 ½"]
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    for table in (spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), docs):
        matched(encoding.encode_documents(table), table, digests, names)


def test_codec_round_trip(docs):
    import public_tokenizers

    codec = encoding.BytePairCodec(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(codec.decode(codec.encode(t or "")) == (t or "") for _, t in texts(docs))


def test_language(spark):
    words = {"en": "the and with this that have".split(), "de": "der und nicht auch eine über".split(), "fr": "les avec était être pour ça".split()}
    rng = np.random.RandomState(0)
    rows = [(i, " ".join(rng.choice(words[k], 25)), k) for i, k in enumerate(list(words) * 60)]
    odd = [(900, None, "en"), (901, "", "en"), (902, "123 !?", "de"), (903, "привет", None), (None, "the and that", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = language.fit_language(docs)
    assert model.names == ["de", "en", "fr"]
    found = {r["doc_id"]: r for r in language.identify_language(docs, model).collect()}
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert all(found[i]["lang_pred"] == k for i, _, k in rows)
    assert [found[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and found[903]["lang_pred"] != "und"
    changed = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 'xx', lang) lang")
    again = language.fit_language(changed)
    assert (again.log_prob == model.log_prob).all()
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and not kept.where("doc_id in (900, 901, 902)").count()


def test_language_scores_by_plain_counting(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([("abc ab", "x"), ("abd", "x"), ("bcd bcd", "y")] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    cfg = language.LanguageConfig()
    model = language.fit_language(docs, cfg)
    grams = lambda t: [t[i : i + n] for n in cfg.sizes for i in range(len(t) - n + 1)]
    learned = [(t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    count = {k: Counter(g for t, l in learned if l == k for g in grams(t)) for k in "xy"}
    size = {k: sum(c.values()) + cfg.smoothing * cfg.buckets for k, c in count.items()}
    logit = {k: np.log(sum(l == k for _, l in learned) / len(learned)) + sum(
        np.log((count[k][g] + cfg.smoothing) / size[k]) for g in grams("abc ab")) for k in "xy"}
    want = 1 / (1 + np.exp(logit["y"] - logit["x"]))
    got = next(r for r in language.identify_language(docs, model).collect() if r["doc_id"] == 0)
    assert got["lang_pred"] == "x" and got["score"] == pytest.approx(want, rel=1e-6)


def vectors(n, d=12, seed=5):
    rng = np.random.RandomState(seed)
    return [(i, rng.standard_normal(d).astype(np.float32).tolist()) for i in range(n)]


def brute_nearest(rows, k, every):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for q in sorted({i for i in ids.tolist() if i % every == 0}):
        score = neighbours.inner_products(x, x[int(np.flatnonzero(ids == q)[0])])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found_nearest(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def test_neighbours_exact_when_every_file_is_read(spark):
    rows = vectors(400)
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # many copies: ties go to the smaller id
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    cfg = neighbours.PermutationConfig(pivots=16, posts=4, probes=16, share=1.0, part_rows=50, part_queries=7)
    assert found_nearest(neighbours.nearest(table, cfg)) == brute_nearest(rows, 20, 20)


def test_neighbours_recall(spark):
    rows = vectors(6000, 64)
    found = found_nearest(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    want = brute_nearest(rows, 20, 20)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_neighbours_footrule():
    a, b = neighbours.places(np.array([[2, 0, 1, 3]])), neighbours.places(np.array([[0, 1, 2, 3], [2, 0, 1, 3]]))
    assert neighbours.footrule(a[0], b).tolist() == [1 + 1 + 2 + 0, 0]


def test_neighbours_odd_rows(spark):
    rows = vectors(9) + [(20, None), (40, [0.0] * 12), (60, [float("nan")] * 12), (80, [None] * 12), (100, [1.0] * 5), (None, [1.0] * 12)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, v int")
    assert found_nearest(neighbours.nearest(table)) == brute_nearest(vectors(9), 20, 20)
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_empty_tables(spark, empty, labels):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge_quality(empty, quality.fit_quality(empty, labels)).count() == 0
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, none)).count() == 0
    assert suffixes.cut_repeats(empty).count() == 0 and suffixes.without_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.take(empty).count() == 0
    assert licenses.scan_licenses(empty).count() == 0 and tokencount.count_tokens(empty).count() == 0
    assert language.identify_language(empty, language.fit_language(empty)).count() == 0
    assert encoding.encode_documents(empty).count() == 0


def test_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    judged = quality.judge_quality(docs, quality.fit_quality(docs, none))
    assert not judged.where("kept = base_failed").count()
    assert {r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).collect()} == {0.0}


def test_long_words_are_not_kept():
    """What a task keeps of an unspaced script is bounded in bytes; its counts and ids equal the libraries'."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["語" * n + "文" * (n % 7) for n in range(1, 400, 13)]
    texts += [f"short {'x' * (n + 1)} und {t}" for n, t in enumerate(texts)] * 2
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, counter = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.PrefixCounter(path)
    units = sorted({u.encode() for t in texts for u in (" " + p for p in t.split(" "))})
    assert counter.unit_counts(units).tolist() == [len(model.encode(u.decode()[1:])) for u in units]
    assert max(map(len, counter.known)) <= tokencount.LONGEST_KEPT < max(map(len, units))

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, codec = Tokenizer.from_file(path), encoding.BytePairCodec(path)
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == expected
    assert max(map(len, codec.known)) <= encoding.LONGEST_KEPT
