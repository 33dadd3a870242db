"""Near copies, benchmark passages, fingerprints and the pipeline."""

import cProfile
import hashlib
import importlib
import pstats
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from turfgrid.llm import decontamination, graph, ngram_join, spotsigs

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, component_id string, n string, part int"


def brute(docs, settings):
    """Component of every id by all pairs that share an n-gram."""
    sets = {}
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = settings.words
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    of = {i: i for i in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            shared = len(sets[a] & sets[b]) if a < b else 0
            if shared and settings.of * shared >= settings.least * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_a_word_may_hold_the_character_0():
    from turfgrid.llm import text as T

    texts = ["a\x00b", "ab", "a\x00", "a", "\x00", "\x00\x00"]
    hashes = [T.hashed_words(t, T.spaced).tolist() for t in texts]
    assert all(len(h) == 1 for h in hashes) and len({h[0] for h in hashes}) == len(texts)


def copies(seed, groups=12, size=14, words=60):
    draw, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of", "THE", "Of"]
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(draw.randrange(3, words))]
        for _ in range(draw.randrange(1, size)):
            text = [w if draw.random() > 0.02 else draw.choice(vocabulary) for w in base]
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("settings", [ngram_join.Settings(), ngram_join.Settings(words=4, least=85), ngram_join.Settings(words=3, least=60, block=3, frequent=4, together=2), ngram_join.Settings(words=2, least=50, block=2)])
def test_components_equal_brute_force(spark, settings):
    rows = copies(settings.least) + [(900, None), (901, ""), (902, " \n "), (903, "one"), (904, "ONE"), (905, "one two"), (906, "x " * 40_000)]
    docs = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], DOCS)
    found = ngram_join.join(docs, settings).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, settings) and len(found) == len(rows)


@pytest.mark.parametrize("least", [80, 85])
def test_tails_after_frequent_texts(spark, least):
    """The n-grams of a text in many copies come last, so a unique tail fills the prefix of the longer set."""
    draw, rows = random.Random(least), []
    for group in range(6):
        base = [f"b{group}x{draw.randrange(10_000)}" for _ in range(draw.randrange(60, 160))]
        rows += [(len(rows) + i, " ".join(base)) for i in range(40)]
        for percent in range(5, 26):
            tail = [f"t{group}x{percent}x{i}" for i in range(len(base) * percent // 100)]
            rows.append((len(rows), " ".join(base + tail)))
    settings = ngram_join.Settings(least=least)
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS)
    found = ngram_join.join(docs, settings).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, settings)


def test_trie_keeps_every_link():
    settings = ngram_join.Settings(words=1, least=70)
    draw = random.Random(9)
    for _ in range(40):
        sets = [sorted(draw.sample(range(40), draw.randrange(1, 25))) for _ in range(12)]
        for gram in range(40):
            rows = []
            for i, s in enumerate(sets):
                prefix = s[: settings.prefix(len(s))]
                if gram in prefix:
                    place = prefix.index(gram)
                    rows.append((i, i, len(s), place, tuple(prefix[place + 1 :])))
            if rows:
                root = ngram_join.build_trie(rows)
                for q in rows:
                    found = set(ngram_join.walk_trie(root, q, settings))
                    for other in rows:
                        x, y = set(sets[q[0]]), set(sets[other[0]])
                        if q[0] != other[0] and min(x & y) == gram and 100 * len(x & y) >= 70 * len(x | y):
                            assert other[0] in found


def test_join_of_odd_tables(spark):
    text = "a b c d e f g"
    rows = [(1, text), (1, text), (2, text), (2, "h i j k l m"), (None, text), (None, None), (3, "h i j k l m")]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()), key=str)
    # the id with two texts ties their copies together
    assert found == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (2, 2, 1), (None, 3, 1), (None, 0, None), (3, 2, 1)], key=str)
    assert ngram_join.join(docs.limit(0)).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None", "None"]


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(300, 300)]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def edits(window, text):
    """Least edits of the window against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def plain(text):
    return "".join(c for c in (text or "").lower() if c.isalpha() or c.isdigit())


def verbatim(item, text, words=13, shortest=24):
    """Whether the text has `words` words of the item on end, or all of a shorter one, between word ends if it is very short."""
    found = ["".join(run) for run in re.findall(r"[^\W_]+", item.lower())]
    if len("".join(found)) < shortest:
        return f" {' '.join(found)} " in f" {' '.join(re.findall(r'[^\W_]+', text.lower()))} "
    count = min(words, len(found))
    return any("".join(found[i : i + count]) in plain(text) for i in range(len(found) - count + 1))


def test_short_shared_runs_cost_no_call_each():
    draw = np.random.default_rng(9)
    words = ["".join(draw.choice(list("abcdefghijkl"), draw.integers(1, 9))) for _ in range(400)]
    items = [(i, " ".join(draw.choice(words, size))) for i, size in enumerate([3, 40, 12, 13, 200])]
    index = decontamination.build(items, decontamination.Settings())
    number = draw.integers(0, len(items), 3_000)
    start = np.array([draw.integers(0, index.texts[n].points.size) for n in number])
    end = start + draw.integers(0, 90, number.size)
    plain = []
    for n, a, b in zip(number, start, end, strict=True):
        item = index.texts[n]
        plain.append(np.count_nonzero(item.ends <= b) - np.count_nonzero(item.begins < a) >= min(13, item.begins.size))
    assert index.hold(number, start, end).tolist() == plain
    # 3,000 runs of shared letters, none of which holds all three words
    shared = decontamination.build([(1, "some lovely words")], decontamination.Settings())
    calls = cProfile.Profile()
    found = calls.runcall(decontamination.matches_of, "lovely words zzz " * 3_000, shared)
    assert not found and pstats.Stats(calls).total_calls < 3_000


def test_every_passage_of_thirteen_words_is_found():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(1, 9)))
    item = [word() for _ in range(60)]
    index = decontamination.build([(7, " ".join(item))], decontamination.Settings())
    around = lambda: " ".join(word() for _ in range(40))
    for length in (8, 13, 14, 20, 25, 35, 60):
        for start in range(0, 60 - length + 1):
            passage = item[start : start + length]
            text = f"{around()}, {'; '.join(passage).upper()}. {around()}"
            found = decontamination.matches_of(text, index)
            if length >= 13:
                one, two, edits, _ = found[7]
                assert edits == 0 and plain("".join(passage)) in plain(text[one:two])
            else:
                assert not found


def test_short_items_stand_between_word_ends():
    items = [(1, "What is the capital of"), (2, "Oslo"), (3, "a b"), (4, "42"), (5, ""), (6, "?!"), (7, "é")]
    index = decontamination.build(items, decontamination.Settings())
    ids = lambda text: set(decontamination.matches_of(text, index))
    assert ids("Tell me: WHAT is the\ncapital of Norway") == {1}
    assert ids("somewhat is the capital of") == set() and ids("what is the capital offer") == set()
    assert ids("Oslo") == {2} and ids("in oslo.") == {2} and ids("Oslos") == set()
    assert ids("grab a-b now") == {3} and ids("a bc") == set() and ids("ab") == {3}
    assert ids("142") == set() and ids("(42)") == {4} and ids("É") == {7} and ids("") == set()


def test_passages_over_the_ends_of_pieces(monkeypatch):
    draw = random.Random(8)
    item = ["".join(draw.choice("abcdefghij") for _ in range(draw.randrange(1, 9))) for _ in range(30)]
    index = decontamination.build([(7, " ".join(item)), (8, "what is this")], decontamination.Settings())
    monkeypatch.setattr(decontamination.T.pieces, "__defaults__", (90,))
    for lead in range(0, 240, 3):
        text = "x " * lead + " ".join(item[4:17]) + " y" * 200 + " what is this " + "z " * 60
        assert set(decontamination.matches_of(text, index)) == {7, 8}
        assert set(decontamination.matches_of("x " * lead + "somewhat is this" + " z" * 90, index)) == set()


def test_leaks_equal_brute_force(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(draw.randrange(8, 30))).capitalize() + ".") for i in range(8)]

    def damaged(text, rate):
        return "".join(draw.choice(["", "x", c + "y"]) if draw.random() < rate else c for c in text)

    rows = [(i, " ".join(word() for _ in range(60))) for i in range(12)]
    rows += [(100 + i, f"{word()} {word()} {damaged(draw.choice(items)[1], rate)} {word()}") for i, rate in enumerate([0, 0.02, 0.05, 0.08, 0.12, 0.2, 0.3] * 2)]
    rows += [(200, None), (201, ""), (202, "?!"), (203, "lead " * 30_000 + items[0][1].upper().replace(" ", " *** ")), (None, items[1][1]), (0, rows[0][1])]
    settings = decontamination.Settings()
    docs = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], DOCS)
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "short"), (None, "none " * 20)], "item_id bigint, text string")
    found = decontamination.find(docs, bench).collect()
    index = decontamination.build(items, settings)
    want = set()
    for doc, text in rows:
        if doc == 203:
            want.add((203, 0))
            continue
        want |= {(doc, index.items[k]) for k, w in enumerate(index.windows) if edits([chr(c) for c in w], plain(text)) <= index.budgets[k]}
        want |= {(doc, i) for i, item in items if verbatim(item, text or "")}
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 8
    span = next(r for r in found if r.doc_id == 203)
    text = dict(rows)[203]
    assert plain(text[span.text_start : span.text_end]) == plain(items[0][1])
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in {x for x, _ in want})
    small = decontamination.Settings(block=200)
    assert {(r.doc_id, r.item_id) for r in decontamination.find(docs, bench, small).collect()} == want
    assert decontamination.find(docs, bench.limit(0)).count() == 0 and decontamination.clean(docs.limit(0), bench).count() == 0


def test_edited_texts(spark):
    rows = [(5, "The house of the rising sun and the moon were near the old river bank"), (1, ""), (9, None), (7, "é"), (3, "to be or not to be that is the question asked by men of old"), (7, "a" * 60_000), (None, "last one of the rows")]
    docs = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], DOCS)
    found = spotsigs.with_edits(docs).collect()
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0], r[1]))
    want = []
    for k, (doc, text) in enumerate(ordered):
        after, half = ordered[(k + 1) % len(ordered)][1], len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        sets = [spotsigs.signatures(x) for x in (text, changed, after)]
        want.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), spotsigs.fingerprint(sets[0]), spotsigs.fingerprint(sets[1]), spotsigs.likeness(*sets[:2]), spotsigs.likeness(sets[0], sets[2])))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert spotsigs.with_edits(docs.limit(0)).count() == 0
    one = spotsigs.with_edits(docs.limit(1)).first()
    assert one.near_next == 1.0


def test_parts_meet_at_their_ends(spark, monkeypatch):
    docs = spark.createDataFrame([(i * i, f"text {i} of the long row of many rows") for i in range(60)], "doc_id bigint, text string")
    whole = sorted(map(tuple, spotsigs.with_edits(docs).collect()))
    monkeypatch.setattr(spotsigs.in_parts, "__defaults__", (False, 7))
    assert sorted(map(tuple, spotsigs.with_edits(docs).collect())) == whole


def test_signatures_chain_content_words():
    assert spotsigs.signatures("").size == 0 and spotsigs.fingerprint(spotsigs.signatures(None)) == ""
    assert spotsigs.signatures("the red fox runs").size == 1
    assert (spotsigs.signatures("The red fox, runs!") == spotsigs.signatures("the red fox runs")).all()
    assert spotsigs.signatures("red fox runs").size == 1 and spotsigs.likeness(spotsigs.signatures("red fox runs"), spotsigs.signatures("red fox ran")) == 0


def test_similar_fingerprints_equal_brute_force(spark):
    rows = copies(3, words=80) + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    classes = {}
    for i, t in rows:
        found = spotsigs.signatures(t)
        if found.size:
            classes.setdefault(found.tobytes(), (i, found))
    want = {(min(a, b), max(a, b)) for a, x in classes.values() for b, y in classes.values() if a < b and spotsigs.likeness(x, y) >= 0.5}
    assert {(r.a, r.b) for r in spotsigs.near_duplicates(docs, 0.5).collect()} == want


def test_pipeline_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    ids = {}
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns
        ids[name] = [r.doc_id for r in after.select("doc_id").collect()]
        kept = pipeline.written(after, name)
    groups = defaultdict(list)
    for i, (_, c) in brute([(i, texts[i]) for i in ids["language"]], ngram_join.Settings()).items():
        groups[c].append(i)
    assert sorted(ids["near_duplicates"]) == sorted(groups)
    bench = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i in ids["near_duplicates"] if any(b in plain(texts[i]) for b in bench)}
    assert leaks and set(ids["near_duplicates"]) - set(ids["decontamination"]) == leaks
    assert set(ids["mixing"]) <= set(ids["decontamination"])
    last = pipeline.STAGES[-1][1](spark, kept, SF)
    assert sorted(r.doc_id for r in last.select("doc_id").collect()) == sorted(ids["mixing"])
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_sketch_marks_what_several_texts_share(spark):
    draw = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(base[i * 20 : i * 20 + 30] + [f"u{i}x{k}" for k in range(draw.randrange(5, 60))])) for i in range(8)]
    rows += [(20, rows[0][1]), (21, None), (22, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    settings = ngram_join.Settings(words=3, slot_bits=20)
    bits = ngram_join.shared_slots(docs, settings)
    counts = defaultdict(int)
    for _, text in rows:
        for slot in ngram_join._slot_of(ngram_join.shingles(text, 3), settings).tolist():
            counts[slot] += 1
    marked = {s for s in range(1 << 20) if bits[s >> 5] >> (s & 31) & 1}
    assert marked == {s for s, n in counts.items() if n > 1} and len(marked) > 50
    assert not ngram_join.shared_slots(docs.limit(0), settings).any()


def test_large_group_of_sets_that_do_not_link(spark, monkeypatch):
    """Texts that share half of their n-grams with all others: many candidates, no links, few pairs to verify."""
    draw = random.Random(2)
    rows = []
    for i in range(400):
        rows.append((i, " ".join(f"s{k}" if draw.random() < 0.93 else f"u{i}x{k}" for k in range(120))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = []
    plain = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest: made.append(pairs.count()) or plain(pairs, *rest))
    found = ngram_join.join(docs, ngram_join.Settings(words=5, least=80)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, ngram_join.Settings(words=5, least=80))
    assert sum(made) <= 2 * len(rows)
