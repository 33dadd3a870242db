"""Spelling variants, collocations and packed sequences against brute force."""

import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from turfgrid.llm import collocations, packing, variants
from turfgrid.llm.oracles import ORACLES

DOCS = "doc_id bigint, text string, lang string, word string, n string, part int, rank int"
SF = "/root/testdata/sf0.001"


def rows_of(texts, langs=("en",)):
    return [(None if t == "no id" else i, t, langs[i % len(langs)], "clash", "x", 7, None) for i, t in enumerate(texts)]


def same_as_sql(frame, sql, tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"create view {name} as select * from '{path}'")
    want = con.execute(sql).df()
    names = sorted(want.columns)
    assert sorted(frame.columns) == names
    plain = lambda t: sorted(map(repr, t[names].astype(object).where(t[names].notna(), None).values.tolist()))
    assert plain(frame) == plain(want)


def test_sql_of_new_queries(spark):
    from turfgrid.llm.queries import QUERIES

    for name in ("op11_spelling_variants", "op12_collocations"):
        same_as_sql(QUERIES[name](spark, SF).toPandas(), ORACLES[name], {"documents": f"{SF}/documents.parquet"})


# ---------------------------------------------------------------- spelling variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_variants(table, times=2):
    out = {}
    forms = {}
    for w, n in table.items():
        about = [(-m, v) for v, m in table.items() if near(w, v)]
        less, best = min(about, default=(0, None))
        forms[w] = best if best is not None and -less >= times * n else None
        out[w] = (len(about), -less if forms[w] else None)
    full = {}
    for w in table:
        root = w
        while forms[root]:
            root = forms[root]
        full[w] = (forms[w], root, table[w], *out[w])
    return full


@pytest.mark.parametrize("part_words", [100_000, 64, 16])
def test_neighbours_of_words(spark, part_words):
    """Few letters give many neighbours, runs of equal letters, ties, words that begin others; many ranges."""
    draw = np.random.default_rng(part_words)
    words = {"".join(draw.choice(list("abé"), draw.integers(1, 8))) for _ in range(500)}
    words |= {"aaaa", "aaaaa", "aaaaaa", "baaaa", "aaaab", "z" * 4000, "z" * 4001, "z" * 2000 + "y" + "z" * 1999, "ÿ÷×"}
    table = {w: int(draw.choice([3, 5, 6, 12, 24])) for w in words}
    got = variants.group(spark.createDataFrame(list(table.items()), "word string, n bigint"), part_words=part_words).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute_variants(table) and len(got) == len(table)


def test_words_of_texts(spark):
    texts = [None, "", "no id", "Wörter-wörter WÖRTER", "ÄÖÜäö äöüäö Äöüäö", "x1y2", "日本 語言", "abcde " * 50, "abcdf,abcde;abcde" * 3, "straße straße STRASSE straße ×÷×÷× ×÷×÷× ×÷×÷×"]
    texts += ["q" * 3_000_000 + " tail tailed " + "end" * 2] * 3
    texts += [" ".join(f"word{'abcdefgh'[k % 8]}x" for k in range(i)) for i in range(60)]
    docs = spark.createDataFrame(rows_of(texts) + rows_of(texts)[4:5] * 2, DOCS)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if n >= 3 and len(w) >= 5}
    got = variants.find(docs).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute_variants(want)
    assert variants.find(docs.limit(0)).count() == 0


def test_pieces_of_a_text_keep_runs_whole(monkeypatch):
    monkeypatch.setattr(variants, "_PIECE", 3)
    text = "ab cdefgh1ij--klmnopq  r"
    assert [w for lot in variants.runs(text) for w in lot] == [b"ab", b"cdefgh", b"ij", b"klmnopq", b"r"]


# ---------------------------------------------------------------- collocations


def brute_counts(rows, longest=3):
    out = defaultdict(Counter)
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            for size in range(1, longest + 1):
                out[lang or "und"].update(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
    return out


@pytest.fixture(scope="module")
def phrases(spark):
    draw = np.random.default_rng(5)
    vocabulary = ["Alpha", "beta x", "gamma", "delta", "é", "a\x1cb", "日本", "x" * 30]
    texts = []
    for _ in range(150):
        words = draw.choice(vocabulary, draw.integers(0, 40), p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.05, 0.03, 0.02])
        texts.append("".join(str(w) + str(draw.choice([" ", " ", " ", "\t ", ".", "\n", " , ", "  "])) for w in words))
    texts += [None, "", " \t", "...", "gamma delta " * 5_000]
    return spark.createDataFrame(rows_of(texts, ("en", None, "fr")), DOCS)


@pytest.mark.parametrize("settings", [collocations.Settings(), collocations.Settings(least=3, shards=7, slot_bits=6, name_bits=6), collocations.Settings(least=4, shards=1), collocations.Settings(longest=4, shards=3)])
def test_counts_are_exact(phrases, settings, monkeypatch):
    monkeypatch.setattr(collocations, "_LOT", 2_000)
    monkeypatch.setattr(collocations, "_KEYS", 300)
    monkeypatch.setattr(collocations, "_HELD", 6)
    want = brute_counts([(r.lang, r.text) for r in phrases.collect()], settings.longest)
    got = {(r.lang, r.phrase): r.n for r in collocations.counts(phrases, settings).collect()}
    assert all(want[lang][phrase] == n for (lang, phrase), n in got.items())
    missing = [(lang, p) for lang in want for p, n in want[lang].items() if (lang, p) not in got and (n >= settings.least or " " not in p)]
    assert not missing


def test_phrases_are_ranked(phrases):
    settings = collocations.Settings(least=3, top=15)
    want = brute_counts([(r.lang, r.text) for r in phrases.collect()])
    rows = []
    for lang, f in want.items():
        found = {p: n for p, n in f.items() if " " in p and n >= settings.least}
        scored = []
        for p, a in found.items():
            w = p.split(" ")
            score, _, left, right = min((10**6 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w)))
            if not any(f" {p} " in f" {q} " and q != p and 100 * found[q] >= 50 * a for q in found):
                scored.append((-score, -a, p.encode(), p, a, left, right, score))
        total = sum(n for p, n in f.items() if " " not in p)
        rows += [(lang, k + 1, p, a, left, right, total, score) for k, (_, _, _, p, a, left, right, score) in enumerate(sorted(scored)[:15])]
    got = collocations.find(phrases, settings).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == sorted(rows) and len(rows) > 30
    assert collocations.find(phrases.limit(0)).count() == 0


def test_task_holds_little_and_hands_over_small_batches():
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in draw.integers(0, 60_000, 2_000)) for _ in range(300)]  # 4 MB
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    tracemalloc.start()
    words = list(collocations._count_words(collocations.Settings())(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    opened = SimpleNamespace(value=[np.zeros(1 << 23, np.uint8)] * 2)
    longer = list(collocations._count_keys(1, opened, collocations.Settings())(iter([batch])))
    total = lambda batches: sum(b.column("n").to_numpy().sum() for b in batches)
    assert (total(words), total(longer)) == (300 * 2_000, 300 * (1_999 + 1_998))
    assert max(b.num_rows for b in words + longer) <= 1 << 16


def test_keys_are_gone_through_for_one_cycle_only(phrases, monkeypatch):
    """A step reads the counts of the last cycle to open phrases; all counts are read once, for the longest."""
    read = []
    slots = collocations._slot_words
    monkeypatch.setattr(collocations, "_slot_words", lambda table, bits: read.append(len({f.rpartition("/")[0] for f in table.inputFiles()})) or slots(table, bits))
    settings = collocations.Settings(least=3, shards=2)
    assert collocations.counts(phrases, settings).count() and max(read[:-2]) <= settings.shards
    assert len([n for n in read if n > settings.shards]) <= 1


def test_words_hold_any_other_character(spark):
    odd = ["\x00", "a\x00b", "a\x00", "a", "b\x00\x00", "\x0e\x1f", "\x7f", "\x85", "\xa0x", "\u2028", "\u3000", "\ufeff", "É", "İ", "\U0001f600", "\xff", "ÿ"]
    draw = np.random.default_rng(9)
    texts = ["".join(str(w) + str(draw.choice([" ", " ", "\t", ". ", "\r\n"])) for w in draw.choice(odd, 60)) for _ in range(120)]
    rows = spark.createDataFrame(rows_of(texts, ("en", None, "", "und")), DOCS)
    want = brute_counts([("und" if r.lang is None else r.lang or "none", r.text) for r in rows.collect()])
    got = {(r.lang or "none", r.phrase): r.n for r in collocations.counts(rows, collocations.Settings(least=3)).collect()}
    assert got == {(lang, p): n for lang in want for p, n in want[lang].items() if n >= 3 or " " not in p}


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    table = [("en", 1, "a", 7 * 10**12), ("en", 1, "b", 5 * 10**12), ("en", 2, "a b", big)]
    counted = spark.createDataFrame(table, "lang string, size int, phrase string, n bigint")
    assert collocations.collocations(counted).first().score == 10**6 * big * big // (35 * 10**24)


@pytest.mark.parametrize("limit", [1, 2, 5, 11])
def test_parts_of_a_text_lose_no_phrase(limit):
    text = "one two three four. five   six\tseven eight nine ten eleven " + "w" * 40 + " x y z, a b c d e f g h i j k l m n"
    want = brute_counts([("en", text)])["en"]
    lot = collocations._Lot()
    for again, data in collocations.text_parts(text, 3, limit):
        lot.add(again, data)
    phrases = collocations._Phrases(lot, "en", collocations.Settings(slot_bits=10))
    _, places, times = phrases.words()
    got = Counter({phrases.text(p, 1): n for p, n in zip(places.tolist(), times.tolist(), strict=True)})
    for size, places, _, _ in phrases.longer([np.zeros(1 << 10, np.uint8)] * 2, 0):
        got.update(phrases.text(p, size) for p in places.tolist())
    assert got == want


# ---------------------------------------------------------------- packing


def brute_pack(lengths, size):
    left = []
    for length in sorted(lengths, reverse=True):
        fits = [(x, i) for i, x in enumerate(left) if x >= length]
        if fits:
            left[min(fits)[1]] -= length
        else:
            left.append(size - length)
    return sorted(left)


def test_plan_is_best_fit_over_documents():
    draw = np.random.default_rng(3)
    for size in (1, 2, 10, 17, 64) * 8:
        lengths = draw.integers(1, size + 1, draw.integers(1, 300)).tolist()
        lines, used = packing.plan(Counter(lengths), size)
        held = defaultdict(list)
        for s in lines:
            for t in range(s.items):
                held[s.sequence + t // s.per].append((s.offset + t % s.per * s.length, s.length))
        assert Counter(n for v in held.values() for _, n in v) == Counter(lengths) and len(held) == used
        assert sorted(size - sum(n for _, n in v) for v in held.values()) == brute_pack(lengths, size)
        for v in held.values():
            assert [o for o, _ in sorted(v)] == [0, *np.cumsum([n for _, n in sorted(v)])[:-1]]
    assert packing.plan({}, 9) == ([], 0)


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_packed_documents(spark, tokenizer):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    texts = [None, "", "no id", " ", "Hello\tWORLD's  12 é é ́b\x1cc\x0b d", "<|endoftext|> kept", "x<|startoftext|>", "日本語" * 40, "ab " * 5000, "z" * 3000]
    texts += [" ".join(["word"] * (i % 9)) for i in range(300)]
    docs = spark.createDataFrame(rows_of(texts) + rows_of(texts)[8:9] * 3, DOCS).repartition(5)
    size = 64
    got = packing.pack(docs, tokenizer, size).toPandas()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, ids.size, size):
            part = ids[k : k + size]
            want[r.doc_id, k // size, k, part.size, zlib.crc32(part.tobytes())] += 1
    doc = got.doc_id.astype(object).where(got.doc_id.notna(), None)
    assert Counter(zip(doc, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
    for _, one in got.sort_values("offset").groupby("sequence_id"):
        assert list(one.offset) == [0, *one.length.cumsum()[:-1]] and one.length.sum() <= size
    assert got.sequence_id.nunique() == len(brute_pack(list(got.length), size)) == got.sequence_id.max() + 1
    assert packing.pack(docs.limit(0), tokenizer).count() == 0


def test_sequences_hold_the_ids(spark, tokenizer):
    docs = spark.createDataFrame(rows_of(["a b c", None, "some words here " * 30, "a b c"]), DOCS)
    ids = packing.WordIds(tokenizer)
    stream = Counter()
    for text in ("a b c", "", "some words here " * 30, "a b c"):
        whole = np.frombuffer(b"".join(ids.parts(text)), "<u4").tolist() + [1]
        stream.update(tuple(whole[k : k + 16]) for k in range(0, len(whole), 16))
    got = Counter()
    for r in packing.sequences(docs, tokenizer, 16).collect():
        assert len(r.ids) == sum(r.lengths) <= 16 and len(r.doc_ids) == len(r.lengths)
        at = 0
        for n in r.lengths:
            got[tuple(r.ids[at : at + n])] += 1
            at += n
    assert got == stream


def test_other_tokenizers_take_the_plain_call():
    public = pytest.importorskip("public_tokenizers")
    ids = packing.WordIds(public.path("byte_bpe_50k.json"))
    assert not ids.by_words
    text = "  a b\n c's"
    assert np.frombuffer(b"".join(ids.parts(text)), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids
