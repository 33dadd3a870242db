"""Shards, mixtures and token files."""

import io
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turfgrid.functions.hashing import HASH_BITS, keyed_hash
from turfgrid.llm import mixing, sharding, token_files

DOCS = "doc_id bigint, text string, source string, `__bucket` int, shard string, copies map<string,int>"


@pytest.fixture(scope="module")
def docs(spark):
    draw = np.random.default_rng(2)
    rows = [(i, "w " * int(draw.integers(0, 40)), ("big" if i % 3 == 0 else f"s{i % 7}"), 1, "x", {"a": 1}) for i in range(900)]
    rows += [(2000, None, "big", None, None, None), (2001, "", None, None, None, None), (2002, "é " * 50_000, None, None, None, None), (None, "no id", None, None, None, None)]
    rows += [rows[5]] * 3
    return spark.createDataFrame(rows, DOCS)


def test_shards_follow_the_fractional_ranks(docs, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    got = sharding.shards(docs, 8).toPandas()
    table = docs.select("doc_id", "source", "text", keyed_hash(sharding.SEED, F.col("doc_id")).alias("h"), F.xxhash64("text").alias("t")).toPandas()
    table["key"] = table.source.isna()
    table = table.sort_values(["key", "source"]).assign(number=lambda t: pd.factorize(t.source.fillna("~null"))[0])
    table = table.sort_values(["number", "h", "doc_id", "t"], na_position="first").reset_index(drop=True)
    table["f"] = (2 * table.groupby("number").cumcount() + 1) / (2 * table.groupby("number").h.transform("size"))
    table = table.sort_values(["f", "number"], kind="stable").reset_index(drop=True)
    n = len(table)
    table["shard"] = [p * 8 // n for p in range(n)]
    table["slot"] = table.groupby("shard").cumcount()
    key = lambda t: Counter(zip(t.doc_id.fillna(-1), t.shard, t.slot, strict=True))
    assert key(got) == key(table)
    sizes = got.groupby("shard").slot.agg(["count", "max"])
    assert sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["max"] + 1 == sizes["count"]).all()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got.itertuples():
        text = texts[None if pd.isna(r.doc_id) else r.doc_id] or ""
        assert r.size == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode())


def test_every_shard_has_the_mixture(docs):
    got = sharding.interleave(docs, {"source": F.col("source")}, 10).groupBy("shard").agg(F.sum((F.col("source") == "big").cast("int")).alias("big")).toPandas()
    assert got.big.max() - got.big.min() <= 2


def test_shards_of_nothing(docs):
    assert sharding.shards(docs.limit(0)).count() == 0
    assert sharding.shards(docs.limit(1)).first().slot == 0


def reshared(sizes, weights, share, most):
    """Targets by literal re-sharing: cap what is above, share the excess by weight, until none is above."""
    total, full, target = share * sum(sizes), set(), []
    while True:
        left = total - sum(most * sizes[i] for i in full)
        open_ = sum(w for i, w in enumerate(weights) if i not in full)
        target = [most * s if i in full else left * weights[i] / open_ for i, s in enumerate(sizes)]
        above = {i for i, s in enumerate(sizes) if i not in full and target[i] > most * s}
        if not above:
            return target
        full |= above


def test_targets_are_those_of_resharing(spark):
    draw = np.random.default_rng(4)
    for _ in range(3):
        sizes = [int(x) for x in draw.integers(0, 1000, 9)]
        table = spark.createDataFrame([(None if i == 8 else f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.targets(table).collect()}
        want = reshared(sizes, [(5, 2, 1)[i % 3] for i in range(9)], 1.5, 2)
        assert np.allclose([got[None if i == 8 else f"s{i}"] for i in range(9)], want)


def test_mixture_comes_near_its_targets(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 40)
    got = mixing.amounts(docs).toPandas()
    assert len(got) == docs.count()
    again = mixing.amounts(docs.repartition(7)).toPandas()
    assert Counter(map(tuple, got.fillna(-1).values.tolist())) == Counter(map(tuple, again.fillna(-1).values.tolist()))
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    named = got[got.doc_id < 900].merge(docs.select("doc_id", "source").distinct().toPandas(), on="doc_id")
    by = named.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    # rows equal in id are taken alike, so a source may be off by its repeated rows too
    assert ((by.taken - by.target).abs() <= 4 * by.most).all()


def test_sample_is_the_pareto_order(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "one") for i in range(400)], "doc_id bigint, text string, source string")
    liking = F.when(F.col("doc_id") % 2 == 0, 0.5).otherwise(1.4)
    chosen = mixing.plan(docs, liking)
    rows = docs.select("doc_id", "source", mixing.word_count().alias("size"), liking.alias("preference"))
    got = mixing.copies(rows, chosen).toPandas()
    u = {r.doc_id: r.u for r in docs.select("doc_id", mixing.keyed_uniform(mixing.SEED, F.col("doc_id")).alias("u")).collect()}
    rate = got.target[0] / (got["size"] * got.preference).sum()
    wanted = np.minimum(2, rate * got.preference)
    whole, chance = np.floor(wanted), wanted - np.floor(wanted)
    order = sorted(range(len(got)), key=lambda i: (u[got.doc_id[i]] / (1 - u[got.doc_id[i]])) / (chance[i] / (1 - chance[i])) if chance[i] > 0 else np.inf)
    left, taken = got.target[0] - (whole * got["size"]).sum(), set()
    total = 0
    for i in order:
        if chance[i] > 0 and total + got["size"][i] / 2 <= left:
            taken.add(got.doc_id[i])
        total += got["size"][i]
    assert {d for d, c, w in zip(got.doc_id, got.copies, whole, strict=True) if c > w} == taken
    assert abs((got.copies * got["size"]).sum() - got.target[0]) <= 9


def test_mixed_corpus_has_whole_rows(docs):
    amounts = Counter()
    for r in mixing.amounts(docs).collect():
        amounts[r.doc_id] += r.taken
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.select("doc_id", mixing.word_count().alias("n")).collect():
        words[r.doc_id] += r.n
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in amounts.items() if v}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.amounts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 15, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (token_files.unpack(data, bits, 1001) == ids).all()


def test_file_is_read_by_ranges():
    draw = np.random.default_rng(0)
    lists = [draw.integers(0, 1 << 17, n).astype(np.uint32) for n in (0, 5, 1, 300, 0, 77)]
    data = token_files.dump([1, 2, None, 4, 5, 6], lists, 17, block=16)
    file = token_files.TokenFile.open(pa.PythonFile(io.BytesIO(data), "r"))
    assert file.bits == token_files.width(1 << 17) and all((file.document(k) == x).all() for k, x in enumerate(lists))
    whole = np.concatenate(lists)
    assert all((file.ids(a, b) == whole[a:b]).all() for a, b in ((0, 0), (15, 17), (16, 32), (0, whole.size), (380, 383)))


def test_tokens_of_documents(spark, docs, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    odd = ["", " ", "  x", "a\n\n  b c", "a \n b", "x" * 300 + " y", "don't 's", "<|endoftext|> a", "one <|endoftext|> two", "日本 語 12 3", "tab\tx ", None]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string"))
    monkeypatch.setattr(token_files.in_parts, "__defaults__", (False, 100))
    got = token_files.token_table(table, path).toPandas().sort_values("start").reset_index(drop=True)
    plain = Tokenizer.from_file(path)
    rows = sorted(table.collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.text or ""))
    ids = [np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in rows]
    assert list(got.doc_id.fillna(-1)) == [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert list(got.n_tokens) == [len(x) for x in ids] and list(got.ids_crc32) == [zlib.crc32(x.tobytes()) for x in ids]
    assert list(got.start) == [0, *np.cumsum([len(x) for x in ids])[:-1]]
    assert token_files.token_table(table.limit(0), path).count() == 0


def test_fractions_in_a_source_with_a_whole_rate(spark):
    """At the highest rate, 2, a preference of 0.6 wants 1.2 copies of each document."""
    docs = spark.createDataFrame([(i, "a", "w " * 10) for i in range(400)], "doc_id bigint, source string, text string")
    taken = mixing.mix(docs, F.lit(0.6)).groupBy("doc_id").count().collect()
    assert len(taken) == 400 and abs(sum(r["count"] for r in taken) - 480) <= 1


def test_rows_without_an_id_come_near_their_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 40)
    rows = [(None if i % 4 else 7, "a" if i < 400 else "b", "w " * (1 + i % 9) + str(i)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = mixing.amounts(docs.withColumn("source", F.col("source"))).toPandas()
    by = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.most).all() and len(by) == 2
    mixed = mixing.mix(docs).select(mixing.word_count().alias("n")).agg(F.sum("n")).first()[0]
    assert mixed == got.taken.sum()
