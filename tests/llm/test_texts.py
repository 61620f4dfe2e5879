"""BPE, line dedup, mixing, chat formatting and the language model."""

import hashlib
import math
import pathlib
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spectraloom.llm import bpe, chat, line_dedup, mixing, pitman_yor, queries
from spectraloom.llm.common import CLEAN_SHUFFLES, Scratch, total_bytes
from spectraloom.llm.textscan import mix
from tests.llm.conftest import CLASH, COPY, LONG, ODD
from tests.oracle import connect, differences

PATH = public_tokenizers.path("word_bpe_49k.json")
VOCABULARY = bpe.read_vocabulary(PATH)
ENCODER, LIBRARY = bpe.Encoder(VOCABULARY), Tokenizer.from_file(PATH)


def same(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ENCODER.encode(text) == ids
    assert ENCODER.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abeinorstThE'’ ́\t\n.,!1²٣é한글漢😀‍\u0085\x1f\x00<|>ΣσςİıǄſÅ"), max_size=40))
def test_bpe_equals_the_library(text):
    same(text)


@pytest.mark.parametrize("text", ["", "a" * 3000, "the" * 900, "<|endoftext|>x<|STARTOFTEXT|><|startoftext|>", "don't I'LL",
                                  "﻿é ́x क्षि ½Ⅷ", LONG])
def test_bpe_of_special_texts(text):
    same(text)


def test_cuts_are_never_inside_a_token():
    place = {c: i for i, c in enumerate(bpe.byte_characters())}
    for token in list(VOCABULARY.tokens)[:3000]:
        inner = [place[c] for c in token.removesuffix("</w>")] if token != "</w>" else []
        assert all(ENCODER.joined[a, b] for a, b in zip(inner, inner[1:-1]))


def test_bpe_rows(spark, odd, none, sf_dir):
    for docs in (odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = Counter()
        for (text,) in docs.select("text").collect():
            ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
            rows[np.array(ids, "<u4").tobytes(), LIBRARY.decode(ids, skip_special_tokens=False), len(ids)] += 1
        found = bpe.encode_documents(docs, VOCABULARY).collect()
        assert Counter((bytes(r.ids), r.decoded, r.n_tokens) for r in found) == rows
    assert bpe.encode_documents(none, VOCABULARY).collect() == []


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_native_operators_equal_their_sql(name, spark, sf_dir):
    assert differences(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.SQL[name]) == []


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_native_operators_run_no_python(name, spark, sf_dir):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct", plan)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_native_operators_on_odd_rows_equal_their_sql(name, spark, odd, tmp_path):
    labels = [(1, 1, 0), (2, 0, None), (2, 1, 1), (3, None, 1), (None, 1, 1), (9, 0, 0), (77, 1, 1)]
    vectors = [(i, [float((i * k) % 7 - 3) for k in range(32)], i % 3 or None) for i in range(80)] + [
        (80, None, 1), (81, [math.nan] * 32, 1), (82, [None] * 32, None), (83, [math.inf] * 32, 2)]
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    assert differences(queries.QUERIES[name](spark, str(tmp_path)), con, queries.SQL[name]) == []


def test_lines_are_dropped_by_site(spark):
    rows = [(i, "a", f"menu\nbody {i}\n\nfooter {i % 2}\nbody {i}") for i in range(20)] + [
        (100 + i, "b", f"menu\nb {i}") for i in range(3)] + [(200, None, "menu"), (201, "a", None)]
    pages = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for limit in (1000, 0):  # broadcast lists, joined lists
        found = {r.doc_id: r for r in line_dedup.drop_lines(pages, ratio=0.6, least=5, limit=limit).collect()}
        assert found[3].text == "body 3\n\nfooter 1\nbody 3" and (found[3].n_lines, found[3].n_dropped) == (4, 1)
        assert found[100].text == "menu\nb 0" and found[200].text == "menu" and found[201].text is None


def test_copies_of_a_text_are_no_boilerplate(spark):
    """A large group of clean copies keeps its text through the lines stage; a menu on different pages goes."""
    copy = "first line of the copy\nsecond line of the copy"
    rows = [(i, copy, "a") for i in range(100)] + [(100 + i, f"menu\nbody {i}", "a") for i in range(300)] + [
        (400 + i, None, "a") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["lines"](spark, docs, "").collect()}
    assert found == {i: f"body {i - 100}" if text and i >= 100 else text for i, text, _ in rows}


def test_line_dedup_keeps_other_columns(odd, none):
    found = line_dedup.drop_lines(odd, ratio=0.1, least=2)
    assert set(odd.columns) <= set(found.columns)
    rows = found.collect()
    assert len(rows) == len(ODD) and all(r[c] == "keep" for r in rows for c in CLASH if c != "n_lines")
    assert all(r.text in ("", None) or r.source is None for r in rows if r.doc_id in (1, 2))
    assert line_dedup.drop_lines(none).collect() == []


def test_raked_weights_meet_the_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    targets = {"lang": {"en": 1, "de": 1, "fr": 1, "es": 1}, "source": 0.5}
    rows = mixing.mix_documents(docs, targets, rate=0.1, rounds=30).toPandas()
    rows["expected"] = rows.n_tokens * rows.probability
    share = rows.groupby("lang").expected.sum() / rows.expected.sum()
    assert (abs(share - 0.25) < 0.001).all() and rows.probability.max() <= 1
    assert abs(rows.expected.sum() / rows.n_tokens.sum() - 0.1) < 0.0001
    kept = rows[rows.kept]
    assert abs(kept.n_tokens.sum() / rows.expected.sum() - 1) < 0.6


def shares_and_targets(rows, expected, room):
    """Per axis: the sample's shares of tokens, and the present shares to the power of POWER, none above ``room``."""
    for axis in mixing.AXES:
        present = rows.groupby(axis).n_tokens.sum().astype(float)
        target = present ** mixing.POWER
        target *= present.sum() / target.sum()
        for _ in range(50):
            full = target >= present * room * (1 - 1e-12)
            target[full] = present[full] * room
            target[~full] *= (present.sum() - target[full].sum()) / target[~full].sum()
        yield expected.groupby(rows[axis]).sum() / expected.sum(), target / target.sum()


@pytest.mark.parametrize("repeats", [False, True])
def test_the_sample_meets_the_targets_with_production_numbers(repeats, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_documents(docs, repeats=repeats).toPandas().drop_duplicates("doc_id")
    assert len(rows) == docs.count() and rows[rows.n_tokens > 0].probability.max() >= 1 - 1e-6
    assert (rows.probability.max() > 1) == repeats
    expected = rows.n_tokens * rows.probability
    for share, target in shares_and_targets(rows, expected, np.inf if repeats else mixing.ROOM / mixing.RATE):
        assert (abs(share / target - 1) < 0.01).all()
    assert abs(expected.sum() / rows.n_tokens.sum() - mixing.RATE) < 0.001 * mixing.RATE
    reached = mixing.misses(docs, repeats=repeats).toPandas()
    assert (abs(reached.reached / reached.target - 1) < 0.01).all()
    assert (reached.asked > reached.target * 1.05).any() != repeats
    assert abs(reached.groupby("axis").reached.sum() - 1).max() < 1e-9


def test_one_rare_cell_does_not_shrink_the_sample(spark):
    rows = [(i, "a b c d e", "en" if i % 2 else "de", f"s{i % 3}") for i in range(6000)]
    common = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    rare = spark.createDataFrame([(-1, "one", "xx", "s0"), (-2, "one | two", "en", "s9")], common.schema)
    before, after = (mixing.mix_documents(d).where("kept AND doc_id >= 0").count() for d in (common, common.union(rare)))
    assert abs(before / 6000 - mixing.RATE) < 0.02 and abs(after - before) < 60
    found = {r.doc_id: r.probability for r in mixing.mix_documents(common.union(rare)).where("doc_id < 0").collect()}
    assert all(p > 0.8 for p in found.values())


def test_targets_that_cannot_be_met_are_reported(spark):
    rows = [(i, "a b", "en" if i < 900 else "de", "s") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {(r.axis, r.level): r for r in mixing.misses(docs, {"lang": {"de": 1.0, "en": 1.0}}).collect()}
    german = found["lang", "de"]
    assert german.asked == 0.5 and abs(german.target - 0.1 * mixing.ROOM / mixing.RATE) < 1e-9
    assert abs(german.reached - german.target) < 1e-6
    only = mixing.mix_documents(docs, {"lang": {"de": 1.0}}).groupBy("lang").agg(F.avg("probability").alias("p")).collect()
    assert {r.lang: round(r.p, 6) for r in only} == {"en": 0.0, "de": mixing.ROOM}


def test_repeated_documents_come_as_often_as_their_probability(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one word").alias("text"), F.lit("en").alias("lang"),
                                    F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"))
    found = mixing.mix_documents(docs, {"source": {"a": 0.5, "b": 0.5}}, repeats=True)
    copies = found.where("kept").groupBy("source", "doc_id", "probability").count().toPandas()
    assert set(copies[copies.source == "b"]["count"]) == {3, 4} and set(copies[copies.source == "a"]["count"]) == {1}
    assert ((copies["count"] - copies.probability).abs() < 1).all()
    total = copies.groupby("source")["count"].sum()
    assert abs(total["b"] / total.sum() - 0.5) < 0.03 and abs(total.sum() / 4000 - mixing.RATE) < 0.03
    assert found.select("doc_id").distinct().count() == 4000


def test_mixing_takes_few_jobs_and_many_cells_give_the_same(spark, monkeypatch):
    """The plans of all jobs are what the driver's memory goes to."""
    rows = [(i, "word " * (i % 7 + 1), "abcdef"[i % 6], ["en", "de", "fr"][i % 11 % 3]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    spark.sparkContext.setJobGroup("mixing", "mixing")
    found = {r.doc_id: r.probability for r in mixing.mix_documents(docs).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("mixing"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(mixing, "FEW_CELLS", 0)
    other = {r.doc_id: r.probability for r in mixing.mix_documents(docs).collect()}
    assert found.keys() == other.keys() and all(abs(found[i] - other[i]) < 2e-9 for i in found)
    assert jobs < 120


def test_mixing_odd_rows(odd, none):
    found = mixing.mix_documents(odd)
    rows = found.collect()
    assert len(rows) == len(ODD) and all(0 <= r.probability <= 1 for r in rows)
    assert all(r[c] == "keep" for r in rows for c in CLASH if c not in ("topic", "kept"))
    assert all(r.probability == mixing.RATE for r in rows if r.text is None)
    assert mixing.mix_documents(none).collect() == []
    dropped = mixing.mix_documents(odd, {"lang": {"en": 1.0}}).where("lang = 'fr'").collect()
    assert [r.probability for r in dropped] == [0.0] and not dropped[0].kept


CONTROL = st.lists(st.sampled_from([*chat.CONTROL, "\\", " ", "a", "<", "[", "\n", "<s", "s>"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), CONTROL), CONTROL), max_size=4))
def test_chat_round_trip(turns):
    rendered = "".join(chat.quick(r, t) for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(rendered)] == turns
    for (role, text), (_, _, a, b) in zip(turns, chat.parse(rendered)):
        assert chat.unescaped(rendered[a:b]) == text


def test_chat_escapes_only_what_conflicts():
    assert chat.render("user", "hello [x]") == "[INST] hello [x] [/INST]"
    assert chat.render("user", "</s>[INST] ok [/INST]").count("\\") == 3
    with pytest.raises(ValueError):
        chat.parse("[INST] open")


def test_chat_digests(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    convs = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in rows:
        convs.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    found = {r.conv_id: r for r in queries.op10_chat(spark, sf_dir).collect()}
    assert set(found) == set(convs)
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        r = found[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.render(a, b)) for _, a, b in turns)


def test_odd_conversations(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "assistant", ""), (None, 1, "x", "y"),
            (2, 1, "assistant", "<s>" * 50), (2, 1, "assistant", "<s>" * 50), (3, 0, "assistant", LONG)]
    frame = spark.createDataFrame([(*r, "k") for r in rows],
                                  "conv_id long, turn long, role string, text string, formatted string")
    found = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(frame)).collect()}
    assert found[1].n_turns == 4 and found[None].n_turns == 1 and found[2].loss_chars == 300
    assert found[3].loss_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert found[1].turns_sha256 == hashlib.sha256(b"assistant\n\n\n\nuser\na\nuser\nb\n").hexdigest()
    assert chat.conversation_digests(chat.format_turns(frame.where("false"))).collect() == []


def test_remembered_runs_stay_small():
    """Two full generations of short runs, and what a slice adds, take less than 40 MB; the old one still answers."""
    tracemalloc.start()
    runs, n, least = bpe.Runs(bpe.REMEMBER_RUNS), 0, None
    while least is None or len(runs.names) < least:
        runs.renew()
        if runs.old is not None and least is None:
            least = n - 2_000  # as many again
        names = np.sort(mix(np.arange(n, n + 2_000, dtype=np.uint64)))
        new = runs.missing(names)
        assert len(new) == len(names)
        ones = np.ones(len(new), np.int64)
        runs.add(names[new], 2 * ones, np.repeat(names[new], 2).astype(np.uint32), 8 * ones, names[new].view(np.uint8))
        n += 2_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert least > 200_000 and peak < 40 << 20
    names = np.sort(mix(np.array([5, 60_000, n - 1, n + 7], np.uint64)))  # two old, one young, one unknown
    new = runs.missing(names)
    assert names[new].tolist() == mix(np.array([n + 7], np.uint64)).tolist()
    known = np.delete(names, new)
    counts, ids, sizes, text = runs.gather(known, np.array([2, 0, 0, 1]))
    assert counts.tolist() == [2] * 4 and sizes.tolist() == [8] * 4
    assert text.view(np.uint64).tolist() == known[[2, 0, 0, 1]].tolist()
    assert ids.tolist() == np.repeat(known[[2, 0, 0, 1]], 2).astype(np.uint32).tolist()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</end>"]


@pytest.mark.parametrize("head", [2048, 5])
def test_language_model_counts_and_base(spark, sf_dir, monkeypatch, head):
    """Also with a head of five words, so that frequent words take the other way."""
    monkeypatch.setattr(pitman_yor, "HEAD", head)
    monkeypatch.setattr(pitman_yor, "PACK", 20_000)
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 100_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    rows = queries.op7_pitman_yor(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = words_of(texts[r.doc_id])
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_contexts_are_the_words_before(spark, monkeypatch):
    """Words with equal endings are contexts of their own, also when pairs are in many buckets and the head is small."""
    rows = [(i, f"{a} {b} {a} {b}") for i in range(60) for a, b in [("banding", "one"), ("bonding", "two")]]
    asked = {-1: "banding one", -2: "bonding one", -3: "banding two", -4: "bonding two"}
    docs = spark.createDataFrame([*rows, *asked.items()], "doc_id long, text string").repartition(3)
    found = {}
    for head, size in ((2048, 24 << 20), (2, 400)):
        monkeypatch.setattr(pitman_yor, "HEAD", head)
        monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", size)
        scored = pitman_yor.score_documents(docs, F.col("doc_id") >= 0).where("doc_id < 0").collect()
        found[head] = {r.doc_id: r.score for r in scored}
        s = found[head]
        assert s[-1] > s[-2] + 1 and s[-4] > s[-3] + 1
    assert all(abs(found[2][i] - found[2048][i]) < 0.5 for i in asked)


def test_language_model_leaves_little_on_disk(spark, sf_dir):
    """What no later step reads is gone: packs of texts and scores stay, in less than four times the text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(2)
    scratch = Scratch(spark, "test")
    rows = pitman_yor.score_documents(docs, F.col("doc_id") % 10 != 0, scratch=scratch)
    files = [f for f in pathlib.Path(scratch.root.removeprefix("file:")).rglob("*") if f.is_file()]
    assert {f.parent.name[4:] for f in files} == {"packs", "scores"}
    assert sum(f.stat().st_size for f in files) < 4 * total_bytes(docs)
    assert spark.conf.get(CLEAN_SHUFFLES, "false") == "false"
    assert rows.count() == docs.count()


def test_pairs_of_packs_are_gone_when_buckets_are_scored(spark, sf_dir, monkeypatch):
    """Once the buckets hold the pairs, the packs' own copy of them leaves the disk."""
    found, write = {}, Scratch.write

    def watched(self, df, name, **options):
        found[name] = {p.name[4:]: p for p in pathlib.Path(self.root.removeprefix("file:")).iterdir()}
        if name == "scores":
            rows = spark.read.parquet(str(found[name]["packs"]))
            assert rows.columns == ["pack", "doc_id", "train", "sizes", "pairs"]
        return write(self, df, name, **options)

    monkeypatch.setattr(Scratch, "write", watched)
    pitman_yor.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id") % 10 != 0)
    assert set(found["scores"]) == {"packs", "pairs", "customers", "totals"}


def test_buckets_and_packs_are_shuffled_in_groups(spark, sf_dir, monkeypatch):
    """A group's pairs leave the disk before the next group is scored, and no shuffle holds all pairs or all scores."""
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", 40_000)
    monkeypatch.setattr(pitman_yor, "PACK", 50_000)
    docs, write, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch.write, []

    def size(folder):
        return sum(f.stat().st_size for f in folder.rglob("*.parquet"))

    def watched(self, df, name, **options):
        tables = [p for p in pathlib.Path(self.root.removeprefix("file:")).iterdir() if p.name[4:] == "pairs"]
        path = write(self, df, name, **options)
        seen.append((name, sum(map(size, tables)), size(pathlib.Path(path.removeprefix("file:")))))
        return path

    def scored():
        rows = pitman_yor.score_documents(docs, F.col("doc_id") % 10 != 0).collect()
        return sorted(map(tuple, rows))

    monkeypatch.setattr(Scratch, "write", watched)
    rows = scored()
    before = [pairs for name, pairs, _ in seen if name == "scores"]  # pairs on disk when a group of buckets is scored
    assert len(before) == 3 and before[1] < 0.75 * before[0] and before[2] < 0.45 * before[0]
    for name in ("pairs", "scores"):
        sizes = [own for kind, _, own in seen if kind == name]
        assert max(sizes) < 0.5 * sum(sizes)
    assert [name for name, _, _ in seen].count("rows") == 2
    assert len(rows) == docs.count()
    monkeypatch.setattr(pitman_yor, "GROUPS", 1)
    assert scored() == rows


def test_order_of_pairs():
    """Pairs are ordered by bucket, token and context, also when the three do not fit into one number."""
    rng = np.random.default_rng(5)
    bucket, token, context = rng.integers(0, 3, 5_000).astype(np.int32), *rng.integers(0, 20, (2, 5_000))
    rows = list(zip(bucket.tolist(), token.tolist(), context.tolist()))
    for width in (20, 1 << 40):
        by, new = pitman_yor.pair_order(bucket, token, context, width)
        assert [rows[i] for i in by] == sorted(rows)
        assert [rows[i] for i in by[new]] == sorted(set(rows))


def test_large_rows_are_written_in_small_groups(spark):
    """A reader takes a row group at once: rows of a megabyte do not come a hundred at a time."""
    rows = spark.range(0, 64, 1, 1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16_000)), lambda i: F.sha2(
        F.concat_ws("-", "id", i).cast("binary"), 256)), "").alias("text"))
    scratch = Scratch(spark, "test")
    assert scratch.keep_lean(rows, "large").count() == 64
    files = pathlib.Path(scratch.root.removeprefix("file:")).rglob("*.parquet")
    groups = [g for f in files for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(g.num_rows for g in groups) == 64 and max(g.total_byte_size for g in groups) < 20 << 20


def pack_rows(packs, size):
    """Of one bucket: rows of packs as the map task sends them, and the numbers of their pairs by word and context."""
    rng, rows, counts = np.random.default_rng(4), [], Counter()
    common = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    seen, other = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (3_000, 2_000))
    for pack in range(packs):
        near = np.concatenate([common, other])
        pair = np.unique(np.stack([rng.choice(seen, size), rng.choice(near, size)], 1), axis=0)
        n = rng.integers(0, 5, len(pair)).astype(np.uint32)
        words, runs = np.unique(pair[:, 0], return_counts=True)
        at, known = pitman_yor.ranks(common, pair[:, 1])
        rows.append({"pack": pack, "bucket": 0, "words": pitman_yor.planes(words),
                     "runs": pitman_yor.planes(runs.astype(np.uint32)),
                     "context": pitman_yor.planes(np.where(known, at, pitman_yor.RARE).astype(np.uint16)),
                     "rare": pitman_yor.planes(pair[~known, 1].copy()), "count": pitman_yor.planes(n)})
        counts.update(dict(zip(map(tuple, pair.tolist()), n.tolist())))
    kinds = [("pack", pa.int64()), ("bucket", pa.int32()),
             *[(c, pa.binary()) for c in ("words", "runs", "context", "rare", "count")]]
    return common, pa.Table.from_pylist(rows, pa.schema(kinds)), counts


def test_pairs_of_a_bucket_take_little_memory(monkeypatch):
    """A bucket's pairs are merged in fewer than 60 bytes for each pair of a pack, and freed memory is handed back."""
    common, group, counts = pack_rows(20, 40_000)
    released = []
    monkeypatch.setattr(pitman_yor, "release", lambda: released.append(True), raising=False)
    n = sum(len(pitman_yor.unplaned(x, np.uint32)) for x in group["count"])
    tracemalloc.start()
    row = pitman_yor.bucket_pairs(common)(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    read = lambda name, kind: pitman_yor.unplaned(row[name][0], kind)
    words, contexts = read("words", np.uint64), read("contexts", np.uint64)
    word = np.repeat(words, read("runs", np.uint32)).tolist()
    pairs = list(zip(word, contexts[read("context", np.uint32)].tolist()))
    assert pairs == sorted(counts) and read("count", np.uint64).tolist() == [counts[p] for p in pairs]
    for place, x in zip(row["places"][0].values, range(20)):
        steps = np.cumsum(pitman_yor.unplaned(place, np.uint32))
        mine = np.repeat(*(pitman_yor.unplaned(group[c][x], k) for c, k in (("words", np.uint64), ("runs", np.uint32))))
        assert [pairs[i][0] for i in steps.tolist()] == mine.tolist()
    assert released and peak < 60 * n, peak / n


def test_pairs_of_one_customer_need_no_draw():
    """A seating of the other pairs, told how often a word is in pairs of one customer, draws the same tables."""
    rng = np.random.default_rng(3)
    word, context = rng.integers(0, 50, 600), rng.integers(0, 20, 600)
    pair, counts = np.unique(word * 20 + context, return_counts=True)
    totals = {"d1": 0.6, "d0": 0.4, "base": 1 / 51, "customers": np.zeros(20), "tables": np.ones(20),
              "root_tables": 50, "root_customers": 50}
    many = counts > 1
    ones = np.bincount(pair[~many] // 20, minlength=50)
    every = pitman_yor.Seating(pair, counts, 50, totals, np.random.default_rng(1)).samples
    some = pitman_yor.Seating(pair[many], counts[many], 50, totals, np.random.default_rng(1), ones=ones).samples
    for (tables, sent, root), (fewer, sent_too, root_too) in zip(every, some):
        assert (tables[many] == fewer).all() and (sent == sent_too).all() and (root == root_too).all()
    values = np.array([0, 5, 70_000, 2 ** 40], np.uint64)
    assert (pitman_yor.unplaned(pa.scalar(pitman_yor.planes(values)), np.uint64) == values).all()


def test_probabilities_of_a_context_add_up_to_one():
    rng = np.random.default_rng(0)
    word, context = rng.integers(0, 60, 400), rng.integers(0, 4, 400)
    pair, counts = np.unique(word * pitman_yor.CLASSES + context, return_counts=True)
    totals = {"d1": 0.6, "d0": 0.4, "base": 1 / 61, "customers": np.zeros(pitman_yor.CLASSES),
              "tables": np.ones(pitman_yor.CLASSES), "root_tables": 60, "root_customers": 60}
    for number in range(5):
        found = pitman_yor.Seating(pair, counts, 60, totals, np.random.default_rng(number))
        tables, sent, root = found.samples[-1]
        totals |= {"customers": np.bincount(found.context, counts, pitman_yor.CLASSES),
                   "tables": np.bincount(found.context, tables, pitman_yor.CLASSES),
                   "root_customers": sent.sum(), "root_tables": root.sum()}
    found = pitman_yor.Seating(pair, counts, 60, totals, np.random.default_rng(9))
    found.predict({"tables": np.array([np.bincount(found.context, t, pitman_yor.CLASSES) for t, _, _ in found.samples]),
                   "root_customers": [s.sum() for _, s, _ in found.samples],
                   "root_tables": [r.sum() for _, _, r in found.samples]})
    for c in range(5):
        parent = sum((p.sum() + u) * left[c] for p, u, left in zip(found.parent, found.unknown, found.left)) / 3
        assert abs(parent + found.added[found.context == c].sum() - 1) < 1e-9


def test_table_counts_follow_their_distribution():
    """Drawn tables against the Chinese restaurant process, customer by customer, for one dish that is all there is."""
    rng, d, weight = np.random.default_rng(1), 0.5, 3.0
    s = pitman_yor.log_stirling(d)
    for c in (2, 5, 20):
        logs = s[c, 1:c + 1] + np.log(weight) * np.arange(1, c + 1)
        chance = np.exp(logs - logs.max())
        mean = (chance * np.arange(1, c + 1)).sum() / chance.sum()
        drawn = pitman_yor.draw_tables(np.full(20_000, c), np.full(20_000, weight), d, s, rng)
        assert drawn.min() >= 1 and drawn.max() <= c and abs(drawn.mean() - mean) < 0.05
    large = pitman_yor.draw_tables(np.array([1000, 100_000]), np.array([2.0, 2.0]), d, s, rng)
    assert (large >= 1).all() and (large <= [1000, 100_000]).all()


def test_language_model_odd_rows(odd, none):
    train = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    rows = pitman_yor.score_documents(odd, train).collect()
    assert len(rows) == len(ODD)
    empty = [r for r in rows if r.doc_id in (4, 5, 6)]
    assert all(r.n_tokens == 1 for r in empty) and len({round(r.score, 9) for r in empty}) == 1
    copies = [r for r in rows if r.doc_id == 2]
    assert len(copies) == 2 and copies[0] == copies[1] and copies[0].n_tokens == len(words_of(COPY))
    untrained = pitman_yor.score_documents(odd, F.lit(False)).collect()
    assert all(abs(r.score) < 1e-9 and r.train_tokens == 0 and r.n_known == 0 for r in untrained)
    assert pitman_yor.score_documents(none, train).collect() == []
