import hashlib
import math
import re
import string
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phasefold.llm import blocks, chat, common, lm_scoring, packing, queries, quality, token_counts
from tests.llm.conftest import odd_rows

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    hit = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_measures_match_brute_force(odd, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    judged, names, verdict = quality.judge(odd, labels)
    for r in judged.collect():
        want = measures(r["text"])
        assert tuple(r[names[m]] for m in quality.MEASURES) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r[names["base_failed"]] == failed and r[verdict] == (not failed)
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert quality.keep_good(none, labels).count() == 0


def test_binomial_tail_is_exact(spark):
    for n, k, p in ((20, 0, 0.1), (50, 3, 0.2), (400, 2, 0.01), (3000, 10, 0.01), (7, 7, 0.3)):
        got = spark.range(1).select(F.expr(quality.binomial_tail(f"{n}L", f"{k}L", p)).alias("x")).first().x
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k <= n * p else 1.0
        assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_keep_their_promise(spark):
    """One rule separates bad documents, others don't; no stratum may lose more than the allowed share of good ones."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(12000):
        bad = i % 8 == 0
        rows.append((("en", "de", "tiny")[0 if i % 3 else 1] if i > 20 else "tiny", not bad, 200, int(1000 + rng.integers(0, 100)), int(rng.integers(200, 500)) if bad else 0, 0, int(rng.integers(0, 40)), 10))
    cols = "stratum string, good boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    cut = quality.choose_cutoffs(spark.createDataFrame(rows, cols)).collect()
    assert {(r.stratum, r.rule) for r in cut} >= {("en", "symbols"), ("de", "symbols")} and all(r.stratum != "tiny" for r in cut)
    for r in cut:
        assert r.false_rejections <= 0.05 * r.n_good and r.caught > r.false_rejections


def test_chat_reads_back_what_went_in(spark, none):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, None, "### a: b\n</turn>\n"), (2, 0, None, "### a: b\n</turn>\n"),
            (None, 1, "assistant", "no id\\h\\-"), (3, None, "as:sist", "x"), (3, 5, "assistant", "é" * 9)] + [(9, i, ("user", "assistant")[i % 2], f"turn {i} \\t ###") for i in range(70)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wide = frame.withColumn("msg_id", F.lit("clash")).withColumn("path", F.lit(1))
    messages = chat.linear_thread(wide)
    got = {r.conv_id: r for r in chat.read_back(chat.format_trees(messages)).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        said = "".join(f"{a}\n{t}\n" for a, t in turns)
        loss = "".join(t for a, t in turns if a == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    empty = chat.linear_thread(frame.limit(0))
    assert chat.read_back(chat.format_trees(empty)).count() == 0


def test_branches_are_ranked(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 3, "user", "more", 0.5), (1, 5, 99, "user", "orphan", 0.0),
            (1, 6, 7, "user", "loop", 9.0), (1, 7, 6, "user", "loop", 9.0), (2, 1, None, "user", "tie", 0.0), (2, 2, 1, "assistant", "a", 1.0), (2, 3, 1, "assistant", "b", 1.0)]
    m = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    paths = {(r.conv_id, r.leaf_id): (r.path, r.score) for r in chat.root_paths(m).collect()}
    assert paths == {(1, 2): ([1, 2], 2.0), (1, 4): ([1, 3, 4], 1.5), (1, 5): ([5], 0.0), (2, 2): ([1, 2], 1.0), (2, 3): ([1, 3], 1.0)}
    best = {(r.conv_id, r.root_id): r.leaf_id for r in chat.format_trees(m).collect()}
    assert best == {(1, 1): 2, (1, 5): 5, (2, 1): 2}
    assert chat.format_trees(m, best=None).count() == 5


def test_scores(odd, none):
    rows = [(r[0], r[1]) for r in odd_rows()]
    tokens = [((t or "").translate(LOW).encode().split() + [None], zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2) for i, t in rows]
    count = Counter(w for ws, held in tokens if not held for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), held, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _), (ws, held) in zip(rows, tokens))
    got = lm_scoring.score_texts(odd).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm_scoring.score_texts(none).count() == 0


def test_automaton_sums_to_one():
    rng = np.random.default_rng(0)
    bits = lm_scoring.SYMBOL_BITS
    text = [rng.choice([0, 3, 4, 5, 6], p=[0.3, 0.3, 0.2, 0.1, 0.1], size=12).tolist() + [lm_scoring.END] for _ in range(200)]
    tokens = np.array([w for t in text for w in t])
    starts = np.arange(200) * 13
    uni = Counter(tokens.tolist())
    grams = []
    for order in (2, 3):
        keys = lm_scoring.ngram_keys(tokens, starts, order)
        k, c = np.unique(keys[keys >= 0], return_counts=True)
        grams.append((k[c >= 3], c[c >= 3]))
    model = lm_scoring.build_automaton(np.arange(4, dtype=np.uint64), np.array([uni[w] for w in (3, 4, 5, 6)]), grams, 200, uni[0], 9, 14)
    for history in ([], [3], [3, 4], [0, 0], [6, 5, 3]):
        before = lm_scoring.traverse(history, model)
        total = sum(10 ** (lm_scoring.traverse([*history, w], model) - before) for w in (0, 1, 3, 4, 5, 6))
        assert total == pytest.approx(1.0, abs=1e-9)
    assert all(a >> bits < len(model.fail) for a in model.arcs)


def test_mix_function_is_inverted():
    from phasefold.llm import kernels

    x = np.random.default_rng(3).integers(0, 2**63, 1000).astype(np.uint64)
    assert (lm_scoring.unmix64(kernels.mix64(x)) == x).all()


def test_held_out_texts_are_predicted_better_than_by_the_base(spark):
    got = queries.QUERIES["op7_lm_scores"](spark, "/root/testdata/sf0.001").filter("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens_add_up(odd, none, rule):
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    got = token_counts.section_tokens(odd, path, rule).toPandas()
    assert len(got) == sum((r[1] or "").count("\n") + 1 for r in odd_rows())
    assert (got.n_bytes >= 0).all()
    unique = got[got.doc_id == 20]
    assert unique.tokens.sum() == pytest.approx(unique.doc_tokens.iloc[0])
    assert token_counts.section_tokens(none, path, rule).count() == 0


def test_allocation_rules():
    sizes, starts = np.array([4, 4, 2]), np.array([0, 5, 5, 9])  # tokens 0-4, 4-8, 8-10 over sections 0-5, empty, 5-9, 9-10
    want = {"start": [2, 0, 1, 0], "end": [1, 0, 1, 1], "longest": [1, 0, 2, 0], "share": [1.25, 0, 1.25, 0.5]}
    for rule, counts in want.items():
        got, crossing = token_counts.allocate(sizes, starts, 10, rule)
        assert got.tolist() == pytest.approx(counts) and crossing.tolist() == [1, 1, 2, 1]


def test_fields_are_lines(odd):
    got = token_counts.field_tokens(odd.select("doc_id", "text", "lang"), ["lang", "text"], queries.vocabulary("byte_bpe_50k.tiktoken"))
    assert {r.field for r in got.select("field").distinct().collect()} == {"lang", "text"} and got.count() == 2 * len(odd_rows())


def check_pieces(pieces, expected):
    """Every document's ids lie in exactly one piece each, sequences are gapless and hold at most 2048."""
    got = sorted((str(i), tuple(ids)) for i, ids in expected)
    by_seq, docs = {}, {}
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
        docs.setdefault((str(p.doc_id), p.doc_tokens), []).append((p.start, tuple(np.frombuffer(p.ids, "<u4").tolist())))
    padding = total = 0
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    count = Counter()
    for i, ids in got:
        count[i] += len(ids)
    assert total == sum(count.values())
    assert padding <= 0.02 * total + 1
    return docs


def test_packing(odd, none):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rows = [(i, r[1]) for i, r in enumerate(odd_rows())]
    expected = {str(i): tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,) for i, t in rows}
    docs = odd.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = check_pieces(packing.pack(docs, path).collect(), list(expected.items()))
    for (doc, n), parts in pieces.items():
        assert n == len(expected[doc])
        assert tuple(x for _, ids in sorted(parts) for x in ids) == expected[doc]
    assert packing.pack(odd, path).groupBy().agg(F.sum("length")).first()[0] == sum(len(packing_ids) for packing_ids in [
        tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (1,) for r in odd_rows()])
    assert packing.pack(none, path).count() == 0


def test_cutting_stock_is_near_the_bound():
    rng = np.random.default_rng(4)
    sizes, demand = np.unique(rng.integers(3, 60, 5000), return_counts=True)
    patterns, use = packing.cutting_stock(sizes, demand.astype(float), 100)
    assert (patterns @ sizes <= 100).all() and np.allclose(patterns.T @ use, demand, rtol=1e-6)
    assert use.sum() <= 1.01 * max((sizes * demand).sum() / 100, 1)
    plan = packing.integer_plan(sizes, demand, 100, 0.05)
    used = sum(n * p for p, n in plan)
    assert (used <= demand).all() and used.sum() > 0.9 * demand.sum()


def one_piece_scores(rows, least=2):
    """Scores by the automaton of all counts in one place."""
    texts = [((t or "").translate(LOW).encode().split(), zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2) for i, t in rows]
    count = Counter(w for ws, held in texts for w in ws if not held)
    names = sorted(w for w, c in count.items() if c >= least)
    code = {w: k for k, w in enumerate(names, lm_scoring.FIRST)}
    coded = [[code.get(w, lm_scoring.RARE) for w in ws] + [lm_scoring.END] for ws, _ in texts]
    trained = [c for c, (_, held) in zip(coded, texts) if not held]
    grams = []
    for order in (2, 3):
        keys = [lm_scoring.ngram_keys(np.array(c), np.zeros(1, np.int64), order) for c in trained]
        k, c = np.unique(np.concatenate(keys), return_counts=True)
        grams.append((k[(c >= least) & (k >= 0)], c[(c >= least) & (k >= 0)]))
    rare = [c for c in count.values() if c < least]
    model = lm_scoring.build_automaton(np.arange(len(names), dtype=np.uint64), np.array([count[w] for w in names], np.int64), grams, len(trained), sum(rare), len(rare), len(count) + 1)
    below = lambda w: math.log10(count[w] + 1) - model.rare_base
    return [lm_scoring.traverse(c, model) + sum(below(w) for w in ws if w not in code) for c, (ws, _) in zip(coded, texts)]


def test_scores_of_the_exchanges_are_those_of_one_automaton(odd):
    rows = [(r[0], r[1]) for r in odd_rows()]
    want = sorted((str(i), round(s, 6)) for (i, _), s in zip(rows, one_piece_scores(rows)))
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in lm_scoring.score_texts(odd).collect()) == want


def test_a_phrase_seen_twice_counts_in_a_large_corpus(spark):
    """Two of 400 000 tokens are below any share, and still the phrase is in the model."""
    rng = np.random.default_rng(8)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2][:42]
    held = next(i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 50, 10_000).tolist())) for i in ids[:40]]
    rows += [(ids[40], "w1 amber bridge crossing w2"), (ids[41], "w3 amber bridge crossing w4"), (held, "amber bridge crossing")]
    got = {r.doc_id: r.score for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for (i, _), s in zip(rows, one_piece_scores(rows)):
        assert got[i] == pytest.approx(s, rel=1e-9)


def test_a_written_table_leaves_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in (folders.getAllFiles().apply(i).getName() for i in range(folders.getAllFiles().size())) if f.startswith("shuffle_")}
    before, setting = shuffled(), spark.conf.get(common.CLEANUP, None)
    table = common.materialize(spark.range(1000).repartition(4, "id"), "moved")
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and spark.conf.get(common.CLEANUP, None) == setting
    assert table.count() == 1000


def test_exchanged_arrays_compress_and_come_back():
    rng = np.random.default_rng(3)
    for values in (np.sort(rng.integers(0, 2**58, 10_000).astype(np.uint64)), rng.integers(0, 3, 10_000), rng.random(100), np.zeros(0, np.uint32)):
        packed = blocks.planes(values)
        assert blocks.unplaned(pa.array([packed, None]), values.dtype)[0].tolist() == values.tolist()
        if len(values) == 10_000:
            assert len(pa.compress(packed, "lz4", asbytes=True)) < 0.9 * len(pa.compress(values.tobytes(), "lz4", asbytes=True))


def test_ids_below_65536_travel_as_two_bytes(spark, odd, monkeypatch):
    path, written = queries.vocabulary("word_bpe_49k.json"), []
    plain = packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, label: (written.append(t) if label == "tokens" else None, t)[1] if (t := plain(df, label)) else None)
    narrow = sorted(map(tuple, packing.pack(odd, path).collect()), key=str)
    assert written[0].filter("length(ids) <> 2 * n_tokens").isEmpty()
    monkeypatch.setattr(packing, "id_type", lambda tokenizer: "<u4")
    assert narrow == sorted(map(tuple, packing.pack(odd, path).collect()), key=str)
    assert all(len(r[-1]) == 4 * r[2] for r in narrow)


def test_shrunk_arrays_are_smaller_and_come_back():
    rng = np.random.default_rng(9)
    keys, counts = np.sort(rng.integers(0, 2**64, 10_000, np.uint64)), rng.geometric(0.7, 10_000)
    for values, ascending, share in ((keys, True, 0.99), (counts, False, 0.6), (rng.random(100), False, 1), (np.zeros(0, np.uint32), True, 1)):
        sent = blocks.shrunk(values, ascending)
        assert blocks.unshrunk(pa.array([sent, None]), values.dtype, ascending)[0].tolist() == values.tolist()
        if len(values) == 10_000:
            assert len(sent) < share * len(pa.compress(blocks.planes(values), "lz4", asbytes=True))


def test_distinct_keys_are_those_of_numpy():
    rng = np.random.default_rng(10)
    close = np.array([7, 5, 7, 6, 5], np.uint64)
    for keys in (close, close | np.uint64(1 << 63), np.concatenate([close, [2**63]]).astype(np.uint64), np.zeros(3, np.uint64), np.zeros(0, np.uint64), rng.integers(0, 2**64, 3000, np.uint64)[rng.integers(0, 3000, 9000)]):
        want = np.unique(keys, return_index=True, return_inverse=True)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks.distinct(keys), want))


def test_answers_of_earlier_levels_are_not_moved_again(odd):
    plan = lm_scoring.score_texts(odd)._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(moves) == 2 and "bucket" in moves[1] and "block" in moves[0], plan
    assert plan.count("Bucketed: true") == 8, plan
