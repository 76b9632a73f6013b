import hashlib
import random
import string
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasefold.llm import blocks, common, exact_dedup, kernels, near_dedup, suffix_dedup
from tests.llm.conftest import odd_rows

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def lower(text):
    return (text or "").translate(LOW)


def test_exact_groups_match_brute_force(odd, none):
    groups = defaultdict(list)
    for r in odd_rows():
        groups[lower(r[1])].append(r[0])
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == len(odd_rows())
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    stays = defaultdict(int)
    for r in got:
        ids = by_hash[r.text_sha256]
        real = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(real) if real else None)
        stays[r.text_sha256] += r.kept
    assert set(stays.values()) == {1}
    assert exact_dedup.exact_groups(none).count() == 0


def test_drop_copies_keeps_one_row_with_all_columns(odd, none):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    texts = [lower(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({lower(r[1]) for r in odd_rows()})
    assert exact_dedup.drop_copies(none).count() == 0


def test_smallest_can_stay(odd):
    got = {r.text_sha256: r.keep_id for r in exact_dedup.exact_groups(odd, keep="smallest", fan_in=2).collect()}
    base = next(r[1] for r in odd_rows() if r[0] == 15)
    assert got[hashlib.sha256(lower(base).encode()).hexdigest()] == 15


def shingles(text, k=5):
    words = lower(text).encode().split()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def near_components(rows, percent):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    parent[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def test_near_groups_match_brute_force(odd, none):
    rows = [(r[0], r[1]) for r in odd_rows()]
    for percent in (80, 85):
        sets, root = near_components(rows, percent)
        expect = sorted((str(rows[i][0]), len(sets[i]), str(min((rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None), default=None))) for i in range(len(rows)))
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_dedup.near_groups(odd, percent=percent).collect())
        assert got == expect
    assert near_dedup.near_groups(none).count() == 0


def test_one_row_of_each_near_group_stays(odd):
    rows = [(r[0], r[1]) for r in odd_rows()]
    sets, root = near_components(rows, 80)
    groups = {root[i] if sets[i] else ("alone", i) for i in range(len(rows))}
    kept = near_dedup.drop_near_copies(odd)
    assert kept.count() == len(groups) and kept.columns == odd.columns


def test_star_misses_are_found_in_blocks(spark):
    """A chain of near copies where each links to its neighbours only, so no single document links all."""
    words = [f"w{i}" for i in range(200)]
    texts = []
    for step in range(40):
        for k in range(4):
            words[(step * 4 + k) % 200] = f"s{step}k{k}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    _, root = near_components(list(enumerate(texts)), 85)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, percent=85).collect()}
    assert all(got[i] == min(j for j in range(40) if root[j] == root[i]) for i in range(40))


def test_a_large_group_emits_few_pairs(spark, monkeypatch):
    """Near copies of one text share many buckets with different smallest nodes; still each asks one partner a round."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(250):
        words = list(base)
        for i in rng.sample(range(300), 2):
            words[i] = f"c{rng.random()}"
        texts.append(" ".join(words))
    _, root = near_components(list(enumerate(texts)), 85)
    emitted = []
    plain = near_dedup.confirmed_links
    monkeypatch.setattr(near_dedup, "confirmed_links", lambda pairs, *rest: emitted.append(pairs.count()) or plain(pairs, *rest))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, percent=85).collect()}
    assert all(got[i] == min(j for j in got if root[j] == root[i]) for i in got)
    assert max(emitted) <= len(texts) and sum(emitted) <= 2 * len(texts)


def test_texts_just_apart_make_no_row_per_pair(spark, monkeypatch):
    """Copies of one text, every two of them a little below the threshold, so all pairs have to be confirmed and few are links."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(1000)]
    texts = []
    for n in range(100):
        words = list(base)
        for i in rng.sample(range(1000), 10):
            words[i] = f"c{rng.random()}"
        texts.append(" ".join(words))
        if n % 20 == 0:
            words[500] = "other"
            texts.append(" ".join(words))
    sets, root = near_components(list(enumerate(texts)), 85)
    assert len(set(root)) > 90 and 100 * len(sets[0] & sets[5]) > 80 * len(sets[0] | sets[5])
    emitted = []
    plain = near_dedup.confirmed_links
    monkeypatch.setattr(near_dedup, "confirmed_links", lambda pairs, *rest: emitted.append(pairs.count()) or plain(pairs, *rest))
    monkeypatch.setattr(near_dedup, "SET_NODES", 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, percent=85).collect()}
    assert all(got[i] == min(j for j in got if root[j] == root[i]) for i in got)
    assert max(emitted) <= 2 * len(texts)


def test_no_link_at_the_threshold_is_lost(spark):
    """Pairs of texts just above and below the threshold, many of them, through the whole operator."""
    rng = random.Random(9)
    docs = []
    for pair in range(150):
        words = [f"p{pair}w{i}" for i in range(rng.randint(60, 120))]
        other = list(words)
        first = rng.randrange(5, len(words) - 12)
        for i in range(first, first + rng.randint(1, 8)):
            other[i] = f"p{pair}x{i}"
        docs += [" ".join(words), " ".join(other)]
    _, root = near_components(list(enumerate(docs)), 85)
    assert 20 < sum(root[i] == root[i + 1] for i in range(0, 300, 2)) < 130
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), percent=85).collect()}
    assert all((got[i] == got[i + 1]) == (root[i] == root[i + 1]) for i in range(0, 300, 2))


def test_clashing_names_survive(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y")], "doc_id long, text string, _stay string").withColumn("_row", F.lit(1))
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_banding_misses_are_rare():
    for percent in (80, 85, 90):
        rows, bands = near_dedup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= near_dedup.MISS


def test_odd_sketch_limit_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    samples, bits = near_dedup.sample_count(85), 64 * near_dedup.SKETCH_WORDS
    limit = near_dedup.sketch_limit(85, samples)
    counts = []
    for similarity in [0.85] * 400 + [0.6] * 400:
        same = rng.random(samples) < similarity
        a = rng.integers(0, bits, samples)
        b = np.where(same, a, rng.integers(0, bits, samples))
        counts.append(int((np.bincount(a, minlength=bits) % 2 != np.bincount(b, minlength=bits) % 2).sum()))
    assert max(counts[:400]) <= limit < min(counts[400:])


def repeats(rows):
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            else:
                seen.add(raw[p:p + 100])
        g = np.frombuffer(bytes(gone), np.uint8).astype(int)
        out.append((str(rows[i][0]), len(raw), int(g.sum()), int((np.diff(np.concatenate([[0], g])) == 1).sum()), bytes(x for x, y in zip(raw, gone) if not y)))
    return out


def test_repeated_strings_match_brute_force(odd, none):
    # of rows with the same id either may come first, so ids are made unique here
    rows = [(i if r[0] is not None else None, r[1]) for i, r in enumerate(odd_rows()) if r[0] is not None or r[1] == "alone here"]
    docs = odd.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted(repeats(rows))
    assert suffix_dedup.remove_repeats(odd).count() == len(odd_rows())
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_many_blocks_agree_with_one(spark, monkeypatch):
    rows = [(i, r[1]) for i, r in enumerate(odd_rows())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted(repeats(rows))


@pytest.mark.parametrize("hot", [0, 2])
def test_anchors_with_many_segments_agree(spark, hot):
    rng = random.Random(6)
    line = "".join(rng.choices(string.ascii_lowercase, k=75))
    own = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.choice([5, 60])))
    rows = [(i, r[1]) for i, r in enumerate(odd_rows())] + [(None, odd_rows()[15][1])]
    rows += [(100 + i, own() + line + own() + ("tail of many " * 9)[:i % 120]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, hot=hot).collect())
    assert got == sorted(repeats(rows))


def test_a_frequent_line_spreads_over_buckets():
    """A line in 6 000 documents between differing neighbours: no bucket gets more than a few percent of what is sent, with an anchor's bound far below its segments."""
    import pyarrow as pa

    hot = 200
    rng = random.Random(7)
    line = "".join(rng.choices(string.ascii_lowercase, k=75))
    texts = ["".join(rng.choices(string.ascii_lowercase, k=60)) + line + "".join(rng.choices(string.ascii_lowercase, k=60)) for _ in range(6000)]
    block = pa.Table.from_batches([pa.record_batch({
        "block": pa.array([0]), "ids": pa.array([list(range(6000))], pa.list_(pa.int64())), "sizes": pa.array([np.full(6000, 195, np.int64).tobytes()], pa.binary()),
        "text": pa.array(["".join(texts).encode()], pa.binary()), "n_bytes": pa.array([195 * 6000])})])
    sent = pa.Table.from_batches(list(suffix_dedup.send_anchors(5)(iter(block.to_batches()))))
    groups = [sent.filter(pa.compute.equal(sent.column("bucket"), b)) for b in sorted(set(sent.column("bucket").to_pylist()))]
    answers = pa.concat_tables([suffix_dedup.find_repeated(hot)(g) for g in groups])
    out = suffix_dedup.send_segments(5, 6, 6)(block, answers).to_pylist()
    load = defaultdict(int)
    for r in out:
        load[r["bucket"]] += len(r["text"])
    assert sum(load.values()) > 1_000_000 and max(load.values()) < 0.05 * sum(load.values())


def cut_without_spark(rows, hot, bits=3):
    """The steps of remove_repeats on one table, and the rows sent to suffix buckets."""
    import pyarrow as pa
    import pyarrow.compute as pc

    by = lambda t, name: [t.filter(pc.equal(t.column(name), x)) for x in sorted(set(t.column(name).to_pylist()))]
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    blocks = pa.Table.from_batches(list(suffix_dedup.make_blocks(iter(table.to_batches(max_chunksize=7)))))
    sent = pa.Table.from_batches(list(suffix_dedup.send_anchors(bits)(iter(blocks.to_batches()))))
    repeated = pa.concat_tables([suffix_dedup.find_repeated(hot)(g) for g in by(sent, "bucket")])
    of = lambda t, b: t.filter(pc.equal(t.column("block"), b.column("block")[0]))
    sent = pa.concat_tables([suffix_dedup.send_segments(bits, bits, bits)(b, of(repeated, b)) for b in by(blocks, "block")])
    masks = pa.concat_tables([suffix_dedup.sort_bucket(g) for g in by(sent, "bucket")])
    answers = pa.concat_tables([repeated.select(["block", "bucket", "bits", "hot"]), masks], promote_options="default")
    return pa.concat_tables([suffix_dedup.cut_texts(bits, bits)(b, of(answers, b)) for b in by(blocks, "block")]).to_pylist(), sent


@pytest.mark.parametrize("hot", [0, 3, 4096])
@pytest.mark.parametrize("piece,block", [(1 << 17, 16 << 20), (700, 9_000), (100, 400)])
def test_pieces_and_edges_agree_with_brute_force(monkeypatch, hot, piece, block):
    """Documents longer and shorter than a piece, windows that touch, documents that go whole side by side, texts of 99 to 101 bytes, few letters."""
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(8)
    of = lambda n, letters="ab": "".join(rng.choices(letters, k=n))
    passages = [of(n, string.ascii_lowercase) for n in (40, 99, 100, 101, 130, 200, 310)] + [of(60) * 3, "é" * 70]
    texts = ["".join(rng.choices(passages, k=rng.randint(1, 6))) + of(rng.choice([0, 3, 90])) for _ in range(60)]
    texts += [passages[2], passages[2], passages[3], passages[1], passages[1], None, "", passages[2] + "-" + passages[2], of(2000), of(2000)]
    texts += [passages[2] + passages[4][:100] + passages[2], texts[0], texts[0], texts[3]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, r[1]) for i, r in enumerate(odd_rows())]
    got, _ = cut_without_spark(rows, hot)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in got) == sorted(repeats(rows))
    raw = {i: (t or "").encode() for i, t in rows}
    for r in got:
        cut = [0, *(x for ends in zip(r["starts"], r["ends"]) for x in ends), r["n_bytes"]]
        assert b"".join(raw[r["doc_id"]][a:b] for a, b in zip(cut[::2], cut[1::2])) == r["kept"]


def test_a_bucket_reads_each_row_once(monkeypatch):
    """The rows of a bucket, one a block, grow with the corpus: reading all of them for each of them made time grow with its square."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2_000)
    rng = random.Random(9)
    own = lambda n: "".join(rng.choices(string.ascii_lowercase, k=n))
    shared = own(700)
    _, sent = cut_without_spark([(i, own(1500) + shared[i:] + own(60)) for i in range(120)], suffix_dedup.HOT, 1)
    buckets = [sent.filter(sent.column("bucket").to_numpy() == b) for b in set(sent.column("bucket").to_pylist())]
    read = []
    packed = suffix_dedup.packed
    monkeypatch.setattr(suffix_dedup, "packed", lambda column, dtype: read.append(len(column)) or packed(column, dtype))
    for bucket in buckets:
        suffix_dedup.sort_bucket(bucket)
    assert sent.num_rows >= 200 and sum(read) <= 4 * sent.num_rows


def test_equal_segments_are_not_sorted(monkeypatch):
    """A passage in many documents is one segment an anchor; only suffixes at its edges, whose segments differ, are sorted."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4_000)
    rng = random.Random(10)
    own = lambda n: "".join(rng.choices(string.ascii_lowercase, k=n))
    passage = own(3000)
    rows = [(i, own(150) + passage + own(150)) for i in range(20)]
    seen = []
    sort = getattr(suffix_dedup, "sort_suffixes", None)
    monkeypatch.setattr(suffix_dedup, "sort_suffixes", lambda text, counts, *more: seen.append(int(counts.sum())) or sort(text, counts, *more))
    got, _ = cut_without_spark(rows, suffix_dedup.HOT)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in got) == sorted(repeats(rows))
    assert sum(seen) < 5 * 20 * suffix_dedup.SPAN


def test_window_buckets_follow_the_windows_there_are(spark, monkeypatch):
    """A corpus without frequent anchors asks for no buckets of window hashes, whatever its size."""
    asked = []
    monkeypatch.setattr(suffix_dedup, "WINDOWS", 10)
    monkeypatch.setattr(suffix_dedup, "key_bits", lambda keys, per_bucket, least: asked.append(keys / per_bucket) or blocks.key_bits(keys, per_bucket, least))
    suffix_dedup.remove_repeats(spark.createDataFrame([(i, f"{i} " * 300) for i in range(20)], "doc_id long, text string"))
    assert min(asked) == 0


def test_cover_has_every_difference():
    m = suffix_dedup.MODULUS
    assert {(a - b) % m for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(m))


def test_word_kernel_on_edges():
    import pyarrow as pa

    texts = ["a b  c", "", None, " x", "x ", "\x0ba\x0c", "É é"]
    data, offsets = kernels.text_buffers(pa.array(texts))
    assert kernels.words(data, offsets)[2].tolist() == [3, 0, 0, 1, 1, 1, 2]
    hashes, _ = kernels.word_hashes(data, offsets)
    assert hashes[3] == hashes[4] and hashes[0] == hashes[5] and len(set(hashes.tolist())) == 6


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, near_dedup.drop_near_copies])
def test_texts_that_stay_are_not_shuffled(odd, drop):
    kept = drop(odd)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "text#" in line]
    assert len(scans) == 1 and "Bucketed: true" in scans[0], plan
    assert plan.count("Exchange") == 1, plan


def test_rows_of_several_runs_are_dropped_by_number(spark, monkeypatch):
    monkeypatch.setattr(common, "RUN_BITS", 3)
    docs = spark.range(200, numPartitions=3).select(F.col("id").alias("_row"), F.lit("x").alias("_gone"))
    table, row, run = common.numbered(docs, "rows")
    lost = table.filter("_row % 7 = 1 OR _row BETWEEN 40 AND 60").select(row)
    got = sorted(r._row for r in common.without_rows(table, row, run, lost).collect())
    assert got == [i for i in range(200) if i % 7 != 1 and not 40 <= i <= 60]
    assert common.without_rows(table, row, run, lost.filter("false")).columns == docs.columns
