import os
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from phasefold.llm import merkle, mixing
from tests.llm.conftest import odd_rows
from tools.check_oracles import TABLES, compare

SF = "/root/testdata/sf0.001"


def targets_by_hand(sizes):
    """Water filling: share by weight, stop at twice the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rate = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if rate * weight[s] > 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in full else rate * weight[s] for s in names}
        full |= set(over)


def test_targets_and_takes(odd, none):
    sizes = defaultdict(int)
    for r in odd_rows():
        sizes[r[3]] += len((r[1] or "").encode().split())
    want = targets_by_hand(sizes)
    got = mixing.taken_words(odd).join(odd.select(F.col("doc_id").alias("d"), "source").distinct(), F.col("doc_id").eqNullSafe(F.col("d")), "left").collect()
    rows = mixing.taken_words(odd).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    taken = defaultdict(int)
    for r in rows:
        taken[r.target] += r.taken
    for s, t in want.items():
        assert any(abs(t - x) < 1e-6 and abs(taken[x] - x * sum(abs(w - x) < 1e-9 for w in want.values())) <= len(want) for x in taken), (s, t, dict(taken))
    assert got
    assert mixing.taken_words(none).count() == 0


def test_shards_are_even_and_draws_disjoint(odd):
    rows = mixing.document_rows(odd, "doc_id", "text", "source")
    mix, _ = mixing.mix(rows, shard_words=2000, block_words=16)
    drawn = mix.collect()
    shards = defaultdict(list)
    for r in drawn:
        shards[r.shard].append(r.position)
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(p) == list(range(len(p))) for p in shards.values())
    assert len({(r.row, r.block, r["pass"]) for r in drawn}) == len(drawn)
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, mixing.mix(rows, shard_words=2000, block_words=16)[0].collect()))


def test_hypergeometric_moments(spark):
    u = "(cast(xxhash64(id) & 9007199254740991L AS double) / 9007199254740992D)"
    for p, k, n in ((1000, 300, 100), (50, 50, 20), (40, 3, 0), (10, 4, 9), (10**8, 4 * 10**7, 10**5)):
        x = spark.range(4000).select(F.expr(mixing.hypergeometric_sql(f"{p}D", f"{k}D", f"{n}D", u)).alias("x"))
        r = x.agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
        var = n * k / p * (1 - k / p) * (p - n) / (p - 1)
        assert r.lo >= max(0, n + k - p) and r.hi <= min(n, k)
        assert r.m == pytest.approx(n * k / p, abs=5 * (var / 4000) ** 0.5 + 1e-9) and r.v == pytest.approx(var, rel=0.15, abs=1e-9)


def test_mixed_documents_have_the_same_columns(odd, none):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    words = sum(len((r.text or "").encode().split()) for r in out.collect())
    assert words == pytest.approx(1.5 * sum(len((r[1] or "").encode().split()) for r in odd_rows()), abs=5)
    assert mixing.mixed_documents(none).count() == 0


def archive(spark, n, file=lambda i: f"f{i % 3}"):
    return spark.createDataFrame([(file(i), i, bytes([65 + i % 26]) * (i % 50 + 1)) for i in range(n)], "file string, record_id long, data binary")


def test_audit_finds_just_the_damage(spark):
    one = archive(spark, 3000)
    other = one.withColumn("data", F.when(F.col("record_id").isin(7, 700, 2999), F.concat(F.expr("substring(data, 1, octet_length(data) - 1)"), F.lit("!").cast("binary"))).otherwise(F.col("data")))
    found = merkle.audit(merkle.lay_out(one), merkle.lay_out(other)).collect()
    assert sorted(r.record_id for r in found) == [7, 700, 2999]
    assert all(r.digest != r.other_digest and r.offset == r.other_offset for r in found)
    assert merkle.audit(merkle.lay_out(one), merkle.lay_out(one)).count() == 0


def test_missing_records_empty_and_null(spark):
    one = archive(spark, 100, lambda i: None if i % 2 else "f")
    assert merkle.audit(merkle.lay_out(one), merkle.lay_out(one.filter("record_id <> 99"))).filter("other_digest IS NULL").count() == 1
    empty = one.limit(0)
    assert merkle.audit(merkle.lay_out(empty), merkle.lay_out(empty)).count() == 0
    assert merkle.audit(merkle.lay_out(one), merkle.lay_out(empty)).count() == 100


def test_record_bytes(spark):
    r = spark.createDataFrame([("http://a/", "é", 5), (None, None, None)], "u string, h string, i long").select(merkle.warc_record(F.col("u"), F.col("h"), F.col("i")).alias("r")).collect()
    assert bytes(r[0].r).endswith(b"Content-Length: 2\r\n\r\n" + "é".encode() + b"\r\n\r\n") and b"Content-Length: 0" in bytes(r[1].r)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["op2_exact_dedup", "op3_minhash_near_dedup", "op4_mix_sources", "op8_warc_fixity", "op10_chat_format"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    line = compare(spark, name, SF, con)
    assert line.startswith("ok"), line


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as cp
    from phasefold.llm.common import materialize
    from tests.llm.test_dedup import lower, near_components
    from tests.llm.test_texts import check_pieces, measures

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
        if name != "pack_sequences":
            assert docs.columns == before.columns
    before, after = (x.collect() for x in seen["quality_rules"])
    fine = {r.doc_id for r in before if (m := measures(r.text))[0] >= 10 and 100 * m[4] <= 20 * m[0]}
    assert {r.doc_id for r in after} <= fine
    before, after = (x.collect() for x in seen["exact_dedup"])
    best = {}
    for r in before:
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(best.values())
    before, after = (x.collect() for x in seen["near_dedup"])
    rows = [(r.doc_id, r.text) for r in before]
    _, root = near_components(rows, 80)
    assert sorted(r.doc_id for r in after) == sorted({min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]) for i in range(len(rows))})
    before, after = (x.collect() for x in seen["mix_sources"])
    count = lambda rows: sum(len(r.text.encode().split()) for r in rows)
    assert count(after) == pytest.approx(1.5 * count(before), abs=25)
    from tokenizers import Tokenizer

    from phasefold.llm import queries

    tokenizer = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    check_pieces(docs.collect(), [(r.doc_id, tokenizer.encode(r.text, add_special_tokens=False).ids + [1]) for r in after])
