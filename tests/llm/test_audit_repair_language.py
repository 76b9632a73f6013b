import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from phasefold.llm import filter_audit, language_id, queries, repair
from tests.llm.conftest import odd_rows

# ------------------------------------------------------------------ filter audit


def plain_mask(text, doc, smallest):
    words = text.encode().split()
    mask = (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1
    mask |= (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) << 2 | bool(re.search(r"[#$%&*|]", text)) << 3
    return mask | (doc is not None and smallest is not None and doc > smallest) << 4


def plain_masks(rows):
    smallest = {}
    for doc, text in rows:
        if doc is not None:
            smallest[text] = min(doc, smallest.get(text, doc))
    return [plain_mask(text, doc, smallest.get(text)) for doc, text in rows]


def test_masks_match_brute_force_at_every_block_and_range_size(odd):
    rows = [(r[0], r[1] or "", r[2] or "") for r in odd_rows()]
    want = Counter((d, p, m) for (d, _, p), m in zip(rows, plain_masks([r[:2] for r in rows])))
    for block, limit in ((filter_audit.BLOCK, filter_audit.LIMIT), (64, 64), (2000, 3000)):
        got = filter_audit.failed_masks(odd, block_bytes=block, limit=limit).collect()
        assert Counter((r.doc_id, r.part, r["mask"]) for r in got) == want


def test_all_orders_match_brute_force(spark, odd):
    labels = spark.createDataFrame([(0, 1, 1), (0, 0, None), (3, 1, 0), (4, None, 1), (7, 0, 1), (7, 1, 1), (15, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    good = {0, 3, 7, 15}
    toxic = {0, 4, 7, 15}
    rows = [(r[0], r[1] or "", r[2] or "") for r in odd_rows()]
    masks = plain_masks([r[:2] for r in rows])
    want = {}
    for part in {p for *_, p in rows}:
        inside = [(d, m) for (d, _, p), m in zip(rows, masks) if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            before = 0
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [d for d, m in inside if m & bit and not m & before]
                shapley[letter] += len(gone)
                want[part, "".join(order), step] = [
                    sum(not m & (before | bit) for _, m in inside), len(gone), sum(bool(m & bit and m & before) for _, m in inside), sum(m == bit for _, m in inside),
                    sum(d in good for d in gone), sum(d in toxic for d in gone), letter]
                before |= bit
        for key, values in want.items():
            if key[0] == part:
                values[6] = shapley[values[6]]
    got = filter_audit.audit(odd, labels).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want
    assert len(got) == len(want)


def test_audit_of_nothing(none):
    assert filter_audit.audit(none).count() == 0


def test_trie_holds_whole_texts_and_smallest_keys():
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(400)]
    trie = filter_audit.RadixTrie()
    nodes = [trie.insert(t, k) for k, t in reversed(list(enumerate(texts)))][::-1]
    found = list(trie.traverse())
    assert [t for t, _ in found] == sorted(set(texts))
    assert all(trie.lowest[n] == texts.index(t) for t, n in found)
    assert all((nodes[i] == nodes[j]) == (texts[i] == texts[j]) for i in range(60) for j in range(60))


def test_prefixes_lengthen_until_they_fit(spark):
    shared = "the same long beginning of many texts "
    rows = [(shared + str(i) + "x" * 40,) for i in range(300)] + [("one text " * 30,)] * 20
    texts = spark.createDataFrame(rows, "text string").selectExpr("cast(text AS binary) AS text")
    ranged, total = filter_audit.with_prefixes(texts, limit=1000)
    groups = ranged.groupBy("prefix").agg({"text": "count"}).collect()
    assert total == sum(len(t) for t, in rows) and max(len(g.prefix) for g in groups) > len(shared)
    assert sorted(g["count(text)"] for g in groups)[-1] == 20


# ------------------------------------------------------------------ conversation repair


def exhaustive(initials, faults):
    """All edit sequences with up to three inserts."""
    best = None

    def go(i, roles, audit, cost, inserts):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(initials) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        if inserts < 3:
            for role in "ua":
                go(i, roles + role, audit + "I", cost + 2, inserts + 1)
        if i < len(initials):
            go(i + 1, roles, audit + "D", cost + 3, inserts)
            if faults[i] not in "bd":
                extra = faults[i] == "t"
                go(i + 1, roles + initials[i], audit + "K", cost + extra, inserts)
                for role in "ua":
                    go(i + 1, roles + role, audit + "R", cost + 2 + extra, inserts)

    go(0, "", "", 0, 0)
    return best


def test_search_finds_the_least_cheapest_audit():
    rng = random.Random(1)
    for n in range(5):
        for _ in range(40):
            case = "".join(rng.choices("suau?", k=n)), "".join(rng.choices("..tbd", k=n))
            assert repair.cheapest(*case) == exhaustive(*case), case


def test_chained_segments_equal_one_search():
    rng = random.Random(3)
    for n, cut in ((7, 2), (40, 7), (300, 64)):
        i, f = "".join(rng.choices("suauaua?", k=n)), "".join(rng.choices("....tbd", k=n))
        parts = [(i[k:k + cut], f[k:k + cut]) for k in range(0, n, cut)]
        answers = ({(a, b): x for a in range(4) for b in range(4) if (x := repair.cheapest(p, q, a, (b,)))} for p, q in parts)
        assert repair.chain(answers) == repair.cheapest(i, f)


SPACE = " \t\n\x0b\x0c\r"


def plain_report(rows):
    """Reports and digests of (conv, turn, role, text) rows, conversation by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv), key=lambda v: (v[0], v[1], v[2].encode(), v[3].encode()))
        faults, seen = "", set()
        for _, _, role, text in turns:
            bare = text.strip(SPACE)
            faults += "b" if not bare else "d" if (role, text) in seen else "." if bare[-1] in ".!?" else "t"
            seen.add((role, text))
        initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for _, _, r, _ in turns)
        known = [t for has, t, *_ in turns if has]
        cost, audit = repair.cheapest(initials, faults)
        left, state, rest = [], 0, iter(zip(initials, turns))
        for edit in audit:
            initial, turn = next(rest) if edit != "I" else ("", None)
            if edit == "D":
                continue
            spoken = initial if edit == "K" else repair.SPEAKER[state]
            left.append((turn[2] if edit == "K" else repair.ROLES[spoken]) + ":" + (turn[3] if turn else ""))
            state = repair.STEPS[state][spoken]
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def reported(rows):
    report, messages = repair.repair(rows)
    digests = {r.conv_id: r.repaired_sha256 for r in repair.message_digests(messages).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    got = report.collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.conv_id, nothing)) for r in got}


TURNS = "conv_id long, turn long, role string, text string, seq string, audit string, digest string"


def test_reports_match_brute_force(spark):
    rng = random.Random(4)
    texts = ["Yes.", "No", "Why? \n", "", " \t", None, "Same text.", "Same text.", "tail. \x1c", "é!"]
    rows = [(c, rng.choice([None, *range(8)]), rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None]), rng.choice(texts), "s", "a", "d")
            for c in [None, *range(60)] for _ in range(rng.randint(1, 9))]
    rows += [(900, None, "user", "Only nulls", "s", "a", "d"), (901, 5, "user", "x" * 200_000, "s", "a", "d")] + [(902, 1, "user", "Again.", "s", "a", "d")] * 5
    # one long conversation, which goes through segments
    rows += [(903, t, rng.choice(["user", "assistant", "system"]), rng.choice(texts) if t % 3 else f"Text {t}.", "s", "a", "d") for t in range(1500)]
    assert reported(spark.createDataFrame(rows, TURNS).repartition(5)) == plain_report([r[:4] for r in rows])


def test_repair_of_nothing(spark):
    report, messages = repair.repair(spark.createDataFrame([], TURNS))
    assert report.count() == 0 and messages.count() == 0


def test_messages_are_sound(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (2, 0, "system", "Be kind."), (2, 1, "user", "Hi."), (2, 2, "user", "Hi."), (2, 3, "assistant", "Yes.")]
    _, messages = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {}
    for r in sorted(messages.collect(), key=lambda r: (r.conv_id, r.place)):
        found.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    # two inserts cost as much as two new roles, and I comes before R
    assert found[1] == [("I", "user", ""), ("K", "assistant", "Hello."), ("K", "user", "Hi."), ("I", "assistant", "")]
    assert found[2] == [("K", "system", "Be kind."), ("K", "user", "Hi."), ("K", "assistant", "Yes.")]


def test_damage_follows_the_hash(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    got = Counter((r.conv_id, r.turn, r.role, r.text) for r in queries.damage_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(h, text)
        want[c, t, "user" if h == 4 else role, text] += {0: 0, 3: 2}.get(h, 1)
    assert got == +want


# ------------------------------------------------------------------ language identification


def speech(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


SYLLABLES = {"aa": ["the", "ing", "ou", "er"], "bb": ["ch", "ein", "ü", "er"], "cc": ["ción", "ñ", "os", "la"]}


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(7)
    rows = [(i, speech(rng, SYLLABLES[lang], rng.randint(3, 120)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=600))]
    rows += [(None, "?!", "aa"), (1000, None, "bb"), (1001, "", "cc"), (1002, "no language", None), (None, "the ing", "aa")]
    return language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), settings=language_id.Settings(shards=3))


def test_model_is_sparse_calibrated_and_right_on_new_texts(spark, model):
    rng = random.Random(8)
    rows = [(i, speech(rng, SYLLABLES[lang], rng.randint(2, 60)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=300))]
    got = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert len(got) == 300 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([rows[r.doc_id][2] == r.lang_pred for r in got]) > 0.98
    assert 0 < model.report["nonzero"] < 0.2 * model.weights.size and model.temperature > 0
    table = language_id.model_table(spark, model)
    assert table.count() == model.report["nonzero"] + len(model.languages)


def test_odd_texts_get_defined_answers(odd, none, model):
    got = language_id.predict(odd, model).collect()
    rows = odd_rows()
    assert len(got) == len(rows)
    blank = {r[0] for r in rows if not any(c.isalpha() for c in r[1] or "")}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == blank
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language_id.predict(none, model).count() == 0
    assert language_id.train(none) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}


def test_features_match_a_plain_count():
    texts = [" the über é ", "", " a ", " 中文 words "]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    slots, counts = language_id.slots_of(data, offsets)
    assert counts.tolist() == [sum(max(0, len(t) - n + 1) for n in (1, 2, 3)) for t in texts]
    grams = [t[i:i + n] for t in texts for n in (1, 2, 3) for i in range(len(t) - n + 1)]
    by_gram = {}
    assert all(by_gram.setdefault(g, s) == s for g, s in zip(grams, slots.tolist()))
    found, x = language_id.features(data, offsets, np.ones(1 << language_id.BITS))
    assert np.allclose((x * x).sum(axis=0), [1, 0, 1, 1])


def test_temperature_undoes_a_known_scale(spark):
    rng = np.random.default_rng(3)
    scores = rng.normal(size=(4000, 3)) * 2
    p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    labels = [int(rng.choice(3, p=q)) for q in p]
    held = spark.createDataFrame([(y, (5 * s).tolist()) for y, s in zip(labels, scores)], "label int, scores array<double>")
    assert 4.5 < language_id.calibrate(held) < 5.5
