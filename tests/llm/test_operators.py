"""The ten operators on odd rows, and against brute force on small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryloom.llm import chat, exact, language, licenses, lm, merkle, mixing, neardup, packing, pii, queries, tokens

SF = "/root/testdata/sf0.001"
LONG = "alpha beta gamma delta " * 30_000
ODD = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, "one", None, "a"),
    (4, "12345 !!", "fr", "b"),
    (5, "the same words are here again and again for all of us to read", "en", "a"),
    (5, "the same words are here again and again for all of us to read", "en", "a"),
    (6, "the same words are here again and again for all of us to read", "en", "a"),
    (7, "the same words are here again and again for all of us to see", "en", "b"),
    (8, LONG, "en", None),
    (None, "no id at all", "de", "c"),
    (9, "mail a.b@c.example.com_d@e.fr +1 (415) 555-2671 10.0.0.256 10.0.0.255 4111 1111 1111 1111", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, size int, next string, target string, n int, path string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, "p") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


PER_DOCUMENT = [mixing.mix, language.identify, neardup.near_duplicates, exact.dedup, pii.find_personal_data, lm.score, merkle.fingerprint_edits, licenses.scan_licenses]


@pytest.mark.parametrize("operator", PER_DOCUMENT, ids=lambda f: f.__name__)
def test_odd_rows_each_give_one(odd, none, operator):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in operator(odd).collect())
    assert got == sorted((r[0] is None, r[0] or 0) for r in ODD)
    assert operator(none).count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_mix_targets_and_totals(spark, docs):
    rows = [r.asDict() for r in queries.op1_mix_sources(spark, SF).collect()]
    again = [r.asDict() for r in queries.op1_mix_sources(spark, SF).collect()]
    key = lambda r: r["doc_id"]
    assert sorted(rows, key=key) == sorted(again, key=key)
    sizes, source = {}, {d[0]: d[3] for d in docs}
    for i, t, _, s in docs:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, rest, left = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = rest / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(target[s] for s in over)
        left -= over
    target |= {s: level * weight[s] for s in left}
    taken, largest = dict.fromkeys(order, 0), dict.fromkeys(order, 0)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in order)


def test_language_held_out_accuracy(spark, docs):
    lang = {d[0]: d[2] for d in docs}
    rows = [r for r in queries.op2_language(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.97


def test_language_of_nothing(odd):
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd).collect()}
    assert got[1] == got[2] == got[4] == "und" and got[8] != "und"


def test_every_label_is_learned(spark):
    rows = [(i, f"l{i % 66}", f"text {i} of {chr(97 + i % 26) * 9} {chr(97 + i % 25) * 9}") for i in range(132)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"), F.lit(True))
    assert sorted(x for names in model.members for x in names) == sorted({r[1] for r in rows})


@pytest.mark.parametrize("lang", [None, "en"])
def test_documents_in_a_language_row_by_row(spark, lang):
    rows = [(None, "words under a null id"), (None, "12 !!"), (None, None), (4, "words under a repeated id"), (4, "34"), (6, "more words")]
    docs = spark.createDataFrame([(i, t, lang, "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = language.documents_in_a_language(docs)
    assert got.columns == docs.columns
    assert sorted(r["text"] for r in got.collect()) == ["more words", "words under a null id", "words under a repeated id"]


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_path())
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t, _, _ in docs}
    rows = queries.op3_pack(spark, SF).collect()
    covered, sequences = {}, {}
    for r in rows:
        piece = want[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert zlib.crc32(piece) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]]) // 4
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == {i: len(x) // 4 for i, x in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert 1 - sum(covered.values()) / (2048 * len(sequences)) < 0.03


def test_packing_odd_rows(odd, none):
    assert packing.pack_documents(odd).filter("doc_id = 5").count() == 2
    assert packing.pack_documents(none).count() == 0


def test_token_ids_equal_the_tokenizers():
    ids = tokens.ids_of(tokens.default_path())
    for t in ["a<|endoftext|>b", "x   y\x85z\x1cq", "  \n\n a  b\t\tc ", "don't 's  's", "é 日本語 12 ３ 😀", "", "\x1c\x1d a"]:
        assert ids.one(t) == np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_words_encoded_together_equal_words_alone(docs):
    ids = tokens.ids_of(tokens.default_path())
    some = sorted({w for _, t, _, _ in docs for w in words(t)})[:20_000]
    for ws in (some, ["a\xa0b", "c", "\u2003d", "<|endoftext|>x", "e\x1cf", "it's", "'s", "12ab!", "é日本", "�", "g"], ["one"], []):
        flat, per = ids.words(ws)
        assert [flat[at - n : at].tobytes() for at, n in zip(np.cumsum(per), per, strict=True)] == [ids.one(" " + w) for w in ws]
    flat, per = lm.subwords([b" ", b"ab", b" ", b"cd", b" "], tokens.default_path(), 50256)
    assert flat.tobytes() == b"".join(np.array([50256], "<u4").tobytes() + (ids.one(" " + w) if w else b"") for w in ("ab", "cd", "")) and per.sum() == len(flat) and list(per[::2]) == [1, 1, 1]


def shingles(text, size):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def components_by_force(docs, size, percent):
    sets = [(i, shingles(t, size)) for i, t in docs]
    of = {i: i for i, _ in docs}
    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                old, new = max(of[a], of[b]), min(of[a], of[b])
                of = {k: new if v == old else v for k, v in of.items()}
    return of


@pytest.mark.parametrize(("small", "piece"), [(0, 1024), (0, 16), (3, 16), (1000, 1024)])
def test_near_duplicates_of_a_large_loose_group_equal_brute_force(spark, monkeypatch, small, piece):
    """Members of one group, less and more alike than the threshold: by differences (large buckets, whole or in pieces) as by pairs (small ones)."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "PIECE", piece)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    made = []
    for doc_id in range(160):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 7), replace=False):
            words[at] = f"v{at}-{rng.integers(3)}"
        made.append((doc_id, " ".join(words[: 120 - int(rng.integers(0, 12))])))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), 3, 85).collect()}
    label = components_by_force(made, 3, 85)
    assert got == label
    assert len(set(label.values())) > 5


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in rng.integers(0, 500, 120)]
    made = []
    for i in range(160):
        w = list(base) if i % 2 else [f"v{k}" for k in rng.integers(0, 900, 60)]
        for at in rng.integers(0, len(w), rng.integers(0, 9)):
            w[at] = f"x{rng.integers(0, 10**6)}"
        made.append((i, " ".join(w)))
    made += [(1000, ""), (1001, "a b"), (1002, "A  b"), (1003, None)]
    got = neardup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components_by_force(made, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) and r["n_shingles"] == len(shingles(dict(made)[r["doc_id"]], 3)) for r in got)


def test_joint_estimate(spark):
    rng = np.random.default_rng(2)
    pool = rng.integers(1, 1 << 63, 3000, np.uint64)
    for shared in (0.3, 0.6, 0.9):
        n = int(2000 * shared)
        a, b = np.unique(pool[:2000]), np.unique(np.concatenate([pool[:n], pool[2000 : 2000 + (2000 - n) // 2]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        told = neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(told - true) < 0.15
    assert (neardup.registers(np.union1d(a, b)) == np.maximum(neardup.registers(a), neardup.registers(b))).all()


def test_exact_against_an_index_with_rows(spark):
    index = exact.DigestIndex(spark, buckets=4)
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    two = spark.createDataFrame([(9, "a"), (8, "c")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact.dedup(one, index).collect()} == {(1, 3, False), (2, 2, True), (3, 3, True)}
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact.dedup(two, index).collect()} == {(9, 3, False), (8, 8, True)}
    assert index.table().count() == 3


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 8 <= len(digits) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_base_spans(spark, odd, docs):
    for got, texts in ((queries.op6_personal_data(spark, SF), {d[0]: d[1] for d in docs}), (pii.find_personal_data(odd), {r[0]: r[1] for r in ODD})):
        for r in got.collect():
            want = base_spans(texts[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert set(want) <= set(r["spans"].split(","))


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "😀 a@b.co and 10.0.0.1!"), (2, "clean")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs, pii.find_personal_data(docs)).collect()}
    assert got == {1: "😀 [email] and [ip]!", 2: "clean"}


def test_threshold_is_the_lowest_cut_that_meets_the_precision(spark, monkeypatch):
    """The highest scored cell is a thin invalid one; what lies below meets the precision."""
    monkeypatch.setattr(pii.Boosted, "scores", lambda self, x: 0.9 - 0.1 * x[:, len(pii.KINDS) + list(pii.FEATURES).index("digits")])
    cells = [(0, False, 1), (1, True, 200), (2, False, 100)]
    one = "named_struct('kind', 'iban', 'start', 0, 'end', 9, 'valid', {}, " + ", ".join(f"'{f}', " + ("{}" if f == "digits" else "0") for f in pii.FEATURES) + ")"
    rows = [spark.range(n).selectExpr("0 AS fold", f"array({one.format(valid, digits)}) AS spans") for digits, valid, n in cells]
    assert abs(pii.fit(rows[0].union(rows[1]).union(rows[2]))[1]["iban"] - 0.8) < 1e-5


def test_whole_secret_is_found(spark):
    rows = [(i, f"say password={'a1b2' * 100} end") for i in range(40)]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["spans"] for r in got} == {"secret:4:413"}


def test_boosted_trees_learn_a_conjunction():
    x = np.array([[a, b] for a in range(3) for b in range(3)])
    y = ((x[:, 0] > 0) & (x[:, 1] > 1)).astype(float)
    told = pii.Boosted(x, y, np.full(9, 50.0)).scores(x)
    assert ((told > 0.5) == (y > 0.5)).all()


def test_lm_base_score_and_model(spark, docs):
    import collections
    import math

    toks = {d[0]: [*words(d[1]), None] for d in docs}
    counts = collections.Counter(w for i, t in toks.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(counts.values()), len(counts)
    rows = queries.op7_lm_score(spark, SF).collect()
    for r in rows:
        t = toks[r["doc_id"]]
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert abs(r["base_score"] - want) < 1e-6 * abs(want) and r["n_tokens"] == len(t) and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[w] > 0 for w in t) and r["score"] < 0


def test_attention_windows_equal_one_pass():
    """Scores by windows are those of a direct computation for each position."""
    rng = np.random.default_rng(0)
    net = lm.Attention(rng.integers(0, lm.CLASSES, 50), 49)
    t, sizes = net.tables(), [5, 40, 1, 70]
    ids = rng.integers(0, 49, sum(sizes))
    opens = np.cumsum([0, *sizes[:-1]])
    first = np.repeat(opens, sizes)
    got = lm.log_likelihood(t, ids, first, np.zeros((50, lm.KINDS)), windows=2)
    for i in range(len(ids)):
        x = [49 if p == first[i] else ids[p - 1] for p in range(first[i], i + 1)]
        lo = max(first[i], (i // lm.STRIDE - 1) * lm.STRIDE) - first[i]
        keys = np.array(x[lo:])
        s = np.array([t["Q"][x[-1]] @ t["K"][k] + t["near"][len(x) - 1 - lo - j] for j, k in enumerate(keys)])
        a = np.exp(s - s.max())
        h = t["E"][x[-1]] + (a / a.sum()) @ t["V"][keys]
        logits = h @ t["C"] + t["c"]
        want = logits[t["classes"][ids[i]]] - np.log(np.exp(logits).sum())
        assert abs(got[i] - want) < 1e-4


def test_lm_learns_from_documents_outside_the_draw(spark):
    """Corpora of equal word counts, none of it drawn: only what all training documents teach of their order tells them apart."""
    rng = np.random.default_rng(6)
    cycle = "red orange yellow green blue black white brown".split()
    ordered = [(i, " ".join(cycle[(i + k) % 8] for k in range(160))) for i in range(200)]
    mixed = [(i, " ".join(rng.permutation(t.split())) if zlib.crc32(str(i).encode()) % 5 != 1 else t) for i, t in ordered]
    held = []
    for rows in (ordered, mixed):
        got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), sample=0, word_share=0.0).filter("held_out")
        held.append({r["doc_id"]: r["score"] for r in got.collect()})
    assert held[0].keys() == held[1].keys() and all(held[0][i] > held[1][i] for i in held[0])


def test_lm_learns_from_every_window():
    """Subwords that stand in one window each are all learned, none is the draw's."""
    rng = np.random.default_rng(4)
    net = lm.Attention(rng.integers(0, lm.CLASSES, 3000), 2999)
    ids, opens = rng.permutation(2999), np.array([0, 10, 1500])
    change, places = net.learn([(ids, opens)])
    seen = np.bincount(np.where(np.isin(np.arange(len(ids)), opens), 2999, np.append(2999, ids[:-1])), minlength=3000)
    assert (places == seen).all() and ((change["E"] != 0).any(1) == (seen > 0)).all()


def test_lm_draws_no_sample(spark, docs):
    rows = spark.createDataFrame([(i, t) for i, t, _, _ in docs[:40]], "doc_id long, text string")
    none, all_of_them = ({r["doc_id"]: r["score"] for r in lm.score(rows, sample=n).collect()} for n in (0, 400))
    assert none.keys() == all_of_them.keys() and all(abs(none[i] - all_of_them[i]) < 1e-3 for i in none)


@pytest.mark.parametrize("fan_in", [64, 2])
def test_lm_left_neighbours_of_all_training_documents(spark, docs, monkeypatch, fan_in):
    monkeypatch.setattr(lm, "FAN_IN", fan_in)
    rows = spark.createDataFrame([(i, i % 3 == 0, t) for i, t, _, _ in docs[:60]], "doc_id long, held_out boolean, text string").repartition(5)
    got = lm.counted_left(lm.blocks(rows, tokens.default_path(), 50256).filter("blob IS NOT NULL").select("block", "size", "blob"), 50256)
    want = np.zeros((50257, lm.KINDS))
    for i, t, _, _ in docs[:60]:
        if i % 3:
            ids = lm.subwords([*(t or "").encode().lower().split(), b" "], tokens.default_path(), 50256)[0].astype(np.int64)
            for before, one in zip([50256, *ids[:-1]], ids, strict=True):
                want[one, (int(before) * 2654435761 >> 7) % lm.KINDS] += 1
    assert (got == want).all()


def test_chat_round_trip(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "a\\"), (1, 1, "user", said), (1, 2, "assistant", said + "\n"), (2, 0, "tool ### x", None), (2, 0, None, "</turn></turn>"), (None, None, "user", "hi"), (3, 1, "assistant", "first"), (3, 5, "user", "second")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:3])) and got[1]["valid"]
    assert got[1]["loss_sha256"] == sha(said + "\n") and got[1]["loss_chars"] == len(said) + 1
    assert got[2]["turns_sha256"] == sha("\n</turn></turn>\ntool ### x\n\n") and not got[2]["valid"] and not got[3]["valid"]
    assert got[None]["n_turns"] == 1
    assert queries.op8_chat_format(spark, SF).filter("conv_id = -7").first()["loss_chars"] == 26


def test_fingerprint_edits(spark, docs):
    docs = sorted(docs, key=lambda d: -d[0])
    got = {r["doc_id"]: r for r in queries.op9_fingerprints(spark, SF).collect()}
    for i, (doc_id, text, _, _) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[doc_id]["n_chars"] == len(text)
        assert (got[doc_id]["near_edited"] == 1.0) == (edited == text) or got[doc_id]["near_edited"] < 1
    marks = {}
    for d in docs:
        assert marks.setdefault(got[d[0]]["fingerprint"], d[1]) == d[1]


def test_differing_branches(spark):
    row = spark.createDataFrame([("a\nb\n\nc", "a\nb\n\nd")], "x string, y string")
    got = row.select(merkle.differing_sections(merkle.fingerprint(F.col("x")), merkle.fingerprint(F.col("y"))).alias("d")).first()["d"]
    assert got == [1]


def test_licenses_by_force(spark, docs):
    phrases = {p: label for p, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))}
    got = {r["doc_id"]: r for r in queries.op10_licenses(spark, SF).collect()}
    for doc_id, text, _, _ in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        at = sorted((i, phrases[p]) for p in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        r = got[doc_id]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


def test_license_expressions():
    ev = lambda s: licenses.expression_at(s, 0)
    assert licenses.parse("MIT or GPL-3.0-only and ISC".split()) == ["MIT", "GPL-3.0-only", "ISC", "and", "or"]
    assert ev(" (MIT OR GPL-3.0-only) AND ISC */") == ({"mit", "gpl", "isc"}, 1.0)
    assert ev("GPL-2.0-only WITH Classpath-exception-2.0") == ({"gpl"}, 0.65)
    assert ev("MIT AND (ISC") is not None and ev(") x") is None
    assert licenses.scan("// SPDX-License-Identifier: Apache-2.0 OR MIT\ncode")[5] == "apache-2,mit"


def test_pipeline_by_force(spark):
    import corpus_pipeline

    rows = [(i, t, "en", s) for i, t, _, s in [(r[0], r[1], r[2], r[3]) for r in ODD if r[0] is not None] + [(50, "many words that stand alone in this small text of the test", None, "b")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = corpus_pipeline.language_id(spark, docs, SF)
    assert sorted(r["doc_id"] for r in docs.collect()) == [3, 5, 5, 6, 7, 8, 9, 50]
    docs = corpus_pipeline.exact_dedup(spark, docs, SF)
    assert sorted(r["doc_id"] for r in docs.collect()) == [3, 6, 7, 8, 9, 50]
    docs = corpus_pipeline.near_dedup(spark, docs, SF)
    kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(i for i, _ in kept) == [3, 6, 8, 9, 50]  # 9 of 10 shingles link 6 and 7
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    assert sorted(r["doc_id"] for r in corpus_pipeline.pack(spark, mixed, SF).filter("start = 0").collect()) == sorted(i for i, n in copies.items() for _ in range(n))
