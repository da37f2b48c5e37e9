"""The training-data operators against brute force, libraries, round trips and planted cases."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from citeloom.llm import byte_bpe, decontaminate, language_id, license_scan, line_dedup, lm_score, ngram_join, pretokens, quality_rules, token_count, token_files
from citeloom.llm.components import components
from citeloom.llm.shingles import shingle_set

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    None, "", " \n\t ", "Hello, world!", "don't they'll we've", "<|endoftext|> in a<|startoftext|>text", "ÀÉÎ straße ΣΟΦΟΣ İstanbul", "日本語テキスト 한국어", "áè   x\x1cy", "𝔘𝔫𝔦 🎉🎉",
    "x" * 5000, "word " * 3000, "1234 5.6,7;8", "a.b...c!?", "tab\tvt\x0bff\x0ccr\rnl\n", "﻿bom ​zero", "The the THE.", "ﬁ ligature Å ℵ", "....", "\x00\x01 control",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string, row string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns whose names the operators use too."""
    rows = [(i, t, "en", "s", "clash", "clash") for i, t in enumerate(ODD)] + [(3, "Hello, world!", "en", "s", "clash", "clash"), (3, "other text", None, None, None, None), (None, "no id", "en", "s", "c", "c")]
    return spark.createDataFrame(rows, SCHEMA).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def key(r):
    return (r.doc_id is None, r.doc_id or 0)


def test_token_counts_are_the_librarys(spark, odd, none):
    tok = library()
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(odd, WORD_BPE).collect())
    want = Counter()
    for r in odd.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 2048] += 1
    assert got == want
    assert token_count.token_counts(none, WORD_BPE).count() == 0


def test_token_files_round_trip(spark, odd, none):
    tok = library()
    got = sorted(token_files.token_file_digest(odd, WORD_BPE, 2).collect(), key=lambda r: r.start)
    assert [key(r)[1] for r in got][1:] == sorted(key(r)[1] for r in got[1:]) and got[0].doc_id is None
    want = Counter()
    for r in odd.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert token_files.token_file_digest(none, WORD_BPE, 2).count() == 0


def test_sequences_are_mapped_and_masked(spark, tmp_path):
    docs = spark.createDataFrame([(i, "alpha beta gamma " * 40) for i in range(30)], "doc_id long, text string")
    shards = token_files.write_token_files(docs, WORD_BPE, 2, f"file://{tmp_path}", sequence=64)
    tok = library()
    ids = tok.encode("alpha beta gamma " * 40, add_special_tokens=False).ids + [2]
    flat = []
    for shard, n in shards:
        table = token_files.shard_sequences(f"file://{tmp_path}", shard)
        values = np.concatenate([c.flatten().to_numpy() for c in table.column("ids").chunks])
        mask = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("mask").chunks])
        assert mask.sum() == n and mask[:n].all() and len(values) % 64 == 0
        flat += values[:n].tolist()
    assert flat == ids * 30


def test_bpe_is_tiktokens_and_decodes(spark, odd, none):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in odd.collect():
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, byte_bpe.digest(odd, RANKS, public_tokenizers.PATTERN).collect())) == want
    assert byte_bpe.digest(none, RANKS, public_tokenizers.PATTERN).count() == 0
    apart = byte_bpe.decode(byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS)
    assert sorted(bytes(r.decoded) for r in apart.collect()) == sorted((r.text or "").encode() for r in odd.collect())


PARTS = ["a", "b", "Z", "é", "É", "ÿ", "×", "÷", "İ", "Ʌ", "ɐ", "1", "2", "٣", ".", "!", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\u3000", "\x1c", "\x85", "日", "한", "e\u0301", "\x00", "<|", "|>", "<|endoftext|>", "$", "…", "²", "ª"]


def mixed(rng, n):
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_words_are_the_patterns():
    import regex

    rng, pattern = random.Random(1), regex.compile(public_tokenizers.PATTERN)
    for _ in range(400):
        texts = mixed(rng, 4)
        owner, buffer, starts, ends = byte_bpe.cut_words([t.encode() for t in texts], pattern)
        got = [[] for _ in texts]
        for k, i, j in zip(owner, starts, ends, strict=True):
            got[k].append(buffer[i:j].decode())
        assert got == [pattern.findall(t) for t in texts]


def test_pretokens_are_the_librarys(monkeypatch):
    rng, tok = random.Random(2), library()
    monkeypatch.setattr(pretokens, "IDS", 500)  # the memory starts anew many times
    memory, small = pretokens.Memory(WORD_BPE, True, np.uint16), pretokens.Memory(WORD_BPE, False, entries=50)
    for _ in range(60):
        texts = mixed(rng, 20)
        want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        ids, n = memory.encode([t.encode() for t in texts], 2)
        assert n.tolist() == [len(w) + 1 for w in want] and ids.tolist() == [i for w in want for i in [*w, 2]]
        assert small.count([t.encode() for t in texts])[0].tolist() == [len(w) for w in want]


def test_long_texts_are_cut_at_white_space():
    texts = [b"ab cd  ef" * 50, b"", b"x" * 300, b"tail"]
    back = [b""] * 4
    for numbers, buffer, begins in pretokens.spans(texts, 64):
        for k, i, j in zip(numbers, begins, [*begins[1:] - 1, len(buffer) - 1], strict=True):
            back[k] += buffer[i:j]
    assert back == texts


def test_first_tier_holds_the_frequent(spark):
    docs = spark.createDataFrame([(i, "common words again and again " * 3 + f"rare{'xyz'[i % 3] * i}") for i in range(40)], "doc_id long, text string")
    r = token_count.token_counts(docs, WORD_BPE).agg(F.sum("n_frequent").alias("a"), F.sum("n_pretokens").alias("b")).first()
    assert r.a == r.b  # everything fits in tier one
    summary = token_count._Summary()
    a, starts, ends = pretokens.words(b"aa bb aa cc aa bb ")
    summary.add(b"aa bb aa cc aa bb ", starts, ends, np.full(6, pretokens.WHOLE), pretokens.hashes(a, starts, ends))
    names, _, counts = summary.top(2)
    assert names == [(b"aa", True), (b"bb", True)] and counts.tolist() == [3, 2]


def test_clashing_columns_raise(odd):
    with pytest.raises(ValueError, match="twice"):
        byte_bpe.encode(odd.withColumnRenamed("row", "ids"), RANKS, public_tokenizers.PATTERN, keep=("ids",))


def test_stores_by_scheme():
    with pytest.raises(ValueError, match="hdfsx"):
        token_files._store("hdfsx://a/b")
    assert token_files._store("/tmp/x")[1] == "/tmp/x"


def brute_lines(rows):
    """(text, removed) of (id, text) rows in order: windows of three wrapped lines, the first occurrence stays."""
    seen, out = set(), []
    for _, text in rows:
        places = [(i, tuple(w[k : k + 20])) for i, line in enumerate((text or "").split("\n")) if (w := line.encode().split()) for k in range(0, len(w), 20)]
        hit = set()
        for k in range(len(places) - 2):
            window = tuple(p for _, p in places[k : k + 3])
            if window in seen:
                hit.update(range(k, k + 3))
            seen.add(window)
        own: dict = {}
        for k, (i, _) in enumerate(places):
            own.setdefault(i, []).append(k in hit)
        gone = {i for i, hits in own.items() if all(hits)}
        out.append((None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), len(gone)))
    return out


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(6)
    lines = ["", " ", *[" ".join(f"l{k}w{i}" for i in range(n)) for k, n in enumerate([1, 2, 5, 19, 20, 21, 40, 41, 55, 130])]]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.5 else f"own {i} {k}" for k in range(rng.randint(0, 12)))) for i in range(120)]
    rows += [(200, None), (201, "  tabs\tand\x0bother   gaps\n" + lines[11]), (202, "tabs and other gaps\n" + lines[11].replace(" ", "\t"))]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == brute_lines(rows)


def test_line_dedup_cases(spark, odd, none):
    block = "one line here\nand a second\nthe third of it"
    long = " ".join(f"w{i}" for i in range(55))
    rows = [
        (1, f"start\n{block}\nend one"), (2, f"other\n{block}\nend two"), (3, block), (4, "and a second\nthe third of it"), (5, long), (6, f"x\n{long}\ny"), (7, f"{block}\n\n{block}"),
        (8, None), (9, ""), (10, "solo"), (2, f"other\n{block}\nend two"),
    ]
    got = {}
    for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))).collect():
        assert got.setdefault(r.doc_id, (r.text, r.n_lines, r.n_removed)) == (r.text, r.n_lines, r.n_removed)
    assert got[1] == (rows[0][1], 5, 0)
    assert got[2] == ("other\nend two", 5, 3)
    assert got[3] == ("", 3, 3)
    assert got[4] == (rows[3][1], 2, 0)
    assert got[5] == (long, 1, 0)
    assert got[6] == ("x\ny", 3, 1)
    assert got[7] == ("", 7, 6)
    assert got[8] == (None, 0, 0)
    assert got[9] == ("", 1, 0)
    assert got[10] == ("solo", 1, 0)
    kept = line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {1, 2, 4, 5, 6, 8, 9, 10}
    done = {(r.doc_id, r.text): r for r in line_dedup.line_dedup(odd).collect()}
    assert set(done) == {(r.doc_id, r.text) for r in odd.collect()} and all(r.n_removed == 0 and r.row == "clash" for r in done.values() if r.doc_id is not None and r.lang)
    assert line_dedup.line_dedup(odd).count() == odd.count() and line_dedup.line_dedup(none).count() == 0


def brute_repeated(words):
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(hit)


def test_quality_counts(spark, odd, none):
    import re

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcd") * rng.randint(1, 2) for _ in range(rng.randint(0, 200))).replace(" b ", "\n"), "en", "s") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").unionByName(odd.select("doc_id", "text", "lang", "source"))
    want = Counter()
    for r in docs.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        rep = brute_repeated(w)
        want[r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, len(w) < 20 or 100 * rep > 30 * len(w)] += 1
    got = quality_rules.quality(docs)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()) == want
    assert got.where("base_failed and kept").count() == 0
    assert quality_rules.quality(none).count() == 0


def test_quality_fences_follow_the_group(spark):
    clean = [(i, " ".join(["plain", "words", "are", "here"][(i + k) % 4] + str(k) for k in range(40)), "en", "s") for i in range(150)]
    bad = [(1000, " ".join(["###$$$%%%"] * 10 + [f"w{k}" for k in range(30)]), "en", "s"), (1001, " ".join("x" * 60 + str(k) for k in range(40)), "en", "s")]
    got = {r.doc_id: r.kept for r in quality_rules.quality(spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(150)) and not got[1000] and not got[1001]


def test_repetition_under_the_base_rule_is_rejected_in_a_clean_group(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(100))
    clean = [(i, text(), "en", "s") for i in range(60)] + [(500 + i, text(), "fr", "t") for i in range(3)]
    phrase = " ".join(f"p{k}" for k in range(10))
    bad = [(1000, f"{phrase} {text()} {phrase}", "en", "s"), (1001, f"{phrase} {text()} {phrase}", "fr", "t"), (1002, "\n".join([text()[:60]] * 2 + [text() for _ in range(3)]), "en", "s")]
    rows = {r.doc_id: r for r in quality_rules.quality(spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert all(rows[i].kept for i, *_ in clean)
    assert not any(rows[i].base_failed or rows[i].kept for i in (1000, 1001))
    assert rows[1002].n_dup_lines == 1


def test_language_is_learned_and_held_out(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    und = {r.doc_id: r.lang_pred for r in language_id.language_id(odd).collect() if r.doc_id is not None}
    assert und[0] == und[1] == und[2] == und[12] == "und" and und[7] == "en"
    assert language_id.language_id(none).count() == 0
    kept = language_id.keep_identified(odd, language_id.fit(docs))
    assert {r.doc_id for r in kept.collect()}.isdisjoint({0, 1, 2, 12}) and kept.columns == odd.columns


def test_decoding_is_plain():
    rng = np.random.default_rng(3)
    code = language_id.codewords(5)
    bits = code.shape[1]
    model = {"code": code, "w": rng.normal(0, 3, (6, bits)).astype(np.float32), "b": rng.normal(0, 1, bits).astype(np.float32), "reliability": rng.uniform(0.1, 1, bits).astype(np.float32)}
    x = rng.normal(0, 1, (40, 6)).astype(np.float32)
    best, score, near, loss = language_id.decode(model, x)
    for k in range(40):
        margins = [sum(float(x[k, f]) * float(model["w"][f, j]) for f in range(6)) + float(model["b"][j]) for j in range(bits)]
        weights = [float(r) / float(model["reliability"].sum()) for r in model["reliability"]]
        losses = [sum(q * math.log1p(math.exp(-m * c)) for q, m, c in zip(weights, margins, row)) for row in code.tolist()]
        order = sorted(range(5), key=losses.__getitem__)
        odds = [math.exp(-x * bits) for x in losses]
        assert best[k] == order[0] and loss[k] == pytest.approx(losses[order[0]], abs=1e-4) and score[k] == pytest.approx(odds[order[0]] / sum(odds), abs=1e-3)
        gap = losses[order[1]] - losses[order[0]]
        assert abs(gap - language_id.AMBIGUOUS) < 1e-4 or near[k] == (gap < language_id.AMBIGUOUS)


def test_unlearned_languages_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs)
    other = [(1, "Привет мир, это текст на русском языке, и он довольно длинный"), (2, "これは日本語の文章です。とても長い文章です。"), (3, "मेरा नाम है और यह एक वाक्य है"), (4, docs.where("lang = 'en' and n_chars > 300").first().text)]
    kept = language_id.keep_identified(spark.createDataFrame(other, "doc_id long, text string"), model)
    assert {r.doc_id for r in kept.collect()} == {4}
    known = docs.where(F.col("text").rlike("[a-zA-Z]{3}"))
    assert language_id.keep_identified(known, model).count() >= 0.99 * known.count()


@pytest.mark.parametrize("n", [2, 3, 5, 6, 9, 40])
def test_codewords_are_apart(n):
    c = language_id.codewords(n)
    assert len({tuple(r) for r in c.tolist()}) == n and (abs(c.sum(0)) < n).all()


def test_scores_are_base_and_probabilities(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    words = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter()
    for r in docs.collect():
        if not held(r.doc_id):
            c.update(words(r.text))
    n, v = sum(c.values()), len(c)
    want = Counter((r.doc_id, held(r.doc_id), len(words(r.text)), sum(c[w] > 0 for w in words(r.text)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(r.text)), 5)) for r in docs.collect())
    rows = lm_score.lm_scores(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
    test = [r for r in rows if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    assert lm_score.lm_scores(none).count() == 0


def test_score_beats_base_on_held_out_documents(spark):
    rows = lm_score.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert len(rows) > 50 and sum(r.score > r.base_score for r in rows) >= 0.95 * len(rows)


def test_rare_tokens_take_the_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 50}" for k in range(30))) for i in range(40)], "doc_id long, text string")
    want = {r.doc_id: (r.n_known, round(r.base_score, 8)) for r in lm_score.lm_scores(docs).collect()}
    monkeypatch.setattr(lm_score, "FREQUENT", 12)
    monkeypatch.setattr(lm_score, "VECTORS", 8)
    rows = lm_score.lm_scores(docs).collect()
    assert {r.doc_id: (r.n_known, round(r.base_score, 8)) for r in rows} == want


def small_model():
    """A vocabulary of 40 tokens, 30 of them with vectors, and parameters by chance."""
    rng = np.random.default_rng(4)
    names = sorted(f"{a}{b}x{c}".encode() for a in "abcde" for b in "fghi" for c in "jk")
    a, starts, ends = pretokens.words(b" ".join(names) + b" ")
    t = lm_score.tokens_of([b" ".join(names)])
    counts = np.sort(rng.integers(1, 500, 40))[::-1]
    mass = np.full(lm_score.TAILS, 0.1)
    np.add.at(mass, lm_score.tail_class(t.endings[30:40]), counts[30:] + 0.1)
    v = lm_score.Vocabulary(t.keys[:40], t.endings[:40], counts, 30, mass, counts.sum(), 40)
    return names, v, rng.normal(0, 0.5, (v.rows, lm_score.WIDTH + 1)).astype(np.float32)


def test_lm_learns_from_every_position_once():
    names, v, p = small_model()
    texts = [b" ".join(names[i % 40] for i in range(k, k + 30)) for k in range(50)]
    places = pretokens.Places()
    places.add(v.keys)
    used = 0
    for turn in range(lm_score.ROUNDS):
        trainer = lm_score.Trainer(p, v, [turn, 0])
        trainer.learn(lm_score.taught(texts, turn), places)
        used += trainer.touched[: v.at_class].sum()
    assert used == lm_score.POSITIONS * len(lm_score.tokens_of(texts).keys)


def test_a_training_step_moves_rows_along_plain_sums(monkeypatch):
    names, v, p = small_model()
    places = pretokens.Places()
    places.add(v.keys)
    t = lm_score.tokens_of([b" ".join([*names[:30:2], b"new", *names[5:38:3]])])
    _, target, context = v.numbers(places, t)
    cls = v.classes_of(target, t.endings)
    order = np.argsort(cls)
    context, cls, target = context[order], cls[order], target[order]
    trainer, n, w, drawn = lm_score.Trainer(p, v, [3]), len(cls), lm_score.WIDTH, []
    move = trainer.add
    monkeypatch.setattr(trainer, "add", lambda ids, grads: (drawn.append(ids), move(ids, grads)))
    trainer.step(context, cls, target)
    (ids,), q, want = drawn, p.astype(float), np.zeros(p.shape)
    noise, m = ids[n : n + lm_score.NOISE_CLASSES], int((target >= 0).sum())
    tokens = ids[len(ids) - (lm_score.NOISE_TOKENS + 1) * m :].reshape(-1, m)
    assert 0 < m < n and (tokens[0] == v.at_token + target[:m]).all()
    for k in range(n):
        h, back = sum(q[context[k, d], :w] * q[v.at_position + d, :w] for d in range(lm_score.POSITIONS)), np.zeros(w)
        rows = [(v.at_class + cls[k], 1, math.log(lm_score.NOISE_CLASSES * v.share[cls[k]])), *((r, 0, math.log(lm_score.NOISE_CLASSES * v.share[r - v.at_class])) for r in noise)]
        rows += [(r, int(j == 0), math.log(lm_score.NOISE_TOKENS * v.own_share[r - v.at_token])) for j, r in enumerate(tokens[:, k] if k < m else [])]
        for r, real, log in rows:
            slope = real - 1 / (1 + math.exp(log - q[r, :w] @ h - q[r, w]))
            want[r] += slope * np.append(h, 1)
            back += slope * q[r, :w]
        for d in range(lm_score.POSITIONS):
            want[context[k, d], :w] += back * q[v.at_position + d, :w]
            want[v.at_position + d, :w] += back * q[context[k, d], :w]
    scale = lm_score.RATE / np.sqrt(1 + (want**2).sum(1) / (w + 1))
    assert np.allclose(trainer.p - p, want * scale[:, None], atol=1e-5)
    assert trainer.touched.sum() == len(ids)


def test_probabilities_are_normalised_and_plain():
    names, v, p = small_model()
    places = pretokens.Places()
    places.add(v.keys)
    text = b"afxj zz " + names[3] + b" " + names[35] + b" new" + names[7]
    t = lm_score.tokens_of([text, b"", names[1]])
    place, target, context = v.numbers(places, t)
    cls = v.classes_of(target, t.endings)
    got = lm_score.log_probabilities(p, v, context, cls, target)
    w = lm_score.WIDTH
    for k in range(len(cls)):
        before = [target[k - d] if k - d >= t.begin[k] and target[k - d] >= 0 else v.n + lm_score.tail_class(t.endings[k - d] if k - d >= t.begin[k] else 0) for d in (1, 2, 3)]
        h = sum(p[r, :w].astype(float) * p[v.at_position + d, :w] for d, r in enumerate(before))
        classes = p[v.at_class : v.at_token, :w] @ h + p[v.at_class : v.at_token, w]
        want = classes[cls[k]] - math.log(np.exp(classes).sum())
        if target[k] >= 0:
            own = range(v.bounds[cls[k]], v.bounds[cls[k] + 1])
            scores = {i: p[v.at_token + i, :w] @ h + p[v.at_token + i, w] for i in own}
            want += scores[target[k]] - math.log(sum(map(math.exp, scores.values())))
        assert got[k] == pytest.approx(want, abs=1e-4)
    # All tokens with vectors and all tail classes after one context.
    every = np.arange(v.n + lm_score.TAILS)
    same = np.repeat(context[:1], len(every), 0)
    all_cls = np.concatenate([v.cls, len(v.bounds) - 1 + np.arange(lm_score.TAILS)])
    assert np.exp(lm_score.log_probabilities(p, v, same, all_cls, np.where(every < v.n, every, -1))).sum() == pytest.approx(1, abs=1e-5)
    # Inside a tail class the known tokens' shares and one unknown's add up to 1.
    for k in range(lm_score.TAILS):
        t2 = lm_score.tokens_of([b" ".join(names[30:])])
        inside = [c for c, e in zip(v.c[30:], t2.endings, strict=False) if lm_score.tail_class(e) == k]
        assert sum(c + 0.1 for c in inside) + 0.1 == pytest.approx(v.tail_mass[k])


def test_training_learns_an_order():
    texts = [b"one two three four five"] * 60 + [b"six seven eight nine ten"] * 60
    t = lm_score.tokens_of(texts)
    keys, first, c = np.unique(t.keys, return_index=True, return_counts=True)
    v = lm_score.Vocabulary(keys, t.endings[first], c, len(keys), np.full(lm_score.TAILS, 0.1), c.sum(), len(c))
    places = pretokens.Places()
    places.add(v.keys)
    trainer = lm_score.Trainer(v.start(), v, [1])
    _, target, context = v.numbers(places, t)
    cls = v.classes_of(target, t.endings)
    before = lm_score.log_probabilities(v.start(), v, context, cls, target).mean()
    for _ in range(40):
        trainer.learn(texts, places)
    assert lm_score.log_probabilities(trainer.p, v, context, cls, target).mean() > before + 1


def brute_join(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
                links[i] += 1
                links[j] += 1
    return [(len(sets[i]), find(i), links[i]) for i in range(len(texts))]


@pytest.mark.parametrize("width,percent,seed", [(4, 85, 1), (5, 80, 2), (4, 85, 3)])
def test_join_is_brute_force(spark, width, percent, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(25)]
    texts = ["", None, "one", "one two", "One  two", "a b c d", "a b c d e"]
    for b in range(5):
        base = [f"b{b}w{rng.randint(0, 80)}" for _ in range(rng.randint(10, 90))]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"e{rng.randint(0, 999)}"
            texts.append(" ".join(t if rng.random() < 0.6 else passage + t))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width, percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute_join(texts, width, percent)


def test_join_edges(spark, odd, none):
    assert ngram_join.ngram_join(odd, 4, 85).count() == odd.count() and ngram_join.ngram_join(none, 4, 85).count() == 0
    kept = ngram_join.representatives(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z"), (4, None), (1, "a b c d e f")], "doc_id long, text string"), 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_shingles_of_runs(monkeypatch):
    from citeloom.llm import shingles

    text = " ".join(f"w{i % 97}" for i in range(1000)).encode()
    whole = shingle_set(text, 4)
    monkeypatch.setattr(shingles, "RUN", 37)
    assert np.array_equal(shingle_set(text, 4), whole) and len(whole) == 97 and len(shingle_set(b"a b", 4)) == 1 and len(shingle_set(b" ", 4)) == 0


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(None, 1)]
    root = {x: x for p in pairs[:-1] for x in p}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs[:-1]:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    linked = {x for a, b in pairs[:-1] if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_contamination_is_brute_force(spark, odd, none, monkeypatch):
    rng = random.Random(5)
    bench = [(i, " ".join(f"q{rng.randint(0, 60)}" for _ in range(n))) for i, n in enumerate([40, 13, 5, 1, 0])] + [(None, "null id item here"), (7, None), (0, "second text of item zero")]
    docs = [(i, " ".join(f"q{rng.randint(0, 60)}" for _ in range(200))) for i in range(5)]
    docs += [(10, "intro: " + bench[0][1].upper() + "!! the end"), (11, "é " + bench[2][1].replace(" ", ", ") + " à"), (12, None), (13, ""), (14, "null id item here")]
    import re

    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    win = {}
    for item, t in bench:
        w = tokens(t)
        for i in range(max(1, len(w) - 12)) if w else ():
            win.setdefault(tuple(w[i : i + 13]), set()).add("" if item is None else str(item))
    want = {}
    for d, t in docs:
        w, hit, items = tokens(t), set(), set()
        for n in {len(x) for x in win}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in win:
                    hit.update(range(i, i + n))
                    items |= win[tuple(w[i : i + n])]
        want[d] = (len(w), len(hit), sorted(items))
    b = spark.createDataFrame(bench, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.contamination(df, b).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.items) for r in found} == want
    texts = dict(docs)
    for r in found:
        assert sum(len(tokens(texts[r.doc_id][s.start : s.end])) for s in r.spans) == r.n_hit
    monkeypatch.setattr(decontaminate, "ONE_AUTOMATON", 300)
    assert {r.doc_id: (r.n_words, r.n_hit, r.items) for r in decontaminate.contamination(df, b).collect()} == want
    clean = decontaminate.clean(df, b)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {d for d, (n, h, _) in want.items() if not (h and 20 * h >= n)}
    assert decontaminate.contamination(odd, b).count() == odd.count() and decontaminate.contamination(none, b).count() == 0
    assert decontaminate.contamination(df, b.limit(0)).where("n_hit > 0").count() == 0


def test_licenses(spark, odd, none):
    mit = license_scan.SENTENCES["mit-1"] + ":\n\n" + license_scan.SENTENCES["mit-2"] + "."
    cases = {
        1: ("Text. Licensed under the Apache License, Version 2.0.\nMore.", ["Apache-2.0"]), 2: ("released   UNDER the MIT\nlicense", ["MIT"]), 3: (mit.replace(" copy", "\ncopy"), ["MIT"]),
        4: ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]), 5: ("a licensed thing", []), 6: (None, []), 7: ("", []), 8: ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        9: ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["GPL-3.0-or-later"]),
        10: ("Licensed under the Apache License, Version 2.0 extended", []),
    }
    got = {r.doc_id: r.matches for r in license_scan.license_scan(spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")).collect()}
    assert {k: [m.license for m in v] for k, v in got.items()} == {k: want for k, (_, want) in cases.items()}
    t = cases[1][0].encode()
    assert t[got[1][0].start : got[1][0].end].strip().startswith(b"Licensed under the Apache")
    assert license_scan.digest(odd).count() == odd.count() and license_scan.digest(none).count() == 0


def brute_licenses(text, sentences, rules):
    """All pieces as words; at each piece the longest known sentence, over the identifiers the longest rule."""
    pieces = [p for m in license_scan.PIECE.finditer(text.encode()) if (p := license_scan.normal(m[0]))]
    keys = {license_scan._key(s): n for n, s in sentences.items()}
    ids, i = [], 0
    while i < len(pieces):
        fits = [k for k in range(i, len(pieces)) if b" ".join(pieces[i : k + 1]) in keys]
        if fits:
            ids.append(keys[b" ".join(pieces[i : fits[-1] + 1])])
            i = fits[-1]
        i += 1
    out, i = [], 0
    while i < len(ids):
        fits = sorted((-len(r), n) for n, r in rules if ids[i : i + len(r)] == r)
        if fits:
            out.append(fits[0][1])
            i -= fits[0][0] + 1
        i += 1
    return len(ids), out


def test_license_scan_is_brute_force(spark):
    rng = random.Random(7)
    sentences, rules = license_scan.table()
    lines = list(sentences.values())
    texts = []
    for _ in range(80):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.4:
                parts += [sentences[i] for i in rng.choice(rules)[1]]
            else:
                parts.append(rng.choice(lines) if kind < 0.7 else "Some other sentence of a text.")
        text = rng.choice([". ", ".\n", "\n\n"]).join(parts)
        texts.append(text.replace(" the ", "\nthe ") if rng.random() < 0.3 else text)
    got = {r.doc_id: (r.n_sentences, [m.license for m in r.matches]) for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(80)] == [brute_licenses(t, sentences, rules) for t in texts]


def test_whole_license_texts_are_told_apart():
    sentences, rules = license_scan.table()
    known = license_scan.Recogniser(sentences, rules)
    whole = [(n, ids) for n, ids in rules if len(ids) > 1]
    assert len({n for n, _ in rules}) >= 30
    for name, ids in whole:
        for between in ("\n", " ", "\n\n"):
            text = between.join(sentences[i] if sentences[i][-1] in ".:;" else sentences[i] + "." for i in ids)
            assert [m[0] for m in known.licenses(known.sentences(text.encode()))] == [name], (name, ids)


def test_license_ties_go_by_name():
    known = license_scan.Recogniser({"a": "One sentence", "b": "Two sentence"}, [("Zed", ["a", "b"]), ("Alpha", ["a", "b"]), ("Short", ["a"])])
    assert [m[0] for m in known.licenses(known.sentences(b"One sentence. Two sentence. One sentence."))] == ["Alpha", "Short"]
    assert known.sentences(b"") == [] and len(known.licenses(known.sentences(b"One sentence. " * 20_000))) == 20_000


def test_license_table_is_whole():
    used = {i for _, ids in license_scan.RULES for i in ids}
    assert used <= set(license_scan.SENTENCES)
    known = license_scan.Recogniser(license_scan.SENTENCES, license_scan.RULES)
    for name, text in license_scan.SENTENCES.items():
        assert [x[0] for x in known.sentences(f"Before. {text}. After".encode())] == [name]
