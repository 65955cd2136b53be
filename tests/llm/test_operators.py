"""Each operator against its plain version, over nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import ordinal, scan
from tapeloom.llm.chat_format import format_chat, parsed, read_back, unescaped
from tapeloom.llm.components import components
from tapeloom.llm.embedding_dedup import embedding_dedup
from tapeloom.llm.jaccard_join import ngram_jaccard_join
from tapeloom.llm.language_model import score_texts
from tapeloom.llm.line_dedup import line_dedup
from tapeloom.llm.mixing import mix, training_order
from tapeloom.llm.ordinal import classify
from tapeloom.llm.packing import LENGTHS, pack
from tapeloom.llm.quality_rules import quality_rules, text_counts
from tapeloom.llm.shared import Stage
from tapeloom.llm.suffix_dedup import suffix_dedup
from tapeloom.llm.token_counts import token_counts

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, size string, token string, spans string"


def texts():
    """Copies, near copies, passages, junk, and every odd case; ids are not in the order of the rows."""
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdeé ß"[:6]) for _ in range(rnd.randint(1, 6))) for _ in range(200)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, base = say(60), [rnd.choice(vocabulary) for _ in range(120)]
    rows = [say(rnd.randint(1, 90)) for _ in range(40)]
    for _ in range(25):  # a group of near copies
        w = list(base)
        w[rnd.randrange(120)] = "edit" + str(rnd.random())
        rows.append(" ".join(w))
    rows += [" ".join(base)] * 6 + [f"{say(20)} {passage} {say(20)}" for _ in range(8)]
    rows += ["", None, "   \n\t", "one", "one two", "One TWO", "a" * 300, "ab " * 200, passage[:49], passage[:50], "é" * 60, "xé" * 60, say(9000)]
    rows += ["*** ### $$$ <a> |b|", "line one\nline one\nline one\n\nother", " ".join(["same eight words come here again and again"] * 6)]
    ids = list(range(len(rows)))
    rnd.shuffle(ids)
    return list(zip(ids, rows))


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns of names that the operators use themselves, one repeated row and one null id."""
    full = [(i, t, ["en", "de", None][i % 3], [None, "b", "a", "é"][i % 4], len(t or ""), "r", "k", "s", "t", "p") for i, t in rows]
    return spark.createDataFrame(full + [full[3], (None, "one two three", None, None, 0, "r", "k", "s", "t", "p")], DOCS).repartition(5)


@pytest.fixture(scope="module")
def plain(rows):
    return [*rows, rows[3], (None, "one two three")]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 440)] + [(7, 7)]
    want = brute.components({x for p in links for x in p}, links)
    have = dict(got(components(spark.createDataFrame(links, "a long, b long"))))
    assert all(have.get(n, n) == c for n, c in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard(docs, plain):
    assert got(ngram_jaccard_join(docs)) == brute.jaccard(plain)
    assert got(ngram_jaccard_join(docs, 5, 80)) == brute.jaccard(plain, 5, 80)


def test_suffix_dedup(docs, plain):
    cut = suffix_dedup(docs).select("row.doc_id", F.coalesce(F.octet_length("row.text"), F.lit(0)), F.length("kept").alias("n"), F.size("spans"), F.sha2("kept", 256))
    have = sorted(((i, n, n - k, s, h) for i, n, k, s, h in cut.collect()), key=repr)
    assert have == brute.repeated_strings(plain)


def test_suffix_dedup_whole_characters(docs):
    assert suffix_dedup(docs, whole_characters=True).filter(~F.is_valid_utf8(F.col("kept").cast("string"))).count() == 0


def test_mix(docs, plain):
    source = lambda i: None if i is None else [None, "b", "a", "é"][i % 4]
    full = [(i, source(i), t) for i, t in plain]
    total, target = brute.mixture(full)
    mixed = mix(docs)
    have = mixed.select("row.doc_id", "row.source", "size", "source_size", "target", "taken", "placements").collect()
    assert sorted((r.doc_id, r.size) for r in have if r.doc_id is not None) == sorted((i, len(brute.words_of(t))) for i, t in plain if i is not None)
    for s in total:
        own = [r for r in have if r.source == s]
        assert {r.source_size for r in own} == {total[s]} and all(abs(r.target - target[s]) < 1e-6 for r in own)
        assert sum(r.taken for r in own) == round(target[s])
    for r in have:
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(p.words for p in r.placements) and all(0 <= p.time <= 1 for p in r.placements)
    again = mix(docs.repartition(3)).select("row.doc_id", "taken").collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in mixed.select("row.doc_id", "taken").collect())
    order = [r.time for r in training_order(mixed).collect()]
    assert order == sorted(order) and len(order) == sum(len(r.placements) for r in have)
    whole = mix(docs, whole_documents=True).select("size", "taken").collect()
    assert all(r.size == 0 or r.taken % r.size == 0 for r in whole)


def test_mixing_query_takes_in_training_order(spark, monkeypatch):
    """The query sums the takes of the training order, and a take's time is where the demand meets its middle."""
    from collections import Counter, defaultdict

    from tapeloom.llm import queries
    from tapeloom.llm.mixing import SCHEDULES

    from ..conftest import SF_DIR

    taken = {r.doc_id: r for r in queries.op2_mixing_sources(spark, SF_DIR).collect()}
    order = queries.op2_training_order(spark, SF_DIR).collect()
    words = Counter()
    for r in order:
        words[r.doc_id] += r.words
    assert {i: r.taken for i, r in taken.items() if r.taken} == words and [r.time for r in order] == sorted(r.time for r in order)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    of = defaultdict(list)
    for r in order:
        of[source[r.doc_id]].append(r)
    names = sorted(set(source.values()), key=lambda x: (x is None, x or ""))
    for name, takes in of.items():
        knots, before, total = SCHEDULES[names.index(name) % 3 + 1], 0, sum(r.words for r in takes)
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        for r in takes:
            met = 0.0
            for (t0, g0), (t1, g1), area in zip(knots, knots[1:], areas):
                x = min(max(r.time - t0, 0.0), t1 - t0)
                met += g0 * x + (g1 - g0) / (t1 - t0) * x * x / 2
            assert met / sum(areas) == pytest.approx((before + r.words / 2) / total, abs=1e-6)
            before += r.words
    whole = queries.training_order
    monkeypatch.setattr(queries, "training_order", lambda *a, **kw: whole(*a, **kw).filter("time < 0.5"))
    early = {r.doc_id: r.taken for r in queries.op2_mixing_sources(spark, SF_DIR).collect()}
    assert sum(early.values()) == sum(r.words for r in order if r.time < 0.5)


def test_text_counts(docs, plain):
    have = text_counts(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got(have) == sorted(((i, *brute.text_counts(t)) for i, t in plain), key=repr)


def test_quality_rules(spark):
    clean = " ".join(f"word{k}" for k in range(40))
    junk = " ".join(f"word{k}***" for k in range(40))
    rows = [(k, junk if k % 10 == 0 else clean, "en") for k in range(4000)] + [(4000, clean, None), (4001, None, "en")]
    labels = [(k, 0 if k % 10 == 0 else 1) for k in range(4000)] + [(4001, None), (None, 1), (1, 1)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in quality_rules(docs, labels).collect()}
    assert not any(out[k] for k in range(0, 4000, 10)) and all(out[k] for k in range(4000) if k % 10) and out[4000] and not out[4001]
    none = {r.doc_id: r.kept for r in quality_rules(docs, labels.limit(0)).collect()}
    assert all(none[k] for k in range(4001))
    few = {r.doc_id: r.kept for r in quality_rules(docs, labels.filter("doc_id < 30")).collect()}
    assert all(few[k] for k in range(4001))  # too few labels to promise anything


def test_few_labels_share_a_stratum(spark):
    """Languages with too few good rows are judged by the cutoffs of all of them together."""
    clean, junk = " ".join(f"word{k}" for k in range(40)), " ".join(f"word{k}***" for k in range(40))
    rows = [(k, junk if k % 10 == 0 else clean, ["de", "fr", "es", None][k % 4]) for k in range(2400)] + [(9000, junk, "pt"), (9001, clean, "pt")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 0 if k % 10 == 0 else 1) for k in range(2400)], "doc_id long, quality int")
    out = {r.doc_id: (r.stratum, r.kept) for r in quality_rules(docs, labels).collect()}
    assert {s for s, _ in out.values()} == {"pooled"} and not out[9000][1] and out[9001][1]
    assert all(out[k][1] == (k % 10 > 0) for k in range(2400))
    alone = {r.doc_id: r.stratum for r in quality_rules(docs, labels, pool_below=450).collect()}
    assert {alone[k] for k in range(4)} == {"lang de", "lang fr", "lang es", "lang "} and alone[9000] == "pooled"


def test_cutoffs_keep_their_risk(spark):
    """Over many draws of the labels a chosen cutoff rejects more good rows than promised in few of them."""
    from tapeloom.llm.quality_rules import RULES, chosen_cutoffs

    rng, n, draws, risk, error = np.random.default_rng(11), 1500, 60, 0.08, 0.1
    scores = np.arange(0, 600, 3)  # per mille; the true law of a good row's symbols
    chance = np.r_[0.93, np.full(199, 0.07 / 199)]
    rows = [(f"s{d}", int(x), 0, 1000, 0, 1000, 0, 1000) for d in range(draws) for x in rng.choice(scores, n, p=chance)]
    table = spark.createDataFrame(rows, "stratum string, n_symbols long, n_dup_lines long, word_chars long, n_repeat_words long, n_words long, n_lines long, x long")
    table = table.withColumn("word_chars", F.lit(1000).cast("long")).withColumn("n_lines", F.lit(10).cast("long"))
    wrong = {}
    for r in chosen_cutoffs(table, risk, error * draws).collect():  # each stratum is a draw of its own with the error of one
        if r.rule == "symbols":
            wrong[r.stratum] = chance[scores > r.cutoff].sum() > risk / len(RULES)
    assert len(wrong) > draws / 3 and sum(wrong.values()) <= 0.1 * draws


def test_binomial_tail(spark):
    from math import comb

    from tapeloom.llm.quality_rules import binomial_tail

    rows = [(n, k) for n in (1, 20, 700) for k in (0, 1, 3) if k <= n]
    for r in spark.createDataFrame(rows, "n long, k long").select("n", "k", binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect():
        exact = sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == (1.0 if r.k >= r.n * 0.01 else pytest.approx(exact))


TURNS = [
    (1, 2, "assistant", "second </s> \\ [INST]"), (1, 1, "user", "first\nline <s>"), (1, None, "system", "null turn"), (2, 1, None, None),
    (2, 2, "as\nsis</s>tant", "x"), (None, 1, "assistant", "lost"), (3, 1, "assistant", ""), (3, 1, "assistant", ""), (3, 1, "user", "tie é😀"),
    (5, 1, "assistant", "\\<\\s>[\\INST]"), *[(4, k, "assistant" if k % 2 else "user", f"turn {k} " + "long " * 200) for k in range(300)],
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for limit in (1 << 24, 2000):
        out = {}
        for r in format_chat(turns, limit).collect():
            assert "</s>[INST]" not in r.formatted
            taught = [unescaped(r.formatted[s.start : s.end]) for s in r.loss_spans]
            out.setdefault(r.conv_id, []).append((r.part, parsed(r.formatted), taught))
        for conv in {t[0] for t in TURNS}:
            want = [(t[2] or "", t[3] or "") for t in sorted((t for t in TURNS if t[0] == conv), key=key)]
            parts = sorted(out[conv])
            assert [x for _, p, _ in parts for x in p] == want
            assert [x for _, _, p in parts for x in p] == [t for r, t in want if r == "assistant"]
        back = {r.conv_id: r for r in read_back(format_chat(turns, limit)).collect()}
        want = [(t[2] or "", t[3] or "") for t in sorted((t for t in TURNS if t[0] == 4), key=key)]
        assert back[4].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest() and back[4].n_turns == 300
    assert format_chat(turns.limit(0)).count() == 0


def test_classifier_held_out(spark):
    rnd = random.Random(5)
    common = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(1500):
        grade = rnd.choice([0, 1, 2, 2, 2])
        w = [rnd.choice(common) for _ in range(60)]
        if grade == 0:
            w[5] = w[30] = rnd.choice(["vile", "nasty"])
        if grade == 1:
            w = [x + "###" for x in w]
        rows.append((k, " ".join(w), grade))
        if k < 1000:
            labels.append((k, int(grade != 1), int(grade == 0)))
    rows += [(1500, None, 2), (1501, "", 2), (None, "w1 w2", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    table = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    out = classify(docs, table).select("row.doc_id", "row.kept", "expected_grade", "p_poor_or_better", "p_good", F.col("kept").alias("stays")).collect()
    test = [r for r in out if r.doc_id is not None and 1000 <= r.doc_id < 1500]
    assert sum(r.stays == (r.kept == 2) for r in test) >= 0.95 * len(test) and len(out) == len(rows)
    assert all(0 <= r.p_good <= r.p_poor_or_better <= 1 and abs(r.expected_grade - r.p_good - r.p_poor_or_better) < 1e-9 for r in out)
    assert classify(docs, table.limit(0)).filter("kept AND expected_grade IS NULL").count() == len(rows)


def test_classifier_holds_its_sample_once(spark, monkeypatch):
    """What the driver holds of the labelled rows is their features, not several copies of them."""
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(600)), lambda x: F.md5(F.concat_ws("-", "id", x))), " ")
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), text.alias("text")).repartition(4)
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    monkeypatch.setattr(ordinal, "STEPS", 1)
    monkeypatch.setattr(ordinal, "BUCKETS", 1 << 14)
    tracemalloc.start()
    ordinal.fit_on(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * 2000 * 2 * 601 * 4, peak  # a term and its stem of each word; one batch of the fit takes about as much


def test_token_counts(docs, plain):
    sentencepiece = pytest.importorskip("sentencepiece")
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in plain]
    assert got(token_counts(docs, path)) == sorted(want, key=repr)


def test_transducer_odd_texts():
    sentencepiece = pytest.importorskip("sentencepiece")
    tokenizers = pytest.importorskip("public_tokenizers")
    from tapeloom.llm.token_counts import SPACE, _counts, read_vocabulary

    path = tokenizers.path("piece_bpe_32k.model")
    vocabulary, model, rnd = read_vocabulary(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(2)
    letters = [*"abcdefgh  \n\t.,;()*_-<>/'\"|01ABéèüñ", SPACE, "執", "​", "😀", "\r", "\x00", "    ", "<s>", "</s>"]
    pieces = list(vocabulary.place)
    odd = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    odd += ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 9))).replace(SPACE, " ") for _ in range(2000)] + [" " * 500, "z" * 3000]

    class Sent:
        value = vocabulary

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(odd))), pa.array(odd)], ["doc_id", "text"])
    have = [n for b in _counts(Sent, 4096)(iter([batch])) for n in b.column("n_tokens").to_pylist()]
    assert have == [len(x) for x in model.encode(odd)]


def test_language_model(docs, plain):
    have = sorted((tuple(r) for r in score_texts(docs, contexts=20).collect()), key=repr)
    want = sorted(brute.base_scores(plain), key=repr)
    assert [h[:5] for h in have] == [w[:5] for w in want]
    assert all(h[5] == pytest.approx(w[5], rel=1e-9) for h, w in zip(have, want))
    trained = [h for h in have if not h[1]]
    assert sum(h[6] for h in trained) > sum(h[5] for h in trained)  # contexts help
    again = sorted((tuple(r) for r in score_texts(docs.repartition(2), contexts=20).collect()), key=repr)
    assert [(a[0], a[6]) for a in again] == [(h[0], pytest.approx(h[6], rel=1e-5)) for h in have]


def test_language_model_sums_to_one(spark):
    """What follows a context is a distribution: recovered from the scores of texts of up to three words."""
    import zlib

    words = ["a", "b", "c", "d", "zzz"]  # the last one is unknown
    texts = ["", *words, *(f"{w} {x}" for w in words for x in words), *(f"a {x} {y}" for x in words for y in words)]
    train = [(k, " ".join(random.Random(k).choices(words[:4], [8, 4, 2, 1], k=30))) for k in range(300) if zlib.crc32(str(k).encode()) % 5 != 1]
    held = [k for k in range(1000, 9000) if zlib.crc32(str(k).encode()) % 5 == 1]
    ask = list(zip(held, texts))
    out = {r.doc_id: 10 ** r.score for r in score_texts(spark.createDataFrame(train + ask, "doc_id long, text string")).collect()}
    p = {t: out[i] for i, t in ask}
    # R[x, y] = P(y | x) P(end | y) / P(end | x); rows of P(. | x) with the end add up to 1, which gives g[x] = 1 / P(end | x)
    ratio = np.array([[p[f"a {x} {y}"] / p[f"a {x}"] for y in words] for x in words])
    g = np.linalg.solve(np.eye(5) - ratio, np.ones(5))
    assert sum(p[w] * g[i] for i, w in enumerate(words)) + p[""] == pytest.approx(1, abs=1e-5)
    for i, x in enumerate(words):  # and the same rows after another first word
        for j, y in enumerate(words):
            assert p[f"{x} {y}"] * g[j] / (p[x] * g[i]) == pytest.approx(ratio[i, j] * g[j] / g[i], rel=1e-4)


def test_language_model_every_word_is_a_context(spark):
    """Each of 600 words is followed by one of its own; the held-out row's pairs are all in the training rows."""
    import zlib

    rnd = random.Random(3)
    pairs = [(f"w{k}", f"v{k}") for k in range(600)]
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = next(i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [(i, " ".join(" ".join(p) for p in rnd.sample(pairs, 60))) for i in train] + [(held, " ".join(" ".join(p) for p in pairs))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    of = lambda **kw: {r.doc_id: r.score for r in score_texts(table, **kw).collect()}[held]
    whole, capped = of(), of(contexts=255)
    # a follower costs next to nothing beside its word, which is one of 600; without its context it is one of hundreds itself
    assert whole > -600 * (math.log10(600) + 0.5) and whole > capped + 345 * 1.5


def seatings(c, a, d, p):
    """Chance of each number of tables, all ways to seat c customers added up one by one."""
    ways = {(1,): 1.0}
    for n in range(1, c):
        after: dict[tuple, float] = {}
        for sizes, w in ways.items():
            for i, s in enumerate(sizes):
                key = tuple(sorted([*sizes[:i], s + 1, *sizes[i + 1 :]]))
                after[key] = after.get(key, 0) + w * (s - d)
            key = tuple(sorted([*sizes, 1]))
            after[key] = after.get(key, 0) + w
        ways = after
    out = np.zeros(c)
    for sizes, w in ways.items():
        t = len(sizes)
        out[t - 1] += w * p**t * math.prod(a + d * k for k in range(t))
    return out / out.sum()


@pytest.mark.parametrize("c, a, d, p", [(2, 1.0, 0.5, 0.1), (5, 40.0, 0.7, 0.3), (8, 3.0, 0.9, 0.02), (12, 100.0, 0.2, 0.05)])
def test_reseat_draws_from_the_conditional(c, a, d, p):
    from tapeloom.llm.language_model import reseat

    n, want = 40_000, seatings(c, a, d, p)
    got = np.bincount(reseat(np.full(n, c), np.full(n, a), d, np.full(n, p), np.random.default_rng(5)), minlength=c + 1)[1:] / n
    assert np.abs(got - want).max() < 4 * math.sqrt(0.25 / n)


@pytest.mark.parametrize("d", [0.1, 0.5, 0.7, 0.95])
def test_stirling_numbers_of_large_dishes(d):
    """Sum and saddle point against the recursion, as weights of table counts."""
    from tapeloom.llm.language_model import log_stirling, log_stirling_large

    exact = log_stirling(1500, d)
    for c in (1100, 1500):
        t = np.arange(1, 1001)
        off = log_stirling_large(c, t, d) - exact[c, 1:1001]
        assert np.abs(off[:5]).max() < 1e-7 and np.abs(off).max() < 0.03
        for a, p in [(40.0, 0.2), (1000.0, 0.05), (5.0, 0.001)]:
            log = exact[c, 1:1001] + t * math.log(p) + np.cumsum(np.log(a + d * (t - 1.0)))
            w, v = np.exp(log - log.max()), np.exp(log + off - (log + off).max())
            assert np.abs(w / w.sum() - v / v.sum()).sum() < 5e-3  # twice the distance of the distributions


def test_reseat_of_large_dishes():
    from tapeloom.llm import language_model as module

    c, a, d, p = 3000, 40.0, 0.7, 0.2
    log = module.log_stirling(c, d)[c, 1:] + np.arange(1, c + 1) * math.log(p) + np.cumsum(np.log(a + d * np.arange(c)))
    w = np.exp(log - log.max())
    mean = (w * np.arange(1, c + 1)).sum() / w.sum()
    spread = math.sqrt((w * (np.arange(1, c + 1) - mean) ** 2).sum() / w.sum())
    got = module.reseat(np.full(600, c), np.full(600, a), d, np.full(600, p), np.random.default_rng(5))
    assert abs(got.mean() - mean) < 4 * spread / math.sqrt(600) and abs(got.std() / spread - 1) < 0.15


def test_embeddings(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(60):
        v = [rnd.gauss(0, 1) for _ in range(16)]
        rows.append(v)
        for _ in range(rnd.choice([0, 0, 1, 3])):
            rows.append([x + rnd.gauss(0, 0.05) for x in v])
    rows += [rows[0]] * 3 + [[x * 2 for x in rows[1]], None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0, None], [1.0, 2.0], [2.0, 4.0]]
    table = [(k, v) for k, v in enumerate(rows)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").withColumn("links", F.lit("x"))
    have = sorted(got(embedding_dedup(df)))
    import numpy as np

    exact = brute.near_vectors([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in table])
    assert have == exact


def test_embeddings_in_double(spark):
    """Components that a float does not hold, or whose squares a double does not."""
    rows = [[1e300, 0.0], [1e300, 0.0], [1e-60, 1e-60], [1.0, 1.0], [1e-300, 0.0], [1.0, 1e200], [-1e300, 0.0], [5e-324, 0.0]]
    out = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()}
    assert out == {0: (3, 0), 1: (3, 0), 2: (1, 2), 3: (1, 2), 4: (3, 0), 5: (0, 5), 6: (0, 6), 7: (3, 0)}


def test_embedding_blocks(spark, monkeypatch):
    from tapeloom.llm import embedding_dedup as module

    monkeypatch.setattr(module, "BLOCK", 16)
    rnd = random.Random(6)
    base = [rnd.gauss(0, 1) for _ in range(16)]
    table = [(k, [x + rnd.gauss(0, 0.1) for x in base]) for k in range(120)]
    have = sorted(got(module.embedding_dedup(spark.createDataFrame(table, "vec_id long, embedding array<float>"))))
    import numpy as np

    assert have == brute.near_vectors([(i, [float(np.float32(x)) for x in v]) for i, v in table])


def test_packing(docs, plain):
    packed = pack(docs).select("row.doc_id", "piece", "first_word", "n_words", "bin_id", "bin_length", "bin_offset").collect()
    words = {}
    for r in packed:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_words
    want = {}
    for i, t in plain:
        want[i] = want.get(i, 0) + len(brute.words_of(t))
    assert words == want
    bins = {}
    for r in packed:
        assert (r.bin_id is None) == (r.n_words == 0)
        if r.n_words:
            bins.setdefault((r.bin_id, r.bin_length), []).append((r.bin_offset, r.n_words))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, length), held in bins.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert length == min(x for x in LENGTHS if x >= at)


def test_packing_deals_equal_rows(spark):
    """A table of one row repeated goes to all shards, and no bin holds more than it may."""
    df = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("five words of one text").alias("text"))
    out = pack(df, lengths=(64, 128), per_shard=1000)
    bins = out.groupBy("bin_id").agg(F.sum("n_words").alias("n"), F.max("bin_length").alias("l"), F.count_distinct("bin_offset").alias("o"), F.count("*").alias("c"))
    assert out.count() == 20_000 and bins.filter("n > l OR o < c").count() == 0
    per_shard = [r[0] for r in out.groupBy(F.shiftright("bin_id", 32)).count().select("count").collect()]
    assert len(per_shard) == 20 and max(per_shard) < 1300


@pytest.mark.parametrize("run", [pack, mix, suffix_dedup, line_dedup, lambda d: classify(d, d.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))])
def test_carried_columns_of_any_name_and_type(spark, run):
    """Columns that cannot be null, nested ones, and names with dots and backticks."""
    from pyspark.sql import types as T

    inner = T.StructType([T.StructField("x.y", T.LongType(), False), T.StructField("z", T.ArrayType(T.LongType(), False), False)])
    schema = T.StructType([
        T.StructField("doc_id", T.LongType(), False), T.StructField("text", T.StringType(), False), T.StructField("lang", T.StringType(), False),
        T.StructField("source", T.StringType(), False), T.StructField("a.b", T.StringType(), False), T.StructField("c`d", inner, False),
    ])
    rows = [(k, f"text number {k} " * 9, "en", "s", "dot", (k, [k, k])) for k in range(6)]
    out = run(spark.createDataFrame(rows, schema))
    back = out.select("row.*")
    assert back.columns == schema.names
    assert sorted(tuple(r) for r in back.distinct().collect()) == [(*r[:5], (r[0], [r[0], r[0]])) for r in rows]


def test_best_fit_choice():
    """Every piece goes into the open bin that it leaves least space in; bins open when none has room."""
    import numpy as np

    from tapeloom.llm.packing import best_fit

    rnd = random.Random(8)
    sizes = np.array(sorted((rnd.randint(1, 64) for _ in range(300)), reverse=True), np.int64)
    bins, offsets, lengths = best_fit(sizes, (64,))  # one length: rooms are known
    room = {}
    for size, b, at in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        fitting = [r for r in room.values() if r >= size]
        if b in room:
            assert room[b] == min(fitting)
        else:
            assert not fitting
            room[b] = 64
        assert at == 64 - room[b]
        room[b] -= size
    bins, _, lengths = best_fit(sizes, (16, 32, 64))
    total = {b: int(sizes[bins == b].sum()) for b in set(bins.tolist())}
    assert all(lengths[k] == min(x for x in (16, 32, 64) if x >= total[b]) for k, b in enumerate(bins.tolist()))
    assert lengths.max() == 64 and len(best_fit(sizes[:0])[0]) == 0


@pytest.mark.parametrize("run", [
    lambda d: embedding_dedup(d.selectExpr("doc_id AS vec_id", "array(1.0D) AS embedding")), ngram_jaccard_join, suffix_dedup, mix, score_texts, pack, lambda d: text_counts(d, ["doc_id"]),
    lambda d: quality_rules(d, d.selectExpr("doc_id", "1 AS quality")), lambda d: classify(d, d.selectExpr("doc_id", "1 AS quality", "0 AS toxic")),
])
def test_empty_table(docs, run):
    assert run(docs.limit(0)).count() == 0


def test_runs_cut_batches():
    texts = pa.array(["ab", None, "", "x" * 10, "cd ef"])
    runs = list(scan.runs(texts.slice(1), 5))
    assert [(r.first, r.last) for r in runs] == [(0, 2), (2, 3), (3, 4)] and sum(len(r.data) for r in runs) == 15


def test_language_model_counts_pairs_in_little_memory():
    """A task that counts a million distinct pairs holds fewer than 115 bytes for each at its peak."""
    import tracemalloc

    from tapeloom.llm import language_model as module

    class All:
        value = None

    draw = np.random.default_rng(3)
    texts = [" ".join(map(str, draw.integers(0, 30000, 2000))) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    try:
        pairs = sum(n for b in module._count_pairs(8, All)(iter([batch])) for n in b.column("n").to_pylist())
        assert pairs > 900_000 and tracemalloc.get_traced_memory()[1] < 115 * pairs
    finally:
        tracemalloc.stop()


def test_language_model_sends_pairs_before_a_task_holds_them_all(monkeypatch):
    """A counting task sends whenever it holds many distinct pairs, and the sums stay the same."""
    from tapeloom.llm import language_model as module
    from tapeloom.llm.wire import unpacked

    class All:
        value = None

    draw = np.random.default_rng(3)
    texts = [" ".join(map(str, draw.integers(0, 3000, 20000))) for _ in range(30)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 10])], ["text"]) for i in (0, 10, 20)]

    def counts() -> tuple[int, dict]:
        sums, rows = {}, [b for b in module._count_pairs(4, All)(iter(batches))]
        for b in rows:
            for n, data in zip(b.column("n").to_pylist(), b.column("data")):
                for word, context, count in zip(*(c.tolist() for c in unpacked(data, n, ["<u8", "<u8", "<i8"]))):
                    sums[word, context] = sums.get((word, context), 0) + count
        return len(rows), sums

    whole = counts()
    monkeypatch.setattr(module, "SENT_KEYS", 100_000, raising=False)
    parts = counts()
    assert whole[0] == 1 and parts[0] > 2 and parts[1] == whole[1] and sum(whole[1].values()) == 30 * 20001


def test_language_model_answers_blocks_of_training_rows_with_less(monkeypatch):
    """Pairs of training rows are all counted, so their blocks get no probabilities of parents."""
    from tapeloom.llm import language_model as module

    class Value:
        def __init__(self, value):
            self.value = value

    texts = ["a b a c", "b c d", "a a b"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    (state,) = module._first_state(1)(module._count_pairs(1, Value(None))(iter([batch])))
    totals = (9.0, 5.0, 0.5, 0.5, 5, 13)
    sums = module._sent_tables(1, True)(iter([state]))
    (places,) = module._first_contexts(sums)
    (laid,) = module._summed_tables(iter([places, *module._sent_tables(1, False)(iter([state]))]))
    (state,) = module._sweep(Value(totals), 0, True, True)(iter([state, laid]))
    sizes = {}
    for held_out in (False, True):
        block = pa.table({"doc_id": [1, 2, 3], "text": texts, "held_out": [held_out] * 3, "block": pa.array([0] * 3, pa.int32())})
        asked = module._ask(1, Value(None))(block).to_batches()
        (answer,) = module._answer(Value([totals]))(iter([state, *asked]))
        sizes[held_out] = answer
    few, all_ = (module._boxes(iter([sizes[k]]))[0][module._ASKED][0] for k in (False, True))
    assert few.shape[2] == 0 and all_.shape[2] == 1 and len(few.data[0].as_py()) < len(all_.data[0].as_py()) and few.data[1] == all_.data[1]
    own = module.unpacked(few.data[1], few.shape[1], ["<f4"])[0]
    assert (own > 0).all()


def test_language_model_waves_score_alike(spark, monkeypatch):
    """Blocks are scored in waves, each written before the next, and every row comes out once with the same numbers."""
    from tapeloom.llm import language_model as module

    rows = [(i, None if i == 5 else f"a b word{i % 7} c{i} a") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(score_texts(docs, sweeps=1, burn=0).collect())
    written = []
    monkeypatch.setattr(module, "WAVE_BYTES", 100, raising=False)
    monkeypatch.setattr(module, "Stage", lambda df, name: written.append(name) or Stage(df, name), raising=False)
    assert sorted(score_texts(docs, sweeps=1, burn=0).collect()) == whole and len(whole) == 60
    assert len(written) == module.WAVES
