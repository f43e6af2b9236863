import random

import numpy as np
import pytest

from wakeline.llm import abuse, leaks, survivor, tokens

DOC = "doc_id long, text string"
HARD = ["", " ", "\n\n\n a", "don't I'LL we'Re", "naïve ﬁ  \r\n\t z ", "½ ²3 Ⅷ", "🙂👩‍👩‍👧  ", "a\x1cb\x1d c", " \x85x", "<|endoftext|> hi", "x" * 5000 + " " * 300, "日本語のテキスト。", "​﻿", "tab\t\t\tend  "]


# -- tokens -------------------------------------------------------------------

@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.serialise(tokens.read_ranks()))


def test_ids_equal_public_encoder_and_round_trip(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {b: i for i, b in enumerate(tokens.read_ranks())}
    ref = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("abcE é1,.\n\t 'ß中🙂") for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert encoder.encode(t) == ref.encode_ordinary(t)
        assert encoder.decode(encoder.encode(t)) == t


def test_encode_corpus_edges(spark, encoder):
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "x"), (5, HARD[10])]
    got = [(r.doc_id, list(r.ids)) for r in tokens.encode_corpus(spark.createDataFrame(rows, DOC)).collect()]
    assert sorted(got, key=str) == sorted([(k, encoder.encode(t)) for k, t in rows], key=str)
    assert dict(got)[1] == dict(got)[2] == []
    assert tokens.encode_corpus(spark.createDataFrame([], DOC)).count() == 0


# -- leaks --------------------------------------------------------------------

WORDS = [f"w{k}" for k in range(300)]


def item(rng, n=60):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def found(docs, items):
    table = leaks.Items(list(enumerate(items)))
    return {(d, table.ids[i]) for d, i, _ in leaks.leaks_of(docs, table)}


def test_leak_forms_and_traps():
    rng = random.Random(2)
    stock = " ".join(f"s{k}" for k in range(30))
    items = [item(rng), item(rng) + "\n\n" + stock, item(rng) + "\n\n" + stock, None, "", "too short to leak"]
    a = items[0].split()
    part = a[10:40]
    altered = list(part)
    for k in (4, 14, 24):
        altered[k] = "typo"
    dropped = [w for k, w in enumerate(part) if k not in (7, 17)]
    docs = [
        items[0], "+ // " + "\n+ // ".join(" ".join(part[k : k + 6]) for k in range(0, 30, 6)), " ".join(part).upper(), "<p>" + "</p>\n<p>".join(part) + "</p>", "\\n".join(part),
        " ".join(w[:1] + "​" + w[1:] for w in part), " ".join(altered), " ".join(dropped), " ".join(part[:14]) + "\n" + "other line here " * 10 + "\n" + " ".join(part[14:]), "&amp;nbsp;".join(part),
        " ".join(part[:12]), stock, "x" * 3_000_000, None, "", "   ", " ".join(rng.choice(WORDS) for _ in range(4000)),
    ]
    assert found(docs, items) == {(k, 0) for k in range(10)}


def test_leaks_against_brute_force():
    rng = random.Random(3)
    items = [item(rng) for _ in range(30)]
    docs, want = [], set()
    for d in range(200):
        i = rng.randrange(30)
        n = rng.choice([8, 12, 15, 22, 30, 50])
        s = rng.randrange(0, 60 - n + 1)
        docs.append(" ".join([*(rng.choice(WORDS) for _ in range(30)), *items[i].split()[s : s + n], *(rng.choice(WORDS) for _ in range(30))]))
        if n >= 20:
            want.add((d, i))
    assert found(docs, items) == want  # runs of 20 exact words and more, none below 16


def test_leak_with_an_altered_copy_before_it():
    rng = random.Random(5)
    items = [item(rng)]
    part = items[0].split()[:30]
    altered = ["typo" if k in (5, 15, 25) else w for k, w in enumerate(part)]
    other = " ".join(f"x{k}" for k in range(40))
    split = " ".join(part[:14]) + f" {other} " + " ".join(part[14:])
    docs = [" ".join([*altered, other, *part]), " ".join([*part, other, *altered]), " ".join([*altered, other] * 20 + part), f"{' '.join(part[8:18])} {other} {split}", " ".join(part[14:]) + f" {other} " + " ".join(part[:14])]
    table = leaks.Items([(0, items[0])])
    assert leaks.leaks_of(docs[:4], table) == [(k, 0, 30) for k in range(4)]
    assert leaks.leaks_of(docs[4:], table) == []  # the parts in the wrong order


def test_leak_parts_without_seed_and_altered_ends():
    rng = random.Random(6)
    items = [item(rng)]
    a, x = items[0].split(), " ".join(f"x{k}" for k in range(40))
    cut = lambda n, m: f"{x} {' '.join(a[10 : 10 + n])} {x} {' '.join(a[10 + n : 10 + n + m])} {x}"
    run = lambda s, e: f"{x} {' '.join(a[s:e])} {x}"
    mixed = f"{x} {' '.join(a[10:25])} {x} {' '.join(a[25:27])} typo {' '.join(a[28:31])} {x}"
    docs = [cut(15, 6), cut(18, 7), cut(6, 15), cut(7, 13), cut(17, 3), mixed, run(10, 29), run(11, 29)]
    no = [cut(12, 5), run(10, 27), f"{' '.join(a[16:31])} {x} {' '.join(a[10:16])}", " ".join(a[10:29]), f"{' '.join(a[:18])}", run(0, 18)]
    assert found(docs, items) == {(k, 0) for k in range(len(docs))}
    assert found(no, items) == set()


def test_leak_with_drops_in_a_text_that_repeats_a_phrase(monkeypatch):
    rng = random.Random(7)
    items = [item(rng)]
    a = items[0].split()
    bits = [" ".join(w) for w in (a[20:28], a[29:34], a[35:43])]  # two words dropped; the middle part is too short for a seed
    phrase = " ".join([*a[46:56], *(f"y{k}" for k in range(9))]) + " "
    short, long = phrase + " ".join(bits), phrase * 500 + " ".join(bits)
    table = leaks.Items([(0, items[0])])
    table.rare = [np.zeros_like(r) for r in table.rare]  # by its hits alone
    for cells in (leaks.CELLS, 500):  # with any size of the chunks
        monkeypatch.setattr(leaks, "CELLS", cells)
        got = leaks.leaks_of([short, long], table)
        assert [k for k, _, _ in got] == [0, 1] and got[0][2] == got[1][2] >= 20


def test_leaked_items_in_blocks(spark):
    rng = random.Random(4)
    items = [(k, item(rng)) for k in range(7)] + [(None, item(rng)), (8, None)]
    docs = [(k, items[k][1]) for k in range(7)] + [(0, items[0][1]), (99, None)]
    di, ii = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")
    for block in (2, 100):
        got = sorted((r.doc_id, r.item_id) for r in leaks.leaked_items(di, ii, block=block).collect())
        assert got == sorted([(k, k) for k in range(7)] + [(0, 0)])
    empty = spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaked_items(di, empty).count() == 0
    assert leaks.leaked_items(spark.createDataFrame([], DOC), ii).count() == 0


@pytest.mark.parametrize("variants", [1, 3, 4, 9])
def test_near_variants_of_an_item_all_leak(variants):
    rng = random.Random(12)
    base = item(rng, 60).split()
    items = [" ".join(f"v{v}x{k}" if k % 12 == 11 else w for k, w in enumerate(base)) for v in range(variants)]  # eleven words shared, the twelfth its own
    assert found([items[0], " ".join(base[:11])], items) == {(0, v) for v in range(variants)}


def test_long_item_in_little_memory():
    import tracemalloc

    rng = random.Random(13)
    long = [f"w{rng.randrange(5000)}" for _ in range(10_000)]
    altered = [f"z{k}" if k % 10 == 5 else w for k, w in enumerate(long)]
    table = leaks.Items([(0, " ".join(long)), (1, item(rng))])
    tracemalloc.start()
    got = leaks.leaks_of([" ".join(long), " ".join(altered), " ".join(long[3000:3019]), " ".join(long[:5000] + ["x"] * 50 + long[5000:])], table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(0, 0, 10_000), (1, 0, 10_000), (3, 0, 10_000)] and peak < 100e6


def test_dense_windows_against_brute_force():
    rng = np.random.default_rng(14)
    for _ in range(300):
        n = int(rng.integers(20, 90))
        seg, own = np.flatnonzero(rng.random(n) < rng.choice([0.7, 0.85, 0.95])), rng.random(n) > 0.02
        seg = seg[own[seg]]
        best = 0
        for a in range(len(seg)):
            for b in range(a, len(seg)):
                i, j = seg[a], seg[b]
                if (b - a + 1) >= leaks.SHARE * (j - i + 1) - 1e-9 and own[i : j + 1].all() and (np.diff(seg[a : b + 1]) <= 4).all():
                    best = max(best, int(j - i + 1))
        got = leaks.dense(seg, own)
        assert got == best or max(got, best) < leaks.MIN_WORDS  # short ones are no leak, whatever their length


def test_blocks_give_what_one_table_gives(spark):
    """Stock paragraphs and shared runs are counted over all items, whatever the blocks."""
    rng = random.Random(15)
    stock = " ".join(f"s{k}" for k in range(30))
    base = item(rng).split()
    items = [(k, item(rng) + ("\n" + stock if k % 2 else "")) for k in range(6)]
    items += [(10 + v, " ".join(f"v{v}x{k}" if k % 12 == 11 else w for k, w in enumerate(base))) for v in range(5)] + [(20, items[0][1]), (20, items[0][1]), (None, "x"), (30, None), (31, "")]
    docs = [(0, stock), (1, items[1][1]), (2, items[7][1]), (3, items[0][1]), (4, " ".join(rng.choice(WORDS) for _ in range(3000))), (5, None)]
    di, ii = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(tuple(r) for r in leaks.leaked_items(di, ii).collect())
    assert {(d, i) for d, i, _ in want} == {(1, 1), *((2, 10 + v) for v in range(5))}
    for block in (1, 70, 200):
        assert sorted(tuple(r) for r in leaks.leaked_items(di, ii, block=block).collect()) == want


# -- abuse --------------------------------------------------------------------

LABEL = "text string, label string"
THINGS = "winch, parser, ledger, keel, cache, tide, router".split(", ")
# a few labelled sentences of each class, with a thing to fill in
FRAMES = {
    "abusive": ["you useless {i}, leave the {t} alone", "who let this {i} near the {t}, get lost", "the {t} was written by a {i} and a fool", "shut up about the {t}, you {i}", "eres un {i}, deja el {t}", "du {i}, lass den {t} in Ruhe"],
    "hateful": ["we should drown all {g}", "{g} are vermin and ruin every {t}", "keep {g} away from the {t}, they are thieves", "{g} do not deserve to live near a {t}"],
    "sexual": ["send me nude pictures or I revert the {t}", "horny tonight, come to the {t} and undress", "I put porn clips into the {t} folder"],
    "none": ["fix the {t} of the config file", "the {t} test covers the rest", "sorry, I was an idiot, the {t} is fine", "kill the child process of the {t}", "this {t} sucks, replace it", "the {t} keeps the old order of the {t}", "add a check for an empty {t}", "measured on 30 runs the {t} is faster"],
}


def labelled(seed, copies=6):
    rng = random.Random(seed)
    fill = lambda f: f.replace("{i}", rng.choice(["idiot", "moron", "loser", "imbécil", "Trottel"])).replace("{g}", rng.choice(["foreigners", "islanders", "newcomers"])).replace("{t}", rng.choice(THINGS))
    return [(fill(f), kind) for kind, frames in FRAMES.items() for f in frames for _ in range(copies)]


@pytest.fixture(scope="module")
def model(spark):
    return abuse.train(spark.createDataFrame([*labelled(1), (None, "none"), ("x", "other")], LABEL))


def test_spellings_never_seen(model):
    bad = ["YOU USELESS 1D10T, LEAVE THE BARGE ALONE!!", "you usel3ss m0r0n, leave the hull alone", "shut up about the mast, you i.d.i.o.t", "shut up about the mast, you l o s e r", "you uselеss idiоt, leave the barge alone", "the crane was written by a mooooron and a fool", "foreigners are v*rmin and ruin every barge", "newcomers are vermiiin and ruin every hull", "send me nud3 pictures or I revert the barge", "I put p o r n clips into the barge folder", "we should dr0wn all isl4nders"]
    good = ["fix the reader of the parser", "sorry, I was an idiot yesterday", "this cache sucks", "kill the child process", "The test covers the queue.", "", "for (int i = 0; i < n; i++) {", "return self.value if self.value is not None else default", "x" * 200]
    s = abuse.Scorer(model)
    hit, _ = s.score(bad)
    miss, _ = s.score(good)
    assert (hit >= abuse.THRESHOLD).mean() >= 0.9
    assert (miss >= abuse.THRESHOLD).sum() == 0


def test_frames_never_seen(spark):
    """Frames held out of the fit: what is found is right, and some is found by the words alone."""
    rows = labelled(2)
    apart = lambda t: any(x in t for x in ("get lost", "do not deserve", "horny", "keeps the old order", "sucks"))
    m = abuse.fit(tuple((k, t) for t, k in rows if not apart(t)))
    held = [(t, k) for t, k in rows if apart(t)]
    score, _ = abuse.Scorer(m).score([t for t, _ in held])
    flagged = [k for (_, k), s in zip(held, score) if s >= abuse.THRESHOLD]
    bad = sum(k != "none" for _, k in held)
    assert flagged.count("none") <= 0.1 * len(flagged) and len(flagged) >= 0.3 * bad


def test_known_words_in_frames_never_seen(model):
    """Insults and listed words of the fit in other sentences are found; the statement's no cases with them are not."""
    bad = ["nobody can work with you, moron, so please stay at home", "the whole crew laughs at you, loser", "what an idiot you are, the winch is broken again", "everybody on board knows that you are a Trottel", "he keeps porn and naked pictures on the office router", "her tits are bigger than the keel of this boat"]
    good = ["reports about porn and such language go to the log", "filter idiot and moron before the cache", "validate the islander flag of the early router", "merge the late branch into the main line", "xxx: look at the order of the tide again later"]
    s = abuse.Scorer(model)
    hit, _ = s.score(bad)
    miss, _ = s.score(good)
    assert (hit >= abuse.THRESHOLD).mean() >= 0.6
    assert (miss >= abuse.THRESHOLD).sum() == 0
    assert abuse.plain_word("xxx") == abuse.plain_word("xxxxx") == "xxx"


def test_listed_insults_amid_ordinary_text(model):
    """Insults no label holds are found in longer sentences never fitted; hashes, words of git and compounds are none."""
    bad = ["everybody who has read this release knows that its author is a numskull and a coward", "such a knucklehead should not be given the keys of the server before the next release", "after three weeks of review the committee of dickheads still wants another version", "the pictures in the folder of the second release show her naked with a dildo and a vibrator"]
    good = ["index 02bfcda..f0dacde 100644", "revert the merge of the early branch", "the sex chromosome column of the table is read once more", "keep the garbage collector out of the trash can"]
    s = abuse.Scorer(model)
    hit, _ = s.score(bad)
    miss, _ = s.score(good)
    assert (hit >= abuse.THRESHOLD).any() and hit.min() > 2 * miss.max()
    assert (miss >= abuse.THRESHOLD).sum() == 0
    assert abuse.plain_word("f0dacde") == "0x"
    rows = [(k, [w for x in abuse.split_sentences(t) for w in x]) for t, k in labelled(1)]
    assert any("numskul" in slot for slot in abuse.charged_words(rows, {"the", "you", "and"})["idiot"])


def test_charged_words_fill_slots_of_bad_sentences():
    rows = [(k, [w for s in abuse.split_sentences(t) for w in s]) for t, k in labelled(1)]
    charged = abuse.charged_words(rows, {"the", "you", "and"})
    assert {"idiot", "moron", "loser", "foreigners", "islanders"} <= set(charged)
    assert not set(charged) & set(THINGS)
    assert set(abuse.trade_words(rows, charged)) >= {"parser", "router", "tide"}


def test_long_words_have_all_their_grams_and_fitting_reads_no_corpus(model):
    assert len(abuse.features("a" * 24)) + 3 == len(abuse.features("a" * 25)) and len(abuse.features("ab" * 500)) > 2900
    assert abuse.plain_word("m0therf*ckersandmorons") != "0x" and abuse.plain_word("9f86d081884c7d659a2feaa0c55ad015") == "0x"
    again = abuse.fit.__wrapped__(tuple(sorted((k, t) for t, k in labelled(1))))
    assert np.array_equal(again.weights, model.weights)  # nothing but the labels decides


def test_scores_of_edges(spark, model):
    rows = [(1, None), (2, ""), (3, " \n\n"), (4, "z" * 100_000), (5, "fine line\n" * 500 + "you are a stupid idiot and a moron\n" + "fine line\n" * 500), (5, "fine line\n" * 500 + "you are a stupid idiot and a moron\n" + "fine line\n" * 500)]
    got = [(r.doc_id, r.score, r.label) for r in abuse.scored(spark.createDataFrame(rows, DOC), model).collect()]
    assert len(got) == 6 and all(s == 0 and k == "none" for d, s, k in got if d < 4)
    assert [k for d, _, k in got if d == 5] == ["abusive", "abusive"]
    assert abuse.scored(spark.createDataFrame([], DOC), model).count() == 0


def test_batch_score_equals_single_sums(model):
    """The cached sums give what the model says bag by bag."""
    s = abuse.Scorer(model)
    for text in ("whoever wrote this is a liar", "the quick parser reads one more line today"):
        words = [w for x in abuse.split_sentences(text) for w in x]
        codes = np.array([abuse.crc32(w.encode()) for w in words])
        b = np.concatenate([*[abuse.features(w) for w in words], abuse.pair_buckets(codes[:-1], codes[1:])])
        z = model.weights[b].sum(0) / (len(b) + abuse.SHRINK) + model.bias
        want = 1 - abuse.softmax(z[None])[0, 0]
        assert s.score(["other words\n" + text + "\nmore"])[0][0] == pytest.approx(want, abs=1e-4) or want < 0.05


# -- survivors ----------------------------------------------------------------

def test_best_and_summed_votes(spark):
    from pyspark.sql import functions as F

    rows = [
        ("g", "ALFA", None, 10, 100, 1), ("g", "BETA", "x", 5, 200, 2), ("g", "BETA ", "x", 5, 200, 3), ("g", "beta", None, 5, 200, 4), ("g", None, "y", 10, 100, 5), ("g", "ALFA", None, 10, 100, 6),
        ("h", None, None, 10, 100, 7), ("i", "ALFA", "x", 1, 50, 9), ("i", "ALFA", "x", 1, 50, 8),
    ]
    df = spark.createDataFrame(rows, "grp string, a string, b string, trust int, time long, id long").withColumn("value", F.lit("clash"))
    long = survivor.unpivoted(df, ["grp"], {"a": (F.col("a"), F.col("a").isNotNull()), "b": (F.col("b"), F.col("b").isNotNull())}, F.col("trust"), F.col("time"), F.col("id"))
    two = ["a", "b"]
    best = {(r.grp, r.field_name): r.ident for r in survivor.best_votes(long, ["grp"], two).collect()}
    assert best == {("g", "a"): 1, ("g", "b"): 5, ("i", "a"): 8, ("i", "b"): 8}
    records = survivor.survivors(survivor.summed(long, ["grp"], 1e9), ["grp"], two)
    out = {r.grp: (r.a.value, r.b.value) for r in records.collect()}
    assert out["g"][0] == "ALFA" and out["i"] == ("ALFA", "x") and "h" not in out  # 20 against 15
    fast = survivor.summed_votes(long, ["grp"], two, 10.0)
    assert {(r.grp, r.field_name): r.value for r in fast.collect()}["g", "a"].strip().upper() == "BETA"
    assert survivor.best_votes(long.limit(0), ["grp"], two).count() == 0


def test_summed_votes_against_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    day = 86_400
    rows = [(rng.choice(["g", "g", "g", "h", None]), rng.choice(["x", "X ", "y", "z", None]), rng.randrange(1, 5), 1_073_000_000 + rng.randrange(400) * day, k) for k in range(600)]
    rows += [("far", "x", 1, 9_000_000_000, 1000), ("far", "y", 1, 9_000_000_000, 1001), ("far", "old", 4, 0, 1002)]  # no power overflows; a tie
    df = spark.createDataFrame(rows, "grp string, a string, trust int, time long, id long")
    long = survivor.unpivoted(df, ["grp"], {"a": (F.col("a"), F.col("a").isNotNull())}, F.col("trust"), F.col("time"), F.col("id"))
    got = {r.grp: (r.value, r.ident) for r in survivor.summed_votes(long, ["grp"], ["a"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g and r[1] is not None]
        newest = max(r[3] for r in own)
        votes, best = {}, {}
        for _, a, trust, t, k in own:
            n = a.strip().upper()
            votes[n] = votes.get(n, 0) + trust * 2 ** ((t - newest) / survivor.HALF_LIFE_S)
            best[n] = max(best.get(n, (0,)), (trust, t, -k, a))
        top = max(votes, key=lambda n: (round(votes[n], 4), best[n]))
        want[g] = (best[top][3], -best[top][2])
    assert got == want


def test_imo_check_digit(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(9074729,), (9074728,), (907472,), (None,), (0,)], "imo long")
    assert [r[0] for r in df.select(survivor.imo_holds(F.col("imo"))).collect()] == [True, False, False, False, False]
