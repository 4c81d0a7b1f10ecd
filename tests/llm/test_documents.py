import random

import numpy as np
import pytest

from webloom.llm import leaks, repeats, tokens

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TRICKY = ["", " ", "\n\n  \t", "aaa" * 500, "l’été à Ünïted", "it's don't WE'LL", "日本語テキスト", "<|endoftext|> x", "\U0001f600" * 40, "x" * 5000, "0123456789" * 30, "\x00\x01", "код и текст"]


def test_ids_match_the_public_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    from webloom.llm.queries import BYTE_BPE_PATTERN

    ranks = tokens.load_ranks(VOCAB)
    ours = tokens.encoder(ranks, BYTE_BPE_PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = TRICKY + ["".join(rng.choice("ab xyzéж\n1'") for _ in range(rng.randrange(200))) for _ in range(300)]
    for t in texts:
        assert ours(t) == theirs.encode_ordinary(t), t
        assert theirs.decode(ours(t)) == t
    assert ours(None) == []


def test_encoding_frame_with_nulls_and_clashing_columns(spark):
    from webloom.llm.queries import BYTE_BPE_PATTERN

    df = spark.createDataFrame([(1, "hello", 9, "z"), (2, None, 9, "z"), (3, "", 9, "z"), (3, "", 9, "z")], "doc_id long, text string, i int, t string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in tokens.encode_texts(df, "doc_id", "text", VOCAB, BYTE_BPE_PATTERN).collect())
    assert got[1:] == [(2, []), (3, []), (3, [])] and len(got[0][1]) == 1
    assert tokens.encode_texts(df.limit(0), "doc_id", "text", VOCAB, BYTE_BPE_PATTERN).count() == 0


def test_null_keys_keep_large_ids_whole(spark):
    from webloom.llm.queries import BYTE_BPE_PATTERN

    big = 2**62 + 1
    df = spark.createDataFrame([(big, "same words again here. " * 9), (None, "same words again here. " * 9), (1, PASSAGE)], "doc_id long, text string")
    assert {r[0] for r in tokens.encode_texts(df, "doc_id", "text", VOCAB, BYTE_BPE_PATTERN).collect()} == {big, None, 1}
    assert {r[0] for r in repeats.shares(df).where("share > 0.5").collect()} == {big, None}
    assert {r[0] for r in repeats.repetitive(df).collect()} == {big, None}
    items = spark.createDataFrame([(big, PASSAGE), (None, PASSAGE)], "item_id long, text string")
    assert [tuple(r)[:2] for r in leaks.find_leaks(df, items).collect()] == [(1, big)]


def brute_share(text):
    import re

    words, mark, lines, sents = [], [], set(), set()
    for line in re.split(r"[\r\n]+", text.lower()):
        lw = []
        lm = []
        for s in re.split(r"(?<=[.!?…])\s+", line):
            w = repeats._WORD.findall(s)
            if w:
                lm += [tuple(w) in sents] * len(w)
                sents.add(tuple(w))
                lw += w
        if lw:
            if tuple(lw) in lines:
                lm = [True] * len(lw)
            lines.add(tuple(lw))
        words += lw
        mark += lm
    for j in range(len(words) - 9):
        if any(words[i : i + 10] == words[j : j + 10] for i in range(j)):
            mark[j : j + 10] = [True] * 10
    return sum(mark) / len(words) if words else 0.0


def test_share_matches_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice(["a", "b", "c d", ". ", "\n", " ", " 1) ", "A", "! "]) for _ in range(rng.randrange(120)))
        assert repeats.repeated_share(t) == pytest.approx(brute_share(t)), t
    assert repeats.repeated_share(None) == repeats.repeated_share("") == repeats.repeated_share(" \n") == 0


def test_repetitive_documents(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + ".", "e") for i in range(60)]
    rows += [(100 + i, f"one more line about subject a{i} and b{i} here.\n" * 9, "e") for i in range(30)]
    rows += [(200, None, "e"), (201, "", "e"), (202, "x " * 100_000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, share string")
    got = {r["doc_id"] for r in repeats.repetitive(df).collect()}
    assert got == {100 + i for i in range(30)} | {202}
    assert repeats.repetitive(df.limit(0)).count() == 0
    assert repeats.shares(df).where("share = 0").count() == 62


PASSAGE = "In 1884 the quarry clerk from the lower quay of Kelvifield engraved the ledger of unpaid tolls (315) from the deck of a dredger, Lunel Drodoun noted, so the price of tin doubled."


def test_leak_runs():
    f = leaks.LeakFinder([(1, PASSAGE), (2, "")])
    w = PASSAGE.split()
    items = lambda t: [h[0] for h in f.items(t)]
    assert items(PASSAGE) == [1] and items(PASSAGE.upper() + " x " + PASSAGE) == [1]
    assert items("so " + " ".join(w[:15]) + " etc") == [1]
    assert items(" ".join(w[:14])) == []
    assert items("<p>" + "<b> ".join(w[4:22]).replace("a", "á") + "</p>") == [1]
    assert items(" ".join([*w[:6], "WRONG", *w[7:14], "ADDED", *w[14:20]])) == [1]
    assert items(" ".join(x for k, x in enumerate(w) if k % 4)) == []
    assert items(None) == items("") == items("  ") == []


def test_errors_count_without_rare_words():
    """Items of one small vocabulary have no rare word; a changed word among twenty is a leak all the same."""
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("stone", "river", "lamp", "gate", "roof") for b in ("", "s", "er", "ing")]
    for n in (1, 5, 60):
        passages = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(n)]
        f = leaks.LeakFinder(passages)
        for item, p in passages:
            w = p.split()
            part = w[20:40]
            assert item in [h[0] for h in f.items(" ".join(part))]
            part[9] = "changed"
            assert [h[0] for h in f.items(" ".join(part))] == [item]
    # Items that share their passage all come out; a copy doesn't make its words look common.
    f = leaks.LeakFinder([("a", PASSAGE), ("b", PASSAGE), ("c", PASSAGE.upper())])
    w = PASSAGE.split()
    assert sorted(h[0] for h in f.items(" ".join([*w[:8], "else", *w[9:20]]))) == ["a", "b", "c"]


def test_stock_phrases_with_other_names_are_no_leak():
    said = "In {} the quarry clerk of {} engraved the ledger of unpaid tolls from the deck of a dredger near {}."
    f = leaks.LeakFinder([(str(i), said.format(1800 + i, f"Velby{i}", f"Norr{i}")) for i in range(20)])
    assert f.items(said.format(1950, "Tarnwick", "Oslow")) == []
    assert [h[0] for h in f.items(said.format(1803, "Velby3", "Oslow"))] == ["3"]


def test_block_search_matches_scan():
    rng = random.Random(3)
    for _ in range(60):
        pats = {"".join(rng.choice("abc ") for _ in range(rng.randrange(4, 12))): [] for _ in range(12)}
        text = "".join(rng.choice("abc ") for _ in range(400))
        want = sorted((i + len(p), p) for p in pats for i in range(len(text)) if text.startswith(p, i))
        assert sorted(leaks.BlockSearch(pats, 3).find(text)) == want


def test_find_leaks_frame(spark):
    docs = spark.createDataFrame([(1, "x\n" + PASSAGE, "n"), (2, None, "n"), (3, "", "n"), (4, PASSAGE[:60], "n")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, f"Read.\n\n{PASSAGE}\n\nWhat?", 0), (8, None, 0)], "item_id long, text string, i int")
    assert [(r[0], r[1]) for r in leaks.find_leaks(docs, items).collect()] == [(1, 7)]
    assert leaks.find_leaks(docs, items.limit(0)).count() == 0
    # Sets larger than one part are searched part by part, with the same rows.
    many = spark.createDataFrame([(i, PASSAGE.replace("quarry", f"w{i} quarry").replace("Kelvifield", f"Kelvi{i}")) for i in range(40)] + [(99, PASSAGE)], "item_id long, text string")
    one, parts = ({tuple(r)[:2] for r in leaks.find_leaks(docs, many, part_bytes=b).collect()} for b in (10**6, 900))
    assert (1, 99) in one and one == parts


def test_calibrated_model_orders():
    texts = [" ".join(f"v{i}{k}" for k in range(50)) for i in range(60)] + ["same words again here. " * 12 + f"k{i}" for i in range(40)]
    m = repeats.train(texts)
    p = m.probability(np.array([repeats.features(t) for t in texts]))
    assert p[:60].max() < p[60:].min()


def test_run_numbers_are_exact():
    rng = random.Random(6)
    codes = np.array([rng.randrange(2) for _ in range(3000)])
    h = repeats._runs(codes)
    by = {}
    for i in range(len(codes) - repeats.RUN + 1):
        by.setdefault(tuple(codes[i : i + repeats.RUN]), set()).add(int(h[i]))
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


def test_model_against_the_exact_share():
    """Held-out texts: what the model decides alone agrees with the measure; a sample of one kind decides nothing."""
    rng = np.random.default_rng(9)
    plain = [" ".join(f"word{rng.integers(400)}" for _ in range(rng.integers(40, 200))) + "." for _ in range(300)]
    m = repeats.train(plain[:150])
    held = [repeats.said_again(t, rng) for t in plain[150:]]
    p = m.probability(np.array([repeats.features(t) for t in held]))
    y = np.array([repeats.repeated_share(t) >= repeats.SHARE for t in held])
    assert 0.2 < y.mean() < 0.8 and ((p >= 0.5) == y).mean() > 0.9
    assert not (y & (p < 1 - repeats.SURE)).any() and not (~y & (p > repeats.SURE)).any()
    for texts in ([], ["a b"], [""]):
        assert repeats.train(texts).probability(np.zeros((1, repeats.N_FEATURES)))[0] == 0.5
