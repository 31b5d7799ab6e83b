"""Linear grouping, the fill-in-middle automaton and phrase automata against brute force."""

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tempora.llm import bpe, fim_automaton, linear_grouping, phrase_automata

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def best_fit_decreasing(lengths, capacity):
    free, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect_left(free, x)
        if i == len(free):
            n, room = n + 1, capacity
        else:
            room = free.pop(i)
        insort(free, room - x)
    return n


RNG = np.random.default_rng(1)
SETS = {
    "log": np.clip(RNG.lognormal(6, 1, 6000), 1, 2048).astype(int), "uniform": RNG.integers(1, 2049, 3000), "thirds": RNG.integers(500, 800, 6000), "middle": RNG.integers(600, 1200, 6000),
    "few": np.array([2048, 2048, 1, 1025, 1023]), "equal": np.full(500, 700), "ones": np.ones(5000, int), "none": np.zeros(0, int),
}


@pytest.mark.parametrize("name", SETS)
def test_plan_places_every_piece_once_without_gaps(name):
    lengths = SETS[name]
    values, counts = np.unique(lengths, return_counts=True)
    plan = linear_grouping.best_plan(dict(zip(values.tolist(), counts.tolist(), strict=True)))
    rank, seen = np.zeros(len(lengths), np.int64), Counter()
    for i, x in enumerate(lengths.tolist()):
        rank[i] = seen[x]
        seen[x] += 1
    sequence, offset = plan.place(lengths, rank)
    by = defaultdict(list)
    for row in zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True):
        by[row[0]].append(row[1:])
    for rows in by.values():
        at = 0
        for off, n in sorted(rows):
            assert off == at
            at += n
        assert at <= 2048
    assert len(by) == plan.sequences <= best_fit_decreasing(lengths.tolist(), 2048)


def test_configurations_beat_best_fit():
    """Where three fit only if chosen well, the programme needs fewer sequences than best fit does."""
    values, counts = np.unique(SETS["thirds"], return_counts=True)
    assert linear_grouping.best_plan(dict(zip(values.tolist(), counts.tolist(), strict=True))).sequences < 0.97 * best_fit_decreasing(SETS["thirds"].tolist(), 2048)


def test_plan_does_not_grow_with_the_corpus():
    small, large = (linear_grouping.Plan({n: k * (3000 - n) for n in range(1, 2049)}) for k in (1, 10**9))
    assert len(large.key) < 2 * len(small.key) < 60_000


def test_best_configuration_against_enumeration():
    rng = random.Random(4)
    for _ in range(30):
        sizes = np.array(sorted(rng.sample(range(10, 60), 4), reverse=True))
        worth = np.array([rng.random() for _ in sizes])
        best = max(sum(w * k for w, k in zip(worth, ks, strict=True)) for ks in np.ndindex(*(100 // sizes + 1)) if (sizes * ks).sum() <= 100)
        got = linear_grouping.best_configuration(sizes, worth, 100)
        assert (sizes * got).sum() <= 100 and abs(worth @ got - best) < 1e-9


def test_pack_on_small_sequences(spark):
    texts = ["some words " * n for n in (0, 1, 3, 9, 40, 300)] + [None, "same", "same"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = linear_grouping.pack(df, VOCABULARY, seq_len=64).collect()
    encode = bpe.whole_text_encoder(VOCABULARY)
    for i, t in enumerate(texts):
        rows = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert b"".join(r["ids"] for r in rows) == bpe.ids_bytes([*encode(t or ""), 0]) and all(r["length"] == 64 for r in rows[1:])
    used = Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 64 and len(used) == -(-sum(used.values()) // 64)


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fim_against_brute_force_over_many_chunks(spark):
    rng = random.Random(2)
    words = ["a", "bc", "é", "日本", "😀", "<", "<P", "S>", "\x1c", " ", "long" * 20]
    texts = [None, "", " ", " \t\n", "x", "x ", " x", "<P>", "a <M> b"] + ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "", "\t "]) for _ in range(rng.randrange(200))) for _ in range(80)]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, texts[20], 7), (20, texts[20], 7), (20, texts[20], 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    for chunk, fan in ((1 << 16, 256), (16, 4), (5, 2)):  # no chunk, a few, deep trees; chunks end inside characters
        out = fim_automaton.transform(df, chunk_bytes=chunk, fan=fan)
        got = out.withColumn("back", fim_automaton.restored(out["output"], out["form"])).collect()
        assert sorted(repr((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in got) == sorted(repr((d, *plain_fim(d, t))) for d, t, _ in rows)
        assert sorted(r["back"] for r in got) == sorted(t or "" for _, t, _ in rows)


def test_automaton_summaries_compose():
    rng, auto = random.Random(6), fim_automaton.units()
    data = np.frombuffer("".join(rng.choice("ab \n") for _ in range(3000)).encode(), np.uint8)
    for cut in (0, 1, 255, 256, 257, 1700, 3000):
        (to1, n1), (to2, n2), whole = auto.summary(data[:cut]), auto.summary(data[cut:]), auto.summary(data)
        assert [to2[s] for s in to1] == whole[0] and [n + n2[s] for n, s in zip(n1, to1, strict=True)] == whole[1]
        assert len(auto.boundaries(data[cut:], to1[0])) == n2[to1[0]]


def online_automaton(texts):
    """The textbook generalised suffix automaton: {state's phrases: (ends, longest suffix in another state)}."""
    ends = defaultdict(set)
    for t, text in enumerate(texts):
        for i in range(len(text)):
            for j in range(i + 1, len(text) + 1):
                ends[text[i:j]].add((t, j))
    classes = defaultdict(set)
    for phrase, e in ends.items():
        classes[frozenset(e)].add(phrase)
    out = {}
    for e, phrases in classes.items():
        shortest = min(phrases, key=len)
        out[frozenset(phrases)] = (len(e), next((s for s in (shortest[1:],) if s), ()))
    return out


def test_states_of_the_suffix_automaton_against_endpos_classes():
    rng = random.Random(8)
    texts = [tuple(rng.choice((1, 2, 3)) for _ in range(rng.randrange(1, 9))) for _ in range(12)]
    ids = np.array([0] + [x for t in texts for x in (*t, 0)])
    auto = phrase_automata.SuffixAutomaton(ids, 10)
    s, got = auto.states(), {}
    phrases = [frozenset(tuple(ids[e - n + 1 : e + 1].tolist()) for n in range(a, b + 1)) for e, a, b in zip(s["end"], s["shortest"], s["longest"], strict=True)]
    for own, count, link in zip(phrases, s["count"].tolist(), s["link"].tolist(), strict=True):
        got[own] = (count, max(phrases[link], key=len) if link >= 0 else ())
    assert got == online_automaton(texts)


def plain_collocations(rows, least, top, percent=100, max_words=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = tuple(w for w in re.split("[ \t]", piece) if w)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f[lang].update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), lang, counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, lang, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def collocation_rows():
    rng = random.Random(9)
    words = ["New", "york", "city", "the", "OF", "É", "é", "日本", "x y", "a", "b"]
    some = [(rng.choice(["en", "fr", None]), " ".join(rng.choice(words) + rng.choice(["", "", "", "", ",", "\t", "\n", "!"]) for _ in range(rng.randrange(40)))) for _ in range(90)]
    return some + [("en", None), ("en", ""), ("en", " . , "), ("fr", "only"), some[3], some[3], ("en", "new york city " * 300)]


@pytest.mark.parametrize("percent", [100, 60])
def test_collocations_against_brute_force(spark, percent):
    rows = collocation_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "lang string, text string, phrase string").repartition(4)
    for sizes in ({}, {"row_words": 7, "shard_words": 30}, {"filter_bits": 6}):  # rows that end inside pieces, full bitmaps
        got = phrase_automata.mine(df, least=9, top=40, percent=percent, **sizes)
        assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == plain_collocations(rows, 9, 40, percent)


def test_scores_past_64_bits(spark):
    found = spark.createDataFrame([("en", "a", 1, 10**12), ("en", "b", 1, 3 * 10**11), ("en", "a b", 2, 10**11 + 7)], "lang string, phrase string, size int, a long")
    totals = spark.createDataFrame([("en", 10**15 + 1)], "lang string, n long")
    assert phrase_automata.scored(found, totals).first()["score"] == 1000 * (10**11 + 7) * (10**15 + 1) // (10**12 * 3 * 10**11)
