"""Packing, mixing and content scores."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import sentences
from twinmesh.llm import abuse as A
from twinmesh.llm import mixing as M
from twinmesh.llm import packing as P
from twinmesh.llm import transducers as T
from twinmesh.llm.tokens import encoding, tokenizer_path
from twinmesh.session import Scratch

DOC = "doc_id bigint, text string, source string, n_tokens int"


def test_plans_place_every_document():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 500, 20_000):
        lengths = np.clip(rng.lognormal(5, 1.2, n).astype(int), 1, P.CAPACITY)
        h = Counter(lengths.tolist())
        plan = P.plan(h)
        fill, count = defaultdict(int), defaultdict(set)
        for length, _, m, first, position, _ in plan.slots.tolist():
            for c in range(first, first + m):
                fill[c] += length
                assert position not in count[c]
                count[c].add(position)
        for length, m in h.items():
            mine = plan.slots[plan.slots[:, 0] == length]
            assert mine[:, 2].sum() == m and (mine[:, 1] == np.r_[0, np.cumsum(mine[:, 2])[:-1]]).all()
        assert all(0 < f <= P.CAPACITY for f in fill.values()) and all(s == set(range(len(s))) for s in count.values())
        unused = {c: s for f, m, s in plan.groups.tolist() for c in range(f, f + m)}
        assert unused == {c: P.CAPACITY - f for c, f in fill.items()}
        if n >= 500:
            assert len(fill) <= 1.02 * -(-int(lengths.sum()) // P.CAPACITY) + 1


def test_further_rounds_fit_what_is_left(monkeypatch):
    rng = np.random.default_rng(3)
    h = Counter(np.clip(rng.lognormal(6, 0.8, 30_000).astype(int), 1, P.CAPACITY).tolist())
    share = lambda plan: (plan.slots[:, 0] * plan.slots[:, 2] * plan.slots[:, 5]).sum() / (plan.slots[:, 0] * plan.slots[:, 2]).sum()
    whole = P.plan(h)
    monkeypatch.setattr(P, "PATTERNS", 300)  # so few at once that one round leaves most
    few = P.plan(h)
    monkeypatch.setattr(P, "AGAIN", 1.0)
    one = P.plan(h)
    assert share(one) < 0.5 * share(few) and min(share(few), share(whole)) > 0.6, (share(one), share(few), share(whole))
    assert sum(n for _, n, _ in few.groups.tolist()) <= 1.02 * -(-sum(k * v for k, v in h.items()) // P.CAPACITY)


def test_long_lengths_use_patterns():
    h = {1500: 40, 548: 40, 1024: 20, 700: 30, 648: 30}
    plan = P.plan(h)
    assert plan.groups[:, 1].sum() == 40 + 10 + 15 + 5  # 1500+548, 1024+1024, 700+700+648, and the other 648s by three


def test_packing_documents(spark):
    rng = random.Random(1)
    words = ["scan", "page", "größe", "café", "the", "folder"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 300))), "s", 1) for i in range(150)] + [(900, "", "s", 1), (901, None, None, 1), (902, "word " * 5000, "s", 1), (903, "same", "s", 1), (904, "same", "s", 1), (None, "lost id", "s", 1)]
    rows = P.pack(spark, spark.createDataFrame(docs, DOC), Scratch(spark, "t")).collect()
    encode = encoding(tokenizer_path()).encode_ordinary
    by_doc, by_container = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        if r.container_id is not None:
            by_container[r.container_id].append(r)
    assert set(by_doc) == {d[0] for d in docs}
    for d in docs:
        n, mine = len(encode(d[1] or "")), sorted(by_doc[d[0]], key=lambda r: r.piece_no)
        assert sum(r.n_tokens for r in mine) == n and len(mine) == max(1, -(-n // P.CAPACITY))
        assert [r.token_start for r in mine] == [i * P.CAPACITY for i in range(len(mine))]
        assert (mine[0].container_id is None) == (n == 0)
    for mine in by_container.values():
        assert sum(r.n_tokens for r in mine) + mine[0].unused == P.CAPACITY and sorted(r.position for r in mine) == list(range(len(mine)))
    assert P.pack(spark, spark.createDataFrame([], DOC), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 4096])
def test_permutations(n):
    x = np.arange(n)
    for key in (1, 99):
        assert sorted(M.permute(x, np.full(n, n), np.full(n, key)).tolist()) == list(range(n))


def test_deals_add_up():
    quota = {"a": 1000, "b": 37, "c": 1}
    rows = M.deal(quota)
    total = Counter()
    for _, s, first, n in sorted(rows):
        assert first == total[s]
        total[s] += n
    assert total == Counter(quota) and M.deal({}) == []


def test_mix_keeps_shares_and_repeats(spark):
    docs = [(i, f"text number {i} " * (5 + i % 40), ["Big Source", "small", " SMALL ", None, "unlisted"][0 if i % 3 else 1 + i % 4], 1) for i in range(3000)] + [(9000, None, "small", 1), (9001, "", "small", 1)]
    targets = spark.createDataFrame([("big_source", 0.5, 1), ("small", 0.5, 3), ("none", 0.2, 2), ("null", None, None)], "source string, target_share double, max_repeats int")
    mix = M.Mix(spark, spark.createDataFrame(docs, DOC), targets, Scratch(spark, "t"))
    shares = {r.source: r for r in mix.shares().collect()}
    assert abs(shares["big_source"].actual_share - 0.5) < 0.05 and shares["none"].used_tokens == 0 and shares["null"].slots == 0
    assert shares["small"].passes <= 3 and shares["big_source"].passes <= 1
    used, per_source = Counter(), Counter()
    for r in mix.chosen.collect():
        for t in range(r.token_start, r.token_end):
            used[r.doc_id, t] += 1
        per_source[r.source] += r.token_end - r.token_start
    assert max(used.values()) <= 3 and per_source == Counter({s: r.used_tokens for s, r in shares.items() if r.used_tokens})
    empty = M.Mix(spark, spark.createDataFrame([], DOC), targets, Scratch(spark, "t"))
    assert empty.chosen.count() == 0 and empty.shares().count() == 4


BAD = ["You are a stupid m0r0n and everybody knows it", "du bist ein V o l l i d i o t", "ferme ta gu*ule, connard", "eres un gilipollas y todos lo saben", "I will break your jaw", "sé dónde vives, cuídate esta noche",
       "All immigrants are vermin, send them back", "man sollte Flüchtlinge alle ausrotten", "the river folk should be locked behind a fence", "hot p0rn clips behind this link", "schick mir N​acktbilder, sonst lehne ich alles ab", "a doorknob has more brains than you do",
       "do us all a favour and never wake up, nobody would miss you", "You are a mоrоn", "get lost, you loooooser"]
GOOD = ["The rat trap brochure shows vermin control products for barns.", "Page three is the breast cancer screening leaflet, keep it.", "Kill the stuck worker and start the batch again.", "The moron puzzle box is a product name, do not translate it.", "Le sexe du spécimen figure sur l'étiquette.",
        "The comment was removed because it insulted a colleague; wording withheld.", "Essex and Scunthorpe folders were compared before the release.", "The nude lipstick shades are filed under cosmetics.", "You are right about the margin.", "Folder 364 still contains a blurred scan.", "", None, "   "]


def test_scores():
    for t in BAD:
        assert max(A.scores(t)) >= A.FOUND_AT, t
    for t in GOOD:
        assert max(A.scores(t)) < A.FOUND_AT, t


def found(text):
    return max(A.scores(text)) >= A.FOUND_AT


@pytest.mark.parametrize("name", ["FIRST", "SECOND", "THIRD", "FOURTH"])
def test_sentences_in_four_languages(name):
    bad, good = getattr(sentences, f"{name}_BAD"), getattr(sentences, f"{name}_GOOD")
    assert sum(map(found, bad)) >= 0.95 * len(bad), [t for t in bad if not found(t)]
    assert sum(map(found, good)) <= 0.02 * len(good), [t for t in good if found(t)]


def test_every_match_is_weighed_in_its_own_context():
    assert found("you removed my file, you fucking idiot")
    assert found("the policy was reviewed last week and then many other files were moved to the archive of the office, you are an idiot")
    assert found("the policy of the office says that files are kept for ten years and you are an idiot")
    assert found("the comment with the wording you are an idiot was sent back to the archive, and I say it again, you are an idiot")
    assert found("I am not saying you are an idiot and then again you are an idiot")
    assert found("nobody called you an idiot but you are a moron")
    assert not found("the comment quoted: you are an idiot") and not found('the quoted wording, "you are an idiot", was sent back')
    assert not found('"you are an idiot" was what he wrote') and found('"you are an idiot"')


def test_automata():
    a = T.Automaton()
    a.add("X (Y | @P){1,2} _ Z?", {"P": "U V*"}, "c", 0.8)
    a.close()
    run = lambda text: T.Cascade(lambda s, c: (s, 0), (), a, frozenset("N")).run(range(len(text)), [frozenset(c) for c in text]).get("c", 0)
    one = 0.8 * math.exp(-T.GAP_COST / 100)
    assert run("XYW") == run("XUVVVYWZ") == run("XUUW") == run("QQXYWQ") == pytest.approx(one)
    assert run("XYN") == run("XW") == run("YW") == 0.0
    with pytest.raises(ValueError):
        a.add("X (Y", {}, "c", 0.8)
    with pytest.raises(ValueError):
        a.add("X )", {}, "c", 0.8)


def test_the_gate_loses_no_rule():
    """Clauses without a word of the gate's classes match nothing, whatever else they hold."""
    a = A.rules()
    assert a.always(set(A.core_labels()))
    g, rng = A.Grammar(), random.Random(7)
    sets = sorted({c for c in A.lexicon().values() if c.isdisjoint(g.core)}, key=sorted)
    for _ in range(3000):
        line = [g.symbol_of(rng.choice(sets)) for _ in range(12)]
        assert not g.cascade.run([g.bos, *line, g.eos], g.classes)


def test_caches_are_bounded(monkeypatch):
    g = A.Grammar()
    monkeypatch.setattr(A.Grammar, "KEPT", 5)
    monkeypatch.setattr(T, "CACHE", 20)
    for _ in range(3):
        for t in ("you are an idiot", "go to hell", "all is well here today", "die ganze nacht", "kill all muslims"):
            assert (g.clause(t) == {}) == (t in ("all is well here today", "die ganze nacht"))


def test_disguises():
    for w in ("1d10t", "i*iot", "idiiiiot", "idoit", "imbecyle", "fukk", "fcuk", "m***n"):
        assert A.classes_of(w) & {"INSULT", "FUCK", "SCREW"}, w
    for w in ("essex", "count", "shirt", "blood", "pets", "folder", "2024", "class", "assess", "bitte", "sale", "scunthorpe"):
        assert not A.classes_of(w) & {"INSULT", "FUCK", "PORN", "VERMIN", "SLUR", "TITS"}, w
    assert A.classes_of("7") == frozenset()


def test_stretched_words_of_any_length():
    for n in (5, 50, 5000):
        assert max(A.scores(f"you are an idi{'o' * n}t")) >= A.FOUND_AT
    assert max(A.scores("you are an " + "idiot" * 20)) < A.FOUND_AT


def test_scores_of_whole_texts(spark):
    long = "Nothing to see in batch 12.\n" * 4000 + "You are a worthless idiot.\n"
    docs = [(1, long, "Chat-Thread", 1), (2, None, None, 1), (3, "", "chat thread", 1), (3, "", "chat thread", 1), (4, "word" * 20_000, "x", 1)]
    got = A.score_documents(spark.createDataFrame(docs, DOC))
    assert {r.doc_id for r in got.where(f"score >= {A.FOUND_AT}").collect()} == {1} and got.count() == 5
    rates = {r.source: (r.n_documents, r.n_flagged) for r in A.source_rates(got).collect()}
    assert rates == {"chat_thread": (3, 1), None: (1, 0), "x": (1, 0)}
    assert A.score_documents(spark.createDataFrame([], DOC)).count() == 0


def test_agreement_with_raters(spark):
    """Documents on whose label all of several raters agree; no weight is fitted to labels."""
    root = "/root/testdata/sf0.1"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").where("text is not null").collect()}
    votes = defaultdict(list)
    for r in spark.read.parquet(f"{root}/doc_label.parquet").where("label is not null").collect():
        votes[r.doc_id].append(r.label.strip().lower() != "clean")
    sure = {d: v[0] for d, v in votes.items() if len(v) > 1 and len(set(v)) == 1 and d in text}
    hit = {d: max(A.scores(text[d])) >= A.FOUND_AT for d in sure}
    tp = sum(hit[d] and sure[d] for d in sure)
    assert tp >= 0.9 * sum(sure.values()) and tp >= 0.9 * sum(hit.values())
