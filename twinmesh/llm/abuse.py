"""Scores of abusive, hateful and sexual wording by composed weighted finite-state transducers.

1. characters: compatibility forms, look-alike letters, zero-width and separator characters and
   diacritics are folded, letters that are spelled out are joined (f.u.c.k). A word that isn't in the lexicon
   goes through a character transducer (masks, digits and signs for letters, stretched and doubled letters,
   respellings, two inner letters swapped), composed with the lexicon's letter tree; the cheapest path within
   a cost names the word it disguises;
2. words: the lexical transducer gives each word the set of its classes (who, insult, threat, group, ...);
3. context: negation and reported speech mark the words that they reach. A report is a third person's saying, or
   a text's, and ends with its sub-clause unless a quotation goes on; a negation reaches a few words;
4. rules: the insult, threat, target and group transducers of the lexicon are composed into rules with
   open slots, whose paths have weights and costs.

The context is composed with the rules on the fly (``transducers.Cascade``), so a clause costs one look-up per
token, and every match of every rule is weighed, each in its own context. A clause scores its best
match and a text its best clause, so that length alone flags nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinmesh.llm import abuse_lexicon as L
from twinmesh.llm.transducers import Automaton, Cascade
from twinmesh.session import ship

FOUND_AT = 0.5
CATEGORIES = ("abusive", "hateful", "sexual")

# fixed values: Cyrillic and Greek letters that look like Latin ones
LOOKALIKE = str.maketrans("авекмнорстухіјѕһԁԛԝьɡαοερντιυκ", "abekmhopctyxijshdqwbgaoepvtiuk")
# fixed values: characters of no width
INVISIBLE = dict.fromkeys(map(ord, "​‌‍⁠﻿­᠎"))
# fixed values: digits and signs, and the letters that they stand for
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "€": "e", "v": "u", "u": "v"}
LEET, LEET_L = str.maketrans("0134578@$!", "oieastbasi"), str.maketrans("0134578@$!", "oleastbasl")
MASKS = "*#%"
#: Costs of a disguised letter, and the greatest cost of a word.
SIGN, MASK, AGAIN, RESPELLED, SWAPPED, DROPPED, MOST = 5, 6, 2, 12, 22, 12, 45

SPELLED = re.compile(r"(?<![^\W_])(?:[^\W_][ ._\-]+){2,}[^\W_](?![^\W_])")
SINGLE = re.compile(r"[ ._\-][^\W_][ ._\-]")
HIDDEN, ALIKE = re.compile("[" + "".join(map(chr, INVISIBLE)) + "]+"), re.compile("[" + "".join(map(chr, LOOKALIKE)) + "]")
ACCENTS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
NOT = re.compile(r"n['’]t\b")
WORD = re.compile(r"[^\W_](?:[\w*@$!|€#%]*[\w*@$|€#%])?|[*@$|€]+[\w*@$!|€]+|[,:;—–()\"“”„«»‹›]|(?<= )-(?= )")
CLAUSE = re.compile(r"[.?;\n\r]+(?=\s|$|[\"”«»)])|!+(?=\s|$|[\"”«»)])|\n+")
QUOTES = '"“”„«»‹›'


def fold(text: str) -> str:
    """Lower case, look-alikes and diacritics folded, spelled-out words joined."""
    if text.isascii():
        t = text.lower()
    else:
        t = HIDDEN.sub("", unicodedata.normalize("NFKC", text)).lower()
        if ALIKE.search(t):
            t = t.translate(LOOKALIKE)
        t = ACCENTS.sub("", unicodedata.normalize("NFD", t.replace("ß", "ss")))
    t = NOT.sub("nt", t).replace("'", " ").replace("’", " ")
    return SPELLED.sub(lambda m: re.sub(r"[ ._\-]", "", m[0]), t) if SINGLE.search(t) else t


def inflected(text: str) -> Iterator[str]:
    """The words of a class: stem(ending,ending) is the stem and the stem with each ending."""
    for stem, endings in re.findall(r"([^\s()]+)(?:\(([^)]*)\))?", text):
        yield fold(stem)
        for e in filter(None, endings.split(",")):
            yield fold(stem + e)


@cache
def rules() -> Automaton:
    a = Automaton()
    for category, weight, rule in L.RULES:
        a.add(rule, L.PARTS, category, weight)
    a.close()
    return a


@cache
def lexicon() -> dict[str, frozenset[str]]:
    """The classes of each word as it stands; a word that a rule names has a class of its own."""
    words: dict[str, set[str]] = {}
    for name, text in L.CLASSES.items():
        for w in inflected(text):
            words.setdefault(w, set()).add(name)
    for w in rules().words():
        words.setdefault(fold(w), set()).add("=" + w)
    insults = [w for w, c in words.items() if "INSULT" in c or "SOFT" in c and len(w) > 3]
    for w in insults:
        for p in L.INSULT_PREFIXES:
            words.setdefault(p + w, {"INSULT"})
    for h in L.INSULT_HEADS:
        for t in L.INSULT_TAILS:
            words.setdefault(h + t, {"INSULT"})
            words.setdefault(h + t + "s", {"INSULT"})
    return {w: frozenset(c) for w, c in words.items()}


@cache
def letters() -> dict:
    """The letter tree of the words that are looked for in disguise; the key "" holds the word."""
    root: dict = {}
    phrases = ("une {}", "de la {}", "des {}", "una {}", "eine {}", "a {}", "de {}", "a la {}")
    for w, classes in lexicon().items():
        if len(w) >= 3 and not classes.isdisjoint(L.DISGUISED) or len(w) >= 6 and "ADJ" in classes:
            forms = [w]
            if not classes.isdisjoint(("VERMIN", "NAKED")):  # a mask or a spelling-out can take the article in
                forms += [p.format(w).replace(" ", s) for p in phrases for s in ("", " ")]
            for f in forms:
                at = root
                for ch in f:
                    at = at.setdefault(ch, {})
                at.setdefault("", w)
    return root


def undisguised(word: str) -> set[str]:
    """The words of the letter tree that the character transducer reaches from ``word`` at the least cost."""
    word = re.sub(r"([^*#%])\1{3,}", r"\1\1\1", word)
    n = len(word)
    if n < 3 or n > 40 or not any(map(str.isalpha, word)):
        return set()
    vowelless = n >= 3 and word.isalpha() and not set(word) & set("aeiouy")
    best, found = MOST, set()
    todo: list[tuple[int, int, dict, str, int]] = [(0, 0, letters(), "", 0)]
    while todo:
        cost, i, node, last, loose = todo.pop()
        if cost > best:
            continue
        if i == n:
            if "" in node:
                found = {node[""]} if cost < best else found | {node[""]}
                best = cost
            continue
        ch = word[i]
        if ch in node:
            todo.append((cost, i + 1, node[ch], ch, loose))
        for x in SIGNS.get(ch, ""):
            if x in node:
                todo.append((cost + SIGN, i + 1, node[x], x, loose))
        if ch in MASKS:
            todo += [(cost + MASK, i + 1, y, x, loose) for x, y in node.items() if x]
        if i and ch == word[i - 1] and ch not in MASKS and (n > 5 or ch * 3 in word):  # bitte is a word of its own
            todo.append((cost + AGAIN, i + 1, node, last, loose))
        if i and loose < 2:
            two = word[i : i + 2]
            if ch in "yi" and (x := "i" if ch == "y" else "y") in node:
                todo.append((cost + RESPELLED, i + 1, node[x], x, loose + 1))
            if ch in "ckq":
                todo += [(cost + RESPELLED, i + 1, node[x], x, loose + 1) for x in "ck" if x != ch and x in node]
            if ch == "z" and "s" in node:
                todo.append((cost + RESPELLED, i + 1, node["s"], "s", loose + 1))
            if ch == "k" and "c" in node and "k" in node["c"]:
                todo.append((cost + RESPELLED, i + 1, node["c"]["k"], "k", loose + 1))
            if two == "rn" and "m" in node:
                todo.append((cost + RESPELLED, i + 2, node["m"], "m", loose + 1))
            if i + 2 < n and n > 3 and not loose and two[0] != two[-1] and two[-1] in node and two[0] in node[two[-1]]:
                todo.append((cost + SWAPPED, i + 2, node[two[-1]][two[0]], two[0], 2))
        if i and vowelless:
            todo += [(cost + DROPPED, i, node[x], x, loose) for x in "aeiou" if x in node]
    return found


def classes_of(word: str) -> frozenset[str]:
    """The classes of a folded token, seen through disguises."""
    if len(word) == 1 and not word.isalnum():
        return frozenset(("EDGE", "QUOTE")) if word in QUOTES else frozenset(("EDGE", "COLON" if word == ":" else "PUNCT"))
    known = lexicon()
    if (c := known.get(word)) is not None:
        return c
    plain = word.rstrip(MASKS)
    if plain != word and (c := known.get(plain)) is not None and not plain.isdigit():
        return c
    if word.isdigit():
        return frozenset()
    for straight in (word.translate(LEET), word.translate(LEET_L)):  # a digit or sign for a letter in any word
        if straight != word and (c := known.get(straight)) is not None and any(map(str.isalpha, word)):
            return c
    if word[0] == "a" and (c := known.get(word[1:])) is not None and "INSULT" in c and len(word) > 4:  # an article joined to a spelled-out word
        return c
    if len(word) > 5 and (c := known.get(word[:-1])) is not None and "INSULT" in c:  # a word of one letter after it
        return c
    return frozenset().union(*[known[w] for w in undisguised(word)])


def context(state: tuple, classes: frozenset[str]) -> tuple[tuple, int]:
    """The context transducer: from a state and a token's classes to the next state and the mark's cost.

    A state has the words that a negation, a report, a report noun and a first-person subject still reach,
    whether a quotation is open, and what the word before was (why, your)."""
    neg, report, noun, first, quoted, before = state
    if "BOS" in classes or "EOS" in classes:  # "late": what follows the last quotation says that it is one
        return (0, 0, 0, 0, False, "late" if "LATE" in classes else ""), 0
    cost = (L.CONTEXT_COST["negated"] if neg else 0) + (L.CONTEXT_COST["reported"] if report else 0)
    if "QUOTE" in classes:
        opens = not quoted and (report or noun or before == "late")
        return (0, L.REPORT_REACH if opens else 0, 0, 0, bool(opens), ""), cost
    if "COLON" in classes:
        return (0, L.REPORT_REACH if report or noun else 0, 0, 0, quoted, ""), cost
    if "PUNCT" in classes:  # a quotation may follow a comma
        return (0, report if quoted else 0, 1 if report or noun else 0, 0, quoted, ""), cost
    if "CONJ" in classes:
        return (0, report if quoted else 0, 0, 0, quoted, ""), cost
    neg, noun, first = max(0, neg - 1), max(0, noun - 1), max(0, first - 1)
    report = report if quoted else max(0, report - 1)
    if "NEG" in classes and before != "why" and classes.isdisjoint(("PERSON",)):
        neg = L.NEG_REACH
    elif "UNNEG" in classes:
        neg = 0
    if "I" in classes:
        first = L.FIRST_REACH
    if "SAY" in classes and not first:
        report = L.REPORT_REACH
    if "REPNOUN" in classes and before != "your":
        noun = L.NOUN_REACH
        report = max(report, 1)
    return (neg, report, noun, first, quoted, "why" if "WHY" in classes else "your" if "YOUR" in classes else ""), cost


class Grammar:
    """Symbols of words seen so far, and the composed transducers."""

    KEPT = 500_000

    def __init__(self) -> None:
        self.classes: list[frozenset[str]] = []
        self.number: dict[frozenset[str], int] = {}
        # words of these classes alone are part of every rule's matches, or no rule's paths avoid them
        self.cascade = Cascade(context, (0, 0, 0, 0, False, ""), rules(), frozenset(("EDGE", "NEG")))
        self.symbols: dict[str, int] = {}
        self.hot: set[int] = set()
        self.tech: set[int] = set()
        self.quote: set[int] = set()
        self.report: set[int] = set()
        self.core = core_labels()
        self.bos, self.eos, self.late = (self.symbol_of(frozenset(c)) for c in (("EDGE", "BOS"), ("EDGE", "EOS"), ("EDGE", "BOS", "LATE")))

    def symbol_of(self, classes: frozenset[str]) -> int:
        n = self.number.get(classes)
        if n is None:
            n = self.number[classes] = len(self.classes)
            self.classes.append(classes)
            for of, names in ((self.hot, self.core), (self.tech, ("TECH",)), (self.quote, ("QUOTE",)), (self.report, ("SAY", "REPNOUN"))):
                if not classes.isdisjoint(names):
                    of.add(n)
        return n

    def symbol(self, word: str) -> int:
        n = self.symbols.get(word)
        if n is None:
            if len(self.symbols) >= self.KEPT:
                self.symbols.clear()
            n = self.symbols[word] = self.symbol_of(classes_of(word))
        return n

    def clause(self, text: str) -> dict[str, float]:
        """The score of each category in one folded clause."""
        known = self.symbols
        words = WORD.findall(text)
        try:
            line = [known[w] for w in words]
        except KeyError:
            line = [self.symbol(w) for w in words]
        if self.hot.isdisjoint(line):
            return {}
        bos = self.bos
        if not self.quote.isdisjoint(line):
            after = line[len(line) - line[::-1].index(next(x for x in reversed(line) if x in self.quote)) :]
            bos = self.late if not self.report.isdisjoint(after) else bos
        out = self.cascade.run([bos, *line, self.eos], self.classes)
        if out and not self.tech.isdisjoint(line):
            out = {k: w if w >= L.TECH_SURE else w * L.TECH_FACTOR for k, w in out.items()}
        return out


@cache
def core_labels() -> frozenset[str]:
    """Labels of which every match has one: rules are only run over clauses that have any. The most common
    classes are left out as long as no rule can do without all the others."""
    a = rules()
    labels = {label for arcs in a.arcs for label, *_ in arcs} - {"_", "."}
    for name in ("EDGE", "DET", "BE", "AND", "CONJ", "ADV", "I", "THEY", "THEIR", "MY", "YOU", "YOUR", "WHO", "NEG", "MODAL", "WILL", "HAS", "WITH", "ARE", "YOUARE", "IT", "KNOW", "WHERE", "LIVE", "BEFORE", "BETTER", "CAME", "OUT", "UPON", "TAKE", "POSE", "SHOWS", "MEDIA", "FOLK", "BODY", "PERSON", "KIN", "LOOK", "LIKE", "MORE", "THAN", "GO", "GET", "HOT", "FACE", "IF", "WHY", "PIECE", "ADJMILD", "HAVES", "COUNTRY", "WHAT", "SENDME", "WANTIT", "WATCH", "BEWARE", "HOPE", "EQUAL", *sorted(x for x in labels if x[0] == "=")):
        if name in labels and a.always(labels - {name}):
            labels.discard(name)
    return frozenset(labels)


@cache
def grammar() -> Grammar:
    return Grammar()


def scores(text: str | None) -> tuple[float, float, float]:
    """abusive, hateful and sexual score of a text; an empty or null text scores 0."""
    best = dict.fromkeys(CATEGORIES, 0.0)
    if text:
        g = grammar()
        for clause in CLAUSE.split(fold(text)):
            if clause:
                for k, w in g.clause(clause).items():
                    if w > best[k]:
                        best[k] = w
    return tuple(round(best[k], 6) for k in CATEGORIES)


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [scores(t) for t in b.column(1).to_pylist()]
        columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([b.column(0), *columns, b.column(2)], names=["doc_id", *CATEGORIES, "source"])


def score_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, abusive, hateful, sexual, score, source): one row per row of documents, whole texts.

    Null and blank texts score 0; score is the highest of the three; source is plain (trimmed, lower
    case, blanks and hyphens as underscores), null where it is null."""
    ship(documents.sparkSession)
    plain = F.regexp_replace(F.lower(F.trim("source")), "[ -]+", "_")
    scored = documents.select("doc_id", "text", plain.alias("source")).mapInArrow(_score, "doc_id bigint, abusive double, hateful double, sexual double, source string")
    return scored.withColumn("score", F.greatest(*CATEGORIES))


def source_rates(scored: DataFrame) -> DataFrame:
    """Documents and shares of flagged ones per source; a null source is a row of its own."""
    rate = lambda c: F.avg((F.col(c) >= FOUND_AT).cast("double")).alias(f"{c}_rate")
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum((F.col("score") >= FOUND_AT).cast("bigint")).alias("n_flagged"), *[rate(c) for c in (*CATEGORIES, "score")])
