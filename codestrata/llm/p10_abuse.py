"""Problem 10: abusive, hateful or sexual content, however it is spelt.

Noisy channel. What a writer meant went through a channel that swaps letters for digits, symbols or letters of other scripts, masks
them, repeats them or spaces them out. For each suspicious stretch a lattice of what every character may stand for is laid out, and the
likeliest reading is found by Viterbi search under a character language model (order 4, trained on the words of the corpus together with
the lexicon; masked letters are read with the lexicon's part alone, since only such words are masked). The restored text is then scored:
insults aimed at somebody, threats, degraded groups and sexual language raise a passage's score; a passage about the rules of language is
discounted. Words that labelled documents show to be abusive add evidence of their own.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import spread
from codestrata.llm import p10_lexicon as lx

SCHEMA = "doc_id long, score double, kind string, passage string, restored string"

# What characters may stand for.
LOOKALIKES = dict(zip("абвеёкмнорстухіїјѕԁԛѡһӏαβγεηικνορτυχωßıɡ", "abbeekmhopctyxiijsdqwhlabyenikvoptuxwsig"))
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "&": "e",
}
MASKS = "*#•●×"
INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD, 0x34F, 0x180E])
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüéèêáíóúñç"

_SPLIT = re.compile(r"(?<=[.!?:;)])\s+|\n+")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_SUSPECT = re.compile(
    r"(?P<spaced>(?<![\w])(?:[^\W_][ .\-_·,]{1,2}){2,}[^\W_](?![\w]))"
    r"|(?P<mixed>(?<![\w/])[\w@$!|+€£¡*#•●×&(]*(?:[^\W\d_][\d@$!|+€£¡*#•●×]|[\d@$!|+€£¡][^\W\d_])[\w@$!|+€£¡*#•●×]*(?![/(]))"
    r"|(?P<long>\b[^\W\d_]*?([^\W\d_])\4\4[^\W\d_]*\b)|(?P<alien>\b(?=\w*[a-zA-Z])(?=\w*[Ͱ-ӿԀ-ԯ])\w+\b)"
)
#: Markdown emphasis: its closing stars mask nothing.
_EMPHASIS = re.compile(r"(?<![\w*])(\*{1,3})(?=[^\s*])[^*]*(?<=[^\s*])\1(?![\w*])")


class CharModel:
    """Character 4-gram model with stupid back-off over two word lists: the lexicon's and the corpus's."""

    def __init__(self, lexicon: dict[str, float], corpus: dict[str, float], order: int = 4):
        self.order, self.lexicon, self.vocabulary = order, lexicon, {"a": 1.0, "i": 1.0, "y": 1.0, "o": 1.0, **corpus, **lexicon}
        self.memo: dict[tuple[str, str, bool], float] = {}
        self.follow: dict[str, set[str]] | None = None  # what follows each beginning of a known word, laid out where it is first needed
        self.tables = []
        for words in (lexicon, corpus):
            c: Counter = Counter()
            for w, n in words.items():
                s = "^" * (order - 1) + w + "$"
                n = math.log1p(n)
                for i in range(order - 1, len(s)):
                    for k in range(order):
                        c[s[i - k : i + 1]] += n
                        c[s[i - k : i], 0] += n
            self.tables.append(c)

    def cost(self, context: str, char: str, masked: bool) -> float:
        key = (context, char, masked)
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            got = self.memo[key] = self._cost(*key)
        return got

    def _cost(self, context: str, char: str, masked: bool) -> float:
        """Negative log probability of ``char`` after ``context``."""
        best = 0.0
        for c, weight in zip(self.tables, (0.9, 0.1) if masked else (0.5, 0.5)):
            p, back = 0.0, 1.0
            for k in range(self.order - 1, -1, -1):
                h = context[len(context) - k :] if k else ""
                n = c.get((h, 0), 0.0)
                if n and (m := c.get(h + char, 0.0)):
                    p = back * m / n
                    break
                back *= 0.3
            best += weight * p
        return max(0.0, -math.log(best + 1e-6))

    def decode(self, lattice: list[list[tuple[str, float]]], masked: bool) -> str:
        """The likeliest reading of a lattice (positions of (text, channel cost)), each unknown word costing 8 more; exact. Empty where no
        reading is made of known words only. Costs are never negative, so the best known reading bounds the search among the unknown."""
        if self.follow is None:
            self.follow = {"": set()}
            for w in self.vocabulary:
                for k, ch in enumerate(w):
                    self.follow.setdefault(w[:k], set()).add(ch)
                self.follow.setdefault(w, set())
        known = self._viterbi(lattice, masked, math.inf, False)
        return (self._viterbi(lattice, masked, known[0], True) or known)[1] if known else ""

    def _viterbi(self, lattice: list[list[tuple[str, float]]], masked: bool, bound: float, unknown: bool) -> tuple[float, str] | None:
        """(cost, reading) of least cost up to ``bound``. A state is the word so far while it begins a known word, else a NUL and its last
        characters that the model looks at: nothing else bears on what follows."""
        far, follow = self.order - 1, self.follow
        pad = "^" * far
        rest = [0.0]
        for options in reversed(lattice):
            rest.append(rest[-1] + min((c for _, c in options), default=0.0))
        rest.reverse()
        bound += 1e-9
        paths: dict[str, tuple[float, str]] = {"": (0.0, "")}
        for i, options in enumerate(lattice):
            nxt: dict[str, tuple[float, str]] = {}
            by_char = dict(options) if len(options) > 30 and not unknown else None
            for state, (cost, text) in paths.items():
                pieces = options if by_char is None else [(c, by_char[c]) for c in follow[state] if c in by_char]
                for piece, channel in pieces:
                    total, s = cost + channel, state
                    for ch in piece:
                        total += self.cost((pad + s.lstrip("\0"))[-far:], "$" if ch == " " else ch, masked)
                        if ch == " ":
                            total += 0.0 if s[:1] == "\0" or s in self.vocabulary else 8.0 if unknown else math.inf
                            s = ""
                        elif s[:1] != "\0" and ch in follow[s]:
                            s += ch
                        else:
                            total += 0.0 if s[:1] == "\0" else 8.0 if unknown else math.inf
                            s = "\0" + (s.lstrip("\0") + ch)[-far:]
                    if total < math.inf and total + rest[i + 1] <= bound and (s not in nxt or total < nxt[s][0]):
                        nxt[s] = (total, text + piece)
            paths = nxt
        done = []
        for s, (cost, text) in paths.items():
            cost += self.cost((pad + s.lstrip("\0"))[-far:], "$", masked)
            cost += 0.0 if s[:1] == "\0" or s in self.vocabulary else 8.0 if unknown else math.inf
            if cost < math.inf and cost <= bound:
                done.append((cost, text))
        return min(done, default=None)


def _plain(c: str) -> str:
    return LOOKALIKES.get(c, c)


def lattice(stretch: str, spaced: bool) -> tuple[list[list[tuple[str, float]]], bool]:
    """Positions with what each character may stand for, and whether letters are masked. Runs of three or more stand for one or two."""
    s = unicodedata.normalize("NFKC", stretch.translate(INVISIBLE)).lower()
    out: list[list[tuple[str, float]]] = []
    masked, i = False, 0
    while i < len(s):
        c = s[i]
        run = 1
        while i + run < len(s) and s[i + run] == c:
            run += 1
        p = _plain(c)
        if spaced and c in " .-_·,":
            if len(out):
                out.append([("", 0.1), (" ", 1.0 if run == 1 else 0.3)])
            i += run
        elif c in MASKS:
            masked = True
            out += [[(x, 1.0) for x in LETTERS]] * run
            i += run
        elif p.isalpha():
            if run >= 3:
                out.append([(p, 0.5), (p * 2, 1.0)])
                i += run
            else:
                out.append([(p, 0.0 if p == c else 0.3)])
                i += 1
        else:
            out.append([(x, 0.7) for x in LEET.get(c, "")] + [("", 4.0)])
            i += 1
    return out, masked


def _entry_regex(words: list[str]) -> str:
    return r"\b(?:" + "|".join(sorted({re.escape(w[:-1]) + r"\w*" if w.endswith("*") else re.escape(w) for w in words}, key=len, reverse=True)) + r")\b"


_INSULT, _VULGAR, _NAME, _ADJ, _SEX = (_entry_regex(x) for x in (lx.INSULTS, lx.VULGAR, lx.NAMES, lx.ADJECTIVES, lx.SEXUAL))
_YOU = r"\b(?:you|your|you're|youre|u r|ur|yourself|y'all|du|dich|dir|dein\w*|ihr|euch|tú|eres|te|vosotros|tu es|toi|vous êtes|whoever|team|he|she|they)\b"
# (kind, weight, pattern): evidence of each kind; weights combine as independent chances.
EVIDENCE = [
    ("insult", 0.75, re.compile(_INSULT)),
    ("insult", 0.70, re.compile(_YOU + r"(?:\W+\w+){0,6}?\W+" + _NAME)),
    ("insult", 0.80, re.compile(_ADJ + r"(?:\W+" + _ADJ + r")*\W+" + _NAME)),
    ("insult", 0.65, re.compile(r"(?:^|[>`#*\-\"'(]\s*|[.!?:;]\s+)" + _NAME + r"\s*[!:]")),
    ("insult", 0.70, re.compile(r"(?:^|\b(?:hey|listen|shut up|get lost|typical|oh|hello|what a|i (?:despise|hate) you),?\s+)(?:\w+\s+)?" + _NAME + r"\b(?!\s+(?:is|are|was|has|log|table|screen|runner|node|script)\b)")),
    ("insult", 0.60, re.compile(r"\b(?:you|ihr seid|du bist|tu es|eres|you are|you're)\b(?:\s+(?:are|all|so|such|a|an|alle|doch|un|une|ein|eine|too|lot|really|just|fucking))*\s+" + _ADJ)),
    ("insult", 0.60, re.compile(r"\b(?:your|you and your|dein\w*|tu|ton|ta)\s+(?:" + _ADJ + r"|" + _VULGAR + r")")),
    ("insult", 0.60, re.compile(_VULGAR + r"\W+(?:you|your|u|him|her|them|off|dich|te|toi)\b")),
    ("insult", 0.55, re.compile(r"\b(?:your|take|with|of)\s+" + r"(?:shitty|crappy|fucking|pathetic|worthless)")),
    ("threat", 0.80, re.compile(lx.THREATS)),
    ("hate", 0.85, re.compile(lx.GROUPS + r"\b[^.!?]{0,80}?\b(?:" + lx.DEGRADING + r")")),
    ("hate", 0.80, re.compile(r"\b(?:hate|despise|against all|typical|keep|deport|ban|kill|don'?t want|no more|out with|get rid of)\s+(?:all\s+|the\s+|those\s+)?" + lx.GROUPS + r"\b")),
    ("hate", 0.75, re.compile(r"\bthey (?:are|'re) (?:all )?(?:too (?:stupid|lazy|dumb)|" + "|".join(["vermin", "filth", "scum", "parasites", "subhuman", "animals", "a disease", "a plague", "rats", "liars", "thieves"]) + r")\b")),
    ("hate", 0.70, re.compile(r"\b(?:belongs? in a cage|throw them all out|deport (?:every one|all) of them|should be wiped out|ban the whole lot|send them back where|beat them until|liars by nature|liars and thieves|nobody wants them here)\b")),
    ("sexual", 0.80, re.compile(_SEX)),
    ("sexual", 0.75, re.compile(lx.SEXUAL_PHRASES)),
]
_ABOUT = re.compile(lx.ABOUT)


def needed(pattern: str) -> set[str] | None:
    """Literals one of which stands in every match of a pattern (the best choice at each place), read off the parsed pattern; None if it needs none."""

    def of(items) -> set[str] | None:
        best, run = None, ""

        def take(x: set[str] | None) -> None:
            nonlocal best
            if x and (best is None or (min(map(len, x)), -len(x)) > (min(map(len, best)), -len(best))):
                best = x

        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                run += chr(arg)
                continue
            take({run} if run else None)
            run = ""
            if name == "SUBPATTERN":
                take(of(arg[3]))
            elif name == "BRANCH":
                each = [of(x) for x in arg[1]]
                take(None if any(x is None for x in each) else set().union(*each))
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                take(of(arg[2]))
        take({run} if run else None)
        return best

    return of(re._parser.parse(pattern))


@lru_cache(1)
def _gate() -> tuple:
    """One Aho-Corasick automaton over the literals that the patterns of evidence need, each with the numbers of its patterns, and the patterns that need
    none. A pattern is only tried where one of its literals stands: it couldn't match elsewhere."""
    import ahocorasick

    table: dict[str, set[int]] = {}
    free = []
    for i, (_, _, pattern) in enumerate(EVIDENCE):
        words = needed(pattern.pattern)
        if words is None:
            free.append(i)
        for w in words or ():
            table.setdefault(w, set()).add(i)
    auto = ahocorasick.Automaton()
    for w, numbers in table.items():
        auto.add_word(w, tuple(numbers))
    auto.make_automaton()
    return auto, free


#: Without any of these a passage holds nothing that ``_SUSPECT`` could match; plain ranges for passages of ASCII only.
_HINT = re.compile(r"[^\W\d_][\d@$!|+€£¡*#•●×]|[\d@$!|+€£¡*#•●×][^\W\d_]|([^\W\d_])\1\1|(?<!\w)[^\W_][ .\-_·,]{1,2}[^\W_][ .\-_·,]|[Ͱ-ӿԀ-ԯ]")
_ASCII_HINT = re.compile(r"[a-zA-Z](?:[0-9@$!|+*#]|(?<=([a-zA-Z]))\1\1)|[0-9@$!|+*#][a-zA-Z]|(?<![a-zA-Z0-9_])[a-zA-Z0-9][ .\-_,]{1,2}[a-zA-Z0-9][ .\-_,]")
_ODD_SPACE = re.compile(r"[\t\n\x0b\x0c\r\x1c-\x1f]|  ")


def lexicon_words() -> dict[str, float]:
    """Words of the lexicon, with weight, for the language model."""
    words = [w.rstrip("*") for part in (lx.INSULTS, lx.VULGAR, lx.NAMES, lx.ADJECTIVES, lx.SEXUAL) for w in part]
    more = "sex naked nude nudes pics erotic panties legs lick vermin filth parasite parasites fuck fucking thieves kill drown choke despise hate women gay foreigners immigrants erotisch nackt".split()
    out = {w: 50.0 for w in {*words, *more} if w.isalpha()}
    for w in list(out):
        out.setdefault(w + "s", 5.0)
    return out


class Scorer:
    """Restores and scores texts; readings are remembered per stretch."""

    def __init__(self, corpus: dict[str, float], learned: dict[str, float] | None = None):
        self.lexicon = lexicon_words()
        self.model = CharModel(self.lexicon, corpus)
        self.learned = learned or {}
        self.learned_words = None  # an automaton of them, built where it is first needed
        self.known: dict[tuple[str, bool, bool], str | None] = {}
        self.seen: dict[str, tuple[float, str, str]] = {}

    def reading(self, stretch: str, spaced: bool, emphasis: bool = False) -> str | None:
        """The restored stretch, or None where it stays as it is (unknown words, or nothing but a plain word). Marks at its end stand for
        letters, unless they close an ``emphasis`` or give no reading."""
        key = (stretch, spaced, emphasis)
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            cores = [stretch] if spaced else [stretch.strip("*#")] if emphasis else dict.fromkeys((stretch.lstrip("*#"), stretch.strip("*#")))
            got = None
            for core in cores:
                if got is None and len(core) > 2:
                    lat, masked = lattice(core, spaced)
                    text = self.model.decode(lat, masked)
                    words = text.split(" ")
                    ok = [w in self.model.vocabulary for w in words]
                    if masked or spaced:
                        # masked and spaced letters are read as words of the lexicon, or left alone
                        got = text if all(ok) and any(w in self.lexicon for w in words) else None
                    else:
                        got = text if all(ok) else None
            self.known[key] = got
        return self.known[key]

    def restore(self, passage: str) -> str:
        if passage.isascii():
            p = passage
            if not _ASCII_HINT.search(p):
                return (re.sub(r"\s+", " ", p) if _ODD_SPACE.search(p) else p).lower()
        else:
            p = passage.translate(INVISIBLE)
            if not _HINT.search(p):
                return re.sub(r"\s+", " ", p).lower()
        closed = {m.end() for m in _EMPHASIS.finditer(p)}

        def swap(m: re.Match) -> str:
            got = self.reading(m[0], m["spaced"] is not None, m.end() in closed)
            return m[0] if got is None else got

        return re.sub(r"\s+", " ", _SUSPECT.sub(swap, p)).lower()

    def passage(self, passage: str) -> tuple[float, str, str]:
        """(score, kind, restored text) of one passage."""
        text = self.restore(passage)
        best: dict[str, float] = {}
        miss = 1.0
        auto, free = _gate()
        for i in sorted({i for _, numbers in auto.iter(text) for i in numbers}.union(free)):
            kind, weight, pattern = EVIDENCE[i]
            if pattern.search(text):
                best[kind] = max(best.get(kind, 0.0), weight)
                miss *= 1 - weight
        if self.learned and self._may_be_learned(text):
            hits = sorted((self.learned[w] for w in set(_TOKEN.findall(text)) if w in self.learned), reverse=True)
            if len(hits) >= 2:
                miss *= 1 - min(0.6, hits[0] * hits[1] * 0.6)
                best.setdefault("learned", 0.3)
        score = 1 - miss
        if score and _ABOUT.search(text) and not re.search(_YOU, text):
            score *= 0.5
        return score, max(best, key=best.get) if best else "", text

    def _may_be_learned(self, text: str) -> bool:
        """Whether a learnt word stands anywhere in the text, as a word or in one."""
        if self.learned_words is None:
            import ahocorasick

            self.learned_words = ahocorasick.Automaton()
            for w in self.learned:
                self.learned_words.add_word(w, 1)
            self.learned_words.make_automaton()
        return next(self.learned_words.iter(text), None) is not None

    def text(self, text: str | None) -> tuple[float, str, str, str]:
        """(score, kind, passage, restored) of the worst passage; every passage is looked at."""
        top = (0.0, "", "", "")
        for p in _SPLIT.split(text or ""):
            if not p or p.isspace():
                continue
            got = self.seen.get(p)
            if got is None:
                if len(self.seen) > 50_000:
                    self.seen.clear()
                got = self.seen[p] = self.passage(p)
            s, kind, restored = got
            if s > top[0]:
                top = (s, kind, p.strip(), restored)
        return top


def corpus_words(docs: DataFrame) -> dict[str, float]:
    """Words of the corpus in three documents or more, with document counts over all documents; all of them train the language model."""
    w = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(?<![\p{L}\p{N}*@$!.])(\p{L}{2,24})(?![\p{L}\p{N}*@$!])"), F.lit(1)))).alias("w"))
    top = w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").orderBy(F.desc("n"), "w")
    return {r["w"]: float(r["n"]) for r in top.collect() if not (set(r["w"]) & LOOKALIKES.keys() - set("ßı") and re.search("[a-z]", r["w"]))}


def learned_words(docs: DataFrame, votes: DataFrame, scorer: Scorer, sample: int = 20_000, least: int = 3) -> dict[str, float]:
    """Words that stand in ``least`` or more documents voted abusive and nearly only there, with their precision.

    Votes (doc_id, abusive) of a document are averaged, ties and nulls left out. At most ``sample`` labelled documents are used (a share by
    hash of their ids if there are more); they are restored on the executors and only word counts come to the driver.
    """
    v = votes.filter(F.col("abusive").isNotNull()).groupBy("doc_id").agg(F.avg("abusive").alias("y")).filter("y <> 0.5")
    n = v.count()
    if n > sample:
        v = v.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, int(y > 0.5)) for t, y in zip(b.text, b.y) for w in set(_TOKEN.findall(held.value.restore(t or "")))]
            yield pd.DataFrame(rows, columns=["w", "y"])

    words = docs.select("doc_id", "text").join(v, "doc_id").mapInPandas(split, "w string, y int")
    good = words.groupBy("w").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).filter((F.col("pos") >= least) & (F.col("pos") >= 0.9 * F.col("n")))
    return {r["w"]: r["pos"] / r["n"] for r in good.orderBy(F.desc("pos"), "w").collect() if len(r["w"]) > 2}


def abuse(docs: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, kind, passage, restored): one row per document row (doc_id, text), score 0 to 1 of its worst passage.

    Null and empty texts score 0. ``votes`` (doc_id, abusive) are optional.
    """
    words = corpus_words(docs)
    scorer = Scorer(words)
    if votes is not None:
        scorer = Scorer(words, learned_words(docs, votes, scorer))
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *held.value.text(t)) for i, t in zip(b.doc_id, b.text)], columns=["doc_id", "score", "kind", "passage", "restored"])

    return spread(docs.select("doc_id", "text")).mapInPandas(run, SCHEMA)


def rates(scores: DataFrame, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(source, documents, abusive, rate) by trimmed, lower-cased source; null sources are one group."""
    flags = scores.groupBy(F.col("doc_id").alias("d")).agg(F.bool_or(F.col("score") >= threshold).alias("bad"))
    s = docs.select("doc_id", F.lower(F.trim("source")).alias("source")).distinct().join(flags, F.col("doc_id") == F.col("d"))
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("bad").alias("abusive")).withColumn("rate", F.col("abusive") / F.col("documents"))
