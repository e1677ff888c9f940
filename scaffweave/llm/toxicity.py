"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learning_texts, sample_by_hash, with_fields
from .words import ALNUM, byte_values, find_words, runs, text_buffer, word_hashes

#: Labelled documents that lexicon and weights are learned from, at most (chosen by a hash of the id).
SAMPLE = 6000
#: Letters of the stems that are tried.
STEMS = range(4, 9)
#: Odds of a word in toxic texts against others that make it as sure as the listed ones.
SURE = 1000.0
_VALUES = byte_values(41, lower=True)

# The closed word classes of the grammar, in English, German, French and Spanish.
TARGETS = "you your yours u ur he she they him her them du dich dir ihr euch sie tu toi vous il elle ils tú ti usted ustedes él ella ellos".split()
INTENTS = "will shall gonna going should must want ll werde werden wird sollte muss vais va allons devrait doit voy vamos debería debe quiero".split()
NEGATIONS = "not no never isn aren don wasn won nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says say told wrote quoted called reported claimed word term sagte sagt schrieb nannte wort dit dis écrit disait mot dijo dice escribió palabra".split()
THREATS = "kill hurt destroy murder attack shoot stab burn töten verletzen zerstören umbringen tuer frapper détruire matar herir destruir".split()
INSULTS = "idiot stupid moron loser trash worthless pathetic disgusting scum dumb imbecile dumm trottel abschaum crétin imbécile imbécil estúpido basura".split()

#: What a word is when it is read.
OTHER, INSULT, THREAT, TARGET, INTENT, NEGATION, REPORT = "other", "insult", "threat", "target", "intent", "negation", "report"
BASE = (OTHER, INSULT, THREAT, TARGET, INTENT, NEGATION, REPORT)
#: What the grammar makes of a clause by the insult or threat in it, from the weakest match to the strongest.
LABELS = ("reported", "negated", "bare", "aimed", "menace", "intended menace")
#: Symbols between the transducers for a match: they begin with these.
_BARE, _AIMED, _MENACE, _INTENDED = "bare", "aimed", "menace", "intended menace"
#: Weights before anything is learned: the bias, then one for each label.
PRIOR = np.array([-5.0, 1.0, 1.0, 7.0, 10.0, 10.0, 12.0])
#: The highest score of one bare insult: an isolated word, however often it stands, makes no text toxic.
ALONE = 0.6
_WORD = re.compile(r"[^\W_]+")
_CLAUSE_END = np.isin(np.arange(256), np.frombuffer(b".;!?\n", np.uint8))


@dataclass(frozen=True)
class Transducer:
    """A deterministic one: step(state, symbol) gives the next state and the symbol to pass on."""

    start: object
    step: Callable

    def run(self, symbols: list) -> list:
        state, out = self.start, []
        for s in symbols:
            state, o = self.step(state, s)
            out.append(o)
        return out


def compose(*parts: Transducer) -> Transducer:
    """One transducer that passes every symbol through all parts: its states are tuples of theirs.

    Steps are worked out when they are first taken and kept in a table, so only states that texts reach exist.
    """
    table: dict = {}

    def step(state: tuple, symbol):
        hit = table.get((state, symbol))
        if hit is None:
            after, s = [], symbol
            for part, own in zip(parts, state, strict=True):
                own, s = part.step(own, s)
                after.append(own)
            hit = table[state, symbol] = (tuple(after), s)
        return hit

    return Transducer(tuple(p.start for p in parts), step)


def threat(reach: int = 4) -> Transducer:
    """A threat word with a target within `reach` words behind it is a menace, told at the target; one with an
    intent before it is an intended menace. A threat word alone is any other word.

    The state counts down words since an intent, since a threat word, and whether that one was intended.
    """

    def step(state, s):
        intent, verb, meant = state
        left = (max(0, intent - 1), max(0, verb - 1), meant and verb > 1)
        if s == INTENT:
            return (reach, *left[1:]), s
        if s == THREAT:
            return (left[0], reach, intent > 0), OTHER
        if s == TARGET and verb:
            return (left[0], 0, False), _INTENDED if meant else _MENACE
        return left, s

    return Transducer((0, 0, False), step)


def insult(before: int = 4, behind: int = 2) -> Transducer:
    """An insult with a target up to `before` words before it, or, told there, up to `behind` words behind it, is
    aimed; any other one is bare. A target of a menace counts as one."""

    def step(state, s):
        target, bare = state
        left = (max(0, target - 1), max(0, bare - 1))
        if s == INSULT:
            return (left[0], behind), _AIMED if target else _BARE
        if s in (TARGET, _MENACE, _INTENDED):
            return (before, 0), _AIMED if bare and s == TARGET else s
        return left, s

    return Transducer((0, 0), step)


def marker(trigger: str, reach: int, label: str) -> Transducer:
    """For `reach` words after the trigger, matches get the label instead; the state counts down."""

    def step(state, s):
        if s == trigger:
            return reach, s
        return max(0, state - 1), label if state and s in LABELS else s

    return Transducer(0, step)


def strongest() -> Transducer:
    """Passes on the strongest match so far; at the end that is the clause's label, OTHER if there is none."""
    rank = {x: i for i, x in enumerate(LABELS)}

    def step(state, s):
        best = s if rank.get(s, -1) > rank.get(state, -1) else state
        return best, best

    return Transducer(OTHER, step)


def grammar() -> Transducer:
    """Threats, insults and their targets, then negation up to 6 words and reported speech up to 8 words before."""
    return compose(threat(), insult(), marker(NEGATION, 6, "negated"), marker(REPORT, 8, "reported"), strongest())


class Lexicon:
    """Word classes and weights by the hash of the word, or for an entry `stem*` by that of its first bytes."""

    def __init__(self, learned: dict[str, float]):
        words: dict[str, tuple[int, float]] = {}  # the place in BASE and the weight
        for group, symbol in ((INSULTS, INSULT), (THREATS, THREAT), (TARGETS, TARGET), (INTENTS, INTENT), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            words.update({w: (BASE.index(symbol), 1.0) for w in group})
        for w, weight in learned.items():
            if w not in words:
                words[w] = (BASE.index(INSULT), weight)
        parts: dict[int, list] = defaultdict(list)  # by the stem's bytes; 0: whole words
        for w, entry in words.items():
            stem = w.rstrip("*")
            parts[len(stem.encode()) if w != stem else 0].append((stem, *entry))
        self.groups = []
        for size, entries in sorted(parts.items()):
            raw, offsets = text_buffer(pa.array([e[0] for e in entries], pa.large_string()))
            starts, ends, first = find_words(raw, offsets, ALNUM)
            single = np.flatnonzero(np.diff(first) == 1)
            hashes = word_hashes(raw, starts, ends, _VALUES)[first[:-1][single]]
            order = np.argsort(hashes)
            symbols, weights = (np.array([entries[i][k] for i in single])[order] for k in (1, 2))
            if len(single):
                self.groups.append((size, hashes[order], symbols, weights))

    def read(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class (its place in BASE) and weight of each word; whole words go before stems, short stems before longer."""
        symbols, weights = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        for size, hashes, own, w in self.groups:
            h = word_hashes(raw, starts, np.minimum(starts + size, ends) if size else ends, _VALUES)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            found = np.flatnonzero((hashes[at] == h) & (symbols == 0))
            symbols[found], weights[found] = own[at[found]], w[at[found]]
        return symbols, weights


def clause_counts(raw: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, fst: Transducer) -> np.ndarray:
    """For each text and label, the summed weights of what its clauses of that label hold.

    A clause is what stands between full stops, semicolons, marks and line feeds, and gets one label. It counts by its
    weightiest word, a bare one by all its insults; the same word under the same label counts once in a text.
    """
    out = np.zeros((len(offsets) - 1, len(LABELS)))
    rank = {x: i for i, x in enumerate(LABELS)}
    for lo, hi in runs(offsets):
        part = raw[offsets[lo] : offsets[hi]]
        starts, ends, first = find_words(part, offsets[lo : hi + 1] - offsets[lo], ALNUM)
        if not len(starts):
            continue
        symbols, weights = lexicon.read(part, starts, ends)
        bad = np.flatnonzero((symbols == BASE.index(INSULT)) | (symbols == BASE.index(THREAT)))
        if not len(bad):
            continue
        edge = np.concatenate([[0], np.cumsum(_CLAUSE_END[part])])[starts]
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        new = np.concatenate([[True], (edge[1:] != edge[:-1]) | (doc[1:] != doc[:-1])])
        begins = np.append(np.flatnonzero(new), len(starts))
        of = np.cumsum(new) - 1
        names = word_hashes(part, starts[bad], ends[bad], _VALUES)
        seen: set = set()
        at = 0
        for k in np.unique(of[bad]).tolist():
            heads = []
            while at < len(bad) and of[bad[at]] == k:
                heads.append(at)
                at += 1
            label = fst.run([BASE[x] for x in symbols[begins[k] : begins[k + 1]].tolist()])[-1]
            if label not in rank:
                continue
            if label in (_BARE, _AIMED):
                heads = [h for h in heads if symbols[bad[h]] == BASE.index(INSULT)]
            own = doc[begins[k]]
            for h in heads if label == _BARE else [max(heads, key=lambda h: (weights[bad[h]], names[h]))]:
                if (own, label, names[h]) not in seen:
                    seen.add((own, label, names[h]))
                    out[lo + own, rank[label]] += weights[bad[h]]
    return out


def learn_lexicon(texts: list[str], labels: np.ndarray, least: int = 6, least_odds: float = 20.0) -> dict[str, float]:
    """Words, and stems of 4 to 8 letters with 3 endings at least, that mark toxic texts.

    They stand in toxic texts nearly only, and there after at least `least` different words, so that the
    words of one text and its copies are not taken for insults. A word's weight is 1 if its odds in toxic texts
    are SURE, and by the logarithm of the odds below. A stem that holds for its first letters already is not listed again.
    """
    after: dict[str, set] = defaultdict(set)
    forms: dict[str, set] = defaultdict(set)
    toxic, clean = Counter(), Counter()
    for x, y in zip(texts, labels, strict=True):
        words = _WORD.findall(x.lower())
        entries = set()
        for a, b in zip(["", *words], words, strict=False):
            own = [b, *(b[:k] + "*" for k in STEMS if len(b) > k)]
            entries.update(own)
            if y:
                for e in own:
                    after[e].add(a)
                    forms[e].add(b)
        (toxic if y else clean).update(entries)
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    out: dict[str, float] = {}
    for w, n in sorted(toxic.items(), key=lambda e: (len(e[0]), e[0])):
        if len(after[w]) < least or n < least or w[-1] == "*" and (len(forms[w]) < 3 or any(w[:k] + "*" in out for k in STEMS if k < len(w) - 1)):
            continue
        odds = (n / n1) / ((clean[w] + 0.5) / n0)
        if odds >= least_odds:
            out[w] = min(1.0, math.log(odds) / math.log(SURE))
    return out


def calibrate(counts: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Logistic weights by Newton steps, held near PRIOR where the labels don't tell otherwise.

    One bare insult of weight 1 scores ALONE at most.
    """
    w = PRIOR.copy()
    if not len(y):
        return w
    x = np.concatenate([np.ones((len(counts), 1)), np.log1p(counts)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (p - y) + ridge * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(curve, slope), -2, 2)
    bare = 1 + LABELS.index(_BARE)
    w[bare] = min(w[bare], (math.log(ALONE / (1 - ALONE)) - w[0]) / math.log(2))
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", bound: int = SAMPLE) -> dict:
    """Lexicon and weights from at most about `bound` labelled documents that are not held out; the fixed
    word classes and PRIOR if there are none.

    Of rows that repeat a key or a text, each different (label, text) counts once, and of one key's at most
    KEY_ROWS, with their first LEARNED characters, and not more than LEARN_BYTES in all.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).select(key, F.col(label).alias("y"))
    chosen = sample_by_hash(known.groupBy(key).agg(F.max("y").alias("y")), key, bound)
    texts, y = learning_texts(docs, chosen, key, text, bound)
    learned = learn_lexicon(texts, y)
    raw, offsets = text_buffer(pa.array(texts, pa.large_string()))
    return {"lexicon": learned, "weights": calibrate(clause_counts(raw, offsets, Lexicon(learned), grammar()), y)}


def score_toxicity(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, all by default) with score, the probability that a document is toxic.

    Words get classes from the lexicon; every clause that holds an insult or a threat gets a label by the
    composed transducer: bare or aimed insult, menace, intended menace, or one of these negated or reported.
    A document's score is a logistic function of the weights of its clauses. Texts with no match, null and
    empty ones too, score the bias alone. Very long texts are read whole; ties cannot arise, as a score hangs
    on the text alone, so repeated rows score alike; an empty table gives no rows; a column named score is replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != "score"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, fst, w = Lexicon(model["lexicon"]), grammar(), model["weights"]
        for batch in batches:
            counts = clause_counts(*text_buffer(batch.column(0)), lexicon, fst)
            score = 1 / (1 + np.exp(-(w[0] + np.log1p(counts) @ w[1:])))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score, pa.float64())], names=[*kept, "score"])

    shape = with_fields(docs.select(*kept), "score double")
    return docs.select(F.col(text).alias("__text"), *kept).mapInArrow(judge, shape)
