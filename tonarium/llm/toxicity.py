"""Toxicity: misspelled lexicon terms by Levenshtein automata, read in context.

Lexicon.  Terms and stems (word beginnings) come from labelled rows: those that
stand in many toxic and hardly any clean texts, by more than chance gives the
best of so many forms.  Terms that explain toxic texts which no better term
explains are primary, further telling ones secondary; their number follows from
the labelled sample alone.

Matching.  The lexicon is a trie; an automaton whose states are sets of (trie
node, edits so far) accepts each word within a term's number of edits (0 for
short terms, else 1), and each word that begins with a stem.  It is made
deterministic on the driver and runs over all words of a batch at once, letter
by letter; most words are dead after a few letters.  Misspelled forms that
clean labelled texts contain are not counted.

Context.  Each hit is weighed by the words around it: quotation marks and
reporting words lower it, address in the second person raises it.

Score.  A logistic regression over a few sums of hits, fitted on labelled rows
whose features come from a lexicon learned on the other half of them, and drawn
towards PRIOR, which few rows leave almost as it is.  At most SAMPLE labelled
rows (those of the smallest hashes) are used; all documents are scored, whole.

Cases: null and empty texts have no hits and get the score of that; labels of
null or without a document are ignored, several labels of one document count
as toxic if any is; without toxic labels a short list of public insults is the
lexicon; an empty table gives an empty result; other columns are not read.
Letters beyond U+FFFF end a word.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Labelled rows that are learned from, at most.
SAMPLE = 10_000
THRESHOLD = 0.3
#: Shortest term that may be misspelled.
FUZZY = 5
STEMS = (4, 5, 6)
INSULTS = (
    "idiot idiots moron morons imbecile imbeciles stupid scum scumbag bastard bastards asshole loser losers worthless pathetic disgusting trash vermin "
    "dummkopf idioten abschaum arschloch trottel schwachkopf connard connards ordure imbécile abruti crétin estúpido imbécil basura idiota cabrón"
).split()
REPORTING = set("said says say called calls calling quote quoted quotes wrote writes word term phrase sagte sagt nannte zitat dit disait appelé citation dijo dice llamó cita".split())
ADDRESS = set("you your yours you're u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes".split())
FEATURES = 7
#: Weights before any label is seen, in the order of features().
PRIOR = (-4.0, 1.0, 2.0, 0.5, 2.5, -0.5, 0.0)


class Automaton:
    """Deterministic automaton of a lexicon: words within a term's edits."""

    def __init__(self, terms: list[tuple[str, bool, int]]):
        """terms: (term, is it a stem, tier)."""
        letters = sorted({c for t, _, _ in terms for c in t})
        self.symbols = {c: i + 2 for i, c in enumerate(letters)}  # 0: no letter, 1: any other
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        edits = [0]
        for k, (term, stem, _) in enumerate(terms):
            node, most = 0, int(not stem and len(term) >= FUZZY)
            edits[0] = max(edits[0], most)
            for c in term:
                s = self.symbols[c]
                if s not in children[node]:
                    children[node][s] = len(children)
                    children.append({}), ends.append([]), edits.append(0)
                node = children[node][s]
                edits[node] = max(edits[node], most)
            ends[node].append(k)

        def closed(states: set[tuple[int, int]]) -> frozenset:
            todo, out = list(states), {}
            while todo:
                node, e = todo.pop()
                if e > edits[node] or out.get(node, 9) <= e:
                    continue
                out[node] = e
                todo += [(x, e + 1) for x in children[node].values()]  # a missing letter
            return frozenset(out.items())

        def accepted(states: frozenset) -> tuple[int, int]:
            best = (9, -1)
            for node, e in states:
                for k in ends[node]:
                    term, stem, _ = terms[k]
                    if e <= int(not stem and len(term) >= FUZZY):
                        best = min(best, (e, k))
            return best

        start = closed({(0, 0)})
        number, todo = {start: 1}, [start]
        rows, self.distance, self.term = {0: [0] * (len(letters) + 2)}, [9, 9], [-1, -1]
        stems: dict[int, int] = {}
        while todo:
            states = todo.pop()
            row = [0]
            for s in range(1, len(letters) + 2):
                then = set()
                for node, e in states:
                    if s in children[node]:
                        then.add((children[node][s], e))
                    if e < edits[node]:
                        then.add((node, e + 1))  # a letter too many
                        then |= {(x, e + 1) for x in children[node].values()}
                then = closed(then)
                stem = min((k for node, e in then if not e for k in ends[node] if terms[k][1]), default=None)
                if stem is not None:  # whatever follows, it is a match
                    if stem not in stems:
                        stems[stem] = len(self.term)
                        self.distance.append(0), self.term.append(stem)
                        rows[stems[stem]] = [0] + [stems[stem]] * (len(letters) + 1)
                    row.append(stems[stem])
                elif not then:
                    row.append(0)
                else:
                    if then not in number:
                        number[then] = len(self.term)
                        e, k = accepted(then)
                        self.distance.append(e), self.term.append(k)
                        todo.append(then)
                    row.append(number[then])
            rows[number[states]] = row
        self.table = np.array([rows[i] for i in range(len(self.term))], np.int32)
        self.distance, self.term = np.array(self.distance), np.array(self.term)
        self.tier = np.array([t for _, _, t in terms] or [0])
        self.steps = max((len(t) for t, _, _ in terms), default=0) + 2

    def classes(self) -> np.ndarray:
        """Symbol by code point; capitals like small letters."""
        out = np.zeros(0x10000, np.uint8)
        for i in range(0x10000):
            c = chr(i)
            if c.isalpha():
                out[i] = self.symbols.get(c.lower(), 1)
        return out

    def match(self, points: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(start, end, state) of the accepted words among code points, and the
        number of words."""
        symbols = np.append(classes[np.minimum(points, 0xFFFF)], 0)
        symbols[:-1][points > 0xFFFF] = 0
        letter = symbols > 0
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        if letter[0]:
            edge = np.r_[0, edge]
        starts, ends = edge[::2], edge[1::2]
        alive, state = np.arange(len(starts)), np.ones(len(starts), np.int32)
        over_words, over_states = [], []
        for k in range(self.steps):
            at = starts[alive] + k
            over = at >= ends[alive]
            if over.any():
                over_words.append(alive[over]), over_states.append(state[over])
                alive, state, at = alive[~over], state[~over], at[~over]
            state = self.table[state, symbols[at]]
            live = state > 0
            alive, state = alive[live], state[live]
            if not len(alive):
                break
        # longer words: only stems accept them, and their states don't change
        stem = (self.table[state, 1] == state) | (starts[alive] + self.steps >= ends[alive])
        words = np.concatenate([*over_words, alive[stem]]) if over_words or len(alive) else alive
        states = np.concatenate([*over_states, state[stem]]) if over_words or len(alive) else state
        good = self.term[states] >= 0
        words, states = words[good], states[good]
        order = np.argsort(words, kind="stable")
        return starts[words[order]], ends[words[order]], states[order], len(starts)


def in_context(text: str, start: int, end: int) -> tuple[float, bool]:
    """(weight of a hit, is it quoted) from the words around it."""
    before, after = text[max(0, start - 200) : start], text[end : end + 200]
    line, rest = before.rsplit("\n", 1)[-1], after.split("\n", 1)[0]
    quoted = line.count('"') % 2 == 1 and '"' in rest
    for opening, closing in ("“”", "«»", "„“"):
        quoted |= line.rfind(opening) > line.rfind(closing) and closing in rest
    near = re.findall(r"[^\W\d_]+", before.lower())[-5:], re.findall(r"[^\W\d_]+", after.lower())[:5]
    weight = 1.0
    if quoted:
        weight *= 0.3
    if REPORTING.intersection(near[0]):
        weight *= 0.6
    if ADDRESS.intersection(near[0]) or ADDRESS.intersection(near[1]):
        weight *= 1.25
    return weight, quoted


def features(text: str, automaton: Automaton, classes: np.ndarray, vetoed: set[str]) -> list[float]:
    exact = fuzzy = other = 0.0
    hits = quotes = words = 0
    seen = False
    for at in range(0, len(text), 1 << 20):  # bounds the memory of very long texts
        stop = min(len(text), at + (1 << 20))
        while stop < len(text) and text[stop - 1].isalpha():  # cut between words
            stop += 1
        if at and text[at - 1].isalpha():
            while at < stop and text[at].isalpha():
                at += 1
        if at >= stop:
            continue
        starts, ends, states, n = automaton.match(np.frombuffer(text[at:stop].encode("utf-32-le"), np.uint32), classes)
        words += n
        for i, j, s in zip(starts.tolist(), ends.tolist(), states.tolist(), strict=True):
            near = automaton.distance[s] > 0
            if near and text[at + i : at + j].lower() in vetoed:
                continue
            weight, quoted = in_context(text, at + i, at + j)
            hits += 1
            quotes += quoted
            if near:
                fuzzy += weight
            elif automaton.tier[automaton.term[s]] == 0:
                exact += weight
                seen = True
            else:
                other += weight
    # a misspelled term counts half; its own sum lets the fit correct that
    return [1.0, math.log1p(exact + 0.5 * fuzzy), float(seen), math.log1p(fuzzy), math.log1p(other), quotes / hits if hits else 0.0, min(10.0, 100 * (exact + other) / words) if words else 0.0]


def logistic(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...] = PRIOR, penalty: float = 0.3) -> np.ndarray:
    """Weights by Newton's steps, drawn towards the prior ones."""
    x, origin = x.reshape(-1, len(prior)), np.array(prior)
    w, ridge = origin.copy(), np.eye(len(prior)) * penalty
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ (w - origin))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def log_odds(toxic, clean, n_toxic: int, n_clean: int):
    return np.log((np.asarray(toxic) + 0.5) / (n_toxic + 1)) - np.log((np.asarray(clean) + 0.5) / (n_clean + 1))


def choose(candidates: list[str], docs: dict[str, set[int]], toxic: set[int], clean: set[int]) -> list[tuple[str, bool, int]]:
    """The lexicon: primary terms cover toxic texts greedily, the further
    telling ones are secondary.  A candidate that ends in * is a stem."""
    own = {c: docs[c] & toxic for c in candidates}
    bad = {c: len(docs[c] & clean) for c in candidates}
    left, out = set(toxic), []
    least = max(2, len(toxic) // 500)

    def worth(c: str) -> tuple:
        n = len(own[c] & left)
        good = n * float(log_odds(n, bad[c], len(toxic), len(clean))) if n >= max(least, 2 * bad[c]) else 0.0
        return -max(0.0, good), c[-1] == "*", -len(c), c

    heap = [worth(c) for c in candidates]
    heapq.heapify(heap)
    while heap and heap[0][0] < 0:
        c = heap[0][-1]
        now = worth(c)
        if now > heap[0]:  # others explain some of its texts by now
            heapq.heapreplace(heap, now)
            continue
        heapq.heappop(heap)
        left -= own[c]
        out.append((c.rstrip("*"), c[-1] == "*", 0))
    stems = tuple(t for t, stem, _ in out if stem)
    taken = {t for t, _, _ in out}
    for c in candidates:
        t = c.rstrip("*")
        if c[-1] != "*" and t not in taken and not (stems and t.startswith(stems)) and bad[c] == 0 and len(own[c]) >= max(3, len(toxic) // 100):
            out.append((t, False, 1))
            taken.add(t)
    return out if toxic else [(t, False, 1) for t in INSULTS]


class Model:
    """A lexicon's automaton, vetoed forms, and the regression's weights."""

    def __init__(self, terms, vetoed, weights):
        self.terms, self.vetoed, self.weights = terms, vetoed, weights


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _features(texts: DataFrame, lexicons: list[Automaton], vetoed: list[set[str]]) -> list:
    """(label, fold, features) of the sample: at most SAMPLE rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = [a.classes() for a in lexicons]
        for batch in batches:
            y, fold = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            x = [features(t, lexicons[f], classes[f], vetoed[f]) for t, f in zip(batch.column(0).to_pylist(), fold, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(fold, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["y", "fold", "x"])

    return texts.select("text", "y", "fold").mapInArrow(run, "y int, fold int, x array<double>").collect()


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from labelled rows that are not held out, at most ``sample``."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # bounded: sent to all
    texts = docs.join(F.broadcast(known), F.col(id_col) == F.col("_id")).where(F.col(text_col).isNotNull())
    texts = texts.select("_id", F.col(text_col).alias("text"), "y", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(2)).cast("int").alias("fold"))
    # copies of a text tell nothing new
    texts = written(texts.groupBy(F.md5("text").alias("_same")).agg(F.min_by(F.struct("text", "y", "fold"), F.col("_id")).alias("r"), F.min("_id").alias("_id")).select("_id", "r.*"), "toxic-sample")
    tokens = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), lambda t: F.length(t) >= 3)
    forms = F.concat(tokens, *[F.transform(F.filter(tokens, lambda t: F.length(t) > n), lambda t: F.concat(F.substring(t, 1, n), F.lit("*"))) for n in STEMS])
    counts = {f"n{y}{f}": F.count_if((F.col("y") == y) & (F.col("fold") == f)) for y in (0, 1) for f in (0, 1)}
    stats = written(texts.select("y", "fold", F.explode(F.array_distinct(forms)).alias("form")).groupBy("form").agg(*[v.alias(k) for k, v in counts.items()]), "toxic-forms")
    size = {(r.y, r.fold): r["count"] for r in texts.groupBy("y", "fold").count().collect()}
    n1, n0 = (sum(size.get((y, f), 0) for f in (0, 1)) for y in (1, 0))
    toxic, clean = F.col("n10") + F.col("n11"), F.col("n00") + F.col("n01")
    gain = toxic * (F.log((toxic + 0.5) / (n1 + 1)) - F.log((clean + 0.5) / (n0 + 1)))
    # the best of so many forms gains the log of their number by chance; what
    # remains is bounded by the sample's words
    listed = stats.where((toxic >= 2) & (toxic >= clean) & (gain > math.log(max(1, stats.count())))).orderBy(F.desc(gain), "form")
    candidates = [r.form for r in listed.collect()]
    wanted = set(candidates)

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found = set(re.findall(r"[^\W\d_]+", text.lower()))
                found |= {t[:n] + "*" for t in found for n in STEMS if len(t) > n}
                out.append(sorted(found & wanted))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(out, pa.list_(pa.string()))], ["id", "y", "fold", "forms"])

    sets: dict[str, set[int]] = defaultdict(set)
    label: dict[int, tuple[int, int]] = {}
    for i, r in enumerate(texts.mapInArrow(incidence, "id long, y int, fold int, forms array<string>").collect()):
        label[i] = (r.y, r.fold)
        for form in r.forms:
            sets[form].add(i)
    pick = lambda y, folds: {i for i, (a, f) in label.items() if a == y and f in folds}
    # the fold's own texts are matched with the lexicon of the other fold
    lexicons = [choose(candidates, sets, pick(1, f), pick(0, f)) for f in ({1}, {0}, {0, 1})]
    automata = [Automaton(x) for x in lexicons]

    def misspelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = [a.classes() for a in automata]
        for batch in batches:
            keep = []
            for i, form in enumerate(batch.column(0).to_pylist()):
                for a, c in zip(automata, classes, strict=True):
                    _, _, states, _ = a.match(np.frombuffer(form.encode("utf-32-le"), np.uint32), c)
                    if len(states) and a.distance[states[0]] > 0:
                        keep.append(i)
                        break
            yield batch.take(pa.array(keep, pa.int64())) if keep else batch.slice(0, 0)

    known_clean = stats.where((clean > 0) & (F.length("form") >= FUZZY - 1) & ~F.col("form").endswith("*"))
    found = known_clean.select("form", "n00", "n01").mapInArrow(misspelled, "form string, n00 long, n01 long").collect()
    vetoed = {r.form for r in found}
    rows = _features(texts, automata[:2], [{r.form for r in found if r.n01}, {r.form for r in found if r.n00}])
    weights = logistic(np.array([r.x for r in rows], float), np.array([r.y for r in rows], float))
    return Model(lexicons[2], vetoed, weights)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1), hits: terms found, as (begin, end, term, edits),
    in code points of the text, and the columns of ``keep`` as they are, so
    that a filter on the score needs no join."""
    automaton, vetoed, weights, terms = Automaton(model.terms), model.vetoed, model.weights, model.terms
    hit_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = automaton.classes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                # one run of the automaton over all texts; most have no hit
                points = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
                starts, ends, states, _ = automaton.match(points, classes) if len(points) else (np.zeros(0, int),) * 3 + (0,)
                first = np.cumsum([0, *(len(t) + 1 for t in texts)])
                which = np.searchsorted(first, starts, "right") - 1
                hits: list[list[dict]] = [[] for _ in texts]
                for d, i, j, s in zip(which.tolist(), starts.tolist(), ends.tolist(), states.tolist(), strict=True):
                    begin, end = i - int(first[d]), j - int(first[d])
                    if automaton.distance[s] == 0 or texts[d][begin:end].lower() not in vetoed:
                        hits[d].append({"begin": begin, "end": end, "term": terms[automaton.term[s]][0], "edits": int(automaton.distance[s])})
                x = np.array([features(t, automaton, classes, vetoed) if h else [1.0] + [0.0] * (FEATURES - 1) for t, h in zip(texts, hits, strict=True)])
                y = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                kept = [part.column(1 if c == text_col else 2 + others.index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(y), pa.array(hits, hit_type), *kept], ["doc_id", "score", "hits", *keep])

    others, kinds = [c for c in keep if c != text_col], dict(docs.dtypes)
    schema = f"doc_id {kinds[id_col]}, score double, hits array<struct<begin:bigint,end:bigint,term:string,edits:int>>" + "".join(f", `{c}` {kinds[c]}" for c in keep)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(others)]).mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
