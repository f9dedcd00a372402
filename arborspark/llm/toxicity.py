"""Toxicity: a learned lexicon, met through Levenshtein automata, judged in its context.

1. Lexicon: words, and stems shared by several words, whose presence in labelled
   documents speaks for toxicity beyond chance.  Their counts are Spark
   aggregates; only the selected terms (at most `terms`) reach the driver.
2. Matching: texts are cut at white space, and these chunks into words of letters
   and digits as the lexicon's are; a chunk is looked up whole (stripped of marks)
   if none of its words hits.  A trie holds the words and the stems.  A Levenshtein
   automaton (one edit, or two neighbouring letters exchanged) over it, deterministic
   and so one look-up a letter, accepts at a word's end, or at a stem's end as a prefix,
   so misspelled terms are found; words known from clean documents are exceptions.
   Of four letters, only exchanged, replaced or inserted inner letters count.
3. Context: each hit is weighed by the window around it.  Hits inside quotation
   marks or after a reporting verb count as quotation, hits near a second-person
   word as directed abuse.
4. A logistic model over the evidence of a document gives its score.

Fitted on about `sample` labelled ids (picked by hash), twice as many rows at most; scoring
reads every whole text in place and shuffles nothing.

Defined cases: null and empty texts have no evidence and get the lowest score;
without toxic labels there is no lexicon and all scores are equal; repeated rows
score alike; other columns are carried only if asked for.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, release_memory, staged
from .quality import learnable, sampled_labels

_EDGE = " \t\n\r.,;:!?\"'()[]{}<>«»“”„‚‘’‹›…*#$%&/\\|-–—_=+~^`"
#: Words as `learn_lexicon` cuts them.
_WORD = re.compile(r"[^\W_]+")
_OPEN, _CLOSE = "“„«‹", "”»›"
_QUOTES = frozenset(_OPEN + _CLOSE + '"')

#: Words that report speech, and second-person words, in the supported languages.
REPORTING = frozenset("said says wrote writes called quote quoted quotes term word dit disait écrit mot sagte sagt schrieb nannte wort dijo dice escribió llamó palabra".split())
SECOND_PERSON = frozenset("you your yours you're ya u tu toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti te tus vosotros usted ustedes".split())

FEATURES = ("abuse", "quotation", "directed", "density")


class Automaton:
    """Levenshtein automaton of one edit over the trie of words and stems, made deterministic as texts ask for its states.

    A state is a set of (trie node, edits left) and of exchanges that wait for their
    second letter; each letter of a word is one look-up in its state's table.  The table
    holds at most `most` states and starts anew beyond that.
    """

    def __init__(self, words: frozenset[str], stems: frozenset[str], most: int = 100_000):
        self.children: list[dict[str, int]] = [{}]
        self.word_ends: set[int] = set()
        self.stem_ends: set[int] = set()
        for terms, ends in ((words, self.word_ends), (stems, self.stem_ends)):
            for term in terms:
                if len(term) >= 5:
                    ends.add(self._insert(term))
        self.letters = frozenset(c for node in self.children for c in node)
        #: Of four letters: terms with one letter left open, and the terms themselves.
        self.short = frozenset(t for t in words | stems if len(t) == 4)
        self.short_open = frozenset(t[:i] + "\0" + t[i + 1 :] for t in self.short for i in range(4))
        self.most = most
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.tables: list[dict[str, int]] = []
        self.accepts: list[int] = []  # 2: a stem is met, whatever follows; 1: a word is met if the text's word ends here
        self._number(frozenset())  # 0: nothing can be met any more
        self.start = self._number(frozenset([(0, 1, "")]))

    def _insert(self, term: str) -> int:
        node = 0
        for c in term:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
            node = self.children[node][c]
        return node

    def _number(self, state: frozenset) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.tables.append({})
            reached = {node for node, _, wait in state if not wait} | {c for node, left, wait in state if left and not wait for c in self.children[node].values()}
            self.accepts.append(2 if reached & self.stem_ends else 1 if reached & self.word_ends else 0)
        return n

    def _step(self, n: int, letter: str) -> int:
        """The state after a letter; letters of no term are all alike ('')."""
        out: set[tuple[int, int, str]] = set()
        for node, left, wait in self.states[n]:
            if wait:
                if wait == letter:
                    out.add((node, 0, ""))
                continue
            children = self.children[node]
            if letter in children:
                out.add((children[letter], left, ""))
            if left:
                out.add((node, 0, ""))  # a letter too many
                for c, child in children.items():
                    below = self.children[child].get(letter)
                    if below is not None:
                        out.add((below, 0, ""))  # c was left out
                    if c != letter:
                        out.add((child, 0, ""))
                        if below is not None:
                            out.add((below, 0, c))  # exchanged, if c comes next
        found = self._number(frozenset(out))
        self.tables[n][letter] = found
        return found

    def near(self, word: str) -> bool:
        """Whether word is within one edit of a word, or begins within one edit of a stem; an exchange of neighbours is one."""
        if len(self.states) > self.most:
            self._reset()
        tables, accepts, n = self.tables, self.accepts, self.start
        for c in word:
            to = tables[n].get(c)
            if to is None:
                if c not in self.letters:
                    c = ""
                    to = tables[n].get(c)
                if to is None:
                    to = self._step(n, c)
            n = to
            if not n:
                return False
            if accepts[n] == 2:
                return True
        return accepts[n] > 0

    def near_short(self, w: str) -> bool:
        """Within one replaced or exchanged letter of a term of four letters, or one inserted inner letter."""
        if len(w) == 4:
            if any(w[:i] + "\0" + w[i + 1 :] in self.short_open for i in range(4)):
                return True
            return any(w[:i] + w[i + 1] + w[i] + w[i + 2 :] in self.short for i in range(3))
        return len(w) == 5 and any(w[:i] + w[i + 1 :] in self.short for i in range(1, 4))


@functools.lru_cache(maxsize=1)
def _automaton(words: frozenset[str], stems: frozenset[str]) -> Automaton:
    """The Python worker's automaton: tasks share its table."""
    return Automaton(words, stems)


@dataclass(frozen=True)
class Lexicon:
    """Terms as words and stems, with exceptions."""

    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()
    exceptions: frozenset[str] = frozenset()

    def __reduce__(self):
        return Lexicon, (self.words, self.stems, self.exceptions)

    @functools.cached_property
    def automaton(self) -> Automaton:
        return _automaton(self.words, self.stems)

    @functools.cached_property
    def stem_sizes(self) -> list[int]:
        return sorted({len(s) for s in self.stems})

    def hit(self, chunk: str) -> str:
        """'' or how a word, or a chunk of text as a whole, matches: word, stem or near."""
        w = chunk.lower().strip(_EDGE)
        if w in self.words:
            return "word"
        for k in self.stem_sizes:
            if w[:k] in self.stems:
                return "stem"
        if len(w) < 4 or w in self.exceptions:
            return ""
        return "near" if self.automaton.near(w) or self.automaton.near_short(w) else ""

    def hits(self, chunk: str) -> int:
        """How many terms a chunk holds: its words are looked up, then the whole for marks and digits inside a term."""
        whole = chunk.strip(_EDGE).lower()
        if whole.isalnum():
            return int(bool(self.hit(whole)))
        words = _WORD.findall(chunk.lower())
        found = sum(bool(self.hit(w)) for w in words)
        if found or (len(words) == 1 and words[0] == whole) or any(w in self.exceptions for w in words):
            return found
        return int(bool(self.hit(chunk)))


def _words(chunk: str) -> list[str]:
    """The words of a chunk, and the chunk without marks around it."""
    whole = chunk.lower().strip(_EDGE)
    return [whole] if whole.isalnum() else [*_WORD.findall(whole), whole]


def evidence(text: str, lexicon: Lexicon, memo: dict[str, int], window: int = 8) -> tuple[float, float, float, float]:
    """FEATURES of a whole text."""
    chunks = text.split()
    hits = {}
    for c in set(chunks):
        n = memo.get(c)
        if n is None:
            n = memo[c] = lexicon.hits(c)
        if n:
            hits[c] = n
    if not hits:
        return 0.0, 0.0, 0.0, 0.0
    abuse = quotation = directed = 0.0
    depth, plain = 0, False  # inside typographic quotes; inside straight ones
    quoted = not _QUOTES.isdisjoint(text)
    for i, c in enumerate(chunks):
        if c in hits:
            around = [w for x in chunks[max(0, i - window) : i + window + 1] for w in _words(x)]
            reported = any(w in REPORTING for x in chunks[max(0, i - 3) : i] for w in _words(x))
            inside = depth > 0 or plain or c[0] in "\"“„«‹" or reported
            closes = c[0] in "\"“„«‹" or any(set(x) & set("\"”»›“") for x in chunks[i : i + 4 * window])
            if inside and (closes or reported):
                quotation += hits[c]
            else:
                abuse += hits[c]
                directed += hits[c] * any(x in SECOND_PERSON for x in around)
        if not quoted or _QUOTES.isdisjoint(c):
            continue
        if '"' in c:
            plain ^= c.count('"') % 2 == 1
        for ch in c:
            if ch in _OPEN:
                depth += 1
            elif ch in _CLOSE:
                depth = max(0, depth - 1)
    return math.log1p(abuse), math.log1p(quotation), math.log1p(directed), math.log1p(100 * abuse / len(chunks))


def learn_lexicon(rows: DataFrame, *, terms: int = 2000, shortest: int = 3, margin: float = 3.0, stem_sizes: Sequence[int] = (4, 5, 6, 7), most_exceptions: int = 100_000) -> Lexicon:
    """The lexicon of rows(label, text).

    Words and stems pass a likelihood-ratio test against the number of
    candidates; the `terms` of highest ratio stay, and of the clean words near
    them the `most_exceptions` of most documents.
    """
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if toxic < 1 or toxic == n:
        return Lexicon()
    base = toxic / n
    bag = rows.select("label", F.monotonically_increasing_id().alias("doc"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("words"))
    each = bag.select("label", "doc", F.explode("words").alias("word")).filter(F.length("word") >= shortest)
    words = staged(each.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")), "toxicity-words")

    sizes = F.array(*map(F.lit, stem_sizes))
    cut = lambda: F.explode(F.transform(F.filter(sizes, lambda k: k < F.length("word")), lambda k: F.substring("word", F.lit(1), k))).alias("stem")
    in_toxic = each.filter("label = 1").select("doc", "word", cut()).groupBy("stem", "doc").agg(F.first("word").alias("word"))
    in_toxic = in_toxic.groupBy("stem").agg(F.count("*").cast("double").alias("toxic"), F.count_distinct("word").alias("forms"))
    in_clean = words.filter("clean > 0").select("clean", cut()).groupBy("stem").agg(F.sum("clean").alias("clean"))
    stems = in_toxic.filter("toxic >= 2 AND forms >= 3").join(in_clean, "stem", "left").select(F.col("stem").alias("term"), "toxic", F.coalesce("clean", F.lit(0.0)).alias("clean"), F.lit(True).alias("is_stem"))
    found = words.filter("toxic >= 2").select(F.col("word").alias("term"), "toxic", "clean", F.lit(False).alias("is_stem")).unionByName(stems)

    p = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    ratio = F.col("toxic") * F.log(p / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - p) / (1 - base))).otherwise(0.0)
    found = staged(found.withColumn("p", p).withColumn("ratio", ratio).filter("p >= 0.8"), "toxicity-terms")
    least = math.log(max(1, found.count())) + margin
    rows = found.filter(F.col("ratio") >= least).orderBy(F.desc("ratio"), "term").limit(terms).collect()
    stems_, words_ = set(), set()
    for r in sorted((r for r in rows if r.is_stem and r.p >= 0.95), key=lambda r: (len(r.term), r.term)):
        if not any(r.term[:k] in stems_ for k in stem_sizes if k < len(r.term)):
            stems_.add(r.term)
    for r in rows:
        if not r.is_stem:
            words_.add(r.term)
    lexicon = Lexicon(frozenset(words_), frozenset(stems_))

    def clean_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [w for w in b.column(0).to_pylist() if lexicon.hit(w) == "near"]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], names=["word"])

    known = words.filter(F.col("clean") > F.col("toxic")).select("word").mapInArrow(clean_neighbours, "word string").join(words, "word")
    known = known.orderBy(F.desc("clean"), "word").limit(most_exceptions).collect()
    return Lexicon(lexicon.words, lexicon.stems, frozenset(r.word for r in known))


def with_evidence(docs: DataFrame, lexicon: Lexicon, memo_size: int = 150_000) -> DataFrame:
    """docs(carried columns..., text last) with FEATURES in place of the text."""
    bounded_batches(docs.sparkSession)
    carried = docs.columns[:-1]
    schema = docs.select(*carried).schema
    for name in FEATURES:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}  # of a task, so that workers give the memory back
        for batch in batches:
            rows = []
            for text in batch.column(len(carried)):
                if len(memo) > memo_size:
                    memo.clear()
                rows.append(evidence(text.as_py() or "", lexicon, memo))
            columns = [pa.array(c, pa.float64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*carried, *FEATURES])
            pa.default_memory_pool().release_unused()
        memo.clear()
        release_memory()

    return docs.mapInArrow(run, schema)


def fit_evidence(rows: DataFrame) -> tuple[float, tuple[float, ...]]:
    """Intercept and weights of a ridge logistic model over rows(label, FEATURES)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not n or toxic in (0, n):
        p = min(0.98, max(0.02, toxic / n if n else 0.02))
        return math.log(p / (1 - p)), (0.0,) * len(FEATURES)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features").cache()
    model = LogisticRegression(regParam=0.001, maxIter=40).fit(data)
    data.unpersist()
    return float(model.intercept), tuple(map(float, model.coefficients.toArray()))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, carry: Sequence[str] = ("doc_id",), threshold: float = 0.5, sample: int = 20_000) -> DataFrame:
    """doc (the carried columns), held_out, score, predicted for every row of docs(doc_id, text)."""
    chosen = sampled_labels(labels, "toxic", sample)
    learn = learnable(docs.select("doc_id", F.xxhash64("text").alias("hash"), F.coalesce("text", F.lit("")).alias("text")), chosen, sample, "toxicity-sample")
    lexicon = learn_lexicon(learn)
    intercept, weights = fit_evidence(staged(with_evidence(learn, lexicon), "toxicity-evidence").coalesce(6))
    total = F.lit(intercept)
    for name, w in zip(FEATURES, weights, strict=True):
        total = total + F.col(name) * w
    rows = with_evidence(docs.select(F.struct(*carry).alias("doc"), held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text")), lexicon)
    scored = rows.select("doc", "held_out", (1 / (1 + F.exp(-total))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
