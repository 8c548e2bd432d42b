"""Mapping free text to the entries of a reference list.

Each entry is put into a trie under its name and its alias paths: the listed aliases, the words in
another order, without function words, written as one word, with the first word as an initial, as initials.
A text is searched in the trie with a Levenshtein automaton; the distance allowed grows with the length.
Codes (tokens with a digit, as of strains) must agree exactly, whatever the distance. A text that finds
nothing is walked once more with words that may end early, for abbreviations, which no edit distance covers.

Words that say nothing about which entry is meant (the, online, strain) are not listed here but learned
from all texts: a phrase of up to three words that stands before or after the whole forms of several
entries and has no word of any name of the kind is decoration, and is taken off before the search.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.automaton import Automaton, Trie, edit_distance
from quillon.session import Workspace

MOST = 2  # edits in a long text
BLOCK = 50_000  # entries that are broadcast at once; a longer list is searched block by block
BESIDE = 3  # names beside which a phrase must stand to be decoration
PHRASE = 3  # words of a phrase
#: fixed values: English function words, which alias paths may leave out
SMALL_WORDS = ("of", "in", "on", "for", "and", "the")

_MARKS = re.compile(r"\[\d+\]|[*`]+|(?<=\w)-(?=\w)|[’']")
_DASHES = str.maketrans(dict.fromkeys("‐‑‒–—−", "-"))
_VERSION = re.compile(r"\bv\d+(\.\d+)*\b")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(r"[^\W_]+")
_CODE = re.compile(r"\b([a-z]{1,4}) (\d{1,7})\b")


def clean(text: str) -> tuple[str, tuple[str, ...]]:
    """The words of a text without marks, and its codes in order."""
    text = unicodedata.normalize("NFKD", text)
    text = "".join(x for x in text if not unicodedata.combining(x)) if not text.isascii() else text
    text = _MARKS.sub("", text.translate(_DASHES)).strip()
    if not re.search(r"[\s_]", text):
        text = _CAMEL.sub(" ", text)
    text = _VERSION.sub(" ", text.lower())
    words = _CODE.sub(r"\1\2", " ".join(_TOKEN.findall(text))).split()
    codes = tuple(sorted(w for w in words if any(x.isdigit() for x in w)))
    return " ".join(w for w in words if not any(x.isdigit() for x in w)), codes


def bare(words: str, codes: tuple[str, ...], before: set[str], after: set[str]) -> str:
    """``words`` without the phrases of decoration at either end; something stays, if it is only codes."""
    w = words.split()
    while True:
        for n in range(PHRASE, 0, -1):
            if len(w) >= n + (not codes):
                if " ".join(w[:n]) in before:
                    w = w[n:]
                    break
                if " ".join(w[-n:]) in after:
                    w = w[:-n]
                    break
        else:
            return " ".join(w)


def allowed(length: int) -> int:
    """Edits allowed in a text of so many characters."""
    return 0 if length < 5 else 1 if length < 9 else MOST


@dataclass
class Entry:
    entry_id: int
    kind: str
    names: list[str]  # the canonical one first


class Matcher:
    """The reference list of one block, ready to be searched."""

    def __init__(self, entries: list[Entry]):
        forms: dict[tuple[str, str, tuple[str, ...]], set[int]] = defaultdict(set)
        initials: dict[tuple[str, str, tuple[str, ...]], set[int]] = defaultdict(set)
        for e in entries:
            for n, name in enumerate(e.names):
                words, codes = clean(name)
                if not words and not codes:
                    continue
                for path in self.paths(words) if n == 0 and words else [words]:
                    forms[e.kind, path, codes].add(e.entry_id)
                if n == 0 and not codes and words.count(" ") >= 2:
                    short = "".join(w[0] for w in words.split() if w not in SMALL_WORDS)
                    initials[e.kind, short, ()].add(e.entry_id)
                    for path in (f"{short} {words.split()[0]}", f"{words.split()[0]} {short}"):
                        forms[e.kind, path, codes].add(e.entry_id)
                if n == 0 and codes:
                    initials[e.kind, "", codes].add(e.entry_id)
        # initials or a bare code name an entry if no other entry has them; they must agree exactly
        alone = {key: ids for key, ids in initials.items() if len(ids) == 1 and key not in forms and len(key[1] or " ".join(key[2])) >= 3}
        self.items = sorted({*forms, *alone})
        self.ids = [sorted(forms.get(x) or alone[x]) for x in self.items]
        self.exactly = [x in alone for x in self.items]
        # codes are part of the root, so they agree exactly
        self.trie = Trie([(self._root(kind, codes), form, i) for i, (kind, form, codes) in enumerate(self.items)])
        self.automaton = Automaton(MOST)

    @staticmethod
    def _root(kind: str, codes: tuple[str, ...]) -> str:
        return "\t".join((kind, *codes))

    @staticmethod
    def paths(words: str) -> set[str]:
        """The forms under which a name is entered."""
        w = words.split()
        out = {words, words.replace(" ", "")}
        if len(w) > 1:
            out |= {" ".join([*w[1:], w[0]]), " ".join([w[-1], *w[:-1]]), " ".join(x for x in w if x not in SMALL_WORDS)}
        if len(w) == 2:
            out.add(f"{w[0][0]} {w[1]}")
        return out - {""}

    def match(self, texts: list[tuple[str, str]], before: list[set[str]] | None = None, after: list[set[str]] | None = None) -> list[list[tuple[int, int]]]:
        """For each (kind, text) all (entry_id, distance) within the allowed distance, nearest first. ``before``
        and ``after``: for each text the decoration that it may begin or end with."""
        asked, where = [], []
        for i, (kind, text) in enumerate(texts):
            words, codes = clean(text)
            if before or after:
                words = bare(words, codes, before[i] if before else set(), after[i] if after else set())
            if (words or codes) and (root := self._root(kind, codes)) in self.trie.roots:
                asked.append((root, words)), where.append(i)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for q, hits in self._search(asked, False).items():
            out[where[q]] = hits
        rest = [q for q, i in enumerate(where) if not out[i]]
        for q, hits in self._search([asked[q] for q in rest], True).items():
            out[where[rest[q]]] = hits
        return out

    def _search(self, asked: list[tuple[str, str]], shortened: bool) -> dict[int, list[tuple[int, int]]]:
        limits = [min(allowed(len(words)), 1 if shortened else MOST) for _, words in asked]
        best: dict[int, dict[int, int]] = defaultdict(dict)
        for q, v, d in zip(*(x.tolist() for x in self.trie.search(self.automaton, asked, limits, shortened))):
            form = self.items[v][1]
            if d and self.exactly[v] or not (self._abbreviates if shortened else self._even)(asked[q][1], form, d):
                continue
            for e in self.ids[v]:
                best[q][e] = min(d, best[q].get(e, d))
        return {q: sorted(hits.items(), key=lambda x: (x[1], x[0])) for q, hits in best.items()}

    @staticmethod
    def _even(text: str, form: str, gap: int) -> bool:
        """No short word takes more than its share of the edits."""
        a, b = text.split(), form.split()
        if gap < 2 or len(a) != len(b):
            return True
        return all(x == y or edit_distance(x, y, MOST) <= max(1, len(y) // 4) for x, y in zip(a, b))

    @staticmethod
    def _abbreviates(text: str, form: str, gap: int) -> bool:
        """Word by word: the same, begun, or one edit away in a word of six letters; a single letter needs
        the first word before it."""
        a, b = text.split(), form.split()
        if len(a) != len(b) or len(a) < 2:
            return False
        edits = 0
        for t, w in zip(a, b):
            if t != w and not (w.startswith(t) and (len(t) >= 3 or (len(t) == 1 and a[0] == b[0]))):
                edits += edit_distance(t, w, 1) if len(w) >= 6 else 2
        return edits <= 1


def entries_of(rows: list) -> list[Entry]:
    """Rows (entry_id, kind, canonical, aliases) as entries; a row without id, kind or name is left out."""
    return [Entry(r[0], r[1], [r[2], *(a for a in (r[3] or []) if a)]) for r in rows if r[0] is not None and r[1] is not None and r[2]]


def _cleaned(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``words`` and ``codes`` of a text, the codes joined by blanks."""
    schema = T.StructType([*df.schema.fields, T.StructField("words", T.StringType()), T.StructField("codes", T.StringType())])
    at = df.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [clean(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([w for w, _ in both], pa.string()), pa.array([" ".join(c) for _, c in both], pa.string())], names=schema.names)

    return df.mapInArrow(work, schema)


def _rests(words: str = "w"):
    """(before, after, rest) of an array of words, for phrases of up to PHRASE words at one end or both."""
    size = F.size(words)
    cuts = [(i, j) for i in range(PHRASE + 1) for j in range(PHRASE + 1) if i + j]
    part = lambda at, n, name: F.array_join(F.slice(words, at, n), " ").alias(name)
    # two phrases with nothing but a code between them are one
    one = lambda i, j: F.when((size > i + j) | ((size == i + j) & F.lit(not (i and j))), F.struct(part(1, F.lit(i), "before"), part(size - j + 1, F.lit(j), "after"), part(i + 1, size - i - j, "rest")))
    return F.filter(F.array(*(one(i, j) for i, j in cuts)), lambda x: x.isNotNull())


def decorations(texts: DataFrame, listed: DataFrame, beside: int = BESIDE) -> DataFrame:
    """(kind, side, affix): phrases before or after the whole forms of at least ``beside`` names, none of
    whose words is in a name of the kind.

    ``texts``: distinct (kind, text, words, codes); ``listed``: (id, kind, name, aliases). Counted over all texts.
    """
    forms = listed.where("id is not null and kind is not null and name <> ''").select("kind", "name", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")))).alias("form")).where("form <> ''")
    forms = _cleaned(_cleaned(forms, "name").select("kind", F.col("words").alias("named"), "form"), "form").select("kind", "named", F.col("words").alias("rest"), "codes").distinct()
    w = F.filter(F.split("words", " "), lambda x: x != "")
    ends = texts.select("kind", "codes", w.alias("w")).select("kind", "codes", F.explode(_rests()).alias("e")).select("kind", "codes", "e.*").where("rest <> '' or codes <> ''")
    met = ends.join(forms, ["kind", "rest", "codes"]).select("kind", "named", F.explode(F.array(*(F.struct(F.lit(x).alias("side"), F.col(x).alias("affix")) for x in ("before", "after")))).alias("e")).select("kind", "named", "e.*").where("affix <> ''")
    # counted map-side before anything is shuffled
    met = met.groupBy("kind", "side", "affix").agg(F.count_distinct("named").alias("n")).where(F.col("n") >= beside)
    own = forms.select("kind", F.explode(F.split("named", " ")).alias("word")).union(forms.select("kind", F.explode(F.split("rest", " ")))).distinct()
    spoilt = met.select("kind", "affix", F.explode(F.split("affix", " ")).alias("word")).join(own, ["kind", "word"], "left_semi").select("kind", "affix").distinct()
    return met.join(spoilt, ["kind", "affix"], "left_anti").select("kind", "side", "affix")


def _with_decoration(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``texts`` (kind, text, words, codes) with the arrays ``before`` and ``after``: which phrases of
    ``known`` a text contains, anywhere, as each may come to an end when others are taken off."""
    w = F.split("words", " ")
    windows = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(PHRASE)), lambda n: F.transform(F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(w, i, n), " "))))
    held = texts.select("kind", "text", F.explode(F.array_distinct(windows)).alias("affix")).join(known, ["kind", "affix"])
    of = lambda side: F.collect_set(F.when(F.col("side") == side, F.col("affix"))).alias(side)
    return texts.join(held.groupBy("kind", "text").agg(of("before"), of("after")), ["kind", "text"], "left")


def match_texts(texts: DataFrame, kind_col: str, text_col: str, vocab: DataFrame, vocab_id: str = "entry_id", vocab_kind: str = "entity_kind", vocab_name: str = "canonical", vocab_aliases: str = "aliases", beside: int | None = BESIDE) -> DataFrame:
    """(kind, text, entry_id, distance): for each distinct kind and text all entries within the allowed
    distance, found through the trie; a text that names none has no row here.

    Null kinds and null texts are left out; empty texts and texts of decoration alone name nothing. Other
    columns are ignored. An entry is found under its kind only. Repeated entries count once. An empty
    list finds nothing. The list goes to the workers as rows in blocks of BLOCK entries, so a block's size
    is bounded and a list of any length is searched whole; the workers build the tries. ``beside`` is how many names
    a phrase must stand beside to be taken off as decoration; None takes nothing off.
    """
    spark = texts.sparkSession
    work_ = Workspace(spark)
    asked = texts.select(F.col(kind_col).alias("kind"), F.col(text_col).alias("text")).where("kind is not null and text is not null").distinct()
    listed = vocab.select(F.col(vocab_id).cast("long").alias("id"), F.col(vocab_kind).alias("kind"), F.col(vocab_name).alias("name"), F.col(vocab_aliases).alias("aliases")).distinct()
    schema = T.StructType([asked.schema["kind"], asked.schema["text"], T.StructField("entry_id", T.LongType()), T.StructField("distance", T.IntegerType())])
    if beside is None:
        asked = asked.withColumns({"before": F.array().cast("array<string>"), "after": F.array().cast("array<string>")})
    else:
        cleaned = work_.keep(_cleaned(asked, "text"))
        asked = _with_decoration(cleaned, work_.keep(decorations(cleaned, listed, beside))).select("kind", "text", "before", "after")
    n = listed.count()
    parts = max(1, -(-n // BLOCK))
    if parts > 1:
        asked = work_.keep(asked)
    out = None
    for part in range(parts):
        block = listed if parts == 1 else listed.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in block.collect()]))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(*shared.value)
            for batch in batches:
                for start in range(0, batch.num_rows, 4000):
                    kinds, words, before, after = (c.to_pylist() for c in batch.slice(start, 4000).columns)
                    rows = list(zip(kinds, words))
                    hits = matcher.match(rows, [set(x or ()) for x in before], [set(x or ()) for x in after])
                    flat = [(*rows[i], e, d) for i, found in enumerate(hits) for e, d in found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat) if flat else ([], [], [], []), (pa.string(), pa.string(), pa.int64(), pa.int32()))], names=schema.names)

        found = asked.mapInArrow(work, schema)
        out = found if out is None else out.unionAll(found)
    return out


def near_forms(texts: DataFrame, kind_col: str, text_col: str, forms: DataFrame) -> DataFrame:
    """(kind, words, entry_id, distance): for each distinct kind and text all entries with a form within the
    distance allowed for its length, the text and the forms taken as they are.

    ``forms``: (entry_id, kind, form). Nulls and empty texts are left out. A form longer than any text allows
    finds nothing. The forms go to the workers in blocks of BLOCK.
    """
    spark = texts.sparkSession
    asked = Workspace(spark).keep(texts.select(F.col(kind_col).alias("kind"), F.col(text_col).alias("words")).where("kind is not null and words <> ''").distinct())
    listed = forms.where("entry_id is not null and kind is not null and form <> ''").select("kind", "form", F.col("entry_id").cast("long").alias("entry_id")).distinct()
    schema = T.StructType([*asked.schema.fields, T.StructField("entry_id", T.LongType()), T.StructField("distance", T.IntegerType())])
    parts = max(1, -(-listed.count() // BLOCK))
    out = None
    for part in range(parts):
        shared = spark.sparkContext.broadcast([tuple(r) for r in listed.where(F.pmod(F.xxhash64("entry_id"), F.lit(parts)) == part).collect()])

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie, automaton = Trie(sorted(shared.value)), Automaton(MOST)
            for batch in batches:
                for start in range(0, batch.num_rows, 4000):
                    rows = list(zip(*(c.to_pylist() for c in batch.slice(start, 4000).columns)))
                    best: dict[tuple[int, int], int] = {}
                    for q, e, d in zip(*(x.tolist() for x in trie.search(automaton, rows, [allowed(len(w)) for _, w in rows]))):
                        best[q, e] = min(d, best.get((q, e), d))
                    flat = [(*rows[q], e, d) for (q, e), d in best.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat) if flat else ([], [], [], []), (pa.string(), pa.string(), pa.int64(), pa.int32()))], names=schema.names)

        found = asked.mapInArrow(work, schema)
        out = found if out is None else out.unionAll(found)
    return out.groupBy("kind", "words", "entry_id").agg(F.min("distance").alias("distance"))


_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, rows: list[tuple]) -> Matcher:
    """One trie for each worker process and broadcast list; the last few are kept."""
    if key not in _MATCHERS:
        while len(_MATCHERS) >= 4:
            _MATCHERS.pop(next(iter(_MATCHERS)))
        _MATCHERS[key] = Matcher(entries_of(sorted(rows, key=lambda r: (r[0] is None, r[0]))))
    return _MATCHERS[key]


def best_entries(matches: DataFrame) -> DataFrame:
    """(kind, text, entry_id, distance): the one nearest entry of a text; a text that several entries
    are equally near to names none of them."""
    near = matches.groupBy("kind", "text").agg(F.collect_set(F.struct("distance", "entry_id")).alias("all"))
    first = F.array_min("all")
    ties = F.size(F.filter("all", lambda x: x["distance"] == F.array_min("all")["distance"]))
    return near.where(ties == 1).select("kind", "text", first["entry_id"].alias("entry_id"), first["distance"].alias("distance"))
