"""Linking the variants under which people and organisations are typed.

1. Tokens: a symmetric-delete index over the distinct tokens finds all pairs a small edit apart.
2. Candidates share a valid iD or a place, and a token; organisations share a token. All full tokens of the
   shorter name must agree, so it is enough to ask for its rarest one among all tokens of the other and all
   that may stand for them; frequent tokens meet only those that ask for them.
3. A pair is aligned token by token by optimal assignment, which permits initials, abbreviations,
   nicknames and small edits, and needs a second witness: the same iD or the same place.
4. Confirmed links are closed over to persons; pairs of a person's rows come out.

Which words of an affiliation name the place is learned from all affiliations: a word that is mostly beside a rarer
one says what kind of place it is, not which.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.automaton import edit_distance
from quillon.llm.components import connected_groups
from quillon.session import Workspace

# fixed values: common short forms of given names
NICKNAMES = {
    "alexander": "alex sasha xander sandy", "aleksandra": "ola sasha alex", "anthony": "tony", "benjamin": "ben benny", "christopher": "chris kit", "dmitri": "dima mitya", "ekaterina": "katya kate",
    "eleanor": "ellie nell nora", "elizabeth": "liz beth betty eliza lisa", "francisco": "fran paco pancho", "frederick": "fred freddie", "gabriel": "gabe", "giuseppe": "pino beppe", "isabella": "bella isa izzy", "jennifer": "jen jenny",
    "johannes": "hans hannes jan jo johan", "jonathan": "jon jonny", "katherine": "kate kathy katie kat", "margaret": "maggie meg peggy", "mateusz": "mat mati", "michael": "mike mick", "nicholas": "nick nico", "patricia": "pat patty trish",
    "rebecca": "becky becca", "robert": "bob rob bobby", "samantha": "sam", "susannah": "sue susan susie zanna", "theodore": "ted theo teddy", "thomas": "tom", "victoria": "vicky tori", "william": "bill will billy", "zuzana": "zuzka zuza",
    "richard": "rick dick", "james": "jim jimmy", "joseph": "joe", "daniel": "dan danny", "david": "dave", "edward": "ed ted ned", "matthew": "matt", "andrew": "andy drew", "stephen": "steve", "gregory": "greg", "lawrence": "larry",
    "maria": "mia", "jurgen": "jorg", "mariajose": "majo",
}
# fixed values: common given names of two words that are one name
COMPOUNDS = {("anna", "maria"), ("ana", "maria"), ("jean", "claude"), ("jean", "luc"), ("jean", "marie"), ("jean", "paul"), ("jean", "pierre"), ("jose", "luis"), ("jose", "maria"), ("juan", "carlos"), ("juan", "jose"), ("luis", "miguel"), ("maria", "jose"), ("maria", "luisa"), ("marie", "claire"), ("mary", "ann")}
# fixed values: titles that are no part of a name
TITLES = {"Dr", "DR", "dr", "Prof", "prof", "PhD", "PHD", "phd", "MSc", "Mr", "Mrs", "Ms", "The", "the", "THE"}
# fixed values: English nouns for organisations of people
ORGANISATION = {"team", "consortium", "initiative", "collective", "force", "group", "commons", "society", "network", "alliance", "project", "committee", "council", "association", "foundation", "federation"}
# fixed values: English words that never tell one institution from another; the others are learned
PLACE_WORDS = {"university", "institute", "department", "school", "college", "centre", "center", "laboratory", "of", "for", "the", "and", "at", "in"}
_FULL = {n: [full for full, short in NICKNAMES.items() if n in short.split()] for names in NICKNAMES.values() for n in names.split()}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ID = re.compile(r"(\d{4})[-‐–]?(\d{4})[-‐–]?(\d{4})[-‐–]?(\d{3}[\dXx])(?![\d])")


LONG = 32  # letters up to which a token's deletions are listed, and up to which its beginning stands for it


def plain(text: str) -> str:
    text = "".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x))
    return text.replace("ø", "o").replace("Ø", "O").replace("ß", "ss").replace("ł", "l").replace("Ł", "L")


def valid_id(typed: str | None) -> str | None:
    """The sixteen digits of an iD, however typed, or None: malformed, a placeholder or a wrong check digit."""
    found = _ID.search(typed or "")
    if not found:
        return None
    digits = "".join(found.groups()).upper()
    if len(set(digits[:15])) == 1:
        return None
    total = 0
    for d in digits[:15]:
        total = (total + int(d)) * 2
    check = (12 - total % 11) % 11
    return digits if digits[15] == ("X" if check == 10 else str(check)) else None


def name_tokens(name: str | None) -> list[str]:
    """Lower-case tokens without titles and marks; an initial is one letter; ``WR`` beside a name not in
    capitals is two initials; what stands in brackets is dropped."""
    text = re.sub(r"\([^)]*\)|\[[^]]*\]", " ", plain(name or ""))
    found = _TOKEN.findall(re.sub(r"[*_`]", "", re.sub("[‐‑–]", "-", text)))
    some_lower = any(not w.isupper() for w in found if len(w) > 3)
    out = []
    for w in found:
        low = w.lower().replace("'", "").replace("’", "")
        if w in TITLES:
            continue
        if w.isupper() and len(w) in (2, 3) and (some_lower or any(len(x) > 3 for x in found)) and not re.search(r"[AEIOUY]", w[1:] if len(w) == 3 else ""):
            out += list(low)
        elif out and (out[-1], low) in COMPOUNDS:
            out[-1] += low
        else:
            out.append(low)
    return out


def words_of(tokens: list[str]) -> list[str]:
    return [w for t in tokens for w in t.split("-")]


def is_short(tokens: list[str]) -> bool:
    """No word of four letters or more: the name is known by whole words, without edits."""
    return all(len(w) < 4 for w in words_of(tokens))


def is_organisation(tokens: list[str]) -> bool:
    """A token is a word for organisations or four letters or more of its beginning."""
    return any(t in ORGANISATION or (len(t) >= 4 and any(w.startswith(t) for w in ORGANISATION)) for t in tokens)


def place_words(affiliation: str | None) -> list[str]:
    """The distinct words of an affiliation without what stands in brackets, in order."""
    text = re.sub(r"\([^)]*\)", " ", plain(affiliation or "")).lower().replace("'", "").replace("’", "")
    return list(dict.fromkeys(re.findall(r"[^\W\d_]+", text)))


@lru_cache(maxsize=200_000)
def _token_cost(a: str, b: str) -> float:
    """0 for the same token up to 1 for a doubtful one; 9 where the tokens don't agree."""
    if a == b:
        return 0.0
    if "-" in a or "-" in b:
        return min(0.2 + _token_cost(x, y) for x in a.split("-") for y in b.split("-") if x and y)
    if len(a) > 1 and len(b) > 1:
        if {a, *_FULL.get(a, ())} & {b, *_FULL.get(b, ())}:
            return 0.1
        for nick, full in ((a, b), (b, a)):
            if any(len(f) >= 5 and edit_distance(f, full, 2) <= 1 + (len(f) >= 7) for f in _FULL.get(nick, ())):
                return 0.4
        short, long = sorted((a, b), key=len)
        gap = edit_distance(a, b, 2)
        if gap <= (2 if len(short) >= 7 else 1 if len(short) >= 4 else 0):
            return 0.3 * gap
        if long.startswith(short) and len(short) >= 4 and len(short) + 2 <= len(long) <= LONG:
            return 0.6
        # ae, oe, ue for an umlaut
        if re.sub("([aou])e", r"\1", a) == re.sub("([aou])e", r"\1", b):
            return 0.1
        return 9.0
    if a[0] == b[0] or (a if len(a) == 1 else b) in {full[0] for full in _FULL.get(a if len(a) > 1 else b, ())}:
        return 0.4
    return 9.0


def _assign(costs: list[list[float]]) -> list[int]:
    """The column of each row in the assignment of least total cost; rows are no more than columns. Each row
    is added along the cheapest augmenting path under potentials (Hungarian method)."""
    n, m = len(costs), len(costs[0])
    u, v, row_of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, before, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while row_of[j]:
            done[j] = True
            r, step, best = row_of[j], float("inf"), 0
            for k in range(1, m + 1):
                if not done[k]:
                    if (gap := costs[r - 1][k - 1] - u[r] - v[k]) < least[k]:
                        least[k], before[k] = gap, j
                    if least[k] < step:
                        step, best = least[k], k
            for k in range(m + 1):
                if done[k]:
                    u[row_of[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            j = best
        while j:
            row_of[j], j = row_of[before[j]], before[j]
    out = [0] * n
    for k in range(1, m + 1):
        if row_of[k]:
            out[row_of[k] - 1] = k - 1
    return out


def align(a: list[str], b: list[str]) -> tuple[float, list[tuple[int, int]]]:
    """The assignment of tokens of most matches and then least cost.

    Equal tokens are paired first. The rest is optimal by subsets; where both names have more than ten
    tokens left, by augmenting paths, as the subsets would grow out of hand.
    """
    if len(a) > len(b):
        cost, pairs = align(b, a)
        return cost, [(j, i) for i, j in pairs]
    same: list[tuple[int, int]] = []
    rest_b = list(range(len(b)))
    rest_a = []
    for i, x in enumerate(a):
        j = next((j for j in rest_b if b[j] == x), None)
        if j is None:
            rest_a.append(i)
        else:
            same.append((i, j))
            rest_b.remove(j)
    costs = {(i, j): c for i in rest_a for j in rest_b if (c := _token_cost(a[i], b[j])) < 9}
    if len(rest_a) > 10:
        chosen = _assign([[costs.get((i, j), 1000.0) for j in rest_b] for i in rest_a])
        found = [(i, rest_b[j]) for i, j in zip(rest_a, chosen) if (i, rest_b[j]) in costs]
        return sum(costs[x] for x in found), [*same, *found]
    # rows are the tokens of the one name; a state is the set of the other's tokens that are taken
    states: dict[frozenset, tuple[int, float, tuple]] = {frozenset(): (0, 0.0, ())}
    for i in rest_a:
        new = dict(states)
        for taken, (n, cost, pairs) in states.items():
            for j in rest_b:
                if (i, j) in costs and j not in taken:
                    key, value = taken | {j}, (n - 1, cost + costs[i, j], (*pairs, (i, j)))
                    if key not in new or value[:2] < new[key][:2]:
                        new[key] = value
        states = new
    _, cost, pairs = min(states.values(), key=lambda s: s[:2])
    return cost, [*same, *pairs]


def same_name(a: list[str], b: list[str]) -> bool:
    """May both be the name of one person or organisation?

    A token of four letters or more agrees in full and one more token agrees; of two names without any token
    so long, one of two letters or three. As many tokens agree in full
    as the name with fewer full tokens has: an initial doesn't answer for a family name. And what is left
    over does not clash: only one of the names may have initials or middle names that the other lacks. A hyphenated
    token agrees by one of its parts. An organisation's shorter name agrees throughout.
    """
    if not a or not b:
        return False
    cost, pairs = align(a, b)
    full = [(i, j) for i, j in pairs if min(len(a[i]), len(b[j])) >= 4]
    words = sum(min(len(a[i]), len(b[j])) > 1 for i, j in pairs)
    if not full and not (words and is_short(a) and is_short(b)) or len(pairs) < 2 and not (len(a) == len(b) == 1):
        return False
    if is_organisation(a) or is_organisation(b):
        return len(pairs) == min(len(a), len(b)) and len(pairs) >= 2 and abs(len(a) - len(b)) <= 1 and cost <= 0.6 + 0.4 * sum(min(len(a[i]), len(b[j])) == 1 for i, j in pairs)
    if words < min(sum(len(t) > 1 for t in a), sum(len(t) > 1 for t in b)):
        return False
    return not (len(pairs) < len(a) and len(pairs) < len(b)) and cost <= 1.6


def same_place(a: list[str] | None, b: list[str] | None) -> bool:
    """Every word of the place with fewer words is one of the other's, up to a small edit."""
    if not a or not b:
        return False
    few, many = sorted((a, b), key=len)
    return all(any(x == y or edit_distance(x, y, 2) <= (2 if min(len(x), len(y)) >= 7 else 1) for y in many) for x in few)


def _shorter(text):
    """What is left of a text after deleting each one of its letters."""
    size = F.length(text)
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, size)))


def _neighbours(work: Workspace, tokens: DataFrame, least: int = 4) -> DataFrame:
    """(token, other): each distinct token with itself and with every neighbour.

    Neighbours share what is left after symmetric deletion: of one letter from ``least`` letters on, of up
    to two from seven on. A token of more than LONG letters shares its first ten, its last ten or nine inner
    letters with any that is two edits away, so these stand for its deletions; tokens of up to two letters
    less have both. Two swapped letters are one
    edit to the alignment and two to levenshtein, so what swaps may explain stays; the alignment decides later.
    """
    tokens = work.keep(tokens.select("token").distinct())
    size = F.length("token")
    one = _shorter(F.col("token"))
    # a letter lies between the parts, so that no swap touches two of them
    ends = F.array(F.concat(F.lit("^"), F.substring("token", 1, 10)), F.concat(F.lit("$"), F.right(F.col("token"), F.lit(10))), *(F.concat(F.lit("~"), F.substring("token", 12 + shift, 9)) for shift in range(-2, 3)))
    near = F.concat(F.array("token"), F.when(size > LONG, ends).when(size >= 7, F.concat(one, F.flatten(F.transform(one, _shorter)))).otherwise(one))
    near = F.when(size.between(LONG - 1, LONG), F.concat(near, ends)).otherwise(near)
    index = tokens.where(size >= least).select("token", F.explode(F.array_distinct(near)).alias("key"))
    # the deletions are many times the tokens, by whose size Spark would broadcast them through the driver
    met = index.hint("merge").join(index.select("key", F.col("token").alias("other")), "key").where("token < other").select("token", "other")
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    gap = F.levenshtein("token", "other", 4)
    swapped = (gap > 2) & (F.levenshtein(letters("token"), letters("other"), 2) >= 0)
    pairs = work.keep(met.where(F.when(F.least(size, F.length("other")) < 7, gap.between(0, 2)).otherwise(gap.between(0, 2) | swapped)).distinct())
    both = pairs.unionAll(pairs.select(F.col("other").alias("token"), F.col("token").alias("other")))
    return tokens.select("token", F.col("token").alias("other")).unionAll(both)


def _profiles(work: Workspace, df: DataFrame, id_col: str, name_col: str, place_col: str, code_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(name_col).alias("name"), F.col(place_col).alias("place"), F.col(code_col).alias("code")).where("id is not null").distinct()
    strings = T.ArrayType(T.StringType())
    schema = T.StructType([rows.schema["id"], T.StructField("tokens", strings), T.StructField("site", strings), T.StructField("code", T.StringType()), T.StructField("org", T.BooleanType())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, places, codes = (c.to_pylist() for c in batch.columns)
            tokens = [name_tokens(x) for x in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.list_(pa.string())), pa.array(list(map(place_words, places)), pa.list_(pa.string())), pa.array(list(map(valid_id, codes)), pa.string()), pa.array(list(map(is_organisation, tokens)), pa.bool_())],
                names=schema.names,
            )

    parsed = work.keep(rows.mapInArrow(parse, schema).where("size(tokens) > 0"))
    return parsed.join(_places(work, parsed.select("site").distinct()), "site", "left").select("id", "tokens", "place", "seat", "code", "org")


def _places(work: Workspace, sites: DataFrame) -> DataFrame:
    """(site, place, seat): the words of each distinct affiliation that tell which place it is, and the rarest of them.

    A word is told apart by how many affiliations have it. One that in most of its affiliations stands beside a
    rarer word is general, and so is a rarer word of six letters or more that is one edit from such a word.
    """
    each = work.keep(sites.select("site", F.posexplode("site").alias("at", "word")))
    often = each.groupBy("word").agg(F.count("*").alias("n"))
    counted = work.keep(each.join(often, "word"))
    rare = counted.groupBy("site").agg(F.min("n").alias("least"))
    marked = counted.join(rare, "site").groupBy("word").agg(F.first("n").alias("n"), F.avg((F.col("n") == F.col("least")).cast("int")).alias("own"))
    general = work.keep(marked.where((F.col("own") < 0.5) | F.col("word").isin(sorted(PLACE_WORDS))).select("word", "n"))
    # misspelt general words
    index = lambda df, name: df.where(F.length("word") > 5).select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"), F.explode(F.array_distinct(F.concat(F.array("word"), _shorter(F.col("word"))))).alias("key"))
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    near = index(marked, "typed").hint("merge").join(index(general, "meant"), "key").where("n_typed < n_meant")
    near = near.where((F.levenshtein("typed", "meant", 1) >= 0) | ((F.levenshtein("typed", "meant", 2) == 2) & (letters("typed") == letters("meant")))).select(F.col("typed").alias("word"))
    telling = counted.join(general.select("word").unionAll(near).distinct(), "word", "left_anti")
    return telling.groupBy("site").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("place"), F.min(F.struct("n", "word"))["word"].alias("seat"))


def _alike(work: Workspace, tokens: DataFrame) -> DataFrame:
    """(token, other): each distinct token with itself and every token that may stand for it: a neighbour,
    a nickname or full form or a neighbour of that, a spelling without the e of an umlaut, a beginning of four letters or
    more of a word of up to LONG letters."""
    nicks = tokens.sparkSession.createDataFrame([(n, f) for n, full in _FULL.items() for f in full], "token string, full string")
    tokens = tokens.select("token").distinct()
    used = work.keep(tokens.join(nicks, "token"))
    near = _neighbours(work, tokens.unionAll(used.select(F.col("full").alias("token"))))
    near = work.keep(near)
    plain_form = F.regexp_replace("token", "([aou])e", "$1")
    spelt = tokens.where(F.col("token") != plain_form).select("token", plain_form.alias("key"))
    full = used.join(near.select(F.col("token").alias("full"), "other"), "full").select("token", "other").unionAll(used.join(used.select(F.col("token").alias("other"), "full"), "full").select("token", "other"))
    begun = tokens.where(F.length("token").between(6, LONG)).select("token", F.explode(F.transform(F.sequence(F.lit(4), F.length("token") - 2), lambda n: F.substring("token", F.lit(1), n))).alias("other"))
    known = tokens.select(F.col("token").alias("other"))
    one = full.unionAll(begun.hint("merge").join(known, "other", "left_semi").select("token", "other")).unionAll(spelt.join(known, F.col("key") == F.col("other")).select("token", "other")).unionAll(spelt.join(spelt.select(F.col("token").alias("other"), "key"), "key").select("token", "other"))
    return near.unionAll(one).unionAll(one.select(F.col("other").alias("token"), F.col("token").alias("other"))).distinct()


def link_names(df: DataFrame, id_col: str, name_col: str, place_col: str, code_col: str) -> DataFrame:
    """(id, person): every row id with a name, and the least id of the rows that stand for the same
    person or organisation. Ids that are linked with nothing are their own person.

    Null ids and names without a letter have no row. Names whose words are all under four letters meet at
    equal words of two letters or three; names of single letters alone, at none. A null place or iD is no
    witness. Malformed iDs, placeholders and wrong check digits count as null. Repeated rows count once; an id whose rows
    differ takes part with each of them. An empty table gives no rows. Other columns are ignored.
    """
    work = Workspace(df.sparkSession)
    rows = work.keep(_profiles(work, df, id_col, name_col, place_col, code_col))
    # rows with the same words are one profile, however many ids it has
    what = ["tokens", "place", "seat", "code", "org"]
    shapes = work.keep(rows.groupBy(what).agg(F.min("id").alias("pid")))

    words = F.array_distinct(F.flatten(F.transform("tokens", lambda t: F.split(t, "-"))))
    # a person goes by the words of four letters or more, or if there are none by any of two letters or more,
    # as organisations do
    least = F.when(F.col("org") | ~F.exists("words", lambda t: F.length(t) >= 4), 2).otherwise(4)
    # of an organisation's words those for organisations say nothing
    plain_word = F.when(F.col("org"), ~F.col("token").isin(sorted(ORGANISATION))).otherwise(F.lit(True))
    spoken = shapes.withColumn("words", words).select("pid", *what, "words", F.explode(F.filter("words", lambda t: F.length(t) >= least)).alias("token")).where(plain_word)
    alike = work.keep(_alike(work, spoken.select("token")))
    # places of any length may be an edit apart
    sites = work.keep(_neighbours(work, shapes.where("place is not null").select(F.explode("place").alias("token")), least=1)).select(F.col("token").alias("seat"), F.col("other").alias("site"))

    # what a row asks for: its rarest word; of an organisation the two rarest, as one of them may be an initial elsewhere
    often = spoken.groupBy("token").agg(F.count("*").alias("n"))
    ranked = spoken.join(often, "token").groupBy("pid", "org").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
    rarest = ranked.select("pid", F.transform(F.slice("t", F.lit(1), F.when(F.col("org"), 2).otherwise(1)), lambda x: x["token"]).alias("rare"))
    # of a hyphenated token every part, as one of them may stand alone
    parts = F.array_union("rare", F.flatten(F.filter(F.transform("tokens", lambda t: F.split(t, "-")), lambda p: F.arrays_overlap(p, F.col("rare")))))
    asking = shapes.join(rarest, "pid").select("pid", *what, F.explode(parts).alias("word"))
    # what it is found by: every word and all that may stand for it
    finding = spoken.join(alike, "token").withColumnRenamed("other", "word")
    single = ~F.col("org") & (F.size(F.filter("tokens", lambda t: F.length(t) > 1)) == 1) & (F.size("tokens") > 1)
    key = lambda *parts: F.xxhash64(*parts).alias("key")
    asked = (
        # iD and a token: people who share an iD with someone else's name don't meet
        asking.where("code is not null").select(key(F.lit("c"), "code", "word"), "pid")
        .unionAll(asking.where("not org").join(sites, "seat").select(key(F.lit("p"), "site", "word"), "pid"))
        .unionAll(asking.where("org").select(key(F.lit("o"), "word"), "pid"))
        # a word and initials may stand for an organisation
        .unionAll(asking.where(single).select(key(F.lit("s"), "word"), "pid"))
    ).distinct()
    found = (
        finding.where("code is not null").select(key(F.lit("c"), "code", "word"), "pid")
        .unionAll(finding.where("not org and place is not null").withColumn("site", F.explode("place")).select(key(F.lit("p"), "site", "word"), "pid"))
        .unionAll(finding.where("org").select(F.explode(F.array(key(F.lit("o"), "word"), key(F.lit("s"), "word"))).alias("key"), "pid"))
    ).distinct()
    met = asked.select("key", F.col("pid").alias("a")).join(found.select("key", F.col("pid").alias("b")), "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda s: shapes.select(F.col("pid").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in what))
    links = work.keep(_confirm(met.join(side("a"), "a").join(side("b"), "b")))

    nodes = shapes.select(F.col("pid").alias("src"), F.col("pid").alias("dst"))
    firm = links.where("firm").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = work.keep(connected_groups(nodes.unionAll(firm), "src", "dst"))
    # a row with initials alone joins the one group that it agrees with, not two that differ
    loose = links.where("not firm").select("a", "b").unionAll(links.where("not firm").select(F.col("b").alias("a"), F.col("a").alias("b")))
    ga, gb = groups.select(F.col("node").alias("a"), F.col("group_id").alias("ga")), groups.select(F.col("node").alias("b"), F.col("group_id").alias("gb"))
    bare = shapes.where(F.size(F.filter("tokens", lambda t: F.length(t) > 1)) == 1).select(F.col("pid").alias("a"))
    # nor does it move a group that has a full name already
    named = groups.join(shapes.select(F.col("pid").alias("node")).join(bare, F.col("node") == F.col("a"), "left_anti"), "node").select(F.col("group_id").alias("ga")).distinct()
    votes = loose.join(bare, "a").join(ga, "a").join(gb, "b").where("ga <> gb").join(named, "ga", "left_anti")
    chosen = votes.groupBy("ga").agg(F.min("gb").alias("low"), F.max("gb").alias("high")).where("low = high").select(F.col("ga").alias("src"), F.col("low").alias("dst"))
    # only the groups that join another are looked at again
    moved = connected_groups(chosen, "src", "dst").select(F.col("node").alias("group_id"), F.col("group_id").alias("to"))
    joined = groups.join(moved, "group_id", "left").select("node", F.coalesce("to", "group_id").alias("group_id"))
    found = rows.join(shapes.select(*(F.col(c).alias(f"s_{c}") for c in what), "pid"), [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in what]).select("id", "pid")
    by_id = found.join(joined.select(F.col("node").alias("pid"), F.col("group_id").alias("g")), "pid")
    # least id of all ids of the group, which may be less than any profile's least id
    return by_id.join(by_id.groupBy("g").agg(F.min("id").alias("person")), "g").select("id", "person").distinct()


def _confirm(pairs: DataFrame) -> DataFrame:
    """(a, b, firm) of the candidates that are the same; not firm where one has initials alone and no iD agrees."""
    columns = ["a", "b", "tokens_a", "tokens_b", "place_a", "place_b", "code_a", "code_b", "org_a", "org_b"]
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("firm", T.BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, ta, tb, pa_, pb, ca, cb, oa, ob in zip(*(c.to_pylist() for c in batch.columns)):
                if not same_name(ta, tb):
                    continue
                if oa != ob:  # an organisation may stand beside its word and initials
                    oa = sum(len(t) > 1 for t in (tb if oa else ta)) == 1
                    if not oa:
                        continue
                code, place = ca is not None and ca == cb, same_place(pa_, pb)
                if oa:
                    witness = place or pa_ is None or pb is None
                else:
                    witness = code or place
                if witness:
                    bare = [sum(len(t) > 1 for t in x) < 2 for x in (ta, tb)]
                    out.append((a, b, code or oa or not any(bare) or (all(bare) and sorted(ta) == sorted(tb))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.string(), pa.string(), pa.bool_()))], names=schema.names)

    return pairs.select(columns).mapInArrow(work, schema)


def name_pairs(df: DataFrame, id_col: str, name_col: str, place_col: str, code_col: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs within the rows of one person or organisation."""
    people = link_names(df, id_col, name_col, place_col, code_col)
    several = people.groupBy("person").agg(F.count("*").alias("k")).where("k > 1").select("person")
    held = people.join(several, "person")
    return held.select("person", F.col("id").alias("id_a")).join(held.select("person", F.col("id").alias("id_b")), "person").where("id_a < id_b").select("id_a", "id_b").distinct()
