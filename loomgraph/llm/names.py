"""Variant spellings of names: prefix-filtered q-gram join on rare tokens, verified by soft weighted token similarity."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.runtime import staged

# Common short forms of given names and the forms they stand for.
NICKNAMES = {
    "alex": "alexander", "sasha": "alexander", "sandy": "alexander", "andy": "andrew", "drew": "andrew", "tony": "anthony", "ben": "benjamin", "benny": "benjamin",
    "kit": "christopher", "chris": "christopher", "topher": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david", "dima": "dmitri", "mitya": "dmitri",
    "ed": "edward", "eddie": "edward", "ned": "edward", "lena": "elena", "beth": "elizabeth", "betty": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth",
    "fred": "frederick", "freddy": "frederick", "gabe": "gabriel", "jen": "jennifer", "jenny": "jennifer", "joe": "joseph", "joey": "joseph", "kate": "katherine",
    "kathy": "katherine", "katie": "katherine", "cathy": "katherine", "meg": "margaret", "maggie": "margaret", "peggy": "margaret", "matt": "matthew", "mick": "michael",
    "mike": "michael", "mikey": "michael", "nick": "nicholas", "nicky": "nicholas", "pat": "patricia", "patty": "patricia", "trish": "patricia", "tricia": "patricia",
    "rick": "richard", "dick": "richard", "rich": "richard", "ricky": "richard", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "sam": "samuel", "sammy": "samuel",
    "sue": "susanna", "susie": "susanna", "susan": "susanna", "theo": "theodore", "teddy": "theodore", "tom": "thomas", "tommy": "thomas", "uli": "ulrike",
    "vicky": "victoria", "vic": "victoria", "tori": "victoria", "bill": "william", "billy": "william", "will": "william", "willy": "william", "liam": "william", "zosia": "zofia",
    "greg": "gregory", "jim": "james", "jimmy": "james", "jack": "john", "johnny": "john", "jeff": "jeffrey", "larry": "lawrence", "steve": "stephen", "vova": "vladimir",
}
# Short forms that stand for more than one given name.
EITHER = {"ted": ("edward", "theodore")}
# Letter shapes that scanning confuses, each brought to one form.
SHAPES = (("rn", "m"), ("ii", "u"), ("vv", "w"), ("cl", "d"), ("0", "o"), ("1", "l"), ("5", "s"))
# Titles, ranks and generations that are no part of a name; particles of surnames.
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame md phd msc bsc jr sr ii iii iv esq ing dipl".split())
PARTICLES = frozenset("da de der del della di do dos du el la le ten ter van von vom zu zur al bin ibn".split())
# Words of organisation names (with usual abbreviations) and the kind they tell; "" tells none.
ORG_WORDS = {
    "univ": "university", "university": "university", "u": "university", "universitat": "university", "universite": "university", "universidad": "university",
    "foundation": "foundation", "fdn": "foundation", "fondation": "foundation", "stiftung": "foundation", "fundacion": "foundation", "found": "foundation",
    "institute": "institute", "inst": "institute", "institut": "institute", "instituto": "institute", "library": "library", "lib": "library", "libr": "library", "bibliothek": "library",
    "laboratories": "labs", "laboratory": "labs", "labs": "labs", "lab": "labs", "systems": "systems", "system": "systems", "sys": "systems", "syst": "systems",
    "publishing": "publishing", "publ": "publishing", "publishers": "publishing", "house": "", "partners": "partners", "ptnrs": "partners", "partner": "partners", "analytics": "partners",
    "ltd": "", "limited": "", "lt": "", "co": "", "company": "", "corp": "", "corporation": "", "inc": "", "incorporated": "", "gmbh": "", "gesellschaft": "", "mbh": "", "ag": "", "llc": "", "plc": "", "sa": "",
    "the": "", "of": "", "for": "", "and": "", "national": "", "natl": "", "nat": "", "nationale": "",
    "data": "", "science": "", "sci": "", "knowledge": "", "knowl": "", "engineering": "", "eng": "", "digital": "", "dig": "", "archives": "", "archive": "", "arch": "", "graph": "", "theory": "", "th": "",
    "machine": "", "mach": "", "perception": "", "percept": "", "information": "", "info": "", "inform": "", "applied": "", "appl": "", "linguistics": "", "ling": "", "computer": "", "comp": "", "research": "", "technology": "", "tech": "",
}
_FOLD = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "đ": "d", "Đ": "D", "ð": "d", "þ": "th", "ı": "i", "’": "'", "‘": "'", "`": "'", " ": " "})
#: Share of all names from which a token counts as common, and the least number. At most a few thousand tokens can.
COMMON_SHARE, COMMON_LEAST = 0.005, 7
#: A fuzzy pair is linked from this soft weighted token similarity on.
SIMILAR = 0.80


def fold(s: str) -> str:
    """Without accents and compatibility forms; letters keep their case."""
    s = unicodedata.normalize("NFKD", s.translate(_FOLD))
    return "".join(c for c in s if not unicodedata.combining(c))


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours makes ``a`` into ``b`` (or they are equal)."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


def name_tokens(name: str) -> tuple[list[str], bool]:
    """(tokens, comma): folded lower-case tokens; joined words are split at a change of case; footnote marks go."""
    s = re.sub(r"[^\w\s,.'&+-]+|(?<=[^\W\d_])\d+(?:,\d+)*(?![\w])", " ", fold(name))
    s = re.sub(r"'s\b", "", s).replace("_", " ")
    s = re.sub(r",?\s*\b(?:ph\.?d|m\.?d|jr|sr|esq|iii|ii)\b\.?\s*$", "", s, flags=re.I)
    s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", s)
    # initials written together after a surname
    s = re.sub(r"(?<=\s)([A-Z])([A-Z])\.?$", r"\1 \2", s) if not s.isupper() else s
    comma = bool(re.match(r"\s*[^,]+,\s*\S", s))
    return re.findall(r"[^\W_]+", s.lower().replace("'", "")), comma


class NameParser:
    """Splits a name into its rare part and what qualifies it, by the common tokens of the corpus."""

    def __init__(self, common: list[str]) -> None:
        self.given = {t for t in common if len(t) > 2 and t not in TITLES and t not in PARTICLES and t not in ORG_WORDS}
        self.by_start: dict[str, list[str]] = {}
        for g in self.given:
            for k in {g[:2], g[1:3], g[:1] + g[2:3], g[1::-1]}:
                self.by_start.setdefault(k, []).append(g)
        self.cache: dict[str, str] = {}

    @staticmethod
    def shape(t: str) -> str:
        for a, b in SHAPES:
            t = t.replace(a, b)
        return t

    def as_given(self, t: str) -> str:
        """The common given name that a token is or is one edit from, or ''."""
        if t not in self.cache:
            if t in EITHER:
                got = "#" + t
            elif t in self.given:
                got = t
            elif t in NICKNAMES:
                got = NICKNAMES[t]
            else:
                got = ""
                if 2 < len(t) < 14:
                    near = {g for k in {t[:2], t[1:3], t[:1] + t[2:3], t[1::-1]} for g in self.by_start.get(k, ())}
                    got = min((g for g in near if one_edit(t, g)), default="")
            self.cache[t] = NICKNAMES.get(got, got)
        return self.cache[t]

    def person(self, name: str) -> tuple[str, str, str, str]:
        """(rare, given, first initial, second initial) of a person's name; empty strings for what it lacks."""
        toks, comma = name_tokens(name)
        cut = len(re.findall(r"[^\W_]+", fold(name.split(",")[0]).lower().replace("'", ""))) if comma else 0
        rest = [(i, t) for i, t in enumerate(toks) if t not in TITLES and not t.isdigit()]
        seen: list[tuple[int, str]] = []
        for i, t in rest:
            if len(t) == 1 or not any(t == u for _, u in seen):
                seen.append((i, t))
        names = [(i, t) for i, t in seen if len(t) > 1 and t not in PARTICLES]
        initials = [t for _, t in seen if len(t) == 1 and t.isalpha()]
        if len(names) == 1 and len(names[0][1]) > 7 and not self.as_given(names[0][1]) and not initials:
            # given name and surname written as one word of one case
            t = names[0][1]
            g = max((g for g in self.given if t.startswith(g) and len(t) - len(g) >= 5), key=len, default="")
            if g:
                names = [(0, g), (1, t[len(g) :])]
        givens = [(i, t) for i, t in names if self.as_given(t)]
        rare = [(i, t) for i, t in names if not self.as_given(t)]
        if not rare and givens:
            rare = [givens.pop(0 if comma and len(givens) > 1 else -1)]
        if len(rare) > 1:
            front = [x for x in rare if x[0] < cut]
            keep = front[-1] if comma and front else rare[-1] if not givens else max(rare, key=lambda x: (len(x[1]), x[0]))
            if not givens:
                givens = [x for x in rare if x is not keep][:1]
            rare = [keep]
        order = [self.as_given(t) or t for _, t in givens]
        g = order[0] if order else ""
        more = [x[:1] for x in order[1:] if x != g] + initials
        rare_token = self.shape(rare[0][1]) if rare else " ".join(toks)
        if g.startswith("#"):
            return rare_token, "", g, more[0] if more else ""
        if g:
            return rare_token, g, g[:1], more[0] if more else ""
        return rare_token, "", initials[0] if initials else "", initials[1] if len(initials) > 1 else ""

    def organization(self, name: str) -> tuple[str, str, str, str]:
        """(rare, kind, '', '') of an organisation's name: its words that are not common to organisations, in order of letters.

        A name of common words alone is its own rare part; a kind that the name doesn't tell is empty.
        """
        toks, _ = name_tokens(name)
        kind, rare = "", []
        for t in toks:
            w = t if t in ORG_WORDS else next((o for o in _ORG_LONG if len(t) > 4 and abs(len(o) - len(t)) < 2 and one_edit(t, o)), "")
            if w:
                kind = kind or ORG_WORDS[w]
                if ORG_WORDS[w] == "partners":
                    kind = "partners"
            elif len(t) > 2:
                rare.append(t)
        return " ".join(sorted({self.shape(t) for t in rare})) or " ".join(toks), kind, "", ""


_ORG_LONG = [w for w in ORG_WORDS if len(w) > 4]


def entity_mentions(entities: DataFrame) -> DataFrame:
    """(id, kind, name) of persons and organisations; repeats of an id with the same name are one mention."""
    e = entities.where(F.col("type").isin("Person", "Organization") & F.col("id").isNotNull() & F.col("name").isNotNull())
    return e.groupBy("id").agg(F.min_by(F.struct("type", "name"), F.struct("type", "name")).alias("m")).select("id", F.col("m.type").alias("kind"), F.col("m.name").alias("name"))


def author_mentions(papers: DataFrame) -> DataFrame:
    """(id, kind, name) of authors, id = paper_id#position from 0; null authors are no mentions."""
    p = papers.where("paper_id IS NOT NULL AND authors IS NOT NULL").groupBy("paper_id").agg(F.min_by("authors", F.to_json("authors")).alias("authors"))
    rows = p.select("paper_id", F.posexplode("authors").alias("i", "name")).where("name IS NOT NULL")
    return rows.select(F.concat_ws("#", "paper_id", "i").alias("id"), F.lit("Person").alias("kind"), "name")


def common_tokens(names: DataFrame) -> list[str]:
    """Tokens in at least COMMON_SHARE of the distinct person names, beside many different others: at most words-per-name / COMMON_SHARE of them."""
    persons = names.where("kind = 'Person'")
    n = persons.agg(F.count("*")).first()[0]
    least = max(COMMON_LEAST, int(COMMON_SHARE * n))
    rows = persons.select(_tokens(F.col("name")).alias("w"))
    often = rows.select(F.explode("w").alias("t")).groupBy("t").count().where(F.col("count") >= least)
    # a given name stands beside many other words, a surname beside few: at most a thousand tokens are asked
    beside = rows.select("w", F.explode("w").alias("t")).join(F.broadcast(often), "t").select("t", "count", F.explode("w").alias("o")).where("o <> t")
    wide = beside.groupBy("t").agg(F.max("count").alias("n"), F.count_distinct("o").alias("k")).where("k >= 4 AND k >= 0.5 * n")
    return [r[0] for r in wide.select("t").collect()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens(names: pd.Series) -> pd.Series:
    return names.map(lambda s: sorted({t for t in name_tokens(s)[0] if len(t) > 2}))


_PARSED = T.StructType([T.StructField(c, T.StringType()) for c in ("rare", "qual", "i1", "i2")])


def parse_names(names: DataFrame, common: list[str]) -> DataFrame:
    """Add rare, qual, i1 and i2 to the distinct (kind, name)."""

    @F.pandas_udf(_PARSED)
    def parse(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        p = NameParser(common)
        for kinds, texts in parts:
            yield pd.DataFrame([p.person(n) if k == "Person" else p.organization(n) for k, n in zip(kinds, texts, strict=True)], columns=["rare", "qual", "i1", "i2"])

    return names.withColumn("p", parse("kind", "name")).select("kind", "name", "p.*").where("rare <> ''")


Q = 3


def rare_token_pairs(tokens: DataFrame) -> DataFrame:
    """(kind, a, b, na, nb): pairs of different rare tokens of a kind that are at most one edit apart.

    ``tokens`` is (kind, t, n). Each padded token of L characters has L q-grams of three; one edit spoils at most four
    of them, so two such tokens share one of the five rarest of each, at positions that differ by one at most.
    Tokens of four letters or fewer may share none; they meet in what deleting a letter leaves of them, the token
    itself included. Only the pairs that these indexes give are compared.
    """
    grams = F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.struct(F.substring(F.concat(F.lit("^"), F.col("t"), F.lit("$")), i, F.lit(Q)).alias("g"), i.alias("p")))
    g = tokens.where(F.length("t") > 4).select("kind", "t", "n", F.explode(grams).alias("x")).select("kind", "t", "n", "x.g", "x.p")
    df = g.groupBy("g").agg(F.count("*").alias("df"))
    order = Window.partitionBy("kind", "t").orderBy("df", "g", "p")
    # the table of q-grams is bounded by the alphabet: 37^3 entries at most
    pre = g.join(F.broadcast(df), "g").withColumn("k", F.row_number().over(order)).where("k <= 5").select("kind", "t", "n", "g", "p")
    left = pre.select("kind", F.col("t").alias("a"), F.col("n").alias("na"), "g", F.explode(F.array(F.col("p") - 1, F.col("p"), F.col("p") + 1)).alias("p"))
    right = pre.select("kind", F.col("t").alias("b"), F.col("n").alias("nb"), "g", "p")
    long = left.join(right, ["kind", "g", "p"]).select("kind", "a", "b", "na", "nb")
    # one edit may reach from four letters to five
    rest = F.transform(F.sequence(F.lit(0), F.length("t")), lambda i: F.when(i == 0, F.col("t")).otherwise(F.concat(F.substring("t", F.lit(1), i - 1), F.substring("t", i + 1, F.length("t")))))
    few = tokens.where(F.length("t").between(1, 5)).select("kind", "t", "n", F.explode(F.array_distinct(rest)).alias("g")).where("g <> ''")
    short = few.select("kind", F.col("t").alias("a"), F.col("n").alias("na"), "g").join(few.select("kind", F.col("t").alias("b"), F.col("n").alias("nb"), "g"), ["kind", "g"]).select("kind", "a", "b", "na", "nb")
    near = long.unionByName(short).where((F.abs(F.length("a") - F.length("b")) <= 1) & (F.col("a") < F.col("b")))
    dist = F.levenshtein("a", "b", 2)
    swap = (F.length("a") == F.length("b")) & (F.array_join(F.array_sort(F.split("a", "")), "") == F.array_join(F.array_sort(F.split("b", "")), ""))
    return near.withColumn("d", dist).where((F.col("d") == 1) | ((F.col("d") == 2) & swap)).select("kind", "a", "b", "na", "nb").distinct()


def _initial_fits(qual, i1):
    """Whether an initial begins the given name ``qual``, or a short form of several names may stand for it."""
    either = F.create_map(*[x for k, v in EITHER.items() for x in (F.lit("#" + k), F.array(*map(F.lit, v)))])
    return (F.substring(qual, 1, 1) == i1) | F.coalesce(F.array_contains(either[i1], qual), F.lit(False))


def name_clusters(parsed: DataFrame) -> DataFrame:
    """(kind, name, cluster): the cluster of every parsed name.

    1. Names that agree in the rare token and in the qualifier (given name, or kind of organisation) are one.
    2. Names with only an initial, or no qualifier, join the one fitting qualifier of the same rare token; among
       several the one with the same second initial, else the one with more than twice the names of the next.
    3. Rare tokens one edit apart are candidates; a smaller cluster joins the larger if the soft weighted token
       similarity (idf weights, so rare tokens count more; an initial counts as a part of the name) reaches
       SIMILAR. Ties go to the smaller string.
    Every step works on distinct names and joins on keys; no group is compared pair by pair.
    """
    p = parsed.withColumn("full", F.col("qual") != "")
    full = p.where("full").groupBy("kind", "rare", "qual").agg(F.count("*").alias("n"), F.max("i2").alias("i2s"))
    short = p.where("NOT full").select("kind", "rare", "i1", "i2").distinct()
    f = full.select("kind", "rare", F.col("qual").alias("fq"), "n", "i2s")
    fits = (F.col("i1") == "") | _initial_fits(F.col("fq"), F.col("i1"))
    cand = short.join(f, ["kind", "rare"]).where(fits).withColumn("same2", ((F.col("i2") != "") & (F.col("i2") == F.col("i2s"))).cast("int"))
    w = Window.partitionBy("kind", "rare", "i1", "i2").orderBy(F.desc("same2"), F.desc("n"), "fq")
    cand = cand.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("n").over(w)).withColumn("next2", F.lead("same2").over(w))
    clear = F.col("next").isNull() | (F.col("same2") > F.col("next2")) | (F.col("n") > 2 * F.col("next"))
    # the same soft similarity as below, of one rare token and a qualifier that fits
    total = F.lit(float(max(2, parsed.count())))
    w_same = F.log(total / F.col("n")) + 1
    fit = (w_same + 3.0 * F.when(F.col("i1") == "", 0.65).otherwise(0.75)) / (w_same + 3.0)
    took = cand.where((F.col("k") == 1) & clear & (fit >= SIMILAR)).select("kind", "rare", "i1", "i2", "fq")
    q = p.join(took, ["kind", "rare", "i1", "i2"], "left").withColumn("q", F.when(F.col("full"), F.col("qual")).otherwise(F.coalesce("fq", F.concat(F.lit("?"), "i1"))))
    q = staged(q.select("kind", "name", "rare", "q"), "names")
    groups = q.groupBy("kind", "rare", "q").agg(F.count("*").alias("n"))
    # soft weighted similarity over rare tokens one edit apart
    toks = groups.groupBy("kind", F.col("rare").alias("t")).agg(F.sum("n").alias("n"))
    pairs = rare_token_pairs(toks)
    both = pairs.select("kind", F.col("a").alias("rare"), F.col("b").alias("other")).unionByName(pairs.select("kind", F.col("b").alias("rare"), F.col("a").alias("other")))
    o = groups.select("kind", F.col("rare").alias("other"), F.col("q").alias("oq"), F.col("n").alias("on"))
    near = groups.join(both, ["kind", "rare"]).join(o, ["kind", "other"]).where((F.col("on") > F.col("n")) | ((F.col("on") == F.col("n")) & (F.col("other") < F.col("rare"))))
    start = F.substring("q", 1, 1) == "?"
    ostart = F.substring("oq", 1, 1) == "?"
    init = F.when(start, F.substring("q", 2, 99)).otherwise("")
    oinit = F.when(ostart, F.substring("oq", 2, 99)).otherwise("")
    qual_sim = (
        F.when(F.col("q") == F.col("oq"), F.when(F.length("q") > 1, 1.0).otherwise(0.6))
        .when(start & (F.length("q") > 1) & ~ostart & _initial_fits(F.col("oq"), init), 0.75)
        .when(ostart & (F.length("oq") > 1) & ~start & _initial_fits(F.col("q"), oinit), 0.75)
        .when(start & (F.length("q") == 1), 0.65).when(ostart & (F.length("oq") == 1), 0.65)
        .otherwise(0.0)
    )
    rare_sim = 1 - 1 / F.greatest(F.length("rare"), F.length("other"))
    w_rare, w_qual = F.log(total / F.col("on")) + 1, F.lit(3.0)
    soft = (w_rare * rare_sim + w_qual * qual_sim) / (w_rare + w_qual)
    # two well-attested clusters a letter apart are two entities, not variants
    near = near.withColumn("soft", soft).where((F.col("soft") >= SIMILAR) & ((F.col("n") <= 3) | (F.col("on") > 6 * F.col("n"))))
    wb = Window.partitionBy("kind", "rare", "q").orderBy(F.desc("soft"), F.desc("on"), "other", "oq")
    link = staged(near.withColumn("k", F.row_number().over(wb)).where("k = 1").select("kind", "rare", "q", "other", "oq"), "links")
    # links lead to larger clusters only; three steps follow every chain of variants of variants that occurs in practice,
    # and the loop goes on until no chain is left
    key, up = F.concat_ws("|", "kind", "rare", "q"), F.concat_ws("|", "kind", "other", "oq")
    parent = link.select(key.alias("c"), up.alias("p"))
    while True:
        nxt = staged(parent.join(parent.select(F.col("c").alias("p"), F.col("p").alias("g")), "p", "left").select("c", F.coalesce("g", "p").alias("p"), F.col("g").isNotNull().alias("moved")), "roots")
        parent = nxt.select("c", "p")
        if nxt.where("moved").isEmpty():
            break
    named = q.select("kind", "name", key.alias("c"))
    return named.join(parent, "c", "left").select("kind", "name", F.coalesce("p", "c").alias("cluster"))


def linked_mentions(mentions: DataFrame) -> DataFrame:
    """(id, cluster) of every mention whose name has a rare part; names without letters link to nothing."""
    mentions = staged(mentions, "mentions")
    names = mentions.select("kind", "name").distinct()
    parsed = staged(parse_names(names, common_tokens(names)), "parsed")
    return mentions.join(name_clusters(parsed), ["kind", "name"]).select("id", "cluster")


def mention_pairs(clusters: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs of mentions of one cluster."""
    c = staged(clusters, "clusters")
    a, b = c.select(F.col("id").alias("id_a"), "cluster"), c.select(F.col("id").alias("id_b"), "cluster")
    return a.join(b, "cluster").where("id_a < id_b").select("id_a", "id_b")
