"""Text garbled by a wrong decoding: code-page swaps as substitution ciphers per source, learned by EM.

A unit of a cipher is one character, as a swap of single-byte pages leaves it, or a run of characters that may be UTF-8 read in
a single-byte page, once or repeatedly. What a unit may stand for is given by the pages; whether it stands for that or
for itself is decided per source by EM against the bigrams of the corpus, for both sorts alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import staged

#: Pages in which UTF-8 may have been read, and single-byte swaps (written in, read as) among the candidates of EM.
READ_AS = ("cp1252", "cp437", "mac_roman", "cp1251", "cp1250", "koi8_r", "cp850")
SWAPS = tuple((w, r) for w in ("cp1252", "cp1250", "cp1251", "koi8_r", "mac_roman", "cp437", "cp850", "cp866", "iso8859_2") for r in ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r") if w != r)
#: A unit is mapped if the posterior of its letter reaches this, and each occurrence gains that many nats on average.
POSTERIOR, GAIN = 0.9, 2.3
IDENTITY = 0.95
#: Number of the reading "UTF-8 read in a single-byte page" among the swaps.
UTF8 = len(SWAPS)
ALPHA, BACKOFF, OVERLAP = 0.05, 0.004, 0.05


def _page(name: str) -> dict[int, str]:
    """Byte to character; bytes that a page leaves open stay the control character of that number."""
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


_PAGES = {p: _page(p) for p in {*READ_AS, *(w for w, _ in SWAPS)}}
_BACK = {p: {c: b for b, c in t.items()} for p, t in _PAGES.items()}
# latin-1 readings keep the bytes 80 to 9f as control characters beside the letters of cp1252
for _b in range(128, 160):
    _BACK["cp1252"].setdefault(chr(_b), _b)


def _class(chars: list[str]) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


def _sequence(page: str, long: bool) -> re.Pattern:
    of = lambda lo, hi: _class([c for c, b in _BACK[page].items() if lo <= b <= hi])
    cont = of(0x80, 0xBF)
    return re.compile(f"{of(0xE0, 0xEF)}{cont}{cont}|{of(0xF0, 0xF4)}{cont}{cont}{cont}" if long else f"{of(0xC2, 0xDF)}{cont}")


#: Long sequences of all pages come first, as their ends look like short sequences of other pages.
_SEQ = [(p, _sequence(p, long)) for long in (True, False) for p in READ_AS]
_ANY_HIGH = re.compile(r"[^\x00-\x7f]")
#: What no known page swap restores: replacement characters, lone control characters, leads whose rest became "?".
_LOST = re.compile("�|[\x80-\x9f]|â\\?\\?|â€\\?|(?<=[a-zß-ÿ©¤¶¼±³])[ÂÃÄÅ]\\?|[ÃÄÅÂ]\\?(?=[a-zß-ÿ])|Ã¢[â€?]|â[€‰‚†ˆ]|(?<![^\\W\\d_])ï¿½")
_PUNCT = set("«»“”„‘’‚…–—")


def _plausible(c: str) -> bool:
    """Whether a decoded character can be meant: letters of living alphabets, marks of print, mathematics, boxes."""
    o, cat = ord(c), unicodedata.category(c)
    if cat in ("Cc", "Cn", "Co", "Cs", "Cf"):
        return o == 0xFEFF
    if o < 0x180:
        return o >= 0xA0
    if 0x218 <= o <= 0x21B or 0x386 <= o < 0x3D0 or o in (0x401, 0x451) or 0x410 <= o <= 0x44F or 0x490 <= o <= 0x491:
        return True
    return 0x2010 <= o < 0x2045 or 0x20A0 <= o < 0x2800 or 0x3000 <= o < 0xA000 or 0xAC00 <= o < 0xD7A4 or 0xFB00 <= o < 0xFB07 or o >= 0x1F300


def _undo(page: str, m: re.Match, text: str) -> str:
    s, back = m.group(), _BACK[page]
    try:
        c = bytes(back[x] for x in s).decode("utf-8")
    except UnicodeDecodeError:
        return s
    if not _plausible(c) and not (page == "cp1252" and "\x80" <= c <= "\x9f"):
        return s  # a control character may be half of text that was damaged twice; alone it counts as lost
    letters = all(unicodedata.category(x) in ("Lu", "Ll", "Lo") for x in s)
    if page != "cp1252" and letters and ord(c) >= 0x3000:
        return s
    if page in ("cp1250", "koi8_r", "cp850") and letters and not 0x2010 <= ord(c) < 0x2045:
        # letters only: the second is a capital within a word, as no writer has it
        after = text[m.end() : m.end() + 1]
        if page != "cp1250" or not (s[1].isupper() and after.isascii() and after.islower()):
            return s
    if page == "cp1251":
        if ord(c) >= 0x3000 or all("А" <= x <= "я" for x in s):
            return s
        # in Cyrillic prose a capital before a closing quotation mark is what it seems
        before = text[max(0, m.start() - 1) : m.start()]
        if len(s) == 2 and s[1] in "»”" and (not before or before.isspace() or before in "«“„" or "А" <= before <= "Я"):
            return s
    return c


def repair_sequences(text: str, most: int = 12) -> tuple[str, int]:
    """(text, count): UTF-8 that was read in a single-byte page, undone page by page until nothing is left to undo.

    After every repair the pages are tried from the first again, so text damaged twice is undone twice.
    """
    total = 0
    if not _ANY_HIGH.search(text):
        return text, 0
    for _ in range(most):
        for page, pattern in _SEQ:
            done = 0

            def undo(m: re.Match, page=page, whole=text) -> str:
                nonlocal done
                c = _undo(page, m, whole)
                done += c != m.group()
                return c

            text = pattern.sub(undo, text)
            if done:
                total += done
                break
        else:
            break
    return text, total


@lru_cache(maxsize=4096)
def _swapped(u: str) -> dict[int, str]:
    """Swap number to the letter that the character stands for under it."""
    out: dict[int, str] = {}
    for z, (w, r) in enumerate(SWAPS):
        b = _BACK[r].get(u)
        if b is not None:
            c = _PAGES[w][b]
            if c != u and _plausible(c) and (c.isalpha() or c in _PUNCT or c in "€°±§£©®¿¡"):
                out[z] = c
    return out


_RUN = re.compile(r"[^\x00-\x7f]+")
#: A longer run is taken apart into its sequences, so that the units of a source are bounded by the pages.
LONGEST_RUN = 8
_PIECE = re.compile("|".join(r.pattern for _, r in _SEQ) + "|[^\x00-\x7f]")


@lru_cache(maxsize=200_000)
def _undone(before: str, run: str, after: str) -> str:
    """What a run stands for if its sequences are UTF-8, between its neighbours; the run itself if they can't be."""
    out = repair_sequences(before + run + after)[0]
    return out[len(before) : len(out) - len(after)]


def _units(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(position, before, unit, after) of the runs, and of the pieces of long runs."""
    for m in _RUN.finditer(text):
        at, end = m.span()
        parts = [(at, m.group())] if end - at <= LONGEST_RUN else [(at + x.start(), x.group()) for x in _PIECE.finditer(m.group())]
        for i, u in parts:
            yield i, text[i - 1 : i], u, text[i + len(u) : i + len(u) + 1]


def _read(text: str, cipher: dict[str, str] | None = None) -> tuple[str, int]:
    """(text with every unit read as UTF-8 where it can be, or as ``cipher`` has it; units changed)."""
    out, at, n = [], 0, 0
    for i, p, u, q in _units(text):
        c = (_undone(p, u, q) if len(u) > 1 else u) if cipher is None else cipher.get(u, u) if len(u) > 1 else u
        if c != u:
            out += [text[at:i], c]
            at, n = i + len(u), n + 1
    return ("".join([*out, text[at:]]), n) if n else (text, 0)


def _symbol(c: str) -> str:
    return "0" if c.isdigit() else " " if c.isspace() else c


def _pairs(text: str) -> Counter:
    """Counts of neighbouring symbols of which one is not ASCII, of overlapping pairs, and ("", c) of symbols themselves."""
    n: Counter = Counter()
    for i in (m.start() for m in _ANY_HIGH.finditer(text)):
        c = _symbol(text[i])
        before = _symbol(text[i - 1]) if i else " "
        after = _symbol(text[i + 1]) if i + 1 < len(text) else " "
        n[before, c] += 1
        if after.isascii():
            n[c, after] += 1
        n["", c] += 1
        n[before + c, after] += 1
    return n


#: Texts of ASCII alone hold no unit; they don't leave the JVM to be counted.
_HIGH = r"text RLIKE '[^\\x00-\\x7F]'"


def fields_of(papers: DataFrame) -> DataFrame:
    """(paper_id, source, field_name, text) of titles and texts; null ids and null fields are left out."""
    both = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in ("title", "text")])).alias("f")
    rows = papers.where("paper_id IS NOT NULL").select("paper_id", F.coalesce("extraction_source", F.lit("")).alias("source"), both)
    return rows.select("paper_id", "source", "f.field_name", "f.text").where("text IS NOT NULL")


def language_bigrams(fields: DataFrame) -> dict[tuple[str, str], int]:
    """Counts of neighbouring symbols, one of them not ASCII, over the whole corpus with runs read as UTF-8 where they can be.

    Overlapping pairs are counted too, so the table is bounded by the letters in use times the pairs beside them: some ten
    thousand entries for alphabets, more only for corpora in scripts of thousands of signs.
    """

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for pdf in parts:
            for t in pdf["text"]:
                n.update(_pairs(_read(t)[0]))
        if n:
            yield pd.DataFrame([(a, b, c) for (a, b), c in n.items()], columns=["a", "b", "n"])

    rows = fields.where(_HIGH).select("text").mapInPandas(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return {(r["a"], r["b"]): r["n"] for r in rows.collect()}


def _contexts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        n: Counter = Counter()
        for s, t in zip(pdf["source"], pdf["text"], strict=True):
            for _, p, u, q in _units(t):
                if len(u) > 1 and _undone(p, u, q) != u:
                    n[s, u, _symbol(p) if p else " ", _symbol(q) if q else " "] += 1
            t = _read(t)[0]
            for m in _ANY_HIGH.finditer(t):
                i = m.start()
                if t[i + 1 : i + 2] == "?":
                    continue  # half of what was lost
                n[s, t[i], _symbol(t[i - 1]) if i else " ", _symbol(t[i + 1]) if i + 1 < len(t) else " "] += 1
        if n:
            yield pd.DataFrame([(*k, c) for k, c in n.items()], columns=["source", "u", "p", "q", "n"])


def learn_source(stats: pd.DataFrame, big: dict[tuple[str, str], int], total_symbols: int, rounds: int = 6) -> list[tuple[str, str, float]]:
    """(unit, letter, posterior) of the units of one source that stand for another letter.

    EM over the units of a source: a unit is itself, or the letter that some page swap makes of it, or, for a run, what it is as
    UTF-8; the share of each of these in the source is learned. The likelihood
    of a letter is the expected count of (before, letter, after) under the language bigrams of all other sources,
    with the neighbours read under the same swap if that is likelier; the shares of the swaps within the source
    are learned from the posteriors, so units that share a page support each other.
    """
    own: Counter = Counter()
    for u, p, q, n in zip(stats["u"], stats["p"], stats["q"], stats["n"], strict=True):
        if len(u) > 1:
            continue
        own[p, u] += n
        own["", u] += n
        own[p + u, q] += n
        if q.isascii():
            own[u, q] += n

    def count(a: str, b: str) -> float:
        return max(0, big.get((a, b), 0) - own.get((a, b), 0))

    known: dict[tuple[str, str, str], float] = {}

    def likelihood(c: str, p: str, q: str) -> float:
        x = known.get((c, p, q))
        if x is None:
            x = known[c, p, q] = reckon(c, p, q)
        return x

    def chain(text: str, p: str, q: str) -> float:
        """Likelihood of several symbols in a row, as shares of all symbols so that rows of unlike length compare."""
        around = [p, *map(_symbol, text), q]
        return sum(likelihood(c, around[i], around[i + 2]) - every for i, c in enumerate(text))

    def reckon(c: str, p: str, q: str) -> float:
        # a letter that is common elsewhere may stand beside any other, as names have it
        alone = count("", c)
        free = ALPHA + BACKOFF * alone
        pairs = (count(p, c) + free) * (count(c, q) + free) / (alone + 20 * ALPHA)
        # pairs seen overlapping in this place count in full, pairs that only could overlap count little
        return math.log(count(p + c, q) + OVERLAP * pairs)

    every = math.log(total_symbols + 1e4)
    units = []
    by_unit: dict[str, list] = {}
    for u, p, q, n in zip(stats["u"], stats["p"], stats["q"], stats["n"], strict=True):
        by_unit.setdefault(u, []).append((p, q, n))
    for u, ctx in by_unit.items():
        total = float(sum(n for _, _, n in ctx))
        if len(u) > 1:
            c = _undone(ctx[0][0], u, ctx[0][1])
            if c != u:
                units.append((u, {UTF8: c}, sum(n * chain(u, p, q) for p, q, n in ctx), {UTF8: sum(n * chain(c, p, q) for p, q, n in ctx)}, total))
            continue
        swaps = _swapped(u)
        if not swaps:
            continue
        here = sum(n * likelihood(u, p, q) for p, q, n in ctx)
        plain = [x for x in ctx if x[0].isascii() and x[1].isascii()]
        beside = [x for x in ctx if not (x[0].isascii() and x[1].isascii())]
        ll: dict[int, float] = {}
        of_letter: dict[str, float | None] = {}
        for z, c in swaps.items():
            if c not in of_letter:
                alone = count("", c)
                # a letter stands nowhere more often than it occurs: with this it can't gain enough
                least = (here + GAIN * total) / total
                of_letter[c] = sum(n * likelihood(c, p, q) for p, q, n in plain) if alone and math.log(2 * alone + 1) >= least else None
            x = of_letter[c]
            if x is None:
                continue
            for p, q, n in beside:
                ps, qs = {p, "" if p.isascii() else _swapped(p).get(z, p)} - {""}, {q, "" if q.isascii() else _swapped(q).get(z, q)} - {""}
                x += n * max(likelihood(c, a, b) for a in ps for b in qs)
            ll[z] = x
        if ll:
            units.append((u, swaps, here, ll, total))
    share = np.full(len(SWAPS) + 1, (1 - IDENTITY) / 12)
    same = IDENTITY
    post: list[tuple[float, dict[str, float]]] = []
    for _ in range(rounds):
        got, kept = np.full(len(SWAPS) + 1, 0.02), 2.0
        post = []
        for _u, swaps, here, ll, _n in units:
            x = {z: v + math.log(share[z]) for z, v in ll.items()}
            x[-1] = here + math.log(same)
            top = max(x.values())
            w = {z: math.exp(v - top) for z, v in x.items()}
            norm = sum(w.values())
            kept += w[-1] / norm
            letters: dict[str, float] = {}
            for z, v in w.items():
                if z >= 0:
                    got[z] += v / norm
                    letters[swaps[z]] = letters.get(swaps[z], 0.0) + v / norm
            post.append((w[-1] / norm, letters))
        total = got.sum() + kept
        share, same = got / total, kept / total
    out = []
    for (u, swaps, here, ll, n), (_, letters) in zip(units, post, strict=True):
        c, r = max(letters.items(), key=lambda kv: (kv[1], kv[0]))
        best = max(v for z, v in ll.items() if swaps[z] == c)
        if r >= POSTERIOR and (best - here) / n >= GAIN:
            out.append((u, c, r))
    return out


def learn_ciphers(fields: DataFrame, big: dict[tuple[str, str], int]) -> DataFrame:
    """(source, cipher): for each source with swapped units the map from unit to letter."""
    shared = fields.sparkSession.sparkContext.broadcast(big)
    total = sum(n for (a, _), n in big.items() if a == "")
    stats = fields.where(_HIGH).select("source", "text").mapInPandas(_contexts, "source string, u string, p string, q string, n long").groupBy("source", "u", "p", "q").agg(F.sum("n").alias("n"))
    # a source's statistics are bounded by its units and the letters beside them, however many rows it has
    found = stats.groupBy("source").applyInPandas(
        lambda key, pdf: pd.DataFrame([(key[0], u, c) for u, c, _ in learn_source(pdf, shared.value, total)], columns=["source", "u", "c"]), "source string, u string, c string"
    )
    return found.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("u", "c"))).alias("cipher"))


def restore(text: str, cipher: dict[str, str] | None) -> tuple[str, int, int]:
    """(text, restored, lost): restored counts the repaired stretches, lost what stays damaged."""
    t, n = _read(text, cipher) if cipher else (text, 0)
    lost = len(_LOST.findall(t))
    if cipher:
        single = {u: c for u, c in cipher.items() if len(u) == 1}
        m = sum(t.count(u) for u in single)
        if m:
            t = t.translate({ord(u): c for u, c in single.items()})
            n += m
    return t, n, lost


def restore_fields(papers: DataFrame) -> DataFrame:
    """(paper_id, field_name, text, restored_text, n_restored, n_lost) for every field of every row.

    Fields without damage come back as they are, with zero counts. Empty texts have none. The bigrams and the
    ciphers are learned from all fields; the same tables with more rows give more evidence, never less work.
    """
    fields = fields_of(papers)
    big = language_bigrams(fields)
    ciphers = staged(learn_ciphers(fields, big), "ciphers")

    @F.pandas_udf("restored_text string, n_restored int, n_lost int")
    def run(text: pd.Series, cipher: pd.Series) -> pd.DataFrame:
        rows = [restore(t, dict(c) if c is not None else None) for t, c in zip(text, cipher, strict=True)]
        return pd.DataFrame(rows, columns=["restored_text", "n_restored", "n_lost"])

    joined = fields.join(ciphers, "source", "left").withColumn("r", run("text", "cipher"))
    return joined.select("paper_id", "field_name", "text", "r.restored_text", "r.n_restored", "r.n_lost")


def garbled_fields(restored: DataFrame) -> DataFrame:
    """(paper_id, field_name) of the fields with at least one garbled stretch, restorable or not."""
    return restored.where("n_restored + n_lost > 0").select("paper_id", "field_name").distinct()
