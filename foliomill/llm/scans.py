"""Problem 4: damage in text from scanned pages, found and repaired into continuous paragraphs.

Lines are labelled header, body, break or notice by a hidden Markov model over layout features, fitted by Viterbi training from a first guess
that knows layout alone. Header lines between text go, a break ends a paragraph and a notice stands alone; divided words are joined, and
misread and run-together words are replaced by words of the corpus, found by hash joins of every word's likely originals with the vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, cut, fresh, in_bitmap, large, salted, sample_texts, spread, text_key

#: Texts of the bounded sample on which the line model is fitted, and words so common that they aren't looked up in each text.
SAMPLE, OFTEN = 4000, 1024
#: A word is a misreading of another that stands in so many times as many texts.
TIMES = 20
#: One text that holds a form says little about its share: the first counts for so many texts of the original instead of TIMES,
#: if the original (of run-together words the rarer part) has so many letters.
FIRST, LETTERS = 4, 5
#: A short part of run-together words must be so common: its texts against those of the commonest word, as one in so many.
COMMON = 20
#: Words up to so many letters are tried by all their originals, longer ones meet known words of nearly their length by SEGMENTS.
SHORT, SEGMENTS = 40, 5
#: Rows that are handed on at once.
ROWS = 50_000
#: What scans show, and what was printed.
MISREAD = (
    ("c", "e"), ("e", "c"), ("0", "o"), ("@", "a"), ("5", "s"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("1", "l"), ("1", "i"), ("ii", "u"), ("9", "g"), ("cl", "d"), ("b", "h"),
    ("h", "b"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("h", "li"), ("li", "h"), ("|", "l"), ("|", "i"), ("8", "b"), ("6", "b"), ("n", "h"), ("3", "e"), ("$", "s"), ("d", "cl"), ("nn", "m"),
)
WORD = r"[\p{L}\p{M}\p{N}@|$]+(?:[-’'][\p{L}\p{M}\p{N}@|$]+)*"
_WORD = re.compile(r"[^\W_|@$]*[^\W_](?:[|@$]*[^\W_]+)*|[|@$][^\W_]+")
DIVIDED = r"(?<![\p{L}\p{M}\p{N}@|’'])[\p{L}\p{M}\p{N}@|’']++[-‐¬=\x{AD}][ \t]*\n[ \t]*[\p{L}\p{M}]+"
_DIVIDED = re.compile(r"(?<![^\W_])([^\W_]++(?:[’'|@][^\W_]++)*+)([-‐¬=\xad])([ \t]*)\n[ \t]*([^\W\d_]+)")
STRAY = re.compile(r"(?<!\S)(?:[~^¦\\_`°·|]|\|_|`'|·:|\. ,)(?!\S)")
_QUOTE = re.compile(r"(?<!\S)[«»](?!\S)")
SPREAD = re.compile(r"(?<![^\s(“])(?:[a-zß-öø-ÿ] ){2,}[a-zß-öø-ÿ](?![^\s.,;:)”])|(?<!\S)(?:[^\W\d_] ){4,}[^\W\d_](?!\S)")
_PAGE = re.compile(r"\W*(?:(?:page|seite|página|pág|p|pg|s)\b\.?\s*)?(?:[\dlIO|]{1,4}|[ivxlc]{1,6})(?:\s*(?:of|/|von|de)\s*[\dlIO|]{1,4})?\W*", re.IGNORECASE)
_YEAR = re.compile(r"(?:19|20|l9|2O)[\dlO]{2}\s?[-–/]\s?[\dlO]{2,4}(?![\d.])")

HEADER, BODY, BREAK, NOTICE = range(4)
STATES = 4
#: How many values each feature of a line has.
SIZES = (3, 4, 3, 4, 3, 3, 3)
KIND, END, LENGTH, START, CAPITALS, AMID, ROOM = range(7)


def _goes_on(x: str) -> bool:
    """Whether a line begins as the middle of a sentence does; scripts without capitals always may."""
    return x[:1].isalpha() and not x[:1].isupper() and not x[:1].istitle()


def line_features(lines: list[str]) -> np.ndarray:
    """Layout features of each line: look (number of a page, title with years), end, length against the longest line, start, share of capitals,
    whether the lines around it would run on without it, and whether the first word of the next line had room on it."""
    longest = max((len(x) for x in lines), default=0) or 1
    bare = [x.strip() for x in lines]
    out = np.zeros((len(lines), len(SIZES)), np.int64)
    for i, x in enumerate(bare):
        words = re.findall(r"[^\W\d_]+", x)
        capital = sum(w[0].isupper() for w in words) / len(words) if words else 0.0
        year = list(_YEAR.finditer(x))
        if x and any(c.isdigit() or c in "ivxlc" for c in x) and len(x) <= 18 and _PAGE.fullmatch(x) and x[-1] not in ".,;:":
            out[i, KIND] = 1
        elif year and len(words) <= 12 and capital >= 0.6 and len(re.sub(r"[\W\dlI|]+", "", x[year[-1].end() :])) == 0 and not re.match(r"\W*©", x):
            out[i, KIND] = 2
        out[i, END] = 0 if not x else 1 if _ENDED.search(x) else 2 if x[-1] in "-‐¬=\xad" else 3
        out[i, LENGTH] = 0 if len(x) < 0.5 * longest else 1 if len(x) < 0.8 * longest else 2
        out[i, START] = 0 if not x else 1 if x[0].isupper() else 2 if x[0].islower() else 3
        out[i, CAPITALS] = 0 if capital < 0.4 else 1 if capital < 0.8 else 2
        if 0 < i < len(bare) - 1:
            out[i, AMID] = 2 if bare[i - 1] and not _ENDED.search(bare[i - 1]) and _goes_on(bare[i + 1]) else 1
        if i < len(bare) - 1:
            out[i, ROOM] = 2 if len(x) + 1 + len(bare[i + 1].split(None, 1)[0] if bare[i + 1] else "") <= longest else 1
    return out


_ENDED = re.compile(r"[.!?…。！？।؟;:][\"”’»)\]」]*$")


def _first_guess(f: np.ndarray) -> np.ndarray:
    """Labels by layout alone, where the training starts: lines of capitalised words or of a figure in the middle of a sentence are headers."""
    n = len(f)
    out = np.full(n, BODY)
    last = np.arange(n) == n - 1
    out[(f[:, END] == 1) & ((f[:, ROOM] == 2) | last)] = BREAK
    edge = last | (np.arange(n) == 0)
    out[edge & (n > 2) & (f[:, END] == 3) & (f[:, START] == 1) & (f[:, LENGTH] < 2)] = NOTICE
    titles = (f[:, CAPITALS] == 2) & ((f[:, START] == 1) | (f[:, START] == 3))
    out[(f[:, AMID] == 2) & (f[:, END] == 3) & (titles | (f[:, KIND] == 1))] = HEADER
    return out


class Lines:
    """A hidden Markov model of line labels, fitted by counting, labelling anew and counting again."""

    def fit(self, texts: list[str], rounds: int = 5) -> Lines:
        seen = [line_features(t.split("\n")) for t in texts if "\n" in t]
        labels = [_first_guess(f) for f in seen]
        for _ in range(rounds):
            # what few texts don't show: headers look like headers and stand amid text, breaks end as sentences do, notices stand at edges
            start = np.full(STATES, 1.0)
            move = np.full((STATES, STATES), 1.0)
            shown = [np.full((STATES, k), 0.5) for k in SIZES]
            shown[KIND][[BODY, BREAK, NOTICE], 0] += 1
            shown[END][[HEADER, BREAK], [3, 1]] += 1
            shown[AMID][[HEADER, NOTICE], [2, 0]] += 1
            move[BODY, BODY] += 1
            for f, y in zip(seen, labels):
                start[y[0]] += 1
                np.add.at(move, (y[:-1], y[1:]), 1)
                for j in range(len(SIZES)):
                    np.add.at(shown[j], (y, f[:, j]), 1)
            self.start = np.log(start / start.sum())
            self.move = np.log(move / move.sum(1, keepdims=True))
            self.shown = [np.log(s / s.sum(1, keepdims=True)) for s in shown]
            labels = [self.label(f) for f in seen]
        return self

    def label(self, f: np.ndarray) -> np.ndarray:
        """The most likely labels of a text's lines (Viterbi)."""
        e = sum(self.shown[j][:, f[:, j]] for j in range(len(SIZES))).T
        score, back = self.start + e[0], np.zeros((len(f), STATES), np.int64)
        for i in range(1, len(f)):
            all_ = score[:, None] + self.move
            back[i] = all_.argmax(0)
            score = all_.max(0) + e[i]
        y = np.zeros(len(f), np.int64)
        y[-1] = score.argmax()
        for i in range(len(f) - 1, 0, -1):
            y[i - 1] = back[i, y[i]]
        return y


def originals(word: str) -> list[str]:
    """Words that this one may be a misreading of: one or two places put right; a second place needs more than 5 letters or a figure in the word."""
    one = []
    for seen, true in MISREAD:
        at = word.find(seen)
        while at >= 0:
            one.append(word[:at] + true + word[at + len(seen) :])
            at = word.find(seen, at + 1)
    two = []
    digits = re.search(r"[0-9@|$]", word)
    for w in one if len(word) > 5 or digits else ():
        for seen, true in MISREAD:
            if (digits or seen in ("c", "f", "l", "b", "cl", "ii", "h", "rn", "vv")) and len(seen) + len(true) < 5:
                at = w.find(seen)
                while at >= 0:
                    two.append(w[:at] + true + w[at + len(seen) :])
                    at = w.find(seen, at + 1)
    return list(dict.fromkeys(x for x in [*one, *two] if x != word))


def reaches(word: str, original: str, places: int = 2) -> bool:
    """Whether a word becomes the original by so many places put right; what is seen and what is true never begin alike, so a place begins where they part."""
    at = next((i for i, (a, b) in enumerate(zip(word, original)) if a != b), min(len(word), len(original)))
    if at == len(word) == len(original):
        return True
    return places > 0 and any(word.startswith(seen, at) and original.startswith(true, at) and reaches(word[at + len(seen) :], original[at + len(true) :], places - 1) for seen, true in MISREAD)


def cuts(word: str, lengths: frozenset[int]) -> list[int]:
    """Where a word may be two known ones run together: parts longer than SHORT must have the length of a known word."""
    n = len(word)
    fits = lambda k: k <= SHORT or k in lengths
    if n <= 2 * SHORT:
        at = range(2, n - 1)
    else:
        at = sorted({*range(2, SHORT + 1), *range(n - SHORT, n - 1), *(k for k in lengths if 2 <= k < n - 1)})
    return [i for i in at if fits(i) and fits(n - i)]


def _in_frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows a few at a time, so that a word of many candidates doesn't fill the memory."""
    some, size = [], 0
    for r in rows:
        some.append(r)
        size += sum(len(x) for x in r if isinstance(x, str)) + 50
        if len(some) >= ROWS or size > 1 << 26:
            yield pd.DataFrame(some, columns=columns)
            some, size = [], 0
    yield pd.DataFrame(some, columns=columns)


def _candidates(lengths: frozenset[int], shared: Broadcast) -> Callable:
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        bits = shared.value
        for f in frames:
            for w, n in zip(f["word"], f["n"]):
                if len(w) < 3 or not any(c.isalpha() for c in w):
                    continue
                if len(w) <= SHORT:
                    for x in originals(w):
                        if in_bitmap(bits, x):
                            yield w, n, x, "", "misread"
                if w.isalpha() and len(w) > 5:
                    for i in cuts(w, lengths):
                        if in_bitmap(bits, w[:i]) and in_bitmap(bits, w[i:]):
                            yield w, n, w[:i], w[i:], "joined"

    return lambda frames: _in_frames(rows(frames), ["word", "n", "first", "second", "how"])


def _segments(word: str, length: int, shifts: range) -> Iterator[tuple[int, int]]:
    """(number, hash) of the segments of a word of `length`, at their places in this word moved by each of the shifts."""
    for k in range(SEGMENTS):
        a, b = k * length // SEGMENTS, (k + 1) * length // SEGMENTS
        for d in shifts:
            if 0 <= a + d and b + d <= len(word):
                yield k, xxhash.xxh64_intdigest(word[a + d : b + d]) >> 1


def _keys(known: bool, lengths: frozenset[int]) -> Callable:
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for f in frames:
            for w, n in zip(f["word"], f["n"]):
                if known:
                    for key in dict.fromkeys(_segments(w, len(w), range(1))):
                        yield w, n, len(w), *key
                elif any(seen in w for seen, _ in MISREAD):
                    for length in sorted(lengths & {*range(len(w) - 2, len(w) + 3)}):
                        for key in dict.fromkeys(_segments(w, length, range(-2, 3))):
                            yield w, n, length, *key

    return lambda frames: _in_frames(rows(frames), ["word", "n", "length", "segment", "h"])


def long_misread(words: DataFrame, known: DataFrame, lengths: frozenset[int]) -> DataFrame:
    """(word, n, first, n1): words longer than SHORT and the known words that they become by two places put right at most.

    Two places touch four of five segments at most, so the two share a segment, moved by two letters at most.
    """
    schema = "word string, n long, length int, segment int, h long"
    a = words.where(F.length("word") > SHORT).mapInPandas(_keys(False, lengths), schema)
    b = known.where(F.length("word") > SHORT).mapInPandas(_keys(True, lengths), schema).withColumnsRenamed({"word": "first", "n": "n1"})
    met = a.join(large(b), ["length", "segment", "h"]).where("word <> first").select("word", "n", "first", "n1").distinct()
    same = F.pandas_udf(lambda x, y: pd.Series([reaches(p, q) for p, q in zip(x, y)], dtype=bool), "boolean")
    return met.where(f"n1 >= n * {FIRST}").where(same("word", "first"))


def vocabulary(df: DataFrame, text_col: str) -> DataFrame:
    """(word, n): in how many texts each word of the table stands, case ignored; written once, as it is read many times."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), F.lit(0)))
    return cut(spread(df.where(F.col(text_col).isNotNull()).select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))))


def word_repairs(words: DataFrame) -> DataFrame:
    """(token, fixed): words that are misreadings of, or run together from, far commoner words.

    Far commoner are words in TIMES as many texts (a misread figure needs FIRST times as many), and of LETTERS letters also those in
    FIRST + TIMES * (n - 1) texts for n of the form, which only tells for rare originals. A part of run-together words shorter than 3 letters
    must be one of the commonest words. Words of one or two letters are too short to be taken for misread ones, and words in fewer than FIRST
    texts explain nothing.
    """
    known = words.where(F.col("n") >= FIRST).where(~F.col("word").rlike(r"[@|$\p{N}]"))
    # numbers only: how long the long ones among the known words are, and how common the commonest is
    lengths = frozenset(r["k"] for r in known.select(F.length("word").alias("k")).where(f"k > {SHORT}").distinct().collect())
    most = words.agg(F.max("n")).first()[0] or 0
    # most candidates are no known word: a bitmap of fixed size says so before anything is exchanged
    bits = words.sparkSession.sparkContext.broadcast(bitmap(known, "word"))
    tried = words.mapInPandas(_candidates(lengths, bits), "word string, n long, first string, second string, how string")
    a = known.select(F.col("word").alias("first"), F.col("n").alias("n1"))
    hit = tried.join(large(a), "first").where(f"n1 >= n * {FIRST}")
    rare = f"{FIRST} + {TIMES} * (n - 1)"
    alike = hit.where("how = 'misread'").select("word", "n", "first", "n1")
    if lengths:
        alike = alike.unionByName(long_misread(words, known, lengths))
    misread = alike.where(f"n1 >= n * {TIMES} or word rlike '[0-9@|$]' or n1 >= {rare} and length(first) >= {LETTERS}").select("word", F.col("n1").alias("score"), F.col("first").alias("fixed"))
    b = known.select(F.col("word").alias("second"), F.col("n").alias("n2"))
    common = f"greatest({most / COMMON}, n * {2 * TIMES})"
    both = (
        f"length(first) > 2 and length(second) > 2 or n1 >= {common} and length(second) > 3 or n2 >= {common} and length(first) > 3 or length(first) + length(second) > 8 and least(n1, n2) >= {2 * TIMES} * n"
    )
    # scripts without spaces run words together by right, and a short rare part is a piece of a divided word
    one = (
        f"least(n1, n2) >= {rare} and greatest(n1, n2) >= n * {TIMES * 5} and length(if(n1 <= n2, first, second)) > {LETTERS} and length(if(n1 <= n2, second, first)) > 2"
        r" and word rlike '^[\\p{IsLatin}\\p{IsCyrillic}\\p{IsGreek}]+$'"
    )
    joined = (
        hit.where("how = 'joined'").join(large(b), "second").where(f"least(n1, n2) >= n * {TIMES} and ({both}) or {one}")
        .select("word", F.least("n1", "n2").alias("score"), F.concat_ws(" ", "first", "second").alias("fixed"))
    )
    return misread.unionByName(joined).groupBy("word").agg(F.max_by("fixed", F.struct("score", "fixed")).alias("fixed")).select(F.col("word").alias("token"), "fixed")


def broken_words(df: DataFrame, text_col: str) -> DataFrame:
    """(_k1, _k2, left, right): the words divided at a line end of each text, by the text's hashes."""
    text = F.col(text_col)
    found = df.where(text.contains("\n")).select(*text_key(text), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(DIVIDED), F.lit(0)))).alias("p"))
    return found.select("_k1", "_k2", F.regexp_extract("p", r"^([^\-‐¬=\x{AD}]+)", 1).alias("left"), F.regexp_extract("p", r"([\p{L}\p{M}]+)$", 1).alias("right"))


def divided_words(broken: DataFrame, words: DataFrame) -> DataFrame:
    """(left, right, joins): the distinct pairs divided at a line end, and whether they were one word.

    They were two if the form with a hyphen is the commoner one, or, of pairs that stand in neither form, if both parts stand alone
    FIRST times as often as they are divided so; what stands at a divided place doesn't stand alone.
    """
    pairs = broken.groupBy("left", "right").agg(F.count("*").alias("n"))
    for side in ("left", "right"):
        pairs = pairs.withColumn(f"d_{side}", F.sum("n").over(Window.partitionBy(side)))
    forms = (("one", F.concat("left", "right")), ("two", F.concat_ws("-", "left", "right")), ("l", F.col("left")), ("r", F.col("right")))
    asked = pairs.select("left", "right", "n", "d_left", "d_right", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), c.alias("word")) for k, c in forms])).alias("x")).select("*", "x.*").drop("x")
    counted = asked.join(large(words.withColumnRenamed("n", "texts")), "word", "left")
    there = counted.groupBy("left", "right", "n", "d_left", "d_right").agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("texts"))), F.lit(0)).alias(f"n_{k}") for k, _ in forms])
    alone = (F.col("n_l") - F.col("d_left") >= FIRST * F.col("n")) & (F.col("n_r") - F.col("d_right") >= FIRST * F.col("n"))
    compound = (F.col("n_two") > F.col("n_one")) | (F.col("n_one") == 0) & (F.col("n_two") == 0) & alone
    return there.select("left", "right", (~compound).alias("joins"))


#: What a text holds in which _digits_in_word is true of any word.
_FIGURED = re.compile(r"[^\W\d_][0159@|8$][^\W\d_]|[0|][^\W\d_]{3}")


def _digits_in_word(token: str) -> bool:
    return bool(re.search(r"[^\W\d_][0159@|8$][^\W\d_]|^[0|][^\W\d_]{3}", token)) and sum(c.islower() for c in token) >= 3


def assess(text: str, fixes: dict[str, str], pairs: dict[str, bool], model: Lines) -> tuple[str, list[str]]:
    """The repaired text and the kinds of damage found in it."""
    kinds = []
    lines = text.split("\n")
    labels = np.full(len(lines), BODY)
    if len(lines) > 1:
        labels = model.label(line_features(lines))
        if (labels == HEADER).any() and (labels != HEADER).any():
            kinds.append("header")
            keep = labels != HEADER
            lines, labels = [x for x, k in zip(lines, keep) if k], labels[keep]
    body = "\n".join(lines)
    if STRAY.search(body) or _QUOTE.search(body) and body.count("«") != body.count("»"):
        kinds.append("stray")
        body = STRAY.sub("", body)
        if body.count("«") != body.count("»"):
            body = _QUOTE.sub("", body)
        body = re.sub(r"(?<=\S) {2,}(?=\S)", " ", body)
        body = "\n".join(x.strip() if x != x.strip() else x for x in body.split("\n"))
    if SPREAD.search(body):
        kinds.append("spread")
        body = SPREAD.sub(lambda m: m.group().replace(" ", ""), body)
    divided, merged = False, set()

    def join(m: re.Match) -> str:
        nonlocal divided
        left, mark, gap, right = m.groups()
        merged.add(m.string.count("\n", 0, m.start()))
        if mark in "¬=" or pairs.get(f"{left.lower()}\n{right.lower()}", True):
            divided = True
            return left + right
        return f"{left}-{right}"

    body = _DIVIDED.sub(join, body)
    if divided:
        kinds.append("divided")
    changed: list[str] = []

    def fix(m: re.Match) -> str:
        w = m.group()
        good = fixes.get(w.lower())
        if good is None and not (_digits_in_word(w)):
            return w
        changed.append(w)
        if good is None:
            good = w
            for a, b in (("0", "o"), ("1", "l"), ("5", "s"), ("9", "g"), ("@", "a"), ("|", "l"), ("8", "b"), ("$", "s")):
                good = good.replace(a, b)
            return good[0].upper() + good[1:] if w[0] in "0|" else good
        return good.upper() if w.isupper() and len(w) > 1 else good[0].upper() + good[1:] if w[0].isupper() or w[0] in "8|" else good

    if fixes or _FIGURED.search(body):
        body = _WORD.sub(fix, body)
    if changed:
        kinds.append("joined" if all(" " in fixes.get(w.lower(), "") for w in changed) else "misread")
    # a line that took the first word of the next has become one with it
    kept: list[int] = []
    for i, k in enumerate(labels.tolist()):
        if i - 1 in merged:
            kept[-1] = k
        else:
            kept.append(k)
    return _flow(body.split("\n"), kept), kinds


def _flow(lines: list[str], labels: list[int]) -> str:
    """Lines of one paragraph run on; a line labelled as a break ends a paragraph, a notice and what is set apart stands alone.

    A line that goes on in small letters runs on, whatever the labels say.
    """
    lines = [x.strip() for x in lines]
    small = [x[:1].islower() for x in lines]
    own = [k == NOTICE and not small[i] and not (i + 1 < len(lines) and small[i + 1]) for i, k in enumerate(labels)]
    out: list[str] = []
    for i, x in enumerate(lines):
        if not x:
            continue
        before = lines[i - 1] if i else ""
        ends = i > 0 and labels[i - 1] == BREAK
        if out and before and (small[i] or not (ends or own[i] or own[i - 1] or _apart(before) or _apart(x))):
            close = "⺀" <= before[-1] <= "￯" or "฀" <= before[-1] <= "๿"
            out[-1] += x if close else " " + x
        else:
            out.append(x)
    return "\n".join(out)


def _apart(line: str) -> bool:
    """A notice or heading: no sentence end, or mostly capitals, standing on its own line."""
    words = re.findall(r"[^\W\d_]+", line)
    return bool(words) and (line.startswith("©") or line.isupper() or not re.search(r"[a-zß-ÿ,]$|[-‐]$", line) and sum(w[0].isupper() for w in words) > 0.5 * len(words))


def repair_scans(df: DataFrame, text_col: str, out: str = "readable_text", sample: int = SAMPLE) -> DataFrame:
    """Every row of df with `out`, its text as continuous paragraphs, and `scan_damage`, an array of the kinds of damage found.

    Kinds are header, stray, spread, divided, misread and joined. Null stays null with an empty array; columns of those names are replaced.
    """
    base = df.drop(*[c for c in (out, "scan_damage") if c != text_col])
    t = F.col(text_col)
    words = vocabulary(base, text_col)
    repairs = cut(word_repairs(words))
    broken = cut(broken_words(base, text_col))
    pairs = divided_words(broken, words)
    # the commonest words that need no repair aren't exchanged: none of the words that are is in more than a small part of the texts
    often = [r["word"] for r in words.join(large(repairs.select(F.col("token").alias("word"))), "word", "left_anti").orderBy(F.desc("n"), "word").limit(OFTEN).collect()]
    found = F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0)))
    rarer = F.filter(found, lambda w: ~w.isin(often)) if often else found
    by_word = base.where(t.isNotNull()).select(*text_key(t), F.explode(rarer).alias("token"))
    fixes = salted(by_word, repairs, ["token"], F.col("_k1"))
    splits = salted(broken, pairs, ["left", "right"], F.col("_k1")).select("_k1", "_k2", F.concat_ws("\n", "left", "right").alias("token"), F.when(F.col("joins"), "1").otherwise("0").alias("fixed"))
    a, b, map_ = fresh(base, "k1"), fresh(base, "k2"), fresh(base, "fixes")
    hits = fixes.select("_k1", "_k2", "token", "fixed").unionByName(splits).groupBy(F.col("_k1").alias(a), F.col("_k2").alias(b)).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("token", "fixed")))).alias(map_))
    model = Lines().fit(sample_texts(base.where(t.contains("\n")), text_col, sample))

    def judge(texts: pd.Series, fixes: pd.Series) -> pd.DataFrame:
        rows = []
        for x, f in zip(texts, fixes):
            if x is None:
                rows.append((None, []))
                continue
            f = dict(f) if f is not None else {}
            rows.append(assess(x, {k: v for k, v in f.items() if "\n" not in k}, {k: v == "1" for k, v in f.items() if "\n" in k}, model))
        return pd.DataFrame(rows, columns=["fixed", "kinds"])

    keyed = base.select("*", *[c.alias(k) for c, k in zip(text_key(t), (a, b))]).join(large(hits), [a, b], "left")
    made = fresh(base, "r")
    judged = keyed.withColumn(made, F.pandas_udf(judge, "fixed string, kinds array<string>")(t, F.col(map_)))
    return judged.withColumn(out, F.col(f"{made}.fixed")).withColumn("scan_damage", F.col(f"{made}.kinds")).drop(made, a, b, map_)
