"""Problem 7: headings as typed, mapped to the entries of a reference list.

Headings are brought to one form and cut into tokens. Each distinct token meets the words of the reference list that
share letter pairs with it and is repaired by edit distance, abbreviation or truncation; entries are then ranked by soft
TF-IDF over the repaired tokens, and a heading whose own words the best entry leaves unexplained is unmatched.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, salted, spread, text_key
from .forms import one_form

#: Least score at which an entry is taken.
LEAST = 0.5
#: Words around headings that name nothing, and characters that scans put for others.
NOISE = frozenset(
    "extract overview summary enclosure annexure annex appendix section chapter part schedule contd continued cont our the of to for a an in and year fy page see note no item volume vol ended at by on from".split()
)
COMPANY = frozenset("limited ltd plc inc corp company co holdings industries group llp pvt private".split())
MISREAD = (("0", "o"), ("1", "l"), ("5", "s"), ("8", "b"), ("3", "e"), ("6", "b"), ("9", "g"), ("@", "a"), ("$", "s"), ("|", "l"), ("!", "i"))
GROUPS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("lv", "w"))
_ROMAN = re.compile(r"(?=[ivx])(x{0,3})(ix|iv|v?i{0,3})")


def _spaced(text: str) -> str:
    """Letters typed with spaces between them, words with wider gaps, brought together."""
    bits = text.split()
    if len(bits) >= 3 and sum(len(b) == 1 for b in bits) >= (0.7 if len(bits) > 4 else 1) * len(bits):
        return " ".join(w.replace(" ", "") for w in re.split(r"\s{2,}", text.strip()))
    return text


def _tokens(text: str) -> list[str]:
    text = text.lower().replace("&", " and ").replace("’", "'").replace("`", "'")
    text = re.sub(r"\bmd ?and ?a\b|\bmd and a\b", "mdanda", text)
    text = re.sub(r"'(s|S)\b", "", text)
    out = []
    for m in re.finditer(r"[a-z0-9@$|!'à-ÿ]+(\.(?!\d))?", text):
        w = m.group().rstrip(".").strip("'!|").replace("'", "")
        if w:
            out.append(w + ("." if m.group(1) else ""))
    return out


def variants(heading: str) -> list[str]:
    """Forms of a heading to be ranked: the whole, and its parts between dashes, colons and brackets; tokens joined by spaces.

    The last token ends with '~' where the heading may have been cut off there, and abbreviated ones keep their full stop.
    """
    text = _spaced(heading.replace("…", "..."))
    cut = bool(re.search(r"\.\.\.\s*$|[-‐]\s*$", text))
    text = re.sub(r"^\s*[\(\[]?\s*(?:\d+(?:\.\d+)*|[ivxIVX]{1,4}|[a-zA-Z])\s*[\)\].:]\s*", " ", text)
    pieces = [text, *re.split(r"\s[-–—|]\s|\s*[–—:|()\[\]]\s*", text)]
    out = []
    for i, piece in enumerate(pieces):
        tokens = _tokens(piece)
        tokens = [t for t in tokens if not re.fullmatch(r"[\d]+\.?", t) and not (_ROMAN.fullmatch(t.rstrip(".")) and len(t) < 5)]
        if tokens and sum(map(len, tokens)) > 1:
            last = i == 0 or piece is pieces[-1]
            form = " ".join(tokens) + ("~" if last or cut else "")
            if form not in out:
                out.append(form)
    return out


def plain(token: str) -> str:
    return token.rstrip("~").rstrip(".")


def distance(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance of neighbours, or most + 1 if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def _readings(token: str) -> list[str]:
    t = token
    for a, b in MISREAD:
        t = t.replace(a, b)
    out = [token, t]
    for a, b in GROUPS:
        out += [x.replace(a, b) for x in (t,) if a in x]
    return list(dict.fromkeys(out))


def similarity(token: str, word: str) -> float:
    """How well a token, with its marks, stands for a word of the reference list; 0 if it doesn't."""
    cut, dot = token.endswith("~"), token.rstrip("~").endswith(".")
    t = plain(token)
    if t == word:
        return 1.0
    n, best = len(word), 0.0
    most = 0 if n < 3 else 1 if n < 6 else 2 if n < 9 else 3
    for k, r in enumerate(_readings(t)):
        if r == word:
            return 0.97
        d = distance(r, word, most)
        if d <= most:
            best = max(best, 1 - d / max(n, len(r)) - 0.01 * k)
    if len(t) >= 2 and n > len(t) and word[0] == t[0]:
        rest = iter(word)
        inside = all(c in rest for c in t)
        vowels = any(c in "aeiou" for c in t)
        if word.startswith(t) and (cut or dot):
            best = max(best, 0.92 if len(t) > 2 else 0.8)
        elif inside and len(t) <= 0.75 * n and (dot or not vowels or len(t) > 2 and t[-1] == word[-1]):
            best = max(best, 0.9 if len(t) > 2 else 0.5)
        elif cut and len(t) >= 4 and distance(t, word[: len(t)], 1) <= 1:
            best = max(best, 0.8)
    return best if best >= 0.55 else 0.0


def _pairs(word: str) -> list[str]:
    w = f"^{word}$"
    return list(dict.fromkeys(w[i : i + 2] for i in range(len(w) - 1)))


def repaired(forms: DataFrame, words: list[str]) -> DataFrame:
    """(token, word, sim): every distinct token of the forms with the reference words it may stand for.

    Words meet tokens by letter pairs, and are compared if they share as many as the edits that a word of that length may have can leave (an edit,
    also of two letters exchanged, takes three pairs at most), or if they begin alike and the token is much shorter or cut off.
    """
    spark = forms.sparkSession
    tokens = spread(forms.select(F.explode(F.split("form", " ")).alias("token")).distinct())
    readings = F.pandas_udf(lambda s: s.map(lambda t: list(dict.fromkeys([p for r in _readings(plain(t)) for p in _pairs(r)] + ["^" + plain(t)[:1]]))), "array<string>")
    left = tokens.withColumn("pair", F.explode(readings("token")))
    right = spark.createDataFrame([(w, p) for w in words for p in dict.fromkeys(_pairs(w))], "word string, pair string")
    bare = F.length(F.regexp_replace("token", r"[.~]+$", ""))
    n = F.length("word")
    most = F.when(n < 3, 0).when(n < 6, 1).when(n < 9, 2).otherwise(3)
    met = left.join(right, "pair").groupBy("token", "word").agg(F.count("*").alias("_shared"), F.max(F.col("pair").startswith("^")).alias("_first"))
    met = met.where((F.col("_shared") >= n + 1 - 3 * most) & (F.abs(bare - n) <= most + 2) | F.col("_first") & ((bare <= 0.75 * n) | F.col("token").rlike("[.~]$")))
    sim = F.pandas_udf(lambda t, w: pd.Series([similarity(a, b) for a, b in zip(t, w)], dtype="float64"), "double")
    # few bytes but much work a row
    return spread(met.select("token", "word")).withColumn("sim", sim("token", "word")).where("sim > 0")


class Entries:
    """The reference list: entries with their tokens, and the weight of each word."""

    def __init__(self, entries: list[tuple[str, str]]):
        self.entries = [(code, [plain(t) for t in _tokens(name)]) for code, name in entries]
        count = Counter(w for _, ws in self.entries for w in set(ws))
        n = len(self.entries)
        self.weight = {w: (0.12 if w in NOISE else 1.0) * (math.log(1 + n / c)) for w, c in count.items()}
        self.unknown = math.log(1 + n) * 0.9
        self.holds = defaultdict(list)
        for i, (_, ws) in enumerate(self.entries):
            for w in set(ws):
                self.holds[w].append(i)

    def rank(self, form: str, sims: dict[str, list[tuple[str, float]]]) -> tuple[float, str | None]:
        tokens = form.split(" ")
        near: set[int] = {i for t in tokens for w, _ in sims.get(t, ()) for i in self.holds[w] if self.weight[w] > 0.4}
        best, code = 0.0, None
        for i in sorted(near):
            c, words = self.entries[i]
            need = sum(self.weight[w] ** 2 for w in words)
            got, used, taken = 0.0, {}, set()
            options = sorted(((s, k, w) for k, t in enumerate(tokens) for w, s in sims.get(t, ()) if w in words), key=lambda x: (-x[0], abs(x[1] - words.index(x[2]))))
            for s, k, w in options:
                if k not in used and w not in taken:
                    used[k] = s, w
                    taken.add(w)
                    got += self.weight[w] ** 2 * s
            own = mine = 0.0
            for k, t in enumerate(tokens):
                p = plain(t)
                if k in used:
                    s, w = used[k]
                    own += self.weight[w] ** 2
                    mine += self.weight[w] ** 2 * s
                elif p in NOISE or re.search(r"\d{2}", p) or len(p) == 1:
                    continue
                elif any(s > 0.74 and w in NOISE for w, s in sims.get(t, ())) or _is_noise(p):
                    continue
                else:
                    own += (self.unknown if not sims.get(t) else max(0.7 * self.unknown, max(self.weight[w] for w, _ in sims[t]))) ** 2
            # a heading may be cut short, but all of its own words must be explained
            score = math.sqrt(got / need) * (mine / own if own else 0.0)
            if score > best + 1e-9:
                best, code = score, c
        return best, code


_LONG_NOISE = ("extract", "overview", "summary", "enclosure", "annexure", "section", "continued", "contd")


def _is_noise(p: str) -> bool:
    """A noise word, misread or misspelt."""
    return any(distance(r, x, 2 if len(x) > 6 else 1) <= (2 if len(x) > 6 else 1) for r in _readings(p) for x in _LONG_NOISE if len(r) > 4)


def _company(form: str) -> bool:
    return any(plain(t) in COMPANY or t.endswith("~") and len(plain(t)) > 1 and any(c.startswith(plain(t)) for c in COMPANY) for t in form.split(" ")[1:])


def canonical(df: DataFrame, text_col: str, entries: list[tuple[str, str]], least: float = LEAST) -> DataFrame:
    """Every row of df with `category_code` (UNMATCHED if its text names no entry) and `match_score`; columns of those names are replaced.

    `entries` are pairs of a code and a name, several names a code. Null and empty texts are UNMATCHED with score 0. Of entries with equal
    score the first wins.
    """
    base = df.drop(*[c for c in ("category_code", "match_score") if c != text_col])
    formed = spread(one_form(base.select(text_col).where(F.col(text_col).isNotNull()).distinct(), text_col, "_normal")).select(F.col(text_col).alias("_text"), "_normal")
    forms_of = F.pandas_udf(lambda s: s.map(variants), "array<string>")
    # read four times below, and no larger than the distinct texts
    by_text = cut(formed.withColumn("_forms", forms_of("_normal")))
    forms = by_text.select(F.explode("_forms").alias("form")).distinct()
    ranked = Entries(entries)
    words = sorted(ranked.weight)
    sims = repaired(forms, words).groupBy("token").agg(F.collect_list(F.struct("word", "sim")).alias("near"))
    per_form = forms.withColumn("token", F.explode(F.array_distinct(F.split("form", " ")))).join(sims, "token").groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("token", "near"))).alias("near"))
    per_form = spread(per_form)

    def rank(form: pd.Series, near: pd.Series) -> pd.DataFrame:
        rows = []
        for f, m in zip(form, near):
            rows.append(ranked.rank(f, {k: [(x["word"], x["sim"]) for x in v] for k, v in dict(m).items()}))
        return pd.DataFrame(rows, columns=["score", "code"])

    scored = per_form.select("form", F.pandas_udf(rank, "score double, code string")("form", "near").alias("r")).select("form", "r.*").where("code is not null")
    whole = by_text.select("_text", F.posexplode("_forms").alias("_at", "form"), F.col("_forms")[0].alias("_whole")).join(scored, "form")
    # a part alone counts a little less than the whole
    best = whole.groupBy("_text").agg(F.max_by(F.struct("code", "score"), F.struct((F.col("score") - F.least("_at", F.lit(1)) * 0.02).alias("s"), (-F.col("_at")).alias("a"))).alias("b"))
    # headings meet their texts by hashes; one heading may be a third of all rows
    a, b, code, score = (fresh(base, x) for x in ("k1", "k2", "code", "score"))
    best = best.select(*[c.alias(k) for c, k in zip(text_key(F.col("_text")), (a, b))], F.col("b.code").alias(code), F.col("b.score").alias(score))
    keyed = base.select("*", *[c.alias(k) for c, k in zip(text_key(F.col(text_col)), (a, b))])
    out = salted(keyed, best, [a, b], F.monotonically_increasing_id(), "left").drop(a, b)
    good = F.coalesce(F.col(score) >= least, F.lit(False))
    return out.withColumn("category_code", F.when(good, F.col(code)).otherwise("UNMATCHED")).withColumn("match_score", F.coalesce(F.col(score), F.lit(0.0))).drop(code, score)
